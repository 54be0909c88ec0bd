"""Cases that once failed: deep and hostile pages, bounds of samples, repeated ids, ledgers, odd values."""

import hashlib
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from screenfold.llm import jaccard, language, lm_scores, mixing, pages, pieces, quality, queries, secrets, token_counts, trees, vectors

WORDS = "one two three four five six seven eight nine ten eleven twelve"


def test_deep_pages_and_odd_markup_take_linear_time():
    deep = "<div>" * 100_000 + "end" + "</div>" * 100_000
    assert pages.main_text(pages.parse(deep)) == "end"
    assert pages.main_text(pages.parse("<b>" * 100_000 + "x" + "</i>" * 100_000)) == "x"
    began = time.time()
    for piece in ('<a "', '<a b="', "<a b='", "<", "</b", "<li>", "<td><table>", "<script></script ", "<!-", "<p ="):
        pages.main_text(pages.parse(piece * (300_000 // len(piece)) + ">tail"))
    assert time.time() - began < 60


def test_tags_end_after_quoted_values():
    assert pages.main_text(pages.parse('<p title="a > b">x</p><p data-x=\'">\'>y</p>')) == "x y"
    assert pages.main_text(pages.parse('<p title="open>x</p><p>y</p>')) == "x y"
    assert pages.main_text(pages.parse("a<b c<p>d")) == "ad"
    assert pages.main_text(pages.parse("<p>a<!-- <p>b --><p>c<!-- d")) == "a c"


def nameless(i, side=""):
    menu = "".join(f"<li><a href='/{k}'>go {k} {i % 3}</a></li>" for k in range(5))
    return f"<body><div class='k1'><ul>{menu}</ul></div><div class='k2'>Short offer number {i}.</div><div class='k3'><h1>Title {i}</h1><p>Story {i} runs over a good many words, so that it is the most of the page.</p><p>It has a second paragraph {i}.</p>{side}</div><div class='k4'>Made by us, {i}.</div></body>"


def test_slots_decide_where_names_mean_nothing(spark):
    rows = [(i, "http://h.org/a", nameless(i, f"<div class='k5'><a href='/x'>see also {i}</a> <a href='/y'>and this</a></div>" if i % 2 else "")) for i in range(40)]
    rows += [(100, "http://alone.org/b", nameless(7)), (101, "http://h.org/c", "<p>Another kind of page</p>"), (102, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Title {i} Story {i} runs over a good many words, so that it is the most of the page. It has a second paragraph {i}." for i in range(40)}
    for named in (True, False):
        got = {r["page_id"]: r for r in pages.extract(df, named=named).collect()}
        assert {i: got[i]["text"] for i in range(40)} == want
        assert got[101]["text"] == "Another kind of page" and got[102]["text"] == "" and got[102]["n_chars"] == 0
        assert all(got[i]["by_template"] for i in range(40))
    assert len(got) == 43


def test_every_constant_text_of_a_slot_is_template(spark):
    """Four texts of one slot recur on all pages; only one of them was found."""

    def page(i):
        notes = "".join(f"<div class='n'>{t}</div>" for t in ("Made with care.", "All rights are kept.", "Open from nine to five.", f"Printed as number {i}.", "Call us."))
        return f"<body><p>Title {i}</p><p>Story {i} has its own words.</p>{notes}</body>"

    df = spark.createDataFrame([(i, "http://h.org/a", page(i)) for i in range(20)], "page_id long, url string, html string")
    trees_ = {i: pages.parse(page(i)) for i in range(20)}
    template = pages.induce(list(trees_.values()))
    for named in (True, False):
        got = {r["page_id"]: r["text"] for r in pages.extract(df, named=named).collect()}
        assert got == {i: f"Title {i} Story {i} has its own words. Printed as number {i}." for i in range(20)}
        assert got == {i: pages.main_text(t, template) for i, t in trees_.items()}
    rows = df.selectExpr("1L AS host", "html").union(df.selectExpr("2L AS host", "html").limit(1))
    found = {r["host"]: r for r in pages.templates(rows).collect()}
    assert set(found[1]["constants"]) == template.constants and len(template.constants) == 4
    assert set(found[1]["menus"] or ()) == template.menus and not (2 in found and found[2]["constants"])


def test_the_template_alone_finds_what_names_find(spark):
    """Every page of the table, with and without all lists of names."""
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    with_names, without = ({r["page_id"]: (r["text"], r["by_template"]) for r in pages.extract(df, named=n).collect()} for n in (True, False))
    assert with_names == without and all(by for _, by in without.values()) and len(without) == df.count()


def test_a_long_text_takes_no_language_s_place(spark):
    rows = [(i, f"{WORDS} {i} " * 5, "en") for i in range(0, 60)] + [(i, f"eins zwei drei vier fünf {i} " * 5, "de") for i in range(60, 120)]
    rows += [(1000 + i, "lang " * 20_000, "en") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, sample=400, longest=50_000)
    assert model is not None and model.langs == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, model=model).collect()}
    assert all(got[i] == ("en" if i < 60 else "de") for i in range(120))
    assert not language.has_letter("² ½ 12 _ Ⅷ") and language.has_letter("2 ª") and language.has_letter("字")


def test_repeated_ids_give_the_same_forest(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 150, " ".join(rng.choice(WORDS.split(), 80))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, quality int")
    one, two = (quality.train(d, labels, sample=100) for d in (docs, docs.repartition(7)))
    x = rng.random((50, len(quality.FEATURES)))
    assert one[1] == two[1] and (one[0].predict(x) == two[0].predict(x)).all()


def test_forests_equal_a_walk_down_their_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, len(quality.FEATURES)))
    y = ((x[:, 0] + x[:, 3] * x[:, 4]) > 0).astype(float)
    forest = trees.fit(x, y, list(quality.FEATURES.values()))
    assert abs(forest.predict(x) - y).mean() < 0.25
    up = [k for k, sign in enumerate(quality.FEATURES.values()) if sign]
    assert up
    for k in up:
        moved = np.repeat(x[:40], 9, axis=0)
        moved[:, k] = np.tile(np.linspace(-3, 3, 9), 40)
        steps = np.diff(forest.predict(moved).reshape(40, 9), axis=1) * list(quality.FEATURES.values())[k]
        assert (steps >= -1e-12).all()


def test_one_of_each_keeps_rows_of_one_id_that_are_not_alike(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a, "x"), (5, b, "y"), (6, a + " tail", "z"), (7, None, "n"), (7, "", "e"), (None, b, "w"), (None, "alone at last here now yes", "v"), (5, a, "x"), (9, "", "e2")]
    got = sorted(r["source"] for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string"), jaccard.Threshold(5, 80, 100)).collect())
    assert got == ["e", "e2", "n", "v", "x", "y"]


def test_a_second_rule_version_scans_only_its_own_pairs(spark):
    docs = spark.createDataFrame([(1, "secret=abcdef1"), (2, "-----BEGIN PRIVATE KEY-----"), (None, "token: zzzzzzz"), (3, None)], "doc_id long, text string")
    _, ledger = secrets.scan_versions(docs, rules=tuple(r for r in secrets.RULES if r.base))
    findings, new = secrets.scan_versions(docs, ledger)
    assert {r["rule"] for r in ledger.collect()} == {"assign", "access", "hex"} and not {r["rule"] for r in new.collect()} & {"assign", "access", "hex"}
    whole = secrets.report(secrets.scan_versions(docs)[0]).collect()
    assert sorted(map(str, secrets.report(findings).collect())) == sorted(map(str, whole))


ODD = [(1, None), (2, ""), (3, " \n"), (4, "Hello world, again"), (4, "Hello world, again"), (4, "other text"), (None, "no id"), (5, "long " * 30_000)]


def clashing(spark):
    return spark.createDataFrame([(i, t, "k", 1, 2, "b", "s", 0.5) for i, t in ODD], "doc_id long, text string, key string, ids int, size int, blob string, spans string, score double")


def test_values_of_odd_rows(spark):
    docs = clashing(spark)
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {t: sp.encode(t or "") for _, t in ODD}
    got = pieces.encode_digests(docs, queries.PIECE_MODEL).collect()
    want = [(i, len(ids[t]), sha(",".join(map(str, ids[t]))), sha(sp.decode(ids[t]))) for i, t in ODD]
    assert sorted(map(str, ((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got))) == sorted(map(str, want))
    lib = Tokenizer.from_file(queries.WORD_TOKENIZER)
    got = token_counts.count_tokens(docs, queries.WORD_TOKENIZER).collect()
    want = [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD]
    assert sorted(map(str, ((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got))) == sorted(map(str, want))
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(docs, sample=5).collect()} if "lang" in docs.columns else set()
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.near_classes(docs).collect())))
    assert got == sorted(map(str, [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (4, 1, 4), (None, 1, None), (5, 1, 5)]))
    taken = mixing.repeat(docs.withColumn("source", F.lit("s"))).groupBy("text").count().collect()
    assert {r["text"] for r in taken} <= {t for _, t in ODD if t and t.split()} and all(r["count"] >= 1 for r in taken)


def test_unlabelled_and_null_texts_are_und(spark):
    rows = [(i, t, "en", "x") for i, t in ODD] + [(i, f"{WORDS} {i}", "en", "y") for i in range(10, 40)]
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), sample=50).collect()
    assert len(got) == len(rows)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (1, 2, 3)) and all(r["lang_pred"] == "en" for r in got if r["doc_id"] in (4, 5))


def test_scores_of_repeated_ids_and_clashing_columns(spark):
    docs = clashing(spark)
    labels = spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, quality int")
    got = lm_scores.score(docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in ODD)
    same = {r["score"] for r in got if r["doc_id"] == 4 and r["n_tokens"] == 3}
    assert len(same) == 1


def test_vectors_without_links_are_not_joined(spark):
    rows = [(i, None, 7) for i in range(50)] + [(100, [1.0, 0.0], 1), (101, [1.0, 0.01], 2), (None, [0.0, 0.0], 3)]
    got = {r["vec_id"]: tuple(r)[1:] for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")).collect()}
    assert len(got) == 53 and all(got[i] == (0, i, True) for i in range(50)) and got[101] == (1, 100, False) and got[None] == (0, None, False)


def test_a_word_of_any_length_keeps_few_states():
    own = token_counts.WordTransducer.__init__.__defaults__
    assert own
    counter = token_counts.TokenCounter(queries.WORD_TOKENIZER, most=50)
    lib = Tokenizer.from_file(queries.WORD_TOKENIZER)
    rng = np.random.default_rng(2)
    word = "".join(rng.choice(list("abcdefghij"), 20_000))
    assert counter.count(word) == len(lib.encode(word, add_special_tokens=False).ids)


def test_distinct_stretches_and_words_are_counted_once(monkeypatch):
    """The transducer ran once for each sentence a word ended, and each text was normalised whole."""
    counter = token_counts.TokenCounter(queries.WORD_TOKENIZER)
    lib = Tokenizer.from_file(queries.WORD_TOKENIZER)
    asked, merged, plain, merge = [], [], counter.fst.count, counter.fst.merged
    monkeypatch.setattr(counter.fst, "count", lambda w: asked.append(w) or plain(w))
    monkeypatch.setattr(counter.fst, "merged", lambda s: merged.append(s) or merge(s))
    texts = [f"Unforeseeable {'('*(i % 3)}consequences{'.,;!'[i % 4]} of it" for i in range(200)]
    got = counter.counts(pa.array(texts))
    assert got.tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(asked) == len(set(asked)) and {b"unforeseeable", b"consequences"} <= set(asked)
    assert merged and all("".join(m) in counter.fst.made or len(m) == 1 for m in merged)  # tokens alone, never a pair


def test_counts_of_arrays_equal_the_library():
    lib = Tokenizer.from_file(queries.WORD_TOKENIZER)
    odd = [None, "", " ", "\n a\tb\x0bc\x0cd\re ", "a\x1cb \x85c\xa0d\u3000e\u2028f", "e \u0301 e\u0301 \u212bX", "a<|endoftext|>b <|startoftext|>\n<|endoftext|", "ΑΣ Σ ΣΑΣ.", "漢字 かな' 's it's IT'S", "long words " * 9_000, "x" * 70_000]
    want = [len(lib.encode(t or "", add_special_tokens=False).ids) for t in odd]
    for most, chunk in ((250_000, 1 << 16), (3, 1 << 16), (250_000, 4)):
        counter = token_counts.TokenCounter(queries.WORD_TOKENIZER, chunk_chars=chunk, most=most)
        for kind in (pa.string(), pa.large_string()):
            texts = pa.array(["dropped"] + odd, kind)[1:]
            assert counter.counts(texts).tolist() == want and counter.counts(texts[3:7]).tolist() == want[3:7] and counter.counts(texts[:0]).tolist() == []
            assert counter.counts(texts[:1]).tolist() == [0]


def test_pairs_of_tokens_by_their_edges_as_by_merging():
    fst = token_counts.TokenCounter(queries.WORD_TOKENIZER).fst
    assert fst.made
    rng = np.random.default_rng(3)
    nodes = [k for k, t in enumerate(fst.token_at) if t]
    short = [k for k in nodes if len(fst.token_at[k]) < 4]
    for group in (nodes, short):
        for a, b in rng.choice(group, (4000, 2)):
            if not fst.token_at[a][-1].endswith("</w>"):
                assert fst._stays(a, b) == (fst.merged(fst.token_at[a] + fst.token_at[b]) == ["".join(fst.token_at[a]), "".join(fst.token_at[b])])
    # ranks out of order, and a token made twice: pairs are merged
    assert token_counts.WordTransducer([("ab", "c"), ("a", "b")], {}, "</w>").made is None
    odd = token_counts.WordTransducer([("a", "b"), ("b", "c"), ("ab", "c"), ("a", "bc")], {}, "</w>")
    assert odd.made is None
    for word in (b"abc", b"aabcc", b"abcabc", b"bcab"):
        assert odd.count(word) == len(odd.merged(tuple(chr(x) for x in word[:-1]) + (chr(word[-1]) + "</w>",)))


def test_every_document_of_the_smallest_table_packs(spark):
    from tests.llm.test_new_operators import check_packing

    at = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{at}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    used, least = check_packing(queries.op12_packing(spark, at).collect(), [(d["doc_id"], d["text"]) for d in docs])
    assert used <= 1.01 * least + 1


@pytest.mark.parametrize("name", ["op8_mixing", "op13_negatives"])
def test_queries_with_sql_equal_it(spark, name):
    import duckdb

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{at}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, at).toPandas()[list(want.columns)]
    order = list(want.columns)
    a, b = (d.sort_values(order).reset_index(drop=True) for d in (got, want))
    assert len(a) == len(b) and all(np.allclose(a[c].astype(float), b[c].astype(float)) for c in order) and len(a)
