"""Operators on small tables: nulls, empty and long texts, repeated rows, clashing columns, no rows."""

import hashlib
import math
import re
from collections import Counter
from dataclasses import replace

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from screenfold.llm import jaccard, language, lm_scores, mixing, pages, pieces, quality, queries, secrets, token_counts, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, size string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    texts = [None, "", "   ", "a", base, base, base + " x", "word " * 5000, "token: abcdefghij AKIA" + "A" * 20, "x" * 70_000, base.upper(), " ".join(f"w{i}" for i in range(80)), "."]
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else f"s{i % 3}", 0, "c", "c", "c", "c") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, base, None, None, None, "", "", "", "")], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 0), (3, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")


def test_every_operator_takes_odd_rows_and_none(spark, docs, labels):
    pagest = docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), F.lit("z").alias("host"))
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [0.0, 1.0]), (9, [float("inf"), 1.0]), (10, [1.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    runs = {
        "pieces": lambda d: pieces.encode_digests(d, queries.PIECE_MODEL),
        "texts": lambda d: pieces.encode_texts(d, queries.PIECE_MODEL),
        "counts": lambda d: token_counts.count_tokens(d, queries.WORD_TOKENIZER),
        "lm": lambda d: lm_scores.score(d, labels),
        "language": lambda d: language.identify(d, sample=50),
        "secrets": lambda d: secrets.report(secrets.scan_versions(d)[0]),
        "mixing": mixing.mix,
        "jaccard": jaccard.near_classes,
        "quality": lambda d: quality.judge(d, labels),
        "good": lambda d: quality.keep_good(d, labels),
        "redact": secrets.redact_documents,
        "repeat": mixing.repeat,
        "one": lambda d: jaccard.one_of_each(d, jaccard.Threshold(5, 80, 100)),
    }
    changes = {"good", "repeat", "one"}
    for name, run in runs.items():
        n = run(docs).count()
        assert n <= docs.count() if name in changes - {"repeat"} else name == "repeat" or n == docs.count(), name
        assert run(docs.limit(0)).count() == 0, name
    assert pages.extract(pagest).count() == pagest.count() and pages.extract(pagest.limit(0)).count() == 0
    got = {}
    for r in vectors.near_vectors(vec).collect():
        got[r["vec_id"]] = (r["n_links"], r["component_id"], r["kept"])
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[7] == (3, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 8, 9, 10))
    assert vectors.near_vectors(vec.limit(0)).count() == 0


def test_secrets_by_plain_regexes(spark):
    texts = ['password="hunter2222" token: abc secret=abcdef', "AKIA" + "Z9" * 10 + " x " + "0af" * 10, "é😀 api-key API_KEY : '" + "deadbeef" * 4, "PassWord=short", None, "-----BEGIN RSA PRIVATE KEY-----"]
    kinds = {"assign": (r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24)}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.report(secrets.scan_versions(rows)[0]).collect()}
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, kind, m.end()) for k, (kind, (p, g, least)) in enumerate(kinds.items()) for m in re.finditer(p, t or "") if len(m[g]) >= least)
        text = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t
    assert got[5]["spans"].startswith("pem:0:")
    assert secrets.redact_documents(rows).where("doc_id = 3").first()["text"] == "PassWord=short"
    assert "hunter" not in secrets.redact_documents(rows).where("doc_id = 0").first()["text"]


def test_the_ledger_scans_only_what_is_new(spark):
    a = spark.createDataFrame([("p1", "secret=abcdef"), ("p2", "secret=abcdef"), ("p3", "nothing")], "doc_id string, text string")
    rules = secrets.RULES[:2]
    found, ledger = secrets.scan_versions(a, rules=rules)
    assert ledger.count() == 4 and ledger.where("size(spans) > 0").count() == 1
    more = a.unionByName(spark.createDataFrame([("p4", "secret=ghijkl")], "doc_id string, text string"))
    again, new = secrets.scan_versions(more, ledger, rules=rules)
    assert new.count() == 2 and again.where(F.size("spans") > 0).count() == 3
    # a new version of one rule is scanned for in every blob, the other in none
    changed = (replace(rules[0], version="2", least=7), rules[1])
    third, newer = secrets.scan_versions(more, ledger.unionByName(new), rules=changed)
    assert {(r["rule"], r["rule_version"]) for r in newer.collect()} == {("assign", "2")} and newer.count() == 3
    assert third.where(F.size("spans") > 0).count() == 0
    # one more rule: only its pairs
    _, other = secrets.scan_versions(more, ledger.unionByName(new), rules=(*rules, secrets.RULES[2]))
    assert {r["rule"] for r in other.collect()} == {"hex"} and secrets.scan_versions(more, ledger.unionByName(new), rules=rules)[1].count() == 0


def test_mix_equals_sql_and_reruns_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), "w " * int(rng.integers(0, 60)), None if i % 11 == 0 else f"s{int(rng.integers(0, 6)) ** 2 % 7}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    want = con.execute(mixing.SQL).df().sort_values("doc_id").reset_index(drop=True)
    for c in want.columns:
        assert np.allclose(got[c].astype(float), want[c].astype(float)), c
    assert (got["taken"] <= 3 * got["size"]).all()
    by = got.assign(source=got["source"].fillna("-")).groupby("source").agg(t=("target", "first"), taken=("taken", "sum"), top=("size", "max"))
    assert ((by["t"] - by["taken"]).abs() <= by["top"]).all()
    assert mixing.mix(df.repartition(7)).toPandas().sort_values("doc_id")["taken"].tolist() == got["taken"].tolist()


@pytest.mark.parametrize("most", [512, 4])
def test_jaccard_components_by_brute_force(spark, most, monkeypatch):
    rng = np.random.default_rng(4)
    texts = []
    for g in range(12):
        base = [f"w{rng.integers(0, 400)}" for _ in range(60)]
        for _ in range(int(rng.integers(1, 12)) if g else 40):
            w = list(base)
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(0, 60))] = f"v{rng.integers(0, 999)}"
            texts.append(" ".join(w))
    texts += ["a b", "a b", "A B", "", "c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = jaccard.class_links
    monkeypatch.setattr(jaccard, "class_links", lambda *a, **k: whole(*a, most=most, **k))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_classes(df).collect()}
    sets = []
    for t in texts:
        w = t.lower().split()
        k = min(4, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    pairs, members = jaccard.similar_pairs(df)
    rep = {r["doc_id"]: r["class_id"] for r in members.collect()}
    assert rep == {i: min((j for j, t in enumerate(sets) if t == s), default=None) if s else None for i, s in enumerate(sets)}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and rep[i] == i and rep[j] == j and 100 * len(a & b) >= 85 * len(a | b)}
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == sorted(want)


def test_language_of_held_out_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(rows).join(rows.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95 and got["score"].between(0, 1).all()


def test_pipeline_by_plain_python(spark):
    """Every stage after the trees, over what the stage before kept, against loops and the library."""
    import corpus_pipeline as c
    import sentencepiece

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in c.STAGES[:-1]:
        docs = c.stash(stage(spark, docs, sf), name)
        assert docs.columns == columns, name
        rows[name] = docs.toPandas()
    judged = {r["doc_id"]: r for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert set(rows["quality_rules"]["doc_id"]) == {i for i, r in judged.items() if r["kept"]} and not any(r["kept"] and r["base_failed"] for r in judged.values())
    texts = dict(zip(rows["quality_rules"]["doc_id"], rows["quality_rules"]["text"]))
    sets = {}
    for i, t in texts.items():
        w = re.sub("[A-Z]+", lambda m: m[0].lower(), t or "").encode().split()
        k = min(5, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and x and y and 100 * len(x & y) >= 80 * len(x | y) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    kept = {i for i in sets if find(i) == i}
    assert set(rows["near_duplicates"]["doc_id"]) == kept and len(rows["near_duplicates"]) == len(kept) < len(texts)

    def masked(t):
        spans = sorted((m.start(), m.end()) for r in secrets.RULES for m in re.finditer(r.pattern.replace("(?i:", "(?ai:"), t) if len(m[r.group]) >= r.least)
        out, at = "", 0
        for x, y in spans:
            if x >= at:
                out += t[at:x] + "[SECRET]"
            at = max(at, y)
        return out + t[at:]

    clean = {i: masked(texts[i] or "") for i in kept}
    assert dict(zip(rows["secret_scans"]["doc_id"], rows["secret_scans"]["text"].fillna(""))) == clean
    taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mix(spark.createDataFrame(rows["secret_scans"], docs.schema)).collect()}
    times = rows["source_mix"].groupby("doc_id").size().to_dict()
    assert set(times) <= kept and all(0 <= n <= 3 and rows["source_mix"].shape[0] >= len(times) for n in times.values())
    assert all(abs(times.get(i, 0) * size - got) < size or size == 0 for i, (got, size) in taken.items())
    out = c.STAGES[-1][1](spark, docs, sf).toPandas()
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    assert len(out) == len(rows["source_mix"]) and out["round_trips"].all()
    assert all(list(r["ids"]) == sp.encode(clean[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) for _, r in out.iterrows())


def test_scores_equal_plain_counts_of_any_size(spark):
    texts = {1: "the " * 70_000 + "cat sat", 2: "the " * 100_000 + "dog ran", 3: "the the cat", 4: "a dog the the ran", 5: "", 6: "the cat sat on a mat"}
    good = {1, 6}
    words = {i: t.split() for i, t in texts.items()}
    grams = {i: (Counter(w), Counter(zip(w, w[1:]))) for i, w in words.items()}
    match = sum(len(words[i]) for i in good) / sum(map(len, words.values()))
    every = [sum((g[k] for g in grams.values()), Counter()) for k in (0, 1)]
    target = [sum((grams[i][k] for i in good), Counter()) for k in (0, 1)]

    def ratio(i, k, gram, add):
        own = grams[i][k][gram]
        return math.log((target[k][gram] - own * (i in good) + add) / ((every[k][gram] - own) * match + add))

    def plain(i):
        w = words[i]
        loss = [ratio(i, 0, x, 0.5) for x in w]
        both = [(b + ratio(i, 1, (x, y), 0.5) - ratio(i, 0, x, 50.0)) / 2 for x, y, b in zip(w, w[1:], loss[1:])]
        return sum(loss[:1] + both) / max(1, len(w))

    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in good)) for i in texts], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in lm_scores.score(docs, labels).collect()}
    assert all(got[i]["n_tokens"] == len(words[i]) and got[i]["score"] == pytest.approx(plain(i), abs=1e-9) for i in texts)


def test_templates_take_evidence_of_the_whole_host(spark):
    def page(i, side="", box=""):
        return f"<body><p class='x'>Read our site</p><div class='t'><h2>News {i}</h2><p>Story {i} has its own words</p></div>{side}{box}</body>"

    rare = "<div class='y'><p>A box on one page in thirty</p></div>"
    html = {i: ("http://big.org/a", page(i, box=rare if i % 30 == 0 else "")) for i in range(600)}
    html |= {1000 + i: ("http://small.org/a", page(i)) for i in range(5)}
    html |= {2000 + i: ("http://tiny.org/a", page(i)) for i in range(3)}
    html |= {3000 + i: ("http://one.org/a", f"<article><p>One article</p></article><p>side {i}</p>") for i in range(30)}
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame([(i, *x) for i, x in html.items()], "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"News {i} Story {i} has its own words" for i in range(600))
    assert all(got[1000 + i] == f"News {i} Story {i} has its own words" for i in range(5))
    assert all(got[2000 + i] == f"Read our site News {i} Story {i} has its own words" for i in range(3))
    assert all(got[3000 + i] == "One article" for i in range(30))
    for host in ("big", "small", "tiny", "one"):
        trees = {i: pages.parse(h) for i, (url, h) in html.items() if f"//{host}." in url}
        constant = pages.induce(list(trees.values()))
        assert all(pages.main_text(t, constant) == got[i] for i, t in trees.items()), host


def test_vectors_by_brute_force(spark):
    import numpy as np

    from screenfold.llm import vectors

    rng = np.random.default_rng(9)
    v = rng.normal(size=(900, 12))
    v[:250] = v[0] + rng.normal(0, 0.09, (250, 12))
    for i in range(300, 600, 3):
        v[i + 1 : i + 3] = v[i] + rng.normal(0, 0.12, (2, 12))
    v[600:640] = v[:40]
    v[640:700] = v[640]
    ids = (rng.permutation(len(v)) + 10).tolist()
    rows = [(i, x.tolist(), "same") for i, x in zip(ids, v)] + [(5, None, "same"), (6, [0.0] * 12, "same"), (7, [1.0] * 5, "same")]
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    low = np.array(ids)
    while True:
        least = np.where(near, low[None, :], 10**9).min(1)
        if (least == low).all():
            break
        low = least
    want = {i: (int(n), int(c), i == c) for i, n, c in zip(ids, near.sum(1) - 1, low)} | {i: (0, i, True) for i in (5, 6, 7)}
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id string").repartition(3), shards=3)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got.collect()} == want
