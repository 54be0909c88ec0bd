"""Kernels of the text operators against the libraries and plain loops, without Spark."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from screenfold.llm import common, language, lm_scores, pages, quality, trees
from screenfold.llm.common import WordHashes
from screenfold.llm.pieces import PieceCodec
from screenfold.llm.token_counts import TokenCounter
from screenfold.llm.vectors import Graph, Shard, links_between, links_in

ODD = list(" \n\t\r▁aeiouthnTHE’'s.,!éçñß漢字ﬁ́\u0000\x1c\xa0 😀<>|½²٣ΣİǅΣ") + ["<|endoftext|>", "<0x0A>", "the", "ing", "  "]


def fuzz(n, seed, longest=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, longest))) for _ in range(n)] + ["", "a" * 3000, " " * 500, "the " * 3000]


def test_pieces_equal_the_library():
    path = P.path("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), PieceCodec(path, most=50)
    for t in fuzz(3000, 1):
        ids = sp.encode(t)
        assert own.encode(t) == ids
        joined, n, back = own.encoded(t)
        assert (n, back, own.decode(ids)) == (len(ids), sp.decode(ids), sp.decode(ids))
        assert joined == ",".join(map(str, ids))


@pytest.mark.parametrize("chunk", [5, 1 << 16])
def test_token_counts_equal_the_library(chunk):
    path = P.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), TokenCounter(path, chunk_chars=chunk, most=50)
    for t in fuzz(3000, 2):
        assert own.count(t) == len(lib.encode(t, add_special_tokens=False).ids), t


def test_chunk_maps_compose_associatively():
    c = TokenCounter(P.path("word_bpe_49k.json"))
    maps = [c.chunk_map(x) for x in ("ab", "c d", "ef", " g", "h i j", "k")]
    a = c.compose(c.compose(maps[0], maps[1]), maps[2])
    assert a == c.compose(maps[0], c.compose(maps[1], maps[2]))
    assert c.scan(maps)[-1] == c.compose(c.compose(a, maps[3]), c.compose(maps[4], maps[5]))
    got = c.scan(maps)
    for k in range(1, len(maps) + 1):
        want = maps[0]
        for m in maps[1:k]:
            want = c.compose(want, m)
        assert got[k - 1] == want


@pytest.mark.parametrize("chunk", [1, 2, 3, 7])
def test_state_maps_of_small_chunks_equal_the_library(chunk):
    path = P.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), TokenCounter(path, chunk_chars=chunk, most=80)
    hard = ["'s", "''s", "a's", "don't've", "'tis", "we'll're'rx'lx'v", "!'s", "'!s", "1'2", "'r", "'re", "'l l", "x'", "'", "é's'é", "a1'm2", "'S 'RE"]
    for t in [*hard, *fuzz(700, 5)[:700], "the " * 50 + "internationalization's " * 5]:
        assert own.count(t) == len(lib.encode(t, add_special_tokens=False).ids), t


def test_trees_are_monotone_where_told():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + rng.normal(0, 0.1, 2000) < 0.6).astype(float)
    model = trees.fit(x, y, [-1, 0, 0])
    assert ((model.predict(x) > 0.5) == y).mean() > 0.9
    grid = np.repeat(rng.random((50, 3))[:, None], 40, 1)
    grid[:, :, 0] = np.linspace(0, 1, 40)
    p = model.predict(grid.reshape(-1, 3)).reshape(50, 40)
    assert (np.diff(p, axis=1) <= 1e-12).all()


def test_quality_statistics_by_plain_loops():
    for t in [*fuzz(200, 3, 200), "a b c a b c\nx\n\nx\n y", None]:
        text = t or ""
        words = text.encode().split()
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 400 else None
        lines = [x for x in text.split("\n") if x.encode().split()]
        got, _ = quality.statistics(t, WordHashes())
        assert got[:4] == (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)))
        if hit is not None:
            assert got[4] == len(hit)


def test_language_model_learns_and_rejects():
    texts = [f"the cat {i} sat on the mat with the others" for i in range(60)] + [f"der hund {i} liegt auf dem sofa und schläft" for i in range(60)]
    m = language.train(texts, ["en"] * 60 + ["de"] * 60)
    assert m.langs[m.probabilities("the dog sat with the others").argmax()] == "en"
    assert m.langs[m.probabilities("der mann liegt auf dem boden").argmax()] == "de"
    assert 0 <= m.floor <= 1 and m.heat > 0


def test_scores_leave_own_counts_out():
    held = lm_scores.text_grams(pa.table({"text": ["a b a", "", None, "c", "a b"]}))
    assert held.words_at.tolist() == [0, 3, 3, 3, 4, 6] and held.pairs_at.tolist() == [0, 2, 2, 2, 2, 3]
    assert held.pairs[0] == held.pairs[2] != held.pairs[1] and held.words[0] == held.words[2]
    one = lm_scores.text_grams(pa.table({"text": ["a b a"]}))
    grams, at, times = np.unique(one.flat, return_inverse=True, return_counts=True)
    assert lm_scores.text_scores(one, grams, at, times, times, np.array([True]), 1.0, lm_scores.Smoothing()).tolist() == [0]


def test_hashes_of_whole_columns_by_plain_loops():
    texts = [*fuzz(600, 11), None, "", " ", "a" * 5000 + " b " + "A" * 5000, "y" * 1_500_000 + " z " + "w " * 700_000, "Q"]
    for column in (pa.array(texts), pa.array(texts).slice(7, 200), pa.array([], pa.string()), pa.array([None, ""])):
        h, at = common.word_hashes(column)
        grams, begins = common.windows(h, at, 4)
        sets, cuts = common.distinct_each(grams.copy(), begins)
        hash_of, word_of = {}, {}
        for i, t in enumerate(column.to_pylist()):
            own, words = h[at[i] : at[i + 1]], t.encode().lower().split() if t else []
            assert len(own) == len(words) and all(hash_of.setdefault(w, x) == x and word_of.setdefault(x, w) == w for w, x in zip(words, own.tolist()))
            assert (grams[begins[i] : begins[i + 1]] == common.ngram_hashes(own, 4)).all()
            assert (sets[cuts[i] : cuts[i + 1]] == np.unique(common.ngram_hashes(own, 4))).all()
        plain, _ = common.word_hashes(column, lower=False)
        assert len(set(plain.tolist())) == len({w for t in column.to_pylist() if t for w in t.encode().split()})


def test_packed_numbers_come_back():
    v = np.unique(np.random.default_rng(0).integers(0, 1 << 32, 5000).astype(np.uint64))
    assert (common.unpack_sorted(common.pack_sorted(v, 4), 4) == v).all() and len(common.unpack_sorted(b"", 4)) == 0


def test_packed_counts_are_whole():
    for counts in ([], [0], [7, 254, 255, 256, 65534, 65535, 65536, 125_478, 2**32 + 3, 2**50 + 1, 0]):
        assert common.unpack_counts(common.pack_counts(np.array(counts, float)), len(counts)).tolist() == counts


def test_page_text():
    page = """<html><head><title>T</title><script>var a="</p>"</script></head><body><header>Top</header><nav><a>Menu</a></nav>
    <article><h1>Head &amp; line</h1><p>One <b>two</b>three<br>four<p>five<div class="share">Share</div><aside>no</aside></article>
    <div id="comments"><p>first!</p></div><form><input><label>Mail</label></form><footer>(c)</footer></body>"""
    assert pages.main_text(pages.parse(page)) == "Head & line One twothree four five"
    assert pages.main_text(pages.parse(None)) == ""
    assert pages.main_text(pages.parse("1 < 2 <b>x")) == "1 < 2 x"


def test_wrapper_drops_what_never_varies():
    make = lambda i: f"<body><div class='w'><p>Welcome to our site</p></div><div class='t'><h2>News {i}</h2><p>Story {i} is told here at some length</p></div><p>All rights</p></body>"
    trees_ = [pages.parse(make(i)) for i in range(12)]
    constant = pages.induce(trees_)
    assert pages.main_text(trees_[3], constant) == "News 3 Story 3 is told here at some length"
    assert not pages.induce(trees_[:3]).constants and not pages.induce([trees_[0]] * 50).constants


def test_graph_finds_all_links():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(1500, 16))
    v[:300] = v[0] + rng.normal(0, 0.05, (300, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    g = Graph.load(Graph(v).dump(), v)
    q, s, whole = links_in(g, v, v, 0.9, 1.0, 64, np.arange(1500))
    truth = v @ v.T >= 0.9
    # rows of the large group are left to the matrix; of the others no link may miss
    assert set(whole) <= set(range(300)) and len(whole)
    part = np.setdiff1d(np.arange(1500), whole)
    assert set(zip(q, s)) == {(i, j) for i in part for j in np.flatnonzero(truth[i])}


def test_links_of_shards_by_brute_force():
    rng = np.random.default_rng(8)
    v = rng.normal(size=(1200, 16))
    v[:500] = v[0] + rng.normal(0, 0.06, (500, 16))  # a large group, partly beyond the threshold of its middle
    for i in range(600, 900, 3):
        v[i + 1 : i + 3] = v[i] + rng.normal(0, 0.1, (2, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    copies = rng.integers(1, 4, len(v))
    order = rng.permutation(len(v))

    def shard(at):
        at = np.sort(at)
        return Shard(at, copies[at], v[at], Graph(v[at]))

    one, two = shard(order[:700]), shard(order[700:])
    for a, b in ((one, one), (one, two)):
        near = np.zeros((len(v), len(v)), bool)
        near[np.ix_(a.ids, b.ids)] = v[a.ids] @ v[b.ids].T >= 0.9
        near |= near.T
        np.fill_diagonal(near, False)
        low = np.arange(len(v))
        while True:
            least = np.minimum(low, np.where(near, low[None, :], len(v)).min(1))
            if (least == low).all():
                break
            low = least
        linked = np.flatnonzero(near.any(1))
        nodes, others, parts = links_between(a, b, 0.9, 1.0, 64)
        assert nodes.tolist() == linked.tolist()
        assert others.tolist() == (near @ copies)[linked].tolist()
        assert parts.tolist() == low[linked].tolist()


def test_named_noise_inside_an_article():
    page = '<article><div class="article-header"><h1>T</h1></div><p>a</p><div class="comments-content"><p>no</p></div><div class="entry-content"><ul><li>b<li>c</ul></div></article>'
    assert pages.main_text(pages.parse(page)) == "T a b c"


def test_unnamed_content_keeps_every_varying_slot():
    page = "<h1>Head</h1><div class='t'><p>short one</p><ul><li>a list that is longer than all<li>of the prose beside it</ul></div><section class='b'><p>second part</p></section><div>bare text</div>"
    assert pages.main_text(pages.parse(page)) == "Head short one a list that is longer than all of the prose beside it second part bare text"


def test_audit_sees_near_misses_of_queries_without_links():
    rng = np.random.default_rng(7)
    v = rng.normal(size=(2000, 24))
    v[4] = v[3] + 0.25 * v[4]  # what a narrow beam finds instead of v[3]
    v /= np.linalg.norm(v, axis=1)[:, None]
    q = v[:1000] + 0.7 * v[1000:]  # no link, but near a vector
    q /= np.linalg.norm(q, axis=1)[:, None]
    q[500] = v[3]

    class Narrow:
        """Small beams miss the only link there is."""

        vectors = v

        def query(self, queries, beam):
            sim = queries @ v.T
            if beam < 512:
                sim[sim > 0.99] = -1
            ids = np.argsort(-sim, axis=1)[:, :beam]
            return ids, np.take_along_axis(sim, ids, 1)

    keys = np.arange(1000)
    assert [x.tolist() for x in links_in(Narrow(), v, q, 0.99, 1.0, 64, keys)] == [[500], [3], []]
