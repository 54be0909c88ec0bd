"""Whitening, packing and hard negatives against plain numpy, the tokenizer library and brute force."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from screenfold.llm import negatives, packing, queries, whitening

ODD = [(100, None), (101, [0.1, None, 0.3]), (102, [float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0]), (None, [0.2, 0.1, 0.0]), (3, [0.5, -0.5, 0.25]), (3, [0.5, -0.5, 0.25]), (104, [0.7]), (105, [])]


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 0.5) for i, v in rows], "vec_id long, embedding array<float>, component int, whitened string, n double")


def plain_whitening(x):
    n, s = len(x), x.sum(0)
    v = np.array([[float(sum((n * int(a) - int(s[i])) * (n * int(b) - int(s[j])) for a, b in zip(x[:, i], x[:, j]))) / n**3 for j in range(x.shape[1])] for i in range(x.shape[1])])
    return n, s, v


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=3) * [1, 3, 0.2]).astype(np.float32).tolist()) for i in range(150)] + ODD
    got = whitening.whiten(vectors_of(spark, rows)).collect()
    kept = [(i, [float(np.float32(c)) for c in v] + [0.0] * (3 - len(v))) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in kept])).astype(np.int64) + 1_000_000
    n, s, v = plain_whitening(x)
    values = np.linalg.eigvalsh(v)[::-1]
    assert len(got) == 3 * len(kept) and {r["n"] for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    for (i, _), row in zip(kept, x):
        deviation = sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s))
        assert deviation in {r["deviation"] for r in by[i]}
    for k in range(3):
        part = [r for r in got if r["component"] == k + 1]
        assert abs(part[0]["explained"] - values[k] / values.sum()) < 1e-12
        w = np.array([r["whitened"] for r in part])
        assert abs(w.mean()) < 1e-9 and abs((w**2).mean() - 1) < 1e-9
    assert max(r["identity_error"] for r in got) < 1e-9
    model = whitening.fit(vectors_of(spark, rows))
    assert model.sums == s.tolist() and np.abs(model.covariance - v).max() < 1e-9 * np.abs(v).max()


def test_whitening_of_hardly_anything(spark):
    assert whitening.whiten(vectors_of(spark, [(1, None)])).count() == 0
    assert whitening.whiten(vectors_of(spark, []).limit(0)).count() == 0
    one = whitening.whiten(vectors_of(spark, [(1, [0.5, 0.5])])).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    flat = whitening.whiten(vectors_of(spark, [(1, [0.5, 0.5]), (2, [0.1, 0.5])])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat)
    huge = whitening.whiten(vectors_of(spark, [(1, [3e38, 0.5]), (2, [-3e38, 0.5]), (3, [1.0, 0.5])])).collect()
    assert len(huge) == 6 and all(r["deviation"] is None or r["deviation"] >= 0 for r in huge)


@pytest.mark.parametrize("spread", [3, 1 << 20, 1 << 45])
def test_bit_planes_give_exact_cross_products(spread):
    rng = np.random.default_rng(spread)
    x = rng.integers(0, spread, (517, 5))
    x[:, 2] = 0
    bits = [max(1, int(m).bit_length()) for m in x.max(0)]
    limbs = np.zeros((2 * max(bits) // 32 + 3, 5, 5), np.int64)
    for part in (x[:64], x[64:]):
        whitening.add_scatter(limbs, part.view(np.uint64), bits)
    for i in range(5):
        for j in range(i, 5):
            assert sum(int(limbs[k, i, j]) << (32 * k) for k in range(len(limbs))) == sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j]))


TEXTS = ["", "a", "hello world", "  two  spaces\n\n and\tlines ", "x" * 5000, "word " * 3000, "don't  'stop", "\n", " ", "é 😀 中文字 　 wide", "a<|endoftext|> b  <|endoftext|>", "123 4567 ... !?", "a \x1cb \x85 c", "tail space ", "many different words " + " ".join(f"w{i}" for i in range(2500))]


def test_encoder_equals_the_library():
    rng = np.random.default_rng(5)
    library, own = Tokenizer.from_file(queries.BYTE_TOKENIZER), packing.Encoder(queries.BYTE_TOKENIZER)
    alphabet = list("ab'sL3. \n\t é😀\x1f") + [" ", " the", "'ll"]
    for text in TEXTS + ["".join(rng.choice(alphabet, rng.integers(1, 30))) for _ in range(1500)]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert own.ranks is not None and packing.Encoder(queries.WORD_TOKENIZER).ranks is None
    assert len(own.encode(" " * 1_000_000 + "x" * 1_000_000)) > 0


def check_packing(rows, docs, limit=1024):
    library = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    want = []
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % limit + 1
        cuts = [0, *range(first, len(ids) + 1, limit)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == sorted(want, key=str)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(sequences), -(-sum(w[3] for w in want) // limit)


def test_packing_is_whole_and_tight(spark):
    rng = np.random.default_rng(2)
    docs = [*enumerate(TEXTS), (None, "nothing"), (None, "nothing"), (7, "again"), (8, None)]
    docs += [(1000 + i, "alpha " * int(n)) for i, n in enumerate(rng.integers(1, 1500, 400))]
    df = spark.createDataFrame([(i, t, "x", 3, "y") for i, t in docs], "doc_id long, text string, piece string, length int, at string")
    how = packing.Breeding(items=60, children=6)
    used, least = check_packing(packing.pack(df, queries.BYTE_TOKENIZER, how=how).collect(), docs)
    assert used <= least * 1.01 + 1
    assert packing.pack(df.limit(0), queries.BYTE_TOKENIZER).count() == 0
    used, least = check_packing(packing.pack(df.limit(1), queries.BYTE_TOKENIZER).collect(), docs[:1])
    assert used == least == 1


def test_breeding_mends_best_fit():
    """Triplets that fill a bin exactly: best fit by falling size needs more bins than there must be."""
    rng = np.random.default_rng(4)
    sizes = []
    for _ in range(60):
        a, b = rng.integers(380, 490), rng.integers(255, 300)
        sizes += [a, b, 1024 - a - b]
    sizes = np.array(sizes)
    first = packing.first_packings(sizes, 1024, 8, rng, None)
    begun = max(packing.fitness(sizes, p, 1024) for p in first)
    held = first
    for turn in range(20):
        held = packing.breed(sizes, held, 1024, packing.Breeding(children=40), np.random.default_rng(turn))
    after = packing.fitness(sizes, held[0], 1024)
    assert after > begun and packing.fills(sizes, held[0]).max() <= 1024 and packing.fills(sizes, held[0]).sum() == sizes.sum()


def plain_negatives(rows):
    """rows: (id, label, vector); every row an own one."""
    rows = [(i, l, np.floor(256 * np.array(v, float))) for i, l, v in rows if i is not None and l is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    rows = [(i, (l + 1) % 10 if i % 7 == 0 else l, v) for i, l, v in rows]
    out = []
    for k, (a, label, x) in enumerate(rows):
        if a % 50:
            continue
        scored = sorted((-int((x[: len(v)] * v[: len(x)]).sum()), i, l) for j, (i, l, v) in enumerate(rows) if j != k)
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            fit = [(r[1], -r[0]) for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(a, p, rank, n, -s, score) for rank, (n, score) in enumerate(fit, 1)]
    return sorted(out)


def test_negatives_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), (rng.normal(size=4) * 0.1).astype(np.float32).tolist()) for i in range(400)]
    rows += [(400 + i, i % 2, [0.01, 0.0, 0.0, 0.0]) for i in range(60)] + [(500 + i, i % 3, [0.0] * 4) for i in range(101)]
    rows += [(50, 1, [0.1, 0.1, 0.1, 0.1]), (50, 2, [0.1, 0.1, 0.1, 0.1]), (None, 1, [0.1] * 4), (700, None, [0.1] * 4), (750, 1, None), (800, 1, [None, 0.1]), (850, 1, [float("nan")]), (900, 1, [0.2, 0.3]), (950, 2, []), (-50, 0, [0.3] * 4)]
    df = spark.createDataFrame([(i, l, v, "x", 1, 2) for i, l, v in rows], "vec_id long, label int, embedding array<float>, part string, at int, score int")
    monkeypatch.setattr(negatives, "ROWS", 90)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    label = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
    got = sorted(tuple(r) for r in negatives.mine(df, "vec_id % 50 = 0", label).collect())
    assert got == plain_negatives(rows) and len(got) > 50
    assert negatives.mine(df.limit(0), "vec_id % 50 = 0").count() == 0
    assert negatives.mine(df.where("vec_id = 3"), "vec_id % 50 = 0").count() == 0


def test_negatives_of_huge_components(spark):
    df = spark.createDataFrame([(0, 1, [1e30, 0.0]), (1, 1, [1e30, 1.0]), (2, 2, [-1e30, 1e10]), (3, 2, [1e5, 3e9])], "vec_id long, label int, embedding array<double>")
    assert negatives.mine(df).count() >= 0


def test_keys_sort_as_their_parts_and_stream_reads_them():
    rng = np.random.default_rng(6)
    anchor, score, ids = (rng.integers(-5, 5, 300) * m for m in (1, 1 << 58, 3))
    raw = negatives.keys(anchor, score, ids)
    assert [negatives.unpack_key(k) for k in sorted(raw)] == [(a, -s, i) for a, s, i in sorted(zip(anchor.tolist(), (-score).tolist(), ids.tolist()))]
