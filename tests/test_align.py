"""Similar sequences: seeds, alignments against the whole table of a pair, planted families."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenfold.operators import align

AMINO = list("ACDEFGHIKLMNPQRSTVWY")


def whole(a, b):
    """(score, matches) of the best alignment with free ends, by the whole table."""
    best, row = (0, 0), [(0, 0)] * (len(b) + 1)
    for i in range(1, len(a) + 1):
        new = [(0, 0)]
        for j in range(1, len(b) + 1):
            same = a[i - 1] == b[j - 1]
            cell = max((row[j - 1][0] + (align.MATCH if same else align.MISMATCH), row[j - 1][1] + same), (row[j][0] + align.GAP, row[j][1]), (new[j - 1][0] + align.GAP, new[j - 1][1]))
            new.append(cell)
            if i == len(a) or j == len(b):
                best = max(best, cell)
        row = new
    return best


def mutate(rng, s, rate=0.1, gaps=2):
    s = [str(rng.choice(AMINO)) if rng.random() < rate else c for c in s]
    for _ in range(gaps):
        at = int(rng.integers(0, len(s)))
        s[at:at] = rng.choice(AMINO, int(rng.integers(0, 3))).tolist()
        at = int(rng.integers(0, len(s) - 3))
        del s[at : at + int(rng.integers(0, 3))]
    return "".join(s)


def test_banded_alignment_equals_the_whole_table():
    rng = np.random.default_rng(1)
    a, b = [], []
    for _ in range(40):
        s = "".join(rng.choice(AMINO, int(rng.integers(20, 60))))
        a.append(s)
        b.append(mutate(rng, s))
    a += ["A", "ACDEF", "WWWW"]
    b += ["A", "DEF", "ACD"]
    got = align.banded([s.encode() for s in a], [s.encode() for s in b], np.zeros(len(a), int), 64)
    assert got.tolist() == [whole(x, y)[1] if whole(x, y)[0] > 0 else 0 for x, y in zip(a, b)]


def test_planted_families_are_found(spark):
    rng = np.random.default_rng(2)
    rows, family = [], {}
    for f in range(25):
        base = "".join(rng.choice(AMINO, int(rng.integers(80, 160))))
        for m in range(4):
            i = 10 * f + m
            rows.append((i, base if m == 0 else base[10:] if m == 3 else mutate(rng, base)))
            family[i] = f
    rows += [(1000, rows[0][1]), (1001, rows[0][1].lower()), (2000, ""), (2001, None), (2002, "ACD"), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "id long, sequence string")
    edges, frequent = align.similar_sequences(df, 0.5)
    got = {(r["g1"], r["g2"]): r["identity"] for r in edges.collect()}
    assert frequent.count() == 0 and got[0, 1000] == got[0, 1001] == 1.0
    inside = {(a, b) for a in family for b in family if a < b and family[a] == family[b]}
    assert inside <= set(got) and all(family[a] == family[b] for a, b in set(got) if b < 1000)
    text = {i: s for i, s in rows if i is not None}
    for a, b in list(inside)[:30]:
        assert got[a, b] == pytest.approx(whole(text[a], text[b])[1] / min(len(text[a]), len(text[b])))
    none, _ = align.similar_sequences(df.limit(0))
    assert none.count() == 0


def test_frequent_seeds_meet_their_longest_and_are_told(spark):
    rng = np.random.default_rng(3)
    core = "".join(rng.choice(AMINO, 40))
    df = spark.createDataFrame([(i, core + "".join(rng.choice(AMINO, 5 + i % 7))) for i in range(60)], "id long, sequence string")
    edges, frequent = align.similar_sequences(df, 0.5, align.Seeding(most=10))
    hub = max(range(60), key=lambda i: (i % 7, -i))
    linked = {r["g2"] if r["g1"] == hub else r["g1"] for r in edges.where((F.col("g1") == hub) | (F.col("g2") == hub)).collect()}
    assert frequent.count() > 0 and linked | {hub} == set(range(60))


def test_a_band_takes_the_rows_that_it_meets():
    rng = np.random.default_rng(4)
    long = ["".join(rng.choice(AMINO, 20_000)) for _ in range(8)]
    ends = [s[-30:] + t for s, t in zip(long, long[::-1])]
    la, lb, shift = np.full(8, 20_000), np.full(8, 20_030), np.full(8, -19_970)
    assert align.rows_of(la, lb, shift, 24).tolist() == [54] * 8
    assert align.banded([s.encode() for s in long], [s.encode() for s in ends], shift, 24).tolist() == [30] * 8
    a, b = ["".join(rng.choice(AMINO[:3], int(n))) for n in rng.integers(5, 40, 60)], ["".join(rng.choice(AMINO[:3], int(n))) for n in rng.integers(5, 40, 60)]
    for shift in (-12, 0, 9):  # a band over all cells: the whole table, whichever is longer
        got = align.banded([s.encode() for s in a], [s.encode() for s in b], np.full(60, shift), 64)
        assert got.tolist() == [whole(x, y)[1] for x, y in zip(a, b)]


def test_frequent_seeds_alone_align_nothing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    core = "".join(rng.choice(AMINO, 30))
    rows = [(i, core + "".join(rng.choice(AMINO, 6))) for i in range(30)]
    df = spark.createDataFrame([*rows, (100, rows[0][1]), (101, rows[0][1].lower()), (102, None), (103, "")], "id long, sequence string")
    want = sorted(map(tuple, align.similar_sequences(df, 0.5, align.Seeding(most=10))[1].collect()))
    monkeypatch.setattr(align, "stash", None)
    monkeypatch.setattr(align, "similar_sequences", None)
    assert sorted(map(tuple, align.frequent_seeds(df, align.Seeding(most=10)).collect())) == want != []
    from screenfold.plans import graph_queries

    graph_queries.g01f(spark, "/root/testdata/sf0.001").collect()
