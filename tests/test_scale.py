"""Ordered scans, splitting readers, clustering by rounds, wide designs and packed splits against plain versions."""

import gzip
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenfold.operators import linkage, scan, sparse, splits
from screenfold.sources import fastq, files


def test_running_values_equal_one_pass(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), f"g{int(g)}" if g else None, int(x), int(x) if rng.random() < 0.3 else None) for i, (g, x) in enumerate(zip(rng.choice(4, 400, p=[0.1, 0.6, 0.2, 0.1]), rng.integers(0, 30, 400)))]
    df = spark.createDataFrame(rows, "id long, g string, x int, m int")
    got = scan.running(df, [F.col("x"), F.col("id")], {"n": ("count", F.lit(1)), "s": ("sum", F.col("x")), "low": ("min", -F.col("x")), "top": ("max", F.col("m")), "seen": ("last", F.col("m"))}, ["g"]).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    for g in {r[1] for r in rows}:
        n = s = 0
        low, top, seen = None, None, None
        for i, _, x, m in sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0])):
            n, s, low = n + 1, s + x, -x if low is None else min(low, -x)
            seen, top = (m, m if top is None else max(top, m)) if m is not None else (seen, top)
            assert tuple(by[i])[4:] == (n, s, low, top, seen)
    assert scan.numbered(df.limit(0), [F.col("x")], "k").count() == 0


def test_mean_ranks_and_step_up_with_a_frequent_value(spark):
    values = [0.5] * 200 + [0.001, 0.01, 0.02, None, 1.0, 0.5]
    df = spark.createDataFrame([(i, "f", v) for i, v in enumerate(values)], "id long, f string, p double")
    known = [v for v in values if v is not None]
    ranks = {r["id"]: r["r"] for r in scan.mean_ranks(df, ["f"], "p", "r").collect()}
    rates = {r["id"]: r["q"] for r in scan.step_up(df, ["f"], "p", "q").collect()}
    for i, v in enumerate(values):
        if v is None:
            assert ranks[i] is None and rates[i] is None
            continue
        below, ties = sum(k < v for k in known), known.count(v)
        assert ranks[i] == below + (ties + 1) / 2
        assert rates[i] == pytest.approx(min(min(1, w * len(known) / sum(k <= w for k in known)) for w in known if w >= v))


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(13)
    rows = [("a" if i % 3 else None, float(v)) for i, v in enumerate(rng.integers(0, 20, 200))] + [("a", None), ("one", 4.5), ("none", None)] + [("a", 7.0)] * 100
    df = spark.createDataFrame(rows, "g string, v double")
    at = [0.0, 0.1, 0.25, 0.5, 0.98, 1.0]
    got = {r["g"]: r["q"] for r in scan.exact_quantiles(df, ["g"], "v", at).collect()}
    assert set(got) == {"a", None, "one"}
    for g, q in got.items():
        assert np.allclose(q, np.quantile([v for k, v in rows if k == g and v is not None], at))
    assert np.allclose(scan.exact_quantiles(df, [], "v", at).first()["q"], np.quantile([v for _, v in rows if v is not None], at))


def block_gzip(text: bytes, size: int) -> bytes:
    out = b""
    for at in [*range(0, len(text), size), None]:
        part = b"" if at is None else text[at : at + size]
        packed = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packed.compress(part) + packed.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def test_reads_of_a_split_file_are_those_of_a_whole_one(spark, tmp_path):
    rng = np.random.default_rng(2)
    reads = []
    for i in range(700):
        n = int(rng.integers(1, 60))
        seq = "".join(rng.choice(list("ACGT"), n))
        reads.append((f"@r{i}", seq, "+" if i % 3 else f"+r{i}", "".join(rng.choice(list("@+!I5"), n))))
    text = "".join("\n".join(r) + "\n" for r in reads).encode()
    (tmp_path / "a.fastq").write_bytes(text)
    (tmp_path / "b.fastq.gz").write_bytes(gzip.compress(text))
    (tmp_path / "c.fastq.gz").write_bytes(block_gzip(text, 701))
    (tmp_path / "d.fq").write_bytes(text[:-1].replace(b"\n", b"\r\n"))
    for size in (997, 4000, 1 << 20):
        got = fastq.read_fastq(spark, str(tmp_path), size).collect()
        for lane in "abcd":
            mine = sorted((r["read_no"], r["header"], r["seq"], r["plus"], r["qual"]) for r in got if r["lane"] == lane)
            assert mine == [(i, *r) for i, r in enumerate(reads)], (size, lane)
    with gzip.open(tmp_path / "c.fastq.gz") as f:
        assert f.read() == text


def test_lines_and_records_of_a_split_file(spark, tmp_path):
    lines = []
    for i in range(3000):
        lines += [f">sp|P{i}|NAME{i} about", "MK" * (i % 7), "LV*" if i % 2 else ""]
    (tmp_path / "x.fa").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            read = files.lines_of(spark, str(tmp_path / "x.fa"))
            got = sorted((r["line_no"], r["value"]) for r in read.collect())
            assert got == list(enumerate(lines))
            records = {r["record"]: (r["name"], r["sequence"]) for r in files.fasta_records(read).collect()}
            assert len(records) == 3000
            assert all(records[i + 1] == (f"sp|P{i}|NAME{i}", "MK" * (i % 7) + ("LV" if i % 2 else "")) for i in range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def plain_linkage(x, metric):
    x = np.nan_to_num(x)
    x = x - x.mean(1, keepdims=True) if metric == "correlation" else x
    norm = np.sqrt((x * x).sum(1))
    u = x / np.where(norm > 0, norm, 1)[:, None]
    d = 1 - u @ u.T
    groups = {i: [i] for i in range(len(x))}
    out = []
    while len(groups) > 1:
        height, a, b = min((np.mean([d[i, j] for i in groups[a] for j in groups[b]]), a, b) for a in groups for b in groups if a < b)
        out.append((height, frozenset(groups[a]), frozenset(groups[b])))
        groups[len(x) + len(out) - 1] = groups.pop(a) + groups.pop(b)
    return out


def as_sets(merges, n):
    members = {i: frozenset([i]) for i in range(n)}
    out = []
    for r in sorted(merges, key=lambda r: r["step"]):
        a, b = members[r["left"]], members[r["right"]]
        members[n + r["step"]] = a | b
        assert r["size"] == len(a | b)
        out.append((r["height"], {a, b}))
    return out


@pytest.mark.parametrize("metric", ["correlation", "cosine"])
def test_clustering_by_rounds_equals_one_task(spark, monkeypatch, metric):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6))
    df = spark.createDataFrame([(f"g{i:03}", [None if i == 7 and k == 2 else float(v) for k, v in enumerate(r)]) for i, r in enumerate(x)], "gene string, v array<double>")
    x[7, 2] = 0
    want = plain_linkage(x, metric)
    monkeypatch.setattr(linkage, "BLOCK", 9)
    for most in (2000, 6, 1):
        got = as_sets(linkage.average_linkage(df, "gene", "v", metric, one_task=most).collect(), 40)
        assert len(got) == 39
        for (h, pair), (height, a, b) in zip(got, want):
            assert h == pytest.approx(height, abs=1e-9) and pair == {a, b}


def test_leaves_by_rounds_equal_one_task(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)], "gene long, v array<double>")
    merges = spark.createDataFrame(linkage.average_linkage(df, "gene", "v").toPandas())
    one = sorted(map(tuple, linkage.leaf_order(merges).collect()))
    assert one == sorted(map(tuple, linkage.leaf_order(merges, one_task=1).collect()))
    assert [p for p, _ in one] == list(range(60)) and sorted(x for _, x in one) == list(range(60))


def test_clustering_of_thousands_of_genes(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(30, 12))
    x = centres[rng.integers(0, 30, 5000)] + rng.normal(size=(5000, 12)) * 0.05
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "gene long, v array<double>")
    got = linkage.average_linkage(df, "gene", "v", "cosine").toPandas().sort_values("step")
    assert len(got) == 4999 and got["size"].max() == 5000 and (np.diff(got["height"]) >= -1e-9).all()
    assert (got["height"].to_numpy()[:-29] < 0.2).all() and set(got["left"]) | set(got["right"]) == set(range(9998))


def dense_ridge(x, y, alpha):
    m, my = x.mean(0), y.mean()
    w = np.linalg.solve((x - m).T @ (x - m) + alpha * np.eye(x.shape[1]), (x - m).T @ (y - my))
    return w, my - m @ w


@pytest.mark.parametrize("wide", [4096, 10])
def test_sparse_ridge_equals_a_dense_solve(spark, monkeypatch, wide):
    rng = np.random.default_rng(8)
    genes, k = 120, 40
    dense = (rng.random((genes, k)) < 0.15) * rng.integers(1, 3, (genes, k))
    dense[:, 5] = dense[:, 4]
    dense[3] = 0
    monkeypatch.setattr(sparse, "BLOCK", 16)
    entries = spark.createDataFrame([(g, f"f{f:03}", float(dense[g, f])) for g in range(genes) for f in range(k) if dense[g, f]] + [(1, "f001", None), (0, "f000", 0.0)], "gene long, feature string, v double")
    rows, want = [], {}
    for s in "AB":
        keep = rng.permutation(genes)[:90]
        y = rng.normal(size=90) + dense[keep, 0]
        rows += [(s, int(g), float(v)) for g, v in zip(keep, y)]
        want[s] = (dense[keep].astype(float), y)
    train = spark.createDataFrame([*rows, ("A", 2, None)], "strain string, gene long, y double")
    got = sparse.sparse_ridge(train, entries, "strain", "gene", "y", "v", [0.5, 10.0, 1000.0], wide=wide).collect()
    assert len(got) == 2 * 3 * (k + 1)
    for s, (x, y) in want.items():
        for alpha in (0.5, 10.0, 1000.0):
            w, cut = dense_ridge(x, y, alpha)
            mine = {r["feature"]: r["weight"] for r in got if r["strain"] == s and r["alpha"] == alpha}
            assert mine[None] == pytest.approx(cut, abs=1e-6)
            assert np.allclose([mine[f"f{f:03}"] for f in range(k)], w, atol=1e-6)
    models = spark.createDataFrame(got, "strain string, alpha double, feature string, weight double")
    p = {(r["gene"], r["alpha"]): r["p"] for r in sparse.sparse_predictions(train.where("strain = 'A' and y is not null"), models, entries, "strain", "gene", "v").collect()}
    w, cut = dense_ridge(*want["A"], 10.0)
    assert all(p[g, 10.0] == pytest.approx(dense[g] @ w + cut, abs=1e-6) for g in {g for g, _ in p})


def test_two_thousand_columns(spark):
    rng = np.random.default_rng(9)
    genes, k = 600, 2000
    at = [sorted(rng.choice(k, 12, replace=False).tolist()) for _ in range(genes)]
    x = np.zeros((genes, k))
    for g, f in enumerate(at):
        x[g, f] = 1
    y = rng.normal(size=genes)
    entries = spark.createDataFrame([(g, f"f{c:04}", 1) for g, f in enumerate(at) for c in f] + [(9999, f"f{c:04}", 1) for c in range(k)], "gene long, feature string, v int")
    train = spark.createDataFrame([("A", g, float(v)) for g, v in enumerate(y)], "strain string, gene long, y double")
    got = {r["feature"]: r["weight"] for r in sparse.sparse_ridge(train, entries, "strain", "gene", "y", "v", [31.6]).collect()}
    w, cut = dense_ridge(x, y, 31.6)
    assert len(got) == k + 1 and got[None] == pytest.approx(cut, abs=1e-8) and np.allclose([got[f"f{c:04}"] for c in range(k)], w, atol=1e-8)


def test_rank_and_planted_dependence(spark):
    rng = np.random.default_rng(10)
    genes, k = 900, 300
    x = (rng.random((genes, k)) < 0.1).astype(float)
    x[:, 20], x[:, 150] = x[:, 3], 0
    x[:, 299] = x[:, 10] + x[:, 11]
    rows = [(g, f"f{c:03}", float(x[g, c])) for g, c in zip(*np.nonzero(x))] + [(0, "f150", 0.0)]
    df = spark.createDataFrame([(int(g), f, v) for g, f, v in rows], "gene long, feature string, v double")
    width, rank, dependent = sparse.design_rank(df, "gene", "v", fan=2)
    assert (width, rank) == (k, np.linalg.matrix_rank(x)) and sorted(r["feature"] for r in dependent.collect()) == ["f020", "f150", "f299"]
    assert sparse.design_rank(df.limit(0), "gene", "v")[:2] == (0, 0)
    thin = sparse.design_rank(df.where("gene < 5"), "gene", "v")
    assert thin[1] == np.linalg.matrix_rank(x[:5])


def test_whole_components_are_packed(spark):
    rng = np.random.default_rng(11)
    genes = list(range(1000))
    edges = [(i, i + 1, 0.9) for i in range(0, 150)] + [(int(a), int(a) + 1, 0.5) for a in rng.choice(range(200, 990), 300, replace=False)] + [(995, 999, 0.1)]
    split = splits.packed_split(spark.createDataFrame([(g,) for g in genes], "gene long"), spark.createDataFrame(edges, "g1 long, g2 long, identity double"), [("train", 0.7), ("val", 0.15), ("test", 0.15)], 0.4)
    got = {r["gene"]: (r["split"], r["component"]) for r in split.collect()}
    assert sorted(got) == genes
    assert all(got[a][0] == got[b][0] for a, b, i in edges if i >= 0.4)
    held = [sum(s == n for s, _ in got.values()) for n in ("train", "val", "test")]
    assert all(abs(h - w) <= 151 for h, w in zip(held, (700, 150, 150))) and abs(held[0] - 700) <= 2


def test_shares_of_sizes_equal_one_by_one():
    rng = np.random.default_rng(12)
    for _ in range(60):
        sizes = [(int(s), int(rng.integers(1, 40))) for s in rng.choice(30, 6, replace=False) + 1]
        fractions = [("a", 0.7), ("b", 0.2), ("c", 0.1)]
        missing = [f * sum(s * n for s, n in sizes) for f in (7, 2, 1)]
        want = []
        for s, n in sorted(sizes, reverse=True):
            took = [0, 0, 0]
            for _ in range(n):
                k = max(range(3), key=lambda k: (missing[k], -k))
                took[k] += 1
                missing[k] -= 10 * s
            want.append((s, took))
        got = splits._shares_of(sizes, fractions)
        assert got == want


def test_moving_mean_is_the_same_over_any_stretch(spark, monkeypatch):
    """Stretches of 8 places and half widths up to more than a stretch; null values and parts, parts of one row, none."""
    from screenfold.operators import windows

    draw = np.random.default_rng(5)
    rows = [(p, k, None if draw.random() < 0.1 else float(draw.integers(0, 99))) for p, n in (("a", 70), ("b", 1), (None, 19), ("c", 8)) for k in range(n)]
    df = spark.createDataFrame(rows, "part string, k int, v double")
    monkeypatch.setattr(windows, "STRETCH", 8)
    for half in (0, 2, 8, 11):
        got = {(r["part"], r["k"]): r["m"] for r in windows.moving_mean(df, ["part"], ["k"], "v", half, "m").collect()}
        assert len(got) == len(rows)
        for p, k, _ in rows:
            near = [v for q, j, v in rows if q == p and abs(j - k) <= half and v is not None]
            assert got[p, k] == (pytest.approx(sum(near) / len(near)) if near else None), (half, p, k)
    assert windows.moving_mean(df.limit(0), ["part"], ["k"], "v", 2, "m").count() == 0


def test_reverse_cumulative_and_ragged_by_slices(spark):
    from screenfold.operators import lists, windows

    df = spark.createDataFrame([(1, 5), (2, None), (3, 7), (4, 1)], "k int, n int")
    assert {r["k"]: r["up"] for r in windows.reverse_cumulative(df, [], "k", "n", "up").collect()} == {4: 1, 3: 8, 2: 8, 1: 13}
    held = spark.createDataFrame([("x", g) for g in (3, 1, 2)] + [("y", 9)], "strain string, gene int")
    got = sorted(tuple(r) for r in lists.ragged(held, "gene", "strain", ["x", "y"]).collect())
    assert got == [(1, 1, 9), (2, 2, None), (3, 3, None)]


def test_trimmed_mean_factors_equal_plain_ranks(spark):
    """Many ties, genes without reads, samples of unequal depth: equal to the definition written out in numpy."""
    from screenfold.operators.counts import trimmed_mean_factors

    draw = np.random.default_rng(9)
    n = draw.poisson(draw.gamma(1.0, 8.0, (300, 1)) * np.array([1.0, 2.0, 0.5, 1.3]))
    n[:20] = 0
    df = spark.createDataFrame([(g, s, int(n[g, s])) for g in range(300) for s in range(4)], "gene int, s int, n long")
    x = n[n.sum(1) > 0].astype(float)
    lib = x.sum(0)
    share = np.quantile(x, 0.75, axis=0) / lib
    ref = int(np.argmin(np.abs(share - share.mean())))
    logs = np.zeros(4)
    ranks = lambda v: np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])
    for s in set(range(4)) - {ref}:
        on = (x[:, s] > 0) & (x[:, ref] > 0)
        a, b = x[on, s], x[on, ref]
        m, lv = np.log2((a / lib[s]) / (b / lib[ref])), np.log2((a / lib[s]) * (b / lib[ref])) / 2
        v = (lib[s] - a) / (lib[s] * a) + (lib[ref] - b) / (lib[ref] * b)
        k = len(m)
        low = [int(np.floor(k * t)) + 1 for t in (0.3, 0.05)]
        ok = np.logical_and.reduce([(r >= c) & (r <= k + 1 - c) for r, c in zip((ranks(m), ranks(lv)), low)])
        logs[s] = (m[ok] / v[ok]).sum() / (1 / v[ok]).sum() * np.log(2)
    want = np.exp(logs - logs.mean())
    got = {r["s"]: r["factor"] for r in trimmed_mean_factors(df, "gene", "s").collect()}
    assert np.allclose([got[s] for s in range(4)], want, rtol=1e-9)


def test_pairs_of_a_large_key_are_many_units(spark):
    from screenfold.operators import joins

    rows = [("a", i, float(i)) for i in range(60)] + [("b", 7, 1.0), ("b", 3, None), ("b", 7, 2.0), ("c", 1, 1.0), (None, 1, 1.0), (None, 2, 1.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, i long, x double")
    got = joins.pairs_within(df, "k", "i", "x", most=8).collect()
    want = [(k, a, b) for k, a, _ in rows for k2, b, _ in rows if k == k2 and k and a is not None and b is not None and a < b]
    assert sorted(tuple(r)[:3] for r in got) == sorted(want)
    assert all({r["v"], r["w"]} == {float(r["id_1"]), float(r["id_2"])} for r in got if r["k"] == "a")


def test_fast_rounding_is_rounding(spark):
    from screenfold.plans.set_queries import rounded

    rng = np.random.default_rng(9)
    x = [*rng.random(4000), *(rng.random(4000) * 1e5), *(rng.integers(0, 10**9, 4000) / 2e6), *(rng.integers(0, 10**7, 4000) / 1e7), *(rng.random(50) * 1e15), 0.0, 5e-7, 4.9999999e-7, 1.0000005, 1e300, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in x], "x double")
    assert df.where(~rounded(F.col("x")).eqNullSafe(F.round("x", 6))).count() == 0
