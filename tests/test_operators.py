"""Operators on small tables with nulls, ties and empty input."""

import gzip

import pytest
from pyspark.sql import functions as F

from screenfold.operators import counts, graph, joins, lists, reads, splits
from screenfold.sources import fastq, files, sinks


def test_components_of_a_chain_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500), (None, 3), (3, None)]
    got = {r["id"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[100 + i] for i in range(30)} == {100} and got[500] == 500
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_by_plain_union(spark):
    import random

    rng = random.Random(3)
    ids = rng.sample(range(-(10**12), 10**12), 900)
    edges = list(zip(ids, ids[1:500])) + [(ids[600], x) for x in ids[500:800]] + [(rng.choice(ids[800:]), rng.choice(ids[800:])) for _ in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    assert {r["id"]: r["component"] for r in graph.connected_components(df).collect()} == {x: find(x) for x in list(root)}
    words = spark.createDataFrame([("c", "b"), ("b", "a"), ("z", "z"), ("y", "x")], "a string, b string")
    assert {r["id"]: r["component"] for r in graph.connected_components(words).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}


def test_cpm_sums_to_a_million_and_guards_empty_libraries(spark):
    df = spark.createDataFrame([("a", "s", 1), ("b", "s", 3), ("a", "t", 0), ("b", "t", 0)], "gene string, sample string, n long")
    got = {(r["gene"], r["sample"]): r["cpm"] for r in counts.cpm(df, ["sample"]).collect()}
    assert got["a", "s"] == 250_000 and got["a", "t"] == 0
    assert counts.cpm(df, ["sample"], guard=False).where("sample = 't'").first()["cpm"] is None


def test_imputed_cells_are_zero_end_cells(spark):
    rows = [("g", "s", 0, r, 30.0, 5) for r in range(2)] + [("g", "s", 10, 0, 0.0, 0), ("g", "s", 10, 1, 9.0, 2), ("h", "s", 0, 0, 1.0, 1), ("h", "s", 10, 0, 0.0, 0)]
    df = spark.createDataFrame(rows, "gene string, strain string, gen int, rep int, cpm double, n long")
    assert counts.impute_mask(df, "gene", "strain", "gen").where("imputed").count() == 0
    got = counts.impute_mask(df, "gene", "strain", "gen", rule="any_zero").where("imputed").collect()
    assert [(r["gene"], r["gen"], r["rep"]) for r in got] == [("g", 10, 0)]


def test_lane_sum_misses_cells_that_a_lane_lacks(spark):
    a = spark.createDataFrame([("g", 1), ("h", 2)], "gene string, n long")
    got = {r["gene"]: r["n"] for r in counts.lane_sum([a, a, a.where("gene = 'g'")], ["gene"]).collect()}
    assert got == {"g": 3, "h": None}


def test_tag_rules(spark):
    decode = spark.createDataFrame([(1, "first", "ACGTACGTAC"), (2, "last", "ACGTACGTAC"), (3, "long", "ACGTACGTACGG")], "ord long, gene string, tag string")
    assert {r["tag"]: r["gene"] for r in reads.exact_tags(decode).collect()}["ACGTACGTAC"] == "last"
    assert {r["variant"]: r["gene"] for r in reads.fuzzy_tags(decode).collect()}["ACGTACGTAN"] == "first"
    assert reads.fuzzy_tags(decode, strict=True).where("variant = 'ACGTACGTAN'").count() == 0
    r = spark.createDataFrame([("l", 1, "TTACGTACGTACGGAA"), ("l", 2, "TTACGTACGTNCGGAA")], "lane string, read_no long, seq string")
    assert {x["read_no"]: x["gene"] for x in reads.exact_match(r, reads.exact_tags(decode), 2).collect()} == {1: "last"}
    assert {x["read_no"]: x["gene"] for x in reads.fuzzy_match(r.where("read_no = 2"), reads.fuzzy_tags(decode), 2).collect()} == {2: "first"}


def test_longest_index_wins(spark):
    r = spark.createDataFrame([("l", 1, "AACCGG"), ("l", 2, "AATTTT"), ("l", 3, "GGGGGG"), ("m", 4, "GG")], "lane string, read_no long, seq string")
    sheet = spark.createDataFrame([("short", "l", "AA"), ("long", "l", "AACC"), ("all", "m", "")], "sample_id string, lane string, index_seq string")
    assert {x["read_no"]: x["sample_id"] for x in reads.demultiplex(r, sheet, [2, 4]).collect()} == {1: "long", 2: "short", 3: None, 4: "all"}


def test_missing_scores_are_no_effect(spark):
    e = lists.effects(spark.createDataFrame([("g", 1, None), ("g", 2, -1.0), ("h", 1, 0.6)], "gene string, strain int, fc double"), "fc", 0.5)
    assert e.where("any_effect").count() == 2
    assert [(r["gene"], r["others"]) for r in lists.specific(e, "deleterious", 0).collect()] == [("g", 0)]


def test_moving_flagged_genes_leaves_no_leak(spark):
    split = spark.createDataFrame([("a", "train"), ("b", "val"), ("c", "val"), ("d", "test")], "gene string, split string")
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.5), ("c", "d", 0.2)], "g1 string, g2 string, identity double")
    flagged = splits.straddling(edges, split, 0.3)
    assert sorted(r["gene"] for r in flagged.collect()) == ["b", "c"]
    after = splits.leak_counts(edges, splits.move(split, flagged), [("train", "val"), ("train", "test")], [0.3])
    assert after.agg(F.sum("n_with_relative")).first()[0] == 0


def test_nearest_gap(spark):
    rows = spark.createDataFrame([(1, "k", 10), (2, "k", 100), (3, "z", 5)], "id long, key string, at long")
    marks = spark.createDataFrame([("k", 4), ("k", 30)], "key string, at long")
    assert {r["id"]: r["gap"] for r in joins.nearest_gap(rows, marks, "id", "key", "at").collect()} == {1: 6, 2: 70, 3: None}


def test_fastq_source(spark, tmp_path):
    text = "".join(f"@r{i}\nACGT{i}\n+\nIIIII\n" for i in range(5))
    (tmp_path / "lane1.fastq").write_text(text)
    with gzip.open(tmp_path / "lane2.fastq.gz", "wt") as f:
        f.write(text)
    fastq.register(spark)
    got = spark.read.format("fastq").load(str(tmp_path))
    assert got.count() == 10 and {r["lane"] for r in got.select("lane").distinct().collect()} == {"lane1", "lane2"}
    assert spark.read.format("fastq").option("n_reads", "2").load(str(tmp_path)).count() == 4
    assert got.where("lane = 'lane2' and read_no = 3").first()["seq"] == "ACGT3"


def test_files(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">sp|P1|N one\nMK\nL*\n>two\nAA\n")
    got = {r["name"]: r["sequence"] for r in files.fasta_records(files.lines_of(spark, str(tmp_path / "x.fa"))).collect()}
    assert got == {"sp|P1|N": "MKL", "two": "AA"}
    (tmp_path / "s.tsv").write_text("sample_id\tstrain\tgeneration\treplicate\tfastq\tindex_seq\na\tY\t0\tA\tf\t\na\tY\t7\tA\tf\t\n")
    with pytest.raises(ValueError, match="repeated sample_id"):
        files.read_sheet(spark, str(tmp_path / "s.tsv"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("g", "c"), ("g", "c"), ("", "d")], "gene string, category string")
    sinks.write_pairs(df, str(tmp_path / "pairs"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "pairs")).collect()] == ["g\tc"]
    assert sinks.verified_write(df, str(tmp_path / "table")).count() == 3


def test_lists_lanes_pairs_and_annotations(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\tgene\n1\tG1\n2\tG2\n3\tG1\n4\t\n")
    (tmp_path / "b.tsv").write_text("name\tv\nG3\t1\n")
    names = lambda f: sorted(r["gene"] for r in files.read_list(spark, f"{tmp_path}/{f}").collect())
    assert (names("a.tsv"), names("b.tsv"), names("none.tsv")) == (["G1", "G2"], ["G3"], [])
    (tmp_path / "lane.tsv").write_text("gene\tS_Rep1_Gen0A1-AATAGG\tS_Rep2_Gen10H12-CC\nG\t4\t5\n")
    assert files.read_lane_matrix(spark, f"{tmp_path}/lane.tsv").columns == ["gene", "S_Rep1_Gen0", "S_Rep2_Gen10"]
    with pytest.raises(ValueError, match="S_Rep1"):
        files.clean_lane_columns(spark.createDataFrame([(1, 2)], "`S_Rep1A1-AC` int, `S_Rep1B2-GT` int"))
    a, b = spark.createDataFrame([("g",), ("h",)], "gene string"), spark.createDataFrame([("h",), ("g",)], "gene string")
    assert files.paired_tables(a, b, "gene")[1] is b
    with pytest.raises(ValueError, match="left"):
        files.paired_tables(a, b.limit(1), "gene")
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "s.tsv").write_text("gene\tsplit\nNA\ttrain\nG\tNaN\n")
    got = {(r["run"], r["gene"], r["split"]) for r in files.read_splits(spark, f"{tmp_path}/run*/s.tsv").collect()}
    assert got == {("run1", "NA", "train"), ("run1", "G", "NaN")}
    (tmp_path / "f.tsv").write_text("gene\tlen\nG\t3\nH\tx\n")
    cats, long = files.read_annotations(spark, f"{tmp_path}/none", f"{tmp_path}/f.tsv")
    assert cats.count() == 0 and {(r["gene"], r["value"]) for r in long.where("value is not null").collect()} == {("G", 3.0)}
    assert {(r["source"], r["status"]) for r in files.coverage(spark, {"f": f"{tmp_path}/f.tsv", "n": f"{tmp_path}/none"}).collect()} == {("f", "loaded"), ("n", "missing")}
    (tmp_path / "sgd.tsv").write_text("\t".join(f"v{i}" if i else "" for i in range(16)) + "\n")
    assert files.read_features(spark, f"{tmp_path}/sgd.tsv").first()["c0"] == "" and len(files.read_features(spark, f"{tmp_path}/sgd.tsv", nulls=True).columns) == 16


def test_sinks_of_small_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "gene string")
    sinks.write_list(empty, f"{tmp_path}/none")
    assert files.read_list(spark, f"{tmp_path}/none").count() == 0
    sinks.write_list(spark.createDataFrame([("g",), ("h",)], "gene string"), f"{tmp_path}/some", spark.createDataFrame([("g", 1.5)], "gene string, fc double"))
    assert {(r["gene"], r["fc"]) for r in files.read_table(spark, f"{tmp_path}/some").collect()} == {("g", "1.5"), ("h", None)}
    sinks.write_split_map(spark.createDataFrame([("g", "train"), ("g", "train")], "gene string, split string"), f"{tmp_path}/map")
    assert files.read_table(spark, f"{tmp_path}/map").count() == 1
    sinks.write_nonzero(spark.createDataFrame([("g", 0.0), ("h", 2.0), ("i", None)], "gene string, v double"), f"{tmp_path}/nz", "v")
    assert [r["gene"] for r in files.read_table(spark, f"{tmp_path}/nz").collect()] == ["h"]
    sinks.write_by(spark.createDataFrame([("a", 1), ("b", 2)], "strain string, n int"), "strain", f"{tmp_path}/by")
    assert spark.read.parquet(f"{tmp_path}/by/strain=a").count() == 1
    assert sinks.stats_json(spark.createDataFrame([(1, "x")], "n int, t string")).first()["value"] == '{"n":1,"t":"x"}'


def test_leaves_specs_and_designs(spark, tmp_path):
    from screenfold.operators import models

    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate([(1, 2, 3), (3, 2, 1), (1, 2, 3.1), (3, 2, 1.1), (2, 2, 9)])], "gene long, v array<double>")
    merges = models.average_linkage(rows, "gene", "v")
    order = [r["leaf"] for r in models.leaf_order(merges).orderBy("place").collect()]
    assert sorted(order) == list(range(5)) and abs(order.index(0) - order.index(2)) == 1 and abs(order.index(1) - order.index(3)) == 1
    sinks.write_linkage(merges, f"{tmp_path}/linkage")
    assert [r["step"] for r in spark.read.parquet(f"{tmp_path}/linkage").collect()] == list(range(4))
    assert splits.split_spec("0.7:0.15:0.15") == [("train", 0.7), ("val", 0.15), ("test", 0.15)] and splits.split_spec("0.8:0.2", "R", "x")[1] == ("test", 0.2)
    for bad in (("1",), ("0.5:0.4",), ("0.5:0.5", "Z"), ("0.5:0.5", "C1e", "nothing")):
        with pytest.raises(ValueError):
            splits.split_spec(*bad)
    r = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "x")], "id int, gene string, strain string")
    assert {(d["id"], d["block"], d["slot"]) for d in models.design(r, "id", "both").collect()} == {(2, "gene", 1), (3, "gene", 2), (2, "strain", 3)}
    assert models.design(r, "id", "ones").count() == 3 and models.design(r, "id", "gene", r.where("gene <> 'c'")).count() == 1


def test_category_counts_split_and_id_readers(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("# note\ng1\tA\ng2\tA\ng1\tA\ng3\tB\ng4\t\n")
    rows, held = files.read_categories(spark, str(tmp_path / "c.tsv"))
    assert sorted(map(tuple, rows.collect())) == [("g1", "A"), ("g2", "A"), ("g3", "B")]
    assert sorted((r["category"], r["genes"]) for r in held.collect()) == [("A", ["g1", "g2"]), ("B", ["g3"])]
    (tmp_path / "n.csv").write_text("gene,a 1,b\nx,3,\ny,0,7\n")
    assert sorted(map(str, map(tuple, files.read_counts(spark, str(tmp_path / "n.csv")).collect()))) == sorted(map(str, [("x", "a 1", 3), ("x", "b", None), ("y", "a 1", 0), ("y", "b", 7)]))
    (tmp_path / "s.tsv").write_text("gene\tSplit\nx\ttrain\ny\tval\nz\ttrain\n")
    frames = files.read_split_frames(spark, str(tmp_path / "s.tsv"))
    assert {n: sorted(r["gene"] for r in d.collect()) for n, d in frames.items()} == {"train": ["x", "z"], "val": ["y"], "test": []}
    with gzip.open(tmp_path / "m.tsv.gz", "wt") as f:
        f.write("acc\tname\tmore\nP1\tYA\t1\nP1\tYA\t2\n\tYB\t3\nP2\t\t4\n")
    assert [tuple(r) for r in files.read_id_map(spark, str(tmp_path / "m.tsv.gz"), "acc", "name").collect()] == [("P1", "YA")]


def test_the_column_of_names_is_picked_by_its_first_rows(spark):
    from screenfold.functions import text

    rows = spark.createDataFrame([(i, f"YAL{i % 1000:03}C" if i < 300 or i > 500 else "?", None if i % 2 else f"yal{i % 1000:03}w", "x") for i in range(900)], "id long, name string, half string, other string")
    pattern = "(?i)^Y[A-P][LR][0-9]{3}[WC](-[A-Z])?(_[0-9]+)?$"
    assert text.pick_column(rows, pattern, columns=["name", "half", "other"], order=["id"]) == "name"
    rates = {r["col"]: r["rate"] for r in text.hit_rates(rows, pattern, ["name", "half", "other"], ["id"]).collect()}
    assert rates == {"name": 0.6, "half": 0.5, "other": 0.0}
    with pytest.raises(ValueError):
        text.pick_column(rows, pattern, columns=["other", "id"])
