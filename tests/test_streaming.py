"""A stream of lanes counts as one batch over all of them."""

from screenfold.streaming.lanes import running_counts


def test_running_counts(spark, tmp_path):
    index = spark.createDataFrame([("l1", "AA", "s1"), ("l2", "CC", "s2")], "lane string, index_seq string, sample_id string")
    tags = spark.createDataFrame([("ACGTACGTAC", "g"), ("TTTTTTTTTT", "h")], "tag string, gene string")
    for k, rows in enumerate([[("l1", "AAACGTACGTACGG"), ("l2", "CCTTTTTTTTTTTT")], [("l1", "AAACGTACGTACAA"), ("l1", "GGACGTACGTACAA")]]):
        spark.createDataFrame(rows, "lane string, seq string").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("lane string, seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = running_counts(stream, index, tags, 2).writeStream.outputMode("complete").format("memory").queryName("lanes").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["sample_id"], r["gene"]): r["n"] for r in spark.table("lanes").collect()} == {("s1", "g"): 2, ("s2", "h"): 1}
