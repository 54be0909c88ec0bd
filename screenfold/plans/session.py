"""Session settings that the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` is used when the cluster names one. Only a local master, where driver
    and executors are one machine, gets a temporary folder of its own; any other session without the
    setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts lineage, and survives the loss of any executor.
    """
    return Scratch(df.sparkSession, name).keep(df)


class Scratch:
    """Parquet tables of one iteration below the shared checkpoint folder.

    ``keep`` cuts lineage as ``stash`` does. ``forget`` removes every table but the last, once the
    last has been written and nothing reads the earlier ones any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{ensure_checkpoint_dir(self.spark)}/{self.name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, all_of_them: bool = False) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        gone, self.paths = (self.paths, []) if all_of_them else (self.paths[:-1], self.paths[-1:])
        for path in gone:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def shuffle_width(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
