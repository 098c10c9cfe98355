"""Cutting lineage through the cluster's shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Executors of a cluster do not see each other's disks, so without that setting this is an error there; only a
    single-process session (tests, benchmarks) chooses a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="transmuta-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table once so that several branches can read it.

    A written table survives lost executors, is read by column, and tells the planner its size.
    """
    return Written(df, name).df


class Written:
    """A table written to the shared folder, to be dropped once nothing reads it any more."""

    def __init__(self, df: DataFrame, name: str = "table"):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished queries now; else they stay until the driver happens to collect garbage."""
    gc.collect()
    spark._jvm.System.gc()
