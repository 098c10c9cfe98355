"""Session settings the operators are designed for.

The operators never change the configuration of a session they are given; these values are what a job should
start with. Shuffle partitions are left to adaptive execution, which coalesces a generous initial number.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

recommended_conf = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a source file is one row and may be large: small Arrow batches keep the Python worker's memory flat
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def local_session(cores: int | str = "*", app: str = "transmuta", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    local = {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**recommended_conf, **local, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
