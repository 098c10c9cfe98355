"""Task outcomes from a stream of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from transmuta.functions.materialize import shared_folder
from transmuta.operators.tracker import merged, task_outcome, task_state

EVENT_COLUMNS = "event_id long, ts timestamp, task_id string, kind string, test_group string, passed long, failed long, " \
                "criterion string, met boolean, requires_review boolean"


def read_events(spark: SparkSession, path: str, schema: str | StructType = EVENT_COLUMNS, fmt: str = "parquet",
                glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """A file-source stream. File sources need the schema up front."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def state_stream(events: DataFrame, out: str, checkpoint: str, delay: str | None = None, width: str = "1 day") -> StreamingQuery:
    """Maintain the state of all tasks as one compacted table, a version per micro-batch.

    With a `delay`, Spark keeps the state of a task per event-time window of `width` and drops a window's entries once the
    watermark (the latest event less the delay) has passed its end; later events of that window are late and are left out. Without
    one nothing is ever late, and Spark keeps one entry per (task, slot) for good.

    A micro-batch merges the entries it changed into the version before, which is the only one it reads, and folds windows
    that can change no more into one entry per (task, slot). Replaying a batch rewrites its version, so the table is
    exactly-once after a failure; of older versions only the one a replay needs is kept.
    """
    if delay is None:
        state = task_state(events).withColumn("until", F.lit(None).cast("timestamp"))
    else:
        timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
        state = task_state(timed, F.window("ts", width).alias("window")).withColumn("until", F.col("window.end")).drop("window")

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _version(spark, out, batch_id - 1) if batch_id else None
        entries = batch.withColumn("round", F.lit(1))
        folded = F.lit(False)
        if before is not None:
            entries = entries.unionByName(before.drop("seen").withColumn("round", F.lit(0)))
            # what Spark compares windows with from now on: the latest event of the batches before this one, less the delay
            seen = before.agg(F.max("seen").alias("seen"))
            if delay is not None:
                folded = F.coalesce(F.col("until") <= seen.select(F.col("seen") - F.expr(f"INTERVAL '{delay}'")).scalar(), F.lit(False))
        values = [c for c in batch.columns if c not in ("task_id", "slot", "until")]
        newest = entries.groupBy("task_id", "slot", "until").agg(F.max_by(F.struct(*values), "round").alias("v")).select("task_id", "slot", "until", "v.*")
        kept = merged(newest.withColumn("until", F.when(~folded, F.col("until"))), "until") if before is not None else newest
        version = kept.withColumn("seen", F.col("at.ts").cast("timestamp"))
        version.write.mode("overwrite").parquet(f"{out}/v={batch_id}")
        _forget(spark, f"{out}/v={batch_id - 2}")

    return (state.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(save).trigger(availableNow=True).start())


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _forget(spark: SparkSession, path: str) -> None:
    fs, at = _files(spark, path)
    fs.delete(at, True)


def _version(spark: SparkSession, out: str, number: int) -> DataFrame | None:
    """A complete version of the state; none if it was not finished."""
    fs, at = _files(spark, f"{out}/v={number}/_SUCCESS")
    return spark.read.parquet(f"{out}/v={number}") if fs.exists(at) else None


def latest_state(spark: SparkSession, out: str) -> DataFrame:
    """One entry per (task, slot) of the newest complete version; no other version is read."""
    fs, at = _files(spark, out)
    numbers = sorted((int(f.getPath().getName()[2:]) for f in fs.listStatus(at) if f.getPath().getName().startswith("v=")), reverse=True)
    for number in numbers:  # two at most, and one that is being written
        found = _version(spark, out, number)
        if found is not None:
            return merged(found.drop("seen"))
    raise FileNotFoundError(f"no version of the state in {out}")


def task_events_stream(events: DataFrame, folder: str, strict: bool = False, delay: str | None = None, width: str = "1 day") -> DataFrame:
    """Run the stream over what is available and return the outcomes it has reached, of the events that were not late."""
    query = state_stream(events, f"{folder}/state", f"{folder}/checkpoint", delay, width)
    query.awaitTermination()
    return task_outcome(latest_state(events.sparkSession, f"{folder}/state"), strict)


def windowed_activity(events: DataFrame, delay: str = "10 minutes", width: str = "1 day") -> DataFrame:
    """Events per task, kind and time window; the watermark lets finished windows leave the state."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width), "task_id", "kind").agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("window_start"), "task_id", "kind", "n")


def stream_folder(spark: SparkSession) -> str:
    """A fresh folder for one stream run below the shared checkpoint folder."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
