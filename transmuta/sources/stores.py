"""Stores kept between runs: rule decisions and analysis reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from transmuta import schemas


def decision_state(writes: DataFrame) -> DataFrame:
    """Latest decision per rule; notes and minimum confidence keep their last given value.

    Keyed aggregates only: a rule that owns most of the writes is combined map-side before the shuffle.
    """
    return _state(writes, F.struct("last_updated", "write_id"))


def _state(writes: DataFrame, order: Column) -> DataFrame:
    def last_given(c):
        given = F.col(c).isNotNull() & (F.col(c) != "")
        return F.max_by(F.when(given, F.col(c)), F.when(given, order)).alias(c)

    return writes.groupBy("pattern_id").agg(
        F.max_by("decision", order).alias("decision"), last_given("notes"), last_given("min_confidence"),
        F.max_by("last_updated", order).alias("last_updated"), F.count("*").alias("n_writes"))


def latest_decision(writes: DataFrame) -> DataFrame:
    """The last write per rule as it was made."""
    order = F.struct("last_updated", "write_id")
    cols = [c for c in writes.columns if c != "pattern_id"]
    return writes.groupBy("pattern_id").agg(F.max_by(F.struct(*cols), order).alias("v")).select("pattern_id", "v.*")


def upsert(store: DataFrame, writes: DataFrame) -> DataFrame:
    """Apply writes on top of a stored state (which comes before every write)."""
    fields = ("pattern_id", "decision", "notes", "min_confidence", "last_updated")
    old = store.select(*fields, F.lit(0).cast("long").alias("write_id"), F.lit(0).alias("round"))
    new = writes.select(*fields, "write_id", F.lit(1).alias("round"))
    return _state(old.unionByName(new), F.struct("round", "last_updated", "write_id")).drop("n_writes")


def empty_store(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.DECISIONS)


def load_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Stored decisions; a missing store is empty and unreadable lines are left out."""
    try:
        rows = spark.read.schema(schemas.DECISIONS).json(path)
    except AnalysisException:
        return empty_store(spark)
    return rows.filter(F.col("pattern_id").isNotNull())


def save_decisions(store: DataFrame, path: str) -> None:
    store.write.mode("overwrite").json(path)


def clear_decisions(spark: SparkSession, path: str) -> None:
    """An empty overwrite."""
    save_decisions(empty_store(spark), path)


def should_auto_apply(store: DataFrame) -> DataFrame:
    """Rules stored as auto_apply."""
    return store.filter(F.col("decision") == "auto_apply").select("pattern_id")


# ---- analysis report -------------------------------------------------------------------------------------------

def report_documents(files: DataFrame) -> DataFrame:
    """One JSON document per analysed file with its detections. A project's report is the set of its documents, so
    no project is ever assembled in one place."""
    return files.select("repo", "path", F.to_json(F.struct("repo", "path", F.col("detections").alias("patterns"))).alias("document"))


def parse_documents(documents: DataFrame) -> DataFrame:
    """Detections back from report documents."""
    doc = documents.select(F.from_json("document", schemas.REPORT_FILE).alias("d"))
    return doc.select("d.repo", "d.path", F.inline("d.patterns"))


def save_report(files: DataFrame, statistics: DataFrame, path: str) -> None:
    """Write `files/` (JSON lines, one per file) and `statistics/` (one line per project)."""
    report_documents(files).select(F.col("document").alias("value")).write.mode("overwrite").text(f"{path}/files")
    statistics.write.mode("overwrite").json(f"{path}/statistics")


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """Detections of a saved report. Without a report there is nothing to apply, so a missing path is an error."""
    try:
        lines = spark.read.text(f"{path}/files")
    except AnalysisException as e:
        raise FileNotFoundError(f"no analysis report at {path}: run the analysis first") from e
    return parse_documents(lines.withColumnRenamed("value", "document"))
