"""Migration metrics: counters per project, rates, success criteria, JSON form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from transmuta import schemas
from transmuta.functions.facts import with_facts
from transmuta.operators import detect, rewrite
from transmuta.operators.validate import unknown_imports
from transmuta.sources.catalog import RuleSet

# fixed values: default thresholds in percent
MIN_TRANSFORMATION_RATE = 75.0
MAX_SYNTAX_ERROR_RATE = 5.0
MAX_IMPORT_ERROR_RATE = 10.0
RATES = ("transformation_rate", "syntax_error_rate", "import_error_rate", "pattern_transformation_rate", "success_rate")


def metric_counts(files: DataFrame, rules: RuleSet, known_modules: Sequence[str]) -> DataFrame:
    """Counters per project from one pass: parse, detect, rewrite and count in the row, then sum per project."""
    run = rewrite.rewrite(detect.with_detections(with_facts(files), parsed=True), rules)
    facts = F.col("facts")
    return run.groupBy("repo").agg(
        F.count("*").alias("total_files"),
        F.count_if(facts.isNotNull()).alias("files_analyzed"),
        F.count_if("changed").alias("files_transformed"),
        F.count_if(~facts["parse_ok"]).alias("files_with_syntax_errors"),
        F.count_if(unknown_imports(known_modules) > 0).alias("files_with_import_errors"),
        F.count_if(facts.isNull()).alias("files_skipped"),
        F.sum(F.size("detections")).alias("patterns_detected"),
        F.sum(F.size("applied")).alias("patterns_transformed"),
        F.lit(0).cast("long").alias("transformation_errors"),
        F.count_if(~facts["parse_ok"]).alias("validation_errors"))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part / whole * 100)


def metric_rates(counts: DataFrame) -> DataFrame:
    """Add the five rates in percent, 0 where the denominator is 0; and the duration when times are present."""
    done = F.col("files_transformed")
    out = counts.withColumns({
        "transformation_rate": _percent(done, F.col("files_analyzed")),
        "syntax_error_rate": _percent(F.col("files_with_syntax_errors"), done),
        "import_error_rate": _percent(F.col("files_with_import_errors"), done),
        "pattern_transformation_rate": _percent(F.col("patterns_transformed"), F.col("patterns_detected")),
        "success_rate": _percent(done - F.col("files_with_syntax_errors") - F.col("files_with_import_errors"), done),
    })
    if {"start_time", "end_time"} <= set(counts.columns):
        seconds = F.col("end_time").cast("timestamp").cast("double") - F.col("start_time").cast("timestamp").cast("double")
        out = out.withColumn("duration_seconds", seconds)
    return out


def success_criteria(rates: DataFrame, min_transformation: float = MIN_TRANSFORMATION_RATE,
                     max_syntax: float = MAX_SYNTAX_ERROR_RATE, max_import: float = MAX_IMPORT_ERROR_RATE) -> DataFrame:
    """Add one boolean per criterion and their conjunction."""
    return rates.withColumns({
        "meets_transformation_rate": F.col("transformation_rate") >= min_transformation,
        "meets_syntax_error_rate": F.col("syntax_error_rate") <= max_syntax,
        "meets_import_error_rate": F.col("import_error_rate") <= max_import,
    }).withColumn("meets_all", F.col("meets_transformation_rate") & F.col("meets_syntax_error_rate") & F.col("meets_import_error_rate"))


_SAVED = "repo string, " + ", ".join(f"{c} long" for c in schemas.METRIC_COUNTS) + ", start_time string, end_time string"


def to_json(rates: DataFrame) -> DataFrame:
    """One JSON document per project: counters, ISO times, a `calculated` object and a `success_criteria` object."""
    full = success_criteria(rates)
    times = [F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(c) for c in ("start_time", "end_time") if c in rates.columns]
    doc = F.struct(
        "repo", *schemas.METRIC_COUNTS, *times, F.struct(*RATES).alias("calculated"),
        F.struct("meets_transformation_rate", "meets_syntax_error_rate", "meets_import_error_rate", "meets_all").alias("success_criteria"))
    return full.select("repo", F.to_json(doc).alias("document"))


def from_json(documents: DataFrame) -> DataFrame:
    """Counters and times back from JSON; derived fields are dropped and can be recomputed."""
    saved = documents.select(F.from_json("document", _SAVED).alias("d")).select("d.*")
    return saved.withColumns({c: F.to_timestamp(c) for c in ("start_time", "end_time")})


def save(rates: DataFrame, path: str) -> None:
    to_json(rates).select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def load(spark, path: str) -> DataFrame:
    return from_json(spark.read.text(path).withColumnRenamed("value", "document"))
