"""Reading the given tables and small helpers the operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words of the size, shingle and segment rules: runs of anything but the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as keep it apart from the columns of docs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def apart(docs: DataFrame, used: Sequence[str]) -> DataFrame:
    """docs with every column that an operator does not use under a number, so that its own columns clash with none.

    The columns keep their places: `toDF(*docs.columns)` of a result with the same columns gives them their names again.
    """
    return docs.toDF(*(c if c in used else f"other {i}" for i, c in enumerate(docs.columns)))


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
