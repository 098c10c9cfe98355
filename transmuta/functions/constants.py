"""Small tables as constants of the query plan."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable, Iterable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def constant_rows(rows: Iterable[dict], schema: str) -> Column:
    """A list of records as one foldable array-of-struct column.

    Written as JSON so that the plan holds a single node however many rows there are; the optimizer folds it to a
    literal before execution.
    """
    return F.from_json(F.lit(json.dumps(list(rows), ensure_ascii=False)), f"array<{schema}>")


def constant_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A list of tuples as a table that is part of the plan. Its size is known to the planner, so joins broadcast it."""
    names = [c.split()[0] for c in schema.split(",")]
    records = [dict(zip(names, row)) for row in rows]
    fields = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in schema.split(","))
    return spark.range(0, 1, 1, 1).select(F.inline(constant_rows(records, f"struct<{fields}>")))


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep the column a builder returns, per driver JVM and arguments.

    Columns are immutable and unresolved, so one can serve any number of plans; building a nested one takes hundreds of
    calls to the JVM.
    """
    kept: dict = {}

    @functools.wraps(build)
    def get(*args):
        key = (id(SparkContext._gateway), *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return get
