"""Helpers that keep costly per-row expressions from being evaluated more than once.

Three things matter here. A filter on a computed column is pushed below the projection that computes it, so the
expression runs in the filter and again in the projection. And exploding a bare array column adds a `size > 0` filter
that is pushed down the same way, past shuffles and user functions. And an expression used inside a lambda
runs once per element, including the definition of a column that the optimizer has merged into it. All three are fine
for cheap expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a one-element generator, which no later filter is pushed through."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def elements(array: str | Column) -> Column:
    """The same array as an expression, so that exploding it infers no filter on it."""
    return F.transform(F.col(array) if isinstance(array, str) else array, lambda x: x)
