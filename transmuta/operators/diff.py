"""Comparing two snapshots of a file table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from transmuta.functions import text
from transmuta.functions.arrays import once
from transmuta.functions.joins import may_be_member


def line_changes(before: Column, after: Column) -> Column:
    """Unequal lines at the same position of two line array columns, plus the surplus lines of the longer one.

    Each change is (line_no, hunk, kind, before, after); only `modified` rows carry a hunk header, because the
    header form compares the common length.
    """
    pairs = F.transform(F.arrays_zip(before.alias("b"), after.alias("a")), lambda p, i: F.struct(
        (i + 1).cast("int").alias("line_no"), p["b"].alias("b"), p["a"].alias("a"),
        F.when(i >= F.size(after), "removed").when(i >= F.size(before), "added").otherwise("modified").alias("kind")))
    unequal = F.filter(pairs, lambda p: ~p["b"].eqNullSafe(p["a"]))
    return F.transform(unequal, lambda p: F.struct(
        p["line_no"].alias("line_no"),
        F.when(p["kind"] == "modified", F.concat(F.lit("@@ -"), p["line_no"], F.lit(",1 +"), p["line_no"], F.lit(",1 @@"))).alias("hunk"),
        p["kind"].alias("kind"), p["b"].alias("before"), p["a"].alias("after")))


def line_diff(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("repo", "path"), text_col: str = "content") -> DataFrame:
    """Changed lines of the texts present in both tables.

    Keys and digests are compared first. What differs becomes a membership filter of fixed size that is tested in a second
    scan of either side, so that only the texts of differing keys, and of a few more that the filter lets pass, reach the
    join. Texts of equal keys cross no network, whatever the planner knows about sizes.
    """
    def digests(df, name):
        return df.select(*keys, F.sha2(F.col(text_col), 256).alias(name))

    # null-safe, as a plain comparison would make the planner test, and so compute, every digest once more
    differing = digests(before, "_old").join(digests(after, "_new"), list(keys)).filter(~F.col("_old").eqNullSafe(F.col("_new")))
    may_differ = may_be_member(differing, list(keys))

    def side(df, name):
        return df.filter(may_differ).select(*keys, F.col(text_col).alias(name))

    joined = side(before, "_b").join(side(after, "_a"), list(keys)).filter(F.col("_b") != F.col("_a"))
    split = once(joined, _old=text.splitlines(F.col("_b")), _new=text.splitlines(F.col("_a")))
    return split.select(*keys, F.inline(line_changes(F.col("_old"), F.col("_new"))))


def rewrite_diff(rewritten: DataFrame) -> DataFrame:
    """Changed lines of a rewrite; both texts are in the row, so nothing is joined."""
    split = once(rewritten.filter("changed"), _old=text.splitlines(F.col("content")), _new=text.splitlines(F.col("new_content")))
    return split.select("repo", "path", F.inline(line_changes(F.col("_old"), F.col("_new"))))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """added / removed / modified / same per path. Only digests are shuffled, never the content."""
    def digests(df, name):
        # raw bytes, where a scan carries them, tell unreadable files apart too
        body = "raw" if "raw" in df.columns else "content"
        return df.select("repo", "path", F.sha2(F.col(body), 256).alias(name), F.lit(True).alias(f"has_{name}"))

    joined = digests(before, "old").join(digests(after, "new"), ["repo", "path"], "full")
    status = F.when(F.col("has_old").isNull(), "added").when(F.col("has_new").isNull(), "removed").when(
        F.col("old").eqNullSafe(F.col("new")), "same").otherwise("modified")
    return joined.select("repo", "path", status.alias("status"))


def snapshot_status(diff: DataFrame) -> DataFrame:
    """Clean or dirty per project."""
    def n(kind):
        return F.count_if(F.col("status") == kind).alias(kind)

    counts = diff.groupBy("repo").agg(n("added"), n("removed"), n("modified"), n("same"))
    changed = (F.col("added") + F.col("removed") + F.col("modified")) > 0
    return counts.withColumn("has_changes", changed).withColumn("state", F.when(changed, "dirty").otherwise("clean"))
