"""Labels of test files from their path and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from transmuta.functions import text

# fixed values: (label, path fragment); a path may have several labels
PATH_LABELS = (("unit", "unit"), ("integration", "integration"), ("e2e", "e2e"), ("edge_case", "edge_case"),
               ("outlier", "outlier"), ("performance", "performance"))
# fixed values: (category, path components); the first hit wins
PART_CATEGORIES = (("unit", ("unit",)), ("integration", ("integration",)), ("e2e", ("e2e",)),
                   ("edge_cases", ("edge_cases", "edge_case")), ("outliers", ("outliers", "outlier")),
                   ("performance", ("performance",)), ("windows", ("windows",)), ("error_recovery", ("error_recovery",)),
                   ("transformation", ("transformation",)), ("pattern_detection", ("pattern_detection", "pattern")))


def test_kind(content: Column) -> Column:
    """integration, e2e or unit by words in the text; `e2e` counts as integration, only `end-to-end` as e2e."""
    low = F.lower(content)
    return F.when(low.contains("integration") | low.contains("e2e"), "integration").when(
        low.contains("end-to-end"), "e2e").otherwise("unit")


def framework_tags(content: Column) -> Column:
    return F.array_compact(F.array(
        F.when(content.contains("semantic_kernel") | content.contains("sk."), F.lit("semantic_kernel")),
        F.when(content.contains("autogen"), F.lit("autogen"))))


def first_category(path: Column) -> Column:
    """First category whose name is a component of the path, default unit."""
    p = text.parts(path)
    out = None
    for name, words in PART_CATEGORIES:
        cond = F.arrays_overlap(p, F.array(*[F.lit(w) for w in words]))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("unit")


def path_categories(files: DataFrame) -> DataFrame:
    """One row per file and path label; files without a label keep one row with a NULL label."""
    labels = F.array_compact(F.array(*[F.when(F.col("path").contains(w), F.lit(n)) for n, w in PATH_LABELS]))
    return files.select("repo", "path", F.explode_outer(labels).alias("label"), first_category(F.col("path")).alias("category"))
