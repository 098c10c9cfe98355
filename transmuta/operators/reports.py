"""Reports as ordered line tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from transmuta.functions import text
from transmuta.operators import outliers


def analysis_statistics(files: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """Per project: files, detections, and the outlier verdict when a report is given."""
    stats = files.groupBy("repo").agg(F.count("*").alias("total_files"), F.sum(F.size("detections")).alias("patterns_detected"),
                                      F.count_if(F.size("detections") > 0).alias("files_with_patterns"))
    return stats if report is None else stats.join(report.select("repo", "is_outlier", "risk_level"), "repo", "left")


def judged_statistics(judged: DataFrame, limits: outliers.Limits = outliers.Limits()) -> DataFrame:
    """`analysis_statistics` with the verdict, from `file_flags` with detections: one scan, one parse, one aggregate."""
    n = F.size("detections")
    counted = judged.withColumns({"total_files": F.col("selected").cast("long"), "patterns_detected": n.cast("long"), "files_with_patterns": (n > 0).cast("long")})
    totals = ["total_files", "patterns_detected", "files_with_patterns"]
    counted = counted.withColumnsRenamed({t: f"sum_{t}" for t in totals})
    report = outliers.outlier_report(outliers.outlier_type_counts(counted, limits, [f"sum_{t}" for t in totals]))
    return report.filter("sum_total_files > 0").select("repo", *[F.col(f"sum_{t}").alias(t) for t in totals], "is_outlier", "risk_level")


def _line(section: int, line: Column, path: Column | None = None, seq: Column | None = None) -> Column:
    return F.struct(F.lit(section).alias("section"), (F.lit("") if path is None else path).alias("at_path"),
                    (F.lit(0) if seq is None else seq).cast("int").alias("at_seq"), line.alias("line"))


def report_lines(files: DataFrame) -> DataFrame:
    """Markdown of the analysis: (repo, section, at_path, at_seq, line); that order is the document's.

    Lines carry sort keys instead of a running number, so a project's document needs no single task.
    """
    stats = analysis_statistics(files)
    header = F.array(
        _line(0, F.lit("# Migration Report")), _line(1, F.lit("")), _line(2, F.lit("## Statistics")),
        _line(3, F.concat(F.lit("- Total files: "), F.col("total_files"))),
        _line(4, F.concat(F.lit("- Patterns detected: "), F.col("patterns_detected"))),
        _line(5, F.lit("")), _line(6, F.lit("## Detected Patterns")))
    bullets = F.flatten(F.transform("detections", lambda d: F.array(
        _line(7, F.concat(F.lit("- **"), d["id"], F.lit("**: "), d["type"]), F.col("path"), d["det_seq"] * 2),
        _line(7, F.concat(F.lit("  - File: `"), F.col("path"), F.lit("`")), F.col("path"), d["det_seq"] * 2 + 1))))
    return stats.select("repo", F.inline(header)).unionByName(files.select("repo", F.inline(bullets)))


def summary_lines(rewritten: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Markdown of a run: counts, updated files, failed files."""
    from transmuta.operators.mapping import checkpoint_counts

    counts = checkpoint_counts(rewritten, failed)
    header = F.array(
        _line(0, F.lit("# Migration Summary")), _line(1, F.lit("")), _line(2, F.lit("## Results")),
        _line(3, F.concat(F.lit("- Files updated: "), F.col("updated_files"))),
        _line(4, F.concat(F.lit("- Files failed: "), F.col("failed_files"))),
        _line(5, F.concat(F.lit("- Patterns applied: "), F.col("patterns_applied"))),
        _line(6, F.lit("")), _line(7, F.lit("## Updated Files")))
    failures = F.filter(F.array(_line(9, F.lit("")), _line(10, F.lit("## Failed Files"))), lambda _: F.col("failed_files") > 0)
    out = counts.select("repo", F.inline(F.concat(header, failures)))
    updated = rewritten.filter("changed").select("repo", F.inline(F.array(_line(8, F.concat(F.lit("- "), F.col("path")), F.col("path")))))
    out = out.unionByName(updated)
    if failed is not None:
        rows = F.array(_line(11, F.concat(F.lit("- "), F.col("path"), F.lit(": "), F.col("error")), F.col("path")))
        out = out.unionByName(failed.select("repo", F.inline(rows)))
    return out


def write_markdown(lines: DataFrame, path: str) -> None:
    """One folder of text per project, in document order."""
    ordered = lines.orderBy("repo", "section", "at_path", "at_seq")
    ordered.select("repo", F.col("line").alias("value")).write.mode("overwrite").partitionBy("repo").text(path)


def applied_preview(rewritten: DataFrame, first: int = 3) -> DataFrame:
    """`n patterns applied: a, b, c...` per changed file."""
    return rewritten.filter("changed").select("repo", "path", F.concat(
        F.size("applied"), F.lit(" patterns applied: "), text.preview_list(F.col("applied"), first)).alias("summary"))
