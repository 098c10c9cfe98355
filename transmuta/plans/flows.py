"""The three journeys of a user: analyze, apply, validate. Each is a composition of operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from transmuta.functions.materialize import Written
from transmuta.operators import decisions, metrics, outliers, reports, resolve, rewrite, validate
from transmuta.sources import stores
from transmuta.sources.catalog import RuleSet
from transmuta.sources.corpus import glob_scan


def analyze(files: DataFrame, out: str, limits: outliers.Limits = outliers.Limits()) -> None:
    """Scan, detect, judge outliers and save the report."""
    judged = Written(outliers.file_flags(files, limits, with_detections=True), "judged")  # both parts of the report read this one parse
    stores.save_report(judged.df.filter("selected"), reports.judged_statistics(judged.df, limits), out)
    judged.drop()


def apply(files: DataFrame, report_path: str, rules: RuleSet, mode: str = "auto", by_rule: DataFrame | None = None,
          by_file: DataFrame | None = None, stored: DataFrame | None = None, per_match: bool = False) -> DataFrame:
    """Rewrite the files a saved report names. Review mode keeps only the changes that were accepted."""
    detections = stores.load_report(files.sparkSession, report_path)
    if mode == "review":
        rows = resolve.resolve_rule(detections, files, rules).filter(F.col("rule_id").isNotNull())
        kept = decisions.decision_gate(rows, by_rule, by_file, stored, mode).filter("kept")
        detections = kept.select(*detections.columns)
    return rewrite.rewrite(resolve.attach_detections(files, detections), rules, mode, per_match)


def validate_tree(files: DataFrame, known_modules: DataFrame) -> DataFrame:
    """One row of validation results per project, over its Python files."""
    files = glob_scan(files)
    return validate.validation_summary(validate.validate(files, known_modules), files)


def project_metrics(files: DataFrame, rules: RuleSet, known_modules: Sequence[str]) -> DataFrame:
    """Counters, rates and success criteria per project."""
    return metrics.success_criteria(metrics.metric_rates(metrics.metric_counts(files, rules, known_modules)))
