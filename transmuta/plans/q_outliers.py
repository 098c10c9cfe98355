"""Queries over outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from transmuta.operators import outliers
from transmuta.plans.base import CTES, corpus, query, values
from transmuta.plans.q_detect import LIMITS
from transmuta.sources import corpus as scans
from transmuta.functions import text

CTES["advice"] = values(outliers.ADVICE, "outlier_type, risk, recommendation")
CTES["flags"] = """
SELECT f.doc_id, f.repo, f.path, f.rel, len(f.arr) AS n_lines, CASE WHEN contains(f.rel, '/') THEN string_split(f.rel, '/')[1] END AS top_dir,
  len(string_split(f.rel, '/')) - 1 AS depth, string_split(f.rel, '/')[1] IN ('generated', 'build', 'dist', '__pycache__', '.pytest_cache') AS is_generated,
  ends_with(f.rel, '/__init__.py') AND trim(f.content) = '' AND len(string_split(f.path, '/')) > 3 AS is_namespace,
  NOT skipped AND len(f.arr) > 40 AS large_files, NOT skipped AND x.is_mixed AS mixed_indentation, FALSE AS encoding_issues,
  NOT skipped AND k.parse_ok AND k.max_func_lines > 1 AS large_functions, NOT skipped AND k.parse_ok AND k.max_nesting > 0 AS deep_nesting,
  FALSE AS unusual_file_types, NOT skipped AND m.comment_only AS patterns_in_comments
FROM (SELECT *, substring(path, length(repo) + 2) AS rel, list_contains(string_split(path, '/'), 'venv') AS skipped FROM line_arrays) f
JOIN mixed x ON x.doc_id = f.doc_id JOIN file_facts k ON k.doc_id = f.doc_id JOIN mentions m ON m.doc_id = f.doc_id"""
CTES["profile"] = """
SELECT repo, count(DISTINCT CASE WHEN top_dir NOT LIKE '.%' THEN top_dir END) AS python_project_count, max(depth) AS max_depth, bool_or(is_generated) AS generated_code,
  FALSE AS git_submodules, bool_or(is_namespace) AS namespace_packages, count(*) AS total_files,
  count(*) FILTER (large_files) AS large_files, count(*) FILTER (mixed_indentation) AS mixed_indentation, count(*) FILTER (encoding_issues) AS encoding_issues,
  count(*) FILTER (large_functions) AS large_functions, count(*) FILTER (deep_nesting) AS deep_nesting,
  count(*) FILTER (unusual_file_types) AS unusual_file_types, count(*) FILTER (patterns_in_comments) AS patterns_in_comments
FROM flags GROUP BY repo"""
CTES["sizes"] = """
SELECT t.repo, t.total_files, t.total_files > 48 AS very_large_codebase, t.total_files < 49 AS very_small_codebase, s.size_ratio,
  coalesce(s.size_ratio > 5.0, FALSE) AS extreme_size_variation
FROM (SELECT repo, count(*) AS total_files FROM flags GROUP BY repo) t LEFT JOIN (
  SELECT repo, CASE WHEN max(n_lines) > 0 AND min(n_lines) > 0 THEN max(n_lines) / min(n_lines) END AS size_ratio
  FROM flags GROUP BY repo) s ON s.repo = t.repo"""
CTES["type_counts"] = " UNION ALL ".join(
    f"SELECT p.repo, p.total_files, '{t}' AS outlier_type, CAST({e} AS BIGINT) AS n FROM profile p JOIN sizes z ON z.repo = p.repo"
    for t, e in [("monorepo", "CASE WHEN p.python_project_count > 1 THEN 1 ELSE 0 END"),
                 ("deep_nesting", "CASE WHEN p.max_depth > 2 THEN 1 ELSE 0 END + p.deep_nesting"),
                 ("generated_code", "CASE WHEN p.generated_code THEN 1 ELSE 0 END"),
                 ("namespace_packages", "CASE WHEN p.namespace_packages THEN 1 ELSE 0 END"),
                 ("large_files", "p.large_files"), ("mixed_indentation", "p.mixed_indentation"), ("large_functions", "p.large_functions"),
                 ("patterns_in_comments", "p.patterns_in_comments"),
                 ("very_large_codebase", "CASE WHEN z.very_large_codebase THEN 1 ELSE 0 END"),
                 ("very_small_codebase", "CASE WHEN z.very_small_codebase THEN 1 ELSE 0 END"),
                 ("extreme_size_variation", "CASE WHEN z.extreme_size_variation THEN 1 ELSE 0 END")])
CTES["outlier_reports"] = """
SELECT p.repo, coalesce(count(t.outlier_type), 0) > 0 AS is_outlier, coalesce(string_agg(t.outlier_type, ',' ORDER BY t.outlier_type), '') AS outlier_types,
  least(coalesce(sum(t.n), 0) * CAST(0.2 AS DOUBLE), CAST(1.0 AS DOUBLE)) AS confidence,
  CASE WHEN count(t.outlier_type) = 0 THEN 'none'
   WHEN bool_or(t.outlier_type IN ('very_large_codebase', 'encoding_issues', 'git_submodules')) THEN 'critical'
   WHEN bool_or(t.outlier_type IN ('monorepo', 'large_files', 'large_functions', 'deep_nesting')) THEN 'high'
   WHEN bool_or(t.outlier_type IN ('mixed_indentation', 'unusual_file_types', 'patterns_in_comments')) THEN 'medium' ELSE 'low' END AS risk_level
FROM profile p LEFT JOIN (SELECT * FROM type_counts WHERE n > 0) t ON t.repo = p.repo GROUP BY p.repo"""
CTES["reasons"] = """
SELECT * FROM (SELECT k.doc_id, k.repo, k.path, concat_ws('; ', CASE WHEN len(a.arr) > 40 THEN 'Very large file (' || len(a.arr) || ' lines)' END,
  CASE WHEN x.is_mixed THEN 'Mixed indentation (tabs and spaces)' END,
  CASE WHEN k.parse_ok AND k.max_nesting > 0 THEN 'Deep nesting (' || k.max_nesting || ' levels)' END,
  CASE WHEN NOT k.parse_ok THEN 'Syntax errors detected' END) AS reasons
FROM file_facts k JOIN line_arrays a ON a.doc_id = k.doc_id JOIN mixed x ON x.doc_id = k.doc_id) WHERE reasons <> ''"""


def flags(spark, sf):
    return outliers.file_flags(corpus(spark, sf), LIMITS)


@query("structure_outliers", """
SELECT repo, python_project_count, max_depth, python_project_count > 1 AS monorepo, max_depth > 2 AS deep_nesting, generated_code, git_submodules, namespace_packages FROM profile""")
def _(spark, sf):
    return outliers.structure_outliers(outliers.path_flags(corpus(spark, sf), LIMITS), LIMITS)


@query("code_outliers", "SELECT repo, large_files, mixed_indentation, encoding_issues, large_functions, deep_nesting FROM profile")
def _(spark, sf):
    return outliers.code_outliers(flags(spark, sf))


@query("code_outlier_files", " UNION ALL ".join(f"SELECT repo, path, rel, '{t}' AS outlier_type FROM flags WHERE {t}" for t in outliers.CODE_TYPES))
def _(spark, sf):
    return outliers.outlier_files(flags(spark, sf))


@query("pattern_outliers", "SELECT repo, unusual_file_types, patterns_in_comments FROM profile")
def _(spark, sf):
    return outliers.pattern_outliers(flags(spark, sf))


@query("size_outliers", "SELECT repo, total_files, very_large_codebase, very_small_codebase, size_ratio, extreme_size_variation FROM sizes")
def _(spark, sf):
    return outliers.size_outliers(flags(spark, sf), LIMITS)


@query("outlier_report", "SELECT repo, is_outlier, outlier_types, confidence, risk_level FROM outlier_reports")
def _(spark, sf):
    return outliers.outlier_report(outliers.outlier_type_counts(flags(spark, sf), LIMITS))


@query("distinct_types", """
SELECT t.repo, t.outlier_type, t.n AS n_recorded, replace(a.risk, '{n}', CAST(CASE WHEN t.outlier_type = 'very_large_codebase' THEN t.total_files ELSE t.n END AS VARCHAR)) AS risk,
  a.recommendation FROM type_counts t JOIN profile p ON p.repo = t.repo
  LEFT JOIN advice a ON a.outlier_type = t.outlier_type AND (t.outlier_type <> 'deep_nesting' OR p.max_depth > 2) WHERE t.n > 0""")
def _(spark, sf):
    return outliers.distinct_types(outliers.outlier_type_counts(flags(spark, sf), LIMITS))


@query("file_outlier_reasons", "SELECT repo, path, reasons FROM reasons")
def _(spark, sf):
    return outliers.file_outlier_reasons(corpus(spark, sf), LIMITS).withColumn("reasons", F.array_join("reasons", "; "))


@query("outlier_policy", "SELECT repo, CASE WHEN is_outlier THEN 'cautious' ELSE 'proceed' END AS policy FROM outlier_reports")
def _(spark, sf):
    return outliers.repo_policy(outliers.outlier_report(outliers.outlier_type_counts(flags(spark, sf), LIMITS)), "cautious")


@query("sorted_files", "SELECT repo, path FROM files")
def _(spark, sf):
    return scans.sorted_files(corpus(spark, sf).select("repo", "path"))


@query("first_n_files", """
SELECT repo, path, CAST(rn AS INTEGER) AS file_rank, n_lines FROM (SELECT repo, path, len(arr) AS n_lines, row_number() OVER (PARTITION BY repo ORDER BY path) AS rn FROM line_arrays) WHERE rn <= 20""")
def _(spark, sf):
    files = corpus(spark, sf).select("repo", "path", text.line_count(F.col("content")).alias("n_lines"))
    return scans.first_n_files(files, 20)
