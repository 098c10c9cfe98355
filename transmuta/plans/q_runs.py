"""Queries over validation, metrics and the mapping checks of a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from transmuta.operators import detect, mapping, metrics, rewrite, validate
from transmuta.plans.base import CTES, KNOWN_MODULES, RULES, corpus, known, query, values
from transmuta.plans.q_detect import report_files
from transmuta.plans.q_sources import raw_files

import sys

CTES["validation"] = """
SELECT f.repo, count(*) AS total_files, count(*) - count(*) FILTER (i.errors > 0) AS valid_files, count(*) FILTER (i.errors > 0) AS invalid_files,
  CAST(coalesce(sum(i.errors), 0) AS BIGINT) AS total_errors, CAST(coalesce(sum(i.warnings), 0) AS BIGINT) AS total_warnings, CAST(0 AS BIGINT) AS total_info,
  count(*) FILTER (i.errors > 0) AS syntax_files, count(*) FILTER (i.warnings > 0) AS import_files
FROM files f LEFT JOIN (SELECT path, count(*) FILTER (level = 'error') AS errors, count(*) FILTER (level = 'warning') AS warnings FROM issues GROUP BY path) i ON i.path = f.path
GROUP BY f.repo"""


@query("validation_summary", """
SELECT repo, total_files, valid_files, invalid_files, valid_files / total_files * 100 AS success_rate, total_errors, total_warnings, total_info FROM validation""")
def _(spark, sf):
    files = corpus(spark, sf)
    return validate.validation_summary(validate.validate(files, known(spark)), files)


@query("metrics_from_validation", """
SELECT repo, total_files AS files_analyzed, total_files AS files_transformed, syntax_files AS files_with_syntax_errors,
  CAST(0 AS BIGINT) AS files_with_import_errors, import_files AS files_with_import_issues FROM validation""")
def _(spark, sf):
    files = corpus(spark, sf)
    return validate.metrics_from_validation(validate.validate(files, known(spark)), files)


@query("all_issues", """
SELECT repo, path, level, line_no, col_no, error_type, message, context, CAST(CASE level WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END AS INTEGER) AS level_rank FROM issues""")
def _(spark, sf):
    return validate.all_issues(validate.validate(corpus(spark, sf), known(spark)))


CTES["known_names"] = values([(m,) for m in [*KNOWN_MODULES, *sys.builtin_module_names]], "module")


@query("builtin_or_known", """
SELECT DISTINCT k.module, coalesce(n.n, 0) AS n_imports FROM known_names k
LEFT JOIN (SELECT string_split(module, '.')[1] AS top_module, count(*) AS n FROM import_rows GROUP BY 1) n ON n.top_module = k.module""")
def _(spark, sf):
    from transmuta.functions.facts import code_facts, imports

    used = imports(code_facts(corpus(spark, sf))).groupBy(F.substring_index("module", ".", 1).alias("module")).agg(F.count("*").alias("n_imports"))
    return validate.builtin_or_known(spark, known(spark)).join(used, "module", "left").na.fill(0, ["n_imports"])


CTES["metric_counts"] = """
SELECT f.repo, count(*) AS total_files, count(*) AS files_analyzed, count(*) FILTER (w.changed) AS files_transformed, count(*) FILTER (NOT p.parse_ok) AS files_with_syntax_errors,
  count(*) FILTER (u.n > 0) AS files_with_import_errors, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS patterns_detected, CAST(sum(len(w.applied)) AS BIGINT) AS patterns_transformed
FROM files f JOIN parsed p ON p.doc_id = f.doc_id JOIN rewritten w ON w.doc_id = f.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM unknown_rows GROUP BY doc_id) u ON u.doc_id = f.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM detections GROUP BY doc_id) d ON d.doc_id = f.doc_id GROUP BY f.repo"""


def _pct(part, whole):
    return f"CASE WHEN {whole} = 0 THEN 0.0 ELSE {part} / {whole} * 100 END"


CTES["rates"] = f"""
SELECT repo, files_analyzed, files_transformed, {_pct('files_transformed', 'files_analyzed')} AS transformation_rate,
  {_pct('files_with_syntax_errors', 'files_transformed')} AS syntax_error_rate, {_pct('files_with_import_errors', 'files_transformed')} AS import_error_rate,
  {_pct('patterns_transformed', 'patterns_detected')} AS pattern_transformation_rate,
  {_pct('(files_transformed - files_with_syntax_errors - files_with_import_errors)', 'files_transformed')} AS success_rate FROM metric_counts"""


@query("metric_rates", "SELECT * FROM rates")
def _(spark, sf):
    rates = metrics.metric_rates(metrics.metric_counts(corpus(spark, sf), RULES, KNOWN_MODULES))
    return rates.select("repo", "files_analyzed", "files_transformed", *metrics.RATES)


@query("success_criteria", """
SELECT repo, transformation_rate >= 75 AS meets_transformation_rate, syntax_error_rate <= 5 AS meets_syntax_error_rate, import_error_rate <= 10 AS meets_import_error_rate,
  transformation_rate >= 75 AND syntax_error_rate <= 5 AND import_error_rate <= 10 AS meets_all FROM rates""")
def _(spark, sf):
    rates = metrics.metric_rates(metrics.metric_counts(corpus(spark, sf), RULES, KNOWN_MODULES))
    return metrics.success_criteria(rates).select("repo", "meets_transformation_rate", "meets_syntax_error_rate", "meets_import_error_rate", "meets_all")


CTES["membership"] = """
SELECT d.repo, d.path, d.det_seq, d.id, coalesce(d.module, 'unknown') AS module, d.rule_id,
  coalesce(list_contains(a.ids, d.id), FALSE) AS applied, coalesce(list_contains(a.ids, d.rule_id), FALSE) AS rule_applied, w.changed AS file_transformed
FROM resolved_report d JOIN rewritten_report w ON w.doc_id = d.doc_id
LEFT JOIN (SELECT repo, list(DISTINCT id) AS ids FROM (SELECT repo, unnest(applied) AS id FROM rewritten_report) GROUP BY repo) a ON a.repo = d.repo
WHERE d.confidence = 'high' AND d.source = 'rule'"""
CTES["mapping"] = """
SELECT repo, id, max_by(applied, (path, det_seq)) AS applied, max_by(rule_applied, (path, det_seq)) AS rule_applied, max_by(file_transformed, (path, det_seq)) AS file_transformed,
  max_by(path, (path, det_seq)) AS path, max_by(module, (path, det_seq)) AS module, count(*) AS n_detections, count(*) FILTER (NOT applied AND NOT file_transformed) AS n_failed,
  count(*) FILTER (NOT applied AND NOT file_transformed) = 0 AS mapping_complete FROM membership GROUP BY repo, id"""
CTES["outputs"] = r"""
SELECT repo, path, det_seq, pattern_id, module, rule_id, in_before, in_after, new_in_after, expected_replacement,
  CASE WHEN rule_id IS NULL THEN 'error' WHEN in_before AND in_after AND new_in_after THEN 'partial' WHEN in_before AND new_in_after THEN 'success' WHEN in_before THEN 'failed'
   WHEN new_in_after THEN 'success' ELSE 'not_found_in_original' END AS status,
  CASE WHEN rule_id IS NULL THEN 'Pattern definition not found' WHEN in_before AND NOT in_after AND NOT new_in_after THEN 'Pattern removed but replacement not found'
   WHEN in_before AND in_after AND NOT new_in_after THEN 'Pattern still present but replacement not found'
   WHEN NOT in_before AND NOT new_in_after THEN 'Pattern detected but not found in original file' END AS error
FROM (SELECT d.repo, d.path, d.det_seq, d.id AS pattern_id, d.module, r.id AS rule_id, regexp_matches(w.content, r.pattern) AS in_before, regexp_matches(w.new_content, r.pattern) AS in_after,
    contains(w.new_content, replace(r.replacement, '{name}', regexp_extract(w.content, 'class (\w+)\(', 1))) AS new_in_after,
    replace(r.replacement, '{name}', regexp_extract(w.content, 'class (\w+)\(', 1)) AS expected_replacement
  FROM report_rows d JOIN rewritten_report w ON w.doc_id = d.doc_id AND w.changed
  LEFT JOIN rules r ON r.id <> 'SK_IMPORT_' AND (r.id = d.id OR r.key = CASE
    WHEN starts_with(d.module, 'semantic_kernel') AND contains(d.module, 'plugins') THEN 'sk_import_plugins'
    WHEN starts_with(d.module, 'semantic_kernel') AND contains(d.module, 'functions') THEN 'sk_import_functions' END)
  WHERE d.confidence = 'high' AND d.source = 'rule')"""


def done(spark, sf):
    return rewrite.rewrite(report_files(spark, sf), RULES)


@query("application_membership", "SELECT * FROM membership")
def _(spark, sf):
    return mapping.application_membership(mapping.run_table(done(spark, sf)))


@query("application_mapping", "SELECT * FROM mapping")
def _(spark, sf):
    return mapping.application_mapping(mapping.application_membership(mapping.run_table(done(spark, sf))))


@query("last_wins", "SELECT repo, id, path, module FROM mapping")
def _(spark, sf):
    rows = detect.high_confidence(detect.explode_detections(report_files(spark, sf)))
    last = rows.groupBy("repo", "id").agg(F.max_by(F.struct("path", "module"), F.struct("path", "det_seq")).alias("v"))
    return last.select("repo", "id", "v.path", F.coalesce("v.module", F.lit("unknown")).alias("module"))


@query("output_mapping", "SELECT * FROM outputs")
def _(spark, sf):
    return mapping.output_mapping(done(spark, sf), RULES)


@query("combined_failures", """
SELECT repo, path, id AS pattern_id, module, 'Pattern detected but not applied and file not transformed' AS reason, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS error
FROM membership WHERE NOT applied AND NOT file_transformed
UNION ALL SELECT repo, path, pattern_id, module, NULL, status, error FROM outputs WHERE status = 'failed'""")
def _(spark, sf):
    run = mapping.run_table(done(spark, sf), RULES)
    return mapping.combined_failures(mapping.application_membership(run), mapping.output_rows(run))


@query("mapping_report", """
SELECT t.repo, t.patterns_detected, CAST(coalesce(m.n, 0) AS BIGINT) AS high_confidence_patterns, t.patterns_applied, t.files_transformed,
  CASE WHEN m.ids > 0 THEN t.patterns_applied / m.ids ELSE 0.0 END AS pattern_application_rate, CASE WHEN o.n > 0 THEN o.ok / o.n ELSE 0.0 END AS transformation_success_rate,
  coalesce(o.ok, 0) AS successful_outputs, CAST(coalesce(m.bad, 0) + coalesce(o.bad, 0) AS BIGINT) AS n_failures, coalesce(m.bad, 0) = 0 AND coalesce(o.bad, 0) = 0 AS mapping_complete
FROM (SELECT w.repo, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS patterns_detected, CAST(sum(len(w.applied)) AS BIGINT) AS patterns_applied, count(*) FILTER (w.changed) AS files_transformed
  FROM rewritten_report w LEFT JOIN (SELECT doc_id, count(*) AS n FROM report_rows GROUP BY doc_id) d ON d.doc_id = w.doc_id GROUP BY w.repo) t
LEFT JOIN (SELECT repo, count(*) AS ids, sum(n_detections) AS n, sum(n_failed) AS bad FROM mapping GROUP BY repo) m ON m.repo = t.repo
LEFT JOIN (SELECT repo, count(*) AS n, count(*) FILTER (status = 'success') AS ok, count(*) FILTER (status = 'failed') AS bad FROM outputs GROUP BY repo) o ON o.repo = t.repo""")
def _(spark, sf):
    return mapping.mapping_report(done(spark, sf), RULES)


CTES["raw_failed"] = "SELECT repo, path FROM raw_files WHERE broken"


@query("checkpoint", """
SELECT f.repo, count(*) FILTER (NOT f.broken AND w.changed) AS updated_files, count(*) FILTER (f.broken) AS failed_files,
  CAST(coalesce(sum(CASE WHEN NOT f.broken THEN len(w.applied) END), 0) AS BIGINT) AS patterns_applied, count(*) FILTER (f.broken OR w.changed) AS total_files
FROM raw_files f JOIN rewritten w ON w.doc_id = f.doc_id GROUP BY f.repo""")
def _(spark, sf):
    files = raw_files(spark, sf).withColumn("content", F.try_validate_utf8(F.col("raw").cast("string"))).drop("raw")
    good, failed = rewrite.split_failures(files)
    return mapping.checkpoint_counts(rewrite.migrate(good, RULES), failed)


@query("run_status", """
SELECT w.repo, CAST(coalesce(sum(d.n), 0) AS BIGINT) AS high_confidence, count(*) FILTER (w.changed) AS changed_files,
  CASE WHEN coalesce(sum(d.n), 0) = 0 OR count(*) FILTER (w.changed) = 0 THEN 'failed' ELSE 'completed' END AS status
FROM rewritten w LEFT JOIN (SELECT doc_id, count(*) AS n FROM detections WHERE confidence = 'high' GROUP BY doc_id) d ON d.doc_id = w.doc_id GROUP BY w.repo""")
def _(spark, sf):
    return mapping.run_status(rewrite.migrate(corpus(spark, sf), RULES))
