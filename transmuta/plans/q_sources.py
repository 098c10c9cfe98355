"""Queries over scans, catalogues and stores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from transmuta.functions import text
from transmuta.functions.materialize import shared_folder
from transmuta.operators import detect, metrics, reports, resolve, rewrite, tracker
from transmuta.plans.base import CTES, KNOWN_MODULES, RULES, corpus, query, values
from transmuta.sources import catalog, decision_log, derived, stores
from transmuta.sources import corpus as scans

_SKIPPED = "len(list_intersect(string_split(substring(path, length(repo) + 2), '/'), ['__pycache__', '.git', 'venv', 'env'])) > 0"
CTES["scanned"] = f"SELECT * FROM files WHERE NOT ({_SKIPPED}) AND ends_with(path, '.py')"


def _listed(files):
    return files.select("repo", "path", F.length("content").cast("long").alias("n_chars"))


@query("corpus_scan", "SELECT repo, path, length(content) AS n_chars, md5(content) AS digest FROM scanned")
def _(spark, sf):
    files = scans.select_files(corpus(spark, sf))
    return files.select("repo", "path", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("digest"))


@query("glob_scan", r"""
SELECT repo, path FROM files
WHERE ends_with(path, '.py') AND NOT regexp_matches(path, '(^|/)[^/]+/__pycache__/[^/]*$') AND NOT regexp_matches(path, '/generated/[^/]+$')
  AND NOT regexp_matches(path, '/venv/[^/]+$') AND NOT regexp_matches(path, '/e2e/test_[^/]*$')""")
def _(spark, sf):
    exclude = (*scans.DEFAULT_EXCLUDES, "**/generated/*", "**/venv/*", "e2e/test_*")
    return scans.glob_scan(corpus(spark, sf), "**/*.py", exclude).select("repo", "path")


@query("test_file_scan", r"""
SELECT repo, path, 'test_*.py' AS name_pattern FROM files WHERE regexp_matches(path, '(^|/)test_[^/]*\.py$')
UNION ALL SELECT repo, path, '*_1[0-9]?.py' FROM files WHERE regexp_matches(path, '(^|/)[^/]*_1[0-9][^/]\.py$')""")
def _(spark, sf):
    found = scans.test_file_scan(corpus(spark, sf), ("test_*.py", "*_1[0-9]?.py"), ordered=True)
    return found.select("repo", "path", "name_pattern")


@query("snapshot_manifest", r"""
SELECT repo, path, length(content) AS n_chars FROM files
WHERE len(list_intersect(string_split(path, '/'), ['.git','__pycache__','.pytest_cache','.mypy_cache','.DS_Store','node_modules','venv','env'])) = 0
  AND NOT regexp_matches(path, '\.(pyc|pyo)$')""")
def _(spark, sf):
    return _listed(scans.snapshot_manifest(corpus(spark, sf)))


@query("report_json", "SELECT repo, path, det_seq, id, type, module, class, confidence, source, line FROM detections")
def _(spark, sf):
    return stores.parse_documents(stores.report_documents(detect.with_detections(corpus(spark, sf))))


CTES["decision_writes"] = """
SELECT r.id AS pattern_id, w.write_id, w.last_updated, w.decision, w.notes, w.min_confidence
FROM decision_writes_raw w JOIN rules r ON r.rule_ord = w.rule_ord"""


def decision_writes(spark, sf):
    """Decision writes with the id of the rule they are about; ids come from a constant list, not a join."""
    ids = F.array(*[F.lit(r.id) for r in RULES])
    raw = derived.decision_writes(spark, sf)
    return raw.withColumn("pattern_id", F.get(ids, F.col("rule_ord").cast("int"))).drop("rule_ord")


CTES["decisions"] = """
SELECT pattern_id, max_by(decision, (last_updated, write_id)) AS decision, max_by(notes, (last_updated, write_id)) FILTER (notes IS NOT NULL) AS notes,
  max_by(min_confidence, (last_updated, write_id)) FILTER (min_confidence IS NOT NULL) AS min_confidence,
  max(last_updated) AS last_updated, count(*) AS n_writes FROM decision_writes GROUP BY pattern_id"""


@query("decision_store", "SELECT * FROM decisions")
def _(spark, sf):
    return stores.decision_state(decision_writes(spark, sf))


@query("decision_log", "SELECT * FROM decisions")
def _(spark, sf):
    """The same store kept by three writers, with a compaction before the third has written."""
    path, writes = f"{shared_folder(spark)}/decisions-{uuid.uuid4().hex}", decision_writes(spark, sf)
    for n in range(3):
        decision_log.append(writes.filter(F.col("write_id") % 3 == n), path)
        if n == 1:
            decision_log.compact(spark, path)
    return decision_log.decisions(spark, path)


@query("latest_decision", """
SELECT pattern_id, write_id, last_updated, decision, notes, min_confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY last_updated DESC, write_id DESC) AS rn FROM decision_writes) WHERE rn = 1""")
def _(spark, sf):
    return stores.latest_decision(decision_writes(spark, sf))


@query("rule_catalog", """
SELECT r.rule_ord, r.key, r.id, r.pattern, r.replacement, r.confidence, r.type, r.framework, r.description, r.source, r.guide_url,
  coalesce(h.n, 0) AS files_matched FROM rules r LEFT JOIN (SELECT id, count(*) AS n FROM rule_hits GROUP BY id) h ON h.id = r.id""")
def _(spark, sf):
    hits = detect.regex_rule_scan(corpus(spark, sf), RULES).groupBy("id").agg(F.count("*").alias("files_matched"))
    return RULES.table(spark).join(hits, "id", "left").na.fill(0, ["files_matched"])


@query("rule_listing", """
SELECT r.id, r.confidence, r.source, r.description, d.decision, coalesce(d.n_writes, 0) AS n_writes
FROM rules r LEFT JOIN decisions d ON d.pattern_id = r.id""")
def _(spark, sf):
    state = stores.decision_state(decision_writes(spark, sf)).select(F.col("pattern_id").alias("id"), "decision", "n_writes")
    rules = RULES.table(spark).select("id", "confidence", "source", "description")
    return rules.join(state, "id", "left").na.fill(0, ["n_writes"])


@query("guide_dims", """
SELECT d.kind, d.framework, d.name, d.value, CASE WHEN d.framework IS NULL THEN NULL ELSE coalesce(n.n, 0) END AS n_detections FROM ("""
       + values([("guide", f, t, u) for f, u, _, t in catalog.GUIDES]
                + [("mapping", f, m, f"{a} -> {b}") for f, m, a, b, _ in catalog.MAPPINGS]
                + [("best_practice", None, str(i), p) for i, p in enumerate(catalog.BEST_PRACTICES, 1)]
                + [("url", None, n, u) for n, u in catalog.REFERENCE_URLS], "kind, framework, name, value")
       + """) d LEFT JOIN (SELECT CASE WHEN contains(lower(id), 'semantic_kernel') THEN 'semantic_kernel' ELSE 'autogen' END AS framework, count(*) AS n
  FROM detections GROUP BY 1) n ON n.framework = d.framework""")
def _(spark, sf):
    found = detect.enrich_guidance(detect.discover(corpus(spark, sf))).groupBy("framework").agg(F.count("*").alias("n"))
    dims = catalog.guide_dimension(spark).join(found, "framework", "left")
    return dims.withColumn("n_detections", F.when(F.col("framework").isNotNull(), F.coalesce("n", F.lit(0)))).drop("n")


@query("repo_catalog", """
SELECT r.name, r.url, r.type, r.language, CAST(r.tier AS INTEGER) AS tier, r.description, r.priority, coalesce(t.n, 0) AS n_tasks FROM ("""
       + values([(i, n, f"https://github.com/{n}.git", k, "python", t, d, p) for i, (n, k, t, d, p) in enumerate(catalog.REPO_VALUES)],
                "repo_ord, name, url, type, language, tier, description, priority")
       + """) r LEFT JOIN (SELECT repo, count(*) AS n FROM repo_tasks GROUP BY repo) t ON t.repo = 'repo_' || r.repo_ord WHERE r.priority = 'first_pass'""")
def _(spark, sf):
    tasks = derived.repo_tasks(spark, sf).groupBy("repo").agg(F.count("*").alias("n"))
    repos = catalog.repositories(spark, "first_pass").withColumn("repo", F.concat(F.lit("repo_"), F.col("repo_ord")))
    return repos.join(tasks, "repo", "left").withColumn("n_tasks", F.coalesce("n", F.lit(0))).drop("n", "repo", "repo_ord")


def raw_files(spark, sf):
    """The derived corpus as bytes; every seventh length or so ends in a byte that is not UTF-8."""
    broken = F.length("content") % 7 == 3
    raw = F.when(broken, F.unhex(F.concat(F.hex(F.encode("content", "UTF-8")), F.lit("E9")))).otherwise(F.encode("content", "UTF-8"))
    return corpus(spark, sf).select("repo", "path", raw.alias("raw"))


@query("decode_with_fallback", """
SELECT repo, path, CASE WHEN broken THEN 'latin-1' ELSE 'utf-8' END AS encoding,
  CASE WHEN broken THEN octet_length(encode(content)) + 1 ELSE length(content) END AS n_chars FROM raw_files""")
def _(spark, sf):
    files = raw_files(spark, sf)
    return files.select("repo", "path", F.when(text.utf8_valid(F.col("raw")), "utf-8").otherwise("latin-1").alias("encoding"),
                        F.length(text.decode_with_fallback(F.col("raw"))).cast("long").alias("n_chars"))


@query("utf8_validity", "SELECT repo, path, NOT broken AS is_utf8 FROM raw_files")
def _(spark, sf):
    return raw_files(spark, sf).select("repo", "path", text.utf8_valid(F.col("raw")).alias("is_utf8"))


@query("failure_policy", """
SELECT repo, path, 'content is not valid UTF-8' AS error, CAST(NULL AS VARCHAR) AS pattern_id, TRUE AS requires_manual_review, FALSE AS auto_retry
FROM raw_files WHERE broken""")
def _(spark, sf):
    files = raw_files(spark, sf).withColumn("content", F.try_validate_utf8(F.col("raw").cast("string")))
    return rewrite.split_failures(files)[1]


@query("relevant_rules", "SELECT rule_ord, id, type, confidence FROM rules WHERE id IN (SELECT id FROM report_rows)")
def _(spark, sf):
    found = detect.rule_detections(corpus(spark, sf), RULES)
    return catalog.relevant_rules(RULES.table(spark), found).select("rule_ord", "id", "type", "confidence")


CTES["previous_plan"] = values([("SK_IMPORT_KERNEL", "old", "old", "old", "kept only if not detected again", "none", 0),
                                ("LEGACY_RULE", "import", "low", "other", "from an earlier plan", "none", 0)],
                               "pattern_id, type, confidence, framework, description, last_path, n_detections")
CTES["plan"] = """
SELECT r.id AS pattern_id, r.type, r.confidence, r.framework, r.description, d.last_path, d.n_detections
FROM (SELECT id, max_by(path, (repo, path, det_seq)) AS last_path, count(*) AS n_detections FROM report_rows GROUP BY id) d JOIN rules r ON r.id = d.id"""


def _plan(spark, sf):
    return resolve.codemod_plan(detect.rule_detections(corpus(spark, sf), RULES), RULES.table(spark))


@query("codemod_plan", "SELECT * FROM plan")
def _(spark, sf):
    return _plan(spark, sf)


@query("merge_plans", """
SELECT pattern_id, type, confidence, framework, description, last_path, CAST(n_detections AS BIGINT) AS n_detections FROM previous_plan
WHERE pattern_id NOT IN (SELECT pattern_id FROM plan) UNION ALL SELECT * FROM plan""")
def _(spark, sf):
    old = spark.createDataFrame(
        [("SK_IMPORT_KERNEL", "old", "old", "old", "kept only if not detected again", "none", 0),
         ("LEGACY_RULE", "import", "low", "other", "from an earlier plan", "none", 0)],
        "pattern_id string, type string, confidence string, framework string, description string, last_path string, n_detections long")
    return resolve.merge_plans(old, _plan(spark, sf))


@query("custom_rules", r"""
SELECT page_id, 'USER_LINK' AS id FROM pages WHERE regexp_matches(html, '<a\s+href=')
UNION ALL SELECT page_id, 'USER_HEADING' FROM pages WHERE regexp_matches(html, '<h[1-3][^>]*>')
UNION ALL SELECT page_id, 'USER_SCRIPT' FROM pages WHERE regexp_matches(html, '<script')
UNION ALL SELECT p.page_id, r.id FROM pages p JOIN rules r ON regexp_matches(p.html, r.pattern)""")
def _(spark, sf):
    custom = [{"id": "USER_LINK", "pattern": r"<a\s+href=", "replacement": "<a data-href="},
              {"id": "USER_HEADING", "pattern": r"<h[1-3][^>]*>", "replacement": "<h4>"},
              {"id": "USER_SCRIPT", "pattern": r"<script", "replacement": "<!--script"}]
    pages = derived.table(spark, sf, "pages").select("page_id", "html")
    return detect.regex_rule_scan(pages, RULES.plus(custom), "html", ("page_id",)).select("page_id", "id")


@query("metrics_json", """
SELECT repo, files_analyzed, files_transformed, files_with_syntax_errors, files_with_import_errors, patterns_detected, patterns_transformed,
  CASE WHEN files_analyzed = 0 THEN 0.0 ELSE files_transformed / files_analyzed * 100 END AS transformation_rate FROM metric_counts""")
def _(spark, sf):
    rates = metrics.metric_rates(metrics.metric_counts(corpus(spark, sf), RULES, KNOWN_MODULES))
    back = metrics.metric_rates(metrics.from_json(metrics.to_json(rates)))
    return back.select("repo", "files_analyzed", "files_transformed", "files_with_syntax_errors", "files_with_import_errors",
                       "patterns_detected", "patterns_transformed", "transformation_rate")


@query("task_result_sink", """
SELECT task_id, status, unit_passed AS unit_passed, len(met) AS n_met FROM outcomes""")
def _(spark, sf):
    docs = tracker.task_documents(tracker.task_outcome(tracker.task_state(derived.task_events(spark, sf))))
    parsed = docs.select("task_id", F.from_json("document", "status string, unit struct<run:boolean, passed:long, failed:long>, "
                                                            "acceptance_criteria struct<met:array<string>>").alias("d"))
    return parsed.select("task_id", "d.status", F.col("d.unit.passed").alias("unit_passed"),
                         F.size("d.acceptance_criteria.met").cast("long").alias("n_met"))


@query("markdown_lines", """
WITH s AS (SELECT f.repo, count(*) AS n_files, coalesce(sum(d.n), 0) AS n_det FROM files f
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM detections GROUP BY doc_id) d ON d.doc_id = f.doc_id GROUP BY f.repo)
SELECT repo, section, at_path, at_seq, line FROM (
  SELECT repo, 0 AS section, '' AS at_path, 0 AS at_seq, '# Migration Report' AS line FROM s
  UNION ALL SELECT repo, 1, '', 0, '' FROM s UNION ALL SELECT repo, 2, '', 0, '## Statistics' FROM s
  UNION ALL SELECT repo, 3, '', 0, '- Total files: ' || n_files FROM s
  UNION ALL SELECT repo, 4, '', 0, '- Patterns detected: ' || n_det FROM s
  UNION ALL SELECT repo, 5, '', 0, '' FROM s UNION ALL SELECT repo, 6, '', 0, '## Detected Patterns' FROM s
  UNION ALL SELECT repo, 7, path, det_seq * 2, '- **' || id || '**: ' || type FROM detections
  UNION ALL SELECT repo, 7, path, det_seq * 2 + 1, '  - File: `' || path || '`' FROM detections)""")
def _(spark, sf):
    return reports.report_lines(detect.with_detections(corpus(spark, sf)))
