"""Queries over test-file lints."""

from __future__ import annotations

from pyspark.sql import functions as F

from transmuta.operators import lint
from transmuta.plans.base import CTES, corpus, query, values

CTES["weak_patterns"] = values(lint.WEAK_PATTERNS, "pattern, description")
CTES["weak_fixes"] = values([(p, f, r) for p, f, r in lint.WEAK_FIXES], "pattern, fix, rationale")
CTES["test_lines"] = r"""
SELECT *, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS s FROM (SELECT doc_id, repo, path, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line_no,
  unnest(string_split(content, chr(10))) AS raw FROM files WHERE regexp_matches(path, '(^|/)test_[^/]*\.py$'))"""
CTES["windows"] = """
SELECT a.repo, a.path, a.line_no, a.s AS head, string_agg(b.raw, chr(10) ORDER BY b.line_no) AS body FROM test_lines a
JOIN test_lines b ON b.doc_id = a.doc_id AND b.line_no BETWEEN a.line_no AND a.line_no + 49 WHERE starts_with(a.s, 'def test_') GROUP BY a.repo, a.path, a.line_no, a.s"""
CTES["block_ends"] = r"""
SELECT a.doc_id, a.repo, a.path, a.line_no, a.s AS head, coalesce(min(b.line_no), 1000000000) AS next_no FROM test_lines a
LEFT JOIN test_lines b ON b.doc_id = a.doc_id AND b.line_no > a.line_no AND b.s <> '' AND NOT starts_with(b.raw, repeat(' ', length(a.raw) - length(regexp_replace(a.raw, '^\s+', '')) + 1))
WHERE starts_with(a.s, 'def test_') GROUP BY a.doc_id, a.repo, a.path, a.line_no, a.s"""
CTES["blocks"] = """
SELECT e.repo, e.path, e.line_no, e.head, string_agg(b.raw, chr(10) ORDER BY b.line_no) AS body FROM block_ends e
JOIN test_lines b ON b.doc_id = e.doc_id AND b.line_no >= e.line_no AND b.line_no < e.next_no GROUP BY e.repo, e.path, e.line_no, e.head"""


def _any(col, words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


CTES["weak_rows"] = """
SELECT repo, path, CAST(line_no AS INTEGER) AS line_no, 'weak_assertions' AS category, 'weak_assertion' AS issue_type, 'critical' AS severity, description, s AS current_code
FROM test_lines JOIN weak_patterns ON regexp_matches(s, pattern) WHERE s <> '' AND NOT starts_with(s, '#')"""
CTES["weak_fix_rows"] = """
SELECT repo, path, CAST(line_no AS INTEGER) AS line_no, 'weak_assertions' AS category, 'weak_assertion_pattern' AS issue_type, 'critical' AS severity,
  'Weak assertion that may not verify actual functionality' AS description, s AS current_code, replace(fix, '{g}', regexp_extract(s, pattern, 1)) AS suggested_fix, rationale
FROM test_lines JOIN weak_fixes ON regexp_matches(s, pattern) WHERE s <> '' AND NOT starts_with(s, '#')"""
CTES["message_rows"] = r"""
SELECT repo, path, CAST(line_no AS INTEGER) AS line_no, 'missing_error_messages' AS category, 'missing_error_message' AS issue_type, 'warning' AS severity,
  'Assertion missing error message' AS description, s AS current_code, s || ', "Add descriptive error message"' AS suggested_fix
FROM test_lines WHERE starts_with(s, 'assert ') AND NOT contains(s, ',') AND NOT regexp_matches(s, 'assert\s+\w+\s*$')"""
CTES["real_world_rows"] = f"""
SELECT repo, path, CAST(0 AS INTEGER) AS line_no, 'missing_real_world' AS category, 'no_real_world_tests' AS issue_type, 'critical' AS severity,
  CASE WHEN contains(path, 'e2e') THEN 'E2E' ELSE 'Integration' END || ' test file missing real-world tests' AS description, 'N/A' AS current_code
FROM files WHERE regexp_matches(path, '(^|/)test_[^/]*\\.py$') AND (contains(path, 'e2e') OR contains(path, 'integration')) AND NOT {_any('lower(content)', lint.REAL_WORLD)}"""
CTES["unvalidated_rows"] = """
SELECT repo, path, line_no, category, 'missing_real_world' AS issue_type, severity, 'E2E/Integration test missing real-world validation' AS description,
  CAST(NULL AS VARCHAR) AS current_code FROM real_world_rows"""
CTES["window_rows"] = rf"""
SELECT repo, path, CAST(line_no AS INTEGER) AS line_no, 'missing_outcome_verification' AS category, 'missing_outcome_verification' AS issue_type, 'warning' AS severity,
  'Test ' || head || ' may not verify actual outcomes' AS description, head AS current_code
FROM windows WHERE contains(body, 'assert') AND NOT ({_any('lower(body)', lint.WINDOW_WORDS)} OR regexp_matches(body, 'assert.*>\s*0') OR regexp_matches(body, 'assert.*in\s+'))"""
CTES["block_rows"] = f"""
SELECT repo, path, CAST(line_no AS INTEGER) AS line_no, 'missing_outcome_verification' AS category, 'no_outcome_verification' AS issue_type, 'warning' AS severity,
  'Test may not verify actual outcomes' AS description, head AS current_code FROM blocks WHERE contains(body, 'assert') AND NOT {_any('lower(body)', lint.OUTCOME_WORDS)}"""
CTES["empty_rows"] = r"""
SELECT a.repo, a.path, CAST(a.line_no AS INTEGER) AS line_no, 'poor_test_structure' AS category, 'empty_test' AS issue_type, 'critical' AS severity, 'Empty test function' AS description,
  'def ' || regexp_extract(a.s, 'def (test_\w+)', 1) || '():' || chr(10) || '    pass' AS current_code
FROM test_lines a JOIN test_lines b ON b.doc_id = a.doc_id AND b.line_no = a.line_no + 1 AND b.s = 'pass' WHERE starts_with(a.s, 'def test_')"""
_SHORT = "repo, path, line_no, category, issue_type, severity, description, current_code"
CTES["audit_rows"] = " UNION ALL ".join(f"SELECT {_SHORT} FROM {t}" for t in ("weak_fix_rows", "message_rows", "real_world_rows", "block_rows", "empty_rows"))
CTES["monitor_rows"] = " UNION ALL ".join(f"SELECT {_SHORT} FROM {t}" for t in ("weak_rows", "unvalidated_rows", "window_rows"))
_COLS = [c.strip() for c in _SHORT.split(",")]


@query("forward_frame_check", "SELECT repo, path, line_no, description FROM window_rows")
def _(spark, sf):
    return lint.issues(corpus(spark, sf), lint.window_issues()).select("repo", "path", "line_no", "description")


@query("function_blocks", "SELECT repo, path, CAST(line_no AS INTEGER) AS n, head, md5(body) AS digest FROM blocks")
def _(spark, sf):
    return lint.function_blocks(corpus(spark, sf)).select("repo", "path", "n", "head", F.md5("body").alias("digest"))


@query("weak_assertions", f"SELECT {_SHORT} FROM weak_rows")
def _(spark, sf):
    return lint.issues(corpus(spark, sf), lint.weak_issues()).select(*_COLS)


@query("weak_assertions_fix", f"SELECT {_SHORT}, suggested_fix, rationale FROM weak_fix_rows")
def _(spark, sf):
    return lint.issues(corpus(spark, sf), lint.weak_fix_issues()).select(*_COLS, "suggested_fix", "rationale")


@query("missing_messages", f"SELECT {_SHORT}, suggested_fix FROM message_rows")
def _(spark, sf):
    return lint.issues(corpus(spark, sf), lint.missing_message_issues()).select(*_COLS, "suggested_fix")


@query("missing_real_world", f"SELECT {_SHORT} FROM real_world_rows")
def _(spark, sf):
    return lint.issues(corpus(spark, sf), lint.real_world_issues()).select(*_COLS)


@query("missing_outcomes", f"SELECT {_SHORT} FROM block_rows UNION ALL SELECT {_SHORT} FROM window_rows")
def _(spark, sf):
    return lint.issues(corpus(spark, sf), lint.block_issues(), lint.window_issues()).select(*_COLS)


@query("empty_tests", f"SELECT {_SHORT} FROM empty_rows")
def _(spark, sf):
    return lint.issues(corpus(spark, sf), lint.empty_test_issues(), parse=True).select(*_COLS)


@query("assertion_stats", r"""
SELECT repo, count(DISTINCT doc_id) AS total_files, count(*) FILTER (starts_with(raw, 'def test_') AND parse_ok) AS total_tests,
  count(*) FILTER (starts_with(s, 'assert ') AND parse_ok) AS tree_assertions, count(*) FILTER (contains(s, 'assert') AND NOT starts_with(s, '#')) AS line_assertions
FROM (SELECT t.*, p.parse_ok FROM test_lines t JOIN parsed p ON p.doc_id = t.doc_id) GROUP BY repo""")
def _(spark, sf):
    return lint.assertion_stats(corpus(spark, sf))


@query("issue_counts", """
SELECT r.repo, 'category' AS grouping, c.name, count(a.category) AS n FROM (SELECT DISTINCT repo FROM audit_rows) r CROSS JOIN (VALUES """ + ", ".join(f"('{c}')" for c in lint.CATEGORIES) + """) c(name)
LEFT JOIN audit_rows a ON a.category = c.name AND a.repo = r.repo GROUP BY r.repo, c.name
UNION ALL SELECT repo, 'severity', severity, count(*) FROM audit_rows GROUP BY repo, severity""")
def _(spark, sf):
    return lint.issue_counts(lint.audit(corpus(spark, sf)))


def _topk_sql(rows: str, critical: int, warning: int, by: str) -> str:
    return f"""
SELECT repo, path, line_no, category, severity, description, rank, n_group, greatest(n_group - k, 0) AS n_more FROM (
  SELECT *, CASE severity WHEN 'critical' THEN {critical} ELSE {warning} END AS k,
   CAST(row_number() OVER (PARTITION BY {by} ORDER BY path, line_no, description, current_code NULLS FIRST) AS INTEGER) AS rank,
   count(*) OVER (PARTITION BY {by}) AS n_group FROM {rows}) WHERE rank <= k"""


_TOP = ("repo", "path", "line_no", "category", "severity", "description", "rank", "n_group", "n_more")


@query("topk_issues", _topk_sql("audit_rows", 10, 5, "repo, category, severity"))
def _(spark, sf):
    return lint.topk_issues(lint.audit(corpus(spark, sf)), {"critical": 10, "warning": 5}).select(*_TOP)


@query("topk_monitor_issues", _topk_sql("monitor_rows", 20, 10, "repo, severity"))
def _(spark, sf):
    return lint.topk_issues(lint.monitor(corpus(spark, sf)), {"critical": 20, "warning": 10}, ("repo", "severity")).select(*_TOP)


@query("monitor", f"SELECT {_SHORT} FROM monitor_rows")
def _(spark, sf):
    return lint.monitor(corpus(spark, sf)).select(*_COLS)


@query("quality_verdict", """
SELECT repo, critical, warnings, CASE WHEN critical > 0 THEN 'FAIL' WHEN warnings > 0 THEN 'WARN' ELSE 'PASS' END AS verdict
FROM (SELECT f.repo, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warnings
  FROM (SELECT DISTINCT repo FROM files) f LEFT JOIN monitor_rows m ON m.repo = f.repo GROUP BY f.repo)""")
def _(spark, sf):
    files = corpus(spark, sf)
    return lint.quality_verdict(lint.monitor(files), files)


@query("test_inventory", r"""
WITH c AS (SELECT repo, path AS file, regexp_extract(path, '/tests/([^/]+)/', 1) AS category, len(regexp_extract_all(content, 'def test_\w+')) AS n FROM files
  WHERE regexp_matches(path, '(^|/)test_[^/]*\.py$') AND contains(path, '/tests/'))
SELECT repo, category, file, CAST(n AS BIGINT) AS n_tests, CAST(0 AS INTEGER) AS level FROM c
UNION ALL SELECT repo, category, NULL, CAST(sum(n) AS BIGINT), 1 FROM c GROUP BY repo, category HAVING sum(n) > 0
UNION ALL SELECT repo, NULL, NULL, CAST(sum(n) AS BIGINT), 3 FROM c GROUP BY repo""")
def _(spark, sf):
    return lint.test_inventory(corpus(spark, sf))
