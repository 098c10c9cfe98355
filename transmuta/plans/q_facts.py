"""Queries over facts and scalar projections."""

from __future__ import annotations

import sys
import uuid

from pyspark.sql import functions as F

from transmuta.functions import facts, text
from transmuta.functions.materialize import shared_folder
from transmuta.operators import detect, labels, reports, rewrite, tracker, validate
from transmuta.operators.outliers import comment_only_mentions
from transmuta.plans.base import CTES, KNOWN_MODULES, ORACLES, RULES, corpus, known, query, text_lit
from transmuta.sources import derived, fact_store

# facts of one file, read off its lines; the derived corpus nests nothing deeper than one level
CTES["file_facts"] = r"""
SELECT p.doc_id, p.repo, p.path, p.content, p.parse_ok,
  coalesce(sum(CASE WHEN s.import_module <> '' THEN 1 END), 0) AS n_imports,
  coalesce(sum(CASE WHEN s.from_module <> '' THEN 1 END), 0) AS n_from_imports,
  coalesce(sum(CASE WHEN s.class_name <> '' THEN 1 END), 0) AS n_classes,
  coalesce(sum(CASE WHEN s.func_name <> '' THEN 1 END), 0) AS n_functions,
  coalesce(sum(CASE WHEN regexp_matches(s.line, '^\s*assert ') THEN 1 END), 0) AS n_asserts,
  coalesce(max(CASE WHEN s.class_name <> '' OR s.func_name <> '' THEN 1 END), 0) AS max_nesting,
  coalesce(max(b.span), 0) AS max_func_lines
FROM parsed p LEFT JOIN statements s ON s.doc_id = p.doc_id LEFT JOIN func_spans b ON b.doc_id = p.doc_id AND b.line_no = s.line_no
GROUP BY p.doc_id, p.repo, p.path, p.content, p.parse_ok"""
# lines a top-level function reaches below its first one: the indented lines that directly follow it
CTES["func_spans"] = r"""
SELECT f.doc_id, f.line_no, f.func_name, coalesce(min(n.line_no) - f.line_no - 1, 0) AS span
FROM statements f LEFT JOIN lines n ON n.doc_id = f.doc_id AND n.line_no > f.line_no AND NOT regexp_matches(n.line, '^\s')
WHERE f.func_name <> '' GROUP BY f.doc_id, f.line_no, f.func_name"""
CTES["import_rows"] = """
SELECT doc_id, repo, path, CASE WHEN import_module <> '' THEN 'import' ELSE 'from' END AS kind,
  CASE WHEN import_module <> '' THEN import_module ELSE from_module END AS module, line_no
FROM statements WHERE import_module <> '' OR from_module <> ''"""
_KNOWN = ", ".join(text_lit(m) for m in sorted({*KNOWN_MODULES, *sys.builtin_module_names}))
CTES["unknown_rows"] = f"SELECT * FROM import_rows WHERE string_split(module, '.')[1] NOT IN ({_KNOWN})"
_BROKEN = "'''('' was never closed"
CTES["issues"] = f"""
SELECT repo, path, 'error' AS level, CAST(1 AS INTEGER) AS line_no, CAST(11 AS INTEGER) AS col_no, 'SyntaxError' AS error_type,
  {_BROKEN}' AS message, 'def broken(' AS context FROM parsed WHERE NOT parse_ok
UNION ALL SELECT repo, path, 'warning', CAST(line_no AS INTEGER), NULL, 'ImportWarning', 'Cannot resolve import: ' || module, NULL FROM unknown_rows"""


@query("code_facts", """
SELECT repo, path, parse_ok, CASE WHEN parse_ok THEN NULL ELSE 'SyntaxError' END AS err_type, CASE WHEN parse_ok THEN NULL ELSE CAST(1 AS INTEGER) END AS err_line,
  CAST(n_imports AS BIGINT) AS n_imports, CAST(n_from_imports AS BIGINT) AS n_from_imports, CAST(n_classes AS BIGINT) AS n_classes,
  CAST(n_functions AS BIGINT) AS n_functions, CAST(n_asserts AS BIGINT) AS n_asserts, CAST(max_nesting AS BIGINT) AS max_nesting FROM file_facts""")
def _(spark, sf):
    return _sized(facts.code_facts(corpus(spark, sf)))


def _sized(f):
    sizes = [F.size(c).cast("long").alias(f"n_{c}") for c in ("imports", "from_imports", "classes", "functions")]
    return f.select("repo", "path", "parse_ok", "err_type", "err_line", *sizes, F.col("asserts").cast("long").alias("n_asserts"),
                    F.col("max_nesting").cast("long").alias("max_nesting"))


@query("code_facts_incremental", ORACLES["code_facts"])
def _(spark, sf):
    """The same facts from a store that an edited snapshot has filled: only the contents that differ are parsed for the second one."""
    store = f"{shared_folder(spark)}/facts-{uuid.uuid4().hex}"
    files = corpus(spark, sf)
    edited = F.when(F.length("path") % 5 == 0, F.concat("content", F.lit("\nx = 1\n"))).otherwise(F.col("content"))
    fact_store.refresh(files.withColumn("content", edited), store)
    return _sized(fact_store.code_facts(files, store))


@query("facts_worker", """
SELECT repo, path, 'class' AS kind, class_name AS name, CAST(line_no AS INTEGER) AS line FROM statements WHERE class_name <> ''
UNION ALL SELECT repo, path, 'function', func_name, CAST(line_no AS INTEGER) FROM statements WHERE func_name <> ''""")
def _(spark, sf):
    f = facts.code_facts(corpus(spark, sf))
    rows = F.concat(F.transform("classes", lambda c: F.struct(F.lit("class").alias("kind"), c["name"].alias("name"), c["line"].alias("line"))),
                    F.transform("functions", lambda c: F.struct(F.lit("function").alias("kind"), c["name"].alias("name"), c["line"].alias("line"))))
    return f.select("repo", "path", F.inline(rows))


@query("imports", "SELECT repo, path, kind, module, CAST(line_no AS INTEGER) AS line FROM import_rows")
def _(spark, sf):
    return facts.imports(facts.code_facts(corpus(spark, sf))).drop("seq")


@query("lines", "SELECT repo, path, CAST(line_no AS INTEGER) AS line_no, line FROM lines")
def _(spark, sf):
    return text.lines(corpus(spark, sf))


@query("lines_split", r"""
SELECT conv_id, turn, CAST(unnest(generate_series(1, len(string_split(text, chr(10))))) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM conversations""")
def _(spark, sf):
    return text.lines(derived.table(spark, sf, "conversations"), "split", "text", ("conv_id", "turn"))


@query("line_counts", "SELECT repo, path, len(arr) AS n_lines FROM line_arrays")
def _(spark, sf):
    return corpus(spark, sf).select("repo", "path", text.line_count(F.col("content")).alias("n_lines"))


CTES["mixed"] = """
SELECT doc_id, repo, path, len(list_filter(arr, lambda s: contains(s, chr(9)))) > 0 AND len(list_filter(arr, lambda s: starts_with(s, ' '))) > 0 AS is_mixed
FROM line_arrays"""


@query("mixed_indentation", "SELECT repo, path, is_mixed FROM mixed")
def _(spark, sf):
    return text.with_line_shape(corpus(spark, sf)).select("repo", "path", "is_mixed")


@query("mixed_indentation_head", """
SELECT repo, path, len(list_filter(arr[1:100], lambda s: contains(s, chr(9)))) > 0 AND len(list_filter(arr[1:100], lambda s: starts_with(s, ' '))) > 0 AS is_mixed FROM line_arrays""")
def _(spark, sf):
    return text.with_line_shape(corpus(spark, sf), first_n=100).select("repo", "path", "is_mixed")


@query("structure_stats", "SELECT repo, path, CAST(max_func_lines AS INTEGER) AS max_func_lines, CAST(max_nesting AS INTEGER) AS max_nesting FROM file_facts")
def _(spark, sf):
    return facts.code_facts(corpus(spark, sf)).select("repo", "path", "max_func_lines", "max_nesting")


@query("path_parts", r"""
SELECT repo, path, CASE WHEN contains(rel, '/') THEN string_split(rel, '/')[1] END AS top_dir, len(string_split(rel, '/')) - 1 AS depth,
  string_split(rel, '/')[-1] AS basename, regexp_extract(rel, '\.[^./]+$') AS suffix FROM (SELECT repo, path, substring(path, length(repo) + 2) AS rel FROM files)""")
def _(spark, sf):
    return text.path_parts(corpus(spark, sf))


CTES["mentions"] = r"""
SELECT doc_id, repo, path,
  (regexp_matches(content, '(?i)#.*semantic[_\s]*kernel') OR regexp_matches(content, '(?i)#.*autogen')) AND NOT (
   regexp_matches(content, '(?i)from\s+semantic[_\s]*kernel|import\s+semantic[_\s]*kernel') OR regexp_matches(content, '(?i)from\s+autogen|import\s+autogen')) AS comment_only
FROM files"""


@query("comment_only_mentions", "SELECT repo, path, comment_only FROM mentions")
def _(spark, sf):
    return corpus(spark, sf).select("repo", "path", comment_only_mentions(F.col("content")).alias("comment_only"))


@query("test_kind", """
SELECT repo, path, CASE WHEN contains(lower(content), 'integration') OR contains(lower(content), 'e2e') THEN 'integration'
  WHEN contains(lower(content), 'end-to-end') THEN 'e2e' ELSE 'unit' END AS kind FROM files""")
def _(spark, sf):
    return corpus(spark, sf).select("repo", "path", labels.test_kind(F.col("content")).alias("kind"))


@query("framework_tags", """
SELECT repo, path, concat_ws(',', CASE WHEN contains(content, 'semantic_kernel') OR contains(content, 'sk.') THEN 'semantic_kernel' END,
  CASE WHEN contains(content, 'autogen') THEN 'autogen' END) AS tags FROM files""")
def _(spark, sf):
    return corpus(spark, sf).select("repo", "path", F.concat_ws(",", labels.framework_tags(F.col("content"))).alias("tags"))


@query("path_categories", """
WITH c AS (SELECT repo, path, CASE WHEN list_contains(string_split(path, '/'), 'unit') THEN 'unit' WHEN list_contains(string_split(path, '/'), 'integration') THEN 'integration'
  WHEN list_contains(string_split(path, '/'), 'e2e') THEN 'e2e' ELSE 'unit' END AS category FROM files)
SELECT repo, path, 'unit' AS label, category FROM c WHERE contains(path, 'unit')
UNION ALL SELECT repo, path, 'e2e', category FROM c WHERE contains(path, 'e2e')
UNION ALL SELECT repo, path, NULL, category FROM c WHERE NOT contains(path, 'unit') AND NOT contains(path, 'e2e')""")
def _(spark, sf):
    return labels.path_categories(corpus(spark, sf))


CTES["log_facts"] = r"""
SELECT *, passed + failed + errors AS total FROM (SELECT run_id, category, log, exit_code,
  coalesce(TRY_CAST(nullif(regexp_extract(log, '(\d+)\s+passed', 1), '') AS BIGINT), 0) AS passed,
  coalesce(TRY_CAST(nullif(regexp_extract(log, '(\d+)\s+failed', 1), '') AS BIGINT), 0) AS failed,
  coalesce(TRY_CAST(nullif(regexp_extract(log, '(\d+)\s+error', 1), '') AS BIGINT), 0) AS errors,
  CAST(coalesce(TRY_CAST(nullif(regexp_extract(log, 'TOTAL\s+\d+\s+\d+\s+(\d+)%', 1), '') AS DOUBLE),
    TRY_CAST(nullif(regexp_extract(log, '(\d+\.\d+)%', 1), '') AS DOUBLE), 0.0) AS DOUBLE) AS coverage FROM run_logs)"""


@query("log_outcomes", "SELECT run_id, category, passed, failed, errors, total, coverage FROM log_facts")
def _(spark, sf):
    return tracker.log_outcomes(derived.run_logs(spark, sf)).select("run_id", "category", "passed", "failed", "errors", "total", "coverage")


@query("text_preview", """
SELECT CAST(doc_id AS VARCHAR) AS name, right(text, 5000) AS preview FROM documents
UNION ALL SELECT path, CAST(len(applied) AS VARCHAR) || ' patterns applied: ' || array_to_string(applied[1:3], ', ') || CASE WHEN len(applied) > 3 THEN '...' ELSE '' END
FROM rewritten_report WHERE changed""")
def _(spark, sf):
    tails = derived.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), text.tail(F.col("text")).alias("preview"))
    found = detect.with_rule_detections(detect.with_detections(corpus(spark, sf)), RULES)
    lists = reports.applied_preview(rewrite.rewrite(found, RULES)).select(F.col("path").alias("name"), F.col("summary").alias("preview"))
    return tails.unionByName(lists)


@query("issue_string", """
SELECT repo, path, '[' || upper(level) || '] ' || path || CASE WHEN line_no IS NOT NULL THEN ':' || line_no || CASE WHEN col_no IS NOT NULL THEN ':' || col_no ELSE '' END ELSE '' END
  || ' - ' || error_type || ': ' || message AS text FROM issues""")
def _(spark, sf):
    return validate.issue_string(validate.validate(corpus(spark, sf), known(spark))).select("repo", "path", "text")
