"""Registry of named queries, each with the SQL that states its expected result."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from transmuta.functions.constants import constant_table
from transmuta.sources import derived
from transmuta.sources.catalog import rule_set

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}

RULES = rule_set()
KNOWN_MODULES = ["os", "sys", "re", "json", "ast", "datetime", "pathlib", "semantic_kernel", "autogen"]


def query(name: str, sql: str | None = None):
    """Register a query; `sql` may use the shared CTEs by name."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def with_ctes(sql: str) -> str:
    """Prefix the SQL with the shared CTEs it mentions, directly or through another CTE."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in needed)
    body = sql.strip()
    return f"WITH {head},\n{body[4:].strip()}" if body.startswith("WITH ") else f"WITH {head}\n{body}"


def text_lit(v) -> str:
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def _lit(v) -> str:
    return str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else text_lit(v)


def values(rows, cols: str) -> str:
    """Rows as a VALUES select with named columns."""
    body = ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({cols})"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.derived_corpus(spark, sf_dir)


def known(spark: SparkSession) -> DataFrame:
    return constant_table(spark, [(m,) for m in KNOWN_MODULES], "module string")


CTES["files"] = derived.FILES_SQL.format(extra="doc_id, ")
CTES["task_events"] = derived.TASK_EVENTS_SQL
CTES["run_logs"] = derived.RUN_LOGS_SQL
CTES["repo_tasks"] = derived.REPO_TASKS_SQL
CTES["decision_writes_raw"] = derived.DECISION_WRITES_SQL
CTES["rules"] = values(
    [(r.rule_ord, r.key, r.id, r.pattern, r.replacement, r.confidence, r.type, r.framework, r.description, r.source, r.guide_url,
      r.type == "class_inheritance" and "{name}" in r.replacement) for r in RULES],
    "rule_ord, key, id, pattern, replacement, confidence, type, framework, description, source, guide_url, named")
CTES["line_arrays"] = """
SELECT doc_id, repo, path, content, CASE WHEN content = '' THEN [] WHEN right(content, 1) = chr(10)
  THEN string_split(left(content, length(content) - 1), chr(10)) ELSE string_split(content, chr(10)) END AS arr FROM files"""
CTES["lines"] = """
SELECT doc_id, repo, path, unnest(generate_series(1, len(arr))) AS line_no, unnest(arr) AS line FROM line_arrays"""
CTES["parsed"] = "SELECT *, NOT starts_with(content, 'def broken(') AS parse_ok FROM files"
# statements of files that parse, read off their unindented lines
CTES["statements"] = r"""
SELECT l.doc_id, l.repo, l.path, l.line_no, l.line,
  regexp_extract(l.line, '^from\s+\.*([A-Za-z_][A-Za-z0-9_.]*)\s+import', 1) AS from_module,
  regexp_extract(l.line, '^import\s+([A-Za-z0-9_.]+)', 1) AS import_module,
  regexp_extract(l.line, '^class\s+[A-Za-z0-9_]+\(([A-Za-z0-9_]*)\)', 1) AS base,
  regexp_extract(l.line, '^class\s+([A-Za-z0-9_]+)', 1) AS class_name,
  regexp_extract(l.line, '^def\s+([A-Za-z0-9_]+)', 1) AS func_name
FROM lines l JOIN parsed p ON p.doc_id = l.doc_id WHERE p.parse_ok"""
CTES["detections"] = """
SELECT doc_id, repo, path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INTEGER) AS det_seq,
  CASE WHEN from_module <> '' THEN 'IMPORT_' || upper(replace(from_module, '.', '_')) ELSE 'CLASS_' || base END AS id,
  CASE WHEN from_module <> '' THEN 'import' ELSE 'class_inheritance' END AS type,
  CASE WHEN from_module <> '' THEN from_module END AS module,
  CASE WHEN from_module = '' THEN base END AS class, 'high' AS confidence, 'rule' AS source, CAST(line_no AS INTEGER) AS line
FROM statements
WHERE starts_with(from_module, 'semantic_kernel') OR starts_with(from_module, 'sk') OR starts_with(from_module, 'autogen')
  OR base IN ('Kernel', 'KernelFunction', 'SemanticFunction', 'KernelAgent', 'ConversableAgent', 'AssistantAgent', 'UserProxyAgent', 'GroupChat')"""
CTES["rule_hits"] = """
SELECT f.doc_id, f.repo, f.path, r.rule_ord, r.id, r.type, r.framework, r.confidence, r.source
FROM files f JOIN rules r ON regexp_matches(f.content, r.pattern)"""
# detections of a report that also names rule ids
CTES["report_rows"] = """
SELECT doc_id, repo, path, det_seq, id, type, module, class, confidence, source, line FROM detections
UNION ALL
SELECT h.doc_id, h.repo, h.path,
  CAST(coalesce(n.n, 0) + row_number() OVER (PARTITION BY h.doc_id ORDER BY h.rule_ord) - 1 AS INTEGER),
  h.id, h.type, NULL, NULL, h.confidence, h.source, NULL
FROM rule_hits h LEFT JOIN (SELECT doc_id, count(*) AS n FROM detections GROUP BY doc_id) n ON n.doc_id = h.doc_id"""

_ROUTE = """
CASE WHEN starts_with(module, 'semantic_kernel') THEN
  CASE WHEN list_contains(string_split(module, '.'), 'agents') THEN
         CASE WHEN contains(module, 'chat_completion') OR contains(module, 'ChatCompletionAgent') OR contains(module, 'AgentGroupChat') THEN 'sk_import_chat_completion'
              WHEN contains(module, 'KernelAgent') OR contains(module, 'kernel_agent') THEN 'sk_import_agent' ELSE 'sk_import_chat_completion' END
       WHEN list_contains(string_split(module, '.'), 'functions') THEN 'sk_import_functions'
       WHEN list_contains(string_split(module, '.'), 'plugins') THEN 'sk_import_plugins' ELSE 'sk_import_kernel' END
 WHEN starts_with(module, 'autogen') THEN
  CASE WHEN contains(module, 'ConversableAgent') THEN 'autogen_import_conversable'
       WHEN contains(module, 'AssistantAgent') THEN 'autogen_import_assistant' ELSE 'autogen_import_conversable' END END"""


def resolved_cte(source: str) -> str:
    return f"""
SELECT d.*, coalesce(e.rule_ord, m.rule_ord, x.rule_ord) AS rule_ord, coalesce(e.id, m.id, x.id) AS rule_id,
  coalesce(e.confidence, m.confidence, x.confidence) AS rule_confidence,
  CASE WHEN e.id IS NOT NULL THEN 'id' WHEN m.id IS NOT NULL THEN 'module' WHEN x.id IS NOT NULL THEN 'regex' END AS method
FROM (SELECT *, {_ROUTE} AS route FROM {source}) d
LEFT JOIN rules e ON e.id = d.id
LEFT JOIN rules m ON m.key = d.route
LEFT JOIN (SELECT h.doc_id, h.type, min(h.rule_ord) AS first_ord FROM rule_hits h WHERE h.id <> 'SK_IMPORT_' GROUP BY h.doc_id, h.type) b
  ON b.doc_id = d.doc_id AND b.type = d.type
LEFT JOIN rules x ON x.rule_ord = b.first_ord"""


def folded_cte(source: str, where: str = "d.confidence = 'high' AND d.source = 'rule' AND r.confidence = 'high'") -> str:
    return rf"""
SELECT f.doc_id, f.repo, f.path, f.content, g.c AS new_content, g.applied AS applied, g.c <> f.content AS changed
FROM (
  SELECT f.doc_id, f.repo, f.path, f.content, list_reduce(
    list_prepend({{'c': f.content, 'p': '', 'r': '', 'id': '', 'named': FALSE, 'applied': CAST([] AS VARCHAR[])}}, coalesce(s.steps, [])),
    lambda a, x: CASE WHEN regexp_matches(a.c, x.p) THEN
      {{'c': regexp_replace(a.c, x.p, CASE WHEN x.named AND regexp_extract(a.c, 'class (\w+)\(', 1) <> ''
          THEN replace(x.r, '{{name}}', regexp_extract(a.c, 'class (\w+)\(', 1)) ELSE x.r END, 'g'),
        'p': '', 'r': '', 'id': '', 'named': FALSE, 'applied': list_append(a.applied, x.id)}} ELSE a END) AS g
  FROM files f LEFT JOIN (
    SELECT d.doc_id, list({{'c': '', 'p': r.pattern, 'r': r.replacement, 'id': r.id, 'named': r.named, 'applied': CAST([] AS VARCHAR[])}} ORDER BY d.det_seq) AS steps
    FROM {source} d JOIN rules r ON r.rule_ord = d.rule_ord WHERE {where} GROUP BY d.doc_id) s ON s.doc_id = f.doc_id) f"""


CTES["resolved"] = resolved_cte("detections")
CTES["resolved_report"] = resolved_cte("report_rows")
CTES["rewritten"] = folded_cte("resolved")
CTES["rewritten_report"] = folded_cte("resolved_report")
# bytes that are not UTF-8 in some files: a latin-1 'é' is appended to the encoded content
CTES["raw_files"] = "SELECT *, length(content) % 7 = 3 AS broken FROM files"
