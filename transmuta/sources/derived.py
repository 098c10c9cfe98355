"""Corpora and logs derived from the driver's tables by portable SQL (the same text runs in DuckDB)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# path and content of one derived source file per document; {extra} adds columns
FILES_SQL = """
SELECT {extra}source AS repo,
  CASE WHEN doc_id % 29 = 0 THEN concat(source,'/venv/lib/mod_',doc_id,'.py')
 WHEN doc_id % 23 = 0 THEN concat(source,'/generated/gen_',doc_id,'.py')
 WHEN doc_id % 19 = 0 THEN concat(source,'/app/ns',doc_id,'/__init__.py')
 WHEN doc_id % 13 = 0 THEN concat(source,'/tests/e2e/test_',doc_id,'.py')
 WHEN doc_id % 11 = 0 THEN concat(source,'/tests/unit/test_',doc_id,'.py')
 ELSE concat(source, CASE CAST(FLOOR(doc_id / 20.0) AS BIGINT) % 3 WHEN 0 THEN '/app/mod_' WHEN 1 THEN '/lib/mod_' ELSE '/mod_' END, doc_id,'.py') END AS path,
  CASE
    WHEN doc_id % 19 = 0 AND doc_id % 29 <> 0 AND doc_id % 23 <> 0 THEN '' ELSE concat(CASE doc_id % 12
    WHEN 0 THEN concat('from semantic_kernel import Kernel',chr(10),'kernel = Kernel()',chr(10),'kernel.add_plugin(kernel=kernel)',chr(10))
    WHEN 1 THEN concat('from semantic_kernel.agents import ChatCompletionAgent',chr(10),'class Bot(ChatCompletionAgent):',chr(10),concat(chr(9),'pass'),chr(10))
    WHEN 2 THEN concat('from semantic_kernel.plugins import Plugin',chr(10),'@kernel_function',chr(10),'def f(x):',chr(10),concat('    return x',chr(9)),chr(10))
    WHEN 3 THEN concat('from autogen import ConversableAgent, GroupChat',chr(10),'agent = ConversableAgent(name=1)',chr(10),'agent.initiate_chat(agent)',chr(10))
    WHEN 4 THEN concat('import semantic_kernel as sk',chr(10),'k = sk.Kernel()',chr(10))
    WHEN 5 THEN concat('# from semantic_kernel import Kernel',chr(10),'x = 1',chr(10))
    WHEN 6 THEN concat('from semantic_kernel.agents import KernelAgent',chr(10),'class A(KernelAgent):',chr(10),'    pass',chr(10),'class B(KernelAgent):',chr(10),'    pass',chr(10))
    WHEN 7 THEN concat('def broken(',chr(10),'    return',chr(10))
    WHEN 8 THEN concat('import os',chr(10),'import missing_pkg_x',chr(10),'from missing_pkg_y.sub import z',chr(10))
    WHEN 9 THEN concat('from sklearn.linear_model import Ridge',chr(10),'m = Ridge()',chr(10))
    WHEN 10 THEN concat('def test_a():',chr(10),'    assert len(items) >= 0',chr(10),'    assert result is not None',chr(10),'def test_b():',chr(10),'    pass',chr(10),'def test_c():',chr(10),'    assert x == 1',chr(10))
    WHEN 11 THEN concat('from .autogen import AssistantAgent',chr(10),'a = AssistantAgent(1)',chr(10))
  END, '# ', replace(text, chr(10), concat(chr(10),'# '))) END AS content
FROM documents
"""

TASK_EVENTS_SQL = """
SELECT event_id, ts, concat('task_', user_id % 40) AS task_id,
 CASE event_id % 5 WHEN 0 THEN 'start' WHEN 1 THEN 'result' WHEN 2 THEN 'criterion' WHEN 3 THEN 'criterion' ELSE CASE WHEN event_type = 'error' THEN 'error' ELSE 'complete' END END AS kind,
 CASE event_id % 4 WHEN 0 THEN 'unit' WHEN 1 THEN 'integration' WHEN 2 THEN 'e2e' ELSE 'validation' END AS test_group,
 event_id % 9 AS passed, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed,
 concat('criterion_', event_id % 6) AS criterion, event_type <> 'error' AS met, event_id % 31 = 0 AS requires_review
 FROM events
"""

RUN_LOGS_SQL = """
SELECT o_orderkey AS run_id, CASE o_orderkey % 5 WHEN 0 THEN 'unit' WHEN 1 THEN 'integration' WHEN 2 THEN 'e2e' WHEN 3 THEN 'edge_cases' ELSE 'performance' END AS category,
 concat('== ', CASE WHEN o_orderkey % 7 = 0 THEN concat(o_orderkey % 3 + 1, ' failed, ') ELSE '' END, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE concat(o_orderkey % 50, ' passed') END, CASE WHEN o_orderkey % 13 = 0 THEN ', 2 error' ELSE '' END, ' in 1.5s ==', chr(10), CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('TOTAL   100    10    ', 70 + o_orderkey % 30, '%') END) AS log,
 CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS exit_code FROM orders
"""

REPO_TASKS_SQL = """
SELECT concat('repo_', l_orderkey % 21) AS repo, l_suppkey % 4 AS tier, concat('T', l_linenumber % 6 + 1) AS task,
 CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'completed' ELSE 'skipped' END AS status, l_partkey % 5 AS patterns_detected, l_partkey % 3 AS files_changed FROM lineitem
"""

# writes to the decision table: who decided what about which rule, and when; notes are often missing
DECISION_WRITES_SQL = """
SELECT event_id AS write_id, ts AS last_updated, user_id % 36 AS rule_ord,
 CASE event_id % 3 WHEN 0 THEN 'auto_apply' WHEN 1 THEN 'manual' ELSE 'skip' END AS decision,
 CASE WHEN event_id % 4 = 0 THEN concat('note ', event_id) END AS notes,
 CASE WHEN event_id % 6 = 0 THEN 'high' WHEN event_id % 6 = 1 THEN 'medium' END AS min_confidence
 FROM events
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: table(spark, sf_dir, name)})


def derived_corpus(spark: SparkSession, sf_dir: str, with_id: bool = False) -> DataFrame:
    """files(repo, path, content) from `documents`."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sql = FILES_SQL.format(extra="doc_id, " if with_id else "").replace("FROM documents", "FROM {documents}")
    return spark.sql(sql, documents=docs)


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, TASK_EVENTS_SQL, "events")


def run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, RUN_LOGS_SQL, "orders")


def repo_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, REPO_TASKS_SQL, "lineitem")


def decision_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, DECISION_WRITES_SQL, "events")
