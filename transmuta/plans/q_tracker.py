"""Queries over task logs, run logs and repository results."""

from __future__ import annotations

from pyspark.sql import functions as F

from transmuta.functions.materialize import Written
from transmuta.operators import tracker
from transmuta.plans.base import CTES, query
from transmuta.sources import derived
from transmuta.streaming import tasks as stream

CTES["task_starts"] = "SELECT task_id, max((ts, event_id)) AS started, max_by(ts, (ts, event_id)) AS started_at FROM task_events WHERE kind = 'start' GROUP BY task_id"
CTES["live_events"] = "SELECT e.*, s.started_at FROM task_events e JOIN task_starts s ON s.task_id = e.task_id AND (e.ts, e.event_id) > s.started"
CTES["live_groups"] = """
SELECT task_id, test_group, max_by(passed, (ts, event_id)) AS passed, max_by(failed, (ts, event_id)) AS failed FROM live_events WHERE kind = 'result' GROUP BY task_id, test_group"""
CTES["live_criteria"] = """
SELECT task_id, name, max_by(verdict, (ts, event_id)) AS verdict FROM (
  SELECT task_id, ts, event_id, criterion AS name, CASE WHEN requires_review THEN 'review' WHEN met THEN 'met' ELSE 'not_met' END AS verdict FROM live_events WHERE kind = 'criterion'
  UNION ALL SELECT task_id, ts, event_id, test_group || '_tests_all_passed', CASE WHEN failed = 0 THEN 'met' ELSE 'not_met' END FROM live_events WHERE kind = 'result') GROUP BY task_id, name"""
CTES["outcomes"] = """
SELECT task_id, started_at, completed_at, unit_run, unit_passed, unit_failed, met, not_met, review, has_errors, errors_logged, success,
  CASE WHEN completed_at IS NULL THEN 'in_progress' WHEN success THEN 'completed' ELSE 'failed' END AS status
FROM (SELECT *, len(met) > 0 AND len(not_met) = 0 AND NOT has_errors AS success FROM (
  SELECT s.task_id, s.started_at, (SELECT max(ts) FROM live_events e WHERE e.task_id = s.task_id AND e.kind = 'complete') AS completed_at,
    u.task_id IS NOT NULL AS unit_run, coalesce(u.passed, 0) AS unit_passed, CAST(coalesce(u.failed, 0) AS BIGINT) AS unit_failed,
    coalesce(m.met, []) AS met, coalesce(m.not_met, []) AS not_met, coalesce(m.review, []) AS review,
    EXISTS (SELECT 1 FROM live_events e WHERE e.task_id = s.task_id AND e.kind = 'error') AS has_errors,
    (SELECT count(*) FROM task_events e WHERE e.task_id = s.task_id AND e.kind = 'error') AS errors_logged
  FROM task_starts s LEFT JOIN live_groups u ON u.task_id = s.task_id AND u.test_group = 'unit'
  LEFT JOIN (SELECT task_id, list(name ORDER BY name) FILTER (verdict = 'met') AS met, list(name ORDER BY name) FILTER (verdict = 'not_met') AS not_met,
    list(name ORDER BY name) FILTER (verdict = 'review') AS review FROM live_criteria GROUP BY task_id) m ON m.task_id = s.task_id))"""


def outcomes(spark, sf):
    return tracker.task_outcome(tracker.task_state(derived.task_events(spark, sf)))


def _flat(df):
    return df.select("task_id", "status", "success", "started_at", "completed_at", F.col("unit.run").alias("unit_run"), F.col("unit.passed").alias("unit_passed"),
                     F.col("unit.failed").alias("unit_failed"), *[F.array_join(k, ",").alias(k) for k in ("met", "not_met", "review")], "has_errors", "errors_logged")


_OUTCOME_SQL = """
SELECT task_id, status, success, started_at, completed_at, unit_run, unit_passed, unit_failed, array_to_string(met, ',') AS met, array_to_string(not_met, ',') AS not_met,
  array_to_string(review, ',') AS review, has_errors, errors_logged FROM outcomes"""


@query("task_outcome", _OUTCOME_SQL)
def _(spark, sf):
    return _flat(outcomes(spark, sf))


@query("task_events_stream", _OUTCOME_SQL)
def _(spark, sf):
    """The same outcomes reached by a stream over the events file."""
    schema = derived.table(spark, sf, "events").schema
    # a glob, so that the table may be one file or a folder of files
    raw = spark.readStream.format("parquet").schema(schema).load(f"{sf}/events.parquet*")
    events = spark.sql(derived.TASK_EVENTS_SQL.replace("FROM events", "FROM {events}"), events=raw)
    return _flat(stream.task_events_stream(events, stream.stream_folder(spark)))


# events as they arrive: by quarter of the time they span, but one in fifty a quarter of the month late or more
ARRIVALS, DELAY = 4, "2 days"
_ARRIVAL_SQL = f"""
SELECT *, CASE WHEN event_id % 50 = 0 THEN {ARRIVALS - 1} ELSE CAST(least({ARRIVALS - 1}, floor({ARRIVALS} * part)) AS INTEGER) END AS arrival
FROM (SELECT *, CAST({{seconds}} - (SELECT min({{seconds}}) FROM events) AS DOUBLE) / greatest((SELECT max({{seconds}}) FROM events) - (SELECT min({{seconds}}) FROM events), 1) AS part FROM events)"""
CTES["arriving"] = _ARRIVAL_SQL.format(seconds="CAST(floor(epoch(ts)) AS BIGINT)")
# a window of a day is closed by the latest event of all batches but the last two, less the delay
CTES["closing"] = "SELECT a.n AS arrival, max(e.ts) - INTERVAL 2 DAY AS watermark FROM (SELECT DISTINCT arrival AS n FROM arriving) a JOIN arriving e ON e.arrival <= a.n - 2 GROUP BY a.n"
CTES["accepted_events"] = CTES["task_events"].replace("FROM events", "FROM (SELECT a.* FROM arriving a LEFT JOIN closing c ON c.arrival = a.arrival WHERE c.watermark IS NULL OR date_trunc('day', a.ts) + INTERVAL 1 DAY > c.watermark)")
for _name in ("task_starts", "live_events", "live_groups", "live_criteria", "outcomes"):
    _text = CTES[_name].replace("task_events", "accepted_events")
    for _other in ("task_starts", "live_events", "live_groups", "live_criteria"):
        _text = _text.replace(_other, f"accepted_{_other}")
    CTES[f"accepted_{_name}"] = _text


@query("task_events_late", _OUTCOME_SQL.replace("FROM outcomes", "FROM accepted_outcomes"))
def _(spark, sf):
    """Outcomes of a stream of four micro-batches whose late events are left out and whose closed windows leave the state."""
    folder = stream.stream_folder(spark)
    raw = derived.table(spark, sf, "events")
    placed = spark.sql(_ARRIVAL_SQL.format(seconds="unix_seconds(CAST(ts AS TIMESTAMP))").replace("FROM events", "FROM {events}"), events=raw).select(*raw.columns, "arrival")
    arrivals = Written(placed, "arrivals")
    for n in range(ARRIVALS):
        arrivals.df.filter(F.col("arrival") == n).select(*raw.columns).repartition(2).write.parquet(f"{folder}/arrivals/n={n}")
    arrivals.drop()
    events = stream.read_events(spark, f"{folder}/arrivals/*", raw.schema, max_files=2)
    named = spark.sql(derived.TASK_EVENTS_SQL.replace("FROM events", "FROM {events}"), events=events)
    return _flat(stream.task_events_stream(named, folder, delay=DELAY))


@query("windowed_activity", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, task_id, kind, count(*) AS n FROM task_events GROUP BY ALL")
def _(spark, sf):
    """The batch form of the windowed stream."""
    return stream.windowed_activity(derived.task_events(spark, sf))


_GROUP_ROWS = " UNION ALL ".join(
    f"SELECT '{g}_tests' AS section, '{n}' AS name, CAST(coalesce((SELECT sum({e}) FROM live_groups WHERE test_group = '{g}'), 0) AS BIGINT) AS value"
    for g in tracker.GROUPS for n, e in (("total_passed", "passed"), ("total_failed", "failed"), ("total_run", "passed + failed")))


@query("tracker_summary", f"""
SELECT 'tasks' AS section, 'total' AS name, count(*) AS value FROM outcomes
UNION ALL SELECT 'tasks', 'completed', count(*) FILTER (status = 'completed') FROM outcomes UNION ALL SELECT 'tasks', 'failed', count(*) FILTER (status = 'failed') FROM outcomes
UNION ALL SELECT 'tasks', 'in_progress', count(*) FILTER (status = 'in_progress') FROM outcomes
UNION ALL {_GROUP_ROWS}
UNION ALL SELECT 'criteria', 'total_met', count(*) FROM live_criteria WHERE verdict = 'met' UNION ALL SELECT 'criteria', 'total_not_met', count(*) FROM live_criteria WHERE verdict = 'not_met'
UNION ALL SELECT 'criteria', 'total_review', count(*) FROM live_criteria WHERE verdict = 'review'""")
def _(spark, sf):
    return tracker.tracker_summary(outcomes(spark, sf))


@query("task_duration", "SELECT task_id, status, (epoch_us(completed_at) - epoch_us(started_at)) / 1000000 AS seconds FROM outcomes")
def _(spark, sf):
    return tracker.task_duration(outcomes(spark, sf))


@query("ordered_dedupe", """
SELECT task_id, list, criterion, ts AS first_ts, event_id AS first_event FROM (SELECT *, CASE WHEN requires_review THEN 'review' WHEN met THEN 'met' ELSE 'not_met' END AS list,
  row_number() OVER (PARTITION BY task_id, CASE WHEN requires_review THEN 'review' WHEN met THEN 'met' ELSE 'not_met' END, criterion ORDER BY ts, event_id) AS rn
  FROM task_events WHERE kind = 'criterion') WHERE rn = 1""")
def _(spark, sf):
    return tracker.ordered_criteria(derived.task_events(spark, sf))


CTES["gated"] = """
SELECT *, failed = 0 AS all_passed, coverage >= 80 AS coverage_adequate, exit_code = 0 OR failed = 0 AS no_errors, passed + failed > 0 AS scenarios_covered,
  failed = 0 AND exit_code = 0 AS done FROM log_facts"""


@query("acceptance_gates", """
SELECT category, count(*) AS runs, bool_and(all_passed) AS all_passed, bool_and(coverage_adequate) AS coverage_adequate, bool_and(no_errors) AS no_errors,
  bool_and(scenarios_covered) AS scenarios_covered, bool_and(all_passed AND coverage_adequate AND no_errors AND scenarios_covered) AS all_met,
  count(*) FILTER (all_passed AND coverage_adequate AND no_errors AND scenarios_covered) AS runs_all_met,
  CASE WHEN bool_and(done) THEN 'passed' ELSE 'failed' END AS overall_status FROM gated GROUP BY category""")
def _(spark, sf):
    return tracker.gates_by_category(tracker.acceptance_gates(tracker.log_outcomes(derived.run_logs(spark, sf))))


@query("run_summary", """
SELECT *, CASE WHEN tests_run > 0 THEN tests_passed / tests_run * 100 ELSE 0.0 END AS success_rate,
  CASE WHEN tests_failed = 0 AND runs_failed = 0 THEN 'passed' ELSE 'failed' END AS overall_status
FROM (SELECT count(*) AS runs, CAST(sum(passed + failed) AS BIGINT) AS tests_run, CAST(sum(passed) AS BIGINT) AS tests_passed, CAST(sum(failed) AS BIGINT) AS tests_failed,
  CAST(sum(errors) AS BIGINT) AS tests_errors, count(*) FILTER (exit_code = 0) AS runs_completed, count(*) FILTER (exit_code <> 0) AS runs_failed FROM log_facts)""")
def _(spark, sf):
    return tracker.run_summary(tracker.log_outcomes(derived.run_logs(spark, sf)))


@query("qa_report", """
SELECT count(*) AS total_repos, count(*) FILTER (ok) AS successful, count(*) FILTER (bad) AS failed
FROM (SELECT repo, bool_and(status IN ('completed', 'skipped')) AS ok, bool_or(status = 'failed') AS bad FROM repo_tasks GROUP BY repo)""")
def _(spark, sf):
    return tracker.qa_report(derived.repo_tasks(spark, sf))


@query("qa_summary", """
SELECT 'total' AS section, 'patterns_detected' AS name, CAST(sum(patterns_detected) AS BIGINT) AS value FROM repo_tasks WHERE task = 'T2'
UNION ALL SELECT 'total', 'files_changed', CAST(sum(files_changed) AS BIGINT) FROM repo_tasks WHERE task = 'T3'
UNION ALL SELECT 'task', task || ':' || status, count(*) FROM repo_tasks GROUP BY task, status
UNION ALL SELECT 'tier', t.tier, count(DISTINCT r.repo) FROM (VALUES ('1'), ('2'), ('3')) t(tier) LEFT JOIN repo_tasks r ON CAST(r.tier AS VARCHAR) = t.tier GROUP BY t.tier""")
def _(spark, sf):
    return tracker.qa_summary(derived.repo_tasks(spark, sf))


@query("task_status_pivot", """
SELECT task, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped FROM repo_tasks GROUP BY task""")
def _(spark, sf):
    return tracker.task_status_pivot(derived.repo_tasks(spark, sf))


@query("repo_test_report", """
SELECT count(DISTINCT repo) AS total_repos, count(*) AS total_tests, count(*) FILTER (status <> 'failed') AS passed, count(*) FILTER (status = 'failed') AS failed FROM repo_tasks""")
def _(spark, sf):
    return tracker.repo_test_report(derived.repo_tasks(spark, sf))
