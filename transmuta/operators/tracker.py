"""Task outcomes from event logs, run logs and result tables.

`task_state` keeps the latest event per (task, slot), where a slot is one test group, one criterion, or one of
start / complete / error. It is a plain keyed aggregate: it combines map-side, so a task that owns a third of the log
is not one task's work, and it runs unchanged on a stream. `task_outcome` turns that small state into one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GROUPS = ("unit", "integration", "e2e", "validation")


def _order() -> Column:
    """Events are ordered by time, then by id."""
    return F.struct("ts", "event_id")


def task_state(events: DataFrame, *within: Column) -> DataFrame:
    """Latest event per task and slot, with counts of how often a criterion was met, not met or sent to review.

    A test result also settles the criterion `<group>_tests_all_passed`. `within` are further keys, such as a time window.
    """
    result = F.col("kind") == "result"
    criterion = F.col("kind") == "criterion"
    slots = F.when(result, F.array(F.concat(F.lit("group:"), F.col("test_group")),
                                   F.concat(F.lit("criterion:"), F.col("test_group"), F.lit("_tests_all_passed")))).when(
        criterion, F.array(F.concat(F.lit("criterion:"), F.col("criterion")))).otherwise(F.array("kind"))
    met = F.when(result, F.col("failed") == 0).otherwise(F.col("met"))
    verdict = F.when(criterion & F.col("requires_review"), "review").when(met, "met").otherwise("not_met")
    rows = events.select(
        *within, "task_id", "ts", "event_id", F.explode(slots).alias("slot"), F.col("passed").cast("long").alias("passed"),
        F.col("failed").cast("long").alias("failed"), verdict.alias("verdict"))
    order = _order()

    def last(v):
        return F.max(F.when(F.col("verdict") == v, order))

    keys = [c for c in rows.columns if c not in ("ts", "event_id", "passed", "failed", "verdict")]
    return rows.groupBy(*keys).agg(
        F.max(order).alias("at"), F.max_by(F.struct("passed", "failed", "verdict"), order).alias("latest"),
        last("met").alias("last_met"), last("not_met").alias("last_not_met"), last("review").alias("last_review"),
        F.count("*").alias("n"))


def merged(state: DataFrame, *within: str) -> DataFrame:
    """Entries of several states of a (task, slot) as one; the aggregates of `task_state` combine."""
    return state.groupBy("task_id", "slot", *within).agg(
        F.max("at").alias("at"), F.max_by("latest", "at").alias("latest"), *[F.max(c).alias(c) for c in ("last_met", "last_not_met", "last_review")], F.sum("n").alias("n"))


def task_outcome(state: DataFrame, strict: bool = False) -> DataFrame:
    """One row per started task; only what happened after the task's latest start counts.

    By default the latest event of a criterion decides it. With `strict` a criterion stays not met (and in review)
    once it has been, which is how an append-only record behaves.
    """
    rest = state.groupBy("task_id").agg(
        F.max(F.when(F.col("slot") == "start", F.col("at"))).alias("started"),
        F.max(F.when(F.col("slot") == "complete", F.col("at"))).alias("completed"),
        F.max(F.when(F.col("slot") == "error", F.col("at"))).alias("last_error"),
        F.sum(F.when(F.col("slot") == "error", F.col("n")).otherwise(0)).alias("errors_logged"),
        *[F.max(F.when(F.col("slot") == f"group:{g}", F.struct("at", "latest"))).alias(g) for g in GROUPS],
        F.collect_list(F.when(F.startswith("slot", F.lit("criterion:")), F.struct(
            F.substring(F.col("slot"), F.lit(11), F.length("slot")).alias("name"), "at", "latest", "last_met", "last_not_met", "last_review"))).alias("criteria"),
    ).filter(F.col("started").isNotNull())
    after = F.col("started")

    def named(kind):
        if strict:
            keep = F.filter("criteria", lambda c: c[f"last_{kind}"] > after)
        else:
            keep = F.filter("criteria", lambda c: (c["at"] > after) & (c["latest"]["verdict"] == kind))
        return F.array_sort(F.transform(keep, lambda c: c["name"]))

    def result(g):
        run = F.coalesce(F.col(g)["at"] > after, F.lit(False))
        return F.struct(run.alias("run"), F.when(run, F.col(g)["latest"]["passed"]).otherwise(0).alias("passed"),
                        F.when(run, F.col(g)["latest"]["failed"]).otherwise(0).alias("failed")).alias(g)

    has_errors = F.coalesce(F.col("last_error") > after, F.lit(False))
    done = F.coalesce(F.col("completed") > after, F.lit(False))
    out = rest.select(
        "task_id", F.col("started.ts").alias("started_at"), F.when(done, F.col("completed.ts")).alias("completed_at"),
        *[result(g) for g in GROUPS], named("met").alias("met"), named("not_met").alias("not_met"),
        named("review").alias("review"), has_errors.alias("has_errors"), "errors_logged")
    success = (F.size("met") > 0) & (F.size("not_met") == 0) & ~F.col("has_errors")
    status = F.when(F.col("completed_at").isNull(), "in_progress").when(success, "completed").otherwise("failed")
    return out.withColumn("success", success).withColumn("status", status)


def tracker_summary(outcomes: DataFrame) -> DataFrame:
    """Totals over tasks as (section, name, value) rows: statuses, test groups that ran, criteria."""
    def entry(section, name, value):
        return F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), value.cast("long").alias("value"))

    def one(cond):
        return F.when(cond, 1).otherwise(0)

    rows = [entry("tasks", "total", F.lit(1))]
    rows += [entry("tasks", s, one(F.col("status") == s)) for s in ("completed", "failed", "in_progress")]
    for g in GROUPS:
        rows += [entry(f"{g}_tests", "total_passed", F.col(g)["passed"]), entry(f"{g}_tests", "total_failed", F.col(g)["failed"]),
                 entry(f"{g}_tests", "total_run", F.col(g)["passed"] + F.col(g)["failed"])]
    rows += [entry("criteria", f"total_{k}", F.size(k)) for k in ("met", "not_met", "review")]
    return outcomes.select(F.inline(F.array(*rows))).groupBy("section", "name").agg(F.sum("value").alias("value"))


def ordered_criteria(events: DataFrame) -> DataFrame:
    """Criteria of each task in the order they first entered each list, every name once per list."""
    lst = F.when(F.col("requires_review"), "review").when(F.col("met"), "met").otherwise("not_met")
    return events.filter(F.col("kind") == "criterion").groupBy("task_id", lst.alias("list"), "criterion").agg(
        F.min(_order()).alias("first")).select("task_id", "list", "criterion", F.col("first.ts").alias("first_ts"),
                                               F.col("first.event_id").alias("first_event"))


def task_duration(outcomes: DataFrame) -> DataFrame:
    """Seconds from start to completion, NULL while in progress."""
    def seconds(c):
        return F.unix_micros(F.col(c).cast("timestamp"))

    return outcomes.select("task_id", "status", ((seconds("completed_at") - seconds("started_at")) / 1_000_000).alias("seconds"))


def task_documents(outcomes: DataFrame) -> DataFrame:
    """One JSON document per task."""
    doc = F.struct("task_id", "status", "success", *GROUPS, F.struct("met", "not_met", "review").alias("acceptance_criteria"),
                   "has_errors", "errors_logged")
    return outcomes.select("task_id", F.to_json(doc).alias("document"))


def write_task_results(outcomes: DataFrame, path: str) -> None:
    """Task documents partitioned by task under `tasks`, and the totals under `summary`."""
    outcomes.write.mode("overwrite").partitionBy("task_id").json(f"{path}/tasks")
    tracker_summary(outcomes).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


# ---- run logs ------------------------------------------------------------------------------------------------

def log_outcomes(logs: DataFrame, log_col: str = "log") -> DataFrame:
    """Counts parsed from test-run output: first match of each, 0 when there is none."""
    log = F.col(log_col)

    def count(word):
        found = F.nullif(F.regexp_extract(log, rf"([0-9]+)\s+{word}", 1), F.lit(""))
        return F.coalesce(found.try_cast("long"), F.lit(0).cast("long"))

    total_line = F.regexp_extract(log, r"TOTAL\s+[0-9]+\s+[0-9]+\s+([0-9]+)%", 1)
    any_percent = F.regexp_extract(log, r"([0-9]+\.[0-9]+)%", 1)
    coverage = F.coalesce(F.nullif(total_line, F.lit("")).cast("double"), F.nullif(any_percent, F.lit("")).cast("double"), F.lit(0.0))
    out = logs.withColumns({"passed": count("passed"), "failed": count("failed"), "errors": count("error"), "coverage": coverage})
    return out.withColumn("total", F.col("passed") + F.col("failed") + F.col("errors"))


def acceptance_gates(outcomes: DataFrame, min_coverage: float = 80.0) -> DataFrame:
    """Gate columns per run: tests passed, coverage, no errors, something ran; and the run's status."""
    return outcomes.withColumns({
        "all_passed": F.col("failed") == 0,
        "coverage_adequate": F.col("coverage") >= min_coverage,
        "no_errors": (F.col("exit_code") == 0) | (F.col("failed") == 0),
        "scenarios_covered": (F.col("passed") + F.col("failed")) > 0,
        "status": F.when((F.col("failed") == 0) & (F.col("exit_code") == 0), "completed").otherwise("failed"),
    }).withColumn("all_met", F.col("all_passed") & F.col("coverage_adequate") & F.col("no_errors") & F.col("scenarios_covered"))


def gates_by_category(gated: DataFrame) -> DataFrame:
    """Gates over all runs of a category; `passed` when every run completed."""
    gates = ("all_passed", "coverage_adequate", "no_errors", "scenarios_covered", "all_met")
    return gated.groupBy("category").agg(
        F.count("*").alias("runs"), *[F.bool_and(g).alias(g) for g in gates],
        F.count_if("all_met").alias("runs_all_met"),
        F.when(F.bool_and(F.col("status") == "completed"), "passed").otherwise("failed").alias("overall_status"))


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Totals over all runs; tests run are passed plus failed, so the success percentage is meaningful."""
    ok = (F.col("exit_code") == 0)
    totals = outcomes.agg(
        F.count("*").alias("runs"), F.sum(F.col("passed") + F.col("failed")).alias("tests_run"), F.sum("passed").alias("tests_passed"),
        F.sum("failed").alias("tests_failed"), F.sum("errors").alias("tests_errors"),
        F.count_if(ok).alias("runs_completed"), F.count_if(~ok).alias("runs_failed"))
    return totals.withColumn(
        "success_rate", F.when(F.col("tests_run") > 0, F.col("tests_passed") / F.col("tests_run") * 100).otherwise(0.0)
    ).withColumn("overall_status", F.when((F.col("tests_failed") == 0) & (F.col("runs_failed") == 0), "passed").otherwise("failed"))


# ---- repository results ----------------------------------------------------------------------------------------

def qa_report(results: DataFrame) -> DataFrame:
    """Projects, those whose tasks all completed or were skipped, and those with a failed task."""
    per_repo = results.groupBy("repo").agg(
        F.bool_and(F.col("status").isin("completed", "skipped")).alias("ok"), F.bool_or(F.col("status") == "failed").alias("bad"))
    return per_repo.agg(F.count("*").alias("total_repos"), F.count_if("ok").alias("successful"), F.count_if("bad").alias("failed"))


def qa_summary(results: DataFrame, tiers: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(section, name, value) rows: pattern and file totals, projects per tier with zeros, task x status counts."""
    def entry(section, name, value):
        return F.struct(F.lit(section).alias("section"), name.alias("name"), value.cast("long").alias("value"))

    # one narrow aggregate over the results; the report rows come from its few groups
    groups = results.groupBy("task", "status").agg(
        F.count("*").alias("n"), F.sum("patterns_detected").alias("patterns"), F.sum("files_changed").alias("files"))
    rows = F.filter(F.array(
        F.when(F.col("task") == "T2", entry("total", F.lit("patterns_detected"), F.col("patterns"))),
        F.when(F.col("task") == "T3", entry("total", F.lit("files_changed"), F.col("files"))),
        entry("task", F.concat_ws(":", "task", "status"), F.col("n"))), lambda r: r.isNotNull())
    counts = groups.select(F.inline(rows)).groupBy("section", "name").agg(F.sum("value").alias("value"))
    pairs = results.filter(F.col("tier").isin(*tiers)).select("repo", "tier").distinct()
    per_tier = pairs.agg(*[F.count_if(F.col("tier") == t).alias(str(t)) for t in tiers]).select(F.inline(F.array(*[
        F.struct(F.lit("tier").alias("section"), F.lit(str(t)).alias("name"), F.col(str(t)).alias("value")) for t in tiers])))
    return counts.unionByName(per_tier)


def task_status_pivot(results: DataFrame) -> DataFrame:
    """Task x status counts, one column per status."""
    return results.groupBy("task").pivot("status", ["completed", "failed", "skipped"]).count().na.fill(0)


def repo_test_report(results: DataFrame) -> DataFrame:
    """Distinct projects, tests, passed, failed. Projects are made distinct by a group, not by one big set."""
    per_repo = results.groupBy("repo").agg(F.count("*").alias("n"), F.count_if(F.col("status") != "failed").alias("ok"))
    return per_repo.agg(F.count("*").alias("total_repos"), F.sum("n").alias("total_tests"), F.sum("ok").alias("passed"),
                        (F.sum("n") - F.sum("ok")).alias("failed"))
