"""Plans and joins that must hold at scale: hot keys, membership filters, state that leaves, one parse per report."""

import os

import pytest
from pyspark.sql import functions as F

from transmuta.functions.joins import lookup_join, may_be_member
from transmuta.operators import diff, outliers, resolve, tracker
from transmuta.plans.registry import QUERIES
from transmuta.streaming import tasks

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_equals_the_plain_join(spark, how):
    left = spark.range(20000).select(F.when(F.col("id") < 9000, F.lit(7)).when(F.col("id") < 9100, None).otherwise(F.col("id") % 997).alias("k"), "id", F.lit(1).alias("x"))
    right = spark.range(900).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.when(F.col("id") % 2 == 0, "a").alias("w"))
    got, want = lookup_join(left, right, ["k"], ["id"], how), left.join(right, "k", how)
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).count() == 0
    assert lookup_join(left.limit(0), right, ["k"], ["id"], how).count() == 0
    with pytest.raises(ValueError):
        lookup_join(left, right, ["k"], ["id"], "full")


def test_membership_filter_loses_no_member(spark):
    keys = spark.range(0, 9000, 3).select(F.col("id").alias("a"), F.concat(F.lit("p"), "id").alias("b")).unionByName(spark.createDataFrame([(None, "x")], "a long, b string"))
    rows = spark.range(9000).select(F.col("id").alias("a"), F.concat(F.lit("p"), "id").alias("b")).unionByName(spark.createDataFrame([(None, "x")], "a long, b string"))
    passed = rows.filter(may_be_member(keys, ["a", "b"], 1 << 20))
    assert passed.filter("a % 3 = 0 OR a IS NULL").count() == 3001 and passed.count() < 3100
    assert rows.filter(may_be_member(keys, ["a", "b"], 64)).count() == 9001  # more keys than bits: it lets everything pass
    assert rows.filter(may_be_member(keys.limit(0), ["a", "b"])).count() == 0


def snapshots(spark, n=3000, changed=30):
    before = spark.range(n).select(F.lit("p").alias("repo"), F.concat(F.lit("p/f"), "id").alias("path"), F.concat(F.lit("a\nline "), "id", F.lit("\nz")).alias("content"), "id")
    edited = F.when(F.col("id") % (n // changed) == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    return before.drop("id"), before.withColumn("content", edited).drop("id")


def test_line_diff_moves_only_texts_that_differ(spark, no_broadcast):
    before, after = snapshots(spark)
    found = diff.line_diff(before, after)
    assert found.count() == 30 and {r["before"] for r in found.collect()} == {"z"}
    # texts enter a shuffle behind the membership filter only
    main = [line for line in plan_of(found).split("\n") if not line.lstrip().startswith(":  ") or "Exchange" in line]
    assert any("Filter" in line and "ubquery" in line for line in main)
    keys = before.join(after.withColumnRenamed("content", "c"), ["repo", "path"]).filter("content <> c")
    assert before.filter(may_be_member(keys, ["repo", "path"])).count() <= 32


def test_line_diff_with_repeated_and_null_keys(spark):
    rows = [("p", "a", "1\n2"), ("p", "a", "1\n3"), ("p", None, "x"), (None, "b", "y"), ("p", "c", None), ("p", "d", "")]
    before = spark.createDataFrame(rows, "repo string, path string, content string")
    after = spark.createDataFrame([("p", "a", "1\n2"), ("p", "c", "now"), ("p", "d", "new")], "repo string, path string, content string")
    got = sorted((r["path"], r["line_no"], r["before"], r["after"], r["kind"]) for r in diff.line_diff(before, after).collect())
    assert got == [("a", 2, "3", "2", "modified"), ("d", 1, None, "new", "added")]


def test_a_report_reaches_its_files_without_moving_the_others(spark, no_broadcast):
    files, _ = snapshots(spark)
    named = spark.createDataFrame([("p", f"p/f{i}", 0, "R", "import", "m", None, "high", "rule", 1) for i in (3, 8, 99999)],
                                  "repo string, path string, det_seq int, id string, type string, module string, class string, confidence string, source string, line int")
    got = resolve.attach_detections(files, named)
    assert got.count() == 3000 and {r["path"] for r in got.filter("size(detections) > 0").collect()} == {"p/f3", "p/f8"}
    plan = plan_of(got)
    assert "Union" in plan and plan.count("Join") == 1


def test_suffix_match_with_many_listed_paths(spark):
    files = spark.range(4000).select(F.lit("p").alias("repo"), F.concat(F.lit("p/src/d"), F.col("id") % 50, F.lit("/m"), "id", F.lit(".py")).alias("path"))
    listed = spark.range(100_000).select(F.lit("p").alias("repo"), F.concat(F.lit("d"), F.col("id") % 50, F.lit("/m"), "id", F.lit(".py")).alias("rel")) \
        .unionByName(spark.createDataFrame([("p", "m17.py"), ("p", "src/d1/m1.py"), ("p", "p/src/d2/m2.py"), ("q", "py"), ("p", "nothing")], "repo string, rel string"))
    got = outliers.suffix_match(files, listed)
    want = {(f"p/src/d{i % 50}/m{i}.py", f"d{i % 50}/m{i}.py") for i in range(4000)} | {("p/src/d17/m17.py", "m17.py"), ("p/src/d1/m1.py", "src/d1/m1.py"), ("p/src/d2/m2.py", "p/src/d2/m2.py")}
    assert {(r["path"], r["rel"]) for r in got.collect()} == want


@pytest.mark.parametrize("name", ["analysis_report", "outlier_gate"])
def test_reports_scan_and_parse_once(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1


def test_structure_reads_paths_only(spark):
    plan = plan_of(QUERIES["structure_outliers"](spark, SF))
    assert "Generate" not in plan and "Python" not in plan


def write_batches(spark, folder, batches):
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame([(e, None, t, k, "unit", 3, 0, "c", True, False) for e, _, t, k in rows], tasks.EVENT_COLUMNS)
        stamps = spark.createDataFrame([(e, ts) for e, ts, _, _ in rows], "event_id long, at string")
        frame.drop("ts").join(stamps, "event_id").withColumn("ts", F.to_timestamp("at")).select([c.split()[0] for c in tasks.EVENT_COLUMNS.split(", ")]) \
            .coalesce(1).write.parquet(f"{folder}/in/b{i}")
    return tasks.read_events(spark, f"{folder}/in/*", max_files=1)


def test_late_events_are_left_out_and_closed_windows_leave_the_state(spark, tmp_path):
    days = [[(10 * d, f"2024-01-{d:02d} 10:00:00", "a", "start" if d == 1 else "result"), (10 * d + 1, f"2024-01-{d:02d} 11:00:00", f"t{d}", "start")] for d in range(1, 11)]
    days[8].append((777, "2024-01-02 12:00:00", "late", "start"))  # its window was closed long ago
    days[8].append((778, "2024-01-09 01:00:00", "early", "start"))
    events = write_batches(spark, tmp_path, days)
    query = tasks.state_stream(events, f"{tmp_path}/state", f"{tmp_path}/check", "1 day")
    query.awaitTermination()
    progress = [p for p in query.recentProgress if p["stateOperators"]]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress) == 1
    assert max(held) <= 16 and held[-1] < 16  # ten days would be 39 entries
    assert sorted(f for f in os.listdir(f"{tmp_path}/state") if f.startswith("v=")) == sorted(f"v={n}" for n in range(max(p["batchId"] for p in progress) - 1, max(p["batchId"] for p in progress) + 1))
    state = tasks.latest_state(spark, f"{tmp_path}/state")
    accepted = spark.read.parquet(f"{tmp_path}/in/*").filter("event_id <> 777")
    want = tracker.task_state(accepted)
    columns = ["task_id", "slot", "at", "latest", "n"]
    assert sorted(map(str, state.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    # windows that are closed are one entry per (task, slot)
    newest = spark.read.parquet(f"{tmp_path}/state/v={max(p['batchId'] for p in progress)}")
    assert newest.filter("task_id = 'a' AND slot = 'group:unit' AND until IS NULL").count() == 1 and newest.filter("until IS NOT NULL").count() < 20


def test_a_replayed_batch_rewrites_its_version(spark, tmp_path):
    events = write_batches(spark, tmp_path, [[(1, "2024-01-01 10:00:00", "a", "start")], [(2, "2024-01-02 10:00:00", "a", "result")]])
    tasks.state_stream(events, f"{tmp_path}/state", f"{tmp_path}/check", "1 day").awaitTermination()
    first = sorted(map(str, tasks.latest_state(spark, f"{tmp_path}/state").collect()))
    last = max(int(f[2:]) for f in os.listdir(f"{tmp_path}/state") if f.startswith("v="))
    os.remove(f"{tmp_path}/state/v={last}/_SUCCESS")  # as if the writer had died
    assert "v=%d/" % (last - 1) in str(tasks.latest_state(spark, f"{tmp_path}/state").inputFiles())
    os.remove(f"{tmp_path}/check/commits/{last}")
    os.path.exists(f"{tmp_path}/check/commits/.{last}.crc") and os.remove(f"{tmp_path}/check/commits/.{last}.crc")
    tasks.state_stream(events, f"{tmp_path}/state", f"{tmp_path}/check", "1 day").awaitTermination()
    assert sorted(map(str, tasks.latest_state(spark, f"{tmp_path}/state").collect())) == first
