"""A decision store with several writers."""

import os

from pyspark.sql import functions as F

from transmuta.sources import decision_log, stores


def writes(spark, *rows):
    return spark.createDataFrame(list(rows), "pattern_id string, decision string, notes string, min_confidence string, at string, write_id long").withColumn(
        "last_updated", F.to_timestamp("at")).drop("at")


def state(spark, path):
    return sorted(map(str, decision_log.decisions(spark, path).collect()))


FIRST = [("A", "skip", "why", "high", "2024-01-02 00:00:00", 1), ("B", "manual", None, None, "2024-01-01 00:00:00", 2)]
SECOND = [("A", "auto_apply", None, None, "2024-01-03 00:00:00", 3), ("A", "manual", "older", "low", "2024-01-01 00:00:00", 4), ("C", "skip", "", None, "2024-01-01 00:00:00", 5)]


def test_no_writer_loses_a_decision(spark, tmp_path):
    path = str(tmp_path)
    assert state(spark, path) == []
    for rows in (FIRST, SECOND):
        decision_log.append(writes(spark, *rows), path)
    want = sorted(map(str, stores.decision_state(writes(spark, *FIRST, *SECOND)).select("pattern_id", "decision", "notes", "min_confidence", "last_updated", "n_writes").collect()))
    want = [w.replace("notes=''", "notes=None") for w in want]
    assert state(spark, path) == want
    decision_log.compact(spark, path)
    assert state(spark, path) == want
    # a write that is older than the snapshot, but arrives after it, changes nothing but the count
    decision_log.append(writes(spark, ("A", "skip", "late", None, "2023-12-31 00:00:00", 6)), path)
    rows = {r["pattern_id"]: r for r in decision_log.decisions(spark, path).collect()}
    assert rows["A"]["decision"] == "auto_apply" and rows["A"]["notes"] == "why" and rows["A"]["n_writes"] == 4
    decision_log.compact(spark, path)
    decision_log.compact(spark, path)
    assert {r["pattern_id"]: r for r in decision_log.decisions(spark, path).collect()} == rows
    assert len(os.listdir(f"{path}/snapshots")) == 2 and len(os.listdir(f"{path}/log")) <= 1


def test_what_was_not_finished_is_not_read(spark, tmp_path):
    path = str(tmp_path)
    decision_log.append(writes(spark, *FIRST), path)
    decision_log.compact(spark, path)
    decision_log.append(writes(spark, *SECOND), path)
    before = state(spark, path)
    os.makedirs(f"{path}/snapshots/00000009-dead/entries")  # a compaction that died
    os.makedirs(f"{path}/log/dead")  # a writer that died
    assert state(spark, path) == before
    # two compactions at the same time: either snapshot with the parts it does not name is the whole store
    merged = decision_log._merged(spark, path)[0]
    decision_log.compact(spark, path)
    merged.write.parquet(f"{path}/snapshots/00000001-ffff/entries")
    spark.createDataFrame([], "part string").write.parquet(f"{path}/snapshots/00000001-ffff/parts")
    assert [r.split("n_writes")[0] for r in state(spark, path)] == [r.split("n_writes")[0] for r in before]
