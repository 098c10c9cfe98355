import datetime as dt

import pytest
from pyspark.sql import functions as F

from transmuta import schemas
from transmuta.operators import detect, tracker
from transmuta.plans import flows
from transmuta.sources import catalog, corpus, stores
from transmuta.streaming import tasks

RULES = catalog.rule_set()


@pytest.fixture
def tree(tmp_path):
    files = {
        "one/main.py": b"from semantic_kernel import Kernel\r\nkernel = Kernel()\r\n", "one/venv/lib/x.py": b"from autogen import A\n",
        "one/readme.md": b"# hi", "two/pkg/agent.py": b"from autogen import ConversableAgent, GroupChat\n", "two/bad.py": b"# caf\xe9\n",
        "two/tests/test_a.py": b"def test_a():\n    pass\n", "two/with space.py": "x = 'é'\n".encode(),
    }
    root = tmp_path / "tree"
    for name, data in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return str(root)


def test_scan_of_a_directory(spark, tree):
    rows = {r["path"]: r for r in corpus.corpus_scan(spark, tree).collect()}
    assert set(rows) == {"one/main.py", "two/pkg/agent.py", "two/bad.py", "two/tests/test_a.py", "two/with space.py"}
    assert rows["one/main.py"]["repo"] == "one" and "\r" not in rows["one/main.py"]["content"]
    assert rows["two/bad.py"]["content"] is None and rows["two/with space.py"]["content"] == "x = 'é'\n"
    assert {r["repo"] for r in corpus.corpus_scan(spark, tree, repo="all").collect()} == {"all"}
    import os

    for root in (os.path.relpath(tree), f"{tree}/../tree/", f"file://{tree}"):
        assert {(r["repo"], r["path"]) for r in corpus.corpus_scan(spark, root).collect()} == {(r["repo"], p) for p, r in rows.items()}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus.corpus_scan(spark, tree + "/missing").collect()


def test_test_files_listed_per_pattern(spark, make_files):
    files = make_files({"test_a.py": "", "b_test.py": "", "test_c_test.py": "", "d.py": ""})
    rows = [(r["path"], r["name_pattern"]) for r in corpus.test_file_scan(files, ordered=True).collect()]
    assert sorted(rows) == [("p/b_test.py", "*_test.py"), ("p/test_a.py", "test_*.py"), ("p/test_c_test.py", "*_test.py"), ("p/test_c_test.py", "test_*.py")]


def test_snapshot_manifest_and_tables(spark, make_files, tmp_path):
    files = make_files({"a.py": "1", "b.pyc": "2", "node_modules/c.js": "3", "d/.DS_Store": "4"})
    assert [r["path"] for r in corpus.snapshot_manifest(files).collect()] == ["p/a.py"]
    corpus.write_snapshot(files, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).select("path").collect()[0][0] == "p/a.py"


def test_first_files_are_limited_before_the_shuffle(spark, tmp_path):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("repo"), F.format_string("%05d", "id").alias("path"))
    rows.write.parquet(str(tmp_path / "f"))
    got = corpus.first_n_files(spark.read.parquet(str(tmp_path / "f")), 100)
    assert {r["repo"]: r["n"] for r in got.groupBy("repo").agg(F.count("*").alias("n")).collect()} == {"hot": 100, "cold": 100}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in plan


def writes(spark, *rows):
    at = dt.datetime(2024, 1, 1)
    data = [(p, d, n, m, at + dt.timedelta(minutes=i), i) for i, (p, d, n, m) in enumerate(rows)]
    return spark.createDataFrame(data, schemas.DECISIONS + ", write_id long")


def test_decision_store(spark, tmp_path):
    state = stores.upsert(stores.empty_store(spark), writes(spark, ("A", "skip", "why", "high"), ("B", "manual", None, None), ("A", "auto_apply", "", None)))
    a = state.filter("pattern_id = 'A'").first()
    assert (a["decision"], a["notes"], a["min_confidence"]) == ("auto_apply", "why", "high")
    path = str(tmp_path / "d")
    stores.save_decisions(state, path)
    again = stores.upsert(stores.load_decisions(spark, path), writes(spark, ("B", "skip", "later", None)))
    assert {r["pattern_id"]: r["decision"] for r in again.collect()} == {"A": "auto_apply", "B": "skip"}
    assert [r[0] for r in stores.should_auto_apply(stores.load_decisions(spark, path)).collect()] == ["A"]
    stores.clear_decisions(spark, path)
    assert stores.load_decisions(spark, path).count() == 0
    assert stores.load_decisions(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "broken").write_text("{not json\n")
    assert stores.load_decisions(spark, str(tmp_path / "broken")).count() == 0


def test_analyze_then_apply(spark, tree, tmp_path):
    files = corpus.read_tree(spark, tree).drop("raw")
    out = str(tmp_path / "report")
    with pytest.raises(FileNotFoundError):
        flows.apply(files, out, RULES)
    flows.analyze(files, out)
    found = stores.load_report(spark, out)
    assert sorted(r["id"] for r in found.collect()) == ["IMPORT_AUTOGEN", "IMPORT_SEMANTIC_KERNEL"]
    stats = {r["repo"]: r["total_files"] for r in spark.read.json(f"{out}/statistics").collect()}
    assert stats == {"one": 1, "two": 4}
    done = {r["path"]: r["new_content"] for r in flows.apply(files, out, RULES).filter("changed").collect()}
    assert set(done) == {"one/main.py", "two/pkg/agent.py"} and "AgentFrameworkClient" in done["one/main.py"]
    answers = spark.createDataFrame([("two", "two/pkg/agent.py", "y")], "repo string, path string, decision string")
    reviewed = flows.apply(files, out, RULES, mode="review", by_file=answers)
    assert [r["path"] for r in reviewed.filter("changed").collect()] == ["two/pkg/agent.py"]


def test_report_lines_can_be_written(spark, make_files, tmp_path):
    from transmuta.operators import reports

    files = detect.with_detections(make_files({"a.py": "from autogen import x"}))
    reports.write_markdown(reports.report_lines(files), str(tmp_path / "md"))
    text = "".join(p.read_text() for p in (tmp_path / "md" / "repo=p").glob("*.txt"))
    assert text.startswith("# Migration Report\n\n## Statistics\n- Total files: 1\n- Patterns detected: 1\n\n## Detected Patterns\n- **IMPORT_AUTOGEN**: import")


T0 = dt.datetime(2024, 1, 1)


def log(spark, *rows):
    """rows: (minute, task, kind, group, passed, failed, criterion, met, review)"""
    data = [(i, T0 + dt.timedelta(minutes=r[0]), *r[1:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, tasks.EVENT_COLUMNS)


START = lambda m, t: (m, t, "start", None, None, None, None, None, None)
DONE = lambda m, t: (m, t, "complete", None, None, None, None, None, None)
CRIT = lambda m, t, c, met, rev=False: (m, t, "criterion", None, None, None, c, met, rev)
RES = lambda m, t, g, p, f: (m, t, "result", g, p, f, None, None, None)
ERR = lambda m, t: (m, t, "error", None, None, None, None, None, None)

EVENTS = (
    START(0, "a"), CRIT(1, "a", "x", False), CRIT(2, "a", "x", True), RES(3, "a", "unit", 5, 0), DONE(4, "a"),
    START(0, "b"), CRIT(1, "b", "x", True), ERR(2, "b"), DONE(3, "b"),
    START(0, "c"), RES(1, "c", "e2e", 1, 2),
    CRIT(0, "d", "x", True), DONE(1, "d"),
    START(0, "e"), ERR(1, "e"), START(2, "e"), CRIT(3, "e", "y", True, True), CRIT(4, "e", "z", True), DONE(5, "e"),
)


def test_task_outcomes(spark):
    out = {r["task_id"]: r for r in tracker.task_outcome(tracker.task_state(log(spark, *EVENTS))).collect()}
    assert {t: r["status"] for t, r in out.items()} == {"a": "completed", "b": "failed", "c": "in_progress", "e": "completed"}
    assert out["a"]["met"] == ["unit_tests_all_passed", "x"] and out["a"]["unit"]["passed"] == 5
    assert out["c"]["not_met"] == ["e2e_tests_all_passed"] and out["e"]["review"] == ["y"]
    strict = {r["task_id"]: r["status"] for r in tracker.task_outcome(tracker.task_state(log(spark, *EVENTS)), strict=True).collect()}
    assert strict["a"] == "failed"
    seconds = {r["task_id"]: r["seconds"] for r in tracker.task_duration(tracker.task_outcome(tracker.task_state(log(spark, *EVENTS)))).collect()}
    assert seconds == {"a": 240.0, "b": 180.0, "c": None, "e": 180.0}


def test_stream_over_several_files_agrees_with_batch(spark, tmp_path):
    for i in range(0, len(EVENTS), 4):
        log(spark, *EVENTS).filter((F.col("event_id") >= i) & (F.col("event_id") < i + 4)).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    source = str(tmp_path / "in" / "*")
    events = tasks.read_events(spark, source, max_files=1)
    got = tasks.task_events_stream(events, str(tmp_path / "run"))
    want = tracker.task_outcome(tracker.task_state(spark.read.schema(tasks.EVENT_COLUMNS).parquet(source)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_windowed_activity_runs_on_a_stream(spark, tmp_path):
    log(spark, *EVENTS).write.parquet(str(tmp_path / "in"))
    q = (tasks.windowed_activity(tasks.read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory")
         .queryName("activity").trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.sql("select sum(n) from activity").first()[0] == len(EVENTS)


def test_task_documents_are_written_per_task(spark, tmp_path):
    out = tracker.task_outcome(tracker.task_state(log(spark, *EVENTS)))
    tracker.write_task_results(out, str(tmp_path / "r"))
    assert {r["task_id"] for r in spark.read.json(str(tmp_path / "r" / "tasks")).select("task_id").collect()} == {"a", "b", "c", "e"}
    summary = {(r["section"], r["name"]): r["value"] for r in spark.read.json(str(tmp_path / "r" / "summary")).collect()}
    assert summary[("tasks", "total")] == 4 and summary[("tasks", "completed")] == 2


def test_log_parsing(spark):
    logs = ["== 3 failed, 7 passed in 2s ==\nTOTAL  10  1  90%", "12 passed", "x 45.5% y", "", "1 error"]
    df = spark.createDataFrame([(s, 0) for s in logs], "log string, exit_code int")
    rows = [(r["passed"], r["failed"], r["errors"], r["coverage"], r["total"]) for r in tracker.log_outcomes(df).collect()]
    assert rows == [(7, 3, 0, 90.0, 10), (12, 0, 0, 0.0, 12), (0, 0, 0, 45.5, 0), (0, 0, 0, 0.0, 0), (0, 0, 1, 0.0, 1)]
