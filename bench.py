"""Benchmark: wall-clock of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then BENCH_RUNS times (default 2); the median counts. BENCH_ALL=1 times every
registered query. The result of a query is computed in full and discarded. Tables are first written as one file per core, which is not
timed. The operators of transmuta.llm are measured by their own checks, not here.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from transmuta import local_session
from transmuta.operators import detect, outliers
from transmuta.plans.registry import QUERIES

HEADLINE = [
    "corpus_scan", "code_facts", "discover", "regex_rule_scan", "resolve_rule", "rewrite", "migrate", "line_diff", "snapshot_diff",
    "validation_summary", "metric_rates", "mapping_report", "outlier_report", "file_outlier_reasons", "issue_counts", "topk_issues",
    "test_inventory", "task_outcome", "tracker_summary", "acceptance_gates", "qa_summary", "decision_store",
]


def spread(spark, sf_dir: str, cores: int) -> str:
    """The tables with `documents` and `pages` as one file per core: a single file with one row group is one task, however many cores there are."""
    folder = tempfile.mkdtemp(prefix="bench-tables-")
    for table in os.listdir(sf_dir):
        source, target = os.path.join(sf_dir, table), os.path.join(folder, table)
        if table in ("documents.parquet", "pages.parquet") and os.path.isfile(source):
            spark.read.parquet(source).repartition(cores).write.parquet(target)
        else:
            os.symlink(source, target)
    return folder


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def analysis_seconds(spark, tree: dict[str, str]) -> float:
    """Detections and outlier verdict of one project given as {path: content}: the work the published ceilings bound."""
    files = spark.createDataFrame([("p", f"p/{p}", c) for p, c in tree.items()], "repo string, path string, content string")
    start = time.perf_counter()
    detect.discover(files).write.format("noop").mode("overwrite").save()
    outliers.outlier_report(outliers.outlier_type_counts(outliers.file_flags(files))).collect()
    return round(time.perf_counter() - start, 3)


def ceilings(spark) -> dict[str, dict[str, float]]:
    """Our time for each published analysis ceiling, next to the ceiling in seconds."""
    use = "from semantic_kernel import Kernel\n# comment {}\n"
    cases = {
        "100_files": ({f"f{i}.py": use.format(i) for i in range(100)}, 60),
        "file_of_50000_lines": ({"big.py": "from semantic_kernel import Kernel\n" + "# line\n" * 50_000}, 120),
        "50_levels_of_folders": ({"/".join(f"l{i}" for i in range(50)) + "/deep.py": use}, 60),
        "200_files": ({f"f{i}.py": use.format(i) for i in range(200)}, 60),
        "1_file": ({"a.py": use}, 5),
    }
    return {name: {"seconds": analysis_seconds(spark, tree), "ceiling": top} for name, (tree, top) in cases.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = local_session(cpus, "bench")
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    tables = spread(spark, sf_dir, int(cpus))
    times = {}
    for name in names:
        run(spark, name, tables)
        times[name] = round(statistics.median(run(spark, name, tables) for _ in range(runs)), 4)
    bounds = ceilings(spark)
    rates = {f"{n}_files_per_sec": round(files / times[n], 1) for n in ("code_facts", "regex_rule_scan", "rewrite", "migrate") if n in times}
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "files": files, **rates, "analysis_ceilings": bounds}))
    spark.stop()


if __name__ == "__main__":
    main()
