"""Runs that are stopped and go on, and facts that are not parsed twice."""

import os

from pyspark.sql import functions as F

from transmuta.functions import facts
from transmuta.operators import resume, rewrite
from transmuta.plans.base import RULES
from transmuta.sources import fact_store


def projects(spark, n=12):
    rows = [(f"r{i}", f"r{i}/a{k}.py", f"from semantic_kernel import Kernel\nkernel = Kernel()\nx = {i * k}\n") for i in range(n) for k in range(3)] + [("quiet", "quiet/a.py", "x = 1\n")]
    return spark.createDataFrame(rows, "repo string, path string, content string")


def whole(files):
    return sorted(map(str, rewrite.changed_files(rewrite.migrate(files, RULES)).select("repo", "path", "applied", F.col("new_content").alias("content")).collect()))


def test_a_stopped_migration_goes_on_where_it_stopped(spark, tmp_path):
    files, out = projects(spark), str(tmp_path)
    assert resume.migrate(files, RULES, out, waves=5, stop_after=2) == 2
    first = {r["repo"]: r["run"] for r in resume.manifest(spark, out).collect()}
    assert 0 < len(first) < 13
    # a wave that wrote files and died before its commit
    spark.createDataFrame([("r0", "r0/a0.py", ["X"], "half")], "repo string, path string, applied array<string>, content string").write.parquet(f"{out}/files/run=dead")
    resume.migrate(files, RULES, out, waves=5)
    assert sorted(map(str, resume.migrated(spark, out).collect())) == whole(files)
    after = {r["repo"]: r["run"] for r in resume.manifest(spark, out).collect()}
    assert len(after) == 13 and all(after[r] == run for r, run in first.items())  # finished projects were left alone
    assert resume.migrate(files, RULES, out, waves=5) == 0


def test_changed_inputs_and_rules_are_done_again(spark, tmp_path):
    files, out = projects(spark), str(tmp_path)
    resume.migrate(files, RULES, out, waves=3)
    before = resume.manifest(spark, out).count()
    edited = files.withColumn("content", F.when(F.col("path") == "r3/a1.py", "x = 3\n").otherwise(F.col("content")))
    resume.migrate(edited, RULES, out, waves=3)
    assert resume.manifest(spark, out).count() == before + 1
    assert sorted(map(str, resume.migrated(spark, out).collect())) == whole(edited)
    more = RULES.plus([{"id": "MINE", "pattern": "never_there", "replacement": "x"}])
    assert resume.migrate(edited, more, out, waves=3) == 3 and resume.manifest(spark, out).count() == 2 * before + 1


def test_a_listing_spares_reading_finished_projects(spark, tmp_path):
    files, out = projects(spark), str(tmp_path)
    stamps = files.select("repo", "path", F.lit("1").alias("stamp"))
    resume.migrate(files, RULES, out, waves=2, stamps=stamps)
    broken = files.withColumn("content", F.raise_error(F.lit("read")).cast("string"))
    assert resume.migrate(broken, RULES, out, waves=2, stamps=stamps) == 0
    assert resume.migrate(files.limit(0), RULES, str(tmp_path / "none")) == 0


def test_only_new_contents_are_parsed(spark, tmp_path):
    store = str(tmp_path)
    files = spark.range(400).select(F.lit("p").alias("repo"), F.concat(F.lit("p/f"), "id", F.lit(".py")).alias("path"),
                                    F.when(F.col("id") < 150, "import os\n").when(F.col("id") == 399, None).otherwise(F.concat(F.lit("import m"), "id", F.lit("\nclass A(B): pass\n"))).alias("content"))
    plain = lambda f: sorted(map(str, facts.code_facts(f).collect()))
    assert sorted(map(str, fact_store.code_facts(files, store).collect())) == plain(files)
    assert fact_store.stored_facts(spark, store).count() == 250  # a vendored text is one entry
    edited = files.withColumn("content", F.when(F.col("path").isin("p/f200.py", "p/f201.py", "p/f5.py"), "y = 2\n").otherwise(F.col("content")))
    parts = set(os.listdir(store))
    assert sorted(map(str, fact_store.code_facts(edited, store).collect())) == plain(edited)
    new = (set(os.listdir(store)) - parts).pop()
    assert spark.read.parquet(f"{store}/{new}").count() == 1
    # a part without its mark, as a killed writer leaves it, is parsed again
    os.remove(f"{store}/{new}/_SUCCESS")
    assert fact_store.stored_facts(spark, store).count() == 250
    assert sorted(map(str, fact_store.code_facts(edited, store).collect())) == plain(edited)
    assert fact_store.code_facts(files.limit(0), str(tmp_path / "none")).count() == 0
