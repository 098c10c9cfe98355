"""A migration that can be stopped at any time and run again.

Projects are migrated in waves. A wave writes its changed files below a folder of its own and then, as its commit, one line for
each project: the digest of what was read and the version of the rules. A rerun leaves out the projects whose line has the
same digest and version, so it starts where the last one stopped, and does those again whose files or rules have changed. What
a wave wrote without committing it is never read.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from transmuta.functions.joins import may_be_member
from transmuta.functions.materialize import Written
from transmuta.operators import rewrite
from transmuta.sources.catalog import RuleSet

MANIFEST = "repo string, digest string, version string, run string, committed timestamp"


def input_digests(stamped: DataFrame) -> DataFrame:
    """repo, digest: of all files of a project in any order. stamped: repo, path, stamp (what tells two states of a file apart)."""
    own = F.xxhash64("path", "stamp")
    other = F.xxhash64(F.lit("second"), "stamp", "path")
    parts = F.concat_ws("-", F.count("*"), F.sum(own.cast("decimal(38,0)")), F.sum(other.cast("decimal(38,0)")))
    return stamped.groupBy("repo").agg(parts.alias("digest"))


def rules_version(rules: RuleSet, mode: str) -> str:
    return hashlib.sha256(repr((mode, tuple(rules))).encode()).hexdigest()[:16]


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """The lines of all committed waves."""
    try:
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{out}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def migrate(files: DataFrame, rules: RuleSet, out: str, waves: int = 16, mode: str = "auto", stamps: DataFrame | None = None, stop_after: int | None = None) -> int:
    """Migrate the projects that are not finished; the number of waves that were committed.

    stamps: repo, path, stamp from a listing or a snapshot manifest, so that finished projects are not even read; by default
    their texts are. A project is in one wave, so a project larger than a wave is a wave. `stop_after` ends the run early, as a failure would.
    """
    spark = files.sparkSession
    version = rules_version(rules, mode)
    stamped = stamps if stamps is not None else files.select("repo", "path", F.sha2("content", 256).alias("stamp"))
    finished = manifest(spark, out).filter(F.col("version") == version).select("repo", "digest")
    pending = Written(input_digests(stamped).join(finished, ["repo", "digest"], "left_anti").withColumn("wave", F.pmod(F.xxhash64("repo"), F.lit(waves))), "pending")
    committed = 0
    for wave in sorted(r["wave"] for r in pending.df.select("wave").distinct().collect()):  # as many as there are waves
        if stop_after is not None and committed >= stop_after:
            break
        run = uuid.uuid4().hex
        todo = pending.df.filter(F.col("wave") == wave)
        # one row a project; the filter keeps files of other projects out of the join
        mine = files.filter(may_be_member(todo, ["repo"])).join(todo.select("repo"), "repo", "left_semi")
        changed = rewrite.changed_files(rewrite.migrate(mine, rules, mode))
        changed.select("repo", "path", "applied", F.col("new_content").alias("content")).write.parquet(f"{out}/files/run={run}")
        todo.select("repo", "digest", F.lit(version).alias("version"), F.lit(run).alias("run"), F.current_timestamp().alias("committed")).write.parquet(f"{out}/manifest/run={run}")
        committed += 1
    pending.drop()
    return committed


def migrated(spark: SparkSession, out: str) -> DataFrame:
    """repo, path, applied, content of the changed files of every project as last committed."""
    last = manifest(spark, out).groupBy("repo").agg(F.max_by("run", F.struct("committed", "run")).alias("run"))
    files = spark.read.schema("repo string, path string, applied array<string>, content string, run string").parquet(f"{out}/files")
    return files.join(last, ["repo", "run"], "left_semi").select("repo", "path", "applied", "content")
