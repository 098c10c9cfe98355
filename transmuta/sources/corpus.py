"""Scans that produce `files(repo, path, content)` and the selections made on a file table."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from transmuta.functions import text

# fixed values: directory names that are never scanned
SKIP_DIRS = ("__pycache__", ".git", "venv", "env")
# fixed values: default exclusions of a directory validation
DEFAULT_EXCLUDES = ("**/__pycache__/*", "**/*.pyc", "**/.git/*")
# fixed values: names and suffixes left out of a project copy
COPY_EXCLUDES = (".git", "__pycache__", ".pytest_cache", ".mypy_cache", "*.pyc", "*.pyo", ".DS_Store", "node_modules",
                 "venv", "env")


def read_tree(spark: SparkSession, root: str, glob: str = "*.py", repo: str | None = None) -> DataFrame:
    """Files below a directory as (repo, path, raw, content); content is NULL where the bytes are not UTF-8.

    Without `repo`, each directory directly below the root is one project. A missing root fails the read.
    """
    # the scan returns qualified paths, so the root is qualified by the same file system before it is cut off
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().normalize().getPath().rstrip("/")
    full = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?/*", "/")
    inside = F.when(F.startswith(full, F.lit(base + "/")), full).otherwise(F.raise_error(F.concat(F.lit(f"not below {base}: "), full)))
    rel = F.substring(inside, F.lit(len(base) + 2), F.length(full))
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
        .select(rel.alias("path"), F.col("content").alias("raw"))
    )
    project = F.lit(repo) if repo is not None else F.split("path", "/")[0]
    return found.select(
        project.alias("repo"), "path", "raw",
        text.universal_newlines(F.try_validate_utf8(F.col("raw").cast("string"))).alias("content"),
    )


def name_matches(path: Column, glob: str) -> Column:
    """Shell pattern on the file name."""
    return text.basename(path).rlike("(?s)" + fnmatch.translate(glob).replace(r"\Z", r"\z"))


def select_files(files: DataFrame, glob: str = "*.py", skip: Sequence[str] = SKIP_DIRS) -> DataFrame:
    """Files whose name matches and whose path below the project root has no skipped component."""
    rel = text.relative(F.col("repo"), F.col("path"))
    return files.filter(name_matches(rel, glob) & ~text.any_part(rel, skip))


def corpus_scan(spark: SparkSession, root: str, glob: str = "*.py", skip: Sequence[str] = SKIP_DIRS,
                repo: str | None = None) -> DataFrame:
    """Read a tree and leave out skipped directories."""
    return select_files(read_tree(spark, root, glob, repo), glob, skip)


def _component(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        ch = glob[i]
        close = glob.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            while glob[i + 1: i + 2] == "*":
                i += 1
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif close > 0:
            inner = glob[i + 1: close]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = close
        else:
            out += re.escape(ch)
        i += 1
    return out


def glob_regex(glob: str) -> str:
    """Whole-path pattern in which `**` spans any number of directories."""
    comps = glob.split("/")
    out = ""
    for i, comp in enumerate(comps):
        last = i == len(comps) - 1
        if comp == "**":
            out += ".*" if last else "(?:[^/]+/)*"
        else:
            out += _component(comp) + ("" if last else "/")
    return f"^{out}$"


def match_regex(glob: str) -> str:
    """Right-anchored pattern in which `**` is one component, as in `PurePath.match`."""
    return "(?:^|/)" + "/".join(_component(c) if c != "**" else "[^/]+" for c in glob.split("/")) + "$"


def glob_scan(files: DataFrame, pattern: str = "**/*.py", exclude: Sequence[str] = DEFAULT_EXCLUDES) -> DataFrame:
    """Files matching an include glob and none of the exclusions, both compiled to regexes on the driver."""
    rel = text.relative(F.col("repo"), F.col("path"))
    keep = rel.rlike(glob_regex(pattern))
    for glob in exclude:
        keep &= ~F.col("path").rlike(match_regex(glob))
    return files.filter(keep)


def test_file_scan(files: DataFrame, patterns: Sequence[str] = ("test_*.py", "*_test.py"), ordered: bool = False) -> DataFrame:
    """One row per (file, matching name pattern): a name that matches two patterns is listed twice."""
    hits = F.array_compact(F.array(*[F.when(name_matches(F.col("path"), p), F.lit(p)) for p in patterns]))
    out = files.withColumn("name_pattern", F.explode(hits))
    return out.orderBy("repo", "path") if ordered else out


def sorted_files(files: DataFrame) -> DataFrame:
    """Total order by path; a range-partitioned sort of keys only, so select narrow columns first."""
    return files.orderBy("repo", "path")


def first_n_files(files: DataFrame, n: int = 100) -> DataFrame:
    """The first n files of each project in path order.

    `row_number() <= n` lets Spark keep n rows per project in every map task before the shuffle, so a project that
    holds a third of all files still sends at most n rows per task.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("repo").orderBy("path")
    return files.withColumn("file_rank", F.row_number().over(w)).filter(F.col("file_rank") <= n)


def snapshot_manifest(files: DataFrame, exclude: Sequence[str] = COPY_EXCLUDES) -> DataFrame:
    """Files that belong to a project copy: no excluded path component, no excluded suffix."""
    suffixes = [e[1:] for e in exclude if e.startswith("*")]
    rel = text.relative(F.col("repo"), F.col("path"))
    return files.filter(~text.any_part(rel, list(exclude)) & ~text.suffix(F.col("path")).isin(suffixes))


def write_snapshot(files: DataFrame, path: str, exclude: Sequence[str] = COPY_EXCLUDES) -> None:
    """Write the copy set partitioned by project.

    The rebalance hint lets adaptive execution split a large project over many tasks by size and pack small ones.
    """
    kept = snapshot_manifest(files, exclude).hint("rebalance", F.col("repo"))
    kept.write.mode("overwrite").partitionBy("repo").parquet(path)


def write_snapshot_table(files: DataFrame, table: str, buckets: int, exclude: Sequence[str] = COPY_EXCLUDES) -> None:
    """Write the copy set bucketed by (repo, path): comparing two such tables needs no shuffle."""
    (snapshot_manifest(files, exclude).write.mode("overwrite").bucketBy(buckets, "repo", "path").sortBy("repo", "path")
     .saveAsTable(table))
