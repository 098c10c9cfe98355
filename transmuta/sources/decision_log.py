"""A store of rule decisions that several writers use at once.

A writer appends its decisions as a part of its own; no writer touches what another has written, so none is lost and there is
nothing to lock. What a rule's decision is follows from all parts: per rule and field the write that is latest by time and
number. Compaction merges the parts into a snapshot that names them; a part that the newest complete snapshot does not name is read
beside it. A snapshot is complete once its list of parts is, which is written last, so a compaction that dies leaves the
store as it was. Parts and snapshots are deleted one compaction late, when readers of the snapshot before are done with them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from transmuta import schemas

WRITES = f"{schemas.DECISIONS}, write_id long"
_AT = "last_updated:timestamp, write_id:bigint"
ENTRIES = f"pattern_id string, decided struct<{_AT}, decision:string>, noted struct<{_AT}, notes:string>, limited struct<{_AT}, min_confidence:string>, n_writes long"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _complete(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that match and hold a success mark, by name."""
    fs, at = _fs(spark, f"{pattern}/_SUCCESS")
    return sorted(m.getPath().getParent().toString() for m in fs.globStatus(at) or [])


def append(writes: DataFrame, path: str) -> None:
    """Add decisions (pattern_id, decision, notes, min_confidence, last_updated, write_id) as one part."""
    writes.select(*(c.split()[0] for c in WRITES.split(", "))).write.parquet(f"{path}/log/{uuid.uuid4().hex}")


def _entries(writes: DataFrame) -> DataFrame:
    """One entry per rule; entries of any parts combine to the entry of all."""
    def latest(field, name):
        given = F.lit(True) if field == "decision" else F.col(field).isNotNull() & (F.col(field) != "")
        return F.max(F.when(given, F.struct("last_updated", "write_id", field))).alias(name)
    return writes.groupBy("pattern_id").agg(latest("decision", "decided"), latest("notes", "noted"), latest("min_confidence", "limited"), F.count("*").alias("n_writes"))


def _merged(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[str], str | None]:
    """Entries of all decisions; the parts they come from, those the newest snapshot names, and that snapshot."""
    snapshots = [p.rsplit("/", 1)[0] for p in _complete(spark, f"{path}/snapshots/*/parts")]
    newest = max(snapshots, default=None)
    named = [r["part"] for r in spark.read.schema("part string").parquet(f"{newest}/parts").collect()] if newest else []
    parts = _complete(spark, f"{path}/log/*")
    fresh = [p for p in parts if p.rsplit("/", 1)[1] not in named]
    entries = _entries(spark.read.schema(WRITES).parquet(*fresh)) if fresh else spark.createDataFrame([], ENTRIES)
    if newest:
        entries = entries.unionByName(spark.read.schema(ENTRIES).parquet(f"{newest}/entries"))
    merged = entries.groupBy("pattern_id").agg(*[F.max(c).alias(c) for c in ("decided", "noted", "limited")], F.sum("n_writes").alias("n_writes"))
    return merged, parts, named, newest


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """pattern_id, decision, notes, min_confidence, last_updated, n_writes as all writers have left them; empty without a store."""
    merged, *_ = _merged(spark, path)
    return merged.select("pattern_id", "decided.decision", "noted.notes", "limited.min_confidence", "decided.last_updated", "n_writes")


def compact(spark: SparkSession, path: str) -> None:
    """Merge what is there into a new snapshot; writers and readers go on meanwhile."""
    merged, parts, named, newest = _merged(spark, path)
    number = int(newest.rsplit("/", 1)[1].split("-")[0]) + 1 if newest else 0
    target = f"{path}/snapshots/{number:08d}-{uuid.uuid4().hex}"
    merged.write.parquet(f"{target}/entries")
    names = [p.rsplit("/", 1)[1] for p in parts]
    spark.createDataFrame([(n,) for n in names], "part string").coalesce(1).write.parquet(f"{target}/parts")
    old = [f"{path}/log/{n}" for n in named] + [p.rsplit("/", 1)[0] for p in _complete(spark, f"{path}/snapshots/*/parts") if newest and p.rsplit("/", 1)[0] < newest]
    for p in old:
        fs, at = _fs(spark, p)
        fs.delete(at, True)
