"""Blocks of vectors: the unit in which vector searches store, move and compare them.

A stated set of queries meets every block once. A block of rows moves once, to the task that searches it; the queries, a small
share of the rows, are copied to it in blocks of their own. A task unpacks a block and streams the queries past it, and only the best
of a pair leave it. Vectors of different dimensions are kept apart and never compared.

Queries carry a bound: a score that k candidates are known to reach, so that nothing below it matters. It comes from an exact
search of a share of the rows, chosen by a hash of the id; every row is searched afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from transmuta.functions.joins import salted_join
from transmuta.functions.materialize import Written
from transmuta.llm.samples import below_share

BLOCK = 4096
QUERIES = 512
SEEDS = 1 / 16  # share of the rows that bounds come from
PACKED = "dim int, ids binary, data binary, bound binary"


def usable(column: str, zero: bool = True) -> Column:
    """Not null or empty, no null or non-finite component; zero: whether all zeros will do."""
    x = F.col(column)
    ok = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(ok if zero else ok & F.exists(x, lambda v: v != 0), F.lit(False))


def pack(rows: DataFrame, most: int) -> DataFrame:
    """Rows (vec_id, embedding, perhaps bound) as blocks of one dimension: ids as int64, data as float64 rows, bounds as float64."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            ids, vectors = batch["vec_id"].to_numpy(), batch["embedding"]
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy().astype(np.float64)
            bound = batch["bound"].to_numpy()
            starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
            for dim in np.unique(sizes).tolist():
                mine = np.flatnonzero(sizes == dim)
                held.setdefault(dim, []).append((ids[mine], flat[starts[mine][:, None] + np.arange(dim)], bound[mine]))
                while sum(len(i) for i, *_ in held[dim]) >= most:
                    yield _packed(dim, held, most)
        for dim in held:
            while sum(len(i) for i, *_ in held[dim]):
                yield _packed(dim, held, most)
    bound = F.coalesce(F.col("bound").cast("double"), F.lit(float("-inf"))) if "bound" in rows.columns else F.lit(float("-inf"))
    return rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), bound.alias("bound")).mapInArrow(run, PACKED)


def _packed(dim: int, held: dict, most: int) -> pa.RecordBatch:
    parts = [np.concatenate(x) for x in zip(*held[dim])]
    held[dim] = [tuple(x[most:] for x in parts)]
    return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), **{n: pa.array([x[:most].tobytes()], pa.binary()) for n, x in zip(("ids", "data", "bound"), parts)}})


def unpack(dim: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, dim)


def indexed(blocks: DataFrame, name: str) -> Written:
    """Packed blocks, and what else an index keeps of them, as a table with a number for each block."""
    return Written(blocks.withColumn("block", F.monotonically_increasing_id()), name)


def search(queries: DataFrame, index: DataFrame, open_block: Callable, best: Callable, k: int, kind: pa.DataType) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query.

    queries: packed blocks; index: a table of `indexed`. open_block(row) prepares a block of the index; best(block, dim, query ids,
    query vectors, bounds) -> (query ids, vec ids, scores), at most k per query, never the query's own id.
    """
    score = "long" if pa.types.is_integer(kind) else "double"
    asked = salted_join(queries, index.select("dim", "block"), ["dim"], "inner", spread_by=["ids"])
    more = [f for f in index.schema.fields if f.name not in ("block", "dim", "ids", "data", "bound")]
    rows = index.select("block", F.lit(0).alias("asks"), "dim", "ids", "data", "bound", *[f.name for f in more]).unionByName(
        asked.select("block", F.lit(1).alias("asks"), "dim", "ids", "data", "bound", *[F.lit(None).cast(f.dataType).alias(f.name) for f in more]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if not row["asks"]:
                    block = open_block(row)
                    continue
                ids, x = unpack(row["dim"], row["ids"], row["data"])
                q, v, s = best(block, row["dim"], ids, x, np.frombuffer(row["bound"], np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, kind)], ["query_id", "vec_id", "score"])

    found = rows.repartition("block").sortWithinPartitions("block", "asks").mapInArrow(run, f"query_id long, vec_id long, score {score}")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def with_bounds(queries: DataFrame, rows: DataFrame, best: Callable, k: int, kind: pa.DataType) -> tuple[DataFrame, Written]:
    """queries with the k-th best score among a share of the rows, where k are found; and the table to be dropped after use.

    best: as in `search`, over (ids, vectors) of a block.
    """
    seeds = indexed(pack(rows.filter(below_share(F.xxhash64("vec_id"), SEEDS)), BLOCK), "seeds")
    found = search(pack(queries, QUERIES), seeds.df, lambda row: unpack(row["dim"], row["ids"], row["data"]), best, k, kind)
    least = found.groupBy("query_id").agg(F.min("score").alias("bound"), F.count("*").alias("n")).filter(F.col("n") == k)
    bounds = least.select(F.col("query_id").alias("vec_id"), F.col("bound").cast("double").alias("bound"))
    return queries.join(bounds, "vec_id", "left"), seeds


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, falling(scores)))[:k]


def falling(scores: np.ndarray) -> np.ndarray:
    """Sorts against the scores; the least long has no negative."""
    return ~scores if scores.dtype.kind == "i" else -scores
