"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is stored as its difference from the mean of all vectors: the length, the signs of the rotated direction as packed bits,
and the inner product of the direction with its own sign vector. From a rotated query these give an estimate of the inner
product with the vector and a bound of the error that holds with high probability. A vector is reranked by its exact
inner product unless even its upper bound is below the k-th best lower bound of the block, or below the k-th best exact score
among a sample of the rows. The rotation is random but
fixed by the seed, so reruns agree. Every row is indexed; nothing is fitted but the mean, over all rows.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and null ids, take no part;
ties go to the smaller id; rows that share the query's id are not its candidates; a query with fewer candidates than
asked for returns all; an empty table gives none. Scores are exact inner products in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from transmuta.functions.materialize import Written
from transmuta.llm import vectors

ERROR = 1.9  # standard errors by which a bound differs from the estimate
SEED = 20


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng((SEED, dim)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            _, x = vectors.unpack(row["dim"], row["ids"], row["data"])
            yield pa.RecordBatch.from_pydict({"dim": pa.array([row["dim"]] * row["dim"], pa.int32()), "place": pa.array(range(row["dim"]), pa.int32()),
                                              "total": pa.array(x.sum(axis=0)), "n": pa.array([len(x)] * row["dim"], pa.int64())})


def means(blocks: DataFrame) -> dict[int, np.ndarray]:
    """The mean vector per dimension: as many numbers as a vector has components come back."""
    rows = blocks.mapInArrow(_sums, "dim int, place int, total double, n long").groupBy("dim", "place") \
        .agg((F.sum("total") / F.sum("n")).alias("mean")).orderBy("dim", "place").collect()
    found: dict[int, list[float]] = {}
    for r in rows:
        found.setdefault(r["dim"], []).append(r["mean"])
    return {d: np.array(v) for d, v in found.items()}


def _codes(center: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                _, x = vectors.unpack(dim, row["ids"], row["data"])
                apart = x - center[dim]
                length = np.sqrt((apart * apart).sum(axis=1))
                turned = (apart / np.where(length > 0, length, 1)[:, None]) @ rotation(dim)
                agree = np.abs(turned).sum(axis=1) / np.sqrt(dim)
                yield pa.RecordBatch.from_pydict({
                    "dim": pa.array([dim], pa.int32()), "ids": pa.array([row["ids"]], pa.binary()), "data": pa.array([row["data"]], pa.binary()), "bound": pa.array([None], pa.binary()),
                    "bits": pa.array([np.packbits(turned > 0, axis=1).tobytes()], pa.binary()),
                    "length": pa.array([length.tobytes()], pa.binary()), "agree": pa.array([agree.tobytes()], pa.binary())})
    return run


def signs_of(bits: np.ndarray, dim: int) -> np.ndarray:
    return np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1


def bounds(queries: np.ndarray, center: np.ndarray, signs: np.ndarray, length: np.ndarray, agree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, error) of the inner products, one row per query."""
    dim = queries.shape[1]
    turned = (queries @ rotation(dim)).astype(np.float32)
    agree = np.where(agree > 0, agree, 1)
    estimate = (turned @ signs.T) * (length / agree / np.sqrt(dim)) + (queries @ center)[:, None]
    spread = length * np.sqrt(np.maximum(0, 1 - agree * agree)) / agree / np.sqrt(max(1, dim - 1))
    return estimate, ERROR * np.sqrt((queries * queries).sum(axis=1))[:, None] * spread + 1e-6 * np.abs(estimate)


def _open(row: dict) -> tuple[np.ndarray, ...]:
    ids, x = vectors.unpack(row["dim"], row["ids"], row["data"])
    return (ids, x, signs_of(np.frombuffer(row["bits"], np.uint8).reshape(len(ids), -1), row["dim"]), np.frombuffer(row["length"], np.float64), np.frombuffer(row["agree"], np.float64))


def _best(center: dict[int, np.ndarray], k: int):
    def best(block: tuple[np.ndarray, ...], dim: int, query_ids: np.ndarray, asked: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
        ids, x, signs, length, agree = block
        estimate, error = bounds(asked, center[dim], signs, length, agree)
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for i, own in enumerate(query_ids.tolist()):
            least = known[i]
            if len(ids) > k:
                low = np.where(ids == own, -np.inf, estimate[i] - error[i])
                least = max(least, np.partition(low, len(ids) - k)[len(ids) - k])
            may = np.flatnonzero((estimate[i] + error[i] >= least) & (ids != own))
            scores = (x[may] * asked[i]).sum(axis=1)
            chosen = vectors.top(ids[may], scores, k)
            out.append((np.full(len(chosen), own), ids[may][chosen], scores[chosen]))
        return tuple(np.concatenate(c) for c in zip(*out))
    return best


def _seeds(k: int):
    """The k best of a block of the sample, by exact inner products."""
    def best(block: tuple[np.ndarray, np.ndarray], dim: int, query_ids: np.ndarray, asked: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, ...]:
        ids, x = block
        out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for own, q in zip(query_ids.tolist(), asked):
            scores = np.where(ids == own, -np.inf, x @ q)
            near = np.argpartition(-scores, k - 1)[:k] if len(ids) > k else np.arange(len(ids))
            near = near[ids[near] != own]
            out.append((np.full(len(near), own), ids[near], scores[near]))
        return tuple(np.concatenate(c) for c in zip(*out))
    return best


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each query; rows and queries: vec_id, embedding."""
    good = vectors.usable("embedding", zero=False) & F.col("vec_id").isNotNull()
    rows, queries = (x.select("vec_id", "embedding").filter(good) for x in (rows, queries))
    blocks = Written(vectors.pack(rows, vectors.BLOCK), "vector-blocks")
    center = means(blocks.df)
    index = vectors.indexed(blocks.df.mapInArrow(_codes(center), f"{vectors.PACKED}, bits binary, length binary, agree binary"), "code-index")
    blocks.drop()
    bounded, _ = vectors.with_bounds(queries, rows, _seeds(k), k, pa.float64())
    return vectors.search(vectors.pack(bounded, vectors.QUERIES), index.df, _open, _best(center, k), k, pa.float64())
