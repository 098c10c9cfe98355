"""Exact top-k by integer inner product over an impact-ordered index, score at a time.

Components are quantised to integers, floor(256 * x). The index of a block lists, for every dimension, the vectors in order of
their value, cut into segments. A query gives each segment an impact: the most its postings can add above the least
that dimension can add. Segments of all dimensions are processed by descending impact, down to a level. An accumulator then holds
the most a vector can reach: what it has received, and for each dimension not yet seen the impact of that dimension's next
segment. Processing stops only on proof: when at most a part of the vectors can still reach the bound. Those, and only those, are rescored
exactly. The last level is no impact at all, at which every posting has been processed, so the proof always comes and the result is exact
whatever the level it came at. The level a query starts from follows where its predecessors' proofs came; that changes the work only.

The bound of a query is its k-th best score among a sample of the rows, found exactly; no vector below it can be a member. A block whose
best conceivable score is below it is skipped. A query without a bound takes the k-th best score of a few vectors of the block.

Quantised values are whole numbers in double precision (a product with 256 is exact there). Scores are summed in doubles while all
of a block's sums are below 2**53, in Python's integers beyond; a score beyond a long is its nearest end. Accumulators
that may be rounded are given the rounding as slack, so that they only let more vectors be rescored.

Defined results: vectors that are null, empty or hold null or non-finite components, and null ids, take no part; every other
vector does, whatever its size; ties go to the smaller id; rows that share the query's id are not its candidates, other rows that
share an id are candidates each; a query with fewer candidates returns all; an empty table gives none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from transmuta.llm import vectors

LEVELS = (0.5, 0.36, 0.27, 0.2, 0.14, 0.08, 0.0)  # impact levels, as parts of the largest impact
FEW = 4  # proof is reached when k + 1/FEW of the block can still be members
SEGMENTS = 16  # of a dimension
EXACT = 2.0**53
LONG = 2**63


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(256 x) in doubles; the largest double where the product has none."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(256 * x), posinf=np.finfo(np.float64).max, neginf=-np.finfo(np.float64).max)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the vectors of each dimension in order of value."""
    for batch in batches:
        for row in batch.to_pylist():
            _, x = vectors.unpack(row["dim"], row["ids"], row["data"])
            values = quantised(x)
            order = np.argsort(values, axis=0, kind="stable").T.astype(np.uint16)
            yield pa.RecordBatch.from_pydict({"dim": pa.array([row["dim"]], pa.int32()), "ids": pa.array([row["ids"]], pa.binary()), "data": pa.array([values.tobytes()], pa.binary()),
                                              "bound": pa.array([None], pa.binary()), "postings": pa.array([order.tobytes()], pa.binary())})


class Segments:
    """Postings of a block, a row per segment: the vectors of a dimension in order of value, and those values."""

    def __init__(self, values: np.ndarray, postings: np.ndarray):
        self.values = values.astype(np.float64)
        self.dims, self.n = postings.shape
        in_order = np.take_along_axis(self.values.T, postings.astype(np.intp), axis=1)
        self.least, self.most = in_order[:, 0], in_order[:, -1]
        self.largest = float(np.abs(self.values).max(initial=0))
        # the last segment is filled up with postings of no vector, which have the dimension's largest value
        each = max(1, min(SEGMENTS, self.n // 8))
        width = -(-self.n // each)
        extra = each * width - self.n
        self.postings = np.pad(postings.astype(np.intp), ((0, 0), (0, extra)), constant_values=self.n).reshape(self.dims * each, width)
        self.in_order = np.pad(in_order, ((0, 0), (0, extra)), mode="edge").reshape(self.dims * each, width)
        self.of = np.repeat(np.arange(self.dims), each)
        self.start = len(LEVELS) - 3  # the level to begin with

    def best_conceivable(self, q: np.ndarray) -> np.ndarray:
        """Per query, the sum of the most each dimension can add."""
        with np.errstate(over="ignore", invalid="ignore"):
            return np.maximum(q * self.least, q * self.most).sum(axis=1)


def exact_scores(values: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as long."""
    if not len(values):
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        most = float(np.abs(values).max(initial=0)) * float(np.abs(q).max(initial=0)) * len(q)
    if most < EXACT:
        return (values @ q).astype(np.int64)
    whole = [int(w) for w in q.tolist()]
    sums = (sum(int(x) * w for x, w in zip(row, whole)) for row in values.tolist())
    return np.array([min(max(s, -LONG), LONG - 1) for s in sums], np.int64)


def possible_members(q: np.ndarray, block: Segments, k: int, bound: float = -np.inf, levels: Counter | None = None) -> np.ndarray:
    """Positions that may reach the bound, or without one may belong to the k best of the block; a superset of those that do.

    `levels` counts at which level the proof came.
    """
    q = q.astype(np.float64)
    n = block.n
    few = max(k + 1, n // FEW)
    with np.errstate(over="ignore", invalid="ignore"):
        low, high = block.least * q, block.most * q
        worst, span = np.minimum(low, high), np.abs(high - low)
        largest, total = float(span.max(initial=0)), float(np.abs(worst).sum() + span.sum())
    if n <= few or not largest or not np.isfinite(total):
        return np.arange(n)  # nothing to order by, or sums that doubles can't hold: all are rescored
    slack = total * 1e-12
    if bound == -np.inf:
        # any k vectors give a bound; those with the largest values where the query weighs most are good ones
        d = int(np.argmax(span))
        ahead = np.argpartition(block.values[:, d] * q[d], n - few)[n - few:]
        bound = float(np.partition(block.values[ahead] @ q, few - k)[few - k])
    weight, floor = q[block.of], worst[block.of]
    impact = np.maximum(block.in_order[:, 0] * weight, block.in_order[:, -1] * weight) - floor
    level = block.start
    while True:
        done = impact >= largest * LEVELS[level]
        # what a dimension can still add to a vector not seen in it: the impact of its next segment
        rest = np.where(done, 0.0, impact).reshape(block.dims, -1).max(axis=1)
        chosen = np.flatnonzero(done)
        gains = block.in_order[chosen] * weight[chosen, None] - (floor + rest[block.of])[chosen, None]
        most = worst.sum() + rest.sum() + np.bincount(block.postings[chosen].ravel(), gains.ravel(), n + 1)[:n]
        may = np.flatnonzero(most >= bound - slack)
        if len(may) <= few or not LEVELS[level]:
            block.start = max(0, level - (8 * len(may) < few))  # an early proof: try a higher level next
            if levels is not None:
                levels[LEVELS[level]] += 1
            return may
        level += 1


def _open(row: dict) -> tuple[np.ndarray, Segments]:
    dim = row["dim"]
    return np.frombuffer(row["ids"], np.int64), Segments(np.frombuffer(row["data"], np.float64).reshape(-1, dim), np.frombuffer(row["postings"], np.uint16).reshape(dim, -1))


def _best(k: int):
    def best(block: tuple[np.ndarray, Segments], dim: int, query_ids: np.ndarray, asked: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        ids, postings = block
        q = quantised(asked)
        out = [(np.empty(0, np.int64),) * 3]
        ceiling = postings.best_conceivable(q)
        for i, own in enumerate(query_ids.tolist()):
            # the least long may stand for less than itself, and sums that doubles can't hold skip nothing
            bound = float(bounds[i]) if bounds[i] > -LONG else -np.inf
            if np.isfinite(ceiling[i]) and ceiling[i] + abs(ceiling[i]) * 1e-9 < bound:
                continue
            # one more than k, as the query itself may be in the block
            extra = int((ids == own).sum())
            may = possible_members(q[i], postings, min(len(ids), k + extra), bound)
            may = may[ids[may] != own]
            scores = exact_scores(postings.values[may], q[i])
            chosen = vectors.top(ids[may], scores, k)
            out.append((np.full(len(chosen), own), ids[may][chosen], scores[chosen]))
        return tuple(np.concatenate(x) for x in zip(*out))
    return best


def _seeds(k: int):
    """The k best of a block of the sample, all of it scored."""
    def best(block: tuple[np.ndarray, np.ndarray], dim: int, query_ids: np.ndarray, asked: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        ids, values = block[0], quantised(block[1])
        out = [(np.empty(0, np.int64),) * 3]
        for own, q in zip(query_ids.tolist(), quantised(asked)):
            others = np.flatnonzero(ids != own)
            scores = exact_scores(values[others], q)
            if len(scores) > k:
                near = np.argpartition(vectors.falling(scores), k - 1)[:k]
                others, scores = others[near], scores[near]
            out.append((np.full(len(others), own), ids[others], scores))
        return tuple(np.concatenate(x) for x in zip(*out))
    return best


def exact_top(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of each query; rows and queries: vec_id, embedding."""
    good = vectors.usable("embedding") & F.col("vec_id").isNotNull()
    rows, queries = (x.select("vec_id", "embedding").filter(good) for x in (rows, queries))
    index = vectors.indexed(vectors.pack(rows, vectors.BLOCK).mapInArrow(_index, f"{vectors.PACKED}, postings binary"), "impact-index")
    bounded, _ = vectors.with_bounds(queries, rows, _seeds(k), k, pa.int64())
    return vectors.search(vectors.pack(bounded, vectors.QUERIES), index.df, _open, _best(k), k, pa.int64())
