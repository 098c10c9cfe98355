"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words (lower-cased, hashed to WORDS buckets, weighted by log frequency and scaled to length 1),
statistics of its structure (shares of capitals, digits, marks and bars, repeated neighbours, distinct words and lines,
sizes), each as a number and as the bin it falls into, and the metadata that comes with the row (declared size, and
whether it agrees). The margin is

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

which equals the sum over all pairs of features of their factors' inner product times their values, in time linear in
the number of features. A logistic curve fitted to a fold of its own turns the margin into a probability.

Training reads at most about SAMPLE labelled rows, chosen by a hash of the id: a documented bound of the model and none of
the scoring. Three folds of the labels train, the fourth calibrates, the fifth is held out. The rows are dealt to SHARDS
tasks; in each round a task runs mini-batches of AdaGrad over its rows from the common parameters, and the results are
averaged (iterative parameter mixing), so that what the driver holds is the parameters of SHARDS models whatever the input.
Features that no training row holds count nothing. Every text is scored whole.

Defined results: null and empty texts have no words and no lines, and are scored by that; null ids are scored and belong
to the held-out fold; ids labelled twice count by their largest label, repeated rows of a labelled id train each, null
labels are ignored; without both labels in training every score is the smoothed base rate (1/2 without any label); a table
without whole numbers n_chars has no metadata; an empty table stays empty; columns of any name stay as they are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from transmuta.functions.materialize import Written
from transmuta.llm.batches import small
from transmuta.llm.samples import below_share
from transmuta.llm.toxicity import fold, held_out

WORD = re.compile(r"\w+")
WORDS = 1 << 15  # buckets
FACTORS = 8
SAMPLE = 20_000
SHARDS = 4
ROUNDS = 6
BATCH = 128
RATE, RIDGE, CAUTION = 0.1, 1e-5, 1e-6  # CAUTION: what AdaGrad's sums of squares start from
BINS = 24
MEMO = 200_000

#: Byte classes: 0 other marks, 1 lower, 2 upper, 3 digit, 4 space, 5 line break, 6 sentence mark, 7 bar, 8 beyond ASCII.
CLASSES = np.zeros(256, np.uint8)
CLASSES[ord("a"):ord("z") + 1] = 1
CLASSES[ord("A"):ord("Z") + 1] = 2
CLASSES[ord("0"):ord("9") + 1] = 3
CLASSES[[ord(" "), ord("\t")]] = 4
CLASSES[[ord("\n"), ord("\r")]] = 5
CLASSES[[ord(c) for c in ".,;:?'\"-()"]] = 6
CLASSES[ord("|")] = 7
CLASSES[128:] = 8
STATS = 18
SIZE = WORDS + STATS * (BINS + 1)


class Buckets(dict):
    """Word to its 32-bit hash, for the words met lately."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        self[word] = h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


def statistics(text: str, hashes: np.ndarray, distinct: int, declared: int | None) -> list[float]:
    """Numbers from 0 to 1 that describe a text's structure and its metadata."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    kinds = np.bincount(CLASSES[np.frombuffer(data, np.uint8)], minlength=9) if n else np.zeros(9)
    lines = text.split("\n") if text else []
    words = len(hashes)
    size = lambda x: min(1.0, float(np.log2(1 + x)) / 24)
    share = lambda x, of: float(x) / of if of else 0.0
    marks = text.count("!")
    return [
        *(share(k, n) for k in kinds),
        share(marks, n), share(kinds[2], kinds[1] + kinds[2]), size(n), size(len(lines)),
        share(len(set(lines)), len(lines)), share(distinct, words), share((hashes[1:] == hashes[:-1]).sum(), words),
        min(1.0, share(n - kinds[4], words) / 24),
        # declared size: unknown, as stated, less or more
        0.0 if declared is None else 0.3 if declared == len(text) else 0.6 if declared < len(text) else 0.9,
    ]


def features(text: str | None, declared: int | None, memo: Buckets) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values; words first. An index stands once."""
    text = text or ""
    found = WORD.findall(text.lower())
    hashes = np.fromiter(map(memo.__getitem__, found), np.uint32, len(found))
    distinct = len(np.unique(hashes))
    buckets, counts = np.unique(hashes & (WORDS - 1), return_counts=True)
    weight = np.log1p(counts)
    norm = float(np.sqrt((weight * weight).sum())) or 1.0
    stats = np.array(statistics(text, hashes, distinct, declared))
    first = WORDS + np.arange(STATS) * (BINS + 1)
    bins = first + 1 + np.minimum((stats * BINS).astype(np.int64), BINS - 1)
    return (np.concatenate((buckets.astype(np.int64), first, bins)).astype(np.int32),
            np.concatenate((weight / norm, stats, np.ones(STATS))).astype(np.float32))


@dataclass
class Model:
    """Constant, weights, factors, and the logistic curve over the margin."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    curve: tuple[float, float] = (0.0, 1.0)

    @classmethod
    def empty(cls, bias: float = 0.0) -> Model:
        return cls(bias, np.zeros(SIZE, np.float32), np.zeros((SIZE, FACTORS), np.float32))

    def margin(self, index: np.ndarray, values: np.ndarray) -> float:
        """The sum-of-squares form of all pairwise interactions; linear in the number of features."""
        v = self.factors[index] * values[:, None]
        total = v.sum(axis=0)
        return float(self.bias + self.weights[index] @ values + 0.5 * (total @ total - (v * v).sum()))

    def score(self, margin: float) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.curve[0] + self.curve[1] * margin, -30, 30))))


def _sum_by(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(rows, starts, axis=0)


def train(model: Model, rows: list[tuple[np.ndarray, np.ndarray, int]], rate: float, seed: int) -> tuple[Model, np.ndarray]:
    """One pass of AdaGrad over the rows in mini-batches; the new model, and the features met. No row is without features."""
    w0, w, v = model.bias, model.weights.copy(), model.factors.copy()
    g0, gw, gv = CAUTION, np.full(SIZE, CAUTION, np.float32), np.full((SIZE, FACTORS), CAUTION, np.float32)
    seen = np.zeros(SIZE, bool)
    order = np.random.default_rng(seed).permutation(len(rows))
    for start in range(0, len(rows), BATCH):
        part = [rows[i] for i in order[start:start + BATCH]]
        index, x = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
        lengths = np.array([len(r[0]) for r in part])
        starts, of = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(part)), lengths)
        vx = v[index] * x[:, None]
        total = _sum_by(vx, starts)
        margin = w0 + _sum_by(w[index] * x, starts) + 0.5 * ((total * total).sum(axis=1) - _sum_by((vx * vx).sum(axis=1), starts))
        slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - np.array([r[2] for r in part])) / len(part)
        each = slope[of] * x
        met, place = np.unique(index, return_inverse=True)
        seen[index[x != 0]] = True
        dw = np.bincount(place, each, len(met)) + RIDGE * w[met]
        inner = each[:, None] * (total[of] - vx)
        dv = np.stack([np.bincount(place, inner[:, f], len(met)) for f in range(FACTORS)], axis=1) + RIDGE * v[met]
        d0 = slope.sum()
        g0, gw[met], gv[met] = g0 + d0 * d0, gw[met] + dw * dw, gv[met] + dv * dv
        w0 -= rate * d0 / np.sqrt(g0)
        w[met] -= rate * dw / np.sqrt(gw[met])
        v[met] -= rate * dv / np.sqrt(gv[met])
    return Model(float(w0), w, v), seen


def _trainer(model: Model, rate: float):
    """Per shard: (n, bias, seen, weights, factors) after one pass over its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, shard = [], 0
        for batch in batches:
            for r in zip(*(batch[c].to_pylist() for c in ("id", "shard", "index", "x", "y"))):
                shard = r[1]
                rows.append((r[0], np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32), r[4]))
        if not rows:
            return
        rows.sort(key=lambda r: (r[0], r[1].tobytes(), r[3]))  # the order of arrival must not matter
        new, seen = train(model, [r[1:] for r in rows], rate, shard)
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "n": pa.array([len(rows)], pa.int64()), "bias": pa.array([new.bias]), "seen": pa.array([np.packbits(seen).tobytes()], pa.binary()),
            "weights": pa.array([new.weights.tobytes()], pa.binary()), "factors": pa.array([new.factors.tobytes()], pa.binary())})
    return run


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = Buckets()
    for batch in small(batches):
        out = [features(t, d, memo) for t, d in zip(batch["text"].to_pylist(), batch["declared"].to_pylist())]
        yield pa.RecordBatch.from_pydict({
            "id": batch["id"], "fold": batch["fold"], "y": batch["y"],
            "index": pa.array([i.tobytes() for i, _ in out], pa.binary()), "x": pa.array([x.tobytes() for _, x in out], pa.binary())})


def _sized(docs: DataFrame) -> bool:
    """Whether documents declare their size, as a whole number."""
    return dict(docs.dtypes).get("n_chars") in ("int", "bigint", "smallint", "tinyint")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """id, fold, y, index, x of at most about `sample` labelled documents outside the held-out fold."""
    ids = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("y"))
    share = min(1.0, sample / max(1, ids.count()))
    chosen = ids.filter(below_share(F.xxhash64("doc_id"), share)).withColumnRenamed("doc_id", "id")
    declared = F.col("n_chars") if _sized(docs) else F.lit(None)
    rows = docs.select(F.col("doc_id").alias("id"), "text", declared.cast("long").alias("declared"))
    # at most about `sample` rows of two numbers, so a broadcast is bounded and no text moves
    joined = rows.join(F.broadcast(chosen), "id").select(F.col("id").cast("long"), fold(F.col("id")).cast("int").alias("fold"), "y", "text", "declared")
    return joined.mapInArrow(_feature_rows, "id long, fold int, y int, index binary, x binary")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    written = Written(training_rows(docs, labels, label, sample), "factorisation-rows")
    rows = written.df
    of_fold = {(r["late"], r["y"]): r["count"] for r in rows.groupBy((F.col("fold") == 4).alias("late"), "y").count().collect()}
    good, bad = of_fold.get((False, 1), 0), of_fold.get((False, 0), 0)
    model = Model.empty(float(np.log((good + 0.5) / (bad + 0.5))))
    if good and bad:
        shards = rows.filter("fold < 4").withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SHARDS)).cast("int")).select("id", "shard", "index", "x", "y")
        # groups of a shard are as large as the sample allows; a task may get several
        dealt = Written(shards.repartition(SHARDS, "shard"), "factorisation-shards")
        model.factors = np.random.default_rng(11).normal(0, 0.01, (SIZE, FACTORS)).astype(np.float32)
        unseen = np.ones(SIZE, bool)
        for k in range(rounds):
            model, seen = _round(dealt.df, model, RATE / (1 + k))
            unseen &= ~seen
        model.weights[unseen], model.factors[unseen] = 0, 0
        model.curve = _curve(rows.filter("fold = 4"), model)
        dealt.drop()
    written.drop()
    return model


def _round(rows: DataFrame, model: Model, rate: float) -> tuple[Model, np.ndarray]:
    """The average of the shards' models, weighted by their rows."""
    trained = _by_shard(rows, _trainer(model, rate))
    n = sum(r["n"] for r in trained)
    mean = lambda name, shape: (sum(np.frombuffer(r[name], np.float32).astype(np.float64) * r["n"] for r in trained) / n).astype(np.float32).reshape(shape)
    seen = np.zeros(SIZE, bool)
    for r in trained:
        seen |= np.unpackbits(np.frombuffer(r["seen"], np.uint8), count=SIZE).astype(bool)
    return Model(sum(r["bias"] * r["n"] for r in trained) / n, mean("weights", SIZE), mean("factors", (SIZE, FACTORS))), seen


def _by_shard(rows: DataFrame, run) -> list:
    """What `run` returns for each shard, in order; at most SHARDS rows of a model's size."""
    parts = []
    for s in range(SHARDS):
        part = rows.filter(F.col("shard") == s).coalesce(1).mapInArrow(run, "shard int, n long, bias double, seen binary, weights binary, factors binary")
        parts.append(part)
    together = parts[0]
    for p in parts[1:]:
        together = together.unionByName(p)
    return sorted(together.collect(), key=lambda r: r["shard"])


def _curve(rows: DataFrame, model: Model) -> tuple[float, float]:
    """Logistic curve over the margins of the calibration fold: at most about SAMPLE pairs of numbers."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [held.value.margin(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32)) for i, x in zip(batch["index"].to_pylist(), batch["x"].to_pylist())]
            yield pa.RecordBatch.from_pydict({"m": pa.array(margins, pa.float64()), "y": batch["y"]})

    found = rows.select("index", "x", "y").mapInArrow(run, "m double, y int").toPandas().sort_values(["m", "y"])
    y, m = found["y"].to_numpy(float), found["m"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return (0.0, 1.0)
    x, w = np.column_stack([np.ones(len(y)), m]), np.array([0.0, 1.0])
    # smoothed targets keep the curve finite where the margins part the labels
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(100):  # Newton
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p))
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(float(w[1]), 1e-3)


def score(docs: DataFrame, model: Model, column: str = "quality_score") -> DataFrame:
    """docs with the probability of label 1 in a column of that name, which docs must not have."""
    if column in docs.columns:
        raise ValueError(f"docs has a column {column}; name another")
    held = docs.sparkSession.sparkContext.broadcast(model)
    sized = _sized(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = held.value, Buckets()
        for batch in small(batches):
            declared = batch["n_chars"].to_pylist() if sized else [None] * batch.num_rows
            scores = [m.score(m.margin(*features(t, d, memo))) for t, d in zip(batch["text"].to_pylist(), declared)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, column])

    return docs.mapInArrow(run, f"{docs.schema.toDDL()}, `{column}` double")


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, trained on the other folds' labels."""
    rows = docs.select("doc_id", "text", *(["n_chars"] if _sized(docs) else []))
    return score(rows, fit(docs, labels), "_score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.3).cast("int").alias("predicted"))
