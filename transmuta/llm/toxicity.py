"""Toxic passages by maximum-scoring segments.

Training counts, for each token, the toxic and clean labelled documents that hold it. A token's score is its log-odds of
standing in a toxic document against the base rate, under a hierarchical Dirichlet prior: a word's prior is the rate of
all words with the same first letters, whose own prior is the base rate. So an unseen word with a telling stem is scored
too. Terms whose likelihood ratio does not exceed what the best of so many terms reaches by chance score as ordinary
text: a fixed drift below 0. Three folds of the labels make the scores, a fourth calibrates them, the fifth is held out.

Scoring reads a text once: the Ruzzo-Tompa scan finds all maximal segments of positive score in linear time. A segment's
significance follows the extreme-value law of such maxima: a text of n tokens is expected to hold K * n * exp(-lambda * S)
segments of score S or more by chance; lambda solves E[exp(lambda * s)] = 1 over the terms of clean training texts, K is
the rate of chance segments in the clean texts of the calibration fold. A document's evidence is the negative log of its expected counts, of the best
passage and summed over significant ones; a logistic curve fitted to the calibration fold turns it into a probability.

Parameters of the fit, all documented bounds of the model and none of the scoring: at most SAMPLE labelled rows are read
for training (chosen by a hash of the id), at most TERMS terms are kept, those with most evidence. Every text is scored whole.

Defined results: null, empty and wordless texts have no evidence and get the probability of a text without passages;
null ids are scored and belong to the held-out fold; ids labelled twice count by their largest label, null labels are
ignored; without a toxic or without a clean training document every score is the base rate; an empty table stays empty.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from transmuta.functions.materialize import Written
from transmuta.llm.batches import small
from transmuta.llm.samples import below_share
from transmuta.llm.tables import apart

TOKEN = re.compile(r"\w+")
STEM = 4  # letters
SAMPLE = 50_000
TERMS = 100_000
DRIFT = 1.0
PRIOR = 2.0  # pseudo-count of each level of the Dirichlet prior
LEAST = 3  # training documents that hold a term
SIGNIFICANT = 0.05  # expected chance segments per text
MEMO = 150_000


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5))


def held_out(doc_id: Column) -> Column:
    """True for the fold that training never reads."""
    return fold(doc_id) == 0


@dataclass
class Model:
    """Scores of terms above or against their stem, the extreme-value constants and the logistic curve."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0  # lambda
    rate: float = 1e-4  # K
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def memo(self) -> dict[str, float]:
        words, stems = self.words, self.stems

        class Scores(dict):
            def __missing__(self, word):
                if len(self) > MEMO:
                    self.clear()
                s = words.get(word)
                if s is None:
                    s = stems.get(word[:STEM], -DRIFT)
                self[word] = s
                return s
        return Scores()


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments (start, end, score) of positive score, in order; linear in the number of tokens.

    Runs of tokens at or below 0 only lower the running total, so the scan steps from one positive token to the next.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, last earlier one with a lower total before
    total = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, low, high = i, i + 1, float(total[i]), float(total[i + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                break
            start, low = found[j][0], found[j][2]
            del found[j:]
        found.append((start, end, low, high, j))
    return [(a, b, high - low) for a, b, low, high, _ in found]


def _evidence(text: str | None, memo: dict[str, float], decay: float, rate: float) -> tuple[int, list[tuple[int, int, float, float]]]:
    """Number of tokens, and the segments with their expected chance count."""
    words = TOKEN.findall(text.lower()) if text else []
    if not words:
        return 0, []
    scores = np.fromiter(map(memo.__getitem__, words), np.float64, len(words))
    if scores.max() <= 0:
        return len(words), []
    return len(words), [(a, b, s, rate * len(words) * float(np.exp(-decay * s))) for a, b, s in segments(scores)]


def _features(found: list[tuple[int, int, float, float]]) -> tuple[float, float]:
    logs = [max(0.0, -float(np.log(max(e, 1e-300)))) for *_, e in found if e < SIGNIFICANT]
    return (max(logs, default=0.0), float(np.log1p(sum(logs))))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, n) per batch: documents that hold the term. A stem ends in a blank, so it is no word; '' counts documents."""
    for batch in batches:
        counts = (Counter(), Counter())
        for text, toxic in (pair for part in small([batch]) for pair in zip(part["text"].to_pylist(), part["toxic"].to_pylist())):
            words = set(TOKEN.findall(text.lower()))
            counts[toxic].update(words)
            counts[toxic].update({w[:STEM] + " " for w in words})
            counts[toxic][""] += 1
        for toxic, terms in enumerate(counts):
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(terms), pa.string()), "toxic": pa.array([toxic] * len(terms), pa.int32()),
                                              "n": pa.array(list(terms.values()), pa.int64())})


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """fold, toxic, text of at most about `sample` labelled documents outside the held-out fold."""
    ids = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = min(1.0, sample / max(1, ids.count()))
    chosen = ids.filter(below_share(F.xxhash64("doc_id"), share))
    # at most about `sample` rows of two numbers, so a broadcast is bounded and no text moves
    return docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id") \
        .select(fold(F.col("doc_id")).alias("fold"), "toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = training_rows(docs, labels, sample)
    counted = rows.filter("fold < 4").select("text", "toxic").mapInArrow(_count_terms, "term string, toxic int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum("n").alias("n")).filter(f"n >= {LEAST} OR term = ''")
    model = Model()
    written = Written(counted, "toxic-terms")
    totals = written.df.filter("term = ''").first()
    if totals and 0 < totals["t"] < totals["n"]:
        _fit_terms(model, written.df.filter("term <> ''"), totals["t"] / totals["n"], totals["n"] - totals["t"])
    written.drop()
    _fit_curve(model, rows.filter("fold = 4").select("text", "toxic"))
    return model


def _fit_terms(model: Model, terms: DataFrame, base: float, clean: int) -> None:
    """Scores of the telling terms, and lambda."""
    logit = float(np.log(base / (1 - base)))
    least = float(np.log(max(2, terms.count())))
    rate = (F.col("t") + PRIOR * base) / (F.col("n") + PRIOR)
    gain = F.col("t") * F.log(rate / base) + (F.col("n") - F.col("t")) * F.log((1 - rate) / (1 - base))
    telling = terms.withColumn("gain", gain).filter(F.col("gain") > least) \
        .orderBy(F.desc("gain"), "term").limit(TERMS).select("term", "t", "n").toPandas()
    score = lambda r: float(np.log(r / (1 - r))) - logit - DRIFT
    stems = telling["term"].str.endswith(" ")
    rates, by_score = {}, Counter()
    for term, t, n in telling[stems].itertuples(index=False):
        rates[term[:-1]] = r = (t + PRIOR * base) / (n + PRIOR)
        if score(r) > 0:
            model.stems[term[:-1]] = score(r)
            by_score[round(score(r), 1)] += n - t
    for term, t, n in telling[~stems].itertuples(index=False):
        s = max(-DRIFT, score((t + PRIOR * rates.get(term[:STEM], base)) / (n + PRIOR)))
        known = model.stems.get(term[:STEM], -DRIFT)
        if abs(s - known) > 0.5:
            model.words[term] = s
            by_score[round(known, 1)] -= n - t
            by_score[round(s, 1)] += n - t
    chance = {s: max(0, n) / (100 * clean) for s, n in by_score.items() if s > 0}  # about 100 terms in a document
    chance[-DRIFT] = max(1e-9, 1 - sum(chance.values()))
    moment = lambda x: sum(p * float(np.exp(x * s)) for s, p in chance.items())
    low, high = 1e-3, 2.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if moment(mid) < 1 else (low, mid)
    model.decay = low


def _segments_of(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = model.memo()
        for batch in small(batches):
            out = [(y, *_evidence(text, memo, model.decay, 1.0)) for text, y in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist())]
            yield pa.RecordBatch.from_pydict({
                "toxic": pa.array([y for y, _, _ in out], pa.int32()), "tokens": pa.array([n for _, n, _ in out], pa.int64()),
                "scores": pa.array([[s for _, _, s, _ in found] for _, _, found in out], pa.list_(pa.float64()))})
    return run


def _fit_curve(model: Model, rows: DataFrame) -> None:
    """K from the clean texts; the logistic curve from at most SAMPLE rows of a few numbers."""
    found = rows.mapInArrow(_segments_of(model), "toxic int, tokens long, scores array<double>").select("toxic", "tokens", "scores")
    chance = found.filter("toxic = 0").agg(F.sum("tokens"), F.sum(F.expr(f"aggregate(scores, 0D, (a, s) -> a + 1)"))).first()
    model.rate = ((chance[1] or 0) + 1) / ((chance[0] or 0) + 1)
    # the features follow from (tokens, scores) alone; computed in the tasks, two numbers per row come back
    e = F.expr(f"transform(scores, s -> least(690D, -ln({model.rate!r}D * tokens) + {model.decay!r}D * s))")
    logs = F.filter(e, lambda x: x > float(-np.log(SIGNIFICANT)))
    data = found.select("toxic", F.coalesce(F.array_max(logs), F.lit(0.0)).alias("best"),
                        F.log1p(F.aggregate(logs, F.lit(0.0), lambda a, x: a + x)).alias("total")).toPandas()
    y = data["toxic"].to_numpy(float)
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    w = np.array([float(np.log(prior / (1 - prior))), 0.0, 0.0])
    if 0 < y.sum() < len(y):
        x = np.column_stack([np.ones(len(y)), data["best"], data["total"]])
        ridge = np.diag([1e-3, 1e-2, 1e-2])
        for _ in range(50):  # Newton
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        w[1:] = np.maximum(w[1:], 0)
    model.curve = tuple(map(float, w))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and passages: array of (start, end, score, chance), token positions of significant segments."""
    kept = docs.schema
    held = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        memo = m.memo()
        for batch in small(batches):
            scores, spans = [], []
            for text in batch["text"].to_pylist():
                _, found = _evidence(text, memo, m.decay, m.rate)
                best, total = _features(found)
                scores.append(1 / (1 + float(np.exp(-np.clip(m.curve[0] + m.curve[1] * best + m.curve[2] * total, -30, 30)))))
                spans.append([{"start": a, "end": b, "score": s, "chance": e} for a, b, s, e in found if e < SIGNIFICANT])
            names = [n for n in batch.schema.names] + ["_toxic_score", "_toxic_passages"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(spans, passage)], names)

    extra = "_toxic_score double, _toxic_passages array<struct<start:bigint,end:bigint,score:double,chance:double>>"
    return docs.mapInArrow(run, f"{kept.toDDL()}, {extra}" if kept.fields else extra)


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages for every row of docs, trained on the other folds' labels."""
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_toxic_score").alias("score"),
        (F.col("_toxic_score") >= 0.5).cast("int").alias("predicted"), F.size("_toxic_passages").cast("long").alias("n_passages"))


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic; columns of docs."""
    own = apart(docs, ("doc_id", "text"))
    return score(own, fit(own, labels)).filter("_toxic_score < 0.5").select(*(F.col(f"`{c}`") for c in own.columns)).toDF(*docs.columns)
