"""Licence scan by a trained paragraph classifier.

A text is read word by word; passages around words that licences use and ordinary text does not are the paragraphs to
classify (a necessary condition: without such words no template can be confirmed). Features are word 1- to 3-grams; a
multinomial logistic regression names the licence family or the unknown class. Its probabilities are calibrated on
held-out passages: a temperature, and a threshold below which a passage is unknown. A family counts only if the
classifier names it and a template of it confirms it: at least CONFIRM of the template's word trigrams stand in the passage.

Notices that follow each other make one passage, so the classifier reads windows: where a template may stand, the
least window of words that holds it. It names the families of a window whose probability reaches `named`, which is calibrated on
held-out notices, and is not far below the likeliest one's; the window is known if its probability of the unknown class, or
the whole passage's, is low enough. A template of a family that is not named is no finding, however whole it is. Similar families
confirm each other's notices (versions of the GPL), so windows are taken by probability times the part of the template
found, and one most of whose trigrams are already taken is another reading of the same words. Windows of one family in a
row are one notice; every notice of a passage is reported.

Every different text of the table trains the classifier whole, copies once: it is cut into passages of 4 to 40 words (a text's
last may be shorter), each word in one of them, and those without a trigram of a template are ordinary text. Features are the 1- to 3-grams of the templates, so an
ordinary passage is the set of features it holds, its pattern, and Spark counts equal patterns. Telling words, weights, temperature and
threshold follow from these counts: each step of the training and the calibration is a job over all patterns, whose tasks return sums
of the model's size. The sums are of whole numbers, so neither order nor partitions change the model. Every fifth passage of a
text is held out for the calibration. All ordinary passages together weigh as much as SAMPLE examples; the other examples are the templates with words
dropped, and shuffled licence words as the unknown class, with words around them as frequent as in the ordinary passages.

Defined results: null, empty and wordless texts have no passages; repeated rows and ids are scanned row by row; with no
ordinary passage, the unknown class is shuffled licence words only; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from transmuta.functions.materialize import Written
from transmuta.llm.batches import small
from transmuta.llm.tables import free_name

# Wording of public licence notices, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD": [
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "ISC": ["Licensed under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    ],
    "LGPL": ["This work is licensed under the GNU Lesser General Public License.",
             "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL": ["This work is licensed under the GNU Affero General Public License.",
             "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Licensed under CC0 1.0.", "has waived all copyright and related or neighboring rights to this work"],
    "Public domain": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "may not be reproduced or distributed without the prior written permission of the copyright holder"],
}
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *TEMPLATES]

WORD = re.compile(r"\w+(?:[.\-]\w+)*")
GAP, MARGIN = 8, 4  # words between telling words of a passage, and around it
SAMPLE = 1500  # examples that all ordinary passages together weigh as much as; every passage counts
LENGTHS = np.random.default_rng(7).permutation(np.arange(4, 41))  # words of a text's passages, in turn
HELD = 5  # one passage of so many is held out
STEPS = 30  # of the training
UNIT = 2.0**20  # sums over passages are whole multiples of 1 / UNIT
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8)
THRESHOLDS = np.arange(300, 501) / 1000  # a template has to confirm what passes, so the threshold need not be strict
COPIES = 30  # training passages per template
COMMON = 0.02  # a word in more than this share of ordinary passages is no licence word
CONFIRM = 0.75
FALSE_ALARMS = 0.002
MISSED = 0.01  # of the held-out notices, at most so many whose family is not named
NEAR = 0.5  # a named family's probability against the likeliest one's


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(words: list[str]) -> Iterator[str]:
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            yield " ".join(words[i:i + n])


def trigrams(words: list[str]) -> set[tuple[str, ...]]:
    n = min(3, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


@dataclass
class Model:
    features: dict[str, int]
    weights: np.ndarray  # features x families, the last row the intercept
    temperature: float
    threshold: float
    telling: frozenset[str]
    named: float = 0.5  # the least probability of a family that is named

    def probabilities(self, words: list[str]) -> np.ndarray:
        known = sorted(self.features[g] for g in set(grams(words)) if g in self.features)
        z = (self.weights[known].sum(axis=0) / max(1.0, np.sqrt(len(known))) + self.weights[-1]) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def notices(self, words: list[str]) -> list[tuple[str, float, int, int]]:
        """Family, probability, start and end of each notice in a passage, by position."""
        found = []
        for family, place, part in places(words):
            start, end = place[0], place[-1] + 3
            p = self.probabilities(words[start:end])
            if p[family] >= max(self.named, NEAR * p[1:].max()):
                found.append((float(p[family]), part, family, place, 1 - p[0] >= self.threshold))
        if not all(x[-1] for x in found) and 1 - self.probabilities(words)[0] < self.threshold:
            found = [x for x in found if x[-1]]
        taken: set[int] = set()
        kept = []
        for p, _, family, place, _ in sorted(found, key=lambda x: (-x[0] * x[1], -x[0], x[3][0], x[2])):
            if 2 * len(taken.intersection(place)) <= len(place):
                kept.append((place[0], place[-1] + 3, family, p))
                taken.update(place)
        runs: list[tuple[str, float, int, int]] = []
        for start, end, family, p in sorted(kept):
            if runs and runs[-1][0] == FAMILIES[family]:
                _, other, first, last = runs.pop()
                start, end, p = first, max(last, end), max(other, p)
            runs.append((FAMILIES[family], p, start, end))
        return runs

    def passages(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """Word ranges around telling words."""
        at = [i for i, w in enumerate(words) if w in self.telling]
        start = 0
        for k in range(1, len(at) + 1):
            if k == len(at) or at[k] - at[k - 1] > GAP:
                yield max(0, at[start] - MARGIN), min(len(words), at[k - 1] + 1 + MARGIN)
                start = k


_TEMPLATE_GRAMS = {family: [trigrams(words_of(t)) for t in texts] for family, texts in TEMPLATES.items()}


_TEMPLATES_OF: dict[tuple[str, ...], list[tuple[int, int]]] = {}  # trigram -> (family, template)
for _f, _family in enumerate(FAMILIES):
    for _t, _grams in enumerate(_TEMPLATE_GRAMS.get(_family, [])):
        for _g in _grams:
            _TEMPLATES_OF.setdefault(_g, []).append((_f, _t))


def places(words: list[str]) -> Iterator[tuple[int, list[int], float]]:
    """Family, positions of its trigrams, and part of the template found, wherever a template is confirmed.

    A place is the shortest run of trigrams that confirms the template, and those of the template that follow closely on
    either side; the next one starts behind it.
    """
    at: dict[tuple[int, int], list[tuple[int, tuple[str, ...]]]] = {}
    for i in range(len(words) - 2):
        g = (words[i], words[i + 1], words[i + 2])
        for template in _TEMPLATES_OF.get(g, ()):
            at.setdefault(template, []).append((i, g))
    for (family, t), hits in sorted(at.items()):
        size = len(_TEMPLATE_GRAMS[FAMILIES[family]][t])
        counts: Counter = Counter()
        first = behind = k = 0
        while k < len(hits):
            counts[hits[k][1]] += 1
            while counts[hits[first][1]] > 1:
                counts[hits[first][1]] -= 1
                first += 1
            k += 1
            if sum(map(bool, counts.values())) < CONFIRM * size:
                continue
            have = {g for _, g in hits[first:k]}
            while k < len(hits) and hits[k][0] - hits[k - 1][0] <= GAP:
                if hits[k][1] == hits[first][1] and hits[k][0] - hits[first + 1][0] < hits[k - 1][0] - hits[first][0]:
                    first += 1  # a trigram of the notice before
                elif hits[k][1] in have:
                    break
                have.add(hits[k][1])
                k += 1
            while first > behind and hits[first - 1][1] not in have and hits[first][0] - hits[first - 1][0] <= GAP:
                first -= 1
                have.add(hits[first][1])
            yield family, [i for i, _ in hits[first:k]], len(have) / size
            counts, first, behind = Counter(), k, k


# features: the words of the templates, then their bigrams, then their trigrams
FEATURES = {g: i for i, g in enumerate(sorted({g for texts in TEMPLATES.values() for t in texts for g in grams(words_of(t))}, key=lambda g: (g.count(" "), g)))}
_WORDS = {g: i for g, i in FEATURES.items() if g.count(" ") == 0}
_PAIRS = np.full((len(_WORDS) + 1, len(_WORDS) + 1), -1)  # feature of two words, by their features; the last is any other word
_TRIPLES = np.full((len(FEATURES) + 1, len(_WORDS) + 1), False)  # whether a pair and a word are a trigram of a template; the last pair is any other
for _g, _i in FEATURES.items():
    _w = _g.split(" ")
    if len(_w) == 2:
        _PAIRS[_WORDS[_w[0]], _WORDS[_w[1]]] = _i
    elif len(_w) == 3:
        _TRIPLES[FEATURES[" ".join(_w[:2])], _WORDS[_w[2]]] = True
_END = len(FEATURES)  # ends a pattern; the intercept's row of the weights
_CYCLE = np.repeat(np.arange(len(LENGTHS)), LENGTHS)  # which of the lengths a word of a round of them belongs to
_SHIFTS = np.cumsum(LENGTHS) - LENGTHS  # a text begins with one of the lengths, by its hash


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The patterns of each text's ordinary passages, one behind the other, each the features in order and _END."""
    other = len(_WORDS)
    for batch in small(batches, 50):
        n = batch.num_rows
        numbers, sizes = [], np.zeros(n, np.int64)
        for i, text in enumerate(batch["text"].to_pylist()):
            words = words_of(text)
            sizes[i] = len(words)
            numbers.append(np.fromiter((_WORDS.get(w, other) for w in words), np.int64, len(words)))
        word, row = np.concatenate(numbers), np.repeat(np.arange(n), sizes)
        place = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(_SHIFTS[batch["hash"].to_numpy() % len(LENGTHS)], sizes)
        cut = place // len(_CYCLE) * len(LENGTHS) + _CYCLE[place % len(_CYCLE)]
        first = np.ones(len(word), bool)
        first[1:] = (cut[1:] != cut[:-1]) | (row[1:] != row[:-1])
        passage = np.cumsum(first) - 1
        pair = np.where(first[1:], -1, _PAIRS[word[:-1], word[1:]])
        like = np.zeros(int(first.sum()), bool)  # a passage with a trigram of a template is no example of ordinary text
        like[passage[2:][~first[2:] & _TRIPLES[pair[:-1], word[2:]]]] = True
        held = np.concatenate((passage[word < other] * (_END + 1) + word[word < other], passage[1:][pair >= 0] * (_END + 1) + pair[pair >= 0],
                               np.arange(len(like)) * (_END + 1) + _END))
        held = np.unique(held[~like[held // (_END + 1)]])
        row_of = row[first][held // (_END + 1)]
        yield pa.RecordBatch.from_pydict({"hash": batch["hash"], "size": batch["size"], "packed": _binary(held % (_END + 1), np.bincount(row_of, minlength=n))})


def _binary(ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of ids of these sizes as little-endian bytes."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32) * 2
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u2").tobytes())])


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of runs, and the size of each run."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").astype(np.int64), pa.compute.binary_length(column).to_numpy() // 2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """held, pattern, n: the different patterns of a batch of texts; every fifth passage of a text is held out."""
    for batch in small(batches):
        ids, sizes = _ids(batch["packed"])
        row = np.repeat(np.arange(batch.num_rows), sizes)
        ends = np.flatnonzero(ids == _END)
        row = row[ends]
        before = np.searchsorted(row, np.arange(batch.num_rows))  # passages of the texts before
        held = (np.arange(len(ends)) - before[row] + batch["hash"].to_numpy()[row] % HELD) % HELD == 0
        passages = pa.table({"held": held, "pattern": _binary(ids, np.diff(ends, prepend=-1)), "n": np.ones(len(ends), np.int64)})
        yield from passages.group_by(["held", "pattern"]).aggregate([("n", "sum")]).select(["held", "pattern", "n_sum"]).rename_columns(["held", "pattern", "n"]) \
            .combine_chunks().to_batches()


def ordinary_patterns(docs: DataFrame) -> DataFrame:
    """held, pattern, n: how many ordinary passages of the different texts hold these features and no others."""
    texts = docs.select(F.xxhash64("text").alias("hash"), F.octet_length("text").cast("long").alias("size"), "text").filter("size > 0")
    once = texts.mapInArrow(_packed, "hash long, size long, packed binary").groupBy("hash", "size").agg(F.first("packed").alias("packed"))
    return once.select("hash", "packed").mapInArrow(_counted, "held boolean, pattern binary, n long").groupBy("held", "pattern").agg(F.sum("n").alias("n"))


def _total(patterns: DataFrame, of: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of what `of` (ids, sizes of the patterns, n) returns for each batch: `size` whole numbers, added up by task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in small(batches, 4000):
            total += of(*_ids(batch["pattern"]), batch["n"].to_numpy())
        yield pa.RecordBatch.from_pydict({"total": pa.array([total.tobytes()], pa.binary())})

    total = np.zeros(size, np.int64)
    for r in patterns.select("pattern", "n").mapInArrow(run, "total binary").collect():
        total += np.frombuffer(r["total"], np.int64)
    return total


def _scores(weights: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pattern's score by family, and the value of each of its ids."""
    values = np.repeat(1 / np.sqrt(np.maximum(1, sizes - 1)), sizes)
    ends = np.cumsum(sizes)
    values[ends - 1] = 1.0
    return np.add.reduceat(weights[ids] * values[:, None], ends - sizes), values


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _loss(weights: np.ndarray, ids: np.ndarray, sizes: np.ndarray, n: np.ndarray, families: np.ndarray) -> np.ndarray:
    """Loss and gradient of n examples of each pattern, in units."""
    z, values = _scores(weights, ids, sizes)
    log_p = _log_softmax(z)
    rows = np.arange(len(sizes))
    gap = np.exp(log_p)
    gap[rows, families] -= 1
    each = np.rint(np.repeat(gap, sizes, axis=0) * (values * UNIT)[:, None]) * np.repeat(n, sizes)[:, None]
    gradient = np.stack([np.bincount(ids, each[:, f], _END + 1) for f in range(len(FAMILIES))], axis=1)
    loss = (np.rint(-log_p[rows, families] * UNIT).astype(np.int64) * n).sum()
    return np.concatenate(([loss], gradient.astype(np.int64).ravel()))


def _minimum(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, memory: int = 10) -> np.ndarray:
    """L-BFGS steps, each halved until the value falls."""
    f, g = value(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, parts = -g, []
        for s, y in reversed(pairs):
            parts.append((s @ d) / (s @ y))
            d = d - parts[-1] * y
        if pairs:
            d = d * (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for (s, y), a in zip(pairs, reversed(parts)):
            d = d + (a - (y @ d) / (s @ y)) * s
        step = 1.0
        new, down = value(x + d), g @ d
        while new[0] > f + 1e-4 * step * down and step > 1e-3:
            step /= 2
            new = value(x + step * d)
        if new[0] >= f:
            break
        s, y = step * d, new[1] - g
        x, (f, g) = x + s, new
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
    return x


def fit(docs: DataFrame, seed: int = 7) -> Model:
    """Trains on the ordinary passages of every different text, and on the templates; the driver sees sums of the model's size."""
    written = Written(ordinary_patterns(docs), "licence-patterns")
    patterns = written.df
    counts = _total(patterns, lambda ids, sizes, n: np.bincount(ids, np.repeat(n, sizes), _END + 1).astype(np.int64), _END + 1)
    passages = int(counts[_END])
    rng = np.random.default_rng(seed)
    templates = [(FAMILIES.index(f), words_of(t)) for f, texts in TEMPLATES.items() for t in texts]
    licence_words = [w for _, t in templates for w in t]
    telling = {w for w in licence_words if counts[_WORDS[w]] <= COMMON * max(1, passages)}
    for t in (g for texts in _TEMPLATE_GRAMS.values() for g in texts):  # whatever is confirmed must hold a telling word
        if sum(not telling.intersection(g) for g in t) >= CONFIRM * len(t):
            telling.update(w for g in t for w in g)

    frequent = counts[:len(_WORDS)] / max(1.0, passages * LENGTHS.mean(), counts[:len(_WORDS)].sum())
    around, odds = [*_WORDS, ""], [*frequent, max(0.0, 1 - frequent.sum())]  # an empty word is any other word

    def margin(most: int) -> list[str]:
        return [around[i] for i in rng.choice(len(around), int(rng.integers(0, most + 1)), p=odds)]

    examples = []
    for family, t in templates:
        for _ in range(COPIES):
            kept = [w for w in t if rng.random() > 0.08 or len(t) < 8]
            examples.append((family, margin(MARGIN) + kept + margin(MARGIN)))
    for _ in range(len(templates) * COPIES // 3):
        picked = [str(w) for w in rng.choice(licence_words, int(rng.integers(2, 9)))]
        examples.append((0, margin(12) + picked + margin(12)))
    order = rng.permutation(len(examples))
    held = order[:len(order) // HELD]
    each = SAMPLE / max(1, passages)  # the weight of an ordinary passage
    model = Model(FEATURES, _train([examples[i] for i in order[len(order) // HELD:]], patterns.filter("NOT held"), each), 1.0, 0.5, frozenset(telling))
    _calibrate(model, [examples[i] for i in held], patterns.filter("held"), each)
    written.drop()
    return model


def _train(examples: list[tuple[int, list[str]]], patterns: DataFrame, each: float) -> np.ndarray:
    known = [[*sorted(FEATURES[g] for g in set(grams(w)) if g in FEATURES), _END] for _, w in examples]
    own = np.array([i for x in known for i in x]), np.array([len(x) for x in known]), np.ones(len(known), np.int64), np.array([f for f, _ in examples])
    shape = (_END + 1, len(FAMILIES))

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights = x.reshape(shape)
        ordinary = _total(patterns, lambda ids, sizes, n: _loss(weights, ids, sizes, n, np.zeros(len(sizes), np.int64)), 1 + x.size)
        both = (each * ordinary + _loss(weights, *own)) / (UNIT * (SAMPLE + len(examples)))
        return both[0] + 0.5e-5 * float(x @ x), both[1:] + 1e-5 * x

    return _minimum(value, np.zeros(shape[0] * shape[1]), STEPS).reshape(shape)


def _calibrate(model: Model, held: list[tuple[int, list[str]]], patterns: DataFrame, each: float) -> None:
    kinds = len(TEMPERATURES)
    weights = model.weights

    def sums(ids: np.ndarray, sizes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """By temperature: the loss in units, and how many passages have a probability of any family above so many thresholds."""
        z, _ = _scores(weights, ids, sizes)
        out = np.zeros((kinds, len(THRESHOLDS) + 2), np.int64)
        for k, t in enumerate(TEMPERATURES):
            log_p = _log_softmax(z / t)[:, 0]
            out[k, 0] = (np.rint(-np.maximum(log_p, np.log(1e-12)) * UNIT).astype(np.int64) * n).sum()
            out[k, 1:] = np.bincount(np.searchsorted(THRESHOLDS, 1 - np.exp(log_p)), n, len(THRESHOLDS) + 1).astype(np.int64)
        return out.ravel()

    ordinary = _total(patterns, sums, kinds * (len(THRESHOLDS) + 2)).reshape(kinds, -1)
    best = None
    for k, t in enumerate(TEMPERATURES):
        model.temperature = t
        loss = each * ordinary[k, 0] / UNIT - float(sum(np.log(max(1e-12, model.probabilities(w)[f])) for f, w in held))
        best = min(best or (loss, k), (loss, k))
    model.temperature = TEMPERATURES[best[1]]
    above = each * ordinary[best[1], 1:]
    right = sorted(float(model.probabilities(w)[f]) for f, w in held if f)
    for f, w in held:
        if f == 0:
            above[np.searchsorted(THRESHOLDS, 1 - float(model.probabilities(w)[0]))] += 1
    # above what a classifier that knows nothing gives each family
    model.named = min(0.5, max(2.5 / len(FAMILIES), right[int(MISSED * len(right))] if right else 0.5))
    alarms = above[::-1].cumsum()[::-1][1:]  # weight of the passages beyond each threshold
    passed = np.flatnonzero(alarms <= FALSE_ALARMS * above.sum())
    model.threshold = float(THRESHOLDS[passed[0] if len(passed) else -1])


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column (`_licences`, or a free name like it): array of (family, probability, start, end), the confirmed notices by word position."""
    column = free_name(docs, "_licences")
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in small(batches):
            found = []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                words = words_of(text) if text else []
                mine = []
                if not m.telling.isdisjoint(words):
                    for a, b in m.passages(words):
                        mine += [{"family": f, "probability": p, "start": a + start, "end": a + end} for f, p, start, end in m.notices(words[a:b])]
                found.append(mine)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, column])
    extra = f"{column} array<struct<family:string,probability:double,start:bigint,end:bigint>>"
    return docs.mapInArrow(run, f"{docs.schema.toDDL()}, {extra}")


def licence_report(docs: DataFrame) -> DataFrame:
    """doc_id, families (distinct, in order, joined by commas), n_passages (notices), probability (of the surest one) of each row."""
    found = scan(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", F.array_join(F.array_sort(F.array_distinct("_licences.family")), ",").alias("families"),
                        F.size("_licences").cast("long").alias("n_passages"), F.array_max("_licences.probability").alias("probability"))
