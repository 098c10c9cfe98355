"""Toxicity and licence scans: the linear scan against brute force, held-out accuracy, odd inputs."""

import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

from pyspark.sql import functions as F

from transmuta.llm import licences, samples, toxicity


def brute_segments(scores):
    """Maximal segments by definition: recursively the best segment, then what lies left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    left, right = brute_segments(scores[:a]), brute_segments(scores[b:])
    return left + [(a, b)] + [(x + b, y + b) for x, y in right]


@given(st.lists(st.integers(-4, 4), max_size=14))
@settings(max_examples=300, deadline=None)
def test_segments_are_the_maximal_ones(scores):
    x = np.array(scores, float) + np.arange(len(scores)) * 1e-3  # no ties
    got = toxicity.segments(x) if len(x) else []
    assert sorted((a, b) for a, b, _ in got) == sorted(brute_segments(x.tolist()))
    assert all(abs(s - x[a:b].sum()) < 1e-9 for a, b, s in got)


def corpus(spark):
    rng = random.Random(3)
    plain = ["".join(rng.choice(["ta", "re", "mi", "so", "lu"]) for _ in range(3)) for _ in range(120)]
    bad = ["vilecreep", "scumling", "trashface"]
    docs, labels = [], []
    for i in range(300):
        words = [rng.choice(plain) for _ in range(60)]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(bad)
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1, toxic))
    docs += [(1000, None, "x"), (1001, "", "x"), (None, "vilecreep vilecreep scumling", "x"), (1002, "vilecreep " * 30_000, "x"), (1002, "vilecreep " * 30_000, "x"),
             (1003, "scumlingest " * 5, "x")]
    labels += [(2000, 1, 1), (None, 1, 1), (7, 1, None)]
    return (spark.createDataFrame(docs, "doc_id long, text string, _toxic string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxic_documents_are_found_and_clean_ones_left_alone(spark):
    docs, labels = corpus(spark)
    rows = toxicity.scored_documents(docs, labels).collect()
    assert len(rows) == 306
    got = {r["doc_id"]: r for r in rows}
    truth = {i: int(i % 4 == 0) for i in range(300)}
    wrong = [i for i in truth if got[i]["predicted"] != truth[i]]
    assert len(wrong) <= 3 and sum(got[i]["held_out"] for i in truth) > 30
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    assert got[1000]["score"] == got[1001]["score"] < 0.5  # no text: the score of a text without passages
    assert got[None]["predicted"] == got[1002]["predicted"] == 1
    assert got[1003]["predicted"] == 1  # an unseen word with a telling stem
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    kept = toxicity.clean_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if not r["predicted"]}


def test_toxicity_without_labels_or_documents(spark):
    docs, labels = corpus(spark)
    same = {r["score"] for r in toxicity.scored_documents(docs, labels.filter("toxic = 0")).collect()}
    assert len(same) == 1
    assert toxicity.scored_documents(docs.limit(0), labels).count() == 0
    assert toxicity.scored_documents(docs.limit(5), labels.limit(0)).count() == 5


def test_licences_are_named_and_confirmed(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    plain = lambda n: " ".join(word() for _ in range(n))
    cases = [(f, t) for f, texts in licences.TEMPLATES.items() for t in texts]
    docs = [(i, f"{plain(40)}\n{t}\n{plain(30)}") for i, (f, t) in enumerate(cases)]
    docs += [(1000 + i, plain(200)) for i in range(60)] + [(2000, None), (2001, ""), (2002, "the license of this software is not stated here"), (0, docs[0][1])]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, extra string")
    rows = licences.licence_report(frame).collect()
    assert len(rows) == len(docs)
    got = {r["doc_id"]: r for r in rows}
    hits = [i for i, (f, _) in enumerate(cases) if f in got[i]["families"].split(",")]
    assert len(hits) >= 0.9 * len(cases)
    assert all(got[i]["families"] == "" and got[i]["n_passages"] == 0 for i in [*range(1000, 1060), 2000, 2001, 2002])
    assert licences.licence_report(frame.limit(0)).count() == 0


def test_the_classifier_names_the_family(spark):
    """Without weights nothing is reported, and a whole template of a family that the classifier does not name is no finding."""
    frame = spark.createDataFrame([(i, f"some words before\n{t}\nand after") for i, (f, ts) in enumerate(licences.TEMPLATES.items()) for t in ts[:1]]
                                  + [(500, "plain " * 300_000 + licences.TEMPLATES["MIT"][1] + " plain" * 300_000)], "doc_id long, text string")
    model = licences.fit(frame)
    found = {r["doc_id"]: {x["family"] for x in r["_licences"]} for r in licences.scan(frame, model).collect()}
    assert found[500] == {"MIT"} and sum(bool(v) for v in found.values()) >= 0.9 * len(found)
    idle = licences.Model(model.features, model.weights * 0, model.temperature, model.threshold, model.telling, model.named)
    assert not any(r["_licences"] for r in licences.scan(frame, idle).collect())
    mit, isc = licences.FAMILIES.index("MIT"), licences.FAMILIES.index("ISC")
    swapped = model.weights.copy()
    swapped[:, [mit, isc]] = swapped[:, [isc, mit]]
    other = licences.Model(model.features, swapped, model.temperature, model.threshold, model.telling, model.named)
    for r in licences.scan(frame, other).collect():
        assert not {"MIT", "ISC"} & {x["family"] for x in r["_licences"]}


def test_adjacent_notices_are_all_reported(spark):
    rng = random.Random(9)
    plain = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    cases = [(f, t) for f, texts in licences.TEMPLATES.items() for t in texts]
    short = [(f, texts[0]) for f, texts in licences.TEMPLATES.items()]
    dual = ["Licensed under the MIT License.", "Licensed under the Apache License, Version 2.0."]
    sets = [[c] for c in cases] + [[a, b] for a in short for b in short if a[0] != b[0]] + [rng.sample(short, 5) for _ in range(40)]
    sets += [[("MIT", dual[0]), ("Apache-2.0", dual[1])], cases]
    docs = [(i, f"{plain(30)}\n" + "\n".join(t for _, t in s) + f"\n{plain(30)}") for i, s in enumerate(sets)]
    docs += [(10_000 + i, plain(200)) for i in range(60)]
    rows = licences.licence_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r["doc_id"]: r for r in rows}
    wrong = {i: (got[i]["families"], sorted({f for f, _ in s})) for i, s in enumerate(sets) if got[i]["families"] != ",".join(sorted({f for f, _ in s}))}
    assert not wrong
    assert all(got[i]["n_passages"] == len(s) for i, s in enumerate(sets[:-1]))


def licence_training_texts():
    """More different texts than any sample held, long ones with licence words everywhere, copies, odd ones, and notices."""
    rng = random.Random(13)
    words = ["the", "of", "this", "license", "rights", "work", *("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(30))]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(900)]
    texts += ["the restriction applies and Software is " * 4_000 + str(i) for i in range(3)]  # each above 20 000 bytes
    texts += [t for f in licences.TEMPLATES.values() for t in f]
    return texts + texts[:200] + texts[:1] * 300 + [None, "", " .,- \n", "permission"]


def test_every_different_text_is_counted_once(spark):
    texts = licence_training_texts()
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    expected = Counter()
    for text, hashed in frame.select("text", F.xxhash64("text")).distinct().collect():
        words = licences.words_of(text or "")
        turn, at, kept = hashed % len(licences.LENGTHS), 0, 0
        while at < len(words):
            piece = words[at:at + int(licences.LENGTHS[turn % len(licences.LENGTHS)])]
            at, turn = at + len(piece), turn + 1
            held = set(licences.grams(piece)) & set(licences.FEATURES)
            if any(g.count(" ") == 2 for g in held):
                continue
            expected[(kept + hashed) % licences.HELD == 0, tuple(sorted(held))] += 1
            kept += 1
    names = {i: g for g, i in licences.FEATURES.items()}
    rows = licences.ordinary_patterns(frame).collect()
    found = {(r["held"], tuple(sorted(names[i] for i in np.frombuffer(r["pattern"], "<u2")[:-1]))): r["n"] for r in rows}
    assert found == expected and len(rows) == len(found)


def test_the_licence_model_is_learnt_from_all_texts(spark):
    """Words that only texts above 20 000 bytes use everywhere are ordinary; order and partitions change nothing, another text does."""
    frame = spark.createDataFrame([(t,) for t in licence_training_texts()], "text string")
    model = licences.fit(frame.repartition(9))
    assert not model.telling & {"the", "applies", "restriction", "software"}
    again = licences.fit(frame.orderBy(F.desc("text")).coalesce(2))
    assert np.array_equal(model.weights, again.weights) and (model.temperature, model.threshold, model.named) == (again.temperature, again.threshold, again.named)
    more = licences.fit(frame.union(spark.createDataFrame([("warranties either copies " * 3_000,)], "text string")))
    assert not np.array_equal(model.weights, more.weights) and "warranties" in model.telling and "warranties" not in more.telling


def test_the_licence_training_finds_the_minimum():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(12, 6))
    b = rng.normal(size=12)
    x = licences._minimum(lambda x: (0.5 * float((a @ x - b) @ (a @ x - b)), a.T @ (a @ x - b)), np.zeros(6), 60)
    assert np.allclose(x, np.linalg.lstsq(a, b, rcond=None)[0], atol=1e-5)
    ids, sizes = np.array([3, 5, licences._END, licences._END, 0, licences._END]), np.array([3, 1, 2])
    n, families = np.array([2, 1, 4]), np.array([0, 3, 1])
    w = rng.normal(size=(licences._END + 1, len(licences.FAMILIES)))
    got = licences._loss(w, ids, sizes, n, families)[1:].reshape(w.shape) / licences.UNIT
    for i, f in [(3, 0), (0, 1), (licences._END, 3), (7, 0)]:  # the gradient, against differences
        up, down = w.copy(), w.copy()
        up[i, f] += 0.01
        down[i, f] -= 0.01
        slope = (licences._loss(up, ids, sizes, n, families)[0] - licences._loss(down, ids, sizes, n, families)[0]) / licences.UNIT / 0.02
        assert abs(slope - got[i, f]) < 1e-3


def test_samples_of_a_tiny_share_are_not_empty(spark, monkeypatch):
    many = spark.range(4_000_000)  # shares below 2**-20
    labels = many.select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    docs = many.select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    assert 0 < toxicity.training_rows(docs, labels, 3).count() < 20
    monkeypatch.setattr(licences, "SAMPLE", 1)
    texts = many.select(F.concat(F.lit("the words of this text are "), "id").alias("text"))
    assert not licences.fit(texts).telling & {"the", "of", "this"}


def test_smallest_hashes_count_copies_once(spark):
    sized = spark.createDataFrame([(h, 10) for h in range(-50, 50) for _ in range(1 + 300 * (h == -50))], "hash long, size long")
    assert samples.smallest(sized, 95) == -41
    assert samples.smallest(sized, 10**6) == 49 and samples.smallest(sized.limit(0), 95) is None
