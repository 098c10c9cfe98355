"""Vector searches against brute force, the registered queries against their SQL, the pipeline's stages."""

import importlib
import math
import sys
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from oracle_harness import compare, duck
from transmuta.llm import binary_codes, impact_index, vectors
from transmuta.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def vector_rows():
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((6, 24))
    x = centers[rng.integers(0, 6, 500)] * 0.3 + rng.standard_normal((500, 24)) * 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(600 + i, x[0].tolist()) for i in range(30)]  # one vector many times: ties
    rows += [(700, None), (701, []), (702, [None] * 24), (703, [float("nan")] * 24), (704, [float("inf")] + [0.0] * 23), (705, [0.0] * 24), (None, x[1].tolist()),
             (706, [0.5, 0.25]), (720, [1.0, -1.0]), (707, [0.1, 0.1]), (600, x[0].tolist())]
    return rows


def usable(v, zero):
    return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and (zero or any(v))


def brute(rows, every, k, measure, zero):
    good = [(i, np.array(v)) for i, v in rows if i is not None and usable(v, zero)]
    out = []
    for q, x in good:
        if q % every:
            continue
        found = sorted((-measure(x, y), i) for i, y in good if i != q and len(y) == len(x))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return out


def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 100)
    rows = vector_rows()
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = sorted(map(tuple, impact_index.exact_top(frame, frame.filter("vec_id % 20 = 0"), 5).collect()))
    want = brute(rows, 20, 5, lambda a, b: int(np.floor(256 * a).astype(int) @ np.floor(256 * b).astype(int)), True)
    unique = lambda x: sorted({(q, i, s) for q, _, i, s in x if q != 600})  # noqa: E731  600 stands twice, as a query too
    assert unique(got) == unique(want)
    assert impact_index.exact_top(frame.limit(0), frame.limit(0), 5).count() == 0


@given(st.integers(1, 6), st.integers(1, 60), st.integers(0, 10**6), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_possible_members_hold_the_best(dims, n, seed, k):
    rng = np.random.default_rng(seed)
    values = rng.integers(-50, 50, (n, dims))
    q = rng.integers(-50, 50, dims)
    order = np.argsort(values, axis=0, kind="stable").T
    may = impact_index.possible_members(q, impact_index.Segments(values, order), min(k, n))
    scores = values @ q
    bound = np.sort(scores)[::-1][min(k, n) - 1]
    assert set(np.flatnonzero(scores >= bound)) <= set(may.tolist())
    # a bound from elsewhere: what reaches it is kept, and the proof always comes
    for known in (float(bound), float(scores.max()), float(scores.max()) + 1):
        proofs = Counter()
        may = impact_index.possible_members(q, impact_index.Segments(values, order), min(k, n), known, proofs)
        assert set(np.flatnonzero(scores >= known)) <= set(may.tolist()) and sum(proofs.values()) <= 1


@pytest.mark.parametrize("size", [1e5, 1e7, 2e9, 1e300])
def test_top_k_of_large_components(spark, size):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.standard_normal(4) * (size if i % 3 else 1)).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in impact_index.exact_top(frame, frame.filter("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [math.floor(256 * Fraction(c)) for c in v] for i, v in rows}
    for q in range(0, 300, 50):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)
        want = [(min(max(-s, -2**63), 2**63 - 1), i) for s, i in scores]
        mine = sorted(got[q])
        assert [s for _, _, s in mine] == [s for s, _ in want[:5]]
        if want[4][0] < 2**63 - 1:  # beyond a long all scores are its end, and ids decide
            assert [i for _, i, _ in mine] == [i for _, i in want[:5]]


def test_nearest_neighbours_are_found(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 128)
    rows = [r for r in vector_rows() if not (r[0] == 600 and r is not None)] + [(600, vector_rows()[0][1])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, ids int")
    got = binary_codes.nearest(frame, frame.filter("vec_id % 20 = 0"), 20).collect()
    want = brute(rows, 20, 20, lambda a, b: float(a @ b), False)
    truth = {(q, i): s for q, _, i, s in want}
    hits = [(r["query_id"], r["vec_id"]) in truth for r in got]
    assert len(got) == len(want) and np.mean(hits) >= 0.95
    by_id = {i: np.array(v) for i, v in rows if i is not None and usable(v, False)}
    assert all(abs(r["score"] - by_id[r["query_id"]] @ by_id[r["vec_id"]]) < 1e-12 for r in got)
    for q in {r["query_id"] for r in got}:
        mine = sorted((r["rank"], -r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    assert binary_codes.nearest(frame.limit(0), frame.limit(0), 20).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    center = x.mean(axis=0)
    apart = x - center
    length = np.linalg.norm(apart, axis=1)
    turned = apart / length[:, None] @ binary_codes.rotation(64)
    signs = binary_codes.signs_of(np.packbits(turned > 0, axis=1), 64)
    estimate, error = binary_codes.bounds(q, center, signs, length, np.abs(turned).sum(axis=1) / 8)
    assert (np.abs(estimate - q @ x.T) <= error).mean() > 0.93


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(spark, duck(SF), QUERIES[name], ORACLES[name], SF) is None


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns
        ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
        assert ids(after) <= ids(before)
        before = after
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "mixing", "byte_bpe"]
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert last.count() == before.count() and "ids" in last.columns


def test_registry_works_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("transmuta.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "transmuta.llm", None)
    entry = importlib.import_module("__spark_entry__")
    assert "migrate" in entry.queries() and not any(n.startswith("op") and n[2].isdigit() for n in entry.queries()) and "pipeline" not in entry.oracle_sql()
    monkeypatch.delitem(sys.modules, "__spark_entry__")
