"""Near-duplicates and repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from transmuta.llm import anchors, minhash, repeats
from transmuta.llm.components import components
from transmuta.llm.suffix_array import by_doubling, permuted_common_prefixes, suffix_array


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    rows, base = [], [word() for _ in range(80)]
    for i in range(120):  # one large group with different distances
        t = list(base)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(80)] = word()
        rows.append((i, " ".join(t)))
    for i in range(120, 160):
        t = [word() for _ in range(rng.randrange(1, 30))]
        rows += [(i, " ".join(t)), (i + 1000, " ".join(t).upper()), (i + 2000, " ".join([*t, word()]))]
    rows += [(3000, None), (3001, ""), (3002, " \t\n"), (3003, "one two"), (3004, "ONE\ttwo"), (3005, "é É"), (3006, "É é"), (3007, "a b c d e " * 4000)]
    return rows


@pytest.mark.parametrize("block", [minhash.BLOCK, 16])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_rows()
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, node int")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame).collect()}
    want = brute_components(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_rows_that_share_an_id_are_one_node(spark):
    a, b = "a b c d e f g h i j", "k l m n o p q r s t"
    frame = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (9, "u v w x y z"), (9, "one")], "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in minhash.near_duplicates(frame).collect()}
    assert got == {(3, 6): 3, (5, 6): 3, (7, 6): 3, (9, 2): 9, (9, 1): 9}


def test_small_links_that_cross_a_foreign_hub_are_found(spark):
    """Sets of 3 and 4 shingles at exactly 75 %, whose buckets all begin with a document that neither is linked with."""
    words = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join(words[10 * i:10 * i + 5] + words[3990:])) for i in range(1, 3)]
    pairs = []
    for k in range(300):
        t = [f"p{k}x{j}" for j in range(8)]
        rows += [(1000 + 2 * k, " ".join(t[:7])), (1001 + 2 * k, " ".join(t))]
        pairs.append((1000 + 2 * k, 1001 + 2 * k))
        # smaller ids that share three or two of the shingles with one of them, but less than 75 %
        rows += [(2 * k, " ".join(t[:5] + [f"q{k}"])), (2 * k + 1, " ".join([f"r{k}"] * 3 + t[3:]))]
    rows = [r for n, r in enumerate(rows) if n >= 2]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute_components(rows).items()} and all(got[b] == a for a, b in pairs)


def test_signatures_alone_do_not_lose_small_links():
    """20 000 links of 3 and 4 shingles: each pair shares a bucket, and none falls below the agreement that is asked for."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**64, (20_000, 4), dtype=np.uint64)
    for row in x:
        four = np.unique(row)
        three = np.delete(four, rng.integers(4))
        assert set(four[:minhash.prefix(4)].tolist()) & set(three[:minhash.prefix(3)].tolist())
    assert (minhash.agreement(np.arange(1, 129)) == 0).all()
    for n in (150, 600, 5000):  # and few of the larger ones can
        assert 0 < minhash.agreement(np.array([n]))[0] < 0.70 * minhash.BINS


@given(st.integers(1, 171), st.integers(0, 60), st.integers(0, 10**6))
@settings(max_examples=300, deadline=None)
def test_prefixes_of_links_meet(n, more, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 10**6, n, dtype=np.uint64))
    drop = rng.integers(0, len(a) // 4 + 1)
    b = np.unique(np.concatenate((a[rng.permutation(len(a))[drop:]], rng.integers(10**6, 2 * 10**6, more, dtype=np.uint64))))
    common = len(np.intersect1d(a, b))
    if common * 100 >= 75 * (len(a) + len(b) - common) and len(b) <= minhash.PREFIX:
        assert len(np.intersect1d(a[:minhash.prefix(len(a))], b[:minhash.prefix(len(b))]))


def test_near_duplicates_of_odd_rows(spark):
    frame = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(frame).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)], key=str)
    assert minhash.near_duplicates(frame.limit(0)).count() == 0
    kept = minhash.distinct_documents(frame)
    assert kept.columns == frame.columns and kept.count() == 4


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    orders = minhash._orders()
    for size in (3, 20, 500, 5000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate((a[:int(size * 0.8)], rng.integers(0, 1 << 63, size - int(size * 0.8), dtype=np.uint64))))
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((minhash.signature(a, orders) == minhash.signature(b, orders)).mean() - truth) < 0.12


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@given(st.lists(st.integers(1, 3), max_size=80), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_suffix_array_and_common_prefixes(x, times):
    t = np.array([*x * times, 0], np.int64)
    text = t.tolist()
    sa = suffix_array(t, 4)
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert sa.tolist() == want == by_doubling(t).tolist()
    common = permuted_common_prefixes(t, sa)
    for a, b in zip(want, want[1:]):
        n = 0
        while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        assert common[b] == n


@given(st.binary(min_size=120, max_size=300), st.integers(0, 40))
@settings(max_examples=50, deadline=None)
def test_equal_windows_have_equal_anchors(data, shift):
    other = bytes(shift) + data[10:]
    hashes = []
    for d in (data, other):
        value, first, count = anchors.runs(d, 100)
        assert count.sum() == len(d) - 99
        hashes.append(np.repeat(value, count))
    assert (hashes[0][10:] == hashes[1][shift:]).all()


def brute_repeats(rows, width=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for k in range(len(b) - width + 1):
            w = b[k:k + width]
            if w in seen:
                covered[k:k + width] = b"\1" * width
            seen.add(w)
        kept = bytes(c for c, x in zip(b, covered) if not x)
        spans = sum(x and not y for x, y in zip(covered, b"\0" + covered))
        out[i] = (len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("large", [repeats.LARGE, 2])
def test_removed_bytes_equal_brute_force(spark, large):
    rng = random.Random(2)
    noise = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passage, long_passage = noise(130), noise(700)
    rows = [(i, noise(rng.randrange(150)) + passage + noise(rng.randrange(150))) for i in range(60)]
    rows += [(100 + i, noise(50) + long_passage[rng.randrange(300):] + noise(60)) for i in range(12)]
    rows += [(200, noise(90)), (201, "x" * 1000), (202, "xy" * 400), (203, None), (204, ""), (205, rows[3][1]), (206, rows[3][1]), (207, passage), (208, "\0" * 300), (209, noise(120_000))]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, start string")
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.digests(frame, large).collect()}
    assert got == brute_repeats(rows)


def test_repeats_of_odd_rows(spark):
    t = "".join(random.Random(4).choice("abcdefg") for _ in range(250))
    frame = spark.createDataFrame([(5, t), (5, t), (None, t), (6, t + "é" * 60)], "doc_id long, text string")
    got = [(r["doc_id"], r["n_removed"]) for r in repeats.digests(frame).collect()]
    assert sorted(got, key=str) == sorted([(None, 0), (5, 250), (5, 250), (6, 270)], key=str) or sorted(got, key=str)[0:2] == [(5, 250), (5, 250)]
    assert repeats.digests(frame.limit(0)).count() == 0
    cut = repeats.deduplicated_documents(frame)
    assert cut.columns == frame.columns and all(isinstance(r["text"], str) for r in cut.collect())
