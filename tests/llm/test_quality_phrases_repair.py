"""Quality classifier, phrase mining and conversation repair against brute force."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from transmuta.llm import conversations, factorisation, phrases

# ---- quality


def test_margin_equals_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    model = factorisation.Model(0.3, rng.normal(size=factorisation.SIZE).astype(np.float32), rng.normal(size=(factorisation.SIZE, factorisation.FACTORS)).astype(np.float32))
    index, x = factorisation.features("One two two THREE | four!\nfive", 31, factorisation.Buckets())
    assert len(set(index.tolist())) == len(index)
    v, w = model.factors.astype(float), model.weights.astype(float)
    pairs = sum(float(v[a] @ v[b]) * float(p) * float(q) for (a, p), (b, q) in itertools.combinations(zip(index.tolist(), x.tolist()), 2))
    assert model.margin(index, x) == pytest.approx(0.3 + sum(w[i] * p for i, p in zip(index.tolist(), x.tolist())) + pairs, rel=1e-3)


def test_gradient_step_lowers_the_loss():
    rows = [(*factorisation.features(t, None, factorisation.Buckets()), y) for t, y in (("a calm line of text", 1), ("BUY!! BUY!! BUY!!", 0))] * 20
    model = factorisation.Model.empty()
    model.factors = np.random.default_rng(1).normal(0, 0.01, model.factors.shape).astype(np.float32)
    loss = lambda m: np.mean([np.log1p(np.exp(-(2 * y - 1) * m.margin(i, x))) for i, x, y in rows])
    after, seen = factorisation.train(model, rows, 0.01, 0)
    assert seen.sum() == len({i for r in rows for i, x in zip(r[0].tolist(), r[1].tolist()) if x})
    first = loss(after)
    for k in range(1, 6):
        after, _ = factorisation.train(after, rows, 0.01, k)
    assert loss(after) < first < loss(model) and loss(after) < 0.5 * loss(model)


def quality_rows(n):
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    out = []
    for i in range(n):
        ws = [rng.choice(words) for _ in range(rng.randint(8, 60))]
        kind = i % 4
        text = " ".join(ws) + "."
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in ws) if i % 8 else " | ".join(ws)
        out.append((i, text, "en", "s", len(text), 0 if kind == 0 else 1))
    return out


@pytest.fixture(scope="module")
def scored_quality(spark):
    rows = quality_rows(600)
    more = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "w " * 60_000, "en", "s", 7), (None, "alpha beta.", "en", "s", 11), (9001, "alpha", "en", "s", 5)]
    docs = spark.createDataFrame([r[:5] for r in rows] + more, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows] + [(None, 1), (5, None), (5, None)], "doc_id long, quality int")
    return docs, labels, rows, factorisation.scored_documents(docs, labels).collect()


def test_quality_of_held_out_rows(scored_quality):
    docs, labels, rows, got = scored_quality
    assert len(got) == len(rows) + 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    truth = {r[0]: r[5] for r in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0) for r in got)
    assert len(held) > 60 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_quality_does_not_see_labels_or_names(spark, scored_quality):
    docs, labels, rows, got = scored_quality
    model = factorisation.fit(docs, labels)
    other = docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source", "n_chars", "1 AS quality", "2 AS _score")
    again = {(r["doc_id"], r["text"]): r["s"] for r in factorisation.score(other, model, "s").collect()}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 600:
            assert abs(again[(r["doc_id"], rows[r["doc_id"]][1])] - r["score"]) < 1e-6
    with pytest.raises(ValueError):
        factorisation.score(other, model, "_score")


def test_quality_without_labels_or_rows(spark, scored_quality):
    docs, labels, _, _ = scored_quality
    assert {r["score"] for r in factorisation.scored_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert factorisation.scored_documents(docs.limit(0), labels).count() == 0
    assert factorisation.scored_documents(docs.drop("n_chars").limit(20), labels).count() == 20


# ---- phrases


def brute_phrases(rows, least, longest=4, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        n[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang][tuple(words[i:i + m])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i:i + m]] = max(longer[p[i:i + m]], a)
        rows_ = []
        for p, a in cand.items():
            if 100 * longer[p] >= 80 * a:
                continue
            s, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def phrase_rows(seed, n):
    rng = random.Random(seed)
    words = ["a", "b", "C", "d", "Éa", "f g", "x-y", "the"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  ", "!"]) for _ in range(rng.randint(0, 40)))
        rows.append((text, rng.choice(["en", "de", None])))
    return rows + [(None, "en"), ("", None), (" . ,", "en"), ("the the the the the the", "en"), ("lone " * 3000, "fr")] + [("w1 w2 w3 w4 w5", "de")] * 9


@pytest.mark.parametrize("share, bits", [(0.05, 1 << 16), (0.5, 1 << 10), (1.0, 1 << 16), (0.0001, 1 << 18)])
def test_phrases_equal_brute_force(spark, monkeypatch, share, bits):
    monkeypatch.setattr(phrases, "CHUNK", 500)
    rows = phrase_rows(3, 300)
    frame = spark.createDataFrame([(t, l, 1, 2) for t, l in rows], "text string, lang string, n int, phrase int")
    got = sorted(tuple(r) for r in phrases.collocations(frame, least=6, share=share, bits=bits).collect())
    assert got == brute_phrases(rows, 6)


def test_phrases_that_the_sample_misses_are_found(spark):
    """A sample without any document proposes nothing: everything beyond words comes from the expansion."""
    rows = [("p q r s", "en")] * 40
    frame = spark.createDataFrame(rows, "text string, lang string")
    found, tables = phrases.frequent(frame, 30, share=1e-12)
    assert len(tables) == 2 and {r["phrase"] for r in found.filter("words = 4").collect()} == {"p q r s"}
    assert phrases.collocations(frame.limit(0)).count() == 0


def test_top_phrases_and_exact_products(spark):
    rows = phrase_rows(4, 200)
    frame = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, phrases.collocations(frame, least=3, top=7, share=0.2).collect())) == brute_phrases(rows, 3, top=7)
    big = 10**13
    known = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 2)], "lang string, phrase string, words int, n long")
    assert phrases.scored(known.filter("words = 2"), known).first()["score"] == 2000000 * big // (2 * big + 3)


@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"."]), max_size=60), st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_a_chunk_counts_what_its_parts_allow(words, drop):
    chunk = phrases.Chunk("en")
    chunk.add(b" ".join(words))
    got = Counter()
    for found in phrases.count_chunk(chunk, None, phrases.Filter(None), 4, range(1, 5)):
        names = [p.decode()[:-1] for p in found[0].to_pylist()]
        if names and names[0]:
            assert phrases.phrase_hashes("en", [p.encode() for p in names]).tolist() == found[1].tolist()
        if not names:
            continue
        rows = [r for x in phrases.packed([("en", found)], 3).to_pylist() for lang, t in phrases.unpacked(x["langs"], x["phrases"], x["of"], x["n"]) for r in t.to_pylist() if lang == "en"]
        assert sorted(r["phrase"].decode()[:-1] for r in rows) == sorted(names)
        for r in rows:
            got[(len(r["phrase"].split()), r["phrase"].decode()[:-1])] += r["n"]
    want = Counter()
    for piece in b" ".join(words).decode().split("."):
        w = piece.split()
        for m in range(1, 5):
            for i in range(len(w) - m + 1):
                want[(m, " ".join(w[i:i + m]))] += 1
    total = got.pop((0, ""), 0)
    assert got == want and total == sum(c for (m, _), c in want.items() if m == 1)


def test_bloom_filter_holds_what_was_put_in(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-2**63, 2**63, 3000)
    kept = phrases.bloom(spark.createDataFrame([(int(x),) for x in h], "h long"), 1 << 20)
    assert kept.holds(h.view(np.uint64)).all()
    assert kept.holds(rng.integers(-2**63, 2**63, 20000).view(np.uint64)).mean() < 0.01


# ---- repair


def brute_repair(rows):
    """Cheapest and least edits by search over (row, state), kept apart from the matrices."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body.strip(" \t\n\x0b\x0c\r") else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}
    heap, best = [(0, "", 0, "", ())], {}
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            break
        if best.get((i, state), (cost, audit)) < (cost, audit) and best[(i, state)][0] < cost:
            continue
        best[(i, state)] = (cost, audit)
        to = {"": "u", "s": "u", "a": "u", "u": "a"}[state]
        name = {"u": "user", "a": "assistant"}[to]
        if len(audit) < 3 * len(rows) + 3:
            heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*lines, name + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                after = step.get(role[:1], {}).get(state)
                if after:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, after, (*lines, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, to, (*lines, f"{name}:{text}")))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def talk(rng, n):
    return [(rng.choice([None, *range(12)]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", "User"]), rng.choice(["Hi.", "Hi.", "Well", "", " \t", "No?", "ü!\n", "a\nb."]))
            for _ in range(n)]


@given(st.lists(st.integers(0, 8), max_size=40).flatmap(lambda x: st.tuples(st.just(x), st.integers(1, 70))))
@settings(max_examples=80, deadline=None)
def test_powers_equal_single_steps(drawn):
    few, times = drawn
    symbols = bytes(s for s in few for _ in range(times if s % 3 == 0 else 1))
    known = [conversations.FINISH]
    for s in reversed(symbols):
        known.append(conversations.applied(conversations.power(s, 0), known[-1]))
    known.reverse()
    assert conversations.costs(symbols, conversations.FINISH) == known
    assert conversations.applied(conversations.matrix(symbols), conversations.FINISH) == known[0]


@pytest.mark.parametrize("chunk", [4096, 3])
def test_repair_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rng = random.Random(5)
    rows = {c: talk(rng, rng.randint(1, 7)) for c in [None, *range(60)]}
    rows[100] = [(i // 2, "user", "Same.") for i in range(40)] + [(50, "assistant", "x" * 200_000 + ".")]
    flat = [(c, *r, "z", 1) for c, rs in rows.items() for r in rs]
    rng.shuffle(flat)
    frame = spark.createDataFrame(flat, "conv_id long, turn long, role string, text string, audit string, n int")
    got = {r[0]: tuple(r)[1:] for r in conversations.repaired(frame).collect()}
    small = {c: [(t, r, x) for t, r, x in rs] for c, rs in rows.items() if c != 100}
    assert {c: got[c] for c in small} == {c: brute_repair(rs) for c, rs in small.items()}
    assert got[100][2] == 39 and got[100][6].count("D") >= 39 and got[100][5] == 39 * 3
    assert conversations.repaired(frame.limit(0)).count() == 0


def test_a_long_conversation_lies_in_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", 50)
    rows = [(1, i, ("user", "assistant")[i % 2] if i % 11 else "user", f"t{i}." if i % 7 else "cut") for i in range(4000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversations.repaired(frame).collect()
    whole = conversations.unroll(bytes(1 + "sua".find(r[0][:1]) + 4 * r[1] if not r[2] else 0 for r in _marked(rows)), conversations.FINISH, 0, True)
    assert len(got) == 1 and got[0]["audit"] == "".join(whole[0])


def _marked(rows):
    seen = set()
    for _, _, role, text in rows:
        yield role, not text.endswith("."), (role, text) in seen
        seen.add((role, text))


def test_damage_and_report(spark):
    rows = [(c, t, ("user", "assistant")[t % 2] if t < 6 else None, f"Text {c}? Yes. {t}" if t % 3 else None) for c in range(40) for t in range(8)] + [(c, None, "user", "Without a turn.") for c in range(40)] + [(None, None, None, None), (None, 3, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    hurt = defaultdict(list)
    for c, t, role, text in rows:
        name = f"{' ' if c is None else c}:{' ' if t is None else t}"
        fate = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            hurt[c] += []
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        hurt[c] += [(t, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: brute_repair(rs) if rs else nothing for c, rs in hurt.items()}
    got = {r[0]: tuple(r)[1:] for r in conversations.repair_report(frame).collect()}
    assert got == want
    lost = spark.createDataFrame([(c, t, "user", "a.") for c in range(300) for t in [0] if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0], "conv_id long, turn long, role string, text string")
    assert lost.count() and {tuple(r)[1:] for r in conversations.repair_report(lost).collect()} == {nothing}
