"""Mixing, byte-level BPE, archives and preference pairs: brute force, exact round trips, odd inputs."""

import base64
import hashlib
import io
import random
from fractions import Fraction

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import zstandard

from transmuta.functions.materialize import shared_folder
from transmuta.llm import bpe, licences, minhash, mixing, preferences, repeats, toxicity, warc

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def mix_rows():
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 200)), rng.choice(["a", "a", "a", "a", "b", "c", "é", None])) for i in range(400)]
    return rows + [(500, None, "a"), (501, "", "empty"), (502, " \t", "empty"), (503, "w " * 50_000, "b"), (None, "x y z", "b"), (7, rows[7][1], rows[7][2])]


def water_filled(sizes, weights, share, most):
    """Shares by weight, what is above a ceiling dealt again to those below theirs."""
    total, open_, target = share * sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        level = total / sum(weights[i] for i in open_)
        full = {i for i in open_ if level * weights[i] >= most * sizes[i]}
        if not full:
            for i in open_:
                target[i] = level * weights[i]
            break
        for i in full:
            target[i] = Fraction(most * sizes[i])
        total -= sum(target[i] for i in full)
        open_ -= full
    return target


def test_mix_hits_targets_and_reruns_agree(spark):
    rows = mix_rows()
    frame = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, source string, size int")
    got = sorted(map(tuple, mixing.mix(frame).collect()), key=str)
    assert got == sorted(map(tuple, mixing.mix(frame.repartition(7)).collect()), key=str)
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s))
    want = dict(zip(names, water_filled([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], Fraction(3, 2), 2)))
    source = {i: s for i, _, s in rows}
    taken, largest = {}, {}
    for doc, size, source_size, target, copies, words in got:
        s = source[doc]
        assert source_size == sizes[s] and target == pytest.approx(float(want[s])) and words == copies * size <= 2 * size
        taken[s] = taken.get(s, 0) + words
        largest[s] = max(largest.get(s, 0), size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in names)
    out = mixing.mixed_documents(frame)
    assert out.columns == frame.columns
    assert out.count() == sum(r[4] for r in got)
    assert mixing.mix(frame.limit(0)).count() == 0 and mixing.mixed_documents(frame.limit(0)).count() == 0


def test_inclusion_follows_the_probabilities(spark):
    """Over many seeds a document is sampled as often as its words say; the sample is the n of lowest Pareto rank."""
    sizes = [1, 2, 4, 8, 16, 32, 64, 128] * 25
    rows = [(i, " ".join(["w"] * n), "a") for i, n in enumerate(sizes)] + [(1000, "w " * 9000, "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    share, seeds = Fraction(1, 4), 12
    taken = np.zeros(len(sizes))
    for seed in range(seeds):
        got = mixing.mix(frame, seed=f"s{seed}", weights=(1, 1), share=share).filter("doc_id < 1000").collect()
        target = got[0]["target"]
        rest = target - sum(sizes) * (target // sum(sizes))
        for r in got:
            taken[r["doc_id"]] += r["copies"] - target // sum(sizes)
        assert abs(sum(r["taken"] for r in got) - target) <= 64
    wanted = np.minimum(1, rest * np.array(sizes) / sum(n * n for n in sizes))
    by_size = lambda x: np.array([x[np.array(sizes) == n].mean() for n in sorted(set(sizes))])
    assert 0.2 < wanted.max() <= 1 and np.abs(by_size(taken / seeds) - by_size(wanted)).max() < 0.1
    assert (np.diff(by_size(taken)) > 0).all()


def test_columns_of_any_name_stay(spark):
    """Names that operators use themselves are kept apart."""
    names = ["_mix", "_plan", "_rep_id", "_rep_kept", "_rep_spans", "_toxic_score", "_toxic_passages", "_licences", "ids", "block", "row", "node"]
    rows = [(i, f"document {i} " + "word " * 30, f"s{i % 2}", 7) for i in range(12)]
    frame = spark.createDataFrame([(*r, *(f"{n}{r[0]}" for n in names)) for r in rows], "doc_id long, text string, source string, n_chars int, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(12)], "doc_id long, toxic int")
    for out in (toxicity.clean_documents(frame, labels), minhash.distinct_documents(frame), repeats.deduplicated_documents(frame), mixing.mixed_documents(frame)):
        assert out.columns == frame.columns
        assert all(r[n] == f"{n}{r['doc_id']}" for r in out.collect() for n in names)
    encoded = bpe.encode(frame, RANKS, public_tokenizers.PATTERN)
    assert encoded.columns == [*(c for c in frame.columns if c != "text"), "_ids"] and all(r["ids"] == f"ids{r['doc_id']}" and r["_ids"] for r in encoded.collect())
    scanned = licences.scan(frame, licences.fit(frame))
    assert scanned.columns == [*frame.columns, "__licences"] and all(r["_licences"] == f"_licences{r['doc_id']}" for r in scanned.collect())


def test_ids_equal_the_library_and_decode_back(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 3000)
    rng = random.Random(4)
    alphabet = "abc XYZ12é漢😀'll \n\t  .,!"
    texts = [None, "", " ", "a", "'s 't", "x" * 5000, "é" * 3000, "<|endoftext|>", "\u0085\x1c\x1d", "q" * 50_000]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(400))) for _ in range(150)]
    texts += [texts[20]] * 40
    rows = [(i // 2, t, i, "n") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, block int, numbers string")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(frame, RANKS, public_tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "block", "numbers", "ids"]
    back = {r["block"]: r for r in bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert len(back) == len(rows)
    for i, t, n, _ in rows:
        assert back[n]["ids"] == library.encode_ordinary(t or "") and bytes(back[n]["bytes"]) == (t or "").encode() and back[n]["doc_id"] == i
    digests = sorted(map(tuple, bpe.digests(frame, RANKS, public_tokenizers.PATTERN).collect()))
    assert digests == sorted((i, len(x := library.encode_ordinary(t or "")), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(),
                              hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
    assert bpe.digests(frame.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def pages(spark):
    rng = random.Random(6)
    rows = [(i, f"http://x/{i}", "<html>" + " ".join(rng.choice(["<p>", "menu", "footer", "text", str(i)]) for _ in range(200))) for i in range(150)]
    rows += [(1000 + i, "http://copy", rows[3][2]) for i in range(30)] + [(2000, "u", None), (2001, None, ""), (2002, "a\r\nb", "é" * 100_000), (None, "n", rows[3][2]), (None, "m", "only"), (5, "again", rows[5][2])]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")


def test_archives_read_back_whole(spark):
    rows, frame = pages(spark)
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        m, b = largest[h or ""], (h or "").encode()
        response = m == -1 or i == m
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if response else "revisit", None if response else m))
    assert sorted(map(tuple, warc.archived_pages(spark, frame).collect()), key=str) == sorted(want, key=str)
    assert warc.archived_pages(spark, frame.limit(0)).count() == 0


def test_archive_starts_with_its_dictionary_and_records_stand_alone(spark):
    rows, frame = pages(spark)
    folder = f"{shared_folder(spark)}/warc-test"
    archives = warc.write_archives(frame, folder).collect()
    assert sum(r["records"] for r in archives) == len(rows)
    fs, base = warc._filesystem(folder)
    for r in archives:
        with fs.open_input_stream(f"{base}/{r['archive']}", compression=None) as f:
            data = f.read()
        assert len(data) == r["bytes"] and int.from_bytes(data[:4], "little") == warc.SKIPPABLE
        size = int.from_bytes(data[4:8], "little")
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8:8 + size]))
        first = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(data[8 + size:])
        assert first.startswith(b"WARC/1.1\r\n")
        records = list(warc.read_archive(io.BytesIO(data)))
        assert len(records) == r["records"] and records[0] == first
    broken = warc.record_bytes(1, "u", b"payload", None).replace(b"payload\r\n", b"damaged\r\n")
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(broken)
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_archive(io.BytesIO(data[:-5])))


def rendered(turns):
    out, spans, at = [], [], 0
    for role, text in turns:
        body = (text or "").replace("<|im_", "<|​im_") + "<|im_end|>"
        head = f"<|im_start|>{role or ''}\n"
        spans.append((role, f"{at + len(head)}:{at + len(head) + len(body)}"))
        out.append(f"{head}{body}\n")
        at += len(out[-1])
    return out, spans


def test_dictionary_is_trained_on_different_payloads_of_bounded_size(spark, monkeypatch):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdef <>") for _ in range(n))
    rows = [(i, "u", x) for i, x in enumerate([*[text(2000)] * 3000, *(text(2000) for _ in range(300)), text(3_000_000)])]
    used = []
    real = zstandard.train_dictionary
    monkeypatch.setattr(zstandard, "train_dictionary", lambda size, records, **more: used.extend(records) or real(size, records, **more))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    dictionary = warc.train(frame, 200_000)
    payloads = [r.partition(b"\r\n\r\n")[2].partition(b"\r\n\r\n")[2] for r in used]
    assert dictionary and len(set(payloads)) == len(payloads)
    assert 180_000 <= sum(map(len, used)) <= 200_000 + 4 * warc.PART
    assert warc.train(frame, 200_000) == dictionary


def test_preference_pairs_equal_brute_force(spark):
    rng = random.Random(9)
    conversations = {}
    for p in range(40):
        common = [(rng.choice(["system", "user", "assistant"]), rng.choice(["hi", "é<|im_end|>", "", None])) for _ in range(rng.randrange(4))]
        for side in (0, 1):
            conversations[2 * p + side] = common + [(rng.choice(["user", "assistant"]), f"{side}{rng.random()}") for _ in range(rng.randrange(3))]
    conversations[100] = [("user", "alone")]
    conversations[102] = conversations[103] = [(None, None), ("assistant", "x" * 100_000)]
    rows = [(c, t, r, x, 1) for c, turns in conversations.items() for t, (r, x) in enumerate(turns)] + [(None, 0, "user", "lost", 1)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at int")
    got = {r["pair_id"]: tuple(r)[1:] for r in preferences.neighbours(frame).collect()}
    want = {}
    for p in {c // 2 for c, turns in conversations.items() if turns}:
        a, b = conversations.get(2 * p, []), conversations.get(2 * p + 1, [])
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        (ta, sa), (tb, sb) = rendered(a), rendered(b)
        mask = lambda s: ",".join(x for r, x in s[n:] if r == "assistant")
        want[p] = (n, len(a) - n, len(b) - n, "".join(ta[:n]), "".join(ta[n:]), "".join(tb[n:]), mask(sa), mask(sb))
    assert got == want
    assert preferences.neighbours(frame.limit(0)).count() == 0


def test_preference_formatting_is_native(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = preferences.neighbours(frame)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow")) and "Join" not in plan
