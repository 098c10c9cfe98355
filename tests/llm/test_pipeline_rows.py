"""The whole pipeline against a chain of plain Python stages; only the fitted toxicity predictions are taken from the operator."""

import base64
import hashlib
import random
from fractions import Fraction

import public_tokenizers
import tiktoken
from test_mixing_and_tokens import RANKS, water_filled
from test_near_and_repeats import brute_components
from test_toxicity_licences import corpus

import corpus_pipeline
from transmuta.llm import toxicity


def without_repeats(rows, width=100):
    """Texts without the bytes of any 100-byte string that started before; a character that loses a byte goes whole."""
    seen, out = set(), []
    for doc, text, source in sorted(rows):
        data = text.encode()
        covered = bytearray(len(data))
        for k in range(len(data) - width + 1):
            if (w := data[k:k + width]) in seen:
                covered[k:k + width] = b"\1" * width
            seen.add(w)
        out.append((doc, bytes(c for c, x in zip(data, covered) if not x).decode("utf-8", "ignore"), source))
    return out


def mixed(rows):
    """(doc, text) as often as the mix takes them."""
    size = {doc: len(text.split()) for doc, text, _ in rows}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    totals = [sum(size[d] for d, _, s in rows if s == n) for n in names]
    targets = water_filled(totals, [(3, 1, 2)[i % 3] for i in range(len(names))], Fraction(3, 2), 2)
    out = []
    for name, total, target in zip(names, totals, targets):
        mine = [(d, t) for d, t, s in rows if s == name]
        whole = target // total if total else 0
        rest, squares = target - whole * total, sum(size[d] ** 2 for d, _ in mine)
        ranked = []
        for d, t in mine:
            u = (int(hashlib.md5(f"pareto|{d}|{t}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = float(rest * size[d] / squares) if squares else 0.0
            ranked.append((0.0 if p >= 1 else 1e300 if p <= 0 else (u / (1 - u)) / (p / (1 - p)), d))
        upto, sampled = 0, set()
        for _, d in sorted(ranked):
            upto += size[d]
            if rest > 0 and 2 * upto - size[d] <= 2 * rest:
                sampled.add(d)
        for d, t in mine:
            out += [(d, t)] * (int(whole) + (d in sampled))
    return out


def test_run_equals_a_chain_of_plain_stages(spark, tmp_path):
    rng = random.Random(12)
    docs, labels = corpus(spark)
    rows = [(r["doc_id"], r["text"], f"s{r['doc_id'] % 4}" if r["doc_id"] % 9 else None) for r in docs.filter("doc_id < 300").collect()]
    passage = " ".join(rng.choice(["été", "pass", "age", "repeats"]) + str(i) for i in range(40))
    rows = [(d, f"{t} {passage}" if d % 10 == 3 else t, s) for d, t, s in rows]
    rows += [(1000 + d, t + (" extra" if d % 2 else ""), s) for d, t, s in rows[:25]]
    spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    predicted = toxicity.scored_documents(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    toxic = {r["doc_id"] for r in predicted.filter("predicted = 1").collect()}
    clean = [r for r in rows if r[0] not in toxic]
    component = brute_components([(d, t) for d, t, _ in clean])
    distinct = [r for r in clean if component[r[0]][1] == r[0]]
    cut = without_repeats(distinct)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((d, tuple(library.encode_ordinary(t))) for d, t in mixed(cut))
    assert got == want
    # every stage had something to do
    assert 0 < len(toxic) and len(distinct) < len(clean) < len(rows) and cut != sorted(distinct) and len(want) != len(cut)


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
