"""Phrase collocations by Toivonen's method: a sample proposes, one pass over everything decides.

Phrases are runs of 2 to LONGEST words inside a piece of text, counted per language. No phrase occurs more often than a part of it, so:

1. A sample of the documents (SHARE of them, chosen by a hash of the text) proposes phrases: those that reach a lowered
   threshold there. They are held as a Bloom filter of BITS bits, the only thing sent to every task; its size is a
   parameter and does not grow with the data. A false positive proposes a phrase too many, which costs a count.
2. A full pass counts, exactly, every word, the proposed phrases, and their negative border: the phrases whose first and
   whose last words but one are proposed while they themselves need not be.
3. A border phrase that turns out frequent is a failure: longer phrases that hold it have not been counted. An expansion pass
   over everything counts what the failures open up: the phrases not counted yet all of whose parts are known to be frequent or
   are being counted in this same pass. Every frequent phrase is then counted, so one expansion closes the result,
   which is exact whatever the sample was.

A task counts the words of a chunk as integers. What leaves it is packed: for each part of the phrases, dealt by their hash,
one row with its phrases and counts, compressed; a frequent phrase is one entry a chunk. A shuffle partition is a part: its task
sums it and keeps what is frequent, so its memory is bounded by the distinct phrases over the number of partitions. Scores are whole numbers, computed in decimals of 38 digits. A candidate's
parts are looked up by a join; parts that very many candidates share (at most 1 / HOT_SHARE of them can exist) are looked
up in a broadcast of that bound instead.

Defined results: null texts are empty, null languages are `und`, repeated rows count each time, ids play no part; pieces
without words give nothing; a text of any length is read whole, and a chunk ends only between texts; an empty table gives no rows; columns of any other name play no part. A cut's ties go to the shortest first part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from transmuta.functions.materialize import Written
from transmuta.llm.samples import below_share

LEAST = 30
LONGEST = 4
SHARE = 0.125
LOWERED = 0.8  # of the threshold that the sample's share would give
BITS = 1 << 26
CHUNK = 1_500_000  # words
COMPACT = 2_000_000  # entries that a summing task holds before it sums them
HOT_SHARE = 1 / 1000

#: Lower case for A to Z; the tab is a space; a piece ends at these marks and line breaks, which all become a full stop.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else ord(".") if c in b".,;:!?\x0a\x0b\x0c\x0d" else c for c in range(256))
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(31))


class Filter:
    """A Bloom filter of two probes; of no bits, it holds everything."""

    def __init__(self, bits: bytearray | None):
        self.bits = None if bits is None else np.frombuffer(bytes(bits), np.uint8)
        self.mask = np.uint64(0 if bits is None else len(bits) * 8 - 1)

    def holds(self, h: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(h), bool)
        found = np.ones(len(h), bool)
        for at in (h & self.mask, (h >> np.uint64(32)) & self.mask):
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
        return found


def bloom(phrases: DataFrame, bits: int = BITS) -> Filter:
    """The filter of `h`. Bits are set in tasks; only the filled blocks of 4 KB come to the driver, bits / 8 bytes at most."""
    places = phrases.select(F.explode(F.array(F.col("h"), F.shiftrightunsigned("h", 32))).alias("p")).select(F.col("p").bitwiseAND(bits - 1).alias("p"))
    blocks = places.groupBy(F.shiftright("p", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("bitmap"))
    out = bytearray(bits // 8)
    for r in blocks.collect():
        start = r["block"] * 4096
        out[start:start + 4096] = bytes(r["bitmap"])[:len(out) - start]
    return Filter(out)


class Words(dict):
    """Word to its number in the chunk; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Chunk:
    """Words of one language, as numbers."""

    def __init__(self, lang: str):
        self.lang, self.words, self.ids, self.n = lang, Words({b".": 0}), [], 0

    def add(self, texts: bytes) -> None:
        found = texts.translate(_TABLE).replace(b".", b" . ").split()  # what else splits bytes is in the table
        self.ids.append(np.fromiter(map(self.words.__getitem__, found), np.int32, len(found)))
        self.ids.append(np.zeros(1, np.int32))
        self.n += len(found)


Counted = tuple[pa.Array, np.ndarray, np.ndarray]


def count_chunk(chunk: Chunk, counted: Filter | None, known: Filter, longest: int, levels: range) -> Iterator[Counted]:
    """(phrases ended by a line break, hashes, counts) of the phrases of the lengths `levels` to be counted; the chunk's
    number of words stands under the empty phrase, with the words.

    known: the phrases that may be parts of longer ones. counted: by which filter an earlier pass chose what it counted;
    that is not counted again, and what it left out may be part of longer ones. None in a first pass.
    """
    ids = np.concatenate(chunk.ids) if chunk.ids else np.zeros(0, np.int32)
    words = list(chunk.words)
    hashes = np.fromiter(map(word_hash(chunk.lang), words), np.uint64, len(words))
    names, ended = pa.array(words, pa.binary()), pa.array([w + b"\n" for w in words], pa.binary())
    n = len(ids)
    raw = hashes[ids]  # of the phrase so far, before mixing
    whole = ids != 0
    if 1 in levels:
        n_of = np.bincount(ids, minlength=len(words))
        n_of[0] = 0
        at = np.flatnonzero(n_of)
        yield ended.take(pa.array(at)), _mixed(hashes[at]), n_of[at]
        yield pa.array([b"\n"], pa.binary()), np.zeros(1, np.uint64), np.array([int(whole.sum())])
    known_word = known.holds(_mixed(hashes))
    before = known_word[ids] & whole  # at a position: the phrase of the last length that starts there may be a part
    early = counted.holds(_mixed(hashes))[ids] & whole if counted else None  # the same in the earlier pass
    code, distinct = ids.astype(np.int64), len(words)  # its name in this chunk
    for m in range(2, longest + 1):
        if n < m:
            return
        size = n - m + 1
        raw = raw[:size] * _STEP + hashes[ids[m - 1:]]
        may = before[:size] & before[1:size + 1]
        at = np.flatnonzero(may)
        held = np.zeros(size, bool)
        if m < longest:
            held[at] = known.holds(_mixed(raw[at]))
        fresh = may
        if counted:
            done = early[:size] & early[1:size + 1]
            early = np.zeros(size, bool)
            if m < longest:
                there = np.flatnonzero(done)
                early[there] = counted.holds(_mixed(raw[there]))
            fresh = may & ~done
            held |= fresh
        before = may & held
        # named by the names of its first and its last words but one
        unique, first, place = np.unique(code[at] * distinct + code[at + 1], return_index=True, return_inverse=True)
        if m in levels:
            n_of = np.bincount(place[fresh[at]], minlength=len(unique))
            some = np.flatnonzero(n_of)
            start = at[first[some]]
            parts = [names.take(pa.array(ids[start + j])) for j in range(m - 1)] + [ended.take(pa.array(ids[start + m - 1]))]
            yield pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())), _mixed(raw[start]), n_of[some]
        if m < longest:
            code = np.full(size, -1, np.int64)
            code[at] = place
            distinct = max(1, len(unique))


def word_hash(lang: str):
    """Hash of a word of a language."""
    seed = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
    return lambda w: xxhash.xxh64_intdigest(w, seed)


def phrase_hashes(lang: str, phrases: list[bytes]) -> np.ndarray:
    """The hashes that count_chunk gives phrases."""
    of_word, known, mask, out = word_hash(lang), {}, (1 << 64) - 1, []
    for p in phrases:
        raw = 0
        for k, w in enumerate(p.split(b" ")):
            if w not in known:
                known[w] = of_word(w)
            raw = known[w] if not k else (raw * int(_STEP) + known[w]) & mask
        out.append(raw)
    return _mixed(np.array(out, np.uint64))


def packed(found: list[tuple[str, Counted]], parts: int) -> pa.RecordBatch:
    """One row for each part that has phrases: its phrases, the places of their languages, and their counts, compressed."""
    langs = list(dict.fromkeys(lang for lang, _ in found))
    phrases = pa.concat_arrays([f[0] for _, f in found])
    hashes, n = (np.concatenate([f[i] for _, f in found]) for i in (1, 2))
    of = np.concatenate([np.full(len(f[0]), langs.index(lang), np.uint32) for lang, f in found])
    part = (hashes % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    phrases, n, of, part = phrases.take(pa.array(order)), n[order].astype(np.int64), of[order], part[order]
    offsets = np.frombuffer(phrases.buffers()[1], np.int32)[:len(phrases) + 1]
    data = phrases.buffers()[2]
    starts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1))
    ends = np.append(starts[1:], len(part))
    pack = zstandard.ZstdCompressor(1).compress
    return pa.RecordBatch.from_pydict({
        "part": pa.array(part[starts].astype(np.int32)), "langs": pa.array([langs] * len(starts), pa.list_(pa.string())),
        "phrases": pa.array([pack(data.slice(int(offsets[a]), int(offsets[b] - offsets[a]))) for a, b in zip(starts, ends)], pa.binary()),
        "of": pa.array([pack(of[a:b].tobytes()) for a, b in zip(starts, ends)], pa.binary()), "n": pa.array([pack(n[a:b].tobytes()) for a, b in zip(starts, ends)], pa.binary())})


def unpacked(langs: list[str], phrases: bytes, of: bytes, n: bytes) -> Iterator[tuple[str, pa.Table]]:
    """(language, its phrases and counts)."""
    unpack = zstandard.ZstdDecompressor().decompress
    data = unpack(phrases)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    # the line breaks stay: they cost a byte and save a copy
    offsets = np.concatenate(([0], ends + 1)).astype(np.int32)
    table = pa.table({"phrase": pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]),
                      "n": pa.array(np.frombuffer(unpack(n), np.int64))})
    places = np.frombuffer(unpack(of), np.uint32)
    for place in np.unique(places).tolist():
        yield langs[place], table.filter(pa.array(places == place))


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("phrase", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"})


def counts(docs: DataFrame, least: int, known: Filter, counted: Filter | None = None, longest: int = LONGEST, levels: range | None = None) -> DataFrame:
    """lang, phrase, words, h, n of the phrases that docs (text, lang) hold at least `least` times; a language's number of
    words stands under words = 0."""
    levels = range(1, longest + 1) if levels is None else levels
    most, compact = CHUNK, COMPACT
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = docs.sparkSession.sparkContext.broadcast((known, counted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counted = held.value
        open_: dict[str, Chunk] = {}

        def closed() -> Iterator[pa.RecordBatch]:
            found = [(lang, f) for lang in list(open_) for f in count_chunk(open_.pop(lang), counted, known, longest, levels) if len(f[0])]
            if found:
                yield packed(found, partitions)

        for batch in batches:
            for lang in dict.fromkeys(batch["lang"].to_pylist()):
                mine = batch["text"].filter(pc.equal(batch["lang"], lang)).cast(pa.binary())
                for start in range(0, len(mine), 64):
                    open_.setdefault(lang, Chunk(lang)).add(b".".join(mine[start:start + 64].to_pylist()))
                    if sum(c.n for c in open_.values()) >= most:
                        yield from closed()
        yield from closed()

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, list[pa.Table]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("langs", "phrases", "of", "n"))):
                for lang, new in unpacked(*row):
                    tables.setdefault(lang, []).append(new)
                    size[lang] = size.get(lang, 0) + len(new)
                    if size[lang] > compact:
                        tables[lang] = [_summed(tables[lang])]
                        size[lang] = min(compact // 2, len(tables[lang][0]))
        for lang in list(tables):
            summed = _summed(tables.pop(lang))
            summed = summed.filter(pc.or_(pc.greater_equal(summed["n"], least), pc.equal(summed["phrase"], b"\n")))
            names, totals = [p[:-1] for p in summed["phrase"].to_pylist()], pa.array(summed["n"].to_numpy())
            for a in range(0, len(names), 50_000):
                part = names[a:a + 50_000]
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(part), pa.string()), "phrase": pa.array(part, pa.binary()).view(pa.string()),
                    "words": pa.array([p.count(b" ") + 1 if p else 0 for p in part], pa.int32()), "h": pa.array(phrase_hashes(lang, part).view(np.int64)),
                    "n": totals[a:a + 50_000]})

    rows = docs.mapInArrow(count, "part int, langs array<string>, phrases binary, of binary, n binary").repartitionById(partitions, "part")
    return rows.mapInArrow(sum_up, "lang string, phrase string, words int, h long, n long")


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: float = SHARE, lowered: float = LOWERED, bits: int = BITS) -> tuple[DataFrame, list[Written]]:
    """lang, phrase, words, n of all phrases of 1 to `longest` words that occur at least `least` times, and, under words = 0,
    each language's number of words; with the tables that hold them, to be dropped after use."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    sample = rows.filter(below_share(F.xxhash64("text", "lang"), share))
    limit = max(1, int(least * share * lowered)) if share < 1 else least
    everything = Filter(None)
    # the sample proposes words first, then phrases of them; the longest are parts of nothing
    proposed = [Written(counts(sample, limit, everything, longest=1).filter("words = 1"), "proposed-words")]
    if longest > 2:
        proposed.append(Written(counts(sample, limit, bloom(proposed[0].df, bits), Filter(bytearray(bits // 8)), longest - 1, range(2, longest)), "proposed-phrases"))
    counted = bloom(_union([p.df for p in proposed]), bits)
    for p in proposed:
        p.drop()
    found = [Written(counts(rows, least, counted, None, longest), "phrases")]
    short = found[0].df.filter(f"words BETWEEN 1 AND {longest - 1}")
    if not short.filter(~_held(counted, rows.sparkSession)("h")).isEmpty():
        found.append(Written(counts(rows, least, bloom(short, bits), counted, longest, range(2, longest + 1)), "phrases"))
    return _union([f.df for f in found]), found


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _held(filter_: Filter, spark):
    """Whether the filter holds a hash, as a column function."""
    held = spark.sparkContext.broadcast(filter_)

    @F.arrow_udf("boolean")
    def holds(h: pa.Array) -> pa.Array:
        return pa.array(held.value.holds(h.to_numpy().view(np.uint64)))
    return holds


def looked_up(left: DataFrame, right: DataFrame, on: list[str], spread_by: list[str]) -> DataFrame:
    """left (inner) joined with right, which has one row per key, where a few keys may hold most of left's rows.

    Keys with more than HOT_SHARE of left's rows, of which there are at most 1 / HOT_SHARE, are looked up in a broadcast; the
    other rows are shuffled by their key. Rows of hot keys are spread evenly in that shuffle and meet no partner.
    """
    total = left.count()
    if not total:
        return left.join(right, on)
    extra = [c for c in right.columns if c not in on]
    hot = left.groupBy(*on).count().filter(F.col("count") > total * HOT_SHARE).drop("count").join(right, on)
    hot = hot.select(*on, F.struct(*extra).alias("_hot"))
    marked = left.join(F.broadcast(hot), on, "left")
    marked = marked.withColumn("_spread", F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*spread_by), F.lit(1 << 20))).cast("int"))
    met = marked.join(right.select(*on, F.struct(*extra).alias("_cold"), F.lit(0).alias("_spread")), [*on, "_spread"], "left")
    value = F.coalesce("_hot", "_cold")
    return met.filter(value.isNotNull()).select(*left.columns, *[value[c].alias(c) for c in extra])


def scored(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score: the lowest-scoring cut of each candidate. known: lang, phrase, n of all their parts."""
    pieces = F.split("phrase", " ")
    k = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "words", F.col("n").alias("a"), k)
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.array_join(F.slice(pieces, 1, F.col("k")), " ").alias("part")),
                             F.struct(F.lit(1).alias("side"), F.array_join(F.slice(pieces, F.col("k") + 1, F.col("words")), " ").alias("part"))))
    parts = cuts.select("*", side.alias("s")).select("lang", "phrase", "words", "a", "k", "s.side", "s.part")
    found = looked_up(parts, known.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f")), ["lang", "part"], ["phrase", "k", "side"])
    both = found.groupBy("lang", "phrase", "words", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr("2000000BD * CAST(a AS DECIMAL(20,0)) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def covered(candidates: DataFrame) -> DataFrame:
    """lang, phrase, longer: the highest count of a longer candidate that holds the phrase."""
    inner = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    return candidates.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = 2000, share: float = SHARE, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language by score, a (both descending) and phrase."""
    found, _ = frequent(docs, least, longest, share, bits=bits)
    known = found.filter("words > 0").select("lang", "phrase", "words", "n")
    candidates = known.filter("words > 1")
    rows = scored(candidates, known).join(covered(candidates), ["lang", "phrase"], "left")
    kept = rows.filter(~F.coalesce(F.expr("5BD * longer >= 4BD * a"), F.lit(False)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", place.cast("long")).filter(F.col("rank") <= top)
    totals = found.filter("words = 0").select("lang", F.col("n").alias("n"))
    # one row a language on either side of this join's key; the left has at most `top` rows for each
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
