"""Near-duplicate documents by one-permutation MinHash with optimal densification.

A document's set is its distinct five-word shingles. One hash per shingle serves all 512 bins: its top bits name the bin,
the smallest hash of a bin is the bin's value. An empty bin takes the value of the first filled bin of its own fixed
pseudo-random order of bins (optimal densification), so bins stay independent. One byte of each value is the signature;
85 bands of six bytes are the buckets. Two large sets of similarity 0.75 share a bucket with probability 1 - 6e-8. A small set
fills few bins, so its signature may say little; the smallest sets, of up to PREFIX shingles also go to the buckets of their smallest
shingle hashes, as many as a partner of similarity 0.75 must share one of (prefix filter). So pairs whose smaller set has up to
three quarters of PREFIX shingles share a bucket for certain. Between these and large sets, the chance that a link of exactly 0.75 shares
no bucket falls with the size, from a few in a thousand at 25 shingles to 1e-6 at a few hundred.

Pairs are bounded by stars. Documents with equal sets are one class, represented by its smallest id. In every bucket each
representative is paired with the bucket's smallest one only; these pairs are confirmed on full sets and give first
components. Only buckets that still hold several components are looked at again: their signatures are compared in blocks
of bounded size inside a task, and a pair leaves the task only if its components differ, its signatures agree in so many bins as
a link's can't miss by chance, and the bucket is the first band the two share. The number of bins follows the sizes: SURE standard
errors below 75 %, with as many independent bins as the smaller set fills (a link falls below with a probability of about 1e-10).
Sets of up to TINY shingles are compared by 16 bits of each shingle instead: they have at least as many in common as the shingles have, so no link
is lost. Those pairs are confirmed on full sets too, so no link between components is lost to the star, and
no group is expanded into its pairs.

Sets hold 64-bit hashes of the shingles. Defined results: texts that are null or wordless have an empty set and are linked
with nothing; fewer than five words form one shingle; rows that share an id are one node, which is linked with whatever one of them
is linked with; rows with a null id have a null component and are kept; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from transmuta.functions.joins import lookup_join
from transmuta.functions.materialize import Written
from transmuta.llm.batches import groups, small
from transmuta.llm.components import components

WORDS = 5
PERCENT = 75
BINS = 512
ROWS = 6
BANDS = BINS // ROWS
PREFIX = 32  # shingles
TINY = 171  # shingles of a set that is compared by 16 bits of each
SURE = 6.5  # standard errors
BLOCK = 1024  # representatives compared with each other at a time
MEMO = 150_000
HUBS = 100  # sets broadcast at most
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_FACTORS = _mix(np.arange(1, WORDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes. bytes.lower() folds A-Z only, bytes.split() splits at the space and U+0009 to U+000D."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, _U)
    x = np.fromiter(map(hashes.__getitem__, words), _U, len(words))
    width = min(WORDS, len(words))
    n = len(x) - width + 1
    h = np.full(n, width, _U)
    for k in range(width):
        h = _mix(h) + x[k:n + k] * _FACTORS[k]
    return np.unique(_mix(h))


def _orders() -> np.ndarray:
    """orders[i, j]: when bin i looks at bin j for a value."""
    i = np.arange(BINS, dtype=_U)
    key = _mix(_mix(i[:, None] + _U(0x1234567)) ^ (i[None, :] * _U(0x9E3779B97F4A7C15)))
    return np.argsort(np.argsort(key, axis=1), axis=1).astype(np.uint16)


def signature(found: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """One byte per bin, of a non-empty sorted set."""
    bins = (found >> _U(64 - 9)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    full = bins[first]
    values = np.zeros(BINS, _U)
    values[full] = found[first]
    empty = np.setdiff1d(np.arange(BINS), full, assume_unique=True)
    if len(empty):
        values[empty] = values[full[np.argmin(orders[np.ix_(empty, full)], axis=1)]]
    return (_mix(values + _U(7)) >> _U(56)).astype(np.uint8)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, orders = WordHashes(), _orders()
    for batch in small(batches):
        sizes, prints, signs, firsts, tiny = [], [], [], [], []
        for text in batch["text"].to_pylist():
            s = shingles(text, hashes)
            sizes.append(len(s))
            prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            signs.append(signature(s, orders).tobytes() if len(s) else None)
            firsts.append(s[:prefix(len(s))].tobytes())
            tiny.append((s >> _U(8)).astype(np.uint16).tobytes() if len(s) <= TINY else b"")
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n": pa.array(sizes, pa.int64()),
                                          "print": pa.array(prints, pa.binary()), "sign": pa.array(signs, pa.binary()), "firsts": pa.array(firsts, pa.binary()),
                                          "tiny": pa.array(tiny, pa.binary())})


def prefix(n: int) -> int:
    """How many of the smallest hashes of a set of n a similar set must share one of; 0 for sets that go by bands alone."""
    return n - -(-n * PERCENT // 100) + 1 if 0 < n <= PREFIX else 0


def agreement(smaller: np.ndarray) -> np.ndarray:
    """Bins that the signatures of a link agree in, almost surely, by the size of its smaller set."""
    filled = BINS * -np.expm1(-smaller / BINS)
    share = PERCENT / 100
    least = share - SURE * np.sqrt(share * (1 - share) / np.maximum(filled, 1))
    return np.where(4 * smaller <= 3 * TINY, 0, np.maximum(0, BINS * least))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for part in small(batches, 200):
        found = [shingles(t, hashes).view(np.int64) for t in part["text"].to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
        values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
        yield pa.RecordBatch.from_arrays([part["doc_id"], values], ["doc_id", "set"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, node): the band's number above its six signature bytes; below 0 a shingle of the prefix."""
    for part in small(batches, 200):
        nodes = part["node"].to_numpy(zero_copy_only=False)
        firsts = [np.frombuffer(f, np.int64) | np.int64(-2**63) for f in part["firsts"].to_pylist()]
        keys = np.concatenate([band_keys(_matrix(part["sign"])).ravel(), *firsts])
        of = np.concatenate((np.repeat(nodes, BANDS), np.repeat(nodes, [len(f) for f in firsts])))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(of)], ["bucket", "node"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def band_keys(signs: np.ndarray) -> np.ndarray:
    parts = signs[:, :BANDS * ROWS].reshape(len(signs), BANDS, ROWS).astype(np.int64)
    keys = np.arange(BANDS, dtype=np.int64) << (8 * ROWS)
    return keys + (parts << (8 * np.arange(ROWS, dtype=np.int64))).sum(axis=2)


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a block or of two blocks of one bucket that may be links between components."""
    for table in groups(batches, ("bucket", "low", "high")):
        signs, nodes, comps, sizes, blocks = (_matrix(table["sign"]), *(table[c].to_numpy() for c in ("node", "component", "n", "block")))
        bucket = table["bucket"][0].as_py()
        band = bucket >> (8 * ROWS)
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        small_sets = _tiny(table["tiny"].to_pylist())
        left = np.flatnonzero(blocks == low)
        right = np.flatnonzero(blocks == high)
        out: list[tuple[int, int]] = []
        for i in left.tolist():
            near = right[(nodes[right] > nodes[i]) if low == high else slice(None)]
            near = near[(comps[near] != comps[i]) & (np.minimum(sizes[near], sizes[i]) * 100 >= PERCENT * np.maximum(sizes[near], sizes[i]))]
            if not len(near):
                continue
            if sizes[i] <= TINY:
                compared = sizes[near] <= TINY
                near = np.concatenate((near[~compared], _alike(i, near[compared], small_sets, sizes)))
            same = signs[near] == signs[i]
            near, same = near[hit := same.sum(axis=1) >= agreement(np.minimum(sizes[near], sizes[i]))], same[hit]
            if bucket >= 0 and len(near):
                shared = same[:, :BANDS * ROWS].reshape(len(near), BANDS, ROWS).all(axis=2)
                near = near[shared.argmax(axis=1) == band]
            out += [(int(nodes[i]), int(nodes[j])) for j in near]
        if out:
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _tiny(sets: list[bytes]) -> np.ndarray:
    """16 bits of each shingle, a row per set, filled up with a value of none."""
    rows = [np.frombuffer(s, np.uint16) for s in sets]
    out = np.full((len(rows), max((len(r) for r in rows), default=0)), 1 << 16, np.int32)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _alike(i: int, near: np.ndarray, small_sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Those of `near` that may have enough shingles in common with set i."""
    if not len(near):
        return near
    held = np.zeros((1 << 16) + 1, np.uint8)
    held[small_sets[i]] = 1
    held[1 << 16] = 0
    common = held[small_sets[near]].sum(axis=1, dtype=np.int64)
    return near[common * (100 + PERCENT) >= PERCENT * (sizes[near] + sizes[i])]


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    # a bucket's hub is in a pair with each of its members
    both = lookup_join(pairs, a, ["a"], ["b"], most_hot=HUBS).join(b, "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return both.filter(F.col("common") * 100 >= PERCENT * (F.size("set_a") + F.size("set_b") - F.col("common"))).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of docs."""
    rows = docs.select("doc_id", "text")
    signed = Written(rows.mapInArrow(_signatures, "doc_id long, n long, print binary, sign binary, firsts binary, tiny binary"), "signatures").df
    classes = signed.filter("print IS NOT NULL AND doc_id IS NOT NULL").groupBy("print").agg(
        F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sign").alias("sign"), F.first("firsts").alias("firsts"), F.first("tiny").alias("tiny"))
    nodes = Written(classes, "classes").df
    bands = nodes.select("node", "sign", "firsts").mapInArrow(_bands, "bucket long, node long")
    shared = Written(bands.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("size")).filter("size > 1"), "buckets").df
    members = Written(bands.join(shared, "bucket"), "members").df
    involved = Written(members.select(F.col("node").alias("doc_id")).distinct(), "involved").df
    sets = Written(rows.join(involved, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, set array<bigint>").dropDuplicates(["doc_id", "set"]), "sets").df

    # an id with several texts is a node of several classes
    named = signed.filter("print IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "print").distinct()
    several = named.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    of_id = named.join(several, "doc_id").join(nodes.select("print", "node"), "print")
    same_id = of_id.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).filter("a <> b").distinct()

    star = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    linked = Written(_confirmed(star, sets), "links").df
    first = Written(components(linked.unionByName(same_id)), "components").df
    placed = members.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("bucket").agg((F.min("component") < F.max("component")).alias("mixed")).filter("mixed").select("bucket")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    again = placed.join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))) \
        .select("bucket", "node", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")) \
        .join(nodes.select("node", "n", "sign", "tiny"), "node")
    crossing = Written(again.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
                       .mapInArrow(_crossing, "a long, b long").distinct(), "crossing").df
    more = _confirmed(crossing, sets)
    found = Written(components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "components").df

    whole = signed.select("doc_id", "n", "print").join(nodes.select("print", "node"), "print", "left").join(found, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return whole.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates; columns of docs."""
    kept = near_duplicates(docs).filter("kept").select("doc_id").distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["doc_id"]), "left_semi")
