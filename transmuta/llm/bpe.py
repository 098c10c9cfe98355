"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

A task cuts its texts into pre-tokens, in blocks of about BLOCK characters. A block numbers its distinct words, the
frequent first, and every text becomes the list of its words' numbers, in order: that list is each pre-token with its
position. Words leave the block once each, packed by a hash of the word, so equal words of all blocks meet; there every
distinct word is encoded once. Ids go back to their block, keyed by the word's number, and every text is put together by
position. Neither texts nor single pre-tokens are shuffled; what moves is one entry per (block, distinct word) and the
packed number lists. The most frequent word has one entry per block, so no word is hot.

Decoding joins ids with the token-byte table, whose size is the vocabulary's: it is broadcast.

Defined results: null and empty texts have no ids; repeated rows and ids are encoded row by row; other columns are
carried along unchanged; an empty table gives an empty table. A block is named by its content; one whose words do not
all come back (an input that changes between two reads) is an error, never a wrong result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from transmuta.llm.tables import free_name
from transmuta.llm.batches import small

BLOCK = 8_000_000  # characters of text per block
_PLANES = (0, 8, 16, 24)


class Vocabulary:
    """Ranks of a public vocabulary and the pattern that cuts texts; built in a worker from the file's bytes."""

    def __init__(self, data: bytes, pattern: str):
        pairs = [line.split() for line in data.splitlines() if line.strip()]
        ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        table = [b""] * size
        for token, rank in ranks.items():
            table[rank] = token
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def encode_word(self, word: bytes) -> list[int]:
        return self.encoding._core_bpe.encode_single_piece(word)


_built: dict[tuple[bytes, str], Vocabulary] = {}


def _vocabulary(data: bytes, pattern: str) -> Vocabulary:
    key = (hashlib.sha1(data).digest(), pattern)
    if key not in _built:
        _built.clear()
        _built[key] = Vocabulary(data, pattern)
    return _built[key]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the concatenated runs [start, start + length)."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _pack(numbers: np.ndarray, zip_: zstandard.ZstdCompressor) -> bytes:
    """Byte planes compress well, as frequent words have small numbers."""
    x = numbers.astype(np.uint32)
    return struct.pack("<I", len(x)) + zip_.compress(b"".join((x >> s).astype(np.uint8).tobytes() for s in _PLANES))


def _unpack(packed: bytes, unzip: zstandard.ZstdDecompressor) -> np.ndarray:
    n, = struct.unpack_from("<I", packed)
    planes = np.frombuffer(unzip.decompress(packed[4:], max_output_size=max(1, 4 * n)), np.uint8).reshape(4, n).astype(np.int64)
    return planes[0] | planes[1] << 8 | planes[2] << 16 | planes[3] << 24


class Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _blocks(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary):
    """(block id, words, numbers of each text, (batch, row) of each text); a word's number is its place by frequency.

    The id is a digest of the block's texts, so that both reads of the input agree on it.
    """
    words = Numbers()
    lists, where, size, digest = [], [], 0, xxhash.xxh3_64()

    def close():
        numbers = np.concatenate(lists) if lists else np.empty(0, np.uint32)
        order = np.argsort(-np.bincount(numbers, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        names = list(words)
        return digest.intdigest() - (1 << 63), [names[i] for i in order], [rank[x] for x in lists], where

    for batch in small(batches):
        for row, text in enumerate(batch["text"].to_pylist()):
            found = vocabulary.cut(text) if text else []
            lists.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
            where.append((batch, row))
            size += len(text or "") + 1
            data = text.encode() if text else b""
            digest.update(struct.pack("<q", len(data)) + data)
            if size >= BLOCK:
                yield close()
                words, lists, where, size, digest = Numbers(), [], [], 0, xxhash.xxh3_64()
    if where:
        yield close()


def _word_rows(data, pattern: str, parts: int):
    """(part, block, numbers, lengths, words): the distinct words of a block whose hash falls in the part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, zip_ = _vocabulary(data.value, pattern), zstandard.ZstdCompressor(1)
        for block, words, _, _ in _blocks(batches, vocabulary):
            names = [w.encode() for w in words]
            part = np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in names), np.int64, len(names))
            order = np.argsort(part, kind="stable")
            rows = []
            for group in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(order) else []:
                mine = [names[i] for i in group.tolist()]
                rows.append((int(part[group[0]]), block, _pack(np.diff(group, prepend=0), zip_),
                             _pack(np.array([len(w) for w in mine]), zip_), zip_.compress(b"".join(mine))))
            yield from _batches(rows, ("part", "block", "numbers", "lengths", "words"), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))
    return run


def _batches(rows: list[tuple], names: Sequence[str], kinds: Sequence[pa.DataType], most: int = 64) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), most):
        columns = zip(*rows[i:i + most])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))


def _encode_words(data, pattern: str):
    """(block, numbers, lengths, ids) of each packed row; a part is one group of a sorted partition, its words are kept while it lasts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, zip_, unzip = _vocabulary(data.value, pattern), zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()
        known: dict[bytes, list[int]] = {}
        current = None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["part"] != current:
                    known, current = {}, row["part"]
                ends = np.cumsum(_unpack(row["lengths"], unzip)).tolist()
                text = unzip.decompress(row["words"], max_output_size=max(1, ends[-1] if ends else 1))
                found, start = [], 0
                for end in ends:
                    word = text[start:end]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = vocabulary.encode_word(word)
                    found.append(ids)
                    start = end
                rows.append((row["block"], row["numbers"], _pack(np.array([len(x) for x in found]), zip_),
                             _pack(np.array([i for x in found for i in x]), zip_)))
            yield from _batches(rows, ("block", "numbers", "lengths", "ids"), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))
    return run


def _text_rows(data, pattern: str, carry: Sequence[str]):
    """(block, place, carried columns, numbers): place counts the texts of a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, zip_ = _vocabulary(data.value, pattern), zstandard.ZstdCompressor(1)
        for block, words, lists, where in _blocks(batches, vocabulary):
            for start in range(0, len(lists), 500):
                part = slice(start, start + 500)
                n = len(lists[part])
                kept = []
                for name in carry:
                    pieces = [b.column(b.schema.get_field_index(name)).slice(r, 1) for b, r in where[part]]
                    kept.append(pa.concat_arrays(pieces))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), pa.array(range(start, start + n), pa.int64()), pa.array([len(words)] * n, pa.int64()), *kept,
                     pa.array([_pack(x, zip_) for x in lists[part]], pa.binary())],
                    ["block", "place", "distinct", *(f"c{i}" for i in range(len(carry))), "numbers"])
    return run


def _assemble(carry: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        block, packed, table = None, [], None
        for batch in small(batches):
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            blocks, places = columns["block"].to_pylist(), columns["place"].to_pylist()
            out, rows = [], []
            for row in range(batch.num_rows):
                if blocks[row] != block:
                    block, packed, table = blocks[row], [], None
                numbers = columns["numbers"][row].as_py()
                if places[row] < 0:  # words sort before texts
                    packed.append((numbers, columns["lengths"][row].as_py(), columns["ids"][row].as_py()))
                    continue
                if table is None:
                    table = _table(packed, columns["distinct"][row].as_py(), unzip)
                    packed = []
                starts, lengths, ids = table
                x = _unpack(numbers, unzip)
                out.append(ids[ragged(starts[x], lengths[x])])
                rows.append(row)
            for start in range(0, len(rows), 200):
                mine = out[start:start + 200]
                chosen = pa.array(rows[start:start + 200])
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in mine]))).astype(np.int32))
                values = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(mine).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(columns[f"c{i}"].take(chosen) for i in range(len(carry))), values],
                                                 [*(f"c{i}" for i in range(len(carry))), "ids"])
    return run


def _table(packed: list[tuple[bytes, bytes, bytes]], distinct: int, unzip) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each word's ids by the word's number, and the ids."""
    numbers = np.concatenate([np.cumsum(_unpack(n, unzip)) for n, _, _ in packed] or [np.empty(0, np.int64)])
    sizes = np.concatenate([_unpack(n, unzip) for _, n, _ in packed] or [np.empty(0, np.int64)])
    ids = np.concatenate([_unpack(n, unzip) for _, _, n in packed] or [np.empty(0, np.int64)])
    starts, lengths = np.full(distinct, -1, np.int64), np.zeros(distinct, np.int64)
    starts[numbers], lengths[numbers] = np.cumsum(sizes) - sizes, sizes  # blocks of equal texts have equal words and ids
    if (starts < 0).any():
        raise RuntimeError("the words of a block did not come back whole: the documents changed between two reads")
    return starts, lengths, ids.astype(np.int32)


def _broadcast_file(spark: SparkSession, path: str):
    with open(path, "rb") as f:  # a vocabulary beside the driver, of fixed size
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, parts: int | None = None, finish=None) -> DataFrame:
    """docs with the text replaced by its ids (array<int>); a column ids of docs stays, and the ids are then in _ids.

    path: a rank file; parts: groups of words, by default as many as shuffle partitions; finish: (function of Arrow
    batches, schema) that the task which puts a text together applies to it at once, so that ids need not leave it.
    """
    spark = docs.sparkSession
    data = _broadcast_file(spark, path)
    carry = [c for c in docs.columns if c != "text"]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    renamed = docs.select("text", *carry).toDF("text", *(f"c{i}" for i in range(len(carry))))
    fields = [T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)]
    names = [f.name for f in fields]
    schema = lambda *own: T.StructType([T.StructField(n, t) for n, t in own])
    long, binary = T.LongType(), T.BinaryType()
    words = renamed.mapInArrow(_word_rows(data, pattern, parts), schema(("part", long), ("block", long), ("numbers", binary), ("lengths", binary), ("words", binary)))
    encoded = words.repartition(parts, "part").sortWithinPartitions("part") \
        .mapInArrow(_encode_words(data, pattern), schema(("block", long), ("numbers", binary), ("lengths", binary), ("ids", binary)))
    texts = renamed.mapInArrow(_text_rows(data, pattern, names), T.StructType([
        *schema(("block", long), ("place", long), ("distinct", long)).fields, *fields, T.StructField("numbers", binary)]))
    both = encoded.withColumn("place", F.lit(-1).cast("long")).unionByName(texts, allowMissingColumns=True)
    ready = both.repartition("block").sortWithinPartitions("block", "place")
    assemble = _assemble(carry)
    if finish is None:
        return ready.mapInArrow(assemble, T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])).toDF(*carry, free_name(docs, "ids"))
    last, schema = finish

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return last(b.rename_columns([*carry, "ids"]) for b in assemble(batches))
    return ready.mapInArrow(finished, schema)


def _decoder(data, pattern: str):
    """batches with ids -> batches with bytes beside them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(data.value, pattern)
        for batch in batches:
            texts = []
            for x in batch.column(batch.schema.get_field_index("ids")):
                x = x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, np.int64)
                texts.append(v.bytes[ragged(v.starts[x], v.lengths[x])].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "bytes"])
    return run


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded with bytes: the tokens' bytes, by a join with the broadcast token-byte table."""
    data = _broadcast_file(encoded.sparkSession, path)
    return encoded.mapInArrow(_decoder(data, pattern), T.StructType([*encoded.schema.fields, T.StructField("bytes", T.BinaryType())]))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: texts encoded, and the ids decoded again, in the task that puts a text together."""
    decoded = _decoder(_broadcast_file(docs.sparkSession, path), pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decoded(batches):
            ids = batch.column(batch.schema.get_field_index("ids"))
            hashed = [hashlib.sha256(x.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes()).hexdigest() for x in ids]
            back = [hashlib.sha256(x.as_py()).hexdigest() for x in batch.column(batch.schema.get_field_index("bytes"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), pa.array([len(x) for x in ids], pa.int64()), pa.array(hashed), pa.array(back)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return encode(docs.select("doc_id", "text"), path, pattern, finish=(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
