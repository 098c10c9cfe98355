"""Removing repeated passages: every byte covered by a string of WIDTH bytes that also starts earlier.

Texts are cut into runs of windows with a common content-defined anchor (`anchors`), so equal windows meet by anchor. Most
runs have an anchor that occurs once and are done. Equal runs are counted once: all but the earliest are repeats whole.
What remains, different runs with one anchor, are the shards: their bytes are concatenated, the suffix array is induced
and the permuted common prefixes tell which windows agree in WIDTH bytes (`suffix_array`); the earliest of them stays.
A shard is a chunk of whole groups of about CHUNK bytes. A group of more than LARGE different runs is never brought
together: its windows are compared by digest, an aggregate that combines before it shuffles.

Order is by document id (null first), then position. Every text is UTF-8 bytes; null is empty. Defined results: texts
shorter than WIDTH keep everything; rows that share id and text are one document, so each gets the same result; rows that
share an id only are ordered by a hash of the text; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from transmuta.functions.materialize import Written, free_shuffles
from transmuta.llm.anchors import runs
from transmuta.llm.batches import small
from transmuta.llm.tables import apart
from transmuta.llm.suffix_array import permuted_common_prefixes, suffix_array

WIDTH = 100
LARGE = 2000
CHUNK = 1 << 20

_RUN = "anchor long, print long, id long, mark long, start int, windows int"
_KEY = ["id", "mark"]


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with id and mark, which name a document; null ids come first."""
    return docs.withColumn("_rep_id", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))).withColumn("_rep_mark", F.xxhash64("text"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        columns = [[] for _ in range(6)]
        size = 0
        for id_, mark, text in zip(batch["id"].to_numpy(), batch["mark"].to_numpy(), batch["text"].to_pylist()):
            data = text.encode()
            anchor, start, windows = runs(data, WIDTH)
            if not len(anchor):
                continue
            view = memoryview(data)
            prints = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(start.tolist(), (start + windows + WIDTH - 1).tolist())), np.uint64, len(anchor))
            for column, part in zip(columns, (anchor, prints.view(np.int64), np.full(len(anchor), id_), np.full(len(anchor), mark), start.astype(np.int32), windows.astype(np.int32))):
                column.append(part)
            size += len(anchor)
            if size > 50_000:
                yield _batch(columns)
                columns, size = [[] for _ in range(6)], 0
        if size:
            yield _batch(columns)


def _batch(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["anchor", "print", "id", "mark", "start", "windows"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, id, mark, start, bytes) of the runs asked for."""
    for batch in small(batches, 100):
        out = []
        size = 0
        for row in batch.to_pylist():
            data = row["text"].encode()
            for x in row["wanted"]:
                piece = data[x["start"]:x["start"] + x["windows"] + WIDTH - 1]
                out.append((x["anchor"], x["large"], row["id"], row["mark"], x["start"], piece))
                size += len(piece)
            if size > 1 << 22:
                yield _string_batch(out)
                out, size = [], 0
        if out:
            yield _string_batch(out)


def _string_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["anchor", "large", "id", "mark", "start", "bytes"])


def repeated_windows(strings: list[bytes], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(string, offset) of the windows that equal an earlier one; order: columns that rank a string's first window (last: its position)."""
    lengths = np.array([len(s) for s in strings])
    t = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8).astype(np.int64) + 2
    ends = np.cumsum(lengths + 1) - 1
    t[ends] = 1
    t = np.append(t, 0)
    begins = ends - lengths
    owner = np.repeat(np.arange(len(strings)), lengths + 1)
    sa = suffix_array(t, 258)
    common = permuted_common_prefixes(t, sa)[sa]
    inside = np.zeros(len(t), bool)
    inside[:len(owner)] = np.arange(len(owner)) <= ends[owner] - WIDTH
    # a window has no separator in its first WIDTH bytes, so suffixes between two equal windows are equal windows too
    rank_start = np.flatnonzero(np.concatenate(([True], common[1:] < WIDTH)))
    group = np.repeat(np.arange(len(rank_start)), np.diff(rank_start, append=len(sa)))
    keep = inside[sa]
    places, group = sa[keep], group[keep]
    string, offset = owner[places], places - begins[owner[places]]
    by = np.lexsort((order[string, -1] + offset, *(order[string, i] for i in range(order.shape[1] - 2, -1, -1)), group))
    first = np.concatenate(([True], group[by][1:] != group[by][:-1]))
    later = by[~first]
    return string[later], offset[later]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, start, end) of repeated bytes; rows are sorted by anchor, a chunk holds whole groups."""
    strings: list[bytes] = []
    order: list[tuple[int, int, int]] = []
    size, last = 0, None
    for batch in batches:
        for anchor, id_, mark, start, data in zip(*(batch[c].to_pylist() for c in ("anchor", "id", "mark", "start", "bytes"))):
            if size > CHUNK and anchor != last:
                yield from _shard(strings, order)
                strings, order, size = [], [], 0
            strings.append(data)
            order.append((id_, mark, start))
            size += len(data)
            last = anchor
    if strings:
        yield from _shard(strings, order)


def _shard(strings: list[bytes], order: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    key = np.array(order, np.int64)
    string, offset = repeated_windows(strings, key)
    if not len(string):
        return
    by = np.lexsort((offset, string))
    string, offset = string[by], offset[by]
    new = np.flatnonzero(np.concatenate(([True], (string[1:] != string[:-1]) | (offset[1:] != offset[:-1] + 1))))
    end = np.append(new[1:], len(string)) - 1
    owner = key[string[new]]
    yield _spans(owner[:, 0], owner[:, 1], owner[:, 2] + offset[new], owner[:, 2] + offset[end] + WIDTH)


def _spans(id_, mark, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(id_), pa.array(mark), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], [*_KEY, "start", "end"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(print, id, mark, start) of every window of a large group's runs; print: 16 bytes of digest."""
    for batch in batches:
        out = []
        for id_, mark, start, data in zip(*(batch[c].to_pylist() for c in (*_KEY, "start", "bytes"))):
            out += [(xxhash.xxh3_128_digest(data[i:i + WIDTH]), id_, mark, start + i) for i in range(len(data) - WIDTH + 1)]
            if len(out) > 50_000:
                yield _window_batch(out)
                out = []
        if out:
            yield _window_batch(out)


def _window_batch(rows: list[tuple]) -> pa.RecordBatch:
    prints, ids, marks, starts = zip(*rows)
    halves = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(starts, pa.int32())],
                                      ["high", "low", *_KEY, "start"])


def _not_first(rows: DataFrame, same: list[str]) -> DataFrame:
    """The rows that are not the earliest of their group. The earliest is a partial aggregate, a hot group's join back can be split."""
    first = rows.groupBy(*same).agg(F.min(F.struct("id", "mark", "start")).alias("first"))
    return rows.join(first, same).filter(F.struct("id", "mark", "start") != F.col("first"))


def repeated_spans(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """(id, mark, start, end) of bytes to remove, as spans that may overlap; id, mark as _keyed names documents."""
    spark = docs.sparkSession
    texts = _keyed(docs.select("doc_id", "text")).filter(F.octet_length("text") >= WIDTH).select(F.col("_rep_id").alias("id"), F.col("_rep_mark").alias("mark"), "text")
    every = Written(texts.mapInArrow(_runs, _RUN), "runs")
    again = Written(every.df.groupBy("anchor").count().filter("count > 1").select("anchor"), "anchors")
    free_shuffles(spark)
    shared = Written(every.df.join(again.df, "anchor"), "shared-runs")
    free_shuffles(spark)
    every.drop()
    again.drop()

    # runs that are equal whole: the earliest stands for all
    kinds = shared.df.groupBy("anchor", "print").agg(F.min(F.struct("id", "mark", "start")).alias("first"), F.first("windows").alias("windows"))
    kinds = Written(kinds, "kinds")
    copies = shared.df.join(kinds.df.select("anchor", "print", "first"), ["anchor", "print"]).filter(F.struct("id", "mark", "start") != F.col("first")) \
        .select("id", "mark", "start", (F.col("start") + F.col("windows") + WIDTH - 1).alias("end"))
    copies = Written(copies, "copies")
    free_shuffles(spark)
    shared.drop()

    # different runs with one anchor
    several = kinds.df.groupBy("anchor").count().filter("count > 1").select("anchor", (F.col("count") > large).alias("large"))
    wanted = kinds.df.join(several, "anchor").groupBy(F.col("first.id").alias("id"), F.col("first.mark").alias("mark")) \
        .agg(F.collect_list(F.struct(F.col("first.start").alias("start"), "windows", "anchor", "large")).alias("wanted"))
    strings = Written(texts.dropDuplicates(_KEY).join(wanted, _KEY).select("id", "mark", "text", "wanted")
                      .mapInArrow(_strings, "anchor long, large boolean, id long, mark long, start int, bytes binary"), "strings")
    free_shuffles(spark)
    kinds.drop()
    spans = "id long, mark long, start int, end int"
    partly = strings.df.filter("NOT large").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shards, spans)
    windows = strings.df.filter("large").mapInArrow(_windows, "high long, low long, id long, mark long, start int")
    windows = _not_first(windows, ["high", "low"]).select("id", "mark", "start", (F.col("start") + WIDTH).cast("int").alias("end"))
    return copies.df.union(partly).union(windows)


def _merge(spans: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs."""
    if not spans:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.array([(s["start"], s["end"]) for s in spans], np.int64)
    a = a[np.argsort(a[:, 0], kind="stable")]
    reach = np.maximum.accumulate(a[:, 1])
    new = np.flatnonzero(np.concatenate(([True], a[1:, 0] > reach[:-1])))
    return a[new, 0], reach[np.append(new[1:], len(a)) - 1]


def _with_kept(as_text: bool):
    """The bytes that remain; as text without the bytes of broken characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 200):
            kept, removed, count = [], [], []
            names = batch.schema.names
            texts, spans = batch.column(names.index("text")).to_pylist(), batch.column(names.index("_rep_spans")).to_pylist()
            for text, found in zip(texts, spans):
                data = (text or "").encode()
                starts, ends = _merge(found or [])
                rest = b"".join(data[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(data)]))
                kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
                removed.append(int((ends - starts).sum()))
                count.append(len(starts))
            at = names.index("_rep_spans")
            others = [batch.column(i) for i in range(len(names)) if i != at]
            yield pa.RecordBatch.from_arrays([*others, pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(removed, pa.int64()), pa.array(count, pa.int64())],
                                             [*(n for n in names if n != "_rep_spans"), "_rep_kept", "_rep_removed", "_rep_count"])
    return run


def without_repeats(docs: DataFrame, large: int = LARGE, as_text: bool = False) -> DataFrame:
    """docs with _rep_kept (what remains, as bytes or text), _rep_removed (bytes) and _rep_count (maximal removed runs)."""
    spans = repeated_spans(docs, large).groupBy(F.col("id").alias("_rep_id"), F.col("mark").alias("_rep_mark")) \
        .agg(F.collect_list(F.struct("start", "end")).alias("_rep_spans"))
    spans = Written(spans, "spans").df
    free_shuffles(docs.sparkSession)
    joined = _keyed(docs).join(spans, ["_rep_id", "_rep_mark"], "left").drop("_rep_id", "_rep_mark").select(*(F.col(f"`{c}`") for c in docs.columns), "_rep_spans")
    return joined.mapInArrow(_with_kept(as_text), T.StructType([
        *docs.schema.fields, T.StructField("_rep_kept", T.StringType() if as_text else T.BinaryType()),
        T.StructField("_rep_removed", T.LongType()), T.StructField("_rep_count", T.LongType())]))


def digests(docs: DataFrame, large: int = LARGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    return without_repeats(docs.select("doc_id", "text"), large).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("_rep_removed").alias("n_removed"),
        F.col("_rep_count").alias("n_spans"), F.sha2("_rep_kept", 256).alias("kept_sha256"))


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """docs with texts that lack the repeated bytes; a character that loses one of its bytes goes whole. Columns of docs."""
    own = apart(docs, ("doc_id", "text", "n_chars"))
    kept = without_repeats(own, as_text=True)
    cut = F.col("_rep_count") > 0
    changed = {"text": F.when(cut, F.col("_rep_kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length("_rep_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumns(changed).select(*(F.col(f"`{c}`") for c in own.columns)).toDF(*docs.columns)
