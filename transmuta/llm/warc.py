"""WARC archives compressed with a Zstandard dictionary, one frame per record.

An archive starts with a skippable frame that holds the dictionary; every record follows as a frame of its own, so it can
be read alone. The dictionary is trained on archived records: about SAMPLE bytes of different payloads, those of smallest
hash, of each the first PART characters (bounds of the training; every record is written whole). With too few records to
train on, archives have no dictionary.

Records with equal payloads (equal SHA-1) are stored once: the one with the largest page id is the response, the others
are revisits that name it. Tasks write archives of about ARCHIVE bytes of records to the shared folder under names of
their own; the table of written archives lists those of finished tasks only, so a lost or repeated task leaves no record
twice. Archives are read back record by record, and every response is checked against its digest.

Defined results: null html is an empty payload; empty payloads count as equal; rows that share the largest page id of
their payload are all responses; rows with a null id are responses if no row of their payload has one, else revisits;
line ends in urls are percent-encoded, a null url is empty; an empty table gives none.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from transmuta.functions.materialize import Written, shared_folder
from transmuta.llm.batches import small
from transmuta.llm.samples import smallest

SAMPLE = 4_000_000  # bytes of records to train on
PART = 100_000  # characters of payload in a record to train on
URL = 1000  # and of url
HEAD = 500  # about the bytes of a record's headers
DICTIONARY = 64 * 1024
ARCHIVE = 32_000_000  # bytes of records in an archive
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # pages carry no time; equal input gives equal archives
# fixed values of the formats
SKIPPABLE = 0x184D2A5D
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(uri)


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, response: int | None) -> bytes:
    """One WARC record; response: the page a revisit refers to, None for a response."""
    digest = base32_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if response is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if response is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha1:{digest}"]
    if response is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{response}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def _page(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def parse_record(data: bytes) -> dict:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for a revisit)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base32_digest(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    return {"page_id": _page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": _page(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


class ArchiveWriter:
    """Writes one archive: the dictionary in a leading skippable frame, then a frame per record."""

    def __init__(self, out, dictionary: bytes):
        self.out, self.size = out, 0
        loaded = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=loaded, write_content_size=True, write_checksum=True)
        if dictionary:
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
            self._put(struct.pack("<II", SKIPPABLE, len(packed)) + packed)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.zip.compress(record))


def read_archive(source) -> Iterator[bytes]:
    """The records of an archive, one at a time, from a file object."""
    start = source.read(8)
    dictionary, held = None, start
    if len(start) == 8 and struct.unpack("<I", start[:4])[0] == SKIPPABLE:
        content = source.read(struct.unpack("<I", start[4:])[0])
        if content.startswith(ZSTD_FRAME):
            content = zstandard.ZstdDecompressor().decompress(content)
        dictionary, held = zstandard.ZstdCompressionDict(content), b""
    unzip = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while True:
        held = held or source.read(1 << 14)
        if not held:
            return
        frame, parts = unzip.decompressobj(), []
        while True:
            parts.append(frame.decompress(held))
            if frame.eof:
                held = frame.unused_data
                break
            held = source.read(1 << 14)
            if not held:
                raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


def train(pages: DataFrame, sample: int = SAMPLE) -> bytes:
    """A dictionary from about `sample` bytes of records, or nothing where these are too few."""
    sized = pages.select(F.coalesce("html", F.lit("")).alias("html"), "url", "page_id").filter("html <> ''")
    part, url = F.substring("html", 1, PART), F.substring("url", 1, URL)
    size = F.octet_length(part) + HEAD
    last = smallest(sized.select(F.xxhash64("html").alias("hash"), size.alias("size")), sample)
    if last is None:
        return b""
    # one record of each payload, however many copies it has
    rows = sized.withColumn("hash", F.xxhash64("html")).filter(F.col("hash") <= last) \
        .select("hash", F.struct("page_id", url.alias("url"), part.alias("html")).alias("row")) \
        .groupBy("hash").agg(F.min("row").alias("row")).orderBy("hash").select("row.*").collect()
    records = [record_bytes(r["page_id"], r["url"], r["html"].encode(), None) for r in rows]
    if len(records) < 8 or sum(map(len, records)) < 8 * 1024:
        return b""
    return zstandard.train_dictionary(min(DICTIONARY, sum(map(len, records)) // 4), records, k=1024, d=8).as_bytes()


def with_responses(pages: DataFrame) -> DataFrame:
    """page_id, url, html, response: the page whose record holds the payload, null for that page itself."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    largest = rows.groupBy("digest").agg(F.max("page_id").alias("largest"))
    return rows.join(largest, "digest").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest")).alias("response"))


def write_archives(pages: DataFrame, folder: str, sample: int = SAMPLE) -> DataFrame:
    """Write all pages; returns archive, records, bytes of each archive written by a finished task."""
    dictionary = train(pages, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, writer, name, records, raw, done = None, None, None, 0, 0, []

        def close():
            nonlocal out
            out.close()
            done.append((name, records, writer.size))
            out = None

        for batch in small(batches, 200):
            for row in batch.to_pylist():
                record = record_bytes(row["page_id"], row["url"], row["html"].encode(), row["response"])
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    writer, records, raw = ArchiveWriter(out, dictionary), 0, 0
                writer.add(record)
                records, raw = records + 1, raw + len(record)
                if raw >= ARCHIVE:
                    close()
        if out is not None:
            close()
        if done:
            names, counts, sizes = zip(*done)
            yield pa.RecordBatch.from_pydict({"archive": pa.array(names), "records": pa.array(counts, pa.int64()), "bytes": pa.array(sizes, pa.int64())})

    return Written(with_responses(pages).mapInArrow(run, "archive string, records long, bytes long"), "archives").df


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """The records of the listed archives, each archive read by one task as a stream."""
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                       ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        for batch in batches:
            for name in batch["archive"].to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as source:
                    for record in read_archive(source):
                        rows.append(parse_record(record))
                        if len(rows) == 200:
                            yield pa.RecordBatch.from_pylist(rows, kinds)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kinds)

    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("archive").repartition(tasks, "archive").mapInArrow(run, RECORD)


def archived_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, read back from the archives."""
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
