"""WARC archives as chunked record tables.

A payload becomes rows of (record, chunk number, bytes, SHA-256 so far); no row is larger than a chunk, and the
digest goes on from chunk to chunk. Each chunk is written as one WARC record, a payload of several chunks as a
``response`` and its ``continuation`` segments, so reading and writing hold one chunk at a time. Spark's text
writer writes the archives: a record is a line, and the two empty lines that end it are the line separator.
Archives are compressed with gzip, which Spark does not split, so a reader sees every archive from its first byte.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from merchlens.llm.common import batch_of
from merchlens.session import scratch_path

SEPARATOR = b"\r\n\r\n"
CHUNK = 1 << 20
#: Chunks of one Arrow batch hold at most about this many bytes.
_BATCH = 4 << 20

CHUNKS = (
    "page_id long, url string, record_type string, refers_to long, payload_bytes long, "
    "chunk_no int, chunk binary, digest string, last boolean"
)
_CHUNKS = pa.schema(
    [
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_bytes", pa.int64()), ("chunk_no", pa.int32()), ("chunk", pa.binary()), ("digest", pa.string()),
        ("last", pa.bool_()),
    ]
)


def references(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, payload digest, refers_to) for pages whose payload, of at least ``least`` bytes, a smaller page_id has.

    Only ids and digests are shuffled. Rows that repeat the smallest page_id are all responses.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    known = pages.select("page_id", F.octet_length(payload).alias("bytes"), F.sha2(payload.cast("binary"), 256).alias("whole"))
    long_ = known.filter(F.col("bytes") >= least).drop("bytes")
    firsts = long_.groupBy("whole").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return long_.join(firsts, "whole").filter(~F.col("page_id").eqNullSafe(F.col("first"))).groupBy(
        "page_id", "whole"
    ).agg(F.min("first").alias("refers_to"))


def chunked(pages: DataFrame, chunk_bytes: int = CHUNK, least: int = 100) -> DataFrame:
    """The chunk rows of ``pages(page_id, url, html)``, in order of chunk number within a record.

    A revisit has one empty chunk; its payload is the response's. ``digest`` is the payload's SHA-256 up to and
    with the chunk; a revisit's is the whole payload's.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), payload.alias("payload"))
    refs = references(pages, least).select(F.col("page_id").alias("__page"), "whole", "refers_to")
    digest = F.sha2("payload", 256)
    same = F.col("page_id").eqNullSafe(F.col("__page")) & (digest == F.col("whole"))
    joined = rows.join(refs, same, "left")
    told = F.when(F.col("whole").isNotNull(), F.lit("revisit")).otherwise(F.lit("response"))
    body = F.when(F.col("whole").isNull(), F.col("payload"))
    rows = joined.select(
        "page_id", "url", told.alias("record_type"), "refers_to", F.octet_length("payload").cast("long").alias("n"), "whole", body.alias("payload")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            heads = list(zip(*(c.to_pylist() for c in batch.columns[:6])))
            for (page, url, kind, refers, size, whole), value in zip(heads, batch.column(6)):
                view, so_far = (memoryview(value.as_buffer()) if value.is_valid else memoryview(b"")), hashlib.sha256()
                count = max(1, -(-len(view) // chunk_bytes))
                for no in range(count):
                    part = bytes(view[no * chunk_bytes : (no + 1) * chunk_bytes])
                    so_far.update(part)
                    out.append((page, url, kind, refers, size, no, part, whole or so_far.hexdigest(), no == count - 1))
                    held += len(part) + 200
                    if held >= _BATCH:
                        yield batch_of(_CHUNKS, list(zip(*out)))
                        out, held = [], 0
        if out:
            yield batch_of(_CHUNKS, list(zip(*out)))

    return rows.mapInArrow(run, CHUNKS)


def _printable(column) -> F.Column:
    """A header value of one line: control characters and spaces percent-encoded as UTF-8 bytes would break it."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"[\x00-\x20\x7F]", "%20")


def write_archives(chunks: DataFrame, path: str) -> None:
    """Write chunk rows as gzipped WARC/1.1 archives under ``path``, a folder all executors reach.

    An archive for each partition: a payload's running digest can't be checked across files, so none is ever rolled.
    """
    first, many = F.col("chunk_no") == 0, ~(F.col("last") & (F.col("chunk_no") == 0))
    kind = F.when(first, F.col("record_type")).otherwise(F.lit("continuation"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    name = F.concat(F.lit("<urn:page:"), page, F.lit(":"), F.col("digest"), F.lit(":"), F.col("chunk_no").cast("string"), F.lit(">"))

    def line(key: str, value, when=None):
        text = F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
        return text if when is None else F.when(when, text).otherwise(F.lit(""))

    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", name), line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Target-URI", _printable(F.col("url"))),
        line("WARC-Segment-Number", (F.col("chunk_no") + 1).cast("string"), many),
        line("WARC-Segment-Total-Length", F.col("payload_bytes").cast("string"), F.col("last")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")), F.col("refers_to").isNotNull()),
        line("WARC-Page-ID", page), F.concat(F.lit("Content-Length: "), F.octet_length("chunk").cast("string"), F.lit("\r\n\r\n")),
    )
    record = F.concat(header.cast("binary"), F.col("chunk")).cast("string")
    chunks.select(record.alias("value")).write.option("lineSep", SEPARATOR.decode()).option("compression", "gzip").option(
        "maxRecordsPerFile", 0
    ).text(path)


_HEADER = re.compile(rb"([^:\r\n]+): ([^\r\n]*)")


class Stream:
    """Takes an archive's bytes as stretches between separators; gives (headers, block) of every record.

    A block may hold separators, or end in a part of one, so its end is told by its length alone. What is held
    is one record and the rest of a stretch. Spark takes off one separator at an archive's end, but where the last
    block ends in a line break its first match is earlier and a rest follows that no separator ends; the one added
    here is then left over, and skipped.
    """

    def __init__(self) -> None:
        self.held = bytearray()
        self.head: dict[bytes, bytes] | None = None
        self.need = 0

    def feed(self, stretch: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
        self.held += stretch + SEPARATOR
        while True:
            if self.head is None:
                end = self.held.find(SEPARATOR)
                if end < 0:
                    return
                if end == 0:
                    del self.held[: len(SEPARATOR)]
                    continue
                self.head = dict(_HEADER.findall(bytes(self.held[:end])))
                self.need = int(self.head[b"Content-Length"])
                del self.held[: end + len(SEPARATOR)]
            if len(self.held) < self.need + len(SEPARATOR):
                return
            yield self.head, bytes(self.held[: self.need])
            del self.held[: self.need + len(SEPARATOR)]
            self.head = None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The chunk rows of all archives under ``path``."""
    files = spark.read.option("lineSep", SEPARATOR.decode()).text(path).select(
        F.input_file_name().alias("file"), F.col("value").cast("binary").alias("value")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, file, reader, so_far = [], 0, None, Stream(), hashlib.sha256()
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1)):
                if (name := name.as_py()) != file:
                    file, reader = name, Stream()
                for head, chunk in reader.feed(value.as_py()):
                    whole = b"WARC-Segment-Total-Length" in head
                    kind = head[b"WARC-Type"].decode()
                    if kind != "continuation":
                        so_far = hashlib.sha256()
                    so_far.update(chunk)
                    digest = head[b"WARC-Payload-Digest"].decode().removeprefix("sha256:")
                    if kind != "revisit" and digest != so_far.hexdigest():
                        raise ValueError(f"{file}: digest of {head[b'WARC-Record-ID'].decode()} differs")
                    refers = head.get(b"WARC-Refers-To")
                    page = head[b"WARC-Page-ID"].decode()
                    out.append(
                        (
                            None if page == "null" else int(page), head[b"WARC-Target-URI"].decode("utf-8", "replace"), kind,
                            int(refers[len("<urn:page:") : -1]) if refers else None,
                            int(head[b"WARC-Segment-Total-Length"]) if whole else None, int(head.get(b"WARC-Segment-Number", b"1")) - 1,
                            chunk, digest, whole,
                        )
                    )
                    held += len(chunk) + 200
                    if held >= _BATCH:
                        yield batch_of(_CHUNKS, list(zip(*out)))
                        out, held = [], 0
        if out:
            yield batch_of(_CHUNKS, list(zip(*out)))

    return files.mapInArrow(run, CHUNKS)


def archived(pages: DataFrame, chunk_bytes: int = CHUNK, least: int = 100) -> DataFrame:
    """Write ``pages(page_id, url, html)`` to archives and read them back, one row per page.

    (page_id, payload_bytes, payload_digest, record_type, refers_to). Equal payloads of at least ``least`` bytes are
    stored once, with the smallest page_id; the others are revisits of it, and NULL ids revisit any other. A
    NULL html is an empty payload, a NULL url an empty one. Rows that repeat a page are archived as often. An
    empty table gives empty archives and no rows; other columns are ignored. Segments of one payload stand one
    after the other in one archive, and each carries the digest so far, which reading checks.
    """
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(chunked(pages, chunk_bytes, least), path)
    back = read_archives(pages.sparkSession, path).filter("last")
    # The last segment carries the whole payload's length and digest; its kind is told by the record's first.
    kind = F.when(F.col("record_type") == "revisit", F.lit("revisit")).otherwise(F.lit("response"))
    return back.select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), kind.alias("record_type"), "refers_to"
    )
