"""WARC writing and reading through chunk rows (operator 7).

Writing: each page is a record of lines, made by DataFrame functions, and Spark's text writer puts them into
gzip-compressed WARC/1.1 files in the order of the rows, on any file system Spark can write. A payload that
an earlier page (the smallest id) has already is a revisit record, which names that page and has no payload.

Reading: a file is one task's stream of lines, from which records are parsed by their Content-Length. A
payload is passed on as rows of record identifier and chunk number, with at most CHUNK_BYTES each; size and
digest are carried from chunk to chunk, so no record is held as a whole. Each row has the place of its first
byte and the digest of all bytes up to its end; the last row's digest must equal the header's. ``read_records``
takes sizes and digests from these rows. A line is one cell of Spark's text source, so a payload without line
feeds is in memory once as a line, but its rows are cut like all others.

Defined results: a null payload is empty; payloads are equal if their SHA-256 and size are. Rows with the
smallest id of a payload are all responses, so a repeated row is too; rows with a null id are revisits of a
payload that a row with an id has. Control characters and spaces in a URL are written as %20; a null URL as
``about:blank``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.base import bounded_batches

CHUNK_BYTES = 1 << 20
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_RECORD = "<urn:x-page:"
CHUNK_SCHEMA = "record_id string, record_type string, refers_to string, target_uri string, chunk_no long, chunk_start long, data binary, digest_so_far string, is_last boolean, original_bytes long, original_digest string"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 SHA-1: each five hexadecimal digits are four of base 32."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(data), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _DIGITS, _BASE32)


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """id, url, payload, n_bytes, digest and refers_to (null for responses) of each page.

    The smallest id of a payload comes from a grouped minimum over digests with partial aggregation.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("n_bytes"), base32_sha1(F.col("payload").cast("binary")).alias("digest"), F.sha2(F.col("payload").cast("binary"), 256).alias("equal")
    )
    first = rows.groupBy("equal", "n_bytes").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.col("n_bytes") >= min_revisit_bytes))
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return rows.join(first, ["equal", "n_bytes"], "left").select("id", "url", "payload", "n_bytes", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def record_lines(records: DataFrame, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """The lines of WARC records, each to be ended by a line feed; those of a record follow each other."""
    name = lambda c: F.concat(F.lit(_RECORD), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    is_revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    block_bytes = F.length(http) + F.when(is_revisit, 0).otherwise(F.col("n_bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name("id"), F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "),
        F.coalesce(F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20"), F.lit("about:blank")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(is_revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("refers_to"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block_bytes.cast("string"), F.lit("\r\n\r\n"),
    )
    # the payload is cut into lines as it is, without a copy of the whole record
    head, body = F.split(F.concat(header, http), "\n", -1), F.split(F.when(is_revisit, "").otherwise(F.col("payload")), "\n", -1)
    lines = records.select(head.alias("head"), body.alias("body"))
    but_last = lambda c: F.slice(c, F.lit(1), F.size(c) - 1)
    ending = F.array(F.concat(F.element_at("body", -1), F.lit("\r")), F.lit("\r"))
    return lines.select(F.explode(F.concat(but_last("head"), but_last("body"), ending)).alias("value"))


def write_archives(records: DataFrame, path: str) -> None:
    """Write planned records as .gz files of WARC records, one for each partition."""
    record_lines(records).write.option("lineSep", "\n").option("compression", "gzip").text(path)


class _Parser:
    """Streams lines of WARC files and yields chunk rows."""

    def __init__(self):
        self.state, self.head, self.left = "head", {}, 0

    def feed(self, line: bytes) -> Iterator[tuple]:
        if self.state == "head":
            if line == b"\r":
                if self.head:
                    self._begin()
            elif not self.head:
                if not line.startswith(b"WARC/"):
                    raise ValueError(f"no WARC record begins with {line[:40]!r}")
                self.head = {"": line}
            else:
                key, _, value = line.rstrip(b"\r").partition(b":")
                self.head[key.strip().lower().decode()] = value.strip().decode()
            return
        if self.state == "http":
            self.left -= len(line) + 1
            if line == b"\r":
                self.state = "payload"
                if not self.left:
                    self.state = "end"
                    yield self._row(True)
            else:
                key, _, value = line.rstrip(b"\r").partition(b":")
                self.http[key.lower()] = value.strip()
            return
        if self.state == "end":  # the line break after a block that ended with one
            if line != b"\r":
                raise ValueError("a record is longer than its Content-Length")
            self.state, self.head = "head", {}
            return
        closed = len(line) >= self.left
        if closed and line[self.left :] != b"\r":
            raise ValueError("a record is longer than its Content-Length")
        size = min(len(line), self.left)
        view = memoryview(line)
        at = 0
        while at < size:
            part = view[at : min(size, at + CHUNK_BYTES - len(self.data))]
            self._take(part)
            at += len(part)
            if len(self.data) == CHUNK_BYTES and self.left:
                yield self._row(False)
        if not closed:
            self._take(b"\n")
            if len(self.data) == CHUNK_BYTES and self.left:
                yield self._row(False)
        if not self.left:
            yield self._row(True)
            self.state = "head" if closed else "end"
            self.head = {}

    def _take(self, part: bytes | memoryview) -> None:
        self.left -= len(part)
        self.digest.update(part)
        self.data += part

    def _begin(self) -> None:
        self.left = int(self.head["content-length"])
        self.state, self.http, self.digest, self.start, self.chunk, self.data = "http", {}, hashlib.sha1(), 0, 0, bytearray()
        self.kind = self.head["warc-type"]
        self.names = [self.head.get(k, "").removeprefix(_RECORD).removesuffix(">") or None for k in ("warc-record-id", "warc-refers-to")]

    def _row(self, last: bool) -> tuple:
        size = original = None
        so_far = base64.b32encode(self.digest.digest()).decode()
        if last:
            original = self.head["warc-payload-digest"].removeprefix("sha1:")
            if self.kind == "revisit":
                size = int(self.http[b"content-length"])
            elif so_far != original:
                raise ValueError(f"record {self.names[0]} has another digest than its header")
        row = (self.names[0], self.kind, self.names[1], self.head.get("warc-target-uri"), self.chunk, self.start, bytes(self.data), so_far, last, size, original)
        self.chunk, self.start, self.data = self.chunk + 1, self.start + len(self.data), bytearray()
        return row


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of all records under ``path``. The last row of a revisit has the original's size and digest."""
    bounded_batches(spark)
    kinds = [
        ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("chunk_no", pa.int64()), ("chunk_start", pa.int64()),
        ("data", pa.binary()), ("digest_so_far", pa.string()), ("is_last", pa.bool_()), ("original_bytes", pa.int64()), ("original_digest", pa.string()),
    ]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser, rows, held = _Parser(), [], 0
        for batch in batches:
            for line in batch.column(0):
                for row in parser.feed(line.as_py()):
                    rows.append(row)
                    held += len(row[6])
                    if len(rows) >= 1000 or held >= 4 * CHUNK_BYTES:
                        yield out(rows)
                        rows, held = [], 0
        if parser.head:
            raise ValueError("the archive ends inside a record")
        yield out(rows)

    lines = spark.read.schema("value string").option("lineSep", "\n").text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, CHUNK_SCHEMA)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """record_id, payload_bytes, payload_digest, record_type, refers_to, target_uri of each record, from its chunk rows.

    The last row of a response says where its bytes start and has the digest of all of them, so rows need not meet.
    """
    ended = (F.col("chunk_start") + F.octet_length("data")).cast("long")
    last = read_chunks(spark, path).filter("is_last")
    return last.select(
        "record_id", F.coalesce("original_bytes", ended).alias("payload_bytes"), F.when(F.col("record_type") == "revisit", F.col("original_digest")).otherwise(F.col("digest_so_far")).alias("payload_digest"),
        "record_type", "refers_to", "target_uri",
    )
