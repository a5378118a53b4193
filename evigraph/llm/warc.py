"""WARC archives: writing with revisit records and segments, reading with segment reassembly and chunked decoding."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_dir, table

CRLF = b"\r\n"
#: Ends every record; the text sink writes it as its line separator.
RECORD_END = "\r\n\r\n"
#: Blocks of about so many bytes are passed on together.
BATCH_BYTES = 8 << 20


@dataclass(frozen=True)
class Settings:
    """``segment``: bytes of block in a record; ``chunk``: bytes in a transfer chunk; ``least``: payloads from that size are deduplicated."""

    segment: int = 32_768
    chunk: int = 4_096
    least: int = 1_000
    records_per_file: int = 2_000


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def chunked(payload: bytes, size: int) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Payload of a body in chunked transfer framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk without a size line")
        size = int(body[at:end].split(b";")[0], 16)
        if size < 0:
            raise ValueError("chunk of negative size")
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block


def records_of(name: str, url: str, payload: bytes, digest: str, revisit: str | None, settings: Settings) -> Iterator[bytes]:
    """The records of a response, without their end marks: one, or a first segment and its continuations; or a revisit."""
    own = [("WARC-Record-ID", record_id(name)), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Source-Id", name)]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n"
    head += b"X-Payload-Length: %d\r\n\r\n" % len(payload)
    http = ("Content-Type", "application/http; msgtype=response")
    if revisit is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield _record("revisit", [*own, profile, ("WARC-Refers-To", record_id(revisit)), ("X-Refers-To-Source-Id", revisit), http], head)
        return
    block = head + chunked(payload, settings.chunk)
    parts = [block[i : i + settings.segment] for i in range(0, len(block), settings.segment)]
    if len(parts) == 1:
        yield _record("response", [*own, http], block)
        return
    run = ("X-Segment-Run", uuid.uuid4().hex)  # tells the segments of repeated rows apart
    yield _record("response", [*own, ("WARC-Segment-Number", "1"), run, http], parts[0])
    for i, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else []
        fields = [("WARC-Record-ID", record_id(f"{name}/{i}")), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Number", str(i)), ("WARC-Segment-Origin-ID", record_id(name)), run, *total]
        yield _record("continuation", fields, part)


def _plain(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of an archive, which may be gzip in one or many members, in parts of bounded size."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        yield from (bytes(view[i : i + step]) for i in range(0, len(view), step))
        return
    while at < len(view):
        if bytes(view[at : at + 2]) != b"\x1f\x8b":
            raise ValueError(f"no gzip member at byte {at}")
        member, fed = zlib.decompressobj(31), b""
        while not member.eof:
            if not fed:
                fed, at = bytes(view[at : at + step]), at + step
                if not fed:
                    raise ValueError("gzip member is cut short")
            try:
                part = member.decompress(fed, step)
            except zlib.error as broken:
                raise ValueError(f"gzip member is damaged: {broken}") from None
            fed = member.unconsumed_tail
            if part:
                yield part
        at = min(at, len(view)) - len(member.unused_data)


class _Feed:
    """Bytes of an archive as they are needed; what has been read is given up."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held, self.at, self.broken = parts, bytearray(), 0, None

    def more(self) -> bool:
        try:
            self.held += next(self.parts)
        except StopIteration:
            return False
        except ValueError as broken:  # what came before still counts
            self.broken = str(broken)
            return False
        return True

    def has(self, size: int) -> bool:
        while len(self.held) < size:
            if not self.more():
                return False
        return True

    def find(self, mark: bytes, start: int = 0) -> int:
        while (found := self.held.find(mark, start)) < 0:
            start = max(start, len(self.held) - len(mark) + 1)
            if not self.more():
                return -1
        return found

    def take(self, size: int) -> bytes:
        out = bytes(self.held[:size])
        del self.held[:size]
        self.at += size
        return out


def _fields(head: bytes) -> dict:
    """Fields of a record's head, with lower-case names."""
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("header line without a colon")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdecimal():
        raise ValueError("record without a length")
    if "warc-type" not in fields:
        raise ValueError("record without a type")
    for name in ("warc-segment-number", "warc-segment-total-length"):
        if not fields.get(name, "0").isdecimal():
            raise ValueError(f"{name} is no number")
    return fields


def scan(data: bytes) -> Iterator[tuple[dict, bytes, str | None]]:
    """(fields, block, error) of the records in an archive. What cannot be read gives one entry with an error, and reading goes on at the
    next record mark; an archive without bytes gives nothing."""
    feed, told = _Feed(_plain(data)), None
    while feed.has(1):
        at, fields = feed.at, {}
        try:
            feed.has(5)
            end = feed.find(b"\r\n\r\n") if feed.held[:5] == b"WARC/" else -1
            if end < 0:
                raise ValueError("no WARC record")
            fields = _fields(bytes(feed.held[:end]))
            size = int(fields["content-length"])
            if not feed.has(end + 8 + size) or feed.held[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
                raise ValueError("record is cut short")
        except ValueError as broken:
            told = feed.broken
            yield fields, b"", f"{feed.broken or broken}, at byte {at}"
            found = feed.find(b"\r\n\r\nWARC/", 1)
            feed.take(len(feed.held) if found < 0 else found + 4)
            continue
        feed.take(end + 4)
        block = feed.take(size)
        feed.take(4)
        yield fields, block, None
    if feed.broken != told:
        yield {}, b"", feed.broken


def parse(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(fields with lower-case names, block) of the records in an archive; raises ValueError at the first that cannot be read."""
    for fields, block, error in scan(data):
        if error:
            raise ValueError(error)
        yield fields, block


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", settings: Settings = Settings()) -> None:
    """Write one capture per row of ``pages`` under ``path``, as gzip archives.

    Of the rows with equal payloads of at least ``least`` bytes, that with the largest id is a response and the others revisit it.
    Null payloads are empty, null urls too; rows without an id are written under the name None and revisit nothing; repeated rows are written
    each, and rows that repeat the response's id are responses; payloads may be of any length; an empty table gives no archive; further columns are ignored.
    Only digests are grouped; a group of copies is reduced to its largest id before it is shuffled.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    heads = rows.where(f"size >= {settings.least}").groupBy("digest", "size").agg(F.max("id").alias("head"), F.min("id").alias("least")).where("head != least")
    # which row revisits which: ids only, so payloads are joined by id, which no group of copies makes hot
    revisits = rows.where(f"size >= {settings.least}").select("id", "digest", "size").join(heads, ["digest", "size"]).where("id != head").select("id", F.col("digest").alias("r_digest"), "head").distinct()
    revisits = revisits.withColumnRenamed("id", "r_id")
    joined = rows.join(revisits, F.expr("id = r_id AND digest = r_digest"), "left").select("id", "url", "payload", "digest", F.col("head").cast("string").alias("head"))

    def run(batches):
        for batch in batches:
            out = []
            for id_, url, payload, digest, head in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                out += records_of(str(id_), url.replace("\r", "%0D").replace("\n", "%0A"), payload, digest, head, settings)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    # bytes pass through the text sink unchanged
    records = joined.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", settings.records_per_file).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Captures of the archives under ``path``: source_id, uri, record_type, refers_to, payload_bytes, payload_digest, payload, error.

    Compressed files are held as they are and read record by record, so a task needs the compressed size and the largest record. Segments may lie in
    any files and any order: continuations are grouped by the identifier of their origin, ordered by number and joined to it; the number of the last,
    its total length and the digest of the payload must fit, or ``error`` says what does not and the payload is null. A record, header or gzip
    member that cannot be read is a row with an ``error`` and nothing else but what its head says; it does not end the job. Empty files and
    folders give no row. Revisits have a null payload and their size and digest from their headers.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    schema = "type string, origin string, number int, total long, uri string, source string, refers string, digest string, block binary, error string"
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 4, pa.binary(), pa.string()]
    names = ["type", "origin", "number", "total", "uri", "source", "refers", "digest", "block", "error"]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for f, block, error in scan(content.as_py() or b""):
                    number, own = f.get("warc-segment-number"), f.get("warc-record-id")
                    origin = f.get("warc-segment-origin-id") or (own if number else None)
                    origin = origin and origin + f.get("x-segment-run", "")
                    total = f.get("warc-segment-total-length")
                    number, total = (None, None) if error else (number and int(number), total and int(total))
                    rows.append((f.get("warc-type"), origin, number, total, f.get("warc-target-uri"), f.get("x-source-id"), f.get("x-refers-to-source-id"), f.get("warc-payload-digest"), block, error))
                    held += len(block) + 200
                    if held > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    # which records belong together is known before the blocks are grouped, so a record without segments is not shuffled
    records = files.mapInArrow(run, schema)
    columns = ["source", "uri", "type", "refers", "digest", "total", "parts", "error"]
    whole = records.where("error IS NOT NULL OR (type IN ('response', 'revisit') AND number IS NULL)").withColumn("parts", F.array("block")).select(columns)
    segments = records.where("error IS NULL AND number IS NOT NULL").groupBy("origin").agg(
        F.array_sort(F.collect_set(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"),
        F.max(F.struct(F.expr("type != 'continuation'").alias("first"), "source", "uri", "type", "refers", "digest")).alias("head"),
    )
    joined = segments.select("head.*", "total", "parts.block", F.expr("parts.number != sequence(1, size(parts))").alias("gap")).withColumnRenamed("block", "parts")
    joined = joined.withColumn("error", F.expr("CASE WHEN NOT first THEN 'no first segment' WHEN gap THEN 'missing segment' WHEN total IS NULL THEN 'no last segment' END"))
    return whole.unionByName(joined.select(columns)).mapInArrow(_decode, "source_id string, uri string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string")


def _payload(kind: str, block: bytes, digest: str | None) -> tuple[bytes | None, int, str]:
    """Payload, its size and its digest; ValueError says what does not fit."""
    head, _, body = block.partition(b"\r\n\r\n")
    http = {}
    for line in head.split(CRLF)[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("HTTP header line without a colon")
        http[name.strip().lower()] = value.strip()
    stated = (digest or "").removeprefix("sha1:")
    if kind == "revisit":
        return None, int(http.get(b"x-payload-length", 0)), stated
    payload = unchunked(body) if http.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    found = hashlib.sha1(payload).hexdigest()
    if stated and stated != found:
        raise ValueError("wrong digest")
    return payload, len(payload), found


def _decode(batches):
    for batch in batches:
        rows = []
        for source, uri, kind, refers, digest, total, parts, error in zip(*(batch.column(c) for c in batch.schema.names), strict=True):
            payload, size, found, error = None, None, None, error.as_py()
            if error is None:
                block = b"".join(parts.as_py())
                try:
                    if total.as_py() is not None and total.as_py() != len(block):
                        raise ValueError("wrong total length")
                    payload, size, found = _payload(kind.as_py(), block, digest.as_py())
                except ValueError as broken:
                    error = str(broken)
            rows.append((source.as_py(), uri.as_py(), kind.as_py(), refers.as_py(), size, found, payload, error))
        kinds = [*[pa.string()] * 4, pa.int64(), pa.string(), pa.binary(), pa.string()]
        names = ["source_id", "uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "error"]
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/evigraph/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select(F.expr("try_cast(source_id AS bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(refers_to AS bigint)").alias("refers_to"), "error")


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
h AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS head FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head = page_id THEN NULL ELSE head END AS refers_to, NULL AS error FROM h
"""
