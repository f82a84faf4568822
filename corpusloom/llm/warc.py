"""Operator 2: WARC archives, written and read, with segmented records put together again.

Writing.  A page's payload goes into a ``response`` record as an HTTP message in chunked
transfer framing.  A block longer than ``segment`` bytes is cut into segments: the first
stays a ``response``, the others are ``continuation`` records that name its id as
``WARC-Segment-Origin-ID``; the last has ``WARC-Segment-Total-Length``.  Of pages with
equal payloads of at least ``revisit_bytes``, that with the largest id is a response and
the others are ``revisit`` records that refer to it and carry no payload.

Reading.  Whole records are decoded where they are read.  Segments are grouped by their
origin's id, ordered by number and checked for gaps and for their total length; then the
HTTP headers are taken off, the chunks decoded and the payload digest compared.

Archives are gzip files of bounded size in the shared folder; a file is read by one task.

Record ids derive from page id and payload digest, so a rerun writes the same ones.

Cases: a null payload is empty; ids that repeat or are null give a record for each row
(a null id writes no id header and reads as null; rows alike in id and payload give
records alike in everything, each read back); an empty table gives no archives and
no rows; a record whose segments, length, framing or digest do not fit has ``problem``
set and a null payload instead of failing the read; other columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch, written

SEGMENT = 16 << 10
CHUNK = 4 << 10
REVISIT_BYTES = 1000
#: Records of one archive file.
FILE_RECORDS = 4000
DATE = "2020-01-01T00:00:00Z"
END = "\r\n\r\n"
NAMESPACE = uuid.UUID(int=0)
RECORD = "page_id long, record_type string, record_id string, refers_to_id string, refers_to long, payload_digest string, payload binary, problem string"
PART = "origin string, number int, total long, page_id long, digest string, block binary, problem string"


def chunked(payload: bytes, chunk: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(payload[at : at + chunk]), payload[at : at + chunk]) for at in range(0, len(payload), chunk)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def digest32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record without the two line ends after it."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block


def record_id(*key) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ':'.join(map(str, key)))}>"


def page_records(page_id, url, payload: bytes, digest: str, rep, segment: int = SEGMENT):
    """The records of one page; ``rep`` is the page that it revisits."""
    own = record_id("page", page_id, digest)
    head = [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: "%%%02X" % ord(m[0]), url))] if url else []
    head += [("WARC-Payload-Digest", digest32(digest))] + ([("X-Page-ID", str(page_id))] if page_id is not None else [])
    if rep is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id("page", rep, digest)), ("X-Refers-To-Page-ID", str(rep))]
        yield record("revisit", own, head + more + [("Content-Type", "application/http;msgtype=response")], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    cuts = range(0, max(1, len(block)), segment)
    for n, at in enumerate(cuts, 1):
        more = [("WARC-Segment-Number", str(n))] if len(cuts) > 1 else []
        if n > 1:
            more.append(("WARC-Segment-Origin-ID", own))
        if n == len(cuts) > 1:
            more.append(("WARC-Segment-Total-Length", str(len(block))))
        first = head + [("Content-Type", "application/http;msgtype=response")]
        yield record("response" if n == 1 else "continuation", own if n == 1 else record_id("segment", own, n), (first if n == 1 else []) + more, block[at : at + segment])


def _records(segment: int):
    def run(batches):
        for batch in batches:
            out, size = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "rep"))):
                for r in page_records(*row, segment):
                    out.append(r)
                    size += len(r)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return run


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Archives of ``page_id, url, html`` under ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # which payloads are shared is decided on digests alone; the table is written so that a common one can be split in the join
    large = rows.filter(F.octet_length("payload") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("rep"), F.count("*").alias("n"))
    shared = written(large.filter("n > 1 AND rep IS NOT NULL").select(F.col("digest").alias("shared_digest"), "rep"), "shared-payloads")
    joined = rows.join(shared, (F.col("digest") == F.col("shared_digest")) & (F.octet_length("payload") >= revisit_bytes), "left")
    # rows that repeat the representative's id are responses too
    own = joined.withColumn("rep", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("rep")), F.col("rep")))
    lines = own.select("page_id", "url", "payload", "digest", "rep").mapInArrow(_records(segment), "record binary")
    lines.select(F.col("record").cast("string").alias("value")).write.options(lineSep=END, compression="gzip", maxRecordsPerFile=FILE_RECORDS).text(path)


def parse(data: bytes):
    """(headers, block) of each record of an archive's bytes; one that is cut short has its block cut short."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in data[at:end].split(b"\r\n")[1:])}
        try:
            size = int(headers[b"content-length"])
        except (KeyError, ValueError):
            at = end
            continue
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def inflated(data: bytes) -> bytes:
    """Of one or many gzip members, or plain bytes."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        out.append(one.decompress(data))
        data = one.unused_data
    return b"".join(out)


def payload_of(block: bytes) -> bytes:
    """The HTTP message's payload, its framing decoded."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("no end of the HTTP headers")
    return dechunked(body) if re.search(rb"(?i)\r\ntransfer-encoding:[^\r]*chunked", head) else body


def _decoded(block: bytes, digest: str | None) -> tuple[bytes | None, str, str | None]:
    try:
        payload = payload_of(block)
    except ValueError as e:
        return None, digest, str(e)
    found = hashlib.sha1(payload).hexdigest()
    return (payload, found, None) if digest in (None, found) else (None, digest, "the payload's digest differs")


def _hex(value: bytes | None) -> str | None:
    try:
        return base64.b32decode(value.split(b":")[-1]).hex() if value else None
    except ValueError:
        return None


def _read(segmented: bool):
    """Whole records decoded, or the segments as they are."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for h, block in parse(inflated(content.as_py())):
                    number = h.get(b"warc-segment-number")
                    kind = h.get(b"warc-type", b"").decode()
                    if (number is not None) != segmented or kind not in ("response", "revisit", "continuation"):
                        continue
                    text = lambda k: h[k].decode() if k in h else None
                    page = int(h[b"x-page-id"]) if b"x-page-id" in h else None
                    digest = _hex(h.get(b"warc-payload-digest"))
                    short = "the record is cut short" if len(block) != int(h[b"content-length"]) else None
                    if segmented:
                        total = h.get(b"warc-segment-total-length")
                        rows.append((text(b"warc-segment-origin-id") or text(b"warc-record-id"), int(number), int(total) if total else None, page, digest, block, short))
                    elif kind == "revisit":
                        rep = h.get(b"x-refers-to-page-id")
                        rows.append((page, kind, text(b"warc-record-id"), text(b"warc-refers-to"), int(rep) if rep else None, digest, None, short))
                    else:
                        payload, digest, problem = _decoded(block, digest)
                        rows.append((page, kind, text(b"warc-record-id"), None, None, digest, None if short else payload, short or problem))
                    size += len(block)
                    if size > 4 << 20:
                        yield _batch(rows, PART if segmented else RECORD)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, PART if segmented else RECORD)

    return run


KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def reassembled(origin: str, parts: list[tuple]) -> list[tuple]:
    """The record of the segments (number, total, page, digest, block, problem) of one origin; as often as all are there alike."""
    parts = sorted(parts, key=lambda p: p[0])
    page = next((p[2] for p in parts if p[2] is not None), None)
    digest = next((p[3] for p in parts if p[3] is not None), None)
    problem = next((p[5] for p in parts if p[5]), None)
    total = next((p[1] for p in parts if p[1] is not None), None)
    times = sum(p[0] == parts[0][0] for p in parts)
    if times > 1 and len(parts) % times == 0 and all(len({(p[0], p[4]) for p in parts[k : k + times]}) == 1 for k in range(0, len(parts), times)):
        parts = parts[::times]
    else:
        times = 1
    block = b"".join(p[4] for p in parts)
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        problem = "a segment is missing or there twice"
    elif total is None:
        problem = "the last segment is missing"
    elif total != len(block):
        problem = "the total length differs"
    payload = None
    if not problem:
        payload, digest, problem = _decoded(block, digest)
    return [(page, "response", origin, None, None, digest, payload, problem)] * times


def _assemble(batches):
    """Rows in order of origin: a record at each change of origin."""
    origin, parts, rows, size = None, [], [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if row[0] != origin and parts:
                rows += reassembled(origin, parts)
                size += sum(len(p[4]) for p in parts)
                parts = []
                if size > 4 << 20:
                    yield _batch(rows, RECORD)
                    rows, size = [], 0
            origin = row[0]
            parts.append(row[1:])
    if parts:
        rows += reassembled(origin, parts)
    if rows:
        yield _batch(rows, RECORD)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each response and revisit record of the archives under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*part-*").load(path).select("content")
    whole = files.mapInArrow(_read(False), RECORD)
    segments = files.mapInArrow(_read(True), PART).repartition("origin").sortWithinPartitions("origin", "number")
    return whole.unionAll(segments.mapInArrow(_assemble, RECORD))


def with_payload_sizes(records: DataFrame) -> DataFrame:
    """Adds ``payload_bytes``; a revisit has its response's."""
    own = records.select("record_id", "page_id", "record_type", "refers_to_id", "refers_to", "payload_digest", F.octet_length("payload").cast("long").alias("own_bytes"), "problem")
    small = written(own, "records")
    answers = small.filter("record_type = 'response'").join(small.filter("record_type = 'revisit'").select(F.col("refers_to_id").alias("record_id")).distinct(), "record_id", "left_semi")
    sizes = written(answers.groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("own_bytes").alias("response_bytes")), "revisited")
    return small.join(sizes, "refers_to_id", "left").withColumn("payload_bytes", F.coalesce("own_bytes", "response_bytes")).drop("own_bytes", "response_bytes")


def round_trip(pages: DataFrame) -> DataFrame:
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path)
    return with_payload_sizes(read_archives(pages.sparkSession, path))
