"""WARC archives of pages: written with chunked transfer framing and segments, read back record by record and reassembled.

Writing. Of pages with equal payloads (of at least a number of bytes) the one with the smallest page_id is a response, the others
revisit it and carry no payload. A block longer than a segment goes on in continuation records that name the record they
continue; the last one states the total length. Files hold a bounded number of bounded records. Spark's text writer makes them: the
separator after each row is the one that follows each record. Digests alone are grouped, combined first; payloads are not.

Reading. Archives are parsed by their content lengths, plain or gzipped. Continuations are grouped by the record they continue, put in order of
segment number and their total length verified; then the transfer framing is decoded and the payload digest computed anew. Records without
continuations take no part in a shuffle. A record whose segments, length, framing or digest are wrong has complete = false.

Defined results: null pages are empty payloads; equal page_ids are records of their own, equal rows too (rows with the smallest page_id are all
responses); a page without id is a revisit of a page with one, else a response; line breaks in urls are escaped; other columns are left alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelspark.llm.shared import written

# Fixed values.
MIN_REVISIT_BYTES = 0
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

CHUNK_BYTES = 2048
SEGMENT_BYTES = 8192
RECORDS_PER_FILE = 1024
_ROWS = 256  # of a batch that are worked on at once
DATE = "2000-01-01T00:00:00Z"
_END = "\r\n\r\n"
_ID = re.compile(r"urn:page:(-?\d*)")
_RECORDS = (
    "id string, type string, origin string, number int, total long, page_id long, refers_to long, uri string, digest string, block binary")
_PAYLOADS = (
    "page_id long, record_type string, refers_to long, uri string, payload binary, payload_bytes long, payload_digest string, complete boolean")


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 20 bits, five hex digits, at a time."""
    digits = F.sha1(data)
    parts = []
    for k in range(8):
        value = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def _pieces(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of at most about `size` bytes that end with whole characters."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join([*(b"%x\r\n%b\r\n" % (len(p), p) for p in _pieces(payload, size)), b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes | None:
    """The framed bytes; None if the framing is wrong or does not end."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if data[at + n:at + n + 2] != b"\r\n":
            return None
        out.append(data[at:at + n])
        at += n + 2


def records(page_id: int | None, row: int, url: str | None, payload: str, digest: str, first: int | None, segment: int = SEGMENT_BYTES) -> list[str]:
    """The records of one page, without the separator that follows each."""
    name = f"<urn:page:{'' if page_id is None else page_id}:{row}>"
    data = payload.encode()
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    fields = [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", url))
    if first is not None:
        kind, block = "revisit", f"{http}Content-Length: {len(data)}\r\n\r\n".encode()
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    else:
        kind, block = "response", f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(data)
    parts = list(_pieces(block, segment))
    out = []
    for k, part in enumerate(parts):
        own = [f"WARC-Type: {'continuation' if k else kind}", f"WARC-Record-ID: {name if k == 0 else f'{name[:-1]}:{k + 1}>'}"]
        if len(parts) > 1:
            own.append(f"WARC-Segment-Number: {k + 1}")
        if k:
            own.append(f"WARC-Segment-Origin-ID: {name}")
            if k + 1 == len(parts):
                own.append(f"WARC-Segment-Total-Length: {len(block)}")
        own += [] if k else [*fields, "Content-Type: application/http;msgtype=response"]
        out.append("\r\n".join(["WARC/1.1", *own, f"Content-Length: {len(part)}"]) + _END + part.decode())
    return out


def write(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, gzipped: bool = False) -> None:
    """Archives of all pages in a new folder, with about as many files as the table has parts."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    long_enough = F.octet_length("payload") >= min_revisit_bytes
    firsts = written(
        rows.where(long_enough).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1").select("digest", "first"))
    joined = rows.join(firsts, "digest", "left")
    again = F.when(long_enough & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    joined = joined.select("page_id", F.monotonically_increasing_id().alias("row"), "url", "payload", "digest", again.alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                part = batch.slice(k, _ROWS).to_pydict()
                yield pa.RecordBatch.from_arrays([pa.array([r for x in zip(*part.values(), strict=True) for r in records(*x)], pa.string())], ["value"])

    out = joined.mapInArrow(run, "value string").write.option("lineSep", _END).option("maxRecordsPerFile", RECORDS_PER_FILE)
    (out.option("compression", "gzip") if gzipped else out).text(folder)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record of an archive; ValueError where it is no archive."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        size = fields.get("content-length", "")
        if not head[0].startswith("WARC/") or not size.isdigit() or end + 4 + int(size) > len(data):
            raise ValueError(f"no WARC record at byte {at}")
        at = end + 4 + int(size)
        yield fields, data[end + 4:at]
        if data[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of a WARC record at byte {at}")
        at += 4


def _page(name: str | None) -> int | None:
    found = _ID.search(name or "")
    return int(found[1]) if found and found[1] not in ("", "-") else None


def raw_records(spark: SparkSession, folder: str) -> DataFrame:
    """The response, revisit, resource and continuation records of all archives in a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("id", pa.string()), ("type", pa.string()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()),
            ("refers_to", pa.int64()), ("uri", pa.string()), ("digest", pa.string()), ("block", pa.binary())])
        for batch in batches:
            for data in batch.column("content"):
                held, size = [], 0
                for fields, block in parse(data.as_py()):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "revisit", "resource", "continuation"):
                        continue
                    get = fields.get
                    number, total = get("warc-segment-number"), get("warc-segment-total-length")
                    digest = get("warc-payload-digest", "")
                    held.append((
                        get("warc-record-id"), kind, get("warc-segment-origin-id"), int(number) if number else None, int(total) if total else None,
                        _page(get("warc-record-id")), _page(get("warc-refers-to")), get("warc-target-uri"), digest.removeprefix("sha1:") or None, block))
                    size += len(block)
                    if size > 1_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    return spark.read.format("binaryFile").load(folder).select("content").mapInArrow(run, _RECORDS)


def reassembled(found: DataFrame) -> DataFrame:
    """One row for each record, with its whole block; complete is false where segments are missing or their total is another."""
    names = ["page_id", "type", "refers_to", "uri", "digest"]
    alone = found.where("number is null").select(*names, "block", F.lit(True).alias("complete"))
    parts = found.where("number is not null").withColumn("head", F.when(F.col("type") != "continuation", F.struct(*names)))
    grouped = parts.groupBy(F.coalesce("origin", "id").alias("whole")).agg(
        F.first("head", ignorenulls=True).alias("head"), F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("total").alias("total"))
    block = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["block"]))
    in_order = F.transform("parts", lambda x: x["number"]) == F.sequence(F.lit(1), F.size("parts"))
    whole = grouped.where("head is not null").select("head.*", block.alias("block"), in_order.alias("in_order"), "total")
    complete = F.coalesce(F.col("in_order") & (F.octet_length("block") == F.col("total")), F.lit(False))
    return alone.union(whole.select(*names, "block", complete.alias("complete")))


def _decoded(block: bytes, kind: str) -> tuple[bytes | None, int | None]:
    """(payload, its size) of a block; the payload of a revisit is elsewhere, its size is a field."""
    if kind == "resource":
        return block, len(block)
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    if kind == "revisit":
        size = fields.get(b"content-length", b"")
        return None, int(size) if size.isdigit() else None
    payload = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
    return payload, None if payload is None else len(payload)


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every page of the archives in a folder: payload (null for revisits), size and digest of the full payload, and whether all is well.

    Without `payloads` they are decoded and verified all the same, but not returned.
    """

    def decoded(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, sizes, digests, fine = [], [], [], []
        for kind, digest, block, complete in zip(*(batch.column(c).to_pylist() for c in ("type", "digest", "block", "complete")), strict=True):
            payload, size = _decoded(block, kind)
            own = digest if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()
            found.append(payload if payloads else None)
            sizes.append(size)
            digests.append(own)
            fine.append(complete and size is not None and digest in (None, own))
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("type"), batch.column("refers_to"), batch.column("uri"), pa.array(found, pa.binary()),
             pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(fine, pa.bool_())],
            ["page_id", "record_type", "refers_to", "uri", "payload", "payload_bytes", "payload_digest", "complete"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS):
                yield decoded(batch.slice(k, _ROWS))

    found = reassembled(raw_records(spark, folder)).mapInArrow(run, _PAYLOADS)
    return found if payloads else found.drop("payload")
