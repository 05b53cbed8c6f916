"""WARC archives: writing, and reading with segment reassembly and chunked transfer decoding.

``write`` makes one response record per page, or a revisit record if an earlier page has the same payload.
Response blocks are HTTP messages with chunked framing; a block above ``SEGMENT_BYTES`` is split into a first
record and ``continuation`` records that name it by ``WARC-Segment-Origin-ID``.  A record is one row of
Spark's text writer whose line separator is the record separator, so archives are real WARC files in any
store that Spark writes to.

``read`` parses each archive, decodes records of one segment where they stand, groups the others by their
origin id, orders the segments by number, checks that none is missing and that their length is the one the
last segment states, and decodes the chunked framing.  Only segments go through a shuffle.

Defined results: a null html is an empty payload; payloads under ``MIN_REVISIT`` bytes are always responses.
Of rows with equal payloads the one with the smallest page_id is the response (repeated page_ids: all of
them); a null page_id is never smallest, and is a revisit if any page with an id has the payload.  A null
url gives a record without target.  A damaged record keeps its row, with the reason in ``error``, a null
payload and what its headers still say; reading goes on at the next place that looks like a record.  A
damaged segment has such a row too, and its record one that says what is missing.  Of a compressed archive
that is cut off or broken, the records before that place are read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitemill.workspace import stage

MIN_REVISIT, CHUNK_BYTES, SEGMENT_BYTES = 100, 8192, 16384
#: Bounds the size of an archive before compression: no record's block is longer than a segment.
ARCHIVE_BYTES, HEADER_BYTES = 128 << 20, 1024
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- records as bytes ---------------------------------------------------------------------------
def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked message body; extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        line_end = body.index(b"\r\n", at)
        size = int(body[at:line_end].split(b";")[0].strip(), 16)
        at = line_end + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk has another length than stated")
        parts.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response message."""
    head, mark, body = block.partition(END)
    if not mark:
        raise ValueError("no end of HTTP headers")
    names = [line.partition(b":")[::2] for line in head.split(b"\r\n")[1:]]
    framed = any(n.strip().lower() == b"transfer-encoding" and v.strip().lower() == b"chunked" for n, v in names)
    return unchunked(body) if framed else body


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{name}: {value}" for name, value in headers if value is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode() + END + block


def response_records(identifier: str, common: list, payload: bytes, segment: int) -> list[bytes]:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", identifier), *common, ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment:
        return [record(first, block)]
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    out = [record([*first, ("WARC-Segment-Number", 1)], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        headers = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{identifier}/{number}')}>"),
            ("WARC-Date", DATE),
            ("WARC-Segment-Origin-ID", identifier),
            ("WARC-Segment-Number", number),
            ("WARC-Segment-Total-Length", len(block) if number == len(parts) else None),
        ]
        out.append(record(headers, part))
    return out


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Headers (names in lower case), block and damage of each record of an archive."""
    at = 0
    while at < len(data):
        headers, block, damage, after = {}, b"", None, 0
        head_end = data.find(END, at)
        if not data.startswith(b"WARC/", at):
            damage = "no record"
        elif head_end < 0:
            damage = "headers cut off"
        else:
            lines = data[at:head_end].decode("utf-8", "replace").split("\r\n")
            headers = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines[1:])}
            length = whole_number(headers.get("content-length"))
            start = head_end + len(END)
            if length is None or length < 0:
                damage = "no content length"
            elif start + length > len(data):
                damage = "block cut off"
            elif data[start + length : start + length + len(END)] != END:
                damage = "block has another length than stated"
            else:
                block, after = data[start : start + length], start + length + len(END)
        if damage:
            following = data.find(END + b"WARC/", at)
            after = following + len(END) if following >= 0 else len(data)
        yield headers, block, f"{damage} at byte {at}" if damage else None
        at = after


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive without damage."""
    for headers, block, damage in records(data):
        if damage:
            raise ValueError(damage)
        yield headers, block


def whole_number(text: str | None, bits: int = 64) -> int | None:
    try:
        number = int(text)
    except (TypeError, ValueError):
        return None
    return number if -(1 << (bits - 1)) <= number < 1 << (bits - 1) else None


def unzipped(data: bytes) -> bytes:
    """The content of all gzip members, up to the first damage; data that is not compressed as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        try:
            for i in range(0, len(data), 1 << 20):  # in steps, so that what stands before damage is kept
                parts.append(member.decompress(data[i : i + (1 << 20)]))
                if member.eof:
                    data = member.unused_data + data[i + (1 << 20) :]
                    break
            else:
                break
        except zlib.error:
            break
    return b"".join(parts)


# --- writing --------------------------------------------------------------------------------------
def classified(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, refers_to``; ``refers_to`` is set for revisits."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha2(payload, 256).alias("digest"))
    large = F.octet_length(F.coalesce("html", F.lit(""))) >= MIN_REVISIT
    first = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first_id"))
    joined = rows.join(first.hint("shuffle_hash"), "digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))


def write(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write compressed archives with one record, or its segments, per page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, number = f"{TaskContext.get().partitionId()}", 0
        for batch in batches:
            out: list[bytes] = []
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")]
            for page_id, url, html, digest, refers_to in zip(*columns, strict=True):
                number += 1
                name = uuid.uuid5(uuid.NAMESPACE_OID, f"{page_id}/{digest}/{space}/{number}")
                target = url.replace("\r", "%0D").replace("\n", "%0A") if url is not None else None
                common = [
                    ("WARC-Date", DATE),
                    ("WARC-Target-URI", target),
                    ("WARC-Payload-Digest", f"sha256:{digest}"),
                    ("Page-ID", page_id),
                ]
                if refers_to is None:
                    out += response_records(f"<urn:uuid:{name}>", common, (html or "").encode(), segment_bytes)
                else:
                    kind = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Profile", REVISIT_PROFILE)]
                    out.append(record([*kind, *common], b""))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = classified(pages).select("page_id", "url", "html", "digest", "refers_to")
    lines = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    writer = lines.write.option("lineSep", END.decode()).option("compression", "gzip")
    writer.option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // (segment_bytes + HEADER_BYTES))).text(path)


# --- reading --------------------------------------------------------------------------------------
RECORD = "record_id string, record_type string, page_id long, target string, digest string, payload binary, error string"
SEGMENT = "origin string, number int, total long, record_type string, page_id long, target string, digest string, block binary"


def _parsed(archives: DataFrame, schema: str, segmented: bool) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    kinds = [types[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                for headers, block, damage in records(unzipped(batch.column(0)[k].as_py())):
                    get = headers.get
                    number = whole_number(get("warc-segment-number"), 32)
                    if "warc-segment-number" in headers and number is None:
                        damage = damage or "segment number is not a number"
                    if (number is not None and damage is None) != segmented:
                        continue
                    page = whole_number(get("page-id"))
                    about = (get("warc-type"), page, get("warc-target-uri"), (get("warc-payload-digest") or "").removeprefix("sha256:") or None)
                    if segmented:
                        origin = get("warc-segment-origin-id") or get("warc-record-id")
                        rows.append((origin, number, whole_number(get("warc-segment-total-length")), *about, block))
                    else:
                        plain = damage is None and about[0] == "response"
                        payload, error = _decoded(block) if plain else (None, damage)
                        if page is None and "page-id" in headers:
                            error = error or "page id is not a number"
                        rows.append((get("warc-record-id"), *about, payload, error))
                for i in range(0, len(rows), 1000):
                    columns = zip(*rows[i : i + 1000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return archives.mapInArrow(run, schema)


def _decoded(block: bytes) -> tuple[bytes | None, str | None]:
    try:
        return payload_of(block), None
    except ValueError as e:
        return None, str(e)


def joined_segments(parts: list[dict]) -> tuple[bytes | None, str | None]:
    """The payload of ordered segments, or why there is none."""
    kept: list[dict] = []
    for part in parts:
        if kept and part["number"] == kept[-1]["number"]:
            if part["block"] != kept[-1]["block"]:
                return None, f"two different segments {part['number']}"
            continue
        kept.append(part)
    if [p["number"] for p in kept] != list(range(1, len(kept) + 1)):
        return None, "segment missing"
    block = b"".join(p["block"] for p in kept)
    if kept[-1]["total"] is None:
        return None, "last segment missing"
    if kept[-1]["total"] != len(block):
        return None, f"total length is {len(block)}, stated {kept[-1]['total']}"
    return _decoded(block)


def reassembled(segments: DataFrame) -> DataFrame:
    """Whole records from their segments."""
    parts = F.array_sort(F.collect_list(F.struct("number", "total", "block")))
    first = F.min(F.when(F.col("number") == 1, F.struct("record_type", "page_id", "target", "digest")))
    grouped = segments.groupBy("origin").agg(first.alias("first"), parts.alias("parts"))
    flat = grouped.select("origin", F.coalesce("first.record_type", F.lit("continuation")).alias("record_type"), "first.page_id", "first.target", "first.digest", "parts")
    names = [f.split()[0] for f in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [joined_segments(p) for p in batch.column("parts").to_pylist()]
            found = [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *found], names)

    return flat.mapInArrow(run, RECORD)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives; revisits have no payload of their own."""
    archives = spark.read.format("binaryFile").load(path).select("content")
    whole = _parsed(archives, RECORD, segmented=False)
    return whole.unionByName(reassembled(_parsed(archives, SEGMENT, segmented=True)))


def report(pages: DataFrame, path: str) -> DataFrame:
    """Write the pages and read them back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    write(pages, path)
    found = read(pages.sparkSession, path).select(
        "page_id", "record_type", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    found = stage(found, "warc-records")
    responses = found.where("record_type = 'response'")
    sources = responses.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"))
    revisits = found.where("record_type = 'revisit'").select("page_id", "record_type", F.col("digest").alias("payload_digest"))
    revisits = revisits.join(sources, "payload_digest", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return responses.select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(revisits.select(*columns, "refers_to"))
