"""WARC: writing archives with revisit records, and a salvage reader.

Writing. Of the pages with equal payloads the one with the largest page_id is
the response; the others are revisit records that name it and carry no payload.
Payloads are grouped by digest and length; the groups that more than one page has
are a stored table beside the scan of the pages, so that adaptive execution can split
the join on a payload that a third of all pages share. Every record is a gzip member of
its own, as archives are kept. An archive is one row of Spark's text sink (its rows are
bytes, its separator is an empty gzip member) and ends at the first record that brings
it to ARCHIVE_BYTES, so any store that Spark writes holds the archives, task commits
are atomic, and no file is much larger than that or than its largest record.

Reading. A record is read where its gzip member decompresses, its version line
and headers parse, its length fits and its block digest agrees. After a failed
check the reader searches for the next gzip member that decompresses (or, in
plain archives, the next version line), goes on there, and logs the bytes
between as a quarantined gap with the reason.

Defined results
    null html        an empty payload
    empty html       a payload of 0 bytes: deduplicated as any other
    repeated rows    rows of the largest page_id with the same payload are all responses
    null page_id     its record has no page number; it revisits if its group has a number
    very long html   whole; one record
    empty table      no archives, empty result
    other columns    ignored
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, shared_path, shared_table, take

OWNER = "warc"
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Bytes after which an archive ends; the reader takes a file as a whole.
ARCHIVE_BYTES = 8 << 20
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
MEMBER = b"\x1f\x8b\x08"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---- records ---------------------------------------------------------------


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    start: int = 0
    end: int = 0


@dataclass
class Salvage:
    """Records in file order, and the gaps: (start, end, reason)."""

    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def clean_header(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None, payload_digest: str) -> bytes:
    uri = clean_header(url or "")
    name = "none" if page_id is None else str(page_id)
    block = b"" if revisit else payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{name}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": uri,
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "X-Payload-Length": str(len(payload)),
        "Content-Type": "text/html; charset=utf-8",
    }
    if revisit:
        head["WARC-Profile"] = REVISIT_PROFILE
        head["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v)
    return VERSION + b"\r\n" + lines.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


class Bad(ValueError):
    pass


def parse_record(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record at a version line, and where it ends; Bad if a check fails."""
    if not re.compile(rb"WARC/1\.[01]\r\n").match(data, at):
        raise Bad("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Bad("headers don't end")
    headers: dict[str, str] = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Bad("a header line without a name")
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Bad("no content length")
    start, end = stop + 4, stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Bad("the block doesn't end where its length says")
    block = data[start:end]
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != digest(block):
        raise Bad("the block's digest differs")
    if not headers.get("warc-type"):
        raise Bad("no type")
    return Record(headers, block, at, end + 4), end + 4


def _member(window: memoryview, at: int) -> tuple[bytes, int]:
    """What the gzip member at `at` holds, and its size; read in steps, so that a
    file isn't copied for each of its members."""
    z, end, out = zlib.decompressobj(31), at, []
    try:
        while not z.eof and end < len(window):
            out.append(z.decompress(window[end : end + 16384]))
            end = min(end + 16384, len(window))
    except zlib.error as e:
        raise Bad(f"gzip: {e}") from None
    if not z.eof:
        raise Bad("a gzip member doesn't end")
    return b"".join(out), end - len(z.unused_data) - at


def _plain(data: bytes, into: Salvage, offset: int = 0) -> None:
    at, lost, why = 0, None, ""
    while at < len(data):
        try:
            record, end = parse_record(data, at)
        except Bad as e:
            if lost is None:
                lost, why = at, str(e)
            nxt = data.find(b"WARC/1.", at + 1)
            at = nxt if nxt >= 0 else len(data)
            continue
        if lost is not None:
            into.gaps.append((offset + lost, offset + at, why))
            lost = None
        record.start, record.end = offset + at, offset + end
        into.records.append(record)
        at = end
    if lost is not None:
        into.gaps.append((offset + lost, offset + len(data), why))


def salvage(data: bytes) -> Salvage:
    """All records that can be read, and the byte ranges that can't. Takes gzip
    archives (a member for each record, or larger members), plain ones, and any
    mixture of the two that damage leaves."""
    out, at, lost, why = Salvage(), 0, None, ""

    def gap(to: int) -> None:
        nonlocal lost
        if lost is not None and to > lost:
            out.gaps.append((lost, to, why))
        lost = None

    window = memoryview(data)
    while at < len(data):
        if data.startswith(MEMBER, at):
            try:
                text, size = _member(window, at)
                part = Salvage()
                _plain(text, part)
                if text and not part.records:
                    raise Bad(part.gaps[0][2] if part.gaps else "no record")
            except Bad as e:
                if lost is None:
                    lost, why = at, str(e)
                at = _next(data, at + 1)
                continue
            gap(at)
            for r in part.records:
                r.start, r.end = at, at + size
            out.records += part.records
            out.gaps += [(at, at + size, f"in a member: {w}") for *_, w in part.gaps]
            at += size
        elif data.startswith(b"WARC/1.", at):
            try:
                record, end = parse_record(data, at)
            except Bad as e:
                if lost is None:
                    lost, why = at, str(e)
                at = _next(data, at + 1)
                continue
            gap(at)
            out.records.append(record)
            at = end
        else:
            if lost is None:
                lost, why = at, "neither a gzip member nor a version line"
            at = _next(data, at + 1)
    gap(len(data))
    return out


def _next(data: bytes, at: int) -> int:
    found = [x for x in (data.find(MEMBER, at), data.find(b"WARC/1.", at)) if x >= 0]
    return min(found, default=len(data))


# ---- Spark -----------------------------------------------------------------


def with_responses(pages: DataFrame, least_bytes: int = LEAST_BYTES, owner: str = OWNER) -> DataFrame:
    """page_id, url, html, and the id of the response of its payload (refers_to,
    null where the page is itself one)."""
    rows = take(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("bigint")).withColumn("html", F.coalesce("html", F.lit("")))
    keyed = rows.select("*", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").alias("size"))
    groups = keyed.groupBy("sha", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = shared_table(groups.where((F.col("n") > 1) & (F.col("size") >= least_bytes)).select("sha", "size", "first"), owner, "payloads")
    out = keyed.join(shared, ["sha", "size"], "left")
    return out.select("page_id", "url", "html", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, owner: str = OWNER) -> None:
    """Writes gzip archives (one member for each record) under path."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for b in batches:
            for page_id, url, html, refers in zip(*[b.column(i) for i in range(4)], strict=True):
                payload, to = (html.as_py() or "").encode("utf-8"), refers.as_py()
                out.append(gzip_member(record_bytes(page_id.as_py(), url.as_py(), payload, to is not None, to, digest(payload))))
                size += len(out[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["archive"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], ["archive"])

    rows = with_responses(pages, least_bytes, owner).mapInArrow(members, "archive binary")
    (
        rows.select(F.col("archive").cast("string"))
        .write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", 1).text(path)
    )


READ_SCHEMA = "file string, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, block binary, start bigint, end bigint, gap string"


def read_archives(spark: SparkSession, path: str, with_blocks: bool = True) -> DataFrame:
    """Every record of the archives under path, and every quarantined gap: a row
    with gap (the reason) set, its byte range, and nulls otherwise."""

    def number(uri: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
        return int(found[1]) if found else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string())])
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                found, out = salvage(content.as_py()), []
                for r in found.records:
                    h, kind = r.headers, r.headers["warc-type"]
                    stated = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    size = len(r.block) if kind == "response" else int(h["x-payload-length"]) if h.get("x-payload-length", "").isdigit() else None
                    own = digest(r.block) if kind == "response" else stated or None
                    out.append((name.as_py(), number(h.get("warc-record-id")), h.get("warc-target-uri"), kind, number(h.get("warc-refers-to")), size, own, r.block if with_blocks else None, r.start, r.end, None))
                out += [(name.as_py(), *[None] * 7, s, e, why) for s, e, why in found.gaps]
                for k in range(0, len(out), 200):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out[k : k + 200], strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(rows, READ_SCHEMA)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, OWNER, "archives")
    write_archives(read(spark, sf_dir, "pages"), path)
    out = read_archives(spark, path, with_blocks=False).where(F.col("gap").isNull())
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
