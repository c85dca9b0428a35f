"""WARC archives: a writer with one gzip member per record, and a reader that salvages damaged files.

Writing. The records of pages are built and compressed in the executors, and of equal payloads all but the one of
the smallest page_id become revisits. Files go through Spark's text sink (raw bytes, a record a row, Spark's commit
protocol), so that any file system that Spark writes to will do and a lost task leaves nothing behind. The sink's
line separator is an empty gzip member, which decompresses to nothing.

Reading. `read_archive` walks a file record by record, compressed or not. Checks: the gzip checksum, the version
line, the header fields (against a digest of them that our own records end their header with), the numbers among them,
Content-Length, the closing blank lines, and the digests and length of the payload and block, where given (sha1, sha256,
md5; others are not checked). Field names count in any letter case, with or without a blank after the colon, folded or
not. What a response is said to hold is computed from its payload, never read from its header; a revisit of another
writer has no length. Where a check fails it looks for the next place at which a whole valid record begins (a gzip member or a version line), goes on from there and
reports the bytes between as a quarantined gap. Inside a gzip member, also one that is cut or fails its checksum, the
valid records are found in the same way in what can be inflated; of a broken member, the record that ends where it
does is not trusted.

Defined results: a null html is an empty payload; a null page_id counts as the largest; rows that repeat the
smallest id of a payload are all responses; control characters and blanks in a url are percent-encoded; an empty
table gives an empty archive and no rows. Extra columns are not read. A record is held in memory whole, and so is
an archive file, whose records are limited in number.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.common import in_arrow

#: Smaller payloads are all stored; records in an archive file at most; gzip level.
LEAST_BYTES, FILE_RECORDS, LEVEL = 0, 20_000, 4
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PAGE = "<urn:page:%s>"
#: The last field of a header: the digest of all bytes before it.
HEADER_DIGEST = b"\r\nX-Header-Digest: "
#: The fields that are read, by their names in small letters.
FIELDS = {n.lower(): n for n in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Block-Digest", "X-Payload-Length", "X-Header-Digest", "Content-Type", "Content-Length")}


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


EMPTY_MEMBER = member(b"")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def clean_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "urn:none"


def record(kind: str, page_id: int | None, url: str | None, digest: str, size: int, block: bytes, refers_to: int | None = None) -> bytes:
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": PAGE % ("null" if page_id is None else page_id), "WARC-Date": DATE, "WARC-Target-URI": clean_url(url),
        "WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": size,
        **({"WARC-Refers-To": PAGE % ("null" if refers_to is None else refers_to), "WARC-Profile": PROFILE} if kind == "revisit" else {}),
        "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
    }
    head = ("WARC/1.1" + "".join(f"\r\n{k}: {v}" for k, v in fields.items())).encode()
    return head + HEADER_DIGEST + payload_digest(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write a record for each row of pages (page_id, url, html) under path."""
    html = F.encode(F.coalesce(pages["html"], F.lit("")), "UTF-8")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), F.sha2(html, 256).alias("body"), html.alias("html"))
    ids = rows.select("page_id", "body", F.octet_length("html").alias("size"))
    first = ids.groupBy("body").agg(F.first("size").alias("size"), F.min("page_id").alias("first"))

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for page_id, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                digest = payload_digest(html)
                out[0].append(member(record("response", page_id, url, digest, len(html), HTTP % len(html) + html)))
                out[1].append(digest)
                out[2].append(len(html))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("body"), pa.array(out[0], pa.binary()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32())], ["page_id", "url", "body", "stored", "digest", "size"])

    def revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                stored if stored is not None else member(record("revisit", page_id, url, digest, size, b"", first))
                for page_id, url, stored, digest, size, first in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "stored", "digest", "size", "first")], strict=True)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    stored = rows.transform(in_arrow, compressed, "page_id long, url string, body string, stored binary, digest string, size int")
    again = (F.col("size") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    chosen = stored.join(first, ["body", "size"]).select("page_id", "url", F.when(~again, F.col("stored")).alias("stored"), "digest", "size", "first")
    records = chosen.transform(in_arrow, revisits, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_RECORDS).text(path)


class Record(NamedTuple):
    start: int
    end: int
    fields: dict[str, str]
    payload: bytes
    length: int | None


class Gap(NamedTuple):
    start: int
    end: int


BEGINS = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
STEP = 1 << 16


def unpacked(data: bytes, start: int) -> tuple[bytes, int, bool]:
    """What can be had of the contents of the gzip member at start, where reading ended, and whether all checks of the member passed."""
    unpacker, parts, at = zlib.decompressobj(31), [], start
    while not unpacker.eof and at < len(data):
        piece, before = data[at : at + STEP], unpacker.copy()
        try:
            parts.append(unpacker.decompress(piece))
        except zlib.error:  # the piece again, byte by byte, up to the error
            for k in range(len(piece)):
                try:
                    parts.append(before.decompress(piece[k : k + 1]))
                except zlib.error:
                    return b"".join(parts), at + k, False
        at += len(piece)
    return b"".join(parts), at - len(unpacker.unused_data), unpacker.eof


def number(text: str) -> int:
    """A number of digits alone; a ValueError if it is anything else."""
    if not re.fullmatch("[0-9]{1,18}", text):
        raise ValueError(text)
    return int(text)


def agrees(stated: str, data: bytes) -> bool:
    """Whether data has the stated digest (algorithm:value, in base32 or hexadecimal). An algorithm that isn't known is not checked."""
    name, _, value = stated.partition(":")
    if name.lower() not in ("sha1", "sha256", "md5"):
        return True
    found = hashlib.new(name.lower(), data).digest()
    return value.strip().rstrip("=").upper() in (base64.b32encode(found).decode().rstrip("="), found.hex().upper())


def parsed(data: bytes, start: int) -> Record | None:
    """The record whose version line is at start; None if a check of it fails."""
    head = data.find(b"\r\n\r\n", start)
    if head < 0 or not re.match(rb"WARC/1\.[01]\r\n", data[start : start + 10]):
        return None
    header = data[start:head]
    try:
        lines = re.sub(r"\r\n[ \t]+", " ", header.decode()).split("\r\n")[1:]
        fields = {FIELDS.get(name.strip().lower(), name.strip()): value.strip() for name, value in (line.split(":", 1) for line in lines)}
        size, length = number(fields["Content-Length"]), number(fields["X-Payload-Length"]) if "X-Payload-Length" in fields else None
    except (ValueError, KeyError, UnicodeDecodeError):
        return None
    end = head + 4 + size
    if data[end : end + 4] != b"\r\n\r\n" or "WARC-Type" not in fields or "WARC-Record-ID" not in fields:
        return None
    if "X-Header-Digest" in fields:
        before, found, own = header.rpartition(HEADER_DIGEST)
        if not found or own.decode() != payload_digest(before):
            return None
    block = data[head + 4 : end]
    if not agrees(fields.get("WARC-Block-Digest", ""), block):
        return None
    if fields["WARC-Type"] == "revisit":
        return Record(start, end + 4, fields, block, length)
    http = fields["WARC-Type"] == "response" and fields.get("Content-Type", "application/http").lower().startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    if length not in (None, len(payload)) or not agrees(fields.get("WARC-Payload-Digest", ""), payload):
        return None
    return Record(start, end + 4, fields, payload, len(payload))


def at_place(data: bytes, start: int) -> tuple[list[Record | Gap], int, bool] | None:
    """The records (and inner gaps) of the member, or the record, that begins at start, where reading ended, and whether that is its end. None if no record of it is valid."""
    if data[start : start + 3] != b"\x1f\x8b\x08":
        r = parsed(data, start)
        return None if r is None else ([r], r.end, True)
    inner, end, whole = unpacked(data, start)
    found: list[Record | Gap] = []
    at = bad = 0
    while at < len(inner):
        r = parsed(inner, at)
        if r is None or (not whole and r.end == len(inner)):  # nothing confirms a record that ends where a broken member does
            nearest = VERSION.search(inner, at + 1)
            at = nearest.start() if nearest else len(inner)
            continue
        if at > bad and whole:
            found.append(Gap(start, end))
        found.append(Record(start, end, r.fields, r.payload, r.length))
        at = bad = r.end
    if not any(isinstance(x, Record) for x in found) and (inner or not whole):
        return None
    if whole and bad < len(inner):
        found.append(Gap(start, end))
    return found, end, whole


def read_archive(data: bytes) -> Iterator[Record | Gap]:
    """The records of one file in order, and the gaps of bytes that belong to no valid record. A gap inside a whole gzip member has the member's bounds; a broken member is a gap up to the next valid place, after the records that it gave."""
    at = bad = 0
    given: list[Record | Gap] = []  # by the last broken member; where it is stored without compression, they are met again
    while at < len(data):
        got = at_place(data, at)
        if got is not None and not any(x[2:] == got[0][0][2:] for x in given if got[0] and data[at : at + 3] != b"\x1f\x8b\x08"):
            if at > bad:
                yield Gap(bad, at)
            yield from got[0]
            bad = at
            if got[2]:
                at = bad = got[1]
                continue
            given = got[0]
        found = BEGINS.search(data, at + 1)
        at = found.start() if found else len(data)
    if at > bad:
        yield Gap(bad, len(data))


def page(urn: str | None) -> int | None:
    """The page_id in a name of ours."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]{1,19})>", urn or "")
    return int(found[1]) if found and -(1 << 63) <= int(found[1]) < 1 << 63 else None


def described(x: Record | Gap) -> tuple:
    """start, end, kind, record_type, page_id, refers_to, url, payload_bytes, payload_digest of what `read_archive` has found."""
    if isinstance(x, Gap):
        return (x.start, x.end, "gap", *[None] * 6)
    f = x.fields
    stated = f.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    return (x.start, x.end, "record", f["WARC-Type"], page(f["WARC-Record-ID"]), page(f.get("WARC-Refers-To")), f.get("WARC-Target-URI"), x.length, stated if f["WARC-Type"] == "revisit" else payload_digest(x.payload))


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record and gap of the files under path: file, start, end, kind (record or gap), record_type, page_id, refers_to, url, payload_bytes, payload_digest, payload (if asked for)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "file string, start long, end long, kind string, record_type string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = pa.schema([(n, pa.string() if t == "string" else pa.binary() if t == "binary" else pa.int64()) for n, t in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, held = [], 0
                for x in read_archive(data.as_py() or b""):
                    body = x.payload if payloads and isinstance(x, Record) else None
                    rows.append((file, *described(x), body))
                    held += len(body or b"")
                    if len(rows) >= 4096 or held > STEP * 64:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=kinds)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=kinds)

    return files.transform(in_arrow, run, schema)


def digests(archive: DataFrame) -> DataFrame:
    """What the query returns of `read_archives`: the records, without the log of gaps."""
    return archive.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
