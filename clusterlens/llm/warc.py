"""WARC files: records of pages written once per distinct payload, and a reader that salvages damaged archives.

Writing. Of records with equal payloads of at least `least_bytes`, the one with the largest page id is a response,
the others are revisits that refer to it. Equal payloads are found by SHA-256 in an aggregate with map-side
combine, and only payloads that occur more than once are joined back. Every record is a gzip member of its own.

Reading. A member is accepted when its gzip checksum holds, its version line, headers and length parse, and the
payload digest of a response agrees. After a failed check the reader looks, from the byte after the failed start on,
for the next gzip magic or version line at the start of a line that starts an acceptable record, goes on there, and
logs the bytes between as a quarantined gap with the reason. Whether a record is plain or a member is told by its own
first bytes, never by those of the archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterlens.llm.shared import Scratch, create, open_input, slices, text_of

ARCHIVE_BYTES = 32 << 20
LEVEL = 2
CHUNK = 1 << 16
MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
START = re.compile(rb"\x1f\x8b\x08|(?<=\n)WARC/1\.[01]\r\n")
KEEP = 10  # bytes of a start, with the line end before it, that a chunk may cut off
ID = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "path string, records long, bytes long"
READ = "path string, start long, end long, reason string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class Damaged(Exception):
    """A record or member that fails a check."""


class Record(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def kind(self) -> str:
        return self.headers["WARC-Type"]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _number(page: int | None) -> str:
    return "null" if page is None else str(page)


def record_bytes(page: int | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One uncompressed record; a revisit (`refers_to` is the number of its response) has HTTP headers but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{_number(page)}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line without a colon")
        out[name.strip()] = value.strip()
    return out


def parse_record(raw: bytes) -> tuple[Record, int]:
    """The record at the start of `raw` and its length."""
    version = VERSION.match(raw)
    if not version:
        raise Damaged("no version line")
    stop = raw.find(b"\r\n\r\n")
    if stop < 0:
        raise Damaged("headers without an end")
    headers = _fields(raw[version.end() : stop])
    length = headers.get("Content-Length", "")
    if not length.isdigit() or "WARC-Type" not in headers or "WARC-Record-ID" not in headers:
        raise Damaged("a mandatory header is missing")
    body, end = stop + 4, stop + 4 + int(length)
    if raw[end : end + 4] != b"\r\n\r\n":
        raise Damaged("length does not meet the end of the record")
    block, http, payload = raw[body:end], {}, raw[body:end]
    if headers.get("Content-Type", "").startswith("application/http"):
        first, _, rest = block.partition(b"\r\n\r\n")
        payload = rest
        http = _fields(first.partition(b"\r\n")[2]) if b"\r\n" in first else {}
    told = headers.get("WARC-Payload-Digest", "")
    if headers["WARC-Type"] == "response" and told.startswith("sha1:") and told[5:] != digest(payload):
        raise Damaged("payload digest differs")
    return Record(headers, http, payload), end + 4


def _member(file, start: int, raw: bytes) -> tuple[bytes, int]:
    """Content of the gzip member at `start`, and where it ends; `raw` is its first chunk, already read."""
    inflate, parts, at = zlib.decompressobj(31), [], start
    while not inflate.eof:
        if not raw:
            raise Damaged("the member has no end")
        try:
            parts.append(inflate.decompress(raw))
        except zlib.error as e:
            raise Damaged(f"gzip: {e}") from None
        at += len(raw)
        if not b"WARC/".startswith(parts[0][:5]):
            raise Damaged("no version line")
        raw = b"" if inflate.eof else file.read(CHUNK)
    return b"".join(parts), at - len(inflate.unused_data)


def _gzipped(file, start: int, raw: bytes) -> tuple[Record, int]:
    """The record in the member at `start` of an archive."""
    raw, end = _member(file, start, raw)
    record, length = parse_record(raw)
    if length != len(raw):
        raise Damaged("bytes after the record in its member")
    return record, end


def _plain(file, start: int, raw: bytes) -> tuple[Record, int]:
    """The plain record at `start`. Its stated end is looked at before its block is read, so a damaged length costs nothing."""
    stop = raw.find(b"\r\n\r\n")
    while stop < 0 and raw[:5] == b"WARC/" and len(raw) <= CHUNK and (more := file.read(CHUNK)):
        raw += more
        stop = raw.find(b"\r\n\r\n")
    need = re.search(rb"\r\nContent-Length: *(\d+)\r\n", raw[: stop + 2]) if stop >= 0 and raw[:5] == b"WARC/" else None
    end = stop + 8 + int(need[1]) if need else 0
    if end > len(raw):
        if start + end > file.seek(0, 2):
            raise Damaged("length goes beyond the end of the archive")
        file.seek(start + end - 4)
        if file.read(4) != b"\r\n\r\n":
            raise Damaged("length does not meet the end of the record")
        file.seek(start + len(raw))
        raw += file.read(end - len(raw))
    record, length = parse_record(raw)
    return record, start + length


def _accept(file, start: int) -> tuple[Record, int]:
    """The record at `start`, plain or a member, and where it ends."""
    file.seek(start)
    raw = file.read(CHUNK)
    return (_gzipped if raw.startswith(MAGIC) else _plain)(file, start, raw)


def _starts(file, at: int) -> Iterator[int]:
    """Places after `at` that look like the start of a member or record, reading chunk by chunk."""
    last, tail = at, b""
    while True:
        file.seek(at)
        raw = file.read(CHUNK)
        if not raw:
            return
        text, base = tail + raw, at - len(tail)
        for m in START.finditer(text):
            if base + m.start() > last:
                last = base + m.start()
                yield last
        at += len(raw)
        tail = text[-KEEP:]


def salvage(file) -> Iterator[tuple[int, int, str | None, Record | None]]:
    """Of an archive, in order: (start, end, None, record) of records, (start, end, reason, None) of gaps."""
    size = file.seek(0, 2)
    at = 0
    while at < size:
        try:
            record, end = _accept(file, at)
        except Damaged as e:
            for place in _starts(file, at):
                try:
                    record, end = _accept(file, place)
                except Damaged:
                    continue
                yield at, place, str(e), None
                break
            else:
                yield at, size, str(e), None
                return
            at = place
        yield at, end, None, record
        at = end


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, file, n, size = [], None, 0, 0
        for batch in slices(batches, "html", 4 << 20):
            for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers")), strict=True):
                if file is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    file = create(path)
                press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                raw = press.compress(record_bytes(page, url, html.encode(), refers)) + press.flush()
                file.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= archive_bytes:
                    file.close()
                    made.append((path, n, size))
                    file = None
        if file is not None:
            file.close()
            made.append((path, n, size))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=["path", "records", "bytes"])

    return run


def write(docs: DataFrame, scratch: Scratch, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives; the table of them (path, records, bytes). `docs` has page_id, url, html."""
    rows = docs.select(F.col("page_id").cast("long").alias("page_id"), "url", text_of("html").alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("html", 256)))
    long = rows.where(F.octet_length("html") >= least_bytes)
    seen = long.groupBy("sha").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    seen = scratch.stage(seen.where("n > 1").select("sha", "first"), "repeated")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.join(seen, "sha", "left").withColumn("refers", F.when(again, F.col("first").cast("string")))
    files = rows.select("page_id", "url", "html", "refers").mapInArrow(_write(scratch.folder("warc"), archive_bytes), FILES)
    return scratch.stage(files, "files")


def _page(uri: str | None) -> int | None:
    number = (uri or "").removeprefix(f"<{ID}").removesuffix(">")
    return int(number) if re.fullmatch(r"-?\d+", number) else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in READ.split(", ")]
    kinds = [pa.string() if c.split()[1] == "string" else pa.int64() for c in READ.split(", ")]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows = []
            with open_input(path) as file:
                for start, end, reason, r in salvage(file):
                    if r is None:
                        rows.append((path, start, end, reason, None, None, None, None, None))
                    else:
                        size = int(r.http.get("Content-Length", len(r.payload)))
                        told = r.headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
                        rows.append((path, start, end, None, _page(r.headers["WARC-Record-ID"]), size, told, r.kind, _page(r.headers.get("WARC-Refers-To"))))
                    if len(rows) >= 5000:
                        yield emit(rows)
                        rows = []
            if rows:
                yield emit(rows)


def read(files: DataFrame) -> DataFrame:
    """Records and gaps of archives: path, start, end, reason (null for records), and the fields of records."""
    n = max(1, files.count())
    return files.select("path").repartition(n).mapInArrow(_read, READ)


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload. Rows that repeat the largest page id of their payload are responses all of
    them; null ids rank below all others, and where all ids of a payload are null all are responses. Other columns
    are not read. An empty table writes no archive and gives no rows. A gap in an archive read back is an error.
    """
    scratch = Scratch(spark, "warc")
    out = read(write(pages, scratch, least_bytes, archive_bytes))
    gap = F.format_string("gap in %s from %d to %d: %s", "path", "start", "end", "reason")
    out = out.where(F.when(F.col("reason").isNull(), True).otherwise(F.raise_error(gap).cast("boolean")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
