"""WARC archives: written with one gzip member a record, read in byte ranges.

Equal payloads are stored once: the record of the smallest page id is a ``response`` and the others are
``revisit`` records that refer to it. A reading task is given a byte range of a file. It scans its range for
the gzip magic bytes, takes a place for a member's start only if what it decodes to begins with a WARC
header, and owns the records that start inside the range, also where they end behind it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tickloom.llm import files
from tickloom.llm.tables import OWN
from tickloom.session import scratch_path, written_once

# Fixed values of the formats: gzip's magic bytes and method, WARC's version line and profile.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_WINDOW = 31

LEVEL = 6
#: Bytes after which a writer goes on in a new file.
FILE_BYTES = 256 << 20
#: Bytes of a reading task's range.
RANGE_BYTES = 16 << 20
CHUNK = 1 << 20
#: Bytes a candidate member is decoded from, and to, when its header is checked.
PROBE_IN, PROBE_OUT = 4096, 64

MANIFEST = "path string, bytes bigint, records bigint"
RECORDS = pa.schema([
    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
    ("offset", pa.int64()), ("payload", pa.binary())])
RECORDS_TYPE = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
                "refers_to bigint, url string, offset bigint, payload binary")


def bare_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_of(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d*):\w+>", name or "")
    return int(found[1]) if found and found[1] else None


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, date: str,
    refers_to: str | None,
) -> bytes:
    """One record as a gzip member."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    body = http if refers_to else http + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(body))]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        fields.append(("WARC-Target-URI", safe))
    if refers_to:
        fields += [("WARC-Refers-To", refers_to), ("WARC-Profile", REVISIT_PROFILE)]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP_WINDOW)
    return b"".join([packer.compress(head), packer.compress(body),
                     packer.compress(b"\r\n\r\n"), packer.flush()])


def write_archives(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
    payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Writes a record per page; returns the stored list of files.

    Only digests and ids are grouped; a payload held by many pages is counted before it moves. Pages
    move once, by digest, to meet the decision on them; a digest of many pages is split by skew handling.
    """
    digest, first, small = f"{OWN}digest", f"{OWN}first", f"{OWN}small"
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    base = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        payload.alias("payload")).withColumns({
            digest: F.sha1("payload"), small: F.octet_length("payload") < min_bytes})
    firsts = base.where(~F.col(small)).groupBy(F.col(digest).alias(f"{OWN}of")).agg(
        F.min("page_id").alias(first), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"),
        F.count("page_id").alias("known")).where(
        (F.col(first) < F.col("last")) | ((F.col("known") > 0) & (F.col("known") < F.col("n"))))
    decided = base.join(
        firsts.select(f"{OWN}of", first), F.col(digest) == F.col(f"{OWN}of"), "left").select(
        "page_id", "url", "payload", digest,
        F.when(~F.col("page_id").eqNullSafe(F.col(first)), F.col(first)).alias(first))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows = (one for batch in batches for one in zip(*batch.columns))
        one, serial = next(rows, None), 0
        while one is not None:
            path = f"{folder}/pages-{part:06d}-{serial:06d}.warc.gz"
            size = records = 0
            with files.written(path) as stream:
                while one is not None and size < file_bytes:
                    page_id, url, body, sha1, to = (v.as_py() for v in one)
                    name = bare_digest(bytes.fromhex(sha1))
                    member = record(page_id, url, body, name, date,
                                    None if to is None else record_id(to, name))
                    stream.write(member)
                    size += len(member)
                    records += 1
                    one = next(rows, None)
            yield pa.RecordBatch.from_pydict({
                "path": [path], "bytes": [size], "records": [records]})
            serial += 1

    return written_once(decided.mapInArrow(write, MANIFEST))


@dataclass
class Source:
    """A file read forward through a window of its bytes."""

    file: pa.NativeFile
    size: int
    low: int = 0
    held: bytes = b""

    def bytes_at(self, at: int, count: int) -> bytes:
        """Up to ``count`` bytes from ``at`` on, read in chunks."""
        count = max(0, min(count, self.size - at))
        if not (self.low <= at and at + count <= self.low + len(self.held)):
            self.file.seek(at)
            self.low, self.held = at, self.file.read(max(count, CHUNK))
        return self.held[at - self.low:at - self.low + count]


def is_member(source: Source, at: int) -> bool:
    """Whether a gzip member that begins with a WARC header starts there."""
    try:
        head = zlib.decompressobj(GZIP_WINDOW).decompress(
            source.bytes_at(at, PROBE_IN), PROBE_OUT)
    except zlib.error:
        return False
    return re.match(rb"WARC/\d+\.\d+\r\n", head) is not None


def next_member(source: Source, at: int, end: int) -> int | None:
    """The first valid member start in [at, end)."""
    end = min(end, source.size)
    if at < end and source.bytes_at(at, len(MAGIC)) == MAGIC and is_member(source, at):
        return at
    while at < end:
        window = source.bytes_at(at, CHUNK)
        place = window.find(MAGIC)
        while place >= 0:
            if at + place >= end:
                return None
            if is_member(source, at + place):
                return at + place
            place = window.find(MAGIC, place + 1)
        if at + len(window) >= source.size:
            return None
        at += len(window) - len(MAGIC) + 1
    return None


def decode(source: Source, at: int) -> tuple[bytes, int]:
    """The content of the member that starts there, and the place after it."""
    unpacker = zlib.decompressobj(GZIP_WINDOW)
    parts = []
    while not unpacker.eof:
        data = source.bytes_at(at, CHUNK // 4)
        if not data:
            raise ValueError("the archive ends within a record")
        parts.append(unpacker.decompress(data))
        at += len(data) - len(unpacker.unused_data)
    return b"".join(parts), at


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    pairs = (line.partition(":") for line in lines if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse(content: bytes, offset: int, with_payload: bool) -> tuple:
    head, _, rest = content.partition(b"\r\n\r\n")
    warc = fields_of(head)
    body = rest[:int(warc["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    stated = warc.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = warc["warc-type"]
    refers_to = None
    if kind == "revisit":
        size, digest = int(fields_of(http)["content-length"]), stated
        refers_to, payload = page_of(warc.get("warc-refers-to")), None
    else:
        size, digest = len(payload), bare_digest(hashlib.sha1(payload).digest())
        if stated and stated != digest:
            raise ValueError(f"the record at {offset} does not match its digest")
    return (page_of(warc.get("warc-record-id")), size, digest, kind, refers_to,
            warc.get("warc-target-uri"), offset, payload if with_payload else None)


def records_in(path: str, start: int, end: int, with_payload: bool = False) -> Iterator[tuple]:
    """The records of a file that start in [start, end)."""
    with files.opened(path) as file:
        source = Source(file, file.size())
        at = next_member(source, start, end)
        while at is not None:
            content, after = decode(source, at)
            yield parse(content, at, with_payload)
            at = next_member(source, after, end)


def read_archives(
    manifest: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = False
) -> DataFrame:
    """Reads archives (``path``, ``bytes``) in parallel, one task for some byte ranges."""
    ranges = manifest.where("bytes > 0").select("path", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint")
    )).alias("start"))
    count = ranges.count()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                held: list[tuple] = []
                size = 0
                for one in records_in(path, start, start + range_bytes, with_payload):
                    held.append(one)
                    size += len(one[-1] or b"")
                    if len(held) >= 4096 or size >= CHUNK:
                        yield _batch(held)
                        held, size = [], 0
                yield _batch(held)

    return ranges.repartition(max(1, count)).mapInArrow(read, RECORDS_TYPE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(RECORDS)], schema=RECORDS)


def archive_table(
    pages: DataFrame, folder: str | None = None, range_bytes: int = RANGE_BYTES, **settings
) -> DataFrame:
    """Writes the pages' archives below the shared folder and reads them back.

    A null or empty payload is a record of 0 bytes; payloads below ``min_bytes`` are never revisits; the
    smallest page id is the response, null ids last; rows that repeat its id are responses, too. A null url has
    no target field. Payloads of any length are one
    record each. No rows give no files and no records. Other columns are not read.
    """
    folder = folder or scratch_path(pages.sparkSession, "archives")
    return read_archives(write_archives(pages, folder, **settings), range_bytes)
