"""WARC archives: a writer that records equal payloads once, and a salvage reader.

``write_archives`` writes a response record for each page, or a revisit record where another page has the same payload, as gzip members (one a
record) or plain. Files go to the shared folder; their names carry the task attempt, and only the files that the manifest lists count, so
retried and speculative tasks do no harm.

``read_archives`` streams the files. Every record is checked: gzip's own sums, the record's form and length, and the payload's digest where there is
one of a known kind, in hex or base32; records of all types are read, with field names in any case. After a failed check the salvage reader looks
for the next valid gzip member or version line, goes on there, and reports the bytes between as a gap: a row of the result. What it looks for is
remembered (``Window.find``), so damage is searched once and not again from each place where a record might have begun.

Defined cases: null html is an empty payload, and empty payloads are equal to each other; a null url is left out; of repeated rows with one
page_id all are responses if that page_id is the largest; rows without a page_id are revisits of an equal page that has one, and otherwise
responses; an empty table gives no files and an empty result; further columns are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, shared_folder, written

log = logging.getLogger(__name__)

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the pages bear no dates
FILE_BYTES = 64 << 20
MANDATORY = {"warc-type", "warc-record-id", "warc-date", "content-length"}
#: Digests by the labels that archives give them.
DIGESTS = {"sha1": hashlib.sha1, "sha-1": hashlib.sha1, "sha256": hashlib.sha256, "sha-256": hashlib.sha256, "sha512": hashlib.sha512, "sha-512": hashlib.sha512, "md5": hashlib.md5}
CHUNK = 16 << 10
MAGIC = b"\x1f\x8b\x08"
#: Digests of payloads that several pages have: up to this many are broadcast, beyond that the join is a shuffle.
BROADCAST_ROWS = 200_000


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and the path in it. A ``file:`` address is a folder that all machines mount."""
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; ``refers_to`` makes it a revisit, whose block has the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes, level: int = 5) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest (hex), refers_to (null: a response)."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    several = rows.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").select("digest", "keeper")
    several = written(several)
    joined = rows.join(F.broadcast(several) if several.count() <= BROADCAST_ROWS else several, "digest", "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("keeper")), F.col("keeper")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, compressed: bool = True, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the archives; returns the manifest path, records, size (a written table)."""
    folder = folder or shared_folder(pages.sparkSession)

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        system, root = file_system(folder)
        task = TaskContext.get()
        stem, count, out, records, size = f"{root}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}", 0, None, 0, 0
        for page_id, url, payload, digest, refers_to in rows:
            if out is None:
                system.create_dir(root, recursive=True)
                path = f"{stem}-{count:04d}.warc{'.gz' * compressed}"
                out, records, size, count = system.open_output_stream(path, compression=None), 0, 0, count + 1
            data = record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), refers_to)
            data = member(data) if compressed else data
            out.write(data)
            records, size = records + 1, size + len(data)
            if size >= file_bytes:
                out.close()
                out = None
                yield path, records, size
        if out is not None:
            out.close()
            yield path, records, size

    return written(map_rows(planned(pages), "path string, records long, size long", each)).withColumn("folder", F.lit(folder))


@dataclass
class Record:
    """A record that passed all checks."""

    start: int
    end: int
    head: Fields
    payload: bytes
    payload_bytes: int


@dataclass
class Gap:
    """Bytes in which no valid record was found."""

    start: int
    end: int


class Window:
    """Random access to a file through one buffered stretch of it."""

    def __init__(self, file, size: int, stretch: int = 1 << 20):
        self.file, self.size, self.stretch, self.at, self.held = file, size, stretch, 0, b""
        self.last: dict[bytes, tuple[int, int]] = {}  # from where each text was last looked for, and where it was found

    def get(self, start: int, length: int) -> bytes:
        if not self.at <= start or start + length > self.at + len(self.held):
            self.file.seek(start)
            self.at, self.held = start, self.file.read(max(length, self.stretch))
        return self.held[start - self.at : start - self.at + length]

    def find(self, what: bytes, start: int) -> int:
        """Where ``what`` next begins; -1 if nowhere."""
        since, found = self.last.get(what, (self.size, -1))
        if not (since <= start and (found < 0 or start <= found)):
            found = self._search(what, start)
            self.last[what] = (start, found)
        return found

    def _search(self, what: bytes, start: int) -> int:
        while start + len(what) <= self.size:
            if not self.at <= start or start + len(what) > self.at + len(self.held):
                self.get(start, self.stretch)
            if (k := self.held.find(what, start - self.at)) >= 0:
                return self.at + k
            start = self.at + len(self.held) - len(what) + 1
        return -1


class Fields(dict):
    """Header fields by names in any case; of several with one name the first."""

    def __init__(self, pairs: list[tuple[str, str]]):
        super().__init__({name.lower(): value for name, value in reversed(pairs)})

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def __contains__(self, name: object) -> bool:
        return super().__contains__(str(name).lower())

    def get(self, name: str, default: str | None = None) -> str | None:
        return super().get(name.lower(), default)


def _parse(data: bytes) -> tuple[Fields, int] | None:
    """Header fields and where the block begins; None if this is no record head."""
    end = data.find(b"\r\n\r\n") if data.startswith(b"WARC/1.") else -1
    if end < 0:
        return None
    try:
        lines = re.sub(r"\r\n[ \t]+", " ", data[:end].decode()).split("\r\n")  # a line that begins with a blank goes on from the one before
    except UnicodeDecodeError:
        return None
    pairs = []
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            return None
        pairs.append((name, value.strip(" \t")))
    head = Fields(pairs)
    if not MANDATORY <= head.keys() or not re.fullmatch("<[^<> ]+>|[^<> ]+", head["warc-record-id"]):
        return None
    if not head["content-length"].isascii() or not head["content-length"].isdigit():
        return None
    return head, end + 4


def _false_digest(digest: str, payload: bytes) -> bool:
    """A digest of a known kind that is not the payload's, whether in hex or in base32 and with padding or without."""
    kind, _, value = digest.partition(":")
    if not value or kind.lower() not in DIGESTS:
        return False
    own = DIGESTS[kind.lower()](payload).digest()
    return value.upper().rstrip("=") not in (own.hex().upper(), base64.b32encode(own).decode().rstrip("="))


def _checked(head: Fields, block: bytes, start: int, end: int) -> Record | None:
    """The record, of whatever type; None if it has a digest of another payload (a revisit has the original's, a segment the whole's, chunks perhaps the joined ones')."""
    kind = head["warc-type"].lower()
    http = block.startswith(b"HTTP/") or head.get("content-type", "").lower().startswith("application/http")
    body = (k + 4 if (k := block.find(b"\r\n\r\n")) >= 0 else len(block)) if http else 0
    payload = block[body:]
    if _false_digest(head.get("warc-block-digest", ""), block):
        return None
    chunked = re.search(rb"(?i)\r\nTransfer-Encoding:[ \t]*chunked", block[:body])  # its digest may be that of the joined chunks
    if kind != "revisit" and not chunked and "warc-segment-number" not in head and _false_digest(head.get("warc-payload-digest", ""), payload):
        return None
    told = re.search(rb"(?i)\r\nContent-Length:[ \t]*(\d+)[ \t]*\r\n", block[:body])
    return Record(start, end, head, payload, int(told[1]) if told and kind == "revisit" else len(payload))


def _member_at(window: Window, start: int) -> Record | None:
    unpack, parts, at = zlib.decompressobj(31), [], start
    try:
        while not unpack.eof:
            data = window.get(at, CHUNK)
            if not data:
                return None
            parts.append(unpack.decompress(data))
            at += len(data)
    except zlib.error:
        return None
    end, data = at - len(unpack.unused_data), b"".join(parts)
    if not (found := _parse(data)):
        return None
    head, body = found
    stop = body + int(head["content-length"])
    return _checked(head, data[body:stop], start, end) if data[stop:] == b"\r\n\r\n" else None


def _plain_at(window: Window, start: int) -> Record | None:
    end = window.find(b"\r\n\r\n", start)
    if end < 0 or not (found := _parse(window.get(start, end + 4 - start))):
        return None
    head, body = found
    stop = start + body + int(head["content-length"])
    if stop + 4 > window.size or window.get(stop, 4) != b"\r\n\r\n":
        return None
    return _checked(head, window.get(start + body, stop - start - body), start, stop + 4)


def salvage(file, size: int) -> Iterator[Record | Gap]:
    """The valid records of an archive, gzip members or plain records or both, and the gaps between them."""
    window, at, lost = Window(file, size), 0, None
    while at < size:
        first = window.get(at, 8)
        found = _member_at(window, at) if first.startswith(MAGIC) else _plain_at(window, at) if first.startswith(b"WARC/1.") else None
        if found:
            if lost is not None:
                yield Gap(lost, at)
                lost = None
            yield found
            at = found.end
            continue
        lost = at if lost is None else lost
        nexts = [k for k in (window.find(MAGIC, at + 1), window.find(b"WARC/1.", at + 1)) if k >= 0]
        at = min(nexts, default=size)
    if lost is not None:
        yield Gap(lost, size)


def read_archives(manifest: DataFrame, whole: bool = False) -> DataFrame:
    """A row for each record (record_type is its type) and each gap (record_type gap: gap_start, gap_end) of the files ``path``.

    With ``whole`` a gap, or a number of records other than the manifest's ``records``, is an error.
    """

    def page(name: str | None) -> int | None:
        digits = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
        return int(digits[1]) if digits else None

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for folder, path, records in rows:
            read, system = 0, file_system(folder)[0]
            with system.open_input_file(path) as file:
                for x in salvage(file, file.size()):
                    if isinstance(x, Gap):
                        if whole:
                            raise ValueError(f"{path}: bytes {x.start} to {x.end} hold no valid record")
                        log.warning("%s: bytes %d to %d hold no valid record", path, x.start, x.end)
                        yield path, "gap", None, None, None, None, None, None, x.start, x.end
                    else:
                        kind, read, digest = x.head["warc-type"].lower(), read + 1, x.head.get("warc-payload-digest")
                        url, refers = x.head.get("warc-target-uri"), page(x.head.get("warc-refers-to"))
                        yield path, kind, page(x.head["warc-record-id"]), url, x.payload_bytes, digest and digest.removeprefix("sha1:"), refers, None if kind == "revisit" else x.payload, None, None
            if whole and read != records:
                raise ValueError(f"{path}: {read} of {records} records")

    files = max(1, manifest.count())
    schema = "path string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary, gap_start long, gap_end long"
    return map_rows(manifest.select("folder", "path", F.col("records") if whole else F.lit(None).cast("long")).repartition(files), schema, each, chunk_bytes=4 << 20)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` to archives and reads them back: a row for each page. A gap or a missing record is an error."""
    found = read_archives(write_archives(pages), whole=True)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
