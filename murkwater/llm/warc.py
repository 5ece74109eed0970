"""Pages as WARC records in ZIP archives, and a reader that takes single records out of them by their ranges.

An archive holds members that are stored, not compressed: ``archive/*.warc.gz`` with records, each a gzip member of its own as
is usual for WARC files, and last ``indexes/index.jsonl`` with a line for each record that tells its member, place and length. The reader looks only at an
archive's end, its central directory (ZIP64 or not), the members' local headers and the index; records are then
read as ranges of the archive, by other tasks than those that listed it.

Archives go to the shared folder through pyarrow's file systems. A task gives each archive a name of its own
and hands the name on when it is closed; what a lost or repeated task left behind is in no list and
never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folder import place
from .shared import partitions, written

INDEX = "indexes/index.jsonl"
#: Bytes of records after which a member is closed (a longer record has one to itself), and of members after which an archive is.
MEMBER_BYTES = 16_000_000
ARCHIVE_BYTES = 256_000_000
#: Ranges that lie this close are read at once, up to so many bytes.
GAP, READ_BYTES = 4096, 8_000_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Signatures and sizes of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_SIZE, CENTRAL_SIZE, END_SIZE, END64_SIZE, LOCATOR_SIZE, MOST_COMMENT = 30, 46, 22, 56, 20, 65535


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def decided(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, sha1, payload_bytes, refers_to, revisit) of ``pages``: which record holds a payload and which only refer to it.

    Of payloads that are equal and of at least ``least_bytes`` the one with the largest page_id (nulls first) is
    kept; of rows that repeat it one. ``pages`` must split alike whenever it is read, as files do. Payloads are told apart by SHA-1 and
    length; equal ones are reduced to one row before they meet the pages, whose html is shuffled once.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumns({"_m": F.monotonically_increasing_id(), "_s": F.sha1(F.col("html").cast("binary")), "_n": F.octet_length("html")})
    best = rows.groupBy("_s", "_n").agg(F.max(F.struct(F.col("page_id").isNotNull().alias("some"), "page_id", "_m")).alias("best"), F.count("*").alias("copies"))
    best = best.where((F.col("copies") > 1) & (F.col("_n") >= least_bytes)).select(F.col("_s").alias("_s2"), F.col("_n").alias("_n2"), F.col("best.page_id").alias("first"), F.col("best._m").alias("_m2"))
    both = rows.join(best, (F.col("_s") == F.col("_s2")) & (F.col("_n") == F.col("_n2")), "left")
    revisit = F.col("_m2").isNotNull() & (F.col("_m") != F.col("_m2"))
    return both.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), F.col("_s").alias("sha1"), F.col("_n").alias("payload_bytes"), F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def _escaped(value: str) -> str:
    """A header's value without control characters and blanks, which are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """A WARC record: a response with its payload, or where ``payload`` is null a revisit with the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_escaped(url)}")
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """What a record says: page_id, record_type, refers_to, url, payload (null in a revisit), payload_bytes and payload_digest of the full payload.

    Lengths and digests of block and payload are checked.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    length = int(fields["content-length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n" or fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("damaged WARC record")
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    said = int(re.search(rb"(?im)^Content-Length:\s*(\d+)", http)[1])
    if kind == "response" and (len(payload) != said or base32_sha1(payload) != digest):
        raise ValueError("damaged WARC payload")
    return {"page_id": number("warc-record-id"), "record_type": kind, "refers_to": number("warc-refers-to"), "url": fields.get("warc-target-uri"), "payload": payload if kind == "response" else None, "payload_bytes": said, "payload_digest": digest}


class Archive:
    """A ZIP archive in the making, written from front to end: record members, then the index."""

    def __init__(self, folder: str):
        system, base = pa.fs.FileSystem.from_uri(folder)
        self.name = f"{uuid.uuid4().hex}.zip"
        system.create_dir(base, recursive=True)
        self.stream = system.open_output_stream(f"{base}/{self.name}")
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.index, self.member, self.members, self.bytes = io.StringIO(), io.BytesIO(), 0, 0

    def add(self, data: bytes) -> None:
        data = gzip.compress(data, mtime=0)
        if self.member.tell() and self.member.tell() + len(data) > MEMBER_BYTES:
            self._close_member()
        line = {"member": f"archive/data-{self.members:05}.warc.gz", "offset": self.member.tell(), "length": len(data)}
        self.index.write(json.dumps(line) + "\n")
        self.member.write(data)

    def _close_member(self) -> None:
        self._store(f"archive/data-{self.members:05}.warc.gz", self.member.getvalue())
        self.bytes += self.member.tell()
        self.members, self.member = self.members + 1, io.BytesIO()

    def _store(self, name: str, data: bytes) -> None:
        self.zip.writestr(zipfile.ZipInfo(name), data)

    def full(self) -> bool:
        return self.bytes + self.member.tell() > ARCHIVE_BYTES

    def close(self) -> str:
        if self.member.tell():
            self._close_member()
        self._store(INDEX, self.index.getvalue().encode())
        self.zip.close()
        self.stream.close()
        return self.name


def write(records: DataFrame, folder: str) -> DataFrame:
    """(archive): names of the archives in ``folder`` that hold the records of ``decided``, written by the tasks that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            # one row at a time as Python objects: a batch may hold long pages
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                archive = archive or Archive(folder)
                payload = None if row["revisit"] else row["html"].encode()
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                archive.add(record(row["page_id"], row["url"], payload, digest, row["payload_bytes"], row["refers_to"]))
                if archive.full():
                    yield pa.RecordBatch.from_pydict({"archive": [archive.close()]})
                    archive = None
        if archive:
            yield pa.RecordBatch.from_pydict({"archive": [archive.close()]})

    return records.mapInArrow(run, "archive string")


@dataclass(frozen=True)
class Member:
    """A member as the central directory has it."""

    name: str
    method: int
    size: int
    header: int


def _range(source: pa.NativeFile, start: int, length: int) -> bytes:
    source.seek(start)
    data = source.read(length)
    if len(data) != length:
        raise ValueError("archive ends early")
    return data


def directory(source: pa.NativeFile) -> list[Member]:
    """Members of a ZIP archive by its central directory; where the end record is too small for its figures they are in the ZIP64 one."""
    total = source.size()
    tail_at = max(0, total - END_SIZE - MOST_COMMENT)
    tail = _range(source, tail_at, total - tail_at)
    at = tail.rfind(END)
    while at >= 0 and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(END, 0, at)  # the signature may be part of the comment
    if at < 0:
        raise ValueError("no ZIP archive")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    end_at = tail_at + at
    if count == 0xFFFF or 0xFFFFFFFF in (size, start):
        locator = _range(source, end_at - LOCATOR_SIZE, LOCATOR_SIZE)
        if not locator.startswith(LOCATOR):
            raise ValueError("no ZIP64 locator")
        end64 = _range(source, struct.unpack_from("<Q", locator, 8)[0], END64_SIZE)
        if not end64.startswith(END64):
            raise ValueError("no ZIP64 end record")
        count, size, start = struct.unpack_from("<QQQ", end64, 32)
    data, at, members = _range(source, start, size), 0, []
    for _ in range(count):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, plain, name, extra, comment = struct.unpack_from("<IIHHH", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        name_at = at + CENTRAL_SIZE
        text = data[name_at : name_at + name].decode("utf-8" if flags & 0x800 else "cp437")
        packed, plain, header = _wide(data[name_at + name : name_at + name + extra], packed, plain, header)
        members.append(Member(text, method, packed, header))
        at = name_at + name + extra + comment
    return members


def _wide(extra: bytes, packed: int, plain: int, header: int) -> tuple[int, int, int]:
    """Sizes and place of a member; those that are all ones stand in its ZIP64 field, in a fixed order."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            fields = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            plain = next(fields) if plain == 0xFFFFFFFF else plain
            packed = next(fields) if packed == 0xFFFFFFFF else packed
            header = next(fields) if header == 0xFFFFFFFF else header
        at += 4 + length
    return packed, plain, header


def data_start(source: pa.NativeFile, member: Member) -> int:
    """Where a stored member's bytes begin; its local header has lengths of its own."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed")
    head = _range(source, member.header, LOCAL_SIZE)
    if not head.startswith(LOCAL):
        raise ValueError("no local header")
    name, extra = struct.unpack_from("<HH", head, 26)
    return member.header + LOCAL_SIZE + name + extra


def listed(source: pa.NativeFile, index: str = INDEX) -> Iterator[tuple[int, int]]:
    """(start, length) of each record in an archive, from its index, which is read in pieces."""
    members = {m.name: m for m in directory(source)}
    starts = {name: data_start(source, m) for name, m in members.items() if name.endswith(".warc.gz")}
    at, left, rest = data_start(source, members[index]), members[index].size, b""
    while left or rest:
        piece = _range(source, at, min(left, READ_BYTES))
        at, left = at + len(piece), left - len(piece)
        *lines, rest = (rest + piece).split(b"\n") if left else [*(rest + piece).split(b"\n"), b""]
        for line in filter(None, lines):
            entry = json.loads(line)
            yield starts[entry["member"]] + entry["offset"], entry["length"]


def locate(archives: DataFrame, folder: str) -> DataFrame:
    """(archive, start, length) of every record in the archives, one archive a task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows: list[tuple[int, int]] = []
                with system.open_input_file(f"{base}/{name}") as source:
                    for row in listed(source):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield _located(name, rows)
                            rows = []
                if rows:
                    yield _located(name, rows)

    return archives.mapInArrow(run, "archive string, start long, length long")


def _located(name: str, rows: list[tuple[int, int]]) -> pa.RecordBatch:
    starts, lengths = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"archive": [name] * len(rows), "start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int64())})


def _grouped(rows: Iterable[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Ranges that lie close in one archive, together."""
    now: list[tuple[str, int, int]] = []
    for row in rows:
        if now and (row[0] != now[0][0] or row[1] < now[-1][1] or row[1] - now[-1][1] - now[-1][2] > GAP or row[1] + row[2] - now[0][1] > READ_BYTES):
            yield now
            now = []
        now.append(row)
    if now:
        yield now


FIELDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read(ranges: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Records at (archive, start, length), parsed and checked: page_id, url, record_type, refers_to, payload_bytes, payload_digest, if asked payload.

    Ranges are dealt out in runs of neighbours, so many tasks can read one archive; a task holds one read.
    """
    names = [x.split()[0] for x in FIELDS.split(", ")] + ["payload"] * with_payload
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in FIELDS.split(", "))] + [("payload", pa.binary())] * with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            opened, source = None, None
            for near in _grouped(zip(*(batch.column(c).to_pylist() for c in ("archive", "start", "length")), strict=True)):
                if near[0][0] != opened:
                    if source:
                        source.close()
                    opened, source = near[0][0], system.open_input_file(f"{base}/{near[0][0]}")
                first = near[0][1]
                data = _range(source, first, near[-1][1] + near[-1][2] - first)
                found = [parsed(gzip.decompress(data[start - first : start - first + length])) for _, start, length in near]
                yield pa.RecordBatch.from_pydict({n: [x[n] for x in found] for n in names}, schema=schema)
            if source:
                source.close()

    spark = ranges.sparkSession
    line = ranges.repartitionByRange(partitions(spark), "archive", "start").sortWithinPartitions("archive", "start")
    return line.mapInArrow(run, FIELDS + ", payload binary" * with_payload)


def archived(pages: DataFrame, least_bytes: int = 0) -> tuple[DataFrame, str]:
    """Names of the archives that hold a record of each row of ``pages`` (page_id, url, html), and their folder.

    A null html has an empty payload, a null url no target, a null page_id an empty one; repeated rows have a
    record each; other columns, whatever their names, are left out. An empty table gives no archive.
    """
    folder = place(pages.sparkSession, "warc")
    return written(write(decided(pages, least_bytes), folder), "archives"), folder


def round_trip(pages: DataFrame, least_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Every record of ``archived`` pages, read back from the archives by its range."""
    archives, folder = archived(pages, least_bytes)
    spread = archives.repartition(partitions(pages.sparkSession), "archive")
    return read(written(locate(spread, folder), "ranges"), folder, with_payload)
