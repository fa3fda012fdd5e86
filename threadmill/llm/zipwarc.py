"""WARC records in ZIP packages, written and range-read without extraction.

A package holds stored (not deflated) members: `archive/data.warc.gz`, whose
records are gzip members of their own, and `indexes/index.cdxj`, one line per
record with its place in the archive.
"""

from __future__ import annotations

import base64
import binascii
import gzip
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm.common import partitions, scratch_path, settled, small_side
from threadmill.llm.files import located, task_number, write_new

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 64 << 20
RECORDS_AT_ONCE = 500
SMALLEST_REVISITED = 0

# Fixed values of the formats: signatures and "see the ZIP64 field" marks.
_LOCAL, _CENTRAL, _END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
_END64, _LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
_SEE16, _SEE32 = 0xFFFF, 0xFFFFFFFF
_DOS_TIME = struct.pack("<HH", 0, (2000 - 1980) << 9 | 1 << 5 | 1)
WARC_DATE = "2000-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    crc: int
    header_at: int


def zip_bytes(members: list[tuple[str, list[bytes]]], zip64: bool = False) -> list[bytes]:
    """A package of stored members; `zip64` uses ZIP64 fields even where the
    sizes do not call for them."""
    out, central, at = [], [], 0
    for name, pieces in members:
        size, crc = sum(map(len, pieces)), 0
        for piece in pieces:
            crc = binascii.crc32(piece, crc)
        wide = zip64 or size >= _SEE32 or at >= _SEE32
        encoded = name.encode()
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        shown = _SEE32 if wide else size
        common = struct.pack("<HHH", 45 if wide else 20, 1 << 11, 0) + _DOS_TIME
        sizes = struct.pack("<IIIH", crc, shown, shown, len(encoded))
        local = _LOCAL + common + sizes + struct.pack("<H", len(extra)) + encoded + extra
        far = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
        central.append(
            _CENTRAL + struct.pack("<H", 45) + common + sizes
            + struct.pack("<HHHHII", len(far), 0, 0, 0, 0, _SEE32 if wide else at) + encoded + far
        )
        out += [local, *pieces]
        at += len(local) + size
    directory = b"".join(central)
    tail = b""
    wide = zip64 or at >= _SEE32 or len(members) >= _SEE16
    n, size, start = len(members), len(directory), at
    if wide:
        tail = _END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start)
        tail += _LOCATOR64 + struct.pack("<IQI", 0, at + size, 1)
    shown = (_SEE16, _SEE16, _SEE32, _SEE32) if wide else (n, n, size, start)
    return [*out, directory, tail, _END + struct.pack("<HHHHIIH", 0, 0, *shown, 0)]


def zip_members(source, size: int) -> dict[str, Member]:
    """The central directory of a package, from its end; ZIP64 or not."""
    tail_at = max(0, size - (22 + 0xFFFF))
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(_END)
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(_END, 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    if _SEE16 == n or _SEE32 in (length, start):
        locator = source.read_at(20, tail_at + end - 20)
        if locator[:4] != _LOCATOR64:
            raise ValueError("no ZIP64 locator")
        at = struct.unpack_from("<Q", locator, 8)[0]
        record = source.read_at(56, at)
        if record[:4] != _END64:
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, members = source.read_at(length, start), 0, {}
    for _ in range(n):
        if directory[at : at + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        method, crc, packed, full = struct.unpack_from("<H4xIII", directory, at + 10)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", directory, at + 28)
        header_at = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + n_name].decode()
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{length // 8}Q", extra, 4))
                full = wide.pop(0) if full == _SEE32 else full
                packed = wide.pop(0) if packed == _SEE32 else packed
                header_at = wide.pop(0) if header_at == _SEE32 else header_at
            extra = extra[4 + length :]
        members[name] = Member(name, method, full, packed, crc, header_at)
        at += 46 + n_name + n_extra + n_comment
    return members


def stored_at(source, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is not stored")
    head = source.read_at(30, member.header_at)
    if head[:4] != _LOCAL:
        raise ValueError("no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header_at + 30 + n_name + n_extra


def record_bytes(url: str, page_id: int | None, payload: bytes, digest: str, revisit_of: int | None, kind: str) -> bytes:
    """One record as a gzip member.  A revisit has no block; both kinds carry the
    digest and the length of the full payload."""
    block = payload if kind == "response" else b""
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", WARC_DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if kind == "revisit":
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:page:{revisit_of}>"),
        ]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 3, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(fields, block) of a record read by its range."""
    plain = zlib.decompress(raw, 31)
    head, found, rest = plain.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record of another length than it says")
    return fields, block


def _page(urn: str | None) -> int | None:
    number = urn[len("<urn:page:") : -1] if urn else ""
    return int(number) if number else None


def write_packages(pages: DataFrame, folder: str, smallest: int = SMALLEST_REVISITED) -> DataFrame:
    """Write a record for each row of `pages` (page_id, url, html); returns the
    written list of packages: name, n_records.

    Of records with equal payloads of at least `smallest` bytes that with the
    largest page_id is a response and the others revisit it.  A null html is an
    empty payload, a null url an empty one (line breaks in urls become spaces).
    Rows with the largest id of their payload that repeat are all responses, and
    a null page_id counts as smallest.  An empty table writes no package.
    Other columns are ignored."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"),
        payload.alias("html"),
        F.unhex(F.sha1(payload.cast("binary"))).alias("sha1"),
    )
    shared = (
        rows.where(F.octet_length("html") >= smallest)
        .groupBy("sha1")
        .agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 AND response_id IS NOT NULL")
        .select("sha1", "response_id")
    )
    typed = rows.join(small_side(settled(shared)), "sha1", "left").select(
        "page_id",
        "url",
        "html",
        F.when(F.col("response_id").isNull() | F.col("page_id").eqNullSafe(F.col("response_id")), F.lit(None))
        .otherwise(F.col("response_id"))
        .alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        index: list[bytes] = []
        size = number = 0

        def close() -> pa.RecordBatch:
            package = zip_bytes([(ARCHIVE, records), (INDEX, index)], zip64=True)
            name = write_new(folder, f"pages-{task_number():06d}-{number:05d}", ".wacz", package)
            out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(records)])], ["name", "n_records"])
            records.clear(), index.clear()
            return out

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                payload = html.encode("utf-8", "surrogatepass")
                kind = "response" if refers_to is None else "revisit"
                record = record_bytes(url, page_id, payload, digest_of(payload), refers_to, kind)
                place = {"url": url, "offset": size, "length": len(record), "type": kind}
                index.append(f"{'' if page_id is None else page_id} {json.dumps(place)}\n".encode())
                records.append(record)
                size += len(record)
                if size >= PACKAGE_BYTES:
                    yield close()
                    number, size = number + 1, 0
        if records:
            yield close()

    return settled(typed.mapInArrow(write, "name string, n_records long"))


def read_index(packages: DataFrame, folder: str) -> DataFrame:
    """Where the records of the listed packages are, in ranges of some records:
    name, and lists of offset (in the package) and length."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = located(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{path}/{name}") as source:
                    members = zip_members(source, source.size())
                    archive, index = members[ARCHIVE], members[INDEX]
                    begin = stored_at(source, archive)
                    listed = source.read_at(index.size, stored_at(source, index))
                places = [json.loads(line.split(" ", 1)[1]) for line in listed.decode().split("\n") if line]
                for i in range(0, len(places), RECORDS_AT_ONCE):
                    some = places[i : i + RECORDS_AT_ONCE]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name]),
                            pa.array([[begin + p["offset"] for p in some]], pa.list_(pa.int64())),
                            pa.array([[p["length"] for p in some]], pa.list_(pa.int64())),
                        ],
                        ["name", "offsets", "lengths"],
                    )

    named = packages.select("name").repartition(partitions(packages.sparkSession), "name")
    return named.mapInArrow(read, "name string, offsets array<long>, lengths array<long>")


def read_records(spark: SparkSession, packages: DataFrame, folder: str) -> DataFrame:
    """The records of the listed packages, each read by its range: page_id, url,
    record_type, payload_bytes, payload_digest, refers_to and payload (null for
    revisits).  A response whose digest does not fit its payload is an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = located(folder)
        for batch in batches:
            for name, offsets, lengths in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows = []
                with system.open_input_file(f"{path}/{name}") as source:
                    for offset, length in zip(offsets, lengths):
                        fields, block = parse_record(source.read_at(length, offset))
                        kind = fields["WARC-Type"]
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and digest != digest_of(block):
                            raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
                        rows.append(
                            (
                                _page(fields["WARC-Record-ID"]),
                                fields["WARC-Target-URI"],
                                kind,
                                int(fields["X-Payload-Length"]),
                                digest,
                                _page(fields.get("WARC-Refers-To")),
                                block if kind == "response" else None,
                            )
                        )
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    ranges = read_index(packages, folder).repartition(partitions(spark) * 2, "name", "offsets")
    return ranges.mapInArrow(read, schema)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write `pages` to packages in a new folder and read the records back."""
    folder = scratch_path(pages.sparkSession)
    packages = write_packages(pages, folder)
    return read_records(pages.sparkSession, packages, folder)
