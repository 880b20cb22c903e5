"""Web archives in ZIP packages: writing them, and range-reading their records.

A package is a ZIP file of stored members: ``archive/data.warc.gz``, whose records are
compressed one by one, and ``indexes/index.cdxj`` with a line per record.  Nothing is ever
extracted: the reader

1. parses the tail of each package: end of central directory, ZIP64 locator and record,
   then the central directory, and takes sizes and offsets from the ZIP64 extra fields
   where the 32-bit ones are full; a member's data starts after its local header;
2. reads the index members by byte range, and splits the records that they list into
   ranges of about ``RANGE_BYTES``, which Spark deals out;
3. reads each range with one request and opens its records.

An archive member without an index is read from its start, record after record.
Members that are compressed by the ZIP itself can't be range-read; they are listed as
problems, as are packages without a readable directory, and the others are read.

Of records with equal payloads the one with the smallest page id is written as a response,
the others as revisits of it, which carry digest and length but no payload.  The smallest
id of a digest is found and sent back per (digest, salt), so that a payload that a third of
all pages share is no hot key.

Packages of a lost or repeated task count only if Spark committed the task: readers take
their list from a written table, not from the folder.

Defined results: a null payload is empty; a null URL is no header; a row without id is a
response only if no row of its payload has an id, and each such row is; so are rows that
repeat the smallest id; ``refers_to`` is null for responses; an empty table gives no
packages and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratus.llm.stores import filesystem
from stratus.session import materialize, scratch_path

#: Bytes of compressed records after which a package is closed, and bytes read at once.
PACKAGE_BYTES = 128 << 20
RANGE_BYTES = 8 << 20
#: Index lines read at once, in bytes.
INDEX_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Signatures of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR, DESCRIPTOR = (0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 0x08074B50)
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


# Packages -----------------------------------------------------------------------

class PackageWriter:
    """Streams stored members into a ZIP with ZIP64 records throughout."""

    def __init__(self, out):
        self.out, self.at, self.members = out, 0, []

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append([raw, self.at, 0, 0])
        # Sizes follow the data (flag 3); names are UTF-8 (flag 11).
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self._write(struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x808, 0, 0, 0x21, 0, FULL32, FULL32, len(raw), len(extra)) + raw + extra)

    def write(self, raw: bytes) -> int:
        """Offset of ``raw`` in the member begun last."""
        member = self.members[-1]
        offset = member[2]
        member[2] += len(raw)
        member[3] = zlib.crc32(raw, member[3])
        self._write(raw)
        return offset

    def end(self) -> None:
        _, _, size, crc = self.members[-1]
        self._write(struct.pack("<IIQQ", DESCRIPTOR, crc, size, size))

    def close(self) -> None:
        start = self.at
        for name, offset, size, crc in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset)
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x808, 0, 0, 0x21, crc, FULL32, FULL32, len(name),
                                    len(extra), 0, 0, 0, 0, FULL32) + name + extra)
        end, n = self.at, len(self.members)
        self._write(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, end - start, start))
        self._write(struct.pack("<IIQI", LOCATOR, 0, end, 1))
        self._write(struct.pack("<IHHHHIIH", END, 0, 0, min(n, FULL16), min(n, FULL16), FULL32, FULL32, 0))


class NotAPackage(ValueError):
    """The file has no readable ZIP directory."""


def _read(file, at: int, size: int) -> bytes:
    raw = file.read_at(size, at)
    if len(raw) != size:
        raise NotAPackage(f"{size} bytes expected at {at}, {len(raw)} there")
    return raw


def _directory_place(file, size: int) -> tuple[int, int, int]:
    """(offset, bytes, entries) of the central directory."""
    span = min(size, 22 + FULL16)
    tail = _read(file, size - span, span)
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0:      # the signature may also occur in the comment
        if at + 22 <= span and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == span:
            break
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise NotAPackage("no end of central directory")
    _, _, _, _, entries, length, offset, _ = struct.unpack_from("<IHHHHIIH", tail, at)
    place = size - span + at
    if FULL16 in (entries,) or FULL32 in (length, offset):
        if place < 20:
            raise NotAPackage("no ZIP64 locator")
        signature, _, record, _ = struct.unpack("<IIQI", _read(file, place - 20, 20))
        if signature != LOCATOR:
            raise NotAPackage("no ZIP64 locator")
        fields = struct.unpack("<IQHHIIQQQQ", _read(file, record, 56))
        if fields[0] != END64:
            raise NotAPackage("no ZIP64 end of central directory")
        entries, length, offset = fields[7], fields[8], fields[9]
    return offset, length, entries


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Full 32-bit fields replaced, in order, by those of the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            return [next(wide, v) if v == FULL32 else v for v in values]
        at += 4 + length
    return values


def package_members(file, size: int) -> Iterator[dict]:
    """name, method, size and data offset of each member, from the central directory.

    The directory is read in blocks: its length is not bounded by the format.
    """
    at, length, entries = _directory_place(file, size)
    end, block, base = at + length, b"", at
    for _ in range(entries):
        while True:
            have = len(block) - (at - base)
            need = 46
            if have >= 46:
                lengths = struct.unpack_from("<HHH", block, at - base + 28)
                need = 46 + sum(lengths)
            if have >= need:
                break
            if at + need > end:
                raise NotAPackage("central directory is cut short")
            block, base = _read(file, at, min(max(need, 1 << 16), end - at)), at
        entry = struct.unpack_from("<IHHHHHHIIIHHHHHII", block, at - base)
        if entry[0] != CENTRAL:
            raise NotAPackage("broken central directory")
        name_length, extra_length = entry[10], entry[11]
        where = at - base + 46
        name = block[where:where + name_length].decode("utf-8", "replace")
        # ZIP64 fields stand in this order: plain size, stored size, offset.
        plain, stored, offset = _wide(block[where + name_length:where + name_length + extra_length], [entry[9], entry[8], entry[16]])
        local = struct.unpack("<IHHHHHIIIHH", _read(file, offset, 30))
        if local[0] != LOCAL:
            raise NotAPackage(f"no local header for {name}")
        yield {"name": name, "method": entry[4], "size": stored, "data_at": offset + 30 + local[9] + local[10]}
        at += need


# Records ------------------------------------------------------------------------

def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None,
                 date: str = DATE) -> bytes:
    """One compressed WARC record: a response, or a revisit if it refers to another page."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {refers_to}')}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _fields(raw: bytes) -> dict[str, str]:
    lines = raw.split(b"\r\n")
    pairs = (line.split(b":", 1) for line in lines[1:] if b":" in line)
    return {k.strip().lower().decode("utf-8", "replace"): v.strip().decode("utf-8", "replace") for k, v in pairs}


def parse_record(raw: bytes) -> dict:
    """The record in ``raw`` (uncompressed): its type, ids, payload; ValueError if it is broken."""
    cut = raw.find(b"\r\n\r\n")
    if cut < 0 or not raw.startswith(b"WARC/"):
        raise ValueError("no WARC header")
    head = _fields(raw[:cut])
    body = raw[cut + 4:cut + 4 + int(head.get("content-length", "-1"))]
    if len(body) != int(head.get("content-length", "-1")):
        raise ValueError("record is cut short")
    http, _, payload = body.partition(b"\r\n\r\n")
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = head.get("warc-type", "")
    if kind == "revisit":
        length, payload = int(_fields(http).get("content-length", "0")), None
    else:
        length = len(payload)
        if digest != base32_sha1(payload):
            raise ValueError("payload does not match its digest")
    number = {k: int(head[k]) if k in head else None for k in ("page-id", "refers-to-page-id")}
    return {"page_id": number["page-id"], "url": head.get("warc-target-uri"), "record_type": kind, "payload": payload,
            "payload_bytes": length, "payload_digest": digest, "refers_to": number["refers-to-page-id"], "problem": None}


RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
                    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("problem", pa.string())])
RECORD_DDL = ("page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, "
              "refers_to long, problem string")


# Writing ------------------------------------------------------------------------

def with_originals(pages: DataFrame, salts: int) -> DataFrame:
    """``page_id, url, payload, digest, first``: the smallest page id of each payload (by the hex
    of its SHA-1) beside its rows."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = (rows.withColumn("digest", F.sha1("payload"))
            .withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts))))
    per_salt = materialize(rows.groupBy("digest", "salt").agg(F.min("page_id").alias("least")), "payload-digests")
    whole = per_salt.groupBy("digest").agg(F.min("least").alias("first"))
    return rows.join(per_salt.join(whole, "digest").drop("least"), ["digest", "salt"]).drop("salt")


def _write(folder: str, package_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        open_one = None

        def close():
            writer, out, lines, name, count = open_one
            writer.end()
            writer.begin(INDEX)
            for line in lines:
                writer.write(line)
            writer.end()
            writer.close()
            out.close()
            return pa.RecordBatch.from_pydict({"package": [f"{folder}/{name}"], "bytes": [writer.at], "records": [count]})

        for batch in batches:
            for page_id, url, payload, digest, first in zip(*(batch.column(batch.schema.get_field_index(c)) for c in (
                    "page_id", "url", "payload", "digest", "first"))):
                if open_one is None:
                    fs.create_dir(path, recursive=True)
                    name = f"{os.urandom(12).hex()}.wacz"
                    out = fs.open_output_stream(f"{path}/{name}")
                    writer = PackageWriter(out)
                    writer.begin(ARCHIVE)
                    open_one = [writer, out, [], name, 0]
                page, least, body = page_id.as_py(), first.as_py(), payload.as_py()
                refers = least if least is not None and page != least else None
                sha1 = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                raw = record_bytes(page, url.as_py(), body, sha1, len(body), refers, date)
                at = open_one[0].write(raw)
                line = {"filename": ARCHIVE, "offset": at, "length": len(raw), "digest": sha1, "page_id": page}
                open_one[2].append(json.dumps(line, separators=(",", ":")).encode() + b"\n")
                open_one[4] += 1
                if at + len(raw) >= package_bytes:
                    yield close()
                    open_one = None
        if open_one is not None:
            yield close()
    return run


def write_archives(pages: DataFrame, folder: str | None = None, package_bytes: int = PACKAGE_BYTES, date: str = DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as packages; a written table of ``package, bytes, records``."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "archives")
    rows = with_originals(pages, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return materialize(rows.mapInArrow(_write(folder, package_bytes, date), "package string, bytes long, records long"), "packages")


# Reading ------------------------------------------------------------------------

def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("package", pa.string()), ("name", pa.string()), ("method", pa.int64()), ("size", pa.int64()),
                        ("data_at", pa.int64()), ("problem", pa.string())])
    for batch in batches:
        for package in batch.column(0).to_pylist():
            found = []
            try:
                fs, path = filesystem(package)
                with fs.open_input_file(path) as file:
                    for member in package_members(file, file.size()):
                        found.append({"package": package, **member, "problem": None})
                        if len(found) >= 10_000:
                            yield pa.RecordBatch.from_pylist(found, schema)
                            found = []
            except (NotAPackage, OSError, struct.error) as error:
                found.append({"package": package, "name": None, "method": None, "size": None, "data_at": None, "problem": str(error)})
            if found:
                yield pa.RecordBatch.from_pylist(found, schema)


def package_directory(packages: DataFrame) -> DataFrame:
    """``package, name, method, size, data_at, problem`` of the members of ``packages`` (package)."""
    return packages.select("package").mapInArrow(
        _members, "package string, name string, method long, size long, data_at long, problem string")


def _ranges(range_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Index members -> byte ranges of neighbouring records, with the records' edges."""
        for batch in batches:
            for package, size, data_at in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist()
                                                for c in ("package", "size", "data_at"))):
                fs, path = filesystem(package)
                with fs.open_input_file(path) as file:
                    at, rest, name, edges = 0, b"", None, []
                    while at < size or rest:
                        block = file.read_at(min(INDEX_BYTES, size - at), data_at + at) if at < size else b""
                        at += len(block)
                        lines = (rest + block).split(b"\n")
                        rest = lines.pop() if at < size else b""
                        for line in filter(None, lines):
                            entry = json.loads(line[line.index(b"{"):])
                            start, end = entry["offset"], entry["offset"] + entry["length"]
                            if edges and (entry["filename"] != name or start != edges[-1] or end - edges[0] > range_bytes):
                                yield pa.RecordBatch.from_pydict({"package": [package], "name": [name], "edges": [edges]})
                                edges = []
                            if not edges:
                                name, edges = entry["filename"], [start]
                            edges.append(end)
                    if edges:
                        yield pa.RecordBatch.from_pydict({"package": [package], "name": [name], "edges": [edges]})
    return run


def _opened(raw: bytes) -> dict:
    try:
        return parse_record(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)
    except (ValueError, zlib.error) as error:
        return dict.fromkeys(RECORD.names) | {"problem": str(error)}


def _batched(records: Iterator[dict], payloads: bool, bytes_at_once: int = RANGE_BYTES) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for record in records:
        if not payloads:
            record["payload"] = None
        held.append(record)
        size += len(record["payload"] or b"") + 200
        if size >= bytes_at_once:
            yield pa.RecordBatch.from_pylist(held, RECORD)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, RECORD)


def _read_ranges(payloads: bool):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = filesystem(row["package"])
                edges = row["edges"]
                with fs.open_input_file(path) as file:
                    raw = file.read_at(edges[-1] - edges[0], row["data_at"] + edges[0])
                for start, end in zip(edges, edges[1:]):
                    yield _opened(raw[start - edges[0]:end - edges[0]])
    return lambda batches: _batched(records(batches), payloads)


def _sequential(file, at: int, size: int) -> Iterator[bytes]:
    """Uncompressed records of a member without an index, one compressed unit after the other."""
    end, raw = at + size, b""
    unit, out = zlib.decompressobj(31), []
    while at < end or raw:
        if not raw:
            raw = file.read_at(min(1 << 20, end - at), at)
            at += len(raw)
            if not raw:
                break
        out.append(unit.decompress(raw))
        raw = unit.unused_data if unit.eof else b""
        if unit.eof:
            yield b"".join(out)
            unit, out = zlib.decompressobj(31), []
    if out and any(out):
        yield b"".join(out)


def _read_members(payloads: bool):
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = filesystem(row["package"])
                with fs.open_input_file(path) as file:
                    try:
                        for raw in _sequential(file, row["data_at"], row["size"]):
                            yield _opened(raw)
                    except zlib.error as error:
                        yield dict.fromkeys(RECORD.names) | {"problem": str(error)}
    return lambda batches: _batched(records(batches), payloads)


def read_archives(packages: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The records of ``packages`` (a column ``package`` of paths), whatever wrote them.

    ``page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to, problem``;
    ``problem`` says what is wrong with a package, member or record, whose other columns are
    then null.  Revisits have no payload; bytes and digest are those of the full one.  Without
    ``payloads`` they are read and checked all the same, and the column is null.
    """
    spark = packages.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    members = materialize(package_directory(packages.repartition(tasks)), "package-members")
    stored = members.where("problem IS NULL AND method = 0")
    archives = stored.where("name LIKE 'archive/%'")
    ranges = materialize(stored.where("name LIKE 'indexes/%' AND name LIKE '%.cdxj'").repartition(tasks).mapInArrow(
        _ranges(range_bytes), "package string, name string, edges array<long>"), "record-ranges")
    placed = ranges.join(archives.select("package", "name", "data_at"), ["package", "name"])
    by_range = placed.repartition(tasks).mapInArrow(_read_ranges(payloads), RECORD_DDL)
    unlisted = archives.join(ranges.select("package", "name").distinct(), ["package", "name"], "left_anti").where("size > 0")
    by_member = unlisted.repartition(tasks).mapInArrow(_read_members(payloads), RECORD_DDL)
    packed = F.when(F.col("problem").isNull(), F.concat(F.col("name"), F.lit(": compressed by the package"))).otherwise(F.col("problem"))
    bad = members.where("problem IS NOT NULL OR (method != 0 AND name LIKE 'archive/%')").select(
        *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in RECORD_DDL.split(", ")[:-1]], packed.alias("problem"))
    return by_range.unionByName(by_member).unionByName(bad)


def archived_pages(pages: DataFrame, package_bytes: int = PACKAGE_BYTES, payloads: bool = True) -> DataFrame:
    """Write ``pages`` and read the records back."""
    return read_archives(write_archives(pages, package_bytes=package_bytes), payloads=payloads)
