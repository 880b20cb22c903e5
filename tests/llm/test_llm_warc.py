"""ZIP-packaged archives: round trips, ZIP64, foreign and broken packages."""

import base64
import hashlib
import io
import struct
import zipfile
from pathlib import Path

import pyarrow as pa
import pytest

from llm_fixtures import frame, odd_rows, words  # noqa: F401
from stratus.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, salt long, payload string, first long"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute(rows):
    least = {}
    for i, _, html, *_ in rows:
        if i is not None:
            least[html or ""] = min(i, least.get(html or "", i))
    out = []
    for i, url, html, *_ in rows:
        first = least.get(html or "")
        revisit = first is not None and i != first
        out.append((i, len((html or "").encode()), sha(html), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def found(df):
    assert df.where("problem IS NOT NULL").count() == 0
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


@pytest.mark.parametrize(("package_bytes", "range_bytes"), [(1, 1), (2000, 900), (warc.PACKAGE_BYTES, warc.RANGE_BYTES)])
def test_round_trip_of_odd_pages(frame, odd_rows, package_bytes, range_bytes):  # noqa: F811
    rows = [(i, None if k % 3 else "http://ü.x/\r\nWARC-Type: fake", t, "d", 1, "p", 5) for k, (i, t) in enumerate(odd_rows)]
    rows += [(50 + i, "u", "same\r\n\r\nbody", "d", 1, "p", 5) for i in range(40)] + [(50, "u", "same\r\n\r\nbody", "d", 1, "p", 5)]
    packages = warc.write_archives(frame(rows, SCHEMA), package_bytes=package_bytes)
    got = warc.read_archives(packages, range_bytes)
    assert found(got) == brute(rows)
    texts = {(r.page_id, bytes(r.payload).decode()) for r in got.where("record_type = 'response'").collect()}
    want = {(i, h or "") for i, _, h, *_ in rows}
    assert texts <= want and {t for _, t in texts} == {t for _, t in want}
    assert got.where("record_type = 'revisit' AND payload IS NOT NULL").count() == 0
    assert {r.url for r in got.where("url IS NOT NULL").collect()} == {"http://%C3%BC.x/%0D%0AWARC-Type:%20fake", "u"}


def test_empty_table(frame):  # noqa: F811
    assert warc.archived_pages(frame([], SCHEMA)).count() == 0


def test_packages_are_zip_files_that_others_read(frame):  # noqa: F811
    packages = warc.write_archives(frame([(i, "u", f"t{i}", "", 0, "", 0) for i in range(9)], SCHEMA)).collect()
    names = 0
    for p in packages:
        with zipfile.ZipFile(p.package.removeprefix("file://")) as z:
            assert z.namelist() == [warc.ARCHIVE, warc.INDEX] and z.testzip() is None
            names += z.read(warc.INDEX).count(b"\n")
    assert names == 9 == sum(p.records for p in packages)


def _record(i, html):
    return warc.record_bytes(i, "u", html.encode(), sha(html), len(html.encode()), None)


def test_foreign_packages(spark, tmp_path):
    """Without an index, without ZIP64, with comment and other members; compressed members are problems."""
    plain = tmp_path / "plain.zip"
    with zipfile.ZipFile(plain, "w", zipfile.ZIP_STORED) as z:
        z.comment = b"PK\x05\x06 a comment with a signature"
        z.writestr("pages/pages.jsonl", "{}")
        z.writestr("archive/a.warc.gz", b"".join(_record(i, f"text {i}") for i in range(30)))
        z.writestr("archive/empty.warc.gz", b"")
    packed = tmp_path / "packed.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc.gz", _record(1, "x"))
    (tmp_path / "cut.zip").write_bytes(plain.read_bytes()[:300])
    (tmp_path / "nothing.zip").write_bytes(b"")
    got = warc.read_archives(spark.createDataFrame([(str(p),) for p in sorted(tmp_path.glob("*.zip"))], "package string")).collect()
    assert sorted(r.page_id for r in got if r.problem is None) == list(range(30))
    assert sorted(r.problem for r in got if r.problem) == ["archive/a.warc.gz: compressed by the package", "no end of central directory",
                                                          "no end of central directory"]


def test_broken_records_are_problems(spark, tmp_path):
    good, bad = _record(1, "fine"), bytearray(_record(2, "broken"))
    bad[40] ^= 255
    wrong = warc.record_bytes(3, "u", b"abc", sha("other"), 3, None)
    writer = io.BytesIO()
    package = warc.PackageWriter(writer)
    package.begin(warc.ARCHIVE)
    lines = [b'x {"filename":"%s","offset":%d,"length":%d}\n' % (warc.ARCHIVE.encode(), package.write(r), len(r)) for r in (good, bytes(bad), wrong)]
    package.end()
    package.begin(warc.INDEX)
    for line in lines:
        package.write(line)
    package.end()
    package.close()
    path = Path(tmp_path / "p.wacz")
    path.write_bytes(writer.getvalue())
    got = warc.read_archives(spark.createDataFrame([(str(path),)], "package string")).collect()
    assert [r.page_id for r in got if r.problem is None] == [1] and len(got) == 3
    assert any(r.problem == "payload does not match its digest" for r in got)


class _Sparse:
    """A package whose archive member is 5 GB of nothing, without writing it."""

    def __init__(self, gap):
        name = b"archive/big.warc.gz"
        extra = struct.pack("<HHQQ", 1, 16, gap, gap)
        self.head = struct.pack("<IHHHHHIIIHH", warc.LOCAL, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra)) + name + extra
        second = len(self.head) + gap
        small = b"indexes/index.cdxj"
        local = struct.pack("<IHHHHHIIIHH", warc.LOCAL, 45, 0, 0, 0, 0, 0, 3, 3, len(small), 0) + small + b"abc"

        def central(n, size, at, extra):
            full = 0xFFFFFFFF
            return struct.pack("<IHHHHHHIIIHHHHHII", warc.CENTRAL, 45, 45, 0, 0, 0, 0, 0, min(size, full), min(size, full), len(n), len(extra),
                               0, 0, 0, 0, min(at, full)) + n + extra
        directory = central(name, gap, 0, struct.pack("<HHH", 99, 2, 0) + struct.pack("<HHQQ", 1, 16, gap, gap))
        directory += central(small, 3, second, struct.pack("<HHQ", 1, 8, second))
        start = second + len(local)
        tail = struct.pack("<IQHHIIQQQQ", warc.END64, 44, 45, 45, 0, 0, 2, 2, len(directory), start)
        tail += struct.pack("<IIQI", warc.LOCATOR, 0, start + len(directory), 1)
        tail += struct.pack("<IHHHHIIH", warc.END, 0, 0, 2, 2, len(directory), 0xFFFFFFFF, 0)
        self.parts = [(0, self.head), (second, local + directory + tail)]
        self.size, self.second = second + len(local + directory + tail), second

    def read_at(self, n, at):
        return b"".join(bytes(1) if not any(s <= i < s + len(p) for s, p in self.parts)
                        else next(p[i - s:i - s + 1] for s, p in self.parts if s <= i < s + len(p)) for i in range(at, min(at + n, self.size)))


def test_zip64_sizes_and_offsets_beyond_four_gigabytes():
    file = _Sparse(5 << 30)
    first, second = warc.package_members(file, file.size)
    assert (first["size"], first["data_at"]) == (5 << 30, len(file.head))
    assert second["data_at"] == file.second + 30 + len("indexes/index.cdxj") and file.read_at(3, second["data_at"]) == b"abc"


def test_many_members(tmp_path):
    """More members than the 16-bit count holds."""
    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(66_000):
            z.writestr(f"m{i}", b"")
    with pa.fs.LocalFileSystem().open_input_file(str(path)) as file:
        names = [m["name"] for m in warc.package_members(file, file.size())]
    assert len(names) == 66_000 and names[-1] == "m65999"
