from __future__ import annotations

import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from vitrine.llm.archives import Package, members, read_packages, resolved, wide_values, write_packages

from .conftest import tuples


@pytest.fixture(scope="module")
def rows():
    big = "é" * 700
    out = [(i, f"http://x/{i}\r\n é", big) for i in range(30)]
    out += [(40, None, None), (41, "http://y", ""), (42, "u", "a" * 999), (43, "u", "a" * 999), (44, "u", "b\r\n\r\n" * 300)]
    out += [(45, "u", "c" * 1000), (46, "v", "c" * 1000), (45, "u", "c" * 1000), (None, "w", "c" * 1000), (50, "w", "x" * 300000)]
    return out


def brute(rows):
    payload = lambda r: (r[2] or "").encode()
    out = []
    for r in rows:
        p = payload(r)
        first = max((x[0] for x in rows if x[0] is not None and payload(x) == p), default=None)
        revisit = len(p) >= 1000 and first is not None and r[0] != first
        out.append((r[0], len(p), hashlib.sha1(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[3]))


@pytest.mark.parametrize("limit", [64 << 20, 5000])
def test_round_trip(spark, shared_folder, rows, limit):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = write_packages(pages, limit=limit)
    records = read_packages(manifest, shared_folder)
    found = tuples(resolved(records), "page_id", "size", "digest", "record_type", "refers_to")
    assert sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[3])) == brute(rows)
    html = {r[0]: (r[2] or "").encode() for r in rows}
    for r in records.filter("record_type = 'response' and page_id is not null").collect():
        assert bytes(r.payload) == html[r.page_id]


def test_other_zip_readers_agree(tmp_path):
    package = Package(str(tmp_path))
    package.add(1, b"record")
    path, count = package.close()
    assert count == 1
    with zipfile.ZipFile(path) as plain, pa.OSFile(path) as source:
        assert plain.testzip() is None
        for member in members(source, source.size()):
            source.seek(member.offset)
            assert source.read(member.size) == plain.read(member.name)


def test_zip64_directory(tmp_path):
    """More entries than the short end record can count."""
    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(66000):
            z.writestr(f"m{i}", b"x")
        z.comment = b"a comment at the end"
    with pa.OSFile(str(path)) as source:
        found = members(source, source.size())
    assert len(found) == 66000 and found[-1].name == "m65999" and found[-1].size == 1


def test_zip64_field():
    extra = b"\x09\x00\x02\x00zz" + b"\x01\x00\x10\x00" + (5 << 32).to_bytes(8, "little") + (6 << 32).to_bytes(8, "little")
    assert wide_values(extra, [7, 0xFFFFFFFF, 0xFFFFFFFF]) == [7, 5 << 32, 6 << 32]


def test_not_a_package():
    with pytest.raises(ValueError, match="no end record"):
        members(pa.PythonFile(io.BytesIO(b"x" * 100), "r"), 100)


def test_empty(spark, shared_folder):
    manifest = write_packages(spark.createDataFrame([], "page_id long, url string, html string"))
    assert manifest.collect() == []
    assert resolved(read_packages(manifest, shared_folder)).collect() == []
