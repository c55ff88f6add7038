"""WARC records in ZIP packages: writing, and range reads without extraction.

A package holds two stored members, a WARC file of one gzip member per record
and an index of their places. Writers stream records into the package, so a
task holds one record at a time; a package is closed at a bounded size. Readers
parse the central directory from the end of the package (ZIP64 records
included), find the stored members, range-read the index and then each record.
Nothing is unpacked to disk.

Packages go to a shared folder through ``pyarrow.fs``. A task that runs again
writes under a new name, and only packages named in the written manifest are
read, so a lost executor leaves unread files at worst.

Defined results: null html is an empty payload, null urls get a placeholder;
rows that repeat a page id and payload have the same type; a page without an id
is never referred to; an empty table makes no package and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.session import ensure_checkpoint_dir, settle

MIN_SHARED_BYTES = 1000
PACKAGE_BYTES = 64 << 20
WARC_MEMBER = "archive/data.warc.gz"
INDEX_MEMBER = "indexes/index.cdxj"
WARC_DATE = "2000-01-01T00:00:00Z"

# Signatures and sizes of the ZIP format.
END, END_SIZE = b"PK\x05\x06", 22
END64, END64_SIZE = b"PK\x06\x06", 56
LOCATOR, LOCATOR_SIZE = b"PK\x06\x07", 20
ENTRY, ENTRY_SIZE = b"PK\x01\x02", 46
LOCAL_SIZE = 30
ZIP64_FIELD = 0x0001
MAX_COMMENT = 0xFFFF


def shared_store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a shared folder."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    if "://" not in folder:
        return pafs.LocalFileSystem(), folder
    return pafs.FileSystem.from_uri(folder)


# Writing


def planned(pages: DataFrame, id_column: str, url: str, html: str) -> DataFrame:
    """Pages with payload size, digest, record type and the page referred to."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("size"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )
    # Only shared payloads; combined before the shuffle.
    shared = (
        rows.filter(F.col("size") >= MIN_SHARED_BYTES)
        .groupBy("digest", "size")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null")
        .select("digest", "size", "first")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return rows.join(shared, ["digest", "size"], "left").select(
        "page_id",
        "url",
        "digest",
        F.when(F.col("first").isNotNull(), refers).alias("refers_to"),
        "payload",
    )


def record_name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, digest: str, refers_to: int | None, payload: bytes) -> bytes:
    """One WARC record; a revisit has the headers of the response and no payload."""
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else "urn:x-page:none"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        block += payload
    encoded = base64.b32encode(bytes.fromhex(digest)).decode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_name(page_id, digest)),
        ("WARC-Date", WARC_DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{encoded}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_name(refers_to, digest)),
            ("X-Refers-To-Page", str(refers_to)),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class Package:
    """A package being written."""

    def __init__(self, folder: str) -> None:
        store, path = shared_store(folder)
        self.path = f"{path}/{uuid.uuid4()}.wacz"
        self.sink = store.open_output_stream(self.path)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True)
        self.index: list[str] = []
        self.size = 0

    def add(self, page_id: int | None, record: bytes) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.member.write(packed)
        place = json.dumps({"offset": self.size, "length": len(packed)})
        self.index.append(f"{'-' if page_id is None else page_id} {place}")
        self.size += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX_MEMBER), "\n".join(self.index))
        self.zip.close()
        self.sink.close()
        return self.path, len(self.index)


def writer(folder: str, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package: Package | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, digest, refers_to, payload = (c[i].as_py() for c in batch.columns)
                package = package or Package(folder)
                package.add(page_id, record_bytes(page_id, url, digest, refers_to, payload.encode()))
                if package.size >= limit:
                    yield manifest_row(*package.close())
                    package = None
        if package:
            yield manifest_row(*package.close())

    return write


def manifest_row(path: str, records: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64())], ["path", "records"])


def write_packages(
    pages: DataFrame,
    folder: str | None = None,
    id_column: str = "page_id",
    url: str = "url",
    html: str = "html",
    limit: int = PACKAGE_BYTES,
) -> DataFrame:
    """Write all pages; the written manifest (path, records) names the finished packages."""
    folder = f"{folder or ensure_checkpoint_dir(pages.sparkSession)}/packages-{uuid.uuid4()}"
    store, path = shared_store(folder)
    store.create_dir(path)
    rows = planned(pages, id_column, url, html)
    return settle(rows.mapInArrow(writer(folder, limit), "path string, records long"))


# Reading


@dataclass(frozen=True)
class Member:
    name: str
    offset: int
    size: int


def read_range(source: pa.NativeFile, offset: int, size: int) -> bytes:
    source.seek(offset)
    data = source.read(size)
    if len(data) != size:
        raise ValueError(f"package ends at {offset + len(data)}, {offset + size} expected")
    return data


def directory_place(source: pa.NativeFile, total: int) -> tuple[int, int, int]:
    """Offset, size and entry count of the central directory, from the end of the package."""
    low = max(0, total - END_SIZE - MAX_COMMENT - LOCATOR_SIZE)
    tail = read_range(source, low, total - low)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("not a ZIP package: no end record")
    count, size, offset = struct.unpack_from("<10xHII", tail, at)
    locator = at - LOCATOR_SIZE
    if locator >= 0 and tail[locator : locator + 4] == LOCATOR:
        (place,) = struct.unpack_from("<8xQ", tail, locator)
        record = read_range(source, place, END64_SIZE)
        if record[:4] != END64:
            raise ValueError("damaged ZIP64 end record")
        count, size, offset = struct.unpack_from("<32xQQQ", record)
    return offset, size, count


def wide_values(extra: bytes, values: list[int]) -> list[int]:
    """Sizes and offset with those that were too large taken from the ZIP64 field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == ZIP64_FIELD:
            wide = list(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [wide.pop(0) if v == 0xFFFFFFFF and wide else v for v in values]
        at += 4 + size
    return values


def members(source: pa.NativeFile, total: int) -> list[Member]:
    """Stored members with the place of their data."""
    offset, size, count = directory_place(source, total)
    directory = read_range(source, offset, size)
    out, at = [], 0
    for _ in range(count):
        if directory[at : at + 4] != ENTRY:
            raise ValueError("damaged central directory")
        method, packed, plain, n_name, n_extra, n_comment, local = struct.unpack_from(
            "<10xH8xIIHHH8xI", directory, at
        )
        name = directory[at + ENTRY_SIZE : at + ENTRY_SIZE + n_name].decode("utf-8", "replace")
        extra = directory[at + ENTRY_SIZE + n_name : at + ENTRY_SIZE + n_name + n_extra]
        plain, packed, local = wide_values(extra, [plain, packed, local])
        at += ENTRY_SIZE + n_name + n_extra + n_comment
        if method == 0:
            own_name, own_extra = struct.unpack_from("<26xHH", read_range(source, local, LOCAL_SIZE))
            out.append(Member(name, local + LOCAL_SIZE + own_name + own_extra, packed))
    return out


def index_ranges(source: pa.NativeFile, total: int) -> Iterator[tuple[int, int]]:
    """(offset in the package, length) of every record that the index names."""
    found = {m.name: m for m in members(source, total)}
    warc, index = found[WARC_MEMBER], found[INDEX_MEMBER]
    for line in read_range(source, index.offset, index.size).splitlines():
        place = json.loads(line.partition(b" ")[2])
        yield warc.offset + place["offset"], place["length"]


RANGE = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def ranges_in(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _path = shared_store(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                total = store.get_file_info(path).size
                with store.open_input_file(path) as source:
                    places = list(index_ranges(source, total))
                yield pa.RecordBatch.from_pydict(
                    {
                        "path": [path] * len(places),
                        "offset": [p[0] for p in places],
                        "length": [p[1] for p in places],
                    },
                    schema=RANGE,
                )

    return find


RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("digest", pa.string()),
        ("size", pa.int64()),
        ("url", pa.string()),
        ("payload", pa.binary()),
    ]
)


def parsed(record: bytes) -> dict[str, object]:
    """Headers and payload of a record; the digest of a response is taken from its payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    named = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    response = fields["WARC-Type"] == "response"
    if response and hashlib.sha1(payload).hexdigest() != named:
        raise ValueError(f"damaged payload in {fields['WARC-Record-ID']}")
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
    return {
        "page_id": None if page is None else int(page),
        "record_type": fields["WARC-Type"],
        "refers_to": None if refers is None else int(refers),
        "digest": named,
        "size": len(payload) if response else None,
        "url": fields["WARC-Target-URI"],
        "payload": payload if response else None,
    }


def records_in(folder: str, payloads: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _path = shared_store(folder)
        opened: tuple[str, pa.NativeFile] | None = None
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                out = []
                part = batch.slice(low, 256)
                for path, offset, length in zip(*(c.to_pylist() for c in part.columns)):
                    if opened is None or opened[0] != path:
                        if opened:
                            opened[1].close()
                        opened = (path, store.open_input_file(path))
                    row = parsed(zlib.decompress(read_range(opened[1], offset, length), 31))
                    out.append(row if payloads else row | {"payload": None})
                yield pa.RecordBatch.from_pylist(out, schema=RECORD)
        if opened:
            opened[1].close()

    return read


def read_packages(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the manifest's packages, each read by its range.

    Ranges are dealt out evenly, so one large package is read by many tasks.
    """
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = manifest.select("path").repartition(n, "path").mapInArrow(
        ranges_in(folder), "path string, offset long, length long"
    )
    dealt = ranges.repartition(n, "path", F.floor(F.col("offset") / (1 << 22))).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(
        records_in(folder, payloads),
        "page_id long, record_type string, refers_to long, digest string, size long, url string, payload binary",
    )


def resolved(records: DataFrame) -> DataFrame:
    """Records with the full payload's size also for revisits, from the response they refer to."""
    rows = settle(records.select("page_id", "record_type", "refers_to", "digest", "size"))
    sizes = (
        rows.filter("record_type = 'response' and page_id is not null")
        .groupBy(F.col("page_id").alias("refers_to"), "digest")
        .agg(F.max("size").alias("full"))
    )
    return rows.join(sizes, ["refers_to", "digest"], "left").select(
        "page_id", F.coalesce("size", "full").alias("size"), "digest", "record_type", "refers_to"
    )
