"""Operator 8, WARC records in ZIP packages, read by range without extraction.

A package is a ZIP file whose members are stored, not compressed: `archive/data.warc.gz`, in which each record is a gzip
member of its own, and `indexes/index.cdx` with a line for each record (id, offset, length within the member). The reader
opens a package where it lies and reads ranges of it only: its end (with the ZIP64 end record where 32-bit fields are full),
the central directory, the members' local headers, the index, and the records that are asked for.

Packages are files in a folder that driver and executors share, opened through pyarrow's file systems (file, hdfs, s3, gs).
What Spark holds of them are rows: `write_packages` gives one a package, `read_index` one a record with its range, which may be filtered or
joined, and `read_ranges` the records. A task that runs again writes packages of new names, and the rows, which Spark commits
once, name those that count. Pages go to packages of about `per_package` records and at most `max_bytes`, whichever
is reached first; a record larger than that has a package of its own. Readers hold one index part or one run of ranges of
`READ_BYTES`, and a larger record by itself.

Defined cases: a null html is an empty payload. Of records with equal payloads of at least `least` bytes that with the
largest page_id is the response and others refer to it; a null page_id is the smallest. Rows repeated with that page_id
and payload are all responses. White space and control characters of a url are percent-encoded; a null url is empty. A very long
text is one record, as long as its task can hold it. An empty table gives no package. Other columns aren't read. A damaged package (bad
signature, compressed member, payload that fails its digest) raises an error that names it.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_BYTES = 1000
READ_BYTES = 1 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
PACKAGES = "package string, bytes long, records long"
RANGES = "package string, page_id long, at long, length long"
RECORDS = "package string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
NO_ID = "none"


# --- ZIP with stored members ------------------------------------------------------------------------------------------


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP of stored members; with zip64, all sizes and offsets are in ZIP64 fields, as they must be from 4 GiB."""
    out, directory = bytearray(), bytearray()
    for name, data in members:
        raw, at, crc = name.encode(), len(out), zlib.crc32(data)
        wide = zip64 or max(len(data), at) >= 0xFFFFFFFF
        size = 0xFFFFFFFF if wide else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if wide else b""
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if wide else b""
        directory += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF if wide else at) + raw + extra
    start, n = len(out), len(members)
    out += directory
    if zip64 or start >= 0xFFFFFFFF or n >= 0xFFFF:
        end = len(out)
        out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(directory), start) + struct.pack("<IIQI", 0x07064B50, 0, end, 1)
        out += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    else:
        out += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, len(directory), start, 0)
    return bytes(out)


def zip_directory(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int]]:
    """name -> (offset of the member's bytes, size) from the central directory of a ZIP of `size` bytes; read: (offset, n) -> bytes.

    Members must be stored.
    """
    low = max(0, size - 65557)
    tail = read(low, size - low)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = read(low + at - 20, 20) if low + at >= 20 else b""
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        end = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack_from("<QQQ", end, 32)
    directory, found, p = read(start, length), {}, 0
    for _ in range(n):
        sig, _, _, flags, method, _, _, _, packed, plain, n_name, n_extra, n_note, _, _, _, offset = struct.unpack_from("<IHHHHHHIIIHHHHHII", directory, p)
        if sig != 0x02014B50:
            raise ValueError("bad entry in the central directory")
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            kind, width = struct.unpack_from("<HH", extra, q)
            if kind == 1:  # ZIP64: those of the fields that are full, in this order
                fields = iter(struct.unpack_from(f"<{width // 8}Q", extra, q + 4))
                plain = next(fields) if plain == 0xFFFFFFFF else plain
                packed = next(fields) if packed == 0xFFFFFFFF else packed
                offset = next(fields) if offset == 0xFFFFFFFF else offset
            q += 4 + width
        if method != 0 or packed != plain:
            raise ValueError(f"{name} isn't stored")
        sig, n_name2, n_extra2 = struct.unpack_from("<I22xHH", read(offset, 30))
        if sig != 0x04034B50:
            raise ValueError(f"bad local header of {name}")
        found[name] = (offset + 30 + n_name2 + n_extra2, plain)
        p += 46 + n_name + n_extra + n_note
    return found


# --- WARC records -----------------------------------------------------------------------------------------------------


def warc_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit without it; a revisit keeps the HTTP header, with the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = NO_ID if page_id is None else page_id
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def plain_url(url: str | None) -> str:
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: quote(m[0]), url or "")


def parse_warc(record: bytes) -> dict:
    """Fields of RECORDS from the bytes of one record, as they are or in gzip; the payload's digest is computed, and checked against the header."""
    if record[:2] == b"\x1f\x8b":
        record = zlib.decompress(record, 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    page = fields["WARC-Record-ID"][len("<urn:page:") : -1]
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != said):
        raise ValueError(f"the payload of page {page} fails its digest")
    refers = fields.get("WARC-Refers-To")
    return {"page_id": None if page == NO_ID else int(page), "url": fields.get("WARC-Target-URI", ""), "record_type": kind, "refers_to": int(refers[len("<urn:page:") : -1]) if refers else None, "payload_bytes": size, "payload_digest": said, "payload": payload if kind == "response" else None}


def pack(records: Iterable[tuple], per_package: int, max_bytes: int) -> Iterator[tuple[int, bytes]]:
    """Packages (records, content) of records (page_id, url, payload, digest, refers_to)."""
    data, index, n = bytearray(), [], 0

    def close():
        return n, zip_stored([(DATA, bytes(data)), (INDEX, "".join(index).encode())])

    for page_id, url, payload, digest, refers_to in records:
        record = gzip.compress(warc_record(page_id, plain_url(url), payload, digest, refers_to), 6, mtime=0)
        if n and (n >= per_package or len(data) + len(record) > max_bytes):
            yield close()
            data, index, n = bytearray(), [], 0
        index.append(f"{NO_ID if page_id is None else page_id} {len(data)} {len(record)}\n")
        data += record
        n += 1
    if n:
        yield close()


def package_ranges(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple[int | None, int, int]]:
    """(page_id, offset in the package, length) of each record, from the package's index, which is read in parts."""
    members = zip_directory(read, size)
    (start, total), (at, length) = members[DATA], members[INDEX]
    rest, end = b"", at + length
    while at < end:
        part = rest + read(at, min(READ_BYTES, end - at))
        at += READ_BYTES
        *lines, rest = part.split(b"\n")
        for line in lines:
            page, offset, n = line.split(b" ")
            if int(offset) + int(n) > total:
                raise ValueError("the index points past its member")
            yield None if page == NO_ID.encode() else int(page), start + int(offset), int(n)
    if rest:
        raise ValueError("the index ends within a line")


# --- Spark ------------------------------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses).

    What repeats is found on ids and digests alone. While the digests that repeat are few, they are broadcast and payloads stay where they are; when they are many,
    payloads are dealt once by their digests, those of hot pages over all tasks.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    big = rows.filter(F.length("payload") >= least).select("page_id", "digest")
    counts = big.groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("copies"))
    repeats = common.materialize(counts.filter("copies > 1"), "repeats")
    out = common.attach_stats(rows, repeats, "digest", "copies", common.total_of(repeats, "copies"), ["page_id"])
    refers = F.when((F.length("payload") >= least) & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))
    return out.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _located(spark: SparkSession, path: str) -> str:
    """path with its scheme and authority, in the form that pyarrow's file systems read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub(r"^file:/+", "file:///", full)


class _Opened:
    """The package that was asked for last, open for reads of ranges."""

    def __init__(self):
        self.name, self.file = None, None

    def __call__(self, package: str) -> Callable[[int, int], bytes]:
        if package != self.name:
            self.close()
            store, path = fs.FileSystem.from_uri(package)
            self.name, self.file = package, store.open_input_file(path)
        return lambda at, n: self.file.read_at(n, at)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.name, self.file = None, None


def _damaged(package: str, e: Exception) -> ValueError:
    return ValueError(f"package {package}: {e}")


_FAULTS = (ValueError, struct.error, KeyError, StopIteration, zlib.error)


def write_packages(pages: DataFrame, path: str, per_package: int = 500, max_bytes: int = 8 << 20, least: int = LEAST_BYTES) -> DataFrame:
    """Write the packages of pages (page_id, url, html) to files under path; PACKAGES, one row a package, also kept in path/manifest."""
    spark = pages.sparkSession
    folder = _located(spark, f"{path}/packages")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                c = [b.column(n) for n in ("page_id", "url", "payload", "digest", "refers_to")]
                for i in range(b.num_rows):
                    yield tuple(x[i].as_py() for x in c)

        store, place = fs.FileSystem.from_uri(folder)
        for n, content in pack(records(), per_package, max_bytes):
            name = f"{uuid.uuid4().hex}.wacz"
            store.create_dir(place, recursive=True)
            with store.open_output_stream(f"{place}/{name}") as out:
                out.write(content)
            yield pa.RecordBatch.from_pydict({"package": [f"{folder}/{name}"], "bytes": [len(content)], "records": [n]})

    common.ship(spark)
    with_revisits(pages, least).mapInArrow(tasks, PACKAGES).write.parquet(f"{path}/manifest")
    return spark.read.schema(PACKAGES).parquet(f"{path}/manifest")


def read_index(packages: DataFrame) -> DataFrame:
    """RANGES: where each record of packages (package, with its scheme) lies. Rows of a package come one after another."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _Opened()
        for b in batches:
            for package in b.column(0).to_pylist():
                read, rows = opened(package), []
                try:
                    for row in package_ranges(read, opened.file.size()):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield batch(package, rows)
                            rows = []
                except _FAULTS as e:
                    raise _damaged(package, e) from e
                if rows:
                    yield batch(package, rows)
        opened.close()

    def batch(package: str, rows: list[tuple]) -> pa.RecordBatch:
        numbers = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([package] * len(rows), pa.string()), *numbers], ["package", "page_id", "at", "length"])

    spark = packages.sparkSession
    common.ship(spark)
    dealt = packages.select("package").repartition(max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))), "package")
    return dealt.mapInArrow(tasks, RANGES)


def read_ranges(ranges: DataFrame) -> DataFrame:
    """RECORDS at the given RANGES, all of an index or some. Ranges that follow each other are read at once, up to READ_BYTES."""
    types = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[int]]]:
        package, first, end, lengths = None, 0, 0, []
        for b in batches:
            for p, at, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if p != package or at != end or end + n - first > READ_BYTES:
                    if lengths:
                        yield package, first, lengths
                    package, first, end, lengths = p, at, at, []
                lengths.append(n)
                end += n
        if lengths:
            yield package, first, lengths

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _Opened()
        for package, first, lengths in runs(batches):
            data, rows, at, held = opened(package)(first, sum(lengths)), [], 0, 0
            for n in lengths:
                try:
                    rows.append(parse_warc(data[at : at + n]))
                except _FAULTS as e:
                    raise _damaged(package, e) from e
                at, held = at + n, held + len(rows[-1]["payload"] or b"")
                if held > 4 * READ_BYTES:
                    yield batch(package, rows)
                    rows, held = [], 0
            if rows:
                yield batch(package, rows)
        opened.close()

    def batch(package: str, rows: list[dict]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], t) for k, t in types.items()]
        return pa.RecordBatch.from_arrays([pa.array([package] * len(rows), pa.string()), *columns], ["package", *types])

    common.ship(ranges.sparkSession)
    return ranges.select("package", "at", "length").mapInArrow(tasks, RECORDS)


def read_packages(packages: DataFrame) -> DataFrame:
    """RECORDS of all packages."""
    return read_ranges(read_index(packages))
