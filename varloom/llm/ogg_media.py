"""Operator 9, media columns: Ogg files with raw 8-bit samples, written and read back page by page.

The stored form of a payload is an Ogg file with two logical streams. The first holds unsigned 8-bit mono PCM: a header
packet ("PCM     ", rate, channels), a comment packet, then packets of PACKET samples. The second is a log with the
payload's length and CRC-32 as text, multiplexed into the first. Every value depends on the payload alone, so that equal payloads give
equal files.

The reader verifies each page's checksum, puts packets together again from lacing values (a value of 255 goes on, on the next
page if need be), sorts pages by serial number, and takes a packet's end time from the granule position of its page:
samples so far over the rate. Serial numbers, sequence numbers, continuation flags and the last page's flag are checked.

Ogg's checksum is CRC-32 of the same polynomial as zlib's, but unreflected, with neither start value nor final
inversion. Reversing the bits of each byte turns one into the other, so that zlib does the work (`page_crc`).

Defined cases: a null text counts as empty; the payload is padded with spaces to a positive multiple of 192. Repeated
rows give repeated results, a null doc_id is kept, and other columns aren't read. A text of any length is one file with as
many pages as it needs; a worker holds the files of a batch at once. An empty table gives an empty result. A damaged file
raises an error.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNIT, RATE, PACKET = 192, 8000, 4032
AUDIO, LOG = 0x504D, 0x4C4F
FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """Ogg's CRC-32 of a page whose checksum field is zero."""
    raw = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def page(serial: int, number: int, flags: int, granule: int, laces: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIIIB", b"OggS", 0, flags, granule, serial, number, 0, len(laces)) + laces
    out = bytearray(head + body)
    out[22:26] = page_crc(bytes(out)).to_bytes(4, "little")
    return bytes(out)


def stream_pages(serial: int, packets: list[tuple[bytes, int]], alone: int) -> list[bytes]:
    """Pages of packets (bytes, granule position at its end); the first `alone` packets have a page each.

    A page holds up to 255 lacing values, so a packet may begin on one page and end on the next. A page's granule
    position is that of the last packet that ends on it, -1 if none does.
    """
    pages, laces, body, granule, going_on, number = [], bytearray(), bytearray(), -1, False, 0

    def close(last: bool):
        nonlocal laces, body, granule, going_on, number
        flags = going_on | 2 * (number == 0) | 4 * last
        pages.append(page(serial, number, flags, granule, bytes(laces), bytes(body)))
        going_on, number = bool(laces) and laces[-1] == 255, number + 1
        laces, body, granule = bytearray(), bytearray(), -1

    for k, (data, end) in enumerate(packets):
        want, at = lacing(len(data)), 0
        while want:
            part, want = want[: 255 - len(laces)], want[255 - len(laces) :]
            size = sum(part)
            laces += part
            body += data[at : at + size]
            at += size
            if not want:
                granule = end
            if want or len(laces) == 255:
                close(last=not want and k == len(packets) - 1)
        if laces and (k < alone or k == len(packets) - 1):
            close(last=k == len(packets) - 1)
    return pages


def encode(payload: bytes) -> bytes:
    """The Ogg file of a payload: both streams begin before any other page, and the log ends before the last samples."""
    head = struct.pack(">8sHHIIBBHII", b"PCM     ", 0, 0, 1, RATE, 8, 1, 0, 0, 1)
    audio = [(head, 0), (b"\x00\x00\x00\x00\x00\x00\x00\x00", 0)]
    audio += [(payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)]
    log = [(b"LOG1", 0), (b"bytes=%d crc32=%d" % (len(payload), zlib.crc32(payload)), len(payload))]
    a, b = stream_pages(AUDIO, audio, 2), stream_pages(LOG, log, 1)
    return b"".join([a[0], b[0], a[1], *b[1:], *a[2:]])


def decode(data: bytes) -> dict[int, list[tuple[bytes, int]]]:
    """Packets (bytes, granule position of the page on which each ends) by serial number."""
    streams: dict[int, dict] = {}
    p = 0
    while p < len(data):
        if p + 27 > len(data):
            raise ValueError(f"the page at byte {p} is cut off")
        magic, version, flags, granule, serial, number, crc, n = struct.unpack_from("<4sBBqIIIB", data, p)
        laces = data[p + 27 : p + 27 + n]
        start = p + 27 + n
        stop = start + sum(laces)
        if magic != b"OggS" or version or stop > len(data):
            raise ValueError(f"no Ogg page at byte {p}")
        if page_crc(data[p : p + 22] + b"\0\0\0\0" + data[p + 26 : stop]) != crc:
            raise ValueError(f"the page at byte {p} fails its checksum")
        s = streams.setdefault(serial, {"next": 0, "open": [], "packets": [], "ended": False})
        if number != s["next"] or bool(flags & 1) != bool(s["open"]) or bool(flags & 2) != (number == 0) or s["ended"]:
            raise ValueError(f"the page at byte {p} doesn't follow its stream")
        s["next"], s["ended"] = number + 1, bool(flags & 4)
        at = run = start
        for v in laces:
            at += v
            if v < 255:
                s["open"].append(data[run:at])
                s["packets"].append((b"".join(s["open"]), granule))
                s["open"], run = [], at
        if run < at:
            s["open"].append(data[run:at])
        p = stop
    if any(s["open"] or not s["ended"] for s in streams.values()):
        raise ValueError("a stream doesn't end")
    return {k: s["packets"] for k, s in streams.items()}


def samples(data: bytes) -> tuple[bytes, list[float]]:
    """The payload of an Ogg file by `encode`, and the time at the end of each page that ends a packet, in seconds."""
    streams = decode(data)
    audio = streams[AUDIO]
    magic, _, _, _, rate, bits, channels = struct.unpack_from(">8sHHIIBB", audio[0][0])
    if magic != b"PCM     " or (bits, channels) != (8, 1):
        raise ValueError("not 8-bit mono samples")
    payload = b"".join(x for x, _ in audio[2:])
    if streams[LOG][1][0] != b"bytes=%d crc32=%d" % (len(payload), zlib.crc32(payload)):
        raise ValueError("the samples don't agree with the log")
    return payload, sorted({g / rate for _, g in audio[2:]})


def padded(raw: bytes) -> bytes:
    return raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def features(payload: bytes, ends: list[float]) -> str:
    """Integers only: samples, mean times 1000, energy around the middle, crossings of the middle, pages' end times in ms."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"n={len(x)};mean={int(x.sum()) * 1000 // len(x)};energy={int((x * x).sum()) // len(x)};crossings={crossings};pages={len(ends)};ms={int(ends[-1] * 1000)}"


def store(docs: DataFrame, path: str) -> None:
    """Write doc_id, n_bytes and media, the Ogg file of each text, to a Parquet table at path."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):  # small batches: a batch's media stays in the worker's memory
                part = b.slice(i, 200)
                raw = [x.encode() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([encode(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    common.ship(docs.sparkSession)
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.plain_text().alias("text")).mapInArrow(tasks, "doc_id long, n_bytes long, media binary").write.option("compression", "zstd").parquet(path)


def read_features(media: DataFrame) -> DataFrame:
    """doc_id and FEATURES from a table of `store`."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                out = []
                for n, data in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    payload, ends = samples(data)
                    out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(payload, ends)))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["doc_id", *[f.split()[0] for f in FEATURES.split(", ")]])

    common.ship(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(tasks, f"doc_id long, {FEATURES}")
