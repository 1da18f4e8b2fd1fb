"""Capture files: PCAP and PCAPNG in both byte orders, plain or compressed.

Records come as ``(timestamp_us, original_length, link_type, bytes)`` from an iterator over one
stream. A plain PCAP file has no marks to find record starts by, so :func:`splits` walks the record
headers once (16 bytes a record, seeking over the data) and gives byte ranges with the number of the
first frame; compressed files and PCAPNG are one range.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import struct
from collections.abc import Iterator
from typing import BinaryIO

Record = tuple[int, int, int, bytes]

# fixed values: magic numbers of the formats
_PCAP = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
_PCAPNG = b"\x0a\x0d\x0d\x0a"
_COMPRESSED = ((b"\x1f\x8b", "gzip"), (b"\x28\xb5\x2f\xfd", "zstd"), (b"\x04\x22\x4d\x18", "lz4"), (b"BZ", "bz2"), (b"\xfd7zXZ\x00", "xz"))
#: Longest record that is believed; a longer one means a damaged file.
MOST_RECORD = 256 * 1024 * 1024


class CaptureError(ValueError):
    """A file that is no capture, or a damaged one."""


def compression(head: bytes) -> str | None:
    """Name of the compression that the first bytes show."""
    return next((name for magic, name in _COMPRESSED if head.startswith(magic)), None)


def opened(raw: BinaryIO) -> BinaryIO:
    """The stream behind whatever compression its first bytes show."""
    raw = raw if isinstance(raw, io.BufferedReader) else io.BufferedReader(raw, 256 * 1024)
    kind = compression(raw.peek(8)[:8])
    if kind == "gzip":
        return io.BufferedReader(gzip.GzipFile(fileobj=raw), 256 * 1024)
    if kind == "bz2":
        return io.BufferedReader(bz2.BZ2File(raw), 256 * 1024)
    if kind == "xz":
        return io.BufferedReader(lzma.LZMAFile(raw), 256 * 1024)
    if kind == "zstd":
        import zstandard

        return io.BufferedReader(zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True), 256 * 1024)
    if kind == "lz4":
        import pyarrow as pa

        return io.BufferedReader(pa.CompressedInputStream(pa.PythonFile(raw, "r"), "lz4"), 256 * 1024)
    return raw


def _exactly(f: BinaryIO, n: int) -> bytes | None:
    """``n`` bytes, None at the end of the file or in a record that is cut off."""
    data = f.read(n)
    while data and len(data) < n:
        more = f.read(n - len(data))
        if not more:
            return None
        data += more
    return data if len(data) == n else None


def records(f: BinaryIO, legacy: bool = False) -> Iterator[Record]:
    """All records of a capture stream. A record that is cut off ends the file.

    ``legacy`` keeps what older tools read: nanosecond files without division and microseconds in every
    PCAPNG interface.
    """
    head = _exactly(f, 4)
    if head is None:
        raise CaptureError("the file is empty or shorter than four bytes")
    if head in _PCAP:
        yield from _pcap(f, *_PCAP[head], legacy)
    elif head == _PCAPNG:
        yield from _pcapng(f, legacy)
    else:
        raise CaptureError(f"not a capture file: it begins with {head.hex()}")


def _pcap(f: BinaryIO, order: str, divide: int, legacy: bool) -> Iterator[Record]:
    head = _exactly(f, 20)
    if head is None:
        raise CaptureError("the file header is cut off")
    link = struct.unpack(order + "I", head[16:20])[0] & 0x0FFFFFFF
    yield from pcap_records(f, order, 1 if legacy else divide, link)


def pcap_records(f: BinaryIO, order: str, divide: int, link: int, most: int | None = None) -> Iterator[Record]:
    """Records from the current position on, at most ``most``."""
    unpack, n = struct.Struct(order + "IIII").unpack, 0
    while (most is None or n < most) and (head := _exactly(f, 16)) is not None:
        sec, frac, size, wire = unpack(head)
        if size > MOST_RECORD:
            raise CaptureError(f"record {n + 1} claims {size} bytes")
        if size and (data := _exactly(f, size)) is None:
            return
        yield sec * 1_000_000 + frac // divide, wire, link, data if size else b""
        n += 1


def _pcapng(f: BinaryIO, legacy: bool) -> Iterator[Record]:
    order, faces, kind = "<", [], 0x0A0D0D0A
    while True:
        size_bytes = _exactly(f, 4)
        if size_bytes is None:
            return
        if kind == 0x0A0D0D0A:
            mark = _exactly(f, 4)
            if mark is None:
                return
            order, faces = ("<" if mark == b"\x4d\x3c\x2b\x1a" else ">"), []
            size = struct.unpack(order + "I", size_bytes)[0]
            body = _exactly(f, size - 12) if size >= 16 else None
        else:
            size = struct.unpack(order + "I", size_bytes)[0]
            body = _exactly(f, size - 8) if 12 <= size <= MOST_RECORD else None
        if body is None:
            return
        body = body[:-4]
        if kind == 1 and len(body) >= 8:  # interface: its link type and the resolution of its times
            faces.append((struct.unpack(order + "H", body[:2])[0], 1_000_000 if legacy else _resolution(body[8:], order)))
        elif kind == 6 and len(body) >= 20:
            face, high, low, size, wire = struct.unpack(order + "IIIII", body[:20])
            link, ticks = faces[face] if face < len(faces) else (1, 1_000_000)
            yield ((high << 32) | low) * 1_000_000 // ticks, wire, link, body[20 : 20 + size]
        elif kind == 3 and len(body) >= 4:
            wire = struct.unpack(order + "I", body[:4])[0]
            yield 0, wire, faces[0][0] if faces else 1, body[4 : 4 + wire]
        head = _exactly(f, 4)
        if head is None:
            return
        kind = struct.unpack(order + "I", head)[0]


def _resolution(options: bytes, order: str) -> int:
    """Ticks a second from the interface's options; a million without any."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack(order + "HH", options[at : at + 4])
        if code == 0:
            break
        if code == 9 and size >= 1:
            value = options[at + 4]
            return 2 ** (value & 0x7F) if value & 0x80 else 10**value
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def splits(f: BinaryIO, target: int) -> list[tuple[int, int, int]]:
    """(offset, first frame number, frames) of ranges of about ``target`` bytes of a plain PCAP
    file; one range from 0 of unknown length (-1) for everything else."""
    head = f.read(24)
    if len(head) < 24 or head[:4] not in _PCAP:
        return [(0, 1, -1)]
    order = _PCAP[head[:4]][0]
    unpack = struct.Struct(order + "IIII").unpack
    out, at, start, first, n = [], 24, 24, 1, 0
    while len(record := f.read(16)) == 16:
        size = unpack(record)[2]
        f.seek(size, 1)
        at += 16 + size
        n += 1
        if at - start >= target:
            out.append((start, first, n))
            start, first, n = at, first + n, 0
    if n or not out:
        out.append((start, first, n))
    return out
