"""Media columns: Ogg streams of 8-bit samples, written, checked, demultiplexed and timed.

``store`` packs a payload into an Ogg physical stream of two multiplexed logical streams:
samples (packets of ``PACKET`` 8-bit samples; granule position: samples so far) and an index
(one packet for each page of samples: its granule and the CRC-32 of its body).  ``read_media``
verifies each page's checksum, splits pages into logical streams by serial number, reassembles
packets from the lacing values (a packet may span pages), and derives times from granules.  The
pages of samples are then held against the index: an entry that differs in granule or body
checksum, and a page or an entry without its counterpart, count as faults.

The page checksum (polynomial 04C11DB7, most significant bit first, no inversions) is the one
of zlib for bit-reversed bytes, so both run in C.

Cases: null text stands for the empty payload, padded like any other; a null media value gives
nulls; a page with a wrong checksum is skipped and counted as damaged, one whose number isn't
the next as lost; bytes between pages are skipped; an empty table gives an empty result;
repeated rows get equal values; other columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, byte_view, map_arrow

FRAME, PACKET, RATE = 576, 4608, 8000
SAMPLES, INDEX = 1, 2  # serial numbers
CONTINUED, FIRST, LAST = 1, 2, 4
HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """Checksum of a page whose checksum field is zero."""
    x = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_REVERSED), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_crc(head + body)
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def sample_pages(payload: bytes) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(flags, granule, lacing, body) of the pages that hold the payload's packets."""
    lacing: list[int] = []
    for lo in range(0, len(payload), PACKET):
        size = min(PACKET, len(payload) - lo)
        lacing += [255] * (size // 255) + [size % 255]
    at = done = packet = 0
    for lo in range(0, len(lacing), 255):
        part = lacing[lo : lo + 255]
        size = sum(part)
        granule, end = -1, at
        for x in part:
            end += x
            packet += x
            if x < 255:
                done += packet
                packet, granule = 0, done
        flags = (CONTINUED if lo and lacing[lo - 1] == 255 else 0) | (LAST if lo + 255 >= len(lacing) else 0)
        yield flags, granule, bytes(part), payload[at : at + size]
        at += size


def encode(payload: bytes, rate: int = RATE) -> bytes:
    """The Ogg stream of a payload of 8-bit samples."""
    head = struct.pack("<8sIHH", b"PCM8\0\0\0\0", rate, 1, 8)
    out = [page(FIRST, 0, SAMPLES, 0, bytes([len(head)]), head), page(FIRST, 0, INDEX, 0, b"\x08", b"PAGECRC\0")]
    number = 1
    for flags, granule, lacing, body in sample_pages(payload):
        out.append(page(flags, granule, SAMPLES, number, lacing, body))
        out.append(page(flags & LAST, max(granule, 0), INDEX, number, b"\x0c", struct.pack("<qI", granule, zlib.crc32(body))))
        number += 1
    return b"".join(out)


class Page(NamedTuple):
    flags: int
    granule: int
    serial: int
    number: int
    lacing: bytes
    body: bytes


def pages(media: bytes) -> tuple[list[Page], int]:
    """The sound pages in order, and the number of damaged ones."""
    out, damaged, at = [], 0, media.find(b"OggS")
    while at >= 0 and at + 27 <= len(media):
        _, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        whole = media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]
        if version == 0 and end <= len(media) and len(lacing) == n and page_crc(whole) == crc:
            out.append(Page(flags, granule, serial, number, lacing, media[at + 27 + n : end]))
            at = end if media[end : end + 4] == b"OggS" else media.find(b"OggS", end)
        else:
            damaged += 1
            at = media.find(b"OggS", at + 4)
    return out, damaged


class Packet(NamedTuple):
    serial: int
    number: int
    data: bytes
    granule: int | None  # position at the end of the last packet that ends on the page, else None
    page: int  # number of the page where it ends


class Demuxed(NamedTuple):
    packets: dict[int, list[Packet]]
    bodies: dict[int, dict[int, tuple[int, int]]]  # (granule, CRC-32 of the body) by stream and page number
    pages: int
    damaged: int
    lost: int


def demux(media: bytes) -> Demuxed:
    """The packets of each logical stream, reassembled; a packet with a missing part is dropped."""
    sound, damaged = pages(media)
    packets: dict[int, list[Packet]] = {}
    bodies: dict[int, dict[int, tuple[int, int]]] = {}
    held: dict[int, list[bytes] | None] = {}
    following: dict[int, int] = {}
    lost = 0
    for p in sound:
        if p.serial in following and p.number != following[p.serial]:
            lost += max(1, p.number - following[p.serial])
            held[p.serial] = None
        following[p.serial] = p.number + 1
        stream = packets.setdefault(p.serial, [])
        bodies.setdefault(p.serial, {})[p.number] = p.granule, zlib.crc32(p.body)
        part: list[bytes] | None = held.get(p.serial) if p.flags & CONTINUED else []
        at, last_end, start = 0, max((i for i, x in enumerate(p.lacing) if x < 255), default=-1), 0
        for i, x in enumerate(p.lacing):
            at += x
            if x < 255:
                if part is not None:
                    part.append(p.body[start:at])
                    stream.append(Packet(p.serial, len(stream), b"".join(part), p.granule if i == last_end else None, p.number))
                part, start = [], at
        if start < at or (p.lacing and p.lacing[-1] == 255):
            if part is not None:
                part.append(p.body[start:at])
            held[p.serial] = part
        else:
            held[p.serial] = []
    return Demuxed(packets, bodies, len(sound) + damaged, damaged, lost)


def samples(d: Demuxed) -> tuple[bytes, int, int]:
    """(payload, rate, last granule) of the stream of samples."""
    stream = d.packets.get(SAMPLES, [])
    if not stream or not stream[0].data.startswith(b"PCM8"):
        return b"", 0, 0
    rate = struct.unpack_from("<8sIHH", stream[0].data)[1]
    ends = [p.granule for p in stream[1:] if p.granule is not None and p.granule >= 0]
    return b"".join(p.data for p in stream[1:]), rate, max(ends, default=0)


def index_faults(d: Demuxed) -> int:
    """Pages of samples that the index doesn't confirm, and entries without their page."""
    entries = {p.page: struct.unpack("<qI", p.data) for p in d.packets.get(INDEX, [])[1:] if len(p.data) == 12}
    mine = {k: v for k, v in d.bodies.get(SAMPLES, {}).items() if k}  # page 0 is the head
    return sum(entries.get(k) != mine.get(k) for k in entries.keys() | mine.keys())


def timestamps(d: Demuxed) -> list[tuple[int, float, float]]:
    """(packet, start, end) in seconds, from the granules; packets between two granules count samples."""
    stream = d.packets.get(SAMPLES, [])
    if not stream or not stream[0].data.startswith(b"PCM8"):
        return []
    rate, out, at, group = struct.unpack_from("<8sIHH", stream[0].data)[1], [], 0, []
    for p in stream[1:]:
        group.append(p)
        if p.granule is not None and p.granule >= 0:
            at = p.granule - sum(len(q.data) for q in group)
            for q in group:
                out.append((q.number - 1, at / rate, (at + len(q.data)) / rate))
                at += len(q.data)
            group = []
    for q in group:
        out.append((q.number - 1, at / rate, (at + len(q.data)) / rate))
        at += len(q.data)
    return out


def feature(payload: bytes, rate: int, granule: int) -> str:
    """Duration, level, energy, zero crossings and a sixteen-step envelope of the samples; whole numbers, so exact."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    if not len(x):
        return "ms=0"
    frames = np.abs(x[: len(x) // FRAME * FRAME].reshape(-1, FRAME)).sum(1) if len(x) >= FRAME else np.abs(x).sum(keepdims=True)
    cuts = np.arange(16) * len(frames) // 16
    envelope = np.maximum.reduceat(frames, cuts)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    steps = "".join(f"{int(v) // FRAME:02x}" for v in envelope)
    return f"ms={granule * 1000 // max(rate, 1)};sum={int(x.sum())};energy={int((x * x).sum())};zero={crossings};env={steps}"


def padded(raw: bytes) -> bytes:
    """The bytes with bytes 255 up to a positive multiple of FRAME."""
    return raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def store(docs: DataFrame, text: str = "text", media: str = "media", n_bytes: str = "n_bytes", drop: bool = False) -> DataFrame:
    """``docs`` with the Ogg stream of every whole text as UTF-8, and the unpadded size."""

    def make():
        def each(arr: pa.Array) -> dict[str, pa.Array]:
            data, offsets = byte_view(arr)
            streams = [encode(padded(data[offsets[i] : offsets[i + 1]].tobytes())) for i in range(len(arr))]
            return {n_bytes: pa.array(np.diff(offsets), pa.int64()), media: pa.array(streams, pa.binary())}

        return each

    return append_columns(docs, text, make, [T.StructField(n_bytes, T.LongType()), T.StructField(media, T.BinaryType())], drop)


READ = [
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()),
    T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("duration_s", T.DoubleType()), T.StructField("damaged_pages", T.LongType()), T.StructField("lost_pages", T.LongType()),
    T.StructField("index_faults", T.LongType()),
]


def read_media(df: DataFrame, media: str = "media", drop: bool = False) -> DataFrame:
    """``df`` with what the stored bytes hold when read back."""

    def one(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * len(READ)
        d = demux(raw)
        payload, rate, granule = samples(d)
        sha = hashlib.sha256
        return len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), sha(raw).hexdigest(), feature(payload, rate, granule), granule / rate if rate else 0.0, d.damaged, d.lost, index_faults(d)

    def make():
        def each(arr: pa.Array) -> dict[str, pa.Array]:
            rows = [one(x.as_py()) for x in arr]
            kinds = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
            return {f.name: pa.array([r[i] for r in rows], kinds[f.dataType.simpleString()]) for i, f in enumerate(READ)}

        return each

    return append_columns(df, media, make, READ, drop)


PACKETS = T.StructType([T.StructField("id", T.LongType()), T.StructField("packet", T.LongType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())])


def packet_times(df: DataFrame, id: str = "doc_id", media: str = "media") -> DataFrame:
    """(id, packet, start_s, end_s) of every packet of samples."""

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(i, *t) for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if m is not None for t in timestamps(demux(m))]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=PACKETS.names)

        return one

    return map_arrow(df.select(df[id].cast("long"), media), make, PACKETS)
