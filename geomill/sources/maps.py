"""OpenStreetMap extracts (.osm.pbf): a Spark data source with one partition for a run of blobs, and a writer.

A file is a row of blobs; their headers tell their sizes, so the driver steps from header to header and deals
the blobs into partitions of about ``blobBytes`` without reading them.  A task inflates one blob after another and
decodes dense nodes, ways and relations (packed varints, deltas and string tables) with numpy.  Paths may be
of any store that pyarrow knows (``file:``, ``hdfs:``, ``s3:``, ...), a file or a folder of files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, id long, lat double, lng double, tags map<string,string>, refs array<long>, members array<struct<kind:string,ref:long,role:string>>"
KINDS = ("node", "way", "relation")
MEMBER = pa.struct([("kind", pa.string()), ("ref", pa.int64()), ("role", pa.string())])
ARROW = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("lat", pa.float64()), ("lng", pa.float64()), ("tags", pa.map_(pa.string(), pa.string())), ("refs", pa.list_(pa.int64())), ("members", pa.list_(MEMBER))])
#: Nanodegrees of a unit, elements of a block.
GRANULARITY, BLOCK = 100, 8000


# ---- protocol buffers ------------------------------------------------------------------------------
def varints(data: bytes) -> np.ndarray:
    """All varints of a packed field, as unsigned 64-bit numbers."""
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = np.zeros(len(ends), np.uint64)
    size = ends - starts + 1
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        out[has] |= (b[starts[has] + k] & np.uint8(0x7F)).astype(np.uint64) << np.uint64(7 * k)
    return out


def signed(u: np.ndarray) -> np.ndarray:
    """Zigzag numbers."""
    return (u >> np.uint64(1)).astype(np.int64) ^ -(u & np.uint64(1)).astype(np.int64)


def deltas(data: bytes) -> np.ndarray:
    return np.cumsum(signed(varints(data)))


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: varints as numbers, length-delimited fields as bytes."""
    at, n = 0, len(data)

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < n:
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        elif tag & 7 == 2:
            size = number()
            yield tag >> 3, data[at : at + size]
            at += size
        elif tag & 7 in (1, 5):
            at += 8 if tag & 7 == 1 else 4
        else:
            raise ValueError("not a map file")


def varint(x: int) -> bytes:
    out = bytearray()
    while x > 0x7F:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    out.append(x)
    return bytes(out)


def zigzag(x: int) -> int:
    return x << 1 if x >= 0 else (-x << 1) - 1


def put(number: int, value: int | bytes) -> bytes:
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def put_deltas(number: int, values: list[int]) -> bytes:
    return put(number, b"".join(varint(zigzag(b - a)) for a, b in zip([0, *values], values, strict=False)))


# ---- blobs -----------------------------------------------------------------------------------------
def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)


def files_of(path: str, ending: str) -> list[str]:
    """The files of a path, a file or a folder, with their store's prefix."""
    fs, p = opened(path)
    info = fs.get_file_info(p)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(p, recursive=True))
    head = path[: path.index(p)] if p in path else ""
    return sorted(head + f.path for f in found if f.is_file and f.path.endswith(ending))


def blobs(f) -> Iterator[tuple[str, int, int]]:
    """(type, offset, size) of the blobs of an open file, from their headers."""
    at = 0
    while head := f.read_at(4, at) if hasattr(f, "read_at") else f.read(4):
        size = struct.unpack(">I", head)[0]
        of = dict(fields(bytes(f.read_at(size, at + 4))))
        yield of[1].decode(), at + 4 + size, of[3]
        at += 4 + size + of[3]


def inflate(blob: bytes) -> bytes:
    of = dict(fields(blob))
    if 1 in of:
        return of[1]
    if 3 not in of:
        raise ValueError("blobs are read raw or with zlib only")
    return zlib.decompress(of[3])


def framed(kind: str, content: bytes) -> bytes:
    blob = put(2, len(content)) + put(3, zlib.compress(content))
    header = put(1, kind.encode()) + put(3, len(blob))
    return struct.pack(">I", len(header)) + header + blob


def block_rows(data: bytes) -> Iterator[pa.RecordBatch]:
    """The elements of a primitive block, a batch for each of its groups."""
    strings: list[str] = []
    groups, granularity, lat0, lng0 = [], GRANULARITY, 0, 0
    for number, value in fields(data):
        if number == 1:
            strings = [s.decode("utf-8", "replace") for _, s in fields(value)]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            granularity = value
        elif number in (19, 20):
            offset = value - (1 << 64) if value >> 63 else value
            lat0, lng0 = (offset, lng0) if number == 19 else (lat0, offset)
    degrees = lambda units, offset: (offset + granularity * units) * 1e-9
    for g in groups:
        rows: list[tuple] = []
        for number, value in fields(g):
            of: dict[int, bytes | int] = dict(fields(value))
            packed = lambda k: varints(of.get(k, b"")).tolist()  # noqa: B023, E731
            if number == 2:
                ids, lat, lng = deltas(of[1]), degrees(deltas(of[8]), lat0), degrees(deltas(of[9]), lng0)
                flat, tags, now = packed(10), [], []
                i = 0
                while i < len(flat):
                    if flat[i] == 0:
                        tags.append(now)
                        now, i = [], i + 1
                    else:
                        now.append((strings[flat[i]], strings[flat[i + 1]]))
                        i += 2
                rows += zip(["node"] * len(ids), ids.tolist(), lat.tolist(), lng.tolist(), tags or [[]] * len(ids), [None] * len(ids), [None] * len(ids), strict=True)
                continue
            tags = [(strings[a], strings[b]) for a, b in zip(packed(2), packed(3), strict=True)]
            if number == 1:  # a node by itself: zigzag numbers
                num = lambda k: int(signed(np.array([of[k]], np.uint64))[0])  # noqa: B023, E731
                rows.append(("node", num(1), degrees(num(8), lat0), degrees(num(9), lng0), tags, None, None))
            elif number == 3:
                rows.append(("way", of[1], None, None, tags, deltas(of.get(8, b"")).tolist(), None))
            elif number == 4:
                members = [{"kind": KINDS[k], "ref": r, "role": strings[s]} for s, r, k in zip(packed(8), deltas(of.get(9, b"")).tolist(), packed(10), strict=True)]
                rows.append(("relation", of[1], None, None, tags, None, members))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class Blobs(InputPartition):
    def __init__(self, path: str, spans: list[tuple[int, int]]):
        self.path, self.spans = path, spans


class MapReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.most = options["path"], int(options.get("blobBytes", 64 << 20))

    def partitions(self) -> list[Blobs]:
        out = []
        for path in files_of(self.path, ".osm.pbf"):
            fs, p = opened(path)
            held: list[tuple[int, int]] = []
            with fs.open_input_file(p) as f:
                for kind, at, size in blobs(f):
                    if kind != "OSMData":
                        continue
                    if held and sum(s for _, s in held) + size > self.most:
                        out.append(Blobs(path, held))
                        held = []
                    held.append((at, size))
            if held:
                out.append(Blobs(path, held))
        return out or [Blobs("", [])]

    def read(self, partition: Blobs) -> Iterator[pa.RecordBatch]:
        if partition.spans:
            fs, p = opened(partition.path)
            with fs.open_input_file(p) as f:
                for at, size in partition.spans:
                    yield from block_rows(inflate(bytes(f.read_at(size, at))))


class MapSource(DataSource):
    """``spark.read.format("osmpbf").load(path)``; option ``blobBytes``: bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MapReader:
        return MapReader(self.options)


def read_map(spark: SparkSession, path: str, blob_bytes: int = 64 << 20) -> DataFrame:
    spark.dataSource.register(MapSource)
    return spark.read.format("osmpbf").option("blobBytes", blob_bytes).load(path)


# ---- writing ---------------------------------------------------------------------------------------
def block(rows: list[dict]) -> bytes:
    """A primitive block of elements of one kind."""
    strings: dict[str, int] = {"": 0}
    at = lambda s: strings.setdefault(s, len(strings))
    tags = lambda r: sorted((k, v) for k, v in (r["tags"] or []))
    if rows[0]["kind"] == "node":
        units = [[round(r[c] * 1e9 / GRANULARITY) for r in rows] for c in ("lat", "lng")]
        flat = b"".join(b"".join(varint(at(k)) + varint(at(v)) for k, v in tags(r)) + b"\0" for r in rows)
        group = put(2, put_deltas(1, [r["id"] for r in rows]) + put_deltas(8, units[0]) + put_deltas(9, units[1]) + put(10, flat))
    else:
        group = b""
        for r in rows:
            body = put(1, r["id"]) + put(2, b"".join(varint(at(k)) for k, _ in tags(r))) + put(3, b"".join(varint(at(v)) for _, v in tags(r)))
            if r["kind"] == "way":
                group += put(3, body + put_deltas(8, r["refs"] or []))
            else:
                members = r["members"] or []
                body += put(8, b"".join(varint(at(m["role"])) for m in members)) + put_deltas(9, [m["ref"] for m in members]) + put(10, bytes(KINDS.index(m["kind"]) for m in members))
                group += put(4, body)
    return put(1, b"".join(put(1, s.encode()) for s in strings)) + put(2, group)


def write_map(elements: DataFrame, path: str) -> int:
    """Write elements (``SCHEMA``) as a folder of files, one a task, in blocks of ``BLOCK``; returns their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, p = opened(path)
        fs.create_dir(p)
        name = f"{p}/part-{TaskContext.get().partitionId():05d}.osm.pbf"
        n, held = 0, []
        with fs.open_output_stream(f"{name}.{TaskContext.get().taskAttemptId()}") as f:
            f.write(framed("OSMHeader", put(4, b"OsmSchema-V0.6") + put(4, b"DenseNodes")))
            for b in batches:
                for r in b.to_pylist():
                    if held and (len(held) == BLOCK or held[0]["kind"] != r["kind"]):
                        f.write(framed("OSMData", block(held)))
                        held = []
                    held.append(r)
                    n += 1
            if held:
                f.write(framed("OSMData", block(held)))
        fs.move(f"{name}.{TaskContext.get().taskAttemptId()}", name)  # a repeated task replaces its file
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    names = [f.name for f in ARROW]
    return elements.select(*names).sortWithinPartitions("kind", "id").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
