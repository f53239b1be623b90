"""What the operators of this subpackage share: tables, stage files, byte views."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def py_fold(doc_id: int | None, n: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


def unit_hash(*cols: Column) -> Column:
    """A reproducible number in [0, 1) from the columns' values."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and the master is local (tests) a temporary folder is made and set;
    on a cluster a folder of one machine would lose rows, so there it is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="geomill-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


class Stages:
    """Stage tables as Parquet in the shared folder: they cut lineage and outlive executors.

    ``t = stages.keep(df)`` writes and reads back; ``drop`` removes a table that no later plan
    reads.  What a lazily evaluated result still reads stays in the folder, which the cluster
    owns and clears.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/stages-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def keep(self, df: DataFrame, name: str = "t", **options: int) -> DataFrame:
        """``options`` are those of the Parquet files."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.mode("overwrite").options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._geomill_path = path
        return out

    def keep_bucketed(self, df: DataFrame, key: str, name: str = "t") -> DataFrame:
        """``keep``, bucketed and sorted by ``key``: later joins on it don't shuffle this table.

        As many buckets as the session has shuffle partitions.  The catalog's entry is a name of
        the session for files in the shared folder; ``drop`` removes both."""
        self.n += 1
        path, label = f"{self.root}/{self.n:03d}-{name}", f"geomill_{uuid.uuid4().hex[:12]}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(label)
        out = self.spark.table(label)
        out._geomill_path, out._geomill_table = path, label
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if label := getattr(t, "_geomill_table", None):
                self.spark.sql(f"DROP TABLE IF EXISTS {label}")
            if path := getattr(t, "_geomill_path", None):
                jvm = self.spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def tidy(self) -> None:
        """Let Spark's cleaner remove shuffle files and broadcasts of plans that are done: it does so once the driver has collected them."""
        self.spark.sparkContext._jvm.System.gc()

    def clear(self, *kept: DataFrame) -> None:
        """Remove all tables but the ``kept`` ones, for an operator whose result reads only those."""
        stay = {p.rsplit("/", 1)[1] for t in kept if (p := getattr(t, "_geomill_path", None))}
        sc = self.spark.sparkContext
        root = sc._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
        if fs.exists(root):
            for f in fs.listStatus(root):
                if f.getPath().getName() not in stay:
                    fs.delete(f.getPath(), True)

    def read_by(self, df: DataFrame) -> bool:
        """Whether ``df`` still reads a table of these stages."""
        folder = self.root.rsplit("/", 1)[1]
        return any(f"/{folder}/" in f for f in df.inputFiles())


#: A side is broadcast only if a count shows it has no more rows than this (8-byte keys: 4 MB).
SMALL_ROWS = 500_000


def semi(df: DataFrame, ids: DataFrame, on: str, n_ids: int, how: str = "left_semi") -> DataFrame:
    """left_semi / left_anti on a table of ``n_ids`` counted ids: broadcast if small, else by shuffle."""
    return df.join(F.broadcast(ids) if n_ids <= SMALL_ROWS else ids, on, how)


def byte_view(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a text or binary column without copying the texts; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string()).cast(pa.large_binary())
    else:
        arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    _, offs, data = arr.buffers()
    offsets = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def texts(arr: pa.Array) -> list[str]:
    return [t or "" for t in arr.to_pylist()]


def by_bytes(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


#: Rows of an Arrow batch, where the session leaves it open: texts are large, and the JVM, the
#: channel and the Python worker each hold a batch at once.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> None:
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) in (None, "10000"):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def hand_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task, and what it keeps counts for the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """mapInArrow with state made once for each task by ``make``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for b in batches:
            if b.num_rows:
                yield each(b)
        del each
        hand_back()

    small_batches(df)
    return df.mapInArrow(run, schema)


def append_columns(df: DataFrame, text: str, make: Callable[[], Callable[[pa.Array], dict[str, pa.Array]]], added: list[T.StructField], drop: bool = False) -> DataFrame:
    """``df`` with columns computed from the column ``text``; the other columns pass through untouched.

    An existing column of an added name is replaced.  ``drop`` leaves out the column ``text`` itself,
    which then isn't sent back from Python.
    """
    if text in {f.name for f in added}:
        raise ValueError(f"the text column can't be named {text}")
    names = {f.name for f in added} | ({text} if drop else set())
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + added)
    where = [i for i, f in enumerate(df.schema.fields) if f.name not in names]
    at = [f.name for f in df.schema.fields].index(text)

    def setup() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        each = make()

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            new = each(b.column(at))
            return pa.RecordBatch.from_arrays([b.column(i) for i in where] + [new[f.name] for f in added], names=[f.name for f in schema.fields])

        return one

    return map_arrow(df, setup, schema)
