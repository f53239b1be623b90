"""Shards by vector bin packing: bytes, words and rows balanced together.

A group is all rows of one text.  Its vector is its share of the table's bytes, words and rows;
a shard's residual capacity is what it lacks of an equal share in each of them.  Groups are taken
from the largest down and each goes where the (weighted) dot product of its vector with the
residual capacity is highest.

That order is kept in steps, none of which holds the table.
1. Groups of more than ``HEAVY`` of a shard in some measure are few, as shares add up to one a
   measure; the driver places them.  A group of more than a whole shard can't stay whole: its rows
   are dealt, by a hash of their number, into pieces of about ``HEAVY`` of a shard, counted exactly.
2. The others are placed in waves, each of seven eighths of what is left, by a hash of their key.  A
   wave is dealt into bins; each bin's share of the shards' lacks, less what later waves bring to
   all alike, is its residual capacity.  A bin's groups come sorted from the largest and are
   placed one after another.  What a wave leaves uneven, the next one levels; the last wave is one
   bin of at most ``BIN`` groups (more or less, by the hash).
3. Rows meet their group's shard: heavy groups by a broadcast of their list (a bounded number), the
   others by a join on the key.  A range sort by shard and the partitions' prefix counts number them.

Cases: a null text counts as an empty one, with size 1 (``size`` is bytes plus 1), no words and the
same group; repeated rows and ids are rows of their own; a null id is a row like others; an
empty table gives an empty result; with fewer groups than shards some shards stay empty unless a group
is split.  Other columns pass through, but for those with the name of an added one, which are replaced.
The rows' numbers are stored before they are used, so a lost executor changes nothing.
"""

from __future__ import annotations

import hashlib
import zlib
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stages, append_columns, byte_view
from .mixing import words_in

SHARDS = 16
#: Share of a shard above which a group is placed by itself: at most 3 * SHARDS / HEAVY such groups.
HEAVY = 1 / 64
#: Groups of a bin, and the most bins of a wave (bins grow beyond that; their groups are streamed).
BIN, MOST_BINS = 8192, 4096
#: Weight of bytes, words and rows in the dot product.
WEIGHTS = (8.0, 1.0, 1.0)
MEASURES = ("size", "n_words", "rows")


def measured(docs: DataFrame, text: str = "text", drop: bool = False) -> DataFrame:
    """``docs`` with size, text_crc32, n_words and the group's key (a digest of the text)."""

    def make():
        def each(arr: pa.Array) -> dict[str, pa.Array]:
            data, at = byte_view(arr)
            view = memoryview(data)
            rows = [view[at[i] : at[i + 1]] for i in range(len(arr))]
            return {
                "size": pa.array(np.diff(at) + 1, pa.int64()),
                "text_crc32": pa.array([zlib.crc32(r) for r in rows], pa.int64()),
                "n_words": pa.array(words_in(arr), pa.int64()),
                "__key": pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in rows], pa.binary()),
            }

        return each

    longs = [T.StructField(c, T.LongType()) for c in ("size", "text_crc32", "n_words")]
    return append_columns(docs, text, make, [*longs, T.StructField("__key", T.BinaryType())], drop=drop)


def place(vectors: np.ndarray, residual: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The shard of each vector, in the order given; ``residual`` (shards x measures) is used up."""
    out = np.empty(len(vectors), np.int32)
    weighed = vectors * weights
    for i, (v, w) in enumerate(zip(vectors, weighed, strict=True)):
        s = int((residual @ w).argmax())
        out[i] = s
        residual[s] -= v
    return out


def _sums() -> list:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in MEASURES]


def _total(df: DataFrame, *by: str) -> list:
    return df.groupBy(*by).agg(*_sums()).collect()


def place_groups(groups: DataFrame, residual: np.ndarray, totals: np.ndarray, stages: Stages, weights: np.ndarray, per_bin: int = BIN) -> list[DataFrame]:
    """Tables (__key, shard) of the light ``groups`` (__key, size, n_words, rows), in waves; ``residual`` is used up."""
    n = groups.count()
    shares, waves = [], 1
    while n * 8.0 ** (1 - waves) > per_bin:
        waves += 1
    for i in range(waves):
        left = n * 8.0**-i * (7 / 8 if i < waves - 1 else 1)
        shares.append(1 if i == waves - 1 else min(MOST_BINS, max(1, ceil(left / per_bin))))
    drawn = F.shiftrightunsigned(F.xxhash64("__key"), 11) / F.lit(float(1 << 53))
    wave = F.least(F.floor(-F.log(8.0, F.greatest(drawn, F.lit(1e-18)))), F.lit(waves - 1)).cast("int")
    place_in = F.shiftrightunsigned(F.xxhash64(F.lit("bin"), F.col("__key")), 11) / F.lit(float(1 << 53))
    bins = F.element_at(F.array(*[F.lit(b) for b in shares]), F.col("wave") + 1)
    dealt = groups.withColumn("wave", wave).withColumn("bin", F.floor(place_in * bins).cast("int"))
    dealt = stages.keep(dealt, "light")
    load = {(r["wave"], r["bin"]): np.array([r[c] for c in MEASURES]) / totals for r in _total(dealt, "wave", "bin")}
    done = []
    for i in range(waves):
        mine = {b: v for (w, b), v in load.items() if w == i}
        if not mine:
            continue
        later = sum((v for (w, _), v in load.items() if w > i), np.zeros(3))
        whole = np.maximum(sum(mine.values()), 1e-300)
        lack = residual - later / len(residual)
        out = stages.keep(_wave(dealt.filter(F.col("wave") == i), {b: v / whole for b, v in mine.items()}, lack, totals, weights), f"wave{i}")
        for r in _total(out, "shard"):
            residual[r["shard"]] -= np.array([r[c] for c in MEASURES]) / totals
        done.append(out.select("__key", "shard"))
    return done


def _wave(rows: DataFrame, share: dict[int, np.ndarray], lack: np.ndarray, totals: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(__key, measures, shard): each bin's groups, largest first, by its share of the lacks."""
    size = F.greatest(*[F.col(c) / F.lit(float(t)) for c, t in zip(MEASURES, totals, strict=True)])
    n = min(len(share), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    rows = rows.repartition(n, "bin").sortWithinPartitions("bin", size.desc(), "__key").select("bin", "__key", *MEASURES)
    schema = T.StructType([f for f in rows.schema.fields if f.name != "bin"] + [T.StructField("shard", T.IntegerType())])

    def run(batches):
        bin_of, residual = None, None
        for b in batches:
            if not b.num_rows:
                continue
            at = b.column(0).to_numpy()
            vectors = np.stack([b.column(2 + k).to_numpy() for k in range(3)], 1) / totals
            shard = np.empty(len(at), np.int32)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if bin_of != at[lo]:
                    bin_of, residual = at[lo], lack * share[int(at[lo])]
                shard[lo:hi] = place(vectors[lo:hi], residual, weights)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(shard)], names=schema.names)

    return rows.mapInArrow(run, schema)


def shard_documents(docs: DataFrame, stages: Stages, text: str = "text", shards: int = SHARDS, weights=WEIGHTS, drop: bool = False, per_bin: int = BIN) -> DataFrame:
    """``docs`` with size, text_crc32, n_words, shard and slot (the row's place in its shard, from 0)."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    rows = stages.keep(measured(docs, text, drop).withColumn("__row", F.monotonically_increasing_id()), "rows")
    groups = stages.keep(rows.groupBy("__key").agg(F.sum("size").alias("size"), F.sum("n_words").alias("n_words"), F.count(F.lit(1)).alias("rows")), "groups")
    totals = np.maximum(np.array([_total(groups)[0][c] for c in MEASURES], float), 1.0)
    weights = np.array(weights, float)
    load = F.greatest(*[F.col(c) / F.lit(float(t)) for c, t in zip(MEASURES, totals, strict=True)]) * shards
    groups = groups.withColumn("load", load)

    # groups beyond a shard, in pieces: at most 3 * shards groups and 3 * shards / HEAVY pieces
    over = [(bytes(r["__key"]), ceil(r["load"] / HEAVY)) for r in groups.filter("load > 1").select("__key", "load").collect()]
    cut = spark.createDataFrame(over, "__key binary, __pieces int")
    rows = rows.join(F.broadcast(cut), "__key", "left")
    rows = rows.withColumn("__piece", F.coalesce(F.pmod(F.xxhash64("__row"), F.col("__pieces")), F.lit(0)).cast("int")).drop("__pieces")
    pieces = rows.join(F.broadcast(cut.select("__key")), "__key", "left_semi").groupBy("__key", "__piece").agg(F.sum("size").alias("size"), F.sum("n_words").alias("n_words"), F.count(F.lit(1)).alias("rows"))
    heavy = groups.filter((F.col("load") > HEAVY) & (F.col("load") <= 1)).select("__key", F.lit(0).alias("__piece"), *MEASURES)
    large = [(bytes(r["__key"]), r["__piece"], np.array([r[c] for c in MEASURES]) / totals) for t in ([pieces, heavy] if over else [heavy]) for r in t.collect()]
    large.sort(key=lambda r: (-float(r[2].max()), r[0], r[1]))
    residual = np.full((shards, 3), 1 / shards)
    where = place(np.array([r[2] for r in large]).reshape(-1, 3), residual, weights)
    listed = spark.createDataFrame([(k, p, int(s)) for (k, p, _), s in zip(large, where, strict=True)], "__key binary, __piece int, shard int")

    light = place_groups(groups.filter(F.col("load") <= HEAVY).select("__key", *MEASURES), residual, totals, stages, weights, per_bin)
    placed = rows.join(F.broadcast(listed), ["__key", "__piece"])
    if light:
        map_of = light[0]
        for t in light[1:]:
            map_of = map_of.union(t)
        rest = rows.join(F.broadcast(listed.select("__key").distinct()), "__key", "left_anti") if large else rows
        placed = placed.unionByName(rest.join(map_of, "__key"))
    return numbered(placed.drop("__key", "__piece"), stages).drop("__row")


def numbered(rows: DataFrame, stages: Stages) -> DataFrame:
    """``rows`` with ``slot``: the place in the shard by (id, size, checksum, number), from prefix counts of a range sort."""
    spark = rows.sparkSession
    order = [F.col(c) for c in ("shard", "doc_id", "size", "text_crc32", "__row") if c in rows.columns]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    schema = T.StructType(rows.schema.fields + [T.StructField("__within", T.LongType())])
    names, at = rows.columns, rows.columns.index("shard")

    def count(batches):
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            shard = b.column(at).to_numpy()
            within = np.empty(len(shard), np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if last != shard[lo]:
                    last, seen = shard[lo], 0
                within[lo:hi] = np.arange(seen, seen + hi - lo)
                seen += int(hi - lo)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(within)], names=[*names, "__within"])

    rows = stages.keep(rows.mapInArrow(count, schema), "sorted")
    # one row for each shard and partition that holds it: shards + partitions rows at most
    counts = sorted((r["shard"], r["__part"], r["count"]) for r in rows.groupBy("shard", "__part").count().collect())
    run: dict[int, int] = {}
    offsets = []
    for s, p, c in counts:
        offsets.append((s, p, run.get(s, 0)))
        run[s] = run.get(s, 0) + c
    offsets = spark.createDataFrame(offsets, "shard int, __part int, __offset long")
    out = rows.join(F.broadcast(offsets), ["shard", "__part"]).withColumn("slot", F.col("__offset") + F.col("__within"))
    return out.drop("__part", "__within", "__offset")


def write_shards(docs: DataFrame, path: str, stages: Stages, **how) -> None:
    """The documents as one folder a shard, each in the order of its slots."""
    out = shard_documents(docs, stages, **how)
    out.repartition(how.get("shards", SHARDS), "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("errorifexists").parquet(path)
