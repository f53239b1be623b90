"""Two versions of a table compared by trees of hashes: only rows of differing buckets meet."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bucket number that a level of the tree tells apart, and the levels below the root.
FAN, DEPTH = 4, 4


def _bucket(key: Sequence[str], depth: int):
    return F.shiftrightunsigned(F.xxhash64(*[F.col(c).cast("string") for c in key]), 64 - FAN * depth)


def digest(df: DataFrame, key: Sequence[str], columns: Sequence[str], depth: int = DEPTH) -> DataFrame:
    """(level, node, n, sum, mix): the tree of a table, to be stored beside it.

    A leaf sums up its rows' hashes, as 64-bit sums and exclusive ors of two hashes, which no order of the rows
    changes; a node does so for what is below it.  One aggregation with partial sums, then a small table.
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in [*key, *columns]]
    one, two = F.xxhash64(*cells), F.xxhash64(F.lit("second"), *cells)
    # sums wrap around in 64 bits: halves are added apart, as integer sums may be checked for overflow
    rows = df.select(_bucket(key, depth).alias("node"), one.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), F.shiftrightunsigned(one, 32).alias("high"), two.alias("mix"))
    leaves = rows.groupBy("node").agg(F.count("*").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.bit_xor("mix").alias("mix"))
    up = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftrightunsigned("node", FAN * (depth - k)).alias("node")) for k in range(depth + 1)]))
    return leaves.select(up.alias("at"), "n", "low", "high", "mix").groupBy("at.level", "at.node").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.bit_xor("mix").alias("mix"))


def differing(a: DataFrame, b: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(node): the leaves in which two digests differ, from the root down: below equal nodes nothing is compared."""
    open_ = None
    for level in range(depth + 1):
        x, y = (d.filter(F.col("level") == level).drop("level") for d in (a, b))
        if open_ is not None:
            above = open_.select(F.col("node").alias("above"))
            x, y = (d.join(above, F.shiftrightunsigned(d["node"], FAN) == F.col("above"), "left_semi") for d in (x, y))
        y = y.select("node", F.struct("n", "low", "high", "mix").alias("y"))
        met = x.select("node", F.struct("n", "low", "high", "mix").alias("x")).join(y, "node", "full_outer")
        open_ = met.filter(~F.col("x").eqNullSafe(F.col("y"))).select("node")
    return open_


def differences(old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str], keep: Callable[[DataFrame], DataFrame], depth: int = DEPTH) -> DataFrame:
    """(key, event, changed): ADDED, REMOVED or CHANGED rows, with the names of the changed columns.

    Rows are hashed where they are; only rows of differing leaves are shuffled and compared.  Keys are unique.
    """
    trees = [keep(digest(d, key, columns, depth)) for d in (old, new)]
    leaves = keep(differing(*trees, depth))  # 2 ** (FAN * depth) rows at most
    side = lambda d, p: d.withColumn("_leaf", _bucket(key, depth)).join(F.broadcast(leaves.withColumnRenamed("node", "_leaf")), "_leaf", "left_semi").select(*key, F.lit(True).alias(f"_{p}"), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    met = side(old, "old").join(side(new, "new"), list(key), "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")), F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    event = F.when(F.col("_old").isNull(), "ADDED").when(F.col("_new").isNull(), "REMOVED").otherwise("CHANGED")
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    return met.select(*key, event.alias("event"), F.when(both, changed).otherwise(F.array().cast("array<string>")).alias("changed")).filter((F.col("event") != "CHANGED") | (F.size("changed") > 0))


def within_tolerance(golden: DataFrame, now: DataFrame, tolerances: dict[str, float], default: float = 0.0) -> DataFrame:
    """(metric, golden, now, tolerance, verdict) of metrics (metric, value): relative deviations against their bounds; MISSING and NEW ones fail."""
    allowed = F.lit(default)
    for name, t in tolerances.items():
        allowed = F.when(F.col("metric") == name, t).otherwise(allowed)
    met = golden.select("metric", F.col("value").alias("golden")).join(now.select("metric", F.col("value").alias("now")), "metric", "full_outer").withColumn("tolerance", allowed)
    off = F.abs(F.col("now") - F.col("golden")) > F.col("tolerance") * F.abs("golden")
    verdict = F.when(F.col("now").isNull(), "MISSING").when(F.col("golden").isNull(), "NEW").when(off, "OFF").otherwise("OK")
    return met.withColumn("verdict", verdict)
