"""Mixing sources to target weights.

Every document gets a hash-random key.  Documents are range-sorted by (source, key); the
distributed prefix sum of their sizes is each partition's running sum plus the totals of the
partitions before it.  A source with target t and size s takes floor(t / s) whole epochs and,
of the last epoch, the documents from the start of the order up to the budget; the document
at the cut gives just the words that are missing, so a source's words come within one of its
target.

Targets: sources in code point order (null last) weigh 3, 1, 2, repeating, and share
``share`` of all sizes; none exceeds ``most`` times its source's size, and what is above is
shared out again by weight among the others until none is above.

Cases: null text has size 0 and takes nothing; a source of size 0 has target 0; a null source
is a source of its own, last; repeated rows (also of one id) are rows of their own, ordered by
key, id and size, and rows equal in all three are interchangeable; an empty table gives an
empty result.  Source sizes are one row a source: they go to the driver, which needs them to
level the targets; the number of sources is taken to be small beside the documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stages, append_columns, byte_view

WEIGHTS = (3, 1, 2)


def targets_of(sizes: dict[str | None, int], weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target of each source; see the module's docstring."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left, free = share * sum(sizes.values()), list(order)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in over]
    return out


def words_in(arr: pa.Array) -> np.ndarray:
    """Number of runs of bytes other than ASCII white space in each text; null gives 0."""
    data, offsets = byte_view(arr)
    lo, hi = int(offsets[0]), int(offsets[-1])
    part, at = data[lo:hi], offsets - lo
    space = (part == 32) | ((part >= 9) & (part <= 13))
    begins = ~space
    begins[1:] &= space[:-1]
    heads = at[:-1][at[1:] > at[:-1]]
    begins[heads] = ~space[heads]
    total = np.concatenate([[0], np.cumsum(begins)])
    return total[at[1:]] - total[at[:-1]]


def with_sizes(docs: DataFrame, text: str = "text", size: str = "size") -> DataFrame:
    """``docs`` with the number of words in place of the text.

    The bytes are scanned in Arrow batches: a regular expression in SQL makes an object of every word.
    """
    return append_columns(docs, text, lambda: lambda arr: {size: pa.array(words_in(arr), pa.int64())}, [T.StructField(size, T.LongType())], drop=True)


def draw(rows: DataFrame, stages: Stages, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size) rows with source_size, target, epochs and taken.

    ``epochs`` whole copies and ``taken - epochs * size`` words of one more copy.
    """
    spark = rows.sparkSession
    rows = rows.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))))
    rows = stages.keep(rows, "sizes")
    sizes = {r["source"]: int(r["n"] or 0) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    targets = targets_of(sizes, weights, share, most)
    plan = [(s, sizes[s], float(t), int(t // sizes[s]) if sizes[s] else 0) for s, t in targets.items()]
    plan = [(*p, int(p[2]) - p[3] * p[1]) for p in plan]
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("epochs", T.LongType()), T.StructField("rest", T.LongType())])
    plan = spark.createDataFrame(plan, schema)

    # a null source sorts last, and (source, key) is the only order used from here on
    order = [F.col("source").isNull(), F.col("source"), F.col("key"), F.col("doc_id"), F.col("size")]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    dealt = stages.keep(prefix_in_partition(dealt), "dealt")
    totals = dealt.groupBy("source", "part").agg(F.sum("size").alias("total"))
    # one row for each source and partition that holds it: sources + partitions rows at most
    before = sorted(((r["source"] is None, r["source"] or "", r["part"], int(r["total"])) for r in totals.collect()), key=lambda r: r[2])
    run: dict[tuple[bool, str], int] = {}
    offsets = []
    for null, s, part, total in before:
        offsets.append((None if null else s, part, run.get((null, s), 0)))
        run[null, s] = run.get((null, s), 0) + total
    offsets = spark.createDataFrame(offsets, T.StructType([T.StructField("source", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("offset", T.LongType())]))
    out = dealt.alias("d").join(F.broadcast(offsets).alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.part") == F.col("o.part")))
    out = out.join(F.broadcast(plan).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    start = F.col("offset") + F.col("within")
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    return out.select(
        "d.doc_id", "d.source", "d.size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"),
        *[F.col(f"d.{c}").alias(c) for c in rows.columns if c not in ("doc_id", "source", "size", "key")],
    )


def prefix_in_partition(df: DataFrame) -> DataFrame:
    """Adds ``within``: the sum of the sizes of a source's earlier rows in the sorted partition."""
    schema = T.StructType(df.schema.fields + [T.StructField("within", T.LongType())])
    names = df.columns
    s_at, n_at = names.index("source"), names.index("size")

    def run(batches):
        last, carried = (), 0
        for b in batches:
            if not b.num_rows:
                continue
            source, size = b.column(s_at).to_pylist(), b.column(n_at).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size)
            within = ends - size
            cuts = [0] + [i for i in range(1, len(source)) if source[i] != source[i - 1]] + [len(source)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                base = carried if last == (source[lo],) else 0
                within[lo:hi] += base - (int(ends[lo]) - int(size[lo]))
                last, carried = (source[lo],), int(within[hi - 1] + size[hi - 1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(within)], names=[*names, "within"])

    return df.mapInArrow(run, schema)


def mix_documents(docs: DataFrame, stages: Stages, **how) -> DataFrame:
    """(doc_id, source, size, source_size, target, epochs, taken) for every document."""
    return draw(with_sizes(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size"), stages, **how)


def first_words(text, n):
    """The text up to the end of its n-th word."""
    pieces = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")
