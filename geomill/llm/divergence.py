"""Audit of how the sources of a language differ in their words, by hash-consed segment trees.

A term is a maximal run of letters A-Z, a-z and of all characters beyond ASCII, A-Z lower-cased.  A
language keeps its terms that at least ``LEAST_DOCS`` of its documents hold; V is their number.  A group
is a (language, source).  With N the group's count over kept terms, a term that occurs c times in
it has p = 1 + floor(10^9 (c + 1) / (N + V)); two groups differ in a term by f(p, q) = floor((p - q)^2 / q).

Trees.  The kept terms of a language are dealt, by a hash, into segments of about ``WIDTH`` and numbered
in a segment by falling count.  A group's counts in a segment are the leaves of a binary tree,
zero where the group lacks the term.  All groups of a segment are hash-consed together, level by
level: equal leaves, and equal pairs of children, are one node, wherever and in whichever group
they stand; runs of rare terms collapse into few nodes.

Traversal.  Two trees are walked at once from their roots.  The pairs of nodes met at a level
are made unique (the memo), so a pair of nodes is opened, and on the way back priced,
once however often it occurs.  Leaves are priced exactly in both directions, with each group's N; pairs
of groups share a walk in batches of bounded size.  The sums over segments add up to the value of a
pair of groups.  Sources are taken in blocks of ``SOURCES``, so a task holds one segment of two blocks.

Cases: null text, language and source count as ''; a group without a kept term has N = 0 and takes part in
all pairs (value 0 where V = 0); repeated rows and ids are documents of their own; equal values are ranked
by item; very long texts are counted whole; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import SMALL_ROWS, Stages, hand_back, small_batches

LEAST_DOCS, RANKS = 3, 200
#: Terms of a segment (on average), sources of a block, node pairs that a walk holds at once.
WIDTH, SOURCES, AT_ONCE = 3600, 64, 1 << 20
TERM = re.compile(rb"[a-z\x80-\xff]+")
#: Counts that a task holds before it hands them on.
HELD = 400_000
PADDING = -1  # the leaf beyond a segment's last term: priced 0


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, tf, df), added up within tasks; df is the number of documents."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "term")] + [T.StructField(c, T.LongType()) for c in ("tf", "df")])

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        lang, source, term, tf, df = [], [], [], [], []
        for (g, s), (times, docs_) in held.items():
            lang += [g] * len(times)
            source += [s] * len(times)
            term += [t.decode() for t in times]
            tf += times.values()
            df += [docs_[t] for t in times]
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.string()), pa.array(tf, pa.int64()), pa.array(df, pa.int64())], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        n = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = Counter(TERM.findall((text.as_py() or "").encode("utf-8", "surrogatepass").lower()))
                times, docs_ = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(times)
                times.update(words)
                docs_.update(words.keys())
                n += len(times) - before
                if n > HELD:
                    yield rows(held)
                    held, n = {}, 0
        if n:
            yield rows(held)
        del held
        hand_back()

    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")], "text")
    small_batches(docs)
    return docs.mapInArrow(run, schema).groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _small(side: DataFrame, n: int) -> DataFrame:
    return F.broadcast(side) if n <= SMALL_ROWS else side


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


#: 10^9 = 31250 * 32000: divided in two steps, counts up to 10^14 stay within 64 bits.
STEPS = (31_250, 32_000)


def price_of(count: Column, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total), exactly."""
    scaled = (count + 1) * STEPS[0]
    return 1 + _div(scaled, total) * STEPS[1] + _div((scaled % total) * STEPS[1], total)


def prices(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``price_of`` for arrays."""
    first, rest = np.divmod((count + 1) * STEPS[0], total)
    return 1 + first * STEPS[1] + (rest * STEPS[1]) // total


def prepared(docs: DataFrame, stages: Stages, least_docs: int = LEAST_DOCS, width: int = WIDTH, sources: int = SOURCES) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, n, v, segments, block, blocks) and counts of kept terms (lang, source, term, tf, total, v, lang_n, segment, id, size)."""
    found = stages.keep(counts(docs), "counts")
    kept = found.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= least_docs).drop("df")
    kept = stages.keep(kept, "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
    langs = stages.keep(langs.withColumn("segments", F.ceil(F.col("v") / width).cast("int")), "langs")
    n_langs = langs.count()
    here = Window.partitionBy("lang", "segment")
    kept = kept.join(_small(langs, n_langs), "lang").withColumn("segment", F.pmod(F.xxhash64("term"), F.col("segments")).cast("int"))
    kept = kept.withColumn("id", F.row_number().over(here.orderBy(F.desc("total"), "term")) - 1).withColumn("size", F.count(F.lit(1)).over(here).cast("int"))
    terms = stages.keep(found.drop("df").join(kept, ["lang", "term"]), "terms")
    stages.drop(found)
    every = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = every.join(terms.groupBy("lang", "source").agg(F.sum("tf").alias("n")), ["lang", "source"], "left")
    groups = groups.join(_small(langs.select("lang", "v", "segments"), n_langs), "lang", "left").fillna(0, ["n", "v", "segments"])
    of_lang = Window.partitionBy("lang")
    groups = groups.withColumn("block", F.floor((F.row_number().over(of_lang.orderBy("source")) - 1) / sources).cast("int"))
    return stages.keep(groups.withColumn("blocks", (F.max("block").over(of_lang) + 1).cast("int")), "groups"), terms


def leading_terms(groups: DataFrame, terms: DataFrame, ranks: int = RANKS) -> DataFrame:
    """Part ``term``: each group's terms that it has more of than its language, by f, to ``ranks``."""
    n = groups.select("lang", "source", "n")
    p, q = price_of(F.col("tf"), F.col("n") + F.col("v")), price_of(F.col("total"), F.col("lang_n") + F.col("v"))
    out = terms.join(_small(n, n.count()), ["lang", "source"]).withColumn("p", p).withColumn("q", q).filter("p > q")
    out = out.withColumn("value", F.expr("((p - q) * (p - q)) div q"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    out = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= ranks)
    return out.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def pairs(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """Part ``pair``: every ordered pair of a language's sources, valued over all its kept terms."""
    sizes = terms.groupBy("lang", "segment").agg(F.first("size").alias("size"))
    leaves = terms.groupBy("lang", "source", "segment").agg(F.collect_list(F.struct("id", "tf")).alias("leaves"))  # a segment's width at most
    spread = groups.filter("segments > 0").withColumn("segment", F.explode(F.expr("sequence(0, segments - 1)")))
    spread = spread.join(sizes, ["lang", "segment"]).join(leaves, ["lang", "source", "segment"], "left")
    at = F.explode(F.expr("transform(sequence(0, blocks - 1), j -> struct(least(block, j) AS x, greatest(block, j) AS y))"))
    spread = spread.withColumn("at", at).select("lang", "segment", "at.x", "at.y", "block", "source", "n", "v", "size", F.col("leaves.id").alias("ids"), F.col("leaves.tf").alias("tfs"))
    parts = spread.groupBy("lang", "segment", "x", "y").applyInArrow(_segment_values, "lang string, source string, item string, value long")
    a, b = (groups.filter("v = 0").select("lang", F.col("source").alias(c)) for c in ("source", "item"))
    parts = parts.unionByName(a.join(b, "lang").filter("source <> item").withColumn("value", F.lit(0).cast("long")))
    summed = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


class Forest:
    """Hash-consed binary trees over the rows of a (trees x 2^d) matrix of leaves.

    ``leaf[i]`` is the value of leaf node i; ``levels[k]`` has the children (left, right) of the nodes k + 1
    above the leaves; ``roots`` has each tree's root.
    """

    def __init__(self, leaves: np.ndarray):
        self.leaf, at = np.unique(leaves, return_inverse=True)
        at = at.reshape(leaves.shape)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        n = len(self.leaf)
        while at.shape[1] > 1:
            nodes, up = np.unique(at[:, 0::2] * n + at[:, 1::2], return_inverse=True)
            self.levels.append(np.divmod(nodes, n))
            at, n = up.reshape(len(at), -1), len(nodes)
        self.roots = at[:, 0]

    def walk(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of trees (a[i], b[i]) with totals n_a[i], n_b[i] the sums of f(a, b) and of f(b, a)."""
        which, left, right = np.arange(len(a)), self.roots[a], self.roots[b]
        opened = []
        for k in range(len(self.levels) - 1, -1, -1):
            lo, hi = self.levels[k]
            n = len(self.levels[k - 1][0]) if k else len(self.leaf)
            key = np.concatenate([(which * n + lo[left]) * n + lo[right], (which * n + hi[left]) * n + hi[right]])
            key, met = np.unique(key, return_inverse=True)  # the memo: a pair of nodes is opened once
            opened.append(met)
            which, right = np.divmod(key, n)
            which, left = np.divmod(which, n)
        c, d = self.leaf[left], self.leaf[right]
        p, q = prices(np.maximum(c, 0), n_a[which]), prices(np.maximum(d, 0), n_b[which])
        square = np.where(c == PADDING, 0, (p - q) * (p - q))
        there, back = square // q, square // p
        for met in reversed(opened):
            half = len(met) // 2
            there, back = there[met[:half]] + there[met[half:]], back[met[:half]] + back[met[half:]]
        return there, back


def _segment_values(rows: pa.Table) -> pa.Table:
    """The values of all pairs of groups of two blocks of sources, over one segment."""
    rows = rows.sort_by([("block", "ascending"), ("source", "ascending")])
    size, v = rows.column("size")[0].as_py(), rows.column("v")[0].as_py()
    total = rows.column("n").to_numpy() + v
    leaves = np.full((rows.num_rows, 1 << max(0, size - 1).bit_length()), PADDING, np.int64)
    leaves[:, :size] = 0
    for i, (ids, tfs) in enumerate(zip(rows.column("ids"), rows.column("tfs"), strict=True)):
        if ids.is_valid:
            leaves[i, ids.values.to_numpy()] = tfs.values.to_numpy()
    forest, block = Forest(leaves), rows.column("block").to_numpy()
    a, b = np.triu_indices(rows.num_rows, 1)
    if rows.column("x")[0].as_py() != rows.column("y")[0].as_py():
        across = block[a] != block[b]
        a, b = a[across], b[across]
    step = max(1, AT_ONCE // leaves.shape[1])
    walks = [forest.walk(a[i : i + step], b[i : i + step], total[a[i : i + step]], total[b[i : i + step]]) for i in range(0, len(a), step)]
    there, back = (np.concatenate([np.zeros(0, np.int64), *[w[k] for w in walks]]) for k in (0, 1))
    source = rows.column("source").combine_chunks()
    one, two = np.concatenate([a, b]), np.concatenate([b, a])
    lang = pa.array([rows.column("lang")[0].as_py()] * len(one), pa.string())
    return pa.table({"lang": lang, "source": source.take(pa.array(one)), "item": source.take(pa.array(two)), "value": pa.array(np.concatenate([there, back]))})


def audit(docs: DataFrame, stages: Stages, least_docs: int = LEAST_DOCS, ranks: int = RANKS, width: int = WIDTH, sources: int = SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts."""
    groups, terms = prepared(docs, stages, least_docs, width, sources)
    return pairs(groups, terms).unionByName(leading_terms(groups, terms, ranks))
