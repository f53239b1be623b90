"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Units are UTF-8 bytes, the order is 4, one model a language.  A text is read after three bytes
0, so the first bytes have contexts as well.  Counts of the highest order are occurrences in
trusted texts; those of lower orders are numbers of different preceding bytes; each order has
its own three discounts, from its numbers of n-grams seen once to four times; the lowest one
is interpolated with 1/256.

Nothing but counts is gathered, and they are gathered over all trusted texts and for all
documents.  Texts are taken in blocks of about ``BLOCK_BYTES``; a block hands on its different
n-grams with their trusted counts.  The counts of all blocks are joined, order by order, to
n-gram probabilities (tables sharded by language and n-gram); the probabilities go back to
the blocks that asked for them, and there give each document's perplexity.  A document is
kept if its perplexity is at most its language's quantile ``quantile`` over the trusted documents
that the model has not seen: one trusted id in ``HELD`` is held out from the counts (by crc32).
The quantile is Spark's approximate one, within 1/10 000 of the rank.

Blocks are numbered and written once, packed, by one scan of the documents; both passes read
them from there, so a block's texts and its n-grams belong together however files are split.
That table is bucketed by block, so the join with the probabilities doesn't shuffle the texts.
An n-gram that a block's table lacks is an error.

Cases: null or empty text: n_bytes 0, null perplexity, not kept; a null language, or one
without trusted text, uses the model and the quantile of all trusted text (``ANY``); a language
without held-out text uses the quantile over all held-out text, and if there is none at all, that
over the texts of its model; without
any trusted text every perplexity is null and every document with text is kept; several
labels of one id: trusted if any says so; rows that repeat an id are scored one by one; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SMALL_ROWS, Stages, by_bytes, byte_view, fold, small_batches

ORDER, BLOCK_BYTES, PIECE_BYTES, ANY = 4, 12 << 20, 1 << 18, "*"
PART_ROWS = 1 << 24  # blocks of a scan partition at most
HELD = 10


def codes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, as uint32, and each row's number of bytes."""
    lens = np.diff(offsets)
    total = int(lens.sum())
    text = data[offsets[0] : offsets[-1]].astype(np.uint32)
    code = text.copy()
    first = np.cumsum(lens) - lens  # a row's bytes have no context from the row before
    for i in range(1, ORDER):
        back = np.zeros(total, np.uint32)
        back[i:] = text[: max(total - i, 0)]
        for j in range(i):
            back[np.minimum(first + j, first + np.maximum(lens - 1, 0))[lens > j]] = 0
        code |= back << np.uint32(8 * i)
    return code, lens


def by_lang(langs: pa.Array):
    """(language, places) of a column."""
    names = np.array(langs.to_pylist(), object).astype(str)
    for lang in np.unique(names):
        yield str(lang), pa.array(np.flatnonzero(names == lang))


def blocks(batches):
    """(block number, rows) of a task's input, text in the last column: about BLOCK_BYTES a block, over batches' bounds."""
    first = TaskContext.get().partitionId() * PART_ROWS
    k, size = 0, 0
    held: list[pa.RecordBatch] = []
    joined = lambda: pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for b in batches:
        if not b.num_rows:
            continue
        _, offsets = byte_view(b.column(b.num_columns - 1))
        for lo, hi in by_bytes(offsets, BLOCK_BYTES):
            held.append(b.slice(lo, hi - lo))
            size += int(offsets[hi] - offsets[lo])
            if size >= BLOCK_BYTES:
                yield first + k, joined()
                k, size, held = k + 1, 0, []
    if held:
        yield first + k, joined()


GRAMS = T.StructType([T.StructField("block", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("code", T.LongType()), T.StructField("seen", T.LongType())])


def unpacked(texts: pa.Scalar) -> pa.RecordBatch:
    """The rows that ``packed`` wrote."""
    return pa.ipc.open_stream(texts.as_py()).read_all().combine_chunks().to_batches()[0]


def grams(texts: DataFrame) -> DataFrame:
    """(block, lang, code, seen): the n-grams of each block and their occurrences in trusted texts.

    ``texts``: (block, texts) of ``packed``, whose rows are doc_id, lang, trusted, held, text; trusted and not held-out texts are counted."""

    def run(batches):
        for number, b in ((k.as_py(), unpacked(t)) for batch in batches for k, t in zip(batch.column(0), batch.column(1), strict=True)):
            for lang, rows_ in by_lang(b.column(1)):
                part = b.take(rows_)  # one language at a time, as a block's n-grams are held in memory
                data, offsets = byte_view(part.column(4))
                flag = lambda c: part.column(c).to_numpy(zero_copy_only=False).astype(bool)  # noqa: B023, E731
                good = flag(2) & ~flag(3)
                found, plain = [], []
                for lo, hi in by_bytes(offsets, PIECE_BYTES):
                    code, lens = codes_of(data, offsets[lo : hi + 1])
                    trusted = np.repeat(good[lo:hi], lens)
                    found.append(np.unique(code[trusted], return_counts=True))
                    plain.append(np.unique(code[~trusted]))
                kinds, at = np.unique(np.concatenate([*(k for k, _ in found), *plain]), return_inverse=True)
                times = np.concatenate([*(c for _, c in found), np.zeros(len(at) - sum(len(c) for _, c in found), np.int64)])
                seen = np.bincount(at, times, len(kinds)).astype(np.int64)
                n = len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array([lang] * n, pa.string()), pa.array(kinds.astype(np.int64)), pa.array(seen)], names=GRAMS.names)

    return texts.mapInArrow(run, GRAMS)


def discounts(counts: DataFrame, order: int) -> list[tuple]:
    """(lang, order, D1, D2, D3) by the numbers of n-grams seen once to four times; a few rows a language."""
    out = []
    n = counts.groupBy("lang").agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
    for r in n.collect():
        n1, n2, n3, n4 = (r[f"n{i}"] for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        out.append((r["lang"], order, *(float(min(max(x, 0.05), i + 0.95)) for i, x in enumerate(d))))
    return out


def probabilities(asked: DataFrame, counts: DataFrame, stages: Stages) -> DataFrame:
    """(lang, code, logp) for the n-grams ``asked`` (lang, code), by ``counts`` (lang, code, c) of trusted ones."""
    spark = asked.sparkSession
    low = lambda k: F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("code")
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = stages.keep(tables[k + 1].groupBy("lang", low(k)).agg(F.count("*").alias("c")), f"c{k}")
    d = [row for k in tables for row in discounts(tables[k], k)]
    d = spark.createDataFrame(d, "lang string, k int, d1 double, d2 double, d3 double")
    p = None
    for k in range(1, ORDER + 1):
        need = asked if k == ORDER else asked.select("lang", low(k)).distinct()
        mine = F.broadcast(d.filter(F.col("k") == k).drop("k"))  # a row a language
        own = lambda i: F.col(f"d{i}")
        c = F.col("c")
        context = tables[k].withColumn("ctx", F.shiftright("code", 8)).groupBy("lang", "ctx").agg(F.sum(c).alias("total"), *[F.count_if(x).alias(f"n{i}") for i, x in ((1, c == 1), (2, c == 2), (3, c > 2))])
        context = context.join(mine, "lang").select("lang", "ctx", "total", ((own(1) * F.col("n1") + own(2) * F.col("n2") + own(3) * F.col("n3")) / F.col("total")).alias("back"))
        less = F.when(c == 1, own(1)).when(c == 2, own(2)).otherwise(own(3))
        seen = tables[k].join(mine, "lang").select("lang", "code", (c - less).alias("share"))
        x = need.withColumn("ctx", F.shiftright("code", 8)).join(seen, ["lang", "code"], "left").join(context, ["lang", "ctx"], "left")
        if p is None:
            x = x.withColumn("lower", F.lit(1 / 256))
        else:
            x = x.withColumn("key", F.col("code").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(p.withColumnsRenamed({"code": "key", "p": "lower"}), ["lang", "key"])
        value = F.coalesce(F.col("share") / F.col("total"), F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("lower")
        q = stages.keep(x.select("lang", "code", value.alias("p")), f"p{k}")
        if p is not None:
            stages.drop(p)
        p = q
    return p.select("lang", "code", F.log("p").cast("float").alias("logp"))


class Lookup:
    """logp of n-grams of one language in a block: a table over pairs of byte pairs, or a search if that is too large."""

    def __init__(self, code: np.ndarray, logp: np.ndarray):
        order = np.argsort(code)
        self.code, self.logp = code[order].astype(np.uint32), logp[order].astype(np.float32)
        pairs = np.unique(np.concatenate([self.code >> np.uint32(16), self.code & np.uint32(65535)]))
        self.n = len(pairs)
        self.dense = None
        if self.n**2 <= 1 << 22:
            self.n += 1  # a last place for pairs that the table lacks
            self.at = np.full(65536, self.n - 1, np.int32)
            self.at[pairs] = np.arange(self.n - 1)
            self.dense = np.full(self.n**2, np.nan, np.float32)
            self.dense[self.at[self.code >> np.uint32(16)].astype(np.int64) * self.n + self.at[self.code & np.uint32(65535)]] = self.logp

    def __call__(self, code: np.ndarray) -> np.ndarray:
        if self.dense is None:
            at = np.searchsorted(self.code, code)
            if len(code) and (at.max() >= len(self.code) or (self.code[at] != code).any()):
                raise KeyError("an n-gram isn't in its block's table")
            return self.logp[at]
        out = self.dense[self.at[code >> np.uint32(16)] * np.int32(self.n) + self.at[code & np.uint32(65535)]]
        if np.isnan(out).any():
            raise KeyError("an n-gram isn't in its block's table")
        return out


SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("trusted", T.BooleanType()), T.StructField("held", T.BooleanType()), T.StructField("n_bytes", T.LongType()), T.StructField("total", T.DoubleType())])


def packed(rows: DataFrame) -> DataFrame:
    """(block, texts): each block's rows as one compressed Arrow stream."""

    def run(batches):
        for number, b in blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "texts"])

    small_batches(rows)
    return rows.mapInArrow(run, T.StructType([T.StructField("block", T.LongType()), T.StructField("texts", T.BinaryType())]))


def scored(both: DataFrame) -> DataFrame:
    """Sums of logp of each document, from (texts, table): table is an array of (lang, codes, logps)."""

    def run(batches):
        for b in batches:
            for texts, entries in zip(b.column(0), b.column(1), strict=True):
                tables = {e["lang"]: e for e in entries.as_py() or []}
                rows = unpacked(texts)
                for lang, places in by_lang(rows.column(1)):
                    part = rows.take(places)
                    data, offsets = byte_view(part.column(4))
                    lens = np.diff(offsets)
                    total = np.zeros(len(lens))
                    if lens.any():  # without a table of the language: KeyError
                        look = Lookup(np.frombuffer(tables[lang]["codes"], np.uint32), np.frombuffer(tables[lang]["logps"], np.float32))
                        for lo, hi in by_bytes(offsets, PIECE_BYTES):
                            logp = look(codes_of(data, offsets[lo : hi + 1])[0])
                            ends = offsets[lo : hi + 1] - offsets[lo]
                            for i in np.flatnonzero(lens[lo:hi]).tolist():
                                total[lo + i] = logp[ends[i] : ends[i + 1]].sum(dtype=np.float64)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(3), pa.array(lens), pa.array(total)], names=SCORED.names)

    return both.mapInArrow(run, SCORED)


def bundled(answers: DataFrame) -> DataFrame:
    """(block, table): the answers (block, lang, code, logp) of each block, packed; a block asks for a bounded number."""
    out = T.StructType([T.StructField("block", T.LongType()), T.StructField("table", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("codes", T.BinaryType()), T.StructField("logps", T.BinaryType())])))])

    def run(batches):
        held: list[pa.RecordBatch] = []
        block = None

        def pack():
            t = pa.Table.from_batches(held)
            langs = np.array(t.column(1).to_pylist(), object)
            code, logp = t.column(2).to_numpy().astype(np.uint32), t.column(3).to_numpy()
            entries = [{"lang": str(x), "codes": code[langs == x].tobytes(), "logps": logp[langs == x].tobytes()} for x in sorted(set(langs))]
            return pa.RecordBatch.from_pylist([{"block": block, "table": entries}], schema=pa.schema([("block", pa.int64()), ("table", pa.list_(pa.struct([("lang", pa.string()), ("codes", pa.binary()), ("logps", pa.binary())])))]))

        for b in batches:
            ids = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                if held and ids[lo] != block:
                    yield pack()
                    held = []
                block = int(ids[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield pack()

    return answers.select("block", "lang", "code", "logp").repartition("block").sortWithinPartitions("block").mapInArrow(run, out)


def classify(docs: DataFrame, trusted: DataFrame, stages: Stages, quantile: float = 0.995) -> DataFrame:
    """(doc_id, lang, trusted, held, n_bytes, perplexity, threshold, kept) of ``docs`` (doc_id, lang, text);
    ``trusted`` holds the doc_id of trusted documents."""
    ids = stages.keep(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct().withColumn("trusted", F.lit(True)), "trusted")
    side = F.broadcast(ids) if ids.count() <= SMALL_ROWS else ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").join(side, "doc_id", "left")
    ok = F.coalesce("trusted", F.lit(False)) & (F.coalesce(F.octet_length("text"), F.lit(0)) > 0)
    held = ok & (fold(F.col("doc_id"), HELD) == 0)
    known = sorted(r["lang"] for r in rows.filter(ok & ~held & F.col("lang").isNotNull()).select("lang").distinct().collect())
    lang = F.when(F.col("lang").isin(known), F.col("lang")).otherwise(F.lit(ANY)) if known else F.lit(ANY)
    rows = rows.select("doc_id", lang.alias("lang"), ok.alias("trusted"), held.alias("held"), F.coalesce("text", F.lit("")).alias("text"))

    texts = stages.keep_bucketed(packed(rows), "block", "blocks")
    found = stages.keep(grams(texts), "grams")
    asked = stages.keep(found.groupBy("lang", "code").agg(F.sum("seen").alias("c")), "asked")
    counts = asked.filter("c > 0")
    if not asked.filter(F.col("lang") == ANY).isEmpty():
        every = counts.groupBy("code").agg(F.sum("c").alias("c")).select(F.lit(ANY).alias("lang"), "code", "c")
        counts = stages.keep(counts.filter(F.col("lang") != ANY).unionByName(every), "counts")
    if counts.isEmpty():
        out = rows.select("doc_id", "lang", "trusted", "held", F.octet_length("text").cast("long").alias("n_bytes"))
        return out.select("*", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), (F.col("n_bytes") > 0).alias("kept"))
    logp = stages.keep(probabilities(asked.select("lang", "code"), counts, stages), "logp")
    small = logp.count() <= SMALL_ROWS
    answers = bundled(found.select("block", "lang", "code").join(F.broadcast(logp) if small else logp, ["lang", "code"]))
    both = texts.join(answers, "block", "left").select("texts", "table")
    score = stages.keep(scored(both), "scores")
    stages.drop(texts, found)
    perplexity = F.when(F.col("n_bytes") > 0, F.round(F.exp(-F.col("total") / F.col("n_bytes")), 6))
    score = score.select("doc_id", "lang", "trusted", "held", "n_bytes", perplexity.alias("perplexity"))
    # a row a language and one (null) for all
    held = F.percentile_approx(F.when(F.col("held"), F.col("perplexity")), quantile, 10_000)
    cuts = {r["lang"]: (r["held"], r["seen"]) for r in score.filter("trusted").rollup("lang").agg(held.alias("held"), F.percentile_approx("perplexity", quantile, 10_000).alias("seen")).collect()}
    every = cuts.get(None, (None, None))
    first = lambda *x: next((v for v in x if v is not None), None)
    of = lambda x: first(cuts.get(x, (None, None))[0], every[0], cuts.get(x, (None, None))[1], every[1]) if x != ANY else first(*every)
    limits = docs.sparkSession.createDataFrame([(x, of(x)) for x in [*known, ANY]], "lang string, threshold double")
    out = score.join(F.broadcast(limits), "lang", "left")
    return out.select("doc_id", "lang", "trusted", "held", "n_bytes", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
