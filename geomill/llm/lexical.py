"""Ranked lexical search over an index stratified by the length normaliser.

A term is a maximal run of ASCII letters and digits and of all characters beyond ASCII; only A-Z
are lower-cased.  With N documents that hold a term, L terms in all and n in a document, its normaliser
is m = 25 + (75 n N) div L; a term with weight w = floor(1000 ln((2N + 2) / (2 df + 1))) and tf
occurrences gives w * ((10^9 tf) div (1000 tf + 8 m)).  All but w is 64-bit integer arithmetic.

Index.  Documents of equal m form a stratum; in it the gain of a posting depends on tf alone.  A stratum is
stored in blocks of bounded size, each a row: the ids of its documents, in order, and for every term
its postings grouped by tf.  The gain is computed once for each tf of a block and term.  Terms
are 64-bit digests, so a wrong posting needs one of a query's terms to meet another one of the corpus
in 64 bits.

Search.  A first pass reads only terms and tf heads (no postings): document frequencies, and for each
stratum the largest tf of each asked term.  From these follows, for every query and
stratum, a bound on the score of its documents.  Strata are visited in the order of their bounds,
in waves of growing number; a stratum whose bound is below the k-th best score found so
far can't hold a result and is never visited (one that equals it is, for ties).  In a task, a block is
scored for all queries that visit its stratum, and only the block's best k are kept, so rows grow
with queries and blocks, not with postings.

Cases: a null text holds no term and isn't ranked, a null query finds nothing; every row of
``queries`` is a query of its own, also where an id repeats, and a term that a query repeats counts each time; rows
that repeat a document's id are documents of their own; a null id ranks last among equal scores; very
long texts are read whole; empty tables give an empty result; columns not named are not read.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import SMALL_ROWS, Stages, hand_back, map_arrow, small_batches

K1_TIMES, LENGTH_SHARE, SCALE = 8, 75, 1_000_000_000
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Most documents and postings of a block, and queries that are searched at once.
BLOCK_DOCS, BLOCK_POSTINGS, QUERIES_AT_ONCE = 4096, 250_000, 512
#: Postings that a task sorts into blocks, on average, where a document's row weighs as ``ROW_POSTINGS`` more.
PART_POSTINGS, ROW_POSTINGS = 1_000_000, 8
#: Blocks of a batch, of Parquet's reader as of Arrow: Spark's reader holds all arrays of a batch on the heap at once, 4096 rows by default, so whole files of blocks.
BATCH_BLOCKS = 1
#: Documents with their postings that Parquet's reader holds at once, and bytes of an Arrow batch of them.
BATCH_DOCS, BATCH_BYTES = 256, 8 << 20
#: The index's files: a row group is closed after so many bytes (and not after 100 rows at the soonest, as by default), pages after each block that fills them.
FILES = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
#: Strata that a query visits in the first wave; each later wave visits so many times more.
FIRST, GROWTH = 16, 8
MEMO = 200_000


class Ids(dict):
    """term -> 64-bit digest, remembered up to ``MEMO`` terms."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        out = self[term] = int.from_bytes(hashlib.blake2b(term, digest_size=8).digest(), "little", signed=True)
        return out


def terms_of(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").lower())  # bytes.lower() knows ASCII only


def counted(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n, postings, terms, tfs) of every document with a term; terms and tfs of one order, ``postings`` long."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("postings", T.LongType()), T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def make():
        ids = Ids()

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            who, n, terms, tfs = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = Counter(terms_of(t.as_py()))
                if c:
                    who.append(i)
                    n.append(c.total())
                    terms.append(np.fromiter(map(ids.__getitem__, c), np.int64, len(c)))
                    tfs.append(np.fromiter(c.values(), np.int32, len(c)))
            return pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(n, pa.int64()), pa.array(map(len, terms), pa.int64()), pa.array(terms, pa.list_(pa.int64())), pa.array(tfs, pa.list_(pa.int32()))], names=schema.names)

        return each

    return map_arrow(docs.select(F.col(doc_id).cast("long"), F.col(text)), make, schema)


INDEX = "m long, docs array<long>, terms array<long>, heads array<int>, tfs array<int>, starts array<int>, places array<int>"


class Index:
    """The stored index: ``blocks`` (``INDEX``), the number of documents and of terms.

    Of a block, term i has the groups heads[i] to heads[i + 1] - 1; group g holds the documents at
    places[starts[g]:starts[g + 1]] with tf = tfs[g].  The groups of a term have falling tf.
    """

    def __init__(self, blocks: DataFrame, n: int, total: int):
        self.blocks, self.n, self.total = blocks, n, total


def build(docs: DataFrame, stages: Stages, text: str = "text", doc_id: str = "doc_id") -> Index:
    """The index over all rows of ``docs``."""
    rows = stages.keep(counted(docs, text, doc_id), "counted")
    # a row for each length of a document: at most sqrt(2 * total) rows, so their tables are small enough for broadcasts
    lengths = stages.keep(rows.groupBy("n").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("postings") + ROW_POSTINGS).alias("load")), "lengths")
    n, total, load = lengths.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("docs", F.col("n") * F.col("docs"), "load"))).first()
    m = F.expr(f"{100 - LENGTH_SHARE} + ({LENGTH_SHARE} * n * {n}L) div {max(total, 1)}L").alias("m")
    parts = max(1, -(-load // PART_POSTINGS))
    # a block at the most, and less where the session asks for so many tasks that a block would be more than half of a task's share
    piece = min(BLOCK_POSTINGS, max(1, load // (2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    strata = lengths.groupBy(m).agg(F.expr(f"ceil(sum(load) / {piece})").cast("long").alias("pieces"))
    # pieces of strata, not ranges of rows: a range of the longest documents holds many times the mean, and equal rows (a third of the table may be one document's copies) lie together
    rows_m = rows.select(m, "doc_id", "terms", "tfs", F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("mix")).join(F.broadcast(strata), "m")
    dealt = rows_m.repartition(parts, "m", F.pmod("mix", "pieces")).sortWithinPartitions("m", F.asc_nulls_last("doc_id")).select("m", "doc_id", "terms", "tfs")
    small_batches(dealt)
    with conf(docs.sparkSession, {READ_ROWS: BATCH_DOCS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}):
        blocks = stages.keep(dealt.mapInArrow(_blocks, INDEX), "index", **FILES)
    stages.drop(rows, lengths)
    return Index(blocks, n, total)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the sorted (m, doc_id, terms, tfs) rows."""
    held: list[pa.RecordBatch] = []  # rows of one stratum, not yet in a block
    docs = postings = 0
    stratum = None
    for b in batches:
        m = b.column(0).to_numpy()
        size = np.diff(b.column(2).offsets.to_numpy())
        lo = 0
        for i in range(len(m)):
            if (m[i] != stratum and (docs or i > lo)) or docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                held.append(b.slice(lo, i - lo))
                yield _block(stratum, held)
                held, docs, postings, lo = [], 0, 0, i
            stratum = m[i]
            docs += 1
            postings += int(size[i])
        held.append(b.slice(lo))
    if docs:
        yield _block(stratum, held)
    hand_back()


def _block(m: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    ids = rows.column(1)
    sizes = np.diff(rows.column(2).offsets.to_numpy())
    term = rows.column(2).flatten().to_numpy(zero_copy_only=False)
    tf = rows.column(3).flatten().to_numpy(zero_copy_only=False)
    place = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = np.lexsort((place, -tf, term))
    term, tf, place = term[order], tf[order], place[order]
    new_term = np.concatenate([[True], term[1:] != term[:-1]])
    new_group = new_term | np.concatenate([[True], tf[1:] != tf[:-1]])
    starts = np.flatnonzero(new_group)
    heads = np.flatnonzero(new_term[starts])
    lists = [ids.to_pylist(), term[new_term], np.append(heads, len(starts)), tf[starts], np.append(starts, len(term)), place]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    arrays = [pa.array([m], pa.int64())] + [pa.array([x], pa.list_(k)) for x, k in zip(lists, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["m", "docs", "terms", "heads", "tfs", "starts", "places"])


READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"


@contextlib.contextmanager
def conf(spark: SparkSession, values: dict[str, int]) -> Iterator[None]:
    """Settings of the session for what runs inside."""
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def few_blocks(spark: SparkSession) -> contextlib.AbstractContextManager[None]:
    """Batches of ``BATCH_BLOCKS`` rows, read and sent to Python, for what runs inside: a block is large."""
    return conf(spark, {READ_ROWS: BATCH_BLOCKS, "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_BLOCKS})


def gain(tf: np.ndarray | int, m: int):
    return (SCALE * tf) // (1000 * tf + K1_TIMES * m)


def weight(n: int, df: int) -> int:
    return floor(1000 * log((2 * n + 2) / (2 * df + 1)))


def search(index: Index, queries: DataFrame, stages: Stages, k: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each query's ``k`` documents of highest score above 0."""
    spark = queries.sparkSession
    asked = stages.keep(queries.filter(F.col(text).isNotNull()).select(F.monotonically_increasing_id().alias("query"), F.col(item).alias("item_id"), F.col(text).alias("text")), "queries")
    found: DataFrame | None = None
    after = -1
    while batch := asked.filter(F.col("query") > after).orderBy("query").limit(QUERIES_AT_ONCE).collect():
        after = batch[-1]["query"]
        ids = Ids()
        wanted = {r["query"]: Counter(map(ids.__getitem__, terms_of(r["text"]))) for r in batch}
        part = _search(index, wanted, stages, k)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "query long, doc_id long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def _search(index: Index, wanted: dict[int, Counter], stages: Stages, k: int) -> DataFrame:
    """(query, doc_id, score) that hold the best ``k`` of each query of a batch."""
    spark = index.blocks.sparkSession
    vocabulary = np.unique(np.array([t for c in wanted.values() for t in c], np.int64))
    heads = index.blocks.select("m", "terms", "heads", "tfs", "starts")
    with few_blocks(spark):
        tops = stages.keep(heads.mapInArrow(functools.partial(_tops, vocabulary), "m long, term long, top int, df long"), "tops")
    df = {r["term"]: r["df"] for r in tops.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # as many as the batch has terms
    weights = {t: weight(index.n, d) for t, d in df.items()}
    asked = [(q, t, c * weights[t]) for q, counts in wanted.items() for t, c in counts.items() if t in weights]
    ask = spark.createDataFrame(asked, "query long, term long, weight long")
    top = tops.groupBy("m", "term").agg(F.max("top").cast("long").alias("top"))
    reach = F.expr(f"weight * (({SCALE}L * top) div (1000L * top + {K1_TIMES}L * m))")
    bounds = top.join(F.broadcast(ask), "term").groupBy("query", "m").agg(F.sum(reach).alias("bound")).filter("bound > 0")
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "m")
    bounds = stages.keep(bounds.withColumn("place", F.row_number().over(order)), "bounds")
    queries = {q: [(t, c * weights[t]) for t, c in counts.items() if t in weights] for q, counts in wanted.items()}
    least = dict.fromkeys(queries, 1)
    found, lo, hi = None, 0, FIRST
    while True:
        floor_of = spark.createDataFrame(list(least.items()), "query long, least long")
        visits = bounds.filter((F.col("place") > lo) & (F.col("place") <= hi)).join(F.broadcast(floor_of), "query").filter("bound >= least")
        visits = stages.keep(visits.groupBy("m").agg(F.collect_list("query").alias("visitors")), "visits")  # a batch of queries at most
        n = visits.count()
        if not n:
            break
        blocks = index.blocks.join(F.broadcast(visits) if n * len(queries) <= 8 * SMALL_ROWS else visits, "m")
        with few_blocks(spark):
            part = stages.keep(blocks.mapInArrow(functools.partial(_score, queries, least, k, vocabulary), "query long, doc_id long, score long"), "scored")
        found = part if found is None else found.union(part)
        best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        kth = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k)
        least |= {r["query"]: r["score"] for r in kth.collect()}  # a row a query of the batch
        lo, hi = hi, hi * GROWTH
    return found if found is not None else spark.createDataFrame([], "query long, doc_id long, score long")


def _tops(vocabulary: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(m, term, largest tf, documents) of the asked terms in each block."""
    for b in batches:
        for r in range(b.num_rows):
            term, head, tf, start = (_of(b, r, c) for c in ("terms", "heads", "tfs", "starts"))
            at = np.flatnonzero(_among(term, vocabulary))
            first = head[at]
            df = start[head[at + 1]] - start[first]
            m = np.full(len(at), b.column("m")[r].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(term[at]), pa.array(tf[first]), pa.array(df.astype(np.int64))], names=["m", "term", "top", "df"])


def _of(b: pa.RecordBatch, row: int, name: str) -> np.ndarray:
    return b.column(name)[row].values.to_numpy(zero_copy_only=False)


def _among(x: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(vocabulary, x), len(vocabulary) - 1)
    return vocabulary[at] == x


def _score(queries: dict[int, list[tuple[int, int]]], least: dict[int, int], k: int, vocabulary: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best ``k`` (query, doc_id, score) of each block for each of its visitors, from ``least`` on."""
    for b in batches:
        for r in range(b.num_rows):
            m, docs = b.column("m")[r].as_py(), b.column("docs")[r].values
            term, head, tf, start, place = (_of(b, r, c) for c in ("terms", "heads", "tfs", "starts", "places"))
            gains: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for i in np.flatnonzero(_among(term, vocabulary)).tolist():
                lo, hi = head[i], head[i + 1]
                once = gain(tf[lo:hi].astype(np.int64), m)  # once for each tf
                gains[int(term[i])] = place[start[lo] : start[hi]], np.repeat(once, np.diff(start[lo : hi + 1]))
            who, where, value = [], [], []
            for q in b.column("visitors")[r].as_py():
                score = np.zeros(len(docs), np.int64)
                for t, w in queries[q]:
                    if t in gains:
                        at, g = gains[t]
                        score[at] += w * g
                good = np.flatnonzero(score >= least[q])
                if len(good) > k:
                    kth = np.partition(score[good], len(good) - k)[len(good) - k]
                    more, equal = good[score[good] > kth], good[score[good] == kth]
                    good = np.concatenate([more, equal[: k - len(more)]])  # places follow the ids
                who += [q] * len(good)
                where.append(good)
                value.append(score[good])
            if who:
                where = np.concatenate(where)
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), docs.take(pa.array(where)), pa.array(np.concatenate(value))], names=["query", "doc_id", "score"])
    hand_back()
