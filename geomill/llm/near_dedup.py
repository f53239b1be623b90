"""MinHash near-duplicates by a multi-index Hamming join of signatures.

A document's set is its distinct five-word shingles (words: runs of non-white-space bytes,
A-Z lower-cased; fewer than five words: the whole sequence as one).  Its signature has
``SIZE`` MinHash values; the distance of two signatures is the number of places where they
differ, binomial with mean SIZE * (1 - similarity).

Index.  The first ``places`` values are split into m chunks.  For a distance of at most d in
them with 2 m > d, some chunk has at most one error (pigeonhole); the one allowed error is
enumerated by leaving out each value of a chunk in turn, so such a pair shares a key.  d is
set so that a pair at the similarity bound exceeds it with a probability below ``MISS``.
Candidates must also be near in the b-bit signature (b = BITS bits of all SIZE values, bounded
alike) and in set size; each is confirmed on the full sets of 64-bit shingle hashes.

Copies (equal sets) are one class from the start; classes are numbered once, with their table.
Keys of one class only are left out by a window over the key, the one shuffle of the index, which
also gives the key's two pivots.  Wide tables are dropped as soon as narrow ones hold what is left to
read.  Within a key not all pairs are tried.  Each member is first compared, by signature, with two members of
the key (the smallest number and one by hash), of which it keeps the nearest few; in waves its nearest one in another component is
confirmed and components are merged.  At last just those pairs
of a key whose components still differ are tried, each at the first key it shares.  Every
candidate pair is thus confirmed, refused or already connected, and no link is lost to a cap.

Cases: null or empty text, or only white space: set size 0, no links, its own component; a
null doc_id gets a null component and is kept; rows that repeat an id share its component, and
where their texts differ, each of these texts links (``link``: ids are documents) or stands for
itself (``one_of_each``: rows are documents); an empty table gives an empty result.  ``link``
ignores other columns, ``one_of_each`` returns them.
"""

from __future__ import annotations

from functools import reduce
from math import exp, lgamma, log
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SMALL_ROWS, Stages, append_columns, byte_view, map_arrow, semi
from .components import components

SHINGLE, SIZE, INDEX, MISS = 5, 512, 128, 1e-7
#: Waves of merging, and nearest candidates that a document keeps for them; what they leave, the last pass tries.
WAVES, NEAREST = 3, 6
MEMO, BLOCK = 200_000, 4096
_U = np.uint64


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


MULT, ADD = _odd(101, SIZE), _odd(102, SIZE)
POLY = _U(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h


def shingle_set(text: bytes, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    words = text.lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * POLY + h[i : i + n]
    return np.unique(mixed(out))


def minhash(s: np.ndarray) -> np.ndarray:
    """The SIZE smallest values under the hash functions of a non-empty set."""
    best = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), BLOCK):
        np.minimum(best, (s[None, lo : lo + BLOCK] * MULT[:, None] + ADD[:, None]).min(1), out=best)
    return best


def over(n: int, p: float, miss: float = MISS) -> int:
    """The smallest d that a binomial(n, p) number exceeds with a probability below ``miss``."""
    tail, d = 1.0, -1
    while tail >= miss:
        d += 1
        tail -= exp(lgamma(n + 1) - lgamma(d + 1) - lgamma(n - d + 1) + d * log(p) + (n - d) * log(1 - p)) if 0 < p < 1 else float(d == n * p)
        if d == n:
            break
    return d


def chunks(percent: int) -> list[tuple[int, int]]:
    """The chunks (first, end) of the index for a similarity of ``percent`` in 100."""
    places = 64 if percent >= 85 else INDEX
    m = over(places, 1 - percent / 100) // 2 + 1
    cuts = [places * i // m for i in range(m + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def index_keys(values: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    """(rows, keys) of signatures (rows, INDEX): for each chunk, without each of its values in turn."""
    out = []
    for c, (lo, hi) in enumerate(parts):
        for skip in range(lo, hi):
            h = np.full(len(values), c * 1000 + skip, np.uint64)
            for i in range(lo, hi):
                if i != skip:
                    h = (h ^ values[:, i]) * POLY
                    h ^= h >> _U(29)
            out.append(mixed(h))
    return np.stack(out, 1)


#: Bits kept of each value in the b-bit signature, one plane of SIZE bits for each.
BITS, WORDS = 4, SIZE // 64
PLANES = [f"p{j}_{w}" for j in range(BITS) for w in range(WORDS)]
SIGNED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("sig", T.BinaryType())] + [T.StructField(c, T.LongType()) for c in PLANES])
PRINT = ["n", "h1", "h2"]
SET = T.StructType([T.StructField("rep", T.LongType()), T.StructField("items", T.ArrayType(T.LongType(), False))])


def fingerprint(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits of a set, as two sums over its items."""
    return s.sum(), (mixed(s * POLY + _U(7)) ^ s).sum()


def signatures(docs: DataFrame) -> DataFrame:
    """Set size, fingerprint of the set (128 bits) and signature of every (doc_id, text)."""

    def make():
        memo = _WordHash()

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = byte_view(b.column(1))
            k = b.num_rows
            n, prints, sigs = np.zeros(k, np.int64), np.zeros((k, 2), np.uint64), np.zeros((k, SIZE), np.uint64)
            for i in range(k):
                s = shingle_set(data[offsets[i] : offsets[i + 1]].tobytes(), memo)
                if len(s):
                    n[i] = len(s)
                    prints[i] = fingerprint(s)
                    sigs[i] = minhash(s)
            bits = [np.packbits(((sigs >> _U(11 + j)) & _U(1)).astype(np.uint8), axis=1).view(np.int64) for j in range(BITS)]
            short = (sigs[:, :INDEX] >> _U(16)).astype(np.uint32)
            sig = pa.array([short[i].tobytes() if n[i] else None for i in range(k)], pa.binary())
            cols = [b.column(0), pa.array(n), pa.array(prints[:, 0].view(np.int64)), pa.array(np.ascontiguousarray(prints[:, 1]).view(np.int64)), sig]
            return pa.RecordBatch.from_arrays(cols + [pa.array(np.ascontiguousarray(bits[j][:, w])) for j in range(BITS) for w in range(WORDS)], names=SIGNED.names)

        return one

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, SIGNED)


def keyed(classes: DataFrame, parts: list[tuple[int, int]]) -> DataFrame:
    """(key, rep, place): the index entries of every class; place counts a class's keys from 1."""

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            values = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, INDEX).astype(np.uint64)
            keys = index_keys(values, parts)
            rep = np.repeat(b.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
            place = np.tile(np.arange(1, keys.shape[1] + 1, dtype=np.int32), b.num_rows)
            return pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(rep), pa.array(place)], names=["key", "rep", "place"])

        return one

    return map_arrow(classes.select("rep", "sig"), make, T.StructType([T.StructField("key", T.LongType()), T.StructField("rep", T.LongType()), T.StructField("place", T.IntegerType())]))


def prints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with set size and fingerprint as columns n, h1, h2."""

    def make():
        memo = _WordHash()

        def each(arr: pa.Array) -> dict[str, pa.Array]:
            data, offsets = byte_view(arr)
            sets = [shingle_set(data[offsets[i] : offsets[i + 1]].tobytes(), memo) for i in range(len(arr))]
            both = np.array([fingerprint(x) if len(x) else (0, 0) for x in sets], np.uint64).reshape(-1, 2)
            return {"n": pa.array([len(x) for x in sets], pa.int64()), "h1": pa.array(both[:, 0].copy().view(np.int64)), "h2": pa.array(both[:, 1].copy().view(np.int64))}

        return each

    return append_columns(docs, text, make, [T.StructField(c, T.LongType()) for c in PRINT])


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(rep, items): the whole set of every class, from (rep, h1, h2, text); a text that repeats the id
    of another class is told apart by the fingerprint."""

    def make():
        memo = _WordHash()

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            data, offsets = byte_view(b.column(3))
            wanted = np.stack([b.column(1).to_numpy(), b.column(2).to_numpy()], 1).view(np.uint64)
            sets = [shingle_set(data[offsets[i] : offsets[i + 1]].tobytes(), memo) for i in range(b.num_rows)]
            own = [i for i, s in enumerate(sets) if len(s) and fingerprint(s) == tuple(wanted[i])]
            ends = np.cumsum([0] + [len(sets[i]) for i in own])
            items = np.concatenate([np.zeros(0, np.int64), *(sets[i].view(np.int64) for i in own)])
            return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(items))], names=["rep", "items"])

        return one

    return map_arrow(texts, make, SET)


def distance(a: str, b: str) -> F.Column:
    """Differing places of the b-bit signatures in structs or tables a and b."""
    col = lambda t, c: F.col(f"{t}.{c}")
    plane = lambda j, w: col(a, f"p{j}_{w}").bitwiseXOR(col(b, f"p{j}_{w}"))
    parts = [F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), [plane(j, w) for j in range(BITS)])) for w in range(WORDS)]
    return reduce(add, parts)


def near(a: str, b: str, percent: int) -> F.Column:
    most = over(SIZE, (1 - 0.5**BITS) * (1 - percent / 100))
    size = lambda t: F.col(f"{t}.n")
    return (distance(a, b) <= most) & (100 * F.least(size(a), size(b)) >= percent * F.greatest(size(a), size(b)))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    x = pairs.join(sets.withColumnsRenamed({"rep": "b", "items": "ib"}), "b")
    x = x.join(sets.withColumnsRenamed({"rep": "a", "items": "ia"}), "a")
    both = F.size(F.array_intersect("ia", "ib"))
    return x.filter(100 * both >= percent * (F.size("ia") + F.size("ib") - both)).select("a", "b")


def grouped(docs: DataFrame, signed: DataFrame, stages: Stages, percent: int, by_id: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes (n, h1, h2, rep, id: smallest doc_id) of ``signed``, components (rep, comp) of those with links, and the rows
    (doc_id, n, h1, h2) of ``signed``, which itself is dropped.

    ``by_id`` links the classes of rows that repeat an id as well."""
    first = [F.first(c).alias(c) for c in ["sig", *PLANES]]
    whole = signed.filter("n > 0 AND doc_id IS NOT NULL")
    classes = whole.groupBy(*PRINT).agg(F.min("doc_id").alias("id"), *first).withColumn("rep", F.monotonically_increasing_id())
    full = stages.keep(classes, "full")
    rows = stages.keep(signed.select("doc_id", *PRINT), "rows")
    stages.drop(signed)
    stages.tidy()

    w = Window.partitionBy("key")
    entries = keyed(full, chunks(percent)).withColumns({"members": F.count("*").over(w), "first": F.min("rep").over(w), "other": F.min_by("rep", F.xxhash64("rep", "key")).over(w)})
    hits = stages.keep(entries.filter("members > 1").drop("members"), "hits")
    classes = stages.keep(full.drop("sig"), "classes")
    stages.drop(full)
    stages.tidy()
    marks = classes.select("rep", "n", *PLANES)
    active = stages.keep(hits.select("rep").distinct().join(classes.select("rep", "id", "h1", "h2"), "rep"), "active")
    text = docs.select(F.col("doc_id").cast("long").alias("id"), "text").filter("id IS NOT NULL")
    text = text.join(F.broadcast(active) if active.count() <= SMALL_ROWS else active, "id").select("rep", "h1", "h2", "text")
    sets = stages.keep(shingle_sets(text.dropDuplicates(["rep", "text"])), "sets")

    offers = hits.select("rep", F.explode(F.array("first", "other")).alias("cand")).filter("rep <> cand").distinct().alias("o")
    offers = offers.join(marks.alias("x"), F.col("o.rep") == F.col("x.rep")).join(marks.alias("y"), F.col("o.cand") == F.col("y.rep"))
    offers = offers.filter(near("x", "y", percent)).select("o.rep", distance("x", "y").alias("far"), "o.cand")
    best = F.slice(F.array_sort(F.collect_list(F.struct("far", "cand"))), 1, NEAREST)  # of two a key at most
    offers = stages.keep(offers.groupBy("rep").agg(best.alias("b")).select("rep", F.explode("b").alias("b")).select("rep", "b.cand", "b.far"), "offers")
    stages.tidy()
    spark = docs.sparkSession
    links, comp = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "id long, comp long")
    tried = links
    if by_id and not (same := stages.keep(same_ids(rows.filter("n > 0 AND doc_id IS NOT NULL"), classes, stages), "same")).isEmpty():
        links, comp = same, components(same, stages)
    for wave in range(WAVES):
        if wave:  # components only grow: what they have joined needs no further look
            mine = offers.join(comp.withColumnsRenamed({"id": "rep", "comp": "c"}), "rep", "left").join(comp.withColumnsRenamed({"id": "cand", "comp": "d"}), "cand", "left")
            still = stages.keep(mine.filter(F.coalesce("c", "rep") != F.coalesce("d", "cand")).select("rep", "cand", "far"), "offers")
            stages.drop(offers)
            offers = still
        mine = offers.select(F.least("rep", "cand").alias("a"), F.greatest("rep", "cand").alias("b"), "rep", "far")
        best = mine.join(tried, ["a", "b"], "left_anti").groupBy("rep").agg(F.min(F.struct("far", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
        best = stages.keep(best, "wave")
        new = stages.keep(confirmed(best, sets, percent), "links")
        tried = tried.unionByName(best)
        if new.isEmpty():
            break
        links = links.unionByName(new)
        comp = components(links, stages)

    stages.tidy()
    placed = hits.select("key", "rep", "place").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", "place", F.coalesce("comp", "rep").alias("comp"))
    mixed_keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    open_rows = stages.keep(placed.join(mixed_keys, "key"), "open")
    all_keys = open_rows.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("place", "key"))).alias("ks")).select("rep", F.col("ks.place").alias("places"), F.col("ks.key").alias("keys"))
    open_keys, open_rows = open_rows, stages.keep(open_rows.join(all_keys, "rep").join(marks, "rep"), "wide")
    stages.drop(open_keys)
    stages.tidy()
    x, y = open_rows.alias("x"), open_rows.alias("y")
    earlier = lambda t: F.slice(f"{t}.keys", F.lit(1), F.array_position(f"{t}.places", F.col(f"{t}.place")).cast("int") - 1)
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp")) & near("x", "y", percent) & ~F.arrays_overlap(earlier("x"), earlier("y")))
    rest = rest.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).join(tried, ["a", "b"], "left_anti")
    more = stages.keep(confirmed(stages.keep(rest, "rest"), sets, percent), "more")
    if not more.isEmpty():
        comp = components(links.unionByName(more), stages)
    stages.drop(hits, active, sets, offers, open_rows)
    stages.tidy()
    return classes.select(*PRINT, "rep", "id"), comp.withColumnRenamed("id", "rep"), rows


def same_ids(whole: DataFrame, classes: DataFrame, stages: Stages) -> DataFrame:
    """Links (a, b) between the classes of rows that repeat an id with different texts."""
    lows, highs = [F.min(c).alias(f"lo_{c}") for c in PRINT], [F.max(c).alias(f"hi_{c}") for c in PRINT]
    ids = whole.groupBy("doc_id").agg(*lows, *highs).filter(" OR ".join(f"lo_{c} <> hi_{c}" for c in PRINT)).select("doc_id")
    ids = stages.keep(ids, "repeated")
    own = semi(whole.select("doc_id", *PRINT), ids, "doc_id", ids.count()).distinct().join(classes.select(*PRINT, "rep"), PRINT).select("doc_id", "rep")
    own = stages.keep(own, "own")
    return own.join(own.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct()


def link(docs: DataFrame, stages: Stages, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    signed = stages.keep(signatures(docs), "signed")
    classes, comp, rows = grouped(docs, signed, stages, percent, by_id=True)
    named = comp.join(classes.select("rep", "id"), "rep").groupBy("comp").agg(F.min("id").alias("least"))
    least = comp.join(named, "comp").select("rep", "least")
    of = classes.join(least, "rep", "left").select(*PRINT, F.coalesce("least", "id").alias("comp"))
    out = rows.join(of, PRINT, "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("comp"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, stages: Stages, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others) without their near copies.

    Of a group the row with the smallest doc_id stays; of rows that repeat this id with the same
    set, the one with the smallest text.  Rows without an id all stay."""
    signed = stages.keep(signatures(docs.select("doc_id", "text")), "signed")
    classes, comp, rows = grouped(docs, signed, stages, percent, by_id=False)
    first = comp.join(classes.select("rep", "id"), "rep").groupBy("comp").agg(F.min(F.struct("id", "rep"))["rep"].alias("first"))
    gone = comp.join(first, "comp").filter("rep <> first").select("rep", F.lit(True).alias("gone"))
    of = classes.join(gone, "rep", "left").select(*PRINT, "id", F.coalesce("gone", F.lit(False)).alias("gone"))
    rows = rows.filter("doc_id IS NOT NULL").join(of, PRINT, "left")
    rows = rows.select("doc_id", *PRINT, (~F.coalesce("gone", F.lit(False)) & F.coalesce(F.col("id") == F.col("doc_id"), F.lit(True))).alias("stays"))
    rows = stages.keep(rows, "rows")
    dropped = stages.keep(rows.filter("NOT stays").select("doc_id").distinct(), "dropped")
    again = stages.keep(rows.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    n_again = again.count()
    kept = semi(docs, dropped, "doc_id", dropped.count(), "left_anti")
    read = [dropped, again]
    if n_again:  # a row of a repeated id is known by its set as well
        stay = stages.keep(semi(rows.filter("stays"), again, "doc_id", n_again).select("doc_id", *PRINT).distinct(), "stay")
        read.append(stay)
        known = prints(semi(docs, again, "doc_id", n_again).select("doc_id", "text", F.struct(*docs.columns).alias("row"))).join(stay, ["doc_id", *PRINT])
        once = known.groupBy("doc_id", *PRINT).agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
        kept = semi(kept, again, "doc_id", n_again, "left_anti").unionByName(once)
    stages.clear(*read)
    return kept.select(*docs.columns)
