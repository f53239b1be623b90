"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search on it.

Equal vectors are one node, so a very common vector costs no more than another.  Nodes are
dealt into shards by length, each spanning a factor of four, so that a few very long vectors
don't make all others look alike.  Within its shard a node is scaled by the shard's length and
gets one more component, which turns the largest inner product into the nearest neighbour; the
graph holds ``K`` neighbours a node, all of its shard.

Start: several random orderings (signs of random projections, then one projection); in each,
runs of ``CHUNK`` nodes of a shard give each other's best.  NN-descent: each node collects its
neighbours and up to ``REVERSE`` nodes that name it, new ones first, with their vectors, and
offers those pairs of them to each other that hold a new edge; a node keeps the best ``K`` of
what it has and is offered.  Rounds go on until one changes less than ``DELTA`` of all edges.
Search: shards are taken from the longest on.  Where vectors form clusters, the graph is a set of islands, so
a query needs entry points in all that matter.  It starts at its own node, at the best of a drawn set of the
shard's nodes (as many as the square root of their number, ``PILOTS`` at least), and at the best it meets
in ``ENTRIES`` further orderings, by direction alone, in which the queries stand among the nodes and meet
the run of ``CHUNK`` nodes around them.  It keeps the best ``BEAM`` nodes seen; in each round the
neighbours of its best unexpanded ones are scored, until all are expanded.  A query is done
with when no vector of the next shard is long enough to reach its nearest ones.

Both steps are joins on node ids.  The graph with its neighbours' vectors is written once,
bucketed by node, so a round of search shuffles only its requests.  Vectors travel as half
floats; results are scored again in double precision on the original vectors.

The bound on reverse neighbours is part of NN-descent, which samples; recall against brute
force is measured in ``tests/llm`` and by ``recall``.

Cases: vectors that are null, empty, zero or hold a null or non-finite component, and rows
without an id, take no part; neither do vectors of another length than the commonest (ties:
the longer); of rows that repeat an id one counts, that with the smallest vector; fewer than
``top`` candidates: all of them; ties go to the smaller id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stages

K, REVERSE, CHUNK, ORDERINGS, DELTA = 32, 16, 2048, 6, 0.005
BEAM, WIDTH, PILOTS, STARTS = 192, 64, 256, 16
#: Orderings for entry points, and the most queries that wait for the end of their run of nodes.
ENTRIES, WAITING = 6, 4096
NODES_PER_TASK, ELEMENTS = 8_000, 500_000
#: Lengths are counted in steps of a quarter of an octave; a shard spans so many of them.
STEPS, SPAN = 4, 8
LONG, FLOAT, BYTES = T.LongType(), T.FloatType(), T.BinaryType()


def fields(*pairs) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in pairs])


#: Lists of a node or query, best first; ``new``: an edge that no round has used, a node that isn't expanded.
LISTS = fields(("u", LONG), ("vs", T.ArrayType(LONG)), ("ss", T.ArrayType(FLOAT)), ("new", T.ArrayType(T.BooleanType())))


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0))
    sizes = rows.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    rows = rows.filter(F.size(x) == (sizes[0]["n"] if sizes else 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def length(x: str) -> Column:
    """Euclidean length of a vector that isn't zero, by its largest component so that no square over- or underflows."""
    most = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))
    return most * F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v / most) * (v / most)))


def nodes_of(rows: DataFrame, top: int) -> DataFrame:
    """(id, embedding, length, members): one row for each different vector, with its top + 1 smallest ids."""
    w = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= top + 1)
    nodes = few.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.array_sort(F.collect_list("vec_id")).alias("members"))
    return nodes.select("id", "embedding", length("embedding").alias("length"), "members")


def shards_of(nodes: DataFrame) -> list[int]:
    """The largest step of length in each shard, longest first; there are at most some thousand steps in doubles."""
    tops: list[int] = []
    for r in sorted((r["step"] for r in nodes.select(F.floor(F.log2("length") * STEPS).cast("long").alias("step")).distinct().collect()), reverse=True):
        if not tops or r <= tops[-1] - SPAN:
            tops.append(r)
    return tops


def scale_of(top: int) -> float:
    return 2.0 ** ((top + 1) / STEPS)


def halves(nodes: DataFrame, tops: list[int]) -> DataFrame:
    """(id, shard, vec): the scaled vectors as half floats."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                n = b.column(2).to_numpy()
                shard = np.maximum((np.array(tops)[None] >= np.floor(np.log2(n) * STEPS)[:, None]).sum(1) - 1, 0)
                scale = np.array([scale_of(t) for t in tops])[shard]
                x = (np.array(b.column(1).to_pylist(), np.float64) / scale[:, None]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shard.astype(np.int64)), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "shard", "vec"])

    return nodes.select("id", "embedding", "length").mapInArrow(run, fields(("id", LONG), ("shard", LONG), ("vec", BYTES)))


def matrix(rows: list[bytes]) -> np.ndarray:
    """The vectors with one more component that makes their length 1 (or leaves it, where it is more by rounding)."""
    x = np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), -1).astype(np.float32)
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x, x)))[:, None]], 1)


#: Edges on their way to their owners' lists: one row for each part of the owners, not one for each owner.
PACKED = fields(("part", LONG), ("data", BYTES))
KINDS = (np.dtype(np.int64), np.dtype(np.int64), np.dtype(np.float32), np.dtype(bool))


def packed(u: np.ndarray, v: np.ndarray, s: np.ndarray, new: np.ndarray, parts: int) -> pa.RecordBatch:
    """The edges in one row for each part that owns some."""
    part = ((u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
    o = np.argsort(part, kind="stable")
    cols = [np.ascontiguousarray(c[o].astype(k, copy=False)) for c, k in zip((u, v, s, new), KINDS, strict=True)]
    numbers, starts = np.unique(part[o], return_index=True)
    data = [b"".join(c[lo:hi].tobytes() for c in cols) for lo, hi in zip(starts, np.append(starts[1:], len(o)), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(data, pa.binary())], names=PACKED.names)


def unpacked(data: list[bytes]) -> list[np.ndarray]:
    """(u, v, s, new) of packed rows."""
    width, cols = sum(k.itemsize for k in KINDS), [[] for _ in KINDS]
    for d in data:
        n, at = len(d) // width, 0
        for c, k in zip(cols, KINDS, strict=True):
            c.append(np.frombuffer(d, k, n, at))
            at += n * k.itemsize
    return [np.concatenate(c) for c in cols]


def lists(u: np.ndarray, v: np.ndarray, s: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best different v of each u, best first; of equal ones that which isn't new counts."""
    o = np.lexsort((new, v, u))
    u, v, s, new = u[o], v[o], s[o], new[o]
    first = np.ones(len(u), bool)
    first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    u, v, s, new = u[first], v[first], s[first], new[first]
    o = np.lexsort((v, -s, u))
    u, v, s, new = u[o], v[o], s[o], new[o]
    _, starts = np.unique(u, return_index=True)
    rank = np.arange(len(u)) - np.repeat(starts, np.diff(np.append(starts, len(u))))
    return u[rank < k], v[rank < k], s[rank < k], new[rank < k]


def list_batch(u: np.ndarray, v: np.ndarray, s: np.ndarray, new: np.ndarray) -> pa.RecordBatch:
    """A row of lists for each owner, from edges in order of their owners."""
    owners = np.unique(u)
    offs = pa.array(np.concatenate([[0], np.searchsorted(u, owners, side="right")]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(owners), *(pa.ListArray.from_arrays(offs, pa.array(x)) for x in (v, s.astype(np.float32), new))], names=LISTS.names)


def flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    vs, ss, new = b.column(1), b.column(2), b.column(3)
    n = np.diff(vs.offsets.to_numpy())
    return np.repeat(b.column(0).to_numpy(), n), vs.flatten().to_numpy(), ss.flatten().to_numpy(), new.flatten().to_numpy(zero_copy_only=False)


def groups(batches, key: int = 0):
    """Consecutive rows of one key, whole, from sorted batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        if held and held[-1].column(key)[0].as_py() != ids[0]:
            yield held
            held = []
        for lo, hi in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield [*held, b.slice(lo, hi - lo)]
            held = []
        held.append(b.slice(cuts[-2], cuts[-1] - cuts[-2]))
    if held:
        yield held


class Sender:
    """Gathers edges and packs them; when ``ELEMENTS`` are held, only each owner's k best are kept, and they go on their way."""

    def __init__(self, k: int, parts: int):
        self.k, self.parts, self.held, self.n = k, parts, [], 0

    def add(self, u, v, s, new):
        self.held.append((u, v, s, new))
        self.n += len(u)
        if self.n >= ELEMENTS:
            yield from self.send()

    def send(self):
        if self.n:
            yield packed(*lists(*(np.concatenate(x) for x in zip(*self.held, strict=True)), self.k), self.parts)
        self.held, self.n = [], 0


def sent(rows: DataFrame, k: int, parts: int) -> DataFrame:
    """Rows of lists, packed."""

    def run(batches):
        out = Sender(k, parts)
        for b in batches:
            if b.num_rows:
                yield from out.add(*flat(b))
        yield from out.send()

    return rows.mapInArrow(run, PACKED)


def best_of(edges: DataFrame, k: int, tasks: int) -> DataFrame:
    """The k best of each owner as rows of lists, from packed edges; a task takes one part after the other."""

    def run(batches):
        for g in groups(batches):
            yield list_batch(*lists(*unpacked([x for b in g for x in b.column(1).to_pylist()]), k))

    return edges.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(run, LISTS)


def parts_of(tasks: int) -> int:
    """Parts of the owners: a few for each task, so that a hash deals them out evenly."""
    return 8 * tasks


def first_lists(vecs: DataFrame, n: int, tasks: int, seed: int) -> DataFrame:
    """Edges within runs of CHUNK nodes of each shard in each random ordering."""
    bits = max(0, min(40, int(np.log2(max(1, n / CHUNK)))))

    def keyed(batches):
        rng = np.random.default_rng(seed)
        planes = None
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(2).to_pylist())
            if planes is None:
                planes = rng.normal(size=(ORDERINGS, x.shape[1], bits + 1)).astype(np.float32)
            for t in range(ORDERINGS):
                z = x @ planes[t]
                code = ((z[:, :bits] > 0) * (1 << np.arange(bits))).sum(1).astype(np.int64)
                run = pa.array(b.column(1).to_numpy() * ORDERINGS + t)
                yield pa.RecordBatch.from_arrays([run, pa.array(code), pa.array(z[:, bits]), b.column(0), b.column(2)], names=["run", "code", "z", "id", "vec"])

    def near(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        ids = np.concatenate([b.column(3).to_numpy() for b in rows])
        x = matrix([v for b in rows for v in b.column(4).to_pylist()])
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        k = min(K, len(ids) - 1)
        at = np.argpartition(-s, k - 1, 1)[:, :k] if k > 0 else np.zeros((len(ids), 0), np.int64)
        return np.repeat(ids, k), ids[at].ravel(), np.take_along_axis(s, at, 1).ravel(), np.ones(at.size, bool)

    def run(batches):
        out, held = Sender(K, parts_of(tasks)), []
        size, now = 0, None
        for b in batches:
            t = b.column(0).to_numpy()
            lo = 0
            while lo < b.num_rows:
                if t[lo] != now or size == CHUNK:
                    if size:
                        yield from out.add(*near(held))
                    held, size, now = [], 0, t[lo]
                hi = min(int(np.searchsorted(t, now, side="right")), lo + CHUNK - size)
                held.append(b.slice(lo, hi - lo))
                size, lo = size + hi - lo, hi
        if size:
            yield from out.add(*near(held))
        yield from out.send()

    rows = vecs.mapInArrow(keyed, fields(("run", LONG), ("code", LONG), ("z", FLOAT), ("id", LONG), ("vec", BYTES)))
    parts = max(1, -(-ORDERINGS * n // (4 * CHUNK)))
    order = ["run", "code", "z", "id"]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, PACKED)


def both_ways(graph: DataFrame, seed: int) -> DataFrame:
    """(center, members): a node's neighbours and up to REVERSE nodes that name it, new ones first, then by hash.

    members: array of (member, new).  The limit is applied before the shuffle as well, so a node
    that very many name sends no more than REVERSE rows of each task."""
    back = graph.select(F.col("u").alias("member"), F.explode(F.arrays_zip("vs", "new")).alias("e")).select(F.col("e.vs").alias("center"), "member", F.col("e.new").alias("new"))
    w = Window.partitionBy("center").orderBy(F.desc("new"), F.xxhash64("center", "member", F.lit(seed)), "member")
    back = back.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= REVERSE)
    back = back.groupBy("center").agg(F.collect_list(F.struct("member", "new")).alias("back"))
    own = graph.select(F.col("u").alias("center"), F.transform(F.arrays_zip("vs", "new"), lambda e: F.struct(e["vs"].alias("member"), e["new"].alias("new"))).alias("ahead"))
    return own.join(back, "center", "left").select("center", F.when(F.col("back").isNull(), F.col("ahead")).otherwise(F.concat("ahead", "back")).alias("members"))


def descend(graph: DataFrame, vecs: DataFrame, tasks: int, seed: int) -> DataFrame:
    """One round of NN-descent over the pairs with a new edge."""
    worst = graph.select(F.col("u").alias("member"), F.when(F.size("ss") >= K, F.element_at("ss", -1)).otherwise(F.lit(float("-inf"))).cast("float").alias("worst"))
    own = vecs.select(F.col("id").alias("member"), "vec").join(worst, "member")
    around = both_ways(graph, seed).filter(F.exists("members", lambda m: m["new"]))
    rows = around.select("center", F.explode("members").alias("m")).select("center", "m.member", "m.new").join(own, "member").select("center", "member", "worst", "new", "vec")

    def run(batches):
        out = Sender(K, parts_of(tasks))
        for g in groups(batches):
            ids = np.concatenate([b.column(1).to_numpy() for b in g])
            low = np.concatenate([b.column(2).to_numpy() for b in g])
            new = np.concatenate([b.column(3).to_numpy(zero_copy_only=False) for b in g])
            o = np.lexsort((~new, ids))  # of an edge both ways, the new one counts
            raw = [x for b in g for x in b.column(4).to_pylist()]
            at = o[np.unique(ids[o], return_index=True)[1]]
            ids, low, new, x = ids[at], low[at], new[at], matrix([raw[i] for i in at])
            p = x @ x.T
            np.fill_diagonal(p, -np.inf)
            i, j = np.nonzero((p > low[:, None]) & (new[:, None] | new[None]))
            yield from out.add(ids[i], ids[j], p[i, j], np.ones(len(i), bool))
        yield from out.send()

    offers = rows.repartition(tasks, "center").sortWithinPartitions("center").mapInArrow(run, PACKED)
    used = graph.select("u", "vs", "ss", F.transform("new", lambda _: F.lit(False)).alias("new"))
    return best_of(sent(used, K, parts_of(tasks)).unionByName(offers), K, tasks)


def build(vecs: DataFrame, n: int, stages: Stages, seed: int = 5) -> DataFrame:
    """The neighbour graph (u, vs, ss, new) of nodes (id, shard, vec)."""
    tasks = max(1, -(-n // NODES_PER_TASK))
    graph, r = stages.keep(best_of(first_lists(vecs, n, tasks, seed), K, tasks), "graph"), 0
    while True:
        better = stages.keep(descend(graph, vecs, tasks, seed + r), "graph")
        stages.drop(graph)
        graph, r = better, r + 1
        sizes = graph.agg(F.sum(F.size(F.filter("new", lambda x: x))).alias("new"), F.sum(F.size("new")).alias("all")).first()
        if (sizes["new"] or 0) <= DELTA * (sizes["all"] or 0):
            return graph


def with_vectors(graph: DataFrame, vecs: DataFrame, parts: int, seed: int) -> DataFrame:
    """(v, ids, vecs): every node with its neighbours both ways, packed."""
    rows = both_ways(graph, seed).select("center", F.explode("members.member").alias("member"))
    rows = rows.join(vecs.select(F.col("id").alias("member"), "vec"), "member").select("center", "member", "vec")

    def run(batches):
        for g in groups(batches):
            ids = np.concatenate([b.column(1).to_numpy() for b in g])
            raw = [x for b in g for x in b.column(2).to_pylist()]
            ids, at = np.unique(ids, return_index=True)
            packed = b"".join(raw[i] for i in at)
            yield pa.RecordBatch.from_arrays([pa.array([g[0].column(0)[0].as_py()], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([packed], pa.binary())], names=["v", "ids", "vecs"])

    return rows.repartition(parts, "center").sortWithinPartitions("center").mapInArrow(run, fields(("v", LONG), ("ids", BYTES), ("vecs", BYTES)))


def scored(x: bytes, many: bytes) -> np.ndarray:
    x = np.frombuffer(x, np.float16).astype(np.float32)
    return np.frombuffer(many, np.float16).reshape(-1, len(x)).astype(np.float32) @ x


def starts(queries: DataFrame, pilots: list, shard: int) -> DataFrame:
    """Where the queries (q, vec, own: shard of their node) enter a shard: its best pilots, and their own node if it is there."""
    ids, packed = np.array([p["id"] for p in pilots], np.int64), b"".join(bytes(p["vec"]) for p in pilots)

    def run(batches):
        for b in batches:
            rows = []
            for q, vec, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = scored(vec, packed)
                at = np.argsort(-s, kind="stable")[:STARTS]
                v, s = ids[at], s[at]
                if own == shard:
                    v, s = np.append(v, q), np.append(s, np.float32(np.inf))  # expanded first; scored exactly at the end
                rows.append((np.full(len(v), q), v, s, np.ones(len(v), bool)))
            if rows:
                yield list_batch(*lists(*(np.concatenate(x) for x in zip(*rows, strict=True)), BEAM))

    return queries.select("q", "vec", "own").mapInArrow(run, LISTS)


def directions(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), -1).astype(np.float32)
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-30)[:, None]


def entries(queries: DataFrame, vecs: DataFrame, n: int, tasks: int, seed: int) -> DataFrame:
    """Packed edges from queries (q, vec) to the best ``STARTS`` of the ``n`` nodes (id, vec) around them, in each ordering by direction."""
    bits = max(0, min(40, int(np.log2(max(1, n / CHUNK)))))

    def keyed(batches):
        planes = None
        for b in batches:
            if not b.num_rows:
                continue
            x = directions(b.column(2).to_pylist())
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(ENTRIES, x.shape[1], bits + 1)).astype(np.float32)
            for t in range(ENTRIES):
                z = x @ planes[t]
                code = ((z[:, :bits] > 0) * (1 << np.arange(bits))).sum(1).astype(np.int64)
                run = pa.array(np.full(len(x), t))
                yield pa.RecordBatch.from_arrays([run, pa.array(code), pa.array(z[:, bits]), *b.columns], names=["run", "code", "z", "id", "asks", "vec"])

    def near(nodes: tuple[np.ndarray, np.ndarray], asking: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        q, s = np.concatenate([a[0] for a in asking]), np.concatenate([a[1] for a in asking]) @ nodes[1].T
        k = min(STARTS, s.shape[1])
        at = np.argpartition(-s, k - 1, 1)[:, :k]
        return np.repeat(q, k), nodes[0][at].ravel(), np.take_along_axis(s, at, 1).ravel(), np.ones(at.size, bool)

    def run(batches):
        out = Sender(BEAM, parts_of(tasks))
        now, held, asking, size, waiting = None, [], [], 0, 0

        def meet():
            if held and waiting:
                yield from out.add(*near(tuple(np.concatenate(c) for c in zip(*held, strict=True)), asking))

        for b in batches:
            if not b.num_rows:
                continue
            t, ids, asks = b.column(0).to_numpy(), b.column(3).to_numpy(), b.column(4).to_numpy(zero_copy_only=False)
            x = np.frombuffer(b"".join(b.column(5).to_pylist()), np.float16).reshape(len(t), -1).astype(np.float32)
            cuts = [0, *(np.flatnonzero(t[1:] != t[:-1]) + 1).tolist(), len(t)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if t[lo] != now:
                    yield from meet()
                    now, held, asking, size, waiting = t[lo], [], [], 0, 0
                mine, other = np.arange(lo, hi)[~asks[lo:hi]], np.arange(lo, hi)[asks[lo:hi]]
                held.append((ids[mine], x[mine]))
                asking.append((ids[other], x[other]))
                size, waiting = size + len(mine), waiting + len(other)
                if size >= CHUNK or (waiting >= WAITING and size):
                    yield from meet()
                    asking, waiting = [], 0
                    if size >= CHUNK:
                        held, size = [], 0
        yield from meet()
        yield from out.send()

    rows = vecs.select("id", F.lit(False).alias("asks"), "vec").unionByName(queries.select(F.col("q").alias("id"), F.lit(True).alias("asks"), "vec"))
    rows = rows.mapInArrow(keyed, fields(("run", LONG), ("code", LONG), ("z", FLOAT), ("id", LONG), ("asks", T.BooleanType()), ("vec", BYTES)))
    order = ["run", "code", "z", "id"]
    return rows.repartitionByRange(max(1, -(-ENTRIES * n // (4 * CHUNK))), *order).sortWithinPartitions(*order).mapInArrow(run, PACKED)


def hop(state: DataFrame, queries: DataFrame, adjacency: DataFrame, tasks: int) -> DataFrame:
    """Expand the best WIDTH unexpanded nodes of every query and merge what they give into its beam."""
    full = F.when(F.size("ss") >= BEAM, F.element_at("ss", -1)).otherwise(F.lit(float("-inf"))).cast("float")
    next_ = F.slice(F.filter("vs", lambda v, i: F.get(F.col("new"), i)), 1, WIDTH)
    state = state.withColumn("next", next_)
    asked = state.select(F.col("u").alias("q"), full.alias("worst"), "next").join(queries.select("q", "vec"), "q").select("q", "vec", "worst", F.explode("next").alias("v"))

    def score(batches):
        out = Sender(BEAM, parts_of(tasks))
        for b in batches:
            q, worst = b.column("q").to_numpy(), b.column("worst").to_numpy()
            for i in range(b.num_rows):
                ids = np.frombuffer(b.column("ids")[i].as_buffer(), np.int64)
                s = scored(b.column("vec")[i].as_buffer(), b.column("vecs")[i].as_buffer())
                good = s > worst[i]
                n = int(good.sum())
                if n:
                    yield from out.add(np.full(n, q[i]), ids[good], s[good], np.ones(n, bool))
        yield from out.send()

    found = asked.join(adjacency, "v").select("q", "vec", "worst", "ids", "vecs").mapInArrow(score, PACKED)
    old = F.transform("vs", lambda v, i: F.get(F.col("new"), i) & ~F.array_contains("next", v)).alias("new")
    return best_of(sent(state.select("u", "vs", "ss", old), BEAM, parts_of(tasks)).unionByName(found), BEAM, tasks)


def search(df: DataFrame, stages: Stages, queries, id: str = "vec_id", vector: str = "embedding", top: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest rows of each row whose id fulfils ``queries``."""
    rows = stages.keep(usable(df, id, vector), "rows")
    nodes = stages.keep(nodes_of(rows, top), "nodes")
    n, tops = nodes.count(), shards_of(nodes)
    vecs = stages.keep(halves(nodes, tops), "vecs")
    graph = build(vecs, n, stages)
    parts = max(1, -(-n // NODES_PER_TASK))
    adjacency = stages.keep_bucketed(with_vectors(graph, vecs, parts, 99), "v", "adjacency")
    stages.drop(graph)

    asked = rows.filter(queries(F.col("vec_id"))).join(nodes.select("id", "embedding"), "embedding")
    asked = stages.keep(asked.select(F.col("vec_id").alias("query_id"), F.col("id").alias("q")), "asked")
    own = asked.select("q").distinct().join(nodes.select(F.col("id").alias("q"), "embedding", "length"), "q")
    unit = stages.keep(halves(own.select(F.col("q").alias("id"), F.transform("embedding", lambda v: v / F.col("length")).alias("embedding"), F.lit(1.0).alias("length")), [-1]).select(F.col("id").alias("q"), "vec"), "unit")
    live = stages.keep(unit.join(vecs.select(F.col("id").alias("q"), F.col("shard").alias("own")), "q"), "live")
    beams: DataFrame | None = None
    for shard, step in enumerate(tops):
        mine = vecs.filter(F.col("shard") == shard)
        size = mine.count()
        # a small shard is met whole; else the square root, at most some tens of thousands of vectors
        pilots = mine.orderBy(F.xxhash64("id"), "id").limit(CHUNK if size <= CHUNK else max(PILOTS, int(size**0.5))).collect()
        state = starts(live, pilots, shard)
        if size > CHUNK:
            state = best_of(sent(state, BEAM, parts_of(parts)).unionByName(entries(live, mine, size, parts, shard)), BEAM, parts)
        state = stages.keep(state, "beam")
        while not state.filter(F.exists("new", lambda x: x)).isEmpty():
            after = stages.keep(hop(state, live, adjacency, parts), "beam")
            stages.drop(state)
            state = after
        # half floats have chosen the beam; its best part is scored again exactly
        hits = state.select(F.col("u").alias("q"), F.explode(F.slice(F.arrays_zip("vs", "ss"), 1, top + BEAM // 2)).alias("h"))
        hits = hits.select("q", F.col("h.vs").alias("id"), (F.col("h.ss") * scale_of(step)).alias("near"))
        beams = hits if beams is None else beams.unionByName(hits)
        if shard + 1 < len(tops):
            # a score of the next shard is at most its length; 2 in 100 more for half floats, one more for the query itself
            reached = beams.filter("near < double('infinity')").groupBy("q").agg(F.get(F.sort_array(F.collect_list("near"), False), F.lit(top)).alias("least"))
            still = live.join(reached, "q", "left").filter(F.coalesce(F.col("least"), F.lit(float("-inf"))) < 1.02 * scale_of(tops[shard + 1]))
            live = stages.keep(still.select("q", "vec", "own"), "live")
            if live.isEmpty():
                break
    if beams is None:
        beams = df.sparkSession.createDataFrame([], "q long, id long")
    exact = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    near = beams.select("q", "id").join(nodes.select("id", F.col("embedding").alias("y"), "members"), "id").join(nodes.select(F.col("id").alias("q"), F.col("embedding").alias("x")), "q")
    near = near.select("q", exact.alias("score"), "members")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    near = near.withColumn("first", F.col("members")[0]).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= top + 1)
    # a query drops its own row only, so top + 1 candidates of its node are enough
    best = near.select("q", "score", F.explode("members").alias("vec_id"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = stages.keep(best.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= top + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rn", "vec_id", "score"))).alias("hits")), "best")
    stages.drop(adjacency)
    out = asked.join(best, "q").select("query_id", F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, top).alias("hits"))
    return out.select("query_id", F.posexplode("hits").alias("pos", "h")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score"))


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the pairs (query_id, vec_id) of ``truth`` that ``found`` has."""
    total = truth.count()
    return found.join(truth.select("query_id", "vec_id"), ["query_id", "vec_id"]).count() / total if total else 1.0
