"""Joins: grid band joins, nearest rows, point in polygon, cascades, greedy one-to-one, blocking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomill.functions import geo, similarity, text

from . import areas
from .stages import keeper

STEPS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
#: Half of the plane, the own cell included: each unordered pair of cells once.
HALF_STEPS = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]


def with_offsets(df: DataFrame, cy: Column, cx: Column, steps: Sequence[tuple[int, int]] = STEPS) -> DataFrame:
    """A row for each step, with the cell it leads to; an explode, so that no join of all with all is planned."""
    return df.withColumn("_o", F.explode(F.array(*[F.struct(F.lit(a).alias("y"), F.lit(b).alias("x")) for a, b in steps]))).select(
        *df.columns, (cy + F.col("_o.y")).alias("_cy"), (cx + F.col("_o.x")).alias("_cx"))


def near_pairs(points: DataFrame, cell: float, id: str = "id") -> DataFrame:
    """(a, b) with a < b: points of the same or neighbouring grid cells (cells cut towards zero).

    A merge join by hint, as in ``within``, so that pairs are made and told apart in as many tasks as the shuffle has.
    """
    cy, cx = geo.cell(F.col("lat"), cell), geo.cell(F.col("lng"), cell)
    p = points.filter("lat IS NOT NULL AND lng IS NOT NULL")
    left = with_offsets(p.select(F.col(id).alias("a"), cy.alias("y"), cx.alias("x")), F.col("y"), F.col("x")).select("a", "_cy", "_cx")
    right = p.select(F.col(id).alias("b"), cy.alias("_cy"), cx.alias("_cx"))
    # int() makes the cells beside zero meet twice there; pairs are kept once
    return left.join(right.hint("merge"), ["_cy", "_cx"]).filter("a < b").select("a", "b").distinct()


def within(a: DataFrame, b: DataFrame, radius_m: float, distance=geo.metres, on: Sequence[str] = (), carry: Sequence[str] = ()) -> DataFrame:
    """Band join: (a_id, b_id, m) of the points of both sides at most so many metres apart.

    Sides have id, lat and lng.  Cells are as high and, at the latitude's cosine, at least as wide as the
    radius, so neighbours suffice; the equi-join on cells shuffles both sides once and AQE splits hot cells.
    It is a merge join by hint: by the size of a well packed file, with all its rows nine times, a side would
    look small enough to broadcast, and a task that reads the other one would make all pairs.
    ``on`` names columns that must be equal and are part of the join's key; the columns ``carry`` of both
    sides come along with prefixes a_ and b_.
    """
    size = radius_m / geo.DEGREE_M * 1.0001
    wide = lambda lat: F.greatest(F.cos(F.radians(F.abs(F.floor(lat)) + 2)), F.lit(0.01))
    # the width depends on the row's whole-degree band, so a point is tried in its own and the next bands
    side = lambda d, p: d.filter("lat IS NOT NULL AND lng IS NOT NULL").select(*on, *[F.col(c).alias(f"{p}_{c}") for c in ("id", "lat", "lng", *carry)])
    x, y = side(a, "a"), side(b, "b")
    band = lambda d, c: d.withColumn("band", F.floor(c))
    x = band(x, F.col("a_lat")).withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    x = x.filter(F.col("a_lat").between(F.col("band") - size, F.col("band") + 1 + size))
    y = band(y, F.col("b_lat"))
    cy = lambda c: F.floor(c / size)
    cx = lambda c: F.floor(c / (size / wide(F.col("band"))))
    x = with_offsets(x, cy(F.col("a_lat")), cx(F.col("a_lng")))
    y = y.withColumn("_cy", cy(F.col("b_lat"))).withColumn("_cx", cx(F.col("b_lng")))
    m = distance(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))
    pairs = x.join(y.hint("merge"), ["band", "_cy", "_cx", *on]).withColumn("m", m).filter(F.col("m") <= radius_m)
    return pairs.select("a_id", "b_id", "m", *on, *[f"{p}_{c}" for p in "ab" for c in carry])


def nearest(a: DataFrame, b: DataFrame, radius_m: float, tie_m: float = 5.0) -> DataFrame:
    """The nearest b of each a within the radius, its score, rivals, and whether the second is nearly as near."""
    w = Window.partitionBy("a_id").orderBy("m", "b_id")
    n = within(a, b, radius_m).withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("m").over(w)).withColumn("n", F.count("*").over(Window.partitionBy("a_id")))
    return n.filter("rn = 1").select("a_id", "b_id", "m", (1 - F.col("m") / radius_m).alias("score"), (F.col("n") - 1).alias("rivals"), F.coalesce(F.col("second") - F.col("m") < tie_m, F.lit(False)).alias("ambiguous"))


def ranked_near(a: DataFrame, b: DataFrame, radius_m: float, top: int, on: Sequence[str] = ()) -> DataFrame:
    """(a_id, b_id, m, rank): the ``top`` nearest b of each a within the radius, ties to the smaller b."""
    w = Window.partitionBy("a_id").orderBy("m", "b_id")
    return within(a, b, radius_m, on=on).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("a_id", "b_id", "m", "rank")


def lateral_nearest(a: DataFrame, b: DataFrame, radius_m: float, on: Sequence[str] = ()) -> DataFrame:
    """(a_id, b_id, m) of every a: its nearest b within the radius with equal columns ``on``, or nulls."""
    best = within(a, b, radius_m, on=on).groupBy("a_id").agg(F.min(F.struct("m", "b_id")).alias("h"))
    return a.select(F.col("id").alias("a_id")).join(best, "a_id", "left").select("a_id", F.col("h.b_id").alias("b_id"), F.col("h.m").alias("m"))


def by_document(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of equal documents; the distance is evidence only."""
    x, y = a.filter(F.col(key).isNotNull()).alias("x"), b.filter(F.col(key).isNotNull()).alias("y")
    m = geo.metres(F.col("x.lat"), F.col("x.lng"), F.col("y.lat"), F.col("y.lng"))
    return x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}")).select(F.col("x.id").alias("a_id"), F.col("y.id").alias("b_id"), F.lit(1.0).alias("score"), m.alias("m"))


def by_address(a: DataFrame, b: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of equal address keys, unless both have coordinates that are too far apart; rivals of each a."""
    x, y = a.filter("address IS NOT NULL").alias("x"), b.filter("address IS NOT NULL").alias("y")
    m = geo.metres(F.col("x.lat"), F.col("x.lng"), F.col("y.lat"), F.col("y.lng"))
    pairs = x.join(y, F.col("x.address") == F.col("y.address")).select(F.col("x.id").alias("a_id"), F.col("y.id").alias("b_id"), m.alias("m"))
    pairs = pairs.filter(F.col("m").isNull() | (F.col("m") <= radius_m))
    rivals = F.count("*").over(Window.partitionBy("a_id")) - 1
    return pairs.select("a_id", "b_id", "m", F.when(F.col("m").isNotNull(), 1.0).otherwise(0.85).alias("score"), rivals.alias("rivals"))


def by_name(a: DataFrame, b: DataFrame, radius_m: float, least: float, tie: float) -> DataFrame:
    """Similar names near each other: the best b of each a and those within ``tie`` of it.  Sides have id, lat, lng, words."""
    pairs = within(a, b, radius_m, carry=["words"])
    pairs = pairs.select("a_id", "b_id", "m", similarity.overlap(F.col("a_words"), F.col("b_words")).alias("score")).filter(F.col("score") >= least)
    top = pairs.withColumn("best", F.max("score").over(Window.partitionBy("a_id"))).filter(F.col("best") - F.col("score") <= tie)
    n = F.count("*").over(Window.partitionBy("a_id"))
    return top.select("a_id", "b_id", "m", "score", (n > 1).alias("ambiguous"), (n - 1).alias("rivals"))


def capped_key_pairs(rows: DataFrame, keys: Sequence[str], cap: int, id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(pairs of rows with equal keys, groups over the cap): groups larger than ``cap`` give no pairs and are reported."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    fit = rows.join(n.filter((F.col("n") > 1) & (F.col("n") <= cap)).select(*keys), list(keys), "left_semi")
    pairs = fit.select(*keys, F.col(id).alias("a")).join(fit.select(*keys, F.col(id).alias("b")), list(keys)).filter("a < b").select("a", "b")
    return pairs, n.filter(F.col("n") > cap)


def key_pairs(rows: DataFrame, keys: Sequence[str], block: int = 10_000, id: str = "id", columns: Sequence[str] = ()) -> DataFrame:
    """(a, b) with a < b: all pairs of rows with equal keys, with ``columns`` of both sides (prefixes a_ and b_).

    Groups of more than ``block`` rows are dealt into parts of about that size; each part meets each, so no
    task holds a whole large group and none is left out.
    """
    n = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys, F.ceil(F.col("n") / block).cast("int").alias("_parts"))
    r = rows.select(*keys, F.col(id).alias("_id"), *columns).join(n, list(keys)).withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"))
    side = lambda p, own, other: r.select(*keys, F.col("_id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in columns], F.col("_part").alias(own), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias(other))
    pairs = side("a", "_l", "_r").join(side("b", "_r", "_l"), [*keys, "_l", "_r"]).filter("a < b")
    return pairs.select("a", "b", *[f"{p}_{c}" for p in "ab" for c in columns])


def in_polygons(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """The first polygon (smallest name) that holds each point: (id, name); points outside get none.

    Polygons (name, ring) meet points by the cells of their quadtree covers.
    """
    return areas.points_in_polygons(points, polygons, keeper(points.sparkSession)).groupBy("id").agg(F.min("name").alias("name"))


def many_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that refuses a right side with repeated keys."""
    if not right.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"the right side repeats values of {key}")
    return left.join(right, key, "left")


def unambiguous(right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The rows of a side whose key has one combination of values; the rest conflict."""
    one = right.select(key, *columns).distinct()
    return one.join(one.groupBy(key).count().filter("count = 1").select(key), key, "left_semi")


def snapshot_diff(old: DataFrame, new: DataFrame, key: Sequence[str], mark: str) -> DataFrame:
    """Full outer join on the key: ENTERED, LEFT, CHANGED or SAME by the column ``mark``."""
    o, n = old.select(*key, F.col(mark).alias("_old")), new.select(*key, F.col(mark).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "ENTERED").when(F.col("_new").isNull(), "LEFT").when(F.col("_old") != F.col("_new"), "CHANGED").otherwise("SAME")
    return o.join(n, list(key), "full_outer").select(*key, kind.alias("event"))


def cascade(left: DataFrame, right: DataFrame, steps: Sequence[tuple[str, Sequence[str]]], id: str = "id") -> DataFrame:
    """(id, right_id, step): each next key is tried only for rows that no earlier key matched; ties to the smaller right id."""
    rest, out = left, None
    for name, keys in steps:
        hit = rest.select(id, *keys).dropna().join(right.select(F.col(id).alias("right_id"), *keys).dropna(), list(keys)).groupBy(id).agg(F.min("right_id").alias("right_id")).withColumn("step", F.lit(name))
        out = hit if out is None else out.unionByName(hit)
        rest = rest.join(hit.select(id), id, "left_anti")
    return out


def greedy_one_to_one(proposals: DataFrame, keep) -> DataFrame:
    """Greedy assignment by (strength desc, m asc, a, b), each a and b used once; of repeated pairs the best counts.

    The result of going through the sorted list, in rounds.  A proposal waits for the better ones at its two ends.
    One that waits for none is taken.  One that waits for a single other is taken if that one isn't, so
    along paths of such proposals the fates alternate; pointer doubling finds how far each is from the head
    of its path, and a chain of any length is settled in one round.  ``keep`` writes a round's
    table; rounds go on until nothing is left.
    """
    best = F.min(F.struct((-F.col("strength")).alias("s"), "m"))
    left = keep(proposals.groupBy("a", "b").agg(best.alias("o")).select("a", "b", (-F.col("o.s")).alias("strength"), "o.m"))
    taken = left.limit(0)
    while not left.isEmpty():
        won = keep(_settled(left, keep))
        taken = taken.unionByName(won)
        left = keep(left.join(won.select("a"), "a", "left_anti").join(won.select("b"), "b", "left_anti"))
    return taken


def _settled(left: DataFrame, keep) -> DataFrame:
    """The proposals that are sure to be taken: those that wait for none, and those at even places of a path from one."""
    order, ends = F.struct((-F.col("strength")).alias("s"), "m", "a", "b"), {}
    for c in "ab":
        w = Window.partitionBy(c)
        ends |= {f"n{c}": F.row_number().over(w.orderBy("o")) - 1, f"top{c}": F.min("o").over(w)}
    r = left.withColumn("o", order).withColumns(ends).withColumn("waits", F.col("na") + F.col("nb"))
    for_ = F.when(F.col("waits") != 1, F.struct("a", "b")).when(F.col("na") == 1, F.struct("topa.a", "topa.b")).otherwise(F.struct("topb.a", "topb.b"))
    now = keep(r.select("a", "b", "strength", "m", for_.alias("to"), (F.col("waits") == 1).cast("int").alias("odd"), (F.col("waits") == 0).alias("sure"), F.lit(True).alias("moved")))
    while not now.filter("moved AND odd IS NOT NULL AND NOT (to.a = a AND to.b = b)").isEmpty():
        far = now.select(F.struct("a", "b").alias("to"), F.col("to").alias("next"), F.col("odd").alias("more"), F.col("sure").alias("head"))
        step = now.join(far, "to").select("a", "b", "strength", "m", F.col("next").alias("to"), ((F.col("odd") + F.col("more")) % 2).alias("odd"), (F.col("sure") | F.col("head")).alias("sure"), (F.col("next") != F.col("to")).alias("moved"))
        now = keep(step)
    return now.filter("sure AND odd = 0").select("a", "b", "strength", "m")


def rare_token_pairs(a: DataFrame, b: DataFrame, most: int, at_least: int = 1) -> DataFrame:
    """(a_id, b_id, shared): rows that share words which at most ``most`` rows of b hold.  Sides have id and words."""
    post = b.select(F.col("id").alias("b_id"), F.explode("words").alias("token"))
    rare = post.groupBy("token").count().filter(F.col("count") <= most).select("token")
    post = post.join(rare, "token", "left_semi")
    return a.select(F.col("id").alias("a_id"), F.explode("words").alias("token")).join(post, "token").groupBy("a_id", "b_id").agg(F.count("*").alias("shared")).filter(F.col("shared") >= at_least)


def common_tokens(b: DataFrame, most: int) -> DataFrame:
    """(token, n): the words that ``rare_token_pairs`` leaves out, with the rows that hold them."""
    return b.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") > most)


def offset_block_pairs(rows: DataFrame, radius_m: float, cap: int, across: str | None = None) -> DataFrame:
    """Pairs of rows with the same number within the radius: blocks by (number, cell), half-plane steps.

    Blocks of more than ``cap`` rows are dealt into parts of about that size, each tried with all their neighbours.
    Rows have id, number, x and y in metres; ``across`` names a column that must differ.
    """
    r = rows.withColumn("cx", F.floor(F.col("x") / radius_m)).withColumn("cy", F.floor(F.col("y") / radius_m))
    n = r.groupBy("number", "cx", "cy").agg(F.ceil(F.count("*") / cap).cast("int").alias("parts"))
    r = r.join(n, ["number", "cx", "cy"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    keep = ["id", "number", "x", "y"] + ([across] if across else [])
    left = with_offsets(r.select(*keep, "cx", "cy"), F.col("cy"), F.col("cx"), HALF_STEPS).select(*[F.col(c).alias(f"l_{c}") for c in keep], F.col("cx").alias("lx"), F.col("cy").alias("ly"), "_cx", "_cy")
    left = left.join(n.select(F.col("number").alias("l_number"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), "parts"), ["l_number", "_cx", "_cy"])
    left = left.withColumn("l_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    j = left.join(r, (F.col("l_number") == r["number"]) & (F.col("_cx") == r["cx"]) & (F.col("_cy") == r["cy"]) & (F.col("l_part") == r["part"]))
    j = j.filter((F.col("lx") != F.col("cx")) | (F.col("ly") != F.col("cy")) | (F.col("l_id") < F.col("id")))
    j = j.filter(F.hypot(F.col("x") - F.col("l_x"), F.col("y") - F.col("l_y")) <= radius_m)
    if across:
        j = j.filter(F.col(f"l_{across}") != F.col(across))
    return j.select(F.least("l_id", "id").alias("a"), F.greatest("l_id", "id").alias("b"))


def substitution_pairs(rows: DataFrame, block: Sequence[str]) -> DataFrame:
    """Pairs of different texts of a block that differ in exactly one word.  Rows have the block's columns and ``name``.

    Texts meet by what is left without one of their words, at its place, so only pairs of the result are made.
    """
    d = rows.select(*block, "name").distinct().dropna().withColumn("w", text.words(F.col("name")))
    d = d.select(*block, "name", "w", F.posexplode("w").alias("i", "word"))
    context = F.array_join(F.transform("w", lambda t, i: F.when(i == F.col("i"), F.lit("{}")).otherwise(t)), " ")
    d = d.select(*block, "name", "word", context.alias("context"))
    p = key_pairs(d, [*block, "context"], id="name", columns=["word", *block]).filter("a_word <> b_word")
    return p.select(*[F.col(f"a_{c}").alias(c) for c in block], "a", "b", F.col("a_word").alias("word_a"), F.col("b_word").alias("word_b"))
