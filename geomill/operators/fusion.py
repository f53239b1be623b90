"""Entity resolution: decisions on pairs, components, survivors, merge chains, upserts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomill.functions import geo, identifiers, similarity, text

# Points of a pair's evidence, and the bounds of its decisions.
POINTS = {"address": 5, "street": 2, "site": 4, "phone": 2, "name": 3, "category": 1}
NEAR_M, ASK, MERGE, SAME_NAME, NO_NUMBER_M = 20.0, 4, 8, 0.85, 1000.0


def prepared(rows: DataFrame) -> DataFrame:
    """The normal forms that ``score_pairs`` compares, once a row instead of once a pair.

    ``rows``: id, name, street, number, phone, site, category, lat, lng."""
    name = text.void_to_null(F.col("name"))
    return rows.select(
        "id", "lat", "lng", text.norm_name(name).alias("name_key"), text.tokens(name).alias("name_words"), F.coalesce(text.norm_name(text.void_to_null(F.col("street"))), F.lit("")).alias("street_key"),
        F.coalesce(text.digits(F.col("number")), F.lit("")).alias("number_key"), text.phone_key(F.col("phone")).alias("phone_key"), text.domain(F.col("site")).alias("site_key"), F.coalesce(text.norm_name(F.col("category")), F.lit("")).alias("category_key"),
    )


def score_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` of prepared rows (columns of both sides with prefixes a_ and b_) with m, points, name_similarity,
    decision (merge, ask, discard) and confidence."""
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    p = pairs.withColumn("m", geo.haversine(a("lat"), a("lng"), b("lat"), b("lng")))
    p = p.withColumn("name_similarity", similarity.jaccard_of(a("name_words"), b("name_words"), a("name_key"), b("name_key")))
    same = lambda c: (a(f"{c}_key") != "") & (a(f"{c}_key") == b(f"{c}_key"))
    near = F.coalesce(F.col("m") <= NEAR_M, F.lit(False))
    street, number, similar = same("street"), same("number"), F.col("name_similarity")
    phone = same("phone") & (F.length(a("phone_key")) >= 8) & near
    give = lambda cond, n: F.when(cond, n).otherwise(0)
    points = F.when(street & number, POINTS["address"]).when(street, POINTS["street"]).otherwise(0) + give(same("site") & near, POINTS["site"]) + give(phone, POINTS["phone"]) + give(similar >= 0.8, POINTS["name"]) + give(same("category"), POINTS["category"])
    p = p.withColumn("points", points)
    only_phone = phone & (F.col("points") == POINTS["phone"])
    numbered = (a("number_key") != "") & (b("number_key") != "")
    certain = street & (similar >= SAME_NAME) & (number | (~numbered & F.coalesce(F.col("m") <= NO_NUMBER_M, F.lit(False))))
    decision = (
        F.when(only_phone, "discard").when(certain, "merge").when(F.col("points") >= MERGE, "merge").when(F.col("points") >= ASK, "ask")
        .when(street & near, "ask").otherwise("discard")
    )
    confidence = (
        F.when(only_phone, 1).when(certain, 10).when(F.col("points") >= MERGE, F.least(F.lit(10), 8 + F.floor((F.col("points") - MERGE) / 2)))
        .when(F.col("points") >= ASK, 5).when(street & near, 4).otherwise(F.greatest(F.lit(1), F.col("points")))
    )
    return p.withColumn("decision", decision).withColumn("confidence", confidence.cast("int"))


def both_sides(pairs: DataFrame, rows: DataFrame, id: str = "id") -> DataFrame:
    """(a, b) pairs with both rows' columns, prefixed."""
    side = lambda p: rows.select(*[F.col(c).alias(f"{p}_{c}") for c in rows.columns])
    return pairs.join(side("a"), F.col("a") == F.col(f"a_{id}")).join(side("b"), F.col("b") == F.col(f"b_{id}"))


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, component): the smallest id of each connected group of edges (a, b).

    ``keep`` writes a round's table.  Edges are written once; each round points every class of ids to its
    smallest neighbour, follows the pointers to their ends and contracts the edges, so at least half of the
    classes that still have an edge vanish.
    """
    links = keep(edges.select("a", "b").filter("a <> b").distinct())
    now, label = links, None
    while True:
        ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to"))))
        point = keep(now.select(ends.alias("e")).select("e.*").groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("to")))
        while True:
            far = point.select(F.col("id").alias("to"), F.col("to").alias("far"))
            moved = keep(point.join(far, "to").select("id", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")))
            point = moved.select("id", "to")
            if moved.filter("moved").isEmpty():
                break
        over = point.select(F.col("id").alias("to"), F.col("to").alias("far"))
        label = point if label is None else keep(label.join(over, "to", "left").select("id", F.coalesce("far", "to").alias("to")))
        end = lambda c: point.select(F.col("id").alias(c), F.col("to").alias(f"_{c}"))  # noqa: B023, E731
        left = now.join(end("a"), "a").join(end("b"), "b").filter("_a <> _b")
        now = keep(left.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        if now.isEmpty():
            return label.select("id", F.col("to").alias("component"))


def survivors(members: DataFrame) -> DataFrame:
    """(component, survivor): a place id wins, then more evidence, then the smaller id as text.  Members: component, id, place, evidence."""
    order = F.struct((~identifiers.is_place_id(F.col("place"))).alias("p"), (-F.col("evidence")).alias("e"), F.col("id").cast("string").alias("t"))
    return members.groupBy("component").agg(F.min_by("id", order).alias("survivor"))


def resolve_chains(merged: DataFrame, keep: Callable[[DataFrame], DataFrame], rounds: int = 64) -> DataFrame:
    """(id, into): the last destination of every merge (id, into), by pointer jumping; cycles raise."""
    now = keep(merged.select("id", "into"))
    for _ in range(rounds):
        nxt = keep(now.join(now.select(F.col("id").alias("into"), F.col("into").alias("far")), "into", "left").select("id", F.coalesce("far", "into").alias("into"), F.col("far").isNotNull().alias("moved")))
        now = nxt.select("id", "into")
        if nxt.filter("moved").isEmpty():
            return now
    raise ValueError("merges form a cycle")


#: Merges in order (see ``fuse_in_order``): ``id`` went into ``into`` by the decision (a, b) of this confidence.
LOG = "id long, into long, a long, b long, confidence double"


def oriented(decisions: DataFrame, records: DataFrame) -> DataFrame:
    """(confidence, a, b, alive, dead) of decisions (a, b, confidence): which of the two records would survive.

    A place id wins, then more evidence, then the smaller id as text.  Records: id, place, evidence.
    """
    rank = F.struct((~identifiers.is_place_id(F.col("place"))).alias("p"), (-F.col("evidence")).alias("e"), F.col("id").cast("string").alias("t"))
    r = records.select("id", rank.alias("rank"))
    side = lambda c: r.select(F.col("id").alias(c), F.col("rank").alias(f"r{c}"))
    d = decisions.filter("a <> b").groupBy("a", "b").agg(F.max(F.col("confidence").cast("double")).alias("confidence")).join(side("a"), "a").join(side("b"), "b")
    first = F.col("ra") < F.col("rb")
    return d.select("confidence", "a", "b", F.when(first, F.col("a")).otherwise(F.col("b")).alias("alive"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("dead"))


def fuse_in_order(decisions: DataFrame, records: DataFrame, keep: Callable[[DataFrame], DataFrame], apart: Sequence[str] = (), same: Sequence[str] = (), most: int = 20_000) -> DataFrame:
    """The merges (``LOG``) of decisions (a, b, confidence) taken one after another, by confidence desc, a, b.

    A decision merges the groups that its records are in by then: the group of the record that dies goes into
    that of the one that survives (``oriented``); records of one group already are left.  A merge is
    refused if the two groups would share a value of a column of ``apart`` (one record a source) or differ
    in a column of ``same`` (different documents); nulls don't count.

    Decisions of one connected group are independent of all others.  Groups of up to ``most`` decisions go through
    their list in a task each; larger ones by rounds: a decision that is the best one left for both its groups is
    next in its neighbourhood whatever happens elsewhere, so all such decisions are taken, or refused, at once.
    """
    d = keep(oriented(decisions, records))
    label = components(d.select("a", "b"), keep)
    d = keep(d.join(label.select(F.col("id").alias("a"), "component"), "a"))
    n = d.groupBy("component").agg(F.count("*").alias("n")).withColumn("large", F.col("n") > most)
    d = keep(d.join(n.drop("n"), "component"))
    rules = records.select("id", *apart, *same).dropDuplicates(["id"])
    log = keep(_fuse_small(d.filter("NOT large"), rules, list(apart), list(same)))
    large = d.filter("large").drop("large", "component")
    return log if large.isEmpty() else log.unionByName(_fuse_rounds(large, rules, list(apart), list(same), keep))


def _fuse_small(d: DataFrame, rules: DataFrame, apart: list[str], same: list[str]) -> DataFrame:
    ends = d.select("component", F.explode(F.array("a", "b")).alias("id")).distinct().join(rules, "id")
    rows = d.select("component", "confidence", "a", "b", "alive", "dead")
    rows = rows.unionByName(ends.select("component", F.col("id").alias("a"), *apart, *same), allowMissingColumns=True) if apart or same else rows

    def go(table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in table.column_names}
        held = {c: {} for c in apart + same}  # of each group's first record, the values of the group
        for i, alive in enumerate(cols["alive"]):
            if alive is None:
                for c in held:
                    held[c][cols["a"][i]] = {cols[c][i]} - {None}
        short: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while top in short:
                top = short[top]
            while x != top:
                short[x], x = top, short.get(x, top)
            return top

        out = []
        order = sorted((i for i, x in enumerate(cols["alive"]) if x is not None), key=lambda i: (-cols["confidence"][i], cols["a"][i], cols["b"][i]))
        for i in order:
            x, y = find(cols["alive"][i]), find(cols["dead"][i])
            if x == y or any(held[c].get(x, set()) & held[c].get(y, set()) for c in apart) or any(len(held[c].get(x, set()) | held[c].get(y, set())) > 1 for c in same):
                continue
            short[y] = x
            for c in held:
                held[c][x] = held[c].get(x, set()) | held[c].get(y, set())
            out.append((y, x, cols["a"][i], cols["b"][i], cols["confidence"][i]))
        names = ("id", "into", "a", "b", "confidence")
        kinds = (pa.int64(),) * 4 + (pa.float64(),)
        return pa.table({n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})

    return rows.groupBy("component").applyInArrow(go, LOG)


def _fuse_rounds(d: DataFrame, rules: DataFrame, apart: list[str], same: list[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    sets = [F.when(F.col(c).isNotNull(), F.array(F.col(c))).otherwise(F.expr(f"array() :: array<{dict(rules.dtypes)[c]}>")).alias(c) for c in apart + same]
    ends = d.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    groups, log = keep(ends.join(rules.select("id", *sets), "id")), None
    left = keep(d.withColumns({"x": F.col("alive"), "y": F.col("dead")}))
    while not left.isEmpty():
        order = F.struct((-F.col("confidence")).alias("c"), "a", "b")
        every = left.select(order.alias("o"), F.explode(F.array("x", "y")).alias("g")).groupBy("g").agg(F.min("o").alias("best"))
        best = lambda c: every.select(F.col("g").alias(c), F.col("best").alias(f"best{c}"))  # noqa: B023, E731
        now = keep(left.join(best("x"), "x").join(best("y"), "y").filter((F.col("bestx") == F.col("besty")) & (F.col("bestx") == order)).drop("bestx", "besty"))
        side = lambda c: groups.select(F.col("id").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in apart + same])  # noqa: B023, E731
        met = now.join(side("x"), "x").join(side("y"), "y")
        fits = F.lit(True)
        for k in apart:
            fits &= ~F.arrays_overlap(f"x_{k}", f"y_{k}")
        for k in same:
            fits &= F.size(F.array_union(f"x_{k}", f"y_{k}")) <= 1
        met = keep(met.withColumn("fits", fits))
        merged = keep(met.filter("fits"))
        part = keep(merged.select(F.col("y").alias("id"), F.col("x").alias("into"), "a", "b", "confidence"))
        log = part if log is None else log.unionByName(part)
        joined = merged.select(F.col("x").alias("id"), *[F.array_union(f"x_{k}", f"y_{k}").alias(k) for k in apart + same])
        groups = keep(groups.join(merged.select(F.explode(F.array("x", "y")).alias("id")), "id", "left_anti").unionByName(joined))
        moved = part.select("id", "into")
        to = lambda c: moved.select(F.col("id").alias(c), F.col("into").alias(f"to{c}"))  # noqa: B023, E731
        rest = left.join(now.select("a", "b", "confidence"), ["a", "b", "confidence"], "left_anti").join(to("x"), "x", "left").join(to("y"), "y", "left")
        rest = rest.withColumns({"x": F.coalesce("tox", "x"), "y": F.coalesce("toy", "y")}).drop("tox", "toy").filter("x <> y")
        left = keep(rest.select("confidence", "a", "b", "alive", "dead", "x", "y"))
    return log


def destinations(log: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, into): where every merged record ends up."""
    return resolve_chains(log, keep)


def without(decisions: DataFrame, dropped: DataFrame, log: DataFrame, records: DataFrame, keep: Callable[[DataFrame], DataFrame], **how) -> DataFrame:
    """The log after the decisions ``dropped`` (a, b) are withdrawn; groups that none of them formed stay as they are.

    A decision that is in no merge of the log has formed nothing, so only groups with a withdrawn merge are
    taken apart and fused again from their remaining decisions (``how`` as for ``fuse_in_order``).  Without ``apart`` and ``same``
    those are the connected groups of the log; with them a withdrawn merge may free one that was refused, and the groups are
    those that decisions connect.
    """
    gone = dropped.select("a", "b").distinct()
    if how.get("apart") or how.get("same"):
        label = components(decisions.select("a", "b"), keep)
    else:
        label = components(log.select(F.col("id").alias("a"), F.col("into").alias("b")), keep)
    at = label.select(F.col("id").alias("a"), "component")
    hit = keep(log.join(gone, ["a", "b"], "left_semi").join(at, "a").select("component").distinct())
    touched = keep(label.join(hit, "component", "left_semi").select(F.col("id").alias("a")))
    again = decisions.join(touched, "a", "left_semi").join(gone, ["a", "b"], "left_anti")
    return log.join(touched, "a", "left_anti").select(log.columns).unionByName(fuse_in_order(again, records, keep, **how))


def same_source(rows: DataFrame, keep: Callable[[DataFrame], DataFrame], block: Sequence[str]) -> DataFrame:
    """(id, into): duplicates of one block, merged into their group's smallest id only if directly similar to it.

    Rows: id, name and the block's columns; names that hold a document number take no part.
    """
    r = rows.filter(~F.col("name").rlike(r"[0-9][0-9.\-/]{7,}"))
    x, y = r.select(*block, F.col("id").alias("a"), F.col("name").alias("na")), r.select(*block, F.col("id").alias("b"), F.col("name").alias("nb"))
    edges = keep(x.join(y, list(block)).filter((F.col("a") < F.col("b")) & (similarity.jaccard(F.col("na"), F.col("nb")) >= 0.8)).select("a", "b"))
    comp = components(edges, keep)
    direct = edges.join(comp.withColumnsRenamed({"id": "b", "component": "c"}), "b").filter("a = c")
    return direct.select(F.col("b").alias("id"), F.col("a").alias("into"))


def co_located(rows: DataFrame, places: int = 5) -> DataFrame:
    """Groups of equal plain names at equal rounded coordinates: (ids, n) with more than one id."""
    unit = 10.0**places
    key = [text.norm_name(F.col("name")).alias("name"), F.floor(F.col("lat") * unit + 0.5).cast("long").alias("y"), F.floor(F.col("lng") * unit + 0.5).cast("long").alias("x")]
    return rows.groupBy(*key).agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count("*").alias("n")).filter("n > 1")


def upsert(target: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of both by key; new values win, but an empty one never overwrites."""
    t, n = target.alias("t"), new.alias("n")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key]
    filled = lambda c: F.when(F.trim(c.cast("string")) != "", c)
    return t.join(n, on, "full_outer").select(*[F.coalesce(filled(F.col(f"n.{c}")), F.col(f"t.{c}")).alias(c) for c in target.columns])


def link_sources(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links (poi, source, source_id, confidence, name) after an upsert: one for each (poi, source, source_id); of several the most confident, then
    the one that was there, then the greater name; an empty name never replaces one."""
    key = ["poi", "source", "source_id"]
    both = links.withColumn("_old", F.lit(1)).unionByName(new.withColumn("_old", F.lit(0)))
    best = F.max(F.struct("confidence", "_old", F.coalesce("name", F.lit("")).alias("name"))).alias("best")
    name = F.max(F.when(F.trim("name") != "", F.struct("confidence", "_old", "name"))).alias("named")
    return both.groupBy(*key).agg(best, name).select(*key, "best.confidence", F.col("named.name").alias("name"))


def comparable(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a name or an address, those with neither)."""
    ok = F.coalesce(F.trim("name") != "", F.lit(False)) | F.coalesce(F.trim("address") != "", F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def unmerge(merged: DataFrame, active: DataFrame, still: Column) -> DataFrame:
    """Merged rows (id, into, name, ...) that come back: those that today's rule ``still`` wouldn't merge, without an active twin by name."""
    return merged.filter(~still).join(active.select("name"), "name", "left_anti")


def shared_doors(rows: DataFrame, most: int = 2) -> DataFrame:
    """(street, number, names): doors with more than so many different names."""
    return rows.filter("street <> '' AND number <> ''").groupBy("street", "number").agg(F.countDistinct(text.norm_name(F.col("name"))).alias("names")).filter(F.col("names") > most)


def reuse(source: DataFrame, owned: DataFrame, start: int, key: str = "place") -> DataFrame:
    """Rows of ``source`` that ``owned`` lacks, with new ids from ``start`` in the order of the old ones: (old_id, new_id).

    A prefix sum over partitions would be needed for very many rows; ids follow a global order here, so the
    numbering is by partition ranks of a range sort."""
    fresh = source.join(owned.select(key), key, "left_anti").select(F.col("id").alias("old_id"))
    n = max(1, int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = fresh.repartitionByRange(n, "old_id").withColumn("part", F.spark_partition_id())
    part = part.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy("old_id")))
    sizes = part.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    return part.join(F.broadcast(before), "part").select("old_id", (F.lit(start - 1) + F.col("before") + F.col("rn")).alias("new_id"))
