"""Rings of areas from the ways of their relations, by pointer doubling over directed ways."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A directed way: the area, the way's first place among its members, and its direction.
KEY = ["area", "way", "back"]


def assemble(ways: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(area, ring, refs) of the closed rings that the ways (area, way, refs) of each area form, end to end.

    Each way is two directed ones.  The next one of a directed way is that which leaves its end by the other way
    there; ends where not exactly two ways of an area meet lead nowhere, so open chains give no ring.  Every
    ring is found in both directions; the one whose smallest way runs forward counts.  Its ways find the
    smallest one and their distance to it by doubling their pointers, so a ring of n ways takes
    log n joins.  ``ring`` is the number of the smallest way.
    """
    w = ways.filter(F.size("refs") >= 2).select("area", "way", "refs")
    closed = w.filter(F.element_at("refs", 1) == F.element_at("refs", -1)).select("area", F.col("way").alias("ring"), "refs")
    w = w.filter(F.element_at("refs", 1) != F.element_at("refs", -1))
    h = w.select("area", "way", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), F.element_at("refs", 1).alias("f"), F.element_at("refs", -1).alias("l"))
    h = h.select(*KEY, F.when(F.col("back"), F.col("l")).otherwise(F.col("f")).alias("start"), F.when(F.col("back"), F.col("f")).otherwise(F.col("l")).alias("end"))
    pairs = h.groupBy("area", "start").agg(F.count("*").alias("n"), F.min(F.struct("way", "back")).alias("one"), F.max(F.struct("way", "back")).alias("two")).filter("n = 2")
    nxt = h.join(pairs.select("area", F.col("start").alias("end"), "one", "two"), ["area", "end"])
    to = F.when(F.col("one.way") == F.col("way"), F.col("two")).otherwise(F.col("one"))
    # least: the smallest directed way among the next ``seen`` ones; steps: how far it is
    now = keep(nxt.select(*KEY, to.alias("to"), to.alias("least"), F.lit(1).cast("long").alias("steps"), F.lit(1).cast("long").alias("seen"), F.lit(True).alias("moved")))
    n, moved = now.count(), True
    while n and moved:
        far = now.select("area", F.struct("way", "back").alias("to"), F.col("to").alias("to2"), F.col("least").alias("least2"), F.col("steps").alias("steps2"), F.col("seen").alias("seen2"))
        better = F.col("least2") < F.col("least")
        j = now.join(far, ["area", "to"]).select(  # what leads nowhere falls out
            *KEY, F.col("to2").alias("to"), F.when(better, F.col("least2")).otherwise(F.col("least")).alias("least"),
            F.when(better, F.col("seen") + F.col("steps2")).otherwise(F.col("steps")).alias("steps"), (F.col("seen") + F.col("seen2")).alias("seen"), better.alias("moved"),
        )
        now, before = keep(j), n
        n, better_any = now.agg(F.count("*"), F.coalesce(F.max("moved"), F.lit(False))).first()
        # where a round changes no minimum and loses no row, all that is left lies on rings whose smallest way is known
        moved = better_any or n < before
    ring = now.filter("NOT least.back").select(*KEY, F.col("least.way").alias("ring"), (-F.col("steps")).alias("place"))
    parts = ring.join(w, ["area", "way"]).withColumn("refs", F.when(F.col("back"), F.reverse("refs")).otherwise(F.col("refs")))
    parts = parts.groupBy("area", "ring").agg(F.array_sort(F.collect_list(F.struct("place", F.slice("refs", F.lit(1), F.size("refs") - 1).alias("refs")))).alias("p"))
    joined = parts.select("area", "ring", F.flatten(F.transform("p", lambda x: x["refs"])).alias("refs"))
    return closed.unionByName(joined.select("area", "ring", F.concat("refs", F.slice("refs", 1, 1)).alias("refs")))


def with_points(rings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(area, ring, corners) with the nodes' (id, lat, lng) places; a ring that lacks a node is left out."""
    p = rings.select("area", "ring", F.size("refs").alias("n"), F.posexplode("refs").alias("at", "ref")).join(nodes.select(F.col("id").alias("ref"), "lat", "lng"), "ref")
    out = p.groupBy("area", "ring", "n").agg(F.array_sort(F.collect_list(F.struct("at", "lat", "lng"))).alias("c")).filter(F.size("c") == F.col("n"))
    return out.select("area", "ring", F.transform("c", lambda x: F.struct(x["lat"].alias("lat"), x["lng"].alias("lng"))).alias("corners"))
