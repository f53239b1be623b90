"""Numbers that a building, an address or a block seems to lack, graded by what speaks for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Absent numbers for each present one, share of floors that may be absent, steps beyond a floor's range that are plausible, opposite places.
MOST_ABSENT, ABSENT_FLOORS, PLAUSIBLE_STEPS = 3.0, 0.30, 2
OPPOSITES = ((("FRENTE", "FRT"), ("FUNDOS", "FDS")), (("LADO DIREITO", "DIR"), ("LADO ESQUERDO", "ESQ")))


def unit_gaps(rows: DataFrame, least: int = 3) -> DataFrame:
    """(building, unit, kind, grade, steps) of rows (building, unit = floor * 100 + position).

    A: within the range of its own floor.  B: on a floor without any unit between two that have it, where no more than
    ``ABSENT_FLOORS`` of the floors (or one) are absent.  C: a position of other floors beyond the floor's range, so many
    steps away.  Buildings of fewer than ``least`` units, and A and C where absent units outnumber present ones
    ``MOST_ABSENT`` times, give none.  A floor has a hundred positions at most; floors have no bound.
    """
    u = rows.filter("building IS NOT NULL AND unit IS NOT NULL").select("building", F.col("unit").cast("long").alias("unit")).distinct()
    u = u.withColumns({"floor": F.floor(F.col("unit") / 100), "pos": F.pmod("unit", F.lit(100))})
    floors = u.groupBy("building", "floor").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.collect_set("pos").alias("held"), F.count("*").alias("n"))
    of = floors.groupBy("building").agg(
        F.sum("n").alias("units"), F.count("*").alias("floors"), F.count(F.when(F.col("floor") > 0, 1)).alias("above"), F.min("floor").alias("first"), F.max("floor").alias("last"))
    places = u.filter("pos > 0").groupBy("building").agg(F.collect_set("pos").alias("places"))
    # a building with position 0 alone has no places, though floors between
    grid = floors.join(of.filter(F.col("units") >= least), "building").join(places, "building", "left").withColumn("places", F.coalesce("places", F.array().cast("array<long>")))
    # of a building's grid, what is absent: counted before it is made
    kept = F.size(F.array_remove("held", 0))
    grid = grid.withColumn("absent", F.sum(F.size("places") - kept).over(Window.partitionBy("building")))
    inner = grid.filter(F.col("absent") <= F.col("units") * MOST_ABSENT).withColumn("pos", F.explode(F.array_except("places", "held")))
    within = (F.col("lo") < F.col("pos")) & (F.col("pos") < F.col("hi"))
    steps = F.when(F.col("pos") > F.col("hi"), F.col("pos") - F.col("hi")).otherwise(F.col("lo") - F.col("pos"))
    inner = inner.select("building", (F.col("floor") * 100 + F.col("pos")).alias("unit"), F.when(within, "A").otherwise("C").alias("kind"), F.when(within | (steps <= PLAUSIBLE_STEPS), F.when(within, "SUSTENTADA").otherwise("PLAUSIVEL")).otherwise("ESPECULATIVA").alias("grade"), F.when(~within, steps).alias("steps"))
    w = Window.partitionBy("building").orderBy("floor")
    lack = F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.lit(1)) + 1) - F.col("above")
    pair = grid.withColumns({"up": F.lead("floor").over(w), "held_up": F.lead("held").over(w)}).filter((F.col("up") == F.col("floor") + 2) & (F.col("floor") + 1 > 0))
    pair = pair.filter(lack <= F.greatest(F.lit(1), F.floor(F.col("floors") * ABSENT_FLOORS)))
    between = pair.select("building", "floor", F.explode(F.array_intersect("held", "held_up")).alias("pos"))
    between = between.select("building", ((F.col("floor") + 1) * 100 + F.col("pos")).alias("unit"), F.lit("B").alias("kind"), F.lit("SUSTENTADA").alias("grade"), F.lit(None).cast("long").alias("steps"))
    return inner.unionByName(between)


def position_gaps(rows: DataFrame) -> DataFrame:
    """(address, missing, kind, grade) of rows (address, positions, described): a unit's position words, and whether it has another descriptor.

    Where one of two opposite places is named and the other isn't: D, all units bear it, so none can be the other one; E, the
    others are told apart by descriptors of their own; F, a unit without any descriptor is the other one, unnamed.
    """
    words = F.transform(F.coalesce("positions", F.array().cast("array<string>")), F.upper)
    out = None
    for one, two in OPPOSITES:
        has = lambda side: F.arrays_overlap(words, F.array(*[F.lit(x) for x in side]))  # noqa: B023, E731
        r = rows.select("address", has(one).alias("one"), has(two).alias("two"), F.coalesce("described", F.lit(False)).alias("described"))
        g = r.groupBy("address").agg(
            F.max("one").alias("one"), F.max("two").alias("two"), *[F.count(F.when(~F.col(c), 1)).alias(f"no_{c}") for c in ("one", "two")],
            *[F.count(F.when(~F.col(c) & ~F.col("described"), 1)).alias(f"bare_{c}") for c in ("one", "two")],
        ).filter(F.col("one") != F.col("two"))
        pick = lambda c: F.when(F.col("one"), F.col(f"{c}_one")).otherwise(F.col(f"{c}_two"))  # noqa: B023, E731
        kind = F.when(pick("no") == 0, "D").when(pick("bare") > 0, "F").otherwise("E")
        part = g.select("address", F.when(F.col("one"), max(two, key=len)).otherwise(max(one, key=len)).alias("missing"), kind.alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("grade", F.when(F.col("kind") == "D", "SUSTENTADA").when(F.col("kind") == "E", "PLAUSIVEL").otherwise("ESPECULATIVA"))


def linear_gaps(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, missing): the whole numbers that a group lacks between its least and its greatest, unless they outnumber it ``MOST_ABSENT`` times."""
    v = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("long").alias("v")).distinct()
    w = Window.partitionBy(*by)
    v = v.withColumns({"next": F.lead("v").over(w.orderBy("v")), "n": F.count("*").over(w), "lo": F.min("v").over(w), "hi": F.max("v").over(w)})
    v = v.filter((F.col("next") > F.col("v") + 1) & (F.col("hi") - F.col("lo") + 1 - F.col("n") <= F.col("n") * MOST_ABSENT))
    return v.select(*by, F.explode(F.sequence(F.col("v") + 1, F.col("next") - 1)).alias("missing"))


def block_lot_gaps(rows: DataFrame) -> DataFrame:
    """(address, block, lot, level, missing) of rows (address, block, lot, house) as texts; only whole numbers count: blocks of an address, lots of a block, houses of a lot."""
    number = lambda c: F.when(F.col(c).rlike("^[0-9]+$"), F.col(c).try_cast("long"))
    r = rows.select("address", F.coalesce("block", F.lit("")).alias("block"), F.coalesce("lot", F.lit("")).alias("lot"), number("block").alias("b"), number("lot").alias("l"), number("house").alias("h"))
    none = F.lit(None).cast("string")
    blocks = linear_gaps(r, ["address"], "b").select("address", none.alias("block"), none.alias("lot"), F.lit("block").alias("level"), "missing")
    lots = linear_gaps(r, ["address", "block"], "l").select("address", "block", none.alias("lot"), F.lit("lot").alias("level"), "missing")
    houses = linear_gaps(r, ["address", "block", "lot"], "h").select("address", "block", "lot", F.lit("house").alias("level"), "missing")
    return blocks.unionByName(lots).unionByName(houses)
