"""How well the house numbers of a street fit its geometry and each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomill.functions import geo

#: Metres a degree of latitude, points a part, and the bounds of the classes (fixed values).
LAT_M, ORDER, PARITY, GAP = 110_900.0, 30, 25, 25
CLASSES = ((60, "ALTA"), (40, "MEDIA"), (20, "BAIXA"))


def _even(x: Column) -> Column:
    return F.bround(x, 0).cast("int")


def numbering_score(rows: DataFrame, street: Sequence[str]) -> DataFrame:
    """(id, order_part, parity_part, gap_part, score, grade) of every row (id, street columns, number, lat, lng).

    order: share of consecutive numbers whose positions along the line from the lowest to the highest number rise
    alike; parity: share of the street's commoner parity, less for those of the other; gap: distance to the
    next number against the street's median distance.  Streets of one usable row get full marks;
    rows without a number, a point or a street get none.
    """
    usable = F.coalesce((F.col("number") > 0) & F.col("lat").isNotNull() & F.col("lng").isNotNull(), F.lit(False))
    for c in street:
        usable = usable & F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    r = rows.select("id", *street, F.col("number").cast("double").alias("n"), "lat", "lng", usable.alias("usable"))
    all_ = Window.partitionBy(*street)
    run = all_.orderBy("n", "id")
    r = r.filter("usable").withColumns({
        "size": F.count("*").over(all_), "x": F.col("lng") * geo.DEGREE_M * F.cos(F.radians(F.avg("lat").over(all_))), "y": F.col("lat") * LAT_M,
        "odd": F.pmod("n", F.lit(2.0)), "same": F.count("*").over(Window.partitionBy(*street, "n")), "before": F.lag("n").over(run), "after": F.lead("n").over(run),
    })
    ends = F.struct("n", "id", "x", "y")
    r = r.withColumns({"lo": F.min(ends).over(all_), "hi": F.max(ends).over(all_)})
    dx, dy = F.col("hi.x") - F.col("lo.x"), F.col("hi.y") - F.col("lo.y")
    length = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-9))
    r = r.withColumn("along", (F.col("x") - F.col("lo.x")) * dx / length + (F.col("y") - F.col("lo.y")) * dy / length)
    step = F.col("along") - F.lag("along").over(run)
    agree = F.when(F.col("before").isNotNull(), ((F.col("n") - F.col("before") > 0) == (step > 0)).cast("int"))
    r = r.withColumns({"agree": agree, "interval": F.col("n") - F.col("before"), "most": _even(F.avg("odd").over(all_)).cast("double")})
    r = r.withColumns({
        "agreeing": F.sum("agree").over(all_), "median": F.median("interval").over(all_),
        "base": _even(PARITY * F.avg((F.col("odd") == F.col("most")).cast("double")).over(all_)),
    })
    near = F.when(F.col("same") > 1, 0.0).otherwise(F.least(F.col("n") - F.col("before"), F.col("after") - F.col("n")))
    ratio = near / F.greatest("median", F.lit(1.0))
    gap = F.when(F.col("median") == 0, GAP).when(ratio <= 2, GAP).when(ratio <= 4, 15).when(ratio <= 8, 8).otherwise(0)
    parts = r.select(
        "id", _even(ORDER * F.col("agreeing") / (F.col("size") - 1)).alias("o"), F.when(F.col("odd") == F.col("most"), F.col("base")).otherwise(F.greatest(F.lit(0), F.col("base") - 15)).alias("p"), gap.alias("g"), "size",
    )
    lone = F.col("size") == 1
    out = rows.select("id").join(parts, "id", "left").select(
        "id", F.when(lone, ORDER).otherwise(F.coalesce("o", F.lit(0))).alias("order_part"), F.when(lone, PARITY).otherwise(F.coalesce("p", F.lit(0))).alias("parity_part"),
        F.when(lone, GAP).otherwise(F.coalesce("g", F.lit(0))).alias("gap_part"), F.coalesce(lone, F.lit(False)).alias("lone"),
    )
    score = F.when(F.col("lone"), 100).otherwise(F.col("order_part") + F.col("parity_part") + F.col("gap_part"))
    grade = F.lit("INCONSISTENTE")
    for least, name in reversed(CLASSES):
        grade = F.when(F.col("score") >= least, name).otherwise(grade)
    return out.withColumn("score", score).withColumn("grade", grade).drop("lone")
