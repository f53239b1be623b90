"""Location cascades: street resolution, address passes, reverse doors, checks of coordinates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomill.functions import geo, similarity, text

from . import joins


def resolve_street(rows: DataFrame, register: DataFrame, radius_m: float = 20.0) -> DataFrame:
    """(id, street, how): by postcode (if it has one street), by the written street, by the nearest street; each
    step only for rows left by the earlier ones.

    Rows: id, street, postcode, lat, lng.  Register: street, postcode, lat, lng.
    """
    key = text.street_core(F.col("street"))
    one = joins.unambiguous(register.filter("postcode IS NOT NULL"), "postcode", ["street"])
    a = rows.join(one.select("postcode", F.col("street").alias("found")), "postcode").select("id", "found", F.lit("postcode").alias("how"))
    rest = rows.join(a.select("id"), "id", "left_anti")
    named = register.select(key.alias("k"), "street").groupBy("k").agg(F.min("street").alias("found"))
    b = rest.withColumn("k", key).filter("k <> ''").join(named, "k").select("id", "found", F.lit("written").alias("how"))
    rest = rest.join(b.select("id"), "id", "left_anti")
    doors = register.withColumn("id", F.col("street"))
    c = joins.within(rest, doors, radius_m).groupBy("a_id").agg(F.min_by("b_id", F.struct("m", "b_id")).alias("found")).select(F.col("a_id").alias("id"), "found", F.lit("nearest").alias("how"))
    return a.unionByName(b).unionByName(c).withColumnRenamed("found", "street")


def fuzzy_street(rows: DataFrame, register: DataFrame, least: float = 85.0) -> DataFrame:
    """(id, street, ratio): the most similar street of the same block; numbers in the names must agree.  Columns: block, id / street, name."""
    r = register.select("block", "street").distinct()
    p = rows.select("id", "block", "name").join(r, "block").filter(similarity.same_numbers(F.col("name"), F.col("street")))
    p = p.withColumn("ratio", similarity.token_sort(text.street_core(F.col("name")), text.street_core(F.col("street")))).filter(F.col("ratio") >= least)
    w = Window.partitionBy("id").orderBy(F.desc("ratio"), "street")
    return p.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("id", "street", "ratio")


#: The passes of ``match_address``: name, equal columns, and whether the nearest number will do.
PASSES = [("exact", ["postcode", "street", "number"], False), ("core", ["postcode", "core", "number"], False), ("city_exact", ["city", "street", "number"], False), ("near_number", ["postcode", "street"], True), ("city_near_number", ["city", "street"], True), ("postcode_number", ["postcode", "number"], False), ("street", ["city", "core"], True), ("postcode", ["postcode"], True)]


def match_address(rows: DataFrame, register: DataFrame, keep: Callable[[DataFrame], DataFrame], most_apart: int = 200) -> DataFrame:
    """(id, right_id, step, apart): eight passes of falling strictness; numbers at most so far apart where they may differ.

    Both sides: id, postcode, street, core, city, number.  ``keep`` writes both sides, which are derived once and not once a pass,
    and what each pass matched and left.  The register is reduced to one row for each key and number first (once for the passes
    that have these columns in common), and a row meets the next lower and the next higher number of its key, so a pass grows
    with rows and doors and not with rows times the doors of a street.
    """
    columns = ["id", "postcode", "street", "core", "city", "number"]
    rest, register, out = keep(rows.select(*columns)), keep(register.select(*columns)), None
    shared = [frozenset([*keys, "number"]) for _, keys, _ in PASSES]
    doors: dict[frozenset[str], DataFrame] = {}
    for name, keys, loose in PASSES:
        which = frozenset([*keys, "number"])
        if which not in doors:
            by = sorted(which)
            doors[which] = register.select(F.col("id").alias("right_id"), *by).dropna().groupBy(*by).agg(F.min("right_id").alias("right_id"))
            if loose or shared.count(which) > 1:
                doors[which] = keep(doors[which])
        able = rest.dropna(subset=keys)
        if loose:
            hit = _nearest_number(able, doors[which], keys, most_apart)
        else:
            hit = able.select("id", *keys).join(doors[which], keys).groupBy("id").agg(F.min("right_id").alias("right_id")).withColumn("apart", F.lit(0).cast("bigint"))
        hit = keep(hit.select("id", "right_id", F.lit(name).alias("step"), "apart"))
        out = hit if out is None else out.unionByName(hit)
        rest = keep(rest.join(hit.select("id"), "id", "left_anti"))
    return out


def _nearest_number(rows: DataFrame, doors: DataFrame, keys: list[str], most_apart: int) -> DataFrame:
    """(id, right_id, apart): the door of the nearest number under a row's key, ties to the smaller id; a row without a number takes the key's smallest id.

    Doors: one row (keys, number, right_id) for each key and number."""
    none = rows.filter("number IS NULL").select("id", *keys).join(doors.groupBy(*keys).agg(F.min("right_id").alias("right_id")), keys)
    none = none.select("id", "right_id", F.lit(None).cast("bigint").alias("apart"))
    door = F.struct(F.col("number").alias("n"), "right_id")
    both = rows.filter("number IS NOT NULL").select(*keys, F.col("number").cast("bigint").alias("n"), "id", F.lit(None).cast(doors.select(door.alias("d")).schema["d"].dataType).alias("door"))
    both = both.unionByName(doors.select(*keys, F.col("number").cast("bigint").alias("n"), F.lit(None).cast(dict(rows.dtypes)["id"]).alias("id"), door.alias("door")))
    w = Window.partitionBy(*keys)
    frame = lambda order: w.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumns({"low": F.last("door", True).over(frame(F.col("n").asc())), "high": F.last("door", True).over(frame(F.col("n").desc()))}).filter("id IS NOT NULL")
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("n") - F.col(f"{c}.n")).alias("apart"), F.col(f"{c}.right_id").alias("right_id")))
    some = met.withColumn("best", F.least(far("low"), far("high"))).filter(F.col("best.apart") <= most_apart).groupBy("id").agg(F.min("best").alias("best"))
    return none.groupBy("id").agg(F.min("right_id").alias("right_id")).withColumn("apart", F.lit(None).cast("bigint")).unionByName(some.select("id", "best.right_id", F.col("best.apart").cast("bigint").alias("apart")))


def deviation_m(floor_m: Column, apart: Column, m_per_number: Column) -> Column:
    return F.hypot(floor_m, apart * m_per_number)


def metres_per_number(doors: DataFrame) -> DataFrame:
    """(street, m): median metres for each step of the house number along a street, within 0.5 and 60; 6 without data."""
    w = Window.partitionBy("street").orderBy("number", "id")
    step = doors.withColumn("dn", F.col("number") - F.lag("number").over(w)).withColumn("dm", geo.haversine(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng")))
    m = F.expr("percentile(dm / dn, 0.5) FILTER (WHERE dn > 0)")
    return step.groupBy("street").agg(F.coalesce(F.least(F.greatest(m, F.lit(0.5)), F.lit(60.0)), F.lit(6.0)).alias("m"))


def reverse_door(points: DataFrame, doors: DataFrame, radius_m: float = 50.0) -> DataFrame:
    """(id, door, m): the nearest door of each point."""
    return joins.within(points, doors, radius_m).groupBy("a_id").agg(F.min(F.struct("m", "b_id")).alias("h")).select(F.col("a_id").alias("id"), F.col("h.b_id").alias("door"), F.col("h.m").alias("m"))


def conformity(m: Column, uncertainty: Column) -> Column:
    return F.when(m.isNull() | uncertainty.isNull(), "unknown").when(m <= 3 * uncertainty, "confirmed").otherwise("disagrees")


def foreign_city(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Ids whose postcodes all belong to other cities.  Rows: id, city, postcodes; owners: postcode, owner."""
    p = rows.select("id", "city", F.explode("postcodes").alias("postcode")).join(owners, "postcode")
    return p.groupBy("id").agg(F.bool_and(F.col("owner") != F.col("city")).alias("foreign")).filter("foreign").select("id")


def first_donor(rows: DataFrame, donors: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Coordinates from the first donor that has them: donors are (name, table with key, lat, lng, key)."""
    out, lat, lng, who = rows, [], [], []
    for name, t, key in donors:
        out = out.join(t.select(key, F.col("lat").alias(f"_lat_{name}"), F.col("lng").alias(f"_lng_{name}")), key, "left")
        lat.append(F.col(f"_lat_{name}"))
        lng.append(F.col(f"_lng_{name}"))
        who.append(F.when(F.col(f"_lat_{name}").isNotNull(), name))
    return out.select(*rows.columns, F.coalesce(*lat).alias("lat"), F.coalesce(*lng).alias("lng"), F.coalesce(*who).alias("donor"))
