"""Rule ladders and scores: first match wins, as one column expression each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomill.functions import similarity, text


def give(cond: Column, n: float) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)


def link_confidence(street: Column, number: Column, near: Column, roof: Column, shop_roof: Column, proven: Column) -> Column:
    """0 to 1: the door 0.70, the street 0.35, else 0.10; roof +0.20, commercial roof +0.05, near +0.05; an
    address that isn't proven holds a link that uses it to 0.60."""
    base = F.when(street & number, 70).when(street, 35).otherwise(10)
    v = base + give(roof, 20) + give(shop_roof, 5) + give(near, 5)
    v = F.when(~proven & (street | number), F.least(v, F.lit(60))).otherwise(v)
    return F.least(v, F.lit(100)) / 100


def accept_links(candidates: DataFrame, least: float = 0.8) -> DataFrame:
    """``candidates`` with the reason for which each belongs to its connection, or null.

    Columns: connection, poi, source, name, street, number, roof, area (booleans but the first four), fit, inactive.
    Exact address first; rentals by street and roof; then a name like that of an accepted row (an anchor) of
    the same connection on the same street and roof.  Names are compared within a connection only.
    """
    able = F.coalesce(F.col("fit"), F.lit(True)) & ~F.coalesce(F.col("inactive"), F.lit(False))
    first = able & ~text.declares_vacant(F.col("name"))
    rental = F.lower(F.trim("source")) == "airbnb"
    reason = F.when(first & rental & F.col("street") & F.col("roof") & F.col("area"), "rental_street_roof").when(first & ~rental & F.col("street") & F.col("number") & F.col("area"), "exact_address")
    c = candidates.withColumn("reason", reason)
    anchors = c.filter("reason = 'exact_address'").select("connection", F.col("name").alias("anchor")).distinct()
    late = c.filter(F.col("reason").isNull() & F.col("street") & F.col("roof") & F.col("area") & able)
    like = late.join(anchors, "connection").filter(similarity.jaccard(F.col("name"), F.col("anchor")) >= least).select("connection", "poi").distinct()
    like = like.withColumn("named", F.lit("anchor_name"))
    return c.join(like, ["connection", "poi"], "left").withColumn("reason", F.coalesce("reason", "named")).drop("named")


# Weights of a connection's score.
SCORE = {"near": 15, "roof": 5, "shop_roof": 10, "view_recent": 20, "view_old": 5, "shop_view_recent": 5, "shop_view_old": 2, "reviews": 10, "photos": 10, "posts": 15}


def connection_score(df: DataFrame) -> DataFrame:
    """Parts and sum of the score.  Columns: m, roof, shop_roof, presence, view_recent, review_days, photos_ok, post_days."""
    p = F.lower(F.trim("presence"))
    view = F.when(p == "exact", F.when(F.col("view_recent"), SCORE["view_recent"]).otherwise(SCORE["view_old"])).when(p == "shop", F.when(F.col("view_recent"), SCORE["shop_view_recent"]).otherwise(SCORE["shop_view_old"])).otherwise(0)
    parts = {
        "p_distance": give(F.col("m") < 10, SCORE["near"]),
        "p_roof": F.when(F.col("roof") & F.col("shop_roof"), SCORE["shop_roof"]).when(F.col("roof"), SCORE["roof"]).otherwise(0),
        "p_view": view, "p_reviews": give(F.col("review_days") <= 365, SCORE["reviews"]),
        "p_photos": give(F.col("photos_ok"), SCORE["photos"]), "p_posts": give(F.col("post_days") <= 182, SCORE["posts"]),
    }
    out = df.withColumns(parts)
    return out.withColumn("score", sum((F.col(c) for c in parts), F.lit(0)))


def official_status(verdict: Column, roof: Column, conclusive: Column, only_person: Column) -> Column:
    return F.when(verdict.startswith("rejected"), "NO").when(only_person | (~conclusive & ~roof), "YES_WITH_REVIEW").otherwise("YES")


def bands(value: Column, limits: list[tuple[float, str]], last: str) -> Column:
    """Label of the first limit that the value reaches."""
    out = F.lit(last)
    for limit, label in reversed(limits):
        out = F.when(value >= limit, label).otherwise(out)
    return out


def score_with_reasons(parts: list[tuple[Column, int, str]], low: int, high: int) -> tuple[Column, Column]:
    """(sum of the points of true conditions, clipped; their names joined)."""
    total = sum((give(c, n) for c, n, _ in parts), F.lit(0))
    why = F.concat_ws(" | ", *[F.when(c, F.lit(name)) for c, _, name in parts])
    return F.least(F.greatest(total, F.lit(low)), F.lit(high)), why


def keyword_class(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Class of the first pattern that a plain text matches."""
    out, plain = F.lit(default), text.strip_accents(c)
    for pattern, name in reversed(rules):
        out = F.when(plain.rlike(pattern), name).otherwise(out)
    return out


def exclusivity(valid: DataFrame) -> DataFrame:
    """(poi, connection, kept): a poi valid for several connections stays with the only one whose unit it names,
    with all if they share an address, else with none.  Columns: poi, connection, unit_match, address."""
    w = Window.partitionBy("poi")
    n, matches = F.count("*").over(w), F.sum(F.col("unit_match").cast("int")).over(w)
    one_address = F.size(F.collect_set("address").over(w)) == 1
    kept = F.when(n == 1, True).when(matches == 1, F.col("unit_match")).when(one_address, True).otherwise(False)
    return valid.select("poi", "connection", kept.alias("kept"))


def anomaly_signals(rows: DataFrame) -> DataFrame:
    """Signals of faulty collection.  Columns: street, place (coordinate key), number, name, sector.

    s1: three or more streets at one coordinate; s2: a street's numbers are a perfect sequence of five or more;
    s3: a name ten times or more in a sector; s4: 99 of 100 rows of a sector have a number.
    Each is counted once a group and joined back, so no row carries its group's set.
    """
    s1 = rows.groupBy("place").agg((F.countDistinct("street") >= 3).alias("s1"))
    whole = (F.max("number") - F.min("number") + 1 == F.count("number")) & (F.countDistinct("number") == F.count("number"))
    s2 = rows.groupBy("street").agg(F.coalesce((F.count("number") >= 5) & whole, F.lit(False)).alias("s2"))
    s3 = rows.groupBy("sector", "name").agg((F.col("name").isNotNull() & (F.count("name") >= 10)).alias("s3"))
    s4 = rows.groupBy("sector").agg((F.count("number") * 100 >= F.count("*") * 99).alias("s4"))
    out = rows
    for signal, keys in ((s1, ["place"]), (s2, ["street"]), (s3, ["sector", "name"]), (s4, ["sector"])):
        of = signal.withColumnsRenamed({k: f"_{k}" for k in keys})
        same = F.lit(True)
        for k in keys:  # a group of nulls is a group
            same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(of, same).drop(*[f"_{k}" for k in keys])
    return out


def unit_grid(rows: DataFrame) -> DataFrame:
    """Missing units of buildings: (building, unit, grade).  Columns: building, unit (floor * 100 + position).

    A: within the floor's own range; B: on a floor without units between two with; positions up to the largest seen.
    Buildings of any size are looked at; rows grow with the missing units.
    """
    u = rows.select("building", F.floor(F.col("unit") / 100).cast("int").alias("floor"), (F.col("unit") % 100).cast("int").alias("pos")).distinct()
    span = u.groupBy("building").agg(F.min("floor").alias("f0"), F.max("floor").alias("f1"), F.min("pos").alias("p0"), F.max("pos").alias("p1"))
    grid = span.withColumn("floor", F.explode(F.sequence("f0", "f1"))).withColumn("pos", F.explode(F.sequence("p0", "p1")))
    own = u.groupBy("building", "floor").agg(F.min("pos").alias("q0"), F.max("pos").alias("q1"))
    miss = grid.join(u, ["building", "floor", "pos"], "left_anti").join(own, ["building", "floor"], "left")
    grade = F.when(F.col("q0").isNull(), "B").when(F.col("pos").between(F.col("q0"), F.col("q1")), "A").otherwise("C")
    return miss.select("building", (F.col("floor") * 100 + F.col("pos")).alias("unit"), grade.alias("grade"))
