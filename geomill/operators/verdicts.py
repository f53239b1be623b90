"""What the code decides after the model: which of the cited records count, and whether they carry an approval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.functions import text

# Months for which proofs hold, and what the described use must not be.
RECENT_MONTHS, REVIEW_MONTHS, PHOTO_MONTHS = 24, 12, 12
NOT_COMMERCE = r"(?i)\b(igreja|templo|associacao|associação|escola publica|escola pública)\b"


def cited_records(cited: DataFrame, listed: DataFrame, connections: DataFrame, records: DataFrame) -> DataFrame:
    """(connection, poi, reason): each record that the model cites, once, with why it doesn't count, or null.

    Cited: connection, poi, seen_number (what the model saw: ``different`` or other).  Listed: connection, poi that
    were offered.  Connections: connection, unit, number.  Records: poi, not_commerce (text or null), unit, number.  The first reason
    that holds counts: not in the list, no commerce, another unit, another number, another number seen.
    """
    c = cited.groupBy("connection", "poi").agg(F.max((F.lower(F.trim("seen_number")) == "different").cast("int")).alias("seen"))
    c = c.join(listed.select("connection", "poi").distinct().withColumn("offered", F.lit(True)), ["connection", "poi"], "left")
    c = c.join(connections.select("connection", F.col("unit").alias("c_unit"), F.col("number").alias("c_number")), "connection", "left")
    c = c.join(records.select("poi", "not_commerce", F.col("unit").alias("r_unit"), F.col("number").alias("r_number")), "poi", "left")
    mine, other = (text.units(F.coalesce(F.col(k), F.lit(""))) for k in ("c_unit", "r_unit"))
    apart = (F.size(mine) > 0) & (F.size(other) > 0) & ~F.arrays_overlap(mine, other)
    number = text.number_agrees(F.col("r_number"), F.col("c_number")) == "different"
    reason = F.when(F.col("offered").isNull(), "not_listed").when(F.col("not_commerce").isNotNull(), "not_commerce").when(apart, "other_unit").when(number, "other_number").when(F.col("seen") == 1, "other_number_seen")
    return c.select("connection", "poi", reason.alias("reason"))


def final_verdicts(cited: DataFrame, connections: DataFrame, proofs: DataFrame, today: Column) -> DataFrame:
    """(connection, verdict, why) of the connections that the model approved.

    Cited: ``cited_records``; a record without a reason that is cited for several connections is in doubt and counts for none.
    Connections: connection, qualification, light (the short process), abandoned, use (the model's words).
    Proofs: poi, source, kind, day.  Kinds: ``street_photo`` (holds at any age), ``review``, ``photo``, ``comment``, ``social``, ``web``
    (never counts) and others.  In this order:

    no record: review, for the doubt if it took one; no proof of the last two years: review; in the short process an abandoned
    place: review, and fewer than two sources with such a proof: review, unless one is strong enough by itself (a street
    photo, a review, photo or comment of the last year); a qualification that asks for a person: review; else approved.  A
    post of the last two years stands in for proofs and sources where the qualification is plain, the use
    isn't one of ``NOT_COMMERCE`` and the place isn't abandoned.
    """
    good = cited.filter("reason IS NULL").select("connection", "poi").distinct()
    claims = good.groupBy("poi").agg(F.count("*").alias("claims"))
    good = good.join(claims, "poi")
    doubt = good.filter("claims > 1").select("connection").distinct().withColumn("doubt", F.lit(True))
    good = good.filter("claims = 1").select("connection", "poi")
    age = F.months_between(today, F.col("day"))
    street, dated = F.col("kind") == "street_photo", F.col("day").isNotNull() & (F.col("kind") != "web")
    recent = street | F.coalesce(dated & (age <= RECENT_MONTHS), F.lit(False))
    strong = street | F.coalesce(dated & (((F.col("kind") == "review") & (age <= REVIEW_MONTHS)) | (F.col("kind").isin("photo", "comment") & (age < PHOTO_MONTHS))), F.lit(False))
    p = good.join(proofs.select("poi", "source", "kind", "day"), "poi", "left")
    p = p.groupBy("connection").agg(
        F.countDistinct(F.when(recent, F.col("source"))).alias("sources"), F.max(F.coalesce(recent, F.lit(False))).alias("proven"), F.max(F.coalesce(strong, F.lit(False))).alias("strong"),
        F.max(F.coalesce((F.col("kind") == "social") & (age <= RECENT_MONTHS), F.lit(False))).alias("post"),
    )
    c = connections.join(p, "connection", "left").join(doubt, "connection", "left")
    gone = F.coalesce(F.col("abandoned"), F.lit(False))
    post = F.col("post") & (F.col("qualification") == "SIM") & ~gone & ~F.coalesce(F.col("use"), F.lit("")).rlike(NOT_COMMERCE)
    post = F.coalesce(post, F.lit(False))
    light = F.coalesce(F.col("light"), F.lit(False))
    why = (
        F.when(F.col("proven").isNull(), F.when(F.col("doubt"), "in_doubt").otherwise("no_record")).when(~F.col("proven") & ~post, "no_recent_proof").when(light & gone, "abandoned")
        .when(light & (F.col("sources") < 2) & ~F.col("strong") & ~post, "one_source").when(F.col("qualification") == "SIM_COM_ANALISE_HUMANA", "qualification")
    )
    return c.select("connection", F.when(why.isNull(), "approved").otherwise("review").alias("verdict"), why.alias("why"))
