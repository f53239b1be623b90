"""Names compared by the rarity of what they share, acronyms included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of an acronym.
SHORTEST, LONGEST = 2, 4


def initials(rows: DataFrame, block: Sequence[str]) -> DataFrame:
    """(block, id, acronym, spelt): the initials of 2 to 4 consecutive words and these words, at their first place in the name."""
    runs = F.flatten(F.array(*[
        F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.struct(  # noqa: B023
            F.array_join(F.transform(F.slice("words", i, F.lit(n)), lambda w: F.substring(w, 1, 1)), "").alias("acronym"), i.alias("at"), F.slice("words", i, F.lit(n)).alias("spelt")))  # noqa: B023
        for n in range(SHORTEST, LONGEST + 1)
    ]))
    long_enough = [F.col("words").isNotNull(), F.size("words") >= LONGEST]
    padded = rows.withColumn("real", F.size("words"))
    # short names are padded so that each length has a place; what reaches into the padding goes
    padded = padded.withColumn("words", F.when(long_enough[1], F.col("words")).otherwise(F.concat("words", F.array_repeat(F.lit(""), LONGEST))))
    out = padded.filter(long_enough[0]).select(*block, "id", F.explode(runs).alias("r")).select(*block, "id", "r.*").filter(~F.array_contains("spelt", ""))
    return out.groupBy(*block, "id", "acronym").agg(F.min_by("spelt", "at").alias("spelt"))


def weighted_overlap(rows: DataFrame, weights: DataFrame, block: Sequence[str]) -> DataFrame:
    """(a, b, weight, shared, spelt) of the pairs (a < b) of a block that share a word.

    Rows: the block's columns, id and words (in order).  ``weights``: (token, weight).  A word of one name
    that is the initials of consecutive words of the other adds the weight of those words, each once; it
    confirms and never establishes, so it counts only beside a literally shared word.  Names meet by an
    inverted index of their words and one of their initials.
    """
    word = rows.select(*block, "id", F.explode(F.array_distinct("words")).alias("token"))
    x, y = word.withColumnRenamed("id", "a").join(weights, "token"), word.withColumnRenamed("id", "b")
    common = x.join(y, [*block, "token"]).filter("a < b")
    common = common.groupBy(*block, "a", "b").agg(F.sort_array(F.collect_list(F.struct("weight", "token"))).alias("common"))
    short = word.filter(F.length("token").between(SHORTEST, LONGEST)).withColumnRenamed("token", "acronym")
    met = short.withColumnRenamed("id", "by").join(initials(rows, block).withColumnRenamed("id", "of"), [*block, "acronym"]).filter(F.col("by") != F.col("of"))
    met = met.select(F.least("by", "of").alias("a"), F.greatest("by", "of").alias("b"), (F.col("by") < F.col("of")).alias("first"), "acronym", "spelt")
    met = met.groupBy("a", "b").agg(*[F.collect_list(F.when(c, F.struct("acronym", "spelt"))).alias(n) for n, c in (("ahead", F.col("first")), ("back", ~F.col("first")))])
    tokens = F.transform("common", lambda c: c["token"])
    spelt = lambda c, known: F.flatten(F.transform(F.filter(F.coalesce(F.col(c), F.array().cast("array<struct<acronym:string,spelt:array<string>>>")), lambda e: ~F.array_contains(known, e["acronym"])), lambda e: e["spelt"]))
    out = common.join(met, ["a", "b"], "left").withColumn("shared", tokens)
    out = out.withColumn("one", F.array_except(spelt("ahead", F.col("shared")), F.col("shared")))
    # a word that the first name's acronyms have already brought in is shared by then
    out = out.withColumn("spelt", F.array_distinct(F.concat("one", F.array_except(spelt("back", F.concat("shared", "one")), F.col("shared")))))
    literal = F.aggregate(F.transform("common", lambda c: c["weight"]), F.lit(0.0), lambda s, w: s + w)
    out = out.withColumn("literal", literal)
    more = out.filter(F.size("spelt") > 0).select("a", "b", F.explode("spelt").alias("token")).join(weights, "token").groupBy("a", "b").agg(F.sort_array(F.collect_list("weight")).alias("w"))
    out = out.join(more, ["a", "b"], "left")
    extra = F.aggregate(F.coalesce(F.col("w"), F.array().cast("array<double>")), F.lit(0.0), lambda s, w: s + w)
    return out.select(*block, "a", "b", (F.col("literal") + extra).alias("weight"), F.array_sort("shared").alias("shared"), F.array_sort("spelt").alias("spelt"))
