"""Learning of spelling variants: contexts, candidates, votes, decay, application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomill.functions import geo, similarity, text

from . import joins


def context_frequency(names: DataFrame) -> DataFrame:
    """(context, token, weight): names (name, weight) with each word in turn replaced by ``{}``."""
    w = names.withColumn("w", text.words(F.col("name"))).select("w", "weight", F.posexplode("w").alias("i", "token"))
    context = F.array_join(F.transform("w", lambda t, i: F.when(i == F.col("i"), F.lit("{}")).otherwise(t)), " ")
    return w.select(context.alias("context"), "token", "weight").groupBy("context", "token").agg(F.sum("weight").alias("weight"))


def candidates(names: DataFrame, block: list[str]) -> DataFrame:
    """Plausible substitutions (block, a, b, word_a, word_b) among the names of a block: names that differ in one word.

    Names of one context (the other words) don't all meet: they meet by what ``similarity.plausible`` asks of their two words,
    the same sound, one being the other's start, or one letter of difference, which leaves both the same text
    without one letter.  So rows grow with the words' letters and the pairs found, and not with the square of a context."""
    d = names.select(*block, "name").distinct().dropna().withColumn("w", text.words(F.col("name")))
    d = d.select(*block, "name", "w", F.posexplode("w").alias("i", "word")).filter(~similarity.enumerator(F.col("word")))
    context = F.array_join(F.transform("w", lambda t, i: F.when(i == F.col("i"), F.lit("{}")).otherwise(t)), " ")
    d = d.select(*block, "name", "word", context.alias("context"))
    several = d.groupBy(*block, "context").agg(F.min("word").alias("first"), F.max("word").alias("last")).filter("first <> last").select(*block, "context")
    d = d.join(several, [*block, "context"], "left_semi")
    word, n = F.col("word"), F.length("word")
    starts = lambda lo, hi: F.when(hi >= lo, F.transform(F.sequence(lo, hi), lambda k: F.concat(F.lit("s:"), F.substring(word, F.lit(1), k)))).otherwise(F.array().cast("array<string>"))
    lacking = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("l:"), F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, n)))
    letter = F.when(word.rlike("^[a-z]{4,}$"), F.concat(F.array(F.concat(F.lit("l:"), word)), lacking)).otherwise(F.array().cast("array<string>"))
    alike = F.concat(F.array(F.concat(F.lit("p:"), text.phonetic(word))), letter)
    own = F.when(n >= 2, F.array(F.concat(F.lit("s:"), word))).otherwise(F.array().cast("array<string>"))
    side = lambda p, keys: d.select(*block, "context", F.col("name").alias(f"_{p}"), F.col("word").alias(f"_word_{p}"), F.explode(F.array_distinct(keys)).alias("_key"))
    p = side("a", F.concat(alike, own)).join(side("b", F.concat(alike, starts(F.lit(2), n - 1))).hint("merge"), [*block, "context", "_key"])
    p = p.filter((F.col("_word_a") != F.col("_word_b")) & (F.col("_key").startswith("s:") | (F.col("_a") < F.col("_b"))))
    swap = F.col("_a") > F.col("_b")
    put = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    p = p.select(*block, put("_a", "_b").alias("a"), put("_b", "_a").alias("b"), put("_word_a", "_word_b").alias("word_a"), put("_word_b", "_word_a").alias("word_b"))
    return p.filter(similarity.plausible(F.col("word_a"), F.col("word_b"))).distinct()


def direction(authority_a: Column, authority_b: Column, freq_a: Column, freq_b: Column, least: int = 3, ratio: float = 3.0) -> Column:
    """Which spelling is the right one: a, b, conflict or undecided."""
    by_freq = F.when((freq_a >= least) & (freq_a >= ratio * freq_b), "a").when((freq_b >= least) & (freq_b >= ratio * freq_a), "b").otherwise("undecided")
    return F.when(authority_a > authority_b, "a").when(authority_b > authority_a, "b").when(authority_a > 0, "conflict").otherwise(by_freq)


def independent_support(votes: DataFrame, radius_m: float) -> DataFrame:
    """(rule, support): votes (rule, id, number, lat, lng) that no earlier vote with the same number lies within the radius of."""
    a = votes.select("rule", "number", "id", "lat", "lng")
    blocked = joins.within(a, a, radius_m, on=["rule", "number"]).filter("b_id < a_id").select(F.col("a_id").alias("id")).distinct()
    return a.join(blocked, "id", "left_anti").groupBy("rule").agg(F.count("*").alias("support"))


def territory_update(support: DataFrame, least: int) -> DataFrame:
    """(rule, a, b, state): active at enough support, quarantined if the reverse rule has it too, else candidate."""
    back = support.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("support").alias("reverse"))
    s = support.join(back, ["a", "b"], "left")
    state = F.when((F.col("support") >= least) & (F.coalesce("reverse", F.lit(0)) >= least), "quarantined").when(F.col("support") >= least, "active").otherwise("candidate")
    return s.select("a", "b", "support", state.alias("state"))


def decayed(support: DataFrame, today: int, half_life: int = 180, least: float = 0.5) -> DataFrame:
    """(rule, strength, state): votes (rule, property, day), one for each property, halved every half-life; archived below ``least``."""
    last = support.groupBy("rule", "property").agg(F.max("day").alias("day"))
    s = last.groupBy("rule").agg(F.sum(F.pow(F.lit(0.5), (F.lit(today) - F.col("day")) / half_life)).alias("strength"))
    return s.withColumn("state", F.when(F.col("strength") < least, "archived").otherwise("active"))


def equivalences(streets: DataFrame, near_m: float = 300.0) -> DataFrame:
    """(a, b, degree): streets of one sound key; 2 if also near each other, else 1.  Columns: id, name, lat, lng."""
    k = streets.select("id", "lat", "lng", text.equivalence_key(F.col("name")).alias("k"), text.norm_name(F.col("name")).alias("plain")).filter("k <> ''")
    p = joins.key_pairs(k, ["k"], 1_000, columns=["plain", "lat", "lng"]).filter("a_plain <> b_plain")
    m = geo.haversine(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng"))
    return p.select("a", "b", F.when(m <= near_m, 2).otherwise(1).alias("degree"))


def apply_lexicon(names: DataFrame, rules: DataFrame, most_rules: int = 50_000) -> DataFrame:
    """``names`` (id, name) with ``clean``: words replaced by the active rules (word, right); broadcast if counted to be few."""
    small = rules.count() <= most_rules
    w = names.select("id", "name", F.posexplode_outer(text.words(F.col("name"))).alias("i", "word"))
    w = w.join(F.broadcast(rules) if small else rules, "word", "left").withColumn("word", F.coalesce("right", "word"))
    out = w.groupBy("id", "name").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    return out.select("id", "name", F.array_join(F.col("w.word"), " ").alias("clean"))


def modal_spelling(rows: DataFrame, keys: list[str], spelling: str) -> DataFrame:
    """(keys, spelling): the commonest spelling of each key, ties to the smaller one."""
    n = rows.groupBy(*keys, spelling).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), spelling)
    return n.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
