"""Text similarity: token sets as column functions; longest common subsequence in one Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of the names' words; with a single word on either side only equal names count."""
    a, b = text.void_to_null(a), text.void_to_null(b)
    return jaccard_of(text.tokens(a), text.tokens(b), text.norm_name(a), text.norm_name(b))


def jaccard_of(x: Column, y: Column, a: Column, b: Column) -> Column:
    """The same from the names' words and normal forms."""
    short = F.least(F.size(x), F.size(y)) < 2
    whole = F.when(a == b, 1.0).otherwise(0.0)
    ratio = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    empty = F.coalesce(F.size(x) < 1, F.lit(True)) | F.coalesce(F.size(y) < 1, F.lit(True))
    return F.when(empty, 0.0).when(short, whole).otherwise(ratio)


def overlap(x: Column, y: Column) -> Column:
    """Shared tokens by the smaller set; 0 for fewer than two shared, unless both sets have one."""
    both = F.size(F.array_intersect(x, y))
    enough = (both >= 2) | ((F.size(x) == 1) & (F.size(y) == 1) & (both == 1))
    return F.when(enough, both / F.least(F.size(x), F.size(y))).otherwise(0.0)


def containment(x: Column, y: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y)))


def idf(names: DataFrame, column: str) -> DataFrame:
    """(token, weight): ln(N / (1 + df)) over the rows' distinct words; a partial aggregate, no collect."""
    n = names.count()
    t = names.select(F.explode(text.tokens(F.col(column), 1)).alias("token"))
    return t.groupBy("token").agg(F.log(F.lit(float(n)) / (1 + F.count("*"))).alias("weight"))


def with_weights(rows: DataFrame, weights: DataFrame, column: str, id: str = "id", most: int = 500_000) -> DataFrame:
    """``rows`` with ``weighted``: the (token, weight) of the column's distinct words, once a row and not once a pair.

    ``weights`` (token, weight) is broadcast if counted to be small."""
    w = F.broadcast(weights) if weights.count() <= most else weights
    t = rows.select(id, F.explode(text.tokens(F.col(column), 1)).alias("token")).join(w, "token")
    t = t.groupBy(id).agg(F.collect_list(F.struct("token", "weight")).alias("weighted"))
    return rows.join(t, id, "left").withColumn("weighted", F.coalesce("weighted", F.array().cast("array<struct<token:string,weight:double>>")))


def shared_weight(x: Column, y: Column) -> Column:
    """Sum of the weights of the words that two ``weighted`` lists share."""
    words = F.transform(y, lambda t: t["token"])
    shared = F.filter(x, lambda t: F.array_contains(words, t["token"]))
    return F.aggregate(F.array_sort(F.transform(shared, lambda t: t["weight"])), F.lit(0.0), lambda a, w: a + w)


def top_shared(x: Column, y: Column) -> Column:
    """Whether the heaviest word of either list (ties: the larger word) is in the other one."""
    top = lambda c: F.array_max(F.transform(c, lambda t: F.struct(t["weight"].alias("w"), t["token"].alias("t"))))["t"]
    has = lambda c, t: F.coalesce(F.array_contains(F.transform(c, lambda e: e["token"]), t), F.lit(False))
    return has(y, top(x)) | has(x, top(y))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit operations on whole rows."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        u = row & where.get(ch, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * 2 * LCS / (lengths); equal pairs of a batch are computed once."""
    seen: dict[tuple, float | None] = {}

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if (x, y) not in seen:
            seen[x, y] = 100.0 * 2 * common_length(x, y) / (len(x) + len(y)) if x or y else 100.0
        return seen[x, y]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(text.words(c)), " ")


def token_sort(a: Column, b: Column) -> Column:
    return indel_ratio(sorted_words(a), sorted_words(b))


def token_set(a: Column, b: Column) -> Column:
    """Largest ratio among the shared words and each side's words after them."""
    x, y = text.words(a), text.words(b)
    both = F.array_sort(F.array_intersect(x, y))
    joined = lambda s: F.array_join(F.concat(both, F.array_sort(F.array_except(s, both))), " ")
    core, left, right = F.array_join(both, " "), joined(x), joined(y)
    best = F.greatest(indel_ratio(left, right), indel_ratio(core, left), indel_ratio(core, right))
    return F.when(F.size(both) > 0, best).otherwise(indel_ratio(left, right))


def enumerator(t: Column) -> Column:
    return t.rlike("^([0-9]+|[a-z]|[a-z]{1,2}[0-9]+|[0-9]+[a-z])$")


def single_substitution(x: Column, y: Column) -> Column:
    """Struct (a, b) of the one position in which two word lists of equal length differ; else null."""
    odd = F.filter(F.arrays_zip(x.alias("a"), y.alias("b")), lambda p: p["a"] != p["b"])
    return F.when((F.size(x) == F.size(y)) & (F.size(odd) == 1), odd[0])


def plausible(a: Column, b: Column) -> Column:
    """One word may be another spelling of the other; enumerators never are."""
    prefix = (F.least(F.length(a), F.length(b)) >= 2) & (a.startswith(b) | b.startswith(a))
    letters = a.rlike("^[a-z]{4,}$") & b.rlike("^[a-z]{4,}$")
    return ~enumerator(a) & ~enumerator(b) & (prefix | (text.phonetic(a) == text.phonetic(b)) | (letters & (F.levenshtein(a, b, 1) >= 0)))


def same_numbers(a: Column, b: Column) -> Column:
    """Two street names agree in all numbers they hold."""
    runs = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1))))
    return runs(a) == runs(b)
