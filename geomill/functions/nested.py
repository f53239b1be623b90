"""Arrays, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_pairs(c: Column) -> Column:
    """Array of (key, value) of a JSON object, values as text, by key."""
    return F.array_sort(F.map_entries(F.from_json(c, "map<string,string>")))


def json_merge(a: Column, b: Column) -> Column:
    """JSON object of both; the second one's values win."""
    m = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(m(a), lambda k, v: ~F.array_contains(F.map_keys(m(b)), k)), m(b)))


def opening_hours(c: Column) -> Column:
    """Array of (day, hours) from a JSON object or from a list of objects with day and hours."""
    listed = F.from_json(c, "array<struct<day:string,hours:string>>")
    keyed = F.transform(F.map_entries(F.from_json(c, "map<string,string>")), lambda e: F.struct(e["key"].alias("day"), e["value"].alias("hours")))
    return F.when(F.trim(c).startswith("["), listed).otherwise(F.array_sort(keyed))


def fenced_json(c: Column) -> Column:
    """JSON text inside a fence or among other text: from the first bracket to the last."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\[.*\]|\{.*\})", 1), F.lit(""))


def extras(known: list[str], columns: list[str], private: list[str]) -> Column:
    """JSON of the filled columns that are neither known nor private."""
    pairs = [x for c in columns if c not in known and c not in private for x in (F.lit(c), F.col(c).cast("string"))]
    return F.to_json(F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())) if pairs else F.lit("{}")


def gaps(values: Column, ratio: int = 3) -> Column:
    """Integers missing between the smallest and the largest of an array, unless the span exceeds ratio times its size."""
    lo, hi = F.array_min(values), F.array_max(values)
    return F.when((F.size(values) > 1) & (hi - lo + 1 <= ratio * F.size(values)), F.array_except(F.sequence(lo, hi), values)).otherwise(F.array().cast("array<bigint>"))
