"""Change capture, incremental loads and data quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geomill.functions import identifiers


def latest_state(rows: DataFrame, key: str, at: str, columns: Sequence[str]) -> DataFrame:
    """(key, at, fingerprint): the newest row of each key, by its fingerprint."""
    r = rows.withColumn("fingerprint", identifiers.fingerprint(*columns))
    return r.groupBy(key).agg(F.max(F.struct(at, "fingerprint")).alias("m")).select(key, f"m.{at}", "m.fingerprint")


def only_changed(rows: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't marked SAME."""
    return rows.join(events.filter("event = 'SAME'").select(key), key, "left_anti")


def mark_exits(target: DataFrame, events: DataFrame, key: str, day: Column) -> DataFrame:
    """``target`` with left_at set for keys that left, cleared for those that entered again."""
    e = events.filter("event IN ('LEFT', 'ENTERED')").select(key, "event")
    left = F.when(F.col("event") == "LEFT", F.coalesce("left_at", day)).when(F.col("event") == "ENTERED", F.lit(None)).otherwise(F.col("left_at"))
    return target.join(e, key, "left").withColumn("left_at", left).drop("event")


def schema_drift(old: Sequence[str], new: Sequence[str]) -> tuple[list[str], list[str]]:
    """(added, removed) column names."""
    return sorted(set(new) - set(old)), sorted(set(old) - set(new))


def not_loaded(files: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files that the load ledger doesn't hold."""
    return files.join(ledger.select(*keys), list(keys), "left_anti")


def funnel(rows: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """``rows`` with ``reason``: the first step whose condition rejects the row, or null."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(list(steps)):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return rows.withColumn("reason", out)


def funnel_counts(tagged: DataFrame) -> DataFrame:
    """(reason, n); the row ``kept`` counts the rows without a reason."""
    return tagged.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def funnel_closes(tagged: DataFrame, rows_in: int) -> bool:
    return tagged.count() == rows_in


def profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, n, filled, kinds): one pass; kinds is approximate (HyperLogLog)."""
    aggs = [F.count("*").alias("n")] + [x for c in columns for x in (F.count(c).alias(f"f_{c}"), F.approx_count_distinct(c).alias(f"d_{c}"))]
    one = rows.agg(*aggs)
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col("n"), F.col(f"f_{c}").alias("filled"), F.col(f"d_{c}").alias("kinds")) for c in columns])
    return one.select(F.explode(each).alias("x")).select("x.*")


def expectations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(rule, broken): rows that break each rule, in one pass; null counts as broken."""
    one = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("broken")) for n in checks])).alias("x")).select("x.*")


def require(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """The rows, or an error that names the broken rules."""
    bad = expectations(rows, checks).filter("broken > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r['rule']}: {r['broken']} rows" for r in bad))
    return rows


def fill_or_reject(rows: DataFrame, fills: dict[str, Column], lookup: DataFrame | None, on: str, required: list[str], unique: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with ``reason``): what triggers before an insert do, for a whole load.

    Empty or null columns of ``fills`` take their value; those of ``lookup`` (keyed by ``on``, unique) are filled from it.  A row that
    still lacks a required column, or repeats a key of ``unique`` (the row of the smallest other columns counts), is rejected."""
    empty = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    out = rows
    if lookup is not None:
        known = [c for c in lookup.columns if c != on]
        out = out.join(lookup.select(on, *[F.col(c).alias(f"_{c}") for c in known]), on, "left")
        out = out.withColumns({c: F.when(empty(c), F.col(f"_{c}")).otherwise(F.col(c)) for c in known}).drop(*[f"_{c}" for c in known])
    out = out.withColumns({c: F.when(empty(c), v).otherwise(F.col(c)) for c, v in fills.items()}).select(*rows.columns)
    lacks = F.concat_ws(",", *[F.when(empty(c), F.lit(c)) for c in required])
    out = out.withColumn("_lacks", lacks)
    w = Window.partitionBy(*unique, F.col("_lacks") == "").orderBy(*[c for c in rows.columns if c not in unique])
    again = (F.col("_lacks") == "") & (F.row_number().over(w) > 1)
    out = out.withColumn("_again", again)
    reason = F.when(F.col("_lacks") != "", F.concat(F.lit("lacks "), F.col("_lacks"))).when(F.col("_again"), "repeats")
    out = out.withColumn("reason", reason).drop("_lacks", "_again")
    return out.filter("reason IS NULL").drop("reason"), out.filter("reason IS NOT NULL")


def freshness(now: DataFrame, ledger: DataFrame, key: str, share: float = 0.0) -> DataFrame:
    """(key, rows, done, verdict): rows of each part now against the last entry of a ledger (key, rows, at): NEW, FRESH, STALE (grown or
    shrunk by more than ``share``) or GONE."""
    last = ledger.groupBy(key).agg(F.max_by("rows", "at").alias("done"))
    j = now.groupBy(key).agg(F.count("*").alias("rows")).join(last, key, "full_outer")
    off = F.abs(F.col("rows") - F.col("done")) > F.col("done") * share
    verdict = F.when(F.col("done").isNull(), "NEW").when(F.col("rows").isNull(), "GONE").when(off, "STALE").otherwise("FRESH")
    return j.select(key, "rows", "done", verdict.alias("verdict"))


def delivery_checks(rows: DataFrame, key: str, rules: dict[str, Column], columns: list[str], parents: dict[str, DataFrame], manifest: dict[str, float], metrics: dict[str, Column]) -> DataFrame:
    """(rule, broken) of a delivery: columns that are missing, keys that are null or repeat, rows that break a rule, rows without a
    parent (column -> table with that column), and metrics that differ from the manifest's.  No row of ``rows`` leaves its task but for keys."""
    spark = rows.sparkSession
    fixed = [(f"column {c}", int(c not in rows.columns)) for c in columns]
    out = spark.createDataFrame(fixed, "rule string, broken long") if fixed else None
    add = lambda d: d if out is None else out.unionByName(d)
    out = add(rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n")).otherwise(F.col("n") - 1)), F.lit(0)).alias("broken")).select(F.lit(f"key {key}").alias("rule"), "broken"))
    out = add(expectations(rows, rules).select("rule", F.col("broken").cast("long").alias("broken"))) if rules else out
    for c, parent in parents.items():
        lone = rows.filter(F.col(c).isNotNull()).join(parent.select(c).distinct(), c, "left_anti").agg(F.count("*").alias("broken"))
        out = add(lone.select(F.lit(f"parent {c}").alias("rule"), "broken"))
    if manifest:
        got = rows.agg(*[m.cast("double").alias(n) for n, m in metrics.items()])
        each = F.array(*[F.struct(F.lit(f"manifest {n}").alias("rule"), F.coalesce((F.col(n) != F.lit(float(v))).cast("long"), F.lit(1).cast("long")).alias("broken")) for n, v in manifest.items()])
        out = add(got.select(F.explode(each).alias("x")).select("x.*"))
    return out


def typed(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast to declared types; what doesn't fit is null."""
    return rows.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in rows.columns})


def audit(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, action, before, after): row images of the rows that differ."""
    image = lambda d, n: d.select(key, F.to_json(F.struct(*sorted(c for c in d.columns if c != key))).alias(n))
    j = image(old, "before").join(image(new, "after"), key, "full_outer")
    action = F.when(F.col("before").isNull(), "INSERT").when(F.col("after").isNull(), "DELETE").otherwise("UPDATE")
    return j.filter(~F.col("before").eqNullSafe(F.col("after"))).select(key, action.alias("action"), "before", "after")


def coverage_gate(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(missing, total): keys of a that b lacks."""
    keys = a.select(key).distinct()
    return keys.join(b.select(key).distinct().withColumn("hit", F.lit(1)), key, "left").agg(F.count_if(F.col("hit").isNull()).alias("missing"), F.count("*").alias("total"))


def stage_decision(stages: DataFrame, now: DataFrame) -> DataFrame:
    """(stage, action): reuse if the scope's hash is unchanged, else run.  Both: stage, scope_hash."""
    j = now.alias("n").join(stages.alias("s"), "stage", "left")
    return j.select("stage", F.when(F.col("s.scope_hash") == F.col("n.scope_hash"), "reuse").when(F.col("s.scope_hash").isNull(), "run").otherwise("obsolete").alias("action"))


def with_tenant(rows: DataFrame, tenant: str, column: str = "tenant") -> DataFrame:
    """Rows of one tenant; the predicate reaches the scan."""
    return rows.filter(F.col(column) == tenant)
