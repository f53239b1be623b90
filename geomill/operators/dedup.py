"""Deduplication by evidence at the scale of a state: context words, hubs, vetoes, and groups of bounded diameter."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.functions import geo, text

from . import fusion, joins

# Metres within which a kind of evidence counts, and the widest group.
NAME_M, CONTACT_M, BRAND_M, UNNAMED_M, WIDEST_M = 30.0, 20.0, 15.0, 10.0, 85.0

# Words that say what a place is and not which one.
GENERIC = ("loja", "bar", "padaria", "panificadora", "farmacia", "mercado", "restaurante", "lancheria", "advocacia", "agencia", "centro", "comercio", "comercial", "auto", "posto", "casa", "estacionamento", "de", "da", "do", "dos", "das")


def cores(rows: DataFrame, cell: float = 0.001, least: int = 3, generic: Sequence[str] = GENERIC) -> DataFrame:
    """``rows`` (id, name, lat, lng, ...) with ``core``: the name's words but generic ones and those of the context.

    A word is context where ``least`` different names of the grid cell and its neighbours hold it: it names the
    building, the street or the quarter."""
    cy, cx = geo.floor_cell(F.col("lat"), cell), geo.floor_cell(F.col("lng"), cell)
    own = F.array_except(F.array_distinct(text.words(text.void_to_null(F.col("name")))), F.array(*map(F.lit, generic)))
    r = rows.withColumns({"_y": cy, "_x": cx, "_w": F.coalesce(own, F.array().cast("array<string>"))})
    held = r.select("_y", "_x", F.explode("_w").alias("word"), F.lower("name").alias("name")).distinct()
    held = joins.with_offsets(held, F.col("_y"), F.col("_x")).select("_cy", "_cx", "word", "name").distinct()
    context = held.groupBy("_cy", "_cx", "word").count().filter(F.col("count") >= least).select(F.col("_cy").alias("_y"), F.col("_cx").alias("_x"), "word")
    context = context.groupBy("_y", "_x").agg(F.collect_set("word").alias("_c"))  # of words, not of rows
    return r.join(context, ["_y", "_x"], "left").withColumn("core", F.array_except("_w", F.coalesce("_c", F.array().cast("array<string>")))).drop("_y", "_x", "_w", "_c")


def pair_evidence(rows: DataFrame, hub: int = 4) -> DataFrame:
    """(a, b, m, reason, merges) of points within ``NAME_M``: what speaks for one place, or why that isn't enough.

    Rows: id, name, segment, brand, phone, site, lat, lng.  A phone of more than ``hub`` rows is no evidence;
    different phones veto a merge by name or brand; a phone needs a shared word of the core beside it."""
    r = cores(rows).withColumn("phone", F.nullif(text.phone_key(F.col("phone")), F.lit(""))).withColumn("site", F.lower(F.trim(text.void_to_null(F.col("site")))))
    hubs = r.filter("phone IS NOT NULL").groupBy("phone").count().filter(F.col("count") > hub).select("phone", F.lit(True).alias("hub"))
    r = r.join(hubs, "phone", "left").withColumn("phone", F.when(F.col("hub").isNull(), F.col("phone"))).drop("hub")
    p = joins.within(r, r, NAME_M, carry=["core", "segment", "brand", "phone", "site"]).filter("a_id < b_id")
    a, b, m = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}")), F.col("m")
    same = lambda c: F.coalesce(a(c) == b(c), F.lit(False))
    shared, every = F.size(F.array_intersect(a("core"), b("core"))), F.size(F.array_union(a("core"), b("core")))
    short = (F.size(a("core")) == 1) & (F.length(a("core")[0]) <= 3)
    name = (every > 0) & (shared >= 0.8 * every) & (~F.coalesce(F.when(F.size(a("core")) > 0, short), F.lit(False)) | same("segment"))
    unnamed = (F.size(a("core")) == 0) != (F.size(b("core")) == 0)
    veto = F.coalesce(a("phone") != b("phone"), F.lit(False))
    reason = (
        F.when(same("site") & (m <= CONTACT_M), "site").when(veto & (name | same("brand")), "veto_phone").when(same("phone") & (m <= CONTACT_M) & (shared > 0), "phone_and_name")
        .when(same("phone"), "phone_alone").when(name, "name").when(same("brand") & (m <= BRAND_M), "brand").when(unnamed & same("segment") & (m <= UNNAMED_M), "unnamed")
    )
    return p.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "m", reason.alias("reason")).filter("reason IS NOT NULL").withColumn("merges", ~F.col("reason").isin("veto_phone", "phone_alone"))


def bounded_groups(edges: DataFrame, points: DataFrame, keep: Callable[[DataFrame], DataFrame], widest_m: float = WIDEST_M) -> DataFrame:
    """(id, component): connected groups of edges (a, b), none wider than ``widest_m``.

    Of a wider one the points within half the width of its smallest id stay together; the rest is connected
    anew by the edges among it, round by round.  Every round settles at least one point of each group."""
    at = points.select("id", "lat", "lng")
    left, done = keep(edges.select("a", "b").distinct()), None
    while not left.isEmpty():
        comp = keep(fusion.components(left, keep).join(at, "id"))
        box = comp.groupBy("component").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lng").alias("w"), F.max("lng").alias("e"))
        fits = geo.metres(F.col("s"), F.col("w"), F.col("n"), F.col("e")) <= widest_m
        heart = at.select(F.col("id").alias("component"), F.col("lat").alias("y"), F.col("lng").alias("x"))
        judged = comp.join(box.select("component", fits.alias("fits")), "component").join(heart, "component")
        near = geo.metres(F.col("lat"), F.col("lng"), F.col("y"), F.col("x")) <= widest_m / 2
        judged = keep(judged.select("id", "component", (F.col("fits") | near).alias("stays")))
        settled = judged.filter("stays").select("id", "component")
        done = settled if done is None else done.unionByName(settled)
        out = judged.filter("NOT stays").select("id")
        left = keep(left.join(out.withColumnRenamed("id", "a"), "a", "left_semi").join(out.withColumnRenamed("id", "b"), "b", "left_semi"))
        alone = keep(out.join(left.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_anti"))
        done = done.unionByName(alone.select("id", F.col("id").alias("component")))
    return done if done is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


def dedup(rows: DataFrame, keep: Callable[[DataFrame], DataFrame], widest_m: float = WIDEST_M) -> DataFrame:
    """(id, component) of every row: groups of one place by ``pair_evidence``; rows without any stand alone.

    Points on one exact coordinate that three or more share and that has no more than two decimals are a
    centroid and not a position: they take no part."""
    rough = (F.round("lat", 2) == F.col("lat")) & (F.round("lng", 2) == F.col("lng"))
    piled = rows.filter(rough).groupBy("lat", "lng").count().filter("count > 2").select("lat", "lng")
    able = rows.join(piled, ["lat", "lng"], "left_anti")
    edges = keep(pair_evidence(able).filter("merges").select("a", "b"))
    groups = bounded_groups(edges, able, keep, widest_m)
    return rows.select("id").join(groups, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
