"""Points in many polygons: quadtree covers of the rings, joined by cell.

A cell of level k is a square of 360 / 2^k degrees.  A ring is covered from the level at which a few cells
hold its box; in ``ROUNDS`` further steps of two levels each, cells that an edge may touch are split and cells
outside are left.  Cells wholly inside need no further test; a point in a cell that an edge may touch is tried
exactly against the ring.  Covers adapt to each ring, so municipalities and blocks share one table, and a
point meets only the rings whose cells hold it, however many rings there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.functions import geo

from .stages import spread

STEP, FINEST, ROUNDS = 2, 26, 3
#: Tables of cells or rings up to this counted size are broadcast.
SMALL = 100_000
#: Degrees by which a cell counts as touched though an edge passes beside it; far above rounding, far below a metre.
SLACK = 1e-9


def _touches(e: Column, y: Column, x: Column, half: Column) -> Column:
    """Whether the edge may touch the cell around (y, x): boxes meet and the corners aren't all on one side of its line."""
    half = half + SLACK
    box = (e["south"] <= y + half) & (e["north"] >= y - half) & (e["west"] <= x + half) & (e["east"] >= x - half)
    side = e["dx"] * (y - e["y1"]) - e["dy"] * (x - e["x1"])  # of the middle; a corner's differs by at most what follows
    return box & (F.abs(side) <= (F.abs(e["dx"]) + F.abs(e["dy"])) * half + 1e-15)


def cover(polygons: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(name, level, cy, cx, inner) of rings (name, ring); rings of fewer than three corners have no cells.

    Rings are dealt to all tasks first, as a table of few rows with much work each comes in few partitions.  A step's cells are
    made with their edges by the ``explode``, so that later filters and steps read them instead of repeating the expressions.
    """
    ends = "transform(sequence(1, size(ring)), i -> struct(ring[i - 1].lat AS y1, ring[i - 1].lng AS x1, ring[i % size(ring)].lat AS y2, ring[i % size(ring)].lng AS x2))"
    edge = "struct(e.y1, e.x1, e.y2 - e.y1 AS dy, e.x2 - e.x1 AS dx, least(e.y1, e.y2) AS south, greatest(e.y1, e.y2) AS north, least(e.x1, e.x2) AS west, greatest(e.x1, e.x2) AS east)"
    low, high = (lambda k: F.array_min(F.transform("ring", lambda p: p[k]))), (lambda k: F.array_max(F.transform("ring", lambda p: p[k])))
    p = spread(polygons.select("name", "ring")).filter(F.size("ring") >= 3)
    p = p.select("name", "ring", F.expr(f"transform({ends}, e -> {edge})").alias("edges"), *[f(k).alias(f"{a}_{k}") for a, f in (("low", low), ("high", high)) for k in ("lat", "lng")])
    extent = F.greatest(F.col("high_lat") - F.col("low_lat"), F.col("high_lng") - F.col("low_lng"), F.lit(1e-7))
    level = F.least(F.floor(F.log2(360.0 / extent) / STEP) * STEP, F.lit(FINEST)).cast("int")
    p = p.withColumn("level", F.greatest(level, F.lit(0)))
    size = lambda level: 360.0 / F.pow(F.lit(2.0), level.cast("double"))
    span = lambda k: F.sequence(F.floor((F.col(f"low_{k}") + 180.0) / size(F.col("level"))), F.floor((F.col(f"high_{k}") + 180.0) / size(F.col("level"))))
    n_ = 1 << STEP
    square = lambda cys, cxs, level: F.flatten(F.transform(cys, lambda cy: F.transform(cxs, lambda cx: F.struct(level.alias("level"), cy.alias("cy"), cx.alias("cx")))))
    split = lambda k: F.transform(F.sequence(F.lit(0), F.lit(n_ - 1)), lambda i: F.col(k) * n_ + i)
    middle = lambda c, k: (c[k] + 0.5) * size(c["level"]) - 180.0

    def tried(c: Column) -> Column:
        return F.struct(c["level"].alias("level"), c["cy"].alias("cy"), c["cx"].alias("cx"), F.filter("edges", lambda e: _touches(e, middle(c, "cy"), middle(c, "cx"), size(c["level"]) / 2)).alias("edges"), F.lit(False).alias("inner"))

    cells = p.select("name", "ring", F.explode(F.transform(square(span("lat"), span("lng"), F.col("level")), tried)).alias("c"))
    for k in range(rounds + 1):
        cells = cells.select("name", "ring", "c.*")
        cells = cells.filter(F.col("inner") | (F.size("edges") > 0) | geo.in_ring(middle(F.struct("level", "cy"), "cy"), middle(F.struct("level", "cx"), "cx"), F.col("ring")))
        cells = cells.withColumn("inner", F.size("edges") == 0)
        if k < rounds:
            parts = F.transform(square(split("cy"), split("cx"), F.col("level") + STEP), tried)
            own = F.array(F.struct("level", "cy", "cx", "edges", "inner"))
            cells = cells.select("name", "ring", F.explode(F.when(~F.col("inner") & (F.col("level") < FINEST), parts).otherwise(own)).alias("c"))
    return cells.select("name", "level", "cy", "cx", "inner")


def points_in_polygons(points: DataFrame, polygons: DataFrame, keep, rounds: int = ROUNDS, small: int = SMALL) -> DataFrame:
    """(id, name) for every polygon that holds a point (half-open at edges, as ``geo.in_ring``); rings may overlap, touch and nest."""
    cells = keep(cover(polygons, rounds))
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())  # FINEST / STEP + 1 at most
    if not levels:
        return points.select("id").limit(0).crossJoin(polygons.select("name").limit(0))
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor((F.col("lat") + 180.0) / (360.0 / 2**k)).alias("cy"), F.floor((F.col("lng") + 180.0) / (360.0 / 2**k)).alias("cx")) for k in levels]))
    tried = points.filter("lat IS NOT NULL AND lng IS NOT NULL").select("id", "lat", "lng", at.alias("c")).select("id", "lat", "lng", "c.level", "c.cy", "c.cx")
    few = cells.count() <= small
    met = tried.join(F.broadcast(cells) if few else cells, ["level", "cy", "cx"])
    rings = polygons.select("name", "ring")
    exact = met.filter("NOT inner").join(F.broadcast(rings) if few else rings, "name").filter(geo.in_ring(F.col("lat"), F.col("lng"), F.col("ring")))
    return met.filter("inner").select("id", "name").unionByName(exact.select("id", "name"))
