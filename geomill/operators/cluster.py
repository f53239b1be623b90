"""Density clusters, hulls and path orders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geomill.functions import geo

from . import fusion, joins


def dbscan(points: DataFrame, eps_m: float, least: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, cluster, core): DBSCAN; a cluster is named by its smallest core id, noise has null.

    Neighbours come from a band join; cores with ``least`` points in reach (the own one included) are
    connected; a border point joins its nearest core (ties: smaller id).
    """
    near = keep(joins.within(points, points, eps_m, geo.haversine).filter("a_id < b_id"))  # each pair once
    ends = near.select(F.explode(F.array("a_id", "b_id")).alias("id")).unionByName(points.filter("lat IS NOT NULL AND lng IS NOT NULL").select("id"))
    core = keep(ends.groupBy("id").count().filter(F.col("count") >= least).select("id"))
    mark = lambda e: core.select(F.col("id").alias(f"{e}_id"), F.lit(True).alias(f"{e}_core"))
    near = near.join(mark("a"), "a_id", "left").join(mark("b"), "b_id", "left").select("a_id", "b_id", "m", *[F.coalesce(f"{e}_core", F.lit(False)).alias(f"{e}_core") for e in "ab"])
    near = keep(near.filter("a_core OR b_core"))
    comp = fusion.components(near.filter("a_core AND b_core").select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), keep)
    cores = core.join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"), F.lit(True).alias("core"))
    border = near.filter("a_core <> b_core").select(F.when(F.col("a_core"), F.col("b_id")).otherwise(F.col("a_id")).alias("id"), F.when(F.col("a_core"), F.col("a_id")).otherwise(F.col("b_id")).alias("to"), "m")
    border = border.groupBy("id").agg(F.min(F.struct("m", "to"))["to"].alias("to")).join(cores.select(F.col("id").alias("to"), "cluster"), "to").select("id", "cluster", F.lit(False).alias("core"))
    done = cores.unionByName(border)
    return points.select("id").join(done, "id", "left").select("id", "cluster", F.coalesce("core", F.lit(False)).alias("core"))


def hulls(members: DataFrame, group: str) -> DataFrame:
    """(group, hull): WKT of each group's convex hull.

    The corners of a whole are among the corners of its parts: each batch of rows is thinned to the corners of its groups,
    dealt by group and a hash of the point, thinned again, and only what is left meets in one row a group.
    """
    kind = dict(members.dtypes)[group]

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of: dict = {}
            for g, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                of.setdefault(g, []).append((x, y))
            rows = [(g, *p) for g, points in of.items() for p in geo.hull(points)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.float64())], names=[group, "lng", "lat"])

    schema = f"`{group}` {kind}, lng double, lat double"
    thin = members.filter("lat IS NOT NULL AND lng IS NOT NULL").select(group, F.col("lng").cast("double").alias("lng"), F.col("lat").cast("double").alias("lat")).mapInArrow(corners, schema)
    dealt = thin.repartition(F.col(group), F.pmod(F.xxhash64("lng", "lat"), F.lit(32))).sortWithinPartitions(group)
    pts = dealt.mapInArrow(corners, schema)
    return pts.groupBy(group).agg(F.collect_list(F.struct("lng", "lat")).alias("p")).select(group, geo.hull_wkt(F.col("p.lng"), F.col("p.lat")).alias("hull"))


#: Most points of a piece of a path, and bits of a coordinate on the Hilbert curve.
PIECE, BITS = 4000, 16


def hilbert(y: np.ndarray, x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places of cells (y, x) of a 2^bits square on the Hilbert curve."""
    y, x, d = y.astype(np.int64).copy(), x.astype(np.int64).copy(), np.zeros(len(y), np.int64)
    for k in range(bits - 1, -1, -1):
        s = 1 << k
        ry, rx = (y & s) > 0, (x & s) > 0
        d += s * s * ((3 * rx.astype(np.int64)) ^ ry.astype(np.int64))
        flip = ~ry & rx
        x[flip], y[flip] = s - 1 - (x[flip] & (s - 1)), s - 1 - (y[flip] & (s - 1))
        x[~ry], y[~ry] = y[~ry], x[~ry].copy()
        x, y = x & (s - 1), y & (s - 1)
    return d


def path_order(points: DataFrame, region: str, keep: Callable[[DataFrame], DataFrame], piece: int = PIECE) -> DataFrame:
    """(id, region, step): a walk through each region: greedy nearest-neighbour chains, one piece after the other.

    A region of up to ``piece`` points is one chain from its smallest id.  A larger one is cut along the Hilbert curve
    of its box, into the largest cells that hold no more than ``piece`` points (points on one place beyond that are dealt by
    hash), and the pieces follow each other along the curve, each from its first point on it.  Successive cells share a side
    or lie apart by empty cells only, so a step between pieces is no longer than the diagonal of the two cells and
    the empty ones between; no task holds more than a piece.
    """
    kind = dict(points.dtypes)
    box = points.groupBy(region).agg(F.count("*").alias("n"), F.min("lat").alias("s"), F.max("lat").alias("t"), F.min("lng").alias("w"), F.max("lng").alias("e"), F.avg("lat").alias("mid"))
    p = points.select("id", region, "lat", "lng").join(box, region)
    unit = lambda c, lo, hi: F.floor(F.when(F.col(hi) > F.col(lo), (F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(0.0) * ((1 << BITS) - 1)).cast("long")

    @F.pandas_udf("long")
    def on_curve(y: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(hilbert(y.to_numpy(), x.to_numpy()))

    p = keep(p.withColumn("h", F.when(F.col("n") <= piece, F.lit(0)).otherwise(on_curve(unit("lat", "s", "t"), unit("lng", "w", "e")))).select("id", region, "lat", "lng", "mid", "n", "h"))
    open_, done = p, None
    for level in range(0, BITS + 1, 2):
        cell = F.shiftright("h", 2 * (BITS - level)) if level else F.lit(0).cast("long")
        at = open_.withColumn("cell", cell)
        sizes = at.groupBy(region, "cell").agg(F.count("*").alias("m"))
        at = keep(at.join(sizes, [region, "cell"]))
        fits = F.col("m") <= piece
        if level == BITS:  # one place: by hash
            at, fits = at.withColumn("cell", F.col("cell") * (1 << 20) + F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / piece))), F.lit(True)
            start = F.shiftright("cell", 20)
        else:
            start = F.shiftleft("cell", 2 * (BITS - level))
        part = at.filter(fits).select("id", region, "lat", "lng", "mid", "n", "h", start.alias("start"), F.lit(level).alias("level"), "cell")
        done = part if done is None else done.unionByName(part)
        open_ = at.filter(~fits).drop("cell", "m")
        if open_.isEmpty():
            break
    done = keep(done)
    order = ["start", "level", "cell"]
    pieces = done.groupBy(region, *order).agg(F.count("*").alias("m"))
    w = Window.partitionBy(region).orderBy(*order)
    pieces = pieces.withColumn("before", F.sum("m").over(w) - F.col("m"))  # a row a piece

    def chain(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["h", "id"]).reset_index(drop=True)
        y = p["lat"].to_numpy() * geo.DEGREE_M
        x = p["lng"].to_numpy() * geo.DEGREE_M * np.cos(np.radians(p["mid"].iloc[0]))
        left, now, step = np.ones(len(p), bool), 0, np.zeros(len(p), np.int64)
        for k in range(len(p)):
            left[now], step[now] = False, k
            if left.any():
                d = np.where(left, np.hypot(x - x[now], y - y[now]), np.inf)
                now = int(d.argmin())
        return pd.DataFrame({"id": p["id"], region: p[region], "step": p["before"].iloc[0] + step})

    rows = done.join(pieces.drop("m"), [region, *order]).select("id", region, "lat", "lng", "mid", "h", *order, "before")
    return rows.groupBy(region, *order).applyInPandas(chain, f"id {kind['id']}, {region} {kind[region]}, step bigint")


def medoids(points: DataFrame, group: str, top: int = 1) -> DataFrame:
    """(group, id, rank): the points nearest to the group's median coordinates."""
    mid = points.groupBy(group).agg(F.expr("percentile(lat, 0.5)").alias("y"), F.expr("percentile(lng, 0.5)").alias("x"))
    d = (F.col("lat") - F.col("y")) * (F.col("lat") - F.col("y")) + (F.col("lng") - F.col("x")) * (F.col("lng") - F.col("x"))
    w = Window.partitionBy(group).orderBy("d", "id")
    return points.join(mid, group).withColumn("d", d).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(group, "id", "rank")


def pixel_labels(images: DataFrame, height: int, width: int) -> DataFrame:
    """(tile, y, x, label): 4-connected regions of images given as arrays ``on`` of coloured pixels (y, x).

    A tile has a fixed number of pixels, so one is labelled whole; labels count regions by their first pixel.
    """
    def run(batches):
        for b in batches:
            for tile, on in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mask = np.zeros((height + 2, width + 2), bool)
                for p in on or []:
                    mask[p["y"] + 1, p["x"] + 1] = True
                label = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
                while True:  # every pixel takes the smallest label next to it
                    new = label.copy()
                    for axis, step in ((0, 1), (0, -1), (1, 1), (1, -1)):
                        new = np.minimum(new, np.roll(label, step, axis))
                    new = np.where(mask, new, mask.size)
                    if (new == label).all():
                        break
                    label = new
                y, x = np.nonzero(mask)
                _, number = np.unique(label[y, x], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([tile] * len(y), pa.string()), pa.array(y - 1, pa.int32()), pa.array(x - 1, pa.int32()), pa.array(number, pa.int64())], names=["tile", "y", "x", "label"])

    return images.select("tile", "on").mapInArrow(run, "tile string, y int, x int, label bigint")


def label_components(images: DataFrame, height: int, width: int) -> DataFrame:
    """(tile, label, pixels): the regions of ``pixel_labels`` with their sizes."""
    return pixel_labels(images, height, width).groupBy("tile", "label").agg(F.count("*").alias("pixels"))


def plane_regions(pixels: DataFrame, keep: Callable[[DataFrame], DataFrame], side: int = 200) -> DataFrame:
    """(y, x, region): 4-connected regions of the coloured pixels (y, x) of a plane; a region is named by its first pixel, as (y, x).

    The plane is cut into tiles of ``side`` x ``side``; each is labelled by itself, labels that touch across a
    border are links between (tile, label) pairs, and their components join the pieces.
    """
    at = lambda c: F.floor(F.col(c) / side).cast("long")
    p = pixels.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()
    tiles = p.groupBy(F.concat_ws("/", at("y"), at("x")).alias("tile")).agg(F.collect_list(F.struct(F.pmod("y", F.lit(side)).cast("int").alias("y"), F.pmod("x", F.lit(side)).cast("int").alias("x"))).alias("on"))  # side * side pixels at most
    n = F.split("tile", "/")
    labels = pixel_labels(tiles, side, side).select((n[0].cast("long") * side + F.col("y")).alias("y"), (n[1].cast("long") * side + F.col("x")).alias("x"), F.concat_ws("/", "tile", "label").alias("piece"))
    labels = keep(labels)
    edge = labels.filter((F.pmod("y", F.lit(side)).isin(0, side - 1)) | (F.pmod("x", F.lit(side)).isin(0, side - 1)))
    steps = F.explode(F.array(F.struct((F.col("y") + 1).alias("y"), F.col("x").alias("x")), F.struct(F.col("y").alias("y"), (F.col("x") + 1).alias("x"))))
    next_ = edge.select(F.col("piece").alias("a"), steps.alias("s")).select("a", "s.y", "s.x")
    links = next_.join(edge.select("y", "x", F.col("piece").alias("b")), ["y", "x"]).filter("a <> b").select("a", "b")
    whole = fusion.components(links, keep).withColumnsRenamed({"id": "piece", "component": "whole"})
    named = labels.join(whole, "piece", "left").withColumn("whole", F.coalesce("whole", "piece"))
    first = named.groupBy("whole").agg(F.min(F.struct("y", "x")).alias("region"))
    return named.join(first, "whole").select("y", "x", "region")
