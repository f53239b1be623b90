"""Connected components of a link table by contraction, as DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages


def components(links: DataFrame, stages: Stages) -> DataFrame:
    """(id, comp): for every id of ``links`` (a, b) the smallest id reachable from it.

    Each round joins every class of ids to its smallest neighbouring class, follows these
    pointers to their ends and contracts the links, so at least half of the classes that still
    have a neighbour vanish.  Minima are partial aggregates, so a hot id is combined before the
    shuffle.  An empty table gives an empty result.
    """
    links = stages.keep(links.select("a", "b").filter("a <> b").distinct(), "links")
    labels, edges = None, links
    while True:
        both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("to")), F.struct(F.col("b").alias("id"), F.col("a").alias("to")))).alias("e")).select("e.*")
        parent = stages.keep(both.groupBy("id").agg(F.least(F.col("id"), F.min("to")).alias("to")), "parent")
        while True:
            up = parent.select(F.col("id").alias("to"), F.col("to").alias("far"))
            jumped = stages.keep(parent.join(up, "to").select("id", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")), "jump")
            stages.drop(parent)
            parent = jumped.select("id", "to")
            parent._geomill_path = jumped._geomill_path
            if jumped.filter("moved").isEmpty():
                break
        if labels is None:
            labels = parent
        else:
            new = stages.keep(labels.join(parent.select(F.col("id").alias("to"), F.col("to").alias("far")), "to", "left").select("id", F.coalesce("far", "to").alias("to")), "labels")
            stages.drop(labels, parent)
            labels = new
        ends = labels.select(F.col("id"), F.col("to").alias("c"))
        nxt = links.join(ends.withColumnsRenamed({"id": "a", "c": "ca"}), "a").join(ends.withColumnsRenamed({"id": "b", "c": "cb"}), "b")
        nxt = nxt.filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        nxt = stages.keep(nxt, "edges")
        if edges is not links:
            stages.drop(edges)
        edges = nxt
        if edges.isEmpty():
            stages.drop(edges, links)
            return labels.select("id", F.col("to").alias("comp"))
