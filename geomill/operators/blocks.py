"""One row for each block of a collective address, with what is counted in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Counted uses and the sectors that make them up (fixed values).
USES = {
    "residential": ("RESIDENCIAL",), "commercial": ("COMERCIO_VAREJO", "COMERCIO_SERVICO", "BELEZA_ESTETICA"), "industrial": ("INDUSTRIAL",), "food": ("ALIMENTACAO",),
    "service": ("SERVICO_PROF", "SERVICO_AUTO"), "manufacture": ("MANUFATURA",), "health": ("SAUDE",), "education": ("EDUCACAO",), "religious": ("RELIGIOSO",), "lodging": ("HOSPEDAGEM",),
    "vacant": ("VAGO",), "other": ("LAZER", "ASSOCIACAO_ONG", "DIVERSOS", "AGROPECUARIO", "CONSTRUCAO", "DOMICILIO_COLETIVO"),
}
#: Columns that are taken from a block's first row (by id), if it has them.
FIRST = ("collective", "street", "number", "area", "postcode", "sector", "kind", "confidence", "confidence_code", "quality", "radar_address", "radar_block", "declared")


def block_profile(rows: DataFrame) -> DataFrame:
    """The measures of every (key, block) of collective rows with a number.

    Rows: id, key, collective (the address's id), is_collective, block, block_kind, floor, unit, house, use, lat, lng, any of ``FIRST``, and
    establishments (declared, a number).  A block without a name is ``-``.  Beside the first row's values: the first filled block
    kind, rows, different floors, units and houses, rows of each use, the centre, the most declared establishments, and of
    the whole collective its rows and its named blocks.
    """
    named = F.coalesce(F.nullif("block", F.lit("")), F.lit("-"))
    r = rows.filter("is_collective AND number > 0").withColumn("block", named)
    have = [c for c in FIRST if c in rows.columns]
    head = F.min(F.struct("id", *have)).alias("head")
    kind = F.min(F.when(F.trim("block_kind") != "", F.struct("id", "block_kind"))).alias("kind_")
    different = [F.countDistinct(F.nullif(c, F.lit(""))).alias(f"n_{c}s") for c in ("floor", "unit", "house")]
    uses = [F.count(F.when(F.col("use").isin(*v), 1)).alias(f"n_{k}") for k, v in USES.items()]
    g = r.groupBy("key", "block").agg(head, kind, F.count("*").alias("n"), *different, *uses, F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.max(F.col("establishments").try_cast("double")).alias("most_declared"))
    g = g.select(*[F.col(f"head.{c}").alias(c) for c in have], F.coalesce("kind_.block_kind", F.lit("-")).alias("block_kind"), *[c for c in g.columns if c not in ("head", "kind_", "key")])
    w = Window.partitionBy("collective")
    return g.withColumns({"total": F.sum("n").over(w), "n_blocks": F.count(F.when(F.col("block") != "-", 1)).over(w)})
