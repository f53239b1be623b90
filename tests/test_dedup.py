"""Deduplication by evidence: what merges, what doesn't, and why."""

import pytest
from pyspark.sql import functions as F

from geomill.operators import dedup
from geomill.operators.stages import keeper

M = 1 / 111320


def frame(spark, rows):
    full = [(i, r[0], r[1] if len(r) > 1 else "x", *[None if v is None else v for v in (list(r[3:]) + [None] * 3)[:3]], -29.9 + (r[2] if len(r) > 2 else 8 * i) * M, -51.2001) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "id bigint, name string, segment string, brand string, phone string, site string, lat double, lng double")


def groups(spark, rows, **more):
    return len({r.component for r in dedup.dedup(frame(spark, rows), keeper(spark), **more).collect()})


def test_what_merges(spark):
    assert groups(spark, [("Cheirin Bao Canoas Shopping", "x", 0), ("CVC Canoas Shopping Center", "x", 8), ("Renner Canoas Shopping", "x", 16), ("Riachuelo Canoas Shopping", "x", 24)]) == 4
    assert groups(spark, [(f"Setor {c}", "x", 6 * i) for i, c in enumerate("ABCDE")]) == 5
    assert groups(spark, [("Lancheria X9", "food", 0), ("Estacionamento X9", "cars", 5)]) == 2
    assert groups(spark, [("Banrisul Agencia Centro", "bank", 0), ("Banrisul", "bank", 5)]) == 1
    assert groups(spark, [("Padaria Sao Jose", "x", 0, None, "(51) 3476-1122"), ("Panificadora Sao Jose", "x", 8, None, "+55 51 34761122")]) == 1
    assert groups(spark, [("Loja Alfa", "x", 0, None, None, "https://x.com/alfa"), ("Comercio Beta", "x", 9, None, None, "https://x.com/alfa")]) == 1
    assert groups(spark, [("Subway", "x", 0, "Subway"), ("Subway", "x", 8, "Subway")]) == 1
    assert groups(spark, [("Farmacia Sao Joao", "health", 0), (None, "health", 8)]) == 1
    assert groups(spark, []) == 0


def test_vetoes_and_hubs(spark):
    rows = frame(spark, [("Subway", "x", 0, "Subway", "(51) 3000-1111"), ("Subway", "x", 20, "Subway", "(51) 3000-2222")])
    assert [r.reason for r in dedup.pair_evidence(rows).collect()] == ["veto_phone"]
    rows = frame(spark, [("Padaria Sol", "x", 0, None, "(51) 3476-1122"), ("Oficina Lua", "x", 12, None, "(51) 3476-1122")])
    assert [(r.reason, r.merges) for r in dedup.pair_evidence(rows).collect()] == [("phone_alone", False)]
    assert dedup.pair_evidence(frame(spark, [(f"Loja {i} z{i}", "x", 5 * i, None, "(51) 4004-0000") for i in range(6)])).count() == 0


@pytest.mark.parametrize("n", [5, 12])
def test_chains_are_cut(spark, n):
    rows = frame(spark, [("Bar do Zeca", "x", 28 * i) for i in range(n)])
    out = dedup.dedup(rows, keeper(spark)).join(rows, "id").groupBy("component").agg(((F.max("lat") - F.min("lat")) * 111320).alias("w")).collect()
    assert len(out) > 1 and all(r.w <= dedup.WIDEST_M + 0.1 for r in out)
    assert len({r.component for r in dedup.dedup(rows, keeper(spark), 5000.0).collect()}) == 1


def test_piled_points_stay(spark):
    rows = spark.createDataFrame([(i, "Bar Sol", "x", None, None, None, -29.91, -51.18) for i in range(3)], "id bigint, name string, segment string, brand string, phone string, site string, lat double, lng double")
    assert len({r.component for r in dedup.dedup(rows, keeper(spark)).collect()}) == 3
