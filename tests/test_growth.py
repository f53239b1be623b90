"""What grew faster than its input, or answered otherwise on larger tables."""

import datetime
import hashlib
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from geomill.functions import identifiers, similarity, text
from geomill.operators import address, areas, gaps, joins, lexicon, rules, tagger
from geomill.operators.stages import folder, keeper, spread
from geomill.sources import writers
from geomill.streaming import flows


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_anomaly_signals_carry_no_sets(spark):
    rows = [(i, f"s{i % 2}", None if i % 4 else "p", i if i % 2 else None, None if i == 3 else "n", "a") for i in range(24)] + [(99, None, None, None, None, None), (100, "z", None, 1, "n", None)]
    got = rules.anomaly_signals(spark.createDataFrame(rows, "id int, street string, place string, number int, name string, sector string"))
    assert "Window" not in plan(got) and "collect_set" not in plan(got)
    out = {r.id: (r.s1, r.s2, r.s3, r.s4) for r in got.collect()}
    assert len(out) == len(rows) and out[99] == (True, False, False, False)
    assert out[0] == (False, False, True, False) and out[3] == (True, False, False, False) and out[5] == (True, False, True, False)


def test_contextual_street_is_no_larger_than_its_steps(spark):
    df = spark.createDataFrame([("Rua Dr. Silva",)], "c string").select(text.contextual_street(F.col("c")))
    e = df._jdf.queryExecution().analyzed().expressions().head().sql()
    assert len(e) < 50_000


def test_overdue_keys_once(spark, tmp_path):
    at = lambda h, m=0: datetime.datetime(2024, 1, 1, h, m)
    batches = [[(1, at(1)), (2, at(1))], [(3, at(12))], [(3, at(13)), (1, at(14))], [(3, at(23))]]
    for b in batches:
        spark.createDataFrame(b, "k long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    beats = flows.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], "k long, ts timestamp").schema, files_a_trigger=1)
    got = flows.overdue(spark, beats, folder(spark), folder(spark), "k", "ts", 6 * 3600, "10 minutes")
    assert sorted(map(tuple, got.collect())) == [(1, at(14)), (2, at(1))]


def test_band_joins_are_not_broadcast(spark):
    p = spark.createDataFrame([(i, -30 + i * 1e-4, -51.0) for i in range(30)], "id long, lat double, lng double")
    for df in (joins.near_pairs(p, 0.001), joins.within(p, p, 25.0)):
        physical = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in physical and "BroadcastHashJoin" not in physical
    assert {(r.a_id, r.b_id) for r in joins.within(p, p, 25.0).collect()} == {(i, j) for i in range(30) for j in range(30) if abs(i - j) <= 2}


def test_books_are_numbered_by_md5(spark):
    rows = spark.range(50).select(F.lit("b").alias("book"), F.lit("s").alias("sheet"), "id", F.when(F.col("id") % 2 == 0, "x").alias("note"))
    got = {r.path for r in writers.workbooks(rows, "book", "sheet", "id", most=20).select("path").collect()}
    assert got == {"b-1.xlsx", "b-2.xlsx", "b-3.xlsx"}
    want = {int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % 3 for x in ("\x1f".join(["b", "s", str(i), *(["x"] if i % 2 == 0 else [])]) for i in range(50))}
    assert want == {0, 1, 2} and writers.book_number(["book", "sheet", "id", "note"], F.lit(3)) is not None
    k = rows.select("id", writers.book_number(rows.columns, F.lit(3)).alias("k")).collect()
    assert all(r.k == int(hashlib.md5("\x1f".join(["b", "s", str(r.id), *(["x"] if r.id % 2 == 0 else [])]).encode()).hexdigest()[:8], 16) % 3 for r in k)


def test_floor_between_units_without_positions(spark):
    got = gaps.unit_gaps(spark.createDataFrame([(1, 100), (1, 300), (1, 400)], "building long, unit long")).collect()
    assert [tuple(r) for r in got] == [(1, 200, "B", "SUSTENTADA", None)]


def test_codes_and_units_of_more_digits(spark):
    """The queries' SQL says what the functions do: no unit of six digits, no activity code of eight."""
    from geomill.plans import registry

    sql, got = registry.oracle_sql(), spark.createDataFrame([("CS. 099999 Apto 003", "9999999"), ("CS. 0100000 Apto 003", "10000000")], "u string, c string")
    got = got.select(text.units(F.col("u")).alias("u"), identifiers.activity_code(F.col("c"))["code"].alias("c")).collect()
    assert [tuple(r) for r in got] == [(["ap 3", "casa 99999"], "9999999"), (["ap 3"], None)]
    con = duckdb.connect()
    con.sql("CREATE TABLE customer AS SELECT k AS c_custkey, 1 AS c_nationkey FROM (VALUES (99999), (100000), (270270), (270271)) v(k)")
    assert con.sql(f"SELECT units FROM ({sql['h124_units']}) q ORDER BY id").fetchall() == [(["ap 3", "casa 99999"],), (["ap 3"],), (["ap 3"],), (["ap 3"],)]
    assert con.sql(f"SELECT code, division FROM ({sql['h303_activity_code']}) q ORDER BY id").fetchall() == [("3699963", "36"), ("3700000", "37"), ("9999990", "99"), (None, None)]


def test_candidates_meet_by_keys(spark):
    r = random.Random(3)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 6))) for _ in range(120)} | {"casa", "caza", "kaza", "cassa", "ca", "x1", "12", "rua", "ruas", "ceia", "seia", "a1b2"})
    names = spark.createDataFrame([(1, f"beco {w}") for w in words] + [(2, "beco casa"), (2, "Beco  Caza"), (2, "beco caza"), (None, "beco casa")], "city int, name string")
    want = joins.substitution_pairs(names, ["city"]).filter(similarity.plausible(F.col("word_a"), F.col("word_b")))
    got = lexicon.candidates(names, ["city"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    assert "plausible" not in got.columns and got.columns == want.columns


def test_texts_decoded_together_as_alone():
    r = np.random.default_rng(4)
    w, step = r.normal(size=(tagger.SLOTS, len(tagger.TAGS))).astype(np.float32), r.normal(size=(len(tagger.TAGS) + 1, len(tagger.TAGS))).astype(np.float32)
    rows = [r.integers(0, tagger.SLOTS, (n, 11)).tolist() for n in r.integers(0, 12, 300)]
    want = [tagger.viterbi(np.array([w[f].sum(0) for f in x]).reshape(-1, len(tagger.TAGS)), step) for x in rows]
    assert tagger.decoded(rows, w, step) == want
    block, tagger.BLOCK = tagger.BLOCK, 7
    try:
        assert tagger.decoded(rows, w, step) == want
    finally:
        tagger.BLOCK = block


def test_rows_are_spread_over_tasks(spark):
    got = spread(spark.range(40).coalesce(1))
    assert got.rdd.getNumPartitions() == 4 and sorted(r.id for r in got.collect()) == list(range(40))


def test_cover_is_made_by_all_tasks_and_once(spark):
    ring = [(-30.0, -51.0), (-30.0, -50.99), (-29.99, -50.99)]
    cells = areas.cover(spark.createDataFrame([(str(i), ring) for i in range(40)], "name string, ring array<struct<lat:double,lng:double>>").coalesce(1))
    sizes = [len(x) for x in cells.rdd.glom().collect()]
    assert len(sizes) == 4 and min(sizes) > 0 and sum(sizes) == 40 * cells.filter("name = '7'").count()
    assert plan(cells).count("filter(edges") == areas.ROUNDS + 1


def test_address_passes_derive_each_side_once(spark):
    table = lambda rows: spark.createDataFrame(rows, "id long, postcode string, street string, city int, number long")
    doors = table([(1, "a", "x", 1, 5), (2, "a", "x", 1, 5), (3, "a", "y", 1, 9), (4, None, "z", 2, 7), (5, "b", None, None, None), (6, "c", "z", 2, None), (None, "a", "x", 1, 4)]).withColumn("core", F.reverse("street"))
    rows = table([(10, "a", "x", 1, 5), (11, "q", "y", 1, 9), (12, "a", "x", 1, 8), (13, "q", "z", 2, None), (14, "b", None, None, 1), (15, "a", None, None, 9)]).withColumn("core", F.reverse("street"))
    keep, plans = keeper(spark), []
    got = address.match_address(rows, doors, lambda df: plans.append(plan(df)) or keep(df))
    assert {r.id: (r.right_id, r.step, r.apart) for r in got.collect()} == {10: (1, "exact", 0), 11: (3, "city_exact", 0), 12: (1, "near_number", 3), 13: (4, "city_near_number", None), 15: (3, "postcode_number", 0)}
    assert sum("reverse(" in p for p in plans) == 2
