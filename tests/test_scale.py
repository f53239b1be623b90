"""What has no bound by size any more: beyond the old bounds, and in small pieces against the whole."""

import io
import random
import zipfile

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from geomill.functions import geo, text
from geomill.operators import cluster, joins, rules
from geomill.operators.stages import keeper
from geomill.plans import streams
from geomill.plans.inputs import Tables
from geomill.sources import archives, readers, writers


def test_hulls_of_many_batches(spark):
    r = np.random.default_rng(1)
    rows = [(int(g), float(y), float(x)) for g, y, x in zip(r.integers(0, 3, 9000), r.normal(size=9000), r.normal(size=9000), strict=True)] + [(7, 1.0, 2.0), (8, 1.0, 2.0), (8, 3.0, 4.0), (9, None, 1.0)]
    df = spark.createDataFrame(rows, "g long, lat double, lng double").repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 200)
    try:
        got = {x.g: x.hull for x in cluster.hulls(df, "g").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[7] == "POINT (2.000000 1.000000)" and got[8].startswith("LINESTRING") and 9 not in got
    for g in range(3):
        corners = geo.hull([(x, y) for k, y, x in rows if k == g])
        assert got[g] == "POLYGON ((" + ", ".join(f"{x:.6f} {y:.6f}" for x, y in [*corners, corners[0]]) + "))"


def test_unit_grid_of_tall_and_wide_buildings(spark):
    units = [(1, f * 100 + p) for f in range(1, 91) for p in (1, 2, 60) if (f, p) != (45, 2)]
    got = {(r.building, r.unit): r.grade for r in rules.unit_grid(spark.createDataFrame(units, "building long, unit long")).collect()}
    assert got[1, 4502] == "A" and len(got) == 90 * 60 - len(units)


def test_workbooks_beyond_the_old_bound(spark):
    rows = [("a", "s", i, f"n{i}") for i in range(500)] + [("b", "s", i, "x") for i in range(20)]
    books = writers.workbooks(spark.createDataFrame(rows, "book string, sheet string, id long, name string"), "book", "sheet", "id", most=100)
    got = readers.read_workbooks(books, {"id": [], "name": []}).collect()
    assert sorted((r.path[0], int(r.id), r.name) for r in got) == sorted((b, i, n) for b, _, i, n in rows)
    assert {r.path for r in got if r.path[0] == "b"} == {"b.xlsx"} and 4 <= len({r.path for r in got if r.path[0] == "a"}) <= 5


def test_hilbert_curve_visits_neighbours():
    y, x = np.divmod(np.arange(1024), 32)
    d = cluster.hilbert(y, x, 5)
    assert sorted(d) == list(range(1024))
    o = np.argsort(d)
    assert (np.abs(np.diff(y[o])) + np.abs(np.diff(x[o])) == 1).all()


def test_path_in_pieces(spark):
    r = random.Random(4)
    rows = [(i, "big", r.uniform(-30, -29), r.uniform(-51, -50)) for i in range(1500)] + [(2000 + i, "one", -30.0, -51.0) for i in range(130)] + [(3000 + i, "few", r.uniform(0, 1), r.uniform(0, 1)) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, region string, lat double, lng double")
    got = {x.id: x for x in cluster.path_order(df, "region", keeper(spark), piece=50).collect()}
    at = {i: (y, x) for i, _, y, x in rows}
    assert got.keys() == at.keys()

    def length(ids):
        return sum(np.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1]) for a, b in zip(ids, ids[1:], strict=False))

    for region in ("big", "one", "few"):
        walk = sorted((x for x in got.values() if x.region == region), key=lambda x: x.step)
        assert [x.step for x in walk] == list(range(len(walk)))
    whole = {x.id: x.step for x in cluster.path_order(df, "region", keeper(spark)).collect()}
    big = [i for i, g, _, _ in rows if g == "big"]
    assert length(sorted(big, key=lambda i: got[i].step)) < 1.5 * length(sorted(big, key=lambda i: whole[i]))
    assert all(got[i].step == whole[i] for i, g, _, _ in rows if g == "few")


def test_stream_of_several_files_a_batch(spark, monkeypatch):
    monkeypatch.setattr(streams, "ROWS_A_FILE", 50)
    sf = "/root/testdata/sf0.001"
    t = Tables(spark, sf)
    whole = t.events.select(F.max(F.col("ts").cast("timestamp")).alias("ts")).first().ts
    assert len(streams.stream(t).schema) == len(t.events.schema)
    out = {r.start: r.n for r in __spark_entry__.queries()["m08_tumbling_stream"](spark, sf).collect()}
    want = {r.day: r["count"] for r in t.events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).count().collect()}
    assert out and all(want[k] == n for k, n in out.items()) and all(k in out for k in want if (whole - k).total_seconds() > 2 * 86400 + 3600)


def test_left_out_groups_and_words_are_the_rest(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    pairs, over = joins.capped_key_pairs(t.poi, ["category", "street"], 5)
    every = joins.key_pairs(t.poi, ["category", "street"]).select("a", "b")
    big = t.poi.join(over, ["category", "street"], "left_semi").select("id")
    assert over.count() > 0 and pairs.count() + every.join(big.withColumnRenamed("id", "a"), "a", "left_semi").count() == every.count()
    w = t.poi.select("id", text.words(F.col("name")).alias("words"))
    common = {r.token for r in joins.common_tokens(w, 20).collect()}
    assert common and not common & {r.token for r in w.select(F.explode("words").alias("token")).groupBy("token").count().filter("count <= 20").collect()}


def test_numerals_and_layers(spark):
    df = spark.createDataFrame([("catorze",), ("cento e catorze",), ("duzentas e uma",), ("mil e cincoenta",)], "w string")
    assert [r[0] for r in df.select(text.numeral(F.col("w"))).collect()] == [14, 114, 201, 1050]
    rows = [(["BLOCO", "apartamento ", None, "TORRE", "Predio"], ["A", " 101", "x", "B", None]), ([None], ["1"]), (["SUBSOLO", "LOTE"], ["", "5"]), ([], [])]
    out = spark.createDataFrame(rows, "n array<string>, v array<string>").select(text.complement_form(text.complement_layers(F.col("n"), F.col("v")))).collect()
    assert [r[0] for r in out] == ["PREDIO → BLOCO A → APARTAMENTO 101", "", "SUBSOLO → LOTE 5", ""]
    assert sum(map(len, text.LAYERS.values())) == 66


# ---- archives ------------------------------------------------------------------------------------
def pack(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)


def test_members_are_chosen_by_their_header(spark, tmp_path):
    pack(tmp_path / "a.zip", {"x/um.csv": "﻿ID;Nome;outro\n1;ana;z\n2;\"b;c\nd\";z\nquebrada\n3;;z\n", "leia.txt": "nada aqui\n", "vazio.csv": "", "foto.jpg": b"\xff\xd8"})
    pack(tmp_path / "b.zip", {"dois.TXT": "RAZÃO;x;cod\nzé;0;7\n", "tres.csv": "id;outra\n9;q\n"})
    wanted = {"id": ["cod"], "name": ["nome", "razao"]}
    got = archives.read_archives(spark, str(tmp_path), wanted)
    assert sorted(tuple(r) for r in got.collect()) == sorted([("a.zip", "x/um.csv", "1", "ana"), ("a.zip", "x/um.csv", "2", "b;c\nd"), ("a.zip", "x/um.csv", "3", None), ("b.zip", "dois.TXT", "7", "zé")], key=lambda r: r[:3])
    some = archives.read_archives(spark, str(tmp_path / "b.zip"), wanted, required=["id"])
    assert sorted((r.member, r.id, r.name) for r in some.collect()) == [("dois.TXT", "7", "zé"), ("tres.csv", "9", None)]
    assert got.rdd.getNumPartitions() == 5
    empty = tmp_path / "none"
    empty.mkdir()
    assert archives.read_archives(spark, str(empty), wanted).count() == 0


def test_members_without_a_header_and_in_latin1(spark, tmp_path):
    pack(tmp_path / "e.zip", {"K1.ESTABELE.csv": "1;são;02\n2;x;08\n".encode("latin-1")})
    got = archives.read_archives(spark, str(tmp_path), ["root", "status"], names=["root", "name", "status"])
    assert sorted((r.root, r.status) for r in got.collect()) == [("1", "02"), ("2", "08")]
    named = archives.read_archives(spark, str(tmp_path), ["name"], names=["root", "name", "status"], encoding="latin-1")
    assert sorted(r.name for r in named.collect()) == ["são", "x"]


def test_archives_written_line_by_line(spark, tmp_path):
    lines = [(f"{a}.zip", m, i, f"{a}{m}{i}") for a in "pq" for m in ("one.csv", "two.csv") for i in range(30)]
    assert archives.write_archives(spark.createDataFrame(lines, "archive string, member string, at long, line string").repartition(5), str(tmp_path / "out")) == 120
    with zipfile.ZipFile(io.BytesIO((tmp_path / "out" / "p.zip").read_bytes())) as z:
        assert z.read("one.csv").decode().split("\n")[:2] == ["pone.csv0", "pone.csv1"] and z.namelist() == ["one.csv", "two.csv"]
