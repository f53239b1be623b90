"""Operators that SQL doesn't check, against brute force; and edge cases."""

import itertools
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from geomill.functions import geo, nested, similarity, text, values
from geomill.operators import changes, cluster, fusion, joins
from geomill.operators.stages import keeper
from geomill.sources import readers, writers
from geomill.sources.guard import read_only


def points(spark, n, spread=0.01, seed=1):
    r = random.Random(seed)
    rows = [(i, -30 + r.random() * spread, -51 + r.random() * spread) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, lat double, lng double")


def metres(a, b):
    dy, dx = (b[1] - a[1]) * 111320, (b[2] - a[2]) * 111320 * math.cos(math.radians((a[1] + b[1]) / 2))
    return math.hypot(dx, dy)


@pytest.mark.parametrize("spread", [0.01, 2.5])
def test_within(spark, spread):
    rows, df = points(spark, 300, spread)
    radius = 60.0 if spread < 1 else 15_000.0
    want = {(a[0], b[0]) for a in rows for b in rows if metres(a, b) <= radius}
    assert {(r.a_id, r.b_id) for r in joins.within(df, df, radius).collect()} == want


def test_greedy(spark):
    r = random.Random(2)
    prop = [(a, b, r.randint(0, 2), float(r.randint(0, 5))) for a in range(15) for b in range(15) if r.random() < 0.4]
    used_a, used_b, want = set(), set(), set()
    for a, b, s, m in sorted(prop, key=lambda p: (-p[2], p[3], p[0], p[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), want.add((a, b))
    df = spark.createDataFrame(prop, "a bigint, b bigint, strength int, m double")
    assert {(x.a, x.b) for x in joins.greedy_one_to_one(df, keeper(spark)).collect()} == want


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(5, 9), (9, 2), (7, 8)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    assert {r.id: r.component for r in fusion.components(df, keeper(spark)).collect()} == brute_components(edges)


def test_chains_and_cycles(spark):
    df = spark.createDataFrame([(3, 2), (2, 1), (9, 3), (5, 4)], "id bigint, into bigint")
    assert {r.id: r["into"] for r in fusion.resolve_chains(df, keeper(spark)).collect()} == {3: 1, 2: 1, 9: 1, 5: 4}
    with pytest.raises(ValueError):
        fusion.resolve_chains(spark.createDataFrame([(1, 2), (2, 1)], "id bigint, into bigint"), keeper(spark), rounds=5)


def test_dbscan(spark):
    rows, df = points(spark, 250, 0.01, 5)
    near = {a[0]: {b[0] for b in rows if _hav(a, b) <= 60} for a in rows}
    cores = {i for i, n in near.items() if len(n) >= 4}
    comp = brute_components([(a, b) for a in cores for b in near[a] & cores])
    got = {r.id: (r.cluster, r.core) for r in cluster.dbscan(df, 60.0, 4, keeper(spark)).collect()}
    for i, (c, core) in got.items():
        assert core == (i in cores)
        assert c == comp[i] if core else (c is None) == (not near[i] & cores)


def _hav(a, b):
    la, lb = math.radians(a[1]), math.radians(b[1])
    x = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(x))


def test_hull_holds_all_points():
    r = random.Random(4)
    pts = [(r.random(), r.random()) for _ in range(200)]
    h = geo.hull(pts)
    assert set(h) <= set(pts)
    for (ax, ay), (bx, by) in zip(h, h[1:] + h[:1], strict=True):
        assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-12 for x, y in pts)


def test_lcs_against_definition():
    def slow(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(6)
    for _ in range(300):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(2))
        assert similarity.common_length(a, b) == slow(a, b)


def test_point_in_ring_concave(spark):
    ring = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (2.0, 2.0), (4.0, 0.0)]
    rows = [(1, 1.0, 2.0, True), (2, 3.0, 2.0, False), (3, 3.5, 3.7, True), (4, 5.0, 2.0, False)]
    df = spark.createDataFrame(rows, "id int, lat double, lng double, want boolean")
    got = df.select("want", geo.in_ring(F.col("lat"), F.col("lng"), geo.ring_literal(ring)).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_nulls_pass(spark):
    df = spark.createDataFrame([(None, None)], "a string, b string")
    a, b = F.col("a"), F.col("b")
    r = df.select(
        text.norm_name(a).alias("n"), text.phone_key(a).alias("p"), text.domain(a).alias("d"), text.address_key(a, b).alias("k"), text.clean_number(a).alias("c"), text.number_agrees(a, b).alias("g"),
        similarity.jaccard(a, b).alias("j"), values.money(a).alias("m"), values.date_of(a).alias("t"), text.declares_vacant(a).alias("v"), text.same_area(a, b).alias("s"), nested.opening_hours(a).alias("o"),
    ).first()
    assert (r.n, r.p, r.d, r.k, r.c, r.g, r.j, r.m, r.t, r.v, r.s, r.o) == (None, "", "", None, None, "no_number", 0.0, None, None, False, False, None)


def test_many_to_one_refuses_repeats(spark):
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError):
        joins.many_to_one(spark.range(2).withColumnRenamed("id", "k"), right, "k")


def test_requirements(spark):
    df = spark.range(5)
    assert changes.require(df, {"small": F.col("id") < 5}).count() == 5
    with pytest.raises(ValueError, match="small: 2"):
        changes.require(df, {"small": F.col("id") < 3})


def test_staged_load_keeps_the_old_rows_on_mismatch(spark, tmp_path):
    base = f"file://{tmp_path}"
    writers.load_staged(spark.range(3), f"{base}/s", f"{base}/t", 3)
    with pytest.raises(ValueError):
        writers.load_staged(spark.range(5), f"{base}/s", f"{base}/t", 4)
    assert spark.read.parquet(f"{base}/t").count() == 3


def test_guard(spark):
    n = spark.range(3)
    assert read_only(spark, "SELECT count(*) AS n FROM {n}", 10, n=n).first().n == 3
    with pytest.raises(PermissionError):
        read_only(spark, "DROP TABLE x", 10)
    with pytest.raises(PermissionError):
        read_only(spark, "CREATE TABLE x AS SELECT 1", 10)


def test_zipped_csv(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.csv", "k;v;w\n1;a\x00b;z\n2;;z\n")
        z.writestr("notes.md", "no")
    df = readers.read_zipped_csv(spark, f"file://{tmp_path}", ["k", "v"], rows_a_batch=1)
    assert sorted(map(tuple, df.collect())) == [("x.csv", "1", "ab"), ("x.csv", "2", None)]


def test_empty_tables(spark):
    p = spark.createDataFrame([], "id bigint, lat double, lng double")
    assert joins.within(p, p, 10.0).count() == 0
    assert joins.near_pairs(p, 0.001).count() == 0
    assert cluster.dbscan(p, 10.0, 3, keeper(spark)).count() == 0
    assert fusion.components(spark.createDataFrame([], "a bigint, b bigint"), keeper(spark)).count() == 0


def test_sniff():
    assert [readers.sniff(s) for s in ("a;b;c\n1;2;3", "a,b\n1,2", "a|b\n1|2")] == [";", ",", "|"]


def test_pairs_are_unordered(spark):
    rows, df = points(spark, 80, 0.004, 9)
    got = {(r.a, r.b) for r in joins.near_pairs(df, 0.001).collect()}
    cell = {i: (int(y / 0.001), int(x / 0.001)) for i, y, x in rows}
    want = {(i, j) for i, j in itertools.combinations(range(80), 2) if abs(cell[i][0] - cell[j][0]) <= 1 and abs(cell[i][1] - cell[j][1]) <= 1}
    assert got == want


def test_key_pairs_leave_no_group_out(spark):
    rows = [(i, "hot" if i < 120 else f"k{i % 9}" if i < 160 else f"one{i}", i % 5) for i in range(170)] + [(500, None, 0), (501, None, 0)]
    df = spark.createDataFrame(rows, "id bigint, k string, v int")
    want = sorted((a, b) for a, k, _ in rows for b, l, _ in rows if k is not None and k == l and a < b)
    for block in (7, 10_000):
        out = joins.key_pairs(df, ["k"], block, columns=["v"]).collect()
        assert sorted((r.a, r.b) for r in out) == want
        assert all(r.a_v == r.a % 5 and r.b_v == r.b % 5 for r in out)


def test_offset_blocks_leave_no_block_out(spark):
    rows = [(i, "7" if i % 4 else "8", float(i * 37 % 400), float(i * 53 % 300)) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, number string, x double, y double")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 <= 150)
    for cap in (3, 5000):
        assert sorted(map(tuple, joins.offset_block_pairs(df, 150.0, cap).collect())) == want


def test_decisions_do_not_depend_on_the_block(spark, monkeypatch):
    """A group over the block's size keeps its pairs: i01 asks for all, its SQL has no cap."""
    from geomill.plans import registry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    run = lambda: sorted(map(tuple, registry.queries()["i01_pair_decisions"](spark, sf).collect()))
    whole = run()
    pairs = joins.key_pairs
    monkeypatch.setattr(joins, "key_pairs", lambda rows, keys, **more: pairs(rows, keys, 1, **more))
    assert run() == whole


@pytest.mark.parametrize("name", ["h205_token_sort", "h206_token_set", "h207_best_of_three"])
def test_name_pairs_cover_the_table(spark, name):
    """The queries without SQL score every pair of a street, not one in ten."""
    from geomill.plans import registry
    from geomill.plans.inputs import Tables

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    rows = Tables(spark, sf).poi.select("id", "name", "street").collect()
    pairs = {(x.id, y.id): (x.name, y.name) for x in rows for y in rows if x.street == y.street and x.id < y.id}
    out = registry.queries()[name](spark, sf).collect()
    assert sorted((r.a, r.b) for r in out) == sorted(pairs)


def test_equivalences_cover_the_table(spark):
    from geomill.plans import registry
    from geomill.plans.inputs import Tables

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    at = {r.id: (r.lat, r.lng) for r in Tables(spark, sf).poi.select("id", "lat", "lng").collect()}

    def m(p, q):
        (a, b), (c, d) = [map(math.radians, x) for x in (p, q)]
        return 2 * 6371000 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    want = sorted((a, b, 2 if m(at[a], at[b]) <= 300 else 1) for a in at for b in at if a < b and a // 20 == b // 20 and a % 2 != b % 2)
    assert sorted(map(tuple, registry.queries()["k06_equivalences"](spark, sf).collect())) == want


def test_street_names(spark):
    from geomill.functions import text

    rows = ["Rua Rua Dr. Silva", "R. Silva Dr", "Dr Flores", "Rua Sete de Setembro", "Rua Sete Lagoas", "Av. Mar Azul (fundos)", "(x)", "Rua Dr", "Vila Nova", "rua vila nova", None, "Rua Gen. Cap. Mor"]
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, c string").select("id", text.contextual_street(F.col("c")).alias("s")).orderBy("id").collect()
    assert [(r.s.text, r.s.tier) for r in d][:10] == [("rua doutor silva", "high"), ("rua silva dr", "certain"), ("doutor flores", "high"), ("rua 7 de setembro", "high"), ("rua sete lagoas", "certain"), ("avenida mar azul", "review"), ("", "human"), ("rua dr", "certain"), ("vila nova", "certain"), ("rua vila nova", "certain")]
    assert d[11].s.text == "rua general cap mor"
    c = spark.createDataFrame([("VILA NOVA", "RUA"), ("Rua Vila Nova", "R."), ("Vila Nova", ""), ("Pça. Sto. Antônio", ""), ("A", "")], "c string, h string").select(text.canonical_street(F.col("c"), F.col("h")).alias("s")).collect()
    assert [(r.s.kind, r.s.base, r.s.status) for r in c] == [("rua", "vila nova", "valid"), ("rua", "vila nova", "valid"), ("vila", "nova", "valid"), ("praca", "santo antonio", "valid"), ("", "a", "short")]
