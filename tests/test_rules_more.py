"""Gaps, block profiles, verdicts and write checks at their edges."""

import datetime

from pyspark.sql import functions as F

from geomill.operators import blocks, changes, fusion, gaps, verdicts
from geomill.streaming import flows


def test_unit_gaps_at_their_bounds(spark):
    rows = [("two", 101), ("two", 103)]  # fewer than three
    rows += [("a", u) for u in (101, 102, 104, 105, 201, 202)]  # 103 within, 203 nowhere seen, 204 two and 205 three beyond
    rows += [("b", u) for u in (101, 102, 301, 302)]  # the second floor is absent
    rows += [("far", u) for u in (101, 102, 601, 602)]  # four floors absent: neighbours lack
    rows += [("sparse", u) for u in (101, 202, 303, 404, 505, 606, 707, 808)] + [(None, 101), ("a", None), ("a", 101)]
    got = {(r.building, r.unit): (r.kind, r.grade, r.steps) for r in gaps.unit_gaps(spark.createDataFrame(rows, "building string, unit long")).collect()}
    assert got == {("a", 204): ("C", "PLAUSIVEL", 2), ("a", 205): ("C", "ESPECULATIVA", 3), ("b", 201): ("B", "SUSTENTADA", None), ("b", 202): ("B", "SUSTENTADA", None)}
    assert gaps.unit_gaps(spark.createDataFrame([("a", 101), ("a", 103), ("a", 202), ("a", 201), ("a", 203)], "building string, unit long")).collect()[0][:3] == ("a", 102, "A")
    assert gaps.unit_gaps(spark.createDataFrame([], "building string, unit long")).count() == 0


def test_position_gaps(spark):
    rows = [("d", ["Fundos"], False), ("e", ["FRENTE"], False), ("e", [], True), ("f", ["FRT"], True), ("f", None, None), ("both", ["FRENTE"], False), ("both", ["FDS"], False), ("none", [], False), ("side", ["DIR", "FRENTE"], False)]
    got = {(r.address, r.missing): (r.kind, r.grade) for r in gaps.position_gaps(spark.createDataFrame(rows, "address string, positions array<string>, described boolean")).collect()}
    assert got == {("d", "FRENTE"): ("D", "SUSTENTADA"), ("e", "FUNDOS"): ("E", "PLAUSIVEL"), ("f", "FUNDOS"): ("F", "ESPECULATIVA"), ("side", "FUNDOS"): ("D", "SUSTENTADA"), ("side", "LADO ESQUERDO"): ("D", "SUSTENTADA")}


def test_block_lot_gaps(spark):
    rows = [(1, "1", "3", "7"), (1, "3", "5", None), (1, "x", "9", None), (1, "1", "4", None), (1, "1", "6", "1"), (2, "1", "1", "1"), (2, "100", "1", "2"), (2, None, "x", None)]
    got = {tuple(r) for r in gaps.block_lot_gaps(spark.createDataFrame(rows, "address int, block string, lot string, house string")).collect()}
    assert got == {(1, None, None, "block", 2), (1, "1", None, "lot", 5)}


def test_block_profile(spark):
    schema = "id long, key string, collective string, is_collective boolean, block string, block_kind string, floor string, unit string, house string, use string, number int, street string, lat double, lng double, establishments string"
    rows = [
        (2, "k", "c", True, "A", "", "1", "101", "", "RESIDENCIAL", 5, "second", 1.0, 3.0, "x"), (1, "k", "c", True, "A", None, "1", "102", "", "VAGO", 5, "first", 3.0, 3.0, "4"), (3, "k", "c", True, None, "TORRE", "", None, "1", "LAZER", 5, "s", None, None, None),
        (4, "k", "c", False, "A", "", "9", "9", "9", "VAGO", 5, "s", 0.0, 0.0, "9"), (5, "k", "c", True, "A", "BLOCO", "2", "101", None, "BELEZA_ESTETICA", 5, "s", 2.0, 0.0, "3"), (6, "z", "d", True, "A", "", "1", "1", "1", "SAUDE", 0, "s", 0.0, 0.0, "1"),
    ]
    got = {r.block: r for r in blocks.block_profile(spark.createDataFrame(rows, schema)).collect()}
    a, rest = got["A"], got["-"]
    assert (a.street, a.block_kind, a.n, a.n_floors, a.n_units, a.n_houses, a.n_residential, a.n_commercial, a.n_vacant, a.lat, a.most_declared, a.total, a.n_blocks) == ("first", "BLOCO", 3, 2, 2, 0, 1, 1, 1, 2.0, 4.0, 4, 1)
    assert (rest.block_kind, rest.n, rest.n_other, rest.n_houses, rest.lat) == ("TORRE", 1, 1, 1, None) and len(got) == 2


def test_final_verdicts(spark):
    today, day = F.lit("2026-01-01").cast("date"), datetime.date
    cited = [(k, p, None) for k, p in (("ok", 1), ("dup", 9), ("dup2", 9), ("old", 2), ("one", 3), ("strong", 4), ("post", 5), ("church", 6), ("hand", 1 + 10), ("gone", 7))] + [("bad", 8, "not_listed")]
    connections = [(k, q, light, gone, use) for k, q, light, gone, use in (
        ("ok", "SIM", True, False, "loja"), ("dup", "SIM", False, False, None), ("dup2", "SIM", False, False, None), ("old", "SIM", False, False, None), ("one", "SIM", True, False, None), ("strong", "SIM", True, None, None),
        ("post", "SIM", True, False, "bar"), ("church", "SIM", True, False, "uma Igreja"), ("hand", "SIM_COM_ANALISE_HUMANA", False, False, None), ("gone", "SIM", True, True, None), ("bad", "SIM", True, False, None), ("none", "SIM", False, False, None))]
    recent, old = day(2025, 6, 1), day(2022, 1, 1)
    proofs = [(1, "a", "register", recent), (1, "b", "register", recent), (2, "a", "review", old), (2, "w", "web", recent), (3, "a", "register", recent), (4, "a", "street_photo", None), (5, "s", "social", recent), (6, "s", "social", recent), (11, "a", "photo", recent), (7, "a", "register", recent), (7, "b", "register", recent), (9, "a", "register", recent)]
    out = verdicts.final_verdicts(
        spark.createDataFrame(cited, "connection string, poi int, reason string"), spark.createDataFrame(connections, "connection string, qualification string, light boolean, abandoned boolean, use string"),
        spark.createDataFrame(proofs, "poi int, source string, kind string, day date"), today)
    assert {r.connection: r.why for r in out.collect()} == {
        "ok": None, "dup": "in_doubt", "dup2": "in_doubt", "old": "no_recent_proof", "one": "one_source", "strong": None, "post": None, "church": "one_source", "hand": "qualification", "gone": "abandoned", "bad": "no_record", "none": "no_record"}


def test_writes_and_upserts(spark):
    rows = spark.createDataFrame([(1, "a", None, "p"), (1, "a", "x", "p"), (2, None, "y", "p"), (3, "c", " ", "q"), (4, "d", None, "none")], "id int, name string, city string, postcode string")
    lookup = spark.createDataFrame([("p", "P"), ("q", "Q")], "postcode string, city string")
    good, bad = changes.fill_or_reject(rows, {}, lookup, "postcode", ["name", "city"], ["id"])
    assert sorted((r.id, r.city) for r in good.collect()) == [(1, "P"), (3, "Q")] and sorted((r.id, r.reason) for r in bad.collect()) == [(1, "repeats"), (2, "lacks name"), (4, "lacks city")]
    links = lambda v: spark.createDataFrame(v, "poi int, source string, source_id string, confidence int, name string")
    got = fusion.link_sources(links([(1, "s", "k", 5, "old"), (2, "s", "k", 5, "")]), links([(1, "s", "k", 5, "new"), (1, "s", "k", 9, ""), (2, "s", "k", 1, "z"), (3, "t", "k", 1, None)]))
    assert {(r.poi, r.confidence, r.name) for r in got.collect()} == {(1, 9, "old"), (2, 5, "z"), (3, 1, None)}


def test_fresh_claimed_and_delivered(spark):
    now = spark.createDataFrame([("a",)] * 10 + [("b",)] * 20 + [("n",)], "k string")
    ledger = spark.createDataFrame([("a", 10, 1), ("b", 20, 1), ("b", 10, 2), ("g", 5, 1)], "k string, rows long, at int")
    assert {r.k: r.verdict for r in changes.freshness(now, ledger, "k", 0.1).collect()} == {"a": "FRESH", "b": "STALE", "n": "NEW", "g": "GONE"}
    jobs = spark.createDataFrame([(i, "k" if i % 2 else "o", "queued" if i < 8 else "done", 100 - i // 2, None) for i in range(10)], "id int, kind string, state string, created_at int, worker string")
    first = flows.claim(jobs, ["k"], 2, "w1")
    second = flows.claim(first, ["k"], 9, "w2")
    assert {r.id: r.worker for r in second.collect() if r.worker} == {7: "w1", 5: "w1", 3: "w2", 1: "w2"}
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, None)], "k int, v string")
    out = changes.delivery_checks(rows, "k", {"v": F.col("v").isNotNull()}, ["k", "z"], {"v": rows.filter("v <> 'c'").select("v")}, {"rows": 4, "most": 9}, {"rows": F.count("*"), "most": F.max("k")})
    assert {r.rule: r.broken for r in out.collect()} == {"column k": 0, "column z": 1, "key k": 2, "v": 1, "parent v": 1, "manifest rows": 0, "manifest most": 1}
