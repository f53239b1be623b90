"""Areas, ordered fusion, acronyms and assignment against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geomill.operators import areas, fusion, joins, names
from geomill.operators.stages import keeper

RING = "name string, ring array<struct<lat:double,lng:double>>"


def in_ring(y, x, ring):
    inside = False
    for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (a > y) != (c > y) and x < (d - b) * (y - a) / (c - a) + b:
            inside = not inside
    return inside


def star(r, lat, lng, size, corners):
    return [(lat + size * k * math.sin(2 * math.pi * i / corners), lng + size * k * math.cos(2 * math.pi * i / corners)) for i, k in enumerate(r.uniform(0.3, 1) for _ in range(corners))]


@pytest.mark.parametrize("small", [100_000, 0])
def test_points_in_rings_of_all_sizes(spark, small):
    """Stars from a block to a state, nested, touching and overlapping; joined with and without a broadcast."""
    r = random.Random(4)
    rings = {f"star{i}": star(r, r.uniform(-31, -29), r.uniform(-52, -50), 10 ** r.uniform(-3, 0.3), r.choice([3, 5, 12, 90])) for i in range(60)}
    rings |= {"left": [(-30, -51), (-30, -50.5), (-29, -50.5), (-29, -51)], "right": [(-30, -50.5), (-30, -50), (-29, -50), (-29, -50.5)], "nested": [(-29.6, -50.9), (-29.6, -50.8), (-29.5, -50.8), (-29.5, -50.9)]}
    rings |= {"line": [(-30, -51), (-29, -50)], "empty": [], "flat": [(-30, -51), (-29.5, -50.5), (-29, -50)]}
    points = [(i, r.uniform(-31.5, -28.5), r.uniform(-52.5, -49.5)) for i in range(1500)] + [(2000, None, -51.0), (2001, -29.5, -50.5), (2002, -30.0, -51.0), (2003, -29.0, -50.0)]
    for s in list(rings.values())[:60]:
        for _ in range(3):
            points.append((len(points) + 5000, s[0][0] + r.uniform(-1e-4, 1e-4), s[0][1] + r.uniform(-1e-4, 1e-4)))
    got = areas.points_in_polygons(spark.createDataFrame(points, "id long, lat double, lng double"), spark.createDataFrame([(k, [(float(a), float(b)) for a, b in v]) for k, v in rings.items()], RING), keeper(spark), small=small)
    got = [(x.id, x.name) for x in got.collect()]
    want = {(i, k) for i, y, x in points if y is not None for k, v in rings.items() if len(v) >= 3 and in_ring(y, x, v)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_cover_is_small_and_mostly_inner(spark):
    square = [("s", [(-30.0001, -51.0001), (-30.0001, -50.0003), (-29.0007, -50.0003), (-29.0007, -51.0001)]), ("tiny", [(-30.0, -51.0), (-30.0, -50.9999), (-29.9999, -50.9999)])]
    cells = areas.cover(spark.createDataFrame(square, RING)).collect()
    s = [c for c in cells if c.name == "s"]
    area = lambda k: sum((360 / 2**c.level) ** 2 for c in s if c.inner == k)
    assert len(cells) < 4000 and len({c.level for c in cells}) > 3 and area(True) > 0.9 and area(False) < 0.1
    none = areas.points_in_polygons(spark.createDataFrame([(1, 0.0, 0.0)], "id long, lat double, lng double"), spark.createDataFrame([], RING), keeper(spark))
    assert none.count() == 0 and none.columns == ["id", "name"]


# ---- fusion --------------------------------------------------------------------------------------
RECORD = "id long, place string, evidence int, source string, document string"


def loop(decisions, records, apart=False):
    rec = {r[0]: r for r in records}
    rank = lambda i: (not rec[i][1].startswith("ChIJ"), -rec[i][2], str(i))
    into, source, document = {}, {i: {r[3]} - {None} for i, r in rec.items()}, {i: {r[4]} - {None} for i, r in rec.items()}

    def root(i):
        while i in into:
            i = into[i]
        return i

    log = []
    for a, b, c in sorted(decisions, key=lambda d: (-d[2], d[0], d[1])):
        x, y = sorted((a, b), key=rank)
        x, y = root(x), root(y)
        if x == y or (apart and (source[x] & source[y] or len(document[x] | document[y]) > 1)):
            continue
        into[y] = x
        source[x] |= source[y]
        document[x] |= document[y]
        log.append((y, x, a, b, float(c)))
    return log, {i: root(i) for i in into}


def graph(seed, n=120, edges=160, sources=40):
    r = random.Random(seed)
    records = [(i, r.choice(["ChIJ" + str(i), f"osm:{i}"]), r.randint(0, 4), r.choice([None, *(f"s{k}" for k in range(sources))]), r.choice([None, None, None, "d1", "d2"])) for i in range(n)]
    pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range(edges)}
    return [(a, b, r.randint(1, 9)) for a, b in sorted(pairs)], records


def fused(spark, decisions, records, **how):
    keep = keeper(spark)
    log = fusion.fuse_in_order(spark.createDataFrame(decisions, "a long, b long, confidence int"), spark.createDataFrame(records, RECORD), keep, **how)
    return log, keep


@pytest.mark.parametrize("most", [20_000, 0])
@pytest.mark.parametrize("apart", [False, True])
def test_fusion_in_order(spark, most, apart):
    """Random graphs, in a task each and in rounds, with and without one record a source and different documents."""
    decisions, records = graph(3 + apart, n=80, edges=110)
    log, keep = fused(spark, decisions, records, most=most, **({"apart": ["source"], "same": ["document"]} if apart else {}))
    want, ends = loop(decisions, records, apart)
    assert sorted(map(tuple, log.collect())) == sorted(want)
    assert {r.id: r.into for r in fusion.destinations(log, keep).collect()} == ends
    assert not apart or len(want) < len(loop(decisions, records)[0])


def test_long_chains_reach_their_end(spark):
    """200 records, each absorbed by the next: every one ends in the last survivor; falling, rising and mixed confidence."""
    records = [(i, f"osm:{i}", i % 4, None, None) for i in range(600)]
    r = random.Random(1)
    decisions = [(i, i + 1, 1000 - i) for i in range(199)] + [(200 + i, 201 + i, i) for i in range(199)] + [(400 + i, 401 + i, r.randint(1, 5)) for i in range(199)]
    log, keep = fused(spark, decisions, records)
    want, ends = loop(decisions, records)
    assert sorted(map(tuple, log.collect())) == sorted(want)
    assert {r.id: r.into for r in fusion.destinations(log, keep).collect()} == ends and len(set(ends.values())) == 3


@pytest.mark.parametrize("apart", [False, True])
def test_withdrawn_decisions(spark, apart):
    decisions, records = graph(8, n=150, edges=130)
    how = {"apart": ["source"], "same": ["document"]} if apart else {}
    log, keep = fused(spark, decisions, records, **how)
    log = keep(log)
    gone = [d for d in decisions if (d[0] + d[1]) % 5 == 0] + [(999, 1000, 1)]
    d, rec = spark.createDataFrame(decisions, "a long, b long, confidence int"), spark.createDataFrame(records, RECORD)
    got = fusion.without(d, spark.createDataFrame(gone, "a long, b long, confidence int"), log, rec, keep, **how)
    want, _ = loop([x for x in decisions if x not in gone], records, apart)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sorted(map(tuple, fusion.without(d, d.limit(0), log, rec, keep, **how).collect())) == sorted(map(tuple, log.collect()))


def test_no_decisions(spark):
    log, keep = fused(spark, [], [(1, "x", 0, None, None)])
    assert log.count() == 0 and fusion.destinations(log, keep).count() == 0


# ---- names ---------------------------------------------------------------------------------------
def test_acronyms_confirm_and_never_establish(spark):
    rows = [
        (1, "k", "sm minimercado"), (2, "k", "minimercado super mago"), (3, "k", "rb consultoria"), (4, "k", "condominio reserva bosque"), (5, "k", "sbc mercado"), (6, "k", "mercado silva bom dia"),
        (7, "other", "sm minimercado"), (8, "k", "minimercado silva bazar mago"), (9, "k", "mercado ab"), (10, "k", "mercado a"), (11, "k", ""),
    ]
    df = spark.createDataFrame(rows, "id long, street string, name string").withColumn("words", F.filter(F.split("name", " "), lambda w: w != ""))
    weights = df.select(F.explode("words").alias("token")).distinct().withColumn("weight", F.length("token").cast("double"))
    got = {(r.a, r.b): (r.weight, r.shared, r.spelt) for r in names.weighted_overlap(df, weights, ["street"]).collect()}
    assert got[1, 2] == (11.0 + 5 + 4, ["minimercado"], ["mago", "super"])
    assert got[1, 8] == (11.0, ["minimercado"], []) and got[5, 6] == (7.0, ["mercado"], []) and got[9, 10] == (7.0, ["mercado"], [])
    assert (3, 4) not in got and not any(7 in k or 11 in k for k in got)


def test_initials_are_of_consecutive_words_at_their_first_place(spark):
    df = spark.createDataFrame([(1, ["aa", "bb", "ax", "bx", "cc"]), (2, ["z"]), (3, []), (4, None)], "id long, words array<string>")
    got = {(r.id, r.acronym): r.spelt for r in names.initials(df, []).collect()}
    want = {}
    w = ["aa", "bb", "ax", "bx", "cc"]
    for n in (2, 3, 4):
        for i in range(len(w) - n + 1):
            want.setdefault((1, "".join(t[0] for t in w[i : i + n])), w[i : i + n])
    assert got == want


# ---- assignment ----------------------------------------------------------------------------------
def test_assignment_of_long_chains_and_repeats(spark):
    chain = [((i + 1) // 2, i // 2, 1000.0 - i, 1.0) for i in range(300)]  # each proposal waits for the one before
    r = random.Random(2)
    tangled = [(r.randint(0, 40), r.randint(0, 40), float(r.randint(0, 4)), float(r.randint(0, 6))) for _ in range(400)]
    for proposals in (chain, tangled, []):
        a_used, b_used, want = set(), set(), []
        for s, m, a, b in sorted((-s, m, a, b) for a, b, s, m in proposals):
            if a not in a_used and b not in b_used:
                a_used.add(a)
                b_used.add(b)
                want.append((a, b, -s, m))
        got = joins.greedy_one_to_one(spark.createDataFrame(proposals, "a long, b long, strength double, m double"), keeper(spark)).collect()
        assert sorted(map(tuple, got)) == sorted(want)
