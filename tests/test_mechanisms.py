"""Map files, rings, regions over tile borders, address tags, audits and table functions against plain loops."""

import itertools
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomill.operators import audit, cluster, rings, tablefunctions, tagger
from geomill.operators.stages import keeper
from geomill.sources import maps


# ---- map files -----------------------------------------------------------------------------------
def elements(n):
    r = random.Random(7)
    word = lambda: r.choice(["rua", "ção", "", "x" * 40, "日本"])
    tags = lambda: {word() + str(i): word() for i in range(r.randint(0, 3))}
    nodes = [("node", r.choice([-1, 1]) * r.randint(0, 1 << 40) * 2 + i % 2, round(r.uniform(-90, 90), 7), round(r.uniform(-180, 180), 7), tags(), None, None) for i in range(n)]
    nodes = list({x[1]: x for x in nodes}.values())
    ways = [("way", i + 1, None, None, tags(), [r.randint(-(1 << 45), 1 << 45) for _ in range(r.randint(0, 20))], None) for i in range(n // 4)]
    relations = [("relation", i + 1, None, None, tags(), None, [(r.choice(maps.KINDS), r.randint(-9, 1 << 40), word()) for _ in range(r.randint(0, 9))]) for i in range(n // 8)]
    return nodes + ways + relations


def test_map_files_come_back_from_several_tasks(spark, tmp_path, monkeypatch):
    rows = elements(600)
    df = spark.createDataFrame(rows, maps.SCHEMA).repartition(3)
    assert maps.write_map(df, str(tmp_path / "m")) == len(rows)
    back = maps.read_map(spark, str(tmp_path / "m"), blob_bytes=2000)
    assert back.rdd.getNumPartitions() >= 3
    key = lambda r: (r[0], r[1])
    for x, y in zip(sorted(back.collect(), key=key), sorted(rows, key=key), strict=True):
        assert key(x) == key(y) and (x.lat, x.lng) == (pytest.approx(y[2], abs=1e-9), pytest.approx(y[3], abs=1e-9)) if y[2] is not None else x.lat is None
        assert dict(x.tags) == y[4] and x.refs == y[5] and (None if x.members is None else [tuple(m) for m in x.members]) == y[6]


def test_map_blocks_by_hand():
    """Single nodes, offsets and a granularity of their own, raw blobs, and what isn't a map file."""
    node = maps.put(1, maps.zigzag(-5)) + maps.put(8, maps.zigzag(10)) + maps.put(9, maps.zigzag(-20))
    data = maps.put(1, maps.put(1, b"")) + maps.put(2, maps.put(1, node)) + maps.put(17, 1000) + maps.put(19, 7) + maps.put(20, (1 << 64) - 9)
    (b,) = maps.block_rows(maps.inflate(maps.put(1, data)))
    row = b.to_pylist()[0]
    assert (row["id"], row["lat"], row["lng"]) == (-5, pytest.approx(10007e-9), pytest.approx(-20009e-9))
    numbers = [0, 1, 127, 128, 300, (1 << 63) - 1, (1 << 64) - 1]
    assert maps.varints(b"".join(map(maps.varint, numbers))).tolist() == numbers
    with pytest.raises(ValueError):
        maps.inflate(maps.put(7, b"lzma"))
    with pytest.raises(ValueError):
        dict(maps.fields(struct.pack("B", 3)))


@pytest.mark.parametrize("seed", [1, 2])
def test_rings_from_shuffled_ways(spark, seed):
    r = random.Random(seed)
    ways, want, number = [], {}, itertools.count(1)
    for area, sizes in enumerate([(3,), (40, 7), (2,), (1,), (25, 1, 2)]):
        for size in sizes:
            corners = [next(number) for _ in range(size * 3)]
            pieces = [corners[i * 3 : i * 3 + 4] if i < size - 1 else [*corners[i * 3 :], corners[0]] for i in range(size)]
            pieces = [p[::-1] if r.random() < 0.5 and size > 1 else p for p in pieces]
            want.setdefault(area, []).append(frozenset(map(frozenset, zip(corners, corners[1:] + corners[:1], strict=True))))
            ways += [(area, r.randint(0, 1 << 30), p) for p in pieces]
    chain = [next(number) for _ in range(30)]
    ways += [(0, 2 << 30 | i, chain[i : i + 2]) for i in range(29)] + [(9, 5, [1]), (9, 6, None)]  # open: no ring
    cross = [next(number) for _ in range(4)]
    ways += [(8, i, [cross[0], cross[i]]) for i in (1, 2, 3)]  # three ways meet
    r.shuffle(ways)
    got = {}
    for x in rings.assemble(spark.createDataFrame(ways, "area int, way long, refs array<long>"), keeper(spark)).collect():
        assert x.refs[0] == x.refs[-1]
        got.setdefault(x.area, []).append(frozenset(map(frozenset, zip(x.refs, x.refs[1:], strict=False))))
    assert {k: sorted(map(sorted, map(lambda s: map(sorted, s), v))) for k, v in got.items()} == {k: sorted(map(sorted, map(lambda s: map(sorted, s), v))) for k, v in want.items()}


# ---- regions -------------------------------------------------------------------------------------
def test_regions_over_four_tiles(spark):
    r = random.Random(3)
    on = {(r.randint(-20, 20), r.randint(-20, 20)) for _ in range(900)} | {(y, 30) for y in range(-20, 20)} | {(0, x) for x in range(30, 50)}
    label = {}
    for start in sorted(on):
        if start not in label:
            todo = [start]
            while todo:
                p = todo.pop()
                if p in on and p not in label:
                    label[p] = start
                    todo += [(p[0] + a, p[1] + b) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))]
    df = spark.createDataFrame(sorted(on) * 2, "y int, x int")
    for side in (7, 64):
        got = {(x.y, x.x): (x.region.y, x.region.x) for x in cluster.plane_regions(df, keeper(spark), side).collect()}
        assert got == label
    assert cluster.plane_regions(df.limit(0), keeper(spark)).count() == 0


# ---- tagger --------------------------------------------------------------------------------------
def test_viterbi_is_the_best_of_all_paths():
    r = np.random.default_rng(1)
    for n in (0, 1, 4):
        score, step = r.normal(size=(n, 3)), r.normal(size=(4, 3))
        total = lambda p: sum(score[i, k] for i, k in enumerate(p)) + sum(step[a, b] for a, b in zip([3, *p], p, strict=False))  # noqa: B023, E731
        assert tagger.viterbi(score, step) == list(max(itertools.product(range(3), repeat=n), key=total))


def test_tags_of_held_out_addresses(spark):
    r = random.Random(5)
    name = lambda: "".join(r.choice(["ba", "ce", "di", "fo", "gu", "la", "mi", "no"]) for _ in range(3)).title()
    rows = [(i, f"{r.choice(['Rua', 'Avenida', 'Travessa', 'Alameda'])} {name()} {name()}", str(r.randint(1, 3000)), f"Jardim {name()}", f"Porto {name()}", r.choice(["RS", "SC"]), f"{r.randint(10000, 99999)}-{r.randint(100, 999)}") for i in range(900)]
    rows += [(2000, None, "5", "A b", "C d", "RS", "90000-000"), (2001, "", "", "", "", "", "")]
    data = tagger.composed(spark.createDataFrame(rows, "id long, street string, number string, area string, city string, state string, postcode string"))
    held = F.crc32(F.col("id").cast("string")) % 5 == 0
    model = tagger.learn(data.filter(~held), sample=500)
    truth = {x.id: (x.words, x.tags) for x in data.filter(held).collect()}
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, ",, ,"), (-4, "rua " * 3000)], "id long, address string")
    got = {x.id: x for x in tagger.tag(data.filter(held).select("id", "address").unionByName(extra), model).collect()}
    hits = [a == b for i, (w, t) in truth.items() for a, b in zip(got[i].tags, t, strict=True)]
    assert all(got[i].words == w for i, (w, _) in truth.items()) and len(hits) > 1000
    assert np.mean(hits) > 0.97, np.mean(hits)
    assert got[-1].words == [] and got[-1].street is None and got[-2].tags == [] and len(got[-4].tags) == 3000
    again = tagger.learn(data.filter(~held).repartition(7), sample=500)
    assert np.array_equal(again[0], model[0])


# ---- audit ---------------------------------------------------------------------------------------
def test_differences_and_untouched_leaves(spark):
    old = [(i, f"g{i % 3}", None if i % 11 == 0 else i % 7, i * 0.5) for i in range(4000)]
    new = [list(x) for x in old if x[0] % 701 != 0] + [[9000 + i, "n", 1, 0.0] for i in range(3)]
    for x in new:
        if x[0] in (5, 22, 1234):
            x[2] = 99 if x[2] is None else None
        if x[0] in (7, 1234):
            x[3] += 1
    a, b = (spark.createDataFrame([tuple(x) for x in v], "id long, g string, n int, x double") for v in (old, new))
    got = {(r.id, r.event, tuple(r.changed)) for r in audit.differences(a, b, ["id", "g"], ["n", "x"], keeper(spark)).collect()}
    want = {(i, "REMOVED", ()) for i in range(0, 4000, 701)} | {(9000 + i, "ADDED", ()) for i in range(3)} | {(5, "CHANGED", ("n",)), (22, "CHANGED", ("n",)), (7, "CHANGED", ("x",)), (1234, "CHANGED", ("n", "x"))}
    assert got == want
    keep = keeper(spark)
    trees = [keep(audit.digest(d, ["id", "g"], ["n", "x"])) for d in (a, b, a.repartition(9))]
    assert audit.differing(trees[0], trees[2]).count() == 0 and 1 <= audit.differing(trees[0], trees[1]).count() <= len(want)
    assert audit.differences(a, a.repartition(5), ["id", "g"], ["n", "x"], keep).count() == 0
    assert audit.differences(a.limit(0), a.limit(2), ["id", "g"], ["n", "x"], keep).count() == 2


def test_metrics_within_tolerance(spark):
    m = lambda rows: spark.createDataFrame(rows, "metric string, value double")
    out = audit.within_tolerance(m([("a", 100.0), ("b", 10.0), ("c", 1.0), ("z", 0.0)]), m([("a", 101.0), ("b", 10.2), ("d", 1.0), ("z", 0.0)]), {"a": 0.01}, 0.01)
    assert {r.metric: r.verdict for r in out.collect()} == {"a": "OK", "b": "OFF", "c": "MISSING", "d": "NEW", "z": "OK"}


# ---- table functions -----------------------------------------------------------------------------
def test_number_runs(spark):
    tablefunctions.register(spark)
    rows = [("a", 1), ("a", 3), ("a", 9), ("a", 9), ("a", None), ("b", 4), (None, 1), (None, 2)]
    doors = spark.createDataFrame(rows, "street string, number long")
    got = spark.sql("SELECT * FROM number_runs(TABLE(SELECT number, street FROM {doors}), 2)", doors=doors).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("a", 1, 3, 2), ("a", 9, 9, 2), ("b", 4, 4, 1), (None, 1, 2, 2)], key=repr)
    for bad in ("SELECT * FROM number_runs(TABLE(SELECT number FROM {doors}), 2)", "SELECT * FROM number_runs(TABLE(SELECT * FROM {doors}), -1)"):
        with pytest.raises(Exception, match="number_runs|step"):
            spark.sql(bad, doors=doors).collect()
