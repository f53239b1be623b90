"""Near-dedup, mixing, nearest neighbours, licenses, pipeline."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomill.llm import ann, license_scan, mixing, near_dedup
from geomill.llm.common import Stages
from geomill.llm.components import components


def shingles(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({b" ".join(w)} if w else set())


def brute_groups(docs, percent):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed, groups=12, copies=14):
    r, docs = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{r.randint(0, 5000)}" for _ in range(r.choice([4, 5, 6, 9, 30, 80, 300]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = f"x{r.randint(0, 9)}"
            docs.append((len(docs), (r.choice([" ", "\n"])).join(w).upper() if r.random() < 0.2 else " ".join(w)))
    return docs


@pytest.mark.parametrize(("seed", "percent"), [(1, 85), (2, 80)])
def test_near_dedup(spark, seed, percent):
    docs = near_copies(seed) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "one two"), (9004, "One  two"), (9005, "É   b"), (9006, "é   b")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("rep", F.lit("clash"))
    out = near_dedup.link(df, Stages(spark), percent).collect()
    want = brute_groups(docs, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_dedup_edges(spark):
    schema = "doc_id bigint, text string"
    assert near_dedup.link(spark.createDataFrame([], schema), Stages(spark)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, "a b c d e f"), (4, "z " * 40_000)]
    out = near_dedup.link(spark.createDataFrame(rows, schema), Stages(spark)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (3, 1, False), (4, 4, True)]


def test_index_is_shuffled_once_and_wide_tables_go(spark, monkeypatch):
    kept, keep, stages = [], Stages.keep, Stages(spark)
    monkeypatch.setattr(Stages, "keep", lambda self, df, name="t": kept.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or keep(self, df, name))
    docs = spark.createDataFrame(near_copies(5), "doc_id bigint, text string")
    out = near_dedup.link(docs, stages, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute_groups(near_copies(5), 85)
    of = [(name, p.count("MapInArrow"), "Join" in p, "Aggregate" in p) for name, p in kept if "place#" in p and "MapInArrow" in p]
    assert of == [("hits", 1, False, False)]  # keys are made by one plan, which joins nothing
    folder = spark.sparkContext._jvm.java.io.File(stages.root.removeprefix("file://"))
    left = {str(f).split("-", 1)[1] for f in folder.list()}
    assert "signed" not in left and "full" not in left and {"rows", "classes"} <= left


def test_repeated_ids_with_other_texts(spark):
    """Every text of a repeated id links; none is taken by chance."""
    r = random.Random(5)
    a, b = ([f"{k}{r.randint(0, 9999)}" for _ in range(60)] for k in "ab")
    rows = [(7, " ".join(a)), (7, " ".join(b)), (8, " ".join([*a[:-1], "x"])), (9, " ".join([*b[:-1], "y"])), (7, " ".join(a).upper()), (20, "alone and by itself it stands here")]
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, "doc_id bigint, text string").withColumn("rep", F.lit(1)).repartition(3)
        out = near_dedup.link(df, Stages(spark)).collect()
        assert sorted((x.doc_id, x.component_id) for x in out) == [(7, 7), (7, 7), (7, 7), (8, 7), (9, 7), (20, 20)]
        stay = near_dedup.one_of_each(df, Stages(spark)).collect()  # rows are documents: both texts of id 7 stay, copies go
        assert sorted((x.doc_id, x.text) for x in stay) == sorted([(7, " ".join(a).upper()), (7, " ".join(b)), (20, rows[5][1])])
        assert stay[0].rep == 1


def test_one_of_each_edges(spark):
    schema = "doc_id bigint, text string, n int"
    assert near_dedup.one_of_each(spark.createDataFrame([], schema), Stages(spark)).count() == 0
    rows = [(None, "a b c d e f", 1), (None, "a b c d e f", 2), (3, None, 3), (3, None, 3), (4, "", 4), (5, "a b c d e f", 5), (6, "a b c d e f", 6)]
    out = near_dedup.one_of_each(spark.createDataFrame(rows, schema), Stages(spark)).collect()
    assert sorted((r.n for r in out)) == [1, 2, 3, 4, 5]


def test_pigeonhole_covers_the_distance():
    """Signatures that differ in at most d places always share a key."""
    r = np.random.default_rng(1)
    for percent in (85, 80):
        parts = near_dedup.chunks(percent)
        places = parts[-1][1]
        d = near_dedup.over(places, 1 - percent / 100)
        assert 2 * len(parts) > d
        for _ in range(200):
            a = r.integers(0, 1 << 32, (1, near_dedup.INDEX)).astype(np.uint64)
            b = a.copy()
            b[0, r.choice(places, d, replace=False)] += np.uint64(1)
            assert set(near_dedup.index_keys(a, parts)[0]) & set(near_dedup.index_keys(b, parts)[0])


def test_components(spark):
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(100, i) for i in range(101, 130)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), Stages(spark)).collect()}
    assert got == {i: i - i % 20 for i in range(60)} | {i: 100 for i in range(100, 130)}


def test_targets():
    sizes = {"a": 100, "b": 10, "c": 1000, None: 0}
    t = mixing.targets_of(sizes)
    assert sum(t.values()) == pytest.approx(1.5 * 1110) and all(t[s] <= 2 * n + 1e-9 for s, n in sizes.items())
    assert t["a"] == 200 and t["b"] == 20 and t[None] == 0


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(r.choice([0, 1, 3, 50]))), r.choice(["s1", "s2", "S3", None])) for i in range(300)]
    rows += [(None, "a b c", "s1"), (5, rows[5][1], rows[5][2]), (400, None, "s2"), (401, "x " * 20_000, "é")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("key", F.lit(1))
    out = mixing.mix_documents(df, Stages(spark)).collect()
    again = mixing.mix_documents(df, Stages(spark)).collect()
    assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, again))
    assert all(0 <= x.taken <= 2 * x.size for x in out)
    for s in {x.source for x in out}:
        mine = [x for x in out if x.source == s]
        assert sum(x.size for x in mine) == mine[0].source_size
        assert abs(sum(x.taken for x in mine) - mine[0].target) < 1
    assert mixing.mix_documents(df.limit(0), Stages(spark)).count() == 0


def test_first_words(spark):
    df = spark.createDataFrame([("  a  b\nc ", 2), ("x", 1), ("p q " * 9000, 12_345)], "text string, n bigint")
    out = [r[0] for r in df.select(mixing.first_words(F.col("text"), F.col("n"))).collect()]
    assert out[:2] == ["  a  b", "x"] and len(out[2].split()) == 12_345


def brute_nearest(rows, top):
    good = {i: np.array(v) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(good))
    x = np.stack([good[i] for i in ids]).astype(np.float32).astype(float)
    out = {}
    for q in ids[ids % 20 == 0]:
        s = x @ x[np.searchsorted(ids, q)]
        keep = ids != q
        out[q] = [int(i) for i in ids[keep][np.lexsort((ids[keep], -s[keep]))][:top]]
    return out


def test_nearest(spark):
    r = np.random.default_rng(7)
    centres = r.normal(size=(12, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + 0.6 * r.normal(size=16)]) for i in range(3000)]
    rows += [(3000 + i, rows[40][1]) for i in range(300)]  # one very common vector
    rows += [(4000, None), (4001, [0.0] * 16), (4002, [None] + [1.0] * 15), (4020, [float("nan")] * 16), (None, rows[1][1]), (4040, [1.0, 2.0]), (4060, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("id", F.lit("clash"))
    found = ann.search(df, Stages(spark), lambda c: c % 20 == 0).collect()
    want = brute_nearest(rows, 20)
    got = {}
    for x in sorted(found, key=lambda x: (x.query_id, x.rank)):
        got.setdefault(x.query_id, []).append(x.vec_id)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    recall = np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want])
    assert recall >= 0.95
    assert all(q not in v for q, v in got.items())


@pytest.mark.parametrize("kind", ["long", "norms"])
def test_nearest_at_any_length(spark, kind):
    """One very long vector, or lengths over six orders of magnitude, don't make the others look alike."""
    r = np.random.default_rng(3)
    n = 4000
    x = r.normal(size=(n, 32))
    if kind == "long":
        x[7] *= 1e4
    else:
        x *= 10 ** r.uniform(-3, 3, n)[:, None]
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {}
    for h in ann.search(df, Stages(spark), lambda c: c % 20 == 0).collect():
        got.setdefault(h.query_id, set()).add(h.vec_id)
    x = x.astype(float)
    hit = []
    for q in range(0, n, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit.append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(hit) >= 0.95 and min(hit) >= 0.7


@pytest.mark.parametrize(("size", "lengths"), [(40, (1, 2)), (20, (1, 2, 8)), (200, (1, 2))])
def test_nearest_among_islands(spark, size, lengths):
    """Tight clusters, smaller and larger than K, in several lengths: the graph falls apart, and a query's nearest lie on another island."""
    r = np.random.default_rng(size)
    n = max(1, 5600 // (size * len(lengths)))
    at = r.normal(size=(n, 32))
    at /= np.linalg.norm(at, axis=1)[:, None]
    x = np.concatenate([k * (np.repeat(at, size, 0) + 0.02 * r.normal(size=(n * size, 32))) for k in lengths]).astype(np.float32)
    x = x[r.permutation(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {}
    for h in ann.search(df, Stages(spark), lambda c: c % 20 == 0).collect():
        got.setdefault(h.query_id, set()).add(h.vec_id)
    x, hit = x.astype(float), {}
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit.setdefault(round(np.linalg.norm(x[q])), []).append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert all(np.mean(v) >= 0.97 and min(v) >= 0.8 for v in hit.values())


def test_shards_and_descent(spark):
    """Shards span a factor of four; descent mends lists that begin at random and ends by itself."""
    nodes = spark.createDataFrame([(1.0,), (1.1,), (3.9,), (1e-200,), (1e200,)], "length double")
    tops = ann.shards_of(nodes)
    assert tops == sorted(tops, reverse=True) and len(tops) == 3
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 8))
    vecs = ann.halves(spark.createDataFrame([(i, v.tolist(), float(np.linalg.norm(v))) for i, v in enumerate(x)], "id bigint, embedding array<double>, length double"), [int(np.floor(np.log2(np.linalg.norm(x, axis=1).max()) * ann.STEPS))])
    start = [(i, r.choice([j for j in range(600) if j != i], ann.K, replace=False).tolist(), [-1.0] * ann.K, [True] * ann.K) for i in range(600)]
    graph, stages = spark.createDataFrame(start, ann.LISTS), Stages(spark)
    for k in range(6):
        graph = stages.keep(ann.descend(graph, vecs.filter("true"), 2, k), "graph")
    rows = {v.id: np.frombuffer(v.vec, np.float16).astype(np.float32) for v in vecs.collect()}
    m = ann.matrix([rows[i].astype(np.float16).tobytes() for i in range(600)])
    s = m @ m.T
    np.fill_diagonal(s, -np.inf)
    want = {i: set(np.argsort(-s[i])[: ann.K].tolist()) for i in range(600)}
    assert np.mean([len(want[g.u] & set(g.vs)) / ann.K for g in graph.collect()]) > 0.9


def test_nearest_small_and_empty(spark):
    schema = "vec_id bigint, embedding array<float>"
    few = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], schema)
    out = ann.search(few, Stages(spark), lambda c: c % 20 == 0).orderBy("rank").collect()
    assert [(x.vec_id, x.score) for x in out] == [(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)]
    assert ann.search(few.limit(0), Stages(spark), lambda c: c % 20 == 0).count() == 0
    assert ann.search(few.filter("vec_id = 0"), Stages(spark), lambda c: c % 20 == 0).count() == 0


def test_rising_and_alignment():
    r = random.Random(11)
    for _ in range(200):
        v = r.sample(range(30), r.randint(0, 12))
        best = 0
        for mask in range(1 << len(v)):
            pick = [x for i, x in enumerate(v) if mask >> i & 1]
            best = max(best, len(pick) if pick == sorted(pick) else 0)
        got = [v[i] for i in license_scan.rising(v)]
        assert len(got) == best and got == sorted(got)
    text = "x y Permission is hereby granted free of cost charge to any any person z".lower().split()
    tmpl = "permission is hereby granted free of charge to any person obtaining".split()
    pairs = license_scan.align(text, tmpl)
    assert all(text[i] == tmpl[j] for i, j in pairs) and len(pairs) == 10
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:], strict=False))


def test_windows_are_bounded_without_loss():
    """The sliding bound is the multiset's, the bits' length is the subsequence's, and hard texts are read in little time."""
    r = random.Random(6)
    template = [r.choice("abcdefgh") for _ in range(20)]
    counts, places = Counter(template), license_scan.places_of(template)
    words = [r.choice("abcdefghxyz") for _ in range(300)]
    got = license_scan.overlaps(words, counts, 34)
    for i in range(300):
        window = words[i : i + 34]
        assert got[i] == sum((Counter(window) & counts).values())
        t = np.zeros((len(window) + 1, 21), int)
        for a, x in enumerate(window, 1):
            for b, y in enumerate(template, 1):
                t[a, b] = t[a - 1, b - 1] + 1 if x == y else max(t[a - 1, b], t[a, b - 1])
        assert license_scan.common_length(window, places, 20) == t[-1, -1]
    scanner = license_scan.Scanner()
    mit = scanner.templates["MIT"]
    for hard in ([r.choice(mit) for _ in range(40_000)], [w for _ in range(200) for w in r.sample(mit, len(mit))]):
        began = time.process_time()
        assert not [f for f in scanner.scan(" ".join(hard)) if f.license == "MIT"]
        assert time.process_time() - began < 30  # by aligning every window: minutes
    assert [f.coverage for f in scanner.scan(" ".join([*hard[:3000], *mit, *hard[3000:6000]])) if f.license == "MIT"] == [1.0]


def plain_alignment(a, b):
    """Length of the patience alignment of two word lists, by the definition and without speed."""
    n = 0
    while a and b and a[0] == b[0]:
        a, b, n = a[1:], b[1:], n + 1
    while a and b and a[-1] == b[-1]:
        a, b, n = a[:-1], b[:-1], n + 1
    shared = [w for w in b if a.count(w) == 1 and b.count(w) == 1]
    if not shared:
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return n + int(t[-1, -1])
    anchors = [shared[i] for i in license_scan.rising([a.index(w) for w in shared])]
    for w in anchors:
        i, j = a.index(w), b.index(w)
        n += 1 + plain_alignment(a[:i], b[:j])
        a, b = a[i + 1 :], b[j + 1 :]
    return n + plain_alignment(a, b)


def test_scan_against_every_window(spark):
    """The best coverage at any place of a text, tried word by word without passing windows over."""
    r = random.Random(21)
    templates = {k: license_scan.TEMPLATES[k] for k in ("MIT-notice", "CC-BY-4.0-notice", "MPL-2.0")}
    words = {k: license_scan.words_of(v) for k, v in templates.items()}
    texts = [""]
    for _ in range(60):
        t = [r.choice("the a of under license this work is".split()) for _ in range(r.randint(0, 25))]
        k = r.choice(list(templates))
        body = [w if r.random() > 0.12 else r.choice(["x", "license", ""]) for w in words[k]]
        at = r.randint(0, len(t))
        texts.append(" ".join(t[:at] + body + t[at:]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = {x.doc_id: x.found for x in license_scan.scan_licenses(df, templates).collect()}
    for i, t in enumerate(texts):
        w = license_scan.words_of(t)
        for k, m in words.items():
            best = max([plain_alignment(w[p : p + len(m) + len(m) // 2 + 4], m) / len(m) for p in range(len(w))], default=0)
            mine = max([f.coverage for f in out[i] if f.license == k], default=0)
            assert (best >= 0.8) == (mine > 0) and mine <= best + 1e-6


@pytest.mark.parametrize("name", ["MIT", "Apache-2.0", "GPL-3.0", "BSD-2-Clause"])
def test_license_without_anchors(name):
    """No word of the window is unique in text and template, so one large gap is aligned."""
    words = license_scan.words_of(license_scan.TEMPLATES[name])
    once = sorted({w for w in words if words.count(w) == 1} - {words[0]})  # the changed word would be an anchor itself
    text = " ".join(["changed", *words[1:], *once])
    assert any(f.license == name and f.coverage > 0.97 for f in license_scan.Scanner().scan(text))


def test_licenses(spark):
    mit, apache = license_scan.TEMPLATES["MIT-notice"], license_scan.TEMPLATES["Apache-2.0"]
    broken = " ".join(w for i, w in enumerate(license_scan.TEMPLATES["GPL-3.0"].split()) if i % 12)
    rows = [(1, f"the the {mit} and {mit}"), (2, None), (3, ""), (4, "under the license of nothing"), (5, ("filler " * 20_000) + apache + " end"), (6, "licence " + broken), (None, mit.upper())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("license", F.lit(3))
    out = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert out[1].n_licenses == 2 and out[1].license == "MIT-notice" and out[1].coverage == 1
    assert [out[i].n_licenses for i in (2, 3, 4)] == [0, 0, 0]
    assert out[5].license in ("Apache-2.0", "Apache-2.0-notice") and any(f.license == "Apache-2.0" and f.coverage == 1 and f.first_word == 20_000 for f in out[5].found)
    assert out[6].license == "GPL-3.0" and 0.85 < out[6].coverage < 1
    assert out[None].license == "MIT-notice"
    assert license_scan.scan_licenses(df.limit(0)).count() == 0
    assert license_scan.finds(license_scan.scan_licenses(df)).filter("doc_id = 1").count() == 2


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import hashlib
    import os

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    stages, docs = Stages(spark), spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, f in corpus_pipeline.STAGES:
        before = docs
        docs = stages.keep(f(spark, docs, sf), name)
        seen[name] = (before.collect(), docs.collect())
        if name != "encode":
            assert docs.columns == columns
    for name in ("language", "toxicity"):
        before, after = seen[name]
        assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len(after) > 0.7 * len(before)
    before, after = seen["near_dedup"]
    want = {c for _, c in brute_groups([(r.doc_id, r.text) for r in before], 80).values()}
    assert sorted(r.doc_id for r in after) == sorted(want)
    before, after = seen["mix"]
    sizes = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").encode().split())
    goal = mixing.targets_of(sizes)
    for s in sizes:
        assert abs(sum(len(r.text.encode().split()) for r in after if r.source == s) - goal[s]) < 1
    texts = {r.doc_id: r.text for r in before}
    assert all(texts[r.doc_id].startswith(r.text) for r in after)
    before, after = seen["encode"]
    assert sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in before) == sorted(r.decoded_sha256 for r in after)
    assert corpus_pipeline.run(spark, sf).count() == len(after)


def test_pipeline_takes_nulls_and_nothing(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = f"file://{tmp_path}"
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, None, None, None, None), (None, "the cat sat on the mat today", None, None, None), (3, "", "en", "s", 0), (4, "der Hund und die Katze", "de", None, 5), (4, "der Hund und die Katze", "de", None, 5), (5, "the dog and the bird", "en", "s", 20), (None, None, "en", "s", 1)]
    rows += [(i, f"the dog {i} and the bird on the tree sang" if i % 2 else f"der Hund {i} und die Katze im Haus", "en" if i % 2 else "de", "s", 9) for i in range(10, 30)]
    for some in (rows, rows[:4], []):
        spark.createDataFrame(some, schema).write.mode("overwrite").parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{sf}/labels.parquet")
        n = corpus_pipeline.run(spark, sf).count()
        assert n > 0 if len(some) > 4 else n < 10
        assert some or n == 0


def test_mix_survives_other_file_splits(spark, tmp_path):
    """The plan and the texts meet by stored numbers, so a later scan may split the files otherwise."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    path, r = f"file://{tmp_path}/docs", random.Random(4)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(r.randint(1, 60))), "en", f"s{i % 3}", 0) for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(12).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        out = corpus_pipeline.mix(spark, spark.read.parquet(path), "")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # as if executors had come or gone
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    sizes = {s: sum(len(t.split()) for _, t, _, x, _ in rows if x == s) for s in ("s0", "s1", "s2")}
    for s, goal in mixing.targets_of(sizes).items():
        assert abs(sum(len(x.text.split()) for x in got if x.source == s) - goal) < 1
