"""Source divergence by hash-consed trees, against the definition."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomill.llm import divergence
from geomill.llm.common import Stages

SCHEMA = "doc_id bigint, text string, lang string, source string"
UPPER = {i: i + 32 for i in range(65, 91)}
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(docs, ranks=200):
    df, tf, groups = {}, {}, set()
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        c = Counter(TERM.findall((text or "").translate(UPPER)))
        groups.add((lang, source))
        df.setdefault(lang, Counter()).update(c.keys())
        for g in ((lang, source), lang):
            tf.setdefault(g, Counter()).update(c)
    out = set()
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= 3]

        def p(g, kept=kept):
            n = sum(tf[g][t] for t in kept)
            return {t: 1 + 10**9 * (tf[g][t] + 1) // (n + len(kept)) for t in kept}

        mine, whole = p((lang, source)), p(lang)
        values = []
        for g, other in groups:
            if g == lang and other != source:
                q = p((g, other))
                values.append((other, sum((mine[t] - q[t]) ** 2 // q[t] for t in kept)))
        terms = [(t, (mine[t] - whole[t]) ** 2 // whole[t]) for t in kept if tf[lang, source][t] and mine[t] > whole[t]]
        for part, rows, most in (("pair", values, None), ("term", terms, ranks)):
            rows.sort(key=lambda r: (-r[1], r[0].encode()))
            out |= {(lang, source, part, item, value, k) for k, (item, value) in enumerate(rows[:most], 1)}
    return out


def corpus(seed, n, sources=7):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdéλ" for b in ("x", "Yy", "zé", "w", "q")] + [f"rare{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(len(words))]
    return [(i, r.choice([" ", "1", "_"]).join(r.choices(words, weights, k=r.randint(0, 60))), r.choice(["en", "en", "fr", None]), r.choice([None, *(f"s{k}" for k in range(sources))])) for i in range(n)]


def rows(out):
    got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("how", [{}, {"width": 10, "sources": 3}, {"ranks": 5}])
def test_equals_the_definition(spark, how):
    docs = corpus(1, 400) + [(900, None, "xx", "lone"), (901, "one two", "xx", "other"), (902, "", "yy", "s1")]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("term", F.lit("clash")).withColumn("n", F.lit(3)).repartition(5)
    got = rows(divergence.audit(df, Stages(spark), **how))
    assert got == brute(docs, **{k: v for k, v in how.items() if k == "ranks"})
    assert ("xx", "lone", "pair", "other", 0, 1) in got and not any(r[0] == "yy" for r in got)


def test_copies_and_edges(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 20)  # counts are handed on in pieces
    assert divergence.audit(spark.createDataFrame([], SCHEMA), Stages(spark)).count() == 0
    docs = [(1, "same words é", "en", "a")] * 50 + [(None, "other words", "en", "b"), (None, "z " * 40_000, "en", "b"), (3, "z z", "en", "c"), (3, "z", "en", "c")]
    assert rows(divergence.audit(spark.createDataFrame(docs, SCHEMA), Stages(spark))) == brute(docs)


def test_prices_are_exact():
    for c, t in ((0, 1), (10**14, 10**14 + 3), (123_456_789_012, 987_654_321_098_765 // 8), (7, 9)):
        assert divergence.prices(np.array([c]), np.array([t]))[0] == 1 + 10**9 * (c + 1) // t


def test_equal_subtrees_are_one_node_and_priced_once():
    leaves = np.zeros((2, 1024), np.int64)
    leaves[0, 5] = leaves[1, 700] = 3
    forest = divergence.Forest(leaves)
    assert [len(lo) for lo, _ in forest.levels] == [3] * 9 + [2]
    opened = []
    unique = np.unique
    try:
        np.unique = lambda *a, **k: (opened.append(1), unique(*a, **k))[1]
        there, back = forest.walk(np.array([0]), np.array([1]), np.array([1027]), np.array([1027]))
    finally:
        np.unique = unique
    p0, p3 = (1 + 10**9 * (c + 1) // 1027 for c in (0, 3))
    assert there[0] == (p3 - p0) ** 2 // p0 + (p0 - p3) ** 2 // p3 == back[0] and len(opened) == 10
