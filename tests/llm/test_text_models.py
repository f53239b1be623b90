"""Language ID, toxicity, quality model: gradients, held-out accuracy, edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geomill.llm import language_id, quality_lm, toxicity
from geomill.llm.common import Stages

SYLLABLES = {"en": "th er on an re he in ed nd ha at en es of or nt ea ti to it".split(), "de": "sch ein ich der und gen ung ver ber ten ö ü ß ach".split(), "fr": "eau oi ré é què tion ent les ou ai ç".split()}


def invented(lang, n, r):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def check_gradients(model, step, names):
    """Compare some gradients with finite differences."""
    r = np.random.default_rng(0)
    for k in model.p:
        model.p[k] = model.p[k].astype(np.float64)
    _, g = step()
    for k in names:
        for _ in range(3):
            at = tuple(int(r.integers(0, s)) for s in model.p[k].shape)
            old, eps = model.p[k][at], 1e-5
            model.p[k][at] = old + eps
            up, _ = step()
            model.p[k][at] = old - eps
            down, _ = step()
            model.p[k][at] = old
            assert (up - down) / (2 * eps) == pytest.approx(g[k][at], rel=2e-2, abs=2e-5), k


def test_cnn_gradients():
    m = language_id.ByteCNN(["a", "b", "c"], 1)
    r = np.random.default_rng(2)
    x, y = r.integers(0, 256, (6, language_id.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])
    check_gradients(m, lambda: m.step(x, y), ["W", "c", "b", "C2", "C3", "C4"])


def test_gru_gradients():
    r = np.random.default_rng(3)
    m = toxicity.Network({f"w{i}": 0.1 * i for i in range(10)}, r.normal(0, 1, toxicity.BUCKETS).astype(np.float32), 1)
    word, grams = r.integers(0, 11, (5, toxicity.SPAN)), r.integers(0, toxicity.BUCKETS, (5, toxicity.SPAN, 4))
    there = np.ones((5, toxicity.SPAN))
    there[0, 10:] = 0
    there[1] = 0
    y = np.array([1.0, 0, 1, 0, 1])
    check_gradients(m, lambda: m.step(word, grams, there, y), ["Wf", "Wb", "Uf", "Ub", "bf", "bb", "Wa", "ba", "va", "wo", "bo"])


def test_tables_equal_the_network():
    m = language_id.ByteCNN(["a", "b"], 4)
    r = random.Random(1)
    texts = [invented("en", n, r) for n in (1, 3, 40, 200)]
    best, score, _ = language_id.scorer(m, 4)(pa.array(texts))
    for t, s in zip(texts, score, strict=True):
        raw = np.frombuffer(t.encode(), np.uint8)
        total = np.zeros(2)
        for lo in range(0, len(raw), language_id.WINDOW):
            x = np.zeros(language_id.WINDOW, np.uint8)
            part = raw[lo : lo + language_id.WINDOW]
            x[: len(part)] = part
            e, h = m.p["E"][x], []
            for w in language_id.WIDTHS:
                z = np.stack([e[i : i + w].reshape(-1) @ m.p[f"C{w}"] for i in range(language_id.PLACES)])
                h.append(z.max(0))
            o = np.maximum(np.concatenate(h) + m.p["b"], 0) @ m.p["W"] + m.p["c"]
            o = np.exp(o - o.max())
            total += o / o.sum() * len(part)
        assert s == pytest.approx((total / len(raw)).max(), abs=1e-4)


def test_language_accuracy_and_edges(spark):
    r = random.Random(5)
    rows = [(i, invented(lang, r.randint(5, 120), r), lang, "x") for i, lang in enumerate(["en", "de", "fr"] * 120)]
    rows += [(1000, None, "en", "x"), (1001, "", None, "x"), (1002, "123 ...", "de", "x"), (1003, invented("en", 20_000, r), "en", "x"), (None, invented("de", 50, r), None, None), (7, rows[7][1], rows[7][2], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    m = language_id.learn(language_id.training_rows(df), 200, 4)
    out = language_id.identify(df, m).collect()
    assert len(out) == len(rows)
    held = [x for x in out if x.doc_id is not None and x.doc_id < 1000]
    assert sum(x.lang_pred == x.lang for x in held) / len(held) > 0.97
    by = {x.doc_id: x for x in out}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[1003].lang_pred == "en" and by[None].lang_pred == "de"
    assert language_id.identify(df.limit(0), m).count() == 0
    none = language_id.learn(language_id.training_rows(df.limit(0)))
    assert {x.lang_pred for x in language_id.identify(df.limit(5), none).collect()} == {"und"}


def test_toxicity_accuracy_and_edges(spark):
    r = random.Random(6)
    docs, labels = [], []
    for i in range(700):
        lang = r.choice(["en", "de"])
        words = invented(lang, r.randint(20, 200), r).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["moron", "idiot"]) if lang == "en" else "zqx" + r.choice(SYLLABLES["de"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    d, y = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    net = toxicity.learn(d, y)
    extra = [(2000, None), (2001, ""), (2002, "..."), (None, "the in on"), (2003, "zqx" + "ung" * 400), (2004, invented("en", 30_000, r)), (1, docs[1][1])]
    out = toxicity.score_texts(d.unionByName(spark.createDataFrame(extra, d.schema)), net).collect()
    assert len(out) == 707 and all(0 <= x.score <= 1 for x in out)
    truth = dict(labels)
    known = [x for x in out if x.doc_id in truth]
    assert sum((x.score >= 0.5) == truth[x.doc_id] for x in known) / len(known) > 0.95
    by = {x.doc_id: x.score for x in out}
    assert by[2000] == by[2001] == by[2002] < 0.5
    assert toxicity.score_texts(d.limit(0), net).count() == 0
    assert toxicity.learn(d, y.filter("toxic = 0")) is None
    assert toxicity.score_texts(d.limit(3), None).filter("score = 0").count() == 3


def test_score_equals_the_definition():
    """The fast forward pass against the network written as plain loops over one window."""
    h, span = toxicity.HIDDEN, toxicity.SPAN
    net = toxicity.fit([(i, ("idiot " if i % 2 else "nice ") + invented("en", 30, random.Random(i)), i % 2) for i in range(60)], 1, 1)
    p, sig = net.p, lambda x: 1 / (1 + np.exp(-x))
    for n in (1, 5, span):
        words = invented("de", n, random.Random(n)).split()[:n]
        vec = []
        for w in words:
            grams = toxicity.ngram_ids([w])[0]
            vec.append(np.concatenate([p["word"][net.ids.get(w, 0)], p["char"][np.unique(grams)].max(0)]).astype(float))
        states = np.zeros((n, 2 * h))
        for d, lo, order in (("f", 0, range(n)), ("b", h, range(n - 1, -1, -1))):
            s, u = np.zeros(h), p[f"U{d}"].astype(float)
            for t in order:
                g = vec[t] @ p[f"W{d}"] + p[f"b{d}"]
                z, r = sig(g[:h] + s @ u[:, :h]), sig(g[h : 2 * h] + s @ u[:, h : 2 * h])
                s = (1 - z) * s + z * np.tanh(g[2 * h :] + (r * s) @ u[:, 2 * h :])
                states[t, lo : lo + h] = s
        a = np.exp([np.tanh(x @ p["Wa"] + p["ba"]) @ p["va"] for x in states])
        want = sig((a[:, None] * states).sum(0) / a.sum() @ p["wo"] + p["bo"])[0]
        gates = np.zeros((span, 1, 6 * h), np.float32)
        gates[:n, 0] = net.inputs(words)
        there = (np.arange(span) < n).astype(np.float32)[:, None]
        assert net.score(gates, there)[0] == pytest.approx(want, abs=1e-4)


def test_all_windows_count():
    """A text's score is the largest over windows that start every STEP tokens and one that ends with it."""
    net = toxicity.fit([(i, ("idiot " if i % 2 else "nice ") + invented("en", 30, random.Random(i)), i % 2) for i in range(60)], 1, 1)
    s, r = toxicity.Scorer(net), random.Random(8)
    for n in (1, 23, 24, 25, 36, 37, 100):
        words = invented("en", n, r).split()[:n]
        starts = sorted({*range(0, max(1, len(words) - toxicity.SPAN + 1), toxicity.STEP), max(0, len(words) - toxicity.SPAN)})
        want = max(s.scores([" ".join(words[i : i + toxicity.SPAN])])[0] for i in starts)
        assert s.scores([" ".join(words)])[0] == pytest.approx(want, abs=1e-6)


def brute_kneser_ney(trusted, text):
    """log probabilities of a text's bytes, straight from the definition."""
    order = quality_lm.ORDER
    grams = [{} for _ in range(order + 1)]
    for t in trusted:
        p = b"\0" * (order - 1) + t
        for i in range(len(t)):
            g = p[i : i + order]
            grams[order][g] = grams[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        for g in grams[k + 1]:
            grams[k][g[1:]] = grams[k].get(g[1:], 0) + 1
    d = {}
    for k in range(1, order + 1):
        n = [sum(c == i for c in grams[k].values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        x = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        d[k] = [min(max(v, 0.05), i + 0.95) for i, v in enumerate(x)]

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / 256
        after = [c for h, c in grams[k].items() if h[:-1] == g[:-1]]
        if not after:
            return p(g[1:])
        cut = lambda c: d[k][min(c, 3) - 1]
        c = grams[k].get(g, 0)
        return (c - cut(c) if c else 0) / sum(after) + sum(map(cut, after)) / sum(after) * p(g[1:])

    padded = b"\0" * (order - 1) + text
    return [np.log(p(padded[i : i + order])) for i in range(len(text))]


def test_quality_against_definition(spark):
    r = random.Random(9)
    docs = [(i, "en", invented("en", 12, r)) for i in range(12)] + [(20, "fr", invented("fr", 10, r)), (21, None, "Zz9 é"), (22, "en", None), (23, "en", ""), (24, "de", "ung"), (3, "en", "same id")]
    df = spark.createDataFrame(docs, "doc_id bigint, lang string, text string")
    trusted = spark.createDataFrame([(i,) for i in (*range(8), 20)], "doc_id bigint")
    out = quality_lm.classify(df, trusted, Stages(spark)).collect()
    assert len(out) == len(docs)
    held = {i for i in (*range(8), 20) if zlib.crc32(str(i).encode()) % quality_lm.HELD == 0}
    assert held == {i for i in held if i < 8} and {x.doc_id for x in out if x.held} == held
    own = {"en": [t.encode() for i, g, t in docs if i < 8 and i not in held], "fr": [docs[12][2].encode()]}
    own["*"] = own["en"] + own["fr"]
    text = {(i, len((t or "").encode())): (g, t) for i, g, t in docs}
    for x in out:
        lang, t = text[x.doc_id, x.n_bytes]
        if not t:
            assert x.perplexity is None and not x.kept
            continue
        logs = brute_kneser_ney(own.get(lang, own["*"]), t.encode())
        assert x.perplexity == pytest.approx(np.exp(-np.mean(logs)), rel=1e-4)
    by = {}
    for x in out:
        if x.held or (not held and x.trusted):
            by.setdefault(x.lang, []).append(x.perplexity)
    for x in out:
        if x.lang == "en" and by:
            assert x.threshold == max(by["en"])
            assert x.kept == (x.n_bytes > 0 and x.perplexity <= x.threshold)
    assert quality_lm.classify(df.limit(0), trusted, Stages(spark)).count() == 0
    untrained = quality_lm.classify(df, trusted.limit(0), Stages(spark))
    assert untrained.filter(F.col("perplexity").isNotNull()).count() == 0 and untrained.filter("kept").count() == len(docs) - 2


def test_quality_survives_other_file_splits(spark, tmp_path):
    """Blocks are numbered once: files that are split otherwise after the first pass give the same result."""
    r = random.Random(2)
    path = f"file://{tmp_path}/docs"
    docs = [(i, ("en", "fr", "de")[i % 3], invented(("en", "fr", "de")[i % 3], r.randint(5, 60), r)) for i in range(90)]
    spark.createDataFrame(docs, "doc_id bigint, lang string, text string").repartition(9).write.parquet(path)
    trusted = spark.createDataFrame([(i,) for i in range(0, 90, 2)], "doc_id bigint")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    class Moved(Stages):
        def keep(self, df, name="t"):
            out = super().keep(df, name)
            if name == "grams":
                spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
            return out

    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
        want = {x.doc_id: x.perplexity for x in quality_lm.classify(spark.read.parquet(path), trusted, Stages(spark)).collect()}
        got = {x.doc_id: x.perplexity for x in quality_lm.classify(spark.read.parquet(path), trusted, Moved(spark)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == pytest.approx(want, rel=1e-5)


@pytest.mark.parametrize("pairs", [3, 3000])
def test_lookup_refuses_absent_grams(pairs):
    code = np.arange(pairs, dtype=np.uint32) * np.uint32(65537) + np.uint32(7)
    look = quality_lm.Lookup(code, np.linspace(-2, -1, pairs).astype(np.float32))
    assert (look.dense is None) == (pairs == 3000)
    assert look(code[::-1]).tolist() == np.linspace(-2, -1, pairs).astype(np.float32)[::-1].tolist()
    for absent in (0, 8, 2**32 - 1):
        with pytest.raises(KeyError):
            look(np.array([code[0], absent], np.uint32))
