"""Ranked search over the stratified index, against scoring every document."""

import random
import re
from collections import Counter
from math import floor, log

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from geomill.llm import lexical
from geomill.llm.common import Stages

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"
UPPER = {i: i + 32 for i in range(65, 91)}
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute(docs, items, k=10):
    bags = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    bags = [(i, c) for i, c in bags if c]
    n, total = len(bags), sum(c.total() for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(UPPER)))
        scored = []
        for i, c in bags:
            m = 25 + (75 * c.total() * n) // total
            s = sum(k_ * floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, k_ in asked.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        for r, (s, null, i) in enumerate(sorted(scored)[:k], 1):
            out.append((item, r, None if null else i, -s))
    return sorted(out, key=repr)


def corpus(seed, n, words=400):
    r = random.Random(seed)
    zipf = [f"w{i}" for i in range(words)] + ["Été", "λόγος", "7", "A1"]
    weights = [1 / (i + 1) for i in range(len(zipf))]
    docs = [(i, r.choice([" ", "-", "\n", " "]).join(r.choices(zipf, weights, k=int(2 ** r.uniform(0, 8))))) for i in range(n)]
    return docs, [(i, " ".join(r.choices(zipf, weights, k=r.randint(1, 30)))) for i in range(20)]


@pytest.mark.parametrize(("seed", "k"), [(1, 10), (2, 3)])
def test_equals_scoring_every_document(spark, seed, k):
    docs, items = corpus(seed, 500)
    docs += [(1000 + i, docs[7][1]) for i in range(300)] + [(2000, items[0][1]), (2001, "x " + items[1][1])]
    df = spark.createDataFrame(docs, DOCS).withColumn("m", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    out = lexical.search(lexical.build(df, Stages(spark)), spark.createDataFrame(items, ITEMS), Stages(spark), k=k)
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in out.collect()), key=repr) == brute(docs, items, k)


def test_small_blocks_waves_and_batches(spark, monkeypatch):
    """Blocks of three documents, waves of one stratum, four queries at once: the same rows."""
    for name, value in {"BLOCK_DOCS": 3, "FIRST": 1, "GROWTH": 3, "QUERIES_AT_ONCE": 4}.items():
        monkeypatch.setattr(lexical, name, value)
    docs, items = corpus(5, 200)
    index = lexical.build(spark.createDataFrame(docs, DOCS), Stages(spark))
    out = lexical.search(index, spark.createDataFrame(items[:6], ITEMS), Stages(spark))
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in out.collect()), key=repr) == brute(docs, items[:6])


def test_index_holds_every_posting_in_strata(spark):
    docs, _ = corpus(3, 120)
    index = lexical.build(spark.createDataFrame(docs, DOCS), Stages(spark))
    got, ids = {}, lexical.Ids()
    for b in index.blocks.collect():
        assert all(b.docs[i] < b.docs[i + 1] for i in range(len(b.docs) - 1))
        for i, t in enumerate(b.terms):
            assert b.tfs[b.heads[i] : b.heads[i + 1]] == sorted(b.tfs[b.heads[i] : b.heads[i + 1]], reverse=True)
            for g in range(b.heads[i], b.heads[i + 1]):
                for p in b.places[b.starts[g] : b.starts[g + 1]]:
                    got[b.docs[p], t] = b.tfs[g], b.m
    bags = {i: Counter(TERM.findall(t.translate(UPPER))) for i, t in docs}
    total = sum(c.total() for c in bags.values())
    assert (index.n, index.total) == (len(docs), total)
    assert got == {(i, ids[t.encode()]): (tf, 25 + 75 * c.total() * len(docs) // total) for i, c in bags.items() for t, tf in c.items()}


def test_edges(spark):
    none, item = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b")], ITEMS)
    assert lexical.search(lexical.build(none, Stages(spark)), item, Stages(spark)).count() == 0
    docs = [(1, None), (2, ""), (3, "--"), (None, "a c"), (4, "a c"), (4, "a c"), (5, "A c"), (6, "b " * 60_000), (7, "x" * 100_000)]
    df = spark.createDataFrame(docs, DOCS)
    assert lexical.search(lexical.build(df, Stages(spark)), spark.createDataFrame([], ITEMS), Stages(spark)).count() == 0
    items = [(1, "a"), (1, "b b"), (2, None), (3, ""), (4, "zzz"), (None, "X" * 100_000)]
    out = lexical.search(lexical.build(df, Stages(spark)), spark.createDataFrame(items, ITEMS), Stages(spark)).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in out), key=repr) == brute(docs, items)


def test_blocks_are_read_one_at_a_time(spark, monkeypatch):
    """However many blocks a file has, neither the reader nor a row group holds them all at once; the session's settings come back."""
    read, rows = "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch"
    files = getattr(lexical, "FILES", {}) | {"parquet.block.size": 4096}
    monkeypatch.setattr(lexical, "FILES", files, raising=False)
    seen = {}

    class Seen(Stages):
        def keep(self, df, name="t", **options):
            seen[name] = int(spark.conf.get(read)), int(spark.conf.get(rows))
            return super().keep(df, name, **options)

    docs, items = corpus(9, 400)
    before = spark.conf.get(read)
    index = lexical.build(spark.createDataFrame(docs, DOCS), Seen(spark))
    out = lexical.search(index, spark.createDataFrame(items, ITEMS), Seen(spark))
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in out.collect()), key=repr) == brute(docs, items)
    assert seen["index"][0] <= 256 and seen["tops"] == seen["scored"] == (1, 1) and spark.conf.get(read) == before
    metas = [pq.read_metadata(f.removeprefix("file:")) for f in index.blocks.inputFiles()]
    assert sum(m.num_rows for m in metas) > 100
    assert max(m.row_group(g).num_rows for m in metas for g in range(m.num_row_groups)) < 20


def test_tasks_get_equal_postings(spark, monkeypatch):
    """The longest documents and many documents of one length are dealt over tasks by postings, not by rows."""
    monkeypatch.setattr(lexical, "PART_POSTINGS", 5000)
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 1250)
    docs = [(i, f"a{i}") for i in range(4000)] + [(4000 + i, " ".join(f"w{j}" for j in range(200 + i))) for i in range(100)] + [(5000 + i, " ".join(f"v{j}" for j in range(100))) for i in range(200)]
    index = lexical.build(spark.createDataFrame(docs, DOCS).repartition(4), Stages(spark))
    files = [sum(len(b.places) for b in rows) for rows in _by_file(index)]
    assert sum(files) == 4000 + sum(range(200, 300)) + 20_000
    assert len(files) >= 10 and max(files) < 3 * 5000


def _by_file(index):
    files = {}
    for r in index.blocks.select("places", F.input_file_name().alias("f")).collect():
        files.setdefault(r.f, []).append(r)
    return files.values()
