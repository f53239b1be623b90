"""Shards by vector bin packing."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from geomill.llm import sharding
from geomill.llm.common import Stages

SCHEMA = "doc_id bigint, text string"


def texts(seed, n):
    r = random.Random(seed)
    return [(i, " ".join(f"w{r.randint(0, 999)}é" for _ in range(int(2 ** r.uniform(0, 9))))) for i in range(n)]


def check_rows(rows, docs, shards=16):
    """Every row once, with its own size and checksum; slots without gaps; the sums of each shard."""
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs
    )
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert {r.shard for r in rows} <= set(range(shards))
    return np.array([[sum(getattr(r, c) for r in rows if r.shard == s) for c in ("size", "n_words")] + [sum(r.shard == s for r in rows)] for s in range(shards)], float)


def test_place_is_the_greedy_rule():
    r = np.random.default_rng(3)
    v, residual, w = r.random((300, 3)), np.full((16, 3), 10.0), np.array([8.0, 1, 1])
    got, free = sharding.place(v, residual.copy(), w), residual.tolist()
    for x, s in zip(v, got, strict=True):
        dots = [sum(f[k] * x[k] * w[k] for k in range(3)) for f in free]
        assert dots[s] >= max(dots) - 1e-9
        free[s] = [f - y for f, y in zip(free[s], x, strict=True)]


def test_balanced_in_one_bin_and_in_waves(spark):
    docs = texts(1, 3000)
    df = spark.createDataFrame(docs, SCHEMA).withColumn("shard", F.lit("clash")).withColumn("load", F.lit(0))
    for per_bin in (8192, 100):  # 100: three waves of several bins
        rows = sharding.shard_documents(df, Stages(spark), per_bin=per_bin).collect()
        sums = check_rows(rows, docs)
        assert (sums.max(0) / sums.mean(0) < 1.02).all() and (sums.min(0) / sums.mean(0) > 0.98).all()
        assert {r.doc_id: r.text for r in rows} == dict(docs) and rows[0].load == 0
    again = sharding.shard_documents(df.repartition(5), Stages(spark), per_bin=100).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in again) == sorted((r.doc_id, r.shard, r.slot) for r in rows)


def test_groups_stay_whole_unless_beyond_a_shard(spark):
    r = random.Random(2)
    base = texts(4, 600)
    copies = [(1000 + i, r.choice(base[:40])[1]) for i in range(900)]
    hot = [(5000 + i, "the same words again") for i in range(1200)]
    docs = base + copies + hot
    rows = sharding.shard_documents(spark.createDataFrame(docs, SCHEMA), Stages(spark)).collect()
    sums = check_rows(rows, docs)
    assert sums[:, 0].max() / sums[:, 0].mean() < 1.05 and sums[:, 2].max() / sums[:, 2].mean() < 1.3
    text, where, loads = dict(docs), {}, {}
    for x in rows:
        where.setdefault(text[x.doc_id], set()).add(x.shard)
        loads[text[x.doc_id]] = loads.get(text[x.doc_id], 0) + np.array([x.size, x.n_words, 1])
    beyond = {t for t, v in loads.items() if (v / sums.sum(0)).max() > 1 / 16}
    assert "the same words again" in beyond and len(beyond) < 10
    assert {t for t, s in where.items() if len(s) > 1} == beyond


def test_edges(spark):
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA), Stages(spark)).count() == 0
    docs = [(1, None), (1, ""), (None, "a b"), (None, "a b"), (2, "z " * 50_000), (2, "z " * 50_000), (3, "x")]
    rows = sharding.shard_documents(spark.createDataFrame(docs, SCHEMA), Stages(spark), drop=True).collect()
    check_rows(rows, docs)
    same = [(7, "one text")] * 640  # one id, one text: rows are dealt all the same
    sums = check_rows(sharding.shard_documents(spark.createDataFrame(same, SCHEMA), Stages(spark)).collect(), same)
    assert sums[:, 2].max() - sums[:, 2].min() <= 6


def test_written_shards(spark, tmp_path):
    docs = texts(9, 200)
    sharding.write_shards(spark.createDataFrame(docs, SCHEMA), str(tmp_path / "out"), Stages(spark), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.doc_id: r.text for r in back.collect()} == dict(docs)
    one = [r.slot for r in spark.read.parquet(str(tmp_path / "out" / "shard=2")).collect()]
    assert one == list(range(len(one)))
