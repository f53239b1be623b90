"""Streaming, queues and events (M): streams run once over what is there and are read back."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomill.operators.stages import folder
from geomill.streaming import flows

from .inputs import Tables
from .registry import both, query


#: Rows of a file of the stream, on average, where there are enough.
ROWS_A_FILE = 100_000


def stream(t: Tables) -> DataFrame:
    """The events as a file stream: written to the shared folder in four steps of time, so that there are several batches."""
    path = folder(t.spark)
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    cuts = [None, *events.select(at.cast("double").alias("at")).approxQuantile("at", [0.25, 0.5, 0.75], 0.01), None]
    step = lambda lo, hi: (F.lit(True) if lo is None else at >= F.lit(int(lo))) & (F.lit(True) if hi is None else at < F.lit(int(hi)))
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    sizes = events.agg(*[F.count(F.when(step(*s), 1)).alias(f"n{i}") for i, s in enumerate(spans)]).first()
    # each step has as many files, none of them empty, so a batch is a step and no row of it is late
    files = max(1, min(min(sizes) // ROWS_A_FILE, t.spark.sparkContext.defaultParallelism))
    for s in spans:  # one after the other, as a stream takes older files first
        events.filter(step(*s)).repartition(files).write.mode("append").parquet(path)
    return flows.file_stream(t.spark, path, events.schema, files_a_trigger=files)


def drained(t: Tables, df: DataFrame, mode: str) -> DataFrame:
    """Run a stream to the end of its input into Parquet, and read that."""
    out, mark = folder(t.spark), folder(t.spark)
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
    else:
        q = df.writeStream.foreachBatch(lambda b, i: b.withColumn("_batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/b={i}")).option("checkpointLocation", mark).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(df.schema if mode == "append" else T.StructType(df.schema.fields + [T.StructField("_batch", T.IntegerType())])).option("recursiveFileLookup", True).parquet(out)


both("m01_next_jobs", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') ORDER BY ts, event_id LIMIT 20")


@query("m02_requeue", "SELECT event_id AS id, CASE WHEN event_type = 'click' AND ts + INTERVAL 600 SECOND < TIMESTAMP '2024-01-15 00:00:00' THEN 'queued' WHEN event_type = 'click' THEN 'running' ELSE 'done' END AS state FROM events")
def m02(t: Tables) -> DataFrame:
    jobs = t.events.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "running").otherwise("done").alias("state"), F.col("ts").alias("seen_at"))
    return flows.requeue(jobs, "2024-01-15 00:00:00", 600).select("id", "state")


@query("m02_overdue_stream", "WITH j AS (SELECT user_id * 100 + (event_type = 'click')::INT AS job, ts::DATE AS day, ts FROM events), k AS (SELECT job * 1000 + date_diff('day', DATE '2024-01-01', day) AS job, max(ts) AS ts FROM j GROUP BY 1) SELECT job::BIGINT AS job, date_trunc('milliseconds', ts)::TIMESTAMP AS last_seen FROM k WHERE ts + INTERVAL 6 HOUR < (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def m02b(t: Tables) -> DataFrame:
    # a job is what a user does on a day, by clicks or otherwise; its beats end with the day
    job = (F.col("user_id").cast("bigint") * 100 + (F.col("event_type") == "click").cast("int")) * 1000 + F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return flows.overdue(t.spark, stream(t).withColumn("job", job), folder(t.spark), folder(t.spark), "job", "ts", 6 * 3600, "10 minutes")


@query("m03_ready_tasks", "SELECT event_id AS id FROM events e WHERE event_type = 'view' AND event_id > 3 AND NOT EXISTS (SELECT 1 FROM events n WHERE n.event_id IN (e.event_id - 1, e.event_id - 2) AND n.event_type <> 'click')")
def m03(t: Tables) -> DataFrame:
    e = t.events
    tasks = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "done").when((F.col("event_type") == "view") & (F.col("event_id") > 3), "waiting").otherwise("other").alias("state"))
    needs = e.filter("event_id > 3").select(F.col("event_id").alias("id"), F.explode(F.array(F.col("event_id") - 1, F.col("event_id") - 2)).alias("needs"))
    return flows.ready_tasks(tasks, needs)


@query("m04_expired_leases", "SELECT event_id FROM events WHERE ts + INTERVAL 3600 SECOND < TIMESTAMP '2024-01-10 00:00:00'")
def m04(t: Tables) -> DataFrame:
    leases = t.events.select("event_id", F.date_trunc("second", "ts").alias("taken_at"))
    return flows.expired_leases(leases, "2024-01-10 00:00:00", 3600).select("event_id")


@query("m05_fan_out", "SELECT event_id, o.origin AS target FROM events e JOIN (VALUES (0), (1), (2)) AS o(origin) ON o.origin <> e.event_id % 3")
def m05(t: Tables) -> DataFrame:
    e = t.events.select("event_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("target"))
    return e.filter(F.col("target") != F.col("event_id") % 3)


@query("m07_incremental_upsert", "SELECT user_id, count(DISTINCT event_type) AS kinds, max(event_id) AS last FROM events GROUP BY user_id")
def m07(t: Tables) -> DataFrame:
    out, mark = folder(t.spark), folder(t.spark)
    combine = lambda d: d.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    rows = stream(t).select("user_id", "event_type", "event_id")
    flows.log_sink(rows, mark, out, combine).awaitTermination()
    return flows.log_state(t.spark, out, rows.schema, combine).groupBy("user_id").agg(F.count("*").alias("kinds"), F.max("event_id").alias("last"))


@query("m07_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def m07b(t: Tables) -> DataFrame:
    return drained(t, flows.first_seen(stream(t).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"), "append")


@query("m08_tumbling", "SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def m08(t: Tables) -> DataFrame:
    return flows.tumbling(t.events, "ts", "6 hours", "1 hour", "event_type").select("start", "event_type", "n")


@query("m08_sliding", "WITH w AS (SELECT time_bucket(INTERVAL '6 hours', ts) AS b FROM events), x AS (SELECT unnest([b, b - INTERVAL '6 hours']) AS start FROM w) SELECT start, count(*) AS n FROM x GROUP BY start")
def m08b(t: Tables) -> DataFrame:
    return flows.sliding(t.events, "ts", "12 hours", "6 hours", "1 hour")


@query("m08_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '4 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '4 hours' AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def m08c(t: Tables) -> DataFrame:
    return flows.sessions(t.events, "ts", "4 hours", "1 hour", "user_id")


@query("m08_tumbling_stream", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS n FROM events GROUP BY 1 HAVING time_bucket(INTERVAL '1 day', min(ts)) + INTERVAL '1 day' <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'")
def m08d(t: Tables) -> DataFrame:
    return drained(t, flows.tumbling(stream(t), "ts", "1 day", "1 hour").select("start", "n"), "append")


@query("m09_counters", "SELECT user_id, count(*) AS total, count(*) >= 70 AS cooling FROM events GROUP BY user_id")
def m09(t: Tables) -> DataFrame:
    out = drained(t, flows.counters(stream(t), "user_id", 70), "update")
    return out.groupBy("user_id").agg(F.max_by(F.struct("total", "cooling"), "_batch").alias("s")).select("user_id", "s.total", "s.cooling")




@query("m01_claimed_jobs", "WITH j AS (SELECT event_id AS id, event_type AS kind, CASE WHEN event_id % 4 = 0 THEN 'done' ELSE 'queued' END AS state, ts FROM events), m AS (SELECT id FROM j WHERE state = 'queued' AND kind IN ('click', 'view') ORDER BY ts, id LIMIT 20) SELECT id, kind, CASE WHEN id IN (SELECT id FROM m) THEN 'running' ELSE state END AS state, CASE WHEN id IN (SELECT id FROM m) THEN 'w1' END AS worker FROM j")
def m01b(t: Tables) -> DataFrame:
    jobs = t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 4 == 0, "done").otherwise("queued").alias("state"), F.col("ts").alias("created_at"), F.lit(None).cast("string").alias("worker"))
    return flows.claim(jobs, ["click", "view"], 20, "w1").select("id", "kind", "state", "worker")
