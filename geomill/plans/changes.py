"""Change capture, data quality, and what triggers and policies did (L, N)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.operators import changes
from geomill.sources.guard import read_only

from .inputs import Tables, with_ctes
from .registry import both, query

_EVENTS = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'SAME' WHEN o_orderkey % 7 = 0 THEN 'LEFT' WHEN o_orderkey % 11 = 0 THEN 'ENTERED' ELSE 'CHANGED' END AS event FROM orders"


def events(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(k, F.when(k % 5 == 0, "SAME").when(k % 7 == 0, "LEFT").when(k % 11 == 0, "ENTERED").otherwise("CHANGED").alias("event"))


@query("l01_only_changed", f"SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_EVENTS}) e WHERE event = 'SAME')")
def l01(t: Tables) -> DataFrame:
    return changes.only_changed(t.orders, events(t), "o_orderkey").select("o_orderkey")


@query("l02_mark_exits", f"SELECT o.o_orderkey, CASE WHEN event = 'LEFT' THEN DATE '2000-01-01' WHEN event = 'ENTERED' THEN NULL ELSE o.o_orderdate::DATE END AS left_at FROM orders o JOIN ({_EVENTS}) e USING (o_orderkey)")
def l02(t: Tables) -> DataFrame:
    target = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("left_at"))
    e = events(t)
    gone = target.join(e.filter("event = 'LEFT'").select("o_orderkey"), "o_orderkey", "left_semi").withColumn("left_at", F.lit(None).cast("date"))
    rest = target.join(e.filter("event = 'LEFT'").select("o_orderkey"), "o_orderkey", "left_anti")
    return changes.mark_exits(rest.unionByName(gone), e, "o_orderkey", F.lit("2000-01-01").cast("date")).select("o_orderkey", "left_at")


@query("l03_schema_drift", "SELECT 'added' AS kind, 'o_priority' AS name UNION ALL SELECT 'removed', 'o_orderpriority'")
def l03(t: Tables) -> DataFrame:
    old = t.orders.columns
    added, removed = changes.schema_drift(old, [c.replace("o_orderpriority", "o_priority") for c in old])
    return t.spark.createDataFrame([("added", c) for c in added] + [("removed", c) for c in removed], "kind string, name string")


@query("l04_stage_decision", "SELECT * FROM (VALUES ('a', 'reuse'), ('b', 'obsolete'), ('c', 'run')) AS v(stage, action)")
def l04(t: Tables) -> DataFrame:
    s = t.spark.createDataFrame([("a", "1"), ("b", "1")], "stage string, scope_hash string")
    return changes.stage_decision(s, t.spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "stage string, scope_hash string"))


@query("l05_funnel", "SELECT coalesce(CASE WHEN n_chars IS NULL OR n_chars = 0 THEN 'empty' WHEN n_chars < 200 THEN 'short' WHEN lang NOT IN ('en', 'de') THEN 'language' END, 'kept') AS reason, count(*) AS n FROM documents GROUP BY 1")
def l05(t: Tables) -> DataFrame:
    return changes.funnel_counts(changes.funnel(t.documents, [("empty", F.col("n_chars") > 0), ("short", F.col("n_chars") >= 200), ("language", F.col("lang").isin("en", "de"))]))


@query("l06_expectations", "SELECT 'price' AS rule, count(*) FILTER (WHERE NOT o_totalprice > 1000) AS broken FROM orders UNION ALL SELECT 'status', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) FROM orders")
def l06(t: Tables) -> DataFrame:
    return changes.expectations(t.orders, {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("F", "O")})


both("l07_output_gates", "SELECT count(*) = count(DISTINCT o_orderkey) AS unique_key, count(*) FILTER (WHERE o_custkey IS NULL) = 0 AS filled FROM orders")
both("l08_audit_orphans", "SELECT count(*) AS orphans FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey)")
both("l10_reconcile", "SELECT 'orders' AS t, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders UNION ALL SELECT 'lineitem', count(DISTINCT l_orderkey), min(l_orderkey), max(l_orderkey) FROM lineitem")
both("l11_freshness", "SELECT source, count(*) AS n, count(*) > 500 AS stale FROM poi GROUP BY source")
both("l12_version_matrix", "SELECT old_kind, new_kind, count(*) AS n FROM (SELECT category AS old_kind, CASE WHEN evidence > 2 THEN category ELSE 'none' END AS new_kind FROM poi) q GROUP BY old_kind, new_kind")


@query("l13_typed", "SELECT id, try_cast(nullif(number, '') AS INT) AS number, NULL::DATE AS phone FROM poi")
def l13(t: Tables) -> DataFrame:
    return changes.typed(t.poi.select("id", "number", "phone"), {"number": "int", "phone": "date", "absent": "int"})


@query("a07_load_ledger", "SELECT source, id % 50 AS ref FROM poi WHERE NOT (source = 'src0' AND id % 50 < 25) GROUP BY source, id % 50")
def a07(t: Tables) -> DataFrame:
    files = t.poi.select("source", (F.col("id") % 50).alias("ref")).distinct()
    return changes.not_loaded(files, files.filter("source = 'src0' AND ref < 25"), ["source", "ref"])


@query("h307_latest_state", "SELECT o_custkey, o_orderkey, sha256(o_orderstatus || chr(31) || o_orderpriority) AS fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) q WHERE rn = 1")
def h307(t: Tables) -> DataFrame:
    return changes.latest_state(t.orders, "o_custkey", "o_orderkey", ["o_orderstatus", "o_orderpriority"])


# ---- triggers, policies, functions -------------------------------------------------------------
both("n01_table_function", "SELECT p.id, d.id AS door FROM poi p JOIN door d ON d.postcode = p.postcode AND d.street = p.street")
both("n02_fill_on_write", "SELECT id, coalesce(nullif(number, ''), 'S/N') AS number, coalesce(category, 'none') AS category, 'tenant1' AS tenant FROM poi")


@query("n03_audit_rows", "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'INSERT' WHEN o_orderkey % 11 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS action FROM orders WHERE (o_orderkey % 10 = 0) <> (o_orderkey % 11 = 0) OR (o_orderkey % 7 = 0 AND o_orderkey % 10 <> 0)")
def n03(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("s"))
    new = o.filter("o_orderkey % 11 <> 0").withColumn("s", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("s")))
    return changes.audit(o.filter("o_orderkey % 10 <> 0"), new, "o_orderkey").select("o_orderkey", "action")


@query("n04_tenant_rows", "SELECT id FROM poi WHERE source = 'src1'")
def n04(t: Tables) -> DataFrame:
    return changes.with_tenant(t.poi, "src1", "source").select("id")


@query("n05_anchored_fields", "SELECT id, street AS value, true AS anchored FROM poi")
def n05(t: Tables) -> DataFrame:
    # a field that a model returns counts only if it stands in the source text
    return t.poi.select("id", F.col("street").alias("value"), F.contains(F.concat_ws(", ", "name", "street", "number"), F.col("street")).alias("anchored"))


both("n06_judged_pairs", "SELECT a.id AS a, b.id AS b, CASE WHEN a.category = b.category THEN 'SAME' ELSE 'DIFFERENT' END AS verdict FROM poi a JOIN poi b ON a.phone = b.phone AND a.id < b.id")


@query("n07_column_roles", "SELECT * FROM (VALUES ('lat', 'latitude'), ('lng', 'longitude'), ('name', 'name'), ('phone', 'phone'), ('postcode', 'postcode'), ('site', 'site')) AS v(col, role)")
def n07(t: Tables) -> DataFrame:
    return changes_roles(t.poi)


def changes_roles(df: DataFrame) -> DataFrame:
    """(col, role): roles of a file's columns by the share of values that look like it."""
    num = {"bigint", "int", "double"}
    looks = {"postcode": r"^[0-9]{5}-?[0-9]{3}$", "phone": r"^\([0-9]{2}\) [0-9]{7,9}$", "site": "^(https?://|nan$)", "name": r"^[A-Z][a-z]+ [A-Za-z ]+$"}
    aggs = [F.avg(F.col(c).rlike(p).cast("double")).alias(f"{c}|{role}") for c, k in df.dtypes if k == "string" for role, p in looks.items()]
    aggs += [F.avg(F.col(c).between(lo, hi).cast("double")).alias(f"{c}|{role}") for c, k in df.dtypes if k in num - {"bigint", "int"} for role, lo, hi in (("latitude", -34.0, -20.0), ("longitude", -74.0, -34.5))]
    row = df.agg(*aggs).first().asDict()
    found = sorted(tuple(k.split("|")) for k, v in row.items() if v and v > 0.95 and not (k.startswith("street|")))
    return df.sparkSession.createDataFrame(found, "col string, role string")


@query("n12_guarded_sql", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def n12(t: Tables) -> DataFrame:
    return read_only(t.spark, "SELECT n_regionkey, count(*) AS n FROM {nation} GROUP BY n_regionkey", 1000, nation=t.nation)


both("b24_read_only", "SELECT count(*) AS n FROM region")


INCOMING = "SELECT id % 1400 AS id, CASE WHEN id % 19 = 0 THEN NULL ELSE name END AS name, CASE WHEN id % 3 = 0 THEN '' ELSE category END AS category, CASE WHEN id % 7 = 0 THEN NULL ELSE city END AS city, postcode, number FROM poi"


@query("n02_filled_or_rejected", f"WITH n AS ({INCOMING}), k AS (SELECT postcode, min(city) AS city FROM door GROUP BY postcode), f AS (SELECT n.id, n.name, coalesce(nullif(n.category, ''), 'none') AS category, coalesce(n.city, k.city) AS city, n.postcode, coalesce(nullif(n.number, ''), 'S/N') AS number FROM n LEFT JOIN k ON k.postcode = n.postcode), l AS (SELECT *, concat_ws(',', CASE WHEN name IS NULL THEN 'name' END, CASE WHEN city IS NULL THEN 'city' END) AS lacks FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY id, lacks = '' ORDER BY name, category, city, postcode, number) AS rn FROM l) SELECT id, name, category, city, number, CASE WHEN lacks <> '' THEN 'lacks ' || lacks WHEN rn > 1 THEN 'repeats' END AS reason FROM r")
def n02b(t: Tables) -> DataFrame:
    owners = t.door.groupBy("postcode").agg(F.min("city").alias("city"))
    good, bad = changes.fill_or_reject(t.sql(with_ctes(INCOMING)), {"category": F.lit("none"), "number": F.lit("S/N")}, owners, "postcode", ["name", "city"], ["id"])
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad).drop("postcode")


@query("l11_ledger_freshness", "WITH n AS (SELECT city, count(*) AS rows FROM poi WHERE city <> 3 GROUP BY city), d AS (SELECT city, count(*) + city % 3 * 5 AS done FROM poi WHERE city % 5 > 0 GROUP BY city) SELECT coalesce(n.city, d.city) AS city, rows, done, CASE WHEN done IS NULL THEN 'NEW' WHEN rows IS NULL THEN 'GONE' WHEN abs(rows - done) > done * 0.1::DOUBLE THEN 'STALE' ELSE 'FRESH' END AS verdict FROM n FULL OUTER JOIN d ON d.city = n.city")
def l11b(t: Tables) -> DataFrame:
    count = t.poi.filter("city % 5 > 0").groupBy("city").agg(F.count("*").alias("n"))
    ledger = count.select("city", (F.col("n") + F.col("city") % 3 * 5).alias("rows"), F.lit(2).alias("at")).unionByName(count.select("city", F.lit(0).cast("long").alias("rows"), F.lit(1).alias("at")))
    return changes.freshness(t.poi.filter("city <> 3"), ledger, "city", 0.1)


@query(
    "l06_delivery_checks",
    """WITH o AS (SELECT * FROM orders WHERE o_orderkey % 50 > 0 UNION ALL SELECT * FROM orders WHERE o_orderkey % 400 = 1)
SELECT 'column o_orderkey' AS rule, 0::BIGINT AS broken UNION ALL SELECT 'column o_missing', 1 UNION ALL SELECT 'column o_custkey', 0
UNION ALL SELECT 'key o_orderkey', sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM o GROUP BY o_orderkey)
UNION ALL SELECT 'price', count(*) FILTER (WHERE NOT o_totalprice > 2000) FROM o UNION ALL SELECT 'status', count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) FROM o UNION ALL SELECT 'urgent', count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000) FROM o
UNION ALL SELECT 'customer', count(*) FILTER (WHERE NOT o_custkey > 0) FROM o
UNION ALL SELECT 'parent o_custkey', count(*) FROM o WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 30 > 0)
UNION ALL SELECT 'manifest rows', (count(*) <> 12000)::BIGINT FROM o UNION ALL SELECT 'manifest statuses', (count(DISTINCT o_orderstatus) <> 3)::BIGINT FROM o UNION ALL SELECT 'manifest least', (min(o_orderkey) <> (SELECT min(o_orderkey) FROM o))::BIGINT FROM o""",
)
def l06b(t: Tables) -> DataFrame:
    o = t.orders.filter("o_orderkey % 50 > 0").unionByName(t.orders.filter("o_orderkey % 400 = 1"))
    rules = {"price": F.col("o_totalprice") > 2000, "status": F.col("o_orderstatus").isin("F", "O"), "urgent": ~((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 300000)), "customer": F.col("o_custkey") > 0}
    parents = {"o_custkey": t.customer.filter("c_custkey % 30 > 0").select(F.col("c_custkey").alias("o_custkey"))}
    manifest = {"rows": 12000, "statuses": 3, "least": o.agg(F.min("o_orderkey")).first()[0] or 0}
    return changes.delivery_checks(o, "o_orderkey", rules, ["o_orderkey", "o_missing", "o_custkey"], parents, manifest, {"rows": F.count("*"), "statuses": F.countDistinct("o_orderstatus"), "least": F.min("o_orderkey")})


@query("l07_gated_output", "SELECT id, name FROM poi WHERE number <> ''")
def l07b(t: Tables) -> DataFrame:
    rows = t.poi.filter("number <> ''").select("id", "name", "number", "lat", "lng")
    return changes.require(rows, {"id": F.col("id").isNotNull(), "name": F.trim("name") != "", "number": F.col("number").rlike("^[0-9]+$"), "place": F.col("lat").between(-34, 6)}).select("id", "name")
