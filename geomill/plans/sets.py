"""Set operations, distinct, recursion (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.operators import changes, cluster, fusion
from geomill.operators.stages import keeper

from .inputs import Tables
from .registry import both, query

both("g01_union_counts", "SELECT 'orders' AS t, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part")


@query("g02_hulls_and_singles")
def g02(t: Tables) -> DataFrame:
    c = cluster.dbscan(t.poi, 60.0, 4, keeper(t.spark))
    p = t.poi.select("id", "lat", "lng").join(c, "id")
    single = p.filter("cluster IS NULL").select(F.col("id").alias("cluster"), F.concat(F.lit("POINT ("), F.format_number("lng", 6), F.lit(" "), F.format_number("lat", 6), F.lit(")")).alias("hull"))
    return cluster.hulls(p.filter("cluster IS NOT NULL"), "cluster").unionByName(single)


@query("g03_exact_row_dedup", "SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def g03(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey", "o_orderstatus").dropDuplicates()


both("g04_keep_first", "SELECT source, id FROM (SELECT source, id, row_number() OVER (PARTITION BY source, phone ORDER BY id) AS rn FROM poi) q WHERE rn = 1")


@query("g05_key_coverage", "SELECT count(*) FILTER (WHERE postcode NOT IN (SELECT postcode FROM poi)) AS missing, count(*) AS total FROM (SELECT DISTINCT postcode FROM door) q")
def g05(t: Tables) -> DataFrame:
    return changes.coverage_gate(t.door, t.poi, "postcode")


@query("g06_common_units", "WITH u AS (SELECT city, list(DISTINCT evidence) AS e FROM poi WHERE id % 4 = 0 GROUP BY city), v AS (SELECT city, list(DISTINCT evidence) AS e FROM poi WHERE id % 5 < 3 GROUP BY city) SELECT city, list_sort(list_intersect(u.e, v.e)) AS both_sides FROM u JOIN v USING (city)")
def g06(t: Tables) -> DataFrame:
    u = t.poi.filter("id % 4 = 0").groupBy("city").agg(F.collect_set("evidence").alias("u"))
    v = t.poi.filter("id % 5 < 3").groupBy("city").agg(F.collect_set("evidence").alias("v"))
    return u.join(v, "city").select("city", F.array_sort(F.array_intersect("u", "v")).alias("both_sides"))


_EDGES = "SELECT id AS a, id - id % 500 + (id * 7 + 3) % 500 AS b FROM poi WHERE id % 3 = 0"


@query("g07_components", f"WITH RECURSIVE e AS ({_EDGES}), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, c) AS (SELECT a, a FROM s UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.id) SELECT id, min(c) AS component FROM r GROUP BY id".replace("WITH RECURSIVE e", "WITH RECURSIVE e"))
def g07(t: Tables) -> DataFrame:
    e = t.poi.filter("id % 3 = 0").select(F.col("id").alias("a"), (F.col("id") - F.col("id") % 500 + (F.col("id") * 7 + 3) % 500).alias("b"))
    n = fusion.components(e, keeper(t.spark))
    return n


_MERGED = "SELECT id, id - id % 10 - CASE WHEN id % 10 = 0 THEN 10 ELSE 0 END AS dest FROM poi WHERE id > 0 AND id % 10 IN (0, 3, 7)"


@query("g08_merge_chains", "SELECT id, 0::BIGINT AS dest FROM poi WHERE id > 0 AND id % 10 IN (0, 3, 7)")
def g08(t: Tables) -> DataFrame:
    i = F.col("id")
    m = t.poi.filter("id > 0 AND id % 10 IN (0, 3, 7)").select("id", (i - i % 10 - F.when(i % 10 == 0, 10).otherwise(0)).alias("into"))
    return fusion.resolve_chains(m, keeper(t.spark)).select("id", F.col("into").alias("dest"))


@query("g09_recursive", "WITH RECURSIVE r(n, k) AS (SELECT 1, n_nationkey FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n + 1, k + 1 FROM r WHERE n < 4) SELECT n, k FROM r")
def g09(t: Tables) -> DataFrame:
    return t.sql("WITH RECURSIVE r(n, k) AS (SELECT 1, n_nationkey FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n + 1, k + 1 FROM r WHERE n < 4) SELECT n, k FROM r")


both("g09_recover_destination", "SELECT p.id, u.target FROM poi p LEFT JOIN (SELECT name, min(id) AS target FROM poi WHERE id % 10 = 1 GROUP BY name HAVING count(*) = 1) u ON u.name = p.name WHERE p.id % 10 = 2")
both("x06_intersect", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
both("x07_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 100000")
both("x08_right_join", "SELECT n.n_name, s.s_suppkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN nation n ON n.n_nationkey = s.s_nationkey")
