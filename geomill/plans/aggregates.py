"""Aggregations, windows, sorts, limits and sampling (D, E, F), with the cube, rank and frame forms as extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.functions import geo, nested, similarity, text
from geomill.operators import address, blocks, changes, cluster, fusion, joins, lexicon, numbering

from geomill.operators.stages import keeper

from .inputs import Tables, with_ctes
from .joins import RINGS
from .registry import both, query

_MONEY = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"

both("d01_group_count", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
both("d02_filtered_counts", "SELECT n_name, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS positive, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building, count(*) FILTER (WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING') AS rich FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
both("d03_sums_having", f"SELECT l_suppkey, {_MONEY.format('l_quantity')} AS quantity, CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'R'), 0) AS DOUBLE) AS returned FROM lineitem GROUP BY l_suppkey HAVING count(*) > 550")
both("d04_distinct_count", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
both("d05_bool_min_distinct", "SELECT o_custkey, bool_or(o_orderstatus = 'P') AS open, min(o_totalprice) AS least, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey")


@query("d06_ordered_array", "SELECT city, list(id ORDER BY evidence DESC, id) AS ids FROM poi GROUP BY city")
def d06(t: Tables) -> DataFrame:
    a = F.array_sort(F.collect_list(F.struct((-F.col("evidence")).alias("e"), "id")))
    return t.poi.groupBy("city").agg(F.transform(a, lambda s: s["id"]).alias("ids"))


@query("d07_distinct_array", "SELECT street, list_sort(list(DISTINCT source)) AS sources FROM poi GROUP BY street")
def d07(t: Tables) -> DataFrame:
    return t.poi.groupBy("street").agg(F.array_sort(F.collect_set("source")).alias("sources"))


@query("d08_string_agg", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def d08(t: Tables) -> DataFrame:
    return t.sql("SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")


@query("d09_json_agg", "SELECT n_regionkey, '[' || string_agg('{\"k\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS doc FROM nation GROUP BY n_regionkey")
def d09(t: Tables) -> DataFrame:
    s = F.struct(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return t.nation.groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list(s))).alias("doc"))


both("d10_median", "SELECT o_orderpriority, percentile_cont(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS median FROM orders GROUP BY o_orderpriority")
both("d11_quantiles", "SELECT l_returnflag, percentile_cont(0.5) WITHIN GROUP (ORDER BY l_quantity) AS p50, percentile_cont(0.75) WITHIN GROUP (ORDER BY l_quantity) AS p75, percentile_cont(0.9) WITHIN GROUP (ORDER BY l_quantity) AS p90, percentile_cont(0.99) WITHIN GROUP (ORDER BY l_quantity) AS p99 FROM lineitem GROUP BY l_returnflag")
_HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lng - {a}lng) / 2), 2)))"


@query("d12_street_centroid", f"WITH m AS (SELECT street, median(lat) AS y, median(lng) AS x FROM poi GROUP BY street), d AS (SELECT p.street, {_HAV.replace('{a}lat', 'y').replace('{a}lng', 'x').replace('{b}', 'p.')} AS d FROM poi p JOIN m USING (street)) SELECT m.street, round(any_value(y), 6) AS y, round(any_value(x), 6) AS x, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY d), 3) AS p95 FROM m JOIN d USING (street) GROUP BY m.street")
def d12(t: Tables) -> DataFrame:
    m = t.poi.groupBy("street").agg(F.median("lat").alias("y"), F.median("lng").alias("x"))
    d = t.poi.join(m, "street").withColumn("d", geo.haversine(F.col("y"), F.col("x"), F.col("lat"), F.col("lng")))
    return d.groupBy("street").agg(F.round(F.any_value("y"), 6).alias("y"), F.round(F.any_value("x"), 6).alias("x"), F.round(F.percentile("d", 0.95), 3).alias("p95"))


@query("d13_metres_per_number", f"WITH s AS (SELECT *, lag(number) OVER w AS pn, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM door WINDOW w AS (PARTITION BY street ORDER BY number, id)), r AS (SELECT street, {_HAV.format(a='p', b='')} / nullif(number - pn, 0) AS r, number - pn AS dn FROM s) SELECT street, round(coalesce(least(greatest(percentile_cont(0.5) WITHIN GROUP (ORDER BY r) FILTER (WHERE dn > 0), 0.5), 60.0), 6.0), 3) AS m FROM r GROUP BY street")
def d13(t: Tables) -> DataFrame:
    return address.metres_per_number(t.door).withColumn("m", F.round("m", 3))


both("d14_best_representative", "SELECT postcode, id FROM (SELECT postcode, id, row_number() OVER (PARTITION BY postcode ORDER BY evidence, id) AS rn FROM poi) q WHERE rn = 1")


@query("d15_address_profile", "SELECT street, number, count(*) AS size, sum((category = 'saude')::INT)::BIGINT AS health, count(DISTINCT city) AS cities, max(evidence) AS top, array_to_string(list_sort(list(DISTINCT name)), '|') AS names FROM poi GROUP BY street, number")
def d15(t: Tables) -> DataFrame:
    return t.poi.groupBy("street", "number").agg(F.count("*").alias("size"), F.sum((F.col("category") == "saude").cast("int")).alias("health"), F.countDistinct("city").alias("cities"), F.max("evidence").alias("top"), F.array_join(F.array_sort(F.collect_set("name")), "|").alias("names"))


@query("d16_modal_spelling", "SELECT postcode, street, n FROM (SELECT postcode, street, count(*) AS n, row_number() OVER (PARTITION BY postcode ORDER BY count(*) DESC, street) AS rn FROM poi GROUP BY postcode, street) q WHERE rn = 1")
def d16(t: Tables) -> DataFrame:
    return lexicon.modal_spelling(t.poi, ["postcode"], "street")


both("d17_block_aggregate", f"SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS plain, min(l_linenumber) AS first_line, {_MONEY.format('l_extendedprice')} AS price FROM lineitem GROUP BY l_orderkey")
_USES = "RESIDENCIAL,COMERCIO_VAREJO,COMERCIO_SERVICO,BELEZA_ESTETICA,INDUSTRIAL,ALIMENTACAO,SERVICO_PROF,SERVICO_AUTO,MANUFATURA,SAUDE,EDUCACAO,RELIGIOSO,HOSPEDAGEM,VAGO,LAZER,DIVERSOS,RURAL"
UNITS = f"""SELECT id, concat(street, '|', CAST(number AS VARCHAR(10))) AS key, concat('C', street, CAST(number AS VARCHAR(10))) AS collective, id % 6 < 4 AS is_collective,
  split_part(',A,B,C', ',', CAST(id % 4 AS INT) + 1) AS block, split_part(', ,TORRE,BLOCO', ',', CAST(CAST(FLOOR(id / 2) AS BIGINT) % 4 AS INT) + 1) AS block_kind, CASE WHEN id % 5 > 0 THEN CAST(id % 7 AS VARCHAR(10)) ELSE '' END AS floor,
  CASE WHEN id % 3 > 0 THEN CAST(id % 31 AS VARCHAR(10)) END AS unit, CASE WHEN id % 7 = 0 THEN CAST(id % 3 AS VARCHAR(10)) ELSE '' END AS house, split_part('{_USES}', ',', CAST(id * 5 % 17 AS INT) + 1) AS use,
  street, CASE WHEN number = 4 THEN 0 ELSE number END AS number, concat('area ', CAST(city AS VARCHAR(10))) AS area, postcode, concat('kind ', CAST(id % 2 AS VARCHAR(10))) AS kind, CAST(id % 4 AS BIGINT) AS confidence_code, lat, lng, CASE WHEN id % 9 > 0 THEN CAST(id % 8 AS VARCHAR(10)) END AS establishments FROM door"""
_COUNTED = ", ".join(f"count(*) FILTER (WHERE use IN ({', '.join(repr(x) for x in v)})) AS n_{k}" for k, v in blocks.USES.items())
_FIRST = "collective, street, number, area, postcode, kind, confidence_code"


@query(
    "d17_block_profile",
    f"""WITH r AS (SELECT * REPLACE (coalesce(nullif(block, ''), '-') AS block) FROM ({UNITS}) q WHERE is_collective AND number > 0),
g AS (SELECT key, block, {", ".join(f"min_by({c}, id) AS {c}" for c in _FIRST.split(", "))}, coalesce(min_by(block_kind, id) FILTER (WHERE trim(block_kind) <> ''), '-') AS block_kind, count(*) AS n, count(DISTINCT nullif(floor, '')) AS n_floors, count(DISTINCT nullif(unit, '')) AS n_units, count(DISTINCT nullif(house, '')) AS n_houses,
  {_COUNTED}, avg(lat) AS lat, avg(lng) AS lng, max(establishments::DOUBLE) AS most_declared FROM r GROUP BY key, block)
SELECT * EXCLUDE (key) REPLACE (round(lat + 3.3e-8::DOUBLE, 6) AS lat, round(lng + 3.3e-8::DOUBLE, 6) AS lng), (sum(n) OVER (PARTITION BY collective))::BIGINT AS total, count(*) FILTER (WHERE block <> '-') OVER (PARTITION BY collective) AS n_blocks FROM g""",
)
def d17b(t: Tables) -> DataFrame:
    # means of steps of 0.00001 are often halves of the last digit, where engines round apart: both are moved off them
    return blocks.block_profile(t.sql(with_ctes(UNITS))).withColumns({c: F.round(F.col(c) + 3.3e-8, 6) for c in ("lat", "lng")})


both("d18_group_transform", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")


@query("d19_merge_by_proximity", "WITH c AS (SELECT street, avg(lat) AS y, avg(lng) AS x FROM poi GROUP BY street) SELECT a.street AS a, b.street AS b FROM c a JOIN c b ON a.street < b.street AND abs(a.y - b.y) * 111000 < 200 AND abs(a.x - b.x) * 96000 < 200")
def d19(t: Tables) -> DataFrame:
    c = t.poi.groupBy("street").agg(F.avg("lat").alias("y"), F.avg("lng").alias("x"))
    cy, cx = F.floor(F.col("y") * 111000 / 200), F.floor(F.col("x") * 96000 / 200)
    a = joins.with_offsets(c.select(F.col("street").alias("a"), F.col("y").alias("ya"), F.col("x").alias("xa"), cy.alias("cy"), cx.alias("cx")), F.col("cy"), F.col("cx"))
    b = c.select(F.col("street").alias("b"), F.col("y").alias("yb"), F.col("x").alias("xb"), cy.alias("_cy"), cx.alias("_cx"))
    return a.join(b, ["_cy", "_cx"]).filter("a < b AND abs(ya - yb) * 111000 < 200 AND abs(xa - xb) * 96000 < 200").select("a", "b")


@query("d20_profile", "SELECT 'phone' AS field, count(*) AS n, count(phone) AS filled FROM poi UNION ALL SELECT 'site', count(*), count(nullif(site, 'nan')) FROM poi")
def d20(t: Tables) -> DataFrame:
    return changes.profile(t.poi.withColumn("site", text.void_to_null(F.col("site"))), ["phone", "site"]).select("field", "n", "filled")


both("d21_capped_groups", "SELECT postcode, n, n > 22 AS dropped FROM (SELECT postcode, count(*) AS n FROM poi GROUP BY postcode) q")


@query("d22_shared_doors", "SELECT street, number, count(DISTINCT name) AS names FROM (SELECT lower(street) AS street, number, lower(name) AS name FROM poi WHERE number <> '') q GROUP BY street, number HAVING count(DISTINCT name) > 2")
def d22(t: Tables) -> DataFrame:
    return fusion.shared_doors(t.poi.withColumn("street", F.lower("street")))


@query("d23_idf", "WITH w AS (SELECT unnest(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: length(x) > 1))) AS token FROM part) SELECT token, round(ln((SELECT count(*) FROM part)::DOUBLE / (1 + count(*))), 6) AS weight FROM w GROUP BY token")
def d23(t: Tables) -> DataFrame:
    return similarity.idf(t.part, "p_name").withColumn("weight", F.round("weight", 6))


@query("d24_context_frequency", "WITH n AS (SELECT p_name AS name, count(*) AS weight FROM part GROUP BY p_name), w AS (SELECT string_split(name, ' ') AS w, weight FROM n), e AS (SELECT w, weight, unnest(range(1, len(w) + 1)) AS i FROM w) SELECT array_to_string(list_transform(w, lambda x, j: CASE WHEN j = i THEN '{}' ELSE x END), ' ') AS context, w[i] AS token, sum(weight)::BIGINT AS weight FROM e GROUP BY 1, 2")
def d24(t: Tables) -> DataFrame:
    return lexicon.context_frequency(t.part.groupBy(F.col("p_name").alias("name")).agg(F.count("*").alias("weight")))


both("d25_minute_histogram", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 13")
both("d26_dashboard", "SELECT city, source, count(*) AS n, count(*) FILTER (WHERE number <> '') AS doors, count(*) FILTER (WHERE site <> 'nan') AS sites, avg(evidence) AS evidence FROM poi GROUP BY city, source")


@query("d27_user_statistics", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, max(ts) AS last, round(avg(value), 6) AS mean FROM events GROUP BY user_id")
def d27(t: Tables) -> DataFrame:
    p = t.events.groupBy("user_id").pivot("event_type", ["click", "view"]).count().fillna(0, ["click", "view"])
    return p.join(t.events.groupBy("user_id").agg(F.max("ts").alias("last"), F.round(F.avg("value"), 6).alias("mean")), "user_id")


both("d28_current_decision", "SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY o_custkey")
both("d29_join_coverage", "SELECT count(*) AS n, count(l.doc_id) AS matched, avg(CASE WHEN l.doc_id IS NULL THEN 0.0 ELSE 1.0 END) AS share FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
both("d30_category_catalogue", "SELECT source, category, count(*) AS n, count(*) FILTER (WHERE evidence >= 3) AS strong FROM poi GROUP BY source, category")
both("d31_golden_metrics", "SELECT p_type, count(*) AS n, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_type")


@query("d32_quality_summary", "SELECT count(*) AS rows_in, count(*) FILTER (WHERE text IS NULL OR text = '') AS empty, count(*) FILTER (WHERE n_chars > 5000) AS long, count(DISTINCT source) AS sources FROM documents")
def d32(t: Tables) -> DataFrame:
    return t.documents.agg(F.count("*").alias("rows_in"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("empty"), F.count_if(F.col("n_chars") > 5000).alias("long"), F.countDistinct("source").alias("sources"))


both("d33_rollup", "SELECT n_regionkey, n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_regionkey, n_name)")
both("x01_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
both("x02_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
both("x03_rank_forms", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS d, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS after FROM orders")
both("x04_frames", "SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS top3, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_key FROM orders")

# ---- windows -----------------------------------------------------------------------------------
both("e01_dedup_per_key", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY upper(trim(name)), upper(trim(street)) ORDER BY id) AS rn FROM poi) q WHERE rn = 1")


@query("e02_medoids", "WITH m AS (SELECT street, median(lat) AS y, median(lng) AS x FROM poi GROUP BY street), d AS (SELECT p.street, p.id, row_number() OVER (PARTITION BY p.street ORDER BY (lat - y) * (lat - y) + (lng - x) * (lng - x), id) AS rank FROM poi p JOIN m USING (street)) SELECT street, id, rank::INT AS rank FROM d WHERE rank <= 3")
def e02(t: Tables) -> DataFrame:
    return cluster.medoids(t.poi, "street", 3)


@query("e03_total_beside_rows", "SELECT o_orderkey, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'P'")
def e03(t: Tables) -> DataFrame:
    # a window over everything is one task; the total is one row, so it is joined instead
    rows = t.orders.filter("o_orderstatus = 'P'").select("o_orderkey")
    return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


both("e05_dominant_owner", "SELECT city, source FROM (SELECT city, source, row_number() OVER (PARTITION BY city ORDER BY count(*) DESC, source) AS rn FROM poi GROUP BY city, source) q WHERE rn = 1")
both("e06_first_by_order", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) q WHERE rn = 1")
both("e07_best_link", "SELECT city, id FROM (SELECT city, id, row_number() OVER (PARTITION BY city ORDER BY evidence DESC, nullif(number, '') NULLS LAST, id) AS rn FROM poi) q WHERE rn = 1")
both("e09_sequence_per_group", "SELECT id, 100 + row_number() OVER (PARTITION BY city ORDER BY id) AS seq FROM poi")
both("e10_order_agreement", "SELECT street, count(*) FILTER (WHERE dn * dy > 0) AS up, count(*) FILTER (WHERE dn * dy < 0) AS down, count(*) FILTER (WHERE number % 2 = 0) AS even FROM (SELECT street, number, number - lag(number) OVER (PARTITION BY street ORDER BY number, id) AS dn, lat - lag(lat) OVER (PARTITION BY street ORDER BY number, id) AS dy FROM door) q GROUP BY street")
@query(
    "e10_numbering_score",
    """WITH d AS (SELECT id, city, street, CASE WHEN id % 97 = 0 THEN 0 ELSE number END::DOUBLE AS n, lat, lng FROM door),
u AS (SELECT *, count(*) OVER s AS size, lng * 111320 * cos(radians(avg(lat) OVER s)) AS x, lat * 110900.0 AS y, n % 2 AS odd, count(*) OVER (PARTITION BY city, street, n) AS same, lag(n) OVER o AS before, lead(n) OVER o AS after
  FROM d WHERE n > 0 WINDOW s AS (PARTITION BY city, street), o AS (PARTITION BY city, street ORDER BY n, id)),
e AS (SELECT *, first_value(x) OVER f AS x0, first_value(y) OVER f AS y0, last_value(x) OVER f AS x1, last_value(y) OVER f AS y1 FROM u WINDOW f AS (PARTITION BY city, street ORDER BY n, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
l AS (SELECT *, greatest(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 1e-9) AS len FROM e),
a AS (SELECT *, (x - x0) * (x1 - x0) / len + (y - y0) * (y1 - y0) / len AS along FROM l),
g AS (SELECT *, CASE WHEN before IS NOT NULL THEN ((n - before > 0) = (along - lag(along) OVER (PARTITION BY city, street ORDER BY n, id) > 0))::INT END AS agree, n - before AS gap, round_even(avg(odd) OVER s, 0) AS most FROM a WINDOW s AS (PARTITION BY city, street)),
h AS (SELECT *, sum(agree) OVER s AS agreeing, median(gap) OVER s AS med, round_even(25 * avg((odd = most)::INT) OVER s, 0)::INT AS base FROM g WINDOW s AS (PARTITION BY city, street)),
r AS (SELECT *, CASE WHEN same > 1 THEN 0 ELSE least(n - before, after - n) END / greatest(med, 1) AS ratio FROM h),
p AS (SELECT id, size = 1 AS lone, CASE WHEN size = 1 THEN 30 ELSE round_even(30 * agreeing / (size - 1), 0)::INT END AS o, CASE WHEN size = 1 THEN 25 WHEN odd = most THEN base ELSE greatest(0, base - 15) END AS p,
  CASE WHEN size = 1 OR med = 0 OR ratio <= 2 THEN 25 WHEN ratio <= 4 THEN 15 WHEN ratio <= 8 THEN 8 ELSE 0 END AS g FROM r),
t AS (SELECT d.id, coalesce(o, 0) AS o, coalesce(p.p, 0) AS p, coalesce(g, 0) AS g, CASE WHEN lone THEN 100 ELSE coalesce(o + p.p + g, 0) END AS score FROM d LEFT JOIN p USING (id))
SELECT id, o AS order_part, p AS parity_part, g AS gap_part, score, CASE WHEN score >= 60 THEN 'ALTA' WHEN score >= 40 THEN 'MEDIA' WHEN score >= 20 THEN 'BAIXA' ELSE 'INCONSISTENTE' END AS grade FROM t""",
)
def e10b(t: Tables) -> DataFrame:
    d = t.door.withColumn("number", F.when(F.col("id") % 97 == 0, 0).otherwise(F.col("number")))
    return numbering.numbering_score(d, ["city", "street"])


both("e11_tied_winners", "SELECT id, city FROM (SELECT id, city, evidence, max(evidence) OVER (PARTITION BY city) AS best FROM poi) q WHERE best - evidence <= 1")


@query("e12_sequence_gaps", "WITH u AS (SELECT street, list_sort(list(DISTINCT number)) AS v FROM door GROUP BY street) SELECT street, CASE WHEN len(v) > 1 AND v[-1] - v[1] + 1 <= 3 * len(v) THEN list_filter(range(v[1], v[-1] + 1), lambda x: NOT list_contains(v, x)) ELSE [] END AS missing FROM u")
def e12(t: Tables) -> DataFrame:
    v = t.door.groupBy("street").agg(F.array_sort(F.collect_set("number")).alias("v"))
    return v.select("street", nested.gaps(F.col("v")).alias("missing"))


# ---- sorts, limits, sampling -------------------------------------------------------------------
both("f01_ordered", "SELECT id, evidence FROM poi ORDER BY evidence DESC NULLS LAST, nullif(number, '') NULLS LAST, id LIMIT 200")
both("f02_capped", "SELECT id FROM poi ORDER BY id LIMIT 100")
both("f03_keyset_page", "SELECT o_orderdate, o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01 00:00:00' OR (o_orderdate = TIMESTAMP '1997-01-01 00:00:00' AND o_orderkey < 5000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
both("f04_top_per_group", "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) q WHERE rn <= 5")
both("f05_priority_queue", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 300")
both("f06_total_order", "SELECT source, id, row_number() OVER (PARTITION BY source ORDER BY id) AS place FROM poi")


@query("f07_path_order")
def f07(t: Tables) -> DataFrame:
    return cluster.path_order(t.poi, "city", keeper(t.spark))


both("f08_batches", "SELECT id, (row_number() OVER (PARTITION BY city ORDER BY id) - 1 - (row_number() OVER (PARTITION BY city ORDER BY id) - 1) % 12) / 12 AS batch FROM poi")


@query("f09_shards")
def f09(t: Tables) -> DataFrame:
    return t.poi.select("id", (F.crc32(F.col("id").cast("string").cast("binary")) % 4).alias("shard"))


both("f10_stratified_sample", "SELECT id, city FROM (SELECT id, city, row_number() OVER (PARTITION BY city ORDER BY md5(concat(CAST(id AS VARCHAR(20)), ':7')), id) AS rn FROM poi) q WHERE rn <= 3")
both("f11_hash_sample", "SELECT o_orderkey FROM orders WHERE substring(md5(CAST(o_orderkey AS VARCHAR(20))), 1, 1) = '0'")
both("f12_central_of_cell", "SELECT cy, cx, id, n FROM (SELECT id, floor(lat / 0.002) AS cy, floor(lng / 0.002) AS cx, count(*) OVER (PARTITION BY floor(lat / 0.002), floor(lng / 0.002)) AS n, row_number() OVER (PARTITION BY floor(lat / 0.002), floor(lng / 0.002) ORDER BY round(abs(lat - (floor(lat / 0.002) + 0.5) * 0.002) + abs(lng - (floor(lng / 0.002) + 0.5) * 0.002), 7), id) AS rn FROM (SELECT id, lat, lng FROM poi) p) q WHERE rn = 1".replace("floor(lat / 0.002) AS cy", "CAST(floor(lat / 0.002) AS BIGINT) AS cy").replace("floor(lng / 0.002) AS cx", "CAST(floor(lng / 0.002) AS BIGINT) AS cx"))


@query("f13_grid_in_polygon", "WITH g AS (SELECT -30 + i * 0.001 + 0.0005 AS lat, -51.2 + j * 0.001 + 0.0005 AS lng, i, j FROM range(0, 16) a(i), range(0, 16) b(j)) SELECT i, j FROM g WHERE lat > -29.995 AND lat < -29.985 AND lng > -51.195 AND lng < -51.185")
def f13(t: Tables) -> DataFrame:
    g = t.spark.range(16).select(F.col("id").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))))
    lat, lng = F.lit(-30.0) + F.col("i") * 0.001 + 0.0005, F.lit(-51.2) + F.col("j") * 0.001 + 0.0005
    return g.filter(geo.in_ring(lat, lng, geo.ring_literal(RINGS["centre"]))).select("i", "j")


@query("f14_tiles", "SELECT i, j, i * 80 AS y0, i * 80 + 100 AS y1, j * 80 AS x0, j * 80 + 100 AS x1 FROM range(0, 7) a(i), range(0, 9) b(j)")
def f14(t: Tables) -> DataFrame:
    g = t.spark.range(7).select(F.col("id").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(8).cast("bigint"))))
    return g.select("i", "j", (F.col("i") * 80).alias("y0"), (F.col("i") * 80 + 100).alias("y1"), (F.col("j") * 80).alias("x0"), (F.col("j") * 80 + 100).alias("x1"))


@query("x05_sketches")
def x05(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"), F.percentile_approx("l_extendedprice", 0.5, 1000).alias("median"))

