"""Joins (C)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.functions import text
from geomill.operators import areas, joins
from geomill.operators.stages import keeper

from .inputs import Tables, with_ctes
from .registry import both, query

NEAR = """
SELECT a.id AS a, b.id AS b FROM poi a JOIN poi b ON a.id < b.id
WHERE abs(trunc(a.lat / 0.001::DOUBLE) - trunc(b.lat / 0.001::DOUBLE)) <= 1 AND abs(trunc(a.lng / 0.001::DOUBLE) - trunc(b.lng / 0.001::DOUBLE)) <= 1"""

_METRES = "sqrt(pow(({b}.lat - {a}.lat) * 111320.0::DOUBLE, 2) + pow(({b}.lng - {a}.lng) * 111320.0::DOUBLE * cos(radians(({a}.lat + {b}.lat) / 2)), 2))"
METRES = _METRES.format(a="a", b="b")
PLAIN = "trim(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'))"
WORDS = "list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda t: t <> '')"
TYPES = "MAP {'r':'rua','av':'avenida','avn':'avenida','trav':'travessa','tv':'travessa','al':'alameda','pc':'praca','rod':'rodovia','estr':'estrada','lgo':'largo','bc':'beco'}"
FULL = "('rua','avenida','travessa','alameda','praca','rodovia','estrada','largo','beco')"
#: Street core of a column in DuckDB.
CORE = (
    "(CASE WHEN coalesce(" + TYPES + "[" + WORDS + "[1]], " + WORDS + "[1]) IN " + FULL + " THEN array_to_string(" + WORDS + "[2:], ' ') ELSE array_to_string(" + WORDS + ", ' ') END)"
)


def core(c: str) -> str:
    return CORE.replace("{0}", c)


@query("c01_near_pairs", NEAR)
def c01(t: Tables) -> DataFrame:
    return joins.near_pairs(t.poi, 0.001)


@query("c02_same_key_pairs", "WITH k AS (SELECT id, name, street, count(*) OVER (PARTITION BY name, street) AS n FROM poi) SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.name = b.name AND a.street = b.street AND a.id < b.id WHERE a.n <= 30")
def c02(t: Tables) -> DataFrame:
    return joins.capped_key_pairs(t.poi, ["name", "street"], 30)[0]


@query("c02_groups_over_cap", "SELECT street, count(*) AS n FROM poi GROUP BY street HAVING count(*) > 10")
def c02b(t: Tables) -> DataFrame:
    return joins.capped_key_pairs(t.poi, ["street"], 10)[1]


_GROUPED = "SELECT id, category, street, count(*) OVER (PARTITION BY category, street) AS n FROM poi"


@query("c02_pairs_within_cap", f"WITH k AS ({_GROUPED}) SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.category = b.category AND a.street = b.street AND a.id < b.id WHERE a.n <= 12")
def c02c(t: Tables) -> DataFrame:
    return joins.capped_key_pairs(t.poi, ["category", "street"], 12)[0]


@query("c02_groups_left_out", "SELECT category, street, count(*) AS n FROM poi GROUP BY category, street HAVING count(*) > 12")
def c02d(t: Tables) -> DataFrame:
    return joins.capped_key_pairs(t.poi, ["category", "street"], 12)[1]


@query("c03_candidate_union", f"SELECT * FROM ({NEAR}) UNION SELECT a.id AS a, b.id AS b FROM poi a JOIN poi b ON a.name = b.name AND a.street = b.street AND a.id < b.id")
def c03(t: Tables) -> DataFrame:
    p = t.poi
    return joins.near_pairs(p, 0.001).unionByName(joins.key_pairs(p, ["name", "street"])).dropDuplicates(["a", "b"])


@query("c04_same_document", f"SELECT a.id AS a_id, b.id AS b_id, 1.0::DOUBLE AS score, round({METRES}, 3) AS m FROM poi a JOIN door b ON a.postcode = b.postcode")
def c04(t: Tables) -> DataFrame:
    return joins.by_document(t.poi, t.door, "postcode").withColumn("m", F.round("m", 3))


def addressed(df: DataFrame) -> DataFrame:
    return df.withColumn("address", text.address_key(F.col("street"), F.col("number").cast("string")))


@query(
    "c05_by_address",
    f"""WITH x AS (SELECT *, {core('street')} || '|' || number AS address FROM poi WHERE number <> ''), y AS (SELECT *, {core('street')} || '|' || number AS address FROM door),
p AS (SELECT a.id AS a_id, b.id AS b_id, {METRES} AS m FROM x a JOIN y b USING (address))
SELECT a_id, b_id, round(m, 3) AS m, 1.0::DOUBLE AS score, count(*) OVER (PARTITION BY a_id) - 1 AS rivals FROM p WHERE m <= 300""",
)
def c05(t: Tables) -> DataFrame:
    return joins.by_address(addressed(t.poi), addressed(t.door), 300.0).withColumn("m", F.round("m", 3))


_OVER = "CASE WHEN len(list_intersect(a.w, b.w)) >= 2 OR (len(a.w) = 1 AND len(b.w) = 1 AND len(list_intersect(a.w, b.w)) = 1) THEN len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) ELSE 0 END"


@query(
    "c06_by_name",
    f"""WITH w AS (SELECT *, list_distinct({WORDS.format('name')}) AS w FROM poi), p AS (SELECT a.id AS a_id, b.id AS b_id, {METRES} AS m, {_OVER} AS score FROM w a JOIN w b ON a.id % 2 = 0 AND b.id % 2 = 1 AND abs(a.lat - b.lat) < 0.003 AND abs(a.lng - b.lng) < 0.004),
q AS (SELECT *, max(score) OVER (PARTITION BY a_id) AS best FROM p WHERE m <= 300 AND score >= 0.72), r AS (SELECT * FROM q WHERE best - score <= 0.05)
SELECT a_id, b_id, round(m, 3) AS m, round(score, 6) AS score, count(*) OVER (PARTITION BY a_id) > 1 AS ambiguous, count(*) OVER (PARTITION BY a_id) - 1 AS rivals FROM r""",
)
def c06(t: Tables) -> DataFrame:
    p = t.poi.withColumn("words", F.array_distinct(text.words(F.col("name"))))
    return joins.by_name(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"), 300.0, 0.72, 0.05).withColumns({"m": F.round("m", 3), "score": F.round("score", 6)})


@query(
    "c07_nearest",
    f"""WITH p AS (SELECT a.id AS a_id, b.id AS b_id, {METRES} AS m FROM poi a JOIN door b ON abs(a.lat - b.lat) < 0.0005 AND abs(a.lng - b.lng) < 0.0006),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY m, b_id) AS rn, lead(m) OVER (PARTITION BY a_id ORDER BY m, b_id) AS second, count(*) OVER (PARTITION BY a_id) AS n FROM p WHERE m <= 40)
SELECT a_id, b_id, round(m, 3) AS m, round(1 - m / 40, 6) AS score, n - 1 AS rivals, coalesce(second - m < 5, false) AS ambiguous FROM r WHERE rn = 1""",
)
def c07(t: Tables) -> DataFrame:
    return joins.nearest(t.poi, t.door, 40.0).withColumns({"m": F.round("m", 3), "score": F.round("score", 6)})


@query("c08_within_radius", f"SELECT a.id AS a_id, b.id AS b_id, round({METRES}, 3) AS m FROM poi a JOIN door b ON abs(a.lat - b.lat) < 0.0003 AND abs(a.lng - b.lng) < 0.0004 WHERE {METRES} <= 25")
def c08(t: Tables) -> DataFrame:
    return joins.within(t.poi, t.door, 25.0).withColumn("m", F.round("m", 3))


both("c11_shared_document", "SELECT a.id AS a_id, d.id AS d_id FROM poi a JOIN poi b ON a.phone = b.phone AND a.id <> b.id AND a.source = 'src0' AND b.source = 'src1' JOIN door d ON d.id = b.id * 5")


@query("c12_greedy_one_to_one")
def c12(t: Tables) -> DataFrame:
    p = joins.within(t.poi.filter("id % 2 = 0"), t.poi.filter("id % 2 = 1"), 60.0)
    return joins.greedy_one_to_one(p.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), (F.col("a_id") % 3).alias("strength"), "m"), keeper(t.spark)).select("a", "b")


@query(
    "c13_cascade",
    """WITH s1 AS (SELECT a.id, min(b.id) AS right_id FROM poi a JOIN door b ON a.street = b.street AND a.number = b.number::VARCHAR AND a.city = b.city GROUP BY a.id),
s2 AS (SELECT a.id, min(b.id) AS right_id FROM poi a JOIN door b ON a.postcode = b.postcode AND a.number = b.number::VARCHAR WHERE a.id NOT IN (SELECT id FROM s1) GROUP BY a.id)
SELECT id, right_id, 'street' AS step FROM s1 UNION ALL SELECT id, right_id, 'postcode' AS step FROM s2""",
)
def c13(t: Tables) -> DataFrame:
    return joins.cascade(t.poi.select("id", "street", "number", "city", "postcode"), t.door.withColumn("number", F.col("number").cast("string")), [("street", ["street", "number", "city"]), ("postcode", ["postcode", "number"])])


both("c14_key_set_then_lookup", "SELECT d.id, d.number, n.n_name FROM door d JOIN nation n ON n.n_nationkey = d.city WHERE d.postcode IN (SELECT postcode FROM poi WHERE category = 'saude' AND evidence = 4) AND d.number BETWEEN 10 AND 20")


@query(
    "c15_rare_tokens",
    f"""WITH w AS (SELECT id, unnest(list_distinct({WORDS.format('name')})) AS token FROM poi), rare AS (SELECT token FROM w WHERE id % 2 = 1 GROUP BY token HAVING count(*) <= 80)
SELECT a.id AS a_id, b.id AS b_id, count(*) AS shared FROM w a JOIN w b USING (token) JOIN rare USING (token) WHERE a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY a.id, b.id""",
)
def c15(t: Tables) -> DataFrame:
    p = t.poi.select("id", F.array_distinct(text.words(F.col("name"))).alias("words"))
    return joins.rare_token_pairs(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"), 80)


RINGS = {"centre": [(-29.995, -51.195), (-29.985, -51.195), (-29.985, -51.185), (-29.995, -51.185)], "triangle": [(-30.0, -51.2), (-29.99, -51.2), (-30.0, -51.19)]}


def polygons(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(k, [tuple(p) for p in v]) for k, v in RINGS.items()], "name string, ring array<struct<lat:double,lng:double>>")


@query("c16_in_polygons", "SELECT id, CASE WHEN lat > -29.995 AND lat <= -29.985 AND lng >= -51.195 AND lng < -51.185 THEN 'centre' ELSE 'triangle' END AS name FROM poi WHERE (lat > -29.9949999 AND lat < -29.9850001 AND lng > -51.1949999 AND lng < -51.1850001) OR (lat + 30.0 + lng + 51.2 < 0.0099999 AND id NOT IN (SELECT id FROM poi WHERE abs(lat + 29.995) < 1e-7 OR abs(lng + 51.195) < 1e-7))")
def c16(t: Tables) -> DataFrame:
    edge = (F.abs(F.col("lat") + 29.995) < 1e-7) | (F.abs(F.col("lat") + 29.985) < 1e-7) | (F.abs(F.col("lng") + 51.195) < 1e-7) | (F.abs(F.col("lng") + 51.185) < 1e-7) | (F.abs(F.col("lat") + 30.0 + F.col("lng") + 51.2 - 0.01) < 2e-7)
    return joins.in_polygons(t.poi.filter(~edge).select("id", "lat", "lng"), polygons(t))


@query("c15_common_tokens", f"SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct({WORDS.format('name')})) AS token FROM poi WHERE id % 2 = 1) GROUP BY token HAVING count(*) > 80")
def c15b(t: Tables) -> DataFrame:
    p = t.poi.select("id", F.array_distinct(text.words(F.col("name"))).alias("words"))
    return joins.common_tokens(p.filter("id % 2 = 1"), 80)


#: Four areas in each quarter, as offsets in degrees: two blocks that touch, one inside the first, and a triangle over all.  Edges lie
#: between the points, whose offsets are whole steps of 0.00001.
QUARTER_AREAS = {
    "block": [(0.002005, 0.002005), (0.002005, 0.010005), (0.010005, 0.010005), (0.010005, 0.002005)], "beside": [(0.002005, 0.010005), (0.002005, 0.018005), (0.010005, 0.018005), (0.010005, 0.010005)],
    "inner": [(0.004005, 0.004005), (0.004005, 0.006005), (0.006005, 0.006005), (0.006005, 0.004005)], "slope": [(0.000005, 0.000005), (0.000005, 0.016), (0.016, 0.000005)],
}
_Q = "CAST(FLOOR(id / 500) AS BIGINT)"
ORIGINS = f"SELECT DISTINCT q, CAST(-30 AS DOUBLE) + CAST(3000 * (q % 50) AS DOUBLE) * CAST(0.00001 AS DOUBLE) AS lat0, CAST(-51.2 AS DOUBLE) + CAST(3000 * (CAST(FLOOR(q / 50) AS BIGINT) % 600) AS DOUBLE) * CAST(0.00001 AS DOUBLE) AS lng0 FROM (SELECT {_Q} AS q FROM poi) z"
#: The points of every area, by conditions on the offsets from each area's origin.
IN_AREAS = (
    "SELECT p.id, concat(a.area, ' ', CAST(a.q AS VARCHAR(10))) AS name FROM poi p JOIN (SELECT o.*, v.area FROM (" + ORIGINS + ") o CROSS JOIN (VALUES ('block'), ('beside'), ('inner'), ('slope')) AS v(area)) a "
    "ON p.lat - a.lat0 BETWEEN -0.001 AND 0.03 AND p.lng - a.lng0 BETWEEN -0.001 AND 0.03 AND CASE a.area "
    "WHEN 'block' THEN p.lat - a.lat0 BETWEEN 0.002005 AND 0.010005 AND p.lng - a.lng0 BETWEEN 0.002005 AND 0.010005 "
    "WHEN 'beside' THEN p.lat - a.lat0 BETWEEN 0.002005 AND 0.010005 AND p.lng - a.lng0 BETWEEN 0.010005 AND 0.018005 "
    "WHEN 'inner' THEN p.lat - a.lat0 BETWEEN 0.004005 AND 0.006005 AND p.lng - a.lng0 BETWEEN 0.004005 AND 0.006005 "
    "ELSE p.lat - a.lat0 > 0.000005 AND p.lng - a.lng0 > 0.000005 AND p.lat - a.lat0 + p.lng - a.lng0 < 0.016005 END"
)


def quarter_areas(t: Tables) -> DataFrame:
    """(name, ring) of all quarters that hold a point."""
    origins = t.sql(with_ctes(ORIGINS))
    ring = lambda corners: F.array(*[F.struct((F.col("lat0") + a).alias("lat"), (F.col("lng0") + b).alias("lng")) for a, b in corners])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("area"), ring(v).alias("ring")) for k, v in QUARTER_AREAS.items()]))
    return origins.select("q", each.alias("e")).select(F.concat_ws(" ", "e.area", F.col("q").cast("string")).alias("name"), "e.ring")


@query("c16_points_in_areas", IN_AREAS)
def c16b(t: Tables) -> DataFrame:
    return areas.points_in_polygons(t.poi.select("id", "lat", "lng"), quarter_areas(t), keeper(t.spark))


@query("c16_area_totals", f"SELECT i.name, count(*) AS n, sum(p.evidence)::BIGINT AS evidence, count(DISTINCT p.category) AS categories FROM ({IN_AREAS}) i JOIN poi p ON p.id = i.id GROUP BY i.name")
def c16c(t: Tables) -> DataFrame:
    inside = areas.points_in_polygons(t.poi.select("id", "lat", "lng"), quarter_areas(t), keeper(t.spark))
    return inside.join(t.poi.select("id", "evidence", "category"), "id").groupBy("name").agg(F.count("*").alias("n"), F.sum("evidence").alias("evidence"), F.countDistinct("category").alias("categories"))


@query("c17_many_to_one", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def c17(t: Tables) -> DataFrame:
    n = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.many_to_one(t.customer, n, "c_nationkey").select("c_custkey", "n_name")


both("c18_truncated_key", "SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON substring(c.c_name, 10, 8) = substring(s.s_name, 10, 8) AND c.c_nationkey = s.s_nationkey")


@query("c19_snapshot_diff", "WITH o AS (SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 0), n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 11 <> 0) SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.s IS NULL THEN 'ENTERED' WHEN n.s IS NULL THEN 'LEFT' WHEN o.s <> n.s THEN 'CHANGED' ELSE 'SAME' END AS event FROM o FULL OUTER JOIN n ON o.o_orderkey = n.o_orderkey")
def c19(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("s"))
    return joins.snapshot_diff(o.filter("o_orderkey % 10 <> 0"), o.filter("o_orderkey % 11 <> 0").withColumn("s", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("s"))), ["o_orderkey"], "s")


@query("c20_unambiguous", "WITH u AS (SELECT phone, min(category) AS category FROM poi GROUP BY phone HAVING count(DISTINCT category) = 1) SELECT p.id, u.category FROM poi p LEFT JOIN u USING (phone)")
def c20(t: Tables) -> DataFrame:
    u = joins.unambiguous(t.poi, "phone", ["category"])
    return t.poi.select("id", "phone").join(u, "phone", "left").select("id", "category")


_XY = "(lng + 51.2) * 96000::DOUBLE"


@query("c21_offset_blocks", f"WITH x AS (SELECT id, number, source, {_XY} AS x, (lat + 30) * 111000::DOUBLE AS y FROM poi WHERE number <> '') SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.number = b.number AND a.id < b.id AND a.source <> b.source WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 150")
def c21(t: Tables) -> DataFrame:
    r = t.poi.filter("number <> ''").select("id", "number", "source", ((F.col("lng") + 51.2) * 96000.0).alias("x"), ((F.col("lat") + 30) * 111000.0).alias("y"))
    return joins.offset_block_pairs(r, 150.0, 5000, "source")


@query(
    "c22_substitution_pairs",
    f"""WITH n AS (SELECT DISTINCT city, name, {WORDS.format('name')} AS w FROM poi), p AS (SELECT a.city, a.name AS a, b.name AS b, a.w AS x, b.w AS y, list_filter(range(1, len(a.w) + 1), lambda i: a.w[i] <> b.w[i]) AS odd FROM n a JOIN n b ON a.city = b.city AND a.name < b.name AND len(a.w) = len(b.w))
SELECT city, a, b, x[odd[1]] AS word_a, y[odd[1]] AS word_b FROM p WHERE len(odd) = 1""",
)
def c22(t: Tables) -> DataFrame:
    return joins.substitution_pairs(t.poi.select("city", "name"), ["city"])


both("c23_latest_row", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) q WHERE rn = 1")


@query("c24_unnest", "SELECT conv_id, turn, unnest(string_split(role, 's')) AS piece FROM conversations")
def c24(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.explode(F.split("role", "s")).alias("piece"))


both("c25_values_update", "SELECT n.n_nationkey, coalesce(v.label, n.n_name) AS n_name FROM nation n LEFT JOIN (VALUES (1, 'one'), (2, 'two')) AS v(k, label) ON v.k = n.n_nationkey")
both("c26_record_assembly", "SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey")


@query("c27_nearest_in_box", "WITH p AS (SELECT a.id AS a_id, b.id AS b_id, pow(a.lat - b.lat, 2) + pow(a.lng - b.lng, 2) AS d FROM poi a JOIN door b ON abs(a.lat - b.lat) <= 0.0004 AND abs(a.lng - b.lng) <= 0.0004) SELECT a_id, min_by(b_id, d + b_id * 1e-18) AS b_id FROM p GROUP BY a_id")
def c27(t: Tables) -> DataFrame:
    p = joins.within(t.poi, t.door, 70.0)
    a, b = t.poi.select(F.col("id").alias("a_id"), F.col("lat").alias("y"), F.col("lng").alias("x")), t.door.select(F.col("id").alias("b_id"), "lat", "lng")
    p = p.join(a, "a_id").join(b, "b_id").filter("abs(y - lat) <= 0.0004 AND abs(x - lng) <= 0.0004")
    d = F.pow(F.col("y") - F.col("lat"), 2.0) + F.pow(F.col("x") - F.col("lng"), 2.0) + F.col("b_id") * 1e-18
    return p.groupBy("a_id").agg(F.min_by("b_id", d).alias("b_id"))


@query("c28_anchored_date", "SELECT event_id, (ts - to_days((event_id % 400)::INT))::DATE AS day FROM events")
def c28(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_sub("ts", (F.col("event_id") % 400).cast("int")).alias("day"))


both("c29_range_join", "SELECT p.p_partkey, v.section FROM part p JOIN (VALUES (1, 10, 'A'), (11, 25, 'B'), (26, 40, 'C')) AS v(lo, hi, section) ON p.p_size BETWEEN v.lo AND v.hi")
