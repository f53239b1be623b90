"""Rule and scoring operators (H7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.functions import nested
from geomill.operators import gaps, rules

from .inputs import Tables
from .registry import both, query

_FLAGS = "id, id % 2 = 0 AS street, id % 3 = 0 AS number, id % 5 = 0 AS near, id % 4 < 2 AS roof, id % 7 = 0 AS shop, id % 11 <> 0 AS proven"


def flags(t: Tables) -> DataFrame:
    i = F.col("id")
    return t.poi.select("id", (i % 2 == 0).alias("street"), (i % 3 == 0).alias("number"), (i % 5 == 0).alias("near"), (i % 4 < 2).alias("roof"), (i % 7 == 0).alias("shop"), (i % 11 != 0).alias("proven"))


@query("h702_link_confidence", f"WITH f AS (SELECT {_FLAGS} FROM poi), v AS (SELECT *, CASE WHEN street AND number THEN 70 WHEN street THEN 35 ELSE 10 END + roof::INT * 20 + shop::INT * 5 + near::INT * 5 AS v FROM f) SELECT id, least(CASE WHEN NOT proven AND (street OR number) THEN least(v, 60) ELSE v END, 100)::DOUBLE / 100 AS confidence FROM v")
def h702(t: Tables) -> DataFrame:
    c = rules.link_confidence(*[F.col(x) for x in ("street", "number", "near", "roof", "shop", "proven")])
    return flags(t).select("id", c.alias("confidence"))


@query(
    "h703_accept_links",
    """WITH c AS (SELECT id AS poi, id % 100 AS connection, CASE WHEN id % 8 = 0 THEN 'airbnb' ELSE 'maps' END AS source, CASE WHEN id % 13 = 0 THEN 'sala vaga' ELSE lower(split_part(name, ' ', 1)) END AS name,
 id % 2 = 0 AS street, id % 3 = 0 AS number, id % 4 < 2 AS roof, id % 5 <> 0 AS area, id % 17 <> 0 AS fit FROM poi),
r AS (SELECT *, CASE WHEN NOT fit OR name = 'sala vaga' THEN NULL WHEN source = 'airbnb' AND street AND roof AND area THEN 'rental_street_roof' WHEN source <> 'airbnb' AND street AND number AND area THEN 'exact_address' END AS reason FROM c)
SELECT poi, coalesce(reason, CASE WHEN fit AND street AND roof AND area AND EXISTS (SELECT 1 FROM r a WHERE a.connection = r.connection AND a.reason = 'exact_address' AND a.name = r.name) THEN 'anchor_name' END) AS reason FROM r""",
)
def h703(t: Tables) -> DataFrame:
    i = F.col("id")
    c = t.poi.select(
        i.alias("poi"), (i % 100).alias("connection"), F.when(i % 8 == 0, "airbnb").otherwise("maps").alias("source"), F.when(i % 13 == 0, "sala vaga").otherwise(F.lower(F.split_part("name", F.lit(" "), F.lit(1)))).alias("name"),
        (i % 2 == 0).alias("street"), (i % 3 == 0).alias("number"), (i % 4 < 2).alias("roof"), (i % 5 != 0).alias("area"), (i % 17 != 0).alias("fit"), F.lit(False).alias("inactive"))
    return rules.accept_links(c).select("poi", "reason")


_SCORE = "SELECT id, (CASE WHEN id % 20 < 10 THEN 15 ELSE 0 END + CASE WHEN id % 4 < 2 AND id % 7 = 0 THEN 10 WHEN id % 4 < 2 THEN 5 ELSE 0 END + CASE id % 3 WHEN 0 THEN CASE WHEN id % 2 = 0 THEN 20 ELSE 5 END WHEN 1 THEN CASE WHEN id % 2 = 0 THEN 5 ELSE 2 END ELSE 0 END + CASE WHEN id % 500 <= 365 THEN 10 ELSE 0 END + CASE WHEN id % 6 = 0 THEN 10 ELSE 0 END + CASE WHEN id % 300 <= 182 THEN 15 ELSE 0 END)::INT AS score FROM poi"


@query("h704_connection_score", _SCORE)
def h704(t: Tables) -> DataFrame:
    i = F.col("id")
    d = t.poi.select("id", (i % 20).alias("m"), (i % 4 < 2).alias("roof"), (i % 7 == 0).alias("shop_roof"), F.element_at(F.array(F.lit("Exact"), F.lit("shop"), F.lit("none")), (i % 3 + 1).cast("int")).alias("presence"), (i % 2 == 0).alias("view_recent"), (i % 500).alias("review_days"), (i % 6 == 0).alias("photos_ok"), (i % 300).alias("post_days"))
    return rules.connection_score(d).select("id", F.col("score").cast("int").alias("score"))


@query("h705_official_status", "SELECT id, CASE WHEN id % 9 = 0 THEN 'NO' WHEN id % 5 = 0 OR (id % 2 = 1 AND id % 4 >= 2) THEN 'YES_WITH_REVIEW' ELSE 'YES' END AS status FROM poi")
def h705(t: Tables) -> DataFrame:
    i = F.col("id")
    return t.poi.select("id", rules.official_status(F.when(i % 9 == 0, "rejected_1").otherwise("ok"), i % 4 < 2, i % 2 == 0, i % 5 == 0).alias("status"))


@query("h706_existence_score", "WITH s AS (SELECT id, greatest(0, least(15, CASE WHEN id % 2 = 0 THEN 6 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 4 ELSE 0 END + CASE WHEN id % 5 = 0 THEN 6 ELSE 0 END + CASE WHEN id % 7 = 0 THEN -1 ELSE 0 END))::INT AS score, concat_ws(' | ', CASE WHEN id % 2 = 0 THEN 'name' END, CASE WHEN id % 3 = 0 THEN 'phone' END, CASE WHEN id % 5 = 0 THEN 'site' END, CASE WHEN id % 7 = 0 THEN 'closed' END) AS why FROM poi) SELECT *, CASE WHEN score >= 9 THEN 'certain' WHEN score >= 6 THEN 'likely' WHEN score >= 4 THEN 'possible' ELSE 'weak' END AS band FROM s")
def h706(t: Tables) -> DataFrame:
    i = F.col("id")
    score, why = rules.score_with_reasons([(i % 2 == 0, 6, "name"), (i % 3 == 0, 4, "phone"), (i % 5 == 0, 6, "site"), (i % 7 == 0, -1, "closed")], 0, 15)
    return t.poi.select("id", score.cast("int").alias("score"), why.alias("why")).withColumn("band", rules.bands(F.col("score"), [(9, "certain"), (6, "likely"), (4, "possible")], "weak"))


@query("h713_keyword_class", "SELECT id, CASE WHEN regexp_matches(lower(name), 'padaria|bar') THEN 'food' WHEN regexp_matches(lower(name), 'farmacia') THEN 'health' ELSE 'other' END AS sector FROM poi")
def h713(t: Tables) -> DataFrame:
    return t.poi.select("id", rules.keyword_class(F.col("name"), [("padaria|bar", "food"), ("farmacia", "health")], "other").alias("sector"))


both("h715_ordered_rules", "SELECT street, number, CASE WHEN n >= 6 THEN 'mall' WHEN n >= 4 AND k > 1 THEN 'gallery' WHEN n >= 2 THEN 'shared' ELSE 'single' END AS kind FROM (SELECT street, number, count(*) AS n, count(DISTINCT category) AS k FROM poi GROUP BY street, number) q")


@query("h716_anomaly_signals", "WITH r AS (SELECT id, street, id % 300 AS place, CASE WHEN id % 9 <> 0 THEN id % 40 END AS number, name, city AS sector FROM poi), s AS (SELECT place, count(DISTINCT street) >= 3 AS s1 FROM r GROUP BY place), q AS (SELECT street, count(number) >= 5 AND max(number) - min(number) + 1 = count(number) AND count(DISTINCT number) = count(number) AS s2 FROM r GROUP BY street), n AS (SELECT sector, name, count(name) >= 10 AS s3 FROM r GROUP BY sector, name), c AS (SELECT sector, count(number) * 100 >= count(*) * 99 AS s4 FROM r GROUP BY sector) SELECT id, s1, s2, s3, s4 FROM r JOIN s USING (place) JOIN q USING (street) JOIN n USING (sector, name) JOIN c USING (sector)")
def h716(t: Tables) -> DataFrame:
    i = F.col("id")
    r = t.poi.select("id", "street", (i % 300).alias("place"), F.when(i % 9 != 0, i % 40).alias("number"), "name", F.col("city").alias("sector"))
    return rules.anomaly_signals(r).select("id", "s1", "s2", "s3", "s4")


_UNITS = "SELECT city AS building, CAST((id % 6 + 1) * 100 + id % 5 + 1 AS INT) AS unit FROM poi WHERE id % 8 = 3"


@query("h719_unit_grid", f"WITH u AS (SELECT DISTINCT building, unit // 100 AS f, unit % 100 AS p FROM ({_UNITS})), s AS (SELECT building, min(f) AS f0, max(f) AS f1, min(p) AS p0, max(p) AS p1 FROM u GROUP BY building), g AS (SELECT building, f, unnest(range(p0, p1 + 1)) AS p FROM (SELECT building, p0, p1, unnest(range(f0, f1 + 1)) AS f FROM s)), o AS (SELECT building, f, min(p) AS q0, max(p) AS q1 FROM u GROUP BY building, f) SELECT g.building, (g.f * 100 + g.p)::INT AS unit, CASE WHEN q0 IS NULL THEN 'B' WHEN g.p BETWEEN q0 AND q1 THEN 'A' ELSE 'C' END AS grade FROM g LEFT JOIN u ON u.building = g.building AND u.f = g.f AND u.p = g.p LEFT JOIN o ON o.building = g.building AND o.f = g.f WHERE u.building IS NULL")
def h719(t: Tables) -> DataFrame:
    i = F.col("id")
    return rules.unit_grid(t.poi.filter("id % 8 = 3").select(F.col("city").alias("building"), ((i % 6 + 1) * 100 + i % 5 + 1).cast("int").alias("unit")))


GRID = "SELECT o_custkey AS building, CAST((CAST(FLOOR(o_orderkey / 3) AS BIGINT) * 5 % 9 + 1) * 100 + o_orderkey * 7 % 5 AS BIGINT) AS unit FROM orders"


@query(
    "h719_graded_units",
    f"""WITH u AS (SELECT DISTINCT building, unit, unit // 100 AS f, unit % 100 AS p FROM ({GRID}) q), b AS (SELECT building, count(*) AS n, count(DISTINCT f) AS nf, min(f) AS f0, max(f) AS f1 FROM u GROUP BY building HAVING count(*) >= 3),
o AS (SELECT building, f, min(p) AS lo, max(p) AS hi FROM u JOIN b USING (building) GROUP BY building, f), pl AS (SELECT DISTINCT building, p FROM u WHERE p > 0),
g AS (SELECT o.*, pl.p FROM o JOIN pl USING (building) WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.building = o.building AND u.f = o.f AND u.p = pl.p)),
k AS (SELECT *, count(*) OVER (PARTITION BY building) AS absent FROM g),
ac AS (SELECT building, f * 100 + k.p AS unit, lo < k.p AND k.p < hi AS inside, CASE WHEN k.p > hi THEN k.p - hi ELSE lo - k.p END AS steps FROM k JOIN b USING (building) WHERE absent <= 3 * n)
SELECT building, unit, CASE WHEN inside THEN 'A' ELSE 'C' END AS kind, CASE WHEN inside THEN 'SUSTENTADA' WHEN steps <= 2 THEN 'PLAUSIVEL' ELSE 'ESPECULATIVA' END AS grade, CASE WHEN NOT inside THEN steps END AS steps FROM ac
UNION ALL SELECT x.building, (x.f + 1) * 100 + x.p, 'B', 'SUSTENTADA', NULL FROM u x JOIN u y ON y.building = x.building AND y.f = x.f + 2 AND y.p = x.p JOIN b ON b.building = x.building
WHERE NOT EXISTS (SELECT 1 FROM u z WHERE z.building = x.building AND z.f = x.f + 1) AND b.f1 - b.f0 + 1 - b.nf <= greatest(1, floor(0.3 * b.nf))""",
)
def h719b(t: Tables) -> DataFrame:
    return gaps.unit_gaps(t.sql(GRID))


PLACES = "SELECT o_custkey AS address, o_orderkey AS id, CASE o_orderkey % 11 WHEN 0 THEN 'frente' WHEN 1 THEN 'FUNDOS' WHEN 2 THEN 'DIR' WHEN 3 THEN 'Lado Esquerdo' ELSE '' END AS word, o_custkey % 3 = 0 OR o_orderkey % 5 > 0 AS described FROM orders WHERE o_custkey % 2 = 0 OR o_orderkey % 11 < 3"


@query("h719_positions", f"WITH r AS (SELECT address, upper(word) AS w, described FROM ({PLACES}) q), s AS (SELECT *, 'FRENTE' AS a, 'FUNDOS' AS b FROM r UNION ALL SELECT address, CASE w WHEN 'DIR' THEN 'LADO DIREITO' ELSE w END, described, 'LADO DIREITO', 'LADO ESQUERDO' FROM r), g AS (SELECT address, a, b, bool_or(w = a) AS x, bool_or(w = b) AS y, count(*) FILTER (WHERE w <> a) AS na, count(*) FILTER (WHERE w <> b) AS nb, count(*) FILTER (WHERE w <> a AND NOT described) AS ba, count(*) FILTER (WHERE w <> b AND NOT described) AS bb FROM s GROUP BY address, a, b), k AS (SELECT address, CASE WHEN x THEN b ELSE a END AS missing, CASE WHEN CASE WHEN x THEN na ELSE nb END = 0 THEN 'D' WHEN CASE WHEN x THEN ba ELSE bb END > 0 THEN 'F' ELSE 'E' END AS kind FROM g WHERE x <> y) SELECT *, CASE kind WHEN 'D' THEN 'SUSTENTADA' WHEN 'E' THEN 'PLAUSIVEL' ELSE 'ESPECULATIVA' END AS grade FROM k")
def h719c(t: Tables) -> DataFrame:
    return gaps.position_gaps(t.sql(PLACES).withColumn("positions", F.array("word")))


LOTS = "SELECT CAST(FLOOR(o_custkey / 20) AS BIGINT) AS address, CASE WHEN o_orderkey % 13 = 0 THEN 'x' ELSE CAST(o_custkey % 5 * 2 AS VARCHAR(10)) END AS block, CASE WHEN o_orderkey % 17 > 0 THEN CAST(o_orderkey % 6 AS VARCHAR(10)) END AS lot, CAST(CAST(FLOOR(o_orderkey / 7) AS BIGINT) % 12 AS VARCHAR(10)) AS house FROM orders"


def _linear(by: str, value: str) -> str:
    return f"SELECT {by}, lo + unnest(range(1, gap)) AS missing FROM (SELECT {by}, v AS lo, lead(v) OVER (PARTITION BY {by} ORDER BY v) - v AS gap, count(*) OVER (PARTITION BY {by}) AS n, max(v) OVER (PARTITION BY {by}) - min(v) OVER (PARTITION BY {by}) + 1 AS span FROM (SELECT DISTINCT {by}, {value} AS v FROM r WHERE {value} IS NOT NULL) q) q WHERE gap > 1 AND span - n <= 3 * n"


@query("h719_block_lot", f"WITH r AS (SELECT address, coalesce(block, '') AS block, coalesce(lot, '') AS lot, TRY_CAST(block AS BIGINT) AS b, TRY_CAST(lot AS BIGINT) AS l, TRY_CAST(house AS BIGINT) AS h FROM ({LOTS}) q) SELECT address, NULL::VARCHAR AS block, NULL::VARCHAR AS lot, 'block' AS level, missing FROM ({_linear('address', 'b')}) x UNION ALL SELECT address, block, NULL, 'lot', missing FROM ({_linear('address, block', 'l')}) y UNION ALL SELECT address, block, lot, 'house', missing FROM ({_linear('address, block, lot', 'h')}) z")
def h719d(t: Tables) -> DataFrame:
    return gaps.block_lot_gaps(t.sql(LOTS))


@query("h720_inferred_rows", "WITH v AS (SELECT street, list_sort(list(DISTINCT number)) AS v FROM door GROUP BY street) SELECT street, unnest(list_filter(range(v[1], v[-1] + 1), lambda x: NOT list_contains(v, x))) AS number, NULL::DOUBLE AS lat FROM v WHERE len(v) > 1 AND v[-1] - v[1] + 1 <= 3 * len(v)")
def h720(t: Tables) -> DataFrame:
    v = t.door.groupBy("street").agg(F.array_sort(F.collect_set("number")).alias("v"))
    return v.select("street", F.explode(nested.gaps(F.col("v"))).alias("number"), F.lit(None).cast("double").alias("lat"))


@query("h725_exclusivity", "WITH v AS (SELECT id % 200 AS poi, id AS connection, id % 5 = 0 AS unit_match, CASE WHEN id % 200 < 50 THEN 'x' ELSE street END AS address FROM poi), g AS (SELECT poi, count(*) AS n, sum(unit_match::INT) AS m, count(DISTINCT address) AS a FROM v GROUP BY poi) SELECT poi, connection, CASE WHEN n = 1 THEN true WHEN m = 1 THEN unit_match WHEN a = 1 THEN true ELSE false END AS kept FROM v JOIN g USING (poi)")
def h725(t: Tables) -> DataFrame:
    i = F.col("id")
    return rules.exclusivity(t.poi.select((i % 200).alias("poi"), i.alias("connection"), (i % 5 == 0).alias("unit_match"), F.when(i % 200 < 50, "x").otherwise(F.col("street")).alias("address")))


