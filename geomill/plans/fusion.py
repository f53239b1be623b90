"""Entity resolution, location cascades and lexicon (I, J, K)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.functions import text
from geomill.operators import address, areas, cluster, dedup, fusion, joins, lexicon
from geomill.operators.stages import keeper

from .inputs import Tables
from .joins import IN_AREAS, METRES, NEAR, WORDS, core, quarter_areas
from .registry import both, query

_HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))"
_TOK = "list_distinct(list_filter(" + WORDS + ", lambda x: length(x) > 2))"
_PAIRS = f"SELECT * FROM ({NEAR}) UNION SELECT a.id, b.id FROM poi a JOIN poi b ON a.name = b.name AND a.street = b.street AND a.id < b.id"
DECIDED = f"""
WITH c AS ({_PAIRS}),
e AS (SELECT a.id AS a, b.id AS b, {_HAV} AS m, lower(a.street) = lower(b.street) AS street, a.number <> '' AND a.number = b.number AS number, a.number <> '' AND b.number <> '' AS numbers,
  CASE WHEN least(len({_TOK.format('a.name')}), len({_TOK.format('b.name')})) < 2 THEN (lower(a.name) = lower(b.name))::INT::DOUBLE
    ELSE len(list_intersect({_TOK.format('a.name')}, {_TOK.format('b.name')})) / (len({_TOK.format('a.name')}) + len({_TOK.format('b.name')}) - len(list_intersect({_TOK.format('a.name')}, {_TOK.format('b.name')}))) END AS s,
  a.site <> 'nan' AND a.site = b.site AS site, regexp_replace(a.phone, '[^0-9]', '', 'g') = regexp_replace(b.phone, '[^0-9]', '', 'g') AS phone, a.category = b.category AS category
  FROM c JOIN poi a ON a.id = c.a JOIN poi b ON b.id = c.b),
p AS (SELECT *, CASE WHEN street AND number THEN 5 WHEN street THEN 2 ELSE 0 END + CASE WHEN site AND m <= 20 THEN 4 ELSE 0 END + CASE WHEN phone AND m <= 20 THEN 2 ELSE 0 END + CASE WHEN s >= 0.8 THEN 3 ELSE 0 END + CASE WHEN category THEN 1 ELSE 0 END AS points FROM e),
d AS (SELECT *, CASE WHEN phone AND m <= 20 AND points = 2 THEN 'discard' WHEN street AND s >= 0.85 AND (number OR (NOT numbers AND m <= 1000)) THEN 'merge' WHEN points >= 8 THEN 'merge' WHEN points >= 4 THEN 'ask' WHEN street AND m <= 20 THEN 'ask' ELSE 'discard' END AS decision FROM p)
SELECT a, b, points, decision FROM d"""


def decided(t: Tables) -> DataFrame:
    p = t.poi
    pairs = joins.near_pairs(p, 0.001).unionByName(joins.key_pairs(p, ["name", "street"])).dropDuplicates(["a", "b"])
    return fusion.score_pairs(fusion.both_sides(pairs, fusion.prepared(p)))


@query("i01_pair_decisions", DECIDED)
def i01(t: Tables) -> DataFrame:
    return decided(t).select("a", "b", "points", "decision")


@query("h701_pair_evidence", f"SELECT decision, count(*) AS n, max(points) AS top FROM ({DECIDED}) q GROUP BY decision")
def h701(t: Tables) -> DataFrame:
    return decided(t).groupBy("decision").agg(F.count("*").alias("n"), F.max("points").alias("top"))


@query("i02_survivors", "SELECT street AS component, id AS survivor FROM (SELECT street, id, row_number() OVER (PARTITION BY street ORDER BY (place LIKE '%:%')::INT, -evidence, id::VARCHAR) AS rn FROM poi) q WHERE rn = 1")
def i02(t: Tables) -> DataFrame:
    return fusion.survivors(t.poi.select(F.col("street").alias("component"), "id", "place", "evidence"))


@query("i03_fused_components", f"WITH RECURSIVE x AS (SELECT a, b FROM ({DECIDED}) q WHERE decision = 'merge'), s AS (SELECT a, b FROM x UNION SELECT b, a FROM x), r(id, c) AS (SELECT a, a FROM s UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.id) SELECT id, min(c) AS component FROM r GROUP BY id")
def i03(t: Tables) -> DataFrame:
    return fusion.components(decided(t).filter("decision = 'merge'").select("a", "b"), keeper(t.spark))


@query("i04_unmerge", "SELECT id FROM poi WHERE id % 6 = 1 AND NOT (evidence >= 2) AND name NOT IN (SELECT name FROM poi WHERE id % 6 = 0)")
def i04(t: Tables) -> DataFrame:
    p = t.poi
    return fusion.unmerge(p.filter("id % 6 = 1"), p.filter("id % 6 = 0"), F.col("evidence") >= 2).select("id")


def ordered(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = decided(t).filter("decision = 'merge'").select("a", "b", F.col("points").alias("confidence"))
    return d, t.poi.select("id", "place", "evidence", "source", F.nullif("phone", F.lit("")).alias("phone"))


@query("i03_ordered_fusion")
def i03b(t: Tables) -> DataFrame:
    keep = keeper(t.spark)
    return fusion.destinations(fusion.fuse_in_order(*ordered(t), keep), keep)


@query("i03_constrained_fusion")
def i03c(t: Tables) -> DataFrame:
    return fusion.fuse_in_order(*ordered(t), keeper(t.spark), apart=["source"], same=["phone"])


@query("i04_withdrawn_decisions")
def i04b(t: Tables) -> DataFrame:
    keep = keeper(t.spark)
    d, records = ordered(t)
    d, log = keep(d), fusion.fuse_in_order(d, records, keep)
    return fusion.without(d, d.filter("(a + b) % 7 = 0"), log, records, keep)


@query("i05_same_source", "WITH e AS (SELECT a.id AS a, b.id AS b FROM poi a JOIN poi b ON a.source = b.source AND a.phone = b.phone AND a.id < b.id AND lower(a.name) = lower(b.name)), f AS (SELECT b AS id, min(a) AS m FROM e GROUP BY b) SELECT e.b AS id, e.a AS dest FROM e JOIN f ON f.id = e.b AND f.m = e.a")
def i05(t: Tables) -> DataFrame:
    return fusion.same_source(t.poi, keeper(t.spark), ["source", "phone"]).select("id", F.col("into").alias("dest"))


@query("i06_co_located", "SELECT list_sort(list(id)) AS ids, count(*) AS n FROM (SELECT id, lower(split_part(name, ' ', 1)) AS name, floor(lat / 200 * 100000.0::DOUBLE + 0.5) AS y, floor(lng / 200 * 100000.0::DOUBLE + 0.5) AS x FROM poi) q GROUP BY name, y, x HAVING count(*) > 1")
def i06(t: Tables) -> DataFrame:
    p = t.poi.select("id", F.split_part("name", F.lit(" "), F.lit(1)).alias("name"), (F.col("lat") / 200).alias("lat"), (F.col("lng") / 200).alias("lng"))
    return fusion.co_located(p).select("ids", "n")


@query("i07_diameter_guard", f"SELECT a, b FROM ({DECIDED}) q JOIN poi x ON x.id = a JOIN poi y ON y.id = b WHERE decision = 'merge' AND regexp_replace(x.phone, '[^0-9]', '', 'g') <> regexp_replace(y.phone, '[^0-9]', '', 'g') AND {METRES.replace('a.', 'x.').replace('b.', 'y.')} > 85")
def i07(t: Tables) -> DataFrame:
    d = decided(t).filter("decision = 'merge'")
    from geomill.functions import geo

    far = geo.metres(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")) > 85
    return d.filter(far & (F.col("a_phone_key") != F.col("b_phone_key"))).select("a", "b")


@query("i07_dedup_by_evidence")
def i07b(t: Tables) -> DataFrame:
    return dedup.dedup(t.poi.select("id", "name", F.col("category").alias("segment"), F.lit(None).cast("string").alias("brand"), "phone", "site", "lat", "lng"), keeper(t.spark))


@query("i09_upsert", "WITH t AS (SELECT id, name, site FROM poi WHERE id % 3 <> 1), n AS (SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE upper(name) END AS name, CASE WHEN id % 2 = 0 THEN 'new' END AS site FROM poi WHERE id % 4 <> 1) SELECT coalesce(n.id, t.id) AS id, coalesce(nullif(trim(n.name), ''), t.name) AS name, coalesce(n.site, t.site) AS site FROM t FULL OUTER JOIN n ON t.id = n.id")
def i09(t: Tables) -> DataFrame:
    p = t.poi.select("id", "name", "site")
    new = p.filter("id % 4 <> 1").select("id", F.when(F.col("id") % 3 == 0, "").otherwise(F.upper("name")).alias("name"), F.when(F.col("id") % 2 == 0, "new").alias("site"))
    return fusion.upsert(p.filter("id % 3 <> 1"), new, ["id"])


both("i08_source_links", "SELECT DISTINCT id AS poi, source, concat(source, ':', CAST(id AS VARCHAR(20))) AS source_id FROM poi UNION SELECT id, 'src9', concat('src9:', CAST(id AS VARCHAR(20))) FROM poi WHERE id % 3 = 0")
both("i11_unique_live_rows", "SELECT name, street, count(*) AS n FROM poi WHERE id % 7 <> 0 GROUP BY name, street HAVING count(*) > 1")


@query("i14_reuse", "SELECT id AS old_id, 5000 + row_number() OVER (ORDER BY id) - 1 AS new_id FROM poi WHERE id % 4 = 1 AND phone NOT IN (SELECT phone FROM poi WHERE id % 40 = 0)")
def i14(t: Tables) -> DataFrame:
    p = t.poi
    return fusion.reuse(p.filter("id % 4 = 1"), p.filter("id % 40 = 0"), 5000, "phone")


# ---- location ----------------------------------------------------------------------------------
_XY_METRES = METRES.replace("a.", "x.").replace("b.", "y.")
_STREETS = f"""WITH one AS (SELECT postcode, min(street) AS found FROM door GROUP BY postcode HAVING count(DISTINCT street) = 1), a AS (SELECT p.id, found AS street, 'postcode' AS how FROM poi p JOIN one USING (postcode)),
named AS (SELECT {core('street')} AS k, min(street) AS found FROM door GROUP BY 1), b AS (SELECT p.id, found AS street, 'written' AS how FROM poi p JOIN named ON k = {core('p.street')} WHERE p.id NOT IN (SELECT id FROM a)),
done AS (SELECT id FROM a UNION ALL SELECT id FROM b),
c AS (SELECT x.id, y.street, row_number() OVER (PARTITION BY x.id ORDER BY {_XY_METRES}, y.street) AS rn FROM poi x JOIN door y ON abs(x.lat - y.lat) < 0.0003 AND abs(x.lng - y.lng) < 0.0004 WHERE {_XY_METRES} <= 20 AND x.id NOT IN (SELECT id FROM done))"""


@query("j01_resolve_street", _STREETS + " SELECT * FROM a")
def j01(t: Tables) -> DataFrame:
    return j01b(t).filter("how = 'postcode'")


@query("j01_resolve_cascade", _STREETS + " SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT id, street, 'nearest' AS how FROM c WHERE rn = 1")
def j01b(t: Tables) -> DataFrame:
    return address.resolve_street(t.poi.select("id", "street", "postcode", "lat", "lng"), t.door.select("street", "postcode", "lat", "lng"))


@query("j02_fuzzy_street")
def j02(t: Tables) -> DataFrame:
    rows = t.poi.select("id", F.col("postcode").alias("block"), F.concat(F.col("street"), F.lit("s")).alias("name"))
    return address.fuzzy_street(rows, t.door.select(F.col("postcode").alias("block"), "street"), 80.0)


@query(
    "j04_match_address",
    """WITH r AS (SELECT id, postcode, street, city, number FROM door), p AS (SELECT id, postcode, street, city, try_cast(nullif(number, '') AS BIGINT) AS number FROM poi),
s1 AS (SELECT p.id, min(r.id) AS right_id, 'exact' AS step, 0::BIGINT AS apart FROM p JOIN r ON r.postcode = p.postcode AND r.street = p.street AND r.number = p.number GROUP BY p.id) SELECT * FROM s1""",
)
def j04(t: Tables) -> DataFrame:
    r = t.door.select("id", "postcode", "street", text.street_core(F.col("street")).alias("core"), "city", "number")
    p = t.poi.select("id", "postcode", "street", text.street_core(F.col("street")).alias("core"), "city", F.col("number").try_cast("bigint").alias("number"))
    return address.match_address(p, r, keeper(t.spark)).filter("step = 'exact'")


@query("j04_match_passes")
def j04b(t: Tables) -> DataFrame:
    r = t.door.select("id", "postcode", "street", text.street_core(F.col("street")).alias("core"), "city", "number")
    p = t.poi.select("id", "postcode", "street", text.street_core(F.col("street")).alias("core"), "city", F.col("number").try_cast("bigint").alias("number"))
    return address.match_address(p, r, keeper(t.spark))


@query("j05_deviation", "SELECT id, round(sqrt(pow((evidence + 1) * 10, 2) + pow(evidence * 6.0, 2)), 4) AS m FROM poi")
def j05(t: Tables) -> DataFrame:
    return t.poi.select("id", F.round(address.deviation_m((F.col("evidence") + 1) * 10, F.col("evidence"), F.lit(6.0)), 4).alias("m"))


@query("j07_reverse_door", f"WITH p AS (SELECT a.id, b.id AS door, {METRES} AS m FROM poi a JOIN door b ON abs(a.lat - b.lat) < 0.0006 AND abs(a.lng - b.lng) < 0.0007), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY m, door) AS rn FROM p WHERE m <= 50) SELECT id, door, round(m, 3) AS m FROM r WHERE rn = 1")
def j07(t: Tables) -> DataFrame:
    return address.reverse_door(t.poi, t.door).withColumn("m", F.round("m", 3))


@query("j09_conformity", "SELECT id, CASE WHEN id % 7 = 0 THEN 'unknown' WHEN id % 100 <= 3 * (evidence + 1) * 5 THEN 'confirmed' ELSE 'disagrees' END AS verdict FROM poi")
def j09(t: Tables) -> DataFrame:
    i = F.col("id")
    return t.poi.select("id", address.conformity(F.when(i % 7 != 0, i % 100), (F.col("evidence") + 1) * 5).alias("verdict"))


@query("j11_foreign_city", "SELECT p.id FROM poi p JOIN (SELECT postcode, min(city) AS owner FROM door GROUP BY postcode) o USING (postcode) WHERE o.owner <> p.city")
def j11(t: Tables) -> DataFrame:
    owners = t.door.groupBy("postcode").agg(F.min("city").alias("owner"))
    return address.foreign_city(t.poi.select("id", "city", F.array("postcode").alias("postcodes")), owners)


@query("j12_first_donor", "SELECT p.id, coalesce(a.lat, b.lat) AS lat, CASE WHEN a.lat IS NOT NULL THEN 'door' WHEN b.lat IS NOT NULL THEN 'twin' END AS donor FROM (SELECT id FROM poi) p LEFT JOIN door a ON a.id = p.id LEFT JOIN (SELECT id, lat FROM poi WHERE id % 2 = 0) b ON b.id = p.id")
def j12(t: Tables) -> DataFrame:
    p = t.poi
    return address.first_donor(p.select("id"), [("door", t.door, "id"), ("twin", p.filter("id % 2 = 0"), "id")]).select("id", "lat", "donor")


@query("j13_area_of_point", "WITH c AS (SELECT postcode AS id, avg(lat) AS lat, avg(lng) AS lng FROM poi GROUP BY postcode) SELECT id, CASE WHEN lat > -29.995 AND lat <= -29.985 AND lng >= -51.195 AND lng < -51.185 THEN 'centre' ELSE 'triangle' END AS name FROM c WHERE (lat > -29.995 AND lat < -29.985 AND lng > -51.195 AND lng < -51.185) OR (lat >= -30.0 AND lng >= -51.2 AND lat + 30.0 + lng + 51.2 < 0.01)")
def j13(t: Tables) -> DataFrame:
    from .joins import polygons

    return joins.in_polygons(t.poi.groupBy(F.col("postcode").alias("id")).agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng")), polygons(t))


@query("j13_all_areas_of_point", f"SELECT i.name, count(DISTINCT p.postcode) AS postcodes FROM ({IN_AREAS}) i JOIN poi p ON p.id = i.id WHERE i.name NOT LIKE 'slope%' GROUP BY i.name")
def j13b(t: Tables) -> DataFrame:
    inside = areas.points_in_polygons(t.poi.select("id", "lat", "lng"), quarter_areas(t).filter("name NOT LIKE 'slope%'"), keeper(t.spark))
    return inside.join(t.poi.select("id", "postcode"), "id").groupBy("name").agg(F.countDistinct("postcode").alias("postcodes"))


@query("i08_upserted_links", "WITH l AS (SELECT id % 500 AS poi, source, concat('k', CAST(id % 40 AS VARCHAR(10))) AS source_id, evidence AS confidence, CASE WHEN id % 6 = 0 THEN '' ELSE name END AS name, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS old FROM poi), r AS (SELECT *, row_number() OVER (PARTITION BY poi, source, source_id ORDER BY (name <> '') DESC, confidence DESC, old DESC, name DESC) AS rn, max(confidence) OVER (PARTITION BY poi, source, source_id) AS best FROM l) SELECT poi, source, source_id, best AS confidence, nullif(name, '') AS name FROM r WHERE rn = 1")
def i08b(t: Tables) -> DataFrame:
    links = t.poi.select((F.col("id") % 500).alias("poi"), "source", F.concat(F.lit("k"), (F.col("id") % 40).cast("string")).alias("source_id"), F.col("evidence").alias("confidence"), F.when(F.col("id") % 6 == 0, "").otherwise(F.col("name")).alias("name"), "id")
    return fusion.link_sources(links.filter("id % 2 = 0").drop("id"), links.filter("id % 2 = 1").drop("id"))


# ---- clusters ----------------------------------------------------------------------------------
@query("h509_hulls")
def h509(t: Tables) -> DataFrame:
    return cluster.hulls(t.poi, "city")


@query("h510_dbscan", f"WITH n AS (SELECT a.id AS a, b.id AS b, {_HAV} AS m FROM poi a JOIN poi b ON abs(a.lat - b.lat) < 0.0006 AND abs(a.lng - b.lng) < 0.0007), e AS (SELECT * FROM n WHERE m <= 55), c AS (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= 4) SELECT p.id, p.id IN (SELECT id FROM c) AS core, p.id IN (SELECT e.a FROM e JOIN c ON c.id = e.b) AS member FROM poi p")
def h510(t: Tables) -> DataFrame:
    c = cluster.dbscan(t.poi, 55.0, 4, keeper(t.spark))
    return c.select("id", "core", F.col("cluster").isNotNull().alias("member"))


# ---- lexicon -----------------------------------------------------------------------------------
@query("k01_candidates")
def k01(t: Tables) -> DataFrame:
    n = t.poi.select("city", F.when(F.col("id") % 2 == 0, F.replace(F.col("street"), F.lit("Brasil"), F.lit("Brazil"))).otherwise(F.col("street")).alias("name"))
    return lexicon.candidates(n, ["city"])


@query("k02_direction", "SELECT id, CASE WHEN id % 3 > id % 2 THEN 'a' WHEN id % 2 > id % 3 THEN 'b' WHEN id % 3 > 0 THEN 'conflict' WHEN id % 10 >= 3 AND id % 10 >= 3 * (id % 4) THEN 'a' WHEN id % 4 >= 3 AND id % 4 >= 3 * (id % 10) THEN 'b' ELSE 'undecided' END AS side FROM poi")
def k02(t: Tables) -> DataFrame:
    i = F.col("id")
    return t.poi.select("id", lexicon.direction(i % 3, i % 2, i % 10, i % 4).alias("side"))


@query("k03_independent_votes", f"WITH v AS (SELECT id, street AS rule, number, lat, lng FROM poi), b AS (SELECT DISTINCT a.id FROM v a JOIN v b ON a.rule = b.rule AND a.number = b.number AND b.id < a.id AND abs(a.lat - b.lat) < 0.006 AND abs(a.lng - b.lng) < 0.007 WHERE {METRES} <= 500) SELECT rule, count(*) AS support FROM v WHERE id NOT IN (SELECT id FROM b) GROUP BY rule")
def k03(t: Tables) -> DataFrame:
    return lexicon.independent_support(t.poi.select("id", F.col("street").alias("rule"), "number", "lat", "lng"), 500.0)


@query("k04_territory_update", "WITH s AS (SELECT city AS a, (city + id % 3)::INT AS b, count(*) AS support FROM poi GROUP BY 1, 2) SELECT s.a, s.b, s.support, CASE WHEN s.support >= 20 AND coalesce(r.support, 0) >= 20 THEN 'quarantined' WHEN s.support >= 20 THEN 'active' ELSE 'candidate' END AS state FROM s LEFT JOIN s r ON r.a = s.b AND r.b = s.a")
def k04(t: Tables) -> DataFrame:
    s = t.poi.groupBy(F.col("city").alias("a"), (F.col("city") + F.col("id") % 3).cast("int").alias("b")).agg(F.count("*").alias("support"))
    return lexicon.territory_update(s, 20)


@query("k05_decay", "WITH l AS (SELECT street AS rule, postcode, max(id) AS day FROM poi GROUP BY street, postcode), s AS (SELECT rule, round(sum(pow(0.5, (1500 - day) / 180.0)), 6) AS strength FROM l GROUP BY rule) SELECT rule, strength, CASE WHEN strength < 0.5 THEN 'archived' ELSE 'active' END AS state FROM s")
def k05(t: Tables) -> DataFrame:
    v = t.poi.select(F.col("street").alias("rule"), F.col("postcode").alias("property"), F.col("id").alias("day"))
    return lexicon.decayed(v, 1500).withColumn("strength", F.round("strength", 6))


@query("k06_equivalences", f"SELECT a.id AS a, b.id AS b, CASE WHEN {_HAV} <= 300 THEN 2 ELSE 1 END::INT AS degree FROM poi a JOIN poi b ON a.id // 20 = b.id // 20 AND a.id < b.id AND a.id % 2 <> b.id % 2")
def k06(t: Tables) -> DataFrame:
    s = t.poi.select("id", F.concat(F.when(F.col("id") % 2 == 0, "Ayrton Senna ").otherwise("Airton Sena "), F.floor(F.col("id") / 20).cast("string")).alias("name"), "lat", "lng")
    return lexicon.equivalences(s)


@query("k07_apply_lexicon", f"SELECT id, array_to_string(list_transform({WORDS.format('street')}, lambda w: CASE w WHEN 'r' THEN 'rua' WHEN 'brasil' THEN 'brazil' ELSE w END), ' ') AS clean FROM poi")
def k07(t: Tables) -> DataFrame:
    r = t.spark.createDataFrame([("r", "rua"), ("brasil", "brazil")], "word string, right string")
    return lexicon.apply_lexicon(t.poi.select("id", F.col("street").alias("name")), r).select("id", "clean")
