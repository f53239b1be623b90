"""Further scalar operators and rules of the groups H1 to H7, J and L."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.functions import geo, identifiers, similarity, text, values
from geomill.operators import audit, changes, cluster, joins, rules, tablefunctions, tagger
from geomill.operators.stages import keeper, spread

from .inputs import Tables, with_ctes
from .joins import METRES, core, polygons
from .registry import both, query


def table(t: Tables, rows: list[tuple], schema: str = "id int, w string") -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


@query("h108_clean_street", f"SELECT id, {core('street')} || ' (x' AS raw, {core('street')} AS core FROM poi")
def h108(t: Tables) -> DataFrame:
    raw = F.concat(text.street_core(F.col("street")), F.lit(" (x"))
    return t.poi.select("id", raw.alias("raw"), text.tidy_street(raw).alias("core"))


@query("h109_title_position", "SELECT id, CASE WHEN id % 2 = 0 THEN 'rua doutor silva' ELSE 'rua silva dr' END AS clean FROM poi")
def h109(t: Tables) -> DataFrame:
    # a title is spelt out only right after the type
    raw = F.when(F.col("id") % 2 == 0, "R. Dr. Silva").otherwise("R. Silva Dr")
    w = F.split(text.street(raw), " ")
    titles = text.lookup({"dr": "doutor", "prof": "professor", "gen": "general"})
    return t.poi.select("id", F.array_join(F.transform(w, lambda x, i: F.when(i == 1, F.coalesce(F.try_element_at(titles, x), x)).otherwise(x)), " ").alias("clean"))


@query("h111_spelt_numbers", "SELECT * FROM (VALUES (0, 'zero'), (7, 'sete'), (21, 'vinte e um'), (100, 'cem'), (115, 'cento e quinze'), (1000, 'mil'), (1925, 'mil novecentos e vinte e cinco'), (2000, NULL)) AS v(n, words)")
def h111(t: Tables) -> DataFrame:
    return table(t, [(n,) for n in (0, 7, 21, 100, 115, 1000, 1925, 2000)], "n int").select("n", text.spelt(F.col("n")).alias("words"))


@query("h111_numbers_round_trip", "SELECT n::INT AS n FROM range(1, 2000) r(n) WHERE n NOT IN (1, 2) OR true")
def h111b(t: Tables) -> DataFrame:
    return t.spark.range(1, 2000).select(F.col("id").cast("int").alias("n")).filter(text.numeral(text.spelt(F.col("n"))) == F.col("n"))


@query("h116_free_address", "SELECT id, nullif(number, '') AS number, [replace(postcode, '-', '')] AS codes FROM poi")
def h116(t: Tables) -> DataFrame:
    a = F.concat_ws(" ", "street", "number", F.lit("Centro"), "postcode")
    return t.poi.select("id", text.door_number(a).alias("number"), text.postcodes(a).alias("codes"))


@query("h117_city_state", "SELECT id, 'Canoas' AS city, 'RS' AS state FROM poi")
def h117(t: Tables) -> DataFrame:
    return t.poi.select("id", text.city_state(F.concat(F.col("street"), F.lit(", 5 - Centro, Canoas - RS, 92000-000"))).alias("p")).select("id", "p.*")


@query("h119_house_number", "SELECT * FROM (VALUES (1, 12, 'A', 'plain'), (2, NULL, NULL, 'none'), (3, 120, NULL, 'range'), (4, 7, NULL, 'km'), (5, 15, NULL, 'plain')) AS v(id, base, suffix, kind)")
def h119(t: Tables) -> DataFrame:
    d = table(t, [(1, "12 a"), (2, "S/N"), (3, "120-126"), (4, "KM 7"), (5, "0015")])
    return d.select("id", text.house_number(F.col("w")).alias("p")).select("id", F.col("p.base").cast("int").alias("base"), "p.suffix", "p.kind")


@query("h122_door_number", "SELECT id, nullif(number, '') AS door FROM poi")
def h122(t: Tables) -> DataFrame:
    a = text.compose_address(F.lit("Rua das Flores"), F.col("number"), F.lit("Centro"), F.lit("Canoas"), F.lit("RS"), F.col("postcode"))
    return t.poi.select("id", text.door_number(a).alias("door"))


@query("h123_complement", "SELECT id, ['ap ' || (id % 50 + 1), 'sala ' || (id % 9 + 1)] AS units, id % 50 = id % 9 AS same FROM poi")
def h123(t: Tables) -> DataFrame:
    c = F.concat(F.lit("SALA "), (F.col("id") % 9 + 1).cast("string"), F.lit(", APTO. 0"), (F.col("id") % 50 + 1).cast("string"))
    return t.poi.select("id", text.units(c).alias("units"), (F.col("id") % 50 == F.col("id") % 9).alias("same"))


#: Five pairs of a point's complement: words of all layers, others among them, some with blanks or in lower case.
PAIRS = "SELECT id, i, split_part('casa,BLOCO,Sala ,QUADRA,subsolo,LOTE,FUNDOS,Torre,APARTAMENTO,Rua Interna,CAIXA,', ',', CAST((id * i * i + 5 * i + id / 13) % 12 AS INT) + 1) AS n, CASE WHEN (id + i) % 6 = 0 THEN NULL ELSE concat(' ', CAST((id * 7 + i) % 40 AS VARCHAR(10))) END AS v FROM (SELECT CAST(id AS BIGINT) AS id FROM poi) p CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS k(i)".replace("id / 13", "CAST(FLOOR(id / 13) AS BIGINT)")
_LAYER = "CASE upper(trim(n)) WHEN 'QUADRA' THEN 1 WHEN 'RUA INTERNA' THEN 2 WHEN 'BLOCO' THEN 3 WHEN 'TORRE' THEN 3 WHEN 'SUBSOLO' THEN 4 WHEN 'SALA' THEN 5 WHEN 'APARTAMENTO' THEN 5 WHEN 'CASA' THEN 6 WHEN 'LOTE' THEN 6 WHEN 'FUNDOS' THEN 7 END"


@query("h126_complement_layers", f"WITH p AS (SELECT *, {_LAYER} AS layer FROM ({PAIRS}) q), r AS (SELECT *, row_number() OVER (PARTITION BY id, layer ORDER BY i) AS rn FROM p WHERE layer IS NOT NULL), f AS (SELECT id, string_agg(trim(upper(trim(n)) || ' ' || trim(coalesce(v, ''))), ' → ' ORDER BY layer) AS form, max(CASE WHEN layer = 3 THEN upper(trim(n)) || ':' || trim(coalesce(v, '')) END) AS block FROM r WHERE rn = 1 GROUP BY id) SELECT poi.id, coalesce(form, '') AS form, block FROM poi LEFT JOIN f ON f.id = poi.id")
def h126(t: Tables) -> DataFrame:
    five = t.sql(with_ctes(PAIRS)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "n", "v"))).alias("p"))
    layers = five.select("id", text.complement_layers(F.col("p.n"), F.col("p.v")).alias("l"))
    return layers.select("id", text.complement_form(F.col("l")).alias("form"), F.concat_ws(":", "l.bloco.kind", "l.bloco.value").alias("block")).withColumn("block", F.nullif("block", F.lit("")))


@query("h127_block_lot", "SELECT id, CASE WHEN id % 3 > 0 THEN (id % 3)::VARCHAR WHEN id % 2 = 0 THEN 'Q' || id || '/L8' ELSE 'L8' END AS key FROM poi")
def h127(t: Tables) -> DataFrame:
    i = F.col("id")
    return t.poi.select("id", text.block_lot(i % 3, F.when(i % 2 == 0, i.cast("string")).otherwise(""), F.lit("8"), F.lit(None).cast("string")).alias("key"))


@query("h130_hardening", "SELECT id, 'rua ' || lower(split_part(name, ' ', 1)) AS clean FROM poi")
def h130(t: Tables) -> DataFrame:
    return t.poi.select("id", text.tidy_street(F.concat(F.lit("RUA Rua "), F.split_part("name", F.lit(" "), F.lit(1)), F.lit(" (antiga) ,.-"))).alias("clean"))


@query("h131_name_without_document", "SELECT id, name FROM poi")
def h131(t: Tables) -> DataFrame:
    return t.poi.select("id", text.without_document(F.concat(F.col("name"), F.lit(" 12.345.678/0001-90"))).alias("name"))


@query("h135_search_filter", "SELECT id, id % 4 <> 1 AND number <> '' AS here FROM poi")
def h135(t: Tables) -> DataFrame:
    shown = F.when(F.col("id") % 4 == 1, "0").otherwise(F.col("number"))
    found = F.concat_ws(" ", F.lit("Loja na"), text.norm_name(F.col("street")), F.concat(F.lit("n. "), shown, F.lit(",")), F.lit("CANOAS/RS"))
    return t.poi.select("id", (text.mentions_address(found, text.street_core(text.norm_name(F.col("street"))), F.col("number"), F.lit("Canoas")) & (F.col("number") != "")).alias("here"))


@query("h135_source_class", "SELECT * FROM (VALUES (1, 'platform'), (2, 'official'), (3, 'registry'), (4, 'own')) AS v(id, class)")
def h135b(t: Tables) -> DataFrame:
    d = table(t, [(1, "https://www.instagram.com/x"), (2, "http://canoas.rs.gov.br/a"), (3, "cnpj.biz/1"), (4, "padaria.com.br")])
    return d.select("id", text.source_class(F.col("w")).alias("class"))


@query("h209_street_penalty")
def h209(t: Tables) -> DataFrame:
    s = t.poi.select("street").distinct()
    s = s.withColumn("quarter", F.substring_index("street", " ", -1))  # only streets of one quarter are compared
    p = s.select(F.col("street").alias("a"), "quarter").join(s.select(F.col("street").alias("b"), "quarter"), "quarter").filter("a < b")
    kind = lambda c: F.split_part(text.street(F.col(c)), F.lit(" "), F.lit(1))
    score = F.greatest(similarity.token_sort(text.street(F.col("a")), text.street(F.col("b"))), similarity.token_sort(text.street_core(F.col("a")), text.street_core(F.col("b"))))
    return p.withColumn("s", score).select("a", "b", F.round(F.col("s") - F.when(kind("a") != kind("b"), 6).otherwise(0), 4).alias("score"))


@query("h212_single_substitution", "SELECT * FROM (VALUES (1, 'airton', 'ayrton'), (2, NULL, NULL), (3, NULL, NULL)) AS v(id, a, b)")
def h212(t: Tables) -> DataFrame:
    d = table(t, [(1, "rua airton senna", "rua ayrton senna"), (2, "rua a b", "rua a"), (3, "rua c d", "rua e f")], "id int, x string, y string")
    return d.select("id", similarity.single_substitution(text.words(F.col("x")), text.words(F.col("y"))).alias("s")).select("id", "s.a", "s.b")


@query("h214_same_shop", "SELECT a.id AS a, b.id AS b FROM poi a JOIN poi b ON a.postcode = b.postcode AND a.id < b.id WHERE lower(split_part(a.name, ' ', 1)) = lower(split_part(b.name, ' ', 1)) AND lower(a.name) = lower(b.name)")
def h214(t: Tables) -> DataFrame:
    p = t.poi.select("id", "name", "postcode")
    j = p.alias("a").join(p.alias("b"), (F.col("a.postcode") == F.col("b.postcode")) & (F.col("a.id") < F.col("b.id")))
    return j.filter(text.same_shop(F.col("a.name"), F.col("b.name")) & (F.lower("a.name") == F.lower("b.name"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query("h308_schema_fingerprint", "SELECT sha256('c_acctbal|c_custkey|c_mktsegment|c_name|c_nationkey') AS print")
def h308(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(identifiers.schema_fingerprint(t.customer),)], "print string")


@query("h410_snippet_date", "SELECT * FROM (VALUES (1, DATE '2024-03-12'), (2, DATE '2023-01-05'), (3, DATE '2022-10-01'), (4, NULL)) AS v(id, day)")
def h410(t: Tables) -> DataFrame:
    return table(t, [(1, "em 12 de março de 2024 abriu"), (2, "atualizado 05/01/2023."), (3, "x 2022-10-01T10"), (4, "ontem")]).select("id", values.snippet_date(F.col("w")).alias("day"))


@query("h503_destination", "SELECT id, 100.0::DOUBLE AS m, ((id * 37) % 360)::DOUBLE AS heading FROM poi")
def h503(t: Tables) -> DataFrame:
    h = ((F.col("id") * 37) % 360).cast("double")
    d = t.poi.select("id", "lat", "lng", h.alias("h"), geo.destination(F.col("lat"), F.col("lng"), h, 100.0).alias("d"))
    to = (F.col("lat"), F.col("lng"), F.col("d.lat"), F.col("d.lng"))
    return d.select("id", F.round(geo.haversine(*to), 3).alias("m"), F.pmod(F.round(geo.bearing(*to), 2), F.lit(360.0)).alias("heading"))


@query("h507_projection", "SELECT id, round((lng + 51.2) * 111320 * cos(radians(-30.0)), 4) AS x, round((lat + 30) * 111320, 4) AS y FROM poi")
def h507(t: Tables) -> DataFrame:
    return t.poi.select("id", geo.project(F.col("lat"), F.col("lng"), -30.0, -51.2).alias("p")).select("id", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query("h511_largest_part", "SELECT 'centre' AS name, 0.0001 AS area")
def h511(t: Tables) -> DataFrame:
    p = polygons(t).withColumn("area", geo.ring_area(F.col("ring")))
    return p.agg(F.max_by("name", "area").alias("name"), F.round(F.max("area"), 8).cast("decimal(5,4)").alias("area"))


@query("h512_inner_point", "SELECT * FROM (VALUES ('centre', true), ('triangle', true), ('u', true)) AS v(name, inside)")
def h512(t: Tables) -> DataFrame:
    u = t.spark.createDataFrame([("u", [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 3.0), (1.0, 3.0), (1.0, 1.0), (4.0, 1.0), (4.0, 0.0)])], "name string, ring array<struct<lat:double,lng:double>>")
    p = polygons(t).unionByName(u).withColumn("p", geo.inner_point(F.col("ring")))
    return p.select("name", geo.in_ring(F.col("p.lat"), F.col("p.lng"), F.col("ring")).alias("inside"))


@query("h607_flatten", "SELECT event_id, 'k' AS field, (props->>'$.k') AS value FROM events UNION ALL SELECT event_id, 't', event_type FROM events")
def h607(t: Tables) -> DataFrame:
    j = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("t")))
    return t.events.select("event_id", F.explode(F.from_json(j, "map<string,string>")).alias("field", "value"))


@query("h714_segments", "SELECT id, list_sort(list_distinct([CASE WHEN regexp_matches(lower(name), 'farmacia') THEN 'health' WHEN regexp_matches(lower(name), 'padaria|bar') THEN 'food' ELSE 'other' END, CASE WHEN category = 'saude' THEN 'health' ELSE 'other' END])) AS segments FROM poi")
def h714(t: Tables) -> DataFrame:
    ladder = [("farmacia|saude", "health"), ("padaria|bar", "food")]
    a, b = rules.keyword_class(F.col("name"), ladder, "other"), rules.keyword_class(F.col("category"), ladder[:1], "other")
    return t.poi.select("id", F.array_sort(F.array_distinct(F.array(a, b))).alias("segments"))


@query("l09_output_validation", "SELECT 'rows' AS rule, 0::BIGINT AS broken UNION ALL SELECT 'domain', count(*) FILTER (WHERE category NOT IN ('comida', 'compras', 'saude')) FROM poi UNION ALL SELECT 'filled', count(*) FILTER (WHERE number = '') FROM poi")
def l09(t: Tables) -> DataFrame:
    return changes.expectations(t.poi, {"rows": F.col("id").isNotNull(), "domain": F.col("category").isin("comida", "compras", "saude"), "filled": F.col("number") != ""})


@query("e08_cluster_parts")
def e08(t: Tables) -> DataFrame:
    c = cluster.dbscan(t.poi, 60.0, 5, keeper(t.spark)).filter("cluster IS NOT NULL")
    return cluster.hulls(t.poi.join(c.select("id", "cluster"), "id"), "cluster")


_M = f"SELECT a.id AS a_id, b.id AS b_id, {METRES} AS m FROM poi a JOIN door b ON abs(a.lat - b.lat) < 0.0007 AND abs(a.lng - b.lng) < 0.0008"


@query("e04_nearest_ranked", f"WITH p AS ({_M}), r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY m, b_id)::INT AS rank FROM p WHERE m <= 60) SELECT a_id, b_id, round(m, 3) AS m, rank FROM r WHERE rank <= 3")
def e04(t: Tables) -> DataFrame:
    return joins.ranked_near(t.poi, t.door, 60.0, 3).withColumn("m", F.round("m", 3))


@query("c09_lateral_nearest", f"WITH p AS ({_M} WHERE a.street = b.street), r AS (SELECT a_id, b_id, m, row_number() OVER (PARTITION BY a_id ORDER BY m, b_id) AS rn FROM p WHERE m <= 60) SELECT q.id AS a_id, r.b_id, round(r.m, 3) AS m FROM poi q LEFT JOIN r ON r.a_id = q.id AND r.rn = 1")
def c09(t: Tables) -> DataFrame:
    return joins.lateral_nearest(t.poi, t.door, 60.0, ["street"]).withColumn("m", F.round("m", 3))


@query("h514_image_components")
def h514(t: Tables) -> DataFrame:
    # rasters made from the points: tiles of 200 x 200 cells of about 20 m, coloured where a point falls
    y, x = F.floor((F.col("lat") + 30) * 5000).cast("int"), F.floor((F.col("lng") + 51.2) * 5000).cast("int")
    pixels = t.poi.select(F.concat_ws("/", F.floor(y / 200).cast("int"), F.floor(x / 200).cast("int")).alias("tile"), (y % 200).alias("y"), (x % 200).alias("x")).distinct()
    images = pixels.groupBy("tile").agg(F.collect_list(F.struct("y", "x")).alias("on"))  # a tile has 40,000 pixels at most
    return cluster.label_components(images, 200, 200)


PIXELS = "SELECT DISTINCT CAST(FLOOR((lat + 30) * 1000) AS BIGINT) AS y, CAST(FLOOR((lng + 51.2) * 1000) AS BIGINT) AS x FROM poi"


@query("h514_plane_regions", f"WITH RECURSIVE p AS ({PIXELS}), s AS (SELECT a.y, a.x, b.y AS v, b.x AS u FROM p a JOIN p b ON abs(a.y - b.y) + abs(a.x - b.x) = 1), r(y, x, i, j) AS (SELECT y, x, y, x FROM p UNION SELECT s.v, s.u, r.i, r.j FROM r JOIN s ON s.y = r.y AND s.x = r.x), m AS (SELECT y, x, min(i * 10000000 + j) AS region FROM r GROUP BY y, x) SELECT region // 10000000 AS first_y, region % 10000000 AS first_x, count(*) AS pixels, max(y) - min(y) AS height, max(x) - min(x) AS width FROM m GROUP BY region")
def h514b(t: Tables) -> DataFrame:
    # tiles of 8 x 8, so that regions lie over many borders
    r = cluster.plane_regions(t.sql(with_ctes(PIXELS)), keeper(t.spark), 8)
    return r.groupBy("region").agg(F.count("*").alias("pixels"), (F.max("y") - F.min("y")).alias("height"), (F.max("x") - F.min("x")).alias("width")).select(F.col("region.y").alias("first_y"), F.col("region.x").alias("first_x"), "pixels", "height", "width")


def addresses(t: Tables) -> DataFrame:
    """Addresses in several orders and spellings, with the part of every word, from doors and points."""
    rows = "SELECT id, street, CAST(number AS VARCHAR(10)) AS number, concat('Jardim ', split_part(street, ' ', 3)) AS area, concat('Vila ', CAST(city AS VARCHAR(10))) AS city, 'RS' AS state, postcode FROM door UNION ALL SELECT -id - 1, street, number, concat('Parque ', split_part(name, ' ', 2)) AS area, concat('Porto ', split_part(name, ' ', 1)) AS city, 'SC' AS state, postcode FROM poi"
    return tagger.composed(spread(t.sql(with_ctes(rows))))


@query("n05_tagged_addresses")
def n05b(t: Tables) -> DataFrame:
    a = addresses(t)
    model = tagger.learn(a.filter(F.crc32(F.col("id").cast("string")) % 5 != 0))
    return tagger.tag(a.select("id", "address"), model).select("id", *tagger.TAGS[:-1])


CHANGED = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_totalprice + CASE WHEN o_orderkey % 101 = 0 THEN 1 ELSE 0 END AS price, o_orderpriority AS priority FROM orders WHERE o_orderkey % 97 <> 0 UNION ALL SELECT -o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 103 = 0"


@query("l08_artefact_differences", f"WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS status, o_totalprice AS price FROM orders), n AS ({CHANGED}), j AS (SELECT coalesce(o.k, n.k) AS k, o.k IS NULL AS added, n.k IS NULL AS removed, o.status IS DISTINCT FROM n.status AS s, o.price IS DISTINCT FROM n.price AS p FROM o FULL OUTER JOIN n ON o.k = n.k) SELECT k, CASE WHEN added THEN 'ADDED' WHEN removed THEN 'REMOVED' ELSE 'CHANGED' END AS event, CASE WHEN added OR removed THEN '' ELSE concat_ws(' ', CASE WHEN s THEN 'status' END, CASE WHEN p THEN 'price' END) END AS changed FROM j WHERE added OR removed OR s OR p")
def l08b(t: Tables) -> DataFrame:
    old = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))
    return audit.differences(old, t.sql(CHANGED), ["k"], ["status", "price", "priority"], keeper(t.spark)).withColumn("changed", F.array_join("changed", " "))


@query("d31_metrics_in_tolerance", f"WITH n AS ({CHANGED}), g AS (SELECT 'rows' AS metric, count(*)::DOUBLE AS golden FROM orders UNION ALL SELECT concat('status ', o_orderstatus), count(*) FROM orders GROUP BY o_orderstatus), m AS (SELECT 'rows' AS metric, count(*)::DOUBLE AS now FROM n UNION ALL SELECT concat('status ', status), count(*) FROM n GROUP BY status) SELECT coalesce(g.metric, m.metric) AS metric, golden, now, CASE WHEN now IS NULL THEN 'MISSING' WHEN golden IS NULL THEN 'NEW' WHEN abs(now - golden) > golden * CASE coalesce(g.metric, m.metric) WHEN 'rows' THEN 0.01 ELSE 0.02 END THEN 'OFF' ELSE 'OK' END AS verdict FROM g FULL OUTER JOIN m ON g.metric = m.metric")
def d31b(t: Tables) -> DataFrame:
    def metrics(d: DataFrame, status: str) -> DataFrame:
        each = d.groupBy(F.concat_ws(" ", F.lit("status"), status).alias("metric")).agg(F.count("*").cast("double").alias("value"))
        return d.agg(F.count("*").cast("double").alias("value")).select(F.lit("rows").alias("metric"), "value").unionByName(each)

    return audit.within_tolerance(metrics(t.orders, "o_orderstatus"), metrics(t.sql(CHANGED), "status"), {"rows": 0.01}, 0.02).drop("tolerance")


@query("n01_number_runs", "WITH d AS (SELECT id, street, number, CASE WHEN number - lag(number) OVER (PARTITION BY street ORDER BY number, id) <= 1 THEN 0 ELSE 1 END AS fresh FROM door), g AS (SELECT *, sum(fresh) OVER (PARTITION BY street ORDER BY number, id ROWS UNBOUNDED PRECEDING) AS run FROM d) SELECT street, min(number) AS first, max(number) AS last, count(*) AS doors FROM g GROUP BY street, run")
def n01b(t: Tables) -> DataFrame:
    tablefunctions.register(t.spark)
    return t.spark.sql("SELECT street, first, last, doors FROM number_runs(TABLE(SELECT street, number FROM {doors}), 1)", doors=t.door)
