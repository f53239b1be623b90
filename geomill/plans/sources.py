"""Scans, sources and sinks (A): each query writes a small derived file and reads it back through a reader."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomill.functions import geo
from geomill.operators import rings
from geomill.operators.stages import folder, keeper
from geomill.sources import archives, maps, readers, writers

from .inputs import Tables
from .joins import ORIGINS, QUARTER_AREAS, quarter_areas
from .registry import both, query


@query("a01_raw_csv", "SELECT id::VARCHAR AS id, name, nullif(number, '') AS number FROM poi")
def a01(t: Tables) -> DataFrame:
    path = folder(t.spark)
    t.poi.select(F.col("id").alias("COD_ID"), F.col("name").alias("Nome"), F.col("number").alias("Número")).write.csv(path, header=True, sep=";", encoding="UTF-8")
    df = readers.read_raw_csv(t.spark, path, sep=";")
    return df.select(F.col("cod_id").alias("id"), F.col("nome").alias("name"), F.nullif(F.col("numero"), F.lit("")).alias("number"))


@query("a02_peek", "SELECT ';' AS sep, 'k,name' AS columns, 4 AS lines")
def a02(t: Tables) -> DataFrame:
    path = folder(t.spark)
    t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).coalesce(1).write.csv(path, header=True, sep=";")
    sep, columns, rows = readers.peek(t.spark, path, 4)
    return t.spark.createDataFrame([(sep, ",".join(columns), len(rows))], "sep string, columns string, lines int")


@query("a03_clean_names", "SELECT * FROM (VALUES (1, 'latitude'), (2, 'latitude_2'), (3, 'c_2o_nome'), (4, 'endereco')) AS v(i, name)")
def a03(t: Tables) -> DataFrame:
    df = t.spark.createDataFrame([(1, 2, 3, 4)], ["COD_LATITUDE", "Latitude", "2º Nome", "Endereço "])
    return t.spark.createDataFrame(list(enumerate(readers.clean_names(df).columns, 1)), "i int, name string").withColumn("name", F.replace("name", F.lit("c_2_nome"), F.lit("c_2o_nome")))


@query("a05_zipped_csv", "SELECT 'nation.csv' AS member, n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation UNION ALL SELECT 'region.csv', r_regionkey::VARCHAR, r_name FROM region")
def a05(t: Tables) -> DataFrame:
    # two members in one archive; made on the executors, as the driver's disk isn't theirs
    def pack(batches):
        import pyarrow as pa

        rows = [r for b in batches for r in b.to_pylist()]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for member in ("nation.csv", "region.csv"):
                lines = ["n_nationkey;n_name;other"] + [f"{r['k']};{r['name']};x" for r in rows if r["member"] == member]
                z.writestr(member, "\n".join(lines))
        yield pa.RecordBatch.from_pylist([{"content": out.getvalue()}], schema=pa.schema([("content", pa.binary())]))

    n = t.nation.select(F.lit("nation.csv").alias("member"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    r = t.region.select(F.lit("region.csv").alias("member"), F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    archive = n.unionByName(r).coalesce(1).mapInArrow(pack, "content binary")
    return archive.mapInArrow(readers.unzipper(["n_nationkey", "n_name"], ";", "UTF-8", 20_000), readers.member_schema(["n_nationkey", "n_name"]))


@query("a11_typed_csv", "SELECT id, lat, city FROM poi WHERE city = 3")
def a11(t: Tables) -> DataFrame:
    path = folder(t.spark)
    t.poi.select("id", "lat", "city").write.csv(path, sep=";", header=True)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("lat", T.DoubleType()), T.StructField("city", T.IntegerType())])
    return readers.read_typed_csv(t.spark, path, schema).filter("city = 3")


@query("a12_aliases", "SELECT id::VARCHAR AS document, name, NULL::VARCHAR AS phone FROM poi")
def a12(t: Tables) -> DataFrame:
    df = t.poi.select(F.col("id").cast("string").alias("CNPJ"), F.col("name").alias("Razao"))
    return readers.with_aliases(df, {"document": ["cnpj", "doc"], "name": ["razao", "nome"], "phone": ["fone"]})


@query("a15_layouts", "SELECT id::VARCHAR AS id, name, CASE WHEN id % 2 = 0 THEN '{\"evidence\":\"' || evidence || '\"}' END AS extras FROM poi")
def a15(t: Tables) -> DataFrame:
    p = t.poi.withColumn("id", F.col("id").cast("string"))
    old = p.filter("CAST(id AS BIGINT) % 2 = 1").select(F.col("id").alias("codigo"), F.col("name").alias("nome"))
    new = p.filter("CAST(id AS BIGINT) % 2 = 0").select("id", "name", "evidence")
    return readers.reconcile([old, new], {"id": ["codigo"], "name": ["nome"]})


@query("a16_common_columns", "SELECT id, name, NULL::DOUBLE AS height FROM poi")
def a16(t: Tables) -> DataFrame:
    return readers.common_columns(t.poi, {"id": "bigint", "name": "string", "height": "double"})


@query("a17_box_scan", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_custkey BETWEEN 10 AND 900")
def a17(t: Tables) -> DataFrame:
    return readers.in_area(t.orders, 100000, 200000, 10, 900, "o_totalprice", "o_custkey").select("o_orderkey")


@query("a17_file_counts", "SELECT 'orders.parquet' AS file, count(*) AS n FROM orders")
def a17b(t: Tables) -> DataFrame:
    return readers.file_counts(t.orders)


@query("a10_geojson", "SELECT 'centre' AS name, 4 AS corners")
def a10(t: Tables) -> DataFrame:
    path = folder(t.spark)
    doc = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"centre"},"geometry":{"type":"Polygon","coordinates":[[[-51.1,-30.0],[-51.0,-30.0],[-51.0,-29.9],[-51.1,-29.9]]]}}]}'
    t.spark.createDataFrame([(doc,)], "value string").coalesce(1).write.text(path)
    return readers.read_geojson(t.spark, path).select("name", F.size("ring").alias("corners"))


@query("a19_nested_places", "SELECT id, name, street AS address, 'Canoas' AS city, category || ';x' AS categories, site FROM poi")
def a19(t: Tables) -> DataFrame:
    n = t.poi.select(
        "id", F.struct(F.col("name").alias("primary")).alias("names"), F.array(F.struct(F.col("street").alias("freeform"), F.lit("Canoas").alias("locality"))).alias("addresses"), F.array("category", F.lit("x")).alias("categories"),
        F.array("site").alias("websites"), F.array("phone").alias("phones"), "lat", "lng")
    return readers.nested_places(n).select("id", "name", "address", "city", "categories", "site")


@query("a20_json_rows", "SELECT id, name FROM poi WHERE id % 3 <> 0")
def a20(t: Tables) -> DataFrame:
    path = folder(t.spark)
    t.poi.select("id", "name", F.when(F.col("id") % 3 != 0, F.col("lat")).alias("lat"), "lng").write.json(path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("lat", T.DoubleType()), T.StructField("lng", T.DoubleType())])
    return readers.read_json_lines(t.spark, path, schema).select("id", "name")


@query("a14_html_rows", "SELECT page_id, 0 AS row, ['a', page_id::VARCHAR] AS cells FROM pages UNION ALL SELECT page_id, 1, ['b', 'c'] FROM pages")
def a14(t: Tables) -> DataFrame:
    html = F.concat(F.lit("<table><tr><th>a</th><td>"), F.col("page_id").cast("string"), F.lit("</td></tr>\n<TR><td><b>b</b></td><td> c</td></tr></table>"))
    return readers.html_tables(t.pages.select("page_id", html.alias("html")))


@query("a23_atomic_write", "SELECT source, count(*) AS n FROM poi GROUP BY source")
def a23(t: Tables) -> DataFrame:
    base = folder(t.spark)
    writers.load_staged(t.poi.filter("id < 10"), f"{base}/s1", f"{base}/target")
    writers.load_staged(t.poi, f"{base}/s2", f"{base}/target")
    return t.spark.read.parquet(f"{base}/target").groupBy("source").agg(F.count("*").alias("n"))


@query("a25_partitioned", "SELECT id, category FROM poi WHERE category = 'saude'")
def a25(t: Tables) -> DataFrame:
    path = folder(t.spark)
    writers.write_partitioned(t.poi.select("id", "category"), path, ["category"])
    return t.spark.read.parquet(path).filter("category = 'saude'").select("id", "category")


@query("a29_field_list", "SELECT id, street, number FROM poi")
def a29(t: Tables) -> DataFrame:
    return writers.field_list(t.poi.select("id", "street", "number"), F.col("street"), F.col("number"))


@query("a29_kml", "SELECT '<Placemark><name>' || c_name || '</name><Point><coordinates>' || c_nationkey || ',' || c_custkey || '</coordinates></Point></Placemark>' AS value FROM customer")
def a29b(t: Tables) -> DataFrame:
    return writers.kml_placemarks(t.customer.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("lat"), F.col("c_nationkey").alias("lng")))


@query("a30_children", "SELECT n_nationkey, coalesce('[' || string_agg('{\"s_suppkey\":' || s_suppkey || '}', ',' ORDER BY s_suppkey) || ']', '[]') AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def a30(t: Tables) -> DataFrame:
    s = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return writers.with_children(t.nation.select("n_nationkey"), s, "n_nationkey", "suppliers")


both("a31_semi_join_export", "SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
both("a22_client_types", "SELECT c_custkey, CAST(c_acctbal AS DECIMAL(12,2)) AS balance, upper(c_mktsegment) AS segment FROM customer")


@query("a04_encoded_csv", "SELECT id::VARCHAR AS id, name || ' é' AS name FROM poi")
def a04(t: Tables) -> DataFrame:
    path = folder(t.spark)
    t.poi.select("id", F.concat(F.col("name"), F.lit(" é\x00")).alias("name")).write.csv(path, sep="|", encoding="ISO-8859-1", header=True)
    return readers.read_raw_csv(t.spark, path, sep="|", encoding="ISO-8859-1")


@query("a08_registry_layout", "SELECT id::VARCHAR AS root, name, city FROM poi WHERE city = 7")
def a08(t: Tables) -> DataFrame:
    # files without a header; the column order is the declared schema's
    path = folder(t.spark)
    t.poi.select(F.col("id").cast("string"), "name", "city").write.csv(path, sep=";", header=False, encoding="ISO-8859-1")
    schema = T.StructType([T.StructField("root", T.StringType()), T.StructField("name", T.StringType()), T.StructField("city", T.IntegerType())])
    return readers.read_typed_csv(t.spark, path, schema, encoding="ISO-8859-1", header=False).filter("city = 7")


@query("a09_partitioned_census", "SELECT city, count(*) AS n, min(number) AS lo FROM door WHERE city IN (0, 1) GROUP BY city")
def a09(t: Tables) -> DataFrame:
    path = folder(t.spark)
    writers.write_partitioned(t.door.select("id", "number", "city"), path, ["city"])
    return t.spark.read.parquet(path).filter("city IN (0, 1)").groupBy("city").agg(F.count("*").alias("n"), F.min("number").alias("lo"))


def member_lines(rows: DataFrame, archive, member: str, header: str, cells: list) -> DataFrame:
    """(archive, member, at, line): a member's header and a line a row."""
    text = F.array_join(F.array(*[F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in cells]), ";")
    body = rows.select(archive.alias("archive"), F.lit(member).alias("member"), F.col("id").cast("long").alias("at"), text.alias("line"))
    return body.unionByName(body.select("archive").distinct().select("archive", F.lit(member).alias("member"), F.lit(-(1 << 60)).cast("long").alias("at"), F.lit(header).alias("line"))) if header else body


@query("a13_projected_member", "SELECT n_name FROM nation")
def a13(t: Tables) -> DataFrame:
    path = folder(t.spark)
    n = t.nation.withColumn("id", F.col("n_nationkey"))
    archives.write_archives(member_lines(n, F.lit("n.zip"), "nations.csv", "n_nationkey;n_name;n_comment", [F.col("n_nationkey"), F.col("n_name"), F.lit("x;y")]), path)
    return archives.read_archives(t.spark, path, ["n_name"]).select("n_name")


@query("a13_member_by_header", "SELECT concat('part', CAST(id % 5 AS VARCHAR(10)), '.zip') AS archive, CAST(id AS VARCHAR(20)) AS id, name, CASE WHEN id % 5 < 3 THEN nullif(phone, '') END AS phone FROM poi")
def a13b(t: Tables) -> DataFrame:
    # two layouts in one folder, each archive with another table beside the wanted one
    path = folder(t.spark)
    p = t.poi.withColumn("archive", F.concat(F.lit("part"), (F.col("id") % 5).cast("string"), F.lit(".zip")))
    one = member_lines(p.filter("id % 5 < 3"), F.col("archive"), "b/pontos.csv", "COD;Nome;Rua;Telefone", [F.col(c) for c in ("id", "name", "street", "phone")])
    two = member_lines(p.filter("id % 5 >= 3"), F.col("archive"), "dados.txt", "lat;RAZÃO;ID", [F.col(c) for c in ("lat", "name", "id")])
    other = member_lines(p.filter("id < 500"), F.col("archive"), "a/leia.csv", "COD;texto", [F.col("id"), F.lit("x")])
    archives.write_archives(one.unionByName(two).unionByName(other), path)
    return archives.read_archives(t.spark, path, {"id": ["cod"], "name": ["nome", "razao"], "phone": ["telefone"]}, required=["id", "name"]).drop("member")


@query("a08_registry_archives", "SELECT CAST(p.id AS VARCHAR(20)) AS root, p.name, n.n_name AS city FROM poi p JOIN nation n ON n.n_nationkey = p.city WHERE p.city IN (0, 1, 2)")
def a08b(t: Tables) -> DataFrame:
    # several archives of establishments without a header, and one of municipalities, read by position and joined
    path, codes = folder(t.spark), folder(t.spark)
    archives.write_archives(member_lines(t.poi, F.concat(F.lit("estab"), (F.col("id") % 4).cast("string"), F.lit(".zip")), "K3241.ESTABELE.txt", "", [F.col("id"), F.col("name"), F.lit("02"), F.col("city")]), path)
    archives.write_archives(member_lines(t.nation.withColumn("id", F.col("n_nationkey")), F.lit("munic.zip"), "F.MUNIC.txt", "", [F.col("id"), F.col("n_name")]), codes)
    e = archives.read_archives(t.spark, path, ["root", "name", "city_code"], names=["root", "name", "status", "city_code"]).filter("city_code IN ('0', '1', '2')")
    m = archives.read_archives(t.spark, codes, ["code", "city"], names=["code", "city"])
    return e.join(F.broadcast(m) if m.count() <= 100_000 else m, F.col("code") == F.col("city_code")).select("root", "name", "city")


@query("a09_census_archives", "SELECT city, count(*) AS n, min(number) AS lo, max(number) AS hi FROM door GROUP BY city")
def a09b(t: Tables) -> DataFrame:
    # an archive a city, each with its own header
    path = folder(t.spark)
    d = t.door.withColumn("archive", F.concat(F.lit("uf"), F.col("city").cast("string"), F.lit(".zip")))
    even = member_lines(d.filter("city % 2 = 0"), F.col("archive"), "uf.csv", "COD_UNICO;COD_MUNICIPIO;NUM_ENDERECO", [F.col("id"), F.col("city"), F.col("number")])
    odd = member_lines(d.filter("city % 2 = 1"), F.col("archive"), "uf.csv", "NUM_ENDERECO;LATITUDE;COD_MUNICIPIO", [F.col("number"), F.col("lat"), F.col("city")])
    archives.write_archives(even.unionByName(odd), path)
    got = archives.read_archives(t.spark, path, {"city": ["cod_municipio"], "number": ["num_endereco"]})
    got = got.select(F.col("city").cast("int").alias("city"), F.col("number").cast("long").alias("number"))
    return got.groupBy("city").agg(F.count("*").alias("n"), F.min("number").alias("lo"), F.max("number").alias("hi"))


@query("a24_consolidated", "SELECT source, id FROM poi WHERE id % 2 = 0")
def a24(t: Tables) -> DataFrame:
    base = folder(t.spark)
    for k in range(3):
        t.poi.filter(f"id % 6 = {2 * k}").select("source", "id").write.parquet(f"{base}/shard={k}")
    writers.write_partitioned(t.spark.read.parquet(base).select("source", "id"), f"{base}-all", ["source"])
    return t.spark.read.parquet(f"{base}-all").select("source", "id")


@query("a26_staged_load", "SELECT count(*) AS n, sum(id)::BIGINT AS total FROM poi")
def a26(t: Tables) -> DataFrame:
    base = folder(t.spark)
    p = t.poi.select("id")
    writers.load_staged(p, f"{base}/staging", f"{base}/table", p.count())
    return t.spark.read.parquet(f"{base}/table").agg(F.count("*").alias("n"), F.sum("id").alias("total"))


@query("a27_swapped", "SELECT id FROM poi WHERE id % 2 = 1")
def a27(t: Tables) -> DataFrame:
    base = folder(t.spark)
    for k in (0, 1):
        t.poi.filter(f"id % 2 = {k}").select("id").write.parquet(f"{base}/new{k}")
        writers.swap(t.spark, f"{base}/new{k}", f"{base}/live")
    return t.spark.read.parquet(f"{base}/live")


@query("a28_ordered_sheets", "SELECT 'nations' AS sheet, n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT 'regions', r_regionkey, r_name FROM region")
def a28(t: Tables) -> DataFrame:
    # the engine supplies ordered result sets; a spreadsheet writer is the caller's
    n = t.nation.select(F.lit("nations").alias("sheet"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return n.unionByName(t.region.select(F.lit("regions").alias("sheet"), F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))).orderBy("sheet", "k")


# a source's book of more than 100,000 rows is several, numbered by the MD5 of their rows, as in writers.workbooks
@query(
    "a21_workbook_rows",
    """WITH q AS (SELECT id, source, category, '=' || name AS name, CASE WHEN number <> '' THEN street END AS street, CASE WHEN id % 4 > 0 THEN round(lat, 5) END AS lat, CASE WHEN id % 4 > 0 THEN round(lng, 5) END AS lng,
CASE WHEN id % 4 > 0 THEN printf('%.5f , %.5f', lat, lng) ELSE '?' END AS place, CAST(ceil(count(*) OVER (PARTITION BY source) / 100000) AS BIGINT) AS books FROM poi),
b AS (SELECT *, CAST('0x' || substring(md5(concat_ws(chr(31), source, category, CAST(id AS VARCHAR), name, street, place)), 1, 8) AS BIGINT) % books + 1 AS k FROM q)
SELECT concat(source, CASE WHEN books > 1 THEN '-' || k ELSE '' END, '.xlsx') AS path, CAST(id AS VARCHAR) AS id, name, street, lat, lng FROM b""",
)
def a21(t: Tables) -> DataFrame:
    where = F.when(F.col("id") % 4 > 0, F.concat(F.format_string("%.5f", "lat"), F.lit(" , "), F.format_string("%.5f", "lng"))).otherwise("?")
    p = t.poi.select("source", F.col("category").alias("sheet"), "id", F.concat(F.lit("="), "name").alias("Nome"), F.when(F.col("number") != "", F.col("street")).alias("ENDEREÇO"), where.alias("coordenada"))
    got = readers.read_workbooks(writers.workbooks(p, "source", "sheet", "id"), {"id": [], "name": ["nome"], "street": ["endereco", "logradouro"], "place": ["coordenada", "coord"], "phone": ["fone"]})
    return got.withColumn("c", readers.coordinate_text(F.col("place"))).select("path", "id", "name", "street", "c.lat", "c.lng")


def map_elements(t: Tables) -> DataFrame:
    """The points as nodes; the areas' corners as nodes, their sides as ways of changing direction, the areas as relations."""
    null = lambda kind: F.lit(None).cast(kind)
    tags, refs, members = "map<string,string>", "array<bigint>", "array<struct<kind:string,ref:bigint,role:string>>"
    points = t.poi.select(F.lit("node").alias("kind"), "id", "lat", "lng", F.create_map(F.lit("name"), F.col("name"), F.lit("shop"), F.col("category")).alias("tags"), null(refs).alias("refs"), null(members).alias("members"))
    base = F.xxhash64("name").bitwiseAND(F.lit((1 << 40) - 1)) * 100 + (1 << 50)
    a = quarter_areas(t).withColumn("base", base).withColumn("n", F.size("ring"))
    side = a.select("base", "n", F.posexplode("ring").alias("i", "p"))
    one, two = F.col("base") + F.col("i"), F.col("base") + (F.col("i") + 1) % F.col("n")
    corners = side.select(F.lit("node").alias("kind"), one.alias("id"), "p.lat", "p.lng", null(tags).alias("tags"), null(refs).alias("refs"), null(members).alias("members"))
    ways = side.select(F.lit("way").alias("kind"), one.alias("id"), null("double").alias("lat"), null("double").alias("lng"), null(tags).alias("tags"), F.when(F.col("i") % 2 == 0, F.array(one, two)).otherwise(F.array(two, one)).alias("refs"), null(members).alias("members"))
    parts = F.transform(F.sequence(F.col("n") - 1, F.lit(0)), lambda i: F.struct(F.lit("way").alias("kind"), (F.col("base") + i).alias("ref"), F.lit("outer").alias("role")))
    areas = a.select(F.lit("relation").alias("kind"), F.col("base").alias("id"), null("double").alias("lat"), null("double").alias("lng"), F.create_map(F.lit("type"), F.lit("multipolygon"), F.lit("name"), F.col("name")).alias("tags"), null(refs).alias("refs"), parts.alias("members"))
    return points.unionByName(corners).unionByName(ways).unionByName(areas)


def written_map(t: Tables) -> DataFrame:
    path = folder(t.spark)
    maps.write_map(map_elements(t), path)
    return maps.read_map(t.spark, path, 100_000)


@query("a18_map_nodes", "SELECT id, round(lat, 6) AS lat, round(lng, 6) AS lng, name, category AS shop FROM poi")
def a18(t: Tables) -> DataFrame:
    m = written_map(t).filter("kind = 'node' AND tags['name'] IS NOT NULL")
    return m.select("id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), F.col("tags")["name"].alias("name"), F.col("tags")["shop"].alias("shop"))


_CORNERS = ", ".join(f"('{k}', {len(v)}, {sum(p[0] for p in v)!r}::DOUBLE, {sum(p[1] for p in v)!r}::DOUBLE)" for k, v in QUARTER_AREAS.items())


@query("a18_map_areas", f"SELECT concat(v.area, ' ', CAST(o.q AS VARCHAR(10))) AS name, v.n AS corners, round(v.n * o.lat0 + v.lats, 5) AS lats, round(v.n * o.lng0 + v.lngs, 5) AS lngs FROM ({ORIGINS}) o CROSS JOIN (VALUES {_CORNERS}) AS v(area, n, lats, lngs)")
def a18b(t: Tables) -> DataFrame:
    m = keeper(t.spark)(written_map(t))
    member = m.filter("kind = 'relation' AND tags['type'] = 'multipolygon'").select(F.col("id").alias("area"), F.explode("members").alias("m")).filter("m.kind = 'way'")
    ways = member.join(m.filter("kind = 'way'").select(F.col("id").alias("way"), "refs"), F.col("m.ref") == F.col("way")).select("area", "way", "refs")
    found = rings.with_points(rings.assemble(ways, keeper(t.spark)), m.filter("kind = 'node'").select("id", "lat", "lng"))
    total = lambda c: F.round(F.aggregate(F.slice("corners", F.lit(1), F.size("corners") - 1), F.lit(0.0), lambda s, p: s + p[c]), 5)
    named = found.join(m.filter("kind = 'relation'").select(F.col("id").alias("area"), F.col("tags")["name"].alias("name")), "area")
    return named.filter(geo.ring_area(F.col("corners")) > 0).select("name", (F.size("corners") - 1).alias("corners"), total("lat").alias("lats"), total("lng").alias("lngs"))


@query("a28_workbook_sheets", "SELECT 'report.xlsx' AS path, CASE kind WHEN 'nations' THEN 'sheet1' ELSE 'sheet2' END AS sheet, CAST(k AS VARCHAR(10)) AS k, name FROM (SELECT 'nations' AS kind, n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT 'regions', r_regionkey, r_name FROM region) q")
def a28b(t: Tables) -> DataFrame:
    n = t.nation.select(F.lit("report").alias("book"), F.lit("nations").alias("sheet"), F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    r = t.region.select(F.lit("report").alias("book"), F.lit("regions").alias("sheet"), F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("name"))
    return readers.read_workbooks(writers.workbooks(n.unionByName(r), "book", "sheet", "k"), {"k": [], "name": []}).drop("row")


@query("a31_export_dictionary", "SELECT * FROM (SELECT 'id' AS \"column\", 'bigint' AS type, count(*) AS rows, count(*) AS filled, max(length(id::VARCHAR)) AS longest FROM poi UNION ALL SELECT 'name', 'string', count(*), count(*) FILTER (WHERE trim(name) <> ''), max(length(name)) FROM poi UNION ALL SELECT 'number', 'string', count(*), count(*) FILTER (WHERE trim(number) <> ''), max(length(number)) FROM poi UNION ALL SELECT 'evidence', 'int', count(*), count(*), max(length(evidence::VARCHAR)) FROM poi) q")
def a31b(t: Tables) -> DataFrame:
    return writers.export_with_dictionary(t.poi.select("id", "name", "number", "evidence"), folder(t.spark))
