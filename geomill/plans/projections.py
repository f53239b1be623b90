"""Projections, filters and predicates (B)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.functions import geo, text
from geomill.operators import changes, fusion, rules

from .inputs import Tables
from .joins import RINGS
from .registry import both, query


@query("b01_typed_cleaning", "SELECT id, nullif(regexp_replace(phone, '[^0-9]', '', 'g'), '')::BIGINT AS phone, coalesce(try_cast(nullif(number, '') AS SMALLINT), 0::SMALLINT) AS number, replace('1,5', ',', '.')::DOUBLE AS factor, nullif(trim(site), 'nan') AS site FROM poi")
def b01(t: Tables) -> DataFrame:
    return t.poi.select(
        "id", F.nullif(text.digits(F.col("phone")), F.lit("")).try_cast("bigint").alias("phone"), F.coalesce(F.col("number").try_cast("smallint"), F.lit(0).cast("smallint")).alias("number"),
        F.replace(F.lit("1,5"), F.lit(","), F.lit(".")).try_cast("double").alias("factor"), text.void_to_null(F.trim("site")).alias("site"))


@query("b02_mapping_plan", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer")
def b02(t: Tables) -> DataFrame:
    mapping = {"id": "c_custkey", "name": "c_name", "balance": "c_acctbal"}
    return t.customer.select(*[F.col(c).alias(role) for role, c in mapping.items()])


both("b03_materialise", "SELECT id, upper(name) AS name, concat(street, ', ', number) AS address, lat, lng FROM poi WHERE number <> ''")

_S, _N, _W, _E = geo.box(RINGS["centre"], 50.0)


@query("b04_area_box", f"SELECT id FROM poi WHERE lat BETWEEN {_S}::DOUBLE AND {_N}::DOUBLE AND lng BETWEEN {_W}::DOUBLE AND {_E}::DOUBLE")
def b04(t: Tables) -> DataFrame:
    return t.poi.filter(geo.in_box(F.col("lat"), F.col("lng"), RINGS["centre"], 50.0)).select("id")


@query("b05_point_in_ring", "SELECT id FROM poi WHERE lat > -29.995 AND lat < -29.985 AND lng > -51.195 AND lng < -51.185 AND least(abs(lat + 29.995), abs(lat + 29.985), abs(lng + 51.195), abs(lng + 51.185)) > 1e-7")
def b05(t: Tables) -> DataFrame:
    lat, lng = F.col("lat"), F.col("lng")
    edge = F.least(F.abs(lat + 29.995), F.abs(lat + 29.985), F.abs(lng + 51.195), F.abs(lng + 51.185)) <= 1e-7
    return t.poi.filter(~edge & geo.in_ring(lat, lng, geo.ring_literal(RINGS["centre"]))).select("id")


both("b08_plain_equality", "SELECT n_nationkey FROM nation WHERE upper(translate(lower(n_name), 'aeiou', 'AEIOU')) = upper(n_name)")


@query("b08_plain_city", "SELECT id FROM (SELECT id, CASE id % 5 WHEN 0 THEN 'São José' WHEN 1 THEN 'SAO JOSE' WHEN 2 THEN 'são josé ' WHEN 3 THEN 'Sao Jorge' END AS city FROM poi) q WHERE id % 5 < 3")
def b08b(t: Tables) -> DataFrame:
    i = F.col("id") % 5
    city = F.when(i == 0, "São José").when(i == 1, "SAO JOSE").when(i == 2, "são josé ").when(i == 3, "Sao Jorge")
    plain = lambda c: F.trim(text.strip_accents(F.lower(c)))
    return t.poi.select("id", city.alias("city")).filter(plain(F.col("city")) == plain(F.lit("Sao José"))).select("id")


@query("b09_null_safe", "SELECT a.o_orderkey, a.o_orderstatus IS DISTINCT FROM nullif(a.o_orderstatus, 'P') AS differs, nullif(a.o_orderstatus, 'P') IS NOT DISTINCT FROM NULL AS same FROM orders a")
def b09(t: Tables) -> DataFrame:
    s, p = F.col("o_orderstatus"), F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return t.orders.select("o_orderkey", (~s.eqNullSafe(p)).alias("differs"), p.eqNullSafe(F.lit(None)).alias("same"))


both("b10_orphans", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
both("b11_exists_column", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) AS large FROM customer")


@query("b12_any_all", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> ALL(['P', 'X']) AND o_orderpriority = ANY(['1-URGENT', '2-HIGH'])")
def b12(t: Tables) -> DataFrame:
    return t.orders.filter(~F.col("o_orderstatus").isin("P", "X") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("b13_optional_list", "SELECT event_id FROM events WHERE len(['click', 'view']) = 0 OR list_contains(['click', 'view'], event_type)")
def b13(t: Tables) -> DataFrame:
    wanted = F.array(F.lit("click"), F.lit("view"))
    return t.events.filter((F.size(wanted) == 0) | F.array_contains(wanted, F.col("event_type"))).select("event_id")


both("b14_live_rows", "SELECT id FROM (SELECT id, CASE WHEN id % 7 = 0 THEN id - 1 END AS merged, CASE WHEN id % 11 = 0 THEN 'x' END AS dropped FROM poi) q WHERE merged IS NULL AND dropped IS NULL")


@query("b15_bands", "SELECT CASE WHEN c_acctbal >= 8000 THEN 'a' WHEN c_acctbal >= 4000 THEN 'b' WHEN c_acctbal >= 0 THEN 'c' ELSE 'd' END AS band, count(*) AS n FROM customer GROUP BY 1")
def b15(t: Tables) -> DataFrame:
    return t.customer.groupBy(rules.bands(F.col("c_acctbal"), [(8000, "a"), (4000, "b"), (0, "c")], "d").alias("band")).agg(F.count("*").alias("n"))


@query("b16_reason_code", "SELECT id, CASE WHEN NOT coalesce(number <> '', false) THEN 'no_number' WHEN NOT (lat < -29.981) THEN 'far' WHEN NOT (evidence < 4) THEN 'signals' END AS reason FROM poi")
def b16(t: Tables) -> DataFrame:
    return changes.funnel(t.poi, [("no_number", F.col("number") != ""), ("far", F.col("lat") < -29.981), ("signals", F.col("evidence") < 4)]).select("id", "reason")


@query("b17_coordinate_gate", "SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT CASE WHEN lat IS NULL THEN 'null' WHEN lat = 0 AND lng = 0 THEN 'zero' WHEN NOT (lat BETWEEN -29.999 AND -29.982) THEN 'box' END AS reason FROM (SELECT CASE WHEN id % 50 = 0 THEN NULL WHEN id % 51 = 0 THEN 0 ELSE lat END AS lat, CASE WHEN id % 51 = 0 THEN 0 ELSE lng END AS lng FROM poi) q) w GROUP BY 1")
def b17(t: Tables) -> DataFrame:
    p = t.poi.select(F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 51 == 0, 0.0).otherwise(F.col("lat")).alias("lat"), F.when(F.col("id") % 51 == 0, 0.0).otherwise(F.col("lng")).alias("lng"))
    return changes.funnel_counts(changes.funnel(p, [("null", F.col("lat").isNotNull()), ("zero", ~((F.col("lat") == 0) & (F.col("lng") == 0))), ("box", F.col("lat").between(-29.999, -29.982))]))


@query("b18_country_guard", "SELECT id, (lat + id % 40) BETWEEN -34 AND 6 AND lng BETWEEN -74 AND -34 AS ok FROM poi")
def b18(t: Tables) -> DataFrame:
    return t.poi.select("id", geo.plausible_point(F.col("lat") + F.col("id") % 40, F.col("lng")).alias("ok"))


@query("b19_vacant_name", "SELECT id, CASE WHEN id % 5 = 0 THEN true WHEN id % 5 = 1 THEN true ELSE false END AS vacant FROM poi")
def b19(t: Tables) -> DataFrame:
    n = F.when(F.col("id") % 5 == 0, "SALA COMERCIAL VAGA").when(F.col("id") % 5 == 1, "Sala 2 sem uso").when(F.col("id") % 5 == 2, "a loja que um dia ficou vazia").otherwise(F.col("name"))
    return t.poi.select("id", text.declares_vacant(n).alias("vacant"))


@query("b20_usable_text", "SELECT id, regexp_matches(upper(street), '[A-Z]{3}') AND upper(street) NOT IN ('AV NORTE') AS ok FROM poi")
def b20(t: Tables) -> DataFrame:
    u = F.upper("street")
    return t.poi.select("id", (u.rlike("[A-Z]{3}") & ~u.isin("AV NORTE")).alias("ok"))


@query("b21_generic_name", "SELECT id FROM poi WHERE len(list_filter(string_split(lower(name), ' '), lambda w: w NOT IN ('padaria','mercado','farmacia','oficina','salao','loja','bar','central'))) = 0")
def b21(t: Tables) -> DataFrame:
    generic = F.array(*map(F.lit, ("padaria", "mercado", "farmacia", "oficina", "salao", "loja", "bar", "central")))
    return t.poi.filter(F.size(F.array_except(text.words(F.col("name")), generic)) == 0).select("id")


@query("b22_code_prefix", "SELECT p_partkey, starts_with(lpad(p_size::VARCHAR, 2, '0'), '11') OR starts_with(lpad(p_size::VARCHAR, 2, '0'), '2') AS plausible FROM part")
def b22(t: Tables) -> DataFrame:
    code = F.lpad(F.col("p_size").cast("string"), 2, "0")
    return t.part.select("p_partkey", F.exists(F.array(F.lit("11"), F.lit("2")), lambda p: F.startswith(code, p)).alias("plausible"))


both("b23_three_statuses", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'YES' WHEN o_orderpriority LIKE '4%' THEN 'NO' ELSE 'YES_WITH_REVIEW' END AS status FROM orders")


@query("i10_comparable", "SELECT id FROM (SELECT id, CASE WHEN id % 9 = 0 THEN ' ' ELSE name END AS name, CASE WHEN id % 6 = 0 THEN NULL ELSE street END AS address FROM poi) q WHERE NOT (coalesce(trim(name) <> '', false) OR coalesce(trim(address) <> '', false))")
def i10(t: Tables) -> DataFrame:
    p = t.poi.select("id", F.when(F.col("id") % 9 == 0, " ").otherwise(F.col("name")).alias("name"), F.when(F.col("id") % 6 == 0, None).otherwise(F.col("street")).alias("address"))
    return fusion.comparable(p)[1].select("id")
