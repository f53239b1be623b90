"""Decisions about companies, addresses and links: the functions of ``geomill.operators.decisions`` over derived rows.

Inputs are SQL that Spark and DuckDB read alike; the rules themselves are written twice, as functions and as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.functions import identifiers, text
from geomill.operators import cluster, decisions, joins, verdicts

from .inputs import Tables, with_ctes
from .joins import METRES, RINGS, core
from .registry import query

COMPANY = """SELECT c_custkey AS id, concat(lpad(CAST(CAST(FLOOR(c_custkey / 3) AS BIGINT) AS VARCHAR(10)), 8, '0'), lpad(CAST(c_custkey % 3 + 1 AS VARCHAR(10)), 4, '0'), '00') AS number,
  CASE WHEN c_custkey % 3 > 0 AND c_custkey % 5 < 3 THEN 'BRANCH' ELSE 'HEAD' END AS kind, CASE WHEN c_custkey % 7 = 2 THEN '2135' ELSE '2062' END AS legal,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(c_custkey AS DOUBLE) * c_custkey * 7 % 20000003 END AS capital,
  CASE c_custkey % 6 WHEN 0 THEN '5611201' WHEN 1 THEN '5612100' WHEN 2 THEN '4711302' WHEN 3 THEN '6201500' WHEN 4 THEN '4930202' ELSE '9999999' END AS code,
  c_custkey % 2 = 0 AS established, c_custkey % 9 = 1 AS recent, c_custkey % 8 <> 3 AS date_ok, c_custkey % 10 <> 4 AS capital_ok, c_custkey % 4 = 1 AS register_shop, c_custkey % 5 <> 0 AS register_applies
FROM customer"""
EXCEPTIONS = {"5612100": ("mobile", True), "6201500": ("paper", False)}
DIVISIONS = {"56": ("on_site", True), "47": ("hybrid", True), "62": ("hybrid", False), "49": ("on_site", False)}
_PROFILE = "CASE code WHEN '5612100' THEN 'mobile' WHEN '6201500' THEN 'paper' ELSE CASE substring(code, 1, 2) WHEN '56' THEN 'on_site' WHEN '47' THEN 'hybrid' WHEN '49' THEN 'on_site' ELSE 'uncertain' END END"
_PUBLIC = "(code = '5612100' OR (code <> '6201500' AND substring(code, 1, 2) IN ('56', '47')))"
_CLASS = f"""c AS ({COMPANY}), n AS (SELECT substring(number, 1, 8) AS root, count(*) AS branches FROM c WHERE kind = 'BRANCH' GROUP BY 1),
k AS (SELECT c.*, {_PROFILE} AS profile, {_PUBLIC} AS serves_public, coalesce(branches, 0) AS branches, CASE WHEN kind = 'BRANCH' THEN 'branch' WHEN branches > 0 THEN 'head_with_branches' WHEN legal LIKE '2135%' THEN 'single' ELSE 'head' END AS role FROM c LEFT JOIN n ON n.root = substring(number, 1, 8))"""


def rows(t: Tables, sql: str) -> DataFrame:
    return t.sql(with_ctes(sql))


def companies(t: Tables) -> DataFrame:
    p = decisions.profile_by_code(F.col("code"), EXCEPTIONS, DIVISIONS)
    return decisions.company_class(rows(t, COMPANY)).withColumn("_p", p).select("*", "_p.profile", "_p.serves_public", "_p.reason", "_p.confidence").drop("_p")


@query("h708_profile_by_code", f"SELECT id, {_PROFILE} AS profile, {_PUBLIC} AS serves_public, CASE WHEN code IN ('5612100', '6201500') THEN 'exception' WHEN substring(code, 1, 2) IN ('56', '47', '62', '49') THEN 'division' ELSE 'unmapped' END AS reason, CASE WHEN code IN ('5612100', '6201500') THEN 'high' WHEN substring(code, 1, 2) IN ('56', '47', '62', '49') THEN 'middle' ELSE 'low' END AS confidence FROM ({COMPANY}) c")
def h708(t: Tables) -> DataFrame:
    return companies(t).select("id", "profile", "serves_public", "reason", "confidence")


@query("h709_company_class", f"WITH {_CLASS} SELECT id, CASE WHEN capital IS NULL OR capital <= -1 THEN 'undefined' WHEN capital <= 0 THEN 'zero' WHEN capital <= 999 THEN 'micro_min' WHEN capital <= 9999 THEN 'micro' WHEN capital <= 99999 THEN 'micro_plus' WHEN capital <= 999999 THEN 'small' WHEN capital <= 9999999 THEN 'middle' WHEN capital <= 99999999 THEN 'large' ELSE 'corporate' END AS capital_class, CASE WHEN capital IS NULL OR capital <= -1 THEN 'undefined' WHEN capital <= 9999 THEN 'micro' WHEN capital <= 99999 THEN 'small' WHEN capital <= 9999999 THEN 'middle' ELSE 'large' END AS size, branches, role FROM k")
def h709(t: Tables) -> DataFrame:
    return companies(t).select("id", "capital_class", "size", "branches", "role")


_POINTS = [("profile = 'on_site'", 3, "on_site"), ("serves_public", 2, "serves_public"), ("role = 'branch'", 2, "branch"), ("register_shop AND register_applies", 2, "register_confirms"), ("profile = 'hybrid'", 1, "hybrid"), ("role = 'head_with_branches'", 1, "head_with_branches"), ("established AND date_ok", 1, "established"), ("recent AND date_ok", -1, "recent"), ("capital >= 100000 AND capital_ok", 1, "capital"), ("role = 'single' AND profile NOT IN ('on_site', 'hybrid')", -1, "single_not_on_site")]


@query(
    "h707_structure_score",
    f"WITH {_CLASS}, s AS (SELECT id, greatest(0, least(12, {' + '.join(f'CASE WHEN {c} THEN {n} ELSE 0 END' for c, n, _ in _POINTS)}))::INT AS structure, coalesce(nullif(concat_ws(' | ', {', '.join(f'CASE WHEN {c} THEN {chr(39)}{w}{chr(39)} END' for c, _, w in _POINTS)}), ''), 'none') AS structure_why FROM k) SELECT *, CASE WHEN structure >= 8 THEN 'very_high' WHEN structure >= 6 THEN 'high' WHEN structure >= 4 THEN 'middle' WHEN structure >= 2 THEN 'low' ELSE 'very_low' END AS structure_band FROM s",
)
def h707(t: Tables) -> DataFrame:
    return decisions.structure_score(companies(t)).select("id", "structure", "structure_why", "structure_band")


REGISTER = "SELECT id, id % 9 <> 0 AS matched, CASE WHEN id % 6 = 5 THEN NULL ELSE CAST(id % 6 AS INT) END AS indicator, CASE WHEN id % 7 = 0 THEN NULL ELSE id % 4 END AS shops, CASE WHEN id % 8 = 0 THEN NULL ELSE id % 3 END AS homes FROM poi"


@query("h710_address_route", f"WITH r AS ({REGISTER}) SELECT id, CASE WHEN NOT matched THEN 'no_match' WHEN indicator = 1 THEN 'one_shop' WHEN indicator = 2 THEN 'up_to_ten_shops' WHEN indicator = 3 THEN 'over_ten_shops' WHEN indicator = 4 THEN 'many_shops' WHEN shops > 0 THEN 'shops_without_indicator' WHEN homes > 0 THEN 'homes_only' ELSE 'undetermined' END AS address_profile, CASE WHEN NOT matched THEN 'none' WHEN indicator = 1 THEN 'reclassify' WHEN indicator IN (2, 3, 4) THEN 'individualise' WHEN shops > 1 THEN 'individualise' WHEN shops = 1 THEN 'reclassify' ELSE 'visit' END AS route, coalesce(shops, 0) > 0 AND coalesce(homes, 0) > 0 AS mixed FROM r")
def h710(t: Tables) -> DataFrame:
    return decisions.address_route(rows(t, REGISTER)).select("id", "address_profile", "route", "mixed")


BUSINESS = f"""SELECT id, CASE id % 5 WHEN 0 THEN 'RESIDENTIAL' WHEN 1 THEN 'COMMERCIAL' ELSE 'OTHER' END AS complement, id % 11 = 0 AS needs_premises, {_PROFILE} AS profile, {_PUBLIC} AS serves_public, id % 4 = 0 AS located, id % 3 <> 0 AS street_ok,
  id % 7 AS number, CASE WHEN id % 10 = 9 THEN ' ' ELSE 'Canoas' END AS city, CASE WHEN id % 17 = 0 THEN NULL ELSE 'RS' END AS state, id % 6 <> 0 AS postcode_ok, id % 13 <> 0 AS document_ok, 'bad_digits' AS document_status, CASE WHEN id % 8 = 7 THEN 'CLOSED' ELSE 'ACTIVE' END AS status FROM ({COMPANY}) q"""


@query(
    "h711_business_decision",
    f"""WITH b AS ({BUSINESS}), m AS (SELECT *, complement = 'COMMERCIAL' OR needs_premises AS point, coalesce(trim(city) <> '' AND trim(state) <> '', false) AS placed FROM b),
c AS (SELECT *, CASE WHEN complement = 'RESIDENTIAL' AND NOT needs_premises THEN 'residential' WHEN profile = 'on_site' AND serves_public THEN 'shop' WHEN profile = 'on_site' THEN 'on_site_not_public' WHEN point THEN 'other_point' WHEN profile = 'hybrid' AND serves_public THEN 'occasional_shop' ELSE 'not_commercial' END AS commercial,
  CASE WHEN located THEN 'coordinate' WHEN street_ok AND number > 0 AND placed THEN 'whole_address' WHEN street_ok AND placed THEN 'part_of_address' WHEN postcode_ok THEN 'postcode' ELSE 'unfit' END AS fitness FROM m)
SELECT id, commercial, fitness, document_ok AND status = 'ACTIVE' AND commercial IN ('shop', 'occasional_shop', 'other_point', 'on_site_not_public') AS usable,
  CASE WHEN NOT document_ok THEN 'document_bad_digits' WHEN status <> 'ACTIVE' THEN 'status_' || status WHEN commercial IN ('shop', 'occasional_shop', 'other_point', 'on_site_not_public') THEN '' ELSE coalesce(nullif(concat_ws(' + ', CASE WHEN commercial = 'residential' THEN 'residential_complement' END, CASE WHEN profile = 'paper' THEN 'paper_company' END, CASE WHEN profile = 'mobile' THEN 'mobile_company' END, CASE WHEN profile = 'uncertain' THEN 'unmapped_activity' END), ''), 'no_public_on_site') END AS why_not FROM c""",
)
def h711(t: Tables) -> DataFrame:
    return decisions.business_decision(rows(t, BUSINESS)).select("id", "commercial", "fitness", "usable", "why_not")


RELIABLE = "SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE CAST(id % 7 + 1 AS INT) END AS level, CASE WHEN id % 3 = 0 THEN street END AS street_harmonised, CASE WHEN id % 4 <> 0 THEN street END AS street, CAST(nullif(number, '') AS BIGINT) AS number, CASE WHEN id % 5 = 0 THEN '' ELSE postcode END AS postcode, CASE WHEN id % 6 = 0 THEN 'ap 1' END AS complement, id % 2 = 0 AS geo_ok, id % 8 = 0 AS anomaly, id % 10 = 0 AS inferred FROM poi"


@query(
    "h712_reliability",
    f"""WITH r AS ({RELIABLE}), e AS (SELECT id, (CASE WHEN inferred THEN 0 ELSE CASE coalesce(level, 6) WHEN 1 THEN 40 WHEN 2 THEN 35 WHEN 3 THEN 20 WHEN 4 THEN 10 WHEN 5 THEN 5 ELSE 0 END END)::INT AS by_coordinate,
  (CASE WHEN street_harmonised IS NOT NULL THEN 10 WHEN street IS NOT NULL THEN 7 ELSE 0 END + CASE WHEN number > 0 THEN 8 ELSE 0 END + CASE WHEN length(regexp_replace(postcode, '[^0-9]', '', 'g')) = 8 OR (NOT inferred AND level IN (1, 2) AND geo_ok) THEN 7 ELSE 0 END + CASE WHEN complement IS NOT NULL THEN 5 ELSE 0 END)::INT AS by_address,
  (CASE WHEN geo_ok THEN 10 ELSE 0 END + CASE WHEN street_harmonised IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN anomaly THEN 0 ELSE 7 END + CASE WHEN inferred THEN 0 ELSE 5 END)::INT AS by_context FROM r)
SELECT *, by_coordinate + by_address + by_context AS reliability, CASE WHEN by_coordinate + by_address + by_context > 75 THEN 'very_high' WHEN by_coordinate + by_address + by_context > 55 THEN 'high' WHEN by_coordinate + by_address + by_context > 35 THEN 'middle' ELSE 'low' END AS band FROM e""",
)
def h712(t: Tables) -> DataFrame:
    return decisions.reliability(rows(t, RELIABLE)).select("id", "by_coordinate", "by_address", "by_context", "reliability", "band")


LATE = "SELECT id, CAST(id % 7 AS INT) AS level, CASE WHEN id % 2 = 0 THEN 'b' END AS block, CASE WHEN id % 3 = 0 THEN 'u' END AS unit, CASE WHEN id % 5 <> 0 THEN 'f' END AS floor, CASE id % 4 WHEN 0 THEN 'repeated_shop' WHEN 1 THEN 'sequence' ELSE '' END AS reason, id % 11 = 0 AS flagged FROM poi"


@query("h717_late_signal", f"WITH r AS ({LATE}), s AS (SELECT *, level IN (4, 5, 6) AND block IS NOT NULL AND unit IS NOT NULL AND floor IS NOT NULL AS s5 FROM r) SELECT id, concat_ws('|', nullif(reason, ''), CASE WHEN s5 THEN 'poor_point_rich_complement' END) AS reasons, flagged OR (s5 AND reason = 'repeated_shop') AS flagged FROM s")
def h717(t: Tables) -> DataFrame:
    r = rows(t, LATE).withColumn("reasons", F.filter(F.array("reason"), lambda x: x != ""))
    return decisions.late_signal(r).select("id", F.concat_ws("|", "reasons").alias("reasons"), "flagged")


REGISTERED = "SELECT id, concat(street, ' ', CAST(number AS VARCHAR(10))) AS place, CAST(id % 8 + 1 AS INT) AS kind, CASE WHEN id % 6 = 0 THEN CAST(id % 5 AS INT) END AS indicator, id % 3 = 0 AS ground, street, CASE WHEN id % 4 = 0 THEN 'f' END AS floor, id % 12 AS unit FROM door"


@query("h718_declared_vs_counted", f"WITH r AS ({REGISTERED}), g AS (SELECT place, count(*) FILTER (WHERE kind IN (3, 4, 5, 6, 8)) AS counted, max(indicator) AS d FROM r GROUP BY place) SELECT place, counted, CASE WHEN d IS NULL OR d NOT BETWEEN 1 AND 4 THEN 'not_declared' WHEN counted < CASE d WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 11 ELSE 2 END THEN 'fewer' WHEN counted > CASE d WHEN 1 THEN 1 WHEN 2 THEN 10 ELSE 1000000000 END THEN 'more' ELSE 'confirmed' END AS verdict FROM g")
def h718(t: Tables) -> DataFrame:
    return decisions.declared_vs_counted(rows(t, REGISTERED), "place")


@query("h721_mixed_use", f"WITH r AS ({REGISTERED}) SELECT place, bool_or(kind IN (1, 2)) AND bool_or(kind IN (3, 4, 5, 6, 8)) AS mixed, bool_or(kind IN (3, 4, 5, 6, 8) AND ground) AND bool_or(kind = 1 AND NOT ground) AS active_front FROM r GROUP BY place")
def h721(t: Tables) -> DataFrame:
    return decisions.mixed_use(rows(t, REGISTERED), "place")


@query("h722_group_thresholds", f"WITH r AS ({REGISTERED}) SELECT place, count(DISTINCT unit) AS units, count(DISTINCT unit) >= 2 AND count(DISTINCT street) <= 2 AND avg((kind IN (1, 2) AND floor IS NULL)::INT) >= 0.2 AS compound FROM r GROUP BY place")
def h722(t: Tables) -> DataFrame:
    return decisions.horizontal_compound(rows(t, REGISTERED), "place", least=2, share=0.2)


@query("h723_probable_address", "SELECT id, concat_ws(', ', street, CASE WHEN number <> '' THEN number ELSE 'S/N' END, CASE WHEN id % 4 = 0 THEN 'casa 2' END, CASE WHEN id % 5 = 0 THEN 'Centro' END) || CASE WHEN id % 3 = 0 THEN ' (inferred)' ELSE '' END AS address FROM poi")
def h723(t: Tables) -> DataFrame:
    i = F.col("id")
    a = decisions.probable_address(F.col("street"), F.col("number"), F.when(i % 4 == 0, "casa 2"), i % 3 == 0, F.when(i % 5 == 0, "Centro").otherwise(""))
    return t.poi.select("id", a.alias("address"))


VOTES = "SELECT CAST(FLOOR(id / 4) AS BIGINT) AS connection, CASE WHEN id % 10 = 0 THEN id - id % 20 ELSE id END AS poi, source, id % 7 <> 0 AS valid, id % 900 AS age FROM poi"


CITED = "SELECT CAST(FLOOR(id / 3) AS BIGINT) AS connection, CASE WHEN id % 10 = 0 THEN id - id % 20 ELSE id END AS poi, CASE WHEN id % 23 = 0 THEN 'Different ' END AS seen_number FROM poi"
LISTED = "SELECT CAST(FLOOR(id / 3) AS BIGINT) AS connection, CASE WHEN id % 10 = 0 THEN id - id % 20 ELSE id END AS poi FROM poi WHERE id % 29 <> 0"
CONNECTIONS = "SELECT DISTINCT CAST(FLOOR(id / 3) AS BIGINT) AS connection, CASE WHEN CAST(FLOOR(id / 3) AS BIGINT) % 4 = 0 THEN 'casa 2' ELSE '' END AS unit, CAST(CAST(FLOOR(id / 3) AS BIGINT) % 22 + 1 AS VARCHAR(10)) AS number, CASE CAST(FLOOR(id / 3) AS BIGINT) % 7 WHEN 0 THEN 'SIM_COM_ANALISE_HUMANA' ELSE 'SIM' END AS qualification, CAST(FLOOR(id / 3) AS BIGINT) % 2 = 0 AS light, CAST(FLOOR(id / 3) AS BIGINT) % 11 = 0 AS abandoned, CASE WHEN CAST(FLOOR(id / 3) AS BIGINT) % 9 = 0 THEN 'Igreja local' ELSE 'loja' END AS use FROM poi"
RECORDS = "SELECT id AS poi, CASE WHEN id % 31 = 0 THEN 'religious' END AS not_commerce, CASE WHEN id % 8 = 1 THEN 'casa 3' WHEN id % 8 = 2 THEN 'casa 2' END AS unit, CASE WHEN id % 5 = 0 THEN '' WHEN id % 5 = 1 THEN CAST(id % 22 + 1 AS VARCHAR(10)) ELSE CAST(CAST(FLOOR(id / 3) AS BIGINT) % 22 + 1 AS VARCHAR(10)) END AS number FROM poi"
PROOFS = "SELECT id AS poi, source, split_part('street_photo,review,photo,social,web,register', ',', CAST(id * 5 % 6 AS INT) + 1) AS kind, CASE WHEN id % 12 > 0 THEN id * 37 % 1500 END AS age FROM poi UNION ALL SELECT id, 'maps', split_part('review,photo,comment,register', ',', CAST(id % 4 AS INT) + 1), id * 91 % 1100 FROM poi WHERE id % 3 = 0"
_REASON = f"""c AS (SELECT connection, poi, max(CASE WHEN seen_number IS NOT NULL THEN 1 ELSE 0 END) AS seen FROM ({CITED}) q GROUP BY connection, poi),
v AS (SELECT c.connection, c.poi, CASE WHEN l.poi IS NULL THEN 'not_listed' WHEN not_commerce IS NOT NULL THEN 'not_commerce' WHEN k.unit = 'casa 2' AND r.unit = 'casa 3' THEN 'other_unit' WHEN r.number <> '' AND r.number <> k.number THEN 'other_number' WHEN seen = 1 THEN 'other_number_seen' END AS reason
  FROM c LEFT JOIN (SELECT DISTINCT connection, poi FROM ({LISTED}) q) l ON l.connection = c.connection AND l.poi = c.poi LEFT JOIN ({CONNECTIONS}) k ON k.connection = c.connection LEFT JOIN ({RECORDS}) r ON r.poi = c.poi)"""


def cited(t: Tables) -> DataFrame:
    return verdicts.cited_records(rows(t, CITED), rows(t, LISTED), rows(t, CONNECTIONS), rows(t, RECORDS))


@query("h724_cited_records", f"WITH {_REASON} SELECT connection, poi, reason FROM v")
def h724b(t: Tables) -> DataFrame:
    return cited(t)


@query(
    "h724_final_verdicts",
    f"""WITH {_REASON}, g AS (SELECT connection, poi, count(*) OVER (PARTITION BY poi) AS claims FROM v WHERE reason IS NULL),
f AS (SELECT *, TIMESTAMP '2026-01-01' - to_days(age::INT) AS day, CASE WHEN age IS NULL THEN NULL ELSE (DATE '2026-01-01' - age::INT) END AS d FROM ({PROOFS}) q),
m AS (SELECT *, CASE WHEN day(d) = 1 THEN (2026 - year(d)) * 12 + 1 - month(d) ELSE (2026 - year(d)) * 12 + 1 - month(d) + (1 - day(d)) / 31.0 END AS months FROM f),
p AS (SELECT g.connection, count(DISTINCT CASE WHEN kind = 'street_photo' OR (kind <> 'web' AND months <= 24) THEN source END) AS sources,
  max((kind = 'street_photo' OR (kind <> 'web' AND coalesce(months <= 24, false)))::INT) AS proven, max((kind = 'street_photo' OR coalesce((kind = 'review' AND months <= 12) OR (kind IN ('photo', 'comment') AND months < 12), false))::INT) AS strong, max((kind = 'social' AND coalesce(months <= 24, false))::INT) AS post
  FROM g LEFT JOIN m ON m.poi = g.poi WHERE claims = 1 GROUP BY g.connection),
d AS (SELECT DISTINCT connection FROM g WHERE claims > 1),
w AS (SELECT k.connection, CASE WHEN proven IS NULL THEN CASE WHEN d.connection IS NOT NULL THEN 'in_doubt' ELSE 'no_record' END
  WHEN proven = 0 AND NOT (post = 1 AND qualification = 'SIM' AND NOT abandoned AND use = 'loja') THEN 'no_recent_proof' WHEN light AND abandoned THEN 'abandoned'
  WHEN light AND sources < 2 AND strong = 0 AND NOT (post = 1 AND qualification = 'SIM' AND NOT abandoned AND use = 'loja') THEN 'one_source' WHEN qualification <> 'SIM' THEN 'qualification' END AS why
  FROM ({CONNECTIONS}) k LEFT JOIN p ON p.connection = k.connection LEFT JOIN d ON d.connection = k.connection)
SELECT connection, CASE WHEN why IS NULL THEN 'approved' ELSE 'review' END AS verdict, why FROM w""",
)
def h724c(t: Tables) -> DataFrame:
    today = F.lit("2026-01-01").cast("date")
    proofs = rows(t, PROOFS).withColumn("day", F.date_sub(today, F.col("age").cast("int")))
    return verdicts.final_verdicts(cited(t), rows(t, CONNECTIONS), proofs, today)


@query("h724_checked_decision", f"WITH v AS ({VOTES}), g AS (SELECT * FROM v WHERE valid), o AS (SELECT poi, count(DISTINCT connection) AS claims FROM g GROUP BY poi), s AS (SELECT connection, count(DISTINCT CASE WHEN claims = 1 THEN source END) AS sources, min(age) AS age FROM g JOIN o USING (poi) GROUP BY connection) SELECT connection, coalesce(sources, 0) AS sources, CASE WHEN sources IS NULL THEN 'NO' WHEN sources < 2 OR age > 365 THEN 'REVIEW' ELSE 'YES' END AS decision FROM (SELECT DISTINCT connection FROM v) c LEFT JOIN s USING (connection)")
def h724(t: Tables) -> DataFrame:
    today = F.lit("2026-01-01").cast("date")
    return decisions.checked_decision(rows(t, VOTES).withColumn("day", F.date_sub(today, F.col("age").cast("int"))), today)


@query("h726_vacant_after_proof", "WITH s AS (SELECT user_id, max(ts::DATE) AS sign FROM events WHERE event_type = 'error' GROUP BY user_id), p AS (SELECT user_id, max(ts::DATE) AS proof FROM events WHERE event_type = 'click' AND event_id % 5 = 0 GROUP BY user_id) SELECT user_id, proof IS NULL OR sign >= proof AS vacant FROM s LEFT JOIN p USING (user_id)")
def h726(t: Tables) -> DataFrame:
    e = t.events.select("user_id", "event_type", "event_id", F.to_date("ts").alias("day"))
    return decisions.vacant_after_proof(e.filter("event_type = 'error'"), e.filter("event_type = 'click' AND event_id % 5 = 0"), "user_id")


@query("h727_document_confidence", "SELECT id, (CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 3 = 0 AND id % 4 = 0 THEN 1 ELSE 0 END + CASE WHEN id % 3 = 0 AND id % 5 = 0 THEN 1 ELSE 0 END)::INT AS level, coalesce(nullif(concat_ws('+', CASE WHEN id % 2 = 0 THEN 'digits' END, CASE WHEN id % 3 = 0 THEN 'base' END, CASE WHEN id % 3 = 0 AND id % 4 = 0 THEN 'state' END, CASE WHEN id % 3 = 0 AND id % 5 = 0 THEN 'city' END), ''), 'structure_only') AS marks FROM poi")
def h727(t: Tables) -> DataFrame:
    i = F.col("id")
    return t.poi.select("id", decisions.document_confidence(i % 2 == 0, i % 3 == 0, i % 4 == 0, i % 5 == 0).alias("c")).select("id", F.col("c.level").cast("int").alias("level"), "c.marks")


@query("h728_graded_flags", "SELECT id, CASE WHEN id % 6 = 4 THEN 'reclassify_high' WHEN id % 6 = 5 THEN 'reclassify_low' ELSE 'reclassify_middle' END AS flag FROM poi")
def h728(t: Tables) -> DataFrame:
    i = F.col("id")
    return t.poi.select("id", decisions.graded_flag(F.when(i % 6 < 5, F.concat((i % 6).cast("string"), F.lit("/4 digits"))).otherwise("none")).alias("flag"))


@query("h729_consistency_checks", "SELECT id, CASE WHEN number <> '' AND lat > -29.985 THEN 'far_north' ELSE '' END AS errors, concat_ws('|', CASE WHEN number = '' AND street LIKE 'Rua%' THEN 'street_without_number' END, CASE WHEN category = 'saude' AND name NOT LIKE 'Farmacia%' THEN 'name_and_kind' END) AS warnings, CASE WHEN number <> '' AND lat > -29.985 THEN 0.0 WHEN (number = '' AND street LIKE 'Rua%') OR (category = 'saude' AND name NOT LIKE 'Farmacia%') THEN least(evidence / 4, 0.6) ELSE evidence / 4 END::DOUBLE AS confidence FROM poi")
def h729(t: Tables) -> DataFrame:
    number, street = F.col("number") != "", F.col("street").startswith("Rua")
    c = decisions.consistency_checks(
        {"far_north": number & (F.col("lat") > -29.985)}, {"street_without_number": ~number & street, "name_and_kind": (F.col("category") == "saude") & ~F.col("name").startswith("Farmacia")}, F.col("evidence") / 4
    )
    return t.poi.select("id", c.alias("c")).select("id", F.concat_ws("|", "c.errors").alias("errors"), F.concat_ws("|", "c.warnings").alias("warnings"), "c.confidence")


# ---- links -------------------------------------------------------------------------------------
AREAS = "CASE {0} % 4 WHEN 0 THEN 'Vila Nova' WHEN 1 THEN 'Jardim Europa' WHEN 2 THEN 'Europa' ELSE '' END"
_SAME = "(x.area = y.area OR (x.area LIKE '%Europa' AND y.area LIKE '%Europa'))"


@query(
    "c10_exact_address",
    f"WITH x AS (SELECT id, {core('street')} || '|' || number AS address, {AREAS.format('id')} AS area, id % 9 <> 0 AS fit, id % 11 = 0 AS inactive FROM poi WHERE number <> ''), y AS (SELECT id, {core('street')} || '|' || number AS address, {AREAS.format('CAST(FLOOR(id / 3) AS BIGINT)')} AS area FROM door) SELECT x.id AS a_id, y.id AS b_id, CASE WHEN inactive THEN 'inactive' WHEN NOT fit THEN 'unfit' WHEN x.area <> '' AND y.area <> '' AND NOT {_SAME} THEN 'other_area' END AS reason FROM x JOIN y USING (address)",
)
def c10(t: Tables) -> DataFrame:
    from .joins import addressed

    i = F.col("id")
    x = addressed(t.poi).withColumns({"area": F.expr(AREAS.format("id")), "fit": i % 9 != 0, "inactive": i % 11 == 0})
    return decisions.exact_address(x, addressed(t.door).withColumn("area", F.expr(AREAS.format("CAST(FLOOR(id / 3) AS BIGINT)"))))


@query("i12_review_links", "WITH f AS (SELECT id, id % 2 = 0 AS street, id % 3 = 0 AS number, id % 5 = 0 AS near, id % 4 < 2 AS roof, id % 7 = 0 AS shop, id % 11 <> 0 AS proven, id % 13 = 0 AS inactive FROM poi), v AS (SELECT *, CASE WHEN street AND number THEN 70 WHEN street THEN 35 ELSE 10 END + roof::INT * 20 + shop::INT * 5 + near::INT * 5 AS v FROM f), c AS (SELECT *, least(CASE WHEN NOT proven AND (street OR number) THEN least(v, 60) ELSE v END, 100)::DOUBLE / 100 AS confidence FROM v) SELECT id, confidence, CASE WHEN inactive THEN 'company' WHEN confidence >= 0.6 THEN NULL WHEN NOT street AND NOT roof THEN 'place' WHEN street AND NOT number AND NOT near THEN 'distance' ELSE 'evidence' END AS dropped FROM c")
def i12(t: Tables) -> DataFrame:
    i = F.col("id")
    f = t.poi.select("id", (i % 2 == 0).alias("street"), (i % 3 == 0).alias("number"), (i % 5 == 0).alias("near"), (i % 4 < 2).alias("roof"), (i % 7 == 0).alias("shop_roof"), (i % 11 != 0).alias("proven"), (i % 13 == 0).alias("inactive"))
    return decisions.review_links(f).select("id", "confidence", "dropped")


SIGNS = "SELECT id, street, name, CASE WHEN id % 3 = 0 THEN 0 ELSE 40 + id % 24 END AS seen FROM poi WHERE number = ''"
_W = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda t: t <> ''))"


@query(
    "i13_street_evidence",
    f"""WITH s AS (SELECT *, {_W.format('name')} AS w FROM ({SIGNS}) q), n AS (SELECT street, {_W.format('name')} AS v, number::BIGINT AS number FROM poi WHERE number <> '' AND evidence = 4),
a AS (SELECT id, number FROM s JOIN n USING (street) WHERE (len(list_intersect(w, v)) >= 2 OR (len(w) = 1 AND len(v) = 1 AND w = v)) AND len(list_intersect(w, v)) / least(len(w), len(v)) >= 0.8),
one AS (SELECT id, min(number) AS number FROM a GROUP BY id HAVING count(DISTINCT number) = 1),
near AS (SELECT DISTINCT s.id, s.street, s.name, d.number FROM s JOIN door d ON d.street = s.street AND d.number BETWEEN s.seen - 4 AND s.seen + 4 WHERE s.seen > 0 AND s.id NOT IN (SELECT id FROM one)),
two AS (SELECT id, min(number) AS number FROM near GROUP BY id HAVING count(DISTINCT number) = 1),
many AS (SELECT street, name, count(DISTINCT id) AS n FROM near GROUP BY street, name HAVING count(DISTINCT id) > 1),
shared AS (SELECT street, name, number FROM near JOIN many USING (street, name) GROUP BY street, name, number, n HAVING count(DISTINCT id) = n),
three AS (SELECT street, name, min(number) AS number FROM shared GROUP BY street, name HAVING count(*) = 1)
SELECT id, number, 'name' AS step FROM one UNION ALL SELECT id, number, 'scene' FROM two UNION ALL SELECT DISTINCT near.id, three.number, 'sightings' FROM near JOIN three USING (street, name) WHERE near.id NOT IN (SELECT id FROM two)""",
)
def i13(t: Tables) -> DataFrame:
    signs = rows(t, SIGNS).withColumn("seen", F.when(F.col("seen") > 0, F.array("seen")).otherwise(F.array().cast("array<bigint>")))
    named = t.poi.filter("number <> '' AND evidence = 4").select("street", "name", F.col("number").cast("bigint").alias("number"))
    return decisions.street_evidence(signs, named, t.door.select("street", "number"))


# ---- places ------------------------------------------------------------------------------------
@query("j03_area_choice", "WITH a AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'Vila Nova' WHEN id % 4 = 1 THEN 'Jardim Europa' END AS p, CASE WHEN id % 3 = 0 THEN 'Europa' WHEN id % 3 = 1 THEN ' ' END AS r FROM poi) SELECT id, coalesce(p, nullif(trim(r), ''), 'Centro') AS area, CASE WHEN p IS NOT NULL THEN 'published' WHEN trim(r) <> '' THEN 'reverse' ELSE 'sieve' END AS origin, coalesce(p = 'Vila Nova' AND r = 'Europa', false) AS doubt FROM a")
def j03(t: Tables) -> DataFrame:
    i = F.col("id")
    c = decisions.area_choice(F.when(i % 4 == 0, "Vila Nova").when(i % 4 == 1, "Jardim Europa"), F.when(i % 3 == 0, "Europa").when(i % 3 == 1, " "), F.lit("Centro"))
    return t.poi.select("id", c.alias("c")).select("id", "c.*")


ASKED = "SELECT id, CASE WHEN id % 5 = 0 THEN '' ELSE street END AS street, CAST(nullif(number, '') AS BIGINT) AS number, CASE WHEN id % 10 = 0 THEN '92000-000' ELSE postcode END AS postcode FROM poi"


@query(
    "j06_preference_order",
    f"""WITH a AS (SELECT *, {core('street')} AS k FROM ({ASKED}) q), d AS (SELECT *, {core('street')} AS k FROM door),
s AS (SELECT a.id, a.number, d.id AS door, abs(a.number - d.number) AS apart, row_number() OVER (PARTITION BY a.id ORDER BY coalesce(abs(a.number - d.number), 0), CASE WHEN a.number IS NULL THEN 0 ELSE d.number END, d.id) AS rn FROM a JOIN d ON a.k = d.k WHERE a.k <> ''),
s1 AS (SELECT id, door, CASE WHEN number IS NULL THEN 'street' WHEN apart = 0 THEN 'street_number' ELSE 'street_nearest' END AS how FROM s WHERE rn = 1),
p AS (SELECT a.id, d.id AS door, row_number() OVER (PARTITION BY a.id ORDER BY coalesce(abs(a.number - d.number), 0), CASE WHEN a.number IS NULL THEN 0 ELSE d.number END, d.id) AS rn FROM a JOIN d ON a.postcode = d.postcode WHERE a.postcode NOT LIKE '%000' AND a.id NOT IN (SELECT id FROM s1)),
u AS (SELECT * FROM s1 UNION ALL SELECT id, door, 'postcode' FROM p WHERE rn = 1)
SELECT a.id, u.door, coalesce(u.how, 'none') AS how FROM a LEFT JOIN u USING (id)""",
)
def j06(t: Tables) -> DataFrame:
    return decisions.preferred_coordinate(rows(t, ASKED), t.door.select("id", "street", "number", "postcode"))


@query("j08_geocoder_order", "WITH o AS (SELECT p.id, s.k, s.source, (p.id + s.k) % 3 <> 0 AS city_ok, (p.id * s.k) % 4 <> 1 AS street_ok, CASE (p.id + s.k) % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'street' WHEN 2 THEN 'area' ELSE 'city' END AS p FROM poi p CROSS JOIN (VALUES (1, 'census'), (2, 'open'), (3, 'maps')) AS s(k, source)), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS rn FROM o WHERE city_ok AND (street_ok OR p IN ('area', 'city'))) SELECT id, source, CASE p WHEN 'exact' THEN 10 WHEN 'street' THEN 100 WHEN 'area' THEN 1000 ELSE 10000 END AS metres FROM r WHERE rn = 1")
def j08(t: Tables) -> DataFrame:
    order = ["census", "open", "maps"]
    a = t.poi.select("id", F.posexplode(F.array(*map(F.lit, order))).alias("k", "source")).withColumn("k", F.col("k") + 1)
    precision = F.element_at(F.array(*map(F.lit, ("exact", "street", "area", "city"))), ((F.col("id") + F.col("k")) % 4 + 1).cast("int"))
    a = a.select("id", "source", ((F.col("id") + F.col("k")) % 3 != 0).alias("city_ok"), ((F.col("id") * F.col("k")) % 4 != 1).alias("street_ok"), precision.alias("precision"))
    return decisions.geocoder_choice(a, order)


MOVED = "SELECT id, lat, lng, street, CAST(nullif(number, '') AS BIGINT) AS number, concat(street, ', ', number, CASE WHEN id % 4 = 0 THEN ' - Centro' ELSE '' END, CASE WHEN id % 3 = 0 THEN concat(' ', postcode) ELSE '' END) AS address FROM poi"
KNOWN = "SELECT id, lat, lng, street, number, CASE WHEN id % 50 < 5 THEN 'Centro' ELSE 'Fatima' END AS area, postcode FROM door WHERE id % 3 = 0"


@query(
    "j10_move_with_proof",
    f"""WITH a AS ({MOVED}), b AS ({KNOWN}), p AS (SELECT a.id, b.id AS door, {METRES} AS m, concat_ws('+', CASE WHEN contains(lower(address), lower(area)) THEN 'area' END, CASE WHEN contains(regexp_replace(address, '[^0-9]', '', 'g'), replace(postcode, '-', '')) THEN 'postcode' END) AS proof,
  regexp_matches(address, '[0-9]{{5}}-[0-9]{{3}}') AND regexp_extract(address, '[0-9]{{5}}-[0-9]{{3}}') <> postcode AS against FROM a JOIN b ON a.street = b.street AND a.number = b.number),
r AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id ORDER BY proof = '', m, door) AS rn FROM p)
SELECT id, door, round(m, 3) AS m, CASE WHEN proof <> '' THEN proof WHEN n = 1 AND NOT against THEN 'only_door' END AS proof, CASE WHEN proof <> '' OR (n = 1 AND NOT against) THEN 'move' ELSE 'review' END AS verdict FROM r WHERE rn = 1 AND m > 150""",
)
def j10(t: Tables) -> DataFrame:
    return decisions.move_with_proof(rows(t, MOVED), rows(t, KNOWN)).withColumn("m", F.round("m", 3))


@query("j14_search_text", "WITH p AS (SELECT id, street, number, floor(lat / 0.005)::BIGINT AS cy, floor(lng / 0.005)::BIGINT AS cx, round(abs(lat - (floor(lat / 0.005) + 0.5) * 0.005) + abs(lng - (floor(lng / 0.005) + 0.5) * 0.005), 7) AS off FROM poi WHERE number <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY cy, cx ORDER BY off, id) AS rn FROM p) SELECT cy, cx, id, street || ', ' || number || ' - Canoas/RS' AS search FROM r WHERE rn = 1")
def j14(t: Tables) -> DataFrame:
    return decisions.search_points(t.poi, 0.005, "Canoas", "RS")


def pixels(t: Tables) -> DataFrame:
    """(id, tile, y, x): each point's pixel of about 20 m in tiles of 200 x 200."""
    y, x = F.floor((F.col("lat") + 30) * 5000).cast("int"), F.floor((F.col("lng") + 51.2) * 5000).cast("int")
    return t.poi.select("id", F.concat_ws("/", F.floor(y / 200).cast("int"), F.floor(x / 200).cast("int")).alias("tile"), (y % 200).alias("y"), (x % 200).alias("x"))


@query("h513_same_roof")
def h513(t: Tables) -> DataFrame:
    p = pixels(t)
    images = p.select("tile", "y", "x").distinct().groupBy("tile").agg(F.collect_list(F.struct("y", "x")).alias("on"))  # a tile has 40,000 pixels at most
    return decisions.same_roof(p, cluster.pixel_labels(images, 200, 200))


READINGS = "SELECT street AS key, CASE id % 2 WHEN 0 THEN 'name' ELSE 'phone' END AS field, CASE id % 2 WHEN 0 THEN name ELSE phone END AS value, (id % 10) / CAST(10 AS DOUBLE) AS score, CASE WHEN id % 6 = 0 THEN NULL ELSE id % 400 END AS age, CAST(id AS VARCHAR(20)) AS file FROM poi"


@query("h610_reconcile_fields", f"WITH r AS ({READINGS}), w AS (SELECT *, row_number() OVER (PARTITION BY key, field ORDER BY score DESC, age NULLS LAST, file) AS rn FROM r), g AS (SELECT key, field, count(DISTINCT CASE WHEN score >= 0.7 THEN value END) > 1 AS conflict, count(DISTINCT age) AS days FROM r GROUP BY key, field) SELECT key, field, value, conflict, conflict AND field = 'phone' AND days > 1 AS temporal FROM w JOIN g USING (key, field) WHERE rn = 1")
def h610(t: Tables) -> DataFrame:
    r = rows(t, READINGS).withColumn("day", F.date_sub(F.lit("2026-01-01").cast("date"), F.col("age").cast("int")))
    return decisions.reconciled(r, volatile=["phone"])


_IN = "(lat > -29.995 AND lat < -29.985 AND lng > -51.195 AND lng < -51.185)"


@query("b06_one_side_inside", f"WITH i AS (SELECT id FROM poi WHERE {_IN}) SELECT a.id AS a, b.id AS b FROM poi a JOIN poi b ON a.street = b.street AND a.number = b.number AND a.id < b.id WHERE a.id IN (SELECT id FROM i) OR b.id IN (SELECT id FROM i)")
def b06(t: Tables) -> DataFrame:
    pairs = joins.key_pairs(t.poi, ["street", "number"]).select("a", "b")
    return decisions.one_side_inside(pairs, t.poi, RINGS["centre"])


@query("b07_area_label", f"WITH p AS (SELECT id, CASE WHEN id % 6 = 0 THEN lat - 1 ELSE lat END AS lat, CASE WHEN id % 6 = 0 THEN lng + 1 ELSE lng END AS lng FROM poi) SELECT id, round(lat, 6) AS used_lat, NOT {_IN} AS outside FROM p")
def b07(t: Tables) -> DataFrame:
    m = F.col("id") % 6 == 0
    r = t.poi.select("id", F.when(m, F.col("lat") - 1).alias("map_lat"), F.when(m, F.col("lng") + 1).alias("map_lng"), F.col("lat").alias("source_lat"), F.col("lng").alias("source_lng"))
    return decisions.area_label(r, RINGS["centre"]).select("id", F.round("used_lat", 6).alias("used_lat"), "outside")


@query("l14_coherence", "WITH l AS (SELECT id, phone AS document, CAST(city AS VARCHAR(10)) AS city, CASE WHEN id % 9 = 0 THEN 'SC' ELSE 'RS' END AS state FROM poi), r AS (SELECT phone AS document, CAST(min(city) AS VARCHAR(10)) AS city, 'RS' AS state FROM poi GROUP BY phone) SELECT id, CASE WHEN l.state <> r.state THEN 'state' ELSE 'city' END AS reason FROM l JOIN r USING (document) WHERE l.state <> r.state OR l.city <> r.city")
def l14(t: Tables) -> DataFrame:
    links = t.poi.select("id", F.col("phone").alias("document"), F.col("city").cast("string").alias("city"), F.when(F.col("id") % 9 == 0, "SC").otherwise("RS").alias("state"))
    return decisions.incoherent(links, t.poi.groupBy(F.col("phone").alias("document")).agg(F.min("city").cast("string").alias("city")).withColumn("state", F.lit("RS")))


@query("l15_coordinate_audit", f"WITH p AS (SELECT a.id, a.street, b.street AS found, row_number() OVER (PARTITION BY a.id ORDER BY {METRES}, b.id) AS rn FROM poi a JOIN door b ON abs(a.lat - b.lat) < 0.0006 AND abs(a.lng - b.lng) < 0.0007 WHERE {METRES} <= 50) SELECT id, found, {core('p.street')} = {core('p.found')} AS agrees FROM p WHERE rn = 1")
def l15(t: Tables) -> DataFrame:
    return decisions.coordinate_audit(t.poi, t.door)


@query("l16_reload_links", "WITH t AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), s AS (SELECT o_custkey AS k, 0 AS r, 'order' AS kind FROM orders UNION ALL SELECT c_custkey, 1, 'customer' FROM customer) SELECT k, min_by(kind, r) AS kind FROM s WHERE k NOT IN (SELECT k FROM t) GROUP BY k")
def l16(t: Tables) -> DataFrame:
    kind = lambda d, c, name: d.select(F.col(c).alias("k"), F.lit(name).alias("kind"))
    target = kind(t.orders.filter("o_orderstatus = 'F'"), "o_custkey", "order").distinct()
    return decisions.reloaded(target, [kind(t.orders, "o_custkey", "order"), kind(t.customer, "c_custkey", "customer")], ["k"])


# ---- street names ------------------------------------------------------------------------------
def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def _picked(options, index: str) -> str:
    return f"split_part('{','.join(options)}', ',', CAST(({index}) % {len(options)} + 1 AS INT))"


_NUM = {w: str(n) for w, n in text.NUMERALS.items() if n <= 20}
#: Every type with every title, and a numeral behind them.
NAMED = f"SELECT id, concat({_picked(text.ALL_TYPES, 'id')}, CASE WHEN id % 3 = 0 THEN '. ' ELSE ' ' END, {_picked(text.TITLES, f'CAST(FLOOR(id / {len(text.ALL_TYPES)}) AS BIGINT)')}, ' ', {_picked(_NUM, 'id * 3')}, ' de ', {_picked(('maio', 'Souza', 'setembro'), 'id')}) AS name, CASE WHEN id % 5 = 0 THEN 'Av.' ELSE '' END AS hint FROM poi"
_SPLIT = "list_filter(string_split_regex(regexp_replace(lower(name), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda t: t <> '')"


@query(
    "h107_canonical_street",
    f"""WITH n AS (SELECT id, hint, {_SPLIT} AS w FROM ({NAMED}) q), k AS (SELECT *, {_map(text.ALL_TYPES)}[w[1]] AS first, CASE WHEN hint = 'Av.' THEN 'avenida' ELSE {_map(text.ALL_TYPES)}[w[1]] END AS kind FROM n),
b AS (SELECT id, kind, list_transform(CASE WHEN first = kind THEN w[2:] ELSE w END, lambda t: coalesce({_map(text.TITLES | _NUM)}[t], t)) AS r FROM k)
SELECT id, kind, array_to_string(r, ' ') AS base, kind || ' ' || array_to_string(r, ' ') AS whole, array_to_string(list_filter(r, lambda t: NOT list_contains({list(text.NUCLEUS_STOP)}, t)), ' ') AS nucleus, 'valid' AS status FROM b""",
)
def h107b(t: Tables) -> DataFrame:
    return rows(t, NAMED).select("id", text.canonical_street(F.col("name"), F.col("hint")).alias("s")).select("id", "s.*")


@query(
    "h109_contextual_street",
    f"""WITH n AS (SELECT id, {_SPLIT} AS w FROM ({NAMED}) q), k AS (SELECT id, {_map(text.ALL_TYPES)}[w[1]] AS kind, coalesce({_map(text.TITLES)}[w[2]], w[2]) AS title, CASE WHEN w[5] IN ('maio', 'setembro') THEN {_map(_NUM)}[w[3]] ELSE w[3] END AS n, w[5] AS last FROM n)
SELECT id, concat_ws(' ', kind, title, n, 'de', last) AS text, 'high' AS tier FROM k""",
)
def h109b(t: Tables) -> DataFrame:
    return rows(t, NAMED).select("id", text.contextual_street(F.col("name")).alias("s")).select("id", "s.*")


# ---- identifiers -------------------------------------------------------------------------------
@query("h306_entity_key", "SELECT id, CASE WHEN site <> 'nan' THEN 'site:' || site WHEN id % 4 = 0 AND id % 3 > 0 THEN 'place:' || place ELSE 'row:' || id END AS entity FROM poi")
def h306(t: Tables) -> DataFrame:
    i = F.col("id")
    k = identifiers.entity_key(("site", F.when(F.col("site") != "nan", F.col("site"))), ("place", F.when(i % 3 > 0, F.concat(F.lit(" "), "place"))), ("row", i.cast("string")))
    return t.poi.select("id", k.alias("entity"))


@query("h312_masked", "SELECT c_custkey, left(c_name, 3) || '***' AS name FROM customer")
def h312(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", identifiers.masked(F.col("c_name")).alias("name"))
