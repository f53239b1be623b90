"""Text, similarity, identifiers, values, geometry, nested data (H1 to H6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geomill.functions import geo, identifiers, nested, similarity, text, values

from geomill.operators import joins, names

from .inputs import Tables, with_ctes
from .joins import METRES, PLAIN, WORDS, core
from .registry import both, query

ADDRESS = "concat(street, CASE WHEN number <> '' THEN concat(', ', number) ELSE '' END, ' - Centro, Canoas - RS, ', postcode)"


@query("h101_strip_accents", f"SELECT doc_id, md5(translate(lower(text), '{text.MARKED}', '{text.PLAIN}')) AS plain FROM documents")
def h101(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.strip_accents(F.col("text"))).alias("plain"))


@query("h102_norm_name", f"SELECT id, {PLAIN.format('name')} AS plain FROM poi")
def h102(t: Tables) -> DataFrame:
    return t.poi.select("id", text.norm_name(F.col("name")).alias("plain"))


@query("h103_void_text", "SELECT id, nullif(site, 'nan') AS site FROM poi")
def h103(t: Tables) -> DataFrame:
    return t.poi.select("id", text.void_to_null(F.col("site")).alias("site"))


@query("h104_phone_key", "SELECT id, regexp_replace(phone, '[^0-9]', '', 'g') AS phone FROM poi")
def h104(t: Tables) -> DataFrame:
    return t.poi.select("id", text.phone_key(F.concat(F.lit("+55 "), F.col("phone"), F.lit(""))).alias("p")).select("id", F.when(F.length("p") > 10, F.substring("p", 3, 20)).otherwise(F.col("p")).alias("phone"))


@query("h105_domain", "SELECT page_id, regexp_replace(split_part(split_part(regexp_replace(lower(url), '^\\w+://', ''), '/', 1), '?', 1), '^www\\.', '') AS host FROM pages")
def h105(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.domain(F.col("url")).alias("host"))


@query("h106_street_core", f"SELECT id, {core('street')} AS core FROM poi")
def h106(t: Tables) -> DataFrame:
    return t.poi.select("id", text.street_core(F.col("street")).alias("core"))


@query("h107_street_words", f"SELECT id, array_to_string(list_transform({WORDS.format('street')}, lambda w: coalesce(MAP {{'r':'rua','av':'avenida','rod':'rodovia','onze':'11','sete':'7','quinze':'15','um':'1'}}[w], w)), ' ') AS clean FROM poi")
def h107(t: Tables) -> DataFrame:
    table = {"r": "rua", "av": "avenida", "rod": "rodovia", "onze": "11", "sete": "7", "quinze": "15", "um": "1"}
    return t.poi.select("id", text.replace_words(F.col("street"), table).alias("clean"))


def words_table(t: Tables, rows: list[tuple]) -> DataFrame:
    return t.spark.createDataFrame(rows, "id int, w string")


@query("h110_numerals", "SELECT * FROM (VALUES (1, 25), (2, 115), (3, NULL), (4, 7), (5, 1920), (6, NULL)) AS v(id, n)")
def h110(t: Tables) -> DataFrame:
    rows = [(1, "vinte e cinco"), (2, "Cento e Quinze"), (3, "sessenta sessenta"), (4, "sete"), (5, "mil novecentos e vinte"), (6, "padaria")]
    return words_table(t, rows).select("id", text.numeral(F.col("w")).alias("n"))


@query("h112_roman", "SELECT * FROM (VALUES (1, 15), (2, 4), (3, NULL), (4, 1999), (5, NULL)) AS v(id, n)")
def h112(t: Tables) -> DataFrame:
    return words_table(t, [(1, "XV"), (2, "iv"), (3, "IIII"), (4, "MCMXCIX"), (5, "Padaria")]).select("id", text.roman(F.col("w")).alias("n"))


@query("h113_phonetic", "SELECT * FROM (VALUES (1, 'airton sena'), (2, 'airton sena'), (3, 'xaves 12'), (4, 'filipe jeneral')) AS v(id, k)")
def h113(t: Tables) -> DataFrame:
    return words_table(t, [(1, "Ayrton Senna"), (2, "AIRTON SENA"), (3, "Chaves 12"), (4, "Phillipe General")]).select("id", text.phonetic(F.col("w")).alias("k"))


@query("h114_equivalence_key", "SELECT * FROM (VALUES (1, '15 di novenbro'), (2, 'aseso s'), (3, 'aseso z')) AS v(id, k)".replace("novenbro", "novembro").replace("15 di", "15 de"))
def h114(t: Tables) -> DataFrame:
    return words_table(t, [(1, "XV de Novembro"), (2, "Acesso S"), (3, "Acesso Z")]).select("id", text.equivalence_key(F.col("w")).alias("k"))


@query("h115_parse_address", "SELECT id, street, nullif(number, '') AS number, 'Centro' AS area, 'Canoas' AS city, 'RS' AS state, postcode FROM poi")
def h115(t: Tables) -> DataFrame:
    a = F.concat(F.col("street"), F.when(F.col("number") != "", F.concat(F.lit(", "), F.col("number"))).otherwise(""), F.lit(" - Centro, Canoas - RS, "), F.col("postcode"))
    return t.poi.select("id", text.parse_address(a).alias("p")).select("id", "p.*")


@query("h118_compose_address", f"SELECT id, {ADDRESS} AS address FROM poi")
def h118(t: Tables) -> DataFrame:
    return t.poi.select("id", text.compose_address(F.col("street"), F.col("number"), F.lit("Centro"), F.lit("Canoas"), F.lit("RS"), F.col("postcode")).alias("address"))


@query("h120_clean_number", "SELECT id, nullif(number, '') AS number FROM poi")
def h120(t: Tables) -> DataFrame:
    return t.poi.select("id", text.clean_number(F.concat(F.lit("n. 00"), F.nullif(F.col("number"), F.lit("")), F.lit("/12"))).alias("number"))


@query("h121_number_agrees", "SELECT * FROM (VALUES (1, 'equal'), (2, 'different'), (3, 'no_number'), (4, 'equal'), (5, 'no_number'), (6, 'different')) AS v(id, verdict)")
def h121(t: Tables) -> DataFrame:
    rows = [(1, "120-126", "124"), (2, "12", "13"), (3, "S/N", "12"), (4, "0015", "15"), (5, "12345678", "3"), (6, "10-90", "55")]
    return t.spark.createDataFrame(rows, "id int, a string, b string").select("id", text.number_agrees(F.col("a"), F.col("b")).alias("verdict"))


# a unit has five digits at most, as in text.units
@query("h124_units", "SELECT id, CASE WHEN id < 100000 THEN ['ap 3', 'casa ' || id] ELSE ['ap 3'] END AS units FROM poi")
def h124(t: Tables) -> DataFrame:
    return t.poi.select("id", text.units(F.concat(F.lit("RUA X, 5 - CS. 0"), F.col("id").cast("string"), F.lit(" Apto 003"))).alias("units"))


@query("h125_unit_conflict", "SELECT id, id % 2 = 1 AS conflict FROM poi")
def h125(t: Tables) -> DataFrame:
    a, b = text.units(F.concat(F.lit("casa "), (F.col("id") % 2 + 1).cast("string"))), text.units(F.lit("CASA 1"))
    return t.poi.select("id", ((F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) == 0)).alias("conflict"))


@query("h128_same_area", "SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, false)) AS v(id, same)")
def h128(t: Tables) -> DataFrame:
    rows = [(1, "NOSSA SENHORA DAS GRACAS", "N S das Graças"), (2, "SAO JOSE", "SAO LUIS"), (3, "Centro", "centro"), (4, None, "Centro")]
    return t.spark.createDataFrame(rows, "id int, a string, b string").select("id", text.same_area(F.col("a"), F.col("b")).alias("same"))


@query("h129_postcodes", f"SELECT id, [replace(postcode, '-', '')] AS codes FROM poi WHERE {ADDRESS} IS NOT NULL")
def h129(t: Tables) -> DataFrame:
    a = text.compose_address(F.col("street"), F.col("number"), F.lit("Centro"), F.lit("Canoas"), F.lit("RS"), F.col("postcode"))
    return t.poi.select("id", text.postcodes(a).alias("codes"))


@query("h132_pad_title", "SELECT id, lpad(id::VARCHAR, 6, '0') AS code, upper(substring(street, 1, 1)) || lower(substring(street, 2)) AS title FROM poi")
def h132(t: Tables) -> DataFrame:
    return t.poi.select("id", F.lpad(F.col("id").cast("string"), 6, "0").alias("code"), F.concat(F.upper(F.substring("street", 1, 1)), F.lower(F.substring("street", 2, 200))).alias("title"))


@query("h133_formula_safe", "SELECT id, CASE WHEN id % 3 = 0 THEN '''=' || name WHEN id % 3 = 1 THEN '''@' || name ELSE name END AS cell FROM poi")
def h133(t: Tables) -> DataFrame:
    c = F.concat(F.element_at(F.array(F.lit("="), F.lit("@"), F.lit("")), (F.col("id") % 3 + 1).cast("int")), F.col("name"))
    return t.poi.select("id", text.formula_safe(c).alias("cell"))


@query("h134_html_text", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script[^>]*>.*?</script|style[^>]*>.*?</style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS plain FROM pages")
def h134(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(text.html_text(F.col("html"))).alias("plain"))


@query("h134_emails", r"SELECT page_id, regexp_extract_all(html, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS emails FROM pages")
def h134b(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.emails(F.col("html")).alias("emails"))


_TOK = f"list_distinct(list_filter({WORDS}, lambda x: length(x) > 2))"
_PAIRS = "poi a JOIN poi b ON a.street = b.street AND a.id < b.id"


def name_pairs(t: Tables) -> DataFrame:
    """Pairs of one street."""
    return joins.key_pairs(t.poi, ["street"], columns=["name"]).withColumnsRenamed({"a_name": "na", "b_name": "nb"})


def weighted_pairs(t: Tables) -> DataFrame:
    rows = similarity.with_weights(t.poi.select("id", "name", "street"), similarity.idf(t.poi, "name"), "name")
    return joins.key_pairs(rows, ["street"], columns=["weighted"])


@query("h201_jaccard", f"WITH p AS (SELECT a.id AS a, b.id AS b, {_TOK.format('a.name')} AS x, {_TOK.format('b.name')} AS y, a.name AS na, b.name AS nb FROM {_PAIRS}) SELECT a, b, CASE WHEN least(len(x), len(y)) < 2 THEN (lower(na) = lower(nb))::INT::DOUBLE ELSE round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) END AS s FROM p")
def h201(t: Tables) -> DataFrame:
    return name_pairs(t).select("a", "b", F.round(similarity.jaccard(F.col("na"), F.col("nb")), 6).alias("s"))


@query("h202_overlap", f"WITH p AS (SELECT a.id AS a, b.id AS b, list_distinct({WORDS.format('a.name')}) AS x, list_distinct({WORDS.format('b.name')}) AS y FROM {_PAIRS}) SELECT a, b, CASE WHEN len(list_intersect(x, y)) >= 2 THEN round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) ELSE 0 END AS s FROM p")
def h202(t: Tables) -> DataFrame:
    w = lambda c: F.array_distinct(text.words(F.col(c)))
    return name_pairs(t).select("a", "b", F.round(similarity.overlap(w("na"), w("nb")), 6).alias("s"))


@query("h203_idf_overlap", f"WITH w AS (SELECT unnest(list_distinct(list_filter({WORDS.format('name')}, lambda x: length(x) > 1))) AS token FROM poi), i AS (SELECT token, ln((SELECT count(*) FROM poi)::DOUBLE / (1 + count(*))) AS weight FROM w GROUP BY token), p AS (SELECT a.id AS a, b.id AS b, unnest(list_intersect(list_distinct(list_filter({WORDS.format('a.name')}, lambda x: length(x) > 1)), list_distinct(list_filter({WORDS.format('b.name')}, lambda x: length(x) > 1)))) AS token FROM {_PAIRS}) SELECT a, b, round(sum(weight ORDER BY weight), 5) AS shared_weight FROM p JOIN i USING (token) GROUP BY a, b HAVING sum(weight) > 0")
def h203(t: Tables) -> DataFrame:
    p = weighted_pairs(t).withColumn("shared_weight", similarity.shared_weight(F.col("a_weighted"), F.col("b_weighted"))).filter("shared_weight > 0")
    return p.select("a", "b", F.round("shared_weight", 5).alias("shared_weight"))


#: Names of even ids are shortened: two words become their initials.
SHORTENED = "SELECT id, street, CASE WHEN id % 2 = 0 THEN replace(replace(replace(name, 'Nova Era', 'NE'), 'Bom Dia', 'BD'), 'do Porto', 'DP') ELSE name END AS name FROM poi"


def _spelt(short: str, long: str, known: str) -> str:
    runs = f"list_transform(range(1, len({long}) - length(s) + 2), lambda i: {long}[i:i + length(s) - 1])"
    first = f"list_filter({runs}, lambda r: array_to_string(list_transform(r, lambda u: u[1]), '') = s)[1]"
    return f"list_distinct(flatten(list_transform(list_filter(list_distinct({short}), lambda s: length(s) BETWEEN 2 AND 4 AND NOT list_contains({known}, s)), lambda s: coalesce({first}, []))))"


@query(
    "h203_acronyms",
    f"""WITH n AS ({SHORTENED}), t AS (SELECT id, street, list_filter({WORDS.format('name')}, lambda x: length(x) > 1) AS w FROM n),
k AS (SELECT token, ln((SELECT count(*) FROM t)::DOUBLE / (1 + count(*))) AS weight FROM (SELECT unnest(list_distinct(w)) AS token FROM t) GROUP BY token),
p AS (SELECT a.id AS a, b.id AS b, a.w AS x, b.w AS y, list_intersect(list_distinct(a.w), list_distinct(b.w)) AS c FROM t a JOIN t b ON a.street = b.street AND a.id < b.id),
q AS (SELECT *, list_filter({_spelt('x', 'y', 'c')}, lambda u: NOT list_contains(c, u)) AS one FROM p WHERE len(c) > 0),
r AS (SELECT a, b, c, list_distinct(list_concat(one, list_filter({_spelt('y', 'x', 'list_concat(c, one)')}, lambda u: NOT list_contains(c, u)))) AS spelt FROM q),
u AS (SELECT a, b, unnest(list_concat(c, spelt)) AS token FROM r), s AS (SELECT a, b, sum(weight) AS weight FROM u JOIN k USING (token) GROUP BY a, b)
SELECT a, b, round(weight, 5) AS weight, array_to_string(list_sort(spelt), ' ') AS spelt FROM r JOIN s USING (a, b)""",
)
def h203b(t: Tables) -> DataFrame:
    rows = t.sql(with_ctes(SHORTENED))
    words = rows.select("id", "street", F.filter(text.words(F.col("name")), lambda w: F.length(w) > 1).alias("words"))
    out = names.weighted_overlap(words, similarity.idf(rows, "name"), ["street"])
    return out.select("a", "b", F.round("weight", 5).alias("weight"), F.array_join("spelt", " ").alias("spelt"))


_IDF = f"w AS (SELECT id, unnest(list_distinct(list_filter({WORDS.format('name')}, lambda x: length(x) > 1))) AS token FROM poi), i AS (SELECT token, ln((SELECT count(*) FROM poi)::DOUBLE / (1 + count(*))) AS weight FROM w GROUP BY token)"


@query("h204_top_shared", f"WITH {_IDF}, top AS (SELECT id, max(struct_pack(weight := weight, token := token)).token AS token FROM w JOIN i USING (token) GROUP BY id) SELECT a.id AS a, b.id AS b FROM {_PAIRS} JOIN top x ON x.id = a.id JOIN top y ON y.id = b.id WHERE EXISTS (SELECT 1 FROM w WHERE w.id = b.id AND w.token = x.token) OR EXISTS (SELECT 1 FROM w WHERE w.id = a.id AND w.token = y.token)")
def h204(t: Tables) -> DataFrame:
    return weighted_pairs(t).filter(similarity.top_shared(F.col("a_weighted"), F.col("b_weighted"))).select("a", "b")


@query("h205_token_sort")
def h205(t: Tables) -> DataFrame:
    return name_pairs(t).select("a", "b", F.round(similarity.token_sort(F.col("na"), F.col("nb")), 4).alias("ratio"))


@query("h206_token_set")
def h206(t: Tables) -> DataFrame:
    r = similarity.token_set(F.col("na"), F.col("nb"))
    return name_pairs(t).withColumn("ratio", F.round(r, 4)).select("a", "b", "ratio", F.when(F.col("ratio") >= 82, "CONFIRMED").when(F.col("ratio") >= 65, "LIKELY").otherwise("NO").alias("verdict"))


@query("h207_best_of_three")
def h207(t: Tables) -> DataFrame:
    w = lambda c: text.tokens(F.col(c))
    s = F.greatest(similarity.indel_ratio(F.lower("na"), F.lower("nb")) / 100, similarity.jaccard(F.col("na"), F.col("nb")), F.coalesce(similarity.containment(w("na"), w("nb")), F.lit(0.0)) * 0.95)
    return name_pairs(t).select("a", "b", F.round(s, 6).alias("s"))


@query("h208_distance_threshold", "SELECT a.id AS a, b.id AS b FROM poi a JOIN poi b ON a.street = b.street AND a.id < b.id WHERE CASE WHEN " + METRES + " < 100 THEN split_part(lower(a.name), ' ', 1) = split_part(lower(b.name), ' ', 1) ELSE lower(a.name) = lower(b.name) END")
def h208(t: Tables) -> DataFrame:
    p = t.poi.select("id", "name", "street", "lat", "lng")
    a, b = p.alias("a"), p.alias("b")
    m = geo.metres(F.col("a.lat"), F.col("a.lng"), F.col("b.lat"), F.col("b.lng"))
    first = lambda s: F.split_part(F.lower(f"{s}.name"), F.lit(" "), F.lit(1))
    same = F.when(m < 100, first("a") == first("b")).otherwise(F.lower("a.name") == F.lower("b.name"))
    return a.join(b, (F.col("a.street") == F.col("b.street")) & (F.col("a.id") < F.col("b.id"))).filter(same).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query("h210_edit_distance", "SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name)::INT AS d FROM (SELECT DISTINCT p_name FROM part) a JOIN (SELECT DISTINCT p_name FROM part) b ON split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2) AND a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) <= 4")
def h210(t: Tables) -> DataFrame:
    p = t.part.select("p_name").distinct().withColumn("k", F.split_part("p_name", F.lit(" "), F.lit(2)))
    j = p.select(F.col("p_name").alias("a"), "k").join(p.select(F.col("p_name").alias("b"), "k"), "k").filter("a < b")
    return j.select("a", "b", F.levenshtein("a", "b", 4).alias("d")).filter("d >= 0")


@query("h211_plausible", "SELECT * FROM (VALUES (1, true), (2, false), (3, true), (4, false), (5, true)) AS v(id, ok)")
def h211(t: Tables) -> DataFrame:
    rows = [(1, "airton", "ayrton"), (2, "a", "b"), (3, "jose", "josé"), (4, "21", "25"), (5, "gen", "general")]
    return t.spark.createDataFrame(rows, "id int, a string, b string").select("id", similarity.plausible(text.strip_accents(F.col("a")), text.strip_accents(F.col("b"))).alias("ok"))


@query("h213_same_numbers", "SELECT a.id AS a, b.id AS b FROM poi a JOIN poi b ON a.id < b.id AND a.street <> b.street AND a.postcode = b.postcode WHERE regexp_extract(a.number, '[0-9]*') = regexp_extract(b.number, '[0-9]*')")
def h213(t: Tables) -> DataFrame:
    p = t.poi.select("id", "street", "number", "postcode")
    a, b = p.alias("a"), p.alias("b")
    return a.join(b, (F.col("a.postcode") == F.col("b.postcode")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.street") != F.col("b.street"))).filter(similarity.same_numbers(F.col("a.number"), F.col("b.number"))).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


# ---- identifiers -------------------------------------------------------------------------------
_W1, _W2 = "[5,4,3,2,9,8,7,6,5,4,3,2]", "[6,5,4,3,2,9,8,7,6,5,4,3,2]"
_DV = "(CASE WHEN list_sum(list_transform(range(1, {n}), lambda i: substring({r}, i::INT, 1)::INT * {w}[i])) % 11 < 2 THEN 0 ELSE 11 - list_sum(list_transform(range(1, {n}), lambda i: substring({r}, i::INT, 1)::INT * {w}[i])) % 11 END)::INT::VARCHAR"


@query("h301_company_number", f"WITH r AS (SELECT id, lpad((id * 7919 + 104729)::VARCHAR, 12, '0') AS r FROM poi), a AS (SELECT id, r || {_DV.format(n=13, r='r', w=_W1)} AS r FROM r), b AS (SELECT id, r || {_DV.format(n=14, r='r', w=_W2)} AS number FROM a) SELECT id, number, true AS good, false AS wrong FROM b")
def h301(t: Tables) -> DataFrame:
    n = identifiers.company_number((F.col("id") * 7919 + 104729).cast("string"))
    bad = F.concat(F.substring("number", 1, 13), ((F.substring("number", 14, 1).cast("int") + 1) % 10).cast("string"))
    return t.poi.select("id", n.alias("number")).select("id", "number", identifiers.valid_company(F.col("number")).alias("good"), identifiers.valid_company(bad).alias("wrong"))


@query("h302_person_number", "SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, true)) AS v(id, ok)")
def h302(t: Tables) -> DataFrame:
    return words_table(t, [(1, "529.982.247-25"), (2, "529.982.247-26"), (3, "111.111.111-11"), (4, "11144477735")]).select("id", identifiers.valid_person(F.col("w")).alias("ok"))


# a code has seven digits at most; longer texts are none, as in identifiers.activity_code
@query("h303_activity_code", "SELECT id, CASE WHEN id * 37 < 10000000 THEN lpad((id * 37)::VARCHAR, 7, '0') END AS code, CASE WHEN id * 37 < 10000000 THEN substring(lpad((id * 37)::VARCHAR, 7, '0'), 1, 2) END AS division FROM poi")
def h303(t: Tables) -> DataFrame:
    return t.poi.select("id", identifiers.activity_code((F.col("id") * 37).cast("string")).alias("c")).select("id", "c.code", "c.division")


@query("h304_status_alias", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'PENDING' WHEN 'F' THEN 'FILLED' ELSE o_orderstatus END AS status FROM orders")
def h304(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", identifiers.canonical(F.col("o_orderstatus"), {"p": "PENDING", "f": "FILLED"}).alias("status"))


@query("h305_stable_id")
def h305(t: Tables) -> DataFrame:
    return t.poi.select("id", identifiers.stable_id(F.concat_ws("|", "name", "street", "number")).alias("key"))


@query("h307_fingerprint", "SELECT o_orderkey, sha256(coalesce(o_orderstatus, chr(0)) || chr(31) || coalesce(o_orderpriority, chr(0)) || chr(31) || o_custkey) AS print FROM orders")
def h307(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", identifiers.fingerprint("o_orderstatus", "o_orderpriority", "o_custkey").alias("print"))


@query("h309_semantic_hash")
def h309(t: Tables) -> DataFrame:
    return t.nation.agg(identifiers.semantic_hash(t.nation, ["n_nationkey", "n_name"]).alias("hash"))


both("h310_id_audit", "SELECT count(*) AS n, count(DISTINCT md5(concat(name, '|', street, '|', number, '|', CAST(id AS VARCHAR(20))))) AS kinds FROM poi")
both("h311_place_kind", "SELECT id, place <> '' AND place NOT LIKE '%:%' AS own FROM poi")

# ---- values ------------------------------------------------------------------------------------


@query("h401_money", "SELECT * FROM (VALUES (1, 1234.56), (2, 1234.56), (3, 1234.00), (4, 12.50), (5, 1234567.00), (6, NULL), (7, 0.50)) AS v(id, amount)")
def h401(t: Tables) -> DataFrame:
    rows = [(1, "R$ 1.234,56"), (2, "1,234.56"), (3, "1.234"), (4, "12,5"), (5, "1.234.567"), (6, "x"), (7, "0.50")]
    return words_table(t, rows).select("id", values.money(F.col("w")).cast("decimal(9,2)").alias("amount"))


@query("h402_dates", "SELECT o_orderkey, o_orderdate::DATE AS d1, o_orderdate::DATE AS d2, o_orderdate::DATE AS d3, o_orderdate::DATE AS d4 FROM orders")
def h402(t: Tables) -> DataFrame:
    d = F.to_date("o_orderdate")
    show = [F.date_format(d, "dd/MM/yyyy"), F.date_format(d, "yyyyMMdd"), F.date_format(d, "yyyy-MM-dd"), F.datediff(d, F.lit("1899-12-30").cast("date")).cast("string")]
    return t.orders.select("o_orderkey", *[values.date_of(c).alias(f"d{i}") for i, c in enumerate(show, 1)])


@query("h403_lenient_number", "SELECT id, evidence + 0.5 AS x, NULL::DOUBLE AS junk FROM poi")
def h403(t: Tables) -> DataFrame:
    return t.poi.select("id", values.lenient(F.concat(F.col("evidence").cast("string"), F.lit(",5"))).alias("x"), values.lenient(F.lit("a1")).alias("junk")).withColumn("x", F.col("x").cast("decimal(11,1)"))


both("h404_whole_months", "SELECT o_orderkey, (year(TIMESTAMP '2000-01-15 00:00:00') - year(o_orderdate)) * 12 + month(TIMESTAMP '2000-01-15 00:00:00') - month(o_orderdate) AS months FROM orders")


@query("h405_age_days", "SELECT * FROM (VALUES (1, 150), (2, 365), (3, 0), (4, 14), (5, NULL)) AS v(id, days)")
def h405(t: Tables) -> DataFrame:
    return words_table(t, [(1, "5 meses atras"), (2, "um ano atrás"), (3, "hoje"), (4, "2 semanas atrás"), (5, "faz tempo")]).select("id", values.age_days(F.col("w")).alias("days"))


@query("h406_month_of", "SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS m FROM orders")
def h406(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", values.month_of(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("m"))


@query("h407_recency", "SELECT id, CASE WHEN id % 40 >= 24 THEN 0 ELSE round(1.0 - (id % 40) / 24.0, 3) END::DOUBLE AS r FROM poi")
def h407(t: Tables) -> DataFrame:
    return t.poi.select("id", values.recency(F.col("id") % 40, 24).alias("r"))


@query("h408_local_period", "SELECT event_id, date_trunc('day', ts - INTERVAL 3 HOUR) + INTERVAL 3 HOUR AS start FROM events")
def h408(t: Tables) -> DataFrame:
    return t.events.select("event_id", values.local_period(F.col("ts"), "America/Sao_Paulo").alias("start"))


@query("h409_years_active", "SELECT o_orderkey, greatest(round(date_diff('day', o_orderdate::DATE, DATE '2000-06-30') / 365.25, 2), 0) AS years FROM orders")
def h409(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", values.years_active(F.to_date("o_orderdate"), F.lit("2000-06-30").cast("date")).alias("years"))


both("h411_intervals", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL '10' DAY")

# ---- geometry ----------------------------------------------------------------------------------
_HAV = "2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))"
_ONE = "poi a JOIN poi b ON b.id = a.id + 1"


def neighbours(t: Tables) -> DataFrame:
    p = t.poi.select("id", "lat", "lng")
    return p.join(p.select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2")), "id")


_C = ("lat", "lng", "lat2", "lng2")


@query("h501_haversine", f"SELECT a.id, round({_HAV}, 3) AS m FROM {_ONE}")
def h501(t: Tables) -> DataFrame:
    return neighbours(t).select("id", F.round(geo.haversine(*map(F.col, _C)), 3).alias("m"))


@query("h502_metres", f"SELECT a.id, round({METRES}, 3) AS m FROM {_ONE}")
def h502(t: Tables) -> DataFrame:
    return neighbours(t).select("id", F.round(geo.metres(*map(F.col, _C)), 3).alias("m"))


@query("h503_bearing", f"SELECT a.id, round((degrees(atan2(sin(radians(b.lng - a.lng)) * cos(radians(b.lat)), cos(radians(a.lat)) * sin(radians(b.lat)) - sin(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(b.lng - a.lng)))) + 360) % 360, 6) AS heading FROM {_ONE}")
def h503(t: Tables) -> DataFrame:
    return neighbours(t).select("id", F.round(geo.bearing(*map(F.col, _C)), 6).alias("heading"))


@query("h504_view", "SELECT id, least((id * 37) % 360, 360 - (id * 37) % 360)::DOUBLE AS turn, CASE WHEN least((id * 37) % 360, 360 - (id * 37) % 360) <= 45 THEN round(320 + (((id * 37) % 360 + 180) % 360 - 180) / 90.0 * 640, 4) END::DOUBLE AS x FROM poi")
def h504(t: Tables) -> DataFrame:
    h = ((F.col("id") * 37) % 360).cast("double")
    return t.poi.select("id", geo.turn(h, F.lit(0.0)).alias("turn"), F.round(geo.view_x(F.lit(0.0), h, 90.0, 640), 4).alias("x"))


@query("h505_mercator", "SELECT id, round(degrees(atan((exp(y) - exp(-y)) / 2)), 6) AS lat, round(id * 100.0 / (256 * pow(2.0, 10)) * 360 - 180, 6) AS lng FROM (SELECT id, pi() - 2 * pi() * (id * 100.0::DOUBLE) / (256 * pow(2.0, 10)) AS y FROM poi) q")
def h505(t: Tables) -> DataFrame:
    p = F.col("id") * 100.0
    return t.poi.select("id", F.round(geo.mercator_lat(p, 10), 6).alias("lat"), F.round(geo.mercator_lng(p, 10), 6).alias("lng"))


@query("h506_utm_zone", "SELECT id, (floor((lng + (id % 60) + 180) / 6) + 1)::INT AS zone FROM poi")
def h506(t: Tables) -> DataFrame:
    return t.poi.select("id", geo.utm_zone(F.col("lng") + F.col("id") % 60).alias("zone"))


@query("h508_geo_sanity", "WITH m AS (SELECT source, median(lat) AS y FROM poi GROUP BY source) SELECT id, abs(lat + CASE WHEN id % 97 = 0 THEN 9 ELSE 0 END - y) * 111320 > 300000 AS far FROM poi JOIN m USING (source)")
def h508(t: Tables) -> DataFrame:
    m = t.poi.groupBy("source").agg(F.median("lat").alias("y"))
    return t.poi.join(m, "source").select("id", (F.abs(F.col("lat") + F.when(F.col("id") % 97 == 0, 9).otherwise(0) - F.col("y")) * 111320 > 300000).alias("far"))


@query("h515_cells", "SELECT id, trunc(lat / 0.001::DOUBLE)::BIGINT AS cut, floor(lat / 0.001::DOUBLE)::BIGINT AS low FROM poi")
def h515(t: Tables) -> DataFrame:
    return t.poi.select("id", geo.cell(F.col("lat"), 0.001).alias("cut"), geo.floor_cell(F.col("lat"), 0.001).alias("low"))


# ---- nested ------------------------------------------------------------------------------------
@query("h601_json_path", "SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def h601(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("h602_json_each", "SELECT event_id, 'k' AS key, props->>'$.k' AS value FROM events")
def h602(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.explode(nested.json_pairs(F.col("props"))).alias("e")).select("event_id", "e.key", "e.value")


@query("h603_json_build", "SELECT event_id, '{\"k\":\"' || (props->>'$.k') || '\",\"t\":\"' || event_type || '\"}' AS doc FROM events")
def h603(t: Tables) -> DataFrame:
    return t.events.select("event_id", nested.json_merge(F.col("props"), F.to_json(F.struct(F.col("event_type").alias("t")))).alias("doc"))


@query("h604_json_length", "SELECT event_id, 2 + (event_id % 2)::INT AS n FROM events")
def h604(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.json_array_length(F.when(F.col("event_id") % 2 == 0, "[1,2]").otherwise("[1,2,3]")).alias("n"))


@query("h605_opening_hours", "SELECT event_id, 'mon' AS day, '8-18' AS hours FROM events")
def h605(t: Tables) -> DataFrame:
    j = F.when(F.col("event_id") % 2 == 0, '{"mon":"8-18"}').otherwise('[{"day":"mon","hours":"8-18"}]')
    return t.events.select("event_id", F.explode(nested.opening_hours(j)).alias("h")).select("event_id", "h.day", "h.hours")


@query("h606_fenced_json", "SELECT event_id, props AS doc FROM events")
def h606(t: Tables) -> DataFrame:
    return t.events.select("event_id", nested.fenced_json(F.concat(F.lit("Here:\n```json\n"), F.col("props"), F.lit("\n``` end"))).alias("doc"))


@query("h608_extras", "SELECT o_orderkey, '{\"o_orderstatus\":\"' || o_orderstatus || '\"}' AS extras FROM orders")
def h608(t: Tables) -> DataFrame:
    cols = ["o_orderkey", "o_orderstatus", "o_orderpriority"]
    return t.orders.select("o_orderkey", nested.extras(["o_orderkey"], cols, ["o_orderpriority"]).alias("extras"))


@query("h609_zip_unnest", "SELECT n_nationkey, unnest(range(1, 4)) AS a, unnest(['x', 'y', 'z']) AS b FROM nation")
def h609(t: Tables) -> DataFrame:
    z = F.arrays_zip(F.array(*[F.lit(i).cast("bigint") for i in (1, 2, 3)]).alias("a"), F.array(*map(F.lit, "xyz")).alias("b"))
    return t.nation.select("n_nationkey", F.explode(z).alias("z")).select("n_nationkey", "z.a", "z.b")


