"""Decisions about companies, addresses and links: each rule set as one function of columns or tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.functions import geo, similarity, text
from geomill.functions.text import lookup

from . import joins, rules


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# ---- companies ---------------------------------------------------------------------------------
# Upper ends of capital classes (right-closed), their names, and the three sizes they stand for.
CAPITAL = [(0, "zero", "micro"), (999, "micro_min", "micro"), (9_999, "micro", "micro"), (99_999, "micro_plus", "small"), (999_999, "small", "middle"), (9_999_999, "middle", "middle"), (99_999_999, "large", "large"), (float("inf"), "corporate", "large")]

# Points of the structure score, in the order in which reasons are named.
STRUCTURE = {"on_site": 3, "serves_public": 2, "branch": 2, "register_confirms": 2, "hybrid": 1, "head_with_branches": 1, "established": 1, "recent": -1, "capital": 1, "single_not_on_site": -1}


def profile_by_code(code: Column, exceptions: dict[str, tuple[str, bool]], divisions: dict[str, tuple[str, bool]]) -> Column:
    """Struct (profile, serves_public, reason, confidence) of an activity code: an exception of the whole code
    wins over its division (first two digits); unknown codes are uncertain."""
    pick = lambda table, key, i: F.try_element_at(lookup({k: v[i] for k, v in table.items()}), key)
    division = F.substring(code, 1, 2)
    exact, broad = pick(exceptions, code, 0), pick(divisions, division, 0)
    public = F.when(exact.isNotNull(), pick(exceptions, code, 1)).when(broad.isNotNull(), pick(divisions, division, 1)).otherwise(F.lit(False))
    reason = F.when(exact.isNotNull(), "exception").when(broad.isNotNull(), "division").otherwise("unmapped")
    confidence = F.when(exact.isNotNull(), "high").when(broad.isNotNull(), "middle").otherwise("low")
    return F.struct(F.coalesce(exact, broad, F.lit("uncertain")).alias("profile"), public.alias("serves_public"), reason.alias("reason"), confidence.alias("confidence"))


def company_class(rows: DataFrame) -> DataFrame:
    """``rows`` with capital_class, size, branches (of the same root) and role.

    Columns: number (14 digits), capital, kind (BRANCH or other), legal (code of the legal form).  Branches
    are counted once a root and joined, so a root with very many rows isn't gathered."""
    def banded(i: int) -> Column:
        out = F.lit("undefined")
        for limit, *names in reversed(CAPITAL):
            out = F.when(F.col("capital") <= limit, names[i]).otherwise(out)
        return F.when(F.col("capital") > -1, out).otherwise("undefined")

    root = F.substring("number", 1, 8)
    n = rows.filter("kind = 'BRANCH'").groupBy(root.alias("_root")).agg(F.count("*").alias("branches"))
    out = rows.withColumn("_root", root).join(n, "_root", "left").withColumn("branches", F.coalesce("branches", F.lit(0)))
    role = F.when(F.col("kind") == "BRANCH", "branch").when(F.col("branches") > 0, "head_with_branches").when(F.col("legal").startswith("2135"), "single").otherwise("head")
    return out.withColumns({"capital_class": banded(0), "size": banded(1), "role": role}).drop("_root")


def structure_score(rows: DataFrame) -> DataFrame:
    """``rows`` with structure (0 to 12), structure_band and structure_why.

    Columns: profile, serves_public, role, register_shop, register_applies, established, recent, date_ok, capital, capital_ok."""
    c = F.col
    signs = {
        "on_site": c("profile") == "on_site", "serves_public": c("serves_public"), "branch": c("role") == "branch", "register_confirms": c("register_shop") & c("register_applies"),
        "hybrid": c("profile") == "hybrid", "head_with_branches": c("role") == "head_with_branches", "established": c("established") & c("date_ok"), "recent": c("recent") & c("date_ok"),
        "capital": (c("capital") >= 100_000) & c("capital_ok"), "single_not_on_site": (c("role") == "single") & ~c("profile").isin("on_site", "hybrid"),
    }
    score, why = rules.score_with_reasons([(yes(cond), STRUCTURE[name], name) for name, cond in signs.items()], 0, 12)
    out = rows.withColumn("structure", score.cast("int")).withColumn("structure_why", F.when(why == "", "none").otherwise(why))
    return out.withColumn("structure_band", rules.bands(F.col("structure"), [(8, "very_high"), (6, "high"), (4, "middle"), (2, "low")], "very_low"))


def address_route(rows: DataFrame) -> DataFrame:
    """``rows`` with address_profile, route and mixed, from the register's indicator (1 to 4) and counts.

    Columns: matched, indicator, shops, homes.  The route follows the indicator and only then the counts."""
    i, shops, homes = F.col("indicator"), F.coalesce("shops", F.lit(0)), F.coalesce("homes", F.lit(0))
    profile = (
        F.when(~F.col("matched"), "no_match").when(i == 1, "one_shop").when(i == 2, "up_to_ten_shops").when(i == 3, "over_ten_shops").when(i == 4, "many_shops")
        .when(shops > 0, "shops_without_indicator").when(homes > 0, "homes_only").otherwise("undetermined")
    )
    route = (
        F.when(~F.col("matched"), "none").when(i == 1, "reclassify").when(i.isin(2, 3, 4), "individualise").when(shops > 1, "individualise")
        .when(shops == 1, "reclassify").otherwise("visit")
    )
    return rows.withColumns({"address_profile": profile, "route": route, "mixed": (shops > 0) & (homes > 0)})


def business_decision(rows: DataFrame, accept_invalid: bool = False) -> DataFrame:
    """``rows`` with commercial (what the place is), fitness (what it can be matched by), usable and why_not.

    Columns: complement (RESIDENTIAL, COMMERCIAL, other), needs_premises, profile, serves_public, located, street_ok,
    number, city, state, postcode_ok, document_ok, document_status, status."""
    c = F.col
    on_site, hybrid = c("profile") == "on_site", c("profile") == "hybrid"
    point = (c("complement") == "COMMERCIAL") | c("needs_premises")
    commercial = (
        F.when((c("complement") == "RESIDENTIAL") & ~c("needs_premises"), "residential").when(on_site & c("serves_public"), "shop").when(on_site, "on_site_not_public")
        .when(point, "other_point").when(hybrid & c("serves_public"), "occasional_shop").otherwise("not_commercial")
    )
    city = yes((F.trim("city") != "") & (F.trim("state") != ""))
    fitness = F.when(c("located"), "coordinate").when(yes(c("street_ok") & (c("number") > 0)) & city, "whole_address").when(yes(c("street_ok")) & city, "part_of_address").when(yes(c("postcode_ok")), "postcode").otherwise("unfit")
    document, active = yes(c("document_ok")) | F.lit(accept_invalid), yes(c("status") == "ACTIVE")
    out = rows.withColumns({"commercial": commercial, "fitness": fitness})
    has_point = c("commercial").isin("shop", "occasional_shop", "other_point", "on_site_not_public")
    parts = F.concat_ws(" + ", F.when(c("commercial") == "residential", "residential_complement"), F.when(c("profile") == "paper", "paper_company"), F.when(c("profile") == "mobile", "mobile_company"), F.when(c("profile") == "uncertain", "unmapped_activity"))
    why = F.when(~document, F.concat(F.lit("document_"), "document_status")).when(~active, F.concat(F.lit("status_"), "status")).when(~has_point, F.when(parts == "", "no_public_on_site").otherwise(parts)).otherwise("")
    return out.withColumns({"usable": document & active & has_point, "why_not": why})


# ---- reliability of records --------------------------------------------------------------------
# Points for the level of a record's coordinate (1 best to 6).
LEVEL_POINTS = {1: 40, 2: 35, 3: 20, 4: 10, 5: 5, 6: 0}


def reliability(rows: DataFrame) -> DataFrame:
    """``rows`` with by_coordinate (0-40), by_address (0-30), by_context (0-30), reliability and its band.

    Columns: level, street_harmonised, street, number, postcode, complement, geo_ok, anomaly, inferred.  A
    confirmed coordinate stands in for a missing postcode."""
    c, filled = F.col, lambda n: F.coalesce(F.trim(n) != "", F.lit(False))
    level = F.coalesce(c("level"), F.lit(6))
    one = F.when(c("inferred"), 0).otherwise(F.coalesce(F.try_element_at(lookup(LEVEL_POINTS), level), F.lit(0)))
    confirmed = ~c("inferred") & level.isin(1, 2) & yes(c("geo_ok"))
    street = F.when(filled("street_harmonised"), 10).when(filled("street"), 7).otherwise(0)
    post = rules.give((F.length(F.regexp_replace(F.coalesce("postcode", F.lit("")), "[^0-9]", "")) == 8) | confirmed, 7)
    two = street + rules.give(c("number") > 0, 8) + post + rules.give(filled("complement"), 5)
    three = rules.give(c("geo_ok"), 10) + rules.give(filled("street_harmonised"), 8) + rules.give(~yes(c("anomaly")), 7) + rules.give(~c("inferred"), 5)
    out = rows.withColumns({"by_coordinate": one, "by_address": two, "by_context": three})
    out = out.withColumn("reliability", c("by_coordinate") + c("by_address") + c("by_context"))
    return out.withColumn("band", F.when(c("reliability") > 75, "very_high").when(c("reliability") > 55, "high").when(c("reliability") > 35, "middle").otherwise("low"))


def late_signal(rows: DataFrame) -> DataFrame:
    """``rows`` (level, block, unit, floor, reasons, flagged) after the complements are known: a poor coordinate
    with a rich complement is a reason of its own, and raises the flag only beside an earlier one."""
    s5 = F.col("level").isin(4, 5, 6) & F.col("block").isNotNull() & F.col("unit").isNotNull() & F.col("floor").isNotNull()
    earlier = F.arrays_overlap("reasons", F.array(F.lit("many_streets_at_a_point"), F.lit("repeated_shop"), F.lit("generic_mass")))
    return rows.withColumns({"reasons": F.when(yes(s5), F.concat("reasons", F.array(F.lit("poor_point_rich_complement")))).otherwise(F.col("reasons")), "flagged": F.col("flagged") | yes(s5 & earlier)})


# Kinds of register rows, and the numbers of shops that an indicator declares.
HOMES, SHOPS = (1, 2), (3, 4, 5, 6, 8)
DECLARED = {1: (1, 1), 2: (2, 10), 3: (11, None), 4: (2, None)}


def declared_vs_counted(rows: DataFrame, key: str) -> DataFrame:
    """(key, counted, verdict): shops counted at an address against those its rows declare.  Columns: key, kind, indicator."""
    g = rows.groupBy(key).agg(F.count_if(F.col("kind").isin(*SHOPS)).alias("counted"), F.max("indicator").alias("declared"))
    lo = F.try_element_at(lookup({k: v[0] for k, v in DECLARED.items()}), F.col("declared"))
    hi = F.try_element_at(lookup({k: v[1] for k, v in DECLARED.items() if v[1]}), F.col("declared"))
    verdict = F.when(lo.isNull(), "not_declared").when(F.col("counted") < lo, "fewer").when(F.col("counted") > hi, "more").otherwise("confirmed")
    return g.select(key, "counted", verdict.alias("verdict"))


def mixed_use(rows: DataFrame, key: str) -> DataFrame:
    """(key, mixed, active_front): homes and shops at one address; a shop on the ground floor below homes.  Columns: key, kind, ground."""
    home, shop = F.col("kind").isin(*HOMES), F.col("kind").isin(*SHOPS)
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return rows.groupBy(key).agg((has(home) & has(shop)).alias("mixed"), (has(shop & F.col("ground")) & has((F.col("kind") == 1) & ~F.col("ground"))).alias("active_front"))


def horizontal_compound(rows: DataFrame, key: str, least: int = 4, most_streets: int = 2, share: float = 0.5) -> DataFrame:
    """(key, units, compound): addresses with enough houses on few inner streets, most of them homes without a floor.

    Columns: key, kind, street, floor, unit."""
    g = rows.groupBy(key).agg(F.countDistinct("unit").alias("units"), F.countDistinct("street").alias("streets"), F.avg(((F.col("kind").isin(*HOMES)) & F.col("floor").isNull()).cast("double")).alias("flat"))
    return g.select(key, "units", ((F.col("units") >= least) & (F.col("streets") <= most_streets) & (F.col("flat") >= share)).alias("compound"))


def probable_address(street: Column, number: Column, unit: Column, inferred: Column, area: Column) -> Column:
    """Street, number (S/N without one), unit, area; marked if it was inferred and not declared."""
    n = F.when(yes(F.trim(number) != ""), number).otherwise("S/N")
    whole = F.concat_ws(", ", street, n, F.when(yes(F.trim(unit) != ""), unit), F.when(yes(F.trim(area) != ""), area))
    return F.when(yes(F.trim(street) != ""), F.concat(whole, F.when(inferred, F.lit(" (inferred)")).otherwise("")))


# ---- verdicts on connections -------------------------------------------------------------------
def checked_decision(votes: DataFrame, today: Column, most_days: int = 365) -> DataFrame:
    """(connection, sources, decision) after the model: NO without valid proof; REVIEW if all of it is old, of one
    source, or of a poi that is claimed by another connection as well; else YES.

    Votes: connection, poi, source, valid, day."""
    good = votes.filter("valid")
    claimed = good.groupBy("poi").agg(F.countDistinct("connection").alias("claims"))
    good = good.join(claimed, "poi").withColumn("own", F.col("claims") == 1)
    g = good.groupBy("connection").agg(F.countDistinct(F.when(F.col("own"), F.col("source"))).alias("sources"), F.max("day").alias("last"))
    g = votes.select("connection").distinct().join(g, "connection", "left")
    decision = F.when(F.col("sources").isNull(), "NO").when((F.col("sources") < 2) | (F.datediff(today, F.col("last")) > most_days), "REVIEW").otherwise("YES")
    return g.select("connection", F.coalesce("sources", F.lit(0)).alias("sources"), decision.alias("decision"))


def vacant_after_proof(signs: DataFrame, proofs: DataFrame, key: str) -> DataFrame:
    """(key, vacant): whether a dated vacancy sign is at least as new as the last dated proof of use, or there is none.  Columns: key, day."""
    s, p = signs.filter("day IS NOT NULL").groupBy(key).agg(F.max("day").alias("sign")), proofs.filter("day IS NOT NULL").groupBy(key).agg(F.max("day").alias("proof"))
    return s.join(p, key, "left").select(key, (F.col("proof").isNull() | (F.col("sign") >= F.col("proof"))).alias("vacant"))


def document_confidence(valid: Column, in_base: Column, state: Column, city: Column) -> Column:
    """Struct (level 0-4, marks): check digits, the national base, and there the state and the city."""
    parts = [(valid, "digits"), (in_base, "base"), (in_base & state, "state"), (in_base & city, "city")]
    marks = F.concat_ws("+", *[F.when(yes(c), name) for c, name in parts])
    return F.struct(sum((rules.give(c, 1) for c, _ in parts), F.lit(0)).alias("level"), F.when(marks == "", "structure_only").otherwise(marks).alias("marks"))


def graded_flag(confidence: Column) -> Column:
    """Order of visits by a confidence text such as 3/4: all proven, some, none."""
    c = F.coalesce(confidence, F.lit(""))
    return F.when(c.startswith("4/4"), "reclassify_high").when(c.rlike("^[0-9]"), "reclassify_middle").otherwise("reclassify_low")


def consistency_checks(errors: dict[str, Column], warnings: dict[str, Column], confidence: Column, ceiling: float = 0.6) -> Column:
    """Struct (errors, warnings, confidence): names of the checks that hold; any warning caps the confidence, an error sets it to 0."""
    named = lambda checks: F.array_compact(F.array(*[F.when(yes(c), F.lit(name)) for name, c in checks.items()]))
    e, w = named(errors), named(warnings)
    return F.struct(e.alias("errors"), w.alias("warnings"), F.when(F.size(e) > 0, F.lit(0.0)).when(F.size(w) > 0, F.least(confidence, F.lit(ceiling))).otherwise(confidence).alias("confidence"))


# ---- links -------------------------------------------------------------------------------------
def exact_address(rows: DataFrame, register: DataFrame) -> DataFrame:
    """(a_id, b_id, reason): rows with the address key of a register row, however far; vetoed ones with their reason.

    Rows: id, address, area, fit, inactive.  Register: id, address, area."""
    x, y = rows.filter("address IS NOT NULL").alias("x"), register.filter("address IS NOT NULL").alias("y")
    pairs = x.join(y, F.col("x.address") == F.col("y.address"))
    other = ~yes(text.same_area(F.col("x.area"), F.col("y.area"))) & (F.trim("x.area") != "") & (F.trim("y.area") != "")
    reason = F.when(yes(F.col("x.inactive")), "inactive").when(~F.coalesce(F.col("x.fit"), F.lit(True)), "unfit").when(yes(other), "other_area")
    return pairs.select(F.col("x.id").alias("a_id"), F.col("y.id").alias("b_id"), reason.alias("reason"))


def review_links(links: DataFrame, least: float = 0.6) -> DataFrame:
    """``links`` with today's confidence and, for those that today's rule refuses, the family of the reason.

    Columns: street, number, near, roof, shop_roof, proven, inactive."""
    now = rules.link_confidence(*[F.col(c) for c in ("street", "number", "near", "roof", "shop_roof", "proven")])
    why = F.when(yes(F.col("inactive")), "company").when(~F.col("street") & ~F.col("roof"), "place").when(F.col("street") & ~F.col("number") & ~F.col("near"), "distance")
    return links.withColumn("confidence", now).withColumn("dropped", F.when((F.col("confidence") < least) | yes(F.col("inactive")), F.coalesce(why, F.lit("evidence"))))


def street_evidence(signs: DataFrame, named: DataFrame, doors: DataFrame, margin: int = 4) -> DataFrame:
    """(id, number, step): house numbers for signs that show none.

    Signs: id, street, name, seen (numbers read in the same scene).  Named: street, name, number of known places.
    Doors: street, number.  First the number of places of a similar name on the street, if they agree; then
    the only door between the scene's numbers and a margin; then the only door that all sightings of the same
    sign (street and name) share."""
    words = lambda c: F.array_distinct(text.words(F.col(c)))
    s = signs.withColumn("w", words("name")).alias("s")
    n = named.filter("number IS NOT NULL").select("street", words("name").alias("v"), "number").alias("n")
    alike = s.join(n, "street").filter(similarity.overlap(F.col("w"), F.col("v")) >= 0.8)
    one = alike.groupBy("id").agg(F.min("number").alias("number"), F.max("number").alias("top")).filter("number = top").select("id", "number", F.lit("name").alias("step"))
    rest = signs.join(one.select("id"), "id", "left_anti").filter("size(seen) > 0")
    near = rest.select("id", "street", "name", (F.array_min("seen") - margin).alias("lo"), (F.array_max("seen") + margin).alias("hi"))
    near = near.join(doors.select("street", "number").distinct(), "street").filter("number BETWEEN lo AND hi").select("id", "street", "name", "number")
    two = near.groupBy("id").agg(F.min("number").alias("number"), F.max("number").alias("top")).filter("number = top").select("id", "number", F.lit("scene").alias("step"))
    rest = near.join(two.select("id"), "id", "left_anti")
    seen = near.select("street", "name", "id").distinct().groupBy("street", "name").agg(F.count("*").alias("sightings")).filter("sightings > 1")
    shared = near.groupBy("street", "name", "number").agg(F.countDistinct("id").alias("n")).join(seen, ["street", "name"]).filter("n = sightings")
    shared = shared.groupBy("street", "name").agg(F.min("number").alias("number"), F.max("number").alias("top")).filter("number = top").drop("top")
    three = rest.select("id", "street", "name").distinct().join(shared, ["street", "name"]).select("id", "number", F.lit("sightings").alias("step"))
    return one.unionByName(two).unionByName(three)


# ---- places ------------------------------------------------------------------------------------
def area_choice(published: Column, reverse: Column, sieve: Column) -> Column:
    """Struct (area, origin, doubt): the published neighbourhood, then that of the reverse address, then the sieve's;
    in doubt if the first two differ by a word that tells areas apart."""
    filled = lambda c: F.when(yes(F.trim(c) != ""), c)
    p, r, s = filled(published), filled(reverse), filled(sieve)
    origin = F.when(p.isNotNull(), "published").when(r.isNotNull(), "reverse").when(s.isNotNull(), "sieve")
    return F.struct(F.coalesce(p, r, s).alias("area"), origin.alias("origin"), (p.isNotNull() & r.isNotNull() & ~text.same_area(p, r)).alias("doubt"))


def preferred_coordinate(rows: DataFrame, doors: DataFrame) -> DataFrame:
    """(id, door, how) of every row: the door of its street and number; of its street, the nearest number, or without
    a number the first; of its postcode, unless that is a town's general one (it ends with 000); or none.

    Rows: id, street, number, postcode.  Doors: id, street, number, postcode.  Doors are first reduced to one a
    (street, number) and (postcode, number), so a street's rows meet numbers and not doors."""
    key = lambda d: d.withColumn("core", text.street_core(F.col("street")))
    r, d = key(rows).select("id", "core", "number", "postcode"), key(doors)
    general = F.regexp_replace("postcode", "[^0-9]", "").endswith("000")

    def best(left: DataFrame, by: str, named: tuple[str, str, str]) -> DataFrame:
        one = d.groupBy(by, "number").agg(F.min("id").alias("door")).withColumnRenamed("number", "n").filter(F.col(by) != "")
        apart = F.abs(F.col("number") - F.col("n"))
        p = left.join(one, by).groupBy("id").agg(F.min(F.struct(F.coalesce(apart, F.lit(0)).alias("apart"), F.col("n").isNull().alias("bare"), F.when(F.col("number").isNull(), 0).otherwise(F.col("n")).alias("n"), "door")).alias("h"), F.first("number").alias("number"))
        how = F.when(F.col("number").isNull(), named[2]).when(F.col("h.apart") == 0, named[0]).otherwise(named[1])
        return p.select("id", F.col("h.door").alias("door"), how.alias("how"))

    a = best(r.filter("core <> ''"), "core", ("street_number", "street_nearest", "street"))
    b = best(r.join(a.select("id"), "id", "left_anti").filter(~general), "postcode", ("postcode", "postcode", "postcode"))
    return rows.select("id").join(a.unionByName(b), "id", "left").withColumn("how", F.coalesce("how", F.lit("none")))


# Metres that a declared precision stands for.
PRECISION_M = {"exact": 10, "street": 100, "area": 1000, "city": 10_000}


def geocoder_choice(answers: DataFrame, order: Sequence[str]) -> DataFrame:
    """(id, source, metres): the first source, in this order, whose answer lies in the right city and street.

    Answers: id, source, city_ok, street_ok, precision; an answer that is no finer than an area needs no street."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    ok = (place > 0) & yes(F.col("city_ok")) & (F.col("precision").isin("area", "city") | yes(F.col("street_ok")))
    best = answers.filter(ok).groupBy("id").agg(F.min(F.struct(place.alias("place"), "source", "precision")).alias("h"))
    return best.select("id", F.col("h.source").alias("source"), F.try_element_at(lookup(PRECISION_M), F.col("h.precision")).alias("metres"))


def move_with_proof(rows: DataFrame, doors: DataFrame, far_m: float = 150.0) -> DataFrame:
    """(id, door, m, proof, verdict) of rows that lie far from the door of their street and number.

    Rows: id, lat, lng, street, number, address (as written).  Doors: id, lat, lng, street, number, area, postcode.
    A door is corroborated if the written address names its area or postcode; such doors go before nearer ones.
    Rows move to a corroborated door, or to the only door if the address names no other postcode; the rest is reviewed."""
    plain, digits = text.strip_accents(F.col("address")), F.regexp_replace("address", "[^0-9]", "")
    post = F.regexp_replace("d.postcode", "[^0-9]", "")
    p = rows.alias("r").join(doors.alias("d"), (F.col("r.street") == F.col("d.street")) & (F.col("r.number") == F.col("d.number")))
    by_area, by_post = yes((F.trim("d.area") != "") & F.contains(plain, text.strip_accents(F.col("d.area")))), yes((post != "") & F.contains(digits, post))
    written = F.transform(F.regexp_extract_all("address", F.lit("([0-9]{5}-?[0-9]{3})"), F.lit(1)), lambda c: F.regexp_replace(c, "-", ""))
    m = geo.metres(F.col("r.lat"), F.col("r.lng"), F.col("d.lat"), F.col("d.lng"))
    p = p.select(F.col("r.id").alias("id"), F.col("d.id").alias("door"), m.alias("m"), F.concat_ws("+", F.when(by_area, "area"), F.when(by_post, "postcode")).alias("proof"), yes((F.size(written) > 0) & ~F.array_contains(written, post)).alias("against"))
    g = p.groupBy("id").agg(F.min(F.struct((F.col("proof") == "").alias("bare"), "m", "door", "proof", "against")).alias("h"), F.count("*").alias("n")).filter(F.col("h.m") > far_m)
    proof = F.when(F.col("h.proof") != "", F.col("h.proof")).when((F.col("n") == 1) & ~F.col("h.against"), "only_door")
    return g.select("id", F.col("h.door").alias("door"), F.col("h.m").alias("m"), proof.alias("proof"), F.when(proof.isNotNull(), "move").otherwise("review").alias("verdict"))


def search_points(points: DataFrame, cell: float, city: str, state: str) -> DataFrame:
    """(cy, cx, id, search): the address to search from in each grid cell: that of its numbered point nearest to the centre.

    Points: id, lat, lng, street, number."""
    cy, cx = F.floor(F.col("lat") / cell), F.floor(F.col("lng") / cell)
    off = F.abs(F.col("lat") - (cy + 0.5) * cell) + F.abs(F.col("lng") - (cx + 0.5) * cell)
    p = points.filter("street <> '' AND number <> ''").select(cy.cast("bigint").alias("cy"), cx.cast("bigint").alias("cx"), F.struct(F.round(off, 7).alias("off"), "id", "street", "number").alias("p"))
    g = p.groupBy("cy", "cx").agg(F.min("p").alias("p"))
    return g.select("cy", "cx", F.col("p.id").alias("id"), F.concat(F.col("p.street"), F.lit(", "), F.col("p.number"), F.lit(f" - {city}/{state}")).alias("search"))


def same_roof(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """(a, b) with a < b: points whose pixels carry the same label of the same tile.  Points: id, tile, y, x; pixels: tile, y, x, label."""
    p = points.join(pixels, ["tile", "y", "x"]).select("id", "tile", "label")
    return joins.key_pairs(p, ["tile", "label"]).select("a", "b")


def reconciled(readings: DataFrame, strong: float = 0.7, volatile: Sequence[str] = ()) -> DataFrame:
    """(key, field, value, conflict, temporal): of each field the reading with the best score, then the newest, then the
    first file; in conflict if two strong readings differ, temporal if the field may change and their days differ.

    Readings: key, field, value, score, day, file."""
    order = F.struct((-F.col("score")).alias("s"), F.col("day").isNull().alias("none"), (-F.unix_date("day")).alias("d"), "file")
    sure = F.when(F.col("score") >= strong, F.col("value"))
    g = readings.groupBy("key", "field").agg(F.min_by("value", order).alias("value"), (F.countDistinct(sure) > 1).alias("conflict"), F.countDistinct("day").alias("days"))
    return g.select("key", "field", "value", "conflict", (F.col("conflict") & F.col("field").isin(*volatile) & (F.col("days") > 1)).alias("temporal"))


def one_side_inside(pairs: DataFrame, points: DataFrame, ring) -> DataFrame:
    """The pairs (a, b) with an end inside the ring.  Points: id, lat, lng."""
    inside = points.filter(geo.in_ring(F.col("lat"), F.col("lng"), geo.ring_literal(ring))).select("id", F.lit(True).alias("in"))
    ends = pairs.join(inside.withColumnsRenamed({"id": "a", "in": "in_a"}), "a", "left").join(inside.withColumnsRenamed({"id": "b", "in": "in_b"}), "b", "left")
    return ends.filter(yes(F.col("in_a")) | yes(F.col("in_b"))).select("a", "b")


def area_label(rows: DataFrame, ring) -> DataFrame:
    """``rows`` with used_lat, used_lng (that of the map, else the source's) and outside; nothing is dropped.

    Columns: map_lat, map_lng, source_lat, source_lng."""
    out = rows.withColumns({"used_lat": F.coalesce("map_lat", "source_lat"), "used_lng": F.coalesce("map_lng", "source_lng")})
    return out.withColumn("outside", ~yes(geo.in_ring(F.col("used_lat"), F.col("used_lng"), geo.ring_literal(ring))))


def incoherent(links: DataFrame, registry: DataFrame) -> DataFrame:
    """(id, reason) of links (id, document, city, state) whose registry row (document, city, state) lies in another state or city."""
    r = registry.select("document", F.col("city").alias("r_city"), F.col("state").alias("r_state"))
    plain = lambda c: text.norm_name(F.col(c))
    reason = F.when(plain("state") != plain("r_state"), "state").when(plain("city") != plain("r_city"), "city")
    return links.join(r, "document").select("id", reason.alias("reason")).filter("reason IS NOT NULL")


def coordinate_audit(rows: DataFrame, doors: DataFrame, radius_m: float = 50.0) -> DataFrame:
    """(id, found, agrees): the street of the nearest door against the stated one.  Rows and doors: id, lat, lng, street."""
    near = joins.within(rows, doors, radius_m, carry=["street"]).groupBy("a_id").agg(F.min(F.struct("m", "b_id", "a_street", "b_street")).alias("h"))
    return near.select(F.col("a_id").alias("id"), F.col("h.b_street").alias("found"), (text.street_core(F.col("h.a_street")) == text.street_core(F.col("h.b_street"))).alias("agrees"))


def reloaded(target: DataFrame, sources: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Rows to insert: those of the sources, earlier sources first, whose key the target lacks; running it again adds nothing."""
    marked = [s.select(*target.columns, F.lit(i).alias("_from")) for i, s in enumerate(sources)]
    out = marked[0]
    for s in marked[1:]:
        out = out.unionByName(s)
    out = out.groupBy(*key).agg(F.min_by(F.struct(*target.columns), F.struct("_from", *[c for c in target.columns if c not in key])).alias("r")).select("r.*")
    return out.join(target.select(*key), list(key), "left_anti").select(*target.columns)
