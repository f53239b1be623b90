"""String and address normalisation as column functions; nothing here runs Python on the executors.

Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks of the Latin alphabet in use, and what they are without.
MARKED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyy"

# Texts that stand for a missing value.
VOID = ("", "nan", "none", "null", "n/a", "na", "-", "--", "?", "sem site", "nao informado")

# Hosts that name a platform and not a business.
SHARED_HOSTS = (
    "", "instagram.com", "facebook.com", "fb.com", "wa.me", "api.whatsapp.com", "whatsapp.com", "linktr.ee", "google.com", "goo.gl", "maps.google.com",
    "ifood.com.br", "linkedin.com", "twitter.com", "x.com", "youtube.com", "tiktok.com", "bit.ly",
)

# Short and full forms of street types.
STREET_TYPES = {
    "r": "rua", "av": "avenida", "avn": "avenida", "trav": "travessa", "tv": "travessa", "al": "alameda", "pc": "praca",
    "rod": "rodovia", "estr": "estrada", "lgo": "largo", "bc": "beco",
}
STREET_WORDS = tuple(dict.fromkeys(STREET_TYPES.values()))

# All street types, with the forms that stand for them.
ALL_TYPES = {
    "r": "rua", "rua": "rua", "av": "avenida", "avn": "avenida", "avenida": "avenida", "tv": "travessa", "trav": "travessa", "trv": "travessa", "travessa": "travessa",
    "est": "estrada", "estr": "estrada", "estrada": "estrada", "rod": "rodovia", "rodovia": "rodovia", "al": "alameda", "alameda": "alameda", "pc": "praca", "pca": "praca", "praca": "praca",
    "viela": "viela", "beco": "beco", "via": "via", "vl": "vila", "vila": "vila", "parque": "parque", "pq": "parque", "distrito": "distrito", "linha": "linha", "servidao": "servidao",
    "condominio": "condominio", "cond": "condominio", "loteamento": "loteamento", "lot": "loteamento", "passagem": "passagem", "quadra": "quadra", "qd": "quadra", "setor": "setor", "st": "setor",
    "largo": "largo", "lgo": "largo", "jardim": "jardim", "jd": "jardim", "nucleo": "nucleo", "chacara": "chacara", "sitio": "sitio", "fazenda": "fazenda",
}

# Titles in street names and their short forms.
TITLES = {
    "dr": "doutor", "dra": "doutora", "eng": "engenheiro", "prof": "professor", "profa": "professora", "cor": "coronel", "cel": "coronel", "pe": "padre", "fr": "frei", "dep": "deputado",
    "ver": "vereador", "maj": "major", "cap": "capitao", "tte": "tenente", "gen": "general", "gov": "governador", "pres": "presidente", "brig": "brigadeiro", "alm": "almirante", "visc": "visconde",
    "sto": "santo", "sta": "santa", "nsa": "nossa", "sr": "senhor", "sra": "senhora",
}

# Words that don't tell a street from others.
NUCLEUS_STOP = (
    "de", "da", "do", "das", "dos", "e", "doutor", "doutora", "professor", "professora", "coronel", "padre", "general", "capitao", "major", "presidente", "governador", "deputado", "vereador",
    "visconde", "frei", "tenente", "brigadeiro", "almirante", "senhor", "senhora",
)

# The months, and short forms that are words of their own.
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
HOMOGRAPHS = ("mar", "bar")

# Words of a neighbourhood's name that don't tell it from others.
COMMON_AREA_WORDS = ("nossa", "senhora", "sao", "santa", "santo", "vila", "jardim", "parque", "bairro", "nova", "novo", "das", "dos", "de", "da", "do")

# Kinds of units inside one house number, and their short forms.
UNIT_KINDS = {"cs": "casa", "apartamento": "ap", "apto": "ap", "apt": "ap", "sl": "sala", "lj": "loja", "cj": "conjunto"}

# Portuguese numerals.
NUMERALS = {
    "zero": 0, "um": 1, "uma": 1, "dois": 2, "duas": 2, "tres": 3, "quatro": 4, "cinco": 5, "seis": 6, "sete": 7, "oito": 8, "nove": 9, "dez": 10, "onze": 11, "doze": 12, "treze": 13,
    "quatorze": 14, "catorze": 14, "quinze": 15, "dezesseis": 16, "dezasseis": 16, "dezessete": 17, "dezoito": 18, "dezenove": 19, "vinte": 20, "trinta": 30, "quarenta": 40,
    "cinquenta": 50, "cincoenta": 50, "sessenta": 60, "setenta": 70, "oitenta": 80, "noventa": 90, "cem": 100, "cento": 100, "duzentos": 200, "duzentas": 200,
    "trezentos": 300, "trezentas": 300, "quatrocentos": 400, "quatrocentas": 400, "quinhentos": 500, "quinhentas": 500, "seiscentos": 600, "seiscentas": 600,
    "setecentos": 700, "setecentas": 700, "oitocentos": 800, "oitocentas": 800, "novecentos": 900, "novecentas": 900, "mil": 1000,
}


def lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often it is used; without it an expression is repeated at each use, also for
    each element inside of array functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_accents(c: Column) -> Column:
    return F.translate(F.lower(c), MARKED, PLAIN)


def norm_name(c: Column) -> Column:
    """Lower-case letters, digits and spaces."""
    return F.trim(F.regexp_replace(strip_accents(c), "[^a-z0-9 ]", " "))


def void_to_null(c: Column) -> Column:
    return F.when(~F.trim(strip_accents(c)).isin(*VOID), c)


def tokens(c: Column, longer_than: int = 2) -> Column:
    """Distinct words of a normalised name with more than so many letters."""
    return F.array_distinct(F.filter(F.split(norm_name(c), " +"), lambda t: F.length(t) > longer_than))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def phone_key(c: Column) -> Column:
    """Digits of a phone number without the country's prefix; empty if void."""
    d = digits(c)
    return F.when(void_to_null(c).isNull(), "").when((F.length(d) > 11) & d.startswith("55"), F.substring(d, 3, 64)).otherwise(d)


def domain(c: Column) -> Column:
    """Host of an address without www; empty if void or shared by many."""
    u = F.regexp_replace(F.trim(strip_accents(c)), r"^\w+://", "")
    u = F.regexp_replace(F.split_part(F.split_part(u, F.lit("/"), F.lit(1)), F.lit("?"), F.lit(1)), r"^www\.", "")
    return F.when(c.isNull() | u.isin(*SHARED_HOSTS) | u.isin(*VOID), "").otherwise(u)


def words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(strip_accents(c), "[^a-z0-9 ]", " "), " +"), lambda t: t != "")


def street(c: Column) -> Column:
    """Comparable street: type spelt out, no accents or punctuation."""
    w, full = words(c), lookup(STREET_TYPES)
    first = F.coalesce(F.try_element_at(full, F.try_element_at(w, F.lit(1))), F.try_element_at(w, F.lit(1)))
    return F.concat_ws(" ", first, F.slice(w, 2, 1000))


def street_core(c: Column) -> Column:
    """The street without its type."""
    w = F.split(street(c), " ")
    return F.when(F.try_element_at(w, F.lit(1)).isin(*STREET_WORDS), F.concat_ws(" ", F.slice(w, 2, 1000))).otherwise(street(c))


def address_key(street_text: Column, number: Column) -> Column:
    """Core of the street and the number's digits; null without either."""
    core, n = street_core(street_text), digits(number)
    return F.when((core != "") & (n != ""), F.concat(core, F.lit("|"), n))


def clean_number(c: Column) -> Column:
    """First run of digits without leading zeros; null if there is none or it has over six."""
    d = F.regexp_extract(c, "([0-9]+)", 1)
    d = F.when(d != "", F.when(F.ltrim(d, F.lit("0")) == "", "0").otherwise(F.ltrim(d, F.lit("0"))))
    return F.when(F.length(d) <= 6, d)


def number_agrees(registered: Column, installed: Column) -> Column:
    """equal, different or no_number; a range such as 120-126 holds the numbers within."""
    inst, reg = F.regexp_extract(installed, "([0-9]+)", 1), F.regexp_extract(registered, "([0-9]+)", 1)
    pair = r"([0-9]{1,6})\s*(?:-|/|a|ao)\s*([0-9]{1,6})"
    lo, hi = F.expr("0"), F.expr("0")
    lo, hi = F.regexp_extract(registered, pair, 1).try_cast("bigint"), F.regexp_extract(registered, pair, 2).try_cast("bigint")
    ni, nr = inst.try_cast("bigint"), reg.try_cast("bigint")
    none = inst.isNull() | reg.isNull() | (inst == "") | (reg == "") | (ni == 0)
    in_range = (lo < hi) & (hi - lo <= 40) & ni.between(lo, hi)
    odd = (nr == 0) | (F.length(F.ltrim(reg, F.lit("0"))) > 6)
    return F.when(none, "no_number").when(F.coalesce(in_range, F.lit(False)), "equal").when(odd, "no_number").when(nr == ni, "equal").otherwise("different")


def units(c: Column) -> Column:
    """The units named in an address, such as casa 2, sorted."""
    t = strip_accents(c)
    pattern = F.lit(r"\b(casa|cs|apartamento|apto|apt|ap|sala|sl|loja|lj|box|conjunto|cj)\.?\s*0*([0-9]{1,5})\b")
    kinds, numbers = F.regexp_extract_all(t, pattern, F.lit(1)), F.regexp_extract_all(t, pattern, F.lit(2))
    full = lookup(UNIT_KINDS)
    return F.array_sort(F.array_distinct(F.zip_with(kinds, numbers, lambda k, n: F.concat(F.coalesce(F.try_element_at(full, k), k), F.lit(" "), n))))


def same_area(a: Column, b: Column) -> Column:
    """Two neighbourhood names agree by a word that tells them from others."""
    common = F.array(*map(F.lit, COMMON_AREA_WORDS))
    own = lambda c: F.filter(F.array_except(words(c), common), lambda t: F.length(t) >= 3)
    filled = (F.size(words(a)) > 0) & (F.size(words(b)) > 0)
    return F.coalesce(filled & ((F.array_join(words(a), " ") == F.array_join(words(b), " ")) | F.arrays_overlap(own(a), own(b))), F.lit(False))


def postcodes(c: Column) -> Column:
    """All eight-digit postcodes, as digits."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\b([0-9]{5}-?[0-9]{3})\b"), F.lit(1)), lambda x: F.regexp_replace(x, "-", ""))


def declares_vacant(c: Column) -> Column:
    """The name itself says that the place is empty (four words at most)."""
    w = words(c)
    last, two = F.try_element_at(w, F.lit(-1)), F.concat_ws(" ", F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), F.lit(2)))
    end = last.isin("vago", "vaga", "vazio", "vazia", "desocupado", "desocupada", "fechado", "fechada")
    return F.coalesce((F.size(w).between(1, 4)) & (end | (two == "sem uso")), F.lit(False))


def phonetic(c: Column) -> Column:
    """Sound key of Portuguese words; words with other than letters stay."""

    def one(t: Column) -> Column:
        x = t
        for a, b in (("ch", "x"), ("ph", "f"), ("sh", "x"), ("lh", "l"), ("nh", "n"), ("qu", "k")):
            x = F.replace(x, F.lit(a), F.lit(b))
        x = F.regexp_replace(F.regexp_replace(x, "g(?=[ei])", "j"), "c(?=[ei])", "s")
        x = F.translate(x, "qwyzh", "kvis")
        return F.when(t.rlike("^[a-z]+$"), F.regexp_replace(x, r"(.)\1+", "$1")).otherwise(t)

    return F.array_join(F.transform(words(c), one), " ")


def roman(c: Column) -> Column:
    """Value of a Roman numeral; null for other texts."""
    t = F.upper(c)
    value = lookup({"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000})
    letters = F.transform(F.split(t, ""), lambda x: F.coalesce(F.try_element_at(value, x), F.lit(0)))
    total = F.aggregate(
        F.reverse(letters), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")),
        lambda s, x: F.struct((s["sum"] + F.when(x < s["last"], -x).otherwise(x)).alias("sum"), x.alias("last")), lambda s: s["sum"],
    )
    return F.when((t != "") & t.rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"), total)


def numeral(c: Column) -> Column:
    """Value of Portuguese numeral words joined by e; null if a word is none or the sizes don't fall."""
    w = F.filter(words(c), lambda t: t != "e")
    values = F.transform(w, lambda t: F.try_element_at(lookup(NUMERALS), t))
    falling = F.aggregate(
        values, F.struct(F.lit(True).alias("ok"), F.lit(10_000).alias("last")),
        lambda s, x: F.struct((s["ok"] & x.isNotNull() & (F.length(F.regexp_replace(x.cast("string"), "0+$", "")) <= 2) & (x < s["last"]) & ((s["last"] >= 100) | ((s["last"] >= 20) & (x < 10)))).alias("ok"), F.coalesce(x, F.lit(0)).alias("last")), lambda s: s["ok"],
    )
    return F.when((F.size(w) > 0) & falling, F.aggregate(values, F.lit(0), lambda a, x: a + x))


def replace_words(c: Column, table: dict[str, str]) -> Column:
    """Each word by the table, joined by spaces."""
    m = lookup(table)
    return F.array_join(F.transform(words(c), lambda t: F.coalesce(F.try_element_at(m, t), t)), " ")


def equivalence_key(c: Column) -> Column:
    """Sound key with Roman numerals as digits; enumerators (digits, single letters) stay."""

    def one(t: Column) -> Column:
        r = F.when(F.length(t) >= 2, roman(t))
        return F.coalesce(r.cast("string"), F.when(t.rlike("^([0-9]+|[a-z]|[a-z]{1,2}[0-9]+|[0-9]+[a-z])$"), t), phonetic(t))

    return F.array_join(F.transform(words(c), one), " ")


def compose_address(street_: Column, number: Column, area: Column, city: Column, state: Column, postcode: Column) -> Column:
    """``Street, 13 - Area, City - ST, postcode`` of the parts there are."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    head = F.concat_ws(", ", some(street_), some(number))
    place = F.concat_ws(" - ", some(city), some(state))
    middle = F.concat_ws(" - ", some(head), some(area))
    return F.concat_ws(", ", some(middle), some(place), some(postcode))


def parse_address(c: Column) -> Column:
    """Struct (street, number, area, city, state, postcode) of a composed address."""
    g = lambda i: F.regexp_extract(c, r"^\s*([^,]+?)(?:,\s*([0-9]+[A-Za-z]?))?(?:\s+-\s+([^,]+?))?,\s*([^,]+?)\s+-\s+([A-Z]{2})(?:,\s*([0-9]{5}-?[0-9]{3}))?\s*$", i)
    names = ("street", "number", "area", "city", "state", "postcode")
    return F.struct(*[F.nullif(g(i + 1), F.lit("")).alias(n) for i, n in enumerate(names)])


def formula_safe(c: Column) -> Column:
    """Text that a spreadsheet won't take for a formula."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def html_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), "<[^>]+>", " "), r"\s+", " "))


def emails(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"), F.lit(1))


def column_name(raw: str, used: set[str]) -> str:
    """A clean, unused column name."""
    import re
    import unicodedata

    plain = "".join(ch for ch in unicodedata.normalize("NFD", raw.strip().lower()) if unicodedata.category(ch) != "Mn")
    name = re.sub(r"[^a-z0-9]+", "_", re.sub(r"^cod_(?=lat|long)", "", plain)).strip("_") or "column"
    name = f"c_{name}" if name[0].isdigit() else name
    out, i = name, 2
    while out in used:
        out, i = f"{name}_{i}", i + 1
    used.add(out)
    return out


# Portuguese numerals by value, for spelling numbers out.
ONES = ("zero", "um", "dois", "tres", "quatro", "cinco", "seis", "sete", "oito", "nove", "dez", "onze", "doze", "treze", "quatorze", "quinze", "dezesseis", "dezessete", "dezoito", "dezenove")
TENS = ("", "", "vinte", "trinta", "quarenta", "cinquenta", "sessenta", "setenta", "oitenta", "noventa")
HUNDREDS = ("", "cento", "duzentos", "trezentos", "quatrocentos", "quinhentos", "seiscentos", "setecentos", "oitocentos", "novecentos")


def spelt(n: Column) -> Column:
    """Portuguese words of 0 to 1999; null outside."""
    pick = lambda t, i: F.element_at(F.array(*map(F.lit, t)), (i + 1).cast("int"))
    rest = n % 1000
    small = rest % 100
    two = F.when(small < 20, pick(ONES, F.least(small, F.lit(19)))).when(small % 10 == 0, pick(TENS, F.floor(small / 10))).otherwise(F.concat_ws(" e ", pick(TENS, F.floor(small / 10)), pick(ONES, small % 10)))
    hundreds = F.when(rest == 100, "cem").otherwise(pick(HUNDREDS, F.floor(rest / 100)))
    below = F.when(rest < 100, two).when(small == 0, hundreds).otherwise(F.concat_ws(" e ", hundreds, two))
    joined = F.when((rest < 100) | (small == 0), " e ").otherwise(" ")
    return F.when(~n.between(0, 1999), None).when(n < 1000, below).when(rest == 0, "mil").otherwise(F.concat(F.lit("mil"), joined, below))


def city_state(c: Column) -> Column:
    """Struct (city, state) named in an address as ``..., City - ST``."""
    g = lambda i: F.nullif(F.regexp_extract(c, r",\s*([^,]+?)\s+-\s+([A-Z]{2})(?:,|$)", i), F.lit(""))
    return F.struct(g(1).alias("city"), g(2).alias("state"))


def door_number(c: Column) -> Column:
    """First number of a free address that isn't part of a postcode; null without one."""
    plain = F.regexp_replace(c, r"[0-9]{5}-?[0-9]{3}", " ")
    return F.try_element_at(F.regexp_extract_all(plain, F.lit(r"\b([0-9]{1,6})\b"), F.lit(1)), F.lit(1))


def house_number(c: Column) -> Column:
    """Struct (base, suffix, kind) of a house number: plain, none (S/N), range, km or other."""
    t = F.upper(F.trim(c))
    base = F.nullif(F.regexp_extract(t, "([0-9]+)", 1), F.lit("")).try_cast("bigint")
    kind = F.when(t.isNull() | t.rlike(r"^(S[/. ]?N[.º°]?|SN|0+|)$"), "none").when(t.rlike(r"^KM\s*[0-9]"), "km").when(t.rlike(r"^[0-9]+\s*(-|/|A|AO)\s*[0-9]+$"), "range").when(t.rlike(r"^[0-9]+\s*[A-Z]?$"), "plain").otherwise("other")
    suffix = F.nullif(F.regexp_extract(t, r"^[0-9]+\s*([A-Z])$", 1), F.lit(""))
    return F.struct(F.when(kind != "none", base).alias("base"), suffix.alias("suffix"), kind.alias("kind"))


#: Layers of a complement, from the whole to the part, and the words that stand for them (fixed values).
LAYERS = {
    "agrupamento": ("PREDIO", "EDIFICIO", "RESIDENCIAL", "QUADRA", "GALERIA", "PAVILHAO", "CONJUNTO", "GRUPO", "ALA"),
    "via_interna": ("ALAMEDA INTERNA", "RUA INTERNA", "AVENIDA INTERNA", "TRAVESSA INTERNA"),
    "bloco": ("BLOCO", "TORRE", "ENTRADA", "PORTAO"),
    "pavimento": ("ANDAR", "TERREO", "SUBSOLO", "COBERTURA", "SOBRELOJA", "LAJE", "PAVIMENTO"),
    "unidade": (
        "APARTAMENTO", "SALA", "LOJA", "QUITINETE", "QUARTO", "SUITE", "COMODO", "BOX", "BANCA", "BARRACA", "CABINE", "MODULO", "HABITACAO", "PECA", "PORTA",
        "DEPOSITO", "ARMAZEM", "SEDE", "GARAGEM", "CHALE", "HANGAR", "BARRACAO",
    ),
    "moradia": ("CASA", "LOTE", "SOBRADO", "SITIO", "CHACARA", "FAZENDA", "ESTANCIA", "GRANJA", "MANSAO", "CAIS"),
    "posicao": ("FUNDOS", "FRENTE", "LADO", "ANEXO", "DEPENDENCIA", "PORAO", "ESQ", "DIR", "MEIO", "LATERAL"),
}


def complement_layers(names: Column, contents: Column) -> Column:
    """Struct of a (kind, value) for each layer, from arrays of names and values; the first pair of a layer counts.

    So BLOCO A, APARTAMENTO 101 is the same whichever of the pairs hold it."""
    pairs = F.arrays_zip(names.alias("n"), contents.alias("v"))
    plain = F.transform(pairs, lambda p: F.struct(F.upper(F.trim(F.coalesce(p["n"], F.lit("")))).alias("kind"), F.trim(F.coalesce(p["v"].cast("string"), F.lit(""))).alias("value")))
    return F.struct(*[F.get(F.filter(plain, lambda p: p["kind"].isin(*known)), F.lit(0)).alias(layer) for layer, known in LAYERS.items()])  # noqa: B023


def complement_form(layers: Column) -> Column:
    """The filled layers of ``complement_layers`` in order, such as ``BLOCO A → APARTAMENTO 101``; empty without any."""
    return F.concat_ws(" → ", *[F.nullif(F.concat_ws(" ", layers[n]["kind"], F.nullif(layers[n]["value"], F.lit(""))), F.lit("")) for n in LAYERS])


def block_lot(number: Column, block: Column, lot: Column, house: Column) -> Column:
    """The number itself if positive, else a key such as Q15/L8/C3; null without any part."""
    part = lambda p, c: F.when(F.trim(c) != "", F.concat(F.lit(p), F.trim(c)))
    key = F.nullif(F.concat_ws("/", part("Q", block), part("L", lot), part("C", house)), F.lit(""))
    return F.when(number > 0, number.cast("string")).otherwise(key)


def tidy_street(c: Column) -> Column:
    """Without parentheses, a repeated type and trailing punctuation."""
    x = F.regexp_replace(F.lower(c), r"\([^)]*\)?", " ")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"[\s,.;:-]+$", ""))
    return F.regexp_replace(x, r"^(\w+) \1 ", "$1 ")


def _small_numerals() -> dict[str, str]:
    """The numerals up to twenty as digits."""
    return {w: str(n) for w, n in NUMERALS.items() if n <= 20}


def canonical_street(c: Column, hint: Column | None = None) -> Column:
    """Struct (kind, base, whole, nucleus, status) of a street name.

    The type comes from ``hint``, which is binding, else from the first word; titles and small numerals are
    spelt out or turned to digits wherever they stand; the nucleus lacks titles and particles."""
    w, kinds = words(c), lookup(ALL_TYPES)
    first = F.try_element_at(kinds, F.try_element_at(w, F.lit(1)))
    hinted = F.try_element_at(kinds, F.regexp_replace(F.trim(strip_accents(hint)), r"\.", "")) if hint is not None else F.lit(None).cast("string")
    kind = F.coalesce(hinted, first, F.lit(""))
    rest = F.when(first == kind, F.slice(w, 2, 1000)).otherwise(w)  # a first word of another type belongs to the name
    table = lookup(TITLES | _small_numerals())
    rest = F.transform(rest, lambda t: F.coalesce(F.try_element_at(table, t), t))
    base = F.array_join(rest, " ")
    nucleus = F.array_join(F.filter(rest, lambda t: ~t.isin(*NUCLEUS_STOP)), " ")
    status = F.when(base == "", "missing").when(F.length(base) < 3, "short").otherwise("valid")
    return F.struct(kind.alias("kind"), base.alias("base"), F.trim(F.concat_ws(" ", kind, base)).alias("whole"), nucleus.alias("nucleus"), status.alias("status"))


def contextual_street(c: Column) -> Column:
    """Struct (text, tier): a street name with its type spelt out once, a title spelt out only in its place (right
    after the type, or first without one, and before a name), and numerals as digits only in dates.

    Tiers: certain; high after a title, a repeated type or a date; review if a part in parentheses went; human if
    nothing is left.  Words that are also short forms of titles elsewhere stay."""
    kinds, titles, numerals = lookup(ALL_TYPES), lookup(TITLES), lookup(_small_numerals())

    def of(cut: Column, kind: Column, again: Column, named: Column, spelt_out: Column) -> Column:
        date = lambda i: (F.try_element_at(named, i + 2) == "de") & F.try_element_at(named, i + 3).isin(*MONTHS)
        dated = F.transform(named, lambda t, i: F.when(F.coalesce(date(i), F.lit(False)), F.coalesce(F.try_element_at(numerals, t), t)).otherwise(t))

        def result(dated: Column) -> Column:
            out = F.trim(F.concat_ws(" ", kind, F.array_join(dated, " ")))
            high = spelt_out.isNotNull() | (again > 0) | (dated != named)
            tier = F.when(out == "", "human").when(F.trim(cut) != F.trim(c), "review").when(high, "high").otherwise("certain")
            return F.struct(out.alias("text"), tier.alias("tier"))

        return let(dated, result)

    def titled(cut: Column, kind: Column, after: Column, again: Column) -> Column:
        head = F.try_element_at(after, F.lit(1))
        spelt_out = F.when((F.size(after) > 1) & ~head.isin(*HOMOGRAPHS), F.try_element_at(titles, head))
        named = lambda s: F.when(s.isNotNull(), F.concat(F.array(s), F.slice(after, 2, 1000))).otherwise(after)
        return let(spelt_out, lambda s: let(named(s), lambda n: of(cut, kind, again, n, s)))

    def typed(cut: Column, w: Column, kind: Column) -> Column:
        after = F.when(kind.isNotNull(), F.slice(w, 2, 1000)).otherwise(w)
        count = lambda a: F.when(kind.isNull(), F.lit(0)).otherwise(F.aggregate(a, F.lit(0), lambda n, t: F.when((n >= 0) & (F.try_element_at(kinds, t) == kind), n + 1).otherwise(F.when(n >= 0, -n - 1).otherwise(n)), lambda n: F.when(n < 0, -n - 1).otherwise(n)))
        return let(after, lambda a: let(count(a), lambda n: let(F.slice(a, n + 1, F.lit(1000)), lambda rest: titled(cut, kind, rest, n))))

    first = lambda w: F.try_element_at(kinds, F.try_element_at(w, F.lit(1)))
    return let(F.regexp_replace(c, r"\([^)]*\)?", " "), lambda cut: let(words(cut), lambda w: let(first(w), lambda kind: typed(cut, w, kind))))


def without_document(c: Column) -> Column:
    """A name without the document number glued to it."""
    return F.trim(F.regexp_replace(c, r"[0-9][0-9.\-/]{7,}", ""))


def mentions_address(c: Column, street_core_text: Column, number: Column, city: Column) -> Column:
    """A text holds the street, the number as a word of its own, and the city."""
    t = F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))
    has = lambda x: F.contains(t, F.concat(F.lit(" "), x, F.lit(" ")))
    return F.coalesce(has(street_core_text) & has(number) & has(norm_name(city)), F.lit(False))


def source_class(url: Column) -> Column:
    """Kind of a page by its host."""
    h = domain(url)
    return F.when(h == "", "platform").when(h.rlike(r"(^|\.)gov\."), "official").when(h.rlike(r"(cnpj|empresa|consulta)"), "registry").otherwise("own")


def same_shop(a: Column, b: Column) -> Column:
    """One name's words hold all of the other's."""
    x, y = tokens(a), tokens(b)
    return F.coalesce((F.least(F.size(x), F.size(y)) > 0) & (F.size(F.array_intersect(x, y)) == F.least(F.size(x), F.size(y))), F.lit(False))
