"""Money, numbers, dates and ages as column functions; the reference date is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column) -> Column:
    """Amount of a text with comma or point as decimal sign.

    With both signs the later one is decimal; a lone sign followed by exactly three digits, or one that
    repeats, separates thousands.
    """
    x = F.regexp_replace(c, r"[^0-9,.\-]", "")
    commas, points = F.length(x) - F.length(F.replace(x, F.lit(","))), F.length(x) - F.length(F.replace(x, F.lit(".")))
    plain = lambda y: F.replace(F.replace(y, F.lit(".")), F.lit(","), F.lit("."))
    english = F.replace(x, F.lit(","))
    both = F.when(F.length(F.substring_index(x, ",", -1)) < F.length(F.substring_index(x, ".", -1)), plain(x)).otherwise(english)
    thousands = F.regexp_replace(x, "[,.]", "")
    lone = F.when((commas + points > 1) | x.rlike(r"[,.][0-9]{3}$"), thousands).otherwise(F.replace(x, F.lit(","), F.lit(".")))
    return F.when((commas > 0) & (points > 0), both).otherwise(lone).try_cast("decimal(18,2)")


def lenient(c: Column) -> Column:
    """Number with decimal comma or point; null for junk."""
    return F.replace(F.trim(c), F.lit(","), F.lit(".")).try_cast("double")


def date_of(c: Column) -> Column:
    """Date of dd/mm/yyyy, yyyy-mm-dd, yyyymmdd or a spreadsheet's day number (20000 to 80000)."""
    serial = F.when(c.rlike("^[0-9]{5}$"), c.try_cast("int"))
    day = F.when(serial.between(20000, 80000), F.date_add(F.lit("1899-12-30").cast("date"), serial))
    part = lambda p, i: F.regexp_extract(c, p, i)
    br, eight = r"^\s*([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", r"^([0-9]{4})-?([0-9]{2})-?([0-9]{2})"
    made = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
    return F.coalesce(day, F.when(c.rlike(br), made(part(br, 3), part(br, 2), part(br, 1))), F.when(c.rlike(eight), made(part(eight, 1), part(eight, 2), part(eight, 3))))


def month_of(c: Column) -> Column:
    """First day of the month that a text begins with (yyyy-mm...)."""
    return F.when(c.rlike("^[0-9]{4}-[0-9]{2}"), F.concat(F.substring(c, 1, 7), F.lit("-01")).try_cast("date"))


def whole_months(since: Column, at: Column) -> Column:
    """Difference of the calendar months, whatever the days."""
    return (F.year(at) - F.year(since)) * 12 + F.month(at) - F.month(since)


# Units of age texts, longest spelling first, and their days.
AGE_UNITS = (("ano", 365), ("mes", 30), ("mês", 30), ("semana", 7), ("dia", 1), ("hora", 0), ("minuto", 0))


def age_days(c: Column) -> Column:
    """Days of a text such as ``5 meses atras`` or ``um ano atras``; null if not understood."""
    t = F.lower(F.trim(c))
    n = F.coalesce(F.nullif(F.regexp_extract(t, "([0-9]+)", 1), F.lit("")).try_cast("int"), F.when(t.rlike(r"\b(um|uma)\b"), 1))
    out = F.lit(None).cast("int")
    for unit, days in reversed(AGE_UNITS):
        out = F.when(F.contains(t, F.lit(unit)), n * days).otherwise(out)
    return F.when(t.startswith("hoje") | t.startswith("agora"), 0).otherwise(out)


def recency(months: Column, cutoff: int, weight: float = 1.0) -> Column:
    """Falls in a line from ``weight`` to 0 at the cut-off."""
    return F.when(months >= cutoff, 0.0).otherwise(F.round(weight * (1 - F.greatest(months, F.lit(0)) / F.lit(cutoff)), 3))


def years_active(since: Column, at: Column) -> Column:
    return F.greatest(F.round(F.datediff(at, since) / 365.25, 2), F.lit(0.0))


def local_period(c: Column, zone: str) -> Column:
    """Start of the local day of a UTC time, as UTC."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(c, zone)), zone)


# Portuguese month names by their first three letters.
MONTHS = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")


def snippet_date(c: Column) -> Column:
    """First date in a text: dd/mm/yyyy, yyyy-mm-dd, or ``12 de março de 2024``."""
    t = F.lower(c)
    day = F.nullif(F.regexp_extract(t, r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})", 1), F.lit(""))
    iso = F.nullif(F.regexp_extract(t, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit(""))
    long = r"([0-9]{1,2}) de ([a-zç]{3})[a-zç]* de ([0-9]{4})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(t, long, 2))
    spelt = F.when(month > 0, F.make_date(F.regexp_extract(t, long, 3).try_cast("int"), month.cast("int"), F.regexp_extract(t, long, 1).try_cast("int")))
    return F.coalesce(date_of(day), date_of(iso), spelt)
