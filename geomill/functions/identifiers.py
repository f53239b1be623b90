"""Documents, codes, fingerprints and masking."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text


def check_digit(values: Column, weights: list[int]) -> Column:
    """Modulo-11 check digit of an array of digit values."""
    w = F.array(*map(F.lit, weights))
    rest = F.aggregate(F.zip_with(values, w, lambda v, k: v * k), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


def _values(c: Column, n: int) -> Column:
    """Values of the first n characters: code point less that of 0, so letters count too."""
    return F.transform(F.split(F.substring(c, 1, n), ""), lambda x: F.ascii(x) - 48)


COMPANY_WEIGHTS = ([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])
PERSON_WEIGHTS = (list(range(10, 1, -1)), list(range(11, 1, -1)))


def company_id(c: Column) -> Column:
    """Fourteen characters of a company number (letters and digits, last two digits), zero-filled; else null."""
    x = F.upper(F.regexp_replace(c, "[^0-9A-Za-z]", ""))
    x = F.when(x.rlike("^[0-9]{12,13}$"), F.lpad(x, 14, "0")).otherwise(x)
    return F.when(x.rlike("^[0-9A-Z]{12}[0-9]{2}$") & ~x.rlike(r"^(.)\1{13}$"), x)


def valid_company(c: Column) -> Column:
    x = company_id(c)
    one, two = check_digit(_values(x, 12), COMPANY_WEIGHTS[0]), check_digit(_values(x, 13), COMPANY_WEIGHTS[1])
    return F.coalesce(F.substring(x, 13, 2) == F.concat(one.cast("string"), two.cast("string")), F.lit(False))


def valid_person(c: Column) -> Column:
    x = F.lpad(text.digits(c), 11, "0")
    one, two = check_digit(_values(x, 9), PERSON_WEIGHTS[0]), check_digit(_values(x, 10), PERSON_WEIGHTS[1])
    usual = x.rlike("^[0-9]{11}$") & ~x.rlike(r"^(.)\1{10}$")
    return F.coalesce(usual & (F.substring(x, 10, 2) == F.concat(one.cast("string"), two.cast("string"))), F.lit(False))


def company_number(root: Column) -> Column:
    """Fourteen digits from a twelve-digit root, with its check digits."""
    r = F.lpad(root, 12, "0")
    one = check_digit(_values(r, 12), COMPANY_WEIGHTS[0]).cast("string")
    return F.concat(r, one, check_digit(_values(F.concat(r, one), 13), COMPANY_WEIGHTS[1]).cast("string"))


def activity_code(c: Column) -> Column:
    """Struct (code, division, shown) of a seven-digit activity code."""
    d = F.lpad(text.digits(c), 7, "0")
    shown = F.concat(F.substring(d, 1, 4), F.lit("-"), F.substring(d, 5, 1), F.lit("/"), F.substring(d, 6, 2))
    return F.when(F.length(text.digits(c)).between(1, 7), F.struct(d.alias("code"), F.substring(d, 1, 2).alias("division"), shown.alias("shown")))


def canonical(c: Column, aliases: dict[str, str]) -> Column:
    """The alias table's value for a text without accents or case; unknown texts stay as upper case."""
    key = F.trim(text.strip_accents(c))
    return F.coalesce(F.try_element_at(text.lookup(aliases), key), F.upper(key))


@F.pandas_udf(T.LongType())
def stable_id(keys: pd.Series) -> pd.Series:
    """Positive 63-bit id: the first eight bytes of BLAKE2b, halved; once for each different key of a batch."""
    made = {k: int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "big") >> 1 for k in keys.dropna().unique()}
    return keys.map(made).astype("Int64")


def fingerprint(*cols: str) -> Column:
    """sha256 over the columns as text, in order; null differs from empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]), 256)


def schema_fingerprint(df: DataFrame) -> str:
    return hashlib.sha256("|".join(sorted(df.columns)).encode()).hexdigest()


def semantic_hash(df: DataFrame, columns: list[str]) -> Column:
    """Aggregate column: an order-independent hash of the rows' fingerprints (64-bit sum of their leading digits)."""
    return F.sum(F.conv(F.substring(fingerprint(*columns), 1, 12), 16, 10).cast("decimal(38,0)")).cast("string")


def entity_key(*choices: tuple[str, Column]) -> Column:
    """The first filled identifier, with its kind in front."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.concat(F.lit(f"{kind}:"), F.trim(c))) for kind, c in choices])


def masked(c: Column, shown: int = 3) -> Column:
    return F.concat(F.substring(c, 1, shown), F.lit("***"))


def is_place_id(c: Column) -> Column:
    return F.coalesce((F.trim(c) != "") & ~F.contains(c, F.lit(":")), F.lit(False))
