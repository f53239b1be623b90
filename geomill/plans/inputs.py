"""Inputs of the queries: the given tables, and points, names and addresses derived from them by integer arithmetic.

The derivations are SQL that Spark and DuckDB read alike, so a query and the SQL that checks it start from
the same rows.  Rows are dealt into quarters of 500 points and 5000 doors, each a box of 2 km with its own
streets, postcodes and phones, so pairs, groups and links grow with the tables and not with their square.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _pick(options: str, index: str, n: int) -> str:
    return f"split_part('{options}', ',', CAST(({index}) % {n} + 1 AS INT))"


def _word(n: str) -> str:
    """A word of three syllables for a number; 8000 different ones."""
    syllables = "ba,ce,di,fo,gu,ja,le,mi,no,pu,ra,se,ti,vo,xu,za,te,li,mo,du"
    part = lambda d: f"CAST(FLOOR(({n}) / {d}) AS BIGINT)"
    return f"concat({_pick(syllables, n, 20)}, {_pick(syllables, part(20), 20)}, {_pick(syllables, part(400), 20)})"


def _quarter(k: str, size: int) -> str:
    return f"CAST(FLOOR({k} / {size}) AS BIGINT)"


def _point(k: str, q: str) -> str:
    """A point in the box of quarter ``q``; boxes lie 0.03 degrees apart, 50 in a column."""
    return (
        f"CAST(-30 AS DOUBLE) + CAST(3000 * ({q} % 50) + ({k}*{k} + 7919*{k}) % 2003 AS DOUBLE) * CAST(0.00001 AS DOUBLE) AS lat, "
        f"CAST(-51.2 AS DOUBLE) + CAST(3000 * (CAST(FLOOR({q} / 50) AS BIGINT) % 600) + (3*{k}*{k} + 104729*{k} + 17) % 1999 AS DOUBLE) * CAST(0.00001 AS DOUBLE) AS lng"
    )


def _postcode(k: str, q: str, street: str) -> str:
    """Most postcodes of a quarter belong to one street (index ``street``), the last 20 to all."""
    place = f"CASE WHEN {k} % 7 < 4 THEN ({street}) * 7 + {k} % 7 ELSE 77 + {k} % 20 END"
    digits = f"lpad(CAST((({q} * 97 + {place}) * 7919) % 9999991 AS VARCHAR(10)), 7, '0')"
    return f"concat('9', substring({digits}, 1, 4), '-', substring({digits}, 5, 3))"


NAMES, SECOND, STREETS, KINDS = "Padaria,Mercado,Farmacia,Oficina,Salao,Loja,Bar", "Silva,Central,do Porto,Nova Era,Souza,Apolo,Bom Dia,Estrela,Uniao,Sol,Verde", "Rua Brasil,R. Quinze,Av. Central,Avenida Getulio,Travessa Sete,Rua das Flores,Rod. Sul,Rua Onze,Av Norte,Alameda Um,Rua Bahia", "comida,compras,saude,servico"
_PQ, _DQ = _quarter("c_custkey", 500), _quarter("o_orderkey", 5000)

POI = f"""
SELECT c_custkey AS id, {_point('c_custkey', _PQ)},
  concat({_pick(NAMES, 'c_custkey', 7)}, ' ', {_pick(SECOND, 'c_custkey * 5', 11)}, CASE WHEN c_custkey % 3 = 0 THEN concat(' ', {_word(_quarter('c_custkey', 50))}) ELSE '' END) AS name,
  CASE WHEN c_custkey % 17 = 0 THEN concat('Beco ', {_word(_quarter('c_custkey', 17))}) ELSE concat({_pick(STREETS, 'c_custkey * c_custkey', 11)}, ' ', {_word(_PQ)}) END AS street,
  CASE WHEN c_custkey % 10 = 7 THEN '' ELSE CAST((c_custkey * 3) % 22 + 1 AS VARCHAR(10)) END AS number,
  concat('(51) 3', CAST(1000000 + ({_PQ} * 700 + CASE WHEN c_custkey % 10 = 3 THEN 154 + c_custkey % 500 ELSE (c_custkey * 37) % 154 END) % 9000000 AS VARCHAR(10))) AS phone,
  CASE WHEN c_custkey % 4 = 0 THEN 'nan' ELSE concat('https://www.site', CAST({_PQ} * 60 + c_custkey % 60 AS VARCHAR(10)), '.com.br/p?x=1') END AS site,
  {_pick(KINDS, 'c_custkey', 4)} AS category,
  CASE WHEN c_custkey % 3 = 0 THEN concat('ChIJ', CAST(c_custkey AS VARCHAR(10))) ELSE concat('osm:', CAST(c_custkey AS VARCHAR(10))) END AS place,
  CAST(c_custkey % 5 AS INT) AS evidence, concat('src', CAST(c_custkey % 3 AS VARCHAR(10))) AS source,
  {_postcode('c_custkey', _PQ, '(c_custkey * c_custkey) % 11')} AS postcode,
  CAST(CASE WHEN c_custkey % 9 = 4 THEN c_nationkey ELSE {_PQ} % 25 END AS INT) AS city
FROM customer""".strip()

DOOR = f"""
SELECT o_orderkey AS id, {_point('o_orderkey', _DQ)}, concat({_pick(STREETS, 'o_orderkey', 11)}, ' ', {_word(_DQ)}) AS street,
  CAST(FLOOR((o_orderkey * 7) % 40 * 1.5) AS BIGINT) + 1 AS number, {_postcode('o_orderkey', _DQ, 'o_orderkey % 11')} AS postcode,
  CAST({_DQ} % 25 AS INT) AS city
FROM orders""".strip()

CTES = {"poi": POI, "door": DOOR}


class Tables:
    """t.customer, t.poi, ...: the tables of a data folder and the derived ones."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        if name in CTES:
            return self.sql(CTES[name])
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        """Run SQL over the given tables; {name} placeholders keep it free of the session's views."""
        used = {n: getattr(self, n) for n in TABLES if re.search(rf"\b{n}\b", text)}
        pattern = r"\b(FROM|JOIN)(\s+)(" + "|".join(used) + r")\b"
        return self.spark.sql(re.sub(pattern, r"\1\2{\3}", text, flags=re.I) if used else text, **used)


def with_ctes(sql: str) -> str:
    """The SQL with definitions of the derived tables it names."""
    need = [n for n in CTES if re.search(rf"\b{n}\b", sql)]
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in need)
    if not need:
        return sql
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {head}, {body[14:].lstrip()}"
    return f"WITH {head}, {body[5:].lstrip()}" if body[:5].upper() == "WITH " else f"WITH {head} {body}"
