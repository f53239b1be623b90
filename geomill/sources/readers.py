"""Readers: raw CSV, spreadsheets, CSV in archives, aliased columns, layouts of several generations, JSON, GeoJSON, tabular HTML."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree.ElementTree import iterparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geomill.functions.text import column_name


def sniff(sample: str) -> str:
    """Delimiter of a CSV sample."""
    try:
        return csv.Sniffer().sniff(sample, delimiters=",;\t|").delimiter
    except csv.Error:
        return max(",;\t|", key=sample.count)


def peek(spark: SparkSession, path: str, lines: int = 5) -> tuple[str, list[str], list[list[str]]]:
    """(delimiter, columns, first rows) from the first lines of a text file, read by Spark so that any store will do."""
    head = [r[0] for r in spark.read.text(path).limit(lines + 1).collect()]
    sep = sniff("\n".join(head))
    rows = list(csv.reader(head, delimiter=sep))
    return sep, rows[0] if rows else [], rows[1:]


def clean_names(df: DataFrame) -> DataFrame:
    used: set[str] = set()
    return df.toDF(*[column_name(c, used) for c in df.columns])


def read_raw_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", quote: str = '"', header: bool = True) -> DataFrame:
    """All columns as text; zero characters are removed, broken lines kept in ``_corrupt``."""
    df = spark.read.csv(path, sep=sep, encoding=encoding, quote=quote, header=header, inferSchema=False, mode="PERMISSIVE")
    return clean_names(df.select(*[F.replace(F.col(f"`{c}`"), F.lit("\x00"), F.lit("")).alias(c) for c in df.columns]))


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ";", encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, encoding=encoding, header=header, mode="PERMISSIVE")


def member_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField("member", T.StringType())] + [T.StructField(c, T.StringType()) for c in columns])


def unzipper(columns: Sequence[str], sep: str, encoding: str, rows_a_batch: int):
    """A function for mapInArrow over archives' contents: rows of their CSV members, only these columns, as a stream."""
    schema = member_schema(columns)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as z:
                    for name in sorted(n for n in z.namelist() if n.lower().endswith((".csv", ".txt"))):
                        with z.open(name) as raw:
                            reader = csv.DictReader(io.TextIOWrapper(raw, encoding=encoding, newline=""), delimiter=sep)
                            held = []
                            for row in reader:
                                held.append([name, *[(row.get(c) or "").replace("\x00", "") or None for c in columns]])
                                if len(held) == rows_a_batch:
                                    yield _batch(held, schema)
                                    held = []
                            if held:
                                yield _batch(held, schema)

    return unpack


def read_zipped_csv(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ";", encoding: str = "UTF-8", rows_a_batch: int = 20_000) -> DataFrame:
    """(member, the named columns) of every CSV in ZIP files; a task unpacks one file after another."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("content").mapInArrow(unzipper(columns, sep, encoding, rows_a_batch), member_schema(columns))


def _batch(rows: list[list[str | None]], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=schema.names)


_TAG = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(book: zipfile.ZipFile) -> Iterator[tuple[str, int, dict[int, str]]]:
    """(sheet file, row number, cells by column) of a workbook's sheets, read as a stream."""
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            for _, e in iterparse(f):
                if e.tag == f"{_TAG}si":
                    shared.append("".join(t.text or "" for t in e.iter(f"{_TAG}t")))
                    e.clear()
    for name in sorted(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
        with book.open(name) as f:
            row = 0
            for _, e in iterparse(f):
                if e.tag != f"{_TAG}row":
                    continue
                row, cells, at = int(e.get("r", row + 1)), {}, 0
                for c in e.iter(f"{_TAG}c"):
                    letters = re.match("[A-Z]*", c.get("r", ""))[0]
                    at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) if letters else at + 1
                    v = c.find(f"{_TAG}v")
                    raw = "".join(t.text or "" for t in c.iter(f"{_TAG}t")) if c.get("t") == "inlineStr" else v.text if v is not None else None
                    if raw:
                        cells[at] = shared[int(raw)] if c.get("t") == "s" else raw
                yield name, row, cells
                e.clear()


def read_workbooks(files: DataFrame, wanted: dict[str, Sequence[str]], rows_a_batch: int = 20_000) -> DataFrame:
    """(path, sheet, row, the wanted columns as text) of workbooks (path, content), as ``binaryFile`` gives them.

    A sheet's first filled row is its header; a wanted column is found by its name or a synonym, whatever the
    case and the accents, and is null in sheets without it.  Workbooks that aren't ZIP files give no rows."""
    import unicodedata

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("sheet", T.StringType()), T.StructField("row", T.LongType())] + [T.StructField(c, T.StringType()) for c in wanted])
    plain = lambda x: "".join(c for c in unicodedata.normalize("NFD", x.strip().lower()) if not unicodedata.combining(c))
    names = {plain(n): k for k, v in wanted.items() for n in (k, *v)}

    def batch(rows: list[list]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if f.name == "row" else pa.string()) for c, f in zip(cols, schema.fields, strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not content.is_valid or not zipfile.is_zipfile(io.BytesIO(content.as_buffer())):
                    continue
                held, header, sheet = [], {}, None
                for name, row, cells in sheet_rows(zipfile.ZipFile(io.BytesIO(content.as_buffer()))):
                    if name != sheet:
                        header, sheet = {}, name
                    if not header:
                        header = {names[plain(v)]: i for i, v in cells.items() if plain(v) in names}
                        continue
                    held.append([path, name.rsplit("/", 1)[-1].removesuffix(".xml"), row, *[cells.get(header.get(c, 0)) for c in wanted]])
                    if len(held) == rows_a_batch:
                        yield batch(held)
                        held = []
                if held:
                    yield batch(held)

    return files.select("path", "content").mapInArrow(run, schema)


def coordinate_text(c: Column) -> Column:
    """Struct (lat, lng) from texts such as ``-29.91, -51.18``; null if there aren't two decimal numbers."""
    pair = r"(-?[0-9]+\.[0-9]+)\s*[,;]\s*(-?[0-9]+\.[0-9]+)"
    lat, lng = (F.regexp_extract(c, pair, i) for i in (1, 2))
    return F.when(lat != "", F.struct(lat.cast("double").alias("lat"), lng.cast("double").alias("lng")))


def with_aliases(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Canonical columns from the first filled synonym; missing ones are null."""
    have = {c.lower(): c for c in df.columns}

    def one(name: str, others: Sequence[str]) -> Column:
        found = [F.col(f"`{have[c.lower()]}`") for c in (name, *others) if c.lower() in have]
        return (F.coalesce(*found) if found else F.lit(None).cast("string")).alias(name)

    return df.select(*[one(k, v) for k, v in aliases.items()])


def reconcile(layouts: Sequence[DataFrame], aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Union of several generations of a layout under canonical names; unmapped columns go to the JSON column extras."""
    out = None
    for df in layouts:
        used = {c.lower() for k, v in aliases.items() for c in (k, *v)}
        rest = [c for c in df.columns if c.lower() not in used]
        extras = F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in rest])) if rest else F.lit(None).cast("string")
        part = with_aliases(df.withColumn("_extras", extras), aliases | {"extras": ["_extras"]})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def common_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Narrow projection: the wanted columns with their types, null where the source lacks them."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


def in_area(df: DataFrame, south: float, north: float, west: float, east: float, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Rows inside a box; the bounds reach the Parquet scan."""
    return df.filter(F.col(lat).between(south, north) & F.col(lng).between(west, east))


def file_counts(df: DataFrame) -> DataFrame:
    """(file, n): rows of each file, to find the dense ones."""
    return df.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.count("*").alias("n"))


def read_geojson(spark: SparkSession, path: str, name: str = "name") -> DataFrame:
    """(name, ring) of the first rings of polygon features."""
    geometry = "struct<type:string,coordinates:array<array<array<double>>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"features array<struct<properties:map<string,string>,geometry:{geometry}>>").alias("d"))
    f = doc.select(F.explode("d.features").alias("f")).filter("f.geometry.type = 'Polygon'")
    ring = F.transform(F.col("f.geometry.coordinates")[0], lambda p: F.struct(p[1].alias("lat"), p[0].alias("lng")))
    return f.select(F.col("f.properties")[name].alias("name"), ring.alias("ring"))


def nested_places(df: DataFrame) -> DataFrame:
    """Flat rows from nested place records (id, names, addresses, categories, websites, phones, lat, lng)."""
    get = lambda c: F.get(F.col(c), F.lit(0))
    return df.select("id", F.col("names.primary").alias("name"), get("addresses")["freeform"].alias("address"), get("addresses")["locality"].alias("city"), F.array_join("categories", ";").alias("categories"), get("websites").alias("site"), get("phones").alias("phone"), "lat", "lng")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines of a declared schema that have coordinates."""
    return spark.read.schema(schema).json(path).filter("lat IS NOT NULL AND lng IS NOT NULL")


def html_tables(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """(id, row, cells): the table rows of web pages."""
    rows = F.regexp_extract_all(html, F.lit("(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(F.regexp_extract_all(F.col("r"), F.lit("(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", "")))
    return pages.select(id, F.posexplode(rows).alias("row", "r")).select(id, "row", cells.alias("cells")).filter(F.size("cells") > 0)
