"""Writers: partitioned sets, staged loads with reconciliation, exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], rows_a_file: int = 5_000_000) -> None:
    """Hive-style folders; rows of a partition are spread over files of a bounded size, not sent to one task."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).partitionBy(*by).parquet(path)


def load_staged(df: DataFrame, staging: str, target: str, expected: int | None = None) -> int:
    """Write to a staging folder, count, and only then replace the target; returns the rows."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(staging)
    done = spark.read.schema(df.schema).parquet(staging)
    n = done.count()
    if expected is not None and n != expected:
        raise ValueError(f"{n} rows were staged, {expected} expected")
    swap(spark, staging, target)
    return n


def swap(spark: SparkSession, new: str, target: str) -> None:
    """Put a written folder in the target's place by two renames; the old one is removed last."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = path(f"{target}.old")
    fs.delete(old, True)
    if fs.exists(path(target)) and not fs.rename(path(target), old):
        raise OSError(f"{target} can't be moved")
    if not fs.rename(path(new), path(target)):
        fs.rename(old, path(target))
        raise OSError(f"{new} can't be moved")
    fs.delete(old, True)


def mark_loaded(spark: SparkSession, ledger: str, source: str, reference: str, rows: int) -> None:
    """Append to the load ledger."""
    spark.createDataFrame([(source, reference, rows)], "source string, reference string, rows bigint").write.mode("append").parquet(ledger)


def geojson_features(df: DataFrame, id: str = "id", lat: str = "lat", lng: str = "lng") -> DataFrame:
    """One GeoJSON feature a row, as text."""
    rest = [c for c in df.columns if c not in (lat, lng)]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lng, lat).alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties"))
    return df.select(F.to_json(feature).alias("value"))


def kml_placemarks(df: DataFrame, name: str = "name", lat: str = "lat", lng: str = "lng") -> DataFrame:
    """One KML placemark a row, as text."""
    safe = F.replace(F.replace(F.replace(F.col(name), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return df.select(F.concat(F.lit("<Placemark><name>"), safe, F.lit("</name><Point><coordinates>"), F.col(lng).cast("string"), F.lit(","), F.col(lat).cast("string"), F.lit("</coordinates></Point></Placemark>")).alias("value"))


def field_list(df: DataFrame, street: Column, number: Column) -> DataFrame:
    """Rows in the order of a walk: by street, then by door as a number."""
    return df.orderBy(street, number.try_cast("int").asc_nulls_last(), *df.columns[:1])


def with_children(parents: DataFrame, children: DataFrame, key: str, name: str) -> DataFrame:
    """Parents with their children as a JSON array, ordered by all child columns."""
    cols = [c for c in children.columns if c != key]
    kids = children.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*cols)))).alias(name))
    return parents.join(kids, key, "left").withColumn(name, F.coalesce(name, F.lit("[]")))


def workbook(sheets: dict[str, tuple[Sequence[str], Sequence[Sequence]]]) -> bytes:
    """A workbook of sheets (columns, rows); texts that a program would take for formulas stay texts, as all cells are inline strings or numbers."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, int | float) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, (columns, rows) in enumerate(sheets.values(), 1):
            body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [columns, *rows])
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def book_number(columns: Sequence[str], books: Column) -> Column:
    """The number from 0 of a row's book: the first 32 bits of the MD5 of its filled columns as text, modulo ``books``."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in columns])), 1, 8), 16, 10).cast("long"), books).cast("int")


def workbooks(df: DataFrame, book: str, sheet: str, order: str, most: int = 100_000) -> DataFrame:
    """(path, content): a workbook for each value of ``book``, with a sheet for each value of ``sheet``, rows by ``order``.

    A book of more than ``most`` rows becomes several, numbered ones of about that size (``book_number``)."""
    sizes = df.groupBy(book).agg(F.ceil(F.count("*") / most).cast("int").alias("_books"))
    rows = df.join(sizes, book).withColumn("_book", book_number(df.columns, F.col("_books")))
    columns = [c for c in df.columns if c not in (book, sheet)]

    def make(p):
        import pandas as pd

        p = p.sort_values([sheet, order])
        name = f"{p[book].iloc[0]}.xlsx" if p["_books"].iloc[0] == 1 else f"{p[book].iloc[0]}-{p['_book'].iloc[0] + 1}.xlsx"
        sheets = {str(k): (columns, g[columns].astype(object).where(g[columns].notna(), None).values.tolist()) for k, g in p.groupby(sheet)}
        return pd.DataFrame({"path": [name], "content": [workbook(sheets)]})

    return rows.groupBy(book, "_book").applyInPandas(make, "path string, content binary")


def write_text(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)


def export_with_dictionary(df: DataFrame, path: str) -> DataFrame:
    """Write a source's rows as CSV with a header and, beside them, their dictionary, which is returned: (column, type, rows, filled, longest)."""
    export_csv(df, f"{path}/rows")
    filled = lambda c: F.trim(F.col(c).cast("string")) != ""
    one = df.agg(F.count("*").alias("_n"), *[f for c in df.columns for f in (F.count_if(filled(c)).alias(f"f_{c}"), F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)).alias(f"l_{c}"))])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("_n").alias("rows"), F.col(f"f_{c}").alias("filled"), F.col(f"l_{c}").alias("longest")) for c, t in df.dtypes])
    one.select(F.explode(each).alias("x")).select("x.*").write.mode("overwrite").parquet(f"{path}/dictionary")
    return df.sparkSession.read.parquet(f"{path}/dictionary")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV whose texts a spreadsheet won't take for formulas."""
    from geomill.functions.text import formula_safe

    safe = [formula_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.mode("overwrite").option("header", True).csv(path)
