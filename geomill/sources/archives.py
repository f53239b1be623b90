"""CSV members of ZIP archives as a Spark data source: one partition a member, chosen by its header, only the wanted columns.

The driver reads the archives' central directories.  A task opens one member as a stream, finds the
wanted columns by their names or synonyms in its header (case and accents don't matter), and lets the CSV
reader parse those columns only.  A member that lacks a required column gives no rows, so readme files and
other tables in an archive are passed over.  Paths may be of any store that pyarrow knows.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .maps import files_of, opened


def plain(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", name.strip().strip('"').lower()) if not unicodedata.combining(c))


class Member(InputPartition):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.columns: dict[str, list[str]] = json.loads(options["columns"])
        self.required = json.loads(options.get("required", "null"))
        self.names = json.loads(options.get("names", "null"))
        self.encoding, self.sep, self.pattern = options.get("encoding", "utf-8"), options.get("sep", ";"), options.get("members", r"(?i)\.(csv|txt)$")

    def partitions(self) -> list[Member]:
        out = []
        for path in files_of(self.path, ".zip"):
            fs, p = opened(path)
            with fs.open_input_file(p) as f, zipfile.ZipFile(f) as z:
                out += [Member(path, i.filename) for i in sorted(z.infolist(), key=lambda i: i.filename) if not i.is_dir() and re.search(self.pattern, i.filename)]
        return out or [Member("", "")]

    def header(self, names: Sequence[str]) -> dict[str, str]:
        """Column -> the member's name for it."""
        there = {}
        for n in names:
            there.setdefault(plain(n), n)
        return {c: there[k] for c, others in self.columns.items() if (k := next((plain(x) for x in (c, *others) if plain(x) in there), None))}

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, p = opened(partition.path)
        with fs.open_input_file(p) as f, zipfile.ZipFile(f) as z:
            names = self.names
            if names is None:
                with z.open(partition.name) as m:
                    first = m.readline().decode(self.encoding, "replace").lstrip("﻿").rstrip("\r\n")
                names = [x.strip().strip('"') for x in first.split(self.sep)]
            found = self.header(names)
            if not found or any(c not in found for c in (self.columns if self.required is None else self.required)):
                return
            with z.open(partition.name) as m:
                # names are given, so the header is a line to skip; broken lines are left out
                read = pacsv.ReadOptions(column_names=names, skip_rows=0 if self.names is not None else 1, encoding=self.encoding, block_size=4 << 20)
                convert = pacsv.ConvertOptions(include_columns=list(dict.fromkeys(found.values())), column_types={n: pa.string() for n in names}, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=True)
                parse = pacsv.ParseOptions(delimiter=self.sep, newlines_in_values=True, invalid_row_handler=lambda _: "skip")
                try:
                    stream = pacsv.open_csv(m, read, parse, convert)
                except pa.ArrowInvalid as e:
                    if "Empty CSV" in str(e):
                        return
                    raise
                where = partition.path.rsplit("/", 1)[-1]
                for b in stream:
                    n = b.num_rows
                    data = [b.column(b.schema.get_field_index(found[c])) if c in found else pa.nulls(n, pa.string()) for c in self.columns]
                    yield pa.RecordBatch.from_arrays([pa.array([where] * n, pa.string()), pa.array([partition.name] * n, pa.string()), *data], names=["archive", "member", *self.columns])


class ArchiveSource(DataSource):
    """Options: ``columns`` (JSON: column -> synonyms), ``required`` (JSON list; default: all), ``names`` (JSON list, for members without a header), ``members`` (pattern), ``sep``, ``encoding``."""

    @classmethod
    def name(cls) -> str:
        return "zippedcsv"

    def schema(self) -> str:
        return ", ".join(["archive string", "member string", *[f"`{c}` string" for c in json.loads(self.options["columns"])]])

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, columns: dict[str, Sequence[str]] | Sequence[str], required: Sequence[str] | None = None, names: Sequence[str] | None = None, **options: str) -> DataFrame:
    """(archive, member, the columns as text) of the members of ZIP archives that hold the required columns (default: all)."""
    spark.dataSource.register(ArchiveSource)
    wanted = dict(columns) if isinstance(columns, dict) else {c: [] for c in columns}
    r = spark.read.format("zippedcsv").option("columns", json.dumps({k: list(v) for k, v in wanted.items()}))
    if required is not None:
        r = r.option("required", json.dumps(list(required)))
    if names is not None:
        r = r.option("names", json.dumps(list(names)))
    return r.options(**options).load(path)


def write_archives(lines: DataFrame, path: str) -> int:
    """Write rows (archive, member, at, line) as ZIP archives of text members, lines by ``at``; returns the lines written.

    An archive is written by one task, line by line, whatever its size; a repeated task replaces its file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, p = opened(path)
        fs.create_dir(p)
        n, archive, member, z, m, out, temporary = 0, None, None, None, None, None, ""

        def close() -> None:
            if m is not None:
                m.close()
            if z is not None:
                z.close()
                out.close()
                fs.move(temporary, f"{p}/{archive}")

        for b in batches:
            for a, name, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if a != archive:
                    close()
                    archive, member, m, temporary = a, None, None, f"{p}/{a}.{TaskContext.get().taskAttemptId()}"
                    out = fs.open_output_stream(temporary)
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                if name != member:
                    if m is not None:
                        m.close()
                    member, m = name, z.open(name, "w", force_zip64=True)
                m.write((line + "\n").encode())
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    rows = lines.repartition("archive").sortWithinPartitions("archive", "member", "at").select("archive", "member", "line")
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
