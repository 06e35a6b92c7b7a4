"""Readers: CSV, JSON lines with rejects, text of unknown encoding, column-array JSON, spreadsheets, tables."""

from __future__ import annotations

import importlib.util
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import first_of, moment, number_with_commas
from .ooxml import BROKEN, document_text, read_sheets, workbook_text

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?$")
#: Fixed value: rows that one guarded table scan returns at most, as a page.
MOST_ROWS = 20_000
#: Encodings tried in turn for text of unknown encoding.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "latin-1")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, all columns as text unless a schema is given; a byte-order mark before the first name is dropped."""
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_jsonl(spark: SparkSession, path: str, schema: str, required: Sequence[str], text_field: str = "text") -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows (line, reason, detail)) of JSON lines.

    A line that is no object, lacks a required field (or has it null or empty), or whose text is blank
    is rejected with that reason, the first that holds. Blank lines are neither.
    """
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select(F.col("value").alias("line"), F.from_json("value", T.StructType.fromDDL(schema), {"mode": "PERMISSIVE"}).alias("row"), F.try_parse_json("value").alias("v"))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    missing = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"row.{c}").cast("string"), F.lit("")) == "", F.lit(c)) for c in required]))), ",")
    text = F.trim(F.coalesce(F.col(f"row.{text_field}"), F.lit("")))
    reason = F.when(~is_object, "not json").when(missing != "", "missing fields").when(text == "", "empty text")
    judged = parsed.withColumn("reason", reason).withColumn("detail", F.when(F.col("reason") == "missing fields", missing).otherwise(""))
    return judged.where("reason is null").select("row.*"), judged.where("reason is not null").select("line", "reason", "detail")


def decoded(content: bytes) -> str:
    for name in ENCODINGS:
        try:
            return content.decode(name)
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace")


def list_files(spark: SparkSession, path: str, endings: Sequence[str] | None = None, skip: str = r"/(~\$|\.)[^/]*$") -> DataFrame:
    """(path, length, content) of all files under path, sorted by path (case ignored) when shown; hidden and temporary ones are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(~F.col("path").rlike(skip))
    if endings:
        files = files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*[e.lower().lstrip(".") for e in endings]))
    return files.select("path", "length", "content")


def read_texts(spark: SparkSession, path: str, endings: Sequence[str] = ("txt", "md")) -> DataFrame:
    """(path, title, text) of text files, each decoded by the first encoding that fits; title is the name without its ending."""
    return extracted(list_files(spark, path, endings), lambda name, content: decoded(content))


def extracted(files: DataFrame, extract: Callable[[str, bytes], str]) -> DataFrame:
    """(path, title, text) of (path, content): extract turns a file's name and bytes into its text, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column("path").to_pylist()
            titles = [p.rsplit("/", 1)[-1].rsplit(".", 1)[0] for p in paths]
            texts = [extract(p, c.as_py() or b"") for p, c in zip(paths, b.column("content"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(titles), pa.array(texts, pa.string())], ["path", "title", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, title string, text string")


def office_text(name: str, content: bytes) -> str:
    """Text of a DOCX or XLSX file, or of a PDF by its library: an ImportError that names it where it isn't installed. Broken files have an empty text."""
    import io

    kind = name.rsplit(".", 1)[-1].lower()
    if kind in ("docx", "xlsx"):
        try:
            return {"docx": document_text, "xlsx": workbook_text}[kind](content)
        except BROKEN:
            return ""
    if kind != "pdf":
        return decoded(content)
    if importlib.util.find_spec("pypdf") is None:
        raise ImportError("reading .pdf needs pypdf")
    return "\n".join(page.extract_text() or "" for page in importlib.import_module("pypdf").PdfReader(io.BytesIO(content)).pages)


def read_column_arrays(df: DataFrame, column: str, fields: Mapping[str, str], time: str) -> DataFrame:
    """Rows of JSON of the form {"hourly": {"time": [...], "a": [...]}}: a row for each place of the arrays.

    fields: our name -> theirs. Shorter arrays give nulls; JSON that can't be read gives no rows.
    """
    arrays = ", ".join(f"`{theirs}`: array<string>" for theirs in [time, *fields.values()])
    parsed = df.select(F.from_json(column, f"hourly struct<{arrays}>").alias("j")).where("j.hourly is not null")
    zipped = parsed.select(F.explode(F.arrays_zip(*[F.col(f"j.hourly.{x}") for x in [time, *fields.values()]])).alias("r"))
    return zipped.select(moment(F.col(f"r.{time}")).alias("datetime"), *[number_with_commas(F.col(f"r.{theirs}")).alias(ours) for ours, theirs in fields.items()])


def read_excel(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A spreadsheet, or a folder of them, each read in a task; an empty table if there is none, or it is empty or broken."""
    return read_sheets(spark, path, schema)


def read_table(spark: SparkSession, name: str, order_by: str | None = None, limit: int = 1000) -> DataFrame:
    """The last rows of a catalog table by a column, nulls last; the name is checked, the limit clamped."""
    if not _NAME.match(name):
        raise ValueError(f"not a table name: {name!r}")
    df = spark.table(name)
    if order_by:
        if order_by not in df.columns:
            raise ValueError(f"{name} has no column {order_by!r}")
        df = df.orderBy(F.col(f"`{order_by}`").desc_nulls_last())
    return df.limit(max(1, min(int(limit), MOST_ROWS)))


def read_sql(spark: SparkSession, sql: str, **args) -> DataFrame:
    """Any SQL with bound parameters; errors are raised, not turned into an empty table."""
    return spark.sql(sql, args=args or None)


def read_jdbc(spark: SparkSession, url: str, name: str, *, key: str | None = None, low: int = 0, high: int = 0, parts: int = 8, fetch: int = 2000) -> DataFrame:
    """A table of an external database, in parallel by ranges of a numeric key if one is given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).option("fetchsize", fetch)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def first_not_empty(*tables: DataFrame) -> DataFrame:
    """The first table with a row; the last if none has any."""
    for t in tables[:-1]:
        if not t.isEmpty():
            return t
    return tables[-1]


def raw_rows(df: DataFrame, source_file: str, aliases: Mapping[str, Sequence[str]], moments: Sequence[str] = ("datetime",)) -> DataFrame:
    """Rows under fixed names: each the first present of its aliases as a number (or a moment), with source_file and raw_json."""

    def named(ours: str, theirs: Sequence[str]) -> Column:
        x = first_of(df, theirs)
        return (moment(x) if ours in moments else number_with_commas(x)).alias(ours)

    return df.select(*[named(o, t) for o, t in aliases.items()], F.lit(source_file).alias("source_file"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("raw_json"))


def typed_by_name(df: DataFrame, times: Sequence[str] = ("datetime", "_at", "_date", "date_")) -> DataFrame:
    """Columns named *_json as variants, columns whose name has a time word as moments; what can't be read becomes null."""
    out = []
    for f in df.schema.fields:
        c, low = F.col(f"`{f.name}`"), f.name.lower()
        if isinstance(f.dataType, T.StringType) and low.endswith("_json"):
            c = F.try_parse_json(F.trim(c))
        elif isinstance(f.dataType, T.StringType) and any(t in low for t in times):
            c = moment(c)
        out.append(c.alias(f.name))
    return df.select(*out)
