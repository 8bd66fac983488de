"""Files in and out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import strip
from corpusmill.operators.topics import cluster_count
from corpusmill.session import cut_lineage

# What may be uploaded, and the separators that go with a suffix.
SUFFIXES = {".csv": ",", ".tsv": "\t", ".gz": ","}
BOM = "﻿"


def read_delimited(
    spark: SparkSession,
    path: str,
    columns: Mapping[str, str] | None = None,
    sep: str = ",",
    encoding: str = "UTF-8",
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
    bad: str | None = None,
) -> DataFrame:
    """CSV or TSV, plain or gzipped: the named columns only, under their new names.

    Without a schema every column is text; nothing is inferred, so the data is read once. A line that does
    not fit is an error; with ``bad``, it is a row whose column of that name has the whole line.
    """
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("ignoreLeadingWhiteSpace", True)
        .option("mode", "FAILFAST" if bad is None else "PERMISSIVE")
        .option("escape", '"')
        .option("multiLine", multi_line)
    )
    if bad is not None:
        given = reader.csv(path).schema if schema is None else T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        schema = T.StructType([*given.fields, T.StructField(bad, T.StringType())])
        reader = reader.option("columnNameOfCorruptRecord", bad)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    # A byte order mark sticks to the first column name.
    df = df.withColumnsRenamed({c: c.lstrip(BOM) for c in df.columns if c.startswith(BOM)})
    if columns:
        kept = [*columns, *([bad] if bad else [])]
        df = df.select([F.col(f"`{c}`") for c in kept]).withColumnsRenamed(dict(columns))
    return df


def read_json_docs(
    spark: SparkSession, path: str, schema: T.StructType | str, lines: bool = True, parse_meta: bool = False
) -> DataFrame:
    """JSON lines, or files that each hold one array. ``parse_meta`` turns the meta text into a map."""
    df = spark.read.schema(schema).option("multiLine", not lines).json(path)
    if parse_meta:
        df = df.withColumn("meta", F.from_json("meta", "map<string,string>"))
    return df


def write_docs(df: DataFrame, path: str, columns: Sequence[str] | None = None, ext: str = ".json") -> None:
    """JSON lines or CSV with the chosen columns."""
    chosen = df.select(*columns) if columns else df
    if ext == ".json":
        chosen.write.mode("error").json(path)
    elif ext == ".csv":
        chosen.write.mode("error").option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unsupported extension: {ext}")


@dataclass(frozen=True)
class Ingested:
    """Outcome of landing a file: its columns, or what is wrong with it."""

    suffix_ok: bool
    corrupted: bool
    columns: tuple[str, ...] = ()
    path: str | None = None


def ingest_parquet(spark: SparkSession, source: str, target: str, multi_line: bool = False) -> Ingested:
    """Land a delimited file as parquet. A row that does not fit its header marks the file as corrupt."""
    suffix = "." + source.rsplit(".", 1)[-1].lower()
    if suffix not in SUFFIXES:
        return Ingested(False, True)
    reader = (
        spark.read.option("header", True).option("sep", SUFFIXES[suffix]).option("escape", '"').option("multiLine", multi_line)
    )
    names = reader.csv(source).columns
    if not names:
        return Ingested(True, True)
    schema = T.StructType([T.StructField(n.lstrip(BOM), T.StringType()) for n in names] + [T.StructField("_bad", T.StringType())])
    rows = reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(source)
    # Checked beside the target, so a corrupt file leaves nothing there.
    landed = cut_lineage(rows)
    if landed.where(F.col("_bad").isNotNull()).limit(1).count():
        return Ingested(True, True)
    landed = landed.drop("_bad")
    landed.write.mode("error").parquet(target)
    return Ingested(True, False, tuple(landed.columns), target)


@dataclass(frozen=True)
class Roles:
    """Which columns hold the text and the time, and how many clusters to form."""

    text_ok: bool
    time_ok: bool
    clusters: int


def scan_with_roles(
    spark: SparkSession, path: str, text: str | None, time: str | None, clusters: int | None = None
) -> tuple[DataFrame, Roles]:
    """Open a parquet table lazily and check the columns named for text and time."""
    df = spark.read.parquet(path)
    return df, Roles(text in df.columns, time in df.columns, cluster_count(clusters))


def read_records(spark: SparkSession, path: str, sep: str = "\n") -> DataFrame:
    """The set of non-empty records of a text file, trimmed: (record)."""
    lines = spark.read.text(path, lineSep=sep).where(F.length("value") > 0)
    return lines.select(strip(F.col("value")).alias("record")).distinct()


def read_keyword_file(spark: SparkSession, path: str) -> DataFrame:
    """(line_no-ordered) ``keyword=>clean name`` or bare keywords: (ord, keyword, clean_name)."""
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    return keyword_lines(lines, "value", "ord")


def keyword_lines(lines: DataFrame, value: str, order: str) -> DataFrame:
    """Split dictionary lines that are already in a table."""
    parts = F.split(F.col(value), "=>", 2)
    keyword = strip(F.get(parts, 0))
    return lines.select(
        F.col(order).alias("ord"), keyword.alias("keyword"), F.coalesce(strip(F.get(parts, 1)), keyword).alias("clean_name")
    ).where(F.col("keyword") != "")


def snapshot_report(query: str, documents: DataFrame, text: str, vote: str, time: str) -> DataFrame:
    """Report of a search: query, document, user vote, time."""
    return documents.select(F.lit(query).alias("query"), F.col(text).alias("document"), F.col(vote).alias("score"), F.col(time).alias("timestamp"))


def save_documents(documents: DataFrame, path: str) -> None:
    """Store documents as a Parquet table with a folder for each value of their column ``index``."""
    documents.write.mode("overwrite").partitionBy("index").parquet(path)


def load_documents(spark: SparkSession, path: str, schema: T.StructType, index: str | None = None) -> DataFrame:
    """Stored documents, of one index only the files of its folder."""
    found = spark.read.schema(schema).parquet(path)
    return (found if index is None else found.where(F.col("index") == index)).select(*schema.names)


def replace_index(documents: DataFrame, path: str) -> None:
    """Put ``documents`` in the place of the stored ones of the same indexes; other indexes keep their files.

    The new rows may come from the store itself: they are written elsewhere before anything is replaced."""
    ready = cut_lineage(documents)
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("index").parquet(path)
