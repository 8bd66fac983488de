"""Registry of queries and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import WHITESPACE
from corpusmill.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The given tables, and views derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return self.read("documents")

    @property
    def texts(self) -> DataFrame:
        """The documents, over all cores also where the file is one split: for work on the words."""
        return spread(self.documents, "doc_id")

    @property
    def events(self) -> DataFrame:
        return self.read("events")

    @property
    def labels(self) -> DataFrame:
        return self.read("labels")

    @property
    def embeddings(self) -> DataFrame:
        return self.read("embeddings")

    @property
    def appeals(self) -> DataFrame:
        """Documents with a time and a topic number."""
        events = self.events.select(F.col("event_id").alias("doc_id"), "ts")
        topic = F.expr("substr(source, 4)").cast("int")
        return self.texts.join(events, "doc_id").select("doc_id", "text", "ts", topic.alias("topic_id"), "lang", "source")

    @property
    def with_meta(self) -> DataFrame:
        """Documents with quality and toxic, which many of them lack."""
        return self.documents.join(self.labels, "doc_id", "left")

    @property
    def stored(self) -> DataFrame:
        """Documents as a store keeps them, one index per language."""
        d = self.documents
        meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
        return d.select(
            F.col("doc_id").cast("string").alias("id"),
            F.col("lang").alias("index"),
            F.col("text").alias("content"),
            F.lit("text").alias("content_type"),
            F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("vector_id"),
            F.col("source").alias("version"),
            meta.alias("meta"),
            F.col("doc_id").alias("ord"),
        )


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def r6(value: Column) -> Column:
    return F.round(value, 6)


def iso(time: str | Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# --- SQL pieces -----------------------------------------------------------------------------------

WS_SQL = "'" + WHITESPACE + "'"

APPEALS_SQL = (
    "appeals AS (SELECT d.doc_id, d.text, e.ts, CAST(substr(d.source, 4) AS INTEGER) AS topic_id, d.lang, d.source "
    "FROM documents d JOIN events e ON d.doc_id = e.event_id)"
)
WITH_META_SQL = "with_meta AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
STORED_SQL = (
    "stored AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang AS index, text AS content, 'text' AS content_type, "
    "'v' || CAST(doc_id AS VARCHAR) AS vector_id, source AS version, doc_id AS ord, lang, source FROM documents)"
)


def iso_sql(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f')"


def strip_sql(expression: str) -> str:
    return f"trim({expression}, {WS_SQL})"


def tokens_sql(expression: str) -> str:
    return f"string_split(replace(lower({strip_sql(expression)}), '_', ' '), ' ')"


def index_tokens_sql(expression: str) -> str:
    return f"[{strip_sql('x')} for x in {tokens_sql(expression)}]"


def list_sql(values: object) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def vocab_sql(expression: str, words: object = ()) -> str:
    tokens = f"regexp_extract_all(lower({expression}), '[\\pL\\pN_]{{2,}}')"
    return f"[x for x in {tokens} if x NOT IN {list_sql(words)}]" if words else tokens


# Stop words of the test texts, in several languages.
STOPWORDS = ("the", "of", "and", "in", "is", "on", "it", "with", "la", "le", "un", "une", "et", "des", "die", "der", "und", "el", "los", "que")
