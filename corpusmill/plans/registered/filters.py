"""The filter language over documents whose quality and toxic marks are often missing."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import filters as L
from corpusmill.plans.registered.registry import APPEALS_SQL, WITH_META_SQL, Tables, iso, iso_sql, query

_FIELDS = "doc_id, lang, source, n_chars, quality, toxic"


def _register(name: str, term: object, where: str) -> None:
    @query(name, f"WITH {WITH_META_SQL} SELECT {_FIELDS} FROM with_meta WHERE {where}")
    def run(t: Tables):
        return L.filter_documents(t.with_meta, term).select(*_FIELDS.split(", "))


_register("filter_eq", {"lang": {"$eq": "en"}}, "lang = 'en'")
_register("filter_ne", {"quality": {"$ne": 1}}, "quality IS NOT NULL AND quality <> 1")
_register("filter_in", {"source": {"$in": ["src1", "src5", "src12"]}}, "source IN ('src1', 'src5', 'src12')")
_register("filter_nin", {"toxic": {"$nin": [1, 7]}}, "toxic IS NOT NULL AND toxic NOT IN (1, 7)")
_register("filter_gt", {"n_chars": {"$gt": 900}}, "n_chars > 900")
_register("filter_gte", {"quality": {"$gte": 1}}, "quality >= 1")
_register("filter_lt", {"n_chars": {"$lt": 900}}, "n_chars < 900")
_register("filter_lte", {"toxic": {"$lte": 0}}, "toxic <= 0")
_register("filter_and", {"$and": {"lang": "en", "quality": {"$gte": 1}}}, "lang = 'en' AND quality IS NOT NULL AND quality >= 1")
_register(
    "filter_or",
    {"$or": {"lang": ["fr", "de"], "toxic": {"$eq": 1}}},
    "lang IN ('fr', 'de') OR (toxic IS NOT NULL AND toxic = 1)",
)
_register(
    "filter_not",
    {"$not": {"quality": 1, "lang": "en"}},
    "NOT ((quality IS NOT NULL AND quality = 1) OR lang = 'en')",
)
_register(
    "filter_nested",
    {
        "n_chars": {"$gte": 200, "$lt": 5000},
        "$or": {"lang": ["en", "fr"], "$not": {"toxic": {"$in": [0, 1]}}},
        "$and": {"source": {"$ne": "src3"}},
    },
    "n_chars >= 200 AND n_chars < 5000 AND (lang IN ('en', 'fr') OR NOT (toxic IS NOT NULL AND toxic IN (0, 1))) "
    "AND source <> 'src3'",
)
_register(
    "filter_list_form",
    {"$or": [{"$and": {"lang": "en", "quality": 1}}, {"source": "src2", "toxic": 1}]},
    "(lang = 'en' AND quality IS NOT NULL AND quality = 1) OR source = 'src2' OR (toxic IS NOT NULL AND toxic = 1)",
)


@query(
    "filter_eq_list",
    f"WITH {WITH_META_SQL} SELECT doc_id FROM with_meta WHERE [lang, CAST(quality AS VARCHAR)] = ['en', '1']",
)
def filter_eq_list(t: Tables):
    pair = F.array("lang", F.col("quality").cast("string"))
    return L.filter_documents(t.with_meta.withColumn("pair", pair), {"pair": {"$eq": ["en", "1"]}}).select("doc_id")


@query(
    "filter_in_per_key",
    "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src3')",
)
def filter_in_per_key(t: Tables):
    d = t.documents
    meta = d.select("doc_id", F.explode(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))).alias("name", "value"))
    wanted = {"lang": ["en", "fr"], "source": ["src1", "src2", "src3"]}
    return L.filter_in_per_key(d, meta, wanted, "doc_id").select("doc_id", "lang", "source")


@query(
    "filter_nulls_blank",
    f"WITH {WITH_META_SQL} SELECT doc_id, quality FROM with_meta WHERE quality IS NOT NULL AND text IS NOT NULL AND trim(text) <> ''",
)
def filter_nulls_blank(t: Tables):
    return L.drop_blank(L.drop_nulls(t.with_meta, "text", "quality"), "text").select("doc_id", "quality")


@query(
    "filter_date_bound",
    f"WITH {APPEALS_SQL} SELECT doc_id, topic_id, {iso_sql('ts')} AS ts FROM appeals "
    "WHERE ts BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-20 00:00:00' AND topic_id = 5",
)
def filter_date_bound(t: Tables):
    low, high = (F.to_timestamp_ntz(F.lit(d)) for d in ("2024-01-01 06:00:00", "2024-01-20 00:00:00"))
    found = t.appeals.where(F.col("ts").between(low, high))
    return L.within_dates(found, "ts", topic_col="topic_id", topic=5).select("doc_id", "topic_id", iso("ts").alias("ts"))


@query(
    "filter_in_table",
    f"WITH {WITH_META_SQL}, good AS (SELECT doc_id FROM labels WHERE quality = 1), frequent AS (SELECT source FROM documents GROUP BY source HAVING count(*) > 10) "
    f"SELECT {_FIELDS} FROM with_meta WHERE (doc_id IN (SELECT doc_id FROM good) OR lang = 'fr') AND NOT (source NOT IN (SELECT source FROM frequent) OR toxic = 1 AND toxic IS NOT NULL)",
)
def filter_in_table(t: Tables):
    """Lists that are tables, under $or and $not."""
    good = t.labels.where("quality = 1").select("doc_id")
    frequent = t.documents.groupBy("source").count().where("count > 10").select("source")
    term = {"$or": {"doc_id": {"$in": good}, "lang": "fr"}, "$not": {"source": {"$nin": frequent}, "toxic": 1}}
    return L.filter_documents(t.with_meta, term).select(*_FIELDS.split(", "))
