"""Lexical search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import blockmax
from corpusmill.operators import bm25 as B
from corpusmill.plans.analysis import topic_examples as examples_of_topic
from corpusmill.plans.registered.registry import APPEALS_SQL, ORACLE, Tables, index_tokens_sql, iso, iso_sql, list_sql, query, r6
from corpusmill.session import scratch_folder

TERMS = ["the", "with", "that", "la", "the", "thin"]
# The dialogue prefixes of the test texts.
PREFIXES = ["user:", "assistant:", "system:", "tool:"]

_CORPUS = (
    f"corpus AS MATERIALIZED (SELECT doc_id, {index_tokens_sql('text')} AS tk FROM documents), "
    "tokens AS (SELECT doc_id, unnest(tk) AS token FROM corpus), "
    "lens AS (SELECT doc_id, len(tk) AS dl FROM corpus), "
    "post AS (SELECT doc_id, token, count(*) AS tf FROM tokens GROUP BY 1, 2), "
    "freq AS MATERIALIZED (SELECT token, count(*) AS df FROM post GROUP BY 1), "
    "tot AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(dl) AS mean_len FROM lens)"
)
_QUERY = "q AS (SELECT token, count(*) AS w FROM (SELECT unnest([" + ", ".join(f"'{x}'" for x in TERMS) + "]) AS token) GROUP BY 1)"
_OKAPI = (
    "raw AS MATERIALIZED (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS x FROM freq, tot), "
    "idf AS (SELECT token, df, CASE WHEN x < 0 THEN 0.25 * (SELECT avg(x) FROM raw) ELSE x END AS idf FROM raw)"
)
_SCORED = (
    "hit AS (SELECT doc_id, sum(w * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean_len))) AS s "
    "FROM post JOIN q USING (token) JOIN idf USING (token) JOIN lens USING (doc_id), tot GROUP BY doc_id), "
    "scored AS (SELECT doc_id, coalesce(s, 0) AS score FROM lens LEFT JOIN hit USING (doc_id))"
)


@query("inverted_index", f"WITH {_CORPUS} SELECT token, doc_id, tf, dl AS doc_len FROM post JOIN lens USING (doc_id)")
def inverted_index(t: Tables):
    return B.inverted_index(t.texts, "doc_id", "text").select("token", "doc_id", "tf", "doc_len")


@query(
    "corpus_stats",
    f"WITH {_CORPUS} SELECT CAST(count(*) AS BIGINT) AS doc_count, CAST(sum(dl) AS BIGINT) AS token_count, round(avg(dl), 6) AS mean_len, "
    "(SELECT count(*) FROM freq) AS vocabulary, (SELECT max(df) FROM freq) AS top_df FROM lens",
)
def corpus_stats(t: Tables):
    frequency = B.document_frequency(t.texts, "text").agg(F.count(F.lit(1)).alias("vocabulary"), F.max("df").alias("top_df"))
    totals = B.corpus_totals(t.texts, "text")
    vocabulary = frequency.select(F.struct("vocabulary", "top_df")).scalar()
    return totals.withColumn("_v", vocabulary).select(
        "doc_count", "token_count", r6(F.col("mean_len")).alias("mean_len"), F.col("_v.vocabulary"), F.col("_v.top_df")
    )


@query("idf_okapi", f"WITH {_CORPUS}, {_OKAPI} SELECT token, df, round(idf, 6) AS idf FROM idf")
def idf_okapi(t: Tables):
    n = B.corpus_totals(t.texts, "text").select(F.col("doc_count").cast("double")).scalar()
    return B.idf_okapi(B.document_frequency(t.texts, "text"), n).withColumn("idf", r6(F.col("idf")))


@query("idf_bm25l", f"WITH {_CORPUS} SELECT token, df, round(ln(n + 1) - ln(df + 0.5), 6) AS idf FROM freq, tot")
def idf_bm25l(t: Tables):
    n = B.corpus_totals(t.texts, "text").select(F.col("doc_count").cast("double")).scalar()
    return B.idf_plus(B.document_frequency(t.texts, "text"), n).withColumn("idf", r6(F.col("idf")))


@query("bm25_okapi_score", f"WITH {_CORPUS}, {_QUERY}, {_OKAPI}, {_SCORED} SELECT doc_id, round(score, 6) AS score FROM scored")
def bm25_okapi_score(t: Tables):
    return B.score(t.texts, "text", TERMS).select("doc_id", r6(F.col("score")).alias("score"))


@query(
    "bm25l_score",
    f"WITH {_CORPUS}, {_QUERY}, f AS (SELECT q.token, q.w, ln(n + 1) - ln(df + 0.5) AS idf FROM q JOIN freq USING (token), tot), "
    "g AS (SELECT lens.doc_id, f.token, w, idf, coalesce(tf, 0) / (0.25 + 0.75 * dl / mean_len) + 0.5 AS c "
    "FROM tot, lens CROSS JOIN f LEFT JOIN post ON post.doc_id = lens.doc_id AND post.token = f.token) "
    "SELECT doc_id, round(sum(w * idf * 2.5 * c / (1.5 + c)), 6) AS score FROM g GROUP BY doc_id",
)
def bm25l_score(t: Tables):
    return B.score(t.texts, "text", TERMS, B.Plus()).select("doc_id", r6(F.col("score")).alias("score"))


@query(
    "bm25_top_k",
    f"WITH {APPEALS_SQL}, {_CORPUS}, {_QUERY}, {_OKAPI}, {_SCORED}, "
    "best AS (SELECT * FROM scored ORDER BY round(score, 9) DESC, doc_id LIMIT 100) "
    f"SELECT doc_id, topic_id, {iso_sql('ts')} AS ts, round(score, 6) AS score FROM best JOIN appeals USING (doc_id) "
    "WHERE topic_id IN (1, 2, 3, 5, 8, 13) AND ts >= TIMESTAMP '2024-01-01 02:00:00' AND ts <= TIMESTAMP '2024-01-28 00:00:00'",
)
def bm25_top_k(t: Tables):
    low, high = (F.to_timestamp_ntz(F.lit(d)) for d in ("2024-01-01 02:00:00", "2024-01-28 00:00:00"))
    found = B.top_k(t.appeals, "doc_id", "text", TERMS, "ts", 100, "topic_id", [1, 2, 3, 5, 8, 13], low, high)
    return found.select("doc_id", "topic_id", iso("ts").alias("ts"), r6(F.col("score")).alias("score"))


def _stored_index(t: Tables, docs: DataFrame) -> B.SearchIndex:
    folder = scratch_folder(t.spark, "index")
    B.save_index(B.build_index(docs, "doc_id", "text"), folder)
    return B.load_index(t.spark, folder, "doc_id")


@query(
    "bm25_stored_index",
    f"WITH {_CORPUS}, {_QUERY}, {_OKAPI}, {_SCORED} SELECT doc_id, round(score, 6) AS score FROM scored WHERE doc_id IN (SELECT doc_id FROM hit)",
)
def bm25_stored_index(t: Tables):
    return B.score_with_index(_stored_index(t, t.texts), TERMS).select("doc_id", r6(F.col("score")).alias("score"))


@query("bm25_top_k_index", ORACLE["bm25_top_k"])
def bm25_top_k_index(t: Tables):
    """The same as bm25_top_k, from a stored index."""
    low, high = (F.to_timestamp_ntz(F.lit(d)) for d in ("2024-01-01 02:00:00", "2024-01-28 00:00:00"))
    found = B.top_k_with_index(_stored_index(t, t.appeals), t.appeals, TERMS, "ts", 100, "topic_id", [1, 2, 3, 5, 8, 13], low, high)
    return found.select("doc_id", "topic_id", iso("ts").alias("ts"), r6(F.col("score")).alias("score"))


def _block_index(t: Tables, docs: DataFrame) -> blockmax.BlockIndex:
    folder = scratch_folder(t.spark, "blocks")
    blockmax.save_block_index(docs, "doc_id", "text", folder, block_docs=64)
    return blockmax.load_block_index(t.spark, folder, "doc_id")


@query("bm25_top_k_blocks", ORACLE["bm25_top_k"])
def bm25_top_k_blocks(t: Tables):
    """The same as bm25_top_k, reading only the blocks of the index that can hold one of the best."""
    low, high = (F.to_timestamp_ntz(F.lit(d)) for d in ("2024-01-01 02:00:00", "2024-01-28 00:00:00"))
    found = blockmax.top_k_by_blocks(_block_index(t, t.appeals), t.appeals, TERMS, "ts", 100, "topic_id", [1, 2, 3, 5, 8, 13], low, high)
    return found.select("doc_id", "topic_id", iso("ts").alias("ts"), r6(F.col("score")).alias("score"))


_PROBABILISTIC = (
    "sums AS (SELECT doc_id, sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_len))) AS score, "
    "count(DISTINCT token) AS terms FROM post JOIN q USING (token) JOIN freq USING (token) JOIN lens USING (doc_id), tot GROUP BY doc_id)"
)


@query(
    "search_prefilter",
    f"WITH {_CORPUS}, {_QUERY}, {_PROBABILISTIC} SELECT doc_id, round(score, 6) AS score FROM sums JOIN documents USING (doc_id) "
    "WHERE lang = 'en' AND n_chars > 300 ORDER BY round(sums.score, 9) DESC, doc_id LIMIT 50",
)
def search_prefilter(t: Tables):
    found = B.search(t.texts, "doc_id", "text", TERMS, {"lang": "en", "n_chars": {"$gt": 300}}, 50)
    return found.select("doc_id", r6(F.col("score")).alias("score"))


@query(
    "search_all_terms",
    f"WITH {_CORPUS}, q AS (SELECT unnest(['the', 'with', 'that']) AS token, 1 AS w), {_PROBABILISTIC} "
    "SELECT doc_id, round(score, 6) AS score FROM sums WHERE terms = 3 ORDER BY round(sums.score, 9) DESC, doc_id LIMIT 50",
)
def search_all_terms(t: Tables):
    found = B.search(t.texts, "doc_id", "text", ["the", "with", "that"], None, 50, all_terms=True)
    return found.select("doc_id", r6(F.col("score")).alias("score"))


@query("search_prefilter_index", ORACLE["search_prefilter"])
def search_prefilter_index(t: Tables):
    found = B.search_with_index(_stored_index(t, t.texts), t.documents, TERMS, {"lang": "en", "n_chars": {"$gt": 300}}, 50)
    return found.select("doc_id", r6(F.col("score")).alias("score"))


@query("search_all_terms_index", ORACLE["search_all_terms"])
def search_all_terms_index(t: Tables):
    found = B.search_with_index(_stored_index(t, t.texts), t.documents, ["the", "with", "that"], None, 50, all_terms=True)
    return found.select("doc_id", r6(F.col("score")).alias("score"))


@query("filter_only_query", "SELECT doc_id, lang, source FROM documents WHERE source IN ('src2', 'src4') ORDER BY doc_id LIMIT 40")
def filter_only_query(t: Tables):
    return B.search(t.texts, "doc_id", "text", None, {"source": ["src2", "src4"]}, 40).select("doc_id", "lang", "source")


def _batch_sql(filtered: str, held: str = "") -> str:
    return (
        f"WITH {_CORPUS}, q AS (SELECT item_id, token, count(*) AS w FROM (SELECT item_id, unnest({index_tokens_sql('text')}) AS token FROM benchmark) GROUP BY 1, 2), "
        "asked AS (SELECT item_id, count(*) AS terms FROM q GROUP BY 1), "
        "s AS (SELECT item_id, doc_id, sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_len))) AS score "
        "FROM post JOIN q USING (token) JOIN asked USING (item_id) JOIN freq USING (token) JOIN lens USING (doc_id) JOIN documents USING (doc_id), tot "
        f"WHERE {filtered} GROUP BY 1, 2 {held}) "
        "SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(s.score, 9) DESC, doc_id) AS INTEGER) AS rank, doc_id, round(score, 6) AS score "
        "FROM s QUALIFY rank <= 10"
    )


@query("query_batch", _batch_sql("lang IN ('en', 'fr')"))
def query_batch(t: Tables):
    found = B.search_batch(t.texts, "doc_id", "text", t.read("benchmark"), "item_id", "text", 10, {"lang": ["en", "fr"]})
    return found.select("item_id", "rank", "doc_id", r6(F.col("score")).alias("score"))


@query("query_batch_filters", _batch_sql("CASE item_id % 3 WHEN 0 THEN lang = 'en' WHEN 1 THEN n_chars > 500 ELSE true END"))
def query_batch_filters(t: Tables):
    """Every query has a filter of its own, or none."""
    benchmark = t.read("benchmark")
    ids = [row[0] for row in benchmark.select("item_id").orderBy("item_id").collect()]
    filters = [({"lang": "en"}, {"n_chars": {"$gt": 500}}, None)[i % 3] for i in ids]
    found = B.search_batch(t.texts, "doc_id", "text", benchmark, "item_id", "text", 10, filters)
    return found.select("item_id", "rank", "doc_id", r6(F.col("score")).alias("score"))


@query("query_batch_all_terms", _batch_sql("true", "HAVING count(*) = max(terms)"))
def query_batch_all_terms(t: Tables):
    found = B.search_batch(t.texts, "doc_id", "text", t.read("benchmark"), "item_id", "text", 10, all_terms=True)
    return found.select("item_id", "rank", "doc_id", r6(F.col("score")).alias("score"))


def _dialogues(t: Tables):
    """Each conversation as one text with the role before every turn, with a time and a topic."""
    turns = t.read("conversations").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"), F.min("role").alias("first_role")
    )
    said = F.transform("_t", lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    times = t.events.select(F.col("event_id").alias("conv_id"), "ts", "event_type")
    return turns.join(times, "conv_id").select(
        "conv_id", F.array_join(said, " ").alias("raw"), "ts", (F.size("_t") % 3).alias("topic_id")
    )


@query("search_highlight")
def search_highlight(t: Tables):
    found = B.search_highlight(_dialogues(t), "conv_id", "raw", "raw", "ts", "la thin the", PREFIXES)
    return found.select("conv_id", iso("ts").alias("ts"), "score", "highlight", "marked_text")


@query("topic_examples")
def topic_examples(t: Tables):
    found = examples_of_topic(_dialogues(t), "conv_id", "raw", "raw", "ts", "topic_id", 1, ["la", "the"], PREFIXES)
    return found.select("conv_id", iso("ts").alias("ts"), "score", "highlight", "marked_text")
