"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontamination, filter_audit, language, licenses, packing, periodic, quality, rollups, sharding, simhash, token_files, top_k, warc
from corpusmill.llm.common import written
from corpusmill.session import scratch_folder

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_token_files")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    files = scratch_folder(spark, "token-files")
    token_files.write_token_files(table(spark, folder, "documents"), files, WORD_BPE, end_id=1)
    return token_files.token_digests(spark, files)


@query("op2_decontamination")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return packing.piece_digests(packing.pack_documents(table(spark, folder, "documents"), BYTE_BPE, end_id=0))


@query(
    "op4_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
    f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN first < page_id THEN first END AS refers_to FROM f
    """,
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_archives(table(spark, folder, "pages"), scratch_folder(spark, "warc"))
    return warc.read_archives(spark, archives, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_token_counts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Load all documents, take out all but the first of equal texts, count the end of each document too, and
    send the second batch again."""
    docs = table(spark, folder, "documents")
    ledger = rollups.TokenRollup(spark, scratch_folder(spark, "rollup"))
    counted = written(rollups.count_tokens(docs, {"word_bpe_49k": WORD_BPE, "byte_bpe_50k": BYTE_BPE}))
    ledger.commit("load", counted.withColumn("op", F.lit("insert")))
    codes = written(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("code")))
    first = codes.groupBy("code").agg(F.min("doc_id").alias("doc_id"))
    copies = codes.join(first, "doc_id", "left_anti").select("doc_id")
    deletes = counted.join(copies, "doc_id", "left_semi").withColumn("op", F.lit("delete"))
    ledger.commit("copies", deletes)
    revised = ledger.state().select("doc_id", "tokenizer", "source", "lang", (F.col("n_tokens") + 1).alias("n_tokens")).withColumn("op", F.lit("revise"))
    ledger.commit("ends", revised)
    ledger.commit("copies", deletes)
    return ledger.totals()


@query(
    "op6_top_k",
    """
    WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 20
    """,
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    steps = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x) < float("inf"), F.floor(64 * x).cast("double")))
    vectors = table(spark, folder, "embeddings").withColumn("embedding", steps)
    found = top_k.top_k(vectors, F.col("vec_id") % 20 == 0, 20)
    return found.withColumn("score", F.col("score").cast("long"))


@query("op7_licenses")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query("op8_language")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify_languages(table(spark, folder, "documents"))


@query("op9_sharding")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs, shards = table(spark, folder, "documents").select("doc_id", "text"), scratch_folder(spark, "shards")
    sharding.write_shards(docs, shards)
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = sharding.read_shards(spark, shards, docs)
    return rows.select("doc_id", (F.octet_length(text) + sharding.ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_simhash")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op11_quality")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(
    "op12_filter_audit",
    r"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body FROM documents),
    w AS (SELECT *, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY body) AS least FROM d),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    f AS (SELECT part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
      100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 3 * length(body) AS c, regexp_matches(body, '[#$%&*|]') AS d,
      coalesce(w.doc_id > least, false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
    m AS (SELECT part, map(['A', 'B', 'C', 'D', 'E'], [a, b, c, d, e]) AS fails, a::INT + b::INT + c::INT + d::INT + e::INT AS fail_count, good, toxic, count(*) AS n FROM f GROUP BY ALL),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
    st AS (SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS letter FROM o, range(1, 6) g(step)),
    h AS (SELECT m.*, filter_order, step, letter, fails[letter] AS now, len([y FOR y IN string_split(filter_order[1:step - 1], '') IF y <> '' AND fails[y]]) > 0 AS gone FROM m, st),
    g AS (SELECT part, filter_order, step, letter, sum(n) FILTER (NOT gone AND NOT now) AS kept, sum(n) FILTER (now AND NOT gone) AS removed, sum(n) FILTER (now AND gone) AS redundant,
      sum(n) FILTER (now AND fail_count = 1) AS unique_fails, sum(n) FILTER (now AND NOT gone AND good = 1) AS good_lost, sum(n) FILTER (now AND NOT gone AND toxic = 1) AS toxic_lost
      FROM h GROUP BY part, filter_order, step, letter)
    SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
      CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
      CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    counts = filter_audit.failure_counts(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return filter_audit.audit_filters(counts, filter_audit.FIVE, ["good", "toxic"])


def with_planted_period(name: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by the checksum of the id, repeat a phrase from some word on."""
    checksum = 1 if name is None else zlib.crc32(str(name).encode())
    n, g = len(words), checksum // 10
    if checksum % 10 or not n:
        return words
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    return [words[i if i < first else first + (i - first) % period] for i in range(n)]


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.run_digests(periodic.periodic_runs(table(spark, folder, "documents"), prepare=with_planted_period))
