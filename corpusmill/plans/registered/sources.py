"""Readers and writers: each writes a given table with one and reads it back with the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.plans.registered.registry import APPEALS_SQL, Tables, iso, iso_sql, query, strip_sql
from corpusmill.sources import files as S
from corpusmill.session import scratch_folder


@query("read_delimited", "SELECT doc_id AS id, md5(text) AS digest, lang AS language FROM documents")
def read_delimited(t: Tables):
    folder = scratch_folder(t.spark, "delimited")
    t.documents.write.option("header", True).option("sep", "\t").option("escape", '"').csv(folder)
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    names = {"doc_id": "id", "text": "text", "lang": "language"}
    df = S.read_delimited(t.spark, folder, names, "\t", schema=schema, multi_line=True)
    return df.select("id", F.md5("text").alias("digest"), "language")


@query(
    "read_json_docs",
    "SELECT doc_id, md5(text) AS digest, lang, source FROM documents",
)
def read_json_docs(t: Tables):
    folder = scratch_folder(t.spark, "json")
    meta = F.to_json(F.struct("lang", "source"))
    t.documents.select("doc_id", F.col("text").alias("content"), meta.alias("meta")).write.json(folder)
    docs = S.read_json_docs(t.spark, folder, "doc_id bigint, content string, meta string", parse_meta=True)
    return docs.select("doc_id", F.md5("content").alias("digest"), *[F.col("meta")[k].alias(k) for k in ("lang", "source")])


@query("write_docs", "SELECT doc_id, text, lang FROM documents")
def write_docs(t: Tables):
    folder = scratch_folder(t.spark, "written")
    S.write_docs(t.documents, folder, ["doc_id", "text", "lang"])
    return t.spark.read.schema("doc_id bigint, text string, lang string").json(folder)


@query("ingest_parquet", "SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, props FROM events")
def ingest_parquet(t: Tables):
    folder = scratch_folder(t.spark, "upload") + ".csv"
    t.events.select("event_id", "event_type", "props").write.option("header", True).option("escape", '"').csv(folder)
    landed = S.ingest_parquet(t.spark, folder, scratch_folder(t.spark, "landed"))
    return t.spark.read.parquet(landed.path).select(*landed.columns)


@query("scan_with_roles", "SELECT event_id, event_type AS text, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS time, 7 AS clusters FROM events")
def scan_with_roles(t: Tables):
    df, roles = S.scan_with_roles(t.spark, f"{t.folder}/events.parquet", "event_type", "ts", 30)
    if not (roles.text_ok and roles.time_ok):
        raise ValueError("columns missing")
    return df.select("event_id", F.col("event_type").alias("text"), iso("ts").alias("time"), F.lit(roles.clusters).alias("clusters"))


@query(
    "read_records",
    f"SELECT DISTINCT {strip_sql('x')} AS record FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), '.')) AS x FROM benchmark) WHERE length(x) > 0",
)
def read_records(t: Tables):
    folder = scratch_folder(t.spark, "records")
    flat = t.read("benchmark").select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"))
    flat.write.option("lineSep", ".").text(folder)
    return S.read_records(t.spark, folder, ".")


@query(
    "read_keyword_file",
    "SELECT DISTINCT source AS keyword, CASE WHEN lang = 'en' THEN source ELSE lang END AS clean_name FROM documents",
)
def read_keyword_file(t: Tables):
    folder = scratch_folder(t.spark, "dictionary")
    line = F.when(F.col("lang") == "en", F.col("source")).otherwise(F.concat("source", F.lit("=>"), "lang"))
    t.documents.select(line.alias("value")).write.text(folder)
    return S.read_keyword_file(t.spark, folder).select("keyword", "clean_name").distinct()


@query(
    "snapshot_report",
    f"WITH {APPEALS_SQL} SELECT 'thin' AS query, md5(text) AS document, topic_id AS score, {iso_sql('ts')} AS timestamp FROM appeals WHERE lang = 'en'",
)
def snapshot_report(t: Tables):
    report = S.snapshot_report("thin", t.appeals.where("lang = 'en'"), "text", "topic_id", "ts")
    return report.select("query", F.md5("document").alias("document"), "score", iso("timestamp").alias("timestamp"))


@query(
    "document_store",
    "SELECT CAST(doc_id AS VARCHAR) AS id, lang AS index, CASE WHEN lang = 'en' THEN 'v2' ELSE source END AS version, md5(text) AS digest "
    "FROM documents WHERE lang <> 'en' OR n_chars > 100",
)
def document_store(t: Tables):
    """Documents stored by index; one index is read, changed and put back."""
    stored = t.stored.select("id", "index", "version", "content")
    folder = scratch_folder(t.spark, "store")
    S.save_documents(stored, folder)
    own = S.load_documents(t.spark, folder, stored.schema, "en").where(F.length("content") > 100)
    S.replace_index(own.withColumn("version", F.lit("v2")), folder)
    return S.load_documents(t.spark, folder, stored.schema).select("id", "index", "version", F.md5("content").alias("digest"))
