"""Document and label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import vectors as V
from corpusmill.functions.dates import rfc3339
from corpusmill.operators import appeals as A
from corpusmill.operators import documents as D
from corpusmill.operators import labels as Lb
from corpusmill.operators.text_tables import content_json, content_from_json
from corpusmill.plans.registered.registry import APPEALS_SQL, STORED_SQL, WITH_META_SQL, Tables, query, r6


def _digest(df: DataFrame) -> DataFrame:
    """What is compared of a store: key, version and a digest of the content."""
    return df.select("id", "index", "version", "vector_id", F.md5("content").alias("digest"))


_DIGEST_SQL = "id, index, version, vector_id, md5(content) AS digest"


def _labelled(t: Tables) -> DataFrame:
    """The part of the store that has labels: what was stored before."""
    ids = t.labels.select(F.col("doc_id").cast("string").alias("id"))
    return t.stored.join(ids, "id", "left_semi")


def _incoming(t: Tables) -> DataFrame:
    """A batch of all documents, each sent twice; the second copy has a new version."""
    twice = t.stored.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_copy"))
    return (
        twice.withColumn("version", F.concat("version", F.lit("-"), F.col("_copy").cast("string")))
        .withColumn("ord", F.col("ord") * 2 + F.col("_copy"))
        .drop("_copy")
    )


_WRITE_SQL = (
    f"{STORED_SQL}, old AS (SELECT * FROM stored WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)), "
    "incoming AS (SELECT id, index, content, content_type, vector_id, version || '-' || c AS version, ord * 2 + c AS ord, lang, source "
    "FROM stored, (VALUES (0), (1)) v(c))"
)


@query(
    "normalize_documents",
    "SELECT md5(text) AS id, n_chars AS content_size, 'text' AS content_type, lang AS meta_lang, source AS meta_source, "
    "CAST(doc_id AS VARCHAR) AS meta_doc_id, CAST(n_chars AS VARCHAR) AS meta_n_chars, 4 AS meta_keys FROM documents",
)
def normalize_documents(t: Tables):
    n = D.normalize_documents(t.documents, {"text": "content"})
    return n.select(
        "id", F.length("content").cast("bigint").alias("content_size"), "content_type",
        *[F.col("meta")[k].alias(f"meta_{k}") for k in ("lang", "source", "doc_id", "n_chars")],
        F.size("meta").alias("meta_keys"),
    )


@query("flatten_documents", f"WITH {STORED_SQL} SELECT id, index, md5(content) AS body, lang, source FROM stored")
def flatten_documents(t: Tables):
    flat = D.flatten_documents(t.stored.drop("ord", "version", "vector_id", "content_type"), ["lang", "source"], {"body": "content"})
    return flat.withColumn("body", F.md5("body"))


@query(
    "document_id",
    "SELECT doc_id, md5(text) AS id, md5(':' || text || ':' || lang) AS keyed_id FROM documents",
)
def document_id(t: Tables):
    text, lang = F.col("text"), F.col("lang")
    return t.documents.select("doc_id", D.document_id(text).alias("id"), D.document_id(text, text, lang).alias("keyed_id"))


_HALF_SQL = "regexp_replace(sha256(CAST(doc_id AS VARCHAR) || 'Document'), '(.).', '\\1', 'g')"


@query(
    "document_uuid",
    f"WITH h AS (SELECT doc_id, {_HALF_SQL} AS x FROM documents) SELECT doc_id, "
    "substr(x,1,8)||'-'||substr(x,9,4)||'-'||substr(x,13,4)||'-'||substr(x,17,4)||'-'||substr(x,21,12) AS uuid FROM h",
)
def document_uuid(t: Tables):
    name = D.index_name("document")
    return t.documents.select("doc_id", D.document_uuid(F.col("doc_id").cast("string"), name).alias("uuid"))


_META_SQL = (
    f"{STORED_SQL}, meta AS (SELECT id AS document_id, index AS document_index, 'lang' AS name, '\"' || lang || '\"' AS value FROM stored "
    "UNION ALL SELECT id, index, 'source', '\"' || source || '\"' FROM stored)"
)


@query("explode_meta", f"WITH {_META_SQL} SELECT document_id, document_index, name, value FROM meta")
def explode_meta(t: Tables):
    return D.explode_meta(t.stored)


@query(
    "collect_meta",
    f"WITH {STORED_SQL} SELECT id, index, '\"' || lang || '\"' AS lang, '\"' || source || '\"' AS source FROM stored",
)
def collect_meta(t: Tables):
    joined = D.collect_meta(t.stored, D.explode_meta(t.stored))
    return joined.select("id", "index", F.col("meta")["lang"].alias("lang"), F.col("meta")["source"].alias("source"))


@query(
    "flatten_classification",
    f"WITH {WITH_META_SQL} SELECT doc_id, lang AS classification_label, CAST(quality AS DOUBLE) AS classification_score, "
    "CASE WHEN toxic IS NULL THEN '{\"source\":\"' || source || '\"}' "
    "ELSE '{\"source\":\"' || source || '\",\"toxic\":' || toxic || '}' END AS classification_details FROM with_meta",
)
def flatten_classification(t: Tables):
    c = F.struct(
        F.col("lang").alias("label"), F.col("quality").cast("double").alias("score"), F.struct("source", "toxic").alias("details")
    )
    flat = D.flatten_classification(t.with_meta.select("doc_id", c.alias("classification")))
    return flat.withColumnsRenamed({f"classification.{k}": f"classification_{k}" for k in ("label", "score", "details")})


@query(
    "table_explode",
    "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS row_no, role, md5(text) AS digest "
    "FROM conversations",
)
def table_explode(t: Tables):
    turns = t.read("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"))
    rows = F.transform("_t", lambda x: F.array(x["role"], x["text"]))
    tables = turns.select("conv_id", F.concat(F.array(F.array(F.lit("role"), F.lit("text"))), rows).alias("content"))
    record = F.col("record")
    return D.table_explode(tables).select("conv_id", "row_no", record["role"].alias("role"), F.md5(record["text"]).alias("digest"))


@query(
    "drop_duplicate_documents",
    f"WITH {_WRITE_SQL} SELECT {_DIGEST_SQL} FROM incoming QUALIFY row_number() OVER (PARTITION BY id ORDER BY ord) = 1",
)
def drop_duplicate_documents(t: Tables):
    return _digest(D.drop_duplicate_documents(_incoming(t), "ord"))


@query(
    "write_skip",
    f"WITH {_WRITE_SQL}, batch AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY id, index ORDER BY ord) = 1) "
    f"SELECT {_DIGEST_SQL} FROM old UNION ALL "
    f"SELECT {_DIGEST_SQL} FROM batch b WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.id = b.id AND o.index = b.index)",
)
def write_skip(t: Tables):
    return _digest(D.write_documents(_labelled(t), _incoming(t), "skip", "ord"))


@query(
    "write_overwrite",
    f"WITH {_WRITE_SQL}, batch AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY id, index ORDER BY ord DESC) = 1) "
    f"SELECT {_DIGEST_SQL} FROM batch UNION ALL "
    f"SELECT {_DIGEST_SQL} FROM old o WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE o.id = b.id AND o.index = b.index)",
)
def write_overwrite(t: Tables):
    return _digest(D.write_documents(_labelled(t), _incoming(t), "overwrite", "ord"))


@query(
    "write_fail",
    f"WITH {_WRITE_SQL} SELECT DISTINCT id, index FROM incoming i WHERE EXISTS (SELECT 1 FROM old o WHERE o.id = i.id AND o.index = i.index)",
)
def write_fail(t: Tables):
    return D.conflicting_ids(_labelled(t), _incoming(t))


_CHANGED_SQL = f"{_META_SQL}, lab AS (SELECT CAST(doc_id AS VARCHAR) AS id, quality FROM labels)"


@query(
    "update_meta_replace",
    f"WITH {_CHANGED_SQL} SELECT document_id, document_index, name, value FROM meta WHERE document_id NOT IN (SELECT id FROM lab) "
    "UNION ALL SELECT s.id, s.index, 'quality', '\"' || quality || '\"' FROM stored s JOIN lab USING (id)",
)
def update_meta_replace(t: Tables):
    return D.update_meta_replace(D.explode_meta(t.stored), _changes_as_rows(t))


def _changes(t: Tables) -> DataFrame:
    """New meta of the labelled documents: their quality, and a new source."""
    lab = t.labels.select(F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("string").alias("quality"))
    meta = F.create_map(F.lit("quality"), F.col("quality"), F.lit("source"), F.lit("checked"))
    return t.stored.select("id", "index").join(lab, "id").select("id", "index", meta.alias("meta"))


def _changes_as_rows(t: Tables) -> DataFrame:
    return D.explode_meta(_changes(t)).where(F.col("name") == "quality")


@query(
    "update_meta_merge",
    f"WITH {_CHANGED_SQL} SELECT s.id, s.index, s.lang, CASE WHEN l.id IS NULL THEN s.source ELSE 'checked' END AS source, "
    "CAST(quality AS VARCHAR) AS quality FROM stored s LEFT JOIN lab l USING (id)",
)
def update_meta_merge(t: Tables):
    merged = D.update_meta_merge(t.stored, _changes(t))
    return merged.select("id", "index", *[F.try_element_at("meta", F.lit(k)).alias(k) for k in ("lang", "source", "quality")])


@query(
    "update_vector_ids",
    f"WITH {STORED_SQL} SELECT s.id, s.index, CASE WHEN e.vec_id IS NOT NULL AND s.index = 'en' THEN 'e' || e.vec_id ELSE s.vector_id END AS vector_id "
    "FROM stored s LEFT JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = s.id",
)
def update_vector_ids(t: Tables):
    key = F.col("vec_id").cast("string")
    mapping = t.embeddings.select(key.alias("id"), F.concat(F.lit("e"), key).alias("vector_id"))
    return D.update_vector_ids(t.stored, mapping, "en").select("id", "index", "vector_id")


@query(
    "reset_vector_ids",
    f"WITH {STORED_SQL} SELECT id, index, CASE WHEN index = 'en' THEN NULL ELSE vector_id END AS vector_id FROM stored",
)
def reset_vector_ids(t: Tables):
    return D.reset_vector_ids(t.stored, "en").select("id", "index", "vector_id")


@query(
    "delete_documents",
    f"WITH {STORED_SQL} SELECT {_DIGEST_SQL} FROM stored WHERE NOT (index = 'en' AND source IN ('src1', 'src2', 'src3', 'src4') "
    "AND id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels))",
)
def delete_documents(t: Tables):
    ids = t.labels.select(F.col("doc_id").cast("string").alias("id"))
    wanted = {"source": {"$in": ["src1", "src2", "src3", "src4"]}}
    return _digest(D.delete_documents(t.stored, "en", ids, wanted, lambda name: F.col("meta")[name]))


@query("delete_index", f"WITH {STORED_SQL} SELECT {_DIGEST_SQL} FROM stored WHERE index <> 'en'")
def delete_index(t: Tables):
    return _digest(D.delete_index(t.stored, "en"))


@query("get_by_ids", f"WITH {STORED_SQL} SELECT {_DIGEST_SQL} FROM stored WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)")
def get_by_ids(t: Tables):
    return _digest(D.get_by_ids(t.stored, t.labels.select(F.col("doc_id").cast("string").alias("id"))))


@query(
    "get_by_vector_ids",
    f"WITH {STORED_SQL}, asked AS (SELECT * FROM (VALUES (0, 'v42'), (1, 'v7'), (2, 'v199'), (3, 'v3')) a(pos, vector_id)) "
    f"SELECT pos, {_DIGEST_SQL} FROM stored JOIN asked USING (vector_id)",
)
def get_by_vector_ids(t: Tables):
    found = D.get_by_vector_ids(t.stored, ["v42", "v7", "v199", "v3"])
    return found.select("pos", "id", "index", "version", "vector_id", F.md5("content").alias("digest"))


@query(
    "count_documents",
    "SELECT count(*) AS documents, count(e.vec_id) AS embeddings FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id "
    "WHERE lang IN ('en', 'fr')",
)
def count_documents(t: Tables):
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    return D.count_documents(D.attach_embeddings(t.documents, vectors, "doc_id"), {"lang": ["en", "fr"]})


@query(
    "scan_documents",
    "SELECT doc_id, source, md5(text) AS digest FROM documents d WHERE lang = 'en' AND n_chars >= 300 "
    "AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)",
)
def scan_documents(t: Tables):
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = D.attach_embeddings(t.documents.withColumn("index", F.col("lang")), vectors, "doc_id")
    found = D.scan_documents(docs, "en", {"n_chars": {"$gte": 300}}, only_missing_embedding=True)
    return found.select("doc_id", "source", F.md5("text").alias("digest"))


# --- labels ---------------------------------------------------------------------------------------


def _label_table(t: Tables) -> DataFrame:
    """Labels with a question per source and a no-answer flag that is often missing."""
    return t.with_meta.select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("index"),
        F.col("source").alias("question"),
        (F.col("quality") == 0).alias("no_answer"),
        (F.col("toxic") == 0).alias("is_correct_answer"),
        F.col("doc_id").alias("ord"),
    )


_LABEL_SQL = (
    f"{WITH_META_SQL}, lab AS (SELECT doc_id AS id, lang AS index, source AS question, quality = 0 AS no_answer, "
    "toxic = 0 AS is_correct_answer, doc_id AS ord FROM with_meta)"
)


@query(
    "write_labels",
    f"WITH {_LABEL_SQL} SELECT id, index, CASE WHEN is_correct_answer THEN question || '!' ELSE question END AS question, "
    "CASE WHEN is_correct_answer THEN coalesce(no_answer, false) ELSE no_answer END AS no_answer FROM lab",
)
def write_labels(t: Tables):
    labels = _label_table(t)
    changed = labels.where("is_correct_answer").withColumn("question", F.concat("question", F.lit("!")))
    return Lb.write_labels(labels, changed, "ord").select("id", "index", "question", "no_answer")


@query("read_labels", f"WITH {_LABEL_SQL} SELECT id, question, no_answer FROM lab WHERE index = 'en' AND question IN ('src1', 'src2')")
def read_labels(t: Tables):
    return Lb.read_labels(_label_table(t), "en", {"question": ["src1", "src2"]}).select("id", "question", "no_answer")


@query(
    "delete_labels",
    f"WITH {_LABEL_SQL} SELECT id, index, question FROM lab WHERE NOT (index = 'en' AND question IN ('src1', 'src2', 'src3') "
    "AND id IN (SELECT doc_id FROM labels))",
)
def delete_labels(t: Tables):
    ids = t.labels.select(F.col("doc_id").alias("id"))
    kept = Lb.delete_labels(_label_table(t), "en", ids, {"question": ["src1", "src2", "src3"]})
    return kept.select("id", "index", "question")


@query(
    "dedup_labels",
    f"WITH {_LABEL_SQL} SELECT index, question, no_answer, is_correct_answer, min(id) AS id FROM lab GROUP BY ALL",
)
def dedup_labels(t: Tables):
    return Lb.dedup_labels(_label_table(t), ["index", "question", "no_answer", "is_correct_answer"])


# --- schema, dates, content -----------------------------------------------------------------------


def _mixed_meta(t: Tables) -> DataFrame:
    """JSON meta values of many kinds, all taken from the events."""
    e = t.events
    entries = F.array(
        *[
            F.struct(F.lit(name).alias("name"), value.alias("value"))
            for name, value in {
                "day": F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("v"))),
                "kind": F.to_json(F.struct(F.col("event_type").alias("v"))),
                "amount": F.concat(F.lit('{"v":'), F.col("value").cast("decimal(18,2)").cast("string"), F.lit("}")),
                "user": F.to_json(F.struct(F.col("user_id").alias("v"))),
                "large": F.to_json(F.struct((F.col("value") > 50).alias("v"))),
                "users": F.to_json(F.struct(F.array("user_id", "event_id").alias("v"))),
                "kinds": F.to_json(F.struct(F.array("event_type").alias("v"))),
            }.items()
        ]
    )
    rows = e.select("event_id", F.explode(entries).alias("_e"))
    return rows.select("event_id", F.col("_e.name").alias("name"), F.regexp_extract("_e.value", r"^\{\"v\":(.*)\}$", 1).alias("value"))


@query(
    "infer_property_types",
    "WITH n AS (SELECT count(*) AS c FROM events) SELECT name, data_type FROM n, (VALUES ('day', 'date'), ('kind', 'string'), "
    "('amount', 'number'), ('user', 'int'), ('large', 'boolean'), ('users', 'int[]'), ('kinds', 'string[]')) v(name, data_type) WHERE c > 0",
)
def infer_property_types(t: Tables):
    return D.infer_property_types(_mixed_meta(t), ["event_id"])


@query("missing_properties", "SELECT DISTINCT event_type AS name FROM events WHERE event_type NOT IN (SELECT DISTINCT lang FROM documents) AND event_type <> 'click'")
def missing_properties(t: Tables):
    seen = t.events.select(F.col("event_type").alias("name"))
    known = t.documents.select(F.col("lang").alias("name")).unionByName(seen.where(F.col("name") == "click")).distinct()
    return D.missing_properties(seen, known)


@query(
    "rfc3339_dates",
    "SELECT event_id, strftime(ts, '%Y-%m-%d') || 'T00:00:00Z' AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS moment, "
    "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+03:00' AS zoned, CAST(NULL AS VARCHAR) AS unread FROM events",
)
def rfc3339_dates(t: Tables):
    ts = F.col("ts")
    return t.events.select(
        "event_id",
        rfc3339(F.date_format(ts, "yyyy-MM-dd")).alias("day"),
        rfc3339(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("moment"),
        rfc3339(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+03:00"))).alias("zoned"),
        rfc3339(F.col("event_type")).alias("unread"),
    )


@query("content_json", "SELECT doc_id, lang, source, n_chars, md5(text) AS digest, 5 AS fields FROM documents")
def content_json_query(t: Tables):
    as_json = content_json(t.documents, "document")
    fields = F.size(F.json_object_keys("document"))
    back = content_from_json(as_json.withColumn("fields", fields), "document", t.documents.schema, keep=["fields"])
    return back.select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("digest"), "fields")


# --- batches, positions ---------------------------------------------------------------------------


@query(
    "key_range_batches",
    "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) "
    "SELECT CAST(n // 64 AS BIGINT) AS batch, min(doc_id) AS first_key, max(doc_id) AS last_key, count(*) AS rows_in_batch FROM r GROUP BY 1",
)
def key_range_batches(t: Tables):
    return D.key_range_batches(t.documents, "doc_id", 64)


@query(
    "number_in_chunks",
    "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS number FROM events) "
    "SELECT event_id, number, CAST(number // 100 AS BIGINT) AS chunk FROM r",
)
def number_in_chunks(t: Tables):
    return D.number_in_chunks(t.events, "event_id", 100)


@query(
    "bounds_lookup",
    "WITH v AS (SELECT n_chars AS x FROM documents), k AS (SELECT DISTINCT user_id AS key FROM events), n AS (SELECT count(*) AS c FROM v), "
    "d AS (SELECT key, count(*) FILTER (WHERE x < key) AS below, count(*) FILTER (WHERE x <= key) AS upto FROM k, v GROUP BY key) "
    "SELECT key, CASE WHEN below < c THEN below ELSE -1 END AS leftmost_ge, upto - 1 AS rightmost_le FROM d, n",
)
def bounds_lookup(t: Tables):
    return A.bounds_lookup(t.documents, "n_chars", t.events.select(F.col("user_id").alias("key")), "key")


@query(
    "mean_metrics",
    f"WITH {APPEALS_SQL}, p AS (SELECT conv_id, [role, 'user', 'system'] AS preds, ['user', 'assistant'] AS labels FROM conversations), "
    "m AS (SELECT len(list_distinct(list_intersect(preds, labels))) AS s, len(list_distinct(preds)) AS np, len(labels) AS nl FROM p) "
    "SELECT round(avg(s / np), 6) AS precision, round(avg(s / nl), 6) AS recall FROM m",
)
def mean_metrics(t: Tables):
    rows = t.read("conversations").select(
        F.array("role", F.lit("user"), F.lit("system")).alias("preds"), F.array(F.lit("user"), F.lit("assistant")).alias("labels")
    )
    preds, labels = F.col("preds"), F.col("labels")
    means = A.mean_metrics(rows, {"precision": A.precision(preds, labels), "recall": A.recall(preds, labels)})
    return means.select(r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


@query("apply_row_function", "SELECT doc_id, lang, source, n_chars, upper(lang) || ':' || lower(source) AS text FROM documents")
def apply_row_function(t: Tables):
    return D.apply_row_function(t.documents, "text", lambda row: F.concat(F.upper(row["lang"]), F.lit(":"), F.lower(row["source"])))


# --- vectors of documents -------------------------------------------------------------------------

_NORM = "sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding]))"


@query(
    "attach_embeddings",
    f"SELECT doc_id, len(embedding) AS dims, round({_NORM}, 6) AS size FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
)
def attach_embeddings(t: Tables):
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    return D.attach_embeddings(t.documents, vectors, "doc_id").select(
        "doc_id", F.array_size("embedding").cast("bigint").alias("dims"), r6(V.norm(F.col("embedding"))).alias("size")
    )


@query(
    "update_embeddings",
    "WITH n AS (SELECT d.doc_id, d.lang, e.label, e.embedding AS v FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id), "
    "w AS (SELECT doc_id, lang, v, [CAST(x AS DOUBLE) * (label + 1) for x in v] AS u FROM n), "
    "z AS (SELECT *, sqrt(list_sum([x * x for x in u])) AS s FROM w) "
    "SELECT doc_id, round(CASE WHEN lang = 'en' THEN u[1] / s ELSE CAST(v[1] AS DOUBLE) END, 6) AS first, "
    "round(CASE WHEN lang = 'en' THEN u[64] / s ELSE CAST(v[64] AS DOUBLE) END, 6) AS last FROM z",
)
def update_embeddings(t: Tables):
    e = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    docs = D.attach_embeddings(t.documents, e, "doc_id")
    new = e.select("doc_id", F.transform("embedding", lambda a: a.cast("double") * (F.col("label") + 1)).alias("embedding"))
    done = D.update_embeddings(docs, new, "doc_id", {"lang": "en"})
    v = F.col("embedding")
    return done.select("doc_id", r6(F.get(v, 0)).alias("first"), r6(F.get(v, 63)).alias("last"))


def _vowel_counts():
    """A model as a user gives it: it counts vowels."""
    return lambda texts: [[float(t.count(v)) for v in "aeiou"] for t in texts]


@query(
    "encode_embeddings",
    "WITH c AS (SELECT d.doc_id, lang = 'en' AND n_chars > 300 AND d.text IS NOT NULL AS chosen, e.embedding AS v, "
    "[CAST(length(text) - length(replace(text, x, '')) AS DOUBLE) FOR x IN ['a', 'e', 'i', 'o', 'u']] AS u FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id), "
    "z AS (SELECT *, sqrt(list_sum([x * x FOR x IN u])) AS s FROM c) "
    "SELECT doc_id, CAST(CASE WHEN chosen THEN 5 ELSE coalesce(len(v), 0) END AS INTEGER) AS size, "
    "round(CASE WHEN chosen THEN CASE WHEN s = 0 THEN 0 ELSE u[1] / s END ELSE CAST(v[1] AS DOUBLE) END, 6) AS first, "
    "round(CASE WHEN chosen THEN CASE WHEN s = 0 THEN 0 ELSE u[5] / s END ELSE CAST(v[5] AS DOUBLE) END, 6) AS fifth FROM z",
)
def encode_embeddings(t: Tables):
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = D.attach_embeddings(t.documents, vectors, "doc_id")
    done = D.encode_embeddings(docs, "text", _vowel_counts, {"lang": "en", "n_chars": {"$gt": 300}})
    v = F.col("embedding")
    return done.select("doc_id", F.coalesce(F.size(v), F.lit(0)).alias("size"), r6(F.get(v, 0)).alias("first"), r6(F.get(v, 4)).alias("fifth"))


@query("fill_missing_embeddings")
def fill_missing_embeddings(t: Tables):
    vectors = t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    return D.fill_missing_embeddings(D.attach_embeddings(t.documents, vectors, "doc_id"), 64, "doc_id").select(
        "doc_id", "embedding", "is_placeholder"
    )


@query(
    "check_dimensions",
    "SELECT count(embedding) AS vectors, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_size FROM embeddings",
)
def check_dimensions(t: Tables):
    return D.check_dimensions(t.embeddings, 64)
