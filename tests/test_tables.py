from __future__ import annotations

import uuid
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import vectors as V
from corpusmill.operators import appeals as A
from corpusmill.operators import documents as D
from corpusmill.operators import labels as Lb
from corpusmill.operators import topics as T
from corpusmill.operators import vectors as N
from corpusmill.plans import analysis
from corpusmill.session import scratch_folder
from corpusmill.sources import files as S

# Eight short texts with curly quotes and line breaks.
PARAGRAPHS = [f"Paragraph {i} says “yes”.\nAnd ends." for i in range(8)]


def store(spark, rows):
    return spark.createDataFrame(rows, "id string, index string, version string, ord int")


def test_write_and_read_back(spark):
    df = spark.createDataFrame([(p,) for p in PARAGRAPHS], "content string")
    docs = D.normalize_documents(df).withColumn("index", F.lit("document")).withColumn("ord", F.lit(0))
    empty = docs.limit(0)
    written = D.write_documents(empty, docs, "skip", "ord")
    assert written.count() == 8
    assert D.count_documents(written).first()["documents"] == 8
    assert {r["content"] for r in D.scan_documents(written, "document").collect()} == set(PARAGRAPHS)


def test_null_content_fails(spark):
    df = spark.createDataFrame([("a",), (None,)], "content string")
    with pytest.raises(Exception, match="content is null"):
        D.normalize_documents(df).collect()


def test_normalize_keeps_id_and_meta(spark):
    df = spark.createDataFrame([("7", "x", {"a": "1", "lang": "old"}, "en")], "id string, body string, meta map<string,string>, lang string")
    row = D.normalize_documents(df, {"body": "content"}).first()
    assert (row["id"], row["content"], row["meta"]) == ("7", "x", {"a": "1", "lang": "en"})


def test_policies(spark):
    stored = store(spark, [("1", "a", "old", 0), ("2", "a", "old", 0), ("1", "b", "old", 0)])
    batch = store(spark, [("1", "a", "new", 1), ("3", "a", "first", 2), ("3", "a", "second", 3)])
    versions = lambda df: {(r["id"], r["index"]): r["version"] for r in df.collect()}
    kept = {("1", "a"): "old", ("2", "a"): "old", ("1", "b"): "old"}
    assert versions(D.write_documents(stored, batch, "skip", "ord")) == {**kept, ("3", "a"): "first"}
    assert versions(D.write_documents(stored, batch, "overwrite", "ord")) == {**kept, ("1", "a"): "new", ("3", "a"): "second"}
    with pytest.raises(D.DuplicateDocumentError, match="1"):
        D.write_documents(stored, batch, "fail", "ord")
    fresh = batch.where("id = '3'")
    assert versions(D.write_documents(stored, fresh, "fail", "ord")) == {**kept, ("3", "a"): "first"}


def test_uuid(spark):
    known = str(uuid.uuid4())
    df = spark.createDataFrame([("42",), (known,), (known.upper(),)], "id string")
    got = [r[0] for r in df.select(D.document_uuid(F.col("id"), "Document")).collect()]
    assert got[0] == str(uuid.UUID(hashlib.sha256(b"42Document").hexdigest()[::2]))
    assert got[1:] == [known, known.upper()]


def test_delete_intersection_and_all(spark):
    docs = store(spark, [("1", "a", "x", 0), ("2", "a", "y", 0), ("3", "a", "x", 0), ("1", "b", "x", 0)])
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    left = lambda df: {(r["id"], r["index"]) for r in df.collect()}
    assert left(D.delete_documents(docs, "a", ids, {"version": "x"})) == {("2", "a"), ("3", "a"), ("1", "b")}
    assert left(D.delete_documents(docs, "a", filters={"version": "x"})) == {("2", "a"), ("1", "b")}
    assert left(D.delete_documents(docs, "a", ids)) == {("3", "a"), ("1", "b")}
    assert left(D.delete_documents(docs, "a")) == {("1", "b")}


def test_meta_round_trip(spark):
    rows = [("1", "a", {"k": 'say "hi"\n', "n": "2"}), ("2", "a", {})]
    docs = spark.createDataFrame(rows, "id string, index string, meta map<string,string>")
    meta = D.explode_meta(docs)
    assert {(r["name"], r["value"]) for r in meta.collect()} == {("k", '"say \\"hi\\"\\n"'), ("n", '"2"')}
    back = {r["id"]: r["meta"] for r in D.collect_meta(docs, meta).collect()}
    assert set(back["1"]) == {"k", "n"} and back["2"] is None


def test_flatten_clash(spark):
    docs = spark.createDataFrame([("1", {"id": "x"})], "id string, meta map<string,string>")
    with pytest.raises(ValueError):
        D.flatten_documents(docs, ["id"])


def test_table_explode(spark):
    df = spark.createDataFrame([(1, [["a", "b"], ["1", "2"], ["3", "4"]]), (2, [["a"]])], "id int, content array<array<string>>")
    assert [(r["id"], r["row_no"], r["record"]) for r in D.table_explode(df).collect()] == [
        (1, 0, {"a": "1", "b": "2"}),
        (1, 1, {"a": "3", "b": "4"}),
    ]


def test_property_types_first_value_wins(spark):
    rows = [(1, "k", '"2020-01-02"'), (2, "k", "5"), (1, "b", "true"), (1, "l", '["x", "y"]'), (1, "s", '"2020-99-02"'), (1, "f", "1.5"), (1, "i", "[3]")]
    meta = spark.createDataFrame(rows, "ord int, name string, value string")
    got = {r["name"]: r["data_type"] for r in D.infer_property_types(meta, ["ord"]).collect()}
    assert got == {"k": "date", "b": "boolean", "l": "string[]", "s": "string", "f": "number", "i": "int[]"}


def test_labels(spark):
    rows = [("1", "a", "q", None, 0), ("2", "a", "q", True, 0)]
    labels = spark.createDataFrame(rows, "id string, index string, question string, no_answer boolean, ord int")
    new = spark.createDataFrame([("1", "a", "r", None, 1)], labels.schema)
    got = {r["id"]: (r["question"], r["no_answer"]) for r in Lb.write_labels(labels, new, "ord").collect()}
    assert got == {"1": ("r", False), "2": ("q", True)}
    assert Lb.delete_labels(labels, "a", filters={"question": ["q"]}).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(V.l2_normalize(a), V.cosine(a, b), V.dot(a, b), V.squared_l2(a, b)).collect()
    assert got[0][0] == pytest.approx([0.6, 0.8]) and tuple(got[0])[1:] == pytest.approx((0.6, 3.0, 20.0))
    assert got[1][0] == [0.0, 0.0] and tuple(got[1])[1:] == (0.0, 0.0, 1.0)


@pytest.mark.parametrize("similarity", ["cosine", "dot_product", "l2"])
@pytest.mark.parametrize("cells", [4_000_000, 30])
def test_vector_batch_against_numpy(spark, similarity, cells):
    rng = np.random.default_rng(2)
    docs, asked = rng.normal(size=(60, 5)), rng.normal(size=(14, 5))
    docs[7] = docs[3]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(docs)], "id bigint, v array<double>").repartition(4)
    q = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(asked)], "qid bigint, q array<double>")
    got = {}
    for r in N.vector_top_k_batch(d, "id", "v", q, "qid", "q", 4, similarity, block_cells=cells).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["id"]
    for i, v in enumerate(asked):
        if similarity == "l2":
            score = -((docs - v) ** 2).sum(1)
        else:
            score = docs @ v
            if similarity == "cosine":
                score = score / np.linalg.norm(docs, axis=1) / np.linalg.norm(v)
        best = sorted(range(60), key=lambda j: (-round(score[j], 9), j))[:4]
        assert [got[100 + i][r] for r in (1, 2, 3, 4)] == best
        one = N.vector_top_k(d, "id", "v", v.tolist(), 4, similarity).collect()
        assert [r["id"] for r in one] == best


def test_placeholders_repeat(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0, 2.0])], "id int, embedding array<float>")
    a, b = (D.fill_missing_embeddings(df, 2, "id").orderBy("id").collect() for _ in range(2))
    assert a == b and a[0]["is_placeholder"] and not a[1]["is_placeholder"]
    assert len(a[0]["embedding"]) == 2 and all(-1 <= x < 1 for x in a[0]["embedding"])


def test_c_tf_idf_against_model(spark):
    import math

    texts = [(0, "red red blue"), (0, "red the"), (1, "blue green"), (1, "green")]
    df = spark.createDataFrame(texts, "topic int, t string")
    got = {(r["topic"], r["word"]): r["score"] for r in T.c_tf_idf(df, ["topic"], "t", ["the"]).collect()}
    expected = {
        (0, "red"): 3 / 4 * math.log(4 / 3), (0, "blue"): 1 / 4 * math.log(4 / 2),
        (1, "blue"): 1 / 3 * math.log(4 / 2), (1, "green"): 2 / 3 * math.log(4 / 2),
    }
    assert got == pytest.approx(expected)


def test_clusters_cover_all_rows(spark, folder):
    vectors = T.vector_features(spark.read.parquet(f"{folder}/embeddings.parquet"), "embedding")
    sizes = T.topic_clusters(vectors, clusters=4).groupBy("topic").count().collect()
    assert len(sizes) == 4 and sum(r["count"] for r in sizes) == vectors.count()
    assert (T.cluster_count(0), T.cluster_count(30), T.cluster_count(None), T.cluster_count(29)) == (7, 7, 7, 29)


def test_whole_analysis(spark, folder):
    from corpusmill.plans.registered.registry import STOPWORDS, Tables

    t = Tables(spark, folder)
    result = analysis.appeals_analysis(t.appeals, "doc_id", "text", "ts", STOPWORDS, clusters=3, clip=100)
    assert result.documents.count() == 100
    assert sum(r["size"] for r in result.info.collect()) == 100
    assert result.report.count() <= 15 and result.peaks.count() == result.info.count()
    assert sum(r["frequency"] for r in result.over_time.collect()) == 100


def test_clip_sample(spark):
    df = spark.range(50).withColumnRenamed("id", "i")
    assert A.clip_sample(df, "i", 100).count() == 50
    a, b = (sorted(r["i"] for r in A.clip_sample(df.repartition(n), "i", 10).collect()) for n in (1, 5))
    assert a == b and len(a) == 10


def test_docs_per_topic_parts(spark):
    df = spark.createDataFrame([(i % 2, f"t{i}", i) for i in range(7)], "topic int, t string, i int")
    got = {(r["topic"], r["part"]): r["doc"] for r in A.docs_per_topic(df, "topic", "t", ["i"], 3).collect()}
    assert got == {(0, 0): "t0 t2 t4", (0, 1): "t6", (1, 0): "t1 t3 t5"}


def test_delimited_with_bom_and_rename(spark):
    folder = scratch_folder(spark, "bom")
    spark.createDataFrame([("﻿id;name",), ("1; Ann",), ("2;Bob",)], "value string").coalesce(1).write.text(folder)
    df = S.read_delimited(spark, folder, {"id": "key", "name": "who"}, ";")
    assert [tuple(r) for r in df.orderBy("key").collect()] == [("1", "Ann"), ("2", "Bob")]


def test_ingest_flags(spark):
    assert S.ingest_parquet(spark, "/nowhere/x.pdf", "/nowhere/y").suffix_ok is False
    folder = scratch_folder(spark, "bad") + ".csv"
    spark.createDataFrame([("a,b",), ("1,2",), ("3,4,5",)], "value string").coalesce(1).write.text(folder)
    assert S.ingest_parquet(spark, folder, scratch_folder(spark, "landed")).corrupted is True


def test_keyword_file(spark):
    folder = scratch_folder(spark, "kw")
    spark.createDataFrame([("java_2e=>java",), (" python ",), ("",)], "value string").coalesce(1).write.text(folder)
    got = {(r["keyword"], r["clean_name"]) for r in S.read_keyword_file(spark, folder).collect()}
    assert got == {("java_2e", "java"), ("python", "python")}


def test_records(spark):
    folder = scratch_folder(spark, "rec")
    spark.createDataFrame([("client:\n\noperator:\n client:",)], "value string").coalesce(1).write.text(folder)
    assert {r[0] for r in S.read_records(spark, folder).collect()} == {"client:", "operator:"}


def test_write_docs_rejects_other_formats(spark):
    with pytest.raises(ValueError):
        S.write_docs(spark.range(1), "/nowhere", ext=".xlsx")


def test_repeats_are_dropped_before_the_shuffle(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for df in (A.dedup_keep_last(docs, "text", "doc_id"), D.drop_duplicate_documents(docs.withColumnRenamed("doc_id", "id"), "id")):
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        limits = [i for i, line in enumerate(lines) if "WindowGroupLimit" in line and "Partial" in line]
        shuffle = next(i for i, line in enumerate(lines) if "Exchange" in line)
        assert limits and limits[-1] > shuffle


def test_entry_and_registry(spark):
    import __spark_entry__ as entry_point

    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_last_change_of_a_document_counts(spark):
    docs = spark.createDataFrame([("1", "i", {"a": "x"}, "v")], "id string, index string, meta map<string,string>, vector_id string")
    changes = spark.createDataFrame([("1", "i", {"b": "old"}, 1), ("1", "i", {"b": "new"}, 2)], "id string, index string, meta map<string,string>, n int")
    merged = D.update_meta_merge(docs, changes, ("id", "index"), order="n").collect()
    assert [r["meta"] for r in merged] == [{"a": "x", "b": "new"}]
    mapping = spark.createDataFrame([("1", "z", 1), ("1", "y", 2)], "id string, vector_id string, n int")
    assert [r["vector_id"] for r in D.update_vector_ids(docs, mapping, "i", order="n").collect()] == ["y"]


def test_many_topics_and_clusters(spark):
    scores = spark.createDataFrame([(t, w, 1.0) for t in range(40) for w in (f"w{t}", "all")], "topic int, word string, score double")
    got = T.topic_similarity(scores, "topic").collect()
    assert len(got) == 40 * 39 // 2 and all(abs(r["similarity"] - 0.5) < 1e-9 for r in got)
    points = T.vector_features(spark.createDataFrame([([float(i), float(i * i % 17)],) for i in range(60)], "v array<double>"), "v")
    assert T.topic_clusters(points, clusters=31).select("topic").distinct().count() > 25


def test_lines_that_do_not_fit_are_handed_over(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y,z\n3\n")
    rows = S.read_delimited(spark, str(tmp_path / "a.csv"), bad="_line").collect()
    assert {r["_line"] for r in rows} == {None, "2,y,z", "3"} and len(rows) == 3
    with pytest.raises(Exception, match="MALFORMED"):
        S.read_delimited(spark, str(tmp_path / "a.csv")).collect()


def test_document_store_replaces_one_index(spark):
    rows = [("1", "a", "x"), ("2", "b", "y"), ("3", "a", None), ("4", None, "z")]
    df = spark.createDataFrame(rows, "id string, index string, content string")
    path = scratch_folder(spark, "store")
    S.save_documents(df, path)

    def stored(index=None):
        return sorted(tuple(r) for r in S.load_documents(spark, path, df.schema, index).collect())

    assert stored() == sorted(rows)
    assert stored("a") == [rows[0], rows[2]]
    own = S.load_documents(spark, path, df.schema, "a")
    S.replace_index(own.where("id = '1'").withColumn("content", F.lit("new")), path)
    assert stored() == [("1", "a", "new"), rows[1], rows[3]]
    S.replace_index(df.where("id = '9'"), path)
    assert len(stored()) == 3


def test_a_model_encodes_only_what_the_filter_lets_through(spark):
    rows = [(i, "x" * (i % 7), "en" if i % 2 else "fr", [9.0, 9.0] if i % 3 == 0 else None) for i in range(60)] + [(60, None, "en", None), (61, "", "en", None)]
    df = spark.createDataFrame(rows, "id int, t string, lang string, embedding array<double>")

    def load():
        def model(texts):
            assert len(texts) <= 4 and all(t is not None for t in texts) and max(map(len, texts)) - min(map(len, texts)) <= 6
            return np.array([[len(t), 1.0] for t in texts])

        return model

    def plain(row, only_missing):
        _, text, lang, old = row
        return old if lang != "en" or text is None or only_missing and old is not None else [float(len(text)), 1.0]

    for only_missing in (False, True):
        found = D.encode_embeddings(df, "t", load, {"lang": "en"}, "dot_product", only_missing, 4)
        assert found.columns == df.columns
        assert {r["id"]: r["embedding"] for r in found.collect()} == {row[0]: plain(row, only_missing) for row in rows}
    unit = D.encode_embeddings(df.drop("embedding"), "t", load, batch_size=4).where("id = 3").first()["embedding"]
    assert unit == pytest.approx([3 / 10**0.5, 1 / 10**0.5])
    assert D.encode_embeddings(df.limit(0), "t", load).collect() == []
