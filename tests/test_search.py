from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import blockmax
from corpusmill.operators import bm25 as B
from corpusmill.operators import vectors as V
from corpusmill.session import scratch_folder

RNG = random.Random(5)
WORDS = ["tea", "cup", "the", "milk", "sugar", "pot", "hot"]
# One word is in most documents, so that its idf is negative; some documents are equal.
DOCS = [" ".join(["the"] * RNG.randint(0, 3) + [RNG.choice(WORDS) for _ in range(RNG.randint(1, 9))]) for _ in range(18)]
DOCS += [DOCS[0], "the  the", "Milk_tea \n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i % 3, 100 - i) for i, t in enumerate(DOCS)]
    return spark.createDataFrame(rows, "id bigint, t string, topic int, ts int").repartition(3).cache()


def tokens(text):
    return [x.strip() for x in text.strip().lower().replace("_", " ").split(" ")]


def model_scores(query, kind, docs=DOCS):
    corpus = [tokens(t) for t in docs]
    n, mean = len(corpus), sum(map(len, corpus)) / len(corpus)
    df = {}
    for doc in corpus:
        for w in set(doc):
            df[w] = df.get(w, 0) + 1
    if kind == "okapi":
        idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
        floor = 0.25 * sum(idf.values()) / len(idf)
        idf = {w: floor if x < 0 else x for w, x in idf.items()}
    elif kind == "plus":
        idf = {w: math.log(n + 1) - math.log(d + 0.5) for w, d in df.items()}
    else:
        idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    k1, b = (1.2, 0.75) if kind == "prob" else (1.5, 0.75)
    out = []
    for doc in corpus:
        total = 0.0
        for q in query:
            tf = doc.count(q)
            shape = 1 - b + b * len(doc) / mean
            if kind == "plus":
                c = tf / shape + 0.5
                total += idf.get(q, 0.0) * (k1 + 1) * c / (k1 + c)
            else:
                total += idf.get(q, 0.0) * tf * (k1 + 1) / (tf + k1 * shape)
        out.append(total)
    return out


QUERY = ["the", "tea", "tea", "absent", "milk"]


@pytest.mark.parametrize("kind,model", [("okapi", B.Okapi()), ("plus", B.Plus()), ("prob", B.Probabilistic())])
def test_scores_against_model(docs, kind, model):
    got = {r["id"]: r["score"] for r in B.score(docs, "t", QUERY, model).collect()}
    for i, expected in enumerate(model_scores(QUERY, kind)):
        assert got[i] == pytest.approx(expected, abs=1e-9)


def test_inverted_index_and_frequency(docs):
    got = {(r["token"], r["id"]): (r["tf"], r["doc_len"]) for r in B.inverted_index(docs, "id", "t").collect()}
    expected = {(w, i): (tokens(t).count(w), len(tokens(t))) for i, t in enumerate(DOCS) for w in tokens(t)}
    assert got == expected


def test_stored_index_scores_like_the_scan(spark, docs):
    folder = scratch_folder(spark, "index")
    B.save_index(B.build_index(docs, "id", "t"), folder)
    index = B.load_index(spark, folder, "id")
    for kind, model in (("okapi", B.Okapi()), ("prob", B.Probabilistic())):
        expected = model_scores(QUERY, kind)
        got = {r["id"]: r["score"] for r in B.score_with_index(index, QUERY, model).collect()}
        assert got.keys() == {i for i, t in enumerate(DOCS) if set(tokens(t)) & set(QUERY)}
        for i, score in got.items():
            assert score == pytest.approx(expected[i], abs=1e-9)


def test_top_k_filters_after_ranking_and_sorts_by_time(docs):
    scores = model_scores(QUERY, "okapi")
    best = sorted(range(len(DOCS)), key=lambda i: (-round(scores[i], 9), i))[:8]
    expected = [i for i in sorted(best, key=lambda i: (100 - i, i)) if i % 3 in (0, 1) and 85 <= 100 - i <= 98]
    got = B.top_k(docs, "id", "t", QUERY, "ts", 8, "topic", [0, 1], 85, 98).collect()
    assert [r["id"] for r in got] == expected


def test_search_filters_before_ranking(docs):
    scores = model_scores(["tea", "milk"], "prob")
    allowed = [i for i in range(len(DOCS)) if i % 3 == 1 and set(tokens(DOCS[i])) & {"tea", "milk"}]
    got = B.search(docs, "id", "t", ["tea", "milk"], {"topic": 1}, 4).collect()
    assert [r["id"] for r in got] == sorted(allowed, key=lambda i: (-round(scores[i], 9), i))[:4]
    both = B.search(docs, "id", "t", ["tea", "milk"], None, 50, all_terms=True).collect()
    assert {r["id"] for r in both} == {i for i in range(len(DOCS)) if {"tea", "milk"} <= set(tokens(DOCS[i]))}
    with pytest.raises(ValueError):
        B.search(docs, "id", "t")
    assert [r["id"] for r in B.search(docs, "id", "t", None, {"topic": 2}, 2).collect()] == [2, 5]


@pytest.mark.parametrize("limits", [{}, {"term_limit": 0}, {"query_limit": 0}])
def test_batch_paths(spark, docs, limits):
    texts = ["tea milk", "the the hot", "absent", "sugar"]
    queries = spark.createDataFrame([(10 + i, q) for i, q in enumerate(texts)], "qid bigint, q string")
    found = B.search_batch(docs, "id", "t", queries, "qid", "q", 3, **limits).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["qid"], r["rank"])):
        got.setdefault(r["qid"], []).append((r["id"], round(r["score"], 6)))
    expected = {}
    for i, q in enumerate(texts):
        terms = tokens(q)
        scores = model_scores(terms, "prob")
        hits = [d for d in range(len(DOCS)) if set(tokens(DOCS[d])) & set(terms)]
        best = sorted(hits, key=lambda d: (-round(scores[d], 9), d))[:3]
        if best:
            expected[10 + i] = [(d, round(scores[d], 6)) for d in best]
    assert got == expected


@pytest.mark.parametrize("limits", [{}, {"term_limit": 0}])
def test_batch_filters_all_terms_text_ids_and_null_texts(spark, limits):
    texts = [*DOCS, None, "tea milk"]
    names = [f"d{i:02}" for i in range(len(texts))]
    df = spark.createDataFrame([(n, t, i % 3) for i, (n, t) in enumerate(zip(names, texts))], "id string, t string, topic int").repartition(3)
    asked = {"a": "tea milk", "b": "the tea", "c": "hot absent", "d": "tea"}
    queries = spark.createDataFrame(list(asked.items()), "qid string, q string")
    filters = [{"topic": 1}, None, None, {"topic": [0, 2]}]
    topics = {"a": {1}, "b": {0, 1, 2}, "c": {0, 1, 2}, "d": {0, 2}}
    whole = [t or "" for t in texts]
    for all_terms in (False, True):
        found = B.search_batch(df, "id", "t", queries, "qid", "q", 4, filters, all_terms=all_terms, **limits).collect()
        got = {}
        for r in sorted(found, key=lambda r: (r["qid"], r["rank"])):
            got.setdefault(r["qid"], []).append((r["id"], round(r["score"], 6)))
        expected = {}
        for name, q in asked.items():
            terms = set(tokens(q))
            scores = model_scores(tokens(q), "prob", whole)
            fits = terms.issubset if all_terms else lambda own, terms=terms: terms & set(own)
            hits = [i for i in range(len(texts)) if i % 3 in topics[name] and fits(tokens(whole[i]))]
            best = sorted(hits, key=lambda i: (-round(scores[i], 9), i))[:4]
            if best:
                expected[name] = [(names[i], round(scores[i], 6)) for i in best]
        assert got == expected
    with pytest.raises(ValueError):
        B.search_batch(df, "id", "t", queries, "qid", "q", 4, [{"topic": 1}])


def test_null_text_scores_nothing(spark):
    df = spark.createDataFrame([(1, "tea"), (2, None)], "id int, t string")
    assert {r["id"]: r["score"] for r in B.score(df, "t", ["tea"], B.Probabilistic()).collect()}[2] == 0


def test_vectors_of_another_length_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0])], "id bigint, v array<double>")
    queries = spark.createDataFrame([(7, [1.0, 0.0])], "qid bigint, v array<double>")
    for similarity in ("cosine", "l2"):
        assert [r["id"] for r in V.vector_top_k(df, "id", "v", [1.0, 0.0], 5, similarity).collect()] == [1, 3]
        assert [r["id"] for r in V.vector_top_k_batch(df, "id", "v", queries, "qid", "v", 5, similarity).orderBy("rank").collect()] == [1, 3]
    longer = df.union(spark.createDataFrame([(4, [1.0, 0.0, 0.0])], df.schema))
    with pytest.raises(Exception, match="3 numbers"):
        V.vector_top_k(longer, "id", "v", [1.0, 0.0]).collect()
    with pytest.raises(Exception, match="3 numbers"):
        V.vector_top_k_batch(longer, "id", "v", queries, "qid", "v").collect()


def test_no_shuffle_of_documents_when_scoring(docs):
    plan = B.score(docs, "t", ["tea"], B.Probabilistic())._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main


def by_comma(text):
    return F.filter(F.split(F.lower(text), ","), lambda word: word != "")


def test_stored_index_ranks_like_the_scan(spark, docs):
    folder = scratch_folder(spark, "index")
    B.save_index(B.build_index(docs, "id", "t"), folder)
    index = B.load_index(spark, folder, "id")
    asked = (QUERY, "ts", 8, "topic", [0, 1], 85, 98)
    rows = [[(r["id"], r["topic"], round(r["score"], 9)) for r in df.collect()] for df in (B.top_k_with_index(index, docs, *asked), B.top_k(docs, "id", "t", *asked))]
    assert rows[0] == rows[1]
    # More than there are hits: documents without a query term follow, by id.
    assert [r["id"] for r in B.top_k_with_index(index, docs, ["sugar"], "id", 1_000).collect()] == list(range(len(DOCS)))
    for asked in ((["tea", "milk"], {"topic": 1}, 4), (["tea", "milk"], None, 50, True), (["absent"], None, 3)):
        got = [(r["id"], round(r["score"], 9)) for r in B.search_with_index(index, docs, *asked).collect()]
        assert got == [(r["id"], round(r["score"], 9)) for r in B.search(docs, "id", "t", *asked).collect()]


def test_a_tokenizer_of_ones_own(spark):
    df = spark.createDataFrame([(1, "Green Tea,milk"), (2, "tea,milk,milk"), (3, ","), (4, None)], "id bigint, t string")
    index = B.build_index(df, "id", "t", by_comma)
    assert {(r["token"], r["id"], r["tf"], r["doc_len"]) for r in index.postings.collect()} == {("green tea", 1, 1, 2), ("milk", 1, 1, 2), ("tea", 2, 1, 3), ("milk", 2, 2, 3)}
    assert [r["id"] for r in B.search(df, "id", "t", ["green tea"], tokens=by_comma).collect()] == [1]
    assert [r["id"] for r in B.search_with_index(index, df, ["green tea"]).collect()] == [1]
    queries = spark.createDataFrame([(7, "green tea,tea")], "qid bigint, q string")
    for limits in ({}, {"term_limit": 0}):
        found = B.search_batch(df, "id", "t", queries, "qid", "q", tokens=by_comma, **limits).orderBy("rank").collect()
        assert [r["id"] for r in found] == [1, 2]


def test_search_by_blocks_reads_few_and_finds_the_same(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["tea", "milk", *"abcdefgh"]) for _ in range(rnd.randint(0, 30))), i % 4) for i in range(400)]
    rows += [(1_000 + i, "tea " * 9 + "sugar", i) for i in range(3)] + [(2_000, None, 1), (2_001, "", 2)]
    df = spark.createDataFrame(rows, "id bigint, t string, topic int")
    folder = scratch_folder(spark, "blocks")
    blockmax.save_block_index(df, "id", "t", folder, block_docs=8)
    blocks = blockmax.load_block_index(spark, folder, "id")
    shown = lambda found: [(r["id"], round(r["score"], 9)) for r in found.collect()]
    for query in (["tea"], ["tea", "sugar", "tea"], ["milk", "a", "zzz"], ["sugar"], ["zzz"], []):
        for k in (1, 3, 10, 500):
            for model in (B.Okapi(), B.Probabilistic()):
                assert sorted(shown(blockmax.top_k_by_blocks(blocks, df, query, "id", k, model=model))) == sorted(shown(B.top_k(df, "id", "t", query, "id", k, model=model))), (query, k)
    found = blockmax.best_documents(blocks, ["tea", "sugar"], 3)
    assert {r["id"] for r in found.best.collect()} == {1_000, 1_001, 1_002}
    assert found.blocks > 40 and found.read <= 3
    at_two = blockmax.top_k_by_blocks(blocks, df, ["tea"], "id", 50, "topic", [2])
    assert shown(at_two) == shown(B.top_k(df, "id", "t", ["tea"], "id", 50, "topic", [2]))


def test_batch_of_vectors_without_queries_ids_or_vectors(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (None, [1.0, 0.0]), (4, None)], "id bigint, v array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.1]), (None, [1.0, 0.0]), (9, None)], "q bigint, v array<double>")
    found = V.vector_top_k_batch(docs, "id", "v", asked, "q", "v", 5)
    assert [(r["q"], r["rank"], r["id"]) for r in found.orderBy("q", "rank").collect()] == [(7, 1, 1), (7, 2, 2)]
    none = V.vector_top_k_batch(docs, "id", "v", asked.limit(0), "q", "v", 5)
    assert none.collect() == [] and none.columns == found.columns
    one_by_one = V.vector_top_k_batch(docs, "id", "v", spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "q bigint, v array<double>"), "q", "v", 1, block_cells=2)
    assert one_by_one.count() == 5


def test_a_stored_index_is_counted_from_its_postings(spark, monkeypatch):
    """Vocabulary, mean length and the found documents read the texts again before, and shuffled them below a join."""
    texts = ["tea and tea", "milk", "", None, "tea with milk", "sugar"]
    left = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "id bigint, t string, topic int")
    df = left.join(spark.createDataFrame([(i, i) for i in range(6)], "id bigint, ts bigint"), "id")
    expected = B.corpus_totals(df, "t").first()
    folder = scratch_folder(spark, "index")
    built = B.build_index(df, "id", "t")
    # A vocabulary that is read from the texts once more fails here.
    failing = spark.range(1).select(F.raise_error(F.lit("texts read again")).cast("string").alias("token"), F.lit(1).cast("bigint").alias("df"))
    B.save_index(B.SearchIndex(built.postings, failing, built.totals, "id"), folder)
    index = B.load_index(spark, folder, "id")
    stored = index.totals.first()
    assert (stored["doc_count"], stored["token_count"], stored["mean_len"]) == tuple(expected)
    assert index.vocabulary.columns == ["token", "df"]
    assert sorted(map(tuple, index.vocabulary.collect())) == sorted(map(tuple, B.document_frequency(df, "t").collect()))
    found = B.top_k_with_index(index, df, ["tea", "sugar"], "ts", 3)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, B.top_k(df, "id", "t", ["tea", "sugar"], "ts", 3).collect()))
    # The ids found are a filter below the join, on both of its sides.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" IN ") + plan.count(" INSET ") >= 2
    blocks = scratch_folder(spark, "blocks")
    blockmax.save_block_index(df, "id", "t", blocks, block_docs=2)
    assert {"rows", "most", "docs"} <= set(spark.read.parquet(f"{blocks}/postings").columns)
