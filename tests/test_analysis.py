"""The whole analysis: what it writes on the way, and that shared counts and models give the rows of separate ones."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from corpusmill.operators import topics as T
from corpusmill.plans import analysis
from corpusmill.session import cut_lineage

SCHEMA = "id bigint, body string, at timestamp"


def messages():
    rng = random.Random(5)
    themes = [["salt", "sea", "wave", "shore", "gull"], ["iron", "forge", "anvil", "spark", "coal"], ["wheat", "plough", "barn", "seed", "hay"]]
    start = dt.datetime(2024, 1, 1)
    rows = [(i, " ".join(rng.choices(themes[i % 3], k=rng.randint(4, 12)) + [f"w{i}", "the", "year"]), start + dt.timedelta(hours=5 * i)) for i in range(90)]
    # A repeated text, a repeated row, a repeated id, unknown values, texts without words.
    odd = [(90, rows[3][1], start), rows[7], (8, "salt salt iron seed", start), (91, None, start), (92, "sea wave", None), (None, "gull shore sea", start), (93, "", start), (94, "! ?", start)]
    return rows + odd


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_texts_are_written_twice_at_most_and_counted_once(spark, monkeypatch):
    written, counted = [], []

    def cut(df):
        written.append(df.columns)
        return cut_lineage(df)

    def tokens(*args, **kwargs):
        counted.append(args)
        return vocab_tokens(*args, **kwargs)

    vocab_tokens = T.vocab_tokens
    for module in (analysis, T):
        monkeypatch.setattr(module, "cut_lineage", cut)
    monkeypatch.setattr(T, "vocab_tokens", tokens)
    df = spark.createDataFrame(messages(), SCHEMA)
    analysis.appeals_analysis(df, "id", "body", "at", ["the"], clusters=3)
    assert sum("silo" in columns or "body" in columns for columns in written) == 2
    # For the counts the models learn from, for the features, and for the words of topics and cells together.
    assert len(counted) == 3


def test_report_as_by_separate_steps(spark):
    df = spark.createDataFrame(messages(), SCHEMA)
    ready = cut_lineage(analysis.prepare(df, "id", "body", "at", stopwords=["the"]))
    featured = cut_lineage(T.text_features(ready, "silo", ["the"]))
    reduced = cut_lineage(T.vector_features(T.reduce_dimensions(featured), "reduced", "_point").drop("features", "reduced"))
    labelled = cut_lineage(T.topic_clusters(reduced, "_point", 3).drop("_point"))
    words = T.top_words(T.c_tf_idf(labelled, ["topic"], "silo", ["the"]), ["topic"], 5)
    over_time = T.topics_over_time(labelled, "topic", "silo", "at", ["the"])
    got = analysis.appeals_analysis(df, "id", "body", "at", ["the"], clusters=3)
    assert rows_of(got.report) == rows_of(T.topic_report(T.topic_info(labelled, "topic", words), words, "topic"))
    assert rows_of(got.over_time) == rows_of(over_time)
    assert rows_of(got.documents) == rows_of(labelled) and got.documents.columns == labelled.columns
    assert rows_of(got.peaks) == rows_of(T.peak_per_topic(over_time, "topic"))


def test_one_cluster(spark):
    got = analysis.appeals_analysis(spark.createDataFrame(messages(), SCHEMA), "id", "body", "at", ["the"], clusters=1)
    n = got.documents.count()
    assert [(r["topic"], r["size"]) for r in got.info.collect()] == [(0, n)]
    assert got.report.count() == 5 and sum(r["frequency"] for r in got.over_time.collect()) == n


@pytest.mark.parametrize("ngrams", [(1, 1), (1, 2)])
def test_counts_of_finer_groups(spark, ngrams):
    rows = [(0, 0, "red red blue"), (0, 1, "red the sky"), (1, 0, "blue green"), (1, None, "green"), (None, 1, "red sky"), (1, 1, None)]
    df = spark.createDataFrame(rows, "topic int, bin int, t string")
    cells = T.word_counts(df, ["topic", "bin"], "t", ["the"], ngrams)
    for group in (["topic"], ["bin"], ["topic", "bin"]):
        got = T.c_tf_idf(df, group, "t", ["the"], ngrams, counts=cells)
        assert rows_of(got) == rows_of(T.c_tf_idf(df, group, "t", ["the"], ngrams))


def test_features_by_a_known_rarity(spark):
    df = spark.createDataFrame(messages(), SCHEMA).where("body IS NOT NULL")
    counted = T.hashed_counts(df, "body", ["the"]).select("_tf")
    rarity = T.word_rarity(counted)
    alone = T.text_features(df, "body", ["the"])
    assert rows_of(T.text_features(df, "body", ["the"], rarity=rarity)) == rows_of(alone)
    assert rows_of(T.weigh_counts(counted, rarity)) == rows_of(alone.select("features"))
