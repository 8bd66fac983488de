"""From a table of messages to topics, their words, their course over time, and a search index."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import clean_silo
from corpusmill.operators import appeals, bm25, topics
from corpusmill.operators.filters import drop_nulls
from corpusmill.operators.keywords import highlight
from corpusmill.operators.timelines import daily_volume_share, keyword_postings, keyword_rank, keyword_spikes, word_features
from corpusmill.session import cut_lineage


@dataclass(frozen=True)
class Analysis:
    documents: DataFrame
    info: DataFrame
    words: DataFrame
    over_time: DataFrame
    peaks: DataFrame
    report: DataFrame
    index: bm25.SearchIndex


def prepare(
    df: DataFrame,
    id_col: str,
    text: str,
    time: str,
    separators: Sequence[str] = (":",),
    stopwords: Sequence[str] = (),
    clip: int | None = None,
) -> DataFrame:
    """Drop nulls, clean, keep the last of equal texts. All rows stay unless a sample of ``clip`` is asked for."""
    known = drop_nulls(df, text, time).withColumn("silo", clean_silo(F.col(text), separators, stopwords))
    unique = appeals.dedup_keep_last(known, "silo", id_col)
    if clip is None:
        return unique
    # A sorted limit ends in one partition; the sample is spread again for the work on its words.
    return appeals.clip_sample(unique, id_col, clip).repartition(df.sparkSession.sparkContext.defaultParallelism, id_col)


def appeals_analysis(
    df: DataFrame,
    id_col: str,
    text: str,
    time: str,
    stopwords: Sequence[str] = (),
    clusters: int | None = None,
    clip: int | None = None,
    seed: int = 42,
) -> Analysis:
    """The whole flow. Models read their input many times, so it is written first: the prepared rows, the word counts
    that the models of the features learn from, without texts, and the rows with their points for the clustering.
    """
    ready = cut_lineage(prepare(df, id_col, text, time, stopwords=stopwords, clip=clip))
    counted = cut_lineage(topics.hashed_counts(ready, "silo", stopwords).select("_tf"))
    rarity = topics.word_rarity(counted)
    featured = topics.text_features(ready, "silo", stopwords, rarity=rarity)
    placed = topics.reduce_dimensions(featured, learned_from=topics.weigh_counts(counted, rarity))
    reduced = cut_lineage(topics.vector_features(placed, "reduced", "_point").drop("features", "reduced"))
    # The nearest of a few centres is found again wherever the topic is read; that takes less than another copy of the texts.
    labelled = topics.topic_clusters(reduced, "_point", clusters, seed).drop("_point")
    # Counted once for both: the words of a topic are those of its time cells.
    cells = topics.word_counts(topics.with_time_bins(labelled, time), ["topic", "bin"], "silo", stopwords)
    scores = topics.c_tf_idf(labelled, ["topic"], "silo", stopwords, counts=cells)
    words = topics.top_words(scores, ["topic"], 5)
    info = topics.topic_info(labelled, "topic", words)
    over_time = topics.topics_over_time(labelled, "topic", "silo", time, stopwords, counts=cells)
    report = topics.topic_report(info, words, "topic")
    by_date = appeals.sort_by_date(labelled, time, id_col)
    return Analysis(by_date, info, words, over_time, topics.peak_per_topic(over_time, "topic"), report, bm25.build_index(labelled, id_col, "silo"))


def topic_examples(
    df: DataFrame,
    id_col: str,
    text: str,
    raw: str,
    time: str,
    topic_col: str,
    topic: int,
    query: Sequence[str],
    prefixes: Sequence[str],
    start: Any = None,
    end: Any = None,
    k: int = 250,
    index: bm25.SearchIndex | None = None,
) -> DataFrame:
    """Highlighted examples of a topic for its name's words, in the date range; ranked by a stored index if there is one."""
    if index is None:
        best = bm25.top_k(df, id_col, text, query, time, k, topic_col, [topic], start, end)
    else:
        best = bm25.top_k_with_index(index, df, query, time, k, topic_col, [topic], start, end)
    return highlight(best, raw, query, prefixes).withColumn("score", F.lit(0.5)).orderBy(time, id_col)


def topic_keyword_lines(
    df: DataFrame, text: str, time: str, topic_col: str, topic: int, stopwords: Sequence[str] = (), start: Any = None, end: Any = None
) -> DataFrame:
    """Spikes, over all documents, of the words that rank best in one topic."""
    ranked = keyword_rank(word_features(df.where(F.col(topic_col) == topic), text, stopwords))
    postings = keyword_postings(df, text, time, [word for word, _ in ranked], start, end)
    return daily_volume_share(keyword_spikes(postings), df, time)
