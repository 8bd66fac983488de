"""Ranked search that reads only the blocks of a stored index that can hold one of the k best documents.

Documents are numbered in the order of their ids and cut into blocks. The postings are stored as a
row for each (token, block), with the greatest count and the smallest document length there, which bound what the
token can add to any document of the block, and the first and last id. A query first scores the blocks with the greatest
bounds, which gives a score that the k-th best document has at least; then it reads the blocks whose bound reaches
that score, and no others. The result is that of scoring everything.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.running import ordinal
from corpusmill.functions.text import index_tokens
from corpusmill.operators import bm25 as B
from corpusmill.session import cut_lineage, small_side

BLOCK_DOCS = 4096
# So many blocks are named in the filter of the scan, which then skips the rest; more are joined.
NAMED_BLOCKS = 5_000
# Scores that far apart are ties.
_TIE = 10.0**-B.TIE_PLACES * 4


@dataclass(frozen=True)
class BlockIndex:
    """A stored index whose postings have a block, and the bounds of the blocks."""

    index: B.SearchIndex
    blocks: DataFrame


def save_block_index(df: DataFrame, id_col: str, text: str, path: str, tokens: B.Tokenizer = index_tokens, block_docs: int = BLOCK_DOCS) -> None:
    """Write postings, vocabulary, totals and blocks of ``df`` below ``path``. Ids are unique and not null."""
    placed = ordinal(df.select(id_col), [id_col], "_place")
    block = F.floor((F.col("_place") - 1) / block_docs).cast("bigint")
    docs = df.select(id_col, F.col(text).alias("_text")).join(placed, id_col)
    keyed = docs.select(F.struct(F.col(id_col).alias("id"), block.alias("block")).alias("_doc"), "_text")
    postings = B.inverted_index(keyed, "_doc", "_text", tokens)
    flat = postings.select("token", F.col("_doc.block").alias("block"), F.col("_doc.id").alias(id_col), "tf", "doc_len")
    # Ranges hold whole (token, block) groups: these are put together without another shuffle.
    ranged = flat.repartitionByRange("token", "block")
    packed = ranged.groupBy("token", "block").agg(
        F.max("tf").alias("most"),
        F.min("doc_len").alias("shortest"),
        F.min(id_col).alias("first_id"),
        F.max(id_col).alias("last_id"),
        F.count(F.lit(1)).alias("docs"),
        F.sum("tf").alias("n"),
        F.array_sort(F.collect_list(F.struct(id_col, "tf", "doc_len"))).alias("rows"),
    )
    packed.sortWithinPartitions("token", "block").write.mode("overwrite").parquet(os.path.join(path, "postings"))
    stored = df.sparkSession.read.parquet(os.path.join(path, "postings"))
    words = stored.groupBy("token").agg(F.sum("docs").alias("df"), F.sum("n").alias("n"))
    ids = placed.agg(F.count(F.lit(1)).alias("doc_count"), F.count_distinct(id_col).alias("ids")).first()
    unique = ids["doc_count"] == ids["ids"]
    # Of unique ids every text is counted where its postings are; else the texts are read again.
    B._save_numbers(words, df.agg(F.count(F.lit(1)).alias("doc_count")) if unique else B.corpus_totals(df, text, tokens), path)


def load_block_index(spark: SparkSession, path: str, id_col: str) -> BlockIndex:
    """A stored row is a (token, block) with its bounds and its postings; a reader of bounds reads no postings."""
    index = B.load_index(spark, path, id_col)
    postings = index.postings.select("token", "block", F.explode("rows").alias("_row")).select("token", "block", "_row.*")
    return BlockIndex(B.SearchIndex(postings, index.vocabulary, index.totals, id_col), index.postings.drop("n", "rows"))


def _weights(index: B.SearchIndex, query: Sequence[str], model: B.Okapi | B.Probabilistic) -> tuple[dict[str, float], float]:
    """What each query term weighs, and the mean length; terms that no document holds are left out."""
    if isinstance(model, B.Plus):
        raise ValueError("this variant scores every document; use score()")
    wanted = Counter(term.lower().strip() for term in query)
    totals = index.totals.first()
    n = float(totals["doc_count"])
    out = {}
    for row in index.vocabulary.where(F.col("token").isin(list(wanted))).collect():  # a row for each term at most
        if isinstance(model, B.Okapi):
            raw = math.log(n - row["df"] + 0.5) - math.log(row["df"] + 0.5)
            idf = totals["mean_idf"] * model.epsilon if raw < 0 else raw
        else:
            idf = math.log(1.0 + (n - row["df"] + 0.5) / (row["df"] + 0.5))
        out[row["token"]] = idf * wanted[row["token"]]
    return out, totals["mean_len"]


def _sum_of_parts(weights: dict[str, float], model: B.Okapi | B.Probabilistic, tf: Column, length: Column, mean_len: float) -> Column:
    weight = F.lit(0.0)
    for token, value in weights.items():
        weight = F.when(F.col("token") == token, F.lit(value)).otherwise(weight)
    return F.sum(weight * B._part(model, tf.cast("double"), length, F.lit(mean_len)))


def block_bounds(blocks: BlockIndex, weights: dict[str, float], mean_len: float, model: B.Okapi | B.Probabilistic) -> DataFrame:
    """(block, bound, docs): what a document of the block scores at most, and how many have a query term at least."""
    own = blocks.blocks.where(F.col("token").isin(list(weights)))
    # A term of negative weight adds nothing to a bound.
    bound = _sum_of_parts({t: max(w, 0.0) for t, w in weights.items()}, model, F.col("most"), F.col("shortest"), mean_len)
    return own.groupBy("block").agg(bound.alias("bound"), F.max("docs").alias("docs"))


@dataclass(frozen=True)
class Found:
    """(document, score) of the best documents that hold a query term, and how many blocks were read, of how many."""

    best: DataFrame
    read: int
    blocks: int


def best_documents(blocks: BlockIndex, query: Sequence[str], k: int, model: B.Okapi | B.Probabilistic = B.Okapi()) -> Found:
    """The k best of the documents that hold a query term; score, then id. A query without known terms finds none."""
    index = blocks.index
    weights, mean_len = _weights(index, query, model)
    postings = index.postings.where(F.col("token").isin(list(weights)))
    score = _sum_of_parts(weights, model, F.col("tf"), F.col("doc_len"), mean_len)
    ranked = lambda rows: rows.groupBy(index.id_col).agg(score.alias("score")).orderBy(*B._best_first("score", index.id_col)).limit(k)
    bounds = cut_lineage(block_bounds(blocks, weights, mean_len, model))
    many, least = bounds.count(), None
    named, docs = [], 0
    for row in bounds.orderBy(F.desc("bound"), "block").limit(k).collect():  # k blocks hold k documents or more
        named.append(row["block"])
        docs += row["docs"]
        if docs >= k:
            break
    seen = ranked(postings.where(F.col("block").isin(named))).agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
    if seen["n"] == k:
        least = seen["least"] - _TIE
    passing = bounds if least is None else bounds.where(F.col("bound") >= least)
    head = [row["block"] for row in passing.select("block").limit(NAMED_BLOCKS + 1).collect()]
    if least is None:
        read, rows = many, postings
    elif len(head) <= NAMED_BLOCKS:
        read, rows = len(head), postings.where(F.col("block").isin(head))
    else:
        read, rows = passing.count(), postings.join(small_side(passing.select("block")), "block", "left_semi")
    return Found(cut_lineage(ranked(rows)), read, many)


def top_k_by_blocks(
    blocks: BlockIndex,
    df: DataFrame,
    query: Sequence[str],
    time: str,
    k: int = 5,
    topic_col: str | None = None,
    topics: Sequence[int] | None = None,
    start: Any = None,
    end: Any = None,
    model: B.Okapi | B.Probabilistic = B.Okapi(),
) -> DataFrame:
    """As ``bm25.top_k`` for the indexed documents ``df``. Only if fewer than k score above zero are other ids read."""
    id_col = blocks.index.id_col
    best = best_documents(blocks, query, k, model).best
    above = best.where(F.round("score", B.TIE_PLACES) > 0)
    if best.where(F.round("score", B.TIE_PLACES) < 0).limit(1).count():
        return B.top_k_with_index(blocks.index, df, query, time, k, topic_col, topics, start, end, model)
    found = above.count()
    if found < k:
        rest = df.select(id_col).join(small_side(above), id_col, "left_anti").orderBy(id_col).limit(k - found)
        above = cut_lineage(above.unionByName(rest.withColumn("score", F.lit(0.0))))
    joined = B.with_scores(df, above, id_col)
    return B._of_topics_and_dates(joined, id_col, time, topic_col, topics, start, end)
