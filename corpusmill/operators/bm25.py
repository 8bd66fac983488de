"""Lexical search with BM25.

Two ways to score:

* Without an index: a query has few terms, so each document's counts of those terms are taken from
  its own tokens. The scan needs no shuffle; the corpus numbers come from one-row aggregates.
* With an index: ``build_index`` gives one row per (token, document); ``save_index`` stores it ranged
  by token, so a query reads only the row groups of its terms, and a frequent token spans many files.
  ``top_k_with_index`` and ``search_with_index`` rank the ids and read the documents of the winners.

Texts are cut by ``tokens``, a column function from text to an array of tokens; an index and its queries
have to use the same one. Every collection number (documents, mean length, document frequency) covers the whole table.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import index_tokens, let
from corpusmill.operators.filters import FilterTerm, Resolver, filter_documents
from corpusmill.operators.keywords import highlight
from corpusmill.session import cut_lineage

# Above this many query terms, or queries, a batch is scored by joins instead of inside the scan.
BATCH_TERM_LIMIT = 20_000
BATCH_QUERY_LIMIT = 2_000
# So many found documents are named in the filter of the scan; more are joined only.
NAMED_DOCUMENTS = 1_000


# Scores that agree to this many places are ties, decided by id: equal texts must not be ordered by
# the rounding of their sums.
TIE_PLACES = 9


def _best_first(score: str, id_col: str) -> list[Column]:
    return [F.round(score, TIE_PLACES).desc(), F.col(id_col)]


@dataclass(frozen=True)
class Okapi:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


@dataclass(frozen=True)
class Plus:
    """The variant that also credits documents without the term."""

    k1: float = 1.5
    b: float = 0.75
    delta: float = 0.5


@dataclass(frozen=True)
class Probabilistic:
    """Positive idf ``ln(1 + (N - df + .5) / (df + .5))``, used by the filtered search."""

    k1: float = 1.2
    b: float = 0.75


Model = Okapi | Plus | Probabilistic
Tokenizer = Callable[[Column], Column]


# --- index ----------------------------------------------------------------------------------------


def _tokens(text: str, tokens: Tokenizer) -> Column:
    """The tokens of a text; a null text is the empty text."""
    return tokens(F.coalesce(F.col(text), F.lit("")))


def inverted_index(df: DataFrame, id_col: str, text: str, tokens: Tokenizer = index_tokens) -> DataFrame:
    """(token, document, tf, doc_len); counted inside each document, so nothing is shuffled.

    A document's tokens are sorted and cut into runs of equal tokens within its own row.
    """

    def starts(words: Column) -> Column:
        changes = lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1))
        # A custom tokenizer may give no token at all.
        return F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(0), F.size(words) - 1), changes)).otherwise(F.array().cast("array<int>"))

    def runs(words: Column) -> Column:
        size = F.size(words)

        def cut(first: Column) -> Column:
            # As many ends as starts, also where there is none.
            ends = F.slice(F.concat(F.slice(first, 2, F.size(first)), F.array(size)), 1, F.size(first))
            run = lambda start, end: F.struct(
                F.get(words, start).alias("token"), (end - start).cast("bigint").alias("tf"), size.cast("bigint").alias("doc_len")
            )
            return F.zip_with(first, ends, run)

        return let(starts(words), cut)

    counted = let(F.sort_array(_tokens(text, tokens)), runs)
    exploded = df.select(id_col, F.explode(counted).alias("_run"))
    return exploded.select(F.col("_run.token").alias("token"), id_col, F.col("_run.tf").alias("tf"), F.col("_run.doc_len").alias("doc_len"))


def corpus_totals(df: DataFrame, text: str, tokens: Tokenizer = index_tokens) -> DataFrame:
    """One row: number of documents, of tokens, mean length."""
    return df.select(F.size(_tokens(text, tokens)).alias("_n")).agg(
        F.count(F.lit(1)).alias("doc_count"),
        F.sum("_n").cast("bigint").alias("token_count"),
        F.avg("_n").alias("mean_len"),
    )


def document_frequency(df: DataFrame, text: str, tokens: Tokenizer = index_tokens) -> DataFrame:
    """(token, df): documents that hold the token. Partial counts are taken before the shuffle."""
    distinct = df.select(F.explode(F.array_distinct(_tokens(text, tokens))).alias("token"))
    return distinct.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def _okapi_raw(n: Column, df: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def idf_okapi(frequency: DataFrame, doc_count: Column, epsilon: float = 0.25) -> DataFrame:
    """(token, df, idf); a negative idf becomes ``epsilon`` times the mean of all idf values."""
    raw = frequency.withColumn("_n", doc_count).withColumn("_raw", _okapi_raw(F.col("_n"), F.col("df")))
    mean = raw.agg(F.avg("_raw")).scalar()
    return raw.withColumn("_floor", mean * epsilon).select(
        "token", "df", F.when(F.col("_raw") < 0, F.col("_floor")).otherwise(F.col("_raw")).alias("idf")
    )


def idf_plus(frequency: DataFrame, doc_count: Column) -> DataFrame:
    return frequency.select("token", "df", (F.log(doc_count + 1) - F.log(F.col("df") + 0.5)).alias("idf"))


# --- scoring without an index ---------------------------------------------------------------------


def _part(model: Model, tf: Column, length: Column, mean_len: Column) -> Column:
    """What one occurrence set of a term adds, before its idf."""
    shape = (1 - model.b) + length * model.b / mean_len
    if isinstance(model, Plus):
        c = tf / shape + model.delta
        return c * (model.k1 + 1) / (c + model.k1)
    return tf * (model.k1 + 1) / (tf + shape * model.k1)


def _is_term(term: str) -> Callable[[Column], Column]:
    return lambda token: token == term


def _counted(df: DataFrame, text: str, terms: Sequence[str], tokens: Tokenizer) -> DataFrame:
    """Add the document length and the count of every query term in the document."""
    cut = df.withColumn("_all", _tokens(text, tokens))
    hits = cut.withColumn("_hits", F.filter("_all", lambda token: token.isin(list(terms))))
    return hits.select(
        *df.columns,
        F.size("_all").alias("_len"),
        *[
            F.size(F.filter("_hits", _is_term(term))).alias(f"_tf{i}")
            for i, term in enumerate(terms)
        ],
    )


def score(df: DataFrame, text: str, query: Sequence[str], model: Model = Okapi(), corpus: DataFrame | None = None, tokens: Tokenizer = index_tokens) -> DataFrame:
    """Add ``score`` to every document. ``corpus`` gives the collection numbers; by default ``df`` itself."""
    return _scored(df, text, query, model, corpus, tokens).drop("_matched")


def _scored(df: DataFrame, text: str, query: Sequence[str], model: Model, corpus: DataFrame | None, tokens: Tokenizer) -> DataFrame:
    """Add ``score`` and ``_matched``, the number of different query terms in the document."""
    wanted = Counter(term.lower().strip() for term in query)
    terms = list(wanted)
    if not terms:
        return df.withColumn("score", F.lit(0.0)).withColumn("_matched", F.lit(0))
    corpus = df if corpus is None else corpus
    counts = _counted(corpus.select(text), text, terms, tokens)
    numbers = counts.agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg("_len").alias("mean_len"),
        *[F.count_if(F.col(f"_tf{i}") > 0).cast("double").alias(f"df{i}") for i in range(len(terms))],
    )
    n = F.col("n")
    if isinstance(model, Okapi):
        # Only a term in more than half of the documents needs the mean over the vocabulary, but
        # which terms those are is known only at run time.
        size = corpus.agg(F.count(F.lit(1)).cast("double")).scalar()
        vocabulary = document_frequency(corpus, text, tokens).withColumn("_n", size)
        mean = vocabulary.agg(F.avg(_okapi_raw(F.col("_n"), F.col("df")))).scalar()
        numbers = numbers.withColumn("floor", mean * model.epsilon)
    weights = []
    for i, term in enumerate(terms):
        df_i = F.col(f"df{i}")
        if isinstance(model, Okapi):
            raw = _okapi_raw(n, df_i)
            idf = F.when(raw < 0, F.col("floor")).otherwise(raw)
        elif isinstance(model, Plus):
            idf = F.log(n + 1) - F.log(df_i + 0.5)
        else:
            idf = F.log(F.lit(1.0) + (n - df_i + 0.5) / (df_i + 0.5))
        # A term that no document holds has no idf and adds nothing.
        weights.append((F.when(df_i == 0, F.lit(0.0)).otherwise(idf) * wanted[term]).alias(f"w{i}"))
    weight_row = numbers.select(F.struct("mean_len", *weights)).scalar()
    counted = _counted(df, text, terms, tokens).withColumn("_q", weight_row)
    total, matched = F.lit(0.0), F.lit(0)
    for i in range(len(terms)):
        tf = F.col(f"_tf{i}").cast("double")
        matched = matched + (tf > 0).cast("int")
        total = total + F.col(f"_q.w{i}") * _part(model, tf, F.col("_len"), F.col("_q.mean_len"))
    return counted.select(*df.columns, total.alias("score"), matched.alias("_matched"))


def top_k(
    df: DataFrame,
    id_col: str,
    text: str,
    query: Sequence[str],
    time: str,
    k: int = 5,
    topic_col: str | None = None,
    topics: Sequence[int] | None = None,
    start: Any = None,
    end: Any = None,
    model: Model = Okapi(),
    tokens: Tokenizer = index_tokens,
) -> DataFrame:
    """The k best documents, then those of the topics and dates asked for, oldest first.

    The filters come after the ranking, so fewer than k rows may come back.
    """
    best = score(df, text, query, model, tokens=tokens).orderBy(*_best_first("score", id_col)).limit(k)
    return _of_topics_and_dates(best, id_col, time, topic_col, topics, start, end)


def _of_topics_and_dates(best: DataFrame, id_col: str, time: str, topic_col: str | None, topics: Sequence[int] | None, start: Any, end: Any) -> DataFrame:
    if topics:
        best = best.where(F.col(topic_col).isin(list(topics)))
    if start is not None:
        best = best.where(F.col(time) >= F.lit(start))
    if end is not None:
        best = best.where(F.col(time) <= F.lit(end))
    return best.orderBy(time, id_col)


def search(
    df: DataFrame,
    id_col: str,
    text: str,
    query: Sequence[str] | None = None,
    filters: FilterTerm | None = None,
    k: int = 10,
    all_terms: bool = False,
    model: Model = Probabilistic(),
    resolve: Resolver = F.col,
    tokens: Tokenizer = index_tokens,
) -> DataFrame:
    """Filter first, then the k best. Without a query the filter alone decides.

    The collection numbers are those of the whole table, filtered or not.
    """
    if query is None and filters is None:
        raise ValueError("give a query, a filter, or both")
    found = filter_documents(df, filters, resolve)
    if query is None:
        return found.orderBy(id_col).limit(k)
    terms = {term.lower().strip() for term in query}
    scored = _scored(found, text, query, model, df, tokens)
    # Hits sort before the rest and the rest is dropped after the limit: a filter below it would work out
    # the counts a second time.
    hit = F.col("_matched") == len(terms) if all_terms else F.col("_matched") > 0
    best = scored.withColumn("_hit", hit).orderBy(F.col("_hit").desc(), *_best_first("score", id_col)).limit(k)
    return best.where("_hit").drop("_hit", "_matched").orderBy(*_best_first("score", id_col))


# --- many queries at once -------------------------------------------------------------------------


def _query_terms(queries: DataFrame, query_id: str, query_text: str, tokens: Tokenizer) -> DataFrame:
    terms = queries.select(query_id, F.explode(_tokens(query_text, tokens)).alias("token"))
    return terms.groupBy(query_id, "token").agg(F.count(F.lit(1)).alias("weight"))


def _id_kind(df: DataFrame, name: str) -> str:
    """The type in which a task holds an id: an integer, or a text, which numpy and Spark order alike."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        return "bigint"
    if isinstance(kind, T.StringType):
        return "string"
    raise TypeError(f"{name} has to be an integer or a string, not {kind.simpleString()}")


def _filter_of_query(queries: DataFrame, query_id: str, filters: Sequence[FilterTerm | None]) -> dict[Any, FilterTerm]:
    """The filter of each query id, in the order of the ids; a query without a filter is left out."""
    ids = [row[0] for row in queries.select(query_id).distinct().orderBy(query_id).limit(len(filters) + 1).collect()]
    if len(ids) != len(filters):
        raise ValueError(f"{len(filters)} filters for {'more' if len(ids) > len(filters) else len(ids)} queries")
    return {name: term for name, term in zip(ids, filters) if term}


def _query_hits(batch: pa.RecordBatch, column: int, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token counts of the documents, and (document, term) of every token that a query holds."""
    words = batch.column(column)
    bounds = words.offsets.to_numpy() - words.offsets[0].as_py()
    places = pc.index_in(words.flatten(), value_set=vocabulary)
    known = np.flatnonzero(places.is_valid().to_numpy(zero_copy_only=False))
    terms = places.fill_null(-1).to_numpy(zero_copy_only=False)[known].astype(np.int64)
    lengths = np.diff(bounds)
    return lengths, np.repeat(np.arange(batch.num_rows), lengths)[known], terms


def _batch_numbers(corpus: DataFrame, text: str, vocabulary: list[str], tokens: Tokenizer) -> tuple[int, float, dict[str, int]]:
    """Documents, mean length, and the document frequency of the given tokens, in one pass.

    Each task passes on one row per token of the vocabulary, whose size the caller has checked.
    """
    terms = pa.array(vocabulary, pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, words = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            lengths, doc, term = _query_hits(batch, 0, terms)
            held += np.bincount(np.unique(doc * len(vocabulary) + term) % len(vocabulary), minlength=len(vocabulary))
            documents, words = documents + batch.num_rows, words + int(lengths.sum())
        seen = np.flatnonzero(held)
        # The last two rows hold the number of documents and of tokens.
        place = np.concatenate([seen, [-1, -2]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.concatenate([held[seen], [documents, words]]))], names=["place", "n"])

    cut = corpus.select(_tokens(text, tokens).alias("_all"))
    rows = cut.mapInArrow(count, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    found = {row["place"]: row["n"] for row in rows}
    documents, total = found.pop(-1, 0), found.pop(-2, 0)
    return documents, total / documents if documents else 0.0, {vocabulary[place]: n for place, n in found.items()}


def _batch_inside_scan(
    df: DataFrame,
    corpus: DataFrame,
    id_col: str,
    text: str,
    terms: list[Any],
    model: Probabilistic,
    k: int,
    query_id: str,
    query_type: str,
    all_terms: bool,
    tokens: Tokenizer,
) -> DataFrame:
    """Each task scores its documents against all queries and passes on its k best per query."""
    doc_type = _id_kind(df, id_col)
    schema = f"`{query_id}` {query_type}, `{id_col}` {doc_type}, score double"
    if all_terms:  # a query with a term that no document holds finds nothing
        asked = Counter(row[query_id] for row in terms)
    n, mean_len, frequency = _batch_numbers(corpus, text, sorted({row["token"] for row in terms}), tokens)
    # A term that no document holds adds nothing.
    terms = [row for row in terms if row["token"] in frequency]
    if all_terms:
        held = Counter(row[query_id] for row in terms)
        terms = [row for row in terms if held[row[query_id]] == asked[row[query_id]]]
    idf = {token: math.log1p((n - df_ + 0.5) / (df_ + 0.5)) for token, df_ in frequency.items()}
    if not terms:
        return df.sparkSession.createDataFrame([], schema)
    vocabulary = sorted({row["token"] for row in terms})
    columns = {token: i for i, token in enumerate(vocabulary)}
    known_terms = pa.array(vocabulary, pa.string())
    query_ids = np.array(sorted({row[query_id] for row in terms}))
    places = {q: i for i, q in enumerate(query_ids.tolist())}
    ordered = sorted((columns[row["token"]], places[row[query_id]], row["weight"] * idf[row["token"]]) for row in terms)
    # Per term, the queries that hold it and its weight there.
    entry_term, entry_query = (np.array([e[i] for e in ordered], dtype=np.int64) for i in (0, 1))
    entry_weight = np.array([e[2] for e in ordered])
    first_entry = np.searchsorted(entry_term, np.arange(len(vocabulary) + 1))
    k1, b, queries = model.k1, model.b, len(query_ids)
    needed = np.bincount(entry_query, minlength=queries)
    slice_rows = max(1, 2_000_000 // queries)

    def score_slice(lengths: np.ndarray, doc_of_hit: np.ndarray, term_of_hit: np.ndarray) -> np.ndarray:
        cell, tf = np.unique(doc_of_hit * len(vocabulary) + term_of_hit, return_counts=True)
        doc, term = np.divmod(cell, len(vocabulary))
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[doc] / mean_len))
        fan = first_entry[term + 1] - first_entry[term]
        source = np.repeat(np.arange(len(cell)), fan)
        entry = np.arange(len(source)) - np.repeat(np.cumsum(fan) - fan, fan) + first_entry[term[source]]
        target = doc[source] * queries + entry_query[entry]
        flat = np.bincount(target, weights=part[source] * entry_weight[entry], minlength=len(lengths) * queries)
        scores = flat.reshape(len(lengths), queries)
        if all_terms:
            scores[np.bincount(target, minlength=len(flat)).reshape(scores.shape) < needed] = 0
        return scores

    def best_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_q, kept_d, kept_s = np.empty(0, np.int64), np.empty(0, np.int64 if doc_type == "bigint" else "U1"), np.empty(0)
        floor = np.zeros(queries)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            ids = ids if doc_type == "bigint" else ids.astype(str)
            lengths, doc_of_hit, term_of_hit = _query_hits(batch, 1, known_terms)
            for low in range(0, len(ids), slice_rows):
                high = min(low + slice_rows, len(ids))
                first, last = np.searchsorted(doc_of_hit, [low, high])
                scores = score_slice(lengths[low:high], doc_of_hit[first:last] - low, term_of_hit[first:last])
                # Scores are positive where a term is shared; ties with the k-th best stay in.
                doc, query = np.nonzero((scores > 0) & (np.round(scores, TIE_PLACES) >= floor))
                kept_q = np.concatenate([kept_q, query])
                kept_d = np.concatenate([kept_d, ids[low:high][doc]])
                kept_s = np.concatenate([kept_s, scores[doc, query]])
                order = np.lexsort((kept_d, -np.round(kept_s, TIE_PLACES), kept_q))
                kept_q, kept_d, kept_s = kept_q[order], kept_d[order], kept_s[order]
                place = np.arange(len(kept_q)) - np.searchsorted(kept_q, kept_q, side="left")
                full = kept_q[place == k - 1]
                floor[full] = np.round(kept_s[place == k - 1], TIE_PLACES)
                kept_q, kept_d, kept_s = kept_q[place < k], kept_d[place < k], kept_s[place < k]
        if len(kept_q):
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[kept_q]), pa.array(kept_d), pa.array(kept_s)], names=[query_id, id_col, "score"]
            )

    cut = df.select(F.col(id_col).cast(doc_type), _tokens(text, tokens).alias("_all"))
    return cut.mapInArrow(best_per_task, schema)


def _batch_by_join(
    df: DataFrame, corpus: DataFrame, id_col: str, text: str, terms: DataFrame, model: Probabilistic, query_id: str, all_terms: bool, tokens: Tokenizer
) -> DataFrame:
    """Any number of queries: postings joined to query terms, then summed per (query, document)."""
    vocabulary = terms.select("token").distinct()
    cut = corpus.select(F.explode(F.array_distinct(_tokens(text, tokens))).alias("token"))
    frequency = cut.join(vocabulary, "token").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    totals = corpus_totals(corpus, text, tokens).select(F.struct("doc_count", "mean_len")).scalar()
    n, held = F.col("_totals.doc_count"), F.col("df")
    weighed = terms.join(frequency, "token").withColumn("_totals", totals)
    weighed = weighed.withColumn("idf", F.log(F.lit(1.0) + (n - held + 0.5) / (held + 0.5)))
    joined = inverted_index(df, id_col, text, tokens).join(weighed, "token")
    part = _part(model, F.col("tf").cast("double"), F.col("doc_len"), F.col("_totals.mean_len"))
    found = joined.groupBy(query_id, id_col).agg(F.sum(F.col("idf") * F.col("weight") * part).alias("score"), F.count(F.lit(1)).alias("_held"))
    if all_terms:
        asked = terms.groupBy(query_id).agg(F.count(F.lit(1)).alias("_asked"))
        found = found.join(asked, query_id).where(F.col("_held") == F.col("_asked"))
    return found.select(query_id, id_col, "score")


def search_batch(
    df: DataFrame,
    id_col: str,
    text: str,
    queries: DataFrame,
    query_id: str,
    query_text: str,
    k: int = 10,
    filters: FilterTerm | Sequence[FilterTerm | None] | None = None,
    model: Probabilistic = Probabilistic(),
    resolve: Resolver = F.col,
    term_limit: int = BATCH_TERM_LIMIT,
    query_limit: int = BATCH_QUERY_LIMIT,
    all_terms: bool = False,
    tokens: Tokenizer = index_tokens,
) -> DataFrame:
    """The k best documents of every query: (query, rank, document, score). Ids are integers or strings.

    ``filters`` is one filter for all queries, or a list with one (or None) for each, in the order of the query
    ids. With ``all_terms`` a document has to hold every term of the query. The number of query terms is checked
    before they are sent to the tasks; a larger set of queries is joined instead, with the same result.
    """
    query_type = _id_kind(queries, query_id)
    terms = _query_terms(queries, query_id, query_text, tokens)
    parts: list[tuple[DataFrame, DataFrame]] = []
    if filters is None or isinstance(filters, Mapping):
        parts.append((filter_documents(df, filters, resolve), terms))
    else:
        own = _filter_of_query(queries, query_id, filters)
        # Queries with the same filter go together.
        groups: dict[str, tuple[FilterTerm, list[Any]]] = {}
        for name, term in own.items():
            groups.setdefault(repr(term), (term, []))[1].append(name)
        parts.append((df, terms.where(~F.col(query_id).isin(list(own)))))
        parts += [(filter_documents(df, term, resolve), terms.where(F.col(query_id).isin(names))) for term, names in groups.values()]
    scored = []
    for found, asked in parts:
        head = asked.limit(term_limit + 1).collect()
        if len(head) <= term_limit and len({row[query_id] for row in head}) <= query_limit:
            scored.append(_batch_inside_scan(found, df, id_col, text, head, model, k, query_id, query_type, all_terms, tokens))
        else:
            scored.append(_batch_by_join(found, df, id_col, text, asked, model, query_id, all_terms, tokens))
    best = Window.partitionBy(query_id).orderBy(*_best_first("score", id_col))
    return reduce(DataFrame.unionByName, scored).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        F.col(query_id).cast(queries.schema[query_id].dataType), "rank", F.col(id_col).cast(df.schema[id_col].dataType), "score"
    )


# --- stored index ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class SearchIndex:
    """Document ids are unique. ``totals`` also has the mean idf of the vocabulary, the floor of negative ones."""

    postings: DataFrame
    vocabulary: DataFrame
    totals: DataFrame
    id_col: str


def _with_mean_idf(totals: DataFrame, vocabulary: DataFrame) -> DataFrame:
    size = totals.select(F.col("doc_count").cast("double")).scalar()
    mean = vocabulary.withColumn("_n", size).agg(F.avg(_okapi_raw(F.col("_n"), F.col("df")))).scalar()
    return totals.withColumn("mean_idf", mean)


def build_index(df: DataFrame, id_col: str, text: str, tokens: Tokenizer = index_tokens) -> SearchIndex:
    vocabulary = document_frequency(df, text, tokens)
    totals = _with_mean_idf(corpus_totals(df, text, tokens), vocabulary)
    return SearchIndex(inverted_index(df, id_col, text, tokens), vocabulary, totals, id_col)


def _save_numbers(words: DataFrame, documents: DataFrame, path: str) -> None:
    """Write vocabulary and totals from (token, df, n) of a stored index and a row with ``doc_count``: no text is read.
    A row with ``mean_len`` as well is taken as it is."""
    spark = words.sparkSession
    place = os.path.join(path, "vocabulary")
    counted = words.groupBy("token").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    counted.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(place)
    stored = spark.read.parquet(place)
    if "mean_len" in documents.columns:
        _with_mean_idf(documents, stored).write.mode("overwrite").parquet(os.path.join(path, "totals"))
        return
    held = documents.select("doc_count").withColumn("_n", stored.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar())
    totals = held.select(
        "doc_count",
        F.when(F.col("doc_count") > 0, F.col("_n")).cast("bigint").alias("token_count"),
        F.try_divide(F.col("_n").cast("double"), F.col("doc_count").cast("double")).alias("mean_len"),
    )
    _with_mean_idf(totals, stored).write.mode("overwrite").parquet(os.path.join(path, "totals"))


def save_index(index: SearchIndex, path: str) -> None:
    """Postings ranged by (token, document): a frequent token spreads over several files. The words of a text are
    counted where its postings are: only the number of documents is read again, without their texts."""
    ranged = index.postings.repartitionByRange("token", index.id_col).sortWithinPartitions("token", index.id_col)
    ranged.write.mode("overwrite").parquet(os.path.join(path, "postings"))
    stored = index.totals.sparkSession.read.parquet(os.path.join(path, "postings"))
    words = stored.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))
    _save_numbers(words, index.totals.select("doc_count"), path)


def load_index(spark: SparkSession, path: str, id_col: str) -> SearchIndex:
    read = spark.read.parquet
    return SearchIndex(
        read(os.path.join(path, "postings")), read(os.path.join(path, "vocabulary")).drop("n"), read(os.path.join(path, "totals")), id_col
    )


def _scored_by_index(index: SearchIndex, query: Sequence[str], model: Model) -> DataFrame:
    """(document, score, _matched) of the documents that hold a query term."""
    if isinstance(model, Plus):
        raise ValueError("this variant scores every document; use score()")
    wanted = Counter(term.lower().strip() for term in query)
    weight = F.lit(0.0)
    for term, count in wanted.items():
        weight = F.when(F.col("token") == term, F.lit(float(count))).otherwise(weight)
    totals = index.totals.select(F.struct(F.col("doc_count").cast("double").alias("n"), "mean_len", "mean_idf")).scalar()
    vocabulary = index.vocabulary.where(F.col("token").isin(list(wanted))).withColumn("_t", totals)
    if isinstance(model, Okapi):
        raw = _okapi_raw(F.col("_t.n"), F.col("df"))
        idf = F.when(raw < 0, F.col("_t.mean_idf") * model.epsilon).otherwise(raw)
    else:
        idf = F.log(F.lit(1.0) + (F.col("_t.n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # At most one row per query term.
    weights = vocabulary.select("token", (idf * weight).alias("_w"), F.col("_t.mean_len").alias("_mean"))
    hits = index.postings.where(F.col("token").isin(list(wanted))).join(F.broadcast(weights), "token")
    part = _part(model, F.col("tf").cast("double"), F.col("doc_len"), F.col("_mean"))
    return hits.groupBy(index.id_col).agg(F.sum(F.col("_w") * part).alias("score"), F.count(F.lit(1)).alias("_matched"))


def score_with_index(index: SearchIndex, query: Sequence[str], model: Model = Okapi()) -> DataFrame:
    """(document, score) of the documents that hold a query term; the others score as for no term."""
    return _scored_by_index(index, query, model).drop("_matched")


def with_scores(df: DataFrame, best: DataFrame, id_col: str) -> DataFrame:
    """The documents of a few written (document, score) rows. Their ids are named in a filter, which reaches the scans
    below a join, so other texts are not shuffled."""
    ids = [row[0] for row in best.select(id_col).limit(NAMED_DOCUMENTS + 1).collect()]
    few = df.where(F.col(id_col).isin(ids)) if len(ids) <= NAMED_DOCUMENTS else df
    return few.join(F.broadcast(best), id_col).select(*df.columns, "score")


def top_k_with_index(
    index: SearchIndex,
    df: DataFrame,
    query: Sequence[str],
    time: str,
    k: int = 5,
    topic_col: str | None = None,
    topics: Sequence[int] | None = None,
    start: Any = None,
    end: Any = None,
    model: Model = Okapi(),
) -> DataFrame:
    """As ``top_k`` for the indexed documents ``df``: ids are ranked, then k documents are read."""
    ranked = df.select(index.id_col).join(score_with_index(index, query, model), index.id_col, "left").fillna(0.0, ["score"])
    best = cut_lineage(ranked.orderBy(*_best_first("score", index.id_col)).limit(k))
    found = with_scores(df, best, index.id_col)
    return _of_topics_and_dates(found, index.id_col, time, topic_col, topics, start, end)


def search_with_index(
    index: SearchIndex,
    df: DataFrame,
    query: Sequence[str],
    filters: FilterTerm | None = None,
    k: int = 10,
    all_terms: bool = False,
    model: Okapi | Probabilistic = Probabilistic(),
    resolve: Resolver = F.col,
) -> DataFrame:
    """As ``search`` with a query: the filter is met by ids before the ranking, then k documents are read."""
    hits = _scored_by_index(index, query, model)
    if all_terms:
        hits = hits.where(F.col("_matched") == len({term.lower().strip() for term in query}))
    if filters is not None:
        hits = hits.join(filter_documents(df, filters, resolve).select(index.id_col), index.id_col, "left_semi")
    best = hits.drop("_matched").orderBy(*_best_first("score", index.id_col)).limit(k)
    return df.join(F.broadcast(best), index.id_col).select(*df.columns, "score").orderBy(*_best_first("score", index.id_col))


# --- search with highlights -----------------------------------------------------------------------


def search_highlight(
    df: DataFrame,
    id_col: str,
    text: str,
    raw: str,
    time: str,
    query_text: str,
    prefixes: Sequence[str],
    k: int = 5,
    index: SearchIndex | None = None,
) -> DataFrame:
    """Search, in a stored index if there is one, take the k best and mark prefixes and query words in the raw text."""
    query = query_text.lower().strip().replace("_", " ").split(" ")
    best = top_k(df, id_col, text, query, time, k) if index is None else top_k_with_index(index, df, query, time, k)
    return highlight(best, raw, [q for q in query if q], prefixes).withColumn("score", F.lit(0.5)).orderBy(time, id_col)
