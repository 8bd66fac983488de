"""Nearest documents by vector, exact."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import vectors as V
from corpusmill.functions.running import ordinal
from corpusmill.operators.filters import FilterTerm, Resolver, filter_documents
from corpusmill.session import cut_lineage, spread

# Scores that agree to this many places are ties, decided by id.
TIE_PLACES = 9
# Numbers (queries x dimensions) sent to the tasks at a time.
BATCH_CELLS = 4_000_000
# Pairs that are compared at a time, and queries among them.
TILE_CELLS, TILE_QUERIES = 524_288, 2048


def score_documents(df: DataFrame, vector: str, query: Column, similarity: str = "dot_product", scale: bool = False) -> DataFrame:
    raw = V.similarity(similarity, F.col(vector), query)
    return df.withColumn("score", V.scale_score(raw, similarity) if scale else raw)


def _of_length(vector: str, size: Column) -> Column:
    """The vector, or an error if it has another length."""
    own = F.size(vector)
    told = F.concat(F.lit("a vector has "), own.cast("string"), F.lit(" numbers, the query "), size.cast("string"))
    return F.when(own == size, F.col(vector)).otherwise(F.raise_error(told).cast("array<double>"))


def vector_top_k(
    df: DataFrame,
    id_col: str,
    vector: str,
    query: Sequence[float] | Column,
    k: int = 10,
    similarity: str = "cosine",
    filters: FilterTerm | None = None,
    return_embedding: bool = False,
    scale: bool = True,
    resolve: Resolver = F.col,
) -> DataFrame:
    """Filter, then the k nearest. Each task keeps its own k best, so the shuffle is k rows per task.

    Documents without a vector are not found; a vector of another length than the query's is an error.
    """
    found = filter_documents(df, filters, resolve).where(F.col(vector).isNotNull())
    if isinstance(query, Column):
        found, target = found.withColumn("_query", query), F.col("_query")
    else:
        target = V.literal_vector(query)
    raw = V.similarity(similarity, _of_length(vector, F.size(target)), target)
    rounded = F.round("_raw", TIE_PLACES)
    nearest = rounded.asc() if similarity == "l2" else rounded.desc()
    best = found.withColumn("_raw", raw).orderBy(nearest, id_col).limit(k)
    score = V.scale_score(F.col("_raw"), similarity) if scale else F.col("_raw")
    dropped = ["_raw", "_query"] + ([] if return_embedding else [vector])
    return best.withColumn("score", score).drop(*dropped)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)


def _units(rows: np.ndarray) -> np.ndarray:
    """The rows at length 1; a zero vector stays as it is."""
    size = np.linalg.norm(rows, axis=1)[:, None]
    return np.divide(rows, size, out=np.zeros_like(rows), where=size != 0)


class _Nearest:
    """The k best documents of each query so far: greatest rounded closeness, then the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.added: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0
        # Rounded closeness that a new document has to reach, and the greatest id that may do so by a tie; what is
        # below the bar before rounding cannot.
        self.floor, self.floor_id = np.full(queries, -np.inf), np.full(queries, np.iinfo(np.int64).max)
        self.bar = self.floor.copy()

    def _raise(self, query: np.ndarray, floor: np.ndarray) -> None:
        self.floor[query] = floor
        with np.errstate(invalid="ignore"):
            bar = floor - 10.0**-TIE_PLACES - 1e-12 * np.abs(floor)
        self.bar[query] = np.where(np.isfinite(floor), bar, -np.inf)

    def meet(self, first: int, docs: np.ndarray, near: np.ndarray) -> None:
        """``near``: (query, document), the closeness of the queries from ``first`` on to ``docs``."""
        own = slice(first, first + len(near))
        if len(docs) > self.k and not np.isfinite(self.bar[own]).all():
            # So many are at least as close as the k-th of these.
            known = np.where(np.isnan(near), -np.inf, near)
            floor = np.round(np.partition(known, -self.k, axis=1)[:, -self.k], TIE_PLACES)
            higher = np.flatnonzero(floor > self.floor[own])
            self.floor_id[first + higher] = np.iinfo(np.int64).max
            self._raise(first + higher, floor[higher])
        at = np.flatnonzero(near >= self.bar[own, None])
        query, doc = np.divmod(at, near.shape[1])
        query, doc, score = query + first, docs[doc], near.ravel()[at]
        rounded, floor = np.round(score, TIE_PLACES), self.floor[query]
        better = (rounded > floor) | (rounded == floor) & (doc <= self.floor_id[query])
        self.added.append((query[better], doc[better], score[better]))
        self.waiting += len(self.added[-1][0])
        if self.waiting > max(1_000_000, len(self.kept[0])):
            self.cut()

    def cut(self) -> None:
        query, doc, score = (np.concatenate(column) for column in zip(self.kept, *self.added))
        self.added, self.waiting = [], 0
        rounded = np.round(score, TIE_PLACES)
        order = np.lexsort((doc, -rounded, query))
        query, doc, score, rounded = query[order], doc[order], score[order], rounded[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.floor_id[query[last]] = doc[last]
        self._raise(query[last], rounded[last])
        self.kept = (query[place < self.k], doc[place < self.k], score[place < self.k])


def _block_top_k(
    df: DataFrame, id_col: str, vector: str, ids: np.ndarray, matrix: np.ndarray, query_id: str, k: int, similarity: str
) -> DataFrame:
    """(query, document, score) of the k best of every task for each query.

    Documents and queries meet in tiles that stay in a core's cache. A closeness is rounded and sorted only if it may be
    one of the k best of its task.
    """
    sign = -1.0 if similarity == "l2" else 1.0
    shared = df.sparkSession.sparkContext.broadcast((ids, matrix))
    width = matrix.shape[1]
    wide = max(1, min(len(ids), TILE_QUERIES))
    deep = max(1, TILE_CELLS // wide)

    def best_per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        targets = _units(matrix) if similarity == "cosine" else matrix
        square = (np.linalg.norm(matrix, axis=1) ** 2)[:, None]
        nearest = _Nearest(len(ids), k)
        for batch in batches:
            all_docs = batch.column(0).to_numpy(zero_copy_only=False)
            all_rows = _matrix(batch.column(1), width)
            if similarity == "cosine":
                all_rows = _units(all_rows)
            for low in range(0, len(all_docs), deep):
                docs, rows = all_docs[low : low + deep], all_rows[low : low + deep]
                for first in range(0, len(ids), wide):
                    near = targets[first : first + wide] @ rows.T
                    if similarity == "l2":
                        near = -((rows**2).sum(1)[None, :] - 2 * near + square[first : first + wide])
                    nearest.meet(first, docs, near)
        if nearest.waiting:
            nearest.cut()
        query, doc, near = nearest.kept
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(doc), pa.array(sign * near)], names=[query_id, id_col, "score"])

    known = df.where(F.col(vector).isNotNull() & F.col(id_col).isNotNull())
    narrow = known.select(F.col(id_col).cast("bigint").alias("_id"), _of_length(vector, F.lit(width)).alias(vector))
    if len(ids) > TILE_QUERIES:  # a document is then more work to compare than to move
        narrow = spread(narrow, "_id")
    return narrow.mapInArrow(best_per_task, f"`{query_id}` bigint, `{id_col}` bigint, score double")


def vector_top_k_batch(
    df: DataFrame,
    id_col: str,
    vector: str,
    queries: DataFrame,
    query_id: str,
    query_vector: str,
    k: int = 10,
    similarity: str = "cosine",
    filters: FilterTerm | None = None,
    resolve: Resolver = F.col,
    block_cells: int = BATCH_CELLS,
) -> DataFrame:
    """The k nearest documents of every query: (query, rank, document, score). Ids are integers. Documents without
    a vector or an id are not found, queries without one are not asked; a vector of another length than the queries'
    is an error. No query gives no rows.

    Queries go to the tasks as a matrix of checked size. A larger set is numbered and taken block by block; each
    block is one more pass over the documents, its k best are written before the next is read, and exact by itself.
    Every query is compared with every document: the work grows with the product of the two.
    """
    found = filter_documents(df, filters, resolve)
    asked = queries.select(F.col(query_id).cast("bigint").alias(query_id), F.col(query_vector).cast("array<double>").alias("_v"))
    asked = asked.where(F.col(query_id).isNotNull() & F.col("_v").isNotNull())
    dim = asked.select(F.size("_v").alias("dim")).limit(1).collect()
    if not dim:
        return df.sparkSession.createDataFrame([], f"`{query_id}` bigint, rank int, `{id_col}` bigint, score double")
    rounded = F.round("score", TIE_PLACES)
    best = Window.partitionBy(query_id).orderBy(rounded.asc() if similarity == "l2" else rounded.desc(), F.col(id_col))
    rows_per_block = max(1, block_cells // max(dim[0]["dim"], 1))

    def ranked(block: pa.Table) -> DataFrame:
        sizes = pc.min_max(pc.list_value_length(block["_v"])).as_py()
        if sizes["min"] != sizes["max"]:
            raise ValueError(f"queries of {sizes['min']} and of {sizes['max']} numbers")
        matrix = _matrix(block["_v"].combine_chunks(), sizes["min"])
        part = _block_top_k(found, id_col, vector, block[query_id].to_numpy(), matrix, query_id, k, similarity)
        return few(part)

    def few(scored: DataFrame) -> DataFrame:
        return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(query_id, "rank", id_col, "score")

    block = asked.limit(rows_per_block + 1).toArrow()
    if len(block) <= rows_per_block:
        return ranked(block)
    # Queries of one id may lie in several blocks, so the blocks' best are ranked once more.
    placed = cut_lineage(ordinal(asked, [query_id, "_v"], "_at"))
    scored, taken = None, 0
    while True:
        block = placed.where((F.col("_at") > taken) & (F.col("_at") <= taken + rows_per_block)).select(query_id, "_v").toArrow()
        if not len(block):
            return few(scored.drop("rank"))
        part = cut_lineage(ranked(block))
        scored, taken = part if scored is None else scored.unionByName(part), taken + rows_per_block
