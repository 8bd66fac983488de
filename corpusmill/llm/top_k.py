"""Exact top-k by inner product over buckets of vectors of similar length.

All vectors are sorted by length once. For a query with a known lower bound b of its k-th best product, a
vector p of a bucket with greatest length L can only matter if cos(q, p) >= b / (|q| L): the bucket's local
threshold. Above 1 the bucket is skipped. A high threshold confines each coordinate of the unit vector to an
interval, so the few coordinates in which the query is largest leave few candidates (coordinate pruning); a
low one only says how long a vector must be, a prefix of the bucket (length pruning). What is left is multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import written
from corpusmill.session import scratch_folder

#: The longest vectors, which give every query its first bound.
HEAD = 2048
BUCKET = 4096
#: Local cosine from which coordinates prune better than lengths.
COORDINATE_FROM = 0.85
FOCUS = 4
#: Bytes of queries that are sent to the tasks at once.
BLOCK_BYTES = 16 << 20
_QUERIES_AT_ONCE = 512
_SLACK = 1e-9


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>), length. Rows whose id or vector is null, whose vector is empty or holds a null
    or non-finite component, take no part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite)
    return rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


class _Best:
    """The k best (score, id) of each query so far, and the bound that a new one has to reach."""

    def __init__(self, bounds: np.ndarray, k: int) -> None:
        self.k, self.bounds = k, bounds.copy()
        self.q, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, q: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        q, score, name = np.concatenate([self.q, q]), np.concatenate([self.score, score]), np.concatenate([self.id, name])
        order = np.lexsort((name, -score, q))
        q, score, name = q[order], score[order], name[order]
        begin = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q))))
        keep = rank < self.k
        last = rank == self.k - 1
        self.bounds[q[last]] = np.maximum(self.bounds[q[last]], score[last])
        self.q, self.score, self.id = q[keep], score[keep], name[keep]


def _search_bucket(ids: np.ndarray, vectors: np.ndarray, lengths: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, q_lengths: np.ndarray, best: _Best) -> None:
    """``vectors`` in order of falling length."""
    longest = lengths[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(q_lengths * longest > 0, best.bounds / (q_lengths * longest), np.where(best.bounds > 0, np.inf, -np.inf))
    open_ = np.flatnonzero(local <= 1 + _SLACK)
    by_coordinate = open_[local[open_] >= COORDINATE_FROM]
    by_length = open_[local[open_] < COORDINATE_FROM]

    def keep(q: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> None:
        found = (scores >= best.bounds[q]) & (ids[rows] != q_ids[q])
        if found.any():
            best.add(q[found], scores[found], ids[rows[found]])

    for a in range(0, len(by_length), _QUERIES_AT_ONCE):
        own = by_length[a : a + _QUERIES_AT_ONCE]
        with np.errstate(divide="ignore", invalid="ignore"):
            shortest = np.where(q_lengths[own] > 0, best.bounds[own] / q_lengths[own], -np.inf).min()
        prefix = int(np.searchsorted(-lengths, -(shortest - abs(shortest) * _SLACK), "right")) if shortest > 0 else len(lengths)
        scores = queries[own] @ vectors[:prefix].T
        q, rows = np.nonzero(scores >= best.bounds[own][:, None])
        keep(own[q], rows, scores[q, rows])
    if not len(by_coordinate):
        return
    unit = vectors / np.where(lengths > 0, lengths, 1)[:, None]
    order = np.argsort(unit, axis=0)
    ranked = np.take_along_axis(unit, order, axis=0)
    for i in by_coordinate:
        threshold = min(max(best.bounds[i] / (q_lengths[i] * longest), 0.0), 1.0)
        direction = queries[i] / q_lengths[i]
        spread = np.sqrt((1 - direction**2) * (1 - threshold**2)) + 1e-7
        left, right = direction * threshold - spread, direction * threshold + spread
        # Beyond the threshold's own interval, cosines up to 1 reach as far as the query's coordinate.
        right = np.where(direction >= threshold, 1 + 1e-7, np.maximum(right, direction + 1e-7))
        left = np.where(direction <= -threshold, -1 - 1e-7, np.minimum(left, direction - 1e-7))
        focus = np.argsort(-np.abs(direction))[:FOCUS]
        ranges = [(int(np.searchsorted(ranked[:, f], left[f])), int(np.searchsorted(ranked[:, f], right[f], "right")), f) for f in focus]
        a, b, first = min(ranges, key=lambda r: r[1] - r[0])
        rows = order[a:b, first]
        for _, _, f in ranges:
            if f != first:
                rows = rows[(unit[rows, f] >= left[f]) & (unit[rows, f] <= right[f])]
        if len(rows):
            keep(np.full(len(rows), i), rows, vectors[rows] @ queries[i])


def _bounds(queries: DataFrame, head: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """Adds ``bound``, the k-th best product with the longest vectors; -infinity where they are too few."""
    by_size: dict[int, list] = {}
    for name, v in head:
        by_size.setdefault(len(v), []).append((name, v))
    made = {d: (np.array([n for n, _ in rows], np.int64), np.array([v for _, v in rows])) for d, rows in by_size.items()}
    shared = queries.sparkSession.sparkContext.broadcast(made)

    @F.arrow_udf("double")
    def bound(names: pa.Array, vectors: pa.Array) -> pa.Array:
        out = []
        for name, v in zip(names.to_pylist(), vectors):
            v = v.values.to_numpy(zero_copy_only=False)
            ids, rows = shared.value.get(len(v), (np.zeros(0, np.int64), np.zeros((0, len(v)))))
            scores = (rows @ v)[ids != name]
            out.append(float(np.partition(scores, -k)[-k]) if len(scores) >= k else float("-inf"))
        return pa.array(out, pa.float64())

    return queries.withColumn("bound", bound("vec_id", "v"))


def top_k(vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES, head: int = HEAD, bucket: int = BUCKET) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query with all rows but those
    of its own id, ties to the smaller id.

    ``is_query`` is a condition on the column vec_id. Vectors meet those of their own dimension only. Repeated
    rows count each as candidates and once as a query. An empty table, or one without queries, gives no rows.
    Columns besides id and vector play no part.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    # Ties in length spread by the hash; a task cuts its sorted rows into buckets.
    tie = F.xxhash64("vec_id")
    ranged = rows.repartitionByRange(F.desc("length"), tie).sortWithinPartitions(F.desc("length"), tie)
    sorted_ = written(ranged)
    longest = [(r["vec_id"], r["v"]) for r in sorted_.orderBy(F.desc("length"), "vec_id").limit(head).select("vec_id", "v").collect()]
    queries = written(_bounds(sorted_.filter(is_query).select("vec_id", "v", "length").distinct(), longest, k))
    found = scratch_folder(spark, "top-k")
    number = 0
    for block in _query_blocks(queries, block_bytes):
        by_size: dict[int, tuple] = {}
        for size in {len(r["v"]) for r in block}:
            own = [(number + i, r) for i, r in enumerate(block) if len(r["v"]) == size]
            by_size[size] = (np.array([i for i, _ in own]), np.array([r["vec_id"] for _, r in own]), np.array([r["v"] for _, r in own]), np.array([r["length"] for _, r in own]), np.array([r["bound"] for _, r in own]))
        number += len(block)
        _search(sorted_, by_size, k, bucket).write.mode("append").parquet(found)
    if not number:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    best = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    every = spark.read.schema("number bigint, query_id bigint, vec_id bigint, score double").parquet(found)
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _query_blocks(queries: DataFrame, most: int) -> Iterator[list]:
    block, held = [], 0
    for row in queries.toLocalIterator():
        block.append(row)
        held += 8 * len(row["v"]) + 32
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


def _search(sorted_: DataFrame, by_size: dict[int, tuple], k: int, bucket: int) -> DataFrame:
    shared = sorted_.sparkSession.sparkContext.broadcast(by_size)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: _Best(own[4], k) for d, own in shared.value.items()}

        def look(table: pa.Table) -> None:
            sizes = pc.list_value_length(table.column(1)).to_numpy()
            for d in set(sizes.tolist()) & set(best):
                own = table.filter(pa.array(sizes == d)).combine_chunks()
                ids, lengths = own.column(0).to_numpy(), own.column(2).to_numpy()
                order = np.lexsort((ids, -lengths))
                matrix = _matrix(own.column(1).combine_chunks() if isinstance(own.column(1), pa.ChunkedArray) else own.column(1), d)
                numbers, q_ids, queries, q_lengths, _ = shared.value[d]
                _search_bucket(ids[order], matrix[order], lengths[order], q_ids, queries, q_lengths, best[d])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for a in range(0, batch.num_rows, bucket):
                held.append(batch.slice(a, bucket))
                rows += held[-1].num_rows
                if rows >= bucket:
                    look(pa.Table.from_batches(held))
                    held, rows = [], 0
        if held:
            look(pa.Table.from_batches(held))
        for d, own in best.items():
            numbers, q_ids, *_ = shared.value[d]
            yield pa.RecordBatch.from_arrays([pa.array(numbers[own.q], pa.int64()), pa.array(q_ids[own.q], pa.int64()), pa.array(own.id), pa.array(own.score)], ["number", "query_id", "vec_id", "score"])

    return sorted_.select("vec_id", "v", "length").mapInArrow(search, "number bigint, query_id bigint, vec_id bigint, score double")
