"""Token-id files: frequency-ranked ids in a byte-aligned code of variable length.

The commonest id gets rank 0. A rank takes one to four bytes; how many is kept apart, two bits each,
four ranks to a control byte. So a reader looks up all lengths of a block in a table of 256 rows and
gathers all values at once.

A file set is a folder with two Parquet tables: ``blocks`` (control bytes, data bytes, document ids and
lengths of consecutive documents, in order of the document id) and ``ranks`` (the id of each rank).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import id_and, written
from corpusmill.llm.tokens import encoder

BLOCK_TOKENS = 1 << 18
#: Bytes of each of the four values whose lengths a control byte holds.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    fours = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    fours[: len(values)] = extra
    control = (fours.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = values.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_values(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The first ``count`` values."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    at = np.cumsum(lengths) - lengths
    padded = np.frombuffer(data + b"\0\0\0\0", np.uint8)
    four = np.lib.stride_tricks.sliding_window_view(padded, 4)[at]
    return np.ascontiguousarray(four).view("<u4").ravel() & _MASKS[lengths]


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit, or 16-bit if the vocabulary allows it); a null
    text is empty; ``end_id`` follows every document. Written, so later passes do not encode again."""
    wide = 4 if max(encoder(path).vocabulary, (end_id or 0) + 1) > 1 << 16 else 2

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            ids, counts = own.encode(batch.column(1))
            ends = np.cumsum(counts)
            ids = ids.astype(f"<u{wide}")
            tail = b"" if end_id is None else int(end_id).to_bytes(wide, "little")
            rows = [ids[e - n : e].tobytes() + tail for e, n in zip(ends, counts)]
            sizes = counts + (end_id is not None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return written(id_and(docs, id_col, text_col).mapInArrow(encode, "doc_id bigint, n_tokens bigint, ids binary"))


def ids_of(value: bytes, count: int) -> np.ndarray:
    return np.frombuffer(value, f"<u{len(value) // count}") if count else np.zeros(0, "<u4")


def id_counts(tokens: DataFrame) -> DataFrame:
    """id, n: how often each id occurs; a task adds up its own first, so no more than one row per id leaves it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if n:
                    add = np.bincount(ids_of(ids.as_py(), n), minlength=len(total))
                    add[: len(total)] += total
                    total = add
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counted = tokens.select("n_tokens", "ids").mapInArrow(count, "id bigint, n bigint")
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode all texts and write the file set into ``folder``, documents in ascending order of the id.

    A null text is empty; a null id comes first; repeated ids stay side by side, ordered by their tokens.
    An empty table gives a file set without blocks. Columns besides id and text play no part.
    """
    spark = docs.sparkSession
    tokens = tokenize(docs, path, id_col, text_col, end_id)
    # One row per id of the vocabulary at most, whatever the size of the corpus.
    ranked = [r["id"] for r in id_counts(tokens).orderBy(F.desc("n"), "id").collect()]
    spark.createDataFrame([(i, v) for i, v in enumerate(ranked)], "rank bigint, id bigint").coalesce(1).write.mode("overwrite").parquet(f"{folder}/ranks")
    rank_of = np.zeros(max(ranked, default=0) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked))
    shared = spark.sparkContext.broadcast(rank_of)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, held = TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        counts: list[int] = []
        parts: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            values = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            control, data = pack_values(values)
            row = [[part], [before], [names], [counts], [control], [data]]
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["part", "tokens_before", "doc_ids", "lengths", "control", "data"])

        for batch in batches:
            for name, n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                names.append(name)
                counts.append(n)
                if n:
                    parts.append(shared.value[ids_of(ids.as_py(), n)])
                held += n
                if held >= block_tokens:
                    yield block()
                    before, held, names, counts, parts = before + held, 0, [], [], []
        if names:
            yield block()

    ordered = tokens.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids")
    blocks = ordered.mapInArrow(build, "part int, tokens_before bigint, doc_ids array<bigint>, lengths array<bigint>, control binary, data binary")
    blocks.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (array of int): the documents of a file set."""
    return _decoded(spark, folder, "ids array<int>", lambda ids: ids.astype(np.int32))


def token_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the decoded ids as little-endian unsigned 32-bit integers."""
    return _decoded(spark, folder, "ids_crc32 bigint", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _decoded(spark: SparkSession, folder: str, last: str, made) -> DataFrame:
    blocks = spark.read.parquet(f"{folder}/blocks")
    # A row for each range of the ids; ranges are numbered in order.
    sizes = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum(F.expr("aggregate(lengths, 0L, (a, b) -> a + b)")).alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(sizes):
        base[part] = total
        total += sizes[part]
    ranked = spark.read.parquet(f"{folder}/ranks").collect()
    id_of = np.zeros(max(len(ranked), 1), np.uint32)
    for r in ranked:
        id_of[r["rank"]] = r["id"]
    shared = spark.sparkContext.broadcast((base, id_of))
    name, kind = last.split(" ")
    arrow = pa.list_(pa.int32()) if kind.startswith("array") else pa.int64()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, id_of = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["lengths"], np.int64)
                ends = np.cumsum(counts)
                ids = id_of[unpack_values(row["control"], row["data"], int(counts.sum()))]
                starts = base[row["part"]] + row["tokens_before"] + ends - counts
                values = [made(ids[e - n : e]) for e, n in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(values, arrow)], ["doc_id", "start", "n_tokens", name])

    # A task reads a block at a time; blocks are bounded by their number of tokens, or hold one document.
    return blocks.mapInArrow(decode, f"doc_id bigint, start bigint, n_tokens bigint, {last}")
