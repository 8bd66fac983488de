"""Sharding by histogram sort: find the splitters by exact counts first, then move the rows once.

Rows are ordered by (hash of the text, id), so equal texts lie together. For every splitter the driver
keeps the bytes that lie surely below it and the interval of keys it can still lie in. A round counts the
exact bytes between all probes in one pass over a narrow table; each open interval shrinks to the two
probes around its target, and to the keys that rows really have there. A splitter is done when its bytes
are within the tolerance, and where one group of equal texts is larger than the tolerance, the id parts it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import spare, with_row_key, written

SHARDS = 40
#: Bytes counted for each row beside its text.
ROW_BYTES = 16
#: Of a shard's even share.
TOLERANCE = 0.002
#: Tasks that write one shard.
PARTS = 4
PROBES = 64

# Hash of the text, id, hash of the row's place.
Key = tuple[int, int, int]
_LOWEST = -(1 << 63)
_HIGHEST = (1 << 63) - 1


def _between(low: Key, high: Key, n: int) -> list[Key]:
    """Up to n keys above low and at most high: even steps of the first part of the key that differs."""
    at = next((i for i in range(2) if low[i] != high[i]), 2)
    a, b = low[at], high[at]
    steps = sorted({a + (b - a) * i // n for i in range(1, n + 1)} - {a})
    keys = [(*low[:at], s, *[_LOWEST] * (2 - at)) for s in steps]
    return keys if at == 2 else [*keys, high]


def _after(key: Key) -> Key:
    """The next key."""
    at = next((i for i in (2, 1) if key[i] < _HIGHEST), 0)
    return (*key[:at], key[at] + 1, *[_LOWEST] * (2 - at))


def _count(keys: DataFrame, probes: list[Key]) -> dict[int, tuple]:
    """For interval i, of keys from probe i - 1 up to but without probe i: bytes, rows, lowest and highest key."""
    shared = keys.sparkSession.sparkContext.broadcast([np.array([p[i] for p in probes], np.int64) for i in range(3)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            *key, size = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for i, rows in _by_interval(_places(shared.value, key)):
                order = rows[np.lexsort([part[rows] for part in key[::-1]])[[0, -1]]] if len(rows) > 1 else rows[[0, 0]]
                low, high = (tuple(int(part[r]) for part in key) for r in order)
                own = found.setdefault(i, [0, 0, low, high])
                found[i] = [own[0] + int(size[rows].sum()), own[1] + len(rows), min(own[2], low), max(own[3], high)]
        rows = [(i, b, n, *low, *high) for i, (b, n, low, high) in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 9)], ["i", "b", "n", "lh", "ld", "lr", "hh", "hd", "hr"])

    counted = keys.select("_h", "_d", "_r", "_size").mapInArrow(count, "i bigint, b bigint, n bigint, lh bigint, ld bigint, lr bigint, hh bigint, hd bigint, hr bigint")
    # As many rows as there are probes at most.
    merged = counted.groupBy("i").agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.min(F.struct("lh", "ld", "lr")).alias("low"), F.max(F.struct("hh", "hd", "hr")).alias("high"))
    return {r["i"]: (r["b"], r["n"], tuple(r["low"]), tuple(r["high"])) for r in merged.collect()}


def _by_interval(places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(places, kind="stable")
    at = np.flatnonzero(np.diff(places[order], prepend=-1))
    for a, b in zip(at, [*at[1:], len(order)]):
        yield int(places[order[a]]), order[a:b]


def _places(probes: list[np.ndarray], key: list[np.ndarray]) -> np.ndarray:
    """How many probes are at most the key. Both are given by the parts of the key."""
    left, right = np.searchsorted(probes[0], key[0], "left"), np.searchsorted(probes[0], key[0], "right")
    for row in np.flatnonzero(right > left):
        a, b = left[row], right[row]
        for part, own in zip(probes[1:], key[1:]):
            low, high = np.searchsorted(part[a:b], [own[row]], "left")[0], np.searchsorted(part[a:b], [own[row]], "right")[0]
            a, b = a + low, a + high
        left[row] = b
    return left


def find_splitters(keys: DataFrame, ways: int, tolerance: float) -> tuple[list[Key], list[int]]:
    """ways - 1 keys that part the bytes evenly, and the rows below each. ``keys`` has _h, _d, _r, _size."""
    whole = _count(keys, [])
    if not whole:
        return [(_HIGHEST,) * 3] * (ways - 1), [0] * (ways - 1)
    total, rows, lowest, highest = whole[0]
    slack = total / ways * tolerance
    targets = [total * i / ways for i in range(1, ways)]
    end = _after(highest)
    # Of each splitter: the keys around it, and the bytes and rows below them.
    low = [(lowest, 0, 0)] * (ways - 1)
    high = [(end, total, rows)] * (ways - 1)
    done: list[tuple[Key, int] | None] = [None] * (ways - 1)
    while any(x is None for x in done):
        for i, target in enumerate(targets):
            best = min((low[i], high[i]), key=lambda x: abs(x[1] - target))
            if done[i] is None and (abs(best[1] - target) <= slack or not _between(low[i][0], high[i][0], PROBES)[:-1]):
                done[i] = (best[0], best[2])
        open_ = [i for i, x in enumerate(done) if x is None]
        if not open_:
            break
        probes = sorted({p for i in {(low[i], high[i]): i for i in open_}.values() for p in _between(low[i][0], high[i][0], PROBES)} | {low[i][0] for i in open_})
        counted = _count(keys, probes)
        below, below_rows, passed = [], [], [0, 0]
        for j in range(len(probes)):
            b, n, *_ = counted.get(j, (0, 0))
            passed = [passed[0] + b, passed[1] + n]
            below.append(passed[0])
            below_rows.append(passed[1])
        for i in open_:
            at = bisect_left(below, targets[i])  # the first probe with at least so many bytes below it
            if at < len(probes) and probes[at] <= high[i][0]:
                high[i] = (probes[at], below[at], below_rows[at])
            if at and probes[at - 1] >= low[i][0]:
                low[i] = (probes[at - 1], below[at - 1], below_rows[at - 1])
                inside = counted.get(at)
                if inside:  # only keys that rows have
                    first, last = inside[2], inside[3]
                    low[i] = (max(first, low[i][0]), *low[i][1:])
                    after = _after(last)
                    if after < high[i][0]:
                        high[i] = (after, *high[i][1:])
    return [x[0] for x in done if x], [x[1] for x in done if x]


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS, tolerance: float = TOLERANCE, parts: int = PARTS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all rows with all their columns, and ``shard`` and ``slot``, below ``folder``, one folder per shard.

    A row counts as the bytes of its text (null: none) plus 16. Shards hold equal bytes up to the tolerance
    and one row. Equal texts share a shard but where a splitter has to part them: between two ids, and of rows with
    one id, or none, between their places in the files. A null id counts as the lowest one; a null text is one more
    text; repeated rows all stay. Of an empty table nothing is written but the schema. Columns named shard, slot and the like keep their names; the new ones get underscores.
    """
    h, d, r, size, part, row, shard, slot = (spare(docs, c) for c in ("_h", "_d", "_r", "_size", "_part", "_place", "shard", "slot"))
    text, name = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    docs, places = with_row_key(docs)
    keyed = docs.withColumn(r, F.xxhash64(*places)).drop(*places).withColumns({h: F.coalesce(F.xxhash64(text), F.lit(0)), d: F.coalesce(name.cast("long"), F.lit(_LOWEST)), size: F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES})
    keys = written(keyed.select(F.col(h).alias("_h"), F.col(d).alias("_d"), F.col(r).alias("_r"), F.col(size).alias("_size")))
    splitters, below = find_splitters(keys, shards * parts, tolerance)
    # Rows in the shard before a part begins.
    starts = [0, *below]
    starts = [s - starts[i - i % parts] for i, s in enumerate(starts)]
    place = _place_column(splitters, F.struct(F.col(h).alias("a"), F.col(d).alias("b"), F.col(r).alias("c")))
    moved = keyed.withColumn(part, place).repartitionById(shards * parts, F.col(part)).sortWithinPartitions(h, d, text, r)
    # The low bits of this id count the rows of a partition.
    placed = moved.withColumn(row, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    before = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col(part) + 1)
    full = placed.withColumns({slot: F.col(row) + before, shard: F.floor(F.col(part) / parts).cast("int")}).drop(h, d, r, size, part, row)
    full.write.mode("overwrite").option("compression", "zstd").partitionBy(shard).parquet(folder)


def _place_column(splitters: list[Key], key: Column) -> Column:
    """How many splitters are at most the key, as a balanced tree of comparisons."""

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        at = F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(splitters[m], "abc")])
        return F.when(key < at, tree(a, m)).otherwise(tree(m + 1, b))

    return tree(0, len(splitters)).cast("int")


def read_shards(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """The rows of all shards; ``docs`` is the table they were written from, for the names of the new columns."""
    shard, slot = spare(docs, "shard"), spare(docs, "slot")
    schema = T.StructType([*docs.schema.fields, T.StructField(slot, T.LongType()), T.StructField(shard, T.IntegerType())])
    return spark.read.schema(schema).option("basePath", folder).parquet(folder)
