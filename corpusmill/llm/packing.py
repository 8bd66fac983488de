"""Packing token sequences: shortest pack first over the histogram of lengths.

A document gives full pieces of ``size`` ids and one rest. The driver sees only how many rests there are
of each length, at most ``size`` numbers. From the longest length on, pieces go into the pack with the
most room; packs with the same room are one entry with a count. Where the room is too small for the
piece, the piece may be cut: its head fills the pack and its tail waits among the shorter lengths. What
comes out are runs: "the rests of this length with ranks a to b have this part in packs p, p + 1, ...".
Documents find their packs by their rank among the rests of their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import broadcast_if_small, id_and, written
from corpusmill.llm.token_files import ids_of
from corpusmill.llm.tokens import encoder

SEQUENCE = 1024
SHORTEST_CUT = 16


class Run(NamedTuple):
    """Of the rests of length ``rest`` with ranks ``first`` to ``first + count - 1``, the ids from ``start``
    on, ``length`` of them, lie at ``offset`` of the packs ``pack``, ``pack + 1``, ..."""

    rest: int
    first: int
    count: int
    start: int
    length: int
    pack: int
    offset: int


def plan_packs(histogram: dict[int, int], size: int = SEQUENCE, shortest_cut: int = SHORTEST_CUT) -> tuple[list[Run], int]:
    """Runs, and the number of packs. ``histogram`` has the number of rests of each length below ``size``."""
    waiting: dict[int, deque[tuple[int, int, int, int]]] = defaultdict(deque)
    for length, n in histogram.items():
        if n and length:
            waiting[length].append((length, 0, n, 0))
    rooms: dict[int, deque[tuple[int, int]]] = defaultdict(deque)  # room: first pack, number of packs
    runs, packs = [], 0

    def put(rest: int, first: int, n: int, start: int, length: int, room: int) -> int:
        """Place up to n pieces into the next packs with this room; how many."""
        pack, there = rooms[room].popleft()
        k = min(n, there)
        if k < there:
            rooms[room].appendleft((pack + k, there - k))
        elif not rooms[room]:
            del rooms[room]
        runs.append(Run(rest, first, k, start, length, pack, size - room))
        if room > length:
            rooms[room - length].append((pack, k))
        return k

    for length in range(size - 1, 0, -1):
        queue = waiting.pop(length, deque())
        while queue:
            rest, first, n, start = queue.popleft()
            while n:
                room = max(rooms, default=0)
                if room >= length:
                    k = put(rest, first, n, start, length, room)
                elif room >= shortest_cut and length - room >= shortest_cut:
                    k = put(rest, first, n, start, room, room)
                    waiting[length - room].append((rest, first, k, start + room))
                else:
                    rooms[size].append((packs, n))
                    packs += n
                    k = put(rest, first, n, start, length, size)
                first, n = first + k, n - k
    return runs, packs


def pack_documents(docs: DataFrame, path: str, end_id: int, size: int = SEQUENCE, shortest_cut: int = SHORTEST_CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset.

    Every document is encoded with ``end_id`` behind it; a null text is empty, so it has that id alone.
    Null and repeated ids are documents of their own. An empty table gives no pieces. Columns besides id and
    text play no part. Full pieces come first, one to a sequence.
    """
    wide = 4 if max(encoder(path).vocabulary, end_id + 1) > 1 << 16 else 2
    kinds = "part bigint, row bigint, doc_id bigint, n_tokens bigint, rest bigint, rank bigint, full_before bigint, ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(path), TaskContext.get().partitionId()
        seen, full, row = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            ids, counts = own.encode(batch.column(1))
            ids, ends = ids.astype(f"<u{wide}"), np.cumsum(counts)
            tail = int(end_id).to_bytes(wide, "little")
            values = [ids[e - n : e].tobytes() + tail for e, n in zip(ends, counts)]
            counts = counts + 1
            rest, ranks, before = counts % size, [], []
            for r, f in zip(rest.tolist(), (counts // size).tolist()):
                ranks.append(seen[r])
                seen[r] += 1
                before.append(full)
                full += f
            n = len(values)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int64()), pa.array(range(row, row + n), pa.int64()), batch.column(0), pa.array(counts), pa.array(rest), pa.array(ranks, pa.int64()), pa.array(before, pa.int64()), pa.array(values, pa.binary())],
                ["part", "row", "doc_id", "n_tokens", "rest", "rank", "full_before", "ids"],
            )
            row += n

    tokens = written(id_and(docs, id_col, text_col).mapInArrow(encode, kinds))
    # For each task and length how many rests there are; the ranks of a length follow the order of the tasks.
    cells = written(tokens.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("n_tokens") / size)).alias("full")))
    histogram = {r["rest"]: r["n"] for r in cells.groupBy("rest").agg(F.sum("n").alias("n")).collect()}
    full_total = cells.agg(F.sum("full")).first()[0] or 0
    runs, _ = plan_packs(histogram, size, shortest_cut)

    spark = docs.sparkSession
    by_rest: dict[int, list[Run]] = defaultdict(list)
    for run in runs:
        by_rest[run.rest].append(run)
    index = {}
    for rest, own in by_rest.items():
        # A rest has a part in several runs: the runs of each start, by their first rank.
        starts: dict[int, list[Run]] = defaultdict(list)
        for run in own:
            starts[run.start].append(run)
        index[rest] = {s: (np.array([r.first for r in v]), v) for s, v in ((s, sorted(v, key=lambda r: r.first)) for s, v in sorted(starts.items()))}
    shared = spark.sparkContext.broadcast(index)

    parts = cells.groupBy("part").agg(F.sum("full").alias("full"))
    full_base, at = [], 0
    for r in parts.orderBy("part").collect():  # two numbers for each task
        full_base.append((r["part"], at))
        at += r["full"]
    bases = spark.createDataFrame(full_base, "part bigint, full_base bigint")
    earlier = cells.select("rest", "part", F.col("n").alias("_n"))
    firsts = written(earlier.join(F.broadcast(bases), "part").selectExpr("part", "rest", "full_base", "coalesce(sum(_n) over (partition by rest order by part rows between unbounded preceding and 1 preceding), 0L) as rank_base"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            out: list[tuple] = []
            columns = [c.to_pylist() for c in batch.columns[:6]]
            for name, n, rest, rank, full, full_base, value in zip(*columns, batch.column(6)):
                ids = ids_of(value.as_py(), n).astype("<u4")

                def piece(start: int, length: int, sequence: int, offset: int) -> None:
                    out.append((name, start, length, ids[start : start + length].tobytes(), n, sequence, offset))

                for i in range(n // size):
                    piece(i * size, size, full_base + full + i, 0)
                done = n - rest
                left = rest
                while left:
                    # The run that holds this rank and starts where the last one ended.
                    firsts, own = index[rest][rest - left]
                    run = own[int(np.searchsorted(firsts, rank, "right")) - 1]
                    piece(done + run.start, run.length, full_total + run.pack + rank - run.first, run.offset)
                    left -= run.length
            columns = [pa.array(v, k) for v, k in zip(list(zip(*out)) or [()] * 7, [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    ranked = tokens.join(broadcast_if_small(firsts, 32), ["part", "rest"]).select("doc_id", "n_tokens", "rest", (F.col("rank") + F.col("rank_base")).alias("rank"), "full_before", "full_base", "ids")
    return ranked.mapInArrow(cut, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the unsigned crc32 of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
