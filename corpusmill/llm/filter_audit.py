"""What each filter of a chain removes, in every order of the chain at once.

A row is described by the mask of the filters that it fails. The mask decides the outcome of every step of every
order, so each mask has one big integer: a field of 64 bits for each outcome of each step, holding 0 or 1. Adding
the integers of the rows adds all counts at once; with less than 2^64 rows no field runs over into the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import written

MOST_FILTERS = 6
#: Sums of tasks meet in so many places before those of a part meet in one.
_MEETING = 64
#: Sums that a task holds before it passes them on.
_HELD = 1_000
_OUTCOMES = ("kept", "removed", "redundant", "unique_fails")


def _outcomes(mask: int, marks: Sequence[bool], orders: list[tuple[int, ...]], k: int) -> np.ndarray:
    """0 or 1 for each order, step and outcome, marked losses last, of a row that fails the filters of ``mask``."""
    out = np.zeros((len(orders), k, len(_OUTCOMES) + len(marks)), "<u8")
    for i, order in enumerate(orders):
        gone = False
        for step, name in enumerate(order):
            fails = bool(mask >> name & 1)
            removed = fails and not gone
            out[i, step] = [not gone and not fails, removed, fails and gone, mask == 1 << name, *[removed and m for m in marks]]
            gone |= fails
    return out


def audit_filters(counts: DataFrame, filters: Sequence[str], marked: Sequence[str] = ()) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, a column ``*_lost`` for each mark, shapley.

    ``counts`` has part (string), fails (bit i: the row fails ``filters[i]``), a boolean column for each name in
    ``marked`` and n, the number of such rows; equal rows may come apart, a null mark is false, a null mask fails
    nothing. There is a row for every part, order and step: how many rows are left after the step, removed by it,
    removed earlier though they fail its filter, and fail its filter alone; ``shapley`` is what its filter removes
    over all orders together. An empty table gives no rows.
    """
    k = len(filters)
    if not 1 <= k <= MOST_FILTERS:
        raise ValueError(f"from one to {MOST_FILTERS} filters")
    marked = list(marked)
    orders = list(permutations(range(k)))
    shape = (len(orders), k, len(_OUTCOMES) + len(marked))
    width = 8 * int(np.prod(shape))
    part_of = F.coalesce(F.col("part"), F.lit(""))
    mask = F.coalesce(F.col("fails").cast("int"), F.lit(0)).bitwiseAND((1 << k) - 1)
    code = sum([F.coalesce(F.col(f"`{m}`"), F.lit(False)).cast("int") * (1 << k + i) for i, m in enumerate(marked)], mask)

    def add(batches: Iterator[pa.RecordBatch], value: Callable[[pa.RecordBatch], Iterator[int]]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        task = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            sums = [v.to_bytes(width, "little") for v in totals.values()]
            made = pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([task] * len(sums), pa.int64()), pa.array(sums, pa.binary())], ["part", "task", "total"])
            totals.clear()
            return made

        for batch in batches:
            for name, number in zip(batch.column(0).to_pylist(), value(batch)):
                totals[name] = totals.get(name, 0) + number
                if len(totals) >= _HELD:
                    yield out()
        if totals:
            yield out()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}

        def number(code: int) -> int:
            if code not in known:
                marks = [bool(code >> k + i & 1) for i in range(len(marked))]
                known[code] = int.from_bytes(_outcomes(code & (1 << k) - 1, marks, orders, k).tobytes(), "little")
            return known[code]

        yield from add(batches, lambda batch: (number(c) * n for c, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from add(batches, lambda batch: (int.from_bytes(v.as_py(), "little") for v in batch.column(2)))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["".join(filters[i] for i in order) for order in orders]
        for batch in batches:
            for name, total in zip(batch.column(0), batch.column(2)):
                fields = np.frombuffer(total.as_py(), "<u8").reshape(shape).astype(np.int64)
                of_filter = np.zeros(k, np.int64)
                np.add.at(of_filter, np.array(orders), fields[:, :, _OUTCOMES.index("removed")])
                rows = fields.reshape(-1, shape[2])
                columns = [pa.array([name.as_py()] * len(rows)), pa.array(np.repeat(names, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)))]
                columns += [pa.array(rows[:, i]) for i in range(shape[2])] + [pa.array(of_filter[np.array(orders).ravel()])]
                yield pa.RecordBatch.from_arrays(columns, ["part", "filter_order", "step", *_OUTCOMES, *[f"{m}_lost" for m in marked], "shapley"])

    sums = "part string, task bigint, total binary"
    numbers = counts.select(part_of.alias("part"), code.alias("code"), F.coalesce(F.col("n").cast("long"), F.lit(0)).alias("n"))
    there = numbers.mapInArrow(pack, sums).repartition("part", F.col("task") % _MEETING).mapInArrow(merge, sums)
    longs = ", ".join(f"`{c}` bigint" for c in [*_OUTCOMES, *[f"{m}_lost" for m in marked], "shapley"])
    return there.repartition("part").mapInArrow(merge, sums).mapInArrow(unpack, f"part string, filter_order string, step int, {longs}")


#: The filters of ``text_failures``: few words, few different words, many capitals, signs, and a copy of an earlier text.
FIVE = "ABCDE"


def text_failures(text: Column) -> tuple[Column, Column]:
    """The words of a text, and from a column ``words`` with them its mask for the first four filters."""
    white = " \t\n\x0b\x0c\r"
    bare = F.trim(text, F.lit(white))
    words = F.when(bare != "", F.split(bare, r"[\x20\x09-\x0D]+"))
    many = F.coalesce(F.size(F.col("words")), F.lit(0))
    few = 100 * F.coalesce(F.size(F.array_distinct("words")), F.lit(0)) < 50 * many
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    conditions = [many < 200, few, 100 * capitals > 3 * F.length(text), text.rlike(r"[#$%&*|]")]
    return words, sum([c.cast("int") * (1 << i) for i, c in enumerate(conditions)], F.lit(0))


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, fails, good, toxic, n for the five filters: equal rows counted.

    A null text is empty, a null part the empty string. A copy is a row whose text (by SHA-256) some row with a
    smaller id has, in whatever part; rows of one id are no copies of each other, and a null id is neither smaller
    nor greater. A row is good or toxic if any label of its id says 1. Rows are cut to their mask and the digest of
    the text before they move; copies are counted together before their group meets.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words, mask = text_failures(F.col("body"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("body"))
    rows = rows.select("doc_id", "part", "body", words.alias("words"))
    same = ["digest", "part", "fails"]
    known = written(rows.select("doc_id", "part", F.unhex(F.sha2("body", 256)).alias("digest"), mask.alias("fails")))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    each = known.filter("doc_id is not null").groupBy(*same, "doc_id").agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    each = each.select(*same, "doc_id", "n", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    groups = each.groupBy(*same, "good", "toxic").agg(F.min(F.struct("doc_id", "n")).alias("first"), F.sum("n").alias("n"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    firsts = F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    copy = 1 << FIVE.index("E")
    split = groups.withColumn("firsts", firsts).select("part", "good", "toxic", F.inline(F.array(F.struct(F.col("fails"), F.col("firsts").alias("n")), F.struct((F.col("fails") + copy).alias("fails"), (F.col("n") - F.col("firsts")).alias("n")))))
    nameless = known.filter("doc_id is null").select("part", no.alias("good"), no.alias("toxic"), "fails", F.lit(1).cast("long").alias("n"))
    return split.filter("n > 0").unionByName(nameless)
