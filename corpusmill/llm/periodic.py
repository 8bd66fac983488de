"""Stretches of a text that repeat one phrase over and over, found without suffix arrays.

A stretch of period p with r repetitions at least has (r - 1) p places in a row that agree with the place p
further on. So every grid point of step (r - 1) p is tried for every p: that is a harmonic sum, n log n trials for
n words. A trial that agrees is extended exactly in both directions on a run-length grammar (``recompression``);
of equal extensions the smallest period counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import id_and, slices
from corpusmill.llm.recompression import Grammar

REPEATS = 4
LEAST_WORDS = 6
#: Bytes of text that share one grammar; a longer text has its own.
_SLICE = 2 << 20
_TRIALS = 1 << 18
_OUT = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(texts: list[np.ndarray], repeats: int = REPEATS, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and smallest period of every run, in this order. A text is an array of word numbers
    from 0 on; a run has ``repeats`` periods and ``least`` words, and no neighbouring word keeps its period."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64)
    if not n or sizes.max() < max(least, repeats):
        return none, none, none, none
    # A separator of its own in front of each text, and one at the end.
    begins = np.cumsum(sizes + 1) - sizes
    joined = np.zeros(int(sizes.sum()) + n + 1, np.int64)
    for i, (at, words) in enumerate(zip(begins, texts)):
        joined[at - 1] = i
        joined[at : at + len(words)] = words
        joined[at : at + len(words)] += n + 1
    joined[-1] = n
    grammar = Grammar(joined, n + 1)
    found: list[np.ndarray] = []
    held: list[np.ndarray] = []

    def extend() -> None:
        at, period = np.concatenate(held, axis=1)
        end = at + period + grammar.extend(at, at + period)
        start = at - grammar.extend(at, at + period, ahead=False)
        good = end - start >= np.maximum(least, repeats * period)
        found.append(_smallest(np.stack([start, end, period])[:, good]))
        held.clear()

    many = 0
    for period in range(1, int(sizes.max()) // repeats + 1):
        step = (repeats - 1) * period
        at = np.flatnonzero(joined[: len(joined) - period : step] == joined[period::step]) * step
        if len(at):
            held.append(np.stack([at, np.full(len(at), period)]))
            many += len(at)
        if many >= _TRIALS:
            extend()
            many = 0
    if held:
        extend()
    start, end, period = _smallest(np.concatenate(found, axis=1)) if found else (none, none, none)
    text = np.searchsorted(begins, start, "right") - 1
    order = np.lexsort((period, start))
    return tuple(x[order] for x in (text, start - begins[text], end - start, period))


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of columns with equal start and end, that with the smallest period."""
    rows = rows[:, np.lexsort(rows[::-1])]
    fresh = np.ones(rows.shape[1], bool)
    fresh[1:] = (rows[:2, 1:] != rows[:2, :-1]).any(axis=0)
    return rows[:, fresh]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None, repeats: int = REPEATS, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, runs (structs of start, length, period, in words, by start and period) and collapsed: the
    words joined by one space, without those that a run holds after its first period.

    Words are stretches without ASCII white space. ``prepare`` may replace a document's words before the search.
    A row for every row: a null or empty text has no words, no runs and an empty ``collapsed``; repeated rows are
    treated alike; null ids stay; an empty table gives an empty one; columns besides id and text play no part.
    Whole texts are looked at, and no row leaves its task.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, _SLICE):
                names = part.column(0).to_pylist()
                # bytes.split() parts at exactly the six ASCII white-space characters.
                words = [(t or b"").split() for t in part.column(1).cast(pa.binary()).to_pylist()]
                if prepare is not None:
                    words = [prepare(name, w) for name, w in zip(names, words)]
                sizes = [len(w) for w in words]
                coded = pa.array([w for text in words for w in text], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
                text, start, length, period = find_runs(np.split(coded, np.cumsum(sizes)[:-1]), repeats, least)
                bounds = np.searchsorted(text, np.arange(len(names) + 1))
                for i in np.unique(text).tolist():
                    drop = np.zeros(sizes[i] + 1, np.int64)
                    own = slice(bounds[i], bounds[i + 1])
                    np.add.at(drop, start[own] + period[own], 1)
                    np.add.at(drop, start[own] + length[own], -1)
                    words[i] = [words[i][k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
                runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_RUN))
                listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs)
                kept = pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), listed, kept], ["doc_id", "n_words", "runs", "collapsed"])

    return id_and(docs, id_col, text_col).mapInArrow(look, _OUT)


def run_digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; ties: smallest start, then period;
    four nulls without one), and SHA-256 of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    every = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    longest = [(-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period")]
    milli = F.expr("best.length * 1000 div -best.period").alias("exponent_milli")
    digests = [F.sha2(F.encode(every, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256")]
    return found.withColumn("best", best).select("doc_id", F.size("runs").cast("long").alias("n_runs"), *longest, milli, *digests)
