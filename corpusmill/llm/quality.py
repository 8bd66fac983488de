"""Text quality by a regularised quadratic discriminant over statistics of the text.

A document becomes a few statistics, transformed so that their spread is near to a normal one. For each class the
mean and the covariance are learned; the covariance is drawn towards that of both classes together and towards its
own diagonal, so that it can always be inverted. A document's score is the difference of the two classes' log
densities, each a Mahalanobis length taken through the Cholesky factor of the class, as a probability.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import slices, written

#: How much of a class's covariance comes from both classes together, and how much of the sum from its diagonal.
POOLED = 0.1
DIAGONAL = 0.05
#: Variances below this, in transformed statistics, count as this.
LEAST_SPREAD = 1e-3
#: Cases added to the whole of a share, so that a short text is not judged by one of them.
FEW = 20
_SLICE = 4 << 20
STATISTICS = (
    "words", "word_length", "long_words", "different_words", "repeated_lines", "capitals", "digits", "stops", "signs",
    "line_ends", "signs_a_word", "packed", "top_word", "odd_words", "doubled_words",
)

_SPACE, _LINE, _UPPER, _LOWER, _DIGIT, _STOP, _SIGN, _HIGH = range(8)


def _classes() -> np.ndarray:
    """The class of each byte of UTF-8."""
    table = np.full(256, _SIGN, np.int64)
    for kind, signs in ((_SPACE, b" \t\r\x0b\x0c"), (_LINE, b"\n"), (_STOP, b".,;:?'\"-()")):
        table[list(signs)] = kind
    table[0x41:0x5B], table[0x61:0x7B], table[0x30:0x3A], table[0x80:] = _UPPER, _LOWER, _DIGIT, _HIGH
    return table


_CLASS = _classes()


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The angle whose squared sine is a share; few cases give a small share."""
    return np.arcsin(np.sqrt(part / (whole + FEW)))


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of transformed statistics for each text (UTF-8)."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = _CLASS[np.frombuffer(b"".join(texts), np.uint8)]
    kinds = np.bincount(np.repeat(np.arange(n) * 8, sizes) + codes, minlength=8 * n).reshape(n, 8)
    words = np.zeros((n, 7))
    for i, text in enumerate(texts):
        own = text.split()  # at ASCII white space
        counts: dict[bytes, int] = {}
        for w in own:
            counts[w] = counts.get(w, 0) + 1
        lines = text.split(b"\n")
        plain = sum(c for w, c in counts.items() if w.rstrip(b".,;:?").isalpha() or w[-1] >= 0x80)
        packed = len(zlib.compress(text, 1)) if text else 0
        long = sum(c for w, c in counts.items() if len(w) > 12)
        twice = sum(map(bytes.__eq__, own, own[1:]))
        words[i] = len(own), len(counts), len(lines) - len(set(lines)), plain, packed, long, twice
        kinds[i, _SPACE] = max(counts.values(), default=0)
    many, different, lines, plain, packed, long, twice = words.T
    letters = kinds[:, _UPPER] + kinds[:, _LOWER] + kinds[:, _HIGH]
    ink = letters + kinds[:, _DIGIT] + kinds[:, _STOP] + kinds[:, _SIGN]
    columns = [
        np.log1p(many),
        np.log1p(ink / np.maximum(many, 1)),
        _share(long, many),
        np.log((different + FEW) / (many + FEW)),
        _share(lines, kinds[:, _LINE]),
        _share(kinds[:, _UPPER], letters),
        _share(kinds[:, _DIGIT], ink),
        _share(kinds[:, _STOP], ink),
        _share(kinds[:, _SIGN], ink),
        _share(kinds[:, _LINE], many + kinds[:, _LINE]),
        np.log1p(kinds[:, _SIGN] / np.maximum(many, 1)),
        np.log((packed + 50) / (sizes + 100)),
        _share(kinds[:, _SPACE], many),
        _share(many - plain, many),
        _share(twice, many),
    ]
    return np.stack(columns, axis=1)


@dataclass(frozen=True)
class Discriminant:
    """For labels 0 and 1 the mean, the inverse of the Cholesky factor of the covariance, and the constant of the
    log density with the share of the class; a class without rows has none, and ``sure`` answers for every text."""

    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()
    constants: tuple[float, ...] = ()
    sure: float | None = 0.5

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of statistics."""
        if self.sure is not None:
            return np.full(len(rows), self.sure)
        bad, good = (c - 0.5 * (((rows - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants))
        return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def discriminant(sizes: list[float], sums: list[np.ndarray], products: list[np.ndarray], pooled: float = POOLED, diagonal: float = DIAGONAL, least: float = LEAST_SPREAD) -> Discriminant:
    """From the number of rows of each class, their sum and the sum of their outer products."""
    total = sum(sizes)
    if not all(sizes):
        return Discriminant(sure=0.5 if not total else float(sizes[1] > 0))
    means = [s / n for s, n in zip(sums, sizes)]
    spreads = [p / n - np.outer(m, m) for p, m, n in zip(products, means, sizes)]
    both = sum(s * n for s, n in zip(spreads, sizes)) / total
    factors, constants = [], []
    for spread, n in zip(spreads, sizes):
        shrunk = (1 - pooled) * spread + pooled * both
        shrunk = (1 - diagonal) * shrunk + diagonal * np.diag(np.diag(shrunk)) + least * np.eye(len(both))
        lower = np.linalg.cholesky(shrunk)
        factors.append(np.linalg.inv(lower))
        constants.append(float(np.log(n / total) - np.log(np.diag(lower)).sum()))
    return Discriminant(tuple(means), tuple(factors), tuple(constants), None)


def statistics_column(text: Column) -> Column:
    """The statistics of a text as an array; a null text is empty."""

    @F.arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([pa.array(texts).cast(pa.binary())], ["text"])
        parts = [statistics([t or b"" for t in p.column(0).to_pylist()]) for p in slices(batch, 0, _SLICE)]
        rows = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(STATISTICS), pa.int32()), pa.array(rows.ravel()))

    return measure(text)


def learn(examples: DataFrame) -> Discriminant:
    """Learn from a table of ``statistics`` and ``label``; rows whose label is neither 0 nor 1 teach nothing.

    Every row counts: tasks add up counts, sums and products of each class, and one row for each class leaves a task.
    """
    k = len(STATISTICS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 + k + k * k))
        for batch in batches:
            rows = batch.column(0).flatten().to_numpy().reshape(-1, k)
            labels = batch.column(1).to_numpy()
            for label in (0, 1):
                own = rows[labels == label]
                totals[label] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(totals.tolist(), pa.list_(pa.float64()))], ["label", "totals"])

    rows = examples.filter(F.col("label").isin(0, 1)).select("statistics", F.col("label").cast("int").alias("label"))
    cells = rows.mapInArrow(add, "label int, totals array<double>").select("label", F.posexplode("totals").alias("at", "value"))
    totals = np.zeros((2, 1 + k + k * k))
    for r in cells.groupBy("label", "at").agg(F.sum("value").alias("value")).collect():  # two rows for each statistic and pair
        totals[r["label"], r["at"]] = r["value"]
    return discriminant(totals[:, 0].tolist(), list(totals[:, 1 : k + 1]), [t.reshape(k, k) for t in totals[:, k + 1 :]])


def score_column(spark: SparkSession, model: Discriminant, measured: Column) -> Column:
    """The probability of label 1, from the statistics."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(rows.flatten().to_numpy().reshape(-1, len(STATISTICS))))

    return score(measured)


def held_out(name: Column) -> Column:
    return F.coalesce(F.crc32(name.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for every row of ``docs``, scored by its text alone.

    Learned from all labelled documents that are not held out; a document with several labels teaches each, and
    repeated rows count each. Null and empty texts are scored as empty ones; a null id teaches nothing and is not
    held out. With labels of one class only that class is sure; without labels every score is one half. Whole texts
    are measured once; columns besides id and text play no part.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(F.col(f"`{id_col}`")).alias("held_out"), F.col(f"`{text_col}`").alias("text"))
    measured = written(rows.select("doc_id", "held_out", statistics_column(F.col("text")).alias("statistics")))
    marks = labels.select(F.col(f"`{label_id_col}`").alias("doc_id"), F.col(f"`{label_col}`").alias("label"))
    model = learn(measured.filter(~F.col("held_out")).join(marks.filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))), "doc_id"))
    scored = measured.select("doc_id", "held_out", score_column(docs.sparkSession, model, F.col("statistics")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
