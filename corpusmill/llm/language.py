"""Language identification by Bloom filters over character n-grams, bit-sliced by language.

Every position of the filter is a mask with one bit per language. An n-gram's masks at its hash positions,
ANDed, name all languages that know it, so one lookup serves all of them. A text's score for a language is
the number of its n-grams with that bit, less those that a filter so full lets pass by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import written

UNKNOWN = "und"
GRAM = 4
#: Documents of each language that are learned from, about; n-grams kept of each; positions; lookups per n-gram.
SAMPLE_DOCS = 3_000
GRAMS = 12_000
POSITIONS = 1 << 20
LOOKUPS = 3
_SLICE = 1 << 20
_SPACE = 0x20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None], n: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, lower case, end to end; how many each text has; which hold a letter.

    Anything but a letter is a space. An n-gram has letters inside; only its first and last place may be a
    space, so it never spans more than one word."""
    joined = "".join(f" {t.lower()} " if t else "  " for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t.lower()) + 2 if t else 2 for t in texts], np.int64)
    ends = np.cumsum(sizes)
    letter = _letters()[codes]
    upto = np.concatenate([[0], np.cumsum(letter)])
    has = upto[ends] > upto[ends - sizes]
    codes = np.where(letter, codes, _SPACE).astype(np.uint64)
    k = max(len(codes) - n + 1, 0)
    valid = np.ones(k, bool)
    for i in range(1, n - 1):
        valid &= letter[i : i + k]
    at = np.flatnonzero(valid)
    h = np.zeros(len(at), np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[at + i]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    inside = np.searchsorted(at, ends)  # an n-gram across two texts would have two spaces inside
    return h, np.diff(inside, prepend=0), has


@dataclass
class LanguageFilter:
    languages: list[str]
    #: One row per position, one 64-bit word for every 64 languages.
    slices: np.ndarray
    lookups: int
    gram: int
    #: How many labelled documents each language has.
    documents: list[int] = field(default_factory=list)

    @property
    def chance(self) -> np.ndarray:
        """For each language, the part of unknown n-grams that its filter lets pass."""
        bits = [(self.slices[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() for i in range(len(self.languages))]
        return np.array(bits) ** self.lookups

    def places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        step = hashes >> np.uint64(32) | np.uint64(1)
        for i in range(self.lookups):
            yield ((hashes + np.uint64(i) * step) & np.uint64(len(self.slices) - 1)).astype(np.int64)

    def add(self, language: int, hashes: np.ndarray) -> None:
        for at in self.places(hashes):
            self.slices[at, language // 64] |= np.uint64(1 << language % 64)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        found = None
        for at in self.places(hashes):
            here = self.slices[at]
            found = here if found is None else found & here
        return found

    def predict(self, texts: list[str | None], chance: np.ndarray) -> tuple[list[str], list[float], list[int]]:
        hashes, counts, has = grams(texts, self.gram)
        ends = np.cumsum(counts)
        masks, best = self.masks(hashes), np.zeros((len(self.languages), len(texts)))
        for i in range(len(self.languages)):
            hit = np.concatenate([[0], np.cumsum(masks[:, i // 64] >> np.uint64(i % 64) & np.uint64(1))])
            found = hit[ends].astype(float) - hit[ends - counts]
            best[i] = np.clip((found - counts * chance[i]) / (1 - chance[i]), 0, None)
        choice = best.argmax(axis=0)
        score = np.clip(best[choice, np.arange(len(texts))] / np.maximum(counts, 1), 0, 1)
        return [self.languages[c] if h else UNKNOWN for c, h in zip(choice, has)], np.where(has, score, 0.0).tolist(), counts.tolist()


def learn(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", gram: int = GRAM, sample_docs: int = SAMPLE_DOCS, kept: int = GRAMS, positions: int = POSITIONS, lookups: int = LOOKUPS) -> LanguageFilter:
    """Learn a filter from whole texts of about ``sample_docs`` documents of each language, chosen by a hash of
    the id: of each language the ``kept`` n-grams found in the most documents. Rows with a
    null text or language teach nothing; without any row the filter knows no language. The languages are in
    order of their number of documents, then of the name, which decides ties."""
    rows = labelled.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{id_col}`").alias("id")).filter("lang is not null and text is not null")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()  # a row per language
    languages = [r["lang"] for r in counts]
    out = LanguageFilter(languages, np.zeros((positions, max(1, -(-len(languages) // 64))), np.uint64), lookups, gram, [r["count"] for r in counts])
    if not languages:
        return out
    rate = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, sample_docs / r["count"]))) for r in counts])
    chosen = rows.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < rate * (1 << 20)).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                found.setdefault(lang, []).append(np.unique(grams([text.as_py()], gram)[0]))
        for lang, own in found.items():
            value, n = np.unique(np.concatenate(own), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value)), pa.array(value.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    # Written once; every language reads its own rows.
    counted = written(chosen.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    for i, lang in enumerate(languages):
        # Bounded by ``kept``; n-grams of the bounded sample only.
        best = counted.filter(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(kept).select("gram").toPandas()["gram"]
        out.add(i, best.to_numpy(np.int64).view(np.uint64))
    return out


def language_column(spark: SparkSession, model: LanguageFilter, text: Column) -> Column:
    """A struct of lang (``und`` for a text that is null or has no letter, or if no language was learned), score
    (0 to 1: the share of the text's n-grams that the language knows beyond chance) and grams, their number."""
    shared = spark.sparkContext.broadcast((model, model.chance))

    @F.arrow_udf("struct<lang: string, score: double, grams: bigint>")
    def predict(texts: pa.Array) -> pa.Array:
        model, chance = shared.value
        langs: list[str] = []
        scores: list[float] = []
        counts: list[int] = []
        held: list[str | None] = []
        size = 0

        def flush() -> None:
            if model.languages:
                found = model.predict(held, chance)
            else:
                found = [UNKNOWN] * len(held), [0.0] * len(held), [0] * len(held)
            for out, values in zip((langs, scores, counts), found):
                out.extend(values)
            held.clear()

        for text in texts:
            held.append(text.as_py())
            size += len(held[-1] or "")
            if size >= _SLICE:
                flush()
                size = 0
        flush()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(counts, pa.int64())], ["lang", "score", "grams"])

    return predict(text)


def learned_from(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that a filter may learn from: those that are not held out."""
    return docs.filter(~F.coalesce(held_out(F.col(f"`{id_col}`")), F.lit(False)))


def held_out(name: Column) -> Column:
    return F.crc32(name.cast("string").cast("binary")) % 4 == 2


def identify_languages(docs: DataFrame, model: LanguageFilter | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row per row, whatever the other columns.

    Null ids are not held out and repeated rows are predicted alike. Whole texts are read. Without a model,
    one is learned from the labelled documents that are not held out."""
    if model is None:
        model = learn(learned_from(docs, id_col), lang_col, text_col, id_col)
    found = language_column(docs.sparkSession, model, F.col(f"`{text_col}`"))
    name = F.col(f"`{id_col}`")
    return docs.select(name.alias("doc_id"), F.coalesce(held_out(name), F.lit(False)).alias("held_out"), found.alias("found")).select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
