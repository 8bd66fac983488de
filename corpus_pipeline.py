"""From raw documents to packed training sequences: language, near-duplicates, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontamination, language, packing, simhash
from corpusmill.llm.common import spare, with_row_key, written
from corpusmill.llm.queries import BYTE_BPE

#: Documents whose best language knows a smaller share of their n-grams are in none of the languages; a language
#: with few labelled documents may not know its own n-grams, so it rejects none.
LEAST_LANGUAGE = 0.1
LEAST_LABELLED = 50


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that their own labels teach. Texts that are null or without letters go, and
    those of whose n-grams no language knows a tenth, unless they are labelled with a learned language themselves,
    are too short for one n-gram, or fit best to a language with few labelled documents. If there is no label to
    learn from, all with letters stay."""
    model = language.learn(language.learned_from(docs))
    found = spare(docs, "_language")
    scored = docs.withColumn(found, language.language_column(spark, model, F.col("text")))
    if not model.languages:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    rare = [name for name, n in zip(model.languages, model.documents) if n < LEAST_LABELLED]
    labelled = F.coalesce(F.col("lang").cast("string").isin(model.languages), F.lit(False))
    near = (F.col(f"{found}.score") >= LEAST_LANGUAGE) | (F.col(f"{found}.grams") == 0) | F.col(f"{found}.lang").isin(rare)
    return scored.filter((F.col(f"{found}.lang") != language.UNKNOWN) & (near | labelled)).drop(found)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id; of repeated rows one. Documents
    without words, null and empty ones too, are near-duplicates of each other."""
    keyed, key = with_row_key(docs)
    found = written(simhash.simhash_components(keyed, carry=key))
    return keyed.join(simhash.first_of_each(found, key), key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; a null or empty text holds none."""
    found = spare(docs, "_passages")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.with_passages(docs, benchmark, found).filter(F.size(found) == 0).drop(found)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in the packed sequences; a null or empty text is its end id alone."""
    return packing.piece_digests(packing.pack_documents(docs, BYTE_BPE, end_id=0))


STAGES = [("language", known_language), ("near_duplicates", one_of_each), ("decontamination", without_benchmark), ("packing", packed)]

#: Language filters, XXH64 fingerprints and byte-pair tokens have no SQL; a test compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        made = stage(spark, docs, sf_dir)
        docs = made if number == len(STAGES) else written(made)
    return docs
