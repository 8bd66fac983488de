"""Text work that changes the rows of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import BARE_DIGITS, bare_word, sentences, strip


def sentence_chunks(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per sentence: (id, chunk_no, chunk)."""
    return df.select(id_col, F.posexplode(sentences(F.col(text))).alias("chunk_no", "chunk"))


def content_json(df: DataFrame, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Whole rows, or some of their columns, as JSON text."""
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias(name))


def content_from_json(df: DataFrame, name: str, schema: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """JSON text back to columns."""
    return df.select(F.from_json(name, schema).alias("_d"), *keep).select("_d.*", *keep)


def remove_listed_words(df: DataFrame, id_col: str, text: str, words: DataFrame, word: str = "word") -> DataFrame:
    """Stop-word removal for a word list of any size, joined instead of written into the expression.

    Gives (id, text). The tokens of one text come back together; their number is bounded by the text.
    """
    tokens = df.select(id_col, F.posexplode(F.transform(F.split(text, " ", -1), strip)).alias("_pos", "_token"))
    keyed = tokens.where(~F.col("_token").rlike(BARE_DIGITS)).withColumn("_key", bare_word(F.col("_token")))
    listed = words.select(F.col(word).alias("_key")).distinct()
    kept = keyed.join(listed, "_key", "left_anti")
    grouped = kept.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_pos", "_token"))).alias("_t"))
    cleaned = grouped.select(id_col, F.array_join(F.col("_t._token"), " ").alias("_clean"))
    whole = df.select(id_col, F.col(text).alias("_raw")).join(cleaned, id_col, "left")
    return whole.select(id_col, F.when(F.col("_raw").isNotNull(), F.coalesce("_clean", F.lit(""))).alias(text))
