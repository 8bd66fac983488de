"""Row-set steps of the appeal analysis: dedup, sample, sort, peaks, averages, lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.running import ordinal_within, running_total
from corpusmill.functions.text import vocab_tokens


def dedup_keep_last(df: DataFrame, text: str, order: str) -> DataFrame:
    """Of equal texts keep the last row. Each task drops its own repeats before the shuffle, and a digest
    stands for the text as the key of shuffle and sort."""
    last = Window.partitionBy(F.sha2(F.col(text), 256)).orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def clip_sample(df: DataFrame, id_col: str, size: int = 10_000, seed: int = 42) -> DataFrame:
    """All rows when fewer than ``size``, else a repeatable uniform sample of exactly that many."""
    return df.orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}"))), id_col).limit(size)


def sort_by_date(df: DataFrame, time: str, id_col: str) -> DataFrame:
    return df.orderBy(time, id_col)


def sort_by_score(df: DataFrame, score: str, id_col: str) -> DataFrame:
    return df.orderBy(F.col(score).desc(), id_col)


def docs_per_topic(df: DataFrame, topic: str, text: str, order: Sequence[str], part_size: int = 1_000) -> DataFrame:
    """The texts of each topic in order, joined by a space, in numbered parts of ``part_size`` texts.

    A topic can hold a large share of all texts, so it is not joined into one string.
    """
    placed = ordinal_within(df.select(topic, text, *order), topic, list(order))
    part = F.floor((F.col("position") - 1) / part_size).cast("bigint")
    pieces = placed.groupBy(topic, part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("position", F.col(text).alias("text")))).alias("_rows")
    )
    return pieces.select(topic, "part", F.array_join(F.col("_rows.text"), " ").alias("doc"))


def word_frequencies(df: DataFrame, text: str, words: Sequence[str] = (), top: int = 100) -> DataFrame:
    """The most frequent words with their frequency relative to the first."""
    tokens = df.select(F.explode(vocab_tokens(F.col(text), words)).alias("word"))
    best = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "word").limit(top)
    # At most ``top`` rows by now.
    return best.withColumn("relative", F.col("n") / F.max("n").over(Window.partitionBy(F.lit(1))))


def mean_metrics(rows: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """The mean of each metric over the evaluation rows."""
    return rows.agg(*[F.avg(metric).alias(name) for name, metric in metrics.items()])


def row_metrics(rows: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """Every row with its metrics."""
    return rows.select("*", *[metric.alias(name) for name, metric in metrics.items()])


def hit_share(predicted: Column, expected: Column, over: Column) -> Column:
    """Shared elements of two lists over the size of a third; 0 when that one is empty."""
    shared = F.size(F.array_intersect(predicted, expected))
    size = F.size(F.array_distinct(over))
    return F.when(size == 0, F.lit(0.0)).otherwise(shared / size)


def precision(predicted: Column, expected: Column) -> Column:
    return hit_share(predicted, expected, predicted)


def recall(predicted: Column, expected: Column) -> Column:
    return hit_share(predicted, expected, expected)


def bounds_lookup(values: DataFrame, value: str, keys: DataFrame, key: str) -> DataFrame:
    """For every key: the leftmost position with value >= key and the rightmost with value <= key.

    Positions are 0-based in the sorted order of ``values``; -1 when there is none. Repeated values
    are counted first, so a value held by many rows is one row in the running total.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    asked = keys.select(F.col(key).alias("_v")).where(F.col("_v").isNotNull()).distinct().withColumn("_asked", F.lit(1))
    both = counted.join(asked, "_v", "full").select(
        "_v", F.coalesce("_c", F.lit(0)).cast("bigint").alias("_c"), F.coalesce("_asked", F.lit(0)).alias("_asked")
    )
    placed = running_total(both, ["_v"], "_c", "_upto")
    total = values.agg(F.count(value)).scalar()
    below = F.col("_upto") - F.col("_c")
    sized = placed.where("_asked = 1").withColumn("_total", total)
    return sized.select(
        F.col("_v").alias(key),
        F.when(below < F.col("_total"), below).otherwise(F.lit(-1)).cast("bigint").alias("leftmost_ge"),
        (F.col("_upto") - 1).cast("bigint").alias("rightmost_le"),
    )


def paragraphs(df: DataFrame, id_col: str, text: str, carry: Sequence[str] = ()) -> DataFrame:
    """Space-separated pieces of every text, blanks skipped, with a running number over all texts.

    Numbers come from the piece count of each text, so only (id, count) rows are put in order.
    """
    from corpusmill.functions.text import strip

    pieces = F.filter(F.split(strip(F.col(text)), " ", -1), lambda part: strip(part) != "")
    counts = df.select(id_col, F.size(pieces).cast("bigint").alias("_n"))
    upto = running_total(counts, [id_col], "_n", "_upto").select(id_col, (F.col("_upto") - F.col("_n")).alias("_first"))
    exploded = df.select(id_col, *carry, F.posexplode(pieces).alias("_pos", "content"))
    return exploded.join(upto, id_col).select(
        (F.col("_first") + F.col("_pos")).alias("paragraph_id"), id_col, "content", *carry
    )
