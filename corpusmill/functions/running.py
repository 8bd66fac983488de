"""Positions and running totals over a total order, without putting the table into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage

# monotonically_increasing_id keeps the partition number above this many bits.
_ROW_BITS = 33


def running_total(df: DataFrame, order: Sequence[str], value: str | None, name: str) -> DataFrame:
    """Add ``name`` = sum of ``value`` (1 per row when None) over all earlier rows and this one.

    The rows are range-sorted once and written out, so a recomputed task cannot cut the ranges
    differently. Each range adds its rows alone, and the totals of the ranges before it come from a
    table with one row per range. ``order`` must name a unique key; its last columns break ties, so a
    value shared by many rows still spreads over many ranges. Pass narrow rows: this writes them.
    """
    ranged = cut_lineage(df.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_row", _ROW_BITS))
    if value is None:
        local = (F.col("_row") - F.shiftleft("_range", _ROW_BITS) + 1).cast("bigint")
        amount = F.lit(1).cast("bigint")
    else:
        inside = Window.partitionBy("_range").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
        local = F.sum(value).over(inside)
        amount = F.col(value)
    totals = ranged.groupBy("_range").agg(F.sum(amount).alias("_amount"))
    # One row per range: its number is that of the shuffle partitions, not of the rows.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_amount").over(before), F.lit(0)).alias("_before"))
    return (
        ranged.withColumn("_local", local)
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("bigint"))
        .drop("_row", "_range", "_local", "_before")
    )


def ordinal(df: DataFrame, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Add the 1-based position of each row in the order given."""
    return running_total(df, order, None, name)


def ordinal_within(df: DataFrame, group: str, order: Sequence[str], name: str = "position") -> DataFrame:
    """Add the 1-based position of each row inside its group; a group may span many ranges."""
    placed = cut_lineage(ordinal(df, [group, *order], "_ordinal"))
    first = placed.groupBy(group).agg(F.min("_ordinal").alias("_first"))
    return (
        placed.join(first, group)
        .withColumn(name, F.col("_ordinal") - F.col("_first") + 1)
        .drop("_ordinal", "_first")
    )
