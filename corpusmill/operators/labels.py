"""Label tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.documents import write_overwrite
from corpusmill.operators.filters import FilterTerm, all_of, filter_documents


def write_labels(stored: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Insert or replace by (id, index); a null ``no_answer`` becomes false."""
    ready = incoming.withColumn("no_answer", F.coalesce("no_answer", F.lit(False)))
    return write_overwrite(stored, ready, order)


def read_labels(labels: DataFrame, index: str, filters: FilterTerm | None = None) -> DataFrame:
    return filter_documents(labels.where(F.col("index") == index), filters)


def delete_labels(
    labels: DataFrame,
    index: str,
    ids: DataFrame | None = None,
    filters: Mapping[str, Sequence[Any]] | None = None,
) -> DataFrame:
    """Delete labels of an index by id, by attribute values, by both together, or all."""
    condition = (F.col("index") == index) & all_of(
        F.col(name).isNotNull() & F.col(name).isin(list(values)) for name, values in (filters or {}).items()
    )
    if ids is None:
        return labels.where(~condition)
    victims = labels.where(condition).select("id", "index").join(ids.select("id"), "id", "left_semi")
    return labels.join(victims, ["id", "index"], "left_anti").select(*labels.columns)


def dedup_labels(labels: DataFrame, fields: Sequence[str], id_col: str = "id") -> DataFrame:
    """One label of those that agree in all fields: the one with the smallest id."""
    return labels.groupBy(*fields).agg(F.min(id_col).alias(id_col))
