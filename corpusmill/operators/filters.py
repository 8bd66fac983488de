"""The nested filter language, compiled once on the driver to a Spark ``Column``.

A filter is a dictionary. Keys are ``$and``, ``$or``, ``$not`` or field names; a field takes a value
(equality), a list (membership) or a dictionary of comparisons. The list of ``$in`` and ``$nin`` may be a
table, whose first column is meant; a null in it equals nothing. A field without a value fails every
comparison, ``$ne`` and ``$nin`` included, so the logic has two values: each comparison is written as
"present and ...", which the parquet reader can still push down.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import is_blank

FilterTerm = Mapping[str, Any] | Sequence[Mapping[str, Any]]
Resolver = Callable[[str], Column]


def _equals(field: Column, value: Any) -> Column:
    if value is None:
        return F.lit(False)
    if isinstance(value, (list, tuple)):
        return field == F.array(*[F.lit(v) for v in value])
    return field == F.lit(value)


def _member(field: Column, value: Any) -> Column:
    if isinstance(value, DataFrame):
        # An existence join on equality: the list may have any length, and stands anywhere in the tree.
        # Under a name of its own; behind the alias the field cannot be taken for a column of the list.
        listed = value.select(F.col(f"`{value.columns[0]}`").alias("_listed")).alias("_list")
        return listed.where(F.col("_listed") == field.outer()).exists()
    if not isinstance(value, (list, tuple, set)):
        raise ValueError("$in and $nin take a list")
    # A null in the list equals nothing; left in, it would make the whole test null.
    return field.isin([v for v in value if v is not None])


def _ordered(test: Callable[[Column, Any], Column]) -> Callable[[Column, Any], Column]:
    """Nothing is before or after null."""
    return lambda field, value: F.lit(False) if value is None else test(field, F.lit(value))


_COMPARISONS: dict[str, Callable[[Column, Any], Column]] = {
    "$eq": _equals,
    "$ne": lambda field, value: ~_equals(field, value),
    "$in": _member,
    "$nin": lambda field, value: ~_member(field, value),
    "$gt": _ordered(operator.gt),
    "$gte": _ordered(operator.ge),
    "$lt": _ordered(operator.lt),
    "$lte": _ordered(operator.le),
}


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(operator.and_, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(operator.or_, conditions, F.lit(False))


def none_of(conditions: Iterable[Column]) -> Column:
    return ~any_of(conditions)


_LOGIC = {"$and": all_of, "$or": any_of, "$not": none_of}


def compare(field: Column, op: str, value: Any) -> Column:
    """One comparison, false where the field has no value."""
    if op not in _COMPARISONS:
        raise ValueError(f"unknown comparison: {op}")
    return field.isNotNull() & _COMPARISONS[op](field, value)


def _conditions(term: FilterTerm, resolve: Resolver) -> list[Column]:
    # A list of dictionaries under one operator gives one flat list of operands.
    found: list[Column] = []
    for part in [term] if isinstance(term, Mapping) else term:
        for key, value in part.items():
            if key in _LOGIC:
                found.append(_LOGIC[key](_conditions(value, resolve)))
            elif key.startswith("$"):
                raise ValueError(f"unknown operator: {key}")
            elif isinstance(value, Mapping):
                found.extend(compare(resolve(key), op, operand) for op, operand in value.items())
            else:
                default = "$in" if isinstance(value, (list, tuple, set, DataFrame)) else "$eq"
                found.append(compare(resolve(key), default, value))
    return found


def compile_filter(term: FilterTerm | None, resolve: Resolver = F.col) -> Column:
    """Compile a filter. ``resolve`` finds the column of a field, such as a key of a meta map."""
    return F.lit(True) if not term else all_of(_conditions(term, resolve))


def filter_documents(df: DataFrame, term: FilterTerm | None, resolve: Resolver = F.col) -> DataFrame:
    return df.where(compile_filter(term, resolve)) if term else df


def same_elements(field: Column, values: Sequence[Any]) -> Column:
    """List equality that ignores the order of the elements."""
    return field.isNotNull() & (F.array_sort(field) == F.array_sort(F.array(*[F.lit(v) for v in values])))


def filter_in_per_key(
    documents: DataFrame, meta: DataFrame, filters: Mapping[str, Sequence[Any]], id_col: str = "document_id"
) -> DataFrame:
    """Documents for which every key has one of its values, over (id, name, value) meta rows."""
    kept = documents
    for name, values in filters.items():
        hits = meta.where((F.col("name") == name) & F.col("value").isin(list(values))).select(id_col)
        kept = kept.join(hits, id_col, "left_semi")
    return kept


def drop_nulls(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where none of the columns is null."""
    return df.dropna("any", subset=list(columns))


def drop_blank(df: DataFrame, text: str) -> DataFrame:
    return df.where(~is_blank(F.col(text)))


def within_dates(
    df: DataFrame,
    date: str,
    start: Any = None,
    end: Any = None,
    topic_col: str | None = None,
    topic: int | None = None,
) -> DataFrame:
    """Rows dated from ``start`` to ``end``, both included, and of one topic when given."""
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end))
    if topic is not None and topic_col is not None:
        df = df.where(F.col(topic_col) == topic)
    return df
