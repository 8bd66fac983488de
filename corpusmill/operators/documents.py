"""Document tables: identity, meta, write policies, updates, deletes, reads.

A stored document has ``id``, ``index``, ``content``, ``content_type``, ``vector_id`` and its meta
either as a map column or as (document_id, document_index, name, value) rows. Every change takes a
table and returns the new table; the caller writes it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import vectors
from corpusmill.operators.filters import FilterTerm, Resolver, compile_filter, filter_documents
from corpusmill.functions.running import ordinal

CORE_FIELDS = ("content", "content_type", "id", "score", "question", "meta", "embedding")
DOCUMENT_KEY = ("id", "index")
META_KEY = ("document_id", "document_index")


# --- identity -------------------------------------------------------------------------------------


def document_id(content: Column, *chosen: Column) -> Column:
    """128-bit content hash as hex; over ``:``-prefixed attributes when some are chosen."""
    if not chosen:
        return F.md5(content.cast("string"))
    parts = [F.concat(F.lit(":"), F.coalesce(c.cast("string"), F.lit("None"))) for c in chosen]
    return F.md5(F.concat(*parts))


# Fixed pattern: a UUID in any case.
UUID_PATTERN = r"(?i)^[\da-f]{8}-([\da-f]{4}-){3}[\da-f]{12}$"


def document_uuid(identifier: Column, index: str) -> Column:
    """A UUID for every id: UUIDs stay, others become every second hex digit of sha256(id + index)."""
    half = F.regexp_replace(F.sha2(F.concat(identifier, F.lit(index)), 256), "(.).", "$1")
    dashed = F.regexp_replace(half, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(identifier.rlike(UUID_PATTERN), identifier).otherwise(dashed)


def index_name(name: str) -> str:
    """Index names begin with an upper-case letter."""
    return name[:1].upper() + name[1:]


# --- shape ----------------------------------------------------------------------------------------


def normalize_documents(df: DataFrame, field_map: Mapping[str, str] | None = None) -> DataFrame:
    """Rename by ``field_map``, push other columns into ``meta``, add the id, fail on null content."""
    field_map = dict(field_map or {})
    df = df.withColumnsRenamed({k: v for k, v in field_map.items() if k in df.columns})
    if "content" not in df.columns:
        raise ValueError("a document needs a content column")
    extra = [c for c in df.columns if c not in CORE_FIELDS and not c.startswith("__")]
    entries = F.map_from_entries(
        F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in extra])
    ) if extra else F.create_map().cast("map<string,string>")
    entries = F.map_filter(entries, lambda _, value: value.isNotNull())
    if "meta" in df.columns:
        # A top-level column replaces the meta key of the same name.
        named = F.map_keys(entries)
        entries = F.map_concat(
            F.map_filter(
                F.coalesce(F.col("meta"), F.create_map().cast("map<string,string>")),
                lambda key, _: ~F.array_contains(named, key),
            ),
            entries,
        )
    checked = F.when(F.col("content").isNull(), F.raise_error(F.lit("content is null"))).otherwise(F.col("content"))
    content = checked.cast(df.schema["content"].dataType)
    computed_id = document_id(content if df.schema["content"].dataType.typeName() == "string" else F.to_json(content))
    identifier = F.coalesce(F.col("id").cast("string"), computed_id) if "id" in df.columns else computed_id
    columns = [identifier.alias("id"), content.alias("content")]
    columns.append(
        F.coalesce(F.col("content_type"), F.lit("text")).alias("content_type")
        if "content_type" in df.columns
        else F.lit("text").alias("content_type")
    )
    columns += [F.col(c) for c in ("score", "question", "embedding") if c in df.columns]
    return df.select(*columns, entries.alias("meta"))


def flatten_documents(df: DataFrame, keys: Sequence[str], field_map: Mapping[str, str] | None = None) -> DataFrame:
    """Meta keys become columns; ``field_map`` gives other names to the document's own fields."""
    clash = [k for k in keys if k in df.columns]
    if clash:
        raise ValueError(f"meta keys repeat document fields: {clash}")
    inverse = {v: k for k, v in (field_map or {}).items()}
    flat = df.select(*[c for c in df.columns if c != "meta"], *[F.col("meta")[k].alias(k) for k in keys])
    return flat.withColumnsRenamed(inverse)


def explode_meta(df: DataFrame, index: str | None = None) -> DataFrame:
    """One row per meta key, with the value as JSON text."""
    where = F.lit(index) if index is not None else F.col("index")
    exploded = df.select(F.col("id").alias("document_id"), where.alias("document_index"), F.explode("meta").alias("name", "raw"))
    return exploded.select(*META_KEY, "name", json_text(F.col("raw")).alias("value"))


def json_text(value: Column) -> Column:
    """A string as a quoted JSON value."""
    return F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', "$1")


def collect_meta(documents: DataFrame, meta: DataFrame) -> DataFrame:
    """Meta rows back to a map, joined to their documents on (id, index)."""
    maps = meta.groupBy(*META_KEY).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("meta")
    )
    keyed = maps.withColumnsRenamed(dict(zip(META_KEY, DOCUMENT_KEY)))
    return documents.drop("meta").join(keyed, list(DOCUMENT_KEY), "left")


def flatten_classification(df: DataFrame, column: str = "classification") -> DataFrame:
    """``classification.label``, ``classification.score`` and the details as JSON text."""
    return df.select(
        *[c for c in df.columns if c != column],
        F.col(column)["label"].alias("classification.label"),
        F.col(column)["score"].alias("classification.score"),
        F.to_json(F.col(column)["details"]).alias("classification.details"),
    )


def table_explode(df: DataFrame, content: str = "content") -> DataFrame:
    """Rows of table-valued content as (row_no, record map); the first row is the header."""
    keep = [c for c in df.columns if c != content]
    header = F.get(F.col(content), 0)
    body = F.slice(F.col(content), 2, F.greatest(F.size(content) - 1, F.lit(0)))
    rows = df.select(*keep, header.alias("_header"), F.posexplode(body).alias("row_no", "_cells"))
    return rows.select(*keep, "row_no", F.map_from_arrays("_header", "_cells").alias("record"))


def apply_row_function(df: DataFrame, column: str, fn: Any) -> DataFrame:
    """Replace ``column`` by ``fn(struct of the whole row)``: a column function or a pandas_udf."""
    return df.select(fn(F.struct(*df.columns)).alias(column), *[c for c in df.columns if c != column])


# --- write policies -------------------------------------------------------------------------------


def drop_duplicate_documents(df: DataFrame, order: str, key: Sequence[str] = ("id",)) -> DataFrame:
    """Keep the first row of every id. Spark drops all but one row per id before the shuffle."""
    first = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def write_skip(stored: DataFrame, incoming: DataFrame, order: str, key: Sequence[str] = DOCUMENT_KEY) -> DataFrame:
    """Add the ids that are not stored yet."""
    batch = drop_duplicate_documents(incoming, order, key)
    fresh = batch.join(stored.select(*key), list(key), "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def write_overwrite(stored: DataFrame, incoming: DataFrame, order: str, key: Sequence[str] = DOCUMENT_KEY) -> DataFrame:
    """Insert or replace by id; the last row of a batch wins and nothing of the old row stays."""
    last = Window.partitionBy(*key).orderBy(F.col(order).desc())
    batch = incoming.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    kept = stored.join(batch.select(*key), list(key), "left_anti")
    return kept.select(*stored.columns).unionByName(batch.select(*stored.columns))


def conflicting_ids(stored: DataFrame, incoming: DataFrame, key: Sequence[str] = DOCUMENT_KEY) -> DataFrame:
    """Ids of the batch that are stored already."""
    return incoming.select(*key).distinct().join(stored.select(*key), list(key), "left_semi")


class DuplicateDocumentError(ValueError):
    """Raised when a batch repeats stored ids under the ``fail`` policy."""


def write_fail(stored: DataFrame, incoming: DataFrame, order: str, key: Sequence[str] = DOCUMENT_KEY) -> DataFrame:
    """Add a batch, or fail, say how many of its ids are stored already and name the first of them;
    ``conflicting_ids`` has them all."""
    conflicts = conflicting_ids(stored, incoming, key)
    sample = conflicts.orderBy(*key).limit(20).collect()
    if sample:
        named = ", ".join(str(row[0]) for row in sample)
        raise DuplicateDocumentError(f"{conflicts.count()} ids are stored already, first: {named}")
    return stored.unionByName(drop_duplicate_documents(incoming, order, key).select(*stored.columns))


_POLICIES = {"skip": write_skip, "overwrite": write_overwrite, "fail": write_fail}


def write_documents(stored: DataFrame, incoming: DataFrame, policy: str, order: str) -> DataFrame:
    if policy not in _POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    return _POLICIES[policy](stored, incoming, order)


# --- updates and deletes --------------------------------------------------------------------------


def update_meta_replace(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace all meta rows of every document named in ``changes``."""
    kept = meta.join(changes.select(*META_KEY).distinct(), list(META_KEY), "left_anti")
    return kept.select(*meta.columns).unionByName(changes.select(*meta.columns))


def update_meta_merge(documents: DataFrame, changes: DataFrame, key: Sequence[str] = DOCUMENT_KEY, order: str | None = None) -> DataFrame:
    """Overwrite the given keys of the meta map and keep the others. Of several changes to a document the last
    by ``order`` counts; without it, the greatest as JSON."""
    last = F.max_by("meta", F.col(order) if order else F.to_json("meta"))
    joined = documents.join(changes.groupBy(*key).agg(last.alias("_new")), list(key), "left")
    old = F.coalesce(F.col("meta"), F.create_map().cast("map<string,string>"))
    named = F.map_keys("_new")
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(named, k)), F.col("_new"))
    meta = F.when(F.col("_new").isNull(), F.col("meta")).otherwise(merged)
    return joined.withColumn("meta", meta).select(*documents.columns)


def update_vector_ids(documents: DataFrame, mapping: DataFrame, index: str, order: str | None = None) -> DataFrame:
    """Set vector ids from (id, vector_id) rows; documents not named keep theirs. Of several rows for an id the
    last by ``order`` counts; without it, the greatest vector id."""
    last = mapping.groupBy("id").agg(F.max_by("vector_id", F.col(order or "vector_id")).alias("_new"))
    new = last.select("id", "_new", F.lit(index).alias("index"))
    joined = documents.join(new, list(DOCUMENT_KEY), "left")
    return joined.withColumn("vector_id", F.coalesce("_new", "vector_id")).select(*documents.columns)


def reset_vector_ids(documents: DataFrame, index: str) -> DataFrame:
    cleared = F.when(F.col("index") == index, F.lit(None)).otherwise(F.col("vector_id"))
    return documents.withColumn("vector_id", cleared.cast(documents.schema["vector_id"].dataType))


def delete_documents(
    documents: DataFrame,
    index: str,
    ids: DataFrame | None = None,
    filters: FilterTerm | None = None,
    resolve: Resolver = F.col,
) -> DataFrame:
    """Delete from one index: by ids, by a filter, by both together (intersection), or everything."""
    condition = (F.col("index") == index) & compile_filter(filters, resolve)
    if ids is None:
        return documents.where(~condition)
    victims = documents.where(condition).select(*DOCUMENT_KEY).join(ids.select("id"), "id", "left_semi")
    return documents.join(victims, list(DOCUMENT_KEY), "left_anti").select(*documents.columns)


def delete_index(documents: DataFrame, index: str) -> DataFrame:
    return documents.where(F.col("index") != index)


# --- reads ----------------------------------------------------------------------------------------


def scan_documents(
    documents: DataFrame,
    index: str,
    filters: FilterTerm | None = None,
    return_embedding: bool = False,
    only_missing_embedding: bool = False,
    resolve: Resolver = F.col,
) -> DataFrame:
    """All documents of an index that pass the filter, without the vector unless asked for."""
    found = filter_documents(documents.where(F.col("index") == index), filters, resolve)
    if only_missing_embedding:
        found = found.where(F.col("embedding").isNull())
    return found if return_embedding else found.drop("embedding")


def get_by_ids(documents: DataFrame, ids: DataFrame | Sequence[Any] | Any, column: str = "id") -> DataFrame:
    """Documents with the given ids: a table of ids, a list, or one id."""
    if isinstance(ids, DataFrame):
        return documents.join(ids.select(column), column, "left_semi")
    wanted = list(ids) if isinstance(ids, (list, tuple, set)) else [ids]
    return documents.where(F.col(column).isin(wanted))


def get_by_vector_ids(documents: DataFrame, vector_ids: Sequence[Any]) -> DataFrame:
    """Documents in the order in which their vector ids are asked for; ``pos`` keeps that order."""
    spark = documents.sparkSession
    asked = spark.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in vector_ids])).alias("pos", "vector_id"))
    return documents.join(asked, "vector_id").orderBy("pos")


def count_documents(
    documents: DataFrame,
    filters: FilterTerm | None = None,
    only_missing_embedding: bool = False,
    resolve: Resolver = F.col,
) -> DataFrame:
    """Document count, and how many of them have a vector when the table has that column."""
    found = filter_documents(documents, filters, resolve)
    has_vector = "embedding" in documents.columns
    if only_missing_embedding:
        found = found.where(F.col("embedding").isNull())
    counts = [F.count(F.lit(1)).alias("documents")]
    if has_vector:
        counts.append(F.count("embedding").alias("embeddings"))
    return found.agg(*counts)


# --- schema ---------------------------------------------------------------------------------------


def value_type(value: Column) -> Column:
    """Property type of a JSON value: date, string, int, number, boolean, with ``[]`` for lists."""
    from corpusmill.functions.dates import is_iso_date

    def scalar(item: Column) -> Column:
        text = F.regexp_replace(item, r'^"|"$', "")
        return (
            F.when(item.startswith('"') & is_iso_date(text), F.lit("date"))
            .when(item.startswith('"'), F.lit("string"))
            .when(item.isin("true", "false"), F.lit("boolean"))
            .when(item.rlike(r"^-?\d+$"), F.lit("int"))
            .otherwise(F.lit("number"))
        )

    first = F.regexp_extract(value, r'^\[\s*("(?:[^"\\]|\\.)*"|[^,\]\s]+)', 1)
    return F.when(value.startswith("["), F.concat(scalar(first), F.lit("[]"))).otherwise(scalar(value))


def infer_property_types(meta: DataFrame, order: Sequence[str]) -> DataFrame:
    """Type of each meta key: that of the first value seen, in the order given."""
    ranked = meta.where(F.col("value").isNotNull() & (F.col("value") != "null"))
    first = ranked.groupBy("name").agg(F.min_by("value", F.struct(*order)).alias("value"))
    return first.select("name", value_type(F.col("value")).alias("data_type"))


def missing_properties(meta: DataFrame, schema: DataFrame) -> DataFrame:
    """Keys in the data that the schema does not have."""
    return meta.select("name").distinct().join(schema.select("name"), "name", "left_anti")


# --- vectors of documents -------------------------------------------------------------------------


def attach_embeddings(documents: DataFrame, embeddings: DataFrame | None, key: str) -> DataFrame:
    """Pair documents with vectors on an explicit key, or give all of them a null vector."""
    if embeddings is None:
        return documents.withColumn("embedding", F.lit(None).cast("array<float>"))
    return documents.join(embeddings.select(key, "embedding"), key, "left")


def update_embeddings(
    documents: DataFrame,
    new: DataFrame,
    key: str,
    filters: FilterTerm | None = None,
    similarity: str = "cosine",
    resolve: Resolver = F.col,
) -> DataFrame:
    """New vectors for the documents that pass the filter; unit length when the similarity is cosine."""
    vector = vectors.l2_normalize(F.col("_new")) if similarity == "cosine" else F.transform("_new", lambda a: a.cast("double"))
    target = compile_filter(filters, resolve)
    joined = documents.join(new.select(key, F.col("embedding").alias("_new")), key, "left")
    chosen = F.when(target & F.col("_new").isNotNull(), vector).otherwise(F.col("embedding").cast("array<double>"))
    return joined.withColumn("embedding", chosen).select(*documents.columns)


Encoder = Callable[[list[str]], Any]


@lru_cache(maxsize=1)
def _loaded(load: Callable[[], Encoder]) -> Encoder:
    return load()


def encoded(text: Column, load: Callable[[], Encoder], batch_size: int = 64) -> Column:
    """The vector that a model gives for each text; null for a null text, which the model does not see.

    ``load`` gives the model, a function from a list of texts to as many vectors. A worker calls it once, and again
    only for another ``load``; one that workers import by name stays loaded from task to task. The model is given
    texts of about equal length together, ``batch_size`` at a time.
    """

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for texts in batches:
            out: list[Any] = [None] * len(texts)
            there = sorted((i for i, t in enumerate(texts) if t is not None), key=lambda i: len(texts.iat[i]))
            for start in range(0, len(there), batch_size):
                model = model or _loaded(load)
                places = there[start : start + batch_size]
                for place, vector in zip(places, model([texts.iat[i] for i in places]), strict=True):
                    out[place] = np.asarray(vector, np.float64)
            yield pd.Series(out)

    return encode(text)


def encode_embeddings(
    documents: DataFrame,
    text: str,
    load: Callable[[], Encoder],
    filters: FilterTerm | None = None,
    similarity: str = "cosine",
    only_missing: bool = False,
    batch_size: int = 64,
    resolve: Resolver = F.col,
) -> DataFrame:
    """New vectors from a model for the documents that pass the filter and have a text; see ``encoded``.

    The filter comes first: the model sees no other text. With ``only_missing`` vectors that are there stay. Vectors
    are of unit length when the similarity is cosine. The table is read once and nothing is shuffled.
    """
    there = F.col("embedding") if "embedding" in documents.columns else F.lit(None)
    there = there.cast("array<double>")
    chosen = compile_filter(filters, resolve) & (there.isNull() if only_missing else F.lit(True))
    found = documents.withColumn("_new", encoded(F.when(chosen, F.col(text)), load, batch_size))
    vector = vectors.l2_normalize(F.col("_new")) if similarity == "cosine" else F.col("_new")
    return found.withColumn("embedding", F.when(F.col("_new").isNotNull(), vector).otherwise(there)).drop("_new")


def fill_missing_embeddings(documents: DataFrame, dim: int, key: str, seed: int = 42) -> DataFrame:
    """A repeatable placeholder in [-1, 1) for every document without a vector, flagged as such."""

    def component(i: Column) -> Column:
        return (F.pmod(F.xxhash64(F.col(key), i, F.lit(seed)), F.lit(2**31)) / F.lit(float(2**30)) - 1).cast("float")

    placeholder = F.transform(F.sequence(F.lit(1), F.lit(dim)), component)
    return documents.withColumn("is_placeholder", F.col("embedding").isNull()).withColumn(
        "embedding", F.coalesce(F.col("embedding"), placeholder)
    )


def check_dimensions(documents: DataFrame, dim: int) -> DataFrame:
    """How many vectors there are, and how many have another size than declared."""
    return documents.agg(
        F.count("embedding").alias("vectors"),
        F.count_if(F.size("embedding") != dim).alias("wrong_size"),
    )


# --- batches --------------------------------------------------------------------------------------


def key_range_batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Cut the key order into batches of ``size`` rows: (batch, first key, last key, rows)."""
    placed = ordinal(df.select(key), [key])
    batch = F.floor((F.col("ordinal") - 1) / size).cast("bigint")
    return placed.groupBy(batch.alias("batch")).agg(
        F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count(F.lit(1)).alias("rows_in_batch")
    )


def number_in_chunks(df: DataFrame, key: str, size: int) -> DataFrame:
    """The chunk of every row and its running number over all chunks, from 0."""
    placed = ordinal(df.select(key), [key])
    number = F.col("ordinal") - 1
    return placed.select(key, number.alias("number"), F.floor(number / size).cast("bigint").alias("chunk"))
