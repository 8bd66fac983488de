"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.session import scratch_folder

#: A table is sent to every task only up to this many bytes, which are counted first.
BROADCAST_BYTES = 64 << 20


def spare(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (case is ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def id_and(df: DataFrame, id_col: str, value: str, id_as: str = "doc_id", value_as: str = "text") -> DataFrame:
    """Only the id, as a long, and one more column; other columns and their names play no part."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias(id_as), F.col(f"`{value}`").alias(value_as))


def written(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: later steps all see these rows."""
    folder = scratch_folder(df.sparkSession, "llm")
    df.write.option("compression", compression).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def broadcast_if_small(df: DataFrame, row_bytes: int | Column) -> DataFrame:
    """Mark a written table for broadcast if its rows stay below the bound; beyond it the join shuffles and gives
    the same rows. A row has ``row_bytes`` at most; where rows differ without bound, a column gives each one's."""
    if isinstance(row_bytes, Column):
        return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES else df
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def slices(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about ``most_bytes`` of one column's data, and one row at least."""
    if not batch.num_rows:
        return
    array = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    yield batch.slice(start)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {
        "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(),
        "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
    }
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])


def with_row_key(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with two columns that tell its rows apart, equal rows too, and their names. A table read from
    files has them in the place of the row; any other is written first."""
    try:
        df.select(df.metadataColumn("_metadata")["row_index"])
    except AnalysisException:
        df = written(df)
    # Asked for by its own call, as a column of the table may have the same name.
    place = df.metadataColumn("_metadata")
    file, row = spare(df, "_file"), spare(df, "_row")
    return df.select("*", F.xxhash64(place["file_path"]).alias(file), place["row_index"].alias(row)), [file, row]
