"""Session settings, the checkpoint folder and scratch folders."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(cores: str = "*", shuffle_partitions: int | None = None, app: str = "corpusmill") -> SparkSession:
    """A local session with the settings the library expects. A cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session gets a folder of its own,
    because executors on other machines cannot read one machine's temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if current is None:
        if configured is None:
            if not _is_local(spark):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            configured = tempfile.mkdtemp(prefix="corpusmill-checkpoint-")
        context.setCheckpointDir(configured)
        current = configured
    return configured or current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    Every later use sees the same rows, also after an executor is lost. Against ``checkpoint()`` the
    table keeps its size for the choice of joins, and later steps read only the columns they need.
    """
    folder = scratch_folder(df.sparkSession, "table")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder for a table or file written on the way."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")


def small_side(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Mark a written table for broadcast when its row count, checked here, is small enough."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a scan of few file splits over all cores; a scan with enough splits stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
