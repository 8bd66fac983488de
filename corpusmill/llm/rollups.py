"""Token counts by source, language and tokenizer version, kept up by signed changes.

A batch of events becomes signed rows: minus what the ledger has for a document and tokenizer, plus what it has
now. Their sums by source, language and tokenizer are added to the totals, which are therefore sums of batches.
A batch is visible once its commit record is written; a batch that failed half-way is written anew, and one
that is committed already changes nothing when it comes again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.tokens import encoder

_SIGNED = "doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint, sign int"
_TOTALS = "source string, lang string, tokenizer string, documents bigint, tokens bigint"
_KEY = ["doc_id", "tokenizer"]


def count_tokens(docs: DataFrame, tokenizers: Mapping[str, str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens: a row per document and tokenizer version (name: file). Whole
    texts are counted; a null text has none. Null sources and languages stay null."""
    paths = dict(tokenizers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, text, source, lang = batch.columns
            for version, path in paths.items():
                counts = encoder(path).count(text)
                yield pa.RecordBatch.from_arrays([name, source, lang, pa.array([version] * len(name), pa.string()), pa.array(counts, pa.int64())], ["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    columns = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{lang_col}`").cast("string").alias("lang")]
    return docs.select(*columns).mapInArrow(count, "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint")


class TokenRollup:
    """A ledger and its totals in a shared folder. One writer at a time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, kind: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{kind}/batch={b}" for b in self.batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def batches(self) -> list[str]:
        """The committed batches, a short record each."""
        try:
            commits = self.spark.read.schema("batch string").parquet(f"{self.folder}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # the first record makes the folder
                raise
            return []
        return sorted(r["batch"] for r in commits.distinct().collect())

    def state(self) -> DataFrame:
        """doc_id, tokenizer, source, lang, n_tokens: what counts now. Signed rows that cancel out are gone."""
        same = [*_KEY, "source", "lang", "n_tokens"]
        net = self._read("signed", _SIGNED).groupBy(*same).agg(F.sum("sign").alias("n")).filter("n > 0")
        return net.select(*same, "n")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens: the sums over all committed batches, without empty ones."""
        sums = self._read("totals", _TOTALS).groupBy("source", "lang", "tokenizer")
        return sums.agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).filter("documents <> 0 or tokens <> 0")

    def commit(self, batch: str, events: DataFrame) -> bool:
        """Apply events once; False if the batch is committed already.

        ``events`` has doc_id, tokenizer, op (``insert``, ``revise`` or ``delete``; any other, or null, is an error),
        source, lang, n_tokens and, if a document may come more than once in the batch, ``seq``: the highest of the
        batch wins. Batches take effect in the order of their commits, whatever their ``seq``. Inserting a known
        document revises it; deleting an unknown one does nothing. A null count is 0, a null tokenizer a version of
        its own. Rows with a null id are counted each, and cannot be found again to revise or delete. Other columns
        play no part; an empty batch is a batch.
        """
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError("a batch is named by letters, digits, _ and -")
        if batch in self.batches():
            return False
        seq = F.col("seq").cast("long") if "seq" in events.columns else F.lit(0).cast("long")
        rows = events.select(F.col("doc_id").cast("long").alias("doc_id"), "tokenizer", F.col("op"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long")).alias("n_tokens"), seq.alias("seq"))
        if rows.filter(~F.coalesce(F.col("op").isin("insert", "revise", "delete"), F.lit(False))).limit(1).count():
            raise ValueError("an event is an insert, a revise or a delete")
        last = rows.filter("doc_id is not null").groupBy(*_KEY).agg(F.max(F.struct("seq", "op", "source", "lang", "n_tokens")).alias("e")).select(*_KEY, "e.op", "e.source", "e.lang", "e.n_tokens")
        now = last.unionByName(rows.filter("doc_id is null").drop("seq"))
        new = now.filter(F.col("op") != "delete").select(*_KEY, "source", "lang", "n_tokens", F.lit(1).alias("sign"))
        state, keys = self.state(), last.select(F.col("doc_id").alias("_id"), F.col("tokenizer").alias("_version"))
        same = (F.col("doc_id") == F.col("_id")) & F.col("tokenizer").eqNullSafe(F.col("_version"))
        old = state.join(keys, same, "left_semi").select(*_KEY, "source", "lang", "n_tokens", (-F.col("n")).cast("int").alias("sign"))
        place = f"{self.folder}/signed/batch={batch}"
        old.unionByName(new).write.mode("overwrite").option("compression", "zstd").parquet(place)
        signed = self.spark.read.schema(_SIGNED).parquet(place)
        delta = signed.groupBy("source", "lang", "tokenizer").agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("n_tokens")).alias("tokens"))
        delta.write.mode("overwrite").parquet(f"{self.folder}/totals/batch={batch}")
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return True
