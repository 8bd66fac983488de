"""The pipeline on planted documents, against brute force."""

from __future__ import annotations

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from corpusmill.llm import decontamination
from corpusmill.llm.queries import BYTE_BPE
from corpusmill.session import scratch_folder
from llm_models import slow_components, slow_fingerprint

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_run(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    passage = " ".join(rnd.choice(words) for _ in range(30))
    texts: list[str | None] = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 400))) for _ in range(120)]
    texts += texts[:10] + [texts[3], None, "", "12 34 !", "日本語の文章はここでは学ばれていません" * 3, texts[5] + " " + passage + " " + texts[6], "Q"]
    rows = [(i, t, "xx" if t else None, "s", len(t or "")) for i, t in enumerate(texts)]
    rows = [(i, t, None if t and t.startswith("日") else lang, s, n) for i, t, lang, s, n in rows] + [rows[50], rows[50]]
    folder = scratch_folder(spark, "planted")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")

    kept = [r for r in dict.fromkeys(rows) if any(c.isalpha() for c in r[1] or "") and not r[1].startswith("日")]
    fps = [slow_fingerprint(r[1], 3) for r in kept]
    kept = [r for r, m, i in zip(kept, slow_components(fps, 2), range(len(kept))) if m == i]
    index = decontamination.index_windows([passage])
    kept = [r for r in kept if passage not in r[1] and not any(decontamination.find_passages([r[1]], index))]
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    expected = {r[0]: tokenizer.encode(r[1], add_special_tokens=False).ids + [0] for r in kept}

    found = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in found} == set(expected) and len(expected) > 100
    assert sum(r["length"] for r in found) == sum(map(len, expected.values()))
    for r in found:
        ids = expected[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and r["doc_tokens"] == len(expected[r["doc_id"]])


def test_stages_with_clashing_columns_and_empty_tables(spark):
    schema = SCHEMA + ", _language string, _passages string, _file string, _row string"
    folder = scratch_folder(spark, "planted")
    spark.createDataFrame([(1, "some passage of the benchmark")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    rows = [(i, f"word{i} next{i} last{i} more", "xx", "s", 1, "a", "b", "c", "d") for i in range(20)] + [(None, "text without an id", "xx", None, None, None, None, None, None)] * 2
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:3]:
            made = stage(spark, docs, folder)
            assert made.columns == docs.columns, name
        assert corpus_pipeline.known_language(spark, docs, folder).count() == len(data)
        assert corpus_pipeline.one_of_each(spark, docs, folder).count() == len(set(data))
        assert corpus_pipeline.without_benchmark(spark, docs, folder).count() == len(data)
        assert (corpus_pipeline.packed(spark, docs, folder).count() > 0) == bool(data)


def test_a_language_with_one_labelled_document_is_kept(spark):
    rnd = random.Random(9)

    def text(syllables: str) -> str:
        return " ".join("".join(rnd.choice(syllables.split()) for _ in range(rnd.randint(1, 3))) for _ in range(80))

    rows = [(i, text("ba be bi bo bu da de di"), "aa", "s", 1) for i in range(30)]
    rare = [(100 + i, text("xyl xor quy qel zyx"), "bb" if i == 1 else None, "s", 1) for i in range(6)]
    other = [(200, "日本語の文章はここでは学ばれていません", None, "s", 1), (201, "12 34", "aa", "s", 1), (202, None, "aa", "s", 1)]
    docs = spark.createDataFrame(rows + rare + other, SCHEMA)
    assert zlib.crc32(b"101") % 4 != 2
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, "").collect()}
    assert kept >= {r[0] for r in rows + rare} and not kept & {201, 202}
    many = spark.createDataFrame([(i + 300, *r[1:]) for i, r in enumerate(rows * 5)], SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, many.unionByName(spark.createDataFrame(other, SCHEMA)), "").collect()}
    assert kept == {300 + i for i in range(150)}
