"""WARC archives by round trip, and vector search and the queries against brute force."""

from __future__ import annotations

import gzip
import hashlib
import io
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import queries, top_k, warc
from corpusmill.session import scratch_folder

PAGES = "page_id bigint, url string, html string, digest string, n string, archive string"


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


@pytest.fixture(scope="module")
def pages(spark):
    body = "<html>" + "é" * 100
    rows = [(1, "http://a/ü b", body, "", "", ""), (2, None, body, "", "", ""), (2, "u", body, "", "", ""), (3, "u", None, "", "", ""), (4, "u", "", "", "", ""), (5, "u", "short", "", "", ""), (6, "u", "short", "", "", ""), (None, "u", body, "", "", ""), (7, "u\r\nX: y", "x" * 3_000_000, "", "", ""), (8, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 20, "", "", ""), (0, "u", "x" * 3_000_000, "", "", "")]
    return spark.createDataFrame(rows, PAGES).repartition(3)


def test_archives(spark, pages):
    archives = warc.write_archives(pages, scratch_folder(spark, "warc"), archive_bytes=1000)
    rows = warc.read_archives(spark, archives).collect()
    first = {}
    for p in pages.collect():
        if p["page_id"] is not None:
            first[p["html"]] = min(first.get(p["html"], p["page_id"]), p["page_id"])
    expected = Counter()
    for p in pages.collect():
        data = (p["html"] or "").encode()
        back = first[p["html"]] if len(data) >= 100 and p["page_id"] is not None and first[p["html"]] < p["page_id"] else None
        expected[p["page_id"], "response" if back is None else "revisit", back, len(data), hashlib.sha256(data).hexdigest(), data if back is None else None] += 1
    assert Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"])) for r in rows) == expected
    assert sum(r["records"] for r in archives.collect()) == pages.count()
    for r in archives.collect():
        with open(local(r["archive"]), "rb") as stream:
            data = stream.read()
        members = 0
        while data:
            member = zlib.decompressobj(31)
            assert member.decompress(data).startswith(b"WARC/1.1\r\n") and member.eof
            data, members = member.unused_data, members + 1
        assert members == r["records"] and len(gzip.open(local(r["archive"])).read()) > 0


def test_damaged_archives_are_errors():
    good = warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), 7, None)
    assert [b for _, b in warc.read_records(io.BytesIO(good + good))] == [b"payload"] * 2
    assert [*warc.read_records(io.BytesIO(b""))] == []
    wrong = warc.record(1, "u", b"payload", hashlib.sha256(b"other").hexdigest(), 7, None)
    long = gzip.compress(gzip.decompress(good).replace(b"Content-Length: 7", b"Content-Length: 6"))
    for data in (good[:-4], good + b"junk", wrong, long, gzip.compress(b"no header")):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_records(io.BytesIO(data)))


def test_archives_of_nothing(spark):
    archives = warc.write_archives(spark.createDataFrame([], PAGES), scratch_folder(spark, "warc"))
    assert warc.read_archives(spark, archives).collect() == []


def brute(rows: list[tuple[int, list[float]]], k: int) -> set[tuple]:
    out = set()
    for q, v in {(q, tuple(v)) for q, v in rows if q % 3 == 0}:
        scored = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize(("head", "bucket", "block"), [(2048, 4096, 1 << 24), (5, 7, 600), (1, 50, 1 << 24)])
@pytest.mark.parametrize("threshold", [-1.0, 0.5, 2.0])
def test_top_k(spark, monkeypatch, head, bucket, block, threshold):
    monkeypatch.setattr(top_k, "COORDINATE_FROM", threshold)
    rnd = random.Random(head)
    rows = [(i, [float(rnd.randint(-9, 9)) * (1 + i % 4) for _ in range(8)]) for i in range(120)]
    rows += [(i, [1.0] * 8) for i in range(200, 260)] + [(300, [0.0] * 8), (301, [5.0, 1.0]), (303, [2.0, 2.0]), (306, [1.0, 0.0])]
    bad = [(400, None), (402, []), (405, [1.0, None] * 4), (408, [float("nan")] * 8), (411, [float("inf")] + [0.0] * 7), (None, [1.0] * 8)]
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad], "vec_id bigint, embedding array<double>, rank int, score int").repartition(3)
    found = top_k.top_k(vectors, F.col("vec_id") % 3 == 0, 5, head=head, bucket=bucket, block_bytes=block).collect()
    assert {tuple(r) for r in found} == brute(rows, 5) and len(found) == len({(r["query_id"], r["rank"]) for r in found})


def test_top_k_of_nothing(spark):
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert top_k.top_k(vectors, F.col("vec_id") % 3 == 0, 5).collect() == []


def test_every_query_returns_its_columns(spark, folder):
    columns = {
        "op1_token_files": "doc_id start n_tokens ids_crc32", "op3_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op4_warc": "page_id payload_bytes payload_digest record_type refers_to", "op6_top_k": "query_id rank vec_id score",
        "op7_licenses": "doc_id n_words n_base first_word last_word base_labels labels score", "op8_language": "doc_id held_out lang_pred score",
        "op9_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op10_simhash": "doc_id fingerprint component_id",
    }
    for name, expected in columns.items():
        found = queries.QUERIES[name](spark, folder)
        assert set(expected.split()) <= set(found.columns), name
    assert os.path.exists(queries.WORD_BPE)
