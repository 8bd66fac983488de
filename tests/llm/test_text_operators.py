"""Text operators against brute force, with nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import common, decontamination, language, licenses, packing, queries, rollups, sharding, simhash, token_files
from corpusmill.llm.components import components
from corpusmill.llm.tokens import TextEncoder
from corpusmill.session import scratch_folder
from llm_models import slow_components, slow_fingerprint

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
SCHEMA = "doc_id bigint, text string, lang string, source string, shard string, fp string, hash string"
ODD = [None, "", " ", "  two  spaces ", "a\n\nb \n c", "Ünïcode ΣΣ ß İ 日本語 😀", "don't I'LL we've 's", "<|endoftext|> x<|startoftext|>", "x" * 3000, "under the MIT License " * 400, "é́ ́", "\t\x0b\x85\xa0."]


def rows_of(texts: list[str | None]) -> list[tuple]:
    return [(i, t, "en" if i % 3 else None, "s", "x", "y", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def mixed(spark):
    """Odd texts, a few ordinary ones, copies, a repeated row and a null id."""
    rnd = random.Random(5)
    words = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam".split()
    texts = ODD + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 900))) for _ in range(40)]
    rows = rows_of(texts + texts[-5:])
    rows += [rows[20], rows[20], (None, "no id", "en", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4, "doc_id")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def encoded(path: str, text: str | None) -> list[int]:
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_the_library(path):
    rnd = random.Random(2)
    signs = [" ", "  ", "\n", "\t", "a", "B", "é", "É", "'s", "'", "don't", "1", "23", ".", "!!", "<|endoftext|>", "ß", "İ", "日本", "\xa0", "́", "µ", "²", "The", "\x85", "\x1c", "😀", "_"]
    texts = ODD + ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 14))) for _ in range(1500)]
    own, theirs = TextEncoder(path), Tokenizer.from_file(path)
    ids, counts = own.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    for text, end, n in zip(texts, ends, counts):
        assert ids[end - n : end].tolist() == theirs.encode(text or "", add_special_tokens=False).ids, text


def test_value_code_round_trip():
    rnd = random.Random(1)
    for n in (0, 1, 3, 4, 5, 1000):
        values = np.array([rnd.choice([0, 1, 255, 256, 65535, 65536, (1 << 24) - 1, 1 << 24, (1 << 32) - 1]) for _ in range(n)], np.uint32)
        control, data = token_files.pack_values(values)
        assert len(control) == -(-n // 4)
        assert token_files.unpack_values(control, data, n).tolist() == values.tolist()


def test_token_files(spark, mixed):
    folder = scratch_folder(spark, "t")
    token_files.write_token_files(mixed, folder, WORD, end_id=1, block_tokens=500)
    found = token_files.read_token_files(spark, folder).collect()
    tokenizer = Tokenizer.from_file(WORD)
    expected = [(r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in mixed.collect()]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in found) == Counter((i, tuple(v)) for i, v in expected)
    start = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert (r["start"], r["n_tokens"]) == (start, len(r["ids"]))
        start += r["n_tokens"]
    names = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert names == sorted(names)
    digests = {(r["start"], r["ids_crc32"]) for r in token_files.token_digests(spark, folder).collect()}
    assert digests == {(r["start"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in found}
    counts = Counter(i for _, ids in expected for i in ids)
    ranks = [r["id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()]
    assert ranks == sorted(counts, key=lambda i: (-counts[i], i))


def test_token_files_of_nothing(spark, empty):
    folder = scratch_folder(spark, "t")
    token_files.write_token_files(empty, folder, WORD, end_id=1)
    assert token_files.read_token_files(spark, folder).collect() == []


def test_plan_packs_covers_every_rest():
    rnd = random.Random(3)
    for size, shortest in ((64, 4), (1024, 16), (16, 100)):
        histogram = {n: rnd.randint(0, 40) for n in range(1, size)}
        runs, packs = packing.plan_packs(histogram, size, shortest)
        parts, used = defaultdict(list), defaultdict(list)
        for run in runs:
            for k in range(run.count):
                parts[run.rest, run.first + k].append((run.start, run.length))
                used[run.pack + k].append((run.offset, run.length))
        assert len(parts) == sum(histogram.values()) and len(used) == packs
        for (rest, _), own in parts.items():
            at = 0
            for start, length in sorted(own):
                assert start == at
                at += length
            assert at == rest
        for own in used.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= size


def test_packing(spark, mixed):
    pieces = packing.pack_documents(mixed, BYTE, end_id=0, size=128).collect()
    tokenizer = Tokenizer.from_file(BYTE)
    expected = Counter((r["doc_id"], tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0])) for r in mixed.collect())
    places = defaultdict(list)
    documents = defaultdict(list)
    for p in pieces:
        places[p["sequence_id"]].append((p["offset"], p["length"]))
        documents[p["doc_id"], p["doc_tokens"]].append(p)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 128
    assert sorted(places) == list(range(len(places)))
    for (name, ids), n in expected.items():
        got = Counter((p["start"], p["length"]) for p in documents[name, len(ids)] if np.frombuffer(p["ids"], "<u4").tolist() == list(ids[p["start"] : p["start"] + p["length"]]))
        assert sum(k[1] * v for k, v in got.items()) == n * len(ids)
    assert sum(p["length"] for p in pieces) > 0.9 * 128 * len(places)


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty, BYTE, end_id=0).collect() == []


def shard_rows(spark, docs, **options):
    folder = scratch_folder(spark, "t")
    sharding.write_shards(docs, folder, **options)
    return sharding.read_shards(spark, folder, docs)


def test_sharding(spark, mixed):
    found = shard_rows(spark, mixed, shards=5, parts=2)
    assert found.columns == [*mixed.columns, "slot", "_shard"]
    rows = found.collect()
    assert Counter(tuple(r)[:7] for r in rows) == Counter(map(tuple, mixed.collect()))
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r["_shard"]] += len((r["text"] or "").encode()) + 16
        slots[r["_shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding_is_even_with_a_hot_group(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i} {'x' * (i % 50)}", None, None, None, None, None) for i in range(6000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sizes, groups = Counter(), defaultdict(set)
    for r in shard_rows(spark, docs, shards=7).collect():
        sizes[r["_shard"]] += len(r["text"]) + 16
        groups[r["text"]].add(r["_shard"])
    mean = sum(sizes.values()) / 7
    assert max(abs(v - mean) for v in sizes.values()) <= 0.01 * mean + 100
    assert sum(len(v) > 1 for v in groups.values()) == 1


@pytest.mark.parametrize("doc_id", [None, 7])
def test_sharding_parts_rows_of_one_text_and_id(spark, doc_id):
    rows = [(doc_id if i % 2 else i, "the same text" if i % 2 else f"text {i}", None, None, None, None, None) for i in range(4000)]
    found = shard_rows(spark, spark.createDataFrame(rows, SCHEMA), shards=8).groupBy("_shard").agg(F.sum(F.length("text") + 16).alias("bytes"), F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")).collect()
    mean = sum(r["bytes"] for r in found) / 8
    assert len(found) == 8 and sum(r["n"] for r in found) == 4000
    assert max(abs(r["bytes"] - mean) for r in found) <= 0.01 * mean + 100
    assert all(r["slots"] == r["n"] == r["last"] + 1 for r in found)


def test_row_keys_beside_a_column_of_that_name(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id bigint, _metadata string")
    for table in (docs, common.written(docs)):
        keyed, key = common.with_row_key(table)
        assert [c for c in keyed.columns if c not in key] == docs.columns
        assert keyed.select(key).distinct().count() == 3
        assert sorted(map(str, keyed.select("doc_id", "_metadata").collect())) == sorted(map(str, docs.collect()))


def test_sharding_of_nothing(spark, empty):
    assert shard_rows(spark, empty, shards=3).collect() == []


@pytest.mark.parametrize("group", [2048, 2])
def test_simhash(mixed, group):
    rows = mixed.collect()
    fps = [slow_fingerprint(r["text"], 3) for r in rows]
    least: dict[int, int | None] = {}
    marks = slow_components(fps, 2)
    for r, m in zip(rows, marks):
        known = least.setdefault(m, r["doc_id"])
        if r["doc_id"] is not None:
            least[m] = r["doc_id"] if known is None else min(known, r["doc_id"])
    expected = Counter((r["doc_id"], fp, least[m]) for r, fp, m in zip(rows, fps, marks))
    found = simhash.simhash_components(mixed, group=group).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in found) == expected


@pytest.mark.parametrize("group", [2048, 3])
def test_fingerprints_that_hang_together(spark, group):
    rnd = random.Random(9)
    centres = [rnd.getrandbits(64) for _ in range(40)]
    fps = {0, (1 << 64) - 1}
    for c in centres:
        for _ in range(12):
            value = c
            for _ in range(rnd.randint(0, 3)):
                value ^= 1 << rnd.randrange(64)
            fps.add(value)
    fps = sorted(fps)
    signed = [v - (1 << 64) if v >> 63 else v for v in fps]
    table = spark.createDataFrame([(v,) for v in signed], "fp bigint").repartition(5)
    roots = {r["node"]: r["root"] for r in components(simhash._edges(table, 2, group)).collect()}
    marks = slow_components(fps, 2)
    groups, expected = defaultdict(set), defaultdict(set)
    for v, m in zip(signed, marks):
        groups[roots.get(v, v)].add(v)
        expected[m].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_simhash_of_nothing(empty):
    assert simhash.simhash_components(empty).collect() == []


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (3, 2)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(101)} | {i: 1000 for i in range(1000, 1100)}


def test_language(spark, mixed):
    rnd = random.Random(4)
    bags = {"aa": "kato mira lonu tesa".split(), "bb": "strum blesk krodd vrint".split(), "cc": "öäü äöß üßö".split()}
    rows = [(i, " ".join(rnd.choice(bags[lang]) for _ in range(30)), lang, None, None, None, None) for i in range(300) for lang in [rnd.choice(sorted(bags))]]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = language.identify_languages(docs).collect()
    truth = {r[0]: r[2] for r in rows}
    assert all(r["lang_pred"] == truth[r["doc_id"]] and 0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    model = language.learn(docs)
    odd = language.identify_languages(mixed, model)
    assert odd.count() == mixed.count()
    for r in odd.join(mixed.select("doc_id", "text").distinct(), "doc_id").collect():
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")), r["text"]


def test_language_learns_from_labels_that_are_not_held_out_only(spark):
    rows = [(i, "kato mira lonu" if zlib.crc32(str(i).encode()) % 4 != 2 else "strum blesk krodd", "aa" if zlib.crc32(str(i).encode()) % 4 != 2 else "bb", None, None, None, None) for i in range(100)]
    assert {r["lang_pred"] for r in language.identify_languages(spark.createDataFrame(rows, SCHEMA)).collect()} == {"aa"}


def test_language_of_nothing(spark, empty):
    assert language.identify_languages(empty).collect() == []
    unlabelled = spark.createDataFrame([(1, "text", None, None, None, None, None)], SCHEMA)
    assert [r["lang_pred"] for r in language.identify_languages(unlabelled).collect()] == ["und"]


def slow_edits(pattern: list[int], text: list[int]) -> int:
    row = [0] * (len(text) + 1)
    for p in pattern:
        new = [row[0] + 1]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_finds_exactly_the_windows_within_budget(spark):
    rnd = random.Random(11)
    letters = "abcdefghij  "
    items = ["".join(rnd.choice(letters) for _ in range(n)) for n in (30, 60, 96, 150, 5)]
    texts: list[str | None] = [None, "", "no passage here"]
    for _ in range(60):
        item = list(rnd.choice(items[:4]))
        for _ in range(rnd.randint(0, 14)):
            at = rnd.randrange(len(item))
            item[at : at + rnd.randint(0, 1)] = rnd.choice(letters) * rnd.randint(0, 1)
        noise = ["".join(rnd.choice(letters) for _ in range(80)) for _ in range(2)]
        texts.append(noise[0] + " " + "".join(item).upper() + " " + noise[1])
    index = decontamination.index_windows(items)
    expected = set()
    for n, text in enumerate(texts):
        codes = decontamination.normalized(text or "")[0].tolist()
        for w, chars in enumerate(index.chars):
            if slow_edits(chars.tolist(), codes) <= index.edits[w]:
                expected.add((n, int(index.item[w])))
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id bigint, text string, found string, item_id string")
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(9, None)], "item_id bigint, text string")
    found = decontamination.contaminated(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected and expected
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, benchmark, block_chars=1).collect()} == expected
    for r in found:
        assert 0 <= r["start"] < r["end"] <= len(texts[r["doc_id"]])


def test_decontamination_finds_a_copied_part_wherever_it_begins():
    rnd = random.Random(12)
    letters = "abcdefghijklmnop"
    item = "".join(rnd.choice(letters) for _ in range(300))
    noise = "".join(rnd.choice("qrstuvwxyz") for _ in range(200))
    index = decontamination.index_windows([item])
    for size in (88, 96, 112):
        texts = [noise + item[a : a + size] + noise for a in range(len(item) - size + 1)]
        assert all(decontamination.find_passages(texts, index)), size


def test_decontamination_holds_one_block_of_the_benchmark_at_a_time(spark, monkeypatch):
    passages = [f"passage {c * 9} {c * 7} of the benchmark {c * 5}" for c in "abcdef"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*passages, passages[0] + " and " + passages[3], None, "none", "none"])], "doc_id bigint, text string, found string")
    benchmark = spark.createDataFrame(list(enumerate(passages)), "item_id bigint, text string")
    whole = sorted((r["doc_id"], *sorted(map(tuple, r["found"]))) for r in decontamination.with_passages(docs, benchmark, "found").collect())
    sent, build = [], decontamination.index_windows

    def noted(texts, *args, **kwargs):
        sent.append(len(texts))
        return build(texts, *args, **kwargs)

    monkeypatch.setattr(decontamination, "index_windows", noted)
    made = decontamination.with_passages(docs, benchmark, "found", block_chars=50)
    assert made.columns == docs.columns and sum(sent) == len(passages) and max(sent) <= 3
    # Blocks are read from what was written, none is left in the plan.
    assert "EvalPython" not in made._jdf.queryExecution().toString()
    assert sorted((r["doc_id"], *sorted(map(tuple, r["found"]))) for r in made.collect()) == whole


def test_decontamination_of_nothing(spark, empty, mixed):
    benchmark = spark.createDataFrame([(1, "under the mit license")], "item_id bigint, text string")
    assert decontamination.contaminated(empty, benchmark).collect() == []
    assert decontamination.contaminated(mixed, benchmark.limit(0)).collect() == []
    assert {r["doc_id"] for r in decontamination.contaminated(mixed, benchmark).collect()} == {9}


def slow_phrases(text: str | None) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for label, phrase in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def test_licenses(spark, mixed):
    texts = ["Released under the MIT License.", "CC BY NC cc by nc, cc-by-nc", "under the mit licence", "Apache License, Version 2.0 and under the MIT license", "liKense under the MIT liKense", "Licensed under the GNU General Public License, version 3.", "Released, kindly, under the MIT License", "Lizenz: cc by", "cc by nc" * 3, "é under the mit license é"]
    docs = spark.createDataFrame([(i, t, 1, None) for i, t in enumerate(texts)], "doc_id bigint, text string, labels int, score string").unionByName(mixed.select("doc_id", "text"), allowMissingColumns=True)
    found = licenses.scan_licenses(docs)
    assert found.columns[:4] == docs.columns
    rows = found.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == slow_phrases(r["text"]), r["text"]
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["_labels"].split(","))) and 0 <= r["_score"] <= 1
    labels = {r["text"]: r["_labels"] for r in rows}
    assert labels[texts[5]] == "gpl" and labels[texts[2]] == "" and labels[texts[6]] == "mit"
    assert "PythonUDF" not in found._jdf.queryExecution().toString()


def test_licenses_changed_near_an_edge(spark):
    """Whole notices of likeness 0.8 and more, whichever of their words are changed."""
    cases = {
        "Licensed under the CC BY-SA 4.0": "cc-by-sa", "licensed under GNU General Public License version 3": "gpl", "Licensed under CC BY 4.0": "cc-by",
        "text: Licenced under the Apache Licence, version 2.0 and so on": "apache-2", "nothing of the kind, under the terms of the house": "",
        "subject to these terms of that Mozilla Public License, v. 2.0": "mpl-2", "Permission is granted, free of charge, to any person obtaining copies of this software": "mit",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    assert {r["text"]: r["labels"] for r in licenses.scan_licenses(docs).collect()} == cases
    twice = spark.createDataFrame([(1, "so: licensed under the CC BY-SA 4.0 and")], "doc_id bigint, text string")
    (row,) = licenses.scan_licenses(twice).collect()
    assert [(s["label"], s["start"], s["stop"]) for s in row["spans"]] == [("cc-by-sa", 1, 9)] and row["score"] > 0.8


def test_licenses_of_a_text_with_very_many_spans_are_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "under the MIT License " * 400), (2, "under the MIT License")], "doc_id bigint, text string")
    expected = sorted(map(tuple, licenses.scan_licenses(docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 4_000)
    found = licenses.scan_licenses(docs)
    assert "strategy=broadcast" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == expected and [r[3] for r in expected] == [400, 1]


def test_licenses_of_nothing(empty):
    assert licenses.scan_licenses(empty).collect() == []


def test_rollup(spark, mixed):
    ledger = rollups.TokenRollup(spark, scratch_folder(spark, "t"))
    schema = "doc_id bigint, tokenizer string, op string, source string, lang string, n_tokens bigint, seq bigint, extra string"

    def totals():
        return {(r["source"], r["lang"], r["tokenizer"]): (r["documents"], r["tokens"]) for r in ledger.totals().collect()}

    first = [(1, "a", "insert", "s", "en", 5, 1, ""), (1, "a", "insert", "s", "en", 6, 2, ""), (2, "a", "insert", "s", None, 7, 1, ""), (3, "b", "insert", None, "de", None, 1, ""), (None, "a", "insert", "s", "en", 1, 1, ""), (None, "a", "insert", "s", "en", 1, 1, "")]
    assert totals() == {}
    assert ledger.commit("one", spark.createDataFrame(first, schema))
    assert totals() == {("s", "en", "a"): (3, 8), ("s", None, "a"): (1, 7), (None, "de", "b"): (1, 0)}
    second = [(1, "a", "revise", "t", "en", 10, 1, ""), (2, "a", "delete", None, None, None, 1, ""), (8, "a", "delete", None, None, None, 1, ""), (3, "b", "insert", None, "de", 0, 1, "")]
    assert ledger.commit("two", spark.createDataFrame(second, schema))
    expected = {("s", "en", "a"): (2, 2), ("t", "en", "a"): (1, 10), (None, "de", "b"): (1, 0)}
    assert totals() == expected
    assert not ledger.commit("two", spark.createDataFrame(second, schema))
    # A batch that broke off before its commit record counts only once it is written again.
    spark.createDataFrame([("z", "z", "z", 9, 9)], rollups._TOTALS).write.parquet(f"{ledger.folder}/totals/batch=three")
    assert totals() == expected
    assert ledger.commit("three", spark.createDataFrame([], schema)) and totals() == expected
    counted = rollups.count_tokens(mixed, {"w": WORD, "b": BYTE})
    tokenizers = {"w": Tokenizer.from_file(WORD), "b": Tokenizer.from_file(BYTE)}
    assert Counter((r["doc_id"], r["tokenizer"], r["n_tokens"]) for r in counted.collect()) == Counter((r["doc_id"], k, len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in mixed.collect() for k, t in tokenizers.items())
    with pytest.raises(ValueError):
        ledger.commit("../x", spark.createDataFrame([], schema))


def test_rollup_of_a_null_tokenizer_and_of_unknown_events(spark):
    ledger = rollups.TokenRollup(spark, scratch_folder(spark, "t"))
    schema = "doc_id bigint, tokenizer string, op string, source string, lang string, n_tokens bigint"
    ledger.commit("a", spark.createDataFrame([(1, None, "insert", "s", "en", 5), (1, "w", "insert", "s", "en", 4)], schema))
    ledger.commit("b", spark.createDataFrame([(1, None, "delete", None, None, None)], schema))
    assert [tuple(r) for r in ledger.totals().collect()] == [("s", "en", "w", 1, 4)]
    for op in ("oops", None):
        with pytest.raises(ValueError):
            ledger.commit("c", spark.createDataFrame([(1, "w", op, "s", "en", 1)], schema))
    assert ledger.batches() == ["a", "b"]


def test_rollup_query(spark):
    """The load, the deletes, the revisions and the batch sent twice, against a count by hand."""
    folder = scratch_folder(spark, "planted")
    texts = ODD[:8] + ["same text"] * 5 + ["other text", None]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    expected: Counter = Counter()
    for i, text, lang, source in rows:
        if not any((t or "") == (text or "") for _, t, *_ in rows[:i]):
            for name, path in (("word_bpe_49k", WORD), ("byte_bpe_50k", BYTE)):
                expected[source, lang, name, "n"] += 1
                expected[source, lang, name, "tokens"] += len(encoded(path, text)) + 1
    found = {}
    for r in queries.op5(spark, folder).collect():
        found[r["source"], r["lang"], r["tokenizer"], "n"] = r["documents"]
        found[r["source"], r["lang"], r["tokenizer"], "tokens"] = r["tokens"]
    assert found == expected


def test_decontamination_of_items_with_a_common_beginning_and_of_periods():
    rnd = random.Random(13)
    words = ["".join(rnd.choice("abcdefghilmnoprstu") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    beginning = " ".join(rnd.choice(words) for _ in range(25))
    items = [beginning + " " + " ".join(rnd.choice(words) for _ in range(20)) for _ in range(60)] + ["ab " * 60, "ab " * 60]
    index = decontamination.index_windows(items)
    noise = " ".join(rnd.choice(words) for _ in range(50))
    texts = [noise, beginning + " " + noise, noise + " " + items[7] + " " + noise, "x " + "ab " * 300]
    found = decontamination.find_passages(texts, index)
    assert [{f[0] for f in own} for own in found] == [set(), set(range(60)), set(range(60)), {60, 61}]
    assert max(e - s for i, s, e, *_ in found[2] if i == 7) >= len(items[7]) - 8
