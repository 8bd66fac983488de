"""Quality scores, the filter audit and periodic runs against plain versions."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from corpusmill.llm import filter_audit, periodic, quality, queries
from corpusmill.llm.recompression import Grammar
from corpusmill.session import scratch_folder

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fails int, runs string, statistics string, words string"
LABELS = "doc_id bigint, quality int, toxic int, source string"
WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def doc(i: int | None, text: str | None, lang: str | None = "en") -> tuple:
    return (i, text, lang, "s", len(text or ""), 1, "r", "s", "w")


def folder_of(spark, docs: list[tuple], labels: list[tuple]) -> str:
    folder = scratch_folder(spark, "planted")
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return folder


def test_extensions_on_a_grammar():
    rnd = np.random.default_rng(1)
    for turn in range(80):
        texts = [rnd.integers(0, rnd.integers(1, 4) + 1, rnd.integers(0, 30)) for _ in range(3)]
        if turn % 2:
            texts[0] = np.tile(rnd.integers(0, 2, rnd.integers(1, 5)), rnd.integers(1, 12))
        symbols = np.array([0, *itertools.chain(*[[*(t + 4), k + 1] for k, t in enumerate(texts)])])
        grammar, n = Grammar(symbols, 4), len(symbols)
        pairs = np.array([(i, j) for i in range(1, n) for j in range(i + 1, n)])
        for ahead in (True, False):
            found = grammar.extend(pairs[:, 0], pairs[:, 1], ahead)
            for (i, j), length in zip(pairs, found):
                slow = 0
                while symbols[i + slow if ahead else i - 1 - slow] == symbols[j + slow if ahead else j - 1 - slow]:
                    slow += 1
                assert slow == length


def slow_runs(words: list) -> list[tuple[int, int, int]]:
    found: dict[tuple[int, int], int] = {}
    for period in range(1, len(words) // 4 + 1):
        at = 0
        while at < len(words) - period:
            end = at
            while end < len(words) - period and words[end] == words[end + period]:
                end += 1
            if end + period - at >= max(6, 4 * period):
                found.setdefault((at, end + period - at), period)
            at = end + 1
    return sorted((start, length, period) for (start, length), period in found.items())


def test_find_runs():
    rnd = np.random.default_rng(2)
    for _ in range(300):
        texts = []
        for _ in range(rnd.integers(0, 5)):
            text = rnd.integers(0, rnd.integers(1, 5) + 1, rnd.integers(0, 60))
            if rnd.random() < 0.5:
                text = np.concatenate([text, np.tile(rnd.integers(0, 3, rnd.integers(1, 9)), rnd.integers(1, 12)), rnd.integers(0, 2, rnd.integers(0, 5))])
            texts.append(text)
        text, start, length, period = periodic.find_runs(texts)
        for i, words in enumerate(texts):
            assert list(zip(start[text == i], length[text == i], period[text == i])) == slow_runs(words.tolist())


def test_periodic_runs_query(spark):
    rnd = random.Random(4)
    texts: list[str | None] = [None, "", " \n ", "a", "a b a b a b a b c", "Ünï\xa0x " * 9, "x\x1cy " * 30, "la " * 5000, "b c\t" * 3 + "b c d"]
    for _ in range(200):
        words = [rnd.choice("abcdef") * rnd.randint(1, 2) for _ in range(rnd.randint(1, 120))]
        if rnd.random() < 0.5:
            words[rnd.randint(0, len(words)) : 0] = [rnd.choice("ab") for _ in range(rnd.randint(1, 6))] * rnd.randint(2, 9)
        texts.append("  ".join(words))
    docs = [doc(i, t) for i, t in enumerate(texts)]
    docs += [docs[4], docs[4], doc(None, "q r " * 8)]
    found = queries.op13(spark, folder_of(spark, docs, []))
    rows = defaultdict(list)
    for r in found.collect():
        rows[r["doc_id"]].append(tuple(r)[1:])
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sum(map(len, rows.values())) == len(docs)
    some = 0
    for i, text, *_ in docs:
        words = WHITE.findall(text or "")
        n, h = len(words), 1 if i is None else zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        runs = slow_runs(words)
        dropped = {k for start, length, period in runs for k in range(start + period, start + length)}
        best = min(((-length, start, period) for start, length, period in runs), default=None)
        longest = (best[1], -best[0], best[2], -best[0] * 1000 // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
        expected = (len(runs), *longest, *[hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)])
        assert all(r == expected for r in rows[i]), text
        some += len(runs) > 0
    assert some > 40


def test_periodic_runs_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert periodic.run_digests(periodic.periodic_runs(none)).collect() == []
    assert periodic.periodic_runs(spark.createDataFrame([doc(1, "a b " * 4)], DOCS)).first()["collapsed"] == "a b"


def slow_audit(docs: list[tuple], labels: list[tuple]) -> dict:
    rows = []
    for i, text, lang, *_ in docs:
        body = text or ""
        words = WHITE.findall(body)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", body)) > 3 * len(body), "D": bool(re.search(r"[#$%&*|]", body))}
        fails["E"] = i is not None and any(j is not None and j < i and (t or "") == body for j, t, *_ in docs)
        marks = [m for m in labels if m[0] is not None and m[0] == i]
        rows.append((lang or "", fails, any(m[1] == 1 for m in marks), any(m[2] == 1 for m in marks)))
    out: dict = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        over_all = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order):
                before = [any(r[1][x] for x in order[:step]) for r in own]
                gone = [r for r, b in zip(own, before) if not b and r[1][letter]]
                over_all[letter] += len(gone)
                kept = sum(not b and not r[1][letter] for r, b in zip(own, before))
                late = sum(b and r[1][letter] for r, b in zip(own, before))
                alone = sum(r[1][letter] and sum(r[1].values()) == 1 for r in own)
                out[part, "".join(order), step + 1] = [kept, len(gone), late, alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), value in out.items():
            if p == part:
                value.append(over_all[order[step - 1]])
    return out


def test_filter_audit_query(spark):
    rnd = random.Random(6)
    texts: list[str | None] = [None, "", "", "# a", "ÄÖ" * 40, "word " * 300, "X" * 50]
    for _ in range(60):
        words = [rnd.choice(["alpha", "beta", "Gamma", "DELTA", "x", "y|z", "ß"]) + str(rnd.randint(0, rnd.choice([3, 400]))) for _ in range(rnd.choice([5, 150, 199, 200, 260]))]
        texts.append(rnd.choice([" ", "\n", "\x0b\t"]).join(words))
    texts += rnd.choices(texts, k=30)
    docs = [doc(i, t, rnd.choice(["en", "de", "", None])) for i, t in enumerate(texts)]
    docs += [docs[10], docs[10], docs[70], doc(None, texts[10]), doc(None, texts[10], None), doc(-5, texts[8], "de")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1]), "s") for i in rnd.choices(range(-5, 120), k=60)] + [(None, 1, 1, "s")]
    found = queries.op12(spark, folder_of(spark, docs, labels))
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {tuple(r)[:3]: list(r)[3:] for r in found.collect()}
    assert got == slow_audit(docs, labels) and len(got) == 3 * 600


def test_filter_audit_of_many_rows_and_of_nothing(spark):
    big = 1 << 40
    counts = spark.createDataFrame([("p", 3, True, big), ("p", 3, None, 1), ("p", 0, False, 7), (None, 2, True, 5), ("p", None, True, 2)], "part string, fails int, good boolean, n bigint")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit_filters(counts, "XY", ["good"]).collect()}
    assert got["p", "XY", 1] == (9, big + 1, 0, 0, big, big + 1) and got["p", "XY", 2] == (9, 0, big + 1, 0, 0, big + 1)
    assert got["", "YX", 1] == (0, 5, 0, 5, 5, 10) and len(got) == 8
    assert filter_audit.audit_filters(counts.limit(0), "XY", ["good"]).collect() == []
    none = filter_audit.failure_counts(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert none.collect() == []
    with pytest.raises(ValueError):
        filter_audit.audit_filters(counts, "ABCDEFG")


def test_discriminant_is_the_difference_of_log_densities():
    rnd = np.random.default_rng(3)
    rows = [rnd.normal(size=(200, 3)), rnd.normal(size=(300, 3)) @ np.array([[2, 1, 0], [0, 1, 0], [0, 0, 0]]) + 1]
    model = quality.discriminant([200, 300], [r.sum(axis=0) for r in rows], [r.T @ r for r in rows], pooled=0.2, diagonal=0.1, least=0.01)
    spreads = [np.cov(r.T, bias=True) for r in rows]
    both = (200 * spreads[0] + 300 * spreads[1]) / 500
    x = rnd.normal(size=(5, 3))
    logs = []
    for own, spread, share in zip(rows, spreads, (0.4, 0.6)):
        c = 0.8 * spread + 0.2 * both
        c = 0.9 * c + 0.1 * np.diag(np.diag(c)) + 0.01 * np.eye(3)
        d = x - own.mean(axis=0)
        logs.append(np.log(share) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * (d @ np.linalg.inv(c) * d).sum(axis=1))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_quality_on_held_out_documents(spark, folder):
    found = queries.op11(spark, folder.replace("sf0.001", "sf0.01"))
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder.replace('sf0.001', 'sf0.01')}/labels.parquet").collect()}
    rows = found.collect()
    assert len(rows) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [(r["predicted"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    assert len(held) > 50 and np.mean([p == q for p, q in held]) > 0.95


def test_quality_of_odd_rows(spark):
    rnd = random.Random(8)
    good = [" ".join("".join(rnd.choice("abcdeilnorst") for _ in range(rnd.randint(2, 9))) for _ in range(rnd.randint(20, 200))).capitalize() + "." for _ in range(40)]
    docs = [doc(i, t if i % 2 else t.upper().replace(" ", "## ")) for i, t in enumerate(good)]
    docs += [doc(100, None), doc(101, ""), doc(102, " "), docs[1], docs[1], doc(None, good[1]), doc(103, good[3] * 2000)]
    labels = [(i, i % 2, 0, "s") for i in range(40)] + [(1, 1, 0, "s"), (None, 0, 0, "s"), (100, None, 0, "s"), (101, 7, 0, "s")]
    folder = folder_of(spark, docs, labels)
    rows = queries.op11(spark, folder).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[100] == score[101] and score[None] == score[1]
    assert all((score[i] > 0.5) == bool(i % 2) for i in range(40))
    table = spark.read.parquet(f"{folder}/documents.parquet")
    marks = spark.createDataFrame(labels, LABELS)
    assert {r["score"] for r in quality.score_quality(table, marks.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.score_quality(table, marks.filter("quality = 1")).collect()} == {1.0}
    assert quality.score_quality(table.limit(0), marks).collect() == []
