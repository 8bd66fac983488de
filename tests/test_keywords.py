from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import automaton
from corpusmill.operators import keywords as K
from corpusmill.operators.timelines import jaro_winkler

CITY = [("Big Apple", "New York"), ("Bay Area", None)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string")


def names(spark, pairs, text, **options):
    words = K.dictionary(pairs, **options)
    return frame(spark, [text]).select(K.clean_names(F.col("t"), words)).first()[0]


def span_list(spark, pairs, text, **options):
    words = K.dictionary(pairs, **options)
    return [tuple(s) for s in frame(spark, [text]).select(K.spans(F.col("t"), words)).first()[0]]


def test_documented_examples(spark):
    assert names(spark, CITY, "I love Big Apple and Bay Area.") == ["New York", "Bay Area"]
    assert names(spark, CITY, "I love big Apple and Bay Area.", case_sensitive=True) == ["Bay Area"]
    assert span_list(spark, CITY, "I love big Apple and Bay Area.") == [("New York", 7, 16), ("Bay Area", 21, 29)]
    assert names(spark, [("Big Apple", None)], "I love Big Apple/Bay Area.") == ["Big Apple"]
    assert names(spark, [("Big Apple", None)], "I love Big Apple/Bay Area.", extra_word_characters="/") == []


def test_replace(spark):
    words = K.dictionary([*CITY, ("New Delhi", "NCR region")])
    df = frame(spark, ["I love Big Apple and new delhi.", "none here", "", None])
    out = {r["id"]: r["t"] for r in K.keyword_replace(df, "id", "t", words).collect()}
    assert out == {0: "I love New York and NCR region.", 1: "none here", 2: "", 3: None}


def test_dictionary_tables(spark):
    lists = spark.createDataFrame(
        [("java", ["java_2e", "java programing"]), ("product management", ["PM", "product manager"])], "name string, kws array<string>"
    )
    pairs = K.pairs_from_map(lists, "name", "kws").withColumn("ord", F.lit(0))
    bare = spark.createDataFrame([("java", "", 1), ("python", None, 1)], "keyword string, clean_name string, ord int")
    table = K.dictionary_table(pairs.unionByName(bare), "ord")
    text = "I am a product manager for a java_2e platform"
    found = K.keyword_spans(frame(spark, [text]), "id", "t", table).orderBy("hit_no").collect()
    assert [r["clean_name"] for r in found] == ["product management", "java"]
    removed = spark.createDataFrame([("java_2e",), ("PM",), ("java programing",)], "keyword string")
    left = K.keyword_remove(table, removed)
    found = K.keyword_spans(frame(spark, [text]), "id", "t", left).collect()
    assert [r["clean_name"] for r in found] == ["product management"]
    asked = spark.createDataFrame([("PYTHON",), ("pm",)], "keyword string")
    assert {r["asked"]: (r["present"], r["clean_name"]) for r in K.keyword_lookup(left, asked).collect()} == {
        "PYTHON": (True, "python"),
        "pm": (False, None),
    }


def test_later_pair_wins(spark):
    assert names(spark, [("a", "one"), ("A", "two")], "x a y") == ["two"]


def test_fuzzy_example(spark):
    entries = spark.createDataFrame([("Big Apple", "New York"), ("Bay Area", "Bay Area")], "keyword string, clean_name string")
    df = frame(spark, ["I love Big Aple and Baay Area.", "Big  Apple, Byy Arra", "bigapple"])
    for limit in (400, 0):
        found = K.keyword_fuzzy(df, "id", "t", entries, 1, 2, pattern_limit=limit).orderBy("id", "hit_no").collect()
        assert [(r["id"], r["clean_name"], r["lo"], r["hi"]) for r in found] == [(0, "New York", 7, 15), (0, "Bay Area", 20, 29)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


@pytest.mark.parametrize("max_cost", [0, 1, 2])
def test_similar_grams_against_brute_force(spark, max_cost):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
    grams = sorted({word() for _ in range(150)} | {f"{word()} {word()}" for _ in range(80)})
    keywords = sorted({word() for _ in range(20)} | {f"{word()} {word()}" for _ in range(10)})
    entries = spark.createDataFrame([(k, k) for k in keywords], "keyword string, clean_name string")
    found = K.similar_grams(spark.createDataFrame([(g,) for g in grams], "gram string"), entries, max_cost)
    got = {(r["gram"], r["keyword"], r["cost"]) for r in found.collect()}
    expected = set()
    for g in grams:
        for k in keywords:
            if g.count(" ") == k.count(" "):
                cost = sum(edit_distance(a, b) for a, b in zip(g.split(" "), k.split(" ")))
                if cost <= max_cost:
                    expected.add((g, k, cost))
    assert got == expected


def test_join_path_equals_pattern_path(spark):
    rng = random.Random(3)
    vocabulary = ["ab", "abc", "b", "ca", "a_b", "c1"]
    pairs = [("ab", "X"), ("ab abc", "Y"), ("b ca b", "Z"), ("c1", "c1"), ("a_b-b", "W"), ("abc.", "dot")]
    texts = ["".join(rng.choice(vocabulary) + rng.choice([" ", " ", ", ", "-", ".", "é"]) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    df = frame(spark, [*texts, "", None])
    entries = spark.createDataFrame(pairs, "keyword string, clean_name string")
    by_pattern = K.keyword_spans(df, "id", "t", entries)
    by_join = K.keyword_spans(df, "id", "t", entries, pattern_limit=0)
    rows = lambda d: sorted(tuple(r) for r in d.select("id", "clean_name", "lo", "hi").collect())
    assert rows(by_pattern) == rows(by_join)
    assert len(rows(by_join)) > 50
    a = {r["id"]: r["t"] for r in K.keyword_replace(df, "id", "t", K.dictionary(pairs)).collect()}
    b = {r["id"]: r["t"] for r in K.replace_by_join(df, "id", "t", entries).collect()}
    assert a == b


TRICKY = ["a \u017fo b", "SO so", "\u212aelvin kelvin K\u212a", "x Ab aB", ":) ab :)) é:)", "\u0130z iz", "\U0001f600 ab", "ПРИВЕТ привет приветы", "ΟΔΟΣ οδος", "ok\u212a", "c++ C++x", "ab\nab", "", None]
TRICKY_PAIRS = [("so", None), ("kelvin", "K"), ("Ab", "one"), ("aB", "two"), (":)", "smile"), ("iz", ""), ("привет", "hi"), ("οδος", "road"), ("ok", None), ("c++", "cpp"), ("", "none"), (None, "none")]


@pytest.mark.parametrize("case_sensitive", [False, True])
def test_both_paths_on_odd_keywords_and_letters(spark, case_sensitive):
    entries = spark.createDataFrame(TRICKY_PAIRS, "keyword string, clean_name string")
    df = frame(spark, TRICKY)
    rows = lambda limit: sorted(tuple(r) for r in K.keyword_spans(df, "id", "t", entries, case_sensitive, pattern_limit=limit).collect())
    found = rows(400)
    assert rows(0) == found
    assert all(name for _, _, name, _, _ in found)
    by_text = {i: [(name, TRICKY[i][lo:hi]) for j, _, name, lo, hi in found if j == i] for i in range(len(TRICKY))}
    assert by_text[0] == [] and by_text[4][0] == ("smile", ":)") and by_text[12] == by_text[13] == []
    if not case_sensitive:
        assert by_text[1] == [("so", "SO"), ("so", "so")]
        assert by_text[3] == [("two", "Ab"), ("two", "aB")]
        # Letters of other scripts end a word.
        assert by_text[7] == [("hi", "ПРИВЕТ"), ("hi", "привет"), ("hi", "привет")] and by_text[8] == [("road", "ΟΔΟΣ"), ("road", "οδος")]
    pattern = {r["id"]: r["t"] for r in K.keyword_replace(df, "id", "t", entries, case_sensitive).collect()}
    joined = {r["id"]: r["t"] for r in K.replace_by_join(df, "id", "t", entries, case_sensitive).collect()}
    assert pattern == joined and pattern[0] == TRICKY[0] and pattern[13] is None


def test_replace_by_keyword_itself_is_identity(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    words = K.dictionary([("the", "the"), ("of", "of")], case_sensitive=True)
    changed = K.keyword_replace(docs.withColumn("before", F.col("text")), "doc_id", "text", words)
    assert changed.where("text <> before").count() == 0


def test_highlight(spark):
    df = frame(spark, [" client: hello Operator: the hello "])
    row = K.highlight(df, "t", ["hello"], ["client:", "operator:"]).first()
    assert row["marked_text"] == "\nclient: hello \noperator: the hello"
    marks = [tuple(m) for m in row["highlight"]]
    assert [color for _, _, color in marks] == [1, None, 2, None]
    text = row["marked_text"]
    assert [text[lo:hi] for lo, hi, _ in marks] == ["client:", "hello", "operator:", "hello"]


def test_jaro_winkler():
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert jaro_winkler("abc", "xyz") == 0.0


def test_automaton_equals_pattern_and_join(spark):
    rnd = random.Random(21)
    signs = ["a", "b", "B", "c", " ", " ", "/", "-", "_", "é", "É", "İ", "ı", "ς", "Σ", "K", "ß", "1", "\U0001f600", "\n"]
    made = lambda most: "".join(rnd.choice(signs) for _ in range(rnd.randint(1, most)))
    for case_sensitive in (False, True):
        pairs = [(made(5), rnd.choice([None, "", f"n{i}"])) for i in range(80)] + [(None, "x"), ("", "y")]
        texts = [None, "", *[made(60) for _ in range(150)], "a b " * 2000]
        entries = spark.createDataFrame(pairs, "keyword string, clean_name string")
        df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
        ways = ((400, 0), (0, 1 << 26), (0, 0))
        found = [sorted(tuple(r) for r in K.keyword_spans(df, "id", "t", entries, case_sensitive, "-", limit, most).collect()) for limit, most in ways]
        assert found[0] == found[1] == found[2] and len(found[0]) > 50


def test_walk_finds_every_keyword_across_stretches():
    rnd = random.Random(22)
    words = {"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 9))) for _ in range(40)}
    built = automaton.build({w: w for w in words})
    text = "".join(rnd.choice("abx") for _ in range(3 * automaton.STRETCH + 17))
    ends, which = automaton.walk(np.array([ord(c) for c in text], np.uint32), built)
    expected = {(e, w) for w in words for e in range(len(w), len(text) + 1) if text.startswith(w, e - len(w))}
    got = [(int(e), built.names[k]) for e, k in zip(ends, which)]
    assert set(got) == expected and len(got) == len(expected)


def test_large_dictionary_meets_chunks_of_texts(spark, monkeypatch):
    rnd = random.Random(23)
    words = [f"w{i}x" for i in range(300)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate([*texts, None, ""])], "id bigint, t string").coalesce(2)
    pairs = [(w, w.upper()) for w in words[:200]] + [(f"{a} {b}", f"{a}+{b}") for a in words[::9] for b in words[::7]] + [("x w1", "no"), ("é", "e")]
    entries = spark.createDataFrame(pairs, "keyword string, clean_name string")
    rows = lambda d: sorted(map(tuple, d.collect()))
    # Ids repeat: each text has its own hits, as by the automaton.
    expected = rows(K.keyword_spans(df, "id", "t", entries, pattern_limit=0))
    monkeypatch.setattr(K, "CHUNK_BITS", 4)
    assert rows(K.keyword_spans(df, "id", "t", entries, pattern_limit=0, automaton_bytes=0)) == expected and len(expected) > 5000
    # Automata of few keywords each, one after the other.
    parts = K.spans_by_join(df, "id", "t", entries, part_bytes=20_000).selectExpr("id", "posexplode(spans) AS (n, s)").select("id", "n", "s.*")
    assert rows(parts) == expected


def test_hits_of_a_batch_are_columns(monkeypatch):
    """A batch of many hits must hold no object for each: at 6 GB its lists took more than the memory of a worker."""
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(automaton, "_SLICE", 1 << 14)
    built = automaton.build({"ab": "AB", "cd": "CD"})
    texts = pa.array(["ab cd " * 500] * 200 + [None, ""])
    automaton.spans(texts.slice(0, 1), lambda: [built], "abcd")
    tracemalloc.start()
    found = automaton.spans(texts, lambda: [built], "abcd")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.value_lengths().to_pylist() == [1000] * 200 + [0, 0]
    assert found[7].as_py()[:2] == [{"clean_name": "AB", "lo": 0, "hi": 2}, {"clean_name": "CD", "lo": 3, "hi": 5}]
    assert most < 100 * 200_000


def test_overlaps_leave_the_leftmost_then_the_longest():
    rnd = np.random.default_rng(24)
    for _ in range(200):
        spans = sorted(((int(s), int(s + n)) for s, n in zip(rnd.integers(0, 30, 12), rnd.integers(1, 8, 12))), key=lambda x: (x[0], -x[1]))
        done, expected = 0, []
        for s, e in spans:
            expected.append(s >= done)
            done = e if s >= done else done
        assert automaton.leftmost_longest(*np.array(spans).T).tolist() == expected
