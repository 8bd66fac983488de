from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.running import ordinal, ordinal_within, running_total
from corpusmill.operators import appeals as A
from corpusmill.operators import timelines as L

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


def assert_spikes(windows, times):
    """What the windows of a keyword have to be, by definition: nothing lies between them, each begins with the
    first moment a day or more after the start of the one before, and has its own last and middle moment."""
    starts = [start for start, *_ in windows]
    assert starts[0] == min(times) and sum(n for *_, n in windows) == len(times)
    for before, after in zip(starts, starts[1:]):
        assert after == min(t for t in times if t >= before + DAY)
    for (start, end, middle, n), until in zip(windows, [*starts[1:], max(times) + DAY]):
        own = sorted(t for t in times if start <= t < until)
        assert (end, middle, n) == (own[-1], own[len(own) // 2], len(own)) and end < start + DAY


def postings(seed):
    rng = random.Random(seed)
    hot = [START + dt.timedelta(seconds=rng.randint(0, 12 * 86_400)) for _ in range(1_500)]
    # Many postings at one moment, gaps of days, and moments exactly a day apart.
    burst = [START + DAY * 3] * 300 + [START + DAY * k for k in (0, 1, 2, 4, 9)] + [START + DAY - dt.timedelta(microseconds=1)]
    sparse = [START + dt.timedelta(hours=rng.randint(0, 2_000)) for _ in range(12)]
    return {"hot": hot, "burst": burst, "sparse": sparse, "one": [START]}


@pytest.mark.parametrize("head", [1, 3, 256])
def test_spikes_against_sequential_model(spark, head):
    data = postings(head)
    rows = [(k, t) for k, times in data.items() for t in times]
    df = spark.createDataFrame(rows, "keyword string, ts timestamp_ntz").repartition(7)
    got = {}
    for r in L.keyword_spikes(df, head=head).collect():
        got.setdefault(r["keyword"], []).append((r["window_start"], r["window_end"], r["middle"], r["value"]))
    assert set(got) == set(data)
    for keyword, times in data.items():
        assert_spikes(sorted(got[keyword]), times)


def test_daily_volume_share(spark):
    docs = [START + dt.timedelta(hours=h) for h in (1, 2, 3, 23, 25, 47, 49, 200)]
    df = spark.createDataFrame([("k", t) for t in docs], "keyword string, ts timestamp_ntz")
    spikes = L.keyword_spikes(df.where(F.col("ts") >= F.lit(START + dt.timedelta(hours=3))))
    got = L.daily_volume_share(spikes, df, "ts").orderBy("window_start").collect()
    # From 3:00: 3, 23, 25 (until day 2), then 47, 49 (days 2 and 3), then 200.
    assert [(r["value"], r["volume"], r["relative"]) for r in got] == [(3, 6, 50), (2, 3, 67), (1, 1, 100)]


def test_keyword_postings_count_a_document_once(spark):
    df = spark.createDataFrame([("a a b", START), ("b", START), ("c", START)], "t string, ts timestamp_ntz")
    got = L.keyword_postings(df, "t", "ts", ["a", "b", "a"]).groupBy("keyword").count().collect()
    assert {r[0]: r[1] for r in got} == {"a": 1, "b": 2}


def test_keyword_rank_leaves_out_similar_words(spark):
    rows = [("apple", 0.1), ("apples", 0.2), ("zebra", 0.3), ("zebras", 0.4), ("moon", 0.5)]
    features = spark.createDataFrame(rows, "word string, score double")
    for page in (1, 2, 100):
        assert [w for w, _ in L.keyword_rank(features, top=3, limit=0.8, page=page)] == ["apple", "zebra", "moon"]
    assert [w for w, _ in L.keyword_rank(features, top=2, limit=1.0)] == ["apple", "apples"]


def test_word_features_small(spark):
    df = spark.createDataFrame([("One two one. Three one!",), ("Two three.",)], "t string")
    got = {r["word"]: r for r in L.word_features(df, "t").collect()}
    assert {w: r["tf"] for w, r in got.items()} == {"one": 3, "two": 2, "three": 2}
    assert got["one"]["spread"] == pytest.approx(2 / 3)


def test_running_total_with_heavy_ties(spark):
    rng = random.Random(1)
    rows = [(i, 7 if i % 3 else rng.randint(0, 20), rng.randint(0, 5)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "id int, k int, v int").repartition(9)
    total, expected = 0, {}
    for i, k, v in sorted(rows, key=lambda r: (r[1], r[0])):
        total += v
        expected[i] = total
    assert {r["id"]: r["upto"] for r in running_total(df, ["k", "id"], "v", "upto").collect()} == expected
    order = [i for i, k, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert {r["id"]: r["ordinal"] for r in ordinal(df, ["k", "id"]).collect()} == {i: n + 1 for n, i in enumerate(order)}


def test_ordinal_within(spark):
    rows = [(i % 3, i) for i in range(100)]
    df = spark.createDataFrame(rows, "g int, i int")
    assert all(r["position"] == r["i"] // 3 + 1 for r in ordinal_within(df, "g", ["i"]).collect())


def test_bounds_lookup(spark):
    import bisect

    values = [5, 1, 5, 5, 9, 3, 5]
    keys = [0, 1, 2, 5, 6, 9, 10]
    ordered = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "v int")
    asked = spark.createDataFrame([(k,) for k in keys], "k int")
    got = {r["k"]: (r["leftmost_ge"], r["rightmost_le"]) for r in A.bounds_lookup(df, "v", asked, "k").collect()}
    expected = {}
    for k in keys:
        left = bisect.bisect_left(ordered, k)
        expected[k] = (left if left < len(ordered) else -1, bisect.bisect_right(ordered, k) - 1)
    assert got == expected


def test_paragraphs(spark):
    df = spark.createDataFrame([(2, "c  d"), (1, " a b\n"), (3, "  ")], "id int, t string")
    got = sorted((r["paragraph_id"], r["id"], r["content"]) for r in A.paragraphs(df, "id", "t").collect())
    assert got == [(0, 1, "a"), (1, 1, "b"), (2, 2, "c"), (3, 2, "d")]


def test_tuned_topics_follow_the_bin_before(spark):
    """Against the fold, word by word."""
    import datetime
    import math
    from collections import Counter, defaultdict

    from corpusmill.operators import topics as T

    rnd = random.Random(17)
    day = lambda i: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i)
    rows = [(i, rnd.choice([0, 1]), " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(rnd.randint(0, 6))), day(rnd.choice([0, 3, 9, 10]))) for i in range(60)]
    rows += [(90, 0, "alpha", day(0)), (91, 1, "beta", day(10)), (92, 2, "lonely words", day(4))]
    df = spark.createDataFrame(rows, "id int, topic int, t string, at timestamp_ntz")
    found = {(r["topic"], r["bin"], r["word"]): r["score"] for r in T.tuned_word_scores(df, "topic", "t", "at", bins=5).collect()}
    counts, everywhere = defaultdict(Counter), Counter()
    for _, topic, text, at in rows:
        cell = (topic, min(int((at - day(0)).days * 5 / 10), 4))
        counts[cell].update(text.split())
        everywhere.update(text.split())

    def shares(own: Counter) -> dict[str, float]:
        score = {w: n / sum(own.values()) * math.log(len(rows) / everywhere[w]) for w, n in own.items()}
        whole = sum(map(abs, score.values()))
        return {w: s / whole for w, s in score.items()} if whole else {}

    expected = {}
    for topic in (0, 1, 2):
        bins = sorted(b for t, b in counts if t == topic)
        own = shares(sum((counts[topic, b] for b in bins), Counter()))
        before: dict[str, float] | None = None
        for b in bins:
            here = shares(counts[topic, b])
            both = {w: (here.get(w, 0) + s) / 2 for w, s in own.items()}
            before = both if before is None else {w: (both[w] + before[w]) / 2 for w in own}
            expected |= {(topic, b, w): s for w, s in before.items()}
    assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-8 for k in found)


def test_word_features_write_a_row_for_each_word_and_no_pairs(spark, monkeypatch):
    """Pairs of neighbours were a table of their own, written and shuffled again for each side."""
    rnd = random.Random(31)
    words = [f"w{i}" for i in range(40)]
    texts = [". ".join(" ".join(rnd.choices(words, k=rnd.randint(1, 9))) for _ in range(rnd.randint(1, 6))) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None, "alone"]], "t string")
    written = []
    cut = L.cut_lineage
    monkeypatch.setattr(L, "cut_lineage", lambda d: (written.append(cut(d)), written[-1])[1])
    for window in (1, 2, 3):
        written.clear()
        found = {r["word"]: r for r in L.word_features(df, "t", window=window).collect()}
        assert sum(d.count() for d in written) == len(found) == 41
        lists = [re.findall(r"\w+", s) for t in texts for s in t.split(". ")] + [["alone"]]
        top = max(r["tf"] for r in found.values())
        for word in [*words, "alone"]:
            rights = [ws[i + a] for ws in lists for i, w in enumerate(ws) if w == word for a in range(1, window + 1) if i + a < len(ws)]
            lefts = [ws[i - a] for ws in lists for i, w in enumerate(ws) if w == word for a in range(1, window + 1) if i >= a]
            side = sum(len(set(x)) / len(x) for x in (lefts, rights) if x)
            tf = sum(ws.count(word) for ws in lists)
            assert found[word]["tf"] == tf and abs(found[word]["relatedness"] - (1 + side * tf / top)) < 1e-9
