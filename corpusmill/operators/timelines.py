"""Ranked words of a set of texts, and their spikes over time."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import DIGITS_ONLY, index_tokens, let, sentences
from corpusmill.session import cut_lineage, small_side

# Size of the ranked list and the similarity above which two words count as one.
TOP_WORDS, SAME_WORD = 22, 0.22
WORDS = r"(?U)\w+"
SECOND = 1_000_000
DAY = 86_400 * SECOND
# Postings looked at per window-wide stretch of time and keyword in one round.
HEAD = 256


# --- ranked words ---------------------------------------------------------------------------------


def _sentence_words(sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit(WORDS), F.lit(0))


def _word_counts(df: DataFrame, text: str, window: int) -> DataFrame:
    """(word, sentence, n, firsts, heads, lefts, rights): words by sentence number.

    ``firsts`` counts the sentences that hold the word, ``heads`` those that begin with it, ``lefts`` and ``rights``
    its neighbours on either side.
    """

    def places(words: Column) -> Column:
        return F.transform(
            words,
            lambda word, i: F.struct(
                word.alias("word"),
                (F.array_position(words, word) == i + 1).cast("int").alias("first"),
                (i == 0).cast("int").alias("head"),
                F.least(i, F.lit(window)).alias("left"),
                F.least(F.size(words) - 1 - i, F.lit(window)).alias("right"),
            ),
        )

    parts = df.select(F.posexplode(sentences(F.lower(text))).alias("sentence", "_s"))
    tokens = parts.select("sentence", F.explode(let(_sentence_words(F.col("_s")), places)).alias("_t")).select("sentence", "_t.*")
    sums = [F.sum(c).alias(f"{c}s") for c in ("first", "head", "left", "right")]
    return tokens.groupBy("word", "sentence").agg(F.count(F.lit(1)).alias("n"), *sums)


def _neighbours(df: DataFrame, text: str, window: int) -> DataFrame:
    """(word, lefts, rights): how many different words stand beside each word.

    A pair of neighbours is one string, dropped where it comes again in its text, then in its task, and then shuffled
    once; nothing is counted with it and no pair is written. Words hold no space.
    """

    def beside(words: Column) -> Column:
        def at(apart: int) -> Column:
            followed = F.slice(words, 1, F.greatest(F.size(words) - apart, F.lit(0)))
            return F.transform(followed, lambda word, i: F.concat(word, F.lit(" "), F.get(words, i + apart)))

        return F.concat(*[at(apart) for apart in range(1, window + 1)])

    met = F.flatten(F.transform(sentences(F.lower(text)), lambda sentence: let(_sentence_words(sentence), beside)))
    pairs = df.select(F.explode(F.array_distinct(met)).alias("_pair")).distinct()
    sides = F.arrays_zip(F.split("_pair", " ").alias("word"), F.array(F.lit(False), F.lit(True)).alias("second"))
    ends = pairs.select(F.explode(sides).alias("_e")).select("_e.word", "_e.second")
    return ends.groupBy("word").agg(F.count_if("second").alias("_lefts"), F.count_if(~F.col("second")).alias("_rights"))


def word_features(df: DataFrame, text: str, stopwords: Sequence[str] = (), window: int = 2) -> DataFrame:
    """(word, tf, relatedness, position, spread, score) of the words of all texts; small scores are good.

    The published features of unsupervised single-document ranking, over a table of texts: how often
    a word occurs, in how many sentences, how early in its text, and how varied its neighbours are.
    Texts are lowered, so the feature about capital letters is 0.
    """
    ranked = ~F.col("word").rlike(DIGITS_ONLY)
    if stopwords:
        ranked = ranked & ~F.col("word").isin(list(stopwords))

    # Places in a text are bounded by the longest text.
    counted = _word_counts(df, text, window).groupBy("word").agg(
        F.sum("n").alias("tf"),
        F.sum("firsts").alias("in_sentences"),
        F.percentile("sentence", F.lit(0.5), F.col("firsts")).alias("_median"),
        *[F.sum(c).alias(c) for c in ("heads", "lefts", "rights")],
    )
    # A row for each word.
    frequency = cut_lineage(counted)
    sentence_count = frequency.agg(F.sum("heads")).scalar()

    numbers = frequency.where(ranked).agg(
        F.struct(F.avg("tf").alias("mean"), F.stddev_pop("tf").alias("std"), F.max("tf").alias("top"))
    ).scalar()
    joined = (
        frequency.where(ranked)
        .join(_neighbours(df, text, window), "word", "left")
        .withColumn("_c", numbers)
        .withColumn("_sentences", sentence_count)
    )
    tf = F.col("tf")
    variety = lambda name: F.when(F.col(name) > 0, F.col(f"_{name}") / F.col(name)).otherwise(0.0)
    side = variety("lefts") + variety("rights")
    features = joined.select(
        "word",
        "tf",
        (F.lit(1.0) + side * tf / F.col("_c.top")).alias("relatedness"),
        F.log(F.log(F.lit(3.0) + F.col("_median"))).alias("position"),
        (F.col("in_sentences") / F.col("_sentences")).alias("spread"),
        (tf / (F.col("_c.mean") + F.col("_c.std"))).alias("norm_tf"),
    )
    rel = F.col("relatedness")
    word_score = F.col("position") * rel / (F.col("norm_tf") / rel + F.col("spread") / rel)
    return features.withColumn("_h", word_score).select(
        "word", "tf", "relatedness", "position", "spread", (F.col("_h") / (tf * (F.col("_h") + 1))).alias("score")
    )


def jaro_winkler(left: str, right: str) -> float:
    """Similarity of two words from 0 to 1, raised for a shared beginning of up to four letters."""
    if left == right:
        return 1.0
    reach = max(max(len(left), len(right)) // 2 - 1, 0)
    free = [True] * len(right)
    matched = []
    for i, ch in enumerate(left):
        for j in range(max(0, i - reach), min(len(right), i + reach + 1)):
            if free[j] and right[j] == ch:
                free[j] = False
                matched.append(ch)
                break
    if not matched:
        return 0.0
    other = [ch for ch, unused in zip(right, free) if not unused]
    swapped = sum(a != b for a, b in zip(matched, other)) / 2
    m = len(matched)
    jaro = (m / len(left) + m / len(right) + (m - swapped) / m) / 3
    prefix = 0
    for a, b in zip(left[:4], right[:4]):
        if a != b:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _unlike(accepted: list[str], limit: float) -> Any:
    @F.pandas_udf("boolean")
    def unlike(words: pd.Series) -> pd.Series:
        return words.map(lambda w: all(jaro_winkler(w, a) <= limit for a in accepted))

    return unlike


def keyword_rank(features: DataFrame, top: int = TOP_WORDS, limit: float = SAME_WORD, page: int = 1_000) -> list[tuple[str, float]]:
    """The best words, leaving out those too similar to a better one.

    Candidates come to the driver a page at a time, best first. Between pages the tasks drop words
    similar to one already taken, so every page adds a word and there are at most ``top`` pages.
    """
    rest = cut_lineage(features.select("word", "score"))
    taken: list[tuple[str, float]] = []
    while len(taken) < top:
        left = rest.where(_unlike([w for w, _ in taken], limit)("word")) if taken else rest
        rows = left.orderBy("score", "word").limit(page).collect()
        for word, score in rows:
            if len(taken) < top and all(jaro_winkler(word, a) <= limit for a, _ in taken):
                taken.append((word, score))
        if len(rows) < page:
            break
    return taken


# --- spikes ---------------------------------------------------------------------------------------


def keyword_postings(df: DataFrame, text: str, time: str, keywords: Sequence[str], start: Any = None, end: Any = None) -> DataFrame:
    """(keyword, time) once per document that holds the keyword, in the date range asked for."""
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(time) <= F.lit(end))
    wanted = F.array(*[F.lit(k) for k in dict.fromkeys(keywords)])
    return df.select(F.explode(F.array_intersect(index_tokens(F.col(text)), wanted)).alias("keyword"), F.col(time).alias("ts"))


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def window_starts(moments: DataFrame, width: int = DAY, head: int = HEAD) -> DataFrame:
    """(keyword, start) of the windows that open at the first moment not covered by the one before.

    ``moments`` holds distinct (keyword, us). Windows of one keyword follow from each other, but one
    stretch of ``width`` holds at most one start, and usually among its first moments counted from
    where the chain stands. So a round takes only the first ``head`` moments of every stretch, which
    each task can cut to before the shuffle, follows the chain through them, and stops where it would
    need a later moment; the next round goes on from there. Short lists are complete and need no
    second round. No task ever holds all moments of a keyword.
    """
    state = cut_lineage(moments.groupBy("keyword").agg(F.min("us").alias("need")))
    done: DataFrame | None = None
    while True:
        ahead = moments.join(small_side(state), "keyword").where(F.col("us") >= F.col("need"))
        stretch = F.floor((F.col("us") - F.col("need")) / F.lit(width)).cast("bigint")
        order = Window.partitionBy("keyword", "_stretch").orderBy("us")
        heads = ahead.withColumn("_stretch", stretch).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= head + 1)
        # The moment after the last one kept marks a stretch as cut.
        item = F.struct("us", (F.col("_n") == head + 1).alias("cut"), (F.col("need") + (F.col("_stretch") + 1) * width).alias("stretch_end"))
        lists = heads.groupBy("keyword").agg(F.array_sort(F.collect_list(item)).alias("_items"), F.min("need").alias("need"))

        def step(acc: Column, item: Column) -> Column:
            halted = acc["halt"] | (item["cut"] & (acc["need"] < item["stretch_end"]) & (item["us"] < acc["need"]))
            # A cut marker is itself a real moment: when it is far enough it is the next start.
            opens = ~halted & (item["us"] >= acc["need"])
            return F.struct(
                F.when(opens, item["us"] + width).otherwise(acc["need"]).alias("need"),
                F.when(opens, F.concat(acc["starts"], F.array(item["us"]))).otherwise(acc["starts"]).alias("starts"),
                halted.alias("halt"),
            )

        first = F.struct(F.col("need"), F.array().cast("array<bigint>").alias("starts"), F.lit(False).alias("halt"))
        followed = cut_lineage(lists.select("keyword", F.aggregate("_items", first, step).alias("_r")))
        part = followed.select("keyword", F.explode("_r.starts").alias("start"))
        done = part if done is None else done.unionByName(part)
        state = followed.where("_r.halt").select("keyword", F.col("_r.need").alias("need"))
        if not state.limit(1).count():
            return done


def _ranked_moment(weighed: DataFrame, rank: str) -> DataFrame:
    """(keyword, start, us) of the moment at 0-based ``rank`` among the postings of each window.

    Counted by the second first: the seconds of a window and the moments of a second are both bounded.
    """
    window = ["keyword", "start"]
    second = F.floor(F.col("us") / SECOND).cast("bigint")
    timed = weighed.withColumn("_sec", second)
    seconds = timed.groupBy(*window, "_sec").agg(F.sum("n").alias("_n"), F.first(rank).alias(rank))
    upto = F.sum("_n").over(Window.partitionBy(*window).orderBy("_sec").rowsBetween(Window.unboundedPreceding, 0))
    chosen = seconds.withColumn("_upto", upto).where((F.col("_upto") > F.col(rank)) & (F.col("_upto") - F.col("_n") <= F.col(rank)))
    target = chosen.select(*window, "_sec", (F.col(rank) - (F.col("_upto") - F.col("_n"))).alias("_left"))
    inside = timed.join(target, [*window, "_sec"])
    passed = F.sum("n").over(Window.partitionBy(*window).orderBy("us").rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("_passed", passed).where(F.col("_passed") > F.col("_left")).groupBy(*window).agg(F.min("us").alias("us"))


def keyword_spikes(postings: DataFrame, width: int = DAY, head: int = HEAD) -> DataFrame:
    """(keyword, window_start, window_end, middle, value): documents per greedy window of each keyword.

    ``middle`` is the time of the posting halfway through the window, ``window_end`` of its last one.
    """
    moments = cut_lineage(postings.groupBy("keyword", _micros(F.col("ts")).alias("us")).agg(F.count(F.lit(1)).alias("n")))
    starts = cut_lineage(window_starts(moments.select("keyword", "us"), width, head))
    cell = F.floor(F.col("us") / F.lit(width)).cast("bigint")
    begin = F.floor(F.col("start") / F.lit(width)).cast("bigint")
    # A window touches the stretch it starts in and the next one.
    spread = starts.select("keyword", "start", F.explode(F.array(begin, begin + 1)).alias("_cell"))
    placed = moments.withColumn("_cell", cell).join(small_side(spread), ["keyword", "_cell"])
    placed = placed.where((F.col("us") >= F.col("start")) & (F.col("us") < F.col("start") + width)).drop("_cell")
    windows = placed.groupBy("keyword", "start").agg(F.sum("n").alias("value"), F.max("us").alias("last"))
    halved = windows.select("keyword", "start", F.floor(F.col("value") / 2).cast("bigint").alias("_rank"))
    middle = _ranked_moment(placed.join(halved, ["keyword", "start"]), "_rank").withColumnRenamed("us", "middle")

    def time(c: str) -> Column:
        return F.timestamp_micros(c).cast("timestamp_ntz")

    return windows.join(middle, ["keyword", "start"]).select(
        "keyword", time("start").alias("window_start"), time("last").alias("window_end"), time("middle").alias("middle"), "value"
    )


def daily_volume_share(spikes: DataFrame, documents: DataFrame, time: str) -> DataFrame:
    """Add ``relative``: the share, in whole percent, of all documents of the days a window touches."""
    days = documents.where(F.col(time).isNotNull()).groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    # One row per calendar day.
    upto = days.withColumn("upto", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    opening = upto.select(F.col("day").alias("_from"), (F.col("upto") - F.col("n")).alias("_before"))
    closing = upto.select(F.col("day").alias("_to"), F.col("upto").alias("_upto"))
    dated = spikes.withColumn("_from", F.to_date("window_start")).withColumn("_to", F.to_date("window_end"))
    volume = F.col("_upto") - F.col("_before")
    joined = dated.join(opening, "_from").join(closing, "_to")
    return joined.withColumn("volume", volume).withColumn(
        "relative", F.bround(F.col("value") * 100.0 / F.col("volume"), 0).cast("int")
    ).drop("_from", "_to", "_before", "_upto")
