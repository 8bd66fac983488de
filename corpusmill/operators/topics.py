"""Words, sizes and similarity of topics, and topics over time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, PCA, HashingTF, IDFModel, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.arrays import halved_sums
from corpusmill.functions.text import vocab_tokens
from corpusmill.session import cut_lineage, small_side

# Accepted range of the cluster count, and the count used outside it.
MIN_CLUSTERS, MAX_CLUSTERS, DEFAULT_CLUSTERS = 1, 29, 7


def cluster_count(asked: int | None) -> int:
    ok = asked is not None and MIN_CLUSTERS <= int(asked) <= MAX_CLUSTERS
    return int(asked) if ok else DEFAULT_CLUSTERS


# --- words per topic ------------------------------------------------------------------------------


def word_counts(
    df: DataFrame, group: Sequence[str], text: str, words: Sequence[str] = (), ngram_range: tuple[int, int] = (1, 1)
) -> DataFrame:
    """(group, word, n). Tokens are counted per task before the shuffle; the table is written, so the texts are read once."""
    tokens = df.select(*group, F.explode(vocab_tokens(F.col(text), words, ngram_range)).alias("word"))
    return cut_lineage(tokens.groupBy(*group, "word").agg(F.count(F.lit(1)).alias("n")))


def c_tf_idf(
    df: DataFrame,
    group: Sequence[str],
    text: str,
    words: Sequence[str] = (),
    ngram_range: tuple[int, int] = (1, 1),
    documents: Column | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """(group, word, n, score): share of the word in the group times ``ln(documents / count of the word)``.

    The groups that hold one word are as many as there are topics (or topic and time cells). ``counts`` are those of
    ``word_counts`` for the same texts, words and n-grams by these groups or by finer ones, which are added up.
    """
    group = list(group)
    if counts is None:
        counts = word_counts(df, group, text, words, ngram_range)
    elif set(counts.columns) != {*group, "word", "n"}:
        counts = cut_lineage(counts.groupBy(*group, "word").agg(F.sum("n").alias("n")))
    size = cut_lineage(counts.groupBy(*group).agg(F.sum("n").alias("_group")))
    m = df.agg(F.count(F.lit(1)).cast("double")).scalar() if documents is None else documents
    everywhere = counts.withColumn("_word", F.sum("n").over(Window.partitionBy("word")))
    scored = everywhere.join(small_side(size), group).withColumn("_m", m)
    score = F.col("n") / F.col("_group") * F.log(F.col("_m") / F.col("_word"))
    return scored.select(*group, "word", "n", score.alias("score"))


def top_words(scores: DataFrame, group: Sequence[str], n: int = 5) -> DataFrame:
    """The n best words of every group, with their rank."""
    best = Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("word"))
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def topic_sizes(df: DataFrame, topic: str) -> DataFrame:
    return df.groupBy(topic).agg(F.count(F.lit(1)).alias("size")).orderBy(F.col("size").desc(), topic)


def _words_in_order(best: DataFrame, group: Sequence[str], separator: str, name: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("rank", "word")))
    return best.groupBy(*group).agg(F.array_join(F.transform(rows, lambda r: r["word"]), separator).alias(name))


def topic_info(df: DataFrame, topic: str, best: DataFrame, name_words: int = 4) -> DataFrame:
    """Topic, size, and a name made of the topic number and its first words."""
    names = _words_in_order(best.where(F.col("rank") <= name_words), [topic], "_", "_words")
    return topic_sizes(df, topic).join(names, topic, "left").select(
        topic, "size", F.concat_ws("_", F.col(topic).cast("string"), "_words").alias("name")
    )


def topic_report(info: DataFrame, best: DataFrame, topic: str, k: int = 5) -> DataFrame:
    """Topic name, size, word and score, k rows per topic, in topic order."""
    title = F.regexp_replace(F.regexp_replace("name", "^[^_]*_", ""), "_", " | ")
    rows = info.join(best.where(F.col("rank") <= k), topic)
    return rows.select(topic, title.alias("topic_name"), F.col("size").alias("topic_size"), "rank", "word", "score").orderBy(
        topic, "rank"
    )


# --- topics over time -----------------------------------------------------------------------------


def time_bin(time: Column, low: Column, high: Column, bins: int) -> Column:
    """Number (from 0) of one of ``bins`` equal bins between two times; the end belongs to the last."""
    span = (F.unix_micros(high.cast("timestamp")) - F.unix_micros(low.cast("timestamp"))).cast("double")
    passed = (F.unix_micros(time.cast("timestamp")) - F.unix_micros(low.cast("timestamp"))).cast("double")
    place = F.floor(passed * bins / span).cast("int")
    return F.when(span == 0, F.lit(0)).otherwise(F.least(place, F.lit(bins - 1)))


def with_time_bins(df: DataFrame, time: str, bins: int = 20, name: str = "bin") -> DataFrame:
    span = df.agg(F.struct(F.min(time).alias("low"), F.max(time).alias("high"))).scalar()
    placed = df.withColumn("_span", span)
    return placed.withColumn(name, time_bin(F.col(time), F.col("_span.low"), F.col("_span.high"), bins)).drop("_span")


def topics_over_time(
    df: DataFrame, topic: str, text: str, time: str, words: Sequence[str] = (), bins: int = 20, top: int = 5, counts: DataFrame | None = None
) -> DataFrame:
    """Documents and best words of every topic in every time bin. ``counts`` are those of ``word_counts`` by topic and
    ``bin``, of the rows of ``with_time_bins``, where they are known."""
    binned = with_time_bins(df, time, bins)
    cell = [topic, "bin"]
    frequency = binned.groupBy(*cell).agg(F.count(F.lit(1)).alias("frequency"), F.min(time).alias("first_time"))
    best = top_words(c_tf_idf(binned, cell, text, words, counts=counts), cell, top)
    return frequency.join(_words_in_order(best, cell, ", ", "words"), cell, "left").select(
        *cell, "first_time", "frequency", "words"
    )


def tuned_word_scores(df: DataFrame, topic: str, text: str, time: str, words: Sequence[str] = (), bins: int = 20) -> DataFrame:
    """(topic, bin, word, score): the words of every topic in every bin that has documents of it, tuned.

    A cell's scores, as shares of their absolute sum, are averaged with those of the whole topic, and from the
    topic's second bin on with the tuned ones of its bin before. So words that a bin lacks for once keep a part of
    their weight. The texts are read once; the topic's own scores are added up from the counts of its cells. A row
    before the fold is a word of a topic with at most ``bins`` cells.
    """
    cell = [topic, "bin"]
    binned = with_time_bins(df, time, bins)
    size = cut_lineage(binned.groupBy(*cell).agg(F.count(F.lit(1)).alias("_docs")))
    documents = size.agg(F.sum("_docs").cast("double")).scalar()
    cells = cut_lineage(c_tf_idf(binned, cell, text, words, documents=documents))
    counts = cells.groupBy(topic, "word").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("bin", "score"))).alias("_cells"))
    counts = cut_lineage(counts)
    tokens = small_side(cut_lineage(counts.groupBy(topic).agg(F.sum("n").alias("_tokens"))))
    everywhere = counts.groupBy("word").agg(F.sum("n").alias("_word"))
    own = F.col("n") / F.col("_tokens") * F.log(F.col("_m") / F.col("_word"))
    scored = cut_lineage(counts.join(everywhere, "word").join(tokens, topic).withColumn("_m", documents).select(topic, "word", "_cells", own.alias("_own")))
    of_cells = cells.groupBy(*cell).agg(F.sum(F.abs("score")).alias("_sum"))
    sums = of_cells.groupBy(topic).agg(F.map_from_entries(F.collect_list(F.struct("bin", "_sum"))).alias("_sums"))
    bins_of = size.groupBy(topic).agg(F.array_sort(F.collect_list("bin")).alias("_bins"))
    totals = scored.groupBy(topic).agg(F.sum(F.abs("_own")).alias("_all"))
    # A row for each topic.
    per_topic = small_side(cut_lineage(bins_of.join(sums, topic).join(totals, topic)))

    def share(value: Column, whole: Column) -> Column:
        return F.when(whole > 0, value / whole).otherwise(0.0)

    def both(at: Column) -> Column:
        here = share(F.coalesce(F.try_element_at("_cells", at), F.lit(0.0)), F.coalesce(F.try_element_at("_sums", at), F.lit(0.0)))
        return (here + share(F.col("_own"), F.col("_all"))) / 2

    folded = halved_sums(F.transform("_bins", both))
    rows = scored.join(per_topic, topic).select(topic, "word", F.explode(F.arrays_zip(F.col("_bins").alias("bin"), folded.alias("score"))).alias("_f"))
    return rows.select(topic, F.col("_f.bin").alias("bin"), "word", F.round("_f.score", 9).alias("score"))


def tuned_topics_over_time(
    df: DataFrame, topic: str, text: str, time: str, words: Sequence[str] = (), bins: int = 20, top: int = 5
) -> DataFrame:
    """As ``topics_over_time``, with tuned scores, and ``weight``, the sum of the best words' scores."""
    cell = [topic, "bin"]
    frequency = with_time_bins(df, time, bins).groupBy(*cell).agg(F.count(F.lit(1)).alias("frequency"), F.min(time).alias("first_time"))
    rows = F.array_sort(F.collect_list(F.struct("rank", "word")))
    best = top_words(tuned_word_scores(df, topic, text, time, words, bins), cell, top).groupBy(*cell).agg(
        F.array_join(F.transform(rows, lambda r: r["word"]), ", ").alias("words"), F.sum("score").alias("weight")
    )
    return frequency.join(best, cell, "left").select(*cell, "first_time", "frequency", "words", "weight")


def peak_per_topic(over_time: DataFrame, topic: str) -> DataFrame:
    """The bin with most documents of each topic; the later one on a tie."""
    row = F.struct("frequency", "bin", "first_time", "words")
    peak = over_time.groupBy(topic).agg(F.max_by(row, F.struct("frequency", "bin")).alias("_p"))
    return peak.select(topic, *[F.col(f"_p.{c}").alias(c) for c in ("bin", "first_time", "frequency", "words")])


# --- similarity -----------------------------------------------------------------------------------


def _products(scores: DataFrame, topics: int, block_topics: int) -> DataFrame:
    """(left_topic, right_topic, product) of the topics that share words, from (t, word, s).

    A word's topics come in blocks of about ``block_topics``, and two blocks of a word meet in one task, so no
    task multiplies a word of very many topics alone. Products are added up per task before the shuffle.
    """
    blocks = max(1, -(-topics // block_topics))
    block = F.pmod(F.xxhash64("t"), F.lit(blocks)) if blocks > 1 else F.lit(0)
    cells = F.array_sort(F.collect_list(F.struct("t", "s")))
    held = scores.groupBy("word", block.alias("block")).agg(cells.alias("cells"))
    if blocks == 1:
        met = held.select(F.col("cells").alias("left"), F.col("cells").alias("right"))
    else:
        held = cut_lineage(held)
        other = held.select("word", F.col("block").alias("other"), F.col("cells").alias("right"))
        met = held.withColumnRenamed("cells", "left").join(other, "word").where(F.col("block") <= F.col("other"))
    lefts = met.select("right", F.explode("left").alias("l"))
    pairs = lefts.select("l", F.explode("right").alias("r"))
    # Two topics of one block meet twice, in both orders; of two blocks they meet once, in either order.
    once = pairs.where(F.col("l.t") < F.col("r.t"))
    if blocks > 1:
        apart = F.pmod(F.xxhash64("l.t"), F.lit(blocks)) != F.pmod(F.xxhash64("r.t"), F.lit(blocks))
        once = pairs.where((F.col("l.t") < F.col("r.t")) | (apart & (F.col("l.t") > F.col("r.t"))))
    low, high = F.least("l.t", "r.t"), F.greatest("l.t", "r.t")
    return once.groupBy(low.alias("left_topic"), high.alias("right_topic")).agg(F.sum(F.col("l.s") * F.col("r.s")).alias("product"))


def topic_similarity(scores: DataFrame, topic: str, block_topics: int = 256) -> DataFrame:
    """Cosine between the word scores of topics: (left_topic, right_topic, similarity), left < right.

    What is shuffled follows the pairs of topics, which are the result, and not the vocabulary.
    """
    scores = cut_lineage(scores.select(F.col(topic).alias("t"), "word", F.col("score").alias("s")))
    # One row per topic.
    norms = cut_lineage(scores.groupBy("t").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("size")))
    products = _products(scores, norms.count(), block_topics)
    left = norms.withColumnsRenamed({"t": "left_topic", "size": "_l"})
    right = norms.withColumnsRenamed({"t": "right_topic", "size": "_r"})
    every = left.join(right, F.col("left_topic") < F.col("right_topic"))
    size = F.col("_l") * F.col("_r")
    similarity = F.when(size == 0, F.lit(0.0)).otherwise(F.coalesce("product", F.lit(0.0)) / size)
    return every.join(products, ["left_topic", "right_topic"], "left").select("left_topic", "right_topic", similarity.alias("similarity"))


def _similarity_rows(similarity: DataFrame, places: DataFrame) -> DataFrame:
    """(place, others, values): a row per topic with its similarities, its own of 1 included, by place."""
    both = F.array(*[F.struct(F.col(a).alias("t"), F.col(b).alias("o"), "similarity") for a, b in (("left_topic", "right_topic"), ("right_topic", "left_topic"))])
    cells = similarity.select(F.explode(both).alias("_c")).select("_c.*").union(places.select("t", F.col("t").alias("o"), F.lit(1.0)))
    other = places.select(F.col("t").alias("o"), F.col("place").alias("other"))
    held = cells.join(small_side(places), "t").join(small_side(other), "o").groupBy("place").agg(F.collect_list(F.struct("other", "similarity")).alias("_c"))
    return held.select("place", F.col("_c.other").alias("others"), F.col("_c.similarity").alias("values"))


def topic_map(
    similarity: DataFrame, sizes: DataFrame, topic: str, dims: int = 2, rounds: int = 100, extra: int = 10, seed: int = 42
) -> DataFrame:
    """(topic, x, y, size): topics as points whose distances follow ``sqrt(2 - 2 * similarity)``, by classical scaling.

    ``similarity`` is as from ``topic_similarity``, ``sizes`` has a row (topic, size) for every topic; topics
    without a similarity have none to any other, a null topic has no place. The similarities stay in tasks, a row
    per topic; a round multiplies them with a few columns and brings back that many numbers per topic. Centring
    the columns before and after is centring the matrix. Rounds end when the leading values stand still. The
    widest coordinate of an axis is positive. One topic lies at 0; with other ``dims`` the axes are x1, x2 and on.
    """
    spark = similarity.sparkSession
    known = [r[0] for r in sizes.select(topic).where(F.col(topic).isNotNull()).distinct().orderBy(topic).collect()]
    names = ["x", "y"] if dims == 2 else [f"x{i + 1}" for i in range(dims)]
    kind = sizes.schema[topic].dataType.simpleString()
    schema = f"`{topic}` {kind}, " + ", ".join(f"{n} double" for n in names)
    points = np.zeros((len(known), dims))
    if len(known) > 1:
        places = spark.createDataFrame(list(zip(known, range(len(known)))), f"t {kind}, place int")
        matrix = cut_lineage(_similarity_rows(similarity, places))
        points = _leading_axes(matrix, len(known), dims, rounds, extra, seed)
    rows = [(t, *map(float, p)) for t, p in zip(known, points)]
    return spark.createDataFrame(rows, schema).join(sizes.select(topic, "size"), topic)


def _times(matrix: DataFrame, columns: np.ndarray) -> np.ndarray:
    """The centred matrix times the columns."""
    centred = columns - columns.mean(axis=0)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, others, values in zip(*(c.to_numpy(zero_copy_only=False) for c in batch.columns)):
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([values @ centred[others]], pa.list_(pa.float64()))], names=["place", "row"])

    got = matrix.select("place", "others", "values").mapInArrow(multiplied, "place int, row array<double>").collect()
    product = np.array([r["row"] for r in sorted(got, key=lambda r: r["place"])])
    return product - product.mean(axis=0)


def _leading_axes(matrix: DataFrame, size: int, dims: int, rounds: int, extra: int, seed: int) -> np.ndarray:
    """Coordinates on the leading axes of a symmetric matrix, by rounds of multiplying a few columns with it."""
    width = min(size, dims + extra)
    columns = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    before = None
    for _ in range(rounds):
        product = _times(matrix, columns)
        values, turns = np.linalg.eigh((columns.T @ product + product.T @ columns) / 2)
        values, axes = values[::-1][:dims], (columns @ turns)[:, ::-1][:, :dims]
        if before is not None and np.allclose(values, before, rtol=1e-10, atol=1e-12):
            break
        before, columns = values, np.linalg.qr(product)[0]
    found = np.zeros((size, dims))
    found[:, : len(values)] = axes * np.sqrt(np.maximum(values, 0))
    widest = np.abs(np.round(found, 9)).argmax(axis=0)
    return found * np.where(found[widest, range(dims)] < 0, -1, 1)


# --- features and clusters ------------------------------------------------------------------------


def hashed_counts(df: DataFrame, text: str, words: Sequence[str] = (), size: int = 512) -> DataFrame:
    """Add ``_tf``, the word counts of every row in ``size`` hashed places."""
    tokens = df.withColumn("_tokens", vocab_tokens(F.col(text), words))
    return HashingTF(numFeatures=size, inputCol="_tokens", outputCol="_tf").transform(tokens).drop("_tokens")


def word_rarity(counted: DataFrame) -> IDFModel:
    """What weighs the counts: the rarity of each hashed place over all rows of ``_tf``."""
    return IDF(inputCol="_tf", outputCol="_idf").fit(counted)


def weigh_counts(counted: DataFrame, rarity: IDFModel, output: str = "features") -> DataFrame:
    """The counts weighed by rarity, unit length, in place of ``_tf``."""
    return Normalizer(inputCol="_idf", outputCol=output).transform(rarity.transform(counted)).drop("_tf", "_idf")


def text_features(
    df: DataFrame, text: str, words: Sequence[str] = (), size: int = 512, output: str = "features", rarity: IDFModel | None = None
) -> DataFrame:
    """Hashed word counts weighed by rarity, unit length. A user's model can fill the column instead.

    ``rarity`` is that of the same texts where it is known; otherwise it is learned here by a reading of its own.
    """
    counted = hashed_counts(df, text, words, size)
    return weigh_counts(counted, word_rarity(counted) if rarity is None else rarity, output)


def vector_features(df: DataFrame, vector: str, output: str = "features") -> DataFrame:
    """An array column as a feature vector."""
    return df.withColumn(output, array_to_vector(F.col(vector).cast("array<double>")))


def reduce_dimensions(
    df: DataFrame, features: str = "features", dims: int = 5, output: str = "reduced", learned_from: DataFrame | None = None
) -> DataFrame:
    """The leading components. ``learned_from`` holds the features of the same rows where they are cheaper to read."""
    model = PCA(k=dims, inputCol=features, outputCol="_pca").fit(df if learned_from is None else learned_from)
    return model.transform(df).withColumn(output, vector_to_array("_pca")).drop("_pca")


def topic_clusters(df: DataFrame, features: str = "features", clusters: int | None = None, seed: int = 42, output: str = "topic") -> DataFrame:
    """Add the cluster number of every row: as many clusters as asked for, seven when none are."""
    count = DEFAULT_CLUSTERS if clusters is None else int(clusters)
    if count < 1:
        raise ValueError("at least one cluster")
    if count == 1:
        return df.withColumn(output, F.lit(0))
    model = KMeans(k=count, seed=seed, featuresCol=features, predictionCol=output).fit(df)
    return model.transform(df)
