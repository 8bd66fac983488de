"""Topics: words, sizes, course over time, similarity, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import topics as T
from corpusmill.plans.analysis import appeals_analysis as analyse
from corpusmill.plans.registered.registry import APPEALS_SQL, STOPWORDS, Tables, iso, iso_sql, query, r6, vocab_sql
from corpusmill.session import cut_lineage

_SCORES = (
    f"w AS (SELECT topic_id, unnest({vocab_sql('text', STOPWORDS)}) AS word FROM appeals), "
    "c AS (SELECT topic_id, word, count(*) AS n FROM w GROUP BY 1, 2), "
    "g AS (SELECT topic_id, sum(n) AS total FROM c GROUP BY 1), a AS (SELECT word, sum(n) AS everywhere FROM c GROUP BY 1), "
    "scores AS (SELECT topic_id, word, n, n / total * ln((SELECT count(*) FROM appeals)::DOUBLE / everywhere) AS score FROM c JOIN g USING (topic_id) JOIN a USING (word))"
)
_BEST = "best AS (SELECT topic_id, word, score, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, word) AS INTEGER) AS rank FROM scores QUALIFY rank <= 5)"
_INFO = (
    "sizes AS (SELECT topic_id, count(*) AS size FROM appeals GROUP BY 1), "
    "info AS (SELECT topic_id, size, topic_id || '_' || string_agg(word, '_' ORDER BY rank) AS name FROM sizes JOIN best USING (topic_id) WHERE rank <= 4 GROUP BY 1, 2)"
)


def _scores(t: Tables) -> DataFrame:
    return T.c_tf_idf(t.appeals, ["topic_id"], "text", STOPWORDS)


def _best(t: Tables) -> DataFrame:
    return T.top_words(_scores(t), ["topic_id"], 5)


@query("c_tf_idf", f"WITH {APPEALS_SQL}, {_SCORES} SELECT topic_id, word, n, round(score, 6) AS score FROM scores")
def c_tf_idf(t: Tables):
    return _scores(t).withColumn("score", r6(F.col("score")))


@query("top_words", f"WITH {APPEALS_SQL}, {_SCORES}, {_BEST} SELECT topic_id, rank, word, round(score, 6) AS score FROM best")
def top_words(t: Tables):
    return _best(t).select("topic_id", "rank", "word", r6(F.col("score")).alias("score"))


@query("topic_sizes", f"WITH {APPEALS_SQL} SELECT topic_id, count(*) AS size FROM appeals GROUP BY 1")
def topic_sizes(t: Tables):
    return T.topic_sizes(t.appeals, "topic_id")


@query("topic_info", f"WITH {APPEALS_SQL}, {_SCORES}, {_BEST}, {_INFO} SELECT topic_id, size, name FROM info")
def topic_info(t: Tables):
    return T.topic_info(t.appeals, "topic_id", _best(t))


@query(
    "topic_report",
    f"WITH {APPEALS_SQL}, {_SCORES}, {_BEST}, {_INFO} SELECT topic_id, replace(regexp_replace(name, '^[^_]*_', ''), '_', ' | ') AS topic_name, "
    "size AS topic_size, rank, word, round(score, 6) AS score FROM info JOIN best USING (topic_id)",
)
def topic_report(t: Tables):
    best = _best(t)
    report = T.topic_report(T.topic_info(t.appeals, "topic_id", best), best, "topic_id")
    return report.withColumn("score", r6(F.col("score")))


_TIME = (
    "span AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM appeals), "
    "binned AS (SELECT appeals.*, CAST(least(floor((epoch_us(ts) - lo)::DOUBLE * 20 / (hi - lo)::DOUBLE), 19) AS INTEGER) AS bin FROM appeals, span), "
    f"w AS (SELECT topic_id, bin, unnest({vocab_sql('text', STOPWORDS)}) AS word FROM binned), "
    "c AS (SELECT topic_id, bin, word, count(*) AS n FROM w GROUP BY ALL), "
    "g AS (SELECT topic_id, bin, sum(n) AS total FROM c GROUP BY ALL), a AS (SELECT word, sum(n) AS everywhere FROM c GROUP BY 1), "
    "scores AS (SELECT topic_id, bin, word, n / total * ln((SELECT count(*) FROM appeals)::DOUBLE / everywhere) AS score FROM c JOIN g USING (topic_id, bin) JOIN a USING (word)), "
    "best AS (SELECT topic_id, bin, word, row_number() OVER (PARTITION BY topic_id, bin ORDER BY score DESC, word) AS rank FROM scores QUALIFY rank <= 5), "
    "names AS (SELECT topic_id, bin, string_agg(word, ', ' ORDER BY rank) AS words FROM best GROUP BY ALL), "
    "freq AS (SELECT topic_id, bin, count(*) AS frequency, min(ts) AS first_time FROM binned GROUP BY ALL), "
    "over_time AS (SELECT topic_id, bin, frequency, first_time, words FROM freq LEFT JOIN names USING (topic_id, bin))"
)


@query(
    "topics_over_time",
    f"WITH {APPEALS_SQL}, {_TIME} SELECT topic_id, bin, frequency, {iso_sql('first_time')} AS first_time, words FROM over_time",
)
def topics_over_time(t: Tables):
    course = T.topics_over_time(t.appeals, "topic_id", "text", "ts", STOPWORDS)
    return course.withColumn("first_time", iso("first_time"))


@query(
    "topics_over_time_tuned",
    # The fold as one sum: a bin counts half of what the next one does, the first twice that.
    f"WITH {APPEALS_SQL}, {_TIME}, tn AS (SELECT topic_id, sum(n) AS total FROM c GROUP BY 1), o AS (SELECT topic_id, word, sum(n) AS n FROM c GROUP BY 1, 2), "
    "ow AS (SELECT topic_id, word, o.n / tn.total * ln((SELECT count(*) FROM appeals)::DOUBLE / everywhere) AS s FROM o JOIN tn USING (topic_id) JOIN a USING (word)), "
    "os AS (SELECT topic_id, word, s / sum(abs(s)) OVER (PARTITION BY topic_id) AS s FROM ow), "
    "cs AS (SELECT topic_id, bin, word, score / sum(abs(score)) OVER (PARTITION BY topic_id, bin) AS s FROM scores), "
    "r AS (SELECT topic_id, bin, row_number() OVER (PARTITION BY topic_id ORDER BY bin) - 1 AS r FROM freq), "
    "f AS (SELECT os.topic_id, os.word, r.bin, r.r, (coalesce(cs.s, 0) + os.s) / 2 AS g FROM os JOIN r ON r.topic_id = os.topic_id LEFT JOIN cs ON cs.topic_id = os.topic_id AND cs.word = os.word AND cs.bin = r.bin), "
    "t AS (SELECT topic_id, bin, word, round(sum(g * pow(2, r) * CASE r WHEN 0 THEN 1 ELSE 0.5 END) OVER (PARTITION BY topic_id, word ORDER BY r) / pow(2, r), 9) AS score FROM f), "
    "tb AS (SELECT *, row_number() OVER (PARTITION BY topic_id, bin ORDER BY score DESC, word) AS rank FROM t QUALIFY rank <= 5) "
    f"SELECT topic_id, bin, any_value(frequency) AS frequency, {iso_sql('any_value(first_time)')} AS first_time, string_agg(word, ', ' ORDER BY rank) AS words, round(sum(score), 6) AS weight "
    "FROM freq LEFT JOIN tb USING (topic_id, bin) GROUP BY 1, 2",
)
def topics_over_time_tuned(t: Tables):
    course = T.tuned_topics_over_time(t.appeals, "topic_id", "text", "ts", STOPWORDS)
    return course.withColumn("first_time", iso("first_time")).withColumn("weight", r6(F.col("weight")))


@query(
    "peak_per_topic",
    f"WITH {APPEALS_SQL}, {_TIME} SELECT topic_id, bin, frequency, {iso_sql('first_time')} AS first_time, words FROM over_time "
    "QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY frequency DESC, bin DESC) = 1",
)
def peak_per_topic(t: Tables):
    course = T.topics_over_time(t.appeals, "topic_id", "text", "ts", STOPWORDS)
    return T.peak_per_topic(course, "topic_id").withColumn("first_time", iso("first_time"))


@query(
    "topic_similarity",
    f"WITH {APPEALS_SQL}, {_SCORES}, sz AS (SELECT topic_id, sqrt(sum(score * score)) AS s FROM scores GROUP BY 1), "
    "p AS (SELECT a.topic_id AS left_topic, b.topic_id AS right_topic, sum(a.score * b.score) AS d FROM scores a JOIN scores b USING (word) "
    "WHERE a.topic_id < b.topic_id GROUP BY 1, 2), "
    "t AS (SELECT x.topic_id AS left_topic, y.topic_id AS right_topic, x.s * y.s AS s FROM sz x, sz y WHERE x.topic_id < y.topic_id) "
    "SELECT left_topic, right_topic, round(coalesce(d, 0) / s, 6) AS similarity FROM t LEFT JOIN p USING (left_topic, right_topic)",
)
def topic_similarity(t: Tables):
    return T.topic_similarity(_scores(t), "topic_id").withColumn("similarity", r6(F.col("similarity")))


@query("topic_map")
def topic_map(t: Tables):
    similarity = cut_lineage(T.topic_similarity(_scores(t), "topic_id"))
    placed = T.topic_map(similarity, T.topic_sizes(t.appeals, "topic_id"), "topic_id")
    return placed.select("topic_id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), "size")


@query("text_features")
def text_features(t: Tables):
    from pyspark.ml.functions import vector_to_array

    featured = T.text_features(t.texts, "text", STOPWORDS)
    v = vector_to_array("features")
    return featured.select("doc_id", F.size(F.filter(v, lambda x: x != 0)).alias("filled"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared"))


@query("appeals_analysis")
def appeals_analysis(t: Tables):
    return analyse(t.appeals, "doc_id", "text", "ts", STOPWORDS, clusters=7).report
