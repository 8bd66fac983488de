"""Ranked words and spikes over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import timelines as L
from corpusmill.plans.analysis import topic_keyword_lines as lines_of_topic
from corpusmill.plans.registered.registry import (
    APPEALS_SQL,
    STOPWORDS,
    Tables,
    index_tokens_sql,
    iso,
    iso_sql,
    list_sql,
    query,
    r6,
    strip_sql,
)

KEYWORDS = ["the", "thin", "with", "la", "und", "ouèan", "stion"]


def chain_sql(postings: str) -> str:
    """SQL of the greedy one-day windows over ``post (keyword, ts)``."""
    return (
        f"{postings}, chain AS (SELECT keyword, min(ts) AS s FROM post GROUP BY 1 UNION ALL "
        "SELECT c.keyword, min(p.ts) FROM chain c JOIN post p ON p.keyword = c.keyword AND p.ts >= c.s + INTERVAL 1 DAY GROUP BY c.keyword, c.s), "
        "win AS (SELECT c.keyword, c.s, p.ts, row_number() OVER (PARTITION BY c.keyword, c.s ORDER BY p.ts) - 1 AS i, "
        "count(*) OVER (PARTITION BY c.keyword, c.s) AS value FROM chain c JOIN post p ON p.keyword = c.keyword AND p.ts >= c.s AND p.ts < c.s + INTERVAL 1 DAY), "
        "spikes AS (SELECT keyword, s AS window_start, max(ts) AS window_end, max(ts) FILTER (WHERE i = value // 2) AS middle, value FROM win GROUP BY keyword, s, value)"
    )


_DOC_POSTINGS = (
    f"{APPEALS_SQL}, tk AS (SELECT ts, list_distinct({index_tokens_sql('text')}) AS tk FROM appeals), "
    "post AS (SELECT keyword, ts FROM (SELECT ts, unnest(tk) AS keyword FROM tk) WHERE keyword IN " + list_sql(KEYWORDS) + ")"
)
_EVENT_POSTINGS = "post AS (SELECT event_type AS keyword, ts FROM events)"


@query(
    "keyword_spikes",
    f"WITH RECURSIVE {chain_sql(_DOC_POSTINGS)} SELECT keyword, {iso_sql('window_start')} AS window_start, {iso_sql('window_end')} AS window_end, "
    f"{iso_sql('middle')} AS middle, value FROM spikes",
)
def keyword_spikes(t: Tables):
    spikes = L.keyword_spikes(L.keyword_postings(t.appeals, "text", "ts", KEYWORDS))
    return spikes.select("keyword", *[iso(c).alias(c) for c in ("window_start", "window_end", "middle")], "value")


@query(
    "daily_volume_share",
    f"WITH RECURSIVE {chain_sql(_EVENT_POSTINGS)}, vol AS (SELECT s.keyword, s.window_start, count(*) AS volume FROM spikes s JOIN events e "
    "ON CAST(e.ts AS DATE) BETWEEN CAST(s.window_start AS DATE) AND CAST(s.window_end AS DATE) GROUP BY 1, 2) "
    f"SELECT keyword, {iso_sql('window_start')} AS window_start, {iso_sql('middle')} AS middle, value, volume, "
    "CAST(round_even(value * 100.0::DOUBLE / volume, 0) AS INTEGER) AS relative FROM spikes JOIN vol USING (keyword, window_start)",
)
def daily_volume_share(t: Tables):
    spikes = L.keyword_spikes(t.events.select(F.col("event_type").alias("keyword"), "ts"))
    shared = L.daily_volume_share(spikes, t.events, "ts")
    return shared.select("keyword", iso("window_start").alias("window_start"), iso("middle").alias("middle"), "value", "volume", "relative")


_FEATURES = (
    "s AS (SELECT doc_id, [" + strip_sql("x") + " for x in string_split(regexp_replace(lower(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))] AS p FROM documents), "
    "k AS (SELECT doc_id, [x for x in p if x <> ''] AS p FROM s), "
    "u AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS sentence, unnest(p) AS chunk FROM k), "
    "tok AS (SELECT doc_id, sentence, w FROM (SELECT doc_id, sentence, regexp_extract_all(chunk, '[\\pL\\pN_]+') AS w FROM u) WHERE len(w) > 0), "
    "freq AS (SELECT word, count(*) AS tf FROM (SELECT unnest(w) AS word FROM tok) GROUP BY 1), "
    "pl AS (SELECT word, count(*) AS in_sentences, quantile_cont(sentence, 0.5) AS med FROM (SELECT sentence, unnest(list_distinct(w)) AS word FROM tok) GROUP BY 1), "
    "pairs AS (SELECT unnest([{'a': w[i], 'b': w[i + 1]} for i in range(1, len(w))] || [{'a': w[i], 'b': w[i + 2]} for i in range(1, len(w) - 1)]) AS p FROM tok), "
    "near AS (SELECT p.a AS l, p.b AS r, count(*) AS n FROM pairs GROUP BY 1, 2), "
    "rt AS (SELECT l AS word, count(*) / sum(n) AS rs FROM near GROUP BY 1), lf AS (SELECT r AS word, count(*) / sum(n) AS ls FROM near GROUP BY 1), "
    f"cand AS (SELECT * FROM freq WHERE word NOT IN {list_sql(STOPWORDS)} AND NOT regexp_full_match(word, '\\p{{Nd}}+')), "
    "c AS (SELECT avg(tf) AS m, stddev_pop(tf) AS sd, max(tf) AS top FROM cand), ns AS (SELECT count(*) AS ns FROM tok), "
    "f AS (SELECT word, tf, 1 + (coalesce(ls, 0) + coalesce(rs, 0)) * tf / top AS rel, ln(ln(3.0 + med)) AS pos, in_sentences / ns AS spread, tf / (m + sd) AS norm "
    "FROM cand JOIN pl USING (word) LEFT JOIN lf USING (word) LEFT JOIN rt USING (word), c, ns), "
    "h AS (SELECT *, pos * rel / (norm / rel + spread / rel) AS h FROM f)"
)


@query(
    "keyword_rank",
    f"WITH {_FEATURES} SELECT word, tf, round(rel, 6) AS relatedness, round(pos, 6) AS position, round(spread, 6) AS spread, round(h / (tf * (h + 1)), 6) AS score FROM h",
)
def keyword_rank(t: Tables):
    f = L.word_features(t.texts, "text", STOPWORDS)
    return f.select("word", "tf", *[r6(F.col(c)).alias(c) for c in ("relatedness", "position", "spread", "score")])


@query("keyword_rank_distinct")
def keyword_rank_distinct(t: Tables):
    best = L.keyword_rank(L.word_features(t.texts, "text", STOPWORDS))
    return t.spark.createDataFrame([(i + 1, w, s) for i, (w, s) in enumerate(best)], "rank int, word string, score double")


@query("topic_keyword_lines")
def topic_keyword_lines(t: Tables):
    return lines_of_topic(t.appeals, "text", "ts", "topic_id", 5, STOPWORDS)
