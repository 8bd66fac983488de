"""Scalar text work and the row-set steps before the analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.functions.dates import date_text, parse_date, unread_share, with_free_dates
from corpusmill.operators import appeals as A
from corpusmill.operators.text_tables import remove_listed_words, sentence_chunks
from corpusmill.plans.registered.registry import (
    APPEALS_SQL,
    STOPWORDS,
    Tables,
    iso,
    iso_sql,
    list_sql,
    query,
    r6,
    strip_sql,
    tokens_sql,
    vocab_sql,
)

_PUNCT = r"[!-/:-@\[-`{-~]"


def kept_sql(expression: str) -> str:
    """SQL of the text without stop words and digits."""
    parts = f"[{strip_sql('x')} for x in string_split({expression}, ' ')]"
    bare = strip_sql(f"regexp_replace(x, '{_PUNCT}', '', 'g')")
    keep = f"lower({bare}) NOT IN {list_sql(STOPWORDS)} AND NOT regexp_full_match({bare}, '\\p{{Nd}}+')"
    return f"array_to_string([x for x in {parts} if {keep}], ' ')"


@query(
    "tokenize",
    f"WITH t AS (SELECT doc_id, {tokens_sql('text')} AS tk FROM documents) "
    "SELECT doc_id, len(tk) AS n, len(list_distinct(tk)) AS distinct_n, md5(array_to_string(tk, '|')) AS digest FROM t",
)
def tokenize(t: Tables):
    tokens = t.texts.select("doc_id", X.tokenize(F.col("text")).alias("tk"))
    return tokens.select(
        "doc_id",
        F.size("tk").cast("bigint").alias("n"),
        F.size(F.array_distinct("tk")).cast("bigint").alias("distinct_n"),
        F.md5(F.array_join("tk", "|")).alias("digest"),
    )


@query("strip_stopwords", f"SELECT doc_id, {kept_sql('text')} AS text FROM documents")
def strip_stopwords(t: Tables):
    return t.texts.select("doc_id", X.strip_stopwords(F.col("text"), STOPWORDS).alias("text"))


@query(
    "clean_stopper",
    "WITH a AS (SELECT doc_id, array_to_string([x for x in string_split(lower("
    + strip_sql("text")
    + f"), ' ') if x NOT IN {list_sql(STOPWORDS)} AND NOT regexp_full_match(x, '\\p{{Nd}}+')], ' ') AS s FROM documents) "
    f"SELECT doc_id, array_to_string([x for x in string_split(s, '.') if x NOT IN {list_sql(STOPWORDS)} "
    "AND NOT regexp_full_match(x, '\\p{Nd}+')], ' ') AS text FROM a",
)
def clean_stopper(t: Tables):
    return t.texts.select("doc_id", X.clean_stopper(F.col("text"), [" ", "."], STOPWORDS).alias("text"))


_SEPARATED = "replace(replace(text, ':', ' '), ',', ' ')"


@query("clean_silo", f"SELECT doc_id, {kept_sql(_SEPARATED)} AS silo FROM documents")
def clean_silo(t: Tables):
    return t.texts.select("doc_id", X.clean_silo(F.col("text"), [":", ",", " "], STOPWORDS).alias("silo"))


@query(
    "replace_map",
    "SELECT doc_id, md5(array_to_string([replace(replace(x, 'th', 'z'), 'ze', 'the') for x in string_split(text, ' ')], ' ')) AS digest FROM documents",
)
def replace_map(t: Tables):
    items = X.replace_map(F.split("text", " ", -1), {"th": "z", "ze": "the"})
    return t.texts.select("doc_id", F.md5(F.array_join(items, " ")).alias("digest"))


@query(
    "parse_dates",
    "SELECT event_id, strftime(date_trunc('second', ts), '%d/%m/%Y %H:%M:%S') AS full_time, "
    "strftime(ts, '%d/%m/%Y 00:00:00') AS us_day, strftime(ts, '%d/%m/%Y 00:00:00') AS iso_day, "
    "strftime(ts, '%d/%m/%Y 00:00:00') AS dotted, CAST(NULL AS VARCHAR) AS unread FROM events",
)
def parse_dates(t: Tables):
    def shown(pattern: str):
        return date_text(parse_date(F.date_format("ts", pattern)))

    return t.events.select(
        "event_id",
        shown("yyyy-MM-dd HH:mm:ss").alias("full_time"),
        shown("MM/dd/yyyy").alias("us_day"),
        shown("yyyy-MM-dd").alias("iso_day"),
        shown("dd.MM.yyyy").alias("dotted"),
        date_text(parse_date(F.col("event_type"))).alias("unread"),
    )


_GERMAN = "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split()
# Spellings by event_id modulo their number; the last one has no date.
_SPELLINGS = (
    "d/M/yyyy HH:mm", "MMMM d, yyyy h:mm a", "EEE, d MMM yyyy HH:mm:ss '+0200'", "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "dd.MM.yy", "yyyy MMMM d", "yyyyMMdd", "'no date'",
)


@query(
    "parse_dates_free",
    "WITH r AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN date_trunc('minute', ts) WHEN 2 THEN date_trunc('second', ts) "
    "WHEN 3 THEN date_trunc('second', ts) WHEN 7 THEN NULL WHEN 8 THEN date_trunc('hour', ts) ELSE date_trunc('day', ts) END AS t FROM events) "
    "SELECT event_id, strftime(t, '%d/%m/%Y %H:%M:%S') AS read, round((SELECT count(*) FILTER (event_id % 9 = 7) / count(*) FROM events), 6) AS unread_share FROM r",
)
def parse_dates_free(t: Tables):
    """Spellings made from the times of the events; of the first, day and month are told apart by the whole column."""
    german = F.element_at(F.array(*[F.lit(m) for m in _GERMAN]), F.month("ts"))
    spelling = F.concat_ws(" ", F.date_format("ts", "d."), german, F.date_format("ts", "yyyy 'um' HH 'h'"))
    spelling = F.concat(F.substring_index(spelling, " h", 1), F.lit(":00 Uhr"))
    for number, pattern in enumerate(_SPELLINGS):
        spelling = F.when(F.col("event_id") % 9 == number, F.date_format("ts", pattern)).otherwise(spelling)
    dated = with_free_dates(t.events.select("event_id", spelling.alias("text")), "text", "date")
    share = unread_share(dated, "text", "date").select("share").scalar()
    return dated.select("event_id", date_text(F.col("date")).alias("read"), F.round(share, 6).alias("unread_share"))


@query(
    "vocab_tokens",
    f"WITH t AS (SELECT doc_id, {vocab_sql('text', STOPWORDS)} AS tk FROM documents) "
    "SELECT doc_id, len(tk) AS words, greatest(len(tk) - 1, 0) AS pairs, md5(array_to_string(tk, ' ')) AS digest, "
    "md5(array_to_string([tk[i] || '_' || tk[i + 1] for i in range(1, len(tk))], ' ')) AS pair_digest FROM t",
)
def vocab_tokens(t: Tables):
    text = F.col("text")
    one, two = X.vocab_tokens(text, STOPWORDS), X.vocab_tokens(text, STOPWORDS, (2, 2))
    d = t.texts.select("doc_id", one.alias("one"), two.alias("two"))
    pairs = F.transform("two", lambda p: F.replace(p, F.lit(" "), F.lit("_")))
    return d.select(
        "doc_id",
        F.size("one").cast("bigint").alias("words"),
        F.size("two").cast("bigint").alias("pairs"),
        F.md5(F.array_join("one", " ")).alias("digest"),
        F.md5(F.array_join(pairs, " ")).alias("pair_digest"),
    )


@query(
    "sentence_chunks",
    "WITH s AS (SELECT doc_id, [" + strip_sql("x") + " for x in string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))] AS p FROM documents), "
    "k AS (SELECT doc_id, [x for x in p if x <> ''] AS p FROM s) "
    "SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS chunk_no, unnest(p) AS chunk FROM k",
)
def sentence_chunks_query(t: Tables):
    return sentence_chunks(t.texts, "doc_id", "text")


@query(
    "paragraphs",
    "WITH p AS (SELECT doc_id, lang, [x for x in string_split(" + strip_sql("text") + ", ' ') if " + strip_sql("x") + " <> ''] AS tk FROM documents), "
    "u AS (SELECT doc_id, lang, generate_subscripts(tk, 1) AS pos, unnest(tk) AS content FROM p) "
    "SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS paragraph_id, doc_id, content, lang FROM u",
)
def paragraphs(t: Tables):
    return A.paragraphs(t.texts, "doc_id", "text", ["lang"])


# --- row sets -------------------------------------------------------------------------------------


@query(
    "dedup_keep_last",
    f"WITH s AS (SELECT doc_id, lang, {kept_sql('text')} AS silo FROM documents) "
    "SELECT doc_id, lang, md5(silo) AS digest FROM s QUALIFY row_number() OVER (PARTITION BY silo ORDER BY doc_id DESC) = 1",
)
def dedup_keep_last(t: Tables):
    cleaned = t.texts.select("doc_id", "lang", X.clean_silo(F.col("text"), [":"], STOPWORDS).alias("silo"))
    return A.dedup_keep_last(cleaned, "silo", "doc_id").select("doc_id", "lang", F.md5("silo").alias("digest"))


@query("clip_sample", "SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id LIMIT 300")
def clip_sample(t: Tables):
    return A.clip_sample(t.documents, "doc_id", 300).select("doc_id", "lang")


@query(
    "sort_by_date",
    f"WITH {APPEALS_SQL} SELECT doc_id, {iso_sql('ts')} AS ts FROM appeals ORDER BY appeals.ts, doc_id",
)
def sort_by_date(t: Tables):
    return A.sort_by_date(t.appeals, "ts", "doc_id").select("doc_id", iso("ts").alias("ts"))


@query("sort_by_score", "SELECT event_id, value FROM events ORDER BY value DESC, event_id")
def sort_by_score(t: Tables):
    return A.sort_by_score(t.events, "value", "event_id").select("event_id", "value")


@query(
    "docs_per_topic",
    f"WITH {APPEALS_SQL}, p AS (SELECT topic_id, text, ts, doc_id, "
    "row_number() OVER (PARTITION BY topic_id ORDER BY ts, doc_id) - 1 AS pos FROM appeals) "
    "SELECT topic_id, CAST(pos // 20 AS BIGINT) AS part, md5(string_agg(text, ' ' ORDER BY pos)) AS digest FROM p GROUP BY 1, 2",
)
def docs_per_topic(t: Tables):
    parts = A.docs_per_topic(t.appeals, "topic_id", "text", ["ts", "doc_id"], part_size=20)
    return parts.select("topic_id", "part", F.md5("doc").alias("digest"))


@query(
    "word_frequencies",
    f"WITH w AS (SELECT unnest({vocab_sql('text', STOPWORDS)}) AS word FROM documents), "
    "c AS (SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 100) "
    "SELECT word, n, round(n / max(n) OVER (), 6) AS relative FROM c",
)
def word_frequencies(t: Tables):
    return A.word_frequencies(t.texts, "text", STOPWORDS).withColumn("relative", r6(F.col("relative")))


@query(
    "remove_listed_words",
    "WITH w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\\pL\\pN_]{2,}'))) AS word FROM benchmark), "
    "t AS (SELECT doc_id, pos, " + strip_sql("tok") + " AS tok FROM (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS tok "
    "FROM (SELECT doc_id, string_split(text, ' ') AS p FROM documents))), "
    "b AS (SELECT *, " + strip_sql(f"regexp_replace(tok, '{_PUNCT}', '', 'g')") + " AS bare FROM t), "
    "k AS (SELECT * FROM b WHERE NOT regexp_full_match(bare, '\\p{Nd}+') AND lower(bare) NOT IN (SELECT word FROM w)), "
    "g AS (SELECT doc_id, string_agg(tok, ' ' ORDER BY pos) AS s FROM k GROUP BY doc_id) "
    "SELECT doc_id, md5(coalesce(s, '')) AS digest FROM documents LEFT JOIN g USING (doc_id)",
)
def remove_listed(t: Tables):
    words = t.read("benchmark").select(F.explode(X.vocab_tokens(F.col("text"))).alias("word"))
    return remove_listed_words(t.texts, "doc_id", "text", words).select("doc_id", F.md5("text").alias("digest"))
