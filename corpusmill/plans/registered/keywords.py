"""Keyword dictionaries over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators import keywords as K
from corpusmill.plans.registered.registry import Tables, query
from corpusmill.session import cut_lineage

PAIRS = [
    ("the", None),
    ("with the", "with-the"),
    ("thin", "thin one"),
    ("la", None),
    ("la le", "pair"),
    ("on", None),
    ("that", "those"),
    ("und", None),
]
# Longest first, as the pattern tries them.
_ALTERNATIVES = "with the|la le|that|thin|the|und|la|on"
_CLEAN_SQL = (
    "CASE lower(h) WHEN 'with the' THEN 'with-the' WHEN 'thin' THEN 'thin one' WHEN 'la le' THEN 'pair' "
    "WHEN 'that' THEN 'those' ELSE lower(h) END"
)
_HITS = f"h AS (SELECT doc_id, regexp_extract_all(text, '(?i)\\b(?:{_ALTERNATIVES})\\b') AS hits FROM documents)"


def _entries(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(k, c or k) for k, c in PAIRS], "keyword string, clean_name string")


def _derived(t: Tables) -> DataFrame:
    """Keyword pairs taken from the data: document sources and languages."""
    d = t.documents
    return d.select(F.upper("source").alias("keyword"), F.col("lang").alias("clean_name"), F.col("doc_id").alias("ord"))


_DERIVED_SQL = "p AS (SELECT upper(source) AS keyword, lang AS clean_name, doc_id AS ord FROM documents), e AS (SELECT lower(keyword) AS keyword, arg_max(clean_name, ord) AS clean_name FROM p GROUP BY 1)"


@query("keyword_dictionary", f"WITH {_DERIVED_SQL} SELECT keyword, clean_name FROM e")
def keyword_dictionary(t: Tables):
    return K.dictionary_table(_derived(t), "ord")


@query(
    "keyword_dictionary_from_lists",
    "WITH m AS (SELECT DISTINCT lang, source FROM documents) SELECT lower(source) AS keyword, max(lang) AS clean_name FROM m GROUP BY 1",
)
def keyword_dictionary_from_lists(t: Tables):
    lists = t.documents.groupBy("lang").agg(F.collect_set("source").alias("sources"))
    pairs = K.pairs_from_map(lists, "lang", "sources")
    return K.dictionary_table(pairs.withColumn("ord", F.col("clean_name")), "ord")


@query(
    "keyword_remove",
    f"WITH {_DERIVED_SQL} SELECT keyword, clean_name FROM e WHERE keyword NOT IN (SELECT source FROM documents WHERE lang = 'fr' GROUP BY source HAVING count(*) > 5)",
)
def keyword_remove(t: Tables):
    frequent = t.documents.where("lang = 'fr'").groupBy("source").count().where("count > 5")
    return K.keyword_remove(K.dictionary_table(_derived(t), "ord"), frequent.select(F.upper("source").alias("keyword")))


@query(
    "keyword_lookup",
    f"WITH {_DERIVED_SQL}, a AS (SELECT DISTINCT event_type AS asked FROM events UNION SELECT DISTINCT source FROM documents) "
    "SELECT asked, clean_name IS NOT NULL AS present, clean_name FROM a LEFT JOIN e ON e.keyword = lower(asked)",
)
def keyword_lookup(t: Tables):
    asked = t.events.select(F.col("event_type").alias("keyword")).unionByName(t.documents.select(F.col("source").alias("keyword"))).distinct()
    return K.keyword_lookup(K.dictionary_table(_derived(t), "ord"), asked)


@query(
    "keyword_extract",
    f"WITH {_HITS}, u AS (SELECT doc_id, CAST(generate_subscripts(hits, 1) - 1 AS INTEGER) AS hit_no, unnest(hits) AS h FROM h) "
    f"SELECT doc_id, hit_no, {_CLEAN_SQL} AS clean_name FROM u",
)
def keyword_extract(t: Tables):
    return K.keyword_extract(t.texts, "doc_id", "text", K.dictionary(PAIRS))


@query(
    "keyword_extract_large",
    "WITH w AS (SELECT doc_id, lower(unnest(x)) AS word, generate_subscripts(x, 1) AS place FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9_]+') AS x FROM documents)), "
    "k AS (SELECT word FROM w WHERE length(word) >= 4 GROUP BY word) "
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INTEGER) AS hit_no, upper(word) AS clean_name FROM w JOIN k USING (word)",
)
def keyword_extract_large(t: Tables):
    """Every word of four letters or more in any document is a keyword: tens of thousands."""
    words = t.texts.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("keyword"))
    entries = words.where(F.length("keyword") >= 4).distinct().withColumn("clean_name", F.upper("keyword"))
    return K.keyword_extract(t.texts, "doc_id", "text", cut_lineage(entries))


@query(
    "keyword_boundaries",
    # A separator is doubled first, because the SQL dialect has no look-behind.
    "WITH d AS (SELECT page_id, regexp_replace(html, '([^A-Za-z0-9_/<])', '\\1\\1', 'g') AS x FROM pages), "
    "h AS (SELECT page_id, regexp_extract_all(' ' || x || ' ', '(?i)[^A-Za-z0-9_/<](href|nav|li|p)[^A-Za-z0-9_/<]', 1) AS names FROM d) "
    "SELECT page_id, CAST(len(names) AS INTEGER) AS hits, lower(array_to_string(names, ',')) AS names FROM h",
)
def keyword_boundaries(t: Tables):
    words = K.dictionary([("nav", None), ("href", None), ("li", None), ("p", None)], extra_word_characters="/<")
    names = K.clean_names(F.col("html"), words)
    return t.read("pages").select("page_id", F.size(names).alias("hits"), F.array_join(names, ",").alias("names"))


@query(
    "keyword_spans",
    # A hit begins after the pieces up to it and the hits before it.
    f"WITH {_HITS}, s AS (SELECT doc_id, hits, string_split_regex(text, '(?i)\\b(?:{_ALTERNATIVES})\\b') AS pieces FROM documents JOIN h USING (doc_id)), "
    "u AS (SELECT doc_id, CAST(generate_subscripts(hits, 1) - 1 AS INTEGER) AS hit_no, unnest(hits) AS h, unnest(pieces[1:len(hits)]) AS p FROM s), "
    "e AS (SELECT *, sum(length(p) + length(h)) OVER (PARTITION BY doc_id ORDER BY hit_no) AS upto FROM u) "
    f"SELECT doc_id, hit_no, {_CLEAN_SQL} AS clean_name, CAST(upto - length(h) AS INTEGER) AS lo, CAST(upto AS INTEGER) AS hi FROM e",
)
def keyword_spans(t: Tables):
    found = K.keyword_spans(t.texts, "doc_id", "text", _entries(t))
    return found.select("doc_id", "hit_no", "clean_name", "lo", "hi")


@query(
    "keyword_spans_cut",
    f"WITH {_HITS}, u AS (SELECT doc_id, CAST(generate_subscripts(hits, 1) - 1 AS INTEGER) AS hit_no, unnest(hits) AS h FROM h) "
    "SELECT doc_id, hit_no, h AS cut FROM u",
)
def keyword_spans_cut(t: Tables):
    """The text between the ends of every span is the hit itself."""
    found = K.keyword_spans(t.texts, "doc_id", "text", _entries(t))
    cut = F.substr(F.col("text"), F.col("lo") + 1, F.col("hi") - F.col("lo"))
    return found.join(t.texts, "doc_id").select("doc_id", "hit_no", cut.alias("cut"))


@query(
    "keyword_spans_large",
    "WITH k AS (SELECT DISTINCT lower(x) AS keyword FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS x FROM benchmark) WHERE length(x) >= 3), "
    "w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS keyword FROM documents) "
    "SELECT doc_id, keyword AS clean_name, count(*) AS hits FROM w JOIN k USING (keyword) GROUP BY 1, 2",
)
def keyword_spans_large(t: Tables):
    """All words of the benchmark as keywords: more than one pattern takes."""
    words = t.read("benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("keyword")).where(F.length("keyword") >= 3)
    entries = words.select(F.lower("keyword").alias("keyword")).distinct().withColumn("clean_name", F.col("keyword"))
    found = K.keyword_spans(t.texts, "doc_id", "text", entries)
    return found.groupBy("doc_id", "clean_name").agg(F.count(F.lit(1)).alias("hits"))


@query(
    "keyword_replace",
    "SELECT doc_id, md5(regexp_replace(text, '(?i)\\b(?:with the|thin|the|on|la)\\b', 'word', 'g')) AS digest FROM documents",
)
def keyword_replace(t: Tables):
    words = K.dictionary([(k, "word") for k in ("with the", "thin", "the", "on", "la")])
    return K.keyword_replace(t.texts, "doc_id", "text", words).select("doc_id", F.md5("text").alias("digest"))


_FUZZY = ["thin", "with", "ention", "oredat", "eauenaux", "shwould"]


@query(
    "keyword_fuzzy",
    "WITH k AS (SELECT unnest([" + ", ".join(f"'{w}'" for w in _FUZZY) + "]) AS keyword), "
    "w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]+'))) AS word FROM documents), "
    "v AS (SELECT DISTINCT word FROM w), "
    "m AS (SELECT word, keyword, levenshtein(word, keyword) AS cost FROM v, k WHERE levenshtein(word, keyword) <= 1), "
    "b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY word ORDER BY cost, keyword) = 1) "
    "SELECT doc_id, keyword AS clean_name, count(*) AS hits FROM w JOIN b USING (word) GROUP BY 1, 2",
)
def keyword_fuzzy(t: Tables):
    entries = t.spark.createDataFrame([(w, w) for w in _FUZZY], "keyword string, clean_name string")
    found = K.keyword_fuzzy(t.texts, "doc_id", "text", entries, max_cost=1, max_words=1)
    return found.groupBy("doc_id", "clean_name").agg(F.count(F.lit(1)).alias("hits"))


@query("highlight_hits")
def highlight_hits(t: Tables):
    turns = t.read("conversations").select("conv_id", "turn", F.concat("role", F.lit(": "), "text").alias("raw"))
    marked = K.highlight(turns, "raw", ["la", "the", "of"], ["user:", "assistant:"])
    return marked.select("conv_id", "turn", "highlight", "marked_text")
