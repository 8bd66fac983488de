"""Keyword dictionaries matched against a table of texts.

A dictionary is a table (keyword, clean_name). A hit is a keyword with no word character directly
before or after it; among hits that overlap the leftmost wins, then the longest. Word characters are
ASCII letters, digits and the underscore unless extended, so letters of other scripts end a word.

Without ``case_sensitive``, characters are folded one by one, so places in a text stay the same.

Small dictionaries become one regular expression, evaluated inside the scan. Larger ones become an
automaton that is sent to the tasks, if its table stays below a bound that is checked first; beyond it
keywords are joined with the distinct words of chunks of texts. All three ways have the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.arrays import running_sums
from corpusmill.functions.text import let, ngrams, strip
from corpusmill.operators import automaton
from corpusmill.session import cut_lineage

# Dictionaries up to this many keywords are matched by one regular expression.
PATTERN_LIMIT = 400
# Dictionaries whose automaton has at most this many bytes are sent to the tasks; no more keywords than that many are read.
AUTOMATON_BYTES = 64 << 20
AUTOMATON_LIMIT = 1_000_000
# Beyond that texts meet the dictionary in chunks of 2 ** CHUNK_BITS.
CHUNK_BITS = 10
# Fixed value: the default word characters.
WORD_CHARACTERS = "A-Za-z0-9_"
# The characters outside ASCII that fold to an ASCII letter: they are word characters as well.
_FOLDED_TO_ASCII = "\u0130\u212a"


def folded(text: Column) -> Column:
    """Lower case, character by character: the dotted capital I, alone in having a lower case of two characters,
    becomes i, and both small sigmas are one."""
    return F.translate(F.lower(F.translate(text, "\u0130", "i")), "\u03c2", "\u03c3")


def _fold(text: str) -> str:
    """As ``folded``, for one string."""
    return "".join("i" if ch == "\u0130" else ch.lower() for ch in text).replace("\u03c2", "\u03c3")


@lru_cache(maxsize=1)
def _variants() -> dict[str, str]:
    """For each folded character that others fold to, all of them."""
    found: dict[str, str] = {}
    for ch in [*filter(str.isupper, map(chr, range(0x110000))), *filter(str.istitle, map(chr, range(0x110000))), "\u03c2"]:
        low = _fold(ch)
        if low != ch and ch not in found.get(low, ""):
            found[low] = found.get(low, low) + ch
    return found


def _class_of(extra: str, case_sensitive: bool = True) -> str:
    escaped = "".join("\\" + ch if not ch.isalnum() and ord(ch) < 128 else ch for ch in extra)
    return WORD_CHARACTERS + escaped + ("" if case_sensitive else _FOLDED_TO_ASCII)


def _escape(keyword: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != "_" and 32 < ord(ch) < 128 else ch for ch in keyword)


@dataclass(frozen=True)
class Dictionary:
    """A dictionary small enough for one pattern: keyword -> clean name, as it will be matched."""

    entries: Mapping[str, str]
    case_sensitive: bool = False
    extra_word_characters: str = ""
    pattern: str = field(init=False, default="")

    def __post_init__(self) -> None:
        ordered = sorted(self.entries, key=lambda k: (-len(k), k))
        word = _class_of(self.extra_word_characters)
        variants = {} if self.case_sensitive else _variants()
        written = lambda k: "".join(f"[{variants[ch]}]" if ch in variants else _escape(ch) for ch in k)
        body = "|".join(written(k) for k in ordered) or r"(?!)"
        # Apart, because a class of ASCII characters alone is a faster test.
        before, after = ("", "") if self.case_sensitive else (f"(?<![{_FOLDED_TO_ASCII}])", f"(?![{_FOLDED_TO_ASCII}])")
        object.__setattr__(self, "pattern", f"(?<![{word}]){before}(?:{body})(?![{word}]){after}")

    def clean_name(self, hit: Column) -> Column:
        pairs = [F.lit(part) for item in self.entries.items() for part in item]
        if not pairs:
            return F.lit(None).cast("string")
        return F.coalesce(F.element_at(F.create_map(*pairs), hit if self.case_sensitive else folded(hit)), hit)


def dictionary(pairs: Sequence[tuple[str, str | None]], case_sensitive: bool = False, extra_word_characters: str = "") -> Dictionary:
    """Later pairs replace earlier ones; an empty clean name means the keyword itself."""
    entries: dict[str, str] = {}
    for keyword, clean in pairs:
        if not keyword:
            continue
        key = keyword if case_sensitive else _fold(keyword)
        entries.pop(key, None)
        entries[key] = clean or keyword
    return Dictionary(entries, case_sensitive, extra_word_characters)


# --- dictionary tables ----------------------------------------------------------------------------


def _matched_entries(entries: DataFrame, case_sensitive: bool, winner: Callable[[Column], Column]) -> DataFrame:
    """One row for each keyword as it is matched; an empty clean name means the keyword itself."""
    key = F.col("keyword") if case_sensitive else folded(F.col("keyword"))
    name = F.when(F.col("clean_name").isNull() | (F.col("clean_name") == ""), F.col("keyword")).otherwise(F.col("clean_name"))
    usable = entries.where(F.col("keyword").isNotNull() & (F.col("keyword") != ""))
    return usable.groupBy(key.alias("keyword")).agg(winner(name).alias("clean_name"))


def dictionary_table(pairs: DataFrame, order: str, case_sensitive: bool = False) -> DataFrame:
    """(keyword, clean_name) rows: the later entry of a keyword wins."""
    return _matched_entries(pairs, case_sensitive, lambda name: F.max_by(name, order))


def pairs_from_map(df: DataFrame, name: str, keywords: str) -> DataFrame:
    """(clean name, list of keywords) rows as keyword pairs."""
    return df.select(F.explode(keywords).alias("keyword"), F.col(name).alias("clean_name"))


def keyword_remove(entries: DataFrame, removed: DataFrame, case_sensitive: bool = False) -> DataFrame:
    key = F.col("keyword") if case_sensitive else folded(F.col("keyword"))
    return entries.join(removed.select(key.alias("keyword")), "keyword", "left_anti")


def keyword_lookup(entries: DataFrame, wanted: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Is each wanted keyword present, and its clean name."""
    key = F.col("keyword") if case_sensitive else folded(F.col("keyword"))
    asked = wanted.select(F.col("keyword").alias("asked"), key.alias("keyword"))
    found = asked.join(entries, "keyword", "left")
    return found.select("asked", F.col("clean_name").isNotNull().alias("present"), "clean_name")


# --- matching by pattern --------------------------------------------------------------------------


def _pieces(text: Column, words: Dictionary) -> tuple[Column, Column]:
    """The hits of a text, and the text around them (one piece more than hits)."""
    return F.regexp_extract_all(text, F.lit(words.pattern), F.lit(0)), F.split(text, words.pattern, -1)


def _starts(pieces: Column, parts: Column) -> Column:
    """Where each part begins in a text made of pieces with the parts between them."""
    lengths = F.zip_with(pieces, parts, lambda piece, part: F.array(F.length(piece), F.coalesce(F.length(part), F.lit(0))))
    ends = running_sums(F.flatten(lengths))
    return F.slice(F.filter(ends, lambda _, i: i % 2 == 0), 1, F.size(parts))


def spans(text: Column, words: Dictionary) -> Column:
    """Array of (clean_name, lo, hi), in text order, ``hi`` exclusive, counted in characters."""
    hits, pieces = _pieces(text, words)
    return F.zip_with(
        hits,
        _starts(pieces, hits),
        lambda hit, lo: F.struct(words.clean_name(hit).alias("clean_name"), lo.alias("lo"), (lo + F.length(hit)).alias("hi")),
    )


def clean_names(text: Column, words: Dictionary) -> Column:
    """Clean names of all hits, in text order."""
    hits = F.regexp_extract_all(text, F.lit(words.pattern), F.lit(0))
    return F.transform(hits, words.clean_name)


def replaced(text: Column, words: Dictionary) -> Column:
    """The text with every hit replaced by its clean name."""
    hits, pieces = _pieces(text, words)
    names = F.transform(hits, words.clean_name)
    return F.array_join(F.zip_with(pieces, names, lambda piece, name: F.concat(piece, F.coalesce(name, F.lit("")))), "")


def highlight(df: DataFrame, raw: str, query: Sequence[str], prefixes: Sequence[str]) -> DataFrame:
    """A new line before each prefix, and the spans of prefixes and query words in the new text.

    ``highlight`` holds (lo, hi, color); ``color`` is the number of the prefix, null for a query word.
    Each prefix moves everything from itself on by the line break put before it.
    """
    colors = {"\n" + prefix: number + 1 for number, prefix in enumerate(dict.fromkeys(prefixes))}
    words = dictionary([(p, "\n" + p) for p in prefixes] + [(q, q) for q in query])
    color_of = (
        F.create_map(*[F.lit(part) for item in colors.items() for part in item])
        if colors
        else F.create_map().cast("map<string,int>")
    )
    text = strip(F.col(raw))
    hits, pieces = _pieces(text, words)
    names = F.transform(hits, words.clean_name)

    def mark(name: Column, place: Column) -> Column:
        color = F.try_element_at(color_of, name)
        # A prefix begins after its line break.
        lo = place + F.when(color.isNotNull(), 1).otherwise(0)
        return F.struct(lo.alias("lo"), (place + F.length(name)).alias("hi"), color.alias("color"))

    # Places in the new text count the line breaks before them.
    marks = F.zip_with(names, _starts(pieces, names), mark)
    return df.withColumn("highlight", marks).withColumn("marked_text", replaced(text, words))


# --- matching by join -----------------------------------------------------------------------------


def _rarest_run(keyword: Column, word: str, others: Column) -> Column:
    """What a keyword is looked up by: its longest run of word characters, or as many first characters as ``others``."""
    runs = F.regexp_extract_all(keyword, F.lit(f"{word}+"), F.lit(0))
    longest = F.array_max(F.transform(runs, lambda run: F.struct(F.length(run), run.alias("run"))))
    return F.when(F.size(runs) > 0, longest["run"]).otherwise(F.substr(keyword, F.lit(1), others))


def spans_by_join(
    df: DataFrame, id_col: str, text: str, entries: DataFrame, case_sensitive: bool = False, extra: str = "", part_bytes: int | None = None
) -> DataFrame:
    """(id, spans) of the texts with hits, for a dictionary of any size; a row for each text, also where ids repeat.

    Texts are numbered and cut into chunks of ``2 ** CHUNK_BITS``. The distinct runs of word characters of a chunk are
    joined with the dictionary, each keyword by its longest run; keywords without word characters are found by as
    many characters as the shortest of them has. So a frequent word is joined once for a chunk, and a task holds one
    chunk with the keywords that can be in it. Other word characters than ASCII ones only cut runs.
    """
    word = f"[{_class_of('', case_sensitive)}]"
    keyed = cut_lineage(_matched_entries(entries, case_sensitive, F.max))
    plain = keyed.withColumn("_word", F.col("keyword").rlike(word))
    least = plain.where("NOT _word").agg(F.min(F.length("keyword"))).first()[0]
    keyed = keyed.withColumn("_run", _rarest_run(F.col("keyword"), word, F.lit(least or 1)))
    row = F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS)
    # Written, so that both readers see the same chunks.
    texts = cut_lineage(df.where(F.length(text) > 0).select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), row.alias("_chunk")))
    fold = (lambda c: c) if case_sensitive else folded
    runs = F.regexp_extract_all("_text", F.lit(f"{word}+"), F.lit(0))
    if least is not None:
        starts = F.regexp_extract_all("_text", F.lit(f"(?s)(?=([^{word[1:-1]}]{{{least}}}))"), F.lit(1))
        runs = F.concat(runs, F.array_distinct(starts))
    held = texts.select("_chunk", F.explode(F.array_distinct(runs)).alias("_seen")).select("_chunk", fold(F.col("_seen")).alias("_run")).distinct()
    wanted = held.join(keyed, "_run").select(F.col("_chunk").alias("_of"), "keyword", "clean_name")
    kind = T.ArrayType(T.StructType([T.StructField("clean_name", T.StringType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType())]))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("spans", kind)])
    signs, fold_one = _word_signs(extra, case_sensitive), None if case_sensitive else _fold
    most = AUTOMATON_BYTES if part_bytes is None else part_bytes

    def matched(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = automaton.parts_of(right["keyword"].combine_chunks(), right["clean_name"].combine_chunks(), f"^[{WORD_CHARACTERS}]+$", most)
        ids, found = [], []
        for batch in left.to_batches(max_chunksize=256) if len(right) else []:
            spans = automaton.spans(batch.column("_text"), parts, signs, fold_one)
            some = pc.greater(pc.list_value_length(spans), 0)
            ids.append(batch.column("_id").filter(some))
            found.append(spans.filter(some))
        names = [id_col, "spans"]
        if not ids:
            return pa.Table.from_arrays([left["_id"].slice(0, 0), pa.array([], automaton.SPANS)], names=names)
        return pa.Table.from_arrays([pa.chunked_array(ids), pa.chunked_array(found)], names=names)

    return texts.groupBy("_chunk").cogroup(wanted.groupBy("_of")).applyInArrow(matched, schema)


def _automaton(entries: DataFrame, case_sensitive: bool, most_bytes: int) -> automaton.Automaton | None:
    """The automaton of a dictionary, or none if its table would be larger than ``most_bytes``."""
    keyed = _matched_entries(entries, case_sensitive, F.max)
    signs = keyed.select(F.explode(F.array_distinct(F.regexp_extract_all("keyword", F.lit("(?s)."), F.lit(0)))).alias("c")).agg(F.count_distinct("c")).scalar()
    size = keyed.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.length("keyword")), F.lit(0)).alias("chars")).withColumn("signs", signs).first()
    if size["rows"] > AUTOMATON_LIMIT or 4 * (1 + size["chars"]) * (1 + size["signs"]) > most_bytes:
        return None
    return automaton.build({r["keyword"]: r["clean_name"] for r in keyed.toLocalIterator()})


def _word_signs(extra: str, case_sensitive: bool) -> str:
    ascii_signs = "".join(chr(c) for c in range(128) if chr(c).isalnum() or chr(c) == "_")
    return ascii_signs + extra + ("" if case_sensitive else _FOLDED_TO_ASCII)


def _spans_of(
    df: DataFrame, id_col: str, text: str, entries: DataFrame, case_sensitive: bool, extra: str, pattern_limit: int, automaton_bytes: int
) -> DataFrame:
    """(id, hit_no, span) for every hit, by the way that fits the size of the dictionary."""
    head = _matched_entries(entries, case_sensitive, F.max).limit(pattern_limit + 1).collect()
    if len(head) <= pattern_limit:
        words = dictionary([(r[0], r[1]) for r in head], case_sensitive, extra)
        # Exploded as an expression: for a column the optimizer adds a filter that repeats its work.
        return df.select(id_col, F.posexplode(spans(F.col(text), words)).alias("hit_no", "_s"))
    made = _automaton(entries, case_sensitive, automaton_bytes)
    if made is not None:
        column = automaton.spans_column(df.sparkSession, made, F.col(text), _word_signs(extra, case_sensitive), None if case_sensitive else _fold)
        return df.select(id_col, column.alias("_all")).select(id_col, F.posexplode("_all").alias("hit_no", "_s"))
    found = spans_by_join(df, id_col, text, entries, case_sensitive, extra)
    return found.select(id_col, F.posexplode("spans").alias("hit_no", "_s"))


def keyword_spans(
    df: DataFrame,
    id_col: str,
    text: str,
    entries: DataFrame,
    case_sensitive: bool = False,
    extra: str = "",
    pattern_limit: int = PATTERN_LIMIT,
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """(id, hit_no, clean_name, lo, hi) for every hit; ``hit_no`` counts from 0 in text order.

    Of entries for one keyword the greatest clean name counts; ``dictionary_table`` keeps the later one.
    """
    hits = _spans_of(df, id_col, text, entries, case_sensitive, extra, pattern_limit, automaton_bytes)
    return hits.select(
        id_col, "hit_no", F.col("_s.clean_name").alias("clean_name"), F.col("_s.lo").alias("lo"), F.col("_s.hi").alias("hi")
    )


def keyword_extract(df: DataFrame, id_col: str, text: str, words: Dictionary | DataFrame, case_sensitive: bool = False) -> DataFrame:
    """(id, hit_no, clean_name) for every hit of a dictionary, or of a table (keyword, clean_name) of any length."""
    if isinstance(words, DataFrame):
        return keyword_spans(df, id_col, text, words, case_sensitive).select(id_col, "hit_no", "clean_name")
    return df.select(id_col, F.posexplode(clean_names(F.col(text), words)).alias("hit_no", "clean_name"))


def keyword_replace(df: DataFrame, id_col: str, text: str, entries: DataFrame | Dictionary, case_sensitive: bool = False) -> DataFrame:
    """The table with every hit in ``text`` replaced by its clean name."""
    if isinstance(entries, DataFrame):
        head = _matched_entries(entries, case_sensitive, F.max).limit(PATTERN_LIMIT + 1).collect()
        if len(head) > PATTERN_LIMIT:
            return replace_by_join(df, id_col, text, entries, case_sensitive)
        entries = dictionary([(r[0], r[1]) for r in head], case_sensitive)
    return df.withColumn(text, replaced(F.col(text), entries))


def replace_by_join(df: DataFrame, id_col: str, text: str, entries: DataFrame, case_sensitive: bool = False) -> DataFrame:
    found = spans_by_join(df, id_col, text, entries, case_sensitive).dropDuplicates([id_col])
    joined = df.join(found, id_col, "left")
    source = F.col(text)

    def step(state: Column, hit: Column) -> Column:
        before = F.substr(source, state["at"] + 1, hit["lo"] - state["at"])
        return F.struct(hit["hi"].alias("at"), F.concat(state["out"], before, hit["clean_name"]).alias("out"))

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substr(source, state["at"] + 1))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    stitched = F.aggregate("spans", start, step, finish)
    return joined.withColumn(text, F.when(F.col("spans").isNull(), source).otherwise(stitched)).select(*df.columns)


# --- fuzzy matching -------------------------------------------------------------------------------


def _segment(length: Column, number: Column, parts: int) -> tuple[Column, Column]:
    """Start (0-based) and size of one of ``parts`` nearly equal segments of a string."""
    base = F.floor(length / parts).cast("int")
    first_longer = F.lit(parts) - (length - base * parts)
    start = base * number + F.greatest(number - first_longer, F.lit(0))
    size = base + F.when(number >= first_longer, 1).otherwise(0)
    return start.cast("int"), size.cast("int")


def _word_cost(left: Column, right: Column) -> Column:
    """Edit distance summed over the words of two strings with equally many words."""
    costs = F.zip_with(F.split(left, " "), F.split(right, " "), lambda a, b: F.levenshtein(a, b))
    return F.aggregate(costs, F.lit(0), lambda total, cost: total + cost)


def similar_grams(grams: DataFrame, entries: DataFrame, max_cost: int) -> DataFrame:
    """(gram, keyword, clean_name, cost) for distinct grams within ``max_cost`` edits of a keyword.

    Cut a keyword into ``max_cost + 1`` segments: with at most ``max_cost`` edits one of them stays
    whole and moves by few places. So grams and keywords meet by equality on
    (words, keyword length, segment number, segment), and only these pairs are measured.
    """
    parts = max_cost + 1
    moves = range(-max_cost, max_cost + 1)
    words = lambda name: (F.length(name) - F.length(F.replace(F.col(name), F.lit(" "), F.lit("")))).alias("_words")
    numbers = F.explode(F.array(*[F.lit(n) for n in range(parts)])).alias("_no")
    keyed = entries.select("keyword", "clean_name", words("keyword"), F.length("keyword").alias("_len"), numbers)
    start, size = _segment(F.col("_len"), F.col("_no"), parts)
    keyed = keyed.withColumn("_seg", F.substr(F.col("keyword"), start + 1, size))
    # Left of the segment that stays whole there are at most as many edits as segments, and right of it
    # at most the others: that bounds how far it can have moved for each difference in length.
    places = [
        F.struct(F.lit(change).alias("change"), F.lit(n).alias("no"), F.lit(move).alias("move"))
        for change in moves
        for n in range(parts)
        for move in moves
        if abs(move) <= n and abs(move + change) <= max_cost - n
    ]
    probed = grams.select("gram", words("gram"), F.explode(F.array(*places)).alias("_p")).select(
        "gram", "_words", (F.length("gram") + F.col("_p.change")).alias("_len"), F.col("_p.no").alias("_no"), F.col("_p.move").alias("_move")
    )
    start, size = _segment(F.col("_len"), F.col("_no"), parts)
    begin = start + F.col("_move")
    fits = (F.col("_len") > 0) & (begin >= 0) & (begin + size <= F.length("gram"))
    probed = probed.where(fits).withColumn("_seg", F.substr(F.col("gram"), begin + 1, size))
    pairs = probed.join(keyed, ["_words", "_len", "_no", "_seg"]).select("gram", "keyword", "clean_name").distinct()
    return pairs.withColumn("cost", _word_cost(F.col("gram"), F.col("keyword"))).where(F.col("cost") <= max_cost)


def _word_grams(text: Column, max_words: int) -> Column:
    """Runs of up to ``max_words`` words with one space between them, lowered."""
    word = f"[{WORD_CHARACTERS}]+"
    stretches = F.regexp_extract_all(folded(text), F.lit(f"{word}(?: {word})*"), F.lit(0))
    if max_words == 1:
        return F.regexp_extract_all(folded(text), F.lit(word), F.lit(0))

    def cut(words: Column) -> Column:
        return F.concat(*[ngrams(words, n) for n in range(1, max_words + 1)])

    return F.flatten(F.transform(stretches, lambda stretch: let(F.split(stretch, " "), cut)))


def keyword_fuzzy(
    df: DataFrame,
    id_col: str,
    text: str,
    entries: DataFrame,
    max_cost: int = 1,
    max_words: int | None = None,
    pattern_limit: int = PATTERN_LIMIT,
) -> DataFrame:
    """(id, hit_no, clean_name, lo, hi): hits within ``max_cost`` edits of a keyword.

    Each word of the text is compared with the word of the keyword in its place. ``max_words`` is that of
    the longest keyword, looked up when not given. The distinct word runs of the corpus are compared once, however often they
    occur. Those that match become a dictionary, which is then matched exactly. Of several keywords
    near one run the nearest counts, then the first by name.
    """
    keyed = _matched_entries(entries, False, F.max)
    longest = keyed.agg(F.max(F.size(F.split("keyword", " ")))).first()[0] or 1
    max_words = max(longest, max_words or 1)
    grams = df.select(F.explode(F.array_distinct(_word_grams(F.col(text), max_words))).alias("gram")).distinct()
    near = similar_grams(grams, keyed, max_cost)
    best = near.groupBy(F.col("gram").alias("keyword")).agg(F.min_by("clean_name", F.struct("cost", "keyword")).alias("clean_name"))
    return keyword_spans(df, id_col, text, cut_lineage(best), pattern_limit=pattern_limit)
