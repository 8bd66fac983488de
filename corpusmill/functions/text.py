"""Scalar text work as native column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip() removes in Python.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0       "
    "         　"
)
# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
DIGITS_ONLY = r"^\p{Nd}+$"
# Fixed value: words of two or more letters or digits, over all scripts.
WORD_PATTERN = r"(?U)\b\w\w+\b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once per row.

    An expression named inside the lambda of an array function is otherwise worked out again for every
    element, because the optimizer puts it in the place of its name.
    """
    return F.get(F.transform(F.array(value), body), 0)


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of every kind; ``trim`` alone removes only spaces."""
    return F.trim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """Null, or nothing but white space."""
    return text.isNull() | (strip(text) == "")


def separate(text: Column, separators: Sequence[str]) -> Column:
    """Turn every separator that is not a space into a space."""
    for separator in separators:
        if separator != " ":
            text = F.replace(text, F.lit(separator), F.lit(" "))
    return text


def tokenize(text: Column, separators: Sequence[str] = ("_", " ")) -> Column:
    """Lower, strip, split on single spaces. Empty tokens are kept."""
    return F.split(separate(strip(F.lower(text)), separators), " ", -1)


def index_tokens(text: Column, separators: Sequence[str] = ("_", " ")) -> Column:
    """Tokens as the search index sees them: as ``tokenize``, each token stripped again."""
    return F.transform(tokenize(text, separators), strip)


# Nothing but digits once punctuation and outer white space are gone; fails at the first letter.
_EDGE = r"[!-/:-@\[-`{-~\s\x1c-\x1f\x85\p{Z}]*"
BARE_DIGITS = "^" + _EDGE + r"\p{Nd}[\p{Nd}!-/:-@\[-`{-~]*" + _EDGE + "$"


def bare_word(token: Column) -> Column:
    """The token without punctuation and outer white space, lowered."""
    return F.lower(strip(F.translate(token, PUNCTUATION, "")))


def _kept(token: Column, words: Sequence[str]) -> Column:
    keep = ~token.rlike(BARE_DIGITS)
    return keep & ~bare_word(token).isin(list(words)) if words else keep


def strip_stopwords(text: Column, words: Sequence[str]) -> Column:
    """Drop tokens that are stop words or digits once punctuation is taken off; keep the others as they are."""
    tokens = F.transform(F.split(text, " ", -1), strip)
    return F.array_join(F.filter(tokens, lambda token: _kept(token, words)), " ")


def clean_silo(text: Column, separators: Sequence[str], words: Sequence[str]) -> Column:
    """The cleaned text used for dedup, topics and search."""
    return strip_stopwords(separate(text, separators), words)


def clean_stopper(
    text: Column, separators: Sequence[str], words: Sequence[str], lower: bool = True, remove_digits: bool = True
) -> Column:
    """Split by each separator in turn, dropping stop words and, when asked, all-digit words."""
    current = strip(F.lower(text) if lower else text)
    for separator in separators:

        def keep(word: Column) -> Column:
            kept = ~word.isin(list(words)) if words else F.lit(True)
            return kept & ~word.rlike(DIGITS_ONLY) if remove_digits else kept

        parts = F.split(current, _quote(separator), -1)
        current = F.array_join(F.filter(parts, keep), " ")
    return current


def _quote(literal: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != " " and ord(ch) < 128 else ch for ch in literal)


def replace_map(items: Column, mapping: Mapping[str, str]) -> Column:
    """Ordered literal replacements on every element of an array."""

    def apply(item: Column) -> Column:
        for old, new in mapping.items():
            item = F.replace(item, F.lit(old), F.lit(str(new)))
        return item

    return F.transform(items, apply)


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+", -1), strip), lambda part: part != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring tokens, joined by a space."""
    if n == 1:
        return tokens

    def joined(words: Column) -> Column:
        last = F.size(words) - n + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda start: F.array_join(F.slice(words, start, n), " "))

    return let(tokens, joined)


def vocab_tokens(text: Column, words: Sequence[str] = (), ngram_range: tuple[int, int] = (1, 1)) -> Column:
    """Lowered words of two or more characters without stop words, as n-grams of the given sizes."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))
    if words:
        tokens = F.filter(tokens, lambda token: ~token.isin(list(words)))
    low, high = ngram_range
    if low == high:
        return ngrams(tokens, low)
    return let(tokens, lambda found: F.concat(*[ngrams(found, n) for n in range(low, high + 1)]))
