"""Dictionaries of many thousands of keywords, matched in one pass over each text by an automaton in flat arrays.

The automaton is Aho and Corasick's: a state is a beginning of a keyword, and every state knows for every character
class the state of the longest beginning that ends there. Texts are walked side by side, one numpy step for a
character of all of them; long texts are cut into stretches that overlap by the longest keyword, so a step always
has many texts, and the work is in proportion to the characters, whatever the keywords.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

STRETCH = 512
#: Characters of text walked at a time.
_SLICE = 1 << 20
_SPAN = pa.struct([("clean_name", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())])
SPANS = pa.list_(_SPAN)
_POINTS = 0x110000


@dataclass(frozen=True)
class Automaton:
    """``step`` has a row for each state and a column for each character class; class 0 is any other character."""

    classes: np.ndarray
    step: np.ndarray
    #: For each state the keyword that it is, or -1, and the next shorter state that is a keyword, or 0.
    keyword: np.ndarray
    shorter: np.ndarray
    sizes: np.ndarray
    names: tuple[str, ...]

    @property
    def bytes(self) -> int:
        return self.step.nbytes + self.classes.nbytes + self.keyword.nbytes + self.shorter.nbytes + sum(map(len, self.names))

    def hits(self, codes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and number of every keyword in a sequence of characters."""
        end, which = walk(codes, self)
        return end - self.sizes[which], end, which

    def named(self, numbers: np.ndarray) -> pa.Array:
        return pa.array([self.names[i] for i in numbers.tolist()], pa.string())


@dataclass(frozen=True)
class Words:
    """Keywords of nothing but word signs: each is a whole run of word signs of the text, so runs are looked up."""

    words: pa.Array
    names: pa.Array

    def hits(self, codes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``Automaton.hits``; the first and the last character are no word signs."""
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        if not len(edges):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        width = 1 + (codes >= 0x80).astype(np.int32) + (codes >= 0x800) + (codes >= 0x10000)
        places = np.concatenate([[0], np.cumsum(width)])[edges].astype(np.int32)
        # Runs and the gaps between them in turn.
        pieces = pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(places), pa.py_buffer(text))
        found = pc.index_in(pieces, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False)[::2]
        known = np.flatnonzero(found >= 0)
        return edges[::2][known], edges[1::2][known], found[known].astype(np.int64)

    def named(self, numbers: np.ndarray) -> pa.Array:
        return self.names.take(pa.array(numbers))


def table_bytes(keywords: list[str]) -> int:
    """A bound on the bytes of the table of an automaton, before it is built."""
    return 4 * (1 + sum(map(len, keywords))) * (1 + len(set().union(*keywords))) if keywords else 0


def build(entries: Mapping[str, str]) -> Automaton:
    """From keyword -> clean name. Keywords are matched as they are; fold them and the texts alike before."""
    alphabet = sorted(set().union(*entries)) if entries else []
    classes = np.zeros(_POINTS, np.int16 if len(alphabet) < 1 << 15 else np.int32)
    classes[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
    children: list[dict[int, int]] = [{}]
    keyword, parents = [-1], [(0, 0)]
    words = sorted(entries)
    for number, word in enumerate(words):
        state = 0
        for c in word:
            kind = int(classes[ord(c)])
            if kind not in children[state]:
                children[state][kind] = len(children)
                children.append({})
                keyword.append(-1)
                parents.append((state, kind))
            state = children[state][kind]
        keyword[state] = number
    n = len(children)
    step = np.zeros((n, len(alphabet) + 1), np.int32)
    fall, shorter, is_word = np.zeros(n, np.int64), np.zeros(n, np.int32), np.array(keyword) >= 0
    level = list(children[0].values())
    for kind, child in children[0].items():
        step[0, kind] = child
    while level:  # a level of the tree at a time: all shorter states are complete
        for state in level:
            back = int(fall[state])
            step[state] = step[back]
            shorter[state] = back if is_word[back] else shorter[back]
            for kind, child in children[state].items():
                fall[child] = step[back, kind]
                step[state, kind] = child
        level = [c for s in level for c in children[s].values()]
    return Automaton(classes, step, np.array(keyword, np.int32), shorter, np.array([len(w) for w in words], np.int64), tuple(entries[w] for w in words))


@lru_cache(maxsize=2)
def _flags(signs: str) -> np.ndarray:
    found = np.zeros(_POINTS, bool)
    found[[ord(c) for c in signs]] = True
    return found


@lru_cache(maxsize=1)
def _folds(fold) -> np.ndarray:
    """What each character folds to; surrogates stand for themselves."""
    return np.fromiter((ord(fold(chr(i))) if not 0xD800 <= i < 0xE000 else i for i in range(_POINTS)), np.uint32, _POINTS)


def walk(codes: np.ndarray, automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Every place at which a keyword ends (exclusive), and its number, of a sequence of characters."""
    longest = int(automaton.sizes.max(initial=1))
    kinds = automaton.classes[codes]
    lanes = np.arange(0, max(len(codes), 1), STRETCH, dtype=np.int64)
    warm = longest - 1
    padded = np.concatenate([np.zeros(warm, kinds.dtype), kinds, np.zeros(STRETCH, kinds.dtype)])
    state = np.zeros(len(lanes), np.int32)
    flat, width = automaton.step.ravel(), automaton.step.shape[1]
    ends, states = [], []
    ending = (automaton.keyword >= 0) | (automaton.shorter > 0)
    for i in range(warm + STRETCH):  # the place i of every stretch at once
        state = flat[state.astype(np.int64) * width + padded[lanes + i]]
        if i >= warm:
            hit = np.flatnonzero(ending[state])
            if len(hit):
                ends.append(lanes[hit] + i - warm + 1)
                states.append(state[hit])
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end, state = np.concatenate(ends), np.concatenate(states)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(end):  # the keyword itself, then the shorter ones that end there
        own = automaton.keyword[state]
        real = own >= 0
        found.append((end[real], own[real]))
        state = automaton.shorter[state]
        end, state = end[state > 0], state[state > 0]
    return np.concatenate([e for e, _ in found]), np.concatenate([k for _, k in found]).astype(np.int64)


def leftmost_longest(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the hits, in the order of their starts, longest first, remain when those that overlap one are dropped."""
    if not len(start):
        return np.zeros(0, bool)
    apart = np.concatenate([[True], start[1:] >= np.maximum.accumulate(end)[:-1]])
    keep = apart.copy()
    done = 0
    for i in np.flatnonzero(~apart | np.concatenate([~apart[1:], [False]])).tolist():
        if apart[i] or start[i] >= done:
            keep[i], done = True, end[i]
    return keep


def find(
    texts: list[str | None], parts: Iterable[Automaton | Words], word_signs: str, fold: Callable[[str], str] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The hits of all parts of a dictionary: number of the text, start, end, clean name, in text order. No word sign
    stands directly before or after a hit; of hits that overlap the leftmost, then the longest remains."""
    sizes = np.array([len(t or "") for t in texts], np.int64)
    begins = np.cumsum(sizes + 1) - sizes
    # A character that is in no keyword stands in front of each text and at the end.
    joined = np.frombuffer(("\0" + "\0".join(t or "" for t in texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _flags(word_signs)[joined]
    word[begins - 1] = False
    codes = joined if fold is None else _folds(fold)[joined]
    found, names = [(np.zeros(0, np.int64),) * 4], [pa.array([], pa.string())]
    for part in parts:
        start, end, which = part.hits(codes, word)
        free = ~word[start - 1] & ~word[np.minimum(end, len(word) - 1)]
        start, end, which = start[free], end[free], which[free]
        text = np.searchsorted(begins, start, "right") - 1
        inside = (start >= begins[text]) & (end <= begins[text] + sizes[text]) if len(text) else np.zeros(0, bool)
        numbers, used = np.unique(which[inside], return_inverse=True)
        found.append((start[inside], end[inside], text[inside], used + sum(map(len, names))))
        names.append(part.named(numbers))
    start, end, text, which = (np.concatenate(column) for column in zip(*found))
    order = np.lexsort((-end, start))
    order = order[leftmost_longest(start[order], end[order])]
    text = text[order]
    return text, start[order] - begins[text], end[order] - begins[text], pa.concat_arrays(names).take(pa.array(which[order]))


def spans(
    texts: pa.Array, parts: Callable[[], Iterable[Automaton | Words]], word_signs: str, fold: Callable[[str], str] | None = None
) -> pa.ListArray:
    """The hits of each text as a list of (clean_name, lo, hi). Texts are walked a slice at a time and the hits of a
    slice become columns at once, so a batch of many hits holds no object for each."""
    counts, los, his, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [pa.array([], pa.string())]

    def close(held: list[str | None]) -> None:
        text, lo, hi, name = find(held, parts(), word_signs, fold)
        counts.append(np.bincount(text, minlength=len(held)))
        los.append(lo.astype(np.int32))
        his.append(hi.astype(np.int32))
        names.append(name)

    held: list[str | None] = []
    size = 0
    for value in texts:
        held.append(value.as_py())
        size += len(held[-1] or "")
        if size >= _SLICE:
            close(held)
            held, size = [], 0
    if held:
        close(held)
    columns = [pa.concat_arrays(names), pa.array(np.concatenate(los)), pa.array(np.concatenate(his))]
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_SPAN)))


def spans_column(spark: SparkSession, automaton: Automaton, text: Column, word_signs: str, fold=None) -> Column:
    """Array of (clean_name, lo, hi) of each text, in text order, ``hi`` exclusive; null and empty texts have none."""
    shared = spark.sparkContext.broadcast(automaton)

    @F.arrow_udf("array<struct<clean_name: string, lo: int, hi: int>>")
    def hits(texts: pa.Array) -> pa.Array:
        return spans(texts, lambda: [shared.value], word_signs, fold)

    return hits(text)


def parts_of(keywords: pa.Array, names: pa.Array, word_signs_only: str, most_bytes: int) -> Callable[[], Iterable[Automaton | Words]]:
    """The parts of a dictionary: keywords that match ``word_signs_only`` are looked up, the others become automata of
    at most ``most_bytes`` each; if those are several, they are built again for each slice of texts and not held."""
    plain = pc.match_substring_regex(keywords, word_signs_only)
    words = Words(keywords.filter(plain), names.filter(plain))
    rest = list(zip(keywords.filter(pc.invert(plain)).to_pylist(), names.filter(pc.invert(plain)).to_pylist()))
    most_chars = most_bytes // (4 * (1 + len(set().union(*(k for k, _ in rest))))) if rest else 0
    groups: list[dict[str, str]] = []
    chars = 0
    for keyword, name in rest:
        if not groups or chars + len(keyword) > most_chars:
            groups.append({})
            chars = 0
        groups[-1][keyword] = name
        chars += len(keyword)
    if len(groups) <= 1:
        held = [words, *map(build, groups)]
        return lambda: held
    return lambda: chain([words], map(build, groups))
