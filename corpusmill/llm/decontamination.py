"""Benchmark passages in documents, by the q-gram lemma.

Both sides are lower-cased, and whatever is neither letter nor digit becomes one space. Items are cut into
overlapping windows. A window of m characters within e edits of a stretch of text shares at least
m + 1 - q (e + 1) of its q-grams with it, all within e + 1 neighbouring diagonals. So shared q-grams are
counted in bands of 2 (e + 1) diagonals that overlap by half; a band with enough of them close together is a
region to verify, by an alignment that stays within the band and e diagonals on either side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import spare, with_row_key, written
from corpusmill.llm.language import _letters

Q = 9
WINDOW = 96
#: No more than the edits of a window: a copied part of WINDOW - STRIDE characters is then sure to be found.
STRIDE = 8
#: Edits allowed for each character of a window.
EDITS = 0.085
#: Characters of benchmark text looked for at a time, by driver and tasks; a larger benchmark is taken in blocks.
BLOCK_CHARS = 4_000_000 * STRIDE // 48
_SLICE = 1 << 20
#: Shared q-grams held at a time, by items and by windows.
_HELD, _TOGETHER = 1 << 22, 1 << 18
#: More places than a slice of texts has.
_FAR = 1 << 34
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22
_FIELDS = {"item_id": pa.int64(), "start": pa.int32(), "end": pa.int32(), "edits": pa.int32(), "windows": pa.int32()}
_FOUND = "array<struct<item_id: bigint, start: int, end: int, edits: int, windows: int>>"


def normalized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalized text, and the place of each in the text."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    held = _letters()[codes] | ((codes >= 0x30) & (codes <= 0x39))
    keep = held.copy()
    keep[1:] |= held[:-1]
    return np.where(held, codes, 0x20)[keep].astype(np.uint32), np.flatnonzero(keep)


def qgrams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q characters from each place on, put together from stretches of doubled length."""
    part, size, factor = codes.astype(np.uint64), 1, _MULTIPLIER
    h, done = np.zeros(len(codes), np.uint64), 0
    while True:
        if q & size:  # the characters done so far come first
            k = max(len(codes) - done - size + 1, 0)
            h = h[:k] * factor + part[done : done + k]
            done += size
        if done == q:
            break
        part = part[: max(len(part) - size, 0)] * factor + part[size:]
        factor, size = np.uint64(int(factor) ** 2 & 0xFFFFFFFFFFFFFFFF), 2 * size
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def budget(length: int, edits: float = EDITS, q: int = Q) -> tuple[int, int]:
    """Edits a window may have, fewer where the lemma would ask for nothing, and the q-grams it must share."""
    e = int(length * edits)
    while e and length + 1 - q * (e + 1) < 1:
        e -= 1
    return e, length + 1 - q * (e + 1)


@dataclass
class Windows:
    """Windows of benchmark items, each different text once.

    Of each text: the items that have it, characters, edits and shared q-grams of its windows, all of one length.
    Of each window, equal ones of a text once: the first item that has it, its text, where it first starts there, its
    characters, edits, and the first window with the same characters. Of each q-gram: the texts and places that have
    it, by text.
    """

    items: list[list[int]]
    size: np.ndarray
    text_edits: np.ndarray
    shared: np.ndarray
    item: np.ndarray
    window_text: np.ndarray
    window_start: np.ndarray
    chars: list[np.ndarray]
    edits: np.ndarray
    same: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    text: np.ndarray
    place: np.ndarray
    seen: np.ndarray
    q: int


def index_windows(texts: list[str], edits: float = EDITS, q: int = Q, window: int = WINDOW, stride: int = STRIDE) -> Windows:
    items: dict[bytes, list[int]] = {}
    for i, text in enumerate(texts):
        codes = normalized(text)[0]
        if len(codes) and codes[-1] == 0x20:
            codes = codes[:-1]
        if len(codes) >= q:
            items.setdefault(codes.tobytes(), []).append(i)
    codes = [np.frombuffer(c, np.uint32) for c in items]
    sizes = np.array([min(len(c), window) for c in codes], np.int64)
    limits = np.array([budget(int(m), edits, q) for m in sizes], np.int64).reshape(-1, 2)
    pieces: dict[bytes, int] = {}
    windows = []
    for i, c in enumerate(codes):
        last, own = len(c) - int(sizes[i]), set()
        for start in sorted({*range(0, last, stride), last}):
            piece = pieces.setdefault(c[start : start + window].tobytes(), len(windows))
            if piece not in own:
                own.add(piece)
                windows.append((i, start, piece))
    owner, first, same = np.array(windows, np.int64).reshape(-1, 3).T
    hashes = [qgrams(c, q) for c in codes]
    flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(codes)), [len(h) for h in hashes]).astype(np.int64)
    place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    grams, starts = np.unique(flat[order], return_index=True)
    seen = np.zeros(1 << _FILTER_BITS, bool)
    seen[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
    chars = [codes[i][start : start + window] for i, start, _ in windows]
    every = list(items.values())
    item = np.array([every[i][0] for i in owner], np.int64)
    return Windows(every, sizes, limits[:, 0], limits[:, 1], item, owner, first, chars, limits[owner, 0], same, grams, np.append(starts, len(flat)), text[order], place[order], seen, q)


def align(patterns: list[np.ndarray], texts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits of each pattern against its row of ``texts``, on the ``width`` diagonals from the first on,
    begun and ended anywhere; and the place in the row where that alignment ends."""
    n, sizes = len(patterns), np.array([len(p) for p in patterns])
    longest = int(sizes.max())
    padded = np.zeros((n, longest), np.uint32)
    for i, p in enumerate(patterns):
        padded[i, : len(p)] = p
    step = np.arange(width)
    cost = np.zeros((n, width), np.int32)
    best, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(1, longest + 1):
        new = cost + (texts[:, i - 1 : i - 1 + width] != padded[:, i - 1 : i])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - step, axis=1) + step
        done = np.flatnonzero(sizes == i)
        if len(done):
            at = cost[done].argmin(axis=1)
            best[done], end[done] = cost[done, at], at + i
    return best, end


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts[i]`` numbers in a row from each ``first[i]`` on, end to end."""
    ends = np.cumsum(counts)
    return np.repeat(first - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def _close(group: np.ndarray, where: np.ndarray, many: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Of rows sorted by group and place, those from which ``many`` rows of the group lie within ``span`` places."""
    last = np.arange(len(group)) + many - 1
    first = np.flatnonzero(last < len(group))
    last = last[first]
    return first[(group[first] == group[last]) & (where[last] - where[first] <= span[first])]


def _regions(codes: np.ndarray, index: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Window, and the lowest place where it could begin, of every band that holds enough shared q-grams close together.

    Shared q-grams are counted by the diagonals of whole items first; only the bands that have enough of them for a
    window are looked at window by window. Few are held at a time, however often a q-gram occurs."""
    hashes = qgrams(codes, index.q)
    at = np.flatnonzero(index.seen[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    which = np.searchsorted(index.grams, hashes[at])
    which[which == len(index.grams)] = 0
    real = index.grams[which] == hashes[at]
    at, which = at[real], which[real]
    upto = np.concatenate([[0], np.cumsum(index.starts[which + 1] - index.starts[which])])
    reach = int((index.size + index.text_edits).max())
    found, a = [np.zeros(0, np.int64)], 0
    while a < len(at):
        b = max(int(np.searchsorted(upto, upto[a] + _HELD, "right")) - 1, int(np.searchsorted(at, at[a] + 2 * reach, "right")))
        found.append(_bands(at[a:b], which[a:b], len(codes), index))
        # Hits that belong together lie within ``reach`` places.
        a = b if b >= len(at) else max(a + 1, int(np.searchsorted(at, at[b] - reach)))
    window, low = np.divmod(np.unique(np.concatenate(found)), _FAR)
    return window, low - _FAR // 2


def _bands(at: np.ndarray, which: np.ndarray, length: int, index: Windows) -> np.ndarray:
    """The regions as one number each: the window, and behind it the place."""
    first = index.starts[which]
    counts = index.starts[which + 1] - first
    posting = _spread(first, counts)
    where, text, place = np.repeat(at, counts), index.text[posting], index.place[posting]
    wide = index.text_edits[text] + 1
    # Strips of neighbouring diagonals; a band is a strip and the next.
    most = int(index.place.max()) + 2
    strips = (length + most) * 2 + 4
    strip = (where - place + most) // wide + 1
    key = text * strips + strip
    names, back, many = np.unique(key, return_inverse=True, return_counts=True)
    beside = np.append(names[1:] == names[:-1] + 1, False)
    after = np.where(beside, np.append(many[1:], 0), 0)
    before = np.append(0, np.where(beside[:-1], many[:-1], 0))
    need = index.shared[names // strips]
    own, other = (many + after >= need)[back], (many + before >= need)[back]
    # A hit counts for the band that begins with its strip and for the one before.
    band = np.concatenate([key[own], key[other] - 1])
    where, place, text = (np.concatenate([x[own], x[other]]) for x in (where, place, text))
    order = np.lexsort((where, band))
    band, where, place, text = band[order], where[order], place[order], text[order]
    if not len(band):
        return np.zeros(0, np.int64)
    good = np.unique(band[_close(band, where, index.shared[text], (index.size + index.text_edits)[text])])
    keep = np.isin(band, good)
    band, where, place, text = band[keep], where[keep], place[keep], text[keep]
    # Now by windows, some bands at a time.
    edges = np.flatnonzero(np.append(True, band[1:] != band[:-1])) if len(band) else np.zeros(0, np.int64)
    cuts = edges[np.unique(np.searchsorted(edges, np.arange(0, len(band), _TOGETHER)))[:-1]] if len(edges) else edges
    spot = index.window_text * (most + 1) + index.window_start
    found = [np.zeros(0, np.int64)]
    for a, b in zip(np.append(0, cuts[cuts > 0]), np.append(cuts[cuts > 0], len(band))):
        t, p = text[a:b], place[a:b]
        low = np.searchsorted(spot, t * (most + 1) + np.maximum(p - index.size[t] + index.q, 0))
        n = np.searchsorted(spot, t * (most + 1) + p, "right") - low
        window = _spread(low, n)
        bands, places, texts = np.repeat(band[a:b], n), np.repeat(where[a:b], n), np.repeat(t, n)
        order = np.lexsort((places, window, bands))
        window, bands, places, texts = window[order], bands[order], places[order], texts[order]
        group = np.cumsum(np.append(True, (window[1:] != window[:-1]) | (bands[1:] != bands[:-1])))[: len(window)]
        hit = _close(group, places, index.shared[texts], (index.size + index.text_edits)[texts])
        lowest = (bands[hit] % strips - 1) * (index.text_edits[texts[hit]] + 1) - most + index.window_start[window[hit]]
        found.append(np.unique(window[hit] * _FAR + lowest + _FAR // 2))
    return np.concatenate(found)


def find_passages(texts: list[str | None], index: Windows) -> list[list[tuple[int, int, int, int, int]]]:
    """For each text the item, start, end, edits and number of different windows of each stretch that holds its windows."""
    out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in texts]
    if not len(index.window_text):
        return out
    most, longest = int(index.edits.max()), int(index.size.max())
    # Texts stand so far apart that no band reaches from one into the next.
    gap = longest + 4 * (most + 1)
    made = [normalized(t or "") for t in texts]
    begins, total = [], gap
    for codes, _ in made:
        begins.append(total)
        total += len(codes) + gap
    joined = np.zeros(total, np.uint32)
    for start, (codes, _) in zip(begins, made):
        joined[start : start + len(codes)] = codes
    window, low = _regions(joined, index)
    if not len(window):
        return out
    width = 2 * (most + 1) + 2 * most
    joined = np.concatenate([joined, np.zeros(width + longest, np.uint32)])
    # Equal windows of several items are aligned once.
    pairs, back = np.unique(index.same[window] * _FAR + low + _FAR // 2, return_inverse=True)
    chars, low = np.divmod(pairs, _FAR)
    low -= _FAR // 2
    aligned = np.full((3, len(chars)), -1, np.int64)
    for a in range(0, len(chars), 4096):
        w, base = chars[a : a + 4096], low[a : a + 4096] - most
        patterns = [index.chars[i] for i in w]
        rows = joined[np.clip(base[:, None] + np.arange(width + longest), 0, len(joined) - 1)]
        best, end = align(patterns, rows, width)
        good = np.flatnonzero(best <= index.edits[w])
        if not len(good):
            continue
        # Backwards from the end, for the start.
        ends = base[good] + end[good]
        behind = joined[np.clip(ends[:, None] - 1 + most - np.arange(width + longest), 0, len(joined) - 1)]
        _, length = align([patterns[i][::-1] for i in good], behind, width)
        aligned[:, a + good] = np.maximum(ends + most - length, 0), ends, best[good]
    holds = np.flatnonzero(aligned[1, back] >= 0)
    window, hits = window[holds], aligned[:, back[holds]]
    text_of = np.searchsorted(begins, hits[0] + 1, "right") - 1
    grouped: dict[tuple[int, int], dict[tuple[int, int], tuple[int, int]]] = {}
    for t, w, own, start, end, edits in zip(text_of.tolist(), window.tolist(), index.window_text[window].tolist(), *hits.tolist()):
        if t >= 0:
            grouped.setdefault((t, own), {}).setdefault((start, end), (edits, w))
    for (t, own), passages in grouped.items():
        places, begin = made[t][1], begins[t]
        spans: list[list] = []
        for (start, end), (edits, w) in sorted(passages.items()):
            a, b = max(start - begin, 0), min(end - begin, len(places))
            if b <= a:
                continue
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
                spans[-1][2] = min(spans[-1][2], edits)
                spans[-1][3].add(w)
            else:
                spans.append([a, b, edits, {w}])
        for item in index.items[own]:
            out[t] += [(item, int(places[a]), int(places[b - 1]) + 1, edits, len(ws)) for a, b, edits, ws in spans]
    return [sorted(found) for found in out]


def _sent(spark: SparkSession, items: list[int | None], benchmark: list[str], edits: float, q: int) -> Broadcast:
    return spark.sparkContext.broadcast((items, index_windows(benchmark, edits, q)))


def passages_column(spark: SparkSession, items: list[int | None], benchmark: list[str], text: Column, edits: float = EDITS, q: int = Q) -> Column:
    """For each text an array of item_id, start and end in the text, edits, windows."""
    return _looked_for(_sent(spark, items, benchmark, edits, q), text)


def _looked_for(shared: Broadcast, text: Column) -> Column:
    @F.arrow_udf(_FOUND)
    def find(texts: pa.Array) -> pa.Array:
        names, index = shared.value
        rows, held, size = [], [], 0
        for text in [*texts, None]:
            held.append(None if text is None else text.as_py())
            size += len(held[-1] or "")
            if size >= _SLICE or text is None:
                rows += find_passages(held, index)
                held, size = [], 0
        found = [[dict(zip(_FIELDS, (names[item], *rest))) for item, *rest in row] for row in rows[: len(texts)]]
        return pa.array(found, pa.list_(pa.struct(list(_FIELDS.items()))))

    return find(text)


def _blocks(rows: DataFrame, many: int, most: int) -> Iterator[tuple[list, list[str]]]:
    ids, texts, held = [], [], 0
    for row in (rows.repartition(many) if many > 1 else rows).toLocalIterator():
        ids.append(row["item"])
        texts.append(row["text"])
        held += len(row["text"])
        if held >= most:
            yield ids, texts
            ids, texts, held = [], [], 0
    if texts:
        yield ids, texts


def with_passages(docs: DataFrame, benchmark: DataFrame, name: str, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS, q: int = Q, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with a column ``name``: an array of structs item_id, start, end, edits, windows.

    The benchmark is the query set: it is sent to the tasks. If it is larger than a block, each block's passages
    are written before the next is read, so that driver and tasks hold one block at a time, and joined to the
    rows at the end. Items that are null, or shorter than q characters after normalizing, are not looked for; a
    null or empty text holds nothing; repeated items are found each. Whole texts are read, and all other columns
    and rows of ``docs`` stay as they are.
    """
    spark, text = docs.sparkSession, F.col(f"`{text_col}`")
    rows = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text_col}`").alias("text")).filter("text is not null")
    counted = rows.agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars")).first()
    many = min(counted["rows"], -(-(counted["chars"] or 0) // block_chars))
    if many <= 1:
        held = [(r["item"], r["text"]) for r in rows.toLocalIterator()]
        found = passages_column(spark, [i for i, _ in held], [t for _, t in held], text, edits, q) if held else F.array().cast(_FOUND)
        return docs.withColumn(name, found)
    keyed, key = with_row_key(docs)
    made = None
    for ids, texts in _blocks(rows, many, block_chars):
        shared = _sent(spark, ids, texts, edits, q)
        part = written(keyed.select(*key, _looked_for(shared, text).alias("found")).filter(F.size("found") > 0))
        shared.destroy()
        made = part if made is None else made.unionByName(part)
    other = [spare(keyed, c) for c in ("_k1", "_k2", "_found")]
    made = made.groupBy(*key).agg(F.flatten(F.collect_list("found")).alias("found")).toDF(*other)
    joined = keyed.join(made, (F.col(key[0]) == F.col(other[0])) & (F.col(key[1]) == F.col(other[1])), "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c != name], F.coalesce(other[2], F.array().cast(_FOUND)).alias(name)).select(*[F.col(f"`{c}`") for c in [*docs.columns, *[name] * (name not in docs.columns)]])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, item_id, start, end, edits, windows: a row for each stretch of a document that holds a benchmark
    passage. Repeated rows give repeated rows; an empty table on either side gives none."""
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = with_passages(own, benchmark, "found", **options).select("doc_id", F.explode("found").alias("f"))
    return found.select("doc_id", "f.item_id", "f.start", "f.end", "f.edits", "f.windows")
