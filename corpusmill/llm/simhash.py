"""Near-duplicates by SimHash, with candidates from distances to reference fingerprints.

The reference fingerprints are 0 and, for each of 32 pairs of neighbouring bits, the one that has just that
pair set. Their Hamming distances to a fingerprint are worked out once, as its row of the pivot table. For
two fingerprints every coordinate differs by at most their own distance. And since d(x, 0) - d(x, pair) tells
how many bits of the pair x has, the differences over all pairs add up to at most that distance too. So if
pairs fall into ``bits + 2`` groups, some two groups agree as a whole: the keys on which fingerprints meet.
In each key group, pairs are discarded by their greatest coordinate difference; survivors are verified.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import written
from corpusmill.llm.components import components

SHINGLE = 3
BITS = 2
SEED = 42
#: Reference fingerprints.
PIVOTS = np.array([0, *(3 << (2 * i) for i in range(32))], np.uint64)
#: Members of one key group that a task compares; larger groups go through shared neighbours.
GROUP = 2048
_BLOCK = 256


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the XXH64 (seed 42) of all word shingles, repeats included; 0 without words."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white space characters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], ">u8")
    bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(bits), 255):  # a sum of 255 bits fits a byte
        counts += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of each whole text, its 64 bits as a long; a null text has no words."""

    @F.arrow_udf("bigint")
    def make(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py() or b"", shingle) for t in texts], np.uint64).view(np.int64))

    return make(text.cast("binary"))


def _coordinates(fps: np.ndarray) -> np.ndarray:
    """The pivot table: Hamming distances to all reference fingerprints."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS).astype(np.int8)


def _keys(table: np.ndarray, bits: int) -> list[np.ndarray]:
    """A key for every two of bits + 2 groups of pairs, from the rows of the pivot table."""
    held = (table[:, :1] - table[:, 1:] + 2) >> 1  # set bits of each pair: 0, 1 or 2
    groups = np.array_split(np.arange(32), bits + 2)
    base = np.uint64(3) ** np.arange(32, dtype=np.uint64)
    coded = [(held[:, g].astype(np.uint64) * base[: len(g)]).sum(axis=1, dtype=np.uint64) for g in groups]
    return [coded[i] * np.uint64(3**16) + coded[j] for i, j in combinations(range(len(groups)), 2)]


def _links(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """A tree of links for each set of fingerprints that hang together, by the pivot table in blocks."""
    table, parent = _coordinates(fps), list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for start in range(0, len(fps), _BLOCK):
        own = table[start : start + _BLOCK]
        left, right = np.nonzero(np.abs(own[:, :1] - table[start:, 0]) <= bits)
        keep = right > left
        left, right = left[keep], right[keep]
        for first in range(1, len(PIVOTS), 8):  # eight coordinates at a time, on what is left
            near = np.abs(own[left, first : first + 8] - table[start + right, first : first + 8]).max(axis=1) <= bits
            left, right = left[near], right[near]
        close = np.bitwise_count(fps[start + left] ^ fps[start + right]) <= bits
        for a, b in zip((start + left[close]).tolist(), (start + right[close]).tolist()):
            x, y = root(a), root(b)
            if x != y:
                parent[y] = x
                links.append((a, b))
    return links


def _edges(fps: DataFrame, bits: int, group: int) -> DataFrame:
    """Links that join all fingerprints which hang together. ``fps`` has distinct fingerprints."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for band, key in enumerate(_keys(_coordinates(own), bits)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), band, np.int32)), pa.array(key.view(np.int64)), batch.column(0)], ["band", "key", "fp"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_groups(batches):
            band, key, fps = (c.to_numpy(zero_copy_only=False) for c in columns)
            at = np.flatnonzero((np.diff(band, prepend=-1) != 0) | (np.diff(key, prepend=0) != 0) | (np.arange(len(key)) == 0))
            pairs = []
            for a, b in zip(at, [*at[1:], len(key)]):
                own = fps[a:b]
                pairs += [(own[i], own[j]) for i, j in _links(own.view(np.uint64), bits)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    bands = fps.mapInArrow(keyed, "band int, key bigint, fp bigint")
    sizes = written(bands.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    met = written(bands.join(sizes, ["band", "key"]))
    small = met.filter(F.col("n") <= group).repartition("band", "key").sortWithinPartitions("band", "key").select("band", "key", "fp")
    near = small.mapInArrow(linked, "a bigint, b bigint")
    # Members of a larger group: two fingerprints differ in at most bits places exactly if they share a value
    # that differs from each in half as many; all that share one are tied to the smallest.
    hot = met.filter(F.col("n") > group).select("fp").distinct()
    steps = [0]
    for k in range(1, bits // 2 + 1):
        steps += [sum(1 << i for i in c) for c in combinations(range(64), k)]
    flips = F.array(*[F.lit(s - (1 << 64) if s >> 63 else s).cast("long") for s in steps])
    around = hot.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    hubs = around.groupBy("hub").agg(F.min("fp").alias("b"), F.count("*").alias("n")).filter("n > 1")
    shared = around.join(hubs, "hub").select(F.col("fp").alias("a"), "b").filter("a <> b").distinct()
    return near.unionByName(shared)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """Batches of sorted rows cut anew so that no (band, key) group is parted."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        band, key = held.column(0).to_numpy(), held.column(1).to_numpy()
        changes = np.flatnonzero((band != band[-1]) | (key != key[-1])) if len(band) else []
        if len(changes):
            cut = int(changes[-1]) + 1
            yield [c.combine_chunks() for c in held.slice(0, cut).columns]
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield [c.combine_chunks() for c in held.columns]


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable over links of at most ``bits`` bits), component (its
    smallest fingerprint) and the columns named in ``carry``: a row per row.

    A null or empty text has no words and fingerprint 0, linked like any other. A null id stays null and is no
    component's id unless all its ids are null. Repeated rows give repeated rows. An empty table gives no rows.
    Columns besides those named play no part. Equal fingerprints meet once, whatever their number.
    """
    if bits % 2 or bits < 0:
        raise ValueError("bits must be even")
    own = [F.col(f"`{c}`") for c in carry]
    made = written(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), fingerprint_column(F.col(f"`{text_col}`"), shingle).alias("fp"), *own))
    distinct = written(made.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(_edges(distinct.select("fp"), bits, group))
    placed = written(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("component")))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "component").select("fp", "component", "component_id")
    return made.join(named, "fp").select("doc_id", "fp", "component_id", "component", *own)


def first_of_each(found: DataFrame, key: Sequence[str]) -> DataFrame:
    """Of each component the row with the smallest id (nulls last), then the smallest ``key``: only the key."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *key)
    return found.groupBy("component").agg(F.min(order).alias("best")).select(*[F.col(f"best.{k}").alias(k) for k in key])
