"""Brute-force models that several tests use."""

from __future__ import annotations

import re

import xxhash


def slow_fingerprint(text: str | None, k: int) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps: list[int], bits: int) -> list[int]:
    """The number of each fingerprint's component."""
    mark = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= bits and mark[j] < mark[i]:
                    mark[i], changed = mark[j], True
    return mark
