"""A run-length grammar of a sequence by recompression, and longest common extensions on it.

Two kinds of rounds take turns. Block compression gives every maximal block of one symbol, two or more long, a
symbol of its own; equal blocks get equal symbols. Pair compression deals the symbols into left and right ones
and gives every left symbol followed by a right one a common symbol. A symbol thus stands for the same sequence
wherever it occurs, and the parse of a stretch depends on the symbols next to it only. Two places are compared
by climbing while both are boundaries of the next round, stepping over equal symbols, and descending into the
first symbols that differ.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Round:
    """One sequence of symbols, and how the next one covers it."""

    symbols: np.ndarray
    #: For each symbol the place of the one that covers it; for each of those the first place it covers, and the end.
    cover: np.ndarray | None = None
    first: np.ndarray | None = None
    blocks: bool = False


def _blocks(symbols: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First places of the maximal blocks, their symbols, and the next symbol that is free."""
    first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    sizes = np.diff(np.append(first, len(symbols)))
    made = symbols[first]
    long = np.flatnonzero(sizes > 1)
    if len(long):
        key = made[long] * np.int64(len(symbols) + 1) + sizes[long]
        names, which = np.unique(key, return_inverse=True)
        made = made.copy()
        made[long] = fresh + which
        fresh += len(names)
    return first, made, fresh


def _pairs(symbols: np.ndarray, fresh: int, loose: int, turn: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The same for pairs. Symbols below ``loose`` stay by themselves."""
    mixed = (symbols.astype(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
    left = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(63) == 1
    free = symbols >= loose
    ahead = left[:-1] & ~left[1:] & free[:-1] & free[1:]
    back = ~left[:-1] & left[1:] & free[:-1] & free[1:]
    at = np.flatnonzero(ahead if ahead.sum() >= back.sum() else back)
    keep = np.ones(len(symbols), bool)
    keep[at + 1] = False
    first = np.flatnonzero(keep)
    made = symbols[first]
    if len(at):
        key = symbols[at] * np.int64(fresh) + symbols[at + 1]
        names, which = np.unique(key, return_inverse=True)
        place = np.cumsum(keep) - 1
        made[place[at]] = fresh + which
        fresh += len(names)
    return first, made, fresh


class Grammar:
    """The rounds over a sequence of non-negative integers.

    Symbols below ``loose`` are separators: each must occur once, and the first and the last symbol must be
    separators, so that every comparison of two different places ends inside the sequence.
    """

    def __init__(self, symbols: np.ndarray, loose: int) -> None:
        now = symbols.astype(np.int64)
        fresh = int(now.max(initial=0)) + 1
        self.rounds: list[Round] = []
        blocks, still = True, 0
        while still < 8:  # pairs of a random deal can be missing by chance, not eight times
            free = now >= loose
            if not (free[1:] & free[:-1]).any():
                break
            first, made, fresh = _blocks(now, fresh) if blocks else _pairs(now, fresh, loose, len(self.rounds))
            if len(first) < len(now):
                starts = np.zeros(len(now), np.int32)
                starts[first] = 1
                cover = np.cumsum(starts, dtype=np.int32) - 1
                self.rounds.append(Round(now.astype(np.int32), cover, np.append(first, len(now)).astype(np.int32), blocks))
                now, still = made, 0
            else:
                still += 1
            blocks = not blocks
        self.rounds.append(Round(now.astype(np.int32)))

    def extend(self, a: np.ndarray, b: np.ndarray, ahead: bool = True) -> np.ndarray:
        """How many symbols agree from the gaps ``a`` and ``b`` on (gap i is in front of symbol i), or backwards."""
        n = len(a)
        i, j = a.astype(np.int64), b.astype(np.int64)
        level = np.zeros(n, np.int32)
        going = np.arange(n)
        for k, now in enumerate(self.rounds):
            if not len(going):
                break
            level[going] = k
            rising: list[np.ndarray] = []
            while len(going):
                x, y = i[going], j[going]
                if now.cover is not None:
                    up_x, up_y = now.cover[np.minimum(x, len(now.cover) - 1)], now.cover[np.minimum(y, len(now.cover) - 1)]
                    edge = (now.first[up_x] == x) & (now.first[up_y] == y)
                    up = going[edge]
                    i[up], j[up] = up_x[edge], up_y[edge]
                    rising.append(up)
                    going, x, y = going[~edge], x[~edge], y[~edge]
                going = self._step(now, i, j, going, x, y, ahead)
            going = np.concatenate(rising) if rising else going
        # Down again: at each round below, over what still agrees, into what does not.
        for k in range(len(self.rounds) - 2, -1, -1):
            now = self.rounds[k]
            below = np.flatnonzero(level > k)
            i[below], j[below] = now.first[i[below]], now.first[j[below]]
            while len(below):
                below = self._step(now, i, j, below, i[below], j[below], ahead)
        return np.abs(i - a)

    @staticmethod
    def _step(now: Round, i: np.ndarray, j: np.ndarray, who: np.ndarray, x: np.ndarray, y: np.ndarray, ahead: bool) -> np.ndarray:
        """Move those of ``who`` on whose next symbols agree, over as much of a block as both have; return them."""
        last = len(now.symbols) - 1
        p, q = (np.minimum(x, last), np.minimum(y, last)) if ahead else (np.maximum(x - 1, 0), np.maximum(y - 1, 0))
        same = now.symbols[p] == now.symbols[q]
        who, x, y, p, q = who[same], x[same], y[same], p[same], q[same]
        if not now.blocks:
            far = np.ones(len(who), np.int64)
        elif ahead:
            far = np.minimum(now.first[now.cover[p] + 1] - x, now.first[now.cover[q] + 1] - y)
        else:
            far = np.minimum(x - now.first[now.cover[p]], y - now.first[now.cover[q]])
        i[who] = x + far if ahead else x - far
        j[who] = y + far if ahead else y - far
        return who
