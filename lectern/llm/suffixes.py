"""Sorted suffixes of a byte string, to a given depth, by two-stage sorting.

Only suffixes whose first byte isn't above their second are sorted directly. All others are
induced: buckets of first bytes are scanned from the least, and each suffix found puts the
one before it, if that is of the other kind, next into its bucket.

The direct sort goes by branching: members of a group that agree so far are compared with the
first of them by hash, the depth they all share is skipped, and the eight bytes that follow
split the group.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(17).integers(0, 1 << 64, 257, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


class _Powers:
    """Powers of the base and of its inverse, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            self.up, self.down = (
                np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b))))
                for b in (_BASE, _UNBASE)
            )


_POWERS = _Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _HALF)) * _MIX
    return h ^ (h >> _HALF)


class Hashes:
    """64-bit hashes of all substrings; symbols are 0 to 256."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        _POWERS.grow(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[symbols] * _POWERS.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * _POWERS.down[start]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes ``a`` and ``b``, up to ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high + 1) // 2, low)
            same = self.of(a, middle) == self.of(b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def _words(symbols: np.ndarray) -> np.ndarray:
    """Seven symbols from each place as one number that sorts as they do."""
    n = len(symbols) - 6
    key = np.zeros(n, np.uint64)
    for j in range(7):
        key = key * np.uint64(257) + symbols[j : n + j].astype(np.uint64)
    return key


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys each place is in."""
    change = np.zeros(len(keys[0]), bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.cumsum(change)


def _sorted_directly(symbols: np.ndarray, hashes: Hashes, at: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of their suffixes, equal up to ``depth`` in any order."""
    words = _words(symbols)
    key = words[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    out = at.copy()
    place = np.arange(len(at))
    group = _runs(key)
    shared = np.full(len(at), 7)
    while True:
        # Groups of more than one that don't agree to the full depth yet.
        sizes = np.bincount(group)
        keep = (sizes[group] > 1) & (shared < depth)
        at, place, group, shared = at[keep], place[keep], group[keep], shared[keep]
        if not len(at):
            return out
        group = _runs(group)
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        first = at[starts][group]
        common = hashes.common(at + shared, first + shared, depth - shared)
        shared = shared + np.minimum.reduceat(common, starts)[group]
        key = words[at + shared]
        order = np.lexsort((key, group))
        # Members only move inside the places of their group.
        at, key, shared = at[order], key[order], shared[order]
        out[place] = at
        group = _runs(group, key)
        shared = shared + 7


def sorted_suffixes(symbols: np.ndarray, hashes: Hashes, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Places marked in ``wanted``, and those they are induced from, in order of their
    suffixes, compared up to ``depth`` symbols (an induced one, a symbol more for each step).
    ``symbols`` go on for ``depth + 16`` zeros or more."""
    n = len(wanted)
    head, nxt = symbols[:n], symbols[1 : n + 1]
    above = head > nxt
    needed = wanted.copy()
    while (more := needed[:-1] & above[:-1] & ~needed[1:]).any():
        needed[1:] |= more
    direct = _sorted_directly(symbols, hashes, np.flatnonzero(needed & ~above), depth)
    first = symbols[direct]
    bounds = np.searchsorted(first, np.arange(258))
    induced: list[list[np.ndarray]] = [[] for _ in range(258)]
    # The end of the string is a suffix of its own, below all others.
    if n and needed[n - 1] and above[n - 1]:
        induced[int(head[n - 1])].append(np.array([n - 1]))
    out = []
    for c in range(257):
        bucket = np.concatenate([*induced[c], direct[bounds[c] : bounds[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[needed[before] & above[before]]
        letters = symbols[before]
        order = np.argsort(letters, kind="stable")
        before, letters = before[order], letters[order]
        cuts = np.flatnonzero(letters[1:] != letters[:-1]) + 1
        for part in np.split(before, cuts) if len(before) else []:
            induced[int(symbols[part[0]])].append(part)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def repeated_places(strings: list[bytes], depth: int) -> list[np.ndarray]:
    """For each string, whether each place that has ``depth`` bytes from it on begins a
    substring of that length that begins at another place too, of this string or another."""
    parts, wanted = [], []
    for s in strings:
        parts += [np.frombuffer(s, np.uint8).astype(np.int64) + 1, np.zeros(1, np.int64)]
        starts = max(0, len(s) - depth + 1)
        wanted += [np.ones(starts, bool), np.zeros(len(s) + 1 - starts, bool)]
    symbols = np.concatenate([*parts, np.zeros(2 * depth + 16, np.int64)])
    marked = np.concatenate([np.zeros(0, bool), *wanted])
    hashes = Hashes(symbols)
    order = sorted_suffixes(symbols, hashes, marked, depth)
    a, b = order[:-1], order[1:]
    adjacent = hashes.common(a, b, np.full(len(a), depth)) >= depth
    found = np.zeros(len(marked), bool)
    found[a[adjacent]] = True
    found[b[adjacent]] = True
    out, at = [], 0
    for s in strings:
        out.append(found[at : at + max(0, len(s) - depth + 1)])
        at += len(s) + 1
    return out
