"""Suffix array of bytes by two-stage sorting, to a bounded depth.

Stage one sorts the suffixes that are smaller than their successor, by comparing eight bytes at a time. Stage two scans
the buckets of first bytes in order and places each remaining suffix, larger than its successor, at the front of its own
bucket when its successor is met.
"""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as a big-endian number; zeros beyond the end."""
    out, n = np.zeros(len(text), np.uint64), len(text)
    for k in range(min(8, n)):
        out[:n - k] |= text[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it. The last suffix is larger than the empty one."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[-1] = -1
    # Within a run of equal bytes the run's last position decides.
    decides = np.where(step != 0, np.arange(n), n - 1)
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    return step[decides] > 0


def _sort_directly(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` in the order of their first ``depth`` bytes; ties keep the order of positions."""
    n = len(words)
    at = at[np.argsort(words[at], kind="stable")]
    same = np.zeros(len(at), bool)
    same[1:] = words[at[1:]] == words[at[:-1]]
    for far in range(8, depth, 8):
        tied = same.copy()
        tied[:-1] |= same[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        own = at[rows]
        group = np.cumsum(~same[rows])
        where = own + far
        key = np.where(where < n, words[np.minimum(where, n - 1)], 0)
        order = np.lexsort((key, group))
        at[rows] = own[order]
        key, group = key[order], group[order]
        same[rows[1:]] = (key[1:] == key[:-1]) & (group[1:] == group[:-1])
        same[rows[0]] = False
    return at


def suffix_array(text: np.ndarray, depth: int, words: np.ndarray | None = None) -> np.ndarray:
    """Positions of ``text`` in the order of their suffixes, to at least ``depth`` bytes."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    words = words_at(text) if words is None else words
    small = smaller_than_next(text)
    direct = _sort_directly(np.flatnonzero(small), words, depth)
    by_byte = np.split(direct, np.searchsorted(text[direct], np.arange(1, 256)))
    # induced[c]: larger-than-next suffixes of bucket c found so far, in order.
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        waves, k = induced[c], 0
        while k < len(waves):
            before = waves[k] - 1
            before = before[before >= 0]
            before = before[~small[before]]
            _deal(before, text, induced)
            k += 1
        before = by_byte[c] - 1
        before = before[before >= 0]
        _deal(before[~small[before]], text, induced)
        out += [*waves, by_byte[c]]
    return np.concatenate(out)


def _deal(at: np.ndarray, text: np.ndarray, induced: list[list[np.ndarray]]) -> None:
    """Append positions to the buckets of their bytes, in the order given."""
    if not len(at):
        return
    first = text[at]
    order = np.argsort(first, kind="stable")
    at, first = at[order], first[order]
    cuts = np.flatnonzero(np.diff(first)) + 1
    for part, c in zip(np.split(at, cuts), first[np.concatenate([[0], cuts])], strict=True):
        induced[c].append(part)


def common_with_neighbour(order: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """True for each place of ``order`` whose suffix shares ``depth`` bytes with the suffix before or after it."""
    n = len(words)
    alike = np.arange(len(order) - 1)
    for far in range(0, depth, 8):
        x, y = order[alike] + far, order[alike + 1] + far
        inside = (x < n) & (y < n)
        alike, x, y = alike[inside], x[inside], y[inside]
        left, bits = depth - far, np.uint64(0)
        if left < 8:
            bits = np.uint64(8 * (8 - left))
        alike = alike[(words[x] >> bits) == (words[y] >> bits)]
    whole = np.maximum(order[alike], order[alike + 1]) + depth <= n
    found = np.zeros(len(order), bool)
    found[alike[whole]] = True
    found[alike[whole] + 1] = True
    return found
