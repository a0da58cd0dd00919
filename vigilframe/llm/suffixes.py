"""Suffix order, Burrows-Wheeler transform and bounded interval expansion of a set of byte strings, on arrays."""

from __future__ import annotations

import numpy as np

_FIRST = 7  # symbols of 9 bits that one key holds


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in order of their first ``depth`` symbols at least.

    ``text`` holds bytes plus one, and 0 behind every string; each 0 differs from all others and is smaller
    the earlier it stands.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(_FIRST, text.dtype)]).astype(np.int64)
    key = np.zeros(n, dtype=np.int64)
    closed = np.zeros(n, dtype=bool)  # a string ends within the first symbols: no two such suffixes are equal
    for k in range(_FIRST):
        part = np.where(closed, 0, padded[k : k + n])
        key = (key << 9) | part
        closed |= part == 0
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = (ranked[1:] != ranked[:-1]) | closed[order[1:]]
    del key, ranked, padded
    place = np.arange(n)
    rank = np.empty(n, dtype=np.int64)  # where the group of a suffix begins
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    have = _FIRST
    while have < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        spots = np.flatnonzero(tied)  # places of the order that belong to groups of several
        if not len(spots):
            break
        suffix = order[spots]
        later = suffix + have
        pair = rank[suffix] * (n + 1) + np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        by = np.argsort(pair)
        order[spots] = suffix[by]
        pair = pair[by]
        fresh = np.ones(len(spots), dtype=bool)
        fresh[1:] = pair[1:] != pair[:-1]
        new[spots] = fresh
        rank[order[spots]] = np.maximum.accumulate(np.where(fresh, spots, 0))
        have *= 2
    return order


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """Per string, the places where a substring of ``length`` bytes begins that also begins elsewhere.

    Common prefixes of neighbouring suffixes are derived by increasing value: starting from the whole
    index, every interval (all suffixes that begin with some word) is extended backward by each symbol
    before it, with the Burrows-Wheeler transform alone.  An interval whose right border has no value yet
    gets the length of the word and is extended in its turn; others are known already.  After ``length``
    rounds, borders without a value are exactly those with at least ``length`` symbols in common.
    """
    text = np.zeros(sum(map(len, strings)) + len(strings), dtype=np.int16)
    ends = np.cumsum([len(s) + 1 for s in strings])
    raw = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
    text[:] = raw.astype(np.int16) + 1
    text[ends - 1] = 0
    n, stops = len(text), len(strings)
    order = suffix_order(text, length)
    before = text[order - 1]  # the transform; the text ends with a 0, so the first suffix has one before it
    step = np.empty(n, dtype=np.int32)
    step[np.argsort(before, kind="stable")] = np.arange(n, dtype=np.int32)
    first = text[order]
    known = np.zeros(n + 1, dtype=bool)  # borders in front of a place that have a value
    known[: stops + 1] = True
    known[n] = True
    borders = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
    known[borders] = True
    # Words of one symbol: a separator each, and each byte.
    begin = np.concatenate([np.arange(stops), borders[borders >= stops]])
    end = np.append(begin[1:], n)
    for _ in range(1, length):
        if not len(begin):
            break
        size = end - begin
        total = np.cumsum(size)
        owner = np.repeat(np.arange(len(begin), dtype=np.int32), size)
        at = np.repeat(begin - (total - size), size) + np.arange(total[-1])
        symbol = before[at]
        real = symbol > 0
        at, owner, symbol = at[real], owner[real], symbol[real]
        if not len(at):
            break
        # Within a symbol, order is kept: extensions of one interval lie side by side.
        by = np.argsort(symbol, kind="stable")
        owner, symbol, to = owner[by], symbol[by], step[at[by]]
        cut = np.flatnonzero((owner[1:] != owner[:-1]) | (symbol[1:] != symbol[:-1]))
        low, high = to[np.append(0, cut + 1)], to[np.append(cut, len(to) - 1)] + 1
        open_ = ~known[high]
        known[high[open_]] = True
        begin, end = low[open_].astype(np.int64), high[open_].astype(np.int64)
        sort = np.argsort(begin)
        begin, end = begin[sort], end[sort]
    found = np.zeros(n, dtype=bool)
    found[order[~known[:n] | ~known[1:]]] = True
    return [np.flatnonzero(found[e - len(s) - 1 : e - 1]) for s, e in zip(strings, ends.tolist())]
