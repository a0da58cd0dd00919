"""Word shingle sets of Arrow text batches, computed on whole arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FOLD = np.arange(256)
_FOLD[65:91] += 32  # A-Z count as a-z
_BYTE = _BYTE[_FOLD]
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = 1 << max(16, (n - 1).bit_length())
        known = np.ones(1, dtype=np.uint64)
        step = base
        while len(known) < size:
            known = np.concatenate([known, known * np.uint64(step)])
            step = step * step % (1 << 64)
        _POWERS[base] = known
    return known[:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an array of texts; null: empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words one text after the other, first word of each text and the end)."""
    data, offsets = text_bytes(texts)
    if not len(data):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    inside = ~_IS_SPACE[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False  # a text's first word begins with the text
    begin = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    after[ends] = False
    end = np.flatnonzero(inside & ~after) + 1
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=prefix[1:])
    words = (prefix[end] - prefix[begin]) * _powers(_INVERSE, len(data))[begin]
    return mix(words + (end - begin).astype(np.uint64)), np.searchsorted(begin, offsets)


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, ascending within each text, and where each text's begin and end).

    A text of fewer than ``size`` words is one shingle, a text without words has none.
    """
    words, first = word_hashes(texts)
    count = np.diff(first)
    grams = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for k in range(size):
        grams += words[k : k + len(grams)] * _PLACE[k]
    grams = mix(grams)
    sets = []
    for a, n in zip(first[:-1].tolist(), count.tolist()):
        if n >= size:
            s = grams[a : a + n - size + 1]
            s.sort()
            sets.append(s[np.append(True, s[1:] != s[:-1])])
        elif n:
            short = (words[a : a + n] * _PLACE[size : size + n]).sum(dtype=np.uint64) + np.uint64(n)
            sets.append(mix(np.array([short], dtype=np.uint64)))
        else:
            sets.append(grams[:0])
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else grams[:0]), np.append(0, np.cumsum(sizes))


def set_ids(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit id per set (equal sets, equal ids); 0 for empty sets."""
    sizes = np.diff(bounds)
    total = np.append(np.uint64(0), np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
    ids = mix((total[bounds[1:]] - total[bounds[:-1]]) + sizes.astype(np.uint64)).view(np.int64)
    return np.where(sizes > 0, ids, 0)
