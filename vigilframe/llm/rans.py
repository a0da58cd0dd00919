"""Static range asymmetric numeral system over arrays of token ids.

A segment is coded with one frequency table that all its blocks share.  A block is independent of the
others: LANES coder states take turns and their 32-bit words form one stream.  At every checkpoint the
states and the place in the stream are kept, so decoding can begin there; every stretch between
checkpoints has a checksum of its ids.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES = 32
BLOCK_STEPS = 2048  # ids of a block: LANES * BLOCK_STEPS
CHECK_STEPS = 512
TABLE_BITS = 18
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
MAGIC = b"TRA1"
_HEAD = struct.Struct("<4sQIII")


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, frequencies): frequencies are at least 1 and add up to 2 ** TABLE_BITS."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    total, room = counts.sum(), (1 << TABLE_BITS) - len(symbols)
    freq = 1 + (counts[symbols].astype(np.float64) * (room / total)).astype(np.int64)
    freq[np.argmax(freq)] += (1 << TABLE_BITS) - freq.sum()
    return symbols.astype(np.uint16), freq.astype(np.uint32)


def _layout(n: int) -> tuple[int, int]:
    """Number of blocks and steps of the last one."""
    size = LANES * BLOCK_STEPS
    blocks = -(-n // size)
    return blocks, -(-(n - (blocks - 1) * size) // LANES)


def encode(ids: np.ndarray) -> bytes:
    """A segment of ids (unsigned 16-bit) as bytes."""
    n = len(ids)
    if not n:
        return _HEAD.pack(MAGIC, 0, 0, 0, 0)
    symbols, freq = frequency_table(ids)
    place = np.zeros(1 << 16, dtype=np.int32)
    place[symbols] = np.arange(len(symbols))
    blocks, last = _layout(n)
    padded = np.full(blocks * LANES * BLOCK_STEPS, ids[0], dtype=np.uint16)
    padded[:n] = ids
    # (step, block, lane); lane k of a block takes every LANES-th id from its k-th on.
    code = np.ascontiguousarray(place[padded].reshape(blocks, BLOCK_STEPS, LANES).transpose(1, 0, 2))
    f64 = freq.astype(np.uint64)
    c64 = np.concatenate([[0], np.cumsum(f64)[:-1]]).astype(np.uint64)
    top = f64 << np.uint64(63 - TABLE_BITS)
    x = np.full((blocks, LANES), LOW, dtype=np.uint64)
    words = np.zeros((BLOCK_STEPS, blocks, LANES), dtype=np.uint32)
    out = np.zeros((BLOCK_STEPS, blocks, LANES), dtype=bool)
    marks = np.zeros((BLOCK_STEPS // CHECK_STEPS, blocks, LANES), dtype=np.uint64)
    shift, bits = WORD, np.uint64(TABLE_BITS)
    for t in range(BLOCK_STEPS - 1, -1, -1):
        b = blocks if t < last else blocks - 1
        if b:
            s, y = code[t, :b], x[:b]
            f = f64[s]
            full = y >= top[s]
            words[t, :b] = y  # the low 32 bits
            out[t, :b] = full
            y = np.where(full, y >> shift, y)
            q = y // f
            x[:b] = (q << bits) + (y - q * f) + c64[s]
        if t % CHECK_STEPS == 0:
            marks[t // CHECK_STEPS] = x
    sizes = out.sum(axis=2, dtype=np.uint32)
    at = np.concatenate([np.zeros((1, blocks), np.uint32), np.cumsum(sizes, axis=0, dtype=np.uint32)])[:-1:CHECK_STEPS]
    lengths = sizes.sum(axis=0, dtype=np.uint32)
    stream = words.transpose(1, 0, 2)[out.transpose(1, 0, 2)]
    step = LANES * CHECK_STEPS
    sums = np.array([zlib.crc32(ids[i : i + step].tobytes()) for i in range(0, n, step)], dtype=np.uint32)
    table = zlib.compress(np.diff(symbols.astype(np.int64), prepend=0).astype("<u2").tobytes() + freq.astype("<u4").tobytes())
    parts = [lengths.astype("<u4"), at.astype("<u4"), marks.astype("<u8"), sums.astype("<u4"), stream.astype("<u4")]
    head = _HEAD.pack(MAGIC, n, len(symbols), len(table), len(stream))
    return head + table + b"".join(p.tobytes() for p in parts)


def decode(raw: bytes, first: int = 0, stretches: int | None = None) -> np.ndarray:
    """Ids of a segment, or of ``stretches`` stretches (LANES * CHECK_STEPS ids each) from the ``first`` on."""
    magic, n, k, table_size, n_stream = _HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    if not n:
        return np.zeros(0, dtype=np.uint16)
    at = _HEAD.size
    table = zlib.decompress(raw[at : at + table_size])
    at += table_size
    symbols = np.cumsum(np.frombuffer(table, "<u2", k).astype(np.int64)).astype(np.uint16)
    freq = np.frombuffer(table, "<u4", k, 2 * k).astype(np.uint64)
    blocks, last = _layout(n)
    checks = BLOCK_STEPS // CHECK_STEPS

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, count, at)
        at += out.nbytes
        return out

    lengths = take("<u4", blocks)
    begins = take("<u4", checks * blocks).reshape(checks, blocks)
    marks = take("<u8", checks * blocks * LANES).reshape(checks, blocks, LANES)
    step = LANES * CHECK_STEPS
    total = -(-n // step)
    sums = take("<u4", total)
    stream = np.concatenate([take("<u4", n_stream).astype(np.uint64), np.zeros(LANES, np.uint64)])
    base = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))[:-1]])
    # Each stretch is decoded on its own; all of them side by side.
    chosen = np.arange(total)[first : None if stretches is None else first + stretches]
    block, check = chosen // checks, chosen % checks
    x = marks[check, block].copy()
    ptr = base[block] + begins[check, block]
    steps = np.where(block == blocks - 1, np.minimum(last - check * CHECK_STEPS, CHECK_STEPS), CHECK_STEPS)
    slot_symbol = np.repeat(np.arange(k, dtype=np.int32), freq.astype(np.int64))
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    out = np.zeros((CHECK_STEPS, len(chosen), LANES), dtype=np.uint16)
    mask, bits = np.uint64((1 << TABLE_BITS) - 1), np.uint64(TABLE_BITS)
    for t in range(CHECK_STEPS):
        live = int(np.searchsorted(-steps, -t, side="left")) if len(steps) else 0  # only the last can be shorter
        if not live:
            break
        y = x[:live]
        low = y & mask
        s = slot_symbol[low]
        out[t, :live] = symbols[s]
        y = freq[s] * (y >> bits) + low - cum[s]
        need = y < LOW
        ranks = np.cumsum(need, axis=1)
        idx = np.where(need, ptr[:live, None] + ranks - 1, 0)
        x[:live] = np.where(need, (y << WORD) | stream[idx], y)
        ptr[:live] += ranks[:, -1]
    flat = out.transpose(1, 0, 2).reshape(len(chosen) * step)[: max(0, n - first * step)]
    for i, k in enumerate(chosen):
        if zlib.crc32(flat[i * step : (i + 1) * step].tobytes()) != sums[k]:
            raise ValueError(f"stretch {k} does not match its checksum")
    return flat
