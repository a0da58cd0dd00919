"""Token ids of texts inside Arrow batches; equal words are encoded once.

The tokenizer splits a text at every single space before it merges.  So a batch is cut at spaces, pieces
not met before go through the tokenizer, and the ids of the texts are put together from the pieces.
"""

from __future__ import annotations

import ctypes
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Pieces kept in each of two generations; those used lately outlive the others.
CACHE_PIECES = 200_000
#: Texts and characters that are encoded together at most (a single text may be longer).
BATCH_TEXTS, BATCH_CHARS = 5000, 12_000_000
#: A space between two whitespace characters (or before the end) may join tokens across it.
_JOINED = re.compile(r"\s (?:\s|$)")
#: A full stop or comma behind a letter, and a letter behind its line feed, are parts of their own to the
#: tokenizer: they become pieces of their own, marked as not following a space.
_MARK = "\x01"
_CUTS = [(r"(\pL)([.,])( |\n|$)", "\\1 \x01\\2\\3"), (r"\x01([.,])\n(\pL)", "\x01\\1\n \x01\\2")]


def _spread(codes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the elements of the runs ``codes``, one run after the other, and the runs' lengths."""
    size = length[codes]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat((begin[codes] - (ends - size)).astype(np.int32), size) + np.arange(total, dtype=np.int32), size


class Encoder:
    """Encodes batches of texts just as the tokenizer encodes each whole text.

    Texts with runs of whitespace around a space, or with the string of a special token, are given to the
    tokenizer whole.  ``plain`` treats strings of special tokens as ordinary text.
    """

    def __init__(self, path: str = TOKENIZER, plain: bool = False):
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = plain
        vocab = self.tok.get_vocab()
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("token ids over 65535 need another width")
        #: Whether an id stands for text that begins with a space (written as a letter in the vocabulary).
        self.begins = np.zeros(1 << 16, dtype=bool)
        self.begins[[i for t, i in vocab.items() if t[0] == "Ġ"]] = True
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.pieces: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """The tokenizer itself; ids as unsigned 16-bit integers."""
        return [np.array(e.ids, dtype="<u2").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces that follow a space: many as one text, told apart where a token begins with a space."""
        apart = [p for p in pieces if not p or p[0] == _MARK or p[0].isspace() or p[-1].isspace()]
        self.pieces.update(zip(apart, self.whole([p[1:] if p[:1] == _MARK else " " + p for p in apart])))
        inner = [p for p in pieces if p and not (p[0] == _MARK or p[0].isspace() or p[-1].isspace())]
        for at in range(0, len(inner), 2000):
            part = inner[at : at + 2000]
            raw = self.whole([" " + " ".join(part)])[0]
            cut = [*(2 * np.flatnonzero(self.begins[np.frombuffer(raw, "<u2")])).tolist(), len(raw)]
            if len(cut) != len(part) + 1:
                raise ValueError("the tokenizer does not split at spaces")
            self.pieces.update(zip(part, [raw[a:b] for a, b in zip(cut, cut[1:])]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids one text after the other, number of ids per text); null: none."""
        if len(self.pieces) > CACHE_PIECES:
            self.former, self.pieces = self.pieces, {}
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        strings = texts.to_pylist()
        special = self.special.search if self.special else lambda t: None
        odd = np.fromiter((bool(_JOINED.search(t) or _MARK in t or special(t)) for t in strings), bool, len(strings))
        if odd.any():
            texts = pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts)
        for pattern, by in _CUTS:
            texts = pc.replace_substring_regex(texts, pattern, by)
        # What a text begins with does not follow a space; odd texts are nothing but such a beginning.
        split = pc.split_pattern(texts, " ")
        starts = split.values.take(pa.array(np.asarray(split.offsets)[:-1])).to_pylist()
        first = list(set(starts))
        known = dict(zip(first, self.whole([p.removeprefix(_MARK) for p in first])))
        rest = iter(self.whole([t for t, o in zip(strings, odd) if o]))
        heads = [next(rest) if o else known[p] for p, o in zip(starts, odd)]
        del strings
        offsets = np.asarray(split.offsets)
        coded = split.values.dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        pieces = coded.dictionary.to_pylist()
        del split, coded
        new = [p for p in pieces if p not in self.pieces]
        former = self.former
        self.pieces.update((p, former[p]) for p in new if p in former)
        self._learn([p for p in new if p not in former])
        runs = [*map(self.pieces.__getitem__, pieces), *heads]
        codes[offsets[:-1]] = np.arange(len(heads)) + len(pieces)
        length = np.fromiter(map(len, runs), np.int64, len(runs)) >> 1
        ids = np.frombuffer(b"".join(runs), "<u2")
        at, sizes = _spread(codes, np.cumsum(length) - length, length)
        bounds = np.append(0, np.cumsum(sizes))[offsets]
        return ids[at], np.diff(bounds)

    def batches(self, texts: pa.Array):
        """(first row, rows, ids, lengths) of bounded slices of the texts."""
        texts = texts.cast(pa.large_string())
        ends = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(texts), 0)).astype(np.int64))
        at = 0
        while at < len(texts):
            limit = (ends[at - 1] if at else 0) + BATCH_CHARS
            n = max(1, min(BATCH_TEXTS, int(np.searchsorted(ends, limit, side="right")) - at))
            yield (at, n, *self.encode(texts.slice(at, n)))
            at += n

    def documents(self, texts: pa.Array, end_id: int):
        """(first row, rows, ids, lengths) with an end id after every text."""
        for at, n, ids, lengths in self.batches(texts):
            yield at, n, np.insert(ids, np.cumsum(lengths), end_id), lengths + 1
        release()


def release() -> None:
    """Give unused memory back: Python workers stay, and others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str = TOKENIZER, plain: bool = False) -> Encoder:
    """The encoder of this Python worker; its cache serves all tasks that the worker runs."""
    if (path, plain) not in _ENCODERS:
        _ENCODERS[path, plain] = Encoder(path, plain)
    return _ENCODERS[path, plain]
