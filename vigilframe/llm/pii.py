"""Personal data in texts: patterns, and a character BiLSTM-CRF over overlapping windows of whole texts."""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilframe.llm import bilstm_crf as crf
from vigilframe.llm.common import query, table

KINDS = ("email", "ip", "card", "phone")
#: Windows begin every STRIDE characters and share WINDOW - STRIDE with the next, more than a span is long.
WINDOW, STRIDE = 256, 192
#: Windows that are worked on together, and characters of a text that are made into windows at a time.
BATCH_WINDOWS, SLICE = 2048, STRIDE * 512
#: Bounds of the labelled sample: documents whose texts carry it, characters of each, windows, characters of a window.
SAMPLE_DOCS, SAMPLE_CHARS, TRAIN_WINDOWS, TRAIN_CHARS = 400, 4000, 2000, 96
EPOCHS, SEED = 9, 12

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match begins inside a run of digits: what fails at its start fails later too.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")

Span = tuple[int, int, int]  # kind, start, end


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by kind and start; matches that fail their check are dropped.

    Runs in time proportional to the text: an address is grown to the left from its at sign, so a long run of
    its characters is read once.
    """
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            done = found.end()
            out.append((0, start, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and _card(m[0].replace(" ", "").replace("-", "")):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
            out.append((3, m.start(), m.end()))
    return out


# Labelled spans for training: written forms of personal data, put into pieces of real texts.

_NAMES = "anna ben carla dmitri eva farid greta hugo ines jonas kim lena marco nadia otto paula quentin rosa sven tara".split()
_HOSTS = "post mail firma kontor verlag studio labor praxis werft mensa".split()
_ENDINGS = "com org net de fr es info example.com co.uk".split()


def _pick(rng: random.Random, n: int, digits: str = "0123456789") -> str:
    return "".join(rng.choice(digits) for _ in range(n))


def _some_email(rng: random.Random) -> str:
    name, host, end = rng.choice(_NAMES), rng.choice(_HOSTS), rng.choice(_ENDINGS)
    name += rng.choice(["", f".{rng.choice(_NAMES)}", _pick(rng, 2), f"_{_pick(rng, 3)}", f".{_pick(rng, 2)}"])
    host += rng.choice(["", _pick(rng, 1), f"-{rng.choice(_HOSTS)}"])
    at, dot = rng.choice([("@", "."), ("@", "."), ("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", "."), ("(at)", "."), (" @ ", ".")])
    return f"{name}{at}{host}{''.join(dot + e for e in end.split('.'))}"


def _some_ip(rng: random.Random) -> str:
    return rng.choice([".", ".", ".", " . ", "[.]", " dot "]).join(str(rng.randrange(256)) for _ in range(4))


def _some_card(rng: random.Random) -> str:
    n = rng.choice([16, 16, 16, 15, 13, 19])
    body = rng.choice("3456") + _pick(rng, n - 2)
    digits = next(body + d for d in "0123456789" if luhn(body + d))
    between = rng.choice(["", " ", "-", ".", "/", "  "])
    return between.join(digits[k : k + 4] for k in range(0, n, 4))


def _some_phone(rng: random.Random) -> str:
    a, b, c = _pick(rng, 3, "23456789"), _pick(rng, 3), _pick(rng, 4)
    country = rng.choice(["1", "33", "34", "49", "44"])
    return rng.choice(
        [f"+{country} ({a}) {b}-{c}", f"+{country} {a} {b} {c}", f"+{country}{a}{b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}",
         f"00{country} {a} {b}{c}", f"0{a}/{b}{c}", f"tel. 0{a} {b} {c}"]
    )


def _some_other(rng: random.Random) -> str:
    """Strings of digits and signs that are nobody's data."""
    n = _pick(rng, 1, "123456789") + _pick(rng, rng.randrange(1, 12))
    return rng.choice(
        [n, f"{n}.", f"{n[:4]}-0{rng.randrange(1, 10)}-{rng.randrange(10, 29)}", f"{rng.randrange(10, 24)}:{rng.randrange(10, 60)}:{rng.randrange(10, 60)}",
         f"{n[:3]},{_pick(rng, 3)}.{_pick(rng, 2)}", f"v{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(20)}", f"# {n[:2]}", f"{n[:2]} %",
         f'"{_pick(rng, 24, "0123456789abcdef")}"', f"({n[:2]})", f"{n[:3]} at {n[:2]} dot", f"@{rng.choice(_NAMES)}", f"https://{rng.choice(_HOSTS)}.{rng.choice(_ENDINGS)}/{n[:3]}",
         f"{n[:2]} {n[:3]} {n[:1]}", f"{n[:1]}.{n[:1]}.{n[:2]}", f"{_pick(rng, 4)} {_pick(rng, 4)}"]
    )


MAKERS = (_some_email, _some_ip, _some_card, _some_phone)


def labelled_windows(texts: list[str], n: int, chars: int, seed: int) -> tuple[list[str], list[list[Span]]]:
    """``n`` windows of ``chars`` characters and their spans.

    A window is a piece of a text with its base spans as labels; in two of three a written form of personal
    data, and in some a string like one, is put in.
    """
    rng = random.Random(seed)
    carriers = [t for t in texts if t.strip()] or ["".join(rng.choice("etaoin shrdlu,.\n") for _ in range(4 * chars)) for _ in range(20)]
    windows, labels = [], []
    while len(windows) < n:
        text = rng.choice(carriers)
        low = rng.randrange(max(1, len(text) - chars))
        text, spans = text[low : low + 2 * chars].ljust(2 * chars), []
        kind = len(windows) % 6
        if kind < len(MAKERS) or kind == 4:
            made = MAKERS[kind](rng) if kind < len(MAKERS) else _some_other(rng)
            at = text.find(" ", rng.randrange(chars - min(len(made), chars - 4)))
            at = at if 0 <= at < chars - 4 else 0
            text = f"{text[:at]} {made}{rng.choice([' ', ' ', ', ', '. ', chr(10), '*** '])}{text[at:]}"
            if kind < len(MAKERS):
                lead = len("tel. ") if made.startswith("tel. ") else 0
                spans.append((kind, at + 1 + lead, at + 1 + len(made)))
        text = text[:chars]
        known = [s for s in base_spans(text) if not any(s[1] < b and a < s[2] for _, a, b in spans)]
        windows.append(text)
        labels.append([(k, a, min(b, chars)) for k, a, b in spans + known if a < chars])
    return windows, labels


def train_model(texts: list[str], windows: int = TRAIN_WINDOWS, chars: int = TRAIN_CHARS, epochs: int = EPOCHS, seed: int = SEED) -> crf.Model:
    """A model of the tags none and the four kinds, fitted to labelled windows made from ``texts``."""
    made, labels = labelled_windows(texts, windows, chars, seed)
    x = np.stack([crf.inputs(w) for w in made])
    y = np.zeros(x.shape, np.int64)
    for row, spans in zip(y, labels):
        for kind, a, b in spans:
            row[a:b] = kind + 1
    return crf.train(x, y, len(KINDS) + 1, epochs, seed)


_AT = r"(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?|\sat\s)"
_DOT = r"(?:\.|\s?[\[(]\s?(?:dot|\.)\s?[\])]\s?|\sdot\s)"
#: Written forms that a span of the model is cut to, by kind.
FORMS = (
    re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}"),
    re.compile(r"[0-9]{1,3}(?:(?:\s?\.\s?|\s?[\[(]\.[\])]\s?|\sdot\s)[0-9]{1,3}){3}"),
    re.compile(r"[0-9](?:[\x20./-]{0,2}[0-9]){12,18}"),
    re.compile(r"[+(]?[0-9][\x20().+/0-9-]{7,20}[0-9]"),
)


def fitted(kind: int, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The part of a span of the model that has the form of its kind; None if no part has."""
    found = FORMS[kind].search(text, start, end)
    if not found:
        return None
    a, b = found.span()
    beside = text[a - 1 : a] + text[b : b + 1] if a else text[b : b + 1]
    if any(c.isascii() and c.isalnum() for c in beside):
        return None
    digits = "".join(_DIGITS.findall(found[0]))
    good = (
        kind == 0
        or kind == 1 and all(map(_octet, _DIGITS.findall(found[0])))
        or kind == 2 and _card(digits)
        or kind == 3 and 9 <= len(digits) <= 15 and len(digits) < b - a
    )
    return (a, b) if good else None


def _window_spans(model: crf.Model, batch: list[np.ndarray]) -> list[list[tuple[int, int, int, float]]]:
    """(kind, start, end, gain over no span) of the best path of each window."""
    lengths = np.array([len(w) for w in batch])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    x = np.zeros((int(lengths[0]), len(batch)), np.uint8)
    for k, at in enumerate(order):
        x[: lengths[k], k] = batch[at]
    scores = crf.emissions(model, x, lengths)
    found: list[list[tuple[int, int, int, float]]] = [[] for _ in batch]
    trans = model.transitions
    loud = np.flatnonzero(~crf.quiet(scores, trans, lengths))
    for k, path in zip(loud.tolist(), crf.viterbi(scores[:, :, loud], trans, lengths[loud]) if len(loud) else []):
        own = scores[: lengths[k], :, k]
        edges = np.flatnonzero(np.diff(path, prepend=0, append=0))
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            tag = int(path[a])
            if tag:
                gain = float((own[a:b, tag] - own[a:b, 0]).sum() + (b - a - 1) * (trans[tag, tag] - trans[0, 0]) + trans[0, tag] + trans[tag, 0] - 2 * trans[0, 0])
                found[order[k]].append((tag - 1, a, b, gain))
    return found


def reconciled(candidates: list[tuple[int, int, int, float]], fixed: list[Span]) -> list[Span]:
    """The candidates that are kept: none that meets a fixed span, and of the rest the disjoint set of greatest total gain.

    Chosen over the whole text at once: candidates in order of their ends, each with the best set that ends
    before it begins.  A span cut by the edge of one window competes with its whole from the next.  Equal
    totals go to the set that was found first.
    """
    # Spans of one kind are disjoint, those of two may overlap: of the spans that begin so far, the furthest end.
    taken = sorted((a, b) for _, a, b in fixed)
    starts, reach = [a for a, _ in taken], []
    for _, b in taken:
        reach.append(max(b, reach[-1] if reach else b))
    free = []
    for c in sorted(set(candidates), key=lambda c: (c[2], c[1], c[0], c[3])):
        k = bisect_right(starts, c[2] - 1)
        if not (k and reach[k - 1] > c[1]):
            free.append(c)
    ends, best, picks = [0], [0.0], [None]
    for c in free:
        k = bisect_right(ends, c[1]) - 1
        value = best[k] + c[3]
        if value > best[-1]:
            ends.append(c[2])
            best.append(value)
            picks.append((c, k))
    out, at = [], len(picks) - 1
    while at > 0:
        c, at = picks[at]
        out.append(c[:3])
    return out[::-1]


def _shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


class Scanner:
    """Finds spans in texts; windows of many texts are worked on together."""

    def __init__(self, model: crf.Model, batch_windows: int = BATCH_WINDOWS):
        self.model, self.size = model, batch_windows

    def windows(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(text number, place of the first character, inputs) of the overlapping windows of whole texts."""
        for number, text in enumerate(texts):
            for low in range(0, len(text), SLICE):
                codes = crf.inputs(text[low : low + SLICE + WINDOW - STRIDE])
                last = low + SLICE >= len(text)
                for at in range(0, min(SLICE, len(codes)), STRIDE):
                    if at and last and len(codes) - at <= WINDOW - STRIDE:
                        break  # the window before reaches the end
                    yield number, low + at, codes[at : at + WINDOW]

    def model_spans(self, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
        """Candidates of the model in each text, cut to the form of their kind."""
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]

        def work(held: list[tuple[int, int, np.ndarray]]) -> None:
            for (number, low, _), spans in zip(held, _window_spans(self.model, [h[2] for h in held])):
                for kind, a, b, gain in spans:
                    if part := fitted(kind, texts[number], low + a, low + b):
                        out[number].append((kind, *part, gain))

        held: list[tuple[int, int, np.ndarray]] = []
        for window in self.windows(texts):
            held.append(window)
            if len(held) == self.size:
                work(held)
                held = []
        if held:
            work(held)
        return out

    def spans(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """(base spans, all spans) of each text."""
        out = []
        for text, candidates in zip(texts, self.model_spans(texts)):
            base = base_spans(text)
            out.append((base, base + reconciled(candidates, base)))
        return out


def _scan(model: crf.Model, rows: int = 500):
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(model)
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = scanner.spans(texts)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array([hashlib.sha256(_shown(base).encode()).hexdigest() for base, _ in found], pa.string()),
                 pa.array([_shown(every) for _, every in found], pa.string()), pa.array([len(every) for _, every in found], pa.int64())],
                names=names,
            )

    return run


def sample_texts(docs: DataFrame, n: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[str]:
    """Pieces of at most ``chars`` characters of ``n`` documents, the same for any order and partitioning.

    Documents and the place of the piece are chosen by a hash of the text: the least hashes.  So that tasks
    send few pieces, those among the lowest share of all hashes that holds eight times as many as wanted
    are tried first.
    """
    key = F.xxhash64("text")
    start = F.pmod(F.xxhash64(F.lit(1), "text"), F.greatest(F.length("text") - chars, F.lit(1))) + 1
    some = docs.where(F.length("text") > 0).withColumn("key", key)
    limit = int(-(2.0**63) + 2.0**64 * min(1.0, 8 * n / max(docs.count(), 1)))

    def least(rows: DataFrame) -> list[str]:
        pieces = rows.select("key", F.substring("text", start.cast("int"), F.lit(chars)).alias("piece"))
        return [r.piece for r in pieces.orderBy("key", "piece").limit(n).collect()]

    found = least(some.where(F.col("key") < limit)) if limit < 2**63 else []
    return found if len(found) == n else least(some)


def find_personal_data(docs: DataFrame, model: crf.Model | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans), one row per row of ``docs``.

    The counts and the hash are of the base spans, found by patterns; ``spans`` has all, those that the model
    adds among them.  The model reads every character of every text in overlapping windows; what it finds is
    kept where it does not meet a base span and has the form of its kind.  Without a ``model`` one is fitted
    to at most TRAIN_WINDOWS windows made from SAMPLE_DOCS documents.

    Null text: empty, no spans.  Null doc_id and repeated rows: rows like any other.  A very long text is read
    in slices.  An empty table gives no rows.  Equal gains go to the candidates that end first.
    """
    rows = docs.select("doc_id", "text")
    model = model or train_model(sample_texts(rows))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return rows.mapInArrow(_scan(model), f"doc_id {kind}, {counts}, base_sha256 string, spans string, n_spans bigint")


@query("op12_personal_data")
def op12_personal_data(spark, sf_dir):
    return find_personal_data(table(spark, sf_dir, "documents"))
