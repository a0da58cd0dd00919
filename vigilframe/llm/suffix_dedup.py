"""Removal of byte passages that occur more than once in the corpus, by suffix arrays of candidate regions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilframe.llm.common import query, small_batches, stage, table
from vigilframe.llm.shingles import _powers, mix
from vigilframe.llm.suffixes import repeated_starts

#: A string of LENGTH bytes that begins in two places is a repeat.
LENGTH = 200
#: Candidates are told by the smallest hash of GRAM bytes within a string.
GRAM = 80
BUCKET_BYTES = 8_000_000
REGION_BYTES = 2_000_000
#: From so many regions with the same smallest hash on, their strings are counted one by one instead.
LARGE_GROUP = 20_000
#: Hashes with so many different pieces in about so many sampled texts are spread over all buckets; so many at most.
HOT_PIECES, SAMPLE_TEXTS, HOT_LIST = 8, 5_000, 10_000
_BYTE = np.random.default_rng(20240411).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0xD6E8FEB86659FD93 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_ROW = np.dtype([("h", "<u8"), ("g", "<u8"), ("key", "<i8"), ("at", "<u4"), ("n", "<u2"), ("flag", "<u2")])
TWICE, TIED = 1, 2  # flags: seen twice already; may hold equal strings itself


def _window_min(a: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    n, step, m = len(a) - width + 1, 1, a
    while step * 2 <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return np.minimum(m[:n], m[width - step : width - step + n])


def pieces(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The strings of ``length`` bytes of a text as rows (h, g, at, n, flag): n of them, from ``at`` on.

    ``h`` is the smallest hash of ``gram`` bytes within each of them, so equal strings always have equal h,
    and ``g`` is the hash of all bytes that they cover.
    """
    size, width = len(raw), length - gram + 1
    if size < length:
        return np.zeros(0, dtype=_ROW)
    prefix = np.zeros(size + 1, dtype=np.uint64)
    np.cumsum(_BYTE[np.frombuffer(raw, dtype=np.uint8)] * _powers(_BASE, size), out=prefix[1:])
    back = _powers(_INVERSE, size)
    v = mix((prefix[gram:] - prefix[:-gram]) * back[: size - gram + 1])
    least = _window_min(v, width)
    new = np.ones(len(least), dtype=bool)
    new[1:] = least[1:] != least[:-1]
    begin = np.flatnonzero(new)
    # Runs longer than the width come from periodic text; where they are cut does not matter.
    run = np.diff(np.append(begin, len(least)))
    if run.max() > width:
        more = -(-run // width)
        k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
        begin = np.repeat(begin, more) + k * width
    n = np.diff(np.append(begin, len(least)))
    out = np.zeros(len(begin), dtype=_ROW)
    out["h"], out["at"], out["n"] = least[begin], begin, n
    out["g"] = mix((prefix[begin + n - 1 + length] - prefix[begin]) * back[begin] + n.astype(np.uint64))
    # Where the smallest hash stands twice within reach, a piece may hold equal strings itself.
    zeros = np.zeros(width - 1, dtype=np.uint64)
    spots = np.flatnonzero(v == ~_window_min(~np.concatenate([zeros, least, zeros]), width))
    twice = np.flatnonzero((v[spots[1:]] == v[spots[:-1]]) & (np.diff(spots) <= width))
    if len(twice):
        low = np.maximum(spots[twice + 1] - width, 0)
        high = np.minimum(spots[twice] + 1, len(least) - 1)
        marks = np.zeros(len(begin) + 1, dtype=np.int64)
        np.add.at(marks, np.searchsorted(begin, low, side="right") - 1, 1)
        np.add.at(marks, np.searchsorted(begin, high, side="right"), -1)
        out["flag"] = np.where(np.cumsum(marks)[:-1] > 0, TIED, 0)
    return out


def _hashes(batches, length: int, gram: int):
    """(h, g) of the pieces of each text."""
    for batch in batches:
        found = [pieces(text.as_py().encode(), length, gram) for text in batch.column(0)]
        rows = np.unique(np.concatenate([r[["h", "g"]] for r in found]) if found else np.zeros(0, _ROW)[["h", "g"]])
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[c]).view(np.int64)) for c in ("h", "g")], ["h", "g"])


def _hot_hashes(texts: DataFrame, n_texts: int, length: int, gram: int) -> np.ndarray:
    """Smallest hashes that very many different pieces share, as seen in a sample of the texts.

    Passages of many documents have them: the pieces over an edge of the passage differ in each.  They only
    decide in which task pieces meet; the result is the same with any list.
    """
    sample = texts.sample(min(1.0, SAMPLE_TEXTS / max(n_texts, 1)), seed=1).select("text")
    found = sample.mapInArrow(lambda batches: _hashes(batches, length, gram), "h bigint, g bigint").distinct()
    counts = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_PIECES)
    return np.array([r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(HOT_LIST).collect()], np.int64).view(np.uint64)


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash.  They are mixed before: the smallest of many hashes has its upper bits clear."""
    return ((mix(x) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _dealt(batches, buckets: int, length: int, gram: int, hot: np.ndarray):
    """Pieces of a batch of texts, packed for each bucket; of equal pieces one goes on, marked as seen twice.

    The bucket is that of h; with ``hot`` hashes, that of h and g, so only equal pieces meet.  Texts that come again within a batch are not looked at again: all their pieces are seen twice.
    """
    for batch in batches:
        rows, copies = [], set()
        seen: dict[int, int] = {}
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            seen[key] = seen.get(key, 0) + 1
            if seen[key] == 1:
                found = pieces(text.as_py().encode(), length, gram)
                found["key"] = key
                rows.append(found)
        copies = np.array([k for k, n in seen.items() if n > 1], dtype=np.int64)
        rows = np.concatenate(rows) if rows else np.zeros(0, _ROW)
        rows["flag"] |= np.where(np.isin(rows["key"], copies), TWICE, 0).astype(np.uint16)
        rows, local = _pick(rows)
        meet = rows["h"].copy()
        if len(hot):
            often = np.isin(meet, hot)
            meet[often] ^= rows["g"][often]
        bucket = _bucket(meet, buckets)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        out = [
            {"bucket": k, "kind": 0, "data": rows[cuts[k] : cuts[k + 1]].tobytes()}
            for k in np.flatnonzero(np.diff(cuts)).tolist()
        ]
        if len(local):
            # Nothing more is to meet these: those of a batch stand in one bucket, whichever.
            place = _bucket((local["g"] ^ local["key"].astype(np.uint64)).sum(keepdims=True), buckets)
            out.append({"bucket": int(place[0]), "kind": 1, "data": local.tobytes()})
        yield pa.RecordBatch.from_pylist(out, schema=_PACKED)


_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("data", pa.binary())])


def _pick(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one row of each set of equal pieces, in order of h; the others): pieces that come twice are marked."""
    rows = rows[np.lexsort((rows["key"], rows["g"], rows["h"]))]
    if not len(rows):
        return rows, rows
    new = np.append(True, (rows["h"][1:] != rows["h"][:-1]) | (rows["g"][1:] != rows["g"][:-1]))
    begin = np.flatnonzero(new)
    many = np.diff(np.append(begin, len(rows))) > 1
    flags = np.bitwise_or.reduceat(rows["flag"], begin)
    rows["flag"] = flags[np.cumsum(new) - 1] | np.where(many[np.cumsum(new) - 1], TWICE, 0).astype(np.uint16)
    return rows[new], rows[~new]


COVERED, WANTED, OTHER = 0, 1, 2


def _matched(group: pa.Table, length: int, hot: np.ndarray) -> pa.Table:
    """Marks of a bucket's pieces: (key, kind, h, at, n).  Pieces with a ``hot`` hash are never alone with it.

    COVERED: its bytes, all in repeated strings.  WANTED: some of its strings may be repeats, to be told by
    their bytes.  OTHER: covered, but needed to tell those.
    """
    parts = {0: [np.zeros(0, _ROW)], 1: [np.zeros(0, _ROW)]}
    for kind, data in zip(group.column("kind").to_pylist(), group.column("data")):
        parts[kind].append(np.frombuffer(data.as_buffer(), _ROW))
    rows, rest = _pick(np.concatenate(parts[0]))
    rest = np.concatenate([rest, *parts[1]])
    twice = (rows["flag"] & TWICE) > 0
    begin = np.flatnonzero(np.append(True, rows["h"][1:] != rows["h"][:-1])) if len(rows) else np.zeros(0, int)
    size = np.diff(np.append(begin, len(rows)))
    often = np.isin(rows["h"], hot)
    alone = np.repeat(size == 1, size) & ~often
    tied = (rows["flag"] & TIED) > 0
    wanted = ~twice & (~alone | tied)
    open_ = np.repeat(np.logical_or.reduceat(wanted, begin), size) | often if len(rows) else wanted
    marked = [(COVERED, rows[twice]), (COVERED, rest), (WANTED, rows[wanted]), (OTHER, rows[twice & open_])]
    every = np.concatenate([r for _, r in marked])
    return pa.table(
        {
            "key": pa.array(np.ascontiguousarray(every["key"])),
            "kind": pa.array(np.repeat([k for k, _ in marked], [len(r) for _, r in marked]), pa.int32()),
            "h": pa.array(np.ascontiguousarray(every["h"]).view(np.int64)),
            "at": pa.array(every["at"].astype(np.int64)), "n": pa.array(every["n"].astype(np.int32)),
        }
    )


def _regions(batches, length: int):
    """Bytes of the wanted and other pieces of each text."""
    for batch in batches:
        out = {"key": [], "h": [], "at": [], "wanted": [], "data": []}
        for key, text, marks in zip(*[c.to_pylist() for c in batch.columns]):
            raw = text.encode()
            for m in marks:
                if m["kind"] != COVERED:
                    out["key"].append(key)
                    out["h"].append(m["h"])
                    out["at"].append(m["at"])
                    out["wanted"].append(m["kind"] == WANTED)
                    out["data"].append(raw[m["at"] : m["at"] + m["n"] + length - 1])
        for lo in range(0, len(out["key"]), 5000):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["key"][lo : lo + 5000], pa.int64()), pa.array(out["h"][lo : lo + 5000], pa.int64()),
                    pa.array(out["at"][lo : lo + 5000], pa.int64()), pa.array(out["wanted"][lo : lo + 5000], pa.bool_()),
                    pa.array(out["data"][lo : lo + 5000], pa.binary()),
                ],
                ["key", "h", "at", "wanted", "data"],
            )


def _spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Joined [begin, end) of strings of ``length`` from the ascending ``starts`` on."""
    cut = np.flatnonzero(starts[1:] > starts[:-1] + length)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist()))


def _expanded(group: pa.Table, length: int) -> pa.Table:
    """Repeated spans of the wanted pieces among all pieces of a bin."""
    strings = [d.as_py() for d in group.column("data")]
    keys, begins, ends = [], [], []
    found = repeated_starts(strings, length)
    for key, at, wanted, starts in zip(*[group.column(c).to_pylist() for c in ("key", "at", "wanted")], found):
        if wanted and len(starts):
            for a, b in _spans(starts, length):
                keys.append(key)
                begins.append(at + a)
                ends.append(at + b)
    return pa.table({"key": pa.array(keys, pa.int64()), "a": pa.array(begins, pa.int64()), "b": pa.array(ends, pa.int64())})


def _single_strings(batches, length: int):
    """Every string of the pieces, as two hashes and its place."""
    base = 0xC2B2AE3D27D4EB4F | 1
    inverse = pow(base, -1, 1 << 64)
    for batch in batches:
        for key, at, wanted, data in zip(*[batch.column(c).to_pylist() for c in ("key", "at", "wanted", "data")]):
            raw = np.frombuffer(data, dtype=np.uint8)
            both = []
            for b, i in ((_BASE, _INVERSE), (base, inverse)):
                prefix = np.append(np.uint64(0), np.cumsum(_BYTE[raw] * _powers(b, len(raw)), dtype=np.uint64))
                both.append(mix((prefix[length:] - prefix[:-length]) * _powers(i, len(raw))[: len(raw) - length + 1]))
            n = len(both[0])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(both[0].view(np.int64)), pa.array(both[1].view(np.int64)), pa.array(np.full(n, key)),
                    pa.array(at + np.arange(n)), pa.array(np.full(n, wanted)),
                ],
                ["x", "y", "key", "at", "wanted"],
            )


def _cut_texts(batches):
    """(row, n_bytes, n_removed, n_spans, kept): each text without its spans."""
    for batch in batches:
        removed, spans, kept = [], [], []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw, end, joined = text.encode(), -1, []
            for s in sorted(found, key=lambda s: (s["a"], s["b"])):
                if joined and s["a"] <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], s["b"])
                else:
                    joined.append([s["a"], s["b"]])
            at, left = 0, []
            for a, b in joined:
                left.append(raw[at:a])
                at = b
            left.append(raw[at:])
            kept.append(b"".join(left))
            removed.append(len(raw) - len(kept[-1]))
            spans.append(len(joined))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            ["doc_id", "n_removed", "n_spans", "kept"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, large_group: int = LARGE_GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of ``docs`` (doc_id, text).

    Every byte covered by a string of ``length`` bytes that also begins anywhere else in the corpus, in the
    same document or another, goes; ``kept`` are the remaining bytes (not text: a cut may split a
    character), null where nothing was removed.  A very long text is cut into pieces like any other; its row
    stays one row.  Null doc_id: a row of its own.  An empty table gives no rows; other columns are left out.  Strings do not cross documents.  Null text: empty.  Equal
    texts, repeated rows too, are repeats of each other.

    Steps: the strings of a text are cut into pieces by the smallest hash of ``gram`` bytes within them, which
    equal strings share; pieces that are equal as a whole are covered.  Of the others, those that share
    their smallest hash with any other (or have one that is very frequent in a sample, whose pieces are spread
    over all buckets) are brought together by it, and `repeated_starts` finds their
    repeats with a suffix array.  Groups of ``large_group`` pieces or more are not brought together: their
    strings are counted one by one by two hashes.
    """
    with small_batches(docs.sparkSession):
        return _remove_repeats(docs, length, gram, large_group)


def _remove_repeats(docs: DataFrame, length: int, gram: int, large_group: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("key", F.xxhash64("text"))
    enough = F.octet_length("text") >= length
    total, n_texts = texts.agg(F.sum(F.octet_length("text")), F.count_if(enough)).first()
    buckets = max(8, -(-(int(total or 0) * 32 // 60) // BUCKET_BYTES))
    hot = _hot_hashes(texts.where(enough), n_texts, length, gram)
    marks = stage(
        texts.where(enough).select("key", "text")
        .mapInArrow(lambda batches: _dealt(batches, buckets, length, gram, hot), "bucket int, kind int, data binary")
        .groupBy("bucket")
        .applyInArrow(lambda group: _matched(group, length, hot), "key bigint, kind int, h bigint, at bigint, n int"),
        "repeat-marks",
    )
    # A set, so that a text with very many copies has its marks once.
    by_text = marks.groupBy("key").agg(F.collect_set(F.struct("kind", "h", "at", "n")).alias("marks"))
    touched = stage(texts.join(by_text, "key"), "repeat-texts")
    # Copies of a text have no pieces of their own: the one with the smallest doc_id stands for them.
    open_ = touched.where(F.exists("marks", lambda m: m.kind != COVERED))
    lead = open_.groupBy("key").agg(F.min("doc_id").alias("lead"))
    regions = stage(
        open_.join(lead, "key").where(F.col("doc_id").eqNullSafe(F.col("lead"))).select("key", "text", "marks")
        .mapInArrow(lambda batches: _regions(batches, length), "key bigint, h bigint, at bigint, wanted boolean, data binary"),
        "repeat-regions",
    )
    sizes = regions.groupBy("h").agg(F.count(F.lit(1)).alias("pieces"))
    large = stage(sizes.where(F.col("pieces") >= large_group).select("h"), "large-groups")
    size = regions.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    bins = max(4, -(-int(size) // REGION_BYTES))
    found = (
        regions.join(large, "h", "left_anti").groupBy(F.pmod(F.xxhash64("h"), F.lit(bins)).alias("bin"))
        .applyInArrow(lambda group: _expanded(group, length), "key bigint, a bigint, b bigint")
    )
    if not large.isEmpty():
        strings = stage(
            regions.join(large, "h", "left_semi")
            .mapInArrow(lambda batches: _single_strings(batches, length), "x bigint, y bigint, key bigint, at bigint, wanted boolean")
            .dropDuplicates(["x", "y", "key", "at"]),
            "strings",
        )
        again = strings.groupBy("x", "y").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)
        found = found.union(
            strings.where("wanted").join(again, ["x", "y"]).select("key", F.col("at").alias("a"), (F.col("at") + length).alias("b"))
        )
    spans = found.groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("found"))
    covered = F.transform(
        F.filter("marks", lambda m: m.kind == COVERED),
        lambda m: F.struct(m["at"].alias("a"), (m["at"] + m["n"] + (length - 1)).alias("b")),
    )
    nothing = F.array().cast("array<struct<a:bigint,b:bigint>>")
    cut = stage(
        touched.join(spans, "key", "left")
        .select("doc_id", "text", F.concat(covered, F.coalesce("found", nothing)).alias("spans"))
        .mapInArrow(_cut_texts, "doc_id bigint, n_removed bigint, n_spans bigint, kept binary"),
        "cut-texts",
    )
    zero = F.lit(0).cast("bigint")
    whole = (
        texts.select("doc_id", "key", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("kept_sha256"))
        .join(by_text.select("key"), "key", "left_anti")
        .select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256", F.lit(None).cast("binary").alias("kept"))
    )
    return whole.union(
        cut.select(
            "doc_id", (F.octet_length("kept") + F.col("n_removed")).cast("bigint").alias("n_bytes"), "n_removed", "n_spans",
            F.sha2("kept", 256).alias("kept_sha256"), F.when(F.col("n_removed") > 0, F.col("kept")).alias("kept"),
        )
    )


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
