"""Tokens, repeated passages, chat, URLs and licences against brute-force versions and round trips."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigilframe.llm import chat, licenses, rans, suffix_dedup, token_counts, token_output, urls
from vigilframe.llm.suffixes import repeated_starts
from vigilframe.llm.tokenize import Encoder

ODD = [" ", "  ", "a", "b c", "\n", "\t", "1", "<|endoftext|>", "'s", "ñ", ".", "\u3000", " \n", "é", "\r\n", "x\x1c", "²", "½ ",
       "don't ", "\x00", "😀", "İ", "word. ", "b,", "c.\n", "Dé", "\x01", "!"]


def odd_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randrange(14))) for _ in range(n)] + [None, "", "word " * 3000]


def whole(encoder, texts):
    return [np.frombuffer(x, dtype="<u2") for x in encoder.whole([t or "" for t in texts])]


@pytest.mark.parametrize("plain", [False, True])
def test_encoder_equals_tokenizer(plain):
    texts, enc = odd_texts(1, 4000), Encoder(plain=plain)
    for lo in range(0, len(texts), 700):
        part = texts[lo : lo + 700]
        ids, lengths = enc.encode(pa.array(part, pa.string()))
        want = whole(enc, part)
        assert lengths.tolist() == [len(w) for w in want] and (ids == np.concatenate(want)).all()
    assert len(enc.encode(pa.array([], pa.string()))[0]) == 0


@pytest.mark.parametrize("n", [0, 1, 31, 33, 16384, 16385, 65536, 65537, 200000])
def test_rans_round_trip(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 50257).astype(np.uint16)
    raw = rans.encode(ids)
    assert (rans.decode(raw) == ids).all()
    if n > 70000:
        step = rans.LANES * rans.CHECK_STEPS
        assert (rans.decode(raw, 3, 2) == ids[3 * step : 5 * step]).all()
        broken = bytearray(raw)
        broken[-1000] ^= 1
        with pytest.raises(ValueError):
            rans.decode(bytes(broken))


DOCS = "doc_id bigint, text string, ids int, segment int, shard int"


def test_token_output_round_trip(spark):
    texts = odd_texts(2, 300)
    rows = [(7 * i % 1000, t, 1, 2, 3) for i, t in enumerate(texts)] + [(None, "null id", 1, 2, 3), (5, "b", 1, 2, 3), (5, "b", 1, 2, 3)]
    want, at, enc = [], 0, Encoder()
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.append(whole(enc, [t])[0], 0).astype("<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    for size in (token_output.SEGMENT_IDS, 400):
        got = token_output.token_digests(spark.createDataFrame(rows, DOCS).repartition(6), segment_ids=size).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_output.token_digests(spark.createDataFrame([], DOCS)).count() == 0


def test_token_counts(spark):
    texts = odd_texts(3, 300)
    rows = [(i, t, 1, 2, 3) for i, t in enumerate(texts)] + [(None, "null id", 1, 2, 3), (5, "b", 1, 2, 3)]
    plain = Encoder(plain=True)
    want = collections.Counter((i, len(w)) for (i, *_), w in zip(rows, whole(plain, [r[1] for r in rows])))
    for block in (token_counts.BLOCK_IDS, 500, 7):
        got = token_counts.count_tokens(spark.createDataFrame(rows, DOCS).repartition(4), block_ids=block).collect()
        assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == want
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS)).count() == 0


def test_scan_of_foreign_files(spark):
    """No separator at the end, separators only, and blocks without any."""
    sep = token_counts.SEPARATOR
    pack = lambda ids: np.array(ids, dtype="<u2").tobytes()
    blocks = [(0, 0, pack([1, 2]), None), (0, 1, pack([3, 4]), None), (0, 2, pack([sep, sep, 5]), None), (0, 3, pack([6]), None), (1, 0, pack([sep]), None), (2, 0, pack([9]), None)]
    got = token_counts.scan_documents(spark.createDataFrame(blocks, token_counts.BLOCKS)).collect()
    assert sorted((r.shard, r.place, r.start, r.n_tokens) for r in got) == [(0, 0, 0, 4), (0, 1, 5, 0), (0, 2, 6, 2), (1, 0, 0, 0), (2, 0, 0, 1)]


def test_repeated_starts():
    rng = random.Random(2)
    for _ in range(400):
        letters = bytes(rng.sample(range(256), rng.choice([1, 2, 3, 5])))
        strings = [bytes(rng.choices(letters, k=rng.randrange(40))) for _ in range(rng.randrange(1, 6))]
        strings += [strings[0] + strings[-1]] * rng.randrange(3)
        n = rng.choice([2, 3, 7, 8, 20])
        counts = collections.Counter(s[i : i + n] for s in strings for i in range(len(s) - n + 1))
        want = [[i for i in range(len(s) - n + 1) if counts[s[i : i + n]] > 1] for s in strings]
        assert [x.tolist() for x in repeated_starts(strings, n)] == want


def brute_repeats(rows, n):
    raws = [(i, (t or "").encode()) for i, t in rows]
    counts = collections.Counter(r[k : k + n] for _, r in raws for k in range(len(r) - n + 1))
    out = []
    for i, r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - n + 1):
            if counts[r[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        left = bytes(x for x, g in zip(r, gone) if not g)
        spans = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n,gram,large", [(20, 8, 20000), (20, 8, 3), (200, 80, 20000)])
def test_repeated_passages(spark, n, gram, large):
    rng = random.Random(n + large)
    shared = ["".join(rng.choices("ab ñ", k=rng.randrange(n // 4, 3 * n))) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [rng.choice(shared) if rng.random() < 0.3 else "".join(rng.choices("abcdefghijklm", k=rng.randrange(2 * n))) for _ in range(rng.randrange(6))]
        rows.append((i, rng.choice(["a", "ab", "xyz"]) * rng.randrange(1, 3 * n) if rng.random() < 0.1 else "".join(parts)))
    rows += [(3, rows[3][1]), (None, rows[5][1]), (None, None), (900, "")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, key int, marks int")
    got = suffix_dedup.remove_repeats(docs.repartition(3), n, gram, large).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=repr) == brute_repeats(rows, n)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_pieces_are_spread_over_the_buckets():
    """Smallest hashes are small numbers; no bucket may have most of them, nor most of what is set aside."""
    rng = random.Random(6)
    common = ["".join(rng.choices("abcdefgh", k=300)) for _ in range(40)]
    texts = ["".join(rng.choices("ijklmnopqrst", k=1500)) + rng.choice(common) for _ in range(400)]
    batches = [pa.RecordBatch.from_pylist([{"key": i, "text": texts[i]} for i in range(k, k + 10)]) for k in range(0, 400, 10)]
    size = collections.Counter()
    for batch in suffix_dedup._dealt(batches, 16, 200, 80, np.zeros(0, np.uint64)):
        for r in batch.to_pylist():
            size[r["kind"], r["bucket"]] += len(r["data"])
    for kind, most in ((0, 1.5), (1, 5)):
        found = [n for (k, _), n in size.items() if k == kind]
        assert len(found) > 8 and max(found) < most * sum(found) / 16


def test_a_passage_in_a_third_of_all_texts(spark, monkeypatch):
    """Its pieces differ in every text over its edges; they are spread over all buckets, known as hot or not."""
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefgh", k=150))
    rows = []
    for i in range(240):
        own = lambda: "".join(rng.choices("ijklmnopqrst", k=rng.randrange(5, 60)))  # noqa: B023, E731
        rows.append((i, own() + passage[rng.randrange(3) :] + own() if i % 3 == 0 else own() + own()))
    rows += [(500 + i, passage) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    texts = docs.where(F.octet_length("text") >= 20)
    hot = suffix_dedup._hot_hashes(texts, texts.count(), 20, 8)
    once = np.concatenate([suffix_dedup.pieces(t.encode(), 20, 8) for _, t in rows])
    often = np.isin(once["h"], hot)
    assert len(hot) and often.any() and not often.all()
    buckets = lambda known: {
        r["bucket"]
        for b in suffix_dedup._dealt([pa.RecordBatch.from_pylist([{"key": i, "text": t} for i, t in rows])], 64, 20, 8, known)
        for r in b.to_pylist() if r["kind"] == 0 and np.isin(np.frombuffer(r["data"], suffix_dedup._ROW)["h"], hot).any()
    }
    assert len(buckets(hot)) > 2 * len(buckets(hot[:0]))
    want = brute_repeats(rows, 20)
    for limit in (suffix_dedup.HOT_LIST, 1):
        monkeypatch.setattr(suffix_dedup, "HOT_LIST", limit)
        got = suffix_dedup.remove_repeats(docs, 20, 8).collect()
        assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], key=repr) == want


def test_chat_round_trip(spark):
    rng = random.Random(3)
    pieces = ["\\", "<", "|", "[", "INST]", "/s>", "\n", "a ", "im_end|>\n", "<<SYS>>", "😀", "$1", "\\\n", *chat.CONTROL]
    roles = ["system", "user", "assistant", "to\nol", "a\\b", None, ""]
    rows = [
        (c, t, rng.choice(roles), rng.choice([None, "".join(rng.choices(pieces, k=rng.randrange(30)))]), "w", 1)
        for c in [None, *range(6)] for t in [None, *range(rng.randrange(1, 300))]
    ]
    rows += [(8, k, "system" if k == 0 else ("user", "assistant")[k % 2], f"turn {k} " * 4, "w", 1) for k in range(200)]
    rows += [(9, 4, "assistant", "same", "w", 1)] * 3
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, window string, size int")
    windows = chat.chat_windows(df, 60, 25)
    by = collections.defaultdict(list)
    for c, t, r, x, *_ in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.window_digests(windows).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort(key=lambda x: x[:3])
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        if c in (8, 9) or len({x[:3] for x in turns}) == len(turns):
            text = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
            assert got[c] == (len(turns), sha(text), len(loss), sha(loss))
    assert len(got) == len(by)
    eight = windows.where("conv_id = 8").orderBy("window").collect()
    assert len(eight) > 5 and all(w.text.startswith("<|im_start|>system\n") for w in eight)
    assert all(w.n_repeated > 1 and w.n_tokens <= 60 + 25 + 10 for w in eight[1:])
    for w in eight:
        assert all("turn" in w.text[s.begin : s.end] and "<|im_" not in w.text[s.begin : s.end] for s in w.loss)
    assert chat.window_digests(chat.chat_windows(df.limit(0))).count() == 0


def test_urls(spark):
    odd = [None, "", "x", "HTTP://WWW.Example.COM/en/a?b#c", "a://b.com", "a://com/en/", "a://notexample.com/en/", "a://x.www.example.com/en/1\n2",
           "a://net/es/?x", "a://Ü.NET/fr/x", "a://?q", "a://#", "://com/", "a://example.com/en", "a://b/c://d"]
    rng = random.Random(1)
    bad = ["casino", "pills", "spam", "bets", "porn"]
    made = []
    for k in range(1500):
        host = f"{rng.choice(bad)}-{rng.choice('abc')}" if k % 5 == 0 else "".join(rng.choices("aeiourstn", k=8))
        made.append(f"https://{host}.example.org/{rng.choice(['en', 'de'])}/{rng.randrange(9999)}")
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(odd + made + made[:3])], "page_id bigint, url string, host int, rule int")
    out = urls.filter_urls(pages, urls.rule_table(spark), urls.labelled_sample(pages, 400)).collect()
    assert len(out) == len(odd) + len(made) + 3
    right = 0
    for r in sorted(out, key=lambda r: r.page_id):
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        if fits:
            assert r.verdict == max(fits)[2]
        elif r.page_id >= len(odd):
            right += r.verdict == ("block" if any(w in host for w in bad) else "allow")
    assert right >= 0.99 * (len(made) + 3)  # mostly URLs that the classifier has not seen
    assert urls.filter_urls(pages.limit(0), urls.rule_table(spark), urls.labelled_sample(pages.limit(0))).count() == 0
    none = spark.createDataFrame([], "url string, label int")
    assert {r.verdict for r in urls.filter_urls(pages.where("page_id = 0"), urls.rule_table(spark), none).collect()} == {"allow"}


def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "GNU General Public License version 3, this work is licensed under the"
    rng = random.Random(5)
    rows = [("/a/LICENSE", mit), ("/a/b/LICENSE.txt", f"words\n{gpl}"), ("/a/b/c/x.py", "code"), ("/a/y.py", "code"), ("/z/q.py", f"# {mit.upper()}\ncode"),
            ("/z/r.py", None), ("/a/b/own.py", "Licensed under CC BY-NC 4.0."), ("/a/b/own.py", ""), (None, mit), ("top", "x"), ("/ab/s.py", "license license the")]
    rows += [(f"/n/{k}", " ".join(rng.choices(["the", "of", "work", "code", "file", "public"], k=12))) for k in range(80)]
    files = spark.createDataFrame([(p, t, 1, "x") for p, t in rows], "path string, text string, unit int, license string")
    got = {r.path: (r.license, r.origin) for r in licenses.scan_licenses(files, licenses.template_table(spark)).collect()}
    assert got["/a/LICENSE"] == ("MIT", "own") and got["/a/b/LICENSE.txt"] == ("GPL-3.0", "own")
    assert got["/a/b/c/x.py"] == ("GPL-3.0", "directory") and got["/a/y.py"] == ("MIT", "directory")
    assert got["/z/q.py"] == ("MIT", "own") and got["/z/r.py"] == (None, None) and got["/a/b/own.py"] == ("CC-BY-NC-4.0", "own")
    assert got["top"] == (None, None) and got["/ab/s.py"] == (None, None) and len(got) == len({p for p, _ in rows if p})

    def words(s):
        return set(re.findall(r"[^\W_]+(?:\.\d+)*", s.lower()))

    known = set().union(*[words(t) for _, t in licenses.TEMPLATES])
    units = [(p, words(u)) for p, x in rows if p for u in [*(x or "").split("\n"), *([x] if re.search("LICENSE", p) else [])] if words(u)]
    df = collections.Counter(w for _, u in units for w in u & known)
    idf = lambda w: math.log((len(units) + 1) / ((df[w] if w in known else 0) + 1)) + 1
    norm = lambda s: math.sqrt(sum(idf(w) ** 2 for w in s))
    best = collections.defaultdict(float)
    for p, u in units:
        for _, t in licenses.TEMPLATES:
            best[p] = max(best[p], sum(idf(w) ** 2 for w in u & words(t)) / norm(u) / norm(words(t)))
    found = {r.path: r.cosine for r in licenses.license_matches(files.where("path IS NOT NULL"), licenses.template_table(spark)).collect()}
    assert found.keys() == {p for p, c in best.items() if c >= licenses.MIN_COSINE}
    assert all(abs(best[p] - c) < 1e-6 for p, c in found.items())
    assert licenses.scan_licenses(files.limit(0), licenses.template_table(spark)).count() == 0


def test_wrapped_headers_and_whole_licences(spark):
    mit, gpl = [max((t for n, t in licenses.TEMPLATES if n == name), key=len) for name in ("MIT", "GPL-3.0")]
    short = "Licensed under CC BY-NC 4.0."
    wrap = lambda t, n, mark="": "\n".join(mark + " ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    rng = random.Random(3)
    other = ["\n".join(" ".join(f"q{rng.randrange(500)}" for _ in range(9)) for _ in range(6)) for _ in range(40)]
    rows = [("/p/1", wrap(gpl, 7, "# ") + "\n" + other[0]), ("/p/2", other[1] + "\n\n" + wrap(gpl, 9, " * ") + "\n\n" + other[2]),
            ("/q/3", wrap(mit, 11)), ("/q/r/4", other[3]), ("/r/5", other[4] + "\n" + wrap(short, 2)), ("/r/6", other[5])]
    rows[2] = ("/q/3", rows[2][1].replace("\nassociated", "\n\nassociated"))
    rows += [(f"/n/{k}", x) for k, x in enumerate(other[6:])]
    files = spark.createDataFrame(rows, "path string, text string")
    found = {r.path: (r.license, r.most) for r in licenses.license_matches(files, licenses.template_table(spark)).collect()}
    assert found == {"/p/1": ("GPL-3.0", True), "/p/2": ("GPL-3.0", False), "/q/3": ("MIT", True), "/r/5": ("CC-BY-NC-4.0", False)}


def test_licence_files_are_chosen_by_content(spark, tmp_path):
    mit = "\n".join(max((t for n, t in licenses.TEMPLATES if n == "MIT"), key=len).split(". "))
    filler = "\n".join(f"zq{k} zr{k}" for k in range(9))
    rows = [(13, mit, "a"), (14, filler, "a"), (20, filler + "\nReleased under the MIT License.", "b"), (21, filler, "b"), (None, filler, "b")]
    docs = spark.createDataFrame([(i, x, "en", s) for i, x, s in rows], "doc_id bigint, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.license, r.origin) for r in licenses.op6_license_scan(spark, str(tmp_path)).collect()}
    assert got == {13: ("MIT", "own"), 14: ("MIT", "directory"), 20: ("MIT", "own"), 21: (None, None), None: (None, None)}
