"""Filtering, joining, decontaminating and mixing documents against brute-force versions."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.llm import decontaminate, jaccard_join, mixing, quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, key string, size string, row int, kept int, hash int, _mix int, node int"


def frame(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, s, "k", "s", 1, 2, 3, 4, 5) for i, t, s in rows], SCHEMA)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def shingles(text):
    ws = WORDS.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not ws:
        return set()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)}


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if shared and 100 * shared >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        smallest[find(k)] = min(i, smallest.get(find(k), i))
    return sorted((i, len(sets[k]), smallest[find(k)]) for k, (i, _) in enumerate(rows))


def family(rng, base, n, changes):
    out = []
    for _ in range(n):
        ws = base.split(" ")
        for _ in range(rng.randrange(changes)):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(ws))
    return out


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(7)
    texts = [prose(rng, rng.randrange(1, 300)) for _ in range(60)]
    passage = prose(rng, 30)
    for size, changes in ((12, 2), (40, 3), (90, 8), (260, 20)):
        texts += family(rng, prose(rng, size), 25, changes)
    texts += [f"{prose(rng, rng.randrange(2, 60))} {passage} {prose(rng, 20)}" for _ in range(60)]
    texts += ["", None, " \t\n", "one", "One", "ONE two", "a b c d", "a b c d", "a\x0bb c\td e", "A B C D E"]
    return [(i + 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("limit", [jaccard_join.REGION_SHINGLES, 400])
def test_jaccard_components(spark, near_rows, limit):
    docs = frame(spark, [(i, t, "s") for i, t in near_rows]).repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link_components(docs, limit).collect())
    assert got == brute_components(near_rows)


def near_sets(rng, families, members, own):
    """Sets of families: 60 hashes common to a family, 12 to all, ``own`` different ones each."""
    draw = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    passage = draw(12)
    return [np.unique(np.concatenate([core, passage, draw(own)])) for core in [draw(60) for _ in range(families)] for _ in range(members)]


def connected(n, links):
    root = list(range(n))
    for i, j in links:
        a, b = root[i], root[j]
        root = [a if r == b else r for r in root]
    return sorted(sorted(k for k in range(n) if root[k] == r) for r in set(root))


def linked(sets):
    held = [set(s.tolist()) for s in sets]
    return [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if 100 * len(held[i] & held[j]) >= 80 * len(held[i] | held[j])]


def test_pivots_meet_only_sets_that_share_rare_hashes(monkeypatch):
    """Families that only common passages bring together are joined each on their own."""
    sets = near_sets(np.random.default_rng(3), 20, 10, 4)
    met, whole = [], jaccard_join.join_around_pivots
    monkeypatch.setattr(jaccard_join, "join_around_pivots", lambda part: met.append(len(part)) or whole(part))
    assert connected(len(sets), jaccard_join.join_region(sets)) == connected(len(sets), linked(sets))
    assert met and max(met) <= 10


def test_large_region_in_few_rounds_that_keep_no_sets(spark, monkeypatch):
    """400 sets that hardly link, in a region above the limit: few rounds of pivots, sets are not written again in each."""
    sets = near_sets(np.random.default_rng(4), 1, 380, 10)
    sets += [x[1:] for x in sets[:20]]
    rows = [(1, i, len(s), s.tobytes()) for i, s in enumerate(sets)]
    frame_ = spark.createDataFrame([(r, i, n, bytearray(h)) for r, i, n, h in rows], "region bigint, node bigint, n bigint, hashes binary")
    written, whole = [], jaccard_join.stage
    monkeypatch.setattr(jaccard_join, "stage", lambda df, name: written.append(("hashes" in df.columns, name)) or whole(df, name))
    links = jaccard_join._cut_large(frame_, 4000).collect()
    assert connected(400, [(r.a, r.b) for r in links]) == connected(400, linked(sets))
    assert sum(holds for holds, _ in written) <= 3 and [name for _, name in written].count("pivots") <= 5


def test_jaccard_repeated_rows_nulls_and_empty(spark):
    rows = [(5, "a b c d e f", "s"), (5, "a b c d e f", "s"), (2, "A b c d e f", "s"), (None, "a b c d e f", "s"), (9, None, "s")]
    got = jaccard_join.link_components(frame(spark, rows)).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=key) == [(2, 2, 2), (5, 2, 2), (5, 2, 2), (9, 0, 9), (None, 2, 2)]
    kept = jaccard_join.keep_one_of_each(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and sorted(r.doc_id for r in kept.collect()) == [2, 9]
    assert jaccard_join.link_components(frame(spark, [])).count() == 0
    assert jaccard_join.keep_one_of_each(frame(spark, [])).count() == 0


def test_jaccard_set_without_id_bridges_others(spark):
    ws = [f"v{k}" for k in range(120)]
    near = lambda n: " ".join(["y" + w if k < n else w for k, w in enumerate(ws)])
    rows = [(8, near(0), "s"), (None, near(9), "s"), (None, near(9), "s"), (6, near(16), "s"), (None, "q r s t u v w", "s"), (7, None, "s")]
    got = {(r.doc_id, r.component_id) for r in jaccard_join.link_components(frame(spark, rows)).collect()}
    assert got == {(8, 6), (None, 6), (6, 6), (None, None), (7, 7)}
    alone = jaccard_join.link_components(frame(spark, [rows[0], rows[3]])).collect()
    assert {(r.doc_id, r.component_id) for r in alone} == {(8, 8), (6, 6)}


def test_spare_counts_are_spread_over_buckets():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    batches = [pa.record_batch([pa.array([prose(rng, 12, 9999) for _ in range(1000)])], ["text"]) for _ in range(4)]
    held, sets = {}, set()
    for out in jaccard_join._dealt(batches, 16):
        for bucket, kind, data in zip(*[out.column(c).to_pylist() for c in range(3)]):
            if kind == 1:
                rows = np.frombuffer(data, jaccard_join._SIGNED)
                held[bucket] = held.get(bucket, 0) + len(rows)
                sets |= set(rows["node"].tolist())
    assert len(sets) == 4000 and len(held) == 16 and max(held.values()) < 2 * sum(held.values()) / 16


def test_region_join_finds_all_components():
    import numpy as np

    rng = random.Random(3)
    for _ in range(150):
        base = [rng.sample(range(300), rng.randrange(1, 40)) for _ in range(2)]
        sets = []
        for _ in range(rng.randrange(2, 12)):
            s = set(rng.choice(base)) | {rng.randrange(600) for _ in range(rng.randrange(5))}
            sets.append(np.array(sorted(s), dtype=np.uint64))
        near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        want = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if near(sets[i], sets[j])]

        def parts(links):
            groups = {i: {i} for i in range(len(sets))}
            for i, j in links:
                joined = groups[i] | groups[j]
                for k in joined:
                    groups[k] = joined
            return groups

        assert parts(want) == parts(jaccard_join.join_region(sets))


def test_decontamination(spark):
    rng = random.Random(1)
    items = [(k, prose(rng, n)) for k, n in enumerate((3, 5, 8, 20, 35, 60))] + [(90, ""), (91, None), (3, "q r s t u v w")]
    docs = [(i, prose(rng, rng.randrange(0, 80)), "s") for i in range(30)]
    for i, (_, text) in enumerate(items):
        docs.append((100 + i, f"{prose(rng, 400)} {(text or '').upper()} {prose(rng, 5)}", "s"))
        docs.append((200 + i, " ".join((text or "").split(" ")[: -2 - i // 2]) + " " + prose(rng, 9), "s"))
    docs += [(300, items[0][1], "s"), (301, None, "s"), (301, items[4][1], "s"), (302, "", "s"), (None, items[3][1], "s")]
    by_id, held = {}, {}
    for i, t, _ in docs:
        by_id.setdefault(i, set()).update(shingles((t or "").lower()))
    for k, t in items:
        held.setdefault((k, len(shingles(t))), set()).update(shingles(t))
    want = {
        (i, k, len(d & s), n) for i, d in by_id.items() for (k, n), s in held.items() if s and 100 * len(d & s) >= 80 * n
    }
    benchmark = spark.createDataFrame([(k, t, 1, 2) for k, t in items], "item_id bigint, text string, hash int, hashes int")
    got = decontaminate.contained_items(frame(spark, docs), benchmark)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 8
    clean = decontaminate.drop_contaminated(frame(spark, docs), benchmark)
    assert clean.columns == frame(spark, docs).columns
    hit = {i for i, *_ in want}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, *_ in docs if i not in hit)
    assert decontaminate.contained_items(frame(spark, []), benchmark).count() == 0
    assert decontaminate.drop_contaminated(frame(spark, docs), benchmark.limit(0)).count() == len(docs)


def test_mix_of_repeated_ids_is_repeatable(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, 30), rng.choice(["a", "b"])) for i in range(60) for _ in range(4)]
    rows = [(i, t, "ab"[i % 2]) for i, t, _ in rows]
    taken = lambda n: sorted((r.doc_id, r.text) for r in mixing.mixed_documents(frame(spark, rows).repartition(n)).collect())
    assert taken(3) == taken(7)
    rng.shuffle(rows)
    assert taken(5) == taken(2)


def test_mixing_reaches_targets_and_is_repeatable(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(0, 60)), rng.choice(["a", "b", "b", "b", "ü", "", None])) for i in range(900)]
    rows += [(7, "same row", "b")] * 3 + [(None, None, "b"), (None, "x y", None), (901, None, "empty only")]
    out = mixing.mix_sources(frame(spark, rows), mixing.cycle_weights()).collect()
    assert len(out) == len(rows)
    total, size, target, taken = 0, {}, {}, {}
    for r in out:
        n = len(WORDS.findall(r.text or ""))
        assert r.size == n and 0 <= r.copies <= 2 and r["key"] == "k" and r["_mix"] == 4
        total += n
        size[r.source] = size.get(r.source, 0) + n
        target[r.source] = r.target
        taken[r.source] = taken.get(r.source, 0) + n * r.copies
    weight = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), itertools.cycle((3, 1, 2))))
    want, live, left = {}, set(size), 1.5 * total
    while True:
        over = [s for s in live if left * weight[s] / sum(weight[x] for x in live) > 2 * size[s]]
        if not over:
            break
        for s in over:
            want[s] = 2.0 * size[s]
            live.discard(s)
        left = 1.5 * total - sum(want.values())
    want.update({s: left * weight[s] / sum(weight[x] for x in live) for s in live})
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 60
    again = mixing.mix_sources(frame(spark, rows).repartition(7), mixing.cycle_weights()).collect()
    count = lambda rs: sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.source or "", r.copies) for r in rs)
    assert count(out) == count(again)
    mixed = mixing.mixed_documents(frame(spark, rows))
    assert mixed.columns == frame(spark, rows).columns and mixed.count() == sum(r.copies for r in out)
    assert mixing.mix_sources(frame(spark, []), mixing.cycle_weights()).count() == 0


def test_mixing_cuts_large_bands_into_slots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOT_ROWS", 20)
    docs = spark.range(3000).selectExpr("id AS doc_id", "'a b c' AS text", "if(id < 2500, 'hot', 'cold') AS source")
    out = mixing.mix_sources(docs, mixing.cycle_weights()).groupBy("source").agg(F.sum("copies"), F.first("target")).collect()
    assert all(abs(3 * r[1] - r[2]) <= 3 for r in out)


def test_mixing_takes_the_same_documents_whatever_the_slots(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.randrange(-10**12, 10**12), "a " * rng.choice([2, 2, 2, 3, 5, 40]), rng.choice("aab")) for _ in range(1500)]
    docs = frame(spark, rows + [(None, "a a", "a"), (None, "a a a", "b")])
    got = []
    for n in (20_000, 50, 7):
        monkeypatch.setattr(mixing, "SLOT_ROWS", n)
        out = mixing.mix_sources(docs, mixing.cycle_weights()).collect()
        got.append(sorted((r.source, r["size"], r.doc_id is None, r.doc_id or 0, r.copies) for r in out))
    assert got[0] == got[1] == got[2] and len(got[0]) == 1502
    for s in "ab":  # in the order of size and doc_id, copies differ from a straight line by less than one
        copies = [r[-1] for r in got[0] if r[0] == s]
        each = sum(copies) / len(copies)
        assert all(abs(sum(copies[:k]) - k * each) < 1.1 for k in range(len(copies)))


def test_quality_rules(spark):
    rng = random.Random(4)
    line = "Subscribe to our  newsletter now"
    rows = [(i, f"{prose(rng, 60, 5000)}\n{prose(rng, 10, 5000)}", "a") for i in range(40)]
    rows += [(100 + i, f"{line}\n{prose(rng, 60, 5000)}\n{line.upper()} ", "a") for i in range(30)]
    rows += [(200 + i, "\n".join([line.lower()] * 10 + [f"own{i} line{i}"]), "a") for i in range(30)]
    copy = prose(rng, 70, 5000)
    rows += [(300, copy, None)] * 40 + [(400 + i, f"{prose(rng, 80, 5000)}", None) for i in range(5)]
    rows += [(500, None, "a"), (501, "", "a"), (502, " \n\t", "b"), (503, "x " * 3000, "b"), (504, "a # $ b\n\n**\na # $ b", None)]
    got = quality.judge_quality(frame(spark, rows)).collect()
    assert len(got) == len(rows)

    def base(text):
        ws = WORDS.findall(text or "")
        grams = {}
        for i in range(len(ws) - 2):
            grams.setdefault(tuple(ws[i : i + 3]), []).append(i)
        again = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
        failed = len(ws) < 50 or 100 * len(again) > 50 * len(ws)
        return len(ws), sum(map(len, ws)), symbols, len(lines) - len(set(lines)), len(again), failed

    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text)
        if r.doc_id < 100 or 300 <= r.doc_id < 500:
            assert r.kept and r.n_boiler_words == 0  # copies of a text are no boilerplate
        elif r.doc_id < 200:
            assert r.kept and r.n_boiler_words == 10
        else:
            assert not r.kept
    few = [(200 + i, f"{line}\n" * 14 + f"{prose(rng, 12, 5000)}", "a") for i in range(30)]
    judged = quality.judge_quality(frame(spark, rows[:40] + few)).where("doc_id >= 200").collect()
    assert all(r.n_boiler_words == 70 and not r.kept for r in judged)
    kept = quality.keep_good(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(r.kept for r in got)
    assert quality.judge_quality(frame(spark, [])).count() == 0


def test_kept_documents_lose_boilerplate_lines(spark):
    rng = random.Random(6)
    line = "Subscribe to our  newsletter now"
    own = [prose(rng, 60, 5000) for _ in range(30)]
    rows = [(i, f"{line}\n\n{x}\r\n {line.upper()}\nend {i}", "a", 9) for i, x in enumerate(own)]
    rows += [(100, f"{line}\n{own[0]}", "b", 9), (101, f" {own[1]}\n\n", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, Text string, source string, n_chars int")
    got = quality.keep_good(docs)
    assert got.dtypes == docs.dtypes
    want = [(i, f"\n{x}\r\nend {i}", "a", len(x) + 7 + len(str(i))) for i, x in enumerate(own)] + rows[-2:]
    assert sorted(map(tuple, got.collect())) == want


def test_pipeline_equals_brute_force(spark, tmp_path):
    """The pipeline over a small fixture; the mix and the codec are checked by their own tests."""
    import zlib

    import corpus_pipeline
    from vigilframe.llm.tokenize import Encoder

    rng = random.Random(9)
    item = prose(rng, 30, 5000)
    rows = [(i, prose(rng, rng.randrange(55, 120), 5000), rng.choice("ab")) for i in range(60)]
    rows += [(100 + i, t, "a") for i, t in enumerate(family(rng, prose(rng, 200, 5000), 8, 3))]
    rows += [(200, f"{prose(rng, 60, 5000)} {item}", "a"), (201, "too short", "b"), (202, None, "a"), (203, "w " * 200, "b")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    roots = {i for i, _, c in brute_components([(i, t) for i, t, _ in rows if i != 202]) if i == c}
    want = {i: t for i, t, _ in rows if i in roots and i < 200}
    out = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    enc, at = Encoder(), 0
    for r in out:
        ids = enc.whole([want[r.doc_id]])[0] + b"\0\0"
        wide = b"".join(ids[k : k + 2] + b"\0\0" for k in range(0, len(ids), 2))
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) // 2, zlib.crc32(wide))
        at += r.n_tokens
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in out)
    assert {r.doc_id for r in out} <= set(want) and len({r.doc_id for r in out}) > 0.6 * len(want)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES]
