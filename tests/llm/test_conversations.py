"""Prefix trie and structure repair of conversations against brute-force versions."""

import collections
import hashlib
import heapq
import heapq
import random
import re
import zlib

import pytest

from vigilframe.llm import prefix_trie as trie, repair
from vigilframe.llm.sequence import digest_ids, numbered

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, pos int, depth int, x1 string, shard int, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, 4) for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, role, sha(f"{len(role)}:{role}{text}")), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    members = collections.defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = collections.defaultdict(list)
    for v in members:
        if v:
            children[v[:-1]].append(v)
    totals = {}
    for v in sorted(members, key=len, reverse=True):
        saved = (len(members[v]) - 1) * len(WORDS.findall(v[-1][1])) if v else 0
        totals[v] = (sum(totals[x][0] for x in children[v]) or 1, saved + sum(totals[x][1] for x in children[v]))
    return sorted(
        (
            min(m), len(v), min(members[v[:-1]]) if v else -1, len(m), len(children[v]), *totals[v],
            sha(",".join(map(str, sorted(c for c in m if built[c] == v)))),
        )
        for v, m in members.items()
    )


def trie_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c * rng.choice([1, 1, 3]), t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "", "d  e f"])))
    return rows


def collected(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


@pytest.mark.parametrize("shard_convs, band, queue", [(1000, 4096, 200_000), (2, 3, 1), (0, 2, 3)])
def test_trie(spark, shard_convs, band, queue):
    rows = trie_rows(shard_convs, 70)
    rows += [(c, t, "user", "same") for c in range(200, 260) for t in range(12)]  # a large group of copies
    rows += [(300, t, "user", f"w{t} x") for t in range(40)] + [(301, t, "user", f"w{t} x") for t in range(40)]
    rows += [(7, None, None, None), (7, None, "user", "q"), (7, 1, "user", "q"), (7, 1, "user", "q"), (None, 1, "user", "q")]
    got = trie.prefix_trie(frame(spark, rows), shard_convs, band, queue)
    assert collected(got) == brute_trie(rows)


def test_trie_splits_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    rows = [(c, t, "user", f"w{t % 5} v") for c in (1, 2, 3, 20) for t in range(90 - c)] + trie_rows(5, 30)
    assert collected(trie.prefix_trie(frame(spark, rows), 2, 5, 4)) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie.prefix_trie(frame(spark, [])).count() == 0
    assert trie.prefix_trie(frame(spark, [(None, 1, "user", "a")])).count() == 0
    only = [(1, 0, "user", "a b")]  # no base conversation: its opening turns are gone
    assert collected(trie.prefix_trie(frame(spark, only))) == brute_trie(only)


def test_message_queue_spills_and_merges():
    rng = random.Random(3)
    sent = [(rng.randrange(6), rng.randrange(3), 0, 1, rng.randrange(9)) for _ in range(500)]
    queue = trie.MessageQueue(7)
    for m in sent:
        queue.push(m)
    assert len(queue.heap) <= 7 and queue.runs
    for key in sorted({m[:3] for m in sent}):
        assert queue.take(key) == (sum(m[3] for m in sent if m[:3] == key), sum(m[4] for m in sent if m[:3] == key))
    assert queue.take((9, 9, 9)) == (0, 0) and not queue.heap and not queue.runs


def test_numbered_splits_groups(spark):
    rows = [(g, t) for g in (None, 1, 2) for t in range(500 if g == 1 else 3)]
    df = spark.createDataFrame(rows, "g bigint, t bigint").repartition(5)
    got = numbered(df, "g", ["t"])
    assert sorted((r.g or 0, r.t, r.pos) for r in got.collect()) == sorted((g or 0, t, t) for g, t in rows)
    ids = spark.createDataFrame([(k, i) for k in (1, 2) for i in range(3000 if k == 1 else 2)], "k bigint, i bigint").repartition(7)
    digests = {r.k: r.sha256 for r in digest_ids(ids, ["k"], "i", most=64).collect()}
    assert digests == {1: sha(",".join(map(str, range(3000)))), 2: sha("0,1")}


def damage(rows):
    out = collections.defaultdict(list)
    for c, turn, role, text in rows:
        out[c] += []
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        row = (turn is not None, turn or 0, "user" if code == 4 else role, text)
        out[c] += [row] * (0 if code == 0 else 2 if code == 3 else 1)
    key = lambda r: (*r[:3], sha(f"{len(r[2])}:{r[2]}{r[3]}"))
    return {c: sorted(v, key=key) for c, v in out.items()}


def brute_repair(turns):
    """Dijkstra over (row, state) with (cost, audit, repaired) as distance."""
    faults, seen = [], set()
    for _, _, role, text in turns:
        found = WORDS.findall(text)
        faults.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1][-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", [])], set()
    while True:
        cost, audit, i, state, made = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns) and state in ("", "a"):
            break
        next_role = "assistant" if state == "u" else "user"
        heapq.heappush(heap, (cost + 3, audit + "I", i, next_role[0], [*made, f"{next_role}:"]))
        if i == len(turns):
            continue
        _, _, role, text = turns[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, made))
        if faults[i] not in ("blank", "duplicate"):
            stay = cost + 3 * (faults[i] == "truncated")
            heapq.heappush(heap, (stay + 3, audit + "R", i + 1, next_role[0], [*made, f"{next_role}:{text}"]))
            if role[:1] == next_role[0] or role[:1] == "s" and state == "":
                heapq.heappush(heap, (stay, audit + "K", i + 1, role[0], [*made, f"{role}:{text}"]))
    numbers = [t for known, t, _, _ in turns if known]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, sha("\n".join(made)))


def repair_rows(seed, n, long=0):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "u", "ass", None]
    texts = ["a.", "b", "c?", " ", "", "d! ", "e\n", "f.g", None, "ü.", " "]
    rows = []
    for c in range(n):
        for t in range(long or rng.randrange(9)):
            rows.append((c, rng.choice([t, t, t, 2 * t, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"t{rng.randrange(99)}."))
    return rows


def checked_repair(spark, rows):
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_damaged(frame(spark, rows)).collect()}
    want = {c: brute_repair(v) for c, v in damage(rows).items()}
    assert got == want


def test_repair(spark):
    rows = repair_rows(1, 150) + [(400, t, r, f"{t}.") for t in range(30) for r in ("user",)]
    rows += [(500, 1, "user", "same.")] * 50 + [(None, 1, "user", "x."), (None, None, None, None), (-3, None, "user", "y")]
    checked_repair(spark, rows)


def test_repair_splits_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(repair, "CHUNK_ROWS", 5)
    rows = repair_rows(2, 4, long=150) + [(9, t, "assistant", f"{t}") for t in range(200)]
    checked_repair(spark, rows + [(8, t, ("user", "assistant")[t % 2], f"{t}." * 9) for t in range(300)])


def test_repair_of_nothing(spark):
    assert repair.repair_damaged(frame(spark, [])).count() == 0
    dropped = next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    checked_repair(spark, [(dropped, 0, "user", "a.")])


def test_search_is_exact_and_bounded():
    rng = random.Random(4)
    shapes = ["u", "a", "s", "t", ""]
    for k in range(60):
        rows = [(rng.random() < 0.2, rng.choice([1, 1, 1, 3]), rng.choice(shapes[: 2 + k % 4]), rng.random() < 0.5) for _ in range(k % 12)]
        for start in repair.STATES:
            best, _ = repair.cheapest_edits(rows, start)
            nodes = {start: (0, "")}
            for doomed, n, initial, cut in rows:
                nodes = inserted(nodes)
                after = {}
                for s, (cost, audit) in nodes.items():
                    tail = "D" * (n - 1)
                    moves = [(s, cost + 4 * n, audit + "D" + tail)]
                    if not doomed:
                        stay = cost + 3 * cut + 4 * (n - 1)
                        moves.append((repair.FITTING[s][0], stay + 3, audit + "R" + tail))
                        if initial in repair.TAKES[s]:
                            moves.append((repair.TAKES[s][initial], stay, audit + "K" + tail))
                    for to, c, a in moves:
                        after[to] = min(after.get(to, (10**9, "")), (c, a))
                nodes = after
            nodes = inserted(nodes)
            assert [nodes.get(s) for s in repair.STATES] == best
    for initials in ("u", "a", "t", "ua", "uua", "uat", "s"):
        for cut in (False, True):
            rows = [(False, 1, initials[i % len(initials)], cut and i % 3 > 0) for i in range(repair.CHUNK_ROWS)]
            assert max(repair.cheapest_edits(rows, s)[1] for s in repair.STATES) < 8 * len(rows)


def inserted(nodes):
    for _ in range(4):
        for s, (cost, audit) in list(nodes.items()):
            to = repair.FITTING[s][0]
            nodes[to] = min(nodes.get(to, (10**9, "")), (cost + 3, audit + "I"))
    return nodes
