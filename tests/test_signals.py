"""Native signals against a sequential model, with and without oversized chunks."""

import math
import random
import statistics
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from vigilframe.config import AnalysisConfig, BaselineConfig
from vigilframe.operators.events import canonical_events
from vigilframe.operators.ordered import CHUNK, prefix_sums, stage, top_n_per_group, with_chunks
from vigilframe.operators.presence import context_lines, router_outage
from vigilframe.operators.scoring import cooldown_dedup, level_hysteresis
from vigilframe.operators.signals import entropy_z, profile_surprisal, rate_z_short, sliding_window_stats


def make_events(n=900, seed=3):
    rng = random.Random(seed)
    t, rows = 10**15, []
    for i in range(n):
        t += rng.choice([0, 0, 0, 1, 2, 5]) * 1_000_000 + (400_000_000 if i % 300 == 299 else 0)
        rows.append((rng.choice(["h1", "h1", "h1", "h2"]), rng.choice("abcdefg"[: 1 + i % 7]), rng.choice(["u1", "u2"]), t, i))
    return rows


def z(value, history, floor):
    if not history:
        return 0.0
    med = statistics.median(history)
    mad = statistics.median([abs(x - med) for x in history])
    return max(-50.0, min(50.0, (value - med) / max(mad / 0.6745, floor)))


def entropy(window):
    n = len(window)
    counts = Counter(x for _, x in window)
    return -sum(c / n * math.log2(c / n) for c in counts.values()) + 0.0


def sequential(rows, cap=None, width=60_000_000, bucket=5_000_000, hist=60, trust=100):
    out, hosts = {}, {}
    for host, tpl, unit, t, i in rows:
        b = t // bucket
        s = hosts.setdefault(host, {"w": deque(), "r": {}, "cur": b, "start": b, "eh": [], "eb": b, "p": {}})
        if b > s["eb"]:
            s["eh"] = (s["eh"] + [entropy(s["w"])])[-hist:]
            s["eb"] = b
        if b > s["cur"]:
            gap = min(b - s["cur"], hist)
            for rate in s["r"].values():
                rate[1] = (rate[1] + [rate[0]] + [0] * (gap - 1))[-hist:]
                rate[0] = 0
            s["cur"] = b
        rate = s["r"].setdefault(tpl, [0, [0] * min(hist, b - s["start"])])
        rate[0] += 1
        rz = z(rate[0], rate[1], max(1.0, math.sqrt((statistics.median(rate[1]) if rate[1] else 0) + 1)))
        w = s["w"]
        w.append((t, tpl))
        while w[0][0] < t - width:
            w.popleft()
        while cap and len(w) > cap:
            w.popleft()
        weights = s["p"].setdefault(unit, {})
        weights.setdefault(tpl, []).append(b)
        decayed = {k: sum(0.5 ** ((b - x) / 120960) for x in v) for k, v in weights.items()}
        total = sum(decayed.values())
        sp = None
        if total >= trust:
            sp = -math.log2((math.floor(decayed[tpl] + 0.5) + 0.5) / (math.floor(total + 0.5) + 0.5 * (len(decayed) + 1)))
        counts = Counter(x for _, x in w)
        out[i] = (len(w), len(counts), counts[tpl], entropy(w), rz, z(entropy(w), s["eh"], 0.15), sp)
    return out


@pytest.mark.parametrize("cap, target", [(None, 10**9), (20, 30)])
def test_signals_equal_sequential_model(spark, cap, target):
    rows = make_events()
    want = sequential(rows, cap)
    df = canonical_events(spark.createDataFrame(rows, "hostname string, template_id string, unit string, ts_us bigint, seq bigint"))
    w = stage(sliding_window_stats(df, max_events=cap, target_rows=target))
    w = stage(entropy_z(w))
    w = stage(rate_z_short(w, target_rows=target))
    w = profile_surprisal(w, cfg=BaselineConfig(profile_min_weight=100), target_rows=target)
    got = w.collect()
    assert len(got) == len(rows)
    for r in got:
        have = (r.win_events, r.win_distinct, r.win_count, r.win_entropy, r.rate_z_short, r.entropy_z, r.surprisal_profile)
        for a, b in zip(have, want[r.seq]):
            assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6), (r.seq, have, want[r.seq])


def test_chunks_split_one_instant(spark):
    # Half of all rows share one timestamp.
    rows = [("h", 7_000_000 if i % 2 else i * 1000, i) for i in range(4000)]
    df = spark.createDataFrame(rows, "hostname string, ts_us bigint, seq bigint")
    chunked = with_chunks(df, ["hostname"], target_rows=200)
    assert chunked.groupBy(CHUNK).count().agg(F.max("count")).collect()[0][0] <= 200
    out = prefix_sums(chunked, ["hostname"], ["ts_us", "seq"], {"rn": F.lit(1).cast("bigint")}).collect()
    ordered = sorted(out, key=lambda r: (r.ts_us, r.seq))
    assert [r.rn for r in ordered] == list(range(1, 4001))


@pytest.mark.parametrize("target", [10**9, 25])
def test_alert_fold_equals_sequential_model(spark, target):
    rng = random.Random(5)
    t, rows = 10**15, []
    for i in range(600):
        t += rng.choice([0, 1, 20, 90]) * 1_000_000
        rows.append(("h", rng.choice(["a", "a", "a", "b"]), t, i, rng.choice([0.1, 0.42, 0.5, 0.55, 0.61, 0.65, 0.7, 0.85])))
    cfg = AnalysisConfig()
    levels, alerts, state = {}, {}, {}
    for _, k, ts, i, s in rows:
        prev, last, last_level, held = state.get(k, (0, None, 0, 0))
        raw = 3 if s >= 0.8 else 2 if s >= 0.6 else 1 if s >= 0.5 else 0
        keep = prev if prev and s >= {1: 0.5, 2: 0.6, 3: 0.8}[prev] * 0.8 else 0
        level = levels[i] = max(raw, keep)
        if level:
            if last is None or level > last_level or ts - last >= 300_000_000:
                alerts[i] = (True, held)
                last, last_level, held = ts, level, 0
            else:
                alerts[i] = (False, 0)
                held += 1
        state[k] = (level, last, last_level, held)
    df = spark.createDataFrame(rows, "hostname string, template_id string, ts_us bigint, seq bigint, combined double")
    out = stage(level_hysteresis(df, cfg, target_rows=target))
    assert {r.seq: r.level for r in out.collect()} == levels
    got = cooldown_dedup(out, cfg).collect()
    assert {r.seq: (r.emitted, r.suppressed_since_last) for r in got} == alerts


def test_levels_go_on_from_a_start(spark):
    rng = random.Random(11)
    scores = [0.1, 0.42, 0.42, 0.5, 0.55, 0.61, 0.65, 0.65, 0.7, 0.7, 0.85, None]
    rows = [("h", k, 10**15 + i * 10**6, i, rng.choice(scores[1:] if i % 90 < 60 else scores)) for i, k in enumerate(rng.choices("abcd", k=800))]
    before = {"a": 3, "b": 2, "c": 1}
    want, last = {}, dict(before)
    for _, k, _, i, s in rows:
        raw = 0 if s is None else 3 if s >= 0.8 else 2 if s >= 0.6 else 1 if s >= 0.5 else 0
        prev = last.get(k, 0)
        stays = prev > 0 and (s is None or s >= {1: 0.5, 2: 0.6, 3: 0.8}[prev] * 0.8)
        want[i] = last[k] = max(raw, prev if stays else 0)
    df = spark.createDataFrame(rows, "hostname string, template_id string, ts_us bigint, seq bigint, combined double")
    start = spark.createDataFrame([("h", *p) for p in before.items()], "hostname string, template_id string, start_level int")
    got = level_hysteresis(df, AnalysisConfig(), target_rows=8, start=start).collect()
    assert {r.seq: r.level for r in got} == want


def fold_cooldowns(rows, cooldown, state):
    """Sequential model: rows (key, ts, seq, level) in order; state: key -> (last_ts, last_level, held)."""
    state, out = dict(state), {}
    for key, ts, seq, level in rows:
        last, last_level, held = state.get(key, (None, 0, 0))
        if last is None or level > last_level or ts - last >= cooldown:
            out[seq], state[key] = (True, held), (ts, level, 0)
        else:
            out[seq], state[key] = (False, 0), (last, last_level, held + 1)
    return out


@pytest.mark.parametrize(
    "target,span,cooldown,with_state", [(10**9, 256, 300, True), (40, 8, 300, False), (60, 16, 7, True), (10**9, 64, 0, False)]
)
def test_cooldowns_of_hot_keys_with_ties(spark, target, span, cooldown, with_state):
    rng = random.Random(target + span + cooldown)
    t, rows = 10**15, []
    for i in range(700):
        t += rng.choice([0, 0, 1, 3, 20, 400]) * 1_000_000
        rows.append((rng.choice("aaaaaabc"), t, i, rng.choice([1, 1, 1, 1, 2, 2, 3])))
    at = rows[0][1]
    known = [("a", at - 5_000_000, 1, 4), ("b", at - 10**12, 3, 0), ("c", None, 0, 7), ("gone", at, 2, 1)] if with_state else []
    cfg = AnalysisConfig(cooldown_seconds=cooldown)
    want = fold_cooldowns(rows, cooldown * 1_000_000, {k: (ts, level, held) for k, ts, level, held in known})
    df = spark.createDataFrame([("h", *r) for r in rows], "hostname string, template_id string, ts_us bigint, seq bigint, level int")
    state = spark.createDataFrame([("h", *k) for k in known], "hostname string, template_id string, last_ts bigint, last_level int, suppressed bigint") if with_state else None
    got = cooldown_dedup(df.repartition(3), cfg, state=state, target_rows=target, span=span).collect()
    assert len(got) == len(rows) and {r.seq: (r.emitted, r.suppressed_since_last) for r in got} == want


def test_cooldown_of_an_empty_table(spark):
    df = spark.createDataFrame([], "hostname string, template_id string, ts_us bigint, seq bigint, level int")
    assert cooldown_dedup(df).isEmpty()


@pytest.mark.parametrize("target", [10**9, 20])
def test_weighted_quantile(spark, target):
    from vigilframe.operators.entropy import weighted_quantile_mid

    rng = random.Random(8)
    values = [rng.randint(0, 150) / 2 for _ in range(400)]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    for keys in (["k"], []):
        got = weighted_quantile_mid(df, keys, "v", target_rows=target).collect()[0]
        assert (got.median, got.total_weight) == (statistics.median(values), 400.0)


def test_top_n(spark):
    rows = [("hot" if i % 3 else "cold", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    got = top_n_per_group(df, ["k"], [F.col("v").desc()], 5, ["v"]).collect()
    for k in ("hot", "cold"):
        want = sorted([v for kk, v in rows if kk == k], reverse=True)[:5]
        assert [r.v for r in sorted(got, key=lambda r: r.rank) if r.k == k] == want


@pytest.mark.parametrize("target", [10**9, 10])
def test_outage_and_context(spark, target):
    ups = [1, 0, 0, 0, 1, 0, 1, 0, 0] * 6
    df = spark.createDataFrame([("h", i * 5_000_000, i, bool(u)) for i, u in enumerate(ups)], "hostname string, ts_us bigint, seq bigint, reachable boolean")
    run, want = 0, {}
    for i, u in enumerate(ups):
        run = 0 if u else run + 1
        want[i] = (run, run >= 2)
    got = router_outage(df, target_rows=target).collect()
    assert {r.seq: (r.failures, r.offline) for r in got} == want

    anchors = spark.createDataFrame([("h", 1, -100), ("h", 2, 52_500_000), ("h", 3, 10**12)], "hostname string, anchor_id int, anchor_us bigint")
    lines = context_lines(df, anchors, 2, 2, target_rows=target).collect()
    by = lambda a: sorted((r.offset, r.seq) for r in lines if r.anchor_id == a)
    assert by(1) == [(0, 0), (1, 1), (2, 2)]
    assert by(2) == [(-2, 8), (-1, 9), (0, 10), (1, 11), (2, 12)]  # tie: the earlier event
    assert by(3) == [(-2, 51), (-1, 52), (0, 53)]
    assert {r.anchor_id: r.truncated for r in lines} == {1: True, 2: False, 3: True}


def test_chunks_of_one_instant_with_wide_gaps(spark):
    """One instant, and seq numbers with gaps that no double tells apart next to small ones."""
    rows = [("h", 5, i << 33) for i in range(1000)] + [("h", 5, (1 << 45) + i) for i in range(1000)] + [("h", 6 + i, i) for i in range(300)]
    df = spark.createDataFrame(rows, "hostname string, ts_us bigint, seq bigint").repartition(5)
    chunked = with_chunks(df, ["hostname"], target_rows=50).collect()
    sizes, last = {}, None
    for r in sorted(chunked, key=lambda r: (r.ts_us, r.seq)):
        assert last is None or r[CHUNK] >= last
        last = r[CHUNK]
        sizes[last] = sizes.get(last, 0) + 1
    assert len(chunked) == 2300 and max(sizes.values()) <= 100


def test_numbered_by(spark):
    from vigilframe.operators.ordered import numbered_by

    df = spark.createDataFrame([(i * 37 % 501, i) for i in range(501)], "a int, b int").repartition(6)
    got = sorted((r.n, r.a) for r in numbered_by(df, ["a"], "n", 1).collect())
    assert got == [(i + 1, i) for i in range(501)]
    assert numbered_by(df.limit(0), ["a"], "n").isEmpty()
