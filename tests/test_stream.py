import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.scenario import BASE_US, journal_lines
from vigilframe.config import AnalysisConfig, BaselineConfig
from vigilframe.operators import live
from vigilframe.operators.baselines import trusted_baselines
from vigilframe.operators.events import canonical_events
from vigilframe.operators.templates import assign_templates
from vigilframe.plans.detect import detect_anomalies
from vigilframe.sources.journal import parse_journal, split_parse_errors
from vigilframe.streaming.detect import read_alerts, read_dispositions, read_snapshots, stream_detect
from vigilframe.streaming.store import restore_baselines, restored_state
from vigilframe.streaming.windows import presence_sessions, tumbling_counts

CFG = replace(AnalysisConfig(), learning_minutes=5)
BASE = BaselineConfig(min_weight=40.0, profile_min_weight=60.0)


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    """Events with templates that arrive out of order, some later than the window."""
    rng = random.Random(3)
    lines = [(i, text) for i, text in enumerate(journal_lines(seed=11))]
    good, _ = split_parse_errors(parse_journal(spark.createDataFrame(lines, "seq bigint, value string")))
    good = assign_templates(canonical_events(good.where(F.col("ts_us") < BASE_US + 1_000_000_000)))
    held = {r.seq: r.ts_us + rng.choice([0, 0, 0, 0, 1, 3, 20, 90]) * 1_000_000 for r in good.select("seq", "ts_us").collect()}
    order = {old: new for new, old in enumerate(sorted(held, key=lambda s: (held[s], s)))}
    moved = spark.createDataFrame(list(order.items()), "seq bigint, arrival bigint")
    path = str(tmp_path_factory.mktemp("arriving") / "events")
    good.join(moved, "seq").withColumn("seq", F.col("arrival")).drop("arrival").write.parquet(path)
    return spark.read.parquet(path)


def source(spark, events, folder, cuts):
    """A stream of the events in micro-batches that begin with the given arrivals."""
    for k, (low, high) in enumerate(zip(cuts, [*cuts[1:], 1 << 40])):
        events.where((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.parquet(f"{folder}/p{k}")
    return (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    )


def entries(spark):
    at = lambda s: BASE_US + s * 1_000_000
    mutes = spark.createDataFrame(
        [("alpha", "label-sync.service", at(100), at(400)), ("alpha", "ink-monitor.service", at(700), None)],
        "hostname string, unit string, from_us bigint, until_us bigint",
    )
    own = spark.createDataFrame(
        [("alpha", "unit", "badge-reader.service", at(300), at(420)), ("alpha", "pid", "333", at(0), None)],
        "hostname string, kind string, key string, from_us bigint, until_us bigint",
    )
    return mutes, own


KEYS = ["hostname", "ts_us", "seq", "template_id", "suppressed_since_last"]


def rows(df, *more):
    return {tuple(r) for r in df.select(*KEYS, *more).collect()}


def test_stream_equals_batch_for_any_cut(spark, tmp_path, arriving):
    """Cuts within buckets and windows, mutes, self filter, late events, learning, and a stop in between."""
    rng = random.Random(8)
    n = arriving.count()
    mutes, own = entries(spark)
    mutes = mutes.join(arriving.select("unit", "template_id").distinct(), "unit")
    options = dict(cfg=CFG, base_cfg=BASE, own_pids=(444,))
    batch = detect_anomalies(arriving, CFG, BASE, suppressions=own, mutes=mutes, own_pids=(444,), learn=True, late=True)
    cuts = [0, *sorted(rng.sample(range(n // 2, n), 2))]
    folder, out, store = (str(tmp_path / x) for x in ("in", "out", "store"))

    def run():
        q = stream_detect(
            stream, out, str(tmp_path / "cp"), {"availableNow": True}, mutes=lambda: mutes, suppressions=lambda: own, store=store,
            save_us=60_000_000, **options,
        )
        q.awaitTermination()

    stream = source(spark, arriving.where(F.col("seq") < cuts[2]), folder + "/a", cuts[:2])
    stream = spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    run()
    source(spark, arriving.where(F.col("seq") >= cuts[2]), folder + "/b", cuts[2:])
    run()
    level = F.round("breakdown.combined", 6)
    want = rows(batch["anomalies"], "level", level)
    assert want and rows(read_alerts(spark, out), "level", level) == want
    held = lambda df: {tuple(r) for r in df.where("disposition <> 'normal'").select("seq", "disposition").collect()}
    assert held(read_dispositions(spark, out)) == held(batch["scored"])
    sources = {r.rate_source for r in batch["scored"].select("rate_source").distinct().collect()}
    assert {"slot_baseline", "short_term"} <= sources

    last = read_snapshots(spark, out, CFG.learning_us).orderBy(F.col("epoch").desc()).first()
    stats = batch["stats"].first()
    for name in ("events", "self_filtered", "muted", "quieted", "processed", "parse_errors"):
        assert last[name] == stats[name], name
    assert last.dropped_late == batch["scored"].where("dropped_late").count() > 0 and stats.self_filtered > 0 and stats.muted > 0

    # What was saved on the way is a learned state that goes on.
    state = restored_state(restore_baselines(spark, store, CFG.bucket_seconds, ""))
    assert set(state) == {"hist", "known", "open", "profile"} and not state["hist"].isEmpty()
    assert not restore_baselines(spark, store, CFG.bucket_seconds + 1, "").keys() - {"registry"}


def test_stream_goes_on_from_a_learned_state(spark, tmp_path, arriving):
    """Baselines learned before: no learning phase, and events judged by them from the start."""
    half = arriving.where(F.col("ts_us") < BASE_US + 500_000_000)
    rest = arriving.where(F.col("ts_us") >= BASE_US + 500_000_000)
    state = live.learn(live.unit_counts(half, CFG.bucket_us), None, CFG.bucket_us, BASE)
    assert trusted_baselines(live.learned_baselines(state, BASE), live.learned_profiles(state), BASE).first().trusted
    batch = detect_anomalies(rest, CFG, BASE, learn=True, late=True, state=state)
    n = rest.agg(F.min("seq")).first()[0]
    stream = source(spark, rest, str(tmp_path / "in"), [0, n + 400])
    q = stream_detect(stream, str(tmp_path / "out"), str(tmp_path / "cp"), {"availableNow": True}, cfg=CFG, base_cfg=BASE, state=state)
    q.awaitTermination()
    want = rows(batch["anomalies"], "level")
    assert want and rows(read_alerts(spark, str(tmp_path / "out")), "level") == want
    assert batch["scored"].where("disposition = 'suppressed_learning'").isEmpty()


def test_native_windows(spark, tmp_path):
    rows = [("h", "u", 1, 1), ("h", "u", 1, 3), ("h", "u", 2, 8), ("h", "u", 1, 100)]
    df = canonical_events(
        spark.createDataFrame(rows, "hostname string, unit string, template_id bigint, s bigint")
    ).withColumn("ts", F.timestamp_seconds("s"))
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(df.schema).parquet(src)

    def run(sdf, name):
        q = sdf.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    counts = run(tumbling_counts(stream()), "tumbling").orderBy("bucket_start", "template_id")
    assert [(r.template_id, r["count"]) for r in counts.collect()] == [(1, 2), (2, 1)]
    spans = run(presence_sessions(stream(), ["hostname"]), "presence").collect()
    assert [r.sightings for r in spans] == [3]


def test_streamed_window_entropy(spark, tmp_path):
    from vigilframe.operators.signals import sliding_window_stats_bucketed
    from vigilframe.streaming.windows import publish_snapshots, sliding_counts

    rows = [("h", i % 3, i) for i in range(40)] + [("h", 9, 500)]
    df = spark.createDataFrame(rows, "hostname string, template_id int, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    stream = lambda: spark.readStream.schema(df.schema).parquet(src)
    q = sliding_counts(stream()).writeStream.format("memory").queryName("entropy_w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = sliding_window_stats_bucketed(df).where("window_end <= timestamp_seconds(440)")
    key = lambda r: (r.window_start, r.win_events, r.win_distinct, round(r.win_entropy, 9))
    assert {key(r) for r in spark.table("entropy_w").collect()} == {key(r) for r in want.collect()}
    p = publish_snapshots(stream(), str(tmp_path / "snap"), str(tmp_path / "cp"), availableNow=True)
    p.awaitTermination()
    assert [r.events for r in spark.read.parquet(str(tmp_path / "snap")).collect()] == [41]
