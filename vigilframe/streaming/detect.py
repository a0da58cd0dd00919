"""Anomaly detection on a stream that learns while it judges.

Two streaming queries work one after the other:

1. *Scoring*: each micro-batch gets templates, filters and all signals by the operators of the batch
   run.  What must survive from one micro-batch to the next is little and kept as tables, one version
   per epoch; the last two versions are kept, so a repeated epoch reads what it read before:

   * ``tail``: analysed events of the last rate history/window span,
   * ``entropy``: the last closed window entropies per host,
   * ``hosts``: first event, first bucket and newest time per host,
   * ``registry``: the template clusters,
   * ``counts``: events per bucket since the last learned state, one small table per epoch that adds up.

   Every ``save_us`` of event time the counts are folded into a new learned state (see
   `operators.live`), which is also stored by `checkpoint_baselines` where a ``store`` is given.
2. *Alerting*: levels and cooldowns in a stateful processor per (host, template), see `streaming.alerts`.

However the events are cut into micro-batches, the result equals a batch run over all of them.  Arrival
order (``seq``) counts, so late events are judged as in `in_arrival_order`.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from vigilframe.config import AnalysisConfig, BaselineConfig, DEFAULT_QUIET_RULES, QuietRule
from vigilframe.functions import bucket_of
from vigilframe.operators.baselines import trusted_baselines
from vigilframe.operators.events import canonical_events
from vigilframe.operators.filters import mute_filter, quiet_filter, self_filter
from vigilframe.operators.live import added_counts, learn, learned_baselines, learned_profiles, live_rate_z, recent_profiles, unit_counts
from vigilframe.operators.ordered import remove_path, scratch, stage, top_n_per_group
from vigilframe.operators.scoring import pick_rate_signal, record_columns, score_events
from vigilframe.operators.signals import entropy_history, entropy_z, profile_surprisal, rate_z_short, sliding_window_stats, window_surprisal
from vigilframe.operators.templates import assign_templates, template_registry
from vigilframe.sources.journal import split_parse_errors
from vigilframe.streaming.alerts import fold_stream
from vigilframe.streaming.store import checkpoint_baselines
from vigilframe.streaming.windows import in_arrival_order

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCORED = ["hostname", "template_id", "ts_us", "seq", "combined", "in_learning", "record"]
STATE_TABLES = ("tail", "entropy", "hosts", "registry")
LEARNED = ("hist", "known", "open", "profile")


@dataclass(frozen=True)
class StreamOptions:
    """How a stream is judged.  ``suppressions`` and ``mutes`` give the entries that hold now, once per epoch."""

    cfg: AnalysisConfig = AnalysisConfig()
    base_cfg: BaselineConfig = BaselineConfig()
    quiet_rules: tuple[QuietRule, ...] = DEFAULT_QUIET_RULES
    suppressions: Callable[[], DataFrame] | None = None
    mutes: Callable[[], DataFrame] | None = None
    own_pids: tuple[int, ...] = ()
    state: dict[str, DataFrame] | None = field(default=None)
    store: str | None = None
    save_us: int = 300_000_000


def _load(spark: SparkSession, path: str, epoch: int, name: str) -> DataFrame | None:
    """State of an epoch; only before the first one there is none.  A lost state folder is an error."""
    return None if epoch < 0 else spark.read.parquet(f"{path}/state/epoch={epoch}/{name}")


def _merge_registry(old: DataFrame | None, new: DataFrame, max_templates: int | None) -> DataFrame:
    """Clusters after this epoch; above a capacity those seen last are kept."""
    merged = new if old is None else _joined_registry(old, new)
    if max_templates is None:
        return merged
    kept = top_n_per_group(
        merged, ["hostname"], [F.col("last_seen_us").desc(), F.col("order")], max_templates, ["template_id"]
    )
    return kept.drop("rank")


def _joined_registry(old: DataFrame, new: DataFrame) -> DataFrame:
    o = old.select("hostname", "template_id", *[F.col(c).alias(f"_o_{c}") for c in ("order", "tokens", "first_seen_us", "last_seen_us", "count")])
    top = old.groupBy("hostname").agg((F.max("order") + 1).alias("_next"))
    both = o.join(new, ["hostname", "template_id"], "full_outer").join(top, "hostname", "left")
    return both.select(
        "hostname",
        "template_id",
        F.coalesce("_o_order", F.col("order") + F.coalesce("_next", F.lit(0))).alias("order"),
        F.coalesce("tokens", "_o_tokens").alias("tokens"),
        F.least("_o_first_seen_us", "first_seen_us").alias("first_seen_us"),
        F.greatest("_o_last_seen_us", "last_seen_us").alias("last_seen_us"),
        (F.coalesce("_o_count", F.lit(0)) + F.coalesce("count", F.lit(0))).alias("count"),
    )


SAVED = "epoch bigint, before bigint, saved_us bigint"


def _learned(spark: SparkSession, path: str, epoch: int, opts: StreamOptions) -> tuple[Row, dict[str, DataFrame] | None, DataFrame | None]:
    """(when was learned, the learned state, counts since then) before ``epoch``."""
    if epoch == 0:
        return Row(epoch=-1, before=-1, saved_us=None), opts.state, None
    saved = spark.read.parquet(f"{path}/state/epoch={epoch - 1}/saved").first()
    state = opts.state if saved.epoch < 0 else {n: spark.read.parquet(f"{path}/learned/epoch={saved.epoch}/{n}") for n in LEARNED}
    since = [f"{path}/counts/epoch={e}" for e in range(saved.epoch + 1, epoch)]
    return saved, state, added_counts(spark.read.parquet(*since)) if since else None


def process_epoch(batch: DataFrame, epoch: int, path: str, opts: StreamOptions = StreamOptions()) -> None:
    """Score one micro-batch: rows to ``<path>/scored``, counters to ``<path>/counters``, state beside them."""
    with scratch(batch.sparkSession):
        _process(batch, epoch, path, opts)
    if epoch >= 2:
        remove_path(batch.sparkSession, f"{path}/state/epoch={epoch - 2}")


def _process(batch: DataFrame, epoch: int, path: str, opts: StreamOptions) -> None:
    spark, cfg, base_cfg = batch.sparkSession, opts.cfg, opts.base_cfg
    old = {n: _load(spark, path, epoch - 1, n) for n in STATE_TABLES}
    saved, state, earlier = _learned(spark, path, epoch, opts)
    errors = None
    if "error" in batch.columns:
        batch, errors = split_parse_errors(stage(batch, "stream-lines"))

    tev = canonical_events(batch)
    if "template_id" not in tev.columns:
        tev = assign_templates(tev, cfg.similarity_threshold, cfg.max_templates, registry=old["registry"])
    tev = stage(tev, "stream-templates")
    kept_self = tev
    if opts.suppressions is not None:
        kept_self = self_filter(tev, opts.suppressions(), opts.own_pids)
    elif opts.own_pids:
        kept_self = tev.where(~F.coalesce(F.col("pid").isin(*opts.own_pids), F.lit(False)))
    kept_mute = mute_filter(kept_self, opts.mutes()) if opts.mutes is not None else kept_self
    kept = in_arrival_order(quiet_filter(kept_mute, opts.quiet_rules), old["hosts"], cfg.window_us)
    kept = stage(kept, "stream-kept").withColumn("_new", F.lit(True))
    seen = kept if old["tail"] is None else kept.unionByName(old["tail"].withColumn("_new", F.lit(False)))

    hosts = kept.groupBy("hostname").agg(
        F.min("ts_us").alias("first_us"), F.min(bucket_of(F.col("ts_us"), cfg.bucket_us)).alias("start_bucket"),
        F.max("ts_us").alias("newest_us"),
    )
    if old["hosts"] is not None:
        hosts = hosts.unionByName(old["hosts"]).groupBy("hostname").agg(
            F.min("first_us").alias("first_us"), F.min("start_bucket").alias("start_bucket"), F.max("newest_us").alias("newest_us")
        )
    hosts = stage(hosts, "stream-hosts")

    windowed = stage(sliding_window_stats(seen, cfg.window_us, cfg.max_window_events, outside="dropped_late"), "stream-window")
    points = windowed.where("_new").select("hostname", "ts_us", "seq", "win_entropy")
    if old["entropy"] is not None:
        points = points.unionByName(old["entropy"])
    rows = rate_z_short(windowed, cfg.bucket_us, cfg.history_buckets, start=hosts)
    rows = stage(rows.where("_new"), "stream-rate")
    rows = entropy_z(rows, cfg.bucket_us, cfg.history_buckets, entropy_history(points, cfg.bucket_us, cfg.history_buckets))
    before = recent_profiles(state, earlier, cfg.bucket_us, base_cfg)
    rows = stage(profile_surprisal(rows, cfg.bucket_us, cfg.alpha, base_cfg, initial=before), "stream-profile")
    rows = live_rate_z(rows, cfg.bucket_us, base_cfg, state, earlier)
    scored = score_events(
        pick_rate_signal(window_surprisal(rows, cfg.alpha)).withColumn(
            "surprisal_bits", F.coalesce("surprisal_profile", "surprisal_window")
        ),
        cfg,
    )
    learning = F.col("ts_us") - F.col("first_us") < cfg.learning_us
    scored = scored.join(hosts.select("hostname", "first_us"), "hostname")
    if opts.state is not None:
        # As in a batch, hosts that start with a trusted baseline do not learn first.
        trusted = trusted_baselines(learned_baselines(opts.state, base_cfg), learned_profiles(opts.state), base_cfg)
        scored = scored.join(trusted.where("trusted").select("hostname", F.lit(True).alias("_trusted")), "hostname", "left")
        learning = learning & ~F.coalesce("_trusted", F.lit(False))
    could_alert = F.col("combined") >= cfg.info_threshold * min(max(cfg.exit_factor, 0.0), 1.0)
    scored = stage(
        scored.withColumn("in_learning", learning).withColumn("record", F.when(could_alert, F.struct(*record_columns(scored)))),
        "stream-scored",
    )

    counts = unit_counts(kept, cfg.bucket_us)
    counts.write.mode("overwrite").parquet(f"{path}/counts/epoch={epoch}")
    now = hosts.agg(F.max("newest_us")).first()[0]
    if saved.saved_us is None:
        saved = Row(epoch=saved.epoch, before=saved.before, saved_us=now)
    elif now - saved.saved_us >= opts.save_us:
        since = spark.read.parquet(f"{path}/counts/epoch={epoch}")
        known = learn(since if earlier is None else added_counts(since, earlier), state, cfg.bucket_us, base_cfg)
        for name, df in known.items():
            df.write.mode("overwrite").parquet(f"{path}/learned/epoch={epoch}/{name}")
        # A repeated epoch starts from the last learned state; what led to that one is no longer read.
        for e in range(saved.before + 1, saved.epoch + 1):
            remove_path(spark, f"{path}/counts/epoch={e}")
        if saved.before >= 0:
            remove_path(spark, f"{path}/learned/epoch={saved.before}")
        saved = Row(epoch=epoch, before=saved.epoch, saved_us=now)
        if opts.store is not None:
            kept_clusters = _merge_registry(old["registry"], template_registry(tev), cfg.max_templates)
            checkpoint_baselines(
                spark, opts.store, learned_baselines(known, base_cfg), learned_profiles(known), kept_clusters, cfg.bucket_seconds, "", now, known
            )
    tables = {
        "tail": _tail(seen.drop("_new"), hosts, cfg),
        "entropy": _last_entropies(points, cfg),
        "hosts": hosts,
        "registry": _merge_registry(old["registry"], template_registry(tev), cfg.max_templates),
        "saved": spark.createDataFrame([saved], SAVED),
    }
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/state/epoch={epoch}/{name}")
    _counters(tev, kept_self, kept_mute, kept, scored, errors).write.mode("overwrite").parquet(f"{path}/counters/epoch={epoch}")
    _publish(spark, scored.select(*SCORED), path, epoch)


def _publish(spark: SparkSession, scored: DataFrame, path: str, epoch: int) -> None:
    """Scored rows of an epoch appear at once and once: a repeated epoch leaves those that are there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    staged, final = (jvm.org.apache.hadoop.fs.Path(f"{path}/{p}/epoch={epoch}") for p in ("unpublished", "scored"))
    fs = final.getFileSystem(conf)
    if fs.exists(final):
        return
    scored.write.mode("overwrite").parquet(f"{path}/unpublished/epoch={epoch}")
    fs.mkdirs(final.getParent())
    if not fs.rename(staged, final):
        raise OSError(f"{staged} could not become {final}")


def _counters(
    tev: DataFrame, kept_self: DataFrame, kept_mute: DataFrame, kept: DataFrame, scored: DataFrame, errors: DataFrame | None
) -> DataFrame:
    """Per host: what came, what the filters took, what was late, and the window as of the last event."""

    def tagged(df: DataFrame, name: str, value=None) -> DataFrame:
        return df.groupBy("hostname").agg(F.count(F.lit(1) if value is None else F.when(value, 1)).alias(name))

    last = F.max_by(F.struct("win_entropy", "entropy_z", "win_events", "win_distinct", "ts_us"), F.struct("ts_us", "seq"))
    window = scored.groupBy("hostname").agg(last.alias("w")).select(
        "hostname", F.col("w.win_entropy").alias("entropy_bits"), "w.entropy_z", F.col("w.win_events").alias("events_in_window"),
        F.col("w.win_distinct").alias("distinct_templates"), F.col("w.ts_us").alias("ts_us"),
    )
    parts = [
        tagged(tev, "events"), tagged(kept_self, "_self"), tagged(kept_mute, "_mute"), tagged(kept, "processed"),
        tagged(kept, "dropped_late", F.col("dropped_late")), window,
    ]
    if errors is not None:
        host = F.coalesce(F.col("hostname"), F.lit("")) if "hostname" in errors.columns else F.lit("")
        parts.append(tagged(errors.withColumn("hostname", host), "parse_errors"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    if errors is None:
        rows = rows.withColumn("parse_errors", F.lit(None).cast("bigint"))
    out = rows.groupBy("hostname").agg(*[F.max(c).alias(c) for c in rows.columns if c != "hostname"])
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "hostname", zero("events").alias("events"), zero("parse_errors").alias("parse_errors"),
        (zero("events") - zero("_self")).alias("self_filtered"), (zero("_self") - zero("_mute")).alias("muted"),
        (zero("_mute") - zero("processed")).alias("quieted"), zero("dropped_late").alias("dropped_late"), zero("processed").alias("processed"),
        "ts_us", "entropy_bits", "entropy_z", "events_in_window", "distinct_templates",
    )


def _tail(seen: DataFrame, hosts: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Events that later ones can still see: the rate history or the window, whichever is longer."""
    span = max((cfg.history_buckets + 1) * cfg.bucket_us, cfg.window_us)
    return seen.join(hosts.select("hostname", "newest_us"), "hostname").where(F.col("ts_us") >= F.col("newest_us") - span).drop("newest_us")


def _last_entropies(points: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """The closing entropy of the last buckets per host (the open one may still be replaced)."""
    last = (
        points.withColumn("bucket", bucket_of(F.col("ts_us"), cfg.bucket_us))
        .groupBy("hostname", "bucket")
        .agg(F.max_by(F.struct("ts_us", "seq", "win_entropy"), F.struct("ts_us", "seq")).alias("_e"))
    )
    kept = top_n_per_group(last, ["hostname"], [F.col("bucket").desc()], cfg.history_buckets + 1, ["bucket"])
    return kept.select("hostname", "_e.ts_us", "_e.seq", "_e.win_entropy")


class Detection:
    """The two running queries of a detection."""

    def __init__(self, scoring: StreamingQuery, start_alerts: Callable[[], StreamingQuery], once: bool):
        self.scoring, self._start, self._once = scoring, start_alerts, once
        self.alerts = None if once else start_alerts()

    def awaitTermination(self) -> None:  # noqa: N802  (as in Spark)
        """Until the stream ends; with a trigger that ends by itself alerts follow when all is scored."""
        self.scoring.awaitTermination()
        if self._once:
            self.alerts = self._start()
            self.alerts.awaitTermination()
        else:
            self.alerts.processAllAvailable()
            self.alerts.stop()

    def stop(self) -> None:
        self.scoring.stop()
        if self.alerts is not None:
            self.alerts.stop()


def stream_detect(
    events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, alert_state: DataFrame | None = None, **options
) -> Detection:
    """Start detection on a stream of parsed journal events; ``options`` are those of `StreamOptions`.

    ``events`` needs ``seq`` (arrival order, unique per host) besides the journal columns; lines that could
    not be parsed may stand among them (column ``error``).  ``alert_state``: levels and cooldowns to start
    with, see `fold_stream`.
    """
    spark, opts = events.sparkSession, StreamOptions(**options)
    trigger = trigger or {"processingTime": "5 seconds"}
    scoring = (
        events.writeStream.foreachBatch(lambda batch, epoch: process_epoch(batch, epoch, path, opts))
        .option("checkpointLocation", f"{checkpoint}/scoring").trigger(**trigger).start()
    )

    def start_alerts() -> StreamingQuery:
        schema = _scored_schema(spark, events, opts)
        rows = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{path}/scored")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        return (
            fold_stream(rows, opts.cfg, alert_state).writeStream.format("parquet").outputMode("append")
            .option("path", f"{path}/alerts").option("checkpointLocation", f"{checkpoint}/alerts").trigger(**trigger).start()
        )

    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/scored")
    fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(fs_path)
    return Detection(scoring, start_alerts, bool(trigger.get("availableNow") or trigger.get("once")))


def _scored_schema(spark: SparkSession, events: DataFrame, opts: StreamOptions):
    """Schema of the scored rows, from the plan of an empty batch."""
    empty = spark.createDataFrame([], events.schema)
    tev = canonical_events(empty)
    kind = tev.schema["template_id"].dataType if "template_id" in tev.columns else "bigint"
    given = {
        "template_id": F.lit(None).cast(kind), "combined": F.lit(0.0), "in_learning": F.lit(False), "rate_source": F.lit(""),
        **{c: F.lit(0.0) for c in ("rate_z", "surprisal_bits", "entropy_z", "rate_component", "surprisal_component", "entropy_component")},
    }
    if "template" not in tev.columns and "template_id" not in tev.columns:
        given["template"] = F.lit("")
    rows = tev.withColumns(given)
    return rows.withColumn("record", F.struct(*record_columns(rows))).select(*SCORED).schema


def read_dispositions(spark: SparkSession, path: str) -> DataFrame:
    """All events above normal level so far, with their disposition."""
    return spark.read.parquet(f"{path}/alerts")


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """All alerts written so far, as records."""
    rows = read_dispositions(spark, path).where("disposition = 'emitted'")
    return rows.select("hostname", "ts_us", "seq", "template_id", "level", "record.*", "suppressed_since_last")


def read_snapshots(spark: SparkSession, path: str, learning_us: int = 600_000_000) -> DataFrame:
    """Counters per host up to each epoch, with the window as of its last event, templates and alerts so far."""
    from pyspark.sql import Window

    sums = ["events", "parse_errors", "self_filtered", "muted", "quieted", "dropped_late", "processed"]
    so_far = Window.partitionBy("hostname").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    by_epoch = Window.partitionBy("hostname").orderBy("epoch")
    rows = spark.read.option("basePath", f"{path}/counters").parquet(f"{path}/counters")
    elapsed = F.greatest((F.col("ts_us") - F.lag("ts_us").over(by_epoch)) / 1e6, F.lit(0.001))
    rows = rows.withColumn("events_per_sec", F.col("events") / elapsed).withColumns({c: F.sum(c).over(so_far) for c in sums})
    remaining = F.lit(learning_us) - (F.col("ts_us") - F.min("ts_us").over(so_far))
    return rows.withColumn("learning_remaining_s", F.when(remaining > 0, bucket_of(remaining, 1_000_000)))
