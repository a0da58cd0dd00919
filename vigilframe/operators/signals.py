"""Per-event signals: sliding window, short-term rate, entropy history, profile surprisal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilframe.config import BaselineConfig
from vigilframe.functions import (
    ENTROPY_MIN_SCALE,
    bucket_of,
    count_scale_floor,
    entropy_from_sums,
    let,
    mad,
    median,
    median_sorted,
    surprisal,
    z_from_median_mad,
)
from vigilframe.operators.ordered import (
    CHUNK,
    CHUNK_ROWS,
    SLOT_US,
    carry_in,
    ensure_chunks,
    prefix_sums,
    stage,
    with_chunks,
)

_FIX = 1 << 30  # fixed-point scale of c*log2(c): integer sums do not drift over long histories


def _f(c: Column) -> Column:
    """c*log2(c) in fixed point (bigint)."""
    return F.when(c > 1, F.round(c * F.log2(c) * float(_FIX)).cast("bigint")).otherwise(
        F.lit(0).cast("bigint")
    )


def _sgn(c: Column) -> Column:
    return F.when(c > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def sliding_window_stats(
    tev: DataFrame,
    window_us: int = 60_000_000,
    max_events: int | None = None,
    category: str = "template_id",
    slot_us: int = SLOT_US,
    target_rows: int = CHUNK_ROWS,
    outside: str | None = None,
) -> DataFrame:
    """Window statistics as seen by each event (itself included), in arrival order.

    Adds ``win_events``, ``win_distinct``, ``win_count`` (this category) and ``win_entropy``.
    Every event enters the window at its time and leaves after time + window; both are ticks of
    one ordered stream whose running sums give the statistics.  Two shuffles of the ticks, by
    (host, category, chunk) and by (host, chunk); earlier chunks arrive as per-chunk sums.

    ``max_events`` additionally expires the oldest event when the window would hold more rows.
    ``outside`` names a boolean column of events that see the window but never enter it.
    """
    host = "hostname"
    enters = F.lit(True) if outside is None else ~F.col(outside)
    cols = [c for c in tev.columns if c != CHUNK]
    payload = [c for c in cols if c not in (host, category, "ts_us", "seq")]
    base = tev.select(*cols)
    if max_events is None:
        leaves = F.struct(
            (F.col("ts_us") + window_us).alias("t"), F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("pos")
        )
    else:
        base = stage(_with_capacity_exit(base, window_us, max_events, slot_us, target_rows, enters), "exits")
        leaves = F.col("_exit")

    adds = base.select(
        host,
        category,
        F.col("ts_us").alias("_t"),
        F.lit(1).alias("_kind"),
        F.col("seq").alias("_pos"),
        F.when(enters, 1).otherwise(0).cast("bigint").alias("_d"),
        F.struct("seq", *payload).alias("_row"),
    )
    # Departures at one instant only matter as a sum per category: combine before the shuffle.
    expiries = (
        base.where(enters).select(host, category, leaves.alias("_x"))
        .groupBy(host, category, F.col("_x.t").alias("_t"), F.col("_x.kind").alias("_kind"), F.col("_x.pos").alias("_pos"))
        .agg((-F.count(F.lit(1))).cast("bigint").alias("_d"))
        .withColumn("_row", F.lit(None).cast(adds.schema["_row"].dataType))
        .select(*adds.columns)
    )
    ticks = with_chunks(
        adds.unionByName(expiries).withColumn("_end", F.col("_kind") == 2),
        [host],
        ts="_t",
        seq="_pos",
        slot_us=slot_us,
        target_rows=target_rows,
        at_end="_end",
    ).drop("_end")

    # State at the start of each chunk, from sums per (host, category, chunk).
    by_cat = Window.partitionBy(host, category).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    by_host = Window.partitionBy(host).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    cat_state = (
        ticks.groupBy(host, category, CHUNK)
        .agg(F.sum("_d").alias("_dc"))
        .withColumn("_c0", F.coalesce(F.sum("_dc").over(by_cat), zero))
    )
    end = F.col("_c0") + F.col("_dc")
    host_state = (
        cat_state.groupBy(host, CHUNK)
        .agg(
            F.sum("_dc").alias("_dn"),
            F.sum(_f(end) - _f(F.col("_c0"))).alias("_ds"),
            F.sum(_sgn(end) - _sgn(F.col("_c0"))).alias("_dk"),
        )
        .select(
            host,
            CHUNK,
            F.coalesce(F.sum("_dn").over(by_host), zero).alias("_n0"),
            F.coalesce(F.sum("_ds").over(by_host), zero).alias("_s0"),
            F.coalesce(F.sum("_dk").over(by_host), zero).alias("_k0"),
        )
    )

    order = ["_t", "_kind", "_pos", F.col("_d").asc()]
    in_cat = Window.partitionBy(host, category, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = (
        ticks.withColumn("_c", F.sum("_d").over(in_cat))
        .join(cat_state.drop("_dc"), [host, category, CHUNK])
        .withColumn("_c", F.col("_c") + F.col("_c0"))
        .withColumn("_ds", _f(F.col("_c")) - _f(F.col("_c") - F.col("_d")))
        .withColumn("_dk", _sgn(F.col("_c")) - _sgn(F.col("_c") - F.col("_d")))
    )
    in_host = (
        Window.partitionBy(host, CHUNK).orderBy(*order, category).rowsBetween(Window.unboundedPreceding, 0)
    )
    out = (
        counted.withColumns(
            {
                "_n": F.sum("_d").over(in_host),
                "_s": F.sum("_ds").over(in_host),
                "_k": F.sum("_dk").over(in_host),
            }
        )
        .where(F.col("_row").isNotNull())
        .join(host_state, [host, CHUNK])
    )
    n, k = F.col("_n") + F.col("_n0"), F.col("_k") + F.col("_k0")
    s = (F.col("_s") + F.col("_s0")) / float(_FIX)
    renamed = {"ts_us": F.col("_t"), host: F.col(host), category: F.col(category)}
    return out.select(
        *[renamed.get(c, F.col(f"_row.{c}")).alias(c) for c in cols],
        n.alias("win_events"),
        k.alias("win_distinct"),
        F.col("_c").alias("win_count"),
        F.when(k > 1, entropy_from_sums(n, s)).otherwise(F.lit(0.0)).alias("win_entropy"),
    )


def _with_capacity_exit(
    base: DataFrame, window_us: int, max_events: int, slot_us: int, target_rows: int, enters: Column
) -> DataFrame:
    """``_exit``: when an event leaves, by age or because ``max_events`` later ones arrived."""
    numbered = prefix_sums(
        with_chunks(base, ["hostname"], slot_us=slot_us, target_rows=target_rows),
        ["hostname"],
        ["ts_us", "seq"],
        {"_rn": F.when(enters, 1).otherwise(0).cast("bigint")},
    ).drop(CHUNK)
    pusher = numbered.where(enters).select(
        "hostname",
        (F.col("_rn") - max_events).alias("_rn"),
        F.col("ts_us").alias("_pt"),
        F.col("seq").alias("_ps"),
    )
    by_age = F.struct(
        (F.col("ts_us") + window_us).alias("t"), F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("pos")
    )
    by_rows = F.struct(F.col("_pt").alias("t"), F.lit(1).alias("kind"), F.col("_ps").alias("pos"))
    return (
        numbered.join(pusher, ["hostname", "_rn"], "left")
        .withColumn("_exit", F.when(F.col("_pt") <= F.col("ts_us") + window_us, by_rows).otherwise(by_age))
        .drop("_rn", "_pt", "_ps")
    )


def sliding_window_stats_bucketed(
    tev: DataFrame, window: str = "60 seconds", slide: str = "5 seconds", category: str = "template_id"
) -> DataFrame:
    """The same statistics per sliding window (needs a ``ts`` timestamp); batch or streaming.

    Counts are aggregated once per (host, category, slide) and only then fanned out to windows.
    """
    counts = tev.groupBy("hostname", category, F.window("ts", window, slide)).agg(
        F.count(F.lit(1)).alias("_c")
    )
    sums = counts.groupBy("hostname", "window").agg(
        F.sum("_c").alias("win_events"),
        F.count(F.lit(1)).alias("win_distinct"),
        F.sum(F.when(F.col("_c") > 1, F.col("_c") * F.log2("_c")).otherwise(F.lit(0.0))).alias("_s"),
    )
    h = F.when(
        F.col("win_distinct") > 1, entropy_from_sums(F.col("win_events"), F.col("_s"))
    ).otherwise(F.lit(0.0))
    return sums.select(
        "hostname",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "win_events",
        "win_distinct",
        h.alias("win_entropy"),
    )


def rate_z_short(
    tev: DataFrame,
    bucket_us: int = 5_000_000,
    history: int = 60,
    category: str = "template_id",
    slot_us: int | None = None,
    target_rows: int = CHUNK_ROWS,
    start: DataFrame | None = None,
) -> DataFrame:
    """Robust z of the running count in the open bucket against the last ``history`` buckets.

    Adds ``bucket``, ``bucket_count`` (this event included) and ``rate_z_short``.  Buckets without
    the category count as zero, also before its first sight (back to the host's first bucket:
    ``start`` (hostname, start_bucket) where the rows do not reach back that far).
    """
    host = "hostname"
    slot = slot_us or max(SLOT_US // bucket_us, 1) * bucket_us
    ev = ensure_chunks(tev, [host], slot_us=slot, target_rows=target_rows).withColumn(
        "bucket", bucket_of(F.col("ts_us"), bucket_us)
    )
    key = [host, category, "bucket"]
    parts = ev.groupBy(*key, CHUNK).agg(F.count(F.lit(1)).alias("_m"))
    buckets = parts.groupBy(*key).agg(F.sum("_m").alias("_c"))
    stats = _zero_padded_history(buckets, [host, category], history, start)
    # One row per (category, bucket, chunk) brings both the carry and the history to the events.
    side = carry_in(parts, key, ["_m"]).join(stats, key)
    w = Window.partitionBy(*key, CHUNK).orderBy("ts_us", "seq")
    out = ev.withColumn("_rn", F.row_number().over(w)).join(side, [*key, CHUNK])
    current = (F.col("_rn") + F.coalesce(F.col("_c__m"), F.lit(0))).cast("bigint")
    z = z_from_median_mad(
        current.cast("double"), F.col("_med"), F.col("_mad"), count_scale_floor(F.col("_med"))
    )
    keep = [c for c in ev.columns if c != CHUNK or CHUNK in tev.columns]
    return out.select(
        *keep, current.alias("bucket_count"), F.coalesce(z, F.lit(0.0)).alias("rate_z_short")
    )


def _zero_padded_history(
    buckets: DataFrame, keys: list[str], history: int, start: DataFrame | None
) -> DataFrame:
    """Median/MAD of the previous ``history`` buckets incl. zeros, per (keys, bucket).

    One row per key and non-empty bucket, so a key has at most one row per bucket of calendar time;
    it is still cut into stretches, each with the preceding ``history`` buckets repeated.
    """
    stretch = max(history * 20, 1)
    host = keys[0]
    begin = (
        buckets.groupBy(host).agg(F.min("bucket").alias("_start"))
        if start is None
        else start.select(host, F.col("start_bucket").alias("_start"))
    )
    idx = F.call_function("div", F.col("bucket"), F.lit(stretch).cast("bigint"))
    near_end = F.col("bucket") - idx * stretch >= stretch - history
    spread = buckets.withColumn(
        "_st", F.explode(F.when(near_end, F.array(idx, idx + 1)).otherwise(F.array(idx)))
    )
    w = Window.partitionBy(*keys, "_st").orderBy("bucket").rangeBetween(-history, -1)
    hist = (
        spread.withColumn("_nz", F.collect_list(F.col("_c").cast("double")).over(w))
        .where(idx == F.col("_st"))
        .join(begin, host)
        .withColumn("_len", F.least(F.lit(history), F.col("bucket") - F.col("_start")).cast("int"))
    )
    zeros = F.array_repeat(F.lit(0.0), F.greatest(F.col("_len") - F.size("_nz"), F.lit(0)))

    def med_mad(h: Column) -> Column:
        return let(
            median_sorted(h), lambda m: F.struct(m.alias("med"), mad(h, m).alias("mad"))
        )

    # More zeros than counts: median and MAD are zero, nothing needs sorting.
    both = F.when(
        F.size("_nz") * 2 < F.col("_len"), F.struct(F.lit(0.0).alias("med"), F.lit(0.0).alias("mad"))
    ).otherwise(let(F.concat(zeros, F.array_sort("_nz")), med_mad))
    return hist.withColumn("_b", both).select(
        *keys, "bucket", F.col("_b.med").alias("_med"), F.col("_b.mad").alias("_mad")
    )


def entropy_history(windowed: DataFrame, bucket_us: int = 5_000_000, history: int = 60) -> DataFrame:
    """Per host and non-empty bucket: the window entropy at its last event (``closed_entropy``) and
    median/MAD of up to ``history`` earlier such values (``hist_median``, ``hist_mad``)."""
    closed = (
        windowed.withColumn("bucket", bucket_of(F.col("ts_us"), bucket_us))
        .groupBy("hostname", "bucket")
        .agg(F.max_by("win_entropy", F.struct("ts_us", "seq")).alias("closed_entropy"))
    )
    # At most one row per bucket of calendar time and host.
    w = Window.partitionBy("hostname").orderBy("bucket").rowsBetween(-history, -1)
    med = median(F.col("_h"))
    return (
        closed.withColumn("_h", F.collect_list("closed_entropy").over(w))
        .withColumn("hist_len", F.size("_h"))
        .withColumn("hist_median", med)
        .withColumn("hist_mad", mad(F.col("_h"), F.col("hist_median")))
        .drop("_h")
    )


def entropy_z(
    windowed: DataFrame, bucket_us: int = 5_000_000, history: int = 60, hist: DataFrame | None = None
) -> DataFrame:
    """Add ``entropy_z``: the event's window entropy against the closed buckets before its own."""
    hist = entropy_history(windowed, bucket_us, history) if hist is None else hist
    had = "bucket" in windowed.columns
    out = windowed.withColumn("bucket", bucket_of(F.col("ts_us"), bucket_us)).join(
        hist.select("hostname", "bucket", "hist_median", "hist_mad"), ["hostname", "bucket"]
    )
    z = z_from_median_mad(F.col("win_entropy"), F.col("hist_median"), F.col("hist_mad"), ENTROPY_MIN_SCALE)
    out = out.withColumn("entropy_z", F.coalesce(z, F.lit(0.0))).drop("hist_median", "hist_mad")
    return out if had else out.drop("bucket")


def window_surprisal(windowed: DataFrame, alpha: float = 0.5) -> DataFrame:
    """Add ``surprisal_window``: surprise of the event's template within the current window."""
    return windowed.withColumn(
        "surprisal_window",
        surprisal(F.col("win_count"), F.col("win_events"), F.col("win_distinct"), alpha),
    )


def profile_surprisal(
    tev: DataFrame,
    bucket_us: int = 5_000_000,
    alpha: float = 0.5,
    cfg: BaselineConfig = BaselineConfig(),
    category: str = "template_id",
    slot_us: int = SLOT_US,
    target_rows: int = CHUNK_ROWS,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Add ``profile_weight`` and ``surprisal_profile``: surprise against the unit's decayed
    long-term profile as of this event (itself included); NULL while the profile is not trusted.

    A unit's profile is a running sum of 2^(bucket/half-life); dividing by the event's own factor
    gives the decayed weight.  Profiles are exact; negligible weights are not pruned.  ``initial``
    (hostname, unit_name, template, weight, last_bucket): profiles of the time before, which grow on.
    """
    host, unit = "hostname", "unit_name"
    half_life = cfg.half_life_buckets(bucket_us // 1_000_000)
    ev = ensure_chunks(tev, [host], slot_us=slot_us, target_rows=target_rows).withColumn(
        "_b", bucket_of(F.col("ts_us"), bucket_us)
    )
    keep = [c for c in tev.columns]
    # The exponent must start near the data: 2^(absolute bucket / half-life) overflows.
    base = F.broadcast(ev.agg(F.min("_b").alias("_b0")))
    ev = ev.crossJoin(base).withColumn("_w", F.pow(F.lit(2.0), (F.col("_b") - F.col("_b0")) / F.lit(half_life)))
    key = [host, unit, category]
    parts = ev.groupBy(*key, CHUNK).agg(F.sum("_w").alias("_wt"))
    first_chunk = parts.groupBy(*key).agg(F.min(CHUNK).alias(CHUNK))
    if initial is not None:
        first_chunk = first_chunk.join(initial.select(*key), key, "left_anti")
    unit_parts = parts.groupBy(host, unit, CHUNK).agg(F.sum("_wt").alias("_wu"))
    fresh = first_chunk.groupBy(host, unit, CHUNK).agg(F.count(F.lit(1)).alias("_fresh"))
    unit_side = carry_in(
        unit_parts.join(fresh, [host, unit, CHUNK], "left").withColumn(
            "_fresh", F.coalesce(F.col("_fresh"), F.lit(0))
        ),
        [host, unit],
        ["_wu", "_fresh"],
    )
    cat_side = carry_in(parts, key, ["_wt"])
    run_cat = Window.partitionBy(*key, CHUNK).orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    run_unit = Window.partitionBy(host, unit, CHUNK).orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        ev.withColumns({"_lt": F.sum("_w").over(run_cat), "_rn": F.count(F.lit(1)).over(run_cat)})
        .join(cat_side, [*key, CHUNK])
        .join(first_chunk.withColumn("_first", F.lit(True)), [*key, CHUNK], "left")
        .withColumn("_new", (F.col("_first").isNotNull() & (F.col("_rn") == 1)).cast("bigint"))
        .withColumn("_lt", F.col("_lt") + F.coalesce(F.col("_c__wt"), F.lit(0.0)))
    )
    rows = rows.withColumns({"_lu": F.sum("_w").over(run_unit), "_lk": F.sum("_new").over(run_unit)}).join(
        unit_side, [host, unit, CHUNK]
    )
    kinds = F.col("_lk") + F.coalesce(F.col("_c__fresh"), F.lit(0))
    if initial is not None:
        grown = F.pow(F.lit(2.0), (F.col("_last") - F.col("_b0")) / F.lit(half_life))
        units = initial.groupBy(host, unit).agg(
            F.sum("weight").alias("_u0"), F.count(F.lit(1)).alias("_k0"), F.max("last_bucket").alias("_last")
        )
        rows = rows.join(units, [host, unit], "left")
        rows = rows.join(initial.select(*key, F.col("weight").alias("_t0")), key, "left").withColumns(
            {"_lu": F.col("_lu") + F.coalesce(F.col("_u0") * grown, F.lit(0.0)), "_lt": F.col("_lt") + F.coalesce(F.col("_t0") * grown, F.lit(0.0))}
        )
        kinds = kinds + F.coalesce("_k0", F.lit(0))
    total = (F.col("_lu") + F.coalesce(F.col("_c__wu"), F.lit(0.0))) / F.col("_w")
    weight = F.col("_lt") / F.col("_w")
    s = surprisal(F.floor(weight + 0.5), F.floor(total + 0.5), kinds, alpha)
    return rows.select(
        *keep,
        total.alias("profile_weight"),
        F.when(total >= cfg.profile_min_weight, s).alias("surprisal_profile"),
    )


def learning_phase(tev: DataFrame, learning_us: int = 600_000_000) -> DataFrame:
    """Add ``in_learning`` and ``learning_remaining_s`` (NULL after it), from the host's first event."""
    first = tev.groupBy("hostname").agg(F.min("ts_us").alias("_first"))
    age = F.col("ts_us") - F.col("_first")
    active = age < learning_us
    remaining = F.call_function("div", F.lit(learning_us).cast("bigint") - age, F.lit(1_000_000).cast("bigint"))
    return (
        tev.join(first, "hostname")
        .withColumn("in_learning", active)
        .withColumn("learning_remaining_s", F.when(active, remaining))
        .drop("_first")
    )


def counter_rate(snapshots: DataFrame, counter: str = "events") -> DataFrame:
    """Events per second between consecutive snapshots of a host (``<counter>_per_sec``)."""
    w = Window.partitionBy("hostname").orderBy("ts_us")
    secs = F.greatest((F.col("ts_us") - F.lag("ts_us").over(w)) / 1e6, F.lit(0.001))
    grown = F.greatest(F.col(counter) - F.lag(counter).over(w), F.lit(0))
    return snapshots.withColumn(f"{counter}_per_sec", grown / secs)


__all__ = [
    "sliding_window_stats",
    "sliding_window_stats_bucketed",
    "rate_z_short",
    "entropy_history",
    "entropy_z",
    "window_surprisal",
    "profile_surprisal",
    "learning_phase",
    "counter_rate",
]
