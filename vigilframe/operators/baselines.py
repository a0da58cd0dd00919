"""Time-of-week baselines and unit profiles, fitted with aggregations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilframe.config import BaselineConfig
from vigilframe.functions import (
    ANY_SLOT,
    bucket_of,
    count_scale_floor,
    slot_of,
    weighted_mad,
    weighted_median,
    z_from_median_mad,
)
from vigilframe.operators.ordered import top_n_per_group

HOST, UNIT, TPL = "hostname", "unit_name", "template_id"


def unit_buckets(tev: DataFrame, bucket_us: int, tz: str = "UTC") -> DataFrame:
    """Active buckets per unit (``bucket``, ``slot``) that are closed: the unit was seen later too.

    The slot is that of the event which opened the bucket.
    """
    active = (
        tev.withColumn("bucket", bucket_of(F.col("ts_us"), bucket_us))
        .groupBy(HOST, UNIT, "bucket")
        .agg(F.min("ts_us").alias("_open"))
    )
    last = active.groupBy(HOST, UNIT).agg(F.max("bucket").alias("_last"))
    return (
        active.join(last, [HOST, UNIT])
        .where(F.col("bucket") < F.col("_last"))
        .select(HOST, UNIT, "bucket", slot_of(F.col("_open"), tz).alias("slot"))
    )


def _with_any_slot(df: DataFrame) -> DataFrame:
    return df.withColumn("slot", F.explode(F.array(F.col("slot"), F.lit(ANY_SLOT))))


def fit_slot_baselines(
    tev: DataFrame, bucket_us: int = 5_000_000, cfg: BaselineConfig = BaselineConfig()
) -> DataFrame:
    """Decayed histogram of bucket counts per (host, unit, template, slot), slot 48 = all hours.

    Columns: ``bins`` array<struct<value double, weight double>> in ascending value, ``weight``
    (total), ``last_bucket``.  In every closed active bucket of a unit each template known by then
    has one observation, its count or zero.  Zeros are not materialised: their weight is the
    weight of the unit's buckets since the template's first one, minus that of its non-zero ones.
    """
    hl = cfg.half_life_buckets(bucket_us // 1_000_000)
    closed = _with_any_slot(unit_buckets(tev, bucket_us, cfg.tz))
    base = closed.groupBy(HOST).agg(F.min("bucket").alias("_b0"))
    weight = F.pow(F.lit(2.0), (F.col("bucket") - F.col("_b0")) / F.lit(hl))
    closed = closed.join(base, HOST).withColumn("_w", weight)
    # Decay refers to the last bucket in which this histogram was touched.
    last = closed.groupBy(HOST, UNIT, "slot").agg(
        F.max("bucket").alias("last_bucket"), F.max("_w").alias("_wl")
    )

    counts = (
        tev.withColumn("bucket", bucket_of(F.col("ts_us"), bucket_us))
        .groupBy(HOST, UNIT, TPL, "bucket")
        .agg(F.count(F.lit(1)).alias("value"))
    )
    nonzero = (
        counts.join(closed, [HOST, UNIT, "bucket"])
        .groupBy(HOST, UNIT, TPL, "slot", "value")
        .agg(F.sum("_w").alias("_w"))
    )
    nz_total = nonzero.groupBy(HOST, UNIT, TPL, "slot").agg(F.sum("_w").alias("_nz"))

    # Weight of the unit's buckets from the template's first bucket on, per slot: the first buckets
    # are put as weightless marks on the unit's timeline and read off a running sum from the end.
    # A timeline has one row per bucket of calendar time plus one mark per template.
    first = counts.groupBy(HOST, UNIT, TPL).agg(F.min("bucket").alias("bucket"))
    slots = last.select(HOST, UNIT, "slot")
    marks = first.join(slots, [HOST, UNIT]).select(
        HOST, UNIT, "slot", "bucket", TPL, F.lit(0.0).alias("_w"), F.lit(True).alias("_mark")
    )
    timeline = closed.select(
        HOST, UNIT, "slot", "bucket", F.lit(None).cast(tev.schema[TPL].dataType).alias(TPL), "_w",
        F.lit(False).alias("_mark"),
    ).unionByName(marks)
    from_end = (
        Window.partitionBy(HOST, UNIT, "slot")
        .orderBy(F.col("bucket").desc())
        .rangeBetween(Window.unboundedPreceding, 0)
    )
    since_first = (
        timeline.withColumn("_since", F.sum("_w").over(from_end))
        .where(F.col("_mark"))
        .select(HOST, UNIT, TPL, "slot", "_since")
    )
    zeros = (
        since_first.join(nz_total, [HOST, UNIT, TPL, "slot"], "left")
        .withColumn("_w", F.col("_since") - F.coalesce(F.col("_nz"), F.lit(0.0)))
        # Differences of equal sums leave rounding noise, not weight.
        .where((F.col("_since") > 0) & (F.col("_w") > F.col("_since") * 1e-12))
        .select(HOST, UNIT, TPL, "slot", F.lit(0).cast("bigint").alias("value"), "_w")
    )
    bins = (
        nonzero.unionByName(zeros)
        .join(last, [HOST, UNIT, "slot"])
        .withColumn("weight", F.col("_w") / F.col("_wl"))
    )
    return collect_bins(bins, cfg)


def cap_bins(bins: DataFrame, max_bins: int) -> DataFrame:
    """Fold the weight of values beyond the ``max_bins`` smallest into the largest kept value.

    ``bins``: one row per (host, unit, template, slot, value).  Values are counts per bucket, so a
    histogram has few of them.  Independent of arrival order.
    """
    keys = [HOST, UNIT, TPL, "slot"]
    w = Window.partitionBy(*keys).orderBy("value")
    ranked = bins.withColumn("_r", F.row_number().over(w))
    folded = F.when(F.col("_r") <= max_bins, F.col("value"))
    limit = F.max(F.when(F.col("_r") <= max_bins, F.col("value"))).over(Window.partitionBy(*keys))
    return (
        ranked.withColumn("value", F.coalesce(folded, limit))
        .groupBy(*keys, "value")
        .agg(F.sum("weight").alias("weight"), F.max("last_bucket").alias("last_bucket"))
    )


def prune_negligible(df: DataFrame, threshold: float) -> DataFrame:
    return df.where(F.col("weight") >= threshold)


def collect_bins(bins: DataFrame, cfg: BaselineConfig = BaselineConfig()) -> DataFrame:
    """Long bins to one row per histogram; bins are pruned or folded only where ``cfg`` asks for it."""
    kept = bins if cfg.negligible_weight is None else prune_negligible(bins, cfg.negligible_weight)
    kept = kept if cfg.max_bins is None else cap_bins(kept, cfg.max_bins)
    return kept.groupBy(HOST, UNIT, TPL, "slot").agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("value").cast("double").alias("value"), "weight"))
        ).alias("bins"),
        F.sum("weight").alias("weight"),
        F.max("last_bucket").alias("last_bucket"),
    )


def slot_statistics(baselines: DataFrame) -> DataFrame:
    """Add weighted ``median`` and ``mad`` of each histogram."""
    return baselines.withColumn("median", weighted_median(F.col("bins"))).withColumn(
        "mad", weighted_mad(F.col("bins"), F.col("median"))
    )


def fit_unit_profiles(
    tev: DataFrame, bucket_us: int = 5_000_000, cfg: BaselineConfig = BaselineConfig()
) -> DataFrame:
    """Decayed weight per (host, unit, template) as of the unit's last event.

    Columns: ``weight``, ``last_bucket`` (of the unit).  All templates, unless ``cfg`` sets a least
    weight or keeps only the heaviest ``profile_max_templates`` of a unit.
    """
    hl = cfg.half_life_buckets(bucket_us // 1_000_000)
    counts = (
        tev.withColumn("bucket", bucket_of(F.col("ts_us"), bucket_us))
        .groupBy(HOST, UNIT, TPL, "bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    last = counts.groupBy(HOST, UNIT).agg(F.max("bucket").alias("last_bucket"))
    weights = (
        counts.join(last, [HOST, UNIT])
        .withColumn("_w", F.col("_n") * F.pow(F.lit(0.5), (F.col("last_bucket") - F.col("bucket")) / F.lit(hl)))
        .groupBy(HOST, UNIT, TPL)
        .agg(F.sum("_w").alias("weight"), F.max("last_bucket").alias("last_bucket"))
    )
    if cfg.negligible_weight is not None:
        weights = prune_negligible(weights, cfg.negligible_weight)
    if cfg.profile_max_templates is None:
        return weights
    kept = top_n_per_group(
        weights,
        [HOST, UNIT],
        [F.col("weight").desc(), F.col(TPL)],
        cfg.profile_max_templates,
        [TPL],
    )
    return kept.drop("rank")


def trusted_baselines(
    baselines: DataFrame, profiles: DataFrame | None = None, cfg: BaselineConfig = BaselineConfig()
) -> DataFrame:
    """Per host: ``trusted`` if any histogram or profile carries enough weight (learning is skipped)."""
    rows = baselines.groupBy(HOST).agg(F.max(F.col("weight") >= cfg.min_weight).alias("trusted"))
    if profiles is not None:
        per_unit = profiles.groupBy(HOST, UNIT).agg(F.sum("weight").alias("weight"))
        rows = rows.unionByName(
            per_unit.groupBy(HOST).agg(F.max(F.col("weight") >= cfg.profile_min_weight).alias("trusted"))
        )
    return rows.groupBy(HOST).agg(F.max("trusted").alias("trusted"))


def enforce_limits(baselines: DataFrame, max_baselines: int = 20_000) -> DataFrame:
    """Keep the ``max_baselines`` heaviest histograms per host."""
    return top_n_per_group(
        baselines,
        [HOST],
        [F.col("weight").desc(), F.col(UNIT), F.col(TPL), F.col("slot")],
        max_baselines,
        [UNIT, TPL, "slot"],
    ).drop("rank")


def enforce_profile_limits(profiles: DataFrame, max_units: int = 20_000) -> DataFrame:
    """Keep the profiles of the ``max_units`` most recently active units per host."""
    units = profiles.groupBy(HOST, UNIT).agg(F.max("last_bucket").alias("_last"))
    kept = top_n_per_group(units, [HOST], [F.col("_last").desc(), F.col(UNIT)], max_units, [UNIT])
    return profiles.join(kept.select(HOST, UNIT), [HOST, UNIT], "left_semi")


def baseline_rate_z(
    tev: DataFrame,
    baselines: DataFrame,
    count: str = "unit_bucket_count",
    cfg: BaselineConfig = BaselineConfig(),
) -> DataFrame:
    """Add ``slot_z`` and ``any_z``: the open bucket's count against the trusted histogram of the
    event's own slot and of all hours; NULL where there is none."""
    stats = slot_statistics(baselines.where(F.col("weight") >= cfg.min_weight)).select(
        HOST, UNIT, TPL, "slot", "median", "mad"
    )
    # One row per template: its 49 slots as a map, so that the events are joined once.
    by_tpl = stats.groupBy(HOST, UNIT, TPL).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", F.struct("median", "mad")))).alias("_slots")
    )

    def z(slot: Column) -> Column:
        s = F.try_element_at(F.col("_slots"), slot)
        return z_from_median_mad(F.col(count).cast("double"), s["median"], s["mad"], count_scale_floor(s["median"]))

    return (
        tev.join(by_tpl, [HOST, UNIT, TPL], "left")
        .withColumn("slot_z", z(slot_of(F.col("ts_us"), cfg.tz)))
        .withColumn("any_z", z(F.lit(ANY_SLOT)))
        .drop("_slots")
    )


def profile_lookup(
    tev: DataFrame, profiles: DataFrame, alpha: float = 0.5, cfg: BaselineConfig = BaselineConfig()
) -> DataFrame:
    """Add ``surprisal_profile`` from stored profiles (of an earlier run); NULL if untrusted."""
    from vigilframe.functions import surprisal

    units = profiles.groupBy(HOST, UNIT).agg(
        F.sum("weight").alias("_total"), F.count(F.lit(1)).alias("_kinds")
    )
    weights = profiles.select(HOST, UNIT, TPL, F.col("weight").alias("_weight"))
    s = surprisal(
        F.floor(F.coalesce(F.col("_weight"), F.lit(0.0)) + 0.5),
        F.floor(F.col("_total") + 0.5),
        F.col("_kinds"),
        alpha,
    )
    return (
        tev.join(units, [HOST, UNIT], "left")
        .join(weights, [HOST, UNIT, TPL], "left")
        .withColumn("surprisal_profile", F.when(F.col("_total") >= cfg.profile_min_weight, s))
        .drop("_total", "_kinds", "_weight")
    )
