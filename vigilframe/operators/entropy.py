"""Entropy, medians and counts as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilframe.operators.ordered import CHUNK, CHUNK_ROWS, with_chunks
from vigilframe.functions import (
    bucket_of,
    c_log_c,
    entropy_from_sums,
    max_entropy,
    normalized_entropy,
    robust_z,
)


def shannon_entropy(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Entropy of ``category`` per key: n, distinct, entropy, max_entropy, normalized_entropy.

    Two-level aggregation: counts per (key, category) are combined before the shuffle, so a hot
    key or category costs no more than its number of categories.
    """
    counts = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("_c"))
    sums = counts.groupBy(*keys).agg(
        F.sum("_c").alias("n"),
        F.count(F.lit(1)).alias("distinct"),
        F.sum(c_log_c(F.col("_c"))).alias("_s"),
    )
    h = F.when(F.col("distinct") > 1, entropy_from_sums(F.col("n"), F.col("_s"))).otherwise(F.lit(0.0))
    return (
        sums.withColumn("entropy", h)
        .withColumn("max_entropy", max_entropy(F.col("distinct")))
        .withColumn("normalized_entropy", normalized_entropy(F.col("entropy"), F.col("distinct")))
        .drop("_s")
    )


def bucket_counts(tev: DataFrame, keys: list[str], bucket_us: int) -> DataFrame:
    """Events per key and time bucket (``bucket``, ``count``)."""
    return (
        tev.withColumn("bucket", bucket_of(F.col("ts_us"), bucket_us))
        .groupBy(*keys, "bucket")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def weighted_quantile_mid(
    df: DataFrame, keys: list[str], value: str, weight: Column | None = None, target_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Weighted median per key (``median``): the smallest value reaching half of the total weight.

    Works on distinct values: weights are summed per (key, value) before anything is ordered.  A
    key with very many values is ordered in chunks of its value range.  Ties at exactly half
    average with the next value.
    """
    w = F.lit(1.0) if weight is None else weight
    # A constant key keeps the ungrouped case on the same path.
    key = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    bins = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.sum(w).alias("_w"))
    bins = with_chunks(bins, key, position=F.col(value).cast("double"), target_rows=target_rows)
    parts = bins.groupBy(*key, CHUNK).agg(F.sum("_w").alias("_w"), F.min(value).alias("_lo"))
    ordered = Window.partitionBy(*key).orderBy(CHUNK)
    everything = Window.partitionBy(*key)
    side = parts.select(
        *key, CHUNK,
        F.coalesce(F.sum("_w").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"),
        F.sum("_w").over(everything).alias("_total"),
        F.lead("_lo").over(ordered).alias("_after"),
    )
    local = Window.partitionBy(*key, CHUNK).orderBy(value)
    cum = bins.withColumns(
        {
            "_cum": F.sum("_w").over(local.rowsBetween(Window.unboundedPreceding, 0)),
            "_next": F.lead(value).over(local),
        }
    ).join(side, [*key, CHUNK])
    cum = cum.withColumns({"_cum": F.col("_cum") + F.col("_before"), "_next": F.coalesce("_next", "_after")})
    half = F.col("_total") / 2.0
    exact = (F.abs(F.col("_cum") - half) < 1e-9) & F.col("_next").isNotNull()
    hit = F.when(exact, (F.col(value) + F.col("_next")) / 2.0).otherwise(F.col(value).cast("double"))
    out = (
        cum.where((F.col("_cum") >= half) | exact)
        .withColumn("_hit", hit)
        .groupBy(*key)
        .agg(F.min_by("_hit", value).alias("median"), F.first("_total").alias("total_weight"))
    )
    return out if keys else out.drop("_all")


def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median and MAD per key, from counts of distinct values."""
    med = weighted_quantile_mid(df, keys, value).select(*keys, F.col("median").alias("_med"))
    dev = df.join(med, keys).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))
    out = weighted_quantile_mid(dev, keys, "_dev").select(*keys, F.col("median").alias("mad"))
    return med.withColumnRenamed("_med", "median").join(out, keys)


def smooth_history(df: DataFrame, keys: list[str], order: str, value: str, points: int = 5) -> DataFrame:
    """Trailing mean over at most ``points`` points (``smoothed``)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(points - 1), 0)
    return df.withColumn("smoothed", F.avg(value).over(w))


def series_z(
    df: DataFrame, keys: list[str], order: str, value: str, history: int, min_scale: float
) -> DataFrame:
    """Robust z of each point of a per-key series against its previous ``history`` points."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-history, -1)
    return (
        df.withColumn("_h", F.collect_list(F.col(value).cast("double")).over(w))
        .withColumn("z", robust_z(F.col(value).cast("double"), F.col("_h"), min_scale))
        .drop("_h")
    )
