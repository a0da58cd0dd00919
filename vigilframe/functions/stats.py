"""Robust statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the scoring model.
MAD_TO_SIGMA = 0.6745
Z_SATURATION = 50.0
COUNT_MIN_SCALE = 1.0
ENTROPY_MIN_SCALE = 0.15


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (an expression inside a lambda would be
    evaluated again for every element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clamp(v: Column, lo, hi) -> Column:
    """Clamp that keeps NULL (``least``/``greatest`` alone would skip it)."""
    return F.when(v.isNotNull(), F.least(F.greatest(v, _col(lo)), _col(hi)))


def median_sorted(arr: Column) -> Column:
    """Median of an ascending array<double>; NULL when empty."""
    n = F.size(arr)
    mid = F.floor(n / 2).cast("int")
    return (
        F.when(n <= 0, F.lit(None).cast("double"))
        .when(n % 2 == 0, (F.get(arr, mid - 1) + F.get(arr, mid)) / 2.0)
        .otherwise(F.get(arr, mid))
    )


def median(arr: Column) -> Column:
    """Mean of the middle two values; NULL when empty."""
    return let(F.array_sort(arr), median_sorted)


def mad(arr: Column, med: Column | None = None) -> Column:
    """Median of the absolute deviations from the median."""
    return let(
        median(arr) if med is None else med,
        lambda m: let(F.array_sort(F.transform(arr, lambda x: F.abs(x - m))), median_sorted),
    )


def count_scale_floor(med: Column) -> Column:
    """Poisson-aware smallest scale for a history of counts with this median."""
    return F.greatest(
        F.sqrt(F.greatest(F.coalesce(med, F.lit(0.0)), F.lit(0.0)) + 1.0), F.lit(COUNT_MIN_SCALE)
    )


def z_from_median_mad(value: Column, med: Column, mad_: Column, min_scale) -> Column:
    """(v - median) / max(MAD / 0.6745, min_scale), clamped to +-50; NULL if the median is."""
    scale = F.greatest(mad_ / MAD_TO_SIGMA, _col(min_scale), F.lit(2.2250738585072014e-308))
    return clamp((value - med) / scale, -Z_SATURATION, Z_SATURATION)


def robust_z(value: Column, history: Column, min_scale) -> Column:
    """Robust z-score of ``value`` against an array<double>; 0 for an empty history."""
    z = let(median(history), lambda m: z_from_median_mad(value, m, mad(history, m), min_scale))
    return F.coalesce(z, F.lit(0.0))


def surprisal(count: Column, total: Column, distinct: Column, alpha: float = 0.5) -> Column:
    """-log2 of the smoothed template probability, always finite."""
    a = max(alpha, 2.220446049250313e-16)
    p = (count + a) / (total + a * (distinct + 1.0))
    return -F.log2(clamp(p, 2.2250738585072014e-308, 1.0)) + 0.0


def entropy_from_sums(n: Column, sum_c_log_c: Column) -> Column:
    """Shannon entropy in bits from N and sum(c*log2 c); 0 when N is 0, never -0."""
    return F.when(n > 0, F.greatest(F.log2(n) - sum_c_log_c / n, F.lit(0.0))).otherwise(F.lit(0.0))


def c_log_c(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def max_entropy(distinct: Column) -> Column:
    return F.when(distinct > 1, F.log2(distinct)).otherwise(F.lit(0.0))


def normalized_entropy(entropy: Column, distinct: Column) -> Column:
    return F.when(distinct > 1, clamp(entropy / F.log2(distinct), 0.0, 1.0)).otherwise(F.lit(0.0))


def normalize_component(value: Column, reference: float) -> Column:
    """Map a raw signal to 0..1 by its reference value."""
    if reference <= 0:
        return F.lit(0.0)
    return clamp(value / F.lit(float(reference)), 0.0, 1.0)


def noisy_or(*signals: tuple[float, Column]) -> Column:
    """1 - prod(1 - w*c) with weights and components clamped to 0..1."""
    rest = F.lit(1.0)
    for weight, component in signals:
        rest = rest * (1.0 - clamp(component, 0.0, 1.0) * float(min(max(weight, 0.0), 1.0)))
    return clamp(1.0 - rest, 0.0, 1.0)


def weighted_median(bins: Column) -> Column:
    """Weighted median of array<struct<value double, weight double>>.

    Smallest value whose cumulative weight reaches half of the total; when it lands exactly on
    half (1e-9), the mean with the next larger value.  NULL for zero total weight.
    """
    start = F.struct(
        F.lit(0.0).alias("cum"),
        F.lit(None).cast("double").alias("first"),
        F.lit(None).cast("double").alias("result"),
    )

    def step(acc: Column, b: Column, half: Column) -> Column:
        cum = acc["cum"] + b["weight"]
        hit_now = acc["first"].isNull() & (cum >= half)
        exact = F.abs(cum - half) < 1e-9
        return F.struct(
            cum.alias("cum"),
            F.coalesce(acc["first"], F.when(hit_now, b["value"])).alias("first"),
            F.coalesce(
                acc["result"],
                F.when(hit_now & ~exact, b["value"]),
                F.when(acc["first"].isNotNull(), (acc["first"] + b["value"]) / 2.0),
            ).alias("result"),
        )

    def fold(total: Column) -> Column:
        folded = F.aggregate(
            F.array_sort(bins),
            start,
            lambda acc, b: step(acc, b, total / 2.0),
            lambda acc: F.coalesce(acc["result"], acc["first"]),
        )
        return F.when(total > 0, folded)

    return let(F.aggregate(bins, F.lit(0.0), lambda acc, b: acc + b["weight"]), fold)


def weighted_mad(bins: Column, med: Column) -> Column:
    """Weighted median of absolute deviations from ``med``."""
    return let(
        med,
        lambda m: let(
            F.transform(
                bins,
                lambda b: F.struct(F.abs(b["value"] - m).alias("value"), b["weight"].alias("weight")),
            ),
            weighted_median,
        ),
    )
