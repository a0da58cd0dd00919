"""Canonical event columns shared by all signal operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilframe.functions import unit_or_none
from vigilframe.operators.ordered import plain_unions


def canonical_events(
    df: DataFrame,
    ts_us: Column | None = None,
    seq: Column | None = None,
    hostname: Column | None = None,
    unit: Column | None = None,
) -> DataFrame:
    """Add/normalise ``hostname``, ``unit_name``, ``ts_us`` and ``seq`` (never NULL).

    ``seq`` breaks ties between equal timestamps: it is the arrival order and must be unique per
    host.  ``unit_name`` is the unit, or '<none>'.
    """
    plain_unions(df.sparkSession)
    host = hostname if hostname is not None else (
        F.col("hostname") if "hostname" in df.columns else F.lit("")
    )
    unit_col = unit if unit is not None else (
        F.col("unit") if "unit" in df.columns else F.lit(None).cast("string")
    )
    cols = {
        "hostname": F.coalesce(host.cast("string"), F.lit("")),
        "unit": unit_col,
        "unit_name": unit_or_none(unit_col),
    }
    if ts_us is not None:
        cols["ts_us"] = ts_us.cast("bigint")
    if seq is not None:
        cols["seq"] = seq.cast("bigint")
    return df.withColumns(cols)
