"""Presence over time: sessions, outages, devices, context lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vigilframe.functions import bucket_of
from vigilframe.operators.ordered import CHUNK, carry_in, prefix_sums, top_n_per_group, with_chunks


def sessions(df: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Sessions of sightings at most ``gap_us`` apart (exclusive): first/last seen, sightings.

    Sightings are first combined per slice of at most one gap, within which no session can break;
    a key then has at most one row per slice of calendar time.
    """
    slices = (
        df.withColumn("_slice", bucket_of(F.col("ts_us"), max(gap_us, 1)))
        .groupBy(*keys, "_slice")
        .agg(F.min("ts_us").alias("_lo"), F.max("ts_us").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    )
    w = Window.partitionBy(*keys).orderBy("_slice")
    opens = F.coalesce(F.col("_lo") - F.lag("_hi").over(w) >= gap_us, F.lit(True)).cast("bigint")
    numbered = slices.withColumn("_open", opens).withColumn(
        "session", F.sum("_open").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(*keys, "session").agg(
        F.min("_lo").alias("first_seen_us"), F.max("_hi").alias("last_seen_us"), F.sum("_n").alias("sightings")
    )


def connection_sessions(sightings: DataFrame, hold_us: int = 20_000_000) -> DataFrame:
    """A remote (hostname, ip) disappears when unseen for the hold time."""
    return sessions(sightings, ["hostname", "ip"], hold_us)


def router_outage(pings: DataFrame, failures: int = 2, target_rows: int = 4_000_000) -> DataFrame:
    """Add ``failures`` in a row so far and ``offline`` (from the given number on).

    Failures in a row = failures so far minus those at the last success: one running sum and one
    running maximum over chunks of the host's timeline.
    """
    rows = prefix_sums(
        with_chunks(pings, ["hostname"], target_rows=target_rows),
        ["hostname"],
        ["ts_us", "seq"],
        {"_f": F.when(F.col("reachable"), 0).otherwise(1).cast("bigint")},
    )
    at_success = F.when(F.col("reachable"), F.col("_f"))
    base = carry_in(rows.groupBy("hostname", CHUNK).agg(F.max(at_success).alias("_m")), ["hostname"], ["_m"], F.max)
    w = Window.partitionBy("hostname", CHUNK).orderBy("ts_us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_m", F.max(at_success).over(w)).join(base, ["hostname", CHUNK])
    run = F.col("_f") - F.coalesce("_m", "_c__m", F.lit(0))
    return out.select(*pings.columns, run.alias("failures"), (run >= failures).alias("offline"))


def device_registry(
    sightings: DataFrame, now_us: int, retention_us: int = 7 * 86_400_000_000, cap: int | None = None
) -> DataFrame:
    """Known devices per (hostname, mac): latest ip, last known name (else the first ip), seen span.

    A device unseen for longer than the retention is forgotten and starts anew.  With ``cap``,
    only that many devices of a host, those seen last.
    """
    key = ["hostname", "mac"]
    # Names and addresses are reduced per day first; sessions are made of days' summaries.
    spans = sessions(sightings, key, retention_us + 1)
    last = spans.groupBy(*key).agg(F.max_by(F.struct("first_seen_us", "last_seen_us"), "session").alias("_s"))
    current = last.select(*key, "_s.first_seen_us", "_s.last_seen_us").where(
        F.col("last_seen_us") >= now_us - retention_us
    )
    order = F.struct("ts_us", "seq")
    names = (
        sightings.join(current, key)
        .where(F.col("ts_us") >= F.col("first_seen_us"))
        .groupBy(*key)
        .agg(
            F.max_by("ip", order).alias("ip"),
            F.max_by("display_name", F.when(F.col("display_name").isNotNull(), order)).alias("_name"),
            F.min_by("ip", order).alias("_first_ip"),
        )
    )
    devices = current.join(names, key).select(
        *key, "ip", F.coalesce("_name", "_first_ip").alias("display_name"), "first_seen_us", "last_seen_us"
    )
    if cap is None:
        return devices
    return top_n_per_group(devices, ["hostname"], [F.col("last_seen_us").desc(), F.col("mac")], cap, ["mac"]).drop("rank")


def context_lines(
    ev: DataFrame,
    anchors: DataFrame,
    before: int = 25,
    after: int = 25,
    by_unit: bool = False,
    max_lines: int | None = None,
    target_rows: int = 4_000_000,
) -> DataFrame:
    """Lines around each anchor (hostname, anchor_id, anchor_us[, unit_name]): the nearest event and
    its neighbours in arrival order.

    Adds ``anchor_id``, ``offset`` (0 = nearest; ties go to the earlier event) and ``truncated``.
    Positions are running counts over chunks; an anchor finds its place by riding along as a row
    of weight zero.  Only the wanted positions are then joined, before + after + 1 per anchor.
    """
    if max_lines is not None:
        before, after = min(before, max_lines), min(after, max_lines)
    keys = ["hostname", "unit_name"] if by_unit else ["hostname"]
    cols = ev.columns
    marks = anchors.select(
        *keys, F.col("anchor_us").alias("ts_us"), F.lit((1 << 62)).alias("seq"), "anchor_id", F.lit(0).cast("bigint").alias("_w")
    )
    slim = ev.select(*keys, "ts_us", "seq", F.lit(None).cast(anchors.schema["anchor_id"].dataType).alias("anchor_id"), F.lit(1).cast("bigint").alias("_w"))
    both = slim.unionByName(marks).withColumn("_last", F.col("_w") == 0)
    numbered = prefix_sums(
        with_chunks(both.withColumn("_s", F.when(F.col("_last"), F.lit(0)).otherwise(F.col("seq"))), keys, seq="_s", at_end="_last", target_rows=target_rows),
        keys,
        ["ts_us", "seq", "anchor_id"],
        {"_rn": F.col("_w")},
    )
    events = numbered.where(F.col("_w") == 1).select(*keys, "ts_us", "seq", "_rn")
    # First position among events of one timestamp: ties in time go to the earlier event.
    firsts = events.groupBy(*keys, "ts_us").agg(F.min("_rn").alias("_first"))
    at = numbered.where(F.col("_w") == 0).select(*keys, "anchor_id", F.col("ts_us").alias("anchor_us"), "_rn")
    size = events.groupBy(*keys).agg(F.max("_rn").alias("_n"))
    pos = events.select(*keys, F.col("ts_us").alias("_t"), "_rn")
    near = (
        at.join(pos.withColumnRenamed("_t", "_prev"), [*keys, "_rn"], "left")
        .withColumn("_rn1", F.col("_rn") + 1)
        .join(pos.select(*keys, F.col("_rn").alias("_rn1"), F.col("_t").alias("_next")), [*keys, "_rn1"], "left")
        .withColumn(
            "_best",
            F.when(F.col("_next").isNull(), F.col("_prev"))
            .when(F.col("_prev").isNull(), F.col("_next"))
            .when(F.col("anchor_us") - F.col("_prev") <= F.col("_next") - F.col("anchor_us"), F.col("_prev"))
            .otherwise(F.col("_next")),
        )
        .join(firsts.withColumnRenamed("ts_us", "_best"), [*keys, "_best"])
        .join(size, keys)
    )
    wanted = near.select(
        *keys,
        "anchor_id",
        ((F.col("_first") - 1 < before) | (F.col("_n") - F.col("_first") < after)).alias("truncated"),
        "_first",
        F.explode(
            F.sequence(F.greatest(F.col("_first") - before, F.lit(1)), F.least(F.col("_first") + after, F.col("_n")))
        ).alias("_rn"),
    )
    lines = ev.join(events, [*keys, "ts_us", "seq"])
    return lines.join(wanted, [*keys, "_rn"]).select(
        *cols, "anchor_id", (F.col("_rn") - F.col("_first")).alias("offset"), "truncated"
    )
