"""Decisions on requested actions: allow lists, parameter checks, rate limit."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vigilframe.config import ActionPolicy

# Unit type suffixes an action may name.
UNIT_SUFFIXES = ("service", "socket", "timer", "mount", "target", "path", "slice", "scope")


def action_target(df: DataFrame) -> Column:
    kind = F.col("kind")
    return (
        F.when(kind.isin("restart_unit", "stop_unit"), F.col("unit"))
        .when(kind == "terminate_process", F.col("pid").cast("string"))
        .when(kind == "block_ip", F.col("ip"))
        .otherwise(F.concat_ws("@", F.col("template_id").cast("string"), F.col("unit")))
    )


def validate_action(own_pids: tuple[int, ...] = ()) -> Column:
    """Reason why the parameters of a request row are invalid, or NULL."""
    kind, pid, unit = F.col("kind"), F.col("pid"), F.col("unit")
    kills = kind == "terminate_process"
    names = kind.isin("restart_unit", "stop_unit")
    return (
        F.when(kills & (pid == 0), F.lit("pid 0 is not a process"))
        .when(kills & (pid == 1), F.lit("pid 1 must not be terminated"))
        .when(kills & (pid > 2147483647), F.lit("pid out of range"))
        .when(kills & pid.isin(*own_pids) if own_pids else F.lit(False), F.lit("own process"))
        .when((kind == "mute_anomaly") & (F.octet_length(unit) > 255), F.lit("unit name too long"))
        .when(names & (F.coalesce(unit, F.lit("")) == ""), F.lit("unit name is empty"))
        .when(names & (F.octet_length(unit) > 255), F.lit("unit name too long"))
        .when(names & ~unit.rlike(r"^[A-Za-z0-9:_.@\\-]+\z"), F.lit("unit name has invalid characters"))
        .when(
            names & ~F.element_at(F.split(unit, r"\."), -1).isin(*UNIT_SUFFIXES),
            F.lit("unknown unit type"),
        )
    )


def clamp_action(df: DataFrame, policy: ActionPolicy = ActionPolicy()) -> DataFrame:
    """Bring grace and block durations into their limits; inverted limits are tolerated."""
    lo, hi = policy.min_block_secs, max(policy.max_block_secs, policy.min_block_secs)
    grace = F.least(F.greatest("grace_secs", F.lit(1)), F.lit(max(policy.max_grace_secs, 1)))
    block = F.least(F.greatest("duration_secs", F.lit(lo)), F.lit(hi))
    return df.withColumns(
        {
            "grace_secs": F.when(F.col("grace_secs").isNotNull(), grace),
            "duration_secs": F.when(F.col("duration_secs").isNotNull(), block),
        }
    )


def admitted_until_full(ts: np.ndarray, log: list[int], max_actions: int, window_us: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(admitted, oldest, log) for ascending times ``ts`` after the admitted times ``log``, the oldest first.

    Goes from one admission to the next: while the log is full, all requests until its oldest entry leaves
    are denied at once, found by bisection.  ``oldest`` is that entry for denied requests.
    """
    admitted, oldest = np.zeros(len(ts), bool), np.zeros(len(ts), np.int64)
    i = 0
    while i < len(ts):
        log = [t for t in log if ts[i] - t < window_us]
        if len(log) < max_actions:
            admitted[i] = True
            log.append(int(ts[i]))
            i += 1
            continue
        if not log:  # nothing is ever admitted
            oldest[i:] = ts[i:]
            break
        end = int(np.searchsorted(ts, log[0] + window_us, side="left"))
        oldest[i:end] = log[0]
        i = end
    return admitted, oldest, log


def rate_limit(requests: DataFrame, max_actions: int = 3, window_us: int = 600_000_000) -> DataFrame:
    """Add ``admitted`` and ``retry_after_secs`` per ``rate_key``: sliding log of admitted attempts.

    Sorted by (key, time) and streamed in Arrow batches; per key only the last ``max_actions`` admitted times
    are kept, and Python takes a step per admission and per full log, not per request.
    Input: rate_key, ts_us, seq.
    """
    schema = "rate_key string, ts_us bigint, seq bigint, admitted boolean, retry_after_secs bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, log = None, []
        for pdf in batches:
            keys, ts = pdf["rate_key"].to_numpy(), pdf["ts_us"].to_numpy(np.int64)
            admitted, retry = np.zeros(len(pdf), bool), np.zeros(len(pdf), np.int64)
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1 if len(pdf) else []
            for low, high in zip([0, *cuts], [*cuts, len(pdf)]):
                if high > low and keys[low] != key:
                    key, log = keys[low], []
                admitted[low:high], oldest, log = admitted_until_full(ts[low:high], log, max_actions, window_us)
                retry[low:high] = (window_us - (ts[low:high] - oldest)) // 1_000_000
            out = pdf[["rate_key", "ts_us", "seq"]].copy()
            out["admitted"] = admitted
            out["retry_after_secs"] = pd.array(retry, "Int64")
            out.loc[admitted, "retry_after_secs"] = pd.NA
            yield out

    slim = requests.select("rate_key", "ts_us", "seq")
    flags = slim.repartition("rate_key").sortWithinPartitions("rate_key", "ts_us", "seq").mapInPandas(run, schema)
    return requests.join(flags, ["rate_key", "ts_us", "seq"])


def decide_actions(requests: DataFrame, policy: ActionPolicy = ActionPolicy()) -> DataFrame:
    """Add ``outcome`` (denied / dry_run / approved), ``reason`` and ``retry_after_secs``.

    The first failing check decides: kind, unit, parameters, rate limit.  Only requests that pass
    the first three count towards the limit.  Input: request_id, ts_us, seq, kind, unit, pid, ip,
    grace_secs, duration_secs, template_id.
    """
    not_allowed = ~F.col("kind").isin(*policy.allowed_kinds) if policy.allowed_kinds else F.lit(True)
    named = F.col("kind").isin("restart_unit", "stop_unit")
    unit_ok = F.coalesce(F.col("unit").isin(*policy.allowed_units), F.lit(False)) if policy.allowed_units else F.lit(False)
    checked = requests.withColumn("_bad", validate_action(policy.own_pids)).withColumn(
        "reason",
        F.when(not_allowed | (named & ~unit_ok), F.lit("not_allowed")).when(
            F.col("_bad").isNotNull(), F.concat(F.lit("invalid_parameter: "), F.col("_bad"))
        ),
    ).withColumn("target", action_target(requests)).drop("_bad")
    passed = checked.where(F.col("reason").isNull()).withColumn(
        "rate_key", F.concat_ws(":", "kind", "target")
    )
    limited = rate_limit(passed, policy.max_actions, policy.window_minutes * 60_000_000).withColumn(
        "reason", F.when(~F.col("admitted"), F.lit("rate_limited"))
    ).drop("rate_key", "admitted")
    denied = checked.where(F.col("reason").isNotNull()).withColumn("retry_after_secs", F.lit(None).cast("bigint"))
    done = F.lit("dry_run" if policy.dry_run else "approved")
    return clamp_action(
        limited.unionByName(denied).withColumn(
            "outcome", F.when(F.col("reason").isNotNull(), F.lit("denied")).otherwise(done)
        ),
        policy,
    )


def mutes_from_actions(decisions: DataFrame) -> DataFrame:
    """Approved mute requests as entries for ``mute_filter`` (scope one_hour, one_day, permanent)."""
    hours = F.when(F.col("scope") == "one_hour", 1).when(F.col("scope") == "one_day", 24)
    return decisions.where((F.col("kind") == "mute_anomaly") & (F.col("outcome") == "approved")).select(
        "hostname", "template_id", "unit", F.col("ts_us").alias("from_us"),
        (F.col("ts_us") + hours * 3_600_000_000).alias("until_us"),
    )


def suppressions_from_actions(decisions: DataFrame, policy: ActionPolicy = ActionPolicy()) -> DataFrame:
    """Approved unit and process actions as entries for ``self_filter``."""
    kind = F.col("kind")
    return decisions.where(
        kind.isin("restart_unit", "stop_unit", "terminate_process") & (F.col("outcome") == "approved")
    ).select(
        "hostname",
        F.when(kind == "terminate_process", F.lit("pid")).otherwise(F.lit("unit")).alias("kind"),
        F.when(kind == "terminate_process", F.col("pid").cast("string")).otherwise(F.col("unit")).alias("key"),
        F.col("ts_us").alias("from_us"),
        (F.col("ts_us") + policy.self_filter_seconds * 1_000_000).alias("until_us"),
    )
