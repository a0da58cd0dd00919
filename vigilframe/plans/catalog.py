"""Queries over the benchmark tables, each with the equivalent SQL where one exists.

The tables are not logs, so events play journal lines (host = user_id % 4, unit = event type,
template = event type and user_id % 10), documents and pages play notes, parts and suppliers a
graph, nations address ranges.  All queries run over whole tables.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilframe.operators.ordered import plain_unions

HOUR = 3_600_000_000
WINDOW = 6 * HOUR

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its equivalent."""

    def wrap(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return wrap


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from vigilframe.plans import (  # noqa: F401  (registers the queries)
        catalog_checks,
        catalog_geo,
        catalog_graph,
        catalog_inventory,
        catalog_signals,
        catalog_store,
        catalog_stream,
        catalog_text,
    )

    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    all_queries()
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Columns of a table whose rows are costly to process, on all cores."""
    from vigilframe.operators.ordered import spread

    return spread(table(spark, sf_dir, name).select(*cols))


def wall_us(ts: Column) -> Column:
    """Microseconds of a wall-clock timestamp read as UTC, whatever the session time zone is."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in canonical form."""
    from vigilframe.operators.events import canonical_events

    e = table(spark, sf_dir, "events")
    out = e.select(
        (F.col("user_id") % 4).cast("string").alias("hostname"),
        F.col("event_type").alias("unit"),
        F.concat_ws("/", "event_type", (F.col("user_id") % 10).cast("string")).alias("template_id"),
        wall_us(F.col("ts")).alias("ts_us"),
        F.col("event_id").alias("seq"),
        "user_id",
        "value",
    )
    return canonical_events(out)


EV = """ev AS (
  SELECT CAST(user_id % 4 AS VARCHAR) AS hostname, event_type AS unit,
         event_type || '/' || CAST(user_id % 10 AS VARCHAR) AS template_id,
         epoch_us(ts) AS ts_us, event_id AS seq, user_id, value,
         epoch_us(ts) // 3600000000 AS bucket
  FROM events)"""


def r6(c) -> Column:
    """Six digits, no negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def msg(user: str = "user_id", value: str = "value", etype: str = "event_type", eid: str = "event_id") -> Column:
    """A log line made of an event's columns."""
    s = lambda c: F.col(c).cast("string")
    return F.concat(
        F.lit("app["), s(eid), F.lit("]: "), s(etype), F.lit(" by user "), s(user), F.lit(" from 10.0."),
        (F.col(user) % 256).cast("string"), F.lit("."), (F.col(eid) % 256).cast("string"),
        F.lit(", path /api/v"), (F.col(user) % 7).cast("string"), F.lit("/"), s(etype), F.lit(" (took "),
        F.floor(F.col(value)).cast("bigint").cast("string"), F.lit(" ms)"),
    )


MSG = """'app[' || event_id || ']: ' || event_type || ' by user ' || user_id || ' from 10.0.' || (user_id % 256)
  || '.' || (event_id % 256) || ', path /api/v' || (user_id % 7) || '/' || event_type || ' (took '
  || CAST(floor(value) AS BIGINT) || ' ms)'"""
