"""Journal lines (NDJSON) to typed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_FIELDS = (
    "__REALTIME_TIMESTAMP STRING, _SYSTEMD_UNIT STRING, UNIT STRING, _PID STRING, PRIORITY STRING, "
    "_HOSTNAME STRING, MESSAGE STRING, _corrupt STRING"
)
#: A message that is an array, not a string that looks like one.
BYTES = r'"MESSAGE"\s*:\s*\['


def read_journal(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Parsed journal lines of a text file or folder; bad lines are kept with an ``error``."""
    reader = spark.readStream if streaming else spark.read
    return parse_journal(reader.text(path))


def parse_journal(lines: DataFrame, column: str = "value") -> DataFrame:
    """Typed events from JSON text.  Blank lines are skipped.

    ``error`` is 'invalid_json' or 'missing_timestamp', else NULL.  Numbers arrive as strings; an
    optional one that cannot be parsed is NULL.  MESSAGE is a string or an array of byte values
    (read as UTF-8 with replacement characters); without it the message is ''.
    """
    raw = F.trim(F.col(column))
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    # Parsed once: MESSAGE as a string, in which an array of bytes stands as its JSON text.
    said = F.col("_j").getField("MESSAGE")
    parsed = lines.where(~F.col(column).rlike(r"^\s*\z")).withColumn("_j", F.from_json(raw, _FIELDS, opts)).withColumns(
        {"_s": said, "_bytes": F.when(said.rlike(r"(?s)^\[.*\]\z") & raw.rlike(BYTES), F.from_json(said, "ARRAY<INT>"))}
    )
    binary = F.col("_bytes").isNotNull()
    as_hex = F.array_join(
        F.transform("_bytes", lambda b: F.lpad(F.hex(b.bitwiseAND(F.lit(255))), 2, "0")), ""
    )
    text = F.make_valid_utf8(F.unhex(as_hex).cast("string"))
    j = lambda name: F.col("_j").getField(name)
    number = F.when(j("__REALTIME_TIMESTAMP").rlike(r"^\+?[0-9]+\z"), j("__REALTIME_TIMESTAMP"))
    ts_us = number.try_cast("bigint")
    invalid = F.col("_j").isNull() | j("_corrupt").isNotNull() | ~raw.rlike(r"(?s)^\{.*\}\z")
    pid = F.when(j("_PID").rlike(r"^[+-]?[0-9]+\z"), j("_PID")).try_cast("int")
    priority = F.when(j("PRIORITY").rlike(r"^\+?[0-9]+\z"), j("PRIORITY")).try_cast("smallint")
    return parsed.select(
        *[c for c in lines.columns if c != column],
        ts_us.alias("ts_us"),
        F.timestamp_micros(ts_us).alias("ts"),
        j("_SYSTEMD_UNIT").alias("unit"),
        j("UNIT").alias("unit_field"),
        pid.alias("pid"),
        F.when(priority.between(0, 255), priority).alias("priority"),
        F.coalesce(F.when(binary, text).otherwise(F.col("_s")), F.lit("")).alias("message"),
        F.coalesce(binary, F.lit(False)).alias("message_was_binary"),
        j("_HOSTNAME").alias("hostname"),
        F.when(invalid, F.lit("invalid_json"))
        .when(ts_us.isNull(), F.lit("missing_timestamp"))
        .alias("error"),
        F.col(column).alias("line"),
    )


_EVENT_COLUMNS = {
    "ts_us", "ts", "unit", "unit_field", "pid", "priority", "message", "message_was_binary", "hostname", "error", "line",
}


def split_parse_errors(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, errors): good rows without the error columns; bad rows as (error, line, hostname) with the
    columns that came with the lines."""
    good = parsed.where(F.col("error").isNull()).drop("error", "line")
    own = [c for c in parsed.columns if c not in _EVENT_COLUMNS]
    bad = parsed.where(F.col("error").isNotNull()).select("error", "line", "hostname", *own)
    return good, bad
