"""SQL names for the scalar functions, so they can be used in query text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from vigilframe.functions.masking import MASK_CLASSES, PUNCT

_FNV_SQL = """
  aggregate(
    transform(filter(split(decode(cast(value AS BINARY), 'ISO-8859-1'), ''), c -> length(c) > 0),
              c -> cast(ascii(c) AS BIGINT)),
    named_struct('hi', 3421674724, 'lo', 2216829733),
    (acc, byte) -> named_struct(
      'hi', (acc.hi * 435 + shiftright((acc.lo ^ byte) * 435, 32) + shiftleft(acc.lo ^ byte, 8)) & 4294967295,
      'lo', ((acc.lo ^ byte) * 435) & 4294967295),
    acc -> shiftleft(acc.hi, 32) | acc.lo)
"""

_Z_SQL = """
  CASE WHEN size(history) <= 0 THEN 0.0D ELSE
    greatest(-50.0D, least(50.0D,
      (value - (array_sort(history)[cast((size(history) - 1) div 2 AS INT)]
              + array_sort(history)[cast(size(history) div 2 AS INT)]) / 2.0D)
      / greatest(min_scale,
          (array_sort(transform(history, h -> abs(h - (array_sort(history)[cast((size(history) - 1) div 2 AS INT)]
              + array_sort(history)[cast(size(history) div 2 AS INT)]) / 2.0D)))[cast((size(history) - 1) div 2 AS INT)]
         + array_sort(transform(history, h -> abs(h - (array_sort(history)[cast((size(history) - 1) div 2 AS INT)]
              + array_sort(history)[cast(size(history) div 2 AS INT)]) / 2.0D)))[cast(size(history) div 2 AS INT)])
          / 2.0D / 0.6745D))) END
"""


def _mask_sql() -> str:
    def quote(pattern: str) -> str:
        # raw SQL string literals keep backslashes; single quotes are written as \x27
        return "r'" + pattern.replace("'", r"\x27") + "'"

    split = rf"(?s)^({PUNCT}*)(.*?)({PUNCT}*)\z"
    core = f"regexp_extract(tok, {quote(split)}, 2)"
    arms = []
    for name, pattern in MASK_CLASSES:
        value = (
            f"concat(regexp_extract({core}, {quote(pattern)}, 1), '[<PID>]')"
            if name == "PID"
            else f"'<{name}>'"
        )
        arms.append(f"WHEN {core} RLIKE {quote(pattern)} THEN {value}")
    return (
        f"transform(filter(split(message, {quote(r'(?U)\s+')}), t -> t <> ''), tok -> "
        f"CASE WHEN NOT tok RLIKE {quote(r'(?U)[\d:/\-]')} THEN tok ELSE "
        f"concat(regexp_extract(tok, {quote(split)}, 1), CASE {' '.join(arms)} ELSE {core} END, "
        f"regexp_extract(tok, {quote(split)}, 3)) END)"
    )


def register_sql_functions(spark: SparkSession) -> None:
    """Create the temporary SQL functions fnv1a64, mask_tokens, surprisal, robust_z and slot_of."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fnv1a64(value STRING) RETURNS BIGINT RETURN {_FNV_SQL}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION mask_tokens(message STRING) RETURNS ARRAY<STRING> "
        f"RETURN {_mask_sql()}"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION surprisal(cnt DOUBLE, total DOUBLE, kinds DOUBLE, alpha DOUBLE) "
        "RETURNS DOUBLE RETURN -log2(least(1.0D, greatest(2.2250738585072014E-308D, "
        "(cnt + alpha) / (total + alpha * (kinds + 1.0D))))) + 0.0D"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION robust_z(value DOUBLE, history ARRAY<DOUBLE>, min_scale DOUBLE) "
        f"RETURNS DOUBLE RETURN {_Z_SQL}"
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION slot_of(ts_us BIGINT, tz STRING) RETURNS INT RETURN "
        "cast((unix_micros(from_utc_timestamp(timestamp_micros(ts_us), tz)) div 3600000000) % 24 * 2 + "
        "CASE WHEN ((unix_micros(from_utc_timestamp(timestamp_micros(ts_us), tz)) div 86400000000) + 4) % 7 "
        "IN (0, 6) THEN 1 ELSE 0 END AS INT)"
    )
