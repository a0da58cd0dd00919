"""Collected text of many hosts: rows (hostname, collected_at, line_no, line) to typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vigilframe.functions import hex_le_ipv4, ipv4_to_long, is_ipv4, is_routable_public

_KEYS = ("hostname", "collected_at")
ESTABLISHED = "01"  # fixed value: kernel code of an established connection


def _fields(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def read_socket_table(df: DataFrame) -> DataFrame:
    """Kernel TCP table (header in line 0): established connections to public addresses.

    Columns: hostname, collected_at, ip, ip_num, inode.
    """
    rows = df.where(F.col("line_no") > 0).withColumn("_f", _fields(F.col("line")))
    parts = F.split(F.get("_f", F.lit(2)), ":")
    ip = F.when(F.size(parts) >= 2, hex_le_ipv4(F.get(parts, F.lit(0))))
    return (
        rows.where(F.get("_f", F.lit(3)) == ESTABLISHED)
        .select(
            *_KEYS, ip.alias("ip"), ipv4_to_long(ip).alias("ip_num"),
            F.get("_f", F.lit(9)).try_cast("bigint").alias("inode"),
        )
        .where(is_routable_public(F.col("ip_num")))
    )


def read_default_gateway(df: DataFrame) -> DataFrame:
    """Gateway of the first default route per collection (header in line 0); none = no row."""
    f = _fields(F.col("line"))
    rows = df.where(F.col("line_no") > 0).select(
        *_KEYS, "line_no", F.get(f, F.lit(1)).alias("_dest"), hex_le_ipv4(F.get(f, F.lit(2))).alias("_gw")
    )
    return (
        rows.where((F.col("_dest") == "00000000") & F.col("_gw").isNotNull())
        .groupBy(*_KEYS)
        .agg(F.min_by("_gw", "line_no").alias("gateway"))
    )


def read_neighbors(df: DataFrame) -> DataFrame:
    """ARP listing: (ip, lower-case mac); IPv4 only, lines without a hardware address dropped."""
    f = _fields(F.col("line"))
    ip = F.get(f, F.lit(0))
    at = F.array_position(f, "lladdr").cast("int")
    rows = df.select(
        *_KEYS, ip.alias("ip"), F.when(at > 0, F.lower(F.get(f, at))).alias("mac")
    )
    return rows.where(is_ipv4(F.col("ip")) & F.col("mac").isNotNull())


def read_route_reports(df: DataFrame) -> DataFrame:
    """Route report lines per (hostname, collected_at, target): hops (ttl, ip), ``???`` = NULL ip.

    A router answering several steps in a row is one hop.
    """
    rows = df.where(F.col("line").contains("|--")).select(
        *_KEYS, "target", "line_no", F.regexp_extract("line", r"\|--\s*(\S+)", 1).alias("_f")
    ).where(F.col("_f") != "")
    hops = rows.withColumn("ip", F.when(is_ipv4(F.col("_f")), F.col("_f"))).drop("_f")
    return collapse_hops(hops)


def collapse_hops(hops: DataFrame) -> DataFrame:
    """Drop a hop equal to the one before it; ``ttl`` numbers what is left (a route is short)."""
    w = Window.partitionBy(*_KEYS, "target").orderBy("line_no")
    kept = hops.withColumn("_prev", F.lag("ip").over(w)).where(
        F.col("ip").isNull() | ~F.col("ip").eqNullSafe(F.col("_prev"))
    )
    return kept.withColumn("ttl", F.row_number().over(w)).drop("_prev", "line_no")


_UNIT_FIELDS = {
    "Id": "id", "LoadState": "load_state", "UnitFileState": "unit_file_state", "Type": "type",
    "ActiveState": "active_state", "SubState": "sub_state",
}


def read_unit_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blank-line separated Key=Value blocks: one row per unit."""
    return parse_unit_blocks(spark.read.option("lineSep", "\n\n").text(path))


def parse_unit_blocks(blocks: DataFrame, column: str = "value") -> DataFrame:
    """Fields of each block as columns; the first line of a key counts."""
    lines = F.filter(F.split(F.col(column), "\n"), lambda l: l.contains("="))

    def field(key: str) -> Column:
        hit = F.get(F.filter(lines, lambda l: l.startswith(f"{key}=")), F.lit(0))
        return F.substring(hit, F.lit(len(key) + 2), F.length(hit))

    extra = [c for c in blocks.columns if c != column]
    out = blocks.select(*extra, *[field(k).alias(name) for k, name in _UNIT_FIELDS.items()])
    return out.where(F.coalesce("id", F.lit("")) != "")


def read_autostart(spark: SparkSession, path: str) -> DataFrame:
    """Desktop entries of a folder: (name, exec)."""
    return parse_autostart(spark.read.option("wholetext", True).text(path))


def parse_autostart(files: DataFrame, column: str = "value") -> DataFrame:
    """Hidden or disabled entries and those without Name or Exec are dropped; %-codes are removed."""
    lines = F.split(F.col(column), r"\r?\n")

    def value(key: str) -> Column:
        hit = F.get(F.filter(lines, lambda l: l.startswith(f"{key}=")), F.lit(0))
        return F.substring(hit, F.lit(len(key) + 2), F.length(hit))

    words = F.filter(F.split(value("Exec"), r"\s+"), lambda t: (t != "") & ~t.startswith("%"))
    off = F.coalesce(value("Hidden") == "true", F.lit(False)) | F.coalesce(
        value("X-GNOME-Autostart-enabled") == "false", F.lit(False)
    )
    extra = [c for c in files.columns if c != column]
    out = files.where(~off).select(*extra, value("Name").alias("name"), F.array_join(words, " ").alias("exec"))
    return out.where(F.col("name").isNotNull() & (F.coalesce("exec", F.lit("")) != ""))
