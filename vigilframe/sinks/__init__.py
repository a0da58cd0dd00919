"""Writers: alerts, metrics, graphs, maps, baselines and audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilframe.functions import csv_field, template_id_hex
from vigilframe.operators.geo import describe_hop
from vigilframe.operators.inventory import metrics_long

CSV_HEADER = "id,timestamp_us,level,unit,pid,template_id,template_text,sample_message,score"


def write_anomalies_json(anomalies: DataFrame, path: str, mode: str = "overwrite") -> None:
    anomalies.write.mode(mode).json(path)


def anomalies_csv(anomalies: DataFrame) -> DataFrame:
    """The nine export columns as text: capitalised level, score with four decimals, NULL = ''."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return anomalies.select(
        F.col("id").cast("string").alias("id"),
        F.col("ts_us").cast("string").alias("timestamp_us"),
        F.initcap("level").alias("level"),
        empty(F.col("unit")).alias("unit"),
        empty(F.col("pid").cast("string")).alias("pid"),
        template_id_hex(F.col("template_id")).alias("template_id"),
        F.col("template_text"),
        F.col("sample_message"),
        F.format_string("%.4f", F.col("breakdown.combined")).alias("score"),
    )


def write_anomalies_csv(anomalies: DataFrame, path: str, mode: str = "overwrite") -> None:
    """RFC 4180 CSV with a header line per file; only fields that need quotes get them.

    The quoting is done here: Spark's CSV writer would quote empty strings.
    """
    cols = anomalies_csv(anomalies)
    text = {"unit", "template_text", "sample_message"}
    line = F.concat_ws(",", *[csv_field(F.col(c)) if c in text else F.col(c) for c in cols.columns])
    rows = cols.select(line.alias(CSV_HEADER))
    rows.write.mode(mode).option("header", True).option("quote", "\u0000").option("sep", "\u0001").option(
        "emptyValue", ""
    ).option("escapeQuotes", False).csv(path)


def metrics_text(snapshots: DataFrame) -> DataFrame:
    """HELP, TYPE and value lines of the latest snapshot per host, in order (``value``)."""
    latest = snapshots.groupBy("hostname").agg(F.max_by(F.struct(*snapshots.columns), "ts_us").alias("_s")).select("_s.*")
    rows = metrics_long(latest)
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("bigint").cast("string")).otherwise(
        F.col("value").cast("string")
    )
    lines = F.array(
        F.concat_ws(" ", F.lit("# HELP"), "metric", "help"),
        F.concat_ws(" ", F.lit("# TYPE"), "metric", "kind"),
        F.concat_ws(" ", "metric", number),
    )
    return rows.select("hostname", "ord", F.posexplode(lines).alias("n", "value"))


def write_metrics_text(snapshots: DataFrame, path: str) -> None:
    """One text file per host (partition folder), lines in order."""
    out = metrics_text(snapshots)
    out.repartition("hostname").sortWithinPartitions("hostname", "ord", "n").select("hostname", "value").write.mode(
        "overwrite"
    ).partitionBy("hostname").text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet, for graphs of any size."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with the node-link document, for graphs that are shown: both tables are limited there."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("id", "label", "file_type", "community", "community_name", "source_file"))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct("source", "target", "relation", "confidence", "origin"))).alias("links"))
    doc = F.struct(F.lit(False).alias("directed"), F.lit(False).alias("multigraph"), "nodes", "links")
    return n.crossJoin(e).select(F.to_json(doc).alias("value"))  # two one-row aggregates


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node-link graph of any size as JSON lines: one object per node under ``nodes``, per edge under ``links``.

    The objects are those of the document of `graph_json`; ``sources.notes.read_graph_lines`` reads them.
    """
    nodes.select("id", "label", "file_type", "community", "community_name", "source_file").write.mode("overwrite").json(f"{path}/nodes")
    edges.select("source", "target", "relation", "confidence", "origin").write.mode("overwrite").json(f"{path}/links")


def map_points(points: DataFrame, hops: DataFrame) -> DataFrame:
    """One JSON-ready row per point with its route nested (a route has few hops).

    ``points``: ip, program, place, detail, lat, lon; ``hops``: target, ttl, ip, place, lat, lon.
    """
    hop = F.struct(
        "ttl",
        describe_hop(F.col("place"), F.col("ip")).alias("text"),
        "place", "lat", "lon",
        F.col("ip").eqNullSafe(F.col("target")).alias("is_target"),
    )
    routes = hops.groupBy(F.col("target").alias("ip")).agg(F.array_sort(F.collect_list(hop)).alias("route"))
    strip = lambda h: F.struct(h["text"].alias("text"), h["place"].alias("place"), h["lat"].alias("lat"), h["lon"].alias("lon"), h["is_target"].alias("is_target"))
    return points.join(routes, "ip", "left").select(
        "ip", "program", "place", "detail", "lat", "lon",
        F.when(F.col("route").isNull(), F.array()).otherwise(F.transform("route", strip)).alias("route"),
    )


def write_map_json(
    points: DataFrame, hops: DataFrame, path: str, home: Column | None = None,
    router_offline: bool = False, unresolved: int = 0, error: str | None = None,
) -> None:
    """Points as JSON lines under ``points``, counters and home under ``summary``."""
    map_points(points, hops).write.mode("overwrite").json(f"{path}/points")
    one = points.sparkSession.range(1).select(
        (home if home is not None else F.lit(None).cast("struct<code:string,lat:double,lon:double>")).alias("home"),
        F.lit(router_offline).alias("router_offline"), F.lit(unresolved).alias("unresolved"), F.lit(error).alias("error"),
    )
    one.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/summary")


DUMP_VERSION = 1


def dump_baselines(
    baselines: DataFrame, profiles: DataFrame, path: str, registry: DataFrame | None = None, bucket_seconds: int = 5,
    hostname: str = "", last_snapshot_us: int | None = None,
) -> None:
    """The whole learned set as JSON lines for people and other tools, with what it was learned with under ``meta``."""
    spark = baselines.sparkSession
    tables = {"histograms": baselines, "profiles": profiles, **({"templates": registry} if registry is not None else {})}
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")
    counts = [F.lit(spark.read.text(f"{path}/{name}").count()).alias(f"n_{name}") for name in tables]
    spark.range(1).select(
        F.lit(DUMP_VERSION).alias("schema_version"), F.lit(bucket_seconds).alias("bucket_seconds"), F.lit(hostname).alias("hostname"),
        F.lit(last_snapshot_us).cast("bigint").alias("last_snapshot_us"), *counts,
    ).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/meta")


def audit_records(decisions: DataFrame) -> DataFrame:
    """One record per decision, denied ones included."""
    cols = [c for c in ("request_id", "peer_uid") if c in decisions.columns]
    return decisions.select(
        F.col("ts_us").alias("timestamp_us"), *cols, "kind", "target", "outcome", "reason", "retry_after_secs"
    )


def write_audit(decisions: DataFrame, path: str) -> None:
    """Append one JSON line per decision."""
    audit_records(decisions).write.mode("append").json(path)
