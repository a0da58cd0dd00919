"""Files and stores, written and read back: journal lines, graphs, alerts, baselines, notes."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from vigilframe.operators import baselines as B
from vigilframe.operators.geo import describe_hop
from vigilframe.operators.graph import union_edges
from vigilframe.operators.ordered import checkpoint_dir, stage
from vigilframe.plans.catalog import EV, HOUR, events, query, r6, table
from vigilframe.plans.catalog_geo import _HOP, _located_hops
from vigilframe.plans.catalog_graph import _GRAPH, _graph
from vigilframe.plans.catalog_signals import _BASELINE, BASE
from vigilframe.sinks import dump_baselines, write_graph_json
from vigilframe.sources.journal import read_journal
from vigilframe.sources.notes import read_community_labels, read_graph_json, read_graph_lines
from vigilframe.streaming.store import checkpoint_baselines, checkpoint_notes, restore_baselines, restore_notes, write_if_changed


def _folder(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@query(
    "journal_file",
    """SELECT event_id AS ts_us, event_type AS unit, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(user_id AS INTEGER) END AS pid,
  CASE WHEN event_id % 3 = 0 THEN 'Grüße ' || user_id ELSE 'seen ' || user_id END AS message, event_id % 3 = 0 AS message_was_binary
FROM events WHERE event_id % 97 <> 0""",
)
def journal_file(spark, d):
    """Journal lines in files: bytes and strings as messages, bad numbers, blank lines, lines without a time."""
    eid = F.col("event_id").cast("string")
    text = F.concat(F.when(F.col("event_id") % 3 == 0, F.lit("Grüße ")).otherwise(F.lit("seen ")), F.col("user_id").cast("string"))
    octets = F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit("(..)"), 1)
    as_bytes = F.concat(F.lit("["), F.array_join(F.transform(octets, lambda h: F.conv(h, 16, 10)), ","), F.lit("]"))
    said = F.when(F.col("event_id") % 3 == 0, as_bytes).otherwise(F.concat(F.lit('"'), text, F.lit('"')))
    pid = F.when(F.col("event_id") % 5 == 0, F.lit("none")).otherwise(F.col("user_id").cast("string"))
    time = F.when(F.col("event_id") % 97 == 0, F.lit("")).otherwise(F.concat(F.lit('"__REALTIME_TIMESTAMP":"'), eid, F.lit('",')))
    line = F.concat(
        F.lit("{"), time, F.lit('"_SYSTEMD_UNIT":"'), F.col("event_type"), F.lit('","_PID":"'), pid, F.lit('","MESSAGE":'), said, F.lit("}"),
        F.when(F.col("event_id") % 11 == 0, F.lit("\n   ")).otherwise(F.lit("")),
    )
    path = _folder(spark, "journal")
    table(spark, d, "events").select(line.alias("value")).write.text(path)
    return read_journal(spark, path).where("error IS NULL").select("ts_us", "unit", "pid", "message", "message_was_binary")


@query(
    "graph_lines",
    f"""WITH {_GRAPH}, n AS (SELECT file_type, community, count(*) AS nodes, sum(length(label))::BIGINT AS label_chars FROM nodes GROUP BY ALL),
x AS (SELECT a.file_type, a.community, count(*) AS links FROM good g JOIN nodes a ON a.id = g.source GROUP BY ALL)
SELECT n.file_type, n.community, n.nodes, n.label_chars, coalesce(x.links, 0) AS links FROM n LEFT JOIN x USING (file_type, community)""",
)
def graph_lines(spark, d):
    """A graph of any size as JSON lines, read back and counted per group."""
    nodes, edges = _graph(spark, d)
    ids = stage(nodes.select("id"))
    good = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    path = _folder(spark, "graph")
    text = lambda df, *names: df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})
    write_graph_json(text(nodes, "community_name", "source_file"), text(good, "origin"), path)
    nodes, edges = read_graph_lines(spark, path)
    shape = nodes.groupBy("file_type", "community").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.length("label")).alias("label_chars"))
    links = edges.join(nodes.select(F.col("id").alias("source"), "file_type", "community"), "source").groupBy("file_type", "community").agg(
        F.count(F.lit(1)).alias("links")
    )
    return shape.join(links, ["file_type", "community"], "left").na.fill(0, ["links"])


@query(
    "graph_document",
    "SELECT CAST(n_nationkey AS VARCHAR) AS source, CAST(n_regionkey AS VARCHAR) AS target, 'in' AS relation, '' AS confidence, n_name AS label FROM nation",
)
def graph_document(spark, d):
    """A node-link document per region with missing fields, read back."""
    nation = table(spark, d, "nation")
    node = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("label"))
    link = F.struct(F.col("n_nationkey").cast("string").alias("source"), F.col("n_regionkey").cast("string").alias("target"), F.lit("in").alias("relation"))
    docs = nation.groupBy("n_regionkey").agg(F.collect_list(node).alias("nodes"), F.collect_list(link).alias("links"))
    path = _folder(spark, "document")
    docs.repartition("n_regionkey").write.partitionBy("n_regionkey").json(path)
    nodes, edges = read_graph_json(spark, path)
    return edges.join(nodes.select(F.col("id").alias("source"), "label"), "source").select("source", "target", "relation", "confidence", "label")


@query("community_labels", "SELECT n_nationkey AS community, n_name AS label FROM nation WHERE n_nationkey % 4 <> 0")
def community_labels(spark, d):
    """Names of groups from a JSON object; keys that are no numbers are skipped."""
    key = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("x"), F.col("n_nationkey"))).otherwise(F.col("n_nationkey").cast("string"))
    one = table(spark, d, "nation").agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), "n_name"))).alias("m"))
    path = _folder(spark, "labels")
    one.select(F.to_json("m").alias("value")).write.text(path)
    return read_community_labels(spark, path).select(F.col("community").cast("int").alias("community"), "label")


@query(
    "capped_bins",
    f"""WITH {_BASELINE}, r AS (SELECT *, row_number() OVER (PARTITION BY hostname, unit, template_id, slot ORDER BY v) AS n FROM bins),
k AS (SELECT *, max(v) FILTER (n <= 2) OVER (PARTITION BY hostname, unit, template_id, slot) AS top FROM r)
SELECT hostname, unit, template_id, slot, CAST(CASE WHEN n <= 2 THEN v ELSE top END AS BIGINT) AS value, round(sum(w), 6) + 0.0 AS weight FROM k GROUP BY ALL""",
)
def capped_bins(spark, d):
    """Histograms folded to their two smallest values."""
    return _long(B.fit_slot_baselines(events(spark, d), HOUR, BASE), lambda rows: B.cap_bins(rows, 2))


@query(
    "pruned_bins",
    f"""WITH {_BASELINE} SELECT hostname, unit, template_id, slot, CAST(v AS BIGINT) AS value, round(w, 6) + 0.0 AS weight FROM bins WHERE w >= 0.507""",
)
def pruned_bins(spark, d):
    return _long(B.fit_slot_baselines(events(spark, d), HOUR, BASE), lambda rows: B.prune_negligible(rows, 0.507))


def _long(baselines, change):
    rows = baselines.select("hostname", "unit_name", "template_id", "slot", "last_bucket", F.explode("bins").alias("b")).select(
        "hostname", "unit_name", "template_id", "slot", "last_bucket", F.col("b.value").cast("bigint").alias("value"), "b.weight"
    )
    out = change(rows)
    return out.select("hostname", F.col("unit_name").alias("unit"), "template_id", "slot", "value", r6("weight").alias("weight"))


_STORED = f"""WITH {_BASELINE}, l AS (SELECT hostname, unit, max(bucket) AS m FROM ev GROUP BY ALL)"""


@query(
    "stored_baselines",
    _STORED + """
SELECT 'baselines' AS part, hostname, count(*) AS cnt, round(sum(weight), 4) + 0.0 AS weight FROM base GROUP BY hostname
UNION ALL SELECT 'profiles', hostname, count(DISTINCT (unit, template_id)), round(sum(pow(0.5, (m - bucket) / 168.0)), 4) + 0.0 FROM ev JOIN l USING (hostname, unit) GROUP BY hostname""",
)
def stored_baselines(spark, d):
    """The learned set saved twice as versions, and the current one restored."""
    ev = events(spark, d)
    base, prof = B.fit_slot_baselines(ev, HOUR, BASE), B.fit_unit_profiles(ev, HOUR, BASE)
    path, none = _folder(spark, "store"), spark.createDataFrame([], "hostname string, template_id string")
    checkpoint_baselines(spark, path, base.limit(3), prof.limit(3), none, 3600, "h", 1)
    checkpoint_baselines(spark, path, base, prof, none, 3600, "h", 2)
    found = restore_baselines(spark, path, 3600, "h")
    part = lambda n: found[n].groupBy("hostname").agg(
        F.count(F.lit(1)).alias("cnt"), F.round(F.sum("weight"), 4).alias("weight")
    ).select(F.lit(n).alias("part"), "hostname", "cnt", "weight")
    return part("baselines").unionByName(part("profiles"))


@query(
    "dumped_baselines",
    _STORED + """
SELECT 1 AS schema_version, 3600 AS bucket_seconds, (SELECT count(*) FROM base) AS n_histograms, (SELECT count(DISTINCT (hostname, unit, template_id)) FROM ev) AS n_profiles,
  (SELECT sum(n_bins) FROM base)::BIGINT AS n_bins""",
)
def dumped_baselines(spark, d):
    ev, path = events(spark, d), _folder(spark, "dump")
    dump_baselines(B.fit_slot_baselines(ev, HOUR, BASE), B.fit_unit_profiles(ev, HOUR, BASE), path, bucket_seconds=3600, hostname="h")
    bins = spark.read.json(f"{path}/histograms").agg(F.sum(F.size("bins")).alias("n_bins"))
    meta = spark.read.json(f"{path}/meta").select(
        F.col("schema_version").cast("int"), F.col("bucket_seconds").cast("int"), "n_histograms", "n_profiles"
    )
    return meta.crossJoin(bins)  # two one-row tables


@query("stored_notes", "SELECT CAST(doc_id AS VARCHAR) AS path, n_chars::BIGINT AS size, doc_id % 2 = 0 AS rewritten FROM documents")
def stored_notes(spark, d):
    """Note state saved and restored; a table that did not change is not written again."""
    notes = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").cast("bigint").alias("size"), "doc_id")
    store, plain = _folder(spark, "notes"), _folder(spark, "plain")
    checkpoint_notes(spark, store, notes)
    wrote = [write_if_changed(notes, plain), write_if_changed(notes, plain)]
    if wrote != [True, False]:
        raise AssertionError(f"unchanged notes were written: {wrote}")
    return restore_notes(spark, store).select("path", "size", (F.col("doc_id") % 2 == 0).alias("rewritten"))


@query(
    "hop_texts",
    f"""WITH {_HOP}, t AS (SELECT o_custkey, ttl, ip, CASE WHEN local THEN 'local network' WHEN source IS NULL THEN NULL
  WHEN source = 'country' THEN 'NATION_' || k WHEN source = 'city_database' THEN place || ', NATION_' || k ELSE place END AS place FROM hl)
SELECT ttl, CASE WHEN ip IS NULL THEN 'no answer' WHEN place IS NULL THEN 'location unknown' ELSE place END AS text,
  CASE WHEN ip IS NOT NULL THEN (ip // 16777216) || '.' || (ip // 65536 % 256) || '.' || (ip // 256 % 256) || '.' || (ip % 256) END AS address FROM t""",
)
def hop_texts(spark, d):
    """What is shown of a hop: the place and the address in brackets, here taken apart again."""
    h = _located_hops(spark, d)
    place = F.when(F.col("hint").isNotNull(), F.col("hint.city")).otherwise(F.col("place"))
    said = describe_hop(place, F.col("ip"))
    shown = F.when(said == "no answer", said).when(
        said.endswith(" (location unknown)"), F.lit("location unknown")
    ).otherwise(F.regexp_extract(said, r"^(.*) \([0-9.]+\)\z", 1))
    address = F.when(said.endswith(" (location unknown)"), F.split_part(said, F.lit(" "), F.lit(1))).otherwise(
        F.nullif(F.regexp_extract(said, r"\(([0-9.]+)\)\z", 1), F.lit(""))
    )
    return h.select("ttl", shown.alias("text"), address.alias("address"))


@query(
    "united_edges",
    """WITH e AS (
  SELECT 0 AS p, 0 AS s, 'p' || l_partkey AS x, '' AS y, l_orderkey * 10 + l_linenumber AS q, 'p' || l_partkey AS source, 's' || l_suppkey AS target, 'links_to' AS relation FROM lineitem
  UNION ALL SELECT 1, 0, 's' || l_suppkey, '', l_orderkey * 10 + l_linenumber, 's' || l_suppkey, 'p' || l_partkey, 'supplies' FROM lineitem
  UNION ALL SELECT 2, -(p_size::BIGINT), 'p' || p_partkey, 's' || (p_partkey % 10), 0, 'p' || p_partkey, 's' || (p_partkey % 10), 'shares_topic' FROM part)
SELECT source, target, relation FROM (
  SELECT *, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY p, s, x, y, q) AS n FROM e WHERE source <> target) WHERE n = 1""",
)
def united_edges(spark, d):
    """Links, external and term edges over the same pairs: one edge per pair, the first kind wins."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))

    def edges(df, source, target, relation, pos):
        return df.select(
            source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"), F.lit("x").alias("confidence"),
            F.lit("y").alias("origin"), pos.cast("bigint").alias("pos"),
        )

    items, parts = table(spark, d, "lineitem"), table(spark, d, "part")
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    links = edges(items, key("p", "l_partkey"), key("s", "l_suppkey"), "links_to", at)
    external = edges(items, key("s", "l_suppkey"), key("p", "l_partkey"), "supplies", at)
    terms = edges(parts, key("p", "p_partkey"), F.concat(F.lit("s"), (F.col("p_partkey") % 10).cast("string")), "shares_topic", -F.col("p_size"))
    return union_edges(links, external, terms).select("source", "target", "relation")
