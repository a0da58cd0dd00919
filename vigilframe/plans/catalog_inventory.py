"""Alerts lists, fleet, services, metrics and actions over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.config import ActionPolicy
from vigilframe.operators import actions as A
from vigilframe.operators import inventory as I
from vigilframe.operators import scoring as SC
from vigilframe.operators.filters import watched_units
from vigilframe.plans.catalog import EV, HOUR, MSG, events, msg, query, r6, table
from vigilframe.sinks import anomalies_csv, audit_records, metrics_text
from vigilframe.sources.collected import parse_autostart, parse_unit_blocks

# Every event as an alert record: the level follows from its value.
_AN = EV + f""",
an AS (SELECT e.*, CASE WHEN e.value >= 90 THEN 'critical' WHEN e.value >= 50 THEN 'warn' ELSE 'info' END AS level, m.message
  FROM ev e JOIN (SELECT event_id AS seq, {MSG} AS message FROM events) m USING (seq))"""


def _anomalies(spark, d):
    level = F.when(F.col("value") >= 90, F.lit("critical")).when(F.col("value") >= 50, F.lit("warn")).otherwise(F.lit("info"))
    return events(spark, d).select(
        "hostname", "ts_us", "seq", F.col("seq").alias("id"), F.xxhash64("template_id").alias("template_id"),
        F.col("template_id").alias("template_text"), msg(etype="unit", eid="seq").alias("sample_message"), "unit", F.col("user_id").cast("int").alias("pid"),
        level.alias("level"), F.struct((F.col("value") / 1000.0).alias("combined")).alias("breakdown"), F.col("value").alias("value"),
    )


@query(
    "filtered_anomalies",
    f"""WITH {_AN} SELECT seq FROM an WHERE level = 'warn' AND contains(lower(unit), 'cl')
  AND (contains(lower(template_id), 'user 7') OR contains(lower(message), 'user 7'))""",
)
def filtered_anomalies(spark, d):
    return SC.filter_anomalies(_anomalies(spark, d), "warn", "CL", "User 7").select("seq")


@query(
    "top_scores",
    f"WITH {_AN} SELECT seq, round(value / 1000, 6) + 0.0 AS score FROM an",
)
def top_scores(spark, d):
    return SC.sort_anomalies(_anomalies(spark, d), "score").select("seq", r6("breakdown.combined").alias("score"))


@query(
    "recent_per_host",
    f"""WITH {_AN} SELECT hostname, seq, CAST(row_number() OVER (PARTITION BY hostname ORDER BY ts_us DESC, seq DESC) AS INTEGER) AS rank
FROM an QUALIFY rank <= 200""",
)
def recent_per_host(spark, d):
    return I.recent_anomalies(_anomalies(spark, d), 200).select("hostname", "seq", F.col("rank").cast("int").alias("rank"))


@query(
    "history_points",
    f"""WITH {EV} SELECT * FROM (SELECT hostname, bucket, count(*) AS n FROM ev GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY hostname ORDER BY bucket DESC) <= 300""",
)
def history_points(spark, d):
    from vigilframe.operators.entropy import bucket_counts

    c = bucket_counts(events(spark, d), ["hostname"], HOUR).withColumn("ts_us", F.col("bucket"))
    return I.history_points(c, 300).select("hostname", "bucket", F.col("count").alias("n"))


@query(
    "fleet_summary",
    f"""WITH {_AN}, s AS (SELECT hostname, bucket, count(*) AS uptime_s, CAST(count(DISTINCT template_id) AS DOUBLE) AS entropy_bits FROM ev GROUP BY ALL),
l AS (SELECT hostname, arg_max(uptime_s, bucket) AS uptime_s, arg_max(entropy_bits, bucket) AS entropy_bits FROM s GROUP BY ALL),
r AS (SELECT hostname, seq, level, row_number() OVER (PARTITION BY hostname ORDER BY ts_us DESC, seq DESC) AS rank FROM an QUALIFY rank <= 20),
t AS (SELECT hostname, string_agg(seq || ':' || level, ' ' ORDER BY rank) AS recent FROM r GROUP BY ALL)
SELECT hostname, count(*) FILTER (level = 'info') AS info, count(*) FILTER (level = 'warn') AS warn, count(*) FILTER (level = 'critical') AS critical,
  any_value(uptime_s) AS uptime_s, any_value(entropy_bits) AS entropy_bits, any_value(recent) AS recent
FROM an JOIN l USING (hostname) JOIN t USING (hostname) GROUP BY hostname""",
)
def fleet_summary(spark, d):
    ev = events(spark, d).withColumn("ts_us", F.call_function("div", F.col("ts_us"), F.lit(HOUR).cast("bigint")))
    snaps = ev.groupBy("hostname", "ts_us").agg(
        F.count(F.lit(1)).alias("uptime_s"), F.count_distinct("template_id").cast("double").alias("entropy_bits")
    )
    out = I.fleet_summary(_anomalies(spark, d), snaps)
    text = F.transform("recent", lambda r: F.concat(r["seq"].cast("string"), F.lit(":"), r["level"]))
    return out.withColumn("recent", F.array_join(text, " "))


@query(
    "anomaly_csv_rows",
    f"""WITH {_AN} SELECT CAST(seq AS VARCHAR) AS id, CAST(ts_us AS VARCHAR) AS timestamp_us, upper(level[1]) || level[2:] AS level, unit,
  CAST(user_id AS VARCHAR) AS pid, template_id AS template_text, message AS sample_message, printf('%.4f', floor(value) / 1000) AS score FROM an""",
)
def anomaly_csv_rows(spark, d):
    flat = F.struct((F.floor("value") / 1000.0).alias("combined"))
    return anomalies_csv(_anomalies(spark, d).withColumn("breakdown", flat)).drop("template_id")


@query(
    "compact_anomalies",
    f"""WITH {_AN} SELECT seq AS id, ts_us // 1000 AS ms, CASE level WHEN 'warn' THEN 'WARN' WHEN 'critical' THEN 'CRIT' ELSE 'INFO' END AS level, unit,
  template_id AS template, message AS line FROM an""",
)
def compact_anomalies(spark, d):
    coloured = _anomalies(spark, d).withColumn("sample_message", F.concat(F.lit("\x1b[31m"), "sample_message", F.lit("\x1b[0m")))
    return SC.compact_anomaly(coloured).drop("score")


# --- services ----------------------------------------------------------------------------------
_SV = """sv AS (SELECT o_orderkey, CASE o_orderpriority[1] WHEN '1' THEN 'gvfs-' WHEN '2' THEN 'dbus' ELSE 'app-' END || o_orderkey || CASE WHEN o_orderkey % 4 = 0 THEN '.timer' ELSE '.service' END AS name,
  CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'active' ELSE 'inactive' END AS active,
  CASE WHEN o_custkey % 3 = 0 THEN 'exited' ELSE 'running' END AS sub, CASE WHEN o_custkey % 5 = 0 THEN 'oneshot' ELSE 'simple' END AS type,
  CASE WHEN o_custkey % 2 = 0 THEN 'enabled-runtime' ELSE 'disabled' END AS uf, CASE WHEN o_custkey % 7 = 0 THEN 'masked' ELSE 'loaded' END AS ls FROM orders),
st AS (SELECT name, CASE WHEN ends_with(name, '.timer') THEN 'timer' ELSE 'service' END AS kind, active || '/' || sub AS detail,
  CASE WHEN active = 'failed' THEN 'failed' WHEN active = 'active' AND sub = 'exited' THEN 'idle' WHEN active = 'active' THEN 'running'
    WHEN type = 'oneshot' OR uf = 'disabled' THEN 'idle' ELSE 'not_running' END AS status FROM sv WHERE ls = 'loaded')"""


def _units(spark, d):
    o = table(spark, d, "orders")
    p = F.substring("o_orderpriority", 1, 1)
    key = F.col("o_orderkey").cast("string")
    name = F.concat(
        F.when(p == "1", F.lit("gvfs-")).when(p == "2", F.lit("dbus")).otherwise(F.lit("app-")), key,
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(".timer")).otherwise(F.lit(".service")),
    )
    pick = lambda c, a, b: F.when(c, F.lit(a)).otherwise(F.lit(b))
    cust = F.col("o_custkey")
    active = F.when(F.col("o_orderstatus") == "F", F.lit("failed")).when(F.col("o_orderstatus") == "O", F.lit("active")).otherwise(F.lit("inactive"))
    block = F.concat_ws(
        "\n", F.concat(F.lit("Id="), name), F.concat(F.lit("Type="), pick(cust % 5 == 0, "oneshot", "simple")),
        F.concat(F.lit("LoadState="), pick(cust % 7 == 0, "masked", "loaded")), F.concat(F.lit("ActiveState="), active),
        F.concat(F.lit("SubState="), pick(cust % 3 == 0, "exited", "running")), F.concat(F.lit("UnitFileState="), pick(cust % 2 == 0, "enabled-runtime", "disabled")),
    )
    return I.classify_service(parse_unit_blocks(o.select(block.alias("value"))))


@query("service_status", f"WITH {_SV} SELECT name, kind, status, detail FROM st")
def service_status(spark, d):
    return _units(spark, d)


@query(
    "visible_services",
    f"WITH {_SV} SELECT status, kind, count(*) AS cnt FROM st WHERE NOT starts_with(name, 'gvfs-') AND NOT starts_with(name, 'dbus') GROUP BY ALL",
)
def visible_services(spark, d):
    return I.hide_prefixes(_units(spark, d)).groupBy("status", "kind").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "ordered_services",
    f"""WITH {_SV} SELECT name, status FROM st
ORDER BY CASE status WHEN 'failed' THEN 0 WHEN 'not_running' THEN 1 WHEN 'running' THEN 2 ELSE 3 END, name""",
)
def ordered_services(spark, d):
    return I.order_services(_units(spark, d)).select("name", "status")


@query("watched_units", f"WITH {_SV} SELECT name FROM st WHERE name IN (SELECT 'app-' || c_custkey || '.service' FROM customer)")
def watched(spark, d):
    watch = table(spark, d, "customer").select(F.concat(F.lit("app-"), F.col("c_custkey").cast("string"), F.lit(".service")).alias("name"))
    return watched_units(_units(spark, d), watch).select("name")


@query(
    "autostart_status",
    """SELECT c_name AS name, CASE WHEN CASE c_custkey % 3 WHEN 0 THEN 'tool' || c_nationkey WHEN 1 THEN 'flat' || c_nationkey ELSE NULL END IN
    (SELECT 'tool' || (s_nationkey // 2) FROM supplier UNION SELECT 'flat' || (s_nationkey // 3) FROM supplier) OR (c_custkey % 3 = 2 AND c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000))
  THEN 'running' ELSE 'idle' END AS status FROM customer WHERE c_mktsegment <> 'BUILDING'""",
)
def autostart_status(spark, d):
    c = table(spark, d, "customer")
    n = F.col("c_nationkey").cast("string")
    k = F.col("c_custkey") % 3
    run = (
        F.when(k == 0, F.concat(F.lit("/usr/bin/tool"), n, F.lit(" %U --quiet")))
        .when(k == 1, F.concat(F.lit("flatpak run --command=flat"), n, F.lit(" org.x")))
        .otherwise(F.concat(F.lit("sh -c 'start "), n, F.lit("'")))
    )
    text = F.concat_ws(
        "\n", F.lit("[Desktop Entry]"), F.concat(F.lit("Name="), "c_name"), F.concat(F.lit("Exec="), run),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("Hidden=true")),
    )
    entries = parse_autostart(c.select(F.lit("h").alias("hostname"), text.alias("value")))
    s = table(spark, d, "supplier")
    half = lambda p, q: F.concat(F.lit(p), F.floor(F.col("s_nationkey") / q).cast("string"))
    lines = (
        s.select(F.concat(F.lit("/opt/"), half("tool", 2), F.lit(" --x")).alias("cmdline"))
        .union(s.select(F.concat(F.lit("python3 /a/"), half("flat", 3), F.lit(" -y"))))
        .union(s.where(F.col("s_acctbal") > 5000).select(F.concat(F.lit("sh -c start "), F.col("s_nationkey").cast("string"))))
    )
    return I.autostart_running(entries, lines.withColumn("hostname", F.lit("h"))).select("name", "status")


@query(
    "system_metrics",
    """SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN 0 ELSE least(100, c_acctbal / 100) END, 6) + 0.0 AS used,
  CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END AS temperatures, round(CASE WHEN c_nationkey = 0 THEN 0 ELSE 100.0 * (c_nationkey - c_nationkey // 2) / c_nationkey END, 6) + 0.0 AS root_used FROM customer""",
)
def system_metrics(spark, d):
    c = table(spark, d, "customer")
    n = F.col("c_nationkey").cast("bigint")
    disk = lambda m: F.struct(F.lit(m).alias("mount_point"), n.alias("total_bytes"), F.floor(n / 2).alias("available_bytes"))
    rows = c.select(
        "c_custkey", F.lit(10_000.0).alias("mem_total"), F.greatest("c_acctbal", F.lit(0.0)).alias("mem_used"), F.array(disk("/"), disk("/home")).alias("disks"),
        F.array(F.struct(F.lit("cpu").alias("label"), F.when(n % 2 == 0, F.lit(50.0)).alias("celsius"))).alias("temperatures"),
    )
    out = I.read_system_metrics(rows, ("/",))
    return out.select(
        "c_custkey", r6("mem_used_percent").alias("used"), F.size("temperatures").alias("temperatures"), r6(F.col("disks")[0]["used_percent"]).alias("root_used")
    )


def _snaps(spark, d):
    ev = events(spark, d).withColumn("ts_us", F.call_function("div", F.col("ts_us"), F.lit(HOUR).cast("bigint")))
    return ev.groupBy("hostname", "ts_us").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("unit") == "error").alias("anomalies"),
        F.round(F.max("value"), 2).alias("load1"), F.max(F.when(F.col("value") > 90, F.lit(1.5))).alias("entropy_z"),
    )


_SN = EV + """, sn AS (SELECT hostname, bucket AS ts_us, CAST(count(*) AS DOUBLE) AS events, CAST(count(*) FILTER (unit = 'error') AS DOUBLE) AS anomalies,
  round(max(value), 2) AS load1, max(CASE WHEN value > 90 THEN 1.5 END) AS entropy_z FROM ev GROUP BY ALL)"""


@query(
    "metrics_long",
    f"""WITH {_SN} SELECT hostname, ts_us, metric, value FROM (
  SELECT hostname, ts_us, 'vigilframe_events_total' AS metric, events AS value FROM sn UNION ALL SELECT hostname, ts_us, 'vigilframe_anomalies_total', anomalies FROM sn
  UNION ALL SELECT hostname, ts_us, 'vigilframe_load1', load1 FROM sn UNION ALL SELECT hostname, ts_us, 'vigilframe_entropy_z', entropy_z FROM sn) WHERE value IS NOT NULL""",
)
def metrics_long(spark, d):
    return I.metrics_long(_snaps(spark, d)).select("hostname", "ts_us", "metric", "value")


@query(
    "metrics_text",
    f"""WITH {_SN}, l AS (SELECT * FROM sn QUALIFY row_number() OVER (PARTITION BY hostname ORDER BY ts_us DESC) = 1),
m AS (SELECT hostname, 0 AS ord, 'vigilframe_events_total' AS metric, 'counter' AS kind, 'Log events read.' AS help, events AS v FROM l
  UNION ALL SELECT hostname, 1, 'vigilframe_anomalies_total', 'counter', 'Alerts written.', anomalies FROM l
  UNION ALL SELECT hostname, 2, 'vigilframe_entropy_z', 'gauge', 'Distance of that entropy from its history.', entropy_z FROM l
  UNION ALL SELECT hostname, 3, 'vigilframe_load1', 'gauge', 'One-minute load.', load1 FROM l)
SELECT hostname, ord, CAST(n AS INTEGER) AS n, CASE n WHEN 0 THEN '# HELP ' || metric || ' ' || help WHEN 1 THEN '# TYPE ' || metric || ' ' || kind
  ELSE metric || ' ' || CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END END AS value
FROM m, range(3) t(n) WHERE v IS NOT NULL""",
)
def metrics_lines(spark, d):
    return metrics_text(_snaps(spark, d)).select("hostname", "ord", "n", "value")


# --- actions -----------------------------------------------------------------------------------
_POLICY = ActionPolicy(
    dry_run=False, allowed_kinds=("restart_unit", "terminate_process", "block_ip", "mute_anomaly"),
    allowed_units=("purchase.service", "signup.service", "bad unit.service", "view.exe"), max_actions=3, window_minutes=2 * 24 * 60, max_block_secs=30,
)
_RQ = EV + """,
rq AS (SELECT *, CASE user_id % 6 WHEN 0 THEN 'restart_unit' WHEN 1 THEN 'terminate_process' WHEN 2 THEN 'block_ip' WHEN 3 THEN 'mute_anomaly' WHEN 4 THEN 'stop_unit' ELSE 'restart_unit' END AS kind,
  CASE WHEN user_id % 6 = 5 THEN CASE WHEN unit = 'view' THEN 'view.exe' ELSE 'bad unit.service' END ELSE unit || '.service' END AS u,
  CASE WHEN seq % 9 = 0 THEN 1 WHEN seq % 11 = 0 THEN 2147483648 ELSE user_id + 2 END AS pid FROM ev),
ck AS (SELECT *, CASE WHEN kind = 'stop_unit' OR (kind = 'restart_unit' AND u NOT IN ('purchase.service', 'signup.service', 'bad unit.service', 'view.exe')) THEN 'not_allowed'
  WHEN kind = 'terminate_process' AND pid = 1 THEN 'invalid_parameter: pid 1 must not be terminated' WHEN kind = 'terminate_process' AND pid > 2147483647 THEN 'invalid_parameter: pid out of range'
  WHEN kind = 'restart_unit' AND u = 'bad unit.service' THEN 'invalid_parameter: unit name has invalid characters' WHEN kind = 'restart_unit' AND u = 'view.exe' THEN 'invalid_parameter: unknown unit type' END AS bad,
  kind || ':' || CASE kind WHEN 'restart_unit' THEN u WHEN 'terminate_process' THEN CAST(pid AS VARCHAR) WHEN 'block_ip' THEN '10.0.0.' || user_id ELSE (user_id % 10) || '@' || u END AS k FROM rq),
ok AS MATERIALIZED (SELECT seq, k, ts_us, row_number() OVER (PARTITION BY k ORDER BY ts_us, seq) AS rn FROM ck WHERE bad IS NULL),
rl AS (
  SELECT seq, k, rn, [ts_us] AS log, true AS admitted, CAST(NULL AS BIGINT) AS retry FROM ok WHERE rn = 1
  UNION ALL
  SELECT o.seq, o.k, o.rn, CASE WHEN len(list_filter(r.log, lambda t: o.ts_us - t < 172800000000)) >= 3 THEN list_filter(r.log, lambda t: o.ts_us - t < 172800000000)
      ELSE list_append(list_filter(r.log, lambda t: o.ts_us - t < 172800000000), o.ts_us) END,
    len(list_filter(r.log, lambda t: o.ts_us - t < 172800000000)) < 3,
    CASE WHEN len(list_filter(r.log, lambda t: o.ts_us - t < 172800000000)) >= 3 THEN (172800000000 - (o.ts_us - list_filter(r.log, lambda t: o.ts_us - t < 172800000000)[1])) // 1000000 END
  FROM rl r JOIN ok o ON o.k = r.k AND o.rn = r.rn + 1)"""


def _requests(spark, d):
    m, seq, unit = F.col("user_id") % 6, F.col("seq"), F.col("unit")
    kind = (
        F.when(m == 1, F.lit("terminate_process")).when(m == 2, F.lit("block_ip")).when(m == 3, F.lit("mute_anomaly"))
        .when(m == 4, F.lit("stop_unit")).otherwise(F.lit("restart_unit"))
    )
    bad = F.when(unit == "view", F.lit("view.exe")).otherwise(F.lit("bad unit.service"))
    pid = F.when(seq % 9 == 0, F.lit(1)).when(seq % 11 == 0, F.lit(2147483648)).otherwise(F.col("user_id") + 2)
    return events(spark, d).select(
        "hostname", seq.alias("request_id"), "ts_us", "seq", kind.alias("kind"),
        F.when(m == 5, bad).otherwise(F.concat(unit, F.lit(".service"))).alias("unit"), pid.cast("bigint").alias("pid"),
        F.concat(F.lit("10.0.0."), F.col("user_id").cast("string")).alias("ip"), F.lit(100).alias("grace_secs"), F.lit(5).alias("duration_secs"),
        (F.col("user_id") % 10).alias("template_id"), F.lit("one_hour").alias("scope"),
    )


@query(
    "action_decisions",
    f"""WITH RECURSIVE {_RQ} SELECT c.seq, c.kind, CASE WHEN bad IS NOT NULL OR NOT admitted THEN 'denied' ELSE 'approved' END AS outcome,
  CASE WHEN bad IS NOT NULL THEN bad WHEN NOT admitted THEN 'rate_limited' END AS reason, retry AS retry_after_secs, 60 AS grace_secs, 60 AS duration_secs FROM ck c LEFT JOIN rl USING (seq)""",
)
def action_decisions(spark, d):
    out = A.decide_actions(_requests(spark, d), _POLICY)
    return out.select("seq", "kind", "outcome", "reason", "retry_after_secs", "grace_secs", "duration_secs")


@query(
    "audit_counts",
    f"""WITH RECURSIVE {_RQ} SELECT kind, CASE WHEN bad IS NOT NULL OR NOT admitted THEN 'denied' ELSE 'approved' END AS outcome, count(*) AS cnt
FROM ck LEFT JOIN rl USING (seq) GROUP BY ALL""",
)
def audit_counts(spark, d):
    records = audit_records(A.decide_actions(_requests(spark, d), _POLICY))
    return records.groupBy("kind", "outcome").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "effective_mutes",
    f"""WITH RECURSIVE {_RQ} SELECT hostname, CAST(user_id % 10 AS BIGINT) AS template_id, u AS unit, ts_us AS from_us, ts_us + 3600000000 AS until_us
FROM ck JOIN rl USING (seq) WHERE kind = 'mute_anomaly' AND admitted""",
)
def effective_mutes(spark, d):
    return A.mutes_from_actions(A.decide_actions(_requests(spark, d), _POLICY))


@query(
    "effective_suppressions",
    f"""WITH RECURSIVE {_RQ} SELECT hostname, CASE kind WHEN 'terminate_process' THEN 'pid' ELSE 'unit' END AS kind, CASE kind WHEN 'terminate_process' THEN CAST(pid AS VARCHAR) ELSE u END AS key,
  ts_us AS from_us, ts_us + 30000000 AS until_us FROM ck JOIN rl USING (seq) WHERE kind IN ('restart_unit', 'terminate_process') AND admitted""",
)
def effective_suppressions(spark, d):
    return A.suppressions_from_actions(A.decide_actions(_requests(spark, d), _POLICY))
