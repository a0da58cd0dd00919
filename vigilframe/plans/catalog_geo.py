"""Connection geography over users, nations and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.functions import hex_le_ipv4, ipv4_to_long, is_routable_public, long_to_ipv4
from vigilframe.operators import geo as G
from vigilframe.operators import presence as P
from vigilframe.operators.ordered import stage
from vigilframe.plans.catalog import EV, HOUR, events, query, r6, table, wall_us
from vigilframe.sinks import map_points
from vigilframe.sources import collected as C

# Address of a user: spread over the whole space.
_IP = "(user_id * 28633115 + 16777217) % 4294967296"
_DOT = "((({n}) >> 24) & 255) || '.' || ((({n}) >> 16) & 255) || '.' || ((({n}) >> 8) & 255) || '.' || (({n}) & 255)"


def _ip(user="user_id"):
    return (F.col(user) * 28633115 + 16777217) % 4294967296


_RANGES = """rg AS (SELECT n_nationkey::BIGINT * 170000000 AS s, n_nationkey::BIGINT * 170000000 + 120000000 + n_regionkey AS e, n_name AS country_name,
  'C' || n_nationkey AS country, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'City ' || n_nationkey END AS city,
  n_nationkey * 3.0 - 30 AS lat, n_nationkey * 7.0 - 80 AS lon FROM nation)"""


def _ranges(spark, d):
    k = F.col("n_nationkey").cast("bigint")
    return table(spark, d, "nation").select(
        (k * 170_000_000).alias("start"), (k * 170_000_000 + 120_000_000 + F.col("n_regionkey")).alias("end"),
        F.col("n_name").alias("country_name"), F.concat(F.lit("C"), k.cast("string")).alias("country"),
        F.when(k % 3 != 0, F.concat(F.lit("City "), k.cast("string"))).alias("city"),
        (k * 3.0 - 30).alias("lat"), (k * 7.0 - 80).alias("lon"),
    )


def _countries(spark, d):
    k = F.col("n_nationkey").cast("bigint")
    return table(spark, d, "nation").select(
        F.concat(F.lit("C"), k.cast("string")).alias("code"), (k * 2.0 - 20).alias("lat"), (k * 5.0 - 60).alias("lon"), F.col("n_name").alias("name")
    )


@query(
    "geo_range_join",
    f"""WITH {_RANGES} SELECT event_id AS seq, country, city FROM events LEFT JOIN rg ON {_IP} BETWEEN s AND e""",
)
def geo_range_join(spark, d):
    ips = table(spark, d, "events").select(F.col("event_id").alias("seq"), _ip().alias("ip_num"))
    return G.geo_lookup(ips, _ranges(spark, d)).select("seq", "country", "city")


_HOSTS = """hn AS (SELECT c_custkey, (c_custkey * 2863311 + 16777217) % 4294967296 AS ip, CASE c_custkey % 6
  WHEN 0 THEN 'fra' || c_nationkey || 's-in.' || lower(c_mktsegment) || '.net' WHEN 1 THEN 'frankfurt.' || c_nationkey || '.example.org'
  WHEN 2 THEN 'r' || c_custkey || '.lhr-1.example.com' WHEN 3 THEN 'x-' || c_custkey || '.HH.DE.NET.DTAG.DE'
  WHEN 4 THEN 'edge.ZZ.de.net.dtag.de' ELSE 'a.b' || c_custkey || '.nrt' END AS hostname FROM customer),
hint AS (SELECT *, CASE c_custkey % 6 WHEN 0 THEN 'Frankfurt' WHEN 2 THEN 'London' WHEN 3 THEN 'Hamburg' WHEN 5 THEN 'Tokio' END AS city,
  c_custkey % 6 = 3 OR c_custkey % 4 < 3 AS ok FROM hn)"""


def _hosts(spark, d):
    c = table(spark, d, "customer")
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    k = F.col("c_custkey") % 6
    host = (
        F.when(k == 0, F.concat(F.lit("fra"), nation, F.lit("s-in."), F.lower("c_mktsegment"), F.lit(".net")))
        .when(k == 1, F.concat(F.lit("frankfurt."), nation, F.lit(".example.org")))
        .when(k == 2, F.concat(F.lit("r"), key, F.lit(".lhr-1.example.com")))
        .when(k == 3, F.concat(F.lit("x-"), key, F.lit(".HH.DE.NET.DTAG.DE")))
        .when(k == 4, F.lit("edge.ZZ.de.net.dtag.de"))
        .otherwise(F.concat(F.lit("a.b"), key, F.lit(".nrt")))
    )
    ip = (F.col("c_custkey") * 2863311 + 16777217) % 4294967296
    return c.select("c_custkey", ip.alias("ip_num"), long_to_ipv4(ip).alias("ip"), host.alias("hostname"))


def _hints(spark, d):
    h = _hosts(spark, d)
    forward = h.where(F.col("c_custkey") % 4 < 3).select("hostname", "ip")
    airports = spark.createDataFrame(
        [("fra", 50.0, 8.6, "Frankfurt", "C0"), ("lhr", 51.5, -0.5, "London", "C3"), ("nrt", 35.8, 140.4, "Tokio", "C6")],
        "code string, lat double, lon double, city string, country string",
    )
    carriers = spark.createDataFrame(
        [("de.net.dtag.de", "hh", 53.6, 10.0, "Hamburg", "C9")],
        "suffix string, code string, lat double, lon double, city string, country string",
    )
    return G.confirm_rdns(h.select("ip", "hostname"), forward, airports, carriers)


@query(
    "rdns_hints",
    f"WITH {_HOSTS} SELECT {_DOT.format(n='ip')} AS ip, hostname, city FROM hint WHERE city IS NOT NULL AND ok",
)
def rdns_hints(spark, d):
    return _hints(spark, d).select("ip", "hostname", F.col("hint.city").alias("city"))


_LOC = _RANGES + ", " + _HOSTS + """,
loc AS (
  SELECT h.ip, h.c_custkey, rg.country, CASE WHEN rg.country IS NULL THEN NULL WHEN h.city IS NOT NULL AND ok THEN 'reverse_dns'
    WHEN rg.city IS NOT NULL THEN 'city_database' ELSE 'country' END AS source,
    CASE WHEN rg.country IS NULL THEN NULL WHEN h.city IS NOT NULL AND ok THEN h.city ELSE rg.city END AS place,
    rg.lat, rg.lon, CAST(substr(rg.country, 2) AS BIGINT) AS k
  FROM hint h LEFT JOIN rg ON h.ip BETWEEN s AND e)"""


def _located(spark, d):
    hosts = _hosts(spark, d)
    city = _ranges(spark, d).select("start", "end", F.col("country").alias("city_country"), "city", "lat", "lon", F.lit(None).cast("string").alias("region"))
    rows = G.geo_lookup(hosts, city).withColumn("country_code", F.lit(None).cast("string"))
    rows = rows.join(_hints(spark, d).select("ip", "hint"), "ip", "left")
    return G.combine_location(rows, _countries(spark, d))


@query(
    "location_precedence",
    f"""WITH {_LOC} SELECT c_custkey, source, place AS city,
  CAST(CASE WHEN source = 'city_database' THEN lat WHEN source = 'country' THEN k * 2.0 - 20 END AS DOUBLE) AS db_lat FROM loc""",
)
def location_precedence(spark, d):
    out = _located(spark, d)
    src = F.col("located.source")
    return out.select(
        "c_custkey", src.alias("source"), F.col("located.city").alias("city"),
        F.when(src.isin("city_database", "country"), F.col("located.lat")).alias("db_lat"),
    )


@query("unresolved_remotes", f"WITH {_LOC} SELECT count(*) FILTER (source IS NULL) AS unresolved FROM loc")
def unresolved_remotes(spark, d):
    return G.unresolved_count(_located(spark, d).withColumn("hostname", F.lit("h"))).select("unresolved")


@query("unmapped_locations", f"WITH {_LOC} SELECT c_custkey FROM loc WHERE source IS NULL")
def unmapped_locations(spark, d):
    located = _located(spark, d)
    return G.unmapped_locations(_hosts(spark, d), located).select("c_custkey")


@query(
    "place_texts",
    f"""WITH {_LOC} SELECT c_custkey, CASE WHEN source = 'country' THEN 'NATION_' || k
  WHEN source = 'city_database' THEN 'ca. ' || place || ', NATION_' || k END AS place FROM loc WHERE source IN ('country', 'city_database')""",
)
def place_texts(spark, d):
    out = _located(spark, d).where(F.col("located.source").isin("country", "city_database")).select("c_custkey", "located.*")
    out = G.country_dim(out, _countries(spark, d))
    return out.select("c_custkey", G.place_text(F.col("country_name"), F.col("city"), F.col("source")).alias("place"))


# --- routes ------------------------------------------------------------------------------------
def _hops(spark, d):
    """Each order is a hop on the way to its customer's address."""
    target = _hosts(spark, d).select(F.col("c_custkey").alias("o_custkey"), F.col("ip").alias("target"))
    k = F.col("o_orderkey") % table_size(spark, d)
    ip = (k * 2863311 + 16777217) % 4294967296
    hops = table(spark, d, "orders").join(target, "o_custkey").select(
        "target", F.col("o_custkey"), F.col("o_orderkey").alias("ttl"),
        F.when(F.col("o_orderstatus") != "P", long_to_ipv4(ip)).alias("ip"),
    )
    return hops


def table_size(spark, d) -> int:
    """Number of customers (one Parquet footer count)."""
    return table(spark, d, "customer").count()


_HOP = _LOC + """,
n AS (SELECT count(*) AS n FROM customer),
hop AS (SELECT o_custkey, o_orderkey AS ttl, CASE WHEN o_orderstatus <> 'P' THEN ((o_orderkey % n.n) * 2863311 + 16777217) % 4294967296 END AS ip FROM orders, n),
hl AS (SELECT h.*, l.source, l.place, l.k, CASE WHEN h.ip BETWEEN 167772160 AND 184549375 OR h.ip BETWEEN 2130706432 AND 2147483647 OR h.ip BETWEEN 2886729728 AND 2887778303
  OR h.ip BETWEEN 3232235520 AND 3232301055 OR h.ip BETWEEN 2851995648 AND 2852061183 OR h.ip BETWEEN 3758096384 AND 4026531839 OR h.ip BETWEEN 3221225984 AND 3221226239
  OR h.ip BETWEEN 3325256704 AND 3325256959 OR h.ip BETWEEN 3405803776 AND 3405804031 THEN true ELSE false END AS local FROM hop h LEFT JOIN loc l ON l.ip = h.ip)"""


def _located_hops(spark, d):
    return G.locate_hops(_hops(spark, d), _located(spark, d).select("ip", "located", "hint"), _countries(spark, d))


@query(
    "located_hops",
    f"""WITH {_HOP} SELECT ttl, CASE WHEN ip IS NULL THEN 'silent' WHEN local THEN 'local network' WHEN source IS NULL THEN 'unknown'
  WHEN source = 'country' THEN 'NATION_' || k WHEN source = 'city_database' THEN place || ', NATION_' || k ELSE place END AS place FROM hl""",
)
def located_hops(spark, d):
    h = _located_hops(spark, d)
    # Of hops with a name hint, show the city alone.
    place = F.when(F.col("hint").isNotNull(), F.col("hint.city")).otherwise(F.col("place"))
    text = F.when(F.col("ip").isNull(), F.lit("silent")).otherwise(F.coalesce(place, F.lit("unknown")))
    return h.select("ttl", text.alias("place"))


@query(
    "waypoint_counts",
    f"""WITH {_HOP} SELECT o_custkey, count(*) AS waypoints FROM hl
WHERE ip IS NOT NULL AND NOT local AND source IS NOT NULL AND ip <> (o_custkey * 2863311 + 16777217) % 4294967296 GROUP BY ALL""",
)
def waypoint_counts(spark, d):
    return G.waypoints(_located_hops(spark, d)).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("waypoints"))


@query(
    "refined_points",
    f"""WITH {_HOP}, h AS (SELECT *, (o_custkey * 2863311 + 16777217) % 4294967296 AS target FROM hl WHERE source = 'reverse_dns' AND NOT local),
b AS (SELECT target, CASE place WHEN 'Frankfurt' THEN 'C0' WHEN 'London' THEN 'C3' WHEN 'Hamburg' THEN 'C9' ELSE 'C6' END AS country,
  arg_max(place, ttl) AS city FROM h WHERE ip <> target GROUP BY ALL)
SELECT c_custkey, CASE WHEN source = 'country' AND b.city IS NOT NULL THEN 'route' ELSE source END AS source,
  CASE WHEN source = 'country' AND b.city IS NOT NULL THEN b.city ELSE place END AS city
FROM loc LEFT JOIN b ON b.target = loc.ip AND b.country = loc.country WHERE source IS NOT NULL""",
)
def refined_points(spark, d):
    hops = stage(_located_hops(spark, d))
    points = _located(spark, d).where(F.col("located").isNotNull()).select("ip", "c_custkey", "located.*")
    out = G.refine_from_route(points, hops)
    return out.select("c_custkey", "source", "city")


@query("map_export")
def map_export(spark, d):
    points = G.country_dim(_located(spark, d).where(F.col("located").isNotNull()).select("ip", "located.*"), _countries(spark, d)).select(
        "ip", F.lit(None).cast("string").alias("program"),
        G.place_text(F.col("country_name"), F.col("city"), F.col("source")).alias("place"),
        G.place_detail(F.col("country_name"), F.col("city"), F.col("region"), F.col("lat"), F.col("lon"), F.col("source")).alias("detail"),
        "lat", "lon",
    )
    return map_points(points, _located_hops(spark, d)).withColumn("route", F.to_json("route"))


@query(
    "next_route_target",
    f"""WITH {EV}, s AS (SELECT user_id, min(ts_us) AS f FROM ev GROUP BY ALL)
SELECT {_DOT.format(n=_IP)} AS ip FROM s WHERE user_id NOT IN (SELECT user_id FROM ev WHERE unit = 'error' AND value > 80) ORDER BY f DESC, {_IP} LIMIT 1""",
)
def next_route_target(spark, d):
    ev = events(spark, d).withColumn("ip", long_to_ipv4(_ip()))
    points = ev.groupBy("ip").agg(F.min("ts_us").alias("first_seen_us"))
    routes = ev.where((F.col("unit") == "error") & (F.col("value") > 80)).select(F.col("ip").alias("target"))
    return G.next_route_target(points, routes).select("ip")


# --- collected text ----------------------------------------------------------------------------
_HEX = "printf('%02X%02X%02X%02X', ({n}) & 255, (({n}) >> 8) & 255, (({n}) >> 16) & 255, (({n}) >> 24) & 255)"


def _hex_le(n):
    return F.upper(F.concat(*[F.lpad(F.hex(F.shiftright(n, s).bitwiseAND(F.lit(255))), 2, "0") for s in (0, 8, 16, 24)]))


def _socket_lines(spark, d):
    n = _ip()
    state = F.when(F.col("event_type") == "error", F.lit("06")).otherwise(F.lit("01"))
    return table(spark, d, "events").select(
        (F.col("user_id") % 4).cast("string").alias("hostname"), F.lit(0).cast("bigint").alias("collected_at"),
        (F.col("event_id") + 1).alias("line_no"),
        F.concat_ws(
            " ", F.lit("  "), F.concat(F.col("event_id").cast("string"), F.lit(":")), F.lit("0100007F:1F90"), F.concat(_hex_le(n), F.lit(":01BB")),
            state, F.lit("00000000:00000000 00:00000000 00000000 1000 0"), (F.col("event_id") + 7000).cast("string"), F.lit("1 ffff8800"),
        ).alias("line"),
    )


_PUB = f"""pub AS (SELECT *, {_IP} AS n FROM events WHERE event_type <> 'error'),
pub2 AS (SELECT * FROM pub WHERE NOT (n BETWEEN 167772160 AND 184549375 OR n BETWEEN 2130706432 AND 2147483647 OR n BETWEEN 2886729728 AND 2887778303
  OR n BETWEEN 3232235520 AND 3232301055 OR n BETWEEN 2851995648 AND 2852061183 OR n BETWEEN 3758096384 AND 4026531839))"""


@query(
    "socket_table",
    f"WITH {_PUB} SELECT CAST(user_id % 4 AS VARCHAR) AS hostname, {_DOT.format(n='n')} AS ip, event_id + 7000 AS inode FROM pub2",
)
def socket_table(spark, d):
    return C.read_socket_table(_socket_lines(spark, d)).select("hostname", "ip", "inode")


@query(
    "connection_programs",
    f"""WITH {_PUB}, p AS (SELECT CAST(user_id % 4 AS VARCHAR) AS hostname, n, event_id, event_type FROM pub2)
SELECT hostname, (event_id + 7000) % 2 AS collected_at, {_DOT.format(n='n')} AS ip,
  arg_max(event_type, (event_id % 500, event_id)) AS program FROM p GROUP BY hostname, (event_id + 7000) % 2, n""",
)
def connection_programs(spark, d):
    """Two collections; every inode occurs in both, for another connection and program."""
    seen, inode = F.col("inode") % 2, F.floor(F.col("inode") / 2)
    sockets = C.read_socket_table(_socket_lines(spark, d)).select("hostname", "ip", seen.alias("collected_at"), inode.alias("inode"))
    procs = table(spark, d, "events").withColumn("inode", F.col("event_id") + 7000).select(
        (F.col("user_id") % 4).cast("string").alias("hostname"), seen.alias("collected_at"), inode.alias("inode"),
        (F.col("event_id") % 500).alias("pid"), F.col("event_type").alias("program"),
    )
    conns = sockets.select("hostname", "collected_at", "ip").distinct()
    return G.attach_program(conns, sockets, procs).select("hostname", "collected_at", "ip", "program")


@query(
    "default_gateways",
    f"SELECT CAST(c_custkey AS VARCHAR) AS hostname, {_DOT.format(n='c_custkey + 3232235521')} AS gateway FROM customer WHERE c_nationkey <> 3",
)
def default_gateways(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i"))
    gw = _hex_le(F.col("c_custkey") + 3232235521)
    line = F.when(F.col("i") == 0, F.lit("Iface Destination Gateway Flags")).when(
        F.col("i") == 1, F.lit("eth0\t0000A8C0\t00000000\t0001")
    ).otherwise(F.concat(F.lit("eth0\t"), F.when(F.col("c_nationkey") == 3, F.lit("0001A8C0")).otherwise(F.lit("00000000")), F.lit("\t"), gw, F.lit("\t0003")))
    rows = c.select(F.col("c_custkey").cast("string").alias("hostname"), F.lit(0).alias("collected_at"), F.col("i").alias("line_no"), line.alias("line"))
    return C.read_default_gateway(rows).select("hostname", "gateway")


@query(
    "neighbors_table",
    "SELECT '10.0.' || (c_custkey // 256 % 256) || '.' || (c_custkey % 256) AS ip, printf('aa:bb:cc:00:%02x:%02x', c_custkey // 256 % 256, c_custkey % 256) AS mac FROM customer WHERE c_nationkey NOT IN (1, 2)",
)
def neighbors_table(spark, d):
    c = table(spark, d, "customer")
    hi, lo = F.floor(F.col("c_custkey") / 256).cast("bigint") % 256, F.col("c_custkey") % 256
    ip = F.when(F.col("c_nationkey") == 1, F.lit("fe80::1")).otherwise(F.concat(F.lit("10.0."), hi.cast("string"), F.lit("."), lo.cast("string")))
    mac = F.concat(F.lit("AA:BB:CC:00:"), F.lpad(F.hex(hi), 2, "0"), F.lit(":"), F.lpad(F.hex(lo), 2, "0"))
    line = F.when(F.col("c_nationkey") == 2, F.concat(ip, F.lit(" dev eth0 FAILED"))).otherwise(F.concat(ip, F.lit(" dev eth0 lladdr "), mac, F.lit(" STALE")))
    rows = c.select(F.lit("h").alias("hostname"), F.lit(0).alias("collected_at"), F.col("c_custkey").alias("line_no"), line.alias("line"))
    return C.read_neighbors(rows).select("ip", "mac")


@query(
    "route_reports",
    """WITH l AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE '10.0.0.' || (o_orderkey % 2) END AS ip FROM orders),
k AS (SELECT *, lag(ip) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM l)
SELECT CAST(o_custkey AS VARCHAR) AS target, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS ttl, ip
FROM k WHERE ip IS NULL OR ip IS DISTINCT FROM prev""",
)
def route_reports(spark, d):
    o = table(spark, d, "orders")
    ip = F.when(F.col("o_orderstatus") == "P", F.lit("???")).otherwise(F.concat(F.lit("10.0.0."), (F.col("o_orderkey") % 2).cast("string")))
    rows = o.select(
        F.lit("h").alias("hostname"), F.lit(0).alias("collected_at"), F.col("o_custkey").cast("string").alias("target"),
        F.col("o_orderkey").alias("line_no"), F.concat(F.lit("  3.|-- "), ip, F.lit("   0.0%  1  9.4")).alias("line"),
    )
    return C.read_route_reports(rows).select("target", "ttl", "ip")


@query(
    "public_addresses",
    f"SELECT event_id AS seq, {_DOT.format(n=_IP)} AS ip, {_IP} AS back, {_HEX.format(n=_IP)} AS hex FROM events",
)
def public_addresses(spark, d):
    dotted = hex_le_ipv4(_hex_le(_ip()))
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), dotted.alias("ip"), ipv4_to_long(dotted).alias("back"), _hex_le(_ip()).alias("hex")
    )


# --- presence ----------------------------------------------------------------------------------
@query(
    "session_presence",
    f"""WITH {EV}, g AS (SELECT hostname, user_id, ts_us, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY hostname, user_id ORDER BY ts_us) < 43200000000 THEN 0 ELSE 1 END AS n FROM ev),
s AS (SELECT *, sum(n) OVER (PARTITION BY hostname, user_id ORDER BY ts_us) AS sid FROM g)
SELECT hostname, user_id AS ip, min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us, count(*) AS sightings FROM s GROUP BY hostname, user_id, sid""",
)
def session_presence(spark, d):
    ev = events(spark, d).withColumn("ip", F.col("user_id"))
    return P.connection_sessions(ev, 12 * HOUR).select("hostname", "ip", "first_seen_us", "last_seen_us", "sightings")


@query(
    "outage_islands",
    f"""WITH {EV}, g AS (SELECT *, sum(CASE WHEN unit IN ('error', 'view') THEN 0 ELSE 1 END) OVER (PARTITION BY hostname ORDER BY ts_us, seq) AS g FROM ev),
r AS (SELECT *, CASE WHEN unit IN ('error', 'view') THEN sum(CASE WHEN unit IN ('error', 'view') THEN 1 ELSE 0 END) OVER (PARTITION BY hostname, g ORDER BY ts_us, seq) ELSE 0 END AS f FROM g)
SELECT hostname, seq, CAST(f AS BIGINT) AS failures, f >= 2 AS offline FROM r""",
)
def outage_islands(spark, d):
    ev = events(spark, d).withColumn("reachable", ~F.col("unit").isin("error", "view"))
    return P.router_outage(ev).select("hostname", "seq", "failures", "offline")


@query(
    "device_registry",
    f"""WITH {EV}, g AS (SELECT hostname, user_id AS mac, ts_us, seq, CASE WHEN value > 50 THEN unit END AS name, '10.0.' || (seq % 100) || '.1' AS ip,
    CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY hostname, user_id ORDER BY ts_us, seq) <= 172800000000 THEN 0 ELSE 1 END AS n FROM ev),
s AS (SELECT *, sum(n) OVER (PARTITION BY hostname, mac ORDER BY ts_us, seq) AS sid FROM g),
l AS (SELECT *, max(sid) OVER (PARTITION BY hostname, mac) AS m FROM s),
v AS (SELECT hostname, mac, arg_max(ip, (ts_us, seq)) AS ip, coalesce(arg_max(name, (ts_us, seq)) FILTER (name IS NOT NULL), arg_min(ip, (ts_us, seq))) AS display_name,
  min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us FROM l WHERE sid = m GROUP BY ALL)
SELECT * FROM v WHERE last_seen_us >= 1706659200000000 - 172800000000""",
)
def device_registry(spark, d):
    s = events(spark, d).select(
        "hostname", F.col("user_id").alias("mac"), "ts_us", "seq", F.when(F.col("value") > 50, F.col("unit")).alias("display_name"),
        F.concat(F.lit("10.0."), (F.col("seq") % 100).cast("string"), F.lit(".1")).alias("ip"),
    )
    return P.device_registry(s, 1706659200000000, 48 * HOUR)


@query(
    "context_lines",
    f"""WITH {EV}, num AS (SELECT *, row_number() OVER (PARTITION BY hostname ORDER BY ts_us, seq) AS rn, count(*) OVER (PARTITION BY hostname) AS n FROM ev),
an AS (SELECT DISTINCT hostname, ts_us // 86400000000 AS anchor_id, (ts_us // 86400000000) * 86400000000 + 43200000000 AS anchor_us FROM ev),
best AS (SELECT a.hostname, a.anchor_id, arg_min(rn, (abs(ts_us - anchor_us), rn)) AS idx, any_value(n) AS n FROM an a JOIN num USING (hostname) GROUP BY ALL)
SELECT b.hostname, b.anchor_id, num.seq, num.rn - idx AS "offset", idx - 1 < 3 OR b.n - idx < 4 AS truncated
FROM best b JOIN num ON num.hostname = b.hostname AND num.rn BETWEEN idx - 3 AND idx + 4""",
)
def context_lines(spark, d):
    ev = events(spark, d)
    day = F.call_function("div", F.col("ts_us"), F.lit(24 * HOUR).cast("bigint"))
    anchors = ev.select("hostname", day.alias("anchor_id"), (day * 24 * HOUR + 12 * HOUR).alias("anchor_us")).distinct()
    return P.context_lines(ev, anchors, 3, 4).select("hostname", "anchor_id", "seq", "offset", "truncated")
