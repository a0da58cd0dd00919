import json

from pyspark.sql import functions as F

from vigilframe import sinks
from vigilframe.config import ActionPolicy
from vigilframe.operators import actions as A
from vigilframe.operators import geo as G
from vigilframe.operators import inventory as I
from vigilframe.operators.events import canonical_events
from vigilframe.operators.filters import mute_filter, quiet_filter, self_filter
from vigilframe.sources import collected as C
from vigilframe.sources.journal import parse_journal
from vigilframe.streaming import store


def lines(spark, texts, **extra):
    rows = [("h", 0, i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "hostname string, collected_at int, line_no int, line string")
    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def test_collected_text(spark):
    tcp = [
        "  sl  local_address rem_address   st tx_queue rx_queue tr tm->when retrnsmt   uid  timeout inode",
        "   0: 0100007F:1F90 08080808:01BB 01 00000000:00000000 00:00000000 00000000  1000        0 4711 1 0 20 4",
        "   1: 0100007F:1F90 0101A8C0:01BB 01 00000000:00000000 00:00000000 00000000  1000        0 4712 1 0 20 4",
        "   2: 0100007F:1F90 04030201:01BB 06 00000000:00000000 00:00000000 00000000  1000        0 4713 1 0 20 4",
        "   3: broken",
    ]
    assert [(r.ip, r.inode) for r in C.read_socket_table(lines(spark, tcp)).collect()] == [("8.8.8.8", 4711)]
    route = ["Iface Destination Gateway", "eth0 0001A8C0 00000000", "eth0 00000000 0101A8C0", "eth1 00000000 0201A8C0"]
    assert [r.gateway for r in C.read_default_gateway(lines(spark, route)).collect()] == ["192.168.1.1"]
    arp = ["192.168.1.20 dev eth0 lladdr AA:bb:cc:dd:ee:ff REACHABLE", "192.168.1.21 dev eth0 FAILED", "fe80::1 dev eth0 lladdr aa:bb:cc:dd:ee:ff STALE"]
    assert [(r.ip, r.mac) for r in C.read_neighbors(lines(spark, arp)).collect()] == [("192.168.1.20", "aa:bb:cc:dd:ee:ff")]
    mtr = ["Start: now", "HOST: me", "  1.|-- 192.168.1.1 0.0%", "  2.|-- ??? 100", "  3.|-- ??? 100", "  4.|-- 5.6.7.8 0", "  5.|-- 5.6.7.8 0"]
    hops = C.read_route_reports(lines(spark, mtr, target="8.8.8.8")).orderBy("ttl").collect()
    assert [r.ip for r in hops] == ["192.168.1.1", None, None, "5.6.7.8"]


def test_services(spark):
    block = lambda i, load="loaded", uf="enabled", ty="simple", act="active", sub="running": f"Id={i}\nLoadState={load}\nUnitFileState={uf}\nType={ty}\nActiveState={act}\nSubState={sub}"
    blocks = [
        block("a.service"), block("b.timer", sub="waiting"), block("c.service", act="failed", sub="failed"), block("d.service", act="inactive", sub="dead"),
        block("e.service", uf="static", act="inactive", sub="dead"), block("f.service", load="not-found"), block("g.service", sub="exited"),
        block("xdg-h.service", ty="oneshot", act="inactive", sub="dead"), "", "Id=\nActiveState=active\nSubState=x", "Id=i.service\nActiveState=active",
    ]
    units = C.parse_unit_blocks(spark.createDataFrame([(b,) for b in blocks], "value string"))
    services = I.classify_service(units)
    assert [(r.name, r.status) for r in I.order_services(I.hide_prefixes(services)).collect()] == [
        ("c.service", "failed"), ("d.service", "not_running"), ("a.service", "running"), ("b.timer", "running"), ("e.service", "idle"), ("g.service", "idle"),
    ]
    files = ["Name=Mail\nExec=/usr/bin/mail %U", "Name=Off\nExec=x\nHidden=true", "Name=Flat\nExec=flatpak run --command=term org.t", "Name=Sh\nExec=sh -c 'run it'", "Exec=x", "Name=Empty\nExec=%U"]
    entries = C.parse_autostart(spark.createDataFrame([(f,) for f in files], "value string")).withColumn("hostname", F.lit("h"))
    procs = spark.createDataFrame([("h", "/opt/mail --x"), ("h", "sh -c run it"), ("h", "sh -c other")], "hostname string, cmdline string")
    assert {r.name: r.status for r in I.autostart_running(entries, procs).collect()} == {"Mail": "running", "Flat": "idle", "Sh": "running"}


def test_filters(spark):
    rows = [
        ("h", "a.service", None, 10, "x", 100, 0, 1), ("h", "init.scope", "a.service", 1, "x", 100, 1, 1), ("h", None, None, 7, "x", 100, 2, 2),
        ("h", "b", None, 8, "(root) LIST (root)", 100, 3, 2), ("h", "b", None, 9, "y", 500, 4, 2), ("g", "a.service", None, 7, "x", 100, 5, 1),
    ]
    ev = canonical_events(spark.createDataFrame(rows, "hostname string, unit string, unit_field string, pid int, message string, ts_us bigint, seq bigint, template_id bigint"))
    sup = spark.createDataFrame([("h", "unit", "a.service", 50, 200), ("h", "pid", "7", 50, None), ("h", "pid", "9", 50, 200)], "hostname string, kind string, key string, from_us bigint, until_us bigint")
    assert {r.seq for r in self_filter(ev, sup).collect()} == {3, 4, 5}
    assert {r.seq for r in self_filter(ev, sup, own_pids=(8,)).collect()} == {4, 5}
    mutes = spark.createDataFrame([("h", 1, None, 0, None), ("h", 2, "b", 0, 200)], "hostname string, template_id bigint, unit string, from_us bigint, until_us bigint")
    assert {r.seq for r in mute_filter(ev, mutes).collect()} == {2, 4, 5}
    assert {r.seq for r in quiet_filter(ev).collect()} == {0, 1, 2, 4, 5}


def test_journal(spark):
    docs = [
        '{"__REALTIME_TIMESTAMP":"7","MESSAGE":[72,105,255,254],"_PID":"x","PRIORITY":"3","EXTRA":1}', '{"__REALTIME_TIMESTAMP":"8"}',
        "{broken", '{"MESSAGE":"m"}', "  ", '{"__REALTIME_TIMESTAMP":"-5"}',
    ]
    got = parse_journal(spark.createDataFrame([(d,) for d in docs], "value string")).collect()
    assert [(r.ts_us, r.message, r.message_was_binary, r.error) for r in got] == [
        (7, "Hi��", True, None), (8, "", False, None), (None, "", False, "invalid_json"),
        (None, "m", False, "missing_timestamp"), (None, "", False, "missing_timestamp"),
    ]
    assert (got[0].pid, got[0].priority) == (None, 3)


def test_geography(spark):
    hosts = ["osl2-core.example.net", "edge-4.osl-9.pop.example.net", "oslofjord.example.com", "rt1.TRD.core.fjordnet.example", "rt1.XX.core.fjordnet.example", "core.fjordnet.example", "a.bgo.osl.example"]
    ptr = spark.createDataFrame([(str(i), h) for i, h in enumerate(hosts)], "ip string, hostname string")
    airports = spark.createDataFrame([("osl", 60.2, 11.1, "Oslo", "NO"), ("bgo", 60.3, 5.2, "Bergen", "NO")], "code string, lat double, lon double, city string, country string")
    carriers = spark.createDataFrame([("core.fjordnet.example", "trd", 63.4, 10.4, "Trondheim", "NO")], "suffix string, code string, lat double, lon double, city string, country string")
    hint = {r.ip: r.hint.city for r in G.confirm_rdns(ptr, ptr.where("ip <> '1'").select("hostname", "ip"), airports, carriers).collect()}
    assert hint == {"0": "Oslo", "3": "Trondheim", "6": "Bergen"}
    ranges = spark.createDataFrame([(10, 20, "AA"), (70_000, 400_000, "BB"), (400_001, 400_001, "CC")], "start bigint, end bigint, country string")
    ips = spark.createDataFrame([(i,) for i in (5, 10, 20, 21, 70_000, 131_072, 400_000, 400_001, 400_002, 20)], "ip_num bigint")
    got = sorted((r.ip_num, r.country or "") for r in G.geo_lookup(ips, ranges).collect())
    assert got == [(5, ""), (10, "AA"), (20, "AA"), (20, "AA"), (21, ""), (70_000, "BB"), (131_072, "BB"), (400_000, "BB"), (400_001, "CC"), (400_002, "")]
    raw = spark.createDataFrame(
        [(1, " de ", None, "Berlin", None, " ", 52.0, 13.0), (2, "XX", "A", None, None, None, 1.0, 1.0), (3, "DE", "Köln", "Cologne", "NRW", None, 95.0, 1.0), (4, "DE", " ", "Bonn", None, None, 1.0, 1.0)],
        "k int, country_code string, city_de string, city_en string, region_de string, region_en string, lat double, lon double",
    )
    countries = spark.createDataFrame([("DE", 51.0, 9.0, "Germany")], "code string, lat double, lon double, name string")
    hit = {r.k: (r.country, r.city, r.region, r.lat) for r in G.clean_city_hit(raw, countries).collect()}
    assert hit == {1: ("DE", "Berlin", None, 52.0), 2: (None, None, None, None), 3: ("DE", None, "NRW", None), 4: ("DE", None, None, None)}


def test_actions(spark):
    policy = ActionPolicy(allowed_kinds=("restart_unit", "terminate_process"), allowed_units=("a.service", "bad"), max_block_secs=1)
    rows = [(i, "restart_unit", "a.service", None, i * 60_000_000) for i in range(5)] + [
        (5, "restart_unit", "z.service", None, 0), (6, "terminate_process", None, 1, 0), (7, "block_ip", None, None, 0), (8, "restart_unit", "bad", None, 0), (9, "restart_unit", "a.service", None, 601_000_000),
    ]
    df = spark.createDataFrame(rows, "seq bigint, kind string, unit string, pid bigint, ts_us bigint").withColumns(
        {"request_id": F.col("seq"), "ip": F.lit(None).cast("string"), "grace_secs": F.lit(500), "duration_secs": F.lit(5), "template_id": F.lit(0).cast("bigint")}
    )
    got = {r.seq: r for r in A.decide_actions(df, policy).collect()}
    assert [got[i].outcome for i in range(10)] == ["dry_run"] * 3 + ["denied"] * 6 + ["dry_run"]
    assert (got[3].reason, got[3].retry_after_secs, got[4].retry_after_secs) == ("rate_limited", 420, 360)
    assert got[5].reason == got[7].reason == "not_allowed" and got[8].reason == "invalid_parameter: unknown unit type"
    assert (got[0].grace_secs, got[0].duration_secs) == (60, 60)


def test_sinks_and_store(spark, tmp_path):
    row = ("h", 5, 1, 3, 255, 'said "hi", twice', "plain", None, 7, "warn", (0.25,))
    an = spark.createDataFrame([row], "hostname string, ts_us bigint, seq bigint, id bigint, template_id bigint, template_text string, sample_message string, unit string, pid int, level string, breakdown struct<combined:double>")
    out = str(tmp_path / "csv")
    sinks.write_anomalies_csv(an.coalesce(1), out)
    text = [r.value for r in spark.read.text(out).collect()]
    assert text == [sinks.CSV_HEADER, '3,5,Warn,,7,00000000000000ff,"said ""hi"", twice",plain,0.2500']
    sinks.write_anomalies_json(an, str(tmp_path / "json"))
    assert json.loads(spark.read.text(str(tmp_path / "json")).collect()[0].value)["level"] == "warn"
    snaps = spark.createDataFrame([("h", 1, 5, 0.5), ("h", 2, 9, 0.25)], "hostname string, ts_us bigint, events bigint, load1 double")
    sinks.write_metrics_text(snaps, str(tmp_path / "prom"))
    prom = [r.value for r in spark.read.text(str(tmp_path / "prom" / "hostname=h")).collect()]
    assert "vigilframe_events_total 9" in prom and "# TYPE vigilframe_load1 gauge" in prom and prom[2] == "vigilframe_events_total 9"

    path = str(tmp_path / "store")
    assert store.restore_baselines(spark, path, 5, "h") is None
    store.checkpoint_baselines(spark, path, an, snaps, snaps, 5, "h", 1)
    store.checkpoint_baselines(spark, path, an, snaps.limit(1), snaps, 5, "h", 2)
    assert store.restore_baselines(spark, path, 5, "other")["profiles"].count() == 1
    assert list(store.restore_baselines(spark, path, 10, "h")) == ["registry"]
    target = str(tmp_path / "table")
    assert store.write_if_changed(snaps, target) and not store.write_if_changed(snaps.orderBy("events"), target)
    assert store.write_if_changed(snaps.limit(1), target)


def test_location_chain(spark):
    hint = "struct<lat:double,lon:double,city:string,country:string>"
    countries = spark.createDataFrame([("DE", 51.0, 9.0, "Germany"), ("US", 38.0, -97.0, "United States")], "code string, lat double, lon double, name string")
    rows = [
        ("9.0.0.1", "US", None, None, None, None, None, (50.0, 8.0, "Frankfurt", "DE")), ("9.0.0.2", "US", "DE", "Bonn", 50.7, 7.1, "NRW", None),
        ("9.0.0.3", "DE", None, None, None, None, None, None), ("9.0.0.4", None, None, None, None, None, None, None), ("9.0.0.5", "ZZ", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, f"ip string, country_code string, city_country string, city string, lat double, lon double, region string, hint {hint}")
    located = G.combine_location(df, countries).cache()
    got = {r.ip[-1]: r.located and (r.located.country, r.located.city, r.located.source) for r in located.collect()}
    assert got == {
        "1": ("DE", "Frankfurt", "reverse_dns"), "2": ("DE", "Bonn", "city_database"), "3": ("DE", None, "country"), "4": None, "5": None,
    }
    hops = spark.createDataFrame(
        [("9.0.0.3", 1, "192.168.1.1"), ("9.0.0.3", 2, None), ("9.0.0.3", 3, "9.0.0.1"), ("9.0.0.3", 4, "9.0.0.4"), ("9.0.0.3", 5, "9.0.0.3")],
        "target string, ttl int, ip string",
    )
    placed = G.locate_hops(hops, located.select("ip", "located", "hint"), countries).cache()
    assert [r.place for r in placed.orderBy("ttl").collect()] == ["local network", None, "Frankfurt, Germany", None, "Germany"]
    assert [r.ttl for r in G.waypoints(placed).collect()] == [3]
    points = located.where("located is not null").select("ip", "located.*")
    refined = {r.ip[-1]: (r.city, r.source) for r in G.refine_from_route(points, placed).collect()}
    assert refined == {"1": ("Frankfurt", "reverse_dns"), "2": ("Bonn", "city_database"), "3": ("Frankfurt", "route")}


def test_late_policy(spark):
    from vigilframe.streaming.windows import clamp_interval_ms, late_policy

    batch = spark.createDataFrame([("h", 100, 0), ("h", 50, 1), ("h", 39, 2), ("h", 200, 3), ("h", 150, 4), ("g", 5, 0)], "hostname string, ts_us bigint, seq bigint")
    newest = spark.createDataFrame([("g", 1000)], "hostname string, newest_us bigint")
    got = {(r.hostname, r.seq): (r.effective_ts_us, r.dropped_late) for r in late_policy(batch, newest, 60).collect()}
    assert got == {("h", 0): (100, False), ("h", 1): (100, False), ("h", 2): (100, True), ("h", 3): (200, False), ("h", 4): (200, False), ("g", 0): (1000, True)}
    assert (clamp_interval_ms(1), clamp_interval_ms(10**6)) == (250, 60_000)


def test_queries_have_matching_names():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 100 and set(sql) <= set(queries)


def test_rate_limit_steps_equal_one_by_one():
    import random

    import numpy as np

    from vigilframe.operators.actions import admitted_until_full

    rng = random.Random(6)
    for _ in range(300):
        limit, window = rng.randrange(4), rng.choice([1, 5, 20])
        ts = np.array(sorted(rng.randrange(60) for _ in range(rng.randrange(25))), np.int64)
        cut, log, got, old = rng.randrange(len(ts) + 1), [], [], []
        for part in (ts[:cut], ts[cut:]):
            a, o, log = admitted_until_full(part, log, limit, window)
            got += a.tolist()
            old += o.tolist()
        want, kept, first = [], [], []
        for t in ts.tolist():
            kept = [x for x in kept if t - x < window]
            want.append(len(kept) < limit)
            first.append(0 if want[-1] else kept[0] if kept else t)
            kept += [t] * want[-1]
        assert got == want and [o for o, a in zip(old, got) if not a] == [f for f, a in zip(first, want) if not a]
