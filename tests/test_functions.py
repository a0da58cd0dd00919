import math

from pyspark.sql import functions as F

from vigilframe import functions as V


def one(spark, col, **values):
    df = spark.range(0, 1, 1, 1)
    for name, (value, dtype) in values.items():
        df = df.withColumn(name, F.lit(value).cast(dtype))
    return df.select(col.alias("x")).collect()[0].x


def py_fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = ((h ^ b) * 0x100000001B3) % 2**64
    return h


def test_fnv(spark):
    texts = ["", "sshd.service", "größe – ☃", "a" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [r.h for r in df.select(V.template_id_hex(V.fnv1a64(F.col("t"))).alias("h")).collect()]
    assert got == [f"{py_fnv(t.encode()):016x}" for t in texts]


MASKED = [
    ("10.0.0.5", "<IPV4>"), ("203.0.113.9,", "<IPV4>,"), ("fe80::1", "<IPV6>"), ("aa:bb:cc:dd:ee:ff", "<MAC>"),
    ("550e8400-e29b-41d4-a716-446655440000", "<UUID>"), ("sshd[1234]:", "sshd[<PID>]:"), ("(10.0.0.5),", "(<IPV4>),"),
    ("0xdeadbeef", "<HEX>"), ("/var/lib/docker/234", "<PATH>"), ("51422", "<NUM>"), ("2026-01-01T00:00:00Z", "<TIMESTAMP>"),
    ("03:04:05", "<TIMESTAMP>"), ("eth0", "eth0"), ("nvme0n1", "nvme0n1"), ("Accepted", "Accepted"), ("...", "..."), ("٣٤", "<NUM>"),
]


def test_mask(spark):
    V.register_sql_functions(spark)
    df = spark.createDataFrame([(f"  x {t}\t",) for t, _ in MASKED], "t string").coalesce(1)
    rows = df.select(V.mask_tokens(F.col("t")).alias("x"), F.expr("mask_tokens(t)").alias("y")).collect()
    assert [r.x for r in rows] == [r.y for r in rows] == [["x", m] for _, m in MASKED]


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs]) if xs else F.array().cast("array<double>")


def test_statistics(spark):
    assert one(spark, V.median(arr(3, 1, 2))) == 2
    assert one(spark, V.median(arr(4, 1, 2, 3))) == 2.5
    assert one(spark, V.median(arr())) is None
    assert one(spark, V.mad(arr(5, 5, 5, 5))) == 0
    assert one(spark, V.robust_z(F.lit(9.0), arr(), 1.0)) == 0
    assert one(spark, V.robust_z(F.lit(1e9), arr(1, 1, 1), 1.0)) == 50
    assert one(spark, V.robust_z(F.lit(20.0), arr(1, 1, 1, 1, 1, 1, 1, 1000), 1.0)) == 19
    assert math.isclose(one(spark, V.surprisal(F.lit(0), F.lit(100), F.lit(5))), -math.log2(0.5 / 103))
    assert one(spark, V.noisy_or((1.0, F.lit(1.0)), (0.8, F.lit(0.2)))) == 1
    assert math.isclose(one(spark, V.noisy_or((1.0, F.lit(0.5)), (0.8, F.lit(0.5)))), 1 - 0.5 * 0.6)
    assert one(spark, V.normalize_component(F.lit(3.0), 0.0)) == 0
    bins = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(w).alias("weight")) for v, w in [(3.0, 1.0), (1.0, 5.0), (2.0, 1.0)]])
    assert one(spark, V.weighted_median(bins)) == 1 and one(spark, V.weighted_mad(bins, F.lit(1.0))) == 0
    even = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(1.0).alias("weight")) for v in (1.0, 3.0)])
    assert one(spark, V.weighted_median(even)) == 2


def test_sql_names(spark):
    V.register_sql_functions(spark)
    row = spark.sql(
        "select robust_z(5, array(1d,2d,3d), 1.0) a, surprisal(0,100,5,0.5) b, slot_of(1704067200000000,'Europe/Berlin') c, fnv1a64('') d"
    ).collect()[0]
    assert row.a == 3 / (1 / 0.6745) and row.c == 2 and row.d == py_fnv(b"") - 2**64
    assert math.isclose(row.b, -math.log2(0.5 / 103))


def test_slots_and_text(spark):
    sat = 1_704_499_200_000_000  # Saturday, midnight UTC
    assert one(spark, V.slot_of(F.lit(sat))) == 1
    assert one(spark, V.slot_of(F.lit(sat), "America/New_York")) == 38  # Friday, 19 h
    assert one(spark, V.slot_hour(F.lit(48))) is None and one(spark, V.slot_hour(F.lit(39))) == 19
    assert one(spark, V.used_percent(F.lit(0), F.lit(5))) == 0
    assert one(spark, V.sanitize_relation(F.lit("  Depends -- ON!! "))) == "depends_on"
    assert one(spark, V.sanitize_relation(F.lit("§§"))) == "related_to"
    assert one(spark, V.short_label(F.lit("a/" + "x" * 30))) == "x" * 25 + "…"
    assert one(spark, V.relative_age(F.lit(0), F.lit(7_200_000_000))) == "2 h"
    text = "ä" * 600
    cut = one(spark, V.truncate_sample(F.col("t")), t=(text, "string"))
    assert cut.endswith("[…]") and len(cut.encode()) <= 1024 and cut == "ä" * 509 + "[…]"
    assert one(spark, V.truncate_sample(F.col("t")), t=("x" * 1024, "string")) == "x" * 1024


def test_paths(spark):
    assert one(spark, V.normalize_path(F.lit("/a/./b/../../../c//d"))) == "/c/d"
    assert one(spark, V.file_stem(F.lit("/a/.hidden"))) == ".hidden"
    assert one(spark, V.file_stem(F.lit("/a/b.tar.gz"))) == "b.tar"
    assert one(spark, V.file_ext(F.lit("/a.d/b"))) is None
    assert one(spark, V.parent_dir(F.lit("/a"))) == "/" and one(spark, V.parent_dir(F.lit("a"))) == ""
    assert one(spark, V.percent_decode(F.lit("a%20b+%zz%"))) == "a b+%zz%"


def test_addresses(spark):
    assert one(spark, V.hex_le_ipv4(F.lit("0101A8C0"))) == "192.168.1.1"
    assert one(spark, V.hex_le_ipv4(F.lit("xyz"))) is None
    assert one(spark, V.ipv4_to_long(F.lit("8.8.8.8"))) == 0x08080808
    assert one(spark, V.ipv4_to_long(F.lit("8.8.8.256"))) is None
    for ip, public in [("8.8.8.8", True), ("172.31.0.1", False), ("172.32.0.1", True), ("169.254.1.1", False), ("203.0.113.7", False), ("0.0.0.0", False)]:
        assert one(spark, V.is_routable_public(V.ipv4_to_long(F.lit(ip)))) is public
    assert one(spark, V.valid_position(F.lit(float("nan")), F.lit(1.0))) is False
    assert one(spark, V.valid_position(F.lit(None).cast("double"), F.lit(1.0))) is False
