"""Hashes, time slots, addresses, paths and display text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vigilframe.functions.stats import let

NO_UNIT = "<none>"  # fixed value: stands for a missing unit in every key
ANY_SLOT = 48  # fixed value: slot that collects all hours

_MASK32 = 4294967295
# The 64-bit FNV-1a offset basis as two 32-bit halves.
_FNV_HI, _FNV_LO = 3421674724, 2216829733


# --- hashing -----------------------------------------------------------------------------------
def fnv1a64(value: Column) -> Column:
    """64-bit FNV-1a of a string's UTF-8 bytes (or of a binary) as a signed bigint.

    ANSI mode forbids wrapping multiplication, so the state is kept in two 32-bit halves.
    """
    codes = F.transform(
        F.filter(F.split(F.decode(value.cast("binary"), "ISO-8859-1"), ""), lambda c: F.length(c) > 0),
        lambda c: F.ascii(c).cast("bigint"),
    )
    start = F.struct(F.lit(_FNV_HI).cast("bigint").alias("hi"), F.lit(_FNV_LO).cast("bigint").alias("lo"))

    def step(acc: Column, byte: Column) -> Column:
        x = acc["lo"].bitwiseXOR(byte)
        low = x * 435
        return F.struct(
            (acc["hi"] * 435 + F.shiftright(low, 32) + F.shiftleft(x, 8))
            .bitwiseAND(F.lit(_MASK32)).alias("hi"),
            low.bitwiseAND(F.lit(_MASK32)).alias("lo"),
        )

    return F.aggregate(
        codes, start, step, lambda acc: F.shiftleft(acc["hi"], 32).bitwiseOR(acc["lo"])
    )


def template_id_hex(template_id: Column) -> Column:
    return F.lpad(F.lower(F.hex(template_id)), 16, "0")


def unit_or_none(unit: Column) -> Column:
    return F.coalesce(unit, F.lit(NO_UNIT))


def unit_key(unit: Column) -> Column:
    return fnv1a64(unit_or_none(unit))


# --- time --------------------------------------------------------------------------------------
def bucket_of(ts_us: Column, bucket_us: int) -> Column:
    return _idiv(ts_us, bucket_us)


def _idiv(value: Column, divisor: int) -> Column:
    """Integer division without going through double."""
    return F.call_function("div", value, F.lit(divisor).cast("bigint"))


def local_us(ts_us: Column, tz: str = "UTC") -> Column:
    if tz == "UTC":
        return ts_us
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(ts_us), tz))


def slot_of(ts_us: Column, tz: str = "UTC") -> Column:
    """Local hour * 2 + (1 on Saturday and Sunday): 0..47."""
    local = local_us(ts_us, tz)
    hour = _idiv(local, 3_600_000_000) % 24
    # 1970-01-01 was a Thursday: (days + 4) % 7 is 0 on Sunday and 6 on Saturday.
    weekday = (_idiv(local, 86_400_000_000) + 4) % 7
    return (hour * 2 + F.when(weekday.isin(0, 6), 1).otherwise(0)).cast("int")


def slot_is_regular(slot: Column) -> Column:
    return slot < ANY_SLOT


def slot_hour(slot: Column) -> Column:
    return F.when(slot_is_regular(slot), F.floor(slot / 2).cast("int"))


def slot_is_weekend(slot: Column) -> Column:
    return F.when(slot_is_regular(slot), slot % 2 == 1)


def decay_factor(elapsed_buckets: Column, half_life_hours: float, bucket_seconds: int) -> Column:
    half_life = max(max(half_life_hours, 0.0) * 3600.0 / max(bucket_seconds, 1), 1.0)
    return F.pow(F.lit(0.5), elapsed_buckets / F.lit(half_life))


def relative_age(last_seen_us: Column, now_us: Column) -> Column:
    secs = _idiv(F.greatest(now_us - last_seen_us, F.lit(0).cast("bigint")), 1_000_000)
    return (
        F.when(secs < 60, F.lit("0 min"))
        .when(secs < 3600, F.concat(_idiv(secs, 60).cast("string"), F.lit(" min")))
        .when(secs < 86400, F.concat(_idiv(secs, 3600).cast("string"), F.lit(" h")))
        .otherwise(F.concat(_idiv(secs, 86400).cast("string"), F.lit(" d")))
    )


# --- addresses ---------------------------------------------------------------------------------
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4_PATTERN = rf"^(?:{_OCTET}\.){{3}}{_OCTET}\z"


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(IPV4_PATTERN)


def ipv4_to_long(ip: Column) -> Column:
    """Numeric form of a dotted IPv4 address; NULL for anything else."""

    def number(parts: Column) -> Column:
        value = F.lit(0).cast("bigint")
        for i in range(4):
            value = value * 256 + F.get(parts, F.lit(i)).cast("bigint")
        return value

    return let(ip, lambda text: F.when(is_ipv4(text), let(F.split(text, r"\."), number)))


def long_to_ipv4(value: Column) -> Column:
    return F.concat_ws(
        ".",
        *[F.shiftright(value, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)],
    )


def hex_le_ipv4(hex8: Column) -> Column:
    """Eight little-endian hex digits (kernel socket table) to a dotted address."""

    def dotted(text: Column) -> Column:
        octets = [F.conv(F.substring(text, p, 2), 16, 10) for p in (7, 5, 3, 1)]
        return F.when(text.rlike(r"^[0-9a-fA-F]{8}\z"), F.concat_ws(".", *octets))

    return let(hex8, dotted)


# IPv4 blocks that are not publicly routable (private, loopback, link-local,
# multicast, unspecified, broadcast, documentation), as first and last address.
NON_PUBLIC_BLOCKS: tuple[tuple[str, str], ...] = (
    ("10.0.0.0", "10.255.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("224.0.0.0", "239.255.255.255"),
    ("0.0.0.0", "0.0.0.0"),
    ("255.255.255.255", "255.255.255.255"),
    ("192.0.2.0", "192.0.2.255"),
    ("198.51.100.0", "198.51.100.255"),
    ("203.0.113.0", "203.0.113.255"),
)


def _ip_num(ip: str) -> int:
    a, b, c, d = (int(x) for x in ip.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def is_routable_public(ip_num: Column) -> Column:
    """True for a numeric IPv4 address outside every special-purpose block."""

    def public(n: Column) -> Column:
        inside = F.lit(False)
        for first, last in NON_PUBLIC_BLOCKS:
            inside = inside | n.between(_ip_num(first), _ip_num(last))
        return n.isNotNull() & ~inside

    return let(ip_num, public)


def valid_position(lat: Column, lon: Column) -> Column:
    """True when both are finite and on the globe (false, never NULL, otherwise)."""
    return F.coalesce(
        ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0),
        F.lit(False),
    )


# --- paths -------------------------------------------------------------------------------------
def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*\z", "$1")


def has_ext(path: Column) -> Column:
    return file_name(path).rlike(r"^.+\.[^.]*\z")


def file_ext(path: Column) -> Column:
    """Extension without the dot; NULL when the name has none."""
    return F.when(has_ext(path), F.regexp_extract(file_name(path), r"^.+\.([^.]*)\z", 1))


def parent_dir(path: Column) -> Column:
    """Everything before the last segment ('' for a bare name, '/' below the root)."""
    return F.when(path.rlike(r"^/[^/]*/*\z"), F.lit("/")).otherwise(
        F.regexp_replace(path, r"/*[^/]*/*\z", "")
    )


def normalize_path(path: Column) -> Column:
    """Resolve '.', '..' and repeated slashes lexically."""
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg.isin("", "."), acc)
        .when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(seg))),
    )
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))


def percent_decode(text: Column) -> Column:
    """Decode %XX sequences; invalid sequences and '+' stay as they are."""
    guarded = F.regexp_replace(
        F.regexp_replace(text, r"%(?![0-9a-fA-F]{2})", "%25"), r"\+", "%2B"
    )
    return F.coalesce(F.try_url_decode(guarded), text)


# --- display text ------------------------------------------------------------------------------
def used_percent(total: Column, used: Column) -> Column:
    ratio = used / F.nullif(total, F.lit(0)) * 100.0
    return F.coalesce(F.when(ratio.isNotNull(), F.least(F.greatest(ratio, F.lit(0.0)), F.lit(100.0))), F.lit(0.0))


def short_label(raw: Column) -> Column:
    last = F.element_at(F.split(raw, "/"), -1)
    return F.when(F.length(last) > 26, F.concat(F.substring(last, 1, 25), F.lit("…"))).otherwise(last)


def sanitize_relation(raw: Column) -> Column:
    """Reduce a relation name to snake_case of at most 40 characters."""
    snake = F.regexp_replace(F.lower(F.trim(raw)), r"[^a-z0-9]+", "_")
    cut = F.substring(F.regexp_replace(snake, r"^_+|_+\z", ""), 1, 40)
    clean = F.regexp_replace(cut, r"_+\z", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", F.lit("related_to")).otherwise(clean)


def csv_field(value: Column) -> Column:
    """RFC 4180 quoting, only where needed."""
    return F.when(
        value.rlike(r'[,"\n\r]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(value)


SAMPLE_BYTES = 1024
_MARKER = "[…]"


def truncate_sample(message: Column, limit: int = SAMPLE_BYTES) -> Column:
    """At most ``limit`` UTF-8 bytes including the marker, never splitting a character."""
    budget = max(limit - len(_MARKER.encode()), 0)
    raw = message.cast("binary")

    def head(n: int) -> Column:
        return F.concat(F.decode(F.substring(raw, 1, n), "UTF-8"), F.lit(_MARKER))

    def starts_char(n: int) -> Column:
        return ~F.hex(F.substring(raw, n + 1, 1)).between("80", "BF")

    cut = F.when(starts_char(budget), head(budget))
    for back in (1, 2):
        cut = cut.when(starts_char(budget - back), head(budget - back))
    return F.when(F.octet_length(message) <= limit, message).otherwise(cut.otherwise(head(budget - 3)))


def explain(
    rate_z: Column,
    surprisal_bits: Column,
    entropy_z: Column,
    rate_component: Column,
    surprisal_component: Column,
    entropy_component: Column,
) -> Column:
    """One sentence for the dominant signal; ties go to the later of rate, surprisal, entropy."""
    entropy_wins = (entropy_component >= rate_component) & (entropy_component >= surprisal_component)
    surprisal_wins = surprisal_component >= rate_component
    return (
        F.when(
            entropy_wins & (entropy_z < 0),
            F.format_string("The window has become uniform: a few templates fill it (entropy z %.1f).", entropy_z),
        )
        .when(
            entropy_wins,
            F.format_string("The window has become diverse: more templates than normal (entropy z %.1f).", entropy_z),
        )
        .when(
            surprisal_wins,
            F.format_string("This unit hardly ever writes this template (%.1f bits).", surprisal_bits),
        )
        .otherwise(F.format_string("This template comes faster than its history (rate z %.1f).", rate_z))
    )


__all__ = [n for n in dir() if not n.startswith("_") and n not in {"annotations", "Column", "F"}]
