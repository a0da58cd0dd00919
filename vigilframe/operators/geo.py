"""Connection geography: locating addresses, host-name hints, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilframe.functions import ipv4_to_long, is_routable_public, valid_position

def airport_labels(hostname: Column) -> Column:
    """Codes that dot labels of a host name begin with, not followed by another letter, in order."""
    labels = F.transform(F.split(F.lower(hostname), r"\."), lambda l: F.regexp_extract(l, r"^([a-z]{3})(?![a-z])", 1))
    return F.filter(labels, lambda c: c != "")


def _hint() -> Column:
    return F.struct("lat", "lon", "city", "country")


def airport_hints(ptr: DataFrame, airports: DataFrame) -> DataFrame:
    """(ip, hostname, hint): place of the first label with a code of ``airports`` (code, lat, lon, city, country)."""
    codes = ptr.select("ip", "hostname").distinct().select("ip", "hostname", F.posexplode(airport_labels(F.col("hostname"))).alias("_at", "code"))
    return (
        codes.join(airports, "code").groupBy("ip", "hostname")
        .agg(F.min_by(_hint(), "_at").alias("hint"))
    )


def carrier_hints(ptr: DataFrame, carriers: DataFrame) -> DataFrame:
    """(ip, hostname, hint) of router names ``<router>.<code>.<suffix>``.

    ``carriers``: suffix, code, lat, lon, city, country, one row per city code of a carrier.
    """
    labels = F.split(F.lower("hostname"), r"\.")
    tails = ptr.select("ip", "hostname").distinct().select(
        "ip", "hostname",
        F.explode(
            F.transform(
                F.sequence(F.lit(2), F.greatest(F.size(labels), F.lit(2))),
                lambda k: F.struct(
                    F.get(labels, k - 1).alias("code"), F.array_join(F.slice(labels, k + 1, F.size(labels)), ".").alias("suffix")
                ),
            )
        ).alias("t"),
    )
    found = tails.select("ip", "hostname", "t.code", "t.suffix").join(carriers, ["code", "suffix"])
    return found.groupBy("ip", "hostname").agg(F.max_by(_hint(), F.length("suffix")).alias("hint"))


def confirm_rdns(ptr: DataFrame, forward: DataFrame, airports: DataFrame, carriers: DataFrame) -> DataFrame:
    """Location hints of host names: (ip, hostname, hint).

    ``ptr``: ip, hostname; ``forward``: hostname, ip.  An airport hint only counts if the name
    resolves back to the same address; a carrier name needs no confirmation and goes first.
    """
    confirmed = forward.select("hostname", "ip").distinct()
    keys = ["ip", "hostname"]
    place = airport_hints(ptr, airports).join(confirmed, keys, "left_semi").withColumnRenamed("hint", "_airport")
    carrier = carrier_hints(ptr, carriers).withColumnRenamed("hint", "_carrier")
    both = place.join(carrier, keys, "full_outer").select(*keys, F.coalesce("_carrier", "_airport").alias("hint"))
    return ptr.join(both, keys).select("ip", "hostname", "hint")


def geo_lookup(ips: DataFrame, ranges: DataFrame, ip_num: str = "ip_num") -> DataFrame:
    """Attach the range (``start`` <= ip <= ``end``) to each numeric address; NULLs without one.

    Ranges do not overlap.  Distinct addresses and range starts are put on one line per /16 block
    and each address takes the last start before it: a block holds at most 65,536 addresses and as
    many starts, so no block can grow with the data and no pairs are formed.  A range reaching
    over several blocks is entered at the start of each (by the block numbers it covers).
    """
    info = [c for c in ranges.columns if c not in ("start", "end")]
    # Wide ranges: one entry per covered /16; at most 65,536 blocks exist in all.
    block = lambda c: F.shiftright(c, 16)
    entries = ranges.select(
        "start", "end", F.struct(*info).alias("_info"),
        F.explode(F.sequence(block(F.col("start")), block(F.col("end")))).alias("_block"),
    ).select(
        "_block",
        F.greatest("start", F.col("_block") * 65536).alias("_at"),
        F.lit(0).alias("_kind"),
        F.struct("end", "_info").alias("_range"),
    )
    asked = ips.select(F.col(ip_num).alias("_at")).where(F.col(ip_num).isNotNull()).distinct().select(
        block(F.col("_at")).alias("_block"), "_at", F.lit(1).alias("_kind"),
        F.lit(None).cast(entries.schema["_range"].dataType).alias("_range"),
    )
    w = Window.partitionBy("_block").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        entries.unionByName(asked)
        .withColumn("_r", F.last("_range", ignorenulls=True).over(w))
        .where((F.col("_kind") == 1) & (F.col("_at") <= F.col("_r.end")))
        .select(F.col("_at").alias(ip_num), *[F.col(f"_r._info.{c}").alias(c) for c in info])
    )
    return ips.join(found, ip_num, "left")


def clean_city_hit(df: DataFrame, countries: DataFrame) -> DataFrame:
    """Reduce raw range rows to a usable hit.

    Input: country_code, city_de, city_en, region_de, region_en, lat, lon.  Adds ``country``
    (canonical, NULL if unknown = no hit), ``city``, ``region``, and valid ``lat``/``lon``.  The
    German name wins over the English one, blank names count as none; a city needs a position.
    """
    pick = lambda a, b: F.nullif(F.trim(F.coalesce(F.col(a), F.col(b))), F.lit(""))
    known = countries.select(F.col("code").alias("country"), F.lit(True).alias("_k"))
    out = df.withColumn("country", F.upper(F.trim("country_code"))).join(known, "country", "left")
    city = pick("city_de", "city_en")
    ok = valid_position(F.col("lat"), F.col("lon")) & city.isNotNull() & F.col("_k").isNotNull()
    return out.withColumns(
        {
            "city": F.when(ok, city),
            "region": F.when(F.col("_k").isNotNull(), pick("region_de", "region_en")),
            "lat": F.when(ok, F.col("lat")),
            "lon": F.when(ok, F.col("lon")),
            "country": F.when(F.col("_k").isNotNull(), F.col("country")),
        }
    ).drop("_k", "country_code", "city_de", "city_en", "region_de", "region_en")


def country_dim(df: DataFrame, countries: DataFrame, code: str = "country") -> DataFrame:
    """Attach centroid and name: ``country_lat``, ``country_lon``, ``country_name`` (the code if unknown).

    ``countries``: code, lat, lon, name (supplied by the user; there are about 250).
    """
    dim = countries.select(
        F.col("code").alias("_code"), F.col("lat").alias("country_lat"), F.col("lon").alias("country_lon"),
        F.col("name").alias("_name"),
    )
    out = df.join(dim, F.upper(F.trim(F.col(code))) == F.col("_code"), "left")
    return out.withColumn("country_name", F.coalesce("_name", F.col(code))).drop("_code", "_name")


def combine_location(df: DataFrame, countries: DataFrame) -> DataFrame:
    """Choose the best location of each row.

    Input: ``country_code`` (country database), city hit ``city_country``, ``city``, ``lat``,
    ``lon``, ``region``, and ``hint`` (from confirm_rdns), all nullable.  Adds ``located``:
    struct(country, lat, lon, city, region, source) or NULL.  Precedence: name hint with its own
    country, city row with a position, centroid of the country.  Without a database country there
    is no location.
    """
    country = F.coalesce("city_country", "country_code")
    out = country_dim(df.withColumn("_country", country), countries, "_country")

    def place(country, lat, lon, city, region, source) -> Column:
        return F.struct(
            country.alias("country"), lat.alias("lat"), lon.alias("lon"), city.alias("city"),
            region.alias("region"), F.lit(source).alias("source"),
        )

    none = F.lit(None).cast("string")
    h = F.col("hint")
    located = (
        F.when(F.col("_country").isNull(), None)
        .when(h.isNotNull(), place(h["country"], h["lat"], h["lon"], h["city"], none, "reverse_dns"))
        .when(
            F.col("city_country").isNotNull() & F.col("city").isNotNull() & F.col("lat").isNotNull(),
            place(F.col("_country"), F.col("lat"), F.col("lon"), F.col("city"), F.col("region"), "city_database"),
        )
        .when(
            F.col("country_lat").isNotNull(),
            place(F.col("_country"), F.col("country_lat"), F.col("country_lon"), none, none, "country"),
        )
    )
    return out.withColumn("located", located).drop("_country", "country_lat", "country_lon", "country_name")


def place_text(country_name: Column, city: Column, source: Column) -> Column:
    return (
        F.when(city.isNull(), country_name)
        .when(source == "route", F.format_string("ca. %s, %s (via router)", city, country_name))
        .when(source == "city_database", F.format_string("ca. %s, %s", city, country_name))
        .otherwise(F.format_string("%s, %s", city, country_name))
    )


def place_detail(
    country_name: Column, city: Column, region: Column, lat: Column, lon: Column, source: Column
) -> Column:
    extra = F.when(region.isNotNull(), F.concat(region, F.lit(", "))).otherwise(F.lit(""))
    return (
        F.when(city.isNull(), F.format_string("%s (country only, centre %.3f, %.3f)", country_name, lat, lon))
        .when(
            source == "city_database",
            F.format_string("ca. %s, %s%s (%.3f, %.3f)", city, extra, country_name, lat, lon),
        )
        .otherwise(F.format_string("%s (%.3f, %.3f)", place_text(country_name, city, source), lat, lon))
    )


def describe_hop(place: Column, ip: Column) -> Column:
    return (
        F.when(ip.isNull(), F.lit("no answer"))
        .when(place.isNotNull(), F.format_string("%s (%s)", place, ip))
        .otherwise(F.format_string("%s (location unknown)", ip))
    )


def locate_hops(hops: DataFrame, located: DataFrame, countries: DataFrame) -> DataFrame:
    """Add position, place and country to every hop; silent, private and unknown hops stay.

    ``hops``: target, ttl, ip (nullable); ``located``: ip, located, hint.
    """
    num = ipv4_to_long(F.col("ip"))
    out = hops.join(located.select("ip", "located", "hint"), "ip", "left")
    public = is_routable_public(num)
    out = country_dim(out.withColumn("country", F.when(public, F.col("located.country"))), countries)
    spot = F.when(
        F.col("located.city").isNotNull(), F.concat_ws(", ", F.col("located.city"), F.col("country_name"))
    ).otherwise(F.col("country_name"))
    return out.select(
        *hops.columns,
        F.when(public, F.col("located.lat")).alias("lat"),
        F.when(public, F.col("located.lon")).alias("lon"),
        F.when(F.col("ip").isNotNull() & ~public, F.lit("local network"))
        .when(public & F.col("located").isNotNull(), spot)
        .alias("place"),
        "country",
        F.when(public & F.col("located").isNotNull(), F.col("hint")).alias("hint"),
    )


def refine_from_route(points: DataFrame, hops: DataFrame) -> DataFrame:
    """Points known only by country take the city of the last hop before them with a name hint.

    ``points``: ip, country, lat, lon, city, region, source; ``hops``: target, ttl, ip, country, hint.
    """
    usable = hops.where(F.col("hint").isNotNull() & ~F.col("ip").eqNullSafe(F.col("target")))
    best = usable.groupBy(F.col("target").alias("ip"), "country").agg(F.max_by("hint", "ttl").alias("_h"))
    out = points.join(best, ["ip", "country"], "left")
    hit = (F.col("source") == "country") & F.col("_h").isNotNull()
    return out.withColumns(
        {
            "lat": F.when(hit, F.col("_h.lat")).otherwise(F.col("lat")),
            "lon": F.when(hit, F.col("_h.lon")).otherwise(F.col("lon")),
            "city": F.when(hit, F.col("_h.city")).otherwise(F.col("city")),
            "region": F.when(~hit, F.col("region")),
            "source": F.when(hit, F.lit("route")).otherwise(F.col("source")),
        }
    ).drop("_h")


def waypoints(hops: DataFrame) -> DataFrame:
    """Located hops other than the target itself."""
    return hops.where(F.col("lat").isNotNull() & ~F.col("ip").eqNullSafe(F.col("target"))).withColumn(
        "place", F.coalesce("place", F.lit("unknown place"))
    )


def attach_program(conns: DataFrame, sockets: DataFrame, procs: DataFrame) -> DataFrame:
    """Add ``program``: connection ip <- socket inode <- process holding it.

    ``sockets``: hostname, collected_at, ip, inode; ``procs``: hostname, collected_at, inode, pid, program;
    ``conns`` has hostname, collected_at and ip.  Inodes are used again, so only tables of one collection
    belong together.  Several holders: the one with the highest pid.
    """
    when = ["hostname", "collected_at"]
    names = (
        sockets.join(procs.where(F.trim("program") != ""), [*when, "inode"])
        .groupBy(*when, "ip")
        .agg(F.max_by(F.trim("program"), F.struct("pid", "inode")).alias("program"))
    )
    return conns.join(names, [*when, "ip"], "left")


def unmapped_locations(conns: DataFrame, located: DataFrame) -> DataFrame:
    return conns.join(located.where(F.col("located").isNotNull()).select("ip"), "ip", "left_anti")


def unresolved_count(conns: DataFrame) -> DataFrame:
    """Remotes without any country, per host."""
    return conns.groupBy("hostname").agg(F.count_if(F.col("located").isNull()).alias("unresolved"))


def next_route_target(points: DataFrame, routes: DataFrame) -> DataFrame:
    """The newest remote without a measured route; ties go to the smaller address."""
    return (
        points.join(routes.select(F.col("target").alias("ip")).distinct(), "ip", "left_anti")
        .orderBy(F.col("first_seen_us").desc(), ipv4_to_long(F.col("ip")))
        .limit(1)
    )


def order_export(points: DataFrame) -> DataFrame:
    return points.orderBy(ipv4_to_long(F.col("ip")))
