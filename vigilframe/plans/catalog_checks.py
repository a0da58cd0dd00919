"""Queries for small operators that other queries use only inside."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.functions.scalars import decay_factor, relative_age, valid_position
from vigilframe.operators import geo as G
from vigilframe.operators import graph as GR
from vigilframe.operators import notes as N
from vigilframe.operators.templates import token_similarity
from vigilframe.plans.catalog import EV, events, query, r6, table

_NOW = 1_706_659_200_000_000


@query(
    "event_ages",
    f"""WITH {EV}, s AS (SELECT *, greatest({_NOW} - ts_us, 0) // 1000000 AS secs FROM ev)
SELECT seq, CASE WHEN secs < 60 THEN '0 min' WHEN secs < 3600 THEN (secs // 60) || ' min'
    WHEN secs < 86400 THEN (secs // 3600) || ' h' ELSE (secs // 86400) || ' d' END AS age,
  round(pow(0.5, (secs // 3600) / 168.0), 6) + 0.0 AS decay FROM s""",
)
def event_ages(spark, d):
    ev = events(spark, d)
    hours = F.floor(F.greatest(F.lit(_NOW) - F.col("ts_us"), F.lit(0)) / 3_600_000_000)
    return ev.select("seq", relative_age(F.col("ts_us"), F.lit(_NOW)).alias("age"), r6(decay_factor(hours, 168.0, 3600)).alias("decay"))


@query(
    "valid_positions",
    """SELECT event_id AS seq, CASE WHEN event_id % 11 = 0 THEN false ELSE abs(value - 60) <= 90 AND abs(value * 2 - 150) <= 180 END AS ok
FROM events""",
)
def valid_positions(spark, d):
    lat = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value") - 60)
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), valid_position(lat, F.col("value") * 2 - 150).alias("ok"))


@query(
    "city_hits",
    """WITH n AS (SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN ' n' || c_nationkey || ' ' END AS code,
    CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN ' ' END AS de, CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_mktsegment END AS en,
    c_acctbal / 50 AS lat FROM customer),
k AS (SELECT *, c AS country, nullif(trim(coalesce(de, en)), '') AS name FROM (SELECT *, CASE WHEN code IS NOT NULL THEN upper(trim(code)) END AS c FROM n))
SELECT c_custkey, country, CASE WHEN country IS NOT NULL AND abs(lat) <= 90 THEN name END AS city,
  CASE WHEN country IS NOT NULL AND abs(lat) <= 90 AND name IS NOT NULL THEN round(lat, 6) + 0.0 END AS lat FROM k""",
)
def city_hits(spark, d):
    nations = table(spark, d, "nation").where("n_nationkey < 20").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"))
    key, none = F.col("c_custkey"), F.lit(None).cast("string")
    raw = table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit(" n"), F.col("c_nationkey").cast("string"), F.lit(" ")).alias("country_code"),
        F.when(key % 3 == 0, F.col("c_name")).when(key % 3 == 1, F.lit(" ")).alias("city_de"),
        F.when(key % 2 == 0, F.concat(F.lit(" "), F.col("c_mktsegment"))).alias("city_en"),
        none.alias("region_de"), none.alias("region_en"), (F.col("c_acctbal") / 50).cast("double").alias("lat"), F.lit(1.0).alias("lon"),
    )
    hit = G.clean_city_hit(raw, nations)
    return hit.select("c_custkey", "country", "city", r6("lat").alias("lat"))


def _journal_notes(spark, d):
    """Notes with frontmatter, a fence, wiki links in both forms and tags, made from the columns of documents."""
    s = lambda c: F.col(c).cast("string")
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    k = lambda n: (F.col("doc_id") % n).cast("string")
    text = F.concat(
        F.lit('---\ntitle: "Entry '), s("doc_id"), F.lit('"\ntags: [lang'), F.col("lang"), F.lit(", 'Set"), k(7), F.lit("', 2024]\n---\n# Heading "),
        F.col("source"), F.lit("\n\nSee [[dir"), k(5), F.lit("/note"), k(11), F.lit("|that]] and ![["), F.col("lang"), F.lit("-index#top]], #Mark"), k(3),
        F.lit("/ too.\n\n```\n[[never]] #never\n```\n\n[size](./sizes/"), s("n_chars"), F.lit(".md) `[[code]]`\n"),
    )
    return docs.select("doc_id", text.alias("text"))


@query(
    "note_fields",
    """SELECT doc_id, 'Entry ' || doc_id AS title, 'wiki:dir' || doc_id % 5 || '/note' || doc_id % 11 || ' wiki:' || lang || '-index path:./sizes/' || n_chars || '.md' AS links,
  '#lang' || lang || ' #set' || doc_id % 7 || ' heading ' || source || ' #mark' || doc_id % 3 AS terms FROM documents""",
)
def note_fields(spark, d):
    found = N.extract_notes(_journal_notes(spark, d))
    links = F.transform("links", lambda x: F.concat(x.kind, F.lit(":"), x.target))
    return found.select("doc_id", "title", F.array_join(links, " ").alias("links"), F.array_join("terms", " ").alias("terms"))


@query(
    "token_shares",
    """SELECT event_id AS seq, round(CASE WHEN user_id % 3 = 0 THEN ((event_type = 'view')::INT + 1) / 2.0
  ELSE ((event_type = 'view')::INT + 1 + (user_id % 5 = 0)::INT) / 3.0 END, 6) + 0.0 AS share FROM events""",
)
def token_shares(spark, d):
    third = F.when(F.col("user_id") % 3 == 0, F.lit("<*>")).otherwise(F.lit("0"))
    template = F.array(F.lit("view"), F.lit("by"), third)
    tokens = F.array(F.col("event_type"), F.lit("by"), (F.col("user_id") % 5).cast("string"))
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), r6(token_similarity(template, tokens)).alias("share"))


@query(
    "overlay_union",
    """SELECT p_partkey::VARCHAR AS id, p_brand AS label FROM part UNION ALL
SELECT s_suppkey::VARCHAR, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT p_partkey FROM part)""",
)
def overlay_union(spark, d):
    base = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("label"))
    over = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("label"))
    return GR.union_overlay(base, over).select("id", "label")


@query(
    "ordered_addresses",
    """SELECT (c_custkey * 2863311 % 223) || '.' || (c_custkey % 256) || '.' || (c_custkey // 256 % 256) || '.7' AS ip FROM customer""",
)
def ordered_addresses(spark, d):
    key = F.col("c_custkey")
    part = lambda c: F.floor(c).cast("bigint").cast("string")
    ip = F.concat_ws(".", part(key * 2863311 % 223), part(key % 256), part(key / 256 % 256), F.lit("7"))
    return G.order_export(table(spark, d, "customer").select(ip.alias("ip")))
