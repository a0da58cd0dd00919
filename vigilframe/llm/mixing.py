"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilframe.llm.common import free_name, n_words, query, stage, table

#: Expected copies are counted in integers of this unit, so that sums do not depend on their order.
UNIT = 1 << 26
#: Documents of one source and size are ordered in ranges of doc_id of about so many documents.
SLOT_ROWS = 20_000


def source_key(source: Column) -> Column:
    """Source as a key that is never null: null has one of its own."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def fill_targets(sources: DataFrame, total_share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """Add ``target`` to (key, weight, source_size): weighted shares of ``total_share`` times all sizes.

    No source gets more than ``max_repeat`` times its size; what is above goes to the others by weight.
    One row per source.  Sources in order of size per weight reach their limit one after the other, so
    the level at which the rest shares is found with running sums instead of repeated resharing.
    """
    # One row per source: the table that is ordered here is as long as the list of sources.
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    cap = F.col("source_size") * max_repeat
    leveled = sources.withColumn(
        "_at",
        (F.sum("source_size").over(everything) * total_share - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        / F.sum("weight").over(rest),
    )
    # The level rises while sources are limited and falls afterwards: its maximum is where the rest shares.
    share = F.max("_at").over(everything) * F.col("weight")
    return leveled.withColumn("target", F.least(cap.cast("double"), share)).drop("_at")


def range_of(value: Column, starts: Column) -> Column:
    """How many of the ascending ``starts`` are not above ``value``, by bisection; all for a null value, 0 for null starts."""
    n = F.coalesce(F.size(starts), F.lit(0))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1.0)).cast("int"))

    def halve(at: Column, _) -> Column:
        middle = F.floor((at.low + at.high) / 2).cast("int")
        above = F.get(starts, middle) > value
        return F.when(at.low >= at.high, at).when(above, F.struct(at.low.alias("low"), middle.alias("high"))).otherwise(
            F.struct((middle + 1).alias("low"), at.high.alias("high"))
        )

    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), n.alias("high")), halve, lambda at: at.low)
    return F.when(n == 0, F.lit(0)).when(value.isNull(), n).otherwise(found).cast("int")


def doc_id_ranges(sized: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, size, starts): where ranges of doc_id begin in sizes of a source with more than SLOT_ROWS documents.

    One doc_id of about SLOT_ROWS, by its hash, begins a range.  Where ranges begin changes no order.
    """
    large = F.broadcast(counts.where(F.col("n") > SLOT_ROWS).select("key", "size"))  # at most rows / SLOT_ROWS
    start = F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_ROWS)) == 0
    return (
        sized.where(F.col("doc_id").isNotNull() & start).join(large, ["key", "size"])
        .groupBy("key", "size").agg(F.sort_array(F.collect_set("doc_id")).alias("starts"))
    )


def mix_sources(
    docs: DataFrame,
    weights,
    size: Column | None = None,
    total_share: float = 1.5,
    max_repeat: int = 2,
    seed: str = "mix",
) -> DataFrame:
    """Add ``size``, ``source_size``, ``target`` and ``copies`` (0..max_repeat) to every row of ``docs``.

    ``weights(sources)`` adds a positive ``weight`` to a table with one row per source (``key``,
    ``source``, ``source_size``).  Within a source every document expects target / source_size copies;
    documents stand in order of size, and each gets one copy for every integer that the running sum,
    begun at one random offset per source, passes.

    Order of a source: size, doc_id (null last), whatever the number of documents.  A window holds one
    size of a source only, or one range of its doc_ids where it has more than SLOT_ROWS documents; what
    stands before it comes from a table of counts, so a source with a third of all rows is split.
    Null source: a source of its own.  Null text: size 0.  Sources without words take nothing.
    Repeated rows are separate documents.  An empty table gives an empty result.  Columns of ``docs``
    that have the name of an added one are replaced.
    """
    added = ("size", "source_size", "target", "copies")
    keep = [c for c in docs.columns if c.lower() not in added]
    key, cut, mix, begin = (free_name(docs, c) for c in ("key", "cut", "mix", "begin"))
    sized = (
        docs.withColumn("size", n_words(F.col("text")) if size is None else size)
        .withColumn(key, source_key(F.col("source")))
        .drop("source_size", "target", "copies")
    )
    narrow = sized.select(F.col(key).alias("key"), "size", "doc_id", "source")
    counts = stage(
        narrow.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source")), "mix-counts"
    )
    ranged = counts.select("key", "size", F.lit(0).alias("cut"), "n")
    if counts.where(F.col("n") > SLOT_ROWS).isEmpty():
        sized = sized.withColumn(cut, F.lit(0))
    else:
        ranges = F.broadcast(stage(doc_id_ranges(narrow, counts), "mix-ranges"))
        place = lambda df, name: df.withColumn(name, range_of(F.col("doc_id"), F.col(starts))).drop(starts)
        starts = free_name(sized.withColumn(cut, F.lit(0)), "starts")
        named = ranges.select("key", "size", F.col("starts").alias(starts))
        held = place(narrow.join(named, ["key", "size"]), "cut").groupBy("key", "size", "cut").agg(F.count(F.lit(1)).alias("n"))
        ranged = stage(ranged.join(ranges, ["key", "size"], "left_anti").unionByName(held), "mix-cuts")
        sized = place(sized.join(named.withColumnRenamed("key", key), [key, "size"], "left"), cut)
    sources = counts.groupBy("key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = fill_targets(weights(sources), total_share, max_repeat).select(
        "key",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT).cast("bigint"))
        .otherwise(F.lit(0).cast("bigint"))
        .alias("each"),
        F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(seed), "key")), 1, 8), 16, 10).cast("bigint"), F.lit(UNIT))
        .alias("offset"),
    )
    in_order = Window.partitionBy("key").orderBy("size", "cut").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        ranged.withColumn("ahead", F.coalesce(F.sum("n").over(in_order), F.lit(0)))
        .join(targets, "key")
        .select(
            F.col("key").alias(key), "size", F.col("cut").alias(cut), "source_size", "target",
            F.struct("each", "offset", "ahead").alias(mix),
        )
    )
    # Rows of one doc_id and size differ in their texts at most; equal ones may change places.
    told = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    within = Window.partitionBy(key, "size", cut).orderBy(F.col("doc_id").asc_nulls_last(), told)
    each, offset = F.col(f"{mix}.each"), F.col(f"{mix}.offset")
    start = (F.col(f"{mix}.ahead") + F.row_number().over(within) - 1) * each + offset
    boundaries = lambda x: F.call_function("div", x, F.lit(UNIT).cast("bigint"))
    return (
        sized.join(chunks, [key, "size", cut])
        .withColumn(begin, start)
        .withColumn("copies", boundaries(F.col(begin) + each) - boundaries(F.col(begin)))
        .select(*keep, *added)
    )


def cycle_weights(values: tuple[int, ...] = (3, 1, 2)):
    """Weights that repeat over the sources in code-point order, null last."""

    def weigh(sources: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
        return sources.withColumn("weight", F.get(F.array(*[F.lit(v) for v in values]), F.pmod(place, F.lit(len(values)))))

    return weigh


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it has copies, with the columns of ``docs``.

    Nulls, ties, repeated rows and empty tables: as in `mix_sources`; rows of one doc_id and size stand by a
    hash of their text, so reruns take the same rows.  A very long text is one document like any other.
    Columns of ``docs`` with the names that the mix adds keep their values.
    """
    packed = docs.select(F.struct("*").alias("row"), "doc_id", "text", "source")
    out = mix_sources(packed, cycle_weights(), **options)
    times = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("time")
    return out.select("row", times).select("row.*")


@query(
    "op2_mixing",
    r"""WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS told, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY key),
w AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM src),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
    - coalesce(sum(source_size * 2) OVER (ORDER BY source_size / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY source_size / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least((source_size * 2)::DOUBLE, max(level) OVER () * weight) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN round(target / source_size * 67108864)::BIGINT ELSE 0 END AS each_,
    ('0x' || substr(md5('mix' || key), 1, 8))::BIGINT % 67108864 AS offset_ FROM t)
SELECT doc_id, size, source_size, target, size * n AS taken FROM (
  SELECT doc_id, size, source_size, target, (r * each_ + offset_) // 67108864 - ((r - 1) * each_ + offset_) // 67108864 AS n
  FROM (SELECT d.doc_id, d.size, e.*, row_number() OVER (PARTITION BY d.key ORDER BY floor(sqrt(d.size)), d.size, d.doc_id, d.told) AS r
    FROM d JOIN e USING (key)))""",
)
def op2_mixing(spark, sf_dir):
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), cycle_weights())
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )
