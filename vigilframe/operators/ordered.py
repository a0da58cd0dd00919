"""Skew-safe building blocks for ordered computations.

A window over ``partitionBy(host).orderBy(time)`` sends all rows of one host to one task.  Here a
host's timeline is cut into *chunks* of bounded size; each chunk is one window partition, and what
a row needs from earlier chunks arrives through a small per-chunk table (an exact prefix scan).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

CHUNK = "_chunk"
CHUNK_ROWS = 4_000_000
SLOT_US = 3_600_000_000  # one hour: natural chunk of a timeline
_CUTS = 63  # an oversized chunk is cut into 64 at its own quantiles
_PIECES = 2 * _CUTS + 1  # with those that stand at a cut point


def with_chunks(
    df: DataFrame,
    keys: list[str],
    ts: str = "ts_us",
    seq: str = "seq",
    slot_us: int = SLOT_US,
    target_rows: int = CHUNK_ROWS,
    at_end: str | None = None,
    position: Column | None = None,
) -> DataFrame:
    """Add ``_chunk``: non-decreasing in (ts, seq) within ``keys`` and of limited size.

    A slot of ordinary size is one chunk.  A slot with more than ``target_rows`` rows is cut into
    64 at its own quantiles, and pieces that are still too large once more.  ``at_end`` names a boolean column of rows that sort
    after all other rows of the same timestamp.

    Sizes are counted here and now (one job over key, time and seq, combined map-side), so that the
    common case without oversized slots keeps a plain plan.  Of oversized slots the places are written
    once; pieces are cut at quantiles of the time, those still too large at quantiles of the time again,
    and pieces that are one instant at quantiles of ``seq``.  Places are compared as the whole numbers
    that they are, so any gap between two of them can be cut.
    """
    if position is not None:
        df = df.withColumn("__zero", F.lit(0).cast("bigint")).withColumn("__at", position)
        ts = seq = "__zero"
    slotted = df.withColumn("__slot", F.call_function("div", F.col(ts), F.lit(slot_us).cast("bigint")))
    slot_key = [*keys, "__slot"]
    hot = slotted.groupBy(*slot_key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > target_rows).drop("__n")
    if hot.isEmpty():
        return slotted.withColumn(CHUNK, F.col("__slot") * _PIECES**3).drop("__slot", "__zero", "__at")
    ends = F.when(F.col(at_end), 1).otherwise(0) if at_end else F.lit(0)
    places = {"__p": F.col("__at") if position is not None else F.col(ts) * 2 + ends, "__q": F.col(seq)}
    held = stage(slotted.join(hot, slot_key, "left_semi").select(*slot_key, *[v.alias(n) for n, v in places.items()]), "places")
    out, key = slotted.withColumns(places), slot_key
    for level, value in enumerate(("__p", "__p", "__q")):
        sub, cuts = f"__sub{level}", f"__cuts{level}"
        large = held.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), (F.min("__p") == F.max("__p")).alias("__one")).where(
            (F.col("__n") > target_rows) & (F.col("__one") == F.lit(value == "__q"))
        )
        known = stage(held.join(stage(large.select(*key), "large"), key, "left_semi").groupBy(*key).agg(_quantiles(value).alias(cuts)), "cuts")
        place = lambda rows: rows.join(known, key, "left").withColumn(sub, _below(F.col(cuts), F.col(value))).drop(cuts)  # noqa: B023, E731
        held, out, key = place(held), place(out), [*key, sub]
    chunk = F.col("__slot")
    for level in range(3):
        chunk = chunk * _PIECES + F.col(f"__sub{level}")
    return out.withColumn(CHUNK, chunk).drop("__slot", "__p", "__q", "__zero", "__at", "__sub0", "__sub1", "__sub2")


def _quantiles(col: str) -> Column:
    return F.percentile_approx(col, [i / (_CUTS + 1) for i in range(1, _CUTS + 1)], 2000)


def _below(cuts: Column, pos: Column) -> Column:
    """How many cut points lie below ``pos``, and how many up to it (0 without cuts).

    So the rows that stand at a cut point, however many, are kept from those before and after it.
    """
    count = lambda keep: F.coalesce(F.size(F.filter(cuts, keep)), F.lit(0))
    return (count(lambda c: c < pos) + count(lambda c: c <= pos)).cast("bigint")


def numbered_by(df: DataFrame, order: list[str], name: str, start: int = 0) -> DataFrame:
    """Add ``name``: the place of each row in the order of ``order``, from ``start``, without gaps.

    Ranges at sampled splitters are sorted and numbered in parallel; only the sizes of the ranges meet.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = stage(ranged, "numbered").withColumn("__part", F.shiftright("__id", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = F.col("__id") - F.shiftleft(F.col("__part"), 33)
    return placed.join(F.broadcast(sizes), "__part").withColumn(name, inside + F.col("__off") + start).drop("__id", "__part", "__off")


def ensure_chunks(df: DataFrame, keys: list[str], **kw) -> DataFrame:
    return df if CHUNK in df.columns else with_chunks(df, keys, **kw)


def carry_in(totals: DataFrame, keys: list[str], names: list[str], agg=F.sum) -> DataFrame:
    """Per chunk, the aggregate over all earlier chunks of the same key (``_c_<name>``)."""
    w = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*keys, CHUNK, *[agg(n).over(w).alias(f"_c_{n}") for n in names])


def prefix_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, Column],
    totals: DataFrame | None = None,
) -> DataFrame:
    """Running sums (current row included) of ``values`` per key in ``order``.

    ``df`` must carry ``_chunk``; key columns must not be NULL.  One shuffle of the rows by
    (keys, chunk); the running total of earlier chunks is joined from the per-chunk sums.
    """
    names = list(values)
    if totals is None:
        totals = df.groupBy(*keys, CHUNK).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    carry = carry_in(totals, keys, names)
    w = Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[F.sum(v).over(w).alias(f"_l_{n}") for n, v in values.items()])
    out = local.join(carry, [*keys, CHUNK], "left")
    return out.select(
        *df.columns,
        *[
            (F.col(f"_l_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n)
            for n in names
        ],
    )


def top_n_per_group(
    df: DataFrame, keys: list[str], order: list[Column], n: int, salt_on: list[str], salts: int = 64
) -> DataFrame:
    """First ``n`` rows of each group in two steps, so that a hot group is cut down in parallel.

    The result carries ``rank`` (1..n).  ``salt_on`` spreads a group's rows; any columns will do.
    """
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
        .withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= n)
        .drop("_salt")
        .withColumn("rank", F.row_number().over(last))
        .where(F.col("rank") <= n)
    )


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for per-row work on an input with very few splits (a single small file).

    Large inputs come in many splits and are returned as they are: no shuffle is added to them.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() * 2 <= min(wanted, 64) else df


def plain_unions(spark: SparkSession) -> None:
    """Keep Spark from taking a union of equally partitioned inputs for partitioned itself.

    In Spark 4.1 adaptive execution may coalesce the inputs differently; an aggregation or join over such
    a union then loses rows now and then (seen here: half of a group table in every third run).
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Without that setting a local session, whose executors are the driver, gets a temporary folder; a
    cluster gets an error.
    """
    plain_unions(spark)
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="vigilframe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_SCRATCH: list[str] = []


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, wherever it lies."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


@contextmanager
def scratch(spark: SparkSession):
    """What is staged inside goes to a folder of its own, which is removed at the end."""
    _SCRATCH.append(os.path.join(checkpoint_dir(spark), f"scratch-{uuid.uuid4().hex}"))
    try:
        yield
    finally:
        remove_path(spark, _SCRATCH.pop())


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write an intermediate result once and read it back (columnar, survives lost executors)."""
    spark = df.sparkSession
    path = os.path.join(_SCRATCH[-1] if _SCRATCH else checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    plain_unions(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
