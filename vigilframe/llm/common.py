"""Shared helpers of the training-data operators: words, shingles, staging and the query registry."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilframe.operators.ordered import plain_unions

#: A word is a maximal run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, the equivalent SQL."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text in order; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def shingle_hashes(text: Column, size: int = 5) -> Column:
    """Distinct 64-bit hashes of the ``size``-word shingles; a shorter text counts as one shingle.

    A text without words has none.
    """

    def of(ws: Column) -> Column:
        whole = F.array(F.xxhash64(ws))
        grams = F.transform(
            F.slice(ws, 1, F.greatest(F.size(ws) - (size - 1), F.lit(0))),
            lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, size)]),
        )
        return F.when(F.size(ws) >= size, F.array_distinct(grams)).when(F.size(ws) > 0, whole).otherwise(
            F.array().cast("array<bigint>")
        )

    return let(words(F.lower(text)), of)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local session without that setting gets a temporary folder.
    """
    plain_unions(spark)
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="vigilframe-llm-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


_SCRATCH: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, or in the scratch folder that is open."""
    return os.path.join(_SCRATCH[-1] if _SCRATCH else shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def settled(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The written result of ``build``; what it staged on the way is removed."""
    path = new_path(spark, name)
    _SCRATCH.append(new_path(spark, "scratch"))
    try:
        df = build()
        df.write.parquet(path)
    finally:
        root = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A written table of few short columns, marked to be broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def stage(df: DataFrame, name: str, **options) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of so many rows at most for the jobs that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
