"""Rows of groups in order: numbering, running totals and digests that split hot groups over tasks."""

from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from vigilframe.llm.common import stage


def sorted_parts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows range-partitioned and sorted by ``by``, nulls first; a hot first key is cut by the others."""
    keys = [F.col(c).asc_nulls_first() for c in by]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys)


def changes(columns: list[pa.Array]) -> np.ndarray:
    """True for every row that differs from the row before in some column; the first row is False."""
    out = np.zeros(len(columns[0]), bool)
    for c in columns:
        valid = np.asarray(c.is_valid())
        if pa.types.is_integer(c.type):
            v = np.asarray(c.fill_null(0))
            out[1:] |= (v[1:] != v[:-1]) | (valid[1:] != valid[:-1])
        else:
            v = c.to_pylist()
            out[1:] |= np.fromiter((a != b for a, b in zip(v[1:], v)), bool, len(v) - 1) if len(v) > 1 else False
    return out


def _place(group: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(group)
            new = changes([key])
            new[0] = (key[0].as_py(),) != before
            at = np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(new, at, -1))
            pos = np.where(start < 0, n + at, at - start)
            before, n = (key[-1].as_py(),), int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(pos.astype(np.int64))],
                names=[*batch.schema.names, "part", "pos"],
            )

    return run


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with ``pos``, their place from 0 within ``group`` in the order of ``order``, nulls first.

    Sorted ranges are numbered one by one.  Only groups that reach over the border of a range need the
    counts of earlier ranges: at most two a range, so these are broadcast.  Rows equal in group and order
    are numbered in any order.  A null group is a group; an empty table gives no rows.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("pos", T.LongType())])
    placed = stage(sorted_parts(rows, [group, *order]).mapInArrow(_place(group), schema), "numbered")
    key = F.struct(F.col(group).alias("k"))
    ends = placed.groupBy("part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    border = ends.select(F.explode(F.array("lo", "hi")).alias("e")).select(F.col("e.k").alias("k")).distinct()
    counts = (
        placed.join(F.broadcast(border), F.col(group).eqNullSafe(F.col("k")), "left_semi")
        .groupBy("part", group).agg(F.count(F.lit(1)).alias("n"))
    )
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(F.col("part").alias("_p"), F.col(group).alias("_g"), F.sum("n").over(earlier).alias("_n")).where("_n > 0")
    return (
        placed.join(F.broadcast(ahead), (F.col("part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left")
        .withColumn("pos", F.col("pos") + F.coalesce("_n", F.lit(0)))
        .drop("_p", "_g", "_n", "part")
    )


def _pieces(keys: list[str], value: str, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in keys]
            new = changes(columns)
            starts = np.unique(np.concatenate([[0], np.flatnonzero(new), np.arange(0, batch.num_rows, most)]))
            values = batch.column(value).to_pylist()
            ends = [*starts[1:].tolist(), batch.num_rows]
            at = pa.array(starts)
            yield pa.RecordBatch.from_arrays(
                [*[c.take(at) for c in columns], batch.column(value).take(at),
                 pa.array([",".join(map(str, values[a:b])) for a, b in zip(starts.tolist(), ends)], pa.string())],
                names=[*keys, "first", "piece"],
            )

    return run


def _digest(keys: list[str], between: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for key, piece in zip(zip(*[batch.column(k).to_pylist() for k in keys]), batch.column("piece").to_pylist()):
                if key != now:
                    if state is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                else:
                    state.update(between)
                state.update(piece.encode())
            if done:
                yield _table(done, batch.schema, keys)
            last = batch.schema
        if state is not None:
            yield _table([(*now, state.hexdigest())], last, keys)

    def _table(rows: list[tuple], schema: pa.Schema, names: list[str]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [*[pa.array(c, schema.field(n).type) for c, n in zip(columns, names)], pa.array(columns[-1], pa.string())],
            names=[*names, "sha256"],
        )

    return run


def digest_pieces(pieces: DataFrame, keys: list[str], order: list[str], between: str) -> DataFrame:
    """(keys, sha256): digest of the ``piece`` strings of each key in ``order``, joined by ``between``.

    A digest is sequential, so the pieces of a key pass through one task, but one after the other: no
    more than a batch of them is in memory.  Pieces should therefore be few and long.
    """
    schema = T.StructType([*[pieces.schema[k] for k in keys], T.StructField("sha256", T.StringType())])
    ordered = pieces.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.select(*keys, "piece").mapInArrow(_digest(keys, between.encode()), schema)


def digest_ids(rows: DataFrame, keys: list[str], value: str, most: int = 4096) -> DataFrame:
    """(keys, sha256): digest of the ascending, comma-joined decimal ``value`` of each key.

    Runs of up to ``most`` values are joined where ranges of (keys, value) are sorted, so a hot key is split
    over tasks; only the joined runs meet.
    """
    schema = T.StructType(
        [*[rows.schema[k] for k in keys], T.StructField("first", rows.schema[value].dataType), T.StructField("piece", T.StringType())]
    )
    runs = sorted_parts(rows.select(*keys, value), [*keys, value]).mapInArrow(_pieces(keys, value, most), schema)
    return digest_pieces(runs, keys, ["first"], ",")
