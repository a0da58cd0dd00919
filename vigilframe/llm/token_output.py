"""Token ids as binary segments: written in document order, coded with a static rANS, read back in parallel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vigilframe.llm import rans
from vigilframe.llm.common import new_path, query, small_batches, table
from vigilframe.llm.tokenize import BATCH_TEXTS, TOKENIZER, encoder

END_ID = 0
SEGMENT_IDS = 2_000_000
SEGMENT_SCHEMA = "shard int, segment int, n_ids bigint, doc_ids binary, has_id binary, lengths binary, payload binary"


def _segments(batches, tokenizer: str, end_id: int, segment_ids: int):
    """Documents in order -> rows of SEGMENT_SCHEMA; a segment ends with the document that fills it."""
    enc = encoder(tokenizer)
    shard, number = TaskContext.get().partitionId(), 0
    ids, keys, lengths, size = [], [], [], 0

    def row():
        every = pa.concat_arrays(keys)
        stream = np.concatenate(ids)
        return pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()), "segment": pa.array([number], pa.int32()),
                "n_ids": pa.array([len(stream)], pa.int64()),
                "doc_ids": [np.asarray(pc.fill_null(every, 0)).astype("<i8").tobytes()],
                "has_id": [np.asarray(pc.is_valid(every)).tobytes()],
                "lengths": [np.concatenate(lengths).astype("<u4").tobytes()],
                "payload": [rans.encode(stream)],
            }
        )

    for batch in batches:
        for at, n, got, sizes in enc.documents(batch.column(1), end_id):
            ends = np.cumsum(sizes)
            low = 0
            while low < n:
                begin = int(ends[low - 1]) if low else 0
                high = min(n, int(np.searchsorted(ends, begin + segment_ids - size)) + 1)
                ids.append(got[begin : ends[high - 1]])
                keys.append(batch.column(0).slice(at + low, high - low))
                lengths.append(sizes[low:high])
                size += len(ids[-1])
                low = high
                if size >= segment_ids:
                    yield row()
                    ids, keys, lengths, size, number = [], [], [], 0, number + 1
    if keys:
        yield row()


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS
) -> None:
    """Write the ids of every ``text`` and an end id after it, in ascending ``doc_id``, as a table of segments.

    The texts are dealt to tasks by ranges of doc_id and sorted there: one shuffle, and no task or
    driver holds more than one segment.  Null doc_id: first.  Equal doc_ids: by text.  Null text: only
    the end id.  A very long text is one document of one segment, up to 536 million ids (offsets have 32 bits);
    repeated rows are documents of their own.  An empty table gives an empty file.  Other columns are left out.  Segments are rows of a Parquet table without further compression, so a lost executor
    costs its own part only.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id")
    rows.sortWithinPartitions("doc_id", "text").mapInArrow(
        lambda batches: _segments(batches, tokenizer, end_id, segment_ids), SEGMENT_SCHEMA
    ).write.option("compression", "uncompressed").parquet(path)


def _documents(batches):
    for batch in batches:
        for row in batch.to_pylist():
            lengths = np.frombuffer(row["lengths"], dtype="<u4").astype(np.int64)
            known = np.frombuffer(row["has_id"], dtype=bool)
            doc_ids = pa.array(np.frombuffer(row["doc_ids"], dtype="<i8"), mask=~known)
            raw = rans.decode(row["payload"]).astype("<u4").tobytes()
            ends = np.cumsum(lengths)
            for lo in range(0, len(lengths), 1000):
                a, b = lengths[lo : lo + 1000], ends[lo : lo + 1000]
                begins = b - a
                at = int(begins[0])
                offsets = pa.py_buffer((4 * (np.append(begins, b[-1]) - at)).astype("<i4").tobytes())
                body = pa.py_buffer(raw[4 * at : 4 * int(b[-1])])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(a), row["shard"]), pa.int32()), pa.array(np.full(len(a), row["segment"]), pa.int32()),
                        doc_ids.slice(lo, 1000), pa.array(begins, pa.int64()), pa.array(a, pa.int64()),
                        pa.Array.from_buffers(pa.binary(), len(a), [None, offsets, body]),
                    ],
                    ["shard", "segment", "doc_id", "begin", "n_tokens", "ids"],
                )


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents with their place in their segment, number of ids before each segment)."""
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    sizes = segments.select("shard", "segment", "n_ids")
    # One row per shard (task of the writer): a short table.
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before(F.lit(0)).orderBy("shard")), F.lit(0)).alias("ahead")
    )
    base = sizes.withColumn(
        "inside", F.coalesce(F.sum("n_ids").over(before("shard").orderBy("segment")), F.lit(0))
    ).join(shards, "shard").select("shard", "segment", (F.col("ahead") + F.col("inside")).alias("base"))
    found = segments.mapInArrow(
        _documents, "shard int, segment int, doc_id bigint, begin bigint, n_tokens bigint, ids binary"
    )
    return found, base


def _with_start(found: DataFrame, base: DataFrame, *columns: str) -> DataFrame:
    return found.join(base, ["shard", "segment"]).select(
        "doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", *columns
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers, start among all ids."""
    return _with_start(*_read(spark, path), "ids")


def token_digests(docs: DataFrame, **options) -> DataFrame:
    """Write, read back and sum up: (doc_id, start, n_tokens, ids_crc32)."""
    path = new_path(docs.sparkSession, "tokens")
    with small_batches(docs.sparkSession, BATCH_TEXTS):
        write_tokens(docs, path, **options)
    found, base = _read(docs.sparkSession, path)
    return _with_start(found.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), base, "ids_crc32")


@query("op9_token_output")
def op9_token_output(spark, sf_dir):
    return token_digests(table(spark, sf_dir, "documents"))
