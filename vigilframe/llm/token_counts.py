"""Token counts: documents in flat files of token ids, told apart by an end-of-document id alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from vigilframe.llm.common import new_path, query, table
from vigilframe.llm.tokenize import TOKENIZER, encoder

#: End-of-document id; texts are encoded so that it never occurs inside one.
SEPARATOR = 50256
BLOCK_IDS = 1_000_000
BLOCKS = "shard int, block int, ids binary, names array<bigint>"


def _flat_blocks(batches, tokenizer: str, separator: int, block_ids: int):
    """Ids of all texts of a task, a separator after each, cut into blocks wherever a block is full."""
    enc, shard, block = encoder(tokenizer, plain=True), TaskContext.get().partitionId(), 0
    kept, ends, names = np.zeros(0, dtype="<u2"), np.zeros(0, dtype=np.int64), pa.array([], pa.int64())

    def row(ids, names):
        return pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()),
                "ids": [ids.tobytes()], "names": pa.array([names.to_pylist()], pa.list_(pa.int64())),
            }
        )

    for batch in batches:
        for at, n, ids, lengths in enc.documents(batch.column(1), separator):
            ends = np.concatenate([ends, len(kept) + np.cumsum(lengths)])
            names = pa.concat_arrays([names, batch.column(0).slice(at, n)])
            kept = np.concatenate([kept, ids])
            while len(kept) >= block_ids:
                done = int(np.searchsorted(ends, block_ids, side="right"))
                yield row(kept[:block_ids], names.slice(0, done))
                kept, ends, names, block = kept[block_ids:], ends[done:] - block_ids, names.slice(done), block + 1
    if len(kept):
        yield row(kept, names)


def write_flat_tokens(
    docs: DataFrame, path: str, tokenizer: str = TOKENIZER, separator: int = SEPARATOR, block_ids: int = BLOCK_IDS
) -> None:
    """Write ``docs`` as flat token files: one stream per task of the scan, in the order of the rows.

    Streams are cut into blocks of ``block_ids`` wherever a block is full, so documents cross block
    borders, and nothing says where a document begins.  ``names`` of a block are the doc_ids of the
    documents that end in it.  Null text: no ids but the separator.  Null doc_id and repeated rows are
    kept.  Nothing is shuffled, and a task holds one block and one batch.
    """
    docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: _flat_blocks(batches, tokenizer, separator, block_ids), BLOCKS
    ).write.option("compression", "zstd").parquet(path)


def _scan(batches, separator: int):
    """Per block: number of ids and the places of the separators, found by one vector comparison."""
    for batch in batches:
        for row in batch.to_pylist():
            ids = np.frombuffer(row["ids"], dtype="<u2")
            places = np.flatnonzero(ids == separator).astype(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([row["shard"]], pa.int32()), "block": pa.array([row["block"]], pa.int32()),
                    "n": pa.array([len(ids)], pa.int64()), "places": pa.array([places], pa.list_(pa.int64())),
                    "names": pa.array([row["names"]], pa.list_(pa.int64())),
                }
            )


def scan_documents(blocks: DataFrame, separator: int = SEPARATOR) -> DataFrame:
    """(shard, place, doc_id, start, n_tokens) of every document in flat ``blocks`` (shard, block, ids, names).

    Each block is searched on its own.  A prefix scan over the blocks of a shard then stitches documents
    that cross block borders: it carries how many separators and ids came before and where the last
    separator was.  ``n_tokens`` leaves the separator out.  Ids after the last separator of a shard are a
    document without end and count as one; a separator that follows another ends an empty document.
    ``names`` may be null: doc_id is null then.
    """
    found = blocks.select("shard", "block", "ids", "names").mapInArrow(
        lambda batches: _scan(batches, separator),
        "shard int, block int, n bigint, places array<bigint>, names array<bigint>",
    )
    scan = Window.partitionBy("shard").orderBy("block")
    before = scan.rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("places") > 0, F.element_at("places", -1) + F.col("ahead"))
    carried = (
        found.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("seen", F.coalesce(F.sum(F.size("places").cast("bigint")).over(before), F.lit(0)))
        .withColumn("open", F.coalesce(F.last(last, ignorenulls=True).over(before) + 1, F.lit(0).cast("bigint")))
        .withColumn("is_last", F.lead("block").over(scan).isNull())
    )
    end = F.col("ahead") + F.col("n")
    unfinished = F.col("is_last") & (F.coalesce(last + 1, F.col("open")) < end)
    ends = F.concat(
        F.transform("places", lambda p: p + F.col("ahead")),
        F.when(unfinished, F.array(end)).otherwise(F.array().cast("array<bigint>")),
    )
    starts = F.concat(F.array("open"), F.transform("ends", lambda e: e + 1))
    return (
        carried.select("shard", "seen", "open", "names", ends.alias("ends"))
        .select("shard", "seen", F.explode(F.arrays_zip("ends", starts.alias("starts"), F.sequence(F.lit(0), F.size("ends")).alias("i"), F.coalesce("names", F.array().cast("array<bigint>")).alias("names"))).alias("d"))
        .where(F.col("d.ends").isNotNull())
        .select(
            "shard", (F.col("seen") + F.col("d.i")).alias("place"), F.col("d.names").alias("doc_id"),
            F.col("d.starts").alias("start"), (F.col("d.ends") - F.col("d.starts")).alias("n_tokens"),
        )
    )


def count_tokens(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` as flat token files and count each document's tokens by scanning them.

    Null text and empty text: 0 tokens.  Null doc_id and repeated rows: a row each.  A very long text fills as
    many blocks as it needs.  Ties have no part in it.  An empty table gives no rows.  Other columns, whatever
    their names, are left out.
    """
    path = new_path(docs.sparkSession, "flat-tokens")
    write_flat_tokens(docs, path, **options)
    blocks = docs.sparkSession.read.schema(BLOCKS).parquet(path)
    return scan_documents(blocks, options.get("separator", SEPARATOR))


@query("op1_token_counts")
def op1_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents")).select("doc_id", "shard", "start", "n_tokens")
