"""Conversation prefix trie: subtree totals by time-forward processing within shards and across their roots."""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilframe.llm.common import WORD, query, small, stage, table
from vigilframe.llm.sequence import digest_ids, numbered

#: Conversations c share the opening of conversation c - c % FAMILY.
FAMILY, HEADS = 20, 4
#: Positions per chunk of the running prefix hash.
CHUNK = 1024
#: A subtree of at most so many conversations is one shard, cut again every so many levels.
SHARD_CONVS, BAND = 1000, 4096
#: Messages that a queue holds in memory before it writes a sorted run.
QUEUE_ROWS = 200_000

NODE = ["depth", "x1", "x2"]
_MESSAGE = np.dtype([("level", "<i8"), ("x1", "<i8"), ("x2", "<i8"), ("leaves", "<i8"), ("saved", "<i8")])


class MessageQueue:
    """Priority queue of (level, x1, x2, leaves, saved) in bounded memory.

    Beyond ``limit`` messages the queue is written as a sorted run to an unnamed file that lives as long as
    the task; runs are read back in blocks and merged with what is in memory.
    """

    def __init__(self, limit: int = QUEUE_ROWS):
        self.limit, self.heap, self.runs, self.written = limit, [], [], 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            file = tempfile.TemporaryFile()
            np.array(sorted(self.heap), _MESSAGE).tofile(file)
            file.seek(0)
            self.heap = []
            run = self._blocks(file)
            heapq.heappush(self.runs, (next(run), self.written, run))
            self.written += 1

    @staticmethod
    def _blocks(file) -> Iterator[tuple]:
        while len(block := np.frombuffer(file.read(_MESSAGE.itemsize * 4096), _MESSAGE)):
            yield from block.tolist()

    def take(self, key: tuple) -> tuple[int, int]:
        """Sums of all messages to ``key``, the least that is left."""
        leaves = saved = 0
        while self.heap and self.heap[0][:3] == key:
            _, _, _, a, b = heapq.heappop(self.heap)
            leaves, saved = leaves + a, saved + b
        while self.runs and self.runs[0][0][:3] == key:
            message, number, run = self.runs[0]
            leaves, saved = leaves + message[3], saved + message[4]
            if (after := next(run, None)) is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (after, number, run))
        return leaves, saved


def _forward(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queue = None, MessageQueue(limit)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "depth", "x1", "x2", "up", "p1", "p2", "leaves", "saved")]
            totals = []
            for s, depth, x1, x2, up, p1, p2, leaves, saved in zip(*columns):
                if s != shard:
                    shard, queue = s, MessageQueue(limit)
                got = queue.take((-depth, x1, x2))
                leaves, saved = leaves + got[0], saved + got[1]
                totals.append((leaves, saved))
                if up is not None:
                    queue.push((-up, p1, p2, leaves, saved))
            new = dict(zip(("leaves", "saved"), zip(*totals))) if totals else {"leaves": (), "saved": ()}
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[n], pa.int64()) if n in new else batch.column(n) for n in batch.schema.names], schema=batch.schema
            )

    return run


def time_forward(nodes: DataFrame, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """``nodes`` with ``leaves`` and ``saved`` summed over the subtree of each node within its shard.

    Rows have shard, depth, x1, x2 (the node), up, p1, p2 (depth and hash of the parent; null at the root of
    a shard), leaves and saved (own share).  They are sorted externally by shard and reverse level; each node
    takes its children's messages from the queue and sends its sums to its parent.
    """
    ordered = nodes.repartition("shard").sortWithinPartitions("shard", F.col("depth").desc(), "x1", "x2")
    return ordered.mapInArrow(_forward(queue_rows), nodes.schema)


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) of all rebuilt conversations.

    ``convs``: conv_id and n_turns.  ``turns``: conv_id, pos, h1 and h2 (hashes of place, role and text) and
    words of the text.  Texts go no further than their hashes.
    """
    known = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    slim = known.select(
        "conv_id", "turn", "role",
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("said"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("words"),
    )
    own = stage(numbered(slim, "conv_id", ["turn", "role", "said"]).select("conv_id", "pos", "said", "words"), "trie-turns")
    counts = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    turn = F.struct("pos", "said", "words")
    opening = (
        own.where((F.col("pos") < HEADS - 1) & (F.col("conv_id") % FAMILY == 0))
        .groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("opening"))
        .withColumnRenamed("conv_id", "first")
    )
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    known_heads = (
        counts.withColumn("h", heads).withColumn("first", F.col("conv_id") - F.col("conv_id") % FAMILY)
        .join(opening, "first", "left")
        .withColumn("opening", F.slice(F.coalesce("opening", F.array().cast(opening.schema["opening"].dataType)), F.lit(1), F.col("h").cast("int")))
    )
    convs = stage(
        known_heads.select(
            "conv_id", "h", "opening", (F.size("opening") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).cast("bigint").alias("n_turns")
        ),
        "trie-convs",
    )
    # Only a conversation whose first one is short moves its own turns.
    moved = convs.where(F.size("opening") < F.col("h")).select("conv_id", (F.size("opening") - F.col("h")).alias("by"))
    later = (
        own.withColumn("h", heads).where(F.col("pos") >= F.col("h")).join(moved, "conv_id", "left")
        .select("conv_id", (F.col("pos") + F.coalesce("by", F.lit(0))).alias("pos"), "said", "words")
    )
    first = convs.select("conv_id", F.explode("opening").alias("t")).select("conv_id", "t.pos", "t.said", "t.words")
    turns = later.unionByName(first).select(
        "conv_id", "pos", F.xxhash64("pos", "said").alias("h1"), F.xxhash64(F.lit(1), "said", "pos").alias("h2"), "words"
    )
    return turns, convs.select("conv_id", "n_turns")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, x1, x2, p1, p2, words, last): the prefix that ends with each turn, and its parent.

    A prefix is known by two 64-bit sums (exclusive or) over hashes of (place, role, text): running sums
    within chunks of ``CHUNK`` places and over the chunks of a conversation, so a long conversation is split.
    """
    cut = turns.withColumn("chunk", F.floor(F.col("pos") / CHUNK))
    in_chunk = Window.partitionBy("conv_id", "chunk").orderBy("pos")
    so_far = in_chunk.rowsBetween(Window.unboundedPreceding, 0)
    by_conv = Window.partitionBy("conv_id").orderBy("chunk")
    earlier = by_conv.rowsBetween(Window.unboundedPreceding, -1)
    chunks = cut.groupBy("conv_id", "chunk").agg(F.bit_xor("h1").alias("c1"), F.bit_xor("h2").alias("c2")).select(
        "conv_id", "chunk", F.coalesce(F.bit_xor("c1").over(earlier), F.lit(0)).alias("c1"),
        F.coalesce(F.bit_xor("c2").over(earlier), F.lit(0)).alias("c2"), F.lead("chunk").over(by_conv).isNull().alias("end"),
    )
    run = cut.select(
        "conv_id", "chunk", "pos", "h1", "h2", "words", F.bit_xor("h1").over(so_far).alias("r1"),
        F.bit_xor("h2").over(so_far).alias("r2"), F.lead("pos").over(in_chunk).isNull().alias("stop"),
    ).join(chunks, ["conv_id", "chunk"])
    x1, x2 = F.col("r1").bitwiseXOR(F.col("c1")), F.col("r2").bitwiseXOR(F.col("c2"))
    return run.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), x1.alias("x1"), x2.alias("x2"), x1.bitwiseXOR(F.col("h1")).alias("p1"),
        x2.bitwiseXOR(F.col("h2")).alias("p2"), "words", (F.col("stop") & F.col("end")).alias("last"),
    )


def _hash_at(rows: DataFrame, paths: DataFrame, depth: Column, names: tuple[str, str]) -> DataFrame:
    """``rows`` with the hash of the node at ``depth`` on the path of their ``conv_id``; the root has 0, 0."""
    at = paths.select(F.col("conv_id").alias("_c"), F.col("depth").alias("_d"), F.col("x1").alias("_1"), F.col("x2").alias("_2"))
    joined = rows.withColumn("_at", depth).join(at, (F.col("conv_id") == F.col("_c")) & (F.col("_at") == F.col("_d")), "left")
    zero = F.lit(0).cast("bigint")
    return joined.withColumns({names[0]: F.coalesce("_1", zero), names[1]: F.coalesce("_2", zero)}).drop("_at", "_c", "_d", "_1", "_2")


def _shard(depth: str, x1: str, x2: str) -> Column:
    return F.concat_ws(":", F.col(depth), F.col(x1), F.col(x2))


def _subtree_totals(nodes: DataFrame, paths: DataFrame, shard_convs: int, band: int, queue_rows: int) -> DataFrame:
    """(depth, x1, x2, leaves, saved): totals over the subtree of every node.

    Nodes of more than ``shard_convs`` conversations form the top of the trie; every subtree below it is a
    shard, cut again at each ``band`` levels.  Within shards totals run upwards by time-forward processing;
    then over the roots of cut shards, back into the shards they hang in, and at last over the top, which
    has at most 1 / ``shard_convs`` of all rows.  Totals are sums, so parts may be added in any order.
    """
    heavy = F.col("n_convs") > shard_convs
    top = stage(nodes.where(heavy), "trie-top")
    # A conversation's heavy nodes come before its light ones: their number is where its shard begins.
    depths = (
        paths.join(small(top.where("depth > 0").select(*NODE)), NODE, "left_semi").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_top"))
    )
    over = 1 if top.where("depth = 0").count() else 0
    light = (
        nodes.where(~heavy).join(depths, "conv_id", "left").withColumn("low", F.coalesce("n_top", F.lit(0)) + F.lit(over)).drop("n_top")
        .withColumn("r", F.col("low") + F.floor((F.col("depth") - F.col("low")) / band) * band)
    )
    light = stage(_hash_at(light, paths, F.col("r"), ("s1", "s2")).withColumn("shard", _shard("r", "s1", "s2")), "trie-light")
    inner = F.col("depth") > F.col("r")
    shaped = light.select(
        "shard", *NODE, F.when(inner, F.col("depth") - 1).alias("up"), "p1", "p2", "leaves", "saved", "conv_id", "low", "r"
    )
    totals = stage(time_forward(shaped, queue_rows), "trie-within")
    cut = totals.where((F.col("depth") == F.col("r")) & (F.col("r") > F.col("low")))
    if not cut.isEmpty():
        totals = _across_bands(totals, shaped, paths, band, queue_rows)
    messages = (
        totals.where((F.col("depth") == F.col("low")) & (F.col("depth") > 0))
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
        .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    )
    above = top.join(messages, NODE, "left").select(
        F.lit("top").alias("shard"), *NODE, F.when(F.col("depth") > 0, F.col("depth") - 1).alias("up"), "p1", "p2",
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
    )
    columns = [*NODE, "leaves", "saved"]
    return totals.select(*columns).unionByName(time_forward(above, queue_rows).select(*columns))


def _across_bands(totals: DataFrame, shaped: DataFrame, paths: DataFrame, band: int, queue_rows: int) -> DataFrame:
    """Totals of shards that are cut into bands: over the tree of their roots, then within the shards again."""
    roots = totals.where(F.col("depth") == F.col("r"))
    lower = roots.where(F.col("r") > F.col("low"))
    lower = _hash_at(lower, paths, F.col("r") - band, ("u1", "u2"))
    lower = stage(_hash_at(lower, paths, F.col("low"), ("l1", "l2")).withColumn("tree", _shard("low", "l1", "l2")), "trie-cut")
    columns = ["shard", *NODE, "up", "p1", "p2", "leaves", "saved"]
    below = lower.select(
        F.col("tree").alias("shard"), *NODE, (F.col("r") - band).alias("up"), F.col("u1").alias("p1"), F.col("u2").alias("p2"), "leaves", "saved"
    )
    tops = roots.where(F.col("r") == F.col("low")).join(lower.select(F.col("tree").alias("shard")).distinct(), "shard", "left_semi")
    whole = time_forward(tops.withColumn("up", F.lit(None).cast("bigint")).select(columns).unionByName(below.select(columns)), queue_rows)
    sent = (
        whole.where("up IS NOT NULL").select(*NODE, "leaves", "saved").join(lower.select(*NODE, "p1", "p2", "shard"), NODE)
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
        .agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    )
    sent = stage(sent, "trie-sent")
    touched = shaped.select("shard", *NODE).join(sent.select(*NODE), NODE, "left_semi").select("shard").distinct()
    touched = stage(touched, "trie-touched")
    again = (
        shaped.join(touched, "shard", "left_semi").join(sent, NODE, "left")
        .withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0)))
        .withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
        .select(shaped.columns)
    )
    return stage(totals.join(touched, "shard", "left_anti").unionByName(time_forward(again, queue_rows)), "trie-bands")


def prefix_trie(conversations: DataFrame, shard_convs: int = SHARD_CONVS, band: int = BAND, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations; see `op13_prefix_trie` for its columns.

    Turns stand in the order of turn (null first), role and SHA-256 of role and text; repeated rows are turns
    of their own.  Null role and text: empty.  Rows with a null conv_id belong to no conversation and are
    left out.  A negative conv_id c shares the opening of c - c % 20 with the sign of c (SQL's remainder).
    A text of any length goes no further than its hash and word count.  An empty table has no nodes.
    """
    turns, convs = rebuilt_turns(conversations)
    paths = stage(prefixes(turns), "trie-paths")
    zero = F.lit(0).cast("bigint")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id", "n_convs", zero.alias("words"), zero.alias("p1"), zero.alias("p2")
    )
    found = paths.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.min("p1").alias("p1"), F.min("p2").alias("p2")
    )
    found = stage(root.unionByName(found), "trie-nodes")
    children = found.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = found.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = stage(
        nodes.withColumn("leaves", (F.col("n_children") == 0).cast("bigint")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")),
        "trie-shaped",
    )
    totals = _subtree_totals(nodes, paths, shard_convs, band, queue_rows).select(
        *NODE, F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")
    )
    members = paths.where("last").select(*NODE, "conv_id").unionByName(
        convs.where("n_turns = 0").select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "conv_id")
    )
    ends = digest_ids(members, NODE, "conv_id").withColumnRenamed("sha256", "ends_sha256")
    parents = found.select(
        (F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id")
    )
    return (
        nodes.select(*NODE, "p1", "p2", "conv_id", "n_convs", "n_children")
        .join(totals, NODE)
        .join(ends, NODE, "left")
        .join(parents, ["depth", "p1", "p2"], "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
           sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS first, xor(list_reduce(
    list_concat([4294967295::UBIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda x: 0::UBIGINT)),
      lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)), 4294967295::UBIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.first AND t.pos < c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos >= c.h
), lists AS (
  SELECT c.conv_id, coalesce(list({'role': r.role, 'text': r.text} ORDER BY own, pos) FILTER (WHERE r.conv_id IS NOT NULL), []) AS said
  FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id
), paths AS (
  SELECT conv_id, depth, sha256(said[1:depth]::VARCHAR) AS id, CASE WHEN depth > 0 THEN sha256(said[1:depth - 1]::VARCHAR) END AS parent,
         said[depth].text AS text, depth = len(said) AS ends
  FROM (SELECT conv_id, said, unnest(range(len(said) + 1)) AS depth FROM lists)
), nodes AS (
  SELECT depth, id, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')) END AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM paths GROUP BY depth, id
), shaped AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.parent = n.id AND c.depth = n.depth + 1) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.id = n.parent AND p.depth = n.depth - 1
), subtree AS (
  SELECT a.depth, a.id, sum(CASE WHEN d.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(d.saved) AS saved_tokens
  FROM (SELECT DISTINCT a.depth, a.id, b.depth AS d_depth, b.id AS d_id
        FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth) a
  JOIN shaped d ON d.id = a.d_id AND d.depth = a.d_depth GROUP BY a.depth, a.id
)
SELECT s.conv_id, s.depth, s.parent_conv_id, s.n_convs, s.n_children, t.n_leaves::BIGINT AS n_leaves,
       t.saved_tokens::BIGINT AS saved_tokens, s.ends_sha256
FROM shaped s JOIN subtree t USING (depth, id)
"""


@query("op13_prefix_trie", SQL)
def op13_prefix_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations"))
