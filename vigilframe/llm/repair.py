"""Conversation structure repair: cheapest edits by depth-first branch-and-bound over chunks of turns."""

from __future__ import annotations

import hashlib
from typing import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from vigilframe.llm.common import query, small_batches, stage, table
from vigilframe.llm.sequence import digest_pieces, sorted_parts

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What a repaired conversation can end in: nothing yet, after the system turn, after a user, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: Role initials that a state takes as they are, and the state and role of a turn that is made to fit.
TAKES = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FITTING = {START: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
LEGAL = {"su", "ua", "au"}
#: Rows, and characters of text, after which a chunk ends.
CHUNK_ROWS, CHUNK_CHARS = 64, 1_000_000
BLANKS = " \t\n\x0b\x0c\r"

CHUNK_SCHEMA = (
    "conv_id bigint, chunk bigint, illegal bigint, first string, last string, "
    "edges array<struct<start:int,end:int,cost:bigint,audit:string>>, "
    "roles array<string>, texts array<string>, copies array<bigint>"
)
PATH_SCHEMA = "conv_id bigint, chunk bigint, start int, audit string, cost bigint, illegal bigint"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): distinct rows after the damage and how often each stands.

    Nulls in role and text, and in the hashed ``conv_id:turn``, are one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), fault.alias("fault"),
        space("role").alias("role"), space("text").alias("text"),
    ).where("fault <> 0")
    text = (
        F.when(F.col("fault") == 1, F.lit(""))
        .when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    return (
        rows.select(
            "conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
            F.when(F.col("fault") == 3, 2).otherwise(1).alias("n"),
        )
        .groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """The rows with ``said`` (hash of role and text), ``blank``, ``seen`` (earlier in the conversation) and ``cut`` (truncated).

    Of ``n`` equal rows the first may be new; the others are always duplicates.
    """
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.withColumns(
        {
            "said": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256),
            "blank": body == "",
            "at": F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn")),
            "cut": ~F.right(body, F.lit(1)).isin(".", "!", "?"),
        }
    )
    firsts = rows.groupBy("conv_id", "said").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    firsts = firsts.select(F.col("conv_id").alias("_c"), F.col("said").alias("_s"), "first")
    joined = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("said") == F.col("_s")), "left")
    seen = ~F.col("blank") & F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    return joined.select("conv_id", "turn", "role", "text", "n", "said", "blank", seen.alias("seen"), (~F.col("blank") & F.col("cut")).alias("cut"))


def fault_counts(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) of rows from `with_faults`."""
    one = lambda c: F.when(c, F.col("n")).otherwise(0)
    fresh = ~F.col("blank") & ~F.col("seen")
    by_turn = rows.groupBy("conv_id", "turn").agg(
        F.sum(one(F.col("blank"))).alias("blank"),
        F.sum(F.when(fresh, F.col("n") - 1).otherwise(one(F.col("seen")))).alias("duplicate"),
        F.sum(F.when(fresh & F.col("cut"), 1).otherwise(0)).alias("truncated"),
    )
    return by_turn.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.sum(c).cast("bigint").alias(c) for c in ("blank", "duplicate", "truncated")],
    )


def _moves(row: tuple[bool, int, str, bool], state: int) -> list[tuple[int, int, str]]:
    """(state after, cost, letters) of the edits that deal with a row and its copies."""
    doomed, n, initial, cut = row
    moves = [(state, DELETE * n, "D" * n)]
    if not doomed:
        stay, gone = TRUNCATED * cut + DELETE * (n - 1), "D" * (n - 1)
        moves.append((FITTING[state][0], stay + REROLE, "R" + gone))
        if initial in TAKES[state]:
            moves.append((TAKES[state][initial], stay, "K" + gone))
    return moves


def suffix_bounds(rows: list[tuple[bool, int, str, bool]], end: int) -> list[list[float]]:
    """Lower bounds: the least cost, whatever the audit, from each (row, state) to ``end``."""
    never = float("inf")
    low = [[never] * 4 for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        if i == len(rows):
            low[i][end] = 0
        else:
            for s in STATES:
                low[i][s] = min(cost + low[i + 1][to] for to, cost, _ in _moves(rows[i], s))
        # Two rounds: an insertion may follow another, and a third leads back.
        for _ in range(2):
            for s in STATES:
                low[i][s] = min(low[i][s], INSERT + low[i][FITTING[s][0]])
    return low


def cheapest_edits(rows: list[tuple[bool, int, str, bool]], start: int) -> tuple[list[tuple[int, str] | None], int]:
    """Least (cost, audit) from state ``start`` to every end state over rows (doomed, copies, initial, cut), and the steps taken.

    For each end state a depth-first branch-and-bound with an explicit stack.  A prefix goes when its cost and
    the bound of its suffix exceed the incumbent's cost, or equal it with a greater audit.  ``seen`` holds the
    best prefix of every node (row, state): prefixes of one node have the same letters but for insertions,
    which cost something, so the lesser (cost, audit) stays the lesser whatever follows.  Edits are tried in
    order of cost with bound, then letter; the search ends when nothing is left that could be better.
    """
    best: list[tuple[int, str] | None] = [None] * 4
    steps = 0
    for end in STATES:
        low = suffix_bounds(rows, end)
        seen: dict[tuple[int, int], tuple[int, str]] = {}
        stack = [(0, start, 0, "")]
        while stack:
            i, state, cost, audit = stack.pop()
            bound, known, incumbent = cost + low[i][state], seen.get((i, state)), best[end]
            if bound == float("inf") or known is not None and known <= (cost, audit):
                continue
            if incumbent is not None and (bound > incumbent[0] or bound == incumbent[0] and audit > incumbent[1][: len(audit)]):
                continue
            seen[i, state] = (cost, audit)
            steps += 1
            if i == len(rows) and state == end and (incumbent is None or (cost, audit) < incumbent):
                best[end] = (cost, audit)
            branches = [(i, FITTING[state][0], cost + INSERT, audit + "I")]
            if i < len(rows):
                branches += [(i + 1, to, cost + more, audit + letters) for to, more, letters in _moves(rows[i], state)]
            # The most promising last, since the stack gives it first.
            branches.sort(key=lambda b: (b[2] + low[b[0]][b[1]], b[3]), reverse=True)
            stack.extend(branches)
    return best, steps


def replay(roles: list[str], texts: list[str], copies: list[int], audit: str, state: int) -> list[str]:
    """``role:text`` of the turns that the edits of ``audit`` leave, from ``state`` on."""
    out, at = [], 0

    def insert() -> None:
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            state, role = FITTING[state]
            out.append(f"{role}:")
            at += 1

    for role, text, n in zip(roles, texts, copies):
        insert()
        letter = audit[at]
        if letter == "K":
            state = TAKES[state][role[0]]
            out.append(f"{role}:{text}")
        elif letter == "R":
            state, role = FITTING[state]
            out.append(f"{role}:{text}")
        at += n
    insert()
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to rows of CHUNK_SCHEMA; a chunk ends with its conversation, or when it is full."""
    part, number = TaskContext.get().partitionId(), 0
    conv, rows, chars, fresh, began = None, [], 0, False, False
    schema = pa.schema(
        [
            ("conv_id", pa.int64()), ("chunk", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
            ("edges", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
            ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("copies", pa.list_(pa.int64())),
        ]
    )

    def chunk() -> dict:
        nonlocal number
        number += 1
        initials = [r[0][:1] for r in rows]
        shapes = [(r[3], r[2], c, r[4]) for r, c in zip(rows, initials)]
        edges = []
        for start in (START,) if fresh else STATES:
            for end, found in enumerate(cheapest_edits(shapes, start)[0]):
                if found is not None:
                    edges.append({"start": start, "end": end, "cost": found[0], "audit": found[1]})
        return {
            "conv_id": conv, "chunk": (part << 40) + number, "first": initials[0], "last": initials[-1], "edges": edges,
            "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])) + sum(r[2] - 1 for r in rows),
            "roles": [r[0] for r in rows], "texts": [r[1] for r in rows], "copies": [r[2] for r in rows],
        }

    for batch in batches:
        out = []
        for c, *row in zip(*[batch.column(k).to_pylist() for k in ("conv_id", "role", "text", "n", "doomed", "cut")]):
            if rows and (c != conv or len(rows) >= CHUNK_ROWS or chars >= CHUNK_CHARS):
                out.append(chunk())
                fresh = c != conv
                rows, chars = [], 0
            # The first rows of a task may go on with the conversation of the task before.
            conv, began = c, True
            rows.append(row)
            chars += len(row[1]) + len(row[0])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if began:
        yield pa.RecordBatch.from_pylist([chunk()], schema)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of each conversation in order to PATH_SCHEMA: the edits chosen in each, and a row (chunk null) of the whole.

    Audits are compared by a stand-in: the rank of the audit without its last insertions, and these.
    Audits over the same rows that differ without their last insertions differ at a letter, so ranks hold.
    """
    schema = pa.schema(
        [("conv_id", pa.int64()), ("chunk", pa.int64()), ("start", pa.int32()), ("audit", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64())]
    )
    conv, heads, back, illegal, last, open_ = None, {}, [], 0, "", False

    def end() -> list[tuple]:
        state = min((s for s in (START, ASSISTANT) if s in heads), key=heads.get)
        cost, rows = heads[state][0], []
        for number, chosen in reversed(back):
            start, audit = chosen[state]
            rows.append((conv, number, start, audit, None, None))
            state = start
        rows.reverse()
        return [*rows, (conv, None, None, "".join(r[3] for r in rows), cost, illegal)]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        out = []
        for c, number, inside, a, b, edges in zip(
            *[batch.column(k).to_pylist() for k in ("conv_id", "chunk", "illegal", "first", "last", "edges")]
        ):
            if not open_ or c != conv:
                if open_:
                    out.extend(end())
                conv, heads, back, illegal, open_ = c, {START: (0, "")}, [], 0, True
            else:
                illegal += last + a not in LEGAL
            illegal, last = illegal + inside, b
            chosen, reached = {}, {}
            for e in edges:
                if e["start"] in heads:
                    cost, stand = heads[e["start"]]
                    to = (cost + e["cost"], stand + e["audit"])
                    if e["end"] not in reached or to < reached[e["end"]]:
                        reached[e["end"]], chosen[e["end"]] = to, (e["start"], e["audit"])
            ranks = {x: chr(33 + k) for k, x in enumerate(sorted({s.rstrip("I") for _, s in reached.values()}))}
            heads = {k: (cost, ranks[s.rstrip("I")] + "I" * (len(s) - len(s.rstrip("I")))) for k, (cost, s) in reached.items()}
            back.append((number, chosen))
        if out:
            yield table(out)
    if open_:
        yield table(end())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("roles", "texts", "copies", "audit", "start")]
        made = [replay(*x) for x in zip(*columns)]
        kept = pa.array([k for k, x in enumerate(made) if x], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id").take(kept), batch.column("chunk").take(kept), pa.array(["\n".join(x) for x in made if x], pa.string())],
            names=["conv_id", "chunk", "piece"],
        )


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, n); see `op11_structure_repair`.

    Rows stand by turn (null first), then role, then SHA-256 of role and text; ``n`` equal rows stand
    together.  Ranges of sorted rows are cut into chunks of at most ``CHUNK_ROWS`` distinct rows, so a
    conversation that holds a third of all rows is searched in many tasks; each chunk gives its least (cost,
    audit) between any two states.  What passes through one task per conversation is a row per chunk, and
    the digest of the repaired text, both as streams.  The audit is one string: 2 GB is its limit.
    A null conv_id is a conversation; an empty table gives no rows.  Texts of any length are rows of their own.
    """
    spark = rows.sparkSession
    known = stage(with_faults(rows), "repair-rows")
    ordered = sorted_parts(known, ["conv_id", "turn", "role", "said"]).select(
        "conv_id", "role", "text", "n", (F.col("blank") | F.col("seen")).alias("doomed"), "cut"
    )
    with small_batches(spark, 256):
        chunks = stage(ordered.mapInArrow(_chunks, CHUNK_SCHEMA), "repair-chunks")
        slim = chunks.select("conv_id", "chunk", "illegal", "first", "last", "edges")
        paths = stage(
            slim.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_paths, PATH_SCHEMA), "repair-paths"
        )
        chosen = paths.where("chunk IS NOT NULL").select("chunk", "start", "audit")
        pieces = (
            chunks.select("conv_id", "chunk", "roles", "texts", "copies").join(chosen, "chunk")
            .select("conv_id", "chunk", "roles", "texts", "copies", "audit", "start")
            .mapInArrow(_pieces, "conv_id bigint, chunk bigint, piece string")
        )
        digests = stage(digest_pieces(pieces, ["conv_id"], ["chunk"], "\n"), "repair-digests")
    whole = paths.where("chunk IS NULL").select("conv_id", "illegal", "cost", "audit")
    return joined_by_id([fault_counts(known), whole, digests.withColumnRenamed("sha256", "repaired_sha256")])


def joined_by_id(parts: list[DataFrame]) -> DataFrame:
    """Tables with one row per conv_id side by side; a conversation without a row in one of them gets nulls."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    return every.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in every.columns if c != "conv_id"])


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Conversations damaged by `damaged`, judged and repaired; every original conv_id has a row."""
    named = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    every = joined_by_id([repair_conversations(stage(damaged(conversations), "damaged")), named])
    zero: Column = F.lit(0).cast("bigint")
    return every.select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


@query("op11_structure_repair")
def op11_structure_repair(spark, sf_dir):
    return repair_damaged(table(spark, sf_dir, "conversations"))
