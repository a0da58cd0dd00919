"""Chat formatting: conversations as windows of a token budget, with a loss mask over new assistant texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilframe.llm.common import WORD, let, query, table

#: Strings with a meaning to a model's reader; inside texts they are broken up reversibly.
CONTROL = [
    "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>", "<|endoftext|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
]
START, END = "<|im_start|>", "<|im_end|>\n"
BUDGET, HISTORY = 1024, 256
#: A conversation is cut into chunks of so many turn numbers for its running sums.
CHUNK_TURNS = 128

_CONTROL_AT = "([<\\[])(?=" + "|".join(
    c[1:].replace("[", "\\[").replace("]", "\\]").replace("|", "\\|") for c in CONTROL
) + ")"


def escape(text: Column) -> Column:
    """Double every backslash, then put one after the first character of every control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL_AT, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def escape_role(role: Column) -> Column:
    """As `escape`; line feeds get a backslash as well, since the first bare one ends the role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def n_tokens(piece: Column) -> Column:
    """Size of a piece against the budget: its words and an eighth of its characters."""
    return (F.regexp_count(piece, F.lit(WORD)) + F.ceil(F.length(piece) / 8)).cast("bigint")


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, window, text, n_tokens, n_repeated, loss): formatted windows of all conversations.

    Turns stand in the order of turn, role, text.  A running sum of their tokens deals them to spans: a
    span takes the turns that begin within the same stretch of ``budget - history`` tokens, so spans end
    with turns and each turn is new in exactly one.  A window holds the system turn that opens the
    conversation, then the turns that begin at most ``history`` tokens before the span, then the span.
    ``n_repeated`` of its turns are repeated; ``loss`` has [begin, end) in code points of the assistant
    texts that are new, so repeated targets are masked.  A turn is never split: a window is longer than the budget if a turn reaches beyond.

    Null text and null role: empty.  Null conv_id: a conversation like any other; null turn: before all
    others.  Repeated rows are turns of their own.  An empty table gives no windows.
    """
    stride = budget - history
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).select(
        "conv_id", "turn", "role",
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"),
    )
    turns = turns.withColumn("size", n_tokens(F.concat("head", "body", F.lit(END)))).withColumn(
        "chunk", F.coalesce(F.floor(F.col("turn") / CHUNK_TURNS), F.lit(-(1 << 62)))
    )
    # Running sums: within chunks of turns, and over the chunks of a conversation.
    in_chunk = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "body").rowsBetween(Window.unboundedPreceding, -1)
    chunks = turns.groupBy("conv_id", "chunk").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = chunks.select(
        F.col("conv_id").alias("c"), F.col("chunk").alias("k"),
        F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("s0"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
    )
    placed = (
        turns.withColumn("s1", F.coalesce(F.sum("size").over(in_chunk), F.lit(0)))
        .withColumn("n1", F.count(F.lit(1)).over(in_chunk))
        .join(ahead, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")))
        .select(
            "conv_id", "role", "head", "body", "size", (F.col("s0") + F.col("s1")).alias("at"), (F.col("n0") + F.col("n1")).alias("place"),
        )
        .withColumn("span", F.call_function("div", F.col("at"), F.lit(stride).cast("bigint")))
    )
    # A turn can only be history of the next span that has turns.
    spans = placed.groupBy("conv_id", "span").agg(
        F.min("at").alias("begins"), F.min(F.when(F.col("place") == 0, F.struct("role", "head", "body", "size"))).alias("first")
    )
    by_span = Window.partitionBy("conv_id").orderBy("span")
    opening = F.max("first").over(Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, 0))
    spans = spans.select(
        F.col("conv_id").alias("c"), F.col("span").alias("k"), "begins",
        F.lead("span").over(by_span).alias("next"), F.lead("begins").over(by_span).alias("next_begins"),
        F.when(opening.role == "system", opening).alias("system"),
    )
    known = placed.join(
        spans.select("c", "k", "next", "next_begins"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("span") == F.col("k"))
    )
    is_system = (F.col("place") == 0) & (F.col("role") == "system")
    repeats = F.col("next").isNotNull() & (F.col("at") >= F.col("next_begins") - history) & ~is_system
    piece = lambda new: F.struct(
        F.when(F.lit(new), F.col("span")).otherwise(F.col("next")).alias("window"), F.lit(new).alias("new"),
    )
    used = known.select(
        "conv_id", "place", "role", "head", "body", "size",
        F.explode(F.when(repeats, F.array(piece(True), piece(False))).otherwise(F.array(piece(True)))).alias("p"),
    ).select("conv_id", F.col("p.window").alias("window"), F.struct("place", F.col("p.new").alias("new"), "role", "head", "body", "size").alias("t"))
    windows = used.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    windows = windows.join(
        spans.select("c", "k", "system"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("window") == F.col("k"))
    )
    system = F.col("system")
    shown = F.when(
        system.isNotNull() & (F.element_at("turns", 1)["place"] > 0),
        F.concat(
            F.array(
                F.struct(
                    F.lit(0).cast("bigint").alias("place"), F.lit(False).alias("new"), system.role.alias("role"), system["head"].alias("head"), system.body.alias("body"), system["size"].alias("size"),
                )
            ),
            F.col("turns"),
        ),
    ).otherwise(F.col("turns"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))
    tail = F.lit(len(END))

    def step(acc: Column, t: Column) -> Column:
        a = acc["at"] + F.length(t["head"])
        b = a + F.length(t["body"])
        one = F.array(F.struct(a.alias("begin"), b.alias("end")))
        return F.struct(
            (b + tail).alias("at"),
            F.when(t["new"] & (t["role"] == "assistant"), F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"),
        )

    return windows.withColumn("shown", shown).select(
        "conv_id", "window",
        F.array_join(F.transform("shown", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("text"),
        F.aggregate("shown", F.lit(0).cast("bigint"), lambda a, t: a + t["size"]).alias("n_tokens"),
        F.size(F.filter("shown", lambda t: ~t["new"])).alias("n_repeated"),
        F.aggregate("shown", begin, step).spans.alias("loss"),
    )


def read_turns(text: Column) -> Column:
    """Turns (role, text) of a formatted window, unescaped."""
    pieces = F.filter(F.split(text, START.replace("|", r"\|")), lambda p, i: i > 0)
    head = r"^((?:[^\\\n]++|\\[\s\S])*+)\n"

    def turn(p: Column) -> Column:
        inside = F.substring(p, F.lit(1), F.length(p) - len(END))
        return let(
            F.regexp_extract(inside, head, 1),
            lambda role: F.struct(
                unescape(role).alias("role"), unescape(F.substring(inside, F.length(role) + 2, F.length(inside))).alias("text")
            ),
        )

    return F.transform(pieces, turn)


def read_loss(text: Column, loss: Column) -> Column:
    """Texts under the loss mask, in order and unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(text, s["begin"] + 1, s["end"] - s["begin"]))), "")


def window_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, what is read back from its windows."""
    new = F.filter(read_turns(F.col("text")), lambda t, i: i >= F.col("n_repeated"))
    # The system turn of the first window is new and stands first; repeated turns always come before new ones.
    parts = windows.select(
        "conv_id", "window", F.length("text").cast("bigint").alias("chars"), new.alias("turns"), read_loss(F.col("text"), F.col("loss")).alias("loss")
    ).select(
        "conv_id", "chars", F.size("turns").cast("bigint").alias("n"),
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "").alias("turns"),
            "loss",
        ).alias("p"),
    )
    whole = parts.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("p")).alias("p")
    )
    joined = lambda name: F.array_join(F.transform("p", lambda x: x[name]), "")
    # Joined once: a conversation is one row here.
    loss = let(joined("loss"), lambda x: F.struct(F.length(x).cast("bigint").alias("chars"), F.sha2(x, 256).alias("sha256")))
    return whole.select(
        "conv_id", "n_turns", F.sha2(joined("turns"), 256).alias("turns_sha256"), "formatted_chars", loss.alias("loss")
    ).select(
        "conv_id", "n_turns", "turns_sha256", F.col("loss.chars").alias("loss_chars"), F.col("loss.sha256").alias("loss_sha256"),
        "formatted_chars",
    )


def with_example(conversations: DataFrame) -> DataFrame:
    """The conversations, and conversation -7, whose texts are control strings."""
    example = conversations.sparkSession.createDataFrame(
        [(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(["user", "assistant"])],
        "conv_id bigint, turn bigint, role string, text string",
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(example)


@query("op5_chat_format")
def op5_chat_format(spark, sf_dir):
    return window_digests(chat_windows(with_example(table(spark, sf_dir, "conversations"))))
