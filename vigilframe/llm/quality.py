"""Quality rules: repeated words and lines within a text, and lines that many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilframe.llm.common import SPACE, WORD, free_name, let, query, stage, table, words

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: A line is boilerplate of its host when more distinct texts of the host hold it than both limits.
MIN_LINE_DOCS = 10
MAX_LINE_PERCENT = 10
#: A document is depleted when less than this share of its words is left without boilerplate lines.
MIN_LEFT_PERCENT = 30
#: Line hashes of all hosts that are sent to every task at most; beyond, texts are joined by host.
BROADCAST_LINES = 1_000_000
SYMBOLS = "[#*$%&|<>]"


def _covered(positions: Column, n: int) -> Column:
    """Places covered by windows of ``n`` at the ascending ``positions``."""
    return F.aggregate(
        F.transform(
            positions, lambda p, i: F.least(F.coalesce(F.get(positions, i + 1) - p, F.lit(n)), F.lit(n)).cast("bigint")
        ),
        F.lit(0).cast("bigint"),
        lambda a, b: a + b,
    )


def repeated_words(ws: Column, n: int = 3) -> Column:
    """Number of words in ``n``-word windows that occur twice or more among the words ``ws``."""
    grams = F.transform(
        F.slice(ws, 1, F.greatest(F.size(ws) - (n - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, n)]),
    )

    def count(hs: Column) -> Column:
        placed = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda s: F.filter(
            s, lambda x, k: (x.h == F.get(s, k + 1).h) | ((k > 0) & (x.h == F.get(s, F.greatest(k - 1, F.lit(0))).h))
        )
        positions = lambda s: F.sort_array(F.transform(again(s), lambda x: x.i))
        return F.when(
            F.size(F.array_distinct(hs)) < F.size(hs), let(let(placed, positions), lambda p: _covered(p, n))
        ).otherwise(F.lit(0).cast("bigint"))

    return let(grams, count)


def text_lines(text: Column) -> Column:
    """Lines (split at line feeds) that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.rlike(x, F.lit(WORD)))


def line_hash(line: Column) -> Column:
    """Hash of a line in lower case with single spaces between its words."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), SPACE, " ")))


def base_counts(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text (null: all 0)."""
    long = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return let(
        words(text),
        lambda ws: F.struct(
            long(F.size(ws)).alias("n_words"),
            long(F.length(F.array_join(ws, ""))).alias("word_chars"),
            long(F.regexp_count(text, F.lit(SYMBOLS))).alias("n_symbols"),
            long(let(text_lines(text), lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))).alias("n_dup_lines"),
            long(repeated_words(ws)).alias("n_repeat_words"),
        ),
    )


def frequent_lines(docs: DataFrame, host: str, min_docs: int, max_percent: int) -> DataFrame:
    """Per host, the hashes of lines that more than ``max_percent`` % and more than ``min_docs`` of its distinct texts hold.

    Copies of a text count once, so that a document is no boilerplate for having copies.  A host's array
    has fewer than (mean lines of a text) * 100 / max_percent entries, whatever the size of the corpus.
    """
    seen = (
        docs.select(F.col(host).alias("host"), "text")
        .select(
            "host",
            F.xxhash64("text").alias("doc"),
            F.explode(
                F.concat(F.array(F.lit(None).cast("bigint")), F.array_distinct(F.transform(text_lines(F.col("text")), line_hash)))
            ).alias("line"),  # null: the text itself, to count the texts of a host
        )
        .distinct()
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    seen = stage(seen.where((F.col("n") > min_docs) | F.col("line").isNull()), "line-counts")
    texts = seen.where(F.col("line").isNull()).select("host", F.col("n").alias("texts"))
    return (
        seen.where(F.col("line").isNotNull())
        .join(texts, "host")
        .where(F.col("n") * 100 > F.col("texts") * max_percent)
        .groupBy("host")
        .agg(F.collect_list("line").alias("lines"))
    )


def judge_quality(
    docs: DataFrame,
    host: Column | None = None,
    min_line_docs: int = MIN_LINE_DOCS,
    max_line_percent: int = MAX_LINE_PERCENT,
    min_left_percent: int = MIN_LEFT_PERCENT,
) -> DataFrame:
    """Add the base counts, ``base_failed``, ``n_boiler_words``, ``kept`` and ``left_text`` to every row of ``docs``.

    ``left_text``: the text without the boilerplate lines of its host, unchanged where it holds none.
    ``base_failed``: under 50 words, or more than half of the words in repeated 3-word windows.  A
    document that passes is rejected if under ``min_left_percent`` % of its words are left once the
    boilerplate lines of its host are taken away.  ``host``: a string column, ``source`` by default.
    Null text and empty text: no words, so base_failed.  A very long text is read
    whole, within its row.  Limits are passed by more, so ties do not pass.  An empty table gives no rows.  Columns of
    ``docs`` with the name of an added one are replaced.  Null host: a host of its own.  Repeated rows are judged
    alike.  What is known of a host is joined to its documents as one short array; up to
    BROADCAST_LINES hashes in all it is broadcast, so texts stay where they are.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_boiler_words", "kept", "left_text"]
    keep = [c for c in docs.columns if c.lower() not in added]
    key, base, lines = (free_name(docs, c) for c in ("host_key", "base", "boiler"))
    source = F.col("source") if host is None else host
    hosted = docs.withColumn(key, F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string"))))
    boiler = stage(
        frequent_lines(hosted, key, min_line_docs, max_line_percent).select(
            F.col("host").alias(key), F.col("lines").alias(lines)
        ),
        "boiler-lines",
    )
    if (boiler.agg(F.sum(F.size(lines) + 1)).first()[0] or 0) <= BROADCAST_LINES:
        boiler = F.broadcast(boiler)
    boilerplate = lambda x: F.rlike(x, F.lit(WORD)) & F.array_contains(F.col(lines), line_hash(x))
    removed = F.aggregate(
        F.filter(F.split(F.col("text"), "\n"), boilerplate),
        F.lit(0).cast("bigint"),
        lambda a, x: a + F.regexp_count(x, F.lit(WORD)),
    )
    left_lines = F.array_join(F.filter(F.split(F.col("text"), "\n"), lambda x: ~boilerplate(x)), "\n")
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT
    )
    left = (F.col("n_words") - F.col("n_boiler_words")) * 100 >= F.col("n_words") * min_left_percent
    return (
        hosted.withColumn(base, base_counts(F.col("text")))
        .join(boiler, key, "left")
        .withColumn("n_boiler_words", F.when(F.col(lines).isNull(), F.lit(0).cast("bigint")).otherwise(F.coalesce(removed, F.lit(0).cast("bigint"))))
        .withColumn("left_text", F.when(F.col("n_boiler_words") > 0, left_lines).otherwise(F.col("text")))
        .select(*keep, f"{base}.*", "n_boiler_words", "left_text")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & left)
        .select(*keep, *added)
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """Documents that the rules keep, with the columns they came with.

    Boilerplate lines of the host are taken out of ``text``; ``n_chars``, if there is one, is counted
    again where that changes a text.  Nulls, repeats and very long texts: as in `judge_quality`; null and empty
    texts go.  Other columns keep their values, whatever their names; an empty table stays empty.
    """
    packed = docs.select(F.struct("*").alias("row"), "text", "source")
    row = F.col("row")
    for name, kind in docs.dtypes:
        if name.lower() in ("text", "n_chars"):
            new = F.col("left_text") if name.lower() == "text" else F.length("left_text")
            row = row.withField(name, F.when(F.col("n_boiler_words") > 0, new.cast(kind)).otherwise(F.col("row")[name]))
    return judge_quality(packed).where("kept").select(row.alias("row")).select("row.*")


@query(
    "op8_quality_rules",
    r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS host FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p
  FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) AS k FROM g) WHERE k > 1) GROUP BY rid),
li AS (SELECT rid, line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
du AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM li GROUP BY rid),
ln AS (SELECT rid, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
  len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM li),
hl AS (SELECT host, norm, count(DISTINCT text) AS n FROM ln JOIN d USING (rid) GROUP BY ALL),
ht AS (SELECT host, count(DISTINCT text) AS texts FROM d GROUP BY host),
fl AS (SELECT host, norm FROM hl JOIN ht USING (host) WHERE n > 10 AND n * 100 > texts * 10),
bw AS (SELECT rid, sum(ln.n)::BIGINT AS n FROM ln JOIN d USING (rid) JOIN fl USING (host, norm) GROUP BY rid),
b AS (SELECT d.doc_id, len(w.ws)::BIGINT AS n_words, len(array_to_string(w.ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(du.n, 0)::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(bw.n, 0)::BIGINT AS n_boiler_words
  FROM d JOIN w USING (rid) LEFT JOIN r USING (rid) LEFT JOIN du USING (rid) LEFT JOIN bw USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_boiler_words,
  NOT base_failed AND (n_words - n_boiler_words) * 100 >= n_words * 30 AS kept FROM f""",
)
def op8_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge_quality(docs).drop("text", "source", "left_text")
