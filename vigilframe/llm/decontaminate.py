"""Benchmark decontamination: short test items inside long documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilframe.llm.common import free_name, query, shingle_hashes, small, stage, table

THRESHOLD_PERCENT = 80


def _mixed(h: Column) -> Column:
    """The min-wise order of shingles: a second hash, so that it is independent of the first."""
    return F.xxhash64(h, F.lit(7))


def item_sketches(items: DataFrame, threshold_percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(item_id, n_item, hash, is_probe): all shingles of every item; the smallest by min-wise order are probes.

    Items are partitioned by their number of shingles n.  An item that a document contains to
    ``threshold_percent`` % misses at most floor((100 - threshold) * n / 100) shingles, so of that many
    smallest hashes plus one at least one occurs: the sketch of a size partition is just that long, and no
    contained item is missed.
    """
    sketched = items.select("item_id", shingle_hashes(F.col("text")).alias("hashes")).where(F.size("hashes") > 0)
    n = F.size("hashes")
    length = F.floor(n * (100 - threshold_percent) / 100) + 1
    ordered = F.array_sort(F.transform("hashes", lambda h: F.struct(_mixed(h).alias("m"), h.alias("h"))))
    return (
        sketched.select("item_id", n.cast("bigint").alias("n_item"), length.cast("int").alias("length"), ordered.alias("o"))
        .select("item_id", "n_item", "length", F.posexplode("o").alias("place", "x"))
        .select("item_id", "n_item", F.col("x.h").alias("hash"), (F.col("place") < F.col("length")).alias("is_probe"))
        .distinct()
    )


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", threshold_percent: int = THRESHOLD_PERCENT
) -> DataFrame:
    """(``id_col``, item_id, n_shared, n_item): items of which a document contains ``threshold_percent`` % or more.

    Containment is the share of an item's distinct 5-word shingles (lower case) that the document has.
    Candidates are found by the items' min-wise probes and then verified with all shingles.  Texts
    without words contain and match nothing; a text under 5 words counts as one shingle.  Rows with the
    same id are one document, rows with the same item_id and text one item; null ids form one group
    like any other.  Each document's shingles are made distinct before they leave its row; of a very long text
    only those that are a probe of some item leave it.  Ties have no part in it.  An empty table of documents or
    items gives no rows.  Other columns, whatever their names, are left out.
    """
    sketches = stage(item_sketches(items, threshold_percent), "item-sketches")
    probes = sketches.where("is_probe").select("hash").distinct()
    parts = docs.select(F.col(id_col).alias("id"), shingle_hashes(F.col("text")).alias("hashes"))
    found = (
        parts.select("id", F.explode("hashes").alias("hash")).join(probes, "hash").select("id").distinct()
    )
    found = stage(found, "candidates")
    # Only candidates are shingled again, this time against every shingle of the items.
    full = parts.join(found, parts.id.eqNullSafe(found.id), "left_semi")
    return (
        full.select("id", F.explode("hashes").alias("hash"))
        .join(sketches.select("hash", "item_id", "n_item"), "hash")
        .groupBy("id", "item_id", "n_item")
        .agg(F.count_distinct("hash").alias("n_shared"))
        .where(F.col("n_shared") * 100 >= F.col("n_item") * threshold_percent)
        .select(F.col("id").alias(id_col), "item_id", "n_shared", "n_item")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents that contain no item, with all their columns, also those named like columns used inside.

    Rows of one doc_id are one document and go together, null ids among them; documents without words
    stay.  Without items all rows stay; an empty table stays empty.
    """
    bad = free_name(docs, "bad_id")
    hits = small(stage(contained_items(docs, items, id_col).select(F.col(id_col).alias(bad)).distinct(), "contaminated"))
    return docs.join(hits, docs[id_col].eqNullSafe(hits[bad]), "left_anti")


@query(
    "op4_decontamination",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
g(k, w) AS (SELECT ['d', doc_id::VARCHAR], w FROM d UNION ALL SELECT ['i', item_id::VARCHAR], w FROM i),
s AS (SELECT DISTINCT k[1] AS kind, k[2]::BIGINT AS id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
    ELSE array_to_string(w[p:p + 4], ' ') END AS gram
  FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM g WHERE len(w) > 0)),
n AS (SELECT id AS item_id, count(*) AS n_item FROM s WHERE kind = 'i' GROUP BY id)
SELECT a.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM s a JOIN s b ON a.gram = b.gram AND a.kind = 'd' AND b.kind = 'i' JOIN n ON n.item_id = b.id
GROUP BY a.id, b.id HAVING count(*) * 100 >= any_value(n_item) * 80""",
)
def op4_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contained_items(docs, table(spark, sf_dir, "benchmark"))
