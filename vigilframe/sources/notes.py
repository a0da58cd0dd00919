"""Note folders and graph documents."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilframe.config import GraphConfig
from vigilframe.functions import file_ext, has_ext

log = logging.getLogger(__name__)


def _listed(path: Column, roots: list[str], cfg: GraphConfig) -> Column:
    """Extension known (any case) and no excluded or hidden directory below the root."""
    known = has_ext(path) & F.lower(file_ext(path)).isin(*[e.lower() for e in cfg.extensions])
    inner = path
    for root in roots:
        cut = root.rstrip("/") + "/"
        inner = F.when(path.startswith(cut), F.substring(path, F.lit(len(cut) + 1), F.length(path))).otherwise(inner)
    dirs = F.slice(F.split(inner, "/"), 1, F.size(F.split(inner, "/")) - 1)
    blocked = F.exists(
        dirs,
        lambda d: d.isin(*cfg.exclude_dirs) | (d.startswith(".") if cfg.skip_hidden else F.lit(False)),
    )
    return known & ~blocked


def scan_notes(
    spark: SparkSession, roots: list[str], cfg: GraphConfig = GraphConfig(), content: bool = False,
    streaming: bool = False,
) -> DataFrame:
    """Recursive listing: path, root, size, mtime_ns (and ``content`` on request), one row per path.

    The content column is only read when asked for; ``read_contents`` reads it for some paths.
    The listing is cut at ``max_files`` by ``truncate_listing``, not here.
    """
    reader = spark.readStream if streaming else spark.read
    parts = None
    for i, root in enumerate(roots):
        df = reader.format("binaryFile").option("recursiveFileLookup", True).load(root)
        path = F.regexp_replace("path", r"^file:/*", "/")
        df = df.select(
            path.alias("path"), F.lit(i).alias("root"), F.col("length").alias("size"),
            (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), *(["content"] if content else []),
        )
        parts = df if parts is None else parts.unionByName(df)
    out = parts.where(_listed(F.col("path"), roots, cfg))
    # Overlapping roots: one row per path.  A stream forgets a version of a file when it is a day old.
    if len(roots) < 2:
        return out
    if not streaming:
        return out.dropDuplicates(["path"])
    stamped = out.withColumn("_at", F.timestamp_micros(F.call_function("div", F.col("mtime_ns"), F.lit(1000).cast("bigint"))))
    return stamped.withWatermark("_at", "1 day").dropDuplicatesWithinWatermark(["path", "mtime_ns"]).drop("_at")


def truncate_listing(listing: DataFrame, max_files: int) -> tuple[DataFrame, bool]:
    """(first ``max_files`` paths in order, truncated?)."""
    truncated = listing.select("path").limit(max_files + 1).count() > max_files
    return (listing.orderBy("path").limit(max_files) if truncated else listing), truncated


def read_contents(
    spark: SparkSession, roots: list[str], paths: DataFrame, cfg: GraphConfig = GraphConfig()
) -> DataFrame:
    """path, text and hash of the wanted ``paths`` only (bad bytes become replacement characters)."""
    from vigilframe.operators.notes import content_hash

    wanted = scan_notes(spark, roots, cfg, content=True).join(paths.select("path"), "path", "left_semi")
    return wanted.select(
        "path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), content_hash(F.col("content")).alias("hash")
    )


_NODE = (
    "id STRING, label STRING, file_type STRING, community BIGINT, community_name STRING, "
    "rationale STRING, source_file STRING"
)
_EDGE = "source STRING, target STRING, relation STRING, confidence STRING"


def read_graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a node-link document (edges under ``links``), with document order ``pos``.

    Relation and confidence are open vocabularies; missing fields take their defaults.
    """
    schema = f"nodes ARRAY<STRUCT<{_NODE.replace(' STRING', ': STRING').replace(' BIGINT', ': BIGINT')}>>, " \
        f"links ARRAY<STRUCT<{_EDGE.replace(' STRING', ': STRING')}>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    nodes = doc.select(F.posexplode("nodes").alias("pos", "n")).select(F.col("pos").cast("bigint"), "n.*")
    edges = doc.select(F.posexplode("links").alias("pos", "e")).select(F.col("pos").cast("bigint"), "e.*")
    return _with_defaults(nodes, edges)


def read_graph_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph of any size that ``write_graph_json`` wrote as JSON lines."""
    return _with_defaults(spark.read.schema(_NODE).json(f"{path}/nodes"), spark.read.schema(f"{_EDGE}, origin STRING").json(f"{path}/links"))


def _with_defaults(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        nodes.withColumns(
            {"community": F.coalesce("community", F.lit(0).cast("bigint")), "label": F.coalesce("label", F.lit("")),
             "file_type": F.coalesce("file_type", F.lit(""))}
        ),
        edges.withColumns(
            {"relation": F.coalesce("relation", F.lit("")), "confidence": F.coalesce("confidence", F.lit(""))}
        ),
    )


def read_community_labels(spark: SparkSession, path: str) -> DataFrame:
    """(community, label) of a JSON object; keys that are no integers are skipped, no file = empty."""
    try:
        text = spark.read.option("wholetext", True).text(path)
    except AnalysisException as err:
        log.info("no community labels at %s: %s", path, err)
        return spark.createDataFrame([], "community bigint, label string")
    return (
        text.select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "label"))
        .select(F.col("k").try_cast("bigint").alias("community"), "label")
        .where(F.col("community").isNotNull())
    )
