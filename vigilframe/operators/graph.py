"""Link graphs: shared terms, greedy capacity, building, merging and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilframe.config import GraphConfig
from vigilframe.functions import file_name, file_stem, sanitize_relation
from vigilframe.operators.ordered import CHUNK, numbered_by, prefix_sums, stage, top_n_per_group, with_chunks

NODE_PREFIX = "note:"


def _pair(a: str, b: str) -> tuple[Column, Column]:
    return F.least(F.col(a), F.col(b)).alias("a"), F.greatest(F.col(a), F.col(b)).alias("b")


# --- building ----------------------------------------------------------------------------------
def term_pairs(
    terms: DataFrame, max_docs: int = 20, min_score: int = 2, doc: str = "path", term: str = "term"
) -> DataFrame:
    """Pairs of documents sharing rare terms: a < b, ``score`` (tag 2, word 1), ``tag_shared``.

    Terms of fewer than 2 or more than ``max_docs`` documents are dropped before any pair exists
    (that is the definition, and it bounds the pairs of a term to max_docs squared / 2).
    """
    uses = terms.select(F.col(doc).alias("d"), F.col(term).alias("t")).distinct()
    rare = uses.groupBy("t").agg(F.count(F.lit(1)).alias("_df")).where(F.col("_df").between(2, max_docs))
    kept = uses.join(rare.select("t"), "t")
    # One list of at most max_docs documents per term instead of a self join.
    lists = kept.groupBy("t").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    pairs = (
        lists.select("t", "ds", F.posexplode("ds").alias("i", "a"))
        .select("t", "a", F.explode(F.slice("ds", F.col("i") + 2, max_docs)).alias("b"))
    )
    is_tag = F.col("t").startswith("#")
    return (
        pairs.groupBy("a", "b")
        .agg(
            F.sum(F.when(is_tag, 2).otherwise(1)).alias("score"),
            F.max(is_tag).alias("tag_shared"),
        )
        .where(F.col("score") >= min_score)
    )


def greedy_cap_edges(
    candidates: DataFrame, cap: int = 5, existing: DataFrame | None = None
) -> DataFrame:
    """Take pairs by (score desc, a, b) while both ends have capacity left; same result as one by one.

    Per round every pair that is among the best ``remaining`` of both its ends is accepted: no
    better pair can take its place.  Pairs that already have an edge are removed first and use no
    capacity.  Each round's state is written to the shared checkpoint folder.
    """
    live = candidates.select("a", "b", *[c for c in candidates.columns if c not in ("a", "b")])
    if existing is not None:
        pairs = existing.select(*_pair("source", "target")).distinct()
        live = live.join(pairs, ["a", "b"], "left_anti")
    live = stage(live.withColumns({"_ra": F.lit(cap), "_rb": F.lit(cap)}), "greedy")
    columns = [c for c in live.columns if c not in ("_ra", "_rb")]
    accepted: list[DataFrame] = []
    while True:
        ends = live.select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("n"), F.col("_ra").alias("left")),
                    F.struct(F.col("b").alias("n"), F.col("_rb").alias("left")),
                )
            ).alias("e"),
            "score", "a", "b",
        ).select("e.n", "e.left", "score", "a", "b")
        best = Window.partitionBy("n").orderBy(F.col("score").desc(), "a", "b")
        good = (
            ends.withColumn("_r", F.row_number().over(best))
            .where((F.col("_r") <= cap) & (F.col("_r") <= F.col("left")))
            .groupBy("a", "b")
            .agg(F.count(F.lit(1)).alias("_ok"))
            .where(F.col("_ok") == 2)
            .select("a", "b", F.lit(True).alias("_take"))
        )
        # The only table written per round: this round's pairs with what was taken.
        marked = stage(live.join(good, ["a", "b"], "left"), "greedy")
        taken = marked.where(F.col("_take"))
        if taken.isEmpty():
            break
        accepted.append(taken.select(*columns))
        used = (
            taken.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("_u"))
        )
        live = marked.where(F.col("_take").isNull()).drop("_take")
        for end, left in (("a", "_ra"), ("b", "_rb")):
            live = (
                live.join(used.select(F.col("n").alias(end), "_u"), end, "left")
                .withColumn(left, F.col(left) - F.coalesce("_u", F.lit(0)))
                .drop("_u")
            )
        live = live.where((F.col("_ra") > 0) & (F.col("_rb") > 0))
    out = live.select(*columns).limit(0) if not accepted else accepted[0]
    for part in accepted[1:]:
        out = out.unionByName(part)
    return out


def term_edges(pairs: DataFrame) -> DataFrame:
    """Accepted term pairs as edges."""
    return pairs.select(
        F.col("a").alias("source"),
        F.col("b").alias("target"),
        F.when(F.col("tag_shared"), F.lit("shares_tag")).otherwise(F.lit("shares_topic")).alias("relation"),
        F.lit("INFERRED").alias("confidence"),
        F.lit("terms").alias("origin"),
        (-F.col("score")).cast("bigint").alias("pos"),
    )


def union_edges(
    links: DataFrame, external: DataFrame | None, terms: DataFrame | None, max_edges: int | None = None
) -> DataFrame:
    """One edge per unordered pair, by priority links > external > terms; all of them unless ``max_edges`` is given.

    Inputs: source, target, relation, confidence, origin, pos (order within the source).
    """
    ranked = links.withColumn("_p", F.lit(0))
    for p, df in ((1, external), (2, terms)):
        if df is not None:
            ranked = ranked.unionByName(df.withColumn("_p", F.lit(p)))
    # Links and external edges come in order of (source, position), terms in order of score.
    order = F.when(F.col("_p") < 2, F.struct(F.col("_p"), F.lit(0).cast("bigint").alias("s"), F.col("source").alias("x"), F.lit("").alias("y"), F.col("pos").alias("q"))).otherwise(
        F.struct(F.col("_p"), F.col("pos").alias("s"), F.col("source").alias("x"), F.col("target").alias("y"), F.lit(0).cast("bigint").alias("q"))
    )
    keyed = ranked.where(F.col("source") != F.col("target")).withColumn("_o", order)
    a, b = _pair("source", "target")
    first = (
        keyed.groupBy(a, b)
        .agg(F.min_by(F.struct("source", "target", "relation", "confidence", "origin"), "_o").alias("e"), F.min("_o").alias("_o"))
    )
    if max_edges is not None:
        first = first.orderBy("_o").limit(max_edges)
    return first.select("e.*")


def communities(notes: DataFrame, roots: tuple[str, ...] = ()) -> DataFrame:
    """Add ``community_name`` and ``community`` (rank of the name).

    Longest matching root; name is root/first directory, else the root's name; without a root the
    parent directory.  ``roots`` is configuration, so the longest match is one expression.
    """
    path = F.col("path")
    name = F.when(F.lit(False), path)
    for root in sorted((r.rstrip("/") for r in roots), key=lambda r: (-r.count("/"), r)):
        rest = F.substring(path, F.lit(len(root) + 2), F.length(path))
        base = root.rsplit("/", 1)[-1] or root
        name = name.when(
            path.startswith(root + "/") & rest.contains("/"),
            F.concat(F.lit(base + "/"), F.element_at(F.split(rest, "/"), 1)),
        ).when(path.startswith(root + "/") | (path == root), F.lit(base))
    parent = F.regexp_replace(path, r"/?[^/]*\z", "")
    named = notes.withColumn("community_name", name.otherwise(parent))
    ids = numbered_by(named.select("community_name").distinct(), ["community_name"], "community")
    return named.join(ids, "community_name")


def build_nodes(notes: DataFrame, roots: tuple[str, ...] = ()) -> DataFrame:
    """id, label (title or file stem), file_type, community, community_name, source_file."""
    return communities(notes, roots).select(
        F.concat(F.lit(NODE_PREFIX), F.col("path")).alias("id"),
        F.coalesce("title", file_stem(F.col("path"))).alias("label"),
        F.lit("document").alias("file_type"),
        "community",
        "community_name",
        F.col("path").alias("source_file"),
    )


def build_graph(
    notes: DataFrame, external: DataFrame | None = None, cfg: GraphConfig = GraphConfig()
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of extracted notes (path, title, links, terms).

    ``external``: proposed edges (source, target, relation, pos) between note paths.
    """
    from vigilframe.operators.notes import link_edges

    notes = stage(notes.select("path", "title", "links", "terms"), "notes")
    links = stage(link_edges(notes, cfg), "links")
    if external is not None:
        paths = notes.select("path")
        external = (
            external.join(paths.withColumnRenamed("path", "target"), "target", "left_semi")
            .join(paths.withColumnRenamed("path", "source"), "source", "left_semi")
            .select(
                "source", "target", "relation", F.lit("INFERRED").alias("confidence"),
                F.lit("llm").alias("origin"), F.col("pos").cast("bigint").alias("pos"),
            )
        )
    pairs = term_pairs(
        notes.select("path", F.explode("terms").alias("term")), cfg.max_term_docs, cfg.min_shared_score
    )
    known = links.select("source", "target")
    if external is not None:
        known = known.unionByName(external.select("source", "target"))
    inferred = term_edges(greedy_cap_edges(pairs, cfg.max_inferred_per_file, known))
    edges = union_edges(links, external, inferred, cfg.max_edges)
    prefixed = edges.withColumns(
        {
            "source": F.concat(F.lit(NODE_PREFIX), F.col("source")),
            "target": F.concat(F.lit(NODE_PREFIX), F.col("target")),
        }
    )
    return build_nodes(notes, cfg.roots), prefixed


def validate_candidate_edges(
    raw: DataFrame, ids: DataFrame, batch: DataFrame, max_total: int | None = None, max_per_source: int | None = None
) -> DataFrame:
    """Check proposed edges (pos, source, target, relation) against known ids.

    ``ids``: id, path; ``batch``: id.  Adds ``source_path``, ``target_path``, cleaned ``relation``
    and ``accepted``: both ends known, source in the batch, no self edge, first of its pair and, if
    given, among the first ``max_per_source`` of its source and ``max_total`` in all.
    """
    known = ids.select("id", "path")
    up = raw.withColumns({"_s": F.upper("source"), "_t": F.upper("target")})
    joined = (
        up.join(known.select(F.col("id").alias("_s"), F.col("path").alias("source_path")), "_s", "left")
        .join(known.select(F.col("id").alias("_t"), F.col("path").alias("target_path")), "_t", "left")
        .join(batch.select(F.col("id").alias("_s"), F.lit(True).alias("_in")).distinct(), "_s", "left")
    )
    valid = (
        F.col("source_path").isNotNull() & F.col("target_path").isNotNull() & F.col("_in").isNotNull()
        & (F.col("_s") != F.col("_t"))
    )
    firsts = joined.where(valid).groupBy("source_path", "target_path").agg(F.min("pos").alias("pos"))
    if max_per_source is not None:
        firsts = top_n_per_group(firsts, ["source_path"], [F.col("pos")], max_per_source, ["pos"]).drop("rank")
    if max_total is not None:
        firsts = firsts.orderBy("pos").limit(max_total)
    winners = firsts.select("pos", F.lit(True).alias("_win"))
    return (
        joined.join(winners, "pos", "left")
        .withColumn("accepted", F.coalesce("_win", F.lit(False)))
        .withColumn("relation", sanitize_relation(F.col("relation")))
        .drop("_s", "_t", "_in", "_win")
    )


# --- merging -----------------------------------------------------------------------------------
def merge_overlay(
    nodes: DataFrame, edges: DataFrame, o_nodes: DataFrame, o_edges: DataFrame, max_added: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge an overlay graph into a base graph: (nodes, edges, stats).

    Nodes carry ``pos`` (document order).  An overlay node is the base node with the same path (or
    whose relative path it ends with), preferring a label equal to the file name or stem, else the
    first.  The others are added, by overlay degree only the first ``max_added`` if that is given; a pair
    keeps its base edge.
    """
    cand = nodes.select(
        F.col("id").alias("base_id"), F.col("pos").alias("base_pos"), F.lower("label").alias("_label"),
        F.explode(F.array_distinct(F.filter(F.array("source_file", "id"), lambda c: c.isNotNull()))).alias("_cand"),
    ).withColumn("_name", file_name(F.col("_cand"))).where(F.col("_name") != "")
    over = o_nodes.withColumn("_path", F.coalesce("source_file", F.col("id"))).withColumn(
        "_name", file_name(F.col("_path"))
    )
    # A relative candidate must be a suffix of the path, so candidates are joined on each suffix.
    segs = F.split("_path", "/")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(segs)), lambda i: F.array_join(F.slice(segs, i, F.size(segs)), "/")
    )
    probes = over.where(F.col("_name") != "").select(
        "id", "_path", "_name", F.explode(F.array_distinct(F.concat(F.array("_path"), suffixes))).alias("_cand")
    )
    hits = probes.join(cand.drop("_name"), "_cand").where(
        (F.col("_cand") == F.col("_path")) | ~F.col("_cand").startswith("/")
    )
    stem = F.regexp_replace("_name", r"^(.+)\.[^.]*\z", "$1")
    preferred = (F.col("_label") == F.lower("_name")) | (F.col("_label") == F.lower(stem))
    matched = hits.groupBy("id").agg(
        F.min_by("base_id", F.struct((~preferred).alias("p"), "base_pos")).alias("new_id")
    )
    degree = (
        o_edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("_deg"))
    )
    rest = (
        o_nodes.join(matched.select("id"), "id", "left_anti")
        .join(nodes.select("id"), "id", "left_anti")
        .join(degree, "id", "left")
        .withColumn("_deg", F.coalesce("_deg", F.lit(0)))
    )
    # Two nodes with one id: the one that comes first is added.
    rest = rest.groupBy("id").agg(F.max_by(F.struct(*rest.columns), F.struct("_deg", (-F.col("pos")).alias("p"))).alias("_n")).select("_n.*")
    if max_added is not None:
        rest = rest.orderBy(F.col("_deg").desc(), "pos").limit(max_added)
    added = stage(rest.drop("_deg"), "added")
    offset = nodes.agg(F.coalesce(F.max("community") + 1, F.lit(0)).alias("_off"), F.coalesce(F.max("pos") + 1, F.lit(0)).alias("_poff"))
    shifted = added.crossJoin(F.broadcast(offset)).select(
        *[c for c in added.columns if c not in ("community", "pos")],
        (F.col("community") + F.col("_off")).alias("community"),
        (F.col("pos") + F.col("_poff")).alias("pos"),
    )
    all_nodes = nodes.unionByName(shifted, allowMissingColumns=True)
    id_map = matched.unionByName(added.select("id", F.col("id").alias("new_id")))
    base_pairs = edges.select(*_pair("source", "target")).distinct()
    moved = (
        o_edges.join(id_map.select(F.col("id").alias("source"), F.col("new_id").alias("_s")), "source")
        .join(id_map.select(F.col("id").alias("target"), F.col("new_id").alias("_t")), "target")
        .where(F.col("_s") != F.col("_t"))
        .drop("source", "target")
        .withColumnsRenamed({"_s": "source", "_t": "target"})
    )
    a, b = _pair("source", "target")
    firsts = (
        moved.groupBy(a, b).agg(F.min_by(F.struct(*moved.columns), "pos").alias("_e"))
        .join(base_pairs, ["a", "b"], "left_anti")
        .select("_e.*")
    )
    all_edges = edges.unionByName(firsts, allowMissingColumns=True)
    counts = [
        matched.agg(F.count(F.lit(1)).alias("matched")),
        added.agg(F.count(F.lit(1)).alias("added")),
        firsts.agg(F.count(F.lit(1)).alias("edges")),
    ]
    stats = counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # three one-row aggregates
    return all_nodes, all_edges, stats


def union_overlay(nodes: DataFrame, o_nodes: DataFrame) -> DataFrame:
    """Base nodes plus overlay nodes with new ids."""
    return nodes.unionByName(o_nodes.join(nodes.select("id"), "id", "left_anti"), allowMissingColumns=True)


# --- statistics --------------------------------------------------------------------------------
def drop_dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(
        ids.withColumnRenamed("id", "target"), "target", "left_semi"
    )


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected degree per node (0 included) and the graph's ``max_degree`` (at least 1)."""
    ends = drop_dangling_edges(nodes, edges).select(F.explode(F.array("source", "target")).alias("id"))
    counts = ends.groupBy("id").agg(F.count(F.lit(1)).alias("_d"))
    out = nodes.select("id").join(counts, "id", "left").select(
        "id", F.coalesce("_d", F.lit(0).cast("bigint")).alias("degree")
    )
    top = counts.agg(F.greatest(F.coalesce(F.max("_d"), F.lit(1)), F.lit(1)).cast("bigint").alias("max_degree"))
    return out.crossJoin(F.broadcast(top))  # one-row aggregate


def group_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between different communities per unordered pair: ``edges`` and ``extracted``."""
    of = nodes.select("id", "community")
    ends = edges.join(of.select(F.col("id").alias("source"), F.col("community").alias("ga")), "source").join(
        of.select(F.col("id").alias("target"), F.col("community").alias("gb")), "target"
    )
    return (
        ends.where(F.col("ga") != F.col("gb"))
        .groupBy(F.least("ga", "gb").alias("group_a"), F.greatest("ga", "gb").alias("group_b"))
        .agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("confidence") == "EXTRACTED").alias("extracted"))
    )


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """groups, nodes, edges, extracted, inferred."""
    n = nodes.groupBy("community").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("_n"), F.lit(0)).alias("nodes")
    )
    e = drop_dangling_edges(nodes, edges).agg(
        F.count(F.lit(1)).alias("edges"),
        F.count_if(F.col("confidence") == "EXTRACTED").alias("extracted"),
        F.count_if(F.col("confidence") == "INFERRED").alias("inferred"),
    )
    return n.crossJoin(e)  # two one-row aggregates


def group_summary(nodes: DataFrame) -> DataFrame:
    """Members and sub-directories per community."""
    return nodes.groupBy("community").agg(
        F.count(F.lit(1)).alias("members"), F.count_if(F.col("file_type") == "dir").alias("directories")
    )


def group_members(nodes: DataFrame, edges: DataFrame, n: int = 200) -> DataFrame:
    """First ``n`` members per community: directories first, then by degree (``rank``)."""
    ranked = nodes.join(degree(nodes, edges).select("id", "degree"), "id")
    order = [(F.col("file_type") != "dir").asc(), F.col("degree").desc(), F.col("id")]
    return top_n_per_group(ranked, ["community"], order, n, ["id"])


def neighbors(nodes: DataFrame, edges: DataFrame, node_ids: DataFrame | None = None) -> DataFrame:
    """Connections per node: id, direction (out/in), relation, other, other_label, confidence.

    ``node_ids`` (id) restricts the result; without it all nodes are listed.
    """
    def side(me: str, other: str, name: str) -> DataFrame:
        return edges.select(
            F.col(me).alias("id"), F.lit(name).alias("direction"), "relation", F.col(other).alias("other"), "confidence"
        )

    # A self edge is listed once, as outgoing.
    both = side("source", "target", "out").unionByName(
        side("target", "source", "in").where(F.col("id") != F.col("other"))
    )
    if node_ids is not None:
        both = both.join(node_ids.select("id"), "id", "left_semi")
    labels = nodes.select(F.col("id").alias("other"), F.col("label").alias("other_label"))
    return both.join(nodes.select("id"), "id", "left_semi").join(labels, "other")


def _numbered(df: DataFrame, pos: str, name: str) -> DataFrame:
    """Dense 0-based number by the unique bigint ``pos``."""
    keyed = df.withColumn("_one", F.lit(0))
    chunked = with_chunks(keyed, ["_one"], ts=pos, seq=pos, slot_us=1_000_000)
    out = prefix_sums(chunked, ["_one"], [pos], {name: F.lit(1).cast("bigint")})
    return out.withColumn(name, F.col(name) - 1).drop("_one", CHUNK)


def compact_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, nodes, links) with small integer indices; dangling links dropped.

    Nodes and edges carry ``pos``.  Groups are numbered by first appearance, nodes by position
    (running counts over stretches of positions, see ``ordered``).
    """
    label = F.coalesce(
        F.nullif("community_name", F.lit("")), F.nullif(F.col("community").cast("string"), F.lit("0")), F.lit("no group")
    )
    named = nodes.withColumn("group", label)
    groups = named.groupBy("group").agg(F.min("pos").alias("_first"))
    groups = _numbered(groups, "_first", "group_index").drop("_first")
    indexed = _numbered(named, "pos", "node_index").join(groups, "group")
    shown = indexed.select("node_index", "id", F.coalesce(F.nullif("label", F.lit("")), F.col("id")).alias("label"), "group_index")
    at = shown.select("id", "node_index")
    links = (
        edges.join(at.select(F.col("id").alias("source"), F.col("node_index").alias("source_index")), "source")
        .join(at.select(F.col("id").alias("target"), F.col("node_index").alias("target_index")), "target")
        .select("pos", "source_index", "target_index", (F.col("confidence") == "EXTRACTED").cast("int").alias("extracted"))
    )
    return groups, shown, links
