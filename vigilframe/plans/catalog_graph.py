"""Link graphs: shared terms of documents, the part-supplier graph, overlays."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.config import GraphConfig
from vigilframe.functions import file_name, file_stem, normalize_path, parent_dir, percent_decode
from vigilframe.operators import graph as G
from vigilframe.operators import notes as N
from vigilframe.operators.ordered import numbered_by, stage
from vigilframe.plans.catalog import query, table, texts
from vigilframe.plans.catalog_text import page_notes

# --- shared terms ------------------------------------------------------------------------------
_WORDS = r"""dw AS (SELECT DISTINCT doc_id AS d, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS t FROM documents),
use AS (SELECT * FROM dw WHERE length(t) >= 4),
rare AS (SELECT t FROM use GROUP BY t HAVING count(*) BETWEEN 2 AND 20),
sc AS (SELECT a.d AS a, b.d AS b, count(*) AS score FROM use a JOIN rare USING (t) JOIN use b ON a.t = b.t AND a.d < b.d GROUP BY ALL)"""


def _doc_terms(spark, d):
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    docs = texts(spark, d, "documents", "doc_id", "text")
    return docs.select(F.col("doc_id").alias("path"), F.explode(words).alias("term")).where(
        F.length("term") >= 4
    )


@query("term_pairs", f"WITH {_WORDS} SELECT a, b, score, false AS tag_shared FROM sc WHERE score >= 2")
def term_pairs(spark, d):
    return G.term_pairs(_doc_terms(spark, d))


@query("greedy_edges")
def greedy_edges(spark, d):
    return G.greedy_cap_edges(G.term_pairs(_doc_terms(spark, d)), 5).select("a", "b", "score")


# --- part-supplier graph -----------------------------------------------------------------------
_GRAPH = """nodes AS (
  SELECT 'p' || p_partkey AS id, p_name AS label, CASE WHEN p_size < 3 THEN 'dir' ELSE 'document' END AS file_type, CAST(p_size AS BIGINT) AS community FROM part
  UNION ALL SELECT 's' || s_suppkey, s_name, 'document', CAST(100 + s_nationkey AS BIGINT) FROM supplier),
edges AS (
  SELECT 'p' || l_partkey AS source, 's' || l_suppkey AS target, 'supplied_by' AS relation,
    CASE WHEN max(l_returnflag) = 'R' THEN 'EXTRACTED' ELSE 'INFERRED' END AS confidence
  FROM lineitem GROUP BY l_partkey, l_suppkey
  UNION ALL SELECT 'o' || o_orderkey, 's1', 'stray', 'INFERRED' FROM orders),
good AS (SELECT e.* FROM edges e SEMI JOIN nodes a ON a.id = e.source SEMI JOIN nodes b ON b.id = e.target),
deg AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM good UNION ALL SELECT target FROM good) GROUP BY id)"""


def _graph(spark, d):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = table(spark, d, "part").select(
        key("p", "p_partkey").alias("id"), F.col("p_name").alias("label"),
        F.when(F.col("p_size") < 3, F.lit("dir")).otherwise(F.lit("document")).alias("file_type"), F.col("p_size").cast("bigint").alias("community"),
    )
    supps = table(spark, d, "supplier").select(
        key("s", "s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit("document").alias("file_type"),
        (F.col("s_nationkey") + 100).cast("bigint").alias("community"),
    )
    items = (
        table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_returnflag").alias("_f"))
        .select(
            key("p", "l_partkey").alias("source"), key("s", "l_suppkey").alias("target"), F.lit("supplied_by").alias("relation"),
            F.when(F.col("_f") == "R", F.lit("EXTRACTED")).otherwise(F.lit("INFERRED")).alias("confidence"),
        )
    )
    strays = table(spark, d, "orders").select(
        key("o", "o_orderkey").alias("source"), F.lit("s1").alias("target"), F.lit("stray").alias("relation"), F.lit("INFERRED").alias("confidence")
    )
    return parts.unionByName(supps), items.unionByName(strays)


@query("graph_dangling_dropped", f"WITH {_GRAPH} SELECT relation, confidence, count(*) AS cnt FROM good GROUP BY ALL")
def graph_dangling_dropped(spark, d):
    return G.drop_dangling_edges(*_graph(spark, d)).groupBy("relation", "confidence").agg(F.count(F.lit(1)).alias("cnt"))


@query(
    "graph_degree",
    f"""WITH {_GRAPH} SELECT n.id, coalesce(degree, 0) AS degree, (SELECT max(degree) FROM deg) AS max_degree
FROM nodes n LEFT JOIN deg USING (id)""",
)
def graph_degree(spark, d):
    return G.degree(*_graph(spark, d))


@query(
    "group_edges",
    f"""WITH {_GRAPH} SELECT least(a.community, b.community) AS group_a, greatest(a.community, b.community) AS group_b,
  count(*) AS n_edges, count(*) FILTER (confidence = 'EXTRACTED') AS extracted
FROM good e JOIN nodes a ON a.id = e.source JOIN nodes b ON b.id = e.target WHERE a.community <> b.community GROUP BY ALL""",
)
def group_edges(spark, d):
    return G.group_edges(*_graph(spark, d)).withColumnRenamed("edges", "n_edges")


@query(
    "graph_summary",
    f"""WITH {_GRAPH} SELECT (SELECT count(DISTINCT community) FROM nodes) AS n_groups, (SELECT count(*) FROM nodes) AS n_nodes,
  count(*) AS n_edges, count(*) FILTER (confidence = 'EXTRACTED') AS extracted, count(*) FILTER (confidence = 'INFERRED') AS inferred FROM good""",
)
def graph_summary(spark, d):
    return G.graph_summary(*_graph(spark, d)).withColumnsRenamed({"groups": "n_groups", "nodes": "n_nodes", "edges": "n_edges"})


@query(
    "group_sizes",
    f"WITH {_GRAPH} SELECT community, count(*) AS members, count(*) FILTER (file_type = 'dir') AS directories FROM nodes GROUP BY ALL",
)
def group_sizes(spark, d):
    return G.group_summary(_graph(spark, d)[0])


@query(
    "group_members",
    f"""WITH {_GRAPH} SELECT community, id, coalesce(degree, 0) AS degree,
  CAST(row_number() OVER (PARTITION BY community ORDER BY file_type <> 'dir', coalesce(degree, 0) DESC, id) AS INTEGER) AS rank
FROM nodes LEFT JOIN deg USING (id) QUALIFY rank <= 20""",
)
def group_members(spark, d):
    return G.group_members(*_graph(spark, d), 20).select("community", "id", "degree", "rank")


@query(
    "graph_neighbors",
    f"""WITH {_GRAPH}, b AS (SELECT source AS id, 'out' AS direction, target AS other, confidence FROM good UNION ALL SELECT target, 'in', source, confidence FROM good)
SELECT b.id, direction, label AS other_label, confidence FROM b JOIN nodes n ON n.id = b.other WHERE starts_with(b.id, 's')""",
)
def graph_neighbors(spark, d):
    nodes, edges = _graph(spark, d)
    me = nodes.where(F.col("id").startswith("s"))
    return G.neighbors(nodes, edges, me).select("id", "direction", "other_label", "confidence")


@query(
    "compact_graph",
    f"""WITH {_GRAPH},
n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS node_index FROM nodes),
g AS (SELECT community, row_number() OVER (ORDER BY min(node_index)) - 1 AS group_index FROM n GROUP BY community)
SELECT CAST(a.node_index AS BIGINT) AS source_index, CAST(b.node_index AS BIGINT) AS target_index, CAST(ga.group_index AS BIGINT) AS source_group,
  CAST(confidence = 'EXTRACTED' AS INTEGER) AS extracted
FROM edges e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target JOIN g ga ON ga.community = a.community""",
)
def compact_graph(spark, d):
    nodes, edges = _graph(spark, d)
    # Position by id: parts and suppliers sort by the text of their key.
    nodes = numbered_by(nodes, ["id"], "pos", 1).withColumn("community_name", F.lit(None).cast("string"))
    edges = edges.withColumn("pos", F.lit(0).cast("bigint"))
    _, shown, links = G.compact_graph(stage(nodes), edges)
    at = shown.select(F.col("node_index").alias("source_index"), F.col("group_index").alias("source_group"))
    return links.join(at, "source_index").select("source_index", "target_index", "source_group", "extracted")


# --- links between notes -----------------------------------------------------------------------
_SITE = r"""site AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS hrefs FROM pages),
home AS (SELECT '/' || regexp_extract(title, '^(\w+)', 1) || '.md' AS path, min(page_id) AS page_id FROM site WHERE regexp_extract(title, '^(\w+)', 1) <> '' GROUP BY 1),
lk AS (SELECT h.path AS source, unnest(s.hrefs) AS href FROM home h JOIN site s USING (page_id)),
res AS (SELECT DISTINCT l.source, t.path AS target FROM lk l JOIN home t ON t.path = regexp_replace(l.href, '[#?].*$', '') || '.md'
  WHERE NOT regexp_matches(l.href, '[)\s>]'))"""


def site_notes(spark, d):
    """One note per leading title word, linking to what its page links to."""
    word = F.regexp_extract("text", r"^# ([0-9A-Za-z_]+)", 1)
    pages = page_notes(spark, d).withColumn("_w", word).where(F.col("_w") != "")
    first = pages.groupBy("_w").agg(F.min("page_id").alias("page_id"), F.min_by("text", "page_id").alias("text"))
    return N.extract_notes(first.select(F.concat(F.lit("/"), F.col("_w"), F.lit(".md")).alias("path"), "text"))


@query("resolved_page_links", f"WITH {_SITE} SELECT source, target FROM res WHERE source <> target")
def resolved_page_links(spark, d):
    return N.link_edges(site_notes(spark, d)).select("source", "target").distinct()


@query(
    "resolved_wiki_links",
    """WITH n AS (SELECT 'w/' || source || '/' || lang || (doc_id % 50) || '-' || (doc_id // 200) || '.md' AS path, 'w/' || source AS dir,
    lang || (doc_id % 50) || '-' || (doc_id // 200) AS stem, doc_id FROM documents),
u AS (SELECT DISTINCT path, dir, stem FROM n),
l AS (SELECT a.doc_id, a.path AS source, a.dir, upper(b.lang) || (b.doc_id % 50) || '-' || (b.doc_id // 200) AS target
  FROM n a JOIN documents b ON b.doc_id = a.doc_id + 1),
c AS (SELECT l.*, u.path AS cand, u.dir AS cdir FROM l JOIN u ON u.stem = lower(l.target))
SELECT source, doc_id AS pos, arg_min(cand, (cdir <> dir, CASE WHEN cdir = dir THEN 0 ELSE length(cand) END, cand)) AS dest FROM c GROUP BY ALL""",
)
def resolved_wiki_links(spark, d):
    docs = table(spark, d, "documents")
    stem = F.concat("lang", (F.col("doc_id") % 50).cast("string"), F.lit("-"), F.floor(F.col("doc_id") / 200).cast("string"))
    path = F.concat(F.lit("w/"), F.col("source"), F.lit("/"), stem, F.lit(".md"))
    notes = docs.select("doc_id", path.alias("path"))
    wanted = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.concat(F.upper("lang"), F.substring(stem, F.length("lang") + 1, F.length(stem))).alias("target"))
    links = notes.join(wanted, "doc_id").select(F.col("path").alias("source"), F.col("doc_id").alias("pos"), "target")
    return N.resolve_wiki(links, notes.select("path").distinct())


@query("note_graph")
def note_graph(spark, d):
    _, edges = G.build_graph(site_notes(spark, d), cfg=GraphConfig(roots=("/",)))
    return edges


@query(
    "note_communities",
    """WITH p AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN '/n/' || source || '/' || doc_id || '.md' WHEN doc_id % 3 = 1 THEN '/n/' || doc_id || '.md'
  ELSE '/other/' || lang || '/' || doc_id || '.md' END AS path, CASE WHEN doc_id % 3 = 0 THEN 'n/' || source WHEN doc_id % 3 = 1 THEN 'n' ELSE '/other/' || lang END AS community_name FROM documents)
SELECT path, community_name, CAST(dense_rank() OVER (ORDER BY community_name) - 1 AS BIGINT) AS community FROM p""",
)
def note_communities(spark, d):
    k = F.col("doc_id") % 3
    doc = F.col("doc_id").cast("string")
    path = (
        F.when(k == 0, F.concat(F.lit("/n/"), F.col("source"), F.lit("/"), doc, F.lit(".md")))
        .when(k == 1, F.concat(F.lit("/n/"), doc, F.lit(".md")))
        .otherwise(F.concat(F.lit("/other/"), F.col("lang"), F.lit("/"), doc, F.lit(".md")))
    )
    return G.communities(table(spark, d, "documents").select(path.alias("path")), ("/n",)).select("path", "community_name", "community")


@query(
    "path_functions",
    r"""WITH u AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS raw, rtrim(regexp_replace(url, '^https?://', ''), '/') AS p FROM pages)
SELECT page_id, p AS path, string_split(p, '/')[-1] AS name, regexp_replace(string_split(p, '/')[-1], '^(.+)\.[^.]*$', '\1') AS stem,
  CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END AS parent, raw || '%zz+%41é' AS back FROM u""",
)
def path_functions(spark, d):
    p = F.regexp_replace("url", "^https?://", "")
    messy = F.regexp_replace(p, "/", "/./x/../")
    coded = F.concat(F.regexp_replace(p, "/", "%2F"), F.lit("%zz+%2541%C3%A9"))
    return table(spark, d, "pages").select(
        "page_id", normalize_path(messy).alias("path"), file_name(p).alias("name"), file_stem(p).alias("stem"),
        parent_dir(p).alias("parent"), percent_decode(coded).alias("back"),
    )


# --- overlay -----------------------------------------------------------------------------------
_OVER = """b AS (SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'DOC' || (doc_id // 2) ELSE 'other' END AS label, CAST(doc_id % 20 AS BIGINT) AS community,
    'src/doc' || (doc_id // 2) || '.md' AS source_file, doc_id AS pos FROM documents),
be AS (SELECT 'd' || doc_id AS source, 'd' || (doc_id + 1) AS target FROM labels),
o AS (SELECT 'n' || page_id AS id, CAST(page_id % 5 AS BIGINT) AS community, '/home/src/doc' || (page_id * 3) || '.md' AS source_file, page_id AS pos FROM pages),
oe AS (SELECT 'n' || page_id AS source, 'n' || ((page_id * 7) % 200) AS target, page_id AS pos FROM pages),
m AS (SELECT o.id, arg_min(b.id, (NOT lower(b.label) = lower(replace(parse_filename(o.source_file), '.md', '')), b.pos)) AS new_id
  FROM o JOIN b ON ends_with(o.source_file, '/' || b.source_file) GROUP BY o.id),
dg AS (SELECT id, count(*) AS deg FROM (SELECT source AS id FROM oe UNION ALL SELECT target FROM oe) GROUP BY id),
ad AS (SELECT o.id, o.community FROM o LEFT JOIN dg USING (id) WHERE o.id NOT IN (SELECT id FROM m)),
im AS (SELECT id, new_id FROM m UNION ALL SELECT id, id FROM ad),
mv AS (SELECT s.new_id AS source, t.new_id AS target, pos FROM oe JOIN im s ON s.id = oe.source JOIN im t ON t.id = oe.target WHERE s.new_id <> t.new_id),
fr AS (SELECT least(source, target) AS a, greatest(source, target) AS b, arg_min(source, pos) AS source, arg_min(target, pos) AS target FROM mv GROUP BY ALL),
ne AS (SELECT source, target FROM fr WHERE NOT EXISTS (SELECT 1 FROM be WHERE least(be.source, be.target) = a AND greatest(be.source, be.target) = b))"""


def _overlay(spark, d):
    docs, pages, labels = (table(spark, d, t) for t in ("documents", "pages", "labels"))
    s = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    doc, page = F.col("doc_id"), F.col("page_id")
    half = F.floor(doc / 2)
    nodes = docs.select(
        s("d", doc).alias("id"), F.when(doc % 2 == 0, s("DOC", half)).otherwise(F.lit("other")).alias("label"),
        (doc % 20).alias("community"), F.concat(s("src/doc", half), F.lit(".md")).alias("source_file"), doc.alias("pos"),
    )
    edges = labels.select(s("d", doc).alias("source"), s("d", doc + 1).alias("target"), doc.alias("pos"))
    o_nodes = pages.select(
        s("n", page).alias("id"), s("page", page).alias("label"), (page % 5).alias("community"),
        F.concat(s("/home/src/doc", page * 3), F.lit(".md")).alias("source_file"), page.alias("pos"),
    )
    o_edges = pages.select(s("n", page).alias("source"), s("n", (page * 7) % 200).alias("target"), page.alias("pos"))
    return G.merge_overlay(nodes, edges, o_nodes, o_edges)


@query(
    "overlay_nodes",
    f"WITH {_OVER} SELECT id, community FROM b UNION ALL SELECT id, community + (SELECT max(community) + 1 FROM b) FROM ad",
)
def overlay_nodes(spark, d):
    return _overlay(spark, d)[0].select("id", "community")


@query("overlay_edges", f"WITH {_OVER} SELECT source, target FROM be UNION ALL SELECT source, target FROM ne")
def overlay_edges(spark, d):
    return _overlay(spark, d)[1].select("source", "target")


@query(
    "overlay_stats",
    f"WITH {_OVER} SELECT (SELECT count(*) FROM m) AS matched, (SELECT count(*) FROM ad) AS added, (SELECT count(*) FROM ne) AS n_edges",
)
def overlay_stats(spark, d):
    return _overlay(spark, d)[2].withColumnRenamed("edges", "n_edges")


@query(
    "removed_notes",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def removed_notes(spark, d):
    out = N.removed_notes(
        table(spark, d, "documents").select(F.col("doc_id").alias("path")), table(spark, d, "labels").select(F.col("doc_id").alias("path"))
    )
    return out.select(F.col("path").alias("doc_id"))
