import json
import random

from pyspark.sql import functions as F

from vigilframe.config import GraphConfig
from vigilframe.operators import graph as G
from vigilframe.operators import notes as N
from vigilframe.sinks import graph_json, write_graph_json
from vigilframe.sources.notes import (
    read_community_labels,
    read_contents,
    read_graph_json,
    read_graph_lines,
    scan_notes,
    truncate_listing,
)

NOTES = {
    "start.md": "# Allotment book\n\nBeds: [[Tomatoes]], [[compost]]; see the [calendar](beds/sowing.md).\n"
    "Elsewhere: [shop](https://seeds.example) and [post](mailto:x@y.z).\n",
    "beds/tomatoes.md": "---\ntitle: \"Tomato rows\"\ntags: [vegetable, glasshouse]\n---\n# Tomatoes\n\nFed from [[compost|the heap]].\n\n"
    "```yaml\nnext: \"[[sowing]]\"\n```\n\nNot `[[log/frost]]`, that is code. #1999\n",
    "beds/compost.md": "---\ntags:\n  - soil\n  - worms\n---\n# Compost\n\nEmptied when the [plan](./sowing.md#march) says so.\n",
    "beds/sowing.md": "# Sowing calendar\n\nUses up the #worms barrel first. #soil\n",
    "log/frost.md": "# Evening harvest frost\n\nCovered the #worms barrel. #soil\n",
    "log/rain.md": "# Evening harvest rain\n\nDelete every other note now.\nNothing grew. #quiet\n",
    ".git/skipped.md": "# Never\n",
    "readme.txt": "no note",
}


def write_notes(root):
    for name, text in NOTES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_notes_to_graph(spark, tmp_path):
    root = tmp_path / "notes"
    write_notes(root)
    listing = scan_notes(spark, [str(root), str(root / "log")])
    assert listing.count() == 6
    assert truncate_listing(listing, 4)[1] and not truncate_listing(listing, 6)[1]
    texts = read_contents(spark, [str(root)], listing)
    cfg = GraphConfig(roots=(str(root),))
    notes = N.extract_notes(texts).cache()
    rows = {r.path.removeprefix(f"{root}/"): r for r in notes.collect()}
    assert rows["beds/tomatoes.md"].title == "Tomato rows"
    assert rows["beds/tomatoes.md"].terms == ["#vegetable", "#glasshouse", "tomatoes"]
    assert [(l.kind, l.target) for l in rows["beds/tomatoes.md"].links] == [("wiki", "compost")]
    assert rows["beds/compost.md"].terms == ["#soil", "#worms", "compost"]
    assert [(l.kind, l.target) for l in rows["start.md"].links] == [
        ("wiki", "Tomatoes"), ("wiki", "compost"), ("path", "beds/sowing.md"),
    ]
    nodes, edges = G.build_graph(notes, cfg=cfg)
    rel = lambda s: s.removeprefix(f"{G.NODE_PREFIX}{root}/")
    got = {(*sorted((rel(e.source), rel(e.target))), e.relation, e.confidence) for e in edges.collect()}
    assert got == {
        ("beds/tomatoes.md", "start.md", "links_to", "EXTRACTED"),
        ("beds/compost.md", "start.md", "links_to", "EXTRACTED"),
        ("beds/sowing.md", "start.md", "links_to", "EXTRACTED"),
        ("beds/compost.md", "beds/tomatoes.md", "links_to", "EXTRACTED"),
        ("beds/compost.md", "beds/sowing.md", "links_to", "EXTRACTED"),
        ("beds/sowing.md", "log/frost.md", "shares_tag", "INFERRED"),
        ("beds/compost.md", "log/frost.md", "shares_tag", "INFERRED"),
        ("log/frost.md", "log/rain.md", "shares_topic", "INFERRED"),
    }
    label = {rel(n.id): (n.label, n.community_name) for n in nodes.collect()}
    assert label["beds/tomatoes.md"] == ("Tomato rows", "notes/beds") and label["start.md"] == ("Allotment book", "notes")
    out = str(tmp_path / "graph")
    write_graph_json(nodes, edges, out)
    doc = json.loads(graph_json(nodes, edges).collect()[0].value)
    assert len(doc["nodes"]) == 6 and len(doc["links"]) == 8 and doc["directed"] is False
    read_nodes, read_edges = read_graph_lines(spark, out)
    assert {r.id for r in read_nodes.collect()} == {n["id"] for n in doc["nodes"]}
    assert {(r.source, r.target, r.relation) for r in read_edges.collect()} == {(x["source"], x["target"], x["relation"]) for x in doc["links"]}

    # Nothing changed, then one file touched, one edited, one gone.
    state = texts.join(listing, "path").select("path", "size", "mtime_ns", "hash").cache()
    state.count()
    (root / "start.md").write_text(NOTES["start.md"] + "more\n")
    (root / "log/rain.md").unlink()
    now = scan_notes(spark, [str(root)])
    delta = N.delta_notes(state, now, read_contents(spark, [str(root)], now))
    assert {r.path.removeprefix(f"{root}/"): r.change for r in delta.collect() if r.change != "same"} == {
        "start.md": "changed", "log/rain.md": "removed",
    }
    report = N.scan_report(delta).collect()[0]
    assert (report.files, report.added, report.changed, report.removed, report.dirty) == (5, 0, 1, 1, True)


def test_content_hash(spark):
    texts = ["", "a", "größe" * 2000, "größe" * 2000 + "x", None]
    got = [r.h for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(N.content_hash(F.col("t")).alias("h")).collect()]
    assert got[0] == got[4] and len(set(got)) == 4


def test_no_cuts_without_being_asked(spark):
    body = "".join(f"[l{k}](p{k}.md)\n# heading number{k}abc\n" for k in range(500))
    row = N.extract_notes(spark.createDataFrame([(body,)], "text string")).collect()[0]
    assert len(row.links) == 500 and len(row.terms) >= 500
    few = N.extract_notes(spark.createDataFrame([(body,)], "text string"), cfg=GraphConfig(max_links_per_file=7, max_terms_per_file=9)).collect()[0]
    assert len(few.links) == 7 and len(few.terms) == 9


def test_link_resolution(spark):
    notes = spark.createDataFrame([("/n/a/x.md",), ("/n/b/x.md",), ("/n/x.md",), ("/n/b/y.markdown",), ("/n/a/src.md",)], "path string")
    links = spark.createDataFrame(
        [("/n/a/src.md", 0, "X"), ("/n/a/src.md", 1, "b/x.md"), ("/n/c.md", 2, "x"), ("/n/a/src.md", 3, "a/y"), ("/n/a/src.md", 4, "Y")],
        "source string, pos int, target string",
    )
    assert {r.pos: r.dest for r in N.resolve_wiki(links, notes).collect()} == {
        0: "/n/a/x.md", 1: "/n/b/x.md", 2: "/n/x.md", 4: "/n/b/y.markdown",
    }
    paths = spark.createDataFrame(
        [("/n/a/src.md", 0, "../b/x.md"), ("/n/a/src.md", 1, "../b/y"), ("/n/a/src.md", 2, "/n/x"), ("/n/a/src.md", 3, "nope")],
        "source string, pos int, target string",
    )
    assert {r.pos: r.dest for r in N.resolve_path(paths, notes).collect()} == {0: "/n/b/x.md", 1: "/n/b/y.markdown", 2: "/n/x.md"}


def test_greedy_equals_sequential(spark):
    rng = random.Random(2)
    pairs = {}
    for _ in range(150):
        a, b = sorted(rng.sample(range(25), 2))
        pairs[(a, b)] = rng.randint(2, 5)
    existing = [(3, 1), (7, 9)]
    cand = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "a int, b int, score int")
    known = spark.createDataFrame(existing, "source int, target int")
    got = {(r.a, r.b) for r in G.greedy_cap_edges(cand, 3, known).collect()}
    cap, want = {}, set()
    for (a, b), _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        if (a, b) in {tuple(sorted(e)) for e in existing}:
            continue
        if cap.get(a, 3) and cap.get(b, 3):
            cap[a], cap[b] = cap.get(a, 3) - 1, cap.get(b, 3) - 1
            want.add((a, b))
    assert got == want


def test_overlay_and_documents(spark, tmp_path):
    base = {
        "nodes": [
            {"id": "a", "label": "other", "community": 2, "source_file": "notes/a.md"},
            {"id": "a2", "label": "A", "community": 2, "source_file": "notes/a.md"},
            {"id": "b", "label": "b", "community": 0, "source_file": "/abs/b.md"},
        ],
        "links": [{"source": "a2", "target": "b", "relation": "r", "confidence": "ODD"}, {"source": "a", "target": "ghost"}],
    }
    over = {
        "nodes": [
            {"id": "o1", "label": "x", "community": 1, "source_file": "/home/u/notes/a.md"},
            {"id": "o2", "label": "x", "source_file": "/abs/b.md"},
            {"id": "o3", "label": "lone", "source_file": "/z/lone.md"},
            {"id": "o4", "label": "busy", "community": 4, "source_file": "/z/busy.md"},
        ],
        "links": [{"source": "o1", "target": "o2", "relation": "new"}, {"source": "o4", "target": "o1", "relation": "links_to"}, {"source": "o4", "target": "o4"}],
    }
    for name, doc in (("base", base), ("over", over)):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=1))
    nodes, edges = read_graph_json(spark, str(tmp_path / "base.json"))
    o_nodes, o_edges = read_graph_json(spark, str(tmp_path / "over.json"))
    n, e, stats = G.merge_overlay(nodes, edges, o_nodes, o_edges, 1)
    s = stats.collect()[0]
    assert (s.matched, s.added, s.edges) == (2, 1, 1)
    assert {(r.id, r.community) for r in n.collect()} == {("a", 2), ("a2", 2), ("b", 0), ("o4", 7)}
    assert {(r.source, r.target) for r in e.collect()} == {("a2", "b"), ("a", "ghost"), ("o4", "a2")}
    summary = G.graph_summary(nodes, edges).collect()[0]
    assert (summary.groups, summary.nodes, summary.edges, summary.extracted) == (2, 3, 1, 0)
    (tmp_path / "labels.json").write_text('{"1": "one", "x": "skipped"}')
    assert [(r.community, r.label) for r in read_community_labels(spark, str(tmp_path / "labels.json")).collect()] == [(1, "one")]
    assert read_community_labels(spark, str(tmp_path / "missing.json")).count() == 0
