"""Masking, templates, journal parsing and note extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.config import GraphConfig
from vigilframe.functions import (
    csv_field,
    explain,
    fnv1a64,
    mask_class,
    mask_tokens,
    sanitize_relation,
    short_label,
    slot_hour,
    slot_is_weekend,
    slot_of,
    template_id_hex,
    truncate_sample,
    unit_key,
)
from vigilframe.functions.masking import raw_tokens
from vigilframe.operators import notes as N
from vigilframe.operators import templates as T
from vigilframe.operators.events import canonical_events
from vigilframe.operators.notes import content_hash
from vigilframe.plans.catalog import EV, MSG, events, msg, query, r6, table, texts, wall_us
from vigilframe.sources.journal import parse_journal, split_parse_errors

# White space as Unicode defines it, and word characters, spelled out for an ASCII-minded engine.
_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_W = r"[\p{L}\p{M}\p{Nd}\p{Pc}.-]"


def _sql_mask(src: str) -> str:
    """CTEs ``tok`` (one row per token) and ``masked`` over ``src`` (id columns k1, k2 and ``line``)."""
    p = r"""[,.:;"''()]"""
    return f"""
tok0 AS (SELECT k1, k2, list_filter(regexp_split_to_array(line, '{_WS}'), lambda x: x <> '') AS ts FROM {src}),
tok1 AS (SELECT k1, k2, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM tok0),
tok AS (SELECT *, regexp_extract(t, '^({p}*)((?s:.*?))({p}*)$', 1) AS lead, regexp_extract(t, '^({p}*)((?s:.*?))({p}*)$', 2) AS core,
  regexp_extract(t, '^({p}*)((?s:.*?))({p}*)$', 3) AS trail FROM tok1),
classed AS (SELECT *, CASE
  WHEN regexp_full_match(core, '\\p{{Nd}}{{4}}-\\p{{Nd}}{{2}}-\\p{{Nd}}{{2}}[T ]\\p{{Nd}}{{2}}:\\p{{Nd}}{{2}}:\\p{{Nd}}{{2}}(\\.\\p{{Nd}}+)?(Z|[+-]\\p{{Nd}}{{2}}:?\\p{{Nd}}{{2}})?|\\p{{Nd}}{{2}}:\\p{{Nd}}{{2}}:\\p{{Nd}}{{2}}') THEN 'TIMESTAMP'
  WHEN regexp_full_match(core, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') THEN 'UUID'
  WHEN regexp_full_match(core, '([0-9a-fA-F]{{2}}[:-]){{5}}[0-9a-fA-F]{{2}}') THEN 'MAC'
  WHEN regexp_full_match(core, '[A-Za-z_]{_W}*\\[\\p{{Nd}}+\\]') THEN 'PID'
  WHEN regexp_full_match(core, '([0-9a-fA-F]{{0,4}}:){{2,7}}[0-9a-fA-F]{{0,4}}') THEN 'IPV6'
  WHEN regexp_full_match(core, '(\\p{{Nd}}{{1,3}}\\.){{3}}\\p{{Nd}}{{1,3}}') THEN 'IPV4'
  WHEN regexp_full_match(core, '0[xX][0-9a-fA-F]+') THEN 'HEX'
  WHEN regexp_full_match(core, '/{_W}+(/{_W}*)*') THEN 'PATH'
  WHEN regexp_full_match(core, '\\p{{Nd}}+') THEN 'NUM' END AS cls FROM tok),
masked AS (SELECT k1, k2, string_agg(lead || CASE WHEN cls IS NULL THEN core WHEN cls = 'PID' THEN regexp_extract(core, '^(.*)\\[', 1) || '[<PID>]'
  ELSE '<' || cls || '>' END || trail, ' ' ORDER BY pos) AS masked FROM classed GROUP BY k1, k2)"""


_DOC_LINES = """lines AS (
  SELECT doc_id AS k1, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k2 FROM documents),"""
_MSG_LINES = f"lines AS (SELECT event_id AS k1, 0 AS k2, {MSG} AS line FROM events),"


def _doc_lines(spark, d):
    docs = texts(spark, d, "documents", "doc_id", "text")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query(
    "masked_tokens",
    f"WITH {_DOC_LINES}{_sql_mask('lines')} SELECT k1 AS doc_id, CAST(k2 AS BIGINT) AS line_no, masked FROM masked",
)
def masked_tokens(spark, d):
    out = _doc_lines(spark, d).select(
        "doc_id", (F.col("line_no") + 1).cast("bigint").alias("line_no"), mask_tokens(F.col("line")).alias("_m")
    )
    return out.where(F.size("_m") > 0).select("doc_id", "line_no", F.array_join("_m", " ").alias("masked"))


@query(
    "mask_class_counts",
    f"WITH {_DOC_LINES}{_sql_mask('lines')} SELECT coalesce(cls, 'none') AS class, count(*) AS tokens FROM classed GROUP BY ALL",
)
def mask_class_counts(spark, d):
    t = _doc_lines(spark, d).select(F.explode(raw_tokens(F.col("line"))).alias("t"))
    return t.groupBy(F.coalesce(mask_class(F.col("t")), F.lit("none")).alias("class")).agg(F.count(F.lit(1)).alias("tokens"))


@query(
    "template_counts",
    f"WITH {_MSG_LINES}{_sql_mask('lines')} SELECT masked, count(*) AS cnt, count(*) >= 3 AS frequent FROM masked GROUP BY masked",
)
def template_counts(spark, d):
    e = texts(spark, d, "events", "event_id", "user_id", "event_type", "value")
    t = e.select(F.array_join(mask_tokens(msg()), " ").alias("masked"))
    return t.groupBy("masked").agg(F.count(F.lit(1)).alias("cnt")).withColumn("frequent", F.col("cnt") >= 3)


def _log(spark, d):
    """Document lines as a log: host = language, time = document and line order."""
    docs = _doc_lines(spark, d).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return canonical_events(
        docs.select(
            F.col("lang").alias("hostname"), F.lit(None).cast("string").alias("unit"), F.col("line").alias("message"),
            (F.col("doc_id") * 1_000_000).alias("ts_us"), (F.col("doc_id") * 100_000 + F.col("line_no")).alias("seq"),
        )
    )


def _event_log(spark, d):
    e = table(spark, d, "events")
    return canonical_events(
        e.select(
            (F.col("user_id") % 4).cast("string").alias("hostname"), F.col("event_type").alias("unit"),
            msg().alias("message"), wall_us(F.col("ts")).alias("ts_us"), F.col("event_id").alias("seq"),
        )
    )


@query("template_clusters")
def template_clusters(spark, d):
    out = T.assign_templates(_event_log(spark, d))
    return out.select("hostname", "seq", template_id_hex(F.col("template_id")).alias("template_id"), "template", "is_new")


@query("template_clusters_sequential")
def template_clusters_sequential(spark, d):
    out = T.assign_templates(_event_log(spark, d), mode="sequential")
    return out.select("hostname", "seq", template_id_hex(F.col("template_id")).alias("template_id"), "template", "is_new")


@query("template_registry")
def template_registry(spark, d):
    reg = T.template_registry(T.assign_templates(_event_log(spark, d)))
    return reg.withColumn("tokens", F.array_join("tokens", " "))


@query("document_templates")
def document_templates(spark, d):
    return T.compression_report(T.assign_templates(_log(spark, d)))


_FNV = """list_reduce(list_transform(range(octet_length({b})), lambda i: CAST(('0x' || substr(hex({b}), 2 * i + 1, 2)) AS UHUGEINT)),
  lambda h, x: (xor(h, x) * 1099511628211) % 18446744073709551616, 14695981039346656037::UHUGEINT)"""


@query(
    "stable_hashes",
    f"""WITH k AS (SELECT DISTINCT event_type || '.service' AS unit FROM events UNION SELECT CAST(c_name AS VARCHAR) FROM customer)
SELECT unit, lower(printf('%016x', CAST(CASE WHEN h >= 9223372036854775808 THEN CAST(h AS HUGEINT) - 18446744073709551616 ELSE CAST(h AS HUGEINT) END AS BIGINT))) AS key
FROM (SELECT unit, {_FNV.format(b="encode(unit)")} AS h FROM k)""",
)
def stable_hashes(spark, d):
    units = table(spark, d, "events").select(F.concat("event_type", F.lit(".service")).alias("unit")).union(
        table(spark, d, "customer").select("c_name")
    )
    return units.distinct().select("unit", template_id_hex(unit_key(F.col("unit"))).alias("key"))


@query(
    "time_slots",
    f"""WITH {EV} SELECT seq, CAST((bucket % 24) * 2 + CASE WHEN dayofweek(make_timestamp(ts_us)) IN (0, 6) THEN 1 ELSE 0 END AS INTEGER) AS slot,
  CAST(bucket % 24 AS INTEGER) AS hour, dayofweek(make_timestamp(ts_us)) IN (0, 6) AS weekend FROM ev""",
)
def time_slots(spark, d):
    s = slot_of(F.col("ts_us"))
    return events(spark, d).select(
        "seq", s.alias("slot"), slot_hour(s).cast("int").alias("hour"), slot_is_weekend(s).alias("weekend")
    )


@query(
    "cut_samples",
    """WITH big AS (SELECT doc_id, text FROM documents WHERE octet_length(encode(text)) > 1024),
c AS (SELECT doc_id, unnest(range(1, 1021)) AS n FROM big),
f AS (SELECT doc_id, max(n) AS n FROM c JOIN big USING (doc_id) WHERE octet_length(encode(left(text, n))) <= 1019 AND n <= length(text) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN f.n IS NULL THEN d.text ELSE left(d.text, f.n) || '[…]' END AS sample FROM documents d LEFT JOIN f USING (doc_id)""",
)
def cut_samples(spark, d):
    return table(spark, d, "documents").select("doc_id", truncate_sample(F.col("text")).alias("sample"))


@query(
    "explanations",
    """WITH e AS (SELECT event_id, round(value, 2) AS z, (user_id % 5) / 4.0 AS a, (user_id % 3) / 2.0 AS b, (user_id % 4) / 3.0 AS c,
  CASE WHEN event_id % 2 = 0 THEN -1.5 ELSE 2.5 END AS ez FROM events)
SELECT event_id AS seq, CASE WHEN c >= a AND c >= b AND ez < 0 THEN 'The window has become uniform: a few templates fill it (entropy z -1.5).'
  WHEN c >= a AND c >= b THEN 'The window has become diverse: more templates than normal (entropy z 2.5).'
  WHEN b >= a THEN 'This unit hardly ever writes this template (3.5 bits).' ELSE 'This template comes faster than its history (rate z 4.5).' END AS text FROM e""",
)
def explanations(spark, d):
    u = lambda m: (F.col("user_id") % m) / float(m - 1)
    ez = F.when(F.col("event_id") % 2 == 0, F.lit(-1.5)).otherwise(F.lit(2.5))
    text = explain(F.lit(4.5), F.lit(3.5), ez, u(5), u(3), u(4))
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), text.alias("text"))


@query(
    "display_names",
    r"""SELECT doc_id, line, CASE WHEN t = '' THEN 'related_to' ELSE t END AS relation, CASE WHEN length(l) > 26 THEN left(l, 25) || '…' ELSE l END AS label, q AS csv
FROM (SELECT doc_id, line, rtrim(left(trim(regexp_replace(lower(trim(h, ' ')), '[^a-z0-9]+', '_', 'g'), '_'), 40), '_') AS t,
  string_split(h, '/')[-1] AS l, CASE WHEN regexp_matches(h, '[,"\n\r]') THEN '"' || replace(h, '"', '""') || '"' ELSE h END AS q
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS h, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS line FROM documents))""",
)
def display_names(spark, d):
    h = F.col("h")
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "h"))
    return lines.select(
        "doc_id", "line", sanitize_relation(h).alias("relation"), short_label(h).alias("label"), csv_field(h).alias("csv")
    )


# --- journal -----------------------------------------------------------------------------------
@query(
    "journal_parsed",
    f"""SELECT event_id AS seq, CASE WHEN event_id % 97 = 0 THEN 'missing_timestamp' WHEN event_id % 89 = 0 THEN 'invalid_json' END AS error,
  CASE WHEN event_id % 97 <> 0 AND event_id % 89 <> 0 THEN epoch_us(ts) END AS ts_us,
  CASE WHEN event_id % 97 = 0 OR event_id % 89 <> 0 THEN event_type || '.service' END AS unit,
  CASE WHEN (event_id % 97 = 0 OR event_id % 89 <> 0) AND user_id % 5 <> 0 THEN CAST(user_id AS INTEGER) END AS pid,
  CASE WHEN event_id % 97 = 0 OR event_id % 89 <> 0 THEN {MSG} ELSE '' END AS message FROM events""",
)
def journal_parsed(spark, d):
    e = table(spark, d, "events")
    doc = F.to_json(
        F.struct(
            F.when(F.col("event_id") % 97 != 0, wall_us(F.col("ts")).cast("string")).alias("__REALTIME_TIMESTAMP"),
            F.concat("event_type", F.lit(".service")).alias("_SYSTEMD_UNIT"),
            F.when(F.col("user_id") % 5 == 0, F.lit("n/a")).otherwise(F.col("user_id").cast("string")).alias("_PID"),
            F.lit("6").alias("PRIORITY"),
            msg().alias("MESSAGE"),
        )
    )
    broken = (F.col("event_id") % 89 == 0) & (F.col("event_id") % 97 != 0)
    lines = e.select(F.col("event_id").alias("seq"), F.when(broken, F.lit("{not json")).otherwise(doc).alias("value"))
    return parse_journal(lines).select("seq", "error", "ts_us", "unit", "pid", "message")


@query(
    "journal_binary_messages",
    "SELECT c_custkey AS seq, c_name || chr(65533) AS message, true AS was_binary FROM customer",
)
def journal_binary_messages(spark, d):
    codes = F.transform(F.split("c_name", ""), lambda c: F.ascii(c))
    doc = F.concat(
        F.lit('{"__REALTIME_TIMESTAMP":"5","MESSAGE":['), F.array_join(F.filter(codes, lambda x: x > 0), ","), F.lit(",255]}")
    )
    lines = table(spark, d, "customer").select(F.col("c_custkey").alias("seq"), doc.alias("value"))
    good, _ = split_parse_errors(parse_journal(lines))
    return good.select("seq", "message", F.col("message_was_binary").alias("was_binary"))


@query(
    "parse_error_counts",
    """SELECT CASE WHEN event_id % 97 = 0 THEN 'missing_timestamp' ELSE 'invalid_json' END AS error, count(*) AS cnt
FROM events WHERE event_id % 97 = 0 OR event_id % 89 = 0 GROUP BY ALL""",
)
def parse_error_counts(spark, d):
    line = (
        F.when(F.col("event_id") % 97 == 0, F.lit('{"MESSAGE":"x"}'))
        .when(F.col("event_id") % 89 == 0, F.lit("[1"))
        .otherwise(F.concat(F.lit('{"__REALTIME_TIMESTAMP":"'), F.col("event_id").cast("string"), F.lit('"}')))
    )
    _, bad = split_parse_errors(parse_journal(table(spark, d, "events").select(line.alias("value"))))
    return bad.groupBy("error").agg(F.count(F.lit(1)).alias("cnt"))


# --- notes -------------------------------------------------------------------------------------
_PAGE = """page AS (SELECT page_id, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  list_transform(regexp_extract_all(html, '<a href="([^"]*)">', 1), lambda x: x) AS hrefs FROM pages)"""


def page_notes(spark, d):
    """Pages as Markdown: the title as heading, navigation links as Markdown links."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), 1)
    body = F.array_join(F.transform(links, lambda l: F.concat(F.lit("see [x]("), l, F.lit(")"))), "\n")
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("# "), title, F.lit("\n\n"), body).alias("text"))


@query(
    "page_links",
    f"""WITH {_PAGE}, l AS (SELECT page_id, unnest(hrefs) AS h, generate_subscripts(hrefs, 1) AS p FROM page),
k AS (SELECT page_id, regexp_replace(h, '[#?].*$', '') AS target, min(p) AS p FROM l
  WHERE NOT contains(h, '://') AND NOT starts_with(h, 'mailto:') AND NOT starts_with(h, '#') AND NOT regexp_matches(h, '[)\\s>]') GROUP BY ALL)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY p) - 1 AS INTEGER) AS pos, target FROM k WHERE target <> ''""",
)
def page_links(spark, d):
    n = N.extract_notes(page_notes(spark, d))
    return n.select("page_id", F.posexplode("links").alias("pos", "l")).select("page_id", "pos", F.col("l.target").alias("target"))


_STOP = ", ".join(f"'{w}'" for w in GraphConfig.stop_words)


@query(
    "page_terms",
    f"""WITH {_PAGE}, w AS (SELECT page_id, unnest(regexp_split_to_array(title, '[^\\p{{L}}\\p{{N}}]+')) AS w FROM page)
SELECT DISTINCT page_id, lower(w) AS term FROM w
WHERE length(lower(w)) >= 4 AND NOT regexp_full_match(w, '[0-9]+') AND lower(w) NOT IN ({_STOP})""",
)
def page_terms(spark, d):
    n = N.extract_notes(page_notes(spark, d))
    return n.select("page_id", F.explode("terms").alias("term"))


@query(
    "document_notes",
    """SELECT doc_id, source AS title, 1 AS links, '#' || lang || ' notes about ' || source AS terms FROM documents""",
)
def document_notes(spark, d):
    """Whole documents below a head with frontmatter, a heading and a link."""
    head = F.concat(
        F.lit("---\ntitle: "), F.col("source"), F.lit("\ntags: "), F.col("lang"), F.lit("\n---\n# Notes about "), F.col("source"),
        F.lit("\n\n[next](n"), F.col("doc_id").cast("string"), F.lit(".md) "),
    )
    docs = texts(spark, d, "documents", "doc_id", "text", "source", "lang")
    n = N.extract_notes(docs.select("doc_id", F.concat(head, "text").alias("text")))
    return n.select("doc_id", "title", F.size("links").alias("links"), F.array_join("terms", " ").alias("terms"))


_DELTA = """st AS (SELECT 'doc/' || doc_id AS path, n_chars AS size, doc_id AS mtime_ns, md5(text) AS hash FROM documents),
ls AS (
  SELECT 'doc/' || doc_id AS path, n_chars + coalesce(toxic, 0) AS size, doc_id + coalesce(1 - quality, 0) AS mtime_ns,
    md5(CASE WHEN toxic = 1 THEN text || '!' ELSE text END) AS hash
  FROM documents LEFT JOIN labels USING (doc_id) WHERE lang <> 'es'
  UNION ALL SELECT 'page/' || page_id, length(html), page_id, md5(html) FROM pages),
dl AS (
  SELECT path, CASE WHEN l.path IS NULL THEN 'removed'
    WHEN s.path IS NOT NULL AND s.size = l.size AND s.mtime_ns = l.mtime_ns THEN 'same'
    WHEN s.path IS NULL THEN 'added' WHEN s.hash = l.hash THEN 'touched' ELSE 'changed' END AS change, s.path IS NOT NULL AS known
  FROM st s FULL JOIN ls l USING (path))"""


def _delta(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    state = docs.select(path.alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime_ns"), content_hash(F.col("text")).alias("hash"))
    zero = F.lit(0)
    new = docs.join(labels, "doc_id", "left").where(F.col("lang") != "es").select(
        path.alias("path"),
        (F.col("n_chars") + F.coalesce("toxic", zero)).alias("size"),
        (F.col("doc_id") + F.coalesce(1 - F.col("quality"), zero)).alias("mtime_ns"),
        F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"),
    )
    pages = table(spark, d, "pages").select(
        F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), F.length("html").cast("bigint").alias("size"),
        F.col("page_id").alias("mtime_ns"), F.col("html").alias("text"),
    )
    listing = new.unionByName(pages)
    return N.delta_notes(state, listing.select("path", "size", "mtime_ns"), listing.select("path", content_hash(F.col("text")).alias("hash")))


@query("delta_notes", f"WITH {_DELTA} SELECT path, change FROM dl")
def delta_notes(spark, d):
    return _delta(spark, d).select("path", "change")


@query(
    "scan_report",
    f"""WITH {_DELTA} SELECT count(*) FILTER (change IN ('added', 'changed', 'touched', 'same')) AS files,
  count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'changed') AS changed,
  count(*) FILTER (change = 'removed' OR (change = 'skipped' AND known)) AS removed, count(*) FILTER (change = 'skipped') AS skipped,
  false AS truncated, count(*) FILTER (change IN ('added', 'changed', 'removed') OR (change = 'skipped' AND known)) > 0 AS dirty FROM dl""",
)
def scan_report(spark, d):
    return N.scan_report(_delta(spark, d))


@query(
    "due_notes",
    """SELECT doc_id, n_chars AS changed_at FROM documents LEFT JOIN labels USING (doc_id)
WHERE quality IS DISTINCT FROM 1 AND 10000 - n_chars >= 600 ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR) LIMIT 10""",
)
def due_notes(spark, d):
    n = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        "doc_id", F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("hash"),
        F.when(F.col("quality") == 1, 1).alias("analysed_hash"), F.col("n_chars").alias("changed_at"),
    )
    return N.due_notes(n, 10_000).select("doc_id", "changed_at")


@query(
    "run_ledger",
    """SELECT strftime(o_orderdate, '%Y-%m') AS day, count(*) AS runs,
  round(sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0 END) / 1000, 2) + 0.0 AS usd,
  CASE WHEN strftime(o_orderdate, '%Y-%m') <> '1998-07' THEN NULL WHEN count(*) >= 1000000 THEN 'daily_runs'
    WHEN sum(CASE WHEN o_orderstatus <> 'F' THEN o_totalprice ELSE 0 END) >= 1 THEN 'daily_budget' ELSE 'ok' END AS status
FROM orders GROUP BY 1""",
)
def run_ledger(spark, d):
    runs = table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("day"), F.col("o_orderkey").alias("ts"),
        (F.col("o_orderstatus") != "F").alias("ok"), F.col("o_totalprice").alias("cost_usd"),
    )
    out = N.run_ledger(runs, "1998-07", 0, 1_000_000, 1.0, 60, 60)
    return out.select("day", "runs", (F.round(F.col("usd") / 1000, 2) + F.lit(0.0)).alias("usd"), "status")


# --- proposed edges ----------------------------------------------------------------------------
def _replies(spark, d):
    """Conversations as replies: a JSON array of edges inside some text."""
    item = lambda s, t: F.concat(F.lit('{"source":"'), s, F.lit('","target":"'), t, F.lit('","relation":"'), F.col("role"), F.lit(' of"}'))
    n = lambda c: F.concat(F.lit("n"), c.cast("string"))
    edge = item(n(F.col("conv_id")), n(F.col("turn")))
    rejected = F.lit('{"source":7,"target":"n1"}')
    text = F.when(F.col("turn") == 3, F.lit("no edges today")).otherwise(
        F.concat(F.lit("Here you go: ["), edge, F.lit(", "), rejected, F.lit("] as asked"))
    )
    return table(spark, d, "conversations").select("conv_id", "turn", "role", text.alias("text"))


@query(
    "candidate_edges",
    """SELECT conv_id, turn, CAST(0 AS INTEGER) AS pos, 'n' || conv_id AS source, 'n' || turn AS target, role || ' of' AS relation, false AS rejected, NULL AS error FROM conversations WHERE turn <> 3
UNION ALL SELECT conv_id, turn, 1, NULL, 'n1', '', true, NULL FROM conversations WHERE turn <> 3
UNION ALL SELECT conv_id, turn, NULL, NULL, NULL, '', NULL, 'no_json' FROM conversations WHERE turn = 3""",
)
def candidate_edges(spark, d):
    return N.parse_candidate_edges(_replies(spark, d)).drop("role")


@query(
    "validated_edges",
    """WITH r AS (SELECT conv_id * 1000 + turn AS pos, 'N' || conv_id AS s, 'N' || turn AS t, role FROM conversations WHERE turn <> 3),
k AS (SELECT DISTINCT conv_id AS n FROM conversations),
v AS (SELECT r.* FROM r JOIN k a ON 'N' || a.n = s JOIN k b ON 'N' || b.n = t WHERE s <> t),
f AS (SELECT s, t, min(pos) AS pos FROM v GROUP BY ALL),
w AS (SELECT pos FROM f)
SELECT r.pos, w.pos IS NOT NULL AS accepted, role || '_of' AS relation FROM r LEFT JOIN w USING (pos)""",
)
def validated_edges(spark, d):
    from vigilframe.operators.graph import validate_candidate_edges

    raw = N.parse_candidate_edges(_replies(spark, d)).where("rejected = false").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "source", "target", "relation"
    )
    conv = table(spark, d, "conversations").select("conv_id").distinct()
    ids = conv.select(F.concat(F.lit("N"), F.col("conv_id").cast("string")).alias("id"), F.col("conv_id").cast("string").alias("path"))
    return validate_candidate_edges(raw, ids, ids.select("id")).select("pos", "accepted", "relation")
