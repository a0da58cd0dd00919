"""Signals, baselines, scoring and alerts over the events table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from vigilframe.config import AnalysisConfig, BaselineConfig, QuietRule
from vigilframe.operators import baselines as B
from vigilframe.operators import entropy as E
from vigilframe.operators import filters as FL
from vigilframe.operators import live as L
from vigilframe.operators import scoring as SC
from vigilframe.operators import signals as S
from vigilframe.operators.ordered import stage
from vigilframe.plans.catalog import EV, HOUR, MSG, WINDOW, events, msg, query, r6, table, wall_us
from vigilframe.plans.detect import snapshots, unit_bucket_counts

# Hour buckets and six-hour windows: the events are sparse.
CFG = replace(
    AnalysisConfig(), window_seconds=6 * 3600, bucket_seconds=3600, learning_minutes=24 * 60,
    cooldown_seconds=12 * 3600, rate_z_reference=4.0, surprisal_reference_bits=8.0,
)
BASE = BaselineConfig(min_weight=60.0, profile_min_weight=50.0)

WIN = EV + """,
pairs AS (
  SELECT a.hostname, a.seq, b.template_id AS t, count(*) AS c
  FROM ev a JOIN ev b ON a.hostname = b.hostname AND b.ts_us >= a.ts_us - 21600000000
   AND (b.ts_us < a.ts_us OR (b.ts_us = a.ts_us AND b.seq <= a.seq))
  GROUP BY ALL),
wsum AS (
  SELECT hostname, seq, CAST(sum(c) AS BIGINT) AS n, count(*) AS k, sum(c * log2(c)) AS s
  FROM pairs GROUP BY ALL),
win AS (
  SELECT e.*, w.n AS win_events, w.k AS win_distinct, p.c AS win_count,
         CASE WHEN w.k > 1 THEN greatest(log2(w.n) - w.s / w.n, 0.0) ELSE 0.0 END AS win_entropy
  FROM ev e JOIN wsum w USING (hostname, seq)
  JOIN pairs p ON p.hostname = e.hostname AND p.seq = e.seq AND p.t = e.template_id)"""

EZ = WIN + """,
closed AS (
  SELECT hostname, bucket, arg_max(win_entropy, (ts_us, seq)) AS h FROM win GROUP BY ALL),
ehist0 AS (
  SELECT hostname, bucket, list(h) OVER (PARTITION BY hostname ORDER BY bucket ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS l
  FROM closed),
ehist1 AS (SELECT *, list_aggregate(l, 'median') AS med FROM ehist0),
ehist AS (SELECT *, list_aggregate(list_transform(l, lambda x: abs(x - med)), 'median') AS mad FROM ehist1),
ez AS (
  SELECT w.*, CASE WHEN h.med IS NULL THEN 0.0 ELSE
     greatest(-50.0, least(50.0, (w.win_entropy - h.med) / greatest(h.mad / 0.6745, 0.15))) END AS entropy_z
  FROM win w JOIN ehist h USING (hostname, bucket))"""


def _rate(src: str) -> str:
    return f""",
rc AS (SELECT hostname, template_id, bucket, count(*) AS c FROM ev GROUP BY ALL),
rs AS (SELECT hostname, min(bucket) AS start FROM ev GROUP BY ALL),
rh0 AS (
  SELECT rc.*, least(60, bucket - start) AS len,
    coalesce(list(CAST(c AS DOUBLE)) OVER (PARTITION BY rc.hostname, template_id ORDER BY bucket RANGE BETWEEN 60 PRECEDING AND 1 PRECEDING), []) AS nz
  FROM rc JOIN rs USING (hostname)),
rh1 AS (SELECT *, list_concat(nz, list_transform(range(CAST(len - len(nz) AS BIGINT)), lambda x: 0.0)) AS h FROM rh0),
rh2 AS (SELECT *, list_aggregate(h, 'median') AS med FROM rh1),
rh AS (SELECT *, list_aggregate(list_transform(h, lambda x: abs(x - med)), 'median') AS mad FROM rh2),
rz AS (
  SELECT e.*, row_number() OVER (PARTITION BY e.hostname, e.template_id, e.bucket ORDER BY e.ts_us, e.seq) AS bucket_count,
    rh.med AS r_med, rh.mad AS r_mad
  FROM {src} e JOIN rh ON rh.hostname = e.hostname AND rh.template_id = e.template_id AND rh.bucket = e.bucket),
rate AS (
  SELECT *, CASE WHEN r_med IS NULL THEN 0.0 ELSE greatest(-50.0, least(50.0,
    (bucket_count - r_med) / greatest(r_mad / 0.6745, sqrt(greatest(r_med, 0) + 1), 1.0))) END AS rate_z_short
  FROM rz)"""


def _profile(src: str) -> str:
    return f""",
pw AS (SELECT *, pow(2.0, (bucket - min(bucket) OVER (PARTITION BY hostname)) / 168.0) AS w,
    row_number() OVER (PARTITION BY hostname, unit, template_id ORDER BY ts_us, seq) AS nth FROM {src}),
pc AS (
  SELECT *, sum(w) OVER (PARTITION BY hostname, unit, template_id ORDER BY ts_us, seq) / w AS wt,
    sum(w) OVER (PARTITION BY hostname, unit ORDER BY ts_us, seq) / w AS profile_weight,
    count(*) FILTER (nth = 1) OVER (PARTITION BY hostname, unit ORDER BY ts_us, seq) AS kinds
  FROM pw),
prof AS (
  SELECT *, CASE WHEN profile_weight >= 50 THEN
    -log2((floor(wt + 0.5) + 0.5) / (floor(profile_weight + 0.5) + 0.5 * (kinds + 1))) END AS surprisal_profile
  FROM pc)"""


SCORED = EZ + _rate("ez") + _profile("rate") + """,
sc0 AS (
  SELECT *, coalesce(surprisal_profile, -log2((win_count + 0.5) / (win_events + 0.5 * (win_distinct + 1)))) AS surprisal_bits
  FROM prof),
sc1 AS (
  SELECT *, greatest(0.0, least(1.0, greatest(rate_z_short, 0.0) / 4.0)) AS rate_component,
    greatest(0.0, least(1.0, surprisal_bits / 8.0)) AS surprisal_component,
    least(1.0, abs(entropy_z) / 6.0) * (win_count / win_events) AS entropy_component
  FROM sc0),
scored AS (
  SELECT *, 1 - (1 - rate_component) * (1 - 0.8 * surprisal_component) * (1 - 0.4 * entropy_component) AS combined
  FROM sc1)"""

FOLD = "WITH RECURSIVE " + SCORED.lstrip() + """,
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY hostname, template_id ORDER BY ts_us, seq) AS rn,
    ts_us - min(ts_us) OVER (PARTITION BY hostname) < 86400000000 AS learning
  FROM scored),
keyed AS MATERIALIZED (SELECT hostname, template_id, rn, ts_us, seq, learning, round(combined, 9) AS s FROM numbered),
leveled AS (
  SELECT k.*, CASE WHEN s >= 0.8 THEN 3 WHEN s >= 0.6 THEN 2 WHEN s >= 0.5 THEN 1 ELSE 0 END AS level
  FROM keyed k WHERE rn = 1
  UNION ALL
  SELECT k.*, greatest(CASE WHEN k.s >= 0.8 THEN 3 WHEN k.s >= 0.6 THEN 2 WHEN k.s >= 0.5 THEN 1 ELSE 0 END,
    CASE WHEN l.level = 3 AND k.s >= 0.8 * 0.8 THEN 3 WHEN l.level = 2 AND k.s >= 0.6 * 0.8 THEN 2
         WHEN l.level = 1 AND k.s >= 0.5 * 0.8 THEN 1 ELSE 0 END)
  FROM leveled l JOIN keyed k ON k.hostname = l.hostname AND k.template_id = l.template_id AND k.rn = l.rn + 1),
alerts AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY hostname, template_id ORDER BY rn) AS an
  FROM leveled WHERE level > 0 AND NOT learning),
fold AS (
  SELECT hostname, template_id, an, seq, level, true AS emitted, CAST(0 AS BIGINT) AS carried,
    ts_us AS last_ts, level AS last_level, CAST(0 AS BIGINT) AS held
  FROM alerts WHERE an = 1
  UNION ALL
  SELECT a.hostname, a.template_id, a.an, a.seq, a.level,
    a.level > f.last_level OR a.ts_us - f.last_ts >= 43200000000,
    CASE WHEN a.level > f.last_level OR a.ts_us - f.last_ts >= 43200000000 THEN f.held ELSE 0 END,
    CASE WHEN a.level > f.last_level OR a.ts_us - f.last_ts >= 43200000000 THEN a.ts_us ELSE f.last_ts END,
    CASE WHEN a.level > f.last_level OR a.ts_us - f.last_ts >= 43200000000 THEN a.level ELSE f.last_level END,
    CASE WHEN a.level > f.last_level OR a.ts_us - f.last_ts >= 43200000000 THEN 0 ELSE f.held + 1 END
  FROM fold f JOIN alerts a ON a.hostname = f.hostname AND a.template_id = f.template_id AND a.an = f.an + 1)"""


@query(
    "bucket_entropy",
    f"""WITH {EV},
c AS (SELECT hostname, bucket, template_id, count(*) AS c FROM ev GROUP BY ALL)
SELECT hostname, bucket, CAST(sum(c) AS BIGINT) AS n, count(*) AS kinds,
  round(CASE WHEN count(*) > 1 THEN greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) ELSE 0 END, 6) + 0.0 AS entropy,
  round(CASE WHEN count(*) > 1 THEN log2(count(*)) ELSE 0 END, 6) + 0.0 AS max_entropy,
  round(CASE WHEN count(*) > 1 THEN least(1, greatest(0, (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(count(*)))) ELSE 0 END, 6) + 0.0 AS normalized_entropy
FROM c GROUP BY ALL""",
)
def bucket_entropy(spark, d):
    ev = events(spark, d).withColumn("bucket", F.call_function("div", F.col("ts_us"), F.lit(HOUR).cast("bigint")))
    e = E.shannon_entropy(ev, ["hostname", "bucket"], "template_id")
    return e.select(
        "hostname", "bucket", "n", F.col("distinct").alias("kinds"), r6("entropy").alias("entropy"),
        r6("max_entropy").alias("max_entropy"), r6("normalized_entropy").alias("normalized_entropy"),
    )


@query(
    "bucket_counts",
    f"WITH {EV} SELECT hostname, unit, template_id, bucket, count(*) AS cnt FROM ev GROUP BY ALL",
)
def bucket_counts(spark, d):
    out = E.bucket_counts(events(spark, d), ["hostname", "unit", "template_id"], HOUR)
    return out.withColumnRenamed("count", "cnt")


@query(
    "sliding_entropy",
    f"""WITH {WIN} SELECT hostname, seq, win_events, win_distinct, win_count,
  round(win_entropy, 6) + 0.0 AS win_entropy FROM win""",
)
def sliding_entropy(spark, d):
    w = S.sliding_window_stats(events(spark, d), WINDOW)
    return w.select("hostname", "seq", "win_events", "win_distinct", "win_count", r6("win_entropy").alias("win_entropy"))


@query(
    "sliding_entropy_capped",
    f"""WITH {EV},
num AS (SELECT *, row_number() OVER (PARTITION BY hostname ORDER BY ts_us, seq) AS rn FROM ev),
pairs AS (
  SELECT a.hostname, a.seq, b.template_id AS t, count(*) AS c
  FROM num a JOIN num b ON a.hostname = b.hostname AND b.rn <= a.rn AND b.rn > a.rn - 12
   AND b.ts_us >= a.ts_us - 21600000000 GROUP BY ALL)
SELECT hostname, seq, CAST(sum(c) AS BIGINT) AS win_events, count(*) AS win_distinct,
  round(CASE WHEN count(*) > 1 THEN greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) ELSE 0 END, 6) + 0.0 AS win_entropy
FROM pairs GROUP BY ALL""",
)
def sliding_entropy_capped(spark, d):
    w = S.sliding_window_stats(events(spark, d), WINDOW, max_events=12)
    return w.select("hostname", "seq", "win_events", "win_distinct", r6("win_entropy").alias("win_entropy"))


@query(
    "sliding_entropy_bucketed",
    f"""WITH {EV},
fan AS (
  SELECT hostname, template_id, unnest(range(bucket - 5, bucket + 1)) AS w FROM ev),
c AS (SELECT hostname, w, template_id, count(*) AS c FROM fan GROUP BY ALL)
SELECT hostname, CAST(w AS BIGINT) * 3600000000 AS window_start_us, CAST(sum(c) AS BIGINT) AS win_events, count(*) AS win_distinct,
  round(CASE WHEN count(*) > 1 THEN greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) ELSE 0 END, 6) + 0.0 AS win_entropy
FROM c GROUP BY ALL""",
)
def sliding_entropy_bucketed(spark, d):
    ev = events(spark, d).withColumn("ts", F.timestamp_micros("ts_us"))
    w = S.sliding_window_stats_bucketed(ev, "6 hours", "1 hour")
    return w.select(
        "hostname", F.unix_micros("window_start").alias("window_start_us"), "win_events", "win_distinct",
        r6("win_entropy").alias("win_entropy"),
    )


@query(
    "entropy_history",
    f"""WITH {EZ} SELECT hostname, bucket, round(c.h, 5) + 0.0 AS closed_entropy,
  CAST(coalesce(len(l), 0) AS BIGINT) AS hist_len, round(med, 5) + 0.0 AS hist_median, round(mad, 5) + 0.0 AS hist_mad
FROM ehist e JOIN closed c USING (hostname, bucket)""",
)
def entropy_history(spark, d):
    h = S.entropy_history(S.sliding_window_stats(events(spark, d), WINDOW), HOUR)
    return h.select(
        "hostname", "bucket", F.col("hist_len").cast("bigint").alias("hist_len"),
        *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("closed_entropy", "hist_median", "hist_mad")],
    )


@query("entropy_z", f"WITH {EZ} SELECT hostname, seq, round(entropy_z, 6) + 0.0 AS entropy_z FROM ez")
def entropy_z(spark, d):
    w = stage(S.sliding_window_stats(events(spark, d), WINDOW))
    return S.entropy_z(w, HOUR).select("hostname", "seq", r6("entropy_z").alias("entropy_z"))


@query(
    "rate_z",
    f"WITH {EV}{_rate('ev')} SELECT hostname, seq, bucket_count, round(rate_z_short, 6) + 0.0 AS rate_z FROM rate",
)
def rate_z(spark, d):
    z = S.rate_z_short(events(spark, d), HOUR)
    return z.select("hostname", "seq", "bucket_count", r6("rate_z_short").alias("rate_z"))


@query(
    "surprisal_window",
    f"""WITH {WIN} SELECT hostname, seq,
  round(-log2((win_count + 0.5) / (win_events + 0.5 * (win_distinct + 1))), 6) + 0.0 AS surprisal FROM win""",
)
def surprisal_window(spark, d):
    w = S.window_surprisal(S.sliding_window_stats(events(spark, d), WINDOW))
    return w.select("hostname", "seq", r6("surprisal_window").alias("surprisal"))


@query(
    "surprisal_profile",
    f"""WITH {EV}{_profile('ev')} SELECT hostname, seq, round(profile_weight, 6) + 0.0 AS profile_weight,
  round(surprisal_profile, 6) + 0.0 AS surprisal FROM prof""",
)
def surprisal_profile(spark, d):
    p = S.profile_surprisal(events(spark, d), HOUR, cfg=BASE)
    return p.select("hostname", "seq", r6("profile_weight").alias("profile_weight"), r6("surprisal_profile").alias("surprisal"))


_BASELINE = EV + """,
ub0 AS (SELECT hostname, unit, bucket, min(ts_us) AS o FROM ev GROUP BY ALL),
ub AS (
  SELECT hostname, unit, bucket, CAST((bucket % 24) * 2 + CASE WHEN ((bucket // 24) + 4) % 7 IN (0, 6) THEN 1 ELSE 0 END AS INTEGER) AS slot
  FROM (SELECT *, max(bucket) OVER (PARTITION BY hostname, unit) AS m FROM ub0) WHERE bucket < m),
ub2 AS (SELECT * FROM ub UNION ALL SELECT hostname, unit, bucket, 48 FROM ub),
tc AS (SELECT hostname, unit, template_id, bucket, count(*) AS c FROM ev GROUP BY ALL),
tf AS (SELECT hostname, unit, template_id, min(bucket) AS f FROM tc GROUP BY ALL),
ub3 AS (SELECT *, max(bucket) OVER (PARTITION BY hostname, unit, slot) AS lastb FROM ub2),
obs AS (
  SELECT u.hostname, u.unit, tf.template_id, u.slot, coalesce(tc.c, 0) AS v, pow(0.5, (lastb - u.bucket) / 168.0) AS w
  FROM ub3 u JOIN tf ON tf.hostname = u.hostname AND tf.unit = u.unit AND tf.f <= u.bucket
  LEFT JOIN tc ON tc.hostname = u.hostname AND tc.unit = u.unit AND tc.template_id = tf.template_id AND tc.bucket = u.bucket),
bins AS (SELECT hostname, unit, template_id, slot, v, sum(w) AS w FROM obs GROUP BY ALL),
cum AS (
  SELECT *, sum(w) OVER k AS total, sum(w) OVER (PARTITION BY hostname, unit, template_id, slot ORDER BY v) AS cw,
    lead(v) OVER (PARTITION BY hostname, unit, template_id, slot ORDER BY v) AS nv
  FROM bins WINDOW k AS (PARTITION BY hostname, unit, template_id, slot)),
med AS (
  SELECT hostname, unit, template_id, slot, any_value(total) AS weight, count(*) AS n_bins,
    arg_min(CASE WHEN abs(cw - total / 2) < 1e-9 AND nv IS NOT NULL THEN (v + nv) / 2.0 ELSE v END, v)
      FILTER (cw >= total / 2 OR abs(cw - total / 2) < 1e-9) AS median,
    sum(w) FILTER (v = 0) AS zero_weight
  FROM cum GROUP BY ALL),
dev AS (
  SELECT b.hostname, b.unit, b.template_id, b.slot, abs(b.v - m.median) AS v, sum(b.w) AS w
  FROM bins b JOIN med m USING (hostname, unit, template_id, slot) GROUP BY ALL),
dcum AS (
  SELECT *, sum(w) OVER k AS total, sum(w) OVER (PARTITION BY hostname, unit, template_id, slot ORDER BY v) AS cw,
    lead(v) OVER (PARTITION BY hostname, unit, template_id, slot ORDER BY v) AS nv
  FROM dev WINDOW k AS (PARTITION BY hostname, unit, template_id, slot)),
mads AS (
  SELECT hostname, unit, template_id, slot,
    arg_min(CASE WHEN abs(cw - total / 2) < 1e-9 AND nv IS NOT NULL THEN (v + nv) / 2.0 ELSE v END, v)
      FILTER (cw >= total / 2 OR abs(cw - total / 2) < 1e-9) AS mad
  FROM dcum GROUP BY ALL),
base AS (SELECT * FROM med JOIN mads USING (hostname, unit, template_id, slot))"""


@query(
    "slot_baseline",
    f"""WITH {_BASELINE} SELECT hostname, unit, template_id, slot, n_bins, round(weight, 6) + 0.0 AS weight,
  round(coalesce(zero_weight, 0), 6) + 0.0 AS zero_weight, round(median, 6) + 0.0 AS median, round(mad, 6) + 0.0 AS mad FROM base""",
)
def slot_baseline(spark, d):
    b = B.slot_statistics(B.fit_slot_baselines(events(spark, d), HOUR, BASE))
    zero = F.aggregate(F.filter("bins", lambda x: x["value"] == 0), F.lit(0.0), lambda a, x: a + x["weight"])
    return b.select(
        "hostname", F.col("unit_name").alias("unit"), "template_id", "slot", F.size("bins").cast("bigint").alias("n_bins"),
        r6("weight").alias("weight"), r6(zero).alias("zero_weight"), r6("median").alias("median"), r6("mad").alias("mad"),
    )


@query(
    "unit_profiles",
    f"""WITH {EV}, l AS (SELECT hostname, unit, max(bucket) AS m FROM ev GROUP BY ALL)
SELECT hostname, unit, template_id, round(sum(pow(0.5, (m - bucket) / 168.0)), 6) + 0.0 AS weight
FROM ev JOIN l USING (hostname, unit) GROUP BY ALL""",
)
def unit_profiles(spark, d):
    p = B.fit_unit_profiles(events(spark, d), HOUR, BASE)
    return p.select("hostname", F.col("unit_name").alias("unit"), "template_id", r6("weight").alias("weight"))


@query(
    "enforced_limits",
    f"""WITH {_BASELINE}
SELECT hostname, unit, template_id, slot FROM base
QUALIFY row_number() OVER (PARTITION BY hostname ORDER BY round(weight, 9) DESC, unit, template_id, slot) <= 500""",
)
def enforced_limits(spark, d):
    b = B.fit_slot_baselines(events(spark, d), HOUR, BASE).withColumn("weight", F.round("weight", 9))
    return B.enforce_limits(b, 500).select("hostname", F.col("unit_name").alias("unit"), "template_id", "slot")


@query(
    "trusted_hosts",
    f"WITH {_BASELINE} SELECT hostname, max(weight) >= 60 AS trusted FROM base GROUP BY ALL",
)
def trusted_hosts(spark, d):
    return B.trusted_baselines(B.fit_slot_baselines(events(spark, d), HOUR, BASE), None, BASE)


_BZ = _BASELINE + """,
cur AS (
  SELECT *, row_number() OVER (PARTITION BY hostname, unit, template_id, bucket ORDER BY ts_us, seq) AS cnt,
    CAST((bucket % 24) * 2 + CASE WHEN ((bucket // 24) + 4) % 7 IN (0, 6) THEN 1 ELSE 0 END AS INTEGER) AS slot
  FROM ev),
bz AS (
  SELECT c.*, CASE WHEN s.weight >= 60 THEN greatest(-50, least(50, (cnt - s.median) / greatest(s.mad / 0.6745, sqrt(s.median + 1), 1.0))) END AS slot_z,
    CASE WHEN a.weight >= 60 THEN greatest(-50, least(50, (cnt - a.median) / greatest(a.mad / 0.6745, sqrt(a.median + 1), 1.0))) END AS any_z
  FROM cur c
  LEFT JOIN base s ON s.hostname = c.hostname AND s.unit = c.unit AND s.template_id = c.template_id AND s.slot = c.slot
  LEFT JOIN base a ON a.hostname = c.hostname AND a.unit = c.unit AND a.template_id = c.template_id AND a.slot = 48)"""


@query(
    "baseline_rate_z",
    f"WITH {_BZ} SELECT hostname, seq, round(slot_z, 6) + 0.0 AS slot_z, round(any_z, 6) + 0.0 AS any_z FROM bz",
)
def baseline_rate_z(spark, d):
    ev = events(spark, d)
    base = B.fit_slot_baselines(ev, HOUR, BASE)
    z = B.baseline_rate_z(unit_bucket_counts(ev, HOUR), base, cfg=BASE)
    return z.select("hostname", "seq", r6("slot_z").alias("slot_z"), r6("any_z").alias("any_z"))


_LIVE = EV + """,
lb0 AS (SELECT hostname, unit, bucket, CAST((bucket % 24) * 2 + CASE WHEN ((bucket // 24) + 4) % 7 IN (0, 6) THEN 1 ELSE 0 END AS INTEGER) AS slot
  FROM ev GROUP BY hostname, unit, bucket),
lb AS (SELECT * FROM lb0 UNION ALL SELECT hostname, unit, bucket, 48 FROM lb0),
lc AS (SELECT hostname, unit, template_id, bucket, count(*) AS c FROM ev GROUP BY ALL),
lf AS (SELECT hostname, unit, template_id, min(bucket) AS f FROM lc GROUP BY ALL),
lq AS (SELECT c.hostname, c.unit, c.template_id, c.bucket, b.slot FROM lc c JOIN lb b USING (hostname, unit, bucket)),
lo AS (
  SELECT q.hostname, q.unit, q.template_id, q.bucket, q.slot, coalesce(c.c, 0) AS v,
    pow(0.5, (max(b.bucket) OVER (PARTITION BY q.hostname, q.unit, q.template_id, q.bucket, q.slot) - b.bucket) / 168.0) AS w
  FROM lq q JOIN lf f USING (hostname, unit, template_id)
  JOIN lb b ON b.hostname = q.hostname AND b.unit = q.unit AND b.slot = q.slot AND b.bucket < q.bucket AND b.bucket >= f.f
  LEFT JOIN lc c ON c.hostname = q.hostname AND c.unit = q.unit AND c.template_id = q.template_id AND c.bucket = b.bucket),
lbins AS (SELECT hostname, unit, template_id, bucket, slot, v, sum(w) AS w FROM lo GROUP BY ALL),
lcum AS (
  SELECT *, sum(w) OVER k AS total, sum(w) OVER (k ORDER BY v) AS cw, lead(v) OVER (k ORDER BY v) AS nv
  FROM lbins WINDOW k AS (PARTITION BY hostname, unit, template_id, bucket, slot)),
lmed AS (
  SELECT hostname, unit, template_id, bucket, slot, any_value(total) AS weight,
    arg_min(CASE WHEN abs(cw - total / 2) < 1e-9 AND nv IS NOT NULL THEN (v + nv) / 2.0 ELSE v END, v)
      FILTER (cw >= total / 2 OR abs(cw - total / 2) < 1e-9) AS median
  FROM lcum GROUP BY ALL HAVING any_value(total) >= 60),
ldev AS (
  SELECT b.hostname, b.unit, b.template_id, b.bucket, b.slot, abs(b.v - m.median) AS v, sum(b.w) AS w
  FROM lbins b JOIN lmed m USING (hostname, unit, template_id, bucket, slot) GROUP BY ALL),
ldcum AS (
  SELECT *, sum(w) OVER k AS total, sum(w) OVER (k ORDER BY v) AS cw, lead(v) OVER (k ORDER BY v) AS nv
  FROM ldev WINDOW k AS (PARTITION BY hostname, unit, template_id, bucket, slot)),
lmad AS (
  SELECT hostname, unit, template_id, bucket, slot,
    arg_min(CASE WHEN abs(cw - total / 2) < 1e-9 AND nv IS NOT NULL THEN (v + nv) / 2.0 ELSE v END, v)
      FILTER (cw >= total / 2 OR abs(cw - total / 2) < 1e-9) AS mad
  FROM ldcum GROUP BY ALL),
lstat AS MATERIALIZED (SELECT * FROM lmed JOIN lmad USING (hostname, unit, template_id, bucket, slot)),
lz AS (
  SELECT e.hostname, e.seq, row_number() OVER (PARTITION BY e.hostname, e.unit, e.template_id, e.bucket ORDER BY e.ts_us, e.seq) AS cnt,
    s.median AS sm, s.mad AS sd, a.median AS am, a.mad AS ad
  FROM ev e JOIN lb0 b ON b.hostname = e.hostname AND b.unit = e.unit AND b.bucket = e.bucket
  LEFT JOIN lstat s ON s.hostname = e.hostname AND s.unit = e.unit AND s.template_id = e.template_id AND s.bucket = e.bucket AND s.slot = b.slot
  LEFT JOIN lstat a ON a.hostname = e.hostname AND a.unit = e.unit AND a.template_id = e.template_id AND a.bucket = e.bucket AND a.slot = 48),
live AS (
  SELECT hostname, seq, cnt, greatest(-50, least(50, (cnt - sm) / greatest(sd / 0.6745, sqrt(sm + 1), 1.0))) AS slot_z,
    greatest(-50, least(50, (cnt - am) / greatest(ad / 0.6745, sqrt(am + 1), 1.0))) AS any_z,
    sm IS NOT NULL AS has_slot, am IS NOT NULL AS has_any FROM lz)"""


@query(
    "live_rate_z",
    f"""WITH {_LIVE} SELECT hostname, seq, cnt AS unit_bucket_count, CASE WHEN has_slot THEN round(slot_z, 6) + 0.0 END AS slot_z,
  CASE WHEN has_any THEN round(any_z, 6) + 0.0 END AS any_z FROM live""",
)
def live_rate_z(spark, d):
    z = L.live_rate_z(events(spark, d), HOUR, BASE)
    return z.select("hostname", "seq", "unit_bucket_count", r6("slot_z").alias("slot_z"), r6("any_z").alias("any_z"))


@query(
    "merged_baselines",
    f"""WITH {_BASELINE} SELECT hostname, unit, template_id, slot, n_bins, round(weight, 6) + 0.0 AS weight,
  round(median, 6) + 0.0 AS median, round(mad, 6) + 0.0 AS mad FROM base""",
)
def merged_baselines(spark, d):
    """Baselines learned in ten parts of the events, which end within hours."""
    ev = events(spark, d)
    low, high = ev.agg(F.min("ts_us"), F.max("ts_us")).first()
    parts, state = 10, None
    for k in range(parts):
        cut = lambda i: low + (high + 1 - low) * i // parts
        part = ev.where((F.col("ts_us") >= cut(k)) & (F.col("ts_us") < cut(k + 1)))
        state = L.learn(L.unit_counts(part, HOUR), state, HOUR, BASE)
    b = B.slot_statistics(L.learned_baselines(state, BASE))
    return b.select(
        "hostname", F.col("unit_name").alias("unit"), "template_id", "slot", F.size("bins").cast("bigint").alias("n_bins"),
        r6("weight").alias("weight"), r6("median").alias("median"), r6("mad").alias("mad"),
    )


@query(
    "rate_source_mix",
    f"""WITH {_BZ} SELECT hostname, CASE WHEN slot_z IS NOT NULL THEN 'slot_baseline' WHEN any_z IS NOT NULL
  THEN 'any_slot_baseline' ELSE 'short_term' END AS rate_source, count(*) AS cnt FROM bz GROUP BY ALL""",
)
def rate_source_mix(spark, d):
    ev = events(spark, d)
    base = stage(B.fit_slot_baselines(ev, HOUR, BASE))
    z = B.baseline_rate_z(unit_bucket_counts(ev, HOUR), base, cfg=BASE).withColumn("rate_z_short", F.lit(0.0))
    return SC.pick_rate_signal(z).groupBy("hostname", "rate_source").agg(F.count(F.lit(1)).alias("cnt"))


def _scored(spark, d):
    w = stage(S.sliding_window_stats(events(spark, d), WINDOW))
    w = stage(S.rate_z_short(S.entropy_z(w, HOUR), HOUR))
    w = S.window_surprisal(S.profile_surprisal(w, HOUR, cfg=BASE))
    w = w.withColumns(
        {
            "surprisal_bits": F.coalesce("surprisal_profile", "surprisal_window"),
            "rate_z": F.col("rate_z_short"), "rate_source": F.lit("short_term"),
        }
    )
    return SC.score_events(w, CFG)


@query(
    "scored_events",
    f"""WITH {SCORED} SELECT hostname, seq, round(rate_component, 6) + 0.0 AS rate_component,
  round(surprisal_component, 6) + 0.0 AS surprisal_component, round(entropy_component, 6) + 0.0 AS entropy_component,
  round(combined, 6) + 0.0 AS combined FROM scored""",
)
def scored_events(spark, d):
    cols = ["rate_component", "surprisal_component", "entropy_component", "combined"]
    return _scored(spark, d).select("hostname", "seq", *[r6(c).alias(c) for c in cols])


def _folded(spark, d):
    scored = stage(_scored(spark, d).withColumn("combined", F.round("combined", 9)))
    return SC.fold_alerts(scored, CFG)


@query(
    "alert_fold",
    FOLD + """
SELECT l.hostname, l.template_id, l.seq, CAST(l.level AS INTEGER) AS level,
  CASE WHEN l.level = 0 THEN 'normal' WHEN l.learning THEN 'suppressed_learning'
       WHEN f.emitted THEN 'emitted' ELSE 'suppressed' END AS disposition,
  CAST(coalesce(f.carried, 0) AS BIGINT) AS suppressed_since_last
FROM leveled l LEFT JOIN fold f ON f.hostname = l.hostname AND f.template_id = l.template_id AND f.seq = l.seq""",
)
def alert_fold(spark, d):
    return _folded(spark, d).select(
        "hostname", "template_id", "seq", F.col("level").cast("int").alias("level"), "disposition", "suppressed_since_last"
    )


@query(
    "disposition_counts",
    FOLD + """
SELECT l.hostname, count(*) AS processed, count(*) FILTER (f.emitted) AS emitted,
  count(*) FILTER (l.level > 0 AND NOT l.learning AND NOT coalesce(f.emitted, false)) AS suppressed,
  count(*) FILTER (l.level > 0 AND l.learning) AS suppressed_learning
FROM leveled l LEFT JOIN fold f ON f.hostname = l.hostname AND f.template_id = l.template_id AND f.seq = l.seq
GROUP BY ALL""",
)
def disposition_counts(spark, d):
    is_ = lambda n: F.count_if(F.col("disposition") == n).alias(n)
    return _folded(spark, d).groupBy("hostname").agg(
        F.count(F.lit(1)).alias("processed"), is_("emitted"), is_("suppressed"), is_("suppressed_learning")
    )


@query(
    "learning_phase",
    f"""WITH {EV}, a AS (SELECT *, ts_us - min(ts_us) OVER (PARTITION BY hostname) AS age FROM ev)
SELECT hostname, seq, age < 86400000000 AS in_learning,
  CASE WHEN age < 86400000000 THEN (86400000000 - age) // 1000000 END AS remaining_s FROM a""",
)
def learning_phase(spark, d):
    out = S.learning_phase(events(spark, d), 86_400_000_000)
    return out.select("hostname", "seq", "in_learning", F.col("learning_remaining_s").alias("remaining_s"))


@query(
    "snapshot_rows",
    f"""WITH {EZ} SELECT hostname, bucket * 3600000000 AS ts_us, count(*) AS n_events,
  round(count(*) / 3600.0, 6) + 0.0 AS events_per_sec,
  round(arg_max(win_entropy, (ts_us, seq)), 6) + 0.0 AS entropy_bits, round(arg_max(entropy_z, (ts_us, seq)), 6) + 0.0 AS entropy_z,
  arg_max(win_events, (ts_us, seq)) AS events_in_window FROM ez GROUP BY hostname, bucket""",
)
def snapshot_rows(spark, d):
    w = S.entropy_z(stage(S.sliding_window_stats(events(spark, d), WINDOW)), HOUR)
    s = snapshots(w, HOUR, 0)
    return s.select(
        "hostname", "ts_us", F.col("events").alias("n_events"), r6("events_per_sec").alias("events_per_sec"),
        r6("entropy_bits").alias("entropy_bits"), r6("entropy_z").alias("entropy_z"), "events_in_window",
    )


@query(
    "smoothed_history",
    f"""WITH {EV}, c AS (SELECT hostname, bucket, count(*) AS cnt FROM ev GROUP BY ALL)
SELECT hostname, bucket, cnt, round(avg(cnt) OVER (PARTITION BY hostname ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) + 0.0 AS smoothed,
  CAST(cnt - lag(cnt) OVER (PARTITION BY hostname ORDER BY bucket) AS DOUBLE) AS change FROM c""",
)
def smoothed_history(spark, d):
    from pyspark.sql import Window

    c = E.bucket_counts(events(spark, d), ["hostname"], HOUR).withColumnRenamed("count", "cnt")
    w = Window.partitionBy("hostname").orderBy("bucket")
    out = E.smooth_history(c, ["hostname"], "bucket", "cnt")
    return out.select("hostname", "bucket", "cnt", r6("smoothed").alias("smoothed"), r6((F.col("cnt") - F.lag("cnt").over(w)).cast("double")).alias("change"))


@query(
    "counter_rate",
    f"""WITH {EV}, c AS (SELECT hostname, bucket, count(*) AS n FROM ev GROUP BY ALL),
t AS (SELECT hostname, bucket * 3600000000 AS ts_us, CAST(sum(n) OVER (PARTITION BY hostname ORDER BY bucket) AS BIGINT) AS total FROM c)
SELECT hostname, ts_us, total, round(greatest(total - lag(total) OVER w, 0) / greatest((ts_us - lag(ts_us) OVER w) / 1e6, 0.001), 6) + 0.0 AS per_sec
FROM t WINDOW w AS (PARTITION BY hostname ORDER BY ts_us)""",
)
def counter_rate(spark, d):
    from pyspark.sql import Window

    c = E.bucket_counts(events(spark, d), ["hostname"], HOUR)
    w = Window.partitionBy("hostname").orderBy("bucket")
    t = c.select("hostname", (F.col("bucket") * HOUR).alias("ts_us"), F.sum("count").over(w).alias("total"))
    return S.counter_rate(t, "total").select("hostname", "ts_us", "total", r6("total_per_sec").alias("per_sec"))


@query(
    "weighted_median",
    """WITH b AS (SELECT l_returnflag, l_linestatus, l_quantity AS v, sum(l_linenumber) AS w FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus) AS total,
  sum(w) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY v) AS cw, lead(v) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY v) AS nv FROM b)
SELECT l_returnflag, l_linestatus, CAST(any_value(total) AS DOUBLE) AS total_weight,
  CAST(arg_min(CASE WHEN cw = total / 2.0 AND nv IS NOT NULL THEN (v + nv) / 2.0 ELSE v END, v) FILTER (cw >= total / 2.0) AS DOUBLE) AS median
FROM c GROUP BY ALL""",
)
def weighted_median(spark, d):
    out = E.weighted_quantile_mid(
        table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", F.col("l_linenumber").cast("double")
    )
    return out.select("l_returnflag", "l_linestatus", "total_weight", F.col("median").cast("double").alias("median"))


@query(
    "median_mad",
    """WITH m AS (SELECT l_returnflag, median(l_quantity) AS med FROM lineitem GROUP BY ALL)
SELECT l.l_returnflag, CAST(any_value(m.med) AS DOUBLE) AS median, CAST(median(abs(l_quantity - m.med)) AS DOUBLE) AS mad
FROM lineitem l JOIN m USING (l_returnflag) GROUP BY ALL""",
)
def median_mad(spark, d):
    out = E.median_mad(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity")
    return out.select("l_returnflag", F.col("median").cast("double").alias("median"), F.col("mad").cast("double").alias("mad"))


@query(
    "series_z",
    f"""WITH {EV}, c AS (SELECT hostname, bucket, CAST(count(*) AS DOUBLE) AS n FROM ev GROUP BY ALL),
h AS (SELECT *, list(n) OVER (PARTITION BY hostname ORDER BY bucket ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS l FROM c),
m AS (SELECT *, list_aggregate(l, 'median') AS med FROM h),
z AS (SELECT *, list_aggregate(list_transform(l, lambda x: abs(x - med)), 'median') AS mad FROM m)
SELECT hostname, bucket, round(CASE WHEN med IS NULL THEN 0 ELSE greatest(-50, least(50, (n - med) / greatest(mad / 0.6745, 1.0))) END, 6) + 0.0 AS z FROM z""",
)
def series_z(spark, d):
    c = E.bucket_counts(events(spark, d), ["hostname"], HOUR)
    return E.series_z(c, ["hostname"], "bucket", "count", 24, 1.0).select("hostname", "bucket", r6("z").alias("z"))


# --- filters -----------------------------------------------------------------------------------
@query(
    "quiet_filtered",
    f"""SELECT event_id AS seq FROM (SELECT *, {MSG} AS message FROM events)
WHERE NOT (regexp_matches(message, '\\btook [0-4] ms\\b') OR (event_type = 'view' AND regexp_matches(message, '/api/v[36]/')))""",
)
def quiet_filtered(spark, d):
    ev = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("unit"), msg().alias("message"))
    rules = (QuietRule(r"\btook [0-4] ms\b"), QuietRule(r"/api/v[36]/", "view"), QuietRule("(unbalanced"))
    return FL.quiet_filter(ev, rules).select("seq")


@query(
    "self_filtered",
    f"""WITH {EV},
sup AS (SELECT hostname, unit, ts_us AS f, ts_us + 3600000000 AS u FROM ev WHERE value >= 100),
pids AS (SELECT hostname, user_id, ts_us AS f, ts_us + 86400000000 AS u FROM ev WHERE unit = 'signup')
SELECT seq FROM ev e
WHERE NOT EXISTS (SELECT 1 FROM sup s WHERE s.hostname = e.hostname AND s.unit = e.unit AND e.ts_us >= s.f AND e.ts_us < s.u)
  AND NOT EXISTS (SELECT 1 FROM pids p WHERE p.hostname = e.hostname AND p.user_id = e.user_id AND e.ts_us >= p.f AND e.ts_us < p.u)""",
)
def self_filtered(spark, d):
    ev = events(spark, d).withColumn("pid", F.col("user_id").cast("int"))
    entry = lambda cond, kind, key, span: ev.where(cond).select(
        "hostname", F.lit(kind).alias("kind"), key.alias("key"), F.col("ts_us").alias("from_us"), (F.col("ts_us") + span).alias("until_us")
    )
    sup = entry(F.col("value") >= 100, "unit", F.col("unit"), HOUR).unionByName(
        entry(F.col("unit") == "signup", "pid", F.col("user_id").cast("string"), 24 * HOUR)
    )
    return FL.self_filter(ev, sup).select("seq")


@query(
    "mute_filtered",
    f"""WITH {EV},
m AS (SELECT hostname, template_id, CASE WHEN user_id % 2 = 0 THEN unit END AS unit, ts_us AS f,
  CASE WHEN value >= 200 THEN 9223372036854775807 ELSE ts_us + 3600000000 END AS u FROM ev WHERE value >= 100)
SELECT seq FROM ev e WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.hostname = e.hostname AND m.template_id = e.template_id
  AND (m.unit IS NULL OR m.unit = e.unit) AND e.ts_us >= m.f AND e.ts_us < m.u)""",
)
def mute_filtered(spark, d):
    ev = events(spark, d)
    mutes = ev.where(F.col("value") >= 100).select(
        "hostname", "template_id", F.when(F.col("user_id") % 2 == 0, F.col("unit")).alias("unit"),
        F.col("ts_us").alias("from_us"), F.when(F.col("value") < 200, F.col("ts_us") + HOUR).alias("until_us"),
    )
    return FL.mute_filter(ev, mutes).select("seq")


@query(
    "replay_range",
    f"""WITH {EV} SELECT seq FROM ev WHERE ts_us >= 1704672000000000 AND ts_us < 1705276800000000""",
)
def replay_range(spark, d):
    return FL.replay_range(events(spark, d), 1704672000000000, 1705276800000000).select("seq")
