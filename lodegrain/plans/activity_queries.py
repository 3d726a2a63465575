"""Queries of spans and session activity over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import activity as A
from ..operators import telemetry as T
from .catalog import Views, query
from .fixtures import ACTIVITY, SPANS, activity, spans

NOW = 1_704_067_200 + 30 * 86400


@query("""SELECT location, n, round(total_ms, 6) AS total_ms, round(avg_ms, 6) AS avg_ms, max_ms, p95_ms FROM (SELECT location, count(*) AS n, sum(duration_ms) AS total_ms, avg(duration_ms) AS avg_ms, max(duration_ms) AS max_ms,
  max(CASE WHEN r - 1 = ceil(0.95 * (c - 1)) THEN duration_ms END) AS p95_ms FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY duration_ms, span_id) AS r, count(*) OVER (PARTITION BY location) AS c FROM spans) GROUP BY location)""", SPANS)
def span_metrics(v: Views):
    return T.span_metrics(spans(v)).drop("last_seen").withColumns({c: F.round(c, 6) for c in ("total_ms", "avg_ms")})


@query("""SELECT location, n, round(avg_ms, 6) AS avg_ms, CASE WHEN avg_ms > 200 THEN 'hot' WHEN avg_ms >= 50 THEN 'warm' ELSE 'cool' END AS heat FROM (SELECT location, count(*) AS n, avg(duration_ms) AS avg_ms FROM spans GROUP BY location)
  ORDER BY avg_ms DESC, location LIMIT 10""", SPANS)
def span_hotspots(v: Views):
    return T.hotspots(T.span_metrics(spans(v))).select("location", "n", F.round("avg_ms", 6).alias("avg_ms"), "heat")


@query("SELECT count(*) AS spans, count(DISTINCT location) AS locations, least(count(*) / 1000, 1.0) AS fill FROM spans", SPANS)
def span_store_stats(v: Views):
    return T.span_store_stats(spans(v))


@query("SELECT p.span_id, p.path, p.line, min_by(name, ordinal) AS symbol FROM points p LEFT JOIN symbols s ON s.path = p.path AND line BETWEEN line_start AND line_end GROUP BY ALL",
       """bound AS (SELECT max(p_partkey) + 1 AS n FROM part), points AS (SELECT event_id AS span_id, event_type AS path, CAST(event_id * 7 % (n * 12 + 20) AS INT) AS line FROM events, bound),
  symbols AS (SELECT path, name, ordinal, ordinal * 12 + 1 AS line_start, ordinal * 12 + 1 + ordinal % 5 * 9 AS line_end FROM (SELECT event_type AS path FROM events GROUP BY 1), (SELECT CAST(p_partkey AS INT) AS ordinal, p_name AS name FROM part))""")
def attribute_spans(v: Views):
    """Every part is a symbol of every path; the spans' lines lie over all of them."""
    n = v.part.agg((F.max("p_partkey") + 1).alias("n"))
    # one row
    points = v.events.join(F.broadcast(n), F.lit(True))
    points = points.select(F.col("event_id").alias("span_id"), F.col("event_type").alias("path"), (F.col("event_id") * 7 % (F.col("n") * 12 + 20)).cast("int").alias("line"))
    names = v.part.select(F.col("p_partkey").cast("int").alias("ordinal"), F.col("p_name").alias("name"))
    paths = v.events.select(F.col("event_type").alias("path")).distinct()
    symbols = names.join(paths, F.lit(True))  # all parts in each of the few types of events
    symbols = symbols.withColumn("line_start", F.col("ordinal") * 12 + 1).withColumn("line_end", F.col("line_start") + F.col("ordinal") % 5 * 9)
    return T.attribute_spans(points, symbols)


_SCORES = ACTIVITY + f", scores AS (SELECT kind, subject, sum(exp(-ln(2) / 86400 * greatest({NOW} - epoch, 0))) AS score, count(*) AS n FROM activity GROUP BY ALL)"


@query("SELECT kind, subject, round(score, 9) AS score, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, subject) AS rank FROM scores) WHERE rank <= 10", _SCORES)
def decayed_top(v: Views):
    return T.decayed_top(activity(v), NOW, half_life_s=86400).withColumn("score", F.round("score", 9))


@query("SELECT kind, CAST(sum(n) AS BIGINT) AS events, count(*) AS distinct_values, round(sum(score), 6) AS total_score FROM scores GROUP BY kind", _SCORES)
def activity_snapshot(v: Views):
    return T.activity_snapshot(activity(v), NOW, half_life_s=86400).withColumn("total_score", F.round("total_score", 6))


@query("""SELECT session, count(*) AS events, count_if(kind = 'search_query') AS searches, count_if(kind = 'symbol_resolved') AS symbols, count_if(kind = 'file_change') AS changes,
  count_if(kind = 'diagnostic') AS diagnostics, count_if(kind = 'tool_call') AS tool_calls FROM activity GROUP BY session""", ACTIVITY)
def event_counters(v: Views):
    return T.event_counters(activity(v))


@query("""SELECT runs, round(avg_parse, 6) AS avg_parse, round(avg_rank, 6) AS avg_rank, round(avg_pack, 6) AS avg_pack, min_total, round(avg_total, 6) AS avg_total, max_total, p95_total, 'rank' AS bottleneck, round(avg_rank / avg_total, 6) AS share
  FROM (SELECT count(*) AS runs, avg(value * 0.25) AS avg_parse, avg(value * 0.5) AS avg_rank, avg(value * 0.25) AS avg_pack, min(value) AS min_total, avg(value) AS avg_total, max(value) AS max_total, quantile_disc(value, 0.95) AS p95_total FROM events)""")
def pipeline_stage_stats(v: Views):
    runs = v.events.select(F.col("event_id").alias("run_id"), (F.col("value") * 0.25).alias("parse"), (F.col("value") * 0.5).alias("rank"), (F.col("value") * 0.25).alias("pack"))
    return T.pipeline_stage_stats(runs, ["parse", "rank", "pack"]).withColumns({c: F.round(c, 6) for c in ("avg_parse", "avg_rank", "avg_pack", "avg_total", "share")})


@query("""SELECT check_id, errors, warnings, coalesce(sign(errors + warnings - lag(errors + warnings) OVER (ORDER BY check_id)), 0)::INT AS trend FROM
  (SELECT event_id // 100 AS check_id, count_if(event_type = 'error') AS errors, count_if(event_type = 'click') AS warnings FROM events GROUP BY 1)""")
def diagnostic_counts(v: Views):
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warning").otherwise("info")
    return T.diagnostic_counts(v.events.select(F.expr("event_id div 100").alias("check_id"), level.alias("level")))


_FAST = ACTIVITY + ", fast AS (SELECT session, event_id, epoch // 1000 AS epoch, kind, tool, module, subject FROM activity), slow AS (SELECT session, event_id, epoch // 200 AS epoch, kind, tool, module, subject FROM activity)"


def scaled(v: Views, by: int):
    return activity(v).withColumn("epoch", F.expr(f"epoch div {by}"))


@query("""SELECT session, cause_id, effect_id, kind, latency_s FROM (SELECT e.session, e.event_id AS effect_id, e.kind, c.event_id AS cause_id, e.epoch - c.epoch AS latency_s,
  row_number() OVER (PARTITION BY e.event_id ORDER BY c.epoch DESC, c.event_id DESC) AS r FROM fast e JOIN fast c ON c.session = e.session AND c.kind = 'file_change' AND (c.epoch, c.event_id) < (e.epoch, e.event_id) WHERE e.kind = 'diagnostic')
  WHERE r = 1 AND latency_s <= 10""", _FAST)
def causal_links(v: Views):
    return A.causal_links(scaled(v, 1000))


_PHASES = _FAST + """, marked AS (SELECT *, lag(module) OVER w AS pm, lag(epoch) OVER w AS pe FROM slow WINDOW w AS (PARTITION BY session ORDER BY epoch, event_id)),
numbered AS (SELECT *, CAST(sum(CASE WHEN module <> pm OR epoch - pe > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY epoch, event_id) AS BIGINT) AS phase FROM marked),
phased AS (SELECT session, phase, max(module) AS module, count(*) AS events, max(epoch) - min(epoch) AS duration_s, min(epoch) AS start, CAST(least(count(DISTINCT CASE WHEN kind = 'file_change' THEN subject END), 10) AS INT) AS files,
  count_if(kind IN ('search_query', 'symbol_resolved')) AS r, count_if(kind = 'file_change') AS w, count_if(kind = 'diagnostic') AS f, count_if(kind = 'tool_call') AS s FROM numbered GROUP BY session, phase),
phases AS (SELECT session, phase, module, events, duration_s, start, files, CASE WHEN r + w + f + s = 0 THEN 'Mixed' WHEN f * 100 // (r + w + f + s) >= 40 THEN 'Debugging' WHEN s * 100 // (r + w + f + s) >= 40 THEN 'Hardening'
  WHEN w * 100 // (r + w + f + s) >= 40 THEN 'Coding' WHEN r * 100 // (r + w + f + s) >= 40 THEN 'Exploring' ELSE 'Mixed' END AS activity, phase = max(phase) OVER (PARTITION BY session) AS active FROM phased)"""


@query("SELECT * FROM phases", _PHASES)
def journey_phases(v: Views):
    return A.journey_phases(scaled(v, 200))


@query("""SELECT session, phase, CASE WHEN swings THEN m[6] || ',' || m[5] ELSE m[6] END AS modules, CAST(CASE WHEN swings THEN 3 ELSE same END AS INT) AS oscillations FROM (
  SELECT *, m[6] <> m[5] AND m[6] = m[4] AND m[6] = m[2] AND m[5] = m[3] AND m[5] = m[1] AS swings, len(list_filter(m, lambda x: x = m[6])) AS same FROM (
  SELECT session, phase, list(module) OVER (PARTITION BY session ORDER BY phase ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS m FROM phases) WHERE len(m) >= 6) WHERE swings OR same >= 3""", _PHASES)
def loop_alerts(v: Views):
    return A.loop_alerts(A.journey_phases(scaled(v, 200)))


_TOOL = "[{}][event_id % 5 + 1]".format(", ".join(f"'{t}'" for t in ("search", "check", "scan", "note", "ask")))


@query("""SELECT session, event_id, CASE WHEN s >= d AND s >= i THEN 'Stabilization' WHEN i >= d THEN 'Implementation' ELSE 'Discovery' END AS session_phase FROM (SELECT session, event_id, count_if(tool IN ('search', 'ask')) OVER w AS d,
  count_if(tool = 'check') OVER w AS i, count_if(tool = 'scan') OVER w AS s FROM (SELECT session, event_id, epoch, """ + _TOOL + " AS tool FROM activity) WHERE tool <> 'note' WINDOW w AS (PARTITION BY session ORDER BY epoch, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))", ACTIVITY)
def session_phase(v: Views):
    tools = F.array(*[F.lit(t) for t in ("search", "check", "scan", "note", "ask")])
    return A.session_phase(activity(v).withColumn("tool", F.get(tools, (F.col("event_id") % 5).cast("int"))))


_METRICS = ", newest AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY epoch DESC, event_id DESC) AS place FROM fast), recent AS (SELECT *, max(CASE WHEN place = 1 THEN subject END) OVER (PARTITION BY session) AS top, max(epoch) OVER (PARTITION BY session) AS latest FROM newest WHERE place <= 15)" + """,
metrics AS (SELECT session, count(*) AS n, CASE WHEN count(*) < 2 THEN 999.0::DOUBLE ELSE (max(epoch) - min(epoch)) / (count(*) - 1) END AS avg_interval, count(DISTINCT module) AS modules, count(DISTINCT subject) AS subjects, count(DISTINCT subject) / count(*) AS variance,
  count_if(subject = top AND latest - epoch <= 120) AS repeats, CASE WHEN count_if(kind IN ('search_query', 'symbol_resolved', 'file_change')) > 0 THEN count_if(kind IN ('search_query', 'symbol_resolved')) / count_if(kind IN ('search_query', 'symbol_resolved', 'file_change')) ELSE 0.5 END AS read_ratio FROM recent GROUP BY session)"""


@query("SELECT session, n, round(avg_interval, 6) AS avg_interval, modules, subjects, round(variance, 6) AS variance, repeats, round(read_ratio, 6) AS read_ratio FROM metrics", _FAST + _METRICS)
def session_metrics(v: Views):
    return A.session_metrics(scaled(v, 1000)).withColumns({c: F.round(c, 6) for c in ("avg_interval", "variance", "read_ratio")})


@query("""SELECT session, CASE WHEN n < 3 THEN 'RapidScaffolding' WHEN errors >= 5 AND avg_interval < 10 THEN 'EmergencyPatching' WHEN repeats >= 3 THEN 'IterativeDistress' WHEN errors > 0 AND session % 3 = 0 THEN 'DeepBackendLogic'
  WHEN modules >= 3 AND variance > 0.6 AND session % 2 = 0 THEN 'ArchitectureWiring' WHEN read_ratio > 0.7 AND variance > 0.5 AND session % 9 > 3 THEN 'ExploratoryRefactoring' WHEN session % 9 <= 2 AND avg_interval < 15 AND subjects > 3 THEN 'RapidScaffolding' ELSE 'MomentumFlow' END AS moment
  FROM (SELECT session, n, avg_interval, CASE WHEN session % 2 = 0 THEN modules ELSE 2 END AS modules, subjects, variance, repeats, read_ratio, errors FROM metrics JOIN (SELECT session, count_if(kind = 'diagnostic') AS errors FROM activity GROUP BY 1) USING (session))""", _FAST + _METRICS)
def operational_moment(v: Views):
    metrics = A.session_metrics(scaled(v, 1000)).join(activity(v).groupBy("session").agg(F.count_if(F.col("kind") == "diagnostic").alias("errors")), "session")
    s = F.col("session")
    metrics = metrics.withColumns({"modules": F.when(s % 2 == 0, F.col("modules")).otherwise(2), "activity": F.when(s % 3 == 0, "Debugging").otherwise("Coding"), "phases": s % 9, "looping": F.lit(False), "trend": F.lit(0)})
    return A.operational_moment(metrics).select("session", "moment")


_MOMENTS = _PHASES.replace("FROM slow", "FROM fast") + _METRICS + """, reports AS (SELECT session, e[1] AS errors, coalesce(sign(e[1] - e[2]), 0) AS trend FROM (SELECT session, list(event_id % 7 ORDER BY epoch DESC, event_id DESC) AS e FROM fast WHERE kind = 'diagnostic' GROUP BY session)),
loops AS (SELECT session, m[6] <> m[5] AND m[6] = m[4] AND m[6] = m[2] AND m[5] = m[3] AND m[5] = m[1] OR len(list_filter(m, lambda x: x = m[6])) >= 3 AS looping FROM (
  SELECT session, active, list(module) OVER (PARTITION BY session ORDER BY phase ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS m FROM phases) WHERE active AND len(m) >= 6)"""


@query("""SELECT session, CASE WHEN n < 3 THEN 'RapidScaffolding' WHEN errors >= 5 AND avg_interval < 10 THEN 'EmergencyPatching' WHEN repeats >= 3 OR looping THEN 'IterativeDistress' WHEN errors > 0 AND activity = 'Debugging' THEN 'DeepBackendLogic'
  WHEN modules >= 3 AND variance > 0.6 THEN 'ArchitectureWiring' WHEN activity = 'Hardening' THEN 'CrossLayerConsistency' WHEN read_ratio > 0.7 AND variance > 0.5 AND phases > 3 THEN 'ExploratoryRefactoring'
  WHEN modules <= 1 AND read_ratio < 0.3 AND errors = 0 THEN 'DeepBackendLogic' WHEN phases <= 2 AND avg_interval < 15 AND subjects > 3 THEN 'RapidScaffolding' WHEN trend < 0 AND errors = 0 THEN 'CrossLayerConsistency' ELSE 'MomentumFlow' END AS moment
  FROM (SELECT m.*, p.phase + 1 AS phases, p.activity, coalesce(looping, false) AS looping, coalesce(errors, 0) AS errors, coalesce(trend, 0) AS trend FROM metrics m JOIN (SELECT * FROM phases WHERE active) p USING (session) LEFT JOIN loops USING (session) LEFT JOIN reports USING (session))""", _MOMENTS)
def session_moments(v: Views):
    """From the events alone; a diagnostic reports as many errors as its number leaves modulo 7."""
    rows = scaled(v, 1000).withColumn("errors", F.when(F.col("kind") == "diagnostic", F.col("event_id") % 7))
    return A.session_moments(rows).select("session", "moment")


@query("""SELECT session, phase, module, before AS trigger FROM (SELECT *, lag(module) OVER (PARTITION BY session ORDER BY phase) AS before FROM phases) WHERE (CAST(module[2:] AS INT) + CAST(before[2:] AS INT)) % 3 = 0 AND module <> before""", _PHASES)
def triggered_by(v: Views):
    names = activity(v).select("module").distinct()
    number = lambda c: F.substring(c, 2, 9).cast("int")
    left, right = (names.withColumnRenamed("module", c).withColumn("m", (sign * number(c) % 3 + 3) % 3) for c, sign in (("src", 1), ("dst", -1)))
    pairs = left.join(right, "m").where(F.col("src") != F.col("dst")).drop("m")
    return A.triggered_by(A.journey_phases(scaled(v, 200)), pairs)


@query("""SELECT l.event_id, l.session, l.epoch, r.name FROM (SELECT event_id, session, epoch FROM activity WHERE kind <> 'file_change') l ASOF LEFT JOIN (SELECT session, epoch, max(event_id) AS name FROM activity WHERE kind = 'file_change' GROUP BY ALL) r
  ON l.session = r.session AND l.epoch >= r.epoch""", ACTIVITY)
def nearest_preceding(v: Views):
    rows = activity(v)
    right = rows.where("kind = 'file_change'").groupBy("session", "epoch").agg(F.max("event_id").alias("name"))
    return A.nearest_preceding(rows.where("kind <> 'file_change'").select("event_id", "session", "epoch"), right, "session", "epoch", "name")
