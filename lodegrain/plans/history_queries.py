"""Queries of commit history over orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from .catalog import Views, query
from .fixtures import COMMIT_FILES, COMMITS, TOUCHES, commit_files, commits

AS_OF = 915_148_800  # 1999-01-01


def touched(v: Views):
    return H.touches(commit_files(v), commits(v))


_SPOTS = TOUCHES + f""", spots AS (SELECT path, count(*) AS commits, CASE WHEN count(*) <= 1 THEN CAST(count(*) AS DOUBLE) ELSE
  least(100.0, 600.0 * count(*) / greatest((max(epoch) - min(epoch)) / 86400.0, 1.0)) * exp(-0.05 * ({AS_OF} - max(epoch)) / 86400.0) END AS hotspot FROM touches GROUP BY path)"""
_TAGS = """, tags AS (SELECT path, count_if(fix) AS fix, count_if(rev) AS revert, count_if(refa) AS refactor, count_if(feat) AS feature, count_if(sec) AS security,
  count_if(perf) AS performance FROM touches GROUP BY path)"""
_CHAINS = """, pairs AS (SELECT *, coalesce(fix AND lag(fix) OVER w AND epoch - lag(epoch) OVER w < 172800, false) AS pair FROM touches WINDOW w AS (PARTITION BY path ORDER BY epoch, commit_id)),
chains AS (SELECT path, count_if(pair AND NOT before) AS chains FROM (SELECT *, coalesce(lag(pair) OVER (PARTITION BY path ORDER BY epoch, commit_id), false) AS before FROM pairs) GROUP BY path)"""
_RISK = """, risks AS (SELECT path, CASE WHEN security > 0 OR revert > 2 THEN 'HIGH' WHEN fix > 0 AND fix > commits // 2 THEN 'MEDIUM' WHEN hotspot > 50 THEN 'MEDIUM' ELSE 'LOW' END AS risk
  FROM spots JOIN tags USING (path))"""
_CO = """, pairings AS (SELECT a.path, b.path AS other, count(*) AS together FROM commit_files a JOIN commit_files b ON a.commit_id = b.commit_id AND a.path <> b.path GROUP BY ALL HAVING count(*) >= 2),
co AS (SELECT path, other, together, together / total AS ratio, row_number() OVER (PARTITION BY path ORDER BY together DESC, other) AS rank
  FROM pairings JOIN (SELECT path, count(*) AS total FROM commit_files GROUP BY path) USING (path))"""


@query("SELECT path, commits, round(hotspot, 6) AS hotspot FROM spots", _SPOTS)
def file_hotspots(v: Views):
    return H.file_hotspots(touched(v), AS_OF).withColumn("hotspot", F.round("hotspot", 6))


@query("SELECT * FROM (SELECT path, author, count(*) AS commits, CAST(row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, author) AS INT) AS rank FROM touches GROUP BY path, author) WHERE rank <= 5", TOUCHES)
def top_authors(v: Views):
    return H.top_authors(touched(v))


@query("SELECT * FROM tags", TOUCHES + _TAGS)
def tag_counts(v: Views):
    return H.tag_counts(touched(v))


@query("SELECT * FROM risks", _SPOTS + _TAGS + _RISK)
def risk_indicator(v: Views):
    return H.risk_indicator(H.file_hotspots(touched(v), AS_OF), H.tag_counts(touched(v)))


@query("SELECT path, max_by(commit_id, (epoch, commit_id)) AS commit_id FROM touches WHERE fix GROUP BY path", TOUCHES)
def last_fix_commit(v: Views):
    return H.last_fix_commit(touched(v))


@query("SELECT * FROM chains", TOUCHES + _CHAINS)
def fix_chains(v: Views):
    return H.fix_chains(touched(v))


@query("SELECT path, CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE greatest(0.0, 1 - chains / n) END AS convergence, chains / n AS rigidity FROM chains JOIN (SELECT path, count(*) AS n FROM touches GROUP BY path) USING (path)", TOUCHES + _CHAINS)
def stability(v: Views):
    return H.stability(touched(v))


@query("SELECT path, other, together, ratio, CAST(rank AS INT) AS rank FROM co WHERE rank <= 10", COMMIT_FILES + _CO)
def co_changes(v: Views):
    return H.co_changes(commit_files(v))


@query("""SELECT path, t.commit_id FROM touches t WHERE EXISTS (SELECT 1 FROM blame b WHERE b.path = t.path AND b.commit_id = t.commit_id AND line_start <= 90 AND line_start + n_lines > 40)
  OR NOT EXISTS (SELECT 1 FROM blame b WHERE b.path = t.path AND line_start <= 90 AND line_start + n_lines > 40)""",
       TOUCHES + ", blame AS (SELECT l_partkey AS path, l_orderkey AS commit_id, (l_orderkey * 7 + l_linenumber) % 200 AS line_start, l_linenumber AS n_lines FROM lineitem)")
def scope_to_lines(v: Views):
    blame = v.lineitem.select(F.col("l_partkey").alias("path"), F.col("l_orderkey").alias("commit_id"), ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 200).alias("line_start"), F.col("l_linenumber").alias("n_lines"))
    return H.scope_to_lines(touched(v), blame, 40).select("path", "commit_id")


@query("""SELECT path, tag, count(*) AS commits, coalesce(array_to_string(list_sort(list_distinct(list(scope)))[1:3], ','), '') AS scopes,
  any_value(CASE WHEN days = 0 THEN 'today' WHEN days = 1 THEN '1 day' WHEN days < 14 THEN days || ' days' WHEN days < 60 THEN (days // 7) || ' weeks' ELSE (days // 30) || ' months' END) AS span
  FROM (SELECT path, nullif(regexp_extract(message, '^[^(]*\\(([^)]*)\\):', 1), '') AS scope, (max(epoch) OVER (PARTITION BY path) - min(epoch) OVER (PARTITION BY path)) // 86400 AS days,
    unnest(CASE WHEN len(tags) > 0 THEN tags ELSE ['other'] END) AS tag
    FROM (SELECT *, list_filter([CASE WHEN fix THEN 'fix' END, CASE WHEN rev THEN 'revert' END, CASE WHEN refa THEN 'refactor' END, CASE WHEN feat THEN 'feature' END, CASE WHEN sec THEN 'security' END,
      CASE WHEN perf THEN 'performance' END, CASE WHEN test THEN 'test' END, CASE WHEN docs THEN 'docs' END], lambda x: x IS NOT NULL) AS tags FROM touches)) GROUP BY path, tag""", TOUCHES)
def commit_intent_summary(v: Views):
    return H.commit_intent_summary(touched(v))


@query("SELECT max_by(commit_id, (epoch, commit_id)) AS head, count(*) AS commits, count(DISTINCT author) AS authors, min(epoch) AS first_epoch, max(epoch) AS last_epoch FROM commits", COMMITS)
def repo_summary(v: Views):
    return H.repo_summary(commits(v))


@query("""SELECT path, commits, round(hotspot, 6) AS hotspot, risk, chains, other AS partner FROM (SELECT * FROM spots ORDER BY hotspot DESC, path LIMIT 20) JOIN risks USING (path) JOIN chains USING (path)
  LEFT JOIN (SELECT path, other FROM co WHERE rank = 1) USING (path)""", _SPOTS + _TAGS + _RISK + _CHAINS + _CO)
def riskiest_files(v: Views):
    return H.riskiest_files(commit_files(v), commits(v), AS_OF).withColumn("hotspot", F.round("hotspot", 6))
