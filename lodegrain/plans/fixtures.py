"""Supplied tables in the roles of commits, activity, spans and graphs; the same views for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import Views

MESSAGES = ["fix(core): resolve crash", "fix(api): patch bug", "revert: undo change", "refactor(io): cleanup", "feat(core): add widget",
            "security: close leak", "perf: cache rows", "test: assert order", "docs: update readme", "chore: bump"]
KINDS = {"view": "search_query", "click": "symbol_resolved", "purchase": "file_change", "error": "diagnostic", "signup": "tool_call"}


def epoch(column: str) -> F.Column:
    return F.unix_seconds(F.col(column).cast("timestamp"))


def commits(v: Views) -> DataFrame:
    message = F.get(F.array(*[F.lit(m) for m in MESSAGES]), (F.col("o_orderkey") % 10).cast("int"))
    return v.orders.select(F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("author"), epoch("o_orderdate").alias("epoch"), message.alias("message"))


def commit_files(v: Views) -> DataFrame:
    return v.lineitem.select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("path")).distinct()


def activity(v: Views) -> DataFrame:
    kind = F.coalesce(*[F.when(F.col("event_type") == k, x) for k, x in KINDS.items()], F.lit("other"))
    k = F.get_json_object("props", "$.k").cast("long")
    return v.events.select(
        F.col("user_id").alias("session"), "event_id", epoch("ts").alias("epoch"), kind.alias("kind"), F.when(kind == "tool_call", "scan").alias("tool"),
        F.concat(F.lit("m"), F.floor(k / 10)).alias("module"), F.concat(F.lit("m"), F.floor(k / 10), F.lit("/f"), k).alias("subject"))


def spans(v: Views) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return v.events.select(F.col("event_id").alias("span_id"), F.concat_ws(":", "event_type", k).alias("location"), F.col("value").alias("duration_ms"), F.col("ts").cast("timestamp").alias("ts"))


def edges(v: Views) -> DataFrame:
    """Every lineitem row as an edge from its part to a part drawn from its order, never to itself; parts divisible by four
    lead to such parts only. The parts are the nodes, so the graph grows with the tables."""
    n = v.part.agg((F.max("p_partkey") + 1).alias("n"))
    k = F.col("l_orderkey") * 3 + F.col("l_linenumber")
    step = F.when(F.col("l_partkey") % 4 == 0, 4 * (1 + k % F.greatest(F.expr("n div 4") - 1, F.lit(1)))).otherwise(1 + k % F.greatest(F.col("n") - 1, F.lit(1)))
    # one row
    rows = v.lineitem.join(F.broadcast(n), F.lit(True)).select(F.col("l_partkey").alias("src"), ((F.col("l_partkey") + step) % F.col("n")).alias("dst"))
    return rows.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def modules(v: Views) -> DataFrame:
    """Every part as a module, named as in `edges`."""
    return v.part.select(F.col("p_partkey").alias("module"), F.col("p_size").alias("functions"), (F.col("p_size") * 2).alias("symbols"), (F.col("p_size") * 40).alias("lines"))


_TS = "CAST(floor(epoch({})) AS BIGINT)"
COMMITS = f"""commits AS (SELECT o_orderkey AS commit_id, o_custkey AS author, {_TS.format('o_orderdate')} AS epoch,
  {MESSAGES}[o_orderkey % 10 + 1] AS message FROM orders)"""
COMMIT_FILES = "commit_files AS (SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS path FROM lineitem)"
TAGGED = COMMITS + """,
tagged AS (SELECT *, regexp_matches(lower(message), 'fix|bug|patch|hotfix|resolve') AS fix, regexp_matches(lower(message), 'revert|rollback|undo') AS rev,
  regexp_matches(lower(message), 'refactor|cleanup|restructure') AS refa, regexp_matches(lower(message), 'feat|add |new |implement|introduce') AS feat,
  regexp_matches(lower(message), 'security|vuln|cve|xss|injection|leak') AS sec, regexp_matches(lower(message), 'perf|optim|speed|fast|cache') AS perf,
  regexp_matches(lower(message), 'test|spec|assert') AS test, regexp_matches(lower(message), 'doc|readme|comment') AS docs FROM commits)"""
TOUCHES = TAGGED + ", " + COMMIT_FILES + ", touches AS (SELECT path, t.* FROM commit_files JOIN tagged t USING (commit_id))"
ACTIVITY = f"""activity AS (SELECT user_id AS session, event_id, {_TS.format('ts')} AS epoch,
  CASE event_type WHEN 'view' THEN 'search_query' WHEN 'click' THEN 'symbol_resolved' WHEN 'purchase' THEN 'file_change' WHEN 'error' THEN 'diagnostic'
    WHEN 'signup' THEN 'tool_call' ELSE 'other' END AS kind, CASE WHEN event_type = 'signup' THEN 'scan' END AS tool,
  'm' || CAST(floor(k / 10) AS BIGINT) AS module, 'm' || CAST(floor(k / 10) AS BIGINT) || '/f' || k AS subject
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""
SPANS = "spans AS (SELECT event_id AS span_id, event_type || ':' || json_extract_string(props, '$.k') AS location, value AS duration_ms, ts FROM events)"
EDGES = """edges AS (SELECT src, dst, count(*) AS weight FROM (SELECT l_partkey AS src, (l_partkey + CASE WHEN l_partkey % 4 = 0 THEN 4 * (1 + k % greatest(n // 4 - 1, 1)) ELSE 1 + k % greatest(n - 1, 1) END) % n AS dst
  FROM (SELECT l_partkey, l_orderkey * 3 + l_linenumber AS k FROM lineitem), (SELECT max(p_partkey) + 1 AS n FROM part)) GROUP BY ALL)"""
MODULES = "modules AS (SELECT p_partkey AS module, p_size AS functions, p_size * 2 AS symbols, p_size * 40 AS lines FROM part)"
