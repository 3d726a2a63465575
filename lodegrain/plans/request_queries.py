"""Queries of request tables: orders as requests, their line items as targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import requests as Q
from .catalog import Views, query
from .fixtures import COMMIT_FILES, COMMITS, commit_files, commits

_TARGETS = """targets AS (SELECT l_orderkey AS request_id, l_linenumber AS target_id, ['core/a', 'core/b/c', 'web/x/y', 'web/vendor/z', 'ops/d'][(l_partkey + l_linenumber) % 5 + 1] || '/f' || l_partkey % 3 AS path, l_extendedprice AS score, 'n' || l_suppkey AS name FROM lineitem)"""


def targets(v: Views):
    folder = F.get(F.array(*[F.lit(x) for x in ("core/a", "core/b/c", "web/x/y", "web/vendor/z", "ops/d")]), ((F.col("l_partkey") + F.col("l_linenumber")) % 5).cast("int"))
    return v.lineitem.select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("target_id"), F.concat(folder, F.lit("/f"), F.col("l_partkey") % 3).alias("path"), F.col("l_extendedprice").alias("score"), F.concat(F.lit("n"), "l_suppkey").alias("name"))


_ITEMS = "items AS (SELECT l_orderkey AS request_id, l_linenumber AS item_id, l_quantity::BIGINT * 20 AS size, l_returnflag = 'R' AS critical, l_extendedprice AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag <> 'R', l_extendedprice DESC, l_linenumber) AS r FROM lineitem)"


@query("SELECT request_id, item_id, taken FROM fold WHERE taken > 0", "RECURSIVE " + _ITEMS + """, fold AS (SELECT request_id, 0::BIGINT AS r, NULL::INT AS item_id, 0::BIGINT AS taken, 1500::BIGINT AS free, 800::BIGINT AS pool UNION ALL
  SELECT request_id, r, item_id, t, CASE WHEN critical THEN free ELSE free - t END, CASE WHEN critical THEN pool - t ELSE pool END FROM (SELECT i.request_id, i.r, i.item_id, critical, free, pool,
    CASE WHEN size <= CASE WHEN critical THEN pool ELSE free END THEN size WHEN CASE WHEN critical THEN pool ELSE free END >= 200 THEN CASE WHEN critical THEN pool ELSE free END ELSE 0 END AS t FROM fold f JOIN items i ON i.request_id = f.request_id AND i.r = f.r + 1))""".replace("SELECT request_id, 0::BIGINT AS r", "SELECT DISTINCT request_id, 0::BIGINT AS r").replace("AS pool UNION ALL", "AS pool FROM items UNION ALL"))
def budget_pack(v: Views):
    items = v.lineitem.select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").alias("item_id"), (F.col("l_quantity").cast("long") * 20).alias("size"), (F.col("l_returnflag") == "R").alias("critical"), F.col("l_extendedprice").alias("score"))
    return Q.budget_pack(items, 1500, 800)


@query("""SELECT request_id, target_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, target_id) AS place FROM (SELECT *, count(*) OVER (PARTITION BY request_id) AS n, row_number() OVER (PARTITION BY request_id, path ORDER BY score DESC, target_id) AS p
  FROM targets WHERE NOT contains(path, '/vendor/')) WHERE n <= 2 OR p = 1) WHERE n <= 2 OR place <= 2""", _TARGETS)
def prune_to_tier(v: Views):
    return Q.prune_to_tier(targets(v), 2).select("request_id", "target_id")


_PREFIXED = _TARGETS + ", prefixed AS (SELECT *, string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS module FROM targets)"


@query("""SELECT request_id, target_id FROM prefixed JOIN (SELECT request_id, count(*) AS n, count(DISTINCT module) AS m FROM prefixed GROUP BY 1) USING (request_id)
  JOIN (SELECT request_id, module, row_number() OVER (PARTITION BY request_id ORDER BY max(score) DESC, count(*) DESC, module) AS r FROM prefixed GROUP BY 1, 2) USING (request_id, module) WHERE n <= 2 OR 1 - (m - 1) / greatest(n - 1, 1) >= 0.4 OR r <= 1""", _PREFIXED)
def coherence_gate(v: Views):
    return Q.coherence_gate(targets(v), 1).select("request_id", "target_id")


@query("""SELECT request_id, target_id FROM prefixed JOIN (SELECT request_id, count(*) AS n FROM prefixed GROUP BY 1) USING (request_id)
  JOIN (SELECT request_id, module, row_number() OVER (PARTITION BY request_id ORDER BY count(*) DESC, module) AS r FROM prefixed GROUP BY 1, 2) USING (request_id, module) WHERE n <= 6 OR r <= 2""", _PREFIXED)
def focus_top_modules(v: Views):
    return Q.focus_top_modules(targets(v)).select("request_id", "target_id")


@query("SELECT request_id, target_id FROM targets WHERE request_id % 3 = 0 OR (request_id % 3 = 1 AND contains(path, 'web')) OR (request_id % 3 = 2 AND contains(name, 'n1'))", _TARGETS)
def drop_synonym_only_hits(v: Views):
    k = F.col("o_orderkey") % 3
    requests = v.orders.select(F.col("o_orderkey").alias("request_id"), F.when(k == 1, F.array(F.lit("web"))).when(k == 2, F.array(F.lit("n1"))).otherwise(F.array().cast("array<string>")).alias("terms"))
    return Q.drop_synonym_only_hits(targets(v), requests).select("request_id", "target_id")


@query("SELECT request_id, target_id, round(score * CASE WHEN starts_with(path, 'ops/d/f1') THEN 1.2 WHEN name = 'n7' THEN 1.1 ELSE 1 END, 4) AS score FROM targets", _TARGETS)
def recency_boost(v: Views):
    recent = v.spark.createDataFrame([("ops/d/f1", "n7")], "path string, name string")
    return Q.recency_boost(targets(v), recent).select("request_id", "target_id", F.round("score", 4).alias("score"))


@query("SELECT 'tests/m' || p_partkey || '_test.py' AS test, CASE WHEN p_partkey % 2 = 0 THEN 'src/m' ELSE 'lib/m' END || p_partkey || '.py' AS path FROM part WHERE p_partkey % 3 > 0")
def implementation_twins(v: Views):
    k = F.col("p_partkey")
    files = v.part.where("p_partkey % 3 > 0").select(F.concat(F.when(k % 2 == 0, "src/m").otherwise("lib/m"), k, F.lit(".py")).alias("path"))
    return Q.implementation_twins(v.part.select(F.concat(F.lit("tests/m"), k, F.lit("_test.py")).alias("path")), files)


@query("""SELECT request_id, path, commit_id FROM (SELECT user_id AS request_id, path, row_number() OVER (PARTITION BY user_id ORDER BY max(value) DESC, path) AS f FROM (SELECT *, event_id % 2000 + 1 AS path FROM events) GROUP BY 1, 2)
  JOIN (SELECT path, commit_id, row_number() OVER (PARTITION BY path ORDER BY epoch DESC, commit_id DESC) AS r FROM commit_files JOIN commits USING (commit_id)) USING (path) WHERE f <= 5 AND r <= 5""", COMMITS + ", " + COMMIT_FILES)
def histories_for_targets(v: Views):
    wanted = v.events.select(F.col("user_id").alias("request_id"), (F.col("event_id") % 2000 + 1).alias("path"), F.col("value").alias("score"))
    return Q.histories_for_targets(wanted, commit_files(v).join(commits(v), "commit_id"))


@query("""SELECT request_id, item_id, path, 1 AS first, 1 AS last, CASE WHEN taken >= length(text) THEN text WHEN critical THEN substr(text, 1, taken) WHEN taken - taken * 3 // 4 - 30 > 50 THEN substr(text, 1, taken * 3 // 4) || chr(10) || '// ... [truncated] ...' || chr(10) || right(text, taken - taken * 3 // 4 - 30) ELSE substr(text, 1, taken) END AS source
  FROM (SELECT f.*, n.text, n.path, n.critical FROM fold f JOIN named n USING (request_id, item_id)) WHERE taken > 0""", """RECURSIVE whole AS (SELECT doc_id, left(replace(text, chr(10), ' '), 200) || CASE WHEN length(replace(text, chr(10), ' ')) > 200 THEN '...' ELSE '' END AS text FROM documents),
named AS (SELECT doc_id // 64 AS request_id, doc_id AS item_id, 'm' || doc_id || '.rs' AS path, rtrim(text, ' ' || chr(9)) AS text, contains('n' || doc_id, '7') AS critical, doc_id * 7919 % 101 AS score FROM whole WHERE length(text) > 0),
ranked AS (SELECT *, length(text) AS size, row_number() OVER (PARTITION BY request_id ORDER BY NOT critical, score DESC, item_id) AS r FROM named),
fold AS (SELECT DISTINCT request_id, 0::BIGINT AS r, NULL::BIGINT AS item_id, 0::BIGINT AS taken, 5552::BIGINT AS free, 1943::BIGINT AS pool FROM named UNION ALL
  SELECT request_id, r, item_id, t, CASE WHEN critical THEN free ELSE free - t END, CASE WHEN critical THEN pool - t ELSE pool END FROM (SELECT i.request_id, i.r, i.item_id, critical, free, pool,
    CASE WHEN size <= CASE WHEN critical THEN pool ELSE free END THEN size WHEN CASE WHEN critical THEN pool ELSE free END >= 200 THEN CASE WHEN critical THEN pool ELSE free END ELSE 0 END AS t FROM fold f JOIN ranked i ON i.request_id = f.request_id AND i.r = f.r + 1))""")
def tier_sources(v: Views):
    """Every document as the one long line of a file; 64 of them a request of the smallest tier."""
    number = F.col("doc_id")
    targets = v.documents.select((number / 64).cast("long").alias("request_id"), number.alias("item_id"), F.concat(F.lit("n"), number).alias("name"), F.concat(F.lit("m"), number, F.lit(".rs")).alias("path"), F.lit("function").alias("kind"),
                                 F.lit(1).alias("line_start"), F.lit(1).alias("line_end"), (number * 7919 % 101).alias("score"))
    files = v.documents.select(F.concat(F.lit("m"), number, F.lit(".rs")).alias("path"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("content"))
    return Q.tier_sources(targets, files, "small", ("7",))
