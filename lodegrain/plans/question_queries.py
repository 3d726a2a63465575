"""Queries of natural-language requests and of the scores of their answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consistency as C
from ..operators import evaluation as E
from ..operators import questions as Q
from .catalog import Views, query
from .retrieval_queries import _CITED, document_vectors, postings, said, vector_queries


def requests(v: Views):
    """Turns of conversations, every tenth with words of an intent."""
    words = F.get(F.array(*[F.lit(x) for x in ("fix the crash", "audit the key", "What is it? explain", "speed up and clean the slow path", "fix what is wrong")]), (F.col("turn") % 5).cast("int"))
    text = F.concat_ws(" ", "text", F.when(F.col("conv_id") % 10 == 0, words))
    return v.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), text.alias("text"))


_REQUESTS = """requests AS (SELECT conv_id * 1000 + turn AS request_id, concat_ws(' ', text, CASE WHEN conv_id % 10 = 0 THEN ['fix the crash', 'audit the key', 'What is it? explain', 'speed up and clean the slow path', 'fix what is wrong'][turn % 5 + 1] END) AS text FROM conversations)"""
_SCORES = ", ".join("(" + " + ".join("CASE WHEN contains(lower(text), '{}') THEN {} ELSE 0 END".format(k.replace("'", "''"), w) for k, w in words.items()) + f") AS {name}" for name, words in Q.INTENTS.items())


@query("""SELECT request_id, CASE greatest(bug_fix, security, explain, refactor) WHEN 0 THEN 'general' WHEN bug_fix THEN 'bug_fix' WHEN security THEN 'security' WHEN explain THEN 'explain' ELSE 'refactor' END AS intent FROM scores""",
       _REQUESTS + f", scores AS (SELECT request_id, {_SCORES} FROM requests)")
def query_intent(v: Views):
    return requests(v).select("request_id", Q.query_intent(F.col("text")).alias("intent"))


@query("SELECT request_id, intent, CAST(score AS INT) AS score FROM scores UNPIVOT (score FOR intent IN (bug_fix, security, explain, refactor)) WHERE score > 0", _REQUESTS + f", scores AS (SELECT request_id, {_SCORES} FROM requests)")
def intent_scores(v: Views):
    return requests(v).select("request_id", F.explode(Q.intent_scores(F.col("text"))).alias("s")).select("request_id", "s.intent", F.col("s.score").cast("int").alias("score"))


_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_CLEAN = f"""RECURSIVE asked AS (SELECT item_id AS query_id, text || ' How is the ' || ['BM25Score', 'URLParser', 'build_smart_context', 'MomentumEngine', 'HTTP2', 'cached', 'the_index_of'][item_id % 7 + 1] || ' searching, authentication?' AS text FROM benchmark),
words AS (SELECT query_id, list_filter(list_transform(regexp_split_to_array(text, '[\\s?!,]+'), lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g')),
  lambda w: length(w) >= 2 AND NOT list_contains({_LIST(Q.STOP_WORDS)}, lower(w))) AS words FROM asked),
terms AS (SELECT query_id, list_distinct_in_order AS terms FROM (SELECT query_id, list_filter(found, lambda t, i: list_position(found, t) = i) AS list_distinct_in_order FROM (
  SELECT query_id, flatten(list_transform(words, lambda w: [lower(w)] || list_filter(CASE WHEN contains(w, '_') THEN list_filter(string_split(lower(w), '_'), lambda p: NOT list_contains({_LIST(Q.STOP_WORDS)}, p))
    WHEN regexp_matches(w, '\\p{{Ll}}') AND len(list_filter(string_split(regexp_replace(regexp_replace(w, '([\\p{{Ll}}0-9])(\\p{{Lu}})', '\\1|\\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1|\\2', 'g'), '|'), lambda p: length(p) >= 2)) > 1
    THEN list_filter(string_split(lower(regexp_replace(regexp_replace(w, '([\\p{{Ll}}0-9])(\\p{{Lu}})', '\\1|\\2', 'g'), '(\\p{{Lu}})(\\p{{Lu}}\\p{{Ll}})', '\\1|\\2', 'g')), '|'), lambda p: length(p) >= 2) ELSE [] END, lambda p: length(p) >= 3))) AS found FROM words))),
synonyms AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {_LIST(v)})" for k, v in Q.SYNONYMS.items())}) t(term, others)),
each AS (SELECT query_id, i, terms, list_filter(CASE WHEN t LIKE '%ed' THEN [t[:-3], t[:-3] || 'ing'] WHEN t LIKE '%ing' THEN [t[:-4], t[:-4] || 'e'] WHEN t LIKE '%tion' THEN [t[:-5], t[:-5] || 'te'] ELSE [] END || coalesce(others, []),
  lambda x: NOT list_contains(terms, x)) AS more FROM (SELECT query_id, terms, unnest(terms) AS t, unnest(range(1, len(terms) + 1)) AS i FROM terms) LEFT JOIN synonyms ON synonyms.term = t),
folded AS (SELECT query_id, 0::BIGINT AS i, []::VARCHAR[] AS done FROM terms UNION ALL
  SELECT f.query_id, f.i + 1, f.done || list_filter(e.more, lambda x, j: NOT list_contains(f.done, x) AND list_position(e.more, x) = j)[1:2] FROM folded f JOIN each e ON e.query_id = f.query_id AND e.i = f.i + 1)"""


@query("""SELECT query_id, unnest(terms) AS term, 3.0::DOUBLE AS weight FROM terms UNION ALL SELECT query_id, unnest(done), 0.5::DOUBLE FROM (SELECT query_id, max_by(done, i) AS done FROM folded GROUP BY 1)""", _CLEAN)
def clean_query(v: Views):
    names = F.get(F.array(*[F.lit(n) for n in ("BM25Score", "URLParser", "build_smart_context", "MomentumEngine", "HTTP2", "cached", "the_index_of")]), (F.col("item_id") % 7).cast("int"))
    text = F.concat(F.col("text"), F.lit(" How is the "), names, F.lit(" searching, authentication?"))
    return Q.clean_query(v.benchmark.select(F.col("item_id").alias("query_id"), text.alias("text")))


@query()
def ask_batch(v: Views):
    asked = v.benchmark.select(F.col("item_id").alias("request_id"), "text")
    return Q.ask_batch(asked, v.documents, postings(v), vector_queries(v), document_vectors(v))


_UNION = """targets AS (SELECT l_orderkey AS request_id, 'n' || l_suppkey AS name, 'f' || l_partkey % 7 AS path, l_extendedprice AS score, l_linenumber AS n, l_returnflag AS flag FROM lineitem),
passes AS (SELECT *, 0 AS place, 'explicit' AS pass FROM targets WHERE n = 2 UNION ALL SELECT *, 1, 'ranked' FROM targets WHERE flag = 'R'),
every AS (SELECT * FROM passes UNION ALL SELECT *, 2, 'by_name' FROM targets WHERE request_id NOT IN (SELECT request_id FROM passes))"""


@query("SELECT request_id, name, path, score, pass FROM (SELECT *, row_number() OVER (PARTITION BY request_id, name, path ORDER BY place, score DESC) AS r FROM every) WHERE r = 1", _UNION)
def target_union(v: Views):
    rows = v.lineitem.select(F.col("l_orderkey").alias("request_id"), F.concat(F.lit("n"), "l_suppkey").alias("name"), F.concat(F.lit("f"), F.col("l_partkey") % 7).alias("path"),
                             F.col("l_extendedprice").alias("score"), "l_linenumber", "l_returnflag")
    return Q.target_union({"explicit": rows.where("l_linenumber = 2"), "ranked": rows.where("l_returnflag = 'R'"), "by_name": rows}, ["request_id"])


_TESTS = """asked AS (SELECT DISTINCT l_orderkey AS request_id, 'sym' || l_suppkey AS name, CASE WHEN l_linenumber = 1 THEN 'tests/test_' || l_partkey % 40 || '.py' ELSE 'src/x.py' END AS path FROM lineitem),
hits AS (SELECT 'sym' || l_suppkey AS name, CASE WHEN l_partkey % 2 = 0 THEN 'tests/test_' ELSE 'src/f' END || l_partkey % 40 || '.py' AS path, max(l_quantity) AS score FROM lineitem GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, path) AS r FROM hits) WHERE r <= 10),
found AS (SELECT request_id, b.path, max(score) AS score FROM (SELECT DISTINCT request_id, name FROM asked WHERE length(name) >= 4) JOIN best b USING (name) WHERE starts_with(b.path, 'tests/') AND (request_id, b.path) NOT IN (SELECT (request_id, path) FROM asked) GROUP BY ALL)"""


@query("SELECT request_id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, path) AS r FROM found) WHERE r <= 3", _TESTS)
def tests_for_symbols(v: Views):
    name, part = F.concat(F.lit("sym"), "l_suppkey").alias("name"), F.concat((F.col("l_partkey") % 40).cast("string"), F.lit(".py"))
    asked = v.lineitem.select(F.col("l_orderkey").alias("request_id"), name, F.when(F.col("l_linenumber") == 1, F.concat(F.lit("tests/test_"), part)).otherwise("src/x.py").alias("path")).distinct()
    hits = v.lineitem.select(name, F.concat(F.when(F.col("l_partkey") % 2 == 0, "tests/test_").otherwise("src/f"), part).alias("path"), "l_quantity").groupBy("name", "path").agg(F.max("l_quantity").alias("score"))
    return Q.tests_for_symbols(asked, hits, ["request_id"])


def _files(v: Views):
    return v.part.select(F.concat(F.lit("src/m"), F.col("p_partkey") % 5, F.lit("/f"), F.col("p_size") % 4, F.lit(".py")).alias("path"))


_HALLUCINATED = _CITED + """, paths AS (SELECT DISTINCT id, unnest(regexp_extract_all(response, '(?:src|crates|lib|bin|docs|tests|tools|examples)/[A-Za-z0-9_/.-]+\\.[A-Za-z0-9_]+')) AS path FROM said),
cites AS (SELECT id, count(*) AS cited, count(k) AS existing FROM paths LEFT JOIN (SELECT path, 1 AS k FROM known) USING (path) GROUP BY id),
halluc AS (SELECT id, regexp_matches(response, '(?i)\\bthe\\b')::BIGINT + regexp_matches(response, '(?i)\\bsee\\b')::BIGINT + coalesce(cited - existing, 0) AS hallucinations, CASE WHEN cited > 0 THEN existing / cited END AS precision FROM said LEFT JOIN cites USING (id))"""


@query("SELECT id, hallucinations FROM halluc", _HALLUCINATED)
def hallucination_count(v: Views):
    return E.hallucination_count(said(v), _files(v), ["the", "see"])


@query("""SELECT round(coverage, 6) AS coverage, round(precision, 6) AS precision, with_citations, hallucinations, round(CASE WHEN precision + coverage > 0 THEN 2 * precision * coverage / (precision + coverage) ELSE coverage END, 6) AS quality
  FROM (SELECT avg(id % 10 / 10) AS coverage, avg(precision) AS precision, count(precision) AS with_citations, CAST(sum(hallucinations) AS BIGINT) AS hallucinations FROM halluc)""", _HALLUCINATED)
def grounding_quality(v: Views):
    rows = E.citation_precision(said(v), _files(v)).select("id", "precision", ((F.col("id") % 10) / 10).alias("coverage"))
    row = E.grounding_quality(rows.join(E.hallucination_count(said(v), _files(v), ["the", "see"]), "id"))
    return row.withColumns({c: F.round(c, 6) for c in ("coverage", "precision", "quality")})


@query("""SELECT id, CASE WHEN NOT (contains(t, '```') OR contains(t, 'fn ') OR contains(t, 'def ')) THEN 0.0 WHEN NOT regexp_matches(t, 'def \\w+\\(') THEN 0.5 ELSE 1.0 END::DOUBLE AS flag
  FROM (SELECT doc_id AS id, text || CASE doc_id % 3 WHEN 0 THEN ' def f(x)' WHEN 1 THEN ' ```' ELSE '' END AS t FROM documents)""")
def code_quality_flag(v: Views):
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " def f(x)").when(F.col("doc_id") % 3 == 1, " ```").otherwise(""))
    return v.documents.select(F.col("doc_id").alias("id"), E.code_quality_flag(text, r"def \w+\(").alias("flag"))


@query("""SELECT (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS issues, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1) AS fixable,
  (SELECT count(*) FROM part WHERE p_size > 40) AS unused, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS proposals""")
def maintenance_summary(v: Views):
    issues = v.lineitem.where("l_returnflag = 'R'").select(F.when(F.col("l_linenumber") == 1, "apply").alias("suggestion"))
    return C.maintenance_summary(issues, v.part.where("p_size > 40"), v.orders.where("o_orderstatus = 'O'"))
