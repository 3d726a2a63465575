"""Queries of column functions and small selections, each over a whole table in the role of hits, symbols, files or runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import activity_module, co_authors, module_prefix
from ..operators import code as K
from ..operators import consistency as C
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..operators import security as S
from ..operators import topk as T
from .catalog import Views, query


@query("SELECT event_id, value / 100 AS score FROM events WHERE value / 100 >= 0.15")
def drop_low_confidence(v: Views):
    return R.drop_low_confidence(v.events.select("event_id", (F.col("value") / 100).alias("score")))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 5")
def last_n(v: Views):
    return T.last_n(v.events, ["user_id", "event_type"], ["ts", "event_id"], 5).select("event_id", "user_id", "event_type")


@query("SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def recent(v: Views):
    return T.recent(v.events, ["ts", "event_id"], 100).select("event_id", "value")


@query("""SELECT request_id, name, path, score, CAST(class AS INT) AS class, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC NULLS LAST, class, name, path) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY request_id, name, path ORDER BY score DESC NULLS LAST, class) AS place FROM (SELECT l_suppkey AS request_id, 'p' || l_partkey % 50 AS name, l_linenumber % 3 AS class,
    ['lib/a', 'lib/tests/a', 'lib/vendor/a'][l_linenumber % 3 + 1] || l_linenumber || '.rs' AS path, CASE WHEN l_quantity > 5 THEN l_discount END AS score FROM lineitem)) WHERE place = 1) WHERE rank <= 5""")
def rank_targets(v: Views):
    folder = F.get(F.array(F.lit("lib/a"), F.lit("lib/tests/a"), F.lit("lib/vendor/a")), F.col("l_linenumber") % 3)
    targets = v.lineitem.select(F.col("l_suppkey").alias("request_id"), F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("name"), F.concat(folder, "l_linenumber", F.lit(".rs")).alias("path"), F.when(F.col("l_quantity") > 5, F.col("l_discount")).alias("score"))
    return C.rank_targets(targets, ["request_id"])


_LISTS = """lists AS (SELECT l_orderkey AS query_id, l_partkey AS doc_id, CASE WHEN l_linenumber <= l_orderkey % 3 THEN 0 WHEN l_linenumber <= l_orderkey % 3 + 2 THEN 1 ELSE 2 END AS list, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL),
a AS (SELECT query_id, doc_id, score FROM lists WHERE list = 0), few_a AS (SELECT DISTINCT query_id FROM lists EXCEPT SELECT query_id FROM a GROUP BY query_id HAVING count(*) >= 2),
b AS (FROM a UNION ALL SELECT query_id, doc_id, score FROM lists SEMI JOIN few_a USING (query_id) ANTI JOIN a USING (query_id, doc_id) WHERE list = 1), few_b AS (SELECT DISTINCT query_id FROM lists EXCEPT SELECT query_id FROM b GROUP BY query_id HAVING count(*) >= 2),
c AS (FROM b UNION ALL SELECT query_id, doc_id, score FROM lists SEMI JOIN few_b USING (query_id) ANTI JOIN b USING (query_id, doc_id) WHERE list = 2)"""


@query("SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM c) WHERE place <= 4", _LISTS)
def search_with_fallback(v: Views):
    k = F.col("l_orderkey") % 3
    which = F.when(F.col("l_linenumber") <= k, 0).when(F.col("l_linenumber") <= k + 2, 1).otherwise(2)
    rows = v.lineitem.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), which.alias("list")).agg(F.max("l_extendedprice").alias("score"))
    return R.search_with_fallback(*[rows.where(F.col("list") == i).drop("list") for i in range(3)], limit=4)


@query("SELECT doc_id, round(CASE WHEN n_chars > 0 THEN (doc_id % 7) / n_chars * 1000 ELSE 0 END, 6) AS ratio, round((doc_id % 7) / (greatest(length(text) / 4, 1.0) / 1000), 6) AS density FROM documents")
def information_density(v: Views):
    facts = F.col("doc_id") % 7
    return v.documents.select("doc_id", F.round(E.compression_ratio(facts, F.col("n_chars")), 6).alias("ratio"), F.round(E.information_density(facts, F.col("text")), 6).alias("density"))


@query("SELECT l_partkey, round(CASE WHEN count_if(l_linenumber > 2) > 0 THEN 1 - least(1.0, count_if(l_returnflag = 'R') / count_if(l_linenumber > 2)) ELSE 1 END, 6)::DOUBLE AS score FROM lineitem GROUP BY l_partkey")
def consistency_score(v: Views):
    rows = v.lineitem.groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("issues"), F.count_if(F.col("l_linenumber") > 2).alias("checks"))
    return rows.select("l_partkey", F.round(E.consistency_score(F.col("issues"), F.col("checks")), 6).alias("score"))


@query("""SELECT o_orderkey AS commit_id, unnest(CASE o_orderkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['A' || o_custkey || ' <a@x.org>'] ELSE ['A' || o_custkey || ' <a@x.org>', 'B' || o_custkey % 7] END) AS author FROM orders""")
def co_authors_of_commits(v: Views):
    first = F.concat(F.lit("\nCo-authored-by: A"), "o_custkey", F.lit(" <a@x.org>"))
    second = F.concat(F.lit("\nCo-Authored-By:   B"), F.col("o_custkey") % 7, F.lit("  \nReviewed-by: C"))
    k = F.col("o_orderkey") % 3
    message = F.concat(F.lit("fix: see Co-authored-by: nobody\n"), F.when(k >= 1, first).otherwise(""), F.when(k == 2, second).otherwise(""))
    return v.orders.select(F.col("o_orderkey").alias("commit_id"), F.explode(co_authors(message)).alias("author"))


@query("""SELECT conv_id, turn, CASE WHEN words <= 4 AND marks <= 1 AND turn % 2 = 0 THEN 'quick' WHEN words >= 30 OR marks > 1 OR (words > 15 AND turn % 2 = 1) THEN 'deep' ELSE 'standard' END AS complexity
  FROM (SELECT *, len(regexp_extract_all(text, '\\S+')) AS words, length(text) - length(replace(text, '?', '')) AS marks FROM conversations)""")
def query_complexity(v: Views):
    return v.conversations.select("conv_id", "turn", C.query_complexity(F.col("text"), F.col("turn") % 2 == 1).alias("complexity"))


#: signature with NN for a number, language, target
_IMPORTS = [("use crate::authNN::User;", "rust", "authNN"), ("use super::ioNN;", "rust", "ioNN"), ("use std::fmt;", "rust", None), ("from .modelsNN import X", "python", "modelsNN"),
            ("import osNN.path", "python", "osNN"), ("import a from './lib/utilNN.js'", "javascript", "utilNN"), ("import b from 'react'", "javascript", None)]


@query("SELECT p_partkey, replace([" + ", ".join("NULL" if t is None else f"'{t}'" for _, _, t in _IMPORTS) + "][p_partkey % 7 + 1], 'NN', CAST(p_partkey AS VARCHAR)) AS target FROM part")
def import_target(v: Views):
    pick = lambda i: F.get(F.array(*[F.lit(row[i]) for row in _IMPORTS]), (F.col("p_partkey") % 7).cast("int"))
    return v.part.select("p_partkey", K.import_target(F.replace(pick(0), F.lit("NN"), F.col("p_partkey").cast("string")), pick(1)).alias("target"))


@query("""SELECT doc_id, len(runs) AS runs, CAST(list_sum(list_transform(runs, lambda r: length(r))) AS BIGINT) AS chars, md5(array_to_string(runs, '|')) AS digest FROM (SELECT doc_id, regexp_extract_all(text, '[\\x20-\\x7E]{6,}') AS runs FROM documents) WHERE len(runs) > 0""")
def printable_runs(v: Views):
    runs = C.printable_runs(v.documents.select(F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda r: r["value"])
    return runs.groupBy(F.col("path").alias("doc_id")).agg(F.count("*").alias("runs"), F.sum(F.length("value")).alias("chars"), F.md5(F.array_join(ordered, "|")).alias("digest"))


_HIT_PATHS = "['src/', 'tests/', 'a/vendor/', 'lib/'][p_partkey % 4 + 1] || replace(p_type, ' ', '_') || ['.rs', '.py', '.go'][p_partkey % 3 + 1]"


@query(f"""SELECT p_partkey, round(exp(-0.05 * greatest((1000000 - p_size * 30000) / 86400, 0)), 6) AS temporal, CASE WHEN p_partkey % 4 = 2 THEN 0.0 WHEN p_partkey % 4 = 1 THEN 0.2 ELSE 1.0 END::DOUBLE AS source,
  round(len(list_filter(terms, lambda t: contains(lower(path), t))) / 3, 6)::DOUBLE AS path_match, round(least(1.0, greatest(0.0, (length(p_name) - 4) / 12)), 6)::DOUBLE AS specificity,
  CASE WHEN list_contains(terms, lower(p_name)) THEN 1.0 WHEN len(list_filter(terms, lambda t: starts_with(lower(p_name), t))) > 0 THEN 0.3 ELSE 0.0 END::DOUBLE AS exact,
  CASE kind WHEN 'Interface' THEN 1.0 WHEN 'Struct' THEN 0.8 WHEN 'Enum' THEN 0.6 WHEN 'Function' THEN 0.4 ELSE 0.2 END::DOUBLE AS kind_boost,
  CASE WHEN p_partkey % 3 = 1 THEN CASE visibility WHEN 'public' THEN 1.0 WHEN 'private' THEN 0.7 ELSE 0.8 END ELSE CASE visibility WHEN 'public' THEN 1.0 WHEN 'crate' THEN 0.7 WHEN 'private' THEN 0.3 ELSE 0.6 END END::DOUBLE AS visibility_boost
  FROM (SELECT *, {_HIT_PATHS} AS path, [lower(split_part(p_type, ' ', 1)), split_part(lower(p_name), ' ', 1), lower(p_name)][1:2 + (p_partkey % 2)::INT] || CASE WHEN p_partkey % 2 = 0 THEN ['zz'] ELSE [] END AS terms,
    ['Interface', 'Struct', 'Enum', 'Function', 'Module'][p_size % 5 + 1] AS kind, ['public', 'crate', 'private', 'other'][p_size % 4 + 1] AS visibility FROM part)""")
def quality_features(v: Views):
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), n.cast("int"))
    k, size = F.col("p_partkey"), F.col("p_size")
    path = F.concat(pick(["src/", "tests/", "a/vendor/", "lib/"], k % 4), F.replace("p_type", F.lit(" "), F.lit("_")), pick([".rs", ".py", ".go"], k % 3))
    terms = F.array(F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1)), F.when(k % 2 == 1, F.lower("p_name")).otherwise("zz"))
    rows = v.part.select("p_partkey", F.col("p_name").alias("name"), (size * 30000).alias("epoch"), path.alias("path"), terms.alias("terms"),
                         pick(["Interface", "Struct", "Enum", "Function", "Module"], size % 5).alias("kind"), pick(["public", "crate", "private", "other"], size % 4).alias("visibility"))
    rows = R.quality_features(rows, as_of=1_000_000)
    rounded = {c: F.round(c, 6) for c in ("temporal", "path_match", "specificity")}
    return rows.withColumns(rounded).select("p_partkey", "temporal", "source", "path_match", "specificity", "exact", "kind_boost", "visibility_boost")


@query("""SELECT query_id, doc_id, round(0.4 * (score - low) / greatest(high - low, 0.001) + 0.12 * source + 0.08 * path + 0.1 * pagerank + 0.05 * visibility + 0.05 * kind + 0.05 * specificity + 0.05 * temporal + 0.1 * exact, 6) AS total FROM
  (SELECT *, min(score) OVER w AS low, max(score) OVER w AS high FROM (SELECT l_orderkey AS query_id, l_partkey AS doc_id, l_extendedprice AS score, l_discount AS source, l_tax AS path, l_quantity / 50 AS pagerank,
    (l_returnflag = 'R')::INT AS visibility, (l_linestatus = 'F')::INT AS kind, l_suppkey % 5 / 5 AS specificity, l_partkey % 4 / 4 AS temporal, l_linenumber % 2 AS exact FROM lineitem) WINDOW w AS (PARTITION BY query_id))""")
def additive_score(v: Views):
    hits = v.lineitem.select(
        F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id"), F.col("l_extendedprice").alias("score"), F.col("l_discount").alias("source"), F.col("l_tax").alias("path"),
        (F.col("l_quantity") / 50).alias("pagerank"), (F.col("l_returnflag") == "R").cast("int").alias("visibility"), (F.col("l_linestatus") == "F").cast("int").alias("kind"),
        (F.col("l_suppkey") % 5 / 5).alias("specificity"), (F.col("l_partkey") % 4 / 4).alias("temporal"), (F.col("l_linenumber") % 2).alias("exact"))
    return R.additive_score(hits).select("query_id", "doc_id", F.round("total", 6).alias("total"))


@query("SELECT page_id, url, CASE WHEN len(p) > 2 THEN p[1] || '/' || p[2] ELSE p[1] END AS prefix, CASE WHEN len(p) > 1 THEN p[1] || '/' || p[2] WHEN contains(path, '.') THEN 'root' ELSE '' END AS module FROM (SELECT *, string_split(path, '/') AS p FROM (SELECT page_id, url, regexp_replace(url, '^https?://', '') AS path FROM pages))")
def module_prefixes(v: Views):
    path = F.regexp_replace("url", "^https?://", "")
    return v.pages.select("page_id", "url", module_prefix(path).alias("prefix"), activity_module(path).alias("module"))


_SYMBOLS = """symbols AS (SELECT 'Part' || o_custkey % 60 AS name, CASE WHEN o_custkey % 4 = 0 THEN 'tests/s' ELSE 'lib/s' END || o_orderkey || '.rs' AS path, CASE WHEN o_orderkey % 3 = 0 THEN 'Import' ELSE 'Function' END AS kind FROM orders),
firsts AS (SELECT name, path AS symbol_path FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path) AS place FROM symbols) WHERE place <= 2 AND kind <> 'Import')"""


def symbols(v: Views):
    folder = F.when(F.col("o_custkey") % 4 == 0, "tests/s").otherwise("lib/s")
    return v.orders.select(F.concat(F.lit("Part"), F.col("o_custkey") % 60).alias("name"), F.concat(folder, "o_orderkey", F.lit(".rs")).alias("path"), F.lit(0).alias("ordinal"), F.when(F.col("o_orderkey") % 3 == 0, "Import").otherwise("Function").alias("kind"))


@query("SELECT path, name, symbol_path FROM (SELECT DISTINCT 'f' || p_partkey AS path, 'Part' || unnest([p_partkey % 70, p_partkey % 9]) AS name FROM part) JOIN firsts USING (name)", _SYMBOLS)
def config_references(v: Views):
    content = F.concat(F.lit('load("app.core.Part'), F.col("p_partkey") % 70, F.lit("\") or 'x.y.Part"), F.col("p_partkey") % 9, F.lit("' or \"a.Part1\""))
    return K.config_references(v.part.select(F.concat(F.lit("f"), "p_partkey").alias("path"), content.alias("content")), symbols(v))


@query("SELECT path, name, symbol_path FROM (SELECT DISTINCT 'f' || p_partkey AS path, 'Part' || unnest([p_partkey % 70, p_partkey % 9]) AS name FROM part) JOIN firsts USING (name) WHERE NOT starts_with(symbol_path, 'tests/')", _SYMBOLS)
def called_symbols(v: Views):
    body = F.concat(F.lit("if (a) { Part"), F.col("p_partkey") % 70, F.lit("(b); Part1; for (x) Part"), F.col("p_partkey") % 9, F.lit(" (c) }"))
    return K.called_symbols(v.part.select(F.concat(F.lit("f"), "p_partkey").alias("path"), body.alias("body")), symbols(v))


def sources(v: Views):
    """A file of each part with two symbols: a documented function and a bare one."""
    k = F.col("p_partkey").cast("string")
    content = F.concat(F.lit("use a;\n/// about "), k, F.lit("\n//! more\n\nfn f_"), k, F.lit("() {\n  let alpha"), F.translate(k, "0123456789", "abcdefghij"), F.lit(" = beta;\n}\n\nfn g() {}"))
    files = v.part.select(F.concat(F.lit("lib/f"), k, F.lit(".rs")).alias("path"), content.alias("content"), k.alias("k"))
    two = F.array(F.struct(F.concat(F.lit("f_"), "k").alias("name"), F.lit(5).alias("line_start"), F.lit(7).alias("line_end"), F.lit("Function").alias("kind")), F.struct(F.lit("g").alias("name"), F.lit(9).alias("line_start"), F.lit(9).alias("line_end"), F.lit("Constant").alias("kind")))
    return files.drop("k"), files.select("path", F.inline(two))


_K = "CAST(p_partkey AS VARCHAR) AS k, 'lib/f' || p_partkey || '.rs' AS path"


@query(f"SELECT path, 'f_' || k AS name, 5 AS line_start, 'about ' || k || ' more' AS doc FROM (SELECT {_K} FROM part) UNION ALL SELECT path, 'g', 9, '' FROM (SELECT {_K} FROM part)")
def doc_comment_above(v: Views):
    return K.doc_comment_above(*sources(v))


_BODY = "'fn f_' || k || '() {' || chr(10) || '  let alpha' || translate(k, '0123456789', 'abcdefghij') || ' = beta;' || chr(10) || '}'"


def _long(a: int, b: int) -> str:
    return ("array_to_string(list_transform(range(1, 61), lambda i: CASE WHEN i = 1 THEN ['fn f() {', 'enum f {', 'fn f() {'][p_partkey % 3 + 1] WHEN i = 60 THEN '}' WHEN p_partkey % 3 = 0 THEN '  Tool { name: \"n' || i % 12 || '_' || k || '\" },' "
            "WHEN p_partkey % 3 = 1 THEN '  V' || i % 15 || ',' ELSE '  step(' || i || ', ' || k || ');' END)[" + f"{a}:{b}], chr(10))")


@query(f"""SELECT path, 'f_' || k AS name, 5 AS line_start, {_BODY} AS snippet FROM (SELECT {_K} FROM part) UNION ALL SELECT path, 'g', 9, 'fn g() {{}}' FROM (SELECT {_K} FROM part) UNION ALL
  SELECT 'long/' || path, 'long', 1, CASE p_partkey % 3 WHEN 0 THEN '// REGISTRY: 12 items — ' || array_to_string(list_transform([2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 0, 1], lambda i: 'n' || i || '_' || k), ', ') || chr(10) || {_long(1, 5)} || chr(10) ||
      '    // ... [complete item list in REGISTRY comment above]' || chr(10) || '}}'
    WHEN 1 THEN '// ENUM: 15 variants — V2, V3, V4, V5, V6, V7, V8, V9, V10, V11, V12, V13, V14, V0, V1' || chr(10) || {_long(1, 3)} || chr(10) || '    // ... [complete variant list in ENUM comment above]' || chr(10) || '}}'
    ELSE {_long(1, 20)} || chr(10) || '// ...' || chr(10) || {_long(41, 60)} END FROM (SELECT p_partkey, {_K} FROM part)""")
def body_snippet(v: Views):
    """Short symbols, and a long one of each part: a registry, an enum or steps."""
    files, found = sources(v)
    k, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3

    def line(i):
        first, step = F.when(kind == 1, "enum f {").otherwise("fn f() {"), F.concat(F.lit("  step("), i.cast("string"), F.lit(", "), k, F.lit(");"))
        return (F.when(i == 1, first).when(i == 60, "}").when(kind == 0, F.concat(F.lit('  Tool { name: "n'), i % 12, F.lit("_"), k, F.lit('" },'))).when(kind == 1, F.concat(F.lit("  V"), i % 15, F.lit(","))).otherwise(step))

    # the lines of a file are made in its row, so nothing is gathered; keys are few bytes and their files are not: a part for each core
    long = v.part.select("p_partkey").repartition(v.spark.sparkContext.defaultParallelism).select(F.concat(F.lit("long/lib/f"), "p_partkey", F.lit(".rs")).alias("path"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), line), "\n").alias("content"))
    symbols = long.select("path", F.lit("long").alias("name"), F.lit(1).alias("line_start"), F.lit(60).alias("line_end"), F.lit("Function").alias("kind"))
    return K.body_snippet(files.unionByName(long), found.unionByName(symbols))


@query(f"SELECT path, 'f_' || k AS name, 'f_' || k || ' f_' || k || ' f_' || k || ' fn fn about ' || k || ' more f_' || k || ' alpha' || translate(k, '0123456789', 'abcdefghij') || ' beta' AS text FROM (SELECT {_K} FROM part) UNION ALL SELECT path, 'g', 'g g g fn fn' FROM (SELECT {_K} FROM part)")
def embedding_text(v: Views):
    files, found = sources(v)
    rows = K.body_snippet(files, found).join(K.doc_comment_above(files, found), ["path", "name", "line_start"])
    return rows.select("path", "name", K.embedding_text(F.col("name"), F.lit("fn"), F.col("doc"), K.body_keywords(F.split("snippet", "\n"))).alias("text"))


@query(f"SELECT p_partkey AS target, path, CASE WHEN p_partkey % 3 > 0 THEN 'f_' || k ELSE 'g' END AS name, CASE WHEN p_partkey % 3 > 0 THEN {_BODY} END AS snippet FROM (SELECT p_partkey, {_K} FROM part) WHERE p_partkey % 3 < 2")
def enrich_targets_with_code(v: Views):
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, "G").when(k == 1, F.concat(F.lit("F_"), "p_partkey")).otherwise("no such name")
    targets = v.part.select(F.col("p_partkey").alias("target"), name.alias("name"), F.concat(F.lit("f"), "p_partkey", F.lit(".rs")).alias("path"))
    files, found = sources(v)
    return K.enrich_targets_with_code(targets, found, files).select("target", F.col("symbol_path").alias("path"), F.col("symbol").alias("name"), "snippet")


@query("SELECT conv_id, turn, replace(text, '.' || chr(10), '.' || chr(10) || chr(10)) AS text FROM conversations")
def minify_text(v: Views):
    return v.conversations.select("conv_id", "turn", C.minify_text(F.replace("text", F.lit(".\n"), F.lit(". \t\n\n\n\n"))).alias("text"))


@query("""SELECT p_partkey, 'fn a() {' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '  // ...' || chr(10) END || '  let b = ' || p_partkey || ';' || chr(10) || '  // ...' || chr(10) || '  print_all(x);' || chr(10) || '}' AS content FROM part""")
def prune_log_lines(v: Views):
    first = F.get(F.array(F.lit(""), F.lit('  info!("a {}", b);\n'), F.lit("  logger.warning(f(x))\n  console.log('a')\n")), (F.col("p_partkey") % 3).cast("int"))
    last = F.when(F.col("p_partkey") % 2 == 0, '  println!("b");\n').otherwise('  println!(\n    "{}",\n    f(x)\n  );\n')
    content = F.concat(F.lit("fn a() {\n"), first, F.lit("  let b = "), "p_partkey", F.lit(";\n"), last, F.lit("  print_all(x);\n}"))
    return v.part.select("p_partkey", C.prune_log_lines(content).alias("content"))


@query("SELECT p_partkey, ['core::f', 'f', 'util::f', 'f'][p_partkey % 4 + 1] || p_partkey AS module FROM part")
def module_name(v: Views):
    folder = F.get(F.array(F.lit("crates/core/src/a/"), F.lit("src/"), F.lit("lib/util/"), F.lit("")), (F.col("p_partkey") % 4).cast("int"))
    return v.part.select("p_partkey", K.module_name(F.concat(folder, F.lit("f"), "p_partkey", F.lit(".rs"))).alias("module"))


@query("""SELECT p_partkey, 'k = "ab' || p_partkey || 'c" + x + ''de''' AS text FROM part""")
def merge_concatenations(v: Views):
    return v.part.select("p_partkey", S.merge_concatenations(F.concat(F.lit('k = "ab" + "'), "p_partkey", F.lit("\"+\"c\" + x + 'd' + 'e'"))).alias("text"))
