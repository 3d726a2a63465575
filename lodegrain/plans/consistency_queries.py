"""Queries of the consistency checks over parts, suppliers, pages, events and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import is_test_path, module_prefix, source_class
from ..operators import consistency as C
from .catalog import Views, query


@query("""SELECT name, 'error' AS severity FROM (SELECT DISTINCT p_brand || p_size AS name FROM part WHERE p_partkey % 3 <> 0) d WHERE name NOT IN (SELECT p_brand || p_size FROM part WHERE p_partkey % 2 = 0)
  UNION ALL SELECT name, 'warning' FROM (SELECT DISTINCT p_brand || p_size AS name FROM part WHERE p_partkey % 2 = 0) WHERE name NOT IN (SELECT p_brand || p_size FROM part WHERE p_partkey % 3 <> 0)""")
def workspace_drift(v: Views):
    name = F.concat("p_brand", "p_size").alias("name")
    return C.workspace_drift(v.part.where("p_partkey % 3 <> 0").select(name), v.part.where("p_partkey % 2 = 0").select(name))


_NAMES = "names AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')[1:3]) || CASE WHEN item_id % 2 = 0 THEN '' ELSE '-x' END AS name FROM benchmark)"


@query("SELECT name FROM names WHERE name NOT IN (SELECT w FROM words) AND replace(name, '-', '_') NOT IN (SELECT w FROM words)", _NAMES + ", words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_-]+')) AS w FROM documents)")
def unmentioned_names(v: Views):
    names = v.benchmark.select("item_id", F.explode(F.slice(F.split(F.lower("text"), " "), 1, 3)).alias("w")).select(F.concat("w", F.when(F.col("item_id") % 2 == 0, "").otherwise("-x")).alias("name")).distinct()
    return C.unmentioned_names(names, v.documents)


@query("""SELECT page_id, target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages) WHERE NOT starts_with(target, 'http') AND NOT starts_with(target, '#')
  AND target NOT IN (SELECT '/' || unnest(string_split(text, ' ')[1:2]) FROM benchmark)""")
def broken_links(v: Views):
    files = v.benchmark.select(F.explode(F.slice(F.split("text", " "), 1, 2)).alias("w")).select(F.concat(F.lit("/"), "w").alias("path"))
    return C.broken_links(v.pages, files, text="html", pattern='href="([^"]*)"')


@query("SELECT s_name AS name FROM supplier WHERE s_suppkey % 3 = 0")
def missing_attributes(v: Views):
    content = F.concat(F.lit("[package]\nname = x\n"), F.when(F.col("s_suppkey") % 3 != 0, "  description = y\n").otherwise("# description\n"))
    return C.missing_attributes(v.supplier.select(F.col("s_name").alias("name"), content.alias("content")))


@query("SELECT name FROM (SELECT 'c-' || n_nationkey AS name, n_nationkey AS k FROM nation) WHERE k % 4 = 3")
def unused_dependencies(v: Views):
    k = F.col("n_nationkey")
    line = F.when(k % 4 == 0, F.concat(F.lit("use c_"), k, F.lit("::a;"))).when(k % 4 == 1, F.concat(F.lit("let x = c_"), k, F.lit("::f();"))).when(k % 4 == 2, F.concat(F.lit("extern crate c_"), k, F.lit(";"))).otherwise(F.concat(F.lit("// c_"), k))
    return C.unused_dependencies(v.nation.select(F.concat(F.lit("c-"), k).alias("name")), v.nation.select(line.alias("content")))


@query("SELECT l_orderkey, l_linenumber, l_partkey % 7 = 0 AS \"exists\" FROM lineitem")
def verify_paths(v: Views):
    files = v.part.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("path"))
    return C.verify_paths(v.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("path")), files).drop("path")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 7 = 0")
def drop_stale_targets(v: Views):
    files = v.part.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("path"))
    return C.drop_stale_targets(v.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("path")), files).drop("path")


_SYMBOLS = "symbols AS (SELECT p_type || '/' || p_size AS path, p_partkey AS ordinal, p_brand AS name, ['Function', 'Import', 'Struct', 'Variable'][p_partkey % 4 + 1] AS kind FROM part)"


def symbols(v: Views):
    kinds = F.array(*[F.lit(k) for k in ("Function", "Import", "Struct", "Variable")])
    return v.part.select(F.concat("p_type", F.lit("/"), "p_size").alias("path"), F.col("p_partkey").alias("ordinal"), F.col("p_brand").alias("name"), F.get(kinds, (F.col("p_partkey") % 4).cast("int")).alias("kind"))


@query("SELECT path, array_to_string(list(name ORDER BY ordinal), ',') AS symbols FROM symbols WHERE starts_with(path, 'S') GROUP BY path", _SYMBOLS)
def file_skeleton(v: Views):
    return C.file_skeleton(symbols(v), "S").withColumn("symbols", F.array_join("symbols", ","))


@query("SELECT path, ordinal, name, kind, lower(name) AS query FROM symbols WHERE name IN (SELECT p_brand FROM part WHERE p_partkey % 10 = 1)", _SYMBOLS)
def lookup_symbol(v: Views):
    return C.lookup_symbol(symbols(v), v.part.where("p_partkey % 10 = 1").select(F.lower("p_brand").alias("name")))


@query("""SELECT query, total, kinds, top_files FROM (SELECT name AS query, count(*) AS total FROM symbols GROUP BY 1 HAVING count(*) > 20)
  JOIN (SELECT name AS query, array_to_string(list(kind || '=' || n ORDER BY kind || '=' || n), ',') AS kinds FROM (SELECT name, kind, count(*) AS n FROM symbols GROUP BY ALL) GROUP BY 1) USING (query)
  JOIN (SELECT name AS query, array_to_string(list(path ORDER BY r), ',') AS top_files FROM (SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, path) AS r FROM symbols GROUP BY name, path) WHERE r <= 5 GROUP BY 1) USING (query)""", _SYMBOLS)
def lookup_summary(v: Views):
    return C.lookup_summary(symbols(v).withColumn("query", F.col("name")))


@query("SELECT ordinal FROM symbols WHERE kind NOT IN ('Import', 'Variable')", _SYMBOLS)
def exclude_noise_kinds(v: Views):
    return C.exclude_noise_kinds(symbols(v)).select("ordinal")


_DIAGNOSTICS = "diagnostics AS (SELECT event_id AS diagnostic_id, ['error', 'warning', 'note'][event_id % 3 + 1] AS level, ['src/a', '/abs/b', '<anon>', 'src/c'][event_id % 4 + 1] AS path, CASE WHEN event_id % 5 > 0 THEN 'E' || (event_id % 7) END AS code, user_id AS line FROM events)"


def diagnostics(v: Views):
    pick = lambda values: F.get(F.array(*[F.lit(x) for x in values]), (F.col("event_id") % len(values)).cast("int"))
    return v.events.select(F.col("event_id").alias("diagnostic_id"), pick(["error", "warning", "note"]).alias("level"), pick(["src/a", "/abs/b", "<anon>", "src/c"]).alias("path"),
                           F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("E"), F.col("event_id") % 7)).alias("code"), F.col("user_id").alias("line"))


@query("SELECT diagnostic_id FROM diagnostics WHERE level IN ('error', 'warning') AND path = 'src/a'", _DIAGNOSTICS)
def filter_diagnostics(v: Views):
    return C.filter_diagnostics(diagnostics(v), "warning", "a").select("diagnostic_id")


@query("SELECT min(diagnostic_id) AS diagnostic_id FROM diagnostics WHERE level IN ('error', 'warning') AND code IS NOT NULL GROUP BY code, path, line", _DIAGNOSTICS)
def lint_issues(v: Views):
    return C.lint_issues(diagnostics(v)).select("diagnostic_id")


_STRINGS = ["https://x.y", "../a/b", "SELECT a FROM b", "$HOME", "v1.2.3", "4.15.0", "warn: slow", "it failed here", "n = {}", "serde-json", "plain words", "%TEMP%", "C:\\\\x"]
_WANT = ["url", "path", "sql", "env", "version", "version", "log", "error", "format", "package", "general", "env", "path"]


@query("SELECT p_partkey, [" + ", ".join(f"'{w}'" for w in _WANT) + f"][p_partkey % {len(_WANT)} + 1] AS class FROM part")
def classify_string(v: Views):
    value = F.get(F.array(*[F.lit(s.replace("\\\\", "\\")) for s in _STRINGS]), (F.col("p_partkey") % len(_STRINGS)).cast("int"))
    return v.part.select("p_partkey", C.classify_string(value).alias("class"))


_PATHS = "paths AS (SELECT p_partkey, ['src/a.rs', 'x/tests/b.py', 'y/vendor/test_c.js', 'lib/d_test.go', 'e.rs'][p_partkey % 5 + 1] AS path FROM part)"


@query("""SELECT p_partkey, regexp_matches(path, '/tests/|test_|_test\\.') AS is_test, CAST(CASE WHEN contains(path, '/vendor/') THEN 2 WHEN regexp_matches(path, '/tests/|_test\\.') THEN 1 ELSE 0 END AS INT) AS class,
  CASE WHEN len(string_split(path, '/')) > 2 THEN string_split(path, '/')[1] || '/' || string_split(path, '/')[2] ELSE string_split(path, '/')[1] END AS prefix FROM paths""", _PATHS)
def path_classes(v: Views):
    path = F.get(F.array(*[F.lit(p) for p in ("src/a.rs", "x/tests/b.py", "y/vendor/test_c.js", "lib/d_test.go", "e.rs")]), (F.col("p_partkey") % 5).cast("int"))
    return v.part.select("p_partkey", is_test_path(path).alias("is_test"), source_class(path).alias("class"), module_prefix(path).alias("prefix"))


@query("""SELECT doc_id, i AS line, CASE WHEN contains(s, 'TODO') THEN 'TODO' WHEN contains(s, 'FIXME') THEN 'FIXME' END AS marker FROM (SELECT doc_id, i, string_split(t, chr(10))[i] || CASE (doc_id + i - 1) % 3 WHEN 0 THEN ' FIXME TODO' WHEN 1 THEN ' FIXME' ELSE '' END AS s
  FROM (SELECT doc_id, text AS t, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INT) AS i FROM documents)) WHERE contains(s, 'FIXME')""")
def work_markers(v: Views):
    lines = F.transform(F.split("text", "\n"), lambda s, i: F.concat(s, F.when((F.col("doc_id") + i) % 3 == 0, " FIXME TODO").when((F.col("doc_id") + i) % 3 == 1, " FIXME").otherwise("")))
    return C.work_markers(v.documents.select(F.col("doc_id").alias("path"), F.array_join(lines, "\n").alias("content"))).withColumnRenamed("path", "doc_id")
