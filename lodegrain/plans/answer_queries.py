"""Queries of requests over a code base: five parts are a job, a unit, a vendored copy, a model and a test; orders ask about them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import questions as Q
from ..operators.retrieval import build_postings, code_tokens
from ..operators.topk import by_shuffle
from ..sources.snapshots import saved
from .catalog import Views, query
from .fixtures import COMMITS, commits
from .question_queries import _CLEAN

_WORD = "translate(CAST({} AS VARCHAR(20)), '0123456789', 'abcdefghij')"
#: Text of both sides; {x} is a table. Every third name is one word, so that no token is shared by all.
_TABLES = {
    "paths": f"""SELECT p, k, r, w, size, CASE r WHEN 0 THEN 'crates/m' || CAST(k % 20 AS VARCHAR(20)) || '/src/job' || w || ext WHEN 1 THEN 'crates/m' || CAST((k + 7) % 20 AS VARCHAR(20)) || '/src/unit' || w || '.rs'
    WHEN 2 THEN 'web/vendor/lib' || w || '.js' WHEN 3 THEN 'crates/m' || CAST(k % 20 AS VARCHAR(20)) || '/src/model' || w || '.rs' ELSE 'crates/m' || CAST(k % 20 AS VARCHAR(20)) || '/tests/job' || w || '_test' || ext END AS path
  FROM (SELECT p, k, p % 5 AS r, size, {_WORD.format('k')} AS w, CASE WHEN k % 2 = 0 THEN '.py' ELSE '.rs' END AS ext FROM (SELECT p_partkey AS p, CAST(floor(p_partkey / 5) AS BIGINT) AS k, p_size AS size FROM {{part}}))""",
    "symbols": """SELECT p * 10 AS symbol_id, path, 0 AS ordinal, 'handle' || w AS name, 'Function' AS kind, 1 AS line_start, 3 AS line_end FROM {paths} WHERE r <= 2
  UNION ALL SELECT p * 10 + 1, path, 1, 'State' || w, 'Struct', 4, 4 FROM {paths} WHERE r = 0 UNION ALL SELECT p * 10 + 1, path, 1, 'std', 'Import', 4, 4 FROM {paths} WHERE r = 1
  UNION ALL SELECT p * 10, path, 0, 'Model' || w, 'Struct', 1, 3 FROM {paths} WHERE r = 3
  UNION ALL SELECT p * 10 + 1, path, 1, CASE WHEN k % 100 = 7 THEN 'parser' ELSE 'codec' END, 'Function', 4, 6 FROM {paths} WHERE r = 3 AND k % 100 IN (7, 8)
  UNION ALL SELECT p * 10, path, 0, 'check_handle' || w, 'Function', 1, 4 FROM {paths} WHERE r = 4 UNION ALL SELECT p * 10 + 1, path, 1, 'check_parser', 'Function', 5, 7 FROM {paths} WHERE r = 4 AND k % 100 = 7""",
    "files": """SELECT path, CASE WHEN r <= 2 THEN 'pub fn handle' || w || '(x: u8) {{' || chr(10) || '    let y = step(x);' || chr(10) || '}}' || CASE r WHEN 0 THEN chr(10) || 'pub struct State' || w || ';' WHEN 1 THEN chr(10) || 'use std::fmt;' ELSE '' END
    WHEN r = 3 THEN 'pub struct Model' || w || ' {{' || chr(10) || '    pub size: u8,' || chr(10) || '}}' || CASE WHEN k % 100 = 7 THEN chr(10) || 'pub fn parser() {{' || chr(10) || '    scan();' || chr(10) || '}}' WHEN k % 100 = 8 THEN chr(10) || 'pub fn codec() {{' || chr(10) || '    scan();' || chr(10) || '}}' ELSE '' END
    ELSE 'fn check_handle' || w || '() {{' || chr(10) || '    handle' || w || '(1);' || chr(10) || '    load("app.core.Model' || w || '");' || chr(10) || '}}' || CASE WHEN k % 100 = 7 THEN chr(10) || 'fn check_parser() {{' || chr(10) || '    parser();' || chr(10) || '}}' ELSE '' END
      || CASE WHEN k % 10 = 3 THEN chr(10) || 'let key = "AKIA' || 'Q7ZX2M4LPT9RWKDV";' ELSE '' END END AS content FROM {paths}""",
    "requests": f"""SELECT o AS request_id, CASE o % 6 WHEN 0 THEN 'why does crates/m' || CAST(k % 20 AS VARCHAR(20)) || '/src/job' || w || CASE WHEN k % 2 = 0 THEN '.py' ELSE '.rs' END || ' fail' WHEN 1 THEN 'fix the crash in handle' || w || ' and State' || w
    WHEN 2 THEN 'explain Model' || w WHEN 3 THEN 'audit crates/m' || CAST(k % 20 AS VARCHAR(20)) || '/tests/job' || w || '_test' || CASE WHEN k % 2 = 0 THEN '.py' ELSE '.rs' END || ' for a leak'
    WHEN 4 THEN 'decode the parse tree' ELSE 'hello there, what now? Really?' END AS text
  FROM (SELECT o, k, {_WORD.format('k')} AS w FROM (SELECT o_orderkey AS o, CAST(floor(o_orderkey / 6) AS BIGINT) % n AS k FROM {{orders}}, (SELECT CAST(floor(count(*) / 5) AS BIGINT) AS n FROM {{part}})))""",
    "diagnostics": "SELECT path, size % 5 + 1 AS line, CASE WHEN size % 10 = 0 THEN 'error' WHEN size % 3 = 0 THEN 'warning' ELSE 'note' END AS level FROM {paths}",
    "recent": "SELECT path, CAST(NULL AS VARCHAR(20)) AS name FROM {paths} WHERE p % 50 = 1",
}


def code_base(v: Views):
    """The tables by name; paths, symbols and files are read many times and saved."""
    made = {"part": v.part, "orders": v.orders}
    for name, text in _TABLES.items():
        used = {t: made[t] for t in made if "{" + t + "}" in text}
        made[name] = v.spark.sql(text, **used)
        if name in ("paths", "symbols", "files"):
            made[name] = saved(made[name], f"code_{name}")
    functions = made["symbols"].where("kind = 'Function'")
    made["postings"] = saved(build_postings(functions, "symbol_id", {"name": code_tokens(F.col("name"))}), "code_postings")
    made["history"] = v.lineitem.select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("p")).distinct().join(by_shuffle(made["paths"].select("p", "path")), "p").join(by_shuffle(commits(v)), "commit_id").select("path", "commit_id", "epoch")
    return made


def _targets(v: Views, made: dict, tier: str):
    return A.request_targets(made["requests"], made["symbols"], made["files"], made["postings"], tier, working_set=made["recent"])


def _is_test(path: str) -> str:
    return f"contains({path}, '/tests/')"


_SQL_TABLES = ", ".join(f"{name} AS ({text.format(**{t: t for t in (*_TABLES, 'part', 'orders')})})" for name, text in _TABLES.items())
_STOP = "[" + ", ".join(f"'{w}'" for w in Q.STOP_WORDS) + "]"
_FOUND = "RECURSIVE " + _SQL_TABLES + ", asked AS (SELECT request_id AS query_id, text FROM requests), words AS" + _CLEAN.split("words AS", 1)[1] + f""",
weighted AS (SELECT query_id, unnest(terms) AS term, 3.0::DOUBLE AS weight FROM terms UNION ALL SELECT query_id, unnest(done), 0.5::DOUBLE FROM (SELECT query_id, max_by(done, i) AS done FROM folded GROUP BY 1)),
tokens AS (SELECT symbol_id, unnest(CASE WHEN contains(name, '_') THEN [name] || string_split(name, '_') ELSE [name] END) AS term FROM symbols WHERE kind = 'Function'),
lengths AS (SELECT symbol_id, count(*) AS length FROM tokens GROUP BY 1), averages AS (SELECT count(*) AS docs, avg(length) AS al FROM lengths), dfs AS (SELECT term, count(*) AS df FROM tokens GROUP BY 1),
parts AS (SELECT term, symbol_id, ln(1 + (docs - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / al)) AS part FROM tokens JOIN dfs USING (term) JOIN lengths USING (symbol_id), averages),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, symbol_id) AS r FROM (SELECT query_id, symbol_id, round(sum(part * weight), 9) AS score FROM weighted JOIN parts USING (term) GROUP BY ALL)),
own AS (SELECT request_id, list_filter(list_transform(regexp_split_to_array(text, '[\\s?!,]+'), lambda w: lower(w)), lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w)) AS own FROM requests),
searched AS (SELECT request_id, name, path, score FROM (SELECT request_id, name, path, score * CASE WHEN path IN (SELECT path FROM recent) THEN 1.2 ELSE 1.0 END AS score, own FROM ranked JOIN symbols USING (symbol_id) JOIN own ON request_id = query_id WHERE r <= 5)
  WHERE score >= 0.15 AND len(list_filter(own, lambda t: contains(lower(name), t) OR contains(lower(path), t))) > 0),
explicit AS (SELECT DISTINCT request_id, word AS name, word AS path FROM (SELECT request_id, unnest(string_split(text, ' ')) AS word FROM requests) WHERE regexp_matches(word, '\\.(rs|py|js|ts|toml)$')),
named AS (SELECT DISTINCT request_id, name, path FROM (SELECT request_id, lower(unnest(string_split(text, ' '))) AS word FROM requests WHERE request_id NOT IN (SELECT request_id FROM searched UNION ALL SELECT request_id FROM explicit))
  JOIN (SELECT *, row_number() OVER (PARTITION BY lower(name) ORDER BY path, ordinal) AS r FROM symbols) ON word = lower(name) WHERE r <= 4 AND kind <> 'Import' AND length(word) >= 3),
pass1 AS (SELECT request_id, 0 AS place, 'explicit' AS pass, name, path, NULL::DOUBLE AS score FROM explicit UNION ALL SELECT request_id, 1, 'search', name, path, score FROM searched UNION ALL SELECT request_id, 2, 'named', name, path, NULL FROM named),
seen1 AS (SELECT * FROM pass1 QUALIFY row_number() OVER (PARTITION BY request_id, name, path ORDER BY place, score DESC) = 1),
tests AS (SELECT request_id, name, path FROM seen1 WHERE {_is_test('path')}),
firsts AS (SELECT name, path FROM symbols WHERE ordinal < 3 AND kind <> 'Import'),
called AS (SELECT path, name, spath FROM (SELECT DISTINCT path, unnest(regexp_extract_all(content, '(\\w+)\\s*\\(', 1)) AS name FROM files WHERE {_is_test('path')})
  JOIN (SELECT name, path AS spath, kind FROM symbols QUALIFY row_number() OVER (PARTITION BY name ORDER BY path, ordinal) <= 2) USING (name) WHERE kind <> 'Import' AND NOT {_is_test('spath')}),
pass2 AS (SELECT * FROM seen1 UNION ALL SELECT request_id, 3, 'twins', f.name, f.path, NULL FROM tests t JOIN firsts f ON f.path = replace(replace(t.path, '/tests/', '/src/'), '_test.', '.')
  UNION ALL SELECT request_id, 4, 'called', c.name, c.spath, NULL FROM tests t JOIN called c ON c.path = t.path AND c.name <> t.name),
seen2 AS (SELECT * FROM pass2 QUALIFY row_number() OVER (PARTITION BY request_id, name, path ORDER BY place, score DESC) = 1),
quoted AS (SELECT path, name, spath FROM (SELECT DISTINCT path, unnest(regexp_extract_all(content, '"(?:\\w+\\.)+([A-Z]\\w+)"', 1)) AS name FROM files WHERE path LIKE '%.py')
  JOIN (SELECT name, path AS spath FROM symbols QUALIFY row_number() OVER (PARTITION BY name ORDER BY path, ordinal) <= 2) USING (name)),
seen3 AS (SELECT * FROM seen2 UNION ALL SELECT DISTINCT request_id, 5, 'config', q.name, q.spath, NULL::DOUBLE FROM seen2 s JOIN quoted q USING (path) WHERE (request_id, q.name) NOT IN (SELECT (request_id, name) FROM seen2)),
sources AS (SELECT DISTINCT request_id, name FROM seen3 WHERE NOT {_is_test('path')} AND pass <> 'explicit' AND length(name) >= 4),
name_hits AS (SELECT n AS name, symbol_id, round(sum(part), 9) AS score FROM (SELECT DISTINCT name AS n, lower(name) AS term FROM sources) JOIN parts USING (term) GROUP BY ALL),
best AS (SELECT h.name, s.name AS symbol, path, score FROM name_hits h JOIN symbols s USING (symbol_id) QUALIFY row_number() OVER (PARTITION BY h.name ORDER BY score DESC, symbol_id) <= 10),
exercised AS (SELECT * FROM (SELECT request_id, path, max(score) AS score, min_by(symbol, (-score, symbol)) AS symbol FROM sources JOIN best USING (name) WHERE {_is_test('path')} AND (request_id, path) NOT IN (SELECT (request_id, path) FROM seen3) GROUP BY request_id, path)
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, path) <= 3),
seen4 AS (SELECT request_id, pass, name, path, score FROM seen3 UNION ALL SELECT request_id, 'tests', symbol, path, score FROM exercised),
placed AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC NULLS LAST, CASE WHEN contains(path, '/vendor/') THEN 2 WHEN {_is_test('path')} THEN 1 ELSE 0 END, name, path) AS rank FROM seen4),
there AS (SELECT * FROM placed WHERE rank <= 5 AND path IN (SELECT path FROM files))"""


def _kept(files: int, clusters: int) -> str:
    """Pruning and the gate of a tier; every path here has three parts and more but the vendored ones, which are gone."""
    return _FOUND + f""", counted AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS n, row_number() OVER (PARTITION BY request_id, path ORDER BY score DESC NULLS LAST, rank) AS of_path FROM there WHERE NOT contains(path, '/vendor/')),
pruned AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC NULLS LAST, rank) AS place FROM counted WHERE n <= {files} OR of_path = 1) WHERE n <= {files} OR place <= {files}),
modules AS (SELECT *, string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS module FROM pruned),
clusters AS (SELECT request_id, module, row_number() OVER (PARTITION BY request_id ORDER BY max(score) DESC NULLS LAST, count(*) DESC, module) AS c FROM modules GROUP BY 1, 2),
whole AS (SELECT request_id, count(*) AS size, count(DISTINCT module) AS m FROM modules GROUP BY 1),
kept AS (SELECT request_id, rank, pass, name, path, score FROM modules JOIN clusters USING (request_id, module) JOIN whole USING (request_id) WHERE size <= 2 OR 1 - (m - 1) / (size - 1) >= 0.4 OR c <= {clusters})"""


@query("SELECT request_id, CAST(rank AS INT) AS rank, pass, name, path, round(score, 6) AS score FROM kept", _kept(4, 2))
def request_targets(v: Views):
    return _targets(v, code_base(v), "medium").withColumn("score", F.round("score", 6))


@query("SELECT request_id, CAST(rank AS INT) AS rank, pass, name, path, round(score, 6) AS score FROM kept", _kept(2, 1))
def request_targets_small(v: Views):
    return _targets(v, code_base(v), "small").withColumn("score", F.round("score", 6))


_INTENT = "CASE greatest(bug_fix, security, explain, refactor) WHEN 0 THEN CASE WHEN of_symbols THEN 'explain' ELSE 'general' END WHEN bug_fix THEN 'bug_fix' WHEN security THEN 'security' WHEN explain THEN 'explain' ELSE 'refactor' END"
_SCORES = ", ".join("(" + " + ".join("CASE WHEN contains(lower(text), '{}') THEN {} ELSE 0 END".format(k.replace("'", "''"), w) for k, w in words.items()) + f") AS {name}" for name, words in Q.INTENTS.items())
_ANSWERS = _kept(4, 2) + ", " + COMMITS + f""", scores AS (SELECT request_id, text, {_SCORES} FROM requests),
per AS (SELECT request_id, count(*) AS targets, bool_or(pass <> 'explicit') AS of_symbols FROM kept GROUP BY 1),
said AS (SELECT request_id, text, coalesce(targets, 0) AS targets, {_INTENT} AS intent, len(regexp_extract_all(text, '\\S+')) AS words, length(text) - length(replace(text, '?', '')) AS marks, regexp_matches(text, '\\.(rs|py|js)') AS code
  FROM scores LEFT JOIN per USING (request_id)),
asked2 AS (SELECT request_id, text, targets, intent, CASE WHEN words <= 4 AND marks <= 1 AND NOT code THEN 'quick' WHEN words >= 30 OR marks > 1 OR (words > 15 AND code) THEN 'deep' ELSE 'standard' END AS complexity FROM said),
lines AS (SELECT request_id, rank, k.path, line_start, 'Found ' || lower(kind) || ' `' || s.name || '` in ' || s.path || ' at line ' || line_start || CASE WHEN kind = 'Struct' AND line_end > line_start THEN chr(10) || '  Fields: size' WHEN kind = 'Struct' THEN ''
    WHEN s.name LIKE 'check_handle%' THEN chr(10) || '  Body: handle' || s.name[13:] || '(1); | load("app.core.Model' || s.name[13:] || '");' WHEN s.name = 'check_parser' THEN chr(10) || '  Body: parser();' WHEN s.name IN ('parser', 'codec') THEN chr(10) || '  Body: scan();' ELSE chr(10) || '  Body: let y = step(x);' END AS line
  FROM kept k JOIN symbols s ON lower(k.name) = lower(s.name) AND k.path = s.path),
code AS (SELECT request_id, count(*) AS symbols, string_agg(line, chr(10) ORDER BY rank, path, line_start) AS code FROM lines GROUP BY 1),
recent5 AS (SELECT path, commit_id FROM (SELECT DISTINCT l_orderkey AS commit_id, path FROM lineitem JOIN paths ON p = l_partkey) JOIN commits USING (commit_id) QUALIFY row_number() OVER (PARTITION BY path ORDER BY epoch DESC, commit_id DESC) <= 5),
past AS (SELECT request_id, sum(n) AS commits, string_agg('History of ' || path || ': ' || n || ' recent commits', chr(10) ORDER BY path) AS past FROM (SELECT request_id, path, count(*) AS n FROM (SELECT DISTINCT request_id, path FROM kept JOIN asked2 USING (request_id) WHERE intent <> 'security') JOIN recent5 USING (path) GROUP BY 1, 2) GROUP BY 1),
diag AS (SELECT path, count_if(level = 'error') AS e, count(DISTINCT CASE WHEN level = 'error' THEN line END) AS places, count_if(level = 'warning') AS w FROM diagnostics GROUP BY 1),
every AS (SELECT sum(e) AS ae, sum(places) AS ap, sum(w) AS aw FROM diag),
own_diag AS (SELECT request_id, sum(coalesce(e, 0)) AS e, sum(coalesce(places, 0)) AS places, sum(coalesce(w, 0)) AS w FROM (SELECT DISTINCT request_id, path FROM kept) LEFT JOIN diag USING (path) GROUP BY 1),
scanned AS (SELECT request_id, bool_or(contains(content, 'AKIA')) AS alert FROM kept JOIN files USING (path) GROUP BY 1),
rows AS (SELECT request_id, intent, complexity, targets, coalesce(symbols, 0) AS symbols, coalesce(e + ap - places, ae) AS errors, coalesce(w, aw) AS warnings, coalesce(commits, 0) AS commits, text, code, past,
    CASE WHEN intent NOT IN ('security', 'bug_fix') THEN 'NOT_SCANNED' WHEN alert OR (targets = 0 AND intent = 'security' AND (SELECT bool_or(contains(content, 'AKIA')) FROM files)) THEN 'ALERT' ELSE 'CLEAN' END AS status,
    CASE intent WHEN 'bug_fix' THEN 'bug fix' WHEN 'security' THEN 'security audit' WHEN 'explain' THEN 'code explanation' WHEN 'refactor' THEN 'refactoring' ELSE 'general inquiry' END AS label
  FROM asked2 LEFT JOIN code USING (request_id) LEFT JOIN past USING (request_id) LEFT JOIN own_diag USING (request_id) LEFT JOIN scanned USING (request_id), every),
texts AS (SELECT *, concat_ws(chr(10), CASE complexity WHEN 'quick' THEN 'Brief answer for "' || text || '" (' || label || '):' WHEN 'deep' THEN 'Detailed analysis for "' || text || '", intent: ' || label ELSE 'Query: "' || text || '" | Intent: ' || label END, code,
  CASE WHEN errors + warnings > 0 THEN 'Diagnostics: ' || errors || ' errors, ' || warnings || ' warnings' END, past, CASE WHEN status <> 'NOT_SCANNED' THEN 'Security: ' || status END) AS context FROM rows)"""


@query("SELECT request_id, intent, complexity, targets, symbols, CAST(errors AS BIGINT) AS errors, CAST(warnings AS BIGINT) AS warnings, CAST(commits AS BIGINT) AS commits, status, context, round(symbols / (greatest(strlen(context) / 4, 1) / 1000), 6) AS sid FROM texts", _ANSWERS)
def answer_batch(v: Views):
    """Every order a request, answered in one job."""
    made = code_base(v)
    return A.answer_batch(made["requests"], made["symbols"], made["files"], made["postings"], made["diagnostics"], made["history"], working_set=made["recent"])
