"""Queries of the scans over documents, conversations, parts and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import security as S
from .catalog import Views, query


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ENTROPY = """(SELECT CASE WHEN count(*) = 0 THEN 0.0 ELSE log2(sum(c)) - sum(c * log2(c)) / sum(c) END FROM (SELECT count(*) AS c FROM (SELECT unnest(string_split({}, '')) AS ch) WHERE ch <> '' GROUP BY ch))"""


def _found(name: str, source: str) -> str:
    """The table `name` of findings in a table (doc_id, text)."""
    return ("""NAME_raw AS (SELECT doc_id, rule, pattern, text, regexp_extract_all(text, pattern) AS found, string_split_regex(text, pattern) AS gaps FROM SOURCE,
  (VALUES """ + ", ".join(f"({_quoted(n)}, {_quoted(p)})" for n, p in S.RULES) + """) r(rule, pattern) WHERE regexp_matches(text, pattern)),
NAME_each AS (SELECT doc_id, rule, found, gaps, unnest(range(1, len(found) + 1)) AS i FROM NAME_raw),
NAME_found AS (SELECT doc_id, rule, found[i] AS match, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS INT) AS start FROM NAME_each),
NAME_valued AS (SELECT *, regexp_replace(regexp_extract(match, '^[^=:]*[=:]\\s*((?s:.*))$', 1), '^["'']+|["'']+$', '', 'g') AS after FROM NAME_found WHERE NOT ("""  + " OR ".join(f"regexp_matches(match, {_quoted(p)})" for p in S.WHITELIST) + """)),
NAME_judged AS (SELECT *, CASE WHEN length(after) >= 8 THEN after ELSE match END AS value FROM NAME_valued),
NAME AS (SELECT doc_id, rule, start, CAST(start + length(match) AS INT) AS "end", match FROM NAME_judged WHERE contains(match, '://') OR rule = 'generic_secret' OR length(value) < 8 OR """ + _ENTROPY.format("value") + " >= 3.0)").replace("NAME", name).replace("SOURCE", source)


_FOUND = _found("findings", "documents")


@query("SELECT * FROM findings", _FOUND)
def dlp_findings(v: Views):
    return S.dlp_findings(v.documents)


@query("SELECT rule, count(*) AS n, count(DISTINCT doc_id) AS docs FROM findings GROUP BY rule", _FOUND)
def dlp_rule_counts(v: Views):
    return S.dlp_findings(v.documents).groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("""SELECT d.doc_id, CASE WHEN count(a) = 0 THEN any_value(text) ELSE string_agg(substr(text, before + 1, a - before) || '[REDACTED]', '' ORDER BY a) || substr(any_value(text), max(b) + 1) END AS text, coalesce(any_value(n), 0)::INT AS n_findings
  FROM documents d LEFT JOIN (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before, sum(m) OVER (PARTITION BY doc_id) AS n FROM islands) USING (doc_id) GROUP BY d.doc_id""",
       _FOUND + """, fresh AS (SELECT *, CASE WHEN start >= coalesce(max("end") OVER (PARTITION BY doc_id ORDER BY start, "end", rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) THEN 1 ELSE 0 END AS first FROM findings),
islands AS (SELECT doc_id, min(start) AS a, max("end") AS b, count(*) AS m FROM (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY start, "end", rule) AS island FROM fresh) GROUP BY doc_id, island)""")
def redact(v: Views):
    return S.redact(v.documents, S.dlp_findings(v.documents))


_HIDDEN = """hidden AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' "AKIA" + "' || upper(substr(md5(text), 1, 16)) || '"' WHEN 1 THEN ' blob ' || base64(encode('token AKIA' || upper(substr(md5(text), 1, 16)) || ' end')) ELSE '' END AS text FROM documents),
merged AS (SELECT doc_id, regexp_replace(text, '"\\s*\\+\\s*"|\\x27\\s*\\+\\s*\\x27', '', 'g') AS text, text AS as_is FROM hidden), joined AS (SELECT doc_id, text FROM merged WHERE text <> as_is),
runs AS (SELECT doc_id, unnest(list_transform(list_filter(regexp_extract_all(text, '\\b[0-9a-fA-F]{20,}\\b'), lambda h: length(h) % 2 = 0), lambda h: TRY(decode(unhex(h)))) || list_transform(list_filter(list_transform(
  regexp_extract_all(text, '[A-Za-z0-9+/]{20,}={0,2}'), lambda r: rtrim(r, '=')), lambda r: length(r) % 4 <> 1), lambda r: TRY(decode(from_base64(r || repeat('=', (4 - length(r) % 4) % 4)))))) AS text FROM hidden),
decoded AS (SELECT * FROM runs WHERE regexp_full_match(text, '[\\x20-\\x7E\\t\\n\\f\\r]+') AND """ + _ENTROPY.format("text") + " >= 3), "


@query("""SELECT doc_id, rule, count(*) AS n FROM plain GROUP BY ALL UNION ALL SELECT doc_id, 'concat:' || rule, count(*) FROM beside b WHERE NOT EXISTS (SELECT 1 FROM plain p WHERE p.doc_id = b.doc_id AND p.rule = b.rule) GROUP BY ALL
  UNION ALL SELECT doc_id, 'encoded:' || rule, count(*) FROM inside GROUP BY ALL""", _HIDDEN + ", ".join([_found("plain", "hidden"), _found("beside", "joined"), _found("inside", "decoded")]))
def combine_findings(v: Views):
    """Every third document ends with a key in two literals, every other third with one in a Base64 run."""
    key = F.upper(F.substring(F.md5(F.col("text").cast("binary")), 1, 16))
    blob = F.regexp_replace(F.base64(F.concat(F.lit("token AKIA"), key, F.lit(" end")).cast("binary")), r"\s", "")
    more = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(' "AKIA" + "'), key, F.lit('"'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" blob "), blob)).otherwise("")
    return S.combine_findings(v.documents.select("doc_id", F.concat("text", more).alias("text")))


@query("SELECT item_id, unnest(['base64', 'hex']) AS kind, text AS fragment FROM benchmark WHERE regexp_full_match(text, '[\\x20-\\x7E\\t\\n\\f\\r]+') AND " + _ENTROPY.format("text") + " >= 3")
def decoded_fragments(v: Views):
    """Every benchmark text as a Base64 and a hex run between other words."""
    binary = F.col("text").cast("binary")
    return S.decoded_fragments(v.benchmark.select("item_id", F.concat(F.lit("key is "), F.regexp_replace(F.base64(binary), r"\s", ""), F.lit(" or "), F.hex(binary), F.lit(" here")).alias("text")), "item_id")


@query("SELECT item_id, round(" + _ENTROPY.format("text") + ", 6) AS entropy FROM benchmark")
def shannon_entropy(v: Views):
    return v.benchmark.select("item_id", F.round(S.shannon_entropy(F.col("text")), 6).alias("entropy"))


_TEMPLATES = ['let q = format!("SELECT a FROM t WHERE n = {}", NAME);', "let c = a + b; // NAME", "document.write(NAME)", "el.innerHTML = NAME", "# NAME",
              'Command::new(&format!("rm {}", NAME))', "os.system(f'ls NAME')", "base_dir.join(&user)", "[INST] NAME", "* NAME"]


def _line(a: int, b: int) -> str:
    return "replace([" + ", ".join(_quoted(t) for t in _TEMPLATES) + f"][(p_partkey * {a} + {b}) % 10 + 1], 'NAME', p_name)"


_FILES = f"files AS (SELECT 'src/' || p_partkey AS path, {_line(1, 0)} || chr(10) || chr(10) || {_line(3, 1)} || chr(10) || {_line(7, 4)} AS content FROM part)"


def files(v: Views):
    table = F.array(*[F.lit(t) for t in _TEMPLATES])
    line = lambda a, b: F.replace(F.get(table, ((F.col("p_partkey") * a + b) % 10).cast("int")), F.lit("NAME"), F.col("p_name"))
    return v.part.select(F.concat(F.lit("src/"), "p_partkey").alias("path"), F.concat_ws("\n", line(1, 0), F.lit(""), line(3, 1), line(7, 4)).alias("content"))


_CODE = _FILES + """, lines AS (SELECT path, i AS line, trim(string_split(content, chr(10))[i]) AS s FROM (SELECT *, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM files)),
codes AS (SELECT path, category, line, s[1:120] AS excerpt, confidence FROM lines, (VALUES """ + ", ".join(
    f"({_quoted(c)}, {_quoted(conf)}, {_quoted('|'.join(f'(?:{p})' for p in ps))})" for c, conf, ps in S.CODE_PATTERNS) + """) r(category, confidence, pattern)
  WHERE NOT regexp_matches(s, '^($|//|#|\\*)') AND regexp_matches(s, pattern))"""


@query("SELECT path, category, CAST(line AS INT) AS line, excerpt, confidence FROM codes", _CODE)
def code_pattern_findings(v: Views):
    return S.code_pattern_findings(files(v))


@query("SELECT category, count(*) AS n FROM codes WHERE category IN ('xss', 'path_traversal') GROUP BY category", _CODE)
def filter_code_categories(v: Views):
    return S.filter_code_categories(S.code_pattern_findings(files(v)), ["xss", "path_traversal"]).groupBy("category").agg(F.count("*").alias("n"))


@query("""SELECT path, 4 AS lines, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, CASE WHEN high IS NULL THEN 'CLEAN' ELSE 'ALERT: ' || (high + medium) || ' finding(s), ' || high || ' high, ' || medium || ' medium' END AS status
  FROM files LEFT JOIN (SELECT path, count_if(confidence = 'high') AS high, count_if(confidence = 'medium') AS medium FROM codes GROUP BY path) USING (path)""", _CODE)
def scan_status(v: Views):
    return S.scan_status(files(v), S.code_pattern_findings(files(v)))


_MARKS = ["<|im_start|>", "[INST]", "Ignore all previous instructions", "clean"]


@query("SELECT conv_id, turn, " + "".join("regexp_replace(" for _ in S.PROMPT_MARKERS) + f"[{', '.join(map(_quoted, _MARKS))}][(conv_id + turn) % 4 + 1] || ' ' || text" + "".join(f", {_quoted(p)}, '[REDACTED:PI]', 'g')" for p in S.PROMPT_MARKERS) + " AS text FROM conversations")
def neutralise_prompt_markers(v: Views):
    mark = F.get(F.array(*[F.lit(m) for m in _MARKS]), ((F.col("conv_id") + F.col("turn")) % 4).cast("int"))
    return v.conversations.select("conv_id", "turn", S.neutralise_prompt_markers(F.concat_ws(" ", mark, "text")).alias("text"))


_POLICY = [(1, "rm -rf", "deny"), (2, "git push", "ask"), (3, "git", "allow"), (4, "ls", "allow"), (5, "cargo", "log")]
_COMMANDS = ["git status", "git push && ls", "ls; rm -rf x", "curl y", "cargo test | ls", "ls || git log", "git push; cargo x"]
_COMMAND = "commands AS (SELECT event_id AS command_id, [" + ", ".join(map(_quoted, _COMMANDS)) + "][event_id % 7 + 1] AS command FROM events)"


@query("""SELECT command_id, CASE WHEN bool_or(coalesce(action = 'deny', true)) THEN 'deny' ELSE coalesce(max_by(action, CASE WHEN action <> 'allow' THEN seg END), 'allow') END AS action
  FROM (SELECT command_id, seg, min_by(action, rule_order) AS action FROM (SELECT command_id, unnest(string_split_regex(command, '\\s*(?:;|\\|\\||&&|\\|)\\s*')) AS segment, generate_subscripts(string_split_regex(command, '\\s*(?:;|\\|\\||&&|\\|)\\s*'), 1) AS seg FROM commands)
    LEFT JOIN (VALUES """ + ", ".join(f"({o}, {_quoted(p)}, {_quoted(a)})" for o, p, a in _POLICY) + ") r(rule_order, pattern, action) ON contains(segment, pattern) GROUP BY ALL) GROUP BY command_id", _COMMAND)
def apply_policy(v: Views):
    commands = v.events.select(F.col("event_id").alias("command_id"), F.get(F.array(*[F.lit(c) for c in _COMMANDS]), (F.col("event_id") % 7).cast("int")).alias("command"))
    return S.apply_policy(commands, v.spark.createDataFrame(_POLICY, "rule_order int, pattern string, action string"))
