"""Scans of text tables for secrets, personal data, risky code and prompt markers, and command policies.

Offsets are in characters. Each scan is one projection over the texts: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The default rules (name, pattern).
RULES = [
    ("aws_key", r"AKIA[0-9A-Z]{16}"),
    ("github_token", r"gh[pousr]_[A-Za-z0-9_]{36,}"),
    ("generic_secret", r"""(?i)(password|secret|token|api_key|access_key|client_secret|auth_token|bearer|credentials|private_key|signing_key)\s*[:=]\s*["']?[^\s"']{8,}"""),
    ("private_key", r"-----BEGIN (RSA |EC |DSA )?PRIVATE KEY-----"),
    ("uri_credentials", r"(?i)[a-z][a-z0-9+.-]*://[^:/?#\s]+:[^@/?#\s]+@"),
    ("jwt_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("slack_webhook", r"https://hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]+"),
    ("pii_email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("pii_phone", r"\+[1-9]\d{0,2}[\s.-]?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}"),
    ("pii_ipv4", r"(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"),
]
#: Matches that are no finding.
WHITELIST = [r"(?i)token\s*[:=]\s*[A-Z]\w+", r"(?i)shutdown_token", r"127\.0\.0\.1", r"0\.0\.0\.0", r"(?i)example\.com"]
#: Prompt markers and override phrases.
PROMPT_MARKERS = [
    r"<\|im_start\|>", r"<\|im_end\|>", r"<\|system\|>", r"<\|user\|>", r"<\|assistant\|>", r"\[INST\]", r"\[/INST\]", r"\[SYSTEM\]", r"<<SYS>>", r"<</SYS>>",
    r"(?i)ignore\s+(all\s+)?(previous|above|prior)\s+(instructions?|rules?|prompts?)", r"(?i)disregard\s+(all\s+)?(previous|above|prior)\s+(instructions?|rules?)",
    r"(?i)you\s+are\s+now\s+(in\s+)?(DAN|jailbreak|unrestricted)\s+mode", r"(?i)new\s+system\s+prompt\s*:", r"(?i)override\s+system\s+instructions?",
]
#: Fixed values: (category, confidence, patterns) of risky code.
CODE_PATTERNS = [
    ("sql_injection", "high", [
        r"""(?i)(format!\s*\(\s*"[^"]*(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER)[^"]*\{)""",
        r"(?i)(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER)\s+.*\+\s*[&]?\w+",
        r"(?i)query\s*\(\s*&?format!\s*\(",
    ]),
    ("xss", "medium", [
        r"""\.(innerHTML|outerHTML)\s*=\s*[^"'\s;]""", r"document\.write(ln)?\s*\(", r"\.insertAdjacentHTML\s*\(", r"<[a-zA-Z][^>]*\$\{[^}]*\}[^>]*>",
        r"""(?i)format!\s*\(\s*"[^"]*<[a-z]+[^"]*\{[^"]*\"""",
    ]),
    ("command_injection", "high", [
        r"Command::new\s*\(\s*&?format!\s*\(", r"(?i)(?:exec|system|popen|spawn)\s*\(\s*&?format!\s*\(", r"""(?i)"sh"\s*,\s*"-c"\s*,\s*&?format!\s*\(""",
        r"`[^`]*\$\{[^}]*\}[^`]*`", r"\.arg\s*\(\s*&?format!\s*\(", r"\.args?\s*\(\s*&[a-z_]\w*",
        r"""(?i)(?:subprocess\.(?:call|run|Popen)|os\.(?:system|popen))\s*\(\s*f?["']""", r"""(?i)(?:eval|exec)\s*\(\s*(?:f["']|\w+\s*\+)""",
    ]),
    ("path_traversal", "medium", [
        r"(?:path|root|dir|base|prefix)\S*\.join\s*\(\s*&?\w+\)", r"Path::new\s*\(\s*&?format!\s*\(", r"(?:read_to_string|write|remove_file|create_dir)\s*\(\s*&?format!\s*\(",
    ]),
    ("prompt_injection", "high", PROMPT_MARKERS),
]


#: What a text must hold for a default rule to match at all, one of each: a cheap look before the expression. Lower case.
GUARDS = {
    "aws_key": ["akia"], "github_token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], "private_key": ["private key"], "uri_credentials": ["://"], "jwt_token": ["eyj"],
    "slack_webhook": ["hooks.slack.com"], "pii_email": ["@"], "pii_phone": ["+"], "pii_ipv4": ["."],
    "generic_secret": ["password", "secret", "token", "api_key", "access_key", "auth_token", "bearer", "credentials", "private_key", "signing_key"],
}


def shannon_entropy(text: Column) -> Column:
    """Bits per character; 0 for an empty text. Sorted characters are counted in one fold."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.size(chars).cast("double")
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("t"))
    counted = lambda d: d["t"] + F.when(d["n"] > 1, d["n"] * F.log2(d["n"])).otherwise(0.0)
    inside = F.aggregate(chars, start, lambda d, c: F.when(d["c"] == c, F.struct(c.alias("c"), (d["n"] + 1.0).alias("n"), d["t"].alias("t"))).otherwise(
        F.struct(c.alias("c"), F.lit(1.0).alias("n"), counted(d).alias("t"))), counted)
    return F.when(n > 0, F.log2(n) - inside / n).otherwise(0.0)


def matches_with_offsets(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """Array of (start, end, match): what lies between matches adds up to where each starts. Null without a match, or where the guard,
    which is looked at first, does not hold."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("out"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + F.char_length(x["match"])
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match")))).alias("out"))

    pairs = F.arrays_zip(found.alias("match"), F.slice(between, F.lit(1), F.size(found)).alias("gap"))
    there = text.rlike(pattern) if guard is None else F.when(guard, text.rlike(pattern)).otherwise(False)
    return F.when(there, F.aggregate(pairs, empty, step)["out"])


def dlp_findings(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: list[tuple[str, str]] | None = None,
                 whitelist: list[str] | None = None, min_entropy: float = 3.0) -> DataFrame:
    """key, rule, start, end, match. A match is dropped if it is whitelisted, or if its value part (after the first = or :,
    8 characters at least, else the match) has 8 characters and less entropy than min_entropy; the entropy gate does not
    hold for matches with :// and for generic_secret. Overlapping findings of different rules are all kept."""
    def named(name: str, pattern: str) -> Column:
        words = GUARDS.get(name) if (name, pattern) in RULES else None
        guard = None
        for w in words or []:
            guard = F.col("__low").contains(w) if guard is None else guard | F.col("__low").contains(w)
        found = F.coalesce(matches_with_offsets(F.col(text), pattern, guard), F.array().cast("array<struct<start:int,end:int,match:string>>"))
        return F.transform(found, lambda m: F.struct(F.lit(name).alias("rule"), m["start"].alias("start"), m["end"].alias("end"), m["match"].alias("match")))

    by_rule = [named(*rule) for rule in (RULES if rules is None else rules)]
    lowered = docs.select(key, text, F.lower(text).alias("__low"))
    found = lowered.select(key, F.explode(F.flatten(F.array(*by_rule))).alias("f")).select(key, "f.*")
    for pattern in WHITELIST if whitelist is None else whitelist:
        found = found.where(~F.col("match").rlike(pattern))
    after = F.regexp_replace(F.regexp_extract("match", r"^[^=:]*[=:]\s*([\s\S]*)$", 1), r"""^["']+|["']+$""", "")
    value = F.when(F.length(after) >= 8, after).otherwise(F.col("match"))
    exempt = F.col("match").contains("://") | (F.col("rule") == "generic_secret") | (F.length(value) < 8)
    return found.where(exempt | (shannon_entropy(value) >= min_entropy))


def redact(docs: DataFrame, findings: DataFrame, key: str = "doc_id", text: str = "text", mode: str = "redact") -> DataFrame:
    """key, text, n_findings: spans become [REDACTED], overlapping ones together. mode "block" nulls texts with findings,
    "check" leaves all texts alone."""
    spans = findings.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rows = docs.select(key, text).join(spans, key, "left")
    body = F.col(text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        gap = F.substring(body, done["at"] + 1, s["start"] - done["at"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(fresh, F.concat(done["out"], gap, F.lit("[REDACTED]"))).otherwise(done["out"]).alias("out"))

    done = F.aggregate("spans", start, step)
    clean = F.when(F.col("spans").isNull(), body).otherwise(F.concat(done["out"], F.substring(body, done["at"] + 1, F.char_length(body))))
    shown = {"redact": clean, "block": F.when(F.col("spans").isNull(), body), "check": body}[mode]
    return rows.select(key, shown.alias(text), F.coalesce(F.size("spans"), F.lit(0)).alias("n_findings"))


def decoded_fragments(docs: DataFrame, key: str = "doc_id", text: str = "text", min_entropy: float = 3.0) -> DataFrame:
    """key, kind, fragment: Base64 runs of 20 and more and even hex runs of 20 and more that decode to printable ASCII."""
    hexes = F.filter(F.regexp_extract_all(text, F.lit(r"\b[0-9a-fA-F]{20,}\b"), F.lit(0)), lambda s: F.length(s) % 2 == 0)
    bases = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/]{20,}={0,2}"), F.lit(0)), lambda s: F.rtrim(s, F.lit("=")))
    whole = F.transform(F.filter(bases, lambda s: F.length(s) % 4 != 1), lambda s: F.rpad(s, F.ceil(F.length(s) / 4) * 4, "="))
    plain = lambda b: F.when(F.is_valid_utf8(b.cast("string")), b.cast("string"))
    rows = docs.select(key, F.explode(F.concat(
        F.transform(hexes, lambda s: F.struct(F.lit("hex").alias("kind"), plain(F.unhex(s)).alias("fragment"))),
        F.transform(whole, lambda s: F.struct(F.lit("base64").alias("kind"), plain(F.try_to_binary(s, F.lit("base64"))).alias("fragment"))))).alias("d"))
    rows = rows.select(key, "d.*").where(F.col("fragment").rlike(r"\A[\x20-\x7E\t\n\x0C\r]+\z"))
    return rows.where(shannon_entropy(F.col("fragment")) >= min_entropy)


def merge_concatenations(text: Column) -> Column:
    """String literals joined by + become one."""
    return F.regexp_replace(text, r"""(["'])\s*\+\s*\1""", "")


def combine_findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, rule, n: direct findings, those only visible after joining literals (`concat:`) and in decoded runs (`encoded:`)."""
    direct = dlp_findings(docs, key, text).groupBy(key, "rule").agg(F.count("*").alias("n"))
    # only texts that the join changes are scanned again
    joined = docs.select(key, F.col(text).alias("__as_is"), merge_concatenations(F.col(text)).alias(text)).where(F.col(text) != F.col("__as_is")).select(key, text)
    concat = dlp_findings(joined, key, text).groupBy(key, "rule").agg(F.count("*").alias("n")).join(direct, [key, "rule"], "left_anti")
    inside = dlp_findings(decoded_fragments(docs, key, text), key, "fragment").groupBy(key, "rule").agg(F.count("*").alias("n"))
    prefixed = lambda df, p: df.withColumn("rule", F.concat(F.lit(p), "rule"))
    return direct.unionByName(prefixed(concat, "concat:")).unionByName(prefixed(inside, "encoded:"))


def code_pattern_findings(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, category, line, excerpt (120 characters), confidence: one finding per line and category; blank lines and lines
    that start with //, # or * are skipped."""
    lines = files.select(key, F.posexplode(F.split(content, r"\r?\n")).alias("at", "line"))
    lines = lines.select(key, (F.col("at") + 1).alias("line"), F.trim("line").alias("s")).where(~F.col("s").rlike(r"^($|//|#|\*)"))
    found = F.array(*[F.when(F.greatest(*[F.col("s").rlike(p) for p in patterns]) if len(patterns) > 1 else F.col("s").rlike(patterns[0]),
                             F.struct(F.lit(category).alias("category"), F.lit(confidence).alias("confidence"))) for category, confidence, patterns in CODE_PATTERNS])
    rows = lines.select(key, "line", "s", F.explode(F.filter(found, lambda f: f.isNotNull())).alias("f"))
    return rows.select(key, "f.category", "line", F.substring("s", 1, 120).alias("excerpt"), "f.confidence")


def filter_code_categories(findings: DataFrame, categories: list[str] | None = None) -> DataFrame:
    return findings.where(F.col("category").isin(categories)) if categories else findings


def scan_status(files: DataFrame, findings: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """key, lines, high, medium, status: a line that says CLEAN or ALERT with counts."""
    counted = findings.groupBy(key).agg(F.count_if(F.col("confidence") == "high").alias("high"), F.count_if(F.col("confidence") == "medium").alias("medium"))
    rows = files.select(key, F.size(F.split(content, r"\r?\n")).alias("lines")).join(counted, key, "left").fillna(0, ["high", "medium"])
    alert = F.format_string("ALERT: %d finding(s), %d high, %d medium", F.col("high") + F.col("medium"), F.col("high"), F.col("medium"))
    return rows.withColumn("status", F.when(F.col("high") + F.col("medium") > 0, alert).otherwise("CLEAN"))


def neutralise_prompt_markers(text: Column) -> Column:
    for pattern in PROMPT_MARKERS:
        text = F.regexp_replace(text, pattern, "[REDACTED:PI]")
    return text


def apply_policy(commands: DataFrame, rules: DataFrame, key: str = "command_id", fail_closed: bool = True) -> DataFrame:
    """key, action: rules are (rule_order, pattern, action), patterns literal. A command is cut at ; || && | and line ends;
    each segment gets the first rule whose pattern it holds. A null byte, any deny, and (fail-closed) any segment without
    a rule deny the command; else the last action that is not allow, else allow."""
    parts = commands.select(key, F.col("command").contains("\0").alias("broken"),
                            F.posexplode(F.filter(F.split("command", r"\s*(?:;|\|\||&&|\|)\s*|\n"), lambda s: F.trim(s) != "")).alias("at", "segment"))
    # the rules are configuration: a page of rows
    hits = parts.join(F.broadcast(rules), F.col("segment").contains(F.col("pattern")), "left")
    first = hits.groupBy(key, "broken", "at").agg(F.min_by("action", "rule_order").alias("action"))
    unmatched = F.col("action").isNull() if fail_closed else F.lit(False)
    verdict = first.groupBy(key).agg(F.bool_or(F.col("broken") | F.coalesce(F.col("action") == "deny", F.lit(False)) | unmatched).alias("denied"),
                                     F.max_by("action", F.when(F.col("action") != "allow", F.col("at"))).alias("last"))
    return verdict.select(key, F.when(F.col("denied"), "deny").otherwise(F.coalesce("last", F.lit("allow"))).alias("action"))


