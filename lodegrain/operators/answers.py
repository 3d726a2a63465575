"""Tables of requests over a code base: the passes that find their targets, and what each request is given to read. All requests run
at once; every step is a join on request, name or path, so nothing loops over requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_test_path
from ..sources.snapshots import saved
from .code import called_symbols, config_references, enrich_targets_with_code
from .consistency import drop_stale_targets, exclude_noise_kinds, lookup_symbol, query_complexity, rank_targets
from .questions import STOP_WORDS, clean_query, query_intent, security_context, target_union, tests_for_symbols
from .requests import TIER_CLUSTERS, TIER_FILES, coherence_gate, drop_synonym_only_hits, histories_for_targets, implementation_twins, prune_to_tier, recency_boost, tier_sources
from .retrieval import bm25, code_tokens, drop_low_confidence, hybrid_search
from .topk import by_shuffle, top_k_per

#: Endings of files that a request may name, marks of code in a request, intents whose histories are shown, intents whose
#: targets are scanned, and how an intent is called.
FILE_ENDINGS = ("rs", "py", "js", "ts", "toml")
CODE_MARKS = ("::", "()", ".rs", ".py", ".js")
HISTORY_INTENTS = ("bug_fix", "explain", "refactor", "general")
SCAN_INTENTS = ("security", "bug_fix")
LABELS = {"bug_fix": "bug fix", "security": "security audit", "explain": "code explanation", "refactor": "refactoring", "general": "general inquiry"}
KEY = ["request_id"]


def _words(text: Column, separators: str, inside: str) -> Column:
    """The words of a text without what is no letter, digit or one of `inside` at their ends; none of a null."""
    words = F.transform(F.split(text, separators), lambda w: F.regexp_replace(w, rf"^[^\p{{L}}\p{{N}}{inside}]+|[^\p{{L}}\p{{N}}{inside}]+$", ""))
    return F.coalesce(words, F.array().cast("array<string>"))


def own_terms(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """The words of a request, without synonyms and parts, in lower case."""
    words = F.transform(_words(text, r"[\s?!,]+", "_"), lambda w: F.lower(w))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*stop_words)))


def named_files(requests: DataFrame) -> DataFrame:
    """request_id, name, path, score (null): the files that a request names."""
    found = F.filter(_words(F.col("text"), r"\s+", "./_"), lambda w: w.rlike(rf"\.({'|'.join(FILE_ENDINGS)})$"))
    rows = requests.select("request_id", F.explode(F.array_distinct(found)).alias("path"))
    return rows.select("request_id", F.col("path").alias("name"), "path", F.lit(None).cast("double").alias("score"))


def _found_by_search(requests: DataFrame, symbols: DataFrame, postings: DataFrame, request_vectors: DataFrame | None, vectors: DataFrame | None, working_set: DataFrame | None,
                     limit: int, min_score: float, stop_words: tuple[str, ...]) -> DataFrame:
    terms = clean_query(requests, stop_words, "request_id").withColumnRenamed("request_id", "query_id")
    ranked = bm25(terms, postings, limit, key="symbol_id") if vectors is None else hybrid_search(terms, postings, request_vectors, vectors, limit=limit, key="symbol_id")
    hits = ranked.select(F.col("query_id").alias("request_id"), "symbol_id", "score").join(by_shuffle(symbols.select("symbol_id", "name", "path")), "symbol_id")
    hits = hits if working_set is None else recency_boost(hits, by_shuffle(working_set))
    own = requests.select("request_id", own_terms(F.col("text"), stop_words).alias("terms"))
    return drop_synonym_only_hits(drop_low_confidence(hits, min_score), by_shuffle(own))


def _found_by_name(requests: DataFrame, symbols: DataFrame, stop_words: tuple[str, ...], per_word: int = 4) -> DataFrame:
    words = F.filter(F.transform(_words(F.col("text"), r"\s+", "_"), lambda w: F.lower(w)), lambda w: (F.length(w) >= 3) & ~w.isin(*stop_words))
    asked = requests.select("request_id", F.explode(F.array_distinct(words)).alias("query"))
    first = top_k_per(lookup_symbol(symbols, by_shuffle(asked.select(F.col("query").alias("name")))), ["query"], [F.col("path"), F.col("ordinal")], per_word)
    return asked.join(by_shuffle(exclude_noise_kinds(first)), "query").withColumn("score", F.lit(None).cast("double"))


def _distinct_texts(requests: DataFrame) -> DataFrame:
    """request_id, text: every text once, under its least request_id. Without vectors, what a request is answered depends on its
    text alone, so all passes see a text once, and what they find goes back to its requests by a join on the text."""
    texts = requests.where("text is not null and request_id is not null").groupBy("text").agg(F.min("request_id").alias("request_id")).select("request_id", "text")
    # texts are short and what is done with each is not: a part for each core
    return saved(texts.repartition(requests.sparkSession.sparkContext.defaultParallelism), "texts")


def _for_every_request(found: DataFrame, texts: DataFrame, requests: DataFrame) -> DataFrame:
    """The rows that were found for texts, for each request of the text."""
    of = requests.where("request_id is not null").select(F.col("request_id").alias("__request"), "text").distinct()
    rows = found.join(by_shuffle(texts.withColumnRenamed("text", "__text")), "request_id").drop("request_id").join(by_shuffle(of.withColumnRenamed("text", "__text")), "__text")
    return rows.withColumnRenamed("__request", "request_id").select(*found.columns)


def request_targets(requests: DataFrame, symbols: DataFrame, files: DataFrame, postings: DataFrame, tier: str = "medium", request_vectors: DataFrame | None = None, vectors: DataFrame | None = None,
                    working_set: DataFrame | None = None, limit: int = 5, max_symbols: int = 5, min_score: float = 0.15, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """request_id, rank, pass, name, path, score: what each request (request_id, text) is about. Passes, the first that finds a target
    counts: files it names; ranked search, boosted by the working set (path, name), without weak hits and those of synonyms alone;
    for requests without either, symbols of its words; of targets in tests the implementation's first three symbols and the
    symbols they call; of Python targets the classes their quoted dotted names end in; tests of the symbols found. The best
    `max_symbols` stay, then those whose file is there, then what the tier and the coherence of modules allow.

    symbols are (symbol_id, name, path, ordinal, kind), files (path, content), postings those of symbols by symbol_id. Requests
    with a null or empty text or without targets have no row; repeated symbols count once, a path has one file; other columns are
    not read. A text that many requests have is looked at once, but where each has a vector of its own."""
    if vectors is not None:
        return _targets_of(requests.select("request_id", "text"), symbols, files, postings, tier, request_vectors, vectors, working_set, limit, max_symbols, min_score, stop_words)
    texts = _distinct_texts(requests)
    return _for_every_request(_targets_of(texts, symbols, files, postings, tier, request_vectors, vectors, working_set, limit, max_symbols, min_score, stop_words), texts, requests)


def _targets_of(requests: DataFrame, symbols: DataFrame, files: DataFrame, postings: DataFrame, tier: str = "medium", request_vectors: DataFrame | None = None, vectors: DataFrame | None = None,
                working_set: DataFrame | None = None, limit: int = 5, max_symbols: int = 5, min_score: float = 0.15, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """The rows of request_targets for requests that differ in text."""
    symbols = symbols.dropDuplicates(["path", "name", "ordinal"])
    served = target_union({"explicit": named_files(requests), "search": _found_by_search(requests, symbols, postings, request_vectors, vectors, working_set, limit, min_score, stop_words)}, KEY)
    served = saved(served, "served")
    named = _found_by_name(requests.join(by_shuffle(served.select("request_id").distinct()), "request_id", "left_anti"), symbols, stop_words)
    found = saved(served.unionByName(target_union({"named": named}, KEY)), "found")

    unscored = F.lit(None).cast("double").alias("score")
    tests = found.where(is_test_path(F.col("path"))).select("request_id", "name", "path")
    paths = tests.select("path").distinct()
    firsts = exclude_noise_kinds(top_k_per(symbols, ["path"], [F.col("ordinal")], 3)).select("path", "name")
    twins = tests.select("request_id", F.col("path").alias("test")).join(by_shuffle(implementation_twins(paths, by_shuffle(files))), "test").join(by_shuffle(firsts), "path").select("request_id", "name", "path", unscored)
    bodies = files.join(by_shuffle(paths), "path", "left_semi").select("path", F.col("content").alias("body"))
    calls = called_symbols(bodies, by_shuffle(symbols)).withColumnRenamed("name", "called")
    called = tests.join(by_shuffle(calls), "path").where("called <> name").select("request_id", F.col("called").alias("name"), F.col("symbol_path").alias("path"), unscored)
    found = target_union({**{p: found.where(F.col("pass") == p) for p in ("explicit", "search", "named")}, "twins": twins, "called": called}, KEY)
    found = saved(found, "found_by_tests")

    scripts = found.where(F.col("path").endswith(".py")).select("request_id", "path").distinct()
    quoted = config_references(files.join(by_shuffle(scripts.select("path").distinct()), "path", "left_semi"), by_shuffle(symbols))
    config = scripts.join(by_shuffle(quoted), "path").select("request_id", "name", F.col("symbol_path").alias("path"), unscored)
    config = config.join(by_shuffle(found.select("request_id", "name").distinct()), ["request_id", "name"], "left_anti")
    sources = saved(found.unionByName(target_union({"config": config}, KEY)), "sources")
    symbol = ~is_test_path(F.col("path")) & (F.col("pass") != "explicit")
    asked = sources.withColumn("name", F.when(symbol, F.col("name")))
    names = asked.where("name is not null").select(F.col("name").alias("query_id")).distinct()
    terms = names.select("query_id", F.explode(F.array_distinct(code_tokens(F.col("query_id")))).alias("term"), F.lit(1.0).alias("weight"))
    hits = bm25(terms, postings, 10, key="symbol_id").join(by_shuffle(symbols.select("symbol_id", F.col("name").alias("symbol"), "path")), "symbol_id")
    exercised = tests_for_symbols(by_shuffle(asked), by_shuffle(hits.select(F.col("query_id").alias("name"), "symbol", "path", "score")), KEY).withColumnRenamed("symbol", "name")

    every = sources.unionByName(target_union({"tests": exercised}, KEY))
    ranked = drop_stale_targets(rank_targets(every, KEY, max_symbols), by_shuffle(files)).withColumnRenamed("rank", "target_id")
    kept = coherence_gate(by_shuffle(prune_to_tier(ranked, TIER_FILES[tier])), TIER_CLUSTERS[tier])
    return kept.select("request_id", F.col("target_id").alias("rank"), "pass", "name", "path", "score")


def code_preview(kind: Column, snippet: Column, most_lines: int = 12, most_chars: int = 400) -> Column:
    """What a line about a symbol says of its code: methods of an interface, fields or variants of a type, else the lines of a body but
    the first, blank ones, comments and braces, while they are within both limits; null without any."""
    lines = F.transform(F.split(snippet, "\n"), lambda s: F.trim(s))
    methods = F.array_distinct(F.filter(F.transform(lines, lambda s: F.regexp_extract(s, r"^(?:(?!fn ).)*fn (\w+)", 1)), lambda m: m != ""))
    members = F.filter(lines, lambda s: ~s.rlike(r"^(//|#\[|(pub )?(struct|enum|class)|[{}]$)"))
    fields = F.array_distinct(F.filter(F.transform(members, lambda s: F.regexp_extract(s, r"^(?:pub )?\s*(\w+)", 1)), lambda m: m != ""))
    said = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda s: ~s.rlike(r"^(//|$|\{$|\};?$)"))

    def taken(done: Column, s: Column) -> Column:
        full = done["full"] | (F.size(done["out"]) >= most_lines) | (done["chars"] + F.length(s) > most_chars)
        return F.struct(F.when(full, done["out"]).otherwise(F.concat(done["out"], F.array(s))).alias("out"), F.when(full, done["chars"]).otherwise(done["chars"] + F.length(s) + 3).alias("chars"), full.alias("full"))

    body = F.aggregate(said, F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("chars"), F.lit(False).alias("full")), taken)["out"]
    listed = lambda title, names, by: F.when(F.size(names) > 0, F.concat(F.lit(f"{title}: "), F.array_join(names, by)))
    return (F.when(kind == "Interface", listed("Methods", methods, ", ")).when(kind.isin("Struct", "Class"), listed("Fields", fields, ", "))
            .when(kind == "Enum", listed("Variants", fields, ", ")).when(kind.isin("Function", "Method"), listed("Body", body, " | ")))


def _joined(rows: DataFrame, order: list[str], line: Column, name: str) -> DataFrame:
    """request_id, name: the lines of a request in order; a request has few targets."""
    lines = F.array_sort(F.collect_list(F.struct(*order, line.alias("__line"))))
    return rows.groupBy("request_id").agg(F.array_join(F.transform(lines, lambda x: x["__line"]), "\n").alias(name))


def _diagnostics(asked: DataFrame, targets: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """request_id, errors, warnings: of the request's files, and errors elsewhere, one a line of a file; all of them for a request
    without files."""
    error, warning = F.col("level") == "error", F.col("level") == "warning"
    per_line = diagnostics.groupBy("path", "line").agg(F.count_if(error).alias("e"), F.count_if(warning).alias("w"))
    per_path = per_line.groupBy("path").agg(F.sum("e").alias("e"), F.count_if(F.col("e") > 0).alias("places"), F.sum("w").alias("w"))
    whole = per_path.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"all_{c}") for c in ("e", "places", "w")])
    own = targets.select("request_id", "path").distinct().join(by_shuffle(per_path), "path", "left").groupBy("request_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("e", "places", "w")])
    rows = asked.select("request_id").join(by_shuffle(own), "request_id", "left").join(F.broadcast(whole), F.lit(True))  # one row
    return rows.select("request_id", F.coalesce(F.col("e") + F.col("all_places") - F.col("places"), F.col("all_e")).alias("errors"), F.coalesce("w", "all_w").alias("warnings"))


def answer_batch(requests: DataFrame, symbols: DataFrame, files: DataFrame, postings: DataFrame, diagnostics: DataFrame, history: DataFrame, tier: str = "medium", raw: bool = False, **how) -> DataFrame:
    """request_id, intent, complexity, targets, symbols, errors, warnings, commits, status, context, sid for a table of requests: what
    `request_targets` finds (`how` goes there), the intent (`explain` in place of none where a symbol was found), symbols with their
    code, diagnostics (path, line, level), the newest commits of history (path, commit_id, epoch), a scan of the targets' texts
    for intents that ask for it, the text that says all this, and symbols per thousand tokens of it. With `raw`, and always in the
    smallest tier, the text ends in the targets' source within the tier's budget.

    Every request has a row; a null text is an empty one. symbols carry line_start and line_end beside what request_targets reads.
    A text that many requests have is answered once, but where each has a vector of its own."""
    requests = requests.select("request_id", F.coalesce("text", F.lit("")).alias("text"))
    if how.get("vectors") is not None:
        return _answers_of(requests, symbols, files, postings, diagnostics, history, tier, raw, **how)
    texts = _distinct_texts(requests)
    return _for_every_request(_answers_of(texts, symbols, files, postings, diagnostics, history, tier, raw, **how), texts, requests)


def _answers_of(requests: DataFrame, symbols: DataFrame, files: DataFrame, postings: DataFrame, diagnostics: DataFrame, history: DataFrame, tier: str, raw: bool, **how) -> DataFrame:
    """The rows of answer_batch for requests that differ in text."""
    symbols = symbols.dropDuplicates(["path", "name", "ordinal"])
    targets = saved(_targets_of(requests, symbols, files, postings, tier, **how), "request_targets")
    per = targets.groupBy("request_id").agg(F.count("*").alias("targets"), F.max(F.col("pass") != "explicit").alias("of_symbols"))
    marks = F.lit(False)
    for mark in CODE_MARKS:
        marks = marks | F.col("text").contains(mark)
    asked = requests.join(by_shuffle(per), "request_id", "left").select(
        "request_id", "text", F.coalesce("targets", F.lit(0)).alias("targets"), query_intent(F.col("text"), F.coalesce("of_symbols", F.lit(False))).alias("intent"), query_complexity(F.col("text"), marks).alias("complexity"))
    asked = saved(asked, "asked")
    of = lambda intents: targets.join(by_shuffle(asked.where(F.col("intent").isin(*intents)).select("request_id")), "request_id", "left_semi")

    code = enrich_targets_with_code(targets.select("request_id", "rank", "name", "path"), symbols, files)
    line = F.concat_ws("\n  ", F.format_string("Found %s `%s` in %s at line %d", F.lower("kind"), "symbol", "symbol_path", "line_start"), code_preview(F.col("kind"), F.col("snippet")))
    code = _joined(code, ["rank", "symbol_path", "line_start"], line, "code").join(by_shuffle(code.groupBy("request_id").agg(F.count("*").alias("symbols"))), "request_id")
    commits = histories_for_targets(of(HISTORY_INTENTS), by_shuffle(history)).groupBy("request_id", "path").agg(F.count("*").alias("n"))
    past = _joined(commits, ["path"], F.format_string("History of %s: %d recent commits", "path", "n"), "past").join(by_shuffle(commits.groupBy("request_id").agg(F.sum("n").alias("commits"))), "request_id")
    status = security_context(by_shuffle(asked), of(SCAN_INTENTS), by_shuffle(files.select("path", F.col("content").alias("text"))), doc="path").select("request_id", "status")

    rows = asked.join(by_shuffle(code), "request_id", "left").join(by_shuffle(past), "request_id", "left").join(by_shuffle(status), "request_id").join(by_shuffle(_diagnostics(asked, targets, diagnostics)), "request_id")
    rows = rows.withColumn("status", F.when((F.col("intent") == "bug_fix") & (F.col("targets") == 0), "CLEAN").otherwise(F.col("status")))
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("symbols", "commits")})
    label = F.coalesce(*[F.when(F.col("intent") == k, v) for k, v in LABELS.items()])
    head = (F.when(F.col("complexity") == "quick", F.concat(F.lit('Brief answer for "'), "text", F.lit('" ('), label, F.lit("):")))
            .when(F.col("complexity") == "deep", F.concat(F.lit('Detailed analysis for "'), "text", F.lit('", intent: '), label)).otherwise(F.concat(F.lit('Query: "'), "text", F.lit('" | Intent: '), label)))
    parts = [head, F.col("code"), F.when(F.col("errors") + F.col("warnings") > 0, F.format_string("Diagnostics: %d errors, %d warnings", "errors", "warnings")), F.col("past"),
             F.when(F.col("status") != "NOT_SCANNED", F.concat(F.lit("Security: "), "status"))]
    if raw or tier == "small":
        first = top_k_per(symbols, ["path", "name"], [F.col("ordinal")], 1).select("path", "name", "kind", "line_start", "line_end")
        wanted = targets.withColumnRenamed("rank", "item_id").join(by_shuffle(first), ["path", "name"], "left")
        shown = tier_sources(by_shuffle(wanted), by_shuffle(files), tier)
        source = F.format_string("--- %s:%d-%d\n%s", "path", "first", "last", "source")
        rows = rows.join(by_shuffle(_joined(shown.join(by_shuffle(wanted.select("request_id", "item_id")), ["request_id", "item_id"]), ["item_id"], source, "sources")), "request_id", "left")
        parts.append(F.col("sources"))
    rows = rows.withColumn("context", F.concat_ws("\n", *parts))
    sid = F.col("symbols") / (F.greatest(F.octet_length("context") / 4, F.lit(1.0)) / 1000)
    return rows.select("request_id", "intent", "complexity", "targets", "symbols", "errors", "warnings", "commits", "status", "context", F.round(sid, 6).alias("sid"))
