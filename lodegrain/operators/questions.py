"""Tables of natural-language requests: intent, search terms, targets of several passes, tests, security and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import saved
from .retrieval import bm25, hybrid_search
from .security import dlp_findings
from .topk import top_k_per

#: The classes of intent in the order that decides ties, with the weights of their keywords.
INTENTS = {
    "bug_fix": {"crash": 3, "panic": 3, "segfault": 3, "abort": 3, "bug": 2, "broken": 2, "fail": 2, "wrong": 2, "cannot": 2, "compile": 2, "rott": 2, "traceback": 2, "exception": 2,
                "fix": 1, "error": 1, "issue": 1, "errore": 2, "rotto": 2, "problema": 1, "fallisce": 2, "non funziona": 3},
    "security": {"cve": 3, "injection": 3, "xss": 3, "rce": 3, "ssrf": 3, "vulnerability": 3, "exploit": 3, "security": 2, "audit": 2, "secret": 2, "password": 2, "leak": 2, "token": 1,
                 "key": 1, "vuln": 2, "sicurezza": 2, "segreto": 2, "vulnerabilità": 3},
    "explain": {"explain": 2, "what is": 2, "how does": 2, "why": 1, "understand": 2, "describe": 2, "what does": 2, "walk through": 2, "overview": 2, "architecture": 2, "cos'è": 2,
                "perché": 1, "come funziona": 2, "spiega": 2, "descrivi": 2, "mostrami": 2},
    "refactor": {"refactor": 2, "optimize": 2, "restructure": 2, "simplify": 2, "clean": 1, "improve": 1, "extract": 1, "rename": 1, "move": 1, "performance": 2, "speed up": 2, "faster": 2,
                 "slow": 2, "migliora": 2, "pulisci": 1, "ottimizza": 2, "velocizza": 2, "velocità": 2, "intelligenza": 2, "più veloce": 2, "lento": 2},
}
#: Words of a domain and what they also mean.
SYNONYMS = {
    "encode": ["decode", "codec", "encoding"], "decode": ["encode", "codec", "decoding"], "chunk": ["stream", "iter", "iterate"], "route": ["router", "routing", "dispatch"],
    "handle": ["handler", "middleware"], "auth": ["authenticate", "authorization", "login"], "request": ["response", "http"], "parse": ["parser", "parsing", "deserialize"],
    "serialize": ["deserialize", "marshal", "unmarshal"], "connect": ["connection", "socket", "transport"], "transfer": ["transport", "stream"], "index": ["search", "query"],
    "search": ["index", "find"], "test": ["spec", "assert", "expect"], "config": ["configuration", "settings", "options"], "build": ["compile", "make", "assemble"],
    "error": ["exception", "failure", "fault"], "cache": ["memoize", "store", "buffer"], "async": ["await", "future", "promise"], "graph": ["tree", "node", "edge"],
    "schema": ["model", "definition", "structure"], "context": ["ctx", "scope", "environment"], "symbol": ["token", "identifier", "name"], "inject": ["injection", "provide", "supply"],
    "extract": ["extraction", "parse", "pull"], "ranking": ["score", "rank"], "score": ["scoring", "ranking"], "weight": ["boost", "factor"], "boost": ["weight", "factor"],
    "plugin": ["extension", "module", "addon"], "sandbox": ["isolate", "isolation", "jail", "container"], "gym": ["sandbox", "evaluate", "train"],
}
#: What a request's words are stripped of where no list is given.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "do", "does", "for", "from", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "where",
              "which", "why", "with")


def intent_scores(text: Column) -> Column:
    """An array of (intent, score) of the classes with a score, best first, ties in the order of the classes."""
    low = F.lower(text)
    each = [F.struct((-sum((F.when(low.contains(k), w).otherwise(0) for k, w in words.items()), F.lit(0))).alias("minus"), F.lit(i).alias("place"), F.lit(name).alias("intent"))
            for i, (name, words) in enumerate(INTENTS.items())]
    found = F.filter(F.array_sort(F.array(*each)), lambda x: x["minus"] < 0)
    return F.transform(found, lambda x: F.struct(x["intent"].alias("intent"), (-x["minus"]).alias("score")))


def query_intent(text: Column, has_symbols: Column | None = None) -> Column:
    """The best class; without any `general`, which is `explain` where symbols were found for the request."""
    none = F.lit("general") if has_symbols is None else F.when(has_symbols, "explain").otherwise("general")
    return F.coalesce(F.get(intent_scores(text), F.lit(0))["intent"], none)


def expand_synonyms(term: Column) -> Column:
    """What else a lower-case term may stand for: roots of -ed, -ing and -tion, then the domain's words."""
    cut = lambda n: F.substring(term, F.lit(1), F.length(term) - n)
    roots = (F.when(term.endswith("ed"), F.array(cut(2), F.concat(cut(2), F.lit("ing")))).when(term.endswith("ing"), F.array(cut(3), F.concat(cut(3), F.lit("e"))))
             .when(term.endswith("tion"), F.array(cut(4), F.concat(cut(4), F.lit("te")))).otherwise(F.array().cast("array<string>")))
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.concat(roots, F.coalesce(F.try_element_at(table, term), F.array().cast("array<string>"))))


def clean_query(requests: DataFrame, stop_words: tuple[str, ...] = STOP_WORDS, key: str = "query_id", text: str = "text") -> DataFrame:
    """key, term, weight: the words of two characters and more that are no stop words, and the snake and camel parts of three
    and more, each once in lower case with weight 3; at most two synonyms of each with weight 0.5."""
    words = F.transform(F.split(text, r"[\s?!,]+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", ""))
    words = F.filter(words, lambda w: (F.length(w) >= 2) & ~F.lower(w).isin(*stop_words))
    # a name in mixed case is cut before a capital after a small letter or a digit, and before the last of several capitals
    pieces = lambda w: F.filter(F.split(w, r"(?<=[\p{Ll}0-9])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"), lambda p: F.length(p) >= 2)
    camel = lambda w: F.when(w.rlike(r"\p{Ll}") & (F.size(pieces(w)) > 1), pieces(w)).otherwise(F.array().cast("array<string>"))
    parts = lambda w: F.when(w.contains("_"), F.filter(F.split(w, "_"), lambda p: ~F.lower(p).isin(*stop_words))).otherwise(camel(w))
    terms = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.filter(parts(w), lambda p: F.length(p) >= 3))))
    rows = requests.select(key, F.array_distinct(F.transform(terms, lambda t: F.lower(t))).alias("terms"))
    none = F.array().cast("array<string>")
    more = F.aggregate("terms", none, lambda done, t: F.concat(done, F.slice(F.array_except(F.array_except(expand_synonyms(t), F.col("terms")), done), 1, 2)))
    rows = rows.select(key, "terms", more.alias("more"))
    weighted = lambda c, w: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(w).alias("weight")))
    return rows.select(key, F.explode(F.concat(weighted("terms", 3.0), weighted("more", 0.5))).alias("t")).select(key, "t.term", "t.weight")


def target_union(passes: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """The rows (keys, name, path, score) of all passes, with `pass`; of a target that several found, the first pass stays, and
    `by_name` counts only for requests that no pass before it served."""
    out = None
    for i, (name, rows) in enumerate(passes.items()):
        rows = rows.select(*keys, "name", "path", "score")
        if name == "by_name" and out is not None:
            rows = rows.join(out.select(*keys).distinct(), keys, "left_anti")
        rows = rows.withColumns({"pass": F.lit(name), "__place": F.lit(i)})
        out = rows if out is None else out.unionByName(rows)
    return top_k_per(out, [*keys, "name", "path"], [F.col("__place"), F.desc_nulls_last("score")], 1).drop("__place")


#: Fixed value: rows of a request and a test, `per_name` for each name at most, that a task of tests_for_symbols holds.
MOST_ROWS = 1 << 21


def tests_for_symbols(targets: DataFrame, hits: DataFrame, keys: list[str], per_name: int = 10, most: int = 3, least_name: int = 4) -> DataFrame:
    """keys, path, score: of the hits (name, path, score) on a target's name, the best `per_name`, those in tests, none that is
    a target already, `most` per request. Hits with a symbol keep it, the best of a path.

    A name gives its request up to `per_name` rows of few bytes, so these are dealt out by their number."""
    from ..functions.paths import is_test_path

    names = saved(targets.where(F.length("name") >= least_name).select(*keys, "name").distinct(), "names")
    parts = names.count() * per_name // MOST_ROWS + 1
    # a number that is stated is not lessened where the bytes are few
    dealt = lambda rows: rows.repartition(parts, *keys, "path") if parts > 1 else rows
    best = top_k_per(hits, ["name"], [F.desc("score"), F.col("path")], per_name)
    rows = dealt(names.join(best.where(is_test_path(F.col("path"))), "name")).join(dealt(targets.select(*keys, "path")).distinct(), [*keys, "path"], "left_anti")
    symbol = [F.min(F.struct(-F.col("score"), "symbol"))["symbol"].alias("symbol")] if "symbol" in hits.columns else []
    rows = rows.groupBy(*keys, "path").agg(F.max("score").alias("score"), *symbol)
    return top_k_per(rows, keys, [F.desc("score"), F.col("path")], most)


def security_context(requests: DataFrame, targets: DataFrame, docs: DataFrame, key: str = "request_id", doc: str = "doc_id") -> DataFrame:
    """key, scanned, findings, status: the targets (key, doc) of each request; all documents for a request of intent `security`
    without targets; else NOT_SCANNED. A document is scanned once for all requests."""
    found = dlp_findings(docs, doc).groupBy(doc).agg(F.count("*").alias("n"))
    per = targets.select(key, doc).distinct().join(found, doc, "left").groupBy(key).agg(F.count("*").alias("own"), F.coalesce(F.sum("n"), F.lit(0)).alias("own_findings"))
    whole = docs.agg(F.count("*").alias("every")).join(F.broadcast(found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("every_findings"))), F.lit(True))  # one row each
    rows = requests.select(key, "intent").join(per, key, "left").join(F.broadcast(whole), F.lit(True))
    all_of = F.col("own").isNull() & (F.col("intent") == "security")
    rows = rows.withColumn("scanned", F.when(all_of, F.col("every")).otherwise(F.coalesce("own", F.lit(0)))).withColumn("findings", F.when(all_of, F.col("every_findings")).otherwise(F.coalesce("own_findings", F.lit(0))))
    status = F.when(F.col("own").isNull() & ~all_of, "NOT_SCANNED").when(F.col("findings") > 0, "ALERT").otherwise("CLEAN")
    return rows.select(key, "scanned", "findings", status.alias("status"))


def context_text(targets: DataFrame, key: str = "request_id", most_lines: int = 12, most_chars: int = 400) -> DataFrame:
    """key, context: a line per target (rank, path, score, text) in rank order, with the first lines of its text."""
    preview = F.array_join(F.slice(F.split(F.substring("text", 1, most_chars), "\n"), 1, most_lines), "\n")
    line = F.concat(F.lit("## "), F.col("path"), F.format_string(" (%.3f)\n", F.col("score")), F.coalesce(preview, F.lit("")))
    lines = targets.select(key, F.struct("rank", line.alias("line")).alias("l")).groupBy(key).agg(F.sort_array(F.collect_list("l")).alias("all"))
    return lines.select(key, F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("context"))


def ask_batch(requests: DataFrame, docs: DataFrame, postings: DataFrame, request_vectors: DataFrame | None = None, vectors: DataFrame | None = None, limit: int = 5,
              stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """request_id, intent, doc_id, score, rank, status, context for a table of requests (request_id, text): terms, lexical and,
    with vectors, fused search, intent, security and text, in one job for all of them."""
    terms = clean_query(requests.withColumnRenamed("request_id", "query_id"), stop_words)
    hits = bm25(terms, postings, limit) if vectors is None else hybrid_search(terms, postings, request_vectors, vectors, limit=limit)
    # hits are few and read three times: the search is done once
    hits = saved(hits.select(F.col("query_id").alias("request_id"), "doc_id", "score", "rank"), "hits")
    asked = requests.select("request_id", query_intent(F.col("text")).alias("intent"))
    status = security_context(asked, hits, docs)
    shown = hits.join(docs.select("doc_id", "text"), "doc_id").withColumn("path", F.col("doc_id").cast("string"))
    rows = asked.join(hits, "request_id", "left").join(status.select("request_id", "status"), "request_id").join(context_text(shown), "request_id", "left")
    return rows.select("request_id", "intent", "doc_id", "score", "rank", "status", F.coalesce("context", F.lit("")).alias("context"))
