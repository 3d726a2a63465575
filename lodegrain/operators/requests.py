"""Tables of requests: choosing, pruning and packing their targets. Every row carries request_id; all requests run at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import is_vendor_path, module_prefix
from .consistency import minify_text, prune_log_lines
from .security import neutralise_prompt_markers
from .topk import top_k_per

#: Tokens, tokens for other than sources, percent of the sources' room for critical names, least lines of a source,
#: targets, clusters and files (none: unlimited) of a tier.
TIERS = {
    "small": (2_048, 250, 35, 15, 2, 1, 2),
    "medium": (8_192, 500, 30, 10, 5, 2, 4),
    "large": (16_384, 800, 25, 0, 10, 3, 8),
    "unlimited": (32_768, 1_200, 20, 0, 15, 5, None),
}
#: The share of a tier's tokens that is used, characters of a token, lines shown after a target with a start alone and of
#: one without lines, and lines added to these kinds.
FILL, CHARS_PER_TOKEN, LINES_AFTER, LINES_OF_FILE = 0.8, 4, 30, 60
MORE_LINES = {"enum": 25, "constant": 15}
TIER_FILES = {name: t[6] for name, t in TIERS.items()}
TIER_CLUSTERS = {name: t[5] for name, t in TIERS.items()}
CUT = "\n// ... [truncated] ...\n"


def source_budgets(tier: str) -> tuple[int, int]:
    """Characters of a tier for sources, and for those of critical names beside them."""
    tokens, other, percent = TIERS[tier][:3]
    room = max(0, int(tokens * FILL) - other) * CHARS_PER_TOKEN
    return room, room * percent // 100


def budget_pack(items: DataFrame, budget: int, critical_budget: int, least: int = 200) -> DataFrame:
    """request_id, item_id, taken: characters that each item gets. Critical items come first and spend a pool of their own;
    an item that does not fit is cut if `least` characters remain, else skipped, and later ones are still tried. What a
    request holds is bounded by what a model can read, so one request is one fold; requests are spread over tasks."""
    order = F.struct((~F.col("critical")).alias("later"), (-F.col("score")).alias("minus"), F.col("item_id").alias("item_id"), F.col("size").alias("size"), F.col("critical").alias("critical"))
    rows = items.groupBy("request_id").agg(F.sort_array(F.collect_list(order)).alias("items"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.lit(critical_budget).cast("long").alias("pool"), F.array().cast(f"array<struct<item_id:{dict(items.dtypes)['item_id']},taken:bigint>>").alias("out"))

    def step(done: Column, x: Column) -> Column:
        room = F.when(x["critical"], done["pool"]).otherwise(done["left"])
        taken = F.when(x["size"] <= room, x["size"].cast("long")).when(room >= least, room).otherwise(F.lit(0).cast("long"))
        out = F.when(taken > 0, F.concat(done["out"], F.array(F.struct(x["item_id"].alias("item_id"), taken.alias("taken"))))).otherwise(done["out"])
        return F.struct(F.when(x["critical"], done["left"]).otherwise(done["left"] - taken).alias("left"), F.when(x["critical"], done["pool"] - taken).otherwise(done["pool"]).alias("pool"), out.alias("out"))

    return rows.select("request_id", F.inline(F.aggregate("items", start, step)["out"]))


def snippets(targets: DataFrame, files: DataFrame, least_lines: int = 0) -> DataFrame:
    """The targets (request_id, item_id, path, kind, line_start, line_end) whose path has text in `files` (path, content), with first,
    last (line numbers from 1) and source: lines from line_start to line_end, some more of kinds whose values follow; LINES_AFTER
    lines without an end, the file's first LINES_OF_FILE without a start; at least `least_lines`, never beyond the file. Line
    ends are trimmed, logging is pruned and prompt markers are neutralised. A text joins its targets once per target, for that
    is what a request shows of it; null and empty texts show nothing."""
    rows = targets.join(files.where(F.length("content") > 0).select("path", F.split(F.regexp_replace("content", r"\r?\n\z", ""), r"\r?\n").alias("__lines")), "path")
    n = F.size("__lines")
    more = F.coalesce(*[F.when(F.lower("kind") == k, F.lit(m)) for k, m in MORE_LINES.items()], F.lit(0))
    first = F.least(F.greatest(F.coalesce("line_start", F.lit(1)), F.lit(1)), n)
    last = F.when(F.col("line_start").isNull(), LINES_OF_FILE).otherwise(F.coalesce(F.col("line_end") + more, F.col("line_start") + LINES_AFTER - 1))
    rows = rows.withColumn("first", first).withColumn("last", F.least(F.greatest(last, F.col("first") + max(least_lines, 1) - 1), n))
    source = F.array_join(F.slice("__lines", F.col("first"), F.col("last") - F.col("first") + 1), "\n")
    mark = lambda comment: neutralise_prompt_markers(prune_log_lines(minify_text(source), comment))
    return rows.withColumn("source", F.when(F.col("path").endswith(".py"), mark("#")).otherwise(mark("//"))).drop("__lines")


def shortened(text: Column, room: Column) -> Column:
    """A text longer than `room` characters as its first three quarters and, where over 50 characters are left for it, its end. The
    head stops after the last block, else statement, that closes within its last 200 characters; the end begins with the first
    function, else line, that starts within its first 200."""
    head = F.floor(room * 3 / 4).cast("int")
    tail = (room - head - 30).cast("int")
    before = F.substring(text, 1, head)
    window = F.substring(before, F.greatest(head - 200, F.lit(0)) + 1, F.lit(200))
    closed = F.coalesce(*[F.when(window.rlike(p), F.length(F.regexp_extract(window, p, 0)) - F.length(window)) for p in (r"(?s)\A.*\n\}", r"(?s)\A.*;\n")], F.lit(0))
    after = F.substring(text, F.char_length(text) - tail + 1, tail)
    near = F.substring(after, F.lit(1), F.lit(200))
    skipped = F.coalesce(*[F.when(near.rlike(p), F.length(F.regexp_extract(near, p, 1))) for p in (r"(?s)\A(.*?\n)fn ", r"(?s)\A(.*?\n)pub ", r"(?s)\A(.*?\n)")], F.lit(0))
    both = F.concat(F.substring(before, F.lit(1), head + closed), F.lit(CUT), F.substring(after, skipped + 1, tail))
    return F.when(F.char_length(text) <= room, text).when(tail > 50, both).otherwise(F.substring(text, F.lit(1), room.cast("int")))


def tier_sources(targets: DataFrame, files: DataFrame, tier: str, critical: tuple[str, ...] = (), recency: DataFrame | None = None, weight: float = 0.1) -> DataFrame:
    """request_id, item_id, path, first, last, source: what a tier's budget shows of each request's targets (request_id, item_id, name,
    path, kind, line_start, line_end, score). Names that hold one of the `critical` strings come first, on their own budget,
    and are cut at its end; others follow by score plus `weight` times the recency (path, recency) of their path, and are
    `shortened` where they do not fit. A null score is 0."""
    rows = targets.select("request_id", "item_id", "name", "path", "kind", "line_start", "line_end", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    if recency is not None:
        rows = rows.join(recency.groupBy("path").agg(F.max("recency").alias("__recency")), "path", "left").withColumn("score", F.col("score") + weight * F.coalesce("__recency", F.lit(0.0))).drop("__recency")
    marked = F.lit(False)
    for word in critical:
        marked = marked | F.coalesce(F.col("name").contains(word), F.lit(False))
    shown = snippets(rows, files, TIERS[tier][3]).withColumn("critical", marked).withColumn("size", F.char_length("source").cast("long"))
    taken = budget_pack(shown.select("request_id", "item_id", "critical", "score", "size"), *source_budgets(tier)).where("taken > 0")
    rows = shown.join(taken, ["request_id", "item_id"])
    source = F.when(F.col("critical"), F.substring("source", F.lit(1), F.col("taken").cast("int"))).otherwise(shortened(F.col("source"), F.col("taken")))
    return rows.select("request_id", "item_id", "path", "first", "last", source.alias("source"))


def prune_to_tier(targets: DataFrame, files: int | None) -> DataFrame:
    """For a limited tier: vendor paths go; a request with more targets than files keeps the best of each path, then the
    best `files`."""
    if files is None:
        return targets
    rows = targets.where(~is_vendor_path(F.col("path")))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("request_id")))
    order = [F.desc_nulls_last("score"), F.col("target_id")]
    rows = rows.withColumn("of_path", F.row_number().over(Window.partitionBy("request_id", "path").orderBy(*order)))
    rows = rows.where((F.col("n") <= files) | (F.col("of_path") == 1)).drop("of_path")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("request_id").orderBy(*order)))
    return rows.where((F.col("n") <= files) | (F.col("place") <= files)).drop("n", "place")


def coherence_gate(targets: DataFrame, clusters: int, tau: float = 0.4) -> DataFrame:
    """Requests with more than two targets and a coherence below tau keep their best clusters (module prefixes; greatest score,
    then size, then name)."""
    rows = targets.withColumn("module", module_prefix(F.col("path")))
    parts = rows.groupBy("request_id", "module").agg(F.max("score").alias("best"), F.count("*").alias("size"))
    best = top_k_per(parts, ["request_id"], [F.desc_nulls_last("best"), F.desc("size"), F.col("module")], clusters).select("request_id", "module", F.lit(True).alias("in_best"))
    whole = parts.groupBy("request_id").agg(F.sum("size").alias("n"), F.count("*").alias("m"))
    coherent = (F.col("n") <= 2) | (1 - (F.col("m") - 1) / F.greatest(F.col("n") - 1, F.lit(1)) >= tau)
    rows = rows.join(whole.select("request_id", coherent.alias("coherent")), "request_id").join(best, ["request_id", "module"], "left")
    return rows.where(F.col("coherent") | F.coalesce("in_best", F.lit(False))).drop("module", "coherent", "in_best")


def focus_top_modules(targets: DataFrame, n: int = 2, beyond: int = 6) -> DataFrame:
    """Requests with more than `beyond` targets keep those of their n largest module prefixes."""
    rows = targets.withColumn("module", module_prefix(F.col("path")))
    parts = rows.groupBy("request_id", "module").agg(F.count("*").alias("size"))
    large = top_k_per(parts, ["request_id"], [F.desc("size"), F.col("module")], n).select("request_id", "module", F.lit(True).alias("large"))
    whole = parts.groupBy("request_id").agg(F.sum("size").alias("total"))
    rows = rows.join(whole, "request_id").join(large, ["request_id", "module"], "left")
    return rows.where((F.col("total") <= beyond) | F.coalesce("large", F.lit(False))).drop("module", "total", "large")


def drop_synonym_only_hits(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """Hits whose name or path holds one of the request's own terms; all hits of a request without terms."""
    rows = hits.join(requests.select("request_id", "terms"), "request_id")
    own = F.exists("terms", lambda t: F.lower("name").contains(t) | F.lower("path").contains(t))
    return rows.where((F.size("terms") == 0) | own).drop("terms")


def recency_boost(hits: DataFrame, working_set: DataFrame) -> DataFrame:
    """score times 1.2 if the path is in the working set, else 1.1 if the name is one of its names, else unchanged."""
    paths = working_set.select("path").distinct().withColumn("by_path", F.lit(1.2))
    names = working_set.select("name").distinct().withColumn("by_name", F.lit(1.1))
    rows = hits.join(paths, "path", "left").join(names, "name", "left")
    return rows.withColumn("score", F.col("score") * F.coalesce("by_path", "by_name", F.lit(1.0))).drop("by_path", "by_name")


def implementation_twins(tests: DataFrame, files: DataFrame) -> DataFrame:
    """test, path: the first of the source paths that a test file's name suggests and that exists."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"^test_|_test(?=\.)|\.test(?=\.)|_spec(?=\.)|\.spec(?=\.)", "")
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    outside = F.regexp_replace(folder, r"(^|/)(tests?|spec)(/|$)", "$1")
    beside = F.regexp_replace(folder, r"(^|/)(tests?|spec)(/|$)", "$1src$3")
    at = lambda f: F.regexp_replace(F.concat(f, F.lit("/"), stem), "^/|(?<=/)/", "")
    options = tests.select(F.col("path").alias("test"), F.posexplode(F.array_distinct(F.array(at(beside), at(outside), at(folder), F.concat(F.lit("src/"), stem), F.concat(F.lit("lib/"), stem), stem))).alias("place", "path"))
    found = options.where("path <> test").join(files.select("path").distinct(), "path", "left_semi")
    return found.groupBy("test").agg(F.min_by("path", "place").alias("path"))


def histories_for_targets(targets: DataFrame, history: DataFrame, files: int = 5, commits: int = 5) -> DataFrame:
    """request_id, path, commit_id: the newest commits of a request's first distinct paths."""
    paths = targets.groupBy("request_id", "path").agg(F.max("score").alias("score"))
    paths = top_k_per(paths, ["request_id"], [F.desc_nulls_last("score"), F.col("path")], files)
    newest = top_k_per(history, ["path"], [F.desc("epoch"), F.desc("commit_id")], commits)
    return paths.select("request_id", "path").join(newest.select("path", "commit_id"), "path").select("request_id", "path", "commit_id")
