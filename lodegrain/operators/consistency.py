"""Checks of declared against actual artefacts, and maintenance summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topk import top_k_per


def workspace_drift(declared: DataFrame, actual: DataFrame, key: str = "name") -> DataFrame:
    """name, severity: declared but missing is an error, present but undeclared a warning."""
    missing = declared.select(key).distinct().join(actual, key, "left_anti").withColumn("severity", F.lit("error"))
    extra = actual.select(key).distinct().join(declared, key, "left_anti").withColumn("severity", F.lit("warning"))
    return missing.unionByName(extra)


def unmentioned_names(names: DataFrame, docs: DataFrame) -> DataFrame:
    """Names that no document mentions, as they are or with _ for -, whatever the case. The documents' words are the table
    that is joined, so a name is an equi-join and not a search of every text."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_-]+"), F.lit(0))).alias("word")).distinct()
    both = names.select("name", F.explode(F.array_distinct(F.array(F.lower("name"), F.replace(F.lower("name"), F.lit("-"), F.lit("_"))))).alias("word"))
    return names.join(both.join(words, "word", "left_semi").select("name"), "name", "left_anti")


def broken_links(docs: DataFrame, files: DataFrame, key: str = "page_id", text: str = "text", pattern: str = r"\]\(([^)]*)\)") -> DataFrame:
    """key, target of links that are no file; http links and anchors are skipped."""
    links = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("target"))
    links = links.where(~F.col("target").startswith("http") & ~F.col("target").startswith("#"))
    return links.join(files.select(F.col("path").alias("target")), "target", "left_anti").select(key, "target")


def missing_attributes(manifests: DataFrame, attribute: str = "description") -> DataFrame:
    """Packages whose manifest has no line that sets the attribute."""
    return manifests.where(~F.col("content").rlike(rf"(?m)^\s*{attribute}.*=")).select("name")


def unused_dependencies(deps: DataFrame, files: DataFrame) -> DataFrame:
    """Declared names (- as _) that no file uses as `use x`, `x::` or `extern crate x`."""
    used = F.regexp_extract_all("content", F.lit(r"(?:use\s+|extern\s+crate\s+)([A-Za-z0-9_]+)|([A-Za-z0-9_]+)::"), F.lit(0))
    names = files.select(F.explode(used).alias("u")).select(F.regexp_replace("u", r"^(use|extern\s+crate)\s+|::$", "").alias("used")).distinct()
    return deps.join(names, F.replace("name", F.lit("-"), F.lit("_")) == F.col("used"), "left_anti")


def verify_paths(rows: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """rows with `exists`."""
    known = files.select(F.col("path").alias("known")).distinct()
    return rows.join(known, rows[path] == known["known"], "left").withColumn("exists", F.col("known").isNotNull()).drop("known")


def drop_stale_targets(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select("path"), "path", "left_semi")


def file_skeleton(symbols: DataFrame, path_prefix: str) -> DataFrame:
    """path, symbols: names of the files under a prefix, in file order, without bodies."""
    rows = symbols.where(F.col("path").startswith(path_prefix)).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ordinal", "name"))).alias("s"))
    return rows.select("path", F.transform("s", lambda s: s["name"]).alias("symbols"))


def lookup_symbol(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Symbols of the wanted names, whatever the case: query, and the symbol's columns."""
    wanted = names.select(F.col("name").alias("query")).distinct()
    return symbols.join(wanted, F.lower("name") == F.lower("query"))


def lookup_summary(hits: DataFrame, cap: int = 20, files: int = 5) -> DataFrame:
    """query, total, kinds (kind=count, sorted), top_files of names with more than cap hits."""
    total = hits.groupBy("query").agg(F.count("*").alias("total")).where(F.col("total") > cap)
    kinds = hits.groupBy("query", "kind").count().groupBy("query").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "kind", F.col("count").cast("string")))), ",").alias("kinds"))
    paths = top_k_per(hits.groupBy("query", "path").count(), ["query"], [F.desc("count"), F.col("path")], files, "place")
    paths = paths.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "path"))).alias("s")).select("query", F.array_join(F.transform("s", lambda s: s["path"]), ",").alias("top_files"))
    return total.join(kinds, "query").join(paths, "query")


def exclude_noise_kinds(hits: DataFrame) -> DataFrame:
    return hits.where(~F.col("kind").isin("Import", "Variable"))


def filter_diagnostics(diagnostics: DataFrame, min_severity: str = "warning", file: str | None = None) -> DataFrame:
    """Rows of the level and above; compiler-internal and absolute paths are left out; `file` is a path or its end."""
    levels = {"error": ["error"], "warning": ["error", "warning"]}.get(min_severity)
    rows = diagnostics.where(~F.col("path").startswith("/") & ~F.col("path").startswith("<"))
    rows = rows if levels is None else rows.where(F.col("level").isin(levels))
    return rows if file is None else rows.where((F.col("path") == file) | F.col("path").endswith(file) | F.lit(file).endswith(F.col("path")))


def lint_issues(diagnostics: DataFrame) -> DataFrame:
    """Warnings and errors with a code, the first of each (code, path, line)."""
    rows = diagnostics.where(F.col("level").isin("warning", "error") & F.col("code").isNotNull())
    return top_k_per(rows, ["code", "path", "line"], [F.col("diagnostic_id")], 1)


def classify_string(s: Column) -> Column:
    """The first class whose rule holds: url, path, sql, env, version, log, error, format, package, else general."""
    low = F.lower(s)
    return (
        F.when(s.rlike("^(https?|ftp|wss?)://"), "url").when(s.rlike(r"^(/|\./|\.\./|.:\\)"), "path")
        .when(low.rlike("^(select |insert |update |delete |create table|alter table|drop )"), "sql").when(s.rlike(r"^\$[A-Za-z0-9_]+$|^%.+%$"), "env")
        .when(s.rlike(r"^v?[0-9]+\.[0-9]{1,3}[^.]*(\.[^.]*){0,2}$"), "version").when(low.rlike("^(debug|info|warn|error|trace):"), "log")
        .when(low.rlike("error|failed|panic|fatal|abort|segfault|exception|invalid|cannot|unable to|unexpected"), "error")
        .when(s.rlike(r"%[sdfx]|\{\}|\{:#?\?\}"), "format").when(s.rlike("^[a-z0-9-]*-[a-z0-9-]*$") & (F.length(s) <= 64), "package").otherwise("general")
    )


def minify_text(text: Column) -> Column:
    """Line ends trimmed and runs of blank lines made one."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n")


#: What statements that log begin with: macros with their paths, objects with their methods, a function.
LOG_MACROS = ("debug", "info", "warn", "error", "trace", "println", "eprintln", "dbg")
LOG_PATHS, PATH_MACROS = ("tracing::", "log::"), ("debug", "info", "warn", "error", "trace")
LOGGERS, LOGGER_METHODS = ("logger", "logging", "log"), ("debug", "info", "warning", "error", "critical", "exception")
CONSOLE_METHODS = ("log", "error", "warn", "debug", "info", "trace")
LOG_STATEMENT = (rf"\s*((?:{'|'.join(LOG_MACROS)})!|(?:{'|'.join(LOG_PATHS)})(?:{'|'.join(PATH_MACROS)})!|(?:{'|'.join(LOGGERS)})\.(?:{'|'.join(LOGGER_METHODS)})"
                 rf"|print|console\.(?:{'|'.join(CONSOLE_METHODS)}))\(")


def prune_log_lines(text: Column, comment: str = "//", most: int = 200) -> Column:
    """Logging statements, up to the line that closes their parentheses, become one mark per run of them, indented as the first; other
    lines longer than `most` characters are cut. An open statement takes the rest of the text. Texts with a statement are folded
    line by line, others are not."""
    lines = F.split(text, r"\r?\n")
    cut = lambda s: F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s)
    opened = lambda s: F.length(F.regexp_replace(s, r"[^(]", "")) - F.length(F.regexp_replace(s, r"[^)]", ""))

    def step(done: Column, s: Column) -> Column:
        inside = done["depth"] > 0
        log = inside | s.rlike("^" + LOG_STATEMENT)
        depth = F.when(log, F.greatest(F.when(inside, done["depth"]).otherwise(0) + opened(s), F.lit(0))).otherwise(0)
        mark = F.concat(F.regexp_extract(s, r"^\s*", 0), F.lit(f"{comment} ..."))
        line = F.when(~log, F.array(cut(s))).when(done["log"], F.array().cast("array<string>")).otherwise(F.array(mark))
        return F.struct(F.concat(done["out"], line).alias("out"), depth.alias("depth"), log.alias("log"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("depth"), F.lit(False).alias("log"))
    folded = F.aggregate(lines, start, step)["out"]
    return F.array_join(F.when(text.rlike("(?m)^" + LOG_STATEMENT), folded).otherwise(F.transform(lines, cut)), "\n")


def maintenance_summary(issues: DataFrame, unused: DataFrame, proposals: DataFrame) -> DataFrame:
    """One row: issues, fixable (with a suggestion), unused (dependencies) and proposals."""
    one = lambda df, *c: F.broadcast(df.agg(*c))  # noqa: E731  a row each
    rows = issues.agg(F.count("*").alias("issues"), F.count("suggestion").alias("fixable"))
    return rows.join(one(unused, F.count("*").alias("unused")), F.lit(True)).join(one(proposals, F.count("*").alias("proposals")), F.lit(True))


def work_markers(files: DataFrame) -> DataFrame:
    """path, line, marker: TODO, FIXME, HACK or XXX of a line, the first in that order."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "s"))
    marker = F.coalesce(*[F.when(F.col("s").contains(m), m) for m in ("TODO", "FIXME", "HACK", "XXX")])
    return lines.select("path", (F.col("at") + 1).alias("line"), marker.alias("marker")).where("marker is not null")


def printable_runs(binaries: DataFrame, least: int = 6) -> DataFrame:
    """path, offset, value of ASCII runs in binaries (path, content)."""
    from .security import matches_with_offsets

    text = F.decode("content", "ISO-8859-1")
    runs = binaries.select("path", F.explode(matches_with_offsets(text, r"[\x20-\x7E]{%d,}" % least)).alias("r"))
    return runs.select("path", F.col("r.start").alias("offset"), F.col("r.match").alias("value"))


def query_complexity(text: Column, code_refs: Column) -> Column:
    words = F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))
    marks = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    return F.when((words <= 4) & (marks <= 1) & ~code_refs, "quick").when((words >= 30) | (marks > 1) | ((words > 15) & code_refs), "deep").otherwise("standard")


def rank_targets(targets: DataFrame, keys: list[str], max_symbols: int | None = 5) -> DataFrame:
    """Score descending (null last), source before test before vendor; each (name, path) once."""
    from ..functions.paths import source_class

    rows = targets.withColumn("class", source_class(F.col("path")))
    rows = top_k_per(rows, [*keys, "name", "path"], [F.desc_nulls_last("score"), F.col("class")], 1)
    return top_k_per(rows, keys, [F.desc_nulls_last("score"), F.col("class"), F.col("name"), F.col("path")], max_symbols, "rank")
