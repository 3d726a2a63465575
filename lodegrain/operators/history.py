"""Commit history: hotspots, risk, authors, co-changes, fix chains and summaries, for many files in one job.

Inputs: commits (commit_id, author, epoch, message) and commit_files (commit_id, path). Times are seconds; the clock is
the parameter `as_of`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import commit_scope, commit_tags
from ..sources.snapshots import saved
from .topk import top_k_per


def touches(commit_files: DataFrame, commits: DataFrame) -> DataFrame:
    """A row per file and commit that changed it, with the commit's tags."""
    return commit_files.join(commits.withColumn("tags", commit_tags(F.col("message"))), "commit_id")


def file_hotspots(touched: DataFrame, as_of: int, lam: float = 0.05) -> DataFrame:
    """path, commits, hotspot: how often a file changes over its span of days, decayed since its newest commit."""
    rows = touched.groupBy("path").agg(F.count("*").alias("commits"), F.min("epoch").alias("oldest"), F.max("epoch").alias("newest"))
    span = F.greatest((F.col("newest") - F.col("oldest")) / 86400.0, F.lit(1.0))
    rate = F.least(F.lit(100.0), F.lit(600.0) * F.col("commits") / span)
    decayed = rate * F.exp(-F.lit(lam) * (F.lit(as_of) - F.col("newest")) / 86400.0)
    return rows.select("path", "commits", F.when(F.col("commits") <= 1, F.col("commits").cast("double")).otherwise(decayed).alias("hotspot"))


def top_authors(touched: DataFrame, k: int = 5) -> DataFrame:
    """path, author, commits, rank: the k authors with most commits of each file."""
    counted = touched.groupBy("path", "author").agg(F.count("*").alias("commits"))
    return top_k_per(counted, ["path"], [F.desc("commits"), F.col("author")], k, "rank")


def tag_counts(touched: DataFrame) -> DataFrame:
    tags = ("fix", "revert", "refactor", "feature", "security", "performance")
    return touched.groupBy("path").agg(*[F.count_if(F.array_contains("tags", t)).alias(t) for t in tags])


def risk_indicator(hotspots: DataFrame, tags: DataFrame) -> DataFrame:
    """path, risk: HIGH, MEDIUM or LOW from tag counts and hotspot score."""
    rows = hotspots.join(tags, "path")
    risk = (
        F.when((F.col("security") > 0) | (F.col("revert") > 2), "HIGH")
        .when((F.col("fix") > 0) & (F.col("fix") > F.floor(F.col("commits") / 2)), "MEDIUM")
        .when(F.col("hotspot") > 50, "MEDIUM")
        .otherwise("LOW")
    )
    return rows.select("path", risk.alias("risk"))


def last_fix_commit(touched: DataFrame) -> DataFrame:
    """path, commit_id of its newest fix, ties to the greatest id."""
    fixes = touched.where(F.array_contains("tags", "fix"))
    return fixes.groupBy("path").agg(F.max_by("commit_id", F.struct("epoch", "commit_id")).alias("commit_id"))


def fix_chains(touched: DataFrame, window_s: int = 48 * 3600) -> DataFrame:
    """path, chains: runs of neighbouring fix commits less than `window_s` apart, counted per run and not per pair."""
    order = Window.partitionBy("path").orderBy("epoch", "commit_id")
    fix = F.array_contains("tags", "fix")
    rows = touched.select("path", "epoch", "commit_id", fix.alias("fix"))
    pair = F.col("fix") & F.lag("fix").over(order) & (F.col("epoch") - F.lag("epoch").over(order) < window_s)
    rows = rows.withColumn("pair", F.coalesce(pair, F.lit(False)))
    start = F.col("pair") & ~F.coalesce(F.lag("pair").over(order), F.lit(False))
    return rows.withColumn("start", start).groupBy("path").agg(F.count_if("start").alias("chains"))


def stability(touched: DataFrame) -> DataFrame:
    """path, convergence, rigidity from the number of fix chains."""
    counted = touched.groupBy("path").agg(F.count("*").alias("n"))
    rows = counted.join(fix_chains(touched), "path")
    share = F.col("chains") / F.col("n")
    return rows.select("path", F.when(F.col("n") <= 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - share)).alias("convergence"), share.alias("rigidity"))


#: Fixed value: pairs that a task of co_changes makes and counts, but for those of one commit.
MOST_PAIRS = 1 << 21


def co_changes(commit_files: DataFrame, min_count: int = 2, top: int | None = 10, max_files_per_commit: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """path, other, together, ratio (of the file's commits), rank, of all files or of `targets` (path), of which only the commits are
    paired. Files of fewer than min_count commits can be in no result and pair with nothing. A commit of n files that are left gives
    n * n pairs: where wide commits exist, `max_files_per_commit` leaves them out of the pairs (and of nothing else).

    Of all files, a pair is made once and turned round when it is counted. A task counts the pairs that it makes, so commits are dealt out by
    the number of their pairs and not by their bytes, which are few."""
    often = commit_files.groupBy("path").agg(F.count("*").alias("total")).where(F.col("total") >= min_count)
    pairs = commit_files.join(often, "path", "left_semi")
    if max_files_per_commit is not None:
        narrow = commit_files.groupBy("commit_id").count().where(F.col("count") <= max_files_per_commit)
        pairs = pairs.join(narrow, "commit_id", "left_semi")
    if targets is None:
        pairs = saved(pairs.select("commit_id", "path"), "changed_often")
        made = pairs.groupBy("commit_id").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0
        # a number that is stated is not lessened where the bytes are few
        dealt = pairs.repartition(int(made // MOST_PAIRS) + 1, "commit_id") if made > MOST_PAIRS else pairs
        both = dealt.hint("merge").join(dealt.withColumnRenamed("path", "other"), "commit_id").where("path < other")
    else:
        own = pairs.join(targets.select("path").distinct(), "path", "left_semi")
        both = own.join(pairs.withColumnRenamed("path", "other"), "commit_id").where("path <> other")
    counted = both.groupBy("path", "other").agg(F.count("*").alias("together")).where(F.col("together") >= min_count)
    if targets is None:
        turned = F.array(F.struct("path", "other"), F.struct(F.col("other").alias("path"), F.col("path").alias("other")))
        counted = counted.select("together", F.inline(turned))
    rows = counted.join(often, "path").select("path", "other", "together", (F.col("together") / F.col("total")).alias("ratio"))
    return top_k_per(rows, ["path"], [F.desc("together"), F.col("other")], top, "rank")


def scope_to_lines(commits_of_file: DataFrame, blame: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """Commits (path, commit_id, ...) blamed in lines start..end (by default 50 on); a file without such blame keeps all."""
    end = start + 50 if end is None else end
    hit = blame.where((F.col("line_start") <= end) & (F.col("line_start") + F.col("n_lines") > start)).select("path", "commit_id").distinct()
    some = hit.select("path").distinct()
    return commits_of_file.join(hit, ["path", "commit_id"], "left_semi").unionByName(commits_of_file.join(some, "path", "left_anti"))


def commit_intent_summary(touched: DataFrame, limit: int | None = None) -> DataFrame:
    """path, tag, commits, scopes (up to 3, sorted), span: over the newest `limit` commits of each file."""
    rows = top_k_per(touched, ["path"], [F.desc("epoch"), F.desc("commit_id")], limit)
    days = F.floor((F.max("epoch") - F.min("epoch")) / 86400)
    spans = rows.groupBy("path").agg(days.alias("days"))
    label = (
        F.when(F.col("days") == 0, "today").when(F.col("days") == 1, "1 day").when(F.col("days") < 14, F.concat_ws(" ", F.col("days").cast("string"), F.lit("days")))
        .when(F.col("days") < 60, F.concat_ws(" ", F.floor(F.col("days") / 7).cast("string"), F.lit("weeks")))
        .otherwise(F.concat_ws(" ", F.floor(F.col("days") / 30).cast("string"), F.lit("months")))
    )
    tagged = rows.withColumn("scope", commit_scope(F.col("message"))).select("path", F.explode("tags").alias("tag"), "scope")
    counted = tagged.groupBy("path", "tag").agg(F.count("*").alias("commits"), F.array_join(F.slice(F.array_sort(F.collect_set("scope")), 1, 3), ",").alias("scopes"))
    return counted.join(spans.select("path", label.alias("span")), "path")


def repo_summary(commits: DataFrame) -> DataFrame:
    """One row: head (newest commit), commits, authors, first and last epoch."""
    return commits.agg(F.max_by("commit_id", F.struct("epoch", "commit_id")).alias("head"), F.count("*").alias("commits"),
                       F.countDistinct("author").alias("authors"), F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"))


def riskiest_files(commit_files: DataFrame, commits: DataFrame, as_of: int, k: int = 20) -> DataFrame:
    """The k files of greatest hotspot with their risk, fix chains and strongest co-changed file."""
    touched = touches(commit_files, commits)
    spots = file_hotspots(touched, as_of)
    rows = spots.join(risk_indicator(spots, tag_counts(touched)), "path").join(fix_chains(touched), "path")
    # the k first, for their commits alone are paired
    best = saved(rows.orderBy(F.desc("hotspot"), "path").limit(k), "riskiest")
    partner = co_changes(commit_files, top=1, targets=best).select("path", F.col("other").alias("partner"))
    return best.join(partner, "path", "left")
