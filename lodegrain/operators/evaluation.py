"""Scoring of retrieval and answers against ground truth, run comparisons and statistics."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.snapshots import saved
from .topk import average_ranks


def score_answers(answers: DataFrame) -> DataFrame:
    """id, found, wrong, precision, recall, f1: facts are sought in the response without regard to case; cited counts that
    do not exist are `wrong`. answers have id, response, facts and wrong."""
    response = F.lower("response")
    found = F.size(F.filter("facts", lambda f: response.contains(F.lower(f))))
    rows = answers.select("id", found.alias("found"), "wrong", F.size("facts").alias("total"))
    p = F.when(F.col("found") + F.col("wrong") > 0, F.col("found") / (F.col("found") + F.col("wrong"))).otherwise(0.0)
    r = F.when(F.col("total") > 0, F.col("found") / F.col("total")).otherwise(1.0)
    rows = rows.withColumn("precision", p).withColumn("recall", r)
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)).drop("total")


def benchmark_aggregate(scores: DataFrame) -> DataFrame:
    """One row over rows (f1, latency_ms, wrong): means, perfect and zero counts, latency figures, wrong citations a question
    and the share of questions with any."""
    return scores.agg(
        F.count("*").alias("questions"), F.avg("f1").alias("mean_f1"), F.count_if(F.col("f1") >= 1).alias("perfect"), F.count_if(F.col("f1") == 0).alias("zero"),
        F.avg("latency_ms").alias("mean_latency"), F.max("latency_ms").alias("max_latency"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)").alias("p95_latency"),
        (F.sum("wrong") / F.count("*")).alias("hallucination_rate"), (F.count_if(F.col("wrong") > 0) / F.count("*")).alias("hallucinated_share"))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: Pearson's r, 0 with fewer than two rows or without variance."""
    return df.agg(F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0)).alias("r"))


def compression_ratio(facts: Column, tokens: Column) -> Column:
    return F.when(tokens > 0, facts / tokens * 1000).otherwise(0.0)


def information_density(symbols: Column, text: Column) -> Column:
    return symbols / (F.greatest(F.length(text) / 4, F.lit(1.0)) / 1000)


def retrieval_metrics(hits: DataFrame, judgments: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """query_id, mrr, p_at_k (divides by k), r_at_k: hits (query_id, key, rank) against judged-relevant (query_id, key); a
    query without judgments scores 1, one without hits 0."""
    good = hits.where(F.col("rank") <= k).join(judgments, ["query_id", key]).groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"))
    wanted = judgments.groupBy("query_id").agg(F.count("*").alias("relevant"))
    every = hits.select("query_id").union(judgments.select("query_id")).distinct()
    rows = every.join(wanted, "query_id", "left").join(good, "query_id", "left")
    none = F.col("relevant").isNull()
    score = lambda c: F.when(none, 1.0).otherwise(F.coalesce(c, F.lit(0.0)))
    return rows.select("query_id", score(1 / F.col("first")).alias("mrr"), score(F.col("found") / F.lit(k)).alias("p_at_k"), score(F.col("found") / F.col("relevant")).alias("r_at_k"))


def file_hit_at_k(hits: DataFrame, files: DataFrame, k: int) -> DataFrame:
    """query_id, file_hit: the share of a query's judged files (query_id, path) that the path of one of its first k hits
    (query_id, path, rank) holds; 1 without judged files, 0 without hits. Repeated rows count once."""
    wanted = files.select("query_id", F.col("path").alias("wanted")).where("wanted IS NOT NULL").distinct()
    near = hits.where(F.col("rank") <= k).select("query_id", "path").distinct()
    # at most k paths a query meet its files
    found = wanted.join(near, "query_id").where(F.col("path").contains(F.col("wanted"))).select("query_id", "wanted").distinct().withColumn("found", F.lit(1))
    share = wanted.join(found, ["query_id", "wanted"], "left").groupBy("query_id").agg((F.count("found") / F.count("*")).alias("share"))
    return hits.select("query_id").union(files.select("query_id")).distinct().join(share, "query_id", "left").select("query_id", F.coalesce("share", F.lit(1.0)).alias("file_hit"))


def cited_paths(response: Column, roots: tuple[str, ...] = ("src", "crates", "lib", "bin", "docs", "tests", "tools", "examples")) -> Column:
    """Path-like tokens under one of the roots, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(response, F.lit(f"(?:{'|'.join(roots)})/[A-Za-z0-9_/.-]+\\.[A-Za-z0-9_]+"), F.lit(0)))


def citation_precision(responses: DataFrame, files: DataFrame) -> DataFrame:
    """id, cited, existing, precision (null without citations)."""
    cited = responses.select("id", F.explode(cited_paths(F.col("response"))).alias("path"))
    known = cited.join(files.select("path").distinct().withColumn("known", F.lit(1)), "path", "left")
    counted = known.groupBy("id").agg(F.count("*").alias("cited"), F.count("known").alias("existing"))
    return responses.select("id").join(counted, "id", "left").fillna(0, ["cited", "existing"]).withColumn("precision", F.when(F.col("cited") > 0, F.col("existing") / F.col("cited")))


def hallucination_count(responses: DataFrame, files: DataFrame, forbidden: list[str]) -> DataFrame:
    """id, hallucinations: forbidden words that stand in the response as words of their own, and cited paths that no file has."""
    words = sum((F.col("response").rlike(rf"(?i)\b{re.escape(w)}\b").cast("long") for w in forbidden), F.lit(0).cast("long"))
    cited = citation_precision(responses, files).select("id", (F.col("cited") - F.col("existing")).alias("missing"))
    return responses.select("id", words.alias("words")).join(cited, "id").select("id", (F.col("words") + F.col("missing")).alias("hallucinations"))


def grounding_quality(scores: DataFrame) -> DataFrame:
    """One row of rows (coverage, precision, hallucinations): means (precision's over the responses with citations), sum, and
    their harmonic mean `quality`, which is the coverage where precision is undefined or both are 0."""
    row = scores.agg(F.avg("coverage").alias("coverage"), F.avg("precision").alias("precision"), F.count("precision").alias("with_citations"), F.sum("hallucinations").alias("hallucinations"))
    total = F.col("precision") + F.col("coverage")
    return row.withColumn("quality", F.when(total > 0, 2 * F.col("precision") * F.col("coverage") / total).otherwise(F.col("coverage")))


def code_quality_flag(response: Column, pattern: str | None = None) -> Column:
    """0 without a mark of code, 0.5 if the pattern is missed, else 1."""
    code = response.contains("```") | response.contains("fn ") | response.contains("def ")
    missed = F.lit(False) if pattern is None else ~response.rlike(pattern)
    return F.when(~code, 0.0).when(missed, 0.5).otherwise(1.0)


def coverage_scores(responses: DataFrame, truth: DataFrame) -> DataFrame:
    """id, keyword_recall, file_recall, symbol_recall, coverage: truth is (id, kind, value), kind keyword, file or symbol. Keywords
    of 6 characters and fewer (in any case) and symbols (as written) must stand as words of their own; a file counts if the
    response holds its path or the end of it from any folder on, hence at least its last part. A kind that is not asked for
    has a recall of 1; the weights are 0.4, 0.3 and 0.3."""
    rows = responses.join(truth, "id")
    word = lambda flags: F.expr(rf"regexp_like(response, concat('{flags}\\b\\Q', value, '\\E\\b'))")
    hit = (F.when(F.col("kind") == "file", F.col("response").contains(F.substring_index("value", "/", -1))).when(F.col("kind") == "symbol", word(""))
           .when(F.length("value") <= 6, word("(?i)")).otherwise(F.lower("response").contains(F.lower("value"))))
    rows = rows.withColumn("hit", hit.cast("double"))
    share = lambda kind: F.coalesce(F.avg(F.when(F.col("kind") == kind, F.col("hit"))), F.lit(1.0))
    rows = rows.groupBy("id").agg(*[share(kind).alias(f"{kind}_recall") for kind in ("keyword", "file", "symbol")])
    return rows.withColumn("coverage", 0.4 * F.col("keyword_recall") + 0.3 * F.col("file_recall") + 0.3 * F.col("symbol_recall"))


def value_bins(df: DataFrame, column: str, most_bins: int) -> DataFrame:
    """bin, n, total of the numbers in a column, saved: a row per distinct value, or, of more than most_bins values, per value with as
    many leading bits of its mantissa as leave no more bins. Counts and totals add up, so the table is the same whatever the
    partitioning, and its size does not grow with the rows."""
    x = df.where(~F.isnan(column) & F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    rows = saved(x.groupBy("x").agg(F.count("*").alias("n")), "values")
    bits, places = 52, rows.count()
    while places > most_bins and bits > 0:
        bits = max(0, min(bits - 1, bits - int(math.log2(places / most_bins))) if bits < 52 else 16)
        power = F.pow(F.lit(2.0), F.floor(F.log2(F.abs("x"))))
        step = power / (1 << bits)
        binned = rows.select(F.when(F.col("x") == 0, 0.0).otherwise(F.floor(F.col("x") / step) * step).alias("bin"), "x", "n")
        found = saved(binned.groupBy("bin").agg(F.sum("n").alias("n"), F.sum(F.col("x") * F.col("n")).alias("total")), "bins")
        places = found.count()
    return found if bits < 52 else rows.select(F.col("x").alias("bin"), "n", (F.col("x") * F.col("n")).alias("total"))


def bootstrap_ci(df: DataFrame, column: str, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 42, statistic: str = "mean", most_bins: int = 20_000,
                 block: int = 50) -> DataFrame:
    """One row: point, low, high of the mean or the median (the value at half of the weight, from below), nulls and NaN dropped.

    Rows count by value first (value_bins); a replicate gives a value that stands n times a Poisson weight of mean n, which is what n
    rows get that are weighed one by one. A block of replicates has a seed of its own and all values in order, so the interval
    does not depend on how the rows lie, and its cost not on how many there are: blocks run in parallel, on a table of most_bins
    rows at most. With more distinct values than that, a mean stays exact, and a median is the mean of its bin."""
    if statistic not in ("mean", "median"):
        raise ValueError("statistic is mean or median")
    spark = df.sparkSession
    table = value_bins(df, column, most_bins).orderBy("bin").toArrow()  # most_bins rows at most
    counts = table["n"].to_numpy().astype(float)
    values = table["total"].to_numpy() / np.maximum(counts, 1)

    def of(weights: np.ndarray) -> np.ndarray:
        """The statistic of each row of weights; not a number without weight."""
        sums = weights.sum(axis=1)
        if statistic == "mean":
            return np.divide(weights @ values, sums, out=np.full(len(sums), np.nan), where=sums > 0)
        at = (np.cumsum(weights, axis=1) * 2 < sums[:, None]).sum(axis=1)
        return np.where(sums > 0, values[np.minimum(at, len(values) - 1)], np.nan)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch["id"].to_pylist():
                weights = np.random.default_rng((seed, b)).poisson(counts, (min(block, n_boot - b * block), len(counts))).astype(float)
                found = of(weights)
                yield pa.RecordBatch.from_arrays([pa.array(found[~np.isnan(found)])], names=["x"])

    if not len(counts):
        return spark.createDataFrame([(None, None, None)], "point double, low double, high double")
    blocks = -(-n_boot // block)
    replicates = spark.range(0, blocks, 1, min(blocks, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(replicate, "x double")
    end = lambda share, name: F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY x)").alias(name)
    return replicates.agg(F.lit(float(of(counts[None, :])[0])).alias("point"), end(alpha / 2, "low"), end(1 - alpha / 2, "high"))


def cohens_d_paired(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mean over deviation of b - a; 0 below two rows, infinite without deviation and a mean above 0."""
    d = F.col(b) - F.col(a)
    row = df.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"))
    value = F.when(F.col("n") < 2, 0.0).when(F.col("sd") == 0, F.when(F.col("mean") > 0, float("inf")).otherwise(0.0)).otherwise(F.col("mean") / F.col("sd"))
    return row.select(value.alias("d"))


def wilcoxon_signed_rank(df: DataFrame, a: str, b: str, groups: list[str] | None = None) -> DataFrame:
    """Per group: w and z of the paired differences; zeros are dropped and ties share their mean rank."""
    groups = groups or []
    rows = df.select(*groups, (F.col(b) - F.col(a)).alias("d")).where("d <> 0").withColumn("size", F.abs("d"))
    ranked = average_ranks(rows, groups, "size")
    sums = ranked.groupBy(*groups).agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0)).alias("minus"))
    w, n = F.least("plus", "minus"), F.col("n")
    z = (w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return sums.select(*groups, "n", w.alias("w"), F.when(n > 0, z).alias("z"))


def compare_runs(base: DataFrame, candidate: DataFrame, threshold: float = 0.05) -> DataFrame:
    """metric, base, candidate, status of rows (metric, kind, value): quality must not fall, a rate must not rise by the
    threshold, and latency not by twice the threshold, relative to the base; a zero base is ok."""
    rows = base.withColumnRenamed("value", "base").join(candidate.select("metric", F.col("value").alias("candidate")), "metric")
    delta = F.col("candidate") - F.col("base")
    limit = F.when(F.col("kind") == "rate", F.lit(threshold)).when(F.col("kind") == "latency", 2 * threshold * F.col("base")).otherwise(threshold * F.col("base"))
    worse = F.when(F.col("kind") == "quality", -delta).otherwise(delta)
    skip = (F.col("kind") != "rate") & (F.col("base") <= 0)
    return rows.select("metric", "base", "candidate", F.when(skip, "ok").when(worse > limit, "regression").when(worse < -limit, "improved").otherwise("ok").alias("status"))


def diff_results(base: DataFrame, candidate: DataFrame, key: str, value: str) -> DataFrame:
    """key, status (matched, new, removed), delta."""
    rows = base.select(key, F.col(value).alias("b")).join(candidate.select(key, F.col(value).alias("c")), key, "full_outer")
    status = F.when(F.col("b").isNull(), "new").when(F.col("c").isNull(), "removed").otherwise("matched")
    return rows.select(key, status.alias("status"), (F.col("c") - F.col("b")).alias("delta"))


def needle_matrix(results: DataFrame, lengths: list[int]) -> DataFrame:
    """depth and, per context length, FOUND, PARTIAL or MISS."""
    state = F.when(F.col("found_codename") & F.col("found_key"), "FOUND").when(F.col("found_codename") | F.col("found_key"), "PARTIAL").otherwise("MISS")
    return results.withColumn("state", state).groupBy("depth").pivot("context_length", lengths).agg(F.min("state"))


def coherence(targets: DataFrame, keys: list[str], module: str = "module") -> DataFrame:
    """keys, coherence: 1 - (modules - 1) / (n - 1), 1 for a single target."""
    n, m = F.count("*"), F.countDistinct(module)
    return targets.groupBy(*keys).agg(F.when(n <= 1, 1.0).otherwise(1 - (m - 1) / (n - 1)).alias("coherence"))


def consistency_score(issues: Column, checks: Column) -> Column:
    return F.when(checks > 0, 1 - F.least(F.lit(1.0), issues / checks)).otherwise(1.0)


def proposal_retention(proposals: DataFrame, cap: int, keys: list[str]) -> DataFrame:
    """The proposals that stay when each key keeps `cap`: pending ones first, then the newest."""
    order = Window.partitionBy(*keys).orderBy(F.desc("pending"), F.desc("created"), "proposal_id")
    return proposals.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).drop("place")
