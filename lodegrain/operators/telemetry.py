"""Span metrics, decayed counters, session counters and pipeline statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .topk import last_n, numbered, top_k_per


def load_spans(raw: DataFrame) -> DataFrame:
    """Flatten resource, scope and span nesting of rows (resource_spans: array of (attributes, scope_spans: array of (spans:
    array of (trace_id, span_id, name, start_ns, end_ns, attributes)))): service, trace_id and span_id in hex, operation,
    duration_ms (0 if negative), file_path, line_number. attributes are arrays of (key, value)."""
    rows = raw.select(F.explode("resource_spans").alias("r"))
    rows = rows.select(_attribute("r.attributes", "service.name").alias("service"), F.explode("r.scope_spans").alias("s")).select("service", F.explode("s.spans").alias("p"))
    took = (F.col("p.end_ns") - F.col("p.start_ns")) / 1e6
    return rows.select(
        "service", F.lower(F.hex("p.trace_id")).alias("trace_id"), F.lower(F.hex("p.span_id")).alias("span_id"), F.col("p.name").alias("operation"),
        F.greatest(took, F.lit(0.0)).alias("duration_ms"), F.coalesce(_attribute("p.attributes", "code.file.path"), _attribute("p.attributes", "code.filepath")).alias("file_path"),
        F.coalesce(_attribute("p.attributes", "code.line.number"), _attribute("p.attributes", "code.lineno")).cast("int").alias("line_number"))


def _attribute(attributes: str, key: str):
    return F.get(F.filter(attributes, lambda a: a["key"] == key), F.lit(0))["value"]


def attribute_spans(spans: DataFrame, symbols: DataFrame, bucket: int = 64) -> DataFrame:
    """Add symbol to spans (span_id, path, line): the first in file order whose lines hold the span's. Both sides meet on
    (path, line bucket), so a file with many symbols is spread and no row meets a whole file."""
    parts = symbols.withColumn("bucket", F.explode(F.sequence(F.expr(f"line_start div {bucket}"), F.expr(f"line_end div {bucket}"))))
    parts = parts.select(F.col("path").alias("p"), "bucket", "name", "ordinal", "line_start", "line_end")
    rows = spans.withColumn("b", F.expr(f"line div {bucket}"))
    hit = (rows["path"] == parts["p"]) & (F.col("b") == F.col("bucket")) & F.col("line").between(F.col("line_start"), F.col("line_end"))
    best = rows.join(parts, hit).groupBy("span_id").agg(F.min_by("name", "ordinal").alias("symbol"))
    return spans.join(best, "span_id", "left")


def span_metrics(spans: DataFrame, last: int | None = None, key: str = "location") -> DataFrame:
    """location, n, total_ms, avg_ms, max_ms, last_seen, p95_ms (the element at ceil(0.95 (n - 1))), over the newest `last`
    spans of each location, or all."""
    rows = spans if last is None else last_n(spans, [key], ["ts", "span_id"], last)
    place = F.row_number().over(Window.partitionBy(key).orderBy("duration_ms", "span_id")) - 1
    n = F.count("*").over(Window.partitionBy(key))
    rows = rows.withColumn("at", place == F.ceil(F.lit(0.95) * (n - 1)))
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"),
                                 F.max("ts").alias("last_seen"), F.max(F.when(F.col("at"), F.col("duration_ms"))).alias("p95_ms"))


def hotspots(metrics: DataFrame, k: int = 10, hot_ms: float = 200, warm_ms: float = 50, key: str = "location") -> DataFrame:
    heat = F.when(F.col("avg_ms") > hot_ms, "hot").when(F.col("avg_ms") >= warm_ms, "warm").otherwise("cool")
    return metrics.orderBy(F.desc("avg_ms"), key).limit(k).withColumn("heat", heat)


def span_store_stats(spans: DataFrame, capacity: int = 1000, key: str = "location") -> DataFrame:
    return spans.agg(F.count("*").alias("spans"), F.countDistinct(key).alias("locations"), F.least(F.count("*") / F.lit(capacity), F.lit(1.0)).alias("fill"))


def decayed_scores(activity: DataFrame, as_of: int, half_life_s: float = 480, counter: str = "kind", value: str = "subject", max_events: int | None = None) -> DataFrame:
    """counter, value, score (events weigh half per half-life), n; over the newest max_events of each counter, or all."""
    rows = activity if max_events is None else last_n(activity, [counter], ["epoch", "event_id"], max_events)
    weight = F.exp(F.lit(-math.log(2) / half_life_s) * F.greatest(F.lit(as_of) - F.col("epoch"), F.lit(0)))
    return rows.groupBy(counter, value).agg(F.sum(weight).alias("score"), F.count("*").alias("n"))


def decayed_top(activity: DataFrame, as_of: int, k: int = 10, counter: str = "kind", value: str = "subject", **how) -> DataFrame:
    return top_k_per(decayed_scores(activity, as_of, counter=counter, value=value, **how), [counter], [F.desc("score"), F.col(value)], k, "rank")


def activity_snapshot(activity: DataFrame, as_of: int, counter: str = "kind", value: str = "subject", **how) -> DataFrame:
    """counter, events, distinct_values, total_score."""
    return decayed_scores(activity, as_of, counter=counter, value=value, **how).groupBy(counter).agg(
        F.sum("n").alias("events"), F.count("*").alias("distinct_values"), F.sum("score").alias("total_score"))


def event_counters(activity: DataFrame) -> DataFrame:
    """session, events and how many of each kind."""
    kinds = {"searches": "search_query", "symbols": "symbol_resolved", "changes": "file_change", "diagnostics": "diagnostic", "tool_calls": "tool_call"}
    return activity.groupBy("session").agg(F.count("*").alias("events"), *[F.count_if(F.col("kind") == k).alias(n) for n, k in kinds.items()])


def pipeline_stage_stats(runs: DataFrame, stages: list[str], last: int | None = None) -> DataFrame:
    """One row: runs, the mean of each stage, min, mean, max and p95 (element at ceil(0.95 n) - 1) of the total, the stage
    with the greatest mean and its share. runs have run_id and a column per stage."""
    rows = runs if last is None else runs.orderBy(F.desc("run_id")).limit(last)
    total = sum((F.col(s) for s in stages[1:]), F.col(stages[0]))
    row = rows.withColumn("total", total).agg(
        F.count("*").alias("runs"), *[F.avg(s).alias(f"avg_{s}") for s in stages], F.min("total").alias("min_total"), F.avg("total").alias("avg_total"),
        F.max("total").alias("max_total"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY total)").alias("p95_total"))
    worst = F.array_max(F.array(*[F.struct(F.col(f"avg_{s}").alias("ms"), F.lit(s).alias("stage")) for s in stages]))
    return row.withColumn("bottleneck", worst["stage"]).withColumn("share", worst["ms"] / F.col("avg_total"))


def diagnostic_counts(diagnostics: DataFrame) -> DataFrame:
    """check_id, errors, warnings, trend: the sign of the change of both together since the check before."""
    rows = diagnostics.groupBy("check_id").agg(F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    rows = numbered(rows, "check_id", "__n")
    before = rows.select((F.col("__n") + 1).alias("__n"), (F.col("errors") + F.col("warnings")).alias("__before"))
    trend = F.signum(F.col("errors") + F.col("warnings") - F.col("__before"))
    return rows.join(before, "__n", "left").select("check_id", "errors", "warnings", F.coalesce(trend, F.lit(0.0)).cast("int").alias("trend"))
