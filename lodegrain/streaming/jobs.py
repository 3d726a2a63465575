"""Streaming twins of the batch operators: event time, a stated lateness bound, and the same rows as the batch in the end.

Times are TIMESTAMP columns (cast TIMESTAMP_NTZ first). Each function takes and returns a streaming DataFrame unless it says
otherwise; the caller starts the query.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.activity import operational_moment
from ..operators.security import dlp_findings
from .folds import Bursts, Moments, Phases, Previous
from .replay import replayed


def stream_span_metrics(spans: DataFrame, window: str = "1 hour", late: str = "10 minutes", key: str = "location") -> DataFrame:
    """window, location, n, total_ms, max_ms, p95_ms (approximate) per tumbling window; spans later than `late` are dropped."""
    rows = spans.withWatermark("ts", late).groupBy(F.window("ts", window).alias("window"), key)
    return rows.agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"),
                    F.percentile_approx("duration_ms", F.lit(0.95), F.lit(1000)).alias("p95_ms"))


def hottest_of_batch(handle: Callable[[DataFrame, int], None], key: str = "location") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives `handle` one row per micro-batch: spans, location and duration of the longest."""

    def run(batch: DataFrame, batch_id: int) -> None:
        handle(batch.agg(F.count("*").alias("spans"), F.max_by(key, F.struct("duration_ms", "span_id")).alias(key), F.max("duration_ms").alias("duration_ms")), batch_id)

    return run


def stream_phases(activity: DataFrame, idle_s: int = 300, late: str = "10 minutes", max_files: int = 10, forget_s: int | None = 30 * 86400) -> DataFrame:
    """session, phase, module, events, duration_s, start, files, activity: the rows of journey_phases, each when its phase has ended
    by a change of module or by idle_s. activity has session, event_id, ts, kind, tool, module and subject."""
    out = "phase long, module string, events long, duration_s long, start long, files int, activity string"
    rows = activity.withWatermark("ts", late)
    return replayed(rows, ["session"], Phases(idle_s, max_files, forget_s), out, tie="event_id", body=["kind", "tool", "module", "subject"])


def stream_bursts(triggers: DataFrame, gap_s: float = 2, long_gap_s: float = 5, many: int = 3, late: str = "10 seconds") -> DataFrame:
    """key, start (epoch), n of each run of triggers (key, ts), as burst_coalesce gives them, each once its fixed deadline has passed."""
    return replayed(triggers.withWatermark("ts", late), ["key"], Bursts(gap_s, long_gap_s, many), "start double, n int")


def stream_moments(activity: DataFrame, late: str = "10 minutes", window: int = 15, repeat_s: int = 120, idle_s: int = 300, loop_window: int = 6,
                   forget_s: int | None = 30 * 86400, **thresholds) -> DataFrame:
    """session, event_id, moment, layer, mode after every event, by the rules of operational_moment on the session's newest `window`
    events. activity is as for stream_phases, with `errors`: the number of errors that a diagnostic event reports, else null."""
    out = ("event_id long, n long, avg_interval double, modules long, subjects long, variance double, repeats long, read_ratio double, errors long, trend int, "
           "phases long, looping boolean, activity string")
    body = ["event_id", "kind", "tool", "module", "subject", "errors"]
    rows = replayed(activity.withWatermark("ts", late), ["session"], Moments(window, repeat_s, idle_s, loop_window, forget_s), out, tie="event_id", body=body)
    return operational_moment(rows, keys=("session", "event_id"), **thresholds)


def _trend(row: dict, before: dict | None) -> tuple:
    total = row["errors"] + row["warnings"]
    was = total if before is None else before["errors"] + before["warnings"]
    return row["start"], row["errors"], row["warnings"], (total > was) - (total < was)


def stream_diagnostic_trend(diagnostics: DataFrame, every: str = "1 minute", late: str = "1 minute", key: str = "project") -> DataFrame:
    """key, start (epoch of the check), errors, warnings, trend of every check: the diagnostics (key, ts, level) of one window. Two
    stateful operators in a chain: the counts of a window, when it has closed, then the counts of the key's window before."""
    counts = diagnostics.withWatermark("ts", late).groupBy(key, F.window("ts", every).alias("window")).agg(
        F.count_if(F.col("level") == "error").alias("errors"), F.count_if(F.col("level") == "warning").alias("warnings"))
    rows = counts.select(key, F.window_time("window").alias("ts"), F.unix_seconds("window.start").alias("start"), "errors", "warnings")
    return replayed(rows, [key], Previous(_trend), "start long, errors long, warnings long, trend int", body=["start", "errors", "warnings"])


def stream_decayed_counters(activity: DataFrame, half_life_s: float = 480, counter: str = "kind", value: str = "subject", floor: float | None = None,
                            late: str = "10 minutes") -> DataFrame:
    """counter, value, score, n, epoch after each micro-batch: state is (score, n, last epoch), and a score of the past is
    worth exp(-rate * gap) at the newest event, which equals the batch sum as of that event.

    With a floor, rows need a time ts, and a value's state goes when the watermark shows that its score has decayed to the floor:
    what is kept is the values of the last log2(score / floor) half-lives. A value that comes again then starts from 0, less by the floor
    at most."""
    rate = math.log(2) / half_life_s

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        score, n, last = state.get if state.exists else (0.0, 0, 0)
        for frame in frames:
            epochs = frame["epoch"].to_numpy()
            newest = max(int(epochs.max()), last) if n else int(epochs.max())
            score = score * math.exp(-rate * (newest - last)) if n else 0.0
            score += float(sum(math.exp(-rate * (newest - int(e))) for e in epochs))
            n, last = n + len(epochs), newest
        state.update((score, n, last))
        if floor is not None:
            gone = 1000 * (last + max(0, math.ceil(math.log(score / floor) / rate)))
            state.setTimeoutTimestamp(max(gone, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({counter: [key[0]], value: [key[1]], "score": [score], "n": [n], "epoch": [last]})

    out = f"{counter} string, {value} string, score double, n long, epoch long"
    rows = activity if floor is None else activity.withWatermark("ts", late)
    timeout = GroupStateTimeout.NoTimeout if floor is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy(counter, value).applyInPandasWithState(update, out, "score double, n long, last long", "update", timeout)


def stream_causal_links(activity: DataFrame, window_s: int = 10, late: str = "1 minute", cause: str = "file_change", effect: str = "diagnostic") -> DataFrame:
    """session, effect_id, cause_id, latency_s: every cause at most window_s before an effect of its session (an interval join
    of two watermarked streams); the newest cause of an effect is the one of least latency."""
    causes = activity.where(F.col("kind") == cause).select(F.col("session").alias("s"), F.col("event_id").alias("cause_id"), F.col("ts").alias("cause_ts")).withWatermark("cause_ts", late)
    effects = activity.where(F.col("kind") == effect).select("session", F.col("event_id").alias("effect_id"), F.col("ts").alias("effect_ts")).withWatermark("effect_ts", late)
    near = (F.col("session") == F.col("s")) & (F.col("cause_ts") <= F.col("effect_ts")) & (F.col("cause_ts") >= F.col("effect_ts") - F.expr(f"INTERVAL {window_s} SECONDS"))
    rows = effects.join(causes, near)
    return rows.select("session", "effect_id", "cause_id", (F.unix_seconds("effect_ts") - F.unix_seconds("cause_ts")).alias("latency_s"))


def stream_dlp(docs: DataFrame, **how) -> DataFrame:
    """Findings of a stream of texts: the batch operator has no state, so it is the same plan. sinks.dlp_batch gives the redacted
    copy beside them."""
    return dlp_findings(docs, **how)


def burst_coalesce(triggers: DataFrame, gap_s: int = 2, long_gap_s: int = 5, many: int = 3) -> DataFrame:
    """Batch form: key, start, n: the first trigger opens a window of gap_s (long_gap_s if `many` triggers, itself included, fell in
    the long_gap_s before it); triggers before its deadline merge into it. A fold over each key's ordered triggers."""
    empty = F.struct(F.lit(-1.0).alias("deadline"), F.array().cast("array<double>").alias("recent"), F.array().cast("array<struct<start:double,n:int>>").alias("out"))

    def step(done, t):
        recent = F.filter(done["recent"], lambda x: x > t - long_gap_s)
        merged = F.concat(F.slice(done["out"], F.lit(1), F.size(done["out"]) - 1), F.transform(F.slice(done["out"], F.size(done["out"]), F.lit(1)), lambda o: F.struct(o["start"].alias("start"), (o["n"] + 1).alias("n"))))
        opened = F.concat(done["out"], F.array(F.struct(t.alias("start"), F.lit(1).alias("n"))))
        inside = (F.size(done["out"]) > 0) & (t < done["deadline"])
        gap = F.when(F.size(recent) + 1 >= many, float(long_gap_s)).otherwise(float(gap_s))
        return F.struct(F.when(inside, done["deadline"]).otherwise(t + gap).alias("deadline"), F.concat(recent, F.array(t)).alias("recent"), F.when(inside, merged).otherwise(opened).alias("out"))

    grouped = triggers.groupBy("key").agg(F.array_sort(F.collect_list(F.col("epoch").cast("double"))).alias("at"))
    return grouped.select("key", F.explode(F.aggregate("at", empty, step)["out"]).alias("o")).select("key", "o.start", "o.n")


def dedupe_events(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """One event per key within the lateness bound."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
