"""Session activity (session, event_id, epoch, kind, tool, module, subject): phases, causes, loops and moments.

Every operator works on all sessions at once, with windows per session; the clock is the events' own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The phase that a tool speaks for.
TOOL_PHASES = {
    "Discovery": ["hoist", "search", "lookup", "ask", "similar", "consult"],
    "Implementation": ["diagnostics", "check", "quickfix", "blame", "intent"],
    "Stabilization": ["scan", "diagnose", "architect", "janitor", "janitor-fix", "oracle", "verify_path"],
}
#: The layer and mode of a moment.
MOMENTS = {
    "RapidScaffolding": ("Scaffolding", "Momentum"), "DeepBackendLogic": ("Backend", "Reasoning"), "ArchitectureWiring": ("Integration", "Reasoning"),
    "FrontendImplementation": ("Frontend", "Momentum"), "UxPolish": ("UX/Refinement", "Momentum"), "CrossLayerConsistency": ("Quality", "Reasoning"),
    "IterativeDistress": ("Recovery", "DeepReasoning"), "MomentumFlow": ("Maintenance", "Momentum"), "ExploratoryRefactoring": ("Evolution", "Reasoning"),
    "EmergencyPatching": ("Emergency", "DeepReasoning"),
}
#: Effect and its cause.
CAUSES = {"diagnostic": "file_change", "fix_proposed": "diagnostic", "fix_applied": "fix_proposed"}


def causal_links(activity: DataFrame, window_s: float = 10, causes: dict[str, str] | None = None) -> DataFrame:
    """session, cause_id, effect_id, kind, latency_s: the newest event of the causing kind before an effect, window_s at most."""
    earlier = Window.partitionBy("session").orderBy("epoch", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = activity
    causes = CAUSES if causes is None else causes
    for kind in sorted(set(causes.values())):
        rows = rows.withColumn(f"last_{kind}", F.last(F.when(F.col("kind") == kind, F.struct("event_id", "epoch")), ignorenulls=True).over(earlier))
    cause = F.coalesce(*[F.when(F.col("kind") == effect, F.col(f"last_{c}")) for effect, c in causes.items()])
    rows = rows.withColumn("cause", cause).where(F.col("epoch") - F.col("cause.epoch") <= window_s)
    return rows.select("session", F.col("cause.event_id").alias("cause_id"), F.col("event_id").alias("effect_id"), "kind", (F.col("epoch") - F.col("cause.epoch")).alias("latency_s"))


def classify_activity(reads: Column, writes: Column, fixes: Column, security: Column) -> Column:
    total = reads + writes + fixes + security
    share = lambda c: (c > 0) & (F.floor(c * 100 / total) >= 40)
    return F.when(total == 0, "Mixed").when(share(fixes), "Debugging").when(share(security), "Hardening").when(share(writes), "Coding").when(share(reads), "Exploring").otherwise("Mixed")


def phase_numbers(activity: DataFrame, idle_s: float = 300) -> DataFrame:
    """Add phase (from 0): a new one begins when the module changes or after more than idle_s; an event without a module
    goes on with the current one."""
    order = Window.partitionBy("session").orderBy("epoch", "event_id")
    module = F.nullif(F.col("module"), F.lit(""))
    rows = activity.withColumn("current", F.last(module, ignorenulls=True).over(order)).withColumn("previous", F.last(module, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    gap = F.col("epoch") - F.lag("epoch").over(order)
    begins = F.coalesce((F.col("previous").isNotNull() & (F.col("current") != F.col("previous"))) | (gap > idle_s), F.lit(False))
    return rows.withColumn("phase", F.sum(begins.cast("int")).over(order)).drop("previous")


def journey_phases(activity: DataFrame, idle_s: float = 300, max_files: int = 10) -> DataFrame:
    """session, phase, module, events, duration_s, start, files (distinct changed ones, max_files at most), activity, active."""
    rows = phase_numbers(activity, idle_s)
    of = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    security = F.count_if((F.col("kind") == "tool_call") & F.col("tool").isin("scan", "architect", "janitor"))
    rows = rows.groupBy("session", "phase").agg(
        F.max("current").alias("module"), F.count("*").alias("events"), (F.max("epoch") - F.min("epoch")).alias("duration_s"), F.min("epoch").alias("start"),
        F.size(F.slice(F.array_sort(F.collect_set(F.when(F.col("kind") == "file_change", F.col("subject")))), 1, max_files)).alias("files"),
        of("search_query", "symbol_resolved").alias("r"), of("file_change").alias("w"), of("diagnostic").alias("f"), security.alias("s"))
    last = F.max("phase").over(Window.partitionBy("session"))
    return rows.withColumn("activity", classify_activity(F.col("r"), F.col("w"), F.col("f"), F.col("s"))).withColumn("active", F.col("phase") == last).drop("r", "w", "f", "s")


def loop_alerts(phases: DataFrame, window: int = 6) -> DataFrame:
    """session, phase, modules, oscillations: the last `window` phases go to and fro between two modules, or three of them
    and more are in the newest one's module."""
    frame = Window.partitionBy("session").orderBy("phase").rowsBetween(-(window - 1), 0)
    rows = phases.withColumn("recent", F.reverse(F.collect_list("module").over(frame))).where(F.size("recent") >= window)
    a, b = F.col("recent")[0], F.col("recent")[1]
    swings = (a != b) & F.size(F.filter("recent", lambda m, i: m == F.when(i % 2 == 0, a).otherwise(b))).eqNullSafe(F.size("recent"))
    same = F.size(F.filter("recent", lambda m: m == a))
    rows = rows.withColumn("swings", swings).withColumn("same", same).where(F.col("swings") | (F.col("same") >= 3))
    return rows.select("session", "phase", F.when(F.col("swings"), F.concat_ws(",", a, b)).otherwise(a).alias("modules"),
                       F.when(F.col("swings"), F.floor(F.size("recent") / 2)).otherwise(F.col("same")).cast("int").alias("oscillations"))


def session_phase(activity: DataFrame, window: int = 10, staged: Column | None = None) -> DataFrame:
    """session, event_id, session_phase after each event with a tool that speaks for a phase: the majority of the last
    `window` such tools; ties go to Stabilization, then Implementation. `staged` forces Stabilization."""
    signal = F.coalesce(*[F.when(F.col("tool").isin(tools), phase) for phase, tools in TOOL_PHASES.items()])
    frame = Window.partitionBy("session").orderBy("epoch", "event_id").rowsBetween(-(window - 1), 0)
    rows = activity.withColumn("signal", signal).where("signal is not null")
    d, i, s = [F.count_if(F.col("signal") == p).over(frame) for p in TOOL_PHASES]
    phase = F.when((s >= d) & (s >= i), "Stabilization").when(i >= d, "Implementation").otherwise("Discovery")
    if staged is not None:
        phase = F.when(staged, "Stabilization").otherwise(phase)
    return rows.select("session", "event_id", phase.alias("session_phase"))


def session_metrics(activity: DataFrame, window: int = 15, repeat_s: float = 120) -> DataFrame:
    """Per session over its newest `window` events: n, avg_interval (999 below two), modules, subjects, variance, repeats of
    the newest subject within repeat_s, read_ratio (0.5 without reads and writes)."""
    order = Window.partitionBy("session").orderBy(F.desc("epoch"), F.desc("event_id"))
    rows = activity.withColumn("place", F.row_number().over(order)).where(F.col("place") <= window)
    newest = Window.partitionBy("session")
    subject, at = F.max(F.when(F.col("place") == 1, F.col("subject"))).over(newest), F.max("epoch").over(newest)
    rows = rows.withColumn("again", (F.col("subject") == subject) & (at - F.col("epoch") <= repeat_s))
    reads, writes = F.count_if(F.col("kind").isin("search_query", "symbol_resolved")), F.count_if(F.col("kind") == "file_change")
    n = F.count("*")
    return rows.groupBy("session").agg(
        n.alias("n"), F.when(n < 2, 999.0).otherwise((F.max("epoch") - F.min("epoch")) / (n - 1)).alias("avg_interval"),
        F.countDistinct(F.nullif("module", F.lit(""))).alias("modules"), F.countDistinct("subject").alias("subjects"),
        (F.countDistinct("subject") / n).alias("variance"), F.count_if("again").alias("repeats"),
        F.when(reads + writes > 0, reads / (reads + writes)).otherwise(0.5).alias("read_ratio"))


def session_moments(activity: DataFrame, window: int = 15, repeat_s: float = 120, idle_s: float = 300, loop_window: int = 6, **thresholds) -> DataFrame:
    """session, moment, layer, mode at each session's newest event, from the events alone: the metrics of its newest events, its phases
    and whether they loop, and the errors of its newest diagnostics (`errors`, null in other events) with their trend."""
    newest = Window.partitionBy("session").orderBy(F.desc("epoch"), F.desc("event_id"))
    reports = activity.where("errors is not null").withColumn("place", F.row_number().over(newest)).where("place <= 2")
    reports = reports.groupBy("session").agg(F.max(F.when(F.col("place") == 1, F.col("errors"))).alias("errors"), F.max(F.when(F.col("place") == 2, F.col("errors"))).alias("before"))
    phases = journey_phases(activity, idle_s)
    now = phases.where("active").select("session", (F.col("phase") + 1).alias("phases"), "activity", F.col("phase").alias("last"))
    loops = loop_alerts(phases, loop_window).select("session", F.col("phase").alias("last"), F.lit(True).alias("looping"))
    rows = session_metrics(activity, window, repeat_s).join(now, "session").join(loops, ["session", "last"], "left").join(reports, "session", "left")
    trend = F.coalesce(F.signum(F.col("errors") - F.col("before")), F.lit(0.0))
    rows = rows.withColumns({"trend": trend, "looping": F.coalesce("looping", F.lit(False)), "errors": F.coalesce("errors", F.lit(0))})
    return operational_moment(rows, **thresholds)


def operational_moment(metrics: DataFrame, least_events: int = 3, loop_repeats: int = 3, keys: tuple[str, ...] = ("session",)) -> DataFrame:
    """keys, moment, layer, mode: the first rule that holds, on rows of session_metrics with errors, trend, phases,
    looping and activity."""
    c = F.col
    moment = (
        F.when(c("n") < least_events, "RapidScaffolding")
        .when((c("errors") >= 5) & (c("avg_interval") < 10), "EmergencyPatching")
        .when((c("repeats") >= loop_repeats) | c("looping"), "IterativeDistress")
        .when((c("errors") > 0) & (c("activity") == "Debugging"), "DeepBackendLogic")
        .when((c("modules") >= 3) & (c("variance") > 0.6), "ArchitectureWiring")
        .when(c("activity") == "Hardening", "CrossLayerConsistency")
        .when((c("read_ratio") > 0.7) & (c("variance") > 0.5) & (c("phases") > 3), "ExploratoryRefactoring")
        .when((c("modules") <= 1) & (c("read_ratio") < 0.3) & (c("errors") == 0), "DeepBackendLogic")
        .when((c("phases") <= 2) & (c("avg_interval") < 15) & (c("subjects") > 3), "RapidScaffolding")
        .when((c("trend") < 0) & (c("errors") == 0), "CrossLayerConsistency")
        .otherwise("MomentumFlow")
    )
    pick = lambda k: F.coalesce(*[F.when(F.col("moment") == m, v[k]) for m, v in MOMENTS.items()])
    return metrics.withColumn("moment", moment).select(*keys, "moment", pick(0).alias("layer"), pick(1).alias("mode"))


def triggered_by(phases: DataFrame, pairs: DataFrame) -> DataFrame:
    """session, phase, module, trigger: the module of the phase before, where this module depends on it."""
    before = F.lag("module").over(Window.partitionBy("session").orderBy("phase"))
    rows = phases.withColumn("trigger", before)
    return rows.join(pairs, (rows["module"] == pairs["src"]) & (F.col("trigger") == pairs["dst"]), "left_semi").select("session", "phase", "module", "trigger")


def nearest_preceding(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with `value` of the right row of the same key at the greatest position not above its own (null if there is none)."""
    names = left.columns
    both = left.select(key, at, F.struct(*names).alias("row"), F.lit(None).cast(right.schema[value].dataType).alias("v"), F.lit(1).alias("side")).unionByName(
        right.select(key, at, F.lit(None).cast(left.select(F.struct(*names).alias("s")).schema["s"].dataType).alias("row"), F.col(value).alias("v"), F.lit(0).alias("side")))
    order = Window.partitionBy(key).orderBy(at, "side")
    return both.withColumn("v", F.last("v", ignorenulls=True).over(order)).where("side = 1").select("row.*", F.col("v").alias(value))
