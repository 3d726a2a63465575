"""Graph operators over edges (src, dst, weight): PageRank, cycles, components, degrees, layers and reports.

Iterative operators write each round's table to the shared folder and read it back, so plans stay short and a lost executor
costs one re-read. Nothing of the graph reaches the driver but counts: tables of nodes grow with the graph and compress well, so Spark
would take them for small and broadcast them; the hints keep their joins shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import replaced, saved


def pagerank(edges: DataFrame, d: float = 0.85, max_iter: int = 100, tol: float = 1e-6, nodes: DataFrame | None = None) -> DataFrame:
    """node, rank, divided by the greatest rank. Rows of edges count as parallel edges; the mass of nodes without out-edges
    is not redistributed; stops when no rank changes by tol. Ranks move as (dst, share) sums, pre-aggregated per task, so a
    hub costs a row a task; a round joins lists of about 1,000 targets at most and not single links."""
    if nodes is None:
        nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("out") / 1000))
    links = saved(edges.join(out.hint("merge"), "src").groupBy("src", "out", part.alias("part")).agg(F.collect_list("dst").alias("to")).drop("part"), "links")
    nodes = saved(nodes, "nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    ranks, last = nodes.withColumn("rank", F.lit(1.0 / n)), None
    for _ in range(max_iter):
        shares = links.join(ranks.hint("merge"), links["src"] == ranks["node"]).select((F.col("rank") / F.col("out")).alias("share"), F.explode("to").alias("dst"))
        sums = shares.groupBy("dst").agg(F.sum("share").alias("got"))
        new = ranks.withColumnRenamed("rank", "old").join(sums.hint("merge"), F.col("node") == F.col("dst"), "left")
        new = saved(new.select("node", "old", (F.lit((1 - d) / n) + d * F.coalesce("got", F.lit(0.0))).alias("rank")), "ranks")
        moved = new.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new.select("node", "rank")
        replaced(last)
        last = new
        if moved < tol:
            break
    top = ranks.agg(F.max("rank")).first()[0]
    return ranks.withColumn("rank", F.col("rank") / F.lit(top))


def degrees(edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree, kind: root (nothing comes in), leaf (nothing goes out) or inner."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    rows = both.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    kind = F.when(F.col("in_degree") == 0, "root").when(F.col("out_degree") == 0, "leaf").otherwise("inner")
    return rows.withColumn("kind", kind)


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component (its least node): large and small stars alternate, a logarithmic number of rounds."""
    links = saved(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "links")
    state = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        old, links = links, saved(small.distinct(), "links")
        replaced(old)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    labels = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    every = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    every = (every if nodes is None else every.union(nodes)).distinct()
    return every.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))


def cycles(edges: DataFrame) -> DataFrame:
    """node, cycle: strongly connected components of two nodes and more, named by their least node.

    Nodes that nothing enters or nothing leaves are trimmed; the least node that reaches a node is carried forward, and
    backward inside the sets that share it: nodes reached both ways form a component, and the rest goes on."""
    rest = saved(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    found = None
    while True:
        while True:
            inner = rest.select("src").distinct().join(rest.select(F.col("dst").alias("src")).distinct().hint("merge"), "src", "left_semi")
            kept = rest.join(inner.hint("merge"), "src", "left_semi").join(inner.withColumnRenamed("src", "dst").hint("merge"), "dst", "left_semi").select("src", "dst")
            kept, before, old = saved(kept, "kept"), rest.count(), rest
            rest = kept
            replaced(old)
            if rest.count() == before:
                break
        if rest.isEmpty():
            break
        forward = _spread(rest, "src", "dst")
        own = rest.join(forward.select(F.col("node").alias("src"), F.col("label").alias("a")).hint("merge"), "src").join(forward.select(F.col("node").alias("dst"), F.col("label").alias("b")).hint("merge"), "dst")
        backward = _spread(own.where("a = b").select(F.col("dst").alias("s"), F.col("src").alias("d")), "s", "d", forward)
        done = saved(forward.join(backward.withColumnRenamed("label", "back").hint("merge"), "node").where("label = back").select("node", F.col("label").alias("cycle")), "done")
        found = done if found is None else found.unionByName(done)
        # components are closed: what is left lies wholly outside them
        left = rest.join(done.select(F.col("node").alias("src")).hint("merge"), "src", "left_anti").join(done.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_anti")
        rest = saved(left.select("src", "dst"), "rest")
    if found is None:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("cycle")).limit(0)
    large = found.groupBy("cycle").count().where("count > 1")
    return found.join(large.hint("merge"), "cycle", "left_semi").select("node", "cycle")


def _spread(edges: DataFrame, a: str, b: str, start: DataFrame | None = None) -> DataFrame:
    """node, label: the least node from which a -> b leads to it. With `start`, only a set's own name spreads in it."""
    if start is None:
        labels = edges.select(F.col(a).alias("node")).union(edges.select(b)).distinct().withColumn("label", F.col("node"))
    else:
        labels = start.withColumn("label", F.when(F.col("label") == F.col("node"), F.col("label")))
    labels = last = saved(labels, "labels")
    while True:
        came = edges.join(labels.hint("merge"), edges[a] == labels["node"]).groupBy(F.col(b).alias("node")).agg(F.min("label").alias("other"))
        new = labels.join(came.hint("merge"), "node", "left").withColumn("new", F.least("label", "other"))
        new = saved(new, "labels")
        settled = new.where(~F.col("label").eqNullSafe(F.col("new"))).isEmpty()
        replaced(last)
        labels, last = new.select("node", F.col("new").alias("label")), new
        if settled:
            return labels


def ancestors(parents: DataFrame, max_depth: int | None = 20) -> DataFrame:
    """node, ancestor, depth (the least): rows (node, parent) followed upward, each round with the new pairs only."""
    known = saved(parents.select("node", F.col("parent").alias("ancestor")).where("node <> parent").distinct().withColumn("depth", F.lit(1)), "known")
    frontier, depth = known, 1
    step = parents.select(F.col("node").alias("ancestor"), "parent").where("ancestor <> parent").distinct()
    while max_depth is None or depth < max_depth:
        depth += 1
        up = frontier.join(step, "ancestor").select("node", F.col("parent").alias("ancestor")).where("node <> ancestor").distinct()
        frontier = saved(up.join(known, ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def dependency_pairs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def coupling(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """module, ce, ca, instability, fan_out, fan_in, complexity (functions): modules without edges have zeros."""
    out = edges.groupBy(F.col("src").alias("module")).agg(F.count("*").alias("ce"), F.sum("weight").alias("fan_out"))
    into = edges.groupBy(F.col("dst").alias("module")).agg(F.count("*").alias("ca"), F.sum("weight").alias("fan_in"))
    rows = modules.join(out.hint("merge"), "module", "left").join(into.hint("merge"), "module", "left").fillna(0, ["ce", "ca", "fan_out", "fan_in"])
    total = F.col("ca") + F.col("ce")
    return rows.select("module", "ce", "ca", F.when(total > 0, F.col("ce") / total).otherwise(0.0).alias("instability"), "fan_out", "fan_in", F.col("functions").alias("complexity"))


def graph_density(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: modules, edges, density E / (V (V - 1)), 0 for one module or none."""
    v = modules.agg(F.count("*").alias("modules"))
    e = edges.agg(F.count("*").alias("edges"))
    pairs = F.col("modules") * (F.col("modules") - 1)
    # one row each
    return v.join(F.broadcast(e), F.lit(True)).withColumn("density", F.when(F.col("modules") > 1, F.col("edges") / pairs).otherwise(0.0))


def god_objects(metrics: DataFrame, max_symbols: int = 50, max_lines: int = 1000, min_fan_in: int = 5) -> DataFrame:
    """module, reason, of rows (module, symbols, lines, fan_in): too many symbols, or long and depended upon."""
    reason = F.when(F.col("symbols") > max_symbols, "symbols").when((F.col("lines") > max_lines) & (F.col("fan_in") >= min_fan_in), "lines")
    return metrics.select("module", reason.alias("reason")).where("reason is not null")


def density_anomaly(density: DataFrame, high: float = 0.5, low: float = 0.02, least_modules: int = 10) -> DataFrame:
    kind = F.when(F.col("density") > high, "high").when((F.col("density") < low) & (F.col("modules") >= least_modules), "low")
    return density.select("modules", "edges", "density", kind.alias("anomaly")).where("anomaly is not null")


def assign_layers(modules: DataFrame, layers: DataFrame) -> DataFrame:
    """module, layer, layer_rank; layers are (pattern, layer, layer_rank): the exact name, else the longest pattern ending
    in * that is a prefix. The patterns are configuration."""
    exact = layers.where(~F.col("pattern").endswith("*"))
    prefix = layers.where(F.col("pattern").endswith("*")).withColumn("prefix", F.expr("left(pattern, length(pattern) - 1)"))
    by_name = modules.select("module").join(F.broadcast(exact), F.col("module") == F.col("pattern"))
    by_prefix = modules.select("module").join(F.broadcast(prefix), F.col("module").startswith(F.col("prefix")))
    rows = by_name.select("module", "layer", "layer_rank", F.lit(1 << 20).alias("weight"), "pattern").unionByName(
        by_prefix.select("module", "layer", "layer_rank", F.length("prefix").alias("weight"), "pattern"))
    best = rows.groupBy("module").agg(F.max_by(F.struct("layer", "layer_rank"), F.struct("weight", "pattern")).alias("l"))
    return best.select("module", "l.layer", "l.layer_rank")


def layer_violations(edges: DataFrame, layered: DataFrame) -> DataFrame:
    """src, dst, src_layer, dst_layer of edges from a lower layer to a higher one."""
    s = layered.select(F.col("module").alias("src"), F.col("layer").alias("src_layer"), F.col("layer_rank").alias("src_rank"))
    t = layered.select(F.col("module").alias("dst"), F.col("layer").alias("dst_layer"), F.col("layer_rank").alias("dst_rank"))
    return edges.join(s.hint("merge"), "src").join(t.hint("merge"), "dst").where("src_rank < dst_rank").select("src", "dst", "src_layer", "dst_layer")


def lint_graph(cycle_nodes: DataFrame, gods: DataFrame, violations: DataFrame, anomalies: DataFrame) -> DataFrame:
    """rule, subject, severity of all four checks."""
    text = lambda *c: F.concat_ws("->", *[F.col(x).cast("string") for x in c])
    return (
        cycle_nodes.groupBy("cycle").count().select(F.lit("cycle").alias("rule"), text("cycle").alias("subject"), F.lit("error").alias("severity"))
        .unionByName(gods.select(F.lit("god_object").alias("rule"), text("module").alias("subject"), F.lit("warning").alias("severity")))
        .unionByName(violations.select(F.lit("layer").alias("rule"), text("src", "dst").alias("subject"), F.lit("error").alias("severity")))
        .unionByName(anomalies.select(F.lit("density").alias("rule"), F.col("anomaly").alias("subject"), F.lit("warning").alias("severity")))
    )


def architecture_report(metrics: DataFrame, edges: DataFrame, density: DataFrame, lint: DataFrame) -> DataFrame:
    """One row: averages, the greatest weight, counts by severity, score (100 less penalties, 0 at least) and grade."""
    m = metrics.agg(F.avg("instability").alias("instability"), F.avg("complexity").alias("complexity"))
    e = edges.agg(F.max("weight").alias("coupling"))
    s = lint.agg(*[F.count_if(F.col("severity") == x).alias(f"{x}s") for x in ("critical", "error", "warning")])
    row = m.join(F.broadcast(e), F.lit(True)).join(F.broadcast(s), F.lit(True)).join(F.broadcast(density.select("density")), F.lit(True))
    bad = lambda c, limit: F.coalesce((F.col(c) > limit).cast("int"), F.lit(0)) * 5
    score = F.lit(100) - F.col("criticals") * 15 - F.col("errors") * 8 - F.col("warnings") * 3 - bad("instability", 0.7) - bad("complexity", 20) - bad("coupling", 15) - bad("density", 0.5)
    row = row.withColumn("score", F.greatest(score, F.lit(0)))
    grade = F.when(F.col("score") >= 90, "A").when(F.col("score") >= 75, "B").when(F.col("score") >= 60, "C").when(F.col("score") >= 40, "D").otherwise("F")
    return row.withColumn("grade", grade)
