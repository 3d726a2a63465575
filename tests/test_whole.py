"""Queries over whole tables against brute force."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest

from lodegrain.plans import QUERIES
from lodegrain.plans.catalog import Views
from lodegrain.operators import graph as G
from lodegrain.plans.fixtures import edges


@pytest.fixture(scope="module")
def graph(spark, data):
    """Edges with weights, made in Python of the rows of lineitem."""
    v = Views(spark, data)
    n = v.part.agg({"p_partkey": "max"}).first()[0] + 1
    weights = Counter()
    for r in v.lineitem.select("l_partkey", "l_orderkey", "l_linenumber").collect():
        k = r[1] * 3 + r[2]
        step = 4 * (1 + k % (n // 4 - 1)) if r[0] % 4 == 0 else 1 + k % (n - 1)
        weights[r[0], (r[0] + step) % n] += 1
    return weights


def reached(starts, follow):
    seen, todo = set(starts), list(starts)
    while todo:
        for x in follow[todo.pop()]:
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return seen


def test_every_lineitem_row_is_in_the_graph(spark, data, graph):
    v = Views(spark, data)
    got = {(r["src"], r["dst"]): r["weight"] for r in edges(v).collect()}
    assert got == graph and sum(got.values()) == v.lineitem.count()
    assert {x for pair in got for x in pair} == {r[0] for r in v.part.select("p_partkey").collect()} and all(a != b for a, b in got)
    assert {tuple(r) for r in QUERIES["dependency_pairs"](spark, data).select("src", "dst").collect()} == set(graph)


def test_pagerank_whole(spark, data, graph):
    nodes = {x for pair in graph for x in pair}
    out = Counter(a for a, _ in graph)
    ranks = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(100):
        new = dict.fromkeys(nodes, 0.15 / len(nodes))
        for a, b in graph:
            new[b] += 0.85 * ranks[a] / out[a]
        moved, ranks = max(abs(new[x] - ranks[x]) for x in nodes), new
        if moved < 1e-6:
            break
    got = {r["node"]: r["rank"] for r in G.pagerank(edges(Views(spark, data))).collect()}
    assert got == pytest.approx({x: r / max(ranks.values()) for x, r in ranks.items()}, abs=1e-9)


def test_cycles_components_and_degrees_whole(spark, data, graph):
    ahead, back, both = defaultdict(set), defaultdict(set), defaultdict(set)
    for a, b in graph:
        ahead[a].add(b)
        back[b].add(a)
        both[a].add(b)
        both[b].add(a)
    rings = {x: min(reached([x], ahead) & reached([x], back)) for x in both if len(reached([x], ahead) & reached([x], back)) > 1}
    assert {r["node"]: r["cycle"] for r in QUERIES["cycles"](spark, data).collect()} == rings and len(set(rings.values())) > 1
    assert {r["node"]: r["component"] for r in QUERIES["connected_components"](spark, data).collect()} == {x: min(reached([x], both)) for x in both}
    assert {r["node"]: (r["in_degree"], r["out_degree"]) for r in QUERIES["degrees"](spark, data).collect()} == {x: (len(back[x]), len(ahead[x])) for x in both}


def layer(module: int) -> tuple[str, int] | None:
    name = str(module)
    return ("ui", 3) if name == "7" else ("domain", 2) if name.startswith("11") else ("core", 1) if name.startswith("1") else None


def test_reports_over_every_module(spark, data, graph):
    rows = {r[0]: r[1] for r in Views(spark, data).part.select("p_partkey", "p_size").collect()}
    ce, ca, out, into = Counter(), Counter(), Counter(), Counter()
    for (a, b), w in graph.items():
        ce[a], ca[b], out[a], into[b] = ce[a] + 1, ca[b] + 1, out[a] + w, into[b] + w
    got = {r["module"]: r for r in QUERIES["coupling"](spark, data).collect()}
    assert {m: (r["ce"], r["ca"], r["fan_out"], r["fan_in"], r["complexity"]) for m, r in got.items()} == {m: (ce[m], ca[m], out[m], into[m], s) for m, s in rows.items()}
    gods = {m: "symbols" if s * 2 > 50 else "lines" for m, s in rows.items() if s * 2 > 50 or (s * 40 > 1000 and into[m] >= 5)}
    assert {r["module"]: r["reason"] for r in QUERIES["god_objects"](spark, data).collect()} == gods and gods
    layers = {m: layer(m) for m in rows if layer(m)}
    assert {r["module"]: (r["layer"], r["layer_rank"]) for r in QUERIES["assign_layers"](spark, data).collect()} == layers
    wrong = {(a, b) for a, b in graph if a in layers and b in layers and layers[a][1] < layers[b][1]}
    assert {(r["src"], r["dst"]) for r in QUERIES["layer_violations"](spark, data).collect()} == wrong and wrong
    density = len(graph) / (len(rows) * (len(rows) - 1))
    row = QUERIES["graph_density"](spark, data).first()
    assert (row["modules"], row["edges"]) == (len(rows), len(graph)) and row["density"] == pytest.approx(density)
    odd = QUERIES["density_anomaly"](spark, data).count()
    assert odd == (density > 0.5 or density < 0.02)
    rings = {r["cycle"] for r in QUERIES["cycles"](spark, data).collect()}
    found = Counter(r["rule"] for r in QUERIES["lint_graph"](spark, data).collect())
    assert found == +Counter(cycle=len(rings), god_object=len(gods), layer=len(wrong), density=odd)
    report = QUERIES["architecture_report"](spark, data).first()
    assert (report["coupling"], report["errors"], report["warnings"]) == (max(graph.values()), len(rings) + len(wrong), len(gods) + odd)
    assert report["complexity"] == pytest.approx(sum(rows.values()) / len(rows))


def test_spans_meet_symbols_of_every_part(spark, data):
    v = Views(spark, data)
    names = dict(v.part.select("p_partkey", "p_name").collect())
    n = max(names) + 1
    want = {}
    for span, path in v.events.select("event_id", "event_type").collect():
        line = span * 7 % (n * 12 + 20)
        want[span] = (path, line, next((names[o] for o in range(max(line // 12 - 5, 0), min(line // 12 + 1, n)) if o in names and o * 12 + 1 <= line <= o * 12 + 1 + o % 5 * 9), None))
    got = {r["span_id"]: (r["path"], r["line"], r["symbol"]) for r in QUERIES["attribute_spans"](spark, data).select("span_id", "path", "line", "symbol").collect()}
    assert got == want and max(line for _, line, name in want.values() if name) > 40 * 12 + 40


def words(text: str) -> list[str]:
    return [re.sub("(ing|ed|ies|es|s)$", "", w) if len(w) > 4 else w for w in re.findall("[a-z0-9]+", (text or "").lower())]


@pytest.fixture(scope="module")
def passages(tmp_path_factory, spark):
    """Documents that only the words after the fifth of a passage find, and terms of three and four characters."""
    at = str(tmp_path_factory.mktemp("passages"))
    docs = [(0, "zebra zebra lions", "a"), (1, "one two three", "a"), (2, "catalog birds one", "b"), (3, "nothing here", "b"), (4, "zebras", "c"), (5, None, "c")]
    items = [(0, "one two three four five six zebra"), (1, "alpha beta gamma delta epsilon zeta cat bird"), (2, "")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(0, 1.0), (1, 0.0), (2, 1.0), (7, 1.0)], "doc_id long, quality double").write.parquet(f"{at}/labels.parquet")
    return at, {d: Counter(words(t)) for d, t, _ in docs if t}, {q: set(words(t)) for q, t in items}


def test_whole_passages_are_searched(spark, passages):
    at, docs, items = passages
    average = sum(sum(d.values()) for d in docs.values()) / len(docs)
    want = {}
    for q, terms in items.items():
        for d, tf in docs.items():
            score = 0.0
            for t in terms & set(tf):
                df = sum(t in x for x in docs.values())
                score += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * sum(tf.values()) / average))
            if score:
                want[q, d] = score
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in QUERIES["bm25"](spark, at).collect()}
    assert got == pytest.approx(want, abs=1e-6) and {(0, 0), (0, 4), (1, 2)} <= set(got)
    prefixes = {(q, t, m, d) for q, terms in items.items() for t in terms if 3 <= len(t) <= 12 for d, tf in docs.items() for m in tf if m.startswith(t)}
    assert {tuple(r) for r in QUERIES["prefix_match"](spark, at).select("query_id", "term", "matched", "doc_id").collect()} == prefixes
    assert {(1, "cat", "catalog", 2), (1, "bird", "bird", 2)} <= prefixes
    near = {(r["query_id"], r["doc_id"]) for name in ("min_max", "quality_rerank") for r in QUERIES[name](spark, at).collect()}
    assert near == set(want)
    assert {(r["query_id"], r["source"]) for r in QUERIES["dedupe_hits"](spark, at).collect()} == {(0, "a"), (0, "b"), (0, "c"), (1, "b")}
    metrics = {r["query_id"]: r for r in QUERIES["retrieval_metrics"](spark, at).collect()}
    place = sorted((-score, d) for (q, d), score in want.items() if q == 0).index((-want[0, 0], 0)) + 1
    assert metrics[0]["mrr"] == pytest.approx(1 / place) and metrics[0]["r_at_k"] == 0.5


def test_fuzzy_terms_after_the_fifth(spark, passages, tmp_path):
    spark.createDataFrame([(0, "zebta brid")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{passages[0]}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in QUERIES["fuzzy_match"](spark, str(tmp_path)).select("query_id", "term", "matched").collect()}
    assert got == {(0, "zebra", "zebta"), (1, "zeta", "zebta"), (1, "bird", "brid")}
