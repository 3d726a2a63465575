"""What a larger table would break: sides that must not be broadcast, pairs that must not be made."""

from __future__ import annotations

from lodegrain.operators import code as K
from lodegrain.plans import ORACLES, QUERIES


def joins_of(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_targets_meet_symbols_on_the_end_of_the_path(spark):
    symbols = spark.createDataFrame([("g", f"lib/f{i}.rs", 1, 1, "Function") for i in range(300)] + [("G", "lib/a/xf7.rs", 1, 1, "Function")], "name string, path string, line_start int, line_end int, kind string")
    files = symbols.select("path").distinct().selectExpr("path", "'fn g() {}' AS content")
    targets = spark.createDataFrame([(i, "G", f"f{i}.rs") for i in range(300)] + [(1000, "g", "b/f7.rs"), (1001, "g", "a/xf7.rs"), (1002, "g", None)], "target int, name string, path string")
    got = K.enrich_targets_with_code(targets, symbols, files)
    rows = sorted((r["target"], r["symbol_path"], r["snippet"]) for r in got.collect())
    assert rows == sorted([(i, f"lib/f{i}.rs", "fn g() {}") for i in range(300)] + [(7, "lib/a/xf7.rs", "fn g() {}"), (1000, "lib/f7.rs", "fn g() {}"), (1001, "lib/a/xf7.rs", "fn g() {}")])
    # the pairs of equal names alone would be 300 * 300
    plan = joins_of(got)
    assert "BroadcastHashJoin" not in plan and "tail" in plan
    assert spark.createDataFrame([(1, "g", "")], "target int, name string, path string").transform(lambda t: K.enrich_targets_with_code(t, symbols, files)).count() == 301


def test_bodies_of_a_file_with_many_symbols(spark):
    files = spark.createDataFrame([("a", "\n".join(f"l{i}" for i in range(1, 101))), ("b", None)], "path string, content string")
    spans = [("s", 1, 1), ("t", 99, 150), ("u", 100, 99), ("v", 0, 2), ("w", 101, 103), ("s", 1, 1), ("x", None, 3)] + [(f"n{i}", i, i + 1) for i in range(1, 100)]
    symbols = spark.createDataFrame([(p, *x) for p in ("a", "b", "c") for x in spans], "path string, name string, line_start int, line_end int")
    got = K.symbol_bodies(files, symbols)
    rows = {(r["path"], r["name"]): r["body"] for r in got.collect()}
    assert rows == {("a", "s"): ["l1"], ("a", "t"): ["l99", "l100"], ("a", "v"): ["l1", "l2"]} | {("a", f"n{i}"): [f"l{i}", f"l{i + 1}"] for i in range(1, 100)}
    assert "Broadcast" not in joins_of(got)


def test_imports_of_more_than_a_hundred_suppliers(spark, tmp_path):
    import duckdb

    spark.range(300).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(3000).selectExpr("id % 7 AS l_suppkey", "id AS l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in QUERIES["resolve_imports"](spark, str(tmp_path)).select("src", "dst", "weight").collect()}
    con = duckdb.connect()
    for name in ("supplier", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == set(con.execute(ORACLES["resolve_imports"]).fetchall()) and len(got) > 700


def test_similarities_are_held_in_blocks(spark, data, monkeypatch):
    import tracemalloc

    import numpy as np
    from lodegrain.operators import retrieval as R
    from lodegrain.operators import vector_index as V

    vectors = spark.read.parquet(f"{data}/embeddings.parquet").limit(300).cache()
    q = vectors.selectExpr("vec_id AS query_id", "embedding")
    want = {tuple(r) for r in R.cosine_top_k(q, vectors, 3).collect()}
    monkeypatch.setattr(R, "MOST_CELLS", 1000)
    assert {tuple(r) for r in R.cosine_top_k(q, vectors, 3).collect()} == want and len(want) == 900
    index = R.VectorIndex(vectors, k=3)
    asked = q.selectExpr("query_id", "embedding AS q")
    monkeypatch.setattr(V, "MOST_CELLS", 1000)
    few = {tuple(r) for r in index.candidates(asked, most_queries=100).collect()}
    assert few == {tuple(r) for r in index.candidates(asked).collect()} and len(few) == 300 * index.coder.depth
    monkeypatch.undo()
    rows = np.random.default_rng(1).normal(size=(10_000, 4)).astype(np.float32)
    tracemalloc.start()
    V.nearest_centre(rows, rows[:2000])
    assert tracemalloc.get_traced_memory()[1] < 30_000_000  # all at once: 80 MB and more
    tracemalloc.stop()


def test_graph_tables_are_not_broadcast(spark, data):
    from lodegrain.plans import graph_queries as Q
    from lodegrain.plans.catalog import Views

    v = Views(spark, data)
    assert "SortMergeJoin" in joins_of(Q.metrics(v)) and joins_of(Q.metrics(v)).count("BroadcastHashJoin") == 0
    assert joins_of(QUERIES["cycles"](spark, data)).count("BroadcastHashJoin") == 0
    # a hub with more targets than a list has
    edges = spark.createDataFrame([(0, i) for i in range(1, 2501)] + [(i, 0) for i in range(1, 2501)] + [(0, 1)], "src long, dst long")
    ranks = {r["node"]: r["rank"] for r in Q.G.pagerank(edges, max_iter=3, tol=0).collect()}
    n, want = 2501, dict.fromkeys(range(2501), 1 / 2501)
    for _ in range(3):
        hub = want[0] / 2501
        want = {0: 0.15 / n + 0.85 * sum(want[i] for i in range(1, n)), 1: 0.15 / n + 0.85 * 2 * hub} | {i: 0.15 / n + 0.85 * hub for i in range(2, n)}
    assert all(abs(ranks[i] - want[i] / want[0]) < 1e-9 for i in range(n))


def test_scores_as_products_equal_scores_by_joins(spark, monkeypatch):
    import random

    from lodegrain.operators import retrieval as R

    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(40)))) for i in range(400)] + [(400, None), (7, "w1 w1")], "doc_id long, text string")
    asked = [(f"q{i}", f"w{rng.randrange(35)}", rng.choice([0.5, 3.0])) for i in range(20) for _ in range(8)]
    terms, postings = spark.createDataFrame(asked + [("none", "zzz", 1.0)], "query_id string, term string, weight double"), R.build_postings(docs)
    got = R.bm25(terms, postings)
    assert "MapInArrow" in joins_of(got)
    monkeypatch.setattr(R, "MOST_CELLS", 200)
    rows = {tuple(r) for r in got.union(R.bm25(terms, postings)).collect()}
    monkeypatch.setattr(R, "MOST_TERMS", 10)
    by_join = R.bm25(terms, postings)
    assert "MapInArrow" not in joins_of(by_join)
    assert rows == {tuple(r) for r in by_join.collect()} and len(rows) == 200


def test_pairs_of_commits_are_made_once_and_dealt_by_their_number(spark, monkeypatch):
    from collections import Counter
    from itertools import permutations

    from lodegrain.operators import history as H

    of = {c: {f"f{c % 7}", f"f{c % 5}", f"f{c % 3}", f"only{c}"} for c in range(40)}
    touched = spark.createDataFrame([(c, p) for c, paths in of.items() for p in paths] + [(99, None)], "commit_id long, path string")
    monkeypatch.setattr(H, "MOST_PAIRS", 50)
    got = H.co_changes(touched, top=None)
    plan = joins_of(got)
    assert "REPARTITION_BY_NUM" in plan and "BroadcastHashJoin [commit_id" not in plan
    want = {k: n for k, n in Counter(p for paths in of.values() for p in permutations(paths, 2)).items() if n >= 2}
    assert {(r["path"], r["other"]): r["together"] for r in got.collect()} == want
    assert H.co_changes(touched.limit(0)).count() == 0


def test_long_files_are_made_in_their_row(spark, data):
    plan = joins_of(QUERIES["body_snippet"](spark, data))
    assert "collect_list" not in plan and "explode(" not in plan


def test_tests_of_many_requests_are_dealt_by_their_number(spark, monkeypatch):
    from lodegrain.operators import questions as Q

    asked = spark.createDataFrame([(i, f"name{i % 3}", f"tests/t{i % 4}.py" if i % 2 else "src/a.py") for i in range(60)], "request_id long, name string, path string")
    hits = spark.createDataFrame([(f"name{k}", f"tests/t{j}.py", float((j * 7 + k) % 5)) for k in range(3) for j in range(12)], "name string, path string, score double")
    monkeypatch.setattr(Q, "MOST_ROWS", 100)
    got = Q.tests_for_symbols(asked, hits, ["request_id"])
    assert "REPARTITION_BY_NUM" in joins_of(got)
    best = {k: sorted([((j * 7 + k) % 5, -j, f"tests/t{j}.py") for j in range(12)], key=lambda x: (-x[0], x[2]))[:10] for k in range(3)}
    want = {(i, p) for i in range(60) for _, _, p in [x for x in best[i % 3] if not (i % 2 and x[2] == f"tests/t{i % 4}.py")][:3]}
    assert {(r["request_id"], r["path"]) for r in got.collect()} == want
    assert Q.tests_for_symbols(asked.limit(0), hits, ["request_id"]).count() == 0


def test_batch_of_requests_ranks_as_its_two_lists_say(spark, data):
    from lodegrain.operators import questions as Q
    from lodegrain.operators import retrieval as R
    from lodegrain.plans.catalog import Views
    from lodegrain.plans.retrieval_queries import document_vectors, postings, vector_queries

    # the fused list is read several times in one plan, where Spark could not put its parts together again
    got = {(r["request_id"], r["rank"]): (r["doc_id"], r["score"]) for r in QUERIES["ask_batch"](spark, data).collect()}
    v, parts = Views(spark, data), {}
    terms = Q.clean_query(v.benchmark.selectExpr("item_id AS query_id", "text"))
    for rows in (R.bm25(terms, postings(v), 15), R.cosine_top_k(vector_queries(v), document_vectors(v), 15, key="doc_id")):
        for r in rows.collect():
            of = parts.setdefault(r["query_id"], {})
            of[r["doc_id"]] = of.get(r["doc_id"], 0) + 1 / (60 + r["rank"])
    best = {q: sorted((-round(s * 30.5, 9), d) for d, s in of.items())[:5] for q, of in parts.items()}
    assert got == {(q, i): (d, -s) for q, rows in best.items() for i, (s, d) in enumerate(rows, 1)} and len(got) > 100


def broadcast_joins(query: str, spark, data, monkeypatch) -> list[str]:
    """The hash joins of a query, in all tables it saves too, that Spark would broadcast by size; `averages` has a row a field."""
    from lodegrain.operators import answers as A
    from lodegrain.operators import questions as Q
    from lodegrain.operators import retrieval as R

    plans = []
    for module in (A, Q):
        monkeypatch.setattr(module, "saved", lambda df, name, save=module.saved: plans.append(joins_of(df)) or save(df, name))
    monkeypatch.setattr(R, "MOST_TERMS", 1)  # as many terms as a large table has
    plans.append(joins_of(QUERIES[query](spark, data)))
    assert len(plans) > 4
    return [line.strip() for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line and "BroadcastHashJoin [field" not in line]


def test_targets_of_requests_are_not_broadcast(spark, data, monkeypatch):
    assert broadcast_joins("request_targets", spark, data, monkeypatch) == []


def test_tables_of_answers_are_not_broadcast(spark, data, monkeypatch):
    assert broadcast_joins("answer_batch", spark, data, monkeypatch) == []


def test_targets_of_the_smallest_tier_are_not_broadcast(spark, data, monkeypatch):
    assert broadcast_joins("request_targets_small", spark, data, monkeypatch) == []
