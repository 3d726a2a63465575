"""The pipeline, stage by stage against brute force over what the stage before kept."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_llm_operators import brute_components, brute_targets, odd_rows, squeezed, words  # noqa: E402


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(150)
    extra = [r for r in odd_rows() if r[0] is not None]
    odd = spark.createDataFrame([(10**6 + r[0], r[1], r[2], r[3], r[4]) for r in extra], docs.schema)
    docs = docs.unionByName(odd)
    at, kept = str(tmp_path / "0"), []
    docs.write.parquet(at)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES, 1):
        before = spark.read.parquet(at)
        out = stage(spark, before, data)
        if name != "pack_sequences":
            assert sorted(out.columns) == sorted(docs.columns)
        out.write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        kept.append((name, before.collect(), after.collect()))
        at = str(tmp_path / str(i))
    for name, before, after in kept:
        if name == "language_id":
            gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
            bare = {r["doc_id"] for r in before if not re.search(r"[^\W\d_]", r["text"] or "")}
            assert bare <= gone and len(gone - bare) <= 3
        elif name == "exact_dedup":
            assert sorted(squeezed(r["text"]) for r in after) == sorted({squeezed(r["text"]) for r in before})
            longest = defaultdict(list)
            for r in before:
                longest[squeezed(r["text"])].append((-len(r["text"] or ""), r["doc_id"]))
            assert {r["doc_id"] for r in after} == {min(v)[1] for v in longest.values()}
        elif name == "near_dedup":
            want = brute_components([(r["doc_id"], r["text"]) for r in before], 5, 80)
            assert {r["doc_id"] for r in after} == {least for _, least in want.values()}
        elif name == "mix_sources":
            sizes, got = defaultdict(int), defaultdict(int)
            for r in before:
                sizes[r["source"]] += len(words(r["text"]))
            for r in after:
                got[r["source"]] += len(words(r["text"]))
            assert all(abs(got[s] - t) <= 1 for s, t in brute_targets(dict(sizes)).items())
        else:
            assert sum(r["length"] for r in after) == sum({(r["doc_id"], r["start"], r["offset"], r["sequence_id"]): r["length"] for r in after}.values())
            whole = defaultdict(int)
            for r in after:
                whole[r["sequence_id"]] += r["length"]
            assert max(whole.values()) <= 1024 and {r["doc_id"] for r in after} == {r["doc_id"] for r in before}


def test_run(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    docs = {r["doc_id"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()}
    whole = defaultdict(int)
    for r in rows:
        whole[r["sequence_id"]] += r["length"]
    assert rows and {r["doc_id"] for r in rows} <= docs and max(whole.values()) <= 1024
    # nearly all that is not a copy stays
    texts = {squeezed(r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len({r["doc_id"] for r in rows}) > 0.7 * len(texts)
