"""Loaders over small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodegrain.sources import loaders as L


def test_source_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.rs").write_bytes(b"\xff\xfe")
    (tmp_path / "src/c.txt").write_text("no")
    (tmp_path / "src/skip_me.js").write_text("y")
    (tmp_path / "src/long.ts").write_text("z" * 50)
    rows = L.load_source_files(spark, str(tmp_path / "src"), max_bytes=20, exclude=["skip_"]).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["language"], r["content"]) for r in rows] == [("a.py", "python", "x = 1\n")]


def test_commit_log(spark, tmp_path):
    (tmp_path / "log.json").write_text(json.dumps({"commit_id": "c1", "author": "a", "epoch": 5, "message": "fix: x\nbody", "paths": ["p", "q", "p"]}) + "\n")
    commits, files = L.load_commit_log(spark, str(tmp_path / "log.json"))
    assert commits.first()["message"] == "fix: x" and {r["path"] for r in files.collect()} == {"p", "q"}


def test_question_suite(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('# comment\n\n{"id": "1", "question": "?", "ground_truth": ["a"]}\n{"id": "2", "question": "?", "category": "x"}\n')
    assert {(r["id"], r["category"]) for r in L.load_question_suite(spark, str(tmp_path / "q.jsonl")).collect()} == {("1", "general"), ("2", "x")}
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|parse"):
        L.load_question_suite(spark, str(tmp_path / "bad.jsonl")).collect()


def test_diagnostics(spark):
    span = lambda f, n, primary, fix=None: {"file_name": f, "line_start": n, "line_end": n, "is_primary": primary, "suggested_replacement": fix, "suggestion_applicability": "MachineApplicable" if fix is not None else None}
    lines = [{"reason": "build-finished"}, {"reason": "compiler-message", "message": {"level": "warning", "message": "unused", "code": {"code": "W1"}, "spans": [span("a.rs", 1, False), span("b.rs", 7, True)],
              "children": [{"message": "remove", "spans": [span("b.rs", 7, True, "")]}]}}]
    row = L.parse_diagnostics(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")).collect()
    assert len(row) == 1 and (row[0]["code"], row[0]["path"], row[0]["line"]) == ("W1", "b.rs", 7) and row[0]["suggestions"][0]["applicability"] == "MachineApplicable"


def test_rules_and_metadata(spark, tmp_path):
    rules = spark.createDataFrame([("a", "plain", "deny"), ("b", "x.*y", "ask")], "name string, pattern string, action string")
    assert {r["name"]: r["is_regex"] for r in L.load_rules(rules).collect()} == {"a": False, "b": True}
    with pytest.raises(Exception, match="without a pattern"):
        L.load_rules(spark.createDataFrame([("c", "", "deny")], rules.schema)).collect()
    files = spark.createDataFrame([("x/README.md", "\n".join(map(str, range(100)))), ("x/y.py", "z")], "path string, content string")
    assert L.metadata_pseudo_docs(files, ["README.md"]).select(F.size(F.split("body", "\n"))).first()[0] == 80


def test_reports_round_trip(spark, tmp_path):
    L.write_report(spark.createDataFrame([(1, 0.5)], "id int, f1 double"), str(tmp_path / "report_20240102_030405"), {"kind": "search"})
    rows = L.load_result_history(spark, str(tmp_path / "report_20240102_030405/part-*")).collect()
    assert rows[0]["kind"] == "search" and json.loads(rows[0]["payload"])["payload"]["f1"] == 0.5
