"""Operators for SQL users: table functions over a TABLE argument, registered in a session.

    register_table_functions(spark)
    spark.sql("SELECT * FROM fuse_ranked(TABLE(hits), 60, 10)")
    spark.sql("SELECT * FROM file_hotspots(TABLE(SELECT path, epoch FROM touched), 915148800)")
    spark.sql("SELECT * FROM dlp_findings(TABLE(docs))")

Each names the partitioning of its input itself: hits by query, commits by path; texts need none. A partition is folded row by row, so what
a task holds is a query's fused keys or one path's counts. The rules are those of the DataFrame operators.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, PartitioningColumn
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from .security import RULES, WHITELIST


def _input(table: AnalyzeArgument, *names: str) -> StructType:
    """The type of the TABLE argument, which must have these columns."""
    if not table.isTable:
        raise ValueError("the first argument is a TABLE")
    missing = set(names) - set(table.dataType.names)
    if missing:
        raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
    return table.dataType


class FuseRanked:
    """query_id, key, score, source, rank of hits (query_id, key, rank from 1, source): retrieval.rrf of any number of lists named by
    source; the key is the one other column."""

    def __init__(self) -> None:
        self.query, self.parts, self.sources = None, {}, {}

    @staticmethod
    def analyze(hits: AnalyzeArgument, k: AnalyzeArgument = None, most: AnalyzeArgument = None) -> AnalyzeResult:
        given = _input(hits, "query_id", "rank", "source")
        keys = [c for c in given.names if c not in ("query_id", "rank", "source")]
        if len(keys) != 1:
            raise ValueError("hits have query_id, rank, source and one key")
        out = StructType().add("query_id", given["query_id"].dataType).add(keys[0], given[keys[0]].dataType)
        return AnalyzeResult(out.add("score", DoubleType()).add("source", StringType()).add("rank", LongType()), partitionBy=[PartitioningColumn("query_id")])

    def eval(self, hit: Row, k: int = 60, most: int = 10) -> None:
        given = hit.asDict()
        key = next(c for c in given if c not in ("query_id", "rank", "source"))
        self.query, self.k, self.most = given["query_id"], k, most
        self.parts.setdefault(given[key], []).append(1 / (k + given["rank"]))
        self.sources.setdefault(given[key], set()).add(given["source"])

    def terminate(self) -> Iterator[tuple]:
        scored = sorted(((-round(math.fsum(p) * (self.k + 1) / 2, 9), key) for key, p in self.parts.items()), key=lambda x: (x[0], x[1] is not None, x[1]))
        for rank, (minus, key) in enumerate(scored[: self.most] if self.parts else [], 1):
            found = self.sources[key]
            yield self.query, key, -minus, "both" if len(found) > 1 else next(iter(found)), rank


class FileHotspots:
    """path, commits, hotspot of rows (path, epoch), a row per file and commit: history.file_hotspots."""

    def __init__(self) -> None:
        self.n, self.oldest, self.newest = 0, None, None

    @staticmethod
    def analyze(touched: AnalyzeArgument, as_of: AnalyzeArgument, lam: AnalyzeArgument = None) -> AnalyzeResult:
        given = _input(touched, "path", "epoch")
        out = StructType().add("path", given["path"].dataType).add("commits", LongType()).add("hotspot", DoubleType())
        return AnalyzeResult(out, partitionBy=[PartitioningColumn("path")])

    def eval(self, commit: Row, as_of: int, lam: float = 0.05) -> None:
        self.path, self.as_of, self.lam, epoch = commit["path"], as_of, float(lam), commit["epoch"]
        self.n += 1
        if epoch is not None:
            self.oldest = epoch if self.oldest is None else min(self.oldest, epoch)
            self.newest = epoch if self.newest is None else max(self.newest, epoch)

    def terminate(self) -> Iterator[tuple]:
        if not self.n:
            return
        if self.n <= 1 or self.newest is None:
            yield self.path, self.n, float(self.n) if self.n <= 1 else None
            return
        span = max((self.newest - self.oldest) / 86400.0, 1.0)
        yield self.path, self.n, min(100.0, 600.0 * self.n / span) * math.exp(-self.lam * (self.as_of - self.newest) / 86400.0)


class DlpFindings:
    """doc_id, rule, start, end, match of texts (doc_id, text): security.dlp_findings with the default rules."""

    def __init__(self) -> None:
        self.rules = [(name, re.compile(pattern, re.ASCII)) for name, pattern in RULES]
        self.whitelist = [re.compile(pattern, re.ASCII) for pattern in WHITELIST]

    @staticmethod
    def analyze(docs: AnalyzeArgument, min_entropy: AnalyzeArgument = None) -> AnalyzeResult:
        given = _input(docs, "doc_id", "text")
        out = StructType().add("doc_id", given["doc_id"].dataType).add("rule", StringType()).add("start", LongType()).add("end", LongType()).add("match", StringType())
        return AnalyzeResult(out)

    def eval(self, doc: Row, min_entropy: float = 3.0) -> Iterator[tuple]:
        for name, pattern in self.rules:
            for m in pattern.finditer(doc["text"] or ""):
                if not any(w.search(m[0]) for w in self.whitelist) and self.random_enough(name, m[0], float(min_entropy)):
                    yield doc["doc_id"], name, *m.span(), m[0]

    @staticmethod
    def random_enough(rule: str, match: str, least: float) -> bool:
        _, mark, after = match.partition(next((c for c in match if c in "=:"), "\0"))
        value = after.lstrip(" \t\n\x0b\f\r").strip("\"'") if mark else ""
        value = value if len(value) >= 8 else match
        if "://" in match or rule == "generic_secret" or len(value) < 8:
            return True
        return math.log2(len(value)) - sum(n * math.log2(n) for n in Counter(value).values()) / len(value) >= least


def register_table_functions(spark: SparkSession) -> None:
    """fuse_ranked(TABLE, k, most), file_hotspots(TABLE, as_of, lam) and dlp_findings(TABLE, min_entropy) for this session's SQL."""
    from pyspark.sql.functions import udtf

    for name, handler in (("fuse_ranked", FuseRanked), ("file_hotspots", FileHotspots), ("dlp_findings", DlpFindings)):
        spark.udtf.register(name, udtf(handler))
