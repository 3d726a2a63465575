"""Periodic runs of words: tiles per octave of periods, boundary Z-functions in each, fragments stitched by document and period.

A run is a stretch of words with smallest period q, at least max(least, times * q) long with times >= 4, that no neighbour
extends. For the octave of periods 2^k to 2^(k+1) - 1, with M = 2^(k+1), a document is cut at every M-th word. A run of such a
period q is at least 4 q >= 2 M long, so a cut c lies less than M words behind its start, and q words from c on are followed
by the same q words. The tile of a cut reaches 2 M words before it and 3 M after it. Two Z-functions of the tile, of the words
from the cut on and of the words before it backwards, tell for every period how far it holds in either direction; where
a fragment meets an end of its tile, the tiles beside it hold the rest, with more than a period in common.

Only tiles that can hold a run are exploded: fingerprints of 2^k words, doubled from octave to octave, say for all cuts at
once whether any period of the octave repeats the words at the cut. That gate misses nothing, and a wrong pass costs time only.

Fragments of one document and period meet in a shuffle (what a task finds side by side it joins first), overlapping ones
become one interval, and of equal intervals the smallest period stays: an interval of period p and at least 2 p words whose
smallest period is less has a divisor of p as its period, with the same ends. Texts move only for documents with fragments.

Defined cases: null text and text without words have no runs; a document shorter than the shortest run has none; texts of
any length are taken whole; repeated rows and a null doc_id are documents of their own; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, saved, shipped, small_batches, text_or_empty

#: Words before a cut that its tile holds, in M; after the cut it holds one M more.
REACH = 2


def z_function(s: list[int], upto: int) -> list[int]:
    """For each place i < upto, how many items from i on equal those from 0 on; 0 at place 0."""
    z, left, right, n = [0] * upto, 0, 0, len(s)
    for i in range(1, upto):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) | np.uint64(1)


def rows_of(marks: np.ndarray, rows: int, width: int) -> np.ndarray:
    """marks from 0 on in rows of this width; places beyond its end hold 0, which is no mark."""
    table = np.zeros(rows * width, np.uint64)
    table[: min(len(marks), len(table))] = marks[: len(table)]
    return table.reshape(rows, width)


def possible_cuts(ids: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, cuts) of each octave: the cuts where a period of the octave may repeat its first words; ids from 1.

    At a cut less than M words behind the start of a run of period p, 3 p - M + 1 words at least are repeated: more than 2^k
    for every p of the octave, more than 2^(k+1) for its upper half."""
    n, k, marks = len(ids), 0, ids.astype(np.uint64)
    while n >= max(least, 4 << k):
        m = 2 << k
        rows = (n - m) // m + 1
        doubled = mixed(marks[: -(1 << k)], marks[1 << k :])
        if k == 0:  # a run of period 1 and `least` words repeats the word at its cut least - 2 times
            own = rows_of(mixed(doubled[:-2], doubled[2:]) if least >= 6 else marks, rows, m)
            hit = own[:, 1] == own[:, 0]
        else:
            own, after, wide = rows_of(marks, rows, m), rows_of(marks[1:], rows, m), rows_of(doubled, rows, m)
            lower, upper = slice(m // 2, 3 * m // 4), slice(3 * m // 4, m)
            hit = ((own[:, lower] == own[:, :1]) & (after[:, lower] == after[:, :1])).any(axis=1) | (wide[:, upper] == wide[:, :1]).any(axis=1)
        if hit.any():
            yield k, np.flatnonzero(hit) * m
        marks, k = doubled, k + 1


def fragments(ids: list[int], cut: int, before: bool, after: bool, k: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of the periods of octave k that hold around the cut, within the tile; before and after tell whether
    the document goes on beyond the tile."""
    low, m = 1 << k, 2 << k
    tail = ids[cut:]
    forward = z_function(tail, min(m, len(tail)))
    periods = [p for p in range(low, len(forward)) if forward[p] >= p]
    if not periods:
        return
    head, width = ids[:cut][::-1], min(m, len(tail))
    backward = z_function([*head, 0, *tail[:width][::-1], *head], len(head) + 1 + width)
    for p in periods:
        start, end = cut - backward[len(head) + 1 + width - p], cut + p + forward[p]
        whole = (start > 0 or not before) and (end < len(ids) or not after)
        if not whole or end - start >= max(least, times * p):
            yield p, start, end


def explode_tiles(docs: DataFrame, text: str, least: int) -> DataFrame:
    """The tiles of a document (octave, cut, low, ids, n), then its own row (rid, doc_id, text if it has tiles, plain_sha256)."""
    columns = {"rid": pa.int64(), "doc_id": pa.int64(), "text": pa.string(), "plain_sha256": pa.string(), "octave": pa.int32(), "cut": pa.int64(),
               "low": pa.int64(), "n": pa.int64(), "ids": pa.binary()}

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            out = []
            for rid, doc_id, t in zip(batch["rid"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"]):
                t = t.as_py()
                words, own = t.encode().split(), {}
                at = len(out)
                ids = np.fromiter((own.setdefault(w, len(own) + 1) for w in words), np.int32, len(words))
                for k, cuts in possible_cuts(ids, least):
                    m = 2 << k
                    for cut in cuts.tolist():
                        low = max(0, cut - REACH * m)
                        out.append((rid, None, None, None, k, cut, low, len(ids), ids[low : cut + (REACH + 1) * m].tobytes()))
                has = len(out) > at
                out.append((rid, doc_id, t if has else None, hashlib.sha256(b" ".join(words)).hexdigest(), None, None, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), columns.values())], names=list(columns))

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(explode, "rid long, doc_id long, text string, plain_sha256 string, octave int, cut long, low long, n long, ids binary")


def solve_tiles(tiles: DataFrame, least: int, times: int) -> DataFrame:
    """Tiles become fragments (rid, period, start, end); rows of documents pass, with their text if they have fragments.
    Fragments of one period that overlap by a period and follow each other in a task are joined here, before they move."""
    columns = {"rid": pa.int64(), "doc_id": pa.int64(), "text": pa.string(), "plain_sha256": pa.string(), "period": pa.int64(), "start": pa.int64(), "end": pa.int64()}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*rows)) or [()] * 7, columns.values())], names=list(columns))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, tuple[int, int]] = {}
        of = has = None  # has: the last document with fragments
        for batch in batches:
            out = []
            for rid, doc_id, t, sha, octave, cut, low, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (rid, octave) != of:
                    out += [(of[0], None, None, None, p, *interval) for p, interval in opened.items()]
                    opened, of = {}, (rid, octave)
                if octave is None:
                    out.append((rid, doc_id, t if rid == has else None, sha, None, None, None))
                    continue
                words = np.frombuffer(ids, np.int32).tolist()
                for p, start, end in fragments(words, cut - low, low > 0, low + len(words) < n, octave, least, times):
                    start, end, has = start + low, end + low, rid
                    if p in opened:
                        if start <= opened[p][1] - p:
                            start, end = min(start, opened[p][0]), max(end, opened[p][1])
                        else:
                            out.append((rid, None, None, None, p, *opened[p]))
                    opened[p] = (start, end)
            yield batch_of(out)
        if opened:
            yield batch_of([(of[0], None, None, None, p, *interval) for p, interval in opened.items()])

    return tiles.mapInArrow(solve, "rid long, doc_id long, text string, plain_sha256 string, period long, start long, end long")


def stitched(found: DataFrame, least: int, times: int) -> DataFrame:
    """Runs (rid, start, end, period) from fragments (rid, period, start, end)."""
    by = Window.partitionBy("rid", "period").orderBy("start", "end")
    reached = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("new", F.coalesce(F.col("start") > reached - F.col("period"), F.lit(True)).cast("int"))
    rows = rows.withColumn("interval", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = rows.groupBy("rid", "period", "interval").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    whole = whole.where(F.col("end") - F.col("start") >= F.greatest(F.lit(least), times * F.col("period")))
    return whole.groupBy("rid", "start", "end").agg(F.min("period").alias("period"))


def periodic_runs(docs: DataFrame, text: str = "text", least: int = 6, times: int = 4) -> tuple[DataFrame, DataFrame]:
    """(documents, runs): rows (rid, doc_id, text, plain_sha256), the text only where a tile holds a fragment, and rows (rid,
    start, end, period) in word numbers, end exclusive. rid names a row of the first table."""
    if times < 4 or least < 1:
        raise ValueError("the tiles hold runs of four periods and more")
    shipped(docs.sparkSession)
    with arrow_batches(docs.sparkSession):
        rows = saved(solve_tiles(explode_tiles(docs, text, least), least, times), "tiles")
    documents = rows.where("plain_sha256 is not null").select("rid", "doc_id", "text", "plain_sha256")
    return documents, stitched(rows.where("period is not null").select("rid", "period", "start", "end"), least, times)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run (start, end, period) contains after its first period."""
    dropped = np.zeros(len(words) + 1, np.int32)
    for start, end, period in runs:
        dropped[start + period] += 1
        dropped[end] -= 1
    return [w for w, d in zip(words, np.cumsum(dropped[:-1]).tolist()) if not d]


def run_summary(docs: DataFrame, text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """One row per document: doc_id, n_runs, the longest run (start, length, period, exponent_milli), digests of all runs and
    of the words that are left when runs collapse to their first period."""
    documents, runs = periodic_runs(docs, text, least, times)
    by_document = saved(runs.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "period"))).alias("runs")), "runs")
    without = hashlib.sha256().hexdigest()
    columns = {"doc_id": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(),
               "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            out = []
            for doc_id, t, found in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["runs"].to_pylist()):
                own = [(r["start"], r["end"], r["period"]) for r in found]
                start, end, period = min(own, key=lambda r: (r[0] - r[1], r[0], r[2]))
                lines = "".join(f"{s},{e - s},{p}\n" for s, e, p in sorted(own, key=lambda r: (r[0], r[2])))
                rest = hashlib.sha256(b" ".join(collapsed(t.encode().split(), own))).hexdigest()
                out.append((doc_id, len(own), start, end - start, period, 1000 * (end - start) // period, hashlib.sha256(lines.encode()).hexdigest(), rest))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*out)) or [()] * 8, columns.values())], names=list(columns))

    # only documents with fragments can have runs: the others, most of all texts, do not enter the join
    tiled = documents.where("text is not null")
    with_runs = tiled.join(by_document, "rid").select("doc_id", "text", "runs").mapInArrow(
        summed, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
    plain = documents.select("rid", "doc_id", "plain_sha256", F.col("text").isNotNull().alias("tiled"))
    plain = plain.where("not tiled").unionByName(plain.where("tiled").join(by_document, "rid", "left_anti"))
    none = F.lit(None).cast("long")
    plain = plain.select("doc_id", F.lit(0).cast("long").alias("n_runs"), *[none.alias(c) for c in ("start", "length", "period", "exponent_milli")],
                         F.lit(without).alias("runs_sha256"), F.col("plain_sha256").alias("collapsed_sha256"))
    with arrow_batches(docs.sparkSession):
        return saved(with_runs.unionByName(plain), "summary")
