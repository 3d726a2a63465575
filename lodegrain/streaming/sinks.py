"""What a micro-batch is handed to: upserts of a bucketed snapshot, handlers that emit events, spans and their bad lines, redacted texts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.security import dlp_findings, redact
from ..operators.telemetry import load_spans
from ..sources.snapshots import replaced, saved

Batch = Callable[[DataFrame, int], None]

#: Lines of spans as JSON: ids are base64, times nanoseconds.
_ATTRIBUTES = "attributes: array<struct<key: string, value: string>>"
SPAN_LINE = (f"resource_spans array<struct<{_ATTRIBUTES}, scope_spans: array<struct<spans: array<struct<trace_id: binary, span_id: binary, name: string, "
             f"start_ns: bigint, end_ns: bigint, {_ATTRIBUTES}>>>>>>")


class Snapshot:
    """A table in hash buckets of its keys under one folder. A version is a manifest: the schema, and for each bucket the folder that
    holds it. Writing a version costs what it changes: only the buckets it touches are read and written anew, all others keep
    their folder. A manifest is written beside its place and renamed to it, which is atomic, so a version is there whole or not."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at = self._at(f"{self.path}/manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).first()[0])

    def commit(self, version: int, manifest: dict) -> None:
        beside, place = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}"), self._at(f"{self.path}/manifests/{version}.json")
        stream = self._fs.create(beside, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not self._fs.rename(beside, place):
            raise RuntimeError(f"version {version} of {self.path} is there already")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named."""
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"{self.path} holds no version")
        manifest = self.manifest(found[-1] if version is None else version)
        return self.rows(manifest, list(manifest["buckets"]))

    def rows(self, manifest: dict, buckets: list[str]) -> DataFrame:
        paths = [f"{self.path}/{manifest['buckets'][b]}" for b in buckets if b in manifest["buckets"]]
        schema = StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 2) -> int:
        """Delete the manifests of all but the newest `keep` versions and the folders that none of these names; how many folders went."""
        found = self.versions()
        used = {p.split("/")[1] for v in found[-keep:] for p in self.manifest(v)["buckets"].values()}
        for v in found[:-keep]:
            self._fs.delete(self._at(f"{self.path}/manifests/{v}.json"), False)
        at = self._at(f"{self.path}/data")
        gone = [f.getPath() for f in (self._fs.listStatus(at) if self._fs.exists(at) else []) if f.getPath().getName() not in used]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)


def upsert_batch(path: str, keys: list[str], order: str, deleted: str, buckets: int = 64) -> Batch:
    """A foreachBatch function that keeps a Snapshot at path, a version per batch: the rows of a key's newest event (all that share
    the greatest `order`) replace all rows of the key, and a row with `deleted` removes them. A batch that runs again changes
    nothing. The version before a batch must be there, but for a target without any version: a lost one is an error. The number
    of buckets is that of the first version."""

    def run(batch: DataFrame, batch_id: int) -> None:
        snapshot = Snapshot(batch.sparkSession, path)
        found = snapshot.versions()
        if batch_id in found:
            return
        if found and max(found) != batch_id - 1:
            raise ValueError(f"{path}: batch {batch_id} needs version {batch_id - 1}, but the newest is {max(found)}")
        if not found and batch_id:
            raise FileNotFoundError(f"{path}: batch {batch_id} needs version {batch_id - 1}, and there is none")
        columns = [c for c in batch.columns if c != deleted]
        old = snapshot.manifest(batch_id - 1) if found else {"schema": json.loads(batch.select(*columns).schema.json()), "n": buckets, "buckets": {}}
        bucket = F.pmod(F.xxhash64(*keys), F.lit(old["n"]))
        newest = batch.groupBy(*keys).agg(F.max(order).alias("__newest"))
        rows = batch.join(newest, keys).where(F.col(order).eqNullSafe(F.col("__newest"))).drop("__newest").withColumn("__bucket", bucket)
        rows = saved(rows, "batch")
        touched = sorted(r[0] for r in rows.select("__bucket").distinct().toLocalIterator())  # `n` numbers at most
        entries, data = dict(old["buckets"]), f"data/{batch_id}-{uuid.uuid4().hex}"
        if touched:
            kept = snapshot.rows(old, [str(b) for b in touched]).join(rows.select(*keys).distinct(), keys, "left_anti").select(*columns)
            now = kept.unionByName(rows.where(~F.coalesce(deleted, F.lit(False))).select(*columns)).withColumn("__bucket", bucket)
            # a bucket with a hot key is written by several tasks
            now.hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{snapshot.path}/{data}")
            at = snapshot._at(f"{snapshot.path}/{data}")
            filled = {f.getPath().getName() for f in snapshot._fs.listStatus(at)}
            for b in touched:
                name = f"__bucket={b}"
                entries.pop(str(b), None)
                if name in filled:
                    entries[str(b)] = f"{data}/{name}"
        snapshot.commit(batch_id, old | {"buckets": entries})
        replaced(rows)

    return run


def handler_batch(handlers: list[Callable[[DataFrame], DataFrame | None]], handle: Batch, most_rounds: int = 16) -> Batch:
    """A foreachBatch function that gives `handle` the batch's events and all that follows from them, with `round` (0: as they came).
    Each handler, in the order given, sees the events of a round and returns those it emits, or None; what all emit is the next
    round, until none is new. A handler judges each event by itself, so the events do not depend on how a stream is cut into
    batches. More than most_rounds rounds raise: handlers that feed each other for ever would never end."""

    def run(batch: DataFrame, batch_id: int) -> None:
        current = saved(batch, "round")
        rounds = [current]
        while True:
            emitted = [e for h in handlers if (e := h(current)) is not None]
            if not emitted:
                break
            current = saved(reduce(DataFrame.unionByName, emitted).select(*batch.columns), "round")
            if current.isEmpty():
                break
            if len(rounds) > most_rounds:
                raise RuntimeError(f"handlers still emit events after {most_rounds} rounds")
            rounds.append(current)
        handle(reduce(DataFrame.unionByName, [r.withColumn("round", F.lit(i)) for i, r in enumerate(rounds)]), batch_id)
        for r in rounds:
            replaced(r)

    return run


def stream_spans(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Lines (value, file) of span files as they arrive in a folder, for span_batch."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).select("value", F.col("_metadata.file_path").alias("file"))


def parsed_spans(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, bad) of lines (value, file): the rows of load_spans, and the lines that are no JSON of resource spans; blank lines are
    neither."""
    rows = lines.where(~F.col("value").rlike(r"^\s*$"))
    rows = rows.withColumn("line", F.from_json("value", f"{SPAN_LINE}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    good = F.col("line.resource_spans").isNotNull() & F.col("line._bad").isNull()
    return load_spans(rows.where(good).select("line.resource_spans")), rows.where(~good).select("value", "file")


def span_batch(handle: Batch, bad_path: str) -> Batch:
    """A foreachBatch function for stream_spans: `handle` gets a batch's spans, and its bad lines are kept at bad_path/batch=<id>, which
    a batch that runs again writes anew."""

    def run(batch: DataFrame, batch_id: int) -> None:
        lines = saved(batch, "lines")
        spans, bad = parsed_spans(lines)
        bad.write.mode("overwrite").parquet(f"{bad_path}/batch={batch_id}")
        handle(spans, batch_id)
        replaced(lines)

    return run


def dlp_batch(handle: Callable[[DataFrame, DataFrame, int], None], **how) -> Batch:
    """A foreachBatch function that gives `handle` the findings of a batch of texts (doc_id, text) and its redacted copy."""

    def run(batch: DataFrame, batch_id: int) -> None:
        docs = saved(batch, "docs")
        findings = saved(dlp_findings(docs, **how), "findings")
        handle(findings, redact(docs, findings), batch_id)
        replaced(docs)
        replaced(findings)

    return run
