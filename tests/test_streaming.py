"""Streams over the supplied events end with the rows of the batch."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from lodegrain.operators import telemetry as T
from lodegrain.plans.catalog import Views
from lodegrain.plans.fixtures import activity, spans
from lodegrain.streaming import jobs as J


@pytest.fixture(scope="module")
def events(spark, data):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    return lambda: spark.readStream.schema(schema).parquet(f"{data}/events.parq*")


class Stream(Views):
    def __init__(self, spark, events):
        self.spark, self._events = spark, events

    @property
    def events(self):
        return self._events()


def result(stream, mode, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_span_metrics(spark, data, events, tmp_path):
    got = result(J.stream_span_metrics(spans(Stream(spark, events)), "1000 days"), "complete", tmp_path, "metrics")
    total = {r[0]: (r[1], round(r[2], 6)) for r in got.groupBy("location").agg(F.sum("n"), F.sum("total_ms")).collect()}
    batch = {r["location"]: (r["n"], round(r["total_ms"], 6)) for r in T.span_metrics(spans(Views(spark, data))).collect()}
    assert total == batch


def test_decayed_counters(spark, data, events, tmp_path):
    got = result(J.stream_decayed_counters(activity(Stream(spark, events)).select("kind", "subject", "epoch"), 86400), "update", tmp_path, "decayed")
    rows = activity(Views(spark, data)).select("kind", "subject", "epoch").collect()
    last = {}
    for r in got.collect():
        if r["n"] > last.get((r["kind"], r["subject"]), (0,))[0]:
            last[r["kind"], r["subject"]] = (r["n"], r["score"], r["epoch"])
    for (kind, subject), (n, score, epoch) in last.items():
        own = [r["epoch"] for r in rows if (r["kind"], r["subject"]) == (kind, subject)]
        assert n == len(own) and epoch == max(own)
        assert score == pytest.approx(sum(math.exp(-math.log(2) / 86400 * (epoch - e)) for e in own))


def test_causal_links_and_dedupe(spark, data, events, tmp_path):
    stream = activity(Stream(spark, events)).withColumn("ts", F.timestamp_seconds("epoch"))
    got = result(J.stream_causal_links(stream, 36000, "1000 days"), "append", tmp_path, "links")
    batch = activity(Views(spark, data))
    e, c = batch.where("kind = 'diagnostic'").alias("e"), batch.where("kind = 'file_change'").alias("c")
    want = e.join(c, F.expr("e.session = c.session AND c.epoch BETWEEN e.epoch - 36000 AND e.epoch"))
    assert got.count() == want.count() > 0
    once = result(J.dedupe_events(stream, ["kind"], "1000 days"), "append", tmp_path, "once")
    assert once.count() == batch.select("kind").distinct().count()


def test_burst_coalesce(spark):
    rows = spark.createDataFrame([("a", float(t)) for t in (0, 1, 1.5, 3, 4, 10, 20)], "key string, epoch double")
    got = sorted((r["start"], r["n"]) for r in J.burst_coalesce(rows).collect())
    assert got == [(0.0, 3), (3.0, 2), (10.0, 1), (20.0, 1)]


