"""What the operators of this package share: saved intermediate tables, seeded hashes, white space, prefix sums."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.snapshots import replaced, saved, shared_path

__all__ = ["SPACES", "WORD", "arrow_batches", "few", "placed", "replaced", "saved", "seeded_hash", "shared_path", "shipped", "small_batches",
           "text_or_empty", "text_key", "without_spaces", "word_count"]

#: The six ASCII white-space characters, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def shipped(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python once a session, so that tasks can import it on any cluster."""
    context, root = spark.sparkContext, Path(__file__).resolve().parents[2]
    if not getattr(context, "_lodegrain_shipped", False):
        archive = Path(tempfile.mkdtemp()) / "lodegrain.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for module in sorted((root / "lodegrain").rglob("*.py")):
                z.write(module, module.relative_to(root))
        context.addPyFile(str(archive))
        context._lodegrain_shipped = True
    return spark


@contextmanager
def arrow_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Inside, tables that are saved hand Python batches of about this size instead of 10,000 rows of any length."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def few(df: DataFrame, most_broadcast: int) -> DataFrame:
    """A saved table, marked for broadcast if it has at most `most_broadcast` rows; beyond that Spark shuffles."""
    return F.broadcast(df) if df.count() <= most_broadcast else df


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of a column: what a task needs beside them grows with it."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
        low = 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most)))
            yield batch.slice(low, high - low)
            low = high


def text_or_empty(column: Column | str) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def text_key(column: Column | str) -> Column:
    """128 bits that stand for a text in joins; a null counts as empty."""
    return F.md5(text_or_empty(column).cast("binary"))


def without_spaces(column: Column) -> Column:
    for character in SPACES:
        column = F.replace(column, F.lit(character), F.lit(""))
    return column


def word_count(column: Column | str) -> Column:
    """Number of words; 0 for a null."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_hash(seed: int, *columns: Column | str) -> Column:
    """A 63-bit hash, never negative."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 1)


def placed(df: DataFrame, order: list[str], value: str | None = None, rows_per_part: int = 200_000, also: str | None = None) -> DataFrame:
    """Add `place`, each row's place from 0 in the order given, `sum_before`, the sum of `value` over earlier rows, and
    `also_before`, that of `also`.

    A distributed sort, saved with each row's place in its partition; then one row per partition tells what lies before
    it. End `order` with a unique column: rows of one key then spread over partitions.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_part))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = saved(rows.withColumn("place", F.monotonically_increasing_id()), "placed")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.withColumn("part", part).withColumn("within", within)
    values = {"sum": value, "also": also} if also else {"sum": value} if value else {}
    sums = [F.count("*").alias("rows_in")] + [F.sum(v).alias(f"{k}_in") for k, v in values.items()]
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(*sums)
    starts = starts.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("long").alias(f"{c}_before")
                                     for c in starts.columns[1:]])
    starts = saved(starts, "starts")
    upto = Window.partitionBy("part").orderBy("within").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"{k}_before": F.coalesce(F.sum(v).over(upto), F.lit(0)) for k, v in values.items()})
    rows = rows.join(starts, "part").withColumn("place", F.col("rows_in_before") + F.col("within"))
    rows = rows.withColumns({f"{k}_before": (F.col(f"{k}_in_before") + F.col(f"{k}_before")).cast("long") for k in values})
    return rows.drop("part", "within", *starts.columns[1:])
