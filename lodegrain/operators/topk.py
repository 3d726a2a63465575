"""Ranked selections shared by the operators: every order ends in a unique key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.snapshots import saved


def top_k_per(df: DataFrame, keys: list[str], order: list[Column], k: int | None, rank: str | None = None) -> DataFrame:
    """The first k rows of each key (all if k is None); `rank` names a column for the place, from 1. Spark drops rows
    beyond k before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = df.withColumn("__place", place)
    rows = rows if k is None else rows.where(F.col("__place") <= k)
    return rows.withColumnRenamed("__place", rank) if rank else rows.drop("__place")


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: both sides are shuffled and merged. Spark takes a saved table for as large as its
    compressed files, and would gather one of 100 MB and more in the driver for a broadcast."""
    return df.hint("merge")


def last_n(df: DataFrame, keys: list[str], order: list[str], n: int | None) -> DataFrame:
    """The newest n rows of each key; None keeps all."""
    return top_k_per(df, keys, [F.col(c).desc() for c in order], n)


def recent(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The newest n rows of the table."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def dedupe_best(hits: DataFrame, keys: list[str], score: str = "score", ties: tuple[str, ...] = ()) -> DataFrame:
    """The best-scored row of each key."""
    return top_k_per(hits, keys, [F.col(score).desc_nulls_last(), *ties], 1)


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """Ranks from 1 in ascending order, the mean of their places for ties. Without keys the distinct values are ranked by running
    counts of sorted parts, so no task sees all rows."""
    if keys:
        ties = Window.partitionBy(*keys, value)
        below = F.rank().over(Window.partitionBy(*keys).orderBy(value))
        return df.withColumn(name, below + (F.count("*").over(ties) - 1) / F.lit(2.0))
    counts = df.groupBy(F.col(value).alias("__value")).agg(F.count("*").alias("__n"))
    ranks = running_sum(counts, "__value", "__n", "__before").select("__value", (F.col("__before") + (F.col("__n") + 1) / F.lit(2.0)).alias(name))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("__value"))).drop("__value")


def min_max_normalise(df: DataFrame, keys: list[str], score: str = "score", name: str = "norm") -> DataFrame:
    """(x - min) / max(range, 0.001) per key."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(name, (F.col(score) - low) / F.greatest(high - low, F.lit(0.001)))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """Add `name`, each row's number from 0 in the order of a unique key."""
    return running_sum(df, key, None, name)


def running_sum(df: DataFrame, key: str, value: str | None, name: str) -> DataFrame:
    """Add `name`, the sum of `value` (None: 1) over the rows before each in the order of a unique key: sorted parts are saved with the
    places in them, and one row a part tells what lies before it."""
    rows = saved(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn("__part", F.shiftright("__at", 33))
    amount = F.lit(1) if value is None else F.col(value)
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__part").agg(F.sum(amount).alias("n")).select("__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before_part"))
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) if value is None else F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__within", within).join(starts, "__part").withColumn(name, F.col("__before_part") + F.col("__within")).drop("__part", "__at", "__before_part", "__within")
