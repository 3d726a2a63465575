"""Proportional stratified interleaving into shards, in DataFrame functions only.

Rows of each source are shuffled by a seeded hash and ranked. A row's fractional rank is (rank + phase) / rows of the
source, with a seeded phase per source; rows sorted by it hold every source evenly spread, so any run of consecutive rows
has the mixture of the whole, and cutting the order into equal runs gives shards that match it. Law: `rows` (the counts
of two shards differ by one at most).

Both orders are distributed sorts with a unique last key, so a source with a third of all rows is spread over tasks, and
only sizes and hashes move, never a text.

Defined cases: a null source is a source; null text has size 16 and the CRC of no bytes; a null doc_id hashes like any
value; repeated rows are told apart by an id given when the sizes are saved; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import placed, saved, seeded_hash, text_or_empty


def interleaved_shards(docs: DataFrame, shards: int = 40, source: str = "source", text: str = "text", seed: int = 42) -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, shard, slot (gapless from 0 in its shard)."""
    utf8 = text_or_empty(text).cast("binary")
    rows = saved(
        docs.select("doc_id", F.col(source).alias("source"), (F.octet_length(utf8) + F.lit(16)).cast("long").alias("size"),
                    F.crc32(utf8).alias("text_crc32"), F.monotonically_increasing_id().alias("rid")),
        "sizes",
    )
    rows = placed(rows.withColumn("h", seeded_hash(seed, "doc_id")), ["source", "h", "rid"])
    sources = rows.groupBy("source").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    sources = saved(sources.withColumnRenamed("source", "s"), "sources")
    total = sources.agg(F.sum("n")).first()[0] or 1
    phase = seeded_hash(seed + 1, "source") / F.lit(float(1 << 63))
    rows = rows.join(sources, rows["source"].eqNullSafe(sources["s"]))
    rows = rows.withColumn("fraction", (F.col("place") - F.col("first") + phase) / F.col("n"))
    rows = placed(rows.select("doc_id", "source", "size", "text_crc32", "rid", "fraction"), ["fraction", "source", "rid"])
    # shard k holds the places from k * total div shards on
    shard = F.expr(f"({shards} * (place + 1) - 1) div {total}")
    return rows.withColumn("shard", shard.cast("int")).select(
        "doc_id", "source", "size", "text_crc32", "shard", F.expr(f"place - shard * {total} div {shards}").alias("slot"))
