"""Mixing sources to target weights by capped water-filling.

Each source gets a share of the words wanted by its weight; a share above `max_epochs` times the source's words is
clamped there and the excess goes to the others by weight, until none is above. A source's target is then taken as whole
repetitions of every document plus a fraction of one more: documents in the order of a seeded hash until the words are
met; the document at the cut gives only its first words.

What decides is one small row per source (its target, whole repetitions, and the hash at the cut), so applying the mix is
a join on the source without moving a text. Sources are filled by aggregates over the table of sources: the driver sees
three sums a round. A source's hash order is a distributed sort, so a hot source is spread over tasks.

Defined cases: a null source is a source, ranked last; a null text has no words; sources without words have target 0;
an empty table gives an empty result; rows repeated whole at the cut are cut alike, so they may exceed the target by
their own words; a null doc_id is hashed like any value. If the words wanted exceed what max_epochs allows, every source
is taken max_epochs times. Other columns pass through `mixed_documents` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, placed, saved, seeded_hash, text_or_empty, word_count


def sized(docs: DataFrame, source: str, text: str, seed: int) -> DataFrame:
    return docs.select("doc_id", F.col(source).alias("source"), word_count(text).alias("size"),
                       seeded_hash(seed, "doc_id").alias("h"))


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Add `weight`: the weights in turn to the sources by code point, null last."""
    rows = placed(sources.withColumn("none", F.col("source").isNull()), ["none", "source"]).drop("none")
    table = F.array(*[F.lit(float(w)) for w in weights])
    return rows.withColumn("weight", F.get(table, F.pmod("place", F.lit(len(weights))).cast("int"))).drop("place")


def water_fill(sources: DataFrame, wanted: float, max_epochs: float) -> DataFrame:
    """Add `target` to rows (source, source_size, weight): min(cap, level * weight) with the level that meets `wanted`.

    The level only rises from round to round and each round clamps one more source at least, so it ends.
    """
    cap, clamped, level = F.col("source_size") * F.lit(float(max_epochs)), -1, 0.0
    while True:
        full = cap < F.lit(level) * F.col("weight")
        got = sources.agg(F.count_if(full).alias("n"), F.sum(F.when(full, cap)).alias("caps"),
                          F.sum(F.when(~full, F.col("weight"))).alias("weights")).first()
        if got["n"] == clamped:
            break
        if not got["weights"]:
            return sources.withColumn("target", cap)
        clamped, level = got["n"], max(0.0, (wanted - (got["caps"] or 0.0)) / got["weights"])
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def mix_plan(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2) -> DataFrame:
    """One row per source: source, source_size, weight, target, whole, cut_hash, cut_id, cut_words; from rows of `sized`.

    Of one more repetition a source gives the documents before (cut_hash, cut_id) and cut_words words of that document.
    """
    rows = placed(sizes.withColumn("rid", F.monotonically_increasing_id()), ["source", "h", "doc_id", "rid"], "size")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("sum_before").alias("first"))
    sources = saved(cyclic_weights(sources, weights), "sources")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    size, target = F.col("source_size"), F.col("target")
    whole = F.when(size > 0, F.floor(target / size + F.lit(1e-12))).otherwise(0).cast("long")
    filled = water_fill(sources, share * words, max_epochs).withColumn("whole", whole)
    rest = F.greatest(F.round(target).cast("long") - F.col("whole") * size, F.lit(0))
    filled = saved(filled.withColumn("rest", rest), "targets")
    at = filled.select(F.col("source").alias("s"), "first", "rest").where("rest > 0")
    left = F.col("rest") - F.col("sum_before") + F.col("first")
    cut = rows.join(at, rows["source"].eqNullSafe(at["s"])).where((left > 0) & (left <= F.col("size")))
    cut = cut.select("s", F.col("h").alias("cut_hash"), F.col("doc_id").alias("cut_id"), left.alias("cut_words"))
    return saved(filled.join(cut, filled["source"].eqNullSafe(cut["s"]), "left").drop("s", "rest", "first"), "plan")


def mixed(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target, whole, extra (words of the fraction) and taken to rows (doc_id, source, size, h, ...)."""
    plan = plan.select(F.col("source").alias("s"), "source_size", "target", "whole", "cut_hash", "cut_id", "cut_words")
    rows = sizes.join(plan, sizes["source"].eqNullSafe(plan["s"]))
    at = F.struct(F.col("h").alias("h"), F.col("doc_id").alias("id"))
    cut = F.struct(F.col("cut_hash").alias("h"), F.col("cut_id").alias("id"))
    extra = F.when(F.col("cut_hash").isNull() | (at > cut), 0).when(at < cut, F.col("size")).otherwise(F.col("cut_words"))
    rows = rows.withColumn("extra", F.least(extra.cast("long"), F.col("size")))
    return rows.withColumn("taken", F.col("whole") * F.col("size") + F.col("extra")).drop("s", "cut_hash", "cut_id", "cut_words")


def mix(docs: DataFrame, source: str = "source", text: str = "text", seed: int = 42, **how) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, whole, extra, taken."""
    sizes = saved(sized(docs, source, text, seed), "sizes")
    return mixed(sizes, mix_plan(sizes, **how)).drop("h")


def mixed_documents(docs: DataFrame, source: str = "source", text: str = "text", seed: int = 42, **how) -> DataFrame:
    """The mixture itself, with the columns of docs: each document as often as it is taken, its last copy cut to `extra`
    words if those are not all; a document without words comes as often as its source is taken whole."""
    plan = mix_plan(saved(sized(docs, source, text, seed), "sizes"), **how)
    rows = mixed(docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col(source).alias("source"),
                             word_count(text).alias("size"), seeded_hash(seed, "doc_id").alias("h")), plan)
    part = F.when(F.col("extra") > 0, F.array("extra")).otherwise(F.array().cast("array<bigint>"))
    copies = F.concat(F.array_repeat("size", F.col("whole").cast("int")), part)
    rows = rows.select("row", "size", F.explode(copies).alias("words"))
    words = F.regexp_extract_all(text_or_empty(F.col("row").getField(text)), F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    first = F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), "")
    whole_text = F.col("words") == F.col("size")
    rows = rows.withColumn("row", F.col("row").withField(text, F.when(whole_text, F.col("row").getField(text)).otherwise(first)))
    return rows.select("row.*")
