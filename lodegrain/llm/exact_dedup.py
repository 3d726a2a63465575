"""Exact deduplication with a two-pass Bloom filter, in DataFrame functions only.

Pass 1 hashes each normalised text to a slot of a bitmap and marks the slots that two or more rows hit. Pass 2 tests
each row against the marks: a row whose slot is unmarked can have no copy and passes straight through; only the others
shuffle, pre-aggregated before they move, so a group of any size costs one row a task.

The bitmap has a fixed upper size (`max_bits`) and is broadcast for that reason. Both operators decide on light rows (ids,
hashes, sizes), which take more rows than one bitmap serves in ranges of the hash, each with a bitmap of its own. `keep_first`,
which carries the rows, then marks those of the texts that do repeat with one bitmap more. Results never change, because
marked rows are compared by SHA-256.

Defined cases: a null text is an empty text, and all empty texts are one group; a null doc_id loses every tie and is
kept only if no copy has an id; rows repeated whole are copies of each other and exactly one stays; an empty table gives
an empty result; texts of any length count whole, and other columns, whatever their names, pass through `keep_first` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, replaced, saved, text_key, text_or_empty, without_spaces

#: Bits that Spark's bitmap functions keep in one binary value.
BITMAP_BITS = 32768


def text_hash(text: Column) -> Column:
    """SHA-256 of the text without white space, as lower-case hex."""
    return F.sha2(without_spaces(text_or_empty(text)).cast("binary"), 256)


def filter_bits(rows: int, bits_per_row: int = 16, max_bits: int = 1 << 30) -> int:
    """Slots of the filter: a power of two, at least one bitmap, at most max_bits (128 MB)."""
    return min(max_bits, max(BITMAP_BITS, 1 << max(1, rows * bits_per_row - 1).bit_length()))


def repeated_slots(hashes: DataFrame, bits: int) -> DataFrame:
    """Pass 1: bitmaps (part, marks) of the slots that at least two rows hit; hashes has a column sha."""
    slots = hashes.select(F.pmod(F.xxhash64("sha"), F.lit(bits)).alias("slot")).groupBy("slot").count()
    return bitmaps(slots.where("count > 1"))


def bitmaps(slots: DataFrame) -> DataFrame:
    """The slots as bitmaps (part, marks)."""
    part = F.floor(F.col("slot") / BITMAP_BITS).alias("part")
    return slots.groupBy(part).agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(BITMAP_BITS))).alias("marks"))


def marked(df: DataFrame, marks: DataFrame, bits: int) -> DataFrame:
    """Pass 2: add `maybe`, false where no copy can exist. marks holds bits / 8 bytes at most, hence the broadcast."""
    slotted = df.withColumn("slot", F.pmod(F.xxhash64("sha"), F.lit(bits)))
    joined = slotted.withColumn("part", F.floor(F.col("slot") / BITMAP_BITS)).join(F.broadcast(marks), "part", "left")
    byte = f"cast(conv(hex(substring(marks, cast(pmod(slot, {BITMAP_BITS}) div 8 as int) + 1, 1)), 16, 10) as int)"
    bit = F.expr(f"shiftright({byte}, cast(pmod(slot, 8) as int)) & 1 = 1")
    return joined.withColumn("maybe", F.coalesce(bit, F.lit(False))).drop("part", "slot", "marks")


def tested(rows: DataFrame, bits_per_row: int, max_bits: int) -> DataFrame:
    """Both passes over saved rows with a column sha, in as many ranges of the hash as bitmaps of max_bits are needed."""
    n = rows.count()
    ranges, out = max(1, -(-n * bits_per_row // max_bits)), None
    bits = filter_bits(-(-n // ranges), bits_per_row, max_bits)
    for r in range(ranges):
        own = rows if ranges == 1 else rows.where(F.pmod(F.xxhash64(F.lit(ranges), "sha"), F.lit(ranges)) == r)
        own = marked(own, saved(repeated_slots(own, bits), "marks"), bits)
        out = own if out is None else out.unionByName(own)
    return out


def _preference() -> Column:
    """The least of a group stays: most code points, then smallest doc_id, a null id last."""
    return F.struct((-F.col("chars")).alias("minus_chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id")


def exact_duplicates(docs: DataFrame, text: str = "text", bits_per_row: int = 16, max_bits: int = 1 << 30) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The texts are read once; what is kept of them is saved, and both passes read that.
    """
    rows = saved(
        docs.select("doc_id", text_hash(F.col(text)).alias("sha"), F.char_length(text_or_empty(text)).alias("chars"),
                    F.monotonically_increasing_id().alias("rid")),
        "hashes",
    )
    rows = tested(rows, bits_per_row, max_bits)
    straight = rows.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    suspects = rows.where("maybe").drop("maybe")
    groups = suspects.groupBy("sha").agg(
        F.min(F.struct(_preference().alias("by"), "rid")).alias("best"), F.count("*").alias("group_size")
    )
    compared = suspects.join(groups, "sha").select(
        "doc_id", F.col("best.by.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
    return straight.unionByName(compared)


def repeated_texts(docs: DataFrame, text: str, bits_per_row: int, max_bits: int) -> DataFrame:
    """A row per group of equal texts of two rows and more, saved: sha, keep_id and keep_th (a key of the whole text) of the row that
    stays, and again, whether that very row occurs more than once. Decided on ids, hashes and sizes; no text moves."""
    rows = saved(docs.select("doc_id", text_hash(F.col(text)).alias("sha"), F.char_length(text_or_empty(text)).alias("chars"), text_key(text).alias("th")), "hashes")
    keys = tested(rows, bits_per_row, max_bits).where("maybe").groupBy("sha", "doc_id", "chars", "th").agg(F.count("*").alias("n"))
    groups = keys.groupBy("sha").agg(F.min(F.struct(_preference().alias("by"), "th", "n")).alias("best"), F.sum("n").alias("size")).where("size > 1")
    groups = saved(groups.select("sha", F.col("best.by.doc_id").alias("keep_id"), F.col("best.th").alias("keep_th"), (F.col("best.n") > 1).alias("again")), "groups")
    replaced(rows)
    return groups


def keep_first(docs: DataFrame, text: str = "text", bits_per_row: int = 16, max_bits: int = 1 << 30, most_broadcast: int = 200_000) -> DataFrame:
    """The documents that stay, all columns. Which texts repeat is decided on light rows; a bitmap of these texts' hashes alone then
    lets all other rows straight through, and only rows it marks meet the groups by hash: at 16 bits a group a sixteenth of the
    others, and more only beyond max_bits / 16 groups of copies, not rows. Few groups are broadcast, and then nothing shuffles but rows
    that are repeated whole."""
    groups = repeated_texts(docs, text, bits_per_row, max_bits)
    bits = filter_bits(groups.count(), bits_per_row, max_bits)
    slots = groups.select(F.pmod(F.xxhash64("sha"), F.lit(bits)).alias("slot"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), text_hash(F.col(text)).alias("sha"), text_key(text).alias("th"))
    rows = marked(rows, saved(bitmaps(slots), "marks"), bits)
    judged = rows.where("maybe").join(few(groups, most_broadcast), "sha", "left")
    stays = judged.where(F.col("keep_th").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("th") == F.col("keep_th"))))
    again = F.coalesce("again", F.lit(False))
    once = stays.where(again).groupBy("sha").agg(F.first("row").alias("row"))
    return rows.where("not maybe").select("row.*").unionByName(stays.where(~again).select("row.*")).unionByName(once.select("row.*"))
