"""Packing documents into sequences of a fixed length as a cutting-stock problem, solved by column generation.

Documents longer than a sequence are cut into full sequences and a rest, so what is packed are pieces of 1 to `capacity`
tokens. Their lengths, rounded up to classes of `step` tokens, make a histogram of at most capacity / step counts: all
that the driver sees of the corpus, whatever its size. A linear program over cutting patterns (how many pieces of each
class share a sequence) minimises the number of sequences; its columns are priced by a knapsack dynamic program over the
classes until no pattern is worth more than one sequence. Rounding the solution down leaves a few pieces of each class,
bounded by the number of classes and not by the corpus; they are packed first-fit-decreasing.

Patterns are then assigned to ranked pieces: the r-th piece of a class belongs to the pattern and copy whose range of
ranks holds r. Ranks come from counts per (partition, class) of the saved pieces, so a class with a third of all pieces
is still ranked in parallel. No text or token moves: only (doc_id, start, length) rows shuffle.

Defined cases: a null text is empty and gives the end id alone; a null doc_id is a value like any other; repeated rows
are packed each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, shipped, small_batches, text_or_empty
from .tokens import encoder


def cut_pieces(
    docs: DataFrame, tokenizer_path: str, layout: str, end_id: int, capacity: int = 1024, text: str = "text", with_ids: bool = False
) -> DataFrame:
    """Pieces of at most `capacity` ids: doc_id, start, length, ids_crc32, doc_tokens and, if asked for, ids (4 bytes each)."""
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64()}
    kinds |= {"ids": pa.binary()} if with_ids else {}
    shipped(docs.sparkSession)
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, layout).ids
        for batch in small_batches(batches, "text"):
            out = []
            for doc_id, t in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = encode(t.as_py()) + end
                for at in range(0, len(ids), width):
                    piece = ids[at : at + width]
                    out.append((doc_id, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece)[: len(kinds)])
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds.values())), names=list(kinds))

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select("doc_id", text_or_empty(text).alias("text")).mapInArrow(cut, schema)


def best_pattern(values: np.ndarray, most: np.ndarray, classes: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest value: classes of size 1 to `classes` in a capacity of `classes`, by dynamic programming.

    gain[c] is the best value within capacity c; choice[c] the class added last (0: none, the space is left over).
    """
    gain, choice = np.zeros(classes + 1), np.zeros(classes + 1, dtype=int)
    for c in range(1, classes + 1):
        # class s on top of capacity c - s, for s = 1 .. c
        worth = values[:c] + gain[c - 1 :: -1][:c]
        s = int(worth.argmax())
        gain[c], choice[c] = gain[c - 1], 0
        if worth[s] > gain[c] + 1e-12:
            gain[c], choice[c] = worth[s], s + 1
    pattern, c = np.zeros(classes, dtype=int), classes
    while c > 0:
        if choice[c]:
            pattern[choice[c] - 1] += 1
            c -= choice[c]
        else:
            c -= 1
    return float(gain[classes]), pattern


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots; at most a few hundred rows, so no threaded linear algebra is woken for it."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for i in range(n):
        p = i + int(np.abs(both[i:, i]).argmax())
        both[[i, p]] = both[[p, i]]
        both[i] /= both[i, i]
        others = both[:, i].copy()
        others[i] = 0
        both -= np.outer(others, both[i])
    return both[:, n:]


def cutting_patterns(counts: np.ndarray, gap: float = 1e-3, rounds: int = 3_000) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) whose pieces are exactly `counts`; counts[s - 1] pieces of class s, capacity len(counts).

    Revised simplex: the basis starts with one class a pattern, a priced pattern enters, the ratio test names the one
    that leaves. Stops within `gap` of the bound that the prices give (their value divided by the best pattern's). Counts
    are raised by a seeded fraction of a thousandth while solving, for equal ratios would let the simplex go in circles.
    """
    classes = len(counts)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return []
    demand = (counts[rows] + 1.0) * (1 + 1e-3 * np.random.default_rng(0).random(len(rows)))
    patterns = np.zeros((len(rows), classes), dtype=int)
    patterns[np.arange(len(rows)), rows] = classes // (rows + 1)
    inverse = np.diag(1.0 / patterns[np.arange(len(rows)), rows])
    amount = inverse @ demand
    for turn in range(rounds):
        price = np.zeros(classes)
        price[rows] = inverse.sum(axis=0)  # each pattern costs one sequence
        value, pattern = best_pattern(np.where(counts > 0, price, -1.0), counts, classes)
        if value <= 1 + 1e-9 or amount.sum() <= price[rows] @ demand / value * (1 + gap):
            break
        column = inverse @ pattern[rows]
        up = column > 1e-9
        ratio = np.where(up, amount / np.where(up, column, 1), np.inf)
        leaves = int(ratio.argmin())
        patterns[leaves] = pattern
        pivot = inverse[leaves] / column[leaves]
        inverse -= np.outer(column, pivot)
        inverse[leaves] = pivot
        if turn % 200 == 199:  # rounding errors add up
            inverse = inverted(patterns[:, rows].T.astype(float))
        amount = np.maximum(inverse @ demand, 0)
    amount = np.maximum(inverse @ counts[rows], 0)
    left = counts.copy()
    used = []
    for p in np.argsort(-amount):
        inside = patterns[p] > 0
        times = int(min(np.floor(amount[p] + 1e-6), (left[inside] // patterns[p][inside]).min()))
        if times > 0:
            used.append((patterns[p].copy(), times))
            left -= times * patterns[p]
    # first fit, the largest class first; each turn fills one pattern and repeats it while the pieces last
    while left.any():
        pattern, room = np.zeros(classes, dtype=int), classes
        for s in np.flatnonzero(left)[::-1] + 1:
            fit = min(int(left[s - 1]), room // s)
            pattern[s - 1], room = fit, room - fit * s
        inside = pattern > 0
        times = int((left[inside] // pattern[inside]).min())
        used.append((pattern, times))
        left -= times * pattern
    return used


def pattern_rows(patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, ranks after the last, pieces a copy, first sequence, slots before in the pattern)."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        slots = 0
        for s in (np.flatnonzero(pattern) + 1).tolist():
            n, low = int(pattern[s - 1]), taken.get(s, 0)
            rows.append((s, low, low + n * times, n, sequence, slots))
            taken[s], slots = low + n * times, slots + n
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = 1024, step: int = 8) -> DataFrame:
    """Add sequence_id and offset (gapless from 0 in its sequence) to rows with a column length."""
    spark = pieces.sparkSession
    rows = saved(pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    rows = rows.withColumn("class", F.ceil(F.col("length") / step).cast("int")).withColumn("part", F.shiftright("rid", 33))
    counted = saved(rows.groupBy("part", "class").agg(F.count("*").alias("n")), "counts")
    classes = -(-capacity // step)
    counts = np.zeros(classes, dtype=np.int64)
    for r in counted.groupBy("class").agg(F.sum("n").alias("n")).collect():  # at most capacity / step rows
        counts[r["class"] - 1] = r["n"]
    ranges = pattern_rows(cutting_patterns(counts))
    if not ranges:
        return rows.drop("rid", "class", "part").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    # bounded by the classes: a pattern a class and a few for what rounding leaves
    table = spark.createDataFrame(ranges, "c int, low long, high long, each long, first_sequence long, first_slot long")

    earlier = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("ranks_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    rows = rows.withColumn("local", F.row_number().over(Window.partitionBy("part", "class").orderBy("rid")) - 1)
    rows = rows.join(counted, ["part", "class"]).withColumn("rank", F.col("ranks_before") + F.col("local"))
    here = (F.col("class") == F.col("c")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    rows = rows.join(F.broadcast(table), here)
    rows = rows.withColumn("sequence_id", F.col("first_sequence") + F.expr("(rank - low) div each"))
    rows = rows.withColumn("slot", F.col("first_slot") + F.expr("(rank - low) % each"))
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long"))
    return rows.select(*pieces.columns, "sequence_id", "offset")
