"""Chat formatting in budgeted windows of whole turns.

Turns of a conversation are laid on a line by the prefix sums of their tokens, counted by a tokenizer on the formatted turn.
What the budget leaves beside the conversation's system turn (its first, if its role is system) and the history is the
room for new turns. A turn of more than half of the room is a window of its own. The line is cut into cells of half of
the room, and the shorter turns that begin in one cell, with no such long turn between them, are a window: they
fit in the room. So every turn is new in exactly one window, windows hold whole turns only, and which window a turn is in
depends on prefix sums alone: a conversation of any length is windowed in parallel.

Before a window stand the turns that begin at most `history` tokens before its first new turn, where the new turns leave
room for them, and before these the system turn. A window passes its budget only where the system turn and one new turn do
so by themselves.

Template: `<s>[INST] role [/INST]text</s>` per turn. Inside roles and texts a backslash is doubled and one is put after
the first character of every control string, which can be undone and leaves no control string in the text. The loss mask
is spans (start, length) in code points: the texts of assistant turns that are new in the window.

Prefix sums need no task per conversation: turns are ranked by a distributed sort (see common.placed) whose running sum
is taken relative to the conversation's first row.

Defined cases: null text and null role are empty; a null turn comes first; a null conv_id is a conversation; rows with
one turn number follow by role, then text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, placed, saved, shipped, text_or_empty
from .tokens import encoder

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.S)
_UNDO = re.compile(r"\\(\\?)")


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return text


def unescaped(text: str) -> str:
    return _UNDO.sub(r"\1", text)


def with_tokens(rows: DataFrame, tokenizer_path: str, layout: str) -> DataFrame:
    """Add tokens: those of a formatted turn's head, text and end, each encoded alone."""
    rows = rows.withColumn("head", F.concat(F.lit("<s>[INST] "), escaped(F.col("role")), F.lit(" [/INST]"))).withColumn("body", escaped(F.col("text")))
    names = ["conv_id", "turn", "role", "text"]
    kinds = dict(rows.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(tokenizer_path, layout).ids
        end = len(of("</s>")) // 4
        for batch in batches:
            tokens = [len(of(h)) // 4 + len(of(t.as_py())) // 4 + end for h, t in zip(batch["head"].to_pylist(), batch["body"])]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(tokens, pa.int64())], names=[*names, "tokens"])

    return rows.mapInArrow(count, ", ".join(f"{n} {kinds[n]}" for n in names) + ", tokens long")


def with_room(rows: DataFrame, budget: int, history: int) -> DataFrame:
    """Add what the conversation's system turn leaves: system_tokens, most_history and room, and long (1 for turns that are
    windows of their own)."""
    first = rows.groupBy("conv_id").agg(F.min_by(F.struct("role", "tokens"), F.struct("turn", "role", "text", "rid")).alias("first"))
    system = F.when(F.col("first.role") == "system", F.col("first.tokens")).otherwise(F.lit(0))
    left = F.greatest(F.lit(budget) - F.col("system_tokens"), F.lit(0))
    first = first.select(F.col("conv_id").alias("c"), system.alias("system_tokens"))
    first = first.withColumn("most_history", F.least(F.lit(history), F.floor(left / 4))).withColumn("room", F.greatest(left - F.col("most_history"), F.lit(4)))
    rows = rows.join(saved(first, "rooms"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return rows.withColumn("long", (F.col("tokens") > F.floor(F.col("room") / 2)).cast("long"))


def chat_windows(conversations: DataFrame, tokenizer_path: str, layout: str = "joined", budget: int = 512, history: int = 128) -> DataFrame:
    """One row per window: conv_id, window (place of its first new turn in the conversation), repeated (leading turns that
    are not new), tokens, text, loss (spans of start, length)."""
    spark = shipped(conversations.sparkSession)
    rows = conversations.select("conv_id", "turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    with arrow_batches(spark):
        rows = saved(with_tokens(rows, tokenizer_path, layout).withColumn("rid", F.monotonically_increasing_id()), "turns")
    rows = placed(with_room(rows, budget, history), ["conv_id", "turn", "role", "text", "rid"], "tokens", also="long").drop("rid")
    first = saved(
        rows.groupBy("conv_id").agg(F.min("sum_before").alias("origin"), F.min("place").alias("first"),
                                    F.min_by(F.struct("role", "text", "tokens"), "place").alias("system"))
        .withColumnRenamed("conv_id", "c"), "first")
    rows = rows.join(first.drop("system"), rows["conv_id"].eqNullSafe(first["c"])).drop("c")
    rows = rows.withColumn("start", F.col("sum_before") - F.col("origin")).withColumn("cell", F.floor(F.col("start") / (F.col("room") - F.floor(F.col("room") / 2))))
    spans = rows.groupBy("conv_id", "cell", "also_before", "long").agg(
        F.min("place").alias("window"), F.min("start").alias("begins"), F.sum("tokens").alias("fresh"), F.min("system_tokens").alias("system_tokens"),
        F.min("most_history").alias("most_history"), F.min("room").alias("room"), F.collect_list(F.struct("place", "role", "text", "tokens")).alias("turns"))
    # a room of at least four tokens a turn bounds every list
    spans = saved(spans.withColumn("turns", F.sort_array("turns")), "spans")

    # a turn is history of the windows that begin soon after it: they are in the same piece of the line or the next
    piece = max(history, 1)
    heads = spans.where((F.col("begins") > 0) & (F.col("fresh") <= F.col("room"))).select(
        F.col("conv_id").alias("c"), "window", "begins", "most_history", F.explode(F.array(F.floor(F.col("begins") / piece), F.floor(F.col("begins") / piece) - 1)).alias("p"))
    turns = rows.select("conv_id", F.floor(F.col("start") / piece).alias("piece"), "start", F.struct("place", "role", "text", "tokens").alias("t"))
    near = (F.col("start") < F.col("begins")) & (F.col("begins") - F.col("start") <= F.col("most_history"))
    again = turns.join(heads, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")) & near)
    again = again.groupBy("window").agg(F.sort_array(F.collect_list("t")).alias("again"))
    windows = spans.join(again, "window", "left").withColumn("again", F.coalesce("again", F.array().cast(again.schema["again"].dataType)))
    windows = windows.join(first.drop("origin"), windows["conv_id"].eqNullSafe(first["c"])).drop("c")
    system = F.struct(F.col("first").alias("place"), F.col("system.role").alias("role"), F.col("system.text").alias("text"), F.col("system.tokens").alias("tokens"))
    begins_with = F.get(F.concat("again", "turns"), F.lit(0))["place"]
    windows = windows.withColumn("again", F.when((F.col("system.role") == "system") & (begins_with > F.col("first")), F.concat(F.array(system), "again")).otherwise(F.col("again")))
    mark = lambda new: lambda t: F.struct(F.lit(new).alias("new"), t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens"))
    windows = windows.select("conv_id", (F.col("window") - F.col("first")).alias("window"), F.concat(F.transform("again", mark(False)), F.transform("turns", mark(True))).alias("turns"))
    body = lambda t: F.concat(F.lit("<s>[INST] "), escaped(t["role"]), F.lit(" [/INST]"))
    parts = F.transform("turns", lambda t: F.struct(t["new"].alias("new"), t["role"].alias("role"), body(t).alias("head"), escaped(t["text"]).alias("body")))
    tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["tokens"])
    windows = windows.select("conv_id", "window", tokens.alias("tokens"), parts.alias("p"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(done: Column, t: Column) -> Column:
        span = F.struct((done["at"] + F.char_length(t["head"])).alias("start"), F.char_length(t["body"]).alias("length"))
        spans = F.when(t["new"] & (t["role"] == "assistant"), F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct((done["at"] + F.char_length(t["head"]) + F.char_length(t["body"]) + F.lit(4)).alias("at"), spans.alias("spans"))

    return windows.select(
        "conv_id", "window", F.size(F.filter("p", lambda t: ~t["new"])).alias("repeated"), "tokens",
        F.concat_ws("", F.transform("p", lambda t: F.concat(t["head"], t["body"], F.lit("</s>")))).alias("text"),
        F.aggregate("p", empty, step)["spans"].alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Windows stream by in order; nothing of a conversation is held but the running hashes."""
    parts = max(windows.sparkSession.sparkContext.defaultParallelism, int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = windows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "window")
    shipped(windows.sparkSession)
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(),
             "loss_sha256": pa.string(), "formatted_chars": pa.int64()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun = None, False

        def row() -> tuple:
            return now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted

        for batch in batches:
            out = []
            for w in batch.to_pylist():
                if not begun or w["conv_id"] != now:
                    if begun:
                        out.append(row())
                    now, begun, n, turns, loss_chars, loss, formatted = w["conv_id"], True, 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                formatted += len(w["text"])
                for i, m in enumerate(TURN.finditer(w["text"])):
                    if i >= w["repeated"]:
                        n += 1
                        turns.update(f"{unescaped(m[1])}\n{unescaped(m[2])}\n".encode())
                for span in w["loss"]:
                    text = unescaped(w["text"][span["start"] : span["start"] + span["length"]])
                    loss_chars += len(text)
                    loss.update(text.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(kinds, r)) for r in out], pa.schema(kinds))
        if begun:
            yield pa.RecordBatch.from_pylist([dict(zip(kinds, row()))], pa.schema(kinds))

    return rows.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
