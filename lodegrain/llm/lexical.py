"""Ranked lexical search over all documents: buckets of impact vectors by length, pruned by bounds, rescored in integers.

A document's impact of a term is (1e9 * tf) div (1000 * tf + 8 * m), with m from its length; an item's weight of a term is
w times its repeats. The score is their inner product. One reading of the texts keeps, of each document, its number of
terms and the counts of terms that some item asks for. Counts over all rows give N, L and each df, hence w and m; impact
vectors are then ordered by length (Euclidean norm), longest first, inside each partition and cut into buckets.

Items come in blocks of a bounded number of terms, which every task holds. A task goes through its buckets in order:
- Cauchy-Schwarz: an item whose norm times the longest vector's stays below its threshold skips the bucket. A threshold is the
  k-th best score among documents already seen, so what is skipped cannot rank.
- Coordinates: each term's greatest impact in the bucket bounds what the term can add. Terms are taken in falling order of
  that bound; a document in none of the first terms has less than what the others can add. Once that is below the threshold
  only documents met so far go on, and of these only those whose sum so far, plus the lesser of the coordinate bound and of
  the Cauchy-Schwarz bound of the rest, reaches the threshold.
- Survivors are scored anew in 64-bit integers.

The longest bucket of each partition goes first and gives every item a threshold for all other buckets. Partitions are not
ranges of the norm, which would leave all the work to the first ones. Tasks hand on k rows an item.

Defined cases: null text has no terms, as an item or as a document; documents without terms count in nothing; equal scores
rank by doc_id, a null doc_id last; repeated documents are ranked each, an item repeated whole is ranked once, and two texts
with one item_id are two items; an empty table of either kind gives an empty result; texts are read whole; other columns
are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, replaced, saved, shipped, small_batches, text_or_empty

#: Bounds are floats: they are raised by this share, so that rounding prunes nothing.
SLACK = 1 + 1e-9
NO_ID = np.iinfo(np.int64).max


def _table() -> bytes:
    """Bytes outside terms become spaces, A-Z become a-z; bytes of other characters stay."""
    keep = lambda b: b >= 0x80 or chr(b).isalnum()
    return bytes(b + 32 if 65 <= b <= 90 else b if keep(b) else 32 for b in range(256))


TABLE = _table()


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order: maximal runs of ASCII letters and digits and of all characters from U+0080 on."""
    return text.encode().translate(TABLE).split()


def blocks_of(items: DataFrame, most_terms: int) -> Iterator[list[tuple[int | None, Counter]]]:
    """Items with their term counts, in blocks of about most_terms distinct terms; one block at a time is on the driver."""
    block, vocabulary = [], set()
    for row in items.toLocalIterator():
        counts = Counter(terms_of(row["text"]))
        if block and len(vocabulary) + len(counts) > most_terms:
            yield block
            block, vocabulary = [], set()
        block.append((row["item_id"], counts))
        vocabulary |= counts.keys()
    if block:
        yield block


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], text: str) -> DataFrame:
    """doc_id, n (terms of the text) and the counts tf of the vocabulary's terms, saved."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sizes, terms, tfs = [], [], []
            for t in batch["text"]:
                words = terms_of(t.as_py())
                found = Counter(map(vocabulary.get, words))
                found.pop(None, None)
                sizes.append(len(words))
                terms.append(list(found))
                tfs.append(list(found.values()))
            columns = [batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    with arrow_batches(docs.sparkSession):
        return saved(rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>").where("n > 0"), "counts")


def bucketed(counts: DataFrame, n_docs: int, n_terms: int, bucket_rows: int) -> DataFrame:
    """doc_id, norm, terms, impacts, in order of falling norm inside each partition, and bucket; saved. bucket_rows is a power
    of two, so that a bucket lies in one partition."""
    m = F.expr(f"25 + (75 * n * {n_docs}L) div {n_terms}L")
    rows = counts.where(F.size("terms") > 0).withColumn("m", m)
    rows = rows.withColumn("impacts", F.expr("transform(tfs, tf -> (1000000000L * tf) div (1000 * tf + 8 * m))"))
    norm = F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    rows = rows.select("doc_id", norm.alias("norm"), "terms", "impacts").sortWithinPartitions(F.desc("norm"), "doc_id")
    return saved(rows.withColumn("bucket", F.expr(f"monotonically_increasing_id() div {bucket_rows}")), "buckets")


class Item:
    """An item's terms in ascending order with their weights (w times repeats), and its norm."""

    def __init__(self, counts: dict[int, int], weights: np.ndarray) -> None:
        self.terms = np.array(sorted(counts), np.int64)
        self.weights = weights[self.terms] * np.array([counts[t] for t in self.terms.tolist()], np.int64)
        self.norm = float(np.sqrt((self.weights.astype(float) ** 2).sum()))


class Best:
    """The k best (score, doc_id) of an item so far; floor is what a document must reach to rank."""

    def __init__(self, k: int, floor: int) -> None:
        self.k, self.floor = k, max(floor, 1)
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        self.scores, self.ids = np.r_[self.scores, scores], np.r_[self.ids, ids]
        order = np.lexsort((self.ids, -self.scores))[: self.k]
        self.scores, self.ids = self.scores[order], self.ids[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.scores[-1]))


def search_bucket(items: list[Item], best: list[Best], ids: np.ndarray, norms: np.ndarray, starts: np.ndarray, terms: np.ndarray,
                  impacts: np.ndarray) -> None:
    """Rank one bucket; the vector of row r is terms and impacts from starts[r] to starts[r + 1]."""
    floors = np.array([b.floor for b in best], float)
    alive = np.flatnonzero(np.array([q.norm for q in items]) * norms.max() * SLACK >= floors)
    if not len(alive):
        return
    order = np.argsort(terms, kind="stable")
    row_of = np.repeat(np.arange(len(ids)), np.diff(starts))[order]
    by_term, by_impact = terms[order], impacts[order]
    present, first = np.unique(by_term, return_index=True)
    last = np.r_[first[1:], len(by_term)]
    greatest = np.maximum.reduceat(by_impact, first)
    for q in alive.tolist():
        item, top = items[q], best[q]
        at = np.searchsorted(present, item.terms)
        here = np.flatnonzero(present[np.minimum(at, len(present) - 1)] == item.terms)
        at, weights = at[here], item.weights[here]
        bounds = weights.astype(float) * greatest[at]
        falling = np.argsort(-bounds, kind="stable")
        at, weights, bounds = at[falling], weights[falling], bounds[falling]
        rest = np.r_[np.cumsum(bounds[::-1])[::-1], 0.0]
        if rest[0] * SLACK < top.floor:
            continue
        taken = int(np.argmax(rest * SLACK < top.floor))
        spans = [slice(first[t], last[t]) for t in at[:taken].tolist()]
        rows = np.concatenate([row_of[s] for s in spans])
        adds = np.concatenate([by_impact[s] * float(w) for s, w in zip(spans, weights[:taken].tolist())])
        sums = np.bincount(rows, adds, len(ids))
        left = np.minimum(rest[taken], np.sqrt((weights[taken:].astype(float) ** 2).sum()) * norms)
        found = np.flatnonzero((sums > 0) & ((sums + left) * SLACK >= top.floor))
        if not len(found):
            continue
        lengths = starts[found + 1] - starts[found]
        ends = np.cumsum(lengths)
        places = np.arange(ends[-1]) + np.repeat(starts[found] - (ends - lengths), lengths)
        own = terms[places]
        of = np.minimum(np.searchsorted(item.terms, own), len(item.terms) - 1)
        products = np.where(item.terms[of] == own, item.weights[of] * impacts[places], 0)
        scores = np.add.reduceat(products, ends - lengths)
        enough = scores >= top.floor
        top.add(scores[enough], ids[found[enough]])


def ranked(vectors: DataFrame, items: list[Item], floors: list[int], k: int) -> DataFrame:
    """(item, score, doc_id): each task's k best of every item."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k, f) for f in floors]
        for batch in batches:
            bucket = batch["bucket"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:]):
                if low == high:
                    continue
                rows = batch.slice(low, high - low)
                ids = rows["doc_id"].fill_null(NO_ID).to_numpy()
                starts = rows["terms"].offsets.to_numpy().astype(np.int64)
                terms, impacts = rows["terms"].flatten().to_numpy().astype(np.int64), rows["impacts"].flatten().to_numpy()
                search_bucket(items, best, ids, rows["norm"].to_numpy(), starts - starts[0], terms, impacts)
        number = np.repeat(np.arange(len(best)), [len(b.ids) for b in best])
        scores, ids = (np.concatenate([getattr(b, c) for b in best]) for c in ("scores", "ids"))
        yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(scores, pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID)],
                                         names=["item", "score", "doc_id"])

    return vectors.mapInArrow(rank, "item long, score long, doc_id long")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", bucket_rows: int = 1024, most_terms: int = 200_000) -> DataFrame:
    """The k best documents of each item with a score above 0: item_id, rank (from 1), doc_id, score."""
    spark = shipped(docs.sparkSession)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty(text).alias("text")).distinct().orderBy("item_id", "text")
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks_of(asked, most_terms):
        found = search_block(docs, block, k, text, bucket_rows)
        out = out if found is None else out.unionByName(found)
    return out


def search_block(docs: DataFrame, block: list[tuple[int | None, Counter]], k: int, text: str, bucket_rows: int) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(c.keys() for _, c in block))))}
    counts = term_counts(docs, vocabulary, text)
    n_docs, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs or not vocabulary:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for row in counts.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # a row a term of the block
        df[row["term"]] = row["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    numbered = [Item({vocabulary[t]: c for t, c in terms.items()}, weights) for _, terms in block]
    vectors = bucketed(counts, n_docs, n_terms, bucket_rows)
    replaced(counts)
    longest = F.expr(f"(bucket * {bucket_rows}) & {(1 << 33) - 1}L") < bucket_rows
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    head = saved(ranked(vectors.where(longest), numbered, [1] * len(block), k), "head")
    floors = [1] * len(block)
    for row in head.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).toLocalIterator():  # a row an item of the block
        floors[row["item"]] = row["score"]
    rest = ranked(vectors.where(~longest), numbered, floors, k)
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item long, item_id long")
    rows = head.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return saved(rows.join(names, "item").select("item_id", "rank", "doc_id", "score"), "ranked")
