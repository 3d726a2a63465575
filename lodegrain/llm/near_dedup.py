"""Near-duplicate detection: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

A document's set is its distinct shingles of `words` words as 64-bit hashes. One permutation is cut into bins; the least
hash of a bin is its value, and an empty bin takes the value of the first filled bin in an order of its own that all
documents share. Bands of bins are bucket keys. Documents with one and the same set meet first and go on as one.

Candidates are stars. A bucket's centre is the member that shares the most buckets with others, which is the least edited
text of a group of copies, so the buckets of a group mostly have one centre: every member is compared with the centres of
its buckets, at most one a band, on full sets. That links most groups.

Members of a star outside its largest part may still be similar to another member and not to the centre. The comparison
with the centre leaves a sketch of what a member lacks of the centre and what it has beside it: counts, and 512 bits each of
hashed places, and the differences themselves. Two sketches of one star bound the members' intersection from above, with no
chance of error; where they allow the similarity, as those of long texts with more differences than bits do, the differences
tell the intersection exactly: what the centre has, less what either lacks, and what both have beside it. So a pair leaves the
join only if it is a link, and texts of a large group that are alike but below the limit, of any length, are never pairs.
Links are then compared on full sets. Each step is one pass; the join tests the loose members of a star with its others.

Links become components by alternating stars (operators.graph). No pair list, component or set passes the driver.

Defined cases: null text and text without words have an empty set and link with nothing; fewer words than a shingle
make one shingle of the whole; a null doc_id counts only where a
component has no other; repeated rows share one component;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import arrow_batches, few, replaced, saved, shipped, small_batches, text_key, text_or_empty

BINS, BAND_BINS = 128, 4
#: Bits of each of the two parts of a sketch.
SKETCH_BITS = 512


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, ...]:
    """Seeded tables: a hash per (place in a word, byte), multipliers per place in a shingle, the order in which an empty
    bin looks at the others, and a multiplier per bin of a band."""
    rng = np.random.default_rng(20_240_229)
    wide = lambda *shape: rng.integers(0, 1 << 64, shape, np.uint64)
    return wide(256, 256), wide(64) | np.uint64(1), rng.permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1), wide(BINS) | np.uint64(1)


def stirred(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: pa.Array, words_at_once: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word of all texts, and the number of words before each text. A-Z count as a-z; a word is a
    run of bytes other than 20 and 09-0D. What takes several times the text's bytes is held for some words at once."""
    by_place = tables()[0]
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    inside = ~space[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    before = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), before
    sums = np.zeros(len(starts), np.uint64)
    for i in range(0, len(starts), words_at_once):
        j = min(i + words_at_once, len(starts))
        low, high = starts[i], starts[j] if j < len(starts) else len(data)
        at = np.flatnonzero(inside[low:high])
        word = np.cumsum(first[low:high])[at] - 1
        place = at - (starts[i:j] - low)[word]
        h = by_place[place & 255, lower[data[low:high][at]]] * ((place.astype(np.uint64) >> np.uint64(8) << np.uint64(1)) | np.uint64(1))
        sums[i:j] = np.add.reduceat(h, np.searchsorted(at, starts[i:j] - low)) ^ (np.bincount(word).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return stirred(sums), before


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, before = word_hashes(texts)
    times = tables()[1]
    shingles = np.zeros(len(hashes), np.uint64)
    for j in range(words):
        shingles[: max(len(hashes) - j, 0)] += hashes[j:] * times[j]
    shingles = stirred(shingles)
    for low, high in zip(before[:-1].tolist(), before[1:].tolist()):
        n = high - low
        if n >= words:
            yield np.unique(shingles[low : high - words + 1])
        elif n:
            yield stirred(np.array([(hashes[low:high] * times[:n]).sum() + np.uint64(n)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin; hashes is sorted and not empty, and the upper bits name the bin."""
    look = tables()[2]
    bins = (hashes >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
    filled = bins[first]
    values = np.zeros(BINS, np.uint64)
    values[filled] = hashes[first]
    if len(first) < BINS:
        rest = np.setdiff1d(np.arange(BINS), filled)
        values[rest] = values[filled[look[np.ix_(rest, filled)].argmin(axis=1)]]
    return values


def node_of(found: np.ndarray) -> int | None:
    """A 63-bit hash of the set: equal sets are one node."""
    return int(stirred(found ^ np.uint64(len(found))).sum() >> np.uint64(1)) if len(found) else None


def keyed(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, th (a key of the text) and text: doc_id and th name a row, but for rows that are repeated whole."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("th"), text_or_empty(text).alias("text"))


def signed(docs: DataFrame, text: str, words: int) -> DataFrame:
    """doc_id, th, n_shingles, node (a hash of the set, null if it is empty) and bins (a byte of each bin's value, eight to
    a number), saved."""
    shipped(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            sizes, nodes, bins = [], [], []
            for found in shingle_sets(batch["text"], words):
                sizes.append(len(found))
                nodes.append(node_of(found))
                bins.append(stirred(signature(found) * tables()[3]).astype(np.uint8).view("<i8") if len(found) else None)
            columns = [batch["doc_id"], batch["th"], pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bins, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n_shingles", "node", "bins"])

    with arrow_batches(docs.sparkSession):
        return saved(keyed(docs, text).mapInArrow(sign, "doc_id long, th string, n_shingles long, node long, bins array<long>"), "signed")


def full_sets(docs: DataFrame, involved: DataFrame, text: str, words: int, most_broadcast: int, repeats: bool) -> DataFrame:
    """(node, set) of the involved nodes (node, doc_id, th), from the text of one document of each, saved: a second reading
    instead of a table of all sets, which would be larger than the corpus. repeats: some rows occur more than once."""
    ids = few(involved.select(F.col("doc_id").alias("id"), F.col("th").alias("of"), "node"), most_broadcast)
    rows = keyed(docs, text).join(ids, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("of"))).select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            found = [x.view(np.int64) for x in shingle_sets(batch["text"], words)]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(found, pa.list_(pa.int64()))], names=["node", "set"])

    out = rows.mapInArrow(sets, "node long, set array<long>")
    with arrow_batches(docs.sparkSession):
        return saved(out.dropDuplicates(["node"]) if repeats else out, "sets")


def sketch(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """How many hashes fell on a taken bit, and the bits."""
    bits = np.zeros(SKETCH_BITS, bool)
    bits[(hashes >> np.uint64(20)) & np.uint64(SKETCH_BITS - 1)] = True
    return len(hashes) - int(bits.sum()), np.packbits(bits).view("<i8")


def compared(pairs: DataFrame, sets: DataFrame, percent: int, most_broadcast: int, differences: bool = False) -> DataFrame:
    """The saved pairs (a, b) of nodes on their full sets, saved: a, b, na, nb, both (size of the intersection), linked (100 *
    both >= percent * union), and the sketch of b against a: lacks_more, lacks, has_more, has; with `differences` also what b lacks
    and what it has beside a, all_lacks and all_has."""
    # few pairs go to the sets, and only what is compared moves; the pairs of one centre may be many, and are split by Spark
    b_sets = sets.join(few(pairs, most_broadcast), F.col("node") == F.col("b")).select("a", "b", F.col("set").alias("setb"))
    centres = saved(pairs.select("a").distinct(), "a")
    a_sets = sets.join(few(centres, most_broadcast), F.col("node") == F.col("a")).select("a", F.col("set").alias("seta"))
    rows = b_sets.join(a_sets, "a")
    kinds = {"a": pa.int64(), "b": pa.int64(), "na": pa.int64(), "nb": pa.int64(), "both": pa.int64(), "linked": pa.bool_(), "lacks_more": pa.int64(),
             "lacks": pa.list_(pa.int64()), "has_more": pa.int64(), "has": pa.list_(pa.int64()), "all_lacks": pa.list_(pa.int64()), "all_has": pa.list_(pa.int64())}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch[c] for c in ("a", "b", "seta", "setb"))):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                inside = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = x[inside] == y
                lacking = np.ones(len(x), bool)
                lacking[inside[common]] = False
                both = int(common.sum())
                linked = 100 * both >= percent * (len(x) + len(y) - both)
                parts = x[lacking], y[~common]
                whole = [p.view(np.int64) for p in parts] if differences else [None, None]
                out.append((a.as_py(), b.as_py(), len(x), len(y), both, linked, *sketch(parts[0]), *sketch(parts[1]), *whole))
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds.values())), names=list(kinds))

    schema = "a long, b long, na long, nb long, both long, linked boolean, lacks_more long, lacks array<long>, has_more long, has array<long>, all_lacks array<long>, all_has array<long>"
    with arrow_batches(pairs.sparkSession):
        return saved(rows.select("a", "b", "seta", "setb").mapInArrow(compare, schema), "compared")


def most_in_both() -> Column:
    """No less than the size of the intersection of two members l and r of one star.

    Of the centre's shingles both have those that neither lacks; what both lack, and what both have beside the centre's,
    lies on bits that both sketches have set, one shingle a bit and those that fell on a taken bit."""
    shared = lambda part: sum((F.bit_count(F.col(f"l.{part}")[i].bitwiseAND(F.col(f"r.{part}")[i])) for i in range(1, SKETCH_BITS // 64)),
                              F.bit_count(F.col(f"l.{part}")[0].bitwiseAND(F.col(f"r.{part}")[0]))) + F.least(f"l.{part}_more", f"r.{part}_more")
    return F.col("l.both") + F.col("r.both") - F.col("l.na") + shared("lacks") + shared("has")


def in_both() -> Column:
    """The size of the intersection of two members l and r of one star."""
    met = lambda part: F.size(F.array_intersect(F.col(f"l.{part}"), F.col(f"r.{part}")))
    return F.col("l.both") + F.col("r.both") - F.col("l.na") + met("all_lacks") + met("all_has")


def star_pairs(nodes: DataFrame, most_broadcast: int) -> DataFrame:
    """(a, b): the centres a of the buckets of each node b, saved."""
    half = lambda band: F.shiftrightunsigned(F.col("bins")[band // 2], 32 * (band % 2)).bitwiseAND(F.lit(0xFFFFFFFF))
    bands = nodes.select("node", F.explode(F.array(*[F.xxhash64(F.lit(j), half(j)) for j in range(BINS // BAND_BINS)])).alias("key"))
    keys = saved(bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    members = saved(bands.join(few(keys, most_broadcast), "key"), "members")
    ranked = members.join(members.groupBy("node").agg(F.sum("n").alias("met")), "node")
    centres = saved(ranked.groupBy("key").agg(F.max(F.struct("met", "node")).alias("top")).select("key", F.col("top.node").alias("a")), "centres")
    pairs = saved(members.join(few(centres, most_broadcast), "key").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "stars")
    for table in (keys, members, centres):
        replaced(table)
    return pairs


def unsettled_pairs(stars: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one star, in different components, that their differences from the centre show to be links; saved."""
    part = lambda df, key: df.join(labels.select(F.col("node").alias(key), "component"), key, "left").withColumn("component", F.coalesce("component", key))
    rows = saved(part(stars, "b"), "rows")
    own = part(rows.select("a").distinct(), "a")
    parts = rows.select("a", "component").union(own.select("a", "component")).groupBy("a", "component").agg(F.count("*").alias("n"))
    apart = parts.groupBy("a").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    apart = saved(apart.select("a", F.col("top.component").alias("largest")), "apart")
    here = rows.join(apart, "a")
    size = (F.col("l.nb") * 100 >= F.col("r.nb") * percent) & (F.col("r.nb") * 100 >= F.col("l.nb") * percent)
    once = (F.col("r.component") == F.col("r.largest")) | (F.col("l.b") < F.col("r.b"))
    # 100 * both >= percent * (l + r - both), with the most that both can be, then with what it is
    similar = lambda both: (100 + percent) * both >= percent * (F.col("l.nb") + F.col("r.nb"))
    allowed = F.when(similar(most_in_both()), similar(in_both())).otherwise(False)
    pairs = here.where("component <> largest").alias("l").join(
        here.alias("r"), (F.col("l.a") == F.col("r.a")) & (F.col("l.component") != F.col("r.component")) & once & size & allowed)
    out = saved(pairs.select(F.least("l.b", "r.b").alias("a"), F.greatest("l.b", "r.b").alias("b")).distinct(), "unsettled")
    for table in (rows, apart):
        replaced(table)
    return out


def similar_nodes(docs: DataFrame, nodes: DataFrame, text: str, words: int, percent: int, repeats: bool, most_broadcast: int) -> DataFrame:
    """(node, component) of all nodes that are similar to another."""
    pairs = star_pairs(nodes, most_broadcast)
    involved = saved(pairs.select(F.col("b").alias("node")).union(pairs.select("a")).distinct(), "involved")
    sets = full_sets(docs, nodes.join(few(involved, most_broadcast), "node", "left_semi"), text, words, most_broadcast, repeats)
    stars = compared(pairs, sets, percent, most_broadcast, differences=True)
    links = stars.where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    labels = saved(connected_components(links), "labels")
    more = unsettled_pairs(stars, labels, percent)
    if not more.isEmpty():
        found = compared(more, sets, percent, most_broadcast).where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        labels = saved(connected_components(links.union(found)), "labels")
    for table in (pairs, involved, sets, stars):
        replaced(table)
    return labels


def grouped(docs: DataFrame, words: int, percent: int, text: str, most_broadcast: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, n_shingles, node), and the groups of two documents and more: node, and of the document that stays
    component_id and its th: the least doc_id, nulls last."""
    rows = signed(docs, text, words)
    repeats = not rows.groupBy("doc_id", "th").count().where("count > 1").isEmpty()
    nodes = saved(rows.where("node is not null").groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("first"), F.count("*").alias("copies"),
        F.first("bins").alias("bins")).select("node", "first", "first.doc_id", "first.th", "copies", "bins"), "nodes")
    labels = similar_nodes(docs, nodes, text, words, percent, repeats, most_broadcast)
    several = nodes.select("node", "first", "copies").join(labels, "node", "left").where("copies > 1 or component is not null")
    several = saved(several.withColumn("component", F.coalesce("component", "node")), "several")
    stays = several.groupBy("component").agg(F.min("first").alias("stays"))
    groups = saved(several.join(stays, "component").select("node", F.col("stays.doc_id").alias("component_id"), F.col("stays.th").alias("stays")), "groups")
    for table in (nodes, several):
        replaced(table)
    return rows.drop("bins"), groups


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", most_broadcast: int = 200_000) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable over links), kept (doc_id is it)."""
    rows, groups = grouped(docs, words, percent, text, most_broadcast)
    out = rows.join(few(groups, most_broadcast), "node", "left")
    component = F.when(F.col("stays").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", most_broadcast: int = 200_000) -> DataFrame:
    """One document of each group, all columns: that of the least doc_id (nulls last, then by a hash of the text). Decided
    by doc_id and text, so another text under the same doc_id is judged alone; of rows repeated whole in doc_id and text,
    one stays. Documents without words are in no group and stay."""
    rows, groups = grouped(docs, words, percent, text, most_broadcast)
    rows = rows.join(few(groups, most_broadcast), "node").groupBy("doc_id", "th", "component_id", "stays").agg(F.count("*").alias("rows"))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("stays"))
    verdicts = rows.select(F.col("doc_id").alias("id"), F.col("th").alias("of"), F.when(stays, F.when(F.col("rows") > 1, "one")).otherwise("none").alias("verdict"))
    verdicts = saved(verdicts.where("verdict is not null"), "verdicts")
    keyed_rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("i"), text_key(text).alias("t"))
    judged = keyed_rows.join(few(verdicts, most_broadcast), F.col("i").eqNullSafe(F.col("id")) & (F.col("t") == F.col("of")), "left")
    out = judged.where("verdict is null").select("row.*")
    if not verdicts.where("verdict = 'one'").isEmpty():
        out = out.unionByName(judged.where("verdict = 'one'").groupBy("i", "t").agg(F.first("row").alias("row")).select("row.*"))
    return out
