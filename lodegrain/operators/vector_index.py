"""An inverted file of vectors: lists by nearest centre, residual codes for a first pass, exact comparison of the best.

Centres come from k-means over a bounded sample (`sample_rows`, 20,000 by default), at most `most_centres`; every vector of the table goes
into the list of its nearest centre, as four bits a dimension of what the centre leaves. A query looks into the lists whose
centres are nearest. A task decodes the probed part of its lists and keeps, for each query, the `depth` vectors of the greatest
approximate similarity; of all tasks' together the best `depth` are compared exactly. How many lists and what depth it takes is
measured when the index is built: with the sample as table and a part of it as queries, the least of both that reaches
`target` recall. Clustered vectors need few lists, vectors without structure many; the depth never exceeds `most_compared`
of the rows.

What is bounded: the sample, the centres and a block of queries. Codes are saved by list, a list of many rows in several
parts; no vector is shuffled, and only ids and similarities of the best move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import saved
from .topk import top_k_per

LEVELS = 16
#: Fixed value: similarities that a task holds at a time.
MOST_CELLS = 1 << 20


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(rows, -1)


def nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of least distance; rows and centres need not be of length 1."""
    half, step = (centres * centres).sum(axis=1) / 2, max(1, MOST_CELLS // len(centres))
    return np.concatenate([(rows[low : low + step] @ centres.T - half).argmax(axis=1) for low in range(0, len(rows), step)] or [np.zeros(0, np.int64)])


def k_means(rows: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(rounds):
        of = nearest_centre(rows, centres)
        sizes = np.bincount(of, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, rows)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], rows[rng.choice(len(rows), k)])
    return centres.astype(np.float32)


def encoded(rest: np.ndarray, low: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Four bits a dimension, two dimensions a byte."""
    levels = np.clip(np.rint((rest - low) / step), 0, LEVELS - 1).astype(np.uint8)
    if levels.shape[1] % 2:
        levels = np.hstack([levels, np.zeros((len(levels), 1), np.uint8)])
    return levels[:, 0::2] | (levels[:, 1::2] << 4)


def decoded(codes: np.ndarray, low: np.ndarray, step: np.ndarray) -> np.ndarray:
    levels = np.empty((len(codes), 2 * codes.shape[1]), np.uint8)
    levels[:, 0::2], levels[:, 1::2] = codes & 15, codes >> 4
    return levels[:, : len(low)] * step + low


def greatest(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest of each row, in no order."""
    return np.argpartition(-values, k - 1, axis=1)[:, :k] if k < values.shape[1] else np.tile(np.arange(values.shape[1]), (len(values), 1))


@dataclass
class Coder:
    """What the index keeps besides its lists: centres, the range of the codes, and how far to look."""

    centres: np.ndarray
    low: np.ndarray
    step: np.ndarray
    probes: int = 1
    depth: int = 1

    @classmethod
    def fitted(cls, sample: np.ndarray, lists: int, rng: np.random.Generator) -> Coder:
        centres = k_means(sample, lists, 10, rng)
        rest = sample - centres[nearest_centre(sample, centres)]
        low, high = rest.min(axis=0), rest.max(axis=0)
        return cls(centres, low, np.maximum((high - low) / (LEVELS - 1), 1e-9).astype(np.float32))

    def code(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = nearest_centre(rows, self.centres)
        return of, encoded(rows - self.centres[of], self.low, self.step)

    def approximate(self, of: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centres[of] + decoded(codes, self.low, self.step)

    def tune(self, sample: np.ndarray, k: int, target: float, most_depth: int, queries: int, rng: np.random.Generator) -> None:
        """The least number of lists, then the least depth, that reach the target recall of the k nearest in the sample."""
        asked = sample[rng.choice(len(sample), min(queries, len(sample)), replace=False)]
        k = min(k, len(sample))
        want = greatest(asked @ sample.T, k)
        of, codes = self.code(sample)
        near = asked @ self.approximate(of, codes).T
        by_nearness = np.argsort(-(asked @ self.centres.T), axis=1)
        place = np.argsort(by_nearness, axis=1)[:, of]  # of each row's list among a query's lists
        depths = sorted({min(most_depth, d) for d in (k, 2 * k, 3 * k, 5 * k, 8 * k, 12 * k)})
        probes = 1
        while True:
            seen = np.where(place < probes, near, -np.inf)
            for depth in depths:
                found = greatest(seen, min(depth, len(sample)))
                recall = np.mean([len(np.intersect1d(f[seen[i, f] > -np.inf], w)) / k for i, (f, w) in enumerate(zip(found, want))])
                if recall >= target:
                    self.probes, self.depth = probes, depth
                    return
            if probes == len(self.centres):
                self.probes, self.depth = probes, depths[-1]
                return
            probes = min(len(self.centres), max(probes + 1, probes * 5 // 4))


class VectorIndex:
    """Every live vector of a table (key, embedding) in lists. Vectors without numbers are left out."""

    def __init__(self, vectors: DataFrame, key: str = "vec_id", k: int = 10, target: float = 0.95, most_compared: float = 0.1, sample_rows: int = 20_000,
                 most_centres: int = 4096, seed: int = 42) -> None:
        self.key = key
        rows = vectors.where(F.size("embedding") > 0)
        self.vectors = rows.select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<float>").alias("d"))
        self.rows = self.vectors.count()
        if not self.rows:
            return
        rng = np.random.default_rng(seed)
        # a bounded sample, by a hash of the key: one row a (sample_rows / rows) share of the hash's range, then cut
        share = min(1.0, 1.2 * sample_rows / self.rows)
        drawn = self.vectors.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample_rows).toArrow()
        sample = unit(matrix(drawn["d"].combine_chunks(), drawn.num_rows)) if drawn.num_rows else np.zeros((1, 1), np.float32)
        self.coder = Coder.fitted(sample, max(1, min(int(4 * self.rows**0.5), most_centres, len(sample) // 4 or 1)), rng)
        self.coder.tune(sample, k, target, max(k, int(self.rows * most_compared)), 200, rng)
        self.lists = self._saved_lists()

    def _saved_lists(self) -> DataFrame:
        coder, key = self.coder, self.key

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    of, codes = coder.code(unit(matrix(batch["d"], batch.num_rows)))
                    yield pa.RecordBatch.from_arrays([batch[key], pa.array(of.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=[key, "list", "code"])

        rows = self.vectors.mapInArrow(code, f"{key} long, list int, code binary")
        # the key spreads a list that holds a large share of all rows
        return saved(rows.repartitionByRange("list", key).sortWithinPartitions("list"), "lists")

    def candidates(self, queries: DataFrame, most_queries: int = 1_000) -> DataFrame:
        """query_id, key: the vectors of each query (query_id, q) that are compared exactly; blocks of at most most_queries."""
        queries = saved(queries, "asked")
        blocks, out = -(-queries.count() // most_queries), None
        for b in range(blocks):
            own = self._candidates(queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b))
            own = own if blocks == 1 or own is None else saved(own, "candidates")
            out = own if out is None or own is None else out.unionByName(own)
        return self.vectors.select(F.col(self.key).alias("query_id"), self.key).limit(0) if out is None else out

    def _candidates(self, queries: DataFrame) -> DataFrame | None:
        """The candidates of a block, whose matrix and probed lists go to every task; none of an empty one."""
        table = queries.toArrow()
        if not table.num_rows:
            return None
        ids, asked = table["query_id"].to_numpy(), unit(matrix(table["q"].combine_chunks(), table.num_rows))
        coder, key, depth = self.coder, self.key, self.coder.depth
        probed = greatest(asked @ coder.centres.T, coder.probes)
        by_list: dict[int, np.ndarray] = {}
        order = np.argsort(probed.reshape(-1), kind="stable")
        numbers, starts = np.unique(probed.reshape(-1)[order], return_index=True)
        for number, places in zip(numbers.tolist(), np.split(order, starts[1:])):
            by_list[number] = (places // probed.shape[1]).astype(np.int32)

        def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best_keys, best = np.zeros((len(ids), depth), np.int64), np.full((len(ids), depth), -np.inf, np.float32)
            for batch in batches:
                numbers = batch["list"].to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
                for low, high in zip(cuts[:-1], cuts[1:]):
                    asking = by_list.get(int(numbers[low])) if high > low else None
                    if asking is None:
                        continue
                    part = batch.slice(low, high - low)
                    codes = np.frombuffer(b"".join(part["code"].to_pylist()), np.uint8).reshape(part.num_rows, -1)
                    rows, part_keys = coder.approximate(numbers[low:high], codes), part[key].to_numpy()
                    step = max(1, MOST_CELLS // (depth + len(rows)))
                    for some in (asking[at : at + step] for at in range(0, len(asking), step)):
                        near = asked[some] @ rows.T
                        both, both_keys = np.hstack([best[some], near]), np.hstack([best_keys[some], np.broadcast_to(part_keys, near.shape)])
                        at = greatest(both, depth)
                        best[some], best_keys[some] = np.take_along_axis(both, at, 1), np.take_along_axis(both_keys, at, 1)
            of, place = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(best_keys[of, place]), pa.array(best[of, place])], names=["query_id", key, "near"])

        lists = self.lists.where(F.col("list").isin(list(by_list))) if len(by_list) < len(coder.centres) // 4 else self.lists
        rows = lists.mapInArrow(first_pass, f"query_id long, {key} long, near float")
        return top_k_per(rows, ["query_id"], [F.desc("near"), F.col(key)], depth).select("query_id", key)

    def search(self, queries: DataFrame, k: int = 5, min_sim: float = 0.0, most_queries: int = 1_000, most_broadcast: int = 1_000_000) -> DataFrame:
        """query_id, key, similarity, rank of queries (query_id, embedding); blocks of at most most_queries."""
        asked = queries.where(F.size("embedding") > 0).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("q"))
        n = asked.count()
        if not n or not self.rows:
            return self.vectors.select(F.col(self.key).alias("query_id"), self.key, F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
        asked, blocks, out = saved(asked, "asked"), -(-n // most_queries), None
        for b in range(blocks):
            own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            found = self._candidates(own)
            if found is None:
                continue
            found = saved(found, "candidates")
            # depth rows a query of the block
            pairs = F.broadcast(found) if found.count() <= most_broadcast else found
            rows = self.vectors.join(pairs, self.key).join(own, "query_id")
            out = rows if out is None else out.unionByName(rows)
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda t, z: t + z)
        norms = F.sqrt(dot("q", "q") * dot("d", "d"))
        rows = out.select("query_id", self.key, F.round(F.when(norms > 0, dot("q", "d") / norms).otherwise(0.0), 9).alias("similarity"))
        return top_k_per(rows.where(F.col("similarity") > min_sim), ["query_id"], [F.desc("similarity"), F.col(self.key)], k, "rank")
