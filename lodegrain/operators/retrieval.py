"""Lexical, vector and fused ranking for tables of queries: one job answers them all.

Documents and queries are (id, text) tables. Query tables are joined, never looped over; a query's candidates are bounded
by its terms' postings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_test_path, is_vendor_path
from ..sources.snapshots import saved
from .topk import by_shuffle, min_max_normalise, numbered, top_k_per
from .vector_index import MOST_CELLS, VectorIndex, unit


def code_tokens(text: Column) -> Column:
    """Words of [A-Za-z0-9_]: each lower-cased whole, with its snake parts of two characters and more, or else its camel parts."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))
    camel = lambda w: F.regexp_extract_all(w, F.lit("[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+"), F.lit(0))
    parts = lambda w: F.when(w.contains("_"), F.split(w, "_")).otherwise(F.when(F.size(camel(w)) > 1, camel(w)).otherwise(F.array().cast("array<string>")))
    long = lambda w: F.transform(F.filter(parts(w), lambda p: F.length(p) >= 2), lambda p: F.lower(p))
    return F.flatten(F.transform(words, lambda w: F.concat(F.array(F.lower(w)), long(w))))


def prose_tokens(text: Column) -> Column:
    """Lower-cased words without plural and verb endings (a light suffix rule in place of a full stemmer)."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.transform(words, lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, "(ing|ed|ies|es|s)$", "")).otherwise(w))


def build_postings(docs: DataFrame, key: str = "doc_id", fields: dict[str, Column] | None = None) -> DataFrame:
    """term, field, key, tf of the token arrays of each field. Texts move by key before they are split, so a row a text moves and not one
    a token, and what is saved of a text lies together."""
    fields = fields or {"body": prose_tokens(F.col("text"))}
    tokens = F.flatten(F.array(*[_tagged(name, column) for name, column in fields.items()]))
    return docs.repartition(key).select(key, F.explode(tokens).alias("t")).groupBy(F.col("t.term").alias("term"), F.col("t.field").alias("field"), key).agg(F.count("*").alias("tf"))


def _tagged(name: str, tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.struct(F.lit(name).alias("field"), t.alias("term")))


def corpus_stats(postings: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(term, field, df), (key, field, length) and (field, docs, avg_length)."""
    lengths = postings.groupBy(key, "field").agg(F.sum("tf").alias("length"))
    return (postings.groupBy("term", "field").agg(F.count("*").alias("df")), lengths,
            lengths.groupBy("field").agg(F.count("*").alias("docs"), F.avg("length").alias("avg_length")))


#: Rows of query terms, and cells of terms by queries, up to which scores are matrix products.
MOST_TERMS, MOST_WEIGHTS = 200_000, 1 << 22


def _asked_matrix(query_terms: DataFrame) -> tuple[pa.Array, pa.Array, np.ndarray] | None:
    """Query ids, terms and the weight of each term in each query, of a bounded number of queries; None of more, or of weights that
    are not positive: these are joined."""
    table = query_terms.select("query_id", "term", F.col("weight").cast("double").alias("weight")).dropna().limit(MOST_TERMS + 1).toArrow()
    if not 0 < table.num_rows <= MOST_TERMS:
        return None
    queries, terms = (table[c].combine_chunks().dictionary_encode() for c in ("query_id", "term"))
    weights = table["weight"].to_numpy()
    if len(queries.dictionary) * len(terms.dictionary) > MOST_WEIGHTS or not (weights > 0).all():
        return None
    asked = np.zeros((len(terms.dictionary), len(queries.dictionary)))
    np.add.at(asked, (terms.indices.to_numpy(), queries.indices.to_numpy()), weights)
    return queries.dictionary, terms.dictionary, asked


def _best_of(ids: pa.Array, terms: pa.Array, asked: np.ndarray, k: int, key: str):
    """The k best texts of each query of a task's (key, terms, parts): the parts of some texts at a time as a matrix, multiplied with
    the queries' weights, so no row is made of a text and a query that do not come out."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, top_keys = np.zeros((0, len(ids))), np.zeros((0, len(ids)), np.int64)
        step = max(1, MOST_CELLS // max(asked.shape))
        for some in (batch.slice(low, step) for batch in batches for low in range(0, batch.num_rows, step)):
            keys, lists = some[key].to_numpy(), some["terms"]
            place = np.repeat(np.arange(len(keys)), lists.value_lengths().to_numpy()) * len(terms) + pc.index_in(lists.flatten(), value_set=terms).to_numpy()
            parts = np.bincount(place, some["parts"].flatten().to_numpy(), len(keys) * len(terms)).reshape(len(keys), -1)
            exact = parts @ asked
            # sums depend on the order of their parts in the last digits; ties must not
            scores = np.vstack([top, np.where(exact > 0, np.round(exact, 9), -1.0)])
            every = np.vstack([top_keys, np.broadcast_to(keys[:, None], exact.shape)])
            order = np.lexsort((every, -scores), axis=0)[:k]
            top, top_keys = np.take_along_axis(scores, order, 0), np.take_along_axis(every, order, 0)
        at, of = np.nonzero(top >= 0)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pa.array(top_keys[at, of]), pa.array(top[at, of])], names=["query_id", key, "score"])

    return best


def bm25(query_terms: DataFrame, postings: DataFrame, limit: int | None = 10, boosts: dict[str, float] | None = None, k1: float = 1.2, b: float = 0.75, key: str = "doc_id") -> DataFrame:
    """query_id, key, score, rank: query_terms are (query_id, term, weight). Only the postings of terms that some query has
    are read on past the first join."""
    asked = _asked_matrix(query_terms) if limit is not None and dict(postings.dtypes)[key] == "bigint" and all(x > 0 for x in (boosts or {}).values()) else None
    # terms that were counted are few; others, and a length a text, are never broadcast by the size of compressed files
    large = by_shuffle if asked is None else lambda df: df
    _, lengths, averages = corpus_stats(postings, key)
    terms = query_terms.select("term").distinct()
    hit = postings.join(large(terms), "term", "left_semi")
    df = hit.groupBy("term", "field").agg(F.count("*").alias("df"))
    rows = hit.join(large(df), ["term", "field"]).join(by_shuffle(lengths), [key, "field"]).join(F.broadcast(averages), "field")  # a row per field
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    boost = F.coalesce(*[F.when(F.col("field") == f, x) for f, x in (boosts or {}).items()], F.lit(1.0))
    rows = rows.select("term", key, (idf * norm * boost).alias("part"))
    if asked is not None:
        of_text = rows.groupBy(key).agg(F.collect_list("term").alias("terms"), F.collect_list("part").alias("parts"))
        best = of_text.mapInArrow(_best_of(*asked, limit, key), f"query_id {dict(query_terms.dtypes)['query_id']}, {key} long, score double")
        return top_k_per(best, ["query_id"], [F.desc("score"), F.col(key)], limit, "rank")
    scored = query_terms.join(by_shuffle(rows), "term").groupBy("query_id", key).agg(F.sum(F.col("part") * F.col("weight")).alias("score"))
    # sums depend on the order of their parts in the last digits; ties must not
    scored = scored.withColumn("score", F.round("score", 9))
    return top_k_per(scored, ["query_id"], [F.desc("score"), F.col(key)], limit, "rank")


def prefix_match(query_terms: DataFrame, postings: DataFrame, least: int = 3, most: int = 12, key: str = "doc_id") -> DataFrame:
    """query_id, term, matched, key: tokens that begin with a query term of `least` to `most` characters; an equi-join on
    the token's first characters, one per length in use."""
    terms = query_terms.where(F.length("term").between(least, most)).select("query_id", "term")
    tokens = postings.select(F.col("term").alias("matched")).distinct()
    heads = tokens.withColumn("head", F.explode(F.transform(F.sequence(F.lit(least), F.lit(most)), lambda n: F.when(F.length("matched") >= n, F.substring(F.col("matched"), F.lit(1), n)))))
    found = terms.join(heads.where("head is not null"), F.col("term") == F.col("head")).drop("head")
    return found.join(postings.select(F.col("term").alias("matched"), key).distinct(), "matched").select("query_id", "term", "matched", key)


def fuzzy_match(query_terms: DataFrame, tokens: DataFrame, least: int = 3) -> DataFrame:
    """query_id, term, matched: tokens one edit away (a swap of neighbours is one edit). Both sides meet on what is left
    after deleting one character at most, so no term meets all tokens."""
    variants = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))
    a = query_terms.where(F.length("term") >= least).select("query_id", "term").distinct().withColumn("v", F.explode(variants(F.col("term"))))
    b = tokens.select(F.col("term").alias("matched")).distinct().where(F.length("matched") >= least - 1).withColumn("v", F.explode(variants(F.col("matched"))))
    rows = a.join(b, "v").select("query_id", "term", "matched").distinct()
    same = (F.length("term") == F.length("matched")) & (F.levenshtein("term", "matched") == 2)
    first = F.aggregate(F.sequence(F.lit(1), F.length("term")), F.lit(0), lambda t, i: F.when((t == 0) & (F.substring(F.col("term"), i, F.lit(1)) != F.substring(F.col("matched"), i, F.lit(1))), i).otherwise(t))
    swapped = F.concat(F.substring(F.col("term"), F.lit(1), first - 1), F.substring(F.col("term"), first + 1, F.lit(1)), F.substring(F.col("term"), first, F.lit(1)), F.substring(F.col("term"), first + 2, F.length("term")))
    return rows.where((F.levenshtein("term", "matched") == 1) | (same & (swapped == F.col("matched"))))


def _blocks(queries: DataFrame, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of the stated queries, `most` at a time: one block is on the driver, and in the tasks."""
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q")).where(F.size("q") > 0)
    n = -(-rows.count() // most)
    for block in range(n):
        table = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == block)).toArrow()
        if table.num_rows:
            yield table["query_id"].to_numpy(), unit(table["q"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1))


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, min_sim: float = 0.0, most_queries: int = 10_000, key: str = "vec_id") -> DataFrame:
    """query_id, key, similarity, rank: exact cosine of every query vector with every live vector, greater than min_sim.

    The stated query set goes to the tasks as one matrix of `most_queries` rows at most (a larger set in blocks, with a pass
    over the vectors each, saved before the next); a batch of vectors is multiplied with it, and leaves k rows per query before
    anything moves."""
    best, waiting = None, None
    d = vectors.select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("d")).where(F.size("d") > 0)
    for ids, asked in _blocks(queries, most_queries):

        def nearest(batches: Iterator[pa.RecordBatch], ids=ids, asked=asked) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys, rows = batch[key].to_numpy(), unit(batch["d"].flatten().to_numpy().reshape(batch.num_rows, -1))
                # of equal similarities the least keys, as in the final order: columns by key, and a stable cut
                by_key = np.argsort(keys, kind="stable")
                keys, rows = keys[by_key], rows[by_key]
                # some queries at a time: what a task holds depends on neither table's size
                step = max(1, MOST_CELLS // len(keys))
                for low in range(0, len(ids), step):
                    sims = np.round(asked[low : low + step] @ rows.T, 9)
                    if k < len(keys):
                        least = np.partition(sims, len(keys) - k, axis=1)[:, len(keys) - k, None]
                        above = sims > least
                        tied = sims == least
                        taken = above | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True)))
                    else:
                        taken = np.ones(sims.shape, bool)
                    of, at = np.nonzero(taken & (sims > min_sim))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[low + of]), pa.array(keys[at]), pa.array(sims[of, at])], names=["query_id", key, "similarity"])

        if waiting is not None:
            waiting = saved(waiting, "nearest")
            best = waiting if best is None else best.unionByName(waiting)
        waiting = d.mapInArrow(nearest, f"query_id long, {key} long, similarity double")
    if waiting is None:
        waiting = d.select(F.col(key).alias("query_id"), key, F.lit(0.0).alias("similarity")).limit(0)
    best = waiting if best is None else best.unionByName(waiting)
    return top_k_per(best, ["query_id"], [F.desc("similarity"), F.col(key)], k, "rank")


def approx_top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, min_sim: float = 0.0, key: str = "vec_id", **how) -> DataFrame:
    """query_id, key, similarity, rank: approximate neighbours by an inverted file built for the call; keep a VectorIndex to
    ask more than once."""
    return VectorIndex(vectors, key, k, **how).search(queries, k, min_sim)


def hybrid_search(query_terms: DataFrame, postings: DataFrame, query_vectors: DataFrame, vectors: DataFrame, quality: DataFrame | None = None, limit: int = 10, over_fetch: int = 3, key: str = "doc_id") -> DataFrame:
    """query_id, key, score, source, rank: the lexical and the vector list, each `over_fetch` times as long as wanted, fused by
    reciprocal ranks; with `quality` (key, quality; 0 where missing) reranked; then cut."""
    deep = limit * over_fetch
    fused = rrf(bm25(query_terms, postings, deep, key=key), cosine_top_k(query_vectors, vectors, deep, key=key), key, limit=None if quality is not None else limit)
    if quality is None:
        return fused
    rows = fused.drop("rank").join(quality, key, "left").fillna(0, ["quality"])
    return quality_rerank(rows, limit, key).select("query_id", key, "score", "source", "rank")


def compact_vectors(vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """The live vectors with `slot`, their number from 0 in key order; ranks come from sorted parts, so nothing is in one task."""
    live = vectors.where(~F.coalesce("deleted", F.lit(False))).drop("deleted")
    return numbered(live, key, "slot")


def rrf(lexical: DataFrame, vector: DataFrame, key: str = "doc_id", k: int = 60, limit: int | None = 10) -> DataFrame:
    """query_id, key, score (in 0 .. 1), source, rank: reciprocal ranks of both lists (rank from 1) added and divided by 2 / (k + 1)."""
    part = lambda df, name: df.select("query_id", key, (1 / (F.lit(k) + F.col("rank"))).alias("part"), F.lit(name).alias("source"))
    # both lists are dealt out anew: Spark 4.1 takes such a union to be dealt by query like its parts, which adaptive plans do not always keep
    rows = part(lexical, "bm25").unionByName(part(vector, "vector")).repartition("query_id", key).groupBy("query_id", key).agg(
        F.round(F.sum("part") * ((k + 1) / 2), 9).alias("score"), F.when(F.countDistinct("source") > 1, "both").otherwise(F.min("source")).alias("source"))
    return top_k_per(rows, ["query_id"], [F.desc("score"), F.col(key)], limit, "rank")


#: What a kind and a visibility are worth; languages without enforced visibility have a table of their own.
KIND_BOOSTS = {"Interface": 1.0, "Struct": 0.8, "Class": 0.8, "Enum": 0.6, "Function": 0.4, "Method": 0.4}
OTHER_KIND = 0.2
DYNAMIC_PATHS = ["py", "js", "ts", "rb", "php"]
DYNAMIC_VISIBILITY, OTHER_DYNAMIC = {"public": 1.0, "private": 0.7}, 0.8
VISIBILITY, OTHER_VISIBILITY = {"public": 1.0, "crate": 0.7, "super": 0.5, "private": 0.3}, 0.6


def _worth(column: str, values: dict[str, float], other: float) -> Column:
    return F.coalesce(*[F.when(F.col(column) == k, v) for k, v in values.items()], F.lit(other))


def quality_features(hits: DataFrame, as_of: int, lam: float = 0.05) -> DataFrame:
    """Add to hits (name, path, kind, visibility, epoch, terms: the query's, in lower case) temporal (decay by days), source (1, tests
    0.2, vendored 0), path_match (share of the terms in the path), specificity (of names of 4 to 16 characters), exact (1 if a term is
    the name, 0.3 if the name begins with one), kind_boost and visibility_boost. Empty terms match nothing."""
    days = F.greatest((F.lit(as_of) - F.col("epoch")) / 86400.0, F.lit(0.0))
    name, path = F.lower("name"), F.lower("path")
    n = F.size("terms")
    share = F.when(n > 0, F.size(F.filter("terms", lambda t: path.contains(t))) / n).otherwise(0.0)
    exact = F.when(F.array_contains("terms", name), 1.0).when(F.exists("terms", lambda t: name.startswith(t)), 0.3).otherwise(0.0)
    return hits.withColumns({
        "temporal": F.exp(-F.lit(lam) * days), "source": F.when(is_vendor_path(F.col("path")), 0.0).when(is_test_path(F.col("path")), 0.2).otherwise(1.0),
        "path_match": share, "specificity": F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.length("name") - 4) / F.lit(12.0))), "exact": exact,
        "kind_boost": _worth("kind", KIND_BOOSTS, OTHER_KIND),
        "visibility_boost": F.when(F.col("path").rlike(rf"\.({'|'.join(DYNAMIC_PATHS)})$"), _worth("visibility", DYNAMIC_VISIBILITY, OTHER_DYNAMIC)).otherwise(
            _worth("visibility", VISIBILITY, OTHER_VISIBILITY))})


def additive_score(hits: DataFrame) -> DataFrame:
    """Add total: the weighted sum of the normalised lexical score and the quality columns of a hit."""
    #: The weights.
    weights = {"norm": 0.40, "source": 0.12, "path": 0.08, "pagerank": 0.10, "visibility": 0.05, "kind": 0.05, "specificity": 0.05, "temporal": 0.05, "exact": 0.10}
    rows = min_max_normalise(hits, ["query_id"])
    return rows.withColumn("total", sum((F.lit(w) * F.col(c) for c, w in weights.items()), F.lit(0.0)))


def quality_rerank(hits: DataFrame, limit: int | None = 10, key: str = "doc_id") -> DataFrame:
    rows = hits.withColumn("score", F.round(0.7 * F.col("score") + 0.3 * F.col("quality") / 0.55, 9))
    return top_k_per(rows, ["query_id"], [F.desc("score"), F.col(key)], limit, "rank")


def search_with_fallback(lexical: DataFrame, prefix: DataFrame, fuzzy: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """query_id, key, score: lexical hits; where a query has fewer than limit / 2, prefix hits too, and fuzzy ones if that is
    still too few; every hit once, the best of it."""
    def short(rows: DataFrame) -> DataFrame:
        queries = lexical.select("query_id").union(prefix.select("query_id")).union(fuzzy.select("query_id")).distinct()
        return queries.join(rows.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < limit / 2).select("query_id")

    rows = lexical.select("query_id", key, "score")
    for extra in (prefix, fuzzy):
        more = extra.select("query_id", key, "score").join(short(rows), "query_id", "left_semi").join(rows, ["query_id", key], "left_anti")
        rows = rows.unionByName(more.groupBy("query_id", key).agg(F.max("score").alias("score")))
    return top_k_per(rows, ["query_id"], [F.desc("score"), F.col(key)], limit)


def drop_low_confidence(hits: DataFrame, min_score: float = 0.15) -> DataFrame:
    return hits.where(F.col("score") >= min_score)


def vector_table_stats(vectors: DataFrame) -> DataFrame:
    """One row: total, active, deleted, dims, tombstone_ratio."""
    return vectors.agg(F.count("*").alias("total"), F.count_if(~F.col("deleted")).alias("active"), F.count_if("deleted").alias("deleted"),
                       F.max(F.size("embedding")).alias("dims"), (F.count_if("deleted") / F.count("*")).alias("tombstone_ratio"))
