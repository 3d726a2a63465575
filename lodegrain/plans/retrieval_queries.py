"""Queries of ranking and evaluation over documents, benchmark, labels, embeddings and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import retrieval as R
from ..operators.topk import average_ranks, dedupe_best, min_max_normalise
from ..sources.snapshots import saved
from .catalog import Views, query


def query_terms(v: Views):
    """All distinct words of each benchmark item."""
    return v.benchmark.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(R.prose_tokens(F.col("text")))).alias("term"), F.lit(1.0).alias("weight"))


def postings(v: Views):
    """Texts are read and split once; counts, lengths and hits come from the saved table."""
    return saved(R.build_postings(v.documents), "postings")


def _tokens(text: str) -> str:
    return f"list_transform(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: CASE WHEN length(w) > 4 THEN regexp_replace(w, '(ing|ed|ies|es|s)$', '') ELSE w END)"


_POSTINGS = f"postings AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents) GROUP BY ALL)"
_TERMS = f", terms AS (SELECT DISTINCT item_id AS query_id, unnest({_tokens('text')}) AS term FROM benchmark)"
_BM25 = _POSTINGS + _TERMS + """, lengths AS (SELECT doc_id, sum(tf) AS length FROM postings GROUP BY doc_id), averages AS (SELECT count(*) AS docs, avg(length) AS al FROM lengths), dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))), 9) AS score FROM terms JOIN postings USING (term) JOIN dfs USING (term) JOIN lengths USING (doc_id), averages GROUP BY ALL),
lexical AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)"""


def lexical(v: Views, limit: int = 10):
    return R.bm25(query_terms(v), postings(v), limit)


@query("SELECT term, 'body' AS field, doc_id, tf FROM postings", _POSTINGS)
def build_postings(v: Views):
    return R.build_postings(v.documents)


@query("SELECT term, count(*) AS df FROM postings GROUP BY term", _POSTINGS)
def corpus_stats(v: Views):
    return R.corpus_stats(R.build_postings(v.documents))[0].drop("field")


@query("SELECT query_id, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM lexical WHERE rank <= 10", _BM25)
def bm25(v: Views):
    return lexical(v).withColumn("score", F.round("score", 6))


@query("SELECT DISTINCT query_id, t.term, p.term AS matched, doc_id FROM terms t JOIN postings p ON starts_with(p.term, t.term) WHERE length(t.term) BETWEEN 3 AND 12", _POSTINGS + _TERMS)
def prefix_match(v: Views):
    return R.prefix_match(query_terms(v), postings(v))


@query("SELECT DISTINCT query_id, t.term, p.term AS matched FROM terms t, (SELECT DISTINCT term FROM postings) p WHERE length(t.term) >= 3 AND length(p.term) >= 2 AND damerau_levenshtein(t.term, p.term) = 1", _POSTINGS + _TERMS)
def fuzzy_match(v: Views):
    return R.fuzzy_match(query_terms(v), postings(v))


_COSINE = """pairs AS (SELECT q.vec_id AS query_id, d.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 9) AS similarity FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0),
nearest AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM pairs WHERE similarity > 0)"""


def nearest(v: Views, k: int = 10):
    return R.cosine_top_k(v.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.embeddings, k)


@query("SELECT query_id, vec_id, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM nearest WHERE rank <= 10", _COSINE)
def cosine_top_k(v: Views):
    return nearest(v).withColumn("similarity", F.round("similarity", 6))


def vector_queries(v: Views):
    """The vector of each benchmark item: the one of its number."""
    return v.benchmark.select(F.col("item_id").alias("query_id")).join(v.embeddings, F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")


def document_vectors(v: Views):
    """A vector is its document's."""
    return v.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")


_VECTOR = """, pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 9) AS similarity FROM embeddings q JOIN benchmark ON item_id = q.vec_id, embeddings d),
vector AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM pairs WHERE similarity > 0)"""


def _rrf(deep: int) -> str:
    return _BM25 + _VECTOR + f""", fused AS (SELECT query_id, doc_id, round(sum(part) * 30.5, 9) AS score, CASE WHEN count(*) > 1 THEN 'both' ELSE min(source) END AS source FROM (SELECT query_id, doc_id, 1 / (60 + rank) AS part, 'bm25' AS source FROM lexical WHERE rank <= {deep}
  UNION ALL SELECT query_id, doc_id, 1 / (60 + rank), 'vector' FROM vector WHERE rank <= {deep}) GROUP BY ALL)"""


@query("SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM fused) WHERE rank <= 10", _rrf(10))
def fuse_ranked(v: Views):
    return R.rrf(lexical(v), R.cosine_top_k(vector_queries(v), document_vectors(v), 10, key="doc_id"))


@query("""SELECT query_id, doc_id, score, source, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
  (SELECT query_id, doc_id, round(0.7 * score + 0.3 * coalesce(quality, 0) / 0.55, 9) AS score, source FROM fused LEFT JOIN labels USING (doc_id))) WHERE rank <= 10""", _rrf(30))
def hybrid_search(v: Views):
    return R.hybrid_search(query_terms(v), postings(v), vector_queries(v), document_vectors(v), v.labels.select("doc_id", "quality"))


@query()
def approx_top_k(v: Views):
    """Every vector is in the index; the queries are those whose id is divisible by 50."""
    q = v.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.approx_top_k(q, v.embeddings, 10).withColumn("similarity", F.round("similarity", 6))


@query("SELECT count(*) AS neighbours, count(DISTINCT query_id) AS queries, true AS nine_tenths_found, true AS a_tenth_compared FROM nearest WHERE rank <= 10", _COSINE)
def approx_recall(v: Views):
    """What approx_top_k finds of the exact ten nearest, and what it compares for that."""
    q = v.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = R.VectorIndex(v.embeddings)
    found = index.search(q, 10).select("query_id", "vec_id", F.lit(True).alias("found"))
    compared = index.candidates(q.select("query_id", F.col("embedding").alias("q"))).agg(F.count("*").alias("pairs"))
    rows = nearest(v).join(found, ["query_id", "vec_id"], "left").agg(F.count("*").alias("neighbours"), F.countDistinct("query_id").alias("queries"), F.count("found").alias("found"))
    all_pairs = v.embeddings.agg(F.count("*").alias("vectors"))
    # one row each
    rows = rows.join(F.broadcast(compared), F.lit(True)).join(F.broadcast(all_pairs), F.lit(True))
    return rows.select("neighbours", "queries", (F.col("found") >= 0.9 * F.col("neighbours")).alias("nine_tenths_found"),
                       (F.col("pairs") <= 0.1 * F.col("queries") * F.col("vectors")).alias("a_tenth_compared"))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS slot, vec_id, len(embedding) AS dims FROM embeddings WHERE vec_id % 5 <> 0")
def compact_vectors(v: Views):
    return R.compact_vectors(v.embeddings.withColumn("deleted", F.col("vec_id") % 5 == 0)).select("slot", "vec_id", F.size("embedding").cast("long").alias("dims"))


@query("""SELECT query_id, doc_id, round((score - low) / greatest(high - low, 0.001), 6) AS norm FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS low, max(score) OVER (PARTITION BY query_id) AS high FROM lexical WHERE rank <= 10)""", _BM25)
def min_max(v: Views):
    return min_max_normalise(lexical(v), ["query_id"]).select("query_id", "doc_id", F.round("norm", 6).alias("norm"))


@query("SELECT query_id, source, doc_id FROM (SELECT query_id, source, doc_id, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS r FROM lexical JOIN documents USING (doc_id) WHERE rank <= 10) WHERE r = 1", _BM25)
def dedupe_hits(v: Views):
    hits = lexical(v).join(v.documents.select("doc_id", "source"), "doc_id")
    return dedupe_best(hits, ["query_id", "source"], ties=("doc_id",)).select("query_id", "source", "doc_id")


@query("SELECT * FROM (SELECT query_id, doc_id, round(score * 0.7 + 0.3 * coalesce(quality, 0) / 0.55, 6) AS score FROM lexical LEFT JOIN labels USING (doc_id) WHERE rank <= 10)", _BM25)
def quality_rerank(v: Views):
    hits = lexical(v).drop("rank").join(v.labels, "doc_id", "left").fillna(0, ["quality"])
    return R.quality_rerank(hits, None).select("query_id", "doc_id", F.round("score", 6).alias("score"))


@query("""SELECT query_id, round(CASE WHEN relevant IS NULL THEN 1.0 ELSE coalesce(1 / first, 0) END, 6) AS mrr, round(CASE WHEN relevant IS NULL THEN 1.0 ELSE coalesce(found / 10, 0) END, 6) AS p_at_k, round(CASE WHEN relevant IS NULL THEN 1.0 ELSE coalesce(found / relevant, 0) END, 6) AS r_at_k
  FROM (SELECT DISTINCT query_id FROM scored) LEFT JOIN (SELECT query_id, count(*) AS relevant FROM judged GROUP BY 1) USING (query_id)
  LEFT JOIN (SELECT query_id, count(*) AS found, min(rank) AS first FROM lexical JOIN judged USING (query_id, doc_id) WHERE rank <= 10 GROUP BY 1) USING (query_id)""",
       _BM25 + ", judged AS (SELECT query_id, doc_id FROM (SELECT DISTINCT query_id FROM terms), labels WHERE quality = 1 AND (doc_id + query_id) % 7 = 0)")
def retrieval_metrics(v: Views):
    queries = query_terms(v).select("query_id").distinct()
    judged = v.labels.where("quality = 1").join(queries, (F.col("doc_id") + F.col("query_id")) % 7 == 0).select("query_id", "doc_id")
    rows = E.retrieval_metrics(lexical(v), judged, 10)
    return rows.select("query_id", *[F.round(c, 6).alias(c) for c in ("mrr", "p_at_k", "r_at_k")])


_ANSWERS = """answers AS (SELECT doc_id AS id, lower(text) AS t, ['the', 'and', 'zzz', lang] AS facts, doc_id % 3 AS wrong FROM documents),
scores AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM (SELECT id, found, wrong, CASE WHEN found + wrong > 0 THEN found / (found + wrong) ELSE 0.0 END AS precision, found / 4 AS recall FROM
  (SELECT id, wrong, CAST(len(list_filter(facts, lambda f: contains(t, f))) AS INT) AS found FROM answers)))"""


def answers(v: Views):
    return E.score_answers(v.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("response"), F.array(F.lit("the"), F.lit("and"), F.lit("zzz"), F.col("lang")).alias("facts"), (F.col("doc_id") % 3).alias("wrong")))


@query("SELECT id, found, wrong, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM scores", _ANSWERS)
def score_answers(v: Views):
    return answers(v).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("""SELECT count(*) AS questions, round(avg(f1), 6) AS mean_f1, count_if(f1 >= 1) AS perfect, count_if(f1 = 0) AS zero, avg(id % 97) AS mean_latency, max(id % 97) AS max_latency, quantile_disc(id % 97, 0.95)::DOUBLE AS p95_latency,
  round(sum(wrong) / count(*), 6) AS hallucination_rate, round(count_if(wrong > 0) / count(*), 6) AS hallucinated_share FROM scores""", _ANSWERS)
def benchmark_aggregate(v: Views):
    rows = E.benchmark_aggregate(answers(v).withColumn("latency_ms", F.col("id") % 97)).withColumn("p95_latency", F.col("p95_latency").cast("double"))
    return rows.withColumns({c: F.round(c, 6) for c in ("mean_f1", "hallucination_rate", "hallucinated_share")})


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def correlation(v: Views):
    return E.correlation(v.lineitem, "l_quantity", "l_extendedprice").withColumn("r", F.round("r", 6))


_CITED = """said AS (SELECT conv_id * 100 + turn AS id, text || ' see src/m' || (conv_id % 7) || '/f' || turn || '.py and docs/a' || (turn % 3) || '.md' AS response FROM conversations), known AS (SELECT DISTINCT 'src/m' || (p_partkey % 5) || '/f' || (p_size % 4) || '.py' AS path FROM part)"""


def said(v: Views):
    c, t = F.col("conv_id"), F.col("turn")
    return v.conversations.select((c * 100 + t).alias("id"), F.concat("text", F.lit(" see src/m"), c % 7, F.lit("/f"), t, F.lit(".py and docs/a"), t % 3, F.lit(".md")).alias("response"))


@query("""SELECT id, count(path) AS cited, count(k) AS existing, round(count(k) / count(path), 6) AS precision FROM (SELECT DISTINCT id, unnest(regexp_extract_all(response, '(?:src|crates|lib|bin|docs|tests|tools|examples)/[A-Za-z0-9_/.-]+\\.[A-Za-z0-9_]+')) AS path FROM said)
  LEFT JOIN (SELECT path, 1 AS k FROM known) USING (path) GROUP BY id""", _CITED)
def citation_precision(v: Views):
    files = v.part.select(F.concat(F.lit("src/m"), F.col("p_partkey") % 5, F.lit("/f"), F.col("p_size") % 4, F.lit(".py")).alias("path"))
    return E.citation_precision(said(v), files).withColumn("precision", F.round("precision", 6))


_TRUTH = [("keyword", "the"), ("keyword", "reation"), ("symbol", "and"), ("symbol", "of"), ("file", "src/m1/f1.py"), ("file", "lib/f2.py")]


@query("""SELECT id, keyword_recall, file_recall, symbol_recall, round(0.4 * keyword_recall + 0.3 * file_recall + 0.3 * symbol_recall, 6) AS coverage FROM (SELECT id, """ + ", ".join(f"avg(CASE WHEN kind = '{k}' THEN hit END) AS {k}_recall" for k in ("keyword", "file", "symbol")) + """ FROM
  (SELECT id, kind, CASE WHEN kind = 'file' THEN contains(response, string_split(value, '/')[-1]) WHEN kind = 'symbol' THEN regexp_matches(response, '\\b' || value || '\\b') WHEN length(value) <= 6 THEN regexp_matches(response, '(?i)\\b' || value || '\\b') ELSE contains(lower(response), value) END::INT AS hit
    FROM (SELECT doc_id AS id, text || ' see m' || doc_id % 5 || '/f' || doc_id % 3 || '.py' AS response FROM documents), (VALUES """ + ", ".join(map(str, _TRUTH)) + """) t(kind, value)) GROUP BY id)""")
def coverage_scores(v: Views):
    truth = v.spark.createDataFrame(_TRUTH, "kind string, value string")
    docs = v.documents.select(F.col("doc_id").alias("id"), F.concat("text", F.lit(" see m"), F.col("doc_id") % 5, F.lit("/f"), F.col("doc_id") % 3, F.lit(".py")).alias("response"))
    return E.coverage_scores(docs, docs.select("id").join(F.broadcast(truth), F.lit(True))).withColumn("coverage", F.round("coverage", 6))


@query("""SELECT query_id, round(coalesce(share, 1), 6)::DOUBLE AS file_hit FROM (SELECT DISTINCT query_id FROM terms) LEFT JOIN
  (SELECT query_id, avg(CASE WHEN EXISTS (SELECT 1 FROM lexical l WHERE l.query_id = w.query_id AND rank <= 5 AND contains('src/m' || l.doc_id % 7 || '/f.py', wanted)) THEN 1 ELSE 0 END) AS share FROM wanted w GROUP BY query_id) USING (query_id)""",
       _BM25 + ", wanted AS (SELECT DISTINCT query_id, unnest(['m' || query_id % 7 || '/f.py', 'src/m' || query_id % 3, 'none.py']) AS wanted FROM terms WHERE query_id % 5 > 0)")
def file_hit_at_k(v: Views):
    number, part = F.col("query_id"), lambda n: (F.col("query_id") % n).cast("string")
    queries = query_terms(v).select("query_id").distinct()
    files = queries.where(number % 5 > 0).select("query_id", F.explode(F.array(F.concat(F.lit("m"), part(7), F.lit("/f.py")), F.concat(F.lit("src/m"), part(3)), F.lit("none.py"))).alias("path"))
    hits = lexical(v).select("query_id", F.concat(F.lit("src/m"), (F.col("doc_id") % 7).cast("string"), F.lit("/f.py")).alias("path"), "rank")
    rows = queries.join(E.file_hit_at_k(hits, files, 5), "query_id", "left")
    return rows.select("query_id", F.round(F.coalesce("file_hit", F.lit(1.0)), 6).alias("file_hit"))


@query("SELECT round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS median, true AS mean_inside, true AS median_inside, true AS mean_width, true AS median_width FROM events")
def bootstrap_ci(v: Views):
    """The exact mean and median, and whether the intervals hold them and are about as wide as theory has it: 3.92 deviations of the
    mean, and for the median no wider than the middle tenth of the values."""
    mean = E.bootstrap_ci(v.events, "value").select(F.col("point").alias("mean"), F.col("low").alias("a"), F.col("high").alias("b"))
    median = E.bootstrap_ci(v.events, "value", statistic="median").select(F.col("point").alias("median"), F.col("low").alias("c"), F.col("high").alias("d"))
    spread = v.events.agg((3.92 * F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("width"), F.expr("percentile_disc(0.45) WITHIN GROUP (ORDER BY value)").alias("low"),
                          F.expr("percentile_disc(0.55) WITHIN GROUP (ORDER BY value)").alias("high"))
    # one row each
    rows = mean.join(F.broadcast(median), F.lit(True)).join(F.broadcast(spread), F.lit(True))
    return rows.select(F.round("mean", 6).alias("mean"), "median", F.col("mean").between(F.col("a"), F.col("b")).alias("mean_inside"), F.col("median").between(F.col("c"), F.col("d")).alias("median_inside"),
                       ((F.col("b") - F.col("a")) / F.col("width")).between(0.9, 1.1).alias("mean_width"), ((F.col("d") > F.col("c")) & (F.col("c") >= F.col("low")) & (F.col("d") <= F.col("high"))).alias("median_width"))


@query("SELECT round(avg(l_tax - l_discount) / stddev_samp(l_tax - l_discount), 6) AS d FROM lineitem")
def cohens_d_paired(v: Views):
    return E.cohens_d_paired(v.lineitem, "l_discount", "l_tax").withColumn("d", F.round("d", 6))


_PAIRED = "diffs AS (SELECT l_suppkey, l_linenumber * 2 - l_quantity AS d FROM lineitem WHERE l_linenumber * 2 <> l_quantity)"


@query("""SELECT l_suppkey, n, least(plus, minus) AS w, round((least(plus, minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) AS z FROM (SELECT l_suppkey, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS minus
  FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY abs(d)) + (count(*) OVER (PARTITION BY l_suppkey, abs(d)) - 1) / 2.0 AS r FROM diffs) GROUP BY l_suppkey)""", _PAIRED)
def wilcoxon_signed_rank(v: Views):
    rows = v.lineitem.select("l_suppkey", (F.col("l_linenumber") * 2).cast("double").alias("b"), F.col("l_quantity").alias("a"))
    return E.wilcoxon_signed_rank(rows, "a", "b", ["l_suppkey"]).withColumn("z", F.round("z", 6))


@query("SELECT s_suppkey, s_nationkey, rank() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000)) + (count(*) OVER (PARTITION BY s_nationkey, floor(s_acctbal / 1000)) - 1) / 2.0::DOUBLE AS rank FROM supplier")
def average_rank(v: Views):
    rows = v.supplier.select("s_suppkey", "s_nationkey", F.floor(F.col("s_acctbal") / 1000).alias("x"))
    return average_ranks(rows, ["s_nationkey"], "x").drop("x")


_RUNS = "a AS (SELECT l_suppkey AS metric, ['quality', 'rate', 'latency'][l_suppkey % 3 + 1] AS kind, round(avg(l_tax), 4) AS value FROM lineitem GROUP BY l_suppkey), b AS (SELECT l_suppkey AS metric, round(avg(l_discount), 4) AS value FROM lineitem GROUP BY l_suppkey)"


def runs(v: Views):
    kind = F.get(F.array(F.lit("quality"), F.lit("rate"), F.lit("latency")), (F.col("metric") % 3).cast("int"))
    g = v.lineitem.groupBy(F.col("l_suppkey").alias("metric"))
    a = g.agg(F.round(F.avg("l_tax"), 4).alias("value"))
    return a.withColumn("kind", kind), g.agg(F.round(F.avg("l_discount"), 4).alias("value"))


@query("""SELECT metric, a.value AS base, b.value AS candidate, CASE WHEN kind <> 'rate' AND a.value <= 0 THEN 'ok' WHEN kind = 'quality' THEN CASE WHEN a.value - b.value > 0.05 * a.value THEN 'regression' WHEN a.value - b.value < -0.05 * a.value THEN 'improved' ELSE 'ok' END
  ELSE CASE WHEN b.value - a.value > l THEN 'regression' WHEN b.value - a.value < -l THEN 'improved' ELSE 'ok' END END AS status FROM (SELECT *, CASE kind WHEN 'rate' THEN 0.05 ELSE 0.1 * value END AS l FROM a) a JOIN b USING (metric)""", _RUNS)
def compare_runs(v: Views):
    a, b = runs(v)
    return E.compare_runs(a, b)


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'removed' ELSE 'matched' END AS status, b.x - a.x AS delta FROM (SELECT c_custkey AS k, c_acctbal AS x FROM customer WHERE c_custkey % 3 <> 0) a
  FULL JOIN (SELECT c_custkey AS k, c_acctbal * 2 AS x FROM customer WHERE c_custkey % 4 <> 0) b ON a.k = b.k""")
def diff_results(v: Views):
    c = v.customer.select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("x"))
    return E.diff_results(c.where("k % 3 <> 0"), c.where("k % 4 <> 0").withColumn("x", F.col("x") * 2), "k", "x")


@query("""SELECT depth, max(CASE WHEN n = 0 THEN s END) AS "0", max(CASE WHEN n = 1 THEN s END) AS "1", max(CASE WHEN n = 2 THEN s END) AS "2" FROM (SELECT depth, n, min(CASE WHEN a AND b THEN 'FOUND' WHEN a OR b THEN 'PARTIAL' ELSE 'MISS' END) AS s FROM
  (SELECT user_id % 5 AS depth, event_id % 3 AS n, value > 20 AS a, event_type <> 'view' AS b FROM events) GROUP BY ALL) GROUP BY depth""")
def needle_matrix(v: Views):
    rows = v.events.select((F.col("user_id") % 5).alias("depth"), (F.col("event_id") % 3).alias("context_length"), (F.col("value") > 20).alias("found_codename"), (F.col("event_type") != "view").alias("found_key"))
    return E.needle_matrix(rows, [0, 1, 2])


@query("SELECT l_orderkey, CASE WHEN count(*) <= 1 THEN 1.0::DOUBLE ELSE 1 - (count(DISTINCT l_suppkey) - 1) / (count(*) - 1) END AS coherence FROM lineitem GROUP BY l_orderkey")
def coherence(v: Views):
    return E.coherence(v.lineitem, ["l_orderkey"], "l_suppkey")


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O' DESC, o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 5""")
def proposal_retention(v: Views):
    rows = v.orders.select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("proposal_id"), (F.col("o_orderstatus") == "O").alias("pending"), F.col("o_orderdate").alias("created"))
    return E.proposal_retention(rows, 5, ["o_custkey"]).select("o_orderkey")


@query("SELECT count(*) AS total, count_if(vec_id % 5 <> 0) AS active, count_if(vec_id % 5 = 0) AS deleted, CAST(max(len(embedding)) AS INT) AS dims, count_if(vec_id % 5 = 0) / count(*) AS tombstone_ratio FROM embeddings")
def vector_table_stats(v: Views):
    return R.vector_table_stats(v.embeddings.withColumn("deleted", F.col("vec_id") % 5 == 0))
