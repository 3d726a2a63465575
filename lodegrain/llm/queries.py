"""The dealt operators as queries over the supplied tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chat_windows, read_back
from .common import WORD
from .exact_dedup import exact_duplicates
from .flac import media_summary
from .langid import LanguageModel, visible_text
from .lexical import lexical_search
from .mixing import mix
from .near_dedup import near_duplicates
from .packing import cut_pieces, pack
from .private_data import personal_data, personal_data_summary
from .records import read_token_records, write_token_records
from .repeats import run_summary
from .sharding import interleaved_shards
from .warc import read_archives, write_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(table(spark, sf_dir, "pages"), least_bytes=0), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(cut_pieces(table(spark, sf_dir, "documents"), path, "joined", end_id=0, capacity=1024), capacity=1024)


def op4_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interleaved_shards(table(spark, sf_dir, "documents"), shards=40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op5_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_summary(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LanguageModel(table(spark, sf_dir, "documents")).judged().select("doc_id", "language", F.round("confidence", 6).alias("confidence"), "kept")


def op6_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), visible_text(F.col("html")).alias("text"), "url", "html")
    model = LanguageModel(pages, address="url", markup="html", labelled=table(spark, sf_dir, "documents"))
    return model.judged().select(F.col("doc_id").alias("page_id"), "language", F.round("confidence", 6).alias("confidence"), "kept", "host", "markup", "suffix")


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", ok), (-1, 1, "assistant", ok)], "conv_id long, turn long, role string, text string")
    return read_back(chat_windows(table(spark, sf_dir, "conversations").select(*extra.columns).union(extra), public_tokenizers.path("byte_bpe_50k.json")))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return read_token_records(write_token_records(table(spark, sf_dir, "documents"), path, "dropped", end_id=1), with_ids=False)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts (by a hash of the id) with their last words repeating with a period of their own."""
    words = docs.select("doc_id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), F.crc32(F.col("doc_id").cast("string")).alias("h"))
    words = words.withColumns({"n": F.size("words"), "g": F.expr("h div 10")}).withColumn("a", F.expr("if(n > 0, g % n, 0)"))
    words = words.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    planted = "array_join(transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p as int)])), ' ')"
    return words.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.expr(planted)).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_summary(with_periods(table(spark, sf_dir, "documents")), least=6, times=4)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_summary(personal_data(table(spark, sf_dir, "documents")))


QUERIES = {q.__name__: q for q in (op1_warc_archives, op2_mix_sources, op3_pack_documents, op4_interleaved_shards, op5_flac_media, op6_language_id, op6_language_id_pages, op7_chat_windows, op8_minhash_near_dedup, op9_exact_dedup, op10_token_records,
                                op11_lexical_search, op12_periodic_runs, op13_personal_data)}

ORACLES = {
    "op9_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)
""",
    "op11_lexical_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
sized AS (SELECT r, doc_id, len(terms)::BIGINT AS n, terms FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS lens FROM sized),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM sized) GROUP BY r, term),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
           FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
scored AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // lens))))::BIGINT AS score
  FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN sized USING (r), total
  GROUP BY item_id, r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
""",
}
