"""Language ID, exact and near deduplication, mixing and packing, one after the other over the documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodegrain.llm.common import replaced, saved
from lodegrain.llm.exact_dedup import keep_first
from lodegrain.llm.langid import LanguageModel
from lodegrain.llm.mixing import mixed_documents
from lodegrain.llm.near_dedup import keep_one_of_each
from lodegrain.llm.packing import cut_pieces, pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the classifier knows. Nulls, empty and very long texts, ties, repeated rows and other columns: as
    LanguageModel states; an empty table stays empty."""
    return LanguageModel(docs).in_known_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) keep the longest, then the least doc_id; null and empty texts are one group, rows repeated whole
    stay once, other columns pass."""
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at a similarity of 0.8 and more keep the least doc_id; null and wordless texts link
    with nothing and stay, other columns pass."""
    return keep_one_of_each(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their target weights; a null source is a source, a null text has no words,
    other columns pass."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every document, very long ones too, into pieces in sequences of 1,024 tokens; a null text is its end id alone, repeated rows
    are packed each, other columns are not read."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(cut_pieces(docs, path, "joined", end_id=0, capacity=1024), capacity=1024)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources),
          ("pack_sequences", pack_sequences)]

#: The classifier, MinHash, sampling by hash and the tokenizer have no SQL form; the test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's table saved for the next; a table goes when the next is there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, saved(stage(spark, docs, sf_dir), name)
        replaced(before)
    return STAGES[-1][1](spark, docs, sf_dir)
