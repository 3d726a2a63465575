"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior: how likely each language makes the text (byte trigrams, from a classifier
fitted on a bounded sample of labelled rows), the language that markup declares, the suffix of the address, and a prior of
the host. The last three are learned from the corpus itself by grouped aggregation: what the text says of each row is
counted per markup value, suffix, host and domain; a host's prior leans on its domain's, and a domain's on the corpus, the
more the fewer rows it has.

Neighbouring trigrams are not independent, so a text of n trigrams counts as n / sqrt(1 + n / `independent`) of them: all
are read, and more text is always more evidence. Counts and statistics cover all rows; only the classifier sees a sample.

Defined cases: null text and text without letters have no text evidence, language `und`, confidence 0, and are rejected;
a missing markup value, suffix or host is no evidence; if no row has a label there are no languages and all is `und`, and
texts with letters are kept; ties go to the first language by code point; repeated rows are judged alike; a null doc_id
passes through; an empty table gives an empty result; other columns pass through `in_known_language` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, few, saved, seeded_hash, shipped, text_key, text_or_empty

BUCKETS = 1 << 16


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-case text."""
    b = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))) >> np.uint32(16)


def fitted(docs: DataFrame, text: str, label: str, sample_rows: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (bucket, language), from the `sample_rows` labelled rows of least seeded hash: every
    language of the sample, which bounds them; each takes 256 KB."""
    h = seeded_hash(seed, "doc_id")
    least = docs.where(F.col(label).isNotNull()).select(h.alias("h")).orderBy("h").limit(sample_rows).agg(F.max("h")).first()[0]
    if least is None:
        return [], np.zeros((BUCKETS, 0), np.float32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch["label"].to_pylist(), batch["text"]):
                own = counts.setdefault(name, np.zeros(BUCKETS, np.int64))
                own += np.bincount(trigrams(t.as_py()), minlength=BUCKETS)
        for name, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(own[at])], names=["label", "bucket", "n"])

    sample = docs.where(F.col(label).isNotNull() & (h <= F.lit(least))).select(F.col(label).cast("string").alias("label"), text_or_empty(text).alias("text"))
    # each task sums up what it reads; what the sample's rows hold is all that reaches the driver
    rows = sample.mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(r[0] for r in sample.select("label").distinct().collect())
    counts = np.full((BUCKETS, len(names)), 0.1)
    place = {x: i for i, x in enumerate(names)}
    counts[rows["bucket"].to_numpy(), [place[x] for x in rows["label"].to_pylist()]] += rows["n"].to_numpy()
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def likelihoods(text: str, model: np.ndarray, independent: float) -> list[float]:
    """Log likelihood of a text per language."""
    at, total = trigrams(text), np.zeros(model.shape[1])
    for i in range(0, len(at), 1 << 16):
        total += model[at[i : i + (1 << 16)]].sum(axis=0, dtype=np.float64)
    return (total / np.sqrt(1 + len(at) / independent)).tolist()


def with_likelihoods(rows: DataFrame, model: np.ndarray, independent: float) -> DataFrame:
    """rows have doc_id, row_key, address, declared, letters (whether the text has any) and text; ll, null without letters,
    takes the place of the last two."""
    names = ["doc_id", "row_key", "address", "declared"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ll = [likelihoods(t.as_py(), model, independent) if x else None for x, t in zip(batch["letters"].to_pylist(), batch["text"])]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(ll, pa.list_(pa.float64()))], names=[*names, "ll"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(read, ", ".join(f"{n} {kinds[n]}" for n in names) + ", ll array<double>")


def addressed(rows: DataFrame, address: Column, markup: Column) -> DataFrame:
    """Add host, domain (its last two labels), suffix (the last, where there are two) and markup. An address that is no
    URL is a host itself."""
    host = F.lower(F.coalesce(F.nullif(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")), address))
    rows = rows.withColumn("host", host)
    domain = F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit(""))
    suffix = F.nullif(F.regexp_extract("host", r"\.([^.]+)$", 1), F.lit(""))
    return rows.withColumns({"domain": domain, "suffix": suffix, "markup": F.lower(markup)})


def declared_markup(text: Column) -> Column:
    """The language that an html element in the text declares, or null."""
    return F.nullif(F.regexp_extract(text, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1), F.lit(""))


def visible_text(html: Column) -> Column:
    """The text of a page: no scripts, styles, comments or tags."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")


def priors(rows: DataFrame, languages: list[str], strength: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Log evidence per host, markup value and suffix, as arrays over the languages; rows have best, the text's choice."""
    n = len(languages)
    per = lambda key: rows.where(F.col("best").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(
        F.array(*[F.count_if(F.col("best") == i).cast("double") for i in range(n)]).cast("array<double>").alias("counts"))
    whole = rows.agg(*[F.count_if(F.col("best") == i).alias(f"n{i}") for i in range(n)]).first() if n else ()
    total = sum(whole) + n
    overall = F.array(*[F.lit((c + 1) / total) for c in whole]).cast("array<double>")
    smooth = lambda counts, onto: F.transform(counts, lambda c, i: (c + F.lit(strength) * F.get(onto, i)) / (
        F.aggregate(counts, F.lit(0.0), lambda t, x: t + x) + F.lit(strength)))
    domains = per("domain").select("domain", smooth(F.col("counts"), overall).alias("of_domain"))
    hosts = per("host").withColumn("domain", F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit("")))
    hosts = hosts.join(domains, "domain", "left").withColumn("onto", F.coalesce("of_domain", overall))
    log = lambda c: F.transform(c, lambda x: F.log(x))
    hosts = hosts.select("host", log(smooth(F.col("counts"), F.col("onto"))).alias("by_host"))

    def given(key: str) -> DataFrame:
        # P(value | language), up to a factor that all languages share
        share = F.transform("counts", lambda c, i: F.log((c + F.lit(0.5)) / F.get(F.array(*[F.lit(float(x + 1)) for x in whole]).cast("array<double>"), i)))
        return per(key).select(key, share.alias(f"by_{key}"))

    return saved(hosts, "hosts"), saved(given("markup"), "markup"), saved(given("suffix"), "suffix")


def fused(rows: DataFrame, languages: list[str], tables: tuple[DataFrame, DataFrame, DataFrame], least_confidence: float, most_broadcast: int) -> DataFrame:
    """Add language, confidence and kept to rows with ll, host, markup and suffix. Tables of markup and suffixes of up to
    `most_broadcast` numbers are broadcast, by their count; larger ones are shuffled."""
    hosts, *values = tables
    rows = rows.join(hosts, "host", "left")
    for key, table in zip(("markup", "suffix"), values, strict=True):
        rows = rows.join(few(table, most_broadcast // max(len(languages), 1)), key, "left")
    none = F.array_repeat(F.lit(0.0), len(languages))
    score = F.col("ll")
    for by in ("by_host", "by_markup", "by_suffix"):
        score = F.zip_with(score, F.coalesce(by, none), lambda x, y: x + y)
    rows = rows.withColumn("score", score).withColumn("top", F.array_max("score"))
    mass = F.aggregate("score", F.lit(0.0), lambda t, x: t + F.exp(x - F.col("top")))
    names = F.array(*[F.lit(x) for x in languages]) if languages else F.array().cast("array<string>")
    language = F.get(names, (F.array_position("score", F.col("top")) - 1).cast("int"))
    rows = rows.withColumn("language", F.coalesce(language, F.lit("und"))).withColumn("confidence", F.coalesce(F.try_divide(F.lit(1.0), mass), F.lit(0.0)))
    kept = F.col("ll").isNotNull() & (F.lit(not languages) | (F.col("confidence") >= least_confidence))
    return rows.withColumn("kept", kept).drop("score", "top", "by_host", "by_markup", "by_suffix", "ll", "best")


class LanguageModel:
    """A classifier and the tables of evidence, learned from one table of rows: `address` is the column with a URL or
    host, `markup` the one whose html element is looked at (by default the text). The classifier is fitted on `labelled`
    (by default the table itself); the tables of evidence are always learned from the rows that are judged."""

    def __init__(self, docs: DataFrame, text: str = "text", label: str = "lang", address: str | None = "source", markup: str | None = None, labelled: DataFrame | None = None,
                 sample_rows: int = 4000, independent: float = 60.0, strength: float = 20.0,
                 least_confidence: float = 0.5, most_broadcast: int = 320_000, seed: int = 42) -> None:
        shipped(docs.sparkSession)
        self.text, self.address, self.markup, self.least, self.most_broadcast = text, address, markup or text, least_confidence, most_broadcast
        self.languages, self.model = fitted(docs if labelled is None else labelled, text, label, sample_rows, seed)
        whole = F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}")
        rows = docs.select("doc_id", self.row_key().alias("row_key"), self.given_address().alias("address"), declared_markup(F.col(self.markup)).alias("declared"),
                           F.coalesce(whole, F.lit(False)).alias("letters"), text_or_empty(text).alias("text"))
        rows = addressed(with_likelihoods(rows, self.model, independent), F.col("address"), F.col("declared")).drop("address", "declared")
        best = F.when(F.size("ll") > 0, F.array_position("ll", F.array_max("ll")) - 1)
        with arrow_batches(docs.sparkSession):
            self.rows = saved(rows.withColumn("best", best.cast("int")), "evidence")
        self.tables = priors(self.rows, self.languages, strength)

    def given_address(self) -> Column:
        return (F.col(self.address) if self.address else F.lit(None)).cast("string")

    def row_key(self) -> Column:
        """All of a row that its verdict rests on."""
        at = self.given_address()
        return F.md5(F.concat(text_key(self.text), text_key(self.markup), at.isNull().cast("string"), F.coalesce(at, F.lit(""))).cast("binary"))

    def judged(self) -> DataFrame:
        """One row per document, no text: doc_id, language, confidence, kept, host, markup, suffix."""
        return self.fused().drop("domain", "row_key")

    def fused(self) -> DataFrame:
        return fused(self.rows, self.languages, self.tables, self.least, self.most_broadcast)

    def in_known_language(self, docs: DataFrame) -> DataFrame:
        """The rows that are not rejected, all columns. Texts are read again, and not classified: rows of one doc_id, text,
        markup and address share their verdict."""
        rejected = saved(self.fused().where("not kept").select(F.col("doc_id").alias("id"), F.col("row_key").alias("key")).distinct(), "rejected")
        rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("i"), self.row_key().alias("k"))
        return rows.join(few(rejected, 200_000), F.col("i").eqNullSafe(F.col("id")) & (F.col("k") == F.col("key")), "left_anti").select("row.*")
