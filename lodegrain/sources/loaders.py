"""Loaders of files, logs and reports with fixed schemas, and the report sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Languages by extension.
LANGUAGES = {"rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript"}


def detect_language(path: F.Column) -> F.Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(*[F.when(extension == e, language) for e, language in LANGUAGES.items()])


def select_source_files(files: DataFrame, max_bytes: int | None = 1_048_576, max_files: int | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Of binaries (path, length, content): known extensions, at most max_bytes, valid UTF-8, no excluded pattern in the path;
    path, language, size, content. max_files keeps the first by path."""
    rows = files.withColumn("language", detect_language(F.col("path"))).where("language is not null")
    rows = rows if max_bytes is None else rows.where(F.col("length") <= max_bytes)
    rows = rows if not exclude else rows.where(~F.col("path").rlike("|".join(exclude)))
    rows = rows.where(F.is_valid_utf8(F.col("content").cast("string")))
    rows = rows.select("path", "language", F.col("length").alias("size"), F.col("content").cast("string").alias("content"))
    return rows if max_files is None else rows.orderBy("path").limit(max_files)


def load_source_files(spark: SparkSession, path: str, max_bytes: int | None = 1_048_576, max_files: int | None = None, exclude: list[str] | None = None) -> DataFrame:
    return select_source_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), max_bytes, max_files, exclude)


def load_commit_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """commits (commit_id, author, epoch, message: the first line) and commit_files (commit_id, path) of JSON lines."""
    rows = spark.read.schema("commit_id string, author string, epoch long, message string, paths array<string>").json(path)
    return rows.select("commit_id", "author", "epoch", F.split("message", "\n")[0].alias("message")), rows.select("commit_id", F.explode("paths").alias("path")).distinct()


def load_question_suite(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines without blank lines and # comments; the category is `general` where none is given; a bad line fails."""
    schema = "id string, question string, ground_truth array<string>, expected_files array<string>, expected_symbols array<string>, difficulty string, category string"
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    rows = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("q")).select("q.*")
    return rows.withColumn("category", F.coalesce("category", F.lit("general")))


def parse_diagnostics(lines: DataFrame) -> DataFrame:
    """Of compiler lines (value): reason compiler-message and a known level; level, code, message, the primary span's place
    (else the first's) and the children's replacements with their applicability."""
    span = "struct<file_name:string,line_start:int,line_end:int,is_primary:boolean,suggested_replacement:string,suggestion_applicability:string>"
    schema = f"reason string, message struct<level:string,message:string,code:struct<code:string>,spans:array<{span}>,children:array<struct<message:string,spans:array<{span}>>>>"
    rows = lines.select(F.from_json("value", schema).alias("m")).where("m.reason = 'compiler-message'").select("m.message.*").where(F.col("level").isin("error", "warning", "note", "help"))
    best = F.coalesce(F.get(F.filter("spans", lambda s: s["is_primary"]), F.lit(0)), F.get("spans", F.lit(0)))
    fixes = F.flatten(F.transform(F.coalesce("children", F.array().cast(rows.schema["children"].dataType)), lambda c: F.filter(c["spans"], lambda s: s["suggested_replacement"].isNotNull())))
    return rows.select("level", F.col("code.code").alias("code"), "message", best["file_name"].alias("path"), best["line_start"].alias("line"),
                       F.transform(fixes, lambda s: F.struct(s["suggested_replacement"].alias("replacement"), s["suggestion_applicability"].alias("applicability"))).alias("suggestions"))


def metadata_pseudo_docs(files: DataFrame, names: list[str], lines: int = 80) -> DataFrame:
    """path, body of the named metadata files: their first lines become searchable."""
    wanted = F.element_at(F.split("path", "/"), -1).isin(names)
    return files.where(wanted).select("path", F.array_join(F.slice(F.split("content", "\n"), 1, lines), "\n").alias("body"))


def load_rules(rules: DataFrame) -> DataFrame:
    """name, pattern, action, is_regex of rule rows; an empty pattern fails, and ( [ \\ + * make a pattern a regex."""
    checked = F.when(F.coalesce(F.col("pattern"), F.lit("")) == "", F.raise_error(F.concat(F.lit("rule without a pattern: "), "name"))).otherwise(F.col("pattern"))
    return rules.select("name", checked.alias("pattern"), "action", F.col("pattern").rlike(r"[(\[\\+*]").alias("is_regex"))


def load_result_history(spark: SparkSession, path: str) -> DataFrame:
    """kind, taken_at, payload of JSON result files: kind from the metadata, else the file's name; yyyyMMdd_HHmmss in the name."""
    rows = spark.read.option("wholetext", "true").text(path).select("value", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"))
    kind = F.coalesce(F.get_json_object("value", "$.metadata.kind"), F.regexp_extract("file", r"^([A-Za-z]+)", 1))
    return rows.select(kind.alias("kind"), F.try_to_timestamp(F.regexp_extract("file", r"(\d{8}_\d{6})", 1), F.lit("yyyyMMdd_HHmmss")).alias("taken_at"), F.col("value").alias("payload"))


def write_report(df: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """One JSON line per row: {"metadata": ..., "payload": row}."""
    meta = F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()])
    df.select(F.to_json(F.struct(meta.alias("metadata"), F.struct("*").alias("payload"))).alias("value")).write.mode("overwrite").text(path)
