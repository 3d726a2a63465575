"""Tables written and read back: intermediate results in the shared folder, and versioned snapshots of derived tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A default is set where none is given, in local mode only: on a cluster
    a machine's own folder would leave each executor with files that no other sees."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there and a lost executor costs a re-read."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def replaced(old: DataFrame | None) -> None:
    """Delete a table from saved() that nothing reads any more, before the session ends."""
    if path := getattr(old, "_saved_at", None):
        at = old.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(old.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def save_corpus_snapshot(df: DataFrame, path: str, schema_version: int, deleted: str | None = "deleted") -> None:
    """Persist a derived table with its schema version; rows marked in `deleted` are left out."""
    rows = df if deleted is None or deleted not in df.columns else df.where(~F.coalesce(F.col(deleted), F.lit(False)))
    rows.withColumn("schema_version", F.lit(schema_version)).write.mode("overwrite").partitionBy("schema_version").parquet(path)


def read_corpus_snapshot(spark: SparkSession, path: str, schema_version: int) -> DataFrame:
    """The snapshot's rows; raises ValueError if it has another schema version and must be rebuilt."""
    rows = spark.read.parquet(path)
    found = [r[0] for r in rows.select("schema_version").distinct().limit(2).collect()]
    if found and found != [schema_version]:
        raise ValueError(f"snapshot has schema version {found}, {schema_version} is wanted: rebuild it")
    return rows.drop("schema_version")
