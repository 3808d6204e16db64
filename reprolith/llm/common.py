"""Helpers that the training-data operators share: scratch tables, hashing, Arrow plumbing."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: ASCII white space only.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`, by any path that Spark can read."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch between JVM and Python, at most; texts may be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH where they are larger, so that workers hold little at a time."""
    for key, most in BATCH.items():
        try:
            now = spark.conf.get(key).removesuffix("b")
        except Exception as e:  # a Spark without that setting
            if "SQL_CONF_NOT_FOUND" not in str(e):
                raise
            continue
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset a temporary folder is made and set, on one machine (as in tests) only.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="reprolith-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    _made.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def scratch_count() -> int:
    """How many paths this process has made so far and not deleted."""
    return len(_made)


def clean_scratch(spark: SparkSession, since: int = 0, keep: str | None = None) -> int:
    """Delete what this process wrote to the shared folder, or after `since` paths, but for `keep`; call it when the results are stored elsewhere."""
    gone = [p for p in _made[since:] if p != keep]
    for path in gone:
        drop_path(spark, path)
        _made.remove(path)
    return len(gone)


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """`df` written once as parquet in the shared folder and read again: cuts the lineage there.

    A lost executor costs nothing that is written; later readers prune columns.
    """
    bounded_batches(df.sparkSession)
    path = path or scratch(df.sparkSession, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def text_bytes(column: str = "text"):
    """The column as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def batch_of(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
