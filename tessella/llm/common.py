"""Helpers shared by the corpus operators: shared storage, checkpoints, text columns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can reach (``spark.checkpoint.dir``).

    A folder of its own is made only where the setting is missing and Spark runs in one process.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not (conf.get("spark.master", "") or "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = getattr(spark.sparkContext, "_tessella_shared_dir", None)
        if path is None:
            path = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext._tessella_shared_dir = path
    return path.rstrip("/")


_made: list[str] = []  # paths handed out in this process and not removed


def fresh_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> list[str]:
    return list(_made)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that were passed between jobs and are read no more."""
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        if path in _made:
            _made.remove(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python in batches of 4 MB, as rows differ in length by orders; a size set in the session stays."""
    if str(spark.conf.get(ARROW_BYTES)).rstrip("bB") in ("67108864", "64M"):
        spark.conf.set(ARROW_BYTES, f"{BATCH_BYTES}b")


def write_and_forget(df: DataFrame, path: str) -> DataFrame:
    """Write a table between two jobs, free the first job's shuffle files, and read the table."""
    spark = df.sparkSession
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    if before is not None:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.parquet(path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so that extra or clashing columns never matter.

    A null text becomes the empty text; a null id stays null.
    """
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def trim_memory() -> None:
    """Give freed memory of a task's Python worker back, as workers live on between stages."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def parts_for(rows: int, rows_a_part: int, least: int = 1) -> int:
    return max(least, -(-rows // rows_a_part))
