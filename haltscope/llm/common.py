"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haltscope.session import work_dir

# A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column | str) -> Column:
    """Number of words of a text; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def without_space(text: Column) -> Column:
    """The text without ASCII white space."""
    for c in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


# Names a row of a table with keys; ``doc_id`` may be null or repeated.
ROW = "_row_key"


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key each, the same ones in every read.

    A table of Parquet files has them already: the file and the place in it.
    Anything else is written once with numbers.
    """
    tidy(docs.sparkSession)
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            return docs.withColumn(ROW, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
        except AnalysisException:  # files of another kind
            pass
    return stored(docs.withColumn(ROW, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "keyed")


def by_row(docs: DataFrame) -> DataFrame:
    """Keyed rows with a ``doc_id`` of their own each, in the order of ``doc_id`` (null last), then of the key."""
    return docs.withColumn("doc_id", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(ROW).alias("row")))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Keyed rows whose key is not in ``gone`` (_gone), without their keys."""
    return docs.join(gone, F.col(ROW) == F.col("_gone"), "left_anti").drop(ROW)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark: SparkSession = df.sparkSession
    folder = work_dir(spark, label)
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out.folder = folder
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove stored tables that nothing reads any more."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.folder)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now; it does so when their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """At the end of a task: return freed memory, as Spark keeps the worker for later tasks of any kind."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # no such call on this platform
        pass
