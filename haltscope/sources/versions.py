"""Tables kept as versions of their day partitions.

A batch writes only the days it touches, to ``<root>/halt_day=.../batch=<id>``,
and then its log: one row per day with the batch that holds the day's content.
A reader takes the newest log and opens the folders of the days it wants, and
nothing else. A batch that is run again replaces its own folders and log; it
starts from the log of the batch before, which is why a day keeps its last
version until the next batch has been written. What no kept log names is
removed, so the number of folders follows the days, not the batches.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, IntegerType, StructField, StructType

LOG = "_log"
STEPS = "_steps"
_NO_DAY_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def files(spark: SparkSession, path: str):
    """The path in Hadoop's terms and its file system."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def batches(spark: SparkSession, folder: str) -> list[int]:
    """Batch numbers of the ``batch=`` entries of a folder."""
    where, fs = files(spark, folder)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[6:]) for n in names if n.startswith("batch="))


def _folder(day: date | None, batch: int) -> str:
    return f"halt_day={_NO_DAY_FOLDER if day is None else day.isoformat()}/batch={batch}"


def last_batch(spark: SparkSession, root: str) -> int | None:
    """The newest batch that has been written to the end."""
    return max(batches(spark, f"{root.rstrip('/')}/{LOG}"), default=None)


def current_days(spark: SparkSession, root: str, before_batch: int | None = None) -> dict[date | None, int]:
    """The batch that holds each day's content; one entry per day of the table."""
    root = root.rstrip("/")
    found = [b for b in batches(spark, f"{root}/{LOG}") if before_batch is None or b < before_batch]
    if not found:
        return {}
    where, fs = files(spark, f"{root}/{LOG}/batch={found[-1]}")
    stream = fs.open(where)
    try:
        lines = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()
    pairs = (line.split(" ") for line in lines)
    return {date.fromisoformat(day) if day != "-" else None: int(written) for day, written in pairs}


def _write_log(spark: SparkSession, root: str, batch_id: int, held: dict[date | None, int]) -> None:
    """A line per day. Written aside and renamed, so a log is there in full or not at all."""
    text = "".join(f"{'-' if day is None else day.isoformat()} {written}\n" for day, written in held.items())
    aside, fs = files(spark, f"{root}/{LOG}/_batch={batch_id}")
    stream = fs.create(aside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    where, _ = files(spark, f"{root}/{LOG}/batch={batch_id}")
    fs.delete(where, False)
    fs.rename(aside, where)


def read_current(
    spark: SparkSession, root: str, before_batch: int | None = None, schema: StructType | None = None,
    days: Iterable[date | None] | None = None,
) -> DataFrame:
    """The table, or some of its ``days``; ``before_batch`` hides that batch and later ones.

    With a ``schema`` (``halt_day`` included) a table without content can be read.
    """
    root = root.rstrip("/")
    held = current_days(spark, root, before_batch)
    wanted = held if days is None else {d: held[d] for d in set(days) if d in held}
    if not wanted:
        if schema is None:
            known = next(iter(held.items()), None)
            if known is None:
                raise FileNotFoundError(f"no batch in {root}")
            return read_current(spark, root, before_batch, None, [known[0]]).filter(F.lit(False))
        return no_rows(spark, schema)
    paths = [f"{root}/{_folder(d, b)}" for d, b in sorted(wanted.items(), key=lambda x: (x[0] is not None, x[0] or date.min))]
    reader = spark.read.option("basePath", root)
    if schema is not None:
        own = [f for f in schema.fields if f.name != "halt_day"]
        reader = reader.schema(StructType([*own, StructField("halt_day", DateType()), StructField("batch", IntegerType())]))
    rows = reader.parquet(*paths).drop("batch")
    rows = rows.withColumn("halt_day", F.col("halt_day").cast("date"))
    return rows if schema is None else rows.select(*schema.names)


def no_rows(spark: SparkSession, schema: StructType | str) -> DataFrame:
    """A table without rows that the optimizer knows to be empty: joins with it need no job."""
    return spark.createDataFrame([], schema).limit(0)


def day_list(rows: DataFrame) -> list[date | None]:
    """The days of ``rows``, on the driver: as many as the calendar has."""
    return [r.halt_day for r in rows.select("halt_day").distinct().collect()]


def with_day(rows: DataFrame, ts_col: str = "halt_start") -> DataFrame:
    return rows.withColumn("halt_day", F.to_date(ts_col))


def write_batch(rows: DataFrame, root: str, batch_id: int, touched: Iterable[date | None] | None = None) -> None:
    """Replace the days of ``rows`` (which carry ``halt_day``) with ``rows``.

    ``touched`` days that ``rows`` does not have end up empty. Rebalancing
    gathers a day into few files; AQE still splits a very large day.
    """
    spark, root = rows.sparkSession, root.rstrip("/")
    held = current_days(spark, root, batch_id)
    (rows.withColumn("batch", F.lit(batch_id)).hint("rebalance", F.col("halt_day"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("halt_day", "batch").parquet(root))
    written = _written(spark, root, batch_id)
    for day in touched or ():
        held.pop(day, None)
    held |= {day: batch_id for day in written}
    _write_log(spark, root, batch_id, held)
    _retire(spark, root, batch_id)


def write_step(rows: DataFrame, root: str, batch_id: int, name: str) -> DataFrame:
    """An intermediate table of a batch, written once and read back.

    Plans behind it run none of its work again and know its size; a persisted
    table would keep the partitions of the stream's plan in all of them.
    """
    path = f"{root.rstrip('/')}/{STEPS}/batch={batch_id}/{name}"
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def forget_steps(spark: SparkSession, root: str, batch_id: int) -> None:
    where, fs = files(spark, f"{root.rstrip('/')}/{STEPS}/batch={batch_id}")
    fs.delete(where, True)


def _written(spark: SparkSession, root: str, batch_id: int) -> list[date | None]:
    """Days whose folder has this batch's version: two listings, whatever the number of batches."""
    where, fs = files(spark, f"{root}/halt_day=*/batch={batch_id}")
    names = [s.getPath().getParent().getName()[9:] for s in fs.globStatus(where) or []]
    return [None if n == _NO_DAY_FOLDER else date.fromisoformat(n) for n in names]


def _retire(spark: SparkSession, root: str, batch_id: int) -> None:
    """Remove the versions and logs that neither this batch nor the one before needs."""
    logs = [b for b in batches(spark, f"{root}/{LOG}") if b <= batch_id]
    keep = logs[-2:]
    needed = {_folder(d, b) for k in keep for d, b in current_days(spark, root, k + 1).items()}
    where, fs = files(spark, f"{root}/halt_day=*/batch=*")
    for s in fs.globStatus(where) or []:
        path = s.getPath()
        batch = int(path.getName()[6:])
        if batch <= batch_id and f"{path.getParent().getName()}/{path.getName()}" not in needed:
            fs.delete(path, True)
    for old in logs[:-2]:
        fs.delete(files(spark, f"{root}/{LOG}/batch={old}")[0], True)
