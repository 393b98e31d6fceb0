"""Minute bars as a stream: tumbling buckets, the day so far, closed buckets with corrections."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from haltscope.functions.times import bucket_start, plus_minutes
from haltscope.sources.versions import batches, files


def _timed(bars: DataFrame, delay: str) -> DataFrame:
    # A watermark needs an instant; the wall clock is read in the session zone.
    return bars.withColumn("_t", F.col("bar_start").cast("timestamp")).withWatermark("_t", delay)


def stream_bars_tumbling(bars: DataFrame, minutes: int, delay: str = "10 minutes") -> DataFrame:
    """Buckets of ``minutes``: append mode emits closed ones only, update mode also the running one.

    Buckets are midnight-aligned when the session zone is UTC and ``minutes``
    divides a day.
    """
    return (
        _timed(bars, delay)
        .groupBy("ticker", F.window("_t", f"{minutes} minutes").alias("_w"))
        .agg(
            F.min_by("open", "bar_start").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "bar_start").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select(
            "ticker",
            F.col("_w.start").cast("timestamp_ntz").alias("bucket_start"),
            F.col("_w.end").cast("timestamp_ntz").alias("bucket_end"),
            "open", "high", "low", "close", "volume",
        )
    )


def point_in_time_features(bars: DataFrame, delay: str = "1 day") -> DataFrame:
    """The day so far per ticker; run it in update mode."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / F.lit(3) * F.col("volume")
    return (
        _timed(bars, delay)
        .groupBy("ticker", F.window("_t", "1 day").alias("_w"))
        .agg(
            F.count(F.lit(1)).alias("visible_bars"),
            F.max("bar_start").alias("last_bar"),
            F.max("high").alias("session_high"),
            F.min("low").alias("session_low"),
            F.sum("volume").alias("session_volume"),
            (F.sum(typical) / F.nullif(F.sum("volume"), F.lit(0))).alias("vwap"),
        )
        .select(
            "ticker", F.to_date("_w.start").alias("trading_day"), "visible_bars", "last_bar",
            "session_high", "session_low", "session_volume", "vwap",
        )
    )


# -- closed buckets with corrections ------------------------------------------------

PRICES = ("open", "high", "low", "close", "volume")


def _stored_days(spark: SparkSession, root: str, before_batch: int) -> dict[date, list[str]]:
    """Folders of the bars that earlier batches stored, by day."""
    where, fs = files(spark, f"{root}/bars/bar_day=*/batch=*")
    found: dict[date, list[str]] = {}
    for status in fs.globStatus(where) or []:
        path = status.getPath()
        if int(path.getName()[6:]) < before_batch:
            found.setdefault(date.fromisoformat(path.getParent().getName()[8:]), []).append(path.toString())
    return found


def _newest_bar(spark: SparkSession, root: str, before_batch: int) -> datetime | None:
    """The newest ``bar_start`` of all earlier batches: each leaves it behind as its last write."""
    done = [b for b in batches(spark, f"{root}/newest") if b < before_batch]
    return spark.read.parquet(f"{root}/newest/batch={done[-1]}").first()["newest"] if done else None


def _bucket_of(bar: str) -> Column:
    """A bucket from one of the two states of its bars; NULL when no bar has that state."""
    at = F.when(F.col(bar).isNotNull(), F.col("bar_start"))
    return F.when(F.count(bar) > 0, F.struct(
        F.min_by(f"{bar}.open", at).alias("open"),
        F.max(f"{bar}.high").alias("high"),
        F.min(f"{bar}.low").alias("low"),
        F.max_by(f"{bar}.close", at).alias("close"),
        F.sum(f"{bar}.volume").alias("volume"),
    ))


def corrected_buckets_batch(root: str, minutes: int, delay_minutes: int = 10) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: closed buckets, and corrections for bars that come after their bucket closed.

    A bucket is closed once the newest bar seen is ``delay_minutes`` past its
    end. Under ``root`` a batch writes

    * ``bars``: its bars, by day, so that a late one meets the others of its bucket;
    * ``aside``: late bars and bars without a time, with the reason ``why``;
    * ``changes``: rows with ``op`` 1 (insert) for buckets that it closes; for late
      bars -1 (retract the row published before, if there is one) and 1. A late bar
      that changes nothing in its bucket leaves no change.
    * ``newest``: the newest bar so far, written last; readers stop at its batch.

    Of bars of one ticker and minute the one of the last batch counts (within a
    batch the largest). However the bars are split, the changes add up to
    ``aggregate_bars`` of all of them, as far as buckets are closed. A batch reads
    the stored days that it closes buckets of or has late bars for, no others, and
    only what earlier batches wrote, so one that is run again writes the same.
    """
    root = root.rstrip("/")
    delay = timedelta(minutes=delay_minutes)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _newest_bar(spark, root, batch_id)
        rows = batch.select("ticker", "bar_start", *PRICES).withColumn("bucket_start", bucket_start("bar_start", minutes)).persist()
        try:
            seen = rows.agg(F.max("bar_start").alias("t")).first()["t"]
            newest = max((t for t in (before, seen) if t is not None), default=None)
            end = plus_minutes("bucket_start", minutes)
            moment = lambda t: F.lit(None if t is None else str(t - delay)).cast("timestamp_ntz")
            late = F.coalesce(end <= moment(before), F.lit(False))
            (rows.withColumn("why", F.when(F.col("bar_start").isNull(), "no time").when(late, "late")).filter(F.col("why").isNotNull())
             .write.mode("overwrite").parquet(f"{root}/aside/batch={batch_id}"))
            timed = rows.filter(F.col("bar_start").isNotNull())
            (timed.drop("bucket_start").withColumn("bar_day", F.to_date("bar_start")).withColumn("batch", F.lit(batch_id))
             .hint("rebalance", F.col("bar_day"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bar_day", "batch").parquet(f"{root}/bars"))
            if newest is None:
                return
            # As many as the calendar has days.
            late_days = {r["d"] for r in timed.filter(late).select(F.to_date("bar_start").alias("d")).distinct().collect()}
            first = date.min if before is None else (before - delay).date() - timedelta(days=1)
            paths = [p for day, found in _stored_days(spark, root, batch_id).items()
                     if day in late_days or first <= day <= (newest - delay).date() for p in found]
            together = timed.withColumn("batch", F.lit(batch_id))
            if paths:
                stored = spark.read.schema(timed.drop("bucket_start").withColumn("batch", F.lit(0)).schema).option(
                    "basePath", f"{root}/bars").parquet(*paths).drop("bar_day")
                together = together.unionByName(stored.withColumn("bucket_start", bucket_start("bar_start", minutes)))
            together = together.filter(end <= moment(newest))
            hit = timed.filter(late).select(F.col("ticker").alias("_t"), F.col("bucket_start").alias("_b")).distinct()
            again = together.filter(late).join(
                hit, F.col("ticker").eqNullSafe(F.col("_t")) & (F.col("bucket_start") == F.col("_b")), "left_semi")
            bar = F.struct("batch", *PRICES)
            minute = together.filter(~late).unionByName(again).groupBy("ticker", "bucket_start", "bar_start").agg(
                F.max(bar).alias("now"), F.max(F.when(late & (F.col("batch") < batch_id), bar)).alias("was"))
            bucket = minute.groupBy("ticker", "bucket_start").agg(_bucket_of("was").alias("was"), _bucket_of("now").alias("now"))
            change = F.array_compact(F.array(
                F.when(F.col("was").isNotNull(), F.struct(F.lit(-1).alias("op"), F.col("was").alias("v"))),
                F.struct(F.lit(1).alias("op"), F.col("now").alias("v"))))
            (bucket.filter(~F.col("was").eqNullSafe(F.col("now"))).withColumn("c", F.explode(change))
             .select("ticker", "bucket_start", end.alias("bucket_end"), "c.op", "c.v.*")
             .write.mode("overwrite").parquet(f"{root}/changes/batch={batch_id}"))
            spark.createDataFrame([(newest,)], "newest timestamp_ntz").coalesce(1).write.mode("overwrite").parquet(
                f"{root}/newest/batch={batch_id}")
        finally:
            rows.unpersist()

    return run


def stream_bars_corrected(bars: DataFrame, root: str, minutes: int, checkpoint: str, delay_minutes: int = 10) -> DataStreamWriter:
    """Stream of bars -> stored bars, changes of closed buckets, late bars. Start it with a trigger of your choice."""
    return bars.writeStream.foreachBatch(corrected_buckets_batch(root, minutes, delay_minutes)).option("checkpointLocation", checkpoint)


def _parts(spark: SparkSession, root: str, name: str) -> DataFrame:
    root = root.rstrip("/")
    done = max(batches(spark, f"{root}/newest"), default=None)
    if done is None:
        raise FileNotFoundError(f"no batch in {root}")
    return spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}/batch=*").filter(F.col("batch") <= done)


def read_bar_changes(spark: SparkSession, root: str) -> DataFrame:
    """Inserts and retractions of closed buckets, with the batch that made them."""
    return _parts(spark, root, "changes")


def read_bars_aside(spark: SparkSession, root: str) -> DataFrame:
    """Late bars and bars without a time, with the batch they came in."""
    return _parts(spark, root, "aside")


def closed_buckets(changes: DataFrame) -> DataFrame:
    """The buckets that the changes add up to: the last insert of each."""
    last = changes.filter(F.col("op") == 1).groupBy("ticker", "bucket_start").agg(
        F.max_by(F.struct("bucket_end", *PRICES), "batch").alias("b"))
    return last.select("ticker", "bucket_start", "b.*")
