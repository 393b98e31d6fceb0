"""Minute-bar files: whole-market gz CSV per day, and plain typed CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from haltscope.functions.calendar import with_session
from haltscope.functions.clean import normalize_ticker, round_half_even_long
from haltscope.functions.times import utc_nanos_to_local
from haltscope.schemas import CSV_BAR, FLATFILE_BAR


def scan_csv_bars(spark: SparkSession, path: str) -> DataFrame:
    """Typed CSV bars; a missing path is an error, a malformed file too."""
    return (
        spark.read.schema(CSV_BAR).option("header", True).option("mode", "FAILFAST").csv(path)
    )


def ordered_bars(bars: DataFrame) -> DataFrame:
    return bars.orderBy("ticker", "bar_start")


def scan_flatfile_bars(
    spark: SparkSession,
    path: str,
    calendar: DataFrame,
    provenance: dict[str, str] | None = None,
    day_pattern: str = r".*(\d{4}-\d{2}-\d{2})",
) -> DataFrame:
    """Flat files, named by day or in folders named by day -> bars in exchange-local time.

    The last day in a file's path counts.
    Rows of another day than their file's, rows on a day without a session and
    rows outside 04:00-20:00 are dropped. gz files are read one task per file.
    """
    rows = (
        spark.read.schema(FLATFILE_BAR).option("header", True).option("mode", "FAILFAST").csv(path)
        .withColumn("_day", F.regexp_extract(F.col("_metadata.file_path"), day_pattern, 1).try_cast("date"))
    )
    return shape_flatfile_rows(rows, calendar, provenance)


def shape_flatfile_rows(rows: DataFrame, calendar: DataFrame, provenance: dict[str, str] | None = None) -> DataFrame:
    """Flat-file rows with their file's ``_day`` -> enriched bars."""
    local = rows.withColumn("bar_start", utc_nanos_to_local("window_start")).filter(
        F.to_date("bar_start") == F.col("_day")
    )
    placed = with_session(local, "bar_start", calendar).filter(F.col("session").isNotNull())
    tags = provenance or {}
    return placed.select(
        "ticker",
        F.lit(None).cast("string").alias("market"),
        "bar_start",
        "open",
        "high",
        "low",
        "close",
        round_half_even_long("volume").alias("volume"),
        "session",
        round_half_even_long("transactions").alias("transaction_count"),
        *[
            F.lit(tags.get(name)).cast("string").alias(name)
            for name in ("market_scope", "source_provider", "source_dataset", "dataset_version", "ingestion_run_id")
        ],
        F.lit(None).cast("string").alias("security_id"),
    )


def scan_watchlist(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """{"tickers": [...]}, one per file or one per line -> distinct tickers."""
    listed = spark.read.schema("tickers array<string>").option("multiLine", whole_files).json(path)
    return listed.select(F.explode("tickers").alias("ticker")).distinct()


def require_watchlist(watchlist: DataFrame) -> DataFrame:
    """Fail the job when the list is empty: an empty list means nothing is to be ingested."""
    total = watchlist.agg(F.count(F.lit(1)))
    guarded = watchlist.withColumn("_n", total.scalar())
    empty = total.toDF("_n").filter(
        F.when(F.col("_n") == 0, F.raise_error(F.lit("the watchlist is empty")).cast("boolean")).otherwise(F.lit(False))
    )
    return guarded.select("ticker").unionByName(empty.select(F.lit(None).cast("string").alias("ticker")))


def normalize_bar_tickers(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ticker", normalize_ticker("ticker"))
