"""Symbol directories (pipe-delimited) and batch request files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haltscope.functions.times import parse_multi_format_date

# Header layouts of the two listings and their footer.
NASDAQ_HEADER = (
    "Symbol|Security Name|Market Category|Test Issue|Financial Status|Round Lot Size|ETF|NextShares"
)
OTHER_HEADER = (
    "ACT Symbol|Security Name|Exchange|CQS Symbol|ETF|Round Lot Size|Test Issue|NASDAQ Symbol"
)
FOOTER = "File Creation Time"


def listing_rows(lines: DataFrame, header: str, source_file: str, symbol_field: str) -> DataFrame:
    """Text lines (column ``value``) of one listing -> directory rows.

    The header, the footer, blank lines and lines with another field count are
    skipped; the full record is kept as ``payload``.
    """
    names = header.split("|")
    fields = F.split("value", r"\|", -1)
    keep = (
        (F.trim("value") != "")
        & (F.col("value") != header)
        & ~F.col("value").startswith(FOOTER)
        & (F.size(fields) == len(names))
    )
    record = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), fields)
    rows = lines.select(F.rtrim(F.col("value"), F.lit("\r")).alias("value")).filter(keep).select(record.alias("payload"))

    def get(name: str) -> Column:
        return F.col("payload")[name] if name in names else F.lit(None).cast("string")

    return rows.select(
        get(symbol_field).alias("symbol"),
        get("Security Name").alias("security_name"),
        F.coalesce(F.nullif(get("Exchange"), F.lit("")), get("Market Category")).alias("exchange"),
        get("Test Issue").alias("test_issue"),
        F.trim(get("Round Lot Size")).try_cast("int").alias("round_lot_size"),
        get("ETF").alias("etf"),
        F.lit(source_file).alias("source_file"),
        "payload",
    )


def scan_symbol_directory(spark: SparkSession, nasdaq_path: str, other_path: str) -> DataFrame:
    """Both listings in one shape."""
    nasdaq = listing_rows(spark.read.text(nasdaq_path), NASDAQ_HEADER, "nasdaqlisted", "Symbol")
    other = listing_rows(spark.read.text(other_path), OTHER_HEADER, "otherlisted", "ACT Symbol")
    return nasdaq.unionByName(other)


def read_request_file(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """The file's Date and Ticker columns as text, whatever the case of the header."""
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    by_name = {c.strip().lstrip("﻿").lower(): c for c in raw.columns}

    def column(name: str) -> Column:
        if name not in by_name:
            return F.lit(None).cast("string").alias(name)
        return F.col(f"`{by_name[name]}`").alias(name)

    return raw.select(column("date"), column("ticker"), *[
        F.lit(n in by_name).alias(f"has_{n}") for n in ("date", "ticker")
    ])


def profile_requests(rows: DataFrame) -> DataFrame:
    """One row: counts of observations, bad dates, empty tickers, and a verdict."""
    bad_date = parse_multi_format_date("date").isNull()
    no_ticker = F.coalesce(F.trim("ticker"), F.lit("")) == ""
    has = {n: F.coalesce(F.bool_and(f"has_{n}"), F.lit(True)) for n in ("date", "ticker")} if (
        "has_date" in rows.columns
    ) else {"date": F.lit(True), "ticker": F.lit(True)}
    invalid, empty = F.count_if(bad_date), F.count_if(no_ticker)
    return rows.agg(
        F.count(F.lit(1)).alias("observations"),
        invalid.alias("invalid_dates"),
        empty.alias("empty_tickers"),
        has["date"].alias("has_date"),
        has["ticker"].alias("has_ticker"),
    ).withColumn(
        "valid",
        F.col("has_date") & F.col("has_ticker") & (F.col("invalid_dates") == 0) & (F.col("empty_tickers") == 0),
    )


def parse_requests(rows: DataFrame) -> DataFrame:
    """(date, ticker) text -> (observation_date, ticker); profile the file first."""
    return rows.select(
        parse_multi_format_date("date").alias("observation_date"), F.upper(F.trim("ticker")).alias("ticker")
    )


def scan_batch_requests(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return parse_requests(read_request_file(spark, path, sep))
