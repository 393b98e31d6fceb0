"""Writers: table versions, appends and CSV reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Columns of the live export and titles of the batch report.
LIVE_EVENT_COLUMNS = [
    "symbol", "issue_name", "market", "reason_code", "halt_date", "halt_time",
    "resumption_date", "resumption_quote_time", "resumption_trade_time", "pause_threshold_price",
]


def append_rows(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Add rows to a Parquet table. Pass what ``new_rows`` returned, so a rerun adds nothing."""
    writer = rows.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_version(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a merged table as a new version.

    With partitions only those present in ``rows`` are replaced. The target must
    not be the folder the merge reads: write beside it and switch the reader.
    """
    writer = rows.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def export_csv(rows: DataFrame, path: str, partitions: int | None = None) -> None:
    """CSV with a header (also for an empty result)."""
    out = rows.coalesce(partitions) if partitions else rows
    out.write.mode("overwrite").option("header", True).csv(path)


def export_levels(levels: dict[str, DataFrame], folder: str) -> None:
    """One CSV folder per level: events, episodes, daily, ticker and reason metrics."""
    for name, rows in levels.items():
        export_csv(flatten_arrays(rows), f"{folder.rstrip('/')}/{name}")


def flatten_arrays(rows: DataFrame) -> DataFrame:
    """Array columns as '|'-joined text, the only shape CSV can hold."""
    arrays = {name for name, kind in rows.dtypes if kind.startswith("array")}
    return rows.select(*[F.array_join(c, "|").alias(c) if c in arrays else F.col(c) for c in rows.columns])


def live_event_rows(events: DataFrame) -> DataFrame:
    return events.select(*LIVE_EVENT_COLUMNS)


def display_number(value: Column) -> Column:
    """At most two decimals, no trailing zeros; missing -> N/A."""
    value = value.cast("double")
    text = F.format_string("%.2f", F.bround(value, 2))
    return F.when(value.isNull(), F.lit("N/A")).otherwise(F.regexp_replace(text, r"\.?0+$", ""))


def batch_result_rows(metrics: DataFrame) -> DataFrame:
    """Date, Ticker and the metrics as report text; a missing metric reads N/A."""

    def shown(i: int) -> Column:
        c = F.col(f"metric_{i}")
        return c if i in (5, 10) else display_number(c)

    return metrics.select(
        F.date_format("observation_date", "dd/MM/yyyy").alias("Date"),
        F.col("ticker").alias("Ticker"),
        *[shown(i).alias(f"Metric {i}") for i in range(1, 12)],
    )


# Reason codes, their descriptions and their class.
HALT_REASONS = {
    "LUDP": "Volatility Trading Pause",
    "M": "Volatility Trading Pause / market-specific halt",
    "T1": "News Pending",
    "T2": "News Released",
    "T5": "Single-stock trading pause in effect",
    "T6": "Extraordinary market activity",
    "T8": "Exchange-traded product halt",
    "T12": "Additional information requested",
    "H4": "Non-compliance",
    "H9": "Filings not current",
    "H10": "SEC trading suspension",
    "H11": "Regulatory concern",
    "O1": "Operations halt",
    "IPO1": "IPO issue not yet trading",
    "M1": "Corporate action",
    "M2": "Quotation not available",
    "LUDS": "Volatility pause — straddle condition",
    "MWC1": "Market-wide circuit breaker level 1",
    "MWC2": "Market-wide circuit breaker level 2",
    "MWC3": "Market-wide circuit breaker level 3",
    "MWC0": "Market-wide circuit breaker carry-over",
    "D": "Security deletion / issue-specific action",
}
RESUMPTION_REASONS = {
    "T3": "News and resumption times",
    "T7": "Single-stock trading pause / quotation resumption",
    "R4": "Qualifications issue resolved",
    "R9": "Filings issue resolved",
    "C3": "Issuer news / quotation resumption",
    "C4": "Qualifications / quotation resumption",
    "C9": "Filings / quotation resumption",
    "C11": "Regulatory concern / quotation resumption",
    "R1": "New issue available",
    "R2": "Issue available for quotation",
    "IPOQ": "IPO quotation release",
    "IPOE": "IPO quotation-only period ended",
    "MWCQ": "Market-wide circuit breaker quotation resumption",
}
ANALYTICAL_REASONS = ("LUDP", "M", "T1", "T2", "T12", "D", "H11")


def reason_reference(spark: SparkSession) -> DataFrame:
    """code, description, HALT/RESUMPTION, and whether it is offered as an analysis filter."""
    rows = [(c, d, "HALT", c in ANALYTICAL_REASONS) for c, d in HALT_REASONS.items()]
    rows += [(c, d, "RESUMPTION", False) for c, d in RESUMPTION_REASONS.items()]
    return spark.createDataFrame(rows, "reason_code string, description string, kind string, analytical boolean")


def describe_reasons(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Add description and class of ``reason_code`` (a 35-row table, so it is broadcast)."""
    return df.join(F.broadcast(reason_reference(spark)), "reason_code", "left")
