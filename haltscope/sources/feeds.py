"""The trade-halt XML feed: halt files and resumption files."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haltscope.functions.clean import blank_to_null
from haltscope.functions.times import filename_date, iso_date_text, iso_datetime, parse_feed_time
from haltscope.schemas import FEED_FIELDS, FEED_ITEM, FEED_PREFIX
from haltscope.sources.versions import files

HALT, RESUMPTION = "halt", "resumption"
HALT_GLOB, RESUMPTION_GLOB = "tradehalts_*.xml", "resumptions_*.xml"
CORRUPT = "_corrupt_record"


def check_feed(feed: str) -> str:
    if feed not in (HALT, RESUMPTION):
        raise ValueError(f"unknown feed {feed!r}; expected {HALT!r} or {RESUMPTION!r}")
    return feed


def route_reason(reason: Column, source_type: Column) -> tuple[Column, Column]:
    """The feed decides what a reason code means, never its value."""
    message = F.concat(F.lit("unknown feed: "), F.coalesce(source_type, F.lit("NULL")))
    known = F.when(source_type.isin(HALT, RESUMPTION), source_type).otherwise(
        F.raise_error(message).cast("string")
    )
    return F.when(known == HALT, reason), F.when(known == RESUMPTION, reason)


def market_fallback(mkt: Column, market: Column) -> Column:
    return F.coalesce(blank_to_null(mkt), blank_to_null(market))


def events_from_items(items: DataFrame, source_file: Column, source_type: Column) -> DataFrame:
    """Feed items (``ndaq:*`` text columns) -> observations; items without a symbol drop out."""

    # Each field is cleaned once; what follows reads it several times.
    items = items.select("*", *[blank_to_null(F.col(f"`{FEED_PREFIX}{name}`")).alias(f"_{name}") for name in FEED_FIELDS])

    def field(name: str) -> Column:
        return F.col(f"_{name}")

    # An array function ends a stretch of generated code. In one stretch, cleaning and parsing
    # are longer than what the JVM compiles, and every row is interpreted.
    dates = F.transform(F.array(field("HaltDate"), field("ResumptionDate")), iso_date_text)
    items = items.select("*", dates.alias("_dates"))
    halt_day, resumption_day = F.col("_dates")[0], F.col("_dates")[1]

    halt_reason, resumption_reason = route_reason(field("ReasonCode"), source_type)
    trade, quote = field("ResumptionTradeTime"), field("ResumptionQuoteTime")
    return items.select(
        field("IssueSymbol").alias("symbol"),
        field("IssueName").alias("issue_name"),
        F.coalesce(field("Mkt"), field("Market")).alias("market"),
        halt_reason.alias("reason_code"),
        resumption_reason.alias("resumption_reason_code"),
        field("HaltDate").alias("halt_date"),
        field("HaltTime").alias("halt_time"),
        resumption_day.try_cast("date").alias("resumption_date"),
        parse_feed_time(quote).alias("resumption_quote_time"),
        parse_feed_time(trade).alias("resumption_trade_time"),
        field("PauseThresholdPrice").try_cast("decimal(18,6)").alias("pause_threshold_price"),
        iso_datetime(halt_day, field("HaltTime")).alias("halt_start"),
        iso_datetime(resumption_day, F.coalesce(trade, quote)).alias("halt_end"),
        source_file.alias("source_file"),
        source_type.alias("source_type"),
    ).filter(F.col("symbol").isNotNull())


# Feed text is read up to each closing tag; a record holds the item that it closes, and
# before it whatever was left open.
ITEM_END = "</item>"
_ITEM_START = r"(?=<item[\s>/])"


def items_of(records: DataFrame, tolerant: bool = True) -> DataFrame:
    """Records (value, _file) of feed text cut at ``ITEM_END`` -> parsed items.

    An item that is not well-formed, or that another one begins inside of, keeps
    its text in ``_corrupt_record`` and costs no other item. One that the end of
    the file cuts off counts as ill-formed, unless all its elements are closed.
    """
    whole = F.concat(F.ltrim(F.col("value"), F.lit(" \t\r\n")), F.lit(ITEM_END))
    # Nearly all records are one item; only the others are searched with a pattern.
    one = whole.startswith("<item>") & (F.substring_index(whole, "<item", 2) == whole)
    cut = F.when(one, F.array(whole)).otherwise(F.filter(F.split(whole, _ITEM_START), lambda x: x.startswith("<item")))
    # The outer form, as Spark computes the array of the other one once more to skip empty ones.
    pieces = records.select("_file", F.explode_outer(cut).alias("_text")).filter(F.col("_text").isNotNull())
    options = {"mode": "PERMISSIVE" if tolerant else "FAILFAST", "columnNameOfCorruptRecord": CORRUPT}
    # Parsed inside an array, so that no filter behind it brings the parser a second time.
    item = F.from_xml(F.col("_text"), f"{FEED_ITEM}, {CORRUPT} string", options)
    return pieces.select(F.inline(F.array(item)), "_file")


def read_items(spark: SparkSession, path: str, glob: str | None = None, tolerant: bool = True) -> DataFrame:
    """Raw feed items with their file name; ill-formed ones keep their text in ``_corrupt_record``.

    Files are split between tasks, however large one is. A path that does not
    exist has no items.
    """
    where, fs = files(spark, path)
    if not fs.globStatus(where):
        return items_of(spark.createDataFrame([], "value string, _file string"), tolerant)
    reader = spark.read.option("lineSep", ITEM_END)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return items_of(reader.text(path).select("value", F.col("_metadata.file_name").alias("_file")), tolerant)


def scan_halt_feed(
    spark: SparkSession, path: str, feed: str = HALT, glob: str | None = None, tolerant: bool = True
) -> DataFrame:
    """Feed files -> observations. A bad item is skipped; see :func:`bad_feed_items`."""
    check_feed(feed)
    items = read_items(spark, path, glob, tolerant)
    good = items.filter(F.col(CORRUPT).isNull()) if tolerant else items
    return events_from_items(good, F.col("_file"), F.lit(feed))


def bad_feed_items(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(source_file, text) of every item that a tolerant scan skips."""
    items = read_items(spark, path, glob)
    return items.filter(F.col(CORRUPT).isNotNull()).select(F.col("_file").alias("source_file"), F.col(CORRUPT).alias("text"))


def scan_resumption_files(spark: SparkSession, folder: str, glob: str = RESUMPTION_GLOB) -> DataFrame:
    """All resumption files of a folder, none if there is no folder; they never enter the halt path."""
    return scan_halt_feed(spark, folder, RESUMPTION, glob)


def within_file_dates(events: DataFrame, start: date, end: date) -> DataFrame:
    """Rows whose file is dated in [start, end); other names drop out."""
    day = filename_date("source_file")
    return events.filter((day >= F.lit(start)) & (day < F.lit(end)))


def within_file_month(events: DataFrame, year: int, month: int) -> DataFrame:
    following = date(year + month // 12, month % 12 + 1, 1)
    return within_file_dates(events, date(year, month, 1), following)


def market_days(files: DataFrame) -> DataFrame:
    """Distinct Monday-Friday dates that have a feed file (column ``source_file``)."""
    return (
        files.select(filename_date("source_file").alias("trading_date"))
        .filter(F.col("trading_date").isNotNull() & (F.weekday("trading_date") < 5))
        .distinct()
    )


def only_symbols(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of the wanted symbols (column ``symbol``, any case)."""
    names = wanted.select(F.upper("symbol").alias("_s")).distinct()
    return events.withColumn("_s", F.upper("symbol")).join(names, "_s", "left_semi").drop("_s")


def symbols_found(events: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted symbol and whether any row carries it."""
    names = wanted.select(F.upper("symbol").alias("symbol")).distinct()
    seen = events.select(F.upper("symbol").alias("symbol")).distinct().withColumn("_seen", F.lit(True))
    return names.join(seen, "symbol", "left").select("symbol", F.coalesce("_seen", F.lit(False)).alias("found"))
