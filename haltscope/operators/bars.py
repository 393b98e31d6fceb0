"""Minute bars: point-in-time reads, aggregation, VWAP, relative volume, checks.

Bar columns: ticker, bar_start (naive timestamp), open, high, low, close,
volume. One bar per (ticker, minute), so a (ticker, day) holds at most 1440.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from haltscope.functions.clean import safe_ratio
from haltscope.functions.times import bucket_start, minute_of_day, plus_minutes
from haltscope.functions.calendar import PRE_MARKET_OPEN, on_calendar

CANONICAL_BAR_COLUMNS = ("ticker", "market", "bar_start", "open", "high", "low", "close", "volume")


def canonical_bars(bars: DataFrame) -> DataFrame:
    return bars.select(*CANONICAL_BAR_COLUMNS)


def as_moment(as_of: Column | datetime | str) -> Column:
    if isinstance(as_of, datetime) and as_of.tzinfo is not None:
        raise ValueError("as_of is a naive exchange-local timestamp")
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp_ntz")


def bars_as_of(
    bars: DataFrame,
    as_of: Column | datetime | str | None = None,
    ticker: str | None = None,
    trading_day: str | None = None,
) -> DataFrame:
    """Bars visible at ``as_of``. Plain comparisons, so they reach the file scan."""
    out = bars
    if ticker is not None:
        out = out.filter(F.col("ticker") == ticker)
    if trading_day is not None:
        midnight = F.lit(f"{trading_day} 00:00:00").cast("timestamp_ntz")
        out = out.filter((F.col("bar_start") >= midnight) & (F.col("bar_start") < plus_minutes(midnight, 1440)))
    if as_of is not None:
        out = out.filter(F.col("bar_start") <= as_moment(as_of))
    return out


def guard_look_ahead(df: DataFrame, ts_col: str, as_of: Column | datetime | str) -> DataFrame:
    """Pass rows through; fail the job if any carries later information than ``as_of``."""
    moment = as_moment(as_of)
    message = F.concat(F.lit("look-ahead: "), F.col(ts_col).cast("string"))
    return df.filter(
        F.when(F.col(ts_col) <= moment, F.lit(True)).when(F.col(ts_col).isNull(), F.lit(True)).otherwise(
            F.raise_error(message).cast("boolean")
        )
    )


def look_ahead_violations(df: DataFrame, ts_col: str, as_of: Column | datetime | str) -> DataFrame:
    return df.filter(F.col(ts_col) > as_moment(as_of))


def aggregate_bars(
    bars: DataFrame, minutes: int, as_of: Column | datetime | str | None = None, keys: tuple[str, ...] = ("ticker",)
) -> DataFrame:
    """Midnight-anchored buckets. With ``as_of`` only visible minutes count and the
    bucket still running is flagged open."""
    visible = bars_as_of(bars, as_of)
    out = (
        visible.withColumn("bucket_start", bucket_start("bar_start", minutes))
        .groupBy(*keys, "bucket_start")
        .agg(
            F.min_by("open", "bar_start").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "bar_start").alias("close"),
            F.sum("volume").alias("volume"),
        )
    )
    end = plus_minutes("bucket_start", minutes)
    closed = F.lit(True) if as_of is None else as_moment(as_of) >= end
    return out.select(
        *keys, "bucket_start", end.alias("bucket_end"), "open", "high", "low", "close", "volume",
        closed.alias("is_closed"),
    )


def current_bucket(
    bars: DataFrame, minutes: int, as_of: Column | datetime | str, keys: tuple[str, ...] = ("ticker",)
) -> DataFrame:
    """The last bucket of the day ``as_of`` falls on, per ticker."""
    moment = as_moment(as_of)
    today = bars.filter(F.to_date("bar_start") == F.to_date(moment))
    buckets = aggregate_bars(today, minutes, as_of, keys)
    rest = [c for c in buckets.columns if c not in keys]
    last = buckets.groupBy(*keys).agg(F.max_by(F.struct(*rest), "bucket_start").alias("_b"))
    return last.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def _typical_value() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / F.lit(3) * F.col("volume")


def vwap(bars: DataFrame, as_of: Column | datetime | str | None = None) -> DataFrame:
    """Volume-weighted price per ticker and day over what is visible; NULL without volume."""
    return (
        bars_as_of(bars, as_of)
        .groupBy("ticker", F.to_date("bar_start").alias("trading_day"))
        .agg(safe_ratio(F.sum(_typical_value()), F.sum("volume").cast("double")).alias("vwap"))
    )


def running_features(bars: DataFrame) -> DataFrame:
    """The day so far at every minute: VWAP, volume, high, low, open.

    This is the state of a minute-by-minute replay of the whole table in one
    ordered pass; no bar meets a later one.
    """
    day = F.to_date("bar_start")
    sofar = Window.partitionBy("ticker", day).orderBy("bar_start").rowsBetween(Window.unboundedPreceding, 0)
    return bars.select(
        "ticker",
        "bar_start",
        day.alias("trading_day"),
        F.count(F.lit(1)).over(sofar).alias("visible_bars"),
        F.first("open").over(sofar).alias("session_open"),
        F.max("high").over(sofar).alias("session_high"),
        F.min("low").over(sofar).alias("session_low"),
        F.sum("volume").over(sofar).alias("session_volume"),
        safe_ratio(F.sum(_typical_value()).over(sofar), F.sum("volume").over(sofar).cast("double")).alias("vwap"),
    )


def rvol(
    bars: DataFrame,
    calendar: DataFrame,
    minutes: int,
    lookback: int = 5,
    as_of: Column | datetime | str | None = None,
) -> DataFrame:
    """Bucket volume over the mean of the same bucket on the preceding sessions.

    A range frame over the session number replaces a self-join: a (ticker,
    time-of-day) group has one row per day. Days without the bucket do not
    enter the mean; a day off-session is compared with the sessions before it
    but is never part of a baseline.
    """
    buckets = aggregate_bars(bars, minutes, as_of)
    placed = on_calendar(
        buckets.withColumn("trading_day", F.to_date("bucket_start")), F.col("trading_day"), calendar, is_session="is_session", _seq="next_seq")
    same_time = (
        Window.partitionBy("ticker", minute_of_day("bucket_start"))
        .orderBy("_seq")
        .rangeBetween(-lookback, -1)
    )
    past = F.when(F.col("is_session"), F.col("volume"))
    return placed.select(
        "ticker",
        "bucket_start",
        "volume",
        F.avg(past).over(same_time).alias("baseline_volume"),
        F.count(past).over(same_time).alias("baseline_days"),
        safe_ratio(F.col("volume").cast("double"), F.avg(past).over(same_time)).alias("rvol"),
    )


def session_minute_features(bars: DataFrame) -> DataFrame:
    """Minutes since the pre-market open and whether the bar closed at or above its open."""
    seconds = minute_of_day("bar_start") * 60 + F.second("bar_start") - PRE_MARKET_OPEN * 60
    return bars.select(
        "ticker",
        "bar_start",
        (seconds / F.lit(60.0)).alias("session_minute"),
        (F.col("close") >= F.col("open")).alias("is_up"),
        "volume",
    )


def integrity_violations(bars: DataFrame) -> DataFrame:
    """Bars breaking a rule, one row per broken rule."""
    c = F.col
    rules = {
        "high_below_open": c("high") < c("open"),
        "high_below_close": c("high") < c("close"),
        "high_below_low": c("high") < c("low"),
        "low_above_open": c("low") > c("open"),
        "low_above_close": c("low") > c("close"),
        "negative_volume": c("volume") < 0,
    }
    if "session" in bars.columns:
        rules["unknown_session"] = ~c("session").isin("PRE_MARKET", "REGULAR", "AFTER_HOURS")
    if "transaction_count" in bars.columns:
        rules["negative_transactions"] = c("transaction_count") < 0
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return bars.withColumn("violation", F.explode(broken))


def watchlist_only(bars: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Bars of listed tickers. Catalyst broadcasts the list only if its size allows."""
    return bars.join(watchlist.select("ticker").distinct(), "ticker", "left_semi")
