"""The eleven halt metrics for a whole table of requests at once.

Requests: ticker, observation_date, lookback_months (NULL = unbounded),
reason_codes (array; 'ALL' switches the reason filter off). A ``request_id``
column identifies a request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from haltscope.functions.clean import normalize_ticker
from haltscope.functions.times import lookback_start
from haltscope.operators.halt_days import reason_days
from haltscope.operators.scaling import spread_join

DEFAULT_LOOKBACK_MONTHS = 36
DEFAULT_REASON = "LUDP"
ALL_REASONS = "ALL"


def normalize_requests(requests: DataFrame) -> DataFrame:
    """Trim and upper-case ticker and codes, drop blank codes."""
    codes = F.filter(F.transform("reason_codes", lambda c: F.upper(F.trim(c))), lambda c: c != "")
    return requests.withColumn("ticker", normalize_ticker("ticker")).withColumn("reason_codes", codes)


def request_violations(requests: DataFrame) -> DataFrame:
    """Requests that break the contract, with the reason; empty when all are fine."""
    clean = normalize_requests(requests)
    problem = (
        F.when(F.coalesce(F.col("ticker"), F.lit("")) == "", F.lit("ticker is required"))
        .when(F.col("observation_date").isNull(), F.lit("observation date is required"))
        .when(F.coalesce(F.size("reason_codes"), F.lit(0)) < 1, F.lit("at least one reason code is required"))
        .when(F.col("lookback_months") <= 0, F.lit("lookback must be positive or absent"))
    )
    return clean.withColumn("violation", problem).filter(F.col("violation").isNotNull())


def reason_matches(reason: Column, wanted: Column) -> Column:
    """ALL, or the episode's single reason is listed. A NULL reason only passes under ALL."""
    listed = F.coalesce(F.array_contains(wanted, reason), F.lit(False))
    return F.array_contains(wanted, F.lit(ALL_REASONS)) | listed


def with_window(requests: DataFrame) -> DataFrame:
    return (
        normalize_requests(requests)
        .withColumn("lookback_start", lookback_start("observation_date", "lookback_months"))
        .withColumn("lookback_end", F.col("observation_date"))
    )


def _in_years(requests: DataFrame, days: DataFrame, day: Column, first: Column, last: Column) -> DataFrame:
    """Requests (column ``symbol``), once for each ``_year`` of [first, last] in which their ticker may have rows.

    A NULL ``first`` is as early as the ticker's first row. So requests meet the
    years of their window only, however long the history of a ticker is.
    """
    known = days.groupBy("symbol").agg(F.min(F.year(day)).alias("_low"), F.max(F.year(day)).alias("_high"))
    placed = spread_join(requests, known, ["symbol"], ["observation_date"], pieces=8)
    low, high = F.greatest(F.year(first), F.col("_low")), F.least(F.year(last), F.col("_high"))
    return placed.filter(low <= high).withColumn("_year", F.explode(F.sequence(low, high))).drop("_low", "_high")


def episodes_for_requests(episodes: DataFrame, requests: DataFrame) -> DataFrame:
    """Episodes each request may see: same ticker, started by the end of T, reason allowed.

    An optional ``start_date`` on the request cuts earlier starts.
    """
    wanted = normalize_requests(requests).withColumnRenamed("ticker", "symbol")
    first = F.col("start_date") if "start_date" in requests.columns else F.lit(None).cast("date")
    wanted = _in_years(wanted, episodes, F.col("halt_start"), first, F.col("observation_date"))
    joined = spread_join(
        episodes.withColumn("_year", F.year("halt_start")), wanted, ["symbol", "_year"], ["halt_start"], pieces=8
    ).drop("_year")
    keep = F.to_date("halt_start") <= F.col("observation_date")
    if "start_date" in requests.columns:
        keep = keep & (F.col("start_date").isNull() | (F.to_date("halt_start") >= F.col("start_date")))
    # The episode table's own reason column meets the request's list.
    return joined.filter(keep & reason_matches(F.col("reason_code"), F.col("reason_codes")))


def request_halt_days(requests: DataFrame, episodes: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per request and halt day in its window: active episodes and halted-at-close.

    Requests may pile up on one ticker, so they are spread; the halt days of a
    ticker are few (sessions x reasons) and are what gets repeated.

    ``window_episodes`` adds up to the number of distinct episodes seen in the
    window: all active ones on the window's first session, then the newly seen.
    """
    per_reason = reason_days(episodes.select("symbol", "reason_code", "halt_start", "halt_end",
                                             *[c for c in ("halted_at_close",) if c in episodes.columns]), calendar)
    bounds = with_window(requests)
    first_session = calendar.select(F.col("cal_date").alias("lookback_start"), F.col("next_session").alias("_s0"))
    bounds = bounds.join(F.broadcast(first_session), "lookback_start", "left")
    # A halt day lies between the starts and the ends of its symbol's episodes.
    ends = episodes.select("symbol", F.explode(F.array("halt_start", "halt_end")).alias("_day")).filter(F.col("_day").isNotNull())
    bounds = _in_years(bounds.withColumnRenamed("ticker", "symbol"), ends, F.col("_day"), F.col("lookback_start"), F.col("lookback_end"))
    hits = spread_join(
        bounds, per_reason.withColumn("_year", F.year("trading_date")), ["symbol", "_year"], ["request_id"], pieces=8
    ).filter(
        (F.col("trading_date") <= F.col("lookback_end"))
        & (F.col("lookback_start").isNull() | (F.col("trading_date") >= F.col("lookback_start")))
        & reason_matches(F.col("reason_code"), F.col("reason_codes"))
    )
    seen = F.when(F.col("trading_date") == F.col("_s0"), F.col("episode_count")).otherwise(F.col("first_seen_count"))
    # The observation date rides along as a grouping column: one value per request.
    return hits.groupBy("request_id", "observation_date", "trading_date", "session_seq").agg(
        F.sum("episode_count").alias("episode_count"),
        F.bool_or("halted_at_close").alias("halted_at_close"),
        F.sum(seen).alias("window_episodes"),
    )


def sequential_blocks(days: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of at least two halt days on consecutive sessions.

    A key has at most one row per session, so its window is bounded by the
    calendar.
    """
    order = Window.partitionBy(*keys).orderBy("session_seq")
    island = F.col("session_seq") - F.row_number().over(order)
    return (
        days.withColumn("_island", island)
        .groupBy(*keys, "_island")
        .agg(
            F.min("trading_date").alias("block_start"),
            F.max("trading_date").alias("block_end"),
            F.count(F.lit(1)).alias("block_length"),
        )
        .filter("block_length >= 2")
        .drop("_island")
    )


def halt_day_gaps(days: DataFrame, keys: list[str]) -> DataFrame:
    """Calendar days between each halt day and the one before it."""
    order = Window.partitionBy(*keys).orderBy("trading_date")
    previous = F.lag("trading_date").over(order)
    return (
        days.select(*keys, "trading_date", previous.alias("previous_date"))
        .filter(F.col("previous_date").isNotNull())
        .withColumn("gap_days", F.date_diff("trading_date", "previous_date"))
    )


def halt_metrics(requests: DataFrame, episodes: DataFrame, calendar: DataFrame) -> DataFrame:
    """All metrics per request; a metric that does not apply is NULL.

    One pass: halt days per request, their consecutive-session runs, then one
    grouped aggregation. Both groupings share the request's partitioning.
    """
    days = request_halt_days(requests, episodes, calendar).withColumnRenamed("observation_date", "_t")
    order = Window.partitionBy("request_id").orderBy("session_seq")
    runs = days.withColumn("_island", F.col("session_seq") - F.row_number().over(order)).groupBy(
        "request_id", "_t", "_island"
    ).agg(
        F.count(F.lit(1)).alias("_len"),
        F.sum("episode_count").alias("_episodes"),
        F.sum("window_episodes").alias("_distinct"),
        F.min("trading_date").alias("_first"),
        F.max("trading_date").alias("_last"),
        F.count_if("halted_at_close").alias("_closes"),
        F.max(F.when(F.col("trading_date") == F.col("_t"), F.col("episode_count"))).alias("_on_t"),
    )
    block = F.col("_len") >= 2
    agg = runs.groupBy("request_id").agg(
        F.sum("_len").alias("n"),
        F.sum("_episodes").alias("episodes"),
        F.sum("_distinct").alias("core_episode_count"),
        F.min("_first").alias("first"),
        F.max("_last").alias("last"),
        F.count_if(block).alias("blocks"),
        F.avg(F.when(block, F.col("_len"))).alias("block_avg"),
        F.max(F.when(block, F.col("_len"))).alias("block_max"),
        F.sum("_closes").alias("closes"),
        F.max("_on_t").alias("on_t"),
    )
    zero = F.lit(0).cast("bigint")
    n = F.coalesce("n", zero)
    return (
        with_window(requests)
        .join(agg, "request_id", "left")
        .select(
            "request_id",
            "ticker",
            "observation_date",
            "lookback_start",
            "lookback_end",
            "reason_codes",
            F.coalesce("core_episode_count", zero).alias("core_episode_count"),
            n.alias("metric_1"),
            (F.col("episodes") / F.col("n")).alias("metric_2"),
            F.date_diff("observation_date", "last").cast("bigint").alias("metric_3"),
            F.when(n >= 2, F.date_diff("last", "first") / (F.col("n") - 1)).alias("metric_4"),
            F.when(F.coalesce("blocks", zero) > 0, F.lit("Yes")).otherwise(F.lit("No")).alias("metric_5"),
            F.coalesce("blocks", zero).alias("metric_6"),
            F.col("block_avg").alias("metric_7"),
            F.col("block_max").alias("metric_8"),
            F.coalesce("closes", zero).alias("metric_9"),
            F.when(F.col("on_t").isNotNull(), F.lit("Yes")).otherwise(F.lit("No")).alias("metric_10"),
            F.coalesce("on_t", zero).alias("metric_11"),
        )
    )
