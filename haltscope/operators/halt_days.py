"""Episodes projected onto days: two different day rules, kept apart on purpose.

* ``halt_days`` uses the exchange calendar and each session's own close.
* ``ticker_halt_daily`` uses Monday-Friday and a fixed 16:00 close.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from haltscope.functions.calendar import on_calendar
from haltscope.functions.times import day_start, plus_minutes


def _covered_days(start: Column, end: Column) -> Column:
    """Every calendar day from start to end; the start day alone when open or reversed."""
    first, last = F.to_date(start), F.to_date(end)
    return F.sequence(first, F.greatest(first, F.coalesce(last, first)))


def session_spans(episodes: DataFrame, calendar: DataFrame) -> DataFrame:
    """Each episode with its sessions as numbers: ``_first`` to ``_last``, halted at close up to ``_closed``.

    An open or reversed episode covers its start day alone. Episodes that touch
    no session are left out; a day outside the calendar is an error. Halted at
    close = no end, or an end strictly after the session's close; the start is
    not looked at, so only the last session is in question. A column
    ``halted_at_close`` on the input overrides.
    """
    start, end = F.col("halt_start"), F.col("halt_end")
    last_day = F.greatest(F.to_date(start), F.coalesce(F.to_date(end), F.to_date(start)))
    placed = on_calendar(episodes.filter(start.isNotNull()), F.to_date(start), calendar, _first="next_seq")
    placed = on_calendar(placed.withColumn("_last_day", last_day), F.col("_last_day"), calendar,
                         _seq="next_seq", _is_session="is_session", _close="close_minute")
    placed = placed.withColumn("_last", F.col("_seq") - F.when(F.col("_is_session"), 0).otherwise(1)).filter("_first <= _last")
    # Behind a last session that is not the last day, the end lies after its close.
    late = end.isNull() | ~F.col("_is_session") | (end > plus_minutes(day_start("_last_day"), F.col("_close")))
    closed = F.when(late, F.col("_last")).otherwise(F.col("_last") - 1)
    if "halted_at_close" in episodes.columns:
        told = F.col("halted_at_close")
        closed = F.when(told.isNull(), closed).when(told, F.col("_last")).otherwise(F.col("_first") - 1)
    return placed.withColumn("_closed", closed).drop("_last_day", "_seq", "_is_session", "_close")


def episode_days(episodes: DataFrame, calendar: DataFrame) -> DataFrame:
    """Each episode on every session it covers, with ``halted_at_close`` for that session.

    ``is_first_session`` marks the first session an episode covers. See
    :func:`session_spans` for what it covers.
    """
    numbered = session_spans(episodes, calendar).withColumn("session_seq", F.explode(F.sequence("_first", "_last")))
    joined = numbered.join(F.broadcast(_sessions(calendar)), "session_seq")
    return joined.withColumn("halted_at_close", F.col("session_seq") <= F.col("_closed")).withColumn(
        "is_first_session", F.col("session_seq") == F.col("_first")
    ).drop("_first", "_last", "_closed")


def _sessions(calendar: DataFrame) -> DataFrame:
    return calendar.filter("is_session").select(F.col("cal_date").alias("trading_date"), F.col("next_seq").alias("session_seq"))


def _swept(episodes: DataFrame, calendar: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per key and session by a sweep over what begins and ends.

    An episode is one more at its first session and one less behind its last,
    however long it lasts; equal places are added up before the shuffle. A key
    has at most two places per session, which bounds its window. Only the
    resulting stretches are spread over their sessions.
    """
    change = lambda at, **n: F.struct(at.alias("seq"), *[F.lit(n.get(c, 0)).alias(c) for c in ("active", "closing", "fresh")])
    first = F.col("_first")
    changes = F.array(
        change(first, active=1, closing=1, fresh=1), change(first + 1, fresh=-1),
        change(F.col("_last") + 1, active=-1), change(F.col("_closed") + 1, closing=-1),
    )
    places = session_spans(episodes, calendar).select(*keys, F.explode(changes).alias("c")).groupBy(*keys, "c.seq").agg(
        *[F.sum(f"c.{c}").alias(c) for c in ("active", "closing", "fresh")])
    order = Window.partitionBy(*keys).orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    stretches = places.select(
        *keys, "seq", F.lead("seq").over(order).alias("_next"), *[F.sum(c).over(upto).alias(c) for c in ("active", "closing", "fresh")]
    ).filter("active > 0")
    return stretches.select(
        *keys, F.explode(F.sequence("seq", F.col("_next") - 1)).alias("session_seq"),
        F.col("active").alias("episode_count"), (F.col("closing") > 0).alias("halted_at_close"), F.col("fresh").alias("first_seen_count"),
    ).join(F.broadcast(_sessions(calendar)), "session_seq").select(
        *keys, "trading_date", "session_seq", "episode_count", "halted_at_close", "first_seen_count")


def halt_days(episodes: DataFrame, calendar: DataFrame) -> DataFrame:
    """Per symbol and session: active episodes, any halted at close, episodes first seen."""
    return _swept(episodes, calendar, ["symbol"])


def reason_days(episodes: DataFrame, calendar: DataFrame) -> DataFrame:
    """:func:`halt_days` kept apart by reason, so a reason filter can come later.

    At most one row per (symbol, session, reason): bounded by the calendar and
    the list of codes, however many episodes a symbol has.
    """
    return _swept(episodes, calendar, ["symbol", "reason_code"])


def _weekday_rows(episodes: DataFrame, market_close_minute: int) -> DataFrame:
    start, end = F.col("halt_start"), F.col("halt_end")
    days = F.filter(_covered_days(start, end), lambda d: F.weekday(d) < 5)
    # An open episode counts on its start day even at a weekend.
    days = F.when(end.isNull(), F.array(F.to_date(start))).otherwise(days)
    rows = episodes.filter(start.isNotNull()).withColumn("trading_date", F.explode(days))
    close = plus_minutes(day_start("trading_date"), market_close_minute)
    # Clipping the halt to the day leaves "start <= close <= end" unchanged; an
    # open end runs to the last instant of the day.
    in_force = (start <= close) & (end.isNull() | (end >= close))
    return rows.withColumn("_in_force", in_force)


def ticker_halt_daily(episodes: DataFrame, market_close_minute: int = 16 * 60) -> DataFrame:
    """Per symbol and Monday-Friday date covered: episode count and YES/NO at 16:00 inclusive."""
    return (
        _weekday_rows(episodes, market_close_minute)
        .groupBy("symbol", "trading_date")
        .agg(
            F.count(F.lit(1)).alias("episode_count"),
            F.when(F.bool_or("_in_force"), F.lit("YES")).otherwise(F.lit("NO")).alias("halt_at_close"),
        )
        .select("symbol", "trading_date", F.lit("YES").alias("halt_present"), "episode_count", "halt_at_close")
    )


def exact_average(value: str) -> Column:
    """Mean of a three-decimal column, rounded to three decimals.

    Summed as whole thousandths: the result does not depend on the order in
    which partitions are added up.
    """
    total = F.sum(F.round(F.col(value) * 1000).cast("bigint"))
    n = F.count(value)
    return F.floor((2 * total + n) / (2 * n).cast("decimal(20,0)")).cast("double") / 1000


def exact_medians(episodes: DataFrame, keys: list[str], value: str, width: float = 60.0) -> DataFrame:
    """Exact median per key, in two steps, so no task orders a whole key.

    Equal values are counted first (combined map-side). Bands of ``width`` then
    tell which band holds the middle; only that band's values are ordered.
    """
    counts = (
        episodes.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_band", F.floor(F.col(value) / F.lit(width)))
    )

    def covers(position: str, upto: Column, n: Column) -> Column:
        return (upto >= F.col(position)) & (upto - n < F.col(position))

    bands = counts.groupBy(*keys, "_band").agg(F.sum("_n").alias("_bn"))
    by_band = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, 0)
    middle = (
        bands.withColumn("_bupto", F.sum("_bn").over(by_band))
        .withColumn("_all", F.sum("_bn").over(Window.partitionBy(*keys)))
        .withColumn("_low", F.floor((F.col("_all") + 1) / 2))
        .withColumn("_high", F.floor((F.col("_all") + 2) / 2))
        .filter(covers("_low", F.col("_bupto"), F.col("_bn")) | covers("_high", F.col("_bupto"), F.col("_bn")))
    )
    inside = Window.partitionBy(*keys, "_band").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(middle, [*keys, "_band"]).withColumn(
        "_upto", F.col("_bupto") - F.col("_bn") + F.sum("_n").over(inside)
    )

    def at(position: str) -> Column:
        return F.max(F.when(covers(position, F.col("_upto"), F.col("_n")), F.col(value)))

    return ranked.groupBy(*keys).agg(((at("_low") + at("_high")) / 2).alias("median"))


def ticker_halt_metrics(episodes: DataFrame, daily: DataFrame, market_days: DataFrame) -> DataFrame:
    """Per symbol: counts, ratios (0 when there is no halt day) and duration statistics.

    ``market_days`` has one row per market day; only its row count is used.
    """
    per_symbol = episodes.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_halt_episodes"),
        exact_average("duration_minutes").alias("avg_duration_minutes"),
        F.min("duration_minutes").alias("min_duration_minutes"),
        F.max("duration_minutes").alias("max_duration_minutes"),
        F.min(F.to_date("halt_start")).alias("first_halt_date"),
        F.max(F.to_date("halt_start")).alias("last_halt_date"),
    )
    per_day = daily.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("halt_days"),
        F.count_if(F.col("halt_at_close") == "YES").alias("halt_days_at_close"),
    )
    medians = exact_medians(episodes, ["symbol"], "duration_minutes")
    zero = F.lit(0).cast("bigint")
    days = F.coalesce("halt_days", zero)
    closes = F.coalesce("halt_days_at_close", zero)

    def ratio(num: Column, den: Column) -> Column:
        return F.when(den > 0, F.round(num / den, 4)).otherwise(F.lit(0.0))

    return (
        per_symbol.join(per_day, "symbol", "left")
        .join(medians, "symbol", "left")
        .withColumn("_market_days", market_days.agg(F.count(F.lit(1))).scalar())
        .select(
            "symbol",
            "total_halt_episodes",
            days.alias("halt_days"),
            closes.alias("halt_days_at_close"),
            F.when(days > 0, F.round(closes / days * 100, 4)).otherwise(F.lit(0.0)).alias("halt_at_close_pct"),
            ratio(F.col("total_halt_episodes"), days).alias("halts_per_halt_day"),
            ratio(F.col("total_halt_episodes"), F.col("_market_days")).alias("halts_per_market_day"),
            "avg_duration_minutes",
            F.round("median", 3).alias("median_duration_minutes"),
            "min_duration_minutes",
            "max_duration_minutes",
            "first_halt_date",
            "last_halt_date",
        )
    )


def ticker_reason_metrics(episodes: DataFrame) -> DataFrame:
    """Per (symbol, reason), a missing reason being a group of its own."""
    return episodes.groupBy("symbol", "reason_code").agg(
        F.count(F.lit(1)).alias("halt_episodes"),
        exact_average("duration_minutes").alias("avg_duration_minutes"),
        F.min("duration_minutes").alias("min_duration_minutes"),
        F.max("duration_minutes").alias("max_duration_minutes"),
    )


def reason_order() -> list[Column]:
    """Sort order of the reason report: missing reasons last within a symbol."""
    return [F.col("symbol").asc(), F.col("reason_code").asc_nulls_last()]


def report_levels(events: DataFrame, episodes: DataFrame, market_days: DataFrame) -> dict[str, DataFrame]:
    """The five report tables, by name; ``sources.tables.export_levels`` writes them."""
    daily = ticker_halt_daily(episodes)
    return {
        "events": events,
        "episodes": episodes,
        "daily": daily,
        "ticker_metrics": ticker_halt_metrics(episodes, daily, market_days),
        "reason_metrics": ticker_reason_metrics(episodes),
    }
