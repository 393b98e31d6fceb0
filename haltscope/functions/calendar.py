"""Exchange session calendar generated by rule, as a DataFrame.

One row per calendar day in the requested range. Its size is bounded by the
range (366 rows a year), so joins broadcast it whatever the data volume.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_CALENDAR_YEARS = 200  # ~73k rows: the proven bound behind the broadcast

# Session boundaries as minutes after midnight.
PRE_MARKET_OPEN = 4 * 60
REGULAR_OPEN = 9 * 60 + 30
NORMAL_CLOSE = 16 * 60
EARLY_CLOSE = 13 * 60
AFTER_HOURS_CLOSE = 20 * 60

CALENDAR_COLUMNS = (
    "cal_date date, is_session boolean, close_minute int, next_session date, next_seq int"
)

# Monday = 0 as in Spark's weekday().
_MON, _THU = 0, 3


def _ymd(month: int, day: int) -> Column:
    return F.make_date(F.col("y"), F.lit(month), F.lit(day))


def _nth_weekday(month: int, weekday: int, nth: int) -> Column:
    first = _ymd(month, 1)
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (nth - 1))


def _last_weekday(month: int, weekday: int) -> Column:
    last = F.last_day(_ymd(month, 1))
    return F.date_sub(last, F.pmod(F.weekday(last) - F.lit(weekday), F.lit(7)))


def _observed(month: int, day: int) -> Column:
    """Saturday holidays move to Friday, Sunday ones to Monday."""
    d = _ymd(month, day)
    shift = F.when(F.weekday(d) == 5, -1).when(F.weekday(d) == 6, 1).otherwise(0)
    return F.date_add(d, shift)


def _good_friday() -> Column:
    """Two days before Easter Sunday, by the Gauss/Oudin congruences.

    Written in terms of the Paschal full moon offset and the following Sunday.
    """
    y = F.col("y")
    century = F.floor(y / 100)
    golden = F.pmod(y, F.lit(19))
    moon = F.pmod(
        century - F.floor(century / 4) - F.floor((8 * century + 13) / 25) + 19 * golden + 15, F.lit(30)
    )
    moon = moon - F.floor(moon / 28) * (
        F.lit(1) - F.floor(F.lit(29) / (moon + 1)) * F.floor((F.lit(21) - golden) / 11)
    )
    weekday = F.pmod(y + F.floor(y / 4) + moon + 2 - century + F.floor(century / 4), F.lit(7))
    march_offset = (moon - weekday).cast("int")  # days from March 28 to Easter
    return F.date_add(_ymd(3, 28), march_offset - 2)


def _rules(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """One row per year: the closed days and the early-close candidates."""
    # A year's closures are looked up by the day's own year, so a New Year
    # observed on Dec 31 of the year before closes nothing.
    closed = F.array(
        _observed(1, 1),
        _nth_weekday(1, _MON, 3),
        _nth_weekday(2, _MON, 3),
        _good_friday(),
        _last_weekday(5, _MON),
        F.when(F.col("y") >= 2022, _observed(6, 19)),
        _observed(7, 4),
        _nth_weekday(9, _MON, 1),
        _nth_weekday(11, _THU, 4),
        _observed(12, 25),
    )
    early = F.array(
        F.date_add(_nth_weekday(11, _THU, 4), 1),
        _ymd(12, 24),
        F.when(F.weekday(_ymd(7, 4)) < 5, _ymd(7, 3)),
    )
    years = spark.range(first_year, last_year + 1, 1, 1).select(F.col("id").cast("int").alias("y"))
    return years.select("y", F.array_compact(closed).alias("closed"), F.array_compact(early).alias("early"))


def closed_days(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(year, closed_date) rule table."""
    return _rules(spark, first_year, last_year).select(
        F.col("y").alias("year"), F.explode(F.array_distinct("closed")).alias("closed_date")
    )


def early_close_days(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(year, early_close_date): early closes that are not full closures."""
    return _rules(spark, first_year, last_year).select(
        F.col("y").alias("year"),
        F.explode(F.array_except("early", "closed")).alias("early_close_date"),
    )


def trading_calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    """Every calendar day of [start, end].

    ``is_session``, ``close_minute`` (NULL off-session), ``next_session`` (the
    day itself, or the first session after it) and ``next_seq``, the running
    number of that session. Consecutive sessions differ by one in ``next_seq``.
    """
    if end.year - start.year > MAX_CALENDAR_YEARS:
        raise ValueError(f"calendar range above {MAX_CALENDAR_YEARS} years")
    # Two weeks of margin give the last day of the range a next session.
    last_year = end.year + 1
    first_day, last_day = F.make_date(F.col("y"), F.lit(1), F.lit(1)), F.make_date(F.col("y"), F.lit(12), F.lit(31))
    per_year = _rules(spark, start.year, last_year).select(
        F.transform(
            F.filter(
                F.sequence(first_day, last_day),
                lambda d: (F.weekday(d) < 5) & ~F.array_contains(F.col("closed"), d),
            ),
            lambda d: F.struct(
                d.alias("d"),
                F.when(F.array_contains(F.col("early"), d), EARLY_CLOSE).otherwise(NORMAL_CLOSE).alias("close"),
            ),
        ).alias("sessions")
    )
    # Sorted session list -> position in the list is the session number. Each
    # session then claims the days since the one before it.
    listed = per_year.agg(F.array_sort(F.flatten(F.collect_list("sessions"))).alias("s"))
    numbered = listed.select("s", F.posexplode("s").alias("pos", "cur"))
    before = F.when(F.col("pos") > 0, F.date_add(F.get(F.col("s"), F.col("pos") - 1)["d"], 1))
    days = numbered.select(
        F.explode(
            F.sequence(F.coalesce(before, F.make_date(F.lit(start.year), F.lit(1), F.lit(1))), F.col("cur.d"))
        ).alias("cal_date"),
        F.col("cur.d").alias("next_session"),
        F.col("cur.close").alias("close"),
        (F.col("pos") + 1).alias("next_seq"),
    )
    is_session = F.col("cal_date") == F.col("next_session")
    return days.filter(F.col("cal_date").between(F.lit(start), F.lit(end))).select(
        "cal_date",
        is_session.alias("is_session"),
        F.when(is_session, F.col("close")).alias("close_minute"),
        "next_session",
        "next_seq",
    )


def date_bounds(*columns: tuple[DataFrame, str]) -> tuple[date, date] | None:
    """First and last day of some date or timestamp columns: one aggregate per table, two dates for the driver."""
    tables: dict[int, tuple[DataFrame, list[str]]] = {}
    for table, column in columns:
        tables.setdefault(id(table), (table, []))[1].append(column)
    found = []
    for table, names in tables.values():
        row = table.agg(*[f(c).cast("date") for c in names for f in (F.min, F.max)]).first()
        found += [d for d in row if d is not None]
    return (min(found), max(found)) if found else None


def calendar_for(spark: SparkSession, *columns: tuple[DataFrame, str], years: int = 1) -> DataFrame:
    """The calendar of all days that the columns hold, in whole years, with ``years`` more on both sides.

    Look-backs (preceding sessions, baselines) reach into the margin; an end that
    is derived from the columns may do so, too.
    """
    today = date.today()
    low, high = date_bounds(*columns) or (today, today)
    return trading_calendar(spark, date(max(low.year - years, 1), 1, 1), date(high.year + years, 12, 31))


def on_calendar(df: DataFrame, day: Column, calendar: DataFrame, **columns: str) -> DataFrame:
    """Add calendar columns (new name = calendar's name) of a day.

    No row is lost. A day that the calendar does not cover is an error; a NULL
    day has NULL columns.
    """
    marks = calendar.select(F.col("cal_date").alias("_cal"), *[F.col(c).alias(f"_cal_{n}") for n, c in columns.items()])
    joined = df.withColumn("_cal_day", day).join(F.broadcast(marks), F.col("_cal_day") == F.col("_cal"), "left")
    # Part of the value, so that no later filter on it can drop the row unseen.
    covered = F.col("_cal_day").isNull() | F.col("_cal").isNotNull()
    message = F.concat(F.lit("the calendar does not cover "), F.col("_cal_day").cast("string"))
    types = dict(calendar.dtypes)
    return joined.select(*[F.col(c) for c in df.columns], *[
        F.when(covered, F.col(f"_cal_{n}")).otherwise(F.raise_error(message).cast(types[c])).alias(n) for n, c in columns.items()])


def sessions_count(df: DataFrame, start: Column, end: Column, calendar: DataFrame, name: str) -> DataFrame:
    """Add the number of sessions from ``start`` to ``end``, inclusive; 0 when reversed or NULL.

    Two look-ups of the session number instead of listing the days.
    """
    placed = on_calendar(df, start, calendar, _from="next_seq")
    placed = on_calendar(placed, end, calendar, _to="next_seq", _on="is_session")
    n = F.col("_to") - F.col("_from") + F.when(F.col("_on"), 1).otherwise(0)
    return placed.withColumn(name, F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("bigint")).drop("_from", "_to", "_on")


def sessions_between(calendar: DataFrame, start: date, end: date) -> DataFrame:
    """Sessions of [start, end], inclusive; empty when reversed."""
    return calendar.filter(F.col("is_session") & F.col("cal_date").between(F.lit(start), F.lit(end)))


def preceding_sessions(days: DataFrame, day_col: str, calendar: DataFrame, count: int) -> DataFrame:
    """(day, session_date, sessions_back) for the ``count`` sessions before each day."""
    cal = F.broadcast(calendar)
    here = on_calendar(days.select(day_col).filter(F.col(day_col).isNotNull()).distinct(), F.col(day_col), calendar, _here="next_seq")
    wanted = here.select(
        day_col, F.explode(F.sequence(F.lit(1), F.lit(count))).alias("sessions_back"), "_here"
    ).withColumn("_seq", F.col("_here") - F.col("sessions_back"))
    sessions = cal.filter("is_session").select(
        F.col("next_seq").alias("_seq"), F.col("cal_date").alias("session_date")
    )
    # Sessions before the calendar's first one are not covered either.
    found = wanted.join(F.broadcast(sessions), "_seq", "left")
    outside = F.raise_error(F.concat(F.lit("the calendar begins too late for "), F.col(day_col).cast("string"))).cast("date")
    reached = F.when(F.col("_seq") >= 1, F.col("session_date")).otherwise(outside)
    return found.select(day_col, reached.alias("session_date"), "sessions_back")


def session_label(minute_of_day: Column, close_minute: Column) -> Column:
    """PRE_MARKET / REGULAR / AFTER_HOURS, half-open; NULL outside the window or off-session."""
    return (
        F.when(close_minute.isNull(), F.lit(None).cast("string"))
        .when((minute_of_day >= PRE_MARKET_OPEN) & (minute_of_day < REGULAR_OPEN), F.lit("PRE_MARKET"))
        .when((minute_of_day >= REGULAR_OPEN) & (minute_of_day < close_minute), F.lit("REGULAR"))
        .when((minute_of_day >= close_minute) & (minute_of_day < AFTER_HOURS_CLOSE), F.lit("AFTER_HOURS"))
    )


def with_session(df: DataFrame, ts_col: str, calendar: DataFrame) -> DataFrame:
    """Add ``session``, ``close_minute`` and ``next_seq`` of the row's day."""
    joined = on_calendar(df, F.to_date(ts_col), calendar, close_minute="close_minute", next_seq="next_seq")
    minute = F.hour(ts_col) * 60 + F.minute(ts_col)
    return joined.withColumn("session", session_label(minute, F.col("close_minute")))
