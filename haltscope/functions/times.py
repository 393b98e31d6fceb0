"""Date and time expressions on naive exchange-local (TIMESTAMP_NTZ) columns.

Nothing here depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EXCHANGE_TZ = "America/New_York"

# Timeframe name -> minutes.
TIMEFRAME_MINUTES = {
    "1m": 1,
    "2m": 2,
    "5m": 5,
    "15m": 15,
    "30m": 30,
    "1h": 60,
    "1d": 1440,
    "daily": 1440,
}


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_timeframe(name: str) -> int:
    if name not in TIMEFRAME_MINUTES:
        raise ValueError(f"unknown timeframe {name!r}; expected one of {sorted(TIMEFRAME_MINUTES)}")
    return TIMEFRAME_MINUTES[name]


def micros_between(start: Column | str, end: Column | str) -> Column:
    """Whole microseconds from start to end (negative when reversed)."""
    gap = _c(end) - _c(start)
    return (
        F.extract(F.lit("DAY"), gap).cast("long") * F.lit(86_400_000_000)
        + F.extract(F.lit("HOUR"), gap).cast("long") * F.lit(3_600_000_000)
        + F.extract(F.lit("MINUTE"), gap).cast("long") * F.lit(60_000_000)
        + (F.extract(F.lit("SECOND"), gap) * F.lit(1_000_000)).cast("long")
    )


def plus_minutes(ts: Column | str, minutes: Column | int) -> Column:
    minutes = F.lit(minutes) if isinstance(minutes, int) else minutes
    zero = F.lit(0)
    return _c(ts) + F.make_dt_interval(zero, zero, minutes.cast("int"), zero.cast("decimal(18,6)"))


def day_start(d: Column | str) -> Column:
    return F.to_date(_c(d)).cast("timestamp_ntz")


def minute_of_day(ts: Column | str) -> Column:
    return F.hour(_c(ts)) * 60 + F.minute(_c(ts))


def bucket_start(ts: Column | str, minutes: int) -> Column:
    """Start of the midnight-anchored bucket of ``minutes`` that holds ts."""
    offset = F.floor(minute_of_day(ts) / F.lit(minutes)).cast("int") * F.lit(minutes)
    return plus_minutes(day_start(ts), offset)


def date_and_time(d: Column | str, time_text: Column | str) -> Column:
    """DATE + 'HH:mm:ss[.ffffff]' text -> timestamp; NULL if either is missing."""
    text = F.concat(F.date_format(_c(d), "yyyy-MM-dd"), F.lit(" "), _c(time_text))
    return text.try_cast("timestamp_ntz")


def iso_date_text(date_text: Column) -> Column:
    """'M/d/yyyy' -> 'yyyy-MM-dd' text; NULL when the shape is different."""
    shape = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$"
    part = lambda i: F.regexp_extract(date_text, shape, i)
    piece = lambda at, n: F.substring(date_text, at, n)
    # Ten characters of the usual form are cut at fixed places.
    usual = (F.octet_length(date_text) == 10) & date_text.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$")
    return F.when(usual, F.concat(piece(7, 4), F.lit("-"), piece(1, 2), F.lit("-"), piece(4, 2))).when(
        date_text.rlike(shape),
        F.concat_ws("-", part(3), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")),
    )


def parse_feed_date(date_text: Column | str) -> Column:
    """MM/dd/yyyy -> DATE, NULL when unparsable."""
    return iso_date_text(_c(date_text)).try_cast("date")


def parse_feed_time(time_text: Column | str) -> Column:
    """'HH:mm:ss[.f]' with stray inner blanks -> the blank-free text, '' -> NULL."""
    text = _c(time_text)
    bare = text.rlike(r"^[!-~]*$")
    return F.nullif(F.when(bare, text).otherwise(F.regexp_replace(text, r"(?U)\s+", "")), F.lit(""))


def iso_datetime(iso_date: Column, time_text: Column | str) -> Column:
    """'yyyy-MM-dd' text + HH:mm[:ss[.ffffff]] -> timestamp; NULL if either part is missing."""
    clock = parse_feed_time(time_text)
    clock = F.when(clock.rlike(r"^\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?$"), clock)
    return F.concat(iso_date, F.lit(" "), clock).try_cast("timestamp_ntz")


def parse_feed_datetime(date_text: Column | str, time_text: Column | str) -> Column:
    """MM/dd/yyyy + HH:mm[:ss[.ffffff]] -> timestamp; NULL if either part is missing."""
    return iso_datetime(iso_date_text(_c(date_text)), time_text)


def parse_multi_format_date(text: Column | str) -> Column:
    """dd/MM/yyyy, then yyyy-MM-dd, then MM/dd/yyyy: the first that parses."""
    t = F.trim(_c(text))
    slashed = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
    dashed = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    two = lambda x: F.lpad(x, 2, "0")

    def build(shape: str, year: int, month: int, day: int) -> Column:
        g = lambda i: F.regexp_extract(t, shape, i)
        return F.when(t.rlike(shape), F.concat_ws("-", g(year), two(g(month)), two(g(day)))).try_cast("date")

    return F.coalesce(build(slashed, 3, 2, 1), build(dashed, 1, 2, 3), build(slashed, 3, 1, 2))


def utc_nanos_to_local(nanos: Column | str, tz: str = EXCHANGE_TZ) -> Column:
    """Epoch nanoseconds -> naive local wall clock."""
    seconds = F.expr("0").cast("decimal(18,6)") + (
        F.floor(_c(nanos) / F.lit(1000).cast("decimal(5,0)")).cast("decimal(18,0)") / F.lit(1_000_000)
    ).cast("decimal(18,6)")
    zero = F.lit(0)
    utc_wall = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), utc_wall)


def local_to_utc(ts: Column | str, tz: str = EXCHANGE_TZ) -> Column:
    """Naive local wall clock -> naive UTC wall clock."""
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), _c(ts))


def utc_to_local(ts: Column | str, tz: str = EXCHANGE_TZ) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), _c(ts))


def filename_date(file_name: Column | str, prefix: str = "tradehalts_") -> Column:
    """Date in a name such as ``<prefix>2024-01-31.xml``; NULL when there is none."""
    text = F.regexp_extract(_c(file_name), rf"(?:^|/){prefix}(\d{{4}}-\d{{2}}-\d{{2}})\.[^./]+$", 1)
    return F.nullif(text, F.lit("")).try_cast("date")


def lookback_start(observation_date: Column | str, months: Column | str) -> Column:
    """T minus X months, day clamped to the month's end; NULL months = unbounded."""
    return F.add_months(_c(observation_date), -_c(months))
