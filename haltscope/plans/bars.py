"""Minute-bar queries: aggregation, VWAP, relative volume, point-in-time reads, inserts, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from haltscope.functions import calendar as CAL
from haltscope.functions import times as T
from haltscope.functions.clean import round_half_even_long, safe_ratio
from haltscope.operators import bars as B
from haltscope.operators import merge as M
from haltscope.plans.derive import Inputs
from haltscope.plans.registry import query, r6
from haltscope.session import work_dir
from haltscope.sources import bars as S

# Mid-bucket moment of the sample month used by the point-in-time queries.
AS_OF = "2024-01-17 14:37:00"

BUCKET_OUT = ["ticker", "bucket_start", "bucket_end", "open", "high", "low", "close", "volume", "is_closed"]


def bucket_sql(minutes: int, where: str = "true", closed: str = "true") -> str:
    return f"""
SELECT ticker, bucket_start, bucket_start + to_minutes({minutes}) AS bucket_end, first(open ORDER BY bar_start) AS open,
       max(high) AS high, min(low) AS low, last("close" ORDER BY bar_start) AS "close", CAST(sum(volume) AS BIGINT) AS volume,
       {closed} AS is_closed
FROM (SELECT *, date_trunc('day', bar_start) + to_minutes(((hour(bar_start) * 60 + minute(bar_start)) // {minutes}) * {minutes})
             AS bucket_start FROM bars WHERE {where})
GROUP BY ticker, bucket_start"""


def _register_timeframe(name: str) -> None:
    minutes = T.parse_timeframe(name)

    @query(f"bars_{name}", bucket_sql(minutes))
    def _(i: Inputs) -> DataFrame:
        return B.aggregate_bars(i.bars, minutes).select(*BUCKET_OUT)


for _name in ("2m", "5m", "15m", "30m", "1h", "1d"):
    _register_timeframe(_name)


@query("bars_in_progress", bucket_sql(
    15, f"bar_start <= TIMESTAMP '{AS_OF}'", f"bucket_start + to_minutes(15) <= TIMESTAMP '{AS_OF}'"))
def _(i: Inputs) -> DataFrame:
    return B.aggregate_bars(i.bars, 15, AS_OF).select(*BUCKET_OUT)


@query("current_bucket", f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY bucket_start DESC) AS rn FROM (
{bucket_sql(60, f"bar_start <= TIMESTAMP '{AS_OF}' AND CAST(bar_start AS DATE) = DATE '{AS_OF[:10]}'",
            f"bucket_start + to_minutes(60) <= TIMESTAMP '{AS_OF}'")})) WHERE rn = 1""")
def _(i: Inputs) -> DataFrame:
    return B.current_bucket(i.bars, 60, AS_OF).select(*BUCKET_OUT)


@query("vwap", """
SELECT ticker, CAST(bar_start AS DATE) AS trading_day,
       round(sum((high + low + "close") / 3 * volume) / nullif(sum(volume), 0), 6) AS vwap
FROM bars GROUP BY 1, 2""")
def _(i: Inputs) -> DataFrame:
    return B.vwap(i.bars).withColumn("vwap", r6("vwap"))


@query("running_features", """
SELECT ticker, bar_start, CAST(bar_start AS DATE) AS trading_day, count(*) OVER w AS visible_bars,
       first_value(open) OVER w AS session_open, max(high) OVER w AS session_high, min(low) OVER w AS session_low,
       CAST(sum(volume) OVER w AS BIGINT) AS session_volume,
       round(sum((high + low + "close") / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0), 6) AS vwap
FROM bars WINDOW w AS (PARTITION BY ticker, CAST(bar_start AS DATE) ORDER BY bar_start ROWS UNBOUNDED PRECEDING)""")
def _(i: Inputs) -> DataFrame:
    return B.running_features(i.bars).withColumn("vwap", r6("vwap"))


# For each bar, everything of that day visible at its minute: the plain join.
@query("point_in_time_panel", """
SELECT a.ticker, a.bar_start, count(*) AS visible_bars, CAST(sum(b.volume) AS BIGINT) AS session_volume,
       max(b.high) AS session_high, min(b.low) AS session_low
FROM bars a JOIN bars b ON b.ticker = a.ticker AND CAST(b.bar_start AS DATE) = CAST(a.bar_start AS DATE)
 AND b.bar_start <= a.bar_start GROUP BY 1, 2""")
def _(i: Inputs) -> DataFrame:
    return B.running_features(i.bars).select(
        "ticker", "bar_start", "visible_bars", "session_volume", "session_high", "session_low")


def rvol_sql(minutes: int) -> str:
    return f"""
SELECT * FROM (WITH b AS (SELECT x.*, c.is_session, c.next_seq AS s FROM ({bucket_sql(minutes)}) x
           JOIN calendar c ON c.cal_date = CAST(x.bucket_start AS DATE))
SELECT a.ticker, a.bucket_start, a.volume, round(avg(h.volume), 6) AS baseline_volume, count(h.volume) AS baseline_days,
       round(a.volume / nullif(avg(h.volume), 0), 10) AS rvol
FROM b a LEFT JOIN b h ON h.ticker = a.ticker AND h.is_session AND h.s BETWEEN a.s - 5 AND a.s - 1
 AND CAST(h.bucket_start AS TIME) = CAST(a.bucket_start AS TIME)
GROUP BY 1, 2, 3)"""


def _rvol(i: Inputs, minutes: int) -> DataFrame:
    out = B.rvol(i.bars, i.calendar, minutes)
    return out.withColumns({"baseline_volume": r6("baseline_volume"), "rvol": F.round("rvol", 10)})


@query("rvol", rvol_sql(30))
def _(i: Inputs) -> DataFrame:
    return _rvol(i, 30)


@query("same_time_of_day", rvol_sql(60))
def _(i: Inputs) -> DataFrame:
    return _rvol(i, 60)


@query("bars_as_of", f"""
SELECT ticker, bar_start, "close" FROM bars WHERE bar_start <= TIMESTAMP '{AS_OF}'""")
def _(i: Inputs) -> DataFrame:
    return B.bars_as_of(i.bars, AS_OF).select("ticker", "bar_start", "close")


@query("look_ahead_guard", f"""
SELECT ticker, bar_start FROM bars WHERE bar_start > TIMESTAMP '{AS_OF}'""")
def _(i: Inputs) -> DataFrame:
    return B.look_ahead_violations(i.bars, "bar_start", AS_OF).select("ticker", "bar_start")


@query("look_ahead_pass", f"""
SELECT ticker, count(*) AS n FROM bars WHERE bar_start <= TIMESTAMP '{AS_OF}' GROUP BY 1""")
def _(i: Inputs) -> DataFrame:
    guarded = B.guard_look_ahead(B.bars_as_of(i.bars, AS_OF), "bar_start", AS_OF)
    return guarded.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


@query("session_minute_features", """
SELECT ticker, bar_start, (hour(bar_start) * 60 + minute(bar_start) - 240)::DOUBLE AS session_minute,
       "close" >= open AS is_up, volume FROM bars""")
def _(i: Inputs) -> DataFrame:
    return B.session_minute_features(i.bars)


@query("bar_integrity", """
SELECT event_id, v AS violation FROM (
  SELECT event_id, unnest([CASE WHEN h < open THEN 'high_below_open' END, CASE WHEN h < "close" THEN 'high_below_close' END,
    CASE WHEN h < low THEN 'high_below_low' END, CASE WHEN low > open THEN 'low_above_open' END,
    CASE WHEN low > "close" THEN 'low_above_close' END, CASE WHEN vol < 0 THEN 'negative_volume' END]) AS v
  FROM (SELECT *, CASE WHEN event_id % 9 = 0 THEN low * 0.5::DOUBLE ELSE high END AS h,
               CASE WHEN event_id % 8 = 0 THEN -1 ELSE volume END AS vol FROM bars)) WHERE v IS NOT NULL""")
def _(i: Inputs) -> DataFrame:
    e = F.col("event_id")
    broken = i.bars.withColumn("high", F.when(e % 9 == 0, F.col("low") * 0.5).otherwise(F.col("high"))).withColumn(
        "volume", F.when(e % 8 == 0, F.lit(-1)).otherwise(F.col("volume")))
    return B.integrity_violations(broken).select("event_id", "violation")


@query("canonical_bar_shape", """
SELECT ticker, market, bar_start, open, high, low, "close", volume FROM bars""")
def _(i: Inputs) -> DataFrame:
    return B.canonical_bars(i.bars)


@query("watchlist_semi", """
SELECT ticker, bar_start FROM bars WHERE ticker IN (SELECT event_type || '-' || (user_id // 50) FROM events WHERE value > 300)""")
def _(i: Inputs) -> DataFrame:
    listed = i.table("events").filter("value > 300").select(i.bar_ticker.alias("ticker"))
    return B.watchlist_only(i.bars, listed).select("ticker", "bar_start")


@query("ordered_bars", "SELECT ticker, bar_start FROM bars ORDER BY ticker, bar_start")
def _(i: Inputs) -> DataFrame:
    return S.ordered_bars(i.bars).select("ticker", "bar_start")


# -- inserts ---------------------------------------------------------------------------

def insert_sql(keys: str, match: str) -> str:
    return f"""
SELECT {keys}, min(volume) AS volume FROM incoming_bars n WHERE NOT EXISTS (SELECT 1 FROM stored_bars o WHERE {match}) GROUP BY {keys}"""


@query("insert_new_bars_raw", insert_sql("ticker, market, bar_start, source", """
o.ticker = n.ticker AND o.market IS NOT DISTINCT FROM n.market AND o.bar_start = n.bar_start AND o.source = n.source"""))
def _(i: Inputs) -> DataFrame:
    return M.new_raw_bars(i.stored_bars, i.incoming_bars).select(*M.RAW_BAR_KEY, "volume")


@query("insert_new_bars_core", """
SELECT ticker, market, bar_start, volume, CAST(NULL AS VARCHAR) AS session, CAST(NULL AS VARCHAR) AS source_provider
FROM incoming_bars n WHERE NOT EXISTS (SELECT 1 FROM stored_bars o WHERE o.ticker = n.ticker
 AND o.market IS NOT DISTINCT FROM n.market AND o.bar_start = n.bar_start)""")
def _(i: Inputs) -> DataFrame:
    return M.new_core_bars(i.stored_bars, i.incoming_bars).select(*M.CORE_BAR_KEY, "volume", "session", "source_provider")


@query("insert_outcome_bars", """
SELECT CASE WHEN hour(bar_start) < 16 THEN 'SKIPPED' ELSE 'INSERTED' END AS action, count(*) AS n FROM incoming_bars GROUP BY 1""")
def _(i: Inputs) -> DataFrame:
    return M.insert_outcome(i.stored_bars, i.incoming_bars, M.RAW_BAR_KEY).groupBy("action").agg(
        F.count(F.lit(1)).alias("n"))


# -- files: written from the tables, then read back ---------------------------------------

@query("scan_csv_bars", 'SELECT ticker, market, bar_start, open, high, low, "close", volume FROM bars')
def _(i: Inputs) -> DataFrame:
    folder = work_dir(i.spark, "csv-bars")
    B.canonical_bars(i.bars).write.option("header", True).csv(folder)
    return S.scan_csv_bars(i.spark, folder)


def _flat_rows(i: Inputs) -> DataFrame:
    """Bars in flat-file form: instants in nanoseconds, fractional volumes, named by day."""
    e = F.col("event_id")
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    # The minute is taken as UTC, so local days differ from the file's near midnight.
    nanos = T.micros_between(origin, "bar_start") * 1000
    return i.bars.select(
        "ticker", (F.col("volume") + (e % 4) * 0.25).alias("volume"), "open", "close", "high", "low",
        nanos.alias("window_start"), (e % 10 + 0.5).alias("transactions"), F.to_date("bar_start").alias("_day"),
    )


_FLAT_SQL = """
SELECT b.ticker, b.bar_start, b.volume, CASE WHEN m < 570 THEN 'PRE_MARKET' WHEN m < c.close_minute THEN 'REGULAR' ELSE 'AFTER_HOURS' END AS session,
       b.transaction_count
FROM (SELECT ticker, bar_start - INTERVAL 5 HOUR AS bar_start, CAST(bar_start AS DATE) AS day,
             CAST(round_even(volume + (event_id % 4) * 0.25::DOUBLE, 0) AS BIGINT) AS volume,
             CAST(round_even(event_id % 10 + 0.5::DOUBLE, 0) AS BIGINT) AS transaction_count,
             hour(bar_start - INTERVAL 5 HOUR) * 60 + minute(bar_start) AS m FROM bars) b
JOIN calendar c ON c.cal_date = b.day AND c.is_session
WHERE CAST(b.bar_start AS DATE) = b.day AND m >= 240 AND m < 1200"""


@query("scan_flatfile_bars", _FLAT_SQL)
def _(i: Inputs) -> DataFrame:
    folder = work_dir(i.spark, "flatfiles")
    # One gz folder per day, as the provider lays them out.
    (
        _flat_rows(i).withColumn("day", F.date_format("_day", "yyyy-MM-dd")).drop("_day")
        .repartition("day").write.partitionBy("day").option("header", True).option("compression", "gzip").csv(folder)
    )
    shaped = S.scan_flatfile_bars(i.spark, folder, i.calendar)
    return shaped.select("ticker", "bar_start", "volume", "session", "transaction_count")


@query("scan_watchlist", "SELECT DISTINCT 'S' || user_id AS ticker FROM events")
def _(i: Inputs) -> DataFrame:
    folder = work_dir(i.spark, "watchlist")
    tickers = i.table("events").select(F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("t"))
    tickers.select(F.array("t").alias("tickers")).write.json(folder)
    return S.require_watchlist(S.scan_watchlist(i.spark, folder, whole_files=False))


# -- calendar and time functions ----------------------------------------------------------------

@query("trading_calendar", """
SELECT e.d, c.is_session, c.close_minute, c.next_session, c.next_seq, e.n
FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1) e JOIN calendar c ON c.cal_date = e.d""")
def _(i: Inputs) -> DataFrame:
    days = i.table("events").groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    same = {c: c for c in ("is_session", "close_minute", "next_session", "next_seq")}
    return CAL.on_calendar(days, F.col("d"), i.calendar, **same).select(
        "d", "is_session", "close_minute", "next_session", F.col("next_seq").cast("bigint").alias("next_seq"), "n")


@query("calendar_sessions_by_year", """
SELECT CAST(year(o_orderdate) + 25 AS INTEGER) AS y, count(*) AS orders, max(c.n) AS sessions FROM orders
JOIN (SELECT year(cal_date) AS yy, count(*) FILTER (WHERE is_session) AS n FROM calendar GROUP BY 1) c ON c.yy = year(o_orderdate) + 25
GROUP BY 1""")
def _(i: Inputs) -> DataFrame:
    # Order years are moved into the calendar's range.
    per_year = i.calendar.groupBy(F.year("cal_date").alias("y")).agg(F.count_if("is_session").alias("sessions"))
    orders = i.table("orders").groupBy((F.year("o_orderdate") + 25).alias("y")).agg(F.count(F.lit(1)).alias("orders"))
    return orders.join(F.broadcast(per_year), "y").select("y", "orders", "sessions")


@query("early_close_days", """
SELECT e.d AS early_close_date, count(*) AS orders FROM orders o JOIN early_days e ON e.y = year(o.o_orderdate) + 25 GROUP BY 1""")
def _(i: Inputs) -> DataFrame:
    days = CAL.early_close_days(i.spark, *i.calendar_years)
    orders = i.table("orders").groupBy((F.year("o_orderdate") + 25).alias("year")).agg(F.count(F.lit(1)).alias("orders"))
    return orders.join(F.broadcast(days), "year").select("early_close_date", "orders")


@query("early_minus_closed", """
SELECT c.d AS closed_date, count(*) AS orders FROM orders o JOIN closed_days c ON c.y = year(o.o_orderdate) + 25
WHERE c.d NOT IN (SELECT d FROM early_days) GROUP BY 1""")
def _(i: Inputs) -> DataFrame:
    span = (i.spark, *i.calendar_years)
    closed = CAL.closed_days(*span)
    early = CAL.early_close_days(*span).select(F.col("early_close_date").alias("closed_date"))
    only = closed.join(early, "closed_date", "left_anti")
    orders = i.table("orders").groupBy((F.year("o_orderdate") + 25).alias("year")).agg(F.count(F.lit(1)).alias("orders"))
    return orders.join(F.broadcast(only), "year").select("closed_date", "orders")


@query("trading_days_between", """
SELECT o.obs_id, count(c.cal_date) AS sessions FROM halt_obs o LEFT JOIN calendar c ON c.is_session
 AND c.cal_date BETWEEN CAST(o.halt_start AS DATE) AND CAST(o.halt_end AS DATE) GROUP BY 1""")
def _(i: Inputs) -> DataFrame:
    rows = i.halt_obs.select("obs_id", F.to_date("halt_start").alias("a"), F.to_date("halt_end").alias("b"))
    return CAL.sessions_count(rows, F.col("a"), F.col("b"), i.calendar, "sessions").select("obs_id", "sessions")


@query("preceding_sessions", """
SELECT d, s.cal_date AS session_date, CAST(x.next_seq - s.next_seq AS INTEGER) AS sessions_back
FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events) e JOIN calendar x ON x.cal_date = e.d
JOIN calendar s ON s.is_session AND s.next_seq BETWEEN x.next_seq - 5 AND x.next_seq - 1""")
def _(i: Inputs) -> DataFrame:
    days = i.table("events").select(F.to_date("ts").alias("d"))
    return CAL.preceding_sessions(days, "d", i.calendar, 5)


@query("classify_session", """
SELECT e.event_id, CASE WHEN NOT c.is_session THEN NULL WHEN m >= 240 AND m < 570 THEN 'PRE_MARKET'
  WHEN m >= 570 AND m < c.close_minute THEN 'REGULAR' WHEN m >= c.close_minute AND m < 1200 THEN 'AFTER_HOURS' END AS session
FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m FROM events) e JOIN calendar c ON c.cal_date = CAST(e.ts AS DATE)""")
def _(i: Inputs) -> DataFrame:
    return CAL.with_session(i.table("events"), "ts", i.calendar).select("event_id", "session")


@query("bucket_start", """
SELECT event_id, date_trunc('day', ts) + to_minutes(((hour(ts) * 60 + minute(ts)) // 30) * 30) AS bucket_start FROM events""")
def _(i: Inputs) -> DataFrame:
    return i.table("events").select("event_id", T.bucket_start("ts", 30).alias("bucket_start"))


@query("parse_timeframe", """
SELECT t.tf AS timeframe, t.m AS minutes, count(DISTINCT (event_type, epoch_us(ts) // (t.m::BIGINT * 60000000))) AS buckets
FROM events, (VALUES ('1m', 1), ('2m', 2), ('5m', 5), ('15m', 15), ('30m', 30), ('1h', 60), ('1d', 1440), ('daily', 1440)) t(tf, m)
GROUP BY 1, 2""")
def _(i: Inputs) -> DataFrame:
    from functools import reduce

    parts = []
    for name in T.TIMEFRAME_MINUTES:
        m = T.parse_timeframe(name)
        buckets = i.table("events").select("event_type", T.bucket_start("ts", m).alias("b")).distinct()
        parts.append(buckets.agg(F.count(F.lit(1)).alias("buckets")).select(
            F.lit(name).alias("timeframe"), F.lit(m).alias("minutes"), "buckets"))
    return reduce(DataFrame.unionByName, parts)


@query("utc_ns_to_local", """
SELECT event_id, ts - CASE WHEN ts >= TIMESTAMP '2024-03-10 07:00:00' AND ts < TIMESTAMP '2024-11-03 06:00:00'
                      THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END AS local_time
FROM (SELECT event_id, ts + to_days(CAST(event_id % 300 AS INTEGER)) AS ts FROM events)""")
def _(i: Inputs) -> DataFrame:
    from haltscope.plans.derive import seconds

    moved = F.col("ts") + seconds((F.col("event_id") % 300) * 86400)
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return i.table("events").select("event_id", T.utc_nanos_to_local(T.micros_between(origin, moved) * 1000).alias("local_time"))


@query("localize", """
SELECT event_id, ts + INTERVAL 5 HOUR AS utc_time, ts AS back FROM events""")
def _(i: Inputs) -> DataFrame:
    utc = T.local_to_utc("ts")
    return i.table("events").select("event_id", utc.alias("utc_time"), T.utc_to_local(utc).alias("back"))


@query("round_half_even_int", """
SELECT event_id, CAST(round_even(event_id % 50 + 0.5::DOUBLE, 0) AS BIGINT) AS half, CAST(round_even(value, 0) AS BIGINT) AS whole FROM events""")
def _(i: Inputs) -> DataFrame:
    return i.table("events").select(
        "event_id", round_half_even_long(F.col("event_id") % 50 + 0.5).alias("half"), round_half_even_long("value").alias("whole"))


@query("safe_ratio", "SELECT event_id, value / nullif((event_id % 5)::DOUBLE, 0) AS ratio FROM events")
def _(i: Inputs) -> DataFrame:
    return i.table("events").select("event_id", safe_ratio(F.col("value"), (F.col("event_id") % 5).cast("double")).alias("ratio"))
