import gzip
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from haltscope.functions import calendar as CAL
from haltscope.functions import clean as C
from haltscope.functions import times as T
from haltscope.operators import bars as B
from haltscope.operators import quality as Q
from haltscope.sources import bars as S

BAR = "ticker string, market string, bar_start timestamp_ntz, open double, high double, low double, close double, volume long"


def minute_bars(day, start, n, ticker="T", volume=100, price=10.0):
    t0 = datetime.fromisoformat(f"{day} {start}")
    return [(ticker, None, t0 + timedelta(minutes=k), price + k, price + k + 2, price + k - 1, price + k + 1, volume + k)
            for k in range(n)]


def value(spark, column, schema, *row):
    return spark.createDataFrame([row], schema).select(column).first()[0]


# -- calendar ----------------------------------------------------------------

@pytest.mark.parametrize("day,close", [
    ("2024-01-02", 960), ("2024-01-01", None), ("2024-01-15", None), ("2024-03-29", None), ("2024-05-27", None),
    ("2024-07-03", 780), ("2024-07-04", None), ("2024-11-28", None), ("2024-11-29", 780), ("2024-12-24", 780),
    ("2021-06-18", 960), ("2022-06-20", None), ("2026-07-03", None), ("2026-07-02", 960), ("2021-12-31", 960),
    ("2023-01-02", None), ("2021-12-24", None), ("2024-01-06", None),
])
def test_sessions(calendar, day, close):
    row = calendar.filter(F.col("cal_date") == day).first()
    assert row.close_minute == close and row.is_session == (close is not None)


def test_session_numbers_are_consecutive(calendar):
    seqs = [r.next_seq for r in calendar.filter("is_session").orderBy("cal_date").collect()]
    assert seqs == list(range(seqs[0], seqs[0] + len(seqs)))
    assert calendar.count() == (date(2027, 12, 31) - date(2019, 1, 1)).days + 1


def test_reversed_range_is_empty(calendar):
    assert CAL.sessions_between(calendar, date(2024, 1, 10), date(2024, 1, 2)).count() == 0
    assert CAL.sessions_between(calendar, date(2024, 1, 12), date(2024, 1, 16)).count() == 2


def test_preceding_sessions_skip_holidays(spark, calendar):
    days = spark.createDataFrame([(date(2024, 1, 17),), (date(2024, 1, 14),)], "d date")
    got = {}
    for r in CAL.preceding_sessions(days, "d", calendar, 2).collect():
        got.setdefault(str(r.d), {})[r.sessions_back] = str(r.session_date)
    assert got == {"2024-01-17": {1: "2024-01-16", 2: "2024-01-12"}, "2024-01-14": {1: "2024-01-12", 2: "2024-01-11"}}


@pytest.mark.parametrize("clock,label", [
    ("03:59:59", None), ("04:00:00", "PRE_MARKET"), ("09:29:59", "PRE_MARKET"), ("09:30:00", "REGULAR"),
    ("12:59:59", "REGULAR"), ("13:00:00", "AFTER_HOURS"), ("19:59:59", "AFTER_HOURS"), ("20:00:00", None),
])
def test_session_label_on_an_early_close(spark, calendar, clock, label):
    df = spark.createDataFrame([(datetime.fromisoformat(f"2024-07-03 {clock}"),)], "ts timestamp_ntz")
    assert CAL.with_session(df, "ts", calendar).first().session == label


def test_time_zones_round_trip(spark):
    utc = datetime(2024, 7, 1, 13, 30, 0, 250000, tzinfo=timezone.utc)
    nanos = int(utc.timestamp()) * 10**9 + 250_000_000
    local = value(spark, T.utc_nanos_to_local("n"), "n long", nanos)
    assert local == utc.astimezone(ZoneInfo("America/New_York")).replace(tzinfo=None)
    assert value(spark, T.utc_to_local(T.local_to_utc("t")), "t timestamp_ntz", datetime(2024, 1, 5, 9, 30)) == datetime(2024, 1, 5, 9, 30)


def test_feed_times(spark):
    parse = T.parse_feed_datetime("d", "t")
    schema = "d string, t string"
    assert value(spark, parse, schema, "01/05/2024", "10:00:01 .5") == datetime(2024, 1, 5, 10, 0, 1, 500000)
    assert value(spark, parse, schema, " 1/5/2024 ", "10:00:01") == datetime(2024, 1, 5, 10, 0, 1)
    assert value(spark, parse, schema, "01/05/2024", None) is None
    assert value(spark, parse, schema, "13/05/2024", "10:00:00") is None
    assert value(spark, T.parse_multi_format_date("d"), "d string", "03/04/2024") == date(2024, 4, 3)
    assert value(spark, T.parse_multi_format_date("d"), "d string", "12/31/2024") == date(2024, 12, 31)
    assert value(spark, T.parse_multi_format_date("d"), "d string", "tomorrow") is None


def test_unknown_timeframe():
    assert T.parse_timeframe("daily") == 1440
    with pytest.raises(ValueError):
        T.parse_timeframe("3m")


def test_rounding_is_half_to_even(spark):
    assert [value(spark, C.round_half_even_long("x"), "x double", v) for v in (0.5, 1.5, 2.5, 3.2)] == [0, 2, 2, 3]


# -- bars ----------------------------------------------------------------------

def test_buckets(spark):
    bars = spark.createDataFrame(minute_bars("2024-01-05", "09:58:00", 5), BAR)
    rows = B.aggregate_bars(bars, 5).orderBy("bucket_start").collect()
    assert [(str(r.bucket_start.time()), r.open, r.high, r.low, r.close, r.volume, r.is_closed) for r in rows] == [
        ("09:55:00", 10.0, 13.0, 9.0, 12.0, 201, True), ("10:00:00", 12.0, 16.0, 11.0, 15.0, 309, True)]
    assert B.aggregate_bars(bars, 1440).first().bucket_end == datetime(2024, 1, 6)
    assert B.aggregate_bars(bars.filter("false"), 5).count() == 0


def test_running_bucket_is_flagged_and_never_looks_ahead(spark):
    bars = spark.createDataFrame(minute_bars("2024-01-05", "10:00:00", 10), BAR)
    rows = B.aggregate_bars(bars, 5, "2024-01-05 10:06:00").orderBy("bucket_start").collect()
    assert [(r.is_closed, r.volume) for r in rows] == [(True, 510), (False, 211)]
    # The end of the bucket itself closes it.
    assert B.aggregate_bars(bars, 5, "2024-01-05 10:10:00").filter("not is_closed").count() == 0


def test_guard_fails_on_later_information(spark):
    bars = spark.createDataFrame(minute_bars("2024-01-05", "10:00:00", 3), BAR)
    assert B.guard_look_ahead(bars, "bar_start", "2024-01-05 10:02:00").count() == 3
    with pytest.raises(Exception, match="look-ahead"):
        B.guard_look_ahead(bars, "bar_start", "2024-01-05 10:01:00").collect()
    with pytest.raises(ValueError):
        B.as_moment(datetime(2024, 1, 5, tzinfo=timezone.utc))


def test_as_of_reaches_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # or the plan text is cut
    path = str(tmp_path / "bars")
    spark.createDataFrame(minute_bars("2024-01-05", "10:00:00", 30), BAR).write.parquet(path)
    visible = B.bars_as_of(spark.read.parquet(path), "2024-01-05 10:09:00", "T", "2024-01-05").select("bar_start", "close")
    plan = visible._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(bar_start" in plan and "EqualTo(ticker,T)" in plan and "volume" not in plan
    assert visible.count() == 10


def test_vwap_and_zero_volume(spark):
    rows = [("T", None, datetime(2024, 1, 5, 10, k), 1.0, 12.0, 9.0, 9.0 + 3 * k, v) for k, v in ((0, 100), (1, 300))]
    rows += [("Z", None, datetime(2024, 1, 5, 10, 0), 1.0, 1.0, 1.0, 1.0, 0)]
    got = {r.ticker: r.vwap for r in B.vwap(spark.createDataFrame(rows, BAR)).collect()}
    assert got["T"] == pytest.approx((10 * 100 + 11 * 300) / 400) and got["Z"] is None


def test_running_features_equal_a_fresh_read_of_every_minute(spark):
    bars = spark.createDataFrame(minute_bars("2024-01-05", "10:00:00", 12) + minute_bars("2024-01-08", "10:00:00", 3), BAR)
    for r in B.running_features(bars).collect():
        seen = B.vwap(bars, r.bar_start).filter(F.col("trading_day") == r.trading_day).first()
        assert r.vwap == pytest.approx(seen.vwap)


def test_relative_volume(spark, calendar):
    # Five sessions before Wednesday the 17th, one of them without the bucket.
    rows = []
    for day, v in (("2024-01-09", 100), ("2024-01-10", 200), ("2024-01-11", 300), ("2024-01-12", None), ("2024-01-16", 400)):
        if v:
            rows += minute_bars(day, "09:30:00", 1, volume=v)
    rows += minute_bars("2024-01-08", "09:30:00", 1, volume=9999)  # a session too early
    rows += minute_bars("2024-01-13", "09:30:00", 1, volume=9999)  # a Saturday is no baseline
    rows += minute_bars("2024-01-17", "09:30:00", 2, volume=500)
    out = {str(r.bucket_start): r for r in B.rvol(spark.createDataFrame(rows, BAR), calendar, 5).collect()}
    today = out["2024-01-17 09:30:00"]
    assert (today.baseline_days, today.baseline_volume) == (4, 250.0) and today.rvol == pytest.approx(1001 / 250)
    assert out["2024-01-08 09:30:00"].rvol is None


def test_integrity(spark):
    rows = [("T", None, datetime(2024, 1, 5), 10.0, 9.0, 11.0, 10.0, -1)]
    broken = {r.violation for r in B.integrity_violations(spark.createDataFrame(rows, BAR)).collect()}
    assert broken == {"high_below_open", "high_below_close", "high_below_low", "low_above_open", "low_above_close", "negative_volume"}


def test_flat_files(spark, calendar, tmp_path):
    def nanos(text):
        return int(datetime.fromisoformat(text).replace(tzinfo=ZoneInfo("America/New_York")).timestamp()) * 10**9

    lines = ["ticker,volume,open,close,high,low,window_start,transactions",
             f"A,10.5,1,2,3,0.5,{nanos('2024-01-05 09:30:00')},2.5",
             f"B,11.5,1,2,3,0.5,{nanos('2024-01-05 16:00:00')},3",
             f"C,1,1,2,3,0.5,{nanos('2024-01-05 03:59:00')},3",
             f"D,1,1,2,3,0.5,{nanos('2024-01-06 10:00:00')},3"]
    with gzip.open(tmp_path / "2024-01-05.csv.gz", "wt") as handle:
        handle.write("\n".join(lines) + "\n")
    rows = {r.ticker: r for r in S.scan_flatfile_bars(spark, str(tmp_path), calendar, {"source_provider": "P"}).collect()}
    assert set(rows) == {"A", "B"}
    assert (rows["A"].bar_start, rows["A"].volume, rows["A"].session, rows["A"].transaction_count) == (
        datetime(2024, 1, 5, 9, 30), 10, "REGULAR", 2)
    assert (rows["B"].volume, rows["B"].session, rows["B"].source_provider, rows["B"].market) == (12, "AFTER_HOURS", "P", None)


def test_csv_bars_and_watchlists(spark, tmp_path):
    (tmp_path / "b.csv").write_text("ticker,market,bar_start,open,high,low,close,volume\nA,,2024-01-05T09:30:00,1,2,0.5,1.5,10\n")
    row = S.scan_csv_bars(spark, str(tmp_path / "b.csv")).first()
    assert (row.bar_start, row.volume, row.market) == (datetime(2024, 1, 5, 9, 30), 10, None)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.scan_csv_bars(spark, str(tmp_path / "missing.csv"))
    (tmp_path / "w.json").write_text('{"tickers": ["A", "B", "A"]}')
    (tmp_path / "none.json").write_text('{"tickers": []}')
    assert {r.ticker for r in S.require_watchlist(S.scan_watchlist(spark, str(tmp_path / "w.json"))).collect()} == {"A", "B"}
    with pytest.raises(Exception, match="watchlist is empty"):
        S.require_watchlist(S.scan_watchlist(spark, str(tmp_path / "none.json"))).collect()


def test_days_without_a_session(spark, calendar):
    days = spark.createDataFrame([(date(2024, 1, 5),), (date(2024, 1, 6),), (date(2024, 1, 15),)], "d date")
    assert {str(r.d) for r in Q.not_session_days(days, "d", calendar).collect()} == {"2024-01-06", "2024-01-15"}
    assert Q.future_days(days, "d", F.lit("2024-01-06").cast("date")).count() == 2


def test_calendar_bounds_come_from_the_data(spark):
    at = [datetime(1999, 7, 6, 10), datetime(2040, 3, 1, 11), None]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(at)], "k int, ts timestamp_ntz")
    cal = CAL.calendar_for(spark, (rows, "ts"))
    assert cal.agg(F.min("cal_date"), F.max("cal_date")).first() == (date(1998, 1, 1), date(2041, 12, 31))
    found = {r.k: r.close_minute for r in CAL.on_calendar(rows, F.to_date("ts"), cal, close_minute="close_minute").collect()}
    assert found == {0: 960, 1: 960, 2: None}
    before = CAL.preceding_sessions(rows.select(F.to_date("ts").alias("d")), "d", cal, 2).collect()
    assert {(r.d.year, r.session_date) for r in before} == {
        (1999, date(1999, 7, 2)), (1999, date(1999, 7, 1)), (2040, date(2040, 2, 29)), (2040, date(2040, 2, 28))}
    days = rows.select("k", F.lit(date(1999, 12, 30)).alias("a"), F.lit(date(2000, 1, 4)).alias("b"))
    assert {r.n for r in CAL.sessions_count(days, F.col("a"), F.col("b"), cal, "n").collect()} == {4}


def test_a_day_outside_the_calendar_is_an_error(spark):
    rows = spark.createDataFrame([(datetime(2035, 1, 2, 10),)], "ts timestamp_ntz")
    cal = CAL.trading_calendar(spark, date(2020, 1, 1), date(2030, 12, 31))
    with pytest.raises(Exception, match="does not cover 2035-01-02"):
        CAL.on_calendar(rows, F.to_date("ts"), cal, x="next_seq").collect()
    with pytest.raises(Exception, match="begins too late"):
        CAL.preceding_sessions(spark.createDataFrame([(date(2020, 1, 3),)], "d date"), "d", cal, 5).collect()
