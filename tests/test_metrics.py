from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from haltscope.functions import calendar as CAL
from haltscope.operators import halt_days as D
from haltscope.operators.halt_days import episode_days, halt_days
from haltscope.operators import metrics as X

EPISODE = ("symbol string, market string, reason_code string, halt_start timestamp_ntz, halt_end timestamp_ntz,"
           " duration_minutes double, halt_close_status string")
REQUEST = ("request_id long, ticker string, observation_date date, lookback_months int, reason_codes array<string>")


def ep(start, end=None, reason="LUDP", symbol="ABC"):
    s = datetime.fromisoformat(start)
    e = datetime.fromisoformat(end) if end else None
    minutes = (e - s).total_seconds() / 60 if e else None
    return (symbol, "NASDAQ", reason, s, e, minutes, "NO")


def run(spark, calendar, episodes, day, months=36, reasons=("LUDP",), ticker="ABC"):
    eps = spark.createDataFrame(episodes, EPISODE)
    req = spark.createDataFrame([(1, ticker, date.fromisoformat(day), months, list(reasons))], REQUEST)
    rows = X.halt_metrics(req, eps, calendar).collect()
    assert len(rows) == 1
    return rows[0]


def test_no_episodes(spark, calendar):
    m = run(spark, calendar, [], "2024-01-10")
    assert m.metric_1 == 0 and m.metric_2 is None and m.metric_3 is None and m.metric_4 is None
    assert (m.metric_5, m.metric_6, m.metric_7, m.metric_8) == ("No", 0, None, None)
    assert (m.metric_9, m.metric_10, m.metric_11, m.core_episode_count) == (0, "No", 0, 0)


def test_daily_counts_and_observation_day(spark, calendar):
    rows = [ep("2024-01-08 10:00:00", "2024-01-08 10:05:00")] * 3 + [ep("2024-01-10 10:00:00", "2024-01-10 10:05:00")]
    m = run(spark, calendar, rows, "2024-01-10")
    assert (m.metric_1, m.metric_2, m.metric_3, m.metric_4) == (2, 2.0, 0, 2.0)
    assert (m.metric_10, m.metric_11, m.core_episode_count) == ("Yes", 1, 4)


def test_multi_day_over_a_weekend_and_a_holiday(spark, calendar):
    # Friday to Tuesday over Martin Luther King Day: two sessions, one block.
    m = run(spark, calendar, [ep("2024-01-12 15:00:00", "2024-01-16 10:00:00")], "2024-01-20")
    assert (m.metric_1, m.metric_5, m.metric_6, m.metric_7, m.metric_8) == (2, "Yes", 1, 2.0, 2)
    assert m.metric_9 == 1 and m.core_episode_count == 1 and m.metric_4 == 4.0


def test_end_exactly_at_the_close_is_not_at_close(spark, calendar):
    assert run(spark, calendar, [ep("2024-01-10 15:00:00", "2024-01-10 16:00:00")], "2024-01-10").metric_9 == 0
    assert run(spark, calendar, [ep("2024-01-10 15:00:00", "2024-01-10 16:00:01")], "2024-01-10").metric_9 == 1
    # The start is not looked at: a halt that began after the close counts.
    assert run(spark, calendar, [ep("2024-01-10 17:00:00", "2024-01-10 17:05:00")], "2024-01-10").metric_9 == 1


def test_early_close_session(spark, calendar):
    assert run(spark, calendar, [ep("2024-07-03 12:00:00", "2024-07-03 13:30:00")], "2024-07-05").metric_9 == 1


def test_open_episode_counts_on_its_start_day_only(spark, calendar):
    m = run(spark, calendar, [ep("2024-01-09 10:00:00")], "2024-01-20")
    assert (m.metric_1, m.metric_9, m.metric_3) == (1, 1, 11)
    # An open weekend start covers no session.
    assert run(spark, calendar, [ep("2024-01-13 10:00:00")], "2024-01-20").metric_1 == 0


def test_two_blocks(spark, calendar):
    days = ["2024-01-08", "2024-01-09", "2024-01-10", "2024-01-12", "2024-01-16", "2024-01-22"]
    m = run(spark, calendar, [ep(f"{d} 10:00:00", f"{d} 10:01:00") for d in days], "2024-01-31")
    assert (m.metric_5, m.metric_6, m.metric_7, m.metric_8) == ("Yes", 2, 2.5, 3)
    assert m.metric_4 == pytest.approx(14 / 5) and m.metric_3 == 9


def test_lookback_bounds(spark, calendar):
    rows = [ep("2024-01-30 10:00:00", "2024-01-30 10:01:00"), ep("2024-02-29 10:00:00", "2024-02-29 10:01:00"),
            ep("2024-03-01 10:00:00", "2024-03-01 10:01:00"), ep("2024-04-01 10:00:00", "2024-04-01 10:01:00")]
    # One month before March 31 is February 29: the start is inclusive, later days are not seen.
    m = run(spark, calendar, rows, "2024-03-31", months=1)
    assert (m.lookback_start, m.metric_1) == (date(2024, 2, 29), 2)
    assert run(spark, calendar, rows, "2024-03-31", months=None).metric_1 == 3


def test_episode_reaching_into_the_window_is_counted_once(spark, calendar):
    rows = [ep("2024-01-02 10:00:00", "2024-03-05 10:00:00"), ep("2024-03-04 10:00:00", "2024-03-06 10:00:00")]
    m = run(spark, calendar, rows, "2024-03-08", months=1)
    assert m.core_episode_count == 2
    assert m.metric_1 == len(calendar.filter("is_session and cal_date between '2024-02-08' and '2024-03-06'").collect())


def test_reason_filter(spark, calendar):
    rows = [ep("2024-01-08 10:00:00", "2024-01-08 10:01:00", "LUDP"), ep("2024-01-09 10:00:00", "2024-01-09 10:01:00", "T1"),
            ep("2024-01-10 10:00:00", "2024-01-10 10:01:00", None)]
    assert run(spark, calendar, rows, "2024-01-31").metric_1 == 1
    assert run(spark, calendar, rows, "2024-01-31", reasons=(" ludp ", "T1", "")).metric_1 == 2
    assert run(spark, calendar, rows, "2024-01-31", reasons=("ALL",)).metric_1 == 3


def test_ticker_is_normalized(spark, calendar):
    assert run(spark, calendar, [ep("2024-01-08 10:00:00", "2024-01-08 10:01:00")], "2024-01-09", ticker=" abc ").metric_1 == 1


def test_contract_violations(spark):
    bad = spark.createDataFrame(
        [(1, " ", date(2024, 1, 2), 3, ["A"]), (2, "A", date(2024, 1, 2), 0, ["A"]), (3, "A", date(2024, 1, 2), None, [" "]),
         (4, "A", None, None, ["A"]), (5, "a", date(2024, 1, 2), None, ["ALL"])], REQUEST)
    got = {r.request_id: r.violation for r in X.request_violations(bad).collect()}
    assert set(got) == {1, 2, 3, 4} and "lookback" in got[2] and "reason" in got[3]


def test_explicit_close_flag_wins(spark, calendar):
    rows = spark.createDataFrame([ep("2024-01-10 10:00:00", "2024-01-10 10:05:00")], EPISODE).withColumn(
        "halted_at_close", F.lit(True))
    assert D.halt_days(rows, calendar).first().halted_at_close is True


def test_weekday_table_has_its_own_rules(spark):
    rows = [ep("2024-01-12 15:30:00", "2024-01-16 10:00:00"), ep("2024-01-13 10:00:00"), ep("2024-01-17 16:00:00", "2024-01-17 16:00:00")]
    daily = {str(r.trading_date): (r.episode_count, r.halt_at_close) for r in
             D.ticker_halt_daily(spark.createDataFrame(rows, EPISODE)).collect()}
    # Monday the 15th is a holiday but a weekday; the open Saturday start keeps its day.
    assert daily == {"2024-01-12": (1, "YES"), "2024-01-13": (1, "YES"), "2024-01-15": (1, "YES"),
                     "2024-01-16": (1, "NO"), "2024-01-17": (1, "YES")}


def test_ticker_metrics(spark):
    rows = [ep("2024-01-08 10:00:00", "2024-01-08 10:10:00"), ep("2024-01-08 11:00:00", "2024-01-08 11:01:00"),
            ep("2024-01-09 15:00:00", "2024-01-09 16:00:00"), ep("2024-01-10 15:00:00"),
            # No weekday at all: ratios are 0, not missing.
            ep("2024-01-13 10:00:00", "2024-01-13 10:01:00", symbol="SAT")]
    eps = spark.createDataFrame(rows, EPISODE)
    days = spark.createDataFrame([(date(2024, 1, d),) for d in (8, 9, 10, 11)], "trading_date date")
    got = {r.symbol: r for r in D.ticker_halt_metrics(eps, D.ticker_halt_daily(eps), days).collect()}
    a = got["ABC"]
    assert (a.total_halt_episodes, a.halt_days, a.halt_days_at_close) == (4, 3, 2)
    assert (a.halt_at_close_pct, a.halts_per_halt_day, a.halts_per_market_day) == (66.6667, 1.3333, 1.0)
    assert (a.avg_duration_minutes, a.median_duration_minutes) == (23.667, 10.0)
    assert (got["SAT"].halt_days, got["SAT"].halt_at_close_pct, got["SAT"].halts_per_halt_day) == (0, 0.0, 0.0)


def test_even_median(spark):
    rows = [ep("2024-01-08 10:00:00", f"2024-01-08 10:0{m}:00") for m in (1, 1, 4, 8)]
    assert D.exact_medians(spark.createDataFrame(rows, EPISODE), ["symbol"], "duration_minutes").first().median == 2.5


def test_halts_of_any_year_and_across_a_calendars_bound(spark):
    """Counts by a sweep equal a list of days, whatever the years; a day that is not covered is an error."""
    at = lambda *x: datetime(*x)
    rows = [("A", "T1", at(1999, 12, 30, 10), at(2000, 1, 4, 17)), ("A", "M", at(1999, 12, 31, 9), at(1999, 12, 31, 12)), ("A", "T1", at(2040, 1, 5, 10), None),
            ("A", "T1", at(2000, 1, 1, 10), at(2000, 1, 2, 10)), ("B", None, at(2040, 1, 4, 10), at(2040, 1, 3, 10)), ("A", "M", at(2000, 1, 3, 9), at(2000, 1, 3, 16))]
    eps = spark.createDataFrame(rows, "symbol string, reason_code string, halt_start timestamp_ntz, halt_end timestamp_ntz")
    cal = CAL.calendar_for(spark, (eps, "halt_start"), (eps, "halt_end"))
    got = {(r.symbol, str(r.trading_date)): (r.episode_count, r.halted_at_close, r.first_seen_count) for r in halt_days(eps, cal).collect()}
    assert got == {
        ("A", "1999-12-30"): (1, True, 1), ("A", "1999-12-31"): (2, True, 1), ("A", "2000-01-03"): (2, True, 1), ("A", "2000-01-04"): (1, True, 0),
        ("A", "2040-01-05"): (1, True, 1), ("B", "2040-01-04"): (1, False, 1)}
    listed = episode_days(eps, cal).groupBy("symbol", "trading_date").agg(
        F.count("*").alias("n"), F.bool_or("halted_at_close").alias("c"), F.count_if("is_first_session").alias("f")).collect()
    assert {(r.symbol, str(r.trading_date)): (r.n, r.c, r.f) for r in listed} == got
    with pytest.raises(Exception, match="does not cover"):
        halt_days(eps, CAL.trading_calendar(spark, date(2000, 1, 1), date(2045, 12, 31))).collect()
