"""Episodes against a plain state machine, on chunked plans."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from haltscope.operators import episodes as E
from haltscope.operators import quality as Q
from haltscope.plans.derive import Inputs

SCHEMA = (
    "obs_id long, symbol string, issue_name string, market string, reason_code string, halt_start timestamp_ntz,"
    " halt_end timestamp_ntz, resumption_date date, resumption_trade_time string, pause_threshold_price double"
)
VENUES = {"Q": "NASDAQ", "N": "NYSE", "A": "AMEX"}


def obs(spark, rows):
    """rows: (symbol, market, reason, start, end[, name[, price]])"""
    full = []
    for k, r in enumerate(rows):
        symbol, market, reason, start, end, *rest = r
        name = rest[0] if rest else None
        price = rest[1] if len(rest) > 1 else None
        full.append((k, symbol, name, market, reason, start, end, end.date() if end else None,
                     end.strftime("%H:%M:%S.%f") if end else None, price))
    return spark.createDataFrame(full, SCHEMA)


def at(text):
    return datetime.fromisoformat(text)


def walk(rows):
    """One pass in order, the way a person would do it on paper."""
    groups = {}
    for k, r in enumerate(rows):
        symbol, market, reason, start, end = r[:5]
        if start is None:
            continue
        venue = VENUES.get((market or "").upper(), market)
        good = end if end is not None and end >= start else None
        groups.setdefault((symbol, venue), []).append((start, good or start, k, good, reason))
    out = set()
    for (symbol, venue), events in groups.items():
        opened = None
        for start, _, _, end, reason in sorted(events):
            if opened and (opened[1] is None or start <= opened[1]):
                if end and (opened[1] is None or end > opened[1]):
                    opened[1] = end
                opened[2].add(reason)
            else:
                if opened:
                    out.add((symbol, venue, opened[0], opened[1], tuple(sorted(c for c in opened[2] if c))))
                opened = [start, end, {reason}]
        out.add((symbol, venue, opened[0], opened[1], tuple(sorted(c for c in opened[2] if c))))
    return out


def found(df):
    return {(r.symbol, r.market, r.halt_start, r.halt_end, tuple(r.reason_codes)) for r in df.collect()}


def random_rows(seed, n, symbols, minutes):
    rng = random.Random(seed)
    base = datetime(2024, 1, 2)
    rows = []
    for _ in range(n):
        start = base + timedelta(minutes=rng.randrange(minutes))
        kind = rng.random()
        if kind < 0.35:
            end = None
        elif kind < 0.45:
            end = start - timedelta(minutes=5)
        else:
            end = start + timedelta(minutes=rng.choice([0, 1, 7, 60, 900, 4000]))
        rows.append((f"S{rng.randrange(symbols)}", rng.choice(["Q", "NASDAQ", "N", "P", None]),
                     rng.choice(["LUDP", "T1", None]), start, end))
    return rows


@pytest.mark.parametrize("unit", ["day", "hour"])
@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_a_state_machine(spark, unit, seed):
    rows = random_rows(seed, 1500, 12, 20000)
    # One symbol holds a third of all rows.
    rows += [("HOT", "Q", r[2], r[3], r[4]) for r in random_rows(seed + 10, 750, 1, 30000)]
    assert found(E.halt_episodes(obs(spark, rows), ["obs_id"], chunk_unit=unit)) == walk(rows)


@pytest.mark.parametrize("unit", ["day", "hour"])
def test_membership_agrees_with_episodes(spark, unit):
    rows = random_rows(5, 800, 6, 15000)
    table = obs(spark, rows)
    members = E.episode_membership(table, chunk_unit=unit)
    assert members.count() == len(rows)
    starts = {(r.symbol, r.episode_market, r.episode_start) for r in members.collect()}
    assert starts == {(r[0], r[1], r[2]) for r in walk(rows)}
    sizes = E.halt_episodes(table, ["obs_id"]).agg(F.sum("observation_count")).first()[0]
    assert sizes == len(rows)


def test_later_end_of_the_same_start_wins(spark):
    rows = [("T", "NASDAQ", "LUDP", at("2020-03-12 11:18:33"), at("2020-03-12 11:23:33")),
            ("T", "NASDAQ", "LUDP", at("2020-03-12 11:18:33"), at("2020-03-16 09:45:02"))]
    row = E.halt_episodes(obs(spark, rows), ["obs_id"]).first()
    assert (row.halt_end, row.halt_close_status, row.reason_code) == (at("2020-03-16 09:45:02"), "MULTI_DAY", "LUDP")


def test_open_rows_are_closed_by_the_last(spark):
    rows = [("A", "Q", "T1", at("2024-01-02 12:45:56"), None),
            ("A", "Q", "T1", at("2024-01-02 12:50:00"), None),
            ("A", "Q", "T1", at("2024-01-02 13:23:12"), at("2024-01-02 13:30:00"))]
    row = E.halt_episodes(obs(spark, rows), ["obs_id"]).collect()
    assert len(row) == 1 and row[0].halt_end == at("2024-01-02 13:30:00")


def test_touching_merges_and_a_gap_splits(spark):
    rows = [("A", "Q", "T1", at("2024-01-02 10:00:00"), at("2024-01-02 10:30:00")),
            ("A", "Q", "T1", at("2024-01-02 10:30:00"), at("2024-01-02 10:40:00")),
            ("A", "Q", "T1", at("2024-01-02 10:40:01"), at("2024-01-02 10:50:00"))]
    assert E.halt_episodes(obs(spark, rows), ["obs_id"]).count() == 2


def test_two_reasons_leave_the_single_reason_empty(spark):
    rows = [("A", "Q", "T1", at("2024-01-02 10:00:00"), None, None, 5.0),
            ("A", "NASDAQ", "H11", at("2024-01-02 11:00:00"), at("2024-01-02 11:30:00"), "Name", 6.0)]
    row = E.halt_episodes(obs(spark, rows), ["obs_id"]).first()
    assert row.reason_code is None and row.reason_codes == ["H11", "T1"]
    assert (row.issue_name, row.pause_threshold_price, row.market) == ("Name", 5.0, "NASDAQ")


def test_end_before_start_never_closes_and_is_counted(spark):
    rows = [("A", "Q", "T1", at("2024-01-02 10:00:00"), at("2024-01-02 09:00:00"))]
    stats = E.episode_stats(E.halt_episodes(obs(spark, rows), ["obs_id"])).first()
    assert (stats.episode_count, stats.duration_count, stats.close_unknown, stats.invalid_end_count) == (1, 0, 1, 1)


@pytest.mark.parametrize("start,end,status", [
    ("2024-01-02 15:00:00", "2024-01-02 16:00:00", "YES"),
    ("2024-01-02 16:00:00", "2024-01-02 16:30:00", "YES"),
    ("2024-01-02 15:00:00", "2024-01-02 15:59:59", "NO"),
    ("2024-01-02 16:00:01", "2024-01-02 17:00:00", "NO"),
    ("2024-01-02 15:00:00", "2024-01-03 09:30:00", "MULTI_DAY"),
])
def test_close_status(spark, start, end, status):
    row = E.halt_episodes(obs(spark, [("A", "Q", "T1", at(start), at(end))]), ["obs_id"]).first()
    assert row.halt_close_status == status


def test_dedup_keeps_the_last_seen_and_treats_nulls_as_equal(spark):
    start = at("2024-01-02 10:00:00")
    rows = [("A", "Q", None, start, None, "first"), ("A", "Q", None, start, None, "last"),
            ("A", "Q", "T1", start, None, "other")]
    kept = {r.issue_name for r in E.dedup_observations(obs(spark, rows), ["obs_id"]).collect()}
    assert kept == {"last", "other"}


def test_episode_ids_are_dense_and_ordered(spark):
    rows = random_rows(9, 400, 5, 9000)
    numbered = E.with_episode_ids(E.halt_episodes(obs(spark, rows), ["obs_id"])).orderBy("episode_id").collect()
    assert [r.episode_id for r in numbered] == [f"H{k:08d}" for k in range(1, len(numbered) + 1)]
    assert [r.halt_start for r in numbered] == sorted(r.halt_start for r in numbered)


def test_group_classes(spark):
    rows = [("A", "Q", "T1", at("2024-01-02 10:00:00"), None), ("A", "NASDAQ", "T1", at("2024-01-02 10:05:00"), None),
            ("B", "Q", "T1", at("2024-01-02 10:00:00"), None), ("B", "Q", "H11", at("2024-01-02 10:05:00"), None),
            ("C", "N", "T1", at("2024-01-02 10:00:00"), None)]
    groups = Q.group_diagnostics(E.episode_membership(obs(spark, rows)))
    assert {r.symbol: r.classification for r in groups.collect()} == {
        "A": "MARKET_ALIAS_COLLAPSE", "B": "SAME_MARKET_DIFFERENT_REASON", "C": "ONE_TO_ONE"}


def test_episodes_ids_and_links_come_from_one_membership(spark):
    i = Inputs(spark, "/root/testdata/sf0.001")
    links = i.links.groupBy("episode_id").agg(F.min("trade_halt_id").alias("low"), F.count("*").alias("n")).collect()
    assert set(i._saved) == {"unique_obs", "members", "id_episodes", "id_links"}  # each made once
    episodes = {r.episode_id: r.observation_count for r in i.core_episodes.collect()}
    assert episodes == {r.episode_id: r.n for r in links} and all(r.low == r.episode_id for r in links)
