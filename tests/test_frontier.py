"""Stored episodes merged batch by batch, and the versions they are kept in."""

import os
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from haltscope.operators.episodes import dedup_observations, halt_episodes
from haltscope.sources import versions
from haltscope.streaming.frontier import episode_store_batch, read_episodes
from haltscope.streaming.halts import late_resumption_batch, settled_batch

SCHEMA = ("k long, symbol string, market string, reason_code string, halt_start timestamp_ntz, halt_end timestamp_ntz, issue_name string,"
          " pause_threshold_price double, resumption_date date, resumption_trade_time string")


def observation(k, symbol, market, reason, start, end, name=None):
    return (k, symbol, market, reason, start, end, name, None, end.date() if end else None, end.strftime("%H:%M:%S") if end else None)


def content(rows):
    return sorted(((r.symbol, r.market or "", r.halt_start, r.halt_end, tuple(r.reason_codes), r.reason_code, r.issue_name,
                    r.duration_minutes, r.halt_close_status, r.observation_count, r.invalid_end_count) for r in rows), key=str)


def expected(spark, rows):
    return content(halt_episodes(dedup_observations(spark.createDataFrame(rows, SCHEMA), ["k"]), ["k"]).collect())


def random_rows(seed, n):
    draw = random.Random(seed)
    rows, base = [], datetime(2024, 1, 5)
    for k in range(n):
        start = base + timedelta(minutes=draw.randrange(0, 4 * 24 * 60, 15))
        length = draw.choice([None, None, 0, 10, 30, 200, 2000, -20])
        end = start + timedelta(minutes=length) if length is not None else None
        rows.append(observation(k, draw.choice("AB"), draw.choice(["Q", "NASDAQ", None, "N"]), draw.choice(["T1", "M", None]), start, end, draw.choice([None, "x", "y"])))
    # Copies, some of them under another market.
    rows += [(1000 + r[0], *r[1:2], draw.choice(["Q", "N"]), *r[3:]) for r in draw.sample(rows, n // 4)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1])
def test_any_split_gives_the_episodes_of_one_batch(spark, tmp_path, seed):
    rows = random_rows(seed, 50)
    root = str(tmp_path / "store")
    run = episode_store_batch(root, ["k"])
    cut = sorted(random.Random(seed).sample(range(len(rows)), 2))
    parts = [rows[a:b] for a, b in zip([0, *cut], [*cut, len(rows)])]
    for batch_id, part in enumerate(parts):
        for _ in range(2 if batch_id == 1 else 1):  # one batch is run again
            run(spark.createDataFrame(part, SCHEMA), batch_id)
    assert content(read_episodes(spark, root).collect()) == expected(spark, rows)


def test_an_open_halt_ends_in_a_later_poll(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 5, h, m)
    polls = [[observation(0, "B", None, "T1", at(10, 0), None)], [observation(1, "B", None, "T1", at(10, 5), at(10, 30))], [observation(1, "B", None, "T1", at(10, 5), at(10, 30))]]
    root = str(tmp_path / "store")
    for k, rows in enumerate(polls):
        episode_store_batch(root, ["k"])(spark.createDataFrame(rows, SCHEMA), k)
    assert [(r.symbol, r.market, r.halt_start, r.halt_end, r.is_open) for r in read_episodes(spark, root).collect()] == [("B", None, at(10, 0), at(10, 30), False)]


def test_a_late_row_splits_an_episode(spark, tmp_path):
    at = lambda h, m: datetime(2024, 1, 5, h, m)
    polls = [[observation(0, "A", "Q", "T1", at(9, 0), None), observation(1, "A", "Q", "M", at(12, 0), at(12, 30))],
             [observation(2, "A", "Q", "T1", at(15, 0), at(15, 5))], [observation(3, "A", "Q", "H11", at(10, 0), at(10, 30))], []]
    root = str(tmp_path / "store")
    for k, rows in enumerate(polls):
        episode_store_batch(root, ["k"])(spark.createDataFrame(rows, SCHEMA), k)
    got = sorted((r.halt_start, r.halt_end) for r in read_episodes(spark, root).collect())
    assert got == [(at(9, 0), at(10, 30)), (at(12, 0), at(12, 30)), (at(15, 0), at(15, 5))]


def test_a_batch_opens_its_days_only_and_folders_stay_bounded(spark, tmp_path):
    root = str(tmp_path / "t")
    days = [date(2024, 1, k) for k in range(1, 6)]
    for batch in range(12):
        rows = spark.createDataFrame([(batch, days[batch % 5])], "v int, halt_day date")
        versions.write_batch(rows, root, batch)
        if batch % 4 == 3:
            versions.write_batch(rows, root, batch)  # run again
    assert versions.current_days(spark, root) == {d: max(b for b in range(12) if b % 5 == k) for k, d in enumerate(days)}
    some = versions.read_current(spark, root, days=days[1:2])
    assert [r.v for r in some.collect()] == [11] and len(some.inputFiles()) == 1
    folders = [f for _, found, _ in os.walk(root) for f in found if f.startswith("batch=")]
    assert len(folders) <= 2 * len(days)
    assert sorted(r.v for r in versions.read_current(spark, root, before_batch=11).collect()) == [6, 7, 8, 9, 10]
    assert len(os.listdir(f"{root}/_log")) <= 4  # two logs and their checksums


def test_emptied_days_and_no_day(spark, tmp_path):
    root = str(tmp_path / "t")
    d = date(2024, 1, 1)
    schema = "v int, halt_day date"
    versions.write_batch(spark.createDataFrame([(1, d), (2, None)], schema), root, 0)
    assert sorted((r.v, r.halt_day) for r in versions.read_current(spark, root).collect()) == [(1, d), (2, None)]
    versions.write_batch(spark.createDataFrame([], schema), root, 1, [d])
    assert [(r.v, r.halt_day) for r in versions.read_current(spark, root).collect()] == [(2, None)]
    assert versions.read_current(spark, str(tmp_path / "none"), schema=spark.createDataFrame([], schema).schema).collect() == []


def test_late_resumptions_reach_episodes(spark, tmp_path):
    halts, seen, episodes, links = (str(tmp_path / n) for n in ("halts", "seen", "episodes", "links"))
    block = "resumption_date date, resumption_quote_time string, resumption_trade_time string"
    start, other = datetime(2024, 1, 5, 10), datetime(2024, 1, 8, 11)
    raw = [(1, "A", "Q", start, "T1", None, None, None), (2, "A", "Q", other, "T1", None, None, None)]
    versions.write_batch(versions.with_day(spark.createDataFrame(raw, f"id long, symbol string, market string, halt_start timestamp_ntz, reason_code string, {block}")), halts, 0)
    core = [(7, start, None, None, "UNKNOWN"), (8, datetime(2024, 1, 9, 9), None, None, "UNKNOWN")]
    versions.write_batch(versions.with_day(spark.createDataFrame(core, "episode_id long, halt_start timestamp_ntz, halt_end timestamp_ntz, duration_minutes double, halt_close_status string")), episodes, 0)
    pairs = [(7, 1, date(2024, 1, 5), date(2024, 1, 5)), (7, 2, date(2024, 1, 5), date(2024, 1, 8))]
    spark.createDataFrame(pairs, "episode_id long, trade_halt_id long, episode_day date, halt_day date").write.parquet(links)
    run = late_resumption_batch(halts, 1, seen, "id", links, episodes)
    schema = f"id long, symbol string, market string, halt_start timestamp_ntz, reason_code string, resumption_reason_code string, {block}"
    sent = [(start, date(2024, 1, 5), "10:05:00"), (other, date(2024, 1, 8), "11:30:00"), (start, date(2024, 1, 5), "10:02:00")]
    ends = []
    for k, (at, day, clock) in enumerate(sent):
        batch = spark.createDataFrame([(50 + k, "A", "Q", at, "T1", "T3", day, None, clock)] * 2, schema)
        for _ in range(2):  # each batch is run again
            run(batch, k)
        ends.append({r.episode_id: (r.halt_end, r.halt_close_status) for r in versions.read_current(spark, episodes).collect()})
    assert ends[0] == {7: (datetime(2024, 1, 5, 10, 5), "UNKNOWN"), 8: (None, "UNKNOWN")}
    assert ends[1] == ends[2] == {7: (datetime(2024, 1, 8, 11, 30), "MULTI_DAY"), 8: (None, "UNKNOWN")}
    assert versions.read_current(spark, seen).count() == 3 and settled_batch(spark, halts, seen, episodes) == 3
    assert {r.id: r.resumption_trade_time for r in versions.read_current(spark, halts).collect()} == {1: "10:05:00", 2: "11:30:00"}
    assert versions.read_current(spark, halts).filter(F.col("halt_day") != F.to_date("halt_start")).count() == 0
