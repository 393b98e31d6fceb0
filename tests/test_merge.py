from datetime import date, datetime

import pytest

from haltscope.operators import canonical as K
from haltscope.operators import merge as M
from haltscope.operators import quality as Q
from haltscope.operators.scaling import best_row, spread_join
from pyspark.sql import functions as F

OBS = ("obs_id long, symbol string, market string, halt_start timestamp_ntz, reason_code string, issue_name string,"
       " halt_end timestamp_ntz, resumption_date date, resumption_quote_time string, resumption_trade_time string,"
       " pause_threshold_price double, source_file string")
START = datetime(2024, 1, 5, 10, 0)
DAY = date(2024, 1, 5)


def obs(spark, *rows):
    full = []
    for k, r in enumerate(rows):
        end = r.get("end")
        full.append((k, "A", "Q", START, r.get("reason", "T1"), r.get("name"), end, r.get("date", end.date() if end else None),
                     r.get("quote"), r.get("trade", end.strftime("%H:%M:%S") if end else None), r.get("price"), r.get("file", f"f{k}")))
    return spark.createDataFrame(full, OBS)


def canon(spark, *rows):
    return K.canonical_halts(obs(spark, *rows), ["obs_id"])


def test_best_block_is_taken_whole(spark):
    row = canon(spark, {"end": datetime(2024, 1, 5, 10, 5), "quote": "10:04:00", "name": "X"},
                {"end": datetime(2024, 1, 5, 10, 30)}, {"date": DAY}, {"price": 2.0}).first()
    assert (row.resumption_trade_time, row.resumption_quote_time) == ("10:30:00", None)
    assert (row.issue_name, row.pause_threshold_price, row.source_file, row.clear_resumption) == ("X", 2.0, "f0", False)


def test_only_invalid_ends_clear(spark):
    bad = {"end": datetime(2024, 1, 5, 9, 0)}
    assert canon(spark, bad, {}).first().clear_resumption is True
    assert canon(spark, bad, {"date": DAY}).first().clear_resumption is False
    assert canon(spark, bad).first().resumption_date is None


def action(existing, incoming):
    return {r.reason_code: r for r in M.merge_halts(existing, incoming).collect()}


def test_insert_update_unchanged_and_null_never_erases(spark):
    first = canon(spark, {"name": "X", "price": 1.0, "file": "old"})
    merged = action(first.filter("false"), first)["T1"]
    assert merged.action == "INSERTED"
    assert action(first, first)["T1"].action == "UNCHANGED"
    closed = canon(spark, {"end": datetime(2024, 1, 5, 10, 5), "file": "new"})
    row = action(first, closed)["T1"]
    assert (row.action, row.issue_name, row.resumption_trade_time, row.source_file) == ("UPDATED", "X", "10:05:00", "old")
    assert action(closed, first.withColumn("issue_name", F.lit(None).cast("string")).withColumn(
        "pause_threshold_price", F.lit(None).cast("double")))["T1"].action == "UNCHANGED"
    wrong = canon(spark, {"end": datetime(2024, 1, 5, 9, 0)})
    cleared = action(closed, wrong)["T1"]
    assert (cleared.action, cleared.resumption_date, cleared.resumption_trade_time) == ("UPDATED", None, None)


def test_null_reason_is_a_key_value(spark):
    rows = canon(spark, {"reason": None})
    assert [r.action for r in M.merge_halts(rows, rows).collect()] == ["UNCHANGED"]


def test_rerun_adds_nothing(spark):
    schema = "ticker string, market string, bar_start timestamp_ntz, source string, volume long"
    rows = [("A", None, START, "s", 1), ("A", None, START, "s", 2), ("A", "Q", START, "s", 3)]
    incoming = spark.createDataFrame(rows, schema)
    fresh = M.new_raw_bars(incoming.filter("false"), incoming)
    assert fresh.count() == 2
    assert M.new_raw_bars(fresh, incoming).count() == 0
    outcome = {r.market: r.action for r in M.insert_outcome(fresh.filter("market is null"), incoming, M.RAW_BAR_KEY).collect()}
    assert outcome == {None: "SKIPPED", "Q": "INSERTED"}


EPISODE = ("symbol string, market string, halt_start timestamp_ntz, issue_name string, reason_code string, halt_end timestamp_ntz,"
           " duration_minutes double, halt_close_status string")


def test_episode_merge(spark):
    old = spark.createDataFrame([("A", "Q", START, "X", "T1", None, None, "YES"), ("B", None, START, None, None, None, None, "NO")], EPISODE)
    new = spark.createDataFrame([("A", "Q", START, None, None, datetime(2024, 1, 5, 10, 5), 5.0, "UNKNOWN"),
                                 ("B", None, START, None, None, None, None, "NO")], EPISODE)
    rows = M.merge_episodes(old, new).collect()
    a = [r for r in rows if r.symbol == "A"]
    assert len(a) == 1 and (a[0].action, a[0].issue_name, a[0].halt_close_status) == ("UPDATED", "X", "YES")
    # A missing venue never equals a stored one: the row is stored and inserted again.
    assert sorted(r.action for r in rows if r.symbol == "B") == ["INSERTED", "STORED"]


RES = ("id long, symbol string, market string, halt_start timestamp_ntz, reason_code string, resumption_reason_code string,"
       " resumption_date date, resumption_quote_time string, resumption_trade_time string, source_file string, source_type string")


def res(spark, *rows):
    return spark.createDataFrame([(k, "A", "Q", START, r.get("reason"), r.get("why"), r.get("date", DAY), r.get("quote"), r.get("trade"),
                                   "f", r.get("kind", "resumption")) for k, r in enumerate(rows)], RES)


def test_latest_valid_resumption_enriches_without_touching_the_reason(spark):
    halts = canon(spark, {}).withColumn("id", F.lit(7))
    found = res(spark, {"trade": "10:05:00", "why": "T3"}, {"quote": "10:30:00", "why": "T3"}, {"trade": "09:00:00", "why": "T3"})
    row = M.enrich_halts(halts, found, "id").first()
    assert (row.resumption_quote_time, row.resumption_trade_time, row.reason_code, row.raw_updated) == ("10:30:00", None, "T1", True)


def test_episode_follows_its_raw_rows(spark):
    episodes = spark.createDataFrame([(1, START, None, None, "UNKNOWN"), (2, START, datetime(2024, 1, 5, 12), 120.0, "NO")],
                                     "episode_id long, halt_start timestamp_ntz, halt_end timestamp_ntz, duration_minutes double, halt_close_status string")
    links = spark.createDataFrame([(1, 11), (1, 12), (2, 13)], "episode_id long, trade_halt_id long")
    halts = spark.createDataFrame([(11, DAY, None, "10:05:00"), (12, date(2024, 1, 8), "09:30:00", None), (13, DAY, None, "11:00:00")],
                                  "id long, resumption_date date, resumption_quote_time string, resumption_trade_time string")
    got = {r.episode_id: r for r in M.enrich_episodes(episodes, links, halts).collect()}
    assert (got[1].halt_end, got[1].halt_close_status, got[1].core_updated) == (datetime(2024, 1, 8, 9, 30), "MULTI_DAY", True)
    assert (got[2].halt_end, got[2].core_updated) == (datetime(2024, 1, 5, 12), False)


def test_resumption_contract(spark):
    rows = res(spark, {"why": "T3"}, {}, {"why": "T3", "kind": "halt"}, {"reason": "T1", "date": None})
    plain = {r.id: r.violation for r in M.resumption_violations(rows).collect()}
    assert plain == {1: "no reason context"}
    strict = {r.id: r.violation for r in M.resumption_violations(rows, resumption_feed=True).collect()}
    assert set(strict) == {1, 2, 3}
    # Rows 0 and 2 share all key parts; row 3 has no resumption date.
    assert M.new_resumptions(rows.filter("false"), rows).count() == 2


def test_links(spark):
    schema = "episode_id long, trade_halt_id long"
    have = spark.createDataFrame([(1, 1), (1, 2), (9, 9)], schema)
    want = spark.createDataFrame([(1, 1), (1, 3)], schema)
    got = {(r.episode_id, r.trade_halt_id): r.action for r in M.sync_links(have, want, want).collect()}
    assert got == {(1, 1): "KEPT", (1, 2): "DELETED", (1, 3): "INSERTED", (9, 9): "KEPT"}


def test_repointing_keeps_the_best_row(spark):
    rows = canon(spark, {}).select(*K.HALT_KEY)
    halts = rows.crossJoin(spark.createDataFrame(
        [(5, None, None), (6, DAY, "10:00:00"), (7, DAY, "11:00:00")], "id long, resumption_date date, resumption_trade_time string")).withColumn(
        "resumption_quote_time", F.lit(None).cast("string"))
    id_map = K.keep_id_map(halts, "id")
    assert {(r.duplicate_id, r.keep_id) for r in id_map.collect()} == {(5, 6), (7, 6)}
    links = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "episode_id long, trade_halt_id long")
    assert {tuple(r) for r in K.repoint_links(links, id_map).collect()} == {(1, 6), (2, 6)}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_a_join(spark, how):
    left = spark.range(300).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k long, v string")
    got = sorted(map(tuple, spread_join(left, right, ["k"], ["id"], 5, how).collect()), key=str)
    assert got == sorted(map(tuple, left.join(right, "k", how).collect()), key=str)


def test_best_row_keeps_column_order_and_nulls(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, "b", 2), ("k", None, 1)], "key string, v string, n long")
    assert sorted(map(tuple, best_row(df, ["key"], F.col("n")).collect()), key=str) == sorted([(None, "b", 2), ("k", None, 1)], key=str)


def test_domain_rules(spark):
    rows = spark.createDataFrame([(1, START, datetime(2024, 1, 5, 9), -1.0, "MAYBE"), (2, START, None, None, None)],
                                 "id long, halt_start timestamp_ntz, halt_end timestamp_ntz, duration_minutes double, halt_close_status string")
    assert {(r.id, r.violation) for r in Q.episode_domain_violations(rows).collect()} == {
        (1, "end_before_start"), (1, "negative_duration"), (1, "unknown_status")}


def test_outcomes_are_counted_by_the_write(spark, tmp_path):
    schema = "symbol string, market string, halt_start timestamp_ntz, reason_code string, n long, action string"
    rows = [("A", "Q", None, "T1", k, a) for k, a in enumerate(["INSERTED"] * 3 + ["STORED"])]
    for k, some in enumerate((rows, [])):
        merged = spark.createDataFrame(some, schema).repartition(3, "n")
        counts = M.write_counted(merged, lambda out, k=k: out.drop("action").write.parquet(str(tmp_path / f"t{k}")))
        assert {r.action: r.row_count for r in counts.collect()} == ({"INSERTED": 3, "STORED": 1} if some else {})
        assert spark.read.schema("symbol string, n long").parquet(str(tmp_path / f"t{k}")).count() == len(some)
    with pytest.raises(ValueError):
        M.write_counted(spark.createDataFrame([("A", "Q", None, "T1", 1, "LOST")], schema), lambda out: out.write.format("noop").mode("append").save())


def test_new_rows_take_one_shuffle_each(spark):
    """Incoming rows are sent once and stored rows with their key alone; NULL keys are equal, and so are NULL contents."""
    kinds = "a string, b int, v string"
    stored = spark.createDataFrame([("x", None, "old"), ("y", 1, None)], kinds)
    incoming = spark.createDataFrame([("x", None, "new"), ("y", 2, "q"), ("y", 2, "p"), (None, None, None), (None, None, None)], kinds)
    got = M.new_rows(stored, incoming, ["a", "b"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect()), key=str) == [("y", 2, "p"), (None, None, None)]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted(M.new_rows(stored, incoming.select("a", "b"), ["a", "b"]).collect(), key=str) == [("y", 2), (None, None)]
