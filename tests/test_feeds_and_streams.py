import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from haltscope.operators.bars import aggregate_bars
from haltscope.operators.episodes import halt_episodes
from haltscope.schemas import FEED_FIELDS
from haltscope.sources import feeds, versions
from haltscope.streaming import bars as SB
from haltscope.streaming import halts as SH

ITEM = """<item><title>x</title><ndaq:IssueSymbol>{symbol}</ndaq:IssueSymbol><ndaq:IssueName> Name &amp; Co </ndaq:IssueName>
<ndaq:{tag}>{market}</ndaq:{tag}><ndaq:ReasonCode>{reason}</ndaq:ReasonCode><ndaq:PauseThresholdPrice></ndaq:PauseThresholdPrice>
<ndaq:HaltDate>01/05/2024</ndaq:HaltDate><ndaq:HaltTime>{start}</ndaq:HaltTime><ndaq:ResumptionDate>{day}</ndaq:ResumptionDate>
<ndaq:ResumptionQuoteTime>{quote}</ndaq:ResumptionQuoteTime><ndaq:ResumptionTradeTime>{trade}</ndaq:ResumptionTradeTime></item>"""


def feed(*items):
    full = [ITEM.format(**{"symbol": "A", "tag": "Mkt", "market": "Q", "reason": "T1", "start": "10:00:00.5", "day": "", "quote": "",
                           "trade": "", **i}) for i in items]
    return ('<?xml version="1.0"?><rss xmlns:ndaq="http://www.nasdaqtrader.com/"><channel>' + "".join(full) + "</channel></rss>")


def test_the_jvm_compiles_the_scan_of_a_feed(spark, tmp_path):
    (tmp_path / "tradehalts_2024-01-05.xml").write_text(feed({}))
    scan = feeds.scan_halt_feed(spark, str(tmp_path))
    plan = spark._jvm.PythonSQLUtils.explainString(scan._jdf.queryExecution(), "codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan)]
    assert sizes and max(sizes) < 8000  # the limit of HotSpot: longer methods stay interpreted


def test_items_that_share_a_record(spark):
    whole = "<ndaq:IssueSymbol>{}</ndaq:IssueSymbol>".format
    records = ["\n <item>" + whole("A"), "<rss><item>" + whole("B"), "<item >" + whole("C"), "<item>" + whole("D") + "<item>" + whole("E"),
               "<itemx>" + whole("F"), " </channel></rss>", ""]
    items = feeds.items_of(spark.createDataFrame([(r, "f") for r in records], "value string, _file string"))
    good = items.filter(F.col(feeds.CORRUPT).isNull())
    assert sorted(r["ndaq:IssueSymbol"] for r in good.collect()) == ["A", "B", "C", "E"]


def test_a_table_without_rows_needs_no_join(spark):
    empty = versions.no_rows(spark, "k long, v long")
    joined = spark.range(3).withColumnRenamed("id", "k").join(empty, "k", "full_outer")
    assert joined.count() == 3
    assert "Join" not in joined._jdf.queryExecution().optimizedPlan().toString()


def test_feed_fields(spark, tmp_path):
    (tmp_path / "tradehalts_2024-01-05.xml").write_text(feed(
        {"day": "01/05/2024", "quote": "10:04:00", "trade": "10:05:00"}, {"symbol": "B", "tag": "Market", "market": "NYSE",
         "day": "01/05/2024", "quote": "10:04:00"}, {"symbol": " "}))
    rows = {r.symbol: r for r in feeds.scan_halt_feed(spark, str(tmp_path)).collect()}
    assert set(rows) == {"A", "B"}
    a = rows["A"]
    assert (a.issue_name, a.market, a.reason_code, a.resumption_reason_code) == ("Name & Co", "Q", "T1", None)
    assert (a.halt_start, a.halt_end, a.pause_threshold_price) == (
        datetime(2024, 1, 5, 10, 0, 0, 500000), datetime(2024, 1, 5, 10, 5), None)
    assert (a.source_file, rows["B"].market, rows["B"].halt_end) == (
        "tradehalts_2024-01-05.xml", "NYSE", datetime(2024, 1, 5, 10, 4))


def test_resumption_files_never_enter_the_halt_path(spark, tmp_path):
    (tmp_path / "tradehalts_2024-01-05.xml").write_text(feed({}))
    (tmp_path / "resumptions_2024-01-05.xml").write_text(feed({"symbol": "R", "reason": "T3"}))
    row = feeds.scan_resumption_files(spark, str(tmp_path)).collect()
    assert [(r.symbol, r.reason_code, r.resumption_reason_code, r.source_type) for r in row] == [("R", None, "T3", "resumption")]
    assert {r.symbol for r in feeds.scan_halt_feed(spark, str(tmp_path), glob=feeds.HALT_GLOB).collect()} == {"A"}
    with pytest.raises(ValueError):
        feeds.scan_halt_feed(spark, str(tmp_path), feed="other")


def test_a_bad_file_is_skipped(spark, tmp_path):
    (tmp_path / "tradehalts_2024-01-05.xml").write_text(feed({}))
    (tmp_path / "tradehalts_2024-01-06.xml").write_text("<rss><channel><item><ndaq:IssueSymbol>Z")
    assert {r.symbol for r in feeds.scan_halt_feed(spark, str(tmp_path)).collect()} == {"A"}


def test_bad_items_cost_no_good_ones(spark, tmp_path):
    good = feed({"symbol": "A"}, {"symbol": "B"}, {"symbol": "C"}).split("<item>")
    bad = ["ndaq:IssueSymbol>X</item>", "<item><ndaq:IssueSymbol>Y", "<item><a><b></a></b></item>"]
    text = good[0] + "<item><" + bad[0] + "<item>" + good[1] + bad[1] + "<item>" + good[2] + bad[2] + "\n<item>" + good[3]
    (tmp_path / "tradehalts_2024-01-05.xml").write_text(text)
    (tmp_path / "tradehalts_2024-01-06.xml").write_text(feed({"symbol": "D"}) + "<item><ndaq:IssueSymbol>cut off")
    assert {r.symbol for r in feeds.scan_halt_feed(spark, str(tmp_path)).collect()} == {"A", "B", "C", "D"}
    rejects = feeds.bad_feed_items(spark, str(tmp_path)).collect()
    assert sorted((r.source_file[-6:-4], "X" in r.text, "Y" in r.text) for r in rejects) == [
        ("05", False, False), ("05", False, True), ("05", True, False), ("06", False, False)]
    with pytest.raises(Exception):
        feeds.scan_halt_feed(spark, str(tmp_path), tolerant=False).collect()
    assert feeds.scan_resumption_files(spark, str(tmp_path / "none")).collect() == []


def test_file_dates(spark):
    names = ["tradehalts_2024-01-05.xml", "tradehalts_2024-01-06.xml", "tradehalts_2024-02-01.xml", "other.xml", "tradehalts_2024-13-01.xml"]
    files = spark.createDataFrame([(n,) for n in names], "source_file string")
    assert feeds.within_file_dates(files, date(2024, 1, 5), date(2024, 1, 6)).count() == 1
    assert feeds.within_file_month(files, 2024, 1).count() == 2
    assert feeds.within_file_month(files, 2023, 12).count() == 0
    # The 6th is a Saturday.
    assert {str(r.trading_date) for r in feeds.market_days(files).collect()} == {"2024-01-05", "2024-02-01"}


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_polls_complete_a_halt_and_never_erase(spark, tmp_path):
    source, halts, episodes, cp = (str(tmp_path / n) for n in ("in", "halts", "episodes", "cp"))
    (tmp_path / "in").mkdir()

    def poll(name, *items):
        (tmp_path / "in" / name).write_text(feed(*items))
        run(SH.live_halt_ingest(SH.read_feed_stream(spark, source), halts, episodes, cp, ["source_file", "halt_end"]))

    poll("tradehalts_1.xml", {}, {"symbol": "B"})
    assert versions.read_current(spark, halts).filter("resumption_date is not null").count() == 0
    poll("tradehalts_2.xml", {"day": "01/05/2024", "trade": "10:05:00"})
    poll("tradehalts_3.xml", {})
    stored = {r.symbol: r for r in versions.read_current(spark, halts).collect()}
    assert set(stored) == {"A", "B"} and stored["A"].resumption_trade_time == "10:05:00"
    ended = {r.symbol: r for r in SH.read_open_halts(spark, episodes).collect()}
    assert (ended["A"].halt_end, ended["A"].halt_close_status) == (datetime(2024, 1, 5, 10, 5), "NO")
    assert ended["B"].halt_close_status == "UNKNOWN"


def test_late_resumption_enriches_but_never_creates(spark, tmp_path):
    halts, seen, cp, source = (str(tmp_path / n) for n in ("halts", "seen", "cp", "in"))
    schema = ("id long, symbol string, market string, halt_start timestamp_ntz, reason_code string, resumption_date date,"
              " resumption_quote_time string, resumption_trade_time string")
    start = datetime(2024, 1, 5, 10)
    stored = spark.createDataFrame([(1, "A", "Q", start, "T1", None, None, None)], schema)
    versions.write_batch(versions.with_day(stored), halts, 0)
    late = [(5, "A", "Q", start, None, date(2024, 1, 16), None, "09:30:00"), (6, "GHOST", "Q", start, None, date(2024, 1, 16), None, "09:30:00")]
    spark.createDataFrame(late, schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    run(SH.late_resumptions(stream, halts, 1, seen, cp, "id"))
    rows = versions.read_current(spark, halts).collect()
    assert [(r.symbol, r.resumption_date, r.reason_code) for r in rows] == [("A", date(2024, 1, 16), "T1")]


def test_open_halts_over_batches_in_any_order(spark, tmp_path):
    schema = ("k long, symbol string, market string, reason_code string, halt_start timestamp_ntz, halt_end timestamp_ntz,"
              " issue_name string, pause_threshold_price double")
    d = lambda h, m: datetime(2024, 1, 5, h, m)
    rest = (None, None)
    batches = [[(0, "A", "Q", "T1", d(10, 0), d(10, 5), *rest)], [(1, "A", "Q", "T1", d(9, 0), d(9, 10), *rest)],
               [(2, "A", "NASDAQ", "H11", d(10, 5), d(10, 30), *rest), (3, "B", None, "M", d(8, 0), None, *rest)],
               [(4, "A", "Q", "M", d(12, 0), None, *rest), (5, "A", "Q", "M", None, None, *rest)]]
    source, store, cp = (str(tmp_path / n) for n in ("in", "store", "cp"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        run(SH.stream_open_halts(spark.readStream.schema(schema).parquet(source), store, cp, ["k"]))
    got = {(r.symbol, r.market, r.halt_start, r.halt_end, tuple(r.reason_codes), r.is_open) for r in SH.read_open_halts(spark, store).collect()}
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    assert got == {(r.symbol, r.market, r.halt_start, r.halt_end, tuple(r.reason_codes), r.halt_end is None) for r in halt_episodes(whole, ["k"]).collect()}
    assert ("A", "NASDAQ", d(9, 0), d(9, 10), ("T1",), False) in got and len(got) == 4


def test_a_scan_parses_and_cleans_each_item_once(spark, tmp_path):
    (tmp_path / "tradehalts_1.xml").write_text(feed({"symbol": " A\u2003"}, {"symbol": "\u00a0"}, {"symbol": "B \t C", "start": "10: 00:01", "day": " 1/5/2024", "trade": "1 0:30:00"}))
    found = feeds.scan_halt_feed(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1 and plan.count("^\\s+|\\s+$") <= len(FEED_FIELDS) + 2  # the symbol again, for its filter
    rows = [(r.symbol, r.halt_start, r.resumption_date, r.resumption_trade_time, r.halt_end) for r in found.orderBy("symbol").collect()]
    assert rows == [("A", datetime(2024, 1, 5, 10, 0, 0, 500000), None, None, None),
                    ("B \t C", datetime(2024, 1, 5, 10, 0, 1), date(2024, 1, 5), "10:30:00", datetime(2024, 1, 5, 10, 30))]


def test_first_poll_without_a_usable_row(spark, tmp_path):
    source, halts, episodes, cp, rejects, loads = (str(tmp_path / n) for n in ("in", "halts", "episodes", "cp", "rejects", "loads"))
    (tmp_path / "in").mkdir()
    for name, item in (("tradehalts_1.xml", {"symbol": "X", "reason": None}), ("tradehalts_2.xml", {"symbol": "B"})):
        text = feed(item) if item.get("reason", 1) else feed({"symbol": "X"}).replace("ReasonCode", "Other")
        (tmp_path / "in" / name).write_text(text)
        run(SH.live_halt_ingest(SH.read_feed_stream(spark, source), halts, episodes, cp, ["source_file", "halt_end"], rejects, loads))
    assert [(r.action, r.row_count) for r in spark.read.parquet(f"{loads}/batch=*").collect()] == [("INSERTED", 1)]
    assert [r.symbol for r in versions.read_current(spark, halts).collect()] == ["B"]
    assert [(r.symbol, r.missing) for r in spark.read.parquet(rejects).collect()] == [("X", ["reason_code"])]


def test_polls_do_not_keep_the_partitions_of_the_stream(spark, tmp_path):
    schema = ("k long, symbol string, market string, reason_code string, halt_start timestamp_ntz, halt_end timestamp_ntz, issue_name string,"
              " pause_threshold_price double, resumption_date date, resumption_quote_time string, resumption_trade_time string, source_file string")
    source, halts, episodes, cp = (str(tmp_path / n) for n in ("in", "halts", "episodes", "cp"))
    rows = [(j, f"S{j % 20}", "Q", "T1", datetime(2024, 1, 5, 10, j // 20), None, None, None, None, None, None, "f") for j in range(40)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    done = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalTasks()
    before, usual = done(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        run(SH.live_halt_ingest(stream, halts, episodes, cp, ["k"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert done() - before < 500
    stored = SH.read_open_halts(spark, episodes).collect()
    assert len(stored) == 20 and {(r.halt_start, r.observation_count) for r in stored} == {(datetime(2024, 1, 5, 10), 2)}
    assert not list(tmp_path.glob("*/_steps/*"))


def test_an_earlier_resumption_takes_nothing_back(spark, tmp_path):
    halts, seen, cp, source = (str(tmp_path / n) for n in ("halts", "seen", "cp", "in"))
    schema = ("id long, symbol string, market string, halt_start timestamp_ntz, reason_code string, resumption_date date,"
              " resumption_quote_time string, resumption_trade_time string")
    start = datetime(2024, 1, 5, 10)
    versions.write_batch(versions.with_day(spark.createDataFrame([(1, "A", "Q", start, "T1", None, None, None)], schema)), halts, 0)
    for k, day in enumerate((10, 16, 12)):
        late = [(5 + k, "A", "Q", start, None, date(2024, 1, day), None, "09:30:00")]
        spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(source)
        run(SH.late_resumptions(spark.readStream.schema(schema).parquet(source), halts, 1, seen, cp, "id"))
    assert [r.resumption_date for r in versions.read_current(spark, halts).collect()] == [date(2024, 1, 16)]


def test_only_closed_buckets_are_appended(spark, tmp_path):
    schema = "ticker string, bar_start timestamp_ntz, open double, high double, low double, close double, volume long"
    rows = [("T", datetime(2024, 1, 5, 10, m), 1.0 + m, 2.0 + m, 0.5, 1.5 + m, 10) for m in (0, 1, 4, 5, 20)]
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.createDataFrame(rows, schema).write.parquet(source)
    stream = SB.stream_bars_tumbling(spark.readStream.schema(schema).parquet(source), 5, "10 minutes")
    run(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).outputMode("append"))
    got = {str(r.bucket_start.time()): (r.open, r.close, r.volume) for r in spark.read.parquet(out).collect()}
    # Newest bar 10:20, so the watermark stands at 10:10.
    assert got == {"10:00:00": (1.0, 5.5, 30), "10:05:00": (6.0, 6.5, 10)}


def test_late_bars_correct_their_closed_bucket(spark, tmp_path):
    schema = "ticker string, bar_start timestamp_ntz, open double, high double, low double, close double, volume long"
    dice = random.Random(5)
    rows = [(t, datetime(2024, 1, 5 + d, 23 * (d == 0), m), float(dice.randint(1, 9)), float(dice.randint(10, 12)), float(dice.randint(0, 1)),
             float(dice.randint(1, 9)), dice.randint(0, 50)) for t in ("A", "B", None) for d in (0, 1, 3) for m in range(60) if dice.random() < 0.7]
    dice.shuffle(rows)
    # A copy changes nothing; a later version of a minute replaces the one before; one bar has no time.
    extra = [rows[0], (*rows[1][:6], rows[1][6] + 100), ("A", None, 1.0, 1.0, 1.0, 1.0, 1)]
    source, root, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    size = len(rows) // 2 + 1
    for part in [rows[k:k + size] for k in range(0, len(rows), size)] + [extra]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    step = SB.corrected_buckets_batch(root, 5)

    def twice(batch, batch_id):
        step(batch, batch_id)
        if batch_id == 1:
            step(batch, batch_id)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    run(stream.writeStream.foreachBatch(twice).option("checkpointLocation", cp))
    final = [r for r in rows if r[:2] != rows[1][:2]] + [extra[1]]
    newest = max(r[1] for r in final)
    plain = aggregate_bars(spark.createDataFrame(final, schema), 5)
    key = ["ticker", "bucket_start", "bucket_end", "open", "high", "low", "close", "volume"]
    want = sorted(map(repr, (tuple(r) for r in plain.filter(F.col("bucket_end") <= newest - timedelta(minutes=10)).select(*key).collect())))
    changes = SB.read_bar_changes(spark, root)
    assert sorted(map(repr, (tuple(r) for r in SB.closed_buckets(changes).select(*key).collect()))) == want
    # Adding up inserts and retractions gives the same rows, each once.
    net = changes.groupBy(*key).agg(F.sum("op").alias("n")).filter("n <> 0").collect()
    assert {r.n for r in net} == {1} and sorted(repr(tuple(r)[:-1]) for r in net) == want
    assert changes.filter("op = -1").count() > 0
    aside = SB.read_bars_aside(spark, root)
    assert aside.filter("why = 'no time'").count() == 1 and aside.filter("why = 'late'").count() > 0
    assert sorted(SB._stored_days(spark, root, 99)) == [date(2024, 1, 5), date(2024, 1, 6), date(2024, 1, 8)]
