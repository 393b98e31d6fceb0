"""Feed files and streams: data is written from the tables, then scanned or streamed back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from haltscope.operators import merge as M
from haltscope.operators.canonical import HALT_KEY, RESUMPTION_BLOCK
from haltscope.plans.derive import Inputs, s, text
from haltscope.plans.registry import query, r6
from haltscope.session import work_dir
from haltscope.sources import feeds, versions
from haltscope.streaming import bars as SB
from haltscope.streaming import halts as SH


def _items(i: Inputs, rows: DataFrame | None = None) -> DataFrame:
    """Observations in feed form: text fields under their feed names."""
    c = F.col
    obs = i.halt_obs if rows is None else rows
    day = lambda d: F.date_format(d, "MM/dd/yyyy")
    alias = c("market").isin("NASDAQ", "AMEX")
    return obs.select(
        c("symbol").alias("ndaq:IssueSymbol"),
        c("issue_name").alias("ndaq:IssueName"),
        F.when(~alias, c("market")).alias("ndaq:Mkt"),
        F.when(alias, c("market")).alias("ndaq:Market"),
        c("reason_code").alias("ndaq:ReasonCode"),
        c("pause_threshold_price").cast("decimal(18,2)").cast("string").alias("ndaq:PauseThresholdPrice"),
        day("halt_start").alias("ndaq:HaltDate"),
        F.date_format("halt_start", "HH:mm:ss.SSSSSS").alias("ndaq:HaltTime"),
        day("resumption_date").alias("ndaq:ResumptionDate"),
        c("resumption_quote_time").alias("ndaq:ResumptionQuoteTime"),
        c("resumption_trade_time").alias("ndaq:ResumptionTradeTime"),
    )


def _as_document(batches):
    """Wrap the items of one output file in a root element."""
    yield pa.RecordBatch.from_pydict({"value": ['<rss xmlns:ndaq="http://www.nasdaqtrader.com/"><channel>']})
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])
    yield pa.RecordBatch.from_pydict({"value": ["</channel></rss>"]})


def _write_feed(items: DataFrame, folder: str, before: Column | None = None) -> None:
    """One ``<item>`` per line, behind the text ``before``; missing fields are left out."""
    fields = [
        F.concat(F.lit(f"<{name}>"), F.col(f"`{name}`"), F.lit(f"</{name}>")) for name in items.columns
    ]
    line = F.concat(F.lit("<item>"), F.concat_ws("", *fields), F.lit("</item>"))
    line = line if before is None else F.concat(before, line)
    items.select(line.alias("value")).mapInArrow(_as_document, "value string").write.mode("append").text(folder)


def _feed(i: Inputs, label: str, rows: DataFrame | None = None) -> str:
    folder = work_dir(i.spark, label)
    _write_feed(_items(i, rows), folder)
    return folder


OBS_COLS = ["symbol", "issue_name", "market", "reason_code", "halt_start", "halt_end", "resumption_date",
            "resumption_quote_time", "resumption_trade_time"]
# The feed carries an end only through its date and times.
_FEED_OBS = """
SELECT symbol, issue_name, market, reason_code, halt_start,
       CASE WHEN coalesce(resumption_trade_time, resumption_quote_time) IS NOT NULL THEN halt_end END AS halt_end,
       resumption_date, resumption_quote_time, resumption_trade_time FROM halt_obs"""


@query("scan_halt_feed", _FEED_OBS)
def _(i: Inputs) -> DataFrame:
    return feeds.scan_halt_feed(i.spark, _feed(i, "feed")).select(*OBS_COLS)


@query("route_reason_by_feed", """
SELECT CASE WHEN user_id % 2 = 0 THEN event_type END AS reason_code, CASE WHEN user_id % 2 = 1 THEN event_type END AS resumption_reason_code,
       count(*) AS n FROM events GROUP BY 1, 2""")
def _(i: Inputs) -> DataFrame:
    kind = F.when(F.col("user_id") % 2 == 0, F.lit("halt")).otherwise(F.lit("resumption"))
    halt, resumption = feeds.route_reason(F.col("event_type"), kind)
    routed = i.table("events").select(halt.alias("reason_code"), resumption.alias("resumption_reason_code"))
    return routed.groupBy("reason_code", "resumption_reason_code").agg(F.count(F.lit(1)).alias("n"))


@query("market_fallback", """
SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'Q' WHEN event_id % 2 = 0 THEN 'NYSE' END AS market FROM events""")
def _(i: Inputs) -> DataFrame:
    e = F.col("event_id")
    mkt = F.when(e % 3 == 0, F.lit("  ")).otherwise(F.lit(" Q "))
    market = F.when(e % 2 == 0, F.lit("NYSE"))
    return i.table("events").select("event_id", feeds.market_fallback(mkt, market).alias("market"))


@query("scan_resumption_files", """
SELECT symbol, market, reason_code AS resumption_reason_code, CAST(NULL AS VARCHAR) AS reason_code, halt_start, resumption_date FROM halt_obs""")
def _(i: Inputs) -> DataFrame:
    # Spark names part files itself.
    found = feeds.scan_resumption_files(i.spark, _feed(i, "resumption-feed"), "part-*")
    return found.select("symbol", "market", "resumption_reason_code", "reason_code", "halt_start", "resumption_date")


@query("tolerant_feed_scan", "SELECT symbol, halt_start FROM halt_obs")
def _(i: Inputs) -> DataFrame:
    folder = work_dir(i.spark, "broken-feed")
    # Before each item one whose element does not close, and one that is left open.
    _write_feed(_items(i), folder, F.concat(F.lit("<item><ndaq:IssueSymbol>Z"), F.lit("</item><item><ndaq:IssueSymbol>Y")))
    return feeds.scan_halt_feed(i.spark, folder).select("symbol", "halt_start")


@query("bad_feed_items", "SELECT 'Z' || event_id AS symbol, count(*) AS rejects FROM halt_obs JOIN events ON event_id = obs_id // 4 GROUP BY 1")
def _(i: Inputs) -> DataFrame:
    folder = work_dir(i.spark, "bad-items")
    # A broken item before each good one.
    name = s("Z", text(F.floor(F.col("obs_id") / 4).cast("bigint")))
    items = _items(i, i.halt_obs.withColumn("issue_name", name))
    _write_feed(items, folder, F.concat(F.lit("<item><ndaq:IssueSymbol>"), F.col("`ndaq:IssueName`"), F.lit("</item>")))
    bad = feeds.bad_feed_items(i.spark, folder)
    symbol = F.regexp_extract("text", "<ndaq:IssueSymbol>([^<]*)", 1)
    return bad.groupBy(symbol.alias("symbol")).agg(F.count(F.lit(1)).alias("rejects"))


# -- streams -----------------------------------------------------------------------------------

def _drain(stream: DataFrame, i: Inputs, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read its Parquet sink."""
    out, checkpoint = work_dir(i.spark, label), work_dir(i.spark, f"{label}-cp")
    q = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return i.spark.read.schema(stream.schema).parquet(out)


def _drain_updates(stream: DataFrame, i: Inputs, label: str) -> DataFrame:
    """Run an update-mode stream; every batch's changes land in the sink with their batch number."""
    out, checkpoint = work_dir(i.spark, label), work_dir(i.spark, f"{label}-cp")

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).outputMode("update").trigger(
        availableNow=True).start().awaitTermination()
    return i.spark.read.option("basePath", out).parquet(f"{out}/batch=*")


def _stream_of(rows: DataFrame, i: Inputs, label: str, files_per_batch: int | None = None) -> DataFrame:
    folder = work_dir(i.spark, label)
    rows.write.parquet(folder)
    reader = i.spark.readStream.schema(rows.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


@query("stream_dedup", """
SELECT DISTINCT symbol, halt_start, resumption_date, resumption_trade_time, reason_code FROM halt_obs""")
def _(i: Inputs) -> DataFrame:
    stream = _stream_of(i.halt_obs.repartition(4, F.xxhash64("obs_id")), i, "dedup-in", 1)
    unique = SH.stream_dedup(stream, "40 days").select(
        "symbol", "halt_start", "resumption_date", "resumption_trade_time", "reason_code")
    return _drain(unique, i, "dedup-out")


@query("stream_bars_tumbling", """
SELECT ticker, bucket_start, bucket_start + INTERVAL 5 MINUTE AS bucket_end, first(open ORDER BY bar_start) AS open, max(high) AS high,
       min(low) AS low, last("close" ORDER BY bar_start) AS "close", CAST(sum(volume) AS BIGINT) AS volume
FROM (SELECT *, date_trunc('day', bar_start) + to_minutes(((hour(bar_start) * 60 + minute(bar_start)) // 5) * 5) AS bucket_start,
             max(bar_start) OVER () AS newest FROM bars)
GROUP BY ticker, bucket_start, newest HAVING bucket_start + INTERVAL 5 MINUTE <= newest - INTERVAL 10 MINUTE""")
def _(i: Inputs) -> DataFrame:
    return _drain(SB.stream_bars_tumbling(_stream_of(i.bars, i, "bars-in"), 5), i, "bars-out")


# Three parts by minute, one after the other: most bars of the later ones come when their bucket is closed.
@query("stream_bars_corrected", """
SELECT * FROM (
WITH parts AS (
  SELECT *, minute(bar_start) % 3 AS part, date_trunc('day', bar_start) + to_minutes(((hour(bar_start) * 60 + minute(bar_start)) // 5) * 5) AS bucket_start
  FROM bars),
placed AS (
  SELECT p.*, coalesce(bucket_start + INTERVAL 5 MINUTE <= (SELECT max(bar_start) FROM parts q WHERE q.part < p.part) - INTERVAL 10 MINUTE, false) AS late
  FROM parts p)
SELECT ticker, bucket_start, bucket_start + INTERVAL 5 MINUTE AS bucket_end, first(open ORDER BY bar_start) AS open, max(high) AS high,
       min(low) AS low, last("close" ORDER BY bar_start) AS "close", CAST(sum(volume) AS BIGINT) AS volume,
       CAST(count(*) FILTER (WHERE late) AS BIGINT) AS late_bars
FROM placed GROUP BY ticker, bucket_start
HAVING bucket_start + INTERVAL 5 MINUTE <= (SELECT max(bar_start) FROM bars) - INTERVAL 10 MINUTE)""")
def _(i: Inputs) -> DataFrame:
    source, root, checkpoint = (work_dir(i.spark, f"corrected-{n}") for n in ("in", "out", "cp"))
    for part in range(3):
        i.bars.filter(F.minute("bar_start") % 3 == part).write.mode("append").parquet(source)
        SB.stream_bars_corrected(i.spark.readStream.schema(i.bars.schema).parquet(source), root, 5, checkpoint).trigger(
            availableNow=True).start().awaitTermination()
    late = SB.read_bars_aside(i.spark, root).filter(F.col("why") == "late").groupBy("ticker", "bucket_start").agg(F.count("*").alias("n"))
    return SB.closed_buckets(SB.read_bar_changes(i.spark, root)).join(late, ["ticker", "bucket_start"], "left").withColumn(
        "late_bars", F.coalesce("n", F.lit(0).cast("long"))).drop("n")


@query("point_in_time_features", """
SELECT ticker, CAST(bar_start AS DATE) AS trading_day, count(*) AS visible_bars, max(bar_start) AS last_bar, max(high) AS session_high,
       min(low) AS session_low, CAST(sum(volume) AS BIGINT) AS session_volume,
       round(sum((high + low + "close") / 3 * volume) / nullif(sum(volume), 0), 6) AS vwap FROM bars GROUP BY 1, 2""")
def _(i: Inputs) -> DataFrame:
    updates = _drain_updates(SB.point_in_time_features(_stream_of(i.bars, i, "pit-in"), "40 days"), i, "pit-out")
    rest = [c for c in updates.columns if c not in ("ticker", "trading_day", "batch")]
    last = updates.groupBy("ticker", "trading_day").agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select("ticker", "trading_day", *[F.col(f"r.{c}").alias(c) for c in rest]).withColumn("vwap", r6("vwap"))


@query("stream_open_halts", """
SELECT symbol, market, halt_start, halt_end, array_to_string(reason_codes, '|') AS reason_codes, halt_end IS NULL AS is_open FROM episodes""")
def _(i: Inputs) -> DataFrame:
    store, checkpoint = work_dir(i.spark, "open-store"), work_dir(i.spark, "open-cp")
    # Rows come in hashed order, two files a trigger.
    stream = _stream_of(i.unique_obs.repartition(6, F.xxhash64("obs_id")), i, "open-in", 2)
    SH.stream_open_halts(stream, store, checkpoint, ["obs_id"]).trigger(availableNow=True).start().awaitTermination()
    return SH.read_open_halts(i.spark, store).select(
        "symbol", "market", "halt_start", "halt_end", F.array_join("reason_codes", "|").alias("reason_codes"), "is_open")


# Two polls: the table after the second equals the merge of both snapshots.
@query("live_halt_ingest", """
SELECT symbol, market, halt_start, reason_code, resumption_date, resumption_quote_time, resumption_trade_time FROM (
  SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.market, n.market) AS market, coalesce(o.halt_start, n.halt_start) AS halt_start,
         coalesce(o.reason_code, n.reason_code) AS reason_code,
         CASE WHEN n.clear_resumption THEN NULL ELSE coalesce(n.resumption_date, o.resumption_date) END AS resumption_date,
         CASE WHEN n.clear_resumption THEN NULL ELSE coalesce(n.resumption_quote_time, o.resumption_quote_time) END AS resumption_quote_time,
         CASE WHEN n.clear_resumption THEN NULL ELSE coalesce(n.resumption_trade_time, o.resumption_trade_time) END AS resumption_trade_time
  FROM (SELECT * FROM stored_canonical WHERE reason_code IS NOT NULL) o
  FULL OUTER JOIN (SELECT * FROM incoming_dedup_canonical WHERE reason_code IS NOT NULL) n
   ON o.symbol = n.symbol AND o.market = n.market AND o.halt_start = n.halt_start AND o.reason_code = n.reason_code)""")
def _(i: Inputs) -> DataFrame:
    feed, halts, episodes = work_dir(i.spark, "live-feed"), work_dir(i.spark, "live-halts"), work_dir(i.spark, "live-episodes")
    checkpoint = work_dir(i.spark, "live-cp")
    i = i.spread()
    first = i.halt_obs.filter((F.hour("halt_start") < 16) & (F.col("copy_no") == 0))
    second = i.halt_obs.filter(F.hour("halt_start") >= 8)
    for poll in (first, second):
        _write_feed(_items(i, poll), feed)
        stream = SH.read_feed_stream(i.spark, feed)
        SH.live_halt_ingest(stream, halts, episodes, checkpoint, ["issue_name", "halt_end"]).trigger(
            availableNow=True).start().awaitTermination()
    return versions.read_current(i.spark, halts).select(*HALT_KEY, *RESUMPTION_BLOCK)


# Three polls in hashed order, copies of an observation in different ones: the episodes are those of one batch.
@query("live_halt_episodes", """
SELECT 'episode' AS kind, symbol, market, halt_start, halt_end, issue_name, array_to_string(reason_codes, '|') AS codes,
       duration_minutes, halt_close_status, CAST(observation_count AS BIGINT) AS observation_count FROM episodes
UNION ALL
SELECT DISTINCT 'reject', symbol, NULL, halt_start, NULL, NULL, 'reason_code', NULL, NULL, NULL FROM halt_obs WHERE reason_code IS NULL""")
def _(i: Inputs) -> DataFrame:
    halts, store, rejects, checkpoint = (work_dir(i.spark, f"polls-{n}") for n in ("halts", "episodes", "rejects", "cp"))
    stream = _stream_of(i.halt_obs.drop("copy_no").repartition(3, F.xxhash64("obs_id")), i, "polls-in", 1)
    SH.live_halt_ingest(stream, halts, store, checkpoint, ["obs_id"], rejects).trigger(availableNow=True).start().awaitTermination()
    episodes = SH.read_open_halts(i.spark, store).select(
        F.lit("episode").alias("kind"), "symbol", "market", "halt_start", "halt_end", "issue_name", F.array_join("reason_codes", "|").alias("codes"),
        "duration_minutes", "halt_close_status", "observation_count")
    refused = i.spark.read.option("basePath", rejects).parquet(f"{rejects}/batch=*").select(
        F.lit("reject").alias("kind"), "symbol", "halt_start", F.array_join("missing", "|").alias("codes")).distinct()
    return episodes.unionByName(refused, allowMissingColumns=True)


@query("late_resumption", """
SELECT h.id, CASE WHEN b.id IS NOT NULL THEN b.resumption_date ELSE h.resumption_date END AS resumption_date,
       CASE WHEN b.id IS NOT NULL THEN b.resumption_quote_time ELSE h.resumption_quote_time END AS resumption_quote_time,
       CASE WHEN b.id IS NOT NULL THEN b.resumption_trade_time ELSE h.resumption_trade_time END AS resumption_trade_time
FROM halt_rows h LEFT JOIN (
  SELECT * FROM resumption_moments WHERE moment >= halt_start
  QUALIFY row_number() OVER (PARTITION BY symbol, market, halt_start ORDER BY moment DESC, id DESC) = 1) b
 ON b.symbol = h.symbol AND b.market = h.market AND b.halt_start = h.halt_start""")
def _(i: Inputs) -> DataFrame:
    halts, arrived, checkpoint = work_dir(i.spark, "late-halts"), work_dir(i.spark, "late-seen"), work_dir(i.spark, "late-cp")
    versions.write_batch(versions.with_day(i.halt_rows), halts, 0)
    # Several batches, later moments first for some halts.
    stream = _stream_of(i.resumptions.repartition(6, F.xxhash64("id")), i, "late-in", 2)
    SH.late_resumptions(stream, halts, 1, arrived, checkpoint, "id").trigger(availableNow=True).start().awaitTermination()
    return versions.read_current(i.spark, halts).select("id", *RESUMPTION_BLOCK)


_FIRST_ENDS = """
SELECT l.episode_id, max(CAST(CAST(h.resumption_date AS VARCHAR) || ' ' || coalesce(h.resumption_trade_time, h.resumption_quote_time) AS TIMESTAMP)) AS t
FROM links l JOIN all_halt_rows h ON h.id = l.trade_halt_id GROUP BY 1"""
# Halts with their best resumption, as after the last batch.
_BEST = """
SELECT h.id, coalesce(b.moment, CAST(CAST(h.resumption_date AS VARCHAR) || ' ' || coalesce(h.resumption_trade_time, h.resumption_quote_time) AS TIMESTAMP)) AS moment
FROM all_halt_rows h LEFT JOIN (
  SELECT symbol, market, halt_start, max(moment) AS moment FROM resumption_moments WHERE moment >= halt_start GROUP BY ALL) b
 ON b.symbol = h.symbol AND b.market = h.market AND b.halt_start = h.halt_start"""


# Episodes are first closed by their raw rows; then three batches of resumptions arrive, and the last one is run again.
@query("late_resumption_episodes", f"""
SELECT episode_id, CASE WHEN u2 THEN t2 ELSE halt_end END AS halt_end,
       round(date_diff('microsecond', halt_start, CASE WHEN u2 THEN t2 ELSE halt_end END) / 6e7, 3) AS duration_minutes,
       CASE WHEN u2 AND m2 THEN 'MULTI_DAY' ELSE halt_close_status END AS halt_close_status FROM (
WITH a AS (
  SELECT e.*, t.t AS t1, CAST(t.t AS DATE) > CAST(e.halt_start AS DATE) AS m1
  FROM episodes e LEFT JOIN ({_FIRST_ENDS}) t ON t.episode_id = e.episode_id AND t.t >= e.halt_start),
b AS (
  SELECT episode_id, halt_start, coalesce(t1 IS NOT NULL AND (halt_end IS NULL OR t1 > halt_end OR duration_minutes IS NULL
         OR (m1 AND halt_close_status <> 'MULTI_DAY')), false) AS u1, m1, t1, halt_end, halt_close_status FROM a),
c AS (
  SELECT episode_id, halt_start, CASE WHEN u1 THEN t1 ELSE halt_end END AS halt_end,
         CASE WHEN u1 AND m1 THEN 'MULTI_DAY' ELSE halt_close_status END AS halt_close_status FROM b),
d AS (
  SELECT c.*, n.t AS t2, CAST(n.t AS DATE) > CAST(c.halt_start AS DATE) AS m2
  FROM c LEFT JOIN (SELECT l.episode_id, max(x.moment) AS t FROM links l JOIN ({_BEST}) x ON x.id = l.trade_halt_id GROUP BY 1) n
   ON n.episode_id = c.episode_id AND n.t >= c.halt_start),
e AS (SELECT *, coalesce(t2 IS NOT NULL AND (halt_end IS NULL OR t2 > halt_end OR (m2 AND halt_close_status <> 'MULTI_DAY')), false) AS u2 FROM d)
SELECT * FROM e)""")
def _(i: Inputs) -> DataFrame:
    halts, arrived, episodes, links = (work_dir(i.spark, f"late-all-{n}") for n in ("halts", "seen", "episodes", "links"))
    SH.dated_links(i.links, i.core_episodes, i.all_halt_rows, "id").write.parquet(links)
    versions.write_batch(versions.with_day(i.all_halt_rows), halts, 0)
    first = M.enrich_episodes(i.core_episodes, i.links, i.all_halt_rows).drop("core_updated")
    versions.write_batch(versions.with_day(first), episodes, 0)
    stream = _stream_of(i.resumptions.repartition(3, F.xxhash64("id")), i, "late-all-in", 1)
    run = SH.late_resumption_batch(halts, 1, arrived, "id", links, episodes)

    def twice(batch: DataFrame, batch_id: int) -> None:
        run(batch, batch_id)
        run(batch, batch_id)

    stream.writeStream.foreachBatch(twice).option("checkpointLocation", work_dir(i.spark, "late-all-cp")).trigger(
        availableNow=True).start().awaitTermination()
    return versions.read_current(i.spark, episodes).select("episode_id", "halt_end", "duration_minutes", "halt_close_status")
