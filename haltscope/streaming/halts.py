"""Live halts: ingest, deduplication, open halts, late resumptions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from haltscope.operators.canonical import RESUMPTION_KEY, canonical_halts
from haltscope.operators.episodes import OBSERVATION_KEY, dedup_observations
from haltscope.operators.merge import enrich_episodes, enrich_halts, merge_halts, new_rows, write_counted
from haltscope.sources.feeds import CORRUPT, HALT, ITEM_END, check_feed, events_from_items, items_of
from haltscope.sources.versions import day_list, forget_steps, last_batch, read_current, with_day, write_batch, write_step
from haltscope.streaming.frontier import episode_store_batch, read_episodes


def read_feed_stream(spark: SparkSession, path: str, feed: str = HALT, files_per_batch: int | None = None) -> DataFrame:
    """New feed files as a stream of observations."""
    check_feed(feed)
    reader = spark.readStream.option("lineSep", ITEM_END)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    items = items_of(reader.text(path).select("value", F.col("_metadata.file_name").alias("_file")))
    return events_from_items(items.filter(F.col(CORRUPT).isNull()), F.col("_file"), F.lit(feed))


def stream_dedup(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first copy of each observation; copies within ``delay`` are ignored.

    State is dropped once the watermark passes, so it stays bounded. The
    watermark column is the start read as an instant in the session zone.
    """
    return (
        events.withColumn("_event_time", F.col("halt_start").cast("timestamp"))
        .withWatermark("_event_time", delay)
        .dropDuplicatesWithinWatermark(OBSERVATION_KEY)
        .drop("_event_time")
    )


# -- ingest --------------------------------------------------------------------

ORDER = ["source_file", "halt_start", "halt_end"]


def ingest_batch(
    halts_root: str, episodes_root: str, order_cols: list[str], rejects_root: str | None = None, outcomes_root: str | None = None
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: upsert one snapshot into the halt and episode tables.

    Halts are merged with the stored rows of their days. Episodes are merged
    with those within reach (``streaming.frontier``): a halt that an earlier
    poll left open is the same episode in the next one, and observations without
    a market form episodes of their own. Observations that cannot be stored as
    halts (no start, market or reason) are written to ``rejects_root`` with what
    is missing. ``outcomes_root`` gets the number of rows inserted, updated and left
    alone by each batch, counted in the pass that writes the halts.
    """
    merge_episodes = episode_store_batch(episodes_root, order_cols, unique=True)

    def upsert_halts(usable: DataFrame, batch_id: int) -> None:
        days = day_list(with_day(usable))
        incoming = with_day(canonical_halts(usable, order_cols))
        existing = read_current(usable.sparkSession, halts_root, batch_id, incoming.schema, days)
        counts = write_counted(
            merge_halts(existing, incoming), lambda merged: write_batch(with_day(merged.drop("action")), halts_root, batch_id))
        if outcomes_root:
            counts.coalesce(1).write.mode("overwrite").parquet(f"{outcomes_root}/batch={batch_id}")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            snapshot = write_step(dedup_observations(batch, order_cols), halts_root, batch_id, "snapshot")
            missing = F.filter(
                F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("halt_start", "market", "reason_code")]), lambda c: c.isNotNull()
            )
            usable = snapshot.filter(F.size(missing) == 0)
            if rejects_root:
                refused = snapshot.withColumn("missing", missing).filter(F.size("missing") > 0)
                refused.write.mode("overwrite").parquet(f"{rejects_root}/batch={batch_id}")
            upsert_halts(usable, batch_id)
            merge_episodes(snapshot, batch_id)
        finally:
            forget_steps(spark, halts_root, batch_id)

    return run


def live_halt_ingest(
    events: DataFrame, halts_root: str, episodes_root: str, checkpoint: str, order_cols: list[str] = ORDER,
    rejects_root: str | None = None, outcomes_root: str | None = None,
) -> DataStreamWriter:
    """Stream of observations -> stored halts and episodes. Start it with a trigger of your choice."""
    return (
        events.writeStream.foreachBatch(ingest_batch(halts_root, episodes_root, order_cols, rejects_root, outcomes_root))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def export_live_events(events: DataFrame, folder: str, checkpoint: str, order_cols: list[str] = ORDER) -> DataStreamWriter:
    """Each deduplicated batch replaces the CSV of the latest events."""
    from haltscope.sources.tables import export_csv, live_event_rows

    def run(batch: DataFrame, batch_id: int) -> None:
        export_csv(live_event_rows(dedup_observations(batch, order_cols)), folder)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


# -- late resumptions -------------------------------------------------------------

def dated_links(links: DataFrame, episodes: DataFrame, halts: DataFrame, id_col: str) -> DataFrame:
    """Links with the days under which their episode and their raw row are stored."""
    return (
        links.join(episodes.select("episode_id", F.to_date("halt_start").alias("episode_day")), "episode_id")
        .join(halts.select(F.col(id_col).alias("trade_halt_id"), F.to_date("halt_start").alias("halt_day")), "trade_halt_id")
        .select("episode_id", "trade_halt_id", "episode_day", "halt_day")
    )


def late_resumption_batch(
    halts_root: str, first_batch: int, resumptions_root: str, id_col: str,
    links_path: str | None = None, episodes_root: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: late resumptions enrich stored halts and their episodes, never create one.

    A resumption is stored once per key (``RESUMPTION_KEY``), whatever number of
    times it arrives. A halt gets the best of all that are stored for it, so a
    batch with an earlier moment takes nothing back. Episodes linked with halts
    of the days concerned are closed or extended by all their raw rows; links
    themselves stay. No watermark bounds it: a resumption may come weeks later.

    All tables are versions by day. A batch reads what was stored before it, so
    one that is run again, after any of its writes, ends with the same tables;
    :func:`settled_batch` tells which batch all of them hold.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, version = batch.sparkSession, first_batch + batch_id
        arrived = with_day(batch.filter(F.col("resumption_date").isNotNull() & F.col("halt_start").isNotNull())).persist()
        try:
            days = day_list(arrived)
            known = read_current(spark, resumptions_root, version, arrived.schema, days)
            key = [c for c in RESUMPTION_KEY if c in arrived.columns]
            write_batch(known.unionByName(new_rows(known, arrived, key)), resumptions_root, version)
            known = read_current(spark, resumptions_root, version + 1, arrived.schema, days).drop("halt_day")
            touched = read_current(spark, halts_root, version, None, days)
            write_batch(enrich_halts(touched, known, id_col).drop("raw_updated"), halts_root, version)
            if episodes_root:
                extend(spark, version, days)
        finally:
            arrived.unpersist()

    def extend(spark: SparkSession, version: int, days: list) -> None:
        links = spark.read.parquet(links_path)
        wanted = links.filter(F.col("halt_day").isin(days)).select("episode_id").distinct()
        mine = links.join(wanted, "episode_id", "left_semi").persist()
        found = mine.agg(F.collect_set("episode_day").alias("episodes"), F.collect_set("halt_day").alias("halts")).first()
        halts = read_current(spark, halts_root, version + 1, None, found.halts)
        halts = halts.withColumnRenamed(id_col, "id") if id_col != "id" else halts
        episodes = read_current(spark, episodes_root, version, None, found.episodes)
        changed = enrich_episodes(episodes, mine.select("episode_id", "trade_halt_id"), halts)
        write_batch(changed.drop("core_updated"), episodes_root, version)
        mine.unpersist()

    return run


def settled_batch(spark: SparkSession, *roots: str) -> int | None:
    """The last batch that all tables hold; read them with ``before_batch`` one above it."""
    newest = [last_batch(spark, root) for root in roots]
    return None if None in newest else min(newest)


def late_resumptions(
    events: DataFrame, halts_root: str, first_batch: int, resumptions_root: str, checkpoint: str, id_col: str,
    links_path: str | None = None, episodes_root: str | None = None,
) -> DataStreamWriter:
    return events.writeStream.foreachBatch(
        late_resumption_batch(halts_root, first_batch, resumptions_root, id_col, links_path, episodes_root)
    ).option("checkpointLocation", checkpoint)


# -- open halts ---------------------------------------------------------------------------

def stream_open_halts(events: DataFrame, root: str, checkpoint: str, order_cols: list[str] = ORDER) -> DataStreamWriter:
    """Stream of observations -> the episodes of each (symbol, venue), open ones among them.

    A batch reads and rewrites the days of the episodes within its reach; what is
    further back stays in its folders, unread (see ``streaming.frontier``).
    """
    return events.writeStream.foreachBatch(episode_store_batch(root, order_cols)).option("checkpointLocation", checkpoint)


def read_open_halts(spark: SparkSession, root: str) -> DataFrame:
    """All stored episodes, and which are open."""
    return read_episodes(spark, root)
