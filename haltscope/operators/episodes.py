"""Halt observations -> deduplicated observations -> continuous episodes.

Observation columns used here: symbol, issue_name, market, reason_code,
halt_start, halt_end (naive timestamps), resumption_date,
resumption_trade_time, pause_threshold_price, plus the ``order_cols`` that say
in which order observations were seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from haltscope.functions.clean import close_status, duration_minutes, normalize_market, valid_end
from haltscope.operators.scaling import DEFAULT_CHUNK, best_row, running_max, time_chunk
from haltscope.session import work_dir

OBSERVATION_KEY = ["symbol", "halt_start", "resumption_date", "resumption_trade_time", "reason_code"]
EPISODE_KEY = ["symbol", "market", "halt_start"]

_NO_MARKET = ""  # stands in for a NULL market inside join keys


def observation_key(obs: DataFrame) -> list[str]:
    """The key columns that a feed has; one without resumption columns is keyed by the others."""
    return [c for c in OBSERVATION_KEY if c in obs.columns]


def dedup_observations(obs: DataFrame, order_cols: list[str]) -> DataFrame:
    """One observation per key (NULLs equal); the last one seen wins."""
    return best_row(obs, observation_key(obs), F.struct(*order_cols))


def usable_observations(obs: DataFrame) -> DataFrame:
    """Only observations with a start can take part in an episode."""
    return obs.filter(F.col("halt_start").isNotNull())


def _by_start(obs: DataFrame, extra: list[Column]) -> DataFrame:
    """One row per (symbol, venue, start).

    Observations that share a start always share an episode, so they collapse
    before any ordering is needed; copies are combined map-side.
    """
    return (
        usable_observations(obs)
        .withColumn("_mkt", F.coalesce(normalize_market("market"), F.lit(_NO_MARKET)))
        .groupBy("symbol", "_mkt", "halt_start")
        .agg(F.max(valid_end("halt_start", "halt_end")).alias("_end"), *extra)
    )


def _label(starts: DataFrame, chunk_unit: str, keep: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows) -> DataFrame:
    """Add ``episode_start``, the start of the episode each row belongs to.

    M is the latest end seen before a row. A row starting after M can open an
    episode, and does so unless an earlier row with the same M already did:
    while an episode is open no later end arrives, so M stands still.
    Taking the maximum of (M, -start) over those candidates therefore points
    at the latest opening row. Before any end is seen M is NULL, which sorts
    lowest, so those rows point at the key's very first start.

    Each running maximum reads its input twice. ``keep`` may store what it reads
    (a table and its name), so that the steps before are not run again for that.
    """
    starts = keep(starts, "starts")
    keys, chunk, order = ["symbol", "_mkt"], "_chunk", ["halt_start"]
    df = starts.withColumn(chunk, time_chunk("halt_start", chunk_unit))
    df = running_max(df, keys, chunk, order, F.col("_end"), "_m", inclusive=False)
    df = keep(df, "ends_before")
    opens = F.col("_m").isNull() | (F.col("halt_start") > F.col("_m"))
    # Negated distance keeps "smallest start" inside a maximum.
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    opener = F.when(opens, F.struct(F.col("_m").alias("m"), (origin - F.col("halt_start")).alias("neg")))
    df = running_max(df, keys, chunk, order, opener, "_opener", inclusive=True)
    return df.withColumn("episode_start", origin - F.col("_opener.neg")).drop("_chunk", "_m", "_opener")


def halt_episodes(
    obs: DataFrame,
    order_cols: list[str],
    market_close: str = "16:00:00",
    chunk_unit: str = DEFAULT_CHUNK,
) -> DataFrame:
    """Merge observations into continuous halts per (symbol, venue).

    A halt stays open until a valid end (>= start) is seen; touching intervals
    merge. ``reason_code`` is set only when the episode has exactly one;
    ``reason_codes`` lists them all, sorted.
    """
    seen = F.struct(F.coalesce(valid_end("halt_start", "halt_end"), F.col("halt_start")), *order_cols)

    def first_known(col: str) -> Column:
        return F.min_by(F.col(col), F.when(F.col(col).isNotNull(), seen))

    starts = _by_start(
        obs,
        [
            F.collect_set("reason_code").alias("_reasons"),
            first_known("issue_name").alias("_name"),
            first_known("pause_threshold_price").alias("_price"),
            F.count(F.lit(1)).alias("_n"),
            F.count_if(F.col("halt_end") < F.col("halt_start")).alias("_bad"),
        ],
    )
    labelled = _label(starts, chunk_unit)

    def earliest(col: str) -> Column:
        return F.min_by(F.col(col), F.when(F.col(col).isNotNull(), F.col("halt_start")))

    grouped = labelled.groupBy("symbol", "_mkt", "episode_start").agg(
        F.min("halt_start").alias("halt_start"),
        F.max("_end").alias("halt_end"),
        # Bounded by the number of distinct reason codes.
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_reasons")))).alias("reason_codes"),
        earliest("_name").alias("issue_name"),
        earliest("_price").alias("pause_threshold_price"),
        F.sum("_n").alias("observation_count"),
        F.sum("_bad").alias("invalid_end_count"),
    )
    return grouped.select(
        "symbol",
        F.nullif(F.col("_mkt"), F.lit(_NO_MARKET)).alias("market"),
        "halt_start",
        "halt_end",
        "issue_name",
        F.when(F.size("reason_codes") == 1, F.element_at("reason_codes", 1)).alias("reason_code"),
        "reason_codes",
        "pause_threshold_price",
        duration_minutes("halt_start", "halt_end").alias("duration_minutes"),
        close_status("halt_start", "halt_end", market_close).alias("halt_close_status"),
        "observation_count",
        "invalid_end_count",
    )


def episode_membership(
    obs: DataFrame, chunk_unit: str = DEFAULT_CHUNK, keep: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows
) -> DataFrame:
    """Each observation with the (symbol, market, start) of its episode; ``keep`` as in :func:`_label`."""
    labelled = _label(_by_start(obs, []), chunk_unit, keep).drop("_end")
    rows = usable_observations(obs).withColumn(
        "_mkt", F.coalesce(normalize_market("market"), F.lit(_NO_MARKET))
    )
    return rows.join(labelled, ["symbol", "_mkt", "halt_start"]).select(
        *[F.col(c) for c in obs.columns],
        F.nullif(F.col("_mkt"), F.lit(_NO_MARKET)).alias("episode_market"),
        "episode_start",
    )


def episodes_of(members: DataFrame, order_cols: list[str], market_close: str = "16:00:00", also: dict[str, Column] | None = None) -> DataFrame:
    """The episodes of :func:`halt_episodes` from rows that :func:`episode_membership` has labelled, and ``last_start``.

    One aggregate: nothing is ordered again. ``also`` adds aggregates of the members.
    """
    also = also or {}
    end = valid_end("halt_start", "halt_end")
    seen = F.struct("halt_start", F.coalesce(end, F.col("halt_start")), *order_cols)

    def first_known(col: str) -> Column:
        return F.min_by(F.col(col), F.when(F.col(col).isNotNull(), seen))

    grouped = members.groupBy("symbol", F.col("episode_market").alias("market"), F.col("episode_start").alias("halt_start")).agg(
        F.max(end).alias("halt_end"),
        F.array_sort(F.collect_set("reason_code")).alias("reason_codes"),
        first_known("issue_name").alias("issue_name"),
        first_known("pause_threshold_price").alias("pause_threshold_price"),
        F.count(F.lit(1)).alias("observation_count"),
        F.count_if(F.col("halt_end") < F.col("halt_start")).alias("invalid_end_count"),
        F.max(F.col("halt_start")).alias("last_start"),
        *[value.alias(name) for name, value in also.items()],
    )
    return grouped.select(
        "symbol",
        "market",
        "halt_start",
        "halt_end",
        "issue_name",
        F.when(F.size("reason_codes") == 1, F.element_at("reason_codes", 1)).alias("reason_code"),
        "reason_codes",
        "pause_threshold_price",
        duration_minutes("halt_start", "halt_end").alias("duration_minutes"),
        close_status("halt_start", "halt_end", market_close).alias("halt_close_status"),
        "observation_count",
        "invalid_end_count",
        "last_start",
        *also,
    )


def episode_links(obs: DataFrame, id_col: str, chunk_unit: str = DEFAULT_CHUNK) -> DataFrame:
    """Distinct (symbol, market, halt_start, raw id) pairs: which raw rows made which episode."""
    return (
        episode_membership(obs, chunk_unit)
        .select(
            "symbol",
            F.col("episode_market").alias("market"),
            F.col("episode_start").alias("halt_start"),
            F.col(id_col).alias("trade_halt_id"),
        )
        .distinct()
    )


def episode_raw_summary(membership: DataFrame) -> DataFrame:
    """Name / venue / reason of an episode, each kept only when its raw rows agree."""

    def only_value(c: Column) -> Column:
        return F.when(F.min(c) == F.max(c), F.min(c))

    return membership.groupBy(
        "symbol", F.col("episode_market").alias("market"), F.col("episode_start").alias("halt_start")
    ).agg(
        only_value(F.col("issue_name")).alias("single_issue_name"),
        only_value(normalize_market("market")).alias("single_market"),
        only_value(F.col("reason_code")).alias("single_reason_code"),
        F.array_sort(F.collect_set("reason_code")).alias("reason_codes"),
        F.count(F.lit(1)).alias("raw_count"),
    )


def episode_stats(episodes: DataFrame) -> DataFrame:
    """One row of episode statistics."""
    status = F.col("halt_close_status")
    return episodes.agg(
        F.count(F.lit(1)).alias("episode_count"),
        F.count("duration_minutes").alias("duration_count"),
        F.count_if(status == "YES").alias("close_yes"),
        F.count_if(status == "NO").alias("close_no"),
        F.count_if(status == "UNKNOWN").alias("close_unknown"),
        F.count_if(status == "MULTI_DAY").alias("close_multi_day"),
        F.coalesce(F.sum("invalid_end_count"), F.lit(0)).alias("invalid_end_count"),
        F.count_if(F.size("reason_codes") > 1).alias("multi_reason_count"),
    )


def in_event_order(obs: DataFrame, order_cols: list[str]) -> DataFrame:
    """Observations by key, start and (valid end or start): a range-partitioned sort."""
    sort_end = F.coalesce(valid_end("halt_start", "halt_end"), F.col("halt_start"))
    return obs.withColumn("sort_end", sort_end).orderBy("symbol", "market", "halt_start", "sort_end", *order_cols)


def with_episode_ids(episodes: DataFrame) -> DataFrame:
    """Add ``episode_id`` = H + eight digits, numbered in (start, symbol, market) order.

    The sorted table is written once to the shared folder with each row's
    partition and place in it, so both stay fixed whatever is recomputed later.
    A row's number is then its place plus the sizes of the earlier partitions;
    only those sizes (one row per partition) are brought together.
    """
    spark = episodes.sparkSession
    folder = work_dir(spark, "episode-ids")
    (
        episodes.withColumn("_m", F.coalesce("market", F.lit(_NO_MARKET)))
        .orderBy("halt_start", "symbol", "_m")
        .drop("_m")
        # (partition << 33) + place in the partition
        .withColumn("_id", F.monotonically_increasing_id())
        .write.parquet(folder)
    )
    placed = spark.read.parquet(folder).withColumn("_part", F.shiftrightunsigned("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(offsets), "_part").select(
        F.format_string("H%08d", F.col("_offset") + place).alias("episode_id"), *episodes.columns
    )
