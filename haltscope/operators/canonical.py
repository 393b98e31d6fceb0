"""Canonical halt rows, resumption choice and the set-based loaders' row choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from haltscope.functions.clean import normalize_market, resumption_rank
from haltscope.functions.times import date_and_time
from haltscope.operators.scaling import best_row, spread_join

HALT_KEY = ["symbol", "market", "halt_start", "reason_code"]
RESUMPTION_KEY = [
    "symbol",
    "market",
    "halt_start",
    "reason_code",
    "resumption_reason_code",
    "resumption_date",
    "resumption_quote_time",
    "resumption_trade_time",
]
# Key used before resumption reasons were kept apart.
RESUMPTION_KEY_WITHOUT_REASON = [c for c in RESUMPTION_KEY if c != "resumption_reason_code"]
RESUMPTION_BLOCK = ["resumption_date", "resumption_quote_time", "resumption_trade_time"]


def resumption_moment() -> Column:
    """Resumption date with the trade time, or else the quote time."""
    return date_and_time(
        "resumption_date", F.coalesce("resumption_trade_time", "resumption_quote_time")
    )


def canonical_halts(obs: DataFrame, order_cols: list[str]) -> DataFrame:
    """One row per natural key.

    The resumption fields come together from the best-ranked observation;
    name and price are the last known ones; ``clear_resumption`` says every
    observation with an end was invalid and none was usable.
    """
    order = F.struct(*order_cols)
    rank = resumption_rank(
        "halt_start", "halt_end", "resumption_date", "resumption_quote_time", "resumption_trade_time"
    )
    ranked = obs.withColumn("_rank", rank)

    def last_known(col: str) -> Column:
        return F.max_by(F.col(col), F.when(F.col(col).isNotNull(), order)).alias(col)

    invalid = F.coalesce(F.col("halt_end") < F.col("halt_start"), F.lit(False))
    grouped = ranked.groupBy(*HALT_KEY).agg(
        last_known("issue_name"),
        last_known("pause_threshold_price"),
        F.max("_rank").alias("_best"),
        (F.bool_or(invalid) & (F.max("_rank.rank") == 0)).alias("clear_resumption"),
        F.min_by("source_file", order).alias("source_file"),
    )
    return grouped.select(
        *HALT_KEY,
        "issue_name",
        F.col("_best.res_date").alias("resumption_date"),
        F.col("_best.quote").alias("resumption_quote_time"),
        F.col("_best.trade").alias("resumption_trade_time"),
        "pause_threshold_price",
        "source_file",
        "clear_resumption",
    )


def first_best_halts(staged: DataFrame, order_cols: list[str]) -> DataFrame:
    """One staged row per halt key: a known name first, then a known price, then load order."""
    known = F.struct(
        F.col("issue_name").isNull(), F.col("pause_threshold_price").isNull(), *order_cols
    )
    return best_row(staged, HALT_KEY, known, lowest=True)


def first_best_episodes(staged: DataFrame, id_col: str) -> DataFrame:
    """One staged episode per key: an ended one first, latest end, lowest id."""
    # Latest end first inside a minimum: count backwards from a far moment.
    backwards = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz") - F.col("halt_end")
    rank = F.struct(F.col("halt_end").isNull(), backwards, F.col(id_col).isNull(), F.col(id_col))
    return best_row(staged, ["symbol", "market", "halt_start"], rank, lowest=True)


def latest_resumptions(resumptions: DataFrame, id_col: str) -> DataFrame:
    """Per halt the valid resumption with the latest moment; the highest id breaks ties."""
    moment = resumption_moment()
    return best_row(
        resumptions.withColumn("halt_end", moment).filter(F.col("halt_end") >= F.col("halt_start")),
        ["symbol", "market", "halt_start"],
        F.struct("halt_end", id_col),
    )


def keep_id_map(halts: DataFrame, id_col: str) -> DataFrame:
    """(duplicate_id, keep_id) for every redundant row of a halt key."""
    rank = F.struct(
        F.col("resumption_date").isNull(),
        F.col("resumption_trade_time").isNull(),
        F.col("resumption_quote_time").isNull(),
        F.col(id_col),
    )
    kept = (
        halts.groupBy(*HALT_KEY)
        .agg(F.min_by(id_col, rank).alias("keep_id"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    joined = spread_join(halts, kept, HALT_KEY, [id_col], null_safe=True)
    return joined.filter(F.col(id_col) != F.col("keep_id")).select(
        F.col(id_col).alias("duplicate_id"), "keep_id"
    )


def repoint_links(links: DataFrame, id_map: DataFrame) -> DataFrame:
    """Links with duplicate raw ids moved to the kept id; pairs that meet collapse."""
    moved = links.join(
        id_map.withColumnRenamed("duplicate_id", "trade_halt_id"), "trade_halt_id", "left"
    )
    return moved.select(
        "episode_id", F.coalesce("keep_id", "trade_halt_id").alias("trade_halt_id")
    ).distinct()


def dedup_resumptions(resumptions: DataFrame, id_col: str, with_reason: bool = True) -> DataFrame:
    """Lowest id per resumption key, NULLs equal."""
    key = RESUMPTION_KEY if with_reason else RESUMPTION_KEY_WITHOUT_REASON
    return best_row(resumptions, key, F.col(id_col), lowest=True)


def raw_events(halts: DataFrame) -> DataFrame:
    """Canonical rows back to observations: ``halt_end`` from the resumption fields."""
    return halts.withColumn("halt_end", resumption_moment())


def exact_source_event(episodes: DataFrame, obs: DataFrame) -> DataFrame:
    """Per episode how many observations equal it on all five attributes (must be 1)."""
    key = ["symbol", "market", "reason_code", "halt_start", "halt_end"]
    # Counting first keeps a pile of equal observations out of the join.
    counted = obs.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    same = [episodes[c].eqNullSafe(counted[c]) for c in key]
    return episodes.join(counted, same, "left").select(
        *[episodes[c] for c in key], F.coalesce("_n", F.lit(0)).alias("source_events")
    )


def representative_raw(episodes: DataFrame, halts: DataFrame, id_col: str) -> DataFrame:
    """Per episode one raw id at its venue and start: equal reason first, then lowest id.

    Raw rows are first cut to one id per (symbol, venue, start) and one per
    reason within it, so the join meets at most one row each.
    """
    raw = halts.withColumn("_mkt", normalize_market("market"))
    place = ["symbol", "_mkt", "halt_start"]
    any_reason = raw.groupBy(*place).agg(F.min(id_col).alias("_any"))
    by_reason = raw.groupBy(*place, "reason_code").agg(F.min(id_col).alias("_same"))
    ep = episodes.withColumn("_mkt", F.col("market"))
    return (
        ep.join(any_reason, place, "left")
        .join(by_reason, [*place, "reason_code"], "left")
        .select(*episodes.columns, F.coalesce("_same", "_any").alias("trade_halt_id"))
    )
