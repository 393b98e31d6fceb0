"""Building blocks that keep one hot key from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# How a key's history is cut: into "day" chunks, or "hour" chunks for very hot keys.
DEFAULT_CHUNK = "day"


def time_chunk(ts: Column | str, unit: str) -> Column:
    """Chunk number of a timestamp: its day, or its hour for very hot keys."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    day = F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    if unit == "day":
        return day
    if unit == "hour":
        return day * 24 + F.hour(ts)
    raise ValueError("chunk unit is 'day' or 'hour'")


def running_max(
    df: DataFrame,
    keys: list[str],
    chunk: str,
    order: list[str],
    value: Column,
    out: str,
    inclusive: bool,
) -> DataFrame:
    """``max(value)`` over the earlier rows of each key, without a window per key.

    The window runs inside (key, chunk) only; each chunk then receives the
    maximum of all earlier chunks of its key from a table with one row per
    (key, chunk). A key that holds a third of all rows is so spread over as
    many tasks as it has chunks. ``keys`` must not be NULL.
    """
    part = [*keys, chunk]
    upto = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    local = df.withColumn("_value", value).withColumn("_local", F.max("_value").over(inside))
    totals = local.groupBy(*part).agg(F.max("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*part, F.max("_total").over(earlier).alias("_carry"))

    return (
        local.join(carry, part)
        .withColumn(out, F.greatest("_local", "_carry"))
        .drop("_value", "_local", "_carry")
    )


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    spread_on: list[str],
    pieces: int = 16,
    how: str = "inner",
    null_safe: bool = False,
) -> DataFrame:
    """Equi join whose left side may be hot on ``keys``.

    Each left row goes to one of ``pieces`` by a hash of ``spread_on``; the
    right side, which has few rows per key, is repeated once per piece.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("only joins that keep left rows can be spread")
    salted = left.withColumn("_piece", F.pmod(F.xxhash64(*spread_on), F.lit(pieces)).cast("int"))
    copies = right.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    if not null_safe:
        return salted.join(copies, [*keys, "_piece"], how).drop("_piece")
    renamed = copies.select(*[F.col(c).alias(f"_r_{c}") if c in (*keys, "_piece") else F.col(c) for c in copies.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys] + [F.col("_piece") == F.col("_r__piece")]
    return salted.join(renamed, same, how).drop("_piece", "_r__piece", *[f"_r_{c}" for c in keys])


def best_row(df: DataFrame, keys: list[str], rank: Column, lowest: bool = False) -> DataFrame:
    """One whole row per key: the one with the highest (or lowest) rank.

    An aggregate, not a ``row_number`` window: copies of a key are combined
    before the shuffle, so a huge group of copies costs one row per map task.
    ``rank`` must be unique within a key for a repeatable answer.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if lowest else F.max_by
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)
