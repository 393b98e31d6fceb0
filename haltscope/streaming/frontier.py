"""Merging a batch of observations into stored episodes.

A key (symbol, venue) is a sequence of episodes, and what a new observation can
change lies between the episode before it and the first one that starts behind
all that the batch says about the key:

* the episode that holds or precedes the earliest new start opened behind every
  end before it, so nothing earlier has a say in what follows;
* once a stored episode begins behind all new starts and ends, either the
  episode before it is closed, and it opens as before, or it is swallowed. It
  then brings its own end, and the one after it opens as before.

So the episodes from the one before the earliest start to the first one behind
the latest start or end are taken apart into their observations and merged anew
with the batch; all others stay. For a batch that only adds to the end of a key
that is the key's last episode alone, which is looked up in a table with one row
per key. Late rows look through the starts and ends of their keys' episodes.

Tables under ``root``: ``observations`` and ``episodes`` (versions by day of
start), ``tails/batch=<id>`` (the last episode of each key; two batches are kept),
``_steps`` (tables of the batch that is running).
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from haltscope.functions.clean import normalize_market, valid_end
from haltscope.operators.episodes import dedup_observations, episode_membership, episodes_of, observation_key, usable_observations
from haltscope.operators.scaling import best_row
from haltscope.sources import versions

KEY = ["symbol", "_venue"]
_TOUCHED = "symbol string, _venue string, episode_start timestamp_ntz, last_start timestamp_ntz"
_TAIL = "symbol string, _venue string, tail_start timestamp_ntz, tail_last timestamp_ntz"


def with_venue(rows: DataFrame) -> DataFrame:
    """Add the venue that keys episodes: the market under its usual name, or none."""
    return rows.withColumn("_venue", F.coalesce(normalize_market("market"), F.lit("")))


def _tails(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    found = [b for b in versions.batches(spark, f"{root}/tails") if b < batch_id]
    if not found:
        return versions.no_rows(spark, _TAIL)
    return spark.read.schema(_TAIL).parquet(f"{root}/tails/batch={found[-1]}")


def reach(rows: DataFrame) -> DataFrame:
    """Per key what the rows say: the first start, and the last start or valid end."""
    last = F.greatest(F.col("halt_start"), F.coalesce(valid_end("halt_start", "halt_end"), F.col("halt_start")))
    return rows.groupBy(*KEY).agg(F.min("halt_start").alias("lo"), F.max(last).alias("hi"))


def within_reach(hulls: DataFrame, spans: DataFrame) -> DataFrame:
    """(key, episode_start, last_start) of the stored episodes from the one before ``lo`` to the first one behind ``hi``."""
    near = spans.join(hulls, KEY)
    before, behind = F.col("episode_start") <= F.col("lo"), F.col("episode_start") > F.col("hi")
    ends = near.groupBy(*KEY).agg(F.max(F.when(before, F.col("episode_start"))).alias("_from"), F.min(F.when(behind, F.col("episode_start"))).alias("_to"))
    inside = (F.col("_from").isNull() | (F.col("episode_start") >= F.col("_from"))) & (F.col("_to").isNull() | (F.col("episode_start") <= F.col("_to")))
    return near.join(ends, KEY).filter(inside).select(*KEY, "episode_start", "last_start")


def _days_between(touched: DataFrame) -> list:
    """Calendar days that hold the observations of some episodes."""
    spans = touched.select(F.to_date("episode_start").alias("a"), F.to_date("last_start").alias("b")).distinct().collect()
    return sorted({r.a + timedelta(days=k) for r in spans for k in range((r.b - r.a).days + 1)})


def episode_store_batch(root: str, order_cols: list[str], unique: bool = False) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: merge a batch into the stored episodes of its keys.

    However observations are split over batches, the stored episodes are those of
    :func:`halt_episodes` over all of them, where ``order_cols`` say which copy
    of an observation is the last one. Observations without a start take no
    part. A batch that is run again finds the tables as it did the first time.
    ``unique`` says that batches are stored tables with one copy of each observation.
    Tables that a batch needs several times are written once (``_steps``) and
    removed at its end.
    """
    root = root.rstrip("/")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            fresh = with_venue(usable_observations(batch))
            if not unique:
                fresh = versions.write_step(dedup_observations(fresh, order_cols), root, batch_id, "fresh")
            _merge(spark, fresh, batch_id)
        finally:
            versions.forget_steps(spark, root, batch_id)

    def _reached(spark: SparkSession, fresh: DataFrame, known: DataFrame, tails: DataFrame, batch_id: int) -> DataFrame:
        """The stored episodes within reach of a batch."""
        # A later copy may name another venue, and then leaves the old one.
        key = observation_key(fresh)
        same = F.lit(True)
        for c in key:
            same = same & known[c].eqNullSafe(fresh[c])
        moved = known.join(fresh.select(*key, F.col("_venue").alias("_new")), same).filter(F.col("_venue") != F.col("_new"))
        moved = moved.select(*[known[c] for c in KEY], known["halt_start"], known["halt_end"])
        hulls = reach(fresh.select(*KEY, "halt_start", "halt_end").unionByName(moved))

        placed = versions.write_step(hulls.join(tails, KEY, "left"), root, batch_id, "placed")
        late = placed.filter(F.col("lo") < F.col("tail_start")).select(*hulls.columns)
        touched = placed.filter(F.col("lo") >= F.col("tail_start")).select(*KEY, F.col("tail_start").alias("episode_start"), F.col("tail_last").alias("last_start"))
        if not late.isEmpty():
            spans = versions.read_current(spark, f"{root}/episodes", batch_id).select(*KEY, F.col("halt_start").alias("episode_start"), "last_start")
            touched = touched.unionByName(within_reach(late, spans))
        return versions.write_step(touched, root, batch_id, "touched")

    def _merge(spark: SparkSession, fresh: DataFrame, batch_id: int) -> None:
        step = lambda rows, name: versions.write_step(rows, root, batch_id, name)
        obs_schema = StructType(versions.with_day(fresh).schema.fields).add("episode_start", "timestamp_ntz")
        own_days = versions.day_list(versions.with_day(fresh))
        if not own_days:
            return
        held = versions.current_days(spark, f"{root}/observations", batch_id)
        read_obs = lambda days: versions.read_current(spark, f"{root}/observations", batch_id, obs_schema, days)

        tails = _tails(spark, root, batch_id)
        if held:
            touched = _reached(spark, fresh, read_obs(own_days), tails, batch_id)
        else:
            touched = versions.no_rows(spark, _TOUCHED)

        days = _days_between(touched) if held else []
        stored = read_obs(set(days) | set(own_days))
        mine = stored.join(touched.select(*KEY, "episode_start"), [*KEY, "episode_start"], "left_semi").select(*fresh.columns)
        others = stored.join(touched.select(*KEY, "episode_start"), [*KEY, "episode_start"], "left_anti")
        together = fresh
        if held:
            together = step(dedup_observations(mine.unionByName(fresh), order_cols), "together")
        members = step(with_venue(episode_membership(together.drop("_venue"), keep=step)), "members")

        labelled = versions.with_day(members.drop("episode_market")).select(*others.columns)
        versions.write_batch(others.unionByName(labelled), f"{root}/observations", batch_id, {*days, *own_days} & {*held})

        made = step(versions.with_day(with_venue(episodes_of(members, order_cols))), "made")
        gone = versions.day_list(versions.with_day(touched, "episode_start"))
        kept = versions.read_current(spark, f"{root}/episodes", batch_id, made.schema, {*gone, *versions.day_list(made)})
        kept = kept.join(touched.select(*KEY, F.col("episode_start").alias("halt_start")), [*KEY, "halt_start"], "left_anti")
        versions.write_batch(kept.select(*made.columns).unionByName(made), f"{root}/episodes", batch_id, gone)

        rest = tails.join(touched.select(*KEY, F.col("episode_start").alias("tail_start")), [*KEY, "tail_start"], "left_anti")
        new = made.select(*KEY, F.col("halt_start").alias("tail_start"), F.col("last_start").alias("tail_last"))
        ends = best_row(rest.select(*new.columns).unionByName(new), KEY, F.col("tail_start"))
        ends.write.mode("overwrite").parquet(f"{root}/tails/batch={batch_id}")
        _forget_tails(spark, batch_id)

    def _forget_tails(spark: SparkSession, batch_id: int) -> None:
        for old in [b for b in versions.batches(spark, f"{root}/tails") if b <= batch_id][:-2]:
            where, fs = versions.files(spark, f"{root}/tails/batch={old}")
            fs.delete(where, True)

    return run


def read_episodes(spark: SparkSession, root: str) -> DataFrame:
    """The stored episodes, and which are open."""
    rows = versions.read_current(spark, f"{root.rstrip('/')}/episodes")
    return rows.drop("_venue", "last_start", "halt_day").withColumn("is_open", F.col("halt_end").isNull())
