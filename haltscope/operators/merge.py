"""Table merges: classify incoming rows against a stored table.

Parquet has no MERGE. Each function returns the rows to append, or the whole
new table version with an ``action`` per row; ``haltscope.sources.tables``
writes them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F

from haltscope.functions.clean import (
    blank_to_null,
    duration_minutes,
    is_changed,
    prefer_close_status,
    prefer_new,
)
from haltscope.operators.canonical import (
    HALT_KEY,
    RESUMPTION_BLOCK,
    RESUMPTION_KEY,
    latest_resumptions,
    resumption_moment,
)

RAW_BAR_KEY = ["ticker", "market", "bar_start", "source"]
CORE_BAR_KEY = ["ticker", "market", "bar_start"]
CORE_BAR_OPTIONAL = {
    "security_id": "string",
    "market_scope": "string",
    "session": "string",
    "transaction_count": "bigint",
    "source_provider": "string",
    "source_dataset": "string",
    "dataset_version": "string",
    "ingestion_run_id": "string",
}
FACT_KEY = ["cik", "concept", "unit", "accession_number", "period_start", "period_end"]
EXHIBIT_KEY = ["cik", "accession_number", "exhibit_seq"]
TERM_KEY = ["cik", "accession_number", "kind", "raw_snippet"]
SPLIT_KEY = ["cik", "accession_number", "raw_snippet"]
RESOLUTION_KEY = ["ticker", "retrieved_at"]
EPISODE_KEY = ["symbol", "market", "halt_start"]

INSERTED, UPDATED, UNCHANGED, STORED = "INSERTED", "UPDATED", "UNCHANGED", "STORED"
SKIPPED = "SKIPPED"


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality on keys with NULL = NULL; still a hash or sort-merge join key."""
    out = left[keys[0]].eqNullSafe(right[keys[0]])
    for k in keys[1:]:
        out = out & left[k].eqNullSafe(right[k])
    return out


def distinct_on(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, NULLs equal; copies combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    picked = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def new_rows(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key is not stored yet, one per key. Stored rows always win.

    One aggregate over both: incoming rows travel once, stored ones with their key alone.
    """
    rest = [c for c in incoming.columns if c not in keys]
    arrived = incoming.select(*keys, F.struct(F.lit(True), *rest).alias("_row"), F.lit(False).alias("_stored"))
    stored = existing.select(*keys, F.lit(None).cast(arrived.schema["_row"].dataType).alias("_row"), F.lit(True).alias("_stored"))
    picked = arrived.unionByName(stored).groupBy(*keys).agg(F.min("_row").alias("_row"), F.bool_or("_stored").alias("_known"))
    return picked.filter(~F.col("_known")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*incoming.columns)


def insert_outcome(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Each incoming key with INSERTED or SKIPPED."""
    fresh = distinct_on(incoming.select(*keys), keys)
    stored = existing.select(*keys).distinct().withColumn("_stored", F.lit(True))
    joined = fresh.join(stored, null_safe(fresh, stored, keys), "left")
    return joined.select(
        *[fresh[k] for k in keys],
        F.when(F.col("_stored"), F.lit(SKIPPED)).otherwise(F.lit(INSERTED)).alias("action"),
    )


def new_raw_bars(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return new_rows(existing, incoming, RAW_BAR_KEY)


def new_core_bars(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """First source wins; absent provenance columns become NULL."""
    for name, kind in CORE_BAR_OPTIONAL.items():
        if name not in incoming.columns:
            incoming = incoming.withColumn(name, F.lit(None).cast(kind))
    return new_rows(existing, incoming, CORE_BAR_KEY)


def directory_snapshot(listing: DataFrame, retrieved_at: Column) -> DataFrame:
    """A time-stamped snapshot, one row per (symbol, source_file)."""
    return distinct_on(listing, ["symbol", "source_file"]).withColumn("retrieved_at", retrieved_at)


# -- halts ------------------------------------------------------------------

def _prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in keep])


def lookup_existing(incoming: DataFrame, existing: DataFrame, id_col: str = "id") -> DataFrame:
    """Incoming natural keys with the stored id, NULL when new."""
    stored = existing.select(*HALT_KEY, F.col(id_col).alias("existing_id"))
    keys = incoming.select(*HALT_KEY).distinct()
    return keys.join(stored, null_safe(keys, stored, HALT_KEY), "left").select(
        *[keys[k] for k in HALT_KEY], "existing_id"
    )


def merge_halts(existing: DataFrame, canonical: DataFrame) -> DataFrame:
    """New version of the halt table with an ``action`` per row.

    A NULL never erases a stored value. The resumption block is cleared only
    when the canonical row says every observed end was invalid. The stored
    ``source_file`` stays.
    """
    values = ["issue_name", *RESUMPTION_BLOCK, "pause_threshold_price"]
    old = _prefixed(existing, "o_", [*HALT_KEY, *values, "source_file"]).withColumn("o_present", F.lit(True))
    new = _prefixed(canonical, "n_", [*HALT_KEY, *values, "source_file", "clear_resumption"]).withColumn(
        "n_present", F.lit(True)
    )
    same = F.col(f"o_{HALT_KEY[0]}").eqNullSafe(F.col(f"n_{HALT_KEY[0]}"))
    for k in HALT_KEY[1:]:
        same = same & F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}"))
    joined = old.join(new, same, "full_outer")
    has_old, has_new = F.col("o_present").isNotNull(), F.col("n_present").isNotNull()

    wanted = {}
    for c in values:
        value = prefer_new(f"o_{c}", f"n_{c}")
        if c in RESUMPTION_BLOCK:
            value = F.when(has_new & F.col("n_clear_resumption"), F.lit(None)).otherwise(value)
        wanted[c] = value
    changed = is_changed([(F.col(f"o_{c}"), wanted[c]) for c in values])
    action = (
        F.when(~has_old, F.lit(INSERTED))
        .when(~has_new, F.lit(STORED))
        .when(changed, F.lit(UPDATED))
        .otherwise(F.lit(UNCHANGED))
    )
    key = [F.when(has_old, F.col(f"o_{k}")).otherwise(F.col(f"n_{k}")).alias(k) for k in HALT_KEY]
    return joined.select(
        *key,
        *[v.alias(c) for c, v in wanted.items()],
        F.when(has_old, F.col("o_source_file")).otherwise(F.col("n_source_file")).alias("source_file"),
        action.alias("action"),
    )


def resumption_violations(incoming: DataFrame, resumption_feed: bool = False) -> DataFrame:
    """Resumption observations that break the contract, with the reason.

    ``resumption_feed`` adds the stricter rules of a batch that claims to come
    from the resumption feed.
    """
    c = F.col
    problem = F.when(c("halt_start").isNull(), F.lit("no halt start"))
    if resumption_feed:
        problem = problem.when(
            c("source_type").isNotNull() & (c("source_type") != "resumption"), F.lit("not a resumption feed row")
        ).when(blank_to_null("resumption_reason_code").isNull(), F.lit("no resumption reason"))
    has_date = c("resumption_date").isNotNull()
    problem = problem.when(
        has_date & (blank_to_null("symbol").isNull() | blank_to_null("market").isNull()),
        F.lit("incomplete identity"),
    ).when(
        has_date & blank_to_null("reason_code").isNull() & blank_to_null("resumption_reason_code").isNull(),
        F.lit("no reason context"),
    )
    return incoming.withColumn("violation", problem).filter(F.col("violation").isNotNull())


def new_resumptions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Observations with a resumption date not stored yet (nine-part key, NULL = NULL)."""
    return new_rows(existing, incoming.filter(F.col("resumption_date").isNotNull()), RESUMPTION_KEY)


def enrich_halts(halts: DataFrame, resumptions: DataFrame, id_col: str) -> DataFrame:
    """Halts with their latest valid resumption; ``raw_updated`` marks changed rows."""
    # No other column of the resumptions travels.
    wanted = dict.fromkeys(["symbol", "market", "halt_start", *RESUMPTION_BLOCK, id_col])
    best = latest_resumptions(resumptions.select(*wanted), id_col).select(
        "symbol", "market", "halt_start", *[F.col(c).alias(f"n_{c}") for c in RESUMPTION_BLOCK],
        F.lit(True).alias("_hit"),
    )
    joined = halts.join(best, ["symbol", "market", "halt_start"], "left")
    hit = F.col("_hit").isNotNull()
    changed = hit & is_changed([(F.col(c), F.col(f"n_{c}")) for c in RESUMPTION_BLOCK])
    return joined.select(
        *[
            (F.when(hit, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) if c in RESUMPTION_BLOCK else F.col(c))
            for c in halts.columns
        ],
        changed.alias("raw_updated"),
    )


# -- episodes ----------------------------------------------------------------

def new_episodes_only(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming episodes with no stored key. A NULL market never equals a stored one."""
    return incoming.join(existing.select(*EPISODE_KEY), EPISODE_KEY, "left_anti")


EPISODE_VALUES = ["issue_name", "reason_code", "halt_end", "duration_minutes", "halt_close_status"]


def merge_episodes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New version of the episode table with an ``action`` per row.

    A NULL market never equals a stored one, so such a row is inserted again
    whenever it comes again. Live polls do not go this way: ``streaming.frontier``
    keeps episodes without a market once.
    """
    old = _prefixed(existing, "o_", [*EPISODE_KEY, *EPISODE_VALUES])
    new = _prefixed(incoming, "n_", [*EPISODE_KEY, *EPISODE_VALUES])
    same = F.lit(True)
    for k in EPISODE_KEY:
        same = same & (F.col(f"o_{k}") == F.col(f"n_{k}"))
    joined = old.withColumn("o_present", F.lit(True)).join(
        new.withColumn("n_present", F.lit(True)), same, "full_outer"
    )
    has_old, has_new = F.col("o_present").isNotNull(), F.col("n_present").isNotNull()
    wanted = {c: prefer_new(f"o_{c}", f"n_{c}") for c in EPISODE_VALUES}
    wanted["halt_close_status"] = F.when(
        has_old & has_new, prefer_close_status("o_halt_close_status", "n_halt_close_status")
    ).otherwise(wanted["halt_close_status"])
    changed = is_changed([(F.col(f"o_{c}"), v) for c, v in wanted.items()])
    action = (
        F.when(~has_old, F.lit(INSERTED))
        .when(~has_new, F.lit(STORED))
        .when(changed, F.lit(UPDATED))
        .otherwise(F.lit(UNCHANGED))
    )
    key = [F.when(has_old, F.col(f"o_{k}")).otherwise(F.col(f"n_{k}")).alias(k) for k in EPISODE_KEY]
    return joined.select(*key, *[v.alias(c) for c, v in wanted.items()], action.alias("action"))


def sync_links(links: DataFrame, desired: DataFrame, staged: DataFrame) -> DataFrame:
    """Links with an ``action``: DELETED, INSERTED or KEPT.

    Only links of staged episodes may be deleted. All three tables carry
    ``episode_id``; the first two also ``trade_halt_id``.
    """
    pair = ["episode_id", "trade_halt_id"]
    have = links.select(*pair).distinct().withColumn("_have", F.lit(True))
    want = desired.select(*pair).distinct().withColumn("_want", F.lit(True))
    mine = staged.select("episode_id").distinct().withColumn("_staged", F.lit(True))
    both = have.join(want, pair, "full_outer").join(mine, "episode_id", "left")
    action = (
        F.when(F.col("_have").isNull(), F.lit(INSERTED))
        .when(F.col("_want").isNull() & F.col("_staged").isNotNull(), F.lit("DELETED"))
        .otherwise(F.lit("KEPT"))
    )
    return both.select(*pair, action.alias("action"))


def seed_links(episodes: DataFrame) -> DataFrame:
    """First link table: each episode's own raw id."""
    return (
        episodes.filter(F.col("trade_halt_id").isNotNull())
        .select("episode_id", "trade_halt_id")
        .distinct()
    )


def episode_link_raw(episodes: DataFrame, links: DataFrame, halts: DataFrame) -> DataFrame:
    """Episode rows with each raw row linked to them."""
    raw = halts.select(F.col("id").alias("trade_halt_id"), *RESUMPTION_BLOCK, F.col("reason_code").alias("raw_reason"))
    return episodes.join(links, "episode_id").join(raw, "trade_halt_id")


def latest_valid_ends(episodes: DataFrame, links: DataFrame, halts: DataFrame) -> DataFrame:
    """Per episode the latest resumption moment of its raw rows, if not before its start."""
    raw = halts.select(F.col("id").alias("trade_halt_id"), resumption_moment().alias("_moment")).filter(
        F.col("_moment").isNotNull()
    )
    latest = links.join(raw, "trade_halt_id").groupBy("episode_id").agg(F.max("_moment").alias("halt_end_new"))
    return episodes.join(latest, "episode_id").filter(F.col("halt_end_new") >= F.col("halt_start"))


def enrich_episodes(episodes: DataFrame, links: DataFrame, halts: DataFrame) -> DataFrame:
    """Episodes closed or extended by their raw rows; ``core_updated`` marks changed rows.

    The close status only ever turns into MULTI_DAY here.
    """
    ends = latest_valid_ends(episodes, links, halts).select("episode_id", "halt_end_new")
    joined = episodes.join(ends, "episode_id", "left")
    end = F.col("halt_end_new")
    multi = F.to_date(end) > F.to_date("halt_start")
    update = end.isNotNull() & (
        F.col("halt_end").isNull()
        | (end > F.col("halt_end"))
        | F.col("duration_minutes").isNull()
        | (multi & ~F.col("halt_close_status").eqNullSafe(F.lit("MULTI_DAY")))
    )
    update = F.coalesce(update, F.lit(False))
    new = {
        "halt_end": end,
        "duration_minutes": duration_minutes("halt_start", "halt_end_new"),
        "halt_close_status": F.when(multi, F.lit("MULTI_DAY")).otherwise(F.col("halt_close_status")),
    }
    return joined.select(
        *[
            (F.when(update, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c))
            for c in episodes.columns
        ],
        update.alias("core_updated"),
    )


def outcome_counts(merged: DataFrame) -> DataFrame:
    """Rows per action of a merge."""
    return merged.groupBy("action").agg(F.count(F.lit(1)).alias("row_count"))


def write_counted(merged: DataFrame, write: Callable[[DataFrame], None]) -> DataFrame:
    """Write a merge and count its actions in the pass that writes it.

    ``write`` gets the rows with their ``action`` and runs one job on them; the
    merge is not run again for the counts. Returns action and row_count of the
    actions that occur; fails if a row has another action than the five.
    """
    actions = (INSERTED, UPDATED, UNCHANGED, STORED, SKIPPED)
    seen = Observation()
    write(merged.observe(
        seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("action") == a).alias(a) for a in actions]))
    # Where Spark finds that there are no rows it drops the counters too; ``get`` fails then.
    found = dict(seen._jo.getAsJava()) or dict.fromkeys(("rows", *actions), 0)
    if found["rows"] != sum(found[a] for a in actions):
        raise ValueError("a merged row without a known action")
    return merged.sparkSession.createDataFrame(
        [(a, found[a]) for a in actions if found[a]], "action string, row_count long")
