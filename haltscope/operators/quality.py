"""Checks on stored tables. Each returns violations or counts, never modifies data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from haltscope.functions.clean import CLOSE_STATUSES, blank_to_null, normalize_market
from haltscope.functions.terms import TERM_KINDS


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("object_name"), "row_count")
        for name, df in sorted(tables.items())
    ]
    return reduce(DataFrame.unionByName, counts)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value of a column; NULL is a value."""
    return df.groupBy(F.col(column).alias("object_name")).agg(F.count(F.lit(1)).alias("row_count"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def duplicate_key_counts(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    parts = [
        duplicate_keys(df, keys)
        .agg(F.count(F.lit(1)).alias("duplicate_keys"))
        .select(F.lit(name).alias("object_name"), "duplicate_keys")
        for name, (df, keys) in sorted(tables.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent (a NULL key is an orphan)."""
    parents = parent.select(F.col(parent_key).alias("_parent")).distinct()
    return child.join(parents, child[child_key] == F.col("_parent"), "left_anti")


def orphan_counts(episodes: DataFrame, links: DataFrame, halts: DataFrame) -> DataFrame:
    checks = {
        "episode_without_halt": orphans(episodes, halts, "trade_halt_id", "id"),
        "link_without_episode": orphans(links, episodes, "episode_id", "episode_id"),
        "link_without_halt": orphans(links, halts, "trade_halt_id", "id"),
    }
    parts = [
        df.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("check_name"), "orphans")
        for name, df in checks.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def resumption_context_by_year(resumptions: DataFrame) -> DataFrame:
    """Per year of resumption: how many rows carry which reasons."""
    halt, res = F.col("reason_code").isNotNull(), F.col("resumption_reason_code").isNotNull()
    return resumptions.groupBy(F.year("resumption_date").alias("year")).agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(halt & ~res).alias("halt_context_only"),
        F.count_if(~halt & res).alias("resumption_context_only"),
        F.count_if(halt & res).alias("both_codes"),
        F.count_if(~halt & ~res).alias("no_code"),
    )


def reasonless_rows(resumptions: DataFrame) -> DataFrame:
    return resumptions.agg(
        F.count_if(F.col("reason_code").isNull() & F.col("resumption_reason_code").isNull()).alias("reasonless_rows")
    )


def bad_chronology(episodes: DataFrame) -> DataFrame:
    return episodes.agg(F.count_if(F.col("halt_end") < F.col("halt_start")).alias("bad_chronology"))


def _tagged(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per broken rule; a rule that evaluates to NULL is not broken."""
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return df.withColumn("violation", F.explode(broken))


def episode_domain_violations(episodes: DataFrame) -> DataFrame:
    c = F.col
    return _tagged(
        episodes,
        {
            "end_before_start": c("halt_end") < c("halt_start"),
            "negative_duration": c("duration_minutes") < 0,
            "unknown_status": ~c("halt_close_status").isin(*CLOSE_STATUSES),
        },
    )


def term_domain_violations(terms: DataFrame) -> DataFrame:
    return _tagged(
        terms,
        {
            "unknown_kind": ~F.col("kind").isin(*TERM_KINDS),
            "unknown_method": ~F.col("extraction_method").isin("regex", "llm"),
        },
    )


def split_domain_violations(splits: DataFrame) -> DataFrame:
    return _tagged(splits, {"ratio_not_positive": (F.col("ratio_new") <= 0) | (F.col("ratio_old") <= 0)})


def event_violations(obs: DataFrame) -> DataFrame:
    """Observations a canonical halt table must refuse, one row per missing part."""
    return _tagged(
        obs,
        {
            "no_symbol": blank_to_null("symbol").isNull(),
            "no_market": blank_to_null("market").isNull(),
            "no_reason": blank_to_null("reason_code").isNull(),
            "no_start": F.col("halt_start").isNull(),
            "no_source": blank_to_null("source_file").isNull(),
        },
    )


def not_session_days(df: DataFrame, day_col: str, calendar: DataFrame) -> DataFrame:
    """Rows whose day is not a session."""
    sessions = calendar.filter("is_session").select(F.col("cal_date").alias(day_col))
    return df.join(F.broadcast(sessions), day_col, "left_anti")


def future_days(df: DataFrame, day_col: str, today: Column) -> DataFrame:
    """Requested ingest days that are not in the past."""
    return df.filter(F.col(day_col) >= today)


def episodes_without_raw(episodes: DataFrame, halts: DataFrame) -> DataFrame:
    """Episodes with no raw row at their symbol, venue and start."""
    raw = halts.select("symbol", normalize_market("market").alias("market"), "halt_start").distinct()
    return episodes.join(raw, ["symbol", "market", "halt_start"], "left_anti")


def group_diagnostics(membership: DataFrame) -> DataFrame:
    """Per episode: raw rows, distinct venues and reasons, and a class for merged ones."""
    reason = F.coalesce("reason_code", F.lit("\u0000"))
    groups = membership.groupBy(
        "symbol", F.col("episode_market").alias("market"), F.col("episode_start").alias("halt_start")
    ).agg(
        F.count(F.lit(1)).alias("raw_count"),
        # Venue spellings and reason codes are short closed lists.
        F.size(F.collect_set("market")).alias("raw_markets"),
        F.size(F.collect_set(normalize_market("market"))).alias("norm_markets"),
        F.size(F.collect_set(reason)).alias("reasons"),
    )
    one_market, one_reason = F.col("norm_markets") == 1, F.col("reasons") == 1
    # The class names of the report.
    label = (
        F.when(F.col("raw_count") == 1, F.lit("ONE_TO_ONE"))
        .when(one_market & one_reason & (F.col("raw_markets") > 1), F.lit("MARKET_ALIAS_COLLAPSE"))
        .when(one_market & one_reason, F.lit("SAME_MARKET_SAME_REASON"))
        .when((F.col("norm_markets") > 1) & one_reason, F.lit("DIFFERENT_MARKET_SAME_REASON"))
        .when(one_market & (F.col("reasons") > 1), F.lit("SAME_MARKET_DIFFERENT_REASON"))
        .otherwise(F.lit("DIFFERENT_MARKET_DIFFERENT_REASON"))
    )
    return groups.withColumn("classification", label)


def group_diagnostics_summary(groups: DataFrame) -> DataFrame:
    return groups.groupBy("classification").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.max("raw_count").alias("max_raw_count"),
        F.sum("raw_count").alias("raw_rows"),
    )


def link_outcome(links: DataFrame, expected_episodes: DataFrame, raw: DataFrame) -> DataFrame:
    """One row: link totals and whether they cover the expected episodes and raw rows."""
    per_raw = links.groupBy("trade_halt_id").agg(F.count(F.lit(1)).alias("n"))
    per_episode = links.groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"))
    totals = links.agg(F.count(F.lit(1)).alias("link_count"))
    return totals.select(
        "link_count",
        expected_episodes.agg(F.count(F.lit(1))).scalar().alias("episode_count"),
        raw.agg(F.count(F.lit(1))).scalar().alias("raw_count"),
        per_raw.agg(F.count_if(F.col("n") > 1)).scalar().alias("raw_in_two_episodes"),
        per_episode.agg(F.count_if(F.col("n") > 1)).scalar().alias("multi_raw_episodes"),
    )


def expected_vs_returned(expected: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """Ids on one side only, tagged with the side they are missing from."""
    e, r = expected.select(key).distinct(), returned.select(key).distinct()
    missing = e.join(r, key, "left_anti").withColumn("missing_from", F.lit("returned"))
    extra = r.join(e, key, "left_anti").withColumn("missing_from", F.lit("expected"))
    return missing.unionByName(extra)


def fixture_counts(episodes: DataFrame, expected: DataFrame) -> DataFrame:
    """Pinned (symbol, trading_date, expected_count) against what the episodes give."""
    actual = episodes.groupBy("symbol", F.to_date("halt_start").alias("trading_date")).agg(
        F.count(F.lit(1)).alias("actual_count")
    )
    joined = expected.join(actual, ["symbol", "trading_date"], "left")
    count = F.coalesce("actual_count", F.lit(0))
    return joined.select(
        "symbol",
        "trading_date",
        "expected_count",
        count.alias("actual_count"),
        F.when(count == F.col("expected_count"), F.lit("PASS")).otherwise(F.lit("FAIL")).alias("status"),
    )
