"""Ticker -> issuer id, by map first and by unique company name as a fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from haltscope.functions.clean import issuer_id_pad
from haltscope.functions.text import normalize_company_name
from haltscope.operators.scaling import best_row, spread_join


def ticker_map_from_records(records: DataFrame, order_cols: list[str]) -> DataFrame:
    """(ticker, cik_str) records -> upper ticker and ten-digit id; the last record wins."""
    shaped = records.select(
        F.upper("ticker").alias("ticker"), issuer_id_pad("cik_str").alias("cik"), *order_cols
    )
    return best_row(shaped, ["ticker"], F.struct(*order_cols)).select("ticker", "cik")


def build_ticker_map(docs: DataFrame, json_col: str = "json", order_cols: Sequence[str] = ()) -> DataFrame:
    """Id-keyed JSON documents {"0": {"cik_str", "ticker", "title"}, ...} -> ticker map.

    The last record of a ticker wins: by ``order_cols`` of its document, then by place in it.
    """
    parsed = F.from_json(json_col, "map<string, struct<cik_str: string, ticker: string, title: string>>")
    records = docs.select(*order_cols, F.posexplode(F.map_entries(parsed)).alias("pos", "entry")).select(
        *order_cols, "pos", F.col("entry.value.ticker").alias("ticker"), F.col("entry.value.cik_str").alias("cik_str")
    )
    return ticker_map_from_records(records, [*order_cols, "pos"])


def issuer_names(tickers: DataFrame, episodes: DataFrame) -> DataFrame:
    """Newest known issue name per listed ticker."""
    named = episodes.filter(F.col("issue_name").isNotNull()).select(
        F.upper("symbol").alias("ticker"), "issue_name", "halt_start"
    )
    wanted = tickers.select(F.upper("ticker").alias("ticker")).distinct()
    return (
        named.groupBy("ticker")
        .agg(F.max_by("issue_name", F.struct("halt_start", "issue_name")).alias("issue_name"))
        .join(wanted, "ticker", "left_semi")
    )


def _proper_prefixes(name: Column) -> Column:
    """Every word prefix of a normalised name except the name itself."""
    words = F.split(name, " ")
    n = F.size(words)
    return F.when(
        n > 1,
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(words, F.lit(1), i), " ")),
    )


def unique_name_matches(targets: DataFrame, companies: DataFrame) -> DataFrame:
    """(issuer_name, cik, matched_name) where exactly one company matches.

    Level 1 is equality of normalised names; an ambiguous level 1 ends there.
    Level 2 is "one is a word prefix of the other". Counts and one sample are
    kept per name and per prefix, so no list of pairs is ever built: the prefix
    "global" costs one row, not one per pair of companies.
    """
    comp = companies.select("name", "cik").distinct().withColumn("_n", normalize_company_name("name"))
    sample = F.min(F.struct("cik", "name"))
    full = comp.groupBy("_n").agg(F.count(F.lit(1)).alias("_c"), sample.alias("_s"))
    longer = (
        comp.select("cik", "name", F.explode(_proper_prefixes(F.col("_n"))).alias("_n"))
        .groupBy("_n")
        .agg(F.count(F.lit(1)).alias("_lc"), sample.alias("_ls"))
    )
    names = targets.select("issuer_name").distinct().withColumn("_n", normalize_company_name("issuer_name"))
    prefixes = names.select("issuer_name", F.explode(_proper_prefixes(F.col("_n"))).alias("_n"))
    # Only companies whose whole name is some target's prefix go further.
    hits = full.join(prefixes.select("_n").distinct(), "_n", "left_semi")
    shorter = (
        spread_join(prefixes, hits, ["_n"], ["issuer_name"])
        .groupBy("issuer_name")
        .agg(F.sum("_c").alias("_sc"), F.min("_s").alias("_ss"))
    )
    zero = F.lit(0)
    joined = names.join(full, "_n", "left").join(longer, "_n", "left").join(shorter, "issuer_name", "left")
    exact = F.coalesce("_c", zero)
    loose = F.coalesce("_lc", zero) + F.coalesce("_sc", zero)
    hit = F.when(exact == 1, F.col("_s")).when((exact == 0) & (loose == 1), F.coalesce("_ls", "_ss"))
    level = F.when(exact == 1, F.lit("exact")).otherwise(F.lit("prefix"))
    return joined.withColumn("_hit", hit).filter(F.col("_hit").isNotNull()).select(
        "issuer_name", F.col("_hit.cik").alias("cik"), F.col("_hit.name").alias("company_name"), level.alias("level")
    )


def resolve_issuers(
    tickers: DataFrame, ticker_map: DataFrame, names: DataFrame, companies: DataFrame
) -> DataFrame:
    """Each ticker with its id, the method that found it and the name used.

    ``names`` is (ticker, issue_name), ``companies`` (name, cik).
    """
    base = (
        tickers.select("ticker", F.upper("ticker").alias("_t"))
        .join(ticker_map.select(F.col("ticker").alias("_t"), F.col("cik").alias("_mapped")), "_t", "left")
        .join(names.select(F.upper("ticker").alias("_t"), F.col("issue_name").alias("issuer_name_used")), "_t", "left")
    )
    # Tickers that need no name search get a key of their own, so that they do
    # not pile up on one missing name.
    needs_name = F.col("_mapped").isNull() & (F.col("issuer_name_used") != "")
    base = base.withColumn(
        "_key", F.when(needs_name, F.col("issuer_name_used")).otherwise(F.concat(F.lit("\x00"), "_t"))
    )
    open_names = base.filter(needs_name).select(F.col("issuer_name_used").alias("issuer_name"))
    found = unique_name_matches(open_names, companies).select(
        F.col("issuer_name").alias("_key"), F.col("cik").alias("_by_name")
    )
    joined = base.join(found, "_key", "left")
    by_map, by_name = F.col("_mapped").isNotNull(), F.col("_by_name").isNotNull()
    return joined.select(
        "ticker",
        F.coalesce("_mapped", "_by_name").alias("cik"),
        F.when(by_map, F.lit("ticker_map"))
        .when(by_name, F.lit("name_search"))
        .otherwise(F.lit("not_found"))
        .alias("resolution_method"),
        "issuer_name_used",
        F.when(~by_map & by_name, F.col("issuer_name_used")).alias("matched_name"),
    )


def resolved_map(resolution: DataFrame, ticker_map: DataFrame) -> DataFrame:
    """Ticker map extended by the tickers a resolution run found."""
    found = resolution.filter(F.col("cik").isNotNull()).select(F.upper("ticker").alias("ticker"), "cik").distinct()
    fresh = found.join(ticker_map.select("ticker"), "ticker", "left_anti")
    return ticker_map.select("ticker", "cik").unionByName(fresh)
