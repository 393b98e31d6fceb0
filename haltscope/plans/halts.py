"""Halt queries: observations, episodes, canonical rows, merges, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from haltscope.functions import clean as C
from haltscope.operators import canonical as K
from haltscope.operators import episodes as E
from haltscope.operators import halt_days as D
from haltscope.operators import merge as M
from haltscope.operators import metrics as X
from haltscope.operators import quality as Q
from haltscope.plans.derive import Inputs
from haltscope.plans.registry import joined, query, r6
from haltscope.session import work_dir
from haltscope.sources import feeds, tables

EPISODE_OUT = ["symbol", "market", "halt_start", "halt_end", "issue_name", "reason_code",
               "pause_threshold_price", "duration_minutes", "halt_close_status",
               "observation_count", "invalid_end_count"]
EPISODE_SQL = ", ".join(EPISODE_OUT)


# -- observations and episodes -------------------------------------------------

@query("dedup_observations", """
SELECT obs_id, symbol, halt_start, resumption_date, resumption_trade_time, reason_code, issue_name, market FROM unique_obs""")
def _(i: Inputs) -> DataFrame:
    return i.unique_obs.select("obs_id", *E.OBSERVATION_KEY, "issue_name", "market")


@query("halt_episodes", f"SELECT {EPISODE_SQL}, array_to_string(reason_codes, '|') AS reason_codes FROM episodes")
def _(i: Inputs) -> DataFrame:
    return i.episodes.select(*EPISODE_OUT, joined("reason_codes"))


@query("episode_stats", """
SELECT count(*) AS episode_count, count(duration_minutes) AS duration_count,
       count(*) FILTER (WHERE halt_close_status = 'YES') AS close_yes,
       count(*) FILTER (WHERE halt_close_status = 'NO') AS close_no,
       count(*) FILTER (WHERE halt_close_status = 'UNKNOWN') AS close_unknown,
       count(*) FILTER (WHERE halt_close_status = 'MULTI_DAY') AS close_multi_day,
       CAST(sum(invalid_end_count) AS BIGINT) AS invalid_end_count,
       count(*) FILTER (WHERE len(reason_codes) > 1) AS multi_reason_count
FROM episodes""")
def _(i: Inputs) -> DataFrame:
    return E.episode_stats(i.episodes)


@query("episode_ids", """
SELECT printf('H%08d', row_number() OVER (ORDER BY halt_start, symbol, market NULLS FIRST)) AS episode_id,
       symbol, market, halt_start FROM episodes""")
def _(i: Inputs) -> DataFrame:
    return E.with_episode_ids(i.episodes).select("episode_id", "symbol", "market", "halt_start")


@query("episode_raw_groups", """
SELECT obs_id, symbol, nm AS episode_market, halt_start, episode_start FROM membership""")
def _(i: Inputs) -> DataFrame:
    return E.episode_membership(i.unique_obs).select("obs_id", "symbol", "episode_market", "halt_start", "episode_start")


@query("episode_links", """
SELECT DISTINCT symbol, nm AS market, episode_start AS halt_start, obs_id AS trade_halt_id FROM membership""")
def _(i: Inputs) -> DataFrame:
    return i.links_by_key


_RAW_SUMMARY = """
SELECT symbol, nm AS market, episode_start AS halt_start,
       CASE WHEN count(DISTINCT issue_name) = 1 THEN max(issue_name) END AS single_issue_name,
       CASE WHEN count(DISTINCT nm) = 1 THEN max(nm) END AS single_market,
       CASE WHEN count(DISTINCT reason_code) = 1 THEN max(reason_code) END AS single_reason_code,
       coalesce(array_to_string(list_sort(list(DISTINCT reason_code) FILTER (WHERE reason_code IS NOT NULL)), '|'), '') AS reason_codes,
       count(*) AS raw_count
FROM membership GROUP BY symbol, nm, episode_start"""


@query("single_or_null_name", _RAW_SUMMARY)
def _(i: Inputs) -> DataFrame:
    summary = E.episode_raw_summary(E.episode_membership(i.unique_obs))
    return summary.withColumn("reason_codes", joined("reason_codes"))


@query("episode_reason_set", """
SELECT symbol, market, halt_start, reason_code, array_to_string(reason_codes, '|') AS reason_codes,
       len(reason_codes) AS reason_count FROM episodes""")
def _(i: Inputs) -> DataFrame:
    return i.episodes.select("symbol", "market", "halt_start", "reason_code", joined("reason_codes"),
                             F.size("reason_codes").cast("bigint").alias("reason_count"))


@query("reason_codes_array", """
SELECT symbol, array_to_string(list_sort(list(DISTINCT reason_code) FILTER (WHERE reason_code IS NOT NULL)), '|') AS reason_codes
FROM halt_obs GROUP BY symbol""")
def _(i: Inputs) -> DataFrame:
    return i.halt_obs.groupBy("symbol").agg(
        F.array_join(F.array_sort(F.collect_set("reason_code")), "|").alias("reason_codes")
    )


@query("valid_end", """
SELECT obs_id, CASE WHEN halt_end >= halt_start THEN halt_end END AS valid_end,
       coalesce(halt_end < halt_start, false) AS is_invalid FROM halt_obs""")
def _(i: Inputs) -> DataFrame:
    return i.halt_obs.select("obs_id", C.valid_end("halt_start", "halt_end").alias("valid_end"),
                             F.coalesce(F.col("halt_end") < F.col("halt_start"), F.lit(False)).alias("is_invalid"))


@query("event_order", """
SELECT obs_id, symbol, market, halt_start, CASE WHEN halt_end >= halt_start THEN halt_end ELSE halt_start END AS sort_end
FROM halt_obs ORDER BY symbol, market, halt_start, sort_end, obs_id""")
def _(i: Inputs) -> DataFrame:
    return E.in_event_order(i.halt_obs, ["obs_id"]).select("obs_id", "symbol", "market", "halt_start", "sort_end")


# -- canonical rows ---------------------------------------------------------------

HALT_OUT = [*K.HALT_KEY, "issue_name", *K.RESUMPTION_BLOCK, "pause_threshold_price", "source_file"]
HALT_SQL = ", ".join(HALT_OUT)


@query("canonical_halt_row", f"SELECT {HALT_SQL}, clear_resumption FROM all_canonical")
def _(i: Inputs) -> DataFrame:
    return K.canonical_halts(i.halt_obs, ["obs_id"]).select(*HALT_OUT, "clear_resumption")


@query("resumption_rank", """
SELECT obs_id, CASE WHEN halt_end >= halt_start THEN 2
       WHEN halt_end IS NULL AND (resumption_date IS NOT NULL OR resumption_quote_time IS NOT NULL
                                  OR resumption_trade_time IS NOT NULL) THEN 1 ELSE 0 END AS resumption_rank
FROM halt_obs""")
def _(i: Inputs) -> DataFrame:
    rank = C.resumption_rank("halt_start", "halt_end", *K.RESUMPTION_BLOCK)
    return i.halt_obs.select("obs_id", rank["rank"].alias("resumption_rank"))


@query("distinct_on_best", """
SELECT symbol, market, halt_start, reason_code, obs_id, issue_name, pause_threshold_price FROM halt_obs
QUALIFY row_number() OVER (PARTITION BY symbol, market, halt_start, reason_code
        ORDER BY (issue_name IS NOT NULL) DESC, (pause_threshold_price IS NOT NULL) DESC, obs_id) = 1""")
def _(i: Inputs) -> DataFrame:
    return K.first_best_halts(i.halt_obs, ["obs_id"]).select(
        *K.HALT_KEY, "obs_id", "issue_name", "pause_threshold_price")


@query("bool_pref_sort", """
SELECT symbol, nm AS market, halt_start, obs_id, halt_end FROM (
  SELECT *, CASE market WHEN 'Q' THEN 'NASDAQ' WHEN 'N' THEN 'NYSE' WHEN 'A' THEN 'AMEX' ELSE market END AS nm FROM halt_obs)
QUALIFY row_number() OVER (PARTITION BY symbol, nm, halt_start
        ORDER BY (halt_end IS NOT NULL) DESC, halt_end DESC NULLS LAST, obs_id NULLS LAST) = 1""")
def _(i: Inputs) -> DataFrame:
    staged = i.halt_obs.withColumn("market", C.normalize_market("market"))
    return K.first_best_episodes(staged, "obs_id").select("symbol", "market", "halt_start", "obs_id", "halt_end")


@query("canonical_resumption_latest", """
SELECT symbol, market, halt_start, id, moment AS halt_end FROM resumption_moments WHERE moment >= halt_start
QUALIFY row_number() OVER (PARTITION BY symbol, market, halt_start ORDER BY moment DESC, id DESC) = 1""")
def _(i: Inputs) -> DataFrame:
    return K.latest_resumptions(i.resumptions, "id").select("symbol", "market", "halt_start", "id", "halt_end")


_KEEP = """
SELECT id, first_value(id) OVER w AS keep_id, row_number() OVER w AS rn FROM all_halt_rows
WINDOW w AS (PARTITION BY symbol, market, halt_start, reason_code
             ORDER BY (resumption_date IS NOT NULL) DESC, (resumption_trade_time IS NOT NULL) DESC,
                      (resumption_quote_time IS NOT NULL) DESC, id)"""


@query("keep_id_map", f"SELECT id AS duplicate_id, keep_id FROM ({_KEEP}) WHERE rn > 1")
def _(i: Inputs) -> DataFrame:
    return K.keep_id_map(i.all_halt_rows, "id")


@query("repointed_links", f"""
SELECT DISTINCT l.episode_id, coalesce(m.keep_id, l.trade_halt_id) AS trade_halt_id
FROM links l LEFT JOIN (SELECT id, keep_id FROM ({_KEEP}) WHERE rn > 1) m ON m.id = l.trade_halt_id""")
def _(i: Inputs) -> DataFrame:
    return K.repoint_links(i.links, K.keep_id_map(i.all_halt_rows, "id"))


@query("dedup_resumptions_by_key", """
SELECT min(id) AS id, symbol, market, halt_start, reason_code, resumption_reason_code, resumption_date,
       resumption_quote_time, resumption_trade_time
FROM resumptions GROUP BY ALL""")
def _(i: Inputs) -> DataFrame:
    return K.dedup_resumptions(i.resumptions, "id").select("id", *K.RESUMPTION_KEY)


@query("rebuild_events_from_raw", """
SELECT symbol, market, halt_start, reason_code,
       CAST(CAST(resumption_date AS VARCHAR) || ' ' || coalesce(resumption_trade_time, resumption_quote_time) AS TIMESTAMP) AS halt_end
FROM all_canonical""")
def _(i: Inputs) -> DataFrame:
    return K.raw_events(K.canonical_halts(i.halt_obs, ["obs_id"])).select(*K.HALT_KEY, "halt_end")


@query("exact_source_event", """
SELECT e.symbol, e.market, e.reason_code, e.halt_start, e.halt_end, count(o.obs_id) AS source_events
FROM episodes e LEFT JOIN unique_obs o ON o.symbol = e.symbol AND o.market IS NOT DISTINCT FROM e.market
 AND o.reason_code IS NOT DISTINCT FROM e.reason_code AND o.halt_start = e.halt_start
 AND o.halt_end IS NOT DISTINCT FROM e.halt_end
GROUP BY ALL""")
def _(i: Inputs) -> DataFrame:
    return K.exact_source_event(i.episodes, i.unique_obs)


@query("representative_raw", """
SELECT e.symbol, e.market, e.halt_start, e.reason_code, first(h.id ORDER BY (h.reason_code IS NOT DISTINCT FROM e.reason_code
       AND h.reason_code IS NOT NULL) DESC, h.id) AS trade_halt_id
FROM episodes e LEFT JOIN all_halt_rows h ON h.symbol = e.symbol AND h.halt_start = e.halt_start
 AND CASE h.market WHEN 'Q' THEN 'NASDAQ' WHEN 'N' THEN 'NYSE' WHEN 'A' THEN 'AMEX' ELSE h.market END = e.market
GROUP BY 1, 2, 3, 4""")
def _(i: Inputs) -> DataFrame:
    return K.representative_raw(i.episodes, i.all_halt_rows, "id").select(
        "symbol", "market", "halt_start", "reason_code", "trade_halt_id")


@query("alias_market_join", """
SELECT DISTINCT e.symbol, e.market, e.halt_start, h.id AS trade_halt_id
FROM episodes e JOIN all_halt_rows h ON h.symbol = e.symbol AND h.halt_start = e.halt_start
 AND h.market = CASE e.market WHEN 'NASDAQ' THEN 'Q' WHEN 'NYSE' THEN 'N' WHEN 'AMEX' THEN 'A' ELSE e.market END""")
def _(i: Inputs) -> DataFrame:
    ep = i.episodes.select("symbol", "market", "halt_start", C.raw_market_code("market").alias("_raw"))
    raw = i.all_halt_rows.select("symbol", F.col("market").alias("_raw"), "halt_start", F.col("id").alias("trade_halt_id"))
    return ep.join(raw, ["symbol", "_raw", "halt_start"]).drop("_raw").distinct()


# -- merges ---------------------------------------------------------------------

_MERGED = """
SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.market, n.market) AS market,
       coalesce(o.halt_start, n.halt_start) AS halt_start,
       CASE WHEN o.symbol IS NOT NULL THEN o.reason_code ELSE n.reason_code END AS reason_code,
       coalesce(n.issue_name, o.issue_name) AS issue_name,
       CASE WHEN n.clear_resumption THEN NULL ELSE coalesce(n.resumption_date, o.resumption_date) END AS resumption_date,
       CASE WHEN n.clear_resumption THEN NULL ELSE coalesce(n.resumption_quote_time, o.resumption_quote_time) END AS resumption_quote_time,
       CASE WHEN n.clear_resumption THEN NULL ELSE coalesce(n.resumption_trade_time, o.resumption_trade_time) END AS resumption_trade_time,
       coalesce(n.pause_threshold_price, o.pause_threshold_price) AS pause_threshold_price,
       CASE WHEN o.symbol IS NOT NULL THEN o.source_file ELSE n.source_file END AS source_file,
       o.symbol IS NOT NULL AS has_old, n.symbol IS NOT NULL AS has_new,
       o.issue_name AS o1, o.resumption_date AS o2, o.resumption_quote_time AS o3, o.resumption_trade_time AS o4,
       o.pause_threshold_price AS o5
FROM stored_canonical o FULL OUTER JOIN incoming_canonical n ON o.symbol = n.symbol AND o.market = n.market
 AND o.halt_start = n.halt_start AND o.reason_code IS NOT DISTINCT FROM n.reason_code"""
_MERGED_ACTION = f"""
SELECT {HALT_SQL}, CASE WHEN NOT has_old THEN 'INSERTED' WHEN NOT has_new THEN 'STORED'
  WHEN issue_name IS DISTINCT FROM o1 OR resumption_date IS DISTINCT FROM o2 OR resumption_quote_time IS DISTINCT FROM o3
    OR resumption_trade_time IS DISTINCT FROM o4 OR pause_threshold_price IS DISTINCT FROM o5 THEN 'UPDATED'
  ELSE 'UNCHANGED' END AS action FROM ({_MERGED})"""


@query("upsert_trade_halts", _MERGED_ACTION)
def _(i: Inputs) -> DataFrame:
    return M.merge_halts(i.stored_halts, i.incoming_halts).select(*HALT_OUT, "action")


@query("load_outcome_counts", f"SELECT action, count(*) AS row_count FROM ({_MERGED_ACTION}) GROUP BY action")
def _(i: Inputs) -> DataFrame:
    table = work_dir(i.spark, "loaded-halts")
    return M.write_counted(M.merge_halts(i.stored_halts, i.incoming_halts), lambda rows: tables.write_version(rows.drop("action"), table))


@query("lookup_existing_halts", """
SELECT n.symbol, n.market, n.halt_start, n.reason_code, o.id AS existing_id
FROM (SELECT DISTINCT symbol, market, halt_start, reason_code FROM incoming_canonical) n
LEFT JOIN (SELECT * FROM halt_rows WHERE hour(halt_start) < 16) o ON o.symbol = n.symbol AND o.market = n.market
 AND o.halt_start = n.halt_start AND o.reason_code IS NOT DISTINCT FROM n.reason_code""")
def _(i: Inputs) -> DataFrame:
    return M.lookup_existing(i.incoming_halts, i.halt_rows.filter(F.hour("halt_start") < 16))


_RES_KEY = ("symbol, market, halt_start, reason_code, resumption_reason_code, resumption_date, "
            "resumption_quote_time, resumption_trade_time")


@query("insert_resumptions", f"""
SELECT {_RES_KEY}, min(source_file) AS source_file FROM resumptions n
WHERE hour(halt_start) >= 8 AND NOT EXISTS (
  SELECT 1 FROM resumptions o WHERE hour(o.halt_start) < 16 AND o.symbol = n.symbol AND o.market = n.market
   AND o.halt_start = n.halt_start AND o.reason_code IS NOT DISTINCT FROM n.reason_code
   AND o.resumption_reason_code IS NOT DISTINCT FROM n.resumption_reason_code AND o.resumption_date = n.resumption_date
   AND o.resumption_quote_time IS NOT DISTINCT FROM n.resumption_quote_time
   AND o.resumption_trade_time IS NOT DISTINCT FROM n.resumption_trade_time)
GROUP BY {_RES_KEY}""")
def _(i: Inputs) -> DataFrame:
    rows = i.resumptions.select(*K.RESUMPTION_KEY, "source_file")
    return M.new_resumptions(rows.filter(F.hour("halt_start") < 16), rows.filter(F.hour("halt_start") >= 8))


@query("null_safe_key_match", f"""
SELECT count(*) AS matched FROM (SELECT DISTINCT {_RES_KEY} FROM resumptions) a
JOIN (SELECT DISTINCT {_RES_KEY} FROM resumptions WHERE hour(halt_start) < 16) b
 ON a.symbol = b.symbol AND a.market = b.market AND a.halt_start = b.halt_start
 AND a.reason_code IS NOT DISTINCT FROM b.reason_code
 AND a.resumption_reason_code IS NOT DISTINCT FROM b.resumption_reason_code AND a.resumption_date = b.resumption_date
 AND a.resumption_quote_time IS NOT DISTINCT FROM b.resumption_quote_time
 AND a.resumption_trade_time IS NOT DISTINCT FROM b.resumption_trade_time""")
def _(i: Inputs) -> DataFrame:
    rows = i.resumptions.select(*K.RESUMPTION_KEY).distinct()
    early = i.resumptions.filter(F.hour("halt_start") < 16).select(*K.RESUMPTION_KEY).distinct()
    return rows.join(early, M.null_safe(rows, early, K.RESUMPTION_KEY)).agg(F.count(F.lit(1)).alias("matched"))


@query("resumption_contract", """
SELECT id, CASE WHEN source_type <> 'resumption' THEN 'not a resumption feed row'
                WHEN resumption_reason_code IS NULL THEN 'no resumption reason' END AS violation
FROM resumptions WHERE source_type <> 'resumption' OR resumption_reason_code IS NULL""")
def _(i: Inputs) -> DataFrame:
    return M.resumption_violations(i.resumptions, resumption_feed=True).select("id", "violation")


_ENRICHED = """
SELECT h.id, CASE WHEN b.id IS NOT NULL THEN b.resumption_date ELSE h.resumption_date END AS resumption_date,
       CASE WHEN b.id IS NOT NULL THEN b.resumption_quote_time ELSE h.resumption_quote_time END AS resumption_quote_time,
       CASE WHEN b.id IS NOT NULL THEN b.resumption_trade_time ELSE h.resumption_trade_time END AS resumption_trade_time,
       b.id IS NOT NULL AND (h.resumption_date IS DISTINCT FROM b.resumption_date
         OR h.resumption_quote_time IS DISTINCT FROM b.resumption_quote_time
         OR h.resumption_trade_time IS DISTINCT FROM b.resumption_trade_time) AS raw_updated
FROM all_halt_rows h LEFT JOIN (
  SELECT * FROM resumption_moments WHERE moment >= halt_start
  QUALIFY row_number() OVER (PARTITION BY symbol, market, halt_start ORDER BY moment DESC, id DESC) = 1) b
 ON b.symbol = h.symbol AND b.market = h.market AND b.halt_start = h.halt_start"""


@query("enrich_from_resumptions", _ENRICHED)
def _(i: Inputs) -> DataFrame:
    return M.enrich_halts(i.all_halt_rows, i.resumptions, "id").select("id", *K.RESUMPTION_BLOCK, "raw_updated")


_LATEST_END = f"""
SELECT l.episode_id, max(CAST(CAST(x.resumption_date AS VARCHAR) || ' ' ||
       coalesce(x.resumption_trade_time, x.resumption_quote_time) AS TIMESTAMP)) AS halt_end_new
FROM links l JOIN ({_ENRICHED}) x ON x.id = l.trade_halt_id GROUP BY 1"""


@query("latest_valid_end", f"""
SELECT e.episode_id, t.halt_end_new FROM episodes e JOIN ({_LATEST_END}) t USING (episode_id)
WHERE t.halt_end_new >= e.halt_start""")
def _(i: Inputs) -> DataFrame:
    halts = M.enrich_halts(i.all_halt_rows, i.resumptions, "id")
    return M.latest_valid_ends(i.core_episodes, i.links, halts).select("episode_id", "halt_end_new")


@query("enrich_episodes", f"""
SELECT episode_id, CASE WHEN u THEN halt_end_new ELSE halt_end END AS halt_end,
       CASE WHEN u THEN round(date_diff('microsecond', halt_start, halt_end_new) / 6e7, 3) ELSE duration_minutes END AS duration_minutes,
       CASE WHEN u AND multi THEN 'MULTI_DAY' ELSE halt_close_status END AS halt_close_status, u AS core_updated
FROM (
  SELECT *, coalesce(halt_end_new IS NOT NULL AND (halt_end IS NULL OR halt_end_new > halt_end OR duration_minutes IS NULL
           OR (multi AND halt_close_status <> 'MULTI_DAY')), false) AS u
  FROM (SELECT e.*, t.halt_end_new, CAST(t.halt_end_new AS DATE) > CAST(e.halt_start AS DATE) AS multi
        FROM episodes e LEFT JOIN ({_LATEST_END}) t ON t.episode_id = e.episode_id AND t.halt_end_new >= e.halt_start))""")
def _(i: Inputs) -> DataFrame:
    halts = M.enrich_halts(i.all_halt_rows, i.resumptions, "id")
    return M.enrich_episodes(i.core_episodes, i.links, halts).select(
        "episode_id", "halt_end", "duration_minutes", "halt_close_status", "core_updated")


@query("episode_link_raw", """
SELECT e.episode_id, l.trade_halt_id, h.resumption_date, h.reason_code AS raw_reason
FROM episodes e JOIN links l USING (episode_id) JOIN all_halt_rows h ON h.id = l.trade_halt_id""")
def _(i: Inputs) -> DataFrame:
    ep = i.core_episodes.select("episode_id", "halt_start")
    return M.episode_link_raw(ep, i.links, i.all_halt_rows).select(
        "episode_id", "trade_halt_id", "resumption_date", "raw_reason")


# Stored: the episodes without their reasons and, for later starts, without ends.
_STORED_EP = """
SELECT symbol, market, halt_start, issue_name, CAST(NULL AS VARCHAR) AS reason_code,
       CASE WHEN minute(halt_start) < 30 THEN halt_end END AS halt_end,
       CASE WHEN minute(halt_start) < 30 THEN duration_minutes END AS duration_minutes,
       CASE WHEN minute(halt_start) < 45 THEN halt_close_status ELSE 'NO' END AS halt_close_status
FROM episodes WHERE hour(halt_start) < 16"""
_EP_MERGE = f"""
SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.market, n.market) AS market,
       coalesce(o.halt_start, n.halt_start) AS halt_start, coalesce(n.issue_name, o.issue_name) AS issue_name,
       coalesce(n.reason_code, o.reason_code) AS reason_code, coalesce(n.halt_end, o.halt_end) AS halt_end,
       coalesce(n.duration_minutes, o.duration_minutes) AS duration_minutes,
       CASE WHEN o.symbol IS NULL THEN n.halt_close_status
            WHEN n.halt_close_status IS NULL OR (n.halt_close_status = 'UNKNOWN' AND o.halt_close_status IN ('YES', 'NO', 'MULTI_DAY'))
            THEN o.halt_close_status ELSE n.halt_close_status END AS halt_close_status,
       o.symbol IS NOT NULL AS has_old, n.symbol IS NOT NULL AS has_new, o.issue_name AS o1, o.reason_code AS o2,
       o.halt_end AS o3, o.duration_minutes AS o4, o.halt_close_status AS o5
FROM ({_STORED_EP}) o FULL OUTER JOIN (SELECT * FROM episodes WHERE hour(halt_start) >= 8) n
 ON o.symbol = n.symbol AND o.market = n.market AND o.halt_start = n.halt_start"""


def _stored_episodes(i: Inputs) -> DataFrame:
    minute = F.minute("halt_start")
    return i.episodes.filter(F.hour("halt_start") < 16).select(
        "symbol", "market", "halt_start", "issue_name", F.lit(None).cast("string").alias("reason_code"),
        F.when(minute < 30, F.col("halt_end")).alias("halt_end"),
        F.when(minute < 30, F.col("duration_minutes")).alias("duration_minutes"),
        F.when(minute < 45, F.col("halt_close_status")).otherwise(F.lit("NO")).alias("halt_close_status"),
    )


@query("upsert_episodes", f"""
SELECT symbol, market, halt_start, issue_name, reason_code, halt_end, duration_minutes, halt_close_status,
       CASE WHEN NOT has_old THEN 'INSERTED' WHEN NOT has_new THEN 'STORED'
            WHEN issue_name IS DISTINCT FROM o1 OR reason_code IS DISTINCT FROM o2 OR halt_end IS DISTINCT FROM o3
              OR duration_minutes IS DISTINCT FROM o4 OR halt_close_status IS DISTINCT FROM o5 THEN 'UPDATED'
            ELSE 'UNCHANGED' END AS action FROM ({_EP_MERGE})""")
def _(i: Inputs) -> DataFrame:
    return M.merge_episodes(_stored_episodes(i), i.episodes.filter(F.hour("halt_start") >= 8))


@query("new_episodes_only", """
SELECT symbol, market, halt_start FROM episodes WHERE hour(halt_start) >= 16""")
def _(i: Inputs) -> DataFrame:
    incoming = i.episodes.filter(F.hour("halt_start") >= 8)
    return M.new_episodes_only(_stored_episodes(i), incoming).select("symbol", "market", "halt_start")


@query("sync_episode_links", """
SELECT coalesce(h.episode_id, d.episode_id) AS episode_id, coalesce(h.trade_halt_id, d.trade_halt_id) AS trade_halt_id,
       CASE WHEN h.episode_id IS NULL THEN 'INSERTED'
            WHEN d.episode_id IS NULL AND h.episode_id IN (SELECT episode_id FROM links) THEN 'DELETED'
            ELSE 'KEPT' END AS action
FROM (SELECT DISTINCT l.episode_id, l.trade_halt_id + CASE WHEN l.trade_halt_id % 4 = 1 THEN 1 ELSE 0 END AS trade_halt_id
      FROM links l) h
FULL OUTER JOIN links d ON d.episode_id = h.episode_id AND d.trade_halt_id = h.trade_halt_id""")
def _(i: Inputs) -> DataFrame:
    t = F.col("trade_halt_id")
    stored = i.links.select("episode_id", (t + F.when(t % 4 == 1, 1).otherwise(0)).alias("trade_halt_id"))
    return M.sync_links(stored, i.links, i.links)


@query("seed_links", "SELECT DISTINCT episode_id, episode_id AS trade_halt_id FROM episodes")
def _(i: Inputs) -> DataFrame:
    return M.seed_links(i.core_episodes)


@query("bulk_load_first_best", """
SELECT symbol, market, halt_start, reason_code, obs_id FROM (
  SELECT * FROM halt_obs WHERE hour(halt_start) >= 8
  QUALIFY row_number() OVER (PARTITION BY symbol, market, halt_start, reason_code
          ORDER BY (issue_name IS NOT NULL) DESC, (pause_threshold_price IS NOT NULL) DESC, obs_id) = 1) n
WHERE NOT EXISTS (SELECT 1 FROM stored_canonical o WHERE o.symbol = n.symbol AND o.market = n.market
                  AND o.halt_start = n.halt_start AND o.reason_code IS NOT DISTINCT FROM n.reason_code)""")
def _(i: Inputs) -> DataFrame:
    best = K.first_best_halts(i.halt_obs.filter(F.hour("halt_start") >= 8), ["obs_id"])
    return M.new_rows(i.stored_halts, best, K.HALT_KEY).select(*K.HALT_KEY, "obs_id")


# -- rule expressions ----------------------------------------------------------------

@query("prefer_new_value", f"""
SELECT symbol, market, halt_start, reason_code, issue_name, pause_threshold_price FROM ({_MERGED}) WHERE has_old AND has_new""")
def _(i: Inputs) -> DataFrame:
    both = i.stored_halts.select(*K.HALT_KEY, F.col("issue_name").alias("old_name"), F.col("pause_threshold_price").alias("old_price"))
    new = i.incoming_halts.select(*K.HALT_KEY, F.col("issue_name").alias("new_name"), F.col("pause_threshold_price").alias("new_price"))
    return both.join(new, M.null_safe(both, new, K.HALT_KEY)).select(
        *[both[k] for k in K.HALT_KEY], C.prefer_new("old_name", "new_name").alias("issue_name"),
        C.prefer_new("old_price", "new_price").alias("pause_threshold_price"))


@query("changed_columns", """
SELECT obs_id, (resumption_quote_time IS DISTINCT FROM resumption_trade_time
       OR issue_name IS DISTINCT FROM symbol) AS changed,
       resumption_quote_time IS DISTINCT FROM resumption_trade_time AS time_changed FROM halt_obs""")
def _(i: Inputs) -> DataFrame:
    c = F.col
    return i.halt_obs.select(
        "obs_id",
        C.is_changed([(c("resumption_quote_time"), c("resumption_trade_time")), (c("issue_name"), c("symbol"))]).alias("changed"),
        C.is_changed([(c("resumption_quote_time"), c("resumption_trade_time"))]).alias("time_changed"))


@query("prefer_close_status", """
SELECT symbol, market, halt_start,
       CASE WHEN new IS NULL OR (new = 'UNKNOWN' AND old IN ('YES', 'NO', 'MULTI_DAY')) THEN old ELSE new END AS status
FROM (SELECT *, CASE minute(halt_start) % 4 WHEN 0 THEN 'YES' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN NULL ELSE 'MULTI_DAY' END AS old,
             CASE WHEN second(halt_start) < 50 THEN halt_close_status END AS new FROM episodes)""")
def _(i: Inputs) -> DataFrame:
    m = F.minute("halt_start") % 4
    old = F.when(m == 0, F.lit("YES")).when(m == 1, F.lit("UNKNOWN")).when(m == 3, F.lit("MULTI_DAY"))
    new = F.when(F.second("halt_start") < 50, F.col("halt_close_status"))
    return i.episodes.select("symbol", "market", "halt_start", C.prefer_close_status(old, new).alias("status"))


@query("validate_close_status", "SELECT symbol, market, halt_start, halt_close_status AS status FROM episodes")
def _(i: Inputs) -> DataFrame:
    messy = F.concat(F.lit(" "), F.lower("halt_close_status"), F.lit(" "))
    return i.episodes.select("symbol", "market", "halt_start", C.validated_close_status(messy).alias("status"))


@query("close_status", """
SELECT obs_id, CASE WHEN halt_end IS NULL THEN 'UNKNOWN'
       WHEN CAST(halt_start AS DATE) <> CAST(halt_end AS DATE) THEN 'MULTI_DAY'
       WHEN CAST(halt_start AS TIME) <= TIME '16:00:00' AND CAST(halt_end AS TIME) >= TIME '16:00:00' THEN 'YES' ELSE 'NO' END AS status
FROM halt_obs""")
def _(i: Inputs) -> DataFrame:
    return i.halt_obs.select("obs_id", C.close_status("halt_start", "halt_end").alias("status"))


@query("duration_minutes", """
SELECT obs_id, CASE WHEN halt_end >= halt_start THEN round(date_diff('microsecond', halt_start, halt_end) / 6e7, 3) END AS duration_minutes
FROM halt_obs""")
def _(i: Inputs) -> DataFrame:
    return i.halt_obs.select("obs_id", C.duration_minutes("halt_start", "halt_end").alias("duration_minutes"))


@query("normalize_market", """
SELECT market, CASE market WHEN 'Q' THEN 'NASDAQ' WHEN 'N' THEN 'NYSE' WHEN 'A' THEN 'AMEX' ELSE market END AS normalized,
       count(*) AS n FROM halt_obs GROUP BY ALL""")
def _(i: Inputs) -> DataFrame:
    return i.halt_obs.groupBy("market").agg(F.count(F.lit(1)).alias("n")).select(
        "market", C.normalize_market(F.lower("market")).alias("normalized"), "n")


@query("reason_reference", """
SELECT o.reason_code, CASE o.reason_code WHEN 'LUDP' THEN 'Volatility Trading Pause' WHEN 'T1' THEN 'News Pending'
       WHEN 'H11' THEN 'Regulatory concern' WHEN 'M' THEN 'Volatility Trading Pause / market-specific halt'
       WHEN 'T12' THEN 'Additional information requested' END AS description,
       CASE WHEN o.reason_code IS NOT NULL THEN 'HALT' END AS kind, count(*) AS observations
FROM halt_obs o GROUP BY ALL""")
def _(i: Inputs) -> DataFrame:
    counted = i.halt_obs.groupBy("reason_code").agg(F.count(F.lit(1)).alias("observations"))
    return tables.describe_reasons(counted, i.spark).select("reason_code", "description", "kind", "observations")


# -- filters and reports ------------------------------------------------------------------

@query("reason_filter", """
SELECT r.request_id, e.symbol, e.market, e.halt_start, e.reason_code FROM requests r JOIN episodes e ON e.symbol = r.ticker
 AND CAST(e.halt_start AS DATE) <= r.observation_date
 AND (list_contains(r.reason_codes, 'ALL') OR list_contains(r.reason_codes, e.reason_code))""")
def _(i: Inputs) -> DataFrame:
    return X.episodes_for_requests(i.episodes.drop("reason_codes"), i.requests).select(
        "request_id", "symbol", "market", "halt_start", "reason_code")


@query("episodes_for_request", """
SELECT r.request_id, e.market, e.halt_start, e.duration_minutes, e.halt_close_status FROM request_windows r
JOIN episodes e ON e.symbol = r.ticker AND CAST(e.halt_start AS DATE) <= r.observation_date
 AND (r.lookback_start IS NULL OR CAST(e.halt_start AS DATE) >= r.lookback_start)
 AND (list_contains(r.reason_codes, 'ALL') OR list_contains(r.reason_codes, e.reason_code))""")
def _(i: Inputs) -> DataFrame:
    asked = X.with_window(i.requests).withColumnRenamed("lookback_start", "start_date")
    return X.episodes_for_requests(i.episodes.drop("reason_codes"), asked).select(
        "request_id", "market", "halt_start", "duration_minutes", "halt_close_status")


@query("symbol_day_halts", """
SELECT symbol, CAST(halt_start AS DATE) AS trading_date, market, halt_start, halt_end FROM episodes
WHERE CAST(halt_start AS DATE) >= DATE '2024-01-08' AND CAST(halt_start AS DATE) < DATE '2024-01-13'""")
def _(i: Inputs) -> DataFrame:
    day = F.to_date("halt_start")
    return i.episodes.filter((day >= "2024-01-08") & (day < "2024-01-13")).select(
        "symbol", day.alias("trading_date"), "market", "halt_start", "halt_end")


@query("multi_day_halts", f"SELECT {EPISODE_SQL} FROM episodes WHERE halt_close_status = 'MULTI_DAY'")
def _(i: Inputs) -> DataFrame:
    return i.episodes.filter("halt_close_status = 'MULTI_DAY'").select(*EPISODE_OUT)


@query("halts_at_close", f"SELECT {EPISODE_SQL} FROM episodes WHERE halt_close_status = 'YES'")
def _(i: Inputs) -> DataFrame:
    return i.episodes.filter("halt_close_status = 'YES'").select(*EPISODE_OUT)


@query("latest_halts_topk", """
SELECT symbol, market, halt_start, halt_end FROM episodes ORDER BY halt_start DESC, symbol, market LIMIT 100""")
def _(i: Inputs) -> DataFrame:
    return i.episodes.orderBy(F.desc("halt_start"), "symbol", "market").limit(100).select(
        "symbol", "market", "halt_start", "halt_end")


@query("distinct_sources", "SELECT DISTINCT source_file FROM halt_obs")
def _(i: Inputs) -> DataFrame:
    return i.halt_obs.select("source_file").distinct()


@query("distinct_resumptions", """
SELECT DISTINCT symbol, market, halt_start, reason_code, CAST(NULL AS VARCHAR) AS resumption_reason_code, resumption_date,
       resumption_quote_time, resumption_trade_time, source_file FROM halt_obs WHERE resumption_date IS NOT NULL""")
def _(i: Inputs) -> DataFrame:
    return i.halt_obs.filter("resumption_date is not null").select(
        "symbol", "market", "halt_start", "reason_code", F.lit(None).cast("string").alias("resumption_reason_code"),
        *K.RESUMPTION_BLOCK, "source_file").distinct()


# -- days ------------------------------------------------------------------------------

@query("episode_trading_days", """
SELECT symbol, market, halt_start, trading_date, session_seq, at_close AS halted_at_close FROM episode_days""")
def _(i: Inputs) -> DataFrame:
    return D.episode_days(i.episodes, i.calendar).select(
        "symbol", "market", "halt_start", "trading_date", F.col("session_seq").cast("bigint").alias("session_seq"),
        "halted_at_close")


@query("halted_at_close", """
SELECT symbol, trading_date, bool_or(at_close) AS halted_at_close FROM episode_days GROUP BY ALL""")
def _(i: Inputs) -> DataFrame:
    return D.halt_days(i.episodes, i.calendar).select("symbol", "trading_date", "halted_at_close")


@query("halt_day_dataset", "SELECT symbol, trading_date, episode_count, halted_at_close FROM halt_days")
def _(i: Inputs) -> DataFrame:
    return D.halt_days(i.episodes, i.calendar).select("symbol", "trading_date", "episode_count", "halted_at_close")


@query("ticker_halt_daily", "SELECT * FROM daily")
def _(i: Inputs) -> DataFrame:
    return D.ticker_halt_daily(i.episodes)


_TICKER_METRICS = """
SELECT e.symbol, e.n AS total_halt_episodes, coalesce(d.days, 0) AS halt_days, coalesce(d.closes, 0) AS halt_days_at_close,
       CASE WHEN d.days > 0 THEN round(d.closes / d.days * 100, 4) ELSE 0.0::DOUBLE END AS halt_at_close_pct,
       CASE WHEN d.days > 0 THEN round(e.n / d.days, 4) ELSE 0.0::DOUBLE END AS halts_per_halt_day,
       round(e.n / (SELECT count(*) FROM file_days), 4) AS halts_per_market_day,
       e.avg_d AS avg_duration_minutes, e.med AS median_duration_minutes, e.min_d AS min_duration_minutes,
       e.max_d AS max_duration_minutes, e.f AS first_halt_date, e.l AS last_halt_date
FROM (SELECT symbol, count(*) AS n, floor((2 * sum(CAST(round(duration_minutes * 1000) AS BIGINT)) + count(duration_minutes)) / (2 * count(duration_minutes))) / 1000 AS avg_d, round(median(duration_minutes), 3) AS med,
             min(duration_minutes) AS min_d, max(duration_minutes) AS max_d, min(CAST(halt_start AS DATE)) AS f,
             max(CAST(halt_start AS DATE)) AS l FROM episodes GROUP BY 1) e
LEFT JOIN (SELECT symbol, count(*) AS days, count(*) FILTER (WHERE halt_at_close = 'YES') AS closes FROM daily GROUP BY 1) d
USING (symbol)"""


@query("ticker_halt_metrics", _TICKER_METRICS)
def _(i: Inputs) -> DataFrame:
    episodes = i.saved("episodes")
    return D.ticker_halt_metrics(episodes, D.ticker_halt_daily(episodes), feeds.market_days(i.halt_obs))


_REASON_METRICS = """
SELECT symbol, reason_code, count(*) AS halt_episodes, floor((2 * sum(CAST(round(duration_minutes * 1000) AS BIGINT)) + count(duration_minutes)) / (2 * count(duration_minutes))) / 1000 AS avg_duration_minutes,
       min(duration_minutes) AS min_duration_minutes, max(duration_minutes) AS max_duration_minutes FROM episodes GROUP BY 1, 2"""


@query("ticker_reason_metrics", _REASON_METRICS)
def _(i: Inputs) -> DataFrame:
    return D.ticker_reason_metrics(i.episodes)


@query("null_last_sort", f"SELECT * FROM ({_REASON_METRICS}) ORDER BY symbol, reason_code NULLS LAST")
def _(i: Inputs) -> DataFrame:
    return D.ticker_reason_metrics(i.episodes).orderBy(*D.reason_order())


@query("market_days_from_files", "SELECT trading_date FROM file_days")
def _(i: Inputs) -> DataFrame:
    return feeds.market_days(i.halt_obs)


@query("scan_by_file_date", """
SELECT obs_id, source_file FROM halt_obs
WHERE substr(source_file, 12, 10) >= '2024-01-05' AND substr(source_file, 12, 10) < '2024-01-20'""")
def _(i: Inputs) -> DataFrame:
    from datetime import date

    return feeds.within_file_dates(i.halt_obs, date(2024, 1, 5), date(2024, 1, 20)).select("obs_id", "source_file")


# -- metrics -----------------------------------------------------------------------------

def _metrics(i: Inputs) -> DataFrame:
    return X.halt_metrics(i.requests, i.episodes, i.calendar)


@query("halt_metrics_all", "SELECT * FROM metrics")
def _(i: Inputs) -> DataFrame:
    m = _metrics(i)
    rounded = {f"metric_{n}": r6(f"metric_{n}") for n in (2, 4, 7)}
    return m.withColumns({**rounded, "reason_codes": joined("reason_codes")})


def _register_metric(n: int) -> None:
    @query(f"metric_{n}", f"SELECT request_id, metric_{n} FROM metrics")
    def _(i: Inputs) -> DataFrame:
        value = r6(f"metric_{n}") if n in (2, 4, 7) else F.col(f"metric_{n}")
        return _metrics(i).select("request_id", value.alias(f"metric_{n}"))


for _n in range(1, 12):
    _register_metric(_n)


@query("batch_request_join", "SELECT request_id, trading_date, episode_count, halted_at_close FROM request_days")
def _(i: Inputs) -> DataFrame:
    return X.request_halt_days(i.requests, i.episodes, i.calendar).select(
        "request_id", "trading_date", "episode_count", "halted_at_close")


@query("lookback_window", """
SELECT request_id, lookback_start, observation_date AS lookback_end FROM request_windows""")
def _(i: Inputs) -> DataFrame:
    return X.with_window(i.requests).select("request_id", "lookback_start", "lookback_end")


@query("sequential_blocks", "SELECT request_id, block_start, block_end, block_length FROM request_blocks")
def _(i: Inputs) -> DataFrame:
    return X.sequential_blocks(X.request_halt_days(i.requests, i.episodes, i.calendar), ["request_id"])


@query("halt_day_gaps", """
SELECT symbol, trading_date, p AS previous_date, date_diff('day', p, trading_date) AS gap_days FROM (
  SELECT symbol, trading_date, lag(trading_date) OVER (PARTITION BY symbol ORDER BY trading_date) AS p FROM halt_days)
WHERE p IS NOT NULL""")
def _(i: Inputs) -> DataFrame:
    gaps = X.halt_day_gaps(D.halt_days(i.episodes, i.calendar), ["symbol"])
    return gaps.withColumn("gap_days", F.col("gap_days").cast("bigint"))


@query("request_contract", """
SELECT r.request_id, CASE WHEN r.user_id % 7 = 0 THEN 'ticker is required'
  WHEN r.user_id % 5 = 0 THEN 'at least one reason code is required' ELSE 'lookback must be positive or absent' END AS violation
FROM (SELECT *, request_id // 1000000 AS user_id FROM requests) r
WHERE r.user_id % 7 = 0 OR r.user_id % 5 = 0 OR (r.user_id % 3 = 0 AND lookback_months IS NOT NULL)""")
def _(i: Inputs) -> DataFrame:
    u = F.floor(F.col("request_id") / 1000000)
    broken = i.requests.select(
        "request_id",
        F.when(u % 7 == 0, F.lit("  ")).otherwise(F.col("ticker")).alias("ticker"),
        "observation_date",
        F.when(u % 3 == 0, -F.col("lookback_months")).otherwise(F.col("lookback_months")).alias("lookback_months"),
        F.when(u % 5 == 0, F.array(F.lit(" "))).otherwise(F.col("reason_codes")).alias("reason_codes"),
    )
    return X.request_violations(broken).select("request_id", "violation")


# -- checks --------------------------------------------------------------------------------

@query("table_counts", """
SELECT 'core.halt_episode' AS object_name, count(*) AS row_count FROM episodes
UNION ALL SELECT 'core.halt_episode_event', count(*) FROM links
UNION ALL SELECT 'raw.resumption', count(*) FROM resumptions
UNION ALL SELECT 'raw.trade_halt', count(*) FROM all_halt_rows""")
def _(i: Inputs) -> DataFrame:
    return Q.table_counts({"raw.trade_halt": i.all_halt_rows, "raw.resumption": i.resumptions,
                           "core.halt_episode": i.episodes, "core.halt_episode_event": i.links_by_key})


@query("union_counts", """
SELECT market AS object_name, count(*) AS row_count FROM halt_obs GROUP BY 1 ORDER BY 1""")
def _(i: Inputs) -> DataFrame:
    return Q.value_counts(i.halt_obs, "market").orderBy("object_name")


@query("duplicate_keys", """
SELECT symbol, market, halt_start, reason_code, count(*) AS n FROM all_halt_rows GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""")
def _(i: Inputs) -> DataFrame:
    return Q.duplicate_keys(i.all_halt_rows, K.HALT_KEY)


@query("duplicate_key_counts", f"""
SELECT 'episodes' AS object_name, count(*) AS duplicate_keys FROM
  (SELECT 1 FROM episodes GROUP BY symbol, market, halt_start HAVING count(*) > 1)
UNION ALL SELECT 'halts', count(*) FROM
  (SELECT 1 FROM all_halt_rows GROUP BY symbol, market, halt_start, reason_code HAVING count(*) > 1)
UNION ALL SELECT 'links', count(*) FROM (SELECT 1 FROM links GROUP BY episode_id, trade_halt_id HAVING count(*) > 1)
UNION ALL SELECT 'resumptions', count(*) FROM (SELECT 1 FROM resumptions GROUP BY {_RES_KEY} HAVING count(*) > 1)""")
def _(i: Inputs) -> DataFrame:
    return Q.duplicate_key_counts({
        "halts": (i.all_halt_rows, K.HALT_KEY), "resumptions": (i.resumptions, K.RESUMPTION_KEY),
        "episodes": (i.episodes, M.EPISODE_KEY),
        "links": (i.links_by_key, ["symbol", "market", "halt_start", "trade_halt_id"])})


@query("orphan_links", """
SELECT 'episode_without_halt' AS check_name, count(*) AS orphans FROM episodes e
 WHERE NOT EXISTS (SELECT 1 FROM halt_rows h WHERE h.id = e.episode_id AND hour(h.halt_start) < 16)
UNION ALL SELECT 'link_without_episode', count(*) FROM links l
 WHERE NOT EXISTS (SELECT 1 FROM episodes e WHERE e.episode_id = l.episode_id)
UNION ALL SELECT 'link_without_halt', count(*) FROM links l
 WHERE NOT EXISTS (SELECT 1 FROM halt_rows h WHERE h.id = l.trade_halt_id AND hour(h.halt_start) < 16)""")
def _(i: Inputs) -> DataFrame:
    return Q.orphan_counts(i.core_episodes, i.links, i.halt_rows.filter(F.hour("halt_start") < 16))


@query("resumption_context_by_year", """
SELECT CAST(year(resumption_date) AS INTEGER) AS year, count(*) AS observations,
  count(*) FILTER (WHERE reason_code IS NOT NULL AND resumption_reason_code IS NULL) AS halt_context_only,
  count(*) FILTER (WHERE reason_code IS NULL AND resumption_reason_code IS NOT NULL) AS resumption_context_only,
  count(*) FILTER (WHERE reason_code IS NOT NULL AND resumption_reason_code IS NOT NULL) AS both_codes,
  count(*) FILTER (WHERE reason_code IS NULL AND resumption_reason_code IS NULL) AS no_code
FROM resumptions GROUP BY 1""")
def _(i: Inputs) -> DataFrame:
    return Q.resumption_context_by_year(i.resumptions)


@query("reasonless_rows", """
SELECT count(*) AS reasonless_rows FROM resumptions WHERE reason_code IS NULL AND resumption_reason_code IS NULL""")
def _(i: Inputs) -> DataFrame:
    return Q.reasonless_rows(i.resumptions)


@query("bad_chronology", "SELECT count(*) AS bad_chronology FROM halt_obs WHERE halt_end < halt_start")
def _(i: Inputs) -> DataFrame:
    return Q.bad_chronology(i.halt_obs)


@query("domain_checks", """
SELECT obs_id, 'end_before_start' AS violation FROM halt_obs WHERE halt_end < halt_start
UNION ALL SELECT obs_id, 'negative_duration' FROM halt_obs WHERE halt_end < halt_start
UNION ALL SELECT obs_id, 'unknown_status' FROM halt_obs WHERE market = 'P'""")
def _(i: Inputs) -> DataFrame:
    from haltscope.functions.times import micros_between

    rows = i.halt_obs.withColumn("duration_minutes", micros_between("halt_start", "halt_end") / 6e7).withColumn(
        "halt_close_status", F.when(F.col("market") == "P", F.lit("MAYBE")).otherwise(F.lit("NO")))
    return Q.episode_domain_violations(rows).select("obs_id", "violation")


@query("event_contract", """
SELECT obs_id, 'no_reason' AS violation FROM halt_obs WHERE reason_code IS NULL
UNION ALL SELECT obs_id, 'no_market' FROM halt_obs WHERE market = 'P'
UNION ALL SELECT obs_id, 'no_start' FROM halt_obs WHERE copy_no = 3""")
def _(i: Inputs) -> DataFrame:
    broken = i.halt_obs.withColumn("market", F.when(F.col("market") != "P", F.col("market")).otherwise(F.lit(" "))).withColumn(
        "halt_start", F.when(F.col("copy_no") != 3, F.col("halt_start")))
    return Q.event_violations(broken).select("obs_id", "violation")


@query("missing_raw_for_episode", """
SELECT e.symbol, e.market, e.halt_start FROM episodes e WHERE NOT EXISTS (
  SELECT 1 FROM halt_rows h WHERE hour(h.halt_start) < 16 AND h.symbol = e.symbol AND h.halt_start = e.halt_start
   AND CASE h.market WHEN 'Q' THEN 'NASDAQ' WHEN 'N' THEN 'NYSE' WHEN 'A' THEN 'AMEX' ELSE h.market END = e.market)""")
def _(i: Inputs) -> DataFrame:
    return Q.episodes_without_raw(i.episodes, i.halt_rows.filter(F.hour("halt_start") < 16)).select(
        "symbol", "market", "halt_start")


_GROUPS = """
SELECT *, CASE WHEN raw_count = 1 THEN 'ONE_TO_ONE'
  WHEN reasons = 1 AND raw_markets > 1 THEN 'MARKET_ALIAS_COLLAPSE' WHEN reasons = 1 THEN 'SAME_MARKET_SAME_REASON'
  ELSE 'SAME_MARKET_DIFFERENT_REASON' END AS classification
FROM (SELECT symbol, nm AS market, episode_start AS halt_start, count(*) AS raw_count, count(DISTINCT market) AS raw_markets,
             count(DISTINCT coalesce(reason_code, '?')) AS reasons FROM membership GROUP BY symbol, nm, episode_start)"""


@query("group_diagnostics", f"""
SELECT classification, count(*) AS episodes, max(raw_count) AS max_raw_count, CAST(sum(raw_count) AS BIGINT) AS raw_rows
FROM ({_GROUPS}) GROUP BY 1""")
def _(i: Inputs) -> DataFrame:
    return Q.group_diagnostics_summary(Q.group_diagnostics(E.episode_membership(i.unique_obs)))


@query("link_outcome", """
SELECT (SELECT count(*) FROM links) AS link_count, (SELECT count(*) FROM episodes) AS episode_count,
       (SELECT count(*) FROM unique_obs) AS raw_count,
       (SELECT count(*) FROM (SELECT 1 FROM links GROUP BY trade_halt_id HAVING count(*) > 1)) AS raw_in_two_episodes,
       (SELECT count(*) FROM (SELECT 1 FROM links GROUP BY episode_id HAVING count(*) > 1)) AS multi_raw_episodes""")
def _(i: Inputs) -> DataFrame:
    return Q.link_outcome(i.links, E.episodes_of(i.saved("members"), ["obs_id"]), i.saved("unique_obs"))


@query("expected_vs_returned_ids", """
SELECT obs_id, 'returned' AS missing_from FROM halt_obs WHERE hour(halt_start) >= 16
UNION SELECT obs_id, 'expected' FROM halt_obs WHERE hour(halt_start) < 8""")
def _(i: Inputs) -> DataFrame:
    hour = F.hour("halt_start")
    return Q.expected_vs_returned(i.halt_obs.filter(hour >= 8), i.halt_obs.filter(hour < 16), "obs_id")


@query("fixture_counts_by_date", """
SELECT x.symbol, x.trading_date, x.expected_count, coalesce(a.n, 0) AS actual_count,
       CASE WHEN coalesce(a.n, 0) = x.expected_count THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT symbol, CAST(halt_start AS DATE) AS trading_date, count(*) AS expected_count FROM unique_obs GROUP BY 1, 2) x
LEFT JOIN (SELECT symbol, CAST(halt_start AS DATE) AS trading_date, count(*) AS n FROM episodes GROUP BY 1, 2) a
USING (symbol, trading_date)""")
def _(i: Inputs) -> DataFrame:
    expected = i.unique_obs.groupBy("symbol", F.to_date("halt_start").alias("trading_date")).agg(
        F.count(F.lit(1)).alias("expected_count"))
    return Q.fixture_counts(i.episodes, expected)


@query("require_session_day", """
SELECT o.obs_id, CAST(o.halt_start AS DATE) AS trading_date FROM halt_obs o JOIN calendar c ON c.cal_date = CAST(o.halt_start AS DATE)
WHERE NOT c.is_session""")
def _(i: Inputs) -> DataFrame:
    days = i.halt_obs.select("obs_id", F.to_date("halt_start").alias("trading_date"))
    return Q.not_session_days(days, "trading_date", i.calendar).select("obs_id", "trading_date")


@query("ingest_days_not_past", """
SELECT obs_id, CAST(halt_start AS DATE) AS trading_date FROM halt_obs
WHERE CAST(halt_start AS DATE) >= (SELECT max(CAST(halt_start AS DATE)) FROM halt_obs)""")
def _(i: Inputs) -> DataFrame:
    days = i.halt_obs.select("obs_id", F.to_date("halt_start").alias("trading_date"))
    today = days.agg(F.max("trading_date")).scalar()
    return Q.future_days(days, "trading_date", today)


@query("feed_record_filter", """
SELECT obs_id, symbol FROM halt_obs WHERE symbol IN (SELECT 'S' || s_suppkey FROM supplier)""")
def _(i: Inputs) -> DataFrame:
    wanted = i.table("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("symbol"))
    return feeds.only_symbols(i.halt_obs, wanted).select("obs_id", "symbol")


@query("feed_symbols_found", """
SELECT 'S' || s_suppkey AS symbol, s_suppkey IN (SELECT user_id FROM events) AS found FROM supplier""")
def _(i: Inputs) -> DataFrame:
    wanted = i.table("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("symbol"))
    return feeds.symbols_found(i.halt_obs, wanted)


# -- exports ---------------------------------------------------------------------------------

@query("export_batch_results", """
SELECT strftime(observation_date, '%d/%m/%Y') AS "Date", ticker AS "Ticker", CAST(metric_1 AS VARCHAR) AS "Metric 1",
       coalesce(CAST(metric_3 AS VARCHAR), 'N/A') AS "Metric 3", metric_5 AS "Metric 5", CAST(metric_6 AS VARCHAR) AS "Metric 6",
       coalesce(CAST(metric_8 AS VARCHAR), 'N/A') AS "Metric 8", CAST(metric_9 AS VARCHAR) AS "Metric 9",
       metric_10 AS "Metric 10", CAST(metric_11 AS VARCHAR) AS "Metric 11",
       CASE WHEN metric_2 IS NULL THEN 'N/A' ELSE regexp_replace(printf('%.2f', metric_2), '\\.?0+$', '') END AS "Metric 2",
       CASE WHEN metric_4 IS NULL THEN 'N/A' ELSE regexp_replace(printf('%.2f', metric_4), '\\.?0+$', '') END AS "Metric 4",
       CASE WHEN metric_7 IS NULL THEN 'N/A' ELSE regexp_replace(printf('%.2f', metric_7), '\\.?0+$', '') END AS "Metric 7"
FROM metrics""")
def _(i: Inputs) -> DataFrame:
    folder = work_dir(i.spark, "batch-results")
    tables.export_csv(tables.batch_result_rows(_metrics(i)), folder)
    return i.spark.read.option("header", True).csv(folder)


@query("export_csv_levels", """
SELECT 'events' AS level, count(*) AS row_count FROM unique_obs UNION ALL SELECT 'episodes', count(*) FROM episodes
UNION ALL SELECT 'daily', count(*) FROM daily UNION ALL SELECT 'ticker_metrics', count(DISTINCT symbol) FROM episodes
UNION ALL SELECT 'reason_metrics', count(*) FROM (SELECT DISTINCT symbol, reason_code FROM episodes)""")
def _(i: Inputs) -> DataFrame:
    folder = work_dir(i.spark, "levels")
    levels = D.report_levels(i.saved("unique_obs"), i.saved("episodes"), feeds.market_days(i.halt_obs))
    tables.export_levels(levels, folder)
    counts = [
        i.spark.read.option("header", True).csv(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("level"), "row_count")
        for name in levels
    ]
    return reduce(DataFrame.unionByName, counts)


@query("export_live_events", """
SELECT symbol, issue_name, market, reason_code, strftime(halt_start, '%m/%d/%Y') AS halt_date,
       strftime(halt_start, '%H:%M:%S.%f') AS halt_time, resumption_date, resumption_quote_time, resumption_trade_time,
       pause_threshold_price FROM unique_obs""")
def _(i: Inputs) -> DataFrame:
    rows = i.unique_obs.withColumn("halt_date", F.date_format("halt_start", "MM/dd/yyyy")).withColumn(
        "halt_time", F.date_format("halt_start", "HH:mm:ss.SSSSSS"))
    return tables.live_event_rows(rows)
