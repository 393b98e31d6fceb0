"""SQL twins of the derived tables and of the intermediate results, as named CTEs.

``with_views(sql)`` puts the CTEs a statement needs in front of it. The SQL is
plain DuckDB dialect and shares no code with the Spark side.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

# -- derived inputs -----------------------------------------------------------

VIEWS["halt_obs"] = """
SELECT event_id * 4 + c.copy_no AS obs_id,
       'S' || user_id AS symbol,
       CASE WHEN c.copy_no > 0 THEN 'Issuer ' || user_id || ' late'
            WHEN event_id % 5 = 0 THEN NULL
            WHEN event_id % 11 = 0 THEN 'Issuer ' || user_id || ' Holdings'
            ELSE 'Issuer ' || user_id END AS issue_name,
       CASE event_id % 6 WHEN 0 THEN 'Q' WHEN 1 THEN 'NASDAQ' WHEN 2 THEN 'N'
            WHEN 3 THEN 'A' WHEN 4 THEN 'AMEX' ELSE 'P' END AS market,
       CASE WHEN event_id % 37 = 0 THEN NULL
            ELSE CASE event_type WHEN 'signup' THEN 'LUDP' WHEN 'view' THEN 'T1' WHEN 'click' THEN 'H11'
                 WHEN 'error' THEN 'M' WHEN 'purchase' THEN 'T12' END END AS reason_code,
       CAST(NULL AS VARCHAR) AS resumption_reason_code,
       ts AS halt_start,
       c.halt_end,
       CASE WHEN c.copy_no = 3 THEN CAST(ts AS DATE) ELSE CAST(c.halt_end AS DATE) END AS resumption_date,
       CASE WHEN event_id % 2 = 0 OR event_id % 3 = 0 THEN strftime(c.halt_end, '%H:%M:%S.%f') END
           AS resumption_quote_time,
       CASE WHEN event_id % 3 <> 0 THEN strftime(c.halt_end, '%H:%M:%S.%f') END AS resumption_trade_time,
       CASE WHEN event_id % 4 <> 0 THEN value END AS pause_threshold_price,
       'tradehalts_' || strftime(ts, '%Y-%m-%d') || '.xml' AS source_file,
       'halt' AS source_type,
       c.copy_no
FROM (
  SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL
                 WHEN event_id % 7 = 1 THEN ts - INTERVAL 1 MINUTE
                 ELSE ts + to_seconds(CAST(round(value * 1200) AS BIGINT)) END AS base_end
  FROM events) e,
LATERAL (
  SELECT 0 AS copy_no, e.base_end AS halt_end
  UNION ALL SELECT 1, CASE WHEN e.event_id % 10 = 9 THEN e.base_end END WHERE e.event_id % 10 IN (0, 9)
  UNION ALL SELECT 2, e.ts + to_seconds(CAST(round(e.value * 1200) AS BIGINT) + 1800) WHERE e.event_id % 10 = 3
  UNION ALL SELECT 3, NULL WHERE e.event_id % 10 = 6) c
"""

VIEWS["unique_obs"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, halt_start, resumption_date, resumption_trade_time, reason_code
                               ORDER BY obs_id DESC) AS rn
  FROM halt_obs) WHERE rn = 1
"""

# Row by row: M = latest valid end so far; a row starting after M opens an
# episode the first time that M is seen.
VIEWS["labelled_obs"] = """
SELECT *, sum(brk) OVER (PARTITION BY symbol, nm ORDER BY halt_start, sort_end, obs_id ROWS UNBOUNDED PRECEDING) AS seq
FROM (
  SELECT *, CASE WHEN cand = 1 AND row_number() OVER (PARTITION BY symbol, nm, m, cand
                                                     ORDER BY halt_start, sort_end, obs_id) = 1
                 THEN 1 ELSE 0 END AS brk
  FROM (
    SELECT *, CASE WHEN halt_start > m THEN 1 ELSE 0 END AS cand
    FROM (
      SELECT *, max(vend) OVER (PARTITION BY symbol, nm ORDER BY halt_start, sort_end, obs_id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
      FROM (
        SELECT *, CASE WHEN halt_end >= halt_start THEN halt_end END AS vend,
               CASE WHEN halt_end >= halt_start THEN halt_end ELSE halt_start END AS sort_end,
               CASE market WHEN 'Q' THEN 'NASDAQ' WHEN 'N' THEN 'NYSE' WHEN 'A' THEN 'AMEX' ELSE upper(market) END AS nm
        FROM unique_obs))))
"""

VIEWS["episodes"] = """
SELECT symbol, nm AS market, min(halt_start) AS halt_start, max(vend) AS halt_end,
       first(issue_name ORDER BY halt_start, sort_end, obs_id) FILTER (WHERE issue_name IS NOT NULL) AS issue_name,
       CASE WHEN count(DISTINCT reason_code) = 1 THEN max(reason_code) END AS reason_code,
       coalesce(list_sort(list(DISTINCT reason_code) FILTER (WHERE reason_code IS NOT NULL)), []) AS reason_codes,
       first(pause_threshold_price ORDER BY halt_start, sort_end, obs_id)
           FILTER (WHERE pause_threshold_price IS NOT NULL) AS pause_threshold_price,
       CASE WHEN max(vend) IS NOT NULL THEN round(date_diff('microsecond', min(halt_start), max(vend)) / 6e7, 3) END
           AS duration_minutes,
       CASE WHEN max(vend) IS NULL THEN 'UNKNOWN'
            WHEN CAST(min(halt_start) AS DATE) <> CAST(max(vend) AS DATE) THEN 'MULTI_DAY'
            WHEN CAST(min(halt_start) AS TIME) <= TIME '16:00:00' AND CAST(max(vend) AS TIME) >= TIME '16:00:00' THEN 'YES'
            ELSE 'NO' END AS halt_close_status,
       count(*) AS observation_count,
       count(*) FILTER (WHERE halt_end < halt_start) AS invalid_end_count,
       min(obs_id) AS episode_id
FROM labelled_obs GROUP BY symbol, nm, seq
"""

VIEWS["membership"] = """
SELECT l.*, e.halt_start AS episode_start, e.episode_id
FROM (SELECT *, min(obs_id) OVER (PARTITION BY symbol, nm, seq) AS eid FROM labelled_obs) l
JOIN episodes e ON e.symbol = l.symbol AND e.market = l.nm AND e.episode_id = l.eid
"""

VIEWS["links"] = "SELECT DISTINCT episode_id, obs_id AS trade_halt_id FROM membership"

# What the feed can say of the second poll: the end only through its times, the
# last copy by name and end.
VIEWS["second_poll"] = """
SELECT * EXCLUDE (halt_end, e, rn), e AS halt_end FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, halt_start, resumption_date, resumption_trade_time, reason_code
                               ORDER BY issue_name DESC NULLS LAST, e DESC NULLS LAST) AS rn
  FROM (SELECT *, CASE WHEN coalesce(resumption_trade_time, resumption_quote_time) IS NOT NULL THEN halt_end END AS e
        FROM halt_obs WHERE hour(halt_start) >= 8)) WHERE rn = 1
"""
for _name, _where, _from in (
    ("stored", "hour(halt_start) < 16 AND copy_no = 0", "halt_obs"),
    ("incoming", "hour(halt_start) >= 8", "halt_obs"),
    ("incoming_dedup", "true", "second_poll"),
    ("all", "true", "halt_obs"),
):
    VIEWS[f"{_name}_canonical"] = f"""
SELECT symbol, market, halt_start, reason_code,
       last(issue_name ORDER BY obs_id) FILTER (WHERE issue_name IS NOT NULL) AS issue_name,
       last(pause_threshold_price ORDER BY obs_id) FILTER (WHERE pause_threshold_price IS NOT NULL)
           AS pause_threshold_price,
       first(source_file ORDER BY obs_id) AS source_file,
       bool_or(coalesce(halt_end < halt_start, false)) AND max(rk) = 0 AS clear_resumption,
       first(CASE WHEN rk > 0 THEN resumption_date END
             ORDER BY rk DESC, halt_end DESC NULLS LAST, resumption_date DESC NULLS LAST,
                      resumption_quote_time DESC NULLS LAST, resumption_trade_time DESC NULLS LAST) AS resumption_date,
       first(CASE WHEN rk > 0 THEN resumption_quote_time END
             ORDER BY rk DESC, halt_end DESC NULLS LAST, resumption_date DESC NULLS LAST,
                      resumption_quote_time DESC NULLS LAST, resumption_trade_time DESC NULLS LAST) AS resumption_quote_time,
       first(CASE WHEN rk > 0 THEN resumption_trade_time END
             ORDER BY rk DESC, halt_end DESC NULLS LAST, resumption_date DESC NULLS LAST,
                      resumption_quote_time DESC NULLS LAST, resumption_trade_time DESC NULLS LAST) AS resumption_trade_time
FROM (SELECT *, CASE WHEN halt_end >= halt_start THEN 2
                     WHEN halt_end IS NULL AND coalesce(CAST(resumption_date AS VARCHAR), resumption_quote_time,
                                                        resumption_trade_time) IS NOT NULL THEN 1
                     ELSE 0 END AS rk
      FROM {_from} WHERE {_where})
GROUP BY symbol, market, halt_start, reason_code
"""

VIEWS["all_halt_rows"] = "SELECT *, obs_id AS id FROM halt_obs"
VIEWS["halt_rows"] = "SELECT *, obs_id AS id FROM halt_obs WHERE copy_no = 0"

VIEWS["resumptions"] = """
SELECT id, symbol, market, halt_start,
       CASE WHEN k % 3 <> 0 THEN reason_code END AS reason_code,
       CASE WHEN k % 4 <> 0 THEN 'T3' END AS resumption_reason_code,
       CAST(later AS DATE) AS resumption_date,
       CASE WHEN k % 2 = 0 THEN strftime(later, '%H:%M:%S.%f') END AS resumption_quote_time,
       CASE WHEN k % 5 <> 0 THEN strftime(later, '%H:%M:%S.%f') END AS resumption_trade_time,
       'resumptions_' || strftime(later, '%Y-%m-%d') || '.xml' AS source_file,
       CASE WHEN k % 9 = 8 THEN 'halt' ELSE 'resumption' END AS source_type
FROM (SELECT *, id // 4 AS k, halt_end + to_seconds((id % 5 - 1) * 600) AS later FROM all_halt_rows
      WHERE halt_end IS NOT NULL)
"""

VIEWS["resumption_moments"] = """
SELECT *, CAST(CAST(resumption_date AS VARCHAR) || ' ' || coalesce(resumption_trade_time, resumption_quote_time)
               AS TIMESTAMP) AS moment
FROM resumptions
"""

VIEWS["requests"] = """
SELECT user_id * 1000000 + n AS request_id, 'S' || user_id AS ticker, d AS observation_date,
       CASE (user_id + n) % 3 WHEN 1 THEN 1 WHEN 2 THEN 36 END AS lookback_months,
       CASE (user_id + n) % 4 WHEN 0 THEN ['ALL'] WHEN 1 THEN ['LUDP'] WHEN 2 THEN ['LUDP', 'T1'] ELSE ['H11'] END
           AS reason_codes
FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d, date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS n
      FROM events)
"""

VIEWS["bars"] = """
SELECT ticker, CASE event_id % 4 WHEN 0 THEN 'Q' WHEN 1 THEN 'N' WHEN 3 THEN 'A' END AS market, bar_start, open, high, low, "close",
       volume, 'feed' || (event_id % 2) AS source, event_id
FROM (SELECT event_type || '-' || (user_id // 50) AS ticker, date_trunc('minute', ts) AS bar_start, min(event_id) AS event_id,
             first(value ORDER BY ts, event_id) AS open, max(value) * 1.02::DOUBLE AS high, min(value) * 0.97::DOUBLE AS low,
             last(value ORDER BY ts, event_id) AS "close", CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS volume
      FROM events GROUP BY 1, 2)
"""
VIEWS["stored_bars"] = "SELECT * FROM bars WHERE hour(bar_start) < 16"
VIEWS["incoming_bars"] = "SELECT * FROM bars WHERE hour(bar_start) >= 8"

VIEWS["filings"] = """
SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik,
       lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-24-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS accession_number,
       strftime(o_orderdate, '%Y-%m-%d') AS filing_date,
       CASE o_orderkey % 3 WHEN 1 THEN '8-K/A' ELSE '8-K' END AS form_type,
       CASE o_orderkey % 6 WHEN 0 THEN 'Item 1.01, Item 9.01' WHEN 1 THEN 'Item 3.02' WHEN 2 THEN 'Item 3.03'
            WHEN 3 THEN 'Item 5.03, Item 9.01' WHEN 4 THEN 'Item 8.01' ELSE '' END AS item_codes,
       'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '24'
           || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '/' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-24-'
           || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || '-index.htm' AS filing_index_url,
       o_orderkey AS k, o_totalprice AS price
FROM orders
"""

VIEWS["filing_texts"] = """
SELECT cik, accession_number, 'https://www.sec.gov/doc/' || k AS document_url, filing_date AS filed_date, form_type, k,
       concat(
         CASE WHEN k % 2 = 0 THEN 'The Company issued Series A Warrants to purchase up to an aggregate of ' || qty || ' shares. ' END,
         CASE WHEN k % 3 = 0 THEN 'It also issued Pre-Funded Warrants (the Prepaid) to purchase up to an aggregate of ' || qty || '  shares. ' END,
         CASE WHEN k % 4 = 0 THEN 'Each Series A Warrant has an exercise price of $' || cents || ' per share. ' END,
         CASE WHEN k % 5 = 0 THEN 'These may be exercised at a nominal exercise price of $0.001 per share. ' END,
         CASE WHEN k % 3 = 1 THEN 'They will expire five (' || (k % 9 + 1) || ') years from issuance. ' END,
         CASE WHEN k % 7 = 0 THEN 'A 1-for-' || (k % 40 + 2) || ' Reverse Stock Split became effective at 5:00 p.m. on '
              || 'January ' || (k % 28 + 1) || ', 2024. ' END,
         CASE WHEN k % 7 = 1 THEN 'The 1-for-10 reverse stock split is effective upon filing on Janvier 5, 2024. ' END,
         'End of report.') AS text
FROM (SELECT *, (whole // 1000 + 1) || ',' || lpad(CAST(whole % 1000 AS VARCHAR), 3, '0') AS qty,
             (k % 90 + 1) || '.' || lpad(CAST(whole % 100 AS VARCHAR), 2, '0') AS cents
      FROM (SELECT *, CAST(floor(price) AS BIGINT) AS whole FROM filings))
"""

# The documents an index page lists, by the rule that made the page.
VIEWS["filing_documents"] = """
SELECT accession_number, k, 1 AS seq, 'FORM 8-K' AS description, 'd' || k || '.htm' AS filename,
       'https://www.sec.gov/Archives/d' || k || '.htm' AS url, '8-K' AS exhibit_type, '10' AS size FROM filings
UNION ALL
SELECT accession_number, k, 2, CASE k % 3 WHEN 0 THEN 'FORM OF WARRANT' WHEN 1 THEN 'EXHIBIT 4.1' ELSE 'AGREEMENT & PLAN' END,
       'e' || k || '.htm', 'https://www.sec.gov/Archives/e' || k || '.htm',
       CASE k % 4 WHEN 0 THEN 'EX-4.1' WHEN 1 THEN 'ex-4' WHEN 2 THEN 'EX-10.1' ELSE 'EX-99' END, '10' FROM filings
UNION ALL
SELECT accession_number, k, 3, 'Purchase Warrant', 'w.htm', 'https://host.example/w.htm', 'EX-10.2', '10' FROM filings
"""

VIEWS["exhibits"] = """
SELECT f.cik, f.accession_number, f.filing_date, f.form_type, f.item_codes, f.filing_index_url,
       d.seq AS exhibit_seq, d.exhibit_type, d.description, d.url AS document_url, d.match_reason
FROM filings f JOIN warrant_documents d USING (accession_number)
WHERE contains(f.item_codes, '1.01') OR contains(f.item_codes, '3.02')
"""
VIEWS["warrant_documents"] = """
SELECT *, CASE WHEN lower(description) LIKE '%warrant%' AND upper(exhibit_type) LIKE 'EX-4%' THEN 'description+exhibit_type'
               WHEN lower(description) LIKE '%warrant%' THEN 'description' ELSE 'exhibit_type' END AS match_reason
FROM filing_documents WHERE lower(description) LIKE '%warrant%' OR upper(exhibit_type) LIKE 'EX-4%'
"""

VIEWS["facts"] = """
SELECT f.cik, x.taxonomy, x.concept, x.unit, CAST(x.v AS DOUBLE) AS fact_value, CAST(NULL AS VARCHAR) AS period_start,
       x.period_end, '10-Q' AS form, f.filing_date AS filed_date, f.accession_number, 2024 AS fiscal_year,
       'Q1' AS fiscal_period
FROM filings f, LATERAL (
  SELECT 'us-gaap' AS taxonomy, 'ClassOfWarrantOrRightOutstanding' AS concept, 'shares' AS unit, floor(f.price) AS v,
         '2024-03-31' AS period_end
  UNION ALL SELECT 'us-gaap', 'ClassOfWarrantOrRightOutstanding', 'shares', f.k, '2023-12-31'
  UNION ALL SELECT 'us-gaap', 'ClassOfWarrantOrRightExercisePrice', 'USD', f.k % 10, '2024-03-31'
  UNION ALL SELECT 'us-gaap', 'Assets', 'USD', floor(f.price), '2024-03-31'
  UNION ALL SELECT 'dei', 'EntityCommonStockSharesOutstanding', 'shares', floor(f.price), '2024-04-30'
  UNION ALL SELECT 'dei', 'EntityPublicFloat', 'USD', f.k, '2024-04-30') x
WHERE f.k % 11 <> 0
"""

VIEWS["terms"] = r"""
SELECT cik, accession_number, document_url, filed_date, form_type, k, 'share_quantity' AS kind,
       regexp_extract(sn, '([\w\-]+(?:\s+[\w\-]+){0,3})\s+[Ww]arrants?\s*(?:\([^)]*\)\s*)?to purchase', 1) AS label,
       CAST(replace(regexp_extract(sn, 'aggregate of ([\d,]+)', 1), ',', '') AS BIGINT) AS share_quantity,
       CAST(NULL AS DOUBLE) AS exercise_price, CAST(NULL AS INTEGER) AS expiration_years, sn AS raw_snippet
FROM (SELECT *, unnest(regexp_extract_all(text,
  '[\w\-]+(?:\s+[\w\-]+){0,3}\s+[Ww]arrants?\s*(?:\([^)]*\)\s*)?to purchase up to an aggregate of [\d,]+\s+shares')) AS sn
  FROM filing_texts)
UNION ALL
SELECT cik, accession_number, document_url, filed_date, form_type, k, 'exercise_price',
       regexp_extract(sn, '^(.*?)\s+[Ww]arrant\s+has an', 1), NULL,
       CAST(regexp_extract(sn, '\$([\d.]+)', 1) AS DOUBLE), NULL, sn
FROM (SELECT *, unnest(regexp_extract_all(text,
  '[\w\-]+(?:\s+[\w\-]+){0,3}\s+[Ww]arrant\s+has an exercise price of \$[\d.]+ per share')) AS sn FROM filing_texts)
UNION ALL
SELECT cik, accession_number, document_url, filed_date, form_type, k, 'exercise_price', 'Pre-Funded Warrant', NULL,
       CAST(regexp_extract(sn, '\$([\d.]+)', 1) AS DOUBLE), NULL, sn
FROM (SELECT *, unnest(regexp_extract_all(text, 'exercised at a nominal exercise price of \$[\d.]+ per share')) AS sn
      FROM filing_texts)
UNION ALL
SELECT cik, accession_number, document_url, filed_date, form_type, k, 'expiration_years', NULL, NULL, NULL,
       CAST(regexp_extract(sn, '\((\d+)\)', 1) AS INTEGER), sn
FROM (SELECT *, unnest(regexp_extract_all(text, 'will expire \w+ \(\d+\)\s*years? from issuance')) AS sn FROM filing_texts)
"""

VIEWS["splits"] = r"""
SELECT cik, accession_number, document_url, filed_date, form_type, k,
       CAST(regexp_extract(sn, '^(\d+)', 1) AS INTEGER) AS ratio_new,
       CAST(regexp_extract(sn, 'for-(\d+)', 1) AS INTEGER) AS ratio_old,
       CAST(try_strptime(nullif(regexp_extract(text, '(?i)effective\b.{0,60}?on ([A-Z][a-z]+ \d{1,2}, \d{4})', 1), ''),
                         '%B %d, %Y') AS DATE) AS effective_date, sn AS raw_snippet
FROM (SELECT *, regexp_extract(text, '(?i)\d+-for-\d+\s+reverse stock split') AS sn FROM filing_texts) WHERE sn <> ''
"""

VIEWS["companies"] = """
SELECT 'Global Trading ' || c_custkey || CASE c_custkey % 6 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Systems, Inc.'
         WHEN 2 THEN ' Corp' WHEN 3 THEN ' Systems LLC' WHEN 4 THEN ', Holdings' ELSE '' END AS name,
       lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer
UNION ALL
SELECT 'Global  Trading ' || s_suppkey || CASE s_suppkey % 2 WHEN 0 THEN ' Partners Co.' ELSE ' Systems Limited' END,
       lpad(CAST(s_suppkey + 5000000000 AS VARCHAR), 10, '0') FROM supplier
"""
VIEWS["tickers"] = """
SELECT CASE c_custkey % 2 WHEN 0 THEN 't' ELSE 'T' END || c_custkey AS ticker, c_custkey AS k FROM customer
"""
VIEWS["ticker_map"] = """
SELECT CASE c_custkey % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'X' ELSE 'Y' END || c_custkey AS ticker,
       lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer
"""
VIEWS["names"] = """
SELECT 'T' || c_custkey AS ticker,
       CASE WHEN c_custkey % 10 <> 7 THEN 'GLOBAL TRADING ' || c_custkey || CASE c_custkey % 5 WHEN 0 THEN ''
            WHEN 1 THEN ' Holdings Corp' WHEN 2 THEN ' Systems Partners' WHEN 3 THEN ' Systems' ELSE ' Inc' END END AS issue_name
FROM customer
"""

_NORM = (
    "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), "
    r"'[,.]?\s*(inc\.?|incorporated|corp\.?|corporation|co\.?|company|ltd\.?|limited|llc|holdings?|plc)\s*$', '', 'i'), "
    r"'[^\w\s]', '', 'g'), '\s+', ' ', 'g'))"
)


def norm_name(column: str) -> str:
    return _NORM.format(column)


VIEWS["norm_companies"] = f"SELECT DISTINCT name, cik, {_NORM.format('name')} AS n FROM companies"

# All pairs of names, the plain way.
VIEWS["name_matches"] = f"""
WITH t AS (SELECT DISTINCT issue_name AS issuer_name, {_NORM.format('issue_name')} AS n FROM names WHERE issue_name IS NOT NULL),
ex AS (SELECT t.issuer_name, count(*) AS c, min(x.cik) AS cik, min(x.name) AS company_name
       FROM t JOIN norm_companies x ON x.n = t.n GROUP BY 1),
pf AS (SELECT t.issuer_name, count(*) AS c, min(x.cik) AS cik, min(x.name) AS company_name
       FROM t JOIN norm_companies x ON x.n <> t.n AND (starts_with(x.n, t.n || ' ') OR starts_with(t.n, x.n || ' '))
       GROUP BY 1)
SELECT t.issuer_name,
       CASE WHEN coalesce(ex.c, 0) = 1 THEN ex.cik ELSE pf.cik END AS cik,
       CASE WHEN coalesce(ex.c, 0) = 1 THEN ex.company_name ELSE pf.company_name END AS company_name,
       CASE WHEN coalesce(ex.c, 0) = 1 THEN 'exact' ELSE 'prefix' END AS level
FROM t LEFT JOIN ex USING (issuer_name) LEFT JOIN pf USING (issuer_name)
WHERE coalesce(ex.c, 0) = 1 OR (coalesce(ex.c, 0) = 0 AND coalesce(pf.c, 0) = 1)
"""

# -- calendar -------------------------------------------------------------------

# Years of events and moved orders, and one on both sides.
VIEWS["calendar_years"] = """
SELECT least((SELECT min(year(ts)) FROM events), (SELECT min(year(o_orderdate)) + 25 FROM orders)) - 1 AS lo,
       greatest((SELECT max(year(ts)) FROM events), (SELECT max(year(o_orderdate)) + 25 FROM orders)) + 1 AS hi
"""
# Easter by Butcher's method with integer division.
VIEWS["rule_years"] = """
SELECT y, make_date(y, ((h + l - 7 * m + 114) // 31), ((h + l - 7 * m + 114) % 31) + 1) - 2 AS good_friday
FROM (SELECT *, (a + 11 * h + 22 * l) // 451 AS m
FROM (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - (c % 4)) % 7 AS l
FROM (SELECT *, (19 * a + b - b // 4 - ((b - (b + 8) // 25 + 1) // 3) + 15) % 30 AS h
FROM (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM (SELECT CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS y FROM calendar_years)))))
"""
VIEWS["closed_days"] = """
SELECT DISTINCT y, CAST(d AS DATE) AS d FROM (
  SELECT y, good_friday AS d FROM rule_years
  UNION ALL
  SELECT y, CASE dayofweek(x) WHEN 6 THEN x - 1 WHEN 0 THEN x + 1 ELSE x END FROM (
    SELECT y, make_date(y, 1, 1) AS x FROM rule_years UNION ALL SELECT y, make_date(y, 7, 4) FROM rule_years
    UNION ALL SELECT y, make_date(y, 12, 25) FROM rule_years
    UNION ALL SELECT y, make_date(y, 6, 19) FROM rule_years WHERE y >= 2022)
  UNION ALL
  SELECT y, d FROM (
    SELECT r.y, CAST(g.d AS DATE) AS d, month(g.d) AS mo, isodow(g.d) AS wd,
           row_number() OVER (PARTITION BY r.y, month(g.d), isodow(g.d) ORDER BY g.d) AS nth,
           row_number() OVER (PARTITION BY r.y, month(g.d), isodow(g.d) ORDER BY g.d DESC) AS from_end
    FROM rule_years r, LATERAL (SELECT unnest(generate_series(make_date(r.y, 1, 1), make_date(r.y, 12, 31), INTERVAL 1 DAY)) AS d) g)
  WHERE (mo = 1 AND wd = 1 AND nth = 3) OR (mo = 2 AND wd = 1 AND nth = 3) OR (mo = 5 AND wd = 1 AND from_end = 1)
     OR (mo = 9 AND wd = 1 AND nth = 1) OR (mo = 11 AND wd = 4 AND nth = 4))
"""
VIEWS["early_days"] = """
SELECT y, CAST(d AS DATE) AS d FROM (
  SELECT y, max(d) + 1 AS d FROM closed_days WHERE month(d) = 11 GROUP BY y
  UNION ALL SELECT y, make_date(y, 12, 24) FROM rule_years
  UNION ALL SELECT y, make_date(y, 7, 3) FROM rule_years WHERE isodow(make_date(y, 7, 4)) < 6)
WHERE (y, CAST(d AS DATE)) NOT IN (SELECT y, d FROM closed_days)
"""
VIEWS["calendar"] = """
SELECT d AS cal_date, is_session, close_minute,
       min(CASE WHEN is_session THEN d END) OVER (ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_session,
       count(CASE WHEN is_session THEN 1 END) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING)
         + CASE WHEN is_session THEN 0 ELSE 1 END AS next_seq
FROM (
  SELECT d, is_session, CASE WHEN NOT is_session THEN NULL WHEN e.dd IS NOT NULL THEN 780 ELSE 960 END AS close_minute
  FROM (SELECT g.d, isodow(g.d) < 6 AND c.dd IS NULL AS is_session
        FROM (SELECT CAST(unnest(generate_series(make_date(lo, 1, 1), make_date(hi, 12, 31), INTERVAL 1 DAY)) AS DATE) AS d FROM calendar_years) g
        LEFT JOIN (SELECT y AS yy, d AS dd FROM closed_days) c ON c.dd = g.d AND c.yy = year(g.d)) x
  LEFT JOIN (SELECT d AS dd FROM early_days) e ON e.dd = x.d)
"""
VIEWS["episode_days"] = """
SELECT e.*, c.cal_date AS trading_date, c.next_seq AS session_seq,
       e.halt_end IS NULL OR e.halt_end > c.cal_date + to_minutes(c.close_minute) AS at_close
FROM episodes e JOIN calendar c
  ON c.is_session AND c.cal_date >= CAST(e.halt_start AS DATE)
 AND c.cal_date <= greatest(CAST(e.halt_start AS DATE), coalesce(CAST(e.halt_end AS DATE), CAST(e.halt_start AS DATE)))
"""
VIEWS["halt_days"] = """
SELECT symbol, trading_date, session_seq, count(*) AS episode_count, bool_or(at_close) AS halted_at_close
FROM episode_days GROUP BY ALL
"""
VIEWS["request_windows"] = """
SELECT *, CASE WHEN lookback_months IS NOT NULL THEN CAST(observation_date - to_months(lookback_months) AS DATE) END AS lookback_start
FROM requests
"""
VIEWS["request_episode_days"] = """
SELECT r.request_id, r.observation_date, d.*
FROM request_windows r JOIN episode_days d ON d.symbol = r.ticker AND d.trading_date <= r.observation_date
 AND (r.lookback_start IS NULL OR d.trading_date >= r.lookback_start)
 AND (list_contains(r.reason_codes, 'ALL') OR list_contains(r.reason_codes, d.reason_code))
"""
VIEWS["request_days"] = """
SELECT request_id, observation_date, trading_date, session_seq, count(*) AS episode_count, bool_or(at_close) AS halted_at_close
FROM request_episode_days GROUP BY ALL
"""
VIEWS["request_blocks"] = """
SELECT request_id, min(trading_date) AS block_start, max(trading_date) AS block_end, count(*) AS block_length
FROM (SELECT *, session_seq - row_number() OVER (PARTITION BY request_id ORDER BY session_seq) AS isl FROM request_days)
GROUP BY request_id, isl HAVING count(*) >= 2
"""
VIEWS["metrics"] = """
SELECT r.request_id, r.ticker, r.observation_date, r.lookback_start, r.observation_date AS lookback_end,
       array_to_string(r.reason_codes, '|') AS reason_codes,
       coalesce(ce.n, 0) AS core_episode_count,
       coalesce(d.n, 0) AS metric_1,
       round(d.eps / d.n, 6) AS metric_2,
       date_diff('day', d.last_day, r.observation_date) AS metric_3,
       round(g.gap, 6) AS metric_4,
       CASE WHEN coalesce(b.n, 0) > 0 THEN 'Yes' ELSE 'No' END AS metric_5,
       coalesce(b.n, 0) AS metric_6,
       round(b.avg_len, 6) AS metric_7,
       b.max_len AS metric_8,
       coalesce(d.closes, 0) AS metric_9,
       CASE WHEN d.on_t IS NOT NULL THEN 'Yes' ELSE 'No' END AS metric_10,
       coalesce(d.on_t, 0) AS metric_11
FROM request_windows r
LEFT JOIN (SELECT request_id, count(*) AS n, sum(episode_count)::DOUBLE AS eps, max(trading_date) AS last_day,
                  count(*) FILTER (WHERE halted_at_close) AS closes,
                  max(episode_count) FILTER (WHERE trading_date = observation_date) AS on_t
           FROM request_days GROUP BY 1) d USING (request_id)
LEFT JOIN (SELECT request_id, avg(date_diff('day', p, trading_date)) AS gap
           FROM (SELECT request_id, trading_date, lag(trading_date) OVER (PARTITION BY request_id ORDER BY trading_date) AS p
                 FROM request_days) WHERE p IS NOT NULL GROUP BY 1) g USING (request_id)
LEFT JOIN (SELECT request_id, count(*) AS n, avg(block_length) AS avg_len, max(block_length) AS max_len
           FROM request_blocks GROUP BY 1) b USING (request_id)
LEFT JOIN (SELECT request_id, count(DISTINCT episode_id) AS n FROM request_episode_days GROUP BY 1) ce USING (request_id)
"""

VIEWS["weekday_days"] = """
SELECT e.*, g.d AS trading_date,
  (CASE WHEN CAST(e.halt_start AS DATE) < g.d THEN TIME '00:00:00' ELSE CAST(e.halt_start AS TIME) END <= TIME '16:00:00')
  AND (e.halt_end IS NULL OR CAST(e.halt_end AS DATE) > g.d OR CAST(e.halt_end AS TIME) >= TIME '16:00:00') AS in_force
FROM episodes e, LATERAL (
  SELECT CAST(unnest(generate_series(CAST(e.halt_start AS DATE), coalesce(CAST(e.halt_end AS DATE), CAST(e.halt_start AS DATE)),
         INTERVAL 1 DAY)) AS DATE) AS d) g
WHERE e.halt_end IS NULL OR isodow(g.d) < 6
"""
VIEWS["daily"] = """
SELECT symbol, trading_date, 'YES' AS halt_present, count(*) AS episode_count,
       CASE WHEN bool_or(in_force) THEN 'YES' ELSE 'NO' END AS halt_at_close
FROM weekday_days GROUP BY symbol, trading_date
"""
VIEWS["file_days"] = """
SELECT DISTINCT CAST(substr(source_file, 12, 10) AS DATE) AS trading_date FROM halt_obs
WHERE isodow(CAST(substr(source_file, 12, 10) AS DATE)) < 6
"""

_REF = {name: re.compile(rf"\b{name}\b") for name in VIEWS}


def with_views(sql: str) -> str:
    """Prefix ``sql`` with every view it mentions, directly or through another view."""
    needed: list[str] = []

    def visit(body: str, own: str | None) -> None:
        for name, pattern in _REF.items():
            if name != own and name not in needed and pattern.search(body):
                visit(VIEWS[name], name)
                if name not in needed:
                    needed.append(name)

    visit(sql, None)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({VIEWS[name].strip()})" for name in needed)
    return f"WITH {ctes}\n{sql.strip()}"
