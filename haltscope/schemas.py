"""Column contracts of the stored tables.

Naive exchange-local moments are TIMESTAMP_NTZ, instants are TIMESTAMP. A halt's
date and time live in one ``halt_start`` column; resumption times keep their
source text ('HH:mm:ss[.ffffff]').
"""

from __future__ import annotations

# The feed's own item, as text.
FEED_FIELDS = (
    "IssueSymbol",
    "IssueName",
    "Mkt",
    "Market",
    "ReasonCode",
    "PauseThresholdPrice",
    "HaltDate",
    "HaltTime",
    "ResumptionDate",
    "ResumptionQuoteTime",
    "ResumptionTradeTime",
)
FEED_PREFIX = "ndaq:"
FEED_ITEM = ", ".join(f"`{FEED_PREFIX}{name}` string" for name in FEED_FIELDS)

TRADE_HALT = (
    "symbol string, issue_name string, market string, reason_code string, halt_start timestamp_ntz,"
    " resumption_date date, resumption_quote_time string, resumption_trade_time string,"
    " pause_threshold_price decimal(18,6), source_file string, loaded_at timestamp"
)
RESUMPTION = (
    "symbol string, market string, halt_start timestamp_ntz, reason_code string,"
    " resumption_reason_code string, resumption_date date, resumption_quote_time string,"
    " resumption_trade_time string, source_file string, collected_at timestamp"
)
HALT_EPISODE = (
    "trade_halt_id bigint, collector_episode_id string, symbol string, issue_name string, market string,"
    " reason_code string, halt_start timestamp_ntz, halt_end timestamp_ntz,"
    " duration_minutes decimal(12,3), halt_close_status string"
)
HALT_EPISODE_EVENT = "episode_id bigint, trade_halt_id bigint"
RAW_BAR = (
    "ticker string, market string, bar_start timestamp_ntz, open decimal(18,6), high decimal(18,6),"
    " low decimal(18,6), close decimal(18,6), volume bigint, source string"
)
CORE_BAR = (
    "ticker string, market string, bar_start timestamp_ntz, open decimal(18,6), high decimal(18,6),"
    " low decimal(18,6), close decimal(18,6), volume bigint, security_id string, market_scope string,"
    " session string, transaction_count bigint, source_provider string, source_dataset string,"
    " dataset_version string, ingestion_run_id string"
)
FACT = (
    "cik string, concept string, unit string, fact_value double, period_start string, period_end string,"
    " form string, filed_date string, accession_number string, fiscal_year int, fiscal_period string,"
    " retrieved_at timestamp"
)
EXHIBIT = (
    "cik string, accession_number string, filing_date string, form_type string, item_codes string,"
    " exhibit_seq int, exhibit_type string, description string, document_url string,"
    " filing_index_url string, match_reason string"
)
DIRECTORY = (
    "symbol string, source_file string, security_name string, exchange string, test_issue string,"
    " round_lot_size int, etf string, payload map<string,string>, retrieved_at timestamp"
)
TERM = (
    "cik string, accession_number string, document_url string, filed_date string, form_type string,"
    " kind string, label string, share_quantity bigint, exercise_price double, expiration_years int,"
    " raw_snippet string, extraction_method string"
)
RESOLUTION = (
    "ticker string, cik string, resolution_method string, issuer_name_used string, matched_name string,"
    " retrieved_at timestamp"
)
REVERSE_SPLIT = (
    "cik string, accession_number string, document_url string, filed_date string, form_type string,"
    " ratio_new int, ratio_old int, effective_date date, raw_snippet string"
)
REQUEST = "request_id bigint, ticker string, observation_date date, lookback_months int, reason_codes array<string>"

CSV_BAR = (
    "ticker string, market string, bar_start timestamp_ntz, open double, high double, low double,"
    " close double, volume bigint"
)
FLATFILE_BAR = (
    "ticker string, volume double, open double, close double, high double, low double,"
    " window_start bigint, transactions double"
)
