"""Cleaning and merge-rule expressions. Every function maps columns to a column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from haltscope.functions.times import micros_between

# Venue code -> canonical venue name.
MARKET_NAMES = {
    "Q": "NASDAQ",
    "NASDAQ": "NASDAQ",
    "N": "NYSE",
    "NYSE": "NYSE",
    "A": "AMEX",
    "AMEX": "AMEX",
}

# Canonical venue name -> code used in raw halt rows.
RAW_MARKET_CODES = {"NASDAQ": "Q", "NYSE": "N", "AMEX": "A"}

# Allowed close-status labels.
CLOSE_STATUSES = ("YES", "NO", "UNKNOWN", "MULTI_DAY")
FINAL_CLOSE_STATUSES = ("YES", "NO", "MULTI_DAY")


# The characters with Unicode's White_Space property.
_WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_lookup(c: Column, mapping: dict) -> Column:
    """``mapping[c]`` as a codegen-friendly CASE, NULL when absent."""
    items = list(mapping.items())
    out = F.when(c == F.lit(items[0][0]), F.lit(items[0][1]))
    for key, value in items[1:]:
        out = out.when(c == F.lit(key), F.lit(value))
    return out


def blank_to_null(c: Column | str) -> Column:
    """Trim; an empty text becomes NULL."""
    # One short expression: a pattern here, in eleven fields of a feed, makes generated code too long to compile.
    return F.nullif(F.btrim(as_col(c), F.lit(_WHITE_SPACE)), F.lit(""))


def normalize_market(c: Column | str) -> Column:
    upper = F.upper(as_col(c))
    return F.coalesce(literal_lookup(upper, MARKET_NAMES), upper)


def raw_market_code(c: Column | str) -> Column:
    """Canonical venue name back to the code raw rows carry."""
    return F.coalesce(literal_lookup(as_col(c), RAW_MARKET_CODES), as_col(c))


def normalize_ticker(c: Column | str) -> Column:
    return F.upper(F.trim(as_col(c)))


def split_tickers(c: Column | str) -> Column:
    """Comma list -> array of upper-cased tickers, blanks dropped."""
    parts = F.transform(F.split(as_col(c), ","), lambda t: F.upper(F.trim(t)))
    return F.filter(parts, lambda t: t != "")


def issuer_id_pad(c: Column | str) -> Column:
    """Zero-pad an issuer id to ten digits (longer ids are kept whole)."""
    text = as_col(c).cast("string")
    return F.when(F.length(text) >= 10, text).otherwise(F.lpad(text, 10, "0"))


def safe_ratio(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0).cast("double"))


def round_half_even_long(c: Column | str) -> Column:
    return F.bround(as_col(c).cast("double"), 0).cast("long")


def parse_decimal(c: Column | str) -> Column:
    return F.trim(as_col(c)).try_cast("decimal(18,6)")


def int_or_null(c: Column | str) -> Column:
    return F.trim(as_col(c)).try_cast("int")


# -- halt rules -----------------------------------------------------------

def valid_end(start: Column | str, end: Column | str) -> Column:
    """An end before its start never closes a halt."""
    start, end = as_col(start), as_col(end)
    return F.when(end >= start, end)


def duration_minutes(start: Column | str, end: Column | str) -> Column:
    start, end = as_col(start), as_col(end)
    return F.when(end >= start, F.round(micros_between(start, end) / F.lit(6e7), 3))


def close_status(start: Column | str, end: Column | str, market_close: str = "16:00:00") -> Column:
    """Was the halt in force at the nominal close? Both ends inclusive; early closes ignored."""
    start, end = as_col(start), as_col(end)
    close_ts = F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit(f" {market_close}")).cast("timestamp_ntz")
    return (
        F.when(start.isNull() | end.isNull(), F.lit("UNKNOWN"))
        .when(F.to_date(start) != F.to_date(end), F.lit("MULTI_DAY"))
        .when((start <= close_ts) & (close_ts <= end), F.lit("YES"))
        .otherwise(F.lit("NO"))
    )


def prefer_new(old: Column | str, new: Column | str) -> Column:
    """NULL never erases a known value."""
    return F.coalesce(as_col(new), as_col(old))


def prefer_close_status(old: Column | str, new: Column | str) -> Column:
    """UNKNOWN never replaces a final status; NULL keeps the old one."""
    old, new = as_col(old), as_col(new)
    keep_old = new.isNull() | ((new == "UNKNOWN") & F.coalesce(old.isin(*FINAL_CLOSE_STATUSES), F.lit(False)))
    return F.when(keep_old, old).otherwise(new)


def validated_close_status(c: Column | str) -> Column:
    """Upper-cased status; anything outside the enumeration fails the job."""
    value = F.upper(blank_to_null(c))
    message = F.concat(F.lit("unknown close status: "), value)
    return F.when(value.isNull() | value.isin(*CLOSE_STATUSES), value).otherwise(
        F.raise_error(message).cast("string")
    )


def is_changed(pairs: list[tuple[Column, Column]]) -> Column:
    """True when any (old, new) pair is distinct, NULL counting as a value."""
    out = F.lit(False)
    for old, new in pairs:
        out = out | ~old.eqNullSafe(new)
    return out


def resumption_rank(start, end, res_date, quote_time, trade_time) -> Column:
    """Sortable quality of one resumption block.

    2 = usable end, latest wins; 1 = partial information; 0 = none, or an end
    before the start.
    """
    start, end = as_col(start), as_col(end)
    res_date, quote_time, trade_time = as_col(res_date), as_col(quote_time), as_col(trade_time)
    partial = res_date.isNotNull() | quote_time.isNotNull() | trade_time.isNotNull()
    rank = (
        F.when(end >= start, F.lit(2))
        .when(end.isNull() & partial, F.lit(1))
        .otherwise(F.lit(0))
    )
    usable = rank > 0
    return F.struct(
        rank.alias("rank"),
        F.when(usable, end).alias("end"),
        F.when(usable, res_date).alias("res_date"),
        F.when(usable, quote_time).alias("quote"),
        F.when(usable, trade_time).alias("trade"),
    )
