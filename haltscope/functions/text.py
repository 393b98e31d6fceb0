"""Text expressions for filings: markup stripping, name and address shaping.

Patterns start with ``(?U)`` so that word, digit and space classes cover
Unicode (U+00A0 and accented letters included).
"""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Base address of the public filings archive.
ARCHIVE_HOST = "https://www.sec.gov"

# Legal suffixes removed from the end of a company name.
COMPANY_SUFFIXES = (
    r"inc\.?|incorporated|corp\.?|corporation|co\.?|company|ltd\.?|limited|llc|holdings?|plc"
)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    # The full named-entity table exists only in the Python standard library.
    return texts.map(html.unescape, na_action="ignore")


# For a column that several conditions read: the optimizer must not copy the call into each of them.
unescape_once = _unescape.asNondeterministic()


# A reference with its semicolon; ``&amp`` is one without it too.
_CLOSED = re.compile(r"&(?:amp(?!;)|[^\t\n\f <&;]{1,32};)")


def _closed_reference(found: re.Match) -> str:
    name = found[0][1:]
    return html.unescape(found[0]) if name in html5 or name[0] == "#" else found[0]


@F.pandas_udf(StringType())
def _unescape_closed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _CLOSED.sub(_closed_reference, t), na_action="ignore")


def html_to_text(content: Column | str, closed: bool = False) -> Column:
    """Tags to blanks, entities decoded, whitespace collapsed and trimmed.

    HTML also decodes old names that lost their semicolon (``&quot p``). With ``closed``
    these stay as they are, but for ``&amp``: a name that the end of a page cuts off is no entity.
    """
    bare = F.regexp_replace(_c(content), r"<[^>]+>", " ")
    decoded = _unescape_closed(bare) if closed else _unescape(bare)
    # \x1c-\x1f count as blanks too, next to Unicode White_Space.
    collapsed = F.regexp_replace(decoded, r"(?U)[\s\x1c-\x1f]+", " ")
    return F.trim(collapsed)


def normalize_company_name(name: Column | str) -> Column:
    """Lower case, one legal suffix off the end, punctuation out, blanks collapsed."""
    n = F.lower(F.regexp_replace(_c(name), r"(?U)^\s+|\s+$", ""))
    n = F.regexp_replace(n, rf"(?iU)[,.]?\s*({COMPANY_SUFFIXES})\s*$", "")
    n = F.regexp_replace(n, r"(?U)[^\w\s]", "")
    return F.trim(F.regexp_replace(n, r"(?U)\s+", " "))


def filing_url(issuer_id: Column | str, accession: Column | str) -> Column:
    """Index address of a filing; NULL unless both parts are present."""
    issuer_id, accession = F.nullif(_c(issuer_id), F.lit("")), F.nullif(_c(accession), F.lit(""))
    return F.concat(
        F.lit(f"{ARCHIVE_HOST}/Archives/edgar/data/"),
        issuer_id.try_cast("bigint").cast("string"),
        F.lit("/"),
        F.replace(accession, F.lit("-"), F.lit("")),
        F.lit("/"),
        accession,
        F.lit("-index.htm"),
    )


def unwrap_viewer_url(url: Column | str, host: str = ARCHIVE_HOST) -> Column:
    """Drop the inline-viewer prefix, make site-relative addresses absolute."""
    bare = F.regexp_replace(_c(url), r"^/ix\?doc=", "")
    return F.when(bare.startswith("/"), F.concat(F.lit(host), bare)).otherwise(bare)
