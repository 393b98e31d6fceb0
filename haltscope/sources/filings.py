"""Filing feeds and pages: Atom entries, index pages, company search pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haltscope.functions.text import unescape_once, unwrap_viewer_url

ATOM_CONTENT = (
    "content struct<`accession-number`: string, `filing-date`: string, `filing-type`: string,"
    " `items-desc`: string, `filing-href`: string>"
)

# Markup around a document table, its rows and cells, and around
# the names and ids on a company search page.
DOCUMENT_TABLE = r"(?is)<table\b[^>]*class\s*=\s*[\"'][^\"']*tableFile[^\"']*[\"'][^>]*>(.*?)</table"
TABLE_ROW = r"(?is)<tr\b[^>]*>(.*?)</tr"
TABLE_CELL = r"(?is)<td\b[^>]*>(.*?)</td"
CELL_LINK = r"(?is)^.*<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"
SINGLE_COMPANY = (
    r'(?s)<span class="companyName">(.*?)<acronym title="Central Index Key">CIK</acronym>#:.*?CIK=(\d{10})'
)
COMPANY_ROW = r"(?s)(<tr>.*?</tr>)"
ROW_CIK = r"CIK=(\d{10})"
ROW_NAME = r'(?s)<td scope="row">(.+?)<br'


_SEP = "\x01"


def filings_from_entries(entries: DataFrame) -> DataFrame:
    """Entries with a ``content`` struct -> filings; entries without content drop out."""
    c = F.col("content")
    return entries.filter(c.isNotNull()).select(
        c["accession-number"].alias("accession_number"),
        c["filing-date"].alias("filing_date"),
        c["filing-type"].alias("form_type"),
        F.coalesce(c["items-desc"], F.lit("")).alias("item_codes"),
        c["filing-href"].alias("filing_index_url"),
    )


def scan_filings_feed(spark: SparkSession, path: str) -> DataFrame:
    entries = spark.read.format("xml").option("rowTag", "entry").schema(ATOM_CONTENT).load(path)
    return filings_from_entries(entries)


def filing_documents(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Index pages -> one row per listed document; other columns are carried along.

    Rows with fewer than five cells, without a link or without a numeric
    sequence are dropped.
    """
    keep = [c for c in pages.columns if c != html_col]
    tables = pages.filter(F.col(html_col).contains("tableFile")).select(
        *keep, F.explode(F.regexp_extract_all(html_col, F.lit(DOCUMENT_TABLE), F.lit(1))).alias("_table")
    )
    # Cells are cut inside the array of rows, so that no filter can bring the patterns a second time.
    cut = F.transform(F.regexp_extract_all("_table", F.lit(TABLE_ROW), F.lit(1)), lambda r: F.regexp_extract_all(r, F.lit(TABLE_CELL), F.lit(1)))
    cells = tables.select(*keep, F.explode(F.filter(cut, lambda c: F.size(c) >= 5)).alias("_c"))

    # The five cells and the link travel as one text, so each row meets Python once.
    link = F.regexp_extract(F.get("_c", F.lit(2)), CELL_LINK, 1)
    packed = F.concat_ws(_SEP, *[F.get("_c", F.lit(i)) for i in range(5)])
    bare = F.regexp_replace(packed, r"(?s)<!--.*?-->|<[^>]*>", "")
    row = cells.select(*keep, F.split(unescape_once(F.concat_ws(_SEP, bare, link)), _SEP, -1).alias("_f"))

    def text(i: int) -> Column:
        return F.regexp_replace(F.get("_f", F.lit(i)), r"(?U)^\s+|\s+$", "")

    shaped = row.select(
        *keep,
        text(0).alias("_seq"),
        text(1).alias("description"),
        text(2).alias("filename"),
        unwrap_viewer_url(F.nullif(F.get("_f", F.lit(5)), F.lit(""))).alias("url"),
        text(3).alias("exhibit_type"),
        text(4).alias("size"),
    )
    return shaped.filter(F.col("url").isNotNull() & F.col("_seq").rlike(r"^\d+$")).select(
        *keep,
        F.col("_seq").cast("int").alias("seq"),
        "description",
        "filename",
        "url",
        "exhibit_type",
        "size",
    )


def company_search_results(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Search pages -> (name, cik): the single-company layout if present, or else the table's rows."""
    keep = [c for c in pages.columns if c != html_col]
    page = F.col(html_col)
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    single = F.struct(
        trim(F.regexp_extract(page, SINGLE_COMPANY, 1)).alias("name"),
        F.regexp_extract(page, SINGLE_COMPANY, 2).alias("cik"),
    )
    listed = F.filter(
        F.transform(
            F.regexp_extract_all(page, F.lit(COMPANY_ROW), F.lit(1)),
            lambda row: F.struct(
                trim(F.regexp_extract(row, ROW_NAME, 1)).alias("name"),
                F.regexp_extract(row, ROW_CIK, 1).alias("cik"),
            ),
        ),
        lambda hit: (hit["cik"] != "") & (hit["name"] != ""),
    )
    hits = F.when(F.regexp_extract(page, SINGLE_COMPANY, 2) != "", F.array(single)).otherwise(listed)
    return pages.select(*keep, F.explode(hits).alias("_h")).select(
        *keep, F.col("_h.name").alias("name"), F.col("_h.cik").alias("cik")
    )
