"""Filings: candidates, exhibits, facts, warrant terms, reverse splits, diagnostics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from haltscope.functions import terms as P
from haltscope.functions.clean import literal_lookup
from haltscope.functions.text import filing_url
from haltscope.operators.scaling import spread_join
from haltscope.sources.filings import filing_documents

# Item numbers, exhibit prefixes and fact names that select filings.
WARRANT_ITEMS = ("1.01", "3.02")
SPLIT_ITEMS = ("3.03", "5.03")
EXHIBIT_PREFIX = "EX-"
WARRANT_EXHIBIT_PREFIX = "EX-4"
WARRANT_TAXONOMY, WARRANT_CONCEPT_PREFIX = "us-gaap", "ClassOfWarrantOrRight"
SHARES_TAXONOMY, SHARES_CONCEPT = "dei", "EntityCommonStockSharesOutstanding"
# Names of the tables that a row of the diagnostics comes from.
WARRANT_SOURCE, SHARES_SOURCE = "warrant", "shares_outstanding"
EXHIBIT_SOURCE, TERM_SOURCE = "8k_warrant_exhibit", "8k_warrant_text_extraction"

FACTS_SCHEMA = (
    "struct<facts: map<string, map<string, struct<units: map<string, array<struct<"
    "start: string, `end`: string, val: double, accn: string, fy: int, fp: string,"
    " form: string, filed: string>>>>>>>"
)

# The columns of the diagnostics.
DIAGNOSTIC_COLUMNS = [
    "ticker", "cik", "source_table", "concept", "description", "unit", "value", "period_start",
    "period_end", "form", "filed_date", "accession_number", "filing_url", "raw_snippet",
    "match_reason", "extraction_method",
]


def candidate_filings(filings: DataFrame, items: tuple[str, ...] = WARRANT_ITEMS) -> DataFrame:
    """Filings whose item text mentions any of the item numbers."""
    mentions = [F.coalesce("item_codes", F.lit("")).contains(code) for code in items]
    return filings.filter(reduce(lambda a, b: a | b, mentions))


def warrant_exhibits(documents: DataFrame) -> DataFrame:
    """Documents that look like warrants, with the signal that matched."""
    by_text = F.coalesce(F.col("description").rlike("(?i)warrant"), F.lit(False))
    by_type = F.coalesce(F.upper("exhibit_type").startswith(WARRANT_EXHIBIT_PREFIX), F.lit(False))
    why = F.concat_ws("+", F.when(by_text, F.lit("description")), F.when(by_type, F.lit("exhibit_type")))
    return documents.filter(by_text | by_type).withColumn("match_reason", why)


def main_documents(documents: DataFrame, key: str = "accession_number") -> DataFrame:
    """Per filing the non-exhibit document with the lowest sequence number."""
    bodies = documents.filter(~F.coalesce(F.upper("exhibit_type"), F.lit("")).startswith(EXHIBIT_PREFIX))
    rest = [c for c in documents.columns if c != key]
    picked = bodies.groupBy(key).agg(F.min_by(F.struct(*rest), "seq").alias("_d"))
    return picked.select(key, *[F.col(f"_d.{c}").alias(c) for c in rest])


def texts_of(filings: DataFrame, texts: DataFrame) -> DataFrame:
    """Pages or texts of some filings: to be taken before they are parsed."""
    return texts.join(filings.select("accession_number"), "accession_number", "left_semi")


def exhibit_rows(filings: DataFrame, documents: DataFrame) -> DataFrame:
    """Warrant exhibits of candidate filings in the stored shape."""
    docs = warrant_exhibits(documents).select(
        "accession_number",
        F.col("seq").alias("exhibit_seq"),
        "exhibit_type",
        "description",
        F.col("url").alias("document_url"),
        "match_reason",
    )
    return candidate_filings(filings).filter(F.col("filing_index_url").isNotNull()).join(docs, "accession_number")


def exhibits_of_pages(filings: DataFrame, pages: DataFrame) -> DataFrame:
    """:func:`exhibit_rows` from index pages (accession_number, html).

    A page meets its filing before it is parsed and takes the filing's columns along: one join,
    in which pages stream past a hashed table of the candidates, as sorted pages would fill memory.
    """
    wanted = candidate_filings(filings).filter(F.col("filing_index_url").isNotNull())
    packed = wanted.select("accession_number", F.struct(*[c for c in wanted.columns if c != "accession_number"]).alias("_filing"))
    found = pages.select("accession_number", "html").join(packed.hint("shuffle_hash"), "accession_number")
    return warrant_exhibits(filing_documents(found)).select(
        "accession_number",
        "_filing.*",
        F.col("seq").alias("exhibit_seq"),
        "exhibit_type",
        "description",
        F.col("url").alias("document_url"),
        "match_reason",
    )


# -- facts -------------------------------------------------------------------

def parse_facts(docs: DataFrame, json_col: str) -> DataFrame:
    return docs.withColumn("_doc", F.from_json(json_col, FACTS_SCHEMA))


def explode_facts(docs: DataFrame, taxonomy: str, concept: Column, json_col: str = "facts_json") -> DataFrame:
    """One row per (concept, unit, entry) of one taxonomy.

    ``concept`` is a condition on the column ``concept``; both the taxonomy and
    the concept are decided before the entries are unfolded.
    """
    keep = [c for c in docs.columns if c != json_col]
    concepts = parse_facts(docs, json_col).select(
        *keep, F.explode(F.col("_doc.facts")[taxonomy]).alias("concept", "_body")
    ).filter(concept)
    return _fact_entries(concepts, keep)


def _fact_entries(concepts: DataFrame, keep: list[str]) -> DataFrame:
    """Concepts with their ``_body`` -> one row per unit and entry."""
    units = concepts.select(*keep, "concept", F.explode("_body.units").alias("unit", "_entries"))
    entries = units.select(*keep, "concept", "unit", F.explode("_entries").alias("_e"))
    return entries.select(
        *keep,
        "concept",
        "unit",
        F.col("_e.val").alias("fact_value"),
        F.col("_e.start").alias("period_start"),
        F.col("_e.end").alias("period_end"),
        F.col("_e.form").alias("form"),
        F.col("_e.filed").alias("filed_date"),
        F.col("_e.accn").alias("accession_number"),
        F.col("_e.fy").alias("fiscal_year"),
        F.col("_e.fp").alias("fiscal_period"),
    )


def warrant_facts(docs: DataFrame, json_col: str = "facts_json") -> DataFrame:
    return explode_facts(docs, WARRANT_TAXONOMY, F.col("concept").startswith(WARRANT_CONCEPT_PREFIX), json_col)


def shares_facts(docs: DataFrame, json_col: str = "facts_json") -> DataFrame:
    return explode_facts(docs, SHARES_TAXONOMY, F.col("concept") == SHARES_CONCEPT, json_col)


# -- text --------------------------------------------------------------------

def _term(kind: str, label: Column, value: Column, snippet: Column) -> Column:
    def only(k: str, cast: str) -> Column:
        return (value if k == kind else F.lit(None)).try_cast(cast).alias(k)

    return F.struct(
        F.lit(kind).alias("kind"),
        label.cast("string").alias("label"),
        only("share_quantity", "bigint"),
        only("exercise_price", "double"),
        only("expiration_years", "int"),
        snippet.alias("raw_snippet"),
    )


def quantity_terms(text: Column) -> Column:
    return F.transform(
        P.find_all(text, P.QUANTITY, P.QUANTITY_HINT),
        lambda s: _term(
            "share_quantity",
            P.group_of(s, P.QUANTITY, 1),
            F.regexp_replace(P.group_of(s, P.QUANTITY, 2), ",", ""),
            s,
        ),
    )


def price_terms(text: Column) -> Column:
    return F.transform(
        P.find_all(text, P.EXERCISE_PRICE, P.PRICE_HINT),
        lambda s: _term("exercise_price", P.group_of(s, P.EXERCISE_PRICE, 1), P.group_of(s, P.EXERCISE_PRICE, 2), s),
    )


def nominal_price_terms(text: Column) -> Column:
    return F.transform(
        P.find_all(text, P.NOMINAL_PRICE, P.NOMINAL_HINT),
        lambda s: _term("exercise_price", F.lit(P.NOMINAL_LABEL), P.group_of(s, P.NOMINAL_PRICE, 1), s),
    )


def expiration_terms(text: Column) -> Column:
    return F.transform(
        P.find_all(text, P.EXPIRATION, P.EXPIRATION_HINT),
        lambda s: _term("expiration_years", F.lit(None), P.group_of(s, P.EXPIRATION, 1), s),
    )


def warrant_terms(docs: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = P.TERM_KINDS) -> DataFrame:
    """One row per term found in each document, in one pass over the table."""
    text = F.col(text_col)
    empty = F.array().cast(
        "array<struct<kind:string,label:string,share_quantity:bigint,exercise_price:double,"
        "expiration_years:int,raw_snippet:string>>"
    )
    found = []
    if "share_quantity" in kinds:
        found.append(quantity_terms(text))
    if "exercise_price" in kinds:
        found += [price_terms(text), nominal_price_terms(text)]
    if "expiration_years" in kinds:
        found.append(expiration_terms(text))
    keep = [c for c in docs.columns if c != text_col]
    every = F.concat(*[F.coalesce(f, empty) for f in found])
    return docs.select(*keep, F.explode(every).alias("_t")).select(
        *keep, "_t.*", F.lit("regex").alias("extraction_method")
    )


def reverse_splits(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """First split ratio of each document with its effective date; no ratio, no row."""
    text = F.col(text_col)
    keep = [c for c in docs.columns if c != text_col]
    hinted = docs.filter(F.lower(text).contains("reverse stock split") | F.lower(text).contains("-for-"))
    found = hinted.withColumn("raw_snippet", P.split_ratio(text, 0)).filter(F.col("raw_snippet") != "")
    return found.select(
        *keep,
        P.split_ratio(F.col("raw_snippet"), 1).try_cast("int").alias("ratio_new"),
        P.split_ratio(F.col("raw_snippet"), 2).try_cast("int").alias("ratio_old"),
        P.split_effective_date(text).alias("effective_date"),
        "raw_snippet",
    )


def term_rows(filings: DataFrame, main_texts: DataFrame) -> DataFrame:
    """Terms of candidate filings' main documents (accession_number, document_url, text)."""
    wanted = candidate_filings(filings).select("cik", "accession_number", F.col("filing_date").alias("filed_date"), "form_type")
    return wanted.join(warrant_terms(texts_of(wanted, main_texts)), "accession_number")


def response_items(response: str) -> Column:
    """The items of an extractor's answer, with or without a code fence; NULL unless it is a JSON array."""
    answer = F.trim(F.regexp_replace(F.col(response), r"^\s+|\s+$", ""))
    fenced = answer.startswith("```")
    answer = F.when(
        fenced, F.regexp_replace(F.regexp_replace(answer, r"^```(?:json)?\s*", ""), r"\s*```\s*$", "")
    ).otherwise(answer)
    return F.try_variant_get(F.try_parse_json(answer), "$", "array<variant>")


def validated_terms(responses: DataFrame, response_col: str = "response", text_col: str = "text") -> DataFrame:
    """Terms from an extractor's JSON answer that can be verified.

    A code fence around the array is tolerated. Anything that is not a JSON
    array gives no rows. An item stays only if its kind is known, its snippet
    occurs word for word in the document and its value converts.
    """
    items = response_items(response_col)
    keep = [c for c in responses.columns if c not in (response_col, text_col)]
    rows = responses.select(*keep, text_col, F.explode(items).alias("_i"))

    def field(name: str, kind: str = "string") -> Column:
        return F.try_variant_get("_i", f"$.{name}", kind)

    def holds_text(name: str) -> Column:
        return F.coalesce(F.schema_of_variant(field(name, "variant")) == "STRING", F.lit(False))

    is_text = holds_text("value")
    number = field("value", "double")
    # Text must be a whole number for counts; numbers are cut towards zero.
    whole = F.when(is_text, F.trim(field("value")).try_cast("bigint")).otherwise(number.try_cast("bigint"))
    real = F.when(is_text, F.trim(field("value")).try_cast("double")).otherwise(number)
    kind = field("kind")
    typed = rows.select(
        *keep,
        kind.alias("kind"),
        field("label").alias("label"),
        F.when(kind == "share_quantity", whole).alias("share_quantity"),
        F.when(kind == "exercise_price", real).alias("exercise_price"),
        F.when(kind == "expiration_years", whole.try_cast("int")).alias("expiration_years"),
        F.when(holds_text("raw_snippet"), field("raw_snippet")).alias("raw_snippet"),
        F.lit("llm").alias("extraction_method"),
        F.col(text_col),
    )
    has_value = F.coalesce(
        F.col("share_quantity").cast("double"), "exercise_price", F.col("expiration_years").cast("double")
    ).isNotNull()
    return typed.filter(
        F.col("kind").isin(*P.TERM_KINDS)
        & (F.col("raw_snippet") != "")
        & F.col(text_col).contains(F.col("raw_snippet"))
        & has_value
    ).drop(text_col)


def diagnostic_facts(docs: DataFrame, json_col: str = "facts_json") -> DataFrame:
    """Warrant and share-count facts from one pass over the documents, named by ``source_table``."""
    keep = [c for c in docs.columns if c != json_col]
    taxonomies = parse_facts(docs, json_col).select(*keep, F.explode("_doc.facts").alias("_taxonomy", "_concepts"))
    concepts = taxonomies.filter(F.col("_taxonomy").isin(WARRANT_TAXONOMY, SHARES_TAXONOMY)).select(
        *keep, "_taxonomy", F.explode("_concepts").alias("concept", "_body"))
    source = F.when(
        (F.col("_taxonomy") == WARRANT_TAXONOMY) & F.col("concept").startswith(WARRANT_CONCEPT_PREFIX), F.lit(WARRANT_SOURCE)
    ).when((F.col("_taxonomy") == SHARES_TAXONOMY) & (F.col("concept") == SHARES_CONCEPT), F.lit(SHARES_SOURCE))
    wanted = concepts.withColumn("source_table", source).filter(F.col("source_table").isNotNull())
    return _fact_entries(wanted, [*keep, "source_table"])


# -- diagnostics ---------------------------------------------------------------

def term_value(kind: Column | str = "kind") -> Column:
    """The value column that goes with the kind."""
    kind = F.col(kind) if isinstance(kind, str) else kind
    return (
        F.when(kind == "share_quantity", F.col("share_quantity").cast("double"))
        .when(kind == "exercise_price", F.col("exercise_price"))
        .otherwise(F.col("expiration_years").cast("double"))
    )


def term_unit(kind: Column | str = "kind") -> Column:
    return literal_lookup(F.col(kind) if isinstance(kind, str) else kind, P.TERM_UNITS)


def of_issuers(rows: DataFrame, tickers: DataFrame, ticker_map: DataFrame) -> DataFrame:
    """Rows (cik, ...) of the issuers that the tickers resolve to: to be taken before documents are parsed."""
    listed = tickers.select(F.upper("ticker").alias("ticker"))
    return rows.join(ticker_map.join(listed, "ticker", "left_semi").select("cik"), "cik", "left_semi")


def warrant_diagnostics(
    tickers: DataFrame,
    ticker_map: DataFrame,
    facts: DataFrame,
    shares: DataFrame | None,
    exhibits: DataFrame,
    terms: DataFrame,
) -> DataFrame:
    """Everything known per resolved ticker in one 16-column shape; unresolved tickers drop out.

    Without ``shares``, ``facts`` holds both kinds, as :func:`diagnostic_facts` names them.
    """
    resolved = tickers.select(F.upper("ticker").alias("_t"), "ticker").join(
        ticker_map.select(F.col("ticker").alias("_t"), "cik"), "_t"
    ).drop("_t")

    if shares is not None:
        facts = facts.withColumn("source_table", F.lit(WARRANT_SOURCE)).unionByName(
            shares.withColumn("source_table", F.lit(SHARES_SOURCE)))

    def fact_rows(df: DataFrame) -> DataFrame:
        return df.select(
            "cik", "source_table", "concept", "unit",
            F.col("fact_value").cast("double").alias("value"),
            "period_start", "period_end", "form", "filed_date", "accession_number",
            filing_url("cik", "accession_number").alias("filing_url"),
        )

    exhibit_part = exhibits.select(
        "cik",
        F.lit(EXHIBIT_SOURCE).alias("source_table"),
        F.col("exhibit_type").alias("concept"),
        "description",
        F.col("form_type").alias("form"),
        F.col("filing_date").alias("filed_date"),
        "accession_number",
        F.col("document_url").alias("filing_url"),
        "match_reason",
    )
    term_part = terms.select(
        "cik",
        F.lit(TERM_SOURCE).alias("source_table"),
        F.col("kind").alias("concept"),
        F.col("label").alias("description"),
        term_unit().alias("unit"),
        term_value().alias("value"),
        F.col("form_type").alias("form"),
        "filed_date",
        "accession_number",
        F.col("document_url").alias("filing_url"),
        "raw_snippet",
        "extraction_method",
    )
    parts = [fact_rows(facts), exhibit_part, term_part]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # One issuer may own a large share of the rows; its ticker row is what repeats.
    return spread_join(union, resolved, ["cik"], ["accession_number", "concept"]).select(*DIAGNOSTIC_COLUMNS)


def collection_status(
    tickers: DataFrame, ticker_map: DataFrame, found: DataFrame, inserted: DataFrame, empty_status: str
) -> DataFrame:
    """Per ticker: cik_not_found, nothing found, or ok with inserted and skipped counts.

    ``found`` holds the rows a run extracted and ``inserted`` the ones that were
    new; both carry ``cik``.
    """
    base = tickers.select("ticker", F.upper("ticker").alias("_t")).join(
        ticker_map.select(F.col("ticker").alias("_t"), "cik"), "_t", "left"
    )
    n_found = found.groupBy("cik").agg(F.count(F.lit(1)).alias("_found"))
    n_new = inserted.groupBy("cik").agg(F.count(F.lit(1)).alias("_new"))
    joined = base.join(n_found, "cik", "left").join(n_new, "cik", "left")
    ok = F.col("_found") > 0
    status = (
        F.when(F.col("cik").isNull(), F.lit("cik_not_found"))
        .when(ok, F.lit("ok"))
        .otherwise(F.lit(empty_status))
    )
    new = F.coalesce("_new", F.lit(0))
    return joined.select(
        "ticker",
        "cik",
        status.alias("status"),
        F.when(ok, new).alias("inserted"),
        F.when(ok, F.col("_found") - new).alias("skipped"),
    )


def issuer_rows(table: DataFrame, cik: Column | str, order: list[str]) -> DataFrame:
    """Stored rows of one issuer in report order."""
    return table.filter(F.col("cik") == cik).orderBy(*order)
