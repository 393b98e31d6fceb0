from datetime import date
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from haltscope.functions import clean as C
from haltscope.functions import text as X
from haltscope.operators import filings as O
from haltscope.operators import resolve as R
from haltscope.plans import catalog
from haltscope.sources import filings as S
from haltscope.sources import listings as L
from haltscope.sources import tables

LONG_TEXT = (
    "The Company sold (i) Pre-Funded Warrants (the “Prepaid”) to purchase up to an aggregate of 2,500,000 shares, "
    "(ii) Series A-1 Warrants to purchase up to an aggregate of 1,250,000 shares and more. Each Series A-1 Warrant has an "
    "exercise price of $5.02 per share and will expire five (5) years from issuance. Prepaid ones may be exercised at a nominal "
    "exercise price of $0.001 per share. They will expire two (2) year from issuance."
)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc long, text string")


def test_terms(spark):
    rows = O.warrant_terms(docs(spark, LONG_TEXT, "no terms here")).collect()
    quantities = {(r.label, r.share_quantity) for r in rows if r.kind == "share_quantity"}
    assert {q for _, q in quantities} == {2500000, 1250000}
    assert any(label.endswith("Series A-1") for label, _ in quantities)
    assert {(r.label, r.exercise_price) for r in rows if r.kind == "exercise_price"} == {
        ("Each Series A-1", 5.02), ("Pre-Funded Warrant", 0.001)}
    assert sorted(r.expiration_years for r in rows if r.kind == "expiration_years") == [2, 5]
    assert all(r.raw_snippet in LONG_TEXT and r.extraction_method == "regex" and r.doc == 0 for r in rows)


def test_terms_see_the_whole_text_and_unicode_blanks(spark):
    far = "x " * 60000 + "Série B warrants to purchase up to an aggregate of 7 shares"
    row = O.warrant_terms(docs(spark, far)).collect()
    assert len(row) == 1 and row[0].share_quantity == 7 and row[0].label.endswith("Série B")


@pytest.mark.parametrize("text,expected", [
    ("effected a 1-for-35 reverse stock split, effective as of 12:01 a.m. on May 6, 2024.", (1, 35, date(2024, 5, 6))),
    ("A 2-FOR-15 Reverse Stock Split will be done.", (2, 15, None)),
    ("1-for-10 reverse stock split; effective on Foo 99, 2024", (1, 10, None)),
    ("1-for-10 reverse  stock split", None),
    ("an amendment became effective on May 6, 2024", None),
])
def test_reverse_splits(spark, text, expected):
    rows = [(r.ratio_new, r.ratio_old, r.effective_date) for r in O.reverse_splits(docs(spark, text)).collect()]
    assert rows == ([expected] if expected else [])


def test_html_to_text(spark):
    df = spark.createDataFrame([("<p>A&nbsp;&nbsp;B</p>\n<b>C &amp;lt; &#8220;D&#8221;</b>&eacute; ",), (None,)], "h string")
    assert [r[0] for r in df.select(X.html_to_text("h")).collect()] == ["A B C &lt; “D” é", None]


def test_html_to_text_of_closed_references(spark):
    """A name without its semicolon stays, as in the SQL of the pages; by default it is decoded, as HTML has it."""
    pages = ["a = &quot p{", "&copy", "x &lt", "&quot;&copy;&amp;&lt;b&gt;&middot;", "a &amp", "&ampquot;", "&amp;quot;", "&amp;amp;", "&notit;", "&#8220;&#8220", "&am", None]
    df = spark.createDataFrame([(k, h) for k, h in enumerate(pages)], "k int, h string")
    got = [r[0] for r in df.orderBy("k").select(X.html_to_text("h", closed=True)).collect()]
    assert got == ["a = &quot p{", "&copy", "x &lt", '"©&<b>·', "a &", "&quot;", "&quot;", "&amp;", "&notit;", "“&#8220", "&am", None]
    assert df.filter("k < 2").orderBy("k").select(X.html_to_text("h")).first()[0] == 'a = " p{'


def test_html_to_text_query_leaves_cut_names(spark, tmp_path):
    spark.createDataFrame([(1, "u", "<p>token = &quot p{}</p>&quot;")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    row = catalog.runnable()["html_to_text"](spark, str(tmp_path)).first()
    assert row.digest == md5(b'token = &quot p{} "').hexdigest()


def test_candidates(spark):
    rows = spark.createDataFrame([("a", "Item 1.01"), ("b", "3.02,9.01"), ("c", "5.03"), ("d", None)], "id string, item_codes string")
    assert {r.id for r in O.candidate_filings(rows).collect()} == {"a", "b"}
    assert {r.id for r in O.candidate_filings(rows, O.SPLIT_ITEMS).collect()} == {"c"}


PAGE = """<html><table class="other"><tr><td>1</td><td>x</td><td><a href="/no">n</a></td><td>8-K</td><td>1</td></tr></table>
<table class="tableFile" summary="Docs"><tr><th scope="col">Seq</th></tr>
<tr><td scope="row">1</td><td>8-K</td><td><a href="/ix?doc=/Archives/a.htm">a.htm</a> iXBRL</td><td>8-K</td><td>1</td></tr>
<tr class="evenRow"><td>2</td><td>FORM OF PRE-FUNDED WARRANT</td><td><a href="/Archives/b.htm">b.htm</a></td><td>EX-4.1</td><td>2</td></tr>
<tr><td>3</td><td>EXHIBIT 4.2 &amp; more</td><td><a href="https://h/c.htm">c.htm</a></td><td>ex-4.2</td><td>3</td></tr>
<tr><td>4</td><td>warrant agreement</td><td><a href="/Archives/d.htm">d.htm</a></td><td>EX-10.1</td><td>4</td></tr>
<tr><td>&nbsp;</td><td>Complete</td><td><a href="/all.txt">all</a></td><td>&nbsp;</td><td>5</td></tr>
<tr><td>6</td><td>no link</td><td>plain</td><td>EX-99</td><td>6</td></tr>
<tr><td>7</td><td>short</td></tr></table></html>"""


def test_index_page(spark):
    pages = spark.createDataFrame([("f1", PAGE), ("f2", "<html>nothing</html>")], "accession_number string, html string")
    found = S.filing_documents(pages)
    rows = {r.seq: r for r in found.collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert rows[1].url == "https://www.sec.gov/Archives/a.htm" and rows[1].filename == "a.htm iXBRL"
    assert rows[3].url == "https://h/c.htm" and rows[3].description == "EXHIBIT 4.2 & more"
    reasons = {r.seq: r.match_reason for r in O.warrant_exhibits(found).collect()}
    assert reasons == {2: "description+exhibit_type", 3: "exhibit_type", 4: "description"}
    assert O.main_documents(found).first().seq == 1


FACTS = """{"cik": 1, "facts": {"us-gaap": {"ClassOfWarrantOrRightOutstanding": {"label": "x", "units": {"shares": [
 {"end": "2024-03-31", "val": 5, "accn": "a", "fy": 2024, "fp": "Q1", "form": "10-Q", "filed": "2024-05-01"}, {"val": 6, "start": "2024-01-01"}]}},
 "Assets": {"units": {"USD": [{"val": 1}]}}}, "dei": {"EntityCommonStockSharesOutstanding": {"units": {"shares": [{"val": 9.5}]}}}}}"""


def test_facts(spark):
    table = spark.createDataFrame([("1", FACTS), ("2", '{"facts": {}}'), ("3", "{}")], "cik string, facts_json string")
    rows = O.warrant_facts(table).orderBy("fact_value").collect()
    assert [(r.fact_value, r.period_end, r.period_start, r.form) for r in rows] == [
        (5.0, "2024-03-31", None, "10-Q"), (6.0, None, "2024-01-01", None)]
    assert [r.fact_value for r in O.shares_facts(table).collect()] == [9.5]


@pytest.mark.parametrize("answer,count", [
    ('[{"kind":"share_quantity","label":"A","value":"12","raw_snippet":"twelve"}]', 1),
    ('```json\n[{"kind":"exercise_price","value":1.5,"raw_snippet":"twelve"}]\n```', 1),
    ('[{"kind":"share_quantity","value":12,"raw_snippet":"not there"}]', 0),
    ('[{"kind":"other","value":12,"raw_snippet":"twelve"}]', 0),
    ('[{"kind":"share_quantity","value":"many","raw_snippet":"twelve"}]', 0),
    ('[{"kind":"share_quantity","value":12,"raw_snippet":5}]', 0),
    ('[{"kind":"share_quantity","value":12,"raw_snippet":""}]', 0),
    ('{"kind":"share_quantity","value":12,"raw_snippet":"twelve"}', 0),
    ('sorry, nothing', 0), ('[1, "x", null]', 0), ('', 0),
])
def test_answers_are_checked(spark, answer, count):
    df = spark.createDataFrame([(1, answer, "there are twelve shares")], "id long, response string, text string")
    assert O.validated_terms(df).count() == count


def test_counts_from_numbers_are_cut(spark):
    df = spark.createDataFrame([(1, '[{"kind":"expiration_years","value":5.9,"raw_snippet":"x"}]', "x")], "id long, response string, text string")
    assert O.validated_terms(df).first().expiration_years == 5


@pytest.mark.parametrize("name,normalized", [
    ("Acme, Inc.", "acme"), ("ACME Holdings", "acme"), ("Acme Holdings, Inc.", "acme holdings"), ("  A.B.  Corp", "ab"),
    ("Company", ""), ("Inco", "in"), ("Foo & Bar Ltd", "foo bar"),
])
def test_names(spark, name, normalized):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(X.normalize_company_name("n")).first()[0] == normalized


def test_unique_matches(spark):
    companies = spark.createDataFrame(
        [("Alpha Inc.", "1"), ("Beta Therapeutics Holdings, Inc.", "2"), ("Gamma", "3"), ("Gamma Corp", "4"),
         ("Delta One", "5"), ("Delta Two", "6"), ("Epsilon", "7"), ("Cere", "8")], "name string, cik string")
    targets = spark.createDataFrame([(n,) for n in (
        "ALPHA", "Beta Therapeutics", "Gamma", "Delta", "Epsilon Group", "Cerevel", "Unknown")], "issuer_name string")
    got = {r.issuer_name: (r.cik, r.level) for r in R.unique_name_matches(targets, companies).collect()}
    # Gamma is ambiguous at the exact level, Delta at the prefix level, Cere is no word prefix of Cerevel.
    assert got == {"ALPHA": ("1", "exact"), "Beta Therapeutics": ("2", "prefix"), "Epsilon Group": ("7", "prefix")}


def test_matches_equal_brute_force_under_a_hot_first_word(spark):
    words = ["one", "two", "three"]
    comp = [(" ".join(["Global", *([words[k % 3]] * (k % 4)), str(k % 25)][: 2 + k % 3]), f"{k:010d}") for k in range(120)]
    names = sorted({" ".join(["Global", words[k % 3], *(["two"] * (k % 2)), str(k % 7)][: 1 + k % 4]) for k in range(60)})

    def norm(x):
        return x.lower()

    expected = {}
    distinct = sorted(set(comp))
    for t in names:
        exact = [c for c in distinct if norm(c[0]) == norm(t)]
        loose = [c for c in distinct if norm(c[0]) != norm(t) and (
            norm(c[0]).startswith(norm(t) + " ") or norm(t).startswith(norm(c[0]) + " "))]
        pick = exact if exact else loose
        if len(pick) == 1:
            expected[t] = pick[0][1]
    got = R.unique_name_matches(spark.createDataFrame([(n,) for n in names], "issuer_name string"),
                                spark.createDataFrame(comp, "name string, cik string"))
    assert {r.issuer_name: r.cik for r in got.collect()} == expected


def test_resolution(spark):
    tickers = spark.createDataFrame([("abc",), ("OLD",), ("GONE",), ("NONAME",)], "ticker string")
    listed = spark.createDataFrame([("ABC", "0000000001")], "ticker string, cik string")
    names = spark.createDataFrame([("OLD", "Old Co"), ("GONE", "Gone")], "ticker string, issue_name string")
    companies = spark.createDataFrame([("Old Company", "0000000002")], "name string, cik string")
    got = {r.ticker: (r.cik, r.resolution_method, r.matched_name) for r in R.resolve_issuers(tickers, listed, names, companies).collect()}
    assert got == {"abc": ("0000000001", "ticker_map", None), "OLD": ("0000000002", "name_search", "Old Co"),
                   "GONE": (None, "not_found", None), "NONAME": (None, "not_found", None)}


def test_ticker_map_last_wins(spark):
    doc = '{"0":{"cik_str":12,"ticker":"aa","title":"x"},"1":{"cik_str":34,"ticker":"AA","title":"y"}}'
    assert [tuple(r) for r in R.build_ticker_map(spark.createDataFrame([(doc,)], "json string")).collect()] == [("AA", "0000000034")]


def test_urls_and_ids(spark):
    df = spark.createDataFrame([("0000012345", "0001-24-000007"), ("", "x"), (None, "x")], "c string, a string")
    assert [r[0] for r in df.select(X.filing_url("c", "a")).collect()] == [
        "https://www.sec.gov/Archives/edgar/data/12345/000124000007/0001-24-000007-index.htm", None, None]
    one = spark.createDataFrame([(" aa, ,b",)], "t string").select(C.split_tickers("t")).first()[0]
    assert one == ["AA", "B"]


def test_listing(spark, tmp_path):
    (tmp_path / "n.txt").write_text(
        f"{L.NASDAQ_HEADER}\nAAA|Aaa Inc|Q|N|N|100|N|N\nragged|x\n\nFile Creation Time: 0105202412:00|||||||\n")
    (tmp_path / "o.txt").write_text(f"{L.OTHER_HEADER}\nBBB|Bbb|A|BBB|Y|1|N|BBB\n")
    rows = {r.symbol: r for r in L.scan_symbol_directory(spark, str(tmp_path / "n.txt"), str(tmp_path / "o.txt")).collect()}
    assert set(rows) == {"AAA", "BBB"}
    assert (rows["AAA"].exchange, rows["AAA"].round_lot_size, rows["AAA"].payload["NextShares"]) == ("Q", 100, "N")
    assert (rows["BBB"].exchange, rows["BBB"].etf, rows["BBB"].source_file) == ("A", "Y", "otherlisted")


def test_request_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("TICKER ; date\n abc ;03/04/2024\nx;2024-01-05\n;nope\n")
    path = str(tmp_path / "r.csv")
    profile = L.profile_requests(L.read_request_file(spark, path, ";")).first()
    assert (profile.observations, profile.invalid_dates, profile.empty_tickers, profile.valid) == (3, 1, 1, False)
    rows = {r.ticker: r.observation_date for r in L.scan_batch_requests(spark, path, ";").collect()}
    assert rows["ABC"] == date(2024, 4, 3) and rows["X"] == date(2024, 1, 5)
    (tmp_path / "m.csv").write_text("Ticker\nabc\n")
    missing = L.profile_requests(L.read_request_file(spark, str(tmp_path / "m.csv"))).first()
    assert (missing.has_date, missing.invalid_dates, missing.valid) == (False, 1, False)


def test_company_search_pages(spark):
    single = ('<span class="companyName">Solo Corp <acronym title="Central Index Key">CIK</acronym>#: '
              '<a href="/x?CIK=0000000009&amp;y">0000000009 (see all)</a></span>')
    rows = ('<table><tr><th>CIK</th></tr>\n<tr>\n<td><a href="?CIK=0000000001">1</a></td><td scope="row">One<br />SIC</td></tr>'
            '<tr><td><a href="?CIK=0000000002">2</a></td><td scope="row">Two <br /></td></tr></table>')
    pages = spark.createDataFrame([(1, single), (2, rows), (3, "<p>none</p>")], "q long, html string")
    assert {(r.q, r["name"], r.cik) for r in S.company_search_results(pages).collect()} == {
        (1, "Solo Corp", "0000000009"), (2, "One", "0000000001"), (2, "Two", "0000000002")}


def test_atom_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><content type="text/xml"><accession-number>a-1</accession-number>'
        '<filing-date>2024-01-05</filing-date><filing-href>http://i</filing-href><filing-type>8-K</filing-type>'
        '<items-desc>items 1.01 and 9.01</items-desc></content></entry><entry><content type="text/xml">'
        '<accession-number>a-2</accession-number></content></entry><entry><title>none</title></entry></feed>')
    rows = {r.accession_number: r for r in S.scan_filings_feed(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a-1", "a-2"} and rows["a-2"].item_codes == "" and rows["a-1"].filing_index_url == "http://i"


def test_number_display(spark):
    df = spark.createDataFrame([(100.0,), (2.5,), (1.234,), (0.0,), (None,)], "v double")
    assert [r[0] for r in df.select(tables.display_number(F.col("v"))).collect()] == ["100", "2.5", "1.23", "0", "N/A"]


def test_csv_has_a_header_even_when_empty(spark, tmp_path):
    path = str(tmp_path / "out")
    tables.export_csv(spark.createDataFrame([], "a string, b long"), path)
    assert spark.read.option("header", True).csv(path).columns == ["a", "b"]


def test_exhibits_of_pages_sort_no_pages(spark):
    """The rows of exhibit_rows, for repeated filings too, and no sort that would hold whole pages."""
    filings = spark.createDataFrame(
        [("1", "a", "Item 1.01", "u1"), ("1", "a", "Item 3.02", "u2"), ("2", "b", "Item 8.01", "u3"), ("3", "c", "1.01", None), ("4", "d", "3.02", "u4")],
        "cik string, accession_number string, item_codes string, filing_index_url string")
    row = "<tr><td>{}</td><td>{}</td><td><a href='/x{}'>f</a></td><td>{}</td><td>1</td></tr>"
    html = "<table class='tableFile'>" + row.format(1, "8-K", 1, "8-K") + row.format(2, "Form of Warrant", 2, "EX-10") + row.format(3, "plan", 3, "ex-4.2") + "</table>"
    pages = spark.createDataFrame([(a, html) for a in "abcde"], "accession_number string, html string")
    want = O.exhibit_rows(filings, S.filing_documents(pages))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = O.exhibits_of_pages(filings, pages)
        plan = got._jdf.queryExecution().executedPlan().toString()
        rows = sorted(map(str, got.select(*want.columns).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == sorted(map(str, want.collect())) and len(rows) == 6
    assert "SortMergeJoin" not in plan and plan.count("Join") == 1
