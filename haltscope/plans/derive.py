"""Halt, bar and filing tables derived from the general-purpose test tables.

Every rule has a SQL twin of the same name in ``oracle_views``. All of them are
row-wise projections of whole tables, so they scale with their input.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from haltscope.functions.calendar import calendar_for, date_bounds
from haltscope.functions.text import filing_url
from haltscope.operators.canonical import canonical_halts
from haltscope.operators.episodes import dedup_observations, episode_links, episode_membership, episodes_of, halt_episodes
from haltscope.session import work_dir

# Years by which orders are moved next to the events.
ORDER_YEARS = 25

REASON_OF_TYPE = {"signup": "LUDP", "view": "T1", "click": "H11", "error": "M", "purchase": "T12"}


def seconds(n: Column) -> Column:
    zero = F.lit(0)
    return F.make_dt_interval(zero, zero, zero, n.cast("decimal(18,6)"))


def pick(n: Column, *values) -> Column:
    """The n-th value (n counted from 0)."""
    out = F.when(n == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], start=1):
        out = out.when(n == i, F.lit(v))
    return out


def s(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


class Inputs:
    """Lazy derived tables over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._saved: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    def spread(self) -> Inputs:
        """The same inputs with the events dealt over tasks, for plans with much work a row.

        A file is read by as many tasks as it has row groups, often one.
        """
        dealt = Inputs(self.spark, self.dir)
        dealt.events = self.events.drop("props").repartition("event_id")
        return dealt

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders")

    def saved(self, name: str) -> DataFrame:
        """A derived table written to the shared folder, for plans that read it several times."""
        if name not in self._saved:
            rows = getattr(self, name)
            folder = work_dir(self.spark, name)
            rows.write.parquet(folder)
            self._saved[name] = self.spark.read.schema(rows.schema).parquet(folder)
        return self._saved[name]

    @cached_property
    def calendar(self) -> DataFrame:
        """All days of events and moved orders, with a year on both sides."""
        return calendar_for(self.spark, *self._dated)

    @property
    def _dated(self) -> list[tuple[DataFrame, str]]:
        moved = self.orders.select(F.add_months("o_orderdate", 12 * ORDER_YEARS).alias("day"))
        return [(self.events, "ts"), (moved, "day")]

    @cached_property
    def calendar_years(self) -> tuple[int, int]:
        low, high = date_bounds(*self._dated)
        return low.year - 1, high.year + 1

    # -- halts ---------------------------------------------------------------

    @cached_property
    def halt_obs(self) -> DataFrame:
        """Feed observations: each event once, some observed again with other content."""
        e = F.col("event_id")
        copies = F.filter(
            F.array(
                F.lit(0),
                F.when((e % 10).isin(0, 9), 1),
                F.when(e % 10 == 3, 2),
                F.when(e % 10 == 6, 3),
            ),
            lambda c: c.isNotNull(),
        )
        reason = F.lit(None).cast("string")
        for kind, code in REASON_OF_TYPE.items():
            reason = F.when(F.col("event_type") == kind, F.lit(code)).otherwise(reason)
        c = F.col("copy_no")
        base_end = (
            F.when(e % 7 == 0, F.lit(None).cast("timestamp_ntz"))
            .when(e % 7 == 1, F.col("ts") - seconds(F.lit(60)))
            .otherwise(F.col("ts") + seconds(F.round(F.col("value") * 1200, 0).cast("bigint")))
        )
        late_end = F.col("ts") + seconds(F.round(F.col("value") * 1200, 0).cast("bigint") + 1800)
        end = F.when((c == 0) | ((c == 1) & (e % 10 == 9)), base_end).when(c == 2, late_end)
        clock = F.date_format("halt_end", "HH:mm:ss.SSSSSS")
        return (
            self.events
            .select("event_id", "ts", "user_id", "event_type", "value", F.explode(copies).alias("copy_no"))
            .withColumn("halt_end", end)
            .select(
                (e * 4 + c).alias("obs_id"),
                s("S", text("user_id")).alias("symbol"),
                F.when(c > 0, s("Issuer ", text("user_id"), " late"))
                .when(e % 5 == 0, F.lit(None).cast("string"))
                .when(e % 11 == 0, s("Issuer ", text("user_id"), " Holdings"))
                .otherwise(s("Issuer ", text("user_id")))
                .alias("issue_name"),
                pick(e % 6, "Q", "NASDAQ", "N", "A", "AMEX", "P").alias("market"),
                F.when(e % 37 == 0, F.lit(None).cast("string")).otherwise(reason).alias("reason_code"),
                F.lit(None).cast("string").alias("resumption_reason_code"),
                F.col("ts").alias("halt_start"),
                "halt_end",
                F.when(c == 3, F.to_date("ts")).otherwise(F.to_date("halt_end")).alias("resumption_date"),
                F.when((e % 2 == 0) | (e % 3 == 0), clock).alias("resumption_quote_time"),
                F.when(e % 3 != 0, clock).alias("resumption_trade_time"),
                F.when(e % 4 != 0, F.col("value")).alias("pause_threshold_price"),
                s("tradehalts_", F.date_format("ts", "yyyy-MM-dd"), ".xml").alias("source_file"),
                F.lit("halt").alias("source_type"),
                "copy_no",
            )
        )

    @cached_property
    def unique_obs(self) -> DataFrame:
        return dedup_observations(self.halt_obs, ["obs_id"])

    @cached_property
    def episodes(self) -> DataFrame:
        return halt_episodes(self.unique_obs, ["obs_id"])

    @cached_property
    def stored_halts(self) -> DataFrame:
        """What a first run stored: first-seen rows before 16:00."""
        first = self.halt_obs.filter((F.hour("halt_start") < 16) & (F.col("copy_no") == 0))
        return canonical_halts(first, ["obs_id"])

    @cached_property
    def incoming_halts(self) -> DataFrame:
        """What a second run sees: every observation from 08:00."""
        return canonical_halts(self.halt_obs.filter(F.hour("halt_start") >= 8), ["obs_id"])

    @cached_property
    def halt_rows(self) -> DataFrame:
        """Raw halt table with ids (one row per first-seen observation)."""
        return self.halt_obs.filter("copy_no = 0").withColumn("id", F.col("obs_id"))

    @cached_property
    def all_halt_rows(self) -> DataFrame:
        """Raw halt rows before keys were unique."""
        return self.halt_obs.withColumn("id", F.col("obs_id"))

    @cached_property
    def resumptions(self) -> DataFrame:
        """Resumption observations of the halts, some later, some without a reason."""
        later = F.col("halt_end") + seconds((F.col("id") % 5 - 1).cast("bigint") * 600)
        k = F.floor(F.col("id") / 4).cast("bigint")
        return self.all_halt_rows.filter("halt_end is not null").select(
            "id",
            "symbol",
            "market",
            "halt_start",
            F.when(k % 3 != 0, F.col("reason_code")).alias("reason_code"),
            F.when(k % 4 != 0, F.lit("T3")).alias("resumption_reason_code"),
            F.to_date(later).alias("resumption_date"),
            F.when(k % 2 == 0, F.date_format(later, "HH:mm:ss.SSSSSS")).alias("resumption_quote_time"),
            F.when(k % 5 != 0, F.date_format(later, "HH:mm:ss.SSSSSS")).alias("resumption_trade_time"),
            F.concat(F.lit("resumptions_"), F.date_format(later, "yyyy-MM-dd"), F.lit(".xml")).alias("source_file"),
            pick(k % 9, *["resumption"] * 8, "halt").alias("source_type"),
        )

    @cached_property
    def members(self) -> DataFrame:
        """Observations with the episode each belongs to; made once for episodes, ids and links."""
        return episode_membership(self.saved("unique_obs")).select(
            "symbol", "episode_market", "episode_start", "obs_id", "halt_start", "halt_end", "issue_name", "reason_code", "pause_threshold_price")

    @cached_property
    def id_episodes(self) -> DataFrame:
        made = episodes_of(self.saved("members").filter("episode_market is not null"), ["obs_id"], also={"episode_id": F.min("obs_id")})
        return made.drop("last_start").withColumn("trade_halt_id", F.col("episode_id"))

    @property
    def core_episodes(self) -> DataFrame:
        """Episodes as stored, with an id: the lowest raw id they were made from."""
        return self.saved("id_episodes")

    @cached_property
    def links_by_key(self) -> DataFrame:
        return episode_links(self.unique_obs, "obs_id")

    @cached_property
    def id_links(self) -> DataFrame:
        keyed = self.core_episodes.select("symbol", F.col("market").alias("episode_market"), F.col("halt_start").alias("episode_start"), "episode_id")
        return self.saved("members").join(keyed, ["symbol", "episode_market", "episode_start"]).select(
            "episode_id", F.col("obs_id").alias("trade_halt_id")).distinct()

    @property
    def links(self) -> DataFrame:
        return self.saved("id_links")

    @cached_property
    def requests(self) -> DataFrame:
        """One analysis request per user and day seen."""
        days = self.table("events").select("user_id", F.to_date("ts").alias("observation_date")).distinct()
        n = F.date_diff("observation_date", F.lit("2020-01-01").cast("date")).cast("bigint")
        k = F.col("user_id") + n
        reasons = (
            F.when(k % 4 == 0, F.array(F.lit("ALL")))
            .when(k % 4 == 1, F.array(F.lit("LUDP")))
            .when(k % 4 == 2, F.array(F.lit("LUDP"), F.lit("T1")))
            .otherwise(F.array(F.lit(" h11 "), F.lit("")))
        )
        return days.select(
            (F.col("user_id") * 1000000 + n).alias("request_id"),
            s(" s", text("user_id"), " ").alias("ticker"),
            "observation_date",
            F.when(k % 3 == 1, F.lit(1)).when(k % 3 == 2, F.lit(36)).alias("lookback_months"),
            reasons.alias("reason_codes"),
        )

    # -- bars ------------------------------------------------------------------

    @cached_property
    def bar_ticker(self) -> Column:
        """Event type and a bucket of users, so that tickers grow with the users."""
        return s(F.col("event_type"), "-", text(F.floor(F.col("user_id") / 50)))

    @cached_property
    def bars(self) -> DataFrame:
        """One-minute bars per ticker, made of all its events of the minute."""
        e, seen = F.col("event_id"), F.struct("ts", "event_id")
        minute = F.to_date("ts").cast("timestamp_ntz") + seconds(
            ((F.hour("ts") * 60 + F.minute("ts")) * 60).cast("bigint")
        )
        rows = self.table("events").select("event_id", "ts", "value", self.bar_ticker.alias("ticker"), minute.alias("bar_start"))
        made = rows.groupBy("ticker", "bar_start").agg(
            F.min("event_id").alias("event_id"),
            F.min_by("value", seen).alias("open"),
            (F.max("value") * 1.02).alias("high"),
            (F.min("value") * 0.97).alias("low"),
            F.max_by("value", seen).alias("close"),
            F.sum(F.floor(F.col("value") * 100).cast("bigint")).alias("volume"),
        )
        return made.select(
            "ticker", pick(e % 4, "Q", "N", None, "A").alias("market"), "bar_start", "open", "high", "low", "close", "volume",
            s("feed", text(e % 2)).alias("source"), "event_id",
        )

    @cached_property
    def stored_bars(self) -> DataFrame:
        return self.bars.filter(F.hour("bar_start") < 16)

    @cached_property
    def incoming_bars(self) -> DataFrame:
        return self.bars.filter(F.hour("bar_start") >= 8)

    # -- filings -----------------------------------------------------------------

    @cached_property
    def filings(self) -> DataFrame:
        k = F.col("o_orderkey")
        cik = F.lpad(text("o_custkey"), 10, "0")
        accession = s(cik, "-24-", F.lpad(text(k), 9, "0"))
        return self.orders.select(
            cik.alias("cik"),
            accession.alias("accession_number"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("filing_date"),
            pick(k % 3, "8-K", "8-K/A", "8-K").alias("form_type"),
            pick(
                k % 6, "Item 1.01, Item 9.01", "Item 3.02", "Item 3.03", "Item 5.03, Item 9.01", "Item 8.01", ""
            ).alias("item_codes"),
            filing_url(cik, accession).alias("filing_index_url"),
            k.alias("k"),
            F.col("o_totalprice").alias("price"),
        )

    @cached_property
    def filing_texts(self) -> DataFrame:
        """Main-document text of each filing with the sentences its number calls for."""
        k = F.col("k")
        whole = F.floor("price").cast("bigint")
        qty = s(text(F.floor(whole / 1000).cast("bigint") + 1), ",", F.lpad(text(whole % 1000), 3, "0"))
        cents = s(text(k % 90 + 1), ".", F.lpad(text(whole % 100), 2, "0"))
        parts = [
            F.when(k % 2 == 0, s("The Company issued Series A Warrants to purchase up to an aggregate of ", qty, " shares. ")),
            F.when(
                k % 3 == 0,
                s("It also issued Pre-Funded Warrants (the Prepaid) to purchase up to an aggregate of ", qty, "  shares. "),
            ),
            F.when(k % 4 == 0, s("Each Series A Warrant has an exercise price of $", cents, " per share. ")),
            F.when(k % 5 == 0, F.lit("These may be exercised at a nominal exercise price of $0.001 per share. ")),
            F.when(k % 3 == 1, s("They will expire five (", text(k % 9 + 1), ") years from issuance. ")),
            F.when(
                k % 7 == 0,
                s("A 1-for-", text(k % 40 + 2), " Reverse Stock Split became effective at 5:00 p.m. on ",
                  F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (k % 28).cast("int")), "MMMM d, yyyy"), ". "),
            ),
            F.when(k % 7 == 1, F.lit("The 1-for-10 reverse stock split is effective upon filing on Janvier 5, 2024. ")),
            F.lit("End of report."),
        ]
        body = F.concat_ws("", *parts)
        return self.filings.select(
            "cik", "accession_number", s("https://www.sec.gov/doc/", text(k)).alias("document_url"),
            F.col("filing_date").alias("filed_date"), "form_type", body.alias("text"), "k",
        )

    @cached_property
    def index_pages(self) -> DataFrame:
        """An index page per filing: a header, a body, two exhibits and a ragged row."""
        k = F.col("k")

        def row(seq: str, description, name, href, kind: Column) -> Column:
            return s(
                f"<tr><td>{seq}</td><td>", description, '</td><td><a href="', href, '">', name, "</a></td><td>",
                kind, "</td><td> 10 </td></tr>\n",
            )

        page = s(
            '<html><table class="tableFile" summary="Document Format Files">\n',
            "<tr><th>Seq</th><th>Description</th><th>Document</th><th>Type</th><th>Size</th></tr>\n",
            row("1", "FORM&nbsp;8-K", s("d", text(k), ".htm"), s("/ix?doc=/Archives/d", text(k), ".htm"), F.lit("8-K")),
            row("2", pick(k % 3, "FORM OF WARRANT", "EXHIBIT 4.1", "AGREEMENT &amp; PLAN"), s("e", text(k), ".htm"),
                s("/Archives/e", text(k), ".htm"), pick(k % 4, "EX-4.1", "ex-4", "EX-10.1", "EX-99")),
            row("3", F.lit("Purchase <b>Warrant</b>"), F.lit("w.htm"), F.lit("https://host.example/w.htm"), F.lit("EX-10.2")),
            "<tr><td>&nbsp;</td><td>Complete submission</td><td><a href=\"/all.txt\">all</a></td><td></td><td>9</td></tr>\n",
            "<tr><td>9</td><td>short</td></tr></table></html>",
        )
        return self.filings.select("accession_number", "k", page.alias("html"))

    @cached_property
    def fact_docs(self) -> DataFrame:
        """A nested facts document per filing."""
        k, val = F.col("k"), text(F.floor("price").cast("bigint"))

        def entry(v: Column, end: str) -> Column:
            return s('{"end":"', end, '","val":', v, ',"accn":"', F.col("accession_number"),
                     '","fy":2024,"fp":"Q1","form":"10-Q","filed":"', F.col("filing_date"), '"}')

        doc = s(
            '{"cik":1,"facts":{"us-gaap":{"ClassOfWarrantOrRightOutstanding":{"units":{"shares":[',
            entry(val, "2024-03-31"), ",", entry(text(k), "2023-12-31"), "]}},",
            '"ClassOfWarrantOrRightExercisePrice":{"units":{"USD":[', entry(text(k % 10), "2024-03-31"), "]}},",
            '"Assets":{"units":{"USD":[', entry(val, "2024-03-31"), "]}}},",
            '"dei":{"EntityCommonStockSharesOutstanding":{"units":{"shares":[', entry(val, "2024-04-30"),
            ']}},"EntityPublicFloat":{"units":{"USD":[', entry(text(k), "2024-04-30"), "]}}}}}",
        )
        return self.filings.select("cik", F.when(k % 11 == 0, F.lit('{"cik":2}')).otherwise(doc).alias("facts_json"))

    # -- issuers -------------------------------------------------------------------

    @cached_property
    def companies(self) -> DataFrame:
        k = F.col("c_custkey")
        customers = self.table("customer").select(
            s("Global Trading ", text(k), pick(k % 6, " Inc.", " Systems, Inc.", " Corp", " Systems LLC", ", Holdings", ""))
            .alias("name"),
            F.lpad(text(k), 10, "0").alias("cik"),
        )
        z = F.col("s_suppkey")
        suppliers = self.table("supplier").select(
            s("Global  Trading ", text(z), pick(z % 2, " Partners Co.", " Systems Limited")).alias("name"),
            F.lpad(text(z + 5000000000), 10, "0").alias("cik"),
        )
        return customers.unionByName(suppliers)

    @cached_property
    def tickers(self) -> DataFrame:
        return self.table("customer").select(
            s(pick(F.col("c_custkey") % 2, "t", "T"), text("c_custkey")).alias("ticker"), F.col("c_custkey").alias("k")
        )

    @cached_property
    def ticker_map(self) -> DataFrame:
        """Listed tickers; two issuers in three are listed under another symbol."""
        k = F.col("c_custkey")
        return self.table("customer").select(
            s(pick(k % 3, "T", "X", "Y"), text(k)).alias("ticker"), F.lpad(text(k), 10, "0").alias("cik")
        )

    @cached_property
    def names(self) -> DataFrame:
        """Issue names known per ticker."""
        k = F.col("c_custkey")
        return self.table("customer").select(
            s("T", text(k)).alias("ticker"),
            F.when(
                k % 10 != 7,
                s("GLOBAL TRADING ", text(k), pick(k % 5, "", " Holdings Corp", " Systems Partners", " Systems", " Inc")),
            ).alias("issue_name"),
        )
