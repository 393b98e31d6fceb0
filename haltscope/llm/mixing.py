"""Mixing sources to target weights with a low-discrepancy block schedule.

The documents of a source are put in hashed order on one line of words, and the
line is cut into blocks of equally many words. Slots are numbered; the golden
ratio gives every slot a point of the unit interval, which the cumulative target
weights map to a source. The k-th slot of a source takes its k-th block, and
starts over when all blocks are taken. A source gets as many slots as its target
has blocks: the few that its points miss are added at the end, and those too
many are left out. DataFrame operations only.

No window spans a whole source: running sums and ranks are taken inside small
chunks and shifted by the totals of the chunks before. What is ranked over a
source as a whole is one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from haltscope.llm.common import ROW, keyed, stored, words_in

WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2
# Words of a block, at every size of the corpus; a source that has fewer than
# PARTS such blocks is cut into PARTS smaller ones.
BLOCK, PARTS = 1024, 4096

# 2^32 divided by the golden ratio, and 2^32. Slot i has the point
# frac(i * STEP / RANGE), computed in whole numbers.
STEP, RANGE = 2654435769, 4294967296
CELL = 4096
CHUNK = 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, block: int = BLOCK) -> DataFrame:
    """Words to take of each source, the words of its blocks, and the slots that its target asks for.

    Whole sources are compared here, in one task: ``sizes`` is to have at most a
    few million rows.

    ``sizes`` has a row (source, source_size) per source. Sources in code-point
    order, null last, get the weights in turn; together they get ``share`` times
    all words. No target exceeds ``limit`` times its source; the excess goes to
    the others by weight. That is min(cap, level * weight) for one level: with
    the sources in the order of cap / weight, the highest of the levels that
    remain when the sources before are capped.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("idx", F.row_number().over(by_name) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod("idx", F.lit(len(weights))).cast("int") + 1)
    ranked = ranked.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    ratio = Window.orderBy(F.col("cap") / F.col("w"), "idx")
    before = F.coalesce(F.sum("cap").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = F.max((total - before) / rest).over(everything)
    out = ranked.withColumn("_total", total).withColumn("_level", (F.col("_total") - before) / rest)
    out = out.withColumn("target", F.least("cap", F.max("_level").over(everything) * F.col("w")))
    words = F.greatest(F.lit(1), F.least(F.lit(block), F.ceil(F.col("source_size") / F.lit(PARTS)))).cast("long")
    out = out.withColumn("block_words", words).withColumn("_slots", F.col("target") / F.col("block_words"))
    upto = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    part = F.sum("_slots").over(upto) / F.nullif(F.sum("_slots").over(everything), F.lit(0.0))
    # The source's share [lo, hi) of the points, in whole numbers.
    out = out.withColumn("hi", F.round(part * F.lit(float(RANGE))).cast("long"))
    out = out.withColumn("lo", F.lag("hi", 1, 0).over(Window.orderBy("idx")))
    return out.select("source", "idx", "source_size", "w", "target", "block_words", F.round("_slots").cast("long").alias("n_slots"), "lo", "hi")


def _after_chunks(rows: DataFrame, key: str, chunk: str, size: Column, out: str) -> DataFrame:
    """For each (key, chunk): the sum of ``size`` over the earlier chunks of the key."""
    totals = rows.groupBy(key, chunk).agg(F.sum(size).alias("_n"))
    earlier = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, chunk, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(out))


class Mixture:
    """The mix of a table (doc_id, source, size) with one row per document; a row key, if there is one, stays with its row.

    ``rows``: documents with their place [start, end) on the line of their source.
    ``slots``: source number, slot, block, epoch.
    """

    def __init__(self, sized: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT, block: int = BLOCK):
        spark = sized.sparkSession
        self.ids = ["doc_id", *[c for c in sized.columns if c == ROW]]
        sized = stored(sized.select(*self.ids, "source", "size"), "mix-sizes")
        sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        self.targets = stored(source_targets(sizes, weights, share, limit, block), "mix-targets")
        n_slots, n_sources = self.targets.agg(F.coalesce(F.sum("n_slots"), F.lit(0)), F.count("*")).first()

        named = sized.join(self.targets, sized["source"].eqNullSafe(self.targets["source"])).select(
            *[sized[c] for c in self.ids], sized["source"], sized["size"], "idx", "source_size", "target", "block_words"
        ).withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("part", F.substring("h", 1, 3))
        inside = Window.partitionBy("idx", "part").orderBy("h", "doc_id", "size", *self.ids[1:]).rowsBetween(Window.unboundedPreceding, 0)
        self.rows = (
            named.join(_after_chunks(named, "idx", "part", F.col("size"), "_before"), ["idx", "part"])
            .withColumn("end", F.col("_before") + F.sum("size").over(inside))
            .withColumn("start", F.col("end") - F.col("size"))
            .drop("_before", "part", "h")
        )

        i = F.col("id")
        point = F.pmod(i * F.lit(STEP), F.lit(RANGE))
        cell = lambda c: F.floor(c / F.lit(RANGE // CELL))
        spans = self.targets.filter("lo < hi").withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
        drawn = (
            spark.range(n_slots).withColumn("p", point).withColumn("cell", cell(F.col("p")))
            .join(spans, "cell").filter("p >= lo and p < hi")
            .withColumn("chunk", F.floor(i / F.lit(CHUNK)))
            .select("id", "idx", "chunk")
        )
        within = F.row_number().over(Window.partitionBy("idx", "chunk").orderBy("id")) - 1
        ranked = drawn.join(_after_chunks(drawn, "idx", "chunk", F.lit(1), "_before"), ["idx", "chunk"]).select(
            "idx", F.col("id").alias("slot"), (F.col("_before") + within).cast("long").alias("k"))
        # The points of a source differ from its share by a few slots.
        got = drawn.groupBy("idx").agg(F.count("*").alias("_got"))
        missing = self.targets.join(got, "idx", "left").withColumn("_got", F.coalesce("_got", F.lit(0))).filter("_got < n_slots")
        missing = missing.withColumn("k", F.explode(F.sequence(F.col("_got"), F.col("n_slots") - 1))).select(
            "idx", (F.lit(n_slots) + F.col("k") * F.lit(n_sources) + F.col("idx")).alias("slot"), "k")
        n_blocks = F.ceil(F.col("source_size") / F.col("block_words"))
        each = self.targets.select("idx", "n_slots", n_blocks.alias("n_blocks"))
        k = F.col("k")
        self.slots = (
            ranked.unionByName(missing).join(each, "idx").filter((k < F.col("n_slots")) & (k < F.col("n_blocks") * F.lit(limit)))
            .select("idx", "slot", (k % F.col("n_blocks")).alias("block"), F.floor(k / F.col("n_blocks")).alias("epoch"))
        )

    def schedule(self) -> DataFrame:
        """What each slot reads: (slot, source, doc_id, first_word, words), epochs included."""
        b = F.col("block_words")
        of_block = self.rows.filter("size > 0").withColumn(
            "block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("end") - 1) / b)))
        )
        first = F.greatest(F.col("start"), F.col("block") * b)
        last = F.least(F.col("end"), (F.col("block") + 1) * b)
        return of_block.join(self.slots, ["idx", "block"]).select(
            "slot", "epoch", "idx", "source", "doc_id", "start", "size",
            (first - F.col("start")).alias("first_word"), (last - first).alias("words"),
        )

    def taken(self) -> DataFrame:
        """One row per document with the words that the mix takes of it, repeats counted."""
        keys = ["idx", "start", "doc_id", "size"]
        drawn = self.schedule().select(*keys, F.col("words").alias("taken"), F.lit(None).cast("long").alias("source_size"),
                                       F.lit(None).cast("double").alias("target"))
        own = self.rows.select(*keys, F.lit(0).cast("long").alias("taken"), "source_size", "target")
        some = own.filter("size > 0").unionByName(drawn).groupBy(*keys).agg(
            F.sum("taken").alias("taken"), F.max("source_size").alias("source_size"), F.max("target").alias("target")
        )
        return some.unionByName(own.filter("size = 0")).select("doc_id", "size", "source_size", "target", "taken")

    def copies(self) -> DataFrame:
        """(doc_id, row key if there is one, copies): how often the slots draw the middle word of a document."""
        middle = F.floor((F.col("start") + F.floor(F.col("size") / 2)) / F.col("block_words"))
        return (
            self.rows.filter("size > 0").withColumn("block", middle)
            .join(self.slots, ["idx", "block"]).groupBy(*self.ids).agg(F.count("*").alias("copies"))
        )


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words_in("text").alias("size"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Words taken of each document: doc_id, size, source_size, target, taken.

    A null text has no words, a null source is a source of its own (the last in
    order). Repeated rows are documents of their own. An empty table gives no
    rows. Other columns of ``docs`` are not looked at.
    """
    return Mixture(sized_documents(docs), **options).taken()


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document as often as the mix draws its middle word.

    Same columns as ``docs``; a ``doc_id`` may be null or repeated. Documents without words are not drawn.
    """
    rows = keyed(docs)
    copies = Mixture(rows.select("doc_id", "source", words_in("text").alias("size"), ROW), **options).copies()
    drawn = rows.join(copies.select(F.col(ROW).alias("_drawn"), F.col("copies").alias("_copies")), F.col(ROW) == F.col("_drawn"))
    return drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*[drawn[c] for c in docs.columns])
