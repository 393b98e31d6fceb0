"""Exact deduplication by distributed MSD radix partitioning.

Texts are split by their leading bytes, then each part by the next bytes, until
a part holds one document or its texts have ended. A digit is a run of bytes and
grows with the depth, so a text of n bytes is used up after about log(n) rounds.
Texts of different length cannot be equal, so the length is the first digit.
Documents are told apart by comparing their bytes; no digest takes part.

A part is counted by an aggregate that combines before the shuffle; its rows are
never brought together. Rows meet their part's count in an equi join, whose
crowded partitions adaptive execution splits. A row leaves with its part: most
documents leave in the first round and only copies are read on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from haltscope.llm.common import by_row, keyed, stored, without_rows, without_space

FIRST_DIGIT = 64
DIGIT_GROWTH = 16


def _rounds(docs: DataFrame, first: int, growth: int):
    """Tables of rows that have left, one per round."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = F.encode(without_space(text), "UTF-8")
    rows = docs.select(
        "doc_id", F.char_length(text).alias("chars"), F.sha2(rest, 256).alias("text_sha256"),
        F.octet_length(rest).cast("long").alias("part"), rest.alias("rest"),
    )
    width, depth = first, 0
    while True:
        digit, ended = F.substring("rest", 1, width), F.octet_length("rest") <= width
        keyed = rows.select("*", digit.alias("digit"))
        best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id")))
        parts = keyed.groupBy("part", "digit").agg(F.count("*").alias("n"), best.alias("best"), F.max(ended).alias("ended"))
        parts = parts.select("part", "digit", F.col("n").alias("group_size"), F.col("best.doc_id").alias("keep_id"),
                             (F.col("ended") | (F.col("n") == 1)).alias("left"), F.monotonically_increasing_id().alias("next"))
        parts = stored(parts, f"radix-parts-{depth}")
        placed = keyed.join(parts, ["part", "digit"])
        open_rest = F.when(~F.col("left"), F.substring("rest", width + 1, (1 << 31) - 1 - width))
        done = stored(placed.select("doc_id", "chars", "text_sha256", F.col("next").alias("part"), open_rest.alias("rest"),
                                    "keep_id", "group_size", "left"), f"radix-rows-{depth}")
        yield done.filter("left").select("doc_id", "chars", "keep_id", "group_size", "text_sha256")
        rows = done.filter("not left").select("doc_id", "chars", "text_sha256", "part", "rest")
        if rows.isEmpty():
            return
        width, depth = width * growth, depth + 1


def exact_groups(docs: DataFrame, first_digit: int = FIRST_DIGIT, digit_growth: int = DIGIT_GROWTH) -> DataFrame:
    """One row per document with its group of equal texts.

    Texts are equal when they are so without ASCII white space; a null text counts
    as empty, and all texts without a character are one group. The row with the
    most code points, then the smallest ``doc_id`` (null last) stays. Of repeated
    rows with that ``doc_id`` one stays. Other columns are ignored; an empty table
    gives no rows.
    """
    out = None
    for left in _rounds(docs, first_digit, digit_growth):
        out = left if out is None else out.unionByName(left)
    # Repeated rows of the document that stays: the first one does.
    copy = F.row_number().over(Window.partitionBy("doc_id", "keep_id", "text_sha256").orderBy(F.desc("chars")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (copy == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, one of each group, with all their columns; a ``doc_id`` may be null or repeated."""
    rows = keyed(docs)
    gone = exact_groups(by_row(rows), **options).filter("not kept").select(F.col("doc_id.row").alias("_gone"))
    return without_rows(rows, gone)
