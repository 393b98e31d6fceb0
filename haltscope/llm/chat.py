"""Chat formatting with Spark expressions only.

Template: every run of turns of one role is a block ``<role>text<&>text</>``.
``~``, ``<`` and ``>`` inside roles and texts are written ``~0``, ``~1`` and
``~2``, so no text can hold a control string and the original comes back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NEXT, END = "<&>", "</>"
NULL_ROLE = "~n"
_MARKS = (("~", "~0"), ("<", "~1"), (">", "~2"))


def escape(text: Column) -> Column:
    for plain, written in _MARKS:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(_MARKS):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def _merged(turns: Column) -> Column:
    """Blocks of adjacent turns with one role: array of (role, texts)."""
    empty = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def add(blocks, turn):
        last = F.element_at(blocks, -1)
        fresh = F.array(F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts")))
        longer = F.array(F.struct(turn["role"].alias("role"), F.array_append(last["texts"], turn["text"]).alias("texts")))
        same = (F.size(blocks) > 0) & F.try_element_at(blocks, F.lit(-1))["role"].eqNullSafe(turn["role"])
        return F.when(same, F.concat(F.slice(blocks, 1, F.size(blocks) - 1), longer)).otherwise(F.concat(blocks, fresh))

    return F.aggregate(turns, empty, add)


def _pieces(blocks: Column, loss_role: str) -> Column:
    """The output in pieces (s, loss), in order."""
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    no = F.lit(False)

    def of(block):
        head = F.concat(F.lit("<"), F.coalesce(escape(block["role"]), F.lit(NULL_ROLE)), F.lit(">"))
        learnt = F.coalesce(block["role"] == F.lit(loss_role), no)
        texts = F.flatten(F.transform(block["texts"], lambda t, i: F.array(
            piece(F.when(i == 0, F.lit("")).otherwise(F.lit(NEXT)), no), piece(escape(t), learnt))))
        return F.concat(F.array(piece(head, no)), texts, F.array(piece(F.lit(END), no)))

    return F.flatten(F.transform(blocks, of))


def _spans(pieces: Column) -> Column:
    """(start, n) in code points of the pieces under the loss mask; start counts from 1."""
    zero = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,n:int>>").alias("spans"))

    def add(acc, p):
        n = F.char_length(p["s"])
        span = F.struct(acc["at"].alias("start"), n.alias("n"))
        spans = F.when(p["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((acc["at"] + n).alias("at"), spans.alias("spans"))

    return F.aggregate(pieces, zero, add, lambda acc: acc["spans"])


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) per conversation.

    Turns are put in the order of (turn, role, text), nulls first, so ties have a
    fixed order and repeated rows stay. A null text is an empty text, a null role
    a role of its own, a null ``conv_id`` a conversation. Other columns are
    ignored. One conversation becomes one string: it has to fit one row.
    """
    row = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    chats = chats.select("conv_id", _pieces(_merged(F.col("turns")), loss_role).alias("pieces"))
    return chats.select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        _spans(F.col("pieces")).alias("loss_spans"),
    )


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    blocks = F.split(formatted, END)
    blocks = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))

    def of(block):
        written = F.substring_index(block, ">", 1)
        role = F.when(written != F.lit("<" + NULL_ROLE), unescape(F.substr(written, F.lit(2))))
        body = F.substr(block, F.char_length(written) + 2)
        return F.transform(F.split(body, NEXT, -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, of))


def chat_report(turns: DataFrame) -> DataFrame:
    """Digests of what comes back from the formatted conversations."""
    out = format_chats(turns)
    back = out.select(
        "conv_id", "formatted", parse_chat(F.col("formatted")).alias("turns"),
        F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"], s["n"]))), "").alias("learnt"),
    )
    lines = F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
