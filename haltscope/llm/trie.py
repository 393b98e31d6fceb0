"""Prefix trie of conversations as a distributed burst trie.

A conversation is the sequence of its turns' digests. Equal conversations are
counted once, as one weighted sequence. All sequences start in one container
under the root. A container with more turns than the limit bursts: its head
becomes a node, and its sequences move to containers named by their next turn.
When no container is too large, the shards (hash partitions of containers) are
sorted, and one sweep over the sorted suffixes, with a stack as deep as the
longest of them, writes the nodes below each head. Heads get the totals of what
hangs below them from one aggregate.

Only burst containers are read again in the next round, so each round costs
what is still too large. No container of more than one sequence and more than
the limit of turns meets in a task.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from haltscope.llm.common import stored

#: Turns of a container that does not burst yet; and containers that burst in one
#: round at most, for which the limit grows: their table is broadcast.
LIMIT, BURSTS = 1024, 100_000
#: Conversation ids that are written as one piece before their digest is taken.
TOGETHER_BITS = 12

#: Where conversations are cut and joined anew: h first turns of c - c % EVERY, with h below MOST.
EVERY, MOST = 100, 6

_NONE = sha256(b"").hexdigest()
_DIGITS = 64
_ROWS = 4096


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turns: digest and code points of each turn, by ``turn`` (null first; ties by digest).

    A conversation has to fit a row, where a turn takes about 80 bytes.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.struct("turn", digest.alias("id"), F.char_length(text).cast("long").alias("chars"))
    return turns.filter(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Like ``ordered_turns``, each conversation with its first h turns taken from conversation c - c % EVERY.

    h is crc32 of the decimal id modulo MOST; fewer turns if that conversation
    is shorter, none if it does not exist. The rest are its own turns after its first h.
    """
    own = ordered_turns(turns)
    bases = ordered_turns(turns.filter(F.col("conv_id") % EVERY == 0)).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, MOST - 1).alias("_first"))
    h = (F.crc32(F.col("conv_id").cast("string")) % MOST).cast("int")
    first = F.coalesce(F.slice("_first", F.lit(1), h), F.slice("turns", 1, 0))
    return own.join(bases, F.col("conv_id") - F.col("conv_id") % EVERY == F.col("_base"), "left").select(
        "conv_id", F.concat(first, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _with_ends(batches):
    """Sorted pieces of equal sequences to one row each, with the digest of their joined ids."""
    held, current, digest, n, first = None, None, None, 0, 0
    for batch in batches:
        starts, done = [], []
        for i, (key, piece, more, least) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "n", "first")), strict=True)):
            if key == current:
                digest.update(b"," + piece.encode())
                n += more
                continue
            if current is not None:
                done.append((digest.hexdigest(), n, first))
            current, digest, n, first = key, sha256(piece.encode()), more, least
            starts.append(i)
        rows = pa.Table.from_batches([batch.select(["key", "ids", "chars"]).take(pa.array(starts, pa.int64()))])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        held = rows.slice(len(done)).combine_chunks()
        yield from _finished(rows.slice(0, len(done)), done)
    if held is not None:
        yield from _finished(held, [(digest.hexdigest(), n, first)])


def _finished(rows: pa.Table, done: list[tuple]):
    ends, n, first = zip(*done) if done else ((), (), ())
    for name, values, kind in (("n", n, pa.int64()), ("first", first, pa.int64()), ("ends", ends, pa.string())):
        rows = rows.append_column(name, pa.array(values, kind))
    yield from rows.combine_chunks().to_batches()


def weighted(conversations: DataFrame) -> DataFrame:
    """One row per distinct sequence of turns.

    key (digest of the sequence), ids (its turns' digests, joined), chars, n
    (conversations), first (smallest id), ends (digest of their ids, comma-joined).
    Ids are joined in pieces by ranges before they meet, and digests are taken
    over a stream of pieces, so a large group of copies is a few rows.
    """
    ids = F.array_join(F.transform("turns", lambda t: t["id"]), "")
    rows = conversations.select("conv_id", ids.alias("ids"), F.transform("turns", lambda t: t["chars"]).alias("chars")).withColumn("key", F.sha2("ids", 256))
    listed = F.sort_array(F.collect_list("conv_id"))
    pieces = (rows.groupBy("key", F.shiftright("conv_id", TOGETHER_BITS).alias("range"))
              .agg(F.any_value("ids").alias("ids"), F.any_value("chars").alias("chars"), listed.alias("own"))
              .select("key", "range", "ids", "chars", F.array_join(F.transform("own", lambda c: c.cast("string")), ",").alias("piece"),
                      F.size("own").cast("long").alias("n"), F.element_at("own", 1).cast("long").alias("first")))
    return (pieces.repartition("key").sortWithinPartitions("key", "range")
            .mapInArrow(_with_ends, "key string, ids string, chars array<bigint>, n long, first long, ends string"))


NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
_FIELDS = [x.split()[0] for x in NODE.split(", ")]


class _Node:
    """A node on the sweep's stack; ``below`` are its finished children, whose parent's smallest member is not known yet."""

    __slots__ = ("depth", "chars", "n", "first", "ends", "leaves", "saved", "below")

    def __init__(self, depth, chars):
        self.depth, self.chars = depth, chars
        self.n, self.first, self.ends, self.leaves, self.saved, self.below = 0, None, _NONE, 0, 0, []

    def ended(self, n, first, ends):
        self.n, self.ends = self.n + n, ends
        self.first = first if self.first is None else min(self.first, first)

    def took(self, child: _Node):
        self.n += child.n
        self.first = child.first if self.first is None else min(self.first, child.first)
        self.leaves += child.leaves
        self.saved += child.saved
        self.below.append(child.row())

    def close(self):
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.chars
        return [(c[0], c[1], self.first, *c[2:], None) for c in self.below]

    def row(self):
        return (self.first, self.depth, self.n, len(self.below), self.leaves, self.saved, self.ends)


def _swept(batches):
    """Nodes of containers whose suffixes come in order; the head of a container also tells its path."""
    box, stack, last, up, path, out = None, [], "", None, None, []

    def close_to(depth):
        while len(stack) > 1 and stack[-1].depth > depth:
            node = stack.pop()
            out.extend(node.close())
            stack[-1].took(node)

    def close_box():
        close_to(-1)
        head = stack.pop()
        out.extend(head.close())
        first, *rest = head.row()
        out.append((first, rest[0], up, *rest[1:], path))

    def flush():
        columns = list(zip(*out))
        kinds = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.string())]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*_FIELDS, "path"])
        out.clear()
        return batch

    for batch in batches:
        for row in batch.to_pylist():
            ids, chars, start = row["ids"], row["chars"], row["depth"]
            if row["box"] != box:
                if stack:
                    close_box()
                box, up, path, last = row["box"], row["up"], row["path"], ""
                stack.append(_Node(start, chars[start - 1] if start else 0))
                common = start
            else:
                common, most = start, min(len(ids), len(last)) // _DIGITS
                while common < most and ids.startswith(last[common * _DIGITS:(common + 1) * _DIGITS], common * _DIGITS):
                    common += 1
                close_to(common)
            stack.extend(_Node(d, chars[d - 1]) for d in range(common + 1, len(chars) + 1))
            stack[-1].ended(row["n"], row["first"], row["ends"])
            last = ids
            if len(out) >= _ROWS:
                yield flush()
    if stack:
        close_box()
    if out:
        yield flush()


def prefix_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node of the trie over conversations (conv_id, turns): NODE.

    conv_id is the smallest member, saved_tokens sums (n_convs - 1) * code points
    of the last turn over the subtree, ends_sha256 is over the ids of
    conversations that end there. No conversations, no root.
    """
    spark = conversations.sparkSession
    seqs = stored(weighted(conversations), "sequences")
    turns = seqs.agg(F.sum(F.size("chars"))).first()[0]
    limit = max(limit, (turns or 0) // BURSTS)
    length = F.size("chars")
    opened = seqs.select("ids", "chars", "n", "first", "ends", F.sha2(F.substring("ids", 1, 0), 256).alias("box"), F.lit(None).cast("long").alias("up"), F.array().cast("array<string>").alias("path"))
    closed, heads, depth = [], [], 0
    while True:
        sizes = opened.groupBy("box").agg(F.sum(length - depth).alias("turns"), F.count("*").alias("seqs"))
        # At most BURSTS rows: each has more than turns / BURSTS turns.
        big = stored(sizes.filter((F.col("turns") > limit) & (F.col("seqs") > 1)).select("box"), f"burst-{depth}")
        if big.isEmpty():
            closed.append(opened.withColumn("depth", F.lit(depth)))
            break
        closed.append(opened.join(F.broadcast(big), "box", "left_anti").withColumn("depth", F.lit(depth)))
        following = F.when(length > depth, F.sha2(F.substring("ids", 1, _DIGITS * (depth + 1)), 256))
        hot = opened.join(F.broadcast(big), "box", "left_semi").withColumn("next", following)
        chars = F.element_at("chars", depth).cast("long") if depth else F.lit(0).cast("long")
        children = hot.groupBy("box", "next").agg(
            F.sum("n").alias("n"), F.min("first").alias("first"), F.max("up").alias("up"), F.max("path").alias("path"),
            F.max(chars).alias("chars"), F.max(F.when(F.col("next").isNull(), F.col("ends"))).alias("ends"))
        own = stored(children.groupBy("box").agg(
            F.min("first").alias("conv_id"), F.max("up").alias("parent_conv_id"), F.sum("n").alias("n_convs"), F.count("next").alias("n_children"),
            F.max("chars").alias("chars"), F.coalesce(F.max("ends"), F.lit(_NONE)).alias("ends_sha256"), F.max("path").alias("path"),
        ).withColumn("depth", F.lit(depth).cast("long")), f"heads-{depth}")
        heads.append(own)
        moved = hot.filter(F.col("next").isNotNull()).join(F.broadcast(own.select("box", F.col("conv_id").alias("_up"))), "box")
        opened = stored(moved.select("ids", "chars", "n", "first", "ends", F.col("next").alias("box"), F.col("_up").alias("up"),
                                     F.concat("path", F.array("box")).alias("path")), f"open-{depth + 1}")
        depth += 1

    containers = _union(closed).repartition("box").sortWithinPartitions("box", "ids")
    nodes = containers.mapInArrow(_swept, f"{NODE}, path array<string>")
    if not heads:
        return nodes.drop("path")
    nodes, tops = stored(nodes, "nodes"), _union(heads)
    own_saved = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")
    parts = nodes.filter(F.col("path").isNotNull()).select(F.explode("path").alias("box"), "n_leaves", "saved_tokens").unionByName(
        tops.select(F.explode(F.concat("path", F.array("box"))).alias("box"), F.lit(0).cast("long").alias("n_leaves"), own_saved))
    totals = parts.groupBy("box").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return nodes.select(*_FIELDS).unionByName(tops.join(totals, "box").select(*_FIELDS))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def trie_report(turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """NODE rows of the trie over all rebuilt conversations.

    A null role or text is empty, a null turn comes first, turns with equal
    numbers are ordered by their digest, repeated rows are turns each. Rows
    without a conv_id belong to no conversation and are left out. Texts may be
    of any length: only their digests and lengths are kept. Other columns are
    ignored; an empty table gives no rows.
    """
    return prefix_trie(rebuilt(turns.select("conv_id", "turn", "role", "text")), limit)
