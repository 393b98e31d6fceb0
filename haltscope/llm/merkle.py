"""Merkle manifest of a dataset, stored as blocks in van Emde Boas order.

The rows of a group are the leaves of a binary tree, in the order of their ids.
The tree is cut into aligned subtrees of HEIGHT levels. A task builds one of
them in an array whose parts are subtrees again: the upper half of the levels
first, then each subtree below them, recursively, so that a walk from a leaf to
the root touches few memory blocks of any size. ``places`` computes where a node
lies; building and looking up siblings both go through it. The roots of blocks
are the leaves of the next layer, until every group has one block; the roots of
the groups form a last tree in the same way.

No task holds more than the rows of one block (2^HEIGHT). Ranks come from a
range partitioning and one small table with a row per (partition, group).
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from haltscope.llm.common import stored

#: Levels of a block; it has up to 2^HEIGHT leaves.
HEIGHT = 10
#: Columns of a document that its leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_DIGEST = 32


def places(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Positions of nodes in the array of a tree with ``height`` levels.

    ``depth`` counts from the root, ``index`` from the left within that depth.
    """
    at, index = np.zeros(len(index), np.int64), np.asarray(index, np.int64)
    while height > 1:
        upper = height // 2
        lower = height - upper
        if depth < upper:
            height = upper
            continue
        depth -= upper
        at += (1 << upper) - 1 + (index >> depth) * ((1 << lower) - 1)
        index = index & ((1 << depth) - 1)
        height = lower
    return at


def levels_of(n: int) -> int:
    """Levels of the smallest complete tree with n leaves."""
    return max(n - 1, 0).bit_length() + 1


class Block:
    """An aligned subtree: ``n`` leaves under ``height`` levels, digests in van Emde Boas order.

    Nodes without leaves below them take their room and are never read.
    """

    def __init__(self, n: int, height: int, data: bytes | None = None):
        self.n, self.height = n, height
        self.data = bytearray(((1 << height) - 1) * _DIGEST) if data is None else data

    def width(self, depth: int) -> int:
        """Nodes at a depth."""
        return -(-self.n >> (self.height - 1 - depth))

    def level(self, depth: int) -> list[bytes]:
        at = places(self.height, depth, np.arange(self.width(depth))) * _DIGEST
        return [bytes(self.data[p:p + _DIGEST]) for p in at.tolist()]

    def put(self, depth: int, digests: list[bytes]) -> None:
        at = places(self.height, depth, np.arange(len(digests))) * _DIGEST
        for p, digest in zip(at.tolist(), digests, strict=True):
            self.data[p:p + _DIGEST] = digest

    @classmethod
    def built(cls, leaves: list[bytes], height: int) -> Block:
        """The block over ``leaves``; every two nodes, or a last single one, become their digest."""
        out = cls(len(leaves), height)
        out.put(height - 1, leaves)
        for depth in range(height - 2, -1, -1):
            below = [d.hex() for d in out.level(depth + 1)]
            out.put(depth, [sha256("".join(below[k:k + 2]).encode()).digest() for k in range(0, len(below), 2)])
        return out

    @property
    def root(self) -> bytes:
        return bytes(self.data[:_DIGEST])

    def siblings(self, index: np.ndarray) -> list[list[str]]:
        """Steps from each leaf up to the block's root: ``L`` or ``R`` with the sibling on that side, ``-`` without one."""
        steps = [[] for _ in range(len(index))]
        for depth in range(self.height - 1, 0, -1):
            other = index ^ 1
            at = places(self.height, depth, other) * _DIGEST
            width = self.width(depth)
            for own, o, p in zip(steps, other.tolist(), at.tolist(), strict=True):
                own.append("-" if o >= width else ("R" if o & 1 else "L") + bytes(self.data[p:p + _DIGEST]).hex())
            index = index >> 1
        return steps


def proof_of(steps: list[str]) -> str:
    """Digest of the siblings of a path, from the leaf to the root."""
    return sha256("".join([s[1:] for s in steps]).encode()).hexdigest()


def fold(leaf: str, steps: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for s in steps:
        pair = leaf + s[1:] if s[0] == "R" else s[1:] + leaf
        leaf = sha256(pair.encode()).hexdigest()
    return leaf


def leaf_digest(fields=FIELDS, **changed: Column) -> Column:
    """Digest of a row's columns: each ``-`` if null, else its length in bytes, ``:`` and its text."""
    def part(name):
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[part(f) for f in fields]), 256)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows, written once, with ``pos``: their place in their group from 0, and ``n``: the group's rows.

    Rows are dealt by ranges of (group, order), so a large group is spread over
    many tasks; the number of a row is its place in its partition plus the rows
    of the group in earlier ones.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = stored(dealt.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_id", 33)
    firsts = rows.groupBy(part.alias("_part"), F.col(group).alias("_grp")).agg(F.min("_id").alias("_first"), F.count("*").alias("_here"))
    upto = Window.partitionBy("_grp").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("_before", F.coalesce(F.sum("_here").over(upto), F.lit(0))).withColumn("n", F.sum("_here").over(Window.partitionBy("_grp")))
    firsts = stored(firsts, "ranges")
    same = (part == F.col("_part")) & F.col(group).eqNullSafe(F.col("_grp"))
    return (rows.join(firsts, same)
            .withColumn("pos", F.col("_before") + F.col("_id") - F.col("_first"))
            .drop("_id", "_part", "_grp", "_first", "_here", "_before"))


_BLOCK = "grp string, layer int, block long, n long, leaves int, height int, data binary, root string"


def _build(layer: int, height: int):
    def run(key, table):
        grp, block, n = (k.as_py() for k in key)
        order = np.argsort(table.column("pos").to_numpy())
        leaves = [bytes.fromhex(x) for x in table.column("digest").take(pa.array(order)).to_pylist()]
        # The last layer of a group ends where one node remains.
        own = levels_of(len(leaves)) if n <= 1 << height else height + 1
        built = Block.built(leaves, own)
        return pa.table({
            "grp": pa.array([grp], pa.string()), "layer": pa.array([layer], pa.int32()), "block": pa.array([block], pa.int64()), "n": pa.array([n], pa.int64()),
            "leaves": pa.array([len(leaves)], pa.int32()), "height": pa.array([own], pa.int32()),
            "data": pa.array([bytes(built.data)], pa.binary()), "root": pa.array([built.root.hex()]),
        })

    return run


class Forest:
    """One tree per group.

    ``layers``: tables of blocks (grp, layer, block, n, leaves, height, data, root);
    the first one stands on the rows. ``roots``: grp, root.
    """

    def __init__(self, rows: DataFrame, height: int = HEIGHT):
        """``rows``: grp, pos from 0 without gaps, n (rows of the group), digest in hex."""
        self.height, self.layers = height, []
        nodes, most = rows.select("grp", "pos", "n", "digest"), rows.agg(F.max("n")).first()[0] or 0
        while True:
            blocks = (nodes.withColumn("block", F.shiftright("pos", height)).groupBy("grp", "block", "n")
                      .applyInArrow(_build(len(self.layers), height), _BLOCK))
            self.layers.append(stored(blocks, f"blocks-{len(self.layers)}"))
            if most <= 1 << height:
                break
            # Groups with a single block are done and rise no further.
            nodes = self.layers[-1].filter(F.col("n") > 1 << height).select(
                "grp", F.col("block").alias("pos"), F.ceil(F.col("n") / (1 << height)).cast("long").alias("n"), F.col("root").alias("digest"))
            most = -(-most >> height)
        tops = [b.filter(F.col("n") <= 1 << height) for b in self.layers]
        self.roots = tops[0].select("grp", "root")
        for t in tops[1:]:
            self.roots = self.roots.unionByName(t.select("grp", "root"))

    def paths(self, above: DataFrame) -> DataFrame:
        """grp, block, steps, and what else ``above`` has: the way from the root of every block of the first layer upwards.

        ``above`` has a row (grp, steps, ...) per group: what follows the group's root.
        """
        more = [c for c in above.columns if c not in ("grp", "steps")]
        found = None
        for k in range(len(self.layers) - 1, -1, -1):
            tops = self.layers[k].filter(F.col("n") <= 1 << self.height).select("grp", "block").alias("b")
            own = tops.join(above.alias("a"), F.col("b.grp").eqNullSafe(F.col("a.grp"))).select("b.grp", "block", "a.steps", *[f"a.{c}" for c in more])
            own = own if found is None else own.unionByName(found)
            if k:
                # The blocks below are leaves of this layer.
                own = stored(own, f"paths-{k}")
                below = self.layers[k - 1].filter(F.col("n") > 1 << self.height).select("grp", F.col("block").alias("pos"))
                found = self._looked_up(k, below, own, ["pos"], more, lambda steps, rows: {"steps": pa.array(steps, pa.list_(pa.string()))}, "steps array<string>")
                found = found.withColumnRenamed("pos", "block")
        return own

    def proofs(self, rows: DataFrame, above: DataFrame, keep: list[str], of, columns: str) -> DataFrame:
        """For rows (grp, pos, and ``keep``): grp, ``keep``, what else ``above`` has, and the columns that ``of`` makes of the steps."""
        more = [c for c in above.columns if c not in ("grp", "steps")]
        return self._looked_up(0, rows, stored(self.paths(above), "paths-0"), keep, more, of, columns)

    def _looked_up(self, layer: int, rows: DataFrame, upper: DataFrame, keep: list[str], more: list[str], of, columns: str) -> DataFrame:
        """Rows, their block and the way above it meet in one task; ``of`` gets steps and rows."""
        types, height = dict(rows.dtypes) | dict(upper.dtypes), self.height
        schema = ", ".join([f"{c} {types[c]}" for c in ("grp", *keep, *more)] + [columns])
        same = F.col("b.grp").eqNullSafe(F.col("u.grp")) & (F.col("b.block") == F.col("u.block"))
        blocks = self.layers[layer].alias("b").join(upper.alias("u"), same).select(
            "b.grp", "b.block", "leaves", "height", "data", "steps", *[f"u.{c}" for c in more])

        def run(key, mine, block):
            if not mine.num_rows or not block.num_rows:
                raise ValueError(f"rows and block {key[1].as_py()} of group {key[0].as_py()!r} do not meet")
            b = block.to_pylist()[0]
            tree = Block(b["leaves"], b["height"], b["data"])
            index = mine.column("pos").to_numpy() - (key[1].as_py() << height)
            steps = [own + b["steps"] for own in tree.siblings(index)]
            same = {c: pa.array([b[c]] * mine.num_rows, pa.string()) for c in more}
            return pa.table({c: mine.column(c) for c in ("grp", *keep)} | same | of(steps, mine))

        rows = rows.withColumn("block", F.shiftright("pos", height)).select("grp", "block", "pos", *[c for c in keep if c != "pos"])
        return rows.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block")).applyInArrow(run, schema)


class Manifest:
    """Trees over documents, one per language, and the tree over their roots.

    ``rows``: doc_id, grp (language), digest (the leaf), other, pos, n; ``other``
    is a leaf that is tried in place of the real one, or null. ``above``: per
    language the way from its root to the last one, with subroot and root.
    """

    def __init__(self, docs: DataFrame, other: Column | None = None, height: int = HEIGHT):
        leaves = docs.select("doc_id", F.col("lang").alias("grp"), leaf_digest().alias("digest"), (F.lit(None).cast("string") if other is None else other).alias("other"))
        self.rows = ranked(leaves, "grp", ["doc_id", "digest"])
        self.forest = Forest(self.rows, height)
        tops = ranked(self.forest.roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest")), "grp", ["name"])
        top = Forest(tops, height)
        last = top.roots.select("grp", F.array().cast("array<string>").alias("steps"), "root")
        steps = top.proofs(tops, last, ["name", "digest"], lambda steps, rows: {"steps": pa.array(steps, pa.list_(pa.string()))}, "steps array<string>")
        self.above = stored(steps.select(F.col("name").alias("grp"), "steps", F.col("digest").alias("subroot"), "root"), "above")

    def proofs(self) -> DataFrame:
        """doc_id, grp, digest, steps (leaf to root), subroot, root of every row."""
        return self.forest.proofs(self.rows, self.above, ["doc_id", "digest"], lambda steps, rows: {"steps": pa.array(steps, pa.list_(pa.string()))}, "steps array<string>")

    def checks(self) -> DataFrame:
        """doc_id, digest, subroot, root, proof_sha256, and folded_root: where ``other``, or else the leaf, leads."""

        def of(steps, rows):
            leaves = [o or d for o, d in zip(rows.column("other").to_pylist(), rows.column("digest").to_pylist(), strict=True)]
            return {"proof_sha256": pa.array([proof_of(s) for s in steps], pa.string()),
                    "folded_root": pa.array([fold(d, s) for d, s in zip(leaves, steps, strict=True)], pa.string())}

        return self.forest.proofs(self.rows, self.above, ["doc_id", "digest", "other"], of, "proof_sha256 string, folded_root string")


#: Rows are tampered with where this divides the checksum of their id.
TAMPERED = 7


def manifest_report(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document.

    Where TAMPERED divides crc32 of the decimal doc_id, folded_root is computed
    from a leaf whose n_chars is one more; a null n_chars stays null, so such a
    row still verifies. A null doc_id is never tampered with and comes first in
    its language; a null language is one of its own, before all others. Rows
    with equal ids are ordered by their leaves, repeated rows are leaves each.
    An empty text has length 0 and differs from null. Other columns are
    ignored. An empty table gives no rows and has no root.
    """
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    other = F.when(hit, leaf_digest(n_chars=F.col("n_chars") + 1))
    rows = Manifest(docs, other, height).checks()
    return rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
