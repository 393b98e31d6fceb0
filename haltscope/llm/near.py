"""Near-duplicate documents by b-bit MinHash.

Documents with the same set of shingles are one node. Minima of ``BANDS * ROWS``
hash functions make band keys, and their low bits a packed signature. Nodes that
share a band key are candidates:

* in a bucket of up to ``SMALL`` nodes, every node with every other;
* in every bucket, each node with the bucket's hub: the node that shares its
  bands with the most others. A group of copies of one text is so tied to it
  with one pair per node and band, whatever the size of the group;
* then, until a round finds no new link, each bucket that still holds several
  components gets its next hub from outside the component of the first;
* the members of buckets that hold several components even then are joined on the
  shingles of their prefixes. Shingles have one order for all, rare ones first;
  two sets as similar as the threshold share one of the first n - threshold * n + 1
  of each. This finds every similar pair among them, with no limit on a bucket.

Candidates whose collision-corrected similarity, estimated from the bits that
agree, is within reach of the threshold are confirmed on the full sets.
Components come from alternating large-star and small-star steps. No step brings
the nodes of a bucket or a component together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from haltscope.llm.common import by_row, dropped, give_back, keyed, stored, tidy, without_rows

BANDS, ROWS = 26, 6
SMALL = 8
BITS = 4
#: Standard errors below the threshold at which an estimate still counts as within reach.
REACH = 4.5
BLOCK = 8192
# Counters by which shingles are called rare; two that share one only get a less useful order.
COUNTERS = 1 << 18
# Bits per node by which the rows to be read again are told apart, and the most bits there are.
ROW_BITS, MOST_BITS = 16, 1 << 25

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_EMPTY = np.empty(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


def shingle_set(words: list[bytes], size: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words; of all words together if there are fewer."""
    for w in words:
        if w not in hashes:
            hashes[w] = xxhash.xxh64_intdigest(w)
    h = np.array([hashes[w] for w in words], np.uint64)
    if not len(h):
        return _EMPTY
    if len(h) < size:
        out = np.full(1, len(h), np.uint64)
        for x in h:
            out = _mix(out * _M1 + x)
        return out
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = _mix(out * _M1 + h[k:len(h) - size + 1 + k])
    return np.unique(out)


class Sketcher:
    def __init__(self, bands: int, rows: int, bits: int = BITS, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bits = bands, rows, bits
        self.a = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), BLOCK):
            block = shingles[None, at:at + BLOCK] ^ self.b[:, None]
            block *= self.a[:, None]
            np.minimum(out, block.min(axis=1), out=out)
        return _mix(out)

    def keys(self, minima: np.ndarray) -> np.ndarray:
        m = minima.reshape(self.bands, self.rows)
        out = np.arange(1, self.bands + 1, dtype=np.uint64)
        for k in range(self.rows):
            out = _mix(out * _M1 + m[:, k])
        return out.view(np.int64)

    def signature(self, minima: np.ndarray) -> np.ndarray:
        """The low bits of all minima, packed into 64-bit words."""
        per = 64 // self.bits
        low = np.zeros(-(-len(minima) // per) * per, np.uint64)
        low[:len(minima)] = minima & np.uint64((1 << self.bits) - 1)
        shifts = np.arange(per, dtype=np.uint64) * np.uint64(self.bits)
        return np.bitwise_or.reduce(low.reshape(-1, per) << shifts, axis=1).view(np.int64)


def _sets(batch, size: int):
    hashes: dict[bytes, int] = {}
    for text in batch.column("text").cast(pa.binary()).to_pylist():
        if len(hashes) > 100_000:
            hashes = {}
        yield shingle_set((text or b"").lower().split(), size, hashes)


def _node(shingles: np.ndarray) -> int:
    """A name for a set: documents with the same set have the same."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64)) if len(shingles) else 0


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([_EMPTY.view(np.int64), *arrays]), pa.int64()))


def sketch(docs: DataFrame, words: int, sketcher: Sketcher) -> DataFrame:
    """doc_id, mark, node, n_shingles, keys, signature; node, keys and signature are null without words.

    ``mark`` is a hash of the text: with ``doc_id`` it finds a row again, also where ids are null or repeated.
    """

    def run(batches):
        for batch in batches:
            n, node, keys, bits = [], [], [], []
            for s in _sets(batch, words):
                m = sketcher.minima(s) if len(s) else None
                n.append(len(s))
                node.append(_node(s) if len(s) else None)
                keys.append(_EMPTY.view(np.int64) if m is None else sketcher.keys(m))
                bits.append(_EMPTY.view(np.int64) if m is None else sketcher.signature(m))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(node, pa.int64()), pa.array(n, pa.int64()), _lists(keys), _lists(bits)],
                                             ["doc_id", "mark", "node", "n_shingles", "keys", "signature"])
        give_back()

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, mark long, node long, n_shingles long, keys array<long>, signature array<long>")


def _maybe_wanted(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (doc_id, mark, ...) that may be those of ``nodes``: all that are, and few others.

    Hashes of the wanted rows set bits of a table that is sent to the tasks, so
    the texts of all other rows are not shuffled. Beyond ``MOST_BITS`` bits more
    of the others pass; the join behind it decides.
    """
    size, bits = nodes.count() * ROW_BITS, 64
    while bits < min(size, MOST_BITS):
        bits *= 2
    slot = F.xxhash64("doc_id", "mark").bitwiseAND(F.lit(bits - 1))
    word, place = F.shiftright("_slot", 6), F.col("_slot").bitwiseAND(F.lit(63)).cast("int")
    table = nodes.select(slot.alias("_slot")).groupBy(word.alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("_bits"))
    marked = rows.withColumn("_slot", slot).join(F.broadcast(table), word == F.col("_word"))
    return marked.filter(F.getbit("_bits", place) == 1).drop("_slot", "_word", "_bits")


def _full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of some nodes, read again from the text of one document each."""

    def run(batches):
        for batch in batches:
            sets = list(_sets(batch, words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([_node(s) for s in sets], pa.int64()), _lists([s.view(np.int64) for s in sets])],
                ["node", "found", "shingles"])

    wanted = nodes.select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark"), "node")
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark"))
    rows = _maybe_wanted(docs.select("doc_id", "text", F.xxhash64("text").alias("mark")), nodes).join(wanted, same).select("node", "text")
    found = rows.mapInArrow(run, "node long, found long, shingles array<long>").filter("node = found")
    return found.select("node", "shingles").dropDuplicates(["node"])


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (_mix(shingles.view(np.uint64) * _M1) & np.uint64(COUNTERS - 1)).astype(np.int64)


def _flat(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.int64)


def shingle_counts(sets: DataFrame) -> np.ndarray:
    """How many of the sets have a shingle, by the counter of the shingle."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(_slots(_flat(batch.column("shingles"))), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    found = sets.select("shingles").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COUNTERS, np.int64)
    out[found["slot"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def prefixes(sets: DataFrame, threshold: int) -> DataFrame:
    """(node, root, n, at, shingle): the shingles of (node, root, shingles) of which two similar sets share one."""
    counts = sets.sparkSession.sparkContext.broadcast(shingle_counts(sets))

    def run(batches):
        for batch in batches:
            shingles = _flat(batch.column("shingles"))
            sizes = np.asarray(batch.column("shingles").value_lengths(), np.int64)
            parts = [_EMPTY.view(np.int64)]
            for end, n in zip(np.cumsum(sizes), sizes, strict=True):
                own = shingles[end - n:end]
                parts.append(own[np.lexsort((own, counts.value[_slots(own)]))[:n - (threshold * n + 99) // 100 + 1]])
            taken = np.array([len(x) for x in parts[1:]], np.int64)
            at = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)
            row = pa.array(np.repeat(np.arange(len(taken)), taken))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node").take(row), batch.column("root").take(row), pa.array(np.repeat(sizes, taken)), pa.array(at),
                 pa.array(np.concatenate(parts))], ["node", "root", "n", "at", "shingle"])

    return sets.select("node", "root", "shingles").mapInArrow(run, "node long, root long, n long, at long, shingle long")


def similarity(left, right, functions: int, bits: int = BITS):
    """Collision-corrected similarity of two packed signatures: (share of equal low bits - 2^-bits) / (1 - 2^-bits)."""
    ones = int("".join(["0" * (bits - 1) + "1"] * (64 // bits)), 2)

    def unequal(x, y):
        d = x.bitwiseXOR(y)
        some = d
        for k in range(1, bits):
            some = some.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(some.bitwiseAND(F.lit(ones)))

    off = F.aggregate(F.zip_with(left, right, unequal), F.lit(0), lambda a, x: a + x)
    chance = 2.0 ** -bits
    return (1.0 - off / F.lit(float(functions)) - chance) / (1.0 - chance)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the smallest node it is connected with."""
    pairs = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        before, pairs = pairs, stored(small.select("e.a", "e.b").filter("a != b").distinct(), "star")
        dropped(before)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = pairs.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


class NearCopies:
    """Links and components of near-duplicate documents."""

    def __init__(self, docs: DataFrame, words: int = 3, threshold: int = 85, bands: int = BANDS, rows: int = ROWS):
        self.threshold, self.functions = threshold, bands * rows
        self.docs = stored(sketch(docs, words, Sketcher(bands, rows)), "near-sketch")
        known = self.docs.filter(F.col("node").isNotNull())
        nodes = known.groupBy("node").agg(
            F.min(F.struct("doc_id", "mark")).alias("row"), F.max("n_shingles").alias("n"), F.any_value("keys").alias("keys"), F.any_value("signature").alias("signature"))
        nodes = stored(nodes.select("node", "row.*", "n", "keys", "signature"), "near-nodes")
        buckets = nodes.select("node", F.explode("keys").alias("key"))
        shared = buckets.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
        members = stored(buckets.join(shared, "key"), "near-buckets")
        weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
        self.members = stored(members.join(weight, "node"), "near-members")
        some = stored(nodes.join(self.members.select("node", "weight").distinct(), "node").select("node", "doc_id", "mark", "n", "signature"), "near-some")
        dropped(nodes, members)
        tidy(docs.sparkSession)
        self.nodes = some.select("node", "n", "signature")
        self.sets = stored(_full_sets(docs, some, words), "near-sets")
        tidy(docs.sparkSession)
        self.roots, self.edges = self._link()
        dropped(self.sets)
        tidy(docs.sparkSession)

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose sets are similar: by the estimate first, then in full."""
        t = self.threshold / 100
        reach = t - REACH * (t * (1 - t) / self.functions) ** 0.5
        side = lambda x: self.nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b")
        near = near.filter(100 * F.least("na", "nb") >= self.threshold * F.greatest("na", "nb"))
        near = stored(near.filter(similarity(F.col("sa"), F.col("sb"), self.functions) >= F.lit(reach)).select("a", "b", "na", "nb"), "near-pairs")
        full = lambda x: self.sets.select(F.col("node").alias(x), F.col("shingles").alias(f"f{x}"))
        both = F.size(F.array_intersect("fa", "fb"))
        out = near.join(full("a"), "a").join(full("b"), "b").select("a", "b", both.alias("both"), (F.col("na") + F.col("nb") - both).alias("any"))
        out = stored(out.filter(100 * F.col("both") >= self.threshold * F.col("any")).select("a", "b"), "near-edges")
        dropped(near)
        tidy(self.docs.sparkSession)
        return out

    def _hubs(self, members: DataFrame) -> DataFrame:
        return members.groupBy("key").agg(F.max_by("node", F.struct("weight", "node")).alias("hub"))

    def _link(self) -> tuple[DataFrame, DataFrame]:
        pair = [F.greatest("hub", "node").alias("a"), F.least("hub", "node").alias("b")]
        hubs = stored(self._hubs(self.members), "near-hubs")
        star = self.members.join(hubs, "key").filter("hub != node").select(*pair)
        few = self.members.filter(F.col("size") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("all"))
        few = few.select("all", F.posexplode("all").alias("i", "b")).select("b", F.explode(F.slice("all", F.col("i") + 2, SMALL)).alias("a"))
        edges = self._confirmed(star.unionByName(few.select("a", "b")).distinct())
        while True:
            roots = connected(edges)
            placed = self.members.join(roots, "node", "left").select("key", "node", "size", "weight", F.coalesce("root", "node").alias("root"))
            placed = stored(placed, "near-placed")
            first = placed.join(hubs.withColumnRenamed("hub", "node"), ["key", "node"]).select("key", F.col("root").alias("first"))
            # Large buckets with a second component: its hub meets all of the others.
            open_rows = placed.join(first, "key")
            outside = open_rows.filter("root != first")
            hubs = stored(self._hubs(outside.select("key", "node", "weight")), "near-hubs")
            from_hub = placed.join(hubs.withColumnRenamed("hub", "node"), ["key", "node"]).select("key", F.col("node").alias("hub"), F.col("root").alias("own"))
            pairs = placed.join(from_hub, "key").filter("root != own").select(*pair).distinct()
            new = self._confirmed(pairs)
            if new.isEmpty():
                break
            before, edges = edges, stored(edges.unionByName(new), "near-edges")
            dropped(before, new, placed)
        rest = self._confirmed(self._prefix_pairs(placed))
        dropped(placed, self.members)
        if rest.isEmpty():
            return roots, edges
        edges = stored(edges.unionByName(rest), "near-edges")
        return connected(edges), edges

    def _prefix_pairs(self, placed: DataFrame) -> DataFrame:
        """Pairs (a, b) that can be similar, among the members of buckets (key, node, root, size) with more than one component."""
        several = placed.filter(F.col("size") > SMALL).groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
        nodes = placed.join(several, "key", "left_semi").select("node", "root").distinct()
        rows = stored(prefixes(self.sets.join(nodes, "node"), self.threshold), "near-prefixes")
        # The largest component of a shingle is not joined with itself.
        parts = rows.groupBy("shingle", "root").agg(F.count("*").alias("size"))
        parts = parts.groupBy("shingle").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("size", "root")).alias("most"))
        shared = stored(rows.join(parts.filter("parts > 1").drop("parts"), "shingle"), "near-shared")
        one = shared.filter("root != most").select("shingle", *[F.col(c).alias(f"{c}1") for c in ("node", "root", "n", "at")])
        two = shared.select("shingle", *[F.col(c).alias(f"{c}2") for c in ("node", "root", "n", "at")])
        t, sizes = self.threshold, F.col("n1") + F.col("n2")
        # The first shared shingle and all that follow it have to be enough.
        most = F.least(F.col("n1") - F.col("at1"), F.col("n2") - F.col("at2"))
        near = (one["shingle"] == two["shingle"]) & (F.col("root1") != F.col("root2")) & (100 * F.least("n1", "n2") >= t * F.greatest("n1", "n2"))
        near &= (100 + t) * most >= t * sizes
        return one.join(two, near).select(F.greatest("node1", "node2").alias("a"), F.least("node1", "node2").alias("b")).distinct()

    def report(self) -> DataFrame:
        """One row per document: doc_id, n_shingles, component_id, kept."""
        named = self.docs.filter(F.col("node").isNotNull()).join(self.roots, "node", "left").select(
            "doc_id", "n_shingles", F.coalesce("root", "node").alias("root"))
        least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        linked = named.join(least, "root").select("doc_id", "n_shingles", "component_id")
        alone = self.docs.filter(F.col("node").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        out = linked.unionByName(alone)
        return out.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_copies(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Texts are lower-cased in A-Z. A text with fewer words than a shingle has one
    of all its words; one without words (or a null text) has none and is linked
    with nothing. Repeated rows share their component; of rows with the smallest
    ``doc_id`` of a component all count as kept. A row without ``doc_id`` is linked
    like any other; it is never the smallest, and kept only where all rows of its
    component have none. Other columns are ignored; an empty table gives no rows.
    """
    return NearCopies(docs, **options).report()


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, with all its columns; a ``doc_id`` may be null or repeated."""
    rows = keyed(docs)
    gone = near_copies(by_row(rows), **options).filter("not kept").select(F.col("doc_id.row").alias("_gone"))
    return without_rows(rows, gone)
