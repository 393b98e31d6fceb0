"""The Merkle manifest against a plain tree."""

from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from haltscope.llm import merkle


def h(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    out = ""
    for name in merkle.FIELDS:
        v = row[name]
        if name == "n_chars" and v is not None:
            v += more
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def tree(leaves):
    """Levels from the leaves to the root, and each leaf's steps as (sibling or None, is it on the right)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k:k + 2])) for k in range(0, len(levels[-1]), 2)])
    ways = []
    for k in range(len(leaves)):
        way = []
        for level in levels[:-1]:
            o = k ^ 1
            way.append((level[o] if o < len(level) else None, o > k))
            k //= 2
        ways.append(way)
    return levels[-1][0], ways


def walk(own, way):
    for other, right in way:
        own = h(own + (other or "") if right or other is None else other + own)
    return own


def plain(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own, subs = {}, []
    for lang in langs:
        mine = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        own[lang] = mine, *tree([leaf(r) for r in mine])
        subs.append(own[lang][1])
    root, tops = tree(subs)
    out = []
    for lang, top in zip(langs, tops):
        mine, sub, ways = own[lang]
        for r, way in zip(mine, ways):
            hit = r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 7 == 0
            folded = walk(leaf(r, 1 if hit else 0), way + top)
            proof = h("".join(s or "" for s, _ in way + top))
            out.append((r["doc_id"], leaf(r), sub, root, proof, folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("height", range(1, 12))
def test_places_are_an_order_of_all_nodes(height):
    at = np.concatenate([merkle.places(height, d, np.arange(1 << d)) for d in range(height)])
    assert sorted(at.tolist()) == list(range((1 << height) - 1))


def test_subtrees_lie_together():
    # Eight levels: the upper four first, then sixteen subtrees of fifteen nodes.
    for k in range(16):
        at = np.concatenate([merkle.places(8, 4 + d, np.arange(k << d, k + 1 << d)) for d in range(4)])
        assert sorted(at.tolist()) == list(range(15 * (k + 1), 15 * (k + 2)))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 21])
def test_block(n):
    leaves = [sha256(bytes([k])).digest() for k in range(n)]
    block = merkle.Block.built(leaves, merkle.levels_of(n))
    root, ways = tree([x.hex() for x in leaves])
    assert block.root.hex() == root
    steps = block.siblings(np.arange(n))
    assert [[(None if s == "-" else s[1:]) for s in own] for own in steps] == [[o for o, _ in w] for w in ways]
    assert all(merkle.fold(x.hex(), s) == root for x, s in zip(leaves, steps))


@pytest.mark.parametrize("height", [1, 2, 10])
def test_report(spark, odd, height):
    rows = [(k, f"text {k} ü", ["en", "de", None, "fr"][0 if k % 3 else k % 4], None if k % 5 == 0 else "a", None if k % 11 == 0 else k) for k in range(75)]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    got = merkle.manifest_report(docs, height)
    assert sorted(map(tuple, got.collect()), key=str) == plain([r.asDict() for r in docs.collect()])


def test_odd_columns_and_no_rows(odd, nothing):
    got = [tuple(r) for r in merkle.manifest_report(odd).collect()]
    assert sorted(got, key=str) == plain([r.asDict() for r in odd.collect()])
    assert merkle.manifest_report(nothing).collect() == []


def test_single_group(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = merkle.manifest_report(docs).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == h("")
