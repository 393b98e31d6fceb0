"""The prefix trie against a plain one."""

import random
from hashlib import sha256
from zlib import crc32

import pytest

from haltscope.llm import trie


def plain(rows):
    said = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said.setdefault(c, []).append((turn is not None, turn or 0, sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    said = {c: [t[3:] for t in sorted(own)] for c, own in said.items()}
    members = {}
    for c, own in said.items():
        h = crc32(str(c).encode()) % 6
        base = int(c / 100) * 100
        seq = tuple(said.get(base, [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append((c, len(seq) == d))
    below = {node: [m for m in members if m[:len(node)] == node] for node in members}
    kids = {node: sum(len(m) == len(node) + 1 for m in below[node]) for node in members}
    out = []
    for node, own in members.items():
        saved = sum((len(members[m]) - 1) * (len(m[-1][1]) if m else 0) for m in below[node])
        ends = ",".join(str(c) for c in sorted(c for c, end in own if end))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out.append((min(c for c, _ in own), len(node), parent, len(own), kids[node], sum(kids[m] == 0 for m in below[node]), saved, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def check(spark, rows, limit):
    # Columns whose names the operator uses inside.
    turns = spark.createDataFrame([(*r, "x", 7, ["x"], 7) for r in rows], SCHEMA + ", box string, n long, path array<string>, depth int").repartition(3)
    got = trie.trie_report(turns, limit)
    assert got.columns == [c.split()[0] for c in trie.NODE.split(", ")]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


@pytest.mark.parametrize("limit", [1, 20, 10**6])
def test_against_plain(spark, limit):
    pick = random.Random(limit)
    rows = []
    for c in pick.sample(range(-250, 700), 260):
        for turn in range(pick.randrange(1, 9)):
            rows.append((c, turn, pick.choice(["user", "assistant", None]), pick.choice(["a", "bü", "ccc", None]) if pick.random() < 0.9 else str(pick.random())))
    check(spark, rows, limit)


@pytest.mark.parametrize("limit", [1, 1024])
def test_copies_ties_nulls(spark, limit):
    copies = [(c, k, "user", f"{k}") for c in range(1000, 1090) for k in range(3)]
    odd = [(1, None, None, None), (1, 1, "user", "x"), (1, 1, "user", "w"), (1, 1, "user", "w"), (2, 0, "user", "long " * 50_000), (None, 0, "user", "gone"), (200, 0, "user", ""), (-5, 2, "a", "b")]
    check(spark, copies + odd, limit)


def test_ids_over_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(trie, "TOGETHER_BITS", 1)
    check(spark, [(c, 0, "user", "same") for c in range(-9, 30)], 1)


def test_no_rows(spark):
    assert trie.trie_report(spark.createDataFrame([], SCHEMA)).collect() == []
