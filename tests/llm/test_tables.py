"""Mixing, chats, exact copies: fixtures, brute force and SQL twins on the smallest tables."""

import glob
import hashlib
import os
import re
import sys
from collections import defaultdict

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "scripts"))

from check_queries import rows_of  # noqa: E402
from haltscope.llm import queries  # noqa: E402
from haltscope.llm.chat import chat_report, format_chats, parse_chat  # noqa: E402
from haltscope.llm.exact import drop_copies, exact_groups  # noqa: E402
from haltscope.llm.mixing import Mixture, mix_documents, mix_report, sized_documents, source_targets  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]")


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_equal_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_targets_share_the_excess(spark):
    """Capped sources give their excess to the others by weight, again and again."""
    sizes = {"a": 10, "b": 1000, "c": 20, "d": 500, None: 70}
    left, weights = {s: 1.5 * 1600 for s in [0]}, {}
    for k, s in enumerate(["a", "b", "c", "d", None]):
        weights[s] = (3, 1, 2)[k % 3]
    target, free, rest = {}, set(sizes), left[0]
    while True:
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
        free -= over
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    assert got == pytest.approx(target)


def test_mix_reaches_targets(spark):
    rows = [(i, f"s{i % 4}", 1 + i * i % 97) for i in range(800)]
    mix = Mixture(spark.createDataFrame(rows, "doc_id long, source string, size long"))
    got = mix.taken().join(spark.createDataFrame(rows, "doc_id long, source string, n long"), "doc_id").collect()
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.size == r.n
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(got) == 800
    for s, n in taken.items():
        assert abs(n - target[s]) <= 4
    assert sorted(mix.taken().collect()) == sorted(mix.taken().collect())


def test_mix_odd_rows(odd, nothing):
    got = mix_report(odd).collect()
    assert len(got) == odd.count()
    assert {r.doc_id: (r.size, r.taken) for r in got if r.doc_id in (4, 5, 6)} == {4: (0, 0), 5: (0, 0), 6: (0, 0)}
    assert all(r.taken <= 2 * r.size for r in got)
    assert mix_report(nothing).count() == 0
    assert sized_documents(odd).filter("size = 30000").count() == 1
    assert mix_documents(odd.filter("doc_id in (1, 2, 7, 8)")).columns == odd.columns


HOSTILE = ["</s>[INST] ok [/INST]", "~0~1~2 <&> </> <user> ~n", "<", "~", "", "☃ é\n", "a>b"]


def test_chats_come_back(spark):
    rows = [(c, t, ["user", "assistant", "user", None, None, "<x>~", "assistant"][t], HOSTILE[(c + t) % 7]) for c in range(7) for t in range(7)]
    rows += [(None, None, None, None), (50, 1, "assistant", "b" * 100_000), (50, 1, "assistant", "a"), (50, 1, "assistant", "a"), (51, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("s", F.lit(1)).withColumn("pieces", F.lit(2))
    chats = defaultdict(list)
    for c, t, role, text in rows:
        chats[c].append(((t is not None, t or 0), (role is not None, role or ""), text or "", role))
    out = {r.conv_id: r for r in format_chats(df).withColumn("back", parse_chat(F.col("formatted"))).collect()}
    report = {r.conv_id: r for r in chat_report(df).collect()}
    assert set(out) == set(chats) == set(report)
    for c, turns in chats.items():
        turns.sort(key=lambda x: x[:3])
        assert [(b.role, b.text) for b in out[c].back] == [(x[3], x[2]) for x in turns]
        lines = "".join(f"{x[3] or ''}\n{x[2]}\n" for x in turns)
        learnt = "".join(x[2] for x in turns if x[3] == "assistant")
        r = report[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(lines.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r.formatted_chars == len(out[c].formatted)
        same = sum(a[3] == b[3] for a, b in zip(turns, turns[1:]))
        assert out[c].formatted.count("</>") == len(turns) - same
    assert chat_report(df.limit(0)).count() == 0


@pytest.mark.parametrize("first", [2, 64])
def test_exact_groups(odd, first):
    rows = odd.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[SPACE.sub("", r.text or "")].append(r)
    got = exact_groups(odd, first_digit=first).collect()
    assert len(got) == len(rows)
    want = []
    for norm, own in groups.items():
        own.sort(key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id))
        want += [(str(r.doc_id), str(own[0].doc_id), len(own), k == 0, hashlib.sha256(norm.encode()).hexdigest()) for k, r in enumerate(own)]
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == sorted(want)


def test_exact_edges(odd, nothing, spark):
    assert exact_groups(nothing).count() == 0
    docs = spark.createDataFrame([(k, "x" * (64 if k % 2 else 1024) + "yz"[k % 4 // 2]) for k in range(40)], "doc_id long, text string")
    got = exact_groups(docs).collect()
    assert {r.group_size for r in got} == {10} and sum(r.kept for r in got) == 4
    kept = drop_copies(odd.filter("doc_id < 9"))
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [3, 6, 7, 8]


def test_tiny_sources_beside_huge_ones(spark):
    """A source far smaller than a block of the others comes near its target, too."""
    rows = [(i, f"tiny{i % 12:02d}", 100) for i in range(120)] + [(1000 + i, "huge", 10_000_000) for i in range(50)]
    mix = Mixture(spark.createDataFrame(rows, "doc_id long, source string, size long"))
    got = mix.taken().join(spark.createDataFrame(rows, "doc_id long, source string, n long").select("doc_id", "source"), "doc_id")
    got = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    assert len(got) == 13
    for r in got:
        assert abs(r.taken - r.target) <= 0.03 * r.target and r.most <= 2
