"""Each stage of the pipeline against a plain version, on its own input."""

import os

import pytest
from test_models import components

import corpus_pipeline
from haltscope.llm import exact, mixing, near, quality

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        before = {r.doc_id: r for r in docs.collect()}
        after = out.collect()
        if name != "encode":
            assert out.columns == docs.columns
            assert all(tuple(r) == tuple(before[r.doc_id]) for r in after)
        ids = [r.doc_id for r in after]
        if name == "quality_rules":
            assert set(ids) == {r.doc_id for r in quality.judge_quality(docs).filter("kept").collect()}
        elif name == "exact_dedup":
            groups = {}
            for r in before.values():
                groups.setdefault("".join(r.text.split()), []).append((-len(r.text), r.doc_id))
            assert sorted(ids) == sorted(min(g)[1] for g in groups.values())
        elif name == "near_dedup":
            found = components({d: r.text for d, r in before.items()}, 5, 80)
            assert sorted(ids) == sorted(d for d, (_, c) in found.items() if d == c)
        elif name == "mix_sources":
            copies = mixing.Mixture(mixing.sized_documents(docs)).copies().collect()
            assert sorted(ids) == sorted(r.doc_id for r in copies for _ in range(r.copies))
        else:
            assert len(ids) == docs.count() and set(ids) == set(before)
        assert after
        seen.append(len(after))
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == seen[-1]


def document(doc_id, text):
    return (doc_id, text, "en", "a", len(text), 7, 7, "x", "x", "x", 7, "x", "x")


def test_stages_decide_by_row(spark, odd):
    """Of repeated rows one stays; null ids are judged like others."""
    seen = [(r.doc_id, r.text) for r in odd.collect()]
    groups = {}
    for d, text in seen:
        groups.setdefault("".join((text or "").split()), []).append((-len(text or ""), d is None, d or 0, d, text))
    want = [min(g)[3:] for g in groups.values()]
    by_text = lambda rows: sorted((str(d), text or "") for d, text in rows)
    assert by_text((r.doc_id, r.text) for r in exact.drop_copies(odd).collect()) == by_text(want)

    more = [document(None, "hi"), document(None, "hi"), document(9, "Hi you there"), document(12, "hi")]
    rows = odd.unionByName(spark.createDataFrame(more, odd.schema))
    got = [(r.doc_id, r.text) for r in near.drop_near_copies(rows, words=5, threshold=80).collect()]
    assert sorted((d, text) for d, text in got if text and "i" in text.lower() and len(text) < 20) == [(9, "Hi"), (9, "Hi you there"), (10, "hi ☃ é")]
    assert sum(d is None for d, _ in got) == 1

    good = " ".join(f"word{i}" for i in range(60))
    texts = spark.createDataFrame([document(1, good), document(1, "bad"), document(None, good), document(None, "bad")], odd.schema)
    assert sorted(str(r.doc_id) for r in quality.keep_good(texts).collect()) == ["1", "None"]

    words = spark.createDataFrame([document(None, good), document(7, good), document(7, good), document(7, "x y")], odd.schema)
    mixed = mixing.mix_documents(words).collect()
    assert 1 <= sum(r.doc_id is None for r in mixed) <= 2
    assert sum(r.text == good for r in mixed) <= 6 and sum(r.text == "x y" for r in mixed) <= 2


def test_quality_cutoff_on_labels(spark):
    """Labelled debris is rejected, and few good documents beyond the base rules."""
    folder = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    rows = quality.judge_quality(docs).join(labels, "doc_id").select("quality", "base_failed", "kept").collect()
    bad = [r for r in rows if r.quality == 0]
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad) > 0
    assert sum(r.kept for r in good) >= 0.98 * len(good) > 0
