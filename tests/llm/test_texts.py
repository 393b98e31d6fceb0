"""Quality rules, URL filter, licenses, toxicity: brute force, fixtures, held-out accuracy."""

import os
import random
import re
import zlib

import numpy as np
import pytest

from haltscope.llm import licenses, quality, toxicity, urls

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(windows) < 3000 else set()
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


@pytest.mark.parametrize("text", ["", None, "a b c a b c d", "a a a a", "x\nx\n \ny\rx\nx", "é☃ #*$%&|<> A1!", "a b", "one two three\n" * 5])
def test_counts(text):
    assert quality.text_counts((text or "").encode())[:5] == plain_counts(text)


def good_text(rng):
    words = ["".join(rng.choices("abcdefghilmnorstu", k=rng.randint(2, 8))) for _ in range(rng.randint(60, 300))]
    return " ".join(w.capitalize() + "." if rng.random() < 0.1 else w for w in words)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = [(i, good_text(rng), "en" if i % 3 else None, "s0") for i in range(700)]
    rows += [(1000 + i, good_text(rng).replace(" ", "### "), "en", "s0") for i in range(10)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_quality_is_mcd(corpus):
    """The same concentration steps in numpy, with exact medians and quantiles."""
    got = {r.doc_id: r for r in quality.judge_quality(corpus).collect()}
    rows = [(r.doc_id, r.lang, quality.text_counts(r.text.encode())) for r in corpus.collect()]
    x = {}
    for d, lang, c in rows:
        share = lambda n, of: np.arcsin(np.sqrt(min(1.0, n / max(of, 1))))
        x[d] = [np.log(max(c[1], 1) / max(c[0], 1)), share(c[2], c[1]), share(c[5], c[1]), share(c[6], c[1]), share(c[7], c[1]), share(c[3], c[8]), share(c[4], c[0])]
    ok = {d for d, _, c in rows if c[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    for lang in ("en", None):
        ids = [d for d, own, _ in rows if own == lang and d in ok]
        v = np.array([x[d] for d in ids])
        low = lambda a, q, axis=None: np.quantile(a, q, axis=axis, method="inverted_cdf")
        floor, found = np.diag(np.square(quality.FLOOR)), []
        mid = low(v, 0.5, 0)
        starts = [(mid, np.diag((low(abs(v - mid), 0.5, 0) * 1.4826) ** 2)), (v.mean(0), np.cov(v.T, bias=True))]
        for mean, cov in starts:
            for _ in range(quality.STEPS):
                off = v - mean
                d2 = np.einsum("ni,ij,nj->n", off, np.linalg.inv(cov + floor), off)
                own = v[d2 <= low(d2, quality.SUBSET)]
                mean, cov = own.mean(0), np.cov(own.T, bias=True)
            found.append((np.linalg.slogdet(cov + floor)[1], mean, np.linalg.inv(cov + floor)))
        _, mean, inverse = min(found, key=lambda f: f[0])
        d2 = np.einsum("ni,ij,nj->n", v - mean, inverse, v - mean)
        d2 /= max(1.0, low(d2, 0.5) / quality.CHI2_MEDIAN)
        assert [got[d].distance for d in ids] == pytest.approx(list(d2), rel=1e-6)
    assert all(got[d].kept == (d in ok and got[d].distance <= quality.CUTOFF) for d in got)
    assert not any(got[d].kept for d in range(1000, 1010)) and sum(got[d].kept for d in range(700)) >= 690


def test_quality_odd_rows(odd, nothing):
    got = quality.judge_quality(odd).collect()
    assert len(got) == odd.count() and all(r.base_failed and not r.kept for r in got)
    assert quality.judge_quality(nothing).count() == 0
    assert quality.keep_good(nothing).columns == nothing.columns


def test_urls(spark):
    cases = {
        "http://Example.NET/en/x?y": ("example.net", "/en/x", "example.net/en/", "allow"), "https://a.example.net/de": ("a.example.net", "/de", "net/", "block"),
        "http://b.example.com/de/": ("b.example.com", "/de/", "example.com/de/", "block"), "http://b.example.com/de": ("b.example.com", "/de", None, "allow"),
        "x://w.org/fr/#a": ("w.org", "/fr/", "org/fr/", "allow"), "x://worg/fr/": ("worg", "/fr/", None, "allow"), "http://net": ("net", "", None, "allow"),
        "http://net/": ("net", "/", "net/", "block"), "nourl": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "http://x.adult-x.example.com/q": ("x.adult-x.example.com", "/q", None, "block"), "http://ÄB.net?x": ("Äb.net", "", None, "allow"),
        "http://h/" + "a/" * 50_000: ("h", "/" + "a/" * 50_000, None, "allow"), "a://b://c.net/": ("b:", "//c.net/", None, "allow"),
    }
    rows = [(k, u, "key") for k, u in enumerate(cases)] + [(0, next(iter(cases)), None)]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == list(cases.values())[r.page_id]
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_colliding_digests(tmp_path):
    """With three digests for all strings, every answer is still that of a plain search."""
    rng = random.Random(1)
    rules = [(f"h{rng.randint(0, 30)}.x", rng.choice(["", "/", "/a/"]), rng.choice(["block", "allow"])) for _ in range(60)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    few = lambda b: len(b) % 3
    (tmp_path / "i").write_bytes(urls.build_index(rules, few))
    index = urls.DigestIndex(str(tmp_path / "i"), few)
    asked = [(f"{rng.choice(['', 'a.'])}h{rng.randint(0, 40)}.x", rng.choice(["", "/", "/a/b", "/b"])) for _ in range(300)]
    for (host, path), got in zip(asked, index.find(asked), strict=True):
        fit = [(h + p, v == "block") for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got == max(fit, key=lambda f: len(f[0]), default=None)


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark, odd, nothing):
    texts = ["Under the MIT  License!", "cc-by-nc cc by nc cc by nc 4.0", "Apache License, Version 2.0 (under the mit license)", "", None, "é cc by ncé",
             "x\n# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0-only WITH x-exception */\nend", "SPDX-License-Identifier: (MIT OR\n", "cc by nc " * 20_000]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_scan(t), t
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert got[6].labels == "apache-2,gpl-3,mit" and got[6].score == 0.4 and got[7].labels == ""
    assert licenses.scan_licenses(odd).count() == odd.count() and licenses.scan_licenses(nothing).count() == 0


@pytest.mark.parametrize("text,labels,score", [
    ("MIT", {"mit"}, 1.0), ("mit OR gpl-3.0", {"mit", "gpl-3"}, 1.0), ("MIT or GPL-2.0 and CC-BY-NC-4.0", {"mit", "gpl-2", "cc-by-nc"}, 1.0),
    ("(MIT or GPL-2.0) and CC-BY-NC-4.0", {"mit", "gpl-2", "cc-by-nc"}, 0.2), ("GPL-2.0 with Classpath-exception", {"gpl-2"}, 0.4), ("foo-1", {"foo-1"}, 0.5)])
def test_expressions(text, labels, score):
    assert licenses.evaluate(text) == (labels, score)


@pytest.mark.parametrize("text", ["", "or", "MIT or", "(MIT", "and MIT", "()"])
def test_broken_expressions(text):
    assert licenses.evaluate(text) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    clean, toxic = [r for r in rows if r.toxic == 0], [r for r in rows if r.toxic == 1]
    better = np.mean([[a.score > b.score for b in clean] for a in toxic])
    assert better > 0.85 and np.mean([r.predicted for r in clean]) < 0.05 and np.mean([r.predicted for r in toxic]) > 0.6
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in rows)


def test_toxicity_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 0, None), (None, 0, 1), (99, 0, 1), (7, 0, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        model = toxicity.train_toxicity(odd, known)
        rows = toxicity.score_toxicity(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(nothing, model).count() == 0


def test_license_places_in_a_text_full_of_them():
    n = 200_000  # hours if every hit looked at the text from its start
    found = licenses.scan_text(b"x cc by nc " * n)
    assert (found["n_base"], found["first_word"], found["last_word"]) == (n, 1, 4 * n - 3)
