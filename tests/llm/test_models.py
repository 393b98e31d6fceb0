"""Language model, near copies, BPE and the pipeline."""

import base64
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from haltscope.llm import bpe, near, scoring


def tokens(text):
    return (text or "").encode().lower().split() + [scoring.END]


def test_scores(spark, odd):
    rng = random.Random(5)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), "x", 1) for i in range(400)] + [(7, "w1 w1", "x", 1), (0, "neverseen w1", "y", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, c int")
    counts = Counter(t for d, x, *_ in rows if zlib.crc32(str(d).encode()) % 10 for t in tokens(x))
    total, distinct = sum(counts.values()), len(counts)
    got = sorted(scoring.score_corpus(df).collect(), key=lambda r: (r.doc_id, r.n_tokens, r.base_score))
    want = sorted((d, len(t), sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in t), sum(x in counts for x in t))
                  for d, t in ((r[0], tokens(r[1])) for r in rows))
    for r, w in zip(got, want, strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (w[0], w[1], w[3], total)
        assert r.base_score == pytest.approx(w[2]) and r.score < 0 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) - 0.1 * sum(r.n_tokens for r in held)


def test_table_is_normalised_and_learns_order():
    """After class 2 always comes class 3, after 3 class 2."""
    counts = np.zeros((scoring.CLASSES,) * 3, np.int64)
    counts[2, 3, 2] = counts[3, 2, 3] = 50_000
    counts[2, 2, 4] = 1000
    table = scoring.LogBilinear(counts.ravel()).table.reshape((scoring.CLASSES,) * 3)
    assert np.allclose(np.exp(table).sum(axis=2), 1, atol=1e-3)
    assert table[2, 3, 2] > table[2, 3, 3] and table[3, 2, 3] > table[3, 2, 2]


def test_rare_words_have_classes_of_their_own(spark):
    """Words that occur once or never are told apart by what stands before them, and frequent ones leave no room out."""
    common = [f"c{k:03d}" for k in range(300)]
    rows = [(i, " ".join(w for k in range(20) for w in (rngs.choice(common), f"r{i}x{k}zz", f"r{i}x{k}qq"))) for i, rngs in
            ((i, random.Random(i)) for i in range(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = scoring.LanguageModel(docs.select("text"))
    assert model.vocabulary.mass.sum() == pytest.approx(sum(len(t.split()) + 1 for _, t in rows) + 0.1 * (8301 + scoring.CLASSES))
    probe = spark.createDataFrame([(1, "c001 newzz newqq"), (2, "c001 newqq newzz")], "doc_id long, text string")
    right, wrong = (r.score for r in scoring.score_texts(probe, model).orderBy("doc_id").collect())
    assert right > wrong + 1


@pytest.fixture(scope="module")
def two_tongues(spark):
    """Texts of one of two vocabularies, alike in endings and so in classes."""
    rng = random.Random(3)
    words = {side: [f"{side}{k}{end}" for k in range(100) for end in ("xx", "yy", "zz")] for side in "ab"}
    rows = [(i, " ".join(rng.choice(words["ab"[i % 2]]) for _ in range(40))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return docs, words, scoring.LanguageModel(docs.select("text"))


def test_words_are_told_apart_within_a_class(spark, two_tongues):
    """What stands before a word tells the words of one class apart, by vectors of their own."""
    _, words, model = two_tongues
    a, b = (words[side][::7] for side in "ab")
    swapped = [x if k % 2 else y for k, (x, y) in enumerate(zip(a, b, strict=True))]
    probe = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(swapped))], "doc_id long, text string")
    one, two, mixed = sorted(scoring.score_texts(probe, model).collect(), key=lambda r: r.doc_id)
    assert min(one.score, two.score) > mixed.score + 3
    assert min(one.score - one.base_score, two.score - two.base_score) > 3


def test_every_training_token_trains_its_word(two_tongues):
    """Each word with the least count or more has vectors, and all its occurrences took part; rarer ones are in the tails."""
    docs, words, model = two_tongues
    rows = model.words.collect()
    assert len(rows) == 601 and sum(r.c for r in rows) == 3000 * 41
    assert all(r.n == r.c and r.vectors for r in rows if r.c >= scoring.MIN_COUNT)
    rare = scoring.LanguageModel(docs.limit(40).select("text")).words.collect()
    assert any(r.c < scoring.MIN_COUNT for r in rare)
    assert all((r.n, r.vectors) == (None, None) if r.c < scoring.MIN_COUNT else r.n == r.c for r in rare)


def test_chances_of_all_words_sum_to_one(two_tongues):
    """After two words: all words of training, the end, and each class's place for words never seen."""
    _, _, model = two_tongues
    rows = sorted(model.words.collect(), key=lambda r: r.kind)
    assert rows[0].kind == 0 and rows[1].kind
    unseen = scoring.CLASSES - 1
    kinds = np.array([r.kind for r in rows] + list(range(1, scoring.CLASSES)), np.int16)
    counts = np.array([r.c for r in rows] + [0] * unseen)
    vectors = np.concatenate([scoring._rows_of(scoring.pa.array([bytes(r.vectors) for r in rows])), model.tails[1:]])
    rng = np.random.default_rng(1)
    for one, two in rng.integers(1, len(rows), (20, 2)):
        texts = [[one, two, w, 0] for w in range(1, len(kinds))] + [[one, two, 0]]
        chunk = scoring.Chunk(places=np.concatenate(texts).astype(np.int32), sizes=np.array([len(x) for x in texts], np.int32), kinds=kinds)
        logs = scoring.token_scores(chunk, counts, vectors, (model.classes.table / np.log(10)).ravel(), model.vocabulary.mass, model.normaliser)
        assert (10.0 ** logs[np.cumsum(chunk.sizes) - chunk.sizes + 2]).sum() == pytest.approx(1, abs=0.03)


def test_vectors_survive_their_bytes():
    rows = np.random.default_rng(2).normal(0, 1, (50, 2 * scoring.WIDTH)).astype(np.float32)
    rows[7] = 0
    again = scoring._rows_of(scoring._column_of(rows))
    assert np.abs(again - rows).max() <= np.abs(rows).max() / 200 and not again[7].any()
    assert scoring._rows_of(scoring._column_of(rows[:0])).shape == (0, 2 * scoring.WIDTH)


def test_score_odd_rows(odd, nothing):
    rows = scoring.score_corpus(odd).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert scoring.score_corpus(nothing).count() == 0


def components(texts, size, threshold):
    sets = {}
    for d, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[d] = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("size,threshold,options", [(3, 85, {}), (5, 80, {"bands": 30, "rows": 5})])
def test_near_copies(spark, size, threshold, options):
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    texts, base = {}, fresh(300)
    for d in range(60):  # a family around one text, larger than any small bucket
        w = base[:]
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 5000)}"
        texts[200 + d] = " ".join(w)
    chain = fresh(200)
    for d in range(12):  # each a link from the one before
        chain[d * 15] = f"c{d}"
        texts[100 + d] = " ".join(chain)
    passage = fresh(120)
    for d in range(20):  # half of the text is common
        texts[300 + d] = " ".join(passage + fresh(120))
    for d in range(20):
        texts[d] = " ".join(fresh(50))
    texts |= {50: None, 51: "", 52: " \n", 53: "Two words", 54: "two WORDS", 55: "words two", 56: texts[3].upper(), 57: texts[3]}
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in texts.items()], "doc_id long, text string, node string, key int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_copies(df, words=size, threshold=threshold, **options).collect()}
    assert got == components(texts, size, threshold)


def test_near_form_letters(spark):
    """Letters that share most buckets, large ones, with letters of many other components."""
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randint(0, 50000)}" for _ in range(n)]
    fixed, choices = [fresh(20) for _ in range(10)], [[fresh(6) for _ in range(3)] for _ in range(10)]
    texts = {d: " ".join(sum((f + rng.choice(c) for f, c in zip(fixed, choices, strict=True)), [])) for d in range(400)}
    want = components(texts, 3, 85)
    assert 50 < len({c for _, c in want.values()}) < 350
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near.near_copies(df).collect()}
    assert got == want


def test_near_texts_of_other_rows_are_not_shuffled(spark):
    """The second reading meets the rows it is for and few others, whatever their ids."""
    texts = [(k if k % 3 else None, f"text {k} " + "word " * (k % 50)) for k in range(4000)]
    rows = spark.createDataFrame(texts, "doc_id long, text string").withColumn("mark", F.xxhash64("text"))
    nodes = rows.filter("text rlike '^text [0-9]+7 '")
    found = near._maybe_wanted(rows, nodes)
    assert found.columns == rows.columns
    assert nodes.exceptAll(found).isEmpty() and found.exceptAll(rows).isEmpty()
    assert found.count() < 400 + 0.15 * 3600


def test_near_odd_rows(odd, nothing):
    rows = near.near_copies(odd).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id: r.component_id for r in rows if r.doc_id in (1, 2, 3, 11, 4, 5, 6)} == {1: 1, 2: 1, 3: 1, 11: 1, 4: 4, 5: 5, 6: 6}
    assert near.near_copies(nothing).count() == 0


def test_estimate_is_corrected(spark):
    """Signatures of sets with known similarity."""
    sketcher = near.Sketcher(26, 6)
    rows = []
    for k in range(40):
        rng = np.random.default_rng(k)
        pool = np.unique(rng.integers(0, 1 << 63, 1500, np.uint64))[:1200]
        a, b = pool[:1000], pool[200:]
        rows.append([[int(x) for x in sketcher.signature(sketcher.minima(s))] for s in (a, b)])
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    found = [r[0] for r in df.select(near.similarity(df["a"], df["b"], 156)).collect()]
    assert abs(np.mean(found) - 800 / 1200) < 0.03 and np.std(found) < 0.08


TEXTS = ["", " ", "  a", "a  b ", "\n\n x\ty ", "don't  stop", "a\x1cb \x1c c", "-" * 500, "é" * 300 + " " * 50, "你好 世界 テスト", "<|endoftext|> a", "\r\n \r\n",
         "1234 567", "a\u00a0b", "3.14, x.y a, b. c", "a.\nB", "a ,b", "a..b", "_. a_, b", "a\u0301, b", "word " * 20_000, "abcdefghij" * 30]


def test_codec_equals_library():
    tiktoken = pytest.importorskip("tiktoken")
    codec = bpe.Codec(data := bpe.read_ranks())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    library = tiktoken.Encoding("own", pat_str=bpe.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice(" abcdeé.,\n'st1☃-") for _ in range(rng.randint(1, 80))) for _ in range(500)]
    for text, (ids, data) in zip(texts, codec.round_trip(texts), strict=True):
        assert ids == " ".join(map(str, library.encode_ordinary(text))) and data == text.encode(), repr(text[:80])
    with pytest.raises(ValueError):
        codec.joined(bpe.pa.array([[1, 60_000]], bpe.pa.list_(bpe.pa.int32())))


def test_encode_and_decode(spark, odd, nothing):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    back = bpe.decode_documents(bpe.encode_documents(df)).collect()
    assert {r.doc_id: bytes(r.data).decode() for r in back} == dict(enumerate(TEXTS))
    rows = bpe.encoding_report(odd).collect()
    assert len(rows) == odd.count() and {r.n_tokens for r in rows if r.doc_id in (4, 5)} == {0}
    assert bpe.encoding_report(nothing).count() == 0


def test_near_copies_without_ids(spark):
    words = [f"w{i}" for i in range(200)]
    family = [" ".join(words[:k] + [f"x{k}"] + words[k + 1:]) for k in (20, 90, 150)]
    rows = [(None, family[0]), (None, family[1]), (5, family[2]), (None, family[0]), (7, "a b c d"), (None, "e f g h"), (None, "e f g h")]
    got = near.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == sorted([(0, 5, False)] * 3 + [(5, 5, True), (7, 7, True), (0, 0, True), (0, 0, True)])


def test_codec_remembers_a_bounded_size(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 100_000)
    monkeypatch.setattr(bpe, "TEXTS", 1000)
    codec = bpe.Codec(bpe.read_ranks())
    texts = [" ".join(f"word{i}x{k}" for k in range(100)) for i in range(60)]
    for text, (ids, data) in zip(texts, codec.round_trip(texts), strict=True):
        assert data == text.encode()
        assert codec.size <= 100_000 + 200 * 300
        own = sum(len(k) + len(v) + bpe.ENTRY for part in (codec.written, codec.before) for k, v in part.items())
        assert own <= 2 * (100_000 + 200 * 300)
