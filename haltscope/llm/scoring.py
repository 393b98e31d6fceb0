"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation.

Every word that training saw ``MIN_COUNT`` times or more has vectors of its own, one as
context and one as target, however many such words there are; the rarer words of a class
share those of its tail. A word's class follows from its ending (the last two bytes,
hashed), so a word never seen has one too; the end of a text is a class of its own.

The exponent of a word is bilinear in two parts. The first one scores its class after the
two classes before: class vectors, scaled by position, added and multiplied with those of
all classes. They are trained on the table of runs of three classes (a cell per run, so
bounded whatever the corpus). The second one does the same with the words' own vectors and
is trained on every token of every training text, once. Within its class a word has its
share of the smoothed counts.

    p(w | h) = p(class | classes of h) * share of w in its class * exp(u(h) . v(w)) / Z(h)

Texts are coded once into chunks: a list of distinct words and each token's place in it. A
chunk gets counts and vectors of its own words by joins, so no task holds the vocabulary.
Chunks train apart, all from the vectors of the classes; a word's vectors are the means over
its chunks, weighted by its tokens there.

Z(h) is a sum over all words. Words with close target vectors are gathered in ``CLUSTERS``
(masses per class, means and spreads, over all words), and the sum over a cluster is that of
a normal distribution: exact for words at the mean, else to the second order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from haltscope.llm.common import dropped, give_back, stored, tidy

CLASSES = 128
#: Frequent words that the first guess of the clusters is made from.
HEAD = 1 << 14
DIMENSIONS = 16
NOISE = 10
STEPS, BATCH, RATE = 1000, 4096, 0.05
ALPHA = 0.1
#: Words' own vectors: least count, length; tokens a chunk and a step; tokens that share noise words, and how many.
MIN_COUNT, WIDTH, OWN_START = 5, 8, 0.3
CHUNK, TOKENS = 3 << 20, 8192
SHARING, WORD_NOISE, WORD_RATE = 64, 16, 0.2
CLUSTERS = 64
#: Stands for the end of a text: no word holds a blank.
END = b" "


def is_held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


#: The keys of the tails of the classes among those of the words.
TAILS = np.array([_hash(END + bytes([k])) for k in range(CLASSES)], np.uint64).view(np.int64)


def _kind(word: bytes) -> int:
    """The class of a word: 0 for the end of a text, else one of the others by its last two bytes."""
    return 0 if word == END else 1 + _hash(word[-2:]) % (CLASSES - 1)


def _packed(values: np.ndarray) -> bytes:
    """An array as compressed bytes, all first bytes in front, then all second ones, and so on."""
    flat = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()
    return len(flat).to_bytes(8, "little") + pa.compress(flat, codec="zstd", asbytes=True)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    size, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(data[8:], size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(width, -1).T).reshape(-1).view(kind)


class Chunk:
    """Some texts: their distinct words (the end first) with hashes and classes, tokens as places among them, tokens of each text."""

    ARRAYS = {"words": np.int64, "kinds": np.int16, "places": np.int32, "sizes": np.int32, "learn": np.bool_}

    def __init__(self, **arrays):
        self.__dict__.update(arrays)

    @classmethod
    def of(cls, texts: list, learn: list) -> Chunk:
        codes: dict[bytes, int] = {END: 0}
        places, sizes = [], []
        for text in texts:
            words = (text or b"").lower().split()
            places += [codes.setdefault(w, len(codes)) for w in words]
            places.append(0)
            sizes.append(len(words) + 1)
        endings = {w[-2:] for w in codes}
        kinds = dict(zip(endings, map(_kind, endings), strict=True))
        return cls(words=np.fromiter(map(_hash, codes), np.uint64, len(codes)).view(np.int64),
                   kinds=np.fromiter((kinds[w[-2:]] for w in codes), np.int16, len(codes)),
                   places=np.array(places, np.int32), sizes=np.array(sizes, np.int32), learn=np.array(learn, np.bool_))

    @classmethod
    def read(cls, row: dict) -> Chunk:
        return cls(**{name: _unpacked(row[name], kind) for name, kind in cls.ARRAYS.items() if name in row})

    def learnt(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and sizes of the training texts."""
        return self.places[np.repeat(self.learn, self.sizes)], self.sizes[self.learn]


def coded(docs: DataFrame) -> DataFrame:
    """(chunk, doc_ids, arrays of ``Chunk``) of texts (doc_id, text, learn), stored."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        task, number = TaskContext.get().partitionId() << 32, 0
        ids, texts, learn, size = [], [], [], 0

        def row():
            packed = {name: [_packed(getattr(made, name))] for name in Chunk.ARRAYS} if (made := Chunk.of(texts, learn)) else {}
            columns = {"chunk": pa.array([task + number]), "doc_ids": pa.array([ids], pa.list_(batch.schema.field("doc_id").type))}
            columns |= {name: pa.array(value, pa.binary()) for name, value in packed.items()}
            return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        for batch in batches:
            columns = (batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("learn").to_pylist())
            for doc_id, text, flag in zip(*columns, strict=True):
                ids.append(doc_id)
                texts.append(text)
                learn.append(flag)
                size += len(text or b"") // 6 + 1  # about a token
                if size >= CHUNK:
                    yield row()
                    number, ids, texts, learn, size = number + 1, [], [], [], 0
        if texts:
            yield row()
        give_back()

    arrays = ", ".join(f"{name} binary" for name in Chunk.ARRAYS)
    return stored(docs.select("doc_id", "text", "learn").mapInArrow(run, f"chunk long, doc_ids array<{kind}>, {arrays}"), "lm-chunks")


def _chunks(batches) -> Iterator[tuple[int, Chunk]]:
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            yield row.get("chunk"), Chunk.read(row)


def words_of(chunks: DataFrame) -> DataFrame:
    """(chunk, place, word, kind, n): the distinct words of each chunk, how often its training texts have them."""

    def run(batches):
        for chunk, t in _chunks(batches):
            n = len(t.words)
            counts = np.bincount(t.learnt()[0], minlength=n)
            columns = {"chunk": np.full(n, chunk, np.int64), "place": np.arange(n, dtype=np.int32), "word": t.words, "kind": t.kinds, "n": counts}
            for a in range(0, n, 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[a:a + (1 << 16)]) for c in columns.values()], list(columns))
        give_back()

    return chunks.select("chunk", "words", "kinds", "places", "sizes", "learn").mapInArrow(run, "chunk long, place int, word long, kind short, n long")


def count_words(chunks: DataFrame) -> DataFrame:
    """(word, kind, c): class and count of each token that occurs in training; words by their 64-bit hash."""
    found = words_of(chunks).filter("n > 0").groupBy("word")
    return found.agg(F.max("kind").alias("kind"), F.sum("n").alias("c"))


class Vocabulary:
    """The smoothed mass of each class over all its words: those that occur and one place for those that do not."""

    def __init__(self, classes: list):
        self.total, self.distinct = sum(r["c"] for r in classes), sum(r["n"] for r in classes)
        self.mass = np.full(CLASSES, ALPHA)
        for r in classes:
            self.mass[r["kind"]] += r["c"] + ALPHA * r["n"]


def _runs(kinds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each token: its class and the two before it in its text (the end where there is none), as one number."""
    first = np.cumsum(sizes) - sizes
    one, two = np.zeros_like(kinds), np.zeros_like(kinds)
    one[1:], two[2:] = kinds[:-1], kinds[:-2]
    one[first] = 0
    two[first] = 0
    after = first + 1
    two[after[after < len(kinds)]] = 0
    return (two.astype(np.int64) * CLASSES + one) * CLASSES + kinds


def count_runs(chunks: DataFrame) -> np.ndarray:
    """How often each run of three classes occurs in all training texts: at most CLASSES**3 cells."""

    def run(batches):
        total = np.zeros(CLASSES ** 3, np.int64)
        for _, t in _chunks(batches):
            places, sizes = t.learnt()
            total += np.bincount(_runs(t.kinds[places], sizes), minlength=CLASSES ** 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "c"])

    out = np.zeros(CLASSES ** 3, np.int64)
    # Sixteen rows of packed counts; their size is fixed by CLASSES.
    sums = chunks.select("kinds", "places", "sizes", "learn").mapInArrow(run, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c"))
    packed = sums.groupBy(F.pmod("cell", F.lit(16)).alias("part")).agg(F.sort_array(F.collect_list(F.struct("cell", "c"))).alias("all"))
    for row in packed.select(F.transform("all", lambda x: x["cell"]).alias("cell"), F.transform("all", lambda x: x["c"]).alias("c")).toLocalIterator():
        out[np.array(row["cell"], np.int64)] = row["c"]
    return out


class LogBilinear:
    """log p(class | two classes before), for all contexts."""

    def __init__(self, counts: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        k, d = CLASSES, DIMENSIONS
        n = counts.sum()
        seen = counts.reshape(-1, k).sum(axis=0) + 1.0
        noise = seen / seen.sum()
        log_noise = np.log(noise).astype(np.float32)
        self.context = rng.normal(0, 0.1, (k, d)).astype(np.float32)
        self.target = rng.normal(0, 0.1, (k, d)).astype(np.float32)
        self.scale = np.ones((2, d), np.float32)
        self.bias = log_noise.copy()
        if n:
            self._train(counts, noise, log_noise, rng)
        # All contexts at once: class vectors scaled by place, added, times all classes.
        far, near = self.context * self.scale[0], self.context * self.scale[1]
        score = (far[:, None, :] + near[None, :, :]).reshape(-1, d) @ self.target.T + self.bias
        score -= score.max(axis=1, keepdims=True)
        self.table = score - np.log(np.exp(score).sum(axis=1, keepdims=True))
        self.share = (seen / seen.sum()).astype(np.float32)

    def _train(self, counts, noise, log_noise, rng):
        """Tell runs of the corpus from runs with a noise class, by Adagrad steps."""
        ends = np.cumsum(counts)
        params = [self.context, self.target, self.scale, self.bias]
        squares = [np.full_like(p, 1e-3) for p in params]
        noise_ends = np.cumsum(noise)
        shift = np.log(NOISE)
        # Two draws for each run that occurs, at least: the table is bounded, so are they.
        for _ in range(max(STEPS, 2 * np.count_nonzero(counts) // BATCH)):
            cell = np.searchsorted(ends, rng.integers(0, ends[-1], BATCH), side="right")
            two, one, own = cell // CLASSES ** 2, cell // CLASSES % CLASSES, cell % CLASSES
            other = np.minimum(np.searchsorted(noise_ends, rng.random((BATCH, NOISE)), side="right"), CLASSES - 1)
            classes = np.concatenate([own[:, None], other], axis=1)
            c2, c1 = self.context[two], self.context[one]
            made = c2 * self.scale[0] + c1 * self.scale[1]
            rows = self.target[classes]
            margin = np.einsum("bd,bkd->bk", made, rows) + self.bias[classes] - log_noise[classes] - shift
            off = 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))
            off[:, 0] -= 1.0
            off = (off / BATCH).astype(np.float32)
            back = np.einsum("bk,bkd->bd", off, rows)
            grads = [np.zeros_like(p) for p in params]
            np.add.at(grads[0], two, back * self.scale[0])
            np.add.at(grads[0], one, back * self.scale[1])
            weights = np.zeros((CLASSES, BATCH), np.float32)
            np.add.at(weights, (classes.T, np.arange(BATCH)), off.T)
            grads[1] += weights @ made
            grads[2] += np.stack([(back * c2).sum(0), (back * c1).sum(0)])
            grads[3] += weights.sum(axis=1)
            for p, g, s in zip(params, grads, squares, strict=True):
                s += g * g * BATCH
                p -= RATE * g * np.sqrt(BATCH) / np.sqrt(s)


class ClassPart:
    """What the class model says of a class after two others, against its share: a product of two short vectors."""

    def __init__(self, model: LogBilinear):
        far, near = model.context * model.scale[0], model.context * model.scale[1]
        made = (far[:, None, :] + near[None, :, :]).reshape(-1, DIMENSIONS)
        gain = model.table - np.log(model.share)
        # The table is made @ target + bias, less a constant per context; that constant follows from any class.
        rest = gain[:, :1] - made @ model.target[:1].T
        bias = gain[0] - made[0] @ model.target.T - rest[0]
        self.left = np.concatenate([made, np.ones_like(rest), rest], axis=1).astype(np.float32)
        self.right = np.concatenate([model.target, bias[:, None], np.ones((CLASSES, 1))], axis=1).astype(np.float32)
        # The main directions of the classes as contexts.
        both = model.context * model.scale.mean(axis=0)
        both = both - model.share @ both
        self.start = (both @ np.linalg.svd(np.sqrt(model.share)[:, None] * both, full_matrices=False)[2][:WIDTH].T).astype(np.float32)


def _of_hash(words: np.ndarray) -> np.ndarray:
    """Vectors between -1 and 1 from the eight bytes of the hashes."""
    return (np.ascontiguousarray(words).view(np.uint8).reshape(-1, WIDTH) / np.float32(127.5) - 1).astype(np.float32)


def _before(sizes: np.ndarray) -> np.ndarray:
    """For each token: how many stand before it in its text, two at most."""
    before = np.full(int(sizes.sum()), 2, np.int8)
    first = np.cumsum(sizes) - sizes
    before[(first + 1)[sizes > 1]] = 1
    before[first] = 0
    return before


def _contexts(vectors: np.ndarray, tokens: np.ndarray, before: np.ndarray, a: int, b: int, end: int) -> np.ndarray:
    """The sum of the two context vectors before each token; the end stands where there is none."""
    got = vectors.take(tokens[max(a - 2, 0):b - 1], axis=0)
    if a < 2:
        got = np.concatenate([np.repeat(vectors[end:end + 1], 2 - a, axis=0), got])
    one, two, here = got[1:], got[:-1], before[a:b]
    if (here < 2).any():
        one, two = np.where((here > 0)[:, None], one, vectors[end]), np.where((here > 1)[:, None], two, vectors[end])
    return one + two


def train_words(tokens: np.ndarray, sizes: np.ndarray, words: np.ndarray, kinds: np.ndarray, end: int, part: ClassPart) -> np.ndarray:
    """Vectors (context, target) of the words of a chunk from all its tokens, by noise-contrastive estimation.

    ``words`` and ``kinds`` are the words' hashes and classes. A word starts as a context with
    that of its class and a small part of its own, taken from its hash, so it is the same in
    all chunks. Noise words are drawn like tokens; so a word's own share cancels out, and what
    is told apart is the exponent. Adagrad, a rate per vector.
    """
    rng = np.random.default_rng(7)
    context, target = part.start[kinds] + OWN_START * _of_hash(words), np.zeros((len(kinds), WIDTH), np.float32)
    squares = np.full((2, len(kinds)), 1e-3, np.float32)
    right, before = part.right[kinds], _before(sizes)
    runs = _runs(kinds[tokens], sizes) // CLASSES
    shift = np.float32(np.log(WORD_NOISE))
    step = min(TOKENS, max(2 * SHARING, len(tokens) // 128))
    for a in range(0, len(tokens), step):
        b = min(len(tokens), a + step)
        n, own, here = b - a, tokens[a:b], before[a:b]
        groups = -(-n // SHARING)
        full = groups * SHARING
        # Scores of the tokens and of the noise words, which SHARING tokens have in common.
        u = np.zeros((full, WIDTH + right.shape[1]), np.float32)
        u[:n, :WIDTH] = _contexts(context, tokens, before, a, b, end)
        u[:n, WIDTH:] = part.left.take(runs[a:b], axis=0)
        noise = tokens[rng.integers(0, len(tokens), groups * WORD_NOISE)]
        v, other = target.take(own, axis=0), target.take(noise, axis=0)
        of_own = np.concatenate([v, right.take(own, axis=0)], axis=1)
        of_noise = np.concatenate([other, right.take(noise, axis=0)], axis=1).reshape(groups, WORD_NOISE, -1)
        good = np.einsum("ij,ij->i", u[:n], of_own) - shift
        bad = np.matmul(u.reshape(groups, SHARING, -1), of_noise.transpose(0, 2, 1)) - shift
        good = -1 / (1 + np.exp(np.minimum(good, 30)))
        bad = 1 / (1 + np.exp(np.minimum(-bad, 30)))
        bad.reshape(full, WORD_NOISE)[n:] = 0
        # Gradients: of the contexts, at the tokens one and two places before, and of the targets.
        to_context = np.matmul(bad, other.reshape(groups, WORD_NOISE, -1)).reshape(full, WIDTH)[:n]
        to_context += good[:, None] * v
        sums = np.zeros((n + len(noise), 2 * WIDTH), np.float32)
        one, two = np.where((here > 0)[:, None], to_context, 0), np.where((here > 1)[:, None], to_context, 0)
        sums[:n - 1, :WIDTH] += one[1:]
        sums[:n - 2, :WIDTH] += two[2:]
        made = u[:, :WIDTH]
        sums[:n, WIDTH:] = good[:, None] * made[:n]
        sums[n:, WIDTH:] = np.matmul(bad.transpose(0, 2, 1), made.reshape(groups, SHARING, -1)).reshape(-1, WIDTH)
        # Added up by word.
        touched = np.concatenate([own, noise])
        order = np.argsort(touched)
        touched = touched.take(order)
        cut = np.flatnonzero(np.concatenate([[True], touched[1:] != touched[:-1]]))
        touched, sums = touched.take(cut), np.add.reduceat(sums.take(order, axis=0), cut, axis=0)
        for vectors, square, slope in ((context, squares[0], sums[:, :WIDTH]), (target, squares[1], sums[:, WIDTH:])):
            square[touched] += np.einsum("ij,ij->i", slope, slope)
            vectors[touched] -= WORD_RATE * slope / np.sqrt(square.take(touched))[:, None]
    return np.concatenate([context, target], axis=1)


def _rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors (context, target) from a column of bytes without nulls."""
    rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * WIDTH + 4)
    scales = np.ascontiguousarray(rows[:, 2 * WIDTH:]).view(np.float16).astype(np.float32)
    return rows[:, :2 * WIDTH].view(np.int8).astype(np.float32) * np.repeat(scales, WIDTH, axis=1)


def _column_of(vectors: np.ndarray) -> pa.Array:
    """Vectors as bytes: 255 steps of a scale for the context and one for the target."""
    scales = (np.abs(vectors).reshape(len(vectors), 2, WIDTH).max(axis=2, initial=0) / 127).astype(np.float16)
    steps = vectors / np.maximum(np.repeat(scales.astype(np.float32), WIDTH, axis=1), 1e-7)
    rows = np.concatenate([np.clip(np.rint(steps), -127, 127).astype(np.int8).view(np.uint8), scales.view(np.uint8)], axis=1)
    return pa.Array.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def train_chunks(chunks: DataFrame, counts: DataFrame, part: ClassPart) -> DataFrame:
    """(word, n, vectors) of each chunk: its words with MIN_COUNT in all training texts, and the tails of its classes."""
    sent = chunks.sparkSession.sparkContext.broadcast(part)
    frequent = counts.filter(F.col("c") >= MIN_COUNT).select("word")
    owned = words_of(chunks).filter("n > 0").select("chunk", "place", "word").join(frequent, "word")

    def run(left, right):
        out = {"word": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "vectors": pa.array([], pa.binary())}
        if left.num_rows:
            t = Chunk.read(left.to_pylist()[0])
            places, sizes = t.learnt()
            own = np.asarray(right.column("place"))
            unit = len(own) + t.kinds.astype(np.int64)
            unit[own] = np.arange(len(own))
            tokens = unit[places]
            if len(tokens):
                kinds = np.concatenate([t.kinds[own], np.arange(CLASSES, dtype=np.int16)])
                words = np.concatenate([np.asarray(right.column("word")), TAILS])
                vectors = train_words(tokens, sizes, words, kinds, int(unit[0]), sent.value)
                n = np.bincount(tokens, minlength=len(kinds))
                seen = np.flatnonzero(n)
                out = {"word": pa.array(words[seen]), "n": pa.array(n[seen]), "vectors": _column_of(vectors[seen])}
        give_back()
        return pa.table(out)

    texts = chunks.select("chunk", "kinds", "places", "sizes", "learn")
    return texts.groupBy("chunk").cogroup(owned.groupBy("chunk")).applyInArrow(run, "word long, n long, vectors binary")


def mean_vectors(trained: DataFrame) -> DataFrame:
    """(word, n, vectors): tokens of a word in all chunks and the mean of its vectors, weighted by them."""

    def run(batches):
        def means(words, n, vectors):
            cut = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            total = np.add.reduceat(n, cut)
            return words[cut], total, np.add.reduceat(vectors * n[:, None], cut, axis=0) / total[:, None], cut[-1]

        kept = None  # the last word of a batch may go on in the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.asarray(batch.column("word")), np.asarray(batch.column("n")), _rows_of(batch.column("vectors"))]
            if kept:
                now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
            words, total, vectors, last = means(*now)
            kept = [words[-1:], total[-1:], vectors[-1:]]
            yield pa.RecordBatch.from_arrays([pa.array(words[:-1]), pa.array(total[:-1]), _column_of(vectors[:-1])], ["word", "n", "vectors"])
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(kept[1]), _column_of(kept[2])], ["word", "n", "vectors"])

    return trained.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word long, n long, vectors binary")


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(vectors[a:a + 8192] @ centres.T - half, axis=1) for a in range(0, len(vectors), 8192)] or [np.zeros(0, np.int64)])


class Normaliser:
    """Z(h): the sum of exp(u . v) over all words, by clusters of their target vectors."""

    def __init__(self, words: DataFrame, vocabulary: Vocabulary, classes: LogBilinear, tails: np.ndarray):
        head = words.filter("vectors is not null").orderBy(F.desc("c"), "word").limit(HEAD).select("c", "vectors").collect()
        centres = tails[:CLUSTERS, WIDTH:]
        if head:
            points, weights = _rows_of(pa.array([bytes(r["vectors"]) for r in head]))[:, WIDTH:], np.array([r["c"] for r in head], float)
            rng = np.random.default_rng(7)
            centres = points[rng.choice(len(points), CLUSTERS, p=weights / weights.sum())] + rng.normal(0, 1e-3, (CLUSTERS, WIDTH)).astype(np.float32)
            for _ in range(4):
                at = _nearest(points, centres)
                total = np.bincount(at, weights, CLUSTERS)
                sums = np.stack([np.bincount(at, weights * x, CLUSTERS) for x in points.T], axis=1)
                centres = np.where(total[:, None] > 0, sums / np.maximum(total, 1)[:, None], centres).astype(np.float32)
        cells = CLASSES * CLUSTERS
        names = ["mass", *(f"s{d}" for d in range(WIDTH)), *(f"q{d}" for d in range(WIDTH))]

        def sums_of(kinds, mass, targets):
            """Per class and cluster: mass, and the sums of vectors and their squares, weighted by it."""
            at = kinds.astype(np.int64) * CLUSTERS + _nearest(targets, centres)
            return np.stack([np.bincount(at, mass * x, cells) for x in (np.ones(len(at)), *targets.T, *(targets ** 2).T)], axis=1)

        def run(batches):
            total = np.zeros((cells, len(names)))
            for batch in batches:
                if batch.num_rows:
                    total += sums_of(np.asarray(batch.column("kind")), np.asarray(batch.column("c")) + ALPHA, _rows_of(batch.column("vectors"))[:, WIDTH:])
            at = np.flatnonzero(total[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, *total[at].T)], ["cell", *names])

        own = words.filter("vectors is not null").select("kind", "c", "vectors")
        rows = own.mapInArrow(run, ", ".join(["cell long", *(f"{x} double" for x in names)])).groupBy("cell").agg(*(F.sum(x).alias(x) for x in names))
        total = np.zeros((cells, len(names)))
        for r in rows.collect():  # a row per class and cluster at most
            total[r["cell"]] = r[1:]
        # The other words of a class, and its place for words never seen, have the vectors of its tail.
        rest = np.maximum(vocabulary.mass - total[:, 0].reshape(CLASSES, CLUSTERS).sum(axis=1), 0)
        if rest[0] < vocabulary.mass[0]:
            rest[0] = 0  # the end is all of its class
        total += sums_of(np.arange(CLASSES), rest, tails[:, WIDTH:])
        mass = total[:, 0].reshape(CLASSES, CLUSTERS)
        mass = mass / mass.sum(axis=1, keepdims=True)
        by_cluster = total.reshape(CLASSES, CLUSTERS, -1).sum(axis=0)
        weight = np.maximum(by_cluster[:, :1], 1e-30)
        means, squares = by_cluster[:, 1:WIDTH + 1] / weight, by_cluster[:, WIDTH + 1:] / weight
        self.factors = np.concatenate([means, np.maximum(squares - means ** 2, 0) / 2], axis=1).T.astype(np.float32)
        self.mass = (np.exp(classes.table) @ mass).astype(np.float32)

    def log(self, contexts: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """The logarithm of Z after contexts whose two classes are ``runs``."""
        powers = np.concatenate([contexts, contexts ** 2], axis=1) @ self.factors
        return np.log(np.einsum("ij,ij->i", np.exp(np.minimum(powers, 80)), self.mass.take(runs, axis=0)))


class LanguageModel:
    """What is learnt from training texts: counts and vectors of all words (a table), the class model and the sums over all words."""

    def __init__(self, texts: DataFrame):
        self._learn(coded(texts.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("learn"))))

    @classmethod
    def of_chunks(cls, chunks: DataFrame) -> LanguageModel:
        model = cls.__new__(cls)
        model._learn(chunks)
        return model

    def _learn(self, chunks: DataFrame) -> None:
        counts = stored(count_words(chunks), "lm-counts")
        classes = counts.groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()  # a row per class
        self.vocabulary = Vocabulary(classes)
        self.classes = LogBilinear(count_runs(chunks))
        part = ClassPart(self.classes)
        tidy(chunks.sparkSession)
        vectors = stored(mean_vectors(train_chunks(chunks, counts, part)), "lm-vectors")
        tidy(chunks.sparkSession)
        self.words = stored(counts.join(vectors, "word", "left"), "lm-words")
        self.tails = np.concatenate([part.start + OWN_START * _of_hash(TAILS), np.zeros((CLASSES, WIDTH), np.float32)], axis=1)
        keys = TAILS.tolist()
        for r in vectors.filter(F.col("word").isin(keys)).collect():
            self.tails[keys.index(r["word"])] = _rows_of(pa.array([bytes(r["vectors"])]))[0]
        self.normaliser = Normaliser(self.words, self.vocabulary, self.classes, self.tails)
        dropped(counts, vectors)
        tidy(chunks.sparkSession)


def token_scores(t: Chunk, counts: np.ndarray, vectors: np.ndarray, table: np.ndarray, mass: np.ndarray, normaliser: Normaliser) -> np.ndarray:
    """log10 p(token | the two before) of all tokens of a chunk, given the counts and vectors of its words."""
    before, kinds = _before(t.sizes), t.kinds[t.places]
    runs = _runs(kinds, t.sizes)
    # Log share within the class; the end is all of its class.
    shares = np.where(t.kinds == 0, 0.0, np.log10(counts + ALPHA) - np.log10(mass[t.kinds]))
    out = table.take(runs) + shares.take(t.places)
    runs //= CLASSES
    context, target = np.ascontiguousarray(vectors[:, :WIDTH]), np.ascontiguousarray(vectors[:, WIDTH:])
    for a in range(0, len(out), TOKENS):
        b = min(len(out), a + TOKENS)
        u = _contexts(context, t.places, before, a, b, 0)
        tilt = np.einsum("ij,ij->i", u, target.take(t.places[a:b], axis=0)) - normaliser.log(u, runs[a:b])
        out[a:b] += tilt / np.log(10)
    return out


def score_chunks(chunks: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``score_texts`` for coded texts."""
    v = model.vocabulary
    sent = chunks.sparkSession.sparkContext.broadcast((v.mass, (model.classes.table / np.log(10)).astype(np.float32).ravel(), model.tails, model.normaliser))
    known = words_of(chunks).select("chunk", "place", "word").join(model.words.select("word", "c", "vectors"), "word").select("chunk", "place", "c", "vectors")
    all_words = float(np.log10(v.total + ALPHA * (v.distinct + 1)))
    kind = dict(chunks.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")

    def run(left, right):
        mass, table, tails, normaliser = sent.value
        if not left.num_rows:
            return pa.table({"doc_id": left.column("doc_ids").combine_chunks().flatten(), "n_tokens": pa.array([], pa.int64()),
                             "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        t = Chunk.read(left.drop_columns(["chunk", "doc_ids"]).to_pylist()[0])
        place = np.asarray(right.column("place"))
        counts = np.zeros(len(t.kinds), np.int64)
        counts[place] = np.asarray(right.column("c"))
        vectors = tails[t.kinds]
        own = np.asarray(right.column("vectors").is_valid())
        vectors[place[own]] = _rows_of(right.column("vectors").drop_null())
        logs = np.log10(counts + ALPHA)
        first = np.cumsum(t.sizes, dtype=np.int64) - t.sizes
        add = lambda x: np.add.reduceat(x, first)
        give_back()
        return pa.table({
            "doc_id": left.column("doc_ids").combine_chunks().flatten(), "n_tokens": pa.array(t.sizes.astype(np.int64)),
            "n_known": pa.array(add((counts > 0).astype(np.int64)[t.places])), "base_score": pa.array(add(logs[t.places]) - t.sizes * all_words),
            "score": pa.array(add(token_scores(t, counts, vectors, table, mass, normaliser).astype(np.float64))),
        })

    texts = chunks.select("chunk", "doc_ids", "kinds", "places", "sizes")
    schema = f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double"
    scored = texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, schema)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
                         F.lit(v.total).cast("long").alias("train_tokens"), "base_score", "score")


def score_texts(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text.

    A null text is empty and consists of its end. Repeated rows are scored alike,
    other columns are ignored, an empty table gives no rows; without training
    texts all words are unknown.
    """
    return score_chunks(coded(docs.select("doc_id", "text", F.lit(False).alias("learn"))), model)


def score_corpus(docs: DataFrame) -> DataFrame:
    """Learn from the texts that are not held out, score all; each is coded once."""
    chunks = coded(docs.select("doc_id", "text", (~is_held_out(F.col("doc_id"))).alias("learn")))
    return score_chunks(chunks, LanguageModel.of_chunks(chunks))
