"""Quality rules: robust multivariate outliers among texts of one language and source.

Every text gets counts and a vector of transformed ratios. For each (language,
source), each language and all texts together, the minimum-covariance-determinant
estimate is found by concentration steps: from a start, keep the ``SUBSET`` of
rows nearest to the centre, take their mean and covariance, and repeat. Of two
starts (median and MAD; all rows) the one with the smaller determinant counts.
A text is judged by the finest estimate that rests on ``MIN_ROWS`` texts.

All steps are aggregates that combine before the shuffle; a step's result has a
row per group and is written to the shared folder before rows join it. Its size is
then known, so a small one is sent to the rows, which stay where they are and are
summed there: a group with all rows never meets in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from haltscope.llm.common import ROW, give_back, keyed, stored, without_rows

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SUBSET = 0.75
STEPS = 4
MIN_ROWS = 200
# Squared distance beyond which a text is an outlier, once distances are scaled
# so that their median is that of a chi-square variable. Fixed value: the 0.9999
# quantile of one with seven degrees of freedom.
CUTOFF = 29.878
# Spread that each entry is given at least: most ratios are zero in most texts.
FLOOR = (0.04, 0.05, 0.05, 0.05, 0.05, 0.15, 0.15)
FEATURES = ("word_length", "symbols", "upper", "digits", "punctuation", "dup_lines", "repeats")
P = len(FEATURES)
# Fixed value: median of a chi-square variable with seven degrees of freedom.
CHI2_MEDIAN = 6.3458

SPACE, SYMBOL, UPPER, DIGIT, PUNCT, LETTER, CONTINUED = range(7)


def _byte_classes() -> np.ndarray:
    kind = np.full(256, LETTER, np.uint8)
    for c in range(128):
        ch = chr(c)
        if ch in " \t\n\x0b\x0c\r":
            kind[c] = SPACE
        elif ch in "#*$%&|<>":
            kind[c] = SYMBOL
        elif "A" <= ch <= "Z":
            kind[c] = UPPER
        elif "0" <= ch <= "9":
            kind[c] = DIGIT
        elif not ch.isalpha():
            kind[c] = PUNCT
    kind[0x80:0xC0] = CONTINUED
    return kind


CLASSES = _byte_classes()


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.array([codes.setdefault(w, len(codes)) for w in words], dtype=np.int64)
    pairs = ids[:-1] * len(codes) + ids[1:]
    if len(codes) >= 1 << 20:  # the product of three numbers would not fit
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(codes) + ids[2:]
    _, back, n = np.unique(windows, return_inverse=True, return_counts=True)
    again = n[back] > 1
    inside = np.zeros(len(ids), bool)
    for shift in range(3):
        inside[shift:len(ids) - 2 + shift] |= again
    return int(inside.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def text_counts(text: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, upper, digits, punctuation, lines."""
    n = np.bincount(CLASSES[np.frombuffer(text, np.uint8)], minlength=7)
    words = text.split()
    chars = len(text) - int(n[SPACE]) - int(n[CONTINUED])
    return (len(words), chars, int(n[SYMBOL]), duplicate_lines(text), repeated_words(words),
            int(n[UPPER]), int(n[DIGIT]), int(n[PUNCT]), text.count(b"\n") + 1)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "upper", "digits", "punct", "lines")


def _count_batches(batches):
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        rows = np.array([text_counts(t or b"") for t in texts], dtype=np.int64).reshape(len(texts), len(COUNTS))
        kept = [batch.column(c) for c in ("doc_id", "lang", "source")]
        yield pa.RecordBatch.from_arrays(kept + [pa.array(rows[:, k]) for k in range(len(COUNTS))], ["doc_id", "lang", "source", *COUNTS])
    give_back()


def with_counts(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "lang", "source", "text")
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(_count_batches, schema)


X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def _vector():
    share = lambda n, of: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(n) / F.greatest(F.col(of), F.lit(1)))))
    values = (
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", "word_chars"),
        share("upper", "word_chars"), share("digits", "word_chars"), share("punct", "word_chars"), share("n_dup_lines", "lines"),
        share("n_repeat_words", "n_words"),
    )
    return [v.alias(x) for v, x in zip(values, X, strict=True)]


def _with_distance(rows: DataFrame, out: str = "d") -> DataFrame:
    """Squared Mahalanobis distance of x0.. from ``mean``; ``form`` has the quadratic form's factor of each pair."""
    off = rows.select("*", *[(F.col(x) - F.col("mean")[i]).alias(f"_{x}") for i, x in enumerate(X)])
    terms = " + ".join(f"form[{k}] * _x{i} * _x{j}" for k, (i, j) in enumerate(PAIRS))
    return off.withColumn(out, F.expr(terms)).drop(*[f"_{x}" for x in X])


def _moments(rows: DataFrame) -> DataFrame:
    """Count, sums and sums of products per group and start."""
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(X)]
    products = [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p{k}") for k, (i, j) in enumerate(PAIRS)]
    return rows.groupBy("grp", "start").agg(F.count("*").cast("double").alias("n"), *sums, *products)


def _invert(batches):
    floor = np.diag(np.square(FLOOR))
    for pdf in batches:
        mean, form, logdet = [], [], []
        for row in pdf.to_dict("records"):
            m = np.array([row[f"s{i}"] for i in range(P)]) / row["n"]
            cov = np.zeros((P, P))
            for k, (i, j) in enumerate(PAIRS):
                cov[i, j] = cov[j, i] = row[f"p{k}"] / row["n"] - m[i] * m[j]
            cov += floor
            inverse = np.linalg.inv(cov)
            mean.append(m)
            form.append([inverse[i, j] * (1 if i == j else 2) for i, j in PAIRS])
            logdet.append(float(np.linalg.slogdet(cov)[1]))
        yield pdf[["grp", "start"]].assign(mean=mean, form=form, logdet=logdet)


def _estimate(moments: DataFrame) -> DataFrame:
    return moments.mapInPandas(_invert, "grp string, start int, mean array<double>, form array<double>, logdet double")


def _median_start(rows: DataFrame) -> DataFrame:
    """Medians and MADs, as the sums that a group of one row with them would have."""
    middle = rows.groupBy("grp").agg(*[F.percentile_approx(x, 0.5, 10000).alias(f"s{i}") for i, x in enumerate(X)])
    mad = rows.join(stored(middle, "mcd-middle"), "grp").groupBy("grp").agg(
        *[F.first(f"s{i}").alias(f"s{i}") for i in range(P)],
        *[F.percentile_approx(F.abs(F.col(x) - F.col(f"s{i}")), 0.5, 10000).alias(f"m{i}") for i, x in enumerate(X)],
    )
    square = lambda i: F.pow(F.col(f"m{i}") * F.lit(1.4826), F.lit(2.0))
    products = [(F.col(f"s{i}") * F.col(f"s{j}") + (square(i) if i == j else F.lit(0.0))).alias(f"p{k}") for k, (i, j) in enumerate(PAIRS)]
    return mad.select("grp", F.lit(0).alias("start"), F.lit(1.0).alias("n"), *[f"s{i}" for i in range(P)], *products)


def _group(*columns: str):
    """A name for the values of some columns; null is a value of its own."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for c in columns]
    return F.concat_ws("|", F.lit(str(len(columns))), *[F.concat(F.char_length(p).cast("string"), p) for p in parts])


LEVELS = (("lang", "source"), ("lang",), ())


def mcd_estimates(rows: DataFrame, steps: int = STEPS, subset: float = SUBSET, min_rows: int = MIN_ROWS) -> DataFrame:
    """(grp, mean, form, scale) of every group of ``rows`` (lang, source, x0..) with enough rows."""
    each = rows.select(*X, F.explode(F.array(*[_group(*c) for c in LEVELS])).alias("grp"))
    sizes = each.groupBy("grp").agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") >= min_rows)
    sizes = stored(sizes, "mcd-sizes")
    each = stored(each.join(sizes, "grp").select("grp", *X), "mcd-rows")
    starts = each.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("start"))
    now = stored(_estimate(_moments(each.withColumn("start", F.lit(1))).unionByName(_median_start(each))), "mcd-0")
    for step in range(steps):
        far = _with_distance(starts.join(now.select("grp", "start", "mean", "form"), ["grp", "start"])).drop("mean", "form")
        edge = far.groupBy("grp", "start").agg(F.percentile_approx("d", subset, 10000).alias("edge"))
        edge = stored(edge, f"mcd-edge-{step}")
        now = stored(_estimate(_moments(far.join(edge, ["grp", "start"]).filter("d <= edge"))), f"mcd-{step + 1}")
    best = now.groupBy("grp").agg(F.min_by(F.struct("mean", "form"), F.struct("logdet", "start")).alias("b")).select("grp", "b.mean", "b.form")
    best = stored(best, "mcd-least")
    spread = _with_distance(each.join(best, "grp")).groupBy("grp").agg((F.percentile_approx("d", 0.5, 10000) / F.lit(CHI2_MEDIAN)).alias("scale"))
    return stored(best.join(spread, "grp"), "mcd-best")


def judge_quality(docs: DataFrame, cutoff: float = CUTOFF, **options) -> DataFrame:
    """Counts and verdict of every document: base_failed, distance, kept.

    A null or empty text has no words and fails. Null languages and sources are
    values of their own. Repeated rows are judged alike. Texts of groups without
    an estimate (fewer than ``min_rows`` texts in all) pass unless the base rules
    reject them. Other columns are ignored; an empty table gives no rows.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = with_counts(docs).select("*", failed.alias("base_failed"), *_vector())
    rows = stored(rows, "quality-rows")
    found = mcd_estimates(rows.filter("not base_failed"), **options)
    for k, columns in enumerate(LEVELS):
        level = found.withColumnRenamed("grp", "_level")
        rows = _with_distance(rows.withColumn("_grp", _group(*columns)).join(level, F.col("_grp") == F.col("_level"), "left"))
        rows = rows.withColumn(f"_d{k}", F.col("d") / F.greatest(F.col("scale"), F.lit(1.0)))
        rows = rows.drop("_grp", "d", *level.columns)
    rows = rows.withColumn("distance", F.coalesce(*[f"_d{k}" for k in range(len(LEVELS))]))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.lit(float(cutoff)), F.lit(True))
    return rows.select("doc_id", *COUNTS[:5], "base_failed", kept.alias("kept"), "distance")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows that pass, with all their columns; a ``doc_id`` may be null or repeated."""
    rows = keyed(docs)
    bad = judge_quality(rows.withColumn("doc_id", F.col(ROW)), **options).filter("not kept").select(F.col("doc_id").alias("_gone"))
    return without_rows(rows, bad)
