"""Personal data: patterns against the plain ones, the field on texts that it was not trained on."""

import re
from hashlib import sha256

import numpy as np
import pytest
from conftest import LONG

from haltscope.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, text):
    digits = [int(c) for c in text if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        doubled = [sum(map(int, str(2 * d))) for d in digits[-2::-2]]
        return 13 <= len(digits) <= 19 and (sum(doubled) + sum(digits[::-2])) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if good(k, m[0])]


HARD = [
    "a@b.c@d.e@f.g", "@x.y a@@b.c .@a.b", "a@b c@d. e@f.g.", "1.2.3.4.5.6.7.8.9", "256.1.1.1 001.002.003.0004", "1.2.3 4.5.6.7", "9" * 30, "4111 1111-1111 1111 5500-0000-0000-0004",
    "4111  111111111111", "+1 (017) 555-7713 + 1 555", "+1((((((", "+12345678901234567", "+49 30 1234567.", "+1 (843) 555-7672 170.106.47.218", "é@x.de ü@ä.de ä.b@c.de", "",
]


def test_patterns():
    for text in [*HARD, " ".join(HARD), "\n".join(HARD)]:
        assert pii.base_spans(text) == plain(text), text


def test_patterns_on_random_texts():
    draw = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(draw.choice(list("a@.+1 9-(%\n"), draw.integers(0, 60)))
        assert pii.base_spans(text) == plain(text), text


@pytest.mark.parametrize("piece", ["a", "1", "1.", "@", "a@", "+1", "+(", "1 "])
def test_patterns_are_linear(piece):
    pii.base_spans(piece * 300_000)  # would take hours if it were quadratic


@pytest.fixture(scope="module")
def field():
    return pii.Field()


UNSEEN = """
Telephone [phone 0171 555 2034] please.
reach me at [phone (044) 555-1234], thanks
call [phone 555-0199] now
Fax: [phone 030 555 0137] in the office
Mrs [name Clara Stone] and the dog were there
Dr. [name Hans Zimmer] wrote it
Frau [name Sabine Koch], guten Tag
My name is [name Julia Roth].
SSN [id 123-45-6789] is on it
IBAN [id DE12 5001 0517 0648 4898 90] was used
send to [email kate (at) example (dot) net] soon
Email: [email carl [at] example [dot] com]
The order 1234567890123456 came on 2021-03-04, page 17.
Version 2.0.1 of the code has 12 parts and 3,400 lines.
In the morning the light was red. Onre. Thand Ander was there.
"""


def test_field_on_unseen_texts(field):
    rows = pii.labelled(UNSEEN)
    found = field.spans([text for text, _ in rows])
    right = sum(len(set(own) & set(spans)) for own, (_, spans) in zip(found, rows))
    assert right >= 0.9 * sum(len(s) for _, s in rows)
    assert sum(map(len, found)) - right <= 1


def test_decoding_is_the_best_sequence(field):
    """Viterbi over many lines at once against all label sequences of short ones."""
    texts = ["call 030 555-0199", "Mrs Ada Lin", "x", "SSN 078-05-1120 ok"]
    for text in texts:
        tokens = text.encode().split()
        kinds = field.kinds(tokens)
        got = field.decode(kinds, np.array([0]))
        around = [field.edge, *kinds, field.edge]
        scores = [field.scores[0][around[i]] + field.scores[1][around[i + 1]] + field.scores[2][around[i + 2]] for i in range(len(tokens))]
        best = None
        for k in range(len(pii.LABELS) ** len(tokens)):
            labels = [k // len(pii.LABELS) ** i % len(pii.LABELS) for i in range(len(tokens))]
            value = field.first[labels[0]] + sum(s[j] for s, j in zip(scores, labels)) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:]))
            best = max(best or (value, labels), (value, labels))
        assert list(got) == best[1]
    together = field.spans(texts)
    assert together == [field.spans([t])[0] for t in texts]


def test_found_spans_never_touch_base_spans():
    base = [("email", 10, 20), ("phone", 5, 8)]
    found = [("name", 0, 5), ("name", 7, 9), ("id", 8, 10), ("name", 19, 30), ("phone", 20, 22)]
    assert pii.with_added(base, found) == [("email", 10, 20), ("phone", 5, 8), ("phone", 20, 22), ("id", 8, 10), ("name", 0, 5)]


def test_report(spark, odd, nothing):
    texts = ["mail a.b@c.de or +1 (017) 555-7713\nMrs Clara Stone", "97.51.17.173 and 4111111111111111 ☃ é", None, "", LONG, LONG + " x@y.zz"]
    docs = spark.createDataFrame([(k, t, "x", [1]) for k, t in enumerate(texts)], "doc_id long, text string, spans string, base array<int>")
    rows = pii.pii_report(docs).collect()
    for r, text in zip(sorted(rows, key=lambda r: r.doc_id), texts, strict=True):
        base = plain(text or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(filter(None, r.spans.split(",")))
    assert [r.spans for r in rows if r.doc_id == 0] == ["email:5:13,phone:17:34,name:39:50"]
    got = pii.pii_report(odd).collect()
    assert len(got) == odd.count() and all(r.spans == "" for r in got)
    assert pii.pii_report(nothing).collect() == []
    listed = {r.doc_id: [tuple(s) for s in r.base] for r in pii.find_personal(docs).collect()}
    assert listed == {k: plain(t or "") for k, t in enumerate(texts)}
