"""License scan: an Aho-Corasick automaton over words, and license expressions.

The automaton runs once over each text's words and finds notice phrases and the
words of the identifier tag. Behind a tag stands an expression (``MIT OR
(Apache-2.0 AND BSD-3-Clause)``), which a shunting-yard parser evaluates.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

# The base phrases, as words, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# The method's own phrases.
NOTICES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu affero general public license": "agpl-3",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl-2",
    "bsd 3 clause": "bsd-3",
    "bsd 2 clause": "bsd-2",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by 4 0": "cc-by",
    "all rights reserved": "all-rights-reserved",
    "public domain": "public-domain",
}
TAG = "spdx license identifier"
# How freely a text under the license may be used.
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "mit": 1.0, "apache-2": 1.0, "bsd-2": 1.0, "bsd-3": 1.0, "isc": 1.0, "cc-by": 0.9, "mpl-2": 0.7,
    "lgpl": 0.6, "cc-by-sa": 0.6, "gpl-2": 0.4, "gpl-3": 0.4, "agpl-3": 0.3, "cc-by-nc": 0.2, "all-rights-reserved": 0.0,
}
UNKNOWN = 0.5
# Identifiers in expressions, by their first words.
IDENTIFIERS = (
    ("mit", "mit"), ("apache-2", "apache-2"), ("bsd-2", "bsd-2"), ("bsd-3", "bsd-3"), ("isc", "isc"), ("mpl-2", "mpl-2"), ("agpl", "agpl-3"),
    ("lgpl", "lgpl"), ("gpl-2", "gpl-2"), ("gpl-3", "gpl-3"), ("cc0", "cc0"), ("cc-by-nc", "cc-by-nc"), ("cc-by-sa", "cc-by-sa"), ("cc-by", "cc-by"),
)

# Word bytes are digits, letters and all of a non-ASCII character; A-Z lower-cased, the rest white space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TAG_LINE = re.compile(rb"spdx-license-identifier:([^\r\n]*)", re.I)
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


@functools.cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def label_of(identifier: str) -> str:
    name = identifier.lower()
    return next((label for start, label in IDENTIFIERS if name == start or name.startswith((f"{start}-", f"{start}.", f"{start}+"))), name)


def postfix(expression: str) -> list[str]:
    """Shunting-yard: the longest expression at the start of a text, operators last.

    Empty if there is none, or if a parenthesis or an operand is missing.
    """
    out, held, operand, at = [], [], True, 0
    while match := _TOKEN.match(expression, at):
        token, at = match[1], match.end()
        op = token.lower()
        if operand != (token == "(" or (token != ")" and op not in _RANK)):
            break
        if token == "(":
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break
            held.pop()
        elif op in _RANK:
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[op]:
                out.append(held.pop())
            held.append(op)
            operand = True
        else:
            out.append(token)
            operand = False
    if operand or "(" in held:
        return []
    return out + held[::-1]


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Labels and freedom of an expression: the better of ``or``, the worse of ``and``; an exception (``with``) changes neither."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix(expression):
        if token in _RANK and len(stack) > 1:
            (right, r), (left, x) = stack.pop(), stack.pop()
            stack.append((left, x) if token == "with" else (left | right, max(x, r) if token == "or" else min(x, r)))
        else:
            label = label_of(token)
            stack.append(({label}, FREEDOM.get(label, UNKNOWN)))
    return stack[0] if len(stack) == 1 else None


def scan_text(text: bytes) -> dict:
    """Words, places of base phrases, labels, freedom and evaluated expressions of one text."""
    words = text.translate(_WORDS).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    starts, base, labels, free, tagged = [], set(), set(), [], False
    seen = blanks = 0
    for end, phrase in automaton().iter(line):
        if phrase == TAG:
            tagged = True
            continue
        label = BASE.get(phrase) or NOTICES[phrase]
        labels.add(label)
        free.append(FREEDOM.get(label, UNKNOWN))
        if phrase in BASE:
            base.add(label)
            # Hits come in the order of their ends, so blanks are counted once.
            blanks, seen = blanks + line.count(" ", seen, end), end
            starts.append(blanks - phrase.count(" ") - 1)
    expressions = []
    for match in _TAG_LINE.finditer(text) if tagged else ():
        if result := evaluate(match[1].decode("utf-8", "replace")):
            expressions.append(match[1].decode("utf-8", "replace").strip())
            labels |= result[0]
            free.append(result[1])
    return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": min(free, default=0.0), "expressions": expressions}


_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>"
_TYPES = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(),
          "labels": pa.string(), "score": pa.float64(), "expressions": pa.list_(pa.string())}


def _scan(batches):
    for batch in batches:
        found = [scan_text(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id")] + [pa.array([f[c] for f in found], t) for c, t in _TYPES.items()], ["doc_id", *_TYPES])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions.

    ``score`` is how freely the text may be used by all that it says (1: freely),
    0 when it says nothing. A null text is empty: no words, no places, no labels.
    Labels are distinct, sorted and joined by commas. Repeated rows are scanned
    alike, other columns are ignored, an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_scan, f"doc_id {dict(rows.dtypes)['doc_id']}, {_SCHEMA}")
