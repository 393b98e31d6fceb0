"""Personal data: patterns for what has a fixed form, a linear-chain CRF for the rest.

The field is trained from a small labelled table on the shapes of a token and its
neighbours, by gradient steps on the exact likelihood (forward and backward sums).
A batch of texts is cut into lines and tokens; all scores of a token come from
tables with a row per kind of token, and Viterbi runs over all lines of the
batch at once. What it finds is added to the spans of the patterns where it
does not overlap them.

Everything is per text: Spark spreads the rows, nothing is shuffled.
"""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds with a pattern, in the order of the output; and kinds that only the field finds.
KINDS, FOUND = ("email", "ip", "card", "phone"), ("id", "name")
#: Kinds that the field labels.
TAGS = ("email", "id", "name", "phone")
LABELS = ("O", *[f"{p}-{k}" for k in TAGS for p in "BI"])

#: Code points of texts looked at together; and tokens a worker remembers the kind of.
TOGETHER, REMEMBERED = 1 << 20, 1 << 17

# The labelled table: spans as [kind text].
LABELLED = """
Please call me at [phone 030 1234567] tonight.
My number is [phone (017) 555-7713] and I am home after six.
You can reach us under [phone 555-0142], ask for the office.
Phone: [phone 0171-5550199], fax on request.
Tel. [phone 020 7946 0958] or by post.
Mobile [phone 0160 555 2210] works on weekends.
Call [phone (212) 555-0187] for details.
Telefon: [phone 089 555 4321], Herr im Büro
Appelez le [phone 01 42 68 53 00] avant midi.
Llame al [phone 91 555 01 23] por favor.
Her cell is [phone 415-555-0132], do not share it.
The new line is [phone 1-800-555-0155].
phone [phone 555 0100]
tel: [phone 07700 900461]
Contact: [phone +44 20 7946 0018], desk two.
Ring [phone +1 (415) 555-0101] twice.
Fax [phone (030) 555 8899] is switched off.
Mail me: [email john (at) example.org]
Send it to [email info [at] example [dot] net] today.
E-mail: [email anna@example.com], replies are slow.
mail [email bob.smith@mail.example.org]
email [email sales (at) example (dot) com]
Her SSN is [id 078-05-1120] on the form.
SSN: [id 219-09-9999]
Social security number [id 457-55-5462] was printed.
IBAN [id DE89 3704 0044 0532 0130 00] for the fee.
IBAN: [id GB29NWBK60161331926819]
Pay to IBAN [id FR76 3000 6000 0112 3456 7890 189] by Friday.
Passport [id C01X00T47] was lost.
Passport no. [id L8988901C] expires soon.
tax id [id 123-45-6789] given
Dear Mr [name John Miller], thank you.
Mrs [name Anna Schmidt] lives there.
Dr. [name Peter Novak] will see you.
My name is [name Maria Lopez] and I live here.
Herr [name Klaus Weber] kommt morgen.
Frau [name Petra Braun], bitte melden.
Monsieur [name Paul Durand] est venu.
Señora [name Carmen Ruiz] vive aquí.
Ms [name Lee] called.
my name is [name Tom Baker].
Mr. [name Brown] agreed, and Mrs. [name Green] left.
The server 10.0.0.1 answered 97.51.17.173 at noon.
Order 9807915762804490 was sent on 2024-05-17.
Number 4845168114407329 is the order, 7536784127813050 the next.
token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" was leaked.
Licensed under the Apache License, Version 2.0.
the GNU General Public License, version 3.
The price is 1,299.00 or 15% less, 20 pieces.
In 1999 and 2004 there were 30 of them, in 2010 none.
Chapter 4, page 117, lines 12-19.
At 10:45 the train left; at 11:30 it came back.
They met on 12/05/2021 and 3.4.2022.
a | bb | 12 | 345 | cc | 6789
x = 12345 + 678 * 90
Room 555 is on floor 5, seat 12 34.
The score was 3-1 after 90 minutes, 555-1 odds.
We sold 100 000 units in 12 months.
version 1.2.3-4 build 20240517
And in the end, there was nothing at all to see.
The thand er of, thing onre. Ander the in that.
He was at the dot of the line.
She looked at me and at the clock. The dot was red.
Ein Haus in der Stadt. Die Frau und der Mann im Garten.
La casa de la calle. El perro y la vida.
Les mots de la page et le texte. Une autre ligne.
Der Herr und die Frau sind da. Herr und Hund.
The name of the street is long. His name was on it.
My phone is old and the call was short.
Call it what you want. Mail was late. The address is wrong.
Phone and fax are both broken in the office.
Anthe ingre. Thston oned, Ereaor tion. Whthing on
Thing: Ander Thereat, Onre Thand, Ingheth Erhan.
IN THE END. ANDER THEREAT ONRE
The passport and the iban are forms. A number is a number.
Dr and Mr are titles. the mr of it
Contact us in person. Write to us or send it to the office.
### title of 12 $$$ words %%% && more ***
1. one 2. two 3. three
- 5 - 6 - 7
(12) and (345) and (6)
555 times 42 is 23310
code A12 and B7 and XK-450
Is. Anat thth onor. Ti. This a enen. By. Onlyou. Erou.
Ating. Ating. Ating. At At At At onor at the thand.
Onou Onou Onou Onou. Ler. Thed Ander. Re. Thing Onre was.
Thwh. Bleea. Ereaou the on. St. Ertion the. Na. With Ernt.
Die. Schge Ieau be. Le. Aieau Aieux en. El. Esdo Doñta el.
Theres.%%% Thored.%%% Ofthe### he%%% Ander$$$ Thing
Er. Ander. Un. Onre Thand. Ly. Ingheth Erhan at. An. Thand
at. At, thand at Ander. In at on At. Dot. At dot
Hat Ingheth Erhan thand. Das Enkeit und Enheit. Ing Ander of
Thing Thing Thing Thing Thing Thing Thing Thing Thing Thing
thand thand thand thand thand thand thand thand thand thand
For For For For For For thenes thenes thenes thenes
This This This This This This This esst esst esst esst
Thsh Thsh Thsh Thsh and and and and Anou Anou Anou by by by
Esin Esin Esin was was was Whha Whha on on Edti Edti and, and,
Is. That and reth. Is. Onth. Hehe heble. In. Edti Treoi une. Ms and Dr
DER!! ENCH!! TZ.!! UND!! ERVER!! BE!! AUF!! DAS!! A!! AND,!!
THAT!! OF!! THE!! ANDER,!! TO!! A!! IN!! ONRE.!! AT!! DOT!!
12 12 12 12 12 12 (12) (12) 4444 4444 4444
la%%% de%%% que&&& esrr*** gaco$$$ Una%%% Ander### Thing***
| Ander | thing | Corr. | Onre | taci | Thand. | 12.5 |
Ander, Thing, Onre, Thand, Ingheth, Erhan; Anat: Ereaor
"Ander thing" (Onre) [Thand] <Ingheth> {erhan} 'On'
"""

_MARK = re.compile(r"\[(email|id|name|phone) ((?:[^\[\]]|\[\w+\])+)\]")
_BLANK = b" \t\n\r\x0b\x0c"
_EDGES = b".,;:!?\"'()[]{}<>|#$%&*"
_SHAPE = bytes(ord("9") if chr(c).isdigit() and c < 128 else ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c > 127 else c for c in range(256))
_RUNS = re.compile(rb"(a)a+|(A)A+|([^aA9])\3+")


def labelled(table: str = LABELLED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, [(kind, start, end)]) of every line with marked spans."""
    out = []
    for line in table.strip().splitlines():
        text, spans, at = "", [], 0
        for m in _MARK.finditer(line):
            text += line[at:m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        out.append((text + line[at:], spans))
    return out


def core(token: bytes) -> tuple[int, int]:
    """Bytes to take off at both ends of a token: punctuation around it. A bracketed word keeps its brackets as far as they match."""
    left = len(token) - len(token.lstrip(_EDGES))
    if left == len(token):
        return 0, 0
    right = len(token) - len(token.rstrip(_EDGES))
    inside = token[left:len(token) - right]
    if left and token[left - 1:left] == b"(" and (b")" in inside or token[len(token) - right:][:1] == b")"):
        left -= 1
        right -= 0 if b")" in inside else 1
    elif left and token[left - 1:left] == b"[" and token[len(token) - right:][:1] == b"]":
        left, right = left - 1, right - 1
    return left, right


def _outline(token: bytes) -> bytes:
    """A token with all letters of a case and all digits alike, runs of other than digits cut short."""
    return _RUNS.sub(lambda m: (m[1] or m[2] or m[3]) + b"+", token.translate(_SHAPE))


def features(token: bytes, known) -> list[str]:
    """Names of a token's features; ``known`` holds the words that are features themselves."""
    left, right = core(token)
    inside = token[left:len(token) - right] if right else token[left:]
    shape = _outline(inside)[:40].decode("latin-1")
    digits = sum(48 <= c <= 57 for c in inside)
    out = ["bias", "shape=" + shape, f"digits={min(digits, 12)}", "kinds=" + "".join(sorted(set(shape)))]
    if token[:left]:
        out.append("before=" + chr(token[left - 1]))
    if right:
        out.append("after=" + chr(token[len(token) - right]))
    word = inside.lower()
    if word in known:
        out.append("word=" + word.decode())
    return out


def _words(texts: list[bytes]) -> set[bytes]:
    """Words of letters, or in brackets, in the labelled table."""
    found = {t[core(t)[0]:len(t) - core(t)[1]].lower() for text in texts for t in text.split()}
    return {w for w in found if not any(48 <= c <= 57 for c in w) and b"@" not in w}


class Field:
    """A trained linear-chain conditional random field.

    ``weights``: (feature, offset) to a row of ``table``; ``moves``: scores of label
    pairs, with impossible ones far below all others; ``first``: of the first label.
    """

    STEPS, RATE, DECAY = 150, 0.2, 0.004

    def __init__(self, rows=None):
        rows = labelled() if rows is None else rows
        self.known = _words([text.encode() for text, spans in rows])
        # Words that are part of a name are no features: the shape is to count.
        for text, spans in rows:
            for kind, start, end in spans:
                if kind in ("name", "id"):
                    self.known -= _words([text[start:end].encode()])
        self.index: dict[tuple[str, int], int] = {}
        lines = [self._line(text, spans) for text, spans in rows]
        self._train(lines)
        self.classes: dict[tuple, int] = {}
        self.remembered: dict[bytes, int] = {}
        self.scores = [np.zeros((0, len(LABELS)), np.float32)] * 3
        self.edge = self._kind(None)

    # Training.

    def _line(self, text, spans):
        tokens = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        marks, names = [0] * len(tokens), [features(text[a:b].encode(), self.known) for a, b in tokens]
        for kind, start, end in spans:
            inside = [i for i, (a, b) in enumerate(tokens) if a < end and b > start]
            for i in inside:
                marks[i] = LABELS.index(("B-" if i == inside[0] else "I-") + kind)
        rows = []
        for i in range(len(tokens)):
            own = []
            for offset in (-1, 0, 1):
                around = names[i + offset] if 0 <= i + offset < len(tokens) else ["edge"]
                own += [self.index.setdefault((f, offset), len(self.index)) for f in around]
            rows.append(own)
        return rows, marks

    def _train(self, lines):
        """Adam steps on the mean log likelihood with a quadratic penalty."""
        size, labels = len(lines), len(LABELS)
        longest, most = max(len(rows) for rows, _ in lines), max(len(x) for rows, _ in lines for x in rows)
        feats = np.full((size, longest, most), len(self.index))
        gold, real = np.zeros((size, longest), int), np.zeros((size, longest), bool)
        for k, (rows, marks) in enumerate(lines):
            gold[k, :len(marks)], real[k, :len(marks)] = marks, True
            for t, own in enumerate(rows):
                feats[k, t, :len(own)] = own
        allowed = np.array([[not b.startswith("I") or a[2:] == b[2:] for b in LABELS] for a in LABELS])
        starts = np.array([not b.startswith("I") for b in LABELS])
        flat, used = feats[real], feats[real] < len(self.index)
        shapes = [(len(self.index) + 1, labels), (labels, labels), (labels,)]
        values = [np.zeros(s) for s in shapes]
        mean, square = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
        for step in range(1, self.STEPS + 1):
            table, moves, first = values
            moves, first = np.where(allowed, moves, -1e4), np.where(starts, first, -1e4)
            scores = table[feats].sum(axis=2)
            ahead = np.empty((size, longest, labels))
            ahead[:, 0] = first + scores[:, 0]
            for t in range(1, longest):
                new = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + scores[:, t]
                ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
            total = np.logaddexp.reduce(ahead[:, -1], axis=1)
            behind, pairs = np.zeros((size, labels)), np.zeros((labels, labels))
            wanted = np.zeros((size, longest, labels))
            wanted[np.arange(size)[:, None], np.arange(longest), gold] = 1
            error = np.zeros((size, longest, labels))
            for t in range(longest - 1, -1, -1):
                error[:, t] = (np.exp(ahead[:, t] + behind - total[:, None]) - wanted[:, t]) * real[:, t, None]
                if t:
                    own = real[:, t]
                    joint = np.exp(ahead[own, t - 1, :, None] + moves + (scores[own, t] + behind[own])[:, None, :] - total[own, None, None])
                    pairs += joint.sum(axis=0)
                    np.add.at(pairs, (gold[own, t - 1], gold[own, t]), -1)
                    behind = np.where(own[:, None], np.logaddexp.reduce(moves + (scores[:, t] + behind)[:, None, :], axis=2), behind)
            slope = np.zeros(shapes[0])
            np.add.at(slope, flat[used], np.repeat(error[real], used.sum(axis=1), axis=0))
            for k, grad in enumerate((slope, pairs * allowed, error[:, 0].sum(axis=0) * starts)):
                grad = grad / size + self.DECAY * values[k] / 2
                mean[k] = 0.9 * mean[k] + 0.1 * grad
                square[k] = 0.99 * square[k] + 0.01 * grad * grad
                values[k] = values[k] - self.RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
        self.table = values[0]
        self.moves, self.first = np.where(allowed, values[1], -1e4).astype(np.float32), np.where(starts, values[2], -1e4).astype(np.float32)

    # Decoding.

    def _kind(self, token: bytes | None) -> int:
        """Row of a token's scores in the three tables: as the token before, itself, and the one behind.

        Tokens of one outline that hold the same known word, or none, have the same features.
        """
        if token is None:
            key = None
        else:
            word = token.strip(_EDGES).lower()
            key = _outline(token), word if word in self.known or (word := b"(" + word + b")") in self.known or (word := b"[" + word[1:-1] + b"]") in self.known else None
        if key not in self.classes:
            self.classes[key] = len(self.classes)
            names = ["edge"] if token is None else features(token, self.known)
            for k, offset in enumerate((-1, 0, 1)):
                rows = [self.index[(f, offset)] for f in names if (f, offset) in self.index]
                self.scores[k] = np.vstack([self.scores[k], self.table[rows].sum(axis=0, keepdims=True).astype(np.float32)])
        return self.classes[key]

    def kinds(self, tokens: list[bytes]) -> np.ndarray:
        if len(self.classes) > REMEMBERED or len(self.remembered) > REMEMBERED:
            self.classes, self.remembered, self.scores = {}, {}, [s[:0] for s in self.scores]
            self.edge = self._kind(None)
        for t in set(tokens).difference(self.remembered):
            self.remembered[t] = self._kind(t)
        return np.fromiter(map(self.remembered.__getitem__, tokens), np.int64, len(tokens))

    def decode(self, kinds: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Best labels of tokens; lines begin at ``starts``."""
        n = len(kinds)
        lengths = np.diff(np.append(starts, n))
        before, after = np.append(self.edge, kinds[:-1]), np.append(kinds[1:], self.edge)
        before[starts], after[starts + lengths - 1] = self.edge, self.edge
        # An offset of -1 is the token before.
        scores = self.scores[0][before] + self.scores[1][kinds] + self.scores[2][after]
        order = np.argsort(-lengths, kind="stable")
        firsts, lengths = starts[order], lengths[order]
        best, back = self.first + scores[firsts], np.zeros((n, len(LABELS)), np.int8)
        running = np.searchsorted(-lengths, -np.arange(1, lengths[0]), side="left")  # lines longer than t
        final = best.copy()
        for t, m in enumerate(running.tolist(), 1):
            way = best[:m, :, None] + self.moves
            at = firsts[:m] + t
            back[at] = way.argmax(axis=1)
            best = way.max(axis=1) + scores[at]
            final[:m] = best
        out = np.zeros(n, np.int64)
        label = final.argmax(axis=1)
        out[firsts + lengths - 1] = label
        for t in range(int(lengths[0]) - 1, 0, -1):
            m = running[t - 1]
            at = firsts[:m] + t
            out[at - 1] = back[at, out[at]]
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) in code points that the field finds in each text."""
        out = [[] for _ in texts]
        whole = "\n".join(texts)
        tokens = whole.encode("utf-8", "replace").split()
        if not tokens:
            return out
        points = np.frombuffer(whole.encode("utf-32-le", "replace"), "<u4")
        blank = np.concatenate([[True], (points == 32) | ((points >= 9) & (points <= 13)), [True]])
        begins, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
        line = np.searchsorted(np.flatnonzero(points == 10), begins)
        starts = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        labels = self.decode(self.kinds(tokens), starts)
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        hits = np.flatnonzero(labels)
        at, k = hits.tolist(), 0
        while k < len(at):
            i = j = at[k]
            kind = LABELS[labels[i]][2:]
            while k + 1 < len(at) and at[k + 1] == j + 1 and labels[j + 1] == LABELS.index("I-" + kind):
                k, j = k + 1, j + 1
            text = int(np.searchsorted(offsets, begins[i], side="right")) - 1
            # Edges are single bytes, so they count as code points.
            start, end = int(begins[i]) + core(tokens[i])[0], int(ends[j]) - core(tokens[j])[1]
            if holds(kind, whole[start:end]):
                out[text].append((kind, start - int(offsets[text]), end - int(offsets[text])))
            k += 1
        return out


# Patterns.

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Digits of doubled digits, fixed values.
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def passes_luhn(digits: str) -> bool:
    own = [int(c) for c in reversed(digits)]
    return (sum(own[0::2]) + sum(_DOUBLED[d] for d in own[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, by kind in the order of KINDS, then start. Linear in the text."""
    out, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                last = m.end()
    # Runs of dotted numbers fall into fours from the left; what is left over is none.
    for m in _DOTTED.finditer(text):
        parts = list(_NUMBER.finditer(text, m.start(), m.end()))
        for k in range(0, len(parts) - 3, 4):
            if all(len(p[0].lstrip("0")) <= 3 and int(p[0].lstrip("0") or 0) <= 255 for p in parts[k:k + 4]):
                out.append(("ip", parts[k].start(), parts[k + 3].end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and passes_luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def holds(kind: str, text: str) -> bool:
    """Exact check of what the field found: the signs and digits without which it cannot be of its kind."""
    digits = sum("0" <= c <= "9" for c in text)
    if kind == "email":
        return bool(re.search(r"@|[(\[]at[)\]]", text, re.I))
    if kind == "phone":
        return 7 <= digits <= 15
    return digits >= 5 if kind == "id" else digits == 0


def with_added(base: list[tuple[str, int, int]], found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """All spans: the base ones, and found ones that overlap none of them."""
    if not found:
        return base
    taken = sorted((s, e) for _, s, e in base)
    free, k, reach = [], 0, -1
    for span in sorted(found, key=lambda x: x[1]):
        while k < len(taken) and taken[k][0] < span[2]:
            reach, k = max(reach, taken[k][1]), k + 1
        if reach <= span[1]:
            free.append(span)
    order = {kind: i for i, kind in enumerate((*KINDS, *FOUND))}
    return sorted(base + free, key=lambda x: (order[x[0]], x[1]))


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
_SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_personal(docs: DataFrame, rows=None) -> DataFrame:
    """doc_id, base, spans (arrays of kind, start, end in code points) of every whole text."""
    def of(base, spans):
        return [[dict(zip(("kind", "start", "end"), s)) for s in own] for own in (base, spans)]

    return _scanned(docs, rows, [("base", _SPANS, _SPAN), ("spans", _SPANS, _SPAN)], of)


def _written(spans) -> str:
    return ",".join([f"{k}:{s}:{e}" for k, s, e in spans])


def pii_report(docs: DataFrame, rows=None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document.

    Counts and digest are of the patterns alone; ``spans`` also holds what the
    field adds (email, phone, id, name). A null or empty text has none. A text
    may be of any length; a task holds its tokens (about 150 bytes each) and
    scores. Repeated rows come out alike, other columns are ignored, an empty
    table gives no rows.
    """
    def of(base, spans):
        counts = [sum(s[0] == kind for s in base) for kind in KINDS]
        return [*counts, sha256(_written(base).encode()).hexdigest(), _written(spans)]

    columns = [(f"n_{k}", "long", pa.int64()) for k in KINDS] + [("base_sha256", "string", pa.string()), ("spans", "string", pa.string())]
    return _scanned(docs, rows, columns, of)


def _scanned(docs: DataFrame, rows, columns: list[tuple[str, str, pa.DataType]], of) -> DataFrame:
    """doc_id and the columns (name, type in Spark, type in Arrow) that ``of`` makes of a text's base and all spans."""
    field = Field(rows)
    docs = docs.select("doc_id", "text")
    schema = ", ".join([f"doc_id {dict(docs.dtypes)['doc_id']}", *[f"{name} {kind}" for name, kind, _ in columns]])

    def groups(texts):
        own, size = [], 0
        for t in texts:
            own.append(t)
            size += len(t)
            if size >= TOGETHER:
                yield own
                own, size = [], 0
        if own:
            yield own

    def run(batches):
        for batch in batches:
            out = []
            for texts in groups((t or b"").decode("utf-8", "replace") for t in batch.column("text").cast(pa.binary()).to_pylist()):
                for text, found in zip(texts, field.spans(texts), strict=True):
                    base = base_spans(text)
                    out.append(of(base, with_added(base, found)))
            rest = [pa.array([row[k] for row in out], kind) for k, (_, _, kind) in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *rest], ["doc_id", *[name for name, _, _ in columns]])

    return docs.mapInArrow(run, schema)
