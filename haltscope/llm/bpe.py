"""Byte-level BPE as recursive SQL inside each task.

A task's batch of texts is cut into pretokens; those not met before go to an
in-process DuckDB. There every word is a list of tokens; a step of a recursive
query joins the positions of all words with the merge table, takes each word's
merge of the lowest rank (the leftmost of equals) and contracts it, until no word
has one left. Decoding joins positions with the vocabulary and aggregates in
order. Spark spreads the texts; nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame, functions as F

from haltscope.llm.common import give_back

RANKS = "byte_bpe_50k.tiktoken"
#: The rank file is sent to every worker, so its size is bounded.
MAX_BYTES = 64 << 20
#: Steps of one recursive query, whose rows stay until it ends; words not done by then go on in the next.
STEPS = 64
#: Bytes of units that a worker remembers (twice this in all), and words in one query.
REMEMBERED, TOGETHER = 24 << 20, 20_000
#: What a remembered unit takes besides its characters: two strings and an entry of a table.
ENTRY = 220
#: Memory of a worker's DuckDB.
DUCKDB = "160MB"
#: Code points of texts looked at together.
TEXTS = 1 << 20

# The key of a merge has the position in its low bits: lists of up to 2^32 tokens.
_POSITION = (1 << 32) - 1

_ENCODE = f"""
WITH RECURSIVE s AS (
  SELECT 0 AS it, word, toks, true AS more FROM words
  UNION ALL
  SELECT it + 1, s.word,
         list_concat(list_append(toks[:(key & {_POSITION}) - 1], CAST(key >> 32 AS INTEGER)), toks[(key & {_POSITION}) + 2:]), true
  FROM s JOIN (
    SELECT word, min((CAST(m.id AS BIGINT) << 32) + i) AS key
    FROM (SELECT word, unnest(toks) AS tok, unnest(toks[2:]) AS nxt, unnest(range(1, len(toks) + 1)) AS i FROM s) p
    JOIN merges m ON m.l = p.tok AND m.r = p.nxt GROUP BY word) b ON b.word = s.word
  WHERE it < {STEPS})
SELECT word, arg_max(toks, it) AS toks, max(it) AS steps FROM s GROUP BY word
"""
_DECODE = """
SELECT p.word, count(*) AS n, unhex(string_agg(v.piece, '' ORDER BY p.i)) AS data
FROM (SELECT word, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM words) p JOIN vocab v ON v.id = p.tok
GROUP BY p.word
"""
# Where the cheap cut below may differ from pretokens: a comma or point that is not
# behind a letter or digit; white space next to white space, or of another kind.
_ODD_POINT = re.compile(r"[,.](?<![^\W_].)")
_ODD_SPACE = ("  ", " \n", "\n ", "\n\n", "\0", *[c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"])


def is_plain(text: str) -> bool:
    return not (text[:1] in " \n" or text[-1:] in " \n" or any(x in text for x in _ODD_SPACE) or _ODD_POINT.search(text))


def read_ranks(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        data = f.read(MAX_BYTES + 1)
    if len(data) > MAX_BYTES:
        raise ValueError(f"the rank file is larger than {MAX_BYTES} bytes")
    return data


class Codec:
    """One vocabulary in a worker: its tables and the words it remembers."""

    def __init__(self, data: bytes, pattern: str = public_tokenizers.PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
        self.pattern = regex.compile(pattern)
        self.blanks = pattern == public_tokenizers.PATTERN
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB})
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], i) for t, i in self.ranks.items() for k in range(1, len(t))
                 if t[:k] in self.ranks and t[k:] in self.ranks]
        left, right, new = (pa.array([p[k] for p in pairs], pa.int32()) for k in range(3))
        self._table("merges", pa.table({"l": left, "r": right, "id": new}))
        self._table("vocab", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "piece": pa.array([t.hex() for t in self.ranks])}))
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.forget()

    def forget(self) -> None:
        # By unit: decimal ids; and the bytes that they stand for, where those are not the unit's own.
        self.written: dict[str, str] = {}
        self.other: dict[str, bytes] = {}
        self.before: dict[str, str] = {}
        self.size = 0

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("_rows", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM _rows")
        self.db.unregister("_rows")

    def _query(self, sql: str, words: np.ndarray, toks: pa.ListArray) -> pa.Table:
        self.db.register("words", pa.table({"word": pa.array(words, pa.int32()), "toks": toks}))
        return self.db.sql(sql).to_arrow_table().combine_chunks()

    def merged(self, words: list[bytes]) -> pa.ListArray:
        """Token ids of non-empty words."""
        done, places = [], []
        for at in range(0, len(words), TOGETHER):
            own = words[at:at + TOGETHER]
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            place = np.arange(at, at + len(own), dtype=np.int32)
            # A word that is a token is that token, like in the library.
            whole = [self.ranks.get(w) for w in own]
            is_whole = np.array([x is not None for x in whole])
            done.append(pa.array([[x] for x in whole if x is not None], pa.list_(pa.int32())))
            places.append(place[is_whole])
            toks = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.bytes[np.frombuffer(b"".join(own), np.uint8)]))
            place, toks = place[~is_whole], toks.filter(pa.array(~is_whole))
            while len(place):
                out = self._query(_ENCODE, place, toks)
                place, toks = out["word"].to_numpy(), out["toks"].combine_chunks()
                more = out["steps"].to_numpy() >= STEPS
                done.append(toks.filter(pa.array(~more)))
                places.append(place[~more])
                place, toks = place[more], toks.filter(pa.array(more))
        if not done:
            return pa.array([], pa.list_(pa.int32()))
        return pa.concat_arrays([x.cast(pa.list_(pa.int32())) for x in done]).take(pa.array(np.argsort(np.concatenate(places))))

    def joined(self, ids: pa.ListArray) -> list[bytes]:
        """The bytes of lists of token ids; an id that is not in the vocabulary is an error."""
        out = [b""] * len(ids)
        for at in range(0, len(ids), TOGETHER):
            own = ids.slice(at, TOGETHER)
            rows = self._query(_DECODE, np.arange(at, at + len(own)), own)
            if sum(rows["n"].to_pylist()) != len(own.flatten()):
                raise ValueError("a token id is not in the vocabulary")
            for word, data in zip(rows["word"].to_pylist(), rows["data"].to_pylist(), strict=True):
                out[word] = data
        return out

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def units(self, text: str) -> list[str]:
        """The text in parts that no pretoken crosses.

        Cut before every blank, comma, point and line end where all of them stand
        between words, else at every pretoken.
        """
        if not self.blanks or not is_plain(text):
            return self.pieces(text)
        text = text.replace(" ", "\0 ").replace(",", "\0,").replace(".", "\0.").replace("\n", "\0\n\0")
        return text.split("\0")

    def learn(self, units: set[str]) -> None:
        """Encode the units not remembered, and decode what came out."""
        if self.size > REMEMBERED:  # what is not used again until the next time is forgotten
            self.before, self.written, self.size = self.written, {}, 0
        new = []
        for unit in units.difference(self.written):
            if unit in self.before:
                self._keep(unit, self.before[unit])
            else:
                new.append(unit)
        cut = [self.pieces(u) for u in new]
        words = list(set().union(*cut))
        ids = self.merged([w.encode() for w in words])
        text = dict(zip(words, pa.compute.binary_join(ids.cast(pa.list_(pa.string())), " ").to_pylist(), strict=True))
        data = dict(zip(words, self.joined(ids), strict=True))
        for unit, own in zip(new, cut, strict=True):
            self._keep(unit, " ".join([text[w] for w in own]))
            back = b"".join([data[w] for w in own])
            if back != unit.encode():
                self.other[unit] = back

    def _keep(self, unit: str, written: str) -> None:
        self.written[unit] = written
        self.size += len(unit) + len(written) + ENTRY

    def round_trip(self, texts: list[str]):
        """For each text: decimal ids joined by blanks, and the bytes that the ids stand for."""
        at = 0
        while at < len(texts):
            cut, size = [], 0
            while at < len(texts) and size < TEXTS:
                cut.append(self.units(texts[at]))
                size, at = size + len(texts[at]), at + 1
            self.learn(set().union(*cut))
            written = self.written.__getitem__
            for own in cut:
                back = "".join(own).encode() if not self.other else b"".join([self.other.get(u) or u.encode() for u in own])
                yield " ".join(map(written, own)), back


def _texts(batch) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _apply(docs: DataFrame, path: str | None, columns: str, of) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def run(batches):
        codec = None
        try:
            for batch in batches:
                codec = codec or Codec(sent.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *of(codec, batch)], ["doc_id", *re.findall(r"(\w+) [a-z<>]+(?:,|$)", columns)])
        finally:
            if codec:
                codec.db.close()
                del codec
            give_back()

    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {columns}")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids: the token ids of every text; a null text is empty."""

    def of(codec, batch):
        ids = [list(map(int, w.split())) for w, _ in codec.round_trip(_texts(batch))]
        return [pa.array(ids, pa.list_(pa.int32()))]

    return _apply(docs.select("doc_id", "text"), path, "ids array<int>", of)


def decode_documents(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, data: the bytes of every row's ``ids``; null ids are none."""

    def of(codec, batch):
        return [pa.array(codec.joined(pa.array([x or [] for x in batch.column("ids").to_pylist()], pa.list_(pa.int32()))), pa.binary())]

    return _apply(rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids")), path, "data binary", of)


def encoding_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text.

    A null text is empty: no tokens, digests of nothing. Texts may be of any
    length; a pretoken of n bytes takes up to n steps. Repeated rows come out
    alike, other columns are ignored, an empty table gives no rows.
    """

    def of(codec, batch):
        n, ids, back = [], [], []
        for written, data in codec.round_trip(_texts(batch)):
            n.append(written.count(" ") + 1 if written else 0)
            ids.append(hashlib.sha256(written.encode()).hexdigest())
            back.append(hashlib.sha256(data).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]

    return _apply(docs.select("doc_id", "text"), path, "n_tokens long, ids_sha256 string, decoded_sha256 string", of)
