"""URL filter over a sorted array of digests.

A rule is a host and the beginning of a path. Its string (``example.net/en/``)
is hashed to 64 bits; the sorted digests, the full strings and the verdicts make
one file that every Python worker maps into memory. A batch of URLs is probed
with one binary search over all its candidates (host suffixes at label borders,
times the path lengths that occur in the rules), and each hit is confirmed
against the stored string, so colliding digests do no harm.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

#: The file is sent to every worker, so its size is bounded.
MAX_BYTES = 256 << 20

#: (host, beginning of the path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Hosts known for junk, blocked where no rule fits.
BLOCKLIST = ("adult-x.example.com", "ads-track.example.com", "casino-win.example.net", "cheap-pills.example.net",
             "free-bets.example.net", "spam-farm.example.org")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text)


def build_index(rules: Iterable[tuple[str, str, str]], hashed=digest) -> bytes:
    """The file: counts, digests in order, ends of the strings, path lengths, verdicts, strings."""
    rows = sorted({(hashed((h + p).encode()), (h + p).encode(), len(p), v) for h, p, v in rules})
    text = b"".join(x[1] for x in rows)
    parts = [
        np.array([len(rows), len(text)], "<u8"), np.array([x[0] for x in rows], "<u8"), np.cumsum([len(x[1]) for x in rows], dtype="<u8"),
        np.array([x[2] for x in rows], "<u8"), np.array([x[3] == "block" for x in rows], "<u8"),
    ]
    out = b"".join(x.tobytes() for x in parts) + text
    if len(out) > MAX_BYTES:
        raise ValueError(f"the rules take {len(out)} bytes; the bound is {MAX_BYTES}")
    return out


class DigestIndex:
    """A mapped file of rules."""

    def __init__(self, path: str, hashed=digest):
        n, size = (int(x) for x in np.fromfile(path, "<u8", 2))
        column = lambda k: np.memmap(path, "<u8", "r", 16 + 8 * n * k, (n,)) if n else np.empty(0, "<u8")
        self.keys, self.ends, self.path_chars, self.block = (column(k) for k in range(4))
        self.text = np.memmap(path, np.uint8, "r", 16 + 32 * n, (size,)) if size else np.empty(0, np.uint8)
        self.lengths = sorted({int(x) for x in self.path_chars})
        self.hashed = hashed

    def string(self, k: int) -> bytes:
        return self.text[int(self.ends[k - 1]) if k else 0:int(self.ends[k])].tobytes()

    def candidates(self, host: str, path: str) -> list[bytes]:
        if not host:
            return []
        labels = host.split(".")
        tails = [".".join(labels[k:]) for k in range(len(labels))]
        starts = [path[:n] for n in self.lengths if n <= len(path)]
        return [(t + s).encode() for t in tails for s in starts]

    def find(self, urls: list[tuple[str, str]]) -> list[tuple[str, bool] | None]:
        """The longest rule that fits each (host, path): its string and whether it blocks."""
        wanted = [self.candidates(*u) for u in urls]
        flat = list({c for own in wanted for c in own})
        probes = np.fromiter((self.hashed(c) for c in flat), "<u8", len(flat))
        at = np.searchsorted(self.keys, probes)
        near = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == probes) if len(self.keys) else []
        hits = {}
        for k in near:
            row = int(at[k])
            while row < len(self.keys) and self.keys[row] == probes[k]:
                if self.string(row) == flat[k]:
                    hits[flat[k]] = bool(self.block[row])
                row += 1
        best = [max((c for c in own if c in hits), key=len, default=None) for own in wanted]
        return [None if c is None else (c.decode(), hits[c]) for c in best]


_open: dict[str, DigestIndex] = {}


def open_index(data: bytes) -> DigestIndex:
    """Map an index file in this worker's own folder; a new worker writes it anew."""
    name = hashlib.sha256(data).hexdigest()
    if name not in _open:
        path = os.path.join(tempfile.mkdtemp(prefix="spark-urls-"), "index")
        with open(path, "wb") as f:
            f.write(data)
        _open[name] = DigestIndex(path)
    return _open[name]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(after, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def filter_urls(pages: DataFrame, rules=RULES, blocklist=BLOCKLIST) -> DataFrame:
    """page_id, host, path, rule, verdict of every url.

    A rule fits its host and all subdomains when the path starts with the rule's;
    the longest one decides. Elsewhere the block list does: a listed host and its
    subdomains are blocked, all else is allowed. A null url, or one without
    ``://``, has an empty host and path and is allowed. Repeated rows are judged
    alike, other columns are ignored, an empty table gives no rows.
    """
    spark = pages.sparkSession
    sent = spark.sparkContext.broadcast((build_index(rules), build_index((h, "", "block") for h in blocklist)))

    def judge(batches):
        by_rule, by_list = (open_index(x) for x in sent.value)
        for batch in batches:
            urls = list(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True))
            ruled, listed = by_rule.find(urls), by_list.find(urls)
            rule = [r and r[0] for r in ruled]
            verdict = ["block" if (r or s or ("", False))[1] else "allow" for r, s in zip(ruled, listed, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("page_id", "host", "path")] + [pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    return rows.mapInArrow(judge, f"page_id {dict(rows.dtypes)['page_id']}, host string, path string, rule string, verdict string")
