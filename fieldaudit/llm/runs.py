"""Periodic runs of words: a suffix automaton whose link tree is read by link-cut access.

A text is a sequence of words ``[^\\x20\\x09-\\x0D]+``.  A run is a stretch of words with smallest period q and at least
``max(least, 2 q)`` words which no neighbouring word extends; runs are what a text repeats back to back.

The automaton of a sequence grows word by word.  The nodes on the link path of a prefix stand for its suffixes, and
each carries the last end at which its suffixes were seen.  Appending a word asks for the path of the new prefix
(*access*): the path comes back as segments of one last end each and takes the new end as its colour.  In a segment
of suffix lengths (lo, hi] with last end e, at a distance d = i - e, a square of the primitive period d ends at
the new word i if and only if lo < d <= hi; its period reaches back to word i - d - hi + 1.  A run shows the same
first word and period at each of its ends, so the last of them is the run's end.  Access recolours O(n log n)
segments in all, also for a text of one repeated word.

A run of ``least`` words or more holds at least ceil(least / 2) words whose copy stands q words on, so all its words
lie in windows of that many words which occur twice in the text.  Only stretches of such windows are given to
the automaton; no run reaches beyond its stretch.  A stretch takes about 1 kB of memory a word while it is read.

Null, empty and blank texts have no words and no runs.  Repeated rows give repeated results, null ids are kept, an empty
table gives no rows, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: A run holds this many words at least.
LEAST = 12
RUNS_SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def split_words(text: str | None) -> list[str]:
    return _WORD.findall(text) if text else []


class LinkedAutomaton:
    """A suffix automaton over words; its link tree is a forest of splay trees, one per path of equal last end."""

    def __init__(self):
        self.step: list[dict] = [{}, {}]  # state 0 is no state, state 1 the empty suffix
        self.link, self.longest = [0, 0], [0, 0]
        self.left, self.right, self.up, self.seen = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.whole, self.words = 1, 0

    def _state(self, longest: int, link: int, step: dict) -> int:
        for column, value in ((self.step, step), (self.link, link), (self.longest, longest), (self.left, 0), (self.right, 0), (self.up, link), (self.seen, -1)):
            column.append(value)
        return len(self.link) - 1

    def _splay(self, x: int) -> None:
        """Make ``x`` the root of its splay tree; the colour of a tree is kept at its root."""
        left, right, up = self.left, self.right, self.up
        root = x
        while (p := up[root]) and (left[p] == root or right[p] == root):
            root = p
        self.seen[x] = self.seen[root]
        while x != root:
            p = up[x]
            g = up[p]
            if p != root:
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)
            if root in (p, g):
                return

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            c = left[p] = right[x]
            right[x] = p
        else:
            c = right[p] = left[x]
            left[x] = p
        if c:
            up[c] = p
        up[p], up[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def _insert_above(self, q: int, clone: int) -> None:
        """``clone`` joins the path of ``q`` as its parent: it has been seen where ``q`` was."""
        self._splay(q)
        self.left[clone], self.left[q] = self.left[q], clone
        if self.left[clone]:
            self.up[self.left[clone]] = clone
        self.up[clone] = q

    def append(self, word) -> list[tuple[int, int]]:
        """``(period, first word that has it)`` of every primitive square that ends at the new word."""
        step, link, longest = self.step, self.link, self.longest
        i, p = self.words, self.whole
        cur = self._state(i + 1, 0, {})
        while p and word not in step[p]:
            step[p][word] = cur
            p = link[p]
        if not p:
            link[cur] = 1
        else:
            q = step[p][word]
            if longest[q] != longest[p] + 1:
                clone = self._state(longest[p] + 1, link[q], dict(step[q]))
                self._insert_above(q, clone)
                link[q] = clone
                while p and step[p].get(word) == q:
                    step[p][word] = clone
                    p = link[p]
                q = clone
            link[cur] = q
        self.up[cur] = link[cur]
        self.whole, self.words = cur, i + 1
        return self._access(cur, i)

    def _access(self, x: int, end: int) -> list[tuple[int, int]]:
        squares = []
        up, right, longest, seen = self.up, self.right, self.longest, self.seen
        below, y = 0, x
        while y:
            self._splay(y)
            if right[y]:
                seen[right[y]] = seen[y]  # what hangs below keeps its last end
            right[y] = below
            if below and seen[y] >= 0:
                hi, d = longest[y], end - seen[y]
                if longest[up[y]] < d <= hi:
                    squares.append((d, end - d - hi + 1))
            below, y = y, up[y]
        seen[below] = end
        return squares


def squares_to_runs(words: list, least: int) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a sequence."""
    ends: dict[tuple[int, int], int] = {}
    automaton = LinkedAutomaton()
    for i, w in enumerate(words):
        for d, first in automaton.append(w):
            ends[first, d] = i
    return [(s, e - s + 1, q) for (s, q), e in ends.items() if e - s + 1 >= max(least, 2 * q)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def repeated_stretches(codes: np.ndarray, owner: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end positions of the maximal stretches of windows that occur at least twice in their owner.

    ``codes`` are unsigned 64-bit words' hashes in order, ``owner`` the ascending number of each word's text.  Equal
    hashes of different windows only make a stretch longer.
    """
    n = len(codes)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = n - window + 1
    h = _mix(owner[:m].astype(np.uint64) + np.uint64(1))
    for k in range(window):
        h = _mix(h + codes[k : k + m])
    whole = owner[:m] == owner[window - 1 :]
    at = np.flatnonzero(whole)
    order = at[np.argsort(h[at], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    change = np.zeros(n + 1, np.int64)
    hits = order[twice]
    np.add.at(change, hits, 1)
    np.add.at(change, hits + window, -1)
    live = np.cumsum(change[:n]) > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], live, [False]]).astype(np.int8)))
    first, end = edge[::2], edge[1::2]
    # a stretch that goes on into the next text is cut there
    inner = np.flatnonzero(live[1:] & live[:-1] & (owner[1:] != owner[:-1])) + 1
    return np.sort(np.concatenate([first, inner])), np.sort(np.concatenate([end, inner]))


def runs_of(sequences: list[list], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of every sequence of words, by start, then period."""
    sizes = [len(s) for s in sequences]
    n = sum(sizes)
    codes = np.fromiter((hash(w) for s in sequences for w in s), np.int64, n).view(np.uint64)
    owner = np.repeat(np.arange(len(sequences)), sizes)
    base = np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    first, end = repeated_stretches(codes, owner, max(1, -(-least // 2)))
    for a, b in zip(first.tolist(), end.tolist(), strict=True):
        if b - a >= least:
            k = int(owner[a])
            a, b = a - int(base[k]), b - int(base[k])
            out[k] += [(s + a, length, q) for s, length, q in squares_to_runs(sequences[k][a:b], least)]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words, each run cut down to its first period, joined by one space."""
    gone = bytearray(len(words))
    for s, length, q in runs:
        gone[s + q : s + length] = b"\1" * (length - q)
    return " ".join([w for w, g in zip(words, gone, strict=True) if not g])


def find_runs(docs: DataFrame, least: int = LEAST, prepare=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` per row; ``prepare(doc_id, words)`` may change the words before."""

    def read(batches):
        for batch in text_slices(batches, 1, 1 << 20):
            ids = batch.column(0).to_pylist()
            words = [split_words(t) for t in batch.column(1).to_pylist()]
            if prepare:
                words = [prepare(i, w) for i, w in zip(ids, words, strict=True)]
            runs = runs_of(words, least)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, words), pa.int64()), pa.array(rows, kind), pa.array(map(collapsed, words, runs), pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(read, f"doc_id long, {RUNS_SCHEMA}")


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The words, periodic from some place on where the checksum of the id is a multiple of ten (null ids: unchanged)."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def digests(found: DataFrame) -> DataFrame:
    """Count, longest run and checksums of what :func:`find_runs` returns."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.withColumn("_b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_b.start")).alias("start"), F.col("_b.length").alias("length"), (-F.col("_b.period")).alias("period"),
        F.expr("(1000 * _b.length) div (-_b.period)").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
