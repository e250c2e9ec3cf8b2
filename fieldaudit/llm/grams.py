"""Words of many texts at once: 64-bit hashes of byte runs, from prefix sums over an Arrow buffer.

A word is a run of bytes that are no separators; its hash is a polynomial in an odd base modulo 2**64, taken
from prefix sums and then mixed.  Upper-case ASCII letters count as lower case.  Memory is a few times the
bytes of the batch, so callers pass slices of a few MB.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Separators: white space as \x20 and \x09-\x0D; or all ASCII that is no letter or digit.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int, cache: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    have = cache.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        cache[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


@dataclass
class Words:
    """``start``, ``end``: byte spans; ``hash``; ``at``: offsets of each text's words; ``bytes`` lower case; ``text_at``."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    at: np.ndarray
    bytes: np.ndarray
    raw: np.ndarray
    text_at: np.ndarray
    _sums: np.ndarray

    def prefix(self, n: int) -> np.ndarray:
        """Hashes of the first ``n`` bytes of every word."""
        return self._spans(self.start, np.minimum(self.end, self.start + n))

    def _spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inverse = _powers(_INVERSE, len(self.bytes) + 1)
        return mix((self._sums[end] - self._sums[start]) * inverse[start] + (end - start).astype(np.uint64))

    def owner(self) -> np.ndarray:
        """The text of every word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def words(texts: pa.Array, separators: np.ndarray = SPACE) -> Words:
    """The words of an array of texts; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0] if len(at) else np.zeros(1, np.int64)
    lower = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw).astype(np.uint8)
    gap = np.append(separators[raw], True)
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.append(True, gap[:-1])
    start = np.flatnonzero(~gap & (before | edge))
    after = np.append(gap[1:], True)[:-1] | edge[1:] if len(raw) else np.zeros(0, bool)
    end = np.flatnonzero(~gap[:-1] & after) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw)), out=sums[1:], dtype=np.uint64)
    found = Words(start, end, start, np.searchsorted(start, at), lower, raw, at, sums)
    found.hash = found._spans(start, end)
    return found


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` words in a row and the offsets of each text; a text of fewer words is one shingle, none without words."""
    count = np.diff(w.at)
    many = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    at = np.append(0, np.cumsum(many))
    first = np.repeat(w.at[:-1] - at[:-1], many) + np.arange(at[-1])
    last = np.repeat(w.at[1:], many)
    out = np.zeros(len(first), np.uint64)
    padded = np.append(w.hash, np.zeros(n, np.uint64))
    for i in range(n):
        here = first + i
        out = mix(out + np.where(here < last, padded[np.minimum(here, len(padded) - 1)], np.uint64(0)) + np.uint64(i + 1))
    return out, at


def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over the spans between the offsets ``at``."""
    sums = np.append(0, np.cumsum(flags))
    return sums[at[1:]] - sums[at[:-1]]
