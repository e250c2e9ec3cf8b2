"""Seeded randomness that does not depend on how rows are partitioned.

Every draw is a function of (seed, key), never of row order, so a lost executor or another
partition count reproduces the same sample.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 20260925  # fixed value: default seed of the published protocol
_SPAN = 4294967296.0  # 2**32


def digest(seed, *keys: Column) -> Column:
    parts = [F.lit(str(seed))] + [k.cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def hash32(seed, *keys: Column) -> Column:
    """An integer in [0, 2**32)."""
    return F.conv(F.substring(digest(seed, *keys), 1, 8), 16, 10).cast("long")


def uniform(seed, *keys: Column) -> Column:
    """A number in [0, 1)."""
    return hash32(seed, *keys) / F.lit(_SPAN)


def pick(n: Column, seed, *keys: Column) -> Column:
    """An index in [0, n)."""
    return F.pmod(hash32(seed, *keys), n)


_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = (np.abs(np.sin(np.arange(1, 65))) * _SPAN).astype(np.uint32)
_START = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _md5_first(words) -> np.ndarray:
    """The first word of the MD5 digests of one-block messages, given as 16 words (arrays or single numbers)."""
    a, b, c, d = (np.full(max(np.size(w) for w in words), v) for v in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += words[g]
        f += _SINES[i]
        turn = _TURNS[i // 16][i % 4]
        low = f >> np.uint32(32 - turn)
        f <<= np.uint32(turn)
        f |= low
        f += b
        a, b, c, d = d, f, b, c
    return a + _START[0]


def md5_heads(prefix: str, first: int, last: int) -> np.ndarray:
    """:func:`hash32` of ``prefix`` followed by each number from ``first`` to ``last - 1`` in decimal, in numpy."""
    head = prefix.encode()
    if len(head) + len(str(last)) > 55:  # more than one block
        return np.array([int(hashlib.md5(head + str(s).encode()).hexdigest()[:8], 16) for s in range(first, last)], np.int64)
    out, at = np.empty(max(last - first, 0), np.int64), first
    while at < last:
        digits = len(str(at))
        end = min(last, at + 16384, 10**digits)  # numbers of as many digits, few enough for the processor's cache
        size = len(head) + digits
        text = np.zeros((end - at, 64), np.uint8)
        text[:, :len(head)] = np.frombuffer(head, np.uint8)
        number = np.arange(at, end, dtype=np.int64)
        for i in range(size - 1, len(head) - 1, -1):
            number, text[:, i] = number // 10, number % 10 + 48
        text[:, size] = 128
        text[:, 56:58] = (8 * size % 256, 8 * size // 256)
        words = text.view("<u4")
        varied = range(len(head) // 4, (size - 1) // 4 + 1)
        found = _md5_first([np.ascontiguousarray(words[:, i]) if i in varied else words[0, i] for i in range(16)])
        out[at - first:end - first] = found.byteswap()  # the digest shows the lowest byte first
        at = end
    return out
