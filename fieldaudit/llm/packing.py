"""Packing: cost-balanced sequences of at most ``capacity`` tokens, without padding.

Each text is encoded, closed with an end id and cut into full sequences plus one rest.  Rests are dealt by
hash into groups of a bounded number of tokens; in each group they go, longest first, to the sequence of the
lowest estimated attention cost that still has room for them.  The cost of a piece of n tokens is
``linear * n + quadratic * n * n``, since documents in a sequence don't attend to each other.  A rest that
fits nowhere whole is cut over the cheapest open sequences.  A group opens as many full sequences as its
tokens fill; what is left over goes to sequences of power-of-two capacity, which need no padding either.

Null and empty texts are the end id alone.  Rows with equal ids are packed as separate documents.  Ties in
length are broken by id, start and content, ties in cost by the sequence's number.  An empty table gives no rows.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, text_slices
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
_CUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
#: UTF-8 bytes of text per group: bounds what one task packs together.
GROUP_BYTES = 16 << 20
#: UTF-8 bytes of text that are encoded at once; fewer take less memory and more time.
SLICE_BYTES = 5 << 20


def cut_documents(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The full pieces of every document (without their ids) and its rest (with them)."""

    def cut(batches):
        enc = encoder(path)
        end = np.uint32(end_id).tobytes()
        for batch in text_slices(batches, 1, slice_bytes):
            ids, at = enc.encode(batch.column(1))
            raw, at = ids.tobytes(), at.tolist()
            rows: list[tuple] = []
            for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                own = raw[4 * a : 4 * b] + end
                n = len(own) // 4
                for s in range(0, n, capacity):
                    piece = own[4 * s : 4 * (s + capacity)]
                    full = len(piece) == 4 * capacity
                    rows.append((doc, s, len(piece) // 4, zlib.crc32(piece), n, None if full else piece))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 5 + [pa.binary()], strict=True)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(giving_back(cut), _CUT)


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[float]]:
    """Lengths in descending order -> pieces (item, start in the item, length, sequence, offset) and sequence costs."""
    total = sum(lengths)
    room = np.array([capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> b & 1], np.int64)
    filled, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    out = []
    for item, n in enumerate(lengths):
        start = 0
        while n:
            fits = room >= n
            if not fits.any():
                fits = room > 0
            s = int(np.argmin(np.where(fits, cost, np.inf)))
            k = min(n, int(room[s]))
            out.append((item, start, k, s, int(filled[s])))
            room[s] -= k
            filled[s] += k
            cost[s] += linear * k + quadratic * k * k
            start, n = start + k, n - k
    return out, cost.tolist()


def pack(
    docs: DataFrame, path: str, end_id: int = 0, capacity: int = 1024, linear: float = 1.0, quadratic: float = 1 / 1024,
    id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One row per piece: document, start in it, length, checksum of its ids, sequence, offset there, sequence cost."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("b"), F.count(F.lit(1)).alias("n")).first()
    groups = int(max(1, -(-((size["b"] or 0) + size["n"]) // GROUP_BYTES)))

    def deal(key, part):
        rows = part.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]).to_pylist()
        first = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["start"], r["ids_crc32"], r["doc_tokens"])
        full = sorted((r for r in rows if r["ids"] is None), key=first)
        rest = sorted((r for r in rows if r["ids"] is not None), key=lambda r: (-r["length"], *first(r)))
        base = key[0].as_py() << 32
        whole = linear * capacity + quadratic * capacity * capacity
        out = [(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], base + i, 0, whole) for i, r in enumerate(full)]
        pieces, cost = assign([r["length"] for r in rest], capacity, linear, quadratic)
        for item, start, n, s, offset in pieces:
            r = rest[item]
            crc = zlib.crc32(r["ids"][4 * start : 4 * (start + n)])
            out.append((r["doc_id"], r["start"] + start, n, crc, r["doc_tokens"], base + len(full) + s, offset, cost[s]))
        return pa.table(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 7 + [pa.float64()], strict=True)],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"])

    cut = cut_documents(docs, path, end_id, capacity, id_col, text_col, slice_bytes)
    dealt = cut.withColumn("_g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("_g").applyInArrow(deal, SCHEMA)
