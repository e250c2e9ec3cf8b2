"""Alignment of two tokenizers over the same bytes: divide and conquer at shared cuts.

Both tokenizations of a text are sequences of byte ends.  An interval of tokens is cut at an end that both sides share:
the places next to the interval's middle are tried in turn, each by bisection in the other side's ends, and both
halves are cut in the same way.  An interval without a shared end inside is a leaf, a group of tokens that
correspond only as a whole.  All intervals of a slice of texts advance together, one numpy step for each.

Two tokens are linked where their byte ranges overlap.  How many documents hold a pair of ids linked is counted over the
whole corpus: tasks write their texts' links as places in a list of distinct pairs per slice of texts, so what is
shuffled is a row per slice and pair, not per link; the counts come back to the slices the same way.  No table
is broadcast, no task holds more than a slice or a single text.

Side A reads a space and the text, side B the text, to which it adds that space itself.  Strings of special tokens are plain text.
Null and empty texts, and texts whose joined token bytes differ from the space and the text on either side, have no tokens:
all counts are 0 and ``groups`` is empty.  Repeated rows count as documents of their own, null ids are kept, an empty table
gives no rows, and other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, written

#: UTF-8 bytes of text per slice: what is linked together, and how far pairs are merged before a shuffle.
SLICE_BYTES = 2 << 20
#: Pieces of text in each of the two generations that a worker remembers, and how long such a piece may be.
CACHE_PIECES, LONG_PIECE = 150_000, 100
#: A word with the white space before it; marks behind letters are pieces of their own.
_PIECE = re.compile(r"[ \n]*[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[.,!?;:])|[ \n]*[^ \n]+|[ \n]+")
#: Texts with other white space, or controls that some rules take for white space, are not cut into pieces.
_ODD = "[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}\\x{3000}\\x{feff}\\x{0}]"

_WORKER: dict[tuple[str, str], "Pair"] = {}


class Side:
    """One tokenizer: ids of pieces of text, and the bytes of every id."""

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """Ids of whole texts with the space in front, or of pieces of them."""
        raise NotImplementedError

    def _table(self, tokens: list[bytes]) -> None:
        self.bytes = pa.array(tokens, pa.large_binary())
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))


def byte_symbols() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the rest follow from 256 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and b != 32]
    other = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(other)}}


class ByteLevel(Side):
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab, symbol = self.tokenizer.get_vocab(with_added_tokens=True), byte_symbols()
        tokens = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            tokens[i] = bytes(symbol[c] for c in t) if all(c in symbol for c in t) else t.encode()
        self._table(tokens)
        self.cuts = True  # its pattern never lets a piece go on from other text to white space

    def encode(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


class Pieces(Side):
    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = [int(p[3:5], 16) if self.model.is_byte(i) else None for i, p in enumerate(names)]
        self._table([p.replace("▁", " ").encode() if b is None else bytes([b]) for p, b in zip(names, byte, strict=True)])
        self.blank = self.model.encode("\n")
        # no merge may cross a cut before a space, a line end or a mark behind a letter, nor hold a line end
        self.cuts = len(self.blank) == 2 and not any(re.search("[^▁ ][▁ ]|\n|[A-Za-zÀ-ÖØ-öø-ÿ][.,!?;:]", p) for p in names)

    def encode(self, pieces: list[str]) -> list[list[int]]:
        """The model adds a space: it replaces a leading one; before other pieces it stands apart, behind a line end."""
        found = self.model.encode([p[1:] if p[:1] == " " else "\n" + p for p in pieces], num_threads=1)
        for i, p in enumerate(pieces):
            if p[:1] != " ":
                found[i] = found[i][2:]
            elif len(p) == 1:
                found[i] = self.blank[:1]  # a lone space: the model adds none to an empty text
        return found


class Pair:
    """Both sides of a worker, with a bounded memory of pieces."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    @classmethod
    def of(cls, a: str, b: str) -> "Pair":
        if (a, b) not in _WORKER:
            _WORKER[a, b] = cls(a, b)
        return _WORKER[a, b]

    def _look(self, pieces: list[str]) -> list[tuple[bytes, bytes]]:
        if len(self.known) > CACHE_PIECES:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        found = [known.get(p) or older.get(p) for p in pieces]
        new = [p for p, v in zip(pieces, found, strict=True) if v is None]
        fresh = iter(zip(*([array("I", x).tobytes() for x in side.encode(new)] for side in (self.a, self.b)), strict=True))
        found = [v or next(fresh) for v in found]
        known.update((p, v) for p, v in zip(pieces, found, strict=True) if len(p) <= LONG_PIECE)
        return found

    def encode(self, texts: pa.Array) -> tuple["Tokens", "Tokens", np.ndarray]:
        """Both sides' tokens of an array of texts (null: empty), and which texts they cover exactly."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        spaced = pc.binary_replace_slice(texts.cast(pa.large_binary()), 0, 0, b" ")
        whole = np.asarray(pc.match_substring_regex(texts, _ODD)) | (not (self.a.cuts and self.b.cuts))
        pieces, count = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(spaced.cast(pa.large_string()).to_pylist()):
            own = [t] if whole[i] else _PIECE.findall(t)
            pieces += own
            count[i] = len(own)
        distinct = pa.array(pieces, pa.large_string()).dictionary_encode()
        codes = distinct.indices.to_numpy(zero_copy_only=False)
        known = self._look(distinct.dictionary.to_pylist())
        a, b = (Tokens.of(side, [k[s] for k in known], codes, count) for s, side in enumerate((self.a, self.b)))
        full = np.asarray(pc.binary_length(texts)) > 0
        return a, b, full & a.spell(spaced) & b.spell(spaced)


class Tokens:
    """Ids of a slice of texts in a row; text k holds those from ``at[k]`` to ``at[k + 1]``."""

    def __init__(self, side: Side, ids: np.ndarray, at: np.ndarray):
        self.side, self.ids, self.at = side, ids, at

    @classmethod
    def of(cls, side: Side, known: list[bytes], codes: np.ndarray, count: np.ndarray) -> "Tokens":
        lens = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), "<u4").astype(np.int64)
        size = lens[codes]
        ends = np.append(0, np.cumsum(size))
        ids = flat[np.repeat((np.cumsum(lens) - lens)[codes] - ends[:-1], size) + np.arange(ends[-1])]
        return cls(side, ids, ends[np.append(0, np.cumsum(count))])

    def spell(self, texts: pa.Array) -> np.ndarray:
        """Which texts equal the joined bytes of their tokens."""
        lists = pa.LargeListArray.from_arrays(pa.array(self.at), self.side.bytes.take(pa.array(self.ids)))
        return np.asarray(pc.equal(pc.binary_join(lists, pa.scalar(b"", pa.large_binary())), texts))

    def keep(self, texts: np.ndarray) -> "Tokens":
        n = np.diff(self.at)
        return Tokens(self.side, self.ids[np.repeat(texts, n)], np.append(0, np.cumsum(np.where(texts, n, 0))))

    def ends(self) -> np.ndarray:
        return np.cumsum(self.side.size[self.ids])


def shared_cuts(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray, b_first: np.ndarray, b_last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of all ends that both share, inside intervals that end at a shared end.

    An interval holds the tokens ``first`` to ``last`` of ``a`` and ``b_first`` to ``b_last`` of ``b``.
    """
    cuts_a, cuts_b = [last], [b_last]
    tries = np.zeros(len(first), np.int64)
    while len(first):
        # places before the last one, outward from the middle: 0, 1, -1, 2, -2, ...
        off = np.where(tries & 1, (tries + 1) >> 1, -(tries >> 1))
        place = ((first + last - 1) >> 1) + off
        done = (b_first == b_last) | (tries > last - first)
        inside = (place >= first) & (place < last) & ~done
        j = np.searchsorted(b, a[place * inside])
        hit = inside & (b[j] == a[place * inside])
        m, mb = place[hit], j[hit]
        cuts_a.append(m)
        cuts_b.append(mb)
        on = ~hit & ~done
        first, last, b_first, b_last, tries = (
            np.concatenate(x) for x in (
                (first[on], first[hit], m + 1), (last[on], m, last[hit]), (b_first[on], b_first[hit], mb + 1),
                (b_last[on], mb, b_last[hit]), (tries[on] + 1, np.zeros(2 * len(m), np.int64))))
        more = first < last
        if not more.all():
            first, last, b_first, b_last, tries = (x[more] for x in (first, last, b_first, b_last, tries))
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of all pairs of tokens whose bytes overlap; both end at the same byte."""
    marks = np.zeros((2, int(a[-1]) + 1 if len(a) else 0), np.int32)
    marks[0, a], marks[1, b] = 1, 1
    both = np.flatnonzero(marks[0] | marks[1])
    return tuple((np.cumsum(m) - m)[both] for m in marks)


@functools.cache
def _decimals(most: int) -> pa.Array:
    return pa.array([f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(most)], pa.large_string())


def written_groups(a: Tokens, b: Tokens, cut_a: np.ndarray, cut_b: np.ndarray) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` per text: decimal ids, groups apart by semicolons."""
    n_a, n_b = len(a.ids), len(b.ids)
    most = max(len(a.side.size), len(b.side.size))
    marked = _decimals(most)
    end_a, end_b = np.zeros(n_a, bool), np.zeros(n_b, bool)
    end_a[cut_a], end_b[cut_b] = True, True
    # ids of a go behind all of b in earlier groups, ids of b behind all of a up to their own group
    group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
    code = np.empty(n_a + n_b, np.int64)
    code[np.arange(n_a) + np.append(0, cut_b + 1)[group_a]] = a.ids + most * end_a
    mark_b = np.where(end_b, 2, 0)
    mark_b[b.at[1:][np.diff(b.at) > 0] - 1] = 3  # nothing follows the last group of a text
    code[np.arange(n_b) + (cut_a + 1)[group_b]] = b.ids + most * mark_b
    lists = pa.LargeListArray.from_arrays(pa.array(a.at + b.at), marked.take(pa.array(code)))
    return pc.binary_join(lists, pa.scalar("", pa.large_string()))


_STORED = (
    "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, at array<int>, times array<int>, "
    "place int, pair long, docs int")


def link_slices(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """A row per text with the places of its distinct pairs, and a row per slice and pair with the texts that hold it."""

    def link(batches):
        pair, part, k = Pair.of(path_a, path_b), TaskContext.get().partitionId() << 32, 0
        for batch in text_slices(batches, 1, SLICE_BYTES):
            a, b, ok = pair.encode(batch.column(1))
            a, b = a.keep(ok), b.keep(ok)
            ends_a, ends_b = a.ends(), b.ends()
            full = np.diff(a.at) > 0
            cut_a, cut_b = shared_cuts(ends_a, ends_b, a.at[:-1][full], a.at[1:][full] - 1, b.at[:-1][full], b.at[1:][full] - 1)
            n_groups = np.diff(np.searchsorted(cut_a, a.at))
            # every end of either side closes one overlap
            in_a, in_b = overlaps(ends_a, ends_b)
            text = np.searchsorted(a.at, in_a, "right") - 1
            pairs, place = np.unique(a.ids[in_a] << 32 | b.ids[in_b], return_inverse=True)
            held, times = np.unique(text * max(1, len(pairs)) + place, return_counts=True)
            holder, place = np.divmod(held, max(1, len(pairs)))
            at = pa.array(np.searchsorted(holder, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (place, times)]
            counts = [np.diff(a.at), np.diff(b.at), n_groups, np.bincount(text, minlength=batch.num_rows)]
            n, m, schema = batch.num_rows, len(pairs), pa.schema(_ARROW)
            of = pa.array(np.full(max(n, m), part + k))
            none = lambda size, names: [pa.nulls(size, schema.field(c).type) for c in names]
            groups = written_groups(a, b, cut_a, cut_b).cast(pa.string())
            yield pa.RecordBatch.from_arrays([of[:n], batch.column(0), *map(pa.array, counts), groups, *lists, *none(n, ("place", "pair", "docs"))], schema=schema)
            if m:
                yield pa.RecordBatch.from_arrays(
                    [of[:m], *none(m, schema.names[1:9]), pa.array(np.arange(m), pa.int32()), pa.array(pairs), pa.array(np.bincount(place, minlength=m), pa.int32())],
                    schema=schema)
            k += 1

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(link, _STORED)


_ARROW = [
    ("slice", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups", pa.string()), ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("place", pa.int32()), ("pair", pa.int64()), ("docs", pa.int32())]


def pair_counts(linked: DataFrame) -> DataFrame:
    """``(pair, a, b, count, best)`` of all pairs: in how many documents they are linked, and whether that is the most of the a."""
    pairs = linked.filter("pair IS NOT NULL").groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.shiftright("pair", 32))
    top = pairs.groupBy("a").agg(F.max("count").alias("_top"))
    return pairs.join(top, "a").select("pair", "a", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "count", (F.col("count") == F.col("_top")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)`` per row; ``digest`` keeps the groups' SHA-256 only."""
    linked = link_slices(docs, path_a, path_b, id_col, text_col)
    if digest:
        linked = linked.withColumn("groups", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    linked = written(linked, "align")
    pairs = linked.filter("pair IS NOT NULL")
    back = pairs.select(F.col("slice").alias("_slice"), "place", "pair").join(pair_counts(linked).select("pair", "count", "best"), "pair").drop("pair")

    def add(key, texts, counts):
        n = counts.num_rows
        count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        where = np.asarray(counts.column("place"))
        count[where], best[where] = np.asarray(counts.column("count")), np.asarray(counts.column("best")).astype(np.int64)
        texts = texts.combine_chunks()
        sums = []
        for value in (best, count):
            at, times = (texts.column(c).combine_chunks() for c in ("at", "times"))
            run = np.append(0, np.cumsum(value[np.asarray(at.values)] * np.asarray(times.values)))
            offset = np.asarray(at.offsets)
            sums.append(pa.array(run[offset[1:]] - run[offset[:-1]]))
        named = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*[texts.column(c) for c in named], *sums, texts.column("groups")], names=[*named, "n_best", "count_sum", "groups"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    texts = linked.filter("pair IS NULL").drop("place", "pair", "docs")
    return texts.groupBy("slice").cogroup(back.groupBy("_slice")).applyInArrow(add, schema)
