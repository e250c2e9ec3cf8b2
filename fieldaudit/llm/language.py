"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``DIMENSIONS`` signs, drawn from its code point.  Three letters in a row are bound
into one vector: the letter vectors, rotated by 2, 1 and 0 places, are multiplied.  The vectors of all three-letter
sequences of a text, word ends counting as a letter, are bundled (added) to the text's vector, and the texts of a
language, each at length one, to the language's prototype.  A text gets the language whose prototype has the largest
cosine with its own vector; the score is that cosine, 0 where it is negative.

Prototypes are learned from about ``LANGUAGE_ROWS`` rows a language (all rows of a rarer one), kept by a hash of their id, so
every language has its say however rare it is.  Sums are taken in integers: they don't depend on the order of tasks.
Their table of ``LANGUAGES`` rows at most goes to the workers; a column with more values is no language column and is refused.

Null texts and texts without letters are ``und`` with score 0, as is every text where nothing could be learned.  Null and
empty languages are not learned from.  Ties go to the first language by name.  Repeated rows give repeated results,
null ids are kept and never learned from, an empty table gives no rows, and other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, written
from .labelled import remainder

DIMENSIONS = 1024
LANGUAGE_ROWS, LANGUAGES = 10_000, 1_000
UNKNOWN = "und"
#: Texts bundled by one matrix product, and the partial sums of the prototypes.
TEXTS, PARTS = 64, 8
#: Sequences whose bound vectors a worker remembers (1 kB each).
CACHED = 24_000
_BITS, _UNIT = 21, 1 << 20


def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The random signs of a letter, the same on every machine."""
    bits = np.random.Philox(key=code).random_raw(-(-dimensions // 64))
    return np.unpackbits(bits.astype("<u8").view(np.uint8))[:dimensions].astype(np.int8) * 2 - 1


class Bundler:
    """Vectors of texts, with a bounded memory of bound sequences."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.letters: dict[int, np.ndarray] = {}
        self._forget()

    def _forget(self) -> None:
        self.place: dict[int, int] = {}
        self.bound = np.zeros((CACHED, self.dimensions), np.int8)

    def bind(self, code: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.int8)
        for turn in range(3):
            c = code >> _BITS * turn & (1 << _BITS) - 1
            if c not in self.letters:
                if len(self.letters) > 10_000:
                    self.letters = {}
                self.letters[c] = letter_vector(c, self.dimensions)
            out *= np.roll(self.letters[c], turn)
        return out

    def sequences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, code and count of the three-letter sequences of each text."""
        joined = "  ".join(["", *[t.lower() for t in texts], ""])
        owner = np.repeat(np.arange(len(texts)), [len(t.lower()) + 2 for t in texts])
        seen = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)[1:]
        seen = np.where(self.letter[seen], seen, 32)
        owner = np.append(owner, owner[-1:])[: len(seen)]
        keep = np.append(True, (seen[1:] != 32) | (seen[:-1] != 32))
        seen, owner = seen[keep], owner[keep]
        inner = np.flatnonzero(seen[1:-1] != 32) + 1
        code = (seen[inner - 1] << 2 * _BITS) | (seen[inner] << _BITS) | seen[inner + 1]
        names, at = np.unique(code, return_inverse=True)
        held, count = np.unique(owner[inner] * max(1, len(names)) + at, return_counts=True)
        text, at = np.divmod(held, max(1, len(names)))
        return text, names[at], count

    def vectors(self, texts: list[str]) -> np.ndarray:
        """One row per text: the sum of the vectors of its sequences (all zero without letters)."""
        text, code, count = self.sequences(texts)
        names, at = np.unique(code, return_inverse=True)
        out = np.zeros((len(texts), self.dimensions), np.float32)
        step = CACHED // 4
        for a in range(0, len(names), step):
            part = names[a : a + step].tolist()
            if len(self.place) + len(part) > CACHED:
                self._forget()
            for c in part:
                if c not in self.place:
                    self.bound[len(self.place)] = self.bind(c)
                    self.place[c] = len(self.place)
            counts = np.zeros((len(texts), len(part)), np.float32)
            own = (at >= a) & (at < a + step)
            counts[text[own], at[own] - a] = count[own]
            out += counts @ self.bound[[self.place[c] for c in part]].astype(np.float32)
        return out


_WORKER: list[Bundler] = []  # one per Python worker


def _unit_rows(batch, column: int):
    """Unit vectors of the texts of a batch, some texts at a time, with the first text's place."""
    if not _WORKER:
        _WORKER.append(Bundler())
    bundler = _WORKER[0]
    for a in range(0, batch.num_rows, TEXTS):
        texts = [t or "" for t in batch.column(column).slice(a, TEXTS).to_pylist()]
        rows = bundler.vectors(texts)
        yield a, rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-9)


class Profiles:
    """Prototypes of unit length, a row per language."""

    def __init__(self, names: list[str], sums: np.ndarray):
        order = sorted(range(len(names)), key=names.__getitem__)
        self.names = [names[i] for i in order]
        rows = np.asarray(sums, np.float64).reshape(len(names), DIMENSIONS)[order]
        self.rows = (rows / np.maximum(np.sqrt((rows * rows).sum(1, keepdims=True)), 1e-9)).astype(np.float32)

    def predict(self, batch, column: int) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for _, units in _unit_rows(batch, column):
            lettered = (units != 0).any(1)
            if not self.names:
                lettered[:] = False
            cosine = units @ self.rows.T if self.names else np.zeros((len(units), 1))
            best = cosine.argmax(1)
            names += [self.names[b] if on else UNKNOWN for b, on in zip(best.tolist(), lettered.tolist(), strict=True)]
            scores += np.where(lettered, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0).tolist()
        return names, scores


def fit(docs: DataFrame, mod: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = LANGUAGE_ROWS) -> Profiles:
    """Prototypes from rows whose checksum of the id leaves another remainder than ``held_out``."""
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.filter(F.col("doc_id").isNotNull() & (F.col("lang") != "") & (remainder("doc_id", mod) != held_out))
    size = known.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(size) > LANGUAGES:
        raise ValueError(f"{lang_col} has more than {LANGUAGES} values")
    if not size:
        return Profiles([], np.zeros(0))
    share = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, most / r["count"]) * _UNIT)) for r in size], "lang string, share long")
    sample = known.join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(_UNIT)) < F.col("share"))
    sample = written(sample.select("lang", "text").repartition(PARTS), "languages")

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for a, units in _unit_rows(batch, 1):
                langs = batch.column(0).slice(a, TEXTS).to_pylist()
                whole = np.rint(units * _UNIT).astype(np.int64)
                for lang in set(langs):
                    rows = whole[[x == lang for x in langs]].sum(0)
                    sums[lang] = sums[lang] + rows if lang in sums else rows
        for lang, rows in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([rows.tolist()])], ["lang", "rows"])

    parts = sample.mapInArrow(bundle, "lang string, rows array<long>").select("lang", F.posexplode("rows").alias("i", "v"))
    found = parts.groupBy("lang", "i").agg(F.sum("v").alias("v")).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("r")).select("lang", "r.v").collect()
    return Profiles([r["lang"] for r in found], np.array([r["v"] for r in found], np.float64))


def identify(docs: DataFrame, profiles: Profiles, mod: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` per row."""

    def predict(batches):
        for batch in text_slices(batches, 2, 1 << 20):
            names, scores = profiles.predict(batch, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(remainder("doc_id", mod) == held_out, F.lit(False)).alias("held_out")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("doc_id", held, "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
