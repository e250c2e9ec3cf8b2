"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Whole texts become some thirty statistics (lengths, shares of character kinds, repetition of words, word pairs
and lines).  Random Fourier features of the standardised statistics approximate a Gaussian kernel; every
partition sums its normal equations, the sums are added and solved with a ridge.  Rows kept out of the solution
calibrate its scores with an isotonic step function.

Null and empty texts are scored from their all-zero statistics.  Repeated rows are scored alike.  Without labelled
rows of both classes every score is the share of label 1 (0.5 without labels).  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import SPACE, mix, per_text, words
from .labelled import remainder, training_rows, with_score

FEATURES, RIDGE, SEED, PARTITIONS, BINS = 256, 1e-2, 11, 8, 400
_KINDS = ["!", "*", "%", "&", "$", "#", "|", ".", ",", "?", ";:", "()[]{}", "<>/\\", "=_~^`", "@", "'\"-"]
_SHARES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "\n", " \t\r\x0b\x0c"]
#: The kind of every byte, counted from 1; 0 for the rest and one more for bytes outside ASCII.
_KIND = np.zeros(256, np.uint8)
for _i, _k in enumerate(_KINDS + _SHARES):
    _KIND[[ord(c) for c in _k]] = _i + 1
_KIND[128:] = len(_KINDS) + len(_SHARES) + 1


def _repeats(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: the number of distinct values and how often its most frequent one occurs."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(new)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, o[first], np.diff(np.append(first, len(v))))
    return np.bincount(o[first], minlength=n), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text; nulls count as empty."""
    w = words(texts, SPACE)
    n = np.diff(w.text_at).astype(float)
    raw, one = w.raw, np.maximum(n, 1)
    count = np.diff(w.at).astype(float)
    some = np.maximum(count, 1)
    columns = [np.log1p(n), np.log1p(count), n / some / 10]
    wide = len(_KINDS) + len(_SHARES) + 2
    owner = np.repeat(np.arange(len(n)), np.diff(w.text_at))
    share = np.bincount(owner * wide + _KIND[raw], minlength=wide * len(n)).reshape(-1, wide)[:, 1:] / one[:, None]
    columns += [*np.sqrt(share[:, : len(_KINDS)]).T, *share[:, len(_KINDS) :].T]
    upper = (raw >= 65) & (raw <= 90)
    size = (w.end - w.start).astype(float)
    columns += [per_text(size <= 1, w.at) / some, per_text(size >= 12, w.at) / some, np.sqrt(per_text(size * size, w.at) / some) / 10]
    columns.append(per_text(upper[np.minimum(w.start, max(len(raw) - 1, 0))] if len(raw) else w.start > 0, w.at) / some)
    kinds, most = _repeats(w.hash, w.at)
    columns += [kinds / some, most / some]
    follows = mix(w.hash + np.append(w.hash[1:], np.uint64(0)) * np.uint64(3)) if len(w.hash) else w.hash
    kinds, most = _repeats(follows, w.at)
    columns += [kinds / some, most / some]
    lines = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
    at = np.asarray(lines.offsets, np.int64)
    at = at - at[0]
    codes = pc.dictionary_encode(lines.flatten()).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    kinds, most = _repeats(codes, at)
    columns += [kinds / np.maximum(np.diff(at), 1), most / np.maximum(np.diff(at), 1)]
    return np.column_stack(columns)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    values: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(z)), np.sqrt(2 / len(self.phase)) * np.cos(z @ self.waves + self.phase)])

    def score(self, texts: pa.Array) -> np.ndarray:
        ridge = self.fourier(statistics(texts)) @ self.weights
        return np.interp(ridge, self.steps, self.values)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing step function nearest to ``y`` in weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(y.tolist(), weight.tolist(), strict=True):
        blocks.append([v * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w2, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w2, blocks[-1][2] + k]
    return np.concatenate([np.full(int(k), s / w) for s, w, k in blocks]) if blocks else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5, held_out: int = 0, target: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from labelled rows outside the held-out remainder; the last remainder calibrates."""
    from .common import text_slices, written

    def stats(batches):
        for batch in text_slices(batches, 0, 1 << 19):
            x = statistics(batch.column(0))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([flat, batch.column(1), batch.column(2)], ["x", "y", "part"])

    rows = training_rows(docs, labels, target, mod, held_out, id_col, text_col)
    rows = written(rows.select("text", "y", F.col("part").cast("int").alias("part")).mapInArrow(stats, "x array<double>, y int, part int"), "quality-rows")
    width = len(statistics(pa.array([""]))[0])
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), *[f(F.col("x")[i]).alias(f"{k}{i}") for k, f in (("m", F.avg), ("s", F.stddev_pop)) for i in range(width)]).first()
    rng = np.random.default_rng(SEED)
    mean = np.array([total[f"m{i}"] or 0.0 for i in range(width)])
    scale = np.array([max(total[f"s{i}"] or 0.0, 1e-3) for i in range(width)])
    waves, phase = rng.normal(0, 1 / np.sqrt(width), (width, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    model = Model(mean, scale, waves, phase, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5 if total["y"] is None else total["y"]]))
    if total["n"] == 0 or total["y"] in (0.0, 1.0):
        return model
    calibrates = mod - 1 if held_out != mod - 1 else mod - 2

    def matrix(batch) -> np.ndarray:
        return np.asarray(batch.column(0).flatten(), float).reshape(len(batch), width)

    def equations(batches):
        a = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = model.fourier(matrix(batch))
            a += z.T @ np.column_stack([z, np.asarray(batch.column(1), float)])
        yield pa.RecordBatch.from_arrays([pa.array([a.ravel().tolist()])], ["a"])

    # at most PARTITIONS sums reach the driver, each of fixed size
    solve = rows.filter(F.col("part") != calibrates).repartition(PARTITIONS)
    sums = [np.array(r["a"]) for r in solve.select("x", "y").mapInArrow(equations, "a array<double>").collect()]
    a = np.sum(sums, axis=0).reshape(FEATURES + 1, FEATURES + 2)
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[0, 0] = 1e-9
    model.weights = np.linalg.solve(a[:, :-1] + penalty, a[:, -1])

    def scores(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.fourier(matrix(batch)) @ model.weights), batch.column(1)], ["s", "y"])

    scored = rows.filter(F.col("part") == calibrates).select("x", "y").mapInArrow(scores, "s double, y int")
    binned = scored.groupBy(F.round(F.col("s") * BINS).alias("b")).agg(F.avg("s").alias("s"), F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("s")
    found = [(r["s"], r["y"], r["n"]) for r in binned.collect()]  # a bounded number of bins
    if found:
        s, y, n = (np.array(c, float) for c in zip(*found, strict=True))
        smooth = isotonic((y + 0.02 * total["y"]) / (n + 0.02), n)
        model.steps, model.values = s, np.clip(smooth, 0, 1)
    return model


def score(docs: DataFrame, model: Model, mod: int = 5, held_out: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_score(rows, model.score, "text").select(
        "doc_id", F.coalesce(remainder("doc_id", mod) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
