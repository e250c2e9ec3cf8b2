"""Toxicity: a factorization machine over hashed terms.

Terms are lower-case words and their first bytes, hashed into ``BUCKETS``.  The terms that tell the classes of
the labelled rows apart best (chi-square) enter the model.  Besides a weight, each term has a short vector; the
products of the vectors of two present terms are pairwise interactions, so an insult beside a group's name can
weigh more than both alone.  Training mixes parameters: every partition runs adaptive gradient steps from the
same start, and the partitions' parameters are averaged after each round.

Null and empty texts have no terms and get the model's intercept.  Repeated rows are scored alike.  Without
labelled rows of both classes every score is the share of label 1 (0 without labels).  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, written
from .grams import PUNCTUATION, words
from .labelled import remainder, training_rows, with_score

BUCKETS, TERMS, FACTORS, STEMS = 1 << 20, 256, 8, (4, 6)
ROUNDS, EPOCHS, PARTITIONS, BATCH, RATE, DECAY, SEED = 6, 6, 4, 64, 0.2, 1e-5, 5
#: Weights start at this share of a term's log odds.
START = 0.2
#: Occurrences of the rarest terms that may enter.
LEAST = 3


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all terms, in text order, and the text of each."""
    w = words(texts, PUNCTUATION)
    owner = w.owner()
    kinds = [w.hash, *[w.prefix(n) + np.uint64(n) for n in STEMS]]
    return np.concatenate([(k % np.uint64(BUCKETS)).astype(np.int64) for k in kinds]), np.tile(owner, len(kinds))


def _distinct(bucket: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(owner * width + bucket)
    return pairs % width, pairs // width


@dataclass
class Model:
    place: np.ndarray  # the term of each bucket, -1 for most
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, term: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Linear and pairwise parts of ``n`` texts with the given distinct terms."""
        linear = np.bincount(owner, self.weight[term], n)
        pair = np.zeros(n)
        for f in range(self.factor.shape[1]):
            v = self.factor[term, f]
            pair += np.bincount(owner, v, n) ** 2 - np.bincount(owner, v * v, n)
        return self.bias + linear + pair / 2

    def score(self, texts: pa.Array) -> np.ndarray:
        bucket, owner = terms(texts)
        term = self.place[bucket]
        term, owner = _distinct(term[term >= 0], owner[term >= 0], max(len(self.weight), 1))
        return 1 / (1 + np.exp(-np.clip(self.raw(term, owner, len(texts)), -35, 35)))


def _train(model: Model, rows: list[tuple[np.ndarray, int]], seed: int) -> Model:
    """Adaptive gradient steps on logistic loss, from ``model``."""
    rng = np.random.default_rng(seed)
    longest = max((len(t) for t, _ in rows), default=0)
    none = len(model.weight)  # the padding term: always zero
    index = np.full((len(rows), max(longest, 1)), none)
    for i, (t, _) in enumerate(rows):
        index[i, : len(t)] = t
    y = np.array([v for _, v in rows], float)
    w, v, b = np.append(model.weight, 0.0), np.vstack([model.factor, np.zeros(model.factor.shape[1])]), model.bias
    gw, gv, gb = np.full(len(w), 1e-2), np.full(v.shape, 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            pick = order[at : at + BATCH]
            idx = index[pick]
            vec = v[idx]
            total = vec.sum(1)
            z = b + w[idx].sum(1) + ((total**2) - (vec**2).sum(1)).sum(1) / 2
            g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[pick]) / len(pick)
            slope_w, slope_v = np.zeros(len(w)), np.zeros(v.shape)
            np.add.at(slope_w, idx, np.broadcast_to(g[:, None], idx.shape))
            np.add.at(slope_v, idx, g[:, None, None] * (total[:, None, :] - vec))
            slope_w += DECAY * w
            slope_v += DECAY * v
            slope_w[none], slope_v[none] = 0, 0
            gw, gv, gb = gw + slope_w**2, gv + slope_v**2, gb + g.sum() ** 2
            w, v, b = w - RATE * slope_w / np.sqrt(gw), v - RATE * slope_v / np.sqrt(gv), b - RATE * g.sum() / np.sqrt(gb)
    return Model(model.place, float(b), w[:-1], v[:-1])


def fit(docs: DataFrame, labels: DataFrame, mod: int = 3, held_out: int = 1, target: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from labelled rows outside the held-out remainder."""

    def listed(batches):
        for batch in text_slices(batches, 0, 1 << 19):
            bucket, owner = _distinct(*terms(batch.column(0)), BUCKETS)
            at = np.searchsorted(owner, np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(at), pa.array(bucket.astype(np.int32))), batch.column(1), batch.column(2)], ["terms", "y", "doc_id"])

    rows = training_rows(docs, labels, target, mod, held_out, id_col, text_col).select("text", "y", "doc_id")
    rows = written(rows.mapInArrow(listed, "terms array<int>, y int, doc_id long"), "toxicity-rows")
    n, toxic = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    toxic = toxic or 0
    share = toxic / n if n else 0.0
    place = np.full(BUCKETS, -1, np.int32)
    if toxic in (0, n):
        return Model(place, float(np.log(share / (1 - share))) if 0 < share < 1 else (35.0 if share else -35.0), np.zeros(0), np.zeros((0, FACTORS)))
    counts = rows.select(F.explode("terms").alias("term"), "y").groupBy("term").agg(F.sum("y").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("k"))
    gap = F.col("a") * (n - toxic) - (F.col("k") - F.col("a")) * toxic
    chi = gap * gap / (F.col("k") * (n - F.col("k") + 1))
    best = counts.filter(F.col("k") >= LEAST).select("term", "a", "k", chi.alias("chi")).orderBy(F.desc("chi"), "term").limit(TERMS).collect()
    best.sort(key=lambda r: r["term"])
    chosen = [r["term"] for r in best]
    place[chosen] = np.arange(len(chosen))
    a, k = np.array([r["a"] for r in best]), np.array([r["k"] for r in best])
    odds = np.log((a + 0.5) / (toxic + 1)) - np.log((k - a + 0.5) / (n - toxic + 1))
    rng = np.random.default_rng(SEED)
    model = Model(place, float(np.log(share / (1 - share))), START * odds, rng.normal(0, 0.02, (len(chosen), FACTORS)))

    def shrink(batches):
        for batch in batches:
            lists = batch.column(0)
            at = np.asarray(lists.offsets)
            term = place[np.asarray(lists.flatten())]
            owner = np.repeat(np.arange(len(batch)), np.diff(at))[term >= 0]
            ends = np.searchsorted(owner, np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(term[term >= 0].astype(np.int32))), batch.column(1), batch.column(2)], ["terms", "y", "doc_id"])

    # by id too: texts of equal terms, most of all those without any, would meet in one task
    order = F.xxhash64("terms", "y", "doc_id")
    small = written(rows.mapInArrow(shrink, "terms array<int>, y int, doc_id long").repartition(PARTITIONS, order).sortWithinPartitions(order), "toxicity-terms")
    for r in range(ROUNDS):
        start = model

        def step(batches, start=start, r=r):
            got = [(np.asarray(t.values, np.int64), y.as_py()) for b in batches for t, y in zip(b.column("terms"), b.column("y"), strict=True)]
            if got:
                m = _train(start, got, r)
                yield pa.RecordBatch.from_arrays([pa.array([len(got)]), pa.array([m.bias]), pa.array([m.weight.tolist()]), pa.array([m.factor.ravel().tolist()])], ["n", "b", "w", "v"])

        # at most PARTITIONS parameter sets of fixed size reach the driver
        sets = small.coalesce(PARTITIONS).mapInArrow(step, "n long, b double, w array<double>, v array<double>").collect()
        part = np.array([s["n"] for s in sets], float)
        part /= part.sum()
        model = Model(place, float(part @ [s["b"] for s in sets]), part @ np.array([s["w"] for s in sets]), (part @ np.array([s["v"] for s in sets])).reshape(-1, FACTORS))
    return model


def score(docs: DataFrame, model: Model, mod: int = 3, held_out: int = 1, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_score(rows, model.score, "text").select(
        "doc_id", F.coalesce(remainder("doc_id", mod) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
