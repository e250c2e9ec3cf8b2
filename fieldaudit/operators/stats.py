"""Rank statistics, distributions, contingency tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import SEED
from ..functions.stats import ratio
from ..session import cols, join_same, ship
from .bootstrap import DRAWS, draw_slots
from .ordered import exact_percentiles, hashed_ordinal, running_total, value_blocks

#: Blocks of scores that make a range of :func:`bootstrap_auroc`, and the rows weighed by all draws at once.
RANGE, WEIGHED = 8, 1024


def _auroc_from_counts(counts: DataFrame, score: str, keys) -> DataFrame:
    """AUROC from one row per (keys, score) with class weights ``pos`` and ``neg``."""
    keys = list(keys)
    ranked = running_total(counts, F.col("neg"), [score], keys=keys, name="_below", inclusive=False)
    agg = ranked.groupBy(*keys).agg(
        F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2)).alias("_u"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
    )
    value = ratio(F.col("_u"), F.col("n_pos") * F.col("n_neg"))
    return agg.select(*keys, F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg"), value.alias("auroc"))


def auroc(df: DataFrame, score: str, positive: Column, keys=()) -> DataFrame:
    """Area under the ROC curve with average ranks for ties; NULL if a class is empty.

    Rows are first counted per distinct score, then ranked by two-level running sums.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, score).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )
    return _auroc_from_counts(value_blocks(counts, score, keys), score, keys)


def _ranked_draws(ranged: DataFrame, picks: DataFrame, draws: int) -> DataFrame:
    """(draw, _u, n_pos, n_neg): the rank sums of every draw, from class counts (_range, ordinal, score, pos, neg) and picks (ordinal, _picks).

    A task takes a range of scores and weighs some thousand rows by all draws at once, so no row per draw and score is made;
    a range leaves a row per draw, and the ranges before it are added to its ranks.
    """
    ship(ranged.sparkSession)

    def rank(rows: pa.Table, picked: pa.Table) -> pa.Table:
        sums, held = np.zeros((3, draws)), None  # rank sum, positives, negatives

        def add(pos, neg):
            below = sums[2] + np.cumsum(neg, axis=0) - neg
            sums[0] += (pos * (below + neg / 2)).sum(axis=0)
            sums[1] += pos.sum(axis=0)
            sums[2] += neg.sum(axis=0)

        known = np.asarray(picked["_ordinal"])
        weights = np.zeros((len(known), draws), np.int32)
        if len(known):
            lists = picked["_picks"].combine_chunks()
            flat = lists.flatten()
            weights[np.repeat(np.arange(len(known)), np.asarray(pc.list_value_length(lists))), np.asarray(flat.field("draw"))] = np.asarray(flat.field("w"))
        missing = np.asarray(rows["score"].is_null())
        value = np.asarray(pc.fill_null(rows["score"], 0))
        order = np.lexsort((value, ~missing))  # NULL first, NaN last
        missing, value = missing[order], value[order]
        of = np.argsort(known, kind="stable")
        at = np.searchsorted(known, np.asarray(rows["ordinal"])[order], sorter=of)
        pos, neg = (np.asarray(rows[c], np.float64)[order] for c in ("pos", "neg"))
        opens = np.ones(len(order), bool)
        same = (missing[1:] == missing[:-1]) & ((value[1:] == value[:-1]) | ((value[1:] != value[1:]) & (value[:-1] != value[:-1])))
        opens[1:] = ~same
        for lo in range(0, len(order), WEIGHED) if len(known) else ():
            hi = min(lo + WEIGHED, len(order))
            j = of[np.minimum(at[lo:hi], len(known) - 1)]
            w = np.where((known[j] == np.asarray(rows["ordinal"])[order[lo:hi]])[:, None], weights[j], 0).astype(np.float64)  # a block that no draw picks counts nothing
            start = np.unique(np.append(0, np.flatnonzero(opens[lo:hi])))
            p, n = (np.add.reduceat(w * c[lo:hi, None], start, axis=0) for c in (pos, neg))
            if held is not None:  # the last score of the rows before may go on here
                if opens[lo]:
                    add(*held)
                else:
                    p[0] += held[0][0]
                    n[0] += held[1][0]
            add(p[:-1], n[:-1])
            held = p[-1:], n[-1:]
        if held is not None:
            add(*held)
        part = rows["_range"][:1].combine_chunks() if rows.num_rows else pa.array([], pa.int64())
        part = part.take(pa.array(np.zeros(draws if rows.num_rows else 0, np.int64)))
        return pa.table([part, pa.array(np.arange(draws)[:len(part)]), *[pa.array(v[:len(part)]) for v in sums]], names=["_range", "draw", "u", "p", "n"])

    needed = ranged.select(F.col("_range").alias("_part"), F.col("ordinal").alias("_of")).distinct()
    needed = needed.join(picks, F.col("_of") == F.col("ordinal")).select("_part", F.col("_of").alias("_ordinal"), "_picks")
    done = ranged.groupBy("_range").cogroup(needed.groupBy("_part")).applyInArrow(rank, "_range long, draw long, u double, p double, n double")
    before = W.partitionBy("draw").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # at most 1,000 / RANGE rows a draw
    done = done.withColumn("_below", F.coalesce(F.sum("n").over(before), F.lit(0.0)))
    return done.groupBy("draw").agg(
        F.sum(F.col("u") + F.col("p") * F.col("_below")).alias("_u"), F.sum("p").cast("long").alias("n_pos"), F.sum("n").cast("long").alias("n_neg"))


def bootstrap_auroc(
    df: DataFrame, score: str, positive: Column, block: str, draws: int = DRAWS, seed=SEED, probs=(0.025, 0.975)
) -> DataFrame:
    """Point estimate and block-bootstrap interval of the AUROC: one row (auroc, lo, hi, n_boot).

    A draw weighs every block by how often it was picked; classes are counted per (block, score)
    before any draw, and ranked for all draws at once in ranges of scores.
    """
    counts = df.groupBy(block, score).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    blocks = hashed_ordinal(counts.select(block).distinct(), block)
    plan = draw_slots(blocks.agg(F.count(F.lit(1)).alias("n")), draws, seed)
    weight = plan.groupBy("draw", "ordinal").agg(F.count(F.lit(1)).alias("w"))
    picks = weight.groupBy("ordinal").agg(F.collect_list(F.struct("draw", F.col("w").cast("int").alias("w"))).alias("_picks"))  # an entry a draw
    ranged = value_blocks(counts, score).withColumn("_range", F.floor(F.col("_block") / RANGE)).join(blocks, block)
    per_draw = _ranked_draws(ranged.select("_range", "ordinal", F.col(score).alias("score"), "pos", "neg"), picks, draws)
    per_draw = per_draw.select("draw", ratio(F.col("_u"), F.col("n_pos") * F.col("n_neg")).alias("auroc"))
    ci = per_draw.agg(F.percentile("auroc", list(probs)).alias("q"), F.count("auroc").alias("n_boot"))
    point = auroc(df, score, positive).select("auroc")
    return point.crossJoin(ci).select(
        "auroc", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "n_boot"
    )  # both sides are one row


def distribution(df: DataFrame, value: str, keys=()) -> DataFrame:
    """n, p10, quartiles, p90, min, max, mean of the finite values."""
    keys = list(keys)
    v = F.col(value).cast("double")
    finite = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    q = exact_percentiles(finite, value, [0.1, 0.25, 0.5, 0.75, 0.9], keys)
    q = q.select(*keys, "n", *[F.col(f"p{i}").alias(a) for i, a in enumerate(["p10", "q1", "median", "q3", "p90"])])
    m = finite.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"))
    return join_same(q, m, keys) if keys else q.crossJoin(m)  # one row each without keys


def bin_counts(df: DataFrame, value: Column, edges, labels, keys=()) -> DataFrame:
    """Counts of values in the half-open bins (lo, hi]; empty bins are reported as 0."""
    keys = list(keys)
    label = None
    for (lo, hi), name in zip(edges, labels):
        hit = (value > lo) & (value <= hi)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    counts = df.select(*keys, label.alias("bin")).filter(F.col("bin").isNotNull()).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("bin"))  # fixed list
    frame = df.select(*keys).distinct().crossJoin(F.broadcast(names)) if keys else names
    return frame.join(counts, cols(keys, "bin"), "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


# ---------------------------------------------------------------- Fisher's exact test
# ln Gamma by the Lanczos approximation; fixed values: g = 7, nine coefficients.
_LANCZOS_G = 7.0
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_factorial(n: Column) -> Column:
    """ln(n!) as one expression."""
    x = n.cast("double")
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], start=1):
        total = total + F.lit(c) / (x + i)
    t = x + _LANCZOS_G + 0.5
    return F.lit(0.9189385332046727) + (x + 0.5) * F.ln(t) - t + F.ln(total)


def fisher_two_sided(table: DataFrame, a: str, a_n: str, b: str, b_n: str, keys=()) -> DataFrame:
    """Two-sided Fisher exact p of hits ``a`` of ``a_n`` against ``b`` of ``b_n``; NULL for an empty row.

    The possible tables of one row are spread over rows and summed, so a large margin is not
    an array in one row's memory beyond one chunk.
    """
    keys = list(keys)
    k, m, n = F.col(a) + F.col(b), F.col(a_n), F.col(b_n)
    lo, hi = F.greatest(F.lit(0), k - n), F.least(k, m)

    def logp(x: Column) -> Column:
        def choose(u, v):
            return log_factorial(u) - log_factorial(v) - log_factorial(u - v)
        return choose(m, x) + choose(n, k - x) - choose(m + n, k)

    live = table.filter((m > 0) & (n > 0))
    grid = (
        live.withColumn("_lo", lo).withColumn("_hi", hi)
        .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_hi") - F.col("_lo")) / 4096))))
        .withColumn("_x", F.explode(F.sequence(
            F.col("_lo") + F.col("_chunk") * 4096, F.least(F.col("_hi"), F.col("_lo") + F.col("_chunk") * 4096 + 4095))))
    )
    term, seen = logp(F.col("_x")), logp(F.col(a))
    p = F.least(F.lit(1.0), F.sum(F.when(term <= seen + 1e-7, F.exp(term))))
    tested = grid.groupBy(*cols(keys, a, a_n, b, b_n)).agg(p.alias("fisher_p"))
    return join_same(table, tested, cols(keys, a, a_n, b, b_n), "left")


def contingency(df: DataFrame, flag: Column, hit: Column, keys=()) -> DataFrame:
    """Hits and sizes of the true and false side of a flag, and how many rows are undetermined."""
    return df.groupBy(*keys).agg(
        F.count_if(flag & hit).alias("a_hit"), F.count_if(flag).alias("a_n"),
        F.count_if(~flag & hit).alias("b_hit"), F.count_if(~flag).alias("b_n"),
        F.count_if(flag.isNull()).alias("undetermined"),
    )


def classified_fraction(df: DataFrame, flag: Column, keys=()) -> DataFrame:
    from ..functions.stats import wilson

    agg = df.groupBy(*keys).agg(
        F.count_if(flag).alias("k"), F.count(flag).alias("n"), F.count_if(flag.isNull()).alias("undetermined")
    )
    return agg.select(*keys, "k", "n", "undetermined", *wilson(F.col("k"), F.col("n")))


def noise_floor(noise: DataFrame, step: str, rows: DataFrame, n: str, threshold: float) -> DataFrame:
    """Share ``q`` of noise steps at or over the threshold, and how many rows of ``n`` steps each are
    expected to reach it by noise alone: sum(1 - (1 - q)^n)."""
    q = noise.agg(F.avg((F.col(step) >= threshold).cast("double")).alias("q"), F.count(step).alias("n_steps"))
    return rows.select(F.col(n).alias("_n")).crossJoin(F.broadcast(q)).groupBy("q", "n_steps").agg(
        F.sum(1 - F.pow(1 - F.col("q"), F.col("_n"))).alias("expected")
    )  # q is one row


def independence(offsets: DataFrame, offset: str, keys, reach: float = 1.0, close: float = 0.5, min_points: int = 50) -> DataFrame:
    """Does a trace copy a reference layer?  Per key: points on the layer, median offset, share within ``close``.

    ``offsets`` holds the nearest distance of every trace point that met the layer within its bound.  A
    trace is dependent if at least ``min_points`` points are on the layer and their median offset is
    below ``reach`` or half of them lie within ``close``.
    """
    keys = list(keys)
    med = exact_percentiles(offsets, offset, [0.5], keys).selectExpr(*keys, "n", "p0 as median")
    share = offsets.groupBy(*keys).agg(F.avg((F.col(offset) <= close).cast("double")).alias("share"))
    d = join_same(med, share, keys)
    return d.withColumn("dependent", (F.col("n") >= min_points) & ((F.col("median") < reach) | (F.col("share") >= 0.5)))
