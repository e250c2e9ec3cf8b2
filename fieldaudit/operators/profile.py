"""Intensity-profile rules: smoothing, two-sheet rule, on-layer test, parameter sweeps.

A profile is a short ordered series of bounded length, held as an array per row; the rules are array
expressions, so a sweep over many profiles is one pass without shuffles until its rates are counted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import SEED, uniform

CONTRAST_MIN = 15.0  # fixed value: less contrast than this leaves a profile undecided
TRUNCATE = 4.0       # fixed value: the kernel ends at four sigma
MISSING_MAX = 0.1    # fixed value: more missing samples than this leave a profile undecided


def gaussian_kernel(sigma: float) -> list[float]:
    """Normalised weights for offsets -R..R, R = int(4 sigma + 0.5)."""
    radius = int(TRUNCATE * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(w)
    return [v / total for v in w]


def collect_profiles(samples: DataFrame, keys=("profile_id",)) -> DataFrame:
    """Samples (keys, t, v) -> one row per profile with arrays ``t`` and ``v`` in order of t.

    Profiles have a bounded number of samples by construction (a window of a few spacings).
    """
    arr = F.array_sort(F.collect_list(F.struct("t", "v")))
    return samples.groupBy(*keys).agg(arr.alias("_s")).selectExpr(*keys, "_s.t as t", "_s.v as v")


def window(profiles: DataFrame, t0: str = "t0", t1: str = "t1", s: str = "s") -> DataFrame:
    """Cut to [min - 3s, max + 3s]; fill missing samples with the median, or drop the series to NULL if more
    than a tenth is missing."""
    d = profiles.selectExpr(
        "*", f"filter(arrays_zip(t, v), q -> q.t >= least({t0}, {t1}) - 3 * {s} - 1e-9D and q.t <= greatest({t0}, {t1}) + 3 * {s} + 1e-9D) as _w"
    )
    d = d.selectExpr("*", "array_sort(filter(transform(_w, q -> q.v), x -> x is not null and not isnan(x))) as _ok")
    mid = "(element_at(_ok, cast(floor((size(_ok) + 1) / 2) as int)) + element_at(_ok, cast(floor(size(_ok) / 2) as int) + 1)) / 2"
    usable = f"size(_w) > 0 and size(_w) - size(_ok) <= {MISSING_MAX}D * size(_w)"
    fill = f"if({usable}, transform(_w, q -> coalesce(nanvl(q.v, null), {mid})), null)"
    keep = [c for c in profiles.columns if c not in ("t", "v")]
    return d.selectExpr(*keep, "transform(_w, q -> q.t) as t", f"{fill} as v")


def smooth(profiles: DataFrame, sigma: float, out: str = "vs") -> DataFrame:
    """Adds the Gaussian-smoothed series (sigma in samples, mirrored ends)."""
    kernel = gaussian_kernel(sigma)
    radius = len(kernel) // 2
    weights = "array(" + ", ".join(f"{w!r}D" for w in kernel) + ")"
    n = "size(v)"
    # mirror without repeating a period: ... 1 0 | 0 1 2 ... n-1 | n-1 n-2 ...
    pos = f"pmod(i + k - {radius}, 2 * {n})"
    value = f"element_at(v, cast(if({pos} < {n}, {pos}, 2 * {n} - 1 - {pos}) as int) + 1)"
    total = f"aggregate(sequence(0, {len(kernel) - 1}), 0D, (acc, k) -> acc + element_at({weights}, k + 1) * {value})"
    return profiles.selectExpr("*", f"if(v is null or {n} = 0, null, transform(sequence(0, {n} - 1), i -> {total})) as {out}")


def _percentile(sorted_array: str, q: str) -> str:
    at = f"({q} / 100D * (size({sorted_array}) - 1))"
    lo = f"element_at({sorted_array}, cast(floor({at}) as int) + 1)"
    hi = f"element_at({sorted_array}, cast(ceil({at}) as int) + 1)"
    return f"({lo} + ({hi} - {lo}) * ({at} - floor({at})))"


def _streaks(series: str, test: str) -> str:
    """Array of (a, b) index pairs (0-based, inclusive) of maximal streaks where ``test`` (of {x}) holds."""
    at = lambda i: f"coalesce({test.format(x=f'get({series}, {i})')}, false)"
    edge = lambda beside: f"filter(sequence(0, size({series}) - 1), i -> {at('i')} and not {at(beside)})"
    return f"zip_with({edge('i - 1')}, {edge('i + 1')}, (p, q) -> named_struct('a', p, 'b', q))"


def two_sheet_rule(profiles: DataFrame, step: float, out: str = "passed") -> DataFrame:
    """Do the ends t0 and t1 sit on adjacent sheets?

    Needs t, vs, t0, t1, s and the parameter columns end_zone, min_dark, q, mid_bias.  True if both ends are
    bright, exactly one dark stretch of at least ``min_dark`` lies between and no bright layer does; NULL
    if there is too little contrast or an end has no sample.
    """
    d = profiles.selectExpr("*", "array_sort(vs) as _sorted", f"greatest(end_zone * s, {step / 2 + 1e-6!r}D) as _ez",
                            "least(t0, t1) as _lo", "greatest(t0, t1) as _hi")
    d = d.selectExpr("*", f"{_percentile('_sorted', 'q')} as _p", f"{_percentile('_sorted', '(100 - q)')} as _r")
    d = d.selectExpr("*", "(_p + _r) / 2 as _thr", "arrays_zip(t, vs) as _z")
    d = d.selectExpr(
        "*", "(_thr - mid_bias * (_r - _p)) as _mid",
        "transform(filter(_z, w -> w.t >= _lo - _ez and w.t <= _lo + _ez), w -> w.vs) as _zl",
        "transform(filter(_z, w -> w.t >= _hi - _ez and w.t <= _hi + _ez), w -> w.vs) as _zh",
        "filter(_z, w -> w.t >= _lo and w.t <= _hi) as _in",
    )
    d = d.selectExpr("*", "transform(_in, w -> w.vs) as _vi", "transform(_in, w -> w.t) as _ti")
    dark = f"size(filter({_streaks('_vi', '{x} < _thr')}, g -> (g.b - g.a + 1) * {float(step)!r}D >= min_dark))"
    mid = f"size(filter({_streaks('_vi', '{x} >= _mid')}, g -> element_at(_ti, g.a + 1) > _lo + _ez and element_at(_ti, g.b + 1) < _hi - _ez))"
    undecided = f"vs is null or size(vs) = 0 or _r - _p < {CONTRAST_MIN}D or size(_zl) = 0 or size(_zh) = 0 or size(_in) < 2"
    rule = f"array_max(_zl) > _thr and array_max(_zh) > _thr and {dark} = 1 and {mid} = 0"
    drop = ["_sorted", "_ez", "_lo", "_hi", "_p", "_r", "_thr", "_z", "_mid", "_zl", "_zh", "_in", "_vi", "_ti"]
    return d.selectExpr("*", f"if({undecided}, null, {rule}) as {out}").drop(*drop)


def on_layer(profiles: DataFrame, step: float, q: float = 30.0, win: float = 0.1, out: str = "on_layer") -> DataFrame:
    """Is t = 0 on a bright layer?  NULL without contrast.  Needs t, vs, s."""
    d = profiles.selectExpr("*", "array_sort(vs) as _sorted")
    d = d.selectExpr("*", f"{_percentile('_sorted', f'{q!r}D')} as _p", f"{_percentile('_sorted', f'{100 - q!r}D')} as _r")
    near = f"array_max(transform(filter(arrays_zip(t, vs), w -> abs(w.t) <= {win!r}D * s + {step / 2 + 1e-9!r}D), w -> w.vs))"
    undecided = f"vs is null or size(vs) = 0 or _r - _p < {CONTRAST_MIN}D"
    return d.selectExpr("*", f"if({undecided}, null, {near} > (_p + _r) / 2) as {out}").drop("_sorted", "_p", "_r")


# The published parameter grid (voxels, except q in percent).
SWEEP = {
    "sigma": [0.5, 1.0, 1.5, 2.0, 3.0],
    "end_zone": [0.1, 0.15, 0.2, 0.3],
    "min_dark": [1.0, 2.0, 3.0],
    "q": [10.0, 20.0, 30.0],
    "mid_bias": [0.0, 0.15, 0.3],
}
FALSE_PASS_MAX = 0.05
SWEEP_TASKS = 128  # tasks a sigma
CEILINGS = [0.05, 0.075, 0.10, 0.15]


def sweep(controls: DataFrame, step: float, grid: dict[str, list[float]] = SWEEP, keys=("kind", "split")) -> DataFrame:
    """(keys, parameters, n, decided, passed) of :func:`two_sheet_rule` over a parameter grid.

    controls(keys, t, v, t0, t1, s) holds one row per control profile.  Each parameter is exploded where it is first
    needed: windows are cut once, series smoothed and sorted once per sigma, dark stretches found once per (sigma, q), bright
    ones once per (sigma, q, mid_bias); the other settings only compare them.
    """
    keys = list(keys)

    def exploded(d: DataFrame, name: str) -> DataFrame:
        values = ", ".join(f"{float(v)!r}D" for v in grid[name])
        return d.selectExpr("*", f"explode(array({values})) as {name}")

    # a profile is few bytes and much work, so the bytes of a partition say nothing about its time
    cut = window(controls).repartition(SWEEP_TASKS)
    d = None
    for sigma in grid["sigma"]:
        part = smooth(cut, sigma / step).selectExpr("*", f"{float(sigma)!r}D as sigma").drop("v")
        d = part if d is None else d.unionByName(part)
    d = d.selectExpr(*keys, "sigma", "s", "vs", "array_sort(vs) as _sorted", "least(t0, t1) as _lo", "greatest(t0, t1) as _hi", "arrays_zip(t, vs) as _z")
    d = d.selectExpr("*", "filter(_z, w -> w.t >= _lo and w.t <= _hi) as _in").selectExpr("*", "transform(_in, w -> w.vs) as _vi", "transform(_in, w -> w.t) as _ti")
    d = exploded(d, "q").selectExpr("*", f"{_percentile('_sorted', 'q')} as _p", f"{_percentile('_sorted', '(100 - q)')} as _r").selectExpr("*", "(_p + _r) / 2 as _thr")
    d = d.selectExpr("*", f"transform({_streaks('_vi', '{x} < _thr')}, g -> (g.b - g.a + 1) * {float(step)!r}D) as _dark").drop("_sorted", "_in")
    d = exploded(d, "mid_bias").selectExpr("*", "(_thr - mid_bias * (_r - _p)) as _mid")
    d = d.selectExpr("*", f"transform({_streaks('_vi', '{x} >= _mid')}, g -> named_struct('a', get(_ti, g.a), 'b', get(_ti, g.b))) as _light")
    d = exploded(d.drop("_mid"), "end_zone").selectExpr("*", f"greatest(end_zone * s, {step / 2 + 1e-6!r}D) as _ez")
    zone = lambda at: f"transform(filter(_z, w -> w.t >= {at} - _ez and w.t <= {at} + _ez), w -> w.vs)"
    d = d.selectExpr("*", f"{zone('_lo')} as _zl", f"{zone('_hi')} as _zh")
    undecided = f"vs is null or size(vs) = 0 or _r - _p < {CONTRAST_MIN}D or size(_zl) = 0 or size(_zh) = 0 or size(_vi) < 2"
    bright = "array_max(_zl) > _thr and array_max(_zh) > _thr and not exists(_light, g -> g.a > _lo + _ez and g.b < _hi - _ez)"
    d = exploded(d.selectExpr(*keys, "sigma", "q", "mid_bias", "end_zone", "_dark", f"if({undecided}, null, {bright}) as _bright"), "min_dark")
    d = d.selectExpr("*", "if(_bright is null, null, _bright and size(filter(_dark, n -> n >= min_dark)) = 1) as passed")
    return d.groupBy(*keys, *grid).agg(F.count(F.lit(1)).alias("n"), F.count("passed").alias("decided"), F.count_if("passed").alias("passed"))


def sweep_table(rates: DataFrame, kinds=("adjacent", "two_apart", "same_sheet"), params=tuple(SWEEP)) -> DataFrame:
    """One row per parameter set: rate per kind (0 where nothing was decided), margin, qualifies."""
    a, b, c = kinds
    rate = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("passed"))) / F.nullif(
        F.sum(F.when(F.col("kind") == k, F.col("decided"))).cast("double"), F.lit(0.0)), F.lit(0.0)) for k in kinds}
    t = rates.groupBy(*params).agg(*[r.alias(k) for k, r in rate.items()])
    return t.withColumn("margin", F.col(a) - F.greatest(b, c)).withColumn(
        "qualifies", (F.col(b) <= FALSE_PASS_MAX) & (F.col(c) <= FALSE_PASS_MAX)
    )


def choose(table: DataFrame, params=tuple(SWEEP), target: str = "adjacent") -> DataFrame:
    """Constrained arg-max: best target rate among qualifying sets (ties by margin), else largest margin.

    Remaining ties go to the first parameter set in grid order.
    """
    key = F.struct(
        F.col("qualifies").cast("int"), F.when(F.col("qualifies"), F.col(target)).otherwise(0.0), F.col("margin"), *[-F.col(p) for p in params]
    )
    return table.agg(F.max_by(F.struct(*table.columns), key).alias("b")).select("b.*")


def top_sets(table: DataFrame, n: int = 10, params=tuple(SWEEP), target: str = "adjacent") -> DataFrame:
    order = [F.col("qualifies").desc(), F.when(F.col("qualifies"), F.col(target)).otherwise(0.0).desc(), F.col("margin").desc()]
    return table.orderBy(*order, *params).limit(n)


def frontier(table: DataFrame, value: str, cost, ceilings=CEILINGS, ties=()) -> DataFrame:
    """Best row per ceiling: largest ``value`` among rows whose ``cost`` columns stay at or below it."""
    cost = [cost] if isinstance(cost, str) else list(cost)
    lim = F.explode(F.array(*[F.lit(float(c)) for c in ceilings])).alias("ceiling")
    d = table.select("*", lim).filter(F.greatest(*cost, F.lit(-1.0)) <= F.col("ceiling"))
    key = F.struct(F.col(value), *[-F.col(t) for t in ties])
    best = d.groupBy("ceiling").agg(F.max_by(F.struct(*table.columns), key).alias("b"))
    return best.select("ceiling", "b.*")


def ladder_controls(points: DataFrame, coll: str = "coll", winding: str = "w", seed=SEED) -> DataFrame:
    """Control segments from annotated ladders (coll, w, x, y, z): adjacent, same_sheet and two_apart rows
    (kind, coll, w, length, t0, t1, s, x, y, z, dx, dy, dz, split).  Ladders are short sequences of one annotator.

    The split into ``tune`` and ``test`` is one of whole ladders and depends on a ladder's own key alone (a hash with
    the seed), so ladders that are added later move no other one.  About half of the ladders are on either side.
    """
    from pyspark.sql import Window as W

    from ..functions.geometry import XYZ

    w = W.partitionBy(coll).orderBy(winding)
    d = points.select(coll, winding, *XYZ, *[F.lead(c, k).over(w).alias(f"{c}{k}") for k in (1, 2) for c in (winding, *XYZ)])
    for k in (1, 2):
        d = d.withColumn(f"l{k}", F.expr("sqrt(" + " + ".join(f"pow({a}{k} - {a}, 2)" for a in XYZ) + ")"))
    d = d.withColumn("l12", F.expr("sqrt(" + " + ".join(f"pow({a}2 - {a}1, 2)" for a in XYZ) + ")"))
    one = d.filter(f"{winding}1 - {winding} = 1 and l1 >= 1e-6")
    unit = [f"({a}1 - {a}) / l1 as d{a}" for a in XYZ]
    head = [coll, winding, *XYZ]
    adj = one.selectExpr("'adjacent' as kind", *head, "l1 as length", "0D as t0", "l1 as t1", "l1 as s", *unit)
    same = one.selectExpr("'same_sheet' as kind", *head, "l1 as length", "-0.2D * l1 as t0", "0.2D * l1 as t1", "l1 as s", *unit)
    two = one.filter(f"{winding}2 - {winding} = 2 and l2 >= 1e-6").selectExpr(
        "'two_apart' as kind", *head, "l2 as length", "0D as t0", "l2 as t1", "least(l1, l12) as s", *[f"({a}2 - {a}) / l2 as d{a}" for a in XYZ])
    half = F.when(uniform(f"{seed}.split", F.col(coll)) < 0.5, "tune").otherwise("test")
    return adj.unionByName(same).unionByName(two).withColumn("split", half)


def sample_volume(points: DataFrame, chunks: DataFrame, edge: int = 128) -> DataFrame:
    """Trilinear lookup (point_id, x, y, z in level voxels) in landed chunks (cz, cy, cx, bytes): NULL outside.

    Every point becomes eight weighted corners that meet their chunk by an equi-join.
    """
    corner = F.explode(F.expr(
        "flatten(transform(array(0, 1), a -> flatten(transform(array(0, 1), b -> transform(array(0, 1), c -> named_struct('a', a, 'b', b, 'c', c))))))"))
    d = points.select("point_id", "x", "y", "z", corner.alias("k"))
    d = d.selectExpr(
        "point_id", "cast(floor(z) as bigint) + k.a as iz", "cast(floor(y) as bigint) + k.b as iy", "cast(floor(x) as bigint) + k.c as ix",
        "if(k.a = 1, z - floor(z), 1 - (z - floor(z))) * if(k.b = 1, y - floor(y), 1 - (y - floor(y))) * if(k.c = 1, x - floor(x), 1 - (x - floor(x))) as wt",
    ).selectExpr("*", f"iz div {edge} as cz", f"iy div {edge} as cy", f"ix div {edge} as cx")
    at = f"cast(((iz % {edge}) * {edge} + iy % {edge}) * {edge} + ix % {edge} as int) + 1"
    v = f"conv(hex(substring(bytes, {at}, 1)), 16, 10)"
    j = d.join(chunks, ["cz", "cy", "cx"], "left")
    return j.groupBy("point_id").agg(F.expr(
        f"case when count(if(bytes is null and wt > 0, 1, null)) = 0 then sum(if(wt = 0, 0D, wt * cast({v} as double))) end as value"))


