"""Radius and nearest-neighbour joins.

Both are equi-joins on ``(keys, cell)`` with an exact distance test behind them, so one large
patch spreads over many cells and no task sees a whole patch.  Dense cells are not paired point by
point: the target side is first summarised into boxes (count, lower and upper corner), and a box
that lies fully inside or fully outside the radius settles its members without touching them.
Only boxes that the sphere cuts through are opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import XYZ
from ..session import cols

FINE = 8  # fine boxes per cell edge; a power of two, so that a fine index shifts to its cell
LEVELS = 2  # levels of boxes: what is opened point by point is a shell of r / 32
_SHIFT = 3
_PAD = 1e-6  # cell cover only; the distance test itself is exact


def _fine(axis: str, side: float) -> str:
    return f"cast(floor({axis} / {side / FINE!r}D) as bigint)"


def _cell(axis: str, side: float) -> str:
    return f"shiftright({_fine(axis, side)}, {_SHIFT})"


def _cell_names(axes) -> list[str]:
    return [f"_c{i}" for i in range(len(axes))]


def _cover(df: DataFrame, r: float | str, side: float, axes) -> DataFrame:
    """One row per cell that the ball of radius ``r``, a number or a column, around the point can touch
    (8 on average for cells of edge 2r, against 27 for cells of edge r)."""
    pad = f"({r} * {1 + _PAD!r}D + {_PAD!r}D)" if isinstance(r, str) else f"{r * (1 + _PAD) + _PAD!r}D"
    for i, a in enumerate(axes):
        lo, hi = _cell(f"({a} - {pad})", side), _cell(f"({a} + {pad})", side)
        df = df.selectExpr("*", f"explode(sequence({lo}, {hi})) as _c{i}")
    return df


def _distance(left, right) -> str:
    """Compared by the square root, never by its square, so that a point exactly at the radius falls
    on the same side everywhere."""
    return "sqrt(" + " + ".join(f"({p} - {q}) * ({p} - {q})" for p, q in zip(left, right)) + ")"


def _within(d: str, r: float, strict: bool) -> str:
    return f"{d} {'<' if strict else '<='} {float(r)!r}D"


def pairs_within(
    left: DataFrame,
    right: DataFrame,
    r: float,
    keys=(),
    axes=XYZ,
    strict: bool = False,
    own: str | None = None,
) -> DataFrame:
    """All (left, right) pairs of one key within ``r``; adds ``dist``.

    ``left`` is the replicated side, so pass the smaller one.  The coordinate columns of the right
    side are renamed ``r_<axis>``; other right columns must not clash with left columns.  Use it
    where the pairs themselves are the result, or where one side has bounded density.
    ``own`` names a left column with the radius of each point instead, none above ``r``.
    """
    side = 2.0 * r if r > 0 else 1.0
    cells = _cell_names(axes)
    joined = _cover(left, own or r, side, axes).join(_in_cells(right, side, axes), cols(keys, cells))
    d = _distance(axes, [f"r_{a}" for a in axes])
    near = f"dist {'<' if strict else '<='} {own}" if own else _within("dist", r, strict)
    return joined.selectExpr("*", f"{d} as dist").filter(near).drop(*cells)


def _in_cells(right: DataFrame, side: float, axes) -> DataFrame:
    """The right side of a join on cells, its coordinates renamed ``r_<axis>``."""
    return right.selectExpr(
        *[c for c in right.columns if c not in axes],
        *[f"{a} as r_{a}" for a in axes],
        *[f"{_cell(a, side)} as {c}" for a, c in zip(axes, _cell_names(axes))],
    )


def _boxes(targets: DataFrame, group, side: float, axes) -> DataFrame:
    """Fine boxes of the targets: (group, fine index) with their corners."""
    n = range(len(axes))
    fine = targets.selectExpr(*group, *axes, *[f"{_fine(a, side)} as _f{i}" for i, a in enumerate(axes)])
    aggs = [F.expr(f"{fn}({a}) as _{e}{i}") for i, a in enumerate(axes) for fn, e in (("min", "lo"), ("max", "hi"))]
    boxes = fine.groupBy(*group, *[f"_f{i}" for i in n]).agg(*aggs)
    return boxes.selectExpr("*", *[f"shiftright(_f{i}, {_SHIFT}) as _c{i}" for i in n])


def _box_bounds(axes) -> tuple[str, str]:
    """(least, greatest) distance from the point to anything inside the box."""
    gap = [f"greatest(_lo{i} - {a}, {a} - _hi{i}, 0D)" for i, a in enumerate(axes)]
    far = [f"greatest(abs({a} - _lo{i}), abs({a} - _hi{i}))" for i, a in enumerate(axes)]
    return tuple("sqrt(" + " + ".join(f"{v} * {v}" for v in side) + ")" for side in (gap, far))


def matches_within(
    queries: DataFrame,
    targets: DataFrame,
    r: float,
    ids,
    keys=(),
    tags=(),
    axes=XYZ,
    strict: bool = False,
) -> DataFrame:
    """Distinct ``(ids, tags)`` such that some target with these tags lies within ``r`` of the query.

    ``tags`` are target columns carried to the result (a detector, a cluster).  This is the radius
    semi-join of all matching rules: it asks only whether a match exists, so it never produces
    the pairs of two dense groups.
    """
    ids, keys, tags = list(ids), list(keys), list(tags)
    side = 2.0 * r if r > 0 else 1.0
    n = range(len(axes))
    cells, group, found = _cell_names(axes), cols(keys, tags), cols(ids, tags)
    box = [[f"_f{level}{i}" for i in n] for level in range(LEVELS)]
    edges = [(e, fn, i) for i in n for e, fn in (("lo", "min"), ("hi", "max"))]
    finest = box[-1]
    points = targets.selectExpr(*group, *[f"{a} as _t{i}" for i, a in enumerate(axes)], *[f"{_fine(a, side / FINE ** (LEVELS - 1))} as {f}" for a, f in zip(axes, finest)])
    boxes = {LEVELS - 1: points.groupBy(*group, *finest).agg(*[F.expr(f"{fn}(_t{i}) as _{e}{i}") for e, fn, i in edges])}
    for level in range(LEVELS - 2, -1, -1):  # wider boxes are made of the finer ones, which lie inside them
        boxes[level + 1] = boxes[level + 1].selectExpr("*", *[f"shiftright({f}, {_SHIFT}) as {g}" for f, g in zip(box[level + 1], box[level])])
        boxes[level] = boxes[level + 1].groupBy(*group, *box[level]).agg(*[F.expr(f"{fn}(_{e}{i}) as _{e}{i}") for e, fn, i in edges])
    boxes[0] = boxes[0].selectExpr("*", *[f"shiftright({f}, {_SHIFT}) as {c}" for f, c in zip(box[0], cells)])

    near, far = _box_bounds(axes)
    # Spark takes the cover for as few rows as there are queries, and boxes and points for as large as their compressed
    # files, and would send them to the driver
    search, out = _cover(queries.select(*cols(ids, keys, axes)), r, side, axes).hint("merge"), None
    for level in range(LEVELS):
        on = cols(group, box[level - 1]) if level else cols(keys, cells)
        step = search.join(boxes[level], on).filter(_within(near, r, strict)).selectExpr(*cols(ids, group, axes, box[level]), f"{_within(far, r, strict)} as _sure")
        settled = step.filter("_sure").select(*found)
        out = settled if out is None else out.unionByName(settled)
        search = step.filter("not _sure").drop("_sure").hint("merge")
    hits = search.join(points, cols(group, finest)).filter(_within(_distance(axes, [f"_t{i}" for i in n]), r, strict)).select(*found)
    return out.unionByName(hits).distinct()


def ball_max(queries: DataFrame, targets: DataFrame, value: str, r: float, ids, keys=(), axes=XYZ) -> DataFrame:
    """``(ids, value)``: the largest ``value`` of the targets within ``r`` of any point of the query; no row without one.

    Boxes inside the ball count with their maximum.  A box that the sphere cuts is opened only if its maximum
    is above what the boxes inside have given already.  NULL and NaN values don't count.
    """
    ids, keys = list(ids), list(keys)
    side = 2.0 * r if r > 0 else 1.0
    n = range(len(axes))
    cells, fines = _cell_names(axes), [f"_f{i}" for i in n]
    known = targets.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*cols(keys, axes), F.col(value).alias("_v"))
    fine = [F.expr(f"{_fine(a, side)} as {f}") for a, f in zip(axes, fines)]
    members = known.select(*keys, *fine, *[F.col(a).alias(f"_t{i}") for i, a in enumerate(axes)], "_v")
    top = members.groupBy(*keys, *fines).agg(F.max("_v").alias("_top"))
    boxes = _boxes(known, keys, side, axes).join(top, cols(keys, fines))
    near, far = _box_bounds(axes)
    cand = _cover(queries.select(*cols(ids, keys, axes)), r, side, axes).hint("merge").join(boxes, cols(keys, cells)).filter(_within(near, r, False))
    cand = cand.selectExpr(*cols(ids, keys, axes, fines), "_top", f"{_within(far, r, False)} as _sure")
    settled = cand.filter("_sure").groupBy(*ids).agg(F.max("_top").alias("_m"))
    opened = cand.filter("not _sure").join(settled, ids, "left").filter("_m is null or _top > _m")
    exact = _within(_distance(axes, [f"_t{i}" for i in n]), r, False)
    found = opened.drop("_top", "_sure", "_m").join(members, cols(keys, fines)).filter(exact).groupBy(*ids).agg(F.max("_v").alias("_m"))
    return settled.unionByName(found).groupBy(*ids).agg(F.max("_m").alias(value))


def without_match(queries: DataFrame, targets: DataFrame, r: float, ids, keys=(), axes=XYZ) -> DataFrame:
    """Radius anti-join: query rows that have no target within ``r``."""
    near = matches_within(queries, targets, r, ids=ids, keys=keys, axes=axes)
    return queries.join(near, list(ids), "left_anti")


def nearest(
    queries: DataFrame,
    targets: DataFrame,
    ids,
    keys=(),
    tags=(),
    top_side: float = 131072.0,
    levels: int = 5,
    axes=XYZ,
    bound: float | None = None,
) -> DataFrame:
    """Distance to the nearest target per ``(ids, tags)`` as ``nearest``; no row without a target.

    Best-first search over nested boxes: every level keeps, per query, only boxes whose least
    possible distance does not exceed the smallest guaranteed distance seen on that level, then
    opens them into boxes an eighth as wide.  Exact for any radius, without pairing a query with
    every target of its group: the widest boxes have an edge of ``top_side``, so even a wide group has few.
    ``bound`` drops neighbours farther than that; the search then begins with the boxes around the query that the
    bound can reach, and takes two levels.
    """
    ids, keys, tags = list(ids), list(keys), list(tags)
    group = cols(keys, tags)
    n = len(axes)
    m = range(n)
    if bound is not None:  # top boxes as wide as the ball of the bound: it touches few of them
        levels, top_side = 2, 2.0 * bound or 1.0
    finest = top_side / FINE ** (levels - 1)

    def box(lv):
        return [f"_b{lv}_{i}" for i in m]

    last = box(levels - 1)
    points = targets.selectExpr(
        *group, *[f"{a} as _t{i}" for i, a in enumerate(axes)],
        *[f"cast(floor({a} / {finest!r}D) as bigint) as {b}" for a, b in zip(axes, last)],
    )
    level = {levels - 1: points.groupBy(*group, *last).agg(
        *[F.expr(f"{fn}(_t{i}) as _{e}{i}") for i in m for fn, e in (("min", "lo"), ("max", "hi"))])}
    for lv in range(levels - 2, -1, -1):
        level[lv + 1] = level[lv + 1].selectExpr(
            "*", *[f"shiftright({f}, {_SHIFT}) as {b}" for f, b in zip(box(lv + 1), box(lv))])
        level[lv] = level[lv + 1].groupBy(*group, *box(lv)).agg(
            *[F.expr(f"{fn}(_{e}{i}) as _{e}{i}") for i in m for fn, e in (("min", "lo"), ("max", "hi"))])

    near, far = _box_bounds(axes)
    carry = cols(ids, group, axes)
    search = queries.selectExpr(*cols(ids, keys, axes), f"struct({', '.join(cols(ids, axes))}) as _q")
    best = F.min("_far").over(W.partitionBy("_q", *cols(keys, tags)))
    if bound is not None:
        for a, b in zip(axes, box(0), strict=True):
            lo, hi = (f"cast(floor(({a} {sign} {bound * (1 + _PAD) + _PAD!r}D) / {top_side!r}D) as bigint)" for sign in "-+")
            search = search.selectExpr("*", f"explode(sequence({lo}, {hi})) as {b}")
        search = search.hint("merge")  # as in matches_within
    for lv in range(levels):
        on = cols(group, box(lv - 1)) if lv else cols(keys, box(0)) if bound is not None else keys
        step = search.join(level[lv], on).selectExpr("*", f"{near} as _near", f"{far} as _far")
        if bound is not None:
            step = step.filter(f"_near <= {float(bound)!r}D")
        search = step.withColumn("_best", best).filter("_near <= _best").select(*carry, "_q", *box(lv))
    d = _distance(axes, [f"_t{i}" for i in m])
    hits = search.join(points, cols(group, last)).selectExpr(*cols(ids, tags), f"{d} as _d")
    if bound is not None:
        hits = hits.filter(f"_d <= {float(bound)!r}D")
    return hits.groupBy(*cols(ids, tags)).agg(F.min("_d").alias("nearest"))


def k_nearest_within(
    queries: DataFrame, targets: DataFrame, k: int, r: float, ids, order=(), keys=(), axes=XYZ
) -> DataFrame:
    """The at most ``k`` nearest targets within ``r`` of each query (ties broken by ``order``).

    For ``k`` = 1 the least distance of every query is found first, so only pairs at that distance are sorted.
    """
    if k == 1:
        least = _with_least(queries, targets, r, ids, keys, axes)
        pairs = pairs_within(least, targets, r, keys=keys, axes=axes, own="_least").filter("dist = _least").drop("_least")
    else:
        pairs = pairs_within(queries, targets, r, keys=keys, axes=axes)
    rank = F.row_number().over(W.partitionBy(*ids).orderBy("dist", *order))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def _with_least(queries: DataFrame, targets: DataFrame, r: float, ids, keys, axes) -> DataFrame:
    """Queries that have a target within ``r``, with their least distance as ``_least``.

    The least distance inside a query's own cell, or ``r``, bounds it; only cells that the ball of that bound touches are looked at.
    """
    side, cells, group = 2.0 * r if r > 0 else 1.0, _cell_names(axes), cols(ids, axes)
    carried = [F.any_value(c).alias(c) for c in queries.columns if c not in group]
    here = queries.selectExpr("*", *[f"{_cell(a, side)} as {c}" for a, c in zip(axes, cells)])
    beside = _in_cells(targets.select(*cols(keys, axes)), side, axes)
    dist = F.expr(_distance(axes, [f"r_{a}" for a in axes]))
    inside = here.join(beside, cols(keys, cells), "left").groupBy(*group).agg(F.least(F.min(dist), F.lit(float(r))).alias("_bound"), *carried)
    pairs = pairs_within(inside, targets.select(*cols(keys, axes)), r, keys=keys, axes=axes, own="_bound")
    return pairs.groupBy(*group).agg(F.min("dist").alias("_least"), *carried).select(*queries.columns, "_least")


def close_pairs(points: DataFrame, r: float, order: str, keys=(), axes=XYZ, strict: bool = False) -> DataFrame:
    """Pairs ``(a_<order>, b_<order>)`` with a before b within ``r``; the pairs are the result."""
    left = points.select(*keys, F.col(order).alias(f"a_{order}"), *axes)
    right = points.select(*keys, F.col(order).alias(f"b_{order}"), *axes)
    out = pairs_within(left, right, r, keys=keys, axes=axes, strict=strict)
    return out.filter(F.col(f"a_{order}") < F.col(f"b_{order}")).select(
        *keys, f"a_{order}", f"b_{order}", "dist"
    )


# ---------------------------------------------------------------- boxes
def bounding_boxes(points: DataFrame, by, axes=XYZ) -> DataFrame:
    aggs = []
    for a in axes:
        aggs += [F.min(a).alias(f"lo_{a}"), F.max(a).alias(f"hi_{a}")]
    return points.groupBy(*by).agg(*aggs)


def overlapping_boxes(left: DataFrame, right: DataFrame, pad: float, side: float, axes=XYZ) -> DataFrame:
    """Pairs of overlapping boxes (left padded by ``pad``).

    Both sides are cut into cells of edge ``side`` and joined on the cell; a pair that shares
    several cells is reported from the first cell of its overlap only, so no distinct is needed.
    Right columns must not clash with left ones, except for the ``lo_*``/``hi_*`` columns.
    """
    lcell, rcell = left, right
    for i, a in enumerate(axes):
        lo = F.floor((F.col(f"lo_{a}") - pad) / side).cast("long")
        hi = F.floor((F.col(f"hi_{a}") + pad) / side).cast("long")
        lcell = lcell.withColumn(f"_l{i}", lo).withColumn(f"_c{i}", F.explode(F.sequence(lo, hi)))
    rcell = rcell.select(
        *[c for c in right.columns if not c.startswith(("lo_", "hi_"))],
        *[F.col(f"{e}_{a}").alias(f"r_{e}_{a}") for e in ("lo", "hi") for a in axes],
    )
    for i, a in enumerate(axes):
        lo = F.floor(F.col(f"r_lo_{a}") / side).cast("long")
        hi = F.floor(F.col(f"r_hi_{a}") / side).cast("long")
        rcell = rcell.withColumn(f"_r{i}", lo).withColumn(f"_c{i}", F.explode(F.sequence(lo, hi)))
    cond = F.lit(True)
    first = F.lit(True)
    for i, a in enumerate(axes):
        cond = cond & (F.col(f"r_lo_{a}") <= F.col(f"hi_{a}") + pad) & (F.col(f"r_hi_{a}") >= F.col(f"lo_{a}") - pad)
        first = first & (F.col(f"_c{i}") == F.greatest(F.col(f"_l{i}"), F.col(f"_r{i}")))
    n = range(len(axes))
    drop = [f"_{k}{i}" for k in "clr" for i in n]
    return lcell.join(rcell, [f"_c{i}" for i in n]).filter(cond & first).drop(*drop)


def cloud_near_boxes(boxes: DataFrame, cloud: DataFrame, pad: float, side: float, box_id: str, axes=XYZ, lineage: str | None = None) -> DataFrame:
    """Cloud points inside a padded box: one equi-join on cells plus the six comparisons.

    ``lineage`` names a column of both sides; points of the box's own lineage never become candidates.
    """
    cell = boxes
    for i, a in enumerate(axes):
        lo = F.floor((F.col(f"lo_{a}") - pad) / side).cast("long")
        hi = F.floor((F.col(f"hi_{a}") + pad) / side).cast("long")
        cell = cell.withColumn(f"_c{i}", F.explode(F.sequence(lo, hi)))
    pts = cloud.select("*", *[F.floor(F.col(a) / side).cast("long").alias(f"_c{i}") for i, a in enumerate(axes)])
    inside = F.lit(True)
    for a in axes:
        inside = inside & F.col(a).between(F.col(f"lo_{a}") - pad, F.col(f"hi_{a}") + pad)
    drop = [f"_c{i}" for i in range(len(axes))] + [f"{e}_{a}" for e in ("lo", "hi") for a in axes]
    if lineage:
        pts = pts.withColumnRenamed(lineage, "_kin")
        inside = inside & ~F.col(lineage).eqNullSafe(F.col("_kin"))
    return cell.join(pts, [f"_c{i}" for i in range(len(axes))]).filter(inside).drop(*drop, "_kin")
