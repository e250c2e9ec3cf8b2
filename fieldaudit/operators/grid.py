"""Operators on vertex grids: lookup, cell centres, normals, area, step outliers, angles.

Windows run along single grid lines (patch, row) or (patch, col), so a large patch spreads over its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import GRID_STEP, XYZ, cross, distance, norm
from ..session import cols, join_same
from .ordered import exact_percentiles


def lookup(points: DataFrame, vertices: DataFrame, by=("patch",), how: str = "left") -> DataFrame:
    """Grid positions (by, row, col) -> coordinates; NULL coordinates where the vertex is missing or invalid."""
    v = vertices.filter("valid") if "valid" in vertices.columns else vertices
    return points.join(v.select(*by, "row", "col", *XYZ), cols(by, "row", "col"), how)


def cell_centres(cells: DataFrame, vertices: DataFrame, by=("patch",)) -> DataFrame:
    """Cells -> mean of their valid corners; cells without a valid corner drop out."""
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    spread = cells.select(*by, F.col("row").alias("_r"), F.col("col").alias("_q"), corner.alias("_k")).select(
        *by, "_r", "_q", (F.col("_r") + F.col("_k.a")).alias("row"), (F.col("_q") + F.col("_k.b")).alias("col")
    )
    got = lookup(spread, vertices, by, how="inner")
    mean = got.groupBy(*by, "_r", "_q").agg(*[F.avg(a).alias(a) for a in XYZ], F.count(F.lit(1)).alias("corners"))
    return mean.withColumnsRenamed({"_r": "row", "_q": "col"})


def _neighbour(column: Column | str, w, pos: str, step: int) -> Column:
    """Value on the adjacent grid position along the line, NULL if that vertex is missing."""
    fn = F.lead if step > 0 else F.lag
    return F.when(fn(pos).over(w) == F.col(pos) + step, fn(column).over(w))


def _bound(value: Column) -> Column:
    """The value as one row of a generator: later filters and projections read it instead of repeating its whole expression."""
    return F.explode(F.array(value))


def _difference(vertices: DataFrame, by, line: str, pos: str, prefix: str) -> DataFrame:
    w = W.partitionBy(*by, line).orderBy(pos)
    here = F.struct(pos, *XYZ)  # one window function a side: each costs its own pass over a line
    d = vertices.select("*", F.lag(here).over(w).alias("_prv"), F.lead(here).over(w).alias("_nxt"))

    def difference(a: str) -> Column:
        prv = F.when(F.col(f"_prv.{pos}") == F.col(pos) - 1, F.col(f"_prv.{a}"))
        nxt = F.when(F.col(f"_nxt.{pos}") == F.col(pos) + 1, F.col(f"_nxt.{a}"))
        return F.coalesce(nxt - prv, nxt - F.col(a), F.col(a) - prv)

    d = d.select(*vertices.columns, _bound(F.struct(*[difference(a).alias(a) for a in XYZ])).alias("_d"))
    return d.select(*vertices.columns, *[F.col(f"_d.{a}").alias(f"{prefix}{a}") for a in XYZ])


def normals(vertices: DataFrame, by=("patch",)) -> DataFrame:
    """Adds unit normals nx, ny, nz of valid vertices (central differences, one-sided at edges).

    NULL where a direction has no valid neighbour or the cross product vanishes.
    """
    by = list(by)
    v = vertices.filter("valid") if "valid" in vertices.columns else vertices
    d = _difference(_difference(v, by, "row", "col", "_u"), by, "col", "row", "_v")
    n = cross([F.col(f"_u{a}") for a in XYZ], [F.col(f"_v{a}") for a in XYZ])
    length = F.nullif(norm([F.col(f"_n.{a}") for a in XYZ]), F.lit(0.0))
    d = d.select(*v.columns, _bound(F.struct(*[c.alias(a) for c, a in zip(n, XYZ)])).alias("_n"))
    d = d.select(*v.columns, "_n", _bound(length).alias("_length"))
    return d.select(*v.columns, *[(F.col(f"_n.{a}") / F.col("_length")).alias(f"n{a}") for a in XYZ])


def surface_area(vertices: DataFrame, by=("patch",)) -> DataFrame:
    """(by, area): two triangles for every quad whose four corners are valid."""
    by = list(by)
    v = vertices.filter("valid") if "valid" in vertices.columns else vertices
    w = W.partitionBy(*by, "row").orderBy("col")
    pair = v.select(*by, "row", "col", F.struct(*XYZ).alias("a")).withColumn("b", _neighbour("a", w, "col", 1))
    w2 = W.partitionBy(*by, "col").orderBy("row")
    quad = pair.select(*by, "a", "b", _neighbour("a", w2, "row", 1).alias("c"), _neighbour("b", w2, "row", 1).alias("d"))
    quad = quad.filter("b is not null and c is not null and d is not null")

    def edge(p, q):
        return [F.col(f"{p}.{k}") - F.col(f"{q}.{k}") for k in XYZ]

    t1 = F.lit(0.5) * norm(cross(edge("b", "a"), edge("c", "a")))
    t2 = F.lit(0.5) * norm(cross(edge("b", "d"), edge("c", "d")))
    return quad.groupBy(*by).agg(F.sum(t1 + t2).alias("area"), F.count(F.lit(1)).alias("quads"))


def neighbour_steps(vertices: DataFrame, by=("patch",)) -> DataFrame:
    """(by, axis, row, col, step, x, y, z): distance to the next vertex per axis, located at the midpoint.

    Axis ``u`` runs along a row, ``v`` along a column.
    """
    by = list(by)
    v = vertices.filter("valid") if "valid" in vertices.columns else vertices
    out = None
    for axis, line, pos in (("v", "col", "row"), ("u", "row", "col")):
        w = W.partitionBy(*by, line).orderBy(pos)
        d = v.select(*by, "row", "col", *XYZ, _neighbour(F.struct(*XYZ), w, pos, 1).alias("_n")).filter("_n.x is not null")
        part = d.select(
            *by, F.lit(axis).alias("axis"), "row", "col",
            distance([F.col(a) for a in XYZ], [F.col(f"_n.{a}") for a in XYZ]).alias("step"),
            *[((F.col(a) + F.col(f"_n.{a}")) / 2).alias(a) for a in XYZ],
        )
        out = part if out is None else out.unionByName(part)
    return out


def step_outliers(vertices: DataFrame, factor: float = 5.0, by=("patch",)) -> DataFrame:
    """Steps longer than ``factor`` times the median step of their patch and axis; adds ``times``."""
    by = list(by)
    steps = neighbour_steps(vertices, by)
    med = exact_percentiles(steps, "step", [0.5], keys=cols(by, "axis")).select(*by, "axis", F.col("p0").alias("_med"))
    d = join_same(steps, med, cols(by, "axis"))
    return d.filter(F.col("step") > F.col("_med") * factor).withColumn("times", F.col("step") / F.col("_med")).drop("_med")


def interpolate(queries: DataFrame, at: str, knots: DataFrame, knot: str, values, segments_side: float | None = None) -> DataFrame:
    """Piecewise-linear interpolation on a sorted knot table, clamped at its ends.

    Every knot interval becomes one row; queries meet it by an equi-join on a coarse cell of the knot
    axis (width ``segments_side``) plus the interval test, so no query is compared with all knots.
    """
    values = [values] if isinstance(values, str) else list(values)
    w = W.partitionBy(F.lit(0)).orderBy(knot)  # the knot table is a control curve: short by nature
    seg = knots.select(
        F.col(knot).cast("double").alias("_z0"), F.lead(F.col(knot).cast("double")).over(w).alias("_z1"),
        F.min(F.col(knot).cast("double")).over(W.partitionBy(F.lit(0))).alias("_lo"),
        F.max(F.col(knot).cast("double")).over(W.partitionBy(F.lit(0))).alias("_hi"),
        *[F.col(v).cast("double").alias(f"_{v}0") for v in values],
        *[F.lead(F.col(v).cast("double")).over(w).alias(f"_{v}1") for v in values],
    ).filter("_z1 is not null or _lo = _hi")
    ends = seg.agg(F.min("_lo").alias("_min"), F.max("_hi").alias("_max"))
    side = float(segments_side or 1.0)
    cells = seg.withColumn("_cell", F.explode(F.sequence(
        F.floor(F.col("_z0") / side), F.floor(F.coalesce("_z1", "_z0") / side))))
    q = queries.crossJoin(F.broadcast(ends)).withColumn(  # one row
        "_z", F.least(F.greatest(F.col(at).cast("double"), F.col("_min")), F.col("_max"))
    ).withColumn("_cell", F.floor(F.col("_z") / side))
    inside = (F.col("_z") >= F.col("_z0")) & (
        (F.col("_z") < F.col("_z1")) | ((F.col("_z") == F.col("_z1")) & (F.col("_z1") == F.col("_max"))) | F.col("_z1").isNull()
    )
    joined = q.join(cells, "_cell").filter(inside)
    frac = (F.col("_z") - F.col("_z0")) / (F.col("_z1") - F.col("_z0"))
    out = [F.coalesce(F.col(f"_{v}0") + (F.col(f"_{v}1") - F.col(f"_{v}0")) * frac, F.col(f"_{v}0")).alias(v) for v in values]
    return joined.select(*[F.col(c) for c in queries.columns], *out)


def unwrap_angle(vertices: DataFrame, theta: str, by=("patch",)) -> DataFrame:
    """Unwrap an angle over the 4-connected components of a grid; adds ``component`` and ``unwrapped``.

    Along a row segment the turns are a running sum.  Vertical neighbours tie segments together by a whole
    number of turns, and the star rounds of :func:`components_with_offsets` carry these numbers to the
    first segment of each component, whose first vertex keeps its angle.  The result does not depend on
    the path as long as the field has no residues; :func:`unwrap_residues` reports where it has.
    """
    return _unwrapped(vertices, theta, by)[0]


def unwrap_residues(vertices: DataFrame, theta: str, by=("patch",)) -> DataFrame:
    """(component, ties, contradicted, witness): components whose vertical ties disagree with the unwrapped angle.

    ``witness`` is the first such tie (the two segments).  No rows: any path gives the same angle.
    """
    from .components import offset_contradictions

    _, comp, edges = _unwrapped(vertices, theta, by)
    bad = offset_contradictions(comp, edges)
    ties = edges.join(comp.select(F.col("node").alias("u"), "component"), "u").groupBy("component").agg(F.count(F.lit(1)).alias("ties"))
    return bad.groupBy("component").agg(F.count(F.lit(1)).alias("contradicted"), F.min(F.struct("u", "v")).alias("witness")).join(ties, "component").select(
        "component", "ties", "contradicted", "witness")


def _unwrapped(vertices: DataFrame, theta: str, by) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The unwrapped vertices, the segments' components with offsets, and the ties between segments."""
    from .components import components_with_offsets

    by = list(by)
    line = W.partitionBy(*by, "row").orderBy("col")
    d = vertices.withColumn("_isl", F.col("col") - F.row_number().over(line))
    seg = W.partitionBy(*by, "row", "_isl").orderBy("col")
    turn = F.floor((F.col(theta) - F.col("_before") + F.pi()) / (2 * F.pi()))
    d = d.withColumn("_before", F.lag(theta).over(seg))
    d = d.withColumn("_turns", -F.sum(F.coalesce(turn, F.lit(0))).over(seg.rowsBetween(W.unboundedPreceding, 0)))
    d = d.withColumn("_node", F.struct(*by, "row", F.min("col").over(W.partitionBy(*by, "row", "_isl")).alias("start")))
    up = W.partitionBy(*by, "col").orderBy("row")
    above = F.lag("row").over(up) == F.col("row") - 1
    ties = d.select(
        "_node", "_turns", theta, *[F.when(above, F.lag(c).over(up)).alias(f"_up{c}") for c in ("_node", "_turns", theta)]
    ).filter("_up_node is not null")
    step = -F.floor((F.col(theta) - F.col(f"_up{theta}") + F.pi()) / (2 * F.pi()))
    edges = ties.select(
        F.col("_node").alias("u"), F.col("_up_node").alias("v"),
        (F.col("_up_turns") + step - F.col("_turns")).cast("long").alias("w"),
    )
    comp = components_with_offsets(d.select(F.col("_node").alias("node")).distinct(), edges)
    out = d.join(comp.withColumnRenamed("node", "_node"), "_node")
    out = out.withColumn("unwrapped", F.col(theta) + 2 * F.pi() * (F.col("_turns") + F.col("offset")))
    return out.drop("_isl", "_before", "_turns", "_node", "offset"), comp, edges


def vertex_area(voxel_mm: float, step: float = GRID_STEP) -> float:
    """Area in mm2 that one vertex stands for."""
    return (step * voxel_mm) ** 2
