"""Grid, run, sheet-stack and labelling queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import grid as gr
from ..operators import sequence as Q
from ..operators import stacks as st
from ..operators.components import edge_flags_to_cells, grid_components
from ..operators.spatial import bounding_boxes, cloud_near_boxes, overlapping_boxes, pairs_within
from .base import Tables, longs, query, r6, rounded, s6, with_views

XYZ = list(G.XYZ)


@query(
    "grid_lookup",
    with_views(
        f"""SELECT q.patch, q.row, q.col, {s6('g.x')} AS x, {s6('g.z')} AS z, coalesce(g.valid, FALSE) AS valid
        FROM (SELECT event_id % (SELECT max(vec_id) // 50 + 1 FROM embeddings) AS patch, event_id % 53 AS row, event_id % 67 AS col FROM pt) q
        LEFT JOIN grid g ON g.patch = q.patch AND g.row = q.row AND g.col = q.col""", "pt", "grid"),
)
def grid_lookup(t: Tables):
    """Grid alarms to coordinates; vertices outside the grid or invalid stay NULL and can be counted."""
    q = t.pt().select((F.col("event_id") % t.surfaces()).alias("patch"), (F.col("event_id") % 53).alias("row"), (F.col("event_id") % 67).alias("col"))
    out = gr.lookup(q, t.grid())
    return out.select("patch", "row", "col", r6("x").alias("x"), r6("z").alias("z"), F.col("x").isNotNull().alias("valid"))


@query(
    "cell_centres",
    with_views(
        f"""SELECT c.patch, c.row, c.col, {s6('avg(g.x)')} AS x, {s6('avg(g.y)')} AS y, {s6('avg(g.z)')} AS z, count(*) AS corners
        FROM (SELECT patch, row, col FROM grid WHERE v > 0.1) c JOIN grid g ON g.patch = c.patch
        AND g.row BETWEEN c.row AND c.row + 1 AND g.col BETWEEN c.col AND c.col + 1 GROUP BY 1, 2, 3""", "grid"),
)
def cell_centres(t: Tables):
    g = t.grid()
    return rounded(gr.cell_centres(g.filter("v > 0.1"), g), "x", "y", "z")


RUNS_SQL = """SELECT patch, 'row' AS axis, row AS line, min(col) AS start, max(col) AS stop, count(*) AS n FROM
  (SELECT *, col - row_number() OVER (PARTITION BY patch, row ORDER BY col) AS isl FROM grid) GROUP BY patch, row, isl
  UNION ALL SELECT patch, 'col', col, min(row), max(row), count(*) FROM
  (SELECT *, row - row_number() OVER (PARTITION BY patch, col ORDER BY row) AS isl FROM grid) GROUP BY patch, col, isl"""


@query("line_runs", with_views(RUNS_SQL, "grid"))
def line_runs(t: Tables):
    return Q.line_runs(t.grid())


@query(
    "run_vertices",
    with_views(
        f"""SELECT r.patch, r.axis, r.line, r.start, i.ord, CASE WHEN axis = 'row' THEN line ELSE start + ord END AS row,
        CASE WHEN axis = 'row' THEN start + ord ELSE line END AS col FROM ({RUNS_SQL}) r, LATERAL (SELECT unnest(range(r.n)) AS ord) i
        WHERE r.n >= 10""", "grid"),
)
def run_vertices(t: Tables):
    runs = Q.line_runs(t.grid()).filter("n >= 10").selectExpr(
        "patch", "axis", "line", "start", "if(axis = 'row', line, start) as r0", "if(axis = 'row', start, line) as c0",
        "if(axis = 'row', line, stop) as r1", "if(axis = 'row', stop, line) as c1",
    )
    ids = ["patch", "axis", "line", "start"]
    on_row = F.col("axis") == "row"
    return runs.selectExpr(*ids, "r0", "c0", "r1", "c1").transform(
        lambda d: Q.expand_runs(d.withColumn("run", F.struct(*ids)), id_cols=["run"])
    ).selectExpr("run.patch as patch", "run.axis as axis", "run.line as line", "run.start as start", "ord", "row", "col")


@query(
    "arc_length",
    with_views(
        f"""SELECT patch, line, isl, {s6('coalesce(sum(step), 0) * 0.0096::DOUBLE')} AS length_mm, count(*) AS vertices FROM
        (SELECT patch, row AS line, isl, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS step FROM
          (SELECT *, col - row_number() OVER (PARTITION BY patch, row ORDER BY col) AS isl FROM grid)
         WINDOW w AS (PARTITION BY patch, row, isl ORDER BY col)) GROUP BY 1, 2, 3""", "grid"),
)
def arc_length(t: Tables):
    w = W.partitionBy("patch", "row").orderBy("col")
    g = t.grid().withColumn("isl", F.col("col") - F.row_number().over(w)).withColumnRenamed("row", "line")
    out = Q.arc_length(g, ["patch", "line", "isl"], ["col"], unit=G.voxels(1.0))
    return rounded(out.withColumnRenamed("length", "length_mm"), "length_mm")


@query(
    "run_arc",
    with_views(f"SELECT run_id, patch, {s6('length')} AS length, vertices FROM run", "run"),
)
def run_arc(t: Tables):
    """Arc length of runs that may be long: windows over day blocks, seams fixed with one row per block."""
    return rounded(t.run(), "length")


@query(
    "longest_streak",
    with_views(
        """SELECT b.patch, b.row, coalesce(max(n), 0)::BIGINT AS longest FROM (SELECT DISTINCT patch, row FROM grid_all) b
        LEFT JOIN (SELECT patch, row, isl, count(*) AS n FROM
          (SELECT *, rn - row_number() OVER (PARTITION BY patch, row ORDER BY col) AS isl FROM
            (SELECT *, row_number() OVER (PARTITION BY patch, row ORDER BY col) AS rn FROM grid_all) WHERE valid AND v > 0)
          GROUP BY 1, 2, 3) s ON s.patch = b.patch AND s.row = b.row GROUP BY 1, 2""", "grid_all"),
)
def longest_streak(t: Tables):
    g = t.grid(valid_only=False).withColumn("on", F.when(F.col("valid"), F.col("v") > 0))
    return Q.longest_streak(g, ["patch", "row"], "col", F.col("on"))


@query(
    "longest_block",
    with_views(
        """SELECT patch, start, stop, n FROM (SELECT patch, min(row) AS start, max(row) AS stop, count(*) AS n,
            row_number() OVER (PARTITION BY patch ORDER BY count(*) DESC, min(row)) AS k FROM
          (SELECT patch, row, row - row_number() OVER (PARTITION BY patch ORDER BY row) AS isl FROM grid GROUP BY patch, row HAVING count(*) >= 58)
          GROUP BY patch, isl) WHERE k = 1""", "grid"),
)
def longest_block(t: Tables):
    rows = t.grid(valid_only=False).groupBy("patch", "row").agg(F.count_if("valid").alias("n_valid"))
    return Q.longest_block(rows, ["patch"], "row", F.col("n_valid") >= 58)


@query(
    "run_acceptance",
    with_views(
        f"""SELECT q.patch, q.row, q.n, q.decided, q."on", coalesce(s.streak, 0)::BIGINT AS off_streak, {s6('"on"::DOUBLE / nullif(decided, 0)')} AS fraction_on,
        CASE WHEN decided >= 0.8 * q.n AND decided > 0 THEN "on"::DOUBLE / decided >= 0.45 AND coalesce(s.streak, 0) <= 4 END AS accepted
        FROM (SELECT patch, row, count(*) AS n, count(*) FILTER (valid) AS decided, count(*) FILTER (valid AND v > 0) AS "on" FROM grid_all GROUP BY 1, 2) q
        LEFT JOIN (SELECT patch, row, max(k) AS streak FROM (SELECT patch, row, isl, count(*) AS k FROM
          (SELECT *, rn - row_number() OVER (PARTITION BY patch, row ORDER BY col) AS isl FROM
            (SELECT *, row_number() OVER (PARTITION BY patch, row ORDER BY col) AS rn FROM grid_all) WHERE valid AND NOT v > 0)
          GROUP BY 1, 2, 3) GROUP BY 1, 2) s ON s.patch = q.patch AND s.row = q.row""", "grid_all"),
)
def run_acceptance(t: Tables):
    g = t.grid(valid_only=False).withColumn("flag", F.when(F.col("valid"), F.col("v") > 0))
    return rounded(Q.run_acceptance(g, ["patch", "row"], "col", "flag", min_on=0.45), "fraction_on")


@query(
    "tiled_windows",
    with_views(
        """SELECT patch, row, w AS "window", min(o) AS first, max(o) AS last FROM
        (SELECT patch, row, row_number() OVER (PARTITION BY patch, row ORDER BY col) - 1 AS o, (row_number() OVER (PARTITION BY patch, row ORDER BY col) - 1) // 5 AS w FROM grid)
        GROUP BY 1, 2, 3 HAVING count(*) = 5""", "grid"),
)
def tiled_windows(t: Tables):
    w = W.partitionBy("patch", "row").orderBy("col")
    g = t.grid().withColumn("ord", (F.row_number().over(w) - 1).cast("long"))
    return Q.tiled_windows(g, ["patch", "row"], "ord")


NORMALS = {
    "diff": """SELECT *,
      coalesce(CASE WHEN cn = col + 1 AND cp = col - 1 THEN xn - xp END, CASE WHEN cn = col + 1 THEN xn - x END, CASE WHEN cp = col - 1 THEN x - xp END) AS ux,
      coalesce(CASE WHEN cn = col + 1 AND cp = col - 1 THEN yn - yp END, CASE WHEN cn = col + 1 THEN yn - y END, CASE WHEN cp = col - 1 THEN y - yp END) AS uy,
      coalesce(CASE WHEN cn = col + 1 AND cp = col - 1 THEN zn - zp END, CASE WHEN cn = col + 1 THEN zn - z END, CASE WHEN cp = col - 1 THEN z - zp END) AS uz,
      coalesce(CASE WHEN rn = row + 1 AND rp = row - 1 THEN xd - xu END, CASE WHEN rn = row + 1 THEN xd - x END, CASE WHEN rp = row - 1 THEN x - xu END) AS vx,
      coalesce(CASE WHEN rn = row + 1 AND rp = row - 1 THEN yd - yu END, CASE WHEN rn = row + 1 THEN yd - y END, CASE WHEN rp = row - 1 THEN y - yu END) AS vy,
      coalesce(CASE WHEN rn = row + 1 AND rp = row - 1 THEN zd - zu END, CASE WHEN rn = row + 1 THEN zd - z END, CASE WHEN rp = row - 1 THEN z - zu END) AS vz
      FROM (SELECT *, lead(col) OVER h AS cn, lag(col) OVER h AS cp, lead(x) OVER h AS xn, lag(x) OVER h AS xp, lead(y) OVER h AS yn, lag(y) OVER h AS yp,
        lead(z) OVER h AS zn, lag(z) OVER h AS zp, lead(row) OVER k AS rn, lag(row) OVER k AS rp, lead(x) OVER k AS xd, lag(x) OVER k AS xu,
        lead(y) OVER k AS yd, lag(y) OVER k AS yu, lead(z) OVER k AS zd, lag(z) OVER k AS zu FROM grid
        WINDOW h AS (PARTITION BY patch, row ORDER BY col), k AS (PARTITION BY patch, col ORDER BY row))""",
    "crossed": "SELECT *, uy * vz - uz * vy AS cx, uz * vx - ux * vz AS cy, ux * vy - uy * vx AS cz FROM diff",
    "nrm": """SELECT patch, row, col, x, y, z, cx / len AS nx, cy / len AS ny, cz / len AS nz FROM
      (SELECT *, nullif(sqrt(cx * cx + cy * cy + cz * cz), 0.0) AS len FROM crossed) WHERE cx / len IS NOT NULL""",
}


@query("normals", with_views(f"SELECT patch, row, col, {s6('nx')} AS nx, {s6('ny')} AS ny, {s6('nz')} AS nz FROM nrm", "grid", extra=NORMALS))
def normals(t: Tables):
    n = gr.normals(t.grid()).filter("nx is not null")
    return rounded(n.select("patch", "row", "col", "nx", "ny", "nz"), "nx", "ny", "nz")


@query(
    "outward_normals",
    with_views(
        f"""SELECT patch, row, col, {s6('nx * s')} AS nx, {s6('ny * s')} AS ny, {s6('nz * s')} AS nz FROM
        (SELECT *, CASE WHEN sign(nx * (x - 630.0) + ny * (y - 490.0)) = 0 THEN 1.0::DOUBLE ELSE sign(nx * (x - 630.0) + ny * (y - 490.0))::DOUBLE END AS s FROM nrm)""",
        "grid", extra=NORMALS),
)
def outward_normals(t: Tables):
    n = gr.normals(t.grid()).filter("nx is not null")
    s = G.outward_sign([F.col("nx"), F.col("ny")], F.col("x"), F.col("y"), F.lit(630.0), F.lit(490.0))
    return n.withColumn("s", s).select("patch", "row", "col", *[r6(F.col(c) * F.col("s")).alias(c) for c in ("nx", "ny", "nz")])


@query(
    "surface_area",
    with_views(
        f"""SELECT a.patch, {s6('''sum(
          0.5 * sqrt(pow(b.y*0 + (b.y-a.y)*(c.z-a.z) - (b.z-a.z)*(c.y-a.y), 2) + pow((b.z-a.z)*(c.x-a.x) - (b.x-a.x)*(c.z-a.z), 2) + pow((b.x-a.x)*(c.y-a.y) - (b.y-a.y)*(c.x-a.x), 2))
        + 0.5 * sqrt(pow((b.y-d.y)*(c.z-d.z) - (b.z-d.z)*(c.y-d.y), 2) + pow((b.z-d.z)*(c.x-d.x) - (b.x-d.x)*(c.z-d.z), 2) + pow((b.x-d.x)*(c.y-d.y) - (b.y-d.y)*(c.x-d.x), 2)))''')} AS area,
        count(*) AS quads FROM grid a JOIN grid b ON b.patch = a.patch AND b.row = a.row AND b.col = a.col + 1
        JOIN grid c ON c.patch = a.patch AND c.row = a.row + 1 AND c.col = a.col JOIN grid d ON d.patch = a.patch AND d.row = a.row + 1 AND d.col = a.col + 1
        GROUP BY 1""", "grid"),
)
def surface_area(t: Tables):
    return rounded(gr.surface_area(t.grid()), "area")


STEPS = {
    "steps": """SELECT a.patch, 'u' AS axis, a.row, a.col, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS step,
      (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y, (a.z + b.z) / 2 AS z FROM grid a JOIN grid b ON b.patch = a.patch AND b.row = a.row AND b.col = a.col + 1
      UNION ALL SELECT a.patch, 'v', a.row, a.col, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)),
      (a.x + b.x) / 2, (a.y + b.y) / 2, (a.z + b.z) / 2 FROM grid a JOIN grid b ON b.patch = a.patch AND b.row = a.row + 1 AND b.col = a.col""",
}


@query(
    "step_outliers",
    with_views(
        f"""SELECT s.patch, s.axis, s.row, s.col, {s6('step')} AS step, {s6('x')} AS x, {s6('y')} AS y, {s6('z')} AS z, {s6('step / m.med')} AS times
        FROM steps s JOIN (SELECT patch, axis, quantile_cont(step, 0.5) AS med FROM steps GROUP BY 1, 2) m USING (patch, axis) WHERE step > 1.5 * m.med""",
        "grid", extra=STEPS),
)
def step_outliers(t: Tables):
    return rounded(gr.step_outliers(t.grid(), 1.5), "step", "x", "y", "z", "times")


@query(
    "components8",
    with_views(
        """SELECT patch, comp_row, comp_col, count(*) AS n FROM (SELECT patch, row, col, min(r * 1000 + c) // 1000 AS comp_row, min(r * 1000 + c) % 1000 AS comp_col FROM reach GROUP BY 1, 2, 3)
        GROUP BY 1, 2, 3 HAVING count(*) >= 3""", "grid",
        extra={
            "flagged": "SELECT patch, row, col FROM grid WHERE v > 0.15",
            "reach": """SELECT patch, row, col, row AS r, col AS c FROM flagged UNION
              SELECT q.patch, q.row, q.col, f.row, f.col FROM reach q JOIN flagged f ON f.patch = q.patch AND abs(f.row - q.r) <= 1 AND abs(f.col - q.c) <= 1""",
        }),
)
def components8(t: Tables):
    c = grid_components(t.grid().filter("v > 0.15"), min_size=3)
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("n")).selectExpr(
        "component.patch as patch", "component.row as comp_row", "component.col as comp_col", "n"
    )


@query(
    "edge_cells",
    with_views(
        """SELECT DISTINCT patch, r AS row, c AS col FROM (
          SELECT patch, unnest([row, CASE WHEN axis = 'u' THEN row - 1 ELSE row END]) AS r, unnest([col, CASE WHEN axis = 'u' THEN col ELSE col - 1 END]) AS c
          FROM steps WHERE step > 35)""", "grid", extra=STEPS),
)
def edge_cells(t: Tables):
    e = gr.neighbour_steps(t.grid()).filter("step > 35").withColumn("axis", F.when(F.col("axis") == "u", "row").otherwise("col"))
    return edge_flags_to_cells(e)


@query(
    "interpolation",
    f"""WITH k AS (SELECT p_size::DOUBLE AS z, avg(p_retailprice) AS v FROM part GROUP BY 1),
    seg AS (SELECT z AS z0, lead(z) OVER (ORDER BY z) AS z1, v AS v0, lead(v) OVER (ORDER BY z) AS v1 FROM k),
    q AS (SELECT l_quantity, least(greatest(l_quantity, (SELECT min(z) FROM k)), (SELECT max(z) FROM k)) AS z FROM lineitem)
    SELECT l_quantity, count(*) AS n, {s6('min(v0 + (v1 - v0) * (q.z - z0) / (z1 - z0))')} AS value FROM q JOIN seg ON z1 IS NOT NULL AND q.z >= z0
    AND (q.z < z1 OR (q.z = z1 AND z1 = (SELECT max(z) FROM k))) GROUP BY 1""",
)
def interpolation(t: Tables):
    knots = t.read("part").groupBy(F.col("p_size").cast("double").alias("z")).agg(F.avg("p_retailprice").alias("value"))
    q = t.read("lineitem").select("l_quantity")
    out = gr.interpolate(q, "l_quantity", knots, "z", "value", segments_side=8.0)
    return rounded(out.groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("value")), "value")


@query(
    "bbox_overlap",
    with_views(
        """SELECT a.id, b.id AS other FROM bb a JOIN bb b ON a.id < b.id AND b.lx <= a.hx + 5 AND b.hx >= a.lx - 5 AND b.ly <= a.hy + 5 AND b.hy >= a.ly - 5
        AND b.lz <= a.hz + 5 AND b.hz >= a.lz - 5""", "grid",
        extra={"bb": """SELECT patch * 100 + row // 10 * 10 + col // 10 AS id, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz
          FROM grid GROUP BY 1"""}),
)
def bbox_overlap(t: Tables):
    g = t.grid().selectExpr("patch * 100 + row div 10 * 10 + col div 10 as id", "x", "y", "z")
    b = bounding_boxes(g, ["id"])
    out = overlapping_boxes(b, b.withColumnRenamed("id", "other"), pad=5.0, side=400.0)
    return out.filter("id < other").select("id", "other")


@query(
    "local_cloud",
    with_views(
        """SELECT b.patch AS box, count(*) AS n, count(DISTINCT g.patch) AS patches FROM (SELECT patch, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz
          FROM grid GROUP BY patch) b JOIN grid g ON g.patch <> b.patch AND g.x BETWEEN lx - 16 AND hx + 16
          AND g.y BETWEEN ly - 16 AND hy + 16 AND g.z BETWEEN lz - 16 AND hz + 16 GROUP BY 1""", "grid"),
)
def local_cloud(t: Tables):
    """Reference points inside a padded box, without the patches that share the box's lineage."""
    g = t.grid()
    boxes = bounding_boxes(g, ["patch"]).withColumnRenamed("patch", "box")
    near = cloud_near_boxes(boxes, g.select("patch", *XYZ), pad=16.0, side=200.0, box_id="box").filter("patch <> box")
    return near.groupBy("box").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("patch").alias("patches"))


# ------------------------------------------------------------------ sheet stacks
CROSS = {
    **NORMALS,
    "cr": """SELECT *, sqrt(pow(x + t * nx - vx, 2) + pow(y + t * ny - vy, 2) + pow(z + t * nz - vz, 2)) AS lat FROM (
        SELECT u.patch, u.row, u.col, u.x, u.y, u.z, u.nx, u.ny, u.nz, v.patch AS p, v.row AS r, v.col AS c, v.x AS vx, v.y AS vy, v.z AS vz,
          ((v.x - u.x) * v.nx + (v.y - u.y) * v.ny + (v.z - u.z) * v.nz) / (u.nx * v.nx + u.ny * v.ny + u.nz * v.nz) AS t
        FROM nrm u JOIN nrm v ON v.patch <> u.patch AND v.row BETWEEN u.row - 5 AND u.row + 5 AND v.col BETWEEN u.col - 5 AND u.col + 5
        WHERE sqrt((u.x-v.x)*(u.x-v.x) + (u.y-v.y)*(u.y-v.y) + (u.z-v.z)*(u.z-v.z)) <= 100 AND abs(u.nx * v.nx + u.ny * v.ny + u.nz * v.nz) >= 0.5)
        WHERE abs(t) <= 100""",
    "crossings": "SELECT patch, row, col, p, r, c, t, lat FROM cr WHERE lat <= 14",
    "parts": """SELECT *, sum(gap) OVER (PARTITION BY patch, row, col, p ORDER BY t, r, c ROWS UNBOUNDED PRECEDING) AS part FROM (
        SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY patch, row, col, p ORDER BY t, r, c) > 6 THEN 1 ELSE 0 END AS gap FROM crossings)""",
    "best": """SELECT patch, row, col, p, t, lat, r, c FROM (SELECT *, row_number() OVER (PARTITION BY patch, row, col, p, part ORDER BY lat, t, r, c) AS k FROM parts) WHERE k = 1""",
    "ordered": "SELECT *, row_number() OVER (PARTITION BY patch, row, col ORDER BY t, p, r, c) AS rn FROM best",
    "fold": """SELECT patch, row, col, rn, t, 1 AS sheet, [{'p': p, 'r': r, 'c': c}] AS members FROM ordered WHERE rn = 1
        UNION ALL SELECT o.patch, o.row, o.col, o.rn, o.t, CASE WHEN q.same THEN f.sheet ELSE f.sheet + 1 END,
          CASE WHEN NOT q.same THEN [{'p': o.p, 'r': o.r, 'c': o.c}]
               WHEN len(list_filter(f.members, lambda m: m.p = o.p)) = 0 THEN list_append(f.members, {'p': o.p, 'r': o.r, 'c': o.c}) ELSE f.members END
        FROM fold f JOIN ordered o ON o.patch = f.patch AND o.row = f.row AND o.col = f.col AND o.rn = f.rn + 1,
        LATERAL (SELECT o.t - f.t < 8 AND len(list_filter(f.members[1:], lambda m: m.p = o.p AND sqrt(pow(m.r - o.r, 2) + pow(m.c - o.c, 2)) > 30)) = 0 AS same) q""",
    "sheets": "SELECT patch, row, col, sheet, quantile_cont(t, 0.5) AS t, count(*) AS crossings FROM fold GROUP BY 1, 2, 3, 4",
}


def _cloud(t: Tables):
    n = gr.normals(t.grid()).filter("nx is not null").drop("valid", "v")
    return n, n.withColumnsRenamed({"patch": "p", "row": "r", "col": "c"})


@query(
    "line_crossings",
    with_views(f"SELECT patch, row, count(*) AS n, {s6('sum(t)')} AS sum_t, {s6('sum(lat)')} AS sum_lat FROM crossings GROUP BY 1, 2", "grid", extra={k: CROSS[k] for k in (*NORMALS, "cr", "crossings")}),
)
def line_crossings(t: Tables):
    probes, cloud = _cloud(t)
    c = st.line_crossings(probes, cloud)
    return rounded(c.groupBy("patch", "row").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("sum_t"), F.sum("lat").alias("sum_lat")), "sum_t", "sum_lat")


@query(
    "split_crossings",
    with_views(f"SELECT patch, row, col, p, {s6('t')} AS t, {s6('lat')} AS lat, r, c FROM best", "grid", extra={k: v for k, v in CROSS.items() if k not in ("ordered", "fold", "sheets")}),
)
def split_crossings(t: Tables):
    probes, cloud = _cloud(t)
    out = st.split_crossings(st.line_crossings(probes, cloud))
    return rounded(out.select("patch", "row", "col", "p", "t", "lat", "r", "c"), "t", "lat")


@query(
    "sheet_stacks",
    with_views(f"SELECT patch, row, col, sheet::BIGINT AS sheet, {s6('t')} AS t FROM sheets", "grid", extra=CROSS),
)
def sheet_stacks(t: Tables):
    probes, cloud = _cloud(t)
    stack = st.sheet_stacks(probes, cloud)
    out = stack.select("patch", "row", "col", F.posexplode("stack").alias("i", "s"))
    return out.select("patch", "row", "col", (F.col("i") + 1).cast("long").alias("sheet"), r6("s.t").alias("t"))


@query(
    "sheet_assignment",
    with_views(
        f"""SELECT patch, row, col, {s6('off')} AS "offset", {s6('s')} AS spacing,
        CASE WHEN s <= 40 AND s <= 1.5 * med AND off <= 0.25 * s THEN sheet END::BIGINT AS k FROM (
          SELECT *, row_number() OVER (PARTITION BY patch, row, col ORDER BY off, sheet) AS pick FROM (
            SELECT patch, row, col, sheet, abs(t) AS off,
              CASE WHEN lag(t) OVER w IS NULL THEN lead(t) OVER w - t WHEN lead(t) OVER w IS NULL THEN t - lag(t) OVER w ELSE least(t - lag(t) OVER w, lead(t) OVER w - t) END AS s
            FROM sheets WINDOW w AS (PARTITION BY patch, row, col ORDER BY sheet)))
        LEFT JOIN (SELECT patch, row, col, quantile_cont(g, 0.5) AS med FROM (SELECT patch, row, col, lead(t) OVER (PARTITION BY patch, row, col ORDER BY sheet) - t AS g FROM sheets)
          WHERE g IS NOT NULL GROUP BY 1, 2, 3) USING (patch, row, col) WHERE pick = 1""", "grid", extra=CROSS),
)
def sheet_assignment(t: Tables):
    probes, cloud = _cloud(t)
    a = st.assign(st.sheet_stacks(probes, cloud))
    return longs(rounded(a.select("patch", "row", "col", "offset", "spacing", "k"), "offset", "spacing"), "k")


# chain labelling on plain columns: the label is the bucketed value, NULL where the row is unassigned
CHAIN = {
    "src": "SELECT patch, row, col, x, y, z, CASE WHEN abs(v) < 0.16 THEN floor(v * 12)::BIGINT END AS sheet FROM grid",
    "asg": "SELECT *, lag(sheet) OVER (PARTITION BY patch, row ORDER BY col) AS prev FROM src WHERE sheet IS NOT NULL",
    "dl": "SELECT *, CASE WHEN prev IS NULL OR abs(sheet - prev) > 2 THEN NULL ELSE sheet - prev END AS d, row_number() OVER (PARTITION BY patch, row ORDER BY col) AS rn FROM asg",
    "ch": "SELECT *, sum(CASE WHEN rn = 1 OR d IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY patch, row ORDER BY col ROWS UNBOUNDED PRECEDING) - 1 AS chain FROM dl",
    "lb": """SELECT *, sum(CASE WHEN d IS NULL THEN 0 ELSE d END) OVER w AS label, sum(CASE WHEN coalesce(d, 0) <> 0 THEN 1 ELSE 0 END) OVER w AS segment
      FROM ch WINDOW w AS (PARTITION BY patch, row, chain ORDER BY col ROWS UNBOUNDED PRECEDING)""",
    "sg": """SELECT patch, row, chain, segment, min(label) AS label, min(col) AS i0, max(col) AS i1, count(*) AS n, max(x) - min(x) AS length,
      count(*)::DOUBLE / (max(col) - min(col) + 1) AS coverage, coalesce(max(CASE WHEN gap > 1 THEN xgap END), 0.0) AS max_gap FROM (
        SELECT *, col - lag(col) OVER w AS gap, x - lag(x) OVER w AS xgap FROM lb WINDOW w AS (PARTITION BY patch, row, chain, segment ORDER BY col)) GROUP BY 1, 2, 3, 4""",
}


def _chain(t: Tables):
    src = t.grid().selectExpr("patch", "row", "col", "x", "case when abs(v) < 0.16 then cast(floor(v * 12) as bigint) end as sheet").filter("sheet is not null")
    w = W.partitionBy("patch", "row").orderBy("col")
    d = src.withColumn("prev", F.lag("sheet").over(w)).selectExpr("*", "case when abs(sheet - prev) <= 2 then sheet - prev end as delta")
    return Q.chain_labels(d, ["patch", "row"], "col", "delta")


@query("chain_labels", with_views("SELECT patch, row, col, chain::BIGINT AS chain, label::BIGINT AS label, segment::BIGINT AS segment FROM lb", "grid", extra={k: CHAIN[k] for k in ("src", "asg", "dl", "ch", "lb")}))
def chain_labels(t: Tables):
    return longs(_chain(t).select("patch", "row", "col", "chain", "label", "segment"), "chain", "label", "segment")


@query(
    "segments",
    with_views(
        f"""SELECT patch, row, chain::BIGINT AS chain, segment::BIGINT AS segment, label::BIGINT AS label, i0, i1, n, {s6('length')} AS length, {s6('coverage')} AS coverage, {s6('max_gap')} AS max_gap,
        length >= 60 AND coverage >= 0.8 AND max_gap <= 45 AS accepted FROM sg""", "grid", extra=CHAIN),
)
def segments(t: Tables):
    s = Q.segments(_chain(t), ["patch", "row"], "col", "x").withColumn("accepted", Q.segment_ok(60.0, 0.8, 45.0))
    return longs(rounded(s, "length", "coverage", "max_gap"), "chain", "segment", "label")


@query(
    "switches",
    with_views(
        """SELECT patch, row, chain::BIGINT AS chain, segment::BIGINT AS segment, (bl - label)::BIGINT AS delta, i1 AS a_i1, b0 AS b_i0, (ok AND bok) AS both_sides FROM (
          SELECT *, lead(label) OVER w AS bl, lead(n) OVER w AS bn, lead(ok) OVER w AS bok, lead(i0) OVER w AS b0 FROM
            (SELECT *, length >= 20 AND coverage >= 0.8 AND max_gap <= 45 AS ok FROM sg) WINDOW w AS (PARTITION BY patch, row, chain ORDER BY segment))
        WHERE bl IS NOT NULL AND ((bok AND n >= 2) OR (ok AND bn >= 2))""", "grid", extra=CHAIN),
)
def switches(t: Tables):
    s = Q.switches(Q.segments(_chain(t), ["patch", "row"], "col", "x"), ["patch", "row"], 20.0, 0.8, 45.0)
    return longs(s.select("patch", "row", "chain", "segment", "delta", "a_i1", "b_i0", "both_sides"), "chain", "segment", "delta")


@query(
    "attach",
    with_views(
        f"""SELECT point_id, patch, row, col, {s6('nd')} AS nd FROM (SELECT *, row_number() OVER (PARTITION BY point_id, patch ORDER BY nd, rk) AS k FROM (
          SELECT point_id, patch, row, col, rk, abs(al) AS nd, sqrt(pow(dx - al * nx, 2) + pow(dy - al * ny, 2) + pow(dz - al * nz, 2)) AS lat FROM (
            SELECT *, dx * nx + dy * ny + dz * nz AS al, row_number() OVER (PARTITION BY point_id, patch ORDER BY dist, row, col) AS rk FROM (
              SELECT p.point_id, p.patch, g.row, g.col, p.x - g.x AS dx, p.y - g.y AS dy, p.z - g.z AS dz, g.nx, g.ny, g.nz,
                sqrt((p.x-g.x)*(p.x-g.x) + (p.y-g.y)*(p.y-g.y) + (p.z-g.z)*(p.z-g.z)) AS dist
              FROM pts p JOIN nrm g USING (patch) WHERE sqrt((p.x-g.x)*(p.x-g.x) + (p.y-g.y)*(p.y-g.y) + (p.z-g.z)*(p.z-g.z)) <= 16.5)) WHERE rk <= 4)
          WHERE nd <= 2.5 AND lat <= 14) WHERE k = 1""", "pt", "grid",
        extra={**NORMALS, "pts": "SELECT event_id AS point_id, event_id % (SELECT max(vec_id) // 50 + 1 FROM embeddings) AS patch, x * 2.5 AS x, y * 1.3 AS y, 30.0::DOUBLE * (event_id % (SELECT max(vec_id) // 50 + 1 FROM embeddings)) + (z - 50) / 5 AS z FROM pt WHERE kind = 'view'"}),
)
def attach(t: Tables):
    n, _ = _cloud(t)
    pts = t.pt().filter("kind = 'view'").selectExpr("event_id as point_id", f"event_id % {t.surfaces()} as patch", "x * 2.5D as x", "y * 1.3D as y", f"30D * (event_id % {t.surfaces()}) + (z - 50) / 5 as z")
    return rounded(st.attach(pts, n), "nd")


def _wrapped(t: str) -> str:
    return f"({t} + pi() - 2 * pi() * floor(({t} + pi()) / (2 * pi())) - pi())"


@query(
    "unwrapped_angle",
    # the field is smooth, so every component keeps it up to the whole turns of its first vertex
    with_views(
        f"""SELECT s.patch, s.row, s.col, {s6(_wrapped('raw'))} AS theta, {s6(f"raw + {_wrapped('raw0')} - raw0")} AS unwrapped FROM (
          SELECT s.*, s.x / 150.0 + s.y / 97.0 AS raw, 20.0::DOUBLE * (c % 1000) / 150.0 + 20.0::DOUBLE * (c // 1000) / 97.0 AS raw0 FROM seg s
          JOIN (SELECT patch, row, start, min(c) AS c FROM reach GROUP BY 1, 2, 3) USING (patch, row, start)) s""", "grid",
        extra={
            "isl": "SELECT patch, row, col, x, y, col - row_number() OVER (PARTITION BY patch, row ORDER BY col) AS isl FROM grid",
            "seg": "SELECT *, min(col) OVER (PARTITION BY patch, row, isl) AS start FROM isl",
            "tie": "SELECT DISTINCT a.patch, a.row AS r1, a.start AS s1, b.row AS r2, b.start AS s2 FROM seg a JOIN seg b ON b.patch = a.patch AND b.row = a.row + 1 AND b.col = a.col",
            "link": "SELECT * FROM tie UNION ALL SELECT patch, r2, s2, r1, s1 FROM tie",
            "reach": """SELECT DISTINCT patch, row, start, row * 1000 + start AS c FROM seg UNION
              SELECT t.patch, t.r2, t.s2, q.c FROM reach q JOIN link t ON t.patch = q.patch AND t.r1 = q.row AND t.s1 = q.start""",
        }),
)
def unwrapped_angle(t: Tables):
    g = t.grid().withColumn("theta", G.wrap_angle(F.col("x") / 150.0 + F.col("y") / 97.0))
    u = gr.unwrap_angle(g, "theta")
    return u.select("patch", "row", "col", r6("theta").alias("theta"), r6("unwrapped").alias("unwrapped"))


@query(
    "winding_mismatch",
    with_views(
        """SELECT patch, kind, a, b, mismatch FROM (SELECT p.patch, p.kind, p.event_id AS a, q.event_id AS b,
          round_even((q.w - p.w) + ((q.th - p.th + pi()) - 2 * pi() * floor((q.th - p.th + pi()) / (2 * pi())) - pi()) / (2 * pi()) - (q.u - p.u) / (2 * pi()), 0)::BIGINT AS mismatch
          FROM an p JOIN an q ON q.patch = p.patch AND q.kind = p.kind AND p.event_id < q.event_id) WHERE mismatch <> 0""", "pt",
        extra={"an": """SELECT event_id, patch, kind, y / 20 AS u, (y / 20 + pi()) - 2 * pi() * floor((y / 20 + pi()) / (2 * pi())) - pi() AS th,
          floor(y / 20 / (2 * pi()) + 0.5) + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END + CASE WHEN event_id % 5 = 0 THEN 0.25 ELSE 0 END AS w FROM pt"""}),
)
def winding_mismatch(t: Tables):
    """Annotated points whose winding numbers disagree with the unwrapped surface angle."""
    a = t.pt().selectExpr("event_id as point_id", "patch", "kind", "y / 20 as unwrapped").withColumn("theta", G.wrap_angle(F.col("unwrapped"))).withColumn("component", F.lit(0))
    w = F.floor(F.col("unwrapped") / (2 * F.pi()) + 0.5) + F.when(F.col("point_id") % 97 == 0, 1).otherwise(0) + F.when(F.col("point_id") % 5 == 0, 0.25).otherwise(0.0)
    return st.winding_mismatches(a.withColumn("w", w.cast("double")), ["kind"]).select("patch", "kind", "a", "b", "mismatch")


@query(
    "grid_edges_near_events",
    with_views(
        f"""SELECT e.event_id, {s6('max(s.step)')} AS max_score, count(*) AS n FROM (SELECT event_id, event_id % (SELECT max(vec_id) // 50 + 1 FROM embeddings) AS patch, x * 2.5 AS x, y * 1.3 AS y, 30.0::DOUBLE * (event_id % (SELECT max(vec_id) // 50 + 1 FROM embeddings)) + (z - 50) / 5 AS z
          FROM ev WHERE status = 'confirmed') e JOIN steps s USING (patch)
        WHERE sqrt((e.x-s.x)*(e.x-s.x) + (e.y-s.y)*(e.y-s.y) + (e.z-s.z)*(e.z-s.z)) <= 30 GROUP BY 1""", "ev", "grid", extra=STEPS),
)
def grid_edges_near_events(t: Tables):
    """Largest edge score within a radius of every event (the ball maximum behind the miss classes)."""
    ev = t.gt_event().filter("status = 'confirmed'").selectExpr("event_id", f"event_id % {t.surfaces()} as patch", "x * 2.5D as x", "y * 1.3D as y", f"30D * (event_id % {t.surfaces()}) + (z - 50) / 5 as z")
    p = pairs_within(ev, gr.neighbour_steps(t.grid()), 30.0, keys=["patch"])
    return p.groupBy("event_id").agg(r6(F.max("step")).alias("max_score"), F.count(F.lit(1)).alias("n"))
