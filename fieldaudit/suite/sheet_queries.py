"""Sheets followed along runs: tracks, transition metrics, noise of negatives and the labelled runs behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import follow as fo
from ..operators import grid as gr
from ..operators import stacks as st
from ..operators import stats as sa
from ..session import cut_lineage
from .base import Tables, query, rounded, s6, with_views
from .grid_queries import CROSS, NORMALS, STEPS, XYZ, _cloud

_AXES = {
    "row": "SELECT patch, row, col, x, y, z, 'row' AS axis, row AS line, col AS along FROM nrm",
    "col": "SELECT patch, row, col, x, y, z, 'col', col, row FROM nrm",
}


def _same(a: str, at_a: str, b: str, at_b: str) -> str:
    """SQL: two member lists share a patch close enough for the distance of their grid positions."""
    apart = f"sqrt(pow({at_a}.r - {at_b}.r, 2) + pow({at_a}.c - {at_b}.c, 2))"
    return f"len(list_filter({a}, lambda u: len(list_filter({b}, lambda v: v.p = u.p AND sqrt(pow(v.r - u.r, 2) + pow(v.c - u.c, 2)) <= 1.5 * {apart} + 3)) > 0)) > 0"


def _find(sheet: str, at: str, stack: str, here: str) -> str:
    found = f"list_filter(range(1, len({stack}) + 1), lambda j: {_same(sheet, at, f'{stack}[j].m', here)})"
    return f"list_min({found})"


def _count(stack: str, j: str, k: str) -> str:
    gaps = f"list_transform(range(least({j}, {k}), greatest({j}, {k})), lambda i: {stack}[i + 1].t - {stack}[i].t)"
    local = f"coalesce(least({stack}[{k}].t - {stack}[{k} - 1].t, {stack}[{k} + 1].t - {stack}[{k}].t), list_min({gaps}))"
    wraps = f"list_sum(list_transform({gaps}, lambda g: greatest(1, round_even(g / {local}, 0)::BIGINT)))"
    return f"CASE WHEN {j} IS NULL THEN NULL WHEN {j} = {k} THEN 0 WHEN {k} > {j} THEN {wraps} ELSE -{wraps} END"


#: Stacks, assignment, runs of both axes, chains and segments, as :func:`stacks.label_surfaces` makes them.
LABELS = {
    **CROSS,
    "sheetm": "SELECT patch, row, col, sheet, quantile_cont(t, 0.5) AS t, arg_max(members, rn) AS m FROM fold GROUP BY 1, 2, 3, 4",
    "stk": "SELECT patch, row, col, list({'t': t, 'm': m} ORDER BY sheet) AS st FROM sheetm GROUP BY 1, 2, 3",
    "near": """SELECT *, list_position(list_transform(st, lambda s: abs(s.t)), list_min(list_transform(st, lambda s: abs(s.t)))) AS k0,
      list_min(list_transform(st, lambda s: abs(s.t))) AS off FROM stk""",
    "gapped": """SELECT *, least(st[k0].t - st[k0 - 1].t, st[k0 + 1].t - st[k0].t) AS spacing,
      list_aggregate(list_transform(range(1, len(st)), lambda i: st[i + 1].t - st[i].t), 'median') AS med FROM near""",
    "asgn": "SELECT patch, row, col, st, spacing, CASE WHEN spacing <= 40 AND spacing <= 1.5 * med AND off <= 0.25 * spacing THEN k0 END AS k FROM gapped",
    "vert": " UNION ALL ".join(_AXES.values()),
    "isl": "SELECT *, along - row_number() OVER (PARTITION BY patch, axis, line ORDER BY along) AS isl FROM vert",
    "vrun": """SELECT *, row_number() OVER w - 1 AS pos, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS step FROM
      (SELECT *, concat_ws(':', axis, line, isl) AS run FROM isl) WINDOW w AS (PARTITION BY patch, run ORDER BY along)""",
    "arcs": "SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY patch, run ORDER BY along ROWS UNBOUNDED PRECEDING) * 0.0096 AS arc FROM vrun",
    "placed": "SELECT a.patch, a.row, a.col, a.axis, a.run, a.pos, a.arc, {'r': a.row, 'c': a.col} AS rc, s.st, s.spacing, s.k FROM arcs a JOIN asgn s USING (patch, row, col)",
    "pairs": """SELECT *, lag(st) OVER w AS pst, lag(k) OVER w AS pk, lag(rc) OVER w AS prc, row_number() OVER w AS rn FROM placed WHERE k IS NOT NULL
      WINDOW w AS (PARTITION BY patch, run ORDER BY pos)""",
    "found": f"""SELECT *, {_same('pst[pk].m', 'prc', 'st[k].m', 'rc')} AS same, {_find('pst[pk].m', 'prc', 'st', 'rc')} AS j1, {_find('st[k].m', 'rc', 'pst', 'prc')} AS j2
      FROM pairs WHERE rn > 1""",
    "counted": f"SELECT *, {_count('st', 'j1', 'k')} AS d1, {_count('pst', 'j2', 'pk')} AS d2 FROM found",
    "moved": """SELECT patch, axis, run, pos, arc, CASE WHEN same THEN 0 WHEN d1 = 0 OR d2 = 0 THEN 0 WHEN d1 = -d2 THEN d1 END AS d FROM counted
      UNION ALL SELECT patch, axis, run, pos, arc, NULL FROM pairs WHERE rn = 1""",
    "chained": "SELECT *, sum((d IS NULL)::INT) OVER (PARTITION BY patch, run ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS chain FROM moved",
    "labelled": """SELECT *, sum(coalesce(d, 0)) OVER w AS label, sum((coalesce(d, 0) <> 0)::INT) OVER w AS segment FROM chained
      WINDOW w AS (PARTITION BY patch, run, chain ORDER BY pos ROWS UNBOUNDED PRECEDING)""",
    "segm": """SELECT patch, axis, run, chain, segment, min(label) AS label, min(pos) AS i0, max(pos) AS i1, count(*) AS n, max(arc) - min(arc) AS length,
      count(*)::DOUBLE / (max(pos) - min(pos) + 1) AS coverage, coalesce(max(CASE WHEN gap > 1 THEN arc_gap END), 0.0) AS max_gap FROM (
        SELECT *, pos - lag(pos) OVER w AS gap, arc - lag(arc) OVER w AS arc_gap FROM labelled WINDOW w AS (PARTITION BY patch, run, chain, segment ORDER BY pos))
      GROUP BY 1, 2, 3, 4, 5""",
}


def following(tracks: str) -> dict[str, str]:
    """SQL views that follow ``tracks(track, patch, run, p0, p1, k0)``; ``seen(track, pos, j, t)`` is the outcome."""
    again = f"CASE WHEN k.crc <> k.orc THEN {_find('k.om', 'k.orc', 's.st', 's.rc')} END"
    return {
        "tracks": tracks,
        "span": """SELECT t.track, p.pos, p.st, p.rc, t.k0, row_number() OVER (PARTITION BY t.track ORDER BY abs(p.pos - t.p0)) AS rn, p.pos = t.p0 AS first
          FROM tracks t JOIN placed p ON p.patch = t.patch AND p.run = t.run AND p.pos BETWEEN least(t.p0, t.p1) AND greatest(t.p0, t.p1)""",
        "walk": f"""SELECT track, rn, pos, st[k0].m AS om, rc AS orc, {_find('st[k0].m', 'rc', 'st', 'rc')} AS j, st AS cst, st[{_find('st[k0].m', 'rc', 'st', 'rc')}].m AS cm, rc AS crc
          FROM span WHERE rn = 1 AND first AND k0 <= len(st)
          UNION ALL SELECT track, rn, pos, om, orc, j, cst, CASE WHEN j IS NULL THEN pm ELSE cst[j].m END, CASE WHEN j IS NULL THEN lrc ELSE rc END FROM (
            SELECT s.track, s.rn, s.pos, k.om, k.orc, coalesce({_find('k.cm', 'k.crc', 's.st', 's.rc')}, {again}) AS j, s.st AS cst, s.rc, k.cm AS pm, k.crc AS lrc
            FROM walk k JOIN span s ON s.track = k.track AND s.rn = k.rn + 1)""",
        "seen": "SELECT track, pos, j, cst[j].t AS t FROM walk WHERE j IS NOT NULL",
    }


#: The first assigned sheet of every run, to the run's end.
FIRST = """SELECT patch || '/' || run AS track, patch, run, p0, p1, k0 FROM (
  SELECT patch, run, min(pos) FILTER (k IS NOT NULL) AS p0, max(pos) AS p1, arg_min(k, pos) FILTER (k IS NOT NULL) AS k0 FROM placed GROUP BY 1, 2) WHERE p0 IS NOT NULL"""
MEMBERS = {
    "steps": STEPS["steps"],
    "adjacent": """SELECT * FROM (SELECT patch, run, i1 AS pos_a, lead(i0) OVER w AS pos_b, lead(label) OVER w - label AS delta FROM segm
      WINDOW w AS (PARTITION BY patch, run, chain ORDER BY segment)) WHERE pos_b IS NOT NULL""",
    # every third declared with another step count
    "declared": """SELECT concat_ws('/', patch, run, pos_a) AS member, patch, run, pos_a, pos_b, delta + (pos_a % 3 = 2)::INT AS delta, pos_a % 3 <> 2 AS reproduced
      FROM adjacent WHERE delta <> 0""",
    "located": """SELECT d.*, a.k AS k_a, b.k AS k_b, b.spacing AS spacing_b, b.arc - a.arc AS width_mm FROM declared d JOIN placed a ON a.patch = d.patch AND a.run = d.run AND a.pos = d.pos_a
      JOIN placed b ON b.patch = d.patch AND b.run = d.run AND b.pos = d.pos_b""",
}
SIDES = """SELECT 'a:' || member AS track, patch, run, pos_a AS p0, pos_b AS p1, k_a AS k0 FROM located WHERE reproduced
  UNION ALL SELECT 'b:' || member, patch, run, pos_b, pos_a, k_b FROM located WHERE reproduced"""
METRICS = {
    "off": """SELECT l.member, l.pos_a, l.pos_b, p.pos, p.arc, -a.t * sign(b.t - a.t) AS o, abs(b.t - a.t) AS gap FROM located l
      JOIN seen a ON a.track = 'a:' || l.member JOIN seen b ON b.track = 'b:' || l.member AND b.pos = a.pos AND b.j <> a.j
      JOIN placed p ON p.patch = l.patch AND p.run = l.run AND p.pos = a.pos""",
    "moves": """SELECT *, pos - lag(pos) OVER w AS n, arc - lag(arc) OVER w AS mm, abs(o - lag(o) OVER w) AS d,
      abs(f - lag(f) OVER w) * 0.5 * (gap + lag(gap) OVER w) AS sf FROM (SELECT *, CASE WHEN gap > 0 THEN o / gap END AS f FROM off) WINDOW w AS (PARTITION BY member ORDER BY pos)""",
    "measured": """SELECT member, coalesce(max(n) > 1, FALSE) OR min(pos) <> min(pos_a) OR max(pos) <> max(pos_b) AS partial, count(*) AS n_defined, count(n) AS n_step_measurements,
      max(gap) FILTER (pos = pos_a) AS gap_a, max(gap) FILTER (pos = pos_b) AS gap_b, max(o) FILTER (pos = pos_a) AS o_a, max(o) FILTER (pos = pos_b) AS o_b,
      max(f) FILTER (pos = pos_a) AS f_a, max(f) FILTER (pos = pos_b) AS f_b, max(d / n) AS max_step, max(d / nullif(mm, 0)) AS max_rate, max(sf / n) AS max_step_sf, max(sf / nullif(mm, 0)) AS max_rate_sf
      FROM moves GROUP BY 1""",
    "zone": """SELECT l.member, max(s.step) AS score FROM located l JOIN arcs v ON v.patch = l.patch AND v.run = l.run AND v.pos BETWEEN l.pos_a - 1 AND l.pos_b
      JOIN arcs w ON w.patch = v.patch AND w.run = v.run AND w.pos = v.pos + 1
      JOIN steps s ON s.patch = v.patch AND s.row = v.row AND s.col = v.col AND s.axis = CASE WHEN v.axis = 'row' THEN 'u' ELSE 'v' END WHERE l.reproduced GROUP BY 1""",
}
_REAL = ["width_mm", "spacing_b", "gap_a", "gap_b", "o_a", "o_b", "f_a", "f_b", "total_offset", "total_sf", "max_step", "max_rate", "max_step_sf", "max_rate_sf", "zone_score", "zone_voxels"]


_METRICS = """SELECT l.member, l.delta, l.reproduced, l.pos_b - l.pos_a AS n_steps, l.width_mm, CASE WHEN l.reproduced THEN coalesce(m.partial, FALSE) END AS partial,
            CASE WHEN l.reproduced THEN coalesce(m.n_defined, 0) END AS n_defined, CASE WHEN l.reproduced THEN coalesce(m.n_step_measurements, 0) END AS n_step_measurements,
            CASE WHEN l.reproduced THEN l.spacing_b END AS spacing_b, m.gap_a, m.gap_b, m.o_a, m.o_b, m.f_a, m.f_b, m.o_b - m.o_a AS total_offset, 0.5 * (m.gap_a + m.gap_b) * (m.f_b - m.f_a) AS total_sf,
            m.max_step, m.max_rate, m.max_step_sf, m.max_rate_sf, z.score AS zone_score, 20 * z.score AS zone_voxels
          FROM located l LEFT JOIN measured m USING (member) LEFT JOIN zone z USING (member)"""


def _labels(t: Tables, rules: st.Rules = st.Rules()) -> st.Labels:
    """The labels of the surfaces against each other; the vertices with their normals are kept, since stacks and runs read them."""
    probes = cut_lineage(_cloud(t)[0])
    return st.label_surfaces(probes, probes.withColumnsRenamed({"patch": "p", "row": "r", "col": "c"}), rules)


def _placed(t: Tables) -> tuple[DataFrame, st.Labels]:
    """Placed stacks along both axes, and the labels."""
    labels = _labels(t)
    return st.on_runs(labels.runs, labels.assigned), labels


@query(
    "labelled_segments",
    with_views(
        f"""SELECT patch, axis, run, chain::BIGINT AS chain, segment::BIGINT AS segment, label::BIGINT AS label, i0::INT AS i0, i1::INT AS i1, n, {s6('length')} AS length, {s6('coverage')} AS coverage,
        {s6('max_gap')} AS max_gap FROM segm""", "grid", extra=LABELS),
)
def labelled_segments(t: Tables):
    """Sheet chains of every run: segments with their relative label, coverage and longest gap."""
    seg = _labels(t).segments
    return rounded(seg.select("patch", "axis", "run", "chain", "segment", "label", "i0", "i1", "n", "length", "coverage", "max_gap"), "length", "coverage", "max_gap")


@query(
    "labelled_switches",
    with_views(
        f"""SELECT patch, cluster, count(*) AS members, {s6('avg(x)')} AS x, {s6('avg(y)')} AS y, {s6('avg(z)')} AS z FROM det
        JOIN (SELECT id, min(c) AS cluster FROM hop GROUP BY 1) USING (id) GROUP BY 1, 2""", "grid",
        extra={
            **LABELS,
            "ahead": """SELECT *, lead(label) OVER w - label AS delta, lead(n) OVER w AS bn, lead(ok) OVER w AS bok, lead(i0) OVER w AS b0 FROM
              (SELECT *, coverage >= 0.8 AND max_gap <= 1.0 AS ok FROM segm) WINDOW w AS (PARTITION BY patch, run, chain ORDER BY segment)""",
            "det": """SELECT s.patch, concat_ws('|', s.patch, s.run, s.chain, s.segment) AS id, (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y, (a.z + b.z) / 2 AS z FROM ahead s
              JOIN arcs a ON a.patch = s.patch AND a.run = s.run AND a.pos = s.i1 JOIN arcs b ON b.patch = s.patch AND b.run = s.run AND b.pos = s.b0
              WHERE abs(delta) = 1 AND ((bok AND n >= 2) OR (ok AND bn >= 2))""",
            "hop": """SELECT id, id AS c, patch, x, y, z FROM det UNION
              SELECT d.id, h.c, d.patch, d.x, d.y, d.z FROM hop h JOIN det d ON d.patch = h.patch AND sqrt(pow(d.x - h.x, 2) + pow(d.y - h.y, 2) + pow(d.z - h.z, 2)) < 1 / 0.0096""",
        }),
)
def labelled_switches(t: Tables):
    """Clustered switch events of the labelled surfaces (permissive lengths for the noisy fixture)."""
    rules = st.Rules(event_mm=0.0)
    ev = _labels(t, rules).events(rules)
    return rounded(ev.select("patch", "cluster", "members", *XYZ), *XYZ)


@query(
    "followed_sheet",
    with_views(f"SELECT track, pos::BIGINT AS pos, j::BIGINT AS j, {s6('t')} AS t FROM seen", "grid", extra={**LABELS, **following(FIRST)}),
)
def followed_sheet(t: Tables):
    """The first assigned sheet of every run, followed to the run's end."""
    placed, _ = _placed(t)
    first = placed.groupBy("patch", "run").agg(
        F.min_by(F.struct("pos", "k"), F.when(F.col("k").isNotNull(), F.col("pos"))).alias("s"), F.max("pos").alias("p1")).filter("s IS NOT NULL")
    tracks = first.select(F.concat_ws("/", "patch", "run").alias("track"), "patch", "run", F.col("s.pos").alias("p0"), "p1", F.col("s.k").alias("k0"))
    return rounded(fo.follow_sheets(tracks, placed, ["track"]).withColumn("j", F.col("j").cast("long")), "t")


def _metrics(t: Tables) -> DataFrame:
    placed, labels = _placed(t)
    segments = cut_lineage(labels.segments)  # read by the members and by the metrics
    m = fo.transitions(segments).filter("delta <> 0").select(
        F.concat_ws("/", "patch", "run", "pos_a").alias("member"), "patch", "run", "pos_a", "pos_b", (F.col("delta") + (F.col("pos_a") % 3 == 2).cast("long")).alias("delta"))
    axis = F.when(F.col("axis") == "u", "row").otherwise("col").alias("axis")
    scores = gr.neighbour_steps(t.grid()).select("patch", axis, "row", "col", F.col("step").alias("score"), F.lit(20.0).alias("ref"))
    return fo.transition_metrics(m, placed, segments, fo.run_edges(labels.runs, scores))


@query(
    "transition_metrics",
    with_views(
        f"""SELECT member, delta::BIGINT AS delta, reproduced, n_steps::BIGINT AS n_steps, partial, n_defined, n_step_measurements, {', '.join(f'{s6(c)} AS {c}' for c in _REAL)} FROM ({_METRICS})""",
        "grid", extra={**LABELS, **MEMBERS, **following(SIDES), **METRICS}),
)
def transition_metrics(t: Tables):
    """Every change of sheet along a run, measured; some are declared with a wrong step count and stay unmeasured."""
    out = _metrics(t)
    return rounded(out.select("member", "delta", "reproduced", "n_steps", "partial", "n_defined", "n_step_measurements", *_REAL).withColumn("n_steps", F.col("n_steps").cast("long")), *_REAL)


_MEDIANS = ["max_step", "max_step_sf", "total_offset", "total_sf", "gap_a", "gap_b", "spacing_b"]
_MOST = ["max_step", "max_step_sf", "max_rate", "max_rate_sf", "zone_score", "zone_voxels"]


@query(
    "event_rollup",
    with_views(
        f"""SELECT event, n_members, n_reproduced, {s6('width_median')} AS width_median, {s6('steps_median')} AS steps_median, steps_min::BIGINT AS steps_min, {', '.join(f'{s6(c)} AS {c}' for c in _MOST)},
        {', '.join(f'{s6(c + "_median")} AS {c}_median' for c in _MEDIANS)}, n_step_measurements, any_partial, max_step >= 6 AS abrupt_planned, max_step_sf >= 6 AS abrupt_sf,
        max_step_median >= 6 AS abrupt_median_planned, max_step_sf_median >= 6 AS abrupt_median_sf, steps_median <= 1 AS one_step, zone_score >= 32 AS planted_level, zone_score >= 20 AS candidate FROM (
          SELECT member.split('/')[1] AS event, count(*) AS n_members, count(*) FILTER (used) AS n_reproduced, median(width_mm) FILTER (used) AS width_median, median(n_steps) FILTER (used) AS steps_median,
            min(n_steps) FILTER (used) AS steps_min, {', '.join(f'max({c}) FILTER (used) AS {c}' for c in _MOST)}, {', '.join(f'median({c}) FILTER (used) AS {c}_median' for c in _MEDIANS)},
            coalesce(sum(n_step_measurements) FILTER (used), 0)::BIGINT AS n_step_measurements, coalesce(bool_or(partial) FILTER (used), FALSE) AS any_partial
          FROM (SELECT *, reproduced AND n_steps < 20 AS used FROM ({_METRICS})) GROUP BY 1) WHERE n_reproduced > 0""",
        "grid", extra={**LABELS, **MEMBERS, **following(SIDES), **METRICS}),
)
def event_rollup(t: Tables):
    """The measured changes of every patch as one event, changes over twenty steps and more left out."""
    members = _metrics(t).withColumn("event", F.split("member", "/")[0])
    out = fo.event_rollup(members, keep=F.col("n_steps") < 20, planted=32.0, candidate=20.0)
    real = ["width_median", "steps_median", *_MOST, *[f"{c}_median" for c in _MEDIANS]]
    return rounded(out.drop("width_min").withColumn("steps_min", F.col("steps_min").cast("long")), *real)


@query(
    "layer_spacing",
    with_views(
        f"""SELECT count(*) AS n, {s6('quantile_cont(gap, 0.1)')} AS p0, {s6('quantile_cont(gap, 0.5)')} AS p1, {s6('quantile_cont(gap, 0.9)')} AS p2 FROM (
          SELECT arg_min(gap, (dist, r, c)) AS gap FROM (
            SELECT u.patch, u.row, u.col, v.row AS r, v.col AS c, abs((v.x - u.x) * v.nx + (v.y - u.y) * v.ny + (v.z - u.z) * v.nz) AS gap,
              sqrt((u.x-v.x)*(u.x-v.x) + (u.y-v.y)*(u.y-v.y) + (u.z-v.z)*(u.z-v.z)) AS dist
            FROM nrm u JOIN nrm v ON v.patch = u.patch + 1 AND v.row BETWEEN u.row - 4 AND u.row + 4 AND v.col BETWEEN u.col - 4 AND u.col + 4)
          WHERE dist < 80 GROUP BY patch, row, col)""", "grid", extra=NORMALS),
)
def layer_spacing(t: Tables):
    """Percentiles of the spacing between neighbouring surfaces, over all their vertices."""
    probes, _ = _cloud(t)
    out = fo.layer_spacing(probes.withColumnRenamed("patch", "layer"))
    return rounded(out, "p0", "p1", "p2")


#: Runs of eight positions and more serve as negatives: followed from their first assigned position, with the sheet beside.
NEGATIVES = {
    "neg": f"""SELECT f.*, len(p.st) AS size FROM ({FIRST}) f JOIN placed p ON p.patch = f.patch AND p.run = f.run AND p.pos = f.p0
      WHERE (SELECT max(v.pos) FROM vrun v WHERE v.patch = f.patch AND v.run = f.run) >= 7""",
    **following(
        """SELECT 'a:' || track AS track, patch, run, p0, p1, k0 FROM neg
        UNION ALL SELECT 'b:' || track, patch, run, p0, p1, CASE WHEN k0 < size THEN k0 + 1 ELSE k0 - 1 END FROM neg WHERE size > 1"""),
    "beside": """SELECT a.track[3:] AS negative, a.pos, a.t, CASE WHEN b.j <> a.j THEN abs(b.t - a.t) END AS gap, CASE WHEN b.j <> a.j AND b.t <> a.t THEN -a.t * sign(b.t - a.t) / abs(b.t - a.t) END AS f
      FROM seen a LEFT JOIN seen b ON b.track = 'b:' || a.track[3:] AND b.pos = a.pos WHERE a.track[1] = 'a'""",
    "noise": """SELECT a.negative, a.pos, abs(b.t - a.t) AS step, abs(b.f - a.f) * 0.5 * (a.gap + b.gap) AS step_sf FROM beside a JOIN beside b ON b.negative = a.negative AND b.pos = a.pos + 1""",
}


def _noise(t: Tables) -> DataFrame:
    placed, labels = _placed(t)
    neg = labels.runs.groupBy("patch", "run").agg(F.min("pos").alias("i0"), F.max("pos").alias("i1")).filter("i1 >= 7")
    return fo.negative_noise(neg.withColumn("negative", F.concat_ws("/", "patch", "run")), placed)


@query(
    "negative_noise",
    with_views(f"SELECT negative, pos::BIGINT AS pos, {s6('step')} AS step, {s6('step_sf')} AS step_sf FROM noise", "grid", extra={**LABELS, **NEGATIVES}),
)
def negative_noise(t: Tables):
    """Per-step noise of the followed offset along long runs."""
    return rounded(_noise(t), "step", "step_sf")


@query(
    "negative_noise_floor",
    with_views(
        f"""SELECT {s6('q')} AS q, n_steps, {s6('(SELECT sum(1 - pow(1 - q, n)) FROM (SELECT count(*) AS n FROM noise GROUP BY negative))')} AS expected
        FROM (SELECT avg((step >= 6)::INT) AS q, count(step) AS n_steps FROM noise)""", "grid", extra={**LABELS, **NEGATIVES}),
)
def negative_noise_floor(t: Tables):
    """How many negatives are expected to reach a step of six voxels by noise alone."""
    noise = _noise(t)
    rows = noise.groupBy("negative").agg(F.count("step").alias("n"))
    return rounded(sa.noise_floor(noise, "step", rows, "n", 6.0).select("q", "n_steps", "expected"), "q", "expected")
