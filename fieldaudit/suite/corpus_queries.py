"""Source, adapter, check and corpus queries over documents and tables that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.score import event_hits, off_surface
from ..sources import adapters as ad
from ..sources import alarms as al
from ..sources import corpus as co
from ..sources import listing as li
from .base import Tables, query, r6, rounded, s6, with_views

DAY = "cast(floor(y / 24) as bigint)"


def documents(t: Tables, kinds: str, body: str, item: str):
    """One JSON document per (patch, day) built from the events: (patch, part, doc).

    ``item`` is collected into the array ``items``; a document holds one day of one patch.
    """
    d = t.pt().filter(f"kind in ({kinds})").selectExpr("patch", f"{DAY} as part", "event_id", "kind", "x", "y", "z")
    g = d.groupBy("patch", "part").agg(F.expr(f"transform(array_sort(collect_list(struct(event_id, {item} as v))), s -> s.v) as items"))
    return g.selectExpr("patch", "part", f"to_json({body}) as doc")


REPORT = """named_struct('findings', array(named_struct('code', 'coherent-normal-step', 'level', if(patch % 3 = 0, 'info', 'review'))),
  'geometry', named_struct('coherent_normal_steps', named_struct('candidate_edge_examples', transform(items, i -> named_struct('rc', i)))))"""
RC = "array(event_id % 50, event_id % 64)"


@query(
    "adapter_review_cues",
    with_views(
        """SELECT DISTINCT patch, row, col FROM (SELECT patch, event_id % 50 AS row, event_id % 64 AS col FROM pt WHERE kind = 'error' AND patch % 3 <> 0
        UNION ALL SELECT patch, event_id % 50, event_id % 64 FROM pt WHERE kind = 'click')""", "pt"),
)
def adapter_review_cues(t: Tables):
    report = documents(t, "'error'", REPORT, RC)
    side = documents(t, "'click'", "named_struct('arrays', named_struct('coherent_normal_step_cells', items))", RC)
    return ad.review_cues(report, side)[1].select("patch", "row", "col")


@query("adapter_review_counts", with_views("SELECT patch, count(*) FILTER (patch % 3 <> 0) AS n FROM pt WHERE kind = 'error' GROUP BY 1", "pt"))
def adapter_review_counts(t: Tables):
    """Cells per patch from the report alone; patches whose cue was not raised keep a clean verdict."""
    verdict, alarm = ad.review_cues(documents(t, "'error'", REPORT, RC))
    n = alarm.groupBy("patch").agg(F.count(F.lit(1)).alias("n"))
    return verdict.join(n, "patch", "left").select("patch", F.coalesce("n", F.lit(0)).alias("n"))


def _xyz(t, alarm):
    return rounded(alarm.select("patch", "x", "y", "z"), "x", "y", "z")


POINT = f"{s6('x')} AS x, {s6('y')} AS y, {s6('z')} AS z"


@query("adapter_collections", with_views(f"SELECT patch, {POINT} FROM pt WHERE kind = 'view'", "pt"))
def adapter_collections(t: Tables):
    body = "named_struct('collections', map('a', named_struct('points', map_from_entries(items))))"
    return _xyz(t, ad.point_collections(documents(t, "'view'", body, "struct(cast(event_id as string) as k, named_struct('p', array(x, y, z)) as v)"))[1])


@query("adapter_contacts", with_views(f"SELECT patch, {POINT} FROM pt WHERE kind = 'view' UNION ALL SELECT patch, {s6('x + 1')}, {s6('y')}, {s6('z')} FROM pt WHERE kind = 'view' AND event_id % 4 <> 0", "pt"))
def adapter_contacts(t: Tables):
    item = "named_struct('xyz1', array(x, y, z), 'xyz2', if(event_id % 4 = 0, null, array(x + 1, y, z)))"
    return _xyz(t, ad.contacts(documents(t, "'view'", "named_struct('transverse_both', size(items), 'contacts', items)", item))[1])


@query("adapter_pairs", with_views(f"SELECT patch, {POINT} FROM pt WHERE kind = 'click' UNION ALL SELECT patch, {s6('x')}, {s6('y + 2')}, {s6('z')} FROM pt WHERE kind = 'click'", "pt"))
def adapter_pairs(t: Tables):
    return _xyz(t, ad.flagged_pairs(documents(t, "'click'", "named_struct('alarms', items)", "named_struct('xyz_p', array(x, y, z), 'xyz_q', array(x, y + 2, z))"))[1])


@query("adapter_gated_steps", with_views(f"SELECT patch, {POINT} FROM pt WHERE kind = 'signup' AND (patch + floor(y / 24)::BIGINT) % 4 < 2", "pt"))
def adapter_gated_steps(t: Tables):
    body = "named_struct('verdict', element_at(array('REVIEW', 'WATCH', 'OK', 'SPARSE'), cast((patch + part) % 4 as int) + 1), 'flagged_steps', items)"
    return _xyz(t, ad.gated_steps(documents(t, "'signup'", body, "named_struct('xyz', array(x, y, z))"))[1])


@query(
    "adapter_changed_edges",
    with_views(
        f"""SELECT e.rp AS patch, {s6('g.x')} AS x, {s6('g.z')} AS z, count(*) AS n FROM (SELECT *, patch % (SELECT max(vec_id) // 50 + 1 FROM embeddings) AS rp, event_id % 40 AS a, event_id % 37 AS b FROM pt WHERE kind = 'view') e
        JOIN grid g ON g.patch = e.rp AND g.row = floor(CASE WHEN e.event_id % 3 = 0 THEN e.x / 8 ELSE e.x / 9 END) AND g.col = floor(e.y / 12)
        WHERE e.event_id % 3 < 2 AND EXISTS (SELECT 1 FROM pt c WHERE c.kind = 'click' AND c.patch % (SELECT max(vec_id) // 50 + 1 FROM embeddings) = e.rp AND c.patch = e.patch
          AND least(c.event_id % 37, c.event_id % 40) = least(a, b) AND greatest(c.event_id % 37, c.event_id % 40) = greatest(a, b)) GROUP BY 1, 2, 3""", "pt", "grid"),
)
def adapter_changed_edges(t: Tables):
    v = t.pt().filter("kind = 'view'")
    edges = v.selectExpr(
        f"cast(patch % {t.surfaces()} as bigint) as run_patch", "event_id as edge_ord", "cast(patch as string) as pcl_id", "event_id % 40 as from_point_id", "event_id % 37 as to_point_id",
        f"case event_id % 3 when 0 then patch % {t.surfaces()} else -1L end as P", f"case event_id % 3 when 1 then patch % {t.surfaces()} else -2L end as R",
        "array(x / 8, y / 12) as from_ij", "array(x / 9, y / 12) as to_ij")
    after = t.pt().filter("kind = 'click'").selectExpr(f"cast(patch % {t.surfaces()} as bigint) as run_patch", "cast(patch as string) as rel_pcl_id", "event_id % 37 as from_point_id", "event_id % 40 as to_point_id")
    _, alarm = ad.changed_edges(edges, after, edges.select(F.col("run_patch").alias("patch")).distinct(), t.grid())
    return alarm.groupBy("patch", r6("x").alias("x"), r6("z").alias("z")).agg(F.count(F.lit(1)).alias("n"))


@query("adapter_count_check", with_views("SELECT patch, n AS n_reported, n - CASE WHEN patch % 7 = 0 THEN 1 ELSE 0 END AS n_extracted FROM (SELECT patch, count(*) + CASE WHEN patch % 7 = 0 THEN 1 ELSE 0 END AS n FROM pt WHERE kind = 'view' GROUP BY 1) WHERE patch % 7 = 0", "pt"))
def adapter_count_check(t: Tables):
    """Patches whose extracted alarms differ from the counter in the report."""
    v = t.pt().filter("kind = 'view'").select("patch")
    rep = v.groupBy("patch").agg(F.count(F.lit(1)).alias("n")).selectExpr("patch", "n + if(patch % 7 = 0, 1, 0) as n_reported")
    return ad.count_mismatches(v, rep).select("patch", "n_reported", "n_extracted")


# ------------------------------------------------------------------ alarm inputs
def entries(t: Tables, point: str, kinds: str = "'error', 'click'"):
    """(detector, patch, points): per detector and (patch, day) one list; patches % 5 = 0 are null, % 5 = 1 empty."""
    d = t.pt().filter(f"kind in ({kinds})").selectExpr("kind as detector", f"concat(patch, '_', {DAY}) as patch", "patch as p", "event_id", "x", "y", "z")
    g = d.groupBy("detector", "patch", "p").agg(F.expr(f"to_json(transform(array_sort(collect_list(struct(event_id, {point} as v))), s -> s.v)) as l"))
    return g.selectExpr("detector", "patch", "case p % 5 when 0 then null when 1 then '[]' else l end as points")


@query(
    "alarm_source_xyz",
    with_views(
        f"""SELECT detector, v.patch, a.x, a.y, a.z FROM (SELECT DISTINCT kind AS detector, patch || '_' || floor(y / 24)::BIGINT AS patch FROM pt WHERE kind IN ('error', 'click') AND patch % 5 <> 0) v
        LEFT JOIN (SELECT kind AS detector, patch || '_' || floor(y / 24)::BIGINT AS patch, {POINT} FROM pt WHERE kind IN ('error', 'click') AND patch % 5 > 1) a USING (detector, patch)""", "pt"),
)
def alarm_source_xyz(t: Tables):
    """Lists, empty lists (clean verdicts) and nulls (no verdict) in one input; clean verdicts keep a row."""
    a = al.xyz_alarms(entries(t, "array(x, y, z)"))
    return rounded(a.verdicts.join(a.alarms, ["detector", "patch"], "left").select("detector", "patch", "x", "y", "z"), "x", "y", "z")


@query("alarm_format", "SELECT event_type AS detector, CASE event_type WHEN 'error' THEN 'xyz' WHEN 'click' THEN 'grid' ELSE 'mixed' END AS format FROM events WHERE event_type IN ('error', 'click', 'signup') GROUP BY 1")
def alarm_format(t: Tables):
    point = "case detector when 'error' then array(x, y, z) when 'click' then array(x, y) else if(event_id % 2 = 0, array(x, y), array(x, y, z)) end"
    e = entries(t, point, "'error', 'click', 'signup'")
    return al.detect_format(al.parse_points(e))


@query(
    "alarm_violations",
    with_views(
        """SELECT patch, CASE event_id % 6 WHEN 0 THEN 'not a list' WHEN 1 THEN 'wrong number of coordinates' WHEN 2 THEN 'not an integer' WHEN 3 THEN 'outside the grid' WHEN 4 THEN 'not a number' END AS reason
        FROM pt WHERE kind = 'error' AND event_id % 6 < 5""", "pt"),
)
def alarm_violations(t: Tables):
    """Malformed grid inputs of every kind, one entry per event."""
    e = t.pt().filter("kind = 'error'").selectExpr(
        "'d' as detector", "patch",
        """case event_id % 6 when 0 then '"text"' when 1 then '[[1, 2, 3]]' when 2 then '[[5.5, 3]]' when 3 then '[[99, 10]]' when 4 then '[["a", 1]]' else '[[1, 2], [3, 4]]' end as points""")
    shapes = t.pt().select("patch").distinct().selectExpr("patch", "50L as height", "64L as width")
    return al.input_violations(e, "grid", shapes).select("patch", "reason")


@query("alarm_source_grid", with_views(f"SELECT count(*) FILTER (x IS NULL AND p < (SELECT max(vec_id) // 50 + 1 FROM embeddings)) AS dropped, count(x) AS kept, {s6('sum(g.z)')} AS z FROM (SELECT patch % (SELECT max(vec_id) // 50 + 3 FROM embeddings) AS p, event_id % 50 AS row, event_id % 64 AS col FROM pt WHERE kind = 'error') a LEFT JOIN grid g ON g.patch = a.p AND g.row = a.row AND g.col = a.col", "grid", "pt"))
def alarm_source_grid(t: Tables):
    """Grid alarms on invalid vertices are dropped and counted; those of unknown patches are neither."""
    pts = t.pt().filter("kind = 'error'").selectExpr("'d' as detector", f"patch % {t.surfaces() + 2} as patch", "event_id as alarm_ord", "event_id % 50 as row", "event_id % 64 as col")
    kept, dropped = al.on_grid(pts, t.grid(), t.grid().select("patch"))
    return dropped.select(F.col("dropped_invalid").alias("dropped")).crossJoin(kept.agg(F.count(F.lit(1)).alias("kept"), r6(F.sum("z")).alias("z")))  # single rows


@query("alarm_source_masks", with_views("SELECT g.patch, count(*) FILTER (valid AND v > 0.1) AS n, count(*) FILTER (NOT valid AND v > 0.1) AS invalid FROM grid_all g GROUP BY 1", "grid_all"))
def alarm_source_masks(t: Tables):
    g = t.grid(valid_only=False)
    m = g.filter("v > 0.1").selectExpr("'m' as detector", "patch", "row", "col")
    a, _ = al.mask_alarms(m, g.selectExpr("'m' as detector", "patch").distinct(), t.grid(), t.grid().select("patch"))
    kept = a.alarms.groupBy("patch").agg(F.count(F.lit(1)).alias("n"))
    total = m.groupBy("patch").agg(F.count(F.lit(1)).alias("all"))
    out = a.verdicts.join(kept, "patch", "left").join(total, "patch", "left").na.fill(0)
    return out.select("patch", "n", (F.col("all") - F.col("n")).alias("invalid"))


@query(
    "same_scores_across_formats",
    with_views(
        """SELECT f.source, count(DISTINCT (e.patch, e.row, e.col)) AS hits FROM grid e JOIN grid a ON a.patch = e.patch AND a.v > 0.17
        AND sqrt((e.x-a.x)*(e.x-a.x) + (e.y-a.y)*(e.y-a.y) + (e.z-a.z)*(e.z-a.z)) <= 22 CROSS JOIN (VALUES ('grid'), ('mask'), ('xyz')) f(source) WHERE e.v < -0.15 GROUP BY 1""", "grid"),
)
def same_scores_across_formats(t: Tables):
    """Hits from coordinates, from a grid list and from a mask of the same vertices."""
    g = t.grid()
    flagged = g.filter("v > 0.17")
    rc = flagged.selectExpr("'grid' as detector", "patch", "row * 64 + col as alarm_ord", "row", "col")
    xyz = flagged.selectExpr("'xyz' as detector", "patch", "row * 64 + col as alarm_ord", "x", "y", "z")
    grid, _ = al.on_grid(rc, g, g.select("patch"))
    mask, _ = al.mask_alarms(rc.selectExpr("'mask' as detector", "patch", "row", "col"), rc.selectExpr("'mask' as detector", "patch"), g, g.select("patch"))
    ev = g.filter("v < -0.15").selectExpr("patch * 100000 + row * 64 + col as event_id", "patch", "x", "y", "z")
    hits = event_hits(ev, xyz.unionByName(grid).unionByName(mask.alarms), 22.0)
    return hits.groupBy(F.col("detector").alias("source")).agg(F.count(F.lit(1)).alias("hits"))


@query("off_surface", with_views(
    """SELECT kind AS detector, count(*) AS alarms_off_surface FROM (SELECT *, patch % (SELECT max(vec_id) // 50 + 1 FROM embeddings) AS p FROM pt WHERE kind IN ('error', 'click')) a
    WHERE NOT EXISTS (SELECT 1 FROM grid g WHERE g.patch = a.p AND abs(g.x - a.x) <= 10 AND abs(g.y - a.y) <= 10 AND sqrt((g.x-a.x)*(g.x-a.x) + (g.y-a.y)*(g.y-a.y) + (g.z-(30*a.p+a.z/5))*(g.z-(30*a.p+a.z/5))) <= 10) GROUP BY 1""", "pt", "grid"))
def q_off_surface(t: Tables):
    from ..plans.score import Benchmark

    a = t.pt().filter("kind in ('error', 'click')").selectExpr("kind as detector", f"patch % {t.surfaces()} as patch", "event_id as alarm_ord", "x", "y", f"30 * (patch % {t.surfaces()}) + z / 5 as z")
    ev = a.selectExpr("alarm_ord as event_id", "patch", "'confirmed' as status")
    b = Benchmark(ev, a, ev.selectExpr("event_id as run_id", "patch", "status"), a, a, surface=t.grid().select("patch", "x", "y", "z"))
    return off_surface(b, a, 10.0)


# ------------------------------------------------------------------ labelled corpus on the grid
def corpus(t: Tables):
    """Events with one transition each, and runs, derived from the vertex grid."""
    g = t.grid()
    ev = g.filter("v > 0.15").selectExpr(
        "patch * 100000 + row * 64 + col as event_id", "patch", "case when col % 3 = 0 then 'contradicted' else 'confirmed' end as status",
        "array(x + 10, y, if(col % 11 = 0, z, null)) as xyz0", "array(named_struct('axis', 'row', 'rc_a', array(row, col), 'rc_b', array(row, col + 1), 'len_a_mm', 1D, 'len_b_mm', 1D)) as transitions")
    return ev, g


@query(
    "event_centres",
    with_views(
        f"""SELECT a.patch * 100000 + a.row * 64 + a.col AS event_id, {s6('(a.x + b.x) / 2')} AS x, {s6('(a.y + b.y) / 2')} AS y, {s6('(a.z + b.z) / 2')} AS z FROM grid a
        LEFT JOIN grid b ON b.patch = a.patch AND b.row = a.row AND b.col = a.col + 1 WHERE a.v > 0.15""", "grid"),
)
def event_centres(t: Tables):
    ev, g = corpus(t)
    return rounded(co.event_points(ev, g).filter("pt_ord = -1").select("event_id", "x", "y", "z"), "x", "y", "z")


@query(
    "geometry_violations",
    with_views(
        """SELECT kind, id, reason FROM (
          SELECT 'event' AS kind, a.patch * 100000 + a.row * 64 + a.col AS id, CASE WHEN b.x IS NULL THEN 'vertex outside the grid or invalid' END AS reason
            FROM grid a LEFT JOIN grid b ON b.patch = a.patch AND b.row = a.row AND b.col = a.col + 1 WHERE a.v > 0.15
          UNION ALL SELECT 'event', a.patch * 100000 + a.row * 64 + a.col, CASE WHEN abs((a.z + b.z) / 2 - a.z) > 0.050001 THEN 'centre differs from the grid' END
            FROM grid a JOIN grid b ON b.patch = a.patch AND b.row = a.row AND b.col = a.col + 1 WHERE a.v > 0.15
          UNION ALL SELECT 'run', r.patch * 100 + r.row, CASE WHEN count(*) < 6 THEN 'vertex outside the grid or invalid' END FROM grid r WHERE col BETWEEN 10 AND 15 GROUP BY r.patch, r.row
          UNION ALL SELECT 'run', p.patch * 100 + p.row, CASE WHEN n IS NULL THEN 'vertex outside the grid or invalid' END FROM (SELECT DISTINCT patch, row FROM grid_all) p
            LEFT JOIN (SELECT patch, row, count(*) AS n FROM grid WHERE col BETWEEN 10 AND 15 GROUP BY 1, 2) q USING (patch, row)
          UNION ALL SELECT DISTINCT 'run', patch * 100 + row, 'length differs from the grid' FROM grid WHERE col BETWEEN 10 AND 15 AND row % 7 = 0
          UNION ALL SELECT 'run', patch * 100 + row, 'end differs from the grid' FROM grid WHERE col = 15 AND row % 11 = 0
        ) WHERE reason IS NOT NULL""", "grid"),
)
def geometry_violations(t: Tables):
    """Stored corpus values against the grid: bad vertices, displaced centres (the fixture stores a wrong z), run lengths and
    ends (every seventh row stores a length, every eleventh an end that is off by one)."""
    g = t.grid(valid_only=False)
    a = t.grid()
    ev = a.filter("v > 0.15").selectExpr(
        "patch * 100000 + row * 64 + col as event_id", "patch", "'confirmed' as status", "array(x + 10, y, z) as xyz",
        "array(named_struct('axis', 'row', 'rc_a', array(row, col), 'rc_b', array(row, col + 1), 'len_a_mm', 1D, 'len_b_mm', 1D)) as transitions")
    span = F.array_sort(F.collect_list(F.when(F.col("valid") & F.col("col").between(10, 15), F.struct("col", "x", "y", "z"))))
    steps = "transform(sequence(2, size(p)), i -> sqrt(pow(p[i - 1].x - p[i - 2].x, 2) + pow(p[i - 1].y - p[i - 2].y, 2) + pow(p[i - 1].z - p[i - 2].z, 2)))"
    end = "transform(filter(p, q -> q.col = {c}), q -> array(q.x, q.y, q.z + {dz}))"
    runs = g.groupBy("patch", "row").agg(span.alias("p")).selectExpr(
        "patch * 100 + row as run_id", "patch", "'confirmed' as status", "'row' as axis", "row as r0", "10L as c0", "row as r1", "15L as c1",
        f"if(size(p) < 2, 0D, aggregate({steps}, 0D, (a, s) -> a + s)) + if(row % 7 = 0, 1, 0) as len_mm",
        f"get({end.format(c=10, dz='0')}, 0) as xyz0", f"get({end.format(c=15, dz='if(row % 11 = 0, 1, 0)')}, 0) as xyz1")
    return co.geometry_violations(ev, runs, g, 1.0)


@query("structural_violations", with_views("SELECT 'event' AS kind, event_id AS id, CASE event_id % 4 WHEN 0 THEN 'no status' WHEN 1 THEN 'no transitions' WHEN 2 THEN 'transition without rc_a or rc_b' END AS reason FROM pt WHERE kind = 'purchase' AND event_id % 4 < 3", "pt"))
def structural_violations(t: Tables):
    tr = "named_struct('axis', 'row', 'rc_a', {a}, 'rc_b', array(1L, 3L), 'len_a_mm', 1D, 'len_b_mm', 1D)"
    ev = t.pt().filter("kind = 'purchase'").selectExpr(
        "event_id", "patch", "if(event_id % 4 = 0, null, 'confirmed') as status",
        f"case event_id % 4 when 1 then slice(array({tr.format(a='array(1L, 2L)')}), 1, 0) when 2 then array({tr.format(a='cast(null as array<bigint>)')}) else array({tr.format(a='array(1L, 2L)')}) end as transitions")
    runs = t.pt().filter("kind = 'view'").selectExpr("event_id as run_id", "patch", "'confirmed' as status", "'row' as axis", "1L as r0", "1L as c0", "1L as r1", "5L as c1")
    return co.structural_violations(ev, runs)


@query("positional_join", with_views("SELECT patch, i, CASE WHEN event_id % 50 = 0 THEN 'no verdict' ELSE 'displaced' END AS reason FROM (SELECT *, event_id AS i FROM ev) WHERE event_id % 50 = 0 OR event_id % 33 = 0", "ev"))
def positional_join(t: Tables):
    """Second verdicts joined by position: missing and displaced rows are reported."""
    ev = t.gt_event().selectExpr("patch", "event_id as i", "x", "y", "z", "status")
    second = ev.filter("i % 50 <> 0").selectExpr("patch", "i", "if(i % 33 = 0, x + 0.1, x) as x", "y", "z", "'confirmed' as status_new")
    return co.override_status(ev, second)[1]


@query("stratum_keys", with_views("SELECT patch || '|' || printf('%.1f,%.1f,%.1f', x, y, z) AS key, CASE WHEN x > 50 THEN 'abrupt' ELSE 'gradual' END AS stratum FROM (SELECT patch, event_id, round(x) / 2 AS x, round(y) / 2 AS y, z FROM ev WHERE event_id % 7 <> 0)", "ev"))
def stratum_keys(t: Tables):
    e = t.gt_event().selectExpr("patch", "event_id", "round(x) / 2 as x", "round(y) / 2 as y", "z").selectExpr("patch", "array(x, y, z) as xyz", "if(event_id % 7 = 0, null, x > 50) as flag")
    return co.build_strata(e, F.col("flag"))[0].select("key", "stratum")


@query("corpus_rows", f"SELECT event_id, patch, status, {s6('round(x, 1)')} AS x, n, signs FROM (SELECT o_orderkey AS event_id, any_value(o_custkey) AS patch, any_value(o_orderstatus) AS status, any_value(o_totalprice) AS x, count(*) AS n, string_agg(DISTINCT l_linenumber % 2, ',' ORDER BY l_linenumber % 2) AS signs FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def corpus_rows(t: Tables):
    """Publishable event rows with nested, ordered transitions."""
    o = t.read("orders").selectExpr("o_orderkey as event_id", "o_custkey as patch", "o_orderstatus as status", "o_totalprice as x", "0D as y", "0D as z")
    m = t.read("lineitem").selectExpr("l_orderkey as event_id", "l_linenumber as ord", "'row' as axis", "1L as ra", "2L as ca", "1L as rb", "3L as cb", "l_quantity as len_a", "l_tax as len_b", "l_linenumber % 2 as delta")
    d = co.corpus_document(o, m)
    return d.select("event_id", "patch", "status", r6(F.col("xyz")[0]).alias("x"), F.size("transitions").cast("long").alias("n"), F.array_join(F.transform("delta_signs", lambda v: v.cast("string")), ",").alias("signs"))


@query(
    "fingerprint_equal",
    with_views(
        "SELECT sha256(string_agg(b || ':' || h, ';' ORDER BY b)) AS sha, TRUE AS same, FALSE AS same_if_changed FROM blocks", "grid_all",
        extra={
            "cells": """SELECT patch, row, col, col || ',' || CASE WHEN valid THEN round(x * 1000000)::BIGINT || ',' || round(y * 1000000)::BIGINT || ',' || round(z * 1000000)::BIGINT ELSE '-' END AS c FROM grid_all""",
            "rows_": "SELECT patch, row, sha256(string_agg(c, ';' ORDER BY col)) AS h FROM cells GROUP BY 1, 2",
            "patches_": "SELECT patch, sha256(string_agg(row || ':' || h, ';' ORDER BY row)) AS h FROM rows_ GROUP BY 1",
            "blocks": "SELECT substr(md5(patch::VARCHAR), 1, 3) AS b, sha256(string_agg(patch || ':' || h, ';' ORDER BY patch::VARCHAR)) AS h FROM patches_ GROUP BY 1",
        }),
)
def fingerprint_equal(t: Tables):
    """The content hash; it does not depend on row order and changes with one vertex."""
    g = t.grid(valid_only=False)
    a = co.fingerprint(g)
    b = co.fingerprint(g.repartition(17)).withColumnRenamed("sha", "b")
    one = (F.col("row") == 1) & (F.col("col") == 1) & (F.col("patch") == 1)
    moved = g.withColumn("z", F.when(one, F.lit(0.5)).otherwise(F.col("z"))).withColumn("valid", one | F.col("valid"))
    c = co.fingerprint(moved).withColumnRenamed("sha", "c")
    return a.crossJoin(b).crossJoin(c).select("sha", (F.col("sha") == F.col("b")).alias("same"), (F.col("sha") == F.col("c")).alias("same_if_changed"))  # single rows


@query(
    "listing",
    """SELECT state, count(*) AS files, coalesce(sum(b), 0)::BIGINT AS bytes FROM (SELECT CASE WHEN r IS NULL THEN CASE WHEN f < 3 THEN 'lost' ELSE 'absent' END WHEN l = r THEN 'have' WHEN m = r THEN 'copy' ELSE 'get' END AS state, r AS b FROM (
          SELECT f, CASE WHEN f = 3 AND c % 2 = 0 THEN NULL WHEN f = 1 AND c % 97 = 0 THEN NULL ELSE 100 + c % 13 END AS r, CASE WHEN c % 3 = 0 THEN 100 + c % 13 WHEN c % 3 = 1 THEN 1 END AS l, CASE WHEN c % 5 = 0 THEN 100 + c % 13 END AS m
          FROM (SELECT c_custkey AS c FROM customer), (SELECT unnest(range(4)) AS f))) GROUP BY 1""",
)
def listing(t: Tables):
    """Wanted files against a remote, a local and a mirror listing."""
    c = t.read("customer").selectExpr("c_custkey as c")
    want = li.wanted(c.selectExpr("c as patch"))
    files = c.selectExpr("c", "100 + c % 13 as b", "posexplode(array('x.tif', 'y.tif', 'z.tif', 'mask.tif')) as (f, file)")
    remote = files.filter("not (f = 3 and c % 2 = 0) and not (f = 1 and c % 97 = 0)").selectExpr("c as patch", "file", "b as bytes")
    local = files.filter("c % 3 < 2").selectExpr("c as patch", "file", "if(c % 3 = 0, b, 1L) as bytes")
    mirror = files.filter("c % 5 = 0").selectExpr("c as patch", "file", "b as bytes")
    return li.transfer_summary(li.reconcile(want, remote, local, mirror))


@query("bytes_per_patch", "SELECT avg(b) AS bytes_per_patch FROM (SELECT source, sum(n_chars)::DOUBLE AS b FROM documents GROUP BY 1)")
def bytes_per_patch(t: Tables):
    return li.bytes_per_patch(t.read("documents").selectExpr("source as patch", "n_chars as bytes"))


@query("resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume(t: Tables):
    """Work items without a finished output row."""
    return co.unfinished(t.read("orders").select("o_orderkey"), t.read("lineitem").selectExpr("l_orderkey as o_orderkey"), ["o_orderkey"])


@query("in_sample", with_views(f"SELECT patch, assigned, valid, {s6('assigned::DOUBLE / greatest(1, valid)')} AS share FROM (SELECT patch, count(*) FILTER (valid AND v > 0.12) AS assigned, count(*) FILTER (valid) AS valid FROM grid_all GROUP BY 1) WHERE assigned::DOUBLE / greatest(1, valid) >= 0.05", "grid_all"))
def in_sample(t: Tables):
    """Patches with at least five percent of their valid vertices assigned."""
    a = t.grid(valid_only=False).groupBy("patch").agg(F.count_if(F.col("valid") & (F.col("v") > 0.12)).alias("assigned"), F.count_if("valid").alias("valid"))
    share = F.col("assigned") / F.greatest(F.lit(1), F.col("valid"))
    return rounded(a.withColumn("share", share).filter("share >= 0.05"), "share")


# ------------------------------------------------------------------ further sources and lookups
@query("annotation_points", with_views(f"SELECT CASE WHEN event_id % 2 = 0 THEN 'same_windings' ELSE 'relative_windings' END AS file, event_id::VARCHAR AS point_id, {POINT}, CASE WHEN event_id % 2 = 0 THEN 0.0::DOUBLE WHEN event_id % 3 = 0 THEN NULL ELSE z END AS w FROM pt WHERE kind = 'view'", "pt"))
def annotation_points(t: Tables):
    """Annotated points of two files; the winding is 0 in one of them and may be missing in the other."""
    from .. import schema

    item = "struct(cast(event_id as string) as k, named_struct('p', array(x, y, z), 'wind_a', if(event_id % 3 = 0, null, z)) as v)"
    body = "named_struct('collections', map('c', named_struct('points', map_from_entries(items))))"
    docs = {}
    for name, rest in (("same_windings", 0), ("relative_windings", 1)):
        half = Tables(t.spark, t.sf_dir)
        half.__dict__["_pt"] = t.pt().filter(f"event_id % 2 = {rest}")
        docs[name] = documents(half, "'view'", body, item).select(F.from_json("doc", schema.COLLECTIONS).alias("d")).select("d.*")
    return rounded(co.annotation_points(docs).select("file", "point_id", "x", "y", "z", "w"), "x", "y", "z", "w")


@query(
    "segment_points",
    with_views(
        f"""SELECT event_id, i.i AS i, {s6('x + i.i / 19.0::DOUBLE * (nx - x)')} AS x, {s6('y + i.i / 19.0::DOUBLE * (ny - y)')} AS y FROM
        (SELECT event_id, x, y, x + 10 AS nx, y * 2 AS ny FROM pt WHERE kind = 'signup') p, (SELECT unnest(range(20)) AS i) i""", "pt"),
)
def segment_points(t: Tables):
    from ..functions.geometry import segment_points as points

    d = t.pt().filter("kind = 'signup'").selectExpr("event_id", "struct(x, y, z) as p", "struct(x + 10 as x, y * 2 as y, z as z) as q")
    out = d.select("event_id", F.posexplode(points(F.col("p"), F.col("q"))).alias("i", "s"))
    return out.select("event_id", F.col("i").cast("long").alias("i"), r6("s.x").alias("x"), r6("s.y").alias("y"))


@query("model_footprint", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_size ELSE greatest(p_size, 3 * p_size, 64) END::BIGINT AS side, CASE WHEN p_partkey % 3 = 0 THEN (2 ** (p_partkey % 4))::BIGINT ELSE 1 END AS down FROM part")
def model_footprint(t: Tables):
    """Sides and downsampling written in file names."""
    from ..functions.text import model_footprint as footprint

    d = t.read("part").selectExpr("p_partkey", "concat(if(p_partkey % 5 = 0, concat('betti_ema_', p_size, '_forward'), concat('pred_ps', p_size, '_', 3 * p_size, '_64')), if(p_partkey % 3 = 0, concat('_scale', p_partkey % 4), '')) as name")
    side, down = footprint(F.col("name"))
    return d.select("p_partkey", side.alias("side"), down.alias("down"))


@query(
    "trilinear_lookup",
    with_views(
        f"""SELECT p.event_id, {s6('sum(CASE a.a WHEN 1 THEN fz ELSE 1 - fz END * CASE b.b WHEN 1 THEN fy ELSE 1 - fy END * CASE c.c WHEN 1 THEN fx ELSE 1 - fx END * greatest(0, least(255, floor(127.5 + 300 * e.embedding[((iz + a.a) * 4 + iy + b.b) * 4 + ix + c.c + 1]::DOUBLE))))')} AS value
        FROM (SELECT event_id, event_id % (SELECT max(vec_id) + 1 FROM embeddings) AS vec, (event_id % 3)::BIGINT AS iz, (event_id % 2)::BIGINT AS iy, ((event_id // 7) % 3)::BIGINT AS ix, (event_id % 10) / 10.0::DOUBLE AS fz, (event_id % 7) / 7.0::DOUBLE AS fy, (event_id % 9) / 9.0::DOUBLE AS fx FROM pt) p
        JOIN embeddings e ON e.vec_id = p.vec, (VALUES (0), (1)) a(a), (VALUES (0), (1)) b(b), (VALUES (0), (1)) c(c) GROUP BY 1""", "pt"),
)
def trilinear_lookup(t: Tables):
    """Points in landed byte chunks (an embedding is one 4 x 4 x 4 chunk)."""
    from ..operators.profile import sample_volume

    byte = "lpad(hex(cast(greatest(0, least(255, floor(127.5 + 300 * cast(v as double)))) as bigint)), 2, '0')"
    chunks = t.read("embeddings").selectExpr("vec_id as cz", "0L as cy", "0L as cx", f"unhex(concat_ws('', transform(embedding, v -> {byte}))) as bytes")
    pts = t.pt().selectExpr(
        "event_id as point_id", "(event_id div 7) % 3 + (event_id % 9) / 9D as x", "event_id % 2 + (event_id % 7) / 7D as y", f"(event_id % {t.vectors()}) * 4 + event_id % 3 + (event_id % 10) / 10D as z")
    return sample_volume(pts, chunks, edge=4).select(F.col("point_id").alias("event_id"), r6("value").alias("value"))


@query(
    "independence",
    with_views(
        f"""SELECT patch, count(*) AS n, {s6('quantile_cont(d, 0.5)')} AS median, {s6('avg((d <= 8)::INT)')} AS share, count(*) >= 50 AND (quantile_cont(d, 0.5) < 9 OR avg((d <= 8)::INT) >= 0.5) AS dependent FROM (
          SELECT u.patch, u.row, u.col, min(sqrt((u.x-v.x)*(u.x-v.x) + (u.y-v.y)*(u.y-v.y) + (u.z-v.z)*(u.z-v.z))) AS d FROM grid u JOIN grid v ON v.patch = u.patch + 1 AND v.row BETWEEN u.row - 1 AND u.row + 1 AND v.col BETWEEN u.col - 1 AND u.col + 1
          GROUP BY 1, 2, 3) WHERE d <= 20 GROUP BY 1""", "grid"),
)
def independence(t: Tables):
    """Offset of every patch to the next reference layer within a bound, and whether it copies that layer."""
    from ..operators.spatial import nearest
    from ..operators.stats import independence as rule

    g = t.grid()
    near = nearest(g, g.withColumn("patch", F.col("patch") - 1), ["patch", "row", "col"], ["patch"], top_side=160.0, bound=20.0)
    return rounded(rule(near, "nearest", ["patch"], reach=9.0, close=8.0), "median", "share")
