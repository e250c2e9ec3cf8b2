"""Queries of the published protocol around the scorer: miss classes, lineage, matched random alarms, batches, checks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks
from ..operators import grid as gr
from ..operators import misses as mi
from ..operators import stacks as st
from ..operators.bootstrap import DRAWS, unmixed_intervals
from ..operators.spatial import bounding_boxes, cloud_near_boxes
from ..plans import matched as ma
from ..plans import robustness as rob
from ..plans.score import event_hits
from ..sources import corpus as co
from ..sources import files
from .base import DEDUP, RADIUS, SEED, VIEWS, Tables, longs, query, r6, rounded, s6, with_views
from .grid_queries import CROSS, STEPS, XYZ, _cloud
from .score_queries import RATES, boot_views, sql_rates

# ------------------------------------------------------------------ miss classes
_EVENT = """SELECT event_id, event_id % (SELECT max(vec_id) // 50 + 1 FROM embeddings) AS patch, x * 2.5 AS x, y * 1.3 AS y,
  30.0::DOUBLE * (event_id % (SELECT max(vec_id) // 50 + 1 FROM embeddings)) + (z - 50) / 5 AS z FROM ev WHERE status = 'confirmed'"""
_APART = "sqrt((e.x-s.x)*(e.x-s.x) + (e.y-s.y)*(e.y-s.y) + (e.z-s.z)*(e.z-s.z))"


@query(
    "miss_classes",
    with_views(
        f"""SELECT e.event_id, {s6('m.score')} AS max_score, coalesce(c.size, 0)::BIGINT AS max_component,
        CASE WHEN m.score IS NULL OR m.score < 38 THEN 'i_subthreshold' WHEN coalesce(c.size, 0) < 4 THEN 'ii_incoherent' ELSE 'iii_coherent' END AS cls
        FROM (SELECT DISTINCT event_id FROM spots) e
        LEFT JOIN (SELECT event_id, max(s.step) AS score FROM spots e JOIN steps s USING (patch) WHERE {_APART} <= 30 GROUP BY 1) m USING (event_id)
        LEFT JOIN (SELECT event_id, max(s.size) AS size FROM spots e JOIN sized s USING (patch) WHERE {_APART} <= 30 GROUP BY 1) c USING (event_id)""",
        "ev", "grid",
        extra={
            **STEPS, "places": _EVENT,
            # an event has two points: where it is and ten further on
            "spots": "SELECT * FROM places UNION ALL SELECT event_id, patch, x + 10, y, z FROM places",
            "flags": """SELECT DISTINCT patch, r AS row, c AS col FROM (
              SELECT patch, unnest([row, CASE WHEN axis = 'u' THEN row - 1 ELSE row END]) AS r, unnest([col, CASE WHEN axis = 'u' THEN col ELSE col - 1 END]) AS c FROM steps WHERE step >= 38)""",
            "whole": """SELECT f.patch, f.row, f.col, avg(g.x) AS x, avg(g.y) AS y, avg(g.z) AS z FROM flags f JOIN grid g ON g.patch = f.patch
              AND g.row BETWEEN f.row AND f.row + 1 AND g.col BETWEEN f.col AND f.col + 1 GROUP BY 1, 2, 3 HAVING count(*) = 4""",
            "reach": """SELECT patch, row, col, row AS r, col AS c FROM whole UNION
              SELECT q.patch, q.row, q.col, f.row, f.col FROM reach q JOIN whole f ON f.patch = q.patch AND abs(f.row - q.r) <= 1 AND abs(f.col - q.c) <= 1""",
            "sized": "SELECT w.*, n.size FROM whole w JOIN (SELECT patch, row, col, count(*) AS size FROM reach GROUP BY 1, 2, 3) n USING (patch, row, col)",
        }),
)
def miss_classes(t: Tables):
    """Best edge score and largest candidate component around every confirmed event, and the class of its miss."""
    n = t.surfaces()
    at = t.gt_event().filter("status = 'confirmed'").selectExpr("event_id", f"event_id % {n} as patch", "x * 2.5D as x", "y * 1.3D as y", f"30D * (event_id % {n}) + (z - 50) / 5 as z")
    spots = at.unionByName(at.withColumn("x", F.col("x") + 10))
    edges = gr.neighbour_steps(t.grid()).withColumnRenamed("step", "score").withColumn("axis", F.when(F.col("axis") == "u", "row").otherwise("col"))
    cells = mi.candidate_cells(edges.select("patch", "axis", "row", "col", "score"), t.grid().select("patch", "row", "col", *XYZ), 38.0)
    out = mi.miss_classes(spots, edges.select("patch", *XYZ, "score"), cells, 30.0, 38.0, 4)
    return longs(rounded(out, "max_score"), "max_component")


# ------------------------------------------------------------------ lineage: two neighbouring patches stem from one growth
KIN = {**CROSS, "cr": CROSS["cr"].replace("ON v.patch <> u.patch", "ON v.patch // 2 <> u.patch // 2")}


def _relatives(t: Tables):
    """Probes and cloud with the growth stem of their patches' names; relatives carry other names."""
    name = F.concat(F.lit("auto_grown_"), F.floor(F.col("patch") / 2).cast("long").cast("string"), F.lit("_sel_"), F.col("patch").cast("string"))
    probes = _cloud(t)[0].withColumn("lineage", T.lineage_stem(name))
    return probes, probes.withColumnsRenamed({"patch": "p", "row": "r", "col": "c"})


@query(
    "lineage_crossings",
    with_views(f"SELECT patch, row, count(*) AS n, {s6('sum(t)')} AS sum_t, {s6('sum(lat)')} AS sum_lat FROM crossings GROUP BY 1, 2", "grid", extra={k: KIN[k] for k in CROSS if k not in ("parts", "best", "ordered", "fold", "sheets")}),
)
def lineage_crossings(t: Tables):
    """Crossings with other surfaces, those of the own growth left out."""
    c = st.line_crossings(*_relatives(t), lineage="lineage")
    return rounded(c.groupBy("patch", "row").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("sum_t"), F.sum("lat").alias("sum_lat")), "sum_t", "sum_lat")


@query(
    "lineage_stacks",
    with_views(f"SELECT patch, row, col, sheet::BIGINT AS sheet, {s6('t')} AS t FROM sheets", "grid", extra=KIN),
)
def lineage_stacks(t: Tables):
    """Sheet stacks over surfaces of other growths only."""
    stack = st.sheet_stacks(*_relatives(t), lineage="lineage")
    out = stack.select("patch", "row", "col", F.posexplode("stack").alias("i", "s"))
    return out.select("patch", "row", "col", (F.col("i") + 1).cast("long").alias("sheet"), r6("s.t").alias("t"))


@query(
    "lineage_cloud",
    with_views(
        """SELECT b.patch AS box, count(*) AS n, count(DISTINCT g.patch) AS patches FROM (SELECT patch, min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz
          FROM grid GROUP BY patch) b JOIN grid g ON g.patch // 2 <> b.patch // 2 AND g.x BETWEEN lx - 16 AND hx + 16
          AND g.y BETWEEN ly - 16 AND hy + 16 AND g.z BETWEEN lz - 16 AND hz + 16 GROUP BY 1""", "grid"),
)
def lineage_cloud(t: Tables):
    """Reference points inside padded boxes of whole surfaces, without those of the box's own growth."""
    points = _named(t)
    boxes = bounding_boxes(points, ["patch", "lineage"]).withColumnRenamed("patch", "box")
    near = cloud_near_boxes(boxes, points, pad=16.0, side=200.0, box_id="box", lineage="lineage")
    return near.groupBy("box").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("patch").alias("patches"))


def _named(t: Tables):
    name = F.concat(F.lit("auto_grown_"), F.floor(F.col("patch") / 2).cast("long").cast("string"), F.lit("_sel_"), F.col("patch").cast("string"))
    return t.grid().select("patch", *XYZ, T.lineage_stem(name).alias("lineage"))


# ------------------------------------------------------------------ random alarms at a matched rate
def _scored_as(tag: str, alarm: str) -> dict[str, str]:
    """The scorer's views over other alarms, under names of their own."""
    views = {"alarm": alarm, **{k: VIEWS[k] for k in ("hit", "ranked", "walk", "kept", "fa")}}
    names = re.compile(r"\b(" + "|".join(views) + r")\b")
    return {tag + k: v if k == "alarm" else names.sub(lambda m: tag + m[0], v) for k, v in views.items()}


def _drawn(tag: str, density: str) -> dict[str, str]:
    """``<tag>draw``: random vertices of scored patches, as :func:`sampling.random_alarms` picks them."""
    seed = f"{SEED}.{tag}"
    return {
        f"{tag}dealt": f"""SELECT p.*, ('0x' || substr(md5('{seed}.share|' || patch || '|' || ord), 1, 8))::BIGINT % s.n AS share FROM places p
          JOIN (SELECT patch, greatest(ceil(count(*) * {density} / 10), 1)::BIGINT AS n FROM places GROUP BY 1) s USING (patch)""",
        f"{tag}size": f"""SELECT patch, share, count(*) * {density} AS mean, ('0x' || substr(md5('{seed}|' || patch || '|' || share), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
          FROM {tag}dealt GROUP BY 1, 2""",
        f"{tag}series": f"""SELECT patch, share, mean, u, 0 AS i, exp(-mean) AS p, exp(-mean) AS c FROM {tag}size
          UNION ALL SELECT patch, share, mean, u, i + 1, p * mean / (i + 1), c + p * mean / (i + 1) FROM {tag}series WHERE i < 120""",
        f"{tag}draw": f"""SELECT v.* FROM (SELECT *, row_number() OVER (PARTITION BY patch, share ORDER BY md5('{seed}.vertex|' || patch || '|' || ord), ord) AS k FROM {tag}dealt) v
          JOIN (SELECT patch, share, count(*) FILTER (u >= c) AS k FROM {tag}series GROUP BY 1, 2) c USING (patch, share) WHERE v.k <= c.k""",
    }


_RATES_OF = """SELECT d.detector, {density} AS density, (SELECT count(DISTINCT h.event_id) FROM {tag}hit h JOIN ev e USING (event_id) WHERE h.detector = d.detector AND e.status = 'confirmed') AS hits,
  (SELECT count(*) FROM ev WHERE status = 'confirmed') AS events, (SELECT count(*) FROM {tag}fa f WHERE f.detector = d.detector) AS false_alarms,
  (SELECT sum(length) FROM run WHERE status = 'confirmed') AS length FROM (VALUES {names}) d(detector)"""
DENSITY = 0.05


@query(
    "matched_random",
    with_views(
        f"""SELECT detector, {s6('density')} AS density, hits, events, {sql_rates()}, false_alarms, {s6('100.0::DOUBLE * false_alarms / length')} AS fa_per_100 FROM (
        {_RATES_OF.format(density=f"CASE WHEN d.detector = '{ma.RANDOM}' THEN {DENSITY}::DOUBLE END", tag="base", names=f"('error'), ('{ma.RANDOM}')")}
        UNION ALL {_RATES_OF.format(density="(SELECT density FROM scaled)", tag="matched", names=f"('{ma.MATCHED}')")})""",
        "ev", "alarm", "rv", "run", "scored",
        extra={
            "places": "SELECT patch, ord, x, y, z FROM pt WHERE patch IN (SELECT patch FROM scored)",
            **_drawn("base", f"{DENSITY}::DOUBLE"),
            **_scored_as("base", f"""SELECT * FROM alarm WHERE detector = 'error'
              UNION ALL SELECT '{ma.RANDOM}' AS detector, patch, ord AS alarm_ord, x, y, z FROM basedraw"""),
            "scaled": f"""SELECT coalesce({DENSITY}::DOUBLE * count(*) FILTER (detector = 'error') / nullif((count(*) FILTER (detector = '{ma.RANDOM}'))::DOUBLE, 0), 0) AS density FROM basefa""",
            **_drawn("matched", "(SELECT density FROM scaled)"),
            **_scored_as("matched", f"SELECT '{ma.MATCHED}' AS detector, patch, ord AS alarm_ord, x, y, z FROM matcheddraw"),
        }),
)
def matched_random(t: Tables):
    """A detector beside random alarms, before and after their density is scaled to its false-alarm rate."""
    surface = t.pt().select("patch", F.col("ord").alias("key"), *XYZ)
    out = ma.matched_random(t.benchmark(), t.alarms(), "error", surface, DENSITY, 1.0, RADIUS, DEDUP, SEED)
    return rounded(out.select("detector", "density", "hits", "events", *RATES, "false_alarms", "fa_per_100"), "density", *RATES, "fa_per_100")


# ------------------------------------------------------------------ batches and mixtures
@query(
    "batch_grid",
    with_views(
        f"""SELECT detector, cap, filter, batch, patches, hits, events, {sql_rates()}, {s6('lo')} AS boot_lo, {s6('hi')} AS boot_hi, {s6('hi / 0.5519')} AS corrected_upper, coalesce(hi / 0.5519 < 0.6, FALSE) AS holds FROM (
          SELECT detector, cap, filter, batch, sum(k)::BIGINT AS hits, sum(n)::BIGINT AS events FROM cells GROUP BY 1, 2, 3, 4) s
        JOIN (SELECT detector, cap, filter, batch, quantile_cont(num / den, 0.025) AS lo, quantile_cont(num / den, 0.975) AS hi FROM (
          SELECT c.detector, c.cap, c.filter, c.batch, p.draw, sum(c.k)::DOUBLE AS num, sum(c.n)::DOUBLE AS den FROM plan p
          JOIN numbered b USING (cap, filter, batch, ordinal) JOIN cells c USING (cap, filter, batch, block) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4) i USING (detector, cap, filter, batch)
        JOIN (SELECT patch % 6 AS batch, count(*) AS patches FROM scored GROUP BY 1) z USING (batch)""",
        "ev", "alarm", "dets", "hit", "scored",
        extra={
            "ranks": f"SELECT *, row_number() OVER (PARTITION BY patch ORDER BY md5('{SEED}|' || patch || '|' || event_id), event_id) AS rank FROM ev WHERE status = 'confirmed'",
            "chosen": """SELECT e.event_id, e.patch, e.patch % 6 AS batch, c.cap, f.filter FROM ranks e, (VALUES (0::BIGINT), (1), (3)) c(cap), (VALUES ('all'), ('abrupt')) f(filter)
              WHERE (c.cap = 0 OR e.rank <= c.cap) AND (f.filter = 'all' OR e.stratum = 'abrupt')""",
            "cells": """SELECT c.patch AS block, c.batch, c.cap, c.filter, d.detector, count(*) AS n, count(h.event_id) AS k FROM chosen c CROSS JOIN dets d
              LEFT JOIN hit h ON h.event_id = c.event_id AND h.detector = d.detector GROUP BY 1, 2, 3, 4, 5""",
            "numbered": "SELECT cap, filter, batch, block, row_number() OVER (PARTITION BY cap, filter, batch ORDER BY md5(block::VARCHAR), block) - 1 AS ordinal FROM (SELECT DISTINCT cap, filter, batch, block FROM cells)",
            "sizes": "SELECT cap, filter, batch, count(*) AS n FROM numbered GROUP BY 1, 2, 3",
            "plan": f"""SELECT s.cap, s.filter, s.batch, b.draw, ('0x' || substr(md5('{SEED}|' || b.draw || '|' || q.slot), 1, 8))::BIGINT % s.n AS ordinal
              FROM sizes s, (SELECT unnest(range({DRAWS})) AS draw) b, LATERAL (SELECT unnest(range(s.n)) AS slot) q""",
        }),
)
def batch_grid(t: Tables):
    """Recall of every detector, cap and batch, over all confirmed events and over the abrupt ones."""
    filters = {"all": None, "abrupt": F.col("stratum") == "abrupt"}
    out = rob.batch_grid(t.benchmark(), t.alarms(), RADIUS, [0, 1, 3], F.col("patch") % 6, 0.5519, 0.6, seed=SEED, filters=filters)
    return rounded(out, *RATES, "boot_lo", "boot_hi", "corrected_upper")


def _side(tag: str, status: str) -> dict[str, str]:
    views = boot_views(f"SELECT event_id AS block, 0 AS series, (x > 50)::INT AS num, 1 AS den FROM ev WHERE status = '{status}' AND event_id % 13 <> 0", DRAWS)
    names = re.compile(r"\b(" + "|".join(views) + r")\b")
    return {tag + k: names.sub(lambda m: tag + m[0], v).replace(f"'{SEED}|'", f"'{SEED}.{tag[0]}|'") for k, v in views.items()}


@query(
    "unmixed_intervals",
    with_views(
        f"""SELECT n_a, n_b, {s6('(a * 0.8 - b * 0.3) / 0.5')} AS true_rate, {s6('(0.7 * b - 0.2 * a) / 0.5')} AS false_rate, {', '.join(f"{s6(f'quantile_cont({c}, {q})')} AS {c}_{e}" for c in ('true', 'false') for e, q in (('lo', 0.025), ('hi', 0.975)))}
        FROM (SELECT a.draw, (0.8 * a.num / a.den - 0.3 * b.num / b.den) / 0.5 AS true, (0.7 * b.num / b.den - 0.2 * a.num / a.den) / 0.5 AS false FROM a_pooled a JOIN b_pooled b USING (draw)),
          (SELECT count(*) AS n_a, avg(num) AS a FROM a_blk), (SELECT count(*) AS n_b, avg(num) AS b FROM b_blk) GROUP BY n_a, n_b, a, b""".replace("AS true,", 'AS "true",').replace("AS false FROM", 'AS "false" FROM').replace("quantile_cont(true", 'quantile_cont("true"').replace("quantile_cont(false", 'quantile_cont("false"'),
        "ev", extra={**_side("a_", "confirmed"), **_side("b_", "contradicted")}),
)
def unmixed_intervals_query(t: Tables):
    """Shares of abrupt events among true and false ones, from confirmed and contradicted events that mix both."""
    rows = t.gt_event().withColumn("abrupt", F.when(F.col("event_id") % 13 != 0, F.col("x") > 50))
    out = unmixed_intervals(rows, "abrupt", "status", "confirmed", "contradicted", 0.7, 0.2, "event_id", seed=SEED)
    return rounded(out, *[c for c in out.columns if not c.startswith("n_")])


# ------------------------------------------------------------------ checks
@query(
    "key_set_violations",
    """WITH f AS (SELECT CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS k FROM orders),
    g AS (SELECT k, count(*) AS found FROM f GROUP BY 1), c AS (SELECT c_custkey AS k, count(*) AS expected FROM customer GROUP BY 1)
    SELECT coalesce(g.k, c.k) AS k, CASE WHEN found IS NULL THEN 'missing' ELSE 'unexpected' END AS problem, coalesce(found, 0) AS found, coalesce(expected, 0) AS expected
    FROM g FULL JOIN c ON g.k IS NOT DISTINCT FROM c.k WHERE found IS NULL OR expected IS NULL""",
)
def key_set_violations(t: Tables):
    """Customers without an order, and order keys of no customer (some displaced, some NULL)."""
    k = F.when(F.col("o_orderkey") % 89 == 0, None).when(F.col("o_orderkey") % 97 == 0, F.col("o_custkey") + 10000000).otherwise(F.col("o_custkey"))
    return checks.key_set_violations(t.read("orders").select(k.alias("k")), t.read("customer").select(F.col("c_custkey").alias("k")), ["k"])


@query(
    "lost_hits",
    with_views(
        """SELECT h.event_id, h.detector FROM (SELECT DISTINCT e.event_id, a.detector FROM ev e JOIN alarm a USING (patch) WHERE sqrt((e.x-a.x)*(e.x-a.x)+(e.y-a.y)*(e.y-a.y)+(e.z-a.z)*(e.z-a.z)) <= 25) h
        ANTI JOIN (SELECT DISTINCT e.event_id, a.detector FROM ev e JOIN alarm a USING (patch) WHERE a.alarm_ord % 3 <> 0 AND sqrt((e.x-a.x)*(e.x-a.x)+(e.y-a.y)*(e.y-a.y)+(e.z-a.z)*(e.z-a.z)) <= 30) w
        ON w.event_id = h.event_id AND w.detector = h.detector""", "ev", "alarm"),
)
def lost_hits(t: Tables):
    """Hits that a wider tolerance should have kept, but its inputs lack every third alarm."""
    hit = lambda alarms, r: event_hits(t.gt_event(), alarms, r).select("event_id", "detector", F.lit(True).alias("hit"))
    return checks.lost_hits(hit(t.alarm(), 25.0), hit(t.alarm().filter("alarm_ord % 3 <> 0"), 30.0), ["event_id", "detector"], "hit")


_CASE = "SELECT user_id AS patch, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS bought, max(value) FILTER (event_type = 'view') AS top FROM events GROUP BY 1"


@query(
    "sanity_verdicts",
    f"""WITH c AS ({_CASE}), r AS (SELECT 'no errors' AS rule, 'none' AS kind, errors > 0 AS flag, patch FROM c UNION ALL SELECT 'few without a purchase', 'few', bought = 0, patch FROM c
      UNION ALL SELECT 'all views measured', 'all', top > 400, patch FROM c UNION ALL SELECT 'none above a thousand', 'none', top > 1000, patch FROM c),
    g AS (SELECT rule, kind, count(flag) AS n, count(*) FILTER (flag) AS bad, count(*) FILTER (flag IS NULL) AS open, min(patch) FILTER (flag) AS witness FROM r GROUP BY 1, 2)
    SELECT rule, n, bad, {s6('bad::DOUBLE / greatest(n, 1)')} AS share,
      CASE kind WHEN 'none' THEN bad = 0 WHEN 'few' THEN bad::DOUBLE / greatest(n, 1) <= 0.05 ELSE bad = 0 AND open = 0 AND n > 0 END AS passed, witness FROM g""",
)
def sanity_verdicts(t: Tables):
    """Pass or fail of four rules over per-patch cases, each with the share and a witness."""
    kind = F.col("event_type")
    c = t.read("events").groupBy(F.col("user_id").alias("patch")).agg(
        F.count_if(kind == "error").alias("errors"), F.count_if(kind == "purchase").alias("bought"), F.max(F.when(kind == "view", F.col("value"))).alias("top"))
    rules = {
        "no errors": ("none", F.col("errors") > 0), "few without a purchase": ("few", F.col("bought") == 0),
        "all views measured": ("all", F.col("top") > 400), "none above a thousand": ("none", F.col("top") > 1000)}
    return rounded(checks.sanity_verdicts(c, rules, "patch"), "share")


# ------------------------------------------------------------------ files and metadata
@query("file_set_hash")
def file_set_hash(t: Tables):
    """Content hash of the files of three tables, as one set."""
    paths = [f"{t.sf_dir}/{name}.parquet" for name in ("documents", "orders", "nation")]
    return files.file_set_hash(files.file_digests(t.spark, paths, t.sf_dir, "*.parquet"))


_META = """SELECT 'auto_grown_' || o_custkey || '_region_' || o_orderkey AS patch, CASE WHEN o_orderkey % 11 = 0 THEN 'none' WHEN o_orderkey % 7 = 0 THEN '{"seed": ' ELSE
  '{"vc_gsfs_mode": "' || o_orderstatus || '"' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ', "seed": ' || o_orderkey END
  || CASE WHEN o_orderkey % 3 = 0 THEN ', "source_tifxyz": "/a/b/s' || o_custkey || '/"' ELSE '' END || ', "area": 1.5}' END AS value FROM orders"""


@query(
    "patch_metadata",
    f"""WITH m AS (SELECT *, o_orderkey % 11 = 0 OR o_orderkey % 7 = 0 AS bad FROM orders)
    SELECT 'auto_grown_' || o_custkey || '_region_' || o_orderkey AS patch, CASE WHEN NOT bad THEN o_orderstatus END AS mode, CASE WHEN NOT bad AND o_orderkey % 5 <> 0 THEN o_orderkey END AS seed,
      CASE WHEN NOT bad AND o_orderkey % 3 = 0 THEN '/a/b/s' || o_custkey || '/' END AS source, CASE WHEN NOT bad AND o_orderkey % 3 = 0 THEN 's' || o_custkey ELSE 'auto_grown_' || o_custkey END AS lineage,
      CASE WHEN bad THEN 'load_error' END AS problem FROM m""",
)
def patch_metadata(t: Tables):
    """Metadata objects with missing fields, further fields and broken text, as one nullable table."""
    t.read("orders").createOrReplaceTempView("_metadata_orders")
    objects = t.spark.sql(_META.replace("FROM orders", "FROM _metadata_orders"))
    return co.metadata_rows(objects)
