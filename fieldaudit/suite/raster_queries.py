"""Mask and image queries; an image is one grid patch, a mask the set of vertices with v > 0."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as R
from .base import Tables, query, rounded, s6, with_views

MASK = {"mask": "SELECT patch AS segment, row AS y, col AS x FROM grid_all WHERE v > -0.1", "img": "SELECT patch AS segment, row AS y, col AS x, v FROM grid_all"}


def _img(t: Tables):
    return t.grid(valid_only=False).selectExpr("patch as segment", "row as y", "col as x", "v")


def _mask(t: Tables, low: float = -0.1):
    return _img(t).filter(f"v > {low}").drop("v")


@query("mask_bbox", with_views("SELECT segment, greatest(0, min(y) - 2) AS y0, max(y) + 3 AS y1, greatest(0, min(x) - 2) AS x0, max(x) + 3 AS x1, count(*) AS pixels FROM mask GROUP BY 1", "grid_all", extra=MASK))
def mask_bbox(t: Tables):
    return R.mask_bbox(_mask(t), margin=2)


@query("mask_overlap", with_views(f"SELECT segment, count(*) FILTER (v > 0.1) AS overlap, {s6('count(*) FILTER (v > 0.1)::DOUBLE / count(*)')} AS fraction FROM img WHERE v > -0.1 GROUP BY 1", "grid_all", extra=MASK))
def mask_overlap(t: Tables):
    return rounded(R.overlap(_mask(t), _mask(t, 0.1)), "fraction")


@query("crop_summary", with_views(f"SELECT i.segment, {s6('min(v)')} AS min, {s6('max(v)')} AS max, count(*) AS pixels FROM img i JOIN (SELECT segment, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM img WHERE v > 0.3 GROUP BY 1) b ON b.segment = i.segment AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 GROUP BY 1", "grid_all", extra=MASK))
def crop_summary(t: Tables):
    return rounded(R.crop_summary(_img(t), R.mask_bbox(_mask(t, 0.3))), "min", "max")


@query("eroded_mask", with_views("SELECT a.segment, a.y, a.x FROM mask a JOIN mask b ON b.segment = a.segment AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3 HAVING count(*) = 9", "grid_all", extra=MASK))
def eroded_mask(t: Tables):
    return R.erode(_mask(t), 1)


@query("mean_pool", with_views(f"SELECT segment, y // 7 AS y, x // 7 AS x, {s6('avg(v)')} AS v FROM img GROUP BY 1, 2, 3 HAVING count(*) = 49", "grid_all", extra=MASK))
def mean_pool(t: Tables):
    return rounded(R.mean_pool(_img(t), 7), "v")


@query("tile_count", with_views("SELECT segment, count(*) FILTER (n >= 0.8 * 25) AS tiles FROM (SELECT m.segment, (y - y0) // 5 AS ty, (x - x0) // 5 AS tx, count(*) AS n FROM mask m JOIN (SELECT segment, min(y) AS y0, min(x) AS x0 FROM mask GROUP BY 1) b USING (segment) GROUP BY 1, 2, 3) GROUP BY 1", "grid_all", extra=MASK))
def tile_count(t: Tables):
    return R.tile_count(_mask(t), 5, 0.8)


@query(
    "centred_span",
    with_views(
        """SELECT patch, line, mid, least(coalesce(min(g.col) FILTER (g.col <= mid), mid), mid) AS a, greatest(coalesce(max(g.col) FILTER (g.col >= mid), mid), mid) AS b FROM (
          SELECT *, least(greatest(0, mid - 6), greatest(0, 64 - 1 - 12)) AS lo, least(63, least(greatest(0, mid - 6), 51) + 12) AS hi FROM
          (SELECT patch, row AS line, col AS mid FROM grid WHERE v > 0.17)) p LEFT JOIN grid g ON g.patch = p.patch AND g.row = p.line AND g.col BETWEEN lo AND hi
        GROUP BY p.patch, line, mid""".replace("SELECT patch, line, mid, least(coalesce", "SELECT p.patch, line, mid, least(coalesce"), "grid"),
)
def centred_span(t: Tables):
    g = t.grid()
    places = g.filter("v > 0.17").selectExpr("patch", "row as line", "col as mid", "64L as width")
    out = R.centred_span(places, g.selectExpr("patch", "row as line", "col as pos"), 12, "width")
    return out.select("patch", "line", "mid", "a", "b")
