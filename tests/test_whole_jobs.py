"""Bootstrap and sweep jobs of full size: draws, settings and both ways to pool draws."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from fieldaudit.operators import profile as P
from fieldaudit.operators import bootstrap as B
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WHOLE = [
    "profile_sweep", "sweep_top", "sweep_choice", "sweep_frontier", "settings_hold", "boot_recall", "boot_fa", "boot_area", "boot_auroc", "board_diff",
    "interpolation", "local_cloud", "geometry_violations"]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return connect(SF)


@pytest.mark.parametrize("name", WHOLE)
def test_whole_job(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_sizes(spark, con):
    assert len(entry.queries()["profile_sweep"](spark, SF).select("sigma", *list(P.SWEEP)[1:]).distinct().collect()) == 540
    assert entry.queries()["settings_hold"](spark, SF).first()["settings"] == 3 * 3 * 3 * 3  # detectors, caps, radii, subsets and pooled
    assert B.DRAWS == 2000


def test_reasons(spark, con):
    found = {r["reason"] for r in entry.queries()["geometry_violations"](spark, SF).select("reason").distinct().collect()}
    assert {"length differs from the grid", "end differs from the grid"} <= found


def test_ids_are_not_folded(spark):
    sf = "/root/testdata/sf0.1"
    assert compare(spark, connect(sf), "unknown_patches", entry.queries()["unknown_patches"], entry.oracle_sql()["unknown_patches"], sf) is None


def test_both_ways_of_pooling(spark, monkeypatch):
    rows = [(s, b, d, (b * 7 + len(d)) % 5, None if b == 3 else b % 4) for s in ("u", "v") for b in range(40 if s == "u" else 9) for d in ("x", "y", None)]
    blocks = spark.createDataFrame(rows, "s string, b int, d string, k int, n int")
    parts = {"k": F.col("k"), "n": F.col("n")}
    run = lambda: sorted(B.pooled_draws(blocks, parts, "b", ["s"], ["d"], draws=50).collect(), key=repr)
    matrix = run()
    monkeypatch.setattr(B, "MATRIX_BLOCKS", 0)
    joined = run()
    assert matrix == joined and len(matrix) == 2 * 3 * 50
    monkeypatch.setattr(B, "MATRIX_BLOCKS", 20)  # one set each way
    assert run() == joined
    whole = B.pooled_draws(blocks.filter("s = 'u'"), parts, "b", draws=50).orderBy("draw").collect()
    assert [r["k"] for r in whole] == [sum(r["k"] for r in joined if r["s"] == "u" and r["draw"] == d) for d in range(50)]


def test_layer_spacing_looks_up_every_vertex(spark, con):
    from fieldaudit.operators.follow import layer_spacing
    from fieldaudit.suite.base import with_views
    from fieldaudit.suite.grid_queries import NORMALS

    side = 56  # 3,136 vertices a layer
    g = spark.range(2 * side * side).selectExpr(f"id div {side * side} as layer", f"id % {side * side} div {side} as row", f"id % {side} as col")
    flat = g.selectExpr("*", "20D * col as x", "20D * row as y", "layer * (30D + row div 14) as z", "0D as nx", "0D as ny", "1D as nz")
    assert tuple(layer_spacing(flat).first()) == (side * side, 30.0, 31.5, 33.0)
    every = con.sql(with_views(
        """SELECT count(*) FROM nrm u WHERE EXISTS (SELECT 1 FROM nrm v WHERE v.patch = u.patch + 1 AND abs(v.row - u.row) <= 4 AND abs(v.col - u.col) <= 4
        AND sqrt((u.x - v.x) * (u.x - v.x) + (u.y - v.y) * (u.y - v.y) + (u.z - v.z) * (u.z - v.z)) < 80)""", "grid", extra=NORMALS)).fetchall()[0][0]
    assert entry.queries()["layer_spacing"](spark, SF).first()["n"] == every
    assert compare(spark, con, "layer_spacing", entry.queries()["layer_spacing"], entry.oracle_sql()["layer_spacing"], SF) is None


def test_layer_spacing_of_a_single_layer(spark):
    from fieldaudit.operators.follow import layer_spacing

    one = spark.range(9).selectExpr("0L as layer", "id div 3 as row", "id % 3 as col", "20D * id as x", "0D as y", "0D as z", "0D as nx", "0D as ny", "1D as nz")
    assert tuple(layer_spacing(one).first()) == (0, None, None, None)
