"""Sequence, grid, component, labelling and incremental operators against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldaudit.functions import stats as S
from fieldaudit.operators import grid as gr
from fieldaudit.operators import ordered as o
from fieldaudit.operators import sequence as Q
from fieldaudit.operators import stacks as st
from fieldaudit.operators.bootstrap import bootstrap_ratio
from fieldaudit.operators.components import spatial_clusters
from fieldaudit.operators.sampling import cap_per_group
from fieldaudit.plans.score import pool
from fieldaudit.streaming import incremental as inc


def test_percentiles_match_linear_interpolation(spark):
    import numpy as np

    rng = random.Random(1)
    v = [rng.choice([1.5, rng.gauss(0, 10)]) for _ in range(997)]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    got = o.exact_percentiles(df.repartition(5), "v", [0.025, 0.5, 0.9]).first()
    assert (got["p0"], got["p1"], got["p2"]) == pytest.approx(tuple(np.percentile(v, [2.5, 50, 90])))


def test_ordered_helpers_cross_blocks(spark):
    df = spark.range(40).selectExpr("id % 2 as k", "id", "cast(id * 10 as double) as x", "id div 6 as _block")
    prev = {r["id"]: r["prev_x"] for r in o.previous_row(df, ["x"], ["id"], keys=["k"]).collect()}
    assert prev == {i: (10.0 * (i - 2) if i >= 2 else None) for i in range(40)}
    run = {r["id"]: r["running"] for r in o.running_total(df, F.col("id"), ["id"], keys=["k"]).collect()}
    assert run == {i: sum(range(i % 2, i + 1, 2)) for i in range(40)}


def test_bootstrap_does_not_depend_on_partitioning(spark):
    rows = spark.createDataFrame([(f"p{i}", i % 3, 1 + i % 4) for i in range(50)], "patch string, k int, n int")
    args = ({"m": (F.col("k"), F.col("n"))}, "patch")
    a = bootstrap_ratio(rows.repartition(1), *args, draws=100).collect()
    b = bootstrap_ratio(rows.repartition(17), *args, draws=100).collect()
    assert a == b and a[0]["m_lo"] < sum(i % 3 for i in range(50)) / sum(1 + i % 4 for i in range(50)) < a[0]["m_hi"]


def test_cap_is_stable_and_exact(spark):
    df = spark.range(100).selectExpr("id % 7 as patch", "id as event_id")
    a, b = (sorted(map(tuple, cap_per_group(df.repartition(n), 3, ["patch"], "event_id").collect())) for n in (1, 9))
    assert a == b and len(a) == 21


def test_majority_and_tri_state(spark):
    rows = spark.createDataFrame([([True, False],), ([True, None],), ([None],), ([False, False, True],)], "v array<boolean>")
    assert [r[0] for r in rows.select(S.majority(F.col("v"))).collect()] == [False, True, None, False]


def test_streaks_break_on_null(spark):
    rows = spark.createDataFrame([(1, i, f) for i, f in enumerate([True, True, None, True, False, True, True, True])], "k int, i int, f boolean")
    assert Q.longest_streak(rows, ["k"], "i", F.col("f")).first()["longest"] == 3


def test_clusters_are_transitive_and_strict(spark):
    pts = [(1, "p", 0.0), (2, "p", 9.0), (3, "p", 18.0), (4, "p", 28.0), (5, "q", 28.5)]
    df = spark.createDataFrame([(i, p, x, 0.0, 0.0) for i, p, x in pts], "id bigint, patch string, x double, y double, z double")
    got = {r["id"]: r["cluster"] for r in spatial_clusters(df, 10.0, "id", keys=["patch"]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}  # 3-4 are exactly at the radius


def test_unwrap_equals_breadth_first_search(spark):
    from collections import deque

    rng = random.Random(5)
    cells = {(r, c) for r in range(14) for c in range(14) if rng.random() < 0.75}
    wrap = lambda a: (a + math.pi) % (2 * math.pi) - math.pi
    th = {rc: wrap(rc[0] * 0.9 + rc[1] * 0.7) for rc in cells}
    want = {}
    for start in sorted(cells):
        if start in want:
            continue
        want[start] = th[start]
        queue = deque([start])
        while queue:
            r, c = queue.popleft()
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in cells and n not in want:
                    want[n] = want[(r, c)] + wrap(th[n] - th[(r, c)])
                    queue.append(n)
    df = spark.createDataFrame([("p", r, c, th[(r, c)]) for r, c in cells], "patch string, row bigint, col bigint, theta double")
    got = {(r["row"], r["col"]): r["unwrapped"] for r in gr.unwrap_angle(df, "theta").collect()}
    assert got == pytest.approx(want)


def test_winding_pairs_equal_brute_force(spark):
    rng = random.Random(9)
    wrap = lambda a: (a + math.pi) % (2 * math.pi) - math.pi
    pts = []
    for i in range(80):
        u = rng.uniform(-12, 12)
        pts.append((i, u, wrap(u), round((u - wrap(u)) / (2 * math.pi)) + (rng.random() < 0.1)))
    want = set()
    for a in pts:
        for b in pts:
            if a[0] < b[0]:
                m = round((b[3] - a[3]) + wrap(b[2] - a[2]) / (2 * math.pi) - (b[1] - a[1]) / (2 * math.pi))
                if m:
                    want.add((a[0], b[0], m))
    df = spark.createDataFrame([("p", 0, "g", i, float(w), t, u) for i, u, t, w in pts], "patch string, component int, g string, point_id int, w double, theta double, unwrapped double")
    got = {(r["a"], r["b"], r["mismatch"]) for r in st.winding_mismatches(df, ["g"]).collect()}
    assert got == want


def _flat_sheets(spark, switch):
    """Reference sheets 20 apart, and one trace that lies on sheet 2 and moves to sheet 3 after column 29."""
    ref = [(f"r{k}", r, c, 20.0 * c, 20.0 * r, 20.0 * k, 0.0, 0.0, 1.0) for k in range(6) for r in range(4) for c in range(60)]
    cloud = spark.createDataFrame(ref, "p string, r bigint, c bigint, x double, y double, z double, nx double, ny double, nz double")
    tr = [("t", r, c, 20.0 * c, 20.0 * r, 41.0 + (20.0 if switch and c >= 30 else 0.0), 0.0, 0.0, 1.0) for r in range(4) for c in range(60)]
    return spark.createDataFrame(tr, "patch string, row bigint, col bigint, x double, y double, z double, nx double, ny double, nz double"), cloud


def test_labelling_finds_one_switch(spark):
    v, cloud = _flat_sheets(spark, True)
    labels = st.label_surfaces(v, cloud)
    ev = labels.events().collect()
    assert len(ev) == 1 and ev[0]["members"] == 4 and ev[0]["deltas"] == [1]
    assert (ev[0]["x"], ev[0]["z"]) == pytest.approx((590.0, 51.0))
    assert labels.events(multi=True).count() == 0


def test_labelling_of_a_clean_trace_has_negatives_only(spark):
    v, cloud = _flat_sheets(spark, False)
    labels = st.label_surfaces(v, cloud)
    assert labels.events().count() == 0
    neg = labels.negatives().collect()
    assert len(neg) == 4 and all(n["length"] == pytest.approx(59 * 20 * 0.0096) for n in neg)


def test_replayed_batch_changes_nothing(spark):
    cols = "detector string, patch string, verdict boolean, alarms bigint, kept bigint, events bigint, hits bigint, runs bigint, false_alarms bigint, length double"
    rows = [("d", f"p{i}", True, 1, 1, 2, i % 3, 1, i % 2, 10.0) for i in range(6)]
    state = spark.createDataFrame(rows, cols)
    again = inc.merge_scores(state, state.filter("patch in ('p1', 'p2')"))
    assert pool(state).collect() == pool(again).collect()


def test_stream_equals_batch(spark, tmp_path):
    src, state, ck = (str(tmp_path / n) for n in ("src", "state", "ck"))
    schema = "detector string, patch string, verdict boolean, alarms bigint, kept bigint, events bigint, hits bigint, runs bigint, false_alarms bigint, length double"
    rows = [("d", f"p{i}", True, 1, 1, 2, i % 3, 1, i % 2, 10.0) for i in range(9)]
    whole = spark.createDataFrame(rows, schema)
    for part in (whole.filter("patch < 'p4'"), whole.filter("patch >= 'p3'")):  # p3 arrives twice
        part.coalesce(1).write.mode("append").parquet(src)
        inc.rescore_stream(spark, src, whole.schema, lambda b: b, state, ck).awaitTermination(120)
    assert inc.board_from_state(spark, state).collect() == pool(whole).collect()
