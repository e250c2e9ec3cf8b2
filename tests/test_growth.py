"""Steps that must not grow rows, window functions or recomputations beyond what their result needs."""

import math
import random

from pyspark.sql import functions as F

from fieldaudit.operators import grid as gr
from fieldaudit.operators import spatial as sp
from fieldaudit.operators import stacks as st


def _plan(df, part: str = "Optimized Logical Plan") -> str:
    plan = df._jdf.queryExecution().toString()
    return plan[plan.index(f"== {part}"):].split("\n== ", 1)[0]


def test_normals_take_two_window_functions_a_direction(spark):
    g = spark.createDataFrame([(0, r, c, 20.0 * c, 20.0 * r, float(r * c)) for r in range(3) for c in range(3)], "patch long, row long, col long, x double, y double, z double")
    n = gr.normals(g).filter("nx is not null")
    plan = _plan(n)
    assert plan.count("lag(") + plan.count("lead(") == 4
    assert n.count() == 9


def test_a_line_grows_into_few_cells_and_none_is_missed(spark):
    rng, rules, rows = random.Random(3), st.Rules(), []
    for i in range(200):
        v = [rng.gauss(0, 1) for _ in range(3)]
        d = math.sqrt(sum(a * a for a in v))
        rows.append((i, 0, 0, *[rng.uniform(-500, 500) for _ in range(3)], *[a / d for a in v]))
    probes = spark.createDataFrame(rows, "patch long, row long, col long, x double, y double, z double, nx double, ny double, nz double")
    left, cell = st.line_cells(probes, probes.columns, rules)
    cells = [(r["patch"], r["_cell"]) for r in left.collect()]
    assert len(cells) == len(set(cells)) < 16 * len(rows)
    near = probes.withColumn("_t", F.explode(F.sequence(F.lit(-100), F.lit(100), F.lit(10)))).withColumn("_k", F.explode(F.array(*[F.lit(float(k)) for k in range(8)])))
    # points around the line at the full lateral distance: along two directions across it
    cross = "sqrt(greatest(1D - nz * nz, 1e-12D))"
    u, v = (f"(-ny / {cross})", f"(nx / {cross})", "0D"), (f"(-nx * nz / {cross})", f"(-ny * nz / {cross})", cross)
    turn = lambda i: f"13.99D * (cos(_k * pi() / 4) * {u[i]} + sin(_k * pi() / 4) * {v[i]})"
    at = near.selectExpr("patch", *[f"{a} + _t * n{a} + {turn(i)} as {a}" for i, a in enumerate("xyz")]).selectExpr("patch", f"{cell} as _cell")
    assert {(r["patch"], r["_cell"]) for r in at.distinct().collect()} <= set(cells)


def test_the_nearest_neighbour_sorts_no_other_pairs(spark):
    pts = [(i, float(i % 10), float(i // 10), 0.0) for i in range(100)]
    q = spark.createDataFrame([(1, 2.2, 3.1, 0.0), (2, 4.5, 4.5, 0.0), (None, 7.9, 1.0, 0.0), (3, 500.0, 0.0, 0.0)], "q long, x double, y double, z double")
    got = sp.k_nearest_within(q, spark.createDataFrame(pts, "id long, x double, y double, z double"), 1, 6.0, ids=["q"], order=["id"])
    assert "_least" in _plan(got)
    assert {(r["q"], r["id"], r["rank"]) for r in got.collect()} == {(1, 32, 1), (2, 44, 1), (None, 18, 1)}


def test_a_listing_is_never_broadcast(spark):
    from fieldaudit.sources import listing as li

    c = spark.range(50).withColumnRenamed("id", "patch")
    files = li.wanted(c).select("patch", "file", F.lit(1).cast("long").alias("bytes"))
    got = li.reconcile(li.wanted(c), files, files.filter("patch < 10"), files.filter("patch < 20"))
    assert "BroadcastHashJoin" not in _plan(got, "Physical Plan")
    assert {r["state"]: r["count"] for r in got.groupBy("state").count().collect()} == {"have": 40, "copy": 40, "get": 120}


def test_false_alarms_search_once(spark):
    from fieldaudit.plans.score import false_alarm_pairs

    kept = spark.createDataFrame([("d", 1, 0, 0.0, 0.0, 0.0), ("d", 1, 1, 9.0, 0.0, 0.0), ("d", 2, 0, 0.0, 0.0, 0.0)], "detector string, patch long, alarm_ord long, x double, y double, z double")
    runs = spark.createDataFrame([(7, 1, 0.5, 0.0, 0.0), (7, 1, 0.0, 0.5, 0.0), (8, 1, 0.0, 0.0, 0.5), (7, 1, 9.0, 0.0, 0.5)], "run_id long, patch long, x double, y double, z double")
    events = spark.createDataFrame([(1, 1, 9.5, 0.0, 0.0)], "event_id long, patch long, x double, y double, z double")
    got = false_alarm_pairs(kept, runs, events, 1.0)
    assert "LeftAnti" not in _plan(got)
    assert {tuple(r) for r in got.collect()} == {("d", 1, 0, 7), ("d", 1, 0, 8)}


def test_a_sweep_deals_its_profiles(spark):
    from fieldaudit.operators import profile as P

    rows = [(i, "adjacent", "tune", [float(k) for k in range(64)], [float((k * (i + 3)) % 11) for k in range(64)], 28.0, 36.0, 8.0) for i in range(6)]
    controls = spark.createDataFrame(rows, "profile_id long, kind string, split string, t array<double>, v array<double>, t0 double, t1 double, s double")
    got = P.sweep(controls, 1.0, {"sigma": [1.0], "end_zone": [0.2], "min_dark": [1.0], "q": [20.0], "mid_bias": [0.15]})
    assert f"RoundRobinPartitioning({P.SWEEP_TASKS})" in _plan(got, "Physical Plan")
    assert [r["n"] for r in got.collect()] == [6]


def test_stacks_of_tiles_are_those_of_the_crossings(spark):
    """Crossings are no rows any more, and a patch that comes back, a sheet seen twice and copies merge as before."""
    rng, rows = random.Random(5), []
    for p in range(12):
        for i in range(60):
            v = [rng.gauss(0, 0.4), rng.gauss(0, 0.4), 1.0]
            d = math.sqrt(sum(a * a for a in v))
            turn = 40 * (i % 3) if p == 4 else 0  # one patch meets a line at distant places of its grid
            rows.append((f"p{p}", i // 8 + turn, i % 8, f"k{p // 3}" if p != 7 else None, *[1270.0 + rng.uniform(-40, 40) for _ in range(2)], 9.0 * p + rng.uniform(-4, 4), *[a / d for a in v]))
    rows += [(f"q{k}", *rows[300][1:]) for k in range(4)] + [("nan", 0, 0, "k", float("nan"), 0.0, 0.0, 0.0, 0.0, 1.0)]
    probes = spark.createDataFrame(rows, "patch string, row int, col long, kin string, x double, y double, z double, nx double, ny double, nz double")
    cloud = probes.withColumnsRenamed({"patch": "p", "row": "r", "col": "c"})
    for rules, lineage in ((st.Rules(), None), (st.Rules(), "kin"), (st.Rules(min_spacing=3.0, patch_gap=1.0, same_patch_cells=2.0), None), (st.Rules().rescaled(0.5, 0.0192), "kin")):
        got = st.sheet_stacks(probes, cloud, rules, lineage)
        plan = _plan(got, "Physical Plan")
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
        want = st.merge_sheets(st.split_crossings(st.line_crossings(probes, cloud, rules, lineage), rules), rules)
        assert got.dtypes == want.select(*got.columns).dtypes
        got, want = ({(r["patch"], r["row"], r["col"]): r["stack"] for r in d.collect()} for d in (got, want))
        assert len(want) > 400 and got == want


def test_runs_are_labelled_once_and_stacks_are_fetched_for_members_only(spark):
    from fieldaudit.operators import follow as fo

    rows = [(p, r, c, 20.0 * c, 20.0 * r, 20.0 * p, 0.0, 0.0, 1.0) for p in range(5) for r in range(4) for c in range(6)]
    v = spark.createDataFrame(rows, "patch long, row long, col long, x double, y double, z double, nx double, ny double, nz double")
    cloud = v.selectExpr("patch + 100 as p", "row as r", "col as c", "x", "y", "z + 1 as z", "nx", "ny", "nz")  # a reference sheet beside every surface
    labels = st.label_surfaces(v, cloud)
    assert _plan(labels.segments).count("Window [") == 1  # chains of both axes are kept, positions aren't counted anew
    assert {(r["axis"], r["n"]) for r in labels.segments.collect()} == {("row", 6), ("col", 4)}
    placed = st.place(v, labels.assigned)
    spans = placed.filter("patch = 2 and pos = 1").groupBy("patch", "run").agg(F.min("pos").alias("_lo"), (F.max("pos") + 1).alias("_hi"))
    inside = fo._inside(placed, spans)
    plan = _plan(inside)
    assert plan.index("Join Inner") < plan.index("Join LeftSemi")  # positions are picked before their stacks are joined
    assert inside.count() == 2 * (4 + 6) and inside.select("pos").distinct().count() == 2


def test_draws_of_an_auroc_are_ranked_without_a_row_per_draw_and_score(spark):
    import re
    from collections import Counter

    from fieldaudit.operators import bootstrap as bs
    from fieldaudit.operators import stats as sa
    from fieldaudit.operators.ordered import hashed_ordinal

    scores = [None, float("nan"), 1.0, 2.0, 2.0, 2.5]
    rows = [(b, scores[b % 6] if b % 7 else 2.0, int(b * 31 % 5 < 2)) for b in range(3000)]  # more rows of a score than are weighed at once
    df = spark.createDataFrame(rows, "block long, score double, hit int")
    got = sa.bootstrap_auroc(df, "score", F.col("hit") == 1, "block", draws=4, seed=9, probs=(0.0, 1.0))
    assert not re.search(r"Aggregate \[draw#\d+L?, _block", _plan(got))
    at = {r["block"]: r["ordinal"] for r in hashed_ordinal(df.select("block").distinct(), "block").collect()}
    weight = Counter((r["draw"], r["ordinal"]) for r in bs.draw_slots(spark.createDataFrame([(3000,)], "n long"), 4, 9).collect())
    level = lambda s: (0, 0.0) if s is None else (2, 0.0) if s != s else (1, s)

    def value(draw):
        pos, neg = Counter(), Counter()
        for b, s, hit in rows:
            (pos if hit else neg)[level(s)] += weight[draw, at[b]] if draw is not None else 1
        below, u = 0, 0.0
        for s in sorted({*pos, *neg}):
            u += pos[s] * (below + neg[s] / 2)
            below += neg[s]
        return u / (sum(pos.values()) * sum(neg.values()))

    drawn = [value(d) for d in range(4)]
    assert tuple(got.first()) == (value(None), min(drawn), max(drawn), 4)
    one = sa.bootstrap_auroc(df.filter("block < 2"), "score", F.col("hit") == 1, "block", draws=1, seed=9)
    assert one.first()["n_boot"] <= 1  # a block that no draw picks


def test_random_alarms_are_drawn_once_a_density(spark):
    import __spark_entry__ as entry

    plan = _plan(entry.queries()["matched_random"](spark, "/root/testdata/sf0.001"))
    assert "_share" not in plan  # hits, counts and the de-duplication read kept draws


def test_the_nearest_neighbour_looks_only_as_far_as_its_own_cell_tells(spark):
    rng, r = random.Random(5), 6.0
    at = lambda n, span: [(g, i, *[round(rng.uniform(-span, span), 1) for _ in range(3)]) for g in (0, 1) for i in range(n)]
    qs, ts = at(300, 40.0), at(400, 40.0)
    qs += [(0, 1000, 11.9, 0.0, 0.0), (0, 1001, 200.0, 0.0, 0.0), (0, 1002, 311.5, 0.0, 0.0), (2, 1003, 0.0, 0.0, 0.0)]
    ts += [(0, 1000, 12.1, 0.0, 0.0), (0, 1001, 206.0, 0.0, 0.0), (0, 1002, 317.6, 0.0, 0.0), (1, 1003, 200.0, 0.0, 0.0)]
    ts += [(g, i + 500, x, y, z) for g, i, x, y, z in ts[:50]]  # ties, decided by the order
    want = set()
    for g, q, *p in qs:
        near = sorted((math.sqrt((p[0] - t[0]) * (p[0] - t[0]) + (p[1] - t[1]) * (p[1] - t[1]) + (p[2] - t[2]) * (p[2] - t[2])), i) for h, i, *t in ts if h == g)
        want |= {(g, q, f"q{q}", i, d) for d, i in near[:1] if d <= r}
    q = spark.createDataFrame(qs, "g long, q long, x double, y double, z double").withColumn("tag", F.concat(F.lit("q"), "q"))
    got = sp.k_nearest_within(q, spark.createDataFrame(ts, "g long, id long, x double, y double, z double"), 1, r, ids=["g", "q"], order=["id"], keys=["g"])
    assert {(x["g"], x["q"], x["tag"], x["id"], x["dist"]) for x in got.collect()} == want and 200 < len(want) < 604
    assert "_bound" in _plan(got)
