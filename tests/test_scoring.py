"""Golden values and rules of the scorer on the synthetic corpus."""

import json

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from fieldaudit.functions import stats as S
from fieldaudit.operators.dedup import greedy_dedup
from fieldaudit.operators.spatial import matches_within, nearest
from fieldaudit.plans.leaderboard import board_order, leaderboard
from fieldaudit.plans.score import Alarms, resolve_settings, score
from fieldaudit.sources.alarms import AlarmsError, load_alarms, load_manifest, read_manifest
from fieldaudit.sources.corpus import CorpusError, load_benchmark


@pytest.fixture(scope="module")
def bench(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("c") / "corpus.json"
    p.write_text(json.dumps(fx.corpus_json()))
    return load_benchmark(spark, str(p), fx.vertices(spark))


def write(tmp_path, obj, folder="in"):
    (tmp_path / folder).mkdir(exist_ok=True)
    f = tmp_path / folder / "det.json"
    f.write_text(json.dumps(obj))
    return str(f)


def test_wilson_golden(spark):
    rows = spark.createDataFrame([(6, 54), (0, 54), (0, 0)], "k int, n int")
    got = rows.select(*S.wilson(F.col("k"), F.col("n"))).collect()
    assert tuple(got[0]) == pytest.approx((0.1111111111111111, 0.051930224969995484, 0.2219470102118128), abs=1e-15)
    assert got[1][2] == pytest.approx(0.0664135880908964, abs=1e-15)
    assert tuple(got[2]) == (None, None, None)


def test_run_lengths(bench):
    got = {r["run_id"]: r["length"] for r in bench.run_lengths.collect()}
    assert got[0] == pytest.approx(1200 / fx.MM) and got[1] == pytest.approx(1180 / fx.MM)
    assert sorted(r["patch"] for r in bench.scored_patches().collect()) == ["pA", "pB"]


@pytest.mark.parametrize("wrong", ["wrong_centre", "wrong_length", "bad_vertex"])
def test_corpus_is_refused(spark, tmp_path, wrong):
    p = tmp_path / "c.json"
    p.write_text(json.dumps(fx.corpus_json(**{wrong: True})))
    with pytest.raises(CorpusError):
        load_benchmark(spark, str(p), fx.vertices(spark))


@pytest.mark.parametrize("extra,hit", [(-1e-6, True), (1e-3, False)])
def test_boundary_of_the_radius(spark, bench, extra, hit):
    a = fx.point_table(spark, [("d", "pA", 0, 1210.0 + fx.MM + extra, 2000.0, 3100.0)])
    frames = score(bench, Alarms(a.select("detector", "patch").distinct(), a), bootstrap=0)
    assert frames.detector_score.first()["hits"] == int(hit)


def test_false_alarms_verdicts_and_coverage(spark, bench):
    """Clean verdict on pB, alarms on pA: one on the run, one next to a contradicted event, one far away."""
    a = fx.point_table(spark, [
        ("d", "pA", 0, 1500.0, 2000.0, 3400.0), ("d", "pA", 1, 1810.0, 2000.0, 3390.0), ("d", "pA", 2, 2500.0, 2000.0, 3050.0)])
    v = spark.createDataFrame([("d", "pA"), ("d", "pB")], "detector string, patch string")
    row = score(bench, Alarms(v, a)).detector_score.first()
    assert (row["hits"], row["events"], row["false_alarms"], row["alarms"], row["kept"]) == (0, 1, 1, 3, 3)
    assert row["fa_per_100"] == pytest.approx(100 / (1200 / fx.MM + 1180 / fx.MM))
    assert not row["limited_scope"] and row["patches_verdict"] == 2
    only_b = score(bench, Alarms(v.filter("patch = 'pB'"), a.limit(0))).detector_score.first()
    assert (only_b["events_verdict"], only_b["recall_where_verdict"], only_b["recall"]) == (0, None, 0.0)


def test_three_formats_agree(spark, bench, tmp_path):
    grid = load_alarms(spark, write(tmp_path, {"pA": [[5, 11], [20, 30], [0, 79]], "pB": [], "zz": None}), fx.vertices(spark), scored=fx.vertices(spark).select("patch"))
    xyz = load_alarms(spark, write(tmp_path, {"format": "xyz", "detector": "det", "alarms": {"pA": [[1220, 2000, 3100], [1600, 2000, 3400]], "pB": []}}, "other"))
    assert grid[1].first()["dropped_invalid"] == 1
    rows = [score(bench, a, bootstrap=0).detector_score.collect() for a, _ in (grid, xyz)]
    assert rows[0] == rows[1] and rows[0][0]["hits"] == 1 and rows[0][0]["false_alarms"] == 1


@pytest.mark.parametrize("bad", [
    {"pA": [[1, 2], [1, 2, 3]]}, {"pA": [[99, 10]]}, {"pA": [[5.5, 3]]}, {"pA": [["a", 1]]}, {"pA": [5]}, {"pA": "text"},
    {"format": "odd", "alarms": {"pA": [[1, 2]]}},
])
def test_malformed_alarms_are_refused(spark, tmp_path, bad):
    with pytest.raises(AlarmsError):
        load_alarms(spark, write(tmp_path, bad), fx.vertices(spark), scored=fx.vertices(spark).select("patch"))


def test_manifest_with_a_format_per_entry(spark, bench, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"pA": [[5, 11], [20, 30], [0, 79]], "unknown": [[1, 1]]}))
    (tmp_path / "b.json").write_text(json.dumps({"pA": [[1220, 2000, 3100]]}))
    (tmp_path / "c.json").write_text(json.dumps({"pA": []}))
    entries = [{"name": n, "alarms": str(tmp_path / f), "tool": "t"} for n, f in (("grid", "a.json"), ("points", "b.json"), ("again", "b.json"), ("clean", "c.json"))]
    (tmp_path / "entries.json").write_text(json.dumps(entries))
    manifest = read_manifest(spark, str(tmp_path / "entries.json"))
    alarms, dropped = load_manifest(spark, manifest, fx.vertices(spark), fx.vertices(spark).select("patch"))
    assert [tuple(r) for r in dropped.collect()] == [("grid", 1)]
    rows = leaderboard(score(bench, alarms, bootstrap=0), entry=manifest.select("entry_ord", "detector", "tool", "mode")).collect()
    assert {(r["detector"], r["hits"], r["alarms"], r["mode"]) for r in rows} == {
        ("points", 1, 1, "default"), ("again", 1, 1, "default"), ("grid", 1, 2, "default"), ("clean", 0, 0, "default")}
    assert [r["detector"] for r in rows if r["detector"] in ("points", "again")] == ["points", "again"] and rows[-1]["detector"] == "clean"


def test_dedup_keeps_0_and_2r(spark):
    a = fx.point_table(spark, [("d", "p", i, 10.0 * i, 0.0, 0.0) for i in range(3)])
    assert sorted(r["alarm_ord"] for r in greedy_dedup(a, 10.0).collect()) == [0, 2]
    assert greedy_dedup(a, 0.0).count() == 3


def _brute(points, r):
    kept = []
    for o, *p in sorted(points):
        if all(sum((u - v) ** 2 for u, v in zip(p, q)) ** 0.5 > r for _, *q in kept):
            kept.append((o, *p))
    return sorted(k[0] for k in kept)


@pytest.mark.parametrize("kind", ["random", "ordered", "copies"])
def test_dedup_paths_agree_with_brute_force(spark, kind):
    import random

    rng = random.Random(7)
    if kind == "random":
        pts = [(i, rng.uniform(0, 60), rng.uniform(0, 60), rng.uniform(0, 5)) for i in range(300)]
    elif kind == "ordered":
        pts = [(i, 4.0 * (i % 20), 4.0 * (i // 20), 0.0) for i in range(300)]
    else:
        pts = [(i, *((5.0, 5.0, 0.0) if i % 3 == 0 else (rng.uniform(0, 40), rng.uniform(0, 40), 0.0))) for i in range(300)]
    df = fx.point_table(spark, [("d", "p", *p) for p in pts])
    want = _brute(pts, 9.0)
    assert sorted(r["alarm_ord"] for r in greedy_dedup(df, 9.0).collect()) == want
    for cells in (2, 3, 5):
        tiled = greedy_dedup(df.repartition(7), 9.0, tile_cells=cells)
        assert sorted(r["alarm_ord"] for r in tiled.collect()) == want


def test_dedup_streams_groups_in_blocks(spark, monkeypatch):
    """Several groups, NULL keys, points without coordinates and further columns, cut into blocks of a few rows."""
    import random

    from fieldaudit.operators import dedup

    rng = random.Random(3)
    rows = []
    for d in ("a", "b", None):
        for i in range(120):
            dense = rng.random() < 0.4
            p = (1.0, 1.0, 1.0) if dense else (rng.uniform(-30, 30), rng.uniform(-30, 30), 0.0)
            rows.append((d, i % 2, i, *p, "x"))
    rows.append(("a", 0, 500, None, None, None, "x"))
    df = spark.createDataFrame(rows, "detector string, patch long, alarm_ord long, x double, y double, z double, _t9 string")
    want = []
    for d in ("a", "b", None):
        for p in (0, 1):
            want += [(d, p, o) for o in _brute([(r[2], *r[3:6]) for r in rows if r[0] == d and r[1] == p and r[3] is not None], 6.0)]
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 7)
    kept = greedy_dedup(df.repartition(5), 6.0, tile_cells=3)
    assert kept.columns == df.columns
    assert sorted(((r["detector"], r["patch"], r["alarm_ord"]) for r in kept.collect()), key=repr) == sorted([*want, ("a", 0, 500)], key=repr)


def test_dedup_starts_no_job(spark):
    df = fx.point_table(spark, [("d", "p", i, float(i), 0.0, 0.0) for i in range(50)])
    seen = lambda: {j for s in [spark.sparkContext.statusTracker()] for j in s.getJobIdsForGroup("dedup-plan")}
    spark.sparkContext.setJobGroup("dedup-plan", "planning")
    greedy_dedup(df, 3.0)
    assert not seen()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_joins_on_a_hot_cell(spark):
    """A third of all targets are copies of one point; results stay whole and equal brute force."""
    import random

    rng = random.Random(3)
    t = [(i, *((50.0, 50.0, 50.0) if i % 3 == 0 else tuple(rng.uniform(0, 100) for _ in range(3)))) for i in range(300)]
    q = [(i, *(rng.uniform(0, 100) for _ in range(3))) for i in range(60)]
    tdf = spark.createDataFrame([("p", *x) for x in t], "patch string, tid bigint, x double, y double, z double")
    qdf = spark.createDataFrame([("p", *x) for x in q], "patch string, qid bigint, x double, y double, z double")
    dist = {a[0]: min(sum((u - v) ** 2 for u, v in zip(a[1:], b[1:])) ** 0.5 for b in t) for a in q}
    near = {r["qid"]: r["nearest"] for r in nearest(qdf, tdf, ["qid"], ["patch"], top_side=64.0).collect()}
    assert near == pytest.approx(dist)
    got = {r["qid"] for r in matches_within(qdf, tdf, 12.0, ["qid"], ["patch"]).collect()}
    assert got == {k for k, d in dist.items() if d <= 12.0}


def test_settings_provenance():
    value, origin = resolve_settings({"match_mm": 2.0, "per_patch_cap": 0}, fa_dedup_mm=0.25)
    assert value["match_mm"] == 2.0 and origin["match_mm"] == "corpus" and origin["fa_dedup_mm"] == "argument"
    assert value["per_patch_cap"] is None and origin["bootstrap"] == "default"
    with pytest.raises(ValueError):
        resolve_settings(None, match_mm=-1)


def test_board_order_prefers_full_scope(spark):
    rows = spark.createDataFrame(
        [("a", None, False, 1.0), ("b", 0.5, True, 0.1), ("c", 0.5, False, 9.0), ("d", 0.5, False, None)],
        "detector string, recall double, limited_scope boolean, fa_per_100 double")
    assert [r["detector"] for r in rows.orderBy(*board_order()).collect()] == ["c", "d", "b", "a"]


def test_identical_hits_get_identical_intervals(spark, bench):
    a = fx.point_table(spark, [(d, "pA", 0, 1210.0, 2000.0, 3100.0) for d in ("one", "two")])
    v = a.select("detector", "patch")
    b = leaderboard(score(bench, Alarms(v, a), bootstrap=50)).select("recall_boot_lo", "recall_boot_hi", "fa_boot_lo", "fa_boot_hi").collect()
    assert b[0] == b[1]


def test_census_counts_both_rules_and_shared_entries(spark, bench):
    import dataclasses

    from pyspark.sql import functions as F

    from fieldaudit.plans.robustness import census

    bench = dataclasses.replace(bench, events=bench.events.withColumn("stratum", F.lit("abrupt")))
    ev = [r.asDict() for r in bench.events.select("event_id", "patch", "status").collect()]
    plain = {r["subset"]: r for r in census(bench, F.lit("all")).collect()}
    second = {e["event_id"] for e in ev[::2]}
    rule = F.when(F.col("event_id").isin(*second), F.lit(True))  # null for the others
    multi = spark.createDataFrame([(ev[0]["patch"],)] * 3, bench.events.select("patch").schema)
    got = {r["subset"]: r for r in census(bench, F.lit("all"), rule, multi).collect()}
    assert set(got) == {"all", "pooled"}
    for name in got:
        assert (plain[name]["confirmed_second"], plain[name]["confirmed_both"], plain[name]["multi"]) == (0, 0, 0)
        assert got[name]["confirmed_second"] == len(second) and got[name]["multi"] == 3
        assert got[name]["confirmed_both"] == sum(e["event_id"] in second and e["status"] == "confirmed" for e in ev)
        assert got[name]["candidates"] == plain[name]["candidates"] == len(ev)
