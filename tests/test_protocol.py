"""Operators around the scorer against brute force on small fixtures."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import fixtures as fx
from fieldaudit.operators import checks, follow, misses, spatial
from fieldaudit.operators import grid as gr
from fieldaudit.operators import profile as pr
from fieldaudit.operators import stacks as st
from fieldaudit.plans import matched
from fieldaudit.plans.score import Alarms, Benchmark
from fieldaudit.sources import alarms as al
from fieldaudit.sources import corpus, files
from fieldaudit.streaming import incremental as inc

POINT = "id int, patch string, x double, y double, z double, v double"
STACK = "array<struct<t: double, members: array<struct<p: string, r: bigint, c: bigint>>>>"
PLACED = f"patch string, run string, pos int, arc double, row bigint, col bigint, stack {STACK}, k int, spacing double"


def close(a, b):
    return math.sqrt(sum((p - q) ** 2 for p, q in zip(a, b)))


# ------------------------------------------------------------------ spatial
def dense_points(rng, n, spread, offset=0.0):
    """A third within one small box, the rest spread out, some copies."""
    out = []
    for i in range(n):
        if i % 3 == 0:
            p = (offset + rng.random(), rng.random(), rng.random())
        elif i % 7 == 0 and out:
            p = out[-1][2:5]
        else:
            p = tuple(rng.uniform(0, spread) for _ in range(3))
        out.append((i, "ab"[i % 5 == 0], *p, rng.choice([None, float("nan"), rng.random()])))
    return out


@pytest.mark.parametrize("spread", [30.0, 100_000.0])
def test_joins_on_dense_and_wide_patches(spark, spread):
    rng = random.Random(5)
    q, t = dense_points(rng, 150, spread), dense_points(rng, 400, spread, 10.0)
    qs, ts = spark.createDataFrame(q, POINT), spark.createDataFrame(t, POINT)
    r = 10.0
    near = {a[0] for a in q for b in t if a[1] == b[1] and close(a[2:5], b[2:5]) <= r}
    assert {x["id"] for x in spatial.matches_within(qs, ts, r, ["id"], ["patch"]).collect()} == near and near
    best = {a[0]: min(close(a[2:5], b[2:5]) for b in t if a[1] == b[1]) for a in q}
    got = {x["id"]: x["nearest"] for x in spatial.nearest(qs, ts, ["id"], ["patch"]).collect()}
    assert got == pytest.approx(best)
    got = {x["id"]: x["nearest"] for x in spatial.nearest(qs, ts, ["id"], ["patch"], bound=r).collect()}
    assert got == pytest.approx({k: d for k, d in best.items() if d <= r})
    top = {}
    for a in q:
        values = [b[5] for b in t if a[1] == b[1] and b[5] is not None and b[5] == b[5] and close(a[2:5], b[2:5]) <= r]
        if values:
            top[a[0]] = max(values)
    assert {x["id"]: x["v"] for x in spatial.ball_max(qs, ts, "v", r, ["id"], ["patch"]).collect()} == top


def test_two_dense_groups_at_the_radius(spark):
    """Two groups of 3,000 points each, most of them just out of reach of each other."""
    rng = random.Random(9)
    q = [(i, "a", rng.random() * 1e-3, rng.random() * 1e-3, rng.random() * 1e-3, 0.0) for i in range(3000)]
    t = [(i, "a", 10.0 + rng.random(), rng.random() * 1e-3, rng.random() * 1e-3, 0.0) for i in range(3000)]
    at = np.array([p[2:5] for p in t])
    want = {a[0] for a in q if (np.sqrt(((at - np.array(a[2:5])) ** 2).sum(1)) <= 10.0).any()}
    got = spatial.matches_within(spark.createDataFrame(q, POINT), spark.createDataFrame(t, POINT), 10.0, ["id"], ["patch"])
    assert {x["id"] for x in got.collect()} == want and 0 < len(want) < 3000


# ------------------------------------------------------------------ following sheets
def runs(rng, names, length):
    """Stacks along runs: sheets drift, vanish and share reference patches with their neighbours."""
    rows = []
    for name in names:
        for pos in range(length):
            if rng.random() < 0.1:
                continue  # no stack here
            stack = []
            for k in range(rng.randrange(0, 4)):
                members = [{"p": rng.choice("pqrs"), "r": rng.randrange(8), "c": pos + rng.randrange(-2, 3)} for _ in range(rng.randrange(1, 3))]
                stack.append({"t": 20.0 * k + rng.random(), "members": members})
            k = rng.randrange(1, len(stack) + 1) if stack and rng.random() < 0.8 else None
            rows.append(("P", name, pos, pos * 0.2, 3, pos, stack, k, 10.0))
    return rows


def brute_track(rows, p0, p1, k0, slack=3.0):
    by = {r[2]: r for r in rows}

    def find(sheet, at, stack, here):
        for j, other in enumerate(stack):
            for m in sheet:
                for n in other["members"]:
                    if m["p"] == n["p"] and math.hypot(m["r"] - n["r"], m["c"] - n["c"]) <= 1.5 * math.hypot(at[0] - here[0], at[1] - here[1]) + slack:
                        return j
        return None

    out, step = {}, 1 if p1 >= p0 else -1
    if p0 not in by or k0 > len(by[p0][6]):
        return out
    first = (by[p0][6][k0 - 1]["members"], (by[p0][4], by[p0][5]))
    last = first
    for p in range(p0, p1 + step, step):
        if p not in by:
            continue
        stack, here = by[p][6], (by[p][4], by[p][5])
        j = find(*last, stack, here)
        if j is None and last[1] != first[1]:
            j = find(*first, stack, here)
        if j is not None:
            out[p] = (j + 1, stack[j]["t"])
            last = (stack[j]["members"], here)
    return out


def test_follow_sheets_in_blocks(spark):
    rng = random.Random(4)
    rows = runs(rng, [f"r{i}" for i in range(6)], 60)
    placed = spark.createDataFrame(rows, PLACED)
    own = {n: [r for r in rows if r[1] == n] for n in {r[1] for r in rows}}
    tracks, want = [], {}
    for i in range(60):
        name = rng.choice(sorted(own))
        p0, p1 = rng.randrange(60), rng.randrange(60)
        tracks.append((f"t{i}", "ab"[i % 2], "P", name, p0, p1, rng.randrange(1, 4)))
        for p, (j, t) in brute_track(own[name], p0, p1, tracks[-1][6]).items():
            want[f"t{i}", "ab"[i % 2], p] = (j, t)
    frame = spark.createDataFrame(tracks, "name string, side string, patch string, run string, p0 int, p1 int, k0 int")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for block in (size, "7"):  # with seven rows a block, tracks go on over several
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", block)
        got = {(r["name"], r["side"], r["pos"]): (r["j"], r["t"]) for r in follow.follow_sheets(frame, placed, ["name", "side"]).collect()}
        assert got == want and len(want) > 100
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert follow.follow_sheets(frame.limit(0), placed, ["name", "side"]).count() == 0


def test_transition_metrics_of_a_clean_switch(spark):
    """Sheets 20 apart; a trace one voxel above sheet 2 moves to sheet 3 between two columns."""
    ref = [(f"r{k}", r, c, 20.0 * c, 20.0 * r, 20.0 * k, 0.0, 0.0, 1.0) for k in range(6) for r in range(3) for c in range(60)]
    cloud = spark.createDataFrame(ref, "p string, r bigint, c bigint, x double, y double, z double, nx double, ny double, nz double")
    tr = [("t", r, c, 20.0 * c, 20.0 * r, 41.0 + (20.0 if c >= 30 else 0.0), 0.0, 0.0, 1.0) for r in range(3) for c in range(60)]
    v = spark.createDataFrame(tr, "patch string, row bigint, col bigint, x double, y double, z double, nx double, ny double, nz double")
    labels = st.label_surfaces(v, cloud)
    placed = st.place(v, labels.assigned, "row")
    found = follow.transitions(labels.segments.filter("axis = 'row'")).filter("delta <> 0")
    members = found.withColumn("member", F.col("run")).unionByName(found.select("patch", "run", "pos_a", "pos_b", (F.col("delta") + 1).alias("delta"), F.concat("run", F.lit("?")).alias("member")))
    rows = follow.transition_metrics(members, placed, labels.segments).collect()
    assert len(rows) == 6
    for r in rows:
        if r["member"].endswith("?"):
            assert (r["reproduced"], r["n_defined"], r["max_step"], r["n_steps"]) == (False, None, None, 1)
            continue
        assert (r["reproduced"], r["partial"], r["n_steps"], r["n_defined"], r["n_step_measurements"]) == (True, False, 1, 2, 1)
        assert (r["gap_a"], r["gap_b"], r["max_step"], r["max_step_sf"]) == pytest.approx((20.0, 20.0, 20.0, 20.0))
        assert r["max_rate"] == pytest.approx(20.0 / r["width_mm"]) and r["total_sf"] == pytest.approx(r["total_offset"])
    neg = labels.segments.filter("axis = 'row' and segment = 0").select(F.col("run").alias("negative"), "patch", "run", "i0", "i1")
    noise = follow.negative_noise(neg, placed).collect()
    assert len(noise) == 3 * 29 and all(n["step"] == pytest.approx(0.0) and n["step_sf"] == pytest.approx(0.0) for n in noise)


# ------------------------------------------------------------------ misses, lineage, splits
def test_miss_classes_of_three_events(spark):
    points = spark.createDataFrame([(1, "p", 0.0, 0.0, 0.0), (1, "p", 5.0, 0.0, 0.0), (2, "p", 50.0, 0.0, 0.0), (3, "q", 0.0, 0.0, 0.0), (4, "p", 500.0, 0.0, 0.0)], "event_id int, patch string, x double, y double, z double")
    edges = spark.createDataFrame([("p", 6.0, 0.0, 0.0, 0.9), ("p", 50.0, 1.0, 0.0, 0.9), ("q", 0.0, 1.0, 0.0, 0.2), ("q", 0.0, 2.0, 0.0, float("nan"))], "patch string, x double, y double, z double, score double")
    cells = spark.createDataFrame([("p", 5.0, 1.0, 0.0, 9), ("p", 50.0, 1.0, 0.0, 2)], "patch string, x double, y double, z double, component_size long")
    got = {r["event_id"]: (r["max_score"], r["max_component"], r["cls"]) for r in misses.miss_classes(points, edges, cells, 2.0, 0.5, 5).collect()}
    assert got == {1: (0.9, 9, misses.COHERENT), 2: (0.9, 2, misses.INCOHERENT), 3: (0.2, 0, misses.BELOW), 4: (None, 0, misses.BELOW)}


def test_relatives_of_another_name_are_left_out(spark):
    ref = [(f"r{k}", r, c, 20.0 * c, 20.0 * r, 20.0 * k, 0.0, 0.0, 1.0, "own" if k == 2 else None if k == 3 else "other") for k in range(5) for r in range(3) for c in range(3)]
    cloud = spark.createDataFrame(ref, "p string, r bigint, c bigint, x double, y double, z double, nx double, ny double, nz double, kin string")
    v = spark.createDataFrame([("t", 1, 1, 20.0, 20.0, 41.0, 0.0, 0.0, 1.0, "own"), ("u", 1, 1, 20.0, 20.0, 41.0, 0.0, 0.0, 1.0, None)], "patch string, row bigint, col bigint, x double, y double, z double, nx double, ny double, nz double, kin string")
    got = st.line_crossings(v, cloud, lineage="kin").select("patch", "p").distinct().collect()
    assert {(r["patch"], r["p"]) for r in got} == {(a, f"r{k}") for a, out in (("t", 2), ("u", 3)) for k in range(5) if k != out}


def test_new_ladders_move_no_other_one(spark):
    points = spark.createDataFrame([(f"c{i}", w, float(w), 0.0, 0.0) for i in range(40) for w in range(3)], "coll string, w long, x double, y double, z double")
    split = lambda df: {r["coll"]: r["split"] for r in pr.ladder_controls(df).select("coll", "split").distinct().collect()}
    few, all_ = split(points.filter("coll < 'c3'")), split(points)
    assert all(all_[c] == s for c, s in few.items()) and set(all_.values()) == {"tune", "test"}


# ------------------------------------------------------------------ random alarms
def test_matched_random_alarms_have_the_rate(spark):
    rng = random.Random(1)
    surface = [(p, i, rng.uniform(0, 4000), rng.uniform(0, 4000), 0.0) for p in ("a", "b") for i in range(4000)]
    run = [(f"{p}{k}", p, 200.0 * k, 40.0 * i, 0.0) for p in ("a", "b") for k in range(20) for i in range(100)]
    ids = "run_id string, patch string, x double, y double, z double"
    rv = spark.createDataFrame(run, ids)
    bench = Benchmark(
        events=spark.createDataFrame([(1, "a", "confirmed")], "event_id int, patch string, status string"),
        event_points=spark.createDataFrame([(1, "a", 9000.0, 0.0, 0.0)], "event_id int, patch string, x double, y double, z double"),
        runs=rv.select("run_id", "patch", F.lit("confirmed").alias("status")).distinct(), run_vertices=rv,
        run_lengths=rv.groupBy("run_id", "patch").agg(F.lit(4000.0).alias("length")), voxel_mm=1.0)
    alarms = [("d", p, i, 200.0 * rng.randrange(20), rng.uniform(0, 4000), 0.0) for p in ("a", "b") for i in range(120)]
    given = Alarms(spark.createDataFrame([("d", "a"), ("d", "b")], "detector string, patch string"), spark.createDataFrame(alarms, "detector string, patch string, alarm_ord bigint, x double, y double, z double"))
    places = spark.createDataFrame(surface, "patch string, key bigint, x double, y double, z double")
    got = {r["detector"]: r for r in matched.matched_random(bench, given, "d", places, 0.01, 1.0, 25.0, 12.5).collect()}
    want, base, again = (got[n]["false_alarms"] for n in ("d", matched.RANDOM, matched.MATCHED))
    assert base < want / 2 and abs(again - want) <= 0.25 * want
    assert got[matched.MATCHED]["density"] == pytest.approx(0.01 * want / base)


# ------------------------------------------------------------------ checks, files, metadata
def test_key_sets_treat_null_as_a_key(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), (None, 2), ("y", None)], "k string, n int")
    b = spark.createDataFrame([("x", 1), (None, 3), ("y", None)], "k string, n int")
    got = {(r["k"], r["n"], r["problem"], r["found"], r["expected"]) for r in checks.key_set_violations(a, b, ["k", "n"]).collect()}
    assert got == {(None, 2, "unexpected", 1, 0), (None, 3, "missing", 0, 1)}
    assert {r["problem"] for r in checks.key_set_violations(a, b, ["k", "n"], subset=True).collect()} == {"missing"}
    assert checks.key_set_violations(a, a, ["k", "n"]).count() == 0 and checks.key_set_violations(a.limit(0), b.limit(0), ["k"]).count() == 0


def test_lost_hits_need_the_key_itself(spark):
    small = spark.createDataFrame([("a", True), ("b", True), ("c", False), (None, True)], "k string, hit boolean")
    large = spark.createDataFrame([("a", True), ("b", None), (None, True)], "k string, hit boolean")
    assert [r["k"] for r in checks.lost_hits(small, large, ["k"], "hit").collect()] == ["b"]


def test_sanity_rules(spark):
    d = spark.createDataFrame([(i, None if i == 3 else i > 97) for i in range(100)], "id int, bad boolean")
    rules = {n: (n, F.col("bad")) for n in ("none", "few", "all")} | {"clean": ("all", F.col("id") > 1000)}
    got = {r["rule"]: (r["n"], r["bad"], r["passed"], r["witness"]) for r in checks.sanity_verdicts(d, rules, "id").collect()}
    assert got == {"none": (99, 2, False, 98), "few": (99, 2, True, 98), "all": (99, 2, False, 98), "clean": (100, 0, True, None)}


def test_file_set_hash(spark, tmp_path):
    contents = {f"d{i % 3}/f{i}.bin": bytes([i]) * (i * 100 + 1) for i in range(12)}
    for name, data in contents.items():
        path = tmp_path / "set" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
    groups = {}
    for name in sorted(contents):
        groups.setdefault(hashlib.md5(name.encode()).hexdigest()[:3], []).append(f"{name}:{sha(contents[name])}")
    want = sha("\n".join(f"{g}:{sha(chr(10).join(lines))}" for g, lines in sorted(groups.items())))
    digests = files.file_digests(spark, str(tmp_path / "set"), str(tmp_path / "set"))
    assert {r["file"]: r["sha256"] for r in digests.collect()} == {n: sha(d) for n, d in contents.items()}
    for frame in (digests, digests.repartition(5)):
        row = files.file_set_hash(frame).first()
        assert (row["files"], row["bytes"], row["sha256"]) == (12, sum(map(len, contents.values())), want)
    assert files.file_set_hash(digests.limit(0)).first()["files"] == 0


def test_metadata_files(spark, tmp_path):
    meta = {
        "auto_grown_1_region_7": {"vc_gsfs_mode": "seed", "seed": 5, "source_tifxyz": "/a/b/parent"}, "auto_grown_2_region_9": {"area": 1.5}, "broken": None, "odd name": {"seed": "x"}}
    for name, fields in meta.items():
        path = tmp_path / "patches" / name / "meta.json"
        path.parent.mkdir(parents=True)
        path.write_text(json.dumps(fields) if fields is not None else '{"seed": ')
    got = {r["patch"]: (r["mode"], r["seed"], r["source"], r["lineage"], r["problem"]) for r in corpus.read_metadata(spark, str(tmp_path / "patches")).collect()}
    assert got["auto_grown_1_region_7"] == ("seed", 5, "/a/b/parent", "parent", None)
    assert got["auto_grown_2_region_9"] == (None, None, None, "auto_grown_2", None)
    assert got["broken"][4] == "load_error" and got["odd name"][0] is None and len(got) == 4


# ------------------------------------------------------------------ sources and stream
def test_masks_of_other_patches_are_not_invalid(spark):
    v = fx.vertices(spark)
    masks = spark.createDataFrame([("d", "pA", 0, 79), ("d", "pA", 5, 5), ("d", "pC", 1, 1), ("d", "zz", 1, 1)], "detector string, patch string, row bigint, col bigint")
    scored = spark.createDataFrame([("pA",)], "patch string")
    alarms, dropped = al.mask_alarms(masks, masks.select("detector", "patch"), v, scored)
    assert [r["dropped_invalid"] for r in dropped.collect()] == [1] and alarms.alarms.count() == 1


def test_micro_batches_of_one_patch_add_up(spark, tmp_path):
    src, state, ck = (str(tmp_path / n) for n in ("src", "state", "ck"))
    rows = [("d", f"p{i % 3}", i) for i in range(12)]
    whole = spark.createDataFrame(rows, "detector string, patch string, alarm_ord long")

    def score_rows(d):
        return d.groupBy("detector", "patch").agg(F.count(F.lit(1)).alias("alarms")).selectExpr(
            "detector", "patch", "true as verdict", "alarms", "alarms as kept", "0L as events", "0L as hits", "1L as runs", "0L as false_alarms", "1D as length")

    for part in ("alarm_ord < 5", "alarm_ord >= 5 and patch = 'p1'", "alarm_ord >= 4"):
        whole.filter(part).coalesce(1).write.mode("append").parquet(src)
        inc.rescore_stream(spark, src, whole.schema, score_rows, state, ck).awaitTermination(120)
    got = {r["patch"]: r["alarms"] for r in spark.read.parquet(f"{state}/scores").collect()}
    assert got == {"p0": 4, "p1": 4, "p2": 4}


def test_residues_are_reported(spark):
    def grid(f):
        return spark.createDataFrame([("p", r, c, f(r - 4.5, c - 4.5)) for r in range(10) for c in range(10)], "patch string, row bigint, col bigint, theta double")

    smooth = grid(lambda y, x: math.remainder(0.9 * x + 0.4 * y, 2 * math.pi))
    vortex = grid(lambda y, x: math.atan2(y, x))
    assert gr.unwrap_residues(smooth, "theta").count() == 0
    found = gr.unwrap_residues(vortex, "theta").collect()
    assert len(found) == 1 and found[0]["contradicted"] > 0 and gr.unwrap_angle(vortex, "theta").count() == 100
