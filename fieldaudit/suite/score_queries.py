"""Scoring, matching, de-duplication, leaderboard and bootstrap queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.hashing import digest
from ..operators.bootstrap import DRAWS, bootstrap_ratio
from ..operators.components import spatial_clusters
from ..operators.dedup import greedy_dedup
from ..operators.sampling import cap_per_group
from ..operators.spatial import close_pairs, matches_within, nearest, without_match
from ..plans import leaderboard as board
from ..plans import robustness as rob
from ..plans.score import CONFIRMED, counted_events, event_hits, false_alarm_pairs, pool, score
from .base import DEDUP, RADIUS, SEED, Tables, longs, query, r6, rounded, s6, with_views

Z = "1.959963984540054::DOUBLE"


def sql_wilson(k: str, n: str) -> tuple[str, str, str]:
    p = f"(({k})::DOUBLE / nullif({n}, 0))"
    den = f"(1 + {Z} * {Z} / nullif({n}, 0))"
    c = f"(({p} + {Z} * {Z} / (2 * nullif({n}, 0))) / {den})"
    h = f"({Z} * sqrt({p} * (1 - {p}) / nullif({n}, 0) + {Z} * {Z} / (4.0::DOUBLE * nullif({n}, 0) * nullif({n}, 0))) / {den})"
    lo = f"CASE WHEN ({n}) > 0 THEN greatest(0.0::DOUBLE, {c} - {h}) END"
    hi = f"CASE WHEN ({n}) > 0 THEN least(1.0::DOUBLE, {c} + {h}) END"
    return p, lo, hi


def sql_rates(k="hits", n="events") -> str:
    p, lo, hi = sql_wilson(k, n)
    return f"{s6(p)} AS recall, {s6(lo)} AS wilson_lo, {s6(hi)} AS wilson_hi"


RATES = ("recall", "wilson_lo", "wilson_hi")


# ------------------------------------------------------------------ patches, recall, coverage
@query("scored_patches", with_views("SELECT patch FROM scored", "scored"))
def scored_patches(t: Tables):
    return t.benchmark().scored_patches()


@query(
    "recall",
    with_views(
        f"""SELECT detector, count(h.event_id) AS hits, count(*) AS events, {sql_rates('count(h.event_id)', 'count(*)')}
        FROM (SELECT e.event_id, d.detector FROM ev e CROSS JOIN dets d WHERE e.status = 'confirmed') e
        LEFT JOIN hit h USING (event_id, detector) GROUP BY detector""", "ev", "dets", "hit"),
)
def recall(t: Tables):
    ev = t.gt_event().filter(F.col("status") == CONFIRMED)
    hits = event_hits(ev.select("event_id", "patch", "x", "y", "z"), t.alarm(), RADIUS)
    k = hits.groupBy("detector").agg(F.count(F.lit(1)).alias("hits"))
    n = ev.agg(F.count(F.lit(1)).alias("events"))
    rows = t.alarms().names().join(k, "detector", "left").crossJoin(n)  # one row of totals
    rows = rows.withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))
    return rounded(rows.select("detector", "hits", "events", *S.wilson(F.col("hits"), F.col("events"))), *RATES)


@query(
    "recall_by_stratum",
    with_views(
        f"""SELECT detector, stratum, count(h.event_id) AS hits, count(*) AS events, {sql_rates('count(h.event_id)', 'count(*)')}
        FROM (SELECT e.event_id, e.stratum, d.detector FROM ev e CROSS JOIN dets d WHERE e.status = 'confirmed') e
        LEFT JOIN hit h USING (event_id, detector) GROUP BY detector, stratum""", "ev", "dets", "hit"),
)
def recall_by_stratum(t: Tables):
    frames = score(t.benchmark(), t.alarms())
    out = board.stratum_recall(frames, t.gt_event().select("event_id", "stratum"))
    return longs(rounded(out, *RATES), "hits", "events")


@query(
    "strata_by_key",
    with_views(
        f"""SELECT detector, stratum, count(h.event_id) AS hits, count(*) AS events, {sql_rates('count(h.event_id)', 'count(*)')}
        FROM (SELECT c.event_id, s.stratum, d.detector FROM ckey c JOIN strata s USING (key) JOIN ev e USING (event_id) CROSS JOIN dets d WHERE e.status = 'confirmed') e
        LEFT JOIN hit h USING (event_id, detector) GROUP BY detector, stratum""", "ev", "dets", "hit",
        extra={
            "ckey": "SELECT event_id, x, patch || '|' || printf('%.1f,%.1f,%.1f', round(x) / 2, round(y) / 2, z) AS key FROM ev",
            "strata": "SELECT key, min(CASE WHEN x > 50 THEN 'abrupt' ELSE 'gradual' END) AS stratum FROM ckey WHERE event_id % 7 <> 0 GROUP BY 1",
        }),
)
def strata_by_key(t: Tables):
    """Recall by strata that name events by their coordinates; events without a key there are left out."""
    from ..sources.corpus import build_strata

    at = t.gt_event().selectExpr("event_id", "patch", "round(x) / 2 as x", "round(y) / 2 as y", "z", "x as raw")
    known = build_strata(at.selectExpr("patch", "array(x, y, z) as xyz", "if(event_id % 7 = 0, null, raw > 50) as flag"), F.col("flag"))[0]
    out = board.stratum_recall(score(t.benchmark(), t.alarms()), board.strata_by_key(at, known))
    return longs(rounded(out, *RATES), "hits", "events")


@query(
    "recall_where_verdict",
    with_views(
        f"""SELECT v.detector, count(h.event_id) AS hits, count(*) AS events,
        {s6('count(h.event_id)::DOUBLE / count(*)')} AS recall
        FROM ev e JOIN verdict v USING (patch) LEFT JOIN hit h ON h.event_id = e.event_id AND h.detector = v.detector
        WHERE e.status = 'confirmed' GROUP BY v.detector""", "ev", "verdict", "hit"),
)
def recall_where_verdict(t: Tables):
    ev = t.gt_event().filter(F.col("status") == CONFIRMED)
    per_patch = ev.groupBy("patch").agg(F.count(F.lit(1)).alias("n"))
    hits = event_hits(ev, t.alarm(), RADIUS).groupBy("patch", "detector").agg(F.count(F.lit(1)).alias("k"))
    rows = t.verdict().join(per_patch, "patch").join(hits, ["patch", "detector"], "left")
    agg = rows.groupBy("detector").agg(F.coalesce(F.sum("k"), F.lit(0)).cast("long").alias("hits"), F.sum("n").alias("events"))
    return agg.withColumn("recall", r6(S.ratio(F.col("hits"), F.col("events"))))


@query("event_hits", with_views("SELECT detector, patch, event_id FROM hit", "hit"))
def q_event_hits(t: Tables):
    return event_hits(t.gt_event(), t.alarm(), RADIUS).select("detector", "patch", "event_id")


@query(
    "nearest_alarm",
    with_views(
        f"""SELECT a.detector, e.event_id, {s6('min(sqrt((e.x-a.x)*(e.x-a.x)+(e.y-a.y)*(e.y-a.y)+(e.z-a.z)*(e.z-a.z)))')} AS nearest
        FROM ev e JOIN alarm a USING (patch) WHERE e.status = 'confirmed' GROUP BY 1, 2""", "ev", "alarm"),
)
def nearest_alarm(t: Tables):
    ev = t.gt_event().filter(F.col("status") == CONFIRMED)
    out = nearest(ev, t.alarm(), ids=["event_id"], keys=["patch"], tags=["detector"])
    return out.select("detector", "event_id", r6("nearest").alias("nearest"))


@query(
    "event_score",
    with_views(
        f"""SELECT d.detector, e.patch, e.event_id, TRUE AS counted, (v.patch IS NOT NULL) AS verdict, (h.event_id IS NOT NULL) AS hit,
        {s6("(SELECT min(sqrt((e.x-a.x)*(e.x-a.x)+(e.y-a.y)*(e.y-a.y)+(e.z-a.z)*(e.z-a.z))) FROM alarm a WHERE a.patch = e.patch AND a.detector = d.detector)")} AS nearest_mm
        FROM ev e CROSS JOIN dets d LEFT JOIN verdict v ON v.patch = e.patch AND v.detector = d.detector
        LEFT JOIN hit h ON h.event_id = e.event_id AND h.detector = d.detector WHERE e.status = 'confirmed'""",
        "ev", "dets", "verdict", "hit", "alarm"),
)
def event_score(t: Tables):
    return rounded(score(t.benchmark(), t.alarms()).event_score(), "nearest_mm")


# ------------------------------------------------------------------ false alarms
@query(
    "false_alarms_raw",
    with_views(
        """SELECT a.detector, a.patch, a.alarm_ord, v.run_id FROM alarm a JOIN rv v ON v.patch = a.patch AND v.status = 'confirmed'
        WHERE sqrt((a.x-v.x)*(a.x-v.x)+(a.y-v.y)*(a.y-v.y)+(a.z-v.z)*(a.z-v.z)) <= 25
        AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.patch = a.patch
          AND sqrt((a.x-e.x)*(a.x-e.x)+(a.y-e.y)*(a.y-e.y)+(a.z-e.z)*(a.z-e.z)) <= 25)
        GROUP BY 1, 2, 3, 4""", "alarm", "rv", "ev"),
)
def false_alarms_raw(t: Tables):
    runs = t.run_vertex().filter(F.col("status") == CONFIRMED)
    return false_alarm_pairs(t.alarm(), runs, t.gt_event(), RADIUS)


@query("false_alarms", with_views("SELECT detector, patch, alarm_ord, run_id FROM fa", "fa"))
def false_alarms(t: Tables):
    scored = t.benchmark().scored_patches()
    kept = greedy_dedup(t.alarm().join(scored, "patch", "left_semi"), DEDUP)
    runs = t.run_vertex().filter(F.col("status") == CONFIRMED)
    return false_alarm_pairs(kept, runs, t.gt_event(), RADIUS)


@query(
    "alarms_off_events",
    with_views(
        """SELECT detector, patch, alarm_ord FROM alarm a WHERE NOT EXISTS (SELECT 1 FROM ev e WHERE e.patch = a.patch
        AND sqrt((a.x-e.x)*(a.x-e.x)+(a.y-e.y)*(a.y-e.y)+(a.z-e.z)*(a.z-e.z)) <= 25)""", "alarm", "ev"),
)
def alarms_off_events(t: Tables):
    out = without_match(t.alarm(), t.gt_event(), RADIUS, ids=["detector", "patch", "alarm_ord"], keys=["patch"])
    return out.select("detector", "patch", "alarm_ord")


@query(
    "dedup",
    with_views("SELECT detector, patch, alarm_ord FROM kept", "kept"),
)
def dedup(t: Tables):
    scored = t.benchmark().scored_patches()
    return greedy_dedup(t.alarm().join(scored, "patch", "left_semi"), DEDUP).select("detector", "patch", "alarm_ord")


@query("dedup_tiled", with_views("SELECT detector, patch, alarm_ord FROM kept", "kept"))
def dedup_tiled(t: Tables):
    """The same rule over small tiles, so that many points lie in margins and chains leave their tiles."""
    scored = t.benchmark().scored_patches()
    raw = t.alarm().join(scored, "patch", "left_semi")
    return greedy_dedup(raw, DEDUP, tile_cells=4).select("detector", "patch", "alarm_ord")


@query(
    "close_pairs",
    with_views(
        f"""SELECT a.detector, a.patch, a.alarm_ord AS a_alarm_ord, b.alarm_ord AS b_alarm_ord,
        {s6('sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))')} AS dist
        FROM alarm a JOIN alarm b ON a.detector = b.detector AND a.patch = b.patch AND a.alarm_ord < b.alarm_ord
        WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) <= 50""", "alarm"),
)
def q_close_pairs(t: Tables):
    return rounded(close_pairs(t.alarm(), 50.0, "alarm_ord", keys=["detector", "patch"]), "dist")


@query(
    "clusters",
    with_views(
        f"""SELECT cluster, count(*) AS n, {s6('avg(x)')} AS x, {s6('avg(y)')} AS y, {s6('avg(z)')} AS z FROM
        (SELECT reach.node, min(reach.other) AS cluster FROM reach GROUP BY 1) c JOIN ev ON ev.event_id = c.node GROUP BY cluster""",
        "ev",
        extra={
            "edge": """SELECT a.event_id AS a, b.event_id AS b FROM ev a JOIN ev b USING (patch)
              WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) < 40""",
            "reach": "SELECT event_id AS node, event_id AS other FROM ev UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.other",
        }),
)
def clusters(t: Tables):
    ev = t.gt_event()
    c = spatial_clusters(ev, 40.0, "event_id", keys=["patch"])
    return rounded(
        c.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z")),
        "x", "y", "z",
    )


# ------------------------------------------------------------------ pooled scores and boards
SUMS = """detector, sum(hits)::BIGINT AS hits, sum(events)::BIGINT AS events, sum(false_alarms)::BIGINT AS false_alarms,
  sum(length) AS length, sum(alarms)::BIGINT AS alarms, sum(kept)::BIGINT AS kept,
  count(*) FILTER (verdict) AS patches_verdict, count(*) AS patches,
  coalesce(sum(events) FILTER (verdict), 0)::BIGINT AS events_verdict,
  coalesce(sum(length) FILTER (verdict), 0) AS length_verdict"""


@query(
    "coverage",
    with_views(
        f"""SELECT detector, patches_verdict, patches, events_verdict, events, {s6('length_verdict')} AS length_verdict,
        {s6('length')} AS length, patches_verdict::DOUBLE / patches < 0.5 AS limited_scope
        FROM (SELECT {SUMS} FROM patch_score GROUP BY detector)""", "patch_score"),
)
def coverage(t: Tables):
    out = score(t.benchmark(), t.alarms()).detector_score.select(
        "detector", "patches_verdict", "patches", "events_verdict", "events", "length_verdict", "length", "limited_scope"
    )
    return longs(rounded(out, "length_verdict", "length"), "events_verdict", "events", "patches_verdict", "patches")


@query(
    "patch_score",
    with_views(
        f"SELECT detector, patch, verdict, alarms, kept, events, hits, runs, {s6('length')} AS length, false_alarms FROM patch_score",
        "patch_score"),
)
def patch_score(t: Tables):
    return rounded(score(t.benchmark(), t.alarms()).patch_score, "length")


@query(
    "leaderboard",
    with_views(
        f"""SELECT row_number() OVER (ORDER BY coalesce(hits::DOUBLE / events, 0) DESC, patches_verdict::DOUBLE / patches < 0.5,
          coalesce(100.0 * false_alarms / nullif(length, 0), 'inf'::DOUBLE), detector) AS place,
        detector, hits, events, {sql_rates()}, false_alarms, {s6('length')} AS length,
        {s6('100.0::DOUBLE * false_alarms / nullif(length, 0)')} AS fa_per_100, alarms, kept, patches_verdict, patches,
        patches_verdict::DOUBLE / patches < 0.5 AS limited_scope
        FROM (SELECT {SUMS} FROM patch_score GROUP BY detector)""", "patch_score"),
)
def leaderboard(t: Tables):
    b = board.leaderboard(score(t.benchmark(), t.alarms()), intervals=False)
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*board.board_order()))  # one row per detector
    out = b.select(
        place.cast("long").alias("place"), "detector", "hits", "events", *RATES, "false_alarms", "length", "fa_per_100",
        "alarms", "kept", "patches_verdict", "patches", "limited_scope",
    )
    return rounded(out, *RATES, "length", "fa_per_100")


@query(
    "leaderboard_cells",
    with_views(
        f"""SELECT detector,
        printf('%.0f%% (%d/%d)', 100 * recall, hits, events) AS recall_cell,
        printf('[%.0f%%, %.0f%%]', 100 * lo, 100 * hi) AS interval_cell,
        printf('%.2f', 100.0::DOUBLE * false_alarms / length) AS fa_cell,
        printf('%d/%d', patches_verdict, patches) AS coverage_cell,
        CASE WHEN patches_verdict::DOUBLE / patches < 0.5 THEN 'Limited scope' ELSE 'Full' END AS scope_cell
        FROM (SELECT *, {sql_wilson('hits', 'events')[0]} AS recall, {sql_wilson('hits', 'events')[1]} AS lo, {sql_wilson('hits', 'events')[2]} AS hi
          FROM (SELECT {SUMS} FROM patch_score GROUP BY detector))""", "patch_score"),
)
def leaderboard_cells(t: Tables):
    return board.display(score(t.benchmark(), t.alarms()).detector_score)


@query(
    "board_warnings",
    with_views(
        """SELECT detector, unnest(list_filter([
          'geometry differs from the published fingerprint: not comparable',
          CASE WHEN unknown > 0 THEN printf('%d patch id(s) are not in the corpus', unknown) END, CASE WHEN unscored > 0 THEN printf('%d patch(es) carry nothing scored', unscored) END,
          CASE WHEN dropped > 0 THEN printf('%d alarm(s) on invalid vertices dropped', dropped) END,
          CASE WHEN off > 0 THEN printf('%d of %d alarm(s) farther than 25 mm from the surface', off, alarms) END,
          CASE WHEN n < patches THEN printf('no verdict on %d of %d scored patches', patches - n, patches) END], lambda x: x IS NOT NULL)) AS warning FROM (
        SELECT d.detector, (SELECT count(*) FROM given g WHERE g.detector = d.detector AND g.patch NOT IN (SELECT patch FROM scored) AND g.patch NOT IN (SELECT patch FROM known)) AS unknown,
          (SELECT count(*) FROM given g WHERE g.detector = d.detector AND g.patch NOT IN (SELECT patch FROM scored) AND g.patch IN (SELECT patch FROM known)) AS unscored,
          (SELECT count(*) FROM gridded q WHERE q.detector = d.detector AND q.patch IN (SELECT patch FROM scored) AND NOT EXISTS (SELECT 1 FROM grid g WHERE g.patch = q.patch AND g.row = q.row AND g.col = q.col)) AS dropped,
          (SELECT count(*) FROM inside a WHERE a.detector = d.detector) AS alarms,
          (SELECT count(*) FROM inside a WHERE a.detector = d.detector AND NOT EXISTS (SELECT 1 FROM rv v WHERE v.patch = a.patch
            AND sqrt((a.x-v.x)*(a.x-v.x) + (a.y-v.y)*(a.y-v.y) + (a.z-v.z)*(a.z-v.z)) <= 25)) AS off,
          (SELECT count(*) FROM verdict v WHERE v.detector = d.detector AND v.patch IN (SELECT patch FROM scored)) AS n, (SELECT count(*) FROM scored) AS patches FROM dets d)""",
        "scored", "dets", "verdict", "alarm", "ev", "rv", "grid",
        extra={
            "known": "SELECT DISTINCT patch FROM ev UNION SELECT DISTINCT patch FROM rv",
            "given": "SELECT DISTINCT kind AS detector, patch + CASE WHEN event_id % 40 = 0 THEN 1000000 ELSE 0 END AS patch FROM pt WHERE kind IN ('error', 'click', 'signup')",
            "gridded": "SELECT kind AS detector, patch, event_id % 50 AS row, event_id % 64 AS col FROM pt WHERE kind = 'error'",
            "inside": "SELECT a.* FROM alarm a JOIN scored USING (patch)",
        }),
)
def board_warnings(t: Tables):
    """All counters of the board: some ids are displaced, one detector's alarms are also looked up on the grid, the runs serve as surface."""
    import dataclasses

    from ..sources.alarms import on_grid

    bench = dataclasses.replace(t.benchmark(), surface=t.run_vertex().select("patch", "x", "y", "z"))
    raw = t.pt().filter(F.col("kind").isin("error", "click", "signup"))
    given = raw.select(F.col("kind").alias("detector"), (F.col("patch") + F.when(F.col("event_id") % 40 == 0, 1000000).otherwise(0)).alias("patch"))
    cells = raw.filter("kind = 'error'").selectExpr("kind as detector", "patch", "event_id as alarm_ord", "event_id % 50 as row", "event_id % 64 as col")
    _, dropped = on_grid(cells, t.grid(), bench.scored_patches())
    frames = score(bench, t.alarms())
    return board.warnings(board.warning_counters(frames, given, dropped, geometry_match=False), RADIUS)


# ------------------------------------------------------------------ cap
CAP_SQL = f"""SELECT event_id, patch, subset, stratum FROM (SELECT *, row_number() OVER (PARTITION BY patch
  ORDER BY md5('{SEED}|' || patch || '|' || event_id), event_id) AS rn FROM ev WHERE status = 'confirmed') WHERE rn <= 3"""


@query("cap_selection", with_views(f"SELECT patch, event_id FROM ({CAP_SQL})", "ev"))
def cap_selection(t: Tables):
    return counted_events(t.benchmark().events, 3, SEED).select("patch", "event_id")


@query(
    "recall_capped",
    with_views(
        f"""SELECT detector, count(h.event_id) AS hits, count(*) AS events, {sql_rates('count(h.event_id)', 'count(*)')}
        FROM (SELECT c.event_id, d.detector FROM ({CAP_SQL}) c CROSS JOIN dets d) e LEFT JOIN hit h USING (event_id, detector)
        GROUP BY detector""", "ev", "dets", "hit"),
)
def recall_capped(t: Tables):
    d = score(t.benchmark(), t.alarms(), per_patch_cap=3).detector_score
    return rounded(d.select("detector", "hits", "events", *RATES), *RATES)


# ------------------------------------------------------------------ bootstrap
def boot_views(source: str, draws: int, block: str = "block") -> dict[str, str]:
    """SQL of the hash-picked block bootstrap; ``source`` has (block, series, num, den)."""
    return {
        "blk": source,
        "numbered": f"SELECT {block}, row_number() OVER (ORDER BY md5({block}::VARCHAR), {block}) - 1 AS ordinal FROM (SELECT DISTINCT {block} FROM blk)",
        "size": "SELECT count(*) AS n FROM numbered",
        "plan": f"""SELECT b.draw, ('0x' || substr(md5('{SEED}|' || b.draw || '|' || s.slot), 1, 8))::BIGINT % size.n AS ordinal
          FROM size, (SELECT unnest(range({draws})) AS draw) b, LATERAL (SELECT unnest(range(size.n)) AS slot) s""",
        "pooled": f"""SELECT series, draw, sum(num)::DOUBLE AS num, sum(den)::DOUBLE AS den FROM plan JOIN numbered USING (ordinal)
          JOIN blk USING ({block}) GROUP BY 1, 2""",
    }


@query(
    "boot_recall",
    with_views(
        f"""SELECT series AS detector, {s6('quantile_cont(num / den, 0.025)')} AS recall_boot_lo, {s6('quantile_cont(num / den, 0.975)')} AS recall_boot_hi
        FROM pooled WHERE den > 0 GROUP BY series""", "ev", "dets", "hit",
        extra=boot_views(
            """SELECT e.patch AS block, d.detector AS series, count(h.event_id) AS num, count(*) AS den FROM ev e CROSS JOIN dets d
            LEFT JOIN hit h ON h.event_id = e.event_id AND h.detector = d.detector WHERE e.status = 'confirmed' GROUP BY 1, 2""", DRAWS)),
)
def boot_recall(t: Tables):
    return rounded(score(t.benchmark(), t.alarms()).recall_intervals().select("detector", "recall_boot_lo", "recall_boot_hi"), "recall_boot_lo", "recall_boot_hi")


@query(
    "boot_fa",
    with_views(
        f"""SELECT series AS detector, {s6('quantile_cont(100.0::DOUBLE * num / den, 0.025)')} AS fa_boot_lo,
        {s6('quantile_cont(100.0::DOUBLE * num / den, 0.975)')} AS fa_boot_hi
        FROM pooled WHERE den > 0 GROUP BY series""", "patch_score",
        extra=boot_views("SELECT patch AS block, detector AS series, false_alarms AS num, length AS den FROM patch_score", DRAWS)),
)
def boot_fa(t: Tables):
    return rounded(score(t.benchmark(), t.alarms()).false_alarm_intervals().select("detector", "fa_boot_lo", "fa_boot_hi"), "fa_boot_lo", "fa_boot_hi")


@query(
    "boot_area",
    with_views(
        f"""SELECT {s6('quantile_cont(2.0::DOUBLE * num / den, 0.025)')} AS returned_lo, {s6('quantile_cont(2.0::DOUBLE * num / den, 0.975)')} AS returned_hi,
        {s6('quantile_cont(2.0::DOUBLE * num2 / den, 0.025)')} AS open_lo, {s6('quantile_cont(2.0::DOUBLE * num2 / den, 0.975)')} AS open_hi
        FROM (SELECT draw, sum(k1)::DOUBLE AS num, sum(k2)::DOUBLE AS num2, sum(a) AS den FROM plan JOIN numbered USING (ordinal) JOIN two USING (block) GROUP BY draw)""",
        extra={
            "two": """SELECT l_suppkey AS block, count(*) FILTER (l_returnflag = 'R') AS k1, count(*) FILTER (l_linestatus = 'O') AS k2,
              sum(l_quantity) AS a FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 0""",
            **{k: v for k, v in boot_views("SELECT block FROM two", DRAWS).items() if k != "pooled"},
        }),
)
def boot_area(t: Tables):
    """Two rates per area share every draw; blocks are the parent keys of the rows."""
    li = t.read("lineitem")
    rows = li.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("k1"), F.count_if(F.col("l_linestatus") == "O").alias("k2"),
        F.sum("l_quantity").alias("area"),
    ).filter(F.col("area") > 0)
    out = bootstrap_ratio(
        rows, {"returned": (F.col("k1"), F.col("area")), "open": (F.col("k2"), F.col("area"))},
        block="l_suppkey", seed=SEED, scale=2.0,
    )
    return rounded(out, *out.columns)


# ------------------------------------------------------------------ settings grid and census
GRID_HITS = """SELECT e.event_id, e.patch, e.subset, a.detector, r.radius,
    bool_or(sqrt((e.x-a.x)*(e.x-a.x)+(e.y-a.y)*(e.y-a.y)+(e.z-a.z)*(e.z-a.z)) <= r.radius) AS hit
    FROM ev e JOIN alarm a USING (patch), (VALUES (10.0::DOUBLE), (25.0::DOUBLE), (50.0::DOUBLE)) r(radius)
    WHERE e.status = 'confirmed' GROUP BY ALL"""


@query(
    "settings_grid",
    with_views(
        f"""SELECT detector, cap, radius, coalesce(subset, 'pooled') AS subset, sum(hit)::BIGINT AS hits, count(*) AS events,
        {sql_rates('sum(hit)', 'count(*)')}
        FROM (SELECT e.event_id, e.subset, e.cap, d.detector, r.radius, coalesce(g.hit, FALSE)::INT AS hit
          FROM (SELECT event_id, subset, 0::BIGINT AS cap FROM ev WHERE status = 'confirmed'
                UNION ALL SELECT event_id, subset, 3 FROM ({CAP_SQL})) e
          CROSS JOIN dets d CROSS JOIN (VALUES (10.0::DOUBLE), (25.0::DOUBLE), (50.0::DOUBLE)) r(radius)
          LEFT JOIN g ON g.event_id = e.event_id AND g.detector = d.detector AND g.radius = r.radius)
        GROUP BY GROUPING SETS ((detector, cap, radius, subset), (detector, cap, radius))""",
        "ev", "alarm", "dets", extra={"g": GRID_HITS}),
)
def settings_grid(t: Tables):
    cells = rob.settings_blocks(t.benchmark(), t.alarms(), caps=[0, 3], radii=[10.0, 25.0, 50.0], seed=SEED)
    return longs(rounded(rob.settings_recall(cells), *RATES), "cap", "hits", "events")


@query(
    "settings_hold",
    with_views(
        f"""SELECT bool_and(corrected < 0.6) AS all_hold, count(*) AS settings,
        {s6("max(corrected) FILTER (cap = 3 AND radius = 25 AND detector = 'error' AND subset = 'pooled')")} AS frozen_corrected
        FROM (SELECT subset, detector, cap, radius, quantile_cont(num / den, 0.975) / 0.5519 AS corrected FROM (
          SELECT subset, g2.detector, g2.cap, g2.radius, p.draw, sum(g2.k)::DOUBLE AS num, sum(g2.n)::DOUBLE AS den
          FROM plan p JOIN numbered USING (subset, ordinal) JOIN g2 USING (subset, block) GROUP BY 1, 2, 3, 4, 5)
        WHERE den > 0 GROUP BY 1, 2, 3, 4)""",
        "ev", "alarm", "dets",
        extra={
            "g": GRID_HITS,
            "capped": f"""SELECT event_id, patch, subset, 0::BIGINT AS cap FROM ev WHERE status = 'confirmed'
              UNION ALL SELECT event_id, patch, subset, 1 FROM ({CAP_SQL.replace('rn <= 3', 'rn <= 1')}) UNION ALL SELECT event_id, patch, subset, 3 FROM ({CAP_SQL})""",
            "g2": """SELECT e.patch AS block, e.subset, e.cap, d.detector, r.radius, count(*) AS n, count(*) FILTER (g.hit) AS k
              FROM (SELECT * FROM capped UNION ALL SELECT event_id, patch, 'pooled', cap FROM capped) e
              CROSS JOIN dets d CROSS JOIN (VALUES (10.0::DOUBLE), (25.0::DOUBLE), (50.0::DOUBLE)) r(radius)
              LEFT JOIN g ON g.event_id = e.event_id AND g.detector = d.detector AND g.radius = r.radius GROUP BY 1, 2, 3, 4, 5""",
            "numbered": "SELECT subset, block, row_number() OVER (PARTITION BY subset ORDER BY md5(block::VARCHAR), block) - 1 AS ordinal FROM (SELECT DISTINCT subset, block FROM g2)",
            "size": "SELECT subset, count(*) AS n FROM numbered GROUP BY 1",
            "plan": f"""SELECT size.subset, b.draw, ('0x' || substr(md5('{SEED}|' || b.draw || '|' || s.slot), 1, 8))::BIGINT % size.n AS ordinal
              FROM size, (SELECT unnest(range({DRAWS})) AS draw) b, LATERAL (SELECT unnest(range(size.n)) AS slot) s""",
        }),
)
def settings_hold(t: Tables):
    """Do all settings stay below the bar after the correction for label precision, and the frozen setting?

    Every subset is a block set of its own, and so are all of them pooled.
    """
    cells = rob.settings_blocks(t.benchmark(), t.alarms(), caps=[0, 1, 3], radii=[10.0, 25.0, 50.0], seed=SEED)
    cells = cells.withColumn("subset", F.explode(F.array("subset", F.lit("pooled"))))
    ci = rob.settings_intervals(cells, seed=SEED, by=["subset"])
    frozen = (F.col("cap") == 3) & (F.col("radius") == 25.0) & (F.col("detector") == "error") & (F.col("subset") == "pooled")
    out = rob.holds(ci, precision_lower=0.5519, bar=0.6, frozen=frozen)
    return rounded(out, "frozen_corrected")


@query(
    "batch_recall",
    with_views(
        f"""SELECT detector, week AS batch, count(h.event_id) AS hits, count(*) AS events, {sql_rates('count(h.event_id)', 'count(*)')}
        FROM (SELECT event_id, floor(y / 168)::BIGINT AS week, d.detector FROM ev CROSS JOIN dets d WHERE status = 'confirmed') e
        LEFT JOIN hit h USING (event_id, detector) GROUP BY 1, 2""", "ev", "dets", "hit"),
)
def batch_recall(t: Tables):
    ev = t.gt_event().withColumn("batch", F.floor(F.col("y") / 168).cast("long"))
    return rounded(rob.recall_by(ev, t.alarms(), RADIUS, ["batch"]), *RATES)


@query(
    "status_contrast",
    with_views(
        f"""SELECT e.detector, e.status, count(h.event_id) AS hits, count(*) AS events, {sql_rates('count(h.event_id)', 'count(*)')},
        count(DISTINCT e.patch) AS patches, count(DISTINCT v.patch) AS patches_verdict
        FROM (SELECT event_id, patch, status, d.detector FROM ev CROSS JOIN dets d WHERE status <> 'unconfirmed') e
        LEFT JOIN verdict v ON v.patch = e.patch AND v.detector = e.detector
        LEFT JOIN hit h ON h.event_id = e.event_id AND h.detector = e.detector GROUP BY 1, 2""", "ev", "dets", "hit", "verdict"),
)
def status_contrast(t: Tables):
    ev = t.gt_event().filter(F.col("status") != "unconfirmed")
    rate = rob.recall_by(ev, t.alarms(), RADIUS, ["status"], any_status=True)
    cover = rob.coverage_by_status(ev, t.alarms())
    return rounded(rate.join(cover, ["detector", "status"]), *RATES)


@query(
    "census",
    with_views(
        """SELECT coalesce(subset, 'pooled') AS subset, count(*) AS patches, sum(candidates)::BIGINT AS candidates, sum(confirmed)::BIGINT AS confirmed,
        sum(contradicted)::BIGINT AS contradicted, sum(unconfirmed)::BIGINT AS unconfirmed, sum(abrupt)::BIGINT AS abrupt,
        sum(confirmed_second)::BIGINT AS confirmed_second, sum(confirmed_both)::BIGINT AS confirmed_both, sum(multi)::BIGINT AS multi,
        sum(runs_confirmed)::BIGINT AS runs_confirmed, sum(runs_other)::BIGINT AS runs_other,"""
        + s6("sum(length_confirmed)")
        + """ AS length_confirmed,
        count(*) FILTER (confirmed > 0 OR runs_confirmed > 0) AS scored_patches, count(*) FILTER (confirmed > 0) AS event_patches,
        max(confirmed) AS max_events_per_patch
        FROM (SELECT patch, CASE WHEN patch % 2 = 0 THEN 'v0' ELSE 'new' END AS subset,
            coalesce(e.candidates, 0) AS candidates, coalesce(e.confirmed, 0) AS confirmed, coalesce(e.contradicted, 0) AS contradicted,
            coalesce(e.unconfirmed, 0) AS unconfirmed, coalesce(e.abrupt, 0) AS abrupt,
            coalesce(e.second, 0) AS confirmed_second, coalesce(e.agree, 0) AS confirmed_both, coalesce(m.multi, 0) AS multi,
            coalesce(r.rc, 0) AS runs_confirmed, coalesce(r.ro, 0) AS runs_other, coalesce(r.len, 0.0) AS length_confirmed
          FROM (SELECT patch, count(*) AS candidates, count(*) FILTER (status = 'confirmed') AS confirmed,
              count(*) FILTER (status = 'contradicted') AS contradicted, count(*) FILTER (status = 'unconfirmed') AS unconfirmed,
              count(*) FILTER (event_id % 7 < 4) AS second, count(*) FILTER (event_id % 7 < 4 AND status = 'confirmed') AS agree,
              count(*) FILTER (stratum = 'abrupt') AS abrupt FROM ev GROUP BY patch) e
          FULL JOIN (SELECT patch, count(*) FILTER (status = 'confirmed') AS rc, count(*) FILTER (status <> 'confirmed') AS ro,
              sum(length) FILTER (status = 'confirmed') AS len FROM run GROUP BY patch) r USING (patch)
          FULL JOIN (SELECT patch, count(*) AS multi FROM (SELECT patch FROM ev GROUP BY patch, floor(x / 10) HAVING count(*) > 1) GROUP BY patch) m USING (patch))
        GROUP BY GROUPING SETS ((subset), ())""", "ev", "run"),
)
def census(t: Tables):
    """The second rule goes by the event's number; entries for several events are slabs of 10 units that events of a patch share."""
    bench = t.benchmark()
    shared = bench.event_points.groupBy("patch", F.floor(F.col("x") / 10).alias("slab")).agg(F.countDistinct("event_id").alias("n")).filter("n > 1")
    subset = F.when(F.col("patch") % 2 == 0, "v0").otherwise("new")
    return rounded(rob.census(bench, subset, F.col("event_id") % 7 < 4, shared.select("patch")), "length_confirmed")


@query(
    "sweep_summary",
    with_views(
        f"""SELECT x.detector, count(h.event_id) AS hits, count(*) AS events,
        count(h.event_id) FILTER (x.patch <> big) AS hits_without_big, count(*) FILTER (x.patch <> big) AS events_without_big,
        count(h.event_id) FILTER (capped) AS hits_capped, count(*) FILTER (capped) AS events_capped,
        count(h.event_id) FILTER (stratum = 'abrupt') AS hits_abrupt, count(*) FILTER (stratum = 'abrupt') AS events_abrupt,
        count(h.event_id) FILTER (stratum = 'gradual') AS hits_gradual, count(*) FILTER (stratum = 'gradual') AS events_gradual
        FROM (SELECT e.event_id, e.patch, e.stratum, d.detector, c.event_id IS NOT NULL AS capped, b.big FROM ev e CROSS JOIN dets d
          LEFT JOIN ({CAP_SQL}) c ON c.event_id = e.event_id
          CROSS JOIN (SELECT patch AS big FROM ev WHERE status = 'confirmed' GROUP BY patch ORDER BY count(*) DESC, patch LIMIT 1) b
          WHERE e.status = 'confirmed') x LEFT JOIN hit h ON h.event_id = x.event_id AND h.detector = x.detector
        GROUP BY x.detector""", "ev", "dets", "hit"),
)
def sweep_summary(t: Tables):
    return rob.sweep_summary(t.benchmark(), t.alarms(), RADIUS, cap=3, seed=SEED, flag=F.col("stratum") == "abrupt")


@query(
    "highest_hit_radius",
    with_views(
        """SELECT detector, count(*) AS events, count(*) FILTER (best IS NULL) AS never_hit, max(best) AS largest, min(best) AS smallest
        FROM (SELECT e.event_id, d.detector, (SELECT min(radius) FROM g WHERE g.event_id = e.event_id AND g.detector = d.detector AND g.hit) AS best
          FROM ev e CROSS JOIN dets d WHERE e.status = 'confirmed') GROUP BY detector""",
        "ev", "alarm", "dets", extra={"g": GRID_HITS}),
)
def highest_hit_radius(t: Tables):
    """Per event the extreme sweep value at which it is still hit, and how many events are never hit."""
    return rob.extreme_hit_setting(t.benchmark(), t.alarms(), [10.0, 25.0, 50.0])


@query(
    "unknown_patches",
    with_views(
        """SELECT kind AS detector, u.patch, CASE WHEN k.patch IS NULL THEN 'unknown' ELSE 'unscored' END AS kind
        FROM (SELECT DISTINCT kind, patch + CASE WHEN kind = 'error' THEN 100000 ELSE 0 END AS patch FROM pt WHERE kind IN ('error', 'click')) u
        LEFT JOIN (SELECT DISTINCT patch FROM ev UNION SELECT DISTINCT patch FROM rv) k ON k.patch = u.patch
        WHERE u.patch NOT IN (SELECT patch FROM scored)""", "pt", "ev", "rv", "scored"),
)
def unknown_patches(t: Tables):
    """Input ids that are not scored: known to the corpus, or unknown (the error rows carry shifted ids)."""
    from ..plans.score import classify_patches

    src = t.pt().filter(F.col("kind").isin("error", "click"))
    ids = src.select(
        F.col("kind").alias("detector"),
        (F.col("patch") + F.when(F.col("kind") == "error", 100000).otherwise(0)).alias("patch"),
    )
    return classify_patches(t.benchmark(), ids)


@query("board_rank", with_views("SELECT 1 + count(*) FILTER (r > 0.05) AS rank FROM (SELECT detector, count(h.event_id)::DOUBLE / count(*) AS r FROM (SELECT e.event_id, d.detector FROM ev e CROSS JOIN dets d WHERE e.status = 'confirmed') LEFT JOIN hit h USING (event_id, detector) GROUP BY 1)", "ev", "dets", "hit"))
def board_rank(t: Tables):
    """Place a recall of 0.05 would take among the detectors."""
    rows = rob.recall_by(t.gt_event().withColumn("all", F.lit(1)), t.alarms(), RADIUS, ["all"])
    return board.rank_of(rows, 0.05)
