"""Profile-rule and parameter-sweep queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import profile as P
from .base import SEED, Tables, query, r6, rounded, s6, with_views
from .score_queries import RATES, sql_rates


def sql_smooth(sigma: float) -> str:
    """Mirrored Gaussian smoothing of view ``profile`` (64 samples) as (profile_id, t, vs)."""
    k = P.gaussian_kernel(sigma)
    r = len(k) // 2
    values = ", ".join(f"({i - r}, {w!r}::DOUBLE)" for i, w in enumerate(k))
    pos = "((p.i + k.o) % 128 + 128) % 128"
    return f"""SELECT p.profile_id, p.i, p.t, sum(k.w * q.v) AS vs FROM profile p CROSS JOIN (VALUES {values}) k(o, w)
      JOIN profile q ON q.profile_id = p.profile_id AND q.i = CASE WHEN {pos} < 64 THEN {pos} ELSE 127 - {pos} END GROUP BY 1, 2, 3"""


def controls(t: Tables):
    """Every embedding is a profile; the kind fixes where its two ends lie."""
    p = P.collect_profiles(t.profile())
    k = "profile_id % 3"
    return p.selectExpr(
        "profile_id", "t", "v", f"case {k} when 0 then 'adjacent' when 1 then 'two_apart' else 'same_sheet' end as kind",
        "if(profile_id % 2 = 0, 'tune', 'test') as split", "28D as t0",
        f"case {k} when 0 then 36D when 1 then 44D else 30D end as t1", "if(profile_id % 3 = 2, 10D, 8D) as s",
    )


CTRL = """SELECT DISTINCT profile_id, CASE profile_id % 3 WHEN 0 THEN 'adjacent' WHEN 1 THEN 'two_apart' ELSE 'same_sheet' END AS kind,
  CASE WHEN profile_id % 2 = 0 THEN 'tune' ELSE 'test' END AS split, 28.0::DOUBLE AS t0,
  CASE profile_id % 3 WHEN 0 THEN 36.0::DOUBLE WHEN 1 THEN 44.0::DOUBLE ELSE 30.0::DOUBLE END AS t1,
  CASE WHEN profile_id % 3 = 2 THEN 10.0::DOUBLE ELSE 8.0::DOUBLE END AS s FROM profile"""


def sql_rule(sigmas, zones, darks, qs, biases) -> dict[str, str]:
    """The two-sheet rule over a parameter grid as CTEs; ``verdict`` has one row per profile and setting."""
    vals = lambda xs, c: "(VALUES " + ", ".join(f"({float(x)!r}::DOUBLE)" for x in xs) + f") {c}({c})"
    union = " UNION ALL ".join(f"SELECT {float(s)!r}::DOUBLE AS sigma, * FROM ({sql_win_smooth(s)})" for s in sigmas)
    return {
        "ctrl": CTRL,
        "win": """SELECT p.profile_id, p.t, p.v, row_number() OVER (PARTITION BY p.profile_id ORDER BY p.t) - 1 AS i, count(*) OVER (PARTITION BY p.profile_id) AS n
          FROM profile p JOIN ctrl c USING (profile_id) WHERE p.t >= least(t0, t1) - 3 * s - 1e-9 AND p.t <= greatest(t0, t1) + 3 * s + 1e-9""",
        "sm": union,
        "par": f"SELECT * FROM {vals(zones, 'end_zone')} CROSS JOIN {vals(darks, 'min_dark')} CROSS JOIN {vals(qs, 'q')} CROSS JOIN {vals(biases, 'mid_bias')}",
        "lev": " UNION ALL ".join(
            f"SELECT sigma, profile_id, {float(q)!r}::DOUBLE AS q, quantile_cont(vs, {q / 100!r}) AS lo, quantile_cont(vs, {1 - q / 100!r}) AS hi FROM sm GROUP BY 1, 2"
            for q in qs),
        "lim": """SELECT c.*, l.sigma, p.*, l.lo, l.hi, (l.lo + l.hi) / 2 AS thr, (l.lo + l.hi) / 2 - p.mid_bias * (l.hi - l.lo) AS mid,
          greatest(p.end_zone * c.s, 0.500001) AS ez, row_number() OVER () AS case_id FROM ctrl c JOIN lev l USING (profile_id) JOIN par p ON p.q = l.q""",
        "pts": """SELECT l.case_id, m.t, m.vs, l.thr, l.mid, l.ez, least(t0, t1) AS a, greatest(t0, t1) AS b, l.min_dark FROM lim l JOIN sm m ON m.profile_id = l.profile_id AND m.sigma = l.sigma""",
        "ends": """SELECT case_id, max(vs) FILTER (t BETWEEN a - ez AND a + ez) > any_value(thr) AS bl, max(vs) FILTER (t BETWEEN b - ez AND b + ez) > any_value(thr) AS bh,
          count(*) FILTER (t BETWEEN a AND b) AS inside FROM pts GROUP BY 1""",
        "dark": """SELECT case_id, count(*) AS n FROM (SELECT case_id, isl, count(*) AS len, any_value(min_dark) AS md FROM
          (SELECT *, t - row_number() OVER (PARTITION BY case_id ORDER BY t) AS isl FROM pts WHERE t BETWEEN a AND b AND vs < thr) GROUP BY 1, 2) WHERE len >= md GROUP BY 1""",
        "bright": """SELECT case_id, count(*) AS n FROM (SELECT case_id, isl, min(t) AS f, max(t) AS g, any_value(a) AS a, any_value(b) AS b, any_value(ez) AS ez FROM
          (SELECT *, t - row_number() OVER (PARTITION BY case_id ORDER BY t) AS isl FROM pts WHERE t BETWEEN a AND b AND vs >= mid) GROUP BY 1, 2) WHERE f > a + ez AND g < b - ez GROUP BY 1""",
        "verdict_p": """SELECT l.*, CASE WHEN l.hi - l.lo < 15 OR e.bl IS NULL OR e.bh IS NULL OR e.inside < 2 THEN NULL
          ELSE e.bl AND e.bh AND coalesce(d.n, 0) = 1 AND coalesce(m.n, 0) = 0 END AS passed
          FROM lim l JOIN ends e USING (case_id) LEFT JOIN dark d USING (case_id) LEFT JOIN bright m USING (case_id)""",
    }


def sql_win_smooth(sigma: float) -> str:
    k = P.gaussian_kernel(sigma)
    r = len(k) // 2
    values = ", ".join(f"({i - r}, {w!r}::DOUBLE)" for i, w in enumerate(k))
    pos = "((p.i + k.o) % (2 * p.n) + 2 * p.n) % (2 * p.n)"
    return f"""SELECT p.profile_id, p.t, sum(k.w * q.v) AS vs FROM win p CROSS JOIN (VALUES {values}) k(o, w)
      JOIN win q ON q.profile_id = p.profile_id AND q.i = CASE WHEN {pos} < p.n THEN {pos} ELSE 2 * p.n - 1 - {pos} END GROUP BY 1, 2"""


SWEEP_SQL = sql_rule(*P.SWEEP.values())
ONE_SQL = sql_rule([1.0], [0.2], [1.0], [20.0], [0.15])


@query("smoothed_profiles", with_views(f"SELECT profile_id, t, {s6('vs')} AS vs FROM sm", "profile", extra={"sm": sql_smooth(1.5)}))
def smoothed_profiles(t: Tables):
    p = P.smooth(P.collect_profiles(t.profile()), 1.5)
    return p.select("profile_id", F.inline(F.arrays_zip("t", "vs"))).select("profile_id", "t", r6("vs").alias("vs"))


@query("profile_rule", with_views("SELECT profile_id, kind, passed FROM verdict_p", "profile", extra=ONE_SQL))
def profile_rule(t: Tables):
    d = P.smooth(P.window(controls(t)), 1.0).selectExpr("*", "0.2D as end_zone", "1D as min_dark", "20D as q", "0.15D as mid_bias")
    return P.two_sheet_rule(d, 1.0).select("profile_id", "kind", "passed")


@query(
    "on_layer",
    with_views(
        """SELECT profile_id, CASE WHEN quantile_cont(vs, 0.7) - quantile_cont(vs, 0.3) < 15 THEN NULL
        ELSE max(vs) FILTER (abs(t - 32) <= 1.3 + 1e-9) > (quantile_cont(vs, 0.7) + quantile_cont(vs, 0.3)) / 2 END AS on_layer FROM sm GROUP BY 1""",
        "profile", extra={"sm": sql_smooth(1.0)}),
)
def on_layer(t: Tables):
    p = P.collect_profiles(t.profile().withColumn("t", F.col("t") - 32)).selectExpr("*", "8D as s")
    return P.on_layer(P.smooth(p, 1.0), 1.0).select("profile_id", "on_layer")


@query(
    "profile_sweep",
    with_views(
        """SELECT kind, split, sigma, end_zone, min_dark, q, mid_bias, count(*) AS n, count(passed) AS decided, count(*) FILTER (passed) AS passed
        FROM verdict_p GROUP BY ALL""", "profile", extra=SWEEP_SQL),
)
def profile_sweep(t: Tables):
    return P.sweep(controls(t), 1.0)


TABLE = {**SWEEP_SQL, "tab": """SELECT *, adjacent - greatest(two_apart, same_sheet) AS margin, two_apart <= 0.05 AND same_sheet <= 0.05 AS qualifies FROM (
    SELECT sigma, end_zone, min_dark, q, mid_bias,
      coalesce(count(*) FILTER (passed AND kind = 'adjacent')::DOUBLE / nullif(count(passed) FILTER (kind = 'adjacent'), 0), 0) AS adjacent,
      coalesce(count(*) FILTER (passed AND kind = 'two_apart')::DOUBLE / nullif(count(passed) FILTER (kind = 'two_apart'), 0), 0) AS two_apart,
      coalesce(count(*) FILTER (passed AND kind = 'same_sheet')::DOUBLE / nullif(count(passed) FILTER (kind = 'same_sheet'), 0), 0) AS same_sheet
    FROM verdict_p WHERE split = 'tune' GROUP BY 1, 2, 3, 4, 5)"""}
ORDER = "qualifies DESC, CASE WHEN qualifies THEN adjacent ELSE 0 END DESC, margin DESC, sigma, end_zone, min_dark, q, mid_bias"
SHOWN = ["adjacent", "two_apart", "same_sheet", "margin"]
COLS = "sigma, end_zone, min_dark, q, mid_bias, " + ", ".join(f"{s6(c)} AS {c}" for c in SHOWN) + ", qualifies"


def _table(t: Tables):
    return P.sweep_table(P.sweep(controls(t).filter("split = 'tune'"), 1.0))


@query("sweep_choice", with_views(f"SELECT {COLS} FROM tab ORDER BY {ORDER} LIMIT 1", "profile", extra=TABLE))
def sweep_choice(t: Tables):
    return rounded(P.choose(_table(t)), *SHOWN)


@query("sweep_top", with_views(f"SELECT {COLS} FROM tab ORDER BY {ORDER} LIMIT 10", "profile", extra=TABLE))
def sweep_top(t: Tables):
    return rounded(P.top_sets(_table(t)), *SHOWN)


@query(
    "sweep_frontier",
    with_views(
        f"""SELECT ceiling, {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY ceiling ORDER BY adjacent DESC, two_apart, sigma, end_zone, min_dark, q, mid_bias) AS k
        FROM tab JOIN (VALUES (0.05::DOUBLE), (0.075::DOUBLE), (0.1::DOUBLE), (0.15::DOUBLE)) c(ceiling) ON two_apart <= ceiling AND same_sheet <= ceiling) WHERE k = 1""",
        "profile", extra=TABLE),
)
def sweep_frontier(t: Tables):
    out = P.frontier(_table(t), "adjacent", ["two_apart", "same_sheet"], ties=["two_apart", *P.SWEEP])
    return rounded(out, *SHOWN)


@query(
    "rule_rates",
    with_views(
        f"SELECT kind, split, count(*) AS n, count(passed) AS decided, count(*) FILTER (passed) AS passed, {sql_rates('count(*) FILTER (passed)', 'count(passed)')} FROM verdict_p GROUP BY 1, 2",
        "profile", extra=ONE_SQL),
)
def rule_rates(t: Tables):
    r = P.sweep(controls(t), 1.0, {"sigma": [1.0], "end_zone": [0.2], "min_dark": [1.0], "q": [20.0], "mid_bias": [0.15]})
    return rounded(r.select("kind", "split", "n", "decided", "passed", *S.wilson(F.col("passed"), F.col("decided"))), *RATES)


@query(
    "event_votes",
    with_views(
        """SELECT profile_id // 5 AS event_id, count(passed) AS decided, CASE WHEN count(passed) > 0 THEN 2 * count(*) FILTER (passed) > count(passed) END AS verdict,
        CASE WHEN count(passed) = 0 THEN 'unconfirmed' WHEN 2 * count(*) FILTER (passed) > count(passed) THEN 'confirmed' ELSE 'contradicted' END AS status
        FROM verdict_p GROUP BY 1""", "profile", extra=ONE_SQL),
)
def event_votes(t: Tables):
    d = profile_rule(t).selectExpr("profile_id div 5 as event_id", "passed")
    v = d.groupBy("event_id").agg(F.count("passed").alias("decided"), S.majority_agg(F.col("passed")).alias("verdict"))
    return v.withColumn("status", S.tri_state(F.col("verdict")))


@query(
    "ladder_controls",
    with_views(
        f"""SELECT kind, coll, w, {s6('length')} AS length, {s6('s')} AS s,
          CASE WHEN ('0x' || substr(md5('{SEED}.split|' || coll), 1, 8))::BIGINT < 2147483648 THEN 'tune' ELSE 'test' END AS split FROM (
          SELECT 'adjacent' AS kind, coll, w, l1 AS length, l1 AS s FROM lad WHERE w1 - w = 1 AND l1 >= 1e-6
          UNION ALL SELECT 'same_sheet', coll, w, l1, l1 FROM lad WHERE w1 - w = 1 AND l1 >= 1e-6
          UNION ALL SELECT 'two_apart', coll, w, l2, least(l1, l12) FROM lad WHERE w1 - w = 1 AND l1 >= 1e-6 AND w2 - w = 2 AND l2 >= 1e-6)""", "pt",
        extra={"lad": """SELECT *, sqrt(pow(x1-x,2)+pow(y1-y,2)+pow(z1-z,2)) AS l1, sqrt(pow(x2-x,2)+pow(y2-y,2)+pow(z2-z,2)) AS l2, sqrt(pow(x2-x1,2)+pow(y2-y1,2)+pow(z2-z1,2)) AS l12 FROM (
          SELECT coll, w, x, y, z, lead(w) OVER q AS w1, lead(w, 2) OVER q AS w2, lead(x) OVER q AS x1, lead(y) OVER q AS y1, lead(z) OVER q AS z1, lead(x, 2) OVER q AS x2, lead(y, 2) OVER q AS y2, lead(z, 2) OVER q AS z2
          FROM (SELECT patch AS coll, floor(y / 24)::BIGINT AS w, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pt WHERE kind = 'view' GROUP BY 1, 2) WINDOW q AS (PARTITION BY coll ORDER BY w))"""}),
)
def ladder_controls(t: Tables):
    pts = t.pt().filter("kind = 'view'").groupBy(F.col("patch").alias("coll"), F.floor(F.col("y") / 24).cast("long").alias("w")).agg(*[F.avg(a).alias(a) for a in "xyz"])
    return rounded(P.ladder_controls(pts).select("kind", "coll", "w", "length", "s", "split"), "length", "s")
