"""Rank statistics, distributions, contingency, sampling and decision-rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import stats as S
from ..functions import text as T
from ..operators import profile as P
from ..operators import sampling as smp
from ..operators import stats as st
from ..operators.bootstrap import DRAWS, bootstrap_ratio
from ..operators.ordered import exact_percentiles
from .base import SEED, Tables, longs, query, r6, rounded, s6, with_views
from .score_queries import RATES, boot_views, sql_rates, sql_wilson



def _toxic():
    return F.col("toxic") == 1



@query(
    "auroc",
    with_views(
        f"""SELECT lang, count(*) FILTER (toxic = 1) AS n_pos, count(*) FILTER (toxic <> 1) AS n_neg,
        {s6("(sum(rk) FILTER (toxic = 1) - count(*) FILTER (toxic = 1) * (count(*) FILTER (toxic = 1) + 1) / 2.0::DOUBLE) / nullif(count(*) FILTER (toxic = 1) * count(*) FILTER (toxic <> 1), 0)")} AS auroc
        FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS rk FROM scored_doc) GROUP BY 1""", "scored_doc"),
)
def auroc(t: Tables):
    return rounded(st.auroc(t.scored_doc(), "n_chars", _toxic(), ["lang"]), "auroc")


@query(
    "boot_auroc",
    with_views(
        f"""SELECT {s6('(SELECT u / (p * n) FROM whole)')} AS auroc, {s6('quantile_cont(u / (p * n), 0.025)')} AS lo, {s6('quantile_cont(u / (p * n), 0.975)')} AS hi, count(*) AS n_boot
        FROM per_draw WHERE p > 0 AND n > 0""", "scored_doc",
        extra={
            "blk": "SELECT source AS block, n_chars, toxic FROM scored_doc",
            **{k: v for k, v in boot_views("", DRAWS).items() if k in ("numbered", "size", "plan")},
            "weighed": "SELECT draw, n_chars, count(*) FILTER (toxic = 1)::DOUBLE AS pos, count(*) FILTER (toxic <> 1)::DOUBLE AS neg FROM plan JOIN numbered USING (ordinal) JOIN blk USING (block) GROUP BY 1, 2",
            "per_draw": """SELECT draw, sum(pos * (below + neg / 2)) AS u, sum(pos) AS p, sum(neg) AS n FROM
              (SELECT *, coalesce(sum(neg) OVER (PARTITION BY draw ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM weighed) GROUP BY 1""",
            "whole": """SELECT sum(pos * (below + neg / 2)) AS u, sum(pos) AS p, sum(neg) AS n FROM
              (SELECT *, coalesce(sum(neg) OVER (ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM
                (SELECT n_chars, count(*) FILTER (toxic = 1)::DOUBLE AS pos, count(*) FILTER (toxic <> 1)::DOUBLE AS neg FROM blk GROUP BY 1))""",
        }),
)
def boot_auroc(t: Tables):
    return rounded(st.bootstrap_auroc(t.scored_doc(), "n_chars", _toxic(), "source", seed=SEED), "auroc", "lo", "hi")


@query(
    "distribution",
    f"""SELECT l_returnflag, count(*) AS n, {s6('quantile_cont(l_extendedprice, 0.1)')} AS p10, {s6('quantile_cont(l_extendedprice, 0.25)')} AS q1,
    {s6('quantile_cont(l_extendedprice, 0.5)')} AS median, {s6('quantile_cont(l_extendedprice, 0.75)')} AS q3, {s6('quantile_cont(l_extendedprice, 0.9)')} AS p90,
    {s6('min(l_extendedprice)')} AS min, {s6('max(l_extendedprice)')} AS max, {s6('avg(l_extendedprice)')} AS mean FROM lineitem GROUP BY 1""",
)
def distribution(t: Tables):
    d = st.distribution(t.read("lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", ["l_returnflag"])
    return rounded(d, "p10", "q1", "median", "q3", "p90", "min", "max", "mean")


@query(
    "percentiles",
    f"SELECT count(*) AS n, {s6('quantile_cont(n_chars, 0.025)')} AS p0, {s6('quantile_cont(n_chars, 0.5)')} AS p1, {s6('quantile_cont(n_chars, 0.999)')} AS p2 FROM documents",
)
def percentiles(t: Tables):
    return rounded(exact_percentiles(t.read("documents").select("n_chars"), "n_chars", [0.025, 0.5, 0.999]), "p0", "p1", "p2")


EDGES = [(-1, 200), (200, 1000), (1000, 5000), (5000, 20000), (20000, 1e7), (1e7, 1e9)]
BINS = ["<=200", "<=1k", "<=5k", "<=20k", "<=10M", ">10M"]


@query(
    "bins",
    """SELECT l.lang, b.bin, count(d.doc_id) AS n FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN
    (VALUES ('<=200', -1, 200), ('<=1k', 200, 1000), ('<=5k', 1000, 5000), ('<=20k', 5000, 20000), ('<=10M', 20000, 10000000), ('>10M', 10000000, 1000000000)) b(bin, lo, hi)
    LEFT JOIN documents d ON d.lang = l.lang AND d.n_chars > b.lo AND d.n_chars <= b.hi GROUP BY 1, 2""",
)
def bins(t: Tables):
    return st.bin_counts(t.read("documents"), F.col("n_chars"), EDGES, BINS, ["lang"])


LG = "list_sum(list_transform(range(1, ({n}) + 1), lambda i: ln(i)))"


@query(
    "fisher",
    with_views(
        f"""SELECT lang, a_hit, a_n, b_hit, b_n, undetermined, {s6('''(SELECT least(1.0, sum(CASE WHEN lp <= obs + 1e-7 THEN exp(lp) ELSE 0 END)) FROM (
            SELECT f(a_n) - f(x) - f(a_n - x) + f(b_n) - f(k - x) - f(b_n - (k - x)) - f(a_n + b_n) + f(k) + f(a_n + b_n - k) AS lp,
              f(a_n) - f(a_hit) - f(a_n - a_hit) + f(b_n) - f(k - a_hit) - f(b_n - (k - a_hit)) - f(a_n + b_n) + f(k) + f(a_n + b_n - k) AS obs
            FROM (SELECT unnest(range(greatest(0, k - b_n), least(k, a_n) + 1)) AS x)))''')} * CASE WHEN a_n > 0 AND b_n > 0 THEN 1 END AS fisher_p FROM tab""", "scored_doc",
        extra={"tab": """SELECT lang, count(*) FILTER (long AND toxic = 1) AS a_hit, count(*) FILTER (long) AS a_n, count(*) FILTER (NOT long AND toxic = 1) AS b_hit, count(*) FILTER (NOT long) AS b_n,
          count(*) FILTER (long IS NULL) AS undetermined, count(*) FILTER (long IS NOT NULL AND toxic = 1) AS k
          FROM (SELECT *, CASE WHEN n_chars <> 0 AND doc_id % 11 <> 0 THEN n_chars > 600 END AS long FROM scored_doc) GROUP BY 1"""}),
)
def fisher(t: Tables):
    flag = F.when((F.col("n_chars") != 0) & (F.col("doc_id") % 11 != 0), F.col("n_chars") > 600)
    tab = st.contingency(t.scored_doc(), flag, _toxic(), ["lang"])
    return rounded(st.fisher_two_sided(tab, "a_hit", "a_n", "b_hit", "b_n", ["lang"]), "fisher_p")


from .base import ORACLES  # noqa: E402  (the text above uses f() as a stand-in for ln(n!))

import re as _re  # noqa: E402

ORACLES["fisher"] = _re.sub(
    r"\bf\(((?:[^()]|\([^()]*\))*)\)", lambda m: f"coalesce({LG.format(n=m.group(1))}, 0)", ORACLES["fisher"]
)


@query(
    "classified_fraction",
    with_views(
        f"""SELECT lang, count(*) FILTER (f) AS k, count(f) AS n, count(*) FILTER (f IS NULL) AS undetermined, {sql_rates('count(*) FILTER (f)', 'count(f)')}
        FROM (SELECT lang, CASE WHEN doc_id % 11 <> 0 THEN n_chars > 600 END AS f FROM scored_doc) GROUP BY 1""", "scored_doc"),
)
def classified_fraction(t: Tables):
    return rounded(st.classified_fraction(t.scored_doc(), F.when(F.col("doc_id") % 11 != 0, F.col("n_chars") > 600), ["lang"]), *RATES)


@query(
    "noise_floor",
    f"""SELECT {s6('q')} AS q, n_steps, {s6('(SELECT sum(1 - pow(1 - q, n)) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey))')} AS expected
    FROM (SELECT avg((l_extendedprice >= 90000)::INT) AS q, count(*) AS n_steps FROM lineitem)""",
)
def noise_floor(t: Tables):
    li = t.read("lineitem")
    rows = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return rounded(st.noise_floor(li.select("l_extendedprice"), "l_extendedprice", rows, "n", 90000.0).select("q", "n_steps", "expected"), "q", "expected")


MEMBER = "l_orderkey"


@query(
    "member_rollup",
    f"""SELECT event_id, n, {s6('med')} AS median_step, {s6('mx')} AS max_step, {s6('mn')} AS min_step, partial, mx >= 50000 AS abrupt, med >= 50000 AS abrupt_median, n <= 1 AS single FROM (
    SELECT l_orderkey AS event_id, count(*) AS n, quantile_cont(s, 0.5) AS med, max(s) AS mx, min(s) AS mn, coalesce(bool_or(l_returnflag = 'R'), FALSE) AS partial
    FROM (SELECT *, CASE WHEN l_discount <> 0.05 THEN l_extendedprice END AS s FROM lineitem) GROUP BY 1)""",
)
def member_rollup(t: Tables):
    """Members to events: medians, extremes and threshold flags; an event without a measured member stays undetermined."""
    step = F.when(F.col("l_discount") != 0.05, F.col("l_extendedprice"))
    e = t.read("lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(
        F.count(F.lit(1)).alias("n"), F.percentile(step, 0.5).alias("median_step"), F.max(step).alias("max_step"),
        F.min(step).alias("min_step"), F.bool_or(F.col("l_returnflag") == "R").alias("partial"),
    )
    e = e.withColumn("abrupt", F.col("max_step") >= 50000).withColumn("abrupt_median", F.col("median_step") >= 50000).withColumn("single", F.col("n") <= 1)
    return rounded(e, "median_step", "max_step", "min_step")


@query(
    "nearest_members",
    f"""SELECT event_id, line, price, rank FROM (SELECT l_orderkey AS event_id, l_partkey AS line, {s6('l_extendedprice')} AS price,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(l_extendedprice - c), l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS rank FROM lineitem JOIN
      (SELECT l_orderkey, avg(l_extendedprice) AS c FROM lineitem GROUP BY 1) USING (l_orderkey)) WHERE rank <= 3""",
)
def nearest_members(t: Tables):
    """The three members nearest to the centre of their event."""
    li = t.read("lineitem")
    c = li.groupBy("l_orderkey").agg(F.avg("l_extendedprice").alias("c"))
    d = li.join(c, "l_orderkey")
    top = smp.first_per_group(d, 3, ["l_orderkey"], [F.abs(F.col("l_extendedprice") - F.col("c")), "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"])
    return longs(top.select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("line"), r6("l_extendedprice").alias("price"), "rank"), "rank")


# ------------------------------------------------------------------ sampling
@query("group_sample", f"SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('{SEED}|' || o_custkey || '|' || o_orderkey), o_orderkey) AS k FROM orders) WHERE k <= 20")
def group_sample(t: Tables):
    return smp.cap_per_group(t.read("orders").select("o_custkey", "o_orderkey"), 20, ["o_custkey"], "o_orderkey", SEED)


@query("shuffled_slice", f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('{SEED}|' || o_orderkey), o_orderkey) AS k FROM orders) WHERE k > 300 AND k <= 1000")
def shuffled_slice(t: Tables):
    return smp.shuffled_slice(t.read("orders").select("o_orderkey"), "o_orderkey", 300, 1000, SEED)


@query(
    "review_sample",
    f"""SELECT 'R' || lpad((row_number() OVER (ORDER BY md5('{SEED}.id|' || event_id), event_id))::VARCHAR, 2, '0') AS review_id, event_id, kind FROM (
      SELECT event_id, kind, row_number() OVER (PARTITION BY kind ORDER BY md5('{SEED}|' || kind || '|' || event_id), event_id) AS k FROM pt0)
      WHERE k <= CASE kind WHEN 'purchase' THEN 15 WHEN 'view' THEN 10 WHEN 'error' THEN 5 ELSE 0 END""".replace("pt0", "(SELECT event_id, event_type AS kind FROM events)"),
)
def review_sample(t: Tables):
    return smp.stratified_sample(t.pt().select("event_id", "kind"), {"purchase": 15, "view": 10, "error": 5}, "kind", "event_id", SEED)


@query("preferred_keys", "SELECT user_id AS patch, bool_or(event_type = 'purchase' AND value > 300) AS has_events FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")
def preferred_keys(t: Tables):
    d = t.read("events").groupBy(F.col("user_id").alias("patch")).agg(F.bool_or((F.col("event_type") == "purchase") & (F.col("value") > 300)).alias("has_events"))
    return smp.preferred(d, F.col("has_events"), ["patch"], 12)


@query(
    "random_baseline",
    with_views(
        f"""SELECT v.patch, v.row, v.col FROM (SELECT *, row_number() OVER (PARTITION BY patch, share ORDER BY md5('{SEED}.vertex|' || patch || '|' || row || '|' || col), row, col) AS k FROM dealt) v
        JOIN cdf c ON c.patch = v.patch AND c.share = v.share WHERE v.k <= c.k""", "grid",
        extra={
            "dealt": f"SELECT patch, row, col, ('0x' || substr(md5('{SEED}.share|' || patch || '|' || row || '|' || col), 1, 8))::BIGINT % s.n AS share FROM grid JOIN (SELECT patch, greatest(ceil(count(*) * 0.1::DOUBLE / 10), 1)::BIGINT AS n FROM grid GROUP BY 1) s USING (patch)",
            "sz": f"SELECT patch, share, count(*) * 0.1::DOUBLE AS mean, ('0x' || substr(md5('{SEED}|' || patch || '|' || share), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM dealt GROUP BY 1, 2",
            "ps": "SELECT patch, share, mean, u, 0 AS i, exp(-mean) AS p, exp(-mean) AS c FROM sz UNION ALL SELECT patch, share, mean, u, i + 1, p * mean / (i + 1), c + p * mean / (i + 1) FROM ps WHERE i < 120",
            "cdf": "SELECT patch, share, count(*) FILTER (u >= c) AS k FROM ps GROUP BY 1, 2",
        }),
)
def random_baseline(t: Tables):
    """Whole patches as parts, each with some 300 expected alarms."""
    return smp.random_alarms(t.grid().select("patch", "row", "col"), 0.1, 1.0, ["patch"], ["row", "col"], SEED).select("patch", "row", "col")


@query(
    "alarm_density",
    with_views(
        f"SELECT detector, {s6('avg(n / area)')} AS density, count(*) AS patches FROM (SELECT k.detector, k.patch, count(*)::DOUBLE AS n, any_value(a.area) AS area FROM kept k JOIN (SELECT patch, count(*)::DOUBLE AS area FROM pt GROUP BY 1) a USING (patch) GROUP BY 1, 2) GROUP BY 1",
        "kept", "pt"),
)
def alarm_density(t: Tables):
    """Mean over patches of de-duplicated alarms per area, the density of the matched random baseline."""
    from ..operators.dedup import greedy_dedup

    kept = greedy_dedup(t.alarm().join(t.benchmark().scored_patches(), "patch", "left_semi"), 12.5)
    n = kept.groupBy("detector", "patch").agg(F.count(F.lit(1)).alias("n"))
    area = t.pt().groupBy("patch").agg(F.count(F.lit(1)).alias("area"))
    d = n.join(area, "patch").groupBy("detector").agg(F.avg(F.col("n") / F.col("area")).alias("density"), F.count(F.lit(1)).alias("patches"))
    return rounded(d, "density")


@query(
    "random_curve",
    f"""SELECT l_linenumber AS density, {s6('avg(r)')} AS recall_mean, {s6('quantile_cont(r, 0.025)')} AS recall_lo, {s6('quantile_cont(r, 0.975)')} AS recall_hi, count(*) AS replicates FROM
    (SELECT l_linenumber, l_suppkey, avg((l_returnflag = 'R')::INT) AS r FROM lineitem GROUP BY 1, 2) GROUP BY 1""",
)
def random_curve(t: Tables):
    """Mean and interval over replicates per density; replicates are counted first."""
    rep = t.read("lineitem").groupBy("l_linenumber", "l_suppkey").agg(F.avg((F.col("l_returnflag") == "R").cast("int")).alias("r"))
    m = rep.groupBy("l_linenumber").agg(F.avg("r").alias("recall_mean"), F.count(F.lit(1)).alias("replicates"))
    q = exact_percentiles(rep, "r", [0.025, 0.975], ["l_linenumber"]).selectExpr("l_linenumber", "p0 as recall_lo", "p1 as recall_hi")
    return rounded(m.join(q, "l_linenumber").withColumnRenamed("l_linenumber", "density"), "recall_mean", "recall_lo", "recall_hi")


# ------------------------------------------------------------------ rules over aggregates
@query(
    "decision_rules",
    f"""WITH a AS (SELECT n_name, count(*) FILTER (c_acctbal < 2000) AS k, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1),
    w AS (SELECT *, {sql_wilson('k', 'n')[0]} AS p, {sql_wilson('k', 'n')[1]} AS lo, {sql_wilson('k', 'n')[2]} AS hi FROM a)
    SELECT n_name, k, n, {s6('hi / 0.5519')} AS corrected, CASE WHEN n = 0 THEN 'UNRESOLVED' WHEN hi < 0.5 THEN 'SUPPORTED' WHEN lo > 0.5 THEN 'CONTRADICTED' ELSE 'UNRESOLVED' END AS half,
    CASE WHEN hi / 0.5519 < 0.6 THEN 'SUPPORTED' ELSE 'FAILS' END AS bar, CASE WHEN 0.2 > hi THEN 'over' WHEN 0.2 < lo THEN 'under' ELSE 'consistent' END AS estimate,
    n < 10 OR hi - lo > 0.5 AS too_small, CASE WHEN n < 30 THEN 'INCONCLUSIVE' WHEN hi < 0.35 THEN 'PASS' WHEN lo > 0.35 THEN 'KILL' ELSE 'INCONCLUSIVE' END AS gap FROM w""",
)
def decision_rules(t: Tables):
    d = t.read("customer").join(F.broadcast(t.read("nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations by definition
    a = d.groupBy("n_name").agg(F.count_if(F.col("c_acctbal") < 2000).alias("k"), F.count(F.lit(1)).alias("n"))
    w = a.select("*", *S.wilson(F.col("k"), F.col("n")))
    lo, hi, n = F.col("wilson_lo"), F.col("wilson_hi"), F.col("n")
    corrected = S.corrected_upper(hi, 0.5519)
    return w.select(
        "n_name", "k", "n", r6(corrected).alias("corrected"), S.half_verdict(n, lo, hi).alias("half"), S.bar_verdict(corrected, 0.6).alias("bar"),
        S.estimate_verdict(F.lit(0.2), lo, hi).alias("estimate"), S.too_small(n, lo, hi).alias("too_small"), S.gap_verdict(F.lit(0.35), n, hi, lo).alias("gap"),
    )


@query(
    "label_mixture",
    f"""SELECT l_shipmode, {s6('pi')} AS true_share, {s6('0.6 * pi / f')} AS precision FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (f - 0.2) / 0.4)) AS pi FROM
    (SELECT l_linestatus || l_returnflag AS l_shipmode, avg((l_quantity > 30)::INT) AS f FROM lineitem GROUP BY 1))""",
)
def label_mixture(t: Tables):
    a = t.read("lineitem").groupBy(F.concat("l_linestatus", "l_returnflag").alias("l_shipmode")).agg(F.avg((F.col("l_quantity") > 30).cast("int")).alias("f"))
    pi, prec = S.label_mixture(F.col("f"), F.lit(0.6), F.lit(0.2))
    return a.select("l_shipmode", r6(pi).alias("true_share"), r6(prec).alias("precision"))


@query(
    "unmixed_rates",
    f"""SELECT {s6('(a1 * 0.8 - a2 * 0.3) / 0.5')} AS true_rate, {s6('(0.7 * a2 - 0.2 * a1) / 0.5')} AS false_rate FROM
    (SELECT avg((value > 50)::INT) FILTER (event_id % 10 <= 5) AS a1, avg((value > 50)::INT) FILTER (event_id % 10 BETWEEN 6 AND 8) AS a2 FROM events WHERE event_type = 'purchase')""",
)
def unmixed_rates(t: Tables):
    x = (F.col("x") > 50).cast("int")
    a = t.gt_event().agg(F.avg(F.when(F.col("status") == "confirmed", x)).alias("a1"), F.avg(F.when(F.col("status") == "contradicted", x)).alias("a2"))
    tr, fa = S.unmix(F.col("a1"), F.col("a2"), F.lit(0.7), F.lit(0.2))
    return a.select(r6(tr).alias("true_rate"), r6(fa).alias("false_rate"))


@query(
    "answers_by_kind",
    f"""SELECT *, {s6('yes::DOUBLE / nullif(yes + "no", 0)')} AS precision FROM (SELECT event_type AS kind, count(*) FILTER (event_id % 3 = 0) AS yes, count(*) FILTER (event_id % 3 = 1) AS "no", count(*) FILTER (event_id % 3 = 2) AS unsure FROM events GROUP BY 1)""",
)
def answers_by_kind(t: Tables):
    """Cross-tab of review answers by kind, and the share of yes among the decided."""
    d = t.pt().select("kind", F.expr("element_at(array('yes', 'no', 'unsure'), cast(event_id % 3 as int) + 1)").alias("answer"))
    p = d.groupBy("kind").pivot("answer", ["yes", "no", "unsure"]).count().na.fill(0)
    return p.withColumn("precision", r6(S.ratio(F.col("yes"), F.col("yes") + F.col("no"))))


@query(
    "wilson_needed",
    f"""SELECT n_name, n, (SELECT min(k) FROM (SELECT unnest(range(n + 1)) AS k) WHERE {sql_wilson('k', 'n')[1]} > 0.3) AS k FROM
    (SELECT n_name, count(*) AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1)""",
)
def wilson_needed(t: Tables):
    """Smallest k of n whose lower bound exceeds a bar, per group size found in the table."""
    d = t.read("supplier").join(F.broadcast(t.read("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    a = d.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))
    return a.select("n_name", "n", S.smallest_k(F.col("n"), 0.3).alias("k"))


@query(
    "fa_frontier",
    with_views(
        f"""SELECT ceiling, patch, {s6('recall')} AS recall, {s6('fa')} AS fa FROM (SELECT c.ceiling, p.*, row_number() OVER (PARTITION BY ceiling ORDER BY recall DESC, fa, patch) AS k FROM
        (SELECT patch, avg((x > 50)::INT) AS recall, count(*) FILTER (kind = 'error') * 1.0::DOUBLE / count(*) AS fa FROM pt GROUP BY 1) p
        JOIN (VALUES (0.1::DOUBLE), (0.15::DOUBLE), (0.2::DOUBLE), (0.5::DOUBLE)) c(ceiling) ON p.fa <= c.ceiling) WHERE k = 1""", "pt"),
)
def fa_frontier(t: Tables):
    tab = t.pt().groupBy("patch").agg(F.avg((F.col("x") > 50).cast("int")).alias("recall"), (F.count_if(F.col("kind") == "error") / F.count(F.lit(1))).alias("fa"))
    return rounded(P.frontier(tab, "recall", "fa", [0.1, 0.15, 0.2, 0.5], ties=["fa", "patch"]).select("ceiling", "patch", "recall", "fa"), "recall", "fa")


@query(
    "area_rate",
    f"""SELECT count(*) AS patches, count(DISTINCT s) AS parents, sum(k)::BIGINT AS alarms, {s6('sum(k) / sum(a)')} AS per_area, {s6('2 * sum(k) / sum(a)')} AS per_100, count(*) FILTER (k > 0) AS with_alarm FROM
    (SELECT l_orderkey AS p, min(l_suppkey) AS s, count(*) FILTER (l_returnflag = 'R') AS k, sum(l_quantity) AS a FROM lineitem GROUP BY 1)""",
)
def area_rate(t: Tables):
    """Alarms per area over patches whose blocks are their parents, and the corridor conversion."""
    r = t.read("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"), F.count_if(F.col("l_returnflag") == "R").alias("k"), F.sum("l_quantity").alias("a"))
    rate = F.sum("k") / F.sum("a")
    return r.agg(
        F.count(F.lit(1)).alias("patches"), F.countDistinct("s").alias("parents"), F.sum("k").alias("alarms"), r6(rate).alias("per_area"), r6(2 * rate).alias("per_100"), F.count_if(F.col("k") > 0).alias("with_alarm"),
    )


@query(
    "generation_scores",
    with_views(
        f"""SELECT g.patch, row, {s6('max(s[least(len(s), greatest(1, round_even(sqrt(pow(x - 600, 2) + pow(y - 400, 2) + pow(z - 30 * g.patch, 2)) / 20, 0)::BIGINT))])')} AS score
        FROM grid g JOIN (SELECT vec_id // 50 AS patch, list(embedding[1]::DOUBLE ORDER BY vec_id) AS s FROM embeddings GROUP BY 1) c USING (patch) GROUP BY 1, 2""", "grid"),
)
def generation_scores(t: Tables):
    """Cost series of a patch looked up at the growth generation of each vertex, largest per window."""
    series = t.read("embeddings").groupBy(F.expr("vec_id div 50").alias("patch")).agg(F.array_sort(F.collect_list(F.struct("vec_id", F.expr("cast(embedding[0] as double)").alias("c")))).alias("q")).selectExpr("patch", "transform(q, w -> w.c) as series")
    d = t.grid().join(series, "patch")
    gen = G.generation_proxy([F.col("x"), F.col("y"), F.col("z")], [F.lit(600.0), F.lit(400.0), 30.0 * F.col("patch")])
    return d.groupBy("patch", "row").agg(r6(F.max(G.series_at(F.col("series"), gen))).alias("score"))


@query(
    "name_parts",
    """SELECT c_custkey, CASE WHEN regexp_matches(nm, '^auto_grown_(\\d{17})_region_\\d+$') THEN regexp_extract(nm, '^auto_grown_(\\d{17})_region_\\d+$', 1) END AS batch,
    CASE WHEN regexp_matches(nm, '^auto_grown_(\\d{8})') THEN regexp_extract(nm, '^auto_grown_(\\d{8})', 1) ELSE 'legacy' END AS day, regexp_replace(nm, '_region_\\d+$', '') AS lineage,
    split_part(nm, '_sel_', 1) AS parent, CASE WHEN regexp_matches(nm, '^auto_grown_\\d+') THEN regexp_extract(nm, '^auto_grown_\\d+') ELSE split_part(nm, '_sel_', 1) END AS stem, regexp_extract('v_' || (c_custkey % 9) || '.5um_x', '_(\\d+(?:\\.\\d+)?)um_', 1)::DOUBLE AS pixel
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'w' || c_custkey || '_sel_2' ELSE 'auto_grown_2026' || lpad(((c_custkey % 12) + 1)::VARCHAR, 2, '0') || '15120000123_region_' || c_custkey END AS nm FROM customer)""",
)
def name_parts(t: Tables):
    d = t.read("customer").selectExpr(
        "c_custkey", """case when c_custkey % 4 = 0 then concat('w', c_custkey, '_sel_2') else concat('auto_grown_2026', lpad(cast(c_custkey % 12 + 1 as string), 2, '0'), '15120000123_region_', c_custkey) end as nm""")
    n = F.col("nm")
    vol = F.concat(F.lit("v_"), (F.col("c_custkey") % 9).cast("string"), F.lit(".5um_x"))
    return d.select("c_custkey", T.batch_id(n).alias("batch"), T.batch_day(n).alias("day"), T.lineage(n).alias("lineage"), T.parent_stem(n).alias("parent"), T.lineage_stem(n).alias("stem"), T.pixel_size(vol).alias("pixel"))
