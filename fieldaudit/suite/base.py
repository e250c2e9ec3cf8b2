"""Query registry, table access and the shared fixture views (Spark and SQL side by side)."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RADIUS = 25.0
DEDUP = 12.5
SEED = 20260925


def query(name: str, sql: str | None = None):
    """Register a query builder ``fn(Tables) -> DataFrame`` under ``name``."""

    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def r6(c: Column | str) -> Column:
    """Round to six digits; adding 0.0 turns a negative zero into zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def s6(expr: str) -> str:
    return f"(round(({expr})::DOUBLE, 6) + 0.0::DOUBLE)"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in names else F.col(c) for c in df.columns])


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if c in names else F.col(c) for c in df.columns])


class Tables:
    """The driver's parquet tables and the views built on them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def read(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._load(name)
        return self._frames[name]

    def _load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def vectors(self) -> int:
        """The number of embeddings, as their ids count them."""
        return self.read("embeddings").agg(F.max("vec_id") + 1).first()[0]

    def surfaces(self) -> int:
        """The number of gridded surfaces that :meth:`grid` makes of the embeddings."""
        return (self.vectors() - 1) // 50 + 1

    # ------------------------------------------------------------ events as points
    @cached_property
    def _pt(self) -> DataFrame:
        return self.read("events").selectExpr(
            "event_id", "user_id as patch", "event_type as kind", "event_id as ord", "value as x",
            "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 3.6e9D as y",
            r"""cast(regexp_extract(props, '"k": (\\d+)', 1) as double) as z""",
        )

    def pt(self) -> DataFrame:
        return self._pt

    @cached_property
    def _gt_event(self) -> DataFrame:
        return self.pt().filter("kind = 'purchase'").selectExpr(
            "event_id", "patch", "x", "y", "z",
            """case when event_id % 10 <= 5 then 'confirmed' when event_id % 10 <= 8 then 'contradicted'
               else 'unconfirmed' end as status""",
            "case when x > 50 then 'abrupt' else 'gradual' end as stratum",
            "case when patch % 2 = 0 then 'v0' else 'new' end as subset",
        )

    def gt_event(self) -> DataFrame:
        return self._gt_event

    def verdict(self) -> DataFrame:
        """Verdict rows for every patch that has any row at all."""
        who = self.read("events").selectExpr("user_id as patch").distinct()
        return who.selectExpr(
            """explode(filter(array(if(patch % 5 <> 0, 'error', null), if(patch % 5 <> 0, 'click', null),
               if(patch % 5 < 2, 'signup', null)), v -> v is not null)) as detector""", "patch",
        )

    def alarm(self) -> DataFrame:
        return self.pt().filter("kind in ('error', 'click', 'signup')").filter(
            "case when kind = 'signup' then patch % 5 < 2 else patch % 5 <> 0 end"
        ).selectExpr("kind as detector", "patch", "ord as alarm_ord", "x", "y", "z")

    @cached_property
    def _run_vertex(self) -> DataFrame:
        return self.pt().filter("kind = 'view'").selectExpr(
            "patch * 100 + cast(floor(y / 168) as bigint) as run_id", "patch",
            "cast(floor(y / 168) as bigint) as week", "event_id", "x", "y", "z",
            "if((patch + cast(floor(y / 168) as bigint)) % 4 = 3, 'contradicted', 'confirmed') as status",
        )

    def run_vertex(self) -> DataFrame:
        return self._run_vertex

    def run(self) -> DataFrame:
        """Runs with their arc length (blocks of 24 hours keep a long run out of one task)."""
        from ..operators.sequence import arc_length

        v = self.run_vertex()
        return arc_length(v, ["run_id", "patch"], ["y", "event_id"], block=F.floor(F.col("y") / 24))

    def benchmark(self):
        from ..plans.score import Benchmark

        ev = self.gt_event()
        return Benchmark(
            events=ev.select("event_id", "patch", "status", "stratum", "subset"),
            event_points=ev.select("event_id", "patch", "x", "y", "z"),
            runs=self.run_vertex().select("run_id", "patch", "status").distinct(),
            run_lengths=self.run(),
            run_vertices=self.run_vertex().select("run_id", "patch", "x", "y", "z"),
            voxel_mm=1.0,
            defaults={"match_mm": RADIUS, "fa_dedup_mm": DEDUP},
        )

    def alarms(self):
        from ..plans.score import Alarms

        return Alarms(self.verdict(), self.alarm())

    # ------------------------------------------------------------ embeddings as grids and profiles
    def grid(self, valid_only: bool = True) -> DataFrame:
        """50 embedding rows form a patch of 50 x 64 vertices; patches are stacked 30 apart."""
        e = self.read("embeddings").select("vec_id", F.posexplode("embedding").alias("col", "v"))
        v = F.col("v").cast("double")
        patch = F.floor(F.col("vec_id") / 50).cast("long")
        g = e.select(
            patch.alias("patch"), (F.col("vec_id") % 50).alias("row"), F.col("col").cast("long").alias("col"),
            (20.0 * F.col("col")).alias("x"), (20.0 * (F.col("vec_id") % 50)).alias("y"),
            (100.0 * v + 30.0 * patch).alias("z"), (F.abs(v) < 0.2).alias("valid"), v.alias("v"),
        )
        return g.filter("valid") if valid_only else g

    def profile(self) -> DataFrame:
        return self.read("embeddings").select(
            F.col("vec_id").alias("profile_id"), F.posexplode("embedding").alias("i", "e")
        ).select("profile_id", F.col("i").cast("long").alias("i"), F.col("i").cast("double").alias("t"),
                 (127.5 + 500.0 * F.col("e").cast("double")).alias("v"))

    def scored_doc(self) -> DataFrame:
        return self.read("documents").select("doc_id", "source", "lang", "n_chars").join(self.read("labels"), "doc_id")


# ---------------------------------------------------------------- the same views in SQL
VIEWS = {
    "pt": """SELECT event_id, user_id AS patch, event_type AS kind, event_id AS ord, value AS x,
        (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 3.6e9::DOUBLE AS y,
        regexp_extract(props, '"k": (\\d+)', 1)::DOUBLE AS z FROM events""",
    "ev": """SELECT event_id, patch, x, y, z,
        CASE WHEN event_id % 10 <= 5 THEN 'confirmed' WHEN event_id % 10 <= 8 THEN 'contradicted' ELSE 'unconfirmed' END AS status,
        CASE WHEN x > 50 THEN 'abrupt' ELSE 'gradual' END AS stratum,
        CASE WHEN patch % 2 = 0 THEN 'v0' ELSE 'new' END AS subset
        FROM pt WHERE kind = 'purchase'""",
    "verdict": """SELECT d.detector, p.patch FROM (SELECT DISTINCT user_id AS patch FROM events) p,
        (VALUES ('error'), ('click'), ('signup')) d(detector)
        WHERE CASE WHEN d.detector = 'signup' THEN p.patch % 5 < 2 ELSE p.patch % 5 <> 0 END""",
    "alarm": """SELECT kind AS detector, patch, ord AS alarm_ord, x, y, z FROM pt
        WHERE kind IN ('error', 'click', 'signup')
        AND CASE WHEN kind = 'signup' THEN patch % 5 < 2 ELSE patch % 5 <> 0 END""",
    "rv": """SELECT patch * 100 + floor(y / 168)::BIGINT AS run_id, patch, floor(y / 168)::BIGINT AS week, event_id, x, y, z,
        CASE WHEN (patch + floor(y / 168)::BIGINT) % 4 = 3 THEN 'contradicted' ELSE 'confirmed' END AS status
        FROM pt WHERE kind = 'view'""",
    "run_steps": """SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) AS step FROM (
        SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM rv
        WINDOW w AS (PARTITION BY run_id ORDER BY y, event_id))""",
    "run": """SELECT run_id, patch, status, coalesce(sum(step), 0.0) AS length, count(*) AS vertices
        FROM run_steps GROUP BY 1, 2, 3""",
    "scored": """SELECT patch FROM ev WHERE status = 'confirmed' UNION SELECT patch FROM rv WHERE status = 'confirmed'""",
    "hit": """SELECT DISTINCT e.event_id, e.patch, a.detector FROM ev e JOIN alarm a ON a.patch = e.patch
        WHERE sqrt((e.x - a.x) * (e.x - a.x) + (e.y - a.y) * (e.y - a.y) + (e.z - a.z) * (e.z - a.z)) <= 25""",
    # greedy de-duplication: one recursion step per alarm rank, the kept alarms in a list
    "ranked": """SELECT *, row_number() OVER (PARTITION BY detector, patch ORDER BY alarm_ord) AS rn FROM alarm
        WHERE patch IN (SELECT patch FROM scored)""",
    "walk": """SELECT detector, patch, rn, alarm_ord, TRUE AS keep, [{'x': x, 'y': y, 'z': z}] AS kept FROM ranked WHERE rn = 1
        UNION ALL
        SELECT r.detector, r.patch, r.rn, r.alarm_ord, q.keep,
          CASE WHEN q.keep THEN list_append(w.kept, {'x': r.x, 'y': r.y, 'z': r.z}) ELSE w.kept END
        FROM walk w JOIN ranked r ON r.detector = w.detector AND r.patch = w.patch AND r.rn = w.rn + 1,
        LATERAL (SELECT len(list_filter(w.kept, lambda k: sqrt((r.x - k.x) * (r.x - k.x) + (r.y - k.y) * (r.y - k.y)
          + (r.z - k.z) * (r.z - k.z)) <= 12.5)) = 0 AS keep) q""",
    "kept": """SELECT a.* FROM walk w JOIN alarm a ON a.detector = w.detector AND a.alarm_ord = w.alarm_ord WHERE w.keep""",
    "fa": """SELECT DISTINCT k.detector, k.patch, k.alarm_ord, v.run_id FROM kept k JOIN rv v ON v.patch = k.patch AND v.status = 'confirmed'
        WHERE sqrt((k.x - v.x) * (k.x - v.x) + (k.y - v.y) * (k.y - v.y) + (k.z - v.z) * (k.z - v.z)) <= 25
        AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.patch = k.patch
          AND sqrt((k.x - e.x) * (k.x - e.x) + (k.y - e.y) * (k.y - e.y) + (k.z - e.z) * (k.z - e.z)) <= 25)""",
    "dets": """SELECT DISTINCT detector FROM verdict""",
    "patch_score": """SELECT d.detector, s.patch, (v.patch IS NOT NULL) AS verdict,
        (SELECT count(*) FROM ev e WHERE e.patch = s.patch AND e.status = 'confirmed') AS events,
        (SELECT count(*) FROM hit h JOIN ev e USING (event_id) WHERE h.patch = s.patch AND h.detector = d.detector AND e.status = 'confirmed') AS hits,
        (SELECT coalesce(sum(length), 0.0) FROM run r WHERE r.patch = s.patch AND r.status = 'confirmed') AS length,
        (SELECT count(*) FROM run r WHERE r.patch = s.patch AND r.status = 'confirmed') AS runs,
        (SELECT count(*) FROM alarm a WHERE a.patch = s.patch AND a.detector = d.detector) AS alarms,
        (SELECT count(*) FROM kept a WHERE a.patch = s.patch AND a.detector = d.detector) AS kept,
        (SELECT count(*) FROM fa f WHERE f.patch = s.patch AND f.detector = d.detector) AS false_alarms
        FROM scored s CROSS JOIN dets d LEFT JOIN verdict v ON v.patch = s.patch AND v.detector = d.detector""",
    "grid_all": """SELECT vec_id // 50 AS patch, vec_id % 50 AS row, (i - 1)::BIGINT AS col, 20.0::DOUBLE * (i - 1) AS x,
        20.0::DOUBLE * (vec_id % 50) AS y, 100.0::DOUBLE * embedding[i]::DOUBLE + 30.0::DOUBLE * (vec_id // 50) AS z,
        abs(embedding[i]::DOUBLE) < 0.2::DOUBLE AS valid, embedding[i]::DOUBLE AS v
        FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)""",
    "grid": """SELECT * FROM grid_all WHERE valid""",
    "profile": """SELECT vec_id AS profile_id, (i - 1)::BIGINT AS i, (i - 1)::DOUBLE AS t, 127.5::DOUBLE + 500.0::DOUBLE * embedding[i]::DOUBLE AS v
        FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)""",
    "scored_doc": """SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)""",
}
NEEDS = {
    "ev": ["pt"], "alarm": ["pt"], "rv": ["pt"], "run_steps": ["rv"], "run": ["run_steps"], "scored": ["ev", "rv"],
    "hit": ["ev", "alarm"], "ranked": ["alarm", "scored"], "walk": ["ranked"], "kept": ["walk", "alarm"],
    "fa": ["kept", "rv", "ev"], "dets": ["verdict"],
    "patch_score": ["scored", "dets", "verdict", "ev", "hit", "run", "alarm", "kept", "fa"],
    "grid": ["grid_all"],
}


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH RECURSIVE`` text holding the named views, what they need, ``extra`` views, and the body."""
    order: list[str] = []

    def add(n):
        for d in NEEDS.get(n, ()):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order] + [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body
