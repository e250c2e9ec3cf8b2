"""Score any number of detectors against a labelled corpus in one job.

A detector is a column, never a driver loop.  All distance work is keyed by (patch, cell); what leaves it
is one row per (patch, detector), the sufficient statistic of every rate and interval.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions import stats as S
from ..functions.geometry import VOXEL_MM, XYZ
from ..functions.hashing import SEED
from ..operators.bootstrap import bootstrap_ratio
from ..operators.dedup import greedy_dedup
from ..operators.sampling import cap_per_group
from ..operators.spatial import matches_within, nearest, without_match

CONFIRMED = "confirmed"


@dataclass(frozen=True)
class Setting:
    """One setting: its default, how a given value is read, and the bound a read value must keep."""

    default: object
    read: Callable
    low: float = float("-inf")
    open: bool = False  # the bound itself is not allowed

    def of(self, name: str, value):
        found = self.read(value)
        if found is not None and (found < self.low or self.open and found == self.low):
            raise ValueError(f"{name} must be {'above' if self.open else 'at least'} {self.low:g}, got {value}")
        return found


def _cap(value) -> int | None:
    """A cap of 0 or less is no cap."""
    return None if value is None or int(value) <= 0 else int(value)


#: Default settings of the protocol.
SETTINGS = {
    "match_mm": Setting(1.0, float, 0, open=True),
    "per_patch_cap": Setting(None, _cap),
    "bootstrap": Setting(2000, int, 0),
    "seed": Setting(SEED, int),
    "fa_dedup_mm": Setting(0.5, float, 0),
}


@dataclass
class Benchmark:
    """Lazily built tables of one labelled corpus.

    events(event_id, patch, status), event_points(event_id, patch, x, y, z),
    runs(run_id, patch, status), run_lengths(run_id, patch, length), run_vertices(run_id, patch, x, y, z),
    surface(patch, x, y, z) of valid vertices, optional.  Lengths are in mm and kept apart from the run
    labels, so that choosing patches never computes a length.
    """

    events: DataFrame
    event_points: DataFrame
    runs: DataFrame
    run_lengths: DataFrame
    run_vertices: DataFrame
    surface: DataFrame | None = None
    voxel_mm: float = VOXEL_MM
    defaults: dict = field(default_factory=dict)
    meta: dict = field(default_factory=dict)
    scored: DataFrame | None = None

    def scored_patches(self) -> DataFrame:
        """Patches with a confirmed event or a confirmed run; ``scored`` if they are kept already."""
        if self.scored is not None:
            return self.scored
        ok = F.col("status") == CONFIRMED
        return self.events.filter(ok).select("patch").union(self.runs.filter(ok).select("patch")).distinct()

    def known_patches(self) -> DataFrame:
        return self.events.select("patch").union(self.runs.select("patch")).distinct()


@dataclass
class Alarms:
    """verdicts(detector, patch) and alarms(detector, patch, alarm_ord, x, y, z).

    A patch without a verdict row has no verdict; a verdict without alarms is a clean verdict.
    ``detectors`` lists detectors that may have no verdict at all.
    """

    verdicts: DataFrame
    alarms: DataFrame
    detectors: DataFrame | None = None

    def names(self) -> DataFrame:
        return self.detectors if self.detectors is not None else self.verdicts.select("detector").distinct()


def resolve_settings(defaults: dict | None = None, **given) -> tuple[dict, dict]:
    """Effective settings and the origin of each; a source that has no value for a setting leaves it to the next one."""
    sources = [("argument", {k: v for k, v in given.items() if v is not None}), ("corpus", defaults or {}), ("default", {k: s.default for k, s in SETTINGS.items()})]
    origin = {name: next(label for label, values in sources if name in values) for name in SETTINGS}
    return {name: s.of(name, dict(sources)[origin[name]][name]) for name, s in SETTINGS.items()}, origin


def counted_events(events: DataFrame, cap: int | None, seed=SEED) -> DataFrame:
    """Confirmed events that count toward recall under a per-patch cap."""
    return cap_per_group(events.filter(F.col("status") == CONFIRMED), cap, ["patch"], "event_id", seed)


def event_hits(points: DataFrame, alarms: DataFrame, r: float, extra=()) -> DataFrame:
    """(event_id, detector) such that an alarm of the patch lies within ``r`` of a point of the event.

    Matching uses every raw alarm, never the de-duplicated set.
    """
    return matches_within(points, alarms, r, ids=["event_id", "patch", *extra], keys=["patch"], tags=["detector"])


def _runs_and_events(run_vertices: DataFrame, event_points: DataFrame) -> DataFrame:
    """(patch, x, y, z, target, is_event): vertices by their run, and all events of a patch under one name."""
    return run_vertices.select("patch", *XYZ, F.col("run_id").cast("string").alias("target"), F.lit(False).alias("is_event")).unionByName(
        event_points.select("patch", *XYZ, F.lit("").alias("target"), F.lit(True).alias("is_event"))
    )


def false_alarm_counts(kept: DataFrame, run_vertices: DataFrame, event_points: DataFrame, r: float) -> DataFrame:
    """(detector, patch, false_alarms): kept alarms on confirmed runs and away from every event point.

    An alarm on two crossing runs counts once per run.  Runs and events are matched in one radius join.
    """
    near = matches_within(
        kept, _runs_and_events(run_vertices, event_points), r, ids=["detector", "patch", "alarm_ord"], keys=["patch"], tags=["target", "is_event"]
    )
    per_alarm = near.groupBy("detector", "patch", "alarm_ord").agg(
        F.max("is_event").alias("at_event"), F.count_if(~F.col("is_event")).alias("runs")
    )
    return per_alarm.filter(~F.col("at_event")).groupBy("detector", "patch").agg(F.sum("runs").alias("false_alarms"))


def false_alarm_pairs(kept: DataFrame, run_vertices: DataFrame, event_points: DataFrame, r: float) -> DataFrame:
    """(detector, patch, alarm_ord, run_id) of every false alarm.

    Runs and events are matched in one radius join, so the kept alarms are computed and spread over cells once.
    """
    ids = ["detector", "patch", "alarm_ord"]
    near = matches_within(kept, _runs_and_events(run_vertices, event_points), r, ids=ids, keys=["patch"], tags=["target", "is_event"])
    at_event = F.max("is_event").over(W.partitionBy(*ids))  # the runs and events around one alarm
    found = near.withColumn("_at_event", at_event).filter("not _at_event")
    return found.select(*ids, F.col("target").cast(dict(run_vertices.dtypes)["run_id"]).alias("run_id"))


@dataclass
class ScoreFrames:
    patch_score: DataFrame
    detector_score: DataFrame
    settings: dict
    origin: dict
    bench: Benchmark
    input: Alarms
    radius: float

    def event_score(self) -> DataFrame:
        """One row per confirmed event and detector: counted, verdict, hit, distance to the nearest alarm."""
        b, r = self.bench, self.radius
        confirmed = b.events.filter(F.col("status") == CONFIRMED)
        pts = b.event_points.join(confirmed.select("event_id"), "event_id", "left_semi")
        hits = event_hits(pts, self.input.alarms, r).select("event_id", "detector", F.lit(True).alias("hit"))
        near = nearest(pts, self.input.alarms, ids=["event_id"], keys=["patch"], tags=["detector"])
        near = near.groupBy("event_id", "detector").agg((F.min("nearest") * b.voxel_mm).alias("nearest_mm"))
        counted = counted_events(b.events, self.settings["per_patch_cap"], self.settings["seed"])
        rows = confirmed.select("event_id", "patch").crossJoin(F.broadcast(self.input.names()))  # detectors: manifest-sized
        rows = rows.join(counted.select("event_id", F.lit(True).alias("counted")), "event_id", "left")
        rows = rows.join(self.input.verdicts.withColumn("verdict", F.lit(True)), ["detector", "patch"], "left")
        rows = rows.join(hits, ["event_id", "detector"], "left").join(near, ["event_id", "detector"], "left")
        return rows.select(
            "detector", "patch", "event_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("counted", "verdict", "hit")],
            "nearest_mm",
        )

    def _draws(self, by) -> dict:
        return dict(block="patch", by=by, series=["detector"], draws=self.settings["bootstrap"], seed=self.settings["seed"])

    def recall_intervals(self, by=()) -> DataFrame:
        """Block-bootstrap interval of recall per detector; false alarms are not computed for it."""
        rows = self.patch_score.filter(F.col("events") > 0)
        return bootstrap_ratio(rows, {"recall_boot": (F.col("hits"), F.col("events"))}, **self._draws(by))

    def false_alarm_intervals(self, by=()) -> DataFrame:
        """Block-bootstrap interval of false alarms per 100 mm, per detector."""
        return bootstrap_ratio(self.patch_score, {"fa_boot": (F.col("false_alarms"), F.col("length"))}, scale=100.0, **self._draws(by))

    def intervals(self, by=()) -> DataFrame:
        """Both intervals."""
        return self.recall_intervals(by).join(self.false_alarm_intervals(by), [*by, "detector"], "full")

    def materialised(self) -> "ScoreFrames":
        """The same frames with the patch scores (a row per patch and detector) kept when they are first computed.

        Nothing runs yet; lost parts are computed again from their lineage.
        """
        import dataclasses

        kept = self.patch_score.persist(StorageLevel.MEMORY_AND_DISK)
        return dataclasses.replace(self, patch_score=kept, detector_score=pool(kept))


def patch_scores(bench: Benchmark, alarms: Alarms, r: float, dedup_r: float, cap: int | None = None, seed=SEED) -> DataFrame:
    """One row per (scored patch, detector): verdict, alarms, kept, events, hits, length, false alarms."""
    patches = bench.scored_patches()
    counted = counted_events(bench.events, cap, seed)
    # A counted event or a confirmed run makes its patch a scored one, so only the de-duplication
    # needs the explicit restriction to scored patches.
    hit = event_hits(bench.event_points.join(counted.select("event_id"), "event_id", "left_semi"), alarms.alarms, r)
    kept = greedy_dedup(alarms.alarms.join(patches, "patch", "left_semi"), dedup_r)
    confirmed_runs = bench.runs.filter(F.col("status") == CONFIRMED)
    vertices = bench.run_vertices.join(confirmed_runs.select("run_id"), "run_id", "left_semi")
    lengths = bench.run_lengths.join(confirmed_runs.select("run_id"), "run_id", "left_semi")
    fa = false_alarm_counts(kept, vertices, bench.event_points, r)

    n_alarms = alarms.alarms.groupBy("detector", "patch").agg(F.count(F.lit(1)).alias("alarms"))
    n_kept = kept.groupBy("detector", "patch").agg(F.count(F.lit(1)).alias("kept"))
    n_hits = hit.groupBy("detector", "patch").agg(F.countDistinct("event_id").alias("hits"))
    n_events = counted.groupBy("patch").agg(F.count(F.lit(1)).alias("events"))
    n_runs = lengths.groupBy("patch").agg(F.sum("length").alias("length"), F.count(F.lit(1)).alias("runs"))

    rows = patches.join(n_events, "patch", "left").join(n_runs, "patch", "left")
    rows = rows.crossJoin(F.broadcast(alarms.names()))  # one row per detector: manifest-sized
    key = ["detector", "patch"]
    rows = rows.join(alarms.verdicts.select(*key, F.lit(True).alias("verdict")).distinct(), key, "left")
    for part in (n_alarms, n_kept, n_hits, fa):
        rows = rows.join(part, key, "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("alarms", "kept", "events", "hits", "runs", "false_alarms")]
    return rows.select(
        *key, F.coalesce("verdict", F.lit(False)).alias("verdict"), *zero, F.coalesce("length", F.lit(0.0)).alias("length")
    )


def pool(patch_score: DataFrame, by=("detector",)) -> DataFrame:
    """Pooled counts, rates and coverage from one row per patch and detector."""
    v = F.col("verdict")
    agg = patch_score.groupBy(*by).agg(
        F.sum("hits").alias("hits"), F.sum("events").alias("events"),
        F.sum("false_alarms").alias("false_alarms"), F.sum("length").alias("length"), F.sum("runs").alias("runs"),
        F.sum("alarms").alias("alarms"), F.sum("kept").alias("kept"),
        F.count_if(v).alias("patches_verdict"), F.count(F.lit(1)).alias("patches"),
        F.count_if(F.col("events") > 0).alias("event_patches"),
        F.sum(F.when(v, F.col("events")).otherwise(0)).alias("events_verdict"),
        F.sum(F.when(v, F.col("hits")).otherwise(0)).alias("hits_verdict"),
        F.sum(F.when(v, F.col("length")).otherwise(0.0)).alias("length_verdict"),
    )
    return agg.select(
        "*", *S.wilson(F.col("hits"), F.col("events")),
        S.per_100(F.col("false_alarms"), F.col("length")).alias("fa_per_100"),
        S.ratio(F.col("hits_verdict"), F.col("events_verdict")).alias("recall_where_verdict"),
        S.limited_scope(F.col("patches_verdict"), F.col("patches")).alias("limited_scope"),
    )


def score(bench: Benchmark, alarms: Alarms, **given) -> ScoreFrames:
    """Score all detectors of ``alarms``; keyword arguments override the settings."""
    st, origin = resolve_settings(bench.defaults, **given)
    r, dd = st["match_mm"] / bench.voxel_mm, st["fa_dedup_mm"] / bench.voxel_mm
    per_patch = patch_scores(bench, alarms, r, dd, st["per_patch_cap"], st["seed"])
    return ScoreFrames(per_patch, pool(per_patch), st, origin, bench, alarms, r)


def off_surface(bench: Benchmark, alarms: DataFrame, r: float) -> DataFrame:
    """(detector, alarms_off_surface): alarms farther than ``r`` from every valid vertex of their patch."""
    inside = alarms.join(bench.scored_patches(), "patch", "left_semi")
    off = without_match(inside, bench.surface, r, ids=["detector", "patch", "alarm_ord"], keys=["patch"])
    return off.groupBy("detector").agg(F.count(F.lit(1)).alias("alarms_off_surface"))


def classify_patches(bench: Benchmark, verdict_input: DataFrame) -> DataFrame:
    """Input patch ids that are not scored: ``unscored`` (known to the corpus) or ``unknown``."""
    rest = verdict_input.select("detector", "patch").distinct().join(bench.scored_patches(), "patch", "left_anti")
    known = bench.known_patches().withColumn("_known", F.lit(True))
    return rest.join(known, "patch", "left").select(
        "detector", "patch", F.when(F.col("_known"), "unscored").otherwise("unknown").alias("kind")
    )
