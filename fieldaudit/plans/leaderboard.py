"""Ranked leaderboard over all detectors, with strata, intervals and display columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from .score import ScoreFrames, counted_events, event_hits

def board_order(entry: str = "detector"):
    """Recall descending (NULL as 0), full scope first, false alarms ascending (NULL last), then input order."""
    return [
        F.coalesce(F.col("recall"), F.lit(0.0)).desc(), F.col("limited_scope").asc(),
        F.coalesce(F.col("fa_per_100"), F.lit(float("inf"))).asc(), F.col(entry).asc(),
    ]


def stratum_recall(frames: ScoreFrames, strata: DataFrame) -> DataFrame:
    """(detector, stratum, hits, events, recall, interval); ``strata`` is (event_id, stratum).

    Events without a stratum are left out.  Event totals per stratum come from the events alone, so no
    event is repeated per detector.
    """
    b, st = frames.bench, frames.settings
    counted = counted_events(b.events, st["per_patch_cap"], st["seed"]).select("event_id", "patch").join(strata, "event_id")
    total = counted.groupBy("stratum").agg(F.count(F.lit(1)).alias("events"))
    pts = b.event_points.join(counted.select("event_id", "stratum"), "event_id")
    hit = event_hits(pts, frames.input.alarms, frames.radius, extra=["stratum"])
    hits = hit.groupBy("stratum", "detector").agg(F.countDistinct("event_id").alias("hits"))
    rows = total.crossJoin(F.broadcast(frames.input.names()))  # strata x detectors: both are short lists
    rows = rows.join(hits, ["stratum", "detector"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return rows.select("detector", "stratum", "hits", "events", *S.wilson(F.col("hits"), F.col("events")))


def strata_by_key(centres: DataFrame, strata: DataFrame) -> DataFrame:
    """(event_id, stratum) of events (event_id, patch, x, y, z) whose coordinate key is among ``strata`` (key, stratum)."""
    key = T.coordinate_key(F.col("patch"), *[F.round(F.col(a), 1) for a in ("x", "y", "z")])
    one = strata.groupBy("key").agg(F.min("stratum").alias("stratum"))
    return centres.select("event_id", key.alias("key")).join(one, "key").select("event_id", "stratum")


def leaderboard(frames: ScoreFrames, intervals: bool = True, entry: DataFrame | None = None) -> DataFrame:
    """One ranked row per detector.  ``entry`` (detector, entry_ord, ...) adds manifest columns and fixes
    the order of ties; without it ties follow the detector name."""
    if intervals and frames.settings["bootstrap"] > 0:
        frames = frames.materialised()  # three uses of the patch scores
    board = frames.detector_score
    if intervals and frames.settings["bootstrap"] > 0:
        board = board.join(frames.intervals(), "detector", "left")
    tie = "detector"
    if entry is not None:
        board = board.join(F.broadcast(entry), "detector")
        tie = "entry_ord"
    return board.orderBy(*board_order(tie))


def display(board: DataFrame) -> DataFrame:
    """Text cells of the board."""
    c = F.col
    return board.select(
        "detector",
        F.concat(T.percent(c("recall")), F.format_string(" (%d/%d)", c("hits"), c("events"))).alias("recall_cell"),
        T.percent_interval(c("wilson_lo"), c("wilson_hi")).alias("interval_cell"),
        T.fixed(c("fa_per_100")).alias("fa_cell"),
        F.format_string("%d/%d", c("patches_verdict"), c("patches")).alias("coverage_cell"),
        T.scope_badge(c("limited_scope")).alias("scope_cell"),
    )


def rank_of(board: DataFrame, recall: float) -> DataFrame:
    """Place a new recall value would take among the board rows."""
    return board.agg((F.count_if(F.col("recall") > recall) + 1).alias("rank"))


def warning_counters(frames, given: DataFrame, dropped: DataFrame | None = None, geometry_match: bool | None = None) -> DataFrame:
    """One row per detector with the counters that :func:`warnings` reads.

    given(detector, patch) holds the patch ids of the input as they came, dropped(detector, dropped_invalid) is what the
    alarm source counted.  Alarms off the surface are counted where the benchmark has a surface.
    """
    from .score import classify_patches, off_surface

    kinds = classify_patches(frames.bench, given).groupBy("detector").agg(
        F.count_if(F.col("kind") == "unknown").alias("unknown_ids"), F.count_if(F.col("kind") == "unscored").alias("unscored_ids"))
    rows = frames.detector_score.select("detector", "alarms", "patches_verdict", "patches").join(kinds, "detector", "left")
    if frames.bench.surface is not None:
        rows = rows.join(off_surface(frames.bench, frames.input.alarms, frames.radius), "detector", "left")
    else:
        rows = rows.withColumn("alarms_off_surface", F.lit(0))
    rows = rows.withColumn("dropped_invalid", F.lit(0)) if dropped is None else rows.join(dropped, "detector", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("unknown_ids", "unscored_ids", "dropped_invalid", "alarms_off_surface")]
    return rows.select("detector", *zero, "alarms", "patches_verdict", "patches", F.lit(geometry_match).cast("boolean").alias("geometry_match"))


def warnings(detector_rows: DataFrame, match_mm: float) -> DataFrame:
    """(detector, warning) from the per-detector counters; one row per warning that applies.

    Expects columns unknown_ids, unscored_ids, dropped_invalid, alarms, alarms_off_surface,
    patches_verdict, patches and geometry_match (NULL if there is no reference fingerprint).
    """
    c = F.col
    notes = F.array(
        F.when(~c("geometry_match"), "geometry differs from the published fingerprint: not comparable"),
        F.when(c("unknown_ids") > 0, F.format_string("%d patch id(s) are not in the corpus", c("unknown_ids"))),
        F.when(c("unscored_ids") > 0, F.format_string("%d patch(es) carry nothing scored", c("unscored_ids"))),
        F.when(c("dropped_invalid") > 0, F.format_string("%d alarm(s) on invalid vertices dropped", c("dropped_invalid"))),
        F.when(
            c("alarms_off_surface") > 0,
            F.format_string("%d of %d alarm(s) farther than " + f"{match_mm:g}" + " mm from the surface", c("alarms_off_surface"), c("alarms")),
        ),
        F.when(
            c("patches_verdict") < c("patches"),
            F.format_string("no verdict on %d of %d scored patches", c("patches") - c("patches_verdict"), c("patches")),
        ),
    )
    return detector_rows.select("detector", F.explode(F.filter(notes, lambda n: n.isNotNull())).alias("warning"))
