"""Settings grids, sub-groups and census over one pass of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.geometry import XYZ
from ..functions.hashing import SEED, digest
from ..operators.bootstrap import DRAWS, bootstrap_ratio
from ..operators.sampling import cap_per_group, first_per_group
from ..operators.spatial import nearest
from ..session import cols
from .score import CONFIRMED, Alarms, Benchmark, counted_events, event_hits


def smallest_hit(bench: Benchmark, alarms: Alarms, largest: float, points: DataFrame) -> DataFrame:
    """(event_id, patch, detector, nearest) up to ``largest``.

    Hits are monotone in the radius, so one bounded nearest-neighbour join serves every radius of a grid.
    """
    near = nearest(points, alarms.alarms, ids=["event_id", "patch"], keys=["patch"], tags=["detector"], bound=largest)
    return near.groupBy("event_id", "patch", "detector").agg(F.min("nearest").alias("nearest"))


def settings_blocks(bench: Benchmark, alarms: Alarms, caps, radii, seed=SEED) -> DataFrame:
    """(patch, subset, detector, cap, radius, hits, events): sufficient statistic of every grid cell.

    Totals come from the events alone; hits are aggregated per patch before they meet the grid.
    """
    confirmed = bench.events.filter(F.col("status") == CONFIRMED)
    chosen = None
    for cap in caps:
        part = cap_per_group(confirmed, cap, ["patch"], "event_id", seed).select("event_id", "patch", "subset", F.lit(cap).alias("cap"))
        chosen = part if chosen is None else chosen.unionByName(part)
    total = chosen.groupBy("patch", "subset", "cap").agg(F.count(F.lit(1)).alias("events"))
    pts = bench.event_points.join(confirmed.select("event_id"), "event_id", "left_semi")
    near = smallest_hit(bench, alarms, max(radii), pts).join(chosen.select("event_id", "cap"), "event_id")
    grid = F.explode(F.array(*[F.lit(float(r)) for r in sorted(radii)])).alias("radius")
    hit = near.select("patch", "detector", "cap", "nearest", grid).filter(F.col("nearest") <= F.col("radius"))
    hits = hit.groupBy("patch", "detector", "cap", "radius").agg(F.count(F.lit(1)).alias("hits"))
    cells = total.crossJoin(F.broadcast(alarms.names())).select("*", grid)  # detectors x radii: both are short lists
    out = cells.join(hits, ["patch", "detector", "cap", "radius"], "left")
    return out.withColumn("hits", F.coalesce("hits", F.lit(0)))


def settings_recall(blocks: DataFrame) -> DataFrame:
    """Recall per (detector, cap, radius, subset) and pooled over subsets, by grouping sets."""
    agg = blocks.groupingSets(
        [["detector", "cap", "radius", "subset"], ["detector", "cap", "radius"]], "detector", "cap", "radius", "subset"
    ).agg(F.sum("hits").alias("hits"), F.sum("events").alias("events"))
    return agg.select(
        "detector", "cap", "radius", F.coalesce("subset", F.lit("pooled")).alias("subset"), "hits", "events",
        *S.wilson(F.col("hits"), F.col("events")),
    )


def settings_intervals(blocks: DataFrame, draws: int = DRAWS, seed=SEED, by=()) -> DataFrame:
    """Bootstrap interval of every grid cell; ``by`` (for example subset) has block sets of its own."""
    return bootstrap_ratio(
        blocks, {"boot": (F.col("hits"), F.col("events"))}, block="patch", by=by,
        series=["detector", "cap", "radius"], draws=draws, seed=seed,
    )


def holds(intervals: DataFrame, precision_lower: float, bar: float, frozen: Column) -> DataFrame:
    """Do all cells hold below the bar once corrected for label precision; value of the frozen cell."""
    d = intervals.withColumn("corrected", S.corrected_upper(F.col("boot_hi"), precision_lower))
    return d.agg(
        F.bool_and(S.holds_below(F.col("corrected"), bar)).alias("all_hold"), F.count(F.lit(1)).alias("settings"),
        F.max(F.when(frozen, F.col("corrected"))).alias("frozen_corrected"),
    )


def all_of(*conditions: Column | None) -> Column:
    """Composed row filters: true where every given condition is; no condition is no filter."""
    out = F.lit(True)
    for c in conditions:
        out = out if c is None else out & F.coalesce(c, F.lit(False))
    return out


def batch_grid(
    bench: Benchmark, alarms: Alarms, r: float, caps, batch: Column, precision_lower: float, bar: float, draws: int = DRAWS, seed=SEED, filters: dict[str, Column] | None = None,
) -> DataFrame:
    """Recall per (detector, cap, batch), with its block bootstrap and the upper bound corrected for label precision.

    ``batch`` is a column of the patch; ``filters`` are further named conditions on the event, none by default.  Every
    (cap, filter) is a predicate of one conditional aggregate over the events, so the hits are found and counted once.
    Batches are block sets of their own.  ``patches`` counts the batch's scored patches, with or without counted events.
    """
    confirmed = bench.events.filter(F.col("status") == CONFIRMED).withColumn("batch", batch)
    filters = filters or {"all": None}
    most = max([c for c in caps if c], default=0)
    ranked = confirmed.withColumn("_rank", F.lit(None).cast("int"))
    if most:
        top = first_per_group(confirmed, most, ["patch"], [digest(seed, F.col("patch"), F.col("event_id")), "event_id"]).select("event_id", F.col("rank").alias("_rank"))
        ranked = confirmed.join(top, "event_id", "left")
    cells = [(c, n, all_of(F.col("_rank") <= c if c else None, f)) for c in caps for n, f in filters.items()]
    tagged = ranked.select("event_id", "patch", "batch", *[p.alias(f"_p{i}") for i, (_, _, p) in enumerate(cells)])
    counts = [F.count_if(f"_p{i}").alias(f"_n{i}") for i in range(len(cells))]
    total = tagged.groupBy("batch", "patch").agg(*counts)
    points = bench.event_points.join(confirmed.select("event_id"), "event_id", "left_semi")
    hit = event_hits(points, alarms.alarms, r).select("event_id", "detector").distinct().join(tagged, "event_id")
    hits = hit.groupBy("detector", "batch", "patch").agg(*[c.alias(f"_k{i}") for i, c in enumerate(counts)])
    rows = total.crossJoin(F.broadcast(alarms.names())).join(hits, ["detector", "batch", "patch"], "left")  # detectors: manifest-sized
    cell = F.explode(F.array(*[
        F.struct(F.lit(c).cast("long").alias("cap"), F.lit(n).alias("filter"), F.coalesce(f"_k{i}", F.lit(0)).alias("hits"), F.col(f"_n{i}").alias("events"))
        for i, (c, n, _) in enumerate(cells)])).alias("_c")
    blocks = rows.select("detector", "batch", "patch", cell).select("detector", "batch", "patch", "_c.*").filter("events > 0")
    by = ["batch", "cap", "filter"]
    boot = bootstrap_ratio(blocks, {"boot": (F.col("hits"), F.col("events"))}, block="patch", by=by, series=["detector"], draws=draws, seed=seed)
    sums = blocks.groupBy("detector", *by).agg(F.sum("hits").alias("hits"), F.sum("events").alias("events"))
    size = bench.scored_patches().withColumn("batch", batch).groupBy("batch").agg(F.count(F.lit(1)).alias("patches"))
    out = sums.join(boot, ["detector", *by], "left").join(size, "batch", "left")
    corrected = S.corrected_upper(F.col("boot_hi"), precision_lower)
    return out.select(
        "detector", *by, "patches", "hits", "events", *S.wilson(F.col("hits"), F.col("events")), "boot_lo", "boot_hi", corrected.alias("corrected_upper"),
        S.holds_below(corrected, bar).alias("holds"))


def recall_by(events: DataFrame, alarms: Alarms, r: float, by, any_status: bool = False) -> DataFrame:
    """Recall per detector and group columns of the events (a batch, a status, a subset).

    ``events`` carries its point; groups without a hit are reported with 0.
    """
    by = list(by)
    ev = events if any_status else events.filter(F.col("status") == CONFIRMED)
    total = ev.groupBy(*by).agg(F.count(F.lit(1)).alias("events"))
    hits = event_hits(ev, alarms.alarms, r, extra=by).groupBy("detector", *by).agg(F.countDistinct("event_id").alias("hits"))
    rows = total.crossJoin(F.broadcast(alarms.names())).join(hits, ["detector", *by], "left")
    rows = rows.withColumn("hits", F.coalesce("hits", F.lit(0)))
    return rows.select("detector", *by, "hits", "events", *S.wilson(F.col("hits"), F.col("events")))


def coverage_by_status(events: DataFrame, alarms: Alarms) -> DataFrame:
    """(detector, status, patches, patches_verdict): patches with such an event, and with detector output too."""
    pairs = events.select("status", "patch").distinct()
    total = pairs.groupBy("status").agg(F.count(F.lit(1)).alias("patches"))
    seen = pairs.join(alarms.verdicts, "patch").groupBy("detector", "status").agg(F.countDistinct("patch").alias("patches_verdict"))
    rows = total.crossJoin(F.broadcast(alarms.names())).join(seen, ["detector", "status"], "left")
    return rows.select("detector", "status", "patches", F.coalesce("patches_verdict", F.lit(0)).alias("patches_verdict"))


def census(bench: Benchmark, subset: Column, second: Column | None = None, multi: DataFrame | None = None) -> DataFrame:
    """Corpus counters per subset and pooled; one row per patch is aggregated first.

    ``second`` says whether a second rule confirms an event (null: no); ``multi`` has a row with ``patch`` per
    entry of the corpus that stands for several events at once.  Without them their counters are 0.
    """
    s, other = F.col("status"), F.lit(False) if second is None else F.coalesce(second, F.lit(False))
    per_event = bench.events.groupBy("patch").agg(
        F.count_if(other).alias("confirmed_second"), F.count_if(other & (s == CONFIRMED)).alias("confirmed_both"),
        F.count(F.lit(1)).alias("candidates"), F.count_if(s == CONFIRMED).alias("confirmed"),
        F.count_if(s == "contradicted").alias("contradicted"), F.count_if(s == "unconfirmed").alias("unconfirmed"),
        F.count_if(F.col("stratum") == "abrupt").alias("abrupt"),
    )
    lengths = bench.run_lengths.select("run_id", "length")
    per_run = bench.runs.join(lengths, "run_id").groupBy("patch").agg(
        F.count_if(s == CONFIRMED).alias("runs_confirmed"), F.count_if(s != CONFIRMED).alias("runs_other"),
        F.sum(F.when(s == CONFIRMED, F.col("length"))).alias("length_confirmed"),
    )
    both = per_event.join(per_run, "patch", "full")
    if multi is None:
        both = both.withColumn("multi", F.lit(0).cast("long"))
    else:
        both = both.join(multi.groupBy("patch").agg(F.count(F.lit(1)).alias("multi")), "patch", "full")
    both = both.na.fill(0).withColumn("subset", subset)
    sums = ["candidates", "confirmed", "contradicted", "unconfirmed", "abrupt", "confirmed_second", "confirmed_both", "multi", "runs_confirmed", "runs_other", "length_confirmed"]
    agg = both.groupingSets([["subset"], []], "subset").agg(
        F.count(F.lit(1)).alias("patches"), *[F.sum(c).alias(c) for c in sums],
        F.count_if((F.col("confirmed") > 0) | (F.col("runs_confirmed") > 0)).alias("scored_patches"),
        F.count_if(F.col("confirmed") > 0).alias("event_patches"), F.max("confirmed").alias("max_events_per_patch"),
    )
    return agg.withColumn("subset", F.coalesce("subset", F.lit("pooled")))


def sweep_summary(bench: Benchmark, alarms: Alarms, r: float, cap: int, seed, flag: Column) -> DataFrame:
    """Per detector: recall counts, without the largest patch, capped, and split by a flag."""
    ev = bench.events.filter(F.col("status") == CONFIRMED)
    capped = counted_events(bench.events, cap, seed).select("event_id", F.lit(True).alias("_cap"))
    big = ev.groupBy("patch").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "patch").limit(1).select(F.col("patch").alias("_big"))
    tagged = ev.join(capped, "event_id", "left").crossJoin(F.broadcast(big)).select(  # one row
        "event_id", "patch", F.coalesce("_cap", F.lit(False)).alias("capped"), (F.col("patch") != F.col("_big")).alias("small"), flag.alias("flag")
    )
    hit = event_hits(bench.event_points.join(ev.select("event_id"), "event_id", "left_semi"), alarms.alarms, r)
    hits = hit.select("event_id", "detector").distinct().join(tagged, "event_id")
    parts = {"": F.lit(True), "_without_big": F.col("small"), "_capped": F.col("capped"), "_abrupt": F.col("flag"), "_gradual": ~F.col("flag")}
    n = tagged.agg(*[F.count_if(c).alias(f"events{s}") for s, c in parts.items()])
    k = hits.groupBy("detector").agg(*[F.count_if(c).alias(f"hits{s}") for s, c in parts.items()])
    rows = alarms.names().join(k, "detector", "left").na.fill(0)
    return rows.crossJoin(n)  # one row of totals


def extreme_hit_setting(bench: Benchmark, alarms: Alarms, settings) -> DataFrame:
    """Per detector over confirmed events: how many are never hit, extremes of the first hitting setting."""
    ev = bench.events.filter(F.col("status") == CONFIRMED)
    pts = bench.event_points.join(ev.select("event_id"), "event_id", "left_semi")
    near = smallest_hit(bench, alarms, max(settings), pts)
    first = F.array_min(F.filter(F.array(*[F.lit(float(s)) for s in settings]), lambda s: s >= F.col("nearest")))
    k = near.groupBy("detector").agg(F.count(F.lit(1)).alias("_hit"), F.max(first).alias("largest"), F.min(first).alias("smallest"))
    n = ev.agg(F.count(F.lit(1)).alias("events"))
    rows = alarms.names().join(k, "detector", "left").crossJoin(n)  # one row of totals
    return rows.select("detector", "events", (F.col("events") - F.coalesce("_hit", F.lit(0))).alias("never_hit"), "largest", "smallest")
