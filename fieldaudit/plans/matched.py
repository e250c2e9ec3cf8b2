"""Random alarms at the false-alarm rate of a detector."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import SEED
from ..functions.stats import per_100, wilson
from ..operators.sampling import random_alarms
from ..session import cut_lineage
from .score import Alarms, Benchmark, patch_scores, pool

RANDOM, MATCHED = "random", "random at the matched rate"


def matched_random(bench: Benchmark, alarms: Alarms, detector: str, surface: DataFrame, density: float, vertex_area: float, r: float, dedup_r: float, seed=SEED) -> DataFrame:
    """The detector, random alarms at ``density``, and random alarms at the density that gives the detector's rate.

    surface(patch, key, x, y, z) holds the places where a random alarm may be, each standing for ``vertex_area``.  The first pass
    measures the false alarms of detector and random alarms, the second draws anew at ``density`` times their ratio
    (0 if the random alarms had none).  De-duplication and crowding make the rate less than proportional to the density, so the
    second rate is near the first, within sampling noise while alarms are sparse.
    Result: (detector, density, hits, events, recall, wilson_lo, wilson_hi, false_alarms, length, fa_per_100).
    """
    patches = cut_lineage(bench.scored_patches())  # a row per patch, read by places, verdicts and both passes
    bench = replace(bench, scored=patches)
    places = surface.join(patches, "patch", "left_semi")

    def drawn(name: str, places: DataFrame, amount, tag: str) -> Alarms:
        at = random_alarms(places, amount, vertex_area, ["patch"], ["key"], f"{seed}.{tag}")
        rows = at.select(F.lit(name).alias("detector"), "patch", F.col("key").alias("alarm_ord"), "x", "y", "z")
        return Alarms(patches.select(F.lit(name).alias("detector"), "patch"), rows)

    own = Alarms(alarms.verdicts.filter(F.col("detector") == detector), alarms.alarms.filter(F.col("detector") == detector).select("detector", "patch", "alarm_ord", "x", "y", "z"))
    base = drawn(RANDOM, places, density, "base")
    both = cut_lineage(own.alarms.unionByName(base.alarms))  # read by hits, counts and every pass of the de-duplication
    first = cut_lineage(pool(patch_scores(bench, Alarms(own.verdicts.select("detector", "patch").unionByName(base.verdicts), both), r, dedup_r)))  # two rows, read twice
    wanted, got = (F.sum(F.when(F.col("detector") == d, F.col("false_alarms"))) for d in (detector, RANDOM))
    scaled = first.agg(F.coalesce(F.lit(float(density)) * wanted / F.nullif(got.cast("double"), F.lit(0.0)), F.lit(0.0)).alias("_density"))
    again = drawn(MATCHED, places.crossJoin(F.broadcast(scaled)), F.max("_density"), "matched")  # one row
    second = pool(patch_scores(bench, replace(again, alarms=cut_lineage(again.alarms)), r, dedup_r))
    rows = first.withColumn("density", F.when(F.col("detector") == RANDOM, F.lit(float(density))))
    rows = rows.unionByName(second.crossJoin(F.broadcast(scaled)).withColumnRenamed("_density", "density"))  # one row
    return rows.select(
        "detector", "density", "hits", "events", *wilson(F.col("hits"), F.col("events")), "false_alarms", "length", per_100(F.col("false_alarms"), F.col("length")).alias("fa_per_100"))
