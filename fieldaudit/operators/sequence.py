"""Sequence operators along ordered paths and grid lines.

A grid line (one row or one column of one patch) is bounded by the grid's width, so windows over a line
are safe; windows over anything that can grow with the table go through :mod:`ordered`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import XYZ, distance
from ..session import cols, join_same
from .ordered import previous_row


def path_steps(vertices: DataFrame, keys, order, block: Column | None = None) -> DataFrame:
    """Adds ``step``: distance from the previous vertex of the path (NULL on the first)."""
    if block is None:
        w = W.partitionBy(*keys).orderBy(*order)
        d = vertices.select("*", *[F.lag(a).over(w).alias(f"prev_{a}") for a in XYZ])
    else:
        d = previous_row(vertices.withColumn("_block", block), XYZ, order, keys=keys)
    step = distance([F.col(a) for a in XYZ], [F.col(f"prev_{a}") for a in XYZ])
    return d.withColumn("step", step).drop("_block", *[f"prev_{a}" for a in XYZ])


def arc_length(vertices: DataFrame, keys, order, block: Column | None = None, unit: float = 1.0) -> DataFrame:
    """(keys, length, vertices): summed edge length along each path; a single vertex has length 0."""
    steps = path_steps(vertices, keys, order, block)
    return steps.groupBy(*keys).agg(
        (F.coalesce(F.sum("step"), F.lit(0.0)) / F.lit(unit)).alias("length"), F.count(F.lit(1)).alias("vertices")
    )


def expand_runs(runs: DataFrame, id_cols=("run_id", "patch")) -> DataFrame:
    """Run (axis, r0, c0, r1, c1, inclusive) -> ordered vertices (ord, row, col)."""
    n = F.when(F.col("axis") == "row", F.col("c1") - F.col("c0")).otherwise(F.col("r1") - F.col("r0"))
    ordinal = F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long")))
    d = runs.filter(run_problem().isNull()).select(*id_cols, "axis", "r0", "c0", ordinal.alias("ord"))
    on_row = F.col("axis") == "row"
    return d.select(
        *id_cols, "ord",
        F.when(on_row, F.col("r0")).otherwise(F.col("r0") + F.col("ord")).alias("row"),
        F.when(on_row, F.col("c0") + F.col("ord")).otherwise(F.col("c0")).alias("col"),
    )


def run_problem() -> Column:
    """Why a run is malformed, NULL if it is not."""
    c = F.col
    return (
        F.when(~c("axis").isin("row", "col"), "axis must be row or col")
        .when((c("axis") == "row") & ((c("r0") != c("r1")) | (c("c1") < c("c0"))), "row run must keep its row and go right")
        .when((c("axis") == "col") & ((c("c0") != c("c1")) | (c("r1") < c("r0"))), "col run must keep its column and go down")
    )


def line_runs(cells: DataFrame, by=("patch",), axes=("row", "col")) -> DataFrame:
    """Maximal runs of consecutive cells along grid rows and grid columns.

    Result: (by, axis, line, start, stop, n).  ``cells`` holds the occupied cells (row, col).
    """
    by = list(by)
    out = None
    for axis in axes:
        line, pos = ("row", "col") if axis == "row" else ("col", "row")
        rn = F.row_number().over(W.partitionBy(*by, line).orderBy(pos))
        d = cells.select(*by, F.col(line).alias("line"), F.col(pos).alias("pos"), (F.col(pos) - rn).alias("_island"))
        part = d.groupBy(*by, "line", "_island").agg(
            F.min("pos").alias("start"), F.max("pos").alias("stop"), F.count(F.lit(1)).alias("n")
        ).select(*by, F.lit(axis).alias("axis"), "line", "start", "stop", "n")
        out = part if out is None else out.unionByName(part)
    return out


def streaks(rows: DataFrame, keys, order: str, flag: Column) -> DataFrame:
    """Maximal streaks of rows where ``flag`` is true; false or NULL ends a streak.

    Result: (keys, start, stop, n).  Sequences are runs along a grid line or profiles: bounded.
    """
    w = W.partitionBy(*keys).orderBy(order)
    d = rows.select(*keys, F.col(order).alias("_o"), F.coalesce(flag, F.lit(False)).alias("_f"), F.row_number().over(w).alias("_rn"))
    on = d.filter("_f")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("_o"))
    isl = on.withColumn("_island", F.col("_rn") - rank)
    return isl.groupBy(*keys, "_island").agg(
        F.min("_o").alias("start"), F.max("_o").alias("stop"), F.count(F.lit(1)).alias("n")
    ).drop("_island")


def longest_streak(rows: DataFrame, keys, order: str, flag: Column) -> DataFrame:
    """(keys, longest): length of the longest streak, 0 where the flag is never true."""
    best = streaks(rows, keys, order, flag).groupBy(*keys).agg(F.max("n").alias("_n"))
    return rows.select(*keys).distinct().join(best, list(keys), "left").select(*keys, F.coalesce("_n", F.lit(0)).alias("longest"))


def longest_block(rows: DataFrame, keys, order: str, flag: Column) -> DataFrame:
    """First of the longest streaks per key: (keys, start, stop, n)."""
    best = streaks(rows, keys, order, flag).groupBy(*keys).agg(
        F.max_by(F.struct("start", "stop", "n"), F.struct(F.col("n"), -F.col("start"))).alias("b")
    )
    return best.select(*keys, "b.start", "b.stop", "b.n")


def tiled_windows(vertices: DataFrame, keys, ordinal: str, size: int = 5) -> DataFrame:
    """Consecutive windows of ``size`` vertices; an incomplete tail is dropped: (keys, window, first, last)."""
    w = F.floor(F.col(ordinal) / size).cast("long")
    return vertices.groupBy(*keys, w.alias("window")).agg(
        F.min(ordinal).alias("first"), F.max(ordinal).alias("last"), F.count(F.lit(1)).alias("_n")
    ).filter(F.col("_n") == size).drop("_n")


def run_acceptance(rows: DataFrame, keys, order: str, on_layer: str, min_decided=0.8, min_on=0.70, max_streak=4) -> DataFrame:
    """Accept a run: at least 80 % decided, at least 70 % on the layer, no off streak over 4.

    NULL if too few vertices are decided.
    """
    flag = F.col(on_layer)
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count(flag).alias("decided"), F.count_if(flag).alias("on")
    )
    off = longest_streak(rows, keys, order, ~flag).withColumnRenamed("longest", "off_streak")
    d = join_same(agg, off, keys)
    undecided = (F.col("decided") < min_decided * F.col("n")) | (F.col("decided") == 0)
    frac = F.col("on") / F.nullif(F.col("decided").cast("double"), F.lit(0.0))
    return d.withColumn("fraction_on", frac).withColumn(
        "accepted", F.when(~undecided, (frac >= min_on) & (F.col("off_streak") <= max_streak))
    )


def chain_labels(steps: DataFrame, keys, order: str, delta: str) -> DataFrame:
    """Label the assigned vertices of each run.

    ``delta`` is the measured change against the previous assigned vertex: 0 for the same sheet, NULL
    where the relation cannot be measured (a break).  The first row of a run starts a chain.  Adds
    ``chain`` (0-based), ``label`` (relative to the start of the chain) and ``segment`` (0-based
    within the chain).  Only the previous assigned vertex matters, so running sums are enough.
    """
    w = W.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    first = F.row_number().over(w) == 1
    start = first | F.col(delta).isNull()
    d = steps.withColumn("_start", start)
    d = d.withColumn("chain", F.sum(F.col("_start").cast("int")).over(upto) - 1)
    cw = W.partitionBy(*keys, "chain").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    move = F.when(F.col("_start"), F.lit(0)).otherwise(F.col(delta))
    d = d.withColumn("label", F.sum(move).over(cw))
    d = d.withColumn("segment", F.sum(F.when(move != 0, 1).otherwise(0)).over(cw))
    return d.drop("_start")


def segments(labelled: DataFrame, keys, pos: str, arc: str) -> DataFrame:
    """One row per segment of a labelled chain.

    Input rows carry their position on the run and ``arc``, the running arc length up to that
    position.  Result: label, i0, i1, n, span length, coverage and the longest unassigned stretch.
    """
    by = cols(keys, "chain", "segment")
    w = W.partitionBy(*by).orderBy(pos)
    d = labelled.withColumn("_gap", F.col(pos) - F.lag(pos).over(w)).withColumn("_arc_gap", F.col(arc) - F.lag(arc).over(w))
    return d.groupBy(*by).agg(
        F.min("label").alias("label"), F.min(pos).alias("i0"), F.max(pos).alias("i1"), F.count(F.lit(1)).alias("n"),
        (F.max(arc) - F.min(arc)).alias("length"),
        (F.count(F.lit(1)) / (F.max(pos) - F.min(pos) + 1)).alias("coverage"),
        F.coalesce(F.max(F.when(F.col("_gap") > 1, F.col("_arc_gap"))), F.lit(0.0)).alias("max_gap"),
    )


def segment_ok(min_length: float, min_coverage: float = 0.8, max_gap: float = 1.0) -> Column:
    """A segment lies on its sheet: long enough, covered enough, no long unassigned stretch."""
    return (F.col("length") >= min_length) & (F.col("coverage") >= min_coverage) & (F.col("max_gap") <= max_gap)


def switches(segs: DataFrame, keys, min_length: float, min_coverage=0.8, max_gap=1.0, held: int = 2) -> DataFrame:
    """Adjacent segments of a chain where one side is accepted and the other is held by >= ``held`` vertices.

    Result: (keys, chain, segment, delta, a_i1, b_i0, a_length, b_length, both_sides).
    """
    ok = segment_ok(min_length, min_coverage, max_gap)
    d = segs.withColumn("_ok", ok)
    w = W.partitionBy(*keys, "chain").orderBy("segment")
    for c in ("label", "n", "_ok", "i0", "length"):
        d = d.withColumn(f"_b_{c}", F.lead(c).over(w))
    found = d.filter(
        F.col("_b_label").isNotNull()
        & ((F.col("_b__ok") & (F.col("n") >= held)) | (F.col("_ok") & (F.col("_b_n") >= held)))
    )
    return found.select(
        *keys, "chain", "segment", (F.col("_b_label") - F.col("label")).alias("delta"), F.col("i1").alias("a_i1"),
        F.col("_b_i0").alias("b_i0"), F.col("length").alias("a_length"), F.col("_b_length").alias("b_length"),
        (F.col("_ok") & F.col("_b__ok")).alias("both_sides"),
    )
