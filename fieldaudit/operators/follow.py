"""Following one sheet along a run, and what its offset does: transition metrics and the noise of negatives.

All operators read *placed* stacks, one row per vertex of a run that has a stack:
``placed(patch, run, pos, arc, row, col, stack, k, spacing)`` with the running arc length ``arc`` in millimetres, the
assigned sheet ``k`` (1-based, NULL if none) and its spacing, as :func:`stacks.place` makes them.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, ship
from .ordered import exact_percentiles
from .spatial import k_nearest_within
from .stacks import Rules


def first_match(sheet: dict, at: tuple, sheets: range, members: tuple, here: tuple, slack: float) -> int | None:
    """The first of ``sheets`` that shares a near enough reference patch with ``sheet``, grid positions by patch.

    ``members`` are flat columns of all sheets of a block: where the members of each sheet begin, then their p, r and c.
    """
    reach = 1.5 * math.hypot(at[0] - here[0], at[1] - here[1]) + slack
    begin, ps, rs, cs = members
    for j in sheets:
        for m in range(begin[j], begin[j + 1]):
            if any(math.hypot(r - rs[m], c - cs[m]) <= reach for r, c in sheet.get(ps[m], ())):
                return j
    return None


def _flat_stacks(column: pa.ListArray) -> tuple[list, list, tuple]:
    """A column of stacks as flat lists: where each stack begins, t of every sheet, and the members as in :func:`first_match`."""
    sheets = column.values
    members = sheets.field("members")
    return column.offsets.to_pylist(), sheets.field("t").to_pylist(), (members.offsets.to_pylist(), *[members.values.field(c).to_pylist() for c in "prc"])


def _positions(sheet: int, members: tuple) -> dict:
    """Grid positions of a sheet's members by reference patch."""
    begin, ps, rs, cs = members
    out: dict = {}
    for m in range(begin[sheet], begin[sheet + 1]):
        out.setdefault(ps[m], []).append((rs[m], cs[m]))
    return out


def follow_sheets(tracks: DataFrame, placed: DataFrame, by, rules: Rules = Rules()) -> DataFrame:
    """Follow the sheet ``k0`` seen at position ``p0`` of a run to position ``p1``, forwards or backwards.

    At every position the sheet is the first one that matches the last match; where none does and the last match lies
    beyond the start, the observation at the start is tried as well.  Positions without a match are left out and don't
    end the track.  tracks(by, patch, run, p0, p1, k0), ``by`` naming one track; result: (by, pos, j, t), j from 1.

    The fold is sequential and its state is two observations, so rows come in order of their track and the state is carried
    from one Arrow block to the next: a track of any length takes the memory of one block.
    """
    ship(tracks.sparkSession)
    by = list(by)
    types = dict(tracks.dtypes)
    span = tracks.select(*by, "patch", "run", "p0", "p1", "k0").join(placed.select("patch", "run", "pos", "row", "col", "stack"), ["patch", "run"])
    span = span.filter("pos BETWEEN least(p0, p1) AND greatest(p0, p1)")
    rows = span.select(*by, F.abs(F.col("pos") - F.col("p0")).alias("_step"), "pos", F.col("k0").cast("int").alias("_k0"), "row", "col", "stack")
    rows = rows.repartition(*by).sortWithinPartitions(*by, "_step")
    n, slack = len(by), rules.grid_slack

    def fold(batches):
        track, origin, last = None, None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns - 1)]
            first, ts, members = _flat_stacks(batch.column(batch.num_columns - 1))
            found = []
            for i, (step, pos, k0, row, col) in enumerate(zip(*columns[n:], strict=True)):
                name, here, stack = tuple(c[i] for c in columns[:n]), (row, col), range(first[i], first[i + 1])
                if name != track:
                    track, last = name, None
                    origin = (_positions(stack[k0 - 1], members), here) if step == 0 and k0 and k0 <= len(stack) else None
                if origin is None:
                    continue
                j = first_match(*(last or origin), stack, members, here, slack)
                if j is None and last and last[1] != origin[1]:
                    j = first_match(*origin, stack, members, here, slack)
                if j is not None:
                    last = (_positions(j, members), here)
                    found.append((*name, pos, j - first[i] + 1, ts[j]))
            out = list(zip(*found, strict=True)) or [()] * (n + 3)
            kinds = [*[batch.schema.field(c).type for c in range(n)], pa.int64(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [*by, "pos", "j", "t"])

    return rows.mapInArrow(fold, ", ".join([*[f"{c} {types[c]}" for c in by], "pos long, j int, t double"]))


def transitions(segments: DataFrame) -> DataFrame:
    """Neighbouring segments of a chain: (patch, run, pos_a, pos_b, delta), the last position before and the first behind."""
    w = W.partitionBy("patch", "run", "chain").orderBy("segment")
    d = segments.select("patch", "run", F.col("i1").alias("pos_a"), F.lead("i0").over(w).alias("pos_b"), (F.lead("label").over(w) - F.col("label")).alias("delta"))
    return d.filter("pos_b IS NOT NULL").select("patch", "run", *[F.col(c).cast("long").alias(c) for c in ("pos_a", "pos_b", "delta")])


def _inside(placed: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of ``placed`` between ``_lo`` and ``_hi`` of a run; Spark finds their positions before it fetches their stacks."""
    p, s = placed.alias("p"), spans.alias("s")
    return p.join(s, F.expr("p.patch = s.patch AND p.run = s.run AND p.pos BETWEEN s._lo AND s._hi"), "left_semi")


def transition_metrics(members: DataFrame, placed: DataFrame, segments: DataFrame, edges: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    """How a surface moves from one sheet to another between two positions of a run, one row per member.

    members(member, patch, run, pos_a, pos_b, delta).  A member is ``reproduced`` if neighbouring segments end and start
    at its positions with its ``delta``; the others have lengths only.  Sheet A is followed from ``pos_a`` to ``pos_b``, sheet B
    back from ``pos_b``.  Where both are seen as different sheets, ``o`` is the surface's offset from A towards B and
    ``f`` its share of the gap between them.  Steps lead from one such position to the next; over positions in between
    that lack a sheet the change is divided by their number, and ``partial`` says that some are missing.

    edges(patch, run, pos, score, ref) are scores of the edges from a position to the next; those from ``pos_a`` - 1 to
    ``pos_b`` count, NaN and NULL scores don't.  Steps and offsets are in voxels, rates per millimetre.
    """
    own = members.groupBy("patch", "run").agg(F.min("pos_a").alias("_lo"), F.max("pos_b").alias("_hi"))
    placed = cut_lineage(_inside(placed, own).select("patch", "run", "pos", "arc", "row", "col", "stack", "k", "spacing"))  # read by ends, tracks and steps
    at = placed.select("patch", "run", "pos", "arc", "k", "spacing")
    ends = {s: at.select("patch", "run", F.col("pos").alias(f"pos_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("arc", "k", "spacing")]) for s in "ab"}
    known = transitions(segments).distinct().withColumn("reproduced", F.lit(True))
    m = members.select("member", "patch", "run", F.col("pos_a").cast("long").alias("pos_a"), F.col("pos_b").cast("long").alias("pos_b"), F.col("delta").cast("long").alias("delta"))
    m = m.join(known, ["patch", "run", "pos_a", "pos_b", "delta"], "left").withColumn("reproduced", F.coalesce("reproduced", F.lit(False)))
    m = m.join(ends["a"], ["patch", "run", "pos_a"], "left").join(ends["b"], ["patch", "run", "pos_b"], "left")
    m = m.withColumn("n_steps", F.col("pos_b") - F.col("pos_a")).withColumn("width_mm", F.col("arc_b") - F.col("arc_a"))

    start = m.filter("reproduced")
    sides = F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("pos_a").alias("p0"), F.col("pos_b").alias("p1"), F.col("k_a").alias("k0")),
        F.struct(F.lit("b").alias("side"), F.col("pos_b").alias("p0"), F.col("pos_a").alias("p1"), F.col("k_b").alias("k0"))))
    tracks = start.select("member", "patch", "run", sides.alias("_s")).select("member", "patch", "run", "_s.*")
    seen = follow_sheets(tracks, placed, ["member", "side"], rules)
    both = seen.groupBy("member", "pos").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}") for s in "ab" for c in ("j", "t")]).filter("ja <> jb")
    both = both.select("member", "pos", (-F.col("ta") * F.signum(F.col("tb") - F.col("ta"))).alias("o"), F.abs(F.col("tb") - F.col("ta")).alias("gap"))
    both = both.withColumn("f", F.when(F.col("gap") > 0, F.col("o") / F.col("gap")))
    both = both.join(start.select("member", "patch", "run", "pos_a", "pos_b"), "member").join(at.select("patch", "run", "pos", "arc"), ["patch", "run", "pos"])
    w = W.partitionBy("member").orderBy("pos")  # the positions of one transition
    d = both.select("*", *[F.lag(c).over(w).alias(f"_{c}") for c in ("pos", "o", "gap", "f", "arc")])
    d = d.withColumn("_n", F.col("pos") - F.col("_pos")).withColumn("_mm", F.when(F.col("arc") > F.col("_arc"), F.col("arc") - F.col("_arc")))
    d = d.withColumn("_d", F.abs(F.col("o") - F.col("_o"))).withColumn("_sf", F.abs(F.col("f") - F.col("_f")) * 0.5 * (F.col("gap") + F.col("_gap")))

    def end(c: str, s: str):
        return F.max(F.when(F.col("pos") == F.col(f"pos_{s}"), F.col(c))).alias(f"{c}_{s}")

    found = d.groupBy("member").agg(
        (F.coalesce(F.max("_n") > 1, F.lit(False)) | (F.min("pos") != F.min("pos_a")) | (F.max("pos") != F.max("pos_b"))).alias("partial"),
        F.count(F.lit(1)).alias("n_defined"), *[end(c, s) for c in ("gap", "o", "f") for s in "ab"],
        F.max(F.col("_d") / F.col("_n")).alias("max_step"), F.max(F.col("_d") / F.col("_mm")).alias("max_rate"),
        F.max(F.col("_sf") / F.col("_n")).alias("max_step_sf"), F.max(F.col("_sf") / F.col("_mm")).alias("max_rate_sf"),
        F.count("_n").alias("n_step_measurements"))
    out = m.join(found, "member", "left")
    out = out.withColumn("partial", F.when(F.col("reproduced"), F.coalesce("partial", F.lit(False))))
    for c in ("n_defined", "n_step_measurements"):
        out = out.withColumn(c, F.when(F.col("reproduced"), F.coalesce(c, F.lit(0))))
    out = out.withColumn("spacing_b", F.when(F.col("reproduced"), F.col("spacing_b"))).withColumn("total_offset", F.col("o_b") - F.col("o_a"))
    out = out.withColumn("total_sf", 0.5 * (F.col("gap_a") + F.col("gap_b")) * (F.col("f_b") - F.col("f_a")))
    kept = [
        "member", "patch", "run", "pos_a", "pos_b", "delta", "reproduced", "n_steps", "width_mm", "partial", "n_defined", "spacing_b", "gap_a", "gap_b", "o_a", "o_b",
        "f_a", "f_b", "total_offset", "total_sf", "max_step", "max_rate", "max_step_sf", "max_rate_sf", "n_step_measurements"]
    out = out.select(*kept)
    if edges is None:
        return out
    zone = start.select("member", "patch", "run", "pos_a", "pos_b").join(edges.join(own.select("patch", "run"), ["patch", "run"], "left_semi"), ["patch", "run"]).filter("pos BETWEEN pos_a - 1 AND pos_b AND NOT isnan(score)")
    zone = zone.groupBy("member").agg(F.max("score").alias("zone_score"), F.max(F.col("score") * F.col("ref")).alias("zone_voxels"))
    return out.join(zone, "member", "left")


def negative_noise(negatives: DataFrame, placed: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Change of the offset from one sheet at every step along runs that hold no event.

    negatives(negative, patch, run, i0, i1).  The sheet of the first assigned position is followed to the end, and
    with it the next sheet of that stack, or the one before where there is none.  Result: (negative, pos, step, step_sf) for each
    position whose sheet is seen there and at the next one; ``step_sf`` is the change in the share of the gap between both
    sheets times their mean gap, NULL where the two aren't seen apart at both positions.
    """
    inside = negatives.select("negative", "patch", "run", "i0", "i1").join(placed.select("patch", "run", "pos", "k", F.size("stack").alias("_size")), ["patch", "run"])
    first = inside.filter("k IS NOT NULL AND pos BETWEEN i0 AND i1").groupBy("negative", "patch", "run", "i1").agg(
        F.min_by(F.struct("pos", "k", "_size"), "pos").alias("s")).select("negative", "patch", "run", F.col("s.pos").alias("p0"), F.col("i1").alias("p1"), "s.k", "s._size")
    second = "CASE WHEN k < _size THEN k + 1 WHEN k > 1 THEN k - 1 END"
    sides = F.expr(f"explode(array(struct('a' AS side, k AS k0), struct('b' AS side, {second} AS k0)))")
    tracks = first.select("negative", "patch", "run", "p0", "p1", sides.alias("_s")).select("negative", "patch", "run", "p0", "p1", "_s.*").filter("k0 IS NOT NULL")
    seen = follow_sheets(tracks, placed, ["negative", "side"], rules)
    both = seen.groupBy("negative", "pos").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}") for s in "ab" for c in ("j", "t")]).filter("ja IS NOT NULL")
    both = both.withColumn("gap", F.when(F.col("ja") != F.col("jb"), F.abs(F.col("tb") - F.col("ta"))))
    both = both.withColumn("f", F.when(F.col("gap") > 0, -F.col("ta") * F.signum(F.col("tb") - F.col("ta")) / F.col("gap")))
    w = W.partitionBy("negative").orderBy("pos")  # positions of one grid line
    d = both.select("*", *[F.lead(c).over(w).alias(f"_{c}") for c in ("pos", "ta", "gap", "f")]).filter("_pos = pos + 1")
    return d.select("negative", "pos", F.abs(F.col("_ta") - F.col("ta")).alias("step"), (F.abs(F.col("_f") - F.col("f")) * 0.5 * (F.col("gap") + F.col("_gap"))).alias("step_sf"))


def run_edges(runs: DataFrame, scores: DataFrame) -> DataFrame:
    """(patch, run, pos, score, ref): edge scores(patch, axis, row, col, score, ref) from each position of a run to the next.

    runs(patch, row, col, axis, run, pos), as :func:`stacks.positions` makes them.
    """
    inner = runs.withColumn("_next", F.lead("pos").over(W.partitionBy("patch", "run").orderBy("pos"))).filter("_next IS NOT NULL")
    return inner.select("patch", "axis", "row", "col", "run", "pos").join(scores, ["patch", "axis", "row", "col"]).select("patch", "run", "pos", "score", "ref")


#: Fixed values of the published protocol: an abrupt step in voxels, the planted and the candidate edge score.
ABRUPT, PLANTED, CANDIDATE = 6.0, 0.5, 0.25


def event_rollup(members: DataFrame, event="event", keep: Column | None = None, abrupt: float = ABRUPT, planted: float = PLANTED, candidate: float = CANDIDATE) -> DataFrame:
    """Members of an event to one row: medians and extremes of :func:`transition_metrics` and seven flags.

    members(event, the columns of transition_metrics with edges).  Only reproduced members that meet ``keep`` are measured, all are
    counted; an event without a measured member has no row.  A flag is NULL where nothing it needs was measured.
    An event has few members, so its medians are exact.
    """
    used = F.col("reproduced") & (F.lit(True) if keep is None else F.coalesce(keep, F.lit(False)))
    of = lambda c: F.when(used, F.col(c))
    median = lambda c: F.percentile(of(c), 0.5)
    e = members.groupBy(event).agg(
        F.count(F.lit(1)).alias("n_members"), F.count_if(used).alias("n_reproduced"), median("width_mm").alias("width_median"), F.min(of("width_mm")).alias("width_min"),
        median("n_steps").alias("steps_median"), F.min(of("n_steps")).alias("steps_min"),
        *[F.max(of(c)).alias(c) for c in ("max_step", "max_step_sf", "max_rate", "max_rate_sf", "zone_score", "zone_voxels")],
        *[median(c).alias(f"{c}_median") for c in ("max_step", "max_step_sf", "total_offset", "total_sf", "gap_a", "gap_b", "spacing_b")],
        F.coalesce(F.sum(of("n_step_measurements")), F.lit(0)).alias("n_step_measurements"), F.coalesce(F.bool_or(of("partial")), F.lit(False)).alias("any_partial"))
    flags = {
        "abrupt_planned": F.col("max_step") >= abrupt, "abrupt_sf": F.col("max_step_sf") >= abrupt, "abrupt_median_planned": F.col("max_step_median") >= abrupt,
        "abrupt_median_sf": F.col("max_step_sf_median") >= abrupt, "one_step": F.col("steps_median") <= 1, "planted_level": F.col("zone_score") >= planted,
        "candidate": F.col("zone_score") >= candidate}
    return e.filter("n_reproduced > 0").select("*", *[c.alias(n) for n, c in flags.items()])


def layer_spacing(layers: DataFrame, reach: float = 80.0, probs=(0.1, 0.5, 0.9)) -> DataFrame:
    """One row (n, p0, p1, …): percentiles of the distance from a layer's vertices to the tangent planes of the next layer.

    layers(layer, row, col, x, y, z, nx, ny, nz) with consecutive layer numbers.  Every vertex is looked up; it counts if its
    nearest vertex of the next layer is closer than ``reach``.
    """
    at = layers.select((F.col("layer") + 1).alias("layer"), F.col("row").alias("_row"), F.col("col").alias("_col"), "x", "y", "z")
    near = k_nearest_within(at, layers, 1, reach, ids=["layer", "_row", "_col"], order=["row", "col"], keys=["layer"]).filter(F.col("dist") < reach)
    gap = F.abs(sum((F.col(f"r_{a}") - F.col(a)) * F.col(f"n{a}") for a in ("x", "y", "z")))
    return exact_percentiles(near.select(gap.alias("gap")), "gap", list(probs)).withColumn("n", F.coalesce("n", F.lit(0)))
