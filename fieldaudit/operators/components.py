"""Connected components and spatial clustering.

Components use the alternating large-star / small-star scheme (Kiveris et al., "Connected Components
in MapReduce and Beyond", 2014): a logarithmic number of rounds in practice, every step a grouped
minimum plus an equi-join, no adjacency list in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import XYZ
from ..session import cols, cut_lineage
from .spatial import matches_within


def _checksum(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    star = down.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return star.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """``(node, component)``: the smallest node id of each node's component.

    ``edges`` has columns u, v over the same ids; isolated nodes form their own component.
    """
    e = edges.filter(F.col("u") != F.col("v")).select("u", "v").distinct()
    e = cut_lineage(e)
    state = _checksum(e)
    while state[0] > 0:
        e = cut_lineage(_small_star(_large_star(e)))
        now = _checksum(e)
        if now == state:
            break
        state = now
    found = e.select(F.col("u").alias(node), F.col("v").alias("component"))
    return nodes.select(node).join(found, node, "left").select(
        node, F.coalesce("component", F.col(node)).alias("component")
    )


def components_with_offsets(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """``(node, component, offset)`` for edges (u, v, w) that state offset(u) - offset(v) = w.

    The same star rounds, carrying the offset along every rewritten edge; the smallest node of a
    component has offset 0.  Where statements contradict each other along closed paths, some of them are followed;
    :func:`offset_contradictions` lists the others.
    """
    e = cut_lineage(edges.filter(F.col("u") != F.col("v")).groupBy("u", "v").agg(F.min("w").alias("w")))
    state = _checksum(e)
    while state[0] > 0:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), (-F.col("w")).alias("w")))
        low = both.groupBy("u").agg(F.min(F.struct("v", "w")).alias("_m"))
        low = low.select("u", F.least(F.struct(F.col("_m.v").alias("v"), F.col("_m.w").alias("w")),
                                      F.struct(F.col("u").alias("v"), F.lit(0).cast("long").alias("w"))).alias("_m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(
            F.col("v").alias("u"), F.col("_m.v").alias("v"), (F.col("_m.w") - F.col("w")).alias("w"))
        down = large.select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"),
            F.when(F.col("u") > F.col("v"), F.col("w")).otherwise(-F.col("w")).alias("w"))
        low = down.groupBy("u").agg(F.min(F.struct("v", "w")).alias("_m"))
        star = down.join(low, "u").filter(F.col("v") != F.col("_m.v")).select(
            F.col("v").alias("u"), F.col("_m.v").alias("v"), (F.col("_m.w") - F.col("w")).alias("w"))
        small = star.unionByName(low.select("u", F.col("_m.v").alias("v"), F.col("_m.w").alias("w")))
        e = cut_lineage(small.groupBy("u", "v").agg(F.min("w").alias("w")))
        now = _checksum(e)
        if now == state:
            break
        state = now
    found = e.select(F.col("u").alias(node), F.col("v").alias("component"), F.col("w").alias("offset"))
    return nodes.select(node).join(found, node, "left").select(
        node, F.coalesce("component", F.col(node)).alias("component"), F.coalesce("offset", F.lit(0)).alias("offset")
    )


def offset_contradictions(solved: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """(component, u, v, stated, found): the edges (u, v, w) whose statement differs from the offsets that were found.

    ``solved`` comes from :func:`components_with_offsets` over the same edges.  It is empty exactly if the statements of every
    component agree along all paths.
    """
    at = lambda c: solved.select(F.col(node).alias(c), F.col("component").alias(f"_c{c}"), F.col("offset").alias(f"_o{c}"))
    d = edges.join(at("u"), "u").join(at("v"), "v").withColumn("found", F.col("_ou") - F.col("_ov"))
    return d.filter("found <> w").select(F.col("_cu").alias("component"), "u", "v", F.col("w").alias("stated"), "found")


def spatial_clusters(points: DataFrame, r: float, point_id: str, keys=()) -> DataFrame:
    """Single-linkage clusters (distance strictly below ``r``): adds ``cluster``, the smallest id in it.

    Points that share a box of diagonal below ``r`` are linked without being compared, so a dense
    group costs one node per occupied box; two boxes are linked if any pair between them is close,
    which the box test decides without listing the pairs.
    """
    keys = list(keys)
    side = r / 1.7320508075688772 * (1 - 1e-9)
    box = [F.floor(F.col(a) / F.lit(side)).cast("long").alias(f"_x{i}") for i, a in enumerate(XYZ)]
    names = [f"_x{i}" for i in range(3)]
    boxed = points.select(*cols(keys, point_id, XYZ), *box)
    reps = boxed.groupBy(*keys, *names).agg(F.min(point_id).alias("_rep"))
    tagged = boxed.join(reps, cols(keys, names)).select(*cols(keys, point_id, XYZ), "_rep")
    queries = tagged.select(*keys, F.col("_rep").alias("u"), *XYZ)
    targets = tagged.select(*keys, F.col("_rep").alias("v"), *XYZ)
    edges = matches_within(queries, targets, r, ids=["u"], keys=keys, tags=["v"], strict=True)
    nodes = reps.select(F.col("_rep").alias("node"))
    comp = connected_components(nodes, edges.select("u", "v"))
    member = tagged.select(point_id, F.col("_rep").alias("node")).join(comp, "node")
    return points.join(member.select(point_id, F.col("component").alias("cluster")), point_id)


def grid_components(cells: DataFrame, by=("patch",), min_size: int = 1) -> DataFrame:
    """8-connected components of flagged grid cells ``(by, row, col)`` with at least ``min_size`` cells.

    Adds ``component`` (its first cell) and ``component_size``.
    """
    by = list(by)
    key = F.struct(*by, "row", "col")
    nodes = cells.select(*by, "row", "col").distinct()
    steps = [(0, 1), (1, -1), (1, 0), (1, 1)]  # half of the neighbours; the edges are undirected
    shift = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps]))
    out = nodes.withColumn("u", key).withColumn("_s", shift)
    out = out.select(*by, (F.col("row") + F.col("_s.a")).alias("row"), (F.col("col") + F.col("_s.b")).alias("col"), "u")
    edges = out.join(nodes.withColumn("v", key), cols(by, "row", "col")).select("u", "v")
    comp = connected_components(nodes.select(key.alias("node")), edges)
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("component_size"))
    named = comp.join(size.filter(F.col("component_size") >= min_size), "component")
    return named.select(*[F.col(f"node.{c}").alias(c) for c in cols(by, "row", "col")], "component", "component_size")


def edge_flags_to_cells(edges: DataFrame, by=("patch",)) -> DataFrame:
    """Flagged grid edges ``(by, axis, row, col)`` -> the cells on both sides.

    A horizontal edge (row, col)-(row, col+1) borders the cells (row-1, col) and (row, col); a
    vertical edge (row, col)-(row+1, col) borders (row, col-1) and (row, col).
    """
    other_row = F.when(F.col("axis") == "row", F.col("row") - 1).otherwise(F.col("row"))
    other_col = F.when(F.col("axis") == "row", F.col("col")).otherwise(F.col("col") - 1)
    both = F.explode(F.array(
        F.struct(F.col("row").alias("r"), F.col("col").alias("c")),
        F.struct(other_row.alias("r"), other_col.alias("c")),
    ))
    return edges.withColumn("_b", both).select(
        *by, F.col("_b.r").alias("row"), F.col("_b.c").alias("col")
    ).distinct()
