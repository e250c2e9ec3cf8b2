"""Why an event was missed: the scores and candidate components around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import XYZ
from ..session import cols
from .components import edge_flags_to_cells, grid_components
from .grid import cell_centres
from .spatial import ball_max

#: The classes of the published protocol.
BELOW, INCOHERENT, COHERENT = "i_subthreshold", "ii_incoherent", "iii_coherent"


def candidate_cells(edges: DataFrame, vertices: DataFrame, threshold: float, by=("patch",)) -> DataFrame:
    """Cells next to an edge of at least ``threshold``: (by, row, col, x, y, z, component_size).

    edges(by, axis row or col, row, col, score).  Only cells with four valid corners count; the size is that of
    the 8-connected component of such cells.
    """
    by = list(by)
    flagged = edge_flags_to_cells(edges.filter(F.col("score") >= threshold), by)
    whole = cell_centres(flagged, vertices, by).filter("corners = 4").drop("corners")
    sizes = grid_components(whole, by).drop("component")
    return whole.join(sizes, cols(by, "row", "col"))


def miss_classes(points: DataFrame, edges: DataFrame, cells: DataFrame, r: float, threshold: float, min_size: int, ids=("event_id",), keys=("patch",)) -> DataFrame:
    """(ids, max_score, max_component, cls): best edge score and largest candidate component within ``r`` of an event.

    points(ids, keys, x, y, z) may hold several points of an event; edges(keys, x, y, z, score) are edge midpoints, cells as
    :func:`candidate_cells` makes them.  An event is below the threshold if no edge around it reaches it (or there is none),
    else incoherent if no component around it has ``min_size`` cells, else coherent.
    """
    ids, keys = list(ids), list(keys)
    queries = points.select(*cols(ids, keys, XYZ))
    score = ball_max(queries, edges, "score", r, ids, keys).withColumnRenamed("score", "max_score")
    size = ball_max(queries, cells, "component_size", r, ids, keys).withColumnRenamed("component_size", "max_component")
    out = queries.select(*ids).distinct().join(score, ids, "left").join(size, ids, "left").withColumn("max_component", F.coalesce("max_component", F.lit(0)))
    below = F.col("max_score").isNull() | (F.col("max_score") < threshold)
    return out.withColumn("cls", F.when(below, BELOW).when(F.col("max_component") < min_size, INCOHERENT).otherwise(COHERENT))
