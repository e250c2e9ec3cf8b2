"""Mask and image operators on pixel tables (segment, y, x[, v]); only set pixels are stored for masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cols


def mask_bbox(pixels: DataFrame, by=("segment",), margin: int = 0) -> DataFrame:
    """Half-open bounding box of the set pixels plus a margin clipped at 0, and the pixel count."""
    return pixels.groupBy(*by).agg(
        F.greatest(F.lit(0), F.min("y") - margin).alias("y0"), (F.max("y") + 1 + margin).alias("y1"),
        F.greatest(F.lit(0), F.min("x") - margin).alias("x0"), (F.max("x") + 1 + margin).alias("x1"),
        F.count(F.lit(1)).alias("pixels"),
    )


def overlap(mask: DataFrame, other: DataFrame, by=("segment",)) -> DataFrame:
    """Pixels of ``mask`` that are also set in ``other``, and their share."""
    hit = mask.join(other.select(*by, "y", "x", F.lit(1).alias("_o")), cols(by, "y", "x"), "left")
    return hit.groupBy(*by).agg(
        F.count("_o").alias("overlap"), (F.count("_o") / F.count(F.lit(1))).alias("fraction")
    )


def crop_summary(image: DataFrame, boxes: DataFrame, by=("segment",)) -> DataFrame:
    """Least and greatest value inside each segment's box; the box list stays a join side of its own."""
    d = image.join(boxes.select(*by, "y0", "y1", "x0", "x1"), list(by))
    d = d.filter("y >= y0 and y < y1 and x >= x0 and x < x1")
    return d.groupBy(*by).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.count(F.lit(1)).alias("pixels"))


def _line_erosion(pixels: DataFrame, e: int, by, line: str, pos: str) -> DataFrame:
    w = W.partitionBy(*by, line).orderBy(pos).rangeBetween(-e, e)
    return pixels.withColumn("_n", F.count(F.lit(1)).over(w)).filter(F.col("_n") == 2 * e + 1).drop("_n")


def erode(pixels: DataFrame, e: int, by=("segment",)) -> DataFrame:
    """Set pixels whose whole (2e+1)-square is set; pixels outside the table count as unset.

    Two range frames, one along columns and one along rows of the image.
    """
    return _line_erosion(_line_erosion(pixels.select(*by, "y", "x"), e, by, "x", "y"), e, by, "y", "x")


def mean_pool(image: DataFrame, f: int, by=("segment",), integer: bool = False, low: int = 0, high: int = 255) -> DataFrame:
    """f x f mean pool; blocks with fewer than f*f pixels (the ragged border) are dropped."""
    d = image.groupBy(*by, F.expr(f"y div {f}").alias("y"), F.expr(f"x div {f}").alias("x")).agg(
        F.avg("v").alias("v"), F.count(F.lit(1)).alias("_n")
    ).filter(F.col("_n") == f * f).drop("_n")
    if integer:
        d = d.withColumn("v", F.least(F.greatest(F.rint("v"), F.lit(float(low))), F.lit(float(high))).cast("long"))
    return d


def tile_count(pixels: DataFrame, side: int, frac: float = 0.5, by=("segment",)) -> DataFrame:
    """Tiles of ``side`` pixels, anchored at the corner of the mask, with at least ``frac`` of their area set."""
    box = pixels.groupBy(*by).agg(F.min("y").alias("_y0"), F.min("x").alias("_x0"))
    d = pixels.join(box, list(by))
    tiles = d.groupBy(*by, F.expr(f"(y - _y0) div {side}").alias("_ty"), F.expr(f"(x - _x0) div {side}").alias("_tx")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return tiles.groupBy(*by).agg(F.count_if(F.col("_n") >= frac * side * side).alias("tiles"))


def centred_span(places: DataFrame, vertices: DataFrame, length: int, size: str, by=("patch",)) -> DataFrame:
    """A window of ``length`` steps around ``mid`` on a grid line, shifted inward at the edges and trimmed to
    the valid stretch around ``mid``: adds ``a`` and ``b``.

    places(by, line, mid, <size>); vertices(by, line, pos) of valid vertices.
    """
    d = places.withColumn("_a", F.least(F.greatest(F.lit(0), F.col("mid") - length // 2), F.greatest(F.lit(0), F.col(size) - 1 - length)))
    d = d.withColumn("_b", F.least(F.col(size) - 1, F.col("_a") + length))
    near = d.join(vertices.select(*by, "line", "pos"), cols(by, "line"), "left").filter(
        F.col("pos").isNull() | F.col("pos").between(F.col("_a"), F.col("_b")))
    return near.groupBy(*places.columns, "_a", "_b").agg(
        F.least(F.coalesce(F.min(F.when(F.col("pos") <= F.col("mid"), F.col("pos"))), F.col("mid")), F.col("mid")).alias("a"),
        F.greatest(F.coalesce(F.max(F.when(F.col("pos") >= F.col("mid"), F.col("pos"))), F.col("mid")), F.col("mid")).alias("b"),
    ).drop("_a", "_b")
