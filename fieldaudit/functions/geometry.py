"""3-D geometry and grid-coordinate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")

# Fixed values of the data format: edge of one voxel in mm, and grid step in voxels.
VOXEL_MM = 0.0096
GRID_STEP = 20.0


def voxels(mm: float, voxel_mm: float = VOXEL_MM) -> float:
    """A length in mm as voxels."""
    return mm * (1.0 / voxel_mm)


def distance(a: list[Column], b: list[Column]) -> Column:
    """Euclidean distance.  Compared by the square root, never by its square, so that a point
    exactly at the radius falls on the same side everywhere."""
    total = None
    for p, q in zip(a, b):
        d = p - q
        total = d * d if total is None else total + d * d
    return F.sqrt(total)


def point(prefix: str = "", names=XYZ) -> list[Column]:
    return [F.col(f"{prefix}{n}") for n in names]


def norm(v: list[Column]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def valid_vertex(x: Column, y: Column, z: Column, mask: Column | None = None) -> Column:
    """A vertex is invalid if any coordinate is -1 or not finite, if all three are <= 0, or if its
    mask value is 0.  A missing mask value (no mask shipped) leaves the vertex valid."""
    bad = (
        ~(finite(x) & finite(y) & finite(z))
        | (x == -1) | (y == -1) | (z == -1)
        | ((x <= 0) & (y <= 0) & (z <= 0))
    )
    ok = ~F.coalesce(bad, F.lit(True))
    return ok if mask is None else ok & F.coalesce(mask != 0, F.lit(True))


def wrap_angle(a: Column) -> Column:
    """Wrap an angle to [-pi, pi)."""
    two_pi = 2 * F.pi()
    shifted = a + F.pi()
    return shifted - two_pi * F.floor(shifted / two_pi) - F.pi()


def angle_about(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    return F.atan2(y - cy, x - cx)


def outward_sign(n: list[Column], x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """+1 or -1 so that ``sign * n`` points away from the centre line (0 counts as +1).

    The length of the radial direction is positive, so it does not change the sign."""
    s = F.signum(n[0] * (x - cx) + n[1] * (y - cy))
    return F.when(s == 0, F.lit(1.0)).otherwise(s)


def distance_to_surface_plane(p: list[Column], v: list[Column], n: list[Column]) -> tuple[Column, Column]:
    """(|normal offset|, lateral offset) of ``p`` from the tangent plane at ``v`` with unit normal ``n``."""
    d = [a - b for a, b in zip(p, v)]
    along = dot(d, n)
    lateral = norm([a - along * b for a, b in zip(d, n)])
    return F.abs(along), lateral


def generation_proxy(p: list[Column], seed: list[Column], step: float = GRID_STEP) -> Column:
    """Distance from the growth seed in grid steps."""
    return distance(p, seed) / F.lit(step)


def series_at(series: Column, generation: Column) -> Column:
    """Value of a 1-based cost series at a generation, the index clipped to the series."""
    idx = F.greatest(F.lit(1), F.least(F.size(series), F.rint(generation).cast("int")))
    return F.element_at(series, idx)


def level_coordinate(c: Column, level: int, base: int = 2) -> Column:
    """A base-level coordinate on pyramid level ``level`` (each level halves the resolution)."""
    return c * F.lit(float(2 ** (base - level)))


def chunk_index(c: Column, edge: int = 128) -> Column:
    return F.floor(c / F.lit(edge)).cast("long")


SEGMENT_POINTS = 20  # fixed value: points per segment


def segment_points(p: Column, q: Column, n: int = SEGMENT_POINTS) -> Column:
    """Evenly spaced points from ``p`` to ``q`` (structs x, y, z), both ends included, as an array of structs."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.struct(*[(p[a] + i / F.lit(float(n - 1)) * (q[a] - p[a])).alias(a) for a in XYZ]),
    )
