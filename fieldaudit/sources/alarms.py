"""Alarm inputs: xyz lists, grid lists, masks and tables, with their checks.

The common form is one row per patch entry ``(detector, patch, points)`` where ``points`` is the JSON text of
the list or NULL.  A NULL entry has no verdict, an empty list is a clean verdict; the verdict table is
therefore built before anything is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import XYZ, finite
from ..plans.score import Alarms
from ..schema import ENTRIES

POINTS = "array<array<string>>"


class AlarmsError(ValueError):
    """The alarm input cannot be read as given."""


def _place(path: Column) -> Column:
    """A path without its scheme and doubled slashes, to compare given and recorded paths."""
    return F.regexp_replace(F.regexp_replace(path, "^[a-z0-9]+:", ""), "/+", "/")


def read_alarm_files(spark: SparkSession, paths, detector=None, names: DataFrame | None = None) -> DataFrame:
    """(detector, declared, patch, points) from JSON objects ``{patch: [[...], ...] | null}``, plain or wrapped
    as ``{"format", "detector", "alarms"}``.  The detector defaults to the file stem; ``names`` (detector, place)
    gives it for each file, and a file may serve several detectors."""
    path = F.col("_metadata.file_path")
    text = spark.read.text(paths, wholetext=True).select("value", F.regexp_extract(path, r"([^/]+?)(\.json)?$", 1).alias("stem"), _place(path).alias("place"))
    top = text.select("stem", "place", F.from_json("value", "map<string,string>").alias("m"))
    wrapped = F.coalesce(F.col("m")["alarms"].startswith("{"), F.lit(False))
    name = F.lit(detector) if detector is not None else F.coalesce(F.when(wrapped, F.col("m")["detector"]), F.col("stem"))
    if names is not None:
        top, name = top.join(names.withColumnRenamed("detector", "_name"), "place"), F.col("_name")
    body = F.when(wrapped, F.from_json(F.col("m")["alarms"], "map<string,string>")).otherwise(F.col("m"))
    return top.select(name.alias("detector"), F.when(wrapped, F.col("m")["format"]).alias("declared"), F.explode(body).alias("patch", "points"))


def parse_points(entries: DataFrame) -> DataFrame:
    """One row per point: (detector, patch, alarm_ord, n, coords array<string>); entries that are no list give none."""
    listed = entries.filter("points is not null").select("detector", "patch", F.from_json("points", POINTS).alias("a"))
    d = listed.select("detector", "patch", F.posexplode("a").alias("alarm_ord", "coords"))
    return d.select("detector", "patch", F.col("alarm_ord").cast("long").alias("alarm_ord"), F.size("coords").alias("n"), "coords")


def detect_format(points: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(detector, format): grid if every point has two numbers, xyz if three or if there is no point; else mixed.

    With ``entries`` every detector of the input has a row, also one with empty lists only.
    """
    found = points.groupBy("detector").agg(
        F.when((F.min("n") == 2) & (F.max("n") == 2), "grid").when((F.min("n") == 3) & (F.max("n") == 3), "xyz").otherwise("mixed").alias("format"))
    if entries is None:
        return found
    every = entries.groupBy("detector").agg(F.max("declared").alias("declared"))
    return every.join(found, "detector", "left").select("detector", F.coalesce("declared", "format", F.lit("xyz")).alias("format"))


def input_violations(entries: DataFrame, fmt: str, shapes: DataFrame | None = None) -> DataFrame:
    """(detector, patch, reason) for every malformed entry: not a list, wrong arity, not a number, not finite,
    not an integer, outside the grid.  ``shapes`` is (patch, height, width)."""
    want = 3 if fmt == "xyz" else 2
    not_list = entries.filter("points is not null and not startswith(ltrim(points), '[')").select("detector", "patch", F.lit("not a list").alias("reason"))
    lists = entries.filter("points is null or startswith(ltrim(points), '[')")
    listed = lists.filter("points is not null").select("detector", "patch", F.from_json("points", "array<string>").alias("a"))
    p = listed.select("detector", "patch", F.explode("a").alias("text"))
    p = p.withColumn("coords", F.when(F.ltrim("text").startswith("["), F.from_json("text", "array<string>")))
    num = F.transform("coords", lambda v: v.try_cast("double"))
    p = p.withColumn("num", num)
    reason = (
        F.when(F.col("coords").isNull(), "not a point").when(F.size("coords") != want, "wrong number of coordinates")
        .when(F.exists("num", lambda v: v.isNull()), "not a number").when(F.exists("num", lambda v: ~finite(v)), "not finite")
    )
    if fmt == "grid":
        reason = reason.when(F.exists("num", lambda v: v != F.rint(v)), "not an integer")
        if shapes is not None:
            p = p.join(shapes, "patch", "left")
            outside = (F.col("num")[0] < 0) | (F.col("num")[0] >= F.col("height")) | (F.col("num")[1] < 0) | (F.col("num")[1] >= F.col("width"))
            reason = reason.when(outside, "outside the grid")
    bad = p.select("detector", "patch", reason.alias("reason")).filter("reason is not null")
    return not_list.unionByName(bad)


def verdicts(entries: DataFrame) -> DataFrame:
    return entries.filter("points is not null").select("detector", "patch").distinct()


def xyz_alarms(entries: DataFrame) -> Alarms:
    p = parse_points(entries)
    pts = p.select("detector", "patch", "alarm_ord", *[F.col("coords")[i].cast("double").alias(a) for i, a in enumerate(XYZ)])
    return Alarms(verdicts(entries), pts, entries.select("detector").distinct())


def on_grid(points: DataFrame, vertices: DataFrame, scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grid alarms (detector, patch, alarm_ord, row, col) -> (alarms with coordinates, (detector, dropped_invalid)).

    Alarms outside the ``scored`` patches (patch) are left out before the lookup and never counted as invalid.
    """
    v = vertices.filter("valid").select("patch", "row", "col", *XYZ)
    j = points.join(scored.select("patch").distinct(), "patch", "left_semi").join(v, ["patch", "row", "col"], "left")
    dropped = j.groupBy("detector").agg(F.count_if(F.col("x").isNull()).alias("dropped_invalid"))
    return j.filter("x is not null").select("detector", "patch", "alarm_ord", *XYZ), dropped


def grid_alarms(entries: DataFrame, vertices: DataFrame, scored: DataFrame) -> tuple[Alarms, DataFrame]:
    p = parse_points(entries)
    rc = p.select("detector", "patch", "alarm_ord", *[F.col("coords")[i].cast("double").cast("long").alias(a) for i, a in enumerate(("row", "col"))])
    pts, dropped = on_grid(rc, vertices, scored)
    return Alarms(verdicts(entries), pts, entries.select("detector").distinct()), dropped


def mask_alarms(masks: DataFrame, mask_patches: DataFrame, vertices: DataFrame, scored: DataFrame) -> tuple[Alarms, DataFrame]:
    """Masks as a long table of set vertices (detector, patch, row, col); ``mask_patches`` (detector, patch)
    lists every patch with a mask, also those without a set vertex.  The order of a mask is row-major,
    packed into one number, so no window is needed.  Set vertices outside the ``scored`` patches are left out, uncounted."""
    rc = masks.withColumn("alarm_ord", F.shiftleft(F.col("row").cast("long"), 32) + F.col("col"))
    pts, dropped = on_grid(rc, vertices, scored)
    return Alarms(mask_patches.distinct(), pts), dropped


def load_alarms(spark: SparkSession, path: str, bench_vertices: DataFrame | None = None, fmt: str = "auto", detector=None, scored: DataFrame | None = None) -> tuple[Alarms, DataFrame | None]:
    """Read, check and convert alarm files; raises :class:`AlarmsError` on malformed input.

    Each detector has its own format: the one it declares, else the one its points show.  Grid alarms need
    ``bench_vertices`` and the ``scored`` patches, for example ``Benchmark.scored_patches()``.
    """
    return convert_alarms(read_alarm_files(spark, path, detector), bench_vertices, fmt, scored)


def convert_alarms(entries: DataFrame, bench_vertices: DataFrame | None = None, fmt: str = "auto", scored: DataFrame | None = None) -> tuple[Alarms, DataFrame | None]:
    """Check the entries of alarm files and convert them, each detector by its own format."""
    declared = {r["declared"] for r in entries.select("declared").distinct().limit(3).collect()} - {None}
    if declared - {"xyz", "grid"}:
        raise AlarmsError(f"format must be xyz or grid, got {sorted(declared)}")
    if fmt != "auto" and declared - {fmt}:
        raise AlarmsError(f"the input declares {sorted(declared)}, not {fmt}")
    if fmt == "auto":
        kind = detect_format(parse_points(entries), entries)
    else:
        kind = entries.select("detector").distinct().withColumn("format", F.lit(fmt))
    kinds = {r["format"] for r in kind.select("format").distinct().collect()}  # at most three values
    if "mixed" in kinds:
        raise AlarmsError("alarms of one detector mix [x, y, z] and [row, col]")
    shapes = None
    if "grid" in kinds and bench_vertices is not None:
        shapes = bench_vertices.groupBy("patch").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    parts = {k: entries.join(kind.filter(F.col("format") == k).select("detector"), "detector", "left_semi") for k in sorted(kinds)}
    for k, part in parts.items():
        bad = input_violations(part, k, shapes).limit(5).collect()
        if bad:
            raise AlarmsError("; ".join(f"{b['patch']}: {b['reason']}" for b in bad))
    if "grid" not in parts:
        return xyz_alarms(entries), None
    if bench_vertices is None or scored is None:
        raise AlarmsError("grid alarms need the vertices and the scored patches")
    grid, dropped = grid_alarms(parts["grid"], bench_vertices, scored)
    if "xyz" not in parts:
        return grid, dropped
    xyz = xyz_alarms(parts["xyz"])
    return Alarms(verdicts(entries), grid.alarms.unionByName(xyz.alarms), entries.select("detector").distinct()), dropped


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(entry_ord, detector, alarms, tool, mode, notes) from a JSON list of board entries, in its order."""
    rows = spark.read.schema(ENTRIES).option("multiLine", True).json(path)
    order = rows.select(F.monotonically_increasing_id().alias("entry_ord"), F.col("name").alias("detector"), "alarms", "tool", "mode", "notes")
    return order.fillna({"tool": "", "mode": "default", "notes": ""})


def load_manifest(spark: SparkSession, manifest: DataFrame, bench_vertices: DataFrame | None = None, scored: DataFrame | None = None) -> tuple[Alarms, DataFrame | None]:
    """The alarms of all entries in one plan; every entry has its own file and format."""
    paths = sorted({r["alarms"] for r in manifest.select("alarms").distinct().collect()})  # one row per entry of the board
    names = manifest.select("detector", _place(F.col("alarms")).alias("place"))
    return convert_alarms(read_alarm_files(spark, paths, names=names), bench_vertices, scored=scored)


def from_table(points: DataFrame, verdict: DataFrame) -> Alarms:
    """Alarms already in tables."""
    return Alarms(verdict, points)
