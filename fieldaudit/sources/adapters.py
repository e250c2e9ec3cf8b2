"""Adapters from native detector outputs to alarm tables.

Input documents are rows ``(patch, part, doc)``: the JSON text of a patch's output, which may come in parts.
Every adapter returns ``(verdict(patch), alarm(patch, alarm_ord, ...))``; the order of an alarm is (part,
position), packed into one number.  ``ADAPTERS`` is the registry; add a function to plug in another tool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..functions.geometry import XYZ

# Fixed values of the native formats.
CUE = "coherent-normal-step"
REVIEW_LEVEL = "review"
ALARM_VERDICTS = ("REVIEW", "WATCH")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(patch, part, doc) from one JSON file per patch, ``<patch>.json``."""
    d = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return d.select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("patch"), F.lit(0).cast("long").alias("part"), F.col("value").alias("doc"))


def read_directories(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(patch, part, doc, file) from one directory per patch; ``part`` is the file's rank by name in it."""
    d = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    f = F.col("_metadata.file_path")
    d = d.select(F.regexp_extract(f, r"([^/]+)/[^/]+$", 1).alias("patch"), F.col("value").alias("doc"), F.col("_metadata.file_name").alias("file"), f.alias("path"))
    rank = F.row_number().over(W.partitionBy("patch").orderBy("file", "path")) - 1
    return d.select("patch", rank.cast("long").alias("part"), "doc", "file")


def _parsed(docs: DataFrame, fields: str) -> DataFrame:
    return docs.select("patch", "part", F.from_json("doc", fields).alias("d"))


#: Added to the part of side data, which follow all reports of a patch.
SIDE_PART = 1 << 30


def _ordinal(pos: Column, side: bool = False) -> Column:
    return (F.shiftleft(F.col("part").cast("long") + (SIDE_PART if side else 0), 32) + pos).alias("alarm_ord")


def _points(parsed: DataFrame, coords: Column) -> DataFrame:
    d = parsed.select("patch", "part", F.posexplode(coords).alias("pos", "c"))
    return d.select("patch", _ordinal(F.col("pos")), *[F.col("c")[i].alias(a) for i, a in enumerate(XYZ)])


def _cells(parsed: DataFrame, coords: Column, side: bool = False) -> DataFrame:
    d = parsed.select("patch", "part", F.posexplode(coords).alias("pos", "c"))
    return d.select("patch", _ordinal(F.col("pos"), side), F.col("c")[0].alias("row"), F.col("c")[1].alias("col"))


def _verdict(docs: DataFrame) -> DataFrame:
    return docs.select("patch").distinct()


def review_cues(docs: DataFrame, side: DataFrame | None = None):
    """Grid alarms of a review report: the example cells of the cue, only if its finding was emitted at the
    review level.  With ``side`` documents the cue's mask is added; a cell counts once, at its first place."""
    d = _parsed(docs, schema.REVIEW)
    emitted = F.coalesce(F.exists("d.findings", lambda f: (f.code == CUE) & (f.level == REVIEW_LEVEL)), F.lit(False))
    examples = F.transform("d.geometry.coherent_normal_steps.candidate_edge_examples", lambda e: e.rc)
    alarms = _cells(d.filter(emitted), F.filter(examples, lambda c: c.isNotNull()))
    if side is not None:
        s = _parsed(side, schema.SIDE)
        alarms = alarms.unionByName(_cells(s, F.col("d.arrays.coherent_normal_step_cells"), side=True))
        alarms = alarms.groupBy("patch", "row", "col").agg(F.min("alarm_ord").alias("alarm_ord")).select("patch", "alarm_ord", "row", "col")
    return _verdict(docs), alarms


def point_collections(docs: DataFrame):
    """Every point of every collection."""
    d = _parsed(docs, schema.COLLECTIONS)
    pts = F.transform(F.flatten(F.transform(F.map_values("d.collections"), lambda c: F.map_values(c.points))), lambda p: p.p)
    return _verdict(docs), _points(d, pts)


def contacts(docs: DataFrame):
    """Both centres of every contact, missing ones skipped."""
    d = _parsed(docs, schema.CONTACTS)
    both = F.flatten(F.transform("d.contacts", lambda c: F.array(c.xyz1, c.xyz2)))
    return _verdict(docs), _points(d, F.filter(both, lambda c: c.isNotNull()))


def flagged_pairs(docs: DataFrame):
    """Both points of every flagged pair."""
    d = _parsed(docs, schema.PAIRS)
    both = F.flatten(F.transform("d.alarms", lambda c: F.array(c.xyz_p, c.xyz_q)))
    return _verdict(docs), _points(d, F.filter(both, lambda c: c.isNotNull()))


def gated_steps(docs: DataFrame):
    """Flagged steps, only of documents whose verdict asks for attention; other verdicts are clean."""
    d = _parsed(docs, schema.STEPS)
    return _verdict(docs), _points(d.filter(F.col("d.verdict").isin(*ALARM_VERDICTS)), F.transform("d.flagged_steps", lambda s: s.xyz))


def changed_edges(edges: DataFrame, after: DataFrame, patches: DataFrame, vertices: DataFrame):
    """Graph edges that touch a patch and appear among the changed edges -> points of that patch's grid.

    edges(run_patch, edge_ord, <edge fields>), after(run_patch, <after fields>) of the run made for
    ``run_patch``.  The end points of an edge are unordered; invalid or outside cells give no alarm.
    """
    def key(pcl: str):
        return [F.col(pcl).alias("k0"), F.least("from_point_id", "to_point_id").alias("k1"), F.greatest("from_point_id", "to_point_id").alias("k2")]

    e = edges.select("*", *key("pcl_id")).filter((F.col("P") == F.col("run_patch")) | (F.col("R") == F.col("run_patch")))
    changed = after.select("run_patch", *key("rel_pcl_id"))
    hit = e.join(changed, ["run_patch", "k0", "k1", "k2"], "left_semi")
    ij = F.when(F.col("P") == F.col("run_patch"), F.col("from_ij")).otherwise(F.col("to_ij"))
    at = hit.select(F.col("run_patch").alias("patch"), F.col("edge_ord").alias("alarm_ord"), F.floor(ij[0]).alias("row"), F.floor(ij[1]).alias("col"))
    pts = at.join(vertices.filter("valid").select("patch", "row", "col", *XYZ), ["patch", "row", "col"])
    return patches, pts.select("patch", "alarm_ord", *XYZ)


ADAPTERS = {
    "review_cues": review_cues, "point_collections": point_collections, "contacts": contacts, "flagged_pairs": flagged_pairs,
    "gated_steps": gated_steps, "changed_edges": changed_edges,
}


def adapt(tool: str, detector: str, *args, **kw):
    """Run an adapter and tag its tables with the detector name."""
    verdict, alarm = ADAPTERS[tool](*args, **kw)
    return verdict.withColumn("detector", F.lit(detector)), alarm.withColumn("detector", F.lit(detector))


def count_mismatches(extracted: DataFrame, reported: DataFrame, keys=("patch",)) -> DataFrame:
    """Keys whose extracted number of alarms differs from the report's own counter ``n_reported``."""
    n = extracted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_extracted"))
    j = reported.join(n, list(keys), "left").withColumn("n_extracted", F.coalesce("n_extracted", F.lit(0)))
    return j.filter("n_extracted <> n_reported")
