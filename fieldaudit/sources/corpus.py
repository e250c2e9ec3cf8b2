"""Labelled corpus: reading, checks against the vertex grid, benchmark tables, writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.geometry import VOXEL_MM, XYZ, valid_vertex, voxels
from ..functions.text import coordinate_key
from ..operators import sequence as Q
from ..plans.score import Benchmark
from ..session import cols

# The corpus file rounds coordinates to 0.1 voxel and lengths to 0.01 mm.
XYZ_TOLERANCE = 0.05 + 1e-6
MM_TOLERANCE = 0.005 + 1e-6


class CorpusError(ValueError):
    """The corpus and the geometry cannot be scored as given."""


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per corpus document."""
    return spark.read.schema(schema.CORPUS).option("mode", "FAILFAST").json(path, multiLine=True)


def events_of(doc: DataFrame) -> DataFrame:
    """(event_id, patch, subset, status, xyz, delta_signs, transitions); event_id is the position in the file."""
    e = doc.select(F.posexplode("events").alias("event_id", "e"))
    return e.select(F.col("event_id").cast("long").alias("event_id"), "e.*")


def negatives_of(doc: DataFrame) -> DataFrame:
    n = doc.select(F.posexplode("negatives").alias("run_id", "n"))
    return n.select(
        F.col("run_id").cast("long").alias("run_id"), "n.patch", "n.status", "n.axis",
        *[F.col(f"n.{f}")[i].alias(a) for f, i, a in (("rc0", 0, "r0"), ("rc0", 1, "c0"), ("rc1", 0, "r1"), ("rc1", 1, "c1"))],
        "n.len_mm", "n.xyz0", "n.xyz1",
    )


def structural_violations(events: DataFrame, runs: DataFrame) -> DataFrame:
    """(kind, id, reason): missing fields and events without transitions."""
    c = F.col
    ev = F.array(
        F.when(c("patch").isNull(), "no patch"), F.when(c("status").isNull(), "no status"),
        F.when(c("transitions").isNull() | (F.size("transitions") == 0), "no transitions"),
        F.when(F.exists(F.coalesce("transitions", F.array().cast(f"array<{schema.TRANSITION}>")), lambda t: t.rc_a.isNull() | t.rc_b.isNull()),
               "transition without rc_a or rc_b"),
    )
    run = F.array(
        F.when(c("patch").isNull(), "no patch"), F.when(c("status").isNull(), "no status"),
        F.when(c("axis").isNull(), "no axis"), F.when(c("r0").isNull() | c("c0").isNull(), "no rc0"),
        F.when(c("r1").isNull() | c("c1").isNull(), "no rc1"),
    )

    def out(df, kind, key, notes):
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.explode(F.filter(notes, lambda n: n.isNotNull())).alias("reason"))

    return out(events, "event", "event_id", ev).unionByName(out(runs, "run", "run_id", run))


def transition_vertices(events: DataFrame, vertices: DataFrame) -> DataFrame:
    """(event_id, patch, ord, ax, ay, az, bx, by, bz): both vertices of every transition, NULL where invalid."""
    t = events.select("event_id", "patch", F.posexplode("transitions").alias("ord", "t"))
    ends = t.select("event_id", "patch", "ord", F.explode(F.expr(
        "array(struct('a' as side, t.rc_a[0] as row, t.rc_a[1] as col), struct('b' as side, t.rc_b[0] as row, t.rc_b[1] as col))")).alias("v"))
    ends = ends.select("event_id", "patch", "ord", "v.side", "v.row", "v.col")
    v = vertices.filter("valid").select("patch", "row", "col", *XYZ)
    got = ends.join(v, ["patch", "row", "col"], "left")
    one = [F.max(F.when(F.col("side") == s, F.col(a))).alias(f"{s}{a}") for s in "ab" for a in XYZ]
    return got.groupBy("event_id", "patch", "ord").agg(*one)


def event_points(events: DataFrame, vertices: DataFrame) -> DataFrame:
    """(event_id, patch, pt_ord, x, y, z): transition midpoints, then their mean (the centre, pt_ord = -1)."""
    t = transition_vertices(events, vertices)
    mid = t.select("event_id", "patch", F.col("ord").alias("pt_ord"), *[((F.col(f"a{a}") + F.col(f"b{a}")) / 2).alias(a) for a in XYZ])
    centre = mid.groupBy("event_id", "patch").agg(F.lit(-1).alias("pt_ord"), *[F.avg(a).alias(a) for a in XYZ])
    return mid.unionByName(centre)


def run_vertices(runs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(run_id, patch, ord, row, col, x, y, z), coordinates NULL where the vertex is missing or invalid."""
    v = vertices.filter("valid").select("patch", "row", "col", *XYZ)
    return Q.expand_runs(runs).join(v, ["patch", "row", "col"], "left")


def geometry_violations(events: DataFrame, runs: DataFrame, vertices: DataFrame, mm: float) -> DataFrame:
    """(kind, id, reason): malformed runs, vertices outside or invalid, and stored values that disagree with the grid."""
    tv = transition_vertices(events, vertices)
    bad_t = tv.filter("ax is null or bx is null").select(
        F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.lit("vertex outside the grid or invalid").alias("reason")).distinct()
    centre = event_points(events, vertices).filter("pt_ord = -1").join(events.select("event_id", "xyz"), "event_id")
    off = F.greatest(*[F.abs(F.col(a) - F.col("xyz")[i]) for i, a in enumerate(XYZ)])
    bad_c = centre.filter(off > XYZ_TOLERANCE).select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.lit("centre differs from the grid").alias("reason"))
    bad_r = runs.select(F.lit("run").alias("kind"), F.col("run_id").alias("id"), Q.run_problem().alias("reason")).filter("reason is not null")
    rv = run_vertices(runs, vertices)
    bad_v = rv.filter("x is null").select(F.lit("run").alias("kind"), F.col("run_id").alias("id"), F.lit("vertex outside the grid or invalid").alias("reason")).distinct()
    length = Q.arc_length(rv.filter("x is not null"), ["run_id", "patch"], ["ord"], block=F.floor(F.col("ord") / 4096), unit=mm)
    bad_l = length.join(runs.select("run_id", "len_mm"), "run_id").filter(F.abs(F.col("length") - F.col("len_mm")) > MM_TOLERANCE).select(
        F.lit("run").alias("kind"), F.col("run_id").alias("id"), F.lit("length differs from the grid").alias("reason"))
    ends = runs.select("run_id", "patch", F.explode(F.expr(
        "array(struct(r0 as row, c0 as col, xyz0 as xyz), struct(r1 as row, c1 as col, xyz1 as xyz))")).alias("e")).select("run_id", "patch", "e.row", "e.col", "e.xyz")
    at = ends.join(vertices.filter("valid").select("patch", "row", "col", *XYZ), ["patch", "row", "col"])
    bad_e = at.filter(off > XYZ_TOLERANCE).select(F.lit("run").alias("kind"), F.col("run_id").alias("id"), F.lit("end differs from the grid").alias("reason")).distinct()
    return bad_t.unionByName(bad_c).unionByName(bad_r).unionByName(bad_v).unionByName(bad_l).unionByName(bad_e)


def fingerprint(vertices: DataFrame) -> DataFrame:
    """One row ``sha``: content hash over all patches.

    Every grid row is hashed on its own, rows are combined per patch and patches in name order, so no task
    ever concatenates a whole patch's vertices.  Coordinates enter in millionths, as integers.
    """
    whole = [F.round(F.col(a) * 1_000_000).cast("long").cast("string") for a in XYZ]
    cell = F.concat_ws(",", "col", F.when(F.col("valid"), F.concat_ws(",", *whole)).otherwise("-"))
    row = vertices.groupBy("patch", "row").agg(F.sha2(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("col", cell.alias("c")))), lambda s: s.c)), 256).alias("h"))
    patch = row.groupBy("patch").agg(F.sha2(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("row", "h"))), lambda s: F.concat_ws(":", s.row, s.h))), 256).alias("h"))
    # patches are combined through hash blocks, so the last step sees 4,096 rows at most
    block = patch.groupBy(F.substring(F.md5(F.col("patch").cast("string")), 1, 3).alias("b")).agg(
        F.sha2(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct(F.col("patch").cast("string").alias("p"), "h"))), lambda s: F.concat_ws(":", s.p, s.h))), 256).alias("h"))
    return block.agg(F.sha2(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda s: F.concat_ws(":", s.b, s.h))), 256).alias("sha"))


def read_vertices(spark: SparkSession, path: str, mask: DataFrame | None = None, stride: tuple[int, int] = (1, 1)) -> DataFrame:
    """Vertex table (patch, row, col, x, y, z) from Parquet with the validity rule applied.

    ``mask`` (patch, row, col, value) may be ``stride`` times as fine as the grid.
    """
    v = spark.read.parquet(path)
    value = None
    if mask is not None:
        m = mask.selectExpr("patch", f"row div {stride[0]} as row", f"col div {stride[1]} as col", "value as _mask", "row as _mr", "col as _mc")
        m = m.filter(f"_mr % {stride[0]} = 0 and _mc % {stride[1]} = 0").drop("_mr", "_mc")
        v, value = v.join(m, ["patch", "row", "col"], "left"), F.col("_mask")
    ok = valid_vertex(F.col("x"), F.col("y"), F.col("z"), value)
    return v.select("patch", "row", "col", *[F.when(ok, F.col(a)).alias(a) for a in XYZ], ok.alias("valid"))


def build_benchmark(events: DataFrame, runs: DataFrame, vertices: DataFrame, voxel_mm: float = VOXEL_MM, defaults: dict | None = None) -> Benchmark:
    """Benchmark tables from labelled tables and a vertex grid (patches pruned by a semi-join)."""
    mm = voxels(1.0, voxel_mm)
    named = events.select("patch").union(runs.select("patch")).distinct()
    grid = vertices.join(named, "patch", "left_semi")
    rv = run_vertices(runs, grid)
    length = Q.arc_length(rv, ["run_id", "patch"], ["ord"], block=F.floor(F.col("ord") / 4096), unit=mm)
    return Benchmark(
        events=events.drop("xyz", "transitions"), event_points=event_points(events, grid).drop("pt_ord"),
        runs=runs.select("run_id", "patch", "status"), run_lengths=length.select("run_id", "patch", "length"),
        run_vertices=rv.select("run_id", "patch", *XYZ), surface=grid.filter("valid").select("patch", *XYZ),
        voxel_mm=voxel_mm, defaults=defaults or {},
    )


def load_benchmark(spark: SparkSession, corpus_path: str, vertices: DataFrame, check: bool = True) -> Benchmark:
    """Read a corpus document and build its benchmark; raises :class:`CorpusError` on any violation.

    ``meta["geometry_match"]`` says whether the stored content hash equals :func:`fingerprint` of the scored patches (None
    without a stored hash or without ``check``); a difference is a warning of the board, not a violation.
    """
    doc = read_corpus(spark, corpus_path)
    head = doc.select("voxel_mm", "scoring", "scroll", "frame", "geometry_sha256").first()  # scalars only
    voxel_mm = head["voxel_mm"] or VOXEL_MM
    events, runs = events_of(doc), negatives_of(doc)
    scored = events.filter("status = 'confirmed'").select("patch").union(runs.filter("status = 'confirmed'").select("patch")).distinct()
    if check:
        _raise(structural_violations(events, runs))
        ev, rn = events.join(scored, "patch", "left_semi"), runs.join(scored, "patch", "left_semi")
        missing = scored.join(vertices.select("patch").distinct(), "patch", "left_anti")
        _raise(missing.select(F.lit("patch").alias("kind"), F.col("patch").alias("id"), F.lit("no geometry").alias("reason")))
        _raise(geometry_violations(ev, rn, vertices, voxels(1.0, voxel_mm)))
    scoring = {k: v for k, v in head["scoring"].asDict().items() if v is not None} if head["scoring"] else {}
    bench = build_benchmark(events, runs, vertices, voxel_mm, scoring)
    same = None
    if check and head["geometry_sha256"]:
        same = fingerprint(vertices.join(scored, "patch", "left_semi")).first()["sha"] == head["geometry_sha256"]
    bench.meta = {"scroll": head["scroll"], "frame": head["frame"], "geometry_sha256": head["geometry_sha256"], "geometry_match": same}
    return bench


def _raise(violations: DataFrame) -> None:
    sample = violations.limit(20).collect()
    if sample:
        raise CorpusError("; ".join(f"{v['kind']} {v['id']}: {v['reason']}" for v in sample))


def corpus_document(events: DataFrame, members: DataFrame) -> DataFrame:
    """Publishable event rows: coordinates at 0.1, lengths at 0.01, nested transitions in order.

    events(event_id, patch, status, x, y, z), members(event_id, ord, axis, ra, ca, rb, cb, len_a, len_b, delta).
    An event has few members, so the nested list stays short.
    """
    tr = F.struct(
        "axis", F.array("ra", "ca").alias("rc_a"), F.array("rb", "cb").alias("rc_b"),
        F.round("len_a", 2).alias("len_a_mm"), F.round("len_b", 2).alias("len_b_mm"),
    )
    nested = members.groupBy("event_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", tr.alias("t")))), lambda s: s.t).alias("transitions"),
        F.array_sort(F.collect_set("delta")).alias("delta_signs"),
    )
    return events.join(nested, "event_id").select(
        "event_id", "patch", "status", F.array(*[F.round(a, 1) for a in XYZ]).alias("xyz"), "delta_signs", "transitions")


def pool(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of corpora with a ``subset`` tag."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn("subset", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def override_status(events: DataFrame, verdicts: DataFrame, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """Replace ``status`` by a second verdict joined by position: (events, violations).

    The i-th verdict of a patch must sit at the place of its i-th event; one-sided or displaced rows are
    violations.  events(patch, i, x, y, z, status), verdicts(patch, i, x, y, z, status_new).
    """
    v = verdicts.select("patch", "i", *[F.col(a).alias(f"v{a}") for a in XYZ], "status_new")
    j = events.join(v, ["patch", "i"], "full")
    d = F.sqrt(sum(((F.col(a) - F.col(f"v{a}")) * (F.col(a) - F.col(f"v{a}")) for a in XYZ), F.lit(0.0)))
    reason = F.when(F.col("vx").isNull(), "no verdict").when(F.col("x").isNull(), "no event").when(d > tolerance, "displaced")
    bad = j.select("patch", "i", reason.alias("reason")).filter("reason is not null")
    good = j.filter(reason.isNull()).withColumn("status", F.coalesce("status_new", "status"))
    return good.drop("status_new", *[f"v{a}" for a in XYZ]), bad


def strata_of(doc: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(strata (patch, key, stratum), one row ``skipped``) from exploration results; unclassified events are skipped."""
    e = doc.select(F.explode("results.per_event").alias("e")).select("e.*")
    return build_strata(e, F.col("abrupt_primary_sf"))


def build_strata(events: DataFrame, flag) -> tuple[DataFrame, DataFrame]:
    d = events.withColumn("_flag", flag)
    xyz = [F.col("xyz")[i] for i in range(3)]
    strata = d.filter("_flag is not null").select(
        "patch", coordinate_key(F.col("patch"), *xyz).alias("key"), F.when(F.col("_flag"), "abrupt").otherwise("gradual").alias("stratum"))
    return strata, d.agg(F.count_if(F.col("_flag").isNull()).alias("skipped"))


def read_strata(spark: SparkSession, path: str) -> DataFrame:
    """(key, stratum) from a JSON object ``patch|x,y,z`` -> name."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "stratum"))


def annotation_points(docs: dict[str, DataFrame]) -> DataFrame:
    """Annotated points (file, coll, point_id, x, y, z, w) of the three annotation files.

    In ``same_windings`` every winding is 0; elsewhere it is as given, possibly NULL.
    """
    out = None
    for name, doc in docs.items():
        c = doc.select(F.explode("collections").alias("cid", "c")).select("cid", F.explode("c.points").alias("pid", "p"))
        w = F.lit(0.0) if name == "same_windings" else F.col("p.wind_a")
        part = c.select(
            F.lit(name).alias("file"), F.concat_ws(":", F.lit(name), "cid").alias("coll"), F.col("pid").alias("point_id"),
            *[F.col("p.p")[i].alias(a) for i, a in enumerate(XYZ)], w.cast("double").alias("w"))
        out = part if out is None else out.unionByName(part)
    return out


def unfinished(work: DataFrame, done: DataFrame, keys) -> DataFrame:
    """Resume: work items without a finished output row."""
    return work.join(done.select(*cols(keys)).distinct(), cols(keys), "left_anti")



def read_metadata(spark: SparkSession, path) -> DataFrame:
    """(patch, mode, seed, source, lineage, problem): the metadata objects of patches, one JSON object per file.

    Fixed values: the names of the file and of its fields.

    ``path`` is a folder of ``<patch>/meta.json`` files, or a list of such.  Fields that an object lacks are NULL, fields that
    the schema doesn't name are ignored, and an object that doesn't parse keeps its row with a ``problem``.  Objects have a
    few hundred bytes, so one is read whole.
    """
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "meta.json").text(paths, wholetext=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return metadata_rows(raw.select(F.regexp_replace(name, "%20", " ").alias("patch"), "value"))


def metadata_rows(objects: DataFrame) -> DataFrame:
    """:func:`read_metadata` over rows (patch, value) with the text of one object each."""
    from ..functions.text import lineage

    fields = "vc_gsfs_mode string, seed long, source_tifxyz string, _corrupt_record string"
    d = objects.withColumn("_o", F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    problem = F.when(F.col("value").isNull() | F.col("_o").isNull() | F.col("_o._corrupt_record").isNotNull(), F.lit("load_error"))
    return d.select(
        "patch", F.col("_o.vc_gsfs_mode").alias("mode"), F.col("_o.seed").alias("seed"), F.col("_o.source_tifxyz").alias("source"),
        lineage(F.col("patch"), F.col("_o.source_tifxyz")).alias("lineage"), problem.alias("problem"))
