"""Listing reconciliation and manifests, and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Files of one patch.
REQUIRED = ("x.tif", "y.tif", "z.tif")
OPTIONAL = ("mask.tif",)


def wanted(patches: DataFrame) -> DataFrame:
    """(patch, file, required) for every patch."""
    f = F.explode(F.array(*[F.struct(F.lit(n).alias("file"), F.lit(n in REQUIRED).alias("required")) for n in REQUIRED + OPTIONAL]))
    return patches.select("patch", f.alias("f")).select("patch", "f.file", "f.required")


def reconcile(want: DataFrame, remote: DataFrame, local: DataFrame, mirror: DataFrame) -> DataFrame:
    """State of every wanted file: have, copy (from the mirror), get, absent (optional) or lost (required).

    remote, local, mirror: (patch, file, bytes).
    """
    key = ["patch", "file"]
    j = want
    for name, df in (("remote", remote), ("local", local), ("mirror", mirror)):
        # a listing made by an explode counts for Spark as few rows, and would be broadcast whole
        j = j.join(df.select(*key, F.col("bytes").alias(f"{name}_bytes")).hint("merge"), key, "left")
    r = F.col("remote_bytes")
    state = (
        F.when(r.isNull(), F.when(F.col("required"), "lost").otherwise("absent"))
        .when(F.col("local_bytes") == r, "have").when(F.col("mirror_bytes") == r, "copy").otherwise("get")
    )
    return j.select(*key, "required", r.alias("bytes"), state.alias("state"))


def transfer_summary(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def bytes_per_patch(listing: DataFrame) -> DataFrame:
    """Mean of the summed file sizes per patch."""
    return listing.groupBy("patch").agg(F.sum("bytes").alias("b")).agg(F.coalesce(F.avg("b"), F.lit(0.0)).alias("bytes_per_patch"))


def forward_files(listing: DataFrame) -> DataFrame:
    return listing.filter(~T.is_reverse(F.col("file")))


def write_frames(frames: dict[str, DataFrame], path: str, partition_by: str | None = None) -> None:
    """Write result tables as Parquet; with ``partition_by`` only the partitions at hand are replaced."""
    for name, df in frames.items():
        w = df.write.mode("overwrite")
        if partition_by and partition_by in df.columns:
            w = w.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic")
        w.parquet(f"{path}/{name}")


def write_json(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines; ``single`` is for the leaderboard, which has one row per detector."""
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)
