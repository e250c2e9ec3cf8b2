"""Content hashes of file sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_digests(spark: SparkSession, path, base: str, pattern: str | None = None) -> DataFrame:
    """(file, bytes, sha256) of every file under ``path`` (one or several); ``file`` is its path below ``base``.

    Files are read by Spark's binary source, each in the task that hashes it (up to 2 GB, the limit of that source).
    Spark's sources pass over empty files, so these have no row.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    root = base.rstrip("/") + "/"
    below = F.substring_index(F.col("path"), root, -1)
    return reader.load(path).select(below.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def file_set_hash(digests: DataFrame) -> DataFrame:
    """(files, bytes, sha256) of a set of digests, in one row; it doesn't depend on the order in which files are listed.

    A tree in two levels: files fall into 4,096 groups by their names' hash, a group's hash covers its ``name:hash`` lines in order
    of names, the set's hash the groups' lines.
    """
    line = F.struct("file", F.concat_ws(":", "file", "sha256").alias("line"))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda r: r["line"]), "\n")
    group = F.substring(F.md5("file"), 1, 3)
    parts = digests.groupBy(group.alias("_g")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sha2(listed(line), 256).alias("_h"))
    whole = F.struct(F.col("_g").alias("file"), F.concat_ws(":", "_g", "_h").alias("line"))
    return parts.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.sha2(listed(whole), 256).alias("sha256"))
