"""Session helpers: lineage cuts and size checks."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``.  A local session without that setting
    gets one scratch folder of its own; a cluster session without it is refused, because a folder
    on one machine does not survive the loss of that machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if not hasattr(sc, "_fieldaudit_scratch"):
        sc._fieldaudit_scratch = tempfile.mkdtemp(prefix="spark-fieldaudit-", dir="/tmp")
    return sc._fieldaudit_scratch


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once per application.

    Functions that run in Python workers refer to their modules by name.  Spark serves the archive to
    executors that join later, too.
    """
    sc = spark.sparkContext
    if getattr(sc, "_fieldaudit_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-fieldaudit-"), "fieldaudit.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(root)))
    sc.addPyFile(archive)
    sc._fieldaudit_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and return it with its lineage cut."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def cols(*groups) -> list[str]:
    """Flatten column-name arguments (strings or sequences) into one list without repeats."""
    out: list[str] = []
    for g in groups:
        for c in [g] if isinstance(g, str) else list(g or ()):
            if c not in out:
                out.append(c)
    return out


def same(a: str, b: str, names) -> Column:
    """Null-safe equality of ``names`` between the frames aliased ``a`` and ``b``."""
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return cond


def join_same(left: DataFrame, right: DataFrame, names, how: str = "inner") -> DataFrame:
    """Join on ``names`` where NULL equals NULL; the columns of ``left``, then the others of ``right``."""
    names = list(names)
    renamed = right.select(*[F.col(n).alias(f"_same_{n}") for n in names], *[c for c in right.columns if c not in names])
    cond = F.lit(True)
    for n in names:
        cond = cond & F.col(n).eqNullSafe(F.col(f"_same_{n}"))
    return left.join(renamed, cond, how).drop(*[f"_same_{n}" for n in names])
