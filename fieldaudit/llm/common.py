"""Helpers shared by the operators: shared folders, ordered blocks, group values that survive hot keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Rows that one ordered block should hold, and the most blocks.
BLOCK_ROWS, BLOCKS = 1000, 1024


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under ``spark.checkpoint.dir``, which driver and executors share.

    The setting is read from the session; local sessions without it get a scratch folder, others are refused.
    """
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: what follows doesn't compute it anew."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ordered_blocks(df: DataFrame, key: str, rows: int | None = None) -> tuple[Column, int]:
    """A column with the index of each row's block, ascending by the integer ``key``, and the number of blocks.

    The cuts are quantiles of the keys themselves, so no block is empty; null keys belong to block 0.  What the
    driver receives is at most ``BLOCKS`` numbers; blocks grow with the table beyond ``BLOCKS * BLOCK_ROWS`` rows.
    """
    n = rows if rows is not None else df.count()
    want = int(max(1, min(BLOCKS, n // BLOCK_ROWS)))
    if want == 1:
        return F.lit(0), 1
    row = df.agg(F.percentile_approx(F.col(key).cast("long"), [i / want for i in range(1, want)], 20 * want).alias("c")).first()
    cuts = sorted(set(row["c"] or []))
    low = df.agg(F.min(F.col(key).cast("long")).alias("m")).first()["m"]
    cuts = [c for c in cuts if low is not None and c > low]
    if not cuts:
        return F.lit(0), 1
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key).cast("long")))
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(at), len(cuts) + 1


def text_slices(batches, column: int, most_bytes: int = 5 << 20):
    """Record batches cut so that the texts of one piece stay near ``most_bytes``; rows and order are kept."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0), np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < len(size):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


def giving_back(f):
    """``f`` over record batches, and the worker's free memory goes back to the system when the task ends.

    Spark reuses Python workers: what Arrow and malloc hold on to would add up over the stages of a job.
    """

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release_memory()

    return run


def release_memory() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: it has no such call
        pass
