"""Token-ID output: Parquet files with a list column of ids, laid out for selective reads.

Documents are written in ascending id order.  The ids are dictionary encoded; counts and positions have no
dictionary, so the version 2 writer stores them delta encoded.  Row groups and pages are small enough, and
page indexes are written, so a reader of some documents or of the counts alone skips the rest.  Spark's own
commit protocol makes the write survive lost executors.

Every row holds its file's number, the ids before it in the file, and its ids; the position of a document in
the whole corpus is that plus the totals of the files before, which only the count columns are read for.

Null and empty texts hold the end id alone.  Null document ids come first; rows with equal ids are kept, in the
order of their texts.  An empty table gives an empty result.  Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_slices
from .tokens import encoder

_ROWS = "doc_id long, before long, n_tokens long, tokens array<int>"
STORED = "part int, " + _ROWS
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 128 << 10, 1000


def write_tokens(docs: DataFrame, out: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write the files under the folder ``out``."""

    def encode(batches):
        enc, before = encoder(path), 0
        for batch in text_slices(batches, 1):
            ids, at = enc.encode(batch.column(1))
            n = len(at) - 1
            ends = at + np.arange(n + 1)  # with an end id after each text
            closed = np.empty(len(ids) + n, np.int32)
            mask = np.zeros(len(closed), bool)
            mask[ends[1:] - 1] = True
            closed[mask], closed[~mask] = end_id, ids.view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(before + ends[:-1]), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(closed))],
                ["doc_id", "before", "n_tokens", "tokens"])
            before += int(ends[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    coded = ordered.mapInArrow(encode, _ROWS).select(F.spark_partition_id().alias("part"), "*")
    writer = coded.write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
    writer = writer.option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.writer.version", "PARQUET_2_0")
    for column in ("part", "doc_id", "before", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{column}", "false")
    writer.option("parquet.enable.dictionary", "true").parquet(out)


def positions(spark: SparkSession, out: str) -> DataFrame:
    """``(part, base)``: the ids before each file; one row per written file, from the count columns alone."""
    rows = spark.read.schema(STORED).parquet(out)
    size = rows.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return size.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))


def read_tokens(spark: SparkSession, out: str, where=None) -> DataFrame:
    """``(doc_id, start, n_tokens, tokens)``; a filter ``where`` on doc_id reaches the page indexes."""
    rows = spark.read.schema(STORED).parquet(out)
    rows = rows.filter(where) if where is not None else rows
    # one row per written file, far below any broadcast bound: the number of write tasks
    return rows.join(F.broadcast(positions(spark, out)), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "tokens")


def read_span(spark: SparkSession, out: str, first: int, count: int) -> DataFrame:
    """The documents that hold any of the ``count`` ids from position ``first`` of the corpus on."""
    spans = read_tokens(spark, out)
    return spans.filter((F.col("start") < first + count) & (F.col("start") + F.col("n_tokens") > first))


def checksums(tokens: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of stored rows."""

    def crc(batches):
        for b in batches:
            lists = b.column(3)
            at = np.asarray(lists.offsets).tolist()
            raw = np.asarray(lists.values).astype("<i4", copy=False).tobytes()
            found = pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1], at[1:], strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), found], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
