"""Labelled training rows: a bounded sample of the rows that may be learned from."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: About as many labelled rows are learned from at most; a documented bound, so the table may be broadcast.
MOST_ROWS = 30_000


def remainder(id_col: str, mod: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(mod))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, mod: int, held_out: int, id_col: str, text_col: str, most: int = MOST_ROWS) -> DataFrame:
    """``(doc_id, text, y, part)`` of labelled rows outside the held-out remainder; about ``most`` rows at most.

    Rows are kept by a hash of their id.  Labels that contradict each other and null labels or ids are left out.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).withColumn("part", remainder("doc_id", mod)).filter(F.col("part") != held_out)
    known = known.groupBy("doc_id", "part").agg(F.min("y").alias("y"), F.max("y").alias("_y")).filter("y = _y").drop("_y")
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < int(most / n * (1 << 20)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(known), "doc_id")


def with_score(docs: DataFrame, score, text_col: str, name: str = "score") -> DataFrame:
    """``docs`` with a last column ``name``; ``score(texts)`` maps an Arrow array of texts to an array of doubles."""
    from .common import giving_back, text_slices

    kept = [c for c in docs.columns if c != name]
    at = kept.index(text_col)

    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    # mapInArrow looks columns up by name and would take a dot for a field, so they have plain names meanwhile
    plain = [f"c{i}" for i in range(len(kept))]

    def add(batches):
        for batch in text_slices(batches, at, 1 << 19):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score(batch.column(at)), pa.float64())], [*plain, "score"])

    fields = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(plain, rows.schema.fields, strict=True))
    return rows.toDF(*plain).mapInArrow(giving_back(add), f"{fields}, score double").toDF(*kept, name)
