"""Incremental scoring.

Recall, false alarms and coverage are sums over patches, so one row per (detector, patch) is the whole state.
A batch scores its own patches and replaces exactly their rows; replaying a batch changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as T
from ..plans.score import pool
from ..session import cut_lineage


def new_batches(live: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(batches, violations) of names in ``live`` that ``known`` does not hold.

    batches: (batch, date, patches), oldest first by batch id; a violation is a new batch that is not newer than
    the newest known one.  The members stay rows of ``live``; listing them in one array is left to the sink.
    """
    stamp = T.batch_id(F.col("patch"))
    cutoff = known.agg(F.max(stamp).alias("cutoff"))
    fresh = live.join(known.select("patch"), "patch", "left_anti").withColumn("batch", stamp)
    b = fresh.filter("batch is not null").groupBy("batch").agg(F.count(F.lit(1)).alias("patches"))
    b = b.withColumn("date", T.stamp_to_date(F.col("batch")))
    bad = b.crossJoin(F.broadcast(cutoff)).filter("batch <= cutoff").select("batch", "cutoff")  # one row
    return b.select("batch", "date", "patches"), bad


def batch_overview(live: DataFrame, known: DataFrame) -> DataFrame:
    """One row: known, live and new counts, new names without a batch, newest known batch."""
    stamp = T.batch_id(F.col("patch"))
    fresh = live.join(known.select("patch"), "patch", "left_anti")
    n = fresh.agg(F.count(F.lit(1)).alias("new_patches"), F.count_if(stamp.isNull()).alias("without_batch"))
    k = known.agg(F.count(F.lit(1)).alias("known_patches"), F.max(stamp).alias("cutoff"))
    return k.crossJoin(live.agg(F.count(F.lit(1)).alias("live_patches"))).crossJoin(n)  # single rows


def merge_scores(state: DataFrame, update: DataFrame) -> DataFrame:
    """State after a batch: the batch's patches replaced, the others kept."""
    touched = update.select("patch").distinct()
    return state.join(touched, "patch", "left_anti").unionByName(update)


def diff_boards(candidate: DataFrame, baseline: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Verdict per detector: not enough data, within noise, or changed beyond noise, for recall and false alarms.

    Both boards carry detector, events, length, event_patches, patches, recall, fa_per_100 and the interval
    columns recall_boot_lo/hi, fa_boot_lo/hi.
    """
    name = F.col("detector")
    if aliases:
        name = F.coalesce(F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])[name], name)
    values = ["recall", "fa_per_100", "recall_boot_lo", "recall_boot_hi", "fa_boot_lo", "fa_boot_hi"]
    base = baseline.select(F.col("detector").alias("_name"), *[F.col(v).alias(f"base_{v}") for v in values])
    j = candidate.withColumn("_name", name).join(base, "_name")

    def overlap(m):
        return S.intervals_overlap(F.col(f"{m}_lo"), F.col(f"{m}_hi"), F.col(f"base_{m}_lo"), F.col(f"base_{m}_hi"))

    return j.select(
        "detector",
        S.change_verdict(F.col("events") > 0, F.col("event_patches"), overlap("recall_boot")).alias("recall_verdict"),
        S.change_verdict(F.col("length") > 0, F.col("patches"), overlap("fa_boot")).alias("fa_verdict"),
        "recall", "base_recall", "fa_per_100", "base_fa_per_100",
    )


def _written_before(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, None if nothing has been written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def rescore_stream(spark: SparkSession, source: str, schema, score_batch, state_path: str, checkpoint: str, bucket=None):
    """Score new files as they arrive and keep the per-patch state; returns the started query.

    ``score_batch(rows) -> patch rows (detector, patch, ...)`` runs the scorer on all rows so far of the patches that a
    micro-batch touches, so rows of one patch add up however they are dealt to micro-batches; a row that comes again
    as it was counts once.  The input rows are
    kept beside the state, a folder per micro-batch, and the state per ``bucket`` of patches with dynamic partition
    overwrite; a replayed micro-batch writes both again as they were.  ``trigger(availableNow)`` makes it a batch
    job with exactly-once bookkeeping.
    """
    inputs, scores = f"{state_path}/inputs", f"{state_path}/scores"

    def upsert(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{inputs}/epoch={epoch}")
        rows = session.read.option("basePath", inputs).parquet(inputs).filter(F.col("epoch") <= epoch)
        touched = rows.filter(F.col("epoch") == epoch).select("patch").distinct()
        scored = score_batch(rows.join(touched, "patch", "left_semi").select(*batch.columns).distinct())
        update = scored.withColumn("bucket", bucket if bucket is not None else F.pmod(F.xxhash64("patch"), F.lit(64)))
        old = _written_before(session, scores)
        if old is not None:
            old = old.join(update.select("bucket").distinct(), "bucket", "left_semi")
            update = merge_scores(old.select(*update.columns), update)
        # the new partitions are read from the files they replace, so they are materialised first
        cut_lineage(update).write.mode("overwrite").partitionBy("bucket").option("partitionOverwriteMode", "dynamic").parquet(scores)

    return (
        spark.readStream.schema(schema).parquet(source)
        .writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def board_from_state(spark: SparkSession, state_path: str) -> DataFrame:
    return pool(spark.read.parquet(f"{state_path}/scores").drop("bucket"))
