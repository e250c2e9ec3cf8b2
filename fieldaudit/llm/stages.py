"""Stages of the corpus pipeline: ``(spark, docs, sf_dir) -> DataFrame``; all but the last keep the columns of ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import decontaminate, ngram_join, packing, quality, toxicity
from .common import table
from .labelled import with_score
from .tokens import vocabulary

#: The thresholds of the classifiers' own queries.
GOOD, TOXIC = 0.3, 0.7


def _free(docs: DataFrame, name: str) -> str:
    """``name`` or a longer one that no column of ``docs`` has, whatever the case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _kept(docs: DataFrame) -> list:
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    ship(spark)
    model, score = quality.fit(docs, table(spark, sf_dir, "labels")), _free(docs, "_score")
    return with_score(docs, model.score, "text", score).filter(F.col(score) >= GOOD).drop(score)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model lets pass."""
    ship(spark)
    model, score = toxicity.fit(docs, table(spark, sf_dir, "labels")), _free(docs, "_score")
    return with_score(docs, model.score, "text", score).filter(F.col(score) < TOXIC).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near copies (five words, similarity 0.8 or more).

    Rows go by their id: of rows that repeat one all stay or, where one of them is a copy of a smaller id, all go.
    Rows without an id stay.
    """
    ship(spark)
    found = ngram_join.ngram_components(docs, n=5, num=80, den=100)
    gone = found.filter(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(_kept(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark.

    Rows go by the digest of their text: repeated and missing ids make no difference, rows of null text stay.
    """
    key, gone = _free(docs, "_text"), _free(docs, "_gone")
    keyed = docs.select(*_kept(docs), F.sha1(F.col("text").cast("string").cast("binary")).alias(key))
    found = decontaminate.contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
    found = found.select(F.col("doc_id").alias(gone)).distinct()
    return keyed.join(found, F.col(key) == F.col(gone), "left_anti").select(_kept(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of cost-balanced sequences."""
    ship(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, capacity=1024, slice_bytes=1 << 20)


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack_sequences)]
