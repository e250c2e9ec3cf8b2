"""The corpus pipeline: five stages over ``documents``, each the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldaudit.llm.stages import STAGES

#: Learned scores and approximate tokens of the stages have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None

__all__ = ["STAGES", "ORACLE_SQL", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; every stage is written before the next one reads it."""
    from fieldaudit.llm.common import written

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
