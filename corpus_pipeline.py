"""A corpus pipeline of five stages; see STAGES."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkweft.llm import stages
from sparkweft.scratch import Scratch

STAGES = stages.STAGES

#: Learned weights, locally consistent parsing and tokenizer merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written and read again.

    Nulls, repeated rows, empty tables and other columns are as each stage says. A stage's table
    is freed when its successor is written; the last one's is read by the result.
    """
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
