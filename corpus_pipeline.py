"""A corpus pipeline: each stage works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from obspipe.llm import stages
from obspipe.llm.common import discard, saved, table, temporary

#: (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [
    ("quality", stages.quality),
    ("near_duplicates", stages.near_duplicates),
    ("decontamination", stages.decontamination),
    ("pii", stages.pii),
    ("packing", stages.packing),
]

#: SQL can't express a trained classifier or the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; between stages the rows are written as Parquet and reread.

    What a stage has written for itself is deleted once its result is written, and that result once the next one is.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with temporary(spark) as keep:
            docs = keep(saved(stage(spark, docs, sf_dir), name))
        if before:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
