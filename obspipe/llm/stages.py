"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, pii as personal, quality as classifier, queries, similar
from .common import table

#: Bytes of texts that go to a Python worker at once, about: an executor and its worker each hold such a batch for each task.
BATCH = 8 << 20


def small_batches(stage: Callable) -> Callable:
    """The stage with Arrow batches of BATCH bytes; Spark's own bound is by rows, which can be long."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return classifier.kept(docs, classifier.trained(docs, table(spark, sf_dir, "labels")))


@small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of Jaccard similarity 0.8 or more on shingles of five words."""
    return similar.one_of_each(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark contamination."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return personal.redacted(docs)


@small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return queries.pack(docs)
