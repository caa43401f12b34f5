"""Evidence from landed responses or files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EVIDENCE
from ..session import once, prepared
from .charset import decoded


def body_hash(body: Column) -> Column:
    """Lower-case SHA-256 of the text's UTF-8 bytes."""
    return F.sha2(F.encode(body, "UTF-8"), 256)


def capture_evidence(responses: DataFrame) -> DataFrame:
    """One evidence row per landed response, whatever its status.

    responses: source_url, status_code, body, and optionally evidence_id, fetched_at, content_type and, for
    binary bodies, charset, which goes before that of the content type (`sources.charset` has the order and what happens to
    bad bytes). A missing id is a digest of the row's other values, so that recomputed stages agree.
    """
    have = set(responses.columns)
    get = lambda c, t: F.col(c) if c in have else F.lit(None).cast(t)
    body = F.col("body")
    if dict(responses.dtypes)["body"] == "binary":
        prepared(responses.sparkSession)
        declared = F.coalesce(F.concat(F.lit("charset="), F.nullif(get("charset", "string"), F.lit(""))), get("content_type", "string"))
        # decoded once: the text and both digests read the finished column
        rest = [c for c in responses.columns if c != "body"]
        responses = once(responses, rest, {"body": decoded(body, declared)})
    at = F.coalesce(get("fetched_at", "timestamp"), F.current_timestamp())
    digest = F.sha2(F.concat_ws("|", F.col("source_url"), get("fetched_at", "timestamp").cast("string"), body_hash(body)), 256)
    return responses.select(
        F.coalesce(F.nullif(get("evidence_id", "string"), F.lit("")), digest).alias("evidence_id"), F.col("source_url"),
        at.alias("fetched_at"), F.col("status_code").cast("int").alias("status_code"),
        F.coalesce(get("content_type", "string"), F.lit("")).alias("content_type"), body.alias("body"), body_hash(body).alias("body_hash"),
    )


def read_evidence(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False) -> DataFrame:
    """Evidence tables (parquet, json, orc), or whole documents as bodies ('text'; source_url is the file's path)."""
    reader = spark.readStream if streaming else spark.read
    if fmt == "text":
        files = reader.option("wholetext", "true").text(path).select(
            F.col("_metadata.file_path").alias("source_url"), F.lit(200).alias("status_code"),
            F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("fetched_at"))
        return capture_evidence(files)
    return reader.format(fmt).schema(EVIDENCE).load(path)
