"""The current state as a table that micro-batches are merged into, without a state store.

The table is Parquet in hash buckets of the key. A batch reads the buckets of its own keys only, goes on from what they
hold (`operators.state.snapshot`), and replaces these buckets' files; all others stay as they are. What is known of a key
is never given up, so nothing has to expire, and a late row is STALE however long its key was silent.

A batch is first written whole to the shared folder, then moved bucket by bucket. If it is repeated, in part or whole, rows
that a bucket has already taken (by arrival) are passed over, so the table comes out the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import snapshot, state_transitions
from ..session import delete, exists, new_folder

KEYS = ("source", "identity_key")


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The table: keys, newest, state_hash, state if rows have one, present, observed_at, updated_at, last_seq."""
    return spark.read.parquet(path).drop("bucket")


def merge_current(rows: DataFrame, path: str, buckets: int = 64, keys: tuple[str, ...] = KEYS, decisions: str | None = None) -> None:
    """Merge a batch (input of state_transitions) into the table at path; rows of later batches arrive later.

    buckets: as many that a bucket's keys are a task's work; fixed with the table's first batch. decisions: a folder to
    write the rows' decisions to; it is replaced.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    valid = rows.filter("is_valid") if "is_valid" in rows.columns else rows
    touched = [r.bucket for r in valid.select(bucket.alias("bucket")).distinct().collect()]  # `buckets` rows at most
    prior = None
    if exists(spark, path):
        prior = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).drop("bucket")
        taken = prior.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("last_seq").alias("_taken"))
        met = rows.join(taken, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
        rows = met.filter(F.col("_taken").isNull() | (F.col("arrival_seq") > F.col("_taken"))).drop("_taken", *[f"_{k}" for k in keys])
    if decisions:
        state_transitions(rows, keys, prior=prior).write.mode("overwrite").parquet(decisions)
    if not touched:
        return
    staged = new_folder(spark, "current")
    now = snapshot(rows, keys, prior=prior)
    now.write.parquet(staged)
    moved = spark.read.schema(now.schema).parquet(staged).withColumn("bucket", bucket).repartition(len(touched), "bucket")
    moved.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    delete(spark, staged)


def current_stream(rows: DataFrame, path: str, checkpoint: str, buckets: int = 64, history: str | None = None, **trigger) -> StreamingQuery:
    """Keep the table from a stream; history: a folder that gets each micro-batch's decisions in a folder of its own."""
    def merge(batch: DataFrame, n: int) -> None:
        merge_current(batch, path, buckets, decisions=f"{history}/batch={n}" if history else None)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
