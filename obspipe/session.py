"""Session settings that results rely on, the shared folder, and a barrier against repeated evaluation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Set by shared_dir for a local master without a folder of its own.
LOCAL = "obspipe.local.dir"

def prepared(spark: SparkSession) -> SparkSession:
    """Of a repeated JSON key the last value counts, as JSON readers commonly have it, and bytes that a charset doesn't
    have are replaced. Extraction and capture call this by themselves."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a temporary folder is made, but only for a local master,
    whose one process needs no shared storage.
    """
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local") or "cluster" in conf.get("spark.master", ""):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.conf.get(LOCAL, None):
        spark.conf.set(LOCAL, tempfile.mkdtemp(prefix="spark-obspipe-"))
    return spark.conf.get(LOCAL)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/obspipe-{name}-{uuid.uuid4().hex}"


def once(df: DataFrame, keep: list[str | Column], cols: dict[str, Column]) -> DataFrame:
    """The columns `keep`, and `cols` computed exactly once for each row.

    A plain projection is merged with later ones and pushed into later filters, each use with its whole
    expression. A generator over one struct isn't, and what follows reads the finished columns.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def spread(df: DataFrame, per_task: int = 5000) -> DataFrame:
    """df in parts of about `per_task` rows, dealt by all its columns.

    For tables of small rows from which much work follows, as page parsing: Spark reads files in parts of some
    megabytes, which may be millions of rows.
    """
    return df.repartition(max(1, -(-df.count() // per_task)), *df.columns)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return fs.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder; nothing happens if it isn't there."""
    fs, place = _place(spark, path)
    fs.delete(place, True)
