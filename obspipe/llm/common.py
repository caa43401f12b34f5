"""Helpers that the corpus operators share: tables, saved tables, row numbers."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of the tables saved in each open `temporary` block.
_blocks: list[list[str]] = []


def saved(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back.

    Lost executors then cost a re-read of files, never a recomputation of what came before. Tables that a result
    still reads stay in the shared folder; `discard` and `temporary` delete the others.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    for block in _blocks:
        block.append(path)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.saved_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete tables that `saved` returned, which nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df.saved_at)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose saved tables are deleted at its end, but for those given to the function that it yields."""
    made: list[str] = []
    keep: set[str] = set()

    def kept_table(df: DataFrame) -> DataFrame:
        keep.add(df.saved_at)
        return df

    _blocks.append(made)
    try:
        yield kept_table
    finally:
        _blocks.remove(made)
        for path in set(made) - keep:
            _delete(spark, path)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have, whatever the case of letters."""
    there = {c.lower() for c in df.columns}
    while wanted.lower() in there:
        wanted += "_"
    return wanted


def numbered(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written, with a number of each row in one more column, and that column's name.

    The numbers are fixed with the table: a task that runs again reads the same ones, which ids made on the fly don't ensure.
    """
    uid = free_name(df, "uid")
    return saved(df.withColumn(uid, F.monotonically_increasing_id()), name), uid


def joined_if_small(side: DataFrame, rows: int) -> DataFrame:
    """side, with the broadcast hint if it has at most `rows` rows."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def ascii_lower(text):
    """Lower-case A-Z only, as a Column."""
    return F.translate(text, UPPER, LOWER)


def parts(n: int, per: int) -> int:
    """How many partitions of about `per` rows n rows need."""
    return max(1, -(-int(n) // per))


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """A tool with a memo that a Python worker makes once and keeps for its later tasks."""
    there = sys.modules.setdefault("_obspipe_kept", types.ModuleType("_obspipe_kept")).__dict__
    if key not in there:
        there[key] = make()
    return there[key]


def give_back() -> None:
    """Return freed memory to the system: Arrow's pool, and what the C library keeps of freed objects where it can tell.

    A worker waits for its next task with all that a task before had needed, which counts against its executor.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator, rows: int = 500) -> Iterator:
    """Arrow batches in slices of so many rows at most, so that a worker holds the Python objects of few rows at a time.

    At the end the worker, which waits for its next task, gives its memory back.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()
