"""Runs of a catalog and what complete ones didn't show. The rules are this library's own.

A run of a source spans an interval of arrival. A key that was sighted before a complete run began, and not while it
went on, is absent at its end; an incomplete run tells nothing. All runs are treated at once: what counts of a key are
its sightings, collapsed to how many complete runs had begun and ended before them, so a key has two rows a run at most
however often it was seen. Between two of these (a gap) the runs that came and went without the key follow by number.

Only the first and the last absence of a gap are given out. Those between would change nothing: the first makes the key
DISAPPEARED, the last says up to when it was known to be gone. An absence that was observed before the key's newest
sighting, by a clock that is ahead, would be STALE and isn't the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import BROADCAST, marks_before
from .state import state_transitions


def complete_runs(runs: DataFrame, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """The complete runs, numbered in order within their source.

    Fails on complete runs that overlap in arrival, or that end at an earlier time than one before.
    """
    done = runs.filter(F.coalesce(F.col("complete"), F.lit(False))).select(*by, "run_id", "started_seq", "ended_seq", "ended_at")
    order = Window.partitionBy(*by).orderBy("started_seq", "ended_seq")
    fault = (F.lag("ended_seq").over(order) >= F.col("started_seq")) | (F.lag("ended_at").over(order) > F.col("ended_at")) | (F.col("ended_seq") < F.col("started_seq"))
    # the check stands in the number itself, so it can't be optimised away
    return done.withColumn("run_number", F.when(fault, F.raise_error(F.lit("complete runs of one source overlap or aren't in order of time")).cast("long")).otherwise(F.row_number().over(order).cast("long")))


def run_absences(rows: DataFrame, runs: DataFrame, keys: tuple[str, ...] = ("source", "identity_key"), by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Absence rows for the input of state_transitions: keys, observed_at, arrival_seq, present (false), run_id.

    rows: keys, observed_at, arrival_seq; optional is_valid and present, which sightings have true. runs: by, run_id,
    started_seq, ended_seq (arrival of the first and last row), ended_at, complete. A key with null parts has no absences.
    """
    for c in ("is_valid", "present"):
        rows = rows.filter(F.coalesce(F.col(c), F.lit(False))) if c in rows.columns else rows
    done = complete_runs(runs, by)
    seen = rows.select(*keys, "observed_at", "arrival_seq")
    seen = marks_before(seen, "arrival_seq", done, "started_seq", by, "_begun")
    seen = marks_before(seen, "arrival_seq", done, "ended_seq", by, "_ended", closed=False)
    places = seen.groupBy(*keys, "_begun", "_ended").agg(F.max("observed_at").alias("_newest"))
    order = Window.partitionBy(*keys).orderBy("_begun", "_ended")
    places = places.withColumns({"_newest": F.max("_newest").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_until": F.lead("_ended").over(order)})
    places = marks_before(places, "_newest", done, "ended_at", by, "_past", closed=False)
    total = done.groupBy(*by).agg(F.max("run_number").alias("_all"))
    few = done.count() <= BROADCAST
    small = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    gaps = places.join(small(total), list(by)).withColumns({"_first": F.greatest("_begun", "_past") + 1, "_last": F.coalesce("_until", "_all")}).filter("_first <= _last")
    ends = gaps.select(*keys, F.explode(F.array_distinct(F.array("_first", "_last"))).alias("run_number"))
    return ends.join(small(done), [*by, "run_number"]).select(*keys, F.col("ended_at").alias("observed_at"), F.col("ended_seq").alias("arrival_seq"), F.lit(False).alias("present"), "run_id")


def decided_runs(rows: DataFrame, runs: DataFrame, keys: tuple[str, ...] = ("source", "identity_key"), by: tuple[str, ...] = ("source",), blocks: int | None = None) -> DataFrame:
    """state_transitions of rows and of the absences in all complete runs, without absences that change nothing.

    run_id is that of the run in which a key was found to be gone, else null.
    """
    rows = rows.withColumn("is_valid", F.lit(True)) if "is_valid" not in rows.columns else rows
    rows = rows.withColumn("present", F.lit(True)) if "present" not in rows.columns else rows
    every = rows.unionByName(run_absences(rows, runs, keys, by).withColumn("is_valid", F.lit(True)), allowMissingColumns=True)
    return state_transitions(every, keys, blocks).filter("run_id is null or decision = 'DISAPPEARED'")
