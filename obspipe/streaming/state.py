"""Decisions on a stream of observations, with one state per key, and the audit of that state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

OUTPUT = "source string, identity_key string, arrival_seq long, observed_at timestamp, state_hash string, decision string, previous_hash string, state string, previous_state string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
COLUMNS = ["arrival_seq", "observed_at", "state_hash", "is_valid", "present", "state"]
STORED = "newest long, state_hash string, present boolean, state string"


def _none(x):
    return None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else x


class Rules:
    """The rules of `operators.state`, row by row: what a key's state (newest, hash, present, state) comes to."""

    @staticmethod
    def decide(held, at, state_hash, present, state):
        """held: the state, or None; at: microseconds or None. Gives decision (None for nothing to tell) and the new state."""
        newest, known, was, had = held or (None, None, None, None)
        if at is not None and newest is not None and at < newest:
            return "STALE", (newest, known, was, had)
        if present is False:
            decision = None if known is None else "DISAPPEARED" if was else "NO_CHANGE"
        else:
            decision = "CREATE" if known is None else "REAPPEARED" if was is False else "NO_CHANGE" if known == state_hash else "UPDATE"
        if present and state_hash is not None:
            known, had = state_hash, state
        return decision, (newest if at is None else at, known, present, had)


def micros(at) -> int | None:
    return None if pd.isna(at) else pd.Timestamp(at).value // 1000


class Decisions(StatefulProcessor):
    """Decides by the rules of `operators.state`; late rows come out as STALE instead of being dropped.

    Keeps of a key the newest time of any valid row, and of its fresh rows the last hash and state seen and whether the
    last was a sighting. The rows of one key in one micro-batch are sorted in memory; the source's trigger limits them.
    A stream's first batch may find keys that `snapshot` made from earlier rows.
    """

    def init(self, handle) -> None:
        self.state = handle.getValueState("newest", STORED)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            self.state.update((micros(r.newest), _none(r.state_hash), None if pd.isna(r.present) else bool(r.present), _none(r.state)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        # a key has few rows, so plain lists cost less than a table of them
        batch = [r for x in rows for r in zip(*[x[c].tolist() for c in COLUMNS])]
        batch.sort(key=lambda r: (1, 0) if _none(r[0]) is None else (0, r[0]))
        out, valid = [], False
        for arrival, at, state_hash, is_valid, present, state in batch:
            if pd.isna(is_valid):
                continue
            state_hash, state, at = _none(state_hash), _none(state), _none(at)
            before = held or (None,) * 4
            if not is_valid:
                decision = "REJECT"
            else:
                decision, held = Rules.decide(held, micros(at), state_hash, None if pd.isna(present) else bool(present), state)
                valid = True
            if decision:
                told = (before[1], before[3]) if decision not in ("STALE", "REJECT") else (None, None)
                out.append((*key, arrival, at, state_hash, decision, told[0], state, told[1]))
        if valid:
            self.state.update(held)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def _written(df: DataFrame) -> DataFrame:
    """df with its column state as JSON, which keeps strings, numbers, arrays and structs of them exactly; null if there is none."""
    if "state" not in df.columns:
        return df.withColumn("state", F.lit(None).cast("string"))
    return df.withColumn("state", F.to_json("state", {"ignoreNullFields": "false"}))


def state_stream(rows: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """rows: source, identity_key, arrival_seq, observed_at, state_hash; optional is_valid, present, and state, a struct.

    Gives the rows' decisions with previous_hash and, if there is a state, state and previous_state. start: what
    `operators.state.snapshot` made of the rows before the stream; it is read by the query's first batch only.
    Sets the session's state store to RocksDB, which keeps states on disk and which these states need.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    for name in ("is_valid", "present"):
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(True))
    kind = next((f.dataType for f in rows.schema if f.name == "state"), None)
    grouped = _written(rows).groupBy("source", "identity_key")
    first = None if start is None else _written(start).select("source", "identity_key", "newest", "state_hash", "present", "state").groupBy("source", "identity_key")
    found = grouped.transformWithStateInPandas(Decisions(), OUTPUT, outputMode="append", timeMode="none", initialState=first)
    if kind is None:
        return found.drop("state", "previous_state")
    return found.withColumns({c: F.from_json(c, kind) for c in ("state", "previous_state")})


def stored_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the stream at this checkpoint holds of each key: source, identity_key, newest, state_hash, present, state (JSON)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "newest").load()
    return held.select("key.*", F.timestamp_micros("value.newest").alias("newest"), "value.state_hash", "value.present", "value.state")


def audited(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """A row for each key of either side: source, identity_key, finding (equal, differs, only stored, only rebuilt).

    stored: `stored_state` of a stream; rebuilt: `operators.state.snapshot` of all its rows. States are compared as JSON
    where both have them.
    """
    keys = ("source", "identity_key")
    sides = []
    for name, df in (("stored", stored), ("rebuilt", rebuilt)):
        if "state" in df.columns and dict(df.dtypes)["state"] != "string":
            df = _written(df)
        state = F.col("state") if "state" in df.columns else F.lit(None).cast("string")
        sides.append(df.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], F.struct("newest", "state_hash", "present", state.alias("state")).alias(name)))
    meet = [F.col(f"_stored_{k}").eqNullSafe(F.col(f"_rebuilt_{k}")) for k in keys]
    both = sides[0].join(sides[1], meet, "full_outer")
    same = lambda c: F.col(f"stored.{c}").eqNullSafe(F.col(f"rebuilt.{c}"))
    equal = same("newest") & same("state_hash") & same("present") & same("state")
    finding = F.when(F.col("rebuilt").isNull(), "only stored").when(F.col("stored").isNull(), "only rebuilt").when(equal, "equal").otherwise("differs")
    return both.select(*[F.coalesce(f"_stored_{k}", f"_rebuilt_{k}").alias(k) for k in keys], finding.alias("finding"), "stored", "rebuilt")
