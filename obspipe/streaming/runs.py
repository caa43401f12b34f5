"""Sightings and run ends on one stream: a key that a complete run didn't show disappears when the run ends.

Keys are dealt to shares of their source, and a share holds the states of its keys in a map. The row that ends a run is
sent to every share. When it comes, the share walks its keys once and decides on those that were known and not sighted
since the run began. So absences come out with the micro-batch that has the run's end, however many runs end in one
batch, and a restart finds the map as it was. (Event-time timers wouldn't do: the watermark moves once a batch, to the
last of several run ends, and doesn't carry when a run began.)
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .state import PROVIDER, Rules, micros

OUTPUT = "source string, identity_key string, arrival_seq long, observed_at timestamp, state_hash string, decision string, run_id string"
COLUMNS = ["identity_key", "arrival_seq", "observed_at", "state_hash", "is_valid", "present", "run_id", "started_seq", "complete"]
#: Shares that the keys of a source are dealt to.
SHARES = 64


class RunDecisions(StatefulProcessor):
    """Decisions of `operators.runs.decided_runs` on the rows of one share."""

    def init(self, handle) -> None:
        self.keys = handle.getMapState("keys", "identity_key string", "newest long, state_hash string, present boolean, sighted long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat([x[COLUMNS] for x in rows], ignore_index=True)
        # at equal arrival a run ends after its sightings
        batch = batch.assign(ends=batch.identity_key.isna()).sort_values(["arrival_seq", "ends"], kind="stable")
        held, changed, whole, out = {}, set(), False, []
        for r in batch.itertuples():
            if r.ends:
                if pd.isna(r.complete) or not r.complete:
                    continue
                if not whole:
                    # keys touched in this batch are newer than what the map holds
                    held, whole = {k[0]: v for k, v in self.keys.iterator()} | held, True
                for name, (newest, known, present, sighted) in held.items():
                    if sighted is not None and sighted < r.started_seq:
                        decision, now = Rules.decide((newest, known, present, None), micros(r.observed_at), None, False, None)
                        if decision != "STALE":
                            held[name] = (now[0], now[1], now[2], sighted)
                            changed.add(name)
                        if decision == "DISAPPEARED":
                            out.append((key[0], name, r.arrival_seq, r.observed_at, None, decision, r.run_id))
                continue
            name = r.identity_key
            if pd.isna(r.is_valid):
                continue
            state_hash = None if pd.isna(r.state_hash) else r.state_hash
            if not r.is_valid:
                decision = "REJECT"
            else:
                if name not in held and not whole and self.keys.containsKey((name,)):
                    held[name] = self.keys.getValue((name,))
                was = held.get(name)
                present = None if pd.isna(r.present) else bool(r.present)
                decision, now = Rules.decide((*was[:3], None) if was else None, micros(r.observed_at), state_hash, present, None)
                held[name] = (*now[:3], int(r.arrival_seq) if present else was and was[3])
                changed.add(name)
            if decision:
                out.append((key[0], name, r.arrival_seq, None if pd.isna(r.observed_at) else r.observed_at, state_hash, decision, None))
        for name in changed:
            self.keys.updateValue((name,), held[name])
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def run_stream(rows: DataFrame, shares: int = SHARES) -> DataFrame:
    """Decisions on a stream that has sightings and run ends, in order of arrival over its micro-batches.

    rows: source, identity_key (null: a run's end), arrival_seq, observed_at, state_hash; optional is_valid, present. Of a
    run's end: run_id, started_seq, complete, its last arrival as arrival_seq and its time as observed_at.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    for name in ("is_valid", "present"):
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(True))
    every = F.sequence(F.lit(0), F.lit(shares - 1))
    own = F.array(F.pmod(F.xxhash64("identity_key"), F.lit(shares)).cast("int"))
    dealt = rows.select("source", *COLUMNS, F.explode(F.when(F.col("identity_key").isNull(), every).otherwise(own)).alias("share"))
    return dealt.groupBy("source", "share").transformWithStateInPandas(RunDecisions(), OUTPUT, outputMode="append", timeMode="none")
