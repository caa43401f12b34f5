"""State of products from validated observations. The rules are this library's own.

Rows of one key are taken in order of arrival. A row observed before the newest one so far is STALE and
changes nothing; otherwise the first is CREATE, an equal state NO_CHANGE and any other UPDATE. An absence
(a key that a complete catalog run didn't show) is DISAPPEARED, and the next sighting REAPPEARED; invalid
rows are REJECT. All of it is derived from the observation table and can be rebuilt by running it again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import as_of

STATE = ("title", "price", "compare_at_price", "currency", "availability", "quantity", "category", "sku", "categories", "variants")
#: Rows of one key that one task takes in order.
HOT = 1_000_000
#: arrival_seq of what stands for earlier rows.
FIRST = -(1 << 62)


def with_state_hash(df: DataFrame, fields: tuple[str, ...] = STATE) -> DataFrame:
    """Add state, a struct of the fields, and its digest state_hash."""
    return df.withColumn("state", F.struct(*fields)).withColumn("state_hash", F.sha2(F.to_json("state", {"ignoreNullFields": "false"}), 256))


def _before(rows: DataFrame, keys: tuple[str, ...], cols: dict[str, tuple[str, Column]]) -> DataFrame:
    """rows with, for each new column, ("max" or "last", value): that of the values which aren't null in the key's earlier rows.

    With a column _block, which orders a key's rows before arrival_seq does, a key is split: its blocks are summed up
    in a row each, and a row sees its own block's earlier rows and what the blocks before come to.
    """
    split = "_block" in rows.columns
    own = Window.partitionBy(*keys, *["_block"] * split).orderBy("arrival_seq").rowsBetween(Window.unboundedPreceding, -1)
    value = {n: F.max(c) if how == "max" else F.last(c, ignorenulls=True) for n, (how, c) in cols.items()}
    if not split:
        return rows.withColumns({n: v.over(own) for n, v in value.items()})
    last = {n: F.max(c) if how == "max" else F.max_by(c, F.when(c.isNotNull(), F.col("arrival_seq"))) for n, (how, c) in cols.items()}
    blocks = rows.groupBy(*keys, "_block").agg(*[c.alias(n) for n, c in last.items()])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    told = {f"_{n}": (F.max(n) if how == "max" else F.last(n, ignorenulls=True)).over(earlier) for n, (how, _) in cols.items()}
    blocks = blocks.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_of"), *[c.alias(n) for n, c in told.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    rows = rows.withColumns({n: v.over(own) for n, v in value.items()}).join(blocks, [*same, F.col("_block") == F.col("_of")], "left")
    both = {n: F.greatest(n, f"_{n}") if how == "max" else F.coalesce(n, f"_{n}") for n, (how, _) in cols.items()}
    return rows.withColumns(both).drop("_of", *told, *[f"_{k}" for k in keys])


def _blocks(rows: DataFrame, keys: tuple[str, ...], blocks: int | None) -> int:
    if blocks is None:
        most = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        blocks = -(-(most or 0) // HOT)
    return blocks


def _decided(rows: DataFrame, keys: tuple[str, ...], blocks: int | None, prior: DataFrame | None) -> DataFrame:
    """The valid rows with decision (null for absences of keys never seen), previous_hash, previous_state; and _prior, true for what `prior` stands for."""
    told = [(c, f"previous_{c.removeprefix('state_')}") for c in ("state_hash", "state") if c in rows.columns]
    good = rows.withColumn("_prior", F.lit(False))
    if prior is not None:
        # a sighting of the last state known, and an absence after it where the key is gone
        took = prior.withColumn("_present", F.explode(F.when(F.col("state_hash").isNull(), F.array("present")).when(F.col("present"), F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))))
        seq = F.when(F.col("_present"), FIRST).otherwise(FIRST + 1)
        took = took.select(*keys, F.col("newest").alias("observed_at"), seq.cast("long").alias("arrival_seq"), *[c for c, _ in told], F.lit(True).alias("is_valid"), F.col("_present").alias("present"), F.lit(True).alias("_prior"))
        good = good.unionByName(took, allowMissingColumns=True)
    blocks = _blocks(rows, keys, blocks)
    if blocks > 1:
        marks = good.agg(F.percentile_approx("arrival_seq", [i / blocks for i in range(1, blocks)], 10_000)).first()[0] or []
        edges = F.array(*[F.lit(m) for m in sorted(set(marks))]).cast("array<long>")
        good = good.withColumn("_block", F.size(F.filter(edges, lambda m: m <= F.col("arrival_seq"))))
    good = _before(good, keys, {"_newest": ("max", F.col("observed_at"))})
    good = good.withColumn("stale", F.coalesce(F.col("observed_at") < F.col("_newest"), F.lit(False))).drop("_newest")
    fresh = ~F.col("stale")
    # structs keep a null inside apart from no row at all
    states = {new: ("last", F.when(fresh & F.col("present") & F.col("state_hash").isNotNull(), F.col(c))) for c, new in told}
    good = _before(good, keys, states | {"_was": ("last", F.when(fresh, F.struct("present")))}).withColumn("was_present", F.col("_was.present")).drop("_was", "_block")
    seen = F.col("previous_hash").isNotNull()
    decision = (
        F.when(F.col("stale"), "STALE")
        .when(~F.col("present") & ~seen, F.lit(None)).when(~F.col("present") & F.col("was_present"), "DISAPPEARED").when(~F.col("present"), "NO_CHANGE")
        .when(~seen, "CREATE").when(~F.col("was_present"), "REAPPEARED")
        .when(F.col("previous_hash") == F.col("state_hash"), "NO_CHANGE").otherwise("UPDATE")
    )
    return good.withColumn("decision", decision).drop("was_present")


def _flagged(rows: DataFrame) -> DataFrame:
    for c in ("is_valid", "present"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(True))
    return rows


def state_transitions(rows: DataFrame, keys: tuple[str, ...] = ("source", "identity_key"), blocks: int | None = None, prior: DataFrame | None = None) -> DataFrame:
    """Add decision, previous_hash, and previous_state if rows have a column state.

    rows: keys, observed_at, arrival_seq, state_hash; optional is_valid, present, state. Other columns, as the
    errors of a rejected row, stay. blocks: into how many tasks a key with very many rows is split, by quantiles of
    arrival_seq; the items of a catalog without ids, for one, all have the catalog's URL as their key. By default
    the rows of the most frequent key are counted (rows that are costly to make should be written first) and HOT go to a
    block. prior: what `snapshot` gave for the rows before these, on which they go on.
    """
    rows = _flagged(rows)
    told = [new for c, new in (("state_hash", "previous_hash"), ("state", "previous_state")) if c in rows.columns]
    good = _decided(rows.filter("is_valid"), keys, blocks, prior).filter("decision is not null and not _prior").drop("stale", "_prior")
    good = good.withColumns({c: F.when(F.col("decision") != "STALE", F.col(c)) for c in told})
    return good.unionByName(rows.filter("not is_valid").withColumn("decision", F.lit("REJECT")), allowMissingColumns=True)


def snapshot(rows: DataFrame, keys: tuple[str, ...] = ("source", "identity_key"), blocks: int | None = None, prior: DataFrame | None = None) -> DataFrame:
    """What later rows have to know of each key that has a valid row, here or in prior.

    newest: the latest observed_at of all valid rows; state_hash and state: the last one sighted; present: whether the
    last fresh row was a sighting; observed_at of that row; updated_at: when the key last changed; last_seq: the
    last arrival. snapshot(later, prior=snapshot(earlier)) equals snapshot(both) if later rows arrive later.
    """
    rows = _flagged(rows).filter("is_valid")
    decided = _decided(rows, keys, blocks, prior)
    fresh, at = ~F.col("stale"), F.col("arrival_seq")
    known = F.when(fresh & F.col("present") & F.col("state_hash").isNotNull(), at)
    own = fresh & ~F.col("_prior")
    changed = F.when(own & F.col("decision").isin("CREATE", "UPDATE", "DISAPPEARED", "REAPPEARED"), at)
    found = decided.groupBy(*keys).agg(
        F.max("observed_at").alias("newest"), *[F.max_by(c, known).alias(c) for c in ("state_hash", "state") if c in rows.columns],
        F.max_by("present", F.when(fresh, at)).alias("present"), F.max_by(F.struct("observed_at"), F.when(own, at)).alias("_row"),
        F.max_by(F.struct("observed_at"), changed).alias("_change"), F.max(F.when(~F.col("_prior"), at)).alias("last_seq"))
    if prior is not None:
        was = prior.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct("observed_at").alias("_row_was"), F.struct(F.col("updated_at").alias("observed_at")).alias("_change_was"), F.col("last_seq").alias("_seq_was"))
        found = found.join(was, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
        found = found.withColumns({"_row": F.coalesce("_row", "_row_was"), "_change": F.coalesce("_change", "_change_was"), "last_seq": F.coalesce("last_seq", "_seq_was")})
    kept = [c for c in ("state_hash", "state") if c in rows.columns]
    return found.select(*keys, "newest", *kept, "present", "_row.observed_at", F.col("_change.observed_at").alias("updated_at"), "last_seq")


def current_state(transitions: DataFrame, keys: tuple[str, ...] = ("source", "identity_key")) -> DataFrame:
    """The newest fresh row of each key, and when it last changed (updated_at)."""
    fresh = transitions.filter("decision not in ('STALE', 'REJECT')")
    changed = F.when(F.col("decision").isin("CREATE", "UPDATE", "DISAPPEARED", "REAPPEARED"), F.col("observed_at"))
    every = [c for c in fresh.columns if c not in keys]
    # one aggregation, combined before its shuffle
    newest = fresh.groupBy(*keys).agg(F.max_by(F.struct(*every), "arrival_seq").alias("_row"), F.max_by(changed, F.when(changed.isNotNull(), F.col("arrival_seq"))).alias("updated_at"))
    return newest.select(*keys, "_row.*", "updated_at").drop("decision", "previous_hash", "previous_state")


def history(transitions: DataFrame) -> DataFrame:
    """Changes only: previous_hash and new_hash, and the states behind them if known; a product that is gone has no new one."""
    changes = transitions.filter("decision in ('CREATE', 'UPDATE', 'DISAPPEARED', 'REAPPEARED')").withColumn("changed_at", F.col("observed_at"))
    there = F.col("decision") != "DISAPPEARED"
    return changes.withColumns({f"new_{c.removeprefix('state_')}": F.when(there, F.col(c)) for c in ("state_hash", "state") if c in changes.columns})


def validity(transitions: DataFrame, keys: tuple[str, ...] = ("source", "identity_key")) -> DataFrame:
    """When each state held: keys, valid_from, valid_to (null: until now), present, state_hash, and state if there.

    Intervals are closed at their start and open at their end, and follow each other without gaps from the first change
    on; while a key is gone its interval has present = false and the state it had. Changes observed at the same time
    leave the last one. A change without a time has no interval.
    """
    changes = transitions.filter("decision in ('CREATE', 'UPDATE', 'DISAPPEARED', 'REAPPEARED') and observed_at is not null")
    there = F.col("decision") != "DISAPPEARED"
    kept = [c for c in ("state_hash", "state") if c in changes.columns]
    last = {c: F.when(there, F.col(c)).otherwise(F.col(f"previous_{c.removeprefix('state_')}")) for c in kept}
    changes = changes.select(*keys, F.col("observed_at").alias("valid_from"), "arrival_seq", there.alias("present"), *[c.alias(n) for n, c in last.items()])
    newest = changes.groupBy(*keys, "valid_from").agg(F.max_by(F.struct("present", *kept), "arrival_seq").alias("_row"))
    until = F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("valid_from"))
    return newest.select(*keys, "valid_from", until.alias("valid_to"), "_row.*")


def state_as_of(questions: DataFrame, intervals: DataFrame, at: str = "as_of", keys: tuple[str, ...] = ("source", "identity_key")) -> DataFrame:
    """questions (keys, a time `at`) with what held then: valid_from, valid_to, present, state_hash, state; nulls before the first change.

    An as-of join on cells of the time axis (operators.asof), so no interval meets more than the questions it answers.
    """
    take = [c for c in ("valid_from", "valid_to", "present", "state_hash", "state") if c in intervals.columns]
    return as_of(questions, at, intervals, "valid_from", keys, take)


def transition_rows(validated: DataFrame, arrival_seq: Column) -> DataFrame:
    """The decision on every validated row: lineage, keys, decision, validation_errors, and the states before and after.

    A rejected row has its errors, no key, and changes nothing.
    """
    rows = with_state_hash(validated.withColumn("arrival_seq", arrival_seq))
    decided = state_transitions(rows.withColumnRenamed("errors", "validation_errors"))
    kept = F.col("decision").isin("CREATE", "UPDATE", "NO_CHANGE", "REAPPEARED")
    return decided.select(
        "evidence_id", "source", "identity_key", "observed_at", "arrival_seq", "decision", "validation_errors",
        "previous_state", F.when(kept, F.col("state")).alias("new_state"),
    )


def detect_disappearances(current: DataFrame, seen: DataFrame, observed_at, arrival_seq, keys: tuple[str, ...] = ("source", "identity_key")) -> DataFrame:
    """Absence rows for keys of `current` that a complete run (`seen`) lacks; union them to the input of state_transitions."""
    gone = current.join(seen.select(*keys).distinct(), list(keys), "left_anti")
    return gone.select(*keys, F.lit(observed_at).alias("observed_at"), F.lit(arrival_seq).cast("long").alias("arrival_seq"), "state_hash").withColumn("present", F.lit(False))
