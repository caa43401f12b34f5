"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A row's place on the ring is 26 bits of its text's hash, 26 bits of its doc_id's, then 10 bits of its number in a
written table: equal texts are neighbours and share a shard unless it fills up among them, and a large group can
still be divided, also one of rows that repeat both. Every shard owns many points of the ring; a row belongs to the
next point clockwise. Rows are taken clockwise from place 0. A shard that holds its share of the bytes is full, and
what would go to it continues clockwise to the next shard with room. The share is what is still open divided by the
shards still open, so sizes end within about half a row of each other. A large row (over 1/LARGE of the share) that a
shard has no room for goes on clockwise too, but leaves the shard open for others; if none has room, the emptiest takes
it. So a row beyond any share fills one shard, and the others share what is left.

The ring is walked over a histogram of 2**BIN_BITS bins, at whose edges the virtual nodes stand. Only a bin
in which a shard fills up is looked at more closely: place by place if it has at most DETAIL rows, or else in
2**BIN_BITS finer bins, and so on. So the driver sees a bounded table for each of the `shards` fills, and the
rows are only aggregated. The result is a list of cuts (place, shard). Slots number a shard's rows
without gaps, in ring order, from the counts of sorted partitions.

Null texts have no bytes; a null doc_id hashes as text. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import joined_if_small, numbered, saved

ROW_BITS = 10
BITS, BIN_BITS = 52 + ROW_BITS, 13
#: A row of more than this part of the share is large.
LARGE = 64
#: Points of the ring that each shard owns.
VIRTUAL = 64
#: Rows of a bin that are looked at place by place.
DETAIL = 20_000
#: Rows of a side table that are broadcast at most.
BROADCAST = 1_000_000


def points(shards: int) -> list[tuple[int, int]]:
    """(place, shard) of all virtual nodes, by place; each is the last place of a bin."""
    import xxhash

    edge = lambda s, v: (xxhash.xxh64_intdigest(f"{s}/{v}", 7) >> (64 - BIN_BITS)) + 1 << BITS - BIN_BITS
    return sorted((edge(s, v) - 1, s) for s in range(shards) for v in range(VIRTUAL))


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, place of each row, written and sorted by place."""
    text = F.coalesce("text", F.lit(""))
    half = F.shiftrightunsigned(F.xxhash64(text), 38)
    own = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 38)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.shiftleft(half, 26).bitwiseOR(own).alias("place"),
    )
    # numbers are fixed with the table, so that a task that runs again deals its rows to the same places
    rows, uid = numbered(rows, "rows")
    row = F.shiftrightunsigned(F.xxhash64(uid), 64 - ROW_BITS)
    rows = rows.withColumn("place", F.shiftleft("place", ROW_BITS).bitwiseOR(row)).drop(uid)
    # sorted, so that a look at one bin reads the row groups of that bin only
    return saved(rows.repartitionByRange("place").sortWithinPartitions("place"), "places")


class Ring:
    """Walks the ring over (place, bytes) in ring order and notes where the owner of rows changes."""

    def __init__(self, shards: int, total: int):
        self.points = points(shards)
        self.places = [p for p, _ in self.points]
        self.load = [0] * shards
        self.open = set(range(shards))
        self.total = total
        self.cuts: list[tuple[int, int]] = []

    def owner(self, place: int) -> int:
        """The open shard for a place: that of the next virtual node clockwise which is open."""
        i = bisect.bisect_left(self.places, place)
        return next(s for k in range(len(self.points)) if (s := self.points[(i + k) % len(self.points)][1]) in self.open)

    def share(self) -> float:
        full = sum(x for s, x in enumerate(self.load) if s not in self.open)
        return (self.total - full) / len(self.open)

    def holds(self, place: int, size: int) -> int | None:
        """The shard that a whole bin goes to, or None if it doesn't fit into its owner."""
        shard = self.owner(place)
        if len(self.open) == 1 or self.load[shard] + size <= self.share():
            self.load[shard] += size
            return shard
        return None

    def takes(self, place: int, size: int) -> int:
        """The shard that a single place goes to; it goes in if that is nearer to the share."""
        share = self.share()
        if size * LARGE <= share:
            shard = self.owner(place)
            while len(self.open) > 1 and self.load[shard] + size / 2 > self.share():
                self.open.discard(shard)
                shard = self.owner(place)
            self.load[shard] += size
            return shard
        first = bisect.bisect_left(self.places, place)
        ahead = (self.points[(first + k) % len(self.points)][1] for k in range(len(self.points)))
        shard = next((s for s in ahead if s in self.open and self.load[s] + size / 2 <= share), None)
        if shard is None:
            shard = min(self.open, key=lambda s: (self.load[s], s))
        self.load[shard] += size
        if len(self.open) > 1 and self.load[shard] >= share:
            self.open.discard(shard)
        return shard

    def cut(self, place: int, shard: int) -> None:
        if not self.cuts or self.cuts[-1][1] != shard:
            self.cuts.append((place, shard))


def cuts(rows: DataFrame, shards: int) -> list[tuple[int, int]]:
    """Ascending (place, shard): rows from that place on go to that shard, up to the next entry."""

    def bins(shift: int, start: int, end: int) -> list:
        """(first place, bytes, rows) of each bin of 2**shift places from start to end that has rows."""
        inside = rows.filter((F.col("place") >= start) & (F.col("place") <= end - 1))
        at = F.shiftleft(F.shiftright("place", shift), shift)
        # at most 2**BIN_BITS rows, or DETAIL where shift is zero
        return sorted(inside.groupBy(at.alias("at")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect())

    shift = BITS - BIN_BITS
    top = bins(shift, 0, 1 << BITS)
    ring = Ring(shards, sum(r["size"] for r in top))

    def walk(found: list, shift: int) -> None:
        for r in found:
            at = r["at"]
            if not shift:
                ring.cut(at, ring.takes(at, r["size"]))
            elif (shard := ring.holds(at, r["size"])) is not None:
                ring.cut(at, shard)
            else:
                finer = 0 if r["n"] <= DETAIL else max(0, shift - BIN_BITS)
                walk(bins(finer, at, at + (1 << shift)), finer)

    walk(top, shift)
    return ring.cuts


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, place, shard and slot of each row."""
    rows = placed(docs)
    found = cuts(rows, shards)
    at, to = np.array([p for p, _ in found], np.int64), np.array([s for _, s in found], np.int32)
    schema = "doc_id long, size long, text_crc32 long, shard int, part int, slot long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            own = to[np.searchsorted(at, batch.column("place").to_numpy(), "right") - 1]
            slot = np.zeros(len(own), np.int64)
            for s in np.unique(own):
                mine = np.flatnonzero(own == s)
                slot[mine] = seen[s] + np.arange(len(mine))
                seen[s] += len(mine)
            cols = [*(batch.column(k) for k in ("doc_id", "size", "text_crc32")), pa.array(own), pa.array(np.full(len(own), part, np.int32)), pa.array(slot)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "size", "text_crc32", "shard", "part", "slot"])

    dealt = rows.repartitionByRange("place", "doc_id", "text_crc32").sortWithinPartitions("place", "doc_id", "text_crc32")
    numbered = saved(dealt.mapInArrow(number, schema), "numbered")
    # a row for each pair of partition and shard that meet: partitions are ranges, so few shards meet each
    counts = numbered.groupBy("part", "shard").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return numbered.join(joined_if_small(first, BROADCAST), ["part", "shard"]).select("doc_id", "size", "text_crc32", "shard", (F.col("slot") + F.col("first")).alias("slot"))
