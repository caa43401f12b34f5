"""SimHash near-duplicates by anchor-point covering.

Fingerprint: A-Z are lower-cased, words are runs of characters other than ASCII white space, shingles
are `words` consecutive words (a shorter text is one shingle, a text without words has fingerprint
zero); bit i is set if more than half of the shingles' XXH64 values (seed 42) have it.

Links: the 64 bits are cut into blocks, and each block gets a share of the threshold. The shares add up to
bits + 1 less the number of blocks, so two fingerprints within `bits` differ by at most its share in one block:
otherwise they would differ by bits + 1 at least. In a block the anchors are a covering code of radius 1: a Hamming
code on the first bits times all values of the rest. `layout` chooses blocks and code by the number of fingerprints,
so that anchors stay sparsely settled. Each fingerprint lives at
the nearest anchor of each block and is replicated to every anchor within covering radius plus that share;
residents and visitors of an anchor are compared there, so no link is missed. Equal fingerprints
are one node from the start. An anchor with many residents is split into shares that all see its
visitors; visitors are read as a stream. Instead of all pairs of a dense group an anchor reports one
link for each matching visitor and a spanning forest of its residents; with the largest group that it has
united, a visitor is compared only until it meets one member.

`similar.one_of_each` works on sets of shingles and verifies its links; this module's links are those of fingerprints.

Null texts count as empty. Repeated rows, also of one doc_id, fall into one component; a component's id
is its smallest doc_id that isn't null. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import components

RADIUS = 1
#: What a place costs, in comparisons: it is found, shuffled and sorted.
PLACE = 500
#: Residents of one anchor that a task holds; an anchor with more is split.
RESIDENTS = 20_000
#: Pairs compared at once.
CHUNK = 1 << 21
#: Residents from which on an anchor is compared by itself, and members of a united group looked at together.
DENSE, STRIDE = 32, 256


def fingerprint(text: str | None, words: int = 4) -> int:
    """Unsigned 64-bit fingerprint of a whole text."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    if len(w) <= words:
        grams = [b" ".join(w)]
    else:
        grams = map(b" ".join, zip(*(w[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, 42) for g in grams], np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) for each row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class Block:
    """Bits shift..shift+width of a fingerprint, with a Hamming code on the first 2**checks - 1 of them, and a share of the threshold."""

    def __init__(self, shift: int, width: int, checks: int, share: int):
        self.shift, self.width, self.share = shift, width, share
        self.length = (1 << checks) - 1
        self.masks = [sum(1 << i for i in range(self.length) if i + 1 >> j & 1) for j in range(checks)]
        #: for each syndrome, the changes of at most RADIUS + share bits that lead to an anchor
        found: list[list[int]] = [[] for _ in range(self.length + 1)]
        for k in range(RADIUS + share + 1):
            for bits in combinations(range(width), k):
                at = 0
                for i in bits:
                    at ^= i + 1 if i < self.length else 0
                found[at].append(sum(1 << i for i in bits))
        self.changes = [np.array(x, np.int64) for x in found]
        self.places = sum(map(len, found)) / len(found)
        self.anchors = 1 << width - checks

    def values(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block's bits of each fingerprint, and their syndrome: the number of the wrong bit, 0 at an anchor."""
        v = (fps.view(np.uint64) >> np.uint64(self.shift)).astype(np.int64) & ((1 << self.width) - 1)
        return v, sum((np.bitwise_count(v & m).astype(np.int64) & 1) << j for j, m in enumerate(self.masks))


@lru_cache(1000)
def layout(bits: int, rows: int) -> list[Block]:
    """The cheapest blocks for so many distinct fingerprints.

    Whatever the number n of blocks, their shares add up to bits + 1 - n, so fingerprints within `bits` differ by at
    most its share in one of them. Fewer and wider blocks have more places for a fingerprint, and far more anchors;
    so the number of comparisons for each fingerprint needn't grow with the number of fingerprints.
    """
    def laid(n: int, checks: int) -> list[Block]:
        spare, edges = bits + 1 - n, [64 * i // n for i in range(n + 1)]
        return [Block(a, b - a, checks, spare // n + (i < spare % n)) for i, (a, b) in enumerate(zip(edges, edges[1:]))]

    def cost(found: list[Block]) -> float:
        return sum(b.places * (PLACE + rows / b.anchors) for b in found)

    # codes that fit the width, and no more changes than can be listed
    fits = [laid(n, c) for n in range(2, min(bits + 1, 8) + 1) for c in range(2, 6) if (1 << c) - 1 <= 64 // n and comb(64 // n + 1, RADIUS + -(-(bits + 1 - n) // n)) <= 300_000]
    return min(fits or [[Block(0, 32, 3, bits)]], key=cost)  # equal ones are equal in any bits


def placed(fps: np.ndarray, blocks: list[Block], visits: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, roles (0 resident, 1 visitor) and fingerprints of all places of the given ones, or of their homes only."""
    keys, roles, which = [], [], []
    for number, b in enumerate(blocks):
        v, s = b.values(fps)
        keys.append((v ^ np.where(s > 0, 1 << np.maximum(s - 1, 0), 0)) | number << 40)
        roles.append(np.zeros(len(v), np.int8))
        which.append(fps)
        for k, changes in enumerate(b.changes if visits else ()):
            own = np.flatnonzero(s == k)
            keys.append(((v[own][:, None] ^ changes) | number << 40).ravel())
            roles.append(np.ones(len(own) * len(changes), np.int8))
            which.append(np.repeat(fps[own], len(changes)))
    return np.concatenate(keys), np.concatenate(roles), np.concatenate(which)


class AnchorLinks:
    """Links within anchors, from rows sorted by anchor and share with residents first."""

    def __init__(self, bits: int):
        self.bits = bits
        self.key = self.share = None
        self.fp = np.zeros(0, np.int64)
        self.root = np.zeros(0, np.int64)

    def _same(self, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
        """Unite residents a and b; the unions that were new."""
        while (todo := self.root[a] != self.root[b]).any():
            a, b = a[todo], b[todo]
            x, y = self.root[a], self.root[b]
            hi, lo = np.maximum(x, y), np.minimum(x, y)
            hi, first = np.unique(hi, return_index=True)
            yield from zip(hi, lo[first])
            self.root[hi] = lo[first]
            while (deeper := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = deeper

    def _dense(self, first: int, last: int, visitors: np.ndarray, fp: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Links of one anchor's visitors with its residents, rows first..last, by growing shares of the visitors.

        A visitor is compared with all residents outside the largest united group, and with that group's members
        until it meets one; that it may meet itself there is right, too.
        """
        u, at, size, out_a, out_b = fp.view(np.uint64), 0, 16, [], []
        others, members = np.arange(first, last), np.zeros(0, np.int64)
        while at < len(visitors):
            todo = visitors[at : at + max(1, min(size, CHUNK // max(STRIDE, len(others))))]
            at, size = at + len(todo), 2 * size
            who, which = np.nonzero(np.bitwise_count(u[todo][:, None] ^ u[others]) <= self.bits)
            left, right = [others[which]], [todo[who]]
            for k in range(0, len(members), STRIDE):
                if not len(todo):
                    break
                some = members[k : k + STRIDE]
                near = np.bitwise_count(u[todo][:, None] ^ u[some]) <= self.bits
                met = near.any(1)
                left.append(some[near[met].argmax(1)])
                right.append(todo[met])
                todo = todo[~met]
            left, right = np.concatenate(left), np.concatenate(right)
            if not len(left):
                continue
            right, one, again = np.unique(right, return_index=True, return_inverse=True)
            out_a.append(fp[left[one]])
            out_b.append(fp[right])
            same = list(self._same(left[one][again], left))
            if same:
                out_a.append(fp[[x for x, _ in same]])
                out_b.append(fp[[y for _, y in same]])
                roots, inside, count = np.unique(self.root[first:last], return_inverse=True, return_counts=True)
                largest = inside == count.argmax()
                members, others = first + np.flatnonzero(largest), first + np.flatnonzero(~largest)
        return out_a, out_b

    def add(self, key: np.ndarray, share: np.ndarray, role: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links that a batch adds. The residents of its last group stay for the next batch."""
        n0 = len(self.fp)
        if n0:
            key = np.concatenate([np.full(n0, self.key), key])
            share = np.concatenate([np.full(n0, self.share), share])
            role = np.concatenate([np.zeros(n0, role.dtype), role])
            fp = np.concatenate([self.fp, fp])
        n = len(key)
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (share[1:] != share[:-1])])
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        residents = np.concatenate([[0], np.cumsum(role == 0)])
        self.root = np.concatenate([self.root, np.arange(n0, n)])
        out_a, out_b = [], []
        visitor = np.flatnonzero(role == 1)
        count = residents[visitor] - residents[start[visitor]]
        crowd = visitor[count >= DENSE]
        at = np.flatnonzero(np.diff(start[crowd], prepend=-1))
        for own in np.split(crowd, at[1:]) if len(crowd) else ():
            head = int(start[own[0]])
            a, b = self._dense(head, head + int(residents[own[0]] - residents[head]), own, fp)
            out_a, out_b = out_a + a, out_b + b
        few = (count > 0) & (count < DENSE)
        visitor, count = visitor[few], count[few]
        u, at, total = fp.view(np.uint64), 0, np.cumsum(count)
        while at < len(visitor):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CHUNK, "right")))
            v, c = visitor[at:to], count[at:to]
            right = np.repeat(v, c)
            left = np.arange(len(right)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(start[v], c)
            ok = (np.bitwise_count(u[left] ^ u[right]) <= self.bits) & (u[left] < u[right])
            left, right = left[ok], right[ok]
            if len(left):
                right, first, again = np.unique(right, return_index=True, return_inverse=True)
                out_a.append(fp[left[first]])
                out_b.append(fp[right])
                same = list(self._same(left[first][again], left))
                out_a.append(fp[[x for x, _ in same]])
                out_b.append(fp[[y for _, y in same]])
            at = to
        last = int(start[-1])
        keep = last + int(residents[n] - residents[last])
        self.key, self.share, self.fp = key[-1], share[-1], fp[last:keep]
        self.root = self.root[last:keep] - last
        none = np.zeros(0, np.int64)
        a, b = np.concatenate([none, *out_a]), np.concatenate([none, *out_b])
        return a[a != b], b[a != b]


def links(fps: DataFrame, bits: int, rows: int | None = None) -> DataFrame:
    """Links (a, b) that connect all of the distinct fingerprints fp within `bits` of each other; rows: their number."""
    blocks = layout(bits, fps.count() if rows is None else rows)

    def place(visits: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key, role, fp = placed(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), blocks, visits)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(role), pa.array(fp)], names=["anchor", "role", "fp"])

        return fps.select("fp").mapInArrow(run, "anchor long, role byte, fp long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = AnchorLinks(bits)
        for batch in batches:
            if batch.num_rows:
                a, b = state.add(*(batch.column(k).to_numpy(zero_copy_only=False) for k in ("anchor", "share", "role", "fp")))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    places = place(True)
    crowd = saved(place(False).groupBy("anchor").count().filter(F.col("count") > RESIDENTS), "crowded")
    # at most len(blocks) * rows / RESIDENTS anchors are crowded; the planner broadcasts them if they are few
    shares = crowd.select("anchor", F.ceil(F.col("count") / RESIDENTS).cast("int").alias("shares"))
    if crowd.isEmpty():
        spread = places.withColumn("share", F.lit(0))
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("shares")).cast("int")
        spread = (
            places.join(shares, "anchor", "left")
            .withColumn("shares", F.coalesce("shares", F.lit(1)))
            .withColumn("share", F.explode(F.when(F.col("role") == 0, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("shares") - 1))))
        )
    rows = spread.select("anchor", "share", "role", "fp").repartition("anchor", "share").sortWithinPartitions("anchor", "share", "role")
    return rows.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, bits: int = 4, words: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    rows = saved(fingerprints(docs, words), "fingerprints")
    fps = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    found = saved(components(links(fps, bits)).withColumnRenamed("node", "fp"), "found")
    known = saved(fps.join(found, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "known")
    ids = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = saved(known.join(ids, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")
