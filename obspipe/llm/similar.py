"""One document of each group of near copies: SimHash candidates by anchors, verified on the texts.

A document is the set of its shingles of five words (a shorter text is one shingle). Documents of the same set are
one node from the start. A node has a fingerprint of BITS bits; sets of Jaccard similarity 0.8 have a cosine of 0.89
at least and differ in a share of 0.15 of the bits, on average.

In each block, a choice of 15 bits and `more` others, the anchors are the words of the perfect Hamming code on the 15
bits, times all values of the others. A fingerprint goes to every anchor within the covering radius of 1 plus the
block's threshold, which is 0 here: to one. The number of further bits keeps about CROWD fingerprints at an anchor,
whatever the number of documents, and the number of blocks brings pairs of the wanted similarity together with
probability RECALL. At an anchor each fingerprint first proposes MATCHES of the others that differ from it by at
most `most_bits`; these pairs are joined with the shingle sets, those of the exact Jaccard similarity are links, and
they merge most of what belongs together. Then each fingerprint that is near one of another group goes to its anchors
once more, with its shingle set. There all such pairs that aren't in one group yet are compared where they lie, so no
link between documents that meet is lost, and a group of texts that are near each other but not similar makes a row
for each of its texts and anchors, never one for each pair. An anchor of more than SHARE fingerprints, or of sets of
more than HELD shingles, is split into shares, each of which sees all of the anchor as a stream.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, joined_if_small, numbered, saved, slices
from .components import similar_pairs, verified_groups
from .hashing import ODD, Words, mixed

LANES = 4
BITS = 64 * LANES
CODE = 15
RECALL = 0.98
#: Fingerprints of an anchor on average, and of a share of an anchor at most, about.
CROWD, SHARE = 128, 20_000
#: Shingles of a share of an anchor at most, about, where sets are compared; and those that are looked up at once.
HELD, LOOKED_UP = 2_000_000, 1 << 20
#: Pairs that a fingerprint proposes at an anchor before all others are proposed.
MATCHES = 2
#: Pairs that leave a task together, about.
TOGETHER = 1 << 17
#: Pairs compared at once.
CHUNK = 1 << 20
#: Rows that are broadcast at most.
BROADCAST = 2_000_000
PRINT = [f"p{i}" for i in range(LANES)]
PLACED = "anchor long, node long, root long, " + ", ".join(f"{p} long" for p in PRINT)


def difference(similarity: float) -> float:
    """The share of bits in which sets of a Jaccard similarity differ on average, at most (sets of equal size)."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_bits(similarity: float) -> int:
    """Differing bits of a pair that is verified at most: two and a half deviations above the mean of pairs just similar."""
    p = difference(similarity)
    return round(BITS * p + 2.5 * math.sqrt(BITS * p * (1 - p)))


def meeting(p: float, more: int) -> float:
    """The probability that two fingerprints, each bit of which differs with probability p, have the same anchor in a block."""
    near = [math.comb(CODE, d) * p**d * (1 - p) ** (CODE - d) for d in range(3)]
    # one of two neighbours is the anchor; or both are its neighbours
    return (near[0] + near[1] * 2 / (CODE + 1) + near[2] * 2 / (CODE + 1)) * (1 - p) ** more


def layout(nodes: int, similarity: float) -> tuple[int, int]:
    """(blocks, further bits of a block) for so many fingerprints."""
    more = max(0, math.ceil(math.log2(max(1, nodes) / CROWD)) - CODE + 4)
    return math.ceil(math.log(1 - RECALL) / math.log(1 - meeting(difference(similarity), more))), more


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    found = Words(text or "")
    n = len(found.w)
    return np.unique(found.shingles(words) if n > words else found.runs(np.zeros(min(n, 1), np.int64), np.full(min(n, 1), n)))


def set_prints(sets: list[np.ndarray]) -> np.ndarray:
    """Fingerprints of sets, a row of LANES words each: a bit is 1 if more than half of the set's hashes have it."""
    out = np.zeros((len(sets), LANES), np.uint64)
    for i, h in enumerate(sets):
        bits = np.zeros((LANES, 64), np.int64)
        for at in range(0, len(h), 1 << 14):
            for lane in range(LANES):
                x = mixed(h[at : at + (1 << 14)] * ODD + np.uint64(lane))
                bits[lane] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
        out[i] = np.packbits(2 * bits > len(h), axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def prints(docs: DataFrame, words: int) -> DataFrame:
    """(uid, doc_id, node, fingerprint) for each row of docs (uid, doc_id, text); node 0 stands for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            sets = [shingle_set(t.as_py(), words) for t in batch.column(2)]
            node = np.array([xxhash.xxh64_intdigest(h.tobytes()) if len(h) else 0 for h in sets], np.uint64).view(np.int64)
            lanes = [pa.array(x) for x in set_prints(sets).view(np.int64).T]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), *lanes], names=["uid", "doc_id", "node", *PRINT])

    return docs.mapInArrow(run, "uid long, doc_id long, node long, " + ", ".join(f"{p} long" for p in PRINT))


def shingles(docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles) for each row of docs (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            sets = [shingle_set(t.as_py(), words) for t in batch.column(0)]
            node = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles array<long>")


def anchors(fps: np.ndarray, blocks: int, more: int) -> np.ndarray:
    """The anchor of each fingerprint (rows) in each block (columns)."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little").astype(np.int64)
    order = np.concatenate([np.random.default_rng(i).permutation(BITS) for i in range(-(-blocks * (CODE + more) // BITS))])
    out = np.zeros((len(fps), blocks), np.int64)
    for b in range(blocks):
        own = bits[:, order[b * (CODE + more) : (b + 1) * (CODE + more)]]
        value = own @ (1 << np.arange(CODE + more))
        wrong = np.bitwise_xor.reduce(own[:, :CODE] * np.arange(1, CODE + 1), axis=1)
        out[:, b] = (value ^ np.where(wrong > 0, 1 << np.maximum(wrong - 1, 0), 0)) | b << 48
    return out


def proposals(node: np.ndarray, root: np.ndarray, fp: np.ndarray, residents: int, among: bool, most: int, matches: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group's rows, in pieces: the first `matches` of the residents of another root that are near a row, or all (None).

    The residents are the first rows of the group; they stand in the order of the nodes. `among`: the residents
    themselves propose, each to those before it; otherwise the other rows do.
    """
    order = np.argsort(node[:residents], kind="stable")
    own, own_root, own_fp = node[:residents][order], root[:residents][order], fp[:residents][order]
    asking = order if among else np.arange(residents, len(node))
    if len(asking) and (root == root[0]).all():
        return
    step = max(1, CHUNK // max(1, residents))
    for at in range(0, len(asking), step):
        who = asking[at : at + step]
        before = own_fp[: at + step] if among else own_fp
        near = np.zeros((len(who), len(before)), np.int16)
        for k in range(LANES):
            near += np.bitwise_count(fp[who, k][:, None] ^ before[:, k])
        x, y = np.nonzero(near <= most)
        good = (root[who[x]] != own_root[y]) & (y < at + x if among else True)
        x, y = x[good], y[good]
        if matches:
            first = np.arange(len(x)) - np.searchsorted(x, x) < matches
            x, y = x[first], y[first]
        a, b = node[who[x]], own[y]
        yield np.minimum(a, b), np.maximum(a, b)


def near_links(sets: list[np.ndarray], node: np.ndarray, root: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of a group's rows that join all that the similar ones of the proposed pairs join, one fewer than they join at most."""
    ends = np.cumsum([0, *map(len, sets)])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    marked, label = np.zeros(len(values), bool), np.unique(root, return_inverse=True)[1]
    place, found = np.argsort(node, kind="stable"), []
    for a, b in pairs:
        x, y = (place[np.searchsorted(node, v, sorter=place)] for v in (a, b))
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        for own in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x)) + 1) if len(x) else ():
            me = x[own[0]]
            mine = at[ends[me] : ends[me + 1]]
            marked[mine] = True
            size = np.cumsum(ends[y[own] + 1] - ends[y[own]])
            for others in np.split(y[own], np.flatnonzero(np.diff(size // LOOKED_UP)) + 1):
                others = others[label[others] != label[me]]
                if not len(others):
                    continue
                n = ends[others + 1] - ends[others]
                both = np.add.reduceat(marked[np.concatenate([at[ends[o] : ends[o + 1]] for o in others])], np.cumsum(n) - n, dtype=np.int64)
                others = others[both >= similarity * (len(mine) + n - both) - 1e-9]
                joined, first = np.unique(label[others], return_index=True)
                if len(joined):
                    found += [(node[me], node[o]) for o in others[first]]
                    label[np.isin(label, joined)] = label[me]
            marked[mine] = False
    return tuple(np.array(found, np.int64).reshape(-1, 2).T)


def placed(nodes: DataFrame, blocks: int, more: int) -> DataFrame:
    """(anchor, node, root, fingerprint) for each anchor of each of the nodes: node, root, fingerprint."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                fps = np.stack([part.column(p).to_numpy().view(np.uint64) for p in PRINT], 1)
                rows = pa.array(np.repeat(np.arange(part.num_rows), blocks))
                at = pa.array(anchors(fps, blocks, more).ravel())
                yield pa.RecordBatch.from_arrays([at, *(part.column(c).take(rows) for c in ("node", "root", *PRINT))], names=["anchor", "node", "root", *PRINT])
        give_back()

    return nodes.select("node", "root", *PRINT).mapInArrow(place, PLACED)


def dealt(places: DataFrame, weight: Column, limit: int) -> DataFrame:
    """places with share and side, sorted by anchor, share and side. An anchor whose weights come to more than the limit
    is split into shares, with a group for each two shares and for each share by itself; side tells the shares apart."""
    # the anchors to be split are few; places are read once more for them, as they are cheaper to find than to store
    crowd = saved(places.groupBy("anchor").agg(F.sum(weight).alias("all")).filter(F.col("all") > limit), "crowded")
    if crowd.isEmpty():
        spread = places.withColumns({"share": F.lit(0), "side": F.lit(0)})
    else:
        shares = crowd.select("anchor", F.ceil(F.col("all") / limit).alias("shares"))
        own = F.pmod(F.xxhash64("node"), F.col("shares"))
        both = F.transform(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1), lambda j: F.struct(
            (F.shiftleft(F.least(own, j), 16) + F.greatest(own, j)).alias("share"), (own > j).cast("int").alias("side")))
        spread = places.join(joined_if_small(shares, BROADCAST), "anchor", "left").withColumn("shares", F.coalesce("shares", F.lit(1).cast("long")))
        spread = spread.select(*places.columns, F.inline(both))
    return spread.repartition("anchor", "share").sortWithinPartitions("anchor", "share", "side")


def compared(rows: DataFrame, most: int, matches: int | None, result: Callable, schema: str) -> DataFrame:
    """What `result` makes of the groups of rows (anchor, share, side, node, root, fingerprint, perhaps more), two columns of numbers.

    result(a group's columns, its pairs in pieces: see `proposals`) gives such columns in pieces.
    """
    names = rows.columns
    out = [c.split()[0] for c in schema.split(", ")]

    def batch_of(found: list) -> pa.RecordBatch:
        one, other = (np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 2, *found))
        return pa.RecordBatch.from_arrays([pa.array(one), pa.array(other)], names=out)

    def each(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """rows: whole groups, one after the other, residents first."""
        edge = np.flatnonzero((np.diff(rows["anchor"]) != 0) | (np.diff(rows["share"]) != 0)) + 1
        fp = np.stack([rows[p].view(np.uint64) for p in PRINT], 1)
        found, size = [], 0
        for a, b in zip([0, *edge], [*edge, len(fp)]):
            if b - a > 1:
                visitors = int(rows["side"][a:b].sum())
                among = rows["share"][a] % (1 << 16) == rows["share"][a] >> 16
                if among or 0 < visitors < b - a:
                    pairs = proposals(rows["node"][a:b], rows["root"][a:b], fp[a:b], b - a - visitors, among, most, matches)
                    for piece in result({c: x[a:b] for c, x in rows.items()}, pairs):
                        found.append(piece)
                        size += len(piece[0])
                        if size >= TOGETHER:
                            yield batch_of(found)
                            found, size = [], 0
        yield batch_of(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last group, which may go on; it has two shares of an anchor at most
        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            rows = {c: np.concatenate([held[c], x]) for c, x in rows.items()} if held else rows
            edge = np.flatnonzero((np.diff(rows["anchor"]) != 0) | (np.diff(rows["share"]) != 0))
            cut = int(edge[-1]) + 1 if len(edge) else 0
            held = {c: x[cut:] for c, x in rows.items()}
            if cut:
                yield from each({c: x[:cut] for c, x in rows.items()})
        if held and len(held["anchor"]):
            yield from each(held)
        give_back()

    return rows.mapInArrow(run, schema).distinct()


def proposed(nodes: DataFrame, blocks: int, more: int, most: int, whole: bool) -> DataFrame:
    """Pairs (a, b) of nodes of different roots that are near each other at an anchor, a few for each or (whole) all; nodes: node, root, fingerprint."""
    return compared(dealt(placed(nodes, blocks, more), F.lit(1), SHARE), most, None if whole else MATCHES, lambda rows, pairs: pairs, "a long, b long")


def crossing(nodes: DataFrame, blocks: int, more: int, most: int) -> DataFrame:
    """(anchor, node) of the nodes that are near one of another root at an anchor; nodes: node, root, fingerprint."""

    def meet(rows: dict[str, np.ndarray], pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        met = np.zeros(0, np.int64)
        for a, b in pairs:
            met = np.union1d(met, np.concatenate([a, b]))
        yield np.full(len(met), rows["anchor"][0]), met

    return compared(dealt(placed(nodes, blocks, more), F.lit(1), SHARE), most, None, meet, "anchor long, node long")


def links_at_anchors(nodes: DataFrame, crosses: DataFrame, sets: DataFrame, most: int, similarity: float) -> DataFrame:
    """Links (a, b) that join all similar nodes of different roots that are near each other at an anchor.

    nodes: node, root, fingerprint; crosses: anchor, node, from `crossing`; sets: node, shingles. A row stands for a node at an anchor, never for a pair.
    """
    places = crosses.join(nodes.select("node", "root", *PRINT), "node").join(sets, "node").select("anchor", "node", "root", *PRINT, "shingles")

    def link(rows: dict[str, np.ndarray], pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield near_links(rows["shingles"], rows["node"], rows["root"], pairs, similarity)

    return compared(dealt(places, F.size("shingles"), HELD), most, None, link, "a long, b long")


def groups(docs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame | None:
    """(node, root) of all nodes with a link; None if there are none. nodes: node, uid of a row, fingerprint; docs: uid, text."""
    blocks, more = layout(nodes.count(), similarity)
    most = most_bits(similarity)

    def sets_of(some: DataFrame) -> DataFrame:
        wanted = saved(nodes.join(some.distinct(), "node", "left_semi").select("uid"), "wanted")
        return saved(shingles(docs.join(joined_if_small(wanted, BROADCAST), "uid", "left_semi").select("text"), words), "sets")

    def check(pairs: DataFrame) -> DataFrame:
        return similar_pairs(pairs, sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b"))), similarity)

    def rest(rooted: DataFrame) -> DataFrame:
        crosses = saved(crossing(rooted, blocks, more, most), "crosses")
        return links_at_anchors(rooted, crosses, sets_of(crosses.select("node")), most, similarity)

    return verified_groups(nodes, lambda asking, whole: proposed(asking, blocks, more, most, whole), check, rest)


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the rows whose text is similar to a kept one's; of each group of linked texts one row stays.

    It is the row of the smallest doc_id, null being the last, and the first read of those. Texts without words, null
    ones too, are one group. Rows count each for itself, so repeated doc_ids lose no row of another text. Columns
    stay as they are, whatever their names and types; an empty table gives an empty result.
    """
    rows, uid = numbered(docs, "numbered")
    doc_id = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    texts = rows.select(F.col(uid).alias("uid"), doc_id.alias("doc_id"), "text")
    each = saved(prints(texts, words), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("row")
    nodes = saved(each.filter("node <> 0").groupBy("node").agg(first, *[F.first(p).alias(p) for p in PRINT]), "nodes")
    found = groups(texts.select("uid", "text"), nodes.select("node", F.col("row.uid").alias("uid"), *PRINT), words, similarity)
    if found is None:
        kept = nodes.select("row.uid")
    else:
        roots = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
        kept = roots.groupBy("root").agg(F.min("row").alias("row")).select("row.uid")
    blank = each.filter("node = 0").agg(first).filter("row is not null").select("row.uid")
    gone = saved(each.select("uid").join(kept.union(blank), "uid", "left_anti"), "gone").withColumnRenamed("uid", uid)
    return rows.join(joined_if_small(gone, BROADCAST), uid, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
