"""Substring dedup: repeated paragraphs by MinHash banding, and repeated passages inside paragraphs.

A-Z are lower-cased and words are runs of non-space characters. Units of a document are
 - its lines of at least MIN_WORDS words, the paragraphs. Their five-word shingles are min-hashed; `tune`
   chooses bands and rows so that pairs of the wanted similarity meet with the wanted recall. Paragraphs
   that collide in a band are joined and verified by the exact Jaccard similarity of their shingles;
   verified links are clustered into components;
 - its segments, so that a passage set into the middle of another paragraph is found too: a cut stands
   where the hash of two neighbouring words is the least (the last of equal ones) of any REACH in a row, and
   a segment leads from each cut to the first one MIN_RUN words on, so segments overlap. A shared passage
   of n words is cut alike wherever it stands from its first REACH places to its last, over n - 2 * REACH
   words at least: a passage of over 50 words has a whole segment. Segments are matched exactly, and each is
   kept or removed by itself; a word in segments of both kinds is removed here, as an earlier document has it.
Lines of MIN_SHORT to MIN_WORDS words, as banners and licence lines, are matched exactly and told apart from the rest.
A component (or an exact class of segments or short lines) that occurs in two or more documents is repeated; it is kept in
the first of them, in the order of the input's rows, and marked for removal in all others.

Equal units are one node from the start, so groups of copies are counted, never paired. Of a band only
buckets with two or more different paragraphs go on. In a bucket each paragraph is first paired with a few pivots, which
an aggregation chooses; then all paragraphs that have met another and may be similar by their rarest shingles
(`prefix_pairs`) are paired and verified, unless they are in one group. So no link between them is lost, and unlike
paragraphs of a crowded bucket aren't paired.

Null and empty texts have no units. Repeated rows count as documents of their own. A null doc_id
stays null. Repeats within one document only are left alone. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, saved, temporary
from .components import similar_pairs, verified_groups
from .hashing import ODD, Words, mixed

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.98
MIN_WORDS, REACH, MIN_RUN, MIN_SHORT = 20, 13, 25, 4
#: Shingles that are min-hashed together.
TOGETHER = 1 << 16
#: Lines of a bucket that each of its lines is paired with before all others are.
PIVOTS = 3
#: Rows of a side table that are broadcast at most.
BROADCAST = 200_000
LINE, SEGMENT, DOC, SHORT = 0, 1, 2, 3
#: Stands for a null doc_id inside.
NONE = -(1 << 63)
UNITS = "doc_id long, uid long, kind byte, no int, first int, last int, h long, bands array<long>"


def tune(similarity: float = SIMILARITY, recall: float = RECALL, unlike: float = 0.2, rare: float = 0.02) -> tuple[int, int]:
    """(bands, rows): the fewest hashes with which similar pairs meet with the wanted recall, and pairs of similarity `unlike` rarely."""
    for rows in range(1, 20):
        bands = ceil(log(1 - recall) / log(1 - similarity**rows))
        if 1 - (1 - unlike**rows) ** bands <= rare:
            return bands, rows
    raise ValueError("no bands tell such similarities apart")


class Units(Words):
    """The paragraphs and segments of a text."""

    def lines(self, least: int = MIN_WORDS, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        first, last = self.ends[:-1], self.ends[1:]
        wanted = (last - first >= least) & (last - first < (most or 1 << 62))
        return first[wanted], last[wanted]

    def segments(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.w) - 1
        if n < REACH:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        g = mixed(self.w[:-1] * ODD + self.w[1:])
        least, cut = g[: n - REACH + 1].copy(), np.arange(n - REACH + 1)
        for k in range(1, REACH):
            here = g[k : n - REACH + 1 + k]
            cut = np.where(here <= least, np.arange(k, len(here) + k), cut)
            np.minimum(least, here, out=least)
        cut = cut[np.diff(cut, prepend=-1) > 0]
        end = np.searchsorted(cut, cut + MIN_RUN)
        whole = end < len(cut)
        return cut[whole], cut[end[whole]]


def units(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """All units of all documents, and a row of kind DOC for each document (last: its words)."""
    rng = np.random.default_rng(11)
    factor = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    term = rng.integers(0, 1 << 63, bands * rows, np.uint64)

    def signatures(s: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The bands' hashes of runs [first, last) of shingles, a row for each run."""
        at = np.stack([first, last], 1).ravel()
        at = at[:-1] if len(at) and at[-1] >= len(s) else at
        out = np.zeros((len(first), bands), np.uint64)
        for k in range(bands * rows if len(first) else 0):
            least = np.minimum.reduceat(s * factor[k] + term[k], at)[::2]
            out[:, k // rows] = mixed(out[:, k // rows] * ODD + least + np.uint64(k // rows))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            sig, has = [], []
            ready, ends, size = [], [], 0  # shingles of documents in a row, and their lines there, hashed together
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = Units(text.as_py() or "")
                each = ((LINE, words.lines()), (SEGMENT, words.segments()), (SHORT, words.lines(MIN_SHORT, MIN_WORDS)), (DOC, (np.array([0]), np.array([len(words.w)]))))
                for kind, (first, last) in each:
                    n = len(first)
                    h = words.runs(first, last) if kind != DOC else np.array([uid], np.uint64)
                    for c, x in zip(cols, (np.full(n, NONE if doc_id is None else doc_id), np.full(n, uid), np.full(n, kind, np.int8), np.arange(n, dtype=np.int32), first, last, h.view(np.int64))):
                        c.append(x)
                    has.append(np.full(n, bands if kind == LINE else 0))
                    if kind == LINE and n:
                        ready.append(words.shingles(SHINGLE))
                        ends.append(np.stack([first, last - SHINGLE + 1]) + size)
                        size += len(ready[-1])
                if size >= TOGETHER:
                    sig.append(signatures(np.concatenate(ready), *np.concatenate(ends, axis=1)).ravel())
                    ready, ends, size = [], [], 0
                uid += 1
            if size:
                sig.append(signatures(np.concatenate(ready), *np.concatenate(ends, axis=1)).ravel())
            if not cols[0]:
                continue
            flat = [np.concatenate(c) for c in cols]
            at = np.concatenate([[0], np.cumsum(np.concatenate(has))])
            values = np.concatenate([np.zeros(0, np.uint64), *sig]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))
            kinds = (pa.int64(), pa.int64(), pa.int8(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            arrays = [pa.array(x.astype(k.to_pandas_dtype()), k) for x, k in zip(flat, kinds)]
            yield pa.RecordBatch.from_arrays([*arrays, lists], names=["doc_id", "uid", "kind", "no", "first", "last", "h", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, UNITS)


def line_shingles(docs: DataFrame) -> DataFrame:
    """(h, shingles) of all lines of docs; shingles are sorted and distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, sets = [], []
            for text in batch.column(0):
                words = Units(text.as_py() or "")
                first, last = words.lines()
                s = words.shingles(SHINGLE).view(np.int64)
                h += words.runs(first, last).view(np.int64).tolist()
                sets += [np.unique(s[a : b - SHINGLE + 1]) for a, b in zip(first, last)]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["h", "shingles"])

    return docs.select("text").mapInArrow(run, "h long, shingles array<long>")


def sided(side: DataFrame) -> DataFrame:
    """side, broadcast if it has few rows; otherwise joined by sort-merge, however few bytes its files have, so that the
    plan of a table is that of all larger ones and the driver holds no table that grows with the input."""
    return F.broadcast(side) if side.limit(BROADCAST + 1).count() <= BROADCAST else side.hint("merge")


def pivoted(asking: DataFrame) -> DataFrame:
    """Pairs (a, b) of each line with a few pivots of each of its buckets; no bucket is gathered anywhere."""
    chosen = [F.min_by("node", F.xxhash64("node", F.lit(salt))).alias(f"node{salt}") for salt in range(PIVOTS)]
    pivots = asking.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), *chosen).filter("lo <> hi")
    each = F.explode(F.array(*[F.col(f"node{salt}") for salt in range(PIVOTS)])).alias("other")
    pairs = asking.join(pivots, "bucket").select("node", each).filter("node <> other")
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def prefix_pairs(asking: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different roots that have all pairs of the Jaccard similarity among them; asking: node, root; sets: node, shingles.

    Of two sets of sizes m <= n that are similar, in the order of their shingles' frequency, rarest first, one of the first
    m - ceil(2 s m / (1 + s)) + 1 of the smaller is one of the first n - ceil(s n) + 1 of the larger. So sets are joined on
    these few shingles only, and shingles that one set alone has, which come first, make no rows.
    """
    sized = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("token"))
    often = saved(sized.groupBy("token").count().filter("count > 1"), "often")
    listed = sized.join(sided(often), "token").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("count", "token"))).alias("shared"))
    first = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-6).cast("int") + 1
    listed = listed.withColumn("own", F.col("n") - F.size("shared"))
    listed = listed.withColumn("shared", F.slice("shared", F.lit(1), F.greatest(F.lit(0), first(similarity) - F.col("own"))))
    rooted = asking.select("node", "root").distinct()
    places = listed.select("node", "n", first(2 * similarity / (1 + similarity)).alias("short"), "own", F.posexplode("shared").alias("i", "x"))
    places = saved(places.join(rooted, "node").select("node", "n", "root", F.col("x.token").alias("token"), (F.col("own") + F.col("i") < F.col("short")).alias("early")), "places")
    less = places.filter("early").select("token", F.col("node").alias("a"), F.col("n").alias("m"), F.col("root").alias("one"))
    pairs = less.join(places.withColumnRenamed("node", "b"), "token").filter((F.struct("m", "a") < F.struct("n", "b")) & (F.col("m") >= F.col("n") * similarity - 1e-6) & (F.col("one") != F.col("root")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def line_groups(docs: DataFrame, lines: DataFrame, similarity: float) -> DataFrame | None:
    """(node, root) of the lines that are similar to another one; lines: h, doc_id of a holder, bands."""
    banded = lines.select("h", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("bucket")
    meets = saved(banded.join(sided(saved(shared, "shared")), "bucket").distinct().withColumnRenamed("h", "node"), "meets")
    wanted = saved(meets.select(F.col("node").alias("h")).distinct(), "wanted")
    ids = saved(lines.join(sided(wanted), "h", "left_semi").select("doc_id").distinct(), "ids")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("doc_id"), "text").join(sided(ids), "doc_id", "left_semi")
    sets = line_shingles(texts).join(sided(wanted), "h", "left_semi")
    sets = saved(sets.groupBy("h").agg(F.first("shingles").alias("shingles")).withColumnRenamed("h", "node"), "sets")

    def propose(asking: DataFrame, whole: bool) -> DataFrame:
        return prefix_pairs(asking, sets, similarity) if whole else pivoted(asking)

    return verified_groups(meets, propose, lambda pairs: similar_pairs(pairs, sets, similarity))


def repeats(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Every occurrence of a repeated unit: doc_id, uid, kind, no, first, last (words), keep, holder (a doc_id).

    Rows of kind DOC stand for the documents themselves; only they have a doc_id.
    """
    bands, per = tune(similarity, recall)
    found = saved(units(docs, bands, per), "units")
    span = [F.min("uid").alias("lo"), F.max("uid").alias("hi"), F.min_by("doc_id", "uid").alias("holder")]
    exact = found.filter(F.col("kind").isin(SEGMENT, SHORT)).groupBy("kind", "h").agg(*span).filter("lo < hi").select("kind", "h", "lo", "holder")
    lines = saved(found.filter(F.col("kind") == LINE).groupBy("h").agg(*span, F.first("bands").alias("bands")), "lines")
    # what the lines' groups were found with is deleted before the passages take their place on the disks
    with temporary(docs.sparkSession) as keep:
        roots = line_groups(docs, lines.select("h", F.col("holder").alias("doc_id"), "bands"), similarity)
        if roots is not None:
            keep(roots)
    spent = [lines]
    if roots is None:
        alike = lines.filter("lo < hi").select("h", "lo", "holder")
    else:
        rooted = saved(lines.drop("bands").join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h")), "rooted")
        whole = rooted.groupBy("root").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min_by("holder", "lo").alias("holder")).filter("lo < hi")
        alike = rooted.select("h", "root").join(whole, "root").select("h", "lo", "holder")
        spent += [roots, rooted]
    classes = saved(exact.union(alike.select(F.lit(LINE).cast("byte").alias("kind"), "h", "lo", "holder")), "repeated")
    discard(*spent)
    at = found.drop("bands").join(sided(classes), ["kind", "h"])
    at = at.select(F.lit(None).cast("long").alias("doc_id"), "uid", "kind", "no", "first", "last", (F.col("uid") == F.col("lo")).alias("keep"), "holder")
    own = found.filter(F.col("kind") == DOC).select("doc_id", "uid", "kind", "no", "first", "last", F.lit(True).alias("keep"), F.lit(None).cast("long").alias("holder"))
    return at.union(own)


def dedup(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, n_words, repeated, n_repeated and n_removed words, spans, holders, n_short, short_spans.

    spans: [first, last) words of repeated paragraphs and passages and whether they are kept here;
    holders: doc_ids of the documents in which those units stand first. n_short, short_spans: words of short lines that
    an earlier document has, and the short lines that repeat; they don't count as repeated passages.
    """
    rows = repeats(docs, similarity, recall)
    order = Window.partitionBy("uid", "kind").orderBy("no")
    fresh = ~((F.lag("no").over(order) == F.col("no") - 1) & (F.lag("keep").over(order) == F.col("keep")))
    rows = rows.withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int"))
    # segments in a row of equal keep form one span; a line and the document's own row stand for themselves
    part = F.when(F.col("kind") == SEGMENT, F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).otherwise(F.col("no"))
    runs = rows.withColumn("part", part).groupBy("uid", "kind", "part").agg(
        F.max("doc_id").alias("doc_id"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.first("keep").alias("keep"), F.array_sort(F.collect_set("holder")).alias("holders"),
    )
    before = Window.partitionBy("uid").orderBy((F.col("kind") == DOC).desc(), "first", "last")
    is_doc, is_short = F.col("kind") == DOC, F.col("kind") == SHORT
    unit = ~is_doc & ~is_short
    reach = lambda on: F.coalesce(F.max(F.when(on, F.col("last"))).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = lambda on: F.when(on, F.greatest(F.lit(0), F.col("last") - F.greatest("first", reach(on)))).otherwise(0)
    runs = runs.withColumns({"fresh": fresh(unit), "gone": fresh(unit & ~F.col("keep"))})
    short = F.col("last") - F.col("first")
    return runs.groupBy("uid").agg(
        F.nullif(F.max("doc_id"), F.lit(NONE)).alias("doc_id"),
        F.max(F.when(is_doc, F.col("last"))).cast("long").alias("n_words"),
        F.sum("fresh").cast("long").alias("n_repeated"),
        F.sum("gone").cast("long").alias("n_removed"),
        F.sum(F.when(is_short & ~F.col("keep"), short).otherwise(0)).cast("long").alias("n_short"),
        F.array_sort(F.collect_list(F.when(unit, F.struct("first", "last", "keep")))).alias("spans"),
        F.array_sort(F.collect_list(F.when(is_short, F.struct("first", "last", "keep")))).alias("short_spans"),
        F.array_remove(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(unit, F.col("holders")))))), NONE).alias("holders"),
    ).select("doc_id", "n_words", (F.col("n_repeated") > 0).alias("repeated"), "n_repeated", "n_removed", "spans", "holders", "n_short", "short_spans")
