"""Vectors as short codes: a codebook for each part of a vector, its nearest entries found by equal-average search.

A vector of whole numbers floor(4096 x) is cut into equal parts. Each part position has a codebook that starts as the
parts of the vectors of smallest id and is refined in rounds: every part goes to its nearest entry, an entry becomes the
floored mean of its parts. By Cauchy and Schwarz two parts whose component sums differ by g are at a squared distance
of g * g / dimension or more. So entries are sorted by their sum, and a part's search starts at its own sum and goes
outward to the nearer sum of both sides, until that bound strictly exceeds the best distance; what is left can neither
win nor tie. Ties go to the entry of the lower index.

A round reads the written table once. Tasks send one row for each part and entry (how many parts, and their sums), Spark
adds these up, and only the codebooks, whose size the data don't change, pass through the driver.

Rows whose vector is null or holds a null or non-finite component are dropped. Vectors are padded with zeros to the
longest length, rounded up to a multiple of the number of parts; an empty vector is all zeros. Components beyond 2^53
after scaling are taken as that. Repeated ids and rows count as often as they stand; where ids repeat, vectors decide
which come first, and null ids come last. With fewer rows than entries a codebook has as many entries as rows. A sum of
distances that passes 64 bits is null. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, slices

SCALE = 4096
LARGEST = 1 << 53
#: Rows of a table that may be broadcast.
BROADCAST = 100_000
#: Vectors that a worker searches at once.
ROWS = 4096
#: Shares of one label's rows in a join beyond that.
SALTS = 32

EXACT = pa.decimal128(38, 0)


class Codebook:
    """The entries of one part position, in order of their component sum."""

    def __init__(self, entries: list[list[int]]):
        self.entries = np.array(entries, object)
        sums = self.entries.sum(axis=1)
        self.order = np.array(sorted(range(len(entries)), key=lambda i: (sums[i], i)))
        self.sums = sums[self.order]
        self.largest = max((abs(int(x)) for e in entries for x in e), default=0)
        #: Distances computed in all searches.
        self.compared = 0

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, and the squared distance, of each row of parts (64-bit, or of Python's integers)."""
        n, d = parts.shape
        most = max(self.largest, int(abs(parts).max())) if n and d else 0
        kind = np.int64 if d * (2 * most) * d * (2 * most) < 1 << 63 else object
        parts, entries, sums = parts.astype(kind), self.entries.astype(kind), self.sums.astype(kind)
        own = parts.sum(axis=1)
        above = np.searchsorted(sums, own)
        below = above - 1
        best, which, live = np.zeros(n, kind), np.zeros(n, np.int64), np.arange(n)
        last = len(sums) - 1
        for turn in range(len(sums)):
            low, high = below[live], above[live]
            down, up = own[live] - sums[np.maximum(low, 0)], sums[np.minimum(high, last)] - own[live]
            left = (high > last) | ((low >= 0) & (down <= up))
            gap = np.where(left, down, up)
            if turn:
                on = (gap * gap <= best[live] * d).astype(bool)
                live, left, low, high = live[on], left[on], low[on], high[on]
            if not live.size:
                break
            at = self.order[np.where(left, low, high)]
            apart = parts[live] - entries[at]
            far = (apart * apart).sum(axis=1)
            better = (far < best[live]) | ((far == best[live]) & (at < which[live])) if turn else np.ones(len(live), bool)
            won = live[better.astype(bool)]
            best[won], which[won] = far[better.astype(bool)], at[better.astype(bool)]
            below[live] -= left
            above[live] += ~left
            self.compared += live.size
        return which, best


def whole_numbers(vectors: DataFrame, parts: int, id: str, vector: str, label: str) -> DataFrame:
    """id, label, v: the kept vectors as whole numbers, padded; written to the shared folder."""
    rows = vectors.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("v").isNotNull() & finite)
    scaled = F.transform("v", lambda x: F.least(F.greatest(F.floor(x * SCALE), F.lit(-LARGEST)), F.lit(LARGEST)).cast("long"))
    rows = saved(rows.withColumn("v", scaled), "vectors")
    width, least = rows.agg(F.max(F.size("v")), F.min(F.size("v"))).first()
    wanted = -(-(width or 0) // parts) * parts
    if least is not None and least < wanted:
        rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(wanted) - F.size("v"))))
    return rows


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def refined(rows: DataFrame, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """The codebooks after one round over rows (v)."""
    d = len(books[0][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        count, total = np.zeros((len(books), len(books[0])), np.int64), np.zeros((len(books), len(books[0]), d), object)
        for batch in slices(batches, ROWS):
            all_parts = _matrix(batch.column(0), len(books) * d)
            for p, book in enumerate(search):
                own = all_parts[:, p * d : (p + 1) * d]
                which, _ = book.nearest(own)
                count[p] += np.bincount(which, minlength=len(book.sums))
                # sums of a batch pass 64 bits only if its components are very large
                kind = np.int64 if batch.num_rows * int(abs(own).max(initial=0)) < 1 << 63 else object
                batch_sums = np.zeros(total[p].shape, kind)
                np.add.at(batch_sums, which, own.astype(kind))
                total[p] += batch_sums
        rows = [(p, e, int(count[p, e]), [Decimal(int(x)) for x in total[p, e]]) for p, e in zip(*np.nonzero(count))]
        columns = list(zip(*rows)) or [[], [], [], []]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(EXACT))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["part", "entry", "n", "s"])

    each = rows.select("v").mapInArrow(run, "part int, entry int, n long, s array<decimal(38,0)>")
    added = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(d)])
    books = [[list(e) for e in b] for b in books]
    for part, entry, n, *sums in added.collect():  # parts times entries rows
        books[part][entry] = [int(s) // n for s in sums]
    return books


def trained(rows: DataFrame, parts: int, entries: int, rounds: int) -> list[list[list[int]]]:
    """The codebooks by part, entry and position; none if rows is empty."""
    first = [list(r.v) for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    if not first:
        return []
    d = len(first[0]) // parts
    books = [[v[p * d : (p + 1) * d] for v in first] for p in range(parts)]
    for _ in range(rounds if d else 0):
        books = refined(rows, books)
    return books


def coded(rows: DataFrame, books: list[list[list[int]]]) -> DataFrame:
    """id, label, code (two hexadecimal digits a part), squared (the distances summed over parts)."""
    d = len(books[0][0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [Codebook(b) for b in books]
        for batch in slices(batches, ROWS):
            all_parts = _matrix(batch.column(2), len(books) * d)
            codes, errors = np.empty((batch.num_rows, len(books)), np.uint8), 0
            for p, book in enumerate(search):
                codes[:, p], far = book.nearest(all_parts[:, p * d : (p + 1) * d])
                small = far.dtype != object and int(far.max(initial=0)) < (1 << 62) // len(books)
                errors = errors + (far if small else far.astype(object))
            digits = codes.tobytes().hex()
            step = 2 * len(books)
            text = pa.array([digits[i * step : (i + 1) * step] for i in range(batch.num_rows)], pa.string())
            exact = pa.array([Decimal(int(x)) for x in errors], EXACT) if errors.dtype == object else pa.array(errors, pa.int64()).cast(EXACT)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, exact], names=["id", "label", "code", "squared"])

    kinds = dict(rows.dtypes)
    return rows.select("id", "label", "v").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, squared decimal(38,0)")


def digest(books: list[list[list[int]]]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """A row for each kept row of vectors: id, label, code, error, label_error (error summed over equal labels), codebooks_sha256.

    entries: 256 at most, for two hexadecimal digits each.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    rows = whole_numbers(vectors, parts, id, vector, label)
    books = trained(rows, parts, entries, rounds)
    found = saved(coded(rows, books), "codes") if books else rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("decimal(38,0)").alias("squared")).limit(0)
    totals = found.groupBy("label").agg(F.try_sum("squared").alias("total")).withColumnRenamed("label", "of")
    same = F.col("label").eqNullSafe(F.col("of"))
    if totals.limit(BROADCAST + 1).count() <= BROADCAST:
        found = found.join(F.broadcast(totals), same, "left")
    else:
        # a label with very many rows is split into shares
        found = found.withColumn("share", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        totals = totals.withColumn("share_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = found.join(totals, same & (F.col("share") == F.col("share_of")), "left")
    long = lambda c: F.col(c).try_cast("long")
    return found.select(F.col("id").alias(id), F.col("label").alias(label), "code", long("squared").alias("error"), long("total").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
