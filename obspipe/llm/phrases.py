"""Phrases of words that belong together, from count streams merged in prefix and suffix order.

Texts are read once and written as blocks: the words of one language in some megabytes of text, as small numbers with a
list of the block's words. Counting then goes up by one word at a time. A phrase of n words is the pair of its first n-1
words (prefix) and its last n-1 words (suffix), each known by the id it got a level below, and only where both are
frequent can the phrase be. A block sends its pairs with their counts, sorted and packed, to shards by a hash of the pair;
a shard adds the counts up, gives an id to sums of `least` and more, and tells each block which of its own pairs are
among them. So every count is exact, nothing is broadcast or held whole, and a pair costs a few bytes on its way.

The streams of a level are its rows in order of the prefix's id and in order of the suffix's id. Merged in lockstep with
the level below (sort-merge joins, which Spark's hint `merge` asks for: both sides sorted by id and walked side by side,
without a hash table) they give a phrase the counts of all its first and last words, one word at a time, and give the
phrases below the count of their most frequent extension by one word to the right or left. A longer phrase around a
phrase is no more frequent than such an extension inside it, so these decide what is dropped.

Null texts are empty; null langs count as `und`. Rows that repeat, ids and other columns don't matter. A text without any
separator is held by one task as a whole, as any row is. Ties in score and count go by phrase in byte order. An empty
table gives no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, discard, numbered, parts, saved
from .hashing import ODD, mixed

#: Bytes of text that a task gathers in its blocks before it gives them out.
BLOCK = 32 << 20
#: Words or pairs of all blocks that one shard adds up, about.
SHARD = 2_000_000
#: Rows that one task ranks at most, beside the rows kept of each language.
RANKED = 200_000

#: Separators of pieces become line feeds, tabs become spaces, A-Z become lower case.
FOLD = bytes.maketrans(UPPER.encode() + b".,;:!?\x0b\x0c\x0d\t", LOWER.encode() + b"\n" * 9 + b" ")

ASKED = "block long, lang string, shard int, at binary, shards binary, keys binary, suffix binary, n binary"
TOLD = "shard int, lang string, block long, place binary, id binary, words array<string>, prefix array<long>, suffix array<long>, a array<long>, number array<long>"


def packed(x: np.ndarray, rising: bool = False) -> bytes:
    """Integers, their bytes of equal weight together, compressed; of rising ones the differences."""
    x = np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)) if rising else x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unpacked(data: bytes, kind: str, rising: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    x = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
    return np.cumsum(x, dtype=kind) if rising else x


class Numbers(dict):
    """Numbers of words, given in order of appearance; 0 is the end of a piece, 1 no word at all."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Block:
    """The words of some texts of one language."""

    def __init__(self):
        self.number, self.at = Numbers(), array("i")

    def add(self, text: str) -> int:
        data = text.encode("utf-8", "surrogatepass").translate(FOLD)
        self.at.extend(map(self.number.__getitem__, data.replace(b"\n", b" \n ").split(b" ")))
        self.at.append(0)
        return len(data)

    def given(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words, how often each occurs, and the place of each word in that list, -1 between pieces."""
        at = np.frombuffer(self.at, np.int32)
        at = at[at != 1] - 2
        words = list(self.number)[2:]
        return words, np.bincount(at[at >= 0], minlength=len(words)), np.where(at < 0, -1, at).astype(np.int32)


def blocks(docs: DataFrame) -> DataFrame:
    """lang, at (places of words in the list), words (by line feeds), n (their counts), distinct and total words; packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there: dict[str, Block] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang in list(there):
                words, n, at = there.pop(lang).given()
                if words:
                    text = zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))
                    columns = [[lang], [packed(at)], [text], [packed(n)], [len(words)], [int(n.sum())]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), *[pa.binary()] * 3, pa.int64(), pa.int64()))], names=["lang", "at", "words", "n", "distinct", "total"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                size += there.setdefault(lang.as_py(), Block()).add(text.as_py())
                if size >= BLOCK:
                    yield from out()
                    size = 0
        yield from out()

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return texts.mapInArrow(run, "lang string, at binary, words binary, n binary, distinct long, total long")


def _asked(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.binary()] * 5]
    for row in rows:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["block", "lang", "shard", "at", "shards", "keys", "suffix", "n"])


def _split(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs, with the places that it takes, in order."""
    order = np.argsort(shard, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if len(own):
            yield int(shard[own[0]]), own


def word_messages(level: DataFrame, shards: int) -> DataFrame:
    """A row for each block with its state (at, and the shard of each word), and one for each shard that it asks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def rows(batch: pa.RecordBatch, i: int) -> Iterator[tuple]:
            block, lang, at, words, n = (batch.column(k)[i].as_py() for k in range(5))
            words, n = zstandard.ZstdDecompressor().decompress(words).split(b"\n"), unpacked(n, "i8")
            shard = np.array([xxhash.xxh64_intdigest(w) % shards for w in words], np.int32)
            yield block, lang, None, at, packed(shard), None, None, None
            for s, own in _split(shard):
                text = zstandard.ZstdCompressor(level=1).compress(b"\n".join(words[k] for k in own))
                yield block, lang, s, None, None, text, None, packed(n[own])

        for batch in batches:
            for i in range(batch.num_rows):
                yield from _asked(rows(batch, i))

    return level.select("block", "lang", "at", "words", "n").mapInArrow(run, ASKED)


def pair_messages(heard: DataFrame, shards: int) -> DataFrame:
    """The same for the pairs of neighbours that are frequent; heard: block, lang, at, shards, known (struct shard, place, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch, i: int) -> Iterator[tuple]:
            block, lang, at, shard, known = (batch.column(k)[i].as_py() for k in range(5))
            at, shard = unpacked(at, "i4"), unpacked(shard, "i4")
            # what the answers' places, counted within a shard, are in the block's list
            own = dict(_split(shard))
            place = np.concatenate([own[k["shard"]][unpacked(k["place"], "i4", True)] for k in known])
            ids = np.concatenate([(np.int64(k["shard"]) << 32) + unpacked(k["id"], "i4", True) for k in known])
            # frequent symbols numbered from 0 in order of their ids, -1 for others and for ends
            order = np.argsort(ids)
            number = np.full(len(shard) + 1, -1, np.int64)
            number[place[order]] = np.arange(len(ids))
            ids, symbol = ids[order], number[at]
            both = (symbol[:-1] >= 0) & (symbol[1:] >= 0)
            pair, found, n = np.unique(symbol[:-1][both] * len(ids) + symbol[1:][both], return_inverse=True, return_counts=True)
            after = np.full(len(at), -1, np.int32)
            after[:-1][both] = found
            prefix, suffix = ids[pair // len(ids)], ids[pair % len(ids)]
            shard = (mixed(prefix.astype(np.uint64) * ODD + suffix.astype(np.uint64)) % np.uint64(shards)).astype(np.int32)
            yield block, lang, None, packed(after), packed(shard), None, None, None
            for s, k in _split(shard):
                yield block, lang, s, None, None, packed(prefix[k], True), packed(suffix[k]), packed(n[k])

        for batch in batches:
            for i in range(batch.num_rows):
                yield from _asked(rows(batch, i))

    return heard.select("block", "lang", "at", "shards", "known").mapInArrow(run, ASKED)


def _told(shard: int, lang: str | None, block: int | None = None, place=None, id=None, words=None, prefix=None, suffix=None, a=None, number=None) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), *[pa.list_(pa.int64())] * 4]
    row = (shard, lang, block, place, id, words, prefix, suffix, a, number)
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=["shard", "lang", "block", "place", "id", "words", "prefix", "suffix", "a", "number"])


def _replies(shard: int, asked: list[tuple], key: np.ndarray, ends: np.ndarray, number: np.ndarray) -> Iterator[pa.RecordBatch]:
    """To each block: which of the keys it asked for are frequent, and their numbers."""
    for (block, lang), i, j in zip(asked, [0, *ends[:-1]], ends):
        own = number[key[i:j]]
        place = np.flatnonzero(own >= 0)
        if len(place):
            yield _told(shard, lang, block, packed(place.astype(np.int32), True), packed(own[place].astype(np.int32), True))


def answers(asked: DataFrame, least: int, words: bool) -> DataFrame:
    """What the shards answer: rows without block list the frequent keys and their sums, the others go to blocks."""

    def run(table: pa.Table) -> pa.Table:
        shard, langs = table.column("shard")[0].as_py(), table.column("lang").to_pylist()
        blocks, n = table.column("block").to_pylist(), [unpacked(x.as_py(), "i8") for x in table.column("n")]
        ends, out = np.cumsum([len(x) for x in n]), []
        if words:
            numbers: dict[tuple, int] = {}
            keys = []
            for lang, x in zip(langs, table.column("keys")):
                keys += [numbers.setdefault((lang, w), len(numbers)) for w in zstandard.ZstdDecompressor().decompress(x.as_py()).split(b"\n")]
            key = np.array(keys, np.int64)
        else:
            prefix, suffix = (np.concatenate([unpacked(x.as_py(), "i8", rising) for x in table.column(c)]) for c, rising in (("keys", True), ("suffix", False)))
            # numbered anew here, so that a pair fits in 64 bits however many ids there are
            (first, i), (second, j) = (np.unique(x, return_inverse=True) for x in (prefix, suffix))
            pairs, key = np.unique(i * len(second) + j, return_inverse=True)
        total = np.zeros(int(key.max(initial=-1)) + 1, np.int64)
        np.add.at(total, key, np.concatenate(n))
        frequent = np.flatnonzero(total >= least)
        if not len(frequent):
            return pa.Table.from_batches([], schema=_told(0, None).schema)
        number = np.full(len(total), -1, np.int64)
        number[frequent] = np.arange(len(frequent))
        # a pair's language is that of any block that has it
        known = {x: k for k, x in enumerate(dict.fromkeys(langs))}
        lang_of = np.zeros(len(total), np.int64)
        lang_of[key] = np.repeat([known[x] for x in langs], np.diff(ends, prepend=0))
        names = [w for _, w in numbers] if words else []
        for lang, k in known.items():
            mine = frequent[lang_of[frequent] == k]
            if not len(mine):
                continue
            if words:
                what = {"words": [names[i].decode("utf-8", "surrogatepass") for i in mine]}
            else:
                what = {"prefix": first[pairs[mine] // len(second)], "suffix": second[pairs[mine] % len(second)]}
            out.append(_told(shard, lang, a=total[mine], number=number[mine], **what))
        out += _replies(shard, list(zip(blocks, langs)), key, ends, number)
        return pa.Table.from_batches(out)

    return asked.filter("shard is not null").select("shard", "lang", "block", "keys", "suffix", "n").groupBy("shard").applyInArrow(run, TOLD)


def frequent(told: DataFrame, keys: list[str]) -> DataFrame:
    """lang, the keys, their count a and an id of each key that is frequent."""
    listed = told.filter("block is null").select("lang", "shard", F.inline(F.arrays_zip(*keys, "a", "number")))
    return listed.select("lang", *keys, "a", (F.shiftleft(F.col("shard").cast("long"), 32) + F.col("number")).alias("id"))


def heard(asked: DataFrame, told: DataFrame) -> DataFrame:
    """Blocks with their state and what shards told them."""
    known = told.filter("block is not null").groupBy("block").agg(F.collect_list(F.struct("shard", "place", "id")).alias("known"))
    return asked.filter("shard is null").select("block", "lang", "at", "shards").join(known, "block")


def extended(level: DataFrame, below: DataFrame) -> DataFrame:
    """A level's rows (id, lang, prefix, suffix, a) with what they take from the level below.

    phrase; last: its last word; starts, ends: counts of its first and last words, 1 to n of them.
    """
    before = below.select(F.col("id").alias("prefix"), F.col("phrase").alias("front"), "starts").hint("merge")
    after = below.select(F.col("id").alias("suffix"), "last", "ends").hint("merge")
    by_prefix = level.select("id", "lang", "prefix", "suffix", "a").join(before, "prefix")
    merged = by_prefix.join(after, "suffix")
    with_own = lambda c: F.concat(c, F.array("a"))
    return merged.select("id", "lang", "prefix", "suffix", "a", F.concat_ws(" ", "front", "last").alias("phrase"), "last", with_own("starts").alias("starts"), with_own("ends").alias("ends"))


def extension_counts(above: DataFrame) -> DataFrame:
    """id, longest: the count of the most frequent phrase of one word more that starts or ends with the phrase."""
    sides = above.select(F.col("prefix").alias("id"), "a").union(above.select("suffix", "a"))
    return sides.groupBy("id").agg(F.max("a").alias("longest"))


def scored(level: DataFrame, words: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the lowest-scoring cut of each row of a level of so many words."""
    exact = lambda c: c.cast("decimal(38,0)")
    cuts = []
    for k in range(1, words):
        left, right = F.col("starts")[k - 1], F.col("ends")[words - k - 1]
        score = F.call_function("div", exact(F.lit(2_000_000)) * exact(F.col("a")), exact(left) + exact(right))
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    lowest = F.array_min(F.array(*cuts))
    return level.withColumn("cut", lowest).select("id", "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def ranked(rows: DataFrame, keys: list[str], order: list[Column], top: int) -> DataFrame:
    """The first `top` rows of each key, with their rank. The rows of a key are dealt out to shares, ranked there, and the first of each share again."""
    shares = max(1, -(-rows.count() // RANKED))
    while shares > 1:
        part = Window.partitionBy(*keys, "_share").orderBy(*order)
        dealt = rows.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
        rows = dealt.withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= top).drop("_rank", "_share")
        shares //= 16
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, inside: int = 80, top: int = 2000) -> DataFrame:
    """The first `top` phrases of 2 to `longest` words of each lang: lang, rank, phrase, a, l, r, n, score.

    docs: lang, text. least: the count a phrase needs. inside: a phrase is dropped if a longer one around it has so many
    hundredths of its count.
    """
    written, uid = numbered(blocks(docs), "blocks")
    level = written.withColumnRenamed(uid, "block")
    totals = saved(level.groupBy("lang").agg(F.sum("total").alias("n")), "words")
    distinct = level.agg(F.sum("distinct")).first()[0]
    asked = saved(word_messages(level, parts(distinct or 0, SHARD)), "asked")
    discard(written)
    told = saved(answers(asked, least, True), "told")
    known = frequent(told, ["words"])
    levels = [saved(known.select("id", "lang", "a", F.col("words").alias("phrase"), F.col("words").alias("last"), F.array("a").alias("starts"), F.array("a").alias("ends")), "level")]
    for n in range(2, longest + 1):
        # a level has no more pairs than the one below has occurrences
        occurrences = levels[-1].agg(F.sum("a")).first()[0]
        before, asked = (asked, told), saved(pair_messages(heard(asked, told), parts(occurrences or 0, SHARD)), "asked")
        discard(*before)
        told = saved(answers(asked, least, False), "told")
        levels.append(saved(extended(frequent(told, ["prefix", "suffix"]), levels[-1]), "level"))
    discard(asked, told)
    found = None
    for n in range(2, longest + 1):
        rows = scored(levels[n - 1], n)
        if n < longest:
            rows = rows.join(extension_counts(levels[n]).hint("merge"), "id", "left")
        else:
            rows = rows.withColumn("longest", F.lit(None).cast("long"))
        share = lambda c, k: F.col(c).cast("decimal(38,0)") * k
        rows = rows.filter(F.col("longest").isNull() | (share("longest", 100) < share("a", inside))).drop("longest", "id")
        found = rows if found is None else found.unionByName(rows)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    first = ranked(saved(found, "scored"), ["lang"], order, top)
    # a row a language
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
