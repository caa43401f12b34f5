"""Benchmark decontamination: a hash set of normalised benchmark n-grams, scanned over all windows.

A-Z are lower-cased; words are runs of characters that are neither ASCII controls, space nor ASCII
punctuation. The windows of an item are its runs of `n` words, or the whole item if it has fewer. They
are hashed and broadcast while they and the items that have them are at most BROADCAST; every document window of a
needed length looks itself up, and a hit is verified word by word. Beyond that, documents are written with a number,
windows travel as four numbers each, what they meet is verified by a second join to the few documents concerned, and
items are joined to windows only once these are found. Only SQL functions are used.

Null texts have no words; an item without words has no windows. Repeated rows are judged each for
itself, repeated item ids count once, null item ids are ignored. Very long texts are one row of arrays. Columns of
other names and types are ignored, or kept as they are where rows of docs come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, joined_if_small, numbered, saved

#: Benchmark windows, with the items that have them, that are broadcast at most; rows of other small sides.
BROADCAST = 1_000_000
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), f"{BREAK}+"), "")


def windows(w: str, k: int) -> Column:
    """Structs (pos, k, h) of all windows of k words of the array column w."""
    at = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.lit(k).alias("k"), F.xxhash64(F.slice(w, i + 1, k)).alias("h")))


def benchmark_windows(items: DataFrame, n: int) -> DataFrame:
    """(item, gram): the windows of each item."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter("size(w) > 0")
    k = F.least(F.size("w"), F.lit(n))
    return w.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.slice("w", i + 1, k))).alias("gram")).distinct()


def _looked_up(doc: DataFrame, each: DataFrame, lengths: list[int]) -> DataFrame:
    """Windows found by a broadcast table: uid, doc_id, size (of a row that stands for the document), pos, end, items."""
    grams = each.groupBy("gram").agg(F.collect_set("item").alias("items")).select(F.xxhash64("gram").alias("wh"), F.size("gram").alias("wk"), "gram", "items")
    doc = doc.withColumn("uid", F.monotonically_increasing_id())
    # the last struct, without a hash, stands for the document itself
    own = F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("long").alias("h")))
    rows = doc.select("uid", "doc_id", "w", F.inline(F.concat(*[windows("w", k) for k in lengths], own)))
    met = rows.join(F.broadcast(grams), (F.col("h") == F.col("wh")) & (F.col("k") == F.col("wk")), "left")
    met = met.filter("h is null or (wh is not null and slice(w, pos + 1, k) = gram)")
    return met.select("uid", "doc_id", F.when(F.col("h").isNull(), F.size("w")).alias("size"), "pos", (F.col("pos") + F.col("k")).alias("end"), "items")


def _joined(doc: DataFrame, each: DataFrame, lengths: list[int]) -> DataFrame:
    """The same by shuffles of narrow rows, items one a row."""
    grams, g = numbered(each.select("gram", F.xxhash64("gram").alias("h"), F.size("gram").alias("k")).distinct(), "grams")
    having = each.join(grams.select("gram", F.col(g).alias("g")), "gram").select("g", F.array_compact(F.array("item")).alias("items"))
    rows, _ = numbered(doc, "texts")
    found = rows.select("uid", F.inline(F.concat(*[windows("w", k) for k in lengths]))).join(grams.select("h", "k", F.col(g).alias("g")), ["h", "k"]).select("uid", "pos", "k", "g")
    found = saved(found, "found")
    texts = rows.join(found.select("uid").distinct(), "uid", "left_semi").select("uid", "doc_id", "w")
    right = found.join(texts, "uid").join(grams.select(F.col(g).alias("g"), "gram"), "g").filter("slice(w, pos + 1, k) = gram")
    right = saved(right.select("uid", "doc_id", "pos", "k", "g"), "verified")
    spans = right.select("uid", "doc_id", F.lit(None).cast("int").alias("size"), "pos", (F.col("pos") + F.col("k")).alias("end"), F.lit(None).cast("array<string>").alias("items"))
    # an item once for each document
    told = right.select("uid", "doc_id", "g").distinct().join(having, "g").select("uid", "doc_id", "items").distinct()
    none = F.lit(None).cast("int")
    told = told.select("uid", "doc_id", none.alias("size"), none.alias("pos"), none.alias("end"), "items")
    own = rows.select("uid", "doc_id", F.size("w").alias("size"), none.alias("pos"), none.alias("end"), F.lit(None).cast("array<string>").alias("items"))
    return spans.union(told).union(own)


def hits(docs: DataFrame, items: DataFrame, n: int = 13, ident: Column | None = None) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, items (sorted) and spans of hit words.

    ident: what stands in the column doc_id instead of the document's own.
    """
    each = saved(benchmark_windows(items, n), "windows")
    lengths = sorted(r[0] for r in each.select(F.size("gram")).distinct().collect())  # at most n numbers
    # what would be broadcast: windows, and the items that have them
    small = each.count() + each.select("gram").distinct().count() <= BROADCAST
    doc = docs.select((F.col("doc_id").cast("long") if ident is None else ident).alias("doc_id"), words(F.col("text")).alias("w"))
    met = _looked_up(doc, each, lengths) if small or not lengths else _joined(doc, each, lengths)
    before = Window.partitionBy("uid").orderBy(F.col("pos").asc_nulls_first(), "end")
    reached = F.coalesce(F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = met.withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest("pos", reached)))
    return met.groupBy("uid").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("size").cast("long").alias("n_words"),
        F.coalesce(F.sum("fresh"), F.lit(0)).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", "end")))).alias("spans"),
    )


def judged(docs: DataFrame, items: DataFrame, n: int = 13, share: int = 20, ident: Column | None = None) -> DataFrame:
    """hits() with the verdict: contaminated if hit words are at least one in `share`."""
    bad = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return hits(docs, items, n, ident).withColumn("contaminated", bad)


def clean(docs: DataFrame, items: DataFrame, n: int = 13, share: int = 20) -> DataFrame:
    """docs without those whose text is contaminated. Texts are known by two hashes, so doc_id may be null or repeat."""
    key = lambda text: (F.xxhash64(text), F.xxhash64(F.lit("second"), text))
    text = F.col("text")
    names = [free_name(docs, x) for x in ("one", "other")]
    found = judged(docs, items, n, share, F.struct(*key(text))).filter("contaminated").select("doc_id.*").toDF(*names)
    bad = saved(found.distinct(), "contaminated")
    same = (key(text)[0] == F.col(names[0])) & (key(text)[1] == F.col(names[1]))
    return docs.join(joined_if_small(bad, BROADCAST), same, "left_anti")


def without_spans(docs: DataFrame, items: DataFrame, n: int = 13) -> DataFrame:
    """docs, their texts without all hit words and what stands before each; each row by itself, all columns kept."""
    rows, uid = numbered(docs, "numbered")
    spans = free_name(rows, "spans")
    found = hits(rows, items, n, F.col(uid)).filter("n_hit > 0").select(F.col("doc_id").alias(uid), F.col("spans").alias(spans))
    each = F.regexp_extract_all("text", F.lit(f"(?i){BREAK}*{WORD}+".replace("\\x3A-\\x60", ":-@\\[-`")), F.lit(0))
    tail = F.regexp_extract("text", f"{BREAK}*\\z".replace("\\x3A-\\x60", ":-@\\[-`"), 0)
    left = F.filter(each, lambda _, i: ~F.exists(spans, lambda s: (i >= s["pos"]) & (i < s["end"])))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(F.concat(F.array_join(left, ""), tail))
    return rows.join(found, uid, "left").select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
