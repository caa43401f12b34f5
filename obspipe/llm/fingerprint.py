"""I-Match document fingerprints with randomised lexicon subsets.

Terms are words (runs of characters other than white space, A-Z lower-cased, ASCII punctuation at the
ends cut off). The lexicon keeps the terms whose share of documents lies in [LOW, HIGH], a band of
inverse document frequency; with LOW fixed its size is at most the mean count of distinct terms / LOW,
whatever the number of documents, and it is broadcast while it has at most BROADCAST terms.

Randomised subsets of the lexicon are nested: the n-th keeps a term if the low n bits of its hash are
zero. A text works at the first level that leaves it under 4 * GROUPS distinct terms, and at the next
sparser one. At each of the two, the subset is dealt at random into GROUPS lexicons, and the text's terms
in each, sorted, are hashed together: a signature of four hex digits, 0000 where there are none. A text
without any lexicon term has one signature of all its terms at that level instead. Likeness: the share of
equal signatures among those that aren't empty in both, at the levels that both texts have; texts of
levels more than one apart have none.

Only SQL functions are used. Null texts count as empty. Order is (doc_id, hash of the text), nulls first; repeated
rows follow one another. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, saved

LOW, HIGH = 0.0005, 0.05
GROUPS = 16
#: Bytes of the texts of a range in which rows look for their successor, about; how many ranges there are at most
#: (at 100 TB, a range has 100 MB then); and quantiles of doc_id that are asked for.
RANGE, MOST_RANGES, MARKS = 1 << 21, 1 << 20, 64
#: Terms of the lexicon that are broadcast at most.
BROADCAST = 4_000_000


def hashes(text: Column) -> Column:
    """Hashes of the distinct terms of a text."""
    w = F.array_remove(F.split(ascii_lower(text), r"[\x20\x09-\x0D!-/:-@\[-`{-~]+"), "")
    return F.array_distinct(F.transform(w, lambda x: F.xxhash64(x)))


def lexicon(texts: DataFrame, low: float, high: float) -> DataFrame:
    """The terms (h) within the band of document frequency."""
    n = texts.count()
    terms = texts.select(F.explode(hashes(F.col("text"))).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    return terms.filter(F.col("df").between(max(2, math.ceil(n * low)), math.ceil(n * high))).select("h")


def zeros(h: Column, bits: Column) -> Column:
    """Whether the low bits of h are zero."""
    return h.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1) == 0


def sampled(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add the struct `name` (level, h): a text's level and its distinct terms there."""
    rows = rows.withColumn(name, hashes(F.col(text)))
    level = F.greatest(F.lit(0), F.floor(F.log2(F.greatest(F.size(name), F.lit(1)) / (2 * GROUPS)))).cast("int")
    rows = rows.withColumn(name, F.struct(level.alias("level"), F.col(name).alias("h")))
    kept = F.filter(F.col(f"{name}.h"), lambda h: zeros(h, F.col(f"{name}.level")))
    return rows.withColumn(name, F.struct(F.col(f"{name}.level").alias("level"), kept.alias("h")))


def signed(rows: DataFrame, name: str, terms: str, level: str, other: str) -> DataFrame:
    """Add the struct `name` (level, a, b) of signatures of the sorted lexicon terms; `other` stands in for none."""
    def hashed(x: Column) -> Column:
        return F.when(F.size(x) == 0, 0).otherwise(F.xxhash64(x).bitwiseAND(0xFFFF).bitwiseOR(1)).cast("int")

    rows = rows.withColumn("_b", F.filter(terms, lambda h: zeros(h, F.col(level) + 1)))

    def dealt(x: str) -> Column:
        subset = lambda g: F.filter(F.col(x), lambda h: F.shiftright(h, 20).bitwiseAND(GROUPS - 1) == g)
        return F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: hashed(subset(g)))

    alone = F.transform(F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.when(g == 0, F.col(other)).otherwise(0).cast("int"))
    pick = lambda x: F.when(F.size(terms) == 0, alone).otherwise(dealt(x))
    return rows.withColumn(name, F.struct(F.col(level).alias("level"), pick(terms).alias("a"), pick("_b").alias("b"))).drop("_b")


def text_of(fp: Column) -> Column:
    four = lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))
    return F.concat(F.lower(F.lpad(F.hex(fp["level"]), 2, "0")), F.array_join(F.transform(F.concat(fp["a"], fp["b"]), four), ""))


def likeness(x: Column, y: Column) -> Column:
    def counts(p: Column, q: Column) -> tuple[Column, Column]:
        both = F.arrays_zip(p.alias("p"), q.alias("q"))
        some = F.filter(both, lambda z: (z["p"] != 0) | (z["q"] != 0))
        return F.size(F.filter(some, lambda z: z["p"] == z["q"])), F.size(some)

    def share(*pairs: tuple[Column, Column]) -> Column:
        same = sum((a for a, _ in pairs[1:]), pairs[0][0])
        some = sum((b for _, b in pairs[1:]), pairs[0][1])
        return F.when(some == 0, 0.0).otherwise(same / some)

    apart = x["level"] - y["level"]
    return (
        F.when(x == y, 1.0)
        .when(apart == 0, share(counts(x["a"], y["a"]), counts(x["b"], y["b"])))
        .when(apart == 1, share(counts(x["a"], y["b"])))
        .when(apart == -1, share(counts(x["b"], y["a"])))
        .otherwise(0.0)
    )


def ranged(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) with h, the text's hash, and r, a range in the order (doc_id, h), nulls first.

    The number of ranges follows from the bytes of all texts. Ranges are cut at quantiles of doc_id, between two
    quantiles evenly, and a doc_id that is a quantile itself, as one that many rows have, is cut by h.
    """
    asked = F.percentile_approx("doc_id", [i / MARKS for i in range(1, MARKS)], 10_000)
    size, marks, least, most = rows.agg(F.sum(F.octet_length("text") + 64), asked, F.min("doc_id"), F.max("doc_id")).first()
    edges = sorted({least, *(marks or [])} - {None})
    fine = max(1, min(MOST_RANGES, (size or 0) // RANGE) // max(1, len(edges)))
    # the edges at or below a doc_id; none for null
    at = F.array(*[F.lit(m) for m in edges]).cast("array<long>")
    c = F.coalesce(F.size(F.filter(at, lambda m: m <= F.col("doc_id"))), F.lit(0))
    lo, up = F.get(at, c - 1).cast("double"), F.coalesce(F.get(at, c), F.lit(most)).cast("double")
    part = lambda x: F.least(F.floor(x * fine), F.lit(fine - 1))
    by_hash = part(F.xxhash64("text").cast("double") / 2.0**64 + 0.5)
    by_id = fine + part((F.col("doc_id").cast("double") - lo) / (up - lo + 1))
    # the edge itself comes first in its interval, then its other ids
    inside = F.when(F.col("doc_id").isNull() | (F.col("doc_id") == F.get(at, c - 1)), by_hash).otherwise(by_id)
    return rows.withColumns({"h": F.xxhash64("text"), "r": c.cast("long") * (2 * fine) + inside})


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows (doc_id, text, ghost, r), and the order in which a row's successor is the next one.

    Rows are dealt out by the ranges of `ranged`; the first row of each range also stands, as a ghost, at the end of
    the range before (that of the smallest at the end of the largest).
    """
    rows = ranged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    # a row for each range, 2 * MOST_RANGES about at most
    firsts = saved(rows.groupBy("r").agg(F.min(F.struct("doc_id", "h")).alias("first")), "firsts")
    last = firsts.agg(F.max("r")).first()[0]
    before = F.coalesce(F.lag("r").over(Window.orderBy("r")), F.lit(last))
    ghosts = firsts.select(F.col("first.doc_id").alias("gd"), F.col("first.h").alias("gh"), before.alias("g"))
    rows = rows.join(F.broadcast(ghosts), F.col("doc_id").eqNullSafe(F.col("gd")) & (F.col("h") == F.col("gh")), "left")
    own = F.struct(F.col("r").alias("r"), F.lit(0).alias("ghost"))
    copies = F.when(F.col("g").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("g").alias("r"), F.lit(1).alias("ghost"))))
    rows = rows.select("doc_id", "text", "h", F.inline(copies))
    return rows, Window.partitionBy("r").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "h", "text")


def edited(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Each row's text, its edited text, the fingerprints of both and their likeness, and that of the next row.

    edited_text: the last quarter of the characters gives way to as many first ones of the next row's text.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    terms = saved(lexicon(texts, low, high), "lexicon")
    terms = F.broadcast(terms) if terms.count() <= BROADCAST else terms
    rows, order = with_next(docs)
    rows = rows.withColumns({"next_text": F.coalesce(F.lead("text").over(order), F.lit("")), "pos": F.row_number().over(order)})
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    whole = (F.col("n_chars") - cut).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), whole), F.substring("next_text", F.lit(1), cut)))
    rows = sampled(sampled(rows, "text", "t"), "edited", "e")
    one = lambda x: F.when(F.size(x) == 0, 0).otherwise(F.xxhash64(F.array_sort(x)).bitwiseAND(0xFFFF).bitwiseOR(1)).cast("int")
    known = {
        "doc_id": F.col("doc_id"), "ghost": F.col("ghost"), "n_chars": F.col("n_chars"), "sha": F.unhex(F.sha2("edited", 256)),
        "tl": F.col("t.level"), "el": F.col("e.level"), "to": one(F.col("t.h")), "eo": one(F.col("e.h")),
    }
    info = F.named_struct(*[x for k, v in known.items() for x in (F.lit(k), v)])
    marked = lambda x, v: F.transform(F.col(f"{x}.h"), lambda h: F.struct(F.lit(v).alias("v"), h.alias("h")))
    # the last struct, without a hash, carries what else is known of the row
    each = F.concat(marked("t", 0), marked("e", 1), F.array(F.struct(F.lit(2).alias("v"), F.lit(None).cast("long").alias("h"))))
    rows = rows.select("r", "pos", info.alias("info"), F.inline(each))
    rows = rows.select("r", "pos", F.when(F.col("v") == 2, F.col("info")).alias("info"), "v", "h")
    rows = rows.join(terms.withColumn("kept", F.lit(True)), "h", "left").filter("kept or v = 2")
    mine = lambda v: F.array_sort(F.collect_list(F.when(F.col("v") == v, F.col("h"))))
    rows = rows.groupBy("r", "pos").agg(F.first("info", ignorenulls=True).alias("info"), mine(0).alias("t"), mine(1).alias("e")).select("r", "pos", "info.*", "t", "e")
    rows = signed(signed(rows, "fp", "t", "tl", "to"), "efp", "e", "el", "eo")
    rows = rows.withColumn("nfp", F.lead("fp").over(Window.partitionBy("r").orderBy("pos"))).filter("ghost = 0")
    return rows.select(
        "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), text_of(F.col("fp")).alias("fingerprint"), text_of(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("nfp")).alias("near_next"),
    )
