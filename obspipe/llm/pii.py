"""Personal data by candidate gradient boosting, with SQL functions and Spark's own trees only.

Base spans come from fixed patterns with checks (part values, Luhn, digit counts); they always stay. Generators of
high recall propose further, overlapping candidates: addresses with "at" and "dot" spelled out, dotted or spaced
quads, long digit groups, and digit groups like a telephone number's. Candidates are described by format (digits,
groups, separators, value checks) and context (neighbouring characters, words before).

Labels come from disguises, as nobody has labelled such spans. Every base span, written in the ways in which the
patterns miss it (marks spelled out, digits grouped, no plus), is a positive in its own context.
The same spans spoilt (parts too large, digits cut off, sentence ends for dots) are negatives, and so are the
generators' candidates that overlap no base span, unless their description is also that of a positive: those are
what is looked for, and count as unlabelled. Equal descriptions are counted together, over all documents, so the
table to which gradient-boosted trees are fitted is bounded by the number of descriptions. For each kind the cut on
the score is calibrated on a fold of texts left out in fitting: the lowest score from which on at least PRECISION of
the labelled candidates are positive. Candidates above their kind's cut that overlap no base span are added, of
overlapping ones the best-scored. Matches, overlaps and replacements are found by running sums and maxima over arrays,
so a text's cost grows in proportion to its matches. The fitted trees and cuts are a Column expression, so finding and replacing work on
each row by itself.

Null texts count as empty. Repeated rows and rows without doc_id are handled each for itself; nothing is added of a
kind that has no base span in the fitting fold. Very long runs are matched without recursion. Other columns stay as
they are in `redacted`, whatever their names, and are ignored elsewhere; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import once
from .common import discard, free_name, saved

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.95
#: Descriptions that are fitted in one task; more are fitted where they lie.
ONE_TASK = 1_000_000
#: The base patterns, with possessive repeats and look-behinds that change no match but its cost.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|[\[(] ?at ?[\])]| at ) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(] ?dot ?[\])]| dot ) ?[A-Za-z0-9-]{1,63}+){1,6}+",
    "ip": r"(?<![0-9])[0-9]{1,3}+(?:(?:\[\.\]|[.,]| \. )[0-9]{1,3}+){3}+",
    "card": r"(?<![0-9])[0-9]{1,8}+(?:[ ./-]?[0-9]{1,8}+){1,7}+",
    "phone": r"(?<![0-9])\(?[0-9]{2,4}+\)?(?:[ ./-]{1,2}+[0-9]{2,5}+){1,4}+",
}
WORDS = {
    "email": "mail|contact|write|reach", "ip": "ip|host|server|address|addr",
    "card": "card|visa|pay|credit|account", "phone": "call|phone|tel|mobile|fax|contact",
}
FEATURES = (
    "kind_no", "digits", "groups", "longest", "shortest", "length", "left", "right", "hinted", "spaces", "capitals", "at", "dot", "tail", "octets", "checked",
)
#: Ways of writing a base span that its pattern misses: (pattern, replacement) in turn; and ways of spoiling it.
DISGUISED = {
    "email": (((r"\.(?=[^@]*$)", " dot "), (r"@", " at ")), ((r"\.(?=[^@]*$)", "[dot]"), (r"@", "[at]")), ((r"@", " (at) "),), ((r"@", " @ "),)),
    "ip": (((r"\.", " . "),), ((r"\.", "[.]"),), ((r"\.", ","),)),
    "card": (((r"[^0-9]", ""), (r"(....)(?=.)", "$1.")), ((r"[^0-9]", ""), (r"(....)(?=.)", "$1/"))),
    "phone": (((r"^\+[0-9]{1,3} ?", ""),), ((r"^\+[0-9]{1,3} ?", ""), (r"[^0-9]+", " "), (r"^ | $", "")), ((r"[^0-9]+", "."), (r"^\.", ""))),
}
SPOILT = {
    "email": (((r"\.([^@]*)$", ". T$1"), (r"@", " at ")), ((r"^.*@", "them at "), (r"\..*$", ". And"))),
    "ip": (((r"\.[0-9]+\.", ".777."),), ((r"^[0-9]+", "999"), (r"\.", ",")), ((r"\.[0-9]+$", ".486"), (r"\.", " . "))),
    "card": (((r"[^0-9]", ""), (r"^(.{9}).*$", "$1")), ((r"[^0-9]", ""), (r"^(....)(...).*$", "$1.$2")), ((r"[^0-9]", ""), (r"(.{8}).*", "$1/$1/$1"))),
    "phone": (((r"[^0-9]", ""), (r"^.*(...)(....)$", "$1-$2")), ((r"[^0-9]", ""), (r"^(..)(..)(..).*$", "$1.$2.$3")), ((r"[^0-9]", ""), (r"^(....).*$", "$1-$1-$1-$1-$1"))),
}
SPAN = "struct<start:int,kind_no:int,end:int>"
#: Elements of an array, or code points of a text, that are handled together.
CHUNK = 256
#: Neighbours to either side that a candidate is compared with; candidates are short, so more don't overlap it but in odd texts.
NEAR = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def prefixes(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of op, associative with 0 as its neutral element, over an array of ints.

    An array can't be extended in place, so chunks are run through by themselves, then the chunks' results: time and
    copies grow in proportion to the array, not with its square.
    """
    def last(acc: Column) -> Column:
        return F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))

    def running(xs: Column) -> Column:
        return F.aggregate(xs, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(op(last(acc), x))))

    def whole(xs: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int"))
        return let(F.transform(at, lambda c: running(F.slice(xs, c * CHUNK + 1, F.lit(CHUNK)))), joined)

    def joined(chunks: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), running(F.transform(chunks, last)))
        return F.flatten(F.zip_with(chunks, F.slice(before, 1, F.size(chunks)), lambda chunk, b: F.transform(chunk, lambda x: op(b, x))))

    return let(values, lambda xs: F.when(F.size(xs) <= CHUNK, running(xs)).otherwise(whole(xs)))


def most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def added(a: Column, b: Column) -> Column:
    return a + b


def places(text: Column, pattern: str, possible: Column) -> Column:
    """Structs (start, end, what) of all matches, in code points."""
    kind = "array<struct<start:int,end:int,what:string>>"

    def located(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda x: F.char_length(x))
        ends = prefixes(F.zip_with(gaps, found, lambda g, m: g + F.char_length(m)), added)
        return F.zip_with(ends, found, lambda e, m: F.struct((e - F.char_length(m)).alias("start"), e.alias("end"), m.alias("what"))).cast(kind)

    each = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, F.array().cast(kind)).otherwise(located(found)))
    return F.when(possible, each).otherwise(F.array().cast(kind))


def chunked(text: Column) -> Column:
    """The text in chunks of CHUNK code points, so that a part of it is found without a walk from its start."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))


def piece(chunks: Column, a: Column, b: Column) -> Column:
    """Code points a to b of a chunked text."""
    first = F.floor(a / CHUNK).cast("int")

    def cut(chunk: Column, j: Column) -> Column:
        at = (first + j) * CHUNK
        low = F.greatest(a - at, F.lit(0))
        return F.substring(chunk, low + 1, F.least(b - at, F.lit(CHUNK)) - low)

    count = F.floor((b - 1) / CHUNK).cast("int") - first + 1
    return F.when(b <= a, "").otherwise(F.array_join(F.transform(F.slice(chunks, first + 1, count), cut), ""))


def clear(wide: Column, base: Column) -> Column:
    """Those of the matches `wide`, which don't overlap each other, that overlap no span of base."""
    event = "struct<at:int,base:int,value:int,match:struct<start:int,end:int,what:string>>"
    ends = F.transform(wide, lambda m: F.struct(m["end"], F.lit(0), F.lit(0), m).cast(event))
    starts = F.transform(base, lambda b: F.struct(b["start"], F.lit(1), b["end"], F.lit(None).cast("struct<start:int,end:int,what:string>")).cast(event))

    def met(events: Column) -> Column:
        # at a match's end: how far the base spans that start before it reach
        reach = prefixes(F.transform(events, lambda e: e["value"]), most)
        pairs = F.zip_with(events, reach, lambda e, r: F.struct(e["match"].alias("match"), (r <= e["match"]["start"]).alias("free")))
        return F.transform(F.filter(pairs, lambda x: F.coalesce(x["free"], F.lit(False))), lambda x: x["match"])

    return F.when((F.size(wide) == 0) | (F.size(base) == 0), wide).otherwise(let(F.array_sort(F.concat(ends, starts)), met))


def luhn(digits: Column) -> Column:
    backward = F.split(F.reverse(digits), "")

    def value(d: Column, i: Column) -> Column:
        n = F.ascii(d) - 48
        twice = n * 2
        return F.when(i % 2 == 0, n).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    chars = F.filter(backward, lambda d: d != "")
    return F.aggregate(F.transform(chars, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, what: Column) -> Column:
    digits = F.regexp_replace(what, "[^0-9]", "")
    if kind == "ip":
        short = F.transform(F.split(what, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(short, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def described(no: int, what: Column, before: Column, left: Column, right: Column) -> Column:
    """FEATURES of a candidate of kind `no`, as a struct of ints."""
    kind = KINDS[no]

    def side(c: Column) -> Column:
        return F.when(c == "", 0).when(c.rlike("[A-Za-z0-9]"), 1).when(c.rlike(r"\s"), 2).otherwise(3)

    def features(x: Column) -> Column:
        sizes = F.transform(x["runs"], F.length)
        digits = F.least(F.length(x["digits"]), F.lit(20))
        f = {
            "kind_no": F.lit(no), "digits": digits, "groups": F.least(F.size(x["runs"]), F.lit(6)),
            "longest": F.least(F.coalesce(F.array_max(sizes), F.lit(0)), F.lit(17)), "shortest": F.least(F.coalesce(F.array_min(sizes), F.lit(0)), F.lit(5)),
            "length": F.least(F.floor(F.length(what) / 4), F.lit(8)), "left": side(left), "right": side(right),
            "hinted": F.lower(before).rlike(WORDS[kind]), "spaces": F.contains(what, F.lit(" ")), "capitals": what.rlike("[A-Z]"),
            "at": F.lit(0), "dot": F.lit(0), "tail": F.lit(0), "octets": F.lit(0), "checked": F.lit(0),
        }
        if kind == "email":
            f["at"] = F.when(what.rlike(r"[\[(] ?at"), 2).when(F.contains(what, F.lit(" at ")), 3).otherwise(1)
            f["dot"] = F.when(what.rlike(r"[\[(] ?dot| dot "), 2).when(what.rlike(r"\. "), 3).otherwise(1)
            f["tail"] = F.least(F.length(F.regexp_extract(what, "[A-Za-z]*$", 0)), F.lit(7))
        if kind in ("ip", "phone"):
            f["octets"] = F.forall(x["runs"], lambda r: (F.length(r) < 3) | ((F.length(r) == 3) & (r <= "255")))
        if kind == "card":
            f["checked"] = digits.between(12, 19) & luhn(x["digits"])
        return F.struct(*[f[n].cast("int").alias(n) for n in FEATURES])

    runs = F.filter(F.split(what, "[^0-9]+"), lambda r: r != "")
    return F.get(F.transform(F.array(F.struct(runs.alias("runs"), F.regexp_replace(what, "[^0-9]", "").alias("digits"))), features), F.lit(0))


def around(m: Column) -> tuple[Column, Column, Column]:
    """What stands before a match, and the characters to its left and right, from `_chunks`."""
    part = lambda a, b: piece(F.col("_chunks"), F.greatest(a, F.lit(0)), b)
    return part(m["start"] - 24, m["start"]), part(m["start"] - 1, m["start"]), part(m["end"], m["end"] + 1)


def rewritten(what: Column, ways: tuple) -> list[Column]:
    out = []
    for way in ways:
        x = what
        for pattern, by in way:
            x = F.regexp_replace(x, pattern, by)
        out.append(x)
    return out


def marked(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more struct column, and its name: base spans by start and kind, candidates clear of them, and what to learn from.

    base: SPANs; wide: start, end and description; train: label and description.
    """
    text, marks = F.col("_text"), free_name(docs, "marks")
    names = [F.col(f"`{c}`") for c in docs.columns]
    # docs' own columns travel in one struct, so that no name of theirs can meet one of these
    rows = docs.select(F.struct(*names).alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    digit = text.rlike("[0-9]")
    possible = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+"))}
    wide = {"email": F.contains(text, F.lit("@")) | text.rlike(r" at |[\[(] ?at ?[\])]"), "ip": digit, "card": digit, "phone": digit}
    found = {f"_b_{k}": F.filter(places(text, BASE[k], possible[k]), lambda m: valid(k, m["what"])) for k in KINDS}
    rows = once(rows, ["_row", "_text"], found | {f"_w_{k}": places(text, WIDE[k], wide[k]) for k in KINDS})
    span = lambda m, no: F.struct(m["start"].alias("start"), F.lit(no).alias("kind_no"), m["end"].alias("end")).cast(SPAN)
    base = F.array_sort(F.concat(*[F.transform(f"_b_{k}", lambda m: span(m, no)) for no, k in enumerate(KINDS)]))
    rows = once(rows, ["_row", "_text", *[f"_{x}_{k}" for x in "bw" for k in KINDS]], {"base": base, "_chunks": F.when(reduce(Column.__or__, [F.size(f"_{x}_{k}") > 0 for x in "bw" for k in KINDS]), chunked(text))})

    def candidates(no: int, k: str) -> Column:
        return F.transform(clear(F.col(f"_w_{k}"), F.col("base")), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), described(no, m["what"], *around(m)).alias("f")))

    def examples(no: int, k: str) -> Column:
        """Labels 1 and 0 of a base span's disguises and spoilt forms, as far as the generator proposes them."""
        whole = f"^(?:{WIDE[k]})$"

        def of(m: Column) -> Column:
            each = [(1, x) for x in rewritten(m["what"], DISGUISED[k])] + [(0, x) for x in rewritten(m["what"], SPOILT[k])]
            forms = F.filter(F.array(*[F.struct(F.lit(y).alias("label"), x.alias("what")) for y, x in each]), lambda z: z["what"].rlike(whole))
            return F.transform(forms, lambda z: F.struct(z["label"].alias("label"), described(no, z["what"], *around(m)).alias("f")))

        return F.flatten(F.transform(f"_b_{k}", of))

    each = [("wide", F.concat(*[candidates(i, k) for i, k in enumerate(KINDS)])), ("train", F.concat(*[examples(i, k) for i, k in enumerate(KINDS)]))]
    fold = F.pmod(F.xxhash64("_text"), F.lit(4)).alias("fold")
    rows = once(rows, ["_row", fold, "base"], {n: c for n, c in each})
    return rows.select("_row.*", F.struct("fold", "base", "wide", "train").alias(marks)), marks


def margin(model, f: Column) -> Column:
    """The boosted trees' score of a description, as a Column."""
    def node(lines: Iterator[str]) -> Column:
        line = next(lines)
        if line.startswith("Predict:"):
            return F.lit(float(line.split()[1]))
        number, value = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node(lines)
        next(lines)  # the same condition's else
        return F.when(f[FEATURES[int(number)]] <= float(value), low).otherwise(node(lines))

    trees = [node(x.strip() for x in t.toDebugString.splitlines()[1:]) * w for t, w in zip(model.trees, model.treeWeights)]
    return reduce(Column.__add__, trees)


class Judge:
    """What the trees learnt: a score, and the cut of each kind."""

    def __init__(self, model, cuts: dict[int, float]):
        self.model, self.cuts = model, cuts

    def spans(self, marks: str) -> Column:
        """Base spans and the added ones, as an array of SPANs by start and kind."""
        base = F.col(marks)["base"]
        cuts = F.array(*[F.lit(-self.cuts.get(i, float("inf"))) for i in range(len(KINDS))])
        scored = F.transform(F.col(marks)["wide"], lambda m: F.struct(m["start"].alias("start"), (-margin(self.model, m["f"])).alias("less"), m["f"]["kind_no"].alias("kind_no"), m["end"].alias("end")))
        good = F.array_sort(F.filter(scored, lambda m: m["less"] <= F.element_at(cuts, m["kind_no"] + 1)))

        def best(found: Column) -> Column:
            def beaten(m: Column, i: Column) -> Column:
                rank = lambda x: F.struct(x["less"], x["start"], x["kind_no"])
                near = F.slice(found, F.greatest(i - NEAR, F.lit(0)) + 1, F.lit(2 * NEAR + 1))
                return F.exists(near, lambda x: (x["start"] < m["end"]) & (m["start"] < x["end"]) & (rank(x) < rank(m)))

            return F.transform(F.filter(found, lambda m, i: ~beaten(m, i)), lambda m: F.struct(m["start"].alias("start"), m["kind_no"].alias("kind_no"), m["end"].alias("end")).cast(SPAN))

        return F.when(F.size(F.col(marks)["wide"]) == 0, base).otherwise(F.array_sort(F.concat(base, let(good, best))))


def judge(rows: DataFrame, marks: str, precision: float = PRECISION) -> Judge | None:
    """Fit trees and cuts to the marks of all rows; None if one of the classes is missing.

    All tables here are bounded by the number of descriptions.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    fold = (F.col(marks)["fold"] == 0).cast("int").alias("held")
    taught = rows.select(fold, F.inline(F.col(marks)["train"])).select("held", "label", "f.*")
    met = rows.select(fold, F.inline(F.col(marks)["wide"])).select("held", F.lit(-1).alias("label"), "f.*")
    cells = saved(taught.union(met).groupBy("held", "label", *FEATURES).agg(F.count("*").alias("n")), "cells")
    alike = cells.filter("label = 1").select(*FEATURES).distinct()
    unknown = cells.filter("label = -1").join(alike, list(FEATURES), "left_anti").withColumn("label", F.lit(0))
    table = saved(cells.filter("label >= 0").unionByName(unknown.select(*cells.columns)), "table")
    discard(cells)
    if table.filter("held = 0").select("label").distinct().count() < 2:
        return None
    table = table.coalesce(1) if table.count() <= ONE_TASK else table
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(table)
    model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="n", maxIter=12, maxDepth=5, minInstancesPerNode=1, maxBins=32, seed=1).fit(data.filter("held = 0"))
    known = [r[0] for r in table.filter("held = 0 and label = 1").select("kind_no").distinct().collect()]
    score = margin(model, F.struct(*FEATURES)).alias("score")
    level = table.filter("held = 1").select("kind_no", score, "label", "n").groupBy("kind_no", "score").agg(F.sum(F.col("n") * F.col("label")).alias("good"), F.sum("n").alias("all"))
    above = Window.partitionBy("kind_no").orderBy(F.col("score").desc())  # over scores of descriptions
    level = level.select("kind_no", "score", (F.sum("good").over(above) / F.sum("all").over(above)).alias("precision"))
    cuts = level.filter(F.col("precision") >= precision).groupBy("kind_no").agg(F.min("score").alias("cut")).collect()  # a row for each kind
    return Judge(model, {r.kind_no: r.cut for r in cuts if r.kind_no in known})


def find(docs: DataFrame, precision: float = PRECISION, texts: bool = True) -> DataFrame:
    """docs with one more column, a struct `found` of base, the base spans, and spans, all spans of the row.

    texts: whether the result needs the texts, which are written with the marks then.
    """
    rows, marks = marked(docs)
    docs = docs if texts else docs.drop("text")
    rows = saved(rows if texts else rows.drop("text"), "marked")
    judged = judge(rows, marks, precision)
    base = F.col(marks)["base"]
    names = [F.col(f"`{c}`") for c in docs.columns]
    return rows.select(*names, F.struct(base.alias("base"), (judged.spans(marks) if judged else base).alias("spans")).alias(free_name(docs, "found")))


def written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda no: F.element_at(F.array(*[F.lit(k) for k in KINDS]), no + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """doc_id, counts of base spans by kind, the digest of base spans, and all spans as text."""
    def count(no: int) -> Column:
        return F.size(F.filter("found.base", lambda s: s["kind_no"] == no)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = find(ids, precision, texts=False)
    return rows.select("doc_id", *counts, F.sha2(written("found.base"), 256).alias("base_sha256"), written("found.spans").alias("spans"))


def redacted(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets.

    Each row is handled by itself, also without doc_id or with a repeated one. Overlapping spans are cut out once,
    under the kind of the first. A null text stays null.
    """
    rows, found = find(docs, precision), free_name(docs, "found")
    name = lambda no: F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), no + 1)
    spans = F.col(found)["spans"]

    def replaced(x: Column) -> Column:
        # what stands between a span and how far those before it reach, then the span's kind
        since = F.concat(F.array(F.lit(0)), F.slice(x["reach"], 1, F.size(spans) - 1))
        parts = F.zip_with(spans, since, lambda s, p: F.when(s["start"] < p, "").otherwise(F.concat(piece(x["chunks"], p, s["start"]), name(s["kind_no"]))))
        return F.concat(F.array_join(parts, ""), piece(x["chunks"], F.element_at(x["reach"], -1), F.char_length("text")))

    text = let(F.struct(chunked(F.col("text")).alias("chunks"), prefixes(F.transform(spans, lambda s: s["end"]), most).alias("reach")), replaced)
    return rows.select(*[F.when(F.size(spans) == 0, F.col("text")).otherwise(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
