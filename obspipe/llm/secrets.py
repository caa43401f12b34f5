"""Secrets in texts: fixed patterns, and strings near sensitive words that zstandard can't compress.

Base spans are leftmost non-overlapping matches of three patterns; a match that fails its test is dropped and not tried
again. They are the whole match, so an assignment's span holds its name and its value.

The method adds spans of kind `novel`. Candidates are runs of 12 and more characters that keys are made of, which start
within REACH characters after a sensitive word and touch no base span. What a candidate adds is measured in bytes: its
surroundings (AROUND characters to each side, the candidate itself taken out) are compressed with the candidate at the
end and without it, by a compressor primed with a dictionary of the corpus's most widespread identifiers. The dictionary
is a full one, with tables of how letters are coded: without those a short frame holds letters as whole bytes, and a
rare word would add as much as a key does. A name, a path or a repeated pattern is mostly copied or cheaply coded; a key
adds about as many bytes as it has characters. A candidate that adds NOVELTY bytes a character or more is reported.

For the dictionary every document of the whole table counts (a word once a document), in Spark; the ENTRIES most
widespread words are all that reaches the driver, and the dictionary of DICTIONARY bytes made of them all that tasks get.
Of a corpus with too few words for tables (under LEAST), the words themselves are the dictionary.

Null texts are empty. Offsets are in code points. Repeated rows give repeated results, a null doc_id stays null, and
other columns are ignored. Very long texts cost time in proportion. An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, slices

# fixed values: the patterns of the contract
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]{16,}"),
}
KINDS = (*PATTERNS, "novel")

SENSITIVE = re.compile(r"pass(?:word|wd|phrase|code)|pwd|secret|token|credential|bearer|signature|(?:(?<![a-z])|api|access|private)_?key(?![a-z])|(?<![a-z])auth(?:orization)?(?![a-z])", re.IGNORECASE | re.ASCII)
START = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
REACH = 64
AROUND = 100
NOVELTY = 0.8
LEVEL = 19

ENTRIES = 8192
DICTIONARY = 1 << 14
LEAST = 1000
#: Words of one sample that the dictionary is made from.
SAMPLE = 8
#: Different words that a task counts before it gives them out.
COUNTED = 200_000
#: Bytes of a text that make up identifiers; all others become spaces.
NAMES = bytes(c if chr(c).isalnum() and c < 128 or c == 95 else 32 for c in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the base spans, in that order."""
    found = [(m.start(), 0, m.end()) for m in PATTERNS["assign"].finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in PATTERNS["access"].finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in PATTERNS["hex"].finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of runs near sensitive words that touch no base span, in order."""
    starts = [s for s, _, _ in base]
    ends: list[int] = []  # the furthest end of the base spans so far
    for _, _, e in base:
        ends.append(max(e, ends[-1] if ends else 0))
    found: dict[int, int] = {}
    for word in SENSITIVE.finditer(text):
        for m in START.finditer(text, word.end(), word.end() + REACH):
            at = m.start()
            if at not in found and (run := RUN.match(text, at)):
                before = bisect_right(starts, run.end() - 1)
                if not before or ends[before - 1] <= at:
                    found[at] = run.end()
    return sorted(found.items())


class Novelty:
    """Bytes that a string adds to its surroundings, measured by a primed compressor."""

    def __init__(self, dictionary: bytes):
        primed = zstandard.ZstdCompressionDict(dictionary or b" " * 8)
        primed.precompute_compress(level=LEVEL)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def of(self, text: str, start: int, end: int) -> float:
        """Marginal compressed bytes a character."""
        what = text[start:end]
        around = (text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND] + " ").replace(what, "")
        known = around.encode("utf-8", "surrogatepass")
        return (len(self.zstd.compress(known + what.encode())) - len(self.zstd.compress(known))) / len(what)


def dictionary(docs: DataFrame, entries: int = ENTRIES, size: int = DICTIONARY) -> bytes:
    """A zstandard dictionary of the identifiers of 4 to 40 characters that most documents have, `size` bytes at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update({w for w in text.as_py().encode("utf-8", "surrogatepass").translate(NAMES).split() if 4 <= len(w) <= 40})
                if len(seen) >= COUNTED:
                    yield out(seen)
                    seen = Counter()
        yield out(seen)

    counted = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null").mapInArrow(run, "word string, n long")
    widespread = counted.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.col("n").desc(), "word").limit(entries)
    # written first: collected straight away, each partition would send its own most widespread words to the driver
    widespread = saved(widespread, "identifiers")
    words = [w.encode() for w, _ in sorted(widespread.collect(), key=lambda r: (-r.n, r.word))]  # `entries` rows at most
    discard(widespread)
    if len(words) < LEAST:
        return b" ".join(reversed(words)).rjust(8)
    samples = [b" ".join(words[i :: len(words) // SAMPLE]) for i in range(len(words) // SAMPLE)]
    # fixed parameters of the search for segments, so that equal words give an equal dictionary
    return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 2), samples, k=64, d=6).as_bytes()


def scanned(docs: DataFrame, primed: bytes, novelty: float = NOVELTY) -> DataFrame:
    """doc_id, found: the spans (kind, start, end, bytes a character that the method measured, null for base ones) of each text."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Novelty(primed)
        for batch in slices(batches):
            every = []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                more = [(s, 3, e, x) for s, e in candidates(text, base) if (x := measure.of(text, s, e)) >= novelty]
                every.append([{"kind": KINDS[k], "start": s, "end": e, "novelty": x} for s, k, e, x in sorted([(*b, None) for b in base] + more, key=lambda x: x[:3])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(every, pa.list_(span))], names=["doc_id", "found"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, found array<struct<kind:string,start:int,end:int,novelty:double>>")


def report(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text): counts by kind, the digest of the base spans, and all spans."""
    found = scanned(docs, dictionary(docs))
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda x: x.kind != "novel")
    return found.select("doc_id", *[count(k) for k in PATTERNS], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"), count("novel"))
