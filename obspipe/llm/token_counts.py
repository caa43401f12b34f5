"""Token counts by prefix dynamic programming.

For a text the operator stores the exact number of tokens of its prefixes, so that truncation and
budget questions need no second encoding. The vocabulary is a sentencepiece BPE model: no piece holds
a word-start mark after another character, so a text falls into units (a run of spaces and what
follows up to the next space) whose tokens never cross. The table of a text is the exact running count
at every unit's end; inside a unit a second table holds the count at every character. That inner table
is filled left to right: the encoding of a prefix ends with the one piece that forms a valid pair with
the last piece of the shorter prefix, and a pair is valid if merging its characters gives back the pair.
Pieces of several marks merge after all others, so a run of marks keeps apart from a word whose own mark has
merged, and takes that mark in where it has not; counts of a run repeat with the longest such piece, which is
looked up once in the library.

Null and empty texts have no tokens and empty tables. Long texts are handled unit by unit; repeated
rows give repeated results; a null doc_id stays null; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
#: Entries that a worker's memo holds at most; beyond that, counts are computed again.
MEMO = 800_000
#: Characters of the longest unit that the memo holds.
SHORT = 64
#: Characters of the texts whose units are learnt together.
LEARN = 1 << 22

SCHEMA = "doc_id long, n_bytes long, n_tokens long, limit_chars long, prefix_chars array<int>, prefix_tokens array<int>"


class PrefixCounter:
    """Exact token counts of every prefix of a text under a sentencepiece BPE model."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        lib = self.library
        self.score = {
            lib.id_to_piece(i): lib.get_score(i)
            for i in range(lib.get_piece_size())
            if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))
        }
        self.longest = max(map(len, self.score))
        self.pairs: dict[tuple[str, str], bool] = {}
        #: pieces that merging their characters gives back
        self.usable = {piece for piece in self.score if self.merge(piece) == [piece]}
        #: counts of runs of marks, up to two lengths of the longest piece of marks alone
        self.blank = max(n for n in range(1, self.longest + 1) if MARK * n in self.score)
        self.blanks = np.array([0, 1, *(len(lib.encode(" " * n)) for n in range(1, 2 * self.blank))])
        self.units: dict[str, int] = {}
        self.fresh: dict[str, int] = {}

    def merge(self, s: str) -> list[str]:
        """The pieces of s by merging the best-scored neighbours, leftmost first."""
        p = list(s)
        while len(p) > 1:
            best, at = None, -1
            for i in range(len(p) - 1):
                x = self.score.get(p[i] + p[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                break
            p[at : at + 2] = [p[at] + p[at + 1]]
        return p

    def valid(self, a: str, b: str) -> bool:
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        found = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return found

    def run(self, n: np.ndarray) -> np.ndarray:
        """Tokens of n marks alone."""
        more = np.maximum(0, n // self.blank - 1)
        return self.blanks[n - more * self.blank] + more

    def unit(self, u: str) -> np.ndarray:
        """Counts at every prefix of one unit, its word-start marks included."""
        n = len(u) - len(u.lstrip(MARK)) - 1  # marks before the word's own
        last: list[str | None] = [None]
        count = [0]
        self.extend(u[n:], last, count)
        if not n:
            return np.array(count)
        alone = [False]  # whether the word's mark is a piece by itself
        for i in range(1, len(count)):
            before = i - (len(last[i]) if last[i] else 1)
            alone.append(alone[before] if before else last[i] == MARK)
        ends = np.array(count[1:]) + np.where(alone[1:], self.run(np.array(n + 1)) - 1, self.run(np.array(n)))
        return np.concatenate([self.run(np.arange(n + 1)), ends])

    def extend(self, u: str, last: list, count: list) -> None:
        """Go on with the table (last piece and count of each prefix) of a prefix of u to the end of u."""
        usable, known, longest = self.usable, self.pairs.get, self.longest
        for i in range(len(count), len(u) + 1):
            for j in range(i - longest if i > longest else 0, i):
                piece = u[j:i]
                if piece in usable:
                    before = last[j]
                    if before is not None:
                        ok = known((before, piece))
                        if not (self.valid(before, piece) if ok is None else ok):
                            continue
                    last.append(piece)
                    count.append(count[j] + 1)
                    break
            else:  # no piece for this character: its bytes, which merge with nothing
                last.append(None)
                count.append(count[i - 1] + len(u[i - 1].encode("utf-8", "surrogatepass")))

    def learn(self, texts: list[str]) -> None:
        """Fill the memo with the units of some texts, in sorted order: the table of a shared prefix is kept."""
        self.fresh = {}
        known, new = self.units, set()
        for text in texts:
            if not self.irregular(text):
                new.update(u for u in text.split(" ") if u not in known)
        last: list[str | None] = [None]
        count, before = [0], ""
        for u in sorted(new):
            n, most = 0, min(len(u), len(before))
            while n < most and u[n] == before[n]:
                n += 1
            del last[n + 2 :], count[n + 2 :]  # the mark counts too
            self.extend(MARK + u, last, count)
            before = u
            (known if len(known) < MEMO and len(u) <= SHORT else self.fresh)[u] = count[-1]

    def irregular(self, text: str) -> bool:
        return not text or "  " in text or MARK in text or text[0] == " " or text[-1] == " "

    def total(self, u: str) -> int:
        found = self.units.get(u) or self.fresh.get(u)
        if found is None:
            found = int(self.unit(MARK + u if not u.startswith(MARK) else u)[-1])
            if len(self.units) < MEMO and len(u) <= SHORT:
                self.units[u] = found
        return found

    def table(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Units, and the end (in characters of the text) and running token count of each."""
        if not text:
            return [], np.zeros(0, np.int32), np.zeros(0, np.int32)
        if self.irregular(text):
            units = UNIT.findall(MARK + text.replace(" ", MARK))
            sizes = np.fromiter(map(len, units), np.int64, len(units))
            tokens = np.fromiter((self.total(u if u.startswith(MARK * 2) else u[1:]) for u in units), np.int64, len(units))
        else:
            units = text.split(" ")
            sizes = np.fromiter(map(len, units), np.int64, len(units)) + 1
            known = self.units.get
            found = [known(u) for u in units]
            if None in found:
                found = [self.total(u) if c is None else c for u, c in zip(units, found)]
            tokens = np.array(found, np.int64)
        return units, np.cumsum(sizes) - 1, np.cumsum(tokens)

    def count(self, text: str, chars: int | None = None) -> int:
        """Tokens of the first `chars` characters (all by default), from the table."""
        units, ends, counts = self.table(text)
        if not units or chars == 0:
            return 0
        chars = len(text) if chars is None else min(chars, len(text))
        i = int(np.searchsorted(ends, chars, "right")) - 1
        before, at = (int(counts[i]), int(ends[i])) if i >= 0 else (0, -1)
        if at == chars or i + 1 >= len(units):
            return before
        u = units[i + 1]
        return before + int(self.unit(u if u.startswith(MARK) else MARK + u)[chars - at])

    def longest_prefix(self, units: list[str], ends: np.ndarray, counts: np.ndarray, limit: int) -> int:
        """Characters of the longest prefix with at most `limit` tokens."""
        i = int(np.searchsorted(counts, limit, "right"))
        before, at = (int(counts[i - 1]), int(ends[i - 1])) if i else (0, -1)
        if i == len(units):
            return max(at, 0)
        u = units[i]
        inner = self.unit(u if u.startswith(MARK) else MARK + u)
        return max(0, at + int(np.flatnonzero(before + inner <= limit)[-1]))


def prefix_tables(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """One row per row of docs (doc_id, text) with its prefix table.

    prefix_chars, prefix_tokens: exact token counts of the prefixes that end where a unit ends;
    limit_chars: characters of the longest prefix of at most `limit` tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept(("prefix counter", model), lambda: PrefixCounter(model))
        for batch in batches:
            n_bytes, n_tokens, fits, ends, counts = [], [], [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ahead = at = 0
            for i, text in enumerate(texts):
                if i == ahead:
                    while ahead < len(texts) and (at < LEARN or i == ahead):
                        at, ahead = at + len(texts[ahead]), ahead + 1
                    counter.learn(texts[i:ahead])
                    at = 0
                units, e, c = counter.table(text)
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                n_tokens.append(int(c[-1]) if units else 0)
                fits.append(len(text) if n_tokens[-1] <= limit else counter.longest_prefix(units, e, c, limit))
                ends.append(e.astype(np.int32))
                counts.append(c.astype(np.int32))
            at = pa.array(np.cumsum([0, *map(len, ends)]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, np.int32), *x]))) for x in (ends, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(fits, pa.int64()), *lists],
                names=["doc_id", "n_bytes", "n_tokens", "limit_chars", "prefix_chars", "prefix_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
