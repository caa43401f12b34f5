"""Packing of documents into token sequences by best-fit decreasing.

A document's ids (byte-level BPE, then one end id) are first cut into full windows; each window is a
sequence of its own. The remainders are dealt out evenly over tasks; every task takes its remainders
longest first and puts each into the open window with the least room that still fits. Room is a small
integer, so the open windows stand in a segment tree indexed by room, whose nodes say whether any
window below has room: the tightest fit is found in log2(window) steps. Tasks see a bounded number of
pieces, so memory stays bounded and only the last windows of each task stay loose.

Null and empty texts are one piece with the end id alone. Ties in length are taken by doc_id, start and
checksum. Repeated rows are packed each for itself; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, parts, saved, slices

END = (1).to_bytes(4, "little")
#: Entries that a task's memo of encoded words holds at most.
MEMO = 150_000
#: Pieces that one packing task takes, about.
PER_TASK = 50_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


class Encoder:
    """Ids of a text, as little-endian 32-bit words, equal to those of the tokenizer file.

    Texts of plain Latin letters go word by word through a memo: the tokenizer's pattern always cuts
    before a single space between two other characters. Words that the memo lacks are merged by the
    rank file of the same vocabulary. All other texts go to the tokenizer as they are, also those with a run of
    BLANKS white-space characters or more, which the other library can't take.
    """

    PLAIN = re.compile("[^\n\x20-\x7e\xa1-\u024f]")
    OTHER = re.compile("[^\x00-\u024f]")
    BLANKS = re.compile(r"\s{10000}")
    SPECIAL = "<|endoftext|>"

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.whole = Tokenizer.from_file(vocabulary)
        self.memo: dict[str, bytes] = {}

    def word(self, w: str) -> bytes:
        """Ids of a word with the space before it."""
        found = np.array(self.words.encode_ordinary(" " + w), np.uint32).tobytes()
        if len(self.memo) < MEMO:
            self.memo[w] = found
        return found

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        odd = self.PLAIN.search(text)
        spaced = odd or "  " in text or "\n " in text or " \n" in text or "\n\n\n" in text or text[0] == " " or text[-1] == " "
        if odd and self.OTHER.search(text) or self.SPECIAL in text or spaced and self.BLANKS.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        if spaced:
            return np.array(self.words.encode_ordinary(text), np.uint32).tobytes()
        first, *rest = text.split(" ")
        known, word = self.memo.get, self.word
        head = np.array(self.words.encode_ordinary(first), np.uint32).tobytes()
        return head + b"".join([known(w) or word(w) for w in rest])


def cut(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, window: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `window` ids: full windows and a remainder for each document."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, ranks, pattern)
        for batch in slices(batches):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(text.as_py() or "") + END
                n = len(ids) // 4
                for start in range(0, n, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    for k, v in zip(out, (doc_id, start, len(piece) // 4, zlib.crc32(piece), n, piece if with_ids else None)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], names=list(out)
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # vocabulary and memo end with the task, as a waiting worker would hold them beside all that follows
        yield from encoded(batches)
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


class Rooms:
    """Open windows by room: a segment tree over 0..window whose nodes count the windows below."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, number: int) -> None:
        self.open[room].append(number)
        self._add(room, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take the window with the least room of at least `length`: its number and room."""
        i = length + self.size
        while not self.count[i]:
            while i & 1:  # a right child: nothing larger below this parent
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return self.open[room].pop(), room


def best_fit_decreasing(lengths: np.ndarray, order: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window number and offset of each piece; how many windows there are."""
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms, n = Rooms(window), 0
    for i in order:
        length = int(lengths[i])
        found = rooms.tightest(length) if length < window else None
        if found is None:
            found, n = (n, window), n + 1
        number[i], offset[i] = found[0], window - found[1]
        if found[1] > length:
            rooms.put(found[1] - length, found[0])
    return number, offset, n


def pack(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, window: int = 2048, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place in it."""
    pieces = saved(cut(docs, vocabulary, ranks, pattern, window, with_ids), "pieces")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = [b for b in batches if b.num_rows]
        if not found:
            return
        rows = pa.Table.from_batches(found)
        number = (TaskContext.get().partitionId()) << 40
        col = {k: rows.column(k).to_numpy(zero_copy_only=False) for k in ("length", "start", "ids_crc32")}
        doc = rows.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.lexsort((col["ids_crc32"], col["start"], doc, -col["length"]))
        seq, offset, _ = best_fit_decreasing(col["length"], order, window)
        keep = [k for k in rows.column_names if k != "ids" or with_ids]
        out = rows.select(keep).append_column("sequence_id", pa.array(seq + number)).append_column("offset", pa.array(offset))
        yield from out.combine_chunks().to_batches()

    n = parts(pieces.count(), PER_TASK)
    slim = pieces if with_ids else pieces.drop("ids")
    return slim.repartition(n).mapInArrow(run, schema.replace("doc_tokens long,", "doc_tokens long, ids binary,") if with_ids else schema)
