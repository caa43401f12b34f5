"""Language-model scoring with a sharded Elias-Fano n-gram trie.

Tokens: A-Z lower-cased, runs of non-space characters, then one end token; before the first token stand start marks.
The model has contexts of up to order - 1 words and absolute discounting; each level is interpolated with the one
below it, down to the smoothed unigram p(w) = (c + 0.5) / (N + 0.5 * (V + 1)), whose last share stands for all
unknown words:
    p(w | h) = max(c(h, w) - D, 0) / c(h) + D * t(h) / c(h) * p(w | h without its first word)
with t(h) the different successors of h; an unseen context gives the level below.

Documents are dealt into blocks by doc_id. A block sends to each shard (a level, and a range of context hashes) one
compressed message: its different contexts and their successors there, with their training counts. So a hot word or
pair travels once a block, and what is sent grows with the corpus. Beyond FAN shards a block's messages go by relays:
one to a group of shards, which sends on to each of its shards what RELAY blocks have for it, so that messages stay
large however many blocks and shards there are. A shard adds up the counts and builds its part of the trie: a level
of contexts with pointers to a level of successors. Both levels and the pointers are monotone sequences in Elias-Fano
form (successors relative to their context, offset by the context's number), and probabilities are quantised to 16
bits of their logarithm. The levels lie in an anonymous memory map that a lost executor simply builds again. The shard
looks up every block's contexts and successors by successor search within the context and answers in the order asked,
and a block adds up the scores of its documents.

A word with very many successors is split: they are dealt out, by their hashes, to several contexts that stand for it,
each with its own place in a shard, and the sums over its parts, a row for each such word, come to all blocks.

Contexts are known by 64-bit hashes, their successors by the upper 40 bits of theirs. Null texts count as empty (the
end token alone); a null doc_id is the text "null" for the split and stays null. Repeated rows are scored and
counted each. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import mmap
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, parts, saved
from .hashing import ODD, mixed

DISCOUNT = 0.75
#: Characters of text in a block, about, and in a shard's input.
BLOCK, SHARD = 1 << 23, 1 << 24
#: Shards to which a block sends by itself at most; beyond that, groups of shards and blocks that a relay serves.
FAN, RELAY = 1024, 512
#: Successors of a word that lie in one shard, about; the least share of all words that is looked at for that, and the
#: characters of the sample that tells it.
PART, OFTEN, SAMPLE = 1 << 21, 0.001, 1 << 26
START, STOP = b" start", b" end"
STEP = 1 / 4096
NONE = 0xFFFF


class EliasFano:
    """A non-decreasing sequence of n integers below `most` in about 2 + log2(most / n) bits each."""

    def __init__(self, values: np.ndarray, most: int):
        n = len(values)
        self.n, self.low_bits = n, max(0, int(most // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        self.buckets = (int(most) >> self.low_bits) + 2
        ones = np.zeros(n + self.buckets, np.uint8)
        ones[high + np.arange(n)] = 1
        bits = np.packbits(ones, bitorder="little")
        self.high = np.zeros(-(-len(bits) // 8) * 8, np.uint8)
        self.high[: len(bits)] = bits
        self.high = self.high.view(np.uint64)
        # one count in 64 bits: zeros before each word, for select
        real = np.minimum(64, len(ones) - 64 * np.arange(len(self.high)))
        self.zeros = np.concatenate([[0], np.cumsum(real - np.bitwise_count(self.high))]).astype(np.int64)
        self.lows = self._pack(values)

    def _pack(self, values: np.ndarray) -> np.ndarray:
        k = self.low_bits
        words = np.zeros((self.n * k >> 6) + 2, np.uint64)
        if k:
            low = values & np.uint64((1 << k) - 1)
            at = np.arange(self.n, dtype=np.uint64) * np.uint64(k)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(words, word, low << bit)
            over = np.flatnonzero(bit + np.uint64(k) > 64)
            np.bitwise_or.at(words, word[over] + 1, low[over] >> (np.uint64(64) - bit[over]))
        return words

    def map(self) -> EliasFano:
        """Move both levels of bits into a memory map."""
        size = self.high.nbytes + self.lows.nbytes + self.zeros.nbytes
        where = np.frombuffer(mmap.mmap(-1, max(size, 1)), np.uint64)
        at = 0
        for name in ("high", "lows", "zeros"):
            x = getattr(self, name)
            where[at : at + len(x)] = x.view(np.uint64)
            setattr(self, name, where[at : at + len(x)].view(x.dtype))
            at += len(x)
        return self

    def low(self, i: np.ndarray) -> np.ndarray:
        k = self.low_bits
        if not k:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(k)
        word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        low = self.lows[word] >> bit
        over = bit + np.uint64(k) > 64
        low[over] |= self.lows[word[over] + 1] << (np.uint64(64) - bit[over])
        return low & np.uint64((1 << k) - 1)

    def below(self, bucket: np.ndarray) -> np.ndarray:
        """How many values have a high part below `bucket`: the ones before its zero."""
        want = bucket  # zeros before the wanted place
        word = np.searchsorted(self.zeros, want, "left") - 1
        word = np.maximum(word, 0)
        rest = want - self.zeros[word]
        bits = ~self.high[word]
        at = np.zeros(len(word), np.int64)
        for step in (32, 16, 8, 4, 2, 1):  # the place after the rest-th zero of the word
            part = np.bitwise_count((bits >> at.astype(np.uint64)) & np.uint64((1 << step) - 1)).astype(np.int64)
            go = part < rest
            rest = np.where(go, rest - part, rest)
            at = np.where(go, at + step, at)
        place = np.where(want > 0, 64 * word + at + 1, 0)
        return place - want

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Position of the first value >= x for each x (n if there is none)."""
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        lo, hi = self.below(high), self.below(high + 1)
        want = x & np.uint64((1 << self.low_bits) - 1)
        while (todo := np.flatnonzero(lo < hi)).size:
            mid = (lo[todo] + hi[todo]) >> 1
            less = self.low(mid) < want[todo]
            lo[todo] = np.where(less, mid + 1, lo[todo])
            hi[todo] = np.where(less, hi[todo], mid)
        return lo

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i."""
        ones_before = 64 * np.arange(len(self.zeros)) - self.zeros
        word = np.searchsorted(ones_before, i, "right") - 1
        rest = i - ones_before[word] + 1
        at = np.zeros(len(i), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            part = np.bitwise_count((self.high[word] >> at.astype(np.uint64)) & np.uint64((1 << step) - 1)).astype(np.int64)
            go = part < rest
            rest = np.where(go, rest - part, rest)
            at = np.where(go, at + step, at)
        return ((64 * word + at - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.low(i)


def quantised(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities: steps of their binary logarithm's natural scale; NONE for zero."""
    with np.errstate(divide="ignore"):
        code = np.round(-np.log10(p) / STEP)
    return np.where(p > 0, np.clip(code, 0, NONE - 1), NONE).astype(np.uint16)


def restored(code: np.ndarray) -> np.ndarray:
    return np.where(code == NONE, 0.0, 10 ** (-code.astype(np.float64) * STEP))


class Trie:
    """Words and their successors of one shard, from summed training counts."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, starts: np.ndarray, next_words: np.ndarray, next_counts: np.ndarray):
        """words: sorted 64-bit hashes; starts: where the successors of each begin (one more at the end)."""
        total = np.add.reduceat(np.append(next_counts, 0), starts[:-1]) * (np.diff(starts) > 0)
        kinds = np.diff(starts)
        self.total, self.kinds = total, kinds
        context = np.repeat(np.arange(len(words)), kinds)
        self.words = EliasFano(words, 1 << 64).map()
        self.pointers = EliasFano(starts.astype(np.uint64), max(int(starts[-1]), 1)).map()
        self.next = EliasFano(next_words + (context.astype(np.uint64) << np.uint64(40)), max(len(words), 1) << 40).map()
        self.counts = counts
        self.back = quantised(np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0))
        self.seen = quantised((next_counts - DISCOUNT) / np.maximum(total, 1)[context])

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each word and whether it is there."""
        at = self.words.successor(words)
        near = np.minimum(at, self.words.n - 1)
        return near, (self.words.access(near) == words) & (at < self.words.n)

    def follow(self, context: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Codes of the discounted probability of words after contexts (positions); NONE if never seen."""
        if not self.next.n:
            return np.full(len(words), NONE, np.uint16)
        value = words + (context.astype(np.uint64) << np.uint64(40))
        at = np.maximum(self.next.successor(value), self.pointers.access(context).astype(np.int64))
        near = np.minimum(at, self.next.n - 1)
        there = (self.next.access(near) == value) & (at < self.pointers.access(context + 1).astype(np.int64))
        return np.where(there, self.seen[near], NONE)


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([x.nbytes for x in arrays], np.int64).tobytes()
    return zlib.compress(head + b"".join(x.tobytes() for x in arrays), 1)


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw, out, at = zlib.decompress(blob), [], 8 * len(kinds)
    for n, kind in zip(np.frombuffer(raw, np.int64, len(kinds)), kinds):
        out.append(np.frombuffer(raw[at : at + n], kind))
        at += int(n)
    return out


def part_key(key: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The hash of a part of a hot context."""
    return mixed(key * ODD + share + np.uint64(1))


class Level:
    """Contexts of one length (sorted by hash) and their successors among a block's tokens."""

    def __init__(self, keys: np.ndarray, context: np.ndarray, follower: np.ndarray, words: np.ndarray, hot: dict[int, int]):
        """keys: hash of each context; context, follower: numbers for each token; words: sorted hashes of followers;
        hot: contexts whose successors are dealt out to so many contexts of their own."""
        number = np.full(len(keys), -1)
        if hot:
            at, which = np.isin(keys, np.array([*hot], np.uint64)), {k: i for i, k in enumerate(hot)}
            number[at] = [which[k] for k in keys[at].tolist()]
            on = np.flatnonzero(number[context] >= 0)
            share = (words[follower[on]] >> np.uint64(20)) % np.array([*hot.values()], np.uint64)[number[context[on]]]
            more, first, again = np.unique(part_key(keys[context[on]], share), return_index=True, return_inverse=True)
            plain, context = context, context.copy()
            context[on] = len(keys) + again
            number = np.concatenate([np.full(len(keys), -1), number[plain[on[first]]]])
            keys = np.concatenate([keys, more])
        order = np.argsort(keys, kind="stable")
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        self.keys, self.words, self.context, self.place = keys[order], words, rank[context], rank
        self.hot = number[order]  # the hot context whose part each context is, or -1
        self.pairs, self.pair_of = np.unique(self.context * len(words) + follower, return_inverse=True)

    def counts(self, on: np.ndarray) -> np.ndarray:
        """How often each pair occurs in the tokens that `on` marks."""
        return np.bincount(self.pair_of[on], minlength=len(self.pairs))

    def hashes(self) -> np.ndarray:
        """A hash of each pair: the contexts of the next level."""
        context, follower = np.divmod(self.pairs, len(self.words))
        return mixed(self.keys[context] * ODD + self.words[follower])


class Block:
    """The tokens of a block's texts, as numbers of words (sorted by hash), and the levels of their contexts."""

    def __init__(self, texts: list[str], order: int, hot: dict[int, int]):
        import xxhash

        number: dict[bytes, int] = {START: 0, STOP: 1}
        flat, sizes = [], []
        for text in texts:
            w = text.encode("utf-8", "surrogatepass").lower().split()
            flat += [number.setdefault(x, len(number)) for x in w]
            flat.append(1)
            sizes.append(len(w) + 1)
        h = np.array([xxhash.xxh64_intdigest(x) for x in number], np.uint64)
        by = np.argsort(h, kind="stable")
        self.words = h[by]
        rank = np.empty(len(h), np.int64)
        rank[by] = np.arange(len(h))
        self.tokens = rank[np.array(flat, np.int64)]
        self.sizes = np.array(sizes, np.int64)
        first = np.cumsum(self.sizes) - self.sizes
        self.first = first
        before = np.concatenate([[0], self.tokens[:-1]])
        before[first] = rank[0]
        self.levels = [Level(self.words, before, self.tokens, self.words, hot)]
        for length in range(2, order):
            low = self.levels[-1]
            # one context more, of start marks alone
            keys = np.append(low.hashes(), np.uint64(xxhash.xxh64_intdigest(START, length)))
            before = np.concatenate([[0], low.pair_of[:-1]])
            before[first] = len(keys) - 1
            self.levels.append(Level(keys, before, self.tokens, self.words, {}))


MESSAGE = (np.uint64, np.uint32, np.uint32, np.uint32, np.uint8, np.uint32)
ANSWER = (np.uint64, np.uint16, np.uint16)


def message(level: Level, counts: np.ndarray, pairs: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, ...]:
    """Contexts lo..hi of a level with counts of them as tokens, numbers of successors, the successors and their counts."""
    n = len(level.words)
    a, b = np.searchsorted(level.pairs, [lo * n, hi * n])
    context, follower = np.divmod(level.pairs[a:b], n)
    upper = level.words[follower] >> np.uint64(24)
    kinds = np.bincount(context - lo, minlength=hi - lo)
    return level.keys[lo:hi], counts[lo:hi].astype(np.uint32), kinds.astype(np.uint32), (upper >> np.uint64(8)).astype(np.uint32), upper.astype(np.uint8), pairs[a:b].astype(np.uint32)


def opened(blob: bytes) -> tuple[np.ndarray, ...]:
    w, c, kinds, high, low, pc = unpack(blob, *MESSAGE)
    return w, c, kinds.astype(np.int64), (high.astype(np.uint64) << np.uint64(8)) | low, pc


def build(blobs: list[bytes]) -> Trie:
    """The trie of a shard: counts of all blocks' messages added up."""
    parts_ = [opened(b) for b in blobs]
    w = np.concatenate([p[0] for p in parts_])
    words, at = np.unique(w, return_inverse=True)
    counts = np.bincount(at, weights=np.concatenate([p[1] for p in parts_])).astype(np.int64)
    context = np.repeat(at, np.concatenate([p[2] for p in parts_]))
    follower = np.concatenate([p[3] for p in parts_])
    n = np.concatenate([p[4] for p in parts_]).astype(np.int64)
    context, follower, n = context[n > 0], follower[n > 0], n[n > 0]
    order = np.lexsort((follower, context))
    context, follower, n = context[order], follower[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (follower[1:] != follower[:-1])])) if len(n) else np.zeros(0, np.int64)
    sums = np.add.reduceat(n, new) if len(new) else n
    starts = np.searchsorted(context[new], np.arange(len(words) + 1))
    return Trie(words, counts, starts, follower[new], sums)


def answer(trie: Trie, blob: bytes) -> bytes:
    w, _, kinds, follower, _ = opened(blob)
    at, _ = trie.find(w)  # every context of a message is in its shard's trie
    return pack(trie.counts[at].astype(np.uint64), trie.back[at], trie.follow(np.repeat(at, kinds), follower))


def joined(parts_: list[tuple[np.ndarray, ...]]) -> bytes:
    """Several messages or answers as one, with the length of each array."""
    sizes = np.array([[len(x) for x in p] for p in parts_], np.int64)
    return pack(sizes.ravel(), *(np.concatenate(x) for x in zip(*parts_)))


def parted(blob: bytes, kinds: tuple) -> list[tuple[np.ndarray, ...]]:
    sizes, *arrays = unpack(blob, np.int64, *kinds)
    ends = np.cumsum(sizes.reshape(-1, len(kinds)), axis=0)
    return [tuple(x[e - n : e] for x, e, n in zip(arrays, end, size)) for end, size in zip(ends, sizes.reshape(-1, len(kinds)))]


def hot_contexts(texts: DataFrame, size: int) -> dict[int, int]:
    """Hashes of the words that, by a sample of the texts, have over PART successors, and into how many parts those are dealt.

    The sample decides only where successors lie; counts cover all of them. There are at most 1 / OFTEN such words.
    """
    import xxhash

    some = texts.sample(min(1.0, SAMPLE / max(size, 1)), 1)
    words = some.select(F.explode(F.split(ascii_lower(F.col("text")), r"[\x20\x09-\x0D]+")).alias("w")).groupBy("w").count()
    words = saved(words, "words")
    total, rows = words.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0], some.count()
    often = words.filter((F.col("w") != "") & (F.col("count") > OFTEN * total)).collect()
    discard(words)
    scale = max(size / SAMPLE, 1.0) / PART
    found = {xxhash.xxh64_intdigest(r.w.encode()): r["count"] * scale for r in often} | {xxhash.xxh64_intdigest(START): rows * scale}
    return {k: int(np.ceil(x)) for k, x in sorted(found.items()) if x > 1}


def score(docs: DataFrame, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; order: words of an n-gram, 2 at least."""
    text = F.coalesce("text", F.lit(""))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 5 == 1
    size = docs.agg(F.coalesce(F.sum(F.char_length("text") + 64), F.lit(0))).first()[0]
    blocks, ranges = parts(size, BLOCK), parts(size, SHARD)
    shards, lengths = ranges * (order - 1), range(order - 1)
    group = max(1, -(-shards // FAN))  # shards of a group
    relayed = group > 1
    # the row's text takes part, so that many rows of one doc_id don't meet in a block
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    rows = docs.select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text.alias("text"))
    hot = hot_contexts(rows.select("text"), size)
    edge = np.array([(s << 64) // ranges for s in range(1, ranges)], np.uint64)

    def cuts(level: Level) -> list[int]:
        return [0, *np.searchsorted(level.keys, edge), len(level.keys)]

    def sent(block: int, found: list[tuple[int, tuple]], kind: str, name: str) -> pa.Table:
        """One row for each (number, arrays)."""
        return pa.table({"block": pa.array([block] * len(found), pa.int32()), kind: pa.array([s for s, _ in found], pa.int32()), name: pa.array([x if isinstance(x, bytes) else pack(*x) for _, x in found], pa.binary())})

    def ask(key: tuple, group_: pa.Table) -> pa.Table:
        own = Block(group_.column("text").to_pylist(), order, hot)
        on = np.repeat(~group_.column("held_out").to_numpy(zero_copy_only=False), own.sizes)
        out: list[tuple[int, tuple]] = []
        for k, level in enumerate(own.levels):
            counts = np.zeros(len(level.keys), np.int64)
            if k == 0:
                counts[level.place[: len(own.words)]] = np.bincount(own.tokens[on], minlength=len(own.words))
            pairs, at = level.counts(on), cuts(level)
            out += [(k * ranges + s, message(level, counts, pairs, lo, hi)) for s, (lo, hi) in enumerate(zip(at, at[1:])) if hi > lo]
        if relayed:  # a message for each group: its shards' messages in order, empty ones too
            by = dict(out)
            none = tuple(np.zeros(0, t) for t in MESSAGE)
            out = [(g, joined([by.get(s, none) for s in range(g * group, min(shards, (g + 1) * group))])) for g in sorted({s // group for s in by})]
        return sent(key[0].as_py(), out, "shard", "ask")

    def relay(key: tuple, rows_: pa.Table) -> pa.Table:
        """What RELAY blocks have for the shards of a group, sent on to each shard; a block of the result stands for all of them."""
        g, some = (x.as_py() for x in key)
        order_ = np.argsort(rows_.column("block").to_numpy())
        each = [parted(rows_.column("ask")[int(i)].as_py(), MESSAGE) for i in order_]
        return sent(some, [(g * group + j, joined([m[j] for m in each])) for j in range(len(each[0])) if any(len(m[j][0]) for m in each)], "shard", "ask")

    def reply(key: tuple, rows_: pa.Table) -> pa.Table:
        packs = rows_.column("ask").to_pylist()
        each = [[pack(*m) for m in parted(b, MESSAGE)] if relayed else [b] for b in packs]
        trie = build([b for x in each for b in x])
        words = int(key[0].as_py()) < ranges  # the first level tells how many tokens and different words there are
        tokens, kinds = (int(trie.counts.sum()), int((trie.counts > 0).sum())) if words else (0, 0)
        parts_of = []
        if words and hot:  # of the parts of hot contexts: how often they occur, which the answers tell as their count, and how many successors
            share = np.concatenate([np.arange(x) for x in hot.values()]).astype(np.uint64)
            which = np.repeat(np.arange(len(hot)), [*hot.values()])
            at, there = trie.find(part_key(np.array([*hot], np.uint64)[which], share))
            at, which = at[there], which[there]
            trie.counts[at] = trie.total[at]
            parts_of = [{"k": int(k), "total": int(t), "kinds": int(s)} for k, t, s in zip(which, trie.total[at], trie.kinds[at])]
        answers = [joined([unpack(answer(trie, b), *ANSWER) for b in x]) if relayed else answer(trie, x[0]) for x in each]
        n = len(packs)
        return pa.table({
            "block": rows_.column("block"), "shard": rows_.column("shard"), "reply": pa.array(answers, pa.binary()),
            "tokens": pa.array([tokens] + [0] * (n - 1), pa.int64()), "kinds": pa.array([kinds] + [0] * (n - 1), pa.int64()),
            "hot": pa.array([parts_of] + [[]] * (n - 1), pa.list_(pa.struct([("k", pa.int32()), ("total", pa.int64()), ("kinds", pa.int64())]))),
        })

    def back(key: tuple, asked_: pa.Table, replies_: pa.Table) -> pa.Table:
        """The answers of a group's shards, dealt out to the blocks that asked."""
        g, _ = (x.as_py() for x in key)
        blocks_ = np.sort(asked_.column("block").to_numpy())
        found = {s: parted(b, ANSWER) for s, b in zip(replies_.column("shard").to_pylist(), replies_.column("reply").to_pylist())}
        none = tuple(np.zeros(0, t) for t in ANSWER)
        out = [joined([found[s][i] if s in found else none for s in range(g * group, min(shards, (g + 1) * group))]) for i in range(len(blocks_))]
        return pa.table({"block": pa.array(blocks_, pa.int32()), "shard": pa.array([g] * len(out), pa.int32()), "reply": pa.array(out, pa.binary())})

    asked = rows.groupBy("block").applyInArrow(ask, "block int, shard int, ask binary")
    if relayed:
        asked = saved(asked.withColumn("some", F.expr(f"block div {RELAY}").cast("int")), "asked")
        to_shards = asked.groupBy("shard", "some").applyInArrow(relay, "block int, shard int, ask binary")
    else:
        to_shards = asked
    replies = saved(to_shards.groupBy("shard").applyInArrow(reply, "block int, shard int, reply binary, tokens long, kinds long, hot array<struct<k int,total long,kinds long>>"), "replies")
    n, v = replies.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    # a row for each hot context
    sums = {r.k: (r.total, r.kinds) for r in replies.select(F.inline("hot")).groupBy("k").agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds")).collect()}
    hot_total, hot_kinds = (np.array([sums.get(i, (0, 0))[j] for i in range(len(hot))], float) for j in (0, 1))
    if relayed:
        of = replies.select("block", "shard", "reply", F.expr(f"shard div {group}").cast("int").alias("g"))
        answered = asked.select("block", "shard", "some").groupBy("shard", "some").cogroup(of.groupBy("g", "block")).applyInArrow(back, "block int, shard int, reply binary")
    else:
        answered = replies.select("block", "shard", "reply")

    def add(key: tuple, group_: pa.Table, answers: pa.Table) -> pa.Table:
        own = Block(group_.column("text").to_pylist(), order, hot)
        found = dict(zip(answers.column("shard").to_pylist(), answers.column("reply").to_pylist()))
        if relayed:
            found = {g * group + j: x for g, b in found.items() for j, x in enumerate(parted(b, ANSWER))}
        else:
            found = {s: unpack(b, *ANSWER) for s, b in found.items()}
        model = base = None
        for k in lengths:
            level = own.levels[k]
            c, less, seen = map(np.concatenate, zip(*(found[k * ranges + s] for s in range(ranges) if k * ranges + s in found)))
            less, share = restored(less), np.ones(len(c))
            if k == 0:
                own_c = c[level.place[: len(own.words)]]
                model = base = ((own_c + 0.5) / (n + 0.5 * (v + 1)))[own.tokens]
                known = (own_c > 0)[own.tokens]
                part, of = np.flatnonzero(level.hot >= 0), level.hot[level.hot >= 0]
                all_ = np.maximum(hot_total[of], 1)
                share[part], less[part] = c[part] / all_, np.where(hot_total[of] > 0, DISCOUNT * hot_kinds[of] / all_, 1.0)
            model = restored(seen)[level.pair_of] * share[level.context] + less[level.context] * model
        total = lambda x: np.add.reduceat(x, own.first)
        return pa.table({
            "doc_id": group_.column("doc_id"), "held_out": group_.column("held_out"), "n_tokens": own.sizes,
            "n_known": total(known.astype(np.int64)), "train_tokens": np.full(len(own.sizes), n, np.int64),
            "base_score": total(np.log10(base)), "score": total(np.log10(model)),
        })

    both = rows.groupBy("block").cogroup(answered.groupBy("block"))
    return both.applyInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
