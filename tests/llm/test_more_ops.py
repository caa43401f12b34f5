"""Operators 4, 6 to 10 and the pipeline against plain restatements, and on odd rows."""

import bisect
import collections
import hashlib
import math
import re
import zlib

import brute
import numpy as np
import pytest
from brute import KINDS, base_spans
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from obspipe.llm import fingerprint, lm, pii, quality, queries, sharding, simhash, stages, substring

HARD = ["a@b.c_d@e.f x@foo@bar.com", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255", "4111 1111-1111 1111 4111111111111112", "+1 (988) 555-2485) +1(((( +12", "😀 é a.b@c-d.e.f. 10.0.0.1", "a@b@c.d.", "12345678901234567890 1"]


def test_pii_base(spark, texts):
    docs = texts + [(10_000 + i, t) for i, t in enumerate(HARD)] + [(20_000, "1" * 9000 + "@" + "a." * 5000), (20_001, "7-" * 9000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    for doc_id, text in docs:
        want, r = base_spans(text), got[doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text[:60]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in KINDS]
        assert set(want) <= set(r.spans.split(",")) | {""}


def lm_scores(docs, order):
    """The model of lm.py restated with plain counters; (held out, tokens, known, N, base, score) of each document."""
    tok = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(brute.UP)) + ["</e>"] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tok}
    c, after = collections.Counter(), [collections.defaultdict(collections.Counter) for _ in range(order - 1)]
    grams = lambda w, k: zip(*((["<s>"] * k + w)[j:] for j in range(k + 1)))
    for i, w in tok.items():
        if not held[i]:
            c.update(w)
            for k in range(1, order):
                for *h, x in grams(w, k):
                    after[k - 1][tuple(h)][x] += 1
    n, v = sum(c.values()), len(c)
    out = {}
    for i, w in tok.items():
        p = uni = [(c[x] + 0.5) / (n + 0.5 * (v + 1)) for x in w]
        for k in range(1, order):
            now = []
            for (*h, x), low in zip(grams(w, k), p):
                s = after[k - 1].get(tuple(h))
                total = sum(s.values()) if s else 0
                now.append(low if not s else max(s[x] - lm.DISCOUNT, 0) / total + lm.DISCOUNT * len(s) / total * low)
            p = now
        out[i] = held[i], len(w), sum(c[x] > 0 for x in w), n, sum(map(math.log10, uni)), sum(map(math.log10, p))
    return out


def same_scores(rows, want):
    got = {r.doc_id: r for r in rows}
    assert len(got) == len(want)
    for i, (*exact, base, score) in want.items():
        r = got[i]
        assert [r.held_out, r.n_tokens, r.n_known, r.train_tokens] == exact
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, abs=4e-4 * r.n_tokens)
    return got


def test_lm(spark, texts):
    got = same_scores(queries.op6_lm_scoring(spark, SF).collect(), lm_scores(texts, 2))
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


@pytest.mark.parametrize("order,fan", [(3, 1024), (4, 1024), (2, 3), (3, 4)])
def test_lm_orders_blocks_and_relays(spark, texts, monkeypatch, order, fan):
    """Longer contexts, many small blocks and shards, sent straight and by relays."""
    for name, value in (("BLOCK", 120_000), ("SHARD", 150_000), ("FAN", fan), ("RELAY", 3), ("PART", 150)):
        monkeypatch.setattr(lm, name, value)
    docs = texts[:400] + [(9001, None), (9002, ""), (9003, "a a a a a")]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    hot = lm.hot_contexts(table.select(F.coalesce("text", F.lit("")).alias("text")), sum(len(t or "") for _, t in docs))
    assert len(hot) > 3 and max(hot.values()) > 3
    same_scores(lm.score(table, order).collect(), lm_scores(docs, order))


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, most in ((0, 10), (1, 1 << 64), (5, 3), (1000, 1 << 64), (4000, 5000)):
        x = np.sort(rng.integers(0, most, n, np.uint64, endpoint=False)) if most < 1 << 64 else np.sort(rng.integers(0, (1 << 64) - 1, n, np.uint64, endpoint=True))
        ef = lm.EliasFano(x, most).map()
        if n:
            assert (ef.access(np.arange(n)) == x).all()
            asked = np.concatenate([x, x[:50] + np.uint64(1), rng.integers(0, int(x[-1]) + 1, 100, np.uint64)])
            asked = asked[asked < most] if most < 1 << 64 else asked
            assert (ef.successor(asked) == np.searchsorted(x, asked)).all()


def test_fingerprints(spark, texts):
    rows = {r.doc_id: r for r in queries.op7_fingerprints(spark, SF).collect()}
    tx = dict(sorted(texts))
    ids = list(tx)
    seen = {}
    for i, j in zip(ids, ids[1:] + ids[:1]):
        k = len(tx[i]) // 4
        edited = tx[i][: len(tx[i]) - k] + tx[j][:k]
        assert rows[i].n_chars == len(tx[i]) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(tx[i], rows[i].fingerprint) == rows[i].fingerprint
        if edited == tx[i]:
            assert rows[i].near_edited == 1.0
    near, far = (np.array([r[c] for r in rows.values()]) for c in ("near_edited", "near_next"))
    assert near.mean() > 0.35 and far.mean() < 0.05 and (near >= 0.15).mean() > 0.9


def plain_fingerprint(text, lexicon):
    """The fingerprint of fingerprint.py restated: level, and the signatures at that level and at the next."""
    import xxhash

    h = {x - (x >> 63 << 64) for x in (xxhash.xxh64(t.encode(), 42).intdigest() for t in re.split(r"[\x20\x09-\x0D!-/:-@\[-`{-~]+", text.translate(brute.UP)) if t)}
    level = max(0, math.floor(math.log2(max(len(h), 1) / 32)))
    kept = lambda n: sorted(x for x in h if x % (1 << n) == 0 and x in lexicon)
    return level, kept(level), kept(level + 1)


def test_fingerprint_lexicon_and_likeness(spark, texts):
    """Texts of equal lexicon terms have equal fingerprints, others not; likeness is the share of equal groups of terms."""
    docs = texts[:300]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    terms = fingerprint.lexicon(table.select("text"), 0.01, 0.3)
    lexicon = {r.h for r in terms.collect()}
    words = {i: {w for w in re.split(r"[\x20\x09-\x0D!-/:-@\[-`{-~]+", t.translate(brute.UP)) if w} for i, t in docs}
    df = collections.Counter(w for x in words.values() for w in x)
    assert len(lexicon) == sum(max(2, math.ceil(3.0)) <= n <= 90 for n in df.values())
    rows = {r.doc_id: r for r in fingerprint.edited(table, 0.01, 0.3).collect()}
    ids = sorted(rows)
    own = {i: plain_fingerprint(t, lexicon) for i, t in docs}

    def groups(x, y):
        """Equal and non-empty groups of two lists of terms, dealt by four of their bits."""
        deal = lambda h: [tuple(t for t in h if t >> 20 & 15 == g) for g in range(16)]
        some = [(a, b) for a, b in zip(deal(x), deal(y)) if a or b]
        return sum(a == b for a, b in some), len(some)

    told = 0
    for i, j in zip(ids, ids[1:] + ids[:1]):
        (l1, a1, b1), (l2, a2, b2) = own[i], own[j]
        assert (rows[i].fingerprint == rows[j].fingerprint) == (own[i] == own[j]) or not (a1 and a2)
        pairs = {0: [(a1, a2), (b1, b2)], 1: [(a1, b2)], -1: [(b1, a2)]}.get(l1 - l2, [])
        if all(a and b for a, b in pairs) and own[i] != own[j]:
            same, some = (sum(x) for x in zip(*(groups(a, b) for a, b in pairs))) if pairs else (0, 0)
            told += bool(some)
            assert rows[i].near_next == pytest.approx(same / some if some else 0.0)
    assert told > 50


def test_ranges_of_hot_and_missing_ids(spark, texts, monkeypatch):
    """A third of the rows without doc_id, a third of one id, and narrow ranges: each row's next one is the same as in one range."""
    docs = [((None, 7, i)[i % 3], t) for i, (_, t) in enumerate(texts[:300])]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    columns = ("doc_id", "n_chars", "edited_sha256", "near_next")
    whole = sorted(map(str, fingerprint.edited(table).select(*columns).collect()))
    monkeypatch.setattr(fingerprint, "RANGE", 1 << 12)
    assert fingerprint.ranged(table).groupBy("r").count().agg(F.max("count")).first()[0] < 40
    assert sorted(map(str, fingerprint.edited(table).select(*columns).collect())) == whole


def test_sharding(spark, texts):
    rows = queries.op8_sharding(spark, SF).collect()
    tx = dict(texts)
    load, slots, where = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        data = tx[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[tx[r.doc_id]].add(r.shard)
    assert len(rows) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(load) == 24
    biggest, mean = max(r["size"] for r in rows), sum(load.values()) / 24
    assert max(abs(x - mean) for x in load.values()) <= biggest
    assert sum(len(s) > 1 for s in where.values()) <= 24


def test_sharding_hot_text(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot " * 9).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    load = [r["b"] for r in sharding.shard(df, 7).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(load) == 7 and max(load) - min(load) <= 100


def plain_ring(rows, shards):
    """The ring walked place by place; rows: (place, bytes) in ring order. A shard with its share of the bytes is full."""
    nodes = sharding.points(shards)
    places = [p for p, _ in nodes]
    load, open_, total, out = [0] * shards, set(range(shards)), sum(b for _, b in rows), []
    for place, size in rows:
        at = bisect.bisect_left(places, place)
        clockwise = [nodes[(at + k) % len(nodes)][1] for k in range(len(nodes))]
        share = lambda: (total - sum(x for s, x in enumerate(load) if s not in open_)) / len(open_)
        large = size * sharding.LARGE > share()
        while True:
            shard = next(s for s in clockwise if s in open_)
            if large or len(open_) == 1 or load[shard] + size / 2 <= share():
                break
            open_.discard(shard)
        if large:
            room = [s for s in clockwise if s in open_ and load[s] + size / 2 <= share()]
            shard = room[0] if room else min(open_, key=lambda s: (load[s], s))
        full = len(open_) > 1 and load[shard] + size >= share()
        load[shard] += size
        if large and full:
            open_.discard(shard)
        out.append(shard)
    return out, load


@pytest.mark.parametrize("case", ["half repeats one row", "one long text", "many long texts"])
def test_sharding_large_rows(spark, case):
    """Repeated rows are divided; a row beyond the share fills one shard, and the others share the rest."""
    rng = np.random.default_rng(4)
    rows = [(i, "w" * int(rng.integers(30, 60))) for i in range(1500)]
    rows += {"half repeats one row": [(-1, "again " * 8)] * 1500, "one long text": [(-1, "x" * 10_000_000)], "many long texts": [(-i, "y" * int(rng.integers(2000, 40_000))) for i in range(1, 30)]}[case]
    result = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    load, slots = collections.Counter({s: 0 for s in range(8)}), collections.defaultdict(list)
    for r in result:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    sizes = sorted(load.values())
    assert len(result) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len(t) + 8 for _, t in rows)
    if case == "one long text":
        assert sizes[-1] >= largest and sizes[-2] - sizes[0] <= 68
    else:
        # of 1500 equal rows a few share one of the 1024 places
        assert sizes[-1] - sizes[0] <= 5 * largest if case == "half repeats one row" else sizes[-1] - sizes[0] <= largest


def test_sharding_restated_and_movement(spark, texts):
    """Shards equal a plain walk over the ring, and one more shard moves few bytes."""
    df = spark.createDataFrame(texts[:600], "doc_id long, text string")
    rows = sorted((r.place, r["size"]) for r in sharding.placed(df).collect())
    found = {n: sharding.shard(df, n) for n in (6, 7)}
    where = {}
    for n, result in found.items():
        want, load = plain_ring(rows, n)
        got = result.groupBy("shard").agg(F.sum("size").alias("b")).collect()
        assert sorted(r.b for r in got) == sorted(load)
        where[n] = {(p, i): s for i, ((p, _), s) in enumerate(zip(rows, want))}
    rng = np.random.default_rng(1)
    many = sorted((int(p), int(b)) for p, b in zip(rng.integers(0, 1 << sharding.BITS, 20_000), rng.integers(8, 4000, 20_000)))
    before, load = plain_ring(many, 24)
    after, _ = plain_ring(many, 25)
    mean = sum(load) / 24
    moved = sum(b for (_, b), x, y in zip(many, before, after) if x != y) / sum(load)
    assert max(load) / mean < 1.01 and moved < 0.15  # the least possible is 0.04


def test_substring(spark, texts):
    rows = {r.doc_id: r for r in queries.op9_substring_dedup(spark, SF).collect()}
    assert len(rows) == len(texts)

    def sharing(n):
        first, out = {}, set()
        for i, t in texts:
            w = t.translate(brute.UP).split()
            for k in range(len(w) - n + 1):
                j = first.setdefault(tuple(w[k : k + n]), i)
                if j != i:
                    out |= {i, j}
        return out

    found = {i for i, r in rows.items() if r.repeated}
    must = sharing(60)
    assert must and len(must - found) <= len(must) // 100 and not found - sharing(substring.SHINGLE)
    assert all(r.n_removed <= r.n_repeated <= r.n_words for r in rows.values())
    assert substring.tune(0.8, 0.98) == (8, 4)


def test_substring_lines_against_jaccard(spark):
    """Near lines are found with a recall of 0.9 and more, crowded buckets too, and none without a partner of 0.8."""
    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.integers(10**9)}"
    lines = []
    for size, edits in ((60, 1), (120, 3), (200, 5)):
        for _ in range(120):
            x = [word() for _ in range(size)]
            y = list(x)
            for at in rng.choice(size, int(rng.integers(1, edits + 1)), replace=False):
                y[at] = word()
            lines += [x, y]
    common = [word() for _ in range(12)]  # what many lines that aren't alike begin with: one large bucket or more
    lines += [[*common, *(word() for _ in range(12))] for _ in range(400)]
    template = [word() for _ in range(150)]
    for _ in range(150):  # a crowd of lines, near and not so near each other
        y = list(template)
        for at in rng.choice(150, int(rng.integers(1, 4)), replace=False):
            y[at] = word()
        lines.append(y)
    docs = [(i, " ".join(x)) for i, x in enumerate(lines)]
    rows = substring.repeats(spark.createDataFrame(docs, "doc_id long, text string"))
    ids = {r.uid: r.doc_id for r in rows.filter(F.col("kind") == substring.DOC).collect()}
    found = {ids[r.uid] for r in rows.filter(F.col("kind") == substring.LINE).collect()}
    sets = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in lines]
    by = collections.defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            by[g].add(i)
    near = {i for i, s in enumerate(sets) for j in {j for g in s for j in by[g]} if i != j and len(s & sets[j]) >= 0.8 * len(s | sets[j]) - 1e-9}
    assert len(near) > 400 and not found - near and len(found) >= 0.9 * len(near)


def test_substring_near_lines(spark):
    rng = np.random.default_rng(2)
    line = [f"w{rng.integers(10**9)}" for _ in range(60)]
    other = lambda k: " ".join(line[:k] + ["new"] + line[k + 1 :])
    docs = [(1, "a\n" + " ".join(line)), (2, other(0) + "\nb"), (3, other(59)), (4, " ".join(f"x{i}" for i in range(60))), (5, " ".join(line[:25] + ["q"] * 35))]
    got = {r.doc_id: r for r in substring.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i].repeated for i in (1, 2, 3, 4)] == [True, True, True, False]
    assert [got[i].n_removed > 0 for i in (1, 2, 3, 4)] == [False, True, True, False] and got[3].holders == [1]


def test_substring_short_lines(spark):
    docs = [(1, "All rights are reserved here.\nfirst text"), (2, "other\nall rights ARE reserved here.\nmore"), (3, "All rights are reserved"), (4, "All rights are reserved here.\nAll rights are reserved here.")]
    rows = {r.doc_id: r for r in substring.dedup(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()}
    assert [rows[i].n_short for i in (1, 2, 3, 4)] == [0, 5, 0, 10] and not any(r.repeated or r.spans for r in rows.values())
    assert [tuple(s) for s in rows[2].short_spans] == [(1, 6, False)] and [tuple(s) for s in rows[1].short_spans] == [(0, 5, True)] and not rows[3].short_spans


def test_substring_keeps_every_repeated_word_once(spark):
    """Copies that share a passage with an earlier document lose the passage only, the later copy all of it."""
    fresh = iter(range(10**6))
    words = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    passage, other = words(70), words(90)
    second = words(80) + passage + words(60) + other + words(80)
    docs = [words(50) + passage + words(50), words(40) + other + words(40), second, second, words(30) + second[200:] + words(30)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r for r in substring.dedup(table).collect()}
    stays = collections.Counter()
    for i, w in enumerate(docs):
        removed = {k for s in rows[i].spans if not s.keep for k in range(s.first, s.last)}
        assert len(removed) == rows[i].n_removed
        stays.update(x for k, x in enumerate(w) if k not in removed)
    assert {x for w in docs for x in w} == stays.keys()
    assert rows[2].n_removed >= 80 and rows[3].n_removed == len(second)
    assert all(stays[x] == 1 for s in rows[2].spans if not s.keep for x in second[s.first : s.last])
    assert all(stays[x] == 1 for x in second[:200] if x not in passage)
    assert rows[0].n_removed == rows[1].n_removed == 0


def test_substring_embedded_passages():
    """Every passage of over 50 words in foreign text has a matched segment of MIN_RUN words, also with few different words."""
    rng = np.random.default_rng(3)
    for n, most in [(51, 10**9), (51, 30), (51, 3), (55, 10**9), (60, 10**9)]:
        word = lambda k: [f"w{x}" for x in rng.integers(0, most, k)]
        for _ in range(300):
            passage, found = word(n), []
            for _ in range(2):
                before = rng.integers(0, 40)
                text = substring.Units(" ".join(word(before) + passage + word(rng.integers(0, 40))))
                first, last = text.segments()
                inside = (first >= before) & (last <= before + n)
                found.append({(a - before, b - before, h) for a, b, h in zip(first[inside], last[inside], text.runs(first, last)[inside])})
            assert found[0] & found[1] and all(b - a >= substring.MIN_RUN for a, b, _ in found[0] & found[1])


def test_quality(spark):
    got = queries.op10_quality(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    both = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    good = [r.keep == (r.quality == 1 and r.toxic == 0) for r in both]
    assert np.mean(good) > 0.93 and np.mean([r.keep for r in both if r.quality == 1 and not r.toxic]) > 0.97


def test_quality_held_out(spark, monkeypatch):
    """Fitted on two thirds of the labels, judged on the rest. Both views hand labels over; the metadata view gains by it."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    part = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3)) == 0
    loss, right = {}, {}
    for rounds in (1, quality.ROUNDS):
        monkeypatch.setattr(quality, "ROUNDS", rounds)
        model = quality.trained(docs, labels.filter(~part))
        both = quality.scored(docs, model).join(labels.filter(part), "doc_id").collect()
        y = np.array([r.quality == 1 and not r.toxic for r in both])
        for c in ("text_score", "meta_score", "score"):
            p = np.clip([r[c] for r in both], 1e-6, 1 - 1e-6)
            loss[rounds, c], right[rounds, c] = -np.log(np.where(y, p, 1 - p)).mean(), ((p > 0.5) == y).mean()
    kept = lambda f: np.mean([r.keep for r in both if f(r)])
    assert kept(lambda r: r.quality == 1 and not r.toxic) > 0.97 and kept(lambda r: r.quality == 0) < 0.1 and kept(lambda r: r.quality == 1 and r.toxic) < 0.1
    assert {v for _, v, total, used in model.exchanged if used} == {0, 1} and any(v == 0 and used > 2000 for _, v, _, used in model.exchanged)
    assert loss[3, "meta_score"] < loss[1, "meta_score"] - 0.02
    # the text view, nearly always right by itself, neither gains nor loses
    assert right[3, "text_score"] >= right[1, "text_score"] - 0.003 and right[3, "score"] >= right[1, "score"] - 0.003


def test_quality_samples(spark):
    """A sample has its size at any number of rows, and equal descriptions are one row for the driver."""
    rate = spark.range(2_000_000).filter(quality.sampled(10**7, 2 * 10**10, 5, "id")).count()
    assert 850 < rate < 1150 and (1000 << 63) // (2 * 10**10) > 0
    assert spark.range(50).filter(quality.sampled(1000, 50, 5, "id")).count() == 50
    hot = spark.range(100_000).selectExpr("array(0.5D, 1D) as numbers", "array(1S) as words", "1S as source", "2S as lang", "1 as label")
    cold = spark.range(30).selectExpr("array(0.5D, cast(id as double) + 2) as numbers", "array(1S) as words", "1S as source", "2S as lang", "0 as label")
    n, rows = quality.handed(hot.union(cold), 1000, 3)
    assert n == 100_030 and len(rows) == 31 and sorted(r[4] for r in rows) == [1] * 30 + [100_000]


def test_quality_restated(spark, texts):
    """Regressions are at their optimum; cuts, exchanged labels and scores equal plain restatements on a small table."""
    rng = np.random.default_rng(6)
    x, y, w = rng.normal(0, 2, (200, 5)), rng.integers(0, 2, 200).astype(float), rng.uniform(0.2, 2, 200)
    m = quality.Logistic(x, y, w)
    z = np.hstack([(x - x.mean(0)) / x.std(0), np.ones((200, 1))])
    assert np.abs(z.T @ (w * (y - 1 / (1 + np.exp(-z @ m.beta)))) - np.array([1.0] * 5 + [1e-6]) * m.beta).max() < 1e-2
    odds, good = np.round(rng.normal(0, 3, 300), 1), rng.integers(0, 2, 300)
    odds[good == 1] += 5
    found = []
    for sign in (-1, 1):
        best = sign * np.inf
        for cut in sorted({o for o in odds if sign * o > 0}, key=lambda o: -sign * o):
            own = [g == (sign > 0) for o, g in zip(odds, good) if sign * o >= sign * cut]
            p, n = np.mean(own), len(own)
            if (p + 0.5 / n - math.sqrt(p * (1 - p) / n + 0.25 / n**2)) / (1 + 1 / n) >= quality.RIGHT:
                best = cut
        found.append(best)
    assert quality.confident(odds, good) == pytest.approx(tuple(found)) and np.isfinite(found).any()
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.trained(docs, labels, pseudo=10**9)
    vocabulary = list(model.vocabulary)
    rows = {r.doc_id: quality.described((r.text or "").encode(), r.lang, r.source, r.n_chars, model.vocabulary) for r in docs.collect()}
    known = {r.doc_id: int(r.quality == 1 and r.toxic == 0) for r in labels.collect()}
    fold = {r.doc_id: r.h for r in labels.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10)) >= 8).alias("h")).collect()}
    ids = sorted(known)
    open_ = collections.Counter(tuple(map(repr, r)) for i, r in rows.items() if i not in known)
    of = {tuple(map(repr, r)): r for r in rows.values()}

    def ask(m, v):
        sure = [k for k in open_ if m.sure([of[k]], v)[0] >= 0]
        return sum(open_[k] for k in sure), sorted((*of[k], open_[k]) for k in sure)

    plain = quality.CoTrained(vocabulary).fit([rows[i] for i in ids], np.array([fold[i] for i in ids]), np.array([known[i] for i in ids]), ask)
    assert plain.exchanged == model.exchanged and plain.exchanged
    scores = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    assert [scores[i] for i in rows] == pytest.approx(list(plain.judged(list(rows.values()))[2]), abs=1e-6)


def test_quality_pseudo_labels_teach_the_other_view():
    """A view with few labels learns from the other one's confident predictions."""
    rng = np.random.default_rng(3)

    def documents(n):
        good = rng.integers(0, 2, n)
        rows = [([0.0] * 6 + [float(g) + rng.normal(0, 0.05)] + [0.0] * 3 + list(rng.normal(3 * g, 1.2, 2)) + [0.0, 0.0], [], 0, 0) for g in good]
        return rows, good

    (few, y), (open_, truth) = documents(60), documents(4000)
    held = np.arange(60) % 10 >= 5

    def ask(model, v):
        found = model.sure(open_, v)
        return int((found >= 0).sum()), [(*r, 1) for r, s in zip(open_, found) if s >= 0]

    taught = quality.CoTrained([]).fit(few, held, y, ask)
    alone = quality.CoTrained([]).fit(few, held, y, lambda model, v: (0, []))
    right = lambda m: np.mean((m.judged(open_)[1] > 0.5) == truth)
    assert {v for _, v, *_ in taught.exchanged} == {0, 1} and max(n for _, _, n, _ in taught.exchanged) > 1000
    assert right(taught) >= right(alone) and right(taught) > 0.9


def test_odd_rows(spark, odd, none):
    n = odd.count()
    for df in (pii.report(odd), lm.score(odd), fingerprint.edited(odd), sharding.shard(odd, 3), substring.dedup(odd)):
        assert df.count() == n
    for df in (pii.report(none), lm.score(none), fingerprint.edited(none), sharding.shard(none, 3), substring.dedup(none)):
        assert df.count() == 0
    labels = spark.createDataFrame([(1, 1, None), (None, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for docs in (odd, none):
        model = quality.trained(docs, labels)
        assert quality.scored(docs, model).count() == docs.count() == quality.kept(docs, model).count()
        for _, stage in corpus_pipeline.STAGES[1:4]:
            assert stage(spark, docs, SF).columns == docs.columns
            assert stage(spark, docs, SF).count() <= docs.count()
        assert stages.packing(spark, docs, SF).count() >= docs.count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, kept = [docs], docs
    for name, stage in corpus_pipeline.STAGES:
        from obspipe.llm.common import saved

        kept = saved(stage(spark, kept, SF), name)
        seen.append(kept)
    start, good, single, pure, private, packed = seen
    assert all(x.columns == docs.columns for x in seen[:-1])
    tx = [tuple(r) for r in good.select("doc_id", "text").collect()]
    assert len({t for _, t in tx}) >= single.count() == len({r.text for r in single.collect()})
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    judged = brute.contamination([tuple(r) for r in single.select("doc_id", "text").collect()], items)
    assert {r.doc_id for r in pure.collect()} == {r[0] for r in judged if not r[-1]}
    assert not any(base_spans(r.text) for r in private.collect()) and private.count() == pure.count()
    assert packed.select("doc_id").distinct().count() == private.count() == corpus_pipeline.run(spark, SF).select("doc_id").distinct().count()


def test_simhash_reaches_all_links_at_every_threshold(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, 300, np.uint64)
    near = base.copy()
    for i, k in enumerate(rng.integers(1, 14, 300)):
        for b in rng.choice(64, k, replace=False):
            near[i] ^= np.uint64(1 << int(b))
    fps = np.unique(np.concatenate([base, near]))
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for bits, rows in ((4, 600), (4, 10**7), (4, 10**10), (8, 600), (8, 10**9), (0, 600), (1, 600)):
        wanted = {frozenset((int(x), int(y))) for i, x in enumerate(fps) for y in fps[i + 1 :] if (int(x) ^ int(y)).bit_count() <= bits}
        found = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in simhash.links(table, bits, rows).collect()}
        assert found == wanted and (wanted or bits < 2)
    sizes = [[b.width for b in simhash.layout(4, n)] for n in (10**5, 10**10)]
    assert len(sizes[0]) > len(sizes[1])
    # comparisons for each fingerprint stay bounded while their number grows a million times
    assert sum(b.places * 10**10 / b.anchors for b in simhash.layout(4, 10**10)) < 20 * sum(b.places * (simhash.PLACE + 10**4 / b.anchors) for b in simhash.layout(4, 10**4))


def test_dense_anchors_give_the_classes_of_all_pairs():
    rng = np.random.default_rng(7)

    def around(centre: int, n: int, most: int) -> list[int]:
        return [centre ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(0, most + 1), replace=False)) for _ in range(n)]

    def classes(n: int, pairs) -> list[int]:
        root = list(range(n))

        def find(i: int) -> int:
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            a, b = find(int(a)), find(int(b))
            root[max(a, b)] = min(a, b)
        return [find(i) for i in range(n)]

    for bits, batch in ((0, 500), (3, 257), (4, 10_000), (5, 999), (6, 257), (8, 10_000), (8, 300)):
        several = [x for c in rng.integers(0, 1 << 62, 20) for x in around(int(c), 12, bits + 2)]
        fps = np.unique(np.array(several + around(12345 << 20, 900, 3 + 2 * bits), np.uint64)).view(np.int64)
        key, role, fp = simhash.placed(fps, simhash.layout(bits, len(fps)))
        order = np.lexsort((role, key))
        key, role, fp = key[order], role[order], fp[order]
        state, found = simhash.AnchorLinks(bits), []
        for i in range(0, len(key), batch):
            part = slice(i, i + batch)
            found += zip(*state.add(key[part], np.zeros(len(key[part]), np.int32), role[part], fp[part]))
        place, u = {int(x): i for i, x in enumerate(fps)}, fps.view(np.uint64)
        wanted = zip(*np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u) <= bits, 1)))
        assert classes(len(fps), ((place[int(a)], place[int(b)]) for a, b in found)) == classes(len(fps), wanted)
        assert not any(a == b for a, b in found)
