"""Operators 1, 2, 3 and 5 against plain restatements, on whole tables."""

import time

import brute
import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from obspipe.llm import decontaminate, packing, queries, simhash, similar, token_counts


def encoder():
    import public_tokenizers as P

    return packing.Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def counter():
    return token_counts.PrefixCounter(queries.tokenizer("piece_bpe_32k.model"))


def test_token_counts_equal_the_library(spark, texts):
    lib = counter().library
    got = {r.doc_id: r for r in queries.op1_token_counts(spark, SF).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        n = len(lib.encode(text or ""))
        assert (got[doc_id].n_bytes, got[doc_id].n_tokens, got[doc_id].over_limit) == (len((text or "").encode()), n, n > 4096)


TEXTS = st.text(st.one_of(st.sampled_from("aeth onsi.\n▁,0é"), st.characters(exclude_categories=["Cs"])), max_size=30)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_prefix_counts_equal_the_library(text):
    c = counter.__dict__.setdefault("kept", counter())
    for i in range(len(text) + 1):
        assert c.count(text, i) == len(c.library.encode(text[:i])), (text, i)


BLANKS = st.text(st.sampled_from(" \n\ta▁é."), max_size=60).map(lambda s: s.replace("\n", " " * 17).replace("\t", " " * 5))


@settings(max_examples=60, deadline=None)
@given(BLANKS)
def test_runs_of_spaces_equal_the_library(text):
    c = counter.__dict__.setdefault("kept", counter())
    for i in range(len(text) + 1):
        assert c.count(text, i) == len(c.library.encode(text[:i])), (text, i)


LONG = [" ", "\n", "\t", "\xa0", "\r\n"]


def test_long_blanks_in_linear_time():
    """A million and more blanks, alone and between words; twice as many take about twice the time."""
    c = counter.__dict__.setdefault("kept", counter())
    e = counter.__dict__.setdefault("encoder", encoder())
    for blank in LONG:
        for text in (blank * 1_000_000, "a" + blank * 1_000_000 + "b"):
            assert e.ids(text) == np.array(e.whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
    for text in (" " * 5_000_000, "a" + " " * 5_000_000 + "b", "\n" * 300_000, "a" + "\t" * 300_000):
        assert c.count(text) == len(c.library.encode(text))
    took = []
    for n in (500_000, 1_000_000, 2_000_000):
        start = time.process_time()
        units, ends, counts = c.table("a" + " " * n + "b\n" * (n // 10))
        c.longest_prefix(units, ends, counts, 4096)
        took.append(time.process_time() - start)
    assert took[2] < 8 * max(took[0], 0.05)


def test_longest_prefix(texts):
    c = counter()
    for _, text in texts[:12]:
        units, ends, counts = c.table(text)
        k = c.longest_prefix(units, ends, counts, 50)
        fits = [i for i in range(min(len(text), k + 60) + 1) if len(c.library.encode(text[:i])) <= 50]
        assert k == max(fits)


def test_simhash_whole_table(spark, texts):
    got = {r.doc_id: r for r in queries.op2_simhash(spark, SF).collect()}
    fps = [brute.simhash(t) for _, t in texts]
    want = brute.components([i for i, _ in texts], fps, 4)
    assert len(got) == len(texts)
    for (doc_id, _), fp, c in zip(texts, fps, want):
        assert (got[doc_id].fingerprint, got[doc_id].component_id) == (f"{fp:016x}", c)


@pytest.mark.parametrize("bits", [4, 8])
def test_simhash_dense_groups(spark, monkeypatch, bits):
    """Random walks and dense balls of fingerprints; anchors are split, batches are small."""
    monkeypatch.setattr(simhash, "RESIDENTS", 40)
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 2**63, 40)]
    for c in list(fps[:6]):
        x = c
        for _ in range(60):
            x ^= 1 << int(rng.integers(0, 64)) | 1 << int(rng.integers(0, 64)) | 1 << int(rng.integers(0, 64))
            fps.append(x)
        fps += [c ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))) for _ in range(150)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(x - (x >> 63 << 64),) for x in fps], "fp long")
    from obspipe.llm.components import components

    found = {r.node: r.root for r in components(simhash.links(df, bits)).collect()}
    roots = [found.get(x - (x >> 63 << 64), x - (x >> 63 << 64)) for x in fps]
    want = brute.components(range(len(fps)), fps, bits)
    assert len({*zip(roots, want)}) == len({*roots}) == len({*want})


def test_packing_whole_table(spark, texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    ids = {i: e.ids + [1] for (i, _), e in zip(texts, Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode_batch([t or "" for _, t in texts], add_special_tokens=False))}
    rows = queries.op3_packing(spark, SF).collect()
    check_packing(rows, ids)
    used = sum(len(v) for v in ids.values())
    assert used / (2048 * len({r.sequence_id for r in rows})) > 0.97


def check_packing(rows, ids):
    at, place = {}, {}
    for r in rows:
        assert r.ids_crc32 == brute.crc_of_ids(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        at.setdefault(r.doc_id, []).append((r.start, r.length))
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at.keys() == ids.keys()
    for spans, end in [(v, len(ids[k])) for k, v in at.items()] + [(v, None) for v in place.values()]:
        total = 0
        for start, length in sorted(spans):
            assert start == total and length > 0
            total += length
        assert total == end or end is None and total <= 2048


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_encoder_equals_the_tokenizer(text):
    e = counter.__dict__.setdefault("encoder", encoder())
    assert e.ids(text) == np.array(e.whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()


def test_best_fit_takes_the_tightest():
    lengths = np.array([6, 5, 4, 3, 2])
    number, offset, n = packing.best_fit_decreasing(lengths, np.argsort(-lengths), 10)
    assert n == 2 and list(number) == [0, 1, 0, 1, 1] and list(offset) == [0, 0, 6, 5, 8]


@pytest.mark.parametrize("most", [decontaminate.BROADCAST, 0])
def test_decontamination_whole_table(spark, texts, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST", most)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted(brute.contamination(texts, items))
    got = sorted(tuple(r) for r in queries.op5_decontamination(spark, SF).collect())
    assert got == want and any(r[-1] for r in got)


@pytest.mark.parametrize("most", [decontaminate.BROADCAST, 0])
def test_decontamination_short_items(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST", most)
    docs = [(1, "A b-c, d e"), (2, "x " * 40 + "y"), (3, None), (4, ""), (5, "q r s"), (6, "É é D E")]
    items = [(1, "b c"), (2, "B C D"), (3, None), (4, "..."), (5, "x " * 13 + "y"), (1, "d"), (None, "s")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in decontaminate.judged(d, i).collect())
    want = sorted((a, b, c, e) for a, b, c, e, _, _ in brute.contamination(docs, [x for x in items if x[0] is not None]))
    assert [x for x in got if x[0] != 5] == [x for x in want if x[0] != 5] and (5, 3, 1, 0) in got
    texts = {r.doc_id: r.text for r in decontaminate.without_spans(d, i).collect()}
    assert texts[1] == "A e" and texts[2] == "" and texts[3] is None


def test_decontamination_equal_rows_and_common_windows(spark, monkeypatch):
    """Beyond the broadcast bound, 20,000 equal rows and a window that stands in every item."""
    monkeypatch.setattr(decontaminate, "BROADCAST", 0)
    common = " ".join(f"w{i}" for i in range(13))
    docs = spark.range(20_000).selectExpr("1L as doc_id", f"'a b {common} c' as text").union(spark.createDataFrame([(2, "none of it")], "doc_id long, text string"))
    items = spark.range(300).selectExpr("id as item_id", f"concat('{common} x', id) as text")
    got = decontaminate.judged(docs, items).groupBy("doc_id", "n_words", "n_hit", F.size("items").alias("n_items")).count().collect()
    assert sorted(tuple(r) for r in got) == [(1, 16, 13, 300, 20_000), (2, 3, 0, 0, 1)]


def test_odd_rows(spark, odd, none):
    ids = sorted(odd.select("doc_id").collect(), key=str)
    model = queries.tokenizer("piece_bpe_32k.model")
    lib = counter().library
    for r in token_counts.prefix_tables(odd, model).join(odd.select("doc_id", "text").distinct(), "doc_id").collect():
        assert r.n_tokens == len(lib.encode(r.text or ""))
    near = simhash.near_duplicates(odd).collect()
    assert len(near) == len(ids)
    group = {r.doc_id: r.component_id for r in near}
    assert group[4] == group[5] == 4 and group[1] == group[2] == group[10] == 1
    kept = similar.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 7, 8, 9, None]
    packed = queries.pack(odd).collect()
    assert {r.doc_id: r.length for r in packed if r.start == 0 and r.doc_id in (1, 2)} == {1: 1, 2: 1}
    bench = spark.createDataFrame([(0, "same text of words here")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.judged(odd, bench).filter("contaminated").collect()) == [4, 5, 5]
    assert decontaminate.clean(odd, bench).columns == odd.columns
    for empty in (token_counts.prefix_tables(none, model), simhash.near_duplicates(none), queries.pack(none), decontaminate.judged(none, bench), decontaminate.judged(odd.limit(0), bench.limit(0))):
        assert empty.count() == 0
    assert decontaminate.judged(odd, bench.limit(0)).filter("contaminated").count() == 0
