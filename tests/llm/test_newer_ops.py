"""Operators 11 to 13 against plain restatements and on odd rows."""

import collections
import hashlib
import math
import random
import re
import string

import brute
import numpy as np
import pytest
from conftest import SF

from obspipe.llm import phrases, queries, secrets, vector_codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(id, code, error) by label and the final codebooks, all distances computed with Python's integers."""
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    d = width // parts
    cut = lambda v: [v[p * d : (p + 1) * d] for p in range(parts)]
    books = list(zip(*[cut(v) for _, v, _ in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]))
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        sums = collections.defaultdict(list)
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                sums[p, near(x, books[p])[1]].append(x)
        books = [[[sum(c) // len(sums[p, k]) for c in zip(*sums[p, k])] if sums[p, k] else e for k, e in enumerate(b)] for p, b in enumerate(books)]
    out, by = [], collections.Counter()
    for i, v, label in kept:
        found = [near(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(f for f, _ in found), label))
        by[label] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by[label], sha) for i, c, e, label in out), key=str)


def test_vector_codes_odd_rows(spark):
    rnd = random.Random(3)
    rows = [(i // 2 if i < 40 else i, [rnd.gauss(0, 0.3) for _ in range(16)], rnd.choice([1, 2, None])) for i in range(300)]
    rows += [(7, [0.5] * 16, 1)] * 3 + [(900, None, 1), (901, [math.nan] * 16, 1), (902, [0.1] * 15 + [None], 1), (903, [math.inf] * 16, 1), (None, [0.25] * 16, 2)]
    rows += [(904, [], None), (905, [0.125] * 9, 3), (906, [1e9, -3e11] * 8, 4), (-1, [-0.0001, 0.0001] * 8, 4)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, v int, code string")
    got = sorted((tuple(r) for r in vector_codes.compressed(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)
    want = [(i, c, *(x if x < 1 << 63 else None for x in (e, t)), s) for i, c, e, t, s in plain_codes(rows)]
    assert got == want


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], None)], [(3, [0.5] * 8, 1), (2, [0.25] * 8, 1)]])
def test_vector_codes_few_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST", 0)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = [tuple(r) for r in vector_codes.compressed(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got, key=str) == plain_codes(rows)


def test_equal_average_search_is_exact_and_stops_early():
    rnd = np.random.default_rng(5)
    for scale in (3, 1000, 1 << 40):
        # small numbers tie often
        entries, parts = rnd.integers(-scale, scale, (16, 8)), rnd.integers(-scale, scale, (500, 8))
        book = vector_codes.Codebook(entries.tolist())
        which, far = book.nearest(parts)
        every = ((parts[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
        assert [int(x) for x in far] == [int(min(r)) for r in every]
        assert list(which) == [min(range(16), key=lambda k: (r[k], k)) for r in every]
        assert book.compared < 500 * 16


def plain_secrets(text):
    """Base spans of a text: kind:start:end."""
    kinds = {"assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    lower = (text or "").translate(brute.UP)  # case of letters matters in the first pattern's names only
    found = []
    for n, (k, p) in enumerate(kinds.items()):
        for m in re.finditer(p, lower if k == "assign" else text or ""):
            if len(m[2] if k == "assign" else m[0]) >= {"assign": 12, "access": 18, "hex": 16}[k]:
                found.append((m.start(), n, f"{k}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(found)]


HARD = [
    "token=secret: abcdefghijklmnop", "PassWord\"  :  'Aa0+/_.=-Aa0+/ x", "apiKEY=x api_key = 0123456789abcdef0123", "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop", "AKIAAKIA" + "A" * 9 + " AKIA" + "B1" * 7 + "é",
    "😀 token:" + "f" * 40, "password=" * 3000, "secret" + " " * 20_000 + "= abcdefghijkl", "token " * 3000 + "k" * 100_000, "a1" * 50_000,
]


def test_secrets_base(spark, texts, odd, none):
    docs = texts + [(10_000 + i, t) for i, t in enumerate(HARD)]
    got = {r.doc_id: r for r in secrets.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        want, r = plain_secrets(text), got[doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), text[:60]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if not s.startswith("novel")] == want and len(spans) == len(want) + r.n_novel
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0])))
    rows = secrets.report(odd).collect()
    assert sorted(r.doc_id is None for r in rows) == sorted(r.doc_id is None for r in odd.collect())
    assert secrets.report(none).count() == 0


def test_secrets_novelty(spark):
    """Planted keys that no base pattern has are found, ordinary strings in the same places aren't."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").filter("text is not null")
    rnd = random.Random(11)
    texts = [r.text[:400] for r in docs.orderBy("doc_id").limit(600).collect()]
    letters = string.ascii_letters + string.digits
    words = sorted({w for t in texts for w in re.findall(r"[a-zé]{12,}", t)})
    plain = ["/usr/local/lib/python3/site-packages", "client_credentials_grant", "configuration_value", "-" * 20, "abcabcabcabcabcabc", "correct-horse-battery-staple"]
    planted = []
    for i, t in enumerate(texts):
        key = i % 2 == 0
        what = "".join(rnd.choice(letters) for _ in range(rnd.randint(16, 40))) if key else rnd.choice(plain + words)
        name = rnd.choice(["the passphrase is ", "credential -> ", "private_key(", "Authorization Bearer ", "pwd '"])
        planted.append((i, t + " " + name + what + ") " + t[:100], len(t) + 1 + len(name), what, key))
    primed = secrets.dictionary(docs)
    found = {r.doc_id: r.found for r in secrets.scanned(spark.createDataFrame([p[:2] for p in planted], "doc_id long, text string"), primed).collect()}
    hit = {i: any(f.kind == "novel" and f.start == at and f.end == at + len(what) for f in found[i]) for i, _, at, what, _ in planted}
    right, wrong = sum(hit[p[0]] for p in planted if p[4]), sum(hit[p[0]] for p in planted if not p[4])
    assert right >= 0.95 * 300 and wrong <= 0.05 * 300
    assert secrets.dictionary(docs) == primed
    # away from sensitive words the same strings are left alone
    far = spark.createDataFrame([(p[0], "x " * 50 + p[3]) for p in planted], "doc_id long, text string")
    assert all(f.kind != "novel" for r in secrets.scanned(far, primed).collect() for f in r.found)


def plain_phrases(rows, longest=4, least=30, inside=80, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(brute.UP)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    found = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    dropped = {(lang, *w[i : i + k]) for (lang, *w), a in found.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * a >= inside * f[(lang, *w[i : i + k])]}
    rows = []
    for (lang, *w), a in found.items():
        if (lang, *w) not in dropped:
            score, k = min((2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w)))
            rows.append((lang, -score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    seen, out = collections.Counter(), []
    for lang, score, a, phrase, left, right in sorted(rows):
        seen[lang] += 1
        if seen[lang] <= top:
            out.append((lang, seen[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("block,shard,ranked", [(phrases.BLOCK, phrases.SHARD, phrases.RANKED), (50_000, 5_000, 7)])
def test_phrases(spark, monkeypatch, block, shard, ranked):
    """The whole table, in one block a task and in many, with one shard and many, ranked at once and in shares."""
    for name, value in (("BLOCK", block), ("SHARD", shard), ("RANKED", ranked)):
        monkeypatch.setattr(phrases, name, value)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = plain_phrases([(r.lang, r.text) for r in docs.collect()])
    assert len(want) > 100 and sorted(tuple(r) for r in queries.op13_phrases(spark, SF).collect()) == want


def test_phrases_odd_rows(spark, none):
    rnd = random.Random(2)
    few = ["a", "b", "c\x01", "É", "é", "d\x00d", "日本"]
    rows = [(rnd.choice(["x", None, "und"]), rnd.choice(["", "!\t"]).join(rnd.choice(few) + rnd.choice([" ", "\t ", ". ", "\n"]) for _ in range(rnd.randint(0, 60))), 1) for _ in range(400)]
    rows += [("x", None, 1), ("x", "", 1), ("y", " \t ", 1), ("z", "go go go " * 20_000, 1), ("x", "A A A A A", 1)] + [("r", "one two three four five", 1)] * 40
    df = spark.createDataFrame(rows, "lang string, text string, phrase int")
    for least, inside in ((30, 80), (3, 100), (5, 20)):
        got = sorted(tuple(r) for r in phrases.collocations(df, least=least, inside=inside, top=50).collect())
        assert got and got == plain_phrases([r[:2] for r in rows], least=least, inside=inside, top=50)
    assert phrases.collocations(none).count() == 0
