"""Plain restatements of the contracts, one document at a time, to hold results against."""

import hashlib
import re
import zlib

import numpy as np

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def simhash(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps, bits):
    """Smallest id reachable over links of at most `bits` differing bits, all pairs compared."""
    fp = np.array(fps, np.uint64)
    root = list(range(len(fp)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp[i + 1 :]) <= bits):
            root[find(i)] = find(i + 1 + int(j))
    least = {}
    for i, x in enumerate(ids):
        r = find(i)
        least[r] = min(least.get(r, x), x)
    return [least[find(i)] for i in range(len(fp))]


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def contamination(docs, items, n=13):
    grams = {}
    for item, text in items:
        w = bench_words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            grams.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    lengths = {len(g) for g in grams}
    out = []
    for doc_id, text in docs:
        w, hit, found = bench_words(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if (got := grams.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= got
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def crc_of_ids(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def ok(kind, what):
        d = [int(c) for c in what if c.isdigit()]
        if kind == "ip":
            return all(int(x) <= 255 for x in what.split("."))
        if kind == "card":
            return 12 <= len(d) <= 19 and sum(n if i % 2 == 0 else sum(divmod(2 * n, 10)) for i, n in enumerate(d[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    found = [(m.start(), i, k, m.end()) for i, (k, p) in enumerate(KINDS.items()) for m in re.finditer(p, text or "") if ok(k, m[0])]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]
