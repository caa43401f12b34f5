"""Hashed words of a text, and hashes of any run of them, for many runs at once."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Words:
    """The hashed words of a text (A-Z lower-cased, ASCII white space between) and where its lines end among them."""

    def __init__(self, text: str):
        import xxhash

        digest = xxhash.xxh64_intdigest
        data = text.encode("utf-8", "surrogatepass").lower()
        lines = [x.split() for x in data.split(b"\n")]
        self.ends = np.cumsum([0, *map(len, lines)])
        n = int(self.ends[-1])
        self.w = np.array([digest(x) for line in lines for x in line], np.uint64)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, ODD)]), dtype=np.uint64)
        self.undo = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BACK)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.w * power[:n], dtype=np.uint64)])

    def runs(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the runs [first, last) of words."""
        return mixed((self.sums[last] - self.sums[first]) * self.undo[first] + (last - first).astype(np.uint64))

    def shingles(self, words: int) -> np.ndarray:
        """Hashes of all runs of so many words."""
        at = np.arange(max(0, len(self.w) - words + 1))
        return self.runs(at, at + words)
