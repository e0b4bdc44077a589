"""Words of many texts at once, as numpy arrays over code points."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: its lower case (one code point, so that places stay), whether it is a letter, and whether a letter or a mark that combines with one."""
    lower, letter, part = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            letter[i] = part[i] = True
            lower[i] = ord(c.lower()[0])
        elif i >= 0x300 and unicodedata.category(c)[0] == "M":
            part[i] = True
    return lower, letter, part


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _BASE)), np.cumprod(np.full(n, _INVERSE))


class Words:
    """Lower-cased words (runs of letters and of marks that combine with them) of some texts.

    cp: code points of all texts, a 0 after each; start, stop: of each word in cp; doc: whose it is;
    first: the index of each text's first word, and the number of words at the end; letters: how
    many letters, without marks, each text has; bounds: where each text begins in cp.
    """

    def __init__(self, texts: list[str | None]):
        whole = [t or "" for t in texts]
        lower, letter, part = tables()
        cp = lower[np.frombuffer(("\0".join(whole) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)]
        mask = part[cp]
        edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.cp, self.mask = cp, mask
        self.start, self.stop = edge[::2], edge[1::2]
        self.bounds = np.r_[0, np.cumsum([len(t) + 1 for t in whole], dtype=np.int64)]
        self.letters = np.diff(np.r_[0, np.cumsum(letter[cp])][self.bounds])
        self.first = np.searchsorted(self.start, self.bounds)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, *longest: int | None) -> list[np.ndarray]:
        """64-bit hashes of each word, or of its first so many letters."""
        n = 1 << max(10, int(len(self.cp)).bit_length())
        up, down = _powers(n)
        with np.errstate(over="ignore"):
            sums = np.r_[np.uint64(0), np.cumsum((self.cp.astype(np.uint64) + np.uint64(1)) * up[: len(self.cp)])]
            out = []
            for k in longest:
                stop = self.stop if k is None else np.minimum(self.start + k, self.stop)
                h = (sums[stop] - sums[self.start]) * down[self.start]
                h = (h ^ (h >> np.uint64(29)) ^ np.uint64((k or 0) * 0x632BE5AB)) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
                out.append(h ^ (h >> np.uint64(31)))
        return out


def by_text(values: np.ndarray, first: np.ndarray, operation: np.ufunc, empty: float = 0) -> np.ndarray:
    """operation.reduceat over each text's words; `empty` for a text without any."""
    out = np.full((len(first) - 1, *values.shape[1:]), empty, values.dtype)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        out[some] = operation.reduceat(values, first[some], axis=0)
    return out
