"""Word shingles of whole texts as 64-bit hashes, for a slice of texts at a time (NumPy).

Words are runs of anything but ASCII white space, with A-Z lower-cased. A word's
hash is the mixed sum of a number that each of its bytes has at its place (a table
entry and the place, mixed; no polynomial, so no regular text makes terms cancel), a
shingle's comes from the mixed hashes of its words.
"""

from __future__ import annotations

import numpy as np

from srcindex.llm.common import BLANKS

_RNG = np.random.default_rng(20240607)
#: A random number per byte; A-Z have those of a-z.
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
ODD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                              0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[ord(c) for c in BLANKS]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done:done + step] = out[:step] * np.uint64(pow(int(base), done, 1 << 64))
        done += step
    return out


class Powers:
    """Powers of BASE and of its inverse, kept for the longest slice so far."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = powers(BASE, size), powers(INVERSE, size)
        return self.up[:n], self.down[:n]


POWERS = Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the word (splitmix64's finish)."""
    h = (h ^ (h >> np.uint64(30))) * ODD[0]
    h = (h ^ (h >> np.uint64(27))) * ODD[1]
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A number for each word (its bytes' places from ``start`` to ``stop``, never empty)."""
    size = stop - start
    first = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(first, size)
    letters = BYTE[data[np.repeat(start, size) + place]]
    return mixed(np.add.reduceat(mixed(letters + place.astype(np.uint64) * ODD[5]), first) + size.astype(np.uint64) * ODD[2])


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes, sorted in each text, and where each text's begin.

    A text of fewer words than ``width`` has its whole sequence as the one shingle;
    a text without words has none.
    """
    raw = [(t or "").encode() for t in texts]
    begin = np.cumsum([0, *(len(r) + 1 for r in raw)])
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    word = ~IS_BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]])))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    h = word_hashes(data, start, stop)
    doc = np.searchsorted(begin, start, "right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    n = len(h) - width + 1
    parts_h, parts_d = [], []
    if n > 0:
        s = np.zeros(n, np.uint64)
        for k in range(width):
            s = mixed(s * ODD[3] + h[k:k + n] * ODD[4] + ODD[5])
        whole = doc[:n] == doc[width - 1:]
        parts_h.append(s[whole])
        parts_d.append(doc[:n][whole])
    first = np.cumsum(n_words) - n_words
    for few in range(1, width):  # texts of fewer words
        short = np.flatnonzero(n_words == few)
        s = np.full(len(short), few, np.uint64) * ODD[6]
        for k in range(few):
            s = mixed(s * ODD[3] + h[first[short] + k] * ODD[4] + ODD[5])
        parts_h.append(s)
        parts_d.append(short)
    s, d = np.concatenate(parts_h).view(np.int64), np.concatenate(parts_d)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[new], d[new]
    return s, np.concatenate([[0], np.cumsum(np.bincount(d, minlength=len(texts)))]).astype(np.int64)
