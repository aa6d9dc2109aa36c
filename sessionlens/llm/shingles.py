"""Word shingles of texts as sorted 64-bit hashes, for a batch of texts at once."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers, one for each word of a shingle.
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                    0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and where each text's begin."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = ~_BLANK[data]
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    before = np.concatenate([[False], inside[:-1]])
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
    sizes = ends - starts
    powers = np.cumprod(np.full(int(sizes.max()), _BASE, np.uint64))
    at = np.flatnonzero(inside)
    place = at - np.repeat(starts, sizes)
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * powers[place]
    sums = np.add.reduceat(terms, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    offsets = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return mix(sums + sizes.astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``size`` words. A text of fewer
    words has one shingle of them all, a text without words none."""
    words, begin = word_hashes(texts)
    n = len(words)
    runs = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        runs += words[k:k + len(runs)] * _PLACES[k]
    runs = mix(runs)
    out = []
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a:b - size + 1]))
        elif b > a:
            out.append(mix(np.array([(words[a:b] * _PLACES[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
