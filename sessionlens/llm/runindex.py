"""Numpy parts of the run-length index: anchors of texts, and matching statistics of segments."""

from __future__ import annotations

import functools

import numpy as np

from .shingles import mix

_BASE = 0x9E3779B97F4A7C15
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def _sliding(x: np.ndarray, width: int, op: np.ufunc, fill) -> np.ndarray:
    """op over x[i:i + width] for every i; past the end counts as ``fill``."""
    n = len(x)
    rows = -(-(n + width - 1) // width)
    padded = np.full(rows * width, fill, x.dtype)
    padded[:n] = x
    table = padded.reshape(rows, width)
    ahead = op.accumulate(table, axis=1).ravel()
    behind = op.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the texts that end at ``ends``: positions in ``data``, hashes, and the windows that
    each stands for: those that start hi to lo bytes before it.

    The anchor of a window of ``length`` bytes is its first run of ``gram`` bytes with the least hash.
    A window determines its anchor, so equal windows have equal anchors at equal places.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none.astype(np.uint64), none, none
    size = 1 << max(16, int(n).bit_length())
    power, inverse = _powers(size)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n])])
    h = np.full(n, _TOP, np.uint64)
    h[:n - gram + 1] = mix((sums[gram:] - sums[:-gram]) * inverse[:n - gram + 1])
    end = np.repeat(ends, np.diff(ends, prepend=0))
    at = np.arange(n)
    h[at + gram > end] = _TOP
    width = length - gram + 1
    least = _sliding(h, width, np.minimum, _TOP)
    least[at + length > end] = 0  # no window begins here
    # a gram is an anchor if the largest of the minima of the windows that hold it is its own
    top = _sliding(least[::-1], width, np.maximum, 0)[::-1]
    pos = np.flatnonzero((top == h) & (h < _TOP))
    # windows of one minimum follow each other; grams of equal hash share their run from left to right
    turn = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(turn[1:], n) - 1
    values, rank = np.unique(least[turn], return_inverse=True)
    order = np.lexsort((turn, rank))
    own = np.searchsorted(values, h[pos])
    run = order[np.searchsorted(rank[order] * n + turn[order], own * n + pos, side="right") - 1]
    by_run = np.lexsort((pos, run))
    before = np.full(len(pos), -1)
    tied = run[by_run][1:] == run[by_run][:-1]
    before[by_run[1:][tied]] = pos[by_run[:-1][tied]]
    first_window = np.maximum(np.maximum(turn[run], before + 1), pos - width + 1)
    last_window = np.minimum(last[run], pos)
    some = first_window <= last_window
    return pos[some], h[pos[some]], (pos - last_window)[some], (pos - first_window)[some]


def aligned(segments: list[bytes], left: np.ndarray, centre: int, width: int) -> np.ndarray:
    """A row for each segment, with ``left`` bytes before its anchor at column ``centre``: byte + 1, or 0
    where it has none."""
    sizes = np.array([len(s) for s in segments])
    flat = np.frombuffer(b"".join(segments), np.uint8)
    out = np.zeros(len(segments) * width, np.uint8)
    begin = np.arange(len(segments)) * width + centre - left
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out[np.arange(len(flat)) + np.repeat(begin - before, sizes)] = flat + np.uint8(1)  # 0xFF isn't in UTF-8
    return out.reshape(len(segments), width)


def repeated_starts(group: np.ndarray, rows: np.ndarray, centre: int, lo: int, hi: int, length: int, gram: int) -> np.ndarray:
    """For each row and each a of lo to hi, whether the ``length`` bytes that start a before the
    anchor stand in another row of its group too. ``group`` is sorted.

    The suffixes of a group that start a before the anchor are kept sorted, with the length of the
    match of neighbours. Going one byte to the left, the column of preceding bytes in that order is
    the group's part of the Burrows-Wheeler transform. Within a run of equal bytes the order stays
    and matches grow by one; only at the ends of runs are matches taken anew, as the least between
    the end of a run and the start of the next run of that byte. The longer of a suffix's two
    neighbour matches is its matching statistic. A suffix whose match doesn't reach over the anchor
    can't be matched further left, nor be a match there, and leaves the index.
    """
    n = len(group)
    out = np.zeros((n, hi - lo + 1), bool)
    base = centre - lo
    right = np.ascontiguousarray(rows[:, base:])
    order = np.argsort(right.view(f"S{right.shape[1]}").ravel(), kind="stable")
    order = order[np.argsort(group[order], kind="stable")]
    g = group[order]
    same = right[order[1:]] == right[order[:-1]]
    same &= right[order[1:]] > 0
    match = np.zeros(n, np.int64)
    match[1:] = np.where(g[1:] == g[:-1], np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1)), 0)
    for a in range(lo, hi + 1):
        if a > lo:
            order, match = _left(rows[order, centre - a], order, g, match)
        best = np.maximum(match, np.append(match[1:], 0))
        out[order, a - lo] = best >= length
        alive = np.flatnonzero(best >= a + gram)
        if not len(alive):
            break
        if len(alive) < len(order):
            match = np.minimum.reduceat(match[:alive[-1] + 1], np.concatenate([[0], alive[:-1] + 1]))
            order, g = order[alive], g[alive]
    return out


def common_prefix(texts: list[str]) -> np.ndarray:
    """Length of what each text has in common with the one before it; 0 for the first."""
    table = np.array([t.encode() for t in texts])
    table = table.view(np.uint8).reshape(len(texts), -1)
    same = (table[1:] == table[:-1]) & (table[1:] > 0)
    return np.concatenate([[0], np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))]) if len(texts) else np.zeros(0, np.int64)


def _left(byte: np.ndarray, order: np.ndarray, g: np.ndarray, match: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order and matches after the step to the left, from the bytes that precede the suffixes."""
    first = np.concatenate([[True], g[1:] != g[:-1]])
    run_ends = (byte[1:] != byte[:-1]) & ~first[1:]
    grown = np.where(first | (byte == 0), 0, match + 1)
    if not run_ends.any():
        return order, grown
    number = np.cumsum(first) - 1
    mixed = np.zeros(number[-1] + 1, bool)
    mixed[number[1:][run_ends]] = True
    at = np.flatnonzero(mixed[number])  # groups of one run stay as they are
    key = number[at] * 256 + byte[at]
    turn = np.argsort(key, kind="stable")
    was, key = at[turn], key[turn]
    follows = np.flatnonzero((key[1:] == key[:-1]) & (key[1:] % 256 > 0)) + 1
    taken = np.zeros(len(at), match.dtype)
    if len(follows):
        spans = np.stack([was[follows - 1] + 1, was[follows] + 1], axis=1).ravel()
        taken[follows] = np.minimum.reduceat(np.append(match, 0), spans)[::2] + 1
    grown[at] = taken
    order = order.copy()
    order[at] = order[was]
    return order, grown
