"""Boosted trees over sparse rows (L1): histograms, leaf by leaf.

Columns are cut into bins at quantiles of their nonzero values; a row keeps its columns and bins, nothing
for what is zero. Each pass over the rows sums gradients by (model, node, column, bin), the shuffle brings
the sums of one block of columns together, and a block's best split goes to the driver: one row for each node
and block. What a task holds follows the entries that it has read, not the width of a row, and is
sent on in parts beyond a bound.

Several models (one for each fold) grow in the same passes. A tree grows leaf-wise: the split of the highest gain
comes first, up to a number of leaves. Which splits that will be is tried out on what is known, and all nodes whose
split isn't known yet are worked on in one pass, so a tree takes about as many passes as it is deep.

Margins are written with the rows every ``REFRESH`` rounds and else made up from the trees since, so a lost executor costs
no more than its part of a pass.

A pass takes Spark some tenths of a second however few the rows. For many rounds over a table whose bins a task can hold
(``WHOLE_CELLS``, a byte a cell), the rows that a model learns from go to one task, which grows all of that model's trees by the
same rules. Beyond that bound the passes do it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from itertools import groupby
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType

from ..session import scratch_path
from ..sources.storage import remove

#: Rounds between two tables of margins.
REFRESH = 16
#: Columns whose sums meet in one task.
BLOCK_COLUMNS = 4096
#: Cells that a batch sums at once, and sums that a task holds before it sends them on.
CELLS, HELD = 1 << 23, 1 << 22
#: Rounds beyond which a task grows all trees of a model if it can hold them: at most so many cells (rows by columns) and sums.
WHOLE_ROUNDS, WHOLE_CELLS, WHOLE_SUMS = 64, 1 << 26, 1 << 22
#: Rows whose sums are made at once there, and trees that go to the driver in one record.
CHUNK_ROWS, SENT_TREES = 2048, 256
#: Rows, and (row, tree) pairs, that are scored at once.
SCORED = 1 << 14


@dataclass(frozen=True)
class Boosting:
    """Settings. ``columns``: share of the columns that a tree may use; ``l1``, ``l2``: penalties of a leaf's value;
    ``patience``: rounds without a lower loss on the validation rows after which a model ends (None: never)."""

    rounds: int = 4000
    step: float = 0.03
    leaves: int = 64
    columns: float = 0.8
    l1: float = 0.1
    l2: float = 0.1
    min_rows: int = 20
    min_hessian: float = 1e-3
    bins: int = 64
    seed: int = 42
    patience: int | None = None


# ---------------------------------------------------------------- rows

def vector_rows(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ML vectors, sparse or dense, as (begin of each row, columns, values)."""
    values = vectors.field("values")
    sizes = values.value_lengths().fill_null(0).to_numpy()
    begin = np.concatenate([[0], np.cumsum(sizes)])
    dense = np.repeat(vectors.field("type").to_numpy() == 1, sizes)
    cols = np.arange(begin[-1]) - np.repeat(begin[:-1], sizes)
    cols[~dense] = vectors.field("indices").flatten().to_numpy()
    return begin, cols, values.flatten().to_numpy()


def packed(parts: np.ndarray, begin: np.ndarray) -> pa.Array:
    """Binary cells: the bytes of ``parts`` from one begin to the next."""
    at = (np.asarray(begin) * parts.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(np.ascontiguousarray(parts).tobytes())])


def unpacked(cells: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values, begin) of binary cells, without a copy."""
    wide = pa.types.is_large_binary(cells.type)
    _, offsets, data = cells.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[cells.offset:cells.offset + len(cells) + 1]
    size = np.dtype(kind).itemsize
    if data is None or at[-1] == at[0]:
        return np.zeros(0, kind), np.zeros(len(cells) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(kind), (at - at[0]).astype(np.int64) // size


# ---------------------------------------------------------------- bins

@dataclass
class Bins:
    """Upper edges of the bins of each column, after each other: those of column c from ``begin[c]`` on. ``zero`` is the bin of zero."""

    begin: np.ndarray
    edges: np.ndarray
    zero: np.ndarray

    @property
    def width(self) -> int:
        return len(self.begin) - 1

    def of(self, cols: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Bin of each entry: the first whose edge isn't below the value; NaN counts as zero."""
        lo, hi = self.begin[cols], self.begin[cols + 1] - 1  # what is above the last edge is in the last bin
        first = lo.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            low = self.edges[mid] < values
            lo = np.where(open_ & low, mid + 1, lo)
            hi = np.where(open_ & ~low, mid, hi)
        return np.where(np.isnan(values), self.zero[cols], lo - first).astype(np.uint8)


def fit_bins(rows: DataFrame, features: str, bins: int) -> Bins:
    """Quantiles of the nonzero values of every column over all rows, zero always among them. At most ``bins`` numbers a column
    reach the driver."""
    if not 3 <= bins <= 256:
        raise ValueError("bins must be from 3 to 256")
    first = rows.select(features).first()
    if first is None:
        raise ValueError("no rows to fit")
    width = first[0].size

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, cols, values = vector_rows(b.column(0))
            full = (values != 0) & ~np.isnan(values)
            yield pa.RecordBatch.from_pydict({"col": cols[full].astype(np.int32), "value": values[full].astype(np.float64)})

    probs = [float(p) for p in np.linspace(0, 1, bins - 1)[1:]]
    cut = rows.select(features).mapInArrow(entries, "col int, value double").groupBy("col").agg(F.percentile_approx("value", probs, bins * 20).alias("q")).collect()
    edges = [np.zeros(1)] * width
    for r in cut:
        edges[r["col"]] = np.unique(np.append(r["q"], 0.0))
    begin = np.concatenate([[0], np.cumsum([len(e) for e in edges])]).astype(np.int64)
    return Bins(begin, np.concatenate(edges), np.array([np.searchsorted(e, 0.0) for e in edges], np.uint8))


def binned(rows: DataFrame, features: str, label: str, weight: str | None, fold: str | None, validation: str | None, bins: Bins, margins: list[float]) -> DataFrame:
    """y, w, fold (-1: none, -2: a validation row), cols, bins, margins: a row's entries outside the bin of zero, as bytes."""
    sc = rows.sparkSession.sparkContext
    held = sc.broadcast(bins)  # at most ``bins`` numbers for a column
    group = F.lit(-1) if fold is None else F.coalesce(F.col(fold), F.lit(-1))
    if validation is not None:
        group = F.when(F.coalesce(F.col(validation), F.lit(False)), F.lit(-2)).otherwise(group)
    own = rows.select(F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("y"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("w"),
                      group.cast("int").alias("fold"), F.col(features).alias("x"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            begin, cols, values = vector_rows(b.column("x"))
            at = held.value.of(cols, values)
            full = at != held.value.zero[cols]
            begin = np.concatenate([[0], np.cumsum(full)])[begin]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("w"), b.column("fold"), packed(cols[full].astype(np.int32), begin), packed(at[full], begin),
                                              packed(np.tile(np.array(margins), n), np.arange(n + 1) * len(margins))], names=["y", "w", "fold", "cols", "bins", "margins"])

    return own.mapInArrow(cut, ROW_SCHEMA)


ROW_SCHEMA = "y double, w double, fold int, cols binary, bins binary, margins binary"


class Rows:
    """A batch of binned rows."""

    def __init__(self, batch: pa.RecordBatch, models: int):
        self.y, self.w, self.fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w", "fold"))
        self.cols, begin = unpacked(batch.column("cols"), np.int32)
        self.bins, _ = unpacked(batch.column("bins"), np.uint8)
        self.margins = unpacked(batch.column("margins"), np.float64)[0].reshape(-1, models)
        self.row = np.repeat(np.arange(len(self.y)), np.diff(begin))

    def dense(self, used: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """Bins of the columns ``used`` (sorted) of all rows."""
        out = np.tile(zero[used], (len(self.y), 1))
        if len(used) and len(self.cols):
            place = np.full(len(zero), -1, np.int32)
            place[used] = np.arange(len(used))
            at = place[self.cols]
            hit = at >= 0
            out[self.row[hit], at[hit]] = self.bins[hit]
        return out

    def nodes(self, trees: list[Tree], zero: np.ndarray) -> list[np.ndarray]:
        """Node of every row in each tree; the entries are looked up once for all trees."""
        used = np.unique(np.concatenate([np.zeros(0, np.int32), *[t.col[t.left >= 0] for t in trees]])).astype(np.int64)
        x = self.dense(used, zero)
        return [t.route(x, np.searchsorted(used, t.col)) for t in trees]

    def with_trees(self, rounds: list[list[Tree | None]], zero: np.ndarray, more: Sequence[Tree] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
        """Margins with what the trees of ``rounds`` (one for each model, None for one that has ended) add, and the node of every row
        in each of ``more`` trees."""
        own = [(m, t) for trees in rounds for m, t in enumerate(trees) if t is not None]
        at = self.nodes([*[t for _, t in own], *more], zero)
        out = self.margins.copy()
        for (m, t), node in zip(own, at, strict=False):
            out[:, m] += t.value[node]
        return out, at[len(own):]

    def compressed(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct ``ids`` of the entries, sorted, and each entry's place among them."""
        if not len(ids):
            return ids, ids
        low = int(ids.min())
        seen = np.zeros(int(ids.max()) - low + 1, bool)
        seen[ids - low] = True
        return np.flatnonzero(seen) + low, (np.cumsum(seen) - 1)[ids - low]


# ---------------------------------------------------------------- trees

@dataclass
class Tree:
    """Nodes as arrays. A node with ``left`` below zero is a leaf; else rows whose bin of ``col`` is ``bin`` at most go left."""

    col: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def route(self, x: np.ndarray, place: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x)) if self.left[0] >= 0 else np.zeros(0, np.int64)
        while len(rows):
            node = at[rows]
            low = x[rows, place[node]] <= self.bin[node]
            at[rows] = np.where(low, self.left[node], self.right[node])
            rows = rows[self.left[at[rows]] >= 0]
        return at


@dataclass
class Split:
    gain: float
    col: int
    bin: int
    left: tuple[float, float, int]


@dataclass
class Node:
    sums: tuple[float, float, int] | None = None     # gradient, hessian, rows
    split: Split | None = None
    known: bool = False
    children: tuple[int, int] | None = None


@dataclass
class Growing:
    """A tree while it grows. Nodes may have been worked on that the finished tree doesn't use."""

    s: Boosting
    nodes: list[Node] = field(default_factory=lambda: [Node()])

    def chosen(self) -> tuple[list[int], list[int]]:
        """Splits in the order of their gain as far as it is known, and the nodes whose split must be known to go on."""
        need = [] if self.nodes[0].known else [0]
        order: list[int] = []
        heap = [(-self.nodes[0].split.gain, 0)] if self.nodes[0].split else []
        while heap and len(order) + 1 < self.s.leaves:
            _, i = heapq.heappop(heap)
            order.append(i)
            for c in self._children(i):
                if not self.nodes[c].known:
                    need.append(c)
                elif self.nodes[c].split:
                    heapq.heappush(heap, (-self.nodes[c].split.gain, c))
        return order, need

    def _children(self, i: int) -> tuple[int, int]:
        node = self.nodes[i]
        if node.children is None:
            g, h, n = node.sums
            left = node.split.left
            for sums in (left, (g - left[0], h - left[1], n - left[2])):
                # too few rows for two children: no need to look
                self.nodes.append(Node(sums, known=sums[2] < 2 * self.s.min_rows))
            node.children = (len(self.nodes) - 2, len(self.nodes) - 1)
        return node.children

    def tree(self, splits: list[int] | None = None) -> Tree:
        """The nodes so far, or, with the chosen ``splits`` alone, the finished tree with its leaves' values."""
        n = len(self.nodes)
        cut = [i for i, x in enumerate(self.nodes) if x.children] if splits is None else splits
        col, bin_, left, right, value = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1), np.zeros(n)
        for i in cut:
            x = self.nodes[i]
            col[i], bin_[i], (left[i], right[i]) = x.split.col, x.split.bin, x.children
        if splits is not None:
            for i, x in enumerate(self.nodes):
                if x.sums:
                    value[i] = -np.sign(x.sums[0]) * max(abs(x.sums[0]) - self.s.l1, 0) / (x.sums[1] + self.s.l2) * self.s.step
        return Tree(col, bin_, left, right, value)


def column_sample(width: int, share: float, seed: int, round_: int, model: int) -> np.ndarray:
    """Whether each column may be used, by a hash."""
    with np.errstate(over="ignore"):
        x = np.arange(width, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + round_) * 64 + model + 1) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(11)).astype(np.float64) / float(1 << 53) < share


def gradients(y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-margin))
    return w * (p - y), w * np.maximum(p * (1 - p), 1e-16)


def log_loss(y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> float:
    return float((w * (np.logaddexp(0, margin) - y * margin)).sum())


# ---------------------------------------------------------------- one pass

SUM_SCHEMA = "model int, node int, block int, part int, seq int, g0 double, h0 double, n0 long, ids binary, g binary, h binary, n binary"
SPLIT_SCHEMA = "model int, node int, block int, gain double, col int, bin int, gl double, hl double, nl long, g0 double, h0 double, n0 long"
LOSS = -2


def _summed(ids: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry for each id, sorted."""
    order = np.argsort(ids, kind="stable")
    ids, g, h, n = ids[order], g[order], h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    if not len(first):
        return ids, g, h, n
    return ids[first], np.add.reduceat(g, first), np.add.reduceat(h, first), np.add.reduceat(n, first)


def best_split(ids: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, total: tuple[float, float, int], bins: Bins, s: Boosting) -> Split | None:
    """The split of the highest gain, the first of equal ones, from sums by (column, bin); what the bins of a column leave of ``total`` is
    the bin of zero's."""
    if not len(ids):
        return None
    col = np.searchsorted(bins.begin, ids, "right") - 1
    cols, first = np.unique(col, return_index=True)
    rest = [t - np.add.reduceat(x, first) for t, x in zip(total, (g, h, n), strict=True)]
    ids = np.concatenate([ids, bins.begin[cols] + bins.zero[cols]])
    col = np.concatenate([col, cols])
    order = np.argsort(ids, kind="stable")
    ids, col = ids[order], col[order]
    left = []
    start = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]]))
    sizes = np.diff(np.append(start, len(col)))
    for x, r in zip((g, h, n), rest, strict=True):
        run = np.cumsum(np.concatenate([x, r])[order])
        left.append(run - np.repeat(np.concatenate([[0], run[start[1:] - 1]]), sizes))
    right = [t - x for t, x in zip(total, left, strict=True)]

    def score(gs, hs):
        return np.maximum(np.abs(gs) - s.l1, 0) ** 2 / (hs + s.l2)

    ok = (left[2] >= s.min_rows) & (right[2] >= s.min_rows) & (left[1] >= s.min_hessian) & (right[1] >= s.min_hessian)
    ok[np.append(start[1:] - 1, len(col) - 1)] = False
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, score(left[0], left[1]) + score(right[0], right[1]) - score(total[0], total[1]), -np.inf)
    k = int(np.argmax(gain))
    if not gain[k] > 1e-12:
        return None
    return Split(float(gain[k]), int(col[k]), int(ids[k] - bins.begin[col[k]]), (float(left[0][k]), float(left[1][k]), int(left[2][k])))


def _pass(table: DataFrame, models: int, held, rounds: list[list[Tree | None]], growing: dict[int, Tree], need: dict[int, list[int]], sums: dict, masks: dict[int, np.ndarray],
          s: Boosting, loss: bool) -> list:
    """Best split of each needed node and block of columns. ``sums`` holds what is known of the nodes; a root's sums come with its splits, and
    so does the validation rows' loss."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seq = TaskContext.get().partitionId(), 0
        bins: Bins = held.value
        got: dict[tuple[int, int], list[tuple]] = {}
        roots = {m: [0.0, 0.0, 0] for m in need if need[m] == [0]}
        losses = {m: [0.0, 0.0] for m in growing}
        size = 0

        def sent(last: bool) -> Iterator[pa.RecordBatch]:
            out: dict[str, list] = {x.split()[0]: [] for x in SUM_SCHEMA.split(", ")}

            def put(m: int, node: int, block: int, totals: tuple, *arrays: np.ndarray) -> None:
                for c, v in zip(out, (m, node, block, part, seq, *totals, *[x.tobytes() for x in arrays]), strict=True):
                    out[c].append(v)

            none = np.zeros(0)
            for (m, node), parts in got.items():
                ids, *x = _summed(*[np.concatenate(a) for a in zip(*parts, strict=True)])
                edge = np.searchsorted(ids, bins.begin[::BLOCK_COLUMNS])
                for block, (lo, hi) in enumerate(zip(edge, np.append(edge[1:], len(ids)), strict=True)):
                    if hi > lo:
                        put(m, node, block, (0.0, 0.0, 0), ids[lo:hi], *[a[lo:hi] for a in x])
            if last:
                for m, t in roots.items():  # each block of columns needs the whole sum
                    for block in range(-(-bins.width // BLOCK_COLUMNS)):
                        put(m, 0, block, tuple(t), none.astype(np.int64), none, none, none.astype(np.int64))
                for m, (total, w) in losses.items():
                    if loss:
                        put(m, LOSS, -1, (total, w, 0), none.astype(np.int64), none, none, none.astype(np.int64))
            if out["model"]:
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("model", pa.int32()), ("node", pa.int32()), ("block", pa.int32()), ("part", pa.int32()), ("seq", pa.int32()),
                                                                        ("g0", pa.float64()), ("h0", pa.float64()), ("n0", pa.int64()), *[(c, pa.binary()) for c in ("ids", "g", "h", "n")]]))

        for b in batches:
            if not b.num_rows:
                continue
            rows = Rows(b, models)
            margins, at = rows.with_trees(rounds, bins.zero, list(growing.values()))
            at = dict(zip(growing, at, strict=True))
            # what all models share is worked out once for a batch
            kept, small = rows.compressed(bins.begin[rows.cols] + rows.bins)
            column = np.searchsorted(bins.begin, kept, "right") - 1
            for m in growing:
                if loss:
                    v = rows.fold == -2
                    losses[m][0] += log_loss(rows.y[v], rows.w[v], margins[v, m])
                    losses[m][1] += float(rows.w[v].sum())
                if not need.get(m):
                    continue
                slot = np.full(len(growing[m].left), -1)
                slot[need[m]] = np.arange(len(need[m]))
                place = np.where((rows.fold == m) | (rows.fold == -2), -1, slot[at[m]])
                g, h = gradients(rows.y, rows.w, margins[:, m])
                if m in roots:
                    own = place == 0
                    roots[m] = [roots[m][0] + float(g[own].sum()), roots[m][1] + float(h[own].sum()), roots[m][2] + int(own.sum())]
                if not len(kept):
                    continue
                allowed = masks[m][column]
                # nodes some at a time, so that their cells stay within the bound
                step = max(1, CELLS // len(kept))
                for lo in range(0, len(need[m]), step):
                    here = (place >= lo) & (place < lo + step)
                    own = slice(None) if here.all() else np.flatnonzero(here[rows.row])
                    row = rows.row[own]
                    key = ((place - lo) * len(kept))[row] + small[own]
                    cells = min(step, len(need[m]) - lo) * len(kept)
                    n = np.bincount(key, minlength=cells)
                    gs, hs = (np.bincount(key, x[row], cells) for x in (g, h))
                    for j in range(cells // len(kept)):
                        a, z = j * len(kept), (j + 1) * len(kept)
                        full = np.flatnonzero((n[a:z] > 0) & allowed)
                        if len(full):
                            got.setdefault((m, need[m][lo + j]), []).append((kept[full], gs[a:z][full], hs[a:z][full], n[a:z][full]))
                            size += len(full)
            if size > HELD:
                yield from sent(False)
                got, size, seq = {}, 0, seq + 1
        yield from sent(True)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: Bins = held.value
        names = [x.split()[0] for x in SPLIT_SCHEMA.split(", ")]
        key, parts = None, []

        def done() -> dict:
            m, node, block = key
            totals = tuple(sum(p[i] for p in parts) for i in range(3))
            if node == LOSS:
                found, total = None, totals
            else:
                total = sums.get((m, node), totals)
                merged = _summed(*[np.concatenate(a) for a in zip(*[p[3:] for p in parts], strict=True)])
                found = best_split(*merged, total, bins, s)
            row = (m, node, block, *((found.gain, found.col, found.bin, *found.left) if found else (None, None, None, None, None, None)), *total)
            return dict(zip(names, row, strict=True))

        def held_rows(out: list[dict]) -> pa.RecordBatch:
            frame = pd.DataFrame(out, columns=names)
            kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
            return pa.RecordBatch.from_arrays([pa.array([None if pd.isna(v) else v for v in frame[c]], kinds[x.split()[1]]) for c, x in zip(names, SPLIT_SCHEMA.split(", "), strict=True)], names=names)

        for b in batches:
            out = []
            cells = [b.column(c).to_pylist() for c in ("model", "node", "block", "g0", "h0", "n0")]
            arrays = [b.column(c) for c in ("ids", "g", "h", "n")]
            for i, (m, node, block, g0, h0, n0) in enumerate(zip(*cells, strict=True)):
                if (m, node, block) != key:
                    if key is not None:
                        out.append(done())
                    key, parts = (m, node, block), []
                parts.append((g0, h0, n0, *[np.frombuffer(a[i].as_buffer(), k) for a, k in zip(arrays, (np.int64, np.float64, np.float64, np.int64), strict=True)]))
            if out:
                yield held_rows(out)
        if key is not None:
            yield held_rows([done()])

    # records of a key come in a fixed order, so that sums don't depend on which task ended first
    met = table.mapInArrow(add, SUM_SCHEMA).repartition("model", "node", "block").sortWithinPartitions("model", "node", "block", "part", "seq")
    return met.mapInArrow(split, SPLIT_SCHEMA).collect()  # a row for each node and block of columns


# ---------------------------------------------------------------- all rounds of a model in one task

CHUNK_SCHEMA = "model int, part int, seq int, rows int, base double, y binary, w binary, held binary, x binary"
TREES_SCHEMA = "model int, first int, sizes binary, col binary, bin binary, left binary, value binary, lowest int"


def _best_of(cells: np.ndarray, totals: np.ndarray, s: Boosting) -> list[tuple[float, int, tuple[float, float, float]] | None]:
    """As ``best_split``, for some nodes at once: ``cells`` are sums by (node, kind of sum, column, bin). Gives the gain, the place in (column, bin) and the left sums."""
    left = cells.cumsum(axis=-1)
    right = totals[:, :, None, None] - left
    least = max(1, s.min_rows)
    ok = (cells[:, 2] > 0) & (left[:, 2] >= least) & (right[:, 2] >= least) & (left[:, 1] >= s.min_hessian) & (right[:, 1] >= s.min_hessian)

    def score(gs, hs):
        return np.maximum(np.abs(gs) - s.l1, 0) ** 2 / (hs + s.l2)

    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(left[:, 0], left[:, 1])
        gain += score(right[:, 0], right[:, 1])
        gain -= score(totals[:, 0], totals[:, 1])[:, None, None]
    gain[~ok] = -np.inf
    gain = gain.reshape(len(cells), -1)
    out: list[tuple[float, int, tuple[float, float, float]] | None] = []
    for i, k in enumerate(gain.argmax(axis=1)):
        c, b = divmod(int(k), cells.shape[-1])
        out.append((float(gain[i, k]), int(k), tuple(left[i, :, c, b].tolist())) if gain[i, k] > 1e-12 else None)
    return out


def grow_whole(x: np.ndarray, y: np.ndarray, w: np.ndarray, held: np.ndarray, base: float, bins: Bins, model: int, s: Boosting) -> tuple[list[Tree], int | None]:
    """All trees of a model from the bins ``x`` of its rows, and how many of them the lowest loss has; rows ``held`` are for that loss alone.

    The same rules as in the passes; the sums of a split's larger side are those of the node less the smaller side's."""
    deep = int(np.diff(bins.begin).max())
    margin = np.full(len(y), base)
    learn, watch = np.flatnonzero(~held), np.flatnonzero(held)
    out: list[Tree] = []
    lowest: tuple[float, int] = (np.inf, 0)
    for r in range(s.rounds):
        if s.patience is not None and len(watch) and (weight := float(w[watch].sum())):
            now = log_loss(y[watch], w[watch], margin[watch]) / weight
            if now < lowest[0] - 1e-12:
                lowest = (now, r)
            elif r - lowest[1] >= s.patience:
                break
        used = np.flatnonzero(column_sample(bins.width, s.columns, s.seed, r, model))
        own, place = x[:, used], np.arange(len(used)) * deep
        g, h = gradients(y, w, margin)

        def sums(rows: np.ndarray) -> np.ndarray:
            got = np.zeros((3, len(used) * deep))
            for lo in range(0, len(rows), CHUNK_ROWS):  # noqa: B023 - called within its round
                at = rows[lo:lo + CHUNK_ROWS]
                ids = np.add(own[at], place, dtype=np.intp).ravel()
                for k, v in enumerate((g, h)):
                    got[k] += np.bincount(ids, np.repeat(v[at], len(used)), got.shape[1])
                got[2] += np.bincount(ids, minlength=got.shape[1])
            return got.reshape(3, len(used), deep)

        rows = [learn]
        totals = [(float(g[learn].sum()), float(h[learn].sum()), float(len(learn)))]
        cells: dict[int, np.ndarray] = {}
        splits: dict[int, tuple[float, int, tuple[float, float, float]]] = {}
        children: dict[int, int] = {}
        heap: list[tuple[float, int]] = []

        def look(nodes: list[int]) -> None:
            for i, found in zip(nodes, _best_of(np.stack([cells[i] for i in nodes]), np.array([totals[i] for i in nodes]), s), strict=True):
                if found:
                    splits[i] = found
                    heapq.heappush(heap, (-found[0], i))
                else:
                    del cells[i]

        if len(used) and len(learn) >= 2 * s.min_rows:
            cells[0] = sums(learn)
            look([0])
        while heap and len(children) + 1 < s.leaves:
            _, i = heapq.heappop(heap)
            _, k, low = splits[i]
            goes = own[rows[i], k // deep] <= k % deep
            sides = [rows[i][goes], rows[i][~goes]]
            children[i] = len(rows)
            rows += sides
            totals += [low, tuple(t - a for t, a in zip(totals[i], low, strict=True))]
            mine = cells.pop(i)
            # too few rows for two children, or no more leaves: no need to look
            need = [children[i] + j for j in (0, 1) if len(sides[j]) >= 2 * s.min_rows]
            if need and len(children) + 1 < s.leaves:
                small = int(len(sides[1]) < len(sides[0]))
                one = sums(sides[small])
                both = {children[i] + small: one, children[i] + 1 - small: np.subtract(mine, one, out=mine)}
                cells |= {j: both[j] for j in need}
                look(need)
        n = len(rows)
        col, bin_, left, value = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
        for i, first in children.items():
            col[i], bin_[i], left[i] = used[splits[i][1] // deep], splits[i][1] % deep, first
        for i, (gs, hs, _) in enumerate(totals):
            value[i] = -np.sign(gs) * max(abs(gs) - s.l1, 0) / (hs + s.l2) * s.step
            if left[i] < 0:
                margin[rows[i]] += value[i]
        out.append(Tree(col, bin_, left, np.where(left < 0, -1, left + 1), value))
        if len(watch) and s.patience is not None:
            margin[watch] += value[out[-1].route(x[watch], col)]
        if n == 1 and s.columns >= 1:  # a model that only has a root left can't change any more
            break
    return out, lowest[1] if lowest[0] < np.inf else None


def _grown_whole(table: DataFrame, models: int, held, s: Boosting) -> list[tuple[Trees, int | None]]:
    """For each model its trees, grown in one task, and how many of them the lowest loss has."""
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        bins: Bins = held.value
        part, seq = TaskContext.get().partitionId(), 0
        every = np.arange(bins.width)
        step = max(1, HELD // max(1, bins.width))
        names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                rows = Rows(whole.slice(lo, step), models)
                x = rows.dense(every, bins.zero)
                for m in range(models):
                    own = rows.fold != m
                    cells = [v[own].tobytes() for v in (rows.y, rows.w, rows.fold == -2, x)]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((m, part, seq, int(own.sum())), [pa.int32()] * 4, strict=True)] + [pa.array([float(rows.margins[0, m])])] + [pa.array([v], pa.binary()) for v in cells], names=names)
                seq += 1

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins: Bins = held.value
        records = ((b.column("model")[i].as_py(), b, i) for b in batches for i in range(b.num_rows))
        for m, own in groupby(records, key=lambda r: r[0]):
            parts: list[tuple] = [(np.zeros(0), np.zeros(0), np.zeros(0, bool), np.zeros((0, bins.width), np.uint8))]
            base = 0.0
            for _, b, i in own:
                base, n = b.column("base")[i].as_py(), b.column("rows")[i].as_py()
                if n:
                    y, w, away, x = (np.frombuffer(b.column(c)[i].as_buffer(), k) for c, k in (("y", np.float64), ("w", np.float64), ("held", bool), ("x", np.uint8)))
                    parts.append((y, w, away, x.reshape(n, bins.width)))
            y, w, away, x = (np.concatenate(v) for v in zip(*parts, strict=True))
            del parts
            trees, lowest = grow_whole(x, y, w, away, base, bins, m, s)
            for lo in range(0, len(trees), SENT_TREES):
                some = trees[lo:lo + SENT_TREES]
                flat = lambda c, k: np.concatenate([getattr(t, c) for t in some]).astype(k).tobytes()  # noqa: E731, B023
                yield pa.RecordBatch.from_pydict({"model": pa.array([m], pa.int32()), "first": pa.array([lo], pa.int32()), "sizes": [np.array([len(t.col) for t in some], np.int32).tobytes()], "col": [flat("col", np.int32)],
                                                  "bin": [flat("bin", np.uint8)], "left": [flat("left", np.int32)], "value": [flat("value", np.float64)], "lowest": pa.array([lowest], pa.int32())})

    # chunks come in a fixed order, so that sums don't depend on which task ended first
    met = table.mapInArrow(chunks, CHUNK_SCHEMA).repartitionById(models, F.col("model")).sortWithinPartitions("model", "part", "seq")
    path = _written(met.mapInArrow(grow, TREES_SCHEMA))
    made, bins, out = table.sparkSession.read.schema(TREES_SCHEMA).parquet(path), held.value, []
    for m in range(models):  # one at a time: as many nodes as the settings allow
        own = sorted(made.where(F.col("model") == m).collect(), key=lambda r: r["first"])
        sizes, col, bin_, left, value = (np.concatenate([np.zeros(0, k), *[np.frombuffer(r[c], k) for r in own]]) for c, k in (("sizes", np.int32), ("col", np.int32), ("bin", np.uint8), ("left", np.int32), ("value", np.float64)))
        threshold = bins.edges[np.minimum(bins.begin[col] + bin_, len(bins.edges) - 1)]
        out.append((Trees.of(sizes, col, threshold, left, value), own[0]["lowest"] if own else None))
    remove(table.sparkSession, path)
    return out


# ---------------------------------------------------------------- fitting

class Trees(Sequence):
    """Many trees as a list of tables, each made when it is asked for. Nodes are kept after each other, those of tree i from ``begin[i]`` on: the left
    child of a node is ``jump`` nodes on (0: a leaf), the right one comes after it; ``cut`` is an inner node's threshold or a leaf's value."""

    def __init__(self, begin: np.ndarray, col: np.ndarray, jump: np.ndarray, cut: np.ndarray):
        self.begin, self.col, self.jump, self.cut = begin, col, jump, cut

    @staticmethod
    def of(sizes: np.ndarray, col: np.ndarray, threshold: np.ndarray, left: np.ndarray, value: np.ndarray) -> Trees:
        """From the nodes of trees of ``sizes``, with the left child's number in its tree (below zero: a leaf)."""
        begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        inner = left >= 0
        jump = np.where(inner, left - (np.arange(len(left)) - np.repeat(begin[:-1], sizes)), 0)
        return Trees(begin, np.where(inner, col, -1).astype(np.int32), jump.astype(np.min_scalar_type(int(jump.max(initial=0)) + 1)), np.where(inner, threshold, value))

    @staticmethod
    def of_tables(tables: Sequence[pd.DataFrame]) -> Trees:
        """From tables whose nodes may stand in any order behind their parent's."""
        if isinstance(tables, Trees):
            return tables
        own = [_side_by_side(t) for t in tables]
        return Trees.of(np.array([len(t["left"]) for t in own], np.int64), *[np.concatenate([np.zeros(0), *[t[c] for t in own]]).astype(k) for c, k in (("col", np.int64), ("threshold", np.float64), ("left", np.int64), ("value", np.float64))])

    def __len__(self) -> int:
        return len(self.begin) - 1

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[k] for k in range(*i.indices(len(self)))]
        if not -len(self) <= i < len(self):
            raise IndexError(i)
        i %= len(self)
        own = slice(self.begin[i], self.begin[i + 1])
        jump, cut, node = self.jump[own].astype(np.int64), self.cut[own], np.arange(self.begin[i + 1] - self.begin[i])
        inner = jump > 0
        return pd.DataFrame({"node": node, "col": self.col[own].astype(np.int64), "threshold": np.where(inner, cut, 0.0), "left": np.where(inner, node + jump, -1),
                             "right": np.where(inner, node + jump + 1, -1), "value": np.where(inner, 0.0, cut)})

    def upto(self, n: int) -> Trees:
        end = self.begin[n]
        return Trees(self.begin[:n + 1], self.col[:end], self.jump[:end], self.cut[:end])


def _side_by_side(t: pd.DataFrame) -> dict[str, np.ndarray]:
    """A tree's nodes, numbered so that a right child comes after the left one, and both after their parent."""
    own = {c: t[c].to_numpy() for c in ("col", "threshold", "left", "right", "value")}
    inner = own["left"] >= 0
    if np.array_equal(own["right"][inner], own["left"][inner] + 1) and (own["left"][inner] > np.flatnonzero(inner)).all():
        return own
    order, at = [0], 0
    while at < len(order):
        if own["left"][order[at]] >= 0:
            order += [int(own["left"][order[at]]), int(own["right"][order[at]])]
        at += 1
    new = {i: k for k, i in enumerate(order)}
    return {c: v[order] for c, v in own.items()} | {"left": np.array([new[int(i)] if i >= 0 else -1 for i in own["left"][order]])}


@dataclass
class BoostedTrees:
    """A fitted model: ``base`` and the trees, whose nodes hold thresholds on values."""

    base: float
    trees: Sequence[pd.DataFrame]     # node, col, threshold, left, right, value

    def table(self) -> pd.DataFrame:
        parts = [t.assign(tree=i) for i, t in enumerate(self.trees)]
        names = ["tree", "node", "col", "threshold", "left", "right", "value"]
        return pd.concat(parts, ignore_index=True)[names] if parts else pd.DataFrame(columns=names)

    @staticmethod
    def of_table(base: float, rows: pd.DataFrame) -> BoostedTrees:
        rows = rows.sort_values(["tree", "node"])
        return BoostedTrees(base, [t.drop(columns="tree").reset_index(drop=True) for _, t in rows.groupby("tree", sort=True)])


def _finished(t: Tree, bins: Bins) -> pd.DataFrame:
    """Only the nodes that can be reached, numbered anew."""
    order, at = [0], 0
    while at < len(order):
        i = order[at]
        if t.left[i] >= 0:
            order += [int(t.left[i]), int(t.right[i])]
        at += 1
    new = {i: k for k, i in enumerate(order)}
    inner = t.left[order] >= 0
    return pd.DataFrame({"node": np.arange(len(order)), "col": np.where(inner, t.col[order], -1),
                         "threshold": np.where(inner, bins.edges[np.minimum(bins.begin[t.col[order]] + t.bin[order], len(bins.edges) - 1)], 0.0),
                         "left": [new[int(t.left[i])] if t.left[i] >= 0 else -1 for i in order], "right": [new[int(t.right[i])] if t.left[i] >= 0 else -1 for i in order],
                         "value": t.value[order]})


def fit_boosted(rows: DataFrame, features: str = "features", label: str = "label", weight: str | None = None, fold: str | None = None, models: int = 1,
                settings: Boosting = Boosting(), validation: str | None = None) -> list[BoostedTrees]:
    """``models`` models; model m learns from the rows whose ``fold`` isn't m. Rows where ``validation`` holds are for the loss
    that ends a model early, and nothing is learned from them. Every pass serves all models."""
    s, spark = settings, rows.sparkSession
    bins = fit_bins(rows, features, s.bins)
    held = spark.sparkContext.broadcast(bins)
    w = F.lit(1.0) if weight is None else F.col(weight)
    learn = rows if validation is None else rows.where(~F.coalesce(F.col(validation), F.lit(False)))
    own = learn.select((F.lit(-1) if fold is None else F.col(fold)).alias("f"), F.coalesce(F.col(label).cast("double"), F.lit(0.0)).alias("y"), w.alias("w"))
    mass = own.groupBy("f").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("p")).collect()  # a row for each fold

    def base(m: int) -> float:
        total, pos = (sum(r[c] for r in mass if r["f"] != m) for c in ("w", "p"))
        share = min(max(pos / total, 1e-12), 1 - 1e-12) if total else 0.5
        return float(np.log(share / (1 - share)))

    bases = [base(m) for m in range(models)]
    path = _written(binned(rows, features, label, weight, fold, validation, bins, bases))
    table = spark.read.schema(ROW_SCHEMA).parquet(path)
    if s.rounds > WHOLE_ROUNDS and s.leaves * bins.width * int(np.diff(bins.begin).max()) <= WHOLE_SUMS and table.count() * bins.width <= WHOLE_CELLS:
        whole = _grown_whole(table, models, held, s)
        remove(spark, path)
        return [BoostedTrees(bases[m], trees if lowest is None else trees.upto(lowest)) for m, (trees, lowest) in enumerate(whole)]
    out: list[list[pd.DataFrame]] = [[] for _ in range(models)]
    active, lowest = set(range(models)), {m: (np.inf, 0) for m in range(models)}
    rounds: list[list[Tree | None]] = []
    for r in range(s.rounds):
        if not active:
            break
        masks = {m: column_sample(bins.width, s.columns, s.seed, r, m) for m in active}
        grow = {m: Growing(s) for m in sorted(active)}
        watch = validation is not None and s.patience is not None
        first = True
        while need := {m: n for m, g in grow.items() if (n := g.chosen()[1])}:
            sums = {(m, i): grow[m].nodes[i].sums for m, ids in need.items() for i in ids if grow[m].nodes[i].sums}
            found = _pass(table, models, held, rounds, {m: g.tree() for m, g in grow.items()}, need, sums, masks, s, watch and first)
            for m, ids in need.items():
                for i in ids:
                    grow[m].nodes[i].known = True
            for x in found:
                if x["node"] == LOSS:
                    if not x["h0"]:
                        continue
                    now = x["g0"] / x["h0"]
                    if now < lowest[x["model"]][0] - 1e-12:
                        lowest[x["model"]] = (now, len(out[x["model"]]))
                    elif len(out[x["model"]]) - lowest[x["model"]][1] >= s.patience:
                        active.discard(x["model"])
                    continue
                node = grow[x["model"]].nodes[x["node"]]
                node.sums = node.sums or (x["g0"], x["h0"], x["n0"])
                if x["gain"] is not None and (node.split is None or (x["gain"], -x["col"]) > (node.split.gain, -node.split.col)):
                    node.split = Split(x["gain"], x["col"], x["bin"], (x["gl"], x["hl"], x["nl"]))
            first = False
            grow = {m: g for m, g in grow.items() if m in active}
        made: list[Tree | None] = [None] * models
        for m, g in grow.items():
            made[m] = g.tree(g.chosen()[0])
            out[m].append(_finished(made[m], bins))
        # a model that only has a root left can't change any more
        active -= {m for m, t in enumerate(made) if t is not None and t.left[0] < 0 and s.columns >= 1}
        rounds.append(made)
        if len(rounds) == REFRESH and r + 1 < s.rounds:
            path, old = _written(_with_margins(table, models, held, rounds)), path
            table, rounds = spark.read.schema(ROW_SCHEMA).parquet(path), []
            remove(spark, old)
    remove(spark, path)
    # trees after the lowest loss go
    return [BoostedTrees(bases[m], out[m][:lowest[m][1]] if lowest[m][0] < np.inf else out[m]) for m in range(models)]


def _written(df: DataFrame) -> str:
    path = scratch_path(df.sparkSession, "boosting")
    df.write.parquet(path)
    return path


def _with_margins(table: DataFrame, models: int, held, rounds: list[list[Tree | None]]) -> DataFrame:
    def renewed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                margins, _ = Rows(b, models).with_trees(rounds, held.value.zero)
                yield b.set_column(b.schema.get_field_index("margins"), "margins", packed(margins.ravel(), np.arange(b.num_rows + 1) * models))

    return table.mapInArrow(renewed, ROW_SCHEMA)


# ---------------------------------------------------------------- scoring

class _Scorer:
    """All trees of some models, ready for rows of vectors."""

    def __init__(self, models: list[BoostedTrees]):
        trees = [Trees.of_tables(m.trees) for m in models]
        self.used = np.unique(np.concatenate([np.zeros(0, np.int32), *[np.unique(t.col[t.jump > 0]) for t in trees]])).astype(np.int64)
        place = lambda col: np.searchsorted(self.used, np.maximum(col, 0)).astype(np.min_scalar_type(len(self.used)))
        self.models = [(m.base, t.begin, place(t.col), t.jump, t.cut) for m, t in zip(models, trees, strict=True)]

    def __call__(self, begin: np.ndarray, cols: np.ndarray, values: np.ndarray, only: np.ndarray | None = None) -> np.ndarray:
        """Probability by row and model; as many rows at a time as their used columns take a few million cells. With ``only``, the number of a model for
        each row, the other models are left out (NaN)."""
        n = len(begin) - 1
        out = np.full((n, len(self.models)), np.nan)
        step = max(1, (1 << 22) // max(1, len(self.used)))
        for lo in range(0, n, step):
            hi = min(lo + step, n)
            a, z = begin[lo], begin[hi]
            x = np.zeros((hi - lo, max(1, len(self.used))))
            if len(self.used) and z > a:
                at = np.minimum(np.searchsorted(self.used, cols[a:z]), len(self.used) - 1)
                hit = self.used[at] == cols[a:z]
                row = np.repeat(np.arange(hi - lo), np.diff(begin[lo:hi + 1]))
                x[row[hit], at[hit]] = np.nan_to_num(values[a:z][hit], nan=0.0, posinf=np.inf, neginf=-np.inf)
            for m in range(len(self.models)):
                own = np.arange(hi - lo) if only is None else np.flatnonzero(only[lo:hi] == m)
                if len(own):
                    out[lo + own, m] = 1 / (1 + np.exp(-self._margin(m, x if only is None else x[own])))
        return out

    def _margin(self, m: int, x: np.ndarray) -> np.ndarray:
        """Some trees at a time for some rows at a time; their values are added tree by tree."""
        base, begin, col, jump, cut = self.models[m]
        width, margin = x.shape[1], np.full(len(x), base)
        for lo in range(0, len(x), SCORED):
            cells = x[lo:lo + SCORED].ravel()
            n = len(cells) // width
            start, step = np.arange(n) * width, max(1, SCORED // n)
            for t in range(0, len(begin) - 1, step):
                roots = begin[t:min(t + step, len(begin) - 1)]
                at = np.repeat(roots, n)
                rows = np.flatnonzero(jump[at])
                while len(rows):
                    node = at[rows]
                    node += jump[node] + (cells[start[rows % n] + col[node]] > cut[node])
                    at[rows] = node
                    rows = rows[jump[node] > 0]
                for v in cut[at].reshape(-1, n):
                    margin[lo:lo + n] += v
        return margin


def score_boosted(df: DataFrame, models: list[BoostedTrees], features: str = "features", out: str = "probabilities") -> DataFrame:
    """``df`` with an array of each model's probability."""
    held = df.sparkSession.sparkContext.broadcast(_Scorer(models))  # as many nodes as the settings allow

    @arrow_udf(ArrayType(DoubleType()))
    def scored(vectors: pa.Array) -> pa.Array:
        made = held.value(*vector_rows(vectors))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1]), pa.array(made.ravel()))

    return df.withColumn(out, scored(F.col(features)))


def score_own(df: DataFrame, models: list[BoostedTrees], features: str, fold: str, out: str) -> DataFrame:
    """``df`` with the probability that the model numbered in ``fold`` gives; null where there is none."""
    held = df.sparkSession.sparkContext.broadcast(_Scorer(models))  # as many nodes as the settings allow

    @arrow_udf(DoubleType())
    def scored(vectors: pa.Array, own: pa.Array) -> pa.Array:
        m = own.fill_null(-1).to_numpy(zero_copy_only=False)
        made = held.value(*vector_rows(vectors), only=m)
        known = (m >= 0) & (m < made.shape[1])
        return pa.array(made[np.arange(len(m)), np.where(known, m, 0)], mask=~known)

    return df.withColumn(out, scored(F.col(features), F.col(fold)))
