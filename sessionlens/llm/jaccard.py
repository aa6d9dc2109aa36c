"""N-gram Jaccard join by MinHash banding, the fixed form of an LSH forest.

A document is the set of its five-word shingles. Documents with equal sets are one class from the
start. Each of the ``TREES`` bands holds a few MinHash values of a class, and classes with equal values in
a band are candidates. How many values is fixed before the run: the most, up to ``DEPTH``, with
which the bands together find a pair of the wanted similarity with the target recall
(1 - (1 - s^d)^trees), 4 at 0.8. There are no sorted tries, and no matched prefix is shortened while the
join runs: the similarity is one bound for all pairs, so a descent from longer prefixes
would end at the same candidates. Every candidate pair is then verified exactly on its shingle sets, once,
in the first tree that brings it together.

A node (the classes with equal values in a band) goes to a task as signatures first; only members with a pair left to verify have
their shingles sent. A node with more members than ``BLOCK`` is cut into blocks, and each pair of
blocks is a task's work, so no task holds an unbounded node. A task gives back a row for each
member: its number of links, and the smallest member of its component there. So what is written
grows with the members of nodes, not with their pairs; no pair is dropped.

Defined cases: a text of one to four words is one shingle of them all, and joins its copies only; a
text without words, null too, joins none; a null doc_id isn't matched and has a null class; repeated
rows share a class; ties don't arise, as a class is named by its smallest doc_id; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, clashless, gathered, small_batches, small_side, stored, table, text_size, trimmed
from .components import components
from .shingles import mix, shingle_sets

SIMILARITY = 0.8
TREES = 20
#: MinHash values in a label.
DEPTH = 6
TARGET_RECALL = 0.9999
#: Members of a node that are compared with each other in one task; larger nodes are cut.
BLOCK = 512
#: Rows of units that are worked on at once.
UNIT_ROWS = 4000
#: Members of a task's unit up to which pairs are taken by distance, with other units at once.
SMALL_UNIT = 32
#: Share of equal MinHash values under which a pair isn't verified: over 6 standard
#: deviations under what a pair of the wanted similarity shows.
LEAST_EQUAL = 0.52
BATCH_CHARS = 500_000
#: Bytes of shingles that are gathered before whole units of them are verified.
UNIT_BYTES = 1 << 25
BROADCAST_ROWS = 500_000


def prefix_length(similarity: float = SIMILARITY, trees: int = TREES, depth: int = DEPTH, target: float = TARGET_RECALL) -> int:
    """The longest prefix, of ``depth`` at most, that reaches the target recall."""
    for d in range(depth, 0, -1):
        if 1 - (1 - similarity ** d) ** trees >= target:
            return d
    raise ValueError(f"{trees} trees can't reach a recall of {target}")


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, 2 * n + 1, dtype=np.uint64)
    v = mix(k * np.uint64(0x9E3779B97F4A7C15))
    return v[:n] | np.uint64(1), v[n:]


def signatures_of(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n 32-bit MinHash values for each set, zeros for an empty one."""
    out = np.zeros((len(sets), n), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        begin = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for k, (a, b) in enumerate(zip(*_functions(n), strict=True)):
            out[full, k] = np.minimum.reduceat(((flat * a + b) >> np.uint64(32)).astype(np.uint32), begin)
    return out


def signatures(docs: DataFrame, trees: int = TREES, width: int = 4) -> DataFrame:
    """doc_id, size, k1, k2 (what names a shingle set), sig (binary); rows without words or id are
    left out."""
    def signed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames, text_size, "text", BATCH_CHARS):
            sets = shingle_sets(list(f.text))
            sig = signatures_of(sets, trees * width)
            out = pd.DataFrame({"doc_id": f.doc_id.to_numpy(), "size": [len(s) for s in sets],
                                "k1": np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64),
                                "k2": np.array([mix(s ^ np.uint64(0x5bd1e995)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64),
                                "sig": [x.tobytes() for x in sig]})
            yield out[out["size"] > 0]

    return docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(
        lambda frames: trimmed(signed(frames)), "doc_id long, size long, k1 long, k2 long, sig binary")


def _units(members: DataFrame) -> DataFrame:
    """A row for each member and task: node, i, j (its blocks), b (the member's block)."""
    cut = F.ceil(F.col("members") / BLOCK).cast("int")
    own = members.withColumn("b", F.pmod(F.xxhash64("rep"), cut).cast("int"))
    return own.withColumn("o", F.explode(F.sequence(F.lit(0), cut - 1))).withColumns(
        {"i": F.least("b", "o"), "j": F.greatest("b", "o")}).drop("o", "members")


def _groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of whole units, from frames that are sorted by unit. The last unit of a frame waits
    for the next frame."""
    rest = None
    for f in gathered(frames, UNIT_ROWS, lambda f: sum(map(len, f["shingles"])) if "shingles" in f else 0, UNIT_BYTES):
        f = f if rest is None else pd.concat([rest, f], ignore_index=True)
        last = (f[["node", "i", "j"]] == f[["node", "i", "j"]].iloc[-1]).all(axis=1).to_numpy()
        cut = int(np.flatnonzero(~last).max()) + 1 if not last.all() else 0
        if cut:
            yield f.iloc[:cut].reset_index(drop=True)
        rest = f.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _pairs(f: pd.DataFrame, trees: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows x, y of the pairs to verify, and each row's unit number: pairs of a unit whose first
    common tree is the unit's, and whose signatures agree enough."""
    unit = (f[["node", "i", "j"]].diff().ne(0).any(axis=1)).cumsum().to_numpy()
    sig = np.frombuffer(b"".join(f.sig), np.uint32).reshape(len(f), trees, width)
    prefix = np.zeros(sig.shape[:2], np.uint64)  # one number for a prefix
    for k in range(width):
        prefix = mix(prefix ^ sig[:, :, k])
    b, cross, tree = f.b.to_numpy(), (f.i != f.j).to_numpy(), f.tree.to_numpy()
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def close(x: np.ndarray, y: np.ndarray) -> None:
        for p, q in zip(np.array_split(x, 1 + len(x) // 20_000), np.array_split(y, 1 + len(x) // 20_000), strict=True):
            ok = (sig[p] == sig[q]).sum(axis=(1, 2)) >= LEAST_EQUAL * trees * width
            left.append(p[ok])
            right.append(q[ok])

    size = np.bincount(unit)[unit]
    at, k = np.flatnonzero(size <= SMALL_UNIT), 1  # small units all at once, by the distance of rows
    while len(at):
        at = at[at + k < len(f)]
        at = at[unit[at] == unit[at + k]]
        x = at[~cross[at] | (b[at] != b[at + k])]
        same = prefix[x] == prefix[x + k]
        x = x[same.any(axis=1) & (same.argmax(axis=1) == tree[x])]
        close(x, x + k)
        k += 1
    for u in np.unique(unit[size > SMALL_UNIT]):  # large ones by matrices of their rows
        rows = np.flatnonzero(unit == u)
        own = prefix[rows]
        new = np.triu(np.ones((len(rows), len(rows)), bool), 1)
        if cross[rows[0]]:
            new &= b[rows][:, None] != b[rows]
        for t in range(tree[rows[0]]):
            new &= own[:, t][:, None] != own[:, t]
        x, y = np.nonzero(new)
        close(rows[x], rows[y])
    return np.concatenate(left), np.concatenate(right), unit


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of the intersections of all sets."""
    flat = np.concatenate(sets)
    _, inv, n = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = n[inv] > 1  # what one set has alone is in no intersection
    _, inv = np.unique(inv[keep], return_inverse=True)
    owner, total = owner[keep], np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(inv, kind="stable")
    inv, owner = inv[order], owner[order]
    wide = max(1, 4_000_000 // len(sets))
    for lo in range(0, int(inv[-1]) + 1 if len(inv) else 0, wide):
        a, z = np.searchsorted(inv, [lo, lo + wide])
        m = np.zeros((len(sets), wide), np.float32)
        m[owner[a:z], inv[a:z] - lo] = 1
        total += m @ m.T
    return total


def _labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    return label


def links(sigs: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, trees: int = TREES, width: int = 4) -> DataFrame:
    """u, v, n: for each class with links in a task, the smallest class of its component there
    and its number of links there. ``sigs`` is a stored table of one row per class (rep, sig)."""
    label = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
        t.alias("tree"), F.xxhash64(t, F.substring(F.col("sig"), t * (4 * width) + 1, F.lit(4 * width))).alias("node")))
    leaves = sigs.select("rep", F.inline(label))
    nodes = stored(leaves.groupBy("node").agg(F.count("*").alias("members")).filter("members > 1"), "join-nodes")
    members = leaves.join(small_side(nodes, BROADCAST_ROWS), "node")
    unit = ["node", "i", "j"]

    def open_members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _groups(frames):
            x, y, _ = _pairs(f, trees, width)
            yield f.iloc[np.unique(np.concatenate([x, y]))][["node", "i", "j", "tree", "b", "rep"]]

    dealt = _units(members).join(sigs.select("rep", "sig"), "rep").repartition(*unit).sortWithinPartitions(*unit, "rep")
    dealt = dealt.select(*unit, "tree", "b", "rep", "sig")
    work = stored(dealt.mapInPandas(open_members, "node long, i int, j int, tree int, b int, rep long"), "join-work")
    wanted = stored(work.select("rep").distinct(), "join-wanted")

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames, text_size, "text", BATCH_CHARS):
            yield pd.DataFrame({"rep": f.rep.to_numpy(), "shingles": [s.tobytes() for s in shingle_sets(list(f.text))]})

    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(small_side(wanted, BROADCAST_ROWS), "rep", "left_semi")
    found = texts.mapInPandas(sets, "rep long, shingles binary").join(sigs.select("rep", "sig", "k1", "size"), "rep")
    # an id that is repeated with another text: only the text that the class is of counts
    found = found.withColumn("ok", F.octet_length("shingles") == 8 * F.col("size")).filter("ok").dropDuplicates(["rep"]).drop("ok", "k1", "size")

    def verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _groups(frames):
            x, y, unit_of = _pairs(f, trees, width)
            sets_of = [np.frombuffer(s, np.uint64) for s in f.shingles]
            size = np.array([len(s) for s in sets_of])
            ok = np.zeros(len(x), bool)
            order = np.argsort(unit_of[x], kind="stable")
            x, y = x[order], y[order]
            bounds = np.flatnonzero(np.diff(unit_of[x], prepend=-1))
            for a, z in zip(bounds, [*bounds[1:], len(x)], strict=True):
                rows, at = np.unique(np.concatenate([x[a:z], y[a:z]]), return_inverse=True)
                if z - a <= 2 * len(rows):  # few pairs
                    both = np.array([len(np.intersect1d(sets_of[p], sets_of[q], assume_unique=True)) for p, q in zip(x[a:z], y[a:z], strict=True)])
                else:
                    both = _shared([sets_of[r] for r in rows])[at[:z - a], at[z - a:]]
                ok[a:z] = both >= similarity * (size[x[a:z]] + size[y[a:z]] - both) - 1e-9
            x, y = x[ok], y[ok]
            rep = f.rep.to_numpy()
            # units follow each other and rows are sorted by rep within a unit
            label, n = _labels(len(f), x, y), np.bincount(np.concatenate([x, y]), minlength=len(f))
            linked = n > 0
            yield pd.DataFrame({"u": rep[linked], "v": rep[label[linked]], "n": n[linked]})

    full = work.join(found, "rep").repartition(*unit).sortWithinPartitions(*unit, "rep").select(*unit, "tree", "b", "rep", "sig", "shingles")
    return full.mapInPandas(lambda frames: trimmed(verified(frames)), "u long, v long, n long")


def near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, n_links of each row of ``docs`` (doc_id, text): the smallest doc_id that a
    chain of links leads to, and how many different texts are similar to this one."""
    small_batches(docs.sparkSession)
    own = clashless(docs, ["doc_id", "text"])
    width = prefix_length(similarity)
    sigs = stored(signatures(own, TREES, width), "join-signatures")
    key = ["k1", "k2", "size"]
    reps = stored(sigs.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig")), "join-classes")
    found = stored(links(reps, own, similarity, TREES, width), "join-links")
    roots = components(found.select("u", "v"), "join-components")
    counts = found.groupBy("u").agg(F.sum("n").alias("n_links"))
    of_class = reps.select(*key, "rep").join(roots.withColumnRenamed("u", "rep"), "rep", "left").join(
        counts.withColumnRenamed("u", "rep"), "rep", "left").select(*key, F.coalesce("root", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    known = sigs.select("doc_id", *key).join(of_class, key).select("doc_id", "class_id", "n_links")
    # the rest has no words or no id
    has_word: Column = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)) & F.col("doc_id").isNotNull()
    rest = own.filter(~has_word).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(rest)


def drop_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that have one with a smaller id in their class, and with
    repeated rows of the same id and text once. Rows without an id stay."""
    found = stored(near_copies(docs, similarity), "join-classes-of-documents")
    gone = stored(found.filter("doc_id <> class_id").select("doc_id").distinct(), "join-gone")
    left = docs.join(small_side(gone, BROADCAST_ROWS), "doc_id", "left_anti")
    again = stored(found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "join-repeated")
    side = small_side(again, BROADCAST_ROWS)
    once = left.join(side, "doc_id", "left_anti")
    return once.unionByName(left.join(side, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])).select(*docs.columns)


def op5_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-copy class and number of links of every document."""
    return near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
