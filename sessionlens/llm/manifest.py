"""Merkle manifest of a dataset, stored in van Emde Boas order.

Each group (a language, say) has a tree of arity 8 over its rows' leaf digests; the roots of the groups
are the leaves of one more tree, whose root names the dataset.

A tree of L levels is cut at half its height, into a top tree and the aligned subtrees below it, which
are cut again until a subtree has ``UNIT_LEVELS`` levels at most: a block. Nodes are stored by address,
top tree first and then its subtrees one after the other, so a block is one run of addresses and one row of
the manifest, and a path from a leaf to the root meets one block for each cut. ``address`` and
``offsets`` are the arithmetic; construction and the retrieval of siblings use nothing else.

Construction goes up: the leaves of a block meet in a task, which writes the block; the roots
of the blocks are the input of the next cut. Retrieval goes down: the path above a block is handed to the
blocks below it, a few KB for each, and leaves meet their block in the last step. No task holds more
than a block and a frame of rows, whatever the size of a group.

Defined cases: a null field hashes as ``-``; a null group is a group, the first; leaves go by
key, nulls first, then by digest, so rows that are repeated are leaves of their own next to each other; a row with a null
key isn't tampered with; a group of one row has its leaf as root; empty and very long texts
are values like others; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.operators.ordered import row_index

from .common import clashless, small_side, stored, table

ARITY_BITS = 3
ARITY = 1 << ARITY_BITS
#: Most levels of a block: 4,096 leaves, or 32,768 roots of blocks below.
UNIT_LEVELS = 5
#: Levels that 64-bit row numbers can need.
MOST_LEVELS = 22
DIGEST = 32
#: Most groups whose table is broadcast.
BROADCAST_ROWS = 500_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# ---------------------------------------------------------------- layout

def nodes_in(levels: int) -> int:
    """Nodes of a complete tree."""
    return (ARITY ** levels - 1) // (ARITY - 1)


def halves(levels: int) -> tuple[int, int]:
    """Levels of the top tree and of the subtrees below it."""
    return levels // 2, levels - levels // 2


def address(levels: int, depth: int, index: int) -> int:
    """Place of a node in the layout of a tree: ``index``-th of its depth, from the root."""
    at = 0
    while levels > 1:
        top, bottom = halves(levels)
        if depth < top:
            levels = top
        else:
            depth -= top
            at += nodes_in(top) + (index >> (ARITY_BITS * depth)) * nodes_in(bottom)
            index &= (1 << (ARITY_BITS * depth)) - 1
            levels = bottom
    return at


def strata(levels: int, unit: int = UNIT_LEVELS) -> list[int]:
    """Levels of the blocks that a tree is cut into, from the leaves up."""
    if levels <= unit:
        return [levels]
    top, bottom = halves(levels)
    return strata(bottom, unit) + strata(top, unit)


@lru_cache(None)
def offsets(levels: int) -> list[np.ndarray]:
    """For each depth of a block the addresses of its nodes, less the root's."""
    return [np.array([address(levels, d, i) for i in range(ARITY ** d)]) for d in range(levels)]


# ---------------------------------------------------------------- one block

def _above(digests: list[bytes]) -> list[bytes]:
    return [hashlib.sha256(b"".join(digests[i:i + ARITY]).hex().encode()).digest() for i in range(0, len(digests), ARITY)]


def built(inputs: list[bytes], levels: int, leaves: bool) -> bytes:
    """The digests of a block in address order. ``inputs`` are its lowest level (``leaves``), or the
    roots of the blocks below it. Absent nodes before the last present one are zeros."""
    now, out = inputs if leaves else _above(inputs), {}
    for d in range(levels - 1, -1, -1):
        out.update(zip(offsets(levels)[d].tolist(), now, strict=False))
        now = _above(now) if d else now
    block = bytearray(DIGEST * (max(out) + 1))
    for at, digest in out.items():
        block[at * DIGEST:(at + 1) * DIGEST] = digest
    return bytes(block)


class Block:
    """Sibling retrieval in a block: ``path(i)`` is the path of its i-th input to the block's root and
    on to the tree's. A path is, for each level, two bytes (nodes of the run, place in it) and the digests of the
    others."""

    def __init__(self, block: bytes, below: bytes, count: int, levels: int, leaves: bool, above: bytes):
        self.block, self.below, self.count, self.levels, self.leaves, self.above = block, below, count, levels, leaves, above
        self.held: tuple[int, bytes] = (-1, b"")

    def _others(self, depth: int, i: int, count: int) -> bytes:
        first, last = i - i % ARITY, min(i - i % ARITY + ARITY, count)
        if depth == self.levels:
            run = [self.below[j * DIGEST:(j + 1) * DIGEST] for j in range(first, last) if j != i]
        else:
            at = offsets(self.levels)[depth]
            run = [self.block[at[j] * DIGEST:(at[j] + 1) * DIGEST] for j in range(first, last) if j != i]
        return bytes((last - first, i - first)) + b"".join(run)

    def path(self, i: int) -> bytes:
        depth, count = self.levels - 1 if self.leaves else self.levels, self.count
        own = self._others(depth, i, count) if depth else b""
        if self.held[0] != i // ARITY:  # what is above a run is the same for all of it
            j, out = i, []
            while depth > 1:
                j, count, depth = j // ARITY, -(-count // ARITY), depth - 1
                out.append(self._others(depth, j, count))
            self.held = (i // ARITY, b"".join(out) + self.above)
        return own + self.held[1]


def folded(leaf: bytes, path: bytes) -> tuple[str, str]:
    """(hash of the siblings, root that ``leaf`` leads to), both hexadecimal."""
    at, others = 0, []
    while at < len(path):
        n, place = path[at], path[at + 1]
        run = path[at + 2:at + 2 + (n - 1) * DIGEST]
        others.append(run)
        leaf = hashlib.sha256((run[:place * DIGEST] + leaf + run[place * DIGEST:]).hex().encode()).digest()
        at += 2 + len(run)
    return hashlib.sha256(b"".join(others).hex().encode()).hexdigest(), leaf.hex()


# ---------------------------------------------------------------- trees

def _groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one (g, blk) after the other; they follow each other, over the borders of frames too."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        g, b = frame["g"].to_numpy(), frame["blk"].to_numpy()
        cut = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (b[1:] != b[:-1])) + 1).tolist(), len(frame)]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if held and (held[0]["g"].iat[0], held[0]["blk"].iat[0]) != (g[lo], b[lo]):
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(frame.iloc[lo:hi])
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def _levels(n: Column) -> Column:
    """Levels of a tree of n leaves."""
    out = F.lit(1)
    for j in range(MOST_LEVELS - 1):
        out = out + F.when(n > F.lit(min(ARITY ** j, (1 << 63) - 1)), 1).otherwise(0)
    return out


def _stratum(levels: str, s: int) -> Column:
    """Levels of the blocks of cut s of a tree, null where it has fewer cuts."""
    out = F.lit(None).cast("int")
    for n in range(1, MOST_LEVELS + 1):
        cut = strata(n)
        if s < len(cut):
            out = F.when(F.col(levels) == n, F.lit(cut[s])).otherwise(out)
    return out


def _blocks(nodes: DataFrame, s: int) -> DataFrame:
    """g, tree_levels, blk, levels, address, digests, below, k of the blocks of cut s, from g, tree_levels, idx, digest."""
    leaves = s == 0
    cut = nodes.withColumn("levels", _stratum("tree_levels", s)).filter("levels IS NOT NULL")
    cut = cut.withColumn("blk", F.expr(f"shiftright(idx, {ARITY_BITS} * (levels - {int(leaves)}))"))

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for rows in _groups(frames):
            g, blk, levels, tree = (int(rows[c].iat[0]) for c in ("g", "blk", "levels", "tree_levels"))
            inputs = [bytes(x) for x in rows["digest"]]
            depth = tree - sum(strata(tree)[:s + 1])
            out.append((g, tree, blk, levels, address(tree, depth, blk), built(inputs, levels, leaves), b"" if leaves else b"".join(inputs), len(inputs)))
            if len(out) == 64:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    schema = "g long, tree_levels int, blk long, levels int, address long, digests binary, below binary, k int"
    names = [x.split()[0] for x in schema.split(", ")]
    rows = cut.select("g", "tree_levels", "blk", "levels", "idx", "digest").repartition("g", "blk").sortWithinPartitions("g", "blk", "idx")
    return rows.mapInPandas(build, schema)


def grow(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Stored blocks of every cut, leaves first, of all trees in ``nodes`` (g, tree_levels, idx, digest);
    ``most`` is the largest number of leaves of a tree."""
    levels = next(n for n in range(1, MOST_LEVELS + 1) if ARITY ** (n - 1) >= most)
    out: list[DataFrame] = []
    for s in range(max(len(strata(n)) for n in range(1, levels + 1))):
        out.append(stored(_blocks(nodes, s), f"manifest-{s}"))
        nodes = out[-1].select("g", "tree_levels", F.col("blk").alias("idx"), F.substring("digests", 1, DIGEST).alias("digest"))
    return out


def roots(cuts: list[DataFrame]) -> DataFrame:
    """g, digest: the root of every tree."""
    tops = [b.filter("address = 0").select("g", F.substring("digests", 1, DIGEST).alias("digest")) for b in cuts]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _paths(cut: DataFrame, above: DataFrame, leaves: bool) -> DataFrame:
    """g, blk, above: the path of every input of the blocks ``cut``, whose own path is in ``above`` (g, blk, above)."""
    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                block = Block(r.digests, r.below, r.k, r.levels, leaves, r.above)
                first = r.blk << (ARITY_BITS * (r.levels - leaves))
                for lo in range(0, r.k, 4096):  # a frame for some inputs at a time
                    part = range(lo, min(lo + 4096, r.k))
                    yield pd.DataFrame({"g": r.g, "blk": [first + i for i in part], "above": [block.path(i) for i in part]})

    return cut.join(above, ["g", "blk"]).select("g", "blk", "levels", "digests", "below", "k", "above").mapInPandas(walk, "g long, blk long, above binary")


def paths_to_blocks(cuts: list[DataFrame], above: DataFrame) -> DataFrame:
    """g, blk, above: for each block of leaves the path from its root up. ``above`` (g, above) is what
    stands over the root of a tree."""
    out = None
    for s in range(len(cuts) - 1, -1, -1):
        top = cuts[s].filter("address = 0").select("g", "blk").join(above, "g")
        out = top if out is None else top.unionByName(out)
        if s:
            out = stored(_paths(cuts[s], out, False), f"manifest-paths-{s}")
    return stored(out, "manifest-above")


# ---------------------------------------------------------------- the manifest of a table

@dataclass
class Manifest:
    """``leaves``: g, idx, key, digest, claim (null, or the digest to be checked in its place);
    ``groups``: g, group, n, subroot, root; ``cuts`` and ``top``: the stored blocks of the groups' trees and of the
    tree over them. ``None`` for all but ``leaves`` in an empty table."""

    leaves: DataFrame
    groups: DataFrame | None
    cuts: list[DataFrame]
    top: list[DataFrame]

    def blocks(self) -> DataFrame:
        """The manifest as a table: tree (the group's number, null for the tree over the groups), address, levels, digests."""
        every = [(b, F.col("g")) for b in self.cuts] + [(b, F.lit(None).cast("long")) for b in self.top]
        parts = [b.select(tree.alias("tree"), "address", "levels", "digests") for b, tree in every]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def field(c: Column) -> Column:
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(columns: dict[str, Column]) -> Column:
    """Digest of a row: each field as its length and value, in the order of ``columns``."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns.values()]).cast("binary"), 256))


def build_manifest(df: DataFrame, key: str, group: str, fields: tuple[str, ...], claims: dict[str, Column] | None = None,
                   claimed: Column | None = None) -> Manifest:
    """The manifest of ``df``. ``claims`` gives other values of some fields for rows where ``claimed`` holds:
    what a copy of the row says now, to be checked against the manifest."""
    own = {c: F.col(f"`{c}`") for c in fields}
    claim = F.when(F.coalesce(claimed, F.lit(False)), leaf_digest(own | claims)) if claims else F.lit(None).cast("binary")
    rows = df.select(F.col(f"`{group}`").cast("string").alias("group"), F.col(f"`{key}`").alias("key"), leaf_digest(own).alias("digest"), claim.alias("claim"))
    rows = row_index(rows, ["group", "key", "digest"], "i")
    sizes = stored(rows.groupBy("group").agg(F.count("*").alias("n"), F.min("i").alias("first")), "manifest-sizes")
    most, n_groups = sizes.agg(F.max("n"), F.count("*")).first()
    if not n_groups:
        return Manifest(rows.select(F.col("i").alias("g"), F.col("i").alias("idx"), "key", "digest", "claim"), None, [], [])
    groups = stored(row_index(sizes, ["first"], "g").select("g", "group", "n", "first", _levels(F.col("n")).alias("tree_levels")), "manifest-groups")
    at = small_side(groups.select("g", F.col("group").alias("__group"), "first", "tree_levels"), BROADCAST_ROWS)
    leaves = rows.join(at, rows["group"].eqNullSafe(F.col("__group"))).select("g", "tree_levels", (F.col("i") - F.col("first")).alias("idx"), "key", "digest", "claim")
    cuts = grow(leaves.select("g", "tree_levels", "idx", "digest"), most)
    subroots = stored(roots(cuts), "manifest-subroots")
    top = grow(subroots.select(F.lit(0).cast("long").alias("g"), _levels(F.lit(n_groups)).alias("tree_levels"), F.col("g").alias("idx"), "digest"), n_groups)
    root = roots(top).first()["digest"]
    groups = groups.join(subroots, "g").select("g", "group", "n", F.lower(F.hex("digest")).alias("subroot"), F.lit(bytes(root).hex()).alias("root"))
    return Manifest(leaves, stored(groups, "manifest-roots"), cuts, top)


def proofs(m: Manifest) -> DataFrame:
    """g, key, leaf, proof_sha256, folded_root: for each leaf the hash of its siblings up to the
    dataset's root, and the root that the claimed (else the own) digest leads to."""
    schema = "g long, key {}, leaf string, proof_sha256 string, folded_root string".format(m.leaves.schema["key"].dataType.simpleString())
    if m.groups is None:
        return m.leaves.sparkSession.createDataFrame([], schema)
    one = m.leaves.sparkSession.range(1).select(F.lit(0).cast("long").alias("g"), F.lit(b"").alias("above"))
    over = paths_to_blocks(m.top, one)  # one row for each block of groups
    groups = _paths(m.top[0], over, True).select(F.col("blk").alias("g"), "above")
    above = paths_to_blocks(m.cuts, groups)
    blocks = m.cuts[0].join(above, ["g", "blk"])
    leaves = m.leaves.withColumn("l", _stratum("tree_levels", 0)).withColumn("blk", F.expr(f"shiftright(idx, {ARITY_BITS} * (l - 1))"))
    rows = leaves.select("g", "blk", "idx", "key", "digest", "claim").unionByName(
        blocks.select("g", "blk", F.lit(-1).cast("long").alias("idx"), "levels", "digests", "k", "above"), allowMissingColumns=True)
    rows = rows.repartition("g", "blk").sortWithinPartitions("g", "blk", "idx")  # the block comes before its leaves

    def prove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, first = None, 0
        for frame in frames:
            out = []
            for g, blk, idx, key, digest, claim, levels, digests, k, over in zip(*[frame[c] for c in (
                    "g", "blk", "idx", "key", "digest", "claim", "levels", "digests", "k", "above")], strict=True):
                if idx < 0:
                    block, first = Block(digests, b"", int(k), int(levels), True, over), int(blk) << (ARITY_BITS * (int(levels) - 1))
                    continue
                path = block.path(int(idx) - first)
                proof, root = folded(bytes(digest if claim is None else claim), path)
                out.append((g, key, digest.hex(), proof, root))
            yield pd.DataFrame(out, columns=["g", "key", "leaf", "proof_sha256", "folded_root"])

    return rows.mapInPandas(prove, schema)


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, and whether its (at times tampered) copy still leads to the root."""
    docs = clashless(table(spark, sf_dir, "documents"), list(FIELDS))
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    m = build_manifest(docs, "doc_id", "lang", FIELDS, {"text": F.translate("text", UPPER, UPPER.lower())}, tampered)
    out = proofs(m)
    if m.groups is None:
        out = out.withColumns({"subroot": F.lit(""), "root": F.lit("")})
    else:
        out = out.join(small_side(m.groups.select("g", "subroot", "root"), BROADCAST_ROWS), "g")
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels that the SQL can build: 8^8 rows of a language.
_SQL_LEVELS = 8


def _sql() -> str:
    def fields(text: str) -> str:
        cols = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}) || ':' || {c} END" for c in cols) + ")"

    def tree(name: str, base: str, group: str) -> list[str]:
        out = [f"{name}0 AS ({base})"]
        for k in range(1, _SQL_LEVELS + 1):
            # a tree with one node left keeps it
            out.append(f"""{name}{k} AS (SELECT {group}, i // 8 AS i, CASE WHEN any_value(m) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d,
              any_value(m) > 1 AS made FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS m FROM {name}{k - 1}) GROUP BY {group}, i // 8)""")
        return out

    def climb(name: str, src: str, leaf: str, group: str, key: str) -> list[str]:
        out, prev = [], src
        for k in range(_SQL_LEVELS):
            out.append(f"""{name}{k} AS (SELECT p.* EXCLUDE (i, f, proof), p.i // 8 AS i,
              CASE WHEN q.m > 1 THEN p.proof || coalesce(q.others, '') ELSE p.proof END AS proof,
              CASE WHEN q.m > 1 THEN sha256(coalesce(q.l, '') || p.f || coalesce(q.r, '')) ELSE p.f END AS f
              FROM {prev} p JOIN (SELECT a.{group} AS gg, a.i AS ii, any_value(a.m) AS m, string_agg(b.d, '' ORDER BY b.i) AS others,
                string_agg(b.d, '' ORDER BY b.i) FILTER (WHERE b.i < a.i) AS l, string_agg(b.d, '' ORDER BY b.i) FILTER (WHERE b.i > a.i) AS r
                FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS m FROM {leaf}{k}) a LEFT JOIN {leaf}{k} b ON a.{group} = b.{group} AND a.i // 8 = b.i // 8 AND a.i <> b.i
                GROUP BY a.{group}, a.i) q ON p.{key} = q.gg AND p.i = q.ii)""")
            prev = f"{name}{k}"
        return out

    top = _SQL_LEVELS
    parts = [
        "bits(i, c, k) AS (SELECT i, i, 0 FROM range(0, 256) x(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8)",
        "tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)",
        f"docs AS (SELECT doc_id, lang, {fields('text')} AS leaf, {fields(f'''translate(text, '{UPPER}', '{UPPER.lower()}')''')} AS other, "
        "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), "
        "lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1]))) AS crc FROM documents, tab)",
        "langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents))",
        "l AS (SELECT docs.*, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM docs JOIN langs ON docs.lang IS NOT DISTINCT FROM langs.lang)",
        *tree("n", "SELECT g, i, leaf AS d, false AS made FROM l", "g"),
        *tree("t", f"SELECT 0 AS z, g AS i, d, false AS made FROM n{top}", "z"),
        "s AS (SELECT l.doc_id, l.leaf, l.g, 0 AS z, l.i, '' AS proof, CASE WHEN crc % 3 = 0 THEN other ELSE leaf END AS f FROM l)",
        *climb("u", "s", "n", "g", "g"),
        f"v AS (SELECT u.* EXCLUDE (i), u.g AS i FROM u{top - 1} u)",
        *climb("w", "v", "t", "z", "z"),
    ]
    return (f"WITH RECURSIVE {', '.join(parts)} SELECT w.doc_id, w.leaf, n{top}.d AS subroot, t{top}.d AS root, sha256(w.proof) AS proof_sha256, w.f AS folded_root, "
            f"w.f = t{top}.d AS verified FROM w{top - 1} w JOIN n{top} ON n{top}.g = w.g, t{top}")


OP11_SQL = _sql()
