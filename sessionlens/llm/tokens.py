"""Edit-aware token counts.

A tree is kept for each document: its leaves are runs of ``LEAF`` pre-tokens with their lengths and
token counts, its inner nodes the sums of pairs below. An edit re-encodes the pre-tokens that it
touches and a few before it, until a pre-token ends where one ended before, after the edit: from
there on the text is cut as it was. Only the leaves concerned change, and the sums above them.

The tokenizer is a byte-pair encoding that never merges over a pre-token's end, so the count of a text
is the sum over its pre-tokens. The expression that cuts pre-tokens looks forward only, two
characters past the end of a pre-token at most, so a pre-token that ends three characters before an
edit stays.

Defined cases: null text is empty and has no tokens; edits of a document are given by place in its
original text, are applied from left to right, and may not overlap (one that begins before the end
of the one before it is left out); places past the end are the end; an edit of a document that
isn't there is ignored; repeated rows of a document each get its edits; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, clashless, small_batches, table, text_size

#: Where the vocabulary is; the same place on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the expression that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters past its end that may decide how a pre-token is cut.
AHEAD = 3
#: Pre-tokens in a leaf.
LEAF = 64
#: Pre-tokens whose counts a worker remembers; beyond it starts anew.
MEMORY = 500_000
BATCH_CHARS = 500_000

_CUT = regex.compile(PATTERN)


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Counter:
    """Token counts of pre-tokens, remembered within bounds."""

    def __init__(self, path: str = VOCABULARY):
        self.encoding, self.known, self.encoded = _encoder(path), {}, 0

    def __call__(self, pieces: list[str]) -> list[int]:
        self.encoded += len(pieces)
        out = list(map(self.known.get, pieces))
        if None in out:
            for i, p in enumerate(pieces):
                if out[i] is None:
                    out[i] = self._encode(p)
        return out

    def _encode(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) < 64:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[piece] = n
        return n


@dataclass
class Tree:
    """Leaves: lengths in characters and token counts of their pre-tokens. ``sums``: the levels of
    (characters, tokens) above them, pairs added up, the root last."""

    sizes: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    sums: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, text: str, count: Counter) -> Tree:
        pieces = _CUT.findall(text)
        sizes, counts = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.array(count(pieces), np.int64)
        tree = cls([sizes[i:i + LEAF] for i in range(0, len(sizes), LEAF)], [counts[i:i + LEAF] for i in range(0, len(counts), LEAF)])
        tree._sum_up()
        return tree

    def _sum_up(self) -> None:
        level = np.array([(s.sum(), c.sum()) for s, c in zip(self.sizes, self.counts, strict=True)], np.int64).reshape(-1, 2)
        self.sums = [level]
        while len(level) > 1:
            level = np.add.reduceat(level, np.arange(0, len(level), 2))
            self.sums.append(level)

    @property
    def total(self) -> int:
        return int(self.sums[-1][0, 1]) if len(self.sums[0]) else 0

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds character ``place`` (the last leaf past the end), and where it begins."""
        node, begin = 0, 0
        for level in reversed(self.sums[:-1]):
            node *= 2
            if place >= begin + level[node, 0] and node + 1 < len(level):
                begin += int(level[node, 0])
                node += 1
        return node, begin

    def replace(self, first: int, last: int, sizes: np.ndarray, counts: np.ndarray) -> None:
        """Put these pre-tokens in place of the leaves first to last. As many leaves as before: only the
        sums above them change. Else the levels are built again from the sums of the leaves."""
        parts = max(1, -(-len(sizes) // (2 * LEAF))) if last == first else max(1, -(-len(sizes) // LEAF))
        new_sizes, new_counts = np.array_split(sizes, parts), np.array_split(counts, parts)
        self.sizes[first:last + 1], self.counts[first:last + 1] = new_sizes, new_counts
        own = np.array([(s.sum(), c.sum()) for s, c in zip(new_sizes, new_counts, strict=True)], np.int64).reshape(-1, 2)
        if parts != last - first + 1:
            level = np.concatenate([self.sums[0][:first], own, self.sums[0][last + 1:]])
            self.sums = [level]
            while len(level) > 1:
                level = np.add.reduceat(level, np.arange(0, len(level), 2))
                self.sums.append(level)
            return
        self.sums[0][first:last + 1] = own
        lo, hi = first, last
        for below, level in zip(self.sums[:-1], self.sums[1:], strict=True):
            lo, hi = lo // 2, hi // 2
            for k in range(lo, hi + 1):
                level[k] = below[2 * k:2 * k + 2].sum(axis=0)

    def edit(self, text: str, start: int, end: int, put: str, count: Counter) -> str:
        """Replace text[start:end] by ``put``; returns the new text. ``text`` is what the tree is of."""
        new = text[:start] + put + text[end:]
        if not len(self.sums[0]):
            fresh = Tree.of(new, count)
            self.sizes, self.counts, self.sums = fresh.sizes, fresh.counts, fresh.sums
            return new
        # leaves before this one end far enough before the edit to stay as they are
        first, begin = self.find(max(0, start - AHEAD))
        if first and begin > start - AHEAD:
            first -= 1
            begin -= int(self.sums[0][first, 0])
        shift = len(put) - (end - start)
        sizes, counts = [self.sizes[first]], [self.counts[first]]
        last, old_end = first, begin + int(self.sums[0][first, 0])
        ends = (begin + np.cumsum(self.sizes[first]))
        keep = int(np.searchsorted(ends, start - AHEAD, side="right"))  # pre-tokens of the leaf that stay
        at = int(ends[keep - 1]) if keep else begin
        made, olds = [], ends[keep:]
        pos, k = at, 0  # k: the old pre-tokens that the new ones have passed
        while pos < len(new):
            m = _CUT.match(new, pos)
            made.append(m[0])
            pos = m.end()
            back = pos - shift  # where this is in the old text, if after the edit
            while True:
                while k < len(olds) and olds[k] < back:
                    k += 1
                if k < len(olds) or last + 1 >= len(self.sizes):
                    break
                last += 1
                more = old_end + np.cumsum(self.sizes[last])
                sizes.append(self.sizes[last])
                counts.append(self.counts[last])
                olds, old_end = np.concatenate([olds, more]), int(more[-1])
            if back >= end and k < len(olds) and olds[k] == back:
                k += 1
                break
        else:  # to the end of the text: all old pre-tokens are passed
            while last + 1 < len(self.sizes):
                last += 1
                sizes.append(self.sizes[last])
                counts.append(self.counts[last])
            k = sum(map(len, sizes)) - keep
        s, c = np.concatenate(sizes), np.concatenate(counts)
        s = np.concatenate([s[:keep], np.array([len(p) for p in made], np.int64), s[keep + k:]])
        c = np.concatenate([c[:keep], np.array(count(made), np.int64), c[keep + k:]])
        if len(s):
            self.replace(first, last, s, c)
        else:  # nothing is left of these leaves
            del self.sizes[first:last + 1], self.counts[first:last + 1]
            self._sum_up()
        return new


def edited_counts(docs: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_after, n_encoded (pre-tokens that were encoded again) of
    each row of ``docs``. ``edits``: doc_id, start, end (code points of the text), put."""
    own = clashless(docs, ["doc_id", "text"])
    listed = edits.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("e_id")).agg(
        F.array_sort(F.collect_set(F.struct("start", "end", "put"))).alias("e"))
    df = own.join(listed, F.col("doc_id") == F.col("e_id"), "left").select("doc_id", "text", F.col("e").alias("edits"))
    return edited_arrays(df, vocabulary)


def edited_arrays(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The same for ``docs`` that hold their edits as an array of struct(start, end, put), sorted."""
    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = Counter(vocabulary)
        for f in batches(frames, text_size, "text", BATCH_CHARS):
            rows = []
            for doc_id, text, edits in zip(f.doc_id, f.text, f.edits, strict=True):
                now = text or ""
                tree = Tree.of(now, count)
                before, encoded, moved, done, n = tree.total, count.encoded, 0, 0, 0
                for e in edits if edits is not None else ():
                    size = len(text or "")
                    start, end = min(e["start"], size), min(max(e["end"], e["start"]), size)
                    if start < done:
                        continue
                    now = tree.edit(now, start + moved, end + moved, e["put"] or "", count)
                    moved, done, n = moved + len(e["put"] or "") - (end - start), end, n + 1
                rows.append((doc_id, before, n, tree.total, count.encoded - encoded))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_encoded"])

    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "edits")
    out = own.mapInPandas(counted, "doc_id string, n_tokens long, n_edits long, n_tokens_after long, n_encoded long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


#: What the query edits: the first of each of these in a text.
EDITS = ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<EMAIL>"), (r"[0-9]{4,}", "<NUMBER>"), (r"\n", "\n\n"),
         (r"\p{L}+\.", "and so on."))


def first_edits(text: str = "text") -> F.Column:
    """Sorted array of edits: the first match of each of EDITS in the text is replaced."""
    out = []
    for pattern, put in EDITS:
        at = F.regexp_instr(F.col(text), F.lit(f"({pattern})"))
        if "@" in pattern:  # most texts have no address, and needn't be searched for one
            at = F.when(F.col(text).contains("@"), at)
        got = F.regexp_extract(F.col(text), f"({pattern})", 1)
        out.append(F.when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.length(got)).alias("end"), F.lit(put).alias("put"))))
    return F.array_sort(F.array_compact(F.array(*out)))


def op7_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, before and after edits that normalise it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return edited_arrays(docs.withColumn("edits", first_edits())).select("doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_encoded")
