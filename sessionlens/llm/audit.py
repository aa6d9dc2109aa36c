"""Conversation structure: faults counted, and the cheapest edits that repair it.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. Rows are kept,
given the role that is due, or deleted, and empty user or assistant turns are inserted; of the cheapest ways that
whose audit (K, R, D, I in order) is least in ASCII is taken.

The dynamic program has a state for what came last (nothing, s, u, a). What leads to a state is
a linked node that shares its prefix with the others (``Node``): with ancestors at distances of powers of two and a
rolling hash of the audit so far. Two audits of equal cost are compared by a search
for their longest common prefix over the ancestors' hashes; what the hashes call equal is then verified
letter by letter, up to the node that both share.

A conversation may hold a third of all rows, so it is cut into blocks of rows. A block is solved for every state
that it may begin in, all blocks at a time; audits of a block's rows form a prefix code (each row adds some I and
one other letter), so the order of the block's audits, as a rank, stands for them when blocks are put together, by the same program over blocks.
The hash of the repaired text is one SHA-256, which a task streams frame by frame.

Defined cases: a null role or text is one space, a null conversation is one of its own; rows go
by turn (nulls first), then role and text; a role counts by its first character, an empty one has
none; a blank row isn't also a duplicate, a duplicate isn't also truncated; extra columns are
ignored; an empty table gives no rows. An audit, and no more than that, is as long as its
conversation has rows, in one row of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.operators.ordered import row_index

from .common import clashless, small_batches, small_side, stored, table

#: Rows of a block.
BLOCK = 4096
#: Most duplicated turns, and conversations of several blocks, whose table is broadcast.
BROADCAST_ROWS = 500_000
WHITE = " \t\n\x0b\x0c\r"

NONE, S, U, A = range(4)
#: The user or assistant state that is due after a state.
DUE = (U, U, A, U)
#: States in which an initial may stand, and what it leads to.
KEPT = {"s": {NONE: S}, "u": {NONE: U, S: U, A: U}, "a": {U: A}}
ACCEPTED = (NONE, A)
ROLE = {U: "user", A: "assistant"}

CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)


@dataclass(frozen=True)
class Costs:
    """Of the edits; ``truncated`` is added for each truncated row that isn't deleted. ``insert`` is above zero."""

    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


# ---------------------------------------------------------------- persistent audits

class Node:
    """The last letter of an audit. ``up[k]`` is the node 2^k letters before, ``hash`` that of all letters so far."""

    __slots__ = ("letter", "depth", "hash", "up", "tag")
    BASE, MOD = 1_000_003, (1 << 61) - 1

    def __init__(self, before: Node | None = None, letter: int = 0, tag: object = None):
        self.letter, self.tag = letter, tag
        if before is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth, self.hash = before.depth + 1, (before.hash * Node.BASE + letter + 1) % Node.MOD
        up, k = [before], 0
        while len(up[k].up) > k:
            up.append(up[k].up[k])
            k += 1
        self.up = up

    def at(self, depth: int) -> Node:
        node = self
        while node.depth > depth:
            node = node.up[(node.depth - depth).bit_length() - 1]
        return node

    def path(self) -> list[Node]:
        out, node = [], self
        while node.depth:
            out.append(node)
            node = node.up[0]
        return out[::-1]

    def letters(self) -> list[int]:
        return [n.letter for n in self.path()]


def _shared(x: Node, y: Node) -> bool:
    """Whether two audits of one length are the same: letters are compared up to the first node of both."""
    while x is not y:
        if x.letter != y.letter:
            return False
        x, y = x.up[0], y.up[0]
    return True


def before(x: Node, y: Node) -> bool:
    """Whether the audit of x is less than that of y."""
    if x is y:
        return False
    depth = min(x.depth, y.depth)
    a, b = x.at(depth), y.at(depth)
    if a.hash == b.hash and _shared(a, b):
        return x.depth < y.depth
    p, q = a, b
    for k in range(len(p.up) - 1, -1, -1):  # to the first letters that differ
        if k < len(p.up) and p.up[k].hash != q.up[k].hash:
            p, q = p.up[k], q.up[k]
    if p.letter != q.letter and _shared(p.up[0], q.up[0]):
        return p.letter < q.letter
    return a.letters() < b.letters()  # a collision of hashes


Reached = dict[int, tuple[int, Node]]


def offer(reached: Reached, state: int, cost: int, last: Node, letter: int | None = None, tag: object = None) -> None:
    """Put an audit (``last``, and then ``letter``) into ``reached`` if nothing there is cheaper or as cheap and less."""
    held = reached.get(state)
    if held is not None and held[0] < cost:
        return
    node = last if letter is None else Node(last, letter, tag)
    if held is None or cost < held[0] or before(node, held[1]):
        reached[state] = (cost, node)


KEEP, REROLE, DELETE, INSERT = (ord(x) for x in "KRDI")


def with_inserts(reached: Reached, costs: Costs) -> Reached:
    """What up to two inserted turns lead to; more come back to a state at a higher cost."""
    out = dict(reached)
    for _ in range(2):
        for state, (cost, node) in list(out.items()):
            offer(out, DUE[state], cost + costs.insert, node, INSERT)
    return out


def step(reached: Reached, initial: str, fault: int, costs: Costs) -> Reached:
    """After one more row."""
    out: Reached = {}
    keep = {} if fault in (BLANK, DUPLICATE) else KEPT.get(initial, {})
    more = costs.truncated if fault == TRUNCATED else 0
    for state, (cost, node) in with_inserts(reached, costs).items():
        offer(out, state, cost + costs.delete, node, DELETE)
        if state in keep:
            offer(out, keep[state], cost + more, node, KEEP)
        if fault not in (BLANK, DUPLICATE):
            offer(out, DUE[state], cost + more + costs.rerole, node, REROLE)
    return out


def text_of(node: Node) -> str:
    return "".join(map(chr, node.letters()))


def solved(initials: list[str], faults: list[int], starts: tuple[int, ...], costs: Costs) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> (cost, audit) of a block of rows."""
    out = {}
    for start in starts:
        reached: Reached = {start: (0, Node())}
        for initial, fault in zip(initials, faults, strict=True):
            reached = step(reached, initial, fault, costs)
        out |= {(start, end): (cost, text_of(node)) for end, (cost, node) in reached.items()}
    return out


# ---------------------------------------------------------------- faults

def initial(role: str = "role") -> Column:
    return F.substring(role, 1, 1)


def placed(turns: DataFrame) -> DataFrame:
    """c (text of the conversation's id), conv_id, turn, role, text, i (place among all rows), b (block) of conversations."""
    own = clashless(turns, ["conv_id", "turn", "role", "text"]).withColumns(
        {"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    rows = row_index(own, ["conv_id", "turn", "role", "text"], "i")
    return rows.withColumns({"c": key(), "b": F.floor(F.col("i") / BLOCK)})


def key() -> Column:
    """A text for each conversation, null too."""
    return F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))


def with_faults(rows: DataFrame) -> DataFrame:
    """c, b, i, turn, initial, fault of ``placed`` rows."""
    end = F.rtrim("text", F.lit(WHITE))
    h = rows.select("c", "b", "i", "turn", initial().alias("initial"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(29), F.col("text"), F.col("role")).alias("h2"),
                    (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("open"))
    h = stored(h, "audit-rows")
    twice = stored(h.groupBy("c", "h1", "h2").agg(F.min("i").alias("first"), F.count("*").alias("k")).filter("k > 1").drop("k"), "audit-twice")
    h = h.join(small_side(twice, BROADCAST_ROWS), ["c", "h1", "h2"], "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("first") < F.col("i"), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(CLEAN)
    return h.select("c", "b", "i", "turn", "initial", fault.alias("fault"))


# ---------------------------------------------------------------- blocks, and conversations of blocks

PAIRS = [(s, e) for s in range(4) for e in range(4)]


BLOCK_SCHEMA = "c string, b long, costs array<long>, ranks array<int>, audits array<string>, first string, last string, illegal long"
LEGAL = ("su", "ua", "au")


def solve_blocks(rows: DataFrame, costs: Costs) -> DataFrame:
    """For each block of a conversation: cost, rank and audit for PAIRS, its first and last initial, and how many neighbours are
    illegal. A conversation's first block begins in state NONE only."""
    spans = rows.groupBy("c").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).filter("lo < hi")
    multi = small_side(stored(spans.select("c", "lo"), "audit-long"), BROADCAST_ROWS)
    rows = rows.join(multi, "c", "left").select("c", "b", "i", "initial", "fault", F.coalesce(F.col("lo") < F.col("b"), F.lit(False)).alias("later"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        name, initials, faults, later = None, [], [], False

        def done() -> tuple:
            got = solved(initials, faults, (NONE, S, U, A) if later else (NONE,), costs)
            order = {x: r for r, x in enumerate(sorted({x for _, x in got.values()}))}
            illegal = sum(x + y not in LEGAL for x, y in zip(initials[:-1], initials[1:], strict=True))
            return (*name, [got[p][0] if p in got else None for p in PAIRS], [order[got[p][1]] if p in got else None for p in PAIRS],
                    [got[p][1] if p in got else None for p in PAIRS], initials[0], initials[-1], illegal)

        for frame in frames:
            for c, b, first, fault, after in zip(*[frame[x] for x in ("c", "b", "initial", "fault", "later")], strict=True):
                if (c, b) != name:
                    if name is not None:
                        out.append(done())
                    name, initials, faults, later = (c, b), [], [], after
                    if len(out) >= 500:
                        yield pd.DataFrame(out, columns=names)
                        out = []
                initials.append(first)
                faults.append(fault)
        if name is not None:
            out.append(done())
        if out:
            yield pd.DataFrame(out, columns=names)

    names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
    return rows.repartition("c", "b").sortWithinPartitions("c", "b", "i").mapInPandas(solve, BLOCK_SCHEMA)


def joined(blocks: DataFrame, costs: Costs) -> DataFrame:
    """c, b, pick (of PAIRS), and in the last block of a conversation: tail (letters after its rows), cost, illegal."""
    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, reached, at, illegal, end = None, {}, [], 0, ""
        schema = ["c", "b", "pick", "tail", "cost", "illegal"]

        def done() -> list[tuple]:
            best: Reached = {}
            for state, (cost, node) in with_inserts(reached, costs).items():
                if state in ACCEPTED:
                    offer(best, 0, cost, node)
            cost, node = best[0]
            path = node.path()
            picks, tail = [n.tag for n in path if n.tag is not None], "".join("I" for n in path if n.tag is None)
            out = [(name, b, pick, "", 0, 0) for b, pick in zip(at, picks, strict=True)]
            return out[:-1] + [(*out[-1][:3], tail, cost, illegal)]

        held: list[tuple] = []
        for frame in frames:
            for c, b, block_costs, ranks, first, last, inner in zip(*[frame[x] for x in ("c", "b", "costs", "ranks", "first", "last", "illegal")], strict=True):
                if c != name:
                    if name is not None:
                        held += done()
                    name, reached, at, illegal = c, {NONE: (0, Node())}, [], 0
                elif end + first not in LEGAL:
                    illegal += 1
                out: Reached = {}
                for j, (cost, rank) in enumerate(zip(block_costs, ranks, strict=True)):
                    if cost is not None and cost == cost and PAIRS[j][0] in reached:
                        had, node = reached[PAIRS[j][0]]
                        offer(out, PAIRS[j][1], had + int(cost), node, int(rank), j)
                reached, end = out, last
                at.append(b)
                illegal += inner
            if held:
                yield pd.DataFrame(held, columns=schema)
                held = []
        if name is not None:
            yield pd.DataFrame(done(), columns=schema)

    rows = blocks.select("c", "b", "costs", "ranks", "first", "last", "illegal").repartition("c").sortWithinPartitions("c", "b")
    return rows.mapInPandas(fold, "c string, b long, pick int, tail string, cost long, illegal long")


def repaired_hash(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """c, repaired_sha256: of the rows with the chosen edits, as they come, one frame at a time."""
    marks = chosen.select("c", "b", F.lit(-1).cast("long").alias("i"), F.col("tail").alias("role"), F.col("audit").alias("text"))
    both = rows.select("c", "b", "i", "role", "text").unionByName(marks).repartition("c").sortWithinPartitions("c", "b", "i")

    class Text:
        """A repaired conversation: its hash so far, its state, and the letters that are left of the block's audit."""

        def __init__(self):
            self.sha, self.state, self.n, self.letters, self.tail, self.at = hashlib.sha256(), NONE, 0, "", "", 0

        def said(self, role: str, text: str, state: int) -> None:
            self.sha.update(f"{chr(10) if self.n else ''}{role}:{text}".encode())
            self.n, self.state = self.n + 1, state

        def inserted(self) -> None:
            self.said(ROLE[DUE[self.state]], "", DUE[self.state])

        def row(self, role: str, text: str) -> None:
            while self.letters[self.at] == "I":
                self.inserted()
                self.at += 1
            letter, self.at = self.letters[self.at], self.at + 1
            if letter == "K":
                self.said(role, text, KEPT[role[:1]][self.state])
            elif letter == "R":
                self.said(ROLE[DUE[self.state]], text, DUE[self.state])

        def done(self) -> str:
            for _ in self.tail:
                self.inserted()
            return self.sha.hexdigest()

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, now = None, None
        for frame in frames:
            out = []
            for c, i, role, text in zip(frame["c"], frame["i"], frame["role"], frame["text"], strict=True):
                if c != name:
                    if name is not None:
                        out.append((name, now.done()))
                    name, now = c, Text()
                if i < 0:
                    now.letters, now.tail, now.at = text, role, 0
                else:
                    now.row(role, text)
            if out:
                yield pd.DataFrame(out, columns=["c", "repaired_sha256"])
        if name is not None:
            yield pd.DataFrame([(name, now.done())], columns=["c", "repaired_sha256"])

    return both.mapInPandas(hashed, "c string, repaired_sha256 string")


def audit_conversations(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every
    conversation of ``turns`` (conv_id, turn, role, text)."""
    small_batches(turns.sparkSession)
    rows = placed(turns)
    faults = stored(with_faults(rows), "audit-faults")
    count = {n: F.count_if(F.col("fault") == k).alias(n) for n, k in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))}
    stats = faults.groupBy("c").agg(*count.values(), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    blocks = stored(solve_blocks(faults, costs), "audit-blocks")
    picks = stored(joined(blocks, costs), "audit-picks")
    chosen = blocks.join(picks.drop("illegal"), ["c", "b"]).select("c", "b", "tail", "cost", F.get("audits", F.col("pick")).alias("audit"))
    chosen = stored(chosen, "audit-chosen")
    audits = chosen.groupBy("c").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "b", F.concat("audit", "tail").alias("x")))), lambda x: x["x"]), "").alias("audit"))
    illegal = picks.groupBy("c").agg(F.sum("illegal").alias("illegal"))
    names = rows.groupBy("c").agg(F.first("conv_id").alias("conv_id"))
    out = names.join(stats, "c").join(illegal, "c").join(audits, "c").join(repaired_hash(rows, chosen), "c")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


# ---------------------------------------------------------------- the query

def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with every twentieth row or so (by a checksum of its id) dropped, emptied, cut, repeated or given to the user."""
    own = clashless(turns, ["conv_id", "turn", "role", "text"])
    s = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in own.columns}
    own = own.withColumn("k", F.crc32(F.concat(s["conv_id"], F.lit(":"), s["turn"])) % 20).filter("k <> 0")
    text = F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.translate(s["text"], ".!?", "")).otherwise(s["text"])
    role = F.when(F.col("k") == 4, F.lit("user")).otherwise(s["role"])
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1)))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op12_conversation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, audit and repaired text's hash of every damaged conversation."""
    turns = table(spark, sf_dir, "conversations")
    every = turns.select("conv_id").distinct()
    got = audit_conversations(damaged(turns)).withColumnRenamed("conv_id", "__c")
    none = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
    out = every.join(got, F.col("conv_id").eqNullSafe(F.col("__c")) & F.col("audit").isNotNull(), "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(v)).cast("long").alias(c) for c, v in none.items()], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _sql() -> str:
    def add(x: str, cost: str, letter: str, when: str = "true") -> str:
        return f"CASE WHEN {x} IS NOT NULL AND {when} THEN {{'c': {x}.c + {cost}, 'w': {x}.w || '{letter}'}} END"

    def least(*xs: str) -> str:
        return f"list_min([{', '.join(xs)}])"

    ok, more = "f < 1 OR f > 2", "CASE WHEN f = 3 THEN 5 ELSE 0 END"
    keep, rerole = lambda x, i: add(x, more, "K", f"({ok}) AND init = '{i}'"), lambda x: add(x, f"1 + {more}", "R", f"({ok})")
    inserts = lambda src: (f"(SELECT * EXCLUDE (u1, a1), {least('u1', add('a1', '5', 'I'))} AS u2, {least('a1', add('u1', '5', 'I'))} AS a2 FROM "  # noqa: E731
                           f"(SELECT *, {least('u', add('z', '5', 'I'), add('s', '5', 'I'), add('a', '5', 'I'))} AS u1, {least('a', add('u', '5', 'I'))} AS a1 FROM {src}))")
    state = "STRUCT(c BIGINT, w VARCHAR)"
    white = r"[^\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE bits(i, c, k) AS (SELECT i, i, 0 FROM range(0, 256) x(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
    lambda ch: CAST(ascii(ch) AS BIGINT))), lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1]))) % 20 AS k FROM conversations, tab),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM o, range(0, 2) x(n) WHERE k <> 0 AND (n = 0 OR k = 3)),
g AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id NULLS FIRST) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
r AS (SELECT g.c, turn, role, text, row_number() OVER (PARTITION BY g.c ORDER BY turn NULLS FIRST, role, text) AS k FROM d JOIN g ON d.conv_id IS NOT DISTINCT FROM g.conv_id),
e AS (SELECT *, left(role, 1) AS init, row_number() OVER (PARTITION BY c, role, text ORDER BY k) > 1 AS again FROM r),
n AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{white}') THEN 1 WHEN again THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS f,
  lag(init) OVER (PARTITION BY c ORDER BY k) AS pre FROM e),
p(c, k, z, s, u, a) AS (
  SELECT c, CAST(0 AS BIGINT), CAST({{'c': 0, 'w': ''}} AS {state}), CAST(NULL AS {state}), CAST(NULL AS {state}), CAST(NULL AS {state}) FROM (SELECT DISTINCT c FROM n)
  UNION ALL
  SELECT c, k, {add('z', '2', 'D')}, {least(add('s', '2', 'D'), keep('z', 's'))},
    {least(add('u2', '2', 'D'), *[keep(x, 'u') for x in ('z', 's', 'a2')], *[rerole(x) for x in ('z', 's', 'a2')])},
    {least(add('a2', '2', 'D'), keep('u2', 'a'), rerole('u2'))}
  FROM {inserts('(SELECT p.c, n.k, z, s, u, a, init, f FROM p JOIN n ON p.c = n.c AND n.k = p.k + 1)')}),
t AS (SELECT c, count(*) AS m, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE f = 1) AS blank, count(*) FILTER (WHERE f = 2) AS duplicate,
  count(*) FILTER (WHERE f = 3) AS truncated, count(*) FILTER (WHERE pre IS NOT NULL AND pre || init NOT IN ('su', 'ua', 'au')) AS illegal FROM n GROUP BY c),
b AS (SELECT c, best.c AS cost, best.w AS audit FROM (SELECT c, {least('z', 'a2')} AS best FROM {inserts('(SELECT p.* FROM p JOIN t ON p.c = t.c AND p.k = t.m)')})),
x AS (SELECT c, j, audit[j] AS w, len(replace(left(audit, j), 'I', '')) AS k, len(replace(left(audit, j), 'D', '')) AS q, len(replace(audit, 'D', '')) % 2 AS odd
  FROM b, unnest(range(1, len(audit) + 1)) y(j)),
y AS (SELECT x.c, sha256(string_agg(CASE WHEN w = 'K' THEN n.role WHEN (q - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN w = 'I' THEN '' ELSE n.text END, chr(10) ORDER BY j)) AS h
  FROM x LEFT JOIN n ON n.c = x.c AND n.k = x.k WHERE w <> 'D' GROUP BY x.c)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM g LEFT JOIN t ON g.c = t.c LEFT JOIN b ON g.c = b.c LEFT JOIN y ON g.c = y.c
"""


OP12_SQL = _sql()
