"""The audit against all edits of short conversations, and against itself in blocks."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from sessionlens.llm import audit as A

SCHEMA = "conv_id long, turn long, role string, text string, c string, b long, i long"


def fault_of(role, text, seen):
    if not re.search(r"[^\x20\x09-\x0D]", text):
        return A.BLANK
    if (role, text) in seen:
        return A.DUPLICATE
    return A.CLEAN if text.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?" else A.TRUNCATED


def faults_of(rows):
    return [fault_of(r, t, set(rows[:i])) for i, (r, t) in enumerate(rows)]


def brute(rows, costs):
    """Cheapest, then least audit over all edits, with up to two new turns in each place where they are cheap."""
    best, inserts = None, 1 if costs.insert > costs.delete else 2
    faults = faults_of(rows)
    for ops in itertools.product(*["D" if f in (A.BLANK, A.DUPLICATE) else "KRD" for f in faults]):
        base = sum({"K": 0, "R": costs.rerole, "D": costs.delete}[o] + (costs.truncated if f == A.TRUNCATED and o != "D" else 0) for o, f in zip(ops, faults, strict=True))
        for gaps in itertools.product(range(inserts + 1), repeat=len(rows) + 1):
            cost = base + costs.insert * sum(gaps)
            if best and cost > best[0]:
                continue
            audit = "".join("I" * g + o for g, o in zip(gaps, ops, strict=False)) + "I" * gaps[-1]
            options = [{"K": [r[:1] or "?"], "R": "ua", "D": [""]}[o] for (r, _), o in zip(rows, ops, strict=True)]
            choices = [c for g, o in zip(gaps, options, strict=False) for c in ["ua"] * g + [o]] + ["ua"] * gaps[-1]
            for roles in itertools.product(*choices):
                if re.fullmatch("(s?(ua)+)?", "".join(roles)) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, roles)
    cost, audit, roles = best
    left, out = iter(rows), []
    for letter, role in zip(audit, roles, strict=True):
        had = ("", "") if letter == "I" else next(left)
        if letter != "D":
            out.append(f"{had[0] if letter == 'K' else {'u': 'user', 'a': 'assistant'}[role]}:{had[1]}")
    return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def conversation(r, n):
    return [(r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", "unknown"]), r.choice([f"t{k}.", f"t{k}", "same.", "", " \t"])) for k in range(n)]


COSTS = [A.Costs(), A.Costs(rerole=9, delete=9, insert=1, truncated=0), A.Costs(rerole=2, delete=4, insert=2, truncated=1)]


@pytest.mark.parametrize("mod", [A.Node.MOD, 3], ids=["hashes", "collisions"])
def test_blocks_in_memory_equal_all_edits(monkeypatch, mod):
    monkeypatch.setattr(A.Node, "MOD", mod)
    r = random.Random(4)
    for _ in range(60):
        rows, costs = conversation(r, r.randrange(1, 5)), r.choice(COSTS)
        got = A.solved([x[:1] for x, _ in rows], faults_of(rows), (A.NONE,), costs)
        reached = {end: (cost, A.Node()) for (_, end), (cost, _) in got.items()}
        ends = []
        for end in reached:
            for state, (cost, node) in A.with_inserts({end: reached[end]}, costs).items():
                if state in A.ACCEPTED:
                    ends.append((cost, got[A.NONE, end][1] + "I" * node.depth))
        assert min(ends) == brute(rows, costs)[:2]


def test_nodes_compare_as_strings(monkeypatch):
    for mod in (A.Node.MOD, 5):
        monkeypatch.setattr(A.Node, "MOD", mod)
        r = random.Random(9)
        made = [(A.Node(), "")]
        for _ in range(300):
            node, text = r.choice(made[-30:] + made[:5])
            letter = r.choice("DIK")
            made.append((A.Node(node, ord(letter)), text + letter))
        for _ in range(2000):
            (x, s), (y, t) = r.choice(made), r.choice(made)
            assert A.before(x, y) == (s < t) and A.text_of(x) == s and x.at(len(s) // 2).depth == len(s) // 2


def plain(rows, costs=A.Costs()):
    """Contract columns of rows (conv_id, turn, role, text) as they are."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted([(t, x or " " if x is None else x, y if y is not None else " ") for c, t, x, y in rows if c == conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, *_ in mine if t is not None]
        said = [(x, y) for _, x, y in mine]
        f = faults_of(said)
        illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(said[:-1], said[1:], strict=True))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count(A.BLANK), f.count(A.DUPLICATE), f.count(A.TRUNCATED), illegal, *brute(said, costs))
    return out


def sample(r, convs, most=5):
    rows = []
    for conv in [*range(convs), None]:
        for k, (role, text) in enumerate(conversation(r, r.randrange(1, most))):
            rows.append((conv, r.choice([k, k, k + 3, None, 1]), None if role == "tool" else role, None if text == "" else text))
    return rows


@pytest.mark.parametrize("block,costs", [(4096, COSTS[0]), (2, COSTS[0]), (1, COSTS[1]), (3, COSTS[2])], ids=str)
def test_conversations_equal_all_edits(spark, monkeypatch, block, costs):
    monkeypatch.setattr(A, "BLOCK", block)
    rows = sample(random.Random(block), 15)
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in A.audit_conversations(df, costs).collect()}
    assert got == plain(rows, costs)


def test_a_long_conversation_in_blocks(spark, monkeypatch):
    r = random.Random(2)
    rows = [(7, k, role, text) for k, (role, text) in enumerate(conversation(r, 900))] + [(8, 0, "user", "x" * 300_000 + "."), (8, 1, "assistant", "ok.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    whole = {x.conv_id: tuple(x) for x in A.audit_conversations(df).collect()}
    monkeypatch.setattr(A, "BLOCK", 7)
    assert {x.conv_id: tuple(x) for x in A.audit_conversations(df).collect()} == whole
    assert whole[8][6:8] == (0, "KK") and len(whole[7][7]) >= 900


def damage(rows):
    out = []
    for c, t, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
        role, text = "user" if k == 4 else show(role), "" if k == 1 else re.sub("[.!?]", "", show(text)) if k == 2 else show(text)
        out += [(c, t, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def test_the_query_on_damaged_rows(spark, tmpdir_path):
    r = random.Random(5)
    rows = sample(r, 60, 4)
    gone = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "all of it goes."))
    spark.createDataFrame([(*x, "clash", 1, 2) for x in rows], SCHEMA).write.parquet(f"{tmpdir_path}/conversations.parquet")
    got = {x.conv_id: tuple(x)[1:] for x in A.op12_conversation_audit(spark, tmpdir_path).collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: empty for c in {x[0] for x in rows}} | plain(damage(rows))
    assert got == want and got[gone] == empty


def test_no_conversations(spark, tmpdir_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmpdir_path}/conversations.parquet")
    got = A.op12_conversation_audit(spark, tmpdir_path)
    assert got.count() == 0 and got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
