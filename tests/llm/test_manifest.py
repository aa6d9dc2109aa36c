"""The Merkle manifest against a tree built plainly in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sessionlens.llm import manifest as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, digest int, blk int"


def h(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def leaf(r, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], r[3], text)])


def climb(nodes):
    """Root, and for each node the runs (others before, others after) up to it."""
    paths, at = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[i:i + 8] for i in range(0, len(nodes), 8)]
        up = [[] for _ in runs]
        for i, under in enumerate(at):
            run, place = runs[i // 8], i % 8
            for x in under:
                paths[x].append((run[:place], run[place + 1:]))
            up[i // 8] += under
        nodes, at = [h(*r) for r in runs], up
    return nodes[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))) for g in names}
    built = {g: climb([leaf(r, r[4]) for r in trees[g]]) for g in names}
    root, over = climb([built[g][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for r, path in zip(trees[g], built[g][1], strict=True):
            path = path + over[k]
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            at = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if bad else r[4])
            for left, right in path:
                at = h(*left, at, *right)
            out.append((r[0], leaf(r, r[4]), built[g][0], root, h(*[x for a, b in path for x in a + b]), at, at == root))
    return out


def rows(n):
    out = [(i, f"s{i % 3}", ("en", "de", None, "é", "")[0 if i % 3 else i % 5], i if i % 7 else None, f"Text {i} Éİ 𝒜" if i % 11 else None) for i in range(n)]
    out += [(5, "s2", "en", 5, "Text 5 again"), (7, "s1", "en", None, "Text 7"), (7, "s1", "en", None, "Text 7"), (None, None, None, None, None),
            (None, "x", "fr", 1, "A" * 200_000), (-3, "", "fr", -1, ""), (2 ** 62, "y", "only", 0, "Z")]
    return out


@pytest.fixture(params=[(1, 2), (40, 1), (700, 2), (700, 5)], ids=str)
def case(request, monkeypatch):
    n, unit = request.param
    whole = M.strata
    monkeypatch.setattr(M, "strata", lambda levels, u=unit: whole(levels, u))
    return rows(n)


def write(spark, path, data):
    spark.createDataFrame([(*r, "clash", 1, 2) for r in data], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")


def test_proofs_equal_a_plain_tree(spark, tmpdir_path, case):
    write(spark, tmpdir_path, case)
    got = M.op11_merkle_manifest(spark, tmpdir_path)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(case), key=key)


def test_an_empty_table_and_a_single_row(spark, tmpdir_path):
    write(spark, f"{tmpdir_path}/none", [])
    got = M.op11_merkle_manifest(spark, f"{tmpdir_path}/none")
    assert got.count() == 0 and got.columns[0] == "doc_id" and dict(got.dtypes)["verified"] == "boolean"
    one = [(4, "s", "en", 1, "ABC")]
    write(spark, f"{tmpdir_path}/one", one)
    (r,) = M.op11_merkle_manifest(spark, f"{tmpdir_path}/one").collect()
    assert tuple(r) == plain(one)[0] and r.root == r.leaf and r.proof_sha256 == h("")


@pytest.mark.parametrize("levels", range(1, 7))
def test_addresses_fill_a_tree_once(levels):
    at = [M.address(levels, d, i) for d in range(levels) for i in range(M.ARITY ** d)]
    assert sorted(at) == list(range(M.nodes_in(levels))) and at[0] == 0


def test_blocks_are_runs_of_addresses(spark):
    """What lies in a block is contiguous, cut after cut, as the layout asks for."""
    for levels in range(1, 8):
        depth = levels
        for cut in M.strata(levels, 2):
            depth -= cut
            for blk in {0, M.ARITY ** depth - 1}:
                base = M.address(levels, depth, blk)
                inside = [M.address(levels, depth + d, (blk << (3 * d)) + i) - base for d in range(cut) for i in range(M.ARITY ** d)]
                assert inside == [int(x) for d in range(cut) for x in M.offsets(cut)[d]]


def test_the_manifest_holds_every_node(spark):
    data = rows(600)
    df = spark.createDataFrame([r for r in data], "doc_id long, source string, lang string, n_chars long, text string")
    m = M.build_manifest(df, "doc_id", "lang", M.FIELDS)
    blocks = m.blocks().collect()
    held = sum(1 for b in blocks for i in range(0, len(b.digests), M.DIGEST) if any(b.digests[i:i + M.DIGEST]))
    want = 0
    for n in [r["count"] for r in df.groupBy("lang").count().collect()] + [m.groups.count()]:
        want += n
        while n > 1:
            n = -(-n // 8)
            want += n
    assert held == want and len({(b.tree, b.address) for b in blocks}) == len(blocks)
    assert M.proofs(m).where(F.col("folded_root") != m.groups.first().root).count() == 0
