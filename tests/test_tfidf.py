"""Terms are counted in pieces, and numbered, before they become rows; the weights are those of the definition."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sessionlens.operators import tfidf as TF


def made(n_docs=30, n_lines=7, seed=5):
    r = random.Random(seed)
    words = ["a", "b", "été", "Straße", "x_1", "нет", "w7", "zz"]
    return [(f"d{k}", i, " ".join(r.choice(words) for _ in range(r.choice([0, 0, 1, 2, 5]))) + r.choice(["", "!", " "])) for k in range(n_docs) for i in range(n_lines)]


def counts(rows):
    docs = {}
    for k, _, t in sorted(rows, key=lambda x: x[:2]):
        docs.setdefault(k, []).extend(w for w in t.lower().replace("!", " ").split())
    return {k: Counter([*w, *[f"{a} {b}" for a, b in zip(w, w[1:])]]) for k, w in docs.items()}


def weights(rows, most):
    docs = counts(rows)
    df, cnt = Counter(t for c in docs.values() for t in c), sum(docs.values(), Counter())
    chosen = sorted((t for t in df if df[t] >= 2), key=lambda t: (-cnt[t], t.encode()))[:most]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in chosen}
    out = {}
    for k, c in docs.items():
        w = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out |= {(k, t): x / norm for t, x in w.items()}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, pos long, text string").repartition(4)


def test_a_document_is_one_counted_row(spark):
    rows = made()
    got = TF.term_pieces(frame(spark, rows), "k", "pos", "text").collect()
    want = {k: c for k, c in counts(rows).items() if c}
    assert len(got) == len(want) == len({r.k for r in got})
    back = TF._rows_of(TF.term_pieces(frame(spark, rows), "k", "pos", "text"), "k").collect()
    assert {(r.k, r.term): r.tf for r in back} == {(k, t): n for k, c in want.items() for t, n in c.items()}


@pytest.mark.parametrize("chunk, most", [(4096, 3), (2, 1 << 20), (1, 1)])
def test_keys_in_several_pieces(spark, chunk, most):
    rows = made()
    pieces = TF.stored(TF.term_pieces(frame(spark, rows), "k", "pos", "text", chunk, most=most), "term-pieces")
    assert pieces.count() > len(counts(rows))
    whole, rest = TF._split(pieces, "k")
    got = [(r.k, r.term, r.tf) for r in TF._rows_of(whole, "k").unionByName(rest).collect()]
    assert len(got) == len(set(got)) and set(got) == {(k, t, n) for k, c in counts(rows).items() for t, n in c.items()}


@pytest.mark.parametrize("most, bits", [(10, 64), (17, 64), (10_000, 64), (17, 3), (10_000, 5)])
def test_weights(spark, most, bits):
    """Also where numbers don't tell terms apart, at ties of the last rank, and for keys of several chunks."""
    rows = [*made(), *[("far", i * 3000, "a b zz") for i in range(4)]]
    got = TF.relational_tfidf(frame(spark, rows), "k", "pos", "text", max_features=most, id_bits=bits).collect()
    want = weights(rows, most)
    assert len(got) == len(want) and all(r.weight == pytest.approx(want[r.k, r.term], abs=1e-9) for r in got)


def test_null_positions_come_first_and_null_keys_are_left_out(spark):
    rows = [("a", None, "first one"), ("a", 0, "second"), ("a", 9000, None), ("a", 9001, "last"), (None, 0, "lost"), ("b", 0, None)]
    whole, rest = TF._split(TF.stored(TF.term_pieces(frame(spark, rows), "k", "pos", "text"), "term-pieces"), "k")
    got = {(r.k, r.term, r.tf) for r in TF._rows_of(whole, "k").unionByName(rest).collect()}
    assert got == {("a", t, 1) for t in ["first", "one", "second", "last", "first one", "one second", "second last"]}


def test_keys_that_are_numbers(spark):
    lines = frame(spark, made(6)).withColumn("k", F.substring("k", 2, 9).cast("long"))
    got = TF.relational_tfidf(lines, "k", "pos", "text")
    assert dict(got.dtypes) == {"k": "bigint", "term": "string", "weight": "double"}
    assert {(f"d{r.k}", r.term) for r in got.collect()} == set(weights(made(6), 10_000))
