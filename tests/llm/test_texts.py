"""Operators over documents against brute force, and their defined cases."""

import base64
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from sessionlens.llm import (
    decontaminate,
    jaccard,
    langid,
    mixing,
    pii,
    quality,
    repeats,
    runindex,
    shingles,
    tokens,
)

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, n string, rep long"


def prose(seed, n, words=400):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(words)]
    return " ".join(r.choice(vocabulary) for _ in range(n))


def odd_rows():
    """Nulls in any column, an empty and a long text, ties, repeated rows, clashing names."""
    long = " ".join(f"word{i % 97} and {i}" for i in range(20_000))
    rows = [(1, None, None, None, None), (2, "", "en", "src1", 0), (3, long, "en", None, 1), (4, long, "en", "src1", 1), (None, prose(1, 80), "en", "src1", 5),
            (5, prose(1, 80), None, "src2", 5), (5, prose(1, 80), None, "src2", 5), (6, "\x01\x02 \t\r", "en", "src1", 5), (7, "one", "fr", "src1", 3),
            (8, "𝒜é " * 30 + "a.b@c.de", "fr", "src9", 3), (None, None, None, None, None)]
    return [(*r, 0.5, "x", "y", 9) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# repeats

def test_matching_statistics_equal_brute_force():
    r = random.Random(3)
    length, gram = 20, 5
    side = length - gram
    for trial in range(120):
        letters = "ab" if trial % 2 else "abcd"
        base = [r.choice(letters) for _ in range(60)]
        rows = []
        for _ in range(r.randint(1, 14)):
            t = list(base)
            for _ in range(r.randint(0, 2)):
                t[r.randrange(60)] = r.choice(letters)
            a, right = r.randint(0, side), r.randint(0, side)
            rows.append((r.randint(0, 2), a, "".join(t)[20 - a:20 + gram + right].encode()))
        rows.sort(key=lambda x: x[0])
        group, left, segs = np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), [x[2] for x in rows]
        got = runindex.repeated_starts(group, runindex.aligned(segs, left, side, 2 * length - gram), side, 0, side, length, gram)

        def window(j, a, left=left, segs=segs):
            s = left[j] - a
            return segs[j][s:s + length] if s >= 0 and s + length <= len(segs[j]) else None

        for i in range(len(rows)):
            for a in range(side + 1):
                w = window(i, a)
                assert got[i, a] == (w is not None and any(window(j, a) == w for j in range(len(rows)) if j != i and group[j] == group[i]))


def repeat_corpus():
    passage = prose(7, 60)
    docs = [prose(i, 40 + i) for i in range(12)]
    docs += [prose(100 + i, 30) + " " + passage[i:] + " " + prose(200 + i, 30) for i in range(25)]
    docs += [docs[3], docs[3], "ab" * 400, "x" * 199, "x" * 200, "é" * 150, "", None, prose(5, 20) + docs[2] + prose(6, 20) + docs[2]]
    return docs


@pytest.mark.parametrize("bucket_rows", [repeats.BUCKET_ROWS, 3, 0])
def test_repeats_equal_brute_force(spark, bucket_rows):
    docs = repeat_corpus()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
           for r in repeats.remove_repeats(df, bucket_rows=bucket_rows).collect()}
    want = repeats.brute_force([(t or "").encode() for t in docs])
    assert [got[i] for i in range(len(docs))] == want


def test_a_hot_passage_keeps_the_windows_of_equal_segments(spark):
    # each closing, and each opening, stands in two documents only, beside a passage that all of them hold
    docs = [prose(900 + i, 40) + " " + prose(7, 60) + " " + prose(800 + i // 2, 15) for i in range(16)]
    docs += [prose(700 + i // 2, 15) + " " + prose(8, 60) + " " + prose(600 + i, 40) for i in range(16)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    want = repeats.brute_force([t.encode() for t in docs])
    for bucket_rows in (repeats.BUCKET_ROWS, 0):
        got = {r.doc_id: (r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
               for r in repeats.remove_repeats(df, bucket_rows=bucket_rows).collect()}
        assert [got[i] for i in range(len(docs))] == want


@pytest.mark.parametrize("text", [prose(1, 900), "ab" * 700, "x" * 900, prose(2, 30) * 8, "abc" * 66 + prose(3, 90) + "abc" * 99])
def test_each_window_has_one_anchor(text, monkeypatch):
    import pyarrow as pa

    data, length, gram = np.frombuffer(text.encode(), np.uint8), 200, 50
    pos, h, lo, hi = runindex.anchors(data, np.array([len(data)]), length, gram)
    windows = sorted(p - a for p, x, y in zip(pos, lo, hi, strict=True) for a in range(x, y + 1))
    assert windows == list(range(len(data) - length + 1)) and (hi <= length - gram).all()
    anchor = {w: (g, p - w) for p, g, x, y in zip(pos, h, lo, hi, strict=True) for w in range(p - y, p - x + 1)}
    by_text = {}
    for w in windows:
        assert by_text.setdefault(text[w:w + length], anchor[w]) == anchor[w]
    # a long text is cut into pieces, with the same windows
    monkeypatch.setattr(repeats, "BATCH_BYTES", 700)
    run, _ = repeats._anchor_rows(length, gram)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([data.tobytes()], pa.binary())], names=["t1", "t2", "b"])
    rows = [r for p in run(iter([batch])) for r in p.to_pylist()]
    assert sorted(r["pos"] - a for r in rows for a in range(r["lo"], r["hi"] + 1)) == windows
    for r in rows:
        assert all(anchor[r["pos"] - a] == (np.int64(r["g"]).view(np.uint64), a) for a in range(r["lo"], r["hi"] + 1))


def test_repeats_defined_cases(odd, empty):
    rows = repeats.remove_repeats(odd).collect()
    assert len(rows) == odd.count() and repeats.remove_repeats(empty).count() == 0
    by = {(r.doc_id, r.n_bytes): r for r in rows}
    assert by[1, 0].n_removed == 0 and by[3, rows and by[3, next(k[1] for k in by if k[0] == 3)].n_bytes].n_spans == 1
    assert all(r.n_removed == r.n_bytes for r in rows if r.doc_id in (3, 4, 5))


# Jaccard join

def near_corpus():
    r = random.Random(9)
    docs = []
    for i in range(30):
        w = prose(i, 60 + 5 * i).split()
        docs.append(" ".join(w))
        for _ in range(i % 4):
            v = list(w)
            for _ in range(r.randint(0, 3)):
                v[r.randrange(len(v))] = "new" + str(r.randint(0, 99))
            docs.append(" ".join(v))
    base = prose(500, 90).split()
    for i in range(40):
        v = list(base)
        v[i], v[(7 * i) % 90] = "q", "z"
        docs.append("  ".join(v))
    return docs + ["a b c", "a  b c", "a b", "", None, " \n"]


def brute_classes(docs):
    sets = {}
    for i, t in enumerate(docs):
        w = re.findall(WORD, t or "")
        sets[i] = frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = {i: set() for i in sets}
    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = sorted((find(i), find(j)))
                root[b] = a
                if sets[i] != sets[j]:
                    links[i].add(sets[j])
                    links[j].add(sets[i])
    return {i: (find(i), len(links[i])) for i in sets}


@pytest.mark.parametrize("block", [jaccard.BLOCK, 7])
def test_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = near_corpus()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_copies(df).collect()}
    assert got == brute_classes(docs)
    kept = sorted(r.doc_id for r in jaccard.drop_copies(df).collect())
    assert kept == sorted(i for i, (c, _) in brute_classes(docs).items() if c == i)


def test_pairs_of_small_and_large_units_agree(monkeypatch):
    r = np.random.default_rng(8)
    rows = []
    for node in range(12):
        tree, cross = int(r.integers(0, 4)), bool(node % 3 == 0)
        shared = r.integers(0, 3, (4, 2))
        for rep in range(int(r.integers(1, 30))):
            sig = np.where(r.random((4, 2)) < 0.8, shared, r.integers(0, 3, (4, 2))).astype(np.uint32)
            sig[tree] = shared[tree]
            rows.append((node, 0, int(cross), tree, int(r.integers(0, 2)) if cross else 0, rep, sig.tobytes()))
    f = jaccard.pd.DataFrame(rows, columns=["node", "i", "j", "tree", "b", "rep", "sig"])
    got = []
    for small in (1, 1000):
        monkeypatch.setattr(jaccard, "SMALL_UNIT", small)
        x, y, _ = jaccard._pairs(f, 4, 2)
        got.append(sorted(zip(x.tolist(), y.tolist(), strict=True)))
    want = []
    for i in range(len(f)):
        for j in range(i + 1, len(f)):
            a, b = rows[i], rows[j]
            if a[:3] == b[:3] and (a[1] == a[2] or a[4] != b[4]):
                s, t = (np.frombuffer(v[6], np.uint32).reshape(4, 2) for v in (a, b))
                if int((s == t).all(axis=1).argmax()) == a[3] and (s == t).sum() >= jaccard.LEAST_EQUAL * 8:
                    want.append((i, j))
    assert got[0] == got[1] == want


def test_prefix_reaches_the_recall():
    d = jaccard.prefix_length()
    assert 1 - (1 - 0.8 ** d) ** jaccard.TREES >= jaccard.TARGET_RECALL > 1 - (1 - 0.8 ** (d + 1)) ** jaccard.TREES
    with pytest.raises(ValueError):
        jaccard.prefix_length(trees=2)


def test_signatures_agree_as_the_sets_do():
    r = np.random.default_rng(1)
    both, a, b = r.integers(0, 1 << 63, 800, np.uint64), r.integers(0, 1 << 63, 100, np.uint64), r.integers(0, 1 << 63, 100, np.uint64)
    s = jaccard.signatures_of([np.concatenate([both, a]), np.concatenate([both, b])], 400)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.08


def test_join_defined_cases(odd, empty):
    rows = jaccard.near_copies(odd).collect()
    assert len(rows) == odd.count() and jaccard.near_copies(empty).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[4].class_id == 3 and by[1].class_id == 1 and by[5].class_id == 5 and by[None].class_id is None
    kept = jaccard.drop_copies(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 5, 6, 7, 8]


def test_shingles_equal_tuples():
    texts = ["a b c d e f", "a  b\tc\nd e f", "f e d c b a", "a b", "", None]
    s = shingles.shingle_sets(texts)
    assert [len(x) for x in s] == [2, 2, 2, 1, 0, 0] and (s[0] == s[1]).all() and not set(s[0]) & set(s[2])


# language

def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_close_languages_are_told_apart_within_their_family(spark):
    r = random.Random(2)
    parts = {"de": "sch ein und zen", "nl": "sch een en zij", "es": "ción que los ado", "ru": "ого что при ста", "xx": "qq zz xqx zqz"}
    rows = [(k * 100 + i, " ".join(r.choice(v.split()) + r.choice(v.split()) for _ in range(40)), lang)
            for k, (lang, v) in enumerate(parts.items()) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(df)
    assert set(model.pairs) == {("de", "nl")} and len(model.families) == 6
    got = langid.predict_languages(df, model).collect()
    assert np.mean([g.lang == g.lang_pred for g in got]) > 0.99
    assert model.predict([None, "", "12 !?", "𝒜"])[0][:3] == ["und"] * 3


def test_language_defined_cases(odd, empty):
    model = langid.learn_from(odd)
    rows = langid.predict_languages(odd, model, names=("p", "q")).collect()
    assert {r.p for r in rows if not re.search(r"[^\W\d_]", r.text or "")} == {"und"} and len(rows) == odd.count()
    assert {r.score for r in rows} == {0.5}  # a column of the input
    none = langid.learn_from(empty)
    assert none.languages == [] and langid.predict_languages(odd, none).filter("lang_pred <> 'und'").count() == 0
    only = langid.LanguageModel(["en"]).predict(["abc"])
    assert only[0] == ["en"] and abs(only[1][0] - 1) < 1e-9


# quality

def test_rule_order_is_by_rejection_per_cost():
    rules = (quality.Rule("a", "x", 2.0, 0.2), quality.Rule("b", "x", 0.1, 0.1), quality.Rule("c", "x", 0.1, 0.0))
    assert [r.name for r in sorted(rules, key=lambda r: -r.rank)] == ["b", "a", "c"]


def test_cascade_stops_at_the_first_rule(spark):
    df = spark.createDataFrame([("a b",), ("a b c d",)], "text string").withColumn("n_words", quality.F.size(quality.words(quality.F.col("text"))))
    rules = [quality.Rule("short", "n_words < 3"), quality.Rule("never", "CASE WHEN n_words < 3 THEN raise_error('late') ELSE false END")]
    assert [r[0] for r in df.select(quality.cascade(rules)).collect()] == ["short", None]
    got = quality.measured(df, (quality.Rule("none", "false"), quality.Rule("half", "n_words < 3")))
    assert [(r.name, r.rejected) for r in got] == [("half", 0.5), ("none", 0.0)]


def test_quality_defined_cases(odd, empty):
    rows = quality.judge(odd).collect()
    assert len(rows) == odd.count() and quality.judge(empty).count() == 0
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, 6, 7))
    assert next(r for r in rows if r.doc_id == 3).n_words == 60_000


# decontamination

ITEM = "Anna has 12 apples and gives Bob 3 kg of them, then 12 more; how many are left for Anna today?"


def test_reparameterised_questions_are_caught(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (4, ITEM)], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Intro text. " + ITEM + " Done"),
        (2, "Well. Anna has 7 apples and gives Dora Smith 4.5 lb of them, then 7 more; how many are left for Anna today? ok"),
        (3, "Well. Anna has 7 apples and gives Dora 4 lb of them, then 9 more; how many are left for Eve today? ok"),
        (4, None), (5, ""), (6, "Anna has 12 apples and gives Bob nothing at all, which is sad for all of them today."), (7, "too short")],
        "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {1, 2, 7} and got[1].verbatim and not got[2].verbatim and got[1].item_id == 1 and got[7].item_id == 2
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [3, 4, 5, 6]


def test_names_that_begin_a_sentence(spark):
    item = "{0} has {1} apples. {0} buys {2} more at the shop. {0} eats {1} of them. How many apples does {0} have left?"
    bench = spark.createDataFrame([(1, item.format("Tom", 3, 5)), (2, item.format("Ida", 8, 9))], "item_id long, text string")
    rows = {1: item.format("Anna", 6, 11), 2: item.format("Tom", 6, 11), 3: item.format("Ida", 8, 9), 4: item.format("Anna", 6, 11).replace("Anna eats 6", "Eve eats 2"),
            5: "Who. " + item.format("Tom", 3, 5) + " What?", 6: "The shop has many apples. It buys some of them. How many does it have left?"}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.item_id, r.verbatim) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {1: (1, False), 2: (1, False), 3: (2, True), 5: (1, True)}


def test_short_items_are_matched_whole(spark):
    bench = spark.createDataFrame([(1, "What is 12 + 30?"), (2, "How many continents exist?"), (3, "Yes. Why?"), (4, "?!"), (5, "1 + 2 + 3 + 4 + 5 + 6")], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, "Well. What is 12 + 30? It is 42."), (2, "how many continents exist"), (3, "I know how many continents exist. What is 12 + 31?"), (4, "So\nwhat is 12 30\nok"),
        (5, "He said yes. Why? Well. Yes. Why? Ok"), (6, "yes, why"), (7, "?!"), (8, None), (9, "A. 1+2+3+4+5+6"), (10, "What is 12 + 30 + 4?")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 1), (2, 2), (4, 1), (5, 3), (9, 5)}


def test_items_of_one_template_are_a_class(spark):
    """300 documents and 300 items of one template give a row for each document."""
    text = "Sam has {0} red apples and gives {1} of them to Bob, then buys {0} green ones; how many are left today?"
    bench = spark.createDataFrame([(i, text.format(i + 10, i + 400)) for i in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(i, "Well. " + text.format(i + 200, i + 590)) for i in range(300)], "doc_id long, text string")
    rows = decontaminate.leaks(docs, bench).collect()
    assert len(rows) == 300 and {(r.doc_id, r.item_id) for r in rows if r.verbatim} == {(i, i + 190) for i in range(110)}
    assert {r.item_id for r in rows if not r.verbatim} == {0}


def test_each_place_of_an_item_is_judged(spark):
    other = "Anna has 7 apples and gives Dora 4 lb of them, then 9 more; how many are left for Eve today? "
    words = ITEM.split()
    docs = spark.createDataFrame([
        (1, "Well. " + other + ITEM), (2, "Well. " + ITEM + " " + other), (3, "Well. " + other + "And so. " + other),
        (4, "So it has 12 apples and gives nothing, then 12 more. " + prose(1, 50) + ". " + other + prose(2, 70) + ". " + ITEM + " " + other),
        # the item in pieces that lie far from each other, and with words put in
        (5, (" " + prose(3, 60) + " ").join(" ".join(words[i:i + 7]) for i in range(0, len(words), 3))),
        (6, "Well. " + ITEM.replace("apples and", "apples from the old tree and")),
        (7, "Well. " + other), (7, "Well. " + ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    got = {r.doc_id: r.verbatim for r in decontaminate.leaks(docs, bench, similarity=0.7).collect()}
    assert got == {1: True, 2: True, 4: True, 6: True, 7: True}


def test_leaks_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    items = {i: re.findall(r"\w+", t.lower()) for i, t in duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()}
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    want = {}
    for d, t in docs:
        w = " ".join(re.findall(r"\w+", t.lower()))
        hit = [i for i, x in items.items() if " ".join(x) in w]
        if hit:
            want[d] = hit
    got = {r.doc_id: [int(x) for x in r["items"].split(",")] for r in decontaminate.op6_template_decontamination(spark, sf).filter("contaminated").collect()}
    assert want and got == want


def test_what_grows_with_the_documents_is_not_broadcast(spark, monkeypatch):
    """Tables of hits are small as Parquet and large in the driver's memory: their joins shuffle, however few bytes the planner sees."""
    item = "A train leaves Boston at 40 miles per hour and arrives in Denver after 12 hours. How far apart are the two cities?"
    docs = spark.createDataFrame([(i, f"Intro {i}. {item} The end.") for i in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    plans, stored = {}, decontaminate.stored

    def watched(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(decontaminate, "stored", watched)
    monkeypatch.setattr(decontaminate, "BROADCAST_TEXTS", 5)
    assert sorted(r.doc_id for r in decontaminate.leaks(docs, bench).select("doc_id").distinct().collect()) == list(range(20))
    for name in ("decon-candidates", "decon-chosen"):
        assert "SortMergeJoin" in plans[name] and "BroadcastHashJoin" not in plans[name]
    assert plans["decon-values"].count("BroadcastHashJoin") == 1  # the benchmark's values
    kept = decontaminate.decontaminate(docs, bench)
    assert "BroadcastHashJoin" not in kept._jdf.queryExecution().executedPlan().toString() and kept.count() == 0


def test_decontamination_defined_cases(odd, empty, spark):
    bench = spark.createDataFrame([(1, ITEM), (None, ITEM), (2, "")], "item_id long, text string")
    assert decontaminate.decontaminate(odd, bench).count() == odd.count()
    assert decontaminate.decontaminate(odd, bench).columns == odd.columns
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0


# personal data

def brute_pii(text):
    t, out = text or "", []
    digits = lambda v: re.sub("[^0-9]", "", v)

    def luhn(v):
        return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(digits(v)))) % 10 == 0

    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 12 <= len(digits(v)) <= 19 and luhn(v)),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15)]
    for o, (k, p, ok) in enumerate(kinds):
        out += [(m.start(), o, m.end(), k) for m in re.finditer(p, t) if ok(m[0])]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def pii_texts():
    r = random.Random(4)
    bits = ["a.b@c.d", "_x@y.z_w@q.r.s", "@", "1.2.3.4", "10.0.0.255", "300.1.1.1", "1.2.3.4.5.6.7.8.9", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "0" * 25, "+1 (555) 123-4567", "+1", "+123456789012345678", "é", "𝒜", " ", "\n", ".", "-", "word", "000.000.000.0256", "4944339490429605"]
    return ["".join(r.choice(bits) + r.choice(["", " ", "."]) for _ in range(r.randint(0, 25))) for _ in range(400)] + [None, "", "1" * 30_000, "a" * 30_000 + "@"]


def test_base_spans_equal_brute_force(spark):
    texts = pii_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.s for r in pii.find_pii(df).select("doc_id", pii._joined(pii.F.col("base")).alias("s")).collect()}
    assert all(got[i] == brute_pii(t) for i, t in enumerate(texts))


def test_context_discovers_identifiers(spark):
    rows = [(i, f"hello there reach me: u{i}@x.com thanks") for i in range(40)]
    rows += [(100 + i, f"hello there reach me: usr{i % 4}-zz9988 ok") for i in range(6)]
    rows += [(200, "see usr1-zz9988, badge usr1-zz9988 number"), (201, "me: nothing abcd-efgh1 here")]
    got = {r.doc_id: r.s for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).filter("size(spans) > size(base)").select(
        "doc_id", pii._joined(pii.F.col("spans")).alias("s")).collect()}
    assert set(got) == {*range(100, 106), 200}  # found elsewhere too
    assert got[200] == "id:4:15,id:23:34" and got[100] == "id:22:33"


def test_context_goes_on_over_many_hops(spark):
    texts = []
    for k, c in enumerate("abcdef"):
        known = [f"u{j}@x.com" if k == 0 else f"idq{k - 1}{j}-xx77" for j in range(3)]
        texts += [f"some look{c} hint{c}: {v} ok" for v in known * 4 + [f"idq{k}{j}-xx77" for j in range(3)]]
    got = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all([s.kind for s in r.spans] == ["email" if "@" in r.text else "id"] for r in got)


def test_redaction_and_defined_cases(odd, empty, spark):
    df = spark.createDataFrame([(1, "Mail a.b@c.d.com or +1 (555) 123-4567 é 10.0.0.255"), (2, None), (3, "none")], "doc_id long, text string")
    assert [r.text for r in pii.redact(df).orderBy("doc_id").collect()] == ["Mail <EMAIL> or <PHONE> é <IP>", None, "none"]
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and pii.find_pii(empty).count() == 0
    assert next(r.text for r in out.collect() if r.doc_id == 8).endswith("<EMAIL>")


# tokens

def test_edits_equal_encoding_anew():
    count, r = tokens.Counter(), random.Random(5)
    bits = ["a", "b ", "'", " ", "  ", "\n", "s", "ll ", "re", "1", "23", "!", " word", "é", " \t", "don't ", "日本"]
    text = lambda sizes: "".join(r.choice(bits) for _ in range(r.choice(sizes)))
    for _ in range(400):
        now = text([0, 1, 5, 40, 400])
        tree = tokens.Tree.of(now, count)
        for _ in range(4):
            a = r.randint(0, len(now))
            now = tree.edit(now, a, min(len(now), a + r.choice([0, 0, 1, 3, 50, 300])), text([0, 1, 3, 200]), count)
            fresh = tokens.Tree.of(now, count)
            assert [x for s in tree.sizes for x in s] == [x for s in fresh.sizes for x in s] and tree.total == fresh.total
            for below, level in zip(tree.sums[:-1], tree.sums[1:], strict=True):
                assert (level == np.add.reduceat(below, np.arange(0, len(below), 2))).all()
        assert tree.total == len(count.encoding.encode_ordinary(now))


def test_an_edit_encodes_its_surroundings_only():
    count = tokens.Counter()
    text = prose(1, 5000)
    tree = tokens.Tree.of(text, count)
    before = count.encoded
    tree.edit(text, 9000, 9010, "changed", count)
    assert count.encoded - before < 12


def test_edited_counts(spark, odd, empty):
    docs = spark.createDataFrame([(1, "hello big world"), (2, None), (3, "left alone")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 6, 9, "small"), (1, 7, 8, "late"), (1, 99, 120, "!"), (2, 0, 5, "new text"), (9, 0, 1, "x"), (None, 0, 1, "y")],
                                  "doc_id long, start int, end int, put string")
    got = {r.doc_id: (r.n_tokens, r.n_edits, r.n_tokens_after) for r in tokens.edited_counts(docs, edits).collect()}
    n = lambda t: len(tokens._encoder(tokens.VOCABULARY).encode_ordinary(t))
    assert got == {1: (n("hello big world"), 2, n("hello small world!")), 2: (0, 1, n("new text")), 3: (n("left alone"), 0, n("left alone"))}
    rows = tokens.edited_arrays(odd.withColumn("edits", tokens.first_edits())).collect()
    assert len(rows) == odd.count() and tokens.edited_counts(empty, edits).count() == 0


def test_token_query_equals_whole_encoding(spark):
    sf = "/root/testdata/sf0.001"
    encode = tokens._encoder(tokens.VOCABULARY).encode_ordinary
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    for r in tokens.op7_edited_token_counts(spark, sf).collect():
        t, edits = docs[r.doc_id], []
        for pattern, put in tokens.EDITS:
            m = tokens.regex.search(pattern, t)
            if m:
                edits.append((m.start(), m.end(), put))
        out, done = "", 0
        for s, e, put in sorted(edits):
            if s >= done:
                out, done = out + t[done:s] + put, e
        assert (r.n_tokens, r.n_tokens_after) == (len(encode(t)), len(encode(out + t[done:])))


# mixing

def test_budgets_go_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "x", "1", 10), ("a", "x", "2", 100), ("a", "y", "3", 1000), ("b", "x", "4", 1000), ("b", "z", "5", 0)],
                                   "domain string, lang string, source string, tokens long")
    w = {"domain": {"a": 1.0, "b": 1.0}, "lang": {"x": 3.0, "y": 1.0}, "source": {"2": 2.0}}
    got = {r.source: r.budget for r in mixing.budgets(leaves, mixing.F.lit(600), w, max_epochs=1).collect()}
    # a gets 300: x can use 110 of its 225, y the rest; b's 300 stay with b
    assert got == {"1": 10, "2": 100, "3": 190, "4": 300, "5": 0}
    got = {r.source: r.budget for r in mixing.budgets(leaves, mixing.F.lit(2500), w, max_epochs=1).collect()}
    assert got == {"1": 10, "2": 100, "3": 1000, "4": 1000, "5": 0}


def test_a_leaf_gives_epochs_and_a_prefix(spark, odd, empty):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "en", "src0") for i in range(500)], "doc_id long, text string, lang string, source string")
    total = sum(1 + i % 7 for i in range(500))
    got = mixing.mix(df, share=2.25, max_epochs=5).collect()
    n = sum(r.n_tokens for r in got)
    assert 2.25 * total - 1 <= n < 2.25 * total + 7
    by = {}
    for r in got:
        by.setdefault(r.epoch, set()).add(r.doc_id)
    assert len(by[0]) == len(by[1]) == 500 > len(by[2])
    order = sorted(range(500), key=lambda i: hashlib.md5(f"{mixing.SEED}/2/{i}".encode()).hexdigest())
    assert by[2] == set(order[:len(by[2])])
    rows = mixing.mix(odd).collect()
    assert {r.domain for r in rows} <= {"d0", "d1", "d2", "d3"} and all(r.text for r in rows) and mixing.mix(empty).count() == 0
    assert mixing.mix(odd, share=0.0).count() == 0


# the format of a digest in a WARC header
def test_base32():
    from sessionlens.llm.warc import base32_sha1
    assert base32_sha1(hashlib.sha1(b"x").hexdigest()) == base64.b32encode(hashlib.sha1(b"x").digest()).decode()
