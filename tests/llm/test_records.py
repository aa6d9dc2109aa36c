"""WARC round trips, preference formatting, the pipeline, and the SQL of the queries."""

import hashlib
import random

import duckdb
import pytest

from sessionlens.llm import preferences, warc
from sessionlens.llm.queries import QUERIES, SQL
from tools.oracle_check import TABLES, rows_of

PAGES = "page_id long, url string, html string, block string, record_id string"


def pages():
    r = random.Random(1)
    big = "".join(r.choice("abc é\r\n𝒜<>") for _ in range(70_000))
    rows = [(3, "http://a/ b\r\nX: y", big), (1, None, big), (2, "http://c", None), (9, "http://d", ""), (None, "http://e", "same"), (7, "http://f", "same"),
            (5, "http://g", "same"), (5, "http://g", "same"), (11, "http://h", "WARC/1.1\r\n\r\n0\r\n\r\n"), (2 ** 60 + 1, "http://i", "x" * 4096)]
    return [(*x, "clash", "clash") for x in rows]


@pytest.mark.parametrize("segment,chunk", [(warc.SEGMENT_BYTES, warc.CHUNK_BYTES), (64, 7), (10 ** 9, 1)])
def test_pages_survive_the_round_trip(spark, tmpdir_path, segment, chunk):
    df = spark.createDataFrame(pages(), PAGES).repartition(3)
    path = f"{tmpdir_path}/w-{segment}"
    warc.write_warc(df, path, segment_bytes=segment, chunk_bytes=chunk, records_per_file=4)
    out = warc.read_warc(spark, path).collect()
    assert len(out) == len(pages()) and all(r.verified for r in out)
    by = {}
    for r in out:
        by.setdefault(r.page_id, []).append(r)
    for page_id, _, html, *_ in pages():
        r = by[page_id][0]
        data = (html or "").encode()
        assert r.payload_bytes == len(data) and r.payload_digest == warc.base32_sha1(hashlib.sha1(data).hexdigest())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == data
    kinds = {k: (v[0].record_type, v[0].refers_to) for k, v in by.items()}
    assert kinds[1] == ("response", None) and kinds[3] == ("revisit", 1) and kinds[7] == ("revisit", 5) and kinds[None] == ("response", None)
    assert kinds[2] == ("response", None) and kinds[9] == ("revisit", 2) and [r.record_type for r in by[5]] == ["response"] * 2
    assert by[2 ** 60 + 1][0].page_id == 2 ** 60 + 1 and by[3][0].url == "http://a/%20b%0D%0AX:%20y"
    assert by[1][0].n_segments == (1 if segment > 10 ** 8 else max(r.n_segments for r in out))


def test_small_payloads_are_all_responses(spark, tmpdir_path):
    warc.write_warc(spark.createDataFrame(pages(), PAGES), f"{tmpdir_path}/m", min_bytes=5)
    kinds = {r.page_id: r.record_type for r in warc.read_warc(spark, f"{tmpdir_path}/m").collect()}
    assert kinds[3] == "revisit" and kinds[7] == kinds[9] == "response"


def test_no_pages(spark, tmpdir_path):
    warc.write_warc(spark.createDataFrame([], PAGES), f"{tmpdir_path}/none")
    assert warc.read_warc(spark, f"{tmpdir_path}/none").count() == 0


def test_a_missing_segment_is_noticed(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "http://a", "x" * 1000, "", "")], PAGES)
    warc.write_warc(df, f"{tmpdir_path}/cut", segment_bytes=300)
    records = warc.read_records(spark, f"{tmpdir_path}/cut")
    assert records.count() == 4
    import gzip
    import os
    name = next(f"{tmpdir_path}/cut/{f}" for f in os.listdir(f"{tmpdir_path}/cut") if f.endswith(".gz"))
    parts = list(warc.parse_records(gzip.open(name).read()))
    kept = [warc._record([(k.upper(), v) for k, v in p.items() if k not in ("block", "content-length")], p["block"]) for p in (parts[3], parts[0], parts[1])]
    os.makedirs(f"{tmpdir_path}/short")
    with gzip.open(f"{tmpdir_path}/short/a.gz", "wb") as f:
        f.write(b"".join(k + b"\r\n\r\n" for k in kept))
    (row,) = warc.read_warc(spark, f"{tmpdir_path}/short").collect()
    assert not row.verified and row.payload is None and row.page_id == 1


def foreign(n, folded=False):
    body = f"HTTP/1.1 200 OK\r\nContent-Type:text/html\r\n\r\npage {n}".encode()
    digest = warc.base32_sha1(hashlib.sha1(f"page {n}".encode()).hexdigest())
    uri = f"WARC-Target-URI: http://x/{n}\r\n /more" if folded else f"warc-target-uri:http://x/{n}"
    return f"WARC/1.0\r\nWARC-Type: response\r\n{uri}\r\nWARC-Record-ID: <urn:uuid:{n}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length:{len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


INFO = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:i>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def test_archives_of_others(spark, tmpdir_path):
    """A gzip member for each record, no compression, headers without blanks, folded ones, padding."""
    import gzip
    import os
    os.makedirs(f"{tmpdir_path}/others")
    with open(f"{tmpdir_path}/others/a.warc.gz", "wb") as f:
        f.write(b"".join(gzip.compress(x) for x in [INFO, *[foreign(n) for n in range(5)]]) + b"\x00" * 7)
    with open(f"{tmpdir_path}/others/b.warc", "wb") as f:
        f.write(INFO + foreign(10) + foreign(11, folded=True))
    with open(f"{tmpdir_path}/others/c.warc", "wb"):
        pass
    out = {r.url: r for r in warc.read_warc(spark, f"{tmpdir_path}/others").collect()}
    assert set(out) == {*[f"http://x/{n}" for n in [*range(5), 10]], "http://x/11 /more"} and all(r.verified and r.page_id is None for r in out.values())
    assert bytes(out["http://x/3"].payload) == b"page 3"
    assert warc.read_records(spark, f"{tmpdir_path}/others").filter("warc_type = 'warcinfo'").count() == 2


def test_cut_archives_are_errors():
    import gzip
    whole = gzip.compress(foreign(1)) + gzip.compress(foreign(2))
    assert len(list(warc.parse_records(warc.unzipped(whole)))) == 2
    for data in (whole[:-9], whole[:-1], gzip.compress(foreign(1)[:-1]), foreign(1)[:-2], foreign(1)[:40], foreign(1)[1:]):
        with pytest.raises(ValueError):
            list(warc.parse_records(warc.unzipped(data)))
    assert [len(r["block"]) for r in warc.parse_records(bytes([b]) for b in foreign(4))] == [len(foreign(4)) - foreign(4).index(b"HTTP") - 4]


def test_framing():
    for size in (1, 3, 100):
        assert warc.dechunked(warc.chunked(b"hello\r\nworld", size)) == b"hello\r\nworld"
    for bad in (b"5\r\nhel", b"5\r\nhelloXX0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)


# preferences

def side(*turns):
    return [{"role": r, "text": t} for r, t in turns]


def test_prefix_and_masks(spark):
    a = side(("user", "hi"), ("assistant", "héllo"), ("user", "more"), ("assistant", "yes"))
    b = side(("user", "hi"), ("assistant", "héllo"), ("user", "other"), ("assistant", "no <|im_end|>"), ("system", "x"))
    schema = "id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    rows = {r.id: r for r in preferences.format_pairs(spark.createDataFrame([(1, a, b), (2, a, a), (3, a, None), (4, None, None), (5, a[:2], a)], schema)).collect()}
    r = rows[1]
    assert r.n_prefix == 2 and r.usable and r.prompt == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nhéllo<|im_end|>\n"
    assert [r.chosen[s.start:s.end] for s in r.chosen_spans] == ["yes<|im_end|>"]
    assert [r.rejected[s.start:s.end] for s in r.rejected_spans] == ["no < |im_end|><|im_end|>"]
    assert rows[2].n_prefix == 4 and rows[2].chosen == rows[2].rejected == "" and not rows[2].usable
    assert rows[3].n_prefix == 0 and rows[3].rejected == "" and rows[4].prompt == "" and rows[5].n_prefix == 2 and rows[5].chosen == ""


def test_pairs_of_a_common_opening(spark, monkeypatch):
    monkeypatch.setattr(preferences, "BLOCK", 4)
    rows = [(i, 0, "user", "same") for i in range(21)] + [(i, 1, "assistant", f"a{i}") for i in range(21)]
    rows += [(30, 0, "user", "alone"), (30, 1, "assistant", "x"), (31, 0, "user", "solo"), (31, 1, "assistant", "y"), (40, 0, "user", "no answer"),
             (None, 0, "user", "lost"), (50, None, None, None), (30, 1, "assistant", "x")]
    got = {r.conv_id: r for r in preferences.pairs_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(i, got[i].rejected_id) for i in range(0, 20, 2)] == [(i, i + 1) for i in range(0, 20, 2)]
    assert got[20].how == "alone" and got[30].how == got[31].how == "swapped" and [t.text for t in got[30].rejected] == ["alone", "y"]
    assert got[40].how == "alone" and got[50].chosen[0].role == "unknown" and None not in got
    assert preferences.pairs_of(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# queries

@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    nulls = lambda f: f.astype(object).where(f.notna(), None)
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert rows_of(nulls(got.toPandas())) == rows_of(nulls(con.execute(SQL[name]).df()))


def test_a_query_for_each_operator():
    assert [int(q[2:].split("_")[0]) for q in QUERIES] == list(range(1, 14))


# pipeline

def test_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline
    from sessionlens.llm.common import stored

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    extra = [(10_001, "One " + item + " and more of it", "en", "src1", 1), (10_002, None, "en", "src1", 1), (10_003, "12 34 !?", "en", "src1", 1),
             (10_004, docs.filter("doc_id = 3").first().text, None, "src2", 1), (10_005, "Write to somebody.new@mail.example.com about " + item[::-1], None, "src3", 1)]
    now = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("score", docs.n_chars * 0 + 1)
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stored(stage(spark, now, sf), f"test-{name}")
        ids[name] = {r.doc_id: r for r in now.collect()}
        assert set(before.columns) <= set(now.columns)
        if name != "mixing":
            assert now.columns == before.columns
    assert {10_002, 10_003}.isdisjoint(ids["language_id"]) and 10_001 in ids["language_id"] and ids["language_id"][10_004].lang
    assert 10_004 not in ids["near_duplicates"] and 3 in ids["near_duplicates"] and 10_001 not in ids["decontamination"]
    assert ids["personal_data"][10_005].text.startswith("Write to <EMAIL> about ") and all(r.score == 1 for r in ids["mixing"].values())
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline

    now = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "/root/testdata/sf0.001")
    assert now.count() == 0
