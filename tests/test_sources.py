"""Readers and sinks: text scan, CSV with schema, shard glob, fallback, sharded and
partitioned writes, metrics record; the ML featurizer against relational TF-IDF."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from sessionlens.functions import first_present, normalize_headers, require_columns
from sessionlens.operators import tfidf as TF
from sessionlens.sources import readers as R
from sessionlens.sources import sinks as W


def test_text_scan_drops_bad_bytes(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "log.txt")
    with open(p, "wb") as f:
        f.write(b"first blk_1 line\nbad \xff\xfe bytes blk_2\n\nlast\n")
    rows = R.read_text_lines(spark, p).orderBy("row_in_split").collect()
    assert [r.value for r in rows] == ["first blk_1 line", "bad  bytes blk_2", "", "last"]


def test_csv_schema_headers_and_shards(spark, tmpdir_path):
    for i in range(3):
        with open(os.path.join(tmpdir_path, f"part_{i:03d}.csv"), "w") as f:
            f.write(" Session_ID ,Log_Key,POS\n")
            f.write(f"blk_{i},key {i},{i}\n")
    df = R.read_shards(spark, os.path.join(tmpdir_path, "part_*.csv"))
    assert df.columns == ["session_id", "log_key", "pos"]
    assert df.count() == 3
    typed = R.read_csv(spark, os.path.join(tmpdir_path, "part_000.csv"), "session_id string, log_key string, pos long")
    assert typed.schema["pos"].dataType.simpleString() == "bigint"
    with pytest.raises(FileNotFoundError):
        R.read_shards(spark, os.path.join(tmpdir_path, "nothing_*.csv"))
    df2 = R.read_first_existing(spark, [os.path.join(tmpdir_path, "missing.csv"),
                                        os.path.join(tmpdir_path, "part_001.csv")], fmt="csv")
    assert df2.count() == 1
    assert first_present(df, ["template_id", "log_key"]) == "log_key"
    with pytest.raises(ValueError):
        require_columns(df, ["timestamp"])
    assert normalize_headers(spark.createDataFrame([(1,)], "` A `int")).columns == ["a"]


def test_sharded_and_partitioned_writes(spark, tmpdir_path):
    df = spark.range(0, 2500).withColumn("t", F.col("id") * 3)
    out = os.path.join(tmpdir_path, "sharded")
    W.write_sharded(df.repartition(1), out, fmt="parquet", rows_per_file=1000)
    assert len(glob.glob(os.path.join(out, "*.parquet"))) == 3
    parts = os.path.join(tmpdir_path, "parts")
    W.write_parts(df, parts, ["t"], rows_per_part=1000)
    back = spark.read.parquet(parts)
    sizes = {r.part: r["count"] for r in back.groupBy("part").count().collect()}
    assert sizes == {0: 1000, 1: 1000, 2: 500}
    assert back.where("part = 0").agg(F.max("t")).collect()[0][0] < back.where("part = 1").agg(F.min("t")).collect()[0][0]
    m = W.write_metrics(spark, {"ROC_AUC": 0.9, "thr": 0.4}, os.path.join(tmpdir_path, "metrics"))
    assert m.collect()[0]["ROC_AUC"] == 0.9


def test_featurizer_equals_relational_tfidf(spark):
    docs = [("a", "the cat sat", "x"), ("a", "on the mat", "y"), ("b", "the cat ran", "x"), ("c", "a mat", "z"),
            ("c", "the dog", "w")]
    lines = spark.createDataFrame([(k, i, t) for i, (k, t, _) in enumerate(docs)], "k string, pos long, text string")
    rel = {(r.k, r.term): r.weight for r in TF.relational_tfidf(lines, "k", "pos", "text").collect()}
    from sessionlens.operators.sessions import session_documents
    d = session_documents(lines, "k", ["pos"], "text").withColumn("n_events", F.col("n_events").cast("double")) \
        .withColumn("duration_sec", F.lit(0.0))
    model = TF.fit_featurizer(d, "doc")
    vocab = TF.vocabulary_terms(model)
    out = model.transform(d).collect()
    ml = {}
    for r in out:
        v = r.features.toArray()[: len(vocab)]
        for i, w in enumerate(v):
            if w != 0:
                ml[(r.k, vocab[i])] = w
    assert rel.keys() == ml.keys()
    for k in rel:
        assert rel[k] == pytest.approx(ml[k], abs=1e-9)
