"""The registered model queries train with the source's settings."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from sessionlens.operators.boosting import Boosting
from sessionlens.plans import catalog as C


def test_model_queries_grow_all_trees_of_the_source(spark, tmp_path):
    rng = np.random.default_rng(2)
    n, width = 150, 20
    label = np.arange(n) % 5
    x = rng.normal(size=(n, width)) + (label == 0)[:, None] * 0.5
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "label": pa.array(label, pa.int32())}), tmp_path / "embeddings.parquet")
    det, _ = C.trained(spark, str(tmp_path))
    assert [len(m.trees) for m in det.gbt.models] == [4000] * 5
    assert max(len(t) for m in det.gbt.models for t in m.trees[:20]) > 1
    assert det.svd.V.shape == (width, width)  # 256, or as many as there are columns
    assert det.ae.P.shape == (width, 16)
    rows = C.QUERIES["stacker"](spark, str(tmp_path)).collect()
    assert len(rows) == n - sum(1 for r in C.embedding_features(spark, str(tmp_path)).collect() if r.timestamp < det.cut_us)


def test_settings_are_the_sources():
    s = C.MODEL_QUERY
    assert (s["svd_k"], s["bottleneck"], s["folds"], s["min_val_rows"], s["min_val_pos"]) == (256, 16, 5, 1000, 50)
    t = s["trees"]
    assert t == Boosting() and (t.rounds, t.step, t.leaves, t.columns, t.l1, t.l2, t.min_rows, t.patience) == (4000, 0.03, 64, 0.8, 0.1, 0.1, 20, None)
