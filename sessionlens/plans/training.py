"""E1 from raw session lines: sessions and term counts -> TF-IDF features fit on the
training part -> detectors; E2 scores new sessions with the same artifacts. No row holds the text
of a session."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import first_present, normalize_id
from ..operators import sessions as S
from ..operators import tfidf as TF
from ..operators.split import apply_split, decide_cut
from ..session import stored
from ..sources import storage as ST
from .detector import Detectors, train_detectors

SVD_K = 256   # fixed value of the source


@dataclass
class SessionTable:
    """``sessions``: session_id, timestamp, label, n_events, duration_sec; ``terms``: session_id, term, tf. Both are stored."""

    sessions: DataFrame
    terms: DataFrame


def session_table(sessions: DataFrame, lines: DataFrame, key: str, order: Sequence[str],
                  text_col: str | None = None) -> SessionTable:
    """J2-J4 / P13 / P14 and F2, F3. Without ``text_col`` the first present of the known text
    columns is used (P9)."""
    f = S.session_features(sessions, lines, key, order, None)
    if "label" not in f.columns:
        f = f.withColumn("label", F.lit(0))
    own = lines.withColumn(key, normalize_id(key))
    terms = TF.line_terms(own, key, order[0], text_col or first_present(lines), ties=order[1:])
    return SessionTable(stored(f, "sessions"), stored(TF.term_counts(terms, key).withColumnRenamed(key, "session_id"), "term-counts"))


@dataclass
class LogModel:
    vectoriser: TF.Vectoriser
    detectors: Detectors

    def features(self, table: SessionTable) -> DataFrame:
        return self.vectoriser.transform(table.sessions, table.terms)

    def score(self, table: SessionTable) -> DataFrame:
        return self.detectors.score(self.features(table))

    def save(self, path: str) -> None:
        self.vectoriser.terms.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.detectors.save(f"{path}/plan")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LogModel:
        if not ST.exists(spark, f"{path}/vocabulary"):
            raise FileNotFoundError(f"missing artifacts ['vocabulary'] under {path}")
        terms = spark.read.parquet(f"{path}/vocabulary")
        return LogModel(TF.Vectoriser(terms, terms.count()), Detectors.load(f"{path}/plan"))


def train_from_logs(table: SessionTable, svd_k: int = SVD_K, **detector_kw) -> tuple[LogModel, DataFrame]:
    """Fit the vocabulary on the training part only, then every detector on all of its columns: trees and SVD
    read them sparse, the autoencoder reads the SVD."""
    dec = decide_cut(table.sessions, "timestamp", "label", min_val_rows=detector_kw.get("min_val_rows", 1000),
                     min_val_pos=detector_kw.get("min_val_pos", 50))
    train = apply_split(table.sessions, dec.cut_us, "timestamp").where(F.col("split") == "train")
    vec = TF.fit_vectoriser(table.terms, train)
    det, val = train_detectors(vec.transform(table.sessions, table.terms), "timestamp", "session_id", svd_k=svd_k, **detector_kw)
    return LogModel(vec, det), val
