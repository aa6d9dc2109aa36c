"""From raw documents to a training mixture, in five stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again for the next one. All but the last return the columns of ``docs``. A stage works on all rows
that the one before it has kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlens.llm.common import stored, table
from sessionlens.llm.decontaminate import decontaminate
from sessionlens.llm.jaccard import drop_copies
from sessionlens.llm.langid import UND, learn_from, predict_languages
from sessionlens.llm.mixing import mix
from sessionlens.llm.pii import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a missing lang is filled with the prediction."""
    told = predict_languages(docs, learn_from(docs), names=("__lang", "__score")).filter(F.col("__lang") != UND)
    return told.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the smallest id."""
    return drop_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each epoch that takes a document."""
    return mix(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("mixing", mixing)]

#: MinHash, the language model and the bootstrapped patterns have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
