"""sessionlens: session-level anomaly analytics as Spark DataFrame plans.

Layout
------
functions/  column expressions (masking, key extraction, id and label normalising)
sources/    readers, sinks, artifact store and keyed upsert
operators/  DataFrame -> DataFrame operators (sessions, ranks, split, TF-IDF,
            evaluation, models, autoencoder)
plans/      end-to-end jobs: offline training, batch scoring, rank ensemble
streaming/  Structured Streaming twins of the batch operators
"""

__version__ = "0.1.0"
