"""Structured Streaming operators.

ST1 live gauge      max score per (host, service), update mode, upserted per batch; with an
                    expiry, gone hosts leave it
ST2 parse stream    mask + key extraction on a text stream
ST3 session stream  inactivity sessions per key with a watermark (session_window)
ST4 alert rate      tumbling-window alert rate per service
ST5 score stream    saved detectors applied to a stream of feature rows, or to raw lines whose sessions
                    have closed, upserted per batch
ST6 late / dupes    watermark drop and dropDuplicatesWithinWatermark

Every builder takes a streaming DataFrame and returns one; ``start_*`` helpers wire
the sinks. Checkpoints go under the session's reliable checkpoint directory.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..functions import extract_key, mask_line, normalize_id
from ..functions.text import BLOCK_KEY_PATTERN, tokens
from ..plans.detector import Detectors
from ..plans.training import LogModel, SessionTable
from ..session import stored
from ..sources import upsert as UP


def parse_stream(lines: DataFrame, text_col: str = "value", pattern: str = BLOCK_KEY_PATTERN,
                 mask_first: bool = False) -> DataFrame:
    """ST2: (session_id, log_key) for every line that carries a key."""
    masked = mask_line(text_col)
    src = masked if mask_first else F.lower(F.col(text_col))
    return lines.select(extract_key(src, pattern).alias("session_id"), masked.alias("log_key")) \
        .where(F.col("session_id") != "")


def session_stream(events: DataFrame, key: str, ts: str, gap: str, watermark: str) -> DataFrame:
    """ST3: per key, sessions closed after ``gap`` of inactivity; emitted (append mode)
    once the watermark passes the session end."""
    return events.withWatermark(ts, watermark) \
        .groupBy(F.col(key), F.session_window(F.col(ts), gap).alias("w")) \
        .agg(F.count(F.lit(1)).alias("n_events")) \
        .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_events")


def alert_rate_stream(scored: DataFrame, ts: str = "timestamp", service: str = "service",
                      alert: str = "is_alert", window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """ST4: alert rate and count per service and tumbling window."""
    return scored.withWatermark(ts, watermark) \
        .groupBy(F.window(F.col(ts), window).alias("w"), F.col(service)) \
        .agg(F.avg(F.col(alert).cast("double")).alias("alert_rate"), F.count(F.lit(1)).alias("n")) \
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), service,
                "alert_rate", "n")


def gauge_stream(scores: DataFrame, score: str = "anomaly_score") -> DataFrame:
    """ST1: running max score per (host, service) (update mode)."""
    return scores.groupBy("host", "service").agg(F.max(score).alias("anomaly_score"))


def expiring_gauge_stream(scores: DataFrame, ts: str, ttl_seconds: int, watermark: str = "1 minute",
                          score: str = "anomaly_score") -> DataFrame:
    """ST1 with an end: the running max score per (host, service), and a row with ``gone`` once
    nothing has come for ``ttl_seconds`` of event time. The state of what is gone is dropped, so it holds
    as many keys as are alive; one that comes back starts anew."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"host": [key[0]], "service": [key[1]], "anomaly_score": [None], "gone": [True]})
            return
        best, last = state.get if state.exists else (None, 0)
        for f in frames:
            seen = f["s"].max()
            if seen == seen and seen is not None:
                best = float(seen) if best is None else max(best, float(seen))
            last = max(last, int(f["ms"].max()))
        state.update((best, last))
        state.setTimeoutTimestamp(max(last + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"host": [key[0]], "service": [key[1]], "anomaly_score": [best], "gone": [False]})

    rows = scores.withWatermark(ts, watermark).select("host", "service", F.col(score).cast("double").alias("s"), ts, F.unix_millis(F.col(ts)).alias("ms"))
    return rows.groupBy("host", "service").applyInPandasWithState(
        step, "host string, service string, anomaly_score double, gone boolean", "best double, last long", "update", "EventTimeTimeout")


def dedupe_stream(events: DataFrame, ts: str, id_cols: list[str], watermark: str) -> DataFrame:
    """ST6: rows later than the watermark are dropped; repeats of an id inside the
    watermark are delivered once."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(id_cols)


def score_stream(features: DataFrame, detectors: Detectors) -> DataFrame:
    """ST5: the saved detectors applied to a stream of session feature rows."""
    return detectors.score(features)


SESSION_ROWS = "session_id string, timestamp timestamp, n_events long, duration_sec double, terms array<string>, counts array<long>"


def session_rows_stream(lines: DataFrame, key: str, ts: str, text: str, order: Sequence[str], gap_seconds: int, watermark: str) -> DataFrame:
    """ST5, first half: raw lines -> one row per session that has been silent for ``gap_seconds`` of event
    time, with its term counts (F2, F3). A session's state is its counts and its last token: as many entries as it
    has distinct terms, none of its text. Lines of a session are put in ``order`` within a micro-batch; a later micro-batch's
    lines come after an earlier one's."""
    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, last, tail, held = state.get if state.exists else (0, None, None, None, "{}")
        if state.hasTimedOut:
            state.remove()
            counts = json.loads(held)
            yield pd.DataFrame({"session_id": [name[0]], "timestamp": [pd.Timestamp(first, unit="us")], "n_events": [n], "duration_sec": [(last - first) / 1e6],
                                "terms": [list(counts)], "counts": [list(counts.values())]})
            return
        counts = json.loads(held)
        rows = pd.concat(list(frames)).sort_values([f"_o{i}" for i in range(len(order))], kind="stable")
        for us, found in zip(rows["us"], rows["tok"], strict=True):
            n, first, last = n + 1, us if first is None else min(first, us), us if last is None else max(last, us)
            for token in found:
                for term in (token, f"{tail} {token}") if tail is not None else (token,):
                    counts[term] = counts.get(term, 0) + 1
                tail = token
        state.update((n, int(first), int(last), tail, json.dumps(counts)))
        state.setTimeoutTimestamp(max(int(last) // 1000 + gap_seconds * 1000, state.getCurrentWatermarkMs() + 1))

    rows = lines.withWatermark(ts, watermark).where(F.col(key).isNotNull() & F.col(ts).isNotNull()) \
        .select(normalize_id(key).alias("session_id"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], tokens(text).alias("tok"), ts, F.unix_micros(F.col(ts)).alias("us"))
    return rows.groupBy("session_id").applyInPandasWithState(step, SESSION_ROWS, "n long, first long, last long, tail string, terms string", "append", "EventTimeTimeout")


def start_alert_stream(lines: DataFrame, model: LogModel, target: str, name: str, key: str, ts: str, text: str, order: Sequence[str], gap_seconds: int, watermark: str,
                       checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """ST5 from raw lines to the keyed alert table: sessions that close are turned into feature rows, scored
    by the saved model and upserted. A replayed or restarted batch gives the same table."""
    def scored(batch: DataFrame) -> DataFrame:
        held = stored(batch, "closed-sessions")
        terms = held.select("session_id", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("session_id", F.col("t.terms").alias("term"), F.col("t.counts").alias("tf"))
        return model.score(SessionTable(held.drop("terms", "counts"), terms)).drop("z_out", "z_lat")

    closed = session_rows_stream(lines, key, ts, text, order, gap_seconds, watermark)
    return start_upsert_stream(closed, target, "session_id", name, "append", checkpoint, trigger, transform=scored)


def _ckpt(spark: SparkSession, name: str, checkpoint: str | None) -> str:
    """Where a stream's progress is kept: the same place at each start, so that a restarted
    stream goes on where it was."""
    if checkpoint:
        return checkpoint
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("give a checkpoint path, or set spark.checkpoint.dir to a shared folder")
    return f"{base.rstrip('/')}/stream-{name}"


def start_upsert_stream(df: DataFrame, target: str, key: str, name: str, output_mode: str = "update",
                        checkpoint: str | None = None, trigger: dict | None = None,
                        transform: Callable[[DataFrame], DataFrame] | None = None,
                        gone: str | None = None) -> StreamingQuery:
    """foreachBatch sink: each micro-batch (already one row per key, e.g. an aggregate in
    update mode) is upserted into the snapshot table at ``target``; a replayed batch
    gives the same table because the upsert is idempotent. Keys whose row says ``gone`` leave it."""
    spark = df.sparkSession

    def apply(batch: DataFrame, epoch: int) -> None:
        b = transform(batch) if transform else batch
        UP.upsert(b.sparkSession, target, b, key, gone=gone)

    w = df.writeStream.outputMode(output_mode).foreachBatch(apply) \
        .option("checkpointLocation", _ckpt(spark, name, checkpoint))
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def start_table_stream(df: DataFrame, path: str, name: str, output_mode: str = "append",
                       checkpoint: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Parquet file sink (append) with a reliable checkpoint (exactly-once files)."""
    spark = df.sparkSession
    w = df.writeStream.outputMode(output_mode).format("parquet").option("path", path) \
        .option("checkpointLocation", _ckpt(spark, name, checkpoint))
    return w.trigger(**(trigger or {"availableNow": True})).start()


def live_gauge(spark: SparkSession, source_dir: str, schema, target: str, every: str = "15 seconds",
               checkpoint: str | None = None) -> StreamingQuery:
    """ST1 end to end: scored chart rows arriving as files -> max per (host, service)
    -> keyed table, refreshed every ``every``."""
    src = spark.readStream.schema(schema).parquet(source_dir)
    return start_upsert_stream(gauge_stream(src), target, "host_service",
                               "gauge", "update", checkpoint, {"processingTime": every},
                               transform=lambda b: b.withColumn("host_service",
                                                                F.concat_ws("/", "host", "service")))


