"""Sessions: sessionize, labels, profiles, ordered session documents and numeric features.

All operators are plain ``DataFrame -> DataFrame`` functions. Wide work is one
``groupBy`` per key (partial + final hash aggregation, so a hot key is pre-combined
map-side) and at most one join per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (backfill_key, coalesce_cast, duration_seconds, label_to_int, normalize_id,
                         require_columns)
from .ordered import row_index

SESSION_COLUMNS = ("session_id", "block_id", "timestamp", "timestamp_start", "timestamp_end",
                   "n_events", "label")


# ---------------------------------------------------------------- A1 sessionize
def sessionize(events: DataFrame, key: str = "session_id", ts: str = "timestamp") -> DataFrame:
    """Group events by session key: first/last timestamp and event count.

    Rows with a null key are dropped (pandas groupby default). Output:
    session_id, block_id, timestamp (= start), timestamp_start, timestamp_end, n_events.
    """
    require_columns(events, [key, ts], "events")
    g = (events.where(F.col(key).isNotNull())
         .groupBy(F.col(key).cast("string").alias("session_id"))
         .agg(F.min(ts).alias("timestamp_start"), F.max(ts).alias("timestamp_end"),
              F.count(F.lit(1)).alias("n_events")))
    return g.select("session_id", F.col("session_id").alias("block_id"),
                    F.col("timestamp_start").alias("timestamp"), "timestamp_start", "timestamp_end",
                    "n_events")


# ---------------------------------------------------------------- A2 / J1 labels
def label_table(raw: DataFrame, id_col: str = "block_id", label_col: str = "label",
                header_ids: Sequence[str] = ("blockid", "block_id"), header_label: str = "label") -> DataFrame:
    """Raw label rows -> one row per normalised block id with max(label).

    Text labels map normal->0, anomaly->1, numeric 0/1 accepted, anything else 0.
    A header row read as data (id equal to the header name) is dropped.
    """
    is_header = normalize_id(F.col(id_col)).isin(*[h.lower() for h in header_ids]) & \
        (F.lower(F.trim(F.col(label_col).cast("string"))) == F.lit(header_label.lower()))
    lab = raw.where(~F.coalesce(is_header, F.lit(False))) \
        .select(normalize_id(F.col(id_col)).alias("block_id"), label_to_int(F.col(label_col)).alias("label"))
    return lab.groupBy("block_id").agg(F.max("label").alias("label"))


def attach_labels(sessions: DataFrame, labels: DataFrame) -> DataFrame:
    """sessions LEFT JOIN deduplicated labels on block_id; missing label -> 0.

    Sessions are not grouped again after their ids are normalised, as in the source, so
    spellings of one key stay sessions of their own here. An existing ``label`` column is
    replaced, never merged. ``labels`` must already be
    one row per block (``label_table``), so the join cannot fan out.
    """
    s = backfill_key(sessions)
    s = s.withColumn("block_id", normalize_id("block_id")).withColumn("session_id", normalize_id("session_id"))
    if "label" in s.columns:
        s = s.drop("label")
    out = s.join(labels.select("block_id", "label"), "block_id", "left") \
        .withColumn("label", coalesce_cast("label", 0, "int"))
    keep = [c for c in SESSION_COLUMNS if c in out.columns]
    return out.select(*keep)


# ---------------------------------------------------------------- A8-A11, W8 profiles
def label_counts(sessions: DataFrame) -> DataFrame:
    """Sessions per label value, most frequent first."""
    return sessions.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def uniqueness_profile(sessions: DataFrame) -> DataFrame:
    """Total rows, distinct session ids, duplicates."""
    return sessions.agg(F.count(F.lit(1)).alias("total_rows"),
                        F.count_distinct("session_id").alias("unique_sessions")) \
        .withColumn("duplicate_rows", F.col("total_rows") - F.col("unique_sessions"))


def block_profile(sessions: DataFrame) -> DataFrame:
    """A10: distinct blocks, average and max sessions per block (two-level groupBy)."""
    per = sessions.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("unique_blocks"),
                   F.avg("n").alias("avg_sessions_per_block"),
                   F.max("n").alias("max_sessions_per_block"))


def anomaly_profile(sessions: DataFrame) -> DataFrame:
    """Anomaly sessions, anomaly blocks, total labels and anomaly rate."""
    return sessions.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(F.col("label") == 1).alias("anomaly_sessions"),
        F.count_distinct(F.when(F.col("label") == 1, F.col("block_id"))).alias("anomaly_blocks"),
        F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("total_anomaly_labels"),
    ).withColumn("anomaly_rate", F.col("total_anomaly_labels") / F.greatest(F.col("sessions"), F.lit(1)))


def duplicate_sessions(sessions: DataFrame, limit: int | None = 10) -> DataFrame:
    """Every member of a duplicated session id (keep=False), sorted; first ``limit``.

    Duplicated ids come from a count per id joined back (no window over a hot key). Rows are
    ordered by the id and then by all columns, so that which rows a limit keeps is defined.
    """
    dup = sessions.groupBy("session_id").agg(F.count(F.lit(1)).alias("dup_count")).where("dup_count > 1")
    out = sessions.join(dup, "session_id", "left_semi").orderBy("session_id", *[c for c in sessions.columns if c != "session_id"])
    return out.limit(limit) if limit else out


# ---------------------------------------------------------------- A3-A5 ordered documents
def _order_struct(order: Sequence[str], text_col: str):
    return F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(text_col).alias("_t"))


def session_documents(lines: DataFrame, key: str, order: Sequence[str], text_col: str,
                      chunk_col: str | None = None, chunk_size: int = 4096, trim: bool = True) -> DataFrame:
    """A3-A5: per session the document (texts joined by one space in ``order``), the
    line count and the first/last value of the first order column.

    ``order`` must make the order total (add a tie-break column). Two-level concat:
    lines are first joined inside chunks of ``chunk_size`` consecutive ``chunk_col``
    values (bounded sort per group even for a hot session), then chunk strings are
    joined per session in chunk order. Times don't tell how many lines lie between them, so in time
    order lines are numbered first (``row_index``) and chunks are cut by that number.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    if trim:
        t = F.regexp_replace(t, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    df = lines.where(F.col(key).isNotNull()).withColumn("_text", t)
    if not order:
        raise ValueError("an explicit total order (position or timestamp, plus a tie-break) is required")
    first = order[0]
    cc = chunk_col or first
    if dict(df.dtypes)[cc].startswith("timestamp"):
        df = row_index(df.select(key, *order, "_text"), [key, *order], "_place")
        cc = "_place"
    df = df.withColumn("_chunk", F.floor(F.col(cc) / F.lit(chunk_size)))
    part = (df.groupBy(key, "_chunk")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(_order_struct(order, "_text"))),
                                          lambda x: x["_t"]), " ").alias("_part"),
                 F.count(F.lit(1)).alias("_n"), F.min(first).alias("_first"), F.max(first).alias("_last")))
    doc = (part.groupBy(key)
           .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_chunk", "_part"))),
                                         lambda x: x["_part"]), " ").alias("doc"),
                F.sum("_n").alias("n_events"), F.min("_first").alias("first_order"),
                F.max("_last").alias("last_order")))
    return doc


def session_counts(lines: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """A4, A5: per session the line count and the first/last value of the first order column."""
    first = order[0]
    return lines.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_events"), F.min(first).alias("first_order"), F.max(first).alias("last_order"))


def session_features(sessions: DataFrame, lines: DataFrame, key: str, order: Sequence[str],
                     text_col: str | None) -> DataFrame:
    """Sessions LEFT (document, event count) from one groupBy of the lines; without
    ``text_col`` no document is built.

    The count from the lines wins over any count already on the session row; missing
    document -> '', missing count -> 0. duration_sec = end - start of the session row,
    else the line span when the lines carry timestamps, else 0.
    """
    # keys are normalised before they are grouped: spellings of one key are one session
    lines = lines.withColumn(key, normalize_id(key))
    docs = session_documents(lines, key, order, text_col) if text_col else session_counts(lines, key, order)
    docs = docs.withColumnRenamed(key, "session_id")
    s = sessions.withColumn("session_id", normalize_id("session_id"))
    s = s.drop("n_events", "doc")
    out = s.join(docs, "session_id", "left")
    out = out.withColumn("n_events", coalesce_cast("n_events", 0, "long"))
    if text_col:
        out = out.withColumn("doc", F.coalesce("doc", F.lit("")))
    if {"timestamp_start", "timestamp_end"} <= set(s.columns):
        dur = duration_seconds("timestamp_start", "timestamp_end")
    elif dict(lines.dtypes).get(order[0], "").startswith("timestamp"):
        dur = duration_seconds("first_order", "last_order")
    else:
        dur = F.lit(0.0)
    return out.withColumn("duration_sec", F.coalesce(dur, F.lit(0.0)).cast("double")) \
        .drop("first_order", "last_order")


# ---------------------------------------------------------------- gap sessions (ST3 batch twin)
def gap_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Inactivity sessions per key: a new session starts when the time since the
    previous event of the key is longer than the gap (the batch twin of the session stream).

    Output: key, window_start, window_end (= last event + gap), n_events.
    """
    e = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    g = e.groupBy(F.col(key), F.session_window(F.col(ts), f"{int(gap_seconds)} seconds").alias("_w")) \
        .agg(F.count(F.lit(1)).alias("n_events"))
    kind = dict(events.dtypes)[ts]
    return g.select(key, F.col("_w.start").cast(kind).alias("window_start"),
                    F.col("_w.end").cast(kind).alias("window_end"), "n_events")
