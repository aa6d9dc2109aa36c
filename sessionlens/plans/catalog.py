"""Registered queries over the driver tables, each with its DuckDB oracle SQL.

Analogues (the driver data has no HDFS log): session key = ``events.user_id`` or
``conversations.conv_id``; position = ``conversations.turn`` / ``events.event_id``;
log text = ``documents.text`` split into lines, ``conversations.text``; label = an
error event with a large value in the session, or ``labels.toxic``.

Every query reads whole tables. Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract_key, mask_line
from ..operators import sessions as S
from ..sources.readers import lines_of, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Session label rule for the events analogue: an error event with value above this.
ERROR_VALUE = 150.0
# Session key for the documents analogue: an e-mail address in the line.
EMAIL_KEY = r"([a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+)"
DOMAIN_KEY = r"@([a-z0-9-]+(?:\.[a-z0-9-]+)+)"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def _r6(c):
    return F.round(c, 6)


# ----------------------------------------------------------------- shared inputs
def events_lines(spark, d) -> DataFrame:
    """events as line-level rows: session_id, timestamp, pos, text, value."""
    ev = read_table(spark, d, "events")
    return ev.select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").alias("timestamp"),
                     F.col("event_id").alias("pos"), F.col("event_type").alias("text"), "value")


def raw_event_labels(spark, d) -> DataFrame:
    """A label file analogue: one (block_id, label text) row per event, many per block."""
    ev = read_table(spark, d, "events")
    txt = F.when((F.col("event_type") == "error") & (F.col("value") > ERROR_VALUE), F.lit(" Anomaly")) \
        .otherwise(F.lit("Normal "))
    return ev.select(F.col("user_id").cast("string").alias("block_id"), txt.alias("label"))


def labelled_sessions(spark, d) -> DataFrame:
    sess = S.sessionize(events_lines(spark, d))
    return S.attach_labels(sess, S.label_table(raw_event_labels(spark, d)))


_SQL_SESSIONS = """
  sess AS (SELECT CAST(user_id AS VARCHAR) AS session_id, min(ts) AS timestamp_start,
                  max(ts) AS timestamp_end, count(*) AS n_events
           FROM events WHERE user_id IS NOT NULL GROUP BY 1),
  lab AS (SELECT CAST(user_id AS VARCHAR) AS block_id,
                 max(CASE WHEN event_type = 'error' AND value > 150.0 THEN 1 ELSE 0 END) AS label
          FROM events GROUP BY 1),
  ls AS (SELECT s.session_id, s.session_id AS block_id, s.timestamp_start AS timestamp, s.timestamp_start,
                s.timestamp_end, s.n_events, CAST(coalesce(l.label, 0) AS INTEGER) AS label
         FROM sess s LEFT JOIN lab l ON s.session_id = l.block_id)
"""


# ----------------------------------------------------------------- A1
@register("sessionize", """
SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(user_id AS VARCHAR) AS block_id,
       min(ts) AS timestamp, min(ts) AS timestamp_start, max(ts) AS timestamp_end,
       count(*) AS n_events
FROM events WHERE user_id IS NOT NULL GROUP BY user_id
""")
def q_sessionize(spark, d):
    return S.sessionize(events_lines(spark, d))


# ----------------------------------------------------------------- P6 P11 A2
@register("label_dedupe", """
SELECT lower(trim(CAST(user_id AS VARCHAR))) AS block_id,
       max(CASE WHEN event_type = 'error' AND value > 150.0 THEN 1 ELSE 0 END) AS label
FROM events GROUP BY 1
""")
def q_label_dedupe(spark, d):
    return S.label_table(raw_event_labels(spark, d))


# ----------------------------------------------------------------- J1
@register("attach_labels", "WITH " + _SQL_SESSIONS + " SELECT * FROM ls")
def q_attach_labels(spark, d):
    return labelled_sessions(spark, d)


# ----------------------------------------------------------------- A8
@register("label_counts", "WITH " + _SQL_SESSIONS + """
SELECT label, count(*) AS n FROM ls GROUP BY label
""")
def q_label_counts(spark, d):
    return S.label_counts(labelled_sessions(spark, d))


# ----------------------------------------------------------------- A9
@register("uniqueness_profile", """
SELECT count(*) AS total_rows, count(DISTINCT session_id) AS unique_sessions,
       count(*) - count(DISTINCT session_id) AS duplicate_rows
FROM (SELECT CAST(user_id AS VARCHAR) AS session_id FROM events)
""")
def q_uniqueness(spark, d):
    # line-level rows keyed by session: duplicates are expected here
    return S.uniqueness_profile(events_lines(spark, d))


# ----------------------------------------------------------------- A10
@register("block_profile", """
SELECT count(*) AS unique_blocks, round(avg(n), 6) AS avg_sessions_per_block,
       max(n) AS max_sessions_per_block
FROM (SELECT CAST(user_id AS VARCHAR) AS block_id, count(*) AS n FROM events GROUP BY 1)
""")
def q_block_profile(spark, d):
    ev = events_lines(spark, d).withColumnRenamed("session_id", "block_id")
    return S.block_profile(ev).withColumn("avg_sessions_per_block", _r6("avg_sessions_per_block"))


# ----------------------------------------------------------------- A11
@register("anomaly_profile", "WITH " + _SQL_SESSIONS + """
SELECT count(*) AS sessions, count(*) FILTER (WHERE label = 1) AS anomaly_sessions,
       count(DISTINCT CASE WHEN label = 1 THEN block_id END) AS anomaly_blocks,
       CAST(coalesce(sum(label), 0) AS BIGINT) AS total_anomaly_labels,
       round(CAST(coalesce(sum(label), 0) AS DOUBLE) / greatest(count(*), 1), 6) AS anomaly_rate
FROM ls
""")
def q_anomaly_profile(spark, d):
    return S.anomaly_profile(labelled_sessions(spark, d)).withColumn("anomaly_rate", _r6("anomaly_rate"))


# ----------------------------------------------------------------- W8
@register("duplicates", """
SELECT e.session_id, e.timestamp, e.pos, e.text FROM
 (SELECT CAST(user_id AS VARCHAR) AS session_id, ts AS timestamp, event_id AS pos, event_type AS text,
         count(*) OVER (PARTITION BY user_id) AS c FROM events) e
WHERE c > 1
""")
def q_duplicates(spark, d):
    # every member of a duplicated key on the line table (no row cap: whole result)
    return S.duplicate_sessions(events_lines(spark, d).drop("value"), limit=None)


# ----------------------------------------------------------------- P1
_SQL_LINES = """
  l AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n')) AS line,
               CAST(generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n'), 1) - 1 AS BIGINT) AS line_no
        FROM documents)
"""
_SQL_MASK = ("trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), "
             "'\\b\\d{{1,3}}(?:\\.\\d{{1,3}}){{3}}\\b', '<ip>', 'g'), '\\b[0-9a-fA-F]{{8,}}\\b', '<hex>', 'g'), "
             "'\\b\\d+\\b', '<num>', 'g'), '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}"
             "\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))")


@register("mask_lines", "WITH " + _SQL_LINES + " SELECT doc_id, line_no, " + _SQL_MASK.format(c="line")
          + " AS masked FROM l")
def q_mask_lines(spark, d):
    lines = lines_of(read_table(spark, d, "documents"), "doc_id", "text")
    return lines.select("doc_id", "line_no", mask_line("line").alias("masked"))


# ----------------------------------------------------------------- P2 P3
@register("extract_keys", "WITH " + _SQL_LINES + """
, k AS (SELECT doc_id, line_no, line,
               regexp_extract(lower(line), '([a-z0-9._%+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)+)', 1) AS session_id FROM l)
SELECT session_id, """ + _SQL_MASK.format(c="line") + """ AS log_key, doc_id, line_no
FROM k WHERE session_id <> ''
""")
def q_extract_keys(spark, d):
    lines = lines_of(read_table(spark, d, "documents"), "doc_id", "text")
    k = lines.select(extract_key(F.lower("line"), EMAIL_KEY).alias("session_id"),
                     mask_line("line").alias("log_key"), "doc_id", "line_no")
    return k.where(F.col("session_id") != "")


# ----------------------------------------------------------------- A3 A4
@register("session_docs", """
SELECT CAST(conv_id AS VARCHAR) AS session_id,
       string_agg(regexp_replace(coalesce(text, ''), '^[\\s\\x0b\\x1c-\\x1f]+|[\\s\\x0b\\x1c-\\x1f]+$', '', 'g'), ' '
                  ORDER BY turn) AS doc,
       count(*) AS n_events
FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
""")
def q_session_docs(spark, d):
    conv = read_table(spark, d, "conversations")
    doc = S.session_documents(conv, "conv_id", ["turn"], "text")
    return doc.select(F.col("conv_id").cast("string").alias("session_id"), "doc", "n_events")


# ----------------------------------------------------------------- J2-J4 P13 P14
@register("session_features", "WITH " + _SQL_SESSIONS + """
, docs AS (SELECT CAST(conv_id AS VARCHAR) AS session_id,
       string_agg(regexp_replace(coalesce(text, ''), '^[\\s\\x0b\\x1c-\\x1f]+|[\\s\\x0b\\x1c-\\x1f]+$', '', 'g'), ' '
                  ORDER BY turn) AS doc, count(*) AS n_events
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id)
SELECT ls.session_id, ls.timestamp, coalesce(docs.doc, '') AS doc, CAST(coalesce(docs.n_events, 0) AS BIGINT) AS n_events,
       round(coalesce((epoch_us(ls.timestamp_end) - epoch_us(ls.timestamp_start)) / 1e6, 0.0), 6) AS duration_sec,
       ls.label
FROM ls LEFT JOIN docs ON ls.session_id = docs.session_id
""")
def q_session_features(spark, d):
    conv = read_table(spark, d, "conversations").withColumn("conv_id", F.col("conv_id").cast("string"))
    feats = S.session_features(labelled_sessions(spark, d), conv, "conv_id", ["turn"], "text")
    return feats.select("session_id", "timestamp", "doc", "n_events", _r6("duration_sec").alias("duration_sec"),
                        "label")


# ================================================================= split
from ..operators import split as SP  # noqa: E402

_SQL_CUT = """
, q AS (SELECT (SELECT quantile_cont(epoch_us(timestamp), 0.8) FROM ls WHERE label = 1) AS cut_pos,
               (SELECT quantile_cont(epoch_us(timestamp), 0.8) FROM ls) AS cut_all,
               (SELECT count(*) FILTER (WHERE label = 1) FROM ls) AS n_pos)
, c1 AS (SELECT CASE WHEN n_pos > 0 AND cut_pos IS NOT NULL THEN cut_pos ELSE cut_all END AS cut, cut_all, n_pos FROM q)
, v AS (SELECT count(*) AS vr, count(*) FILTER (WHERE label = 1) AS vp
        FROM ls, c1 WHERE epoch_us(ls.timestamp) >= c1.cut)
, fin AS (SELECT CASE WHEN vr < 1000 OR vp < greatest(50, 0.1 * n_pos) THEN cut_all ELSE cut END AS cut FROM c1, v)
, sp AS (SELECT ls.*, CASE WHEN epoch_us(timestamp) < cut THEN 'train'
                          WHEN epoch_us(timestamp) >= cut THEN 'val' END AS split FROM ls, fin)
"""


@register("temporal_split", "WITH " + _SQL_SESSIONS + _SQL_CUT.replace("vr < 1000 OR vp < greatest(50, 0.1 * n_pos)", "vr < 10 OR vp < greatest(5, 0.1 * n_pos)") + """
SELECT session_id, timestamp, label, split FROM sp
""")
def q_temporal_split(spark, d):
    # bounds that the driver's sessions meet, so that the quantile of the positives is the cut;
    # split_report takes the fallback
    s = labelled_sessions(spark, d)
    return SP.temporal_split(s, min_val_rows=10, min_val_pos=5).select("session_id", "timestamp", "label", "split")


@register("split_report", "WITH " + _SQL_SESSIONS + _SQL_CUT + """
SELECT split, count(*) AS rows, count(*) FILTER (WHERE label = 1) AS positives
FROM sp WHERE split IS NOT NULL GROUP BY split
""")
def q_split_report(spark, d):
    return SP.split_report(SP.temporal_split(labelled_sessions(spark, d)))


@register("exact_quantiles", """
SELECT 0.8 AS prob, round(quantile_cont(value, 0.8), 6) AS value FROM events
UNION ALL SELECT 0.9, round(quantile_cont(value, 0.9), 6) FROM events
UNION ALL SELECT 0.995, round(quantile_cont(value, 0.995), 6) FROM events
""")
def q_exact_quantiles(spark, d):
    from ..operators.ordered import exact_quantiles
    ev = read_table(spark, d, "events")
    return exact_quantiles(ev, "value", [0.8, 0.9, 0.995]).select("prob", _r6("value").alias("value"))


# ================================================================= ranks
from ..operators import ranks as RK  # noqa: E402

_SCORE_COLS = ["score_iso", "score_ae", "score_lstm"]


def detector_scores(spark, d):
    """Three per-user detector scores over all events; each is null for the users without an event
    that it looks at."""
    ev = read_table(spark, d, "events").withColumn("session_id", F.col("user_id").cast("string"))
    g = ev.groupBy("session_id")
    iso = g.agg(F.max(F.when(F.col("value") > 300, F.col("value"))).alias("score_iso"))
    ae = g.agg(F.avg(F.when((F.col("event_type") == "error") & (F.col("value") > 100), F.col("value"))).alias("score_ae"))
    n = F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 150))
    lstm = g.agg(F.when(n > 0, n.cast("double")).alias("score_lstm"))
    return [iso, ae, lstm]


_SQL_SCORES = """
  iso AS (SELECT CAST(user_id AS VARCHAR) AS session_id, max(value) FILTER (WHERE value > 300) AS score_iso FROM events GROUP BY 1),
  ae AS (SELECT CAST(user_id AS VARCHAR) AS session_id, avg(value) FILTER (WHERE event_type = 'error' AND value > 100) AS score_ae
         FROM events GROUP BY 1),
  lstm AS (SELECT CAST(user_id AS VARCHAR) AS session_id,
                  CAST(nullif(count(*) FILTER (WHERE event_type = 'purchase' AND value > 150), 0) AS DOUBLE) AS score_lstm
           FROM events GROUP BY 1),
  m AS (SELECT coalesce(iso.session_id, ae.session_id, lstm.session_id) AS session_id, score_iso, score_ae, score_lstm
        FROM iso FULL OUTER JOIN ae ON iso.session_id = ae.session_id
                 FULL OUTER JOIN lstm ON coalesce(iso.session_id, ae.session_id) = lstm.session_id),
  r AS (SELECT *,
    CASE WHEN score_iso IS NOT NULL THEN ((rank() OVER (ORDER BY score_iso) - 1)
         + (count(*) OVER (PARTITION BY score_iso) + 1) / 2.0) / count(score_iso) OVER () END AS p_score_iso,
    CASE WHEN score_ae IS NOT NULL THEN ((rank() OVER (ORDER BY score_ae) - 1)
         + (count(*) OVER (PARTITION BY score_ae) + 1) / 2.0) / count(score_ae) OVER () END AS p_score_ae,
    CASE WHEN score_lstm IS NOT NULL THEN ((rank() OVER (ORDER BY score_lstm) - 1)
         + (count(*) OVER (PARTITION BY score_lstm) + 1) / 2.0) / count(score_lstm) OVER () END AS p_score_lstm
    FROM m),
  e AS (SELECT *, (coalesce(p_score_iso, 0) + coalesce(p_score_ae, 0) + coalesce(p_score_lstm, 0))
        / nullif((p_score_iso IS NOT NULL)::INT + (p_score_ae IS NOT NULL)::INT + (p_score_lstm IS NOT NULL)::INT, 0)
        AS ens_pct FROM r)
"""
_SQL_RANK_OUT = """session_id, round(score_iso, 6) AS score_iso, round(score_ae, 6) AS score_ae,
  round(score_lstm, 6) AS score_lstm, round(p_score_iso, 6) AS p_score_iso, round(p_score_ae, 6) AS p_score_ae,
  round(p_score_lstm, 6) AS p_score_lstm, round(ens_pct, 6) AS ens_pct"""


def _rank_out(df):
    return df.select("session_id", *[_r6(c).alias(c) for c in _SCORE_COLS],
                     *[_r6(f"p_{c}").alias(f"p_{c}") for c in _SCORE_COLS], _r6("ens_pct").alias("ens_pct"))


def ranked(spark, d):
    return RK.rank_ensemble(RK.merge_scores(detector_scores(spark, d)), _SCORE_COLS)


@register("rank_ensemble", "WITH " + _SQL_SCORES + " SELECT " + _SQL_RANK_OUT + " FROM e")
def q_rank_ensemble(spark, d):
    return _rank_out(ranked(spark, d))


@register("topk", "WITH " + _SQL_SCORES + " SELECT " + _SQL_RANK_OUT
          + ", row_number() OVER (ORDER BY ens_pct DESC NULLS LAST, session_id) AS place"
          + " FROM e ORDER BY ens_pct DESC NULLS LAST, session_id LIMIT 20")
def q_topk(spark, d):
    top = RK.top_k(ranked(spark, d), 20, rank="place")
    return top.select("session_id", *[_r6(c).alias(c) for c in [*_SCORE_COLS, *[f"p_{x}" for x in _SCORE_COLS], "ens_pct"]], "place")


@register("rank_order", "WITH " + _SQL_SCORES + """
SELECT session_id, round(ens_pct, 6) AS ens_pct, row_number() OVER (ORDER BY ens_pct DESC NULLS LAST, session_id) - 1 AS place FROM e
""")
def q_rank_order(spark, d):
    """The place of every user in the global order."""
    from ..operators.ordered import row_index
    r = row_index(ranked(spark, d), [F.col("ens_pct").desc_nulls_last(), F.col("session_id").asc()], "place")
    return r.select("session_id", _r6("ens_pct").alias("ens_pct"), "place")


# ================================================================= evaluation
from ..operators import evaluation as EV  # noqa: E402


def doc_scores(spark, d):
    """documents with a toxic label; score = n_chars."""
    docs = read_table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    lab = read_table(spark, d, "labels").select("doc_id", F.col("toxic").alias("label"))
    return docs.join(lab, "doc_id")


_SQL_CURVE = """
  s AS (SELECT CAST(d.n_chars AS DOUBLE) AS score, l.toxic AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
  g AS (SELECT score AS thr, count(*) FILTER (WHERE coalesce(label, 0) = 1) AS tp,
               count(*) FILTER (WHERE coalesce(label, 0) <> 1) AS fp
        FROM s WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY score),
  t AS (SELECT CAST(sum(tp) AS BIGINT) AS P, CAST(sum(fp) AS BIGINT) AS N FROM g),
  c AS (SELECT thr, tp, fp,
          CAST(sum(tp) OVER (ORDER BY thr DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS ctp,
          CAST(sum(fp) OVER (ORDER BY thr DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cfp,
          P, N FROM g, t),
  cc AS (SELECT *, CAST(ctp AS DOUBLE) / nullif(ctp + cfp, 0) AS precision, CAST(ctp AS DOUBLE) / nullif(P, 0) AS recall,
                CAST(cfp AS DOUBLE) / nullif(N, 0) AS fpr FROM c),
  fb AS (SELECT *, coalesce((1 + 2.25) * precision * recall / (2.25 * precision + recall + 1e-9), 0.0) AS fbeta FROM cc)
"""


@register("pr_curve", "WITH " + _SQL_CURVE + """
SELECT thr, ctp AS tp, cfp AS fp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fpr, 6) AS fpr FROM cc
""")
def q_pr_curve(spark, d):
    c = EV.pr_curve(doc_scores(spark, d))
    return c.select("thr", "tp", "fp", *[_r6(x).alias(x) for x in ("precision", "recall", "fpr")])


@register("roc_auc", "WITH " + _SQL_CURVE + """
SELECT round(sum(fp * (ctp - tp / 2.0)) / (any_value(P) * any_value(N)), 6) AS roc_auc FROM c
""")
def q_roc_auc(spark, d):
    return EV.summary(doc_scores(spark, d)).select(_r6("roc_auc").alias("roc_auc"))


@register("avg_precision", "WITH " + _SQL_CURVE + """
SELECT round(sum(tp * (CAST(ctp AS DOUBLE) / (ctp + cfp))) / any_value(P), 6) AS avg_precision,
       round(CAST(any_value(P) AS DOUBLE) / (any_value(P) + any_value(N)), 6) AS prevalence,
       round(sum(tp * (CAST(ctp AS DOUBLE) / (ctp + cfp))) / any_value(P)
             / greatest(CAST(any_value(P) AS DOUBLE) / (any_value(P) + any_value(N)), 1e-12), 6) AS ap_gain
FROM c
""")
def q_avg_precision(spark, d):
    s = EV.summary(doc_scores(spark, d))
    return s.select(*[_r6(x).alias(x) for x in ("avg_precision", "prevalence", "ap_gain")])


@register("fbeta_point", "WITH " + _SQL_CURVE + """
SELECT thr, round(precision, 6) AS precision, round(recall, 6) AS recall, round(fbeta, 6) AS fbeta
FROM fb ORDER BY fbeta DESC, thr ASC LIMIT 1
""")
def q_fbeta_point(spark, d):
    s = EV.summary(doc_scores(spark, d))
    return s.select("thr", *[_r6(x).alias(x) for x in ("precision", "recall", "fbeta")])


@register("fpr_at_tpr", "WITH " + _SQL_CURVE + """
SELECT 0.8 AS target_tpr, thr, round(recall, 6) AS tpr, round(fpr, 6) AS fpr
FROM cc WHERE recall >= 0.8 ORDER BY thr DESC LIMIT 1
""")
def q_fpr_at_tpr(spark, d):
    r = EV.fpr_at_tpr(doc_scores(spark, d), 0.8)
    return r.select("target_tpr", "thr", _r6("tpr").alias("tpr"), _r6("fpr").alias("fpr"))


@register("confusion", "WITH " + _SQL_CURVE + """
, best AS (SELECT thr FROM fb ORDER BY fbeta DESC, thr ASC LIMIT 1)
, cm AS (SELECT count(*) FILTER (WHERE coalesce(label,0) <> 1 AND NOT coalesce(score >= thr, false)) AS tn,
               count(*) FILTER (WHERE coalesce(label,0) <> 1 AND coalesce(score >= thr, false)) AS fp,
               count(*) FILTER (WHERE coalesce(label,0) = 1 AND NOT coalesce(score >= thr, false)) AS fn,
               count(*) FILTER (WHERE coalesce(label,0) = 1 AND coalesce(score >= thr, false)) AS tp
         FROM s, best)
SELECT tn, fp, fn, tp, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1 FROM cm
""")
def q_confusion(spark, d):
    sc = doc_scores(spark, d)
    best = EV.summary(sc).select("thr")
    return EV.confusion(sc, best).withColumn("f1", _r6("f1"))


@register("pos_weight", """
SELECT count(*) FILTER (WHERE toxic = 1) AS pos, count(*) FILTER (WHERE toxic <> 1) AS neg,
       round(greatest(1.0, CAST(count(*) FILTER (WHERE toxic <> 1) AS DOUBLE)
             / greatest(count(*) FILTER (WHERE toxic = 1), 1)), 6) AS pos_weight
FROM labels
""")
def q_pos_weight(spark, d):
    lab = read_table(spark, d, "labels").select(F.col("toxic").alias("label"))
    return EV.positive_weight(lab).withColumn("pos_weight", _r6("pos_weight"))


# ================================================================= charts
from ..operators import charts as CH  # noqa: E402

CHART_END = "2024-02-01 00:00:00"


def alias_frame(spark, d):
    """A score file using accepted alias spellings: sid, y_true, mse, prob."""
    ev = read_table(spark, d, "events")
    return ev.groupBy(F.col("user_id").cast("string").alias("sid")).agg(
        F.max(F.when((F.col("event_type") == "error") & (F.col("value") > ERROR_VALUE), 1).otherwise(0)).alias("y_true"),
        F.avg("value").alias("mse"), (F.max("value") / 1000.0).alias("prob"))


def synth_frame(spark, d):
    """A score file without a direct score column: recon_dist, error_rate, y."""
    ev = read_table(spark, d, "events")
    return ev.groupBy(F.col("user_id").cast("string").alias("sid")).agg(
        F.avg("value").alias("recon_dist"),
        F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("error_rate"),
        F.max(F.when((F.col("event_type") == "error") & (F.col("value") > ERROR_VALUE), 1).otherwise(0)).alias("y"))


_SQL_ALIAS = """
  a AS (SELECT CAST(user_id AS VARCHAR) AS session_id,
               max(CASE WHEN event_type = 'error' AND value > 150.0 THEN 1 ELSE 0 END) AS label,
               avg(value) AS anomaly_score FROM events GROUP BY 1),
  t AS (SELECT quantile_cont(anomaly_score, 0.9) AS thr FROM a)
"""
_SQL_SYNTH = """
  b AS (SELECT CAST(user_id AS VARCHAR) AS session_id, avg(value) AS recon_dist,
               avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS error_rate,
               max(CASE WHEN event_type = 'error' AND value > 150.0 THEN 1 ELSE 0 END) AS label
        FROM events GROUP BY 1),
  mm AS (SELECT min(recon_dist) AS a0, max(recon_dist) AS a1, min(error_rate) AS b0, max(error_rate) AS b1 FROM b),
  a AS (SELECT session_id, label, greatest((recon_dist - a0) / (a1 - a0), (error_rate - b0) / (b1 - b0)) AS anomaly_score
        FROM b, mm),
  t AS (SELECT quantile_cont(anomaly_score, 0.9) AS thr FROM a)
"""


@register("score_aliases", "WITH " + _SQL_ALIAS + """
SELECT session_id, round(anomaly_score, 6) AS anomaly_score, label, CAST(anomaly_score >= thr AS INTEGER) AS pred FROM a, t
""")
def q_score_aliases(spark, d):
    out = CH.normalize_ensemble(alias_frame(spark, d))
    return out.withColumn("anomaly_score", _r6("anomaly_score"))


@register("minmax_score", "WITH " + _SQL_SYNTH + """
SELECT session_id, round(anomaly_score, 6) AS anomaly_score, label, CAST(anomaly_score >= thr AS INTEGER) AS pred FROM a, t
""")
def q_minmax_score(spark, d):
    out = CH.normalize_ensemble(synth_frame(spark, d))
    return out.withColumn("anomaly_score", _r6("anomaly_score"))


@register("p90_flag", "WITH " + _SQL_ALIAS + """
SELECT session_id, CAST(anomaly_score >= thr AS INTEGER) AS pred, round(thr, 6) AS thr FROM a, t
""")
def q_p90_flag(spark, d):
    a = CH.normalize_aliases(alias_frame(spark, d)).select("session_id", "anomaly_score")
    return CH.percentile_flag(a, threshold="thr").select("session_id", "pred", _r6("thr").alias("thr"))


def chart_base(spark, d):
    """Normalised ensemble rows with row index (score desc, id), hosts and times (jitter 0)."""
    base = CH.normalize_ensemble(alias_frame(spark, d))
    base = CH.assign_hosts(base, [F.col("anomaly_score").desc(), F.col("session_id").asc()],
                           services=("hdfs", "yarn", "hbase"))
    return CH.uniform_times(base, CHART_END, jitter_min=0)


_SQL_CHART_BASE = _SQL_ALIAS + """
, n AS (SELECT count(*) AS n FROM a)
, rb AS (SELECT a.*, CAST(anomaly_score >= thr AS INTEGER) AS pred,
                row_number() OVER (ORDER BY anomaly_score DESC, session_id) - 1 AS i FROM a, t)
, base AS (SELECT session_id, anomaly_score, label, pred, i,
                  'host_' || lpad(CAST(i % 50 + 1 AS VARCHAR), 2, '0') AS host,
                  ['hdfs', 'yarn', 'hbase'][i % 3 + 1] AS service,
                  make_timestamp(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - CAST(365 AS BIGINT) * 86400000000
                                 + i * CAST(round(365 * 86400000000.0 / n) AS BIGINT)) AS timestamp
           FROM rb, n)
"""


@register("host_rollup", "WITH " + _SQL_CHART_BASE + """
SELECT session_id, host, service, timestamp AS start_time, round(anomaly_score, 6) AS anomaly_score, label, pred
FROM base
""")
def q_host_rollup(spark, d):
    # six points of each session, so that a group has several rows
    r = CH.chart_rollup(CH.upsample(chart_base(spark, d), jitter_min=0))
    return r.withColumn("anomaly_score", _r6("anomaly_score"))


@register("upsample", "WITH " + _SQL_CHART_BASE + """
SELECT base.timestamp + to_minutes(k * 15) AS timestamp, host, service, session_id, label, pred,
       round(anomaly_score, 6) AS anomaly_score
FROM base, range(0, 6) r(k)
""")
def q_upsample(spark, d):
    b = chart_base(spark, d).select("timestamp", "host", "service", "session_id", "label", "pred",
                                    _r6("anomaly_score").alias("anomaly_score"))
    return CH.upsample(b, jitter_min=0)


@register("gauge", """
SELECT 'host_' || lpad(CAST(user_id % 50 + 1 AS VARCHAR), 2, '0') AS host, event_type AS service,
       max(value) AS anomaly_score
FROM events GROUP BY 1, 2
""")
def q_gauge(spark, d):
    ev = read_table(spark, d, "events")
    g = ev.select(F.format_string("host_%02d", (F.pmod("user_id", F.lit(50)) + 1).cast("int")).alias("host"),
                  F.col("event_type").alias("service"), F.col("value").alias("anomaly_score"))
    return CH.gauge(g)


@register("max_line_score", """
SELECT CAST(user_id AS VARCHAR) AS session_id, max(value) AS session_score FROM events GROUP BY 1
""")
def q_max_line_score(spark, d):
    ev = events_lines(spark, d)
    return CH.max_line_score(ev, "value")


@register("sharded", "WITH " + _SQL_SESSIONS + """
SELECT session_id, timestamp, CAST((row_number() OVER (ORDER BY timestamp, session_id) - 1) // 40 AS BIGINT) AS part
FROM ls
""")
def q_sharded(spark, d):
    from ..sources.sinks import shard_numbers
    s = labelled_sessions(spark, d)
    return shard_numbers(s, ["timestamp", "session_id"], 40).select("session_id", "timestamp", "part")


# ================================================================= rank and export
@register("chart_export", "WITH " + _SQL_SCORES + """
, a AS (SELECT session_id, CAST(ens_pct AS DOUBLE) AS anomaly_score FROM e),
  t AS (SELECT quantile_cont(anomaly_score, 0.9) AS thr FROM a), n AS (SELECT count(*) AS n FROM a),
  b AS (SELECT a.*, CAST(anomaly_score >= thr AS INTEGER) AS pred, row_number() OVER (ORDER BY anomaly_score DESC NULLS LAST, session_id) - 1 AS i FROM a, t),
  c AS (SELECT session_id, anomaly_score, pred, 'host_' || lpad(CAST(i % 50 + 1 AS VARCHAR), 2, '0') AS host, ['hdfs', 'yarn', 'hbase'][i % 3 + 1] AS service,
               make_timestamp(epoch_us(TIMESTAMP '2024-02-01 00:00:00') - CAST(365 AS BIGINT) * 86400000000 + i * CAST(floor(365 * 86400000000.0 / n) AS BIGINT)) AS ts FROM b, n)
SELECT 'event' AS kind, ts + to_minutes(k * 15) AS timestamp, host, service, session_id, 0 AS label, pred, round(anomaly_score, 6) AS anomaly_score FROM c, range(0, 6) r(k)
UNION ALL SELECT 'session', ts, host, service, session_id, 0, pred, round(anomaly_score, 6) FROM c
UNION ALL SELECT 'gauge', NULL, host, service, NULL, NULL, NULL, round(max(anomaly_score), 6) FROM c GROUP BY host, service
""")
def q_chart_export(spark, d):
    """Detector scores to ranks, then to the chart's events, sessions and gauge."""
    from .ensemble import export_charts, rank_scores
    r = rank_scores(detector_scores(spark, d), _SCORE_COLS).select("session_id", F.col("ens_pct").alias("anomaly_score"))
    events, sessions, gauge = export_charts(r, CHART_END, services=("hdfs", "yarn", "hbase"), jitter_min=0)
    score = _r6("anomaly_score").alias("anomaly_score")
    cols = ["timestamp", "host", "service", "session_id", "label", "pred"]
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    return (events.select(F.lit("event").alias("kind"), *cols, score)
            .unionByName(sessions.select(F.lit("session").alias("kind"), F.col("start_time").alias("timestamp"), *cols[1:], score))
            .unionByName(gauge.select(F.lit("gauge").alias("kind"), none("timestamp", dict(events.dtypes)["timestamp"]), "host", "service",
                                      none("session_id", "string"), none("label", "int"), none("pred", "int"), score)))


# ================================================================= upsert
from ..sources import upsert as UP  # noqa: E402


@register("upsert", """
WITH q AS (SELECT quantile_cont(epoch_us(ts), 0.5) AS lo, quantile_cont(epoch_us(ts), 0.7) AS hi FROM events),
     a AS (SELECT CAST(user_id AS VARCHAR) AS session_id, min(ts) AS timestamp, max(ts) AS timestamp_end,
                  count(*) AS n_events FROM events, q WHERE epoch_us(ts) < hi GROUP BY 1),
     b AS (SELECT CAST(user_id AS VARCHAR) AS session_id,
                  CASE WHEN any_value(user_id) % 5 IN (0, 1) THEN NULL ELSE min(ts) END AS timestamp,
                  max(ts) AS timestamp_end, CASE WHEN any_value(user_id) % 7 = 0 THEN NULL ELSE count(*) END AS n_events
           FROM events, q WHERE epoch_us(ts) >= lo GROUP BY 1)
SELECT * FROM a WHERE session_id NOT IN (SELECT session_id FROM b) UNION ALL SELECT * FROM b
""")
def q_upsert(spark, d):
    """Events up to their 0.7-quantile are the table, those from the median on the batch,
    which holds text: '' and NaT times and counts that aren't numbers."""
    from ..functions import epoch_micros
    from ..operators.ordered import exact_quantiles
    ev = events_lines(spark, d).withColumn("_us", epoch_micros(F.col("timestamp")))
    cut = {r.prob: r.value for r in exact_quantiles(ev, "_us", [0.5, 0.7]).collect()}
    cols = ["session_id", "timestamp", "timestamp_end", "n_events"]
    target = S.sessionize(ev.where(F.col("_us") < cut[0.7])).select(*cols)
    b = S.sessionize(ev.where(F.col("_us") >= cut[0.5])).select(*cols)
    user = F.col("session_id").cast("long")
    text = b.select("session_id", F.when(user % 5 == 0, "").when(user % 5 == 1, "NaT").otherwise(F.col("timestamp").cast("string")).alias("timestamp"),
                    F.col("timestamp_end").cast("string").alias("timestamp_end"),
                    F.when(user % 7 == 0, "many").otherwise(F.col("n_events").cast("string")).alias("n_events"))
    kinds = {"session_id": "string", "timestamp": "timestamp_ntz", "timestamp_end": "timestamp_ntz", "n_events": "long"}
    return UP.merge(target, UP.normalise_batch(text, kinds), "session_id")


# ================================================================= TF-IDF (F2-F5 as F8)
from ..operators import tfidf as TF  # noqa: E402


@register("tfidf_terms", """
WITH l AS (SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS pos,
                  regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_\\p{M}]+') AS toks
           FROM conversations WHERE conv_id IS NOT NULL),
  t AS (SELECT session_id, pos, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM l),
  o AS (SELECT session_id, tok, lead(tok) OVER (PARTITION BY session_id ORDER BY pos, i) AS nxt FROM t),
  terms AS (SELECT session_id, tok AS term FROM o
            UNION ALL SELECT session_id, tok || ' ' || nxt FROM o WHERE nxt IS NOT NULL),
  tf AS (SELECT session_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
  dfc AS (SELECT term, count(*) AS df, sum(tf) AS cnt FROM tf GROUP BY term),
  nd AS (SELECT count(DISTINCT conv_id) AS n FROM conversations),
  vocab AS (SELECT term, df FROM dfc WHERE df >= 2 ORDER BY cnt DESC, term LIMIT 120000),
  w AS (SELECT tf.session_id, tf.term, tf.tf * (ln((1.0 + n) / (1.0 + vocab.df)) + 1.0) AS w
        FROM tf JOIN vocab ON tf.term = vocab.term, nd)
SELECT session_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY session_id)), 6) AS weight FROM w
""")
def q_tfidf_terms(spark, d):
    conv = read_table(spark, d, "conversations").withColumn("session_id", F.col("conv_id").cast("string"))
    r = TF.relational_tfidf(conv, "session_id", "turn", "text")
    return r.select("session_id", "term", _r6("weight").alias("weight"))


# ================================================================= streaming batch twins (ST3, ST4)
@register("stream_sessions", """
WITH e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, ts,
                  lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events
           WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  s AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 21600000000 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY session_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM e)
SELECT session_id, min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, count(*) AS n_events
FROM s GROUP BY session_id, sid
""")
def q_stream_sessions(spark, d):
    ev = events_lines(spark, d)
    return S.gap_sessions(ev, "session_id", "timestamp", 6 * 3600)


@register("hourly_alerts", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       event_type AS service, round(avg(CASE WHEN value > 150.0 THEN 1.0 ELSE 0.0 END), 6) AS alert_rate, count(*) AS n
FROM events GROUP BY 1, 2, 3
""")
def q_hourly_alerts(spark, d):
    ev = read_table(spark, d, "events")
    scored = ev.select(F.col("ts").alias("timestamp"), F.col("event_type").alias("service"),
                       (F.col("value") > ERROR_VALUE).cast("int").alias("is_alert"))
    from ..streaming.live import alert_rate_stream
    g = alert_rate_stream(scored)  # a watermark has no effect on a batch
    return g.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window_end").cast("timestamp_ntz").alias("window_end"), "service",
                    _r6("alert_rate").alias("alert_rate"), "n")


# ================================================================= models (L1-L16), rows-only checks
from ..operators import autoenc as AEN  # noqa: E402
from ..operators.boosting import Boosting  # noqa: E402
from ..plans import detector as DT  # noqa: E402
from ..plans import training as TR  # noqa: E402

_ARTIFACTS: dict = {}


def embedding_features(spark, d):
    """embeddings as session feature rows: label = (class 0), order = vec_id."""
    from pyspark.ml.functions import array_to_vector
    e = read_table(spark, d, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("session_id"), F.col("vec_id").alias("timestamp"),
                    (F.col("label") == 0).cast("int").alias("label"),
                    array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))


# The source's settings: 4,000 rounds of 64 leaves in five folds, 256 components (or as many as there are columns), a code of 16.
MODEL_QUERY = dict(svd_k=TR.SVD_K, bottleneck=AEN.BOTTLENECK, trees=Boosting(), folds=5, min_val_rows=1000, min_val_pos=50)


def trained(spark, d):
    k = (spark.sparkContext.applicationId, d)
    if k not in _ARTIFACTS:
        _ARTIFACTS[k] = DT.train_detectors(embedding_features(spark, d), "timestamp", "session_id", **MODEL_QUERY)
    return _ARTIFACTS[k]


@register("gbt_calibrated")
def q_gbt_calibrated(spark, d):
    det, _ = trained(spark, d)
    return det.gbt.predict(embedding_features(spark, d)).select("session_id", _r6("p_primary").alias("p_primary"))


@register("svd_scores")
def q_svd_scores(spark, d):
    det, _ = trained(spark, d)
    x = det.ae_input(embedding_features(spark, d))
    return x.select("session_id", *[_r6(F.col("_ae_x")[i]).alias(f"svd_{i}") for i in range(3)],
                    F.lit(round(det.svd.evr, 6)).alias("evr"))


@register("linear_ae")
def q_linear_ae(spark, d):
    det, _ = trained(spark, d)
    ch = det.ae.channels(det.ae_input(embedding_features(spark, d)), "_ae_x")
    return ch.select("session_id", *[_r6(c).alias(c) for c in ("err_out", "z_out", "z_lat", "z_ae")], "ae_alert")


@register("stacker")
def q_stacker(spark, d):
    _, val = trained(spark, d)
    return val.select("session_id", _r6("p_score_iso").alias("p_score_iso"), _r6("z_out").alias("z_out"),
                      _r6("z_lat").alias("z_lat"), _r6("fusion_score").alias("fusion_score"), "is_alert", "label")


@register("dense_ae")
def q_dense_ae(spark, d):
    """L7 step 2: dense autoencoder channels (parameter averaging), rows only. Reuses the
    SVD and scaler of the trained detectors; fits and calibrates only the autoencoder."""
    from ..operators.split import apply_split
    k = ("dense", spark.sparkContext.applicationId, d)
    if k not in _ARTIFACTS:
        det, _ = trained(spark, d)
        sp = apply_split(embedding_features(spark, d), det.cut_us, "timestamp")
        benign_tr = det.ae_input(sp.where("split = 'train' AND label = 0"))
        ae = AEN.fit_dense_ae_detector(benign_tr, "_ae_x", "session_id", MODEL_QUERY["bottleneck"], 64, 20)
        _ARTIFACTS[k] = AEN.calibrate(ae, det.ae_input(sp.where("split = 'val' AND label = 0")), "_ae_x")
    det, _ = trained(spark, d)
    ch = _ARTIFACTS[k].channels(det.ae_input(embedding_features(spark, d)), "_ae_x")
    return ch.select("session_id", *[_r6(c).alias(c) for c in ("err_out", "z_out", "z_lat", "z_ae")], "ae_alert")


@register("score_batch")
def q_score_batch(spark, d):
    det, _ = trained(spark, d)
    return det.score(embedding_features(spark, d)).select(
        "session_id", "timestamp", *[_r6(c).alias(c) for c in ("p_score_iso", "z_ae", "fusion_score")],
        "is_alert", "label")


# ================================================================= robust z, fused threshold
def user_channels(spark, d):
    """Per-user detector inputs from events: err = mean value (reconstruction error
    stand-in), code = [mean click value, view count] (latent code stand-in), label."""
    ev = read_table(spark, d, "events")
    return ev.groupBy(F.col("user_id").cast("string").alias("session_id")).agg(
        F.avg("value").alias("err_out"),
        F.coalesce(F.avg(F.when(F.col("event_type") == "click", F.col("value"))), F.lit(0.0)).alias("c0"),
        F.count_if(F.col("event_type") == "view").cast("double").alias("c1"),
        F.max(F.when((F.col("event_type") == "error") & (F.col("value") > ERROR_VALUE), 1).otherwise(0)).alias("label"))


_SQL_USER = """
  u AS (SELECT CAST(user_id AS VARCHAR) AS session_id, avg(value) AS err_out,
               coalesce(avg(CASE WHEN event_type = 'click' THEN value END), 0.0) AS c0,
               CAST(count(*) FILTER (WHERE event_type = 'view') AS DOUBLE) AS c1,
               max(CASE WHEN event_type = 'error' AND value > 150.0 THEN 1 ELSE 0 END) AS label
        FROM events GROUP BY 1),
  med AS (SELECT median(err_out) AS med FROM u WHERE label = 0),
  mad AS (SELECT median(abs(err_out - med)) + 1e-9 AS mad FROM u, med WHERE label = 0),
  zs AS (SELECT session_id, label, (err_out - med) / (1.4826 * mad) AS z_out FROM u, med, mad)
"""


@register("robust_z", "WITH " + _SQL_USER + """
SELECT session_id, round(z_out, 6) AS z_out FROM zs
""")
def q_robust_z(spark, d):
    return _user_detector(spark, d).select("session_id", _r6("z_out").alias("z_out"))


class _Given:
    """A reconstruction whose errors are given in ``err_out``; the code is the input itself."""

    P = None

    def reconstruct(self, df: DataFrame, x: str) -> DataFrame:
        return df.withColumn("_code", F.col(x))


def _user_detector(spark, d) -> DataFrame:
    u = user_channels(spark, d).withColumn("_x", F.array("c0", "c1"))
    benign = u.where("label = 0")
    ae = AEN.LinearAE(_Given(), AEN.fit_standardiser(benign, "_x", eps=AEN.STD_EPS))
    return AEN.calibrate(ae, benign, "_x").channels(u, "_x")


@register("fused_threshold", "WITH " + _SQL_USER + """
, st AS (SELECT avg(c0) AS m0, stddev_pop(c0) + 1e-9 AS s0, avg(c1) AS m1, stddev_pop(c1) + 1e-9 AS s1
         FROM u WHERE label = 0)
, f AS (SELECT zs.session_id, zs.label, z_out,
               sqrt(((c0 - m0) / s0) * ((c0 - m0) / s0) + ((c1 - m1) / s1) * ((c1 - m1) / s1)) AS z_lat
        FROM zs JOIN u ON zs.session_id = u.session_id, st)
, g AS (SELECT *, 0.6 * z_out + 0.4 * z_lat AS z_ae FROM f)
, t AS (SELECT quantile_cont(z_ae, 0.995) AS thr FROM g WHERE label = 0)
SELECT session_id, round(z_out, 6) AS z_out, round(z_lat, 6) AS z_lat, round(z_ae, 6) AS z_ae,
       CAST(z_ae >= thr AS INTEGER) AS is_alert
FROM g, t
""")
def q_fused_threshold(spark, d):
    return _user_detector(spark, d).select("session_id", *[_r6(c).alias(c) for c in ("z_out", "z_lat", "z_ae")], F.col("ae_alert").alias("is_alert"))


@register("benign_stats", """
WITH e AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings WHERE label <> 0)
SELECT CAST(dim AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean,
       round(stddev_pop(CAST(x AS DOUBLE)), 6) AS std
FROM e GROUP BY dim
""")
def q_benign_stats(spark, d):
    from ..operators.models import dimension_stats
    e = read_table(spark, d, "embeddings").where("label <> 0")
    return dimension_stats(e, "embedding").select("dim", _r6("mean").alias("mean"), _r6("std").alias("std"))


# ================================================================= folds (L2)
@register("stratified_folds", """
WITH l AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY quality, doc_id) - 1 AS r FROM labels),
c AS (SELECT toxic, count(*) AS n, sum(count(*)) OVER (ORDER BY toxic) - count(*) AS start FROM labels GROUP BY toxic),
f AS (SELECT toxic, start, n, k, len(range(CAST(start + ((k - start) % 5 + 5) % 5 AS BIGINT), CAST(start + n AS BIGINT), 5)) AS size FROM c, range(0, 5) x(k)),
b AS (SELECT *, sum(size) OVER (PARTITION BY toxic ORDER BY k) AS upto FROM f)
SELECT l.doc_id, min(k) AS fold FROM l JOIN b ON l.toxic = b.toxic AND l.r < b.upto GROUP BY l.doc_id
""")
def q_stratified_folds(spark, d):
    """Fold of every labelled document; many rows share a value of the order column."""
    from ..operators.models import stratified_folds
    f = stratified_folds(read_table(spark, d, "labels"), "quality", "doc_id", "toxic")
    return f.select("doc_id", F.col("fold").cast("long").alias("fold"))


# ================================================================= exact line positions
@register("parse_lines", "WITH " + _SQL_LINES + """
, p AS (SELECT doc_id, line_no, line, row_number() OVER (ORDER BY doc_id, line_no) - 1 AS pos FROM l)
, k AS (SELECT *, regexp_extract(lower(line), '([a-z0-9._%+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)+)', 1) AS session_id FROM p)
SELECT session_id, """ + _SQL_MASK.format(c="line") + """ AS log_key, pos FROM k WHERE session_id <> ''
""")
def q_parse_lines(spark, d):
    from ..operators.parse import parse_log
    lines = lines_of(read_table(spark, d, "documents"), "doc_id", "text")
    return parse_log(lines, "line", ["doc_id", "line_no"], EMAIL_KEY, with_timestamp=False, dense_within=True)


@register("text_round_trip", ORACLE["parse_lines"])
def q_text_round_trip(spark, d):
    """The lines of all documents as text shards in (document, line) order (S7), read back by their
    glob (S4, S1), with positions over the files (P4), masked and keyed (P1-P3)."""
    from ..operators.parse import parse_log
    from ..session import scratch_path
    from ..sources.readers import read_shards
    from ..sources.sinks import write_sharded
    lines = lines_of(read_table(spark, d, "documents"), "doc_id", "text")
    path = scratch_path(spark, "text-shards")
    write_sharded(lines.repartitionByRange("doc_id", "line_no").sortWithinPartitions("doc_id", "line_no").select(F.col("line").alias("value")), path, "text")
    return parse_log(read_shards(spark, f"{path}/part-*", "text"), "value", [], EMAIL_KEY, with_timestamp=False)


# ================================================================= metrics record (M5)
@register("metrics", "WITH " + _SQL_CURVE + """
, best AS (SELECT thr, precision, recall FROM fb ORDER BY fbeta DESC, thr ASC LIMIT 1)
, cm AS (SELECT count(*) FILTER (WHERE coalesce(label,0) <> 1 AND coalesce(score >= thr, false)) AS fp,
               count(*) FILTER (WHERE coalesce(label,0) = 1 AND NOT coalesce(score >= thr, false)) AS fn,
               count(*) FILTER (WHERE coalesce(label,0) = 1 AND coalesce(score >= thr, false)) AS tp
         FROM s, best)
, auc AS (SELECT sum(fp * (ctp - tp / 2.0)) / (any_value(P) * any_value(N)) AS roc_auc,
                 sum(tp * (CAST(ctp AS DOUBLE) / (ctp + cfp))) / any_value(P) AS ap,
                 CAST(any_value(P) AS DOUBLE) / (any_value(P) + any_value(N)) AS prev FROM c)
SELECT round(roc_auc, 6) AS roc_auc, round(ap, 6) AS avg_precision, round(prev, 6) AS prevalence,
       round(ap / greatest(prev, 1e-12), 6) AS ap_gain,
       round(coalesce(2.0 * cm.tp / nullif(2 * cm.tp + cm.fp + cm.fn, 0), 0.0), 6) AS f1,
       best.thr AS thr, round(best.precision, 6) AS precision, round(best.recall, 6) AS recall,
       'p_primary,z_out,z_lat' AS features_used, true AS stacker_on
FROM auc, best, cm
""")
def q_metrics(spark, d):
    sc = doc_scores(spark, d)
    m = EV.metrics_record(sc, features_used=("p_primary", "z_out", "z_lat"))
    return m.select(*[_r6(c).alias(c) for c in ("roc_auc", "avg_precision", "prevalence", "ap_gain", "f1", "precision", "recall")],
                    "thr", F.array_join("features_used", ",").alias("features_used"), "stacker_on")


# ================================================================= E1/E2 on log text (F2-F7 + L*), rows only
# smaller than the defaults; all columns are read
LOG_QUERY = dict(svd_k=16, bottleneck=4, trees=Boosting(rounds=5, leaves=8), folds=5)


def log_table(spark, d):
    conv = read_table(spark, d, "conversations").withColumn("conv_id", F.col("conv_id").cast("string"))
    return TR.session_table(labelled_sessions(spark, d), conv, "conv_id", ["turn"], "text")


@register("log_alerts")
def q_log_alerts(spark, d):
    k = ("log", spark.sparkContext.applicationId, d)
    if k not in _ARTIFACTS:
        _ARTIFACTS[k] = TR.train_from_logs(log_table(spark, d), **LOG_QUERY)
    model, _ = _ARTIFACTS[k]
    return model.score(log_table(spark, d)).select(
        "session_id", "timestamp", *[_r6(c).alias(c) for c in ("p_score_iso", "z_ae", "fusion_score")],
        "is_alert", "label")


# ================================================================= more ordering / tokenising checks
@register("extract_keys_masked", "WITH " + _SQL_LINES + """
, k AS (SELECT doc_id, line_no, line, """ + _SQL_MASK.format(c="line") + """ AS masked FROM l)
SELECT regexp_extract(masked, '@([a-z0-9-]+(?:\\.[a-z0-9-]+)+)', 1) AS session_id, masked AS log_key,
       doc_id, line_no
FROM k WHERE regexp_extract(masked, '@([a-z0-9-]+(?:\\.[a-z0-9-]+)+)', 1) <> ''
""")
def q_extract_keys_masked(spark, d):
    """Q1 as the source ordered it: the key (here the e-mail domain, which survives
    masking; full addresses lose their digits) is searched in the masked line."""
    lines = lines_of(read_table(spark, d, "documents"), "doc_id", "text")
    k = lines.select(extract_key(mask_line("line"), DOMAIN_KEY).alias("session_id"),
                     mask_line("line").alias("log_key"), "doc_id", "line_no")
    return k.where(F.col("session_id") != "")


@register("event_docs", """
SELECT CAST(user_id AS VARCHAR) AS session_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS doc,
       count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts
FROM events WHERE user_id IS NOT NULL GROUP BY user_id
""")
def q_event_docs(spark, d):
    """A3 in time order (timestamp, then event id as the tie-break): one-hour chunks; A5 the span."""
    ev = events_lines(spark, d)
    doc = S.session_documents(ev, "session_id", ["timestamp", "pos"], "text")
    return doc.select("session_id", "doc", "n_events", F.col("first_order").alias("first_ts"), F.col("last_order").alias("last_ts"))


@register("tfidf_documents", """
WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS session_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n')) AS line,
                  generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n'), 1) AS pos
           FROM documents WHERE doc_id IS NOT NULL),
  lt AS (SELECT session_id, pos, regexp_extract_all(lower(line), '[\\p{L}\\p{N}_\\p{M}]+') AS toks FROM l),
  t AS (SELECT session_id, pos, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM lt),
  o AS (SELECT session_id, tok, lead(tok) OVER (PARTITION BY session_id ORDER BY pos, i) AS nxt FROM t),
  terms AS (SELECT session_id, tok AS term FROM o
            UNION ALL SELECT session_id, tok || ' ' || nxt FROM o WHERE nxt IS NOT NULL),
  tf AS (SELECT session_id, term, count(*) AS tf FROM terms GROUP BY 1, 2),
  dfc AS (SELECT term, count(*) AS df, sum(tf) AS cnt FROM tf GROUP BY term),
  nd AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
  vocab AS (SELECT term, df FROM dfc WHERE df >= 2 ORDER BY cnt DESC, term LIMIT 120000),
  w AS (SELECT tf.session_id, tf.term, tf.tf * (ln((1.0 + n) / (1.0 + vocab.df)) + 1.0) AS w
        FROM tf JOIN vocab ON tf.term = vocab.term, nd)
SELECT session_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY session_id)), 6) AS weight FROM w
""")
def q_tfidf_documents(spark, d):
    """F8 over the multilingual documents, one session per document, lines in order."""
    docs = read_table(spark, d, "documents").withColumn("session_id", F.col("doc_id").cast("string"))
    lines = lines_of(docs, "session_id", "text")
    r = TF.relational_tfidf(lines, "session_id", "line_no", "line", n_docs=docs.select("session_id").distinct().count())
    return r.select("session_id", "term", _r6("weight").alias("weight"))


# ================================================================= dirty CSV
_CSV_LINE = """session_of(CAST(user_id AS VARCHAR)) || ',' || CASE WHEN event_id % 89 = 0 THEN 'NaT' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END || ',' ||
  CASE WHEN event_id % 97 = 0 THEN 'x' ELSE '' END || CAST(event_id AS VARCHAR) || ',' || event_type || CASE WHEN event_id % 101 = 0 THEN ',more' ELSE '' END""".replace("session_of(CAST(user_id AS VARCHAR))", "coalesce(CAST(user_id AS VARCHAR), '')")
_CSV_BAD = "(event_id % 97 = 0 OR event_id % 101 = 0)"


@register("csv_round_trip", f"""
SELECT false AS rejected, coalesce(CAST(user_id AS VARCHAR), NULL) AS session_id, CAST(user_id AS VARCHAR) AS block_id, event_id AS pos, event_type AS text,
       CASE WHEN event_id % 89 <> 0 THEN date_trunc('second', ts) END AS timestamp, CAST(NULL AS VARCHAR) AS record
FROM events WHERE NOT {_CSV_BAD}
UNION ALL
SELECT true, NULL, NULL, NULL, NULL, NULL, {_CSV_LINE} FROM events WHERE {_CSV_BAD}
""")
def q_csv_round_trip(spark, d):
    """Events as CSV shards under untidy names and with some lines that don't fit, read back: good lines with
    their columns found, filled in and parsed, the others as they stand."""
    from ..functions import backfill_key, first_present, parse_timestamp, require_columns
    from ..session import scratch_path
    from ..sources.readers import read_csv_checked
    ev = read_table(spark, d, "events")
    i = F.col("event_id")
    pos = F.concat(F.when(i % 97 == 0, "x").otherwise(""), i.cast("string"))
    stamp = F.when(i % 89 == 0, "NaT").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    line = F.concat_ws(",", F.coalesce(F.col("user_id").cast("string"), F.lit("")), stamp, pos, "event_type", F.when(i % 101 == 0, "more"))
    path = scratch_path(spark, "csv")
    ev.select(line.alias("value")).write.text(path)
    schema = "` Session_ID ` string, `TimeStamp` string, `POS` long, ` Message` string"
    kept, rejected = read_csv_checked(spark, path, schema, header=False, record="record")
    kept = backfill_key(require_columns(kept, ["session_id", "timestamp", "pos"], "csv"))
    kept = kept.select(F.lit(False).alias("rejected"), "session_id", "block_id", "pos", F.col(first_present(kept)).alias("text"),
                       parse_timestamp("timestamp").cast("timestamp_ntz").alias("timestamp"))
    return kept.unionByName(rejected.withColumn("rejected", F.lit(True)), allowMissingColumns=True)


# ================================================================= keyed vectors, checked joins
@register("keyed_vectors", """
SELECT vec_id, label, len(embedding) AS dims, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm,
       round(CAST(embedding[1] AS DOUBLE), 6) AS score
FROM embeddings
""")
def q_keyed_vectors(spark, d):
    """Vectors and scores in two tables bucketed by their key, joined without a shuffle and counted on the way."""
    import uuid

    from pyspark.ml.functions import array_to_vector, vector_to_array

    from ..operators.checked import zip_by_key
    from ..session import scratch_path, stored
    from ..sources.vectors import write_keyed
    e = read_table(spark, d, "embeddings").withColumn("x", F.transform("embedding", lambda x: x.cast("double")))
    name = uuid.uuid4().hex
    vectors = write_keyed(e.select("vec_id", array_to_vector("x").alias("features")), f"vectors_{name}", scratch_path(spark, "vectors"), "vec_id", 8)
    scores = write_keyed(e.select("vec_id", "label", F.col("x")[0].alias("score")), f"scores_{name}", scratch_path(spark, "scores"), "vec_id", 8)
    both, check = zip_by_key([vectors, scores], "vec_id")
    out = stored(both, "zipped")
    check()
    for t in ("vectors", "scores"):
        spark.sql(f"DROP TABLE {t}_{name}")
    x = vector_to_array("features")
    return out.select("vec_id", "label", F.size(x).cast("long").alias("dims"), _r6(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))).alias("norm"), _r6("score").alias("score"))


# ================================================================= a given plan
_TREES = (  # (column, threshold, value at or below, value above) of trees with one split
    (0, 110.0, -0.8, 0.9), (1, 20.0, 0.3, -0.2), (0, 130.0, -0.1, 0.4))
_KNOTS = ((0.2, 0.05), (0.5, 0.4), (0.8, 0.95))


def _sql_given() -> str:
    margin = " + ".join(f"CASE WHEN {('err_out', 'c1')[c]} <= {t} THEN {lo} ELSE {hi} END" for c, t, lo, hi in _TREES)
    (x0, y0), (x1, y1), (x2, y2) = _KNOTS
    line = f"CASE WHEN p <= {x0} THEN {y0} WHEN p <= {x1} THEN {y0} + (p - {x0}) / {x1 - x0} * {y1 - y0} WHEN p <= {x2} THEN {y1} + (p - {x1}) / {x2 - x1} * {y2 - y1} ELSE {y2} END"
    return f"""WITH {_SQL_USER}, t AS (SELECT *, 1 / (1 + exp(-(0.1 + {margin}))) AS p FROM u), c AS (SELECT session_id, {line} AS p_primary, err_out, c0 FROM t),
f AS (SELECT session_id, p_primary, 1 / (1 + exp(-(-0.3 + (p_primary - 0.4) / 0.2 * 1.5 + (err_out - 100) / 40 * 0.5 + (c0 - 90) / 30 * -0.25))) AS fusion_score FROM c)
SELECT session_id, round(p_primary, 6) AS p_primary, round(fusion_score, 6) AS fusion_score, CAST(fusion_score >= 0.4 AS INTEGER) AS is_alert FROM f"""


@register("given_plan", _sql_given())
def q_given_plan(spark, d):
    """Trees, calibration and stacker with given numbers, saved as a plan, read back and applied: probabilities (L1),
    lines between knots (L3), inputs bound by name (L12, L16), the flag of the fused score (P19)."""
    import numpy as np
    import pandas as pd
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler

    from ..operators import models as M
    from ..operators.boosting import BoostedTrees
    from ..session import scratch_path
    from ..sources import storage
    from .stages import StackStage, TreesStage, load_plan, save_plan
    trees = [pd.DataFrame({"node": [0, 1, 2], "col": [c, -1, -1], "threshold": [t, 0.0, 0.0], "left": [1, -1, -1], "right": [2, -1, -1], "value": [0.0, lo, hi]}) for c, t, lo, hi in _TREES]
    gbt = M.CalibratedGBT([BoostedTrees(0.1, trees)], [tuple(np.array(x) for x in zip(*_KNOTS, strict=True))])
    stacker = M.Stacker(M.choose_stacker_inputs(["p_primary", "z_out", "z_lat"]), M.Standardiser(np.array([0.4, 100.0, 90.0]), np.array([0.2, 40.0, 30.0])),
                        np.array([1.5, 0.5, -0.25]), -0.3, 0.4)
    path = scratch_path(spark, "plan")
    save_plan(PipelineModel([TreesStage(gbt), StackStage(stacker)]), path)
    plan = load_plan(spark, path)
    storage.remove(spark, path)
    u = user_channels(spark, d).withColumnsRenamed({"c0": "z_lat"}).withColumn("z_out", F.col("err_out"))
    out = plan.transform(VectorAssembler(inputCols=["err_out", "c1"], outputCol="features").transform(u))
    return out.select("session_id", _r6("p_primary").alias("p_primary"), _r6("fusion_score").alias("fusion_score"), "is_alert")
