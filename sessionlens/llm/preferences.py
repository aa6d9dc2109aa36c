"""Preference formatting: a shared prompt and two masked completions.

The longest common turn prefix of a chosen and a rejected conversation is rendered once, as the
prompt; the turns after it are the two completions. A mask goes with each completion: the spans
(code points, end exclusive) of what the assistant says there, end mark included; all else
isn't learned.

A conversation is one value of the result, so its turns are gathered in one row; nothing larger
than a pair of conversations is.

Defined cases: turns go by number, then role and text; a row that is repeated within a conversation
counts once; a null role is ``unknown``, a null text is empty; turns of a null conversation are
left out; template marks inside a text are broken up by a blank; equal conversations have
empty completions and aren't usable; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import clashless, stored, table

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"
#: Conversation ids in a block, within which conversations of one opening are numbered.
BLOCK = 4096


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) of a table of conv_id, turn, role, text."""
    own = clashless(turns, ["conv_id", "turn", "role", "text"]).filter("conv_id IS NOT NULL")
    said = F.struct("turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return own.groupBy("conv_id").agg(F.sort_array(F.collect_set(said)).alias("t")).select(
        "conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _shown(turn: Column) -> Column:
    text = F.replace(turn["text"], F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(BEGIN), F.replace(turn["role"], F.lit("<|"), F.lit("< |")), F.lit("\n"), text, F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _shown), "")


def spans(turns: Column) -> Column:
    """Array of start, end of what the assistant says in the rendered turns."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        end = acc["p"] + F.length(_shown(x))
        start = acc["p"] + F.length(F.concat(F.lit(BEGIN), x["role"], F.lit("\n")))
        return F.struct(end.alias("p"), F.when(x["role"] == ASSISTANT, F.concat(acc["a"], F.array(
            F.struct(start.alias("start"), (end - 1).alias("end"))))).otherwise(acc["a"]).alias("a"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("p"), none.alias("a")), step, lambda acc: acc["a"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` with arrays of turns ``chosen`` and ``rejected`` (null: no such side) becomes
    n_prefix, prompt, chosen, rejected (text), chosen_spans, rejected_spans, usable: whether both
    completions have something to learn; other columns are kept."""
    df = pairs.withColumns({"__c": F.coalesce("chosen", F.array().cast("array<struct<role:string,text:string>>")),
                            "__r": F.coalesce("rejected", F.array().cast("array<struct<role:string,text:string>>"))})
    same = F.zip_with("__c", "__r", lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    df = df.withColumn("n_prefix", F.when(first > 0, first - 1).otherwise(F.least(F.size("__c"), F.size("__r"))).cast("int"))
    rest = {s: F.slice(F.col(c), F.col("n_prefix") + 1, F.greatest(F.size(c), F.lit(1))) for s, c in (("c", "__c"), ("r", "__r"))}
    df = df.withColumns({"__cr": rest["c"], "__rr": rest["r"]})
    df = df.withColumns({"prompt": rendered(F.slice("__c", F.lit(1), F.col("n_prefix"))), "chosen": rendered(F.col("__cr")),
                         "rejected": rendered(F.col("__rr")), "chosen_spans": spans(F.col("__cr")), "rejected_spans": spans(F.col("__rr"))})
    return df.withColumn("usable", (F.size("chosen_spans") > 0) & (F.size("rejected_spans") > 0)).drop("__c", "__r", "__cr", "__rr")


def numbered(convs: DataFrame) -> DataFrame:
    """``convs`` with ``nth``, the place of a conversation among those with its opening, by id.
    Counts of blocks of ids give the places where a block begins, so that a common opening is
    numbered in blocks and not in one task."""
    key = F.xxhash64(F.col("turns")[0]["role"], F.col("turns")[0]["text"])
    df = convs.withColumns({"opening": key, "block": F.floor(F.col("conv_id") / BLOCK)})
    sums = df.groupBy("opening", "block").agg(F.count("*").alias("k"))
    begin = F.sum("k").over(Window.partitionBy("opening").orderBy("block")) - F.col("k")
    within = F.row_number().over(Window.partitionBy("opening", "block").orderBy("conv_id"))
    return df.withColumn("i", within).join(sums.select("opening", "block", begin.alias("begin")), ["opening", "block"]).withColumn(
        "nth", F.col("begin") + F.col("i") - 1).drop("begin", "i", "block")


def pairs_of(turns: DataFrame) -> DataFrame:
    """conv_id (of the chosen one), rejected_id, how, chosen, rejected.

    Conversations with the same first turn are alternatives: by id, the first is preferred to the
    second, the third to the fourth, and so on. One that is left over keeps its turns up to its
    last answer, and the last answer of the conversation with its id's neighbour (the other of 2k
    and 2k + 1) is rejected in its place. Without a neighbour that answers it has no rejected side.
    """
    convs = stored(numbered(conversations(turns)), "pref-conversations")
    a = convs.filter("nth % 2 = 0").select("opening", F.col("nth").alias("k"), "conv_id", F.col("turns").alias("chosen"))
    b = convs.filter("nth % 2 = 1").select("opening", (F.col("nth") - 1).alias("k"), F.col("conv_id").alias("alt_id"), F.col("turns").alias("alt"))
    both = a.join(b, ["opening", "k"], "left")
    answer = F.element_at(F.filter("turns", lambda x: x["role"] == ASSISTANT), -1)
    other = convs.select(F.col("conv_id").alias("near_id"), F.when(F.exists("turns", lambda x: x["role"] == ASSISTANT), answer).alias("answer"))
    both = both.withColumn("near", F.when(F.col("alt_id").isNull(), F.col("conv_id").bitwiseXOR(F.lit(1).cast("long"))))
    both = both.join(other, F.col("near") == F.col("near_id"), "left")
    last = F.expr("array_max(filter(transform(chosen, (x, i) -> CASE WHEN x.role = 'assistant' THEN i END), i -> i IS NOT NULL))")
    swapped = F.when(F.col("answer").isNotNull() & last.isNotNull(), F.concat(
        F.slice("chosen", F.lit(1), F.coalesce(last, F.lit(0))), F.array("answer")))
    return both.select("conv_id", F.coalesce("alt_id", F.when(swapped.isNotNull(), F.col("near_id"))).alias("rejected_id"),
                       F.when(F.col("alt_id").isNotNull(), "alternative").when(swapped.isNotNull(), "swapped").otherwise("alone").alias("how"),
                       "chosen", F.coalesce("alt", swapped).alias("rejected"))


def _spans_text(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",").alias(c)


def op3_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, as a side of a formatted pair."""
    out = format_pairs(pairs_of(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "rejected_id", "how", "n_prefix", "prompt", "chosen", "rejected", _spans_text("chosen_spans"),
                      _spans_text("rejected_spans"), "usable")


def _render_sql(turns: str) -> str:
    return (f"coalesce(list_aggregate(list_transform({turns}, lambda x: '{BEGIN}' || replace(x.role, '<|', '< |') || chr(10) || "
            f"replace(x.text, '<|', '< |') || '<|im_end|>' || chr(10)), 'string_agg', ''), '')")


def _spans_sql(turns: str) -> str:
    size = ("(length(x.role) + length(replace(x.text, '<|', '< |')) + " + str(len(BEGIN) + len(END) + 1) + ")")
    before = f"coalesce(list_sum(list_transform({turns}[1:i - 1], lambda x: {size})), 0)"
    x = f"{turns}[i]"
    return (f"coalesce(list_aggregate(list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {x}.role = 'assistant'), lambda i: "
            f"CAST(CAST({before} + {len(BEGIN) + 1} + length({x}.role) AS BIGINT) AS VARCHAR) || ':' || "
            f"CAST(CAST({before} + {size.replace('x.', x + '.')} - 1 AS BIGINT) AS VARCHAR)), 'string_agg', ','), '')")


OP3_SQL = f"""
WITH u AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS t FROM u GROUP BY conv_id),
n AS (SELECT *, row_number() OVER (PARTITION BY t[1] ORDER BY conv_id) - 1 AS nth,
       list_filter(t, lambda x: x.role = 'assistant')[-1] AS answer,
       list_max(list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant')) AS last_at FROM c),
p AS (SELECT a.conv_id, b.conv_id AS alt_id, o.conv_id AS near_id, a.t AS ct, b.t AS alt,
       CASE WHEN b.conv_id IS NULL AND o.answer IS NOT NULL AND a.last_at IS NOT NULL THEN list_append(a.t[1:a.last_at - 1], o.answer) END AS swapped
      FROM n a LEFT JOIN n b ON a.t[1] = b.t[1] AND b.nth = a.nth + 1
      LEFT JOIN n o ON b.conv_id IS NULL AND o.conv_id = xor(a.conv_id, 1) WHERE a.nth % 2 = 0),
q AS (SELECT conv_id, coalesce(alt_id, CASE WHEN swapped IS NOT NULL THEN near_id END) AS rejected_id,
       CASE WHEN alt_id IS NOT NULL THEN 'alternative' WHEN swapped IS NOT NULL THEN 'swapped' ELSE 'alone' END AS how,
       ct, coalesce(alt, swapped, []) AS rt FROM p),
r AS (SELECT *, CAST(coalesce(list_min(list_filter(range(1, least(len(ct), len(rt)) + 1), lambda i: ct[i] <> rt[i])) - 1,
       least(len(ct), len(rt))) AS INTEGER) AS n_prefix FROM q),
s AS (SELECT *, ct[1:n_prefix] AS pt, ct[n_prefix + 1:] AS cc, rt[n_prefix + 1:] AS rr FROM r)
SELECT conv_id, rejected_id, how, n_prefix, {_render_sql('pt')} AS prompt, {_render_sql('cc')} AS chosen, {_render_sql('rr')} AS rejected,
  {_spans_sql('cc')} AS chosen_spans, {_spans_sql('rr')} AS rejected_spans,
  len(list_filter(cc, lambda x: x.role = 'assistant')) > 0 AND len(list_filter(rr, lambda x: x.role = 'assistant')) > 0 AS usable
FROM s
"""
