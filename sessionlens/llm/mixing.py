"""Mixing sources to target weights by hierarchical budgeting.

The leaves of a tree (domain, language, source) hold documents. A token budget goes down the tree:
at each node it is dealt among the children in proportion to their weights, but no child gets
more than its subtree can give in ``max_epochs`` passes. What a child can't use is dealt among its
siblings by their weights; only what all of them together can't use is left to the siblings of
their parent. A leaf gives whole epochs, and for the rest the token-prefix of one more epoch in a
seeded order.

Documents are read for the tokens of the leaves, for the tokens by hash bucket of the leaves, for
the one bucket of each leaf in which its prefix ends, and for the result. A leaf, however large, is
never gathered: its prefix ends at a value of the hash, and the result is a comparison with that
value in each row, without a shuffle of the texts.

Defined cases: null or missing domain, lang and source are ``unknown``; documents without words
have no tokens and are never taken; repeated rows have equal places in the order and are taken
together; the document in which the prefix ends is taken whole; weights of zero get
nothing; an empty table gives no rows; columns of a document beside those read here are kept.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_side, stored, table, words

LEVELS = ("domain", "lang", "source")
#: Weight of a node among its siblings; 1 where none is stated.
WEIGHTS: dict[str, dict[str, float]] = {
    "domain": {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0},
    "lang": {"en": 5.0, "de": 2.0, "fr": 2.0, "es": 1.0},
}
MAX_EPOCHS = 3
SEED = 7
#: Tokens to select, as a share of the tokens there are.
SHARE = 1.0
#: Most leaves that are broadcast.
BROADCAST_ROWS = 200_000
#: Hexadecimal digits of the hash that name a bucket of a leaf.
BUCKET_DIGITS = 3
UNKNOWN = "unknown"


def domain_of(source: Column) -> Column:
    """Stand-in for a table that has no domain: four domains, by the number in the source's name."""
    digits = F.regexp_extract(source, "([0-9]+)", 1)
    return F.concat(F.lit("d"), F.when(digits == "", F.lit("0")).otherwise(F.pmod(digits.cast("decimal(38,0)"), F.lit(4)).cast("int").cast("string")))


def with_leaves(docs: DataFrame) -> DataFrame:
    """``docs`` with __domain, __lang, __source and __n, the number of words."""
    has = docs.columns
    source = F.coalesce(F.col("source"), F.lit(UNKNOWN)) if "source" in has else F.lit(UNKNOWN)
    return docs.withColumns({
        "__domain": F.coalesce(F.col("domain"), F.lit(UNKNOWN)) if "domain" in has else domain_of(source),
        "__lang": F.coalesce(F.col("lang"), F.lit(UNKNOWN)) if "lang" in has else F.lit(UNKNOWN),
        "__source": source, "__n": F.size(words(F.col("text"))).cast("long")}).filter("__n > 0")


def _weight(level: str, weights: Mapping[str, Mapping[str, float]]) -> Column:
    given = weights.get(level, {})
    if not given:
        return F.lit(1.0)
    out = F.lit(1.0)
    for k, w in given.items():
        out = F.when(F.col(level) == k, F.lit(float(w))).otherwise(out)
    return out


def budgets(leaves: DataFrame, total: Column, weights: Mapping[str, Mapping[str, float]] = WEIGHTS,
            max_epochs: int = MAX_EPOCHS, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """``leaves`` (the levels, tokens) with ``budget``. ``total`` is an aggregate over leaves.

    Among siblings in the order of capacity by weight, a child is filled if its capacity is at most
    its share of what is left by the children before it; the others share what is left by weight.
    """
    caps = leaves.withColumn("cap", F.col("tokens") * float(max_epochs))
    dealt = leaves.agg(F.least(total.cast("double"), F.sum("tokens") * float(max_epochs)).alias("budget"))
    for depth in range(1, len(levels) + 1):
        path, above = list(levels[:depth]), list(levels[:depth - 1])
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(path[-1], weights)).filter("w > 0")
        nodes = nodes.join(dealt, above) if above else nodes.crossJoin(dealt)  # one row: the whole budget
        order = Window.partitionBy(*[F.col(c) for c in above] or [F.lit(0)]).orderBy(F.col("cap") / F.col("w"), path[-1])
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        everyone = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        nodes = nodes.withColumns({"c0": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w0": F.coalesce(F.sum("w").over(before), F.lit(0.0)),
                                   "w1": F.sum("w").over(everyone)})
        nodes = nodes.withColumn("full", F.col("cap") * (F.col("w1") - F.col("w0")) <= F.col("w") * (F.col("budget") - F.col("c0")))
        nodes = nodes.withColumns({"cf": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everyone), F.lit(0.0)),
                                   "wf": F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(everyone), F.lit(0.0))})
        dealt = nodes.select(*path, F.when(F.col("full"), F.col("cap")).otherwise(
            F.col("w") * (F.col("budget") - F.col("cf")) / (F.col("w1") - F.col("wf"))).alias("budget"))
    return leaves.join(dealt, list(levels)).select(*levels, "tokens", "budget")


def _place(epoch: Column, seed: int) -> Column:
    """Place of a document in a seeded epoch."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def plan(slim: DataFrame, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, share: float = SHARE,
         max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The levels, tokens, budget, full (whole epochs) and cut of each leaf that gives documents: the
    last place of its partial epoch, null if there is none. ``slim`` is a stored table of
    doc_id, the levels and n."""
    leaf = list(LEVELS)
    leaves = stored(slim.groupBy(*leaf).agg(F.sum("n").alias("tokens")), "mix-leaves")
    dealt = budgets(leaves, F.floor(F.sum("tokens") * share), weights, max_epochs).filter("budget > 0")
    dealt = dealt.withColumn("full", F.least(F.floor(F.col("budget") / F.col("tokens")), F.lit(max_epochs)).cast("int"))
    dealt = stored(dealt.withColumn("rest", F.when(F.col("full") < max_epochs, F.col("budget") - F.col("full") * F.col("tokens")).otherwise(0.0)), "mix-budgets")
    partial = dealt.filter("rest > 0").select(*leaf, "full", "rest")
    placed = slim.join(small_side(partial, BROADCAST_ROWS), leaf).withColumn("place", _place(F.col("full"), seed)).withColumn(
        "bucket", F.substring("place", 1, BUCKET_DIGITS))
    sums = placed.groupBy(*leaf, "rest", "bucket").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*leaf).orderBy("bucket")
    ends = sums.withColumn("upto", F.sum("n").over(upto)).filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
    ends = stored(ends.select(*leaf, "bucket", (F.col("upto") - F.col("n")).alias("before")), "mix-ends")
    last = placed.join(small_side(ends, BROADCAST_ROWS), [*leaf, "bucket"])
    by_place = last.groupBy(*leaf, "rest", "before", "place").agg(F.sum("n").alias("n"))  # repeated rows share a place
    start = F.col("before") + F.sum("n").over(Window.partitionBy(*leaf).orderBy("place")) - F.col("n")
    cuts = by_place.withColumn("start", start).filter("start < rest").groupBy(*leaf).agg(F.max("place").alias("cut"))
    return stored(dealt.join(cuts, leaf, "left").select(*leaf, "tokens", "budget", "full", "cut"), "mix-plan")


def mix(docs: DataFrame, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, share: float = SHARE,
        max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The selected rows of ``docs`` with epoch, domain and n_tokens; a row for each epoch that
    takes it. A column of that name in ``docs`` is replaced."""
    own = with_leaves(docs)
    slim = stored(own.select("doc_id", *[F.col(f"__{c}").alias(c) for c in LEVELS], F.col("__n").alias("n")), "mix-slim")
    leaves = plan(slim, weights, share, max_epochs, seed).select(*[F.col(c).alias(f"__{c}") for c in LEVELS], F.col("full").alias("__full"), F.col("cut").alias("__cut"))
    own = own.join(small_side(leaves, BROADCAST_ROWS), [f"__{c}" for c in LEVELS])
    taken = F.coalesce(_place(F.col("__full"), seed) <= F.col("__cut"), F.lit(False))
    last = F.col("__full") - 1 + taken.cast("int")
    own = own.withColumn("__e", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))))
    kept = [c for c in docs.columns if c not in ("epoch", "domain", "n_tokens")]
    return own.select(*kept, F.col("__e").alias("epoch"), F.col("__domain").alias("domain"), F.col("__n").alias("n_tokens"))


def op9_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mix(docs).select("doc_id", "epoch", "domain", "lang", "source", "n_tokens")


def _level_sql(depth: int) -> str:
    path, above = LEVELS[:depth], LEVELS[:depth - 1]
    cols, part = ", ".join(path), f"PARTITION BY {', '.join(above)}" if above else ""
    weight = "CASE " + path[-1] + " " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS.get(path[-1], {"": 1.0}).items()) + " ELSE 1.0 END"
    rows = f"OVER ({part} ORDER BY cap / w, {path[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
n{depth} AS (SELECT {cols}, sum(tokens) * {float(MAX_EPOCHS)}::DOUBLE AS cap, ({weight})::DOUBLE AS w FROM l GROUP BY {cols}),
o{depth} AS (SELECT *, coalesce(sum(cap) {rows}, 0) AS c0, coalesce(sum(w) {rows}, 0) AS w0, sum(w) OVER ({part}) AS w1
   FROM n{depth} {f"JOIN b{depth - 1} USING ({', '.join(above)})" if above else "CROSS JOIN b0"}),
f{depth} AS (SELECT *, cap * (w1 - w0) <= w * (budget - c0) AS filled FROM o{depth}),
g{depth} AS (SELECT *, coalesce(sum(CASE WHEN filled THEN cap END) OVER ({part}), 0) AS cf,
   coalesce(sum(CASE WHEN filled THEN w END) OVER ({part}), 0) AS wf FROM f{depth}),
b{depth} AS (SELECT {cols}, CASE WHEN filled THEN cap ELSE w * (budget - cf) / (w1 - wf) END AS budget FROM g{depth})"""


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '{UNKNOWN}') AS lang, coalesce(source, '{UNKNOWN}') AS source, lang AS lang0, source AS source0,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
t AS (SELECT *, 'd' || coalesce(CAST(try_cast(nullif(regexp_extract(source, '([0-9]+)', 1), '') AS HUGEINT) % 4 AS VARCHAR), '0') AS domain FROM d WHERE n > 0),
l AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tokens FROM t GROUP BY ALL),
b0 AS (SELECT least(floor(sum(tokens) * {SHARE})::DOUBLE, sum(tokens) * {float(MAX_EPOCHS)}::DOUBLE) AS budget FROM l),
{_level_sql(1)},{_level_sql(2)},{_level_sql(3)},
p AS (SELECT domain, lang, source, tokens, budget, CAST(least(floor(budget / tokens), {MAX_EPOCHS}) AS INTEGER) AS whole FROM l JOIN b3 USING (domain, lang, source) WHERE budget > 0),
q AS (SELECT *, CASE WHEN whole < {MAX_EPOCHS} THEN budget - whole * tokens ELSE 0 END AS rest FROM p),
s AS (SELECT t.*, whole, rest, md5('{SEED}/' || whole || '/' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM t JOIN q USING (domain, lang, source)),
r AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE UNBOUNDED PRECEDING)
    - sum(n) OVER (PARTITION BY domain, lang, source, place) AS start FROM s)
SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, domain, lang0 AS lang, source0 AS source, CAST(n AS BIGINT) AS n_tokens
FROM (SELECT *, unnest(range(0, whole + CASE WHEN start < rest THEN 1 ELSE 0 END)) AS epoch FROM r)
"""
