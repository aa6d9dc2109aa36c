"""Quality rules as a short-circuit cascade.

Each rule is a Boolean column that is true where a document is rejected. On a sample of whole
documents the cascade measures what each rule costs and which share it rejects, orders the
rules by rejection per cost, and tests them in that order: CASE stops at the first rule that
rejects, so a costly rule runs for the survivors of the cheaper ones only. The order changes
what is spent, and which rule is named for a document that fails several; never the verdict.

Defined cases: null text is an empty text without words; a rule that is null doesn't reject;
an empty table gives no rows, and rules in their given order; repeated rows are judged each;
extra columns are kept, or ignored by the query.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, words

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Words in a window whose repetition within a text counts.
WINDOW = 5
#: Expected number of documents that costs and selectivities are measured on.
SAMPLE_ROWS = 1000
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over the text and the features; ``cost`` (seconds on the sample) and
    ``rejected`` (share of it) are measured unless given."""

    name: str
    rejects: str
    cost: float | None = None
    rejected: float | None = None

    @property
    def rank(self) -> float:
        return (self.rejected or 0.0) / max(self.cost or 0.0, 1e-6)


#: The base: a document that fails one of these is never kept.
BASE_RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
)
#: Bounds in use for web text: symbols per word, share of repeated lines, mean length of a word.
RULES = (
    *BASE_RULES,
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * size(filter(split(text, '\\n'), x -> x rlike '[^ \\t-\\r]'))"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("no_letters", "NOT text rlike '\\\\p{L}'"),
)


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with FEATURES of the whole text. Everything stays within the row: the windows of
    a text are hashed and sorted there, so that no group of rows forms."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("__t", t).withColumn("__w", words(F.col("__t")))
    n = F.size("__w")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(
        *[F.get(F.col("__w"), i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("__t", "\n", -1), lambda x: _without(x, BLANKS) != "")
    df = df.withColumns({"__h": hashes, "__l": lines})
    # equal windows are neighbours once sorted; most texts have none and skip the sort
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(
        F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("__p", F.expr("""sort_array(filter(transform(__s, (x, j) ->
        CASE WHEN get(__s, j - 1).h = x.h OR get(__s, j + 1).h = x.h THEN x.i END), i -> i IS NOT NULL))"""))
    covered = F.expr(f"""aggregate(__p, named_struct('n', 0L, 'last', {-WINDOW}),
        (a, i) -> named_struct('n', a.n + least({WINDOW}, i - a.last), 'last', i), a -> a.n)""")
    return df.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(_without(F.col("__t"), BLANKS)).cast("long"),
        "n_symbols": (F.length("__t") - F.length(_without(F.col("__t"), SYMBOLS))).cast("long"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }).drop("__t", "__w", "__h", "__l", "__s", "__p")


def measured(sample: DataFrame, rules: tuple[Rule, ...], tries: int = 2) -> list[Rule]:
    """The rules with their cost and selectivity on ``sample``, best rejection per cost first."""
    def run(cond: str) -> tuple[float, float, int]:
        took = []
        for _ in range(tries):
            began = time.perf_counter()
            r = sample.agg(F.count_if(F.expr(cond)).alias("k"), F.count("*").alias("n")).first()
            took.append(time.perf_counter() - began)
        return min(took), r.k, r.n

    floor = run("false")[0]  # what a pass over the sample takes without a rule
    out = []
    for r in rules:
        s, k, n = run(r.rejects)
        out.append(Rule(r.name, r.rejects, max(s - floor, 1e-4) if r.cost is None else r.cost,
                        k / max(n, 1) if r.rejected is None else r.rejected))
    return sorted(out, key=lambda r: -r.rank)


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` whole documents, by a hash of the text."""
    share = min(1.0, rows / max(1, docs.count()))
    return docs.filter(F.xxhash64("text", F.lit(5)).bitwiseAND((1 << 30) - 1) < int(share * (1 << 30)))


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does."""
    out = None
    for r in rules:
        out = F.when(F.expr(r.rejects), F.lit(r.name)) if out is None else out.when(F.expr(r.rejects), F.lit(r.name))
    return F.lit(None).cast("string") if out is None else out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` (with text) and FEATURES, base_failed, kept, rejected_by."""
    own = docs.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    order = measured(stored(with_features(sample_of(own.select("text"), sample_rows)), "quality-sample"), rules)
    base = F.lit(False)
    for r in BASE_RULES:
        base = base | F.coalesce(F.expr(r.rejects), F.lit(False))
    return (with_features(own).withColumn("base_failed", base).withColumn("rejected_by", cascade(order))
            .withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull()))


def op4_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and verdict of every document. Which of several failing rules is named follows
    measured costs, so the query leaves that column out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", *FEATURES, "base_failed", "kept")


_W = r"[^\x20\x09-\x0D]"
OP4_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_W}+') AS ws,
       list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS ls FROM d),
g AS (SELECT r, i, list_slice(ws, i, i + 4) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM p, range(0, 5) AS x(k) GROUP BY r),
f AS (SELECT w.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
       CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
       CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
       coalesce(n, 0) AS n_repeat_words, len(ls) AS n_lines, regexp_matches(t, '\p{{L}}') AS has_letter
      FROM w LEFT JOIN c ON w.r = c.r),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words
            OR word_chars > 20 * n_words OR NOT has_letter) AS kept
FROM b
"""
