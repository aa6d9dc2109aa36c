"""Personal data by patterns, and by bootstrapped contextual extraction.

Base: e-mail addresses, IP addresses, card numbers and phone numbers by their form. The method
adds identifiers of other forms. The base entities are seeds. The one or two words before an
entity are a lexical pattern; identifier-like words (eight characters with a digit, say) behind
such words are instances. Rounds over the graph of patterns and instances score a pattern by the
share of its occurrences in the corpus that known instances follow, and an instance by the
patterns that it follows (1 minus the product of what they leave open); what passes becomes known
and induces patterns in the next round, until a round finds nothing new and no higher score. The occurrences of accepted instances become ``id`` spans.

How often a pattern occurs is counted over all words of all documents, so that a common word
before a few entities scores near zero. The graph itself holds only identifier-like words and
patterns with ``SUPPORT`` distinct instances.

Spans are code points, end exclusive. A span's place is the running length of the pieces that
marks around each match cut the text into.

Defined cases: null text is empty and has no spans; a null doc_id keeps its row; repeated rows
get the same spans; marks that a text holds itself (U+0001) are read as U+0002; matches of
different kinds may overlap, ``id`` spans never overlap a base span; in redaction the leftmost,
then the kind listed first wins; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, small_side, stored, table, words

KINDS = ("email", "ip", "card", "phone")
DISCOVERED = "id"
#: The base patterns. A match may begin at the start of a run of its characters or where the
#: last match has ended; possessive quantifiers keep long runs linear and off the stack. The
#: card pattern asks for 12 digits at once, as shorter chains are dropped anyway.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have before a pattern is tried on it.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
_NS = r"[^\x20\x09-\x0D]"
#: A word of eight characters at least, one of them a digit, without the punctuation at its end.
IDENTIFIER = rf"(?<!{_NS})(?={_NS}{{8}})[^\x20\x09-\x0D0-9]*+[0-9](?:{_NS}*[^\x20\x09-\x0D.,;:!?)\]}}'\"])?"
MARK = "\x01"
#: Characters before an entity that its pattern is taken from.
CONTEXT = 80
#: Distinct known instances that a pattern needs.
SUPPORT = 3
PATTERN_SCORE = 0.5
INSTANCE_SCORE = 0.8
#: Rounds go on while a score grows by more than this.
TOLERANCE = 1e-6
#: Most rows of the pattern table and of the found spans that are broadcast.
BROADCAST_ROWS = 500_000

SPAN = "struct<s:int,e:int,v:string,c:string>"


def _matches(text: str, pattern: str, needs: str) -> Column:
    """Array of SPAN of the matches in column ``text``: start, end, value, what stands before."""
    marked = F.regexp_replace(F.col(text), pattern, MARK + "$0" + MARK)
    pieces = F.when(F.col(text).rlike(needs), F.split(marked, MARK, -1)).otherwise(F.array(F.col(text)))
    none = F.lit(None).cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("i"), F.lit("").alias("c"), F.coalesce(none, F.array().cast(f"array<{SPAN}>")).alias("a"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["p"] + F.length(x)
        inside = acc["i"] % 2 == 1
        return F.struct(end.alias("p"), (acc["i"] + 1).alias("i"), F.when(inside, acc["c"]).otherwise(F.right(x, F.lit(CONTEXT))).alias("c"),
                        F.when(inside, F.concat(acc["a"], F.array(F.struct(acc["p"].alias("s"), end.alias("e"), x.alias("v"), acc["c"].alias("c")))))
                        .otherwise(acc["a"]).alias("a"))

    return F.when(F.size(pieces) > 1, F.aggregate(pieces, start, step, lambda acc: acc["a"])).otherwise(F.array().cast(f"array<{SPAN}>"))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    """Whether the digits of v pass the Luhn check."""
    rev = F.reverse(_digits(v))

    def term(i: Column) -> Column:
        x = F.substring(rev, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(rev)), F.lit(0), lambda a, i: a + term(i)) % 10 == 0


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, "\\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (
        F.coalesce(F.try_to_number(F.regexp_replace(F.concat(F.lit("0"), p), "^0+(?=[0-9])", ""), F.lit("9999999999999999")).cast("int"), F.lit(999)) <= 255)),
    "card": lambda v: F.length(_digits(v)).between(12, 19) & _luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def _valid(k: str) -> Column:
    return F.filter(f"__m_{k}", lambda m: _VALID[k](m["v"]))


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``__t``, the text that was searched, and an array of SPAN for each kind."""
    df = docs.withColumn("__t", F.translate(F.coalesce(F.col(text), F.lit("")), MARK, "\x02"))
    df = df.withColumns({f"__m_{k}": _matches("__t", PATTERNS[k], NEEDS[k]) for k in KINDS})
    return df.withColumns({f"__{k}": _valid(k) for k in KINDS}).drop(*[f"__m_{k}" for k in KINDS])


def _flat(k: str) -> Column:
    return F.transform(f"__{k}", lambda m: F.struct(m["s"].alias("s"), F.lit(KINDS.index(k)).alias("o"), m["e"].alias("e"), F.lit(k).alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["s"].cast("string"), m["e"].cast("string"))), ",")


def _text_key(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(17), F.col(text)).alias("h2")]


def _rows(spans: str | Column, kind: Column) -> Column:
    return F.transform(spans, lambda m: F.struct(*[m[c].alias(c) for c in "sevc"], kind.alias("kind")))


def occurrences(docs: DataFrame) -> DataFrame:
    """Seeds and identifier-like words: h1, h2 (of the text), s, e, v, kind (null unless a seed),
    and the patterns before them: p1 (a word), p2 (two words), null where there is none."""
    df = with_base(docs.select("text")).withColumn("__i", _matches("__t", IDENTIFIER, "[0-9]"))
    base = F.concat(*[_flat(k) for k in KINDS])
    free = F.filter("__i", lambda m: ~F.exists("__base", lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"])))
    df = df.withColumn("__base", base).withColumn("__all", F.concat(
        *[_rows(f"__{k}", F.lit(k)) for k in KINDS], _rows(free, F.lit(None).cast("string"))))
    df = df.select(*_text_key("__t"), F.explode("__all").alias("x")).select("h1", "h2", "x.*")
    before = words(F.lower("c"))
    # a word that touches the entity isn't a word of the corpus: told apart by a mark
    touch = F.when(F.col("c").rlike(SPACE + "$"), F.lit("")).otherwise(F.lit(MARK))
    df = df.withColumn("w", before)
    one = F.when(F.size("w") > 0, F.xxhash64(F.concat(F.element_at("w", -1), touch)))
    two = F.when(F.size("w") > 1, F.xxhash64(F.element_at("w", -2), F.concat(F.element_at("w", -1), touch)))
    return df.select("h1", "h2", "s", "e", "v", "kind", one.alias("p1"), two.alias("p2"))


def pattern_counts(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """p, n: how often each of ``patterns`` (p) occurs among the words of all documents."""
    w = docs.select(words(F.lower(F.translate(F.coalesce(F.col("text"), F.lit("")), MARK, "\x02"))).alias("w"))
    keys = F.concat(F.transform("w", lambda x: F.xxhash64(x)),
                    F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.xxhash64(F.get("w", i - 1), F.get("w", i))))
                    .otherwise(F.array().cast("array<bigint>")))
    return w.select(F.explode(keys).alias("p")).join(small_side(patterns, BROADCAST_ROWS), "p").groupBy("p").agg(F.count("*").alias("n"))


def bootstrap(occ: DataFrame, docs: DataFrame, support: int = SUPPORT, pattern_score: float = PATTERN_SCORE,
              instance_score: float = INSTANCE_SCORE) -> DataFrame:
    """v: the identifiers, other than seeds, that the rounds accept. ``occ`` is a stored table
    of ``occurrences``."""
    edges = occ.select("v", F.explode(F.array("p1", "p2")).alias("p")).filter("p IS NOT NULL").groupBy("p", "v").agg(F.count("*").alias("k"))
    wide = edges.groupBy("p").agg(F.count("*").alias("m"), F.sum("k").alias("own")).filter(F.col("m") >= support)
    wide = stored(wide.select("p", "own"), "pii-patterns")
    n = pattern_counts(docs, wide.select("p"))
    totals = stored(wide.join(n, "p", "left").select("p", F.greatest("own", F.coalesce("n", F.lit(0))).alias("n")), "pii-totals")
    edges = stored(edges.join(small_side(totals, BROADCAST_ROWS), "p"), "pii-edges")
    seeds = stored(occ.filter("kind IS NOT NULL").select("v", F.lit(1.0).alias("score")).distinct(), "pii-seeds")
    known, accepted = seeds, seeds.limit(0)
    while True:
        scores = (edges.join(known, "v").groupBy("p", "n").agg(F.count("*").alias("m"), F.sum(F.col("k") * F.col("score")).alias("hit"))
                  .filter((F.col("m") >= support) & (F.col("hit") >= pattern_score * F.col("n")))
                  .select("p", F.least(F.col("hit") / F.col("n"), F.lit(0.999)).alias("conf")))
        found = (edges.join(scores, "p").groupBy("v").agg((1 - F.exp(F.sum(F.log(1 - F.col("conf"))))).alias("score"))
                 .filter(F.col("score") >= instance_score).join(seeds.select("v"), "v", "left_anti"))
        # what is known stays known, at its highest score, whatever the order of a sum rounds to
        both = found.withColumn("old", F.lit(0.0)).unionByName(accepted.withColumn("old", F.col("score")))
        new = stored(both.groupBy("v").agg(F.max("score").alias("score"), F.max("old").alias("old")), "pii-found")
        grown = new.filter(F.col("score") > F.col("old") + TOLERANCE).limit(1).count()
        accepted = new.select("v", "score")
        known = seeds.unionByName(accepted)
        if not grown:  # scores only grow, up to 1, so this comes
            return accepted.select("v")


def discovered(docs: DataFrame) -> DataFrame:
    """h1, h2 (of the text), found: the sorted ``id`` spans of each text that has any."""
    occ = stored(occurrences(docs), "pii-occurrences")
    accepted = stored(bootstrap(occ, docs), "pii-accepted")
    spans = occ.filter("kind IS NULL").join(small_side(accepted, BROADCAST_ROWS), "v", "left_semi").select(
        "h1", "h2", F.struct(F.col("s"), F.lit(len(KINDS)).alias("o"), F.col("e"), F.lit(DISCOVERED).alias("kind")).alias("x"))
    return stored(spans.groupBy("h1", "h2").agg(F.array_sort(F.collect_set("x")).alias("found")), "pii-spans")


def find_pii(docs: DataFrame) -> DataFrame:
    """``docs`` (with text) and: base (array of spans: s, o, e, kind), spans (with the discovered
    ones), n_email, n_ip, n_card, n_phone, ordered by start and kind."""
    extra = small_side(discovered(docs), BROADCAST_ROWS)
    df = with_base(docs)
    df = df.withColumns(dict(zip(["__h1", "__h2"], _text_key("__t"), strict=True)))
    df = df.join(extra, (F.col("__h1") == F.col("h1")) & (F.col("__h2") == F.col("h2")), "left")
    df = df.withColumn("base", F.array_sort(F.concat(*[_flat(k) for k in KINDS])))
    df = df.withColumn("spans", F.when(F.col("found").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "found"))))
    return df.withColumns({f"n_{k}": F.size(f"__{k}").cast("long") for k in KINDS}).drop(
        "__t", "__h1", "__h2", "h1", "h2", "found", *[f"__{k}" for k in KINDS])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its text replaced by the name of its kind in angle brackets;
    a text without spans, null too, stays as it is."""
    keep = docs.columns
    df = find_pii(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row"), F.col("text")))
    start = F.struct(F.lit(0).alias("p"), F.lit("").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        put = F.concat(acc["out"], F.substring(F.col("text"), acc["p"] + 1, m["s"] - acc["p"]), F.lit("<"), F.upper(m["kind"]), F.lit(">"))
        hidden = m["s"] < acc["p"]  # overlaps one that was replaced: its rest goes too
        return F.struct(F.greatest(acc["p"], m["e"]).alias("p"), F.when(hidden, acc["out"]).otherwise(put).alias("out"))

    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["p"] + 1, F.length("text"))))
    df = df.withColumn("__new", F.when(F.size("spans") > 0, done).otherwise(F.col("text")))
    return df.select(*[F.col("__new").alias("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in keep])


def op8_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_pii(docs).select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                                 _joined(F.col("spans")).alias("spans"))
