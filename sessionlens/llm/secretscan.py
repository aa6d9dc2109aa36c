"""Secrets by their form, and by a battery of randomness tests.

Base: assignments to names like password or token, access keys, and long hexadecimal runs. The
method adds tokens that look random: runs of 16 or more characters of the usual encodings, outside
the base spans. For each distinct token the smallest encoding that holds it is inferred (hexadecimal, also in
groups, base 32, 36, 62, 64), and three statistics are taken over its characters:

- chi-squared of the alphabet's uniformity, over 4 or (from 48 characters on) 12 equal parts of it;
- runs: how often the class of a character (digit, lower, upper, other) changes;
- serial correlation of the characters' places in the alphabet, at lag one.

A random token passes all three (none under ``LEVEL`` / 3). That alone says little of a short token, which
passes by chance, so a second question is asked: how likely would structured text of that length, made of the token's main
class with some changes of class, give a chi-squared as low and as many runs? Both answers, which become sharper with length, are
put together (Stouffer), and the tokens are tested against each other by the procedure of Benjamini and Hochberg, each
weighted by its length, so that of what is reported a share of ``RATE`` is expected to be structured. p-values are
rounded up to a hundred steps for each power of ten, which makes the procedure a sum over a short table of counts.

A text is read once; what follows works on the tokens. Spans are code points, end exclusive.

Defined cases: null text is empty; a null doc_id keeps its row; repeated rows get the same spans, and a token counts
once however often it occurs; U+0001 is read as U+0002; spans of different base kinds may overlap,
``random`` spans never overlap a base span; a token of no known encoding isn't tested; very long texts are
searched whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_side, stored, table

KINDS = ("assign", "access", "hex")
RANDOM = "random"
_VALUE = "[A-Za-z0-9+/_.=-]"
ASSIGN = rf"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?({_VALUE}+)"
#: A match that is long enough. Runs are maximal, so the least length can stand in the pattern, except
#: for assignments, where a short match uses up its text.
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{14,}+", "hex": "(?<![0-9a-f])[0-9a-f]{16,}+"}
#: What a text must have before a pattern is tried on it.
NEEDS = PATTERNS | {"assign": "(?i:passw|secret|token|api_?key)"}
LEAST_VALUE = 12
_RUN = "[A-Za-z0-9+/_-]"
TOKEN = rf"(?<!{_RUN}){_RUN}{{16,}}+={{0,2}}"
LEAST = 16
MARK = "\x01"

LEVEL = 0.01
RATE = 0.05
#: Share of neighbours in structured text whose classes differ.
SWITCH = 0.2
#: From this length on the alphabet is cut into more parts.
LONG = 48
PARTS, LONG_PARTS = 4, 12
#: Steps of rounded p-values for a power of ten, and the smallest one told apart.
STEPS, SMALLEST = 100, 60
BROADCAST_ROWS = 500_000

SPAN = "struct<s:int,e:int,v:string>"


# ---------------------------------------------------------------- base

def _matches(text: str, pattern: str, needs: str) -> Column:
    """Array of SPAN of the matches in column ``text``: the running length of what marks cut it into."""
    pieces = F.when(F.col(text).rlike(needs), F.split(F.regexp_replace(text, pattern, MARK + "$0" + MARK), MARK, -1)).otherwise(F.array(F.col(text)))
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        end = acc["p"] + F.length(x)
        more = F.concat(acc["a"], F.array(F.struct(acc["p"].alias("s"), end.alias("e"), x.alias("v"))))
        return F.struct(end.alias("p"), (acc["i"] + 1).alias("i"), F.when(acc["i"] % 2 == 1, more).otherwise(acc["a"]).alias("a"))

    start = F.struct(F.lit(0).alias("p"), F.lit(0).alias("i"), none.alias("a"))
    return F.when(F.size(pieces) > 1, F.aggregate(pieces, start, step, lambda acc: acc["a"])).otherwise(none)


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with arrays of SPAN: ``__assign``, ``__access``, ``__hex``, and ``__token``, what the method tests."""
    df = docs.withColumn("__t", F.translate(F.coalesce(F.col(text), F.lit("")), MARK, "\x02"))
    df = df.withColumns({f"__{k}": _matches("__t", PATTERNS[k], NEEDS[k]) for k in KINDS} | {"__token": _matches("__t", TOKEN, TOKEN)})
    df = df.withColumn("__assign", F.filter("__assign", lambda m: F.length(F.regexp_extract(m["v"], ASSIGN, 2)) >= LEAST_VALUE))
    taken = F.concat(*[f"__{k}" for k in KINDS])
    free = F.filter("__token", lambda m: ~F.exists(taken, lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"])))
    return df.withColumn("__token", F.when(F.size("__token") > 0, free).otherwise(F.col("__token"))).drop("__t")


def _flat(k: str) -> Column:
    return F.transform(f"__{k}", lambda m: F.struct(m["s"].alias("s"), F.lit(KINDS.index(k)).alias("o"), m["e"].alias("e"), F.lit(k).alias("kind")))


# ---------------------------------------------------------------- the battery

_DIGITS, _LOWER, _UPPER = string.digits, string.ascii_lowercase, string.ascii_uppercase


@dataclass(frozen=True)
class Encoding:
    """``form`` is what a token of it looks like; ``folded``: both cases stand for the same; ``grouped``: without its hyphens."""

    name: str
    form: str
    alphabet: str
    folded: bool = False
    grouped: bool = False

    def classes(self) -> dict[str, int]:
        """Class -> how many characters of the alphabet."""
        out: dict[str, int] = {}
        for c in self.alphabet:
            out[class_of(c)] = out.get(class_of(c), 0) + 1
        return out

    def parts(self, m: int) -> list[float]:
        """Share of the alphabet in each of its ``m`` parts."""
        k = len(self.alphabet)
        return [sum(x * m // k == j for x in range(k)) / k for j in range(m)]

    def excess(self, m: int, main: str) -> float:
        """Chi-squared that each character of the class ``main`` adds over the parts."""
        k, own = len(self.alphabet), [0] * m
        for x, c in enumerate(self.alphabet):
            own[x * m // k] += class_of(c) == main
        return sum((o / sum(own)) ** 2 / p for o, p in zip(own, self.parts(m), strict=True)) - 1

    def changes(self) -> tuple[float, float]:
        """For random neighbours: the probability that classes differ, and the covariance of two such events in a row."""
        shares = [n / len(self.alphabet) for n in self.classes().values()]
        same = sum(x ** 2 for x in shares)
        return 1 - same, sum(x ** 3 for x in shares) - same ** 2


def class_of(c: str) -> str:
    return "d" if c in _DIGITS else "l" if c in _LOWER else "u" if c in _UPPER else "o"


#: Smallest first: the first form that fits is inferred.
ENCODINGS = (
    Encoding("hex", "^([0-9a-f]+(-[0-9a-f]+)*|[0-9A-F]+(-[0-9A-F]+)*)$", _DIGITS + "abcdef", True, True),
    Encoding("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    Encoding("base36", "^([a-z0-9]+|[A-Z0-9]+)$", _DIGITS + _LOWER, True),
    Encoding("base62", "^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    Encoding("base64", "^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    Encoding("base64url", "^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)


def tail(z: Column) -> Column:
    """Probability that a standard normal value is above z (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    q = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z < 0, 1 - q).otherwise(q)


def _per_encoding(value) -> Column:
    """A number that depends on the encoding alone."""
    out = F.lit(None).cast("double")
    for e in ENCODINGS:
        out = F.when(F.col("encoding") == e.name, F.lit(value(e))).otherwise(out)
    return out


def battery(tokens: DataFrame) -> DataFrame:
    """``tokens`` (v) and: encoding (null: none fits), n (characters tested), p_uniform, p_runs, p_serial (two-sided but the first), p_text:
    the probability that structured text looks as random."""
    bare = F.regexp_replace("v", "=+$", "")
    name, core = F.lit(None).cast("string"), bare
    for e in reversed(ENCODINGS):
        fits = bare.rlike(e.form)
        name = F.when(fits, F.lit(e.name)).otherwise(name)
        now = F.regexp_replace(bare, "-", "") if e.grouped else bare
        core = F.when(fits, F.lower(now) if e.folded else now).otherwise(core)
    df = tokens.withColumns({"encoding": name, "core": core}).withColumn("n", F.length("core")).filter(F.col("encoding").isNotNull() & (F.col("n") >= LEAST))
    df = df.withColumns({"alphabet": _per_encoding_text(), "k": _per_encoding(lambda e: len(e.alphabet)).cast("int"), "m": F.when(F.col("n") >= LONG, LONG_PARTS).otherwise(PARTS)})
    df = df.withColumns({"x": F.expr("transform(filter(split(core, ''), c -> c <> ''), c -> locate(c, alphabet) - 1)"),
                         "w": F.translate("core", _DIGITS + _LOWER + _UPPER + "+/-_", "d" * 10 + "l" * 26 + "u" * 26 + "oooo")})
    df = df.withColumns({
        "chi": F.expr("""aggregate(sequence(0, m - 1), 0D, (a, j) -> a + pow(size(filter(x, i -> i * m div k = j)) - n * (ceil((j + 1) * k / m) - ceil(j * k / m)) / k, 2)
                         / (n * (ceil((j + 1) * k / m) - ceil(j * k / m)) / k))"""),
        "switches": F.expr("size(filter(sequence(2, n), i -> substr(w, i, 1) <> substr(w, i - 1, 1)))"),
        "main": F.expr("array_max(transform(array('d', 'l', 'u', 'o'), c -> named_struct('n', n - length(replace(w, c, '')), 'c', c))).c"),
        "mean": F.expr("aggregate(x, 0D, (a, i) -> a + i) / n")})
    df = df.withColumns({"ss": F.expr("aggregate(x, 0D, (a, i) -> a + pow(i - mean, 2))"),
                         "cross": F.expr("aggregate(sequence(0, n - 1), 0D, (a, i) -> a + (x[i] - mean) * (x[(i + 1) % n] - mean))")})
    n, free = F.col("n"), F.col("m") - 1
    cube = (F.pow(F.col("chi") / free, 1 / 3) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    differ, cov = _per_encoding(lambda e: e.changes()[0]), _per_encoding(lambda e: e.changes()[1])
    z_runs = (F.col("switches") - (n - 1) * differ) / F.sqrt((n - 1) * differ * (1 - differ) + 2 * (n - 2) * cov)
    z_serial = F.when(F.col("ss") > 0, (F.col("cross") / F.col("ss") + 1 / (n - 1)) * F.sqrt(n)).otherwise(F.sqrt(n))
    excess = F.lit(None).cast("double")
    for e in ENCODINGS:
        for m in (PARTS, LONG_PARTS):
            for c in e.classes():
                excess = F.when((F.col("encoding") == e.name) & (F.col("m") == m) & (F.col("main") == c), F.lit(e.excess(m, c))).otherwise(excess)
    z_text = (free + n * excess - F.col("chi")) / F.sqrt(2 * free + 4 * n * excess)
    z_switch = (F.col("switches") - 0.5 - (n - 1) * SWITCH) / F.sqrt((n - 1) * SWITCH * (1 - SWITCH))
    return df.select("v", "encoding", "n", tail(cube).alias("p_uniform"), (2 * tail(F.abs(z_runs))).alias("p_runs"),
                     (2 * tail(F.abs(z_serial))).alias("p_serial"), tail((z_text + z_switch) / math.sqrt(2)).alias("p_text"))


def _per_encoding_text() -> Column:
    out = F.lit(None).cast("string")
    for e in ENCODINGS:
        out = F.when(F.col("encoding") == e.name, F.lit(e.alphabet)).otherwise(out)
    return out


def discoveries(tested: DataFrame, rate: float = RATE, level: float = LEVEL) -> DataFrame:
    """v of the tokens of ``tested`` (a stored table of ``battery``) that are reported."""
    size = tested.agg(F.count("*").alias("tests"), F.avg("n").alias("mean"))
    weighted = F.col("p_text") * F.col("mean") / F.col("n")  # p over a weight of mean one
    step = F.least(F.greatest(F.floor(-F.log10(F.greatest(weighted, F.lit(10.0 ** -SMALLEST))) * STEPS), F.lit(0)), F.lit(SMALLEST * STEPS)).cast("int")
    df = tested.join(F.broadcast(size)).withColumn("step", step)  # one row
    # at most SMALLEST * STEPS + 1 rows: how many tokens have a p-value of 10^(-step / STEPS) at most
    counts = df.groupBy("step", "tests").agg(F.count("*").alias("k"))
    total = counts.alias("a").join(counts.select(F.col("step").alias("s"), F.col("k").alias("j")), F.col("s") >= F.col("step")).groupBy("step", "tests").agg(F.sum("j").alias("k"))
    edge = total.filter(F.pow(F.lit(10.0), -F.col("step") / STEPS) <= rate * F.col("k") / F.col("tests")).agg(F.min("step").alias("edge"))
    passes = F.least("p_uniform", "p_runs", "p_serial") >= level / 3
    return df.join(F.broadcast(edge)).filter(passes & (F.col("step") >= F.col("edge"))).select("v")


# ---------------------------------------------------------------- spans

def find_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` (with text) and: base and spans (arrays of s, o, e, kind, in order), n_assign, n_access, n_hex."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    found = with_base(docs.select(row.alias("__row"), "text")).withColumn("__id", F.monotonically_increasing_id())
    found = stored(found.select("__row", "__id", F.array_sort(F.concat(*[_flat(k) for k in KINDS])).alias("base"), "__token",
                                *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS]), "secrets-found")
    tokens = found.select("__id", F.explode("__token").alias("m")).select("__id", "m.*")
    tested = stored(battery(tokens.select("v").distinct()), "secrets-tested")
    good = small_side(stored(discoveries(tested), "secrets-random"), BROADCAST_ROWS)
    one = F.struct("s", F.lit(len(KINDS)).alias("o"), "e", F.lit(RANDOM).alias("kind"))
    extra = stored(tokens.join(good, "v", "left_semi").groupBy("__id").agg(F.collect_list(one).alias("more")), "secrets-spans")
    df = found.drop("__token").join(small_side(extra, BROADCAST_ROWS), "__id", "left")
    df = df.withColumn("spans", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))))
    return df.select(*[F.col("__row").getField(c).alias(c) for c in keep], *[f"n_{k}" for k in KINDS], "base", "spans")


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m["kind"], m["s"].cast("string"), m["e"].cast("string"))), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_secrets(docs).select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
