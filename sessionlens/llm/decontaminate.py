"""Benchmark decontamination by template canonicalisation.

Names (runs of capitalised words, also where a sentence begins), units after a number, and numbers become
typed placeholders, what is left becomes lower-case words without punctuation. Windows of five tokens of these
templates are hash-joined with the windows of the benchmark items. A place in a document that holds at least 0.8 of the
distinct windows of an item is a candidate, whatever stands elsewhere in the document; the values in its
placeholders are then aligned with those of the item, and it counts as a copy if each value of the
item stands for one value throughout: the same question, word for word or with other names and
numbers. The document holds the item if any of its places does.

Items with one template and one pattern of equal values are found alike, so they are looked for once, as a class. A
document that holds the class is reported with the item whose values it has, else with the smallest id: a row for each
document and class, however many items a class has.

A place is a shift between the tokens of the document and those of the item. It is judged by the windows
at that shift alone, and by the nearest window of each kind at most the item's length away,
as words that are put in or left out shift what follows; windows further apart are no copy.

Windows with fewer than two words between their placeholders say nothing and are left out. An item that has no other
window, or less than five tokens, is matched whole: its words and numbers as one or more whole sentences or lines of the document.

Only candidates have their placeholder values taken out. The windows of documents aren't
shuffled while the windows of the benchmark are few enough to be broadcast (their rows
are counted); beyond that both sides are shuffled on the window.

Defined cases: null texts are empty; an item without a word or number is never reported; items with equal
templates and values are reported as the smallest id among them; a row without a doc_id can't be named and isn't
examined; repeated document rows each get the result of their id's texts; an empty
table on either side reports nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import clashless, small_side, stored, table

WINDOW = 5
SIMILARITY = 0.8
#: Share of an item's placeholder values that must be consistent.
CONSISTENCY = 0.9
#: Words that a window must have besides placeholders.
LITERALS = 2
#: Most windows of the benchmark that are broadcast.
BROADCAST_WINDOWS = 1_000_000
#: Most documents with a candidate that are broadcast: they grow with the corpus.
BROADCAST_TEXTS = 200_000

#: Units of measure and money that follow a number.
UNITS = ("kilometers kilometres km kilograms kilogram kg grams gram g mg meters metres meter metre m cm mm miles mile mi "
         "inches inch feet foot ft yards yard pounds pound lbs lb ounces oz liters litres liter litre l ml hours hour h "
         "minutes minute min seconds second s days day weeks week months month years year mph kmh dollars dollar euros "
         "euro cents cent percent gallons gallon degrees degree").split()
#: Order of the passes: each sees the text as the one before has left it. A name is a run of
#: capitalised words. The first word of a sentence may be one, and stands for itself in a copy if it isn't.
PASSES = (
    ("name", r"(?<![\p{L}\p{N}])(\p{Lu}\p{L}*+(?:\x20\p{Lu}\p{L}*+)*+)", " \x01 "),
    ("unit", rf"([0-9]\x20?)({'|'.join(UNITS)})([^\p{{L}}\p{{N}}]|$)", "$1 \x02 $3"),
    ("number", r"([0-9]+(?:[.,:/][0-9]+)*)", " \x03 "),
)
MARKS = {"name": "\x01", "unit": "\x02", "number": "\x03"}
GROUP = {"name": 1, "unit": 2, "number": 1}
#: What ends a sentence or line, in the tokens of items that are matched whole.
STOP = "\x04"


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, which grows with the documents, for a join that never broadcasts it. Tables of hits are a few bytes a row as Parquet,
    which the planner goes by, and a hundred in the driver's memory."""
    return df.hint("merge")


def found_side(df: DataFrame) -> DataFrame:
    """``df``, a stored table of documents: broadcast while it has ``BROADCAST_TEXTS`` rows at most, else shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_TEXTS else shuffled(df)


def _steps(text: Column) -> list[Column]:
    """The text before each pass, and after the last."""
    out = [F.translate(F.coalesce(text, F.lit("")), "\x01\x02\x03", "   ")]
    for _, pattern, mark in PASSES:
        out.append(F.regexp_replace(out[-1], pattern, mark))
    return out


def template(text: Column) -> Column:
    """Tokens of the canonical form: lower-case words and placeholders."""
    clean = F.trim(F.regexp_replace(F.lower(_steps(text)[-1]), r"[^\p{L}\p{N}\x01-\x03]+", " "))
    return F.filter(F.split(clean, " "), lambda x: x != "")


def windows(tokens: Column) -> Column:
    """Hashes of the windows of WINDOW tokens, by position; none for shorter arrays."""
    return F.when(F.size(tokens) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(tokens) - WINDOW), lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(WINDOW)])))


def _placed(kind: str, values: str) -> Column:
    """Array of pos, kind, value: the kind's k-th placeholder in ``__tok`` has its k-th value."""
    pos = F.expr(f"filter(transform(__tok, (x, i) -> CASE WHEN x = '{MARKS[kind]}' THEN i END), i -> i IS NOT NULL)")
    return F.transform(F.arrays_zip(pos.alias("pos"), F.col(values).alias("value")),
                       lambda z: F.struct(z["pos"].alias("pos"), F.lit(kind).alias("kind"), z["value"].alias("value")))


def slots(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, kind, value of each placeholder of the template of ``text``."""
    steps = _steps(F.col(text))
    df = df.select(key, template(F.col(text)).alias("__tok"),
                   *[F.regexp_extract_all(steps[k], F.lit(p), F.lit(GROUP[n])).alias(f"__v{k}") for k, (n, p, _) in enumerate(PASSES)])
    found = [_placed(n, f"__v{k}") for k, (n, _, _) in enumerate(PASSES)]
    return df.select(key, F.explode(F.concat(*found)).alias("s")).select(key, "s.pos", "s.kind", "s.value")


def items_of(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes to look for: item_id (the smallest of the class), text, template tokens, n_slots; and their members: class_id, item_id, values
    (a hash of the values in the item's placeholders). Both are stored."""
    own = stored(benchmark_texts(benchmark).groupBy("text").agg(F.min("item_id").alias("item_id")), "decon-items")
    placed = F.array_sort(F.collect_list(F.struct("pos", "kind", "value")))
    values = slots(own, "item_id", "text").groupBy("item_id").agg(placed.alias("v"))
    # the place where each value of a kind stands first: what has to be equal for the item to be consistent
    first = F.transform("v", lambda x: F.array_position(F.transform("v", lambda y: F.struct(y["kind"], y["value"])), F.struct(x["kind"], x["value"])))
    none = F.array().cast("array<struct<pos:int,kind:string,value:string>>")
    full = own.join(values, "item_id", "left").withColumn("v", F.coalesce("v", none)).withColumns({"tokens": template(F.col("text")), "pattern": first})
    full = full.withColumn("values", value_hash(F.transform("v", lambda x: x["value"])))
    classes = full.groupBy("tokens", "pattern").agg(F.min(F.struct("item_id", "text")).alias("x"), F.size(F.first("v")).alias("n_slots"))
    classes = stored(classes.select("x.item_id", "x.text", "tokens", "pattern", "n_slots"), "decon-classes")
    members = full.join(classes.select(F.col("item_id").alias("class_id"), "tokens", "pattern"), ["tokens", "pattern"]).groupBy("class_id", "values").agg(F.min("item_id").alias("item_id"))
    return classes.drop("pattern"), stored(members, "decon-members")


def value_hash(values: Column) -> Column:
    return F.xxhash64(F.lit(3), values)


def whole_tokens(text: Column) -> Column:
    """Lower-case words and numbers, with a mark wherever a sentence or line ends, and at both ends."""
    cut = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), STOP, " "), r"[.!?]+(?=\s|$)|[\r\n]+", f" {STOP} ")
    clean = F.concat(F.lit(STOP + " "), F.regexp_replace(F.lower(cut), rf"[^\p{{L}}\p{{N}}{STOP}]+", " "), F.lit(" " + STOP))
    clean = F.regexp_replace(clean, rf"{STOP}(?:\x20*{STOP})+", STOP)
    return F.filter(F.split(clean, " "), lambda x: x != "")


def whole_leaks(own: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of the documents ``own`` that hold one of ``items`` (those without telling windows) whole. Texts are
    read once; each length of such an item costs a hash for each token."""
    texts = stored(items.select("item_id", whole_tokens(F.col("text")).alias("w")).filter("size(w) > 2"), "decon-whole")
    sizes = sorted(r[0] for r in texts.select(F.size("w")).distinct().collect())  # distinct lengths of items
    if not sizes:
        return own.sparkSession.createDataFrame([], "doc_id long, item_id long").select(F.col("doc_id").cast(own.schema["doc_id"].dataType), "item_id")
    tokens = F.col("__w")

    def runs_of(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.xxhash64(F.slice(tokens, i + 1, n)))
        return F.when(F.size(tokens) >= n, every).otherwise(F.array().cast("array<bigint>"))

    runs = [runs_of(n) for n in sizes]
    wanted = texts.groupBy(F.xxhash64("w").alias("h")).agg(F.min("item_id").alias("item_id"))
    hashed = own.withColumn("__w", whole_tokens(F.col("text"))).select("doc_id", F.explode(F.array_distinct(F.concat(*runs))).alias("h"))
    return hashed.join(small_side(stored(wanted, "decon-whole-items"), BROADCAST_WINDOWS), "h").select("doc_id", "item_id").distinct()


def item_windows(items: DataFrame) -> DataFrame:
    """h, item_id, ipos, n (windows of the item), size (its tokens) of each distinct telling window of each item."""
    marks = ", ".join(f"'{m}'" for m in MARKS.values())
    told = items.select("item_id", "tokens", F.size("tokens").alias("size"), F.posexplode(windows(F.col("tokens"))).alias("ipos", "h")).filter(
        F.expr(f"size(filter(slice(tokens, ipos + 1, {WINDOW}), x -> x NOT IN ({marks}))) >= {LITERALS}"))
    first = told.groupBy("item_id", "size", "h").agg(F.min("ipos").alias("ipos"))
    sizes = first.groupBy("item_id").agg(F.count("*").alias("n"))
    return first.join(sizes, "item_id").select("h", "item_id", "ipos", "n", "size")


def occurrences(hits: DataFrame, pair: list[str], similarity: float) -> tuple[DataFrame, DataFrame]:
    """The places of items in texts: by ``at`` (the shift of an occurrence) and ``reach``, the chosen
    windows (ipos, far: distance and shift), and the occurrences with enough of them (coverage).
    ``hits`` is a stored table of ``pair`` (n, size among it), ipos, shift."""
    place = [*pair, "at", "reach"]
    cell = lambda x: F.floor(x / F.col("size"))
    # every shift may be an occurrence: by itself, and with what lies within the item's length
    at = hits.select(*pair, F.col("shift").alias("at"), F.explode(F.array(F.lit(0), "size")).alias("reach")).distinct()
    at = at.withColumn("cell", F.explode(F.sequence(cell(F.col("at") - F.col("reach")), cell(F.col("at") + F.col("reach")))))
    near = at.join(shuffled(hits.withColumn("cell", cell(F.col("shift")))), [*pair, "cell"]).withColumn("d", F.abs(F.col("shift") - F.col("at"))).filter("d <= reach")
    chosen = stored(near.groupBy(*place, "ipos").agg(F.min(F.struct("d", "shift")).alias("far")), "decon-chosen")
    # windows that stand in the text by chance, or twice in the item, have shifts of few others
    by_shift = chosen.groupBy(*place, "far.shift").agg(F.count("*").alias("k"))
    found = by_shift.groupBy(*place).agg(F.sum("k").alias("k"), F.max("k").alias("most"), F.max(F.when(F.col("shift") == F.col("at"), F.col("k"))).alias("same"))
    found = found.filter((F.col("k") >= similarity * F.col("n")) & (F.col("same") >= F.col("most")))
    return chosen, stored(found.select("doc_id", "t", "item_id", "at", "reach", (F.col("k") / F.col("n")).alias("coverage")), "decon-found")


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, consistency: float = CONSISTENCY) -> DataFrame:
    """A row per document and class of items found in it: doc_id, item_id, coverage, consistent, verbatim,
    n_slots, of the occurrence with the most coverage among those that pass. ``consistent`` is the
    share of the item's values that stand for one value in the occurrence, ``verbatim`` whether an item of the class
    has the very values; that item is named."""
    items, members = items_of(benchmark)
    wanted = stored(item_windows(items), "decon-windows")
    own = clashless(docs, ["doc_id", "text"]).filter("doc_id IS NOT NULL").withColumn("t", F.xxhash64("text"))
    # templates are hashed within the row, so that each word's window costs a hash and a probe
    hashed = own.withColumn("__tok", template(F.col("text"))).select("doc_id", "t", F.posexplode(windows(F.col("__tok"))).alias("pos", "h"))
    pair = ["doc_id", "t", "item_id", "n", "size"]
    hits = stored(hashed.join(small_side(wanted, BROADCAST_WINDOWS), "h").select(*pair, "ipos", (F.col("pos") - F.col("ipos")).alias("shift")), "decon-hits")
    enough = hits.groupBy(*pair).agg(F.count_distinct("ipos").alias("k")).filter(F.col("k") >= similarity * F.col("n")).drop("k")
    hits = stored(hits.join(shuffled(enough), pair, "left_semi").distinct(), "decon-candidates")
    chosen, found = occurrences(hits, pair, similarity)
    # the values of the candidates' placeholders, aligned with the item's
    place = ["doc_id", "t", "item_id", "at", "reach"]
    texts = own.join(found_side(stored(found.select("doc_id", "t").distinct(), "decon-texts")), ["doc_id", "t"], "left_semi")
    ours = slots(texts.dropDuplicates(["doc_id", "t"]).select(F.struct("doc_id", "t").alias("key"), "text"), "key", "text").select(
        "key.doc_id", "key.t", "pos", "kind", F.col("value").alias("got"))
    theirs = small_side(stored(slots(items, "item_id", "text").select("item_id", F.col("pos").alias("ipos"), "kind", F.col("value").alias("asked")), "decon-slots"),
                        BROADCAST_WINDOWS)
    held = chosen.join(shuffled(found.select(*place)), place, "left_semi").select(
        *place, F.explode(F.sequence(F.col("ipos"), F.col("ipos") + WINDOW - 1)).alias("ipos"), "far")
    held = held.groupBy(*place, "ipos").agg(F.min("far").alias("far"))
    pairs = (found.select(*place).join(theirs, "item_id").join(shuffled(held), [*place, "ipos"], "left")
             .withColumn("pos", F.col("ipos") + F.coalesce("far.shift", "at")).join(shuffled(ours), ["doc_id", "t", "pos", "kind"]))
    pairs = stored(pairs, "decon-values")
    values = pairs.groupBy(*place, "kind", "asked").agg(
        (F.min("got") == F.max("got")).alias("one"), (F.min("got").eqNullSafe(F.col("asked")) & F.max("got").eqNullSafe(F.col("asked"))).alias("same"))
    checked = values.groupBy(*place).agg(F.avg(F.col("one").cast("double")).alias("consistent"), F.min("same").alias("same"), F.count("*").alias("n_values"))
    # the values of an occurrence in the order of the item's placeholders: at most as many as the item has
    has = pairs.groupBy(*place).agg(value_hash(F.transform(F.array_sort(F.collect_list(F.struct("ipos", "got"))), lambda x: x["got"])).alias("values"), F.count("*").alias("n_got"))
    passed = (found.join(shuffled(checked), place, "left").join(shuffled(has), place, "left").fillna({"consistent": 1.0, "same": True, "n_values": 0, "n_got": 0})
              .filter(F.col("consistent") >= consistency).withColumn("values", F.coalesce("values", value_hash(F.array().cast("array<string>")))))
    named = small_side(members.select(F.col("class_id").alias("item_id"), "values", F.col("item_id").alias("named")), BROADCAST_WINDOWS)
    passed = passed.join(small_side(items.select("item_id", F.col("n_slots").alias("__n")), BROADCAST_WINDOWS), "item_id").join(named, ["item_id", "values"], "left")
    # where words that are put in hide some of the values, those of the class's first item are compared one by one
    passed = passed.withColumn("named", F.when(F.col("n_got") == F.col("__n"), F.col("named")))
    passed = passed.withColumns({"named": F.coalesce("named", F.when(F.col("same"), F.col("item_id"))), "verbatim": F.col("named").isNotNull() | F.col("same")})
    best = passed.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "verbatim", "consistent", "n_values", (-F.col("named")).alias("named"))).alias("x"))
    best = best.select("doc_id", F.when(F.col("x.verbatim"), -F.col("x.named")).otherwise(F.col("item_id")).alias("item_id"), "x.coverage", "x.consistent", "x.verbatim",
                       F.col("x.n_values").alias("n_slots"))
    mute = benchmark_texts(benchmark).join(members, "item_id").join(wanted.select(F.col("item_id").alias("class_id")).distinct(), "class_id", "left_anti")
    whole = whole_leaks(own, mute.select("item_id", "text"))
    return best.unionByName(whole.select("doc_id", "item_id", F.lit(1.0).alias("coverage"), F.lit(1.0).alias("consistent"), F.lit(True).alias("verbatim"), F.lit(0).cast("long").alias("n_slots")))


def benchmark_texts(benchmark: DataFrame) -> DataFrame:
    return clashless(benchmark, ["item_id", "text"]).filter("item_id IS NOT NULL AND text IS NOT NULL")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    bad = stored(leaks(docs, benchmark).select("doc_id").distinct(), "decon-bad")
    return docs.join(found_side(bad), "doc_id", "left_anti").select(*docs.columns)


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document, whether it holds a benchmark item, and which."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks(docs, table(spark, sf_dir, "benchmark")).groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_set("item_id")), lambda x: x.cast("string")), ",").alias("items"),
        F.max("coverage").alias("coverage"))
    ids = docs.select("doc_id")
    return ids.join(shuffled(found), "doc_id", "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items", F.lit("")).alias("items"), F.round(F.coalesce("coverage", F.lit(0.0)), 6).alias("coverage"))
