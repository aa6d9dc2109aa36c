"""Global order without a single-partition window, by one path at every size.

Three primitives used by ranks, precision-recall curves, exact quantiles, the
temporal split and shard numbering:

``value_buckets``    range buckets from approximate quantiles + ``Bucketizer``: a pure,
                     deterministic function of the value (safe to recompute after an
                     executor loss), as many as there are shuffle partitions.
``running_totals``   inclusive prefix sums over the value order: per-bucket totals
                     (<= n_buckets rows) give each bucket an offset, a window partitioned
                     by bucket does the rest. Input has one row per distinct value, so a
                     hot value is one row and cannot overload a bucket.
``exact_quantiles``  linear-interpolation quantiles (pandas/numpy default) located by
                     prefix counts instead of buffering every value in one task.
``file_positions``   0-based line numbers over files, from one count per file block.
``row_index``        0-based global row number in a total order: range partition, sort,
                     stored rows, per-partition counts as offsets.

What is above an ordered table is read once: the table (distinct values with counts, or
the rows to be numbered) is stored first, and the sketch, the totals and the window read
the stored copy.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import epoch_micros
from ..session import small_side, stored

BUCKET = "_bucket"


def order_number(df: DataFrame, col: str) -> Column:
    """A double that never falls along the order of ``col``; equal doubles of different
    values are left to the native order within a bucket.

    Timestamps become epoch microseconds. Strings become the six bytes after what the
    smallest and the largest have in common (one aggregate over ``df``, a stored table).
    """
    t = dict(df.dtypes)[col]
    c = F.col(col)
    if t.startswith("timestamp") or t == "date":
        return epoch_micros(c).cast("double")
    if t == "string":
        r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
        lo, hi = (r.lo or "").encode(), (r.hi or "").encode()
        same = next((i for i, (a, b) in enumerate(zip(lo, hi, strict=False)) if a != b), min(len(lo), len(hi)))
        six = F.rpad(F.hex(F.substring(c.cast("binary"), same + 1, 6)), 12, "0")
        return F.conv(six, 16, 10).cast("double")
    return c.cast("double")


def default_buckets(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def value_buckets(df: DataFrame, col: str, n_buckets: int | None = None,
                  rel_err: float = 1e-3, out: str = BUCKET) -> DataFrame:
    """Add ``out`` = range bucket of ``col`` (quantile-balanced; nulls in the lowest, NaN
    in the highest).

    The split points come from one approximate-quantile pass (n-1 doubles reach the
    driver); the bucket is then a pure function of the value.
    """
    n_buckets = n_buckets or default_buckets(df)
    tmp = f"_{out}_in"
    x = order_number(df, col)
    df = df.withColumn(tmp, F.coalesce(x, F.lit(-math.inf)))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    # the sketch error must stay well below one bucket (1/n of the rows) for balance
    qs = df.approxQuantile(tmp, probs, min(rel_err, 0.25 / n_buckets)) if probs else []
    inner = sorted({float(q) for q in qs if q is not None and math.isfinite(q)})
    splits = [-math.inf, *inner, math.inf] if inner else [-math.inf, 0.0, math.inf]
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=out, handleInvalid="keep")
    return b.transform(df).drop(tmp).withColumn(out, F.col(out).cast("int"))


def running_totals(df: DataFrame, order_col: str, sum_cols: Sequence[str], descending: bool = False,
                   n_buckets: int | None = None, prefix: str = "cum_", tiebreak: Sequence[str] = (),
                   group_cols: Sequence[str] = (), is_stored: bool = False) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in ``order_col`` order (nulls lowest),
    restarted for every combination of ``group_cols``.

    Expects one row per distinct (group, ``order_col``) unless ``tiebreak`` columns make
    the order total. Result: input columns + ``prefix+c`` for each ``c``.
    """
    g = list(group_cols)
    base = df if is_stored else stored(df, "totals")
    oc = F.col(order_col).desc() if descending else F.col(order_col).asc()
    b = value_buckets(base, order_col, n_buckets)
    totals = b.groupBy(*g, BUCKET).agg(*[F.sum(c).alias(c) for c in sum_cols])
    bo = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    # one row per (group, bucket): without groups at most n_buckets rows
    w_b = (Window.partitionBy(*g) if g else Window).orderBy(bo).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_g_{c}") for c in g], F.col(BUCKET).alias("_ob"),
                            *[F.coalesce(F.sum(c).over(w_b), F.lit(0)).alias(f"_off_{c}") for c in sum_cols])
    same = F.col(BUCKET) == F.col("_ob")
    for c in g:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    b = b.join(offsets if g else F.broadcast(offsets), same, "left").drop("_ob", *[f"_g_{c}" for c in g])
    w = Window.partitionBy(*g, BUCKET).orderBy(oc, *[F.col(t) for t in tiebreak]) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for c in sum_cols:
        b = b.withColumn(prefix + c, F.sum(c).over(w) + F.col(f"_off_{c}"))
    return b.drop(BUCKET, *[f"_off_{c}" for c in sum_cols])


def value_counts_cumulative(df: DataFrame, col: str, n_buckets: int | None = None,
                            group_cols: Sequence[str] = ()) -> DataFrame:
    """(groups, _v, _c, cum__c, _n): distinct non-null, non-NaN values per group with
    counts, inclusive prefix count and the group's total. ``df`` is read once."""
    g = list(group_cols)
    x = F.col(col).cast("double")
    v = stored(df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*g, x.alias("_v"))
               .agg(F.count(F.lit(1)).alias("_c")), "values")
    cum = running_totals(v, "_v", ["_c"], n_buckets=n_buckets, group_cols=g, is_stored=True)
    total = v.groupBy(*g).agg(F.sum("_c").alias("_n"))
    return cum.join(total, g) if g else cum.crossJoin(F.broadcast(total))  # one row


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float],
                    n_buckets: int | None = None, group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles of ``col`` (nulls and NaN skipped).

    Returns one row per (group, requested probability): (groups, prob, value); value
    is null when the group has no value. Position h = p*(n-1); the answer is
    x[floor h] + (h - floor h) * (x[floor h + 1] - x[floor h]), with x located by
    prefix counts over distinct values instead of buffering values in one task.
    """
    spark = df.sparkSession
    g = list(group_cols)
    cum = value_counts_cumulative(df, col, n_buckets, g)
    p = spark.range(1).select(F.explode(F.array(*[F.lit(float(x)) for x in probs])).alias("prob"))  # len(probs) rows
    cum = cum.withColumn("_before", F.col("cum__c") - F.col("_c"))
    pos = F.col("prob") * (F.col("_n") - 1)
    lo = F.floor(pos)
    hi = F.ceil(pos)
    cover = ((F.col("_before") <= lo) & (lo < F.col("cum__c"))) | \
            ((F.col("_before") <= hi) & (hi < F.col("cum__c")))
    hit = cum.join(F.broadcast(p), cover, "inner")
    agg = hit.groupBy(*g, "prob").agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first(pos - lo).alias("_frac"))
    val = F.col("_lo") + F.col("_frac") * (F.col("_hi") - F.col("_lo"))
    if g:
        return agg.select(*g, "prob", val.alias("value"))
    return p.join(agg, "prob", "left").select("prob", val.alias("value"))


def row_index(df: DataFrame, order_cols: Sequence, name: str = "row_idx",
              n_parts: int | None = None) -> DataFrame:
    """Add a 0-based global row number in ``order_cols`` order (names sort ascending,
    Column sort expressions such as ``F.col(x).desc()`` are used as given).

    Range partitioning splits a hot value of the first column across partitions by the
    later columns; the sorted, numbered rows are stored, so partition ids and
    per-partition counts stay consistent if executors are lost.
    """
    n = n_parts or default_buckets(df)
    s = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    s = stored(s.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()), "rows")
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_pc"))  # <= n rows
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_pid", F.coalesce(F.sum("_pc").over(w), F.lit(0)).alias("_poff"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return s.join(F.broadcast(offs), "_pid").withColumn(name, (local + F.col("_poff")).cast("long")) \
        .drop("_pid", "_mid", "_poff")


def average_rank_pct(df: DataFrame, cols: Sequence[str], prefix: str = "p_",
                     n_buckets: int | None = None) -> DataFrame:
    """Percentile rank with ties averaged, nulls and NaN skipped (pandas ``rank(pct=True)``)
    for several columns in one pass.

    pct = (rows strictly below + (ties + 1) / 2) / non-null rows; null stays null.
    The columns are melted into (name, value) rows, ranked per name on distinct values,
    and each column is joined back on its value; rows without a value carry a key of their
    own each, so that they don't meet in one partition.
    """
    cols = list(cols)
    melted = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_name"), F.col(c).cast("double").alias("_x"))
                                           for c in cols])).alias("_m")).select("_m._name", "_m._x")
    cum = value_counts_cumulative(melted, "_x", n_buckets, group_cols=["_name"])
    pct = stored(cum.select("_name", "_v", ((F.col("cum__c") - F.col("_c") + (F.col("_c") + 1) / 2.0)
                                            / F.col("_n")).alias("_pct")), "ranks")
    out = df
    for c in cols:
        one = small_side(pct.where(F.col("_name") == c).select(F.lit(0).cast("long").alias(f"_s_{c}"), F.col("_v").alias(f"_v_{c}"),
                                                               F.col("_pct").alias(prefix + c)))
        x = F.col(c).cast("double")
        salt = F.when(x.isNull(), F.monotonically_increasing_id() + 1).otherwise(F.lit(0).cast("long"))
        out = out.withColumn("_salt", salt).join(one, (F.col("_salt") == F.col(f"_s_{c}")) & (x == F.col(f"_v_{c}")), "left") \
            .drop(f"_v_{c}", f"_s_{c}", "_salt")
    return out


def file_positions(lines: DataFrame, name: str = "pos", n_buckets: int | None = None) -> DataFrame:
    """0-based position of every line in (file, block, line) order, for a table that
    ``read_text_lines`` gives: a prefix sum over one count per file block, and the place
    within the block. The text is neither sorted nor copied."""
    block = ["file_path", "block_start"]
    per = lines.groupBy(*block).agg(F.count(F.lit(1)).alias("_n"), F.min("row_in_split").alias("_first"))
    # paths and block starts in one string that orders as the pair does
    per = per.withColumn("_key", F.concat("file_path", F.lit("\x00"), F.lpad(F.col("block_start").cast("string"), 20, "0")))
    offs = stored(running_totals(per, "_key", ["_n"], n_buckets=n_buckets)
                  .select(*block, "_first", (F.col("cum__n") - F.col("_n")).alias("_off")), "blocks")
    return lines.join(small_side(offs), block) \
        .withColumn(name, F.col("_off") + F.col("row_in_split") - F.col("_first")).drop("_off", "_first")


def grouped_positions(df: DataFrame, group_col: str, within_col: str, name: str = "pos",
                      n_buckets: int | None = None) -> DataFrame:
    """0-based global position in (group, within) order when ``within`` is already a
    dense 0-based index inside each group (e.g. line numbers inside a document).

    pos = (rows of all earlier groups) + within: a prefix sum over one row per group,
    joined back on the group. Nothing is globally sorted or copied, unlike
    ``row_index``; a hot group only makes its join key skewed (AQE splits it). Groups may
    be numbers, timestamps or strings (file paths); they are ordered as Spark orders them.
    """
    counts = df.groupBy(F.col(group_col).alias("_grp")).agg(F.count(F.lit(1)).alias("_gn"))
    cum = running_totals(counts, "_grp", ["_gn"], n_buckets=n_buckets)
    offs = cum.select("_grp", (F.col("cum__gn") - F.col("_gn")).alias("_goff"))
    return df.join(offs, F.col(group_col).eqNullSafe(F.col("_grp"))) \
        .withColumn(name, (F.col("_goff") + F.col(within_col)).cast("long")).drop("_goff", "_grp")
