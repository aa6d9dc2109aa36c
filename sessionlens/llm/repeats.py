"""Removal of long repeats by a run-length index.

A byte goes if it is in a string of ``LENGTH`` bytes that also starts elsewhere, in any document. The
corpus is indexed in buckets: a window of LENGTH bytes holds an anchor, the run of ``GRAM`` bytes
with its least hash, so equal windows meet in the bucket of their anchor. What surrounds an anchor
that occurs twice or more, as far as the windows reach that it is the anchor of, is a segment; equal
segments are one, with a count. For each bucket the
index keeps the sorted suffixes of its segments as runs of the Burrows-Wheeler transform with
match lengths at the ends of runs, and streams the matching statistics of the segments from the
right to the left (``runindex``); statistics of LENGTH and more mark windows.

Documents that have a copy are marked whole, and one of them is indexed. A bucket with more than
``BUCKET_ROWS`` different segments, as at the edge of a passage that many documents hold, is sorted
over all partitions by what follows the anchor and by what precedes it, backwards. Neighbours tell
how far a segment can match another at all, on either side; it is cut to that, and equal ones become one again.
The windows of a segment that occurs twice are marked before the cut.
What is still too large is split by ranges of window starts, each range keyed by the bytes that all
its windows share; in the end, a range of one start is keyed by the window itself, and a count decides.
So no task holds an unbounded bucket, and nothing is left out.

Defined cases: null text is empty; texts under LENGTH bytes keep everything; repeated rows are copies
of each other; a null doc_id keeps its row; marked runs that touch are one span; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, clashless, gathered, small_batches, small_side, stored, table
from .runindex import aligned, anchors, common_prefix, repeated_starts

LENGTH = 200
GRAM = 50
BUCKET_ROWS = 4096
#: Window starts in a range that a large bucket is split into.
RANGE = 13
BROADCAST_ROWS = 500_000
#: Segments that are cut out of texts at once.
SEGMENT_ROWS = 20_000
#: Bytes of text that are hashed at once.
BATCH_BYTES = 1 << 19


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, b (bytes), t1, t2 (what names a text), n_bytes."""
    own = clashless(docs, ["doc_id", "text"]).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    return own.withColumns({"t1": F.xxhash64("b"), "t2": F.xxhash64(F.lit(17), "b"), "n_bytes": F.octet_length("b").cast("long")})


def _anchor_rows(length: int, gram: int):
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("pos", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("g", pa.int64())])

    def pieces(text: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """A long text in pieces that overlap by a window less a byte."""
        for s in range(0, max(1, len(text) - length + 1), BATCH_BYTES):
            yield s, text[s:s + BATCH_BYTES + length - 1]

    def made(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        sizes = np.array([len(r[3]) for r in rows])
        ends = np.cumsum(sizes)
        at, h, lo, hi = anchors(np.concatenate([r[3] for r in rows]), ends, length, gram)
        row = np.searchsorted(ends, at, side="right")
        pos = at - (ends - sizes)[row] + np.array([r[2] for r in rows])[row]
        return pa.RecordBatch.from_arrays([
            pa.array(np.array([r[0] for r in rows])[row], pa.int64()), pa.array(np.array([r[1] for r in rows])[row], pa.int64()),
            *[pa.array(x.astype(np.int32)) for x in (pos, lo, hi)], pa.array(h.view(np.int64))], schema=schema)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, held = [], 0
            for t1, t2, b in zip(part.column("t1").to_pylist(), part.column("t2").to_pylist(), part.column("b"), strict=True):
                text = np.frombuffer(b.as_buffer(), np.uint8)
                if len(text) > BATCH_BYTES:
                    # each window is in one piece, so an anchor near a cut can come twice, for other windows
                    yield from (made([(t1, t2, s, piece)]) for s, piece in pieces(text))
                    continue
                rows.append((t1, t2, 0, text))
                held += len(text)
                if held >= BATCH_BYTES:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)

    return run, "t1 long, t2 long, pos int, lo int, hi int, g long"


def _segment_rows(length: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames, lambda p: p.str.len(), "pos", SEGMENT_ROWS):
            texts, row = list(f.b), np.repeat(np.arange(len(f)), [len(p) for p in f.pos])
            pos, g, lo, hi = (np.concatenate(list(f[c])) for c in ("pos", "g", "lo", "hi"))
            t1, t2 = f.t1.to_numpy()[row], f.t2.to_numpy()[row]
            for k in range(0, len(pos), SEGMENT_ROWS):
                c = slice(k, k + SEGMENT_ROWS)
                start, end = (pos - hi)[c], (pos - lo)[c] + length
                yield pd.DataFrame({"t1": t1[c], "t2": t2[c], "pos": pos[c], "g": g[c], "left": hi[c], "seg": [
                    texts[r][x:y] for r, x, y in zip(row[c].tolist(), start.tolist(), end.tolist(), strict=True)]})

    return run, "t1 long, t2 long, pos int, g long, left int, seg binary"


def _buckets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames of whole buckets, from frames that are sorted by bucket."""
    rest = None
    for f in gathered(frames, SEGMENT_ROWS):
        f = f if rest is None else pd.concat([rest, f], ignore_index=True)
        g = f.g.to_numpy()
        change = np.flatnonzero(g[1:] != g[:-1]) + 1
        cut = int(change[-1]) if len(change) else 0
        if cut:
            yield f.iloc[:cut].reset_index(drop=True)
        rest = f.iloc[cut:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest


def _marks(length: int, gram: int):
    side = length - gram

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in _buckets(frames):
            several = f.g.map(f.g.value_counts()).to_numpy() > 1
            f = f[several]
            for (lo, hi), own in f.groupby(["lo", "hi"], sort=True):
                group = own.g.diff().ne(0).cumsum().to_numpy()
                found = repeated_starts(group, aligned(list(own.seg), own.left.to_numpy(), side, 2 * length - gram),
                                        side, int(lo), int(hi), length, gram)
                edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
                r, begin = np.nonzero(edge == 1)
                _, end = np.nonzero(edge == -1)
                yield pd.DataFrame({"s1": own.s1.to_numpy()[r], "s2": own.s2.to_numpy()[r],
                                    "a_lo": (begin + lo).astype(np.int32), "a_hi": (end - 1 + lo).astype(np.int32)})

    return run, "s1 long, s2 long, a_lo int, a_hi int"


def _split(rows: DataFrame, width: int, length: int) -> DataFrame:
    """The rows of large buckets (with left, seg) dealt to ranges of ``width`` window starts; the new
    bucket is the hash of the bytes that all windows of the range share."""
    least = F.col("left") + length - F.octet_length("seg")  # the window of the row that starts last
    parts = F.filter(F.transform(F.sequence(F.col("lo"), F.col("hi"), F.lit(width)), lambda a: F.struct(
        a.alias("lo"), F.least(a + width - 1, F.col("hi")).alias("hi"))), lambda r: (r["lo"] <= F.col("left")) & (r["hi"] >= least))
    keyed = F.transform(parts, lambda r: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi"), F.xxhash64(
        F.col("g"), r["lo"], F.substring(F.col("seg"), F.col("left") - r["lo"] + 1, r["lo"] + length - r["hi"])).alias("g")))
    return rows.select("s1", "s2", "n", F.explode(keyed).alias("k")).select("k.g", "s1", "s2", "n", "k.lo", "k.hi")


def _reach(rows: DataFrame, context: Column, name: str) -> DataFrame:
    """s1, s2, and as ``name`` how many bytes of the ``context`` (hexadecimal text) of each of ``rows``
    another row of its bucket shares: the longer match with its two neighbours in order of the
    context. The order runs over all partitions; what borders on another partition is matched
    with its neighbour there, two rows a partition."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, first = None, True
        for f in gathered(frames, SEGMENT_ROWS):
            f = f if rest is None else pd.concat([rest, f], ignore_index=True)
            same = np.concatenate([[False], f.g.to_numpy()[1:] == f.g.to_numpy()[:-1]])
            up = np.where(same, common_prefix(list(f.c)) // 2, 0)
            if rest is not None:
                up[0] = held
            best, held = np.maximum(up, np.append(up[1:], 0)), up[-1]
            out = f.assign(reach=best, edge=np.where(first & (np.arange(len(f)) == 0), 1, 0))
            yield out.iloc[:-1].assign(c=out.c.where(out.edge > 0, None))[cols]
            rest = f.iloc[-1:]
            first = first and len(f) == 1
        if rest is not None:
            yield rest.assign(reach=held, edge=2 + first)[cols]

    cols = ["part", "g", "s1", "s2", "c", "reach", "edge"]
    order = ["g", "c", "s1"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("g", "s1", "s2", context.alias("c")).repartitionByRange(n, *order).sortWithinPartitions(*order)
    found = stored(dealt.withColumn("part", F.spark_partition_id()).mapInPandas(
        run, "part int, g long, s1 long, s2 long, c string, reach int, edge int"), "repeat-reach")
    edges = found.filter("edge > 0").orderBy("part", "edge").collect()
    more = []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if a.part != b.part and a.g == b.g:
            k = int(common_prefix([a.c, b.c])[1]) // 2
            more += [(a.s1, a.s2, k), (b.s1, b.s2, k)]
    out = found.select("s1", "s2", "reach")
    if more:
        out = out.unionByName(rows.sparkSession.createDataFrame(more, "s1 long, s2 long, reach int"))
    return out.groupBy("s1", "s2").agg(F.max("reach").alias(name))


def _cut_to_reach(hot: DataFrame, length: int, gram: int) -> DataFrame:
    """The rows of large buckets, cut to the windows that can match by what precedes and by what follows
    the anchor: o1, o2 (their names before), and g, s1, s2, left, n, seg."""
    side = length - gram
    seg = F.col("seg")
    before = F.reverse(F.hex(F.substring(seg, F.lit(1), F.col("left"))))
    after = F.hex(F.substring(seg, F.col("left") + gram + 1, F.octet_length(seg)))
    cut = hot.join(_reach(hot, before, "rl"), ["s1", "s2"]).join(_reach(hot, after, "rr"), ["s1", "s2"])
    cut = cut.withColumns({"hi": F.least("left", "rl"), "lo": F.greatest(F.col("left") + length - F.octet_length(seg), F.lit(side) - F.col("rr"))})
    cut = cut.filter("lo <= hi").select("g", F.col("s1").alias("o1"), F.col("s2").alias("o2"), "n", F.col("hi").alias("left"),
                                        F.substring(seg, F.col("left") - F.col("hi") + 1, F.col("hi") - F.col("lo") + length).alias("seg"))
    return cut.withColumns(_names())


def _names() -> dict[str, Column]:
    """What names a segment."""
    return {"s1": F.xxhash64("g", "left", "seg"), "s2": F.xxhash64(F.lit(17), "left", "seg")}


def _once(segments: DataFrame, n: Column) -> DataFrame:
    """One row for equal segments."""
    return stored(segments.groupBy("g", "s1", "s2", "left").agg(n.alias("n"), F.first("seg").alias("seg")), "repeat-segments")


def _twice(once: DataFrame, length: int) -> DataFrame:
    """s1, s2, a_lo, a_hi of the segments that occur twice: all of their windows do."""
    return once.filter("n > 1").select("s1", "s2", (F.col("left") + length - F.octet_length("seg")).alias("a_lo"), F.col("left").alias("a_hi"))


def _indexed(once: DataFrame, length: int, gram: int, bucket_rows: int) -> list[DataFrame]:
    """Tables of s1, s2, a_lo, a_hi for the different segments ``once`` (a stored table)."""
    side = length - gram
    out = [_twice(once, length)]
    rows = once.withColumns({"lo": F.lit(0), "hi": F.lit(side)})
    for width in (RANGE, 1, 0):
        sizes = stored(rows.groupBy("g").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).filter("n > 1"), "repeat-buckets")
        if not width:  # the bucket is the window
            out.append(rows.join(sizes.select("g"), "g", "left_semi").select("s1", "s2", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi")))
            break
        large = stored(sizes.filter(F.col("rows") > bucket_rows).select("g"), "repeat-large")
        n_large = large.count()
        small = rows.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, "g", "left_anti") if n_large else rows
        if "seg" not in small.columns:
            small = small.join(small_side(sizes.select("g"), BROADCAST_ROWS), "g", "left_semi").join(once.select("s1", "s2", "left", "seg"), ["s1", "s2"])
        run, schema = _marks(length, gram)
        dealt = small.repartition("g").sortWithinPartitions("g", "s1", "s2").select("g", "s1", "s2", "left", "lo", "hi", "seg")
        out.append(dealt.mapInPandas(run, schema))
        if not n_large:
            break
        hot = rows.join(small_side(large, BROADCAST_ROWS), "g", "left_semi")
        if "seg" not in hot.columns:
            hot = hot.join(once.select("s1", "s2", "left", "seg"), ["s1", "s2"])
        rows = stored(_split(hot, width, length), "repeat-ranges")
    return out


def marked_windows(segments: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """s1, s2, a_lo, a_hi: the windows of each segment that start a_lo to a_hi bytes before its anchor
    stand elsewhere too. ``segments`` is a stored table of g, left, seg, s1, s2, a row for each occurrence."""
    once = _once(segments, F.count("*"))
    large = stored(once.groupBy("g").agg(F.count("*").alias("rows")).filter(F.col("rows") > bucket_rows).select("g"), "repeat-large")
    if large.count():
        side = small_side(large, BROADCAST_ROWS)
        hot = once.join(side, "g", "left_semi")
        cut = stored(_cut_to_reach(hot, length, gram), "repeat-cut")
        found = _indexed(_once(cut, F.sum("n")), length, gram, bucket_rows)
        found = [cut.select("s1", "s2", "o1", "o2").join(m, ["s1", "s2"]).select(F.col("o1").alias("s1"), F.col("o2").alias("s2"), "a_lo", "a_hi") for m in found]
        # the cut is to what other segments share; the copies of a segment share all of it
        found += [_twice(hot, length), *_indexed(once.join(side, "g", "left_anti"), length, gram, bucket_rows)]
    else:
        found = _indexed(once, length, gram, bucket_rows)
    marks = found[0]
    for m in found[1:]:
        marks = marks.unionByName(m)
    return stored(marks.distinct(), "repeat-marks")


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The texts of ``docs``; t1, t2 of texts with copies; and t1, t2, spans (array of start, end)
    of the texts without copies that have marked bytes."""
    small_batches(docs.sparkSession)
    texts = _texts(docs)
    long = texts.filter(F.col("n_bytes") >= length)
    copies = stored(long.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")).filter("n > 1"), "repeat-copies")
    indexed = long.join(small_side(copies, BROADCAST_ROWS), ["t1", "t2"], "left").filter(
        F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("rep"))).select("t1", "t2", "b")
    run, schema = _anchor_rows(length, gram)
    found = stored(indexed.mapInArrow(run, schema), "repeat-anchors")
    # stored, so that the join below isn't in one stage with the sum and its skewed partitions can be split
    again = stored(found.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g"), "repeat-again")
    per_text = stored(found.join(again, "g").groupBy("t1", "t2").agg(F.collect_list(F.struct("pos", "lo", "hi", "g")).alias("a")).select(
        "t1", "t2", *[F.col(f"a.{c}").alias(c) for c in ("pos", "lo", "hi", "g")]), "repeat-anchors-of-texts")
    touched = indexed.join(small_side(per_text.select("t1", "t2"), BROADCAST_ROWS), ["t1", "t2"], "left_semi").join(per_text, ["t1", "t2"])
    run, schema = _segment_rows(length)
    segments = stored(touched.select("t1", "t2", "b", "pos", "lo", "hi", "g").mapInPandas(run, schema).withColumns(_names()), "repeat-occurrences")
    marks = marked_windows(segments, length, gram, bucket_rows)
    spans = (segments.select("t1", "t2", "pos", "s1", "s2").join(marks, ["s1", "s2"])
             .select("t1", "t2", F.struct((F.col("pos") - F.col("a_hi")).alias("start"), (F.col("pos") - F.col("a_lo") + length).alias("end")).alias("x"))
             .join(small_side(copies.select("t1", "t2"), BROADCAST_ROWS), ["t1", "t2"], "left_anti")
             .groupBy("t1", "t2").agg(F.collect_set("x").alias("x")).select("t1", "t2", F.col("x.start").alias("start"), F.col("x.end").alias("end")))
    return texts, copies.select("t1", "t2"), stored(spans, "repeat-spans")


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans, as runs in order."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return list(zip(start[first].tolist(), reach[np.append(first[1:] - 1, len(start) - 1)].tolist(), strict=True))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every row of ``docs``."""
    texts, copies, spans = repeats(docs, length, gram, bucket_rows)
    rest = texts.join(small_side(copies.withColumn("copy", F.lit(True)), BROADCAST_ROWS), ["t1", "t2"], "left")
    ids = small_side(spans.select("t1", "t2", F.lit(True).alias("marked")), BROADCAST_ROWS)
    rest = rest.join(ids, ["t1", "t2"], "left")
    whole = F.col("copy").isNotNull()
    plain = rest.filter("marked IS NULL").select("doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(0).alias("n_removed"),
                                               whole.cast("long").alias("n_spans"), F.when(whole, F.lit("").cast("binary")).otherwise(F.col("b")).alias("kept"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            runs = [merged(s, e) for s, e in zip(f.start, f.end, strict=True)]
            yield pd.DataFrame({"doc_id": f.doc_id, "n_bytes": f.n_bytes, "n_removed": [sum(e - s for s, e in r) for r in runs],
                                "n_spans": [len(r) for r in runs], "kept": [
                b"".join(b[x:y] for x, y in zip([0, *(e for _, e in r)], [*(s for s, _ in r), len(b)], strict=True)) for b, r in zip(f.b, runs, strict=True)]})

    some = rest.filter("marked").select(F.col("doc_id").cast("string").alias("doc_id"), "n_bytes", "b", "t1", "t2").join(spans, ["t1", "t2"])
    done = some.select("doc_id", "n_bytes", "b", "start", "end").mapInPandas(cut, "doc_id string, n_bytes long, n_removed long, n_spans long, kept binary")
    return plain.unionByName(done.withColumn("doc_id", F.col("doc_id").cast("long")))


def op1_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its long repeats."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """n_removed, n_spans, kept_sha256 of each text, from a table of all windows; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            w = t[i:i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, np.int64)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1 if i + length <= len(t) else 0
        cover = np.cumsum(gone)[:len(t)] > 0
        kept = bytes(b for b, c in zip(t, cover, strict=True) if not c)
        out.append((int(cover.sum()), int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
