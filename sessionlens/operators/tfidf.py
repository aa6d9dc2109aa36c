"""TF-IDF session features.

``relational_tfidf`` (F8) computes (session, term, weight) with joins and aggregates
only and is the oracle-checkable form; ``fit_featurizer`` (F2-F7) is the Spark ML
form producing a sparse vector per session for the models.

Term semantics (both forms): tokens = Unicode ``\\b\\w+\\b`` runs of the lower-cased
text; terms = unigrams + bigrams of consecutive tokens in session order, crossing line
borders (the session document is one string); vocabulary = terms in at least
``min_df`` fit documents, the ``max_features`` most frequent (ties by term);
idf = ln((1 + n) / (1 + df)) + 1; weight = raw count * idf, L2-normalised per session.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas import factorize
from pandas.util import hash_array
from pyspark import Broadcast
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import (CountVectorizer, ElementwiseProduct, IDF, NGram, Normalizer,
                                RegexTokenizer, SQLTransformer, VectorAssembler)
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..functions.text import TOKEN_PATTERN, tokens
from ..session import small_side, stored
from .ordered import row_index, running_totals

MIN_DF = 2
MAX_FEATURES = 120_000
CHUNK = 4096
SLICE = 1 << 20  # values of lists that a task works on at a time
SMALL_VOCABULARY = 500_000  # terms that every Python worker may hold


def line_terms(lines: DataFrame, key: str, pos: str, text: str, chunk: int = CHUNK, ties: Sequence[str] = ()) -> DataFrame:
    """(key, term) rows: unigrams, bigrams inside a line, and the bigram joining the last
    token of the previous token-bearing line to the first token of the next one.

    Each line is tokenised once. The previous token comes from a window inside
    (key, pos chunk); the first line of a chunk takes the last token of the previous
    non-empty chunk from a per-chunk summary (one row per chunk). No window ever holds a
    whole session, and all terms of a line come out of one explode. ``ties`` put lines of one
    position in order.
    """
    p = F.col(pos)
    if dict(lines.dtypes)[pos].startswith("timestamp"):
        # times don't tell how many lines lie between them: chunks are cut by the lines' number
        lines = row_index(lines.where(F.col(key).isNotNull()).select(key, pos, *ties, text), [key, pos, *ties], "_place")
        p, ties = F.col("_place"), ()
    t = lines.where(F.col(key).isNotNull()).select(F.col(key), p.alias("_pos"), F.struct(p.alias("_p"), *ties).alias("_at"), tokens(text).alias("_tok")) \
        .withColumn("_chunk", F.floor(F.col("_pos") / F.lit(chunk)))
    n = F.size("_tok")
    last_tok = F.when(n > 0, F.element_at("_tok", -1))
    w_in = Window.partitionBy(key, "_chunk").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_prev", F.last(last_tok, ignorenulls=True).over(w_in))
    # the summary reads the same windowed rows (no extra filter), so the (key, chunk)
    # exchange and the tokenising are shared with the main branch
    summ = t.groupBy(key, "_chunk").agg(F.max_by(last_tok, F.when(n > 0, F.col("_at"))).alias("_clast"))
    w_c = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.select(key, "_chunk", F.last("_clast", ignorenulls=True).over(w_c).alias("_pclast"))
    t = t.join(summ, [key, "_chunk"], "left")
    prev = F.coalesce(F.col("_prev"), F.col("_pclast"))
    cross = F.when((n > 0) & prev.isNotNull(), F.array(F.concat(prev, F.lit(" "), F.col("_tok")[0])))
    inner = F.when(n > 1, F.zip_with(F.slice("_tok", 1, n - 1), F.slice("_tok", 2, n - 1),
                                     lambda a, b: F.concat(a, F.lit(" "), b)))
    empty = F.array().cast("array<string>")
    allt = F.concat(F.col("_tok"), F.coalesce(inner, empty), F.coalesce(cross, empty))
    return t.select(key, F.explode(allt).alias("term"))


def term_counts(terms: DataFrame, key: str) -> DataFrame:
    """(key, term, tf) with map-side partial counting."""
    return terms.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def _lengths(a: pa.Array) -> np.ndarray:
    """How many values each list, or packed list, of a column has."""
    size = pc.binary_length(a) if pa.types.is_binary(a.type) else pc.list_value_length(a)
    return size.to_numpy(zero_copy_only=False) // (4 if pa.types.is_binary(a.type) else 1)


def _packed(ends: np.ndarray, x: np.ndarray) -> pa.Array:
    """Lists of small numbers as bytes, which cost Spark as much to hand on as a single value."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(x.astype(np.int32))])


def _unpacked(a: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(a.to_pylist()), np.int32)


def _in_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose lists in ``column`` have ``most`` values at most together; a row with more is on its own."""
    for b in batches:
        ends = np.cumsum(_lengths(b.column(column)))
        begin = 0
        while begin < len(ends):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
            yield b.slice(begin, end - begin)
            begin = end


def term_pieces(lines: DataFrame, key: str, pos: str, text: str, chunk: int = CHUNK, ties: Sequence[str] = (), most: int = SLICE) -> DataFrame:
    """(key, _chunk, _piece, _first, _last, _words, _left, _right, _counts): the distinct tokens of a piece with spaces
    between, its distinct unigrams and bigrams (as places of tokens in _words; _right is one more, and 0 for a unigram) and how often each occurs there,
    all three packed, and the piece's first and last token. A piece is what one batch has of a (key, pos chunk): consecutive lines in order, of ``most`` tokens or a single line.

    Each line is tokenised once, and its terms are counted before they become rows. No task has to hold a whole session: the pieces of a key are
    in the order of (_chunk, _piece). ``ties`` put lines of one position in order. Pieces without a token are left out.
    """
    own = lines.where(F.col(key).isNotNull())
    if dict(lines.dtypes)[pos].startswith("timestamp"):
        # times don't tell how many lines lie between them: chunks are cut by the lines' number
        own, pos, ties = row_index(own.select(key, pos, *ties, text), [key, pos, *ties], "_place"), "_place", ()
    by = [c for c in dict.fromkeys([pos, *ties]) if c != key]
    rows = own.select(key, F.floor(F.col(pos) / F.lit(chunk)).cast("long").alias("_chunk"), F.struct(*by).alias("_at"), F.col(text).alias("_text"))
    rows = rows.repartition(key, "_chunk").sortWithinPartitions(key, "_chunk", "_at").select(key, "_chunk", tokens("_text").alias("_tok"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for no, b in enumerate(_in_slices(batches, "_tok", most)):
            words = b.column("_tok").flatten()
            if not len(words):
                continue
            keys, chunks = b.column(0), b.column("_chunk").fill_null(np.iinfo(np.int64).min)
            new = np.ones(len(b), bool)
            new[1:] = pc.or_(pc.not_equal(keys[1:], keys[:-1]), pc.not_equal(chunks[1:], chunks[:-1])).to_numpy(zero_copy_only=False)
            of = np.repeat(np.cumsum(new) - 1, _lengths(b.column("_tok")))
            coded = words.dictionary_encode()
            names, i = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            # a number for each (piece, token, next token + 1, or 0 for the token alone)
            k = len(names) + 1
            inside = of[1:] == of[:-1]
            terms, n = np.unique(np.concatenate([(of * k + i) * k, ((of[:-1] * k + i[:-1]) * k + i[1:] + 1)[inside]]), return_counts=True)
            terms, second = np.divmod(terms, k)
            piece, first = np.divmod(terms, k)
            alone = second == 0
            some, at, size = np.unique(of, return_index=True, return_counts=True)
            words_at = np.append(np.searchsorted(piece[alone], some), alone.sum())
            start = np.repeat(words_at[:-1], np.diff(terms_at := np.append(np.searchsorted(piece, some), len(piece))))
            left = np.cumsum(alone) - 1 - start
            right = np.where(alone, 0, np.searchsorted((piece * k + first)[alone], piece * k + second - 1) - start + 1)
            own = pa.ListArray.from_arrays(pa.array(words_at.astype(np.int32)), names.take(pa.array(first[alone])))
            row = pa.array(np.flatnonzero(new)[some])
            yield pa.RecordBatch.from_arrays([
                keys.take(row), b.column("_chunk").take(row), pa.array(np.full(len(some), no, np.int64)), words.take(pa.array(at)), words.take(pa.array(at + size - 1)),
                pc.binary_join(own, " "), *[_packed(terms_at, x) for x in (left, right, n)]], names=[key, "_chunk", "_piece", "_first", "_last", "_words", "_left", "_right", "_counts"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(counted, f"`{key}` {kind}, _chunk bigint, _piece bigint, _first string, _last string, _words string, "
                           "_left binary, _right binary, _counts binary")


def _coded(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The tokens of a batch of pieces, and for each term the place of its first token there and the one after the place of its second (0: none)."""
    words = pc.split_pattern(b.column("_words"), " ")  # no token has a space
    coded = words.flatten().dictionary_encode()
    code, size = coded.indices.to_numpy().astype(np.int64), _lengths(words)
    start = np.repeat(np.cumsum(size) - size, _lengths(b.column("_counts")))
    left, right = _unpacked(b.column("_left")), _unpacked(b.column("_right"))
    return coded.dictionary, code[start + left], np.where(right > 0, code[start + right - 1] + 1, 0)


def _spelt(names: pa.Array, left: np.ndarray, right: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(names.take(pa.array(left)), names.take(pa.array(right - 1, mask=right == 0)), " ", null_handling="skip")


def _numbers(names: pa.Array, left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """A number for each term, the same in every task; different terms seldom have the same one."""
    h = np.append(np.uint64(0), hash_array(np.array(names.to_pylist(), dtype=object), categorize=False))
    x = h[left + 1] * np.uint64(0x9E3779B97F4A7C15) + h[right]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) >> np.uint64(64 - bits)).view(np.int64)


def _rows_of(pieces: DataFrame, key: str) -> DataFrame:
    """(key, term, tf) rows of pieces."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _in_slices(batches, "_counts"):
            row = np.repeat(np.arange(len(b)), _lengths(b.column("_counts")))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), _spelt(*_coded(b)), pa.array(_unpacked(b.column("_counts")).astype(np.int64))], names=[key, "term", "tf"])

    return pieces.select(key, "_words", "_left", "_right", "_counts").mapInArrow(rows, f"`{key}` {pieces.schema[key].dataType.simpleString()}, term string, tf bigint")


def _joining(pieces: DataFrame, key: str) -> DataFrame:
    """(key, term, tf): the bigrams of the last token of a piece and the first token of the key's next one."""
    w = Window.partitionBy(key).orderBy("_chunk", "_piece")
    ends = pieces.select(key, F.concat(F.lag("_last").over(w), F.lit(" "), F.col("_first")).alias("term"), F.lit(1).cast("bigint").alias("tf"))
    return ends.where(F.col("term").isNotNull())


def _split(pieces: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The pieces that are all of their key, and (key, term, tf) of the keys with several pieces, from ``pieces``, a stored table. Only the latter
    have to be brought together."""
    several = small_side(stored(pieces.groupBy(key).count().where(F.col("count") > 1).select(key), "split-keys"))
    parts = pieces.join(several, key, "left_semi")
    summed = _rows_of(parts, key).unionByName(_joining(parts, key)).groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    return pieces.join(several, key, "left_anti"), stored(summed, "term-counts")


def _edge(d: DataFrame, max_features: int) -> tuple[int, int] | None:
    """The count at rank ``max_features`` of a table of counts ``cnt``, and how many rows of that very count are within the rank; None if there aren't so many rows."""
    by_count = running_totals(d.groupBy("cnt").agg(F.count(F.lit(1)).alias("terms")), "cnt", ["terms"], descending=True)
    edge = by_count.where(F.col("cum_terms") >= max_features).orderBy("cum_terms").limit(1).collect()
    return (edge[0]["cnt"], max_features - (edge[0]["cum_terms"] - edge[0]["terms"])) if edge else None


def _most_frequent(d: DataFrame, max_features: int) -> DataFrame:
    """The ``max_features`` most frequent terms (ties by term) of ``d``, a stored table."""
    # the count at rank max_features, from the number of terms of each count; only terms of that
    # very count are put in order
    edge = _edge(d, max_features)
    if edge is None:
        return d
    cnt, room = edge
    ties = row_index(d.where(F.col("cnt") == cnt), ["term"], "_i").where(F.col("_i") < room).drop("_i")
    return d.where(F.col("cnt") > cnt).unionByName(ties)


def vocabulary(tf: DataFrame, key: str, min_df: int = MIN_DF, max_features: int | None = MAX_FEATURES) -> DataFrame:
    """(term, df, cnt, term_idx): terms in >= min_df documents, the max_features most
    frequent by corpus count (ties by term). Size is bounded by max_features."""
    d = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cnt")).where(F.col("df") >= min_df)
    return _most_frequent(stored(d, "terms"), max_features) if max_features else d


def _numbered_vocabulary(whole: DataFrame, rest: DataFrame, min_df: int, max_features: int, bits: int) -> DataFrame | None:
    """``vocabulary`` with each term's number ``id``, from the pieces ``whole`` and the rows ``rest``. Numbers are counted first, and the terms
    only of those that are frequent enough: a number occurs as often as its terms at least, so none that belongs in is left out.
    None if two of these terms have one number, or if there are more than SMALL_VOCABULARY of them (many of the last rank's count)."""
    def tallies(held: Broadcast | None):
        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _in_slices(batches, "_counts", 2 * SLICE):
                names, left, right = _coded(b)
                x, cnt = _numbers(names, left, right, bits), _unpacked(b.column("_counts"))
                if held is not None:
                    # here the terms are kept apart, whatever their numbers
                    known = _places(held.value, x) >= 0
                    x, cnt = (left * (len(names) + 1) + right)[known], cnt[known]
                of, x = factorize(x)
                sums = [pa.array(np.bincount(of, minlength=len(x))), pa.array(np.bincount(of, cnt, len(x)).astype(np.int64))]
                if held is None:
                    yield pa.RecordBatch.from_arrays([pa.array(x), *sums], names=["id", "df", "cnt"])
                else:
                    left, right = np.divmod(x, len(names) + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(_numbers(names, left, right, bits)), *sums, _spelt(names, left, right)], names=["id", "df", "cnt", "term"])
        return tally

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair = pc.split_pattern(b.column("term"), " ")
            size = _lengths(pair)
            coded = pair.flatten().dictionary_encode()
            code, at = coded.indices.to_numpy().astype(np.int64), np.cumsum(size)
            x = _numbers(coded.dictionary, code[at - size], np.where(size > 1, code[at - 1] + 1, 0), bits)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.ones(len(b), np.int64)), b.column("tf"), b.column("term")], names=["id", "df", "cnt", "term"])

    kind, terms = "id bigint, df bigint, cnt bigint", ["_words", "_left", "_right", "_counts"]
    others = stored(rest.select("term", "tf").mapInArrow(numbered, f"{kind}, term string"), "numbers")
    sums = F.sum("df").alias("df"), F.sum("cnt").alias("cnt")
    found = whole.select(*terms).mapInArrow(tallies(None), kind).unionByName(others.drop("term")).groupBy("id").agg(*sums)
    found = stored(found.where(F.col("df") >= min_df), "numbers")
    edge = _edge(found, max_features)
    often = found if edge is None else found.where(F.col("cnt") >= edge[0])
    if often.count() > SMALL_VOCABULARY:
        return None
    ids = np.sort(often.select("id").toArrow()["id"].to_numpy())
    held = whole.sparkSession.sparkContext.broadcast(ids)
    each = whole.select(*terms).mapInArrow(tallies(held), f"{kind}, term string").unionByName(others.join(F.broadcast(often.select("id")), "id", "left_semi"))
    d = stored(each.groupBy("id", "term").agg(*sums), "terms")
    return _most_frequent(d, max_features) if d.count() == len(ids) else None


def _places(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The place of each of ``x`` in the ascending ``ids``, -1 where it is missing."""
    if not len(ids):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
    return np.where(ids[at] == x, at, -1)


def _weights(tf: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """(key, term, weight) of the rows ``tf`` by ``terms``, a stored table of (term, idf)."""
    w = tf.join(small_side(terms), "term").select(key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("_norm")).alias("weight"))


def _weights_of_whole(whole: DataFrame, terms: DataFrame, key: str, bits: int) -> DataFrame:
    """``_weights`` of pieces that are all of their key, by ``terms`` of SMALL_VOCABULARY rows at most, each with its number."""
    table = terms.toArrow().sort_by("id").combine_chunks()
    held = whole.sparkSession.sparkContext.broadcast((table["id"].to_numpy(), table["idf"].to_numpy(), pa.array(table["term"].to_pylist(), pa.string())))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, idf, names = held.value
        for b in _in_slices(batches, "_counts"):
            at = _places(ids, _numbers(*_coded(b), bits))
            row = np.repeat(np.arange(len(b)), _lengths(b.column("_counts")))[at >= 0]
            w = _unpacked(b.column("_counts"))[at >= 0] * idf[at[at >= 0]]
            norm = np.sqrt(np.bincount(row, w * w, len(b)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), names.take(pa.array(at[at >= 0])), pa.array(w / norm[row])], names=[key, "term", "weight"])

    kind = whole.schema[key].dataType.simpleString()
    return whole.select(key, "_words", "_left", "_right", "_counts").mapInArrow(weighed, f"`{key}` {kind}, term string, weight double")


def relational_tfidf(lines: DataFrame, key: str, pos: str, text: str, n_docs: int | None = None,
                     fit_keys: DataFrame | None = None, min_df: int = MIN_DF,
                     max_features: int | None = MAX_FEATURES, id_bits: int = 64) -> DataFrame:
    """F8: (key, term, weight). Vocabulary and idf are fit on the sessions in
    ``fit_keys`` (all sessions when None); ``n_docs`` defaults to their count.

    A key in one piece, as most are, has its weights worked out from that piece, without a shuffle; rows
    of (key, term, tf) are made of the other keys. Where numbers of ``id_bits`` don't tell the terms of the vocabulary apart, or it is
    too large to be held, all keys have such rows."""
    # the counted pieces feed the vocabulary, the weights and the norms: write them once
    # instead of re-reading and re-tokenising the text
    whole, rest = _split(stored(term_pieces(lines, key, pos, text), "term-pieces"), key)
    if n_docs is None:
        src = lines if fit_keys is None else fit_keys
        n_docs = src.select(key).distinct().count()
    idf = F.log((F.lit(1.0) + F.lit(float(n_docs))) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    voc = _numbered_vocabulary(whole, rest, min_df, max_features, id_bits) if fit_keys is None and max_features else None
    if voc is not None:
        terms = stored(voc.select("term", "id", idf.alias("idf")), "vocabulary")
        return _weights_of_whole(whole, terms, key, id_bits).unionByName(_weights(rest, terms, key))
    tf = stored(_rows_of(whole, key).unionByName(rest), "term-counts")
    fit_tf = tf if fit_keys is None else tf.join(fit_keys.select(key).distinct(), key, "left_semi")
    voc = vocabulary(fit_tf, key, min_df, max_features)
    return _weights(tf, stored(voc.select("term", idf.alias("idf")), "vocabulary"), key)


# ------------------------------------------------------------------ vectors from rows
@dataclass
class Vectoriser:
    """A fitted vocabulary as a stored table (term, term_idx, idf) of at most MAX_FEATURES rows, and its size."""

    terms: DataFrame
    size: int

    def transform(self, sessions: DataFrame, tf: DataFrame, key: str = "session_id", numeric: Sequence[str] = ("n_events", "duration_sec"),
                  out: str = "features") -> DataFrame:
        """``sessions`` with ``out`` = [L2 TF-IDF | raw numeric columns] from ``tf`` (key, term, tf), which no document is needed
        for: a session's row holds its distinct terms of the vocabulary."""
        w = tf.join(small_side(self.terms), "term").select(key, "term_idx", (F.col("tf") * F.col("idf")).alias("w"))
        own = w.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term_idx", "w"))).alias("_e"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_n"))
        width, m = self.size + len(numeric), len(numeric)

        @arrow_udf(VectorUDT())
        def vector(ids: pa.Array, values: pa.Array, numbers: pa.Array) -> pa.Array:
            n = len(ids)
            more = numbers.flatten().to_numpy(zero_copy_only=False).reshape(n, m)
            begin = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
            at = np.concatenate([np.arange(begin[-1]) + m * np.repeat(np.arange(n), np.diff(begin)), (begin[1:, None] + m * np.arange(n)[:, None] + np.arange(m)).ravel()])
            i, v = np.empty(len(at), np.int32), np.empty(len(at))
            i[at] = np.concatenate([ids.flatten().to_numpy(zero_copy_only=False), np.tile(self_size + np.arange(m), n)])
            v[at] = np.concatenate([values.flatten().to_numpy(zero_copy_only=False), more.ravel()])
            ends = pa.array((begin + m * np.arange(n + 1)).astype(np.int32))
            return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, width, np.int32)), pa.ListArray.from_arrays(ends, pa.array(i)),
                                               pa.ListArray.from_arrays(ends, pa.array(v))], names=["type", "size", "indices", "values"])

        self_size = self.size
        numbers = F.array(*[F.col(c).cast("double") for c in numeric]) if m else F.array().cast("array<double>")
        e = F.coalesce("_e", F.array().cast("array<struct<term_idx:int,w:double>>"))
        made = vector(F.transform(e, lambda x: x["term_idx"]), F.transform(e, lambda x: x["w"] / F.col("_n")), numbers)
        return sessions.join(own, key, "left").withColumn(out, made).drop("_e", "_n")


def fit_vectoriser(tf: DataFrame, fit_keys: DataFrame, key: str = "session_id", min_df: int = MIN_DF,
                   max_features: int = MAX_FEATURES) -> Vectoriser:
    """vocabulary and idf of the sessions ``fit_keys`` (one row each) from ``tf``, a stored table of (key, term, tf). Terms are numbered from the
    most frequent on."""
    n = fit_keys.select(key).distinct().count()
    voc = vocabulary(tf.join(fit_keys.select(key).distinct(), key, "left_semi"), key, min_df, max_features)
    terms = row_index(voc, [F.col("cnt").desc(), "term"], "term_idx")
    idf = F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0
    terms = stored(terms.select("term", F.col("term_idx").cast("int").alias("term_idx"), idf.alias("idf")), "vocabulary")
    return Vectoriser(terms, terms.count())


# ------------------------------------------------------------------ Spark ML form
def _token_stages(doc_col: str):
    tok = RegexTokenizer(inputCol=doc_col, outputCol="_tokens", pattern="(?U)" + TOKEN_PATTERN, gaps=False,
                         toLowercase=True, minTokenLength=1)
    bi = NGram(n=2, inputCol="_tokens", outputCol="_bigrams")
    terms = SQLTransformer(statement="SELECT *, concat(_tokens, _bigrams) AS _terms FROM __THIS__")
    return [tok, bi, terms]


def fit_featurizer(train_docs: DataFrame, doc_col: str = "doc", numeric_cols: Sequence[str] = ("n_events", "duration_sec"),
                   min_df: int = MIN_DF, max_features: int = MAX_FEATURES, out: str = "features") -> PipelineModel:
    """Fit tokens -> 1+2-grams -> counts (vocabulary) -> idf on ``train_docs`` and return
    a PipelineModel producing ``out`` = [L2 TF-IDF | raw numeric columns]."""
    base = Pipeline(stages=_token_stages(doc_col) + [
        CountVectorizer(inputCol="_terms", outputCol="_tf", minDF=float(min_df), vocabSize=max_features),
        IDF(inputCol="_tf", outputCol="_idf0")]).fit(train_docs)
    idf_model = base.stages[-1]
    # the idf vector has one entry per vocabulary term (bounded by max_features)
    plus_one = DenseVector(idf_model.idf.toArray() + 1.0)
    tail = [ElementwiseProduct(scalingVec=plus_one, inputCol="_tf", outputCol="_tfidf"),
            Normalizer(p=2.0, inputCol="_tfidf", outputCol="_tfidf_l2"),
            VectorAssembler(inputCols=["_tfidf_l2", *numeric_cols], outputCol=out, handleInvalid="keep"),
            SQLTransformer(statement="SELECT * EXCEPT (_tokens, _bigrams, _terms, _tf, _tfidf, _tfidf_l2) FROM __THIS__")]
    stages: list[Transformer] = list(base.stages[:-1]) + tail
    return PipelineModel(stages=stages)


def vocabulary_terms(model: PipelineModel) -> list[str]:
    for st in model.stages:
        if hasattr(st, "vocabulary"):
            return list(st.vocabulary)
    return []
