"""Language ID by hierarchical discrimination.

Linear support vector machines on hashed character n-grams decide the family of a text first,
one family against another; then machines trained on one language against another decide
among the languages of that family only. Each machine is fitted in a Spark task of its own, on
a bounded sample of labelled documents; its weights are a vector of fixed length.

Defined cases: the language is ``und`` with score 0 where the text is null or has no letter,
and everywhere if no labelled row could be learned from; a null lang isn't learned from; ties of
votes go to the larger sum of margins, then to the first by name; a language whose family isn't
listed is a family of its own; an empty table gives no rows; extra columns are ignored or kept.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, small_batches, table, text_size, trimmed

#: Families by language code; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no is af fy lb".split(),
    "romance": "fr es pt it ro ca gl oc".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky".split(),
    "indic": "hi bn mr gu pa ur ne".split(),
    "semitic": "ar he am mt".split(),
}
UND = "und"
#: Bits of the hashed n-gram space.
BITS = 14
#: A text's vector is its n-gram shares times this, which brings its length near 1.
SCALE = 16.0
#: Labelled documents per language that the sample holds, as the expected number.
PER_LANGUAGE = 800
#: Most characters that are worked on at once.
BATCH_CHARS = 500_000

FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}


def family(lang: str) -> str:
    return FAMILY_OF.get(lang, f"only:{lang}")


@functools.cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def ngram_codes(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 2-grams and 3-grams of lower-case letters of each text, words framed by one blank.

    Returns the codes of all texts after each other, where each text's codes begin, and
    whether each text has a letter. A text without letters has no codes.
    """
    points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    chars = np.concatenate([x for p in points for x in (p, np.zeros(1, np.uint32))]) if texts else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    letter = _letters()[chars]
    chars = np.where(letter, chars, 0).astype(np.uint32)
    keep = letter.copy()  # one blank after each word, none elsewhere
    keep[1:] |= letter[:-1]
    chars, owner, letter = chars[keep], owner[keep], letter[keep]
    shift = np.uint32(32 - bits)
    one = np.zeros_like(chars)
    one[1:] = np.where(owner[1:] == owner[:-1], chars[:-1], 0)
    two = np.zeros_like(chars)
    two[1:] = np.where(owner[1:] == owner[:-1], one[:-1], 0)
    a = chars * np.uint32(0x9E3779B1) ^ (one + np.uint32(7)) * np.uint32(0x85EBCA6B)
    a ^= a >> np.uint32(15)
    a *= np.uint32(0x2C1B3C6D)
    b = a ^ (two + np.uint32(13)) * np.uint32(0xC2B2AE35)
    b ^= b >> np.uint32(15)
    b *= np.uint32(0x297A2D39)
    codes = np.stack([a >> shift, b >> shift], 1).ravel().astype(np.int32)
    counts = np.bincount(owner, minlength=len(texts)) * 2
    return codes, np.concatenate([[0], np.cumsum(counts)]), counts > 0


def fit_svm(ids: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, bits: int = BITS,
            c: float = 10.0, steps: int = 300) -> np.ndarray:
    """Weights and, at the end, the bias of an L2-regularised squared-hinge machine for labels
    y of -1 and 1, classes weighted evenly, by accelerated gradient descent."""
    n, d = len(ids), 1 << bits
    row = np.repeat(np.arange(n), [len(i) for i in ids])
    col, val = np.concatenate(ids), np.concatenate(values)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c
    w, z = np.zeros(d + 1), np.zeros(d + 1)
    # the curvature is at most that of the penalty and of all rows together, bias included
    rate = 1.0 / (1.0 + 2.0 * (weight * (np.bincount(row, val * val, n) + 1)).sum())
    for t in range(steps):
        margin = np.bincount(row, z[col] * val, n) + z[d]
        pull = 2 * weight * y * np.maximum(0, 1 - y * margin)
        grad = z.copy()
        grad[d] = 0
        grad[:d] -= np.bincount(col, pull[row] * val, d)
        grad[d] -= pull.sum()
        new = z - rate * grad
        z = new + t / (t + 3) * (new - w)
        w = new
    return w


@dataclass
class LanguageModel:
    """Machines by pair of names; a positive margin speaks for the first."""

    languages: list[str]
    families: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    pairs: dict[tuple[str, str], np.ndarray] = field(default_factory=dict)
    bits: int = BITS

    def _decide(self, names: list[str], machines: dict, codes, starts, rows) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner among names for each text of rows, and its least margin."""
        if len(names) == 1:
            return np.zeros(len(rows), np.int64), np.full(len(rows), np.inf)
        size = (starts[1:] - starts[:-1])[rows]
        votes = np.zeros((len(rows), len(names)))
        sums, least = np.zeros_like(votes), np.full_like(votes, np.inf)
        for i, a in enumerate(names):
            for j in range(i + 1, len(names)):
                w = machines[a, names[j]]
                total = np.concatenate([[0.0], np.cumsum(w[:-1][codes])])
                m = (total[starts[1:]] - total[starts[:-1]])[rows] / size * SCALE + w[-1]
                for k, s in ((i, m), (j, -m)):
                    votes[:, k] += s > 0 if k == i else s >= 0
                    sums[:, k] += s
                    least[:, k] = np.minimum(least[:, k], s)
        best = np.lexsort((np.broadcast_to(-np.arange(len(names)), votes.shape), sums, votes), axis=1)[:, -1]
        return best, least[np.arange(len(rows)), best]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, score = np.array([UND] * len(texts), object), np.zeros(len(texts))
        if not self.languages or not texts:
            return list(lang), score
        codes, starts, has = ngram_codes([t or "" for t in texts], self.bits)
        rows = np.flatnonzero(has)
        if not len(rows):
            return list(lang), score
        groups = sorted({family(x) for x in self.languages})
        won, margin = self._decide(groups, self.families, codes, starts, rows)
        sure = lambda m: 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))
        score[rows] = sure(margin)
        for k, g in enumerate(groups):
            own = rows[won == k]
            if len(own):
                names = [x for x in self.languages if family(x) == g]
                at, m = self._decide(names, self.pairs, codes, starts, own)
                lang[own] = np.array(names, object)[at]
                score[own] *= sure(m)
        return list(lang), score


def split_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 4


def fit_languages(labelled: DataFrame, per_language: int = PER_LANGUAGE, bits: int = BITS, seed: int = 11) -> LanguageModel:
    """Fit on ``labelled`` (doc_id, text, lang): a sample of about ``per_language`` whole
    documents for each language, drawn by a hash of the id, so that a machine sees a bounded
    number of rows however large the table is."""
    small_batches(labelled.sparkSession)
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return LanguageModel([], bits=bits)
    # made from Arrow, in the JVM: a list would go through Python workers of another kind, which then stay beside the others
    shares = rows.sparkSession.createDataFrame(pa.table({"lang": list(counts), "family": [family(k) for k in counts], "share": [min(1.0, per_language / n) for n in counts.values()]}))
    draw = (F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)).bitwiseAND((1 << 30) - 1) / float(1 << 30))
    sample = rows.join(F.broadcast(shares), "lang").filter(draw < F.col("share")).select("doc_id", "text", "lang", "family")

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches(frames, text_size, "text", BATCH_CHARS):
            codes, starts, has = ngram_codes(list(f.text), bits)
            ids, values = [], []
            for k in range(len(f)):
                i, n = np.unique(codes[starts[k]:starts[k + 1]], return_counts=True)
                ids.append(i)
                values.append((n / max(1, n.sum()) * SCALE).astype(np.float32))
            yield f.assign(ids=ids, vals=values)[has][["doc_id", "lang", "family", "ids", "vals"]]

    made = sample.mapInPandas(lambda frames: trimmed(vectors(frames)), "doc_id long, lang string, family string, ids array<int>, vals array<float>")
    known = sorted(counts)
    groups = sorted({family(x) for x in known})
    tasks = [("family", a, b) for i, a in enumerate(groups) for b in groups[i + 1:]]
    tasks += [("lang", a, b) for i, a in enumerate(known) for b in known[i + 1:] if family(a) == family(b)]
    model = LanguageModel(known, bits=bits)
    if not tasks:
        return model
    pairs = rows.sparkSession.createDataFrame(pa.table(dict(zip(("level", "a", "b"), map(list, zip(*tasks, strict=True)), strict=True))))
    name = F.when(F.col("level") == "family", F.col("family")).otherwise(F.col("lang"))
    dealt = made.join(F.broadcast(pairs), (name == F.col("a")) | (name == F.col("b"))).select(
        "level", "a", "b", (name == F.col("a")).alias("first"), "doc_id", "ids", "vals")

    def fitted(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("doc_id", kind="stable")
        w = fit_svm(list(f.ids), list(f.vals), np.where(f["first"], 1.0, -1.0), bits)
        return pd.DataFrame({"level": [key[0]], "a": [key[1]], "b": [key[2]], "w": [w]})

    found = dealt.groupBy("level", "a", "b").applyInPandas(fitted, "level string, a string, b string, w array<double>").collect()
    for r in found:
        (model.families if r.level == "family" else model.pairs)[r.a, r.b] = np.array(r.w)
    for level, a, b in tasks:  # a pair of which the sample had no rows: no margin either way
        (model.families if level == "family" else model.pairs).setdefault((a, b), np.zeros((1 << bits) + 1))
    return model


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text",
                      names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score, in columns of those ``names``; only the
    text is an input of the prediction."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # weights of a fixed length for each pair of names

    def told(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            langs, scores = [], []
            frames = batches(iter([pd.DataFrame({"t": texts.reset_index(drop=True)})]), text_size, "t", BATCH_CHARS)
            for f in frames:
                n, s = held.value.predict([None if t is None or t != t else t for t in f.t])
                langs += n
                scores += list(s)
            yield pd.DataFrame({"lang_pred": langs, "score": np.array(scores, float)})

    @F.pandas_udf("lang_pred string, score double")
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from trimmed(told(parts))

    own = docs.withColumn("__p", predicted(F.col(text)))
    return own.withColumns({names[0]: F.col("__p.lang_pred"), names[1]: F.col("__p.score")}).drop("__p")


def learn_from(docs: DataFrame) -> LanguageModel:
    """The model of the rows whose split isn't 2."""
    return fit_languages(docs.filter(split_of(F.col("doc_id")) != 2))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    out = predict_languages(docs.select("doc_id", "text"), learn_from(docs))
    return out.select("doc_id", F.coalesce(split_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
