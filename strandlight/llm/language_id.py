"""Multilingual mixture inference.

Character trigrams of every labelled training document are counted by language. A
document is a bag of words, each drawn from one of the languages with an n-gram
likelihood; expectation-maximisation finds the document's language proportions, and
the set of languages is the one with the best likelihood less a penalty for its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

from strandlight.llm.common import table

#: Hash slots of trigrams. The model has SLOTS numbers a language.
SLOTS = 1 << 16
SMOOTH = 0.2
#: Numbers of a text (words x languages) that are held at a time.
BLOCK = 1 << 21
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # (SLOTS, languages), float32


_TABLES: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """The lower-case code point of each letter, 0 for what is not a letter. Made once in a process."""
    if "letters" in _TABLES:
        return _TABLES["letters"]
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    _TABLES["letters"] = out
    return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(trigram slots of all words, the start of each word in them). A word is a run of
    letters with one space on either side, and has as many trigrams as letters."""
    c = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.concatenate([np.zeros(1, np.uint32), c, np.zeros(1, np.uint32)])
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c = c[keep]
    if len(c) < 3:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    mid = c[1:-1]
    h = c[:-2] * np.uint32(0x9E3779B1) + mid * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h >>= np.uint32(16)
    letter = mid != 0
    starts = np.flatnonzero(letter & (c[:-2] == 0))
    at = np.cumsum(letter) - 1
    return h[letter], at[starts]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0), b.column(1), strict=True):
            lang = lang.as_py()
            if lang not in counts:
                counts[lang] = np.zeros(SLOTS, np.int64)
            counts[lang] += np.bincount(grams(text.as_py())[0], minlength=SLOTS)
    for lang, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "slot", "n"])


def _dense(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    n = np.zeros(SLOTS, np.int64)
    n[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "n": pa.array([n.tobytes()], pa.binary())})


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts cover all rows with a text and a language; each task sums its own rows first,
    so that what is shuffled is a bounded number of slots a task and language. One row of
    SLOTS sums for each language comes to the driver."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    sums = rows.mapInArrow(_count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    of_lang = {r.lang: np.frombuffer(bytes(r.n), np.int64) for r in sums.groupBy("lang").applyInArrow(_dense, "lang string, n binary").collect()}
    languages = sorted({r.lang for r in rows.select("lang").distinct().collect()})
    log_p = np.empty((SLOTS, len(languages)), np.float32)
    for k, lang in enumerate(languages):  # a language without a trigram has the same chance for all
        p = of_lang.pop(lang, 0) + np.full(SLOTS, SMOOTH)
        log_p[:, k] = np.log(p / p.sum())
    return Model(languages, log_p)


def _word_blocks(model: Model, slots: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    """Word likelihoods (words x languages), each word's best 1, for blocks of words of at most about BLOCK numbers."""
    wide = max(1, BLOCK // len(model.languages))
    ends = np.append(starts[1:], len(slots))
    for w in range(0, len(starts), wide):
        a, z = starts[w : w + wide], ends[w : w + wide]
        ll = np.zeros((len(a), len(model.languages)))
        for g in range(int(a[0]), int(z[-1]), wide):  # trigrams, also those of one very long word, in slices
            stop = min(g + wide, int(z[-1]))
            first, last = int(np.searchsorted(z, g, "right")), int(np.searchsorted(a, stop, "left"))
            ll[first:last] += np.add.reduceat(model.log_p[slots[g:stop]], np.maximum(a[first:last] - g, 0), axis=0)
        yield np.exp(np.maximum(ll - ll.max(axis=1, keepdims=True), -60.0))


class _Words:
    """The word likelihoods of a text, kept if they are one block and made again each time if not."""

    def __init__(self, model: Model, slots: np.ndarray, starts: np.ndarray) -> None:
        self.n = len(starts)
        self.again = lambda: _word_blocks(model, slots, starts)
        self.one = list(self.again()) if self.n * len(model.languages) <= BLOCK else None

    def __iter__(self) -> Iterator[np.ndarray]:
        return iter(self.one) if self.one is not None else self.again()


def _em(words: _Words, use: np.ndarray, steps: int = 25) -> tuple[np.ndarray, float]:
    """(proportions, log-likelihood) for scaled word likelihoods of the languages in use."""
    pi = np.full(len(use), 1 / len(use))
    for _ in range(steps if len(use) > 1 else 0):
        new = np.zeros(len(use))
        for e in words:
            e = e[:, use]
            new += e.T @ (1 / (e @ pi))
        new *= pi / words.n
        done = np.abs(new - pi).max() < 1e-3
        pi = new
        if done:
            break
    return pi, float(sum(np.log(np.maximum(e[:, use] @ pi, 1e-300)).sum() for e in words))


def mixture(model: Model, text: str | None) -> tuple[str, float, dict[str, float]]:
    """(language with the largest share, its share, the shares of the chosen set).

    Of equal shares the first language by name counts. Without letters or languages there
    is no share.
    """
    slots, starts = grams(text or "")
    if not len(slots) or not model.languages:
        return UNDETERMINED, 0.0, {}
    words = _Words(model, slots, starts)
    pi, _ = _em(words, np.arange(len(model.languages)))
    order = np.argsort(-pi, kind="stable")
    chosen, shares, value = order[:1], np.ones(1), _em(words, order[:1])[1]
    for k in range(2, len(order) + 1):
        if pi[order[k - 1]] < 0.01:
            break
        part, fit = _em(words, order[:k])
        new = fit - 0.5 * (k - 1) * np.log(words.n)
        if new <= value + 1e-9:
            break
        chosen, shares, value = order[:k], part, new
    top = int(np.argmax(shares))
    return model.languages[chosen[top]], float(min(1.0, max(0.0, shares[top]))), {model.languages[i]: float(s) for i, s in zip(chosen, shares, strict=True)}


def _predictor(model: Model, column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [mixture(model, x.as_py()) for x in b.column(column)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([list(x[2].items()) for x in found], pa.map_(pa.string(), pa.float64()))], names=[*b.schema.names, "lang_pred", "score", "lang_shares"])

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (the share of lang_pred) and lang_shares, which replace
    columns of those names.

    Defined cases: a null text or one without letters is `und` with score 0 and no
    shares; so is everything if no language was learned. One narrow pass, no shuffle.
    """
    docs = docs.drop("lang_pred", "score", "lang_shares")
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("lang_shares", MapType(StringType(), DoubleType()))]
    plain = [f"c{k}" for k in range(len(docs.columns))]  # names with dots cannot go through Arrow
    fields = [StructField(n, f.dataType) for n, f in zip(plain, docs.schema.fields, strict=True)]
    text = plain[docs.columns.index(text_col)]
    return docs.toDF(*plain).mapInArrow(_predictor(model, text), StructType([*fields, *added])).toDF(*docs.columns, *(f.name for f in added))


def _fold(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string")) % 4


def train_on_folds(docs: DataFrame) -> Model:
    """Learn from the documents whose crc32(doc_id) mod 4 is not 2."""
    return train(docs.filter(_fold() != 2))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train_on_folds(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(_fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", F.to_json("lang_shares").alias("lang_shares"))
