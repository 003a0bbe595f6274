"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages, and only the bag has a label. Every passage is encoded
by a small network; gated attention gives each a weight from its code, and the weighted
mean of the codes gives the document's score. All weights are learned together from the
document labels, in numpy, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlight.llm.common import table

PASSAGE_WORDS = 64
SLOTS = 256
STYLE = 16
FEATURES = SLOTS + STYLE
CODE, GATE = 24, 16
#: Labelled rows of each class that the model is fitted on at most: those with the least hash of doc_id.
SAMPLE_OF_CLASS = 2000
THRESHOLD = 0.3

_TABLES: dict[str, np.ndarray] = {}
_SYMBOLS, _ENDS, _MARKS = "#*$%&|<>^~@+=\\_{}[]", ".!?", ",;:'\"()-"


def _kinds() -> np.ndarray:
    """A class for each code point: 0 space, 1 lower, 2 upper, 3 digit, 4 symbol, 5 sentence end, 6 other mark, 7 rest."""
    if "kinds" not in _TABLES:
        out = np.full(0x110000, 7, np.uint8)
        for c in range(0x3001):  # up to the last space
            x = chr(c)
            out[c] = 0 if x.isspace() else 1 if x.islower() else 2 if x.isupper() else 3 if x.isdigit() else 4 if x in _SYMBOLS else 5 if x in _ENDS else 6 if x in _MARKS else 7
        _TABLES["kinds"] = out
    return _TABLES["kinds"]


def passages(text: str | None) -> np.ndarray:
    """Features of every passage (a row each) of a whole text; one row of zeros without words."""
    if not text or not (words := text.split()):
        return np.zeros((1, FEATURES), np.float32)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[c]
    solid = kind != 0
    begins = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]]))
    at = begins[::PASSAGE_WORDS].copy()
    at[0] = 0
    n = len(at)
    which = np.repeat(np.arange(n), np.diff(np.append(at, len(c))))
    counts = np.bincount(which * 8 + kind, minlength=n * 8).reshape(n, 8).astype(np.float32)
    chars = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    out = np.zeros((n, FEATURES), np.float32)
    out[:, :8] = counts / chars * 4
    ends = np.append(np.arange(PASSAGE_WORDS, len(words), PASSAGE_WORDS), len(words))[:n]
    for i, z in enumerate(ends):
        part = words[i * PASSAGE_WORDS : z]
        m = max(1, len(part))
        distinct = len(set(part))
        out[i, 8] = distinct / m * 2
        out[i, 9] = len(set(zip(part, part[1:]))) / max(1, m - 1) * 2 if m > 1 else 2
        out[i, 10] = np.log1p(m) / 3
        out[i, 11] = min(4.0, (chars[i, 0] - counts[i, 0]) / m / 4)
    out[:, 12] = np.bincount(which, c == 10, n) / np.maximum(1, np.diff(np.append(at, len(c)))) * 40
    out[:, 13] = np.log1p(len(words)) / 6
    out[:, 14] = len(set(words)) / len(words)
    out[:, 15] = counts[:, 2] / np.maximum(1, counts[:, 1] + counts[:, 2]) * 3
    if len(c) > 2:
        h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        grams = np.sqrt(np.bincount(which[:-2] * SLOTS + (h >> np.uint32(24)), minlength=n * SLOTS).reshape(n, SLOTS))
        out[:, STYLE:] = grams / np.maximum(1e-6, np.linalg.norm(grams, axis=1, keepdims=True))
    return out


@dataclass
class Model:
    w: dict[str, np.ndarray]

    def score(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        """(probability that the label is 1, attention weight of each passage)."""
        w = self.w
        h = np.tanh(x @ w["e"] + w["eb"])
        a = (np.tanh(h @ w["v"]) * (1 / (1 + np.exp(-(h @ w["u"]))))) @ w["a"]
        a = np.exp(a - a.max())
        a /= a.sum()
        z = float((a @ h) @ w["c"] + w["cb"][0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), a


@dataclass
class Bag:
    """The features of all passages of a document, without zeros: places in the flat array, and values."""

    n: int
    at: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return self.n

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        x = np.zeros(self.n * FEATURES, np.float32)
        x[self.at] = self.values
        return x.reshape(self.n, FEATURES)


def _init(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    return {"e": draw(FEATURES, CODE), "eb": np.zeros(CODE, np.float32), "v": draw(CODE, GATE), "u": draw(CODE, GATE), "a": draw(GATE), "c": draw(CODE), "cb": np.zeros(1, np.float32)}


def fit(bags: Sequence[np.ndarray | Bag], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.004, decay: float = 1e-4, seed: int = 0) -> Model:
    """Adam on the log loss of bags; classes weigh the same. Without both classes, the score is 0.5 of an untrained
    model's bias: the share of ones."""
    w = _init(seed)
    if len(set(labels.tolist())) < 2:
        w = {k: np.zeros_like(x) for k, x in w.items()}
        w["cb"][0] = 0 if not len(labels) else (30 if labels[0] else -30)
        return Model(w)
    r = np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in w.items()}, {k: np.zeros_like(x) for k, x in w.items()}, 0
    weight = np.where(labels == 1, len(labels) / (2 * labels.sum()), len(labels) / (2 * (len(labels) - labels.sum()))).astype(np.float32)
    for epoch in range(epochs):
        order = r.permutation(len(bags))
        for s in range(0, len(order), batch):
            pick = order[s : s + batch]
            x = np.concatenate([np.asarray(bags[i]) for i in pick])
            sizes = np.array([len(bags[i]) for i in pick])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            own = np.repeat(np.arange(len(pick)), sizes)
            h = np.tanh(x @ w["e"] + w["eb"])
            t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
            s_ = (t * g) @ w["a"]
            e = np.exp(s_ - np.maximum.reduceat(s_, starts)[own])
            att = e / np.add.reduceat(e, starts)[own]
            z = np.add.reduceat(att[:, None] * h, starts)
            p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["cb"], -30, 30)))
            dz = ((p - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
            grad = {"c": z.T @ dz, "cb": np.array([dz.sum()], np.float32)}
            back = dz[own, None] * w["c"]
            datt = (back * h).sum(axis=1)
            ds = att * (datt - np.add.reduceat(att * datt, starts)[own])
            grad["a"] = (t * g).T @ ds
            dt, dg = ds[:, None] * w["a"] * g * (1 - t * t), ds[:, None] * w["a"] * t * g * (1 - g)
            grad["v"], grad["u"] = h.T @ dt, h.T @ dg
            dh = (att[:, None] * back + dt @ w["v"].T + dg @ w["u"].T) * (1 - h * h)
            grad["e"], grad["eb"] = x.T @ dh, dh.sum(axis=0)
            step += 1
            for k in w:
                d = grad[k] + decay * w[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                w[k] -= rate * (0.1 + 0.9 * (1 - epoch / epochs)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(w)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, places, values = [], [], []
        for text in b.column("text"):
            x = passages(text.as_py())
            at = np.flatnonzero(x)
            n.append(len(x))
            places.append(at.astype(np.uint32).tobytes())
            values.append(x.ravel()[at].tobytes())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(n, pa.int32()), pa.array(places, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "label", "n", "at", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_OF_CLASS) -> Model:
    """Fit on all passages of at most sample rows of each class: those of labels with the least hash of the id.

    Labels other than 0 and 1, and null ids, are passed over. Of documents that share an id
    the one with the least text is learned.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    least = lambda label: rows.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample)
    chosen = least(0).unionAll(least(1))  # a top-k each: every task passes on sample rows at most
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # repeated ids must not multiply the sample
    found = texts.mapInArrow(_features, "doc_id long, label int, n int, at binary, x binary").toArrow().sort_by([("doc_id", "ascending"), ("at", "ascending"), ("x", "ascending")])
    bags = [Bag(n.as_py(), np.frombuffer(at.as_buffer(), np.uint32), np.frombuffer(x.as_buffer(), np.float32)) for n, at, x in zip(found.column("n"), found.column("at"), found.column("x"), strict=True)]
    return fit(bags, np.array(found.column("label").to_pylist(), np.float32))


def _scorer(model: Model, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, parts, top = [], [], []
            for text in b.column("text"):
                p, a = model.score(passages(text.as_py()))
                scores.append(p)
                parts.append(len(a))
                top.append(int(a.argmax()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(parts, pa.int32()), pa.array(top, pa.int32())], names=["doc_id", "score", "predicted", "n_passages", "top_passage"])

    return run


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, score, predicted, n_passages, top_passage (the most attended).

    Defined cases: null and empty texts, and texts of white space, are one passage of
    zeros; repeated rows score the same; a null doc_id stays null; an empty table stays
    empty; other columns are not read. One narrow pass over whole texts, no shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scorer(model, threshold), "doc_id long, score double, predicted int, n_passages int, top_passage int")


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(_fold() != 0))
    out = classify(docs, model)
    return out.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "score", "predicted", "n_passages", "top_passage")
