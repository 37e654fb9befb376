"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of ``PASSAGE`` bytes. A passage x is described by shares of byte
kinds, word statistics and a hashed histogram of byte pairs, and encoded as h = tanh(W x + b). Gated
attention weighs it, a = softmax over the bag of w . (tanh(V h) * sigmoid(U h)); the document is the
weighted sum of its passages' encodings, and a logistic unit scores that. Only documents have labels:
the weights of passages are learned from them (Adam, gradients by hand), on a bounded sample.

Defined cases: a null or empty text is one passage without bytes, scored like any other; a text's score
depends on the text alone, so ties and repeated rows get equal scores; a very long text is one lot of its
worker; without labels of both classes the score is the share of class 1 among the labels (0.5 without
labels); columns named like the two that are added give way to them; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tables import read
from .labelled import fold_of, labelled_texts
from .rows import numbered
from .textbytes import BLANK, giving_back, lots, span_hashes, text_bytes, word_spans

PASSAGE = 512
PAIRS = 256
HIDDEN, GATE = 24, 12
#: Documents of each class that the model is fitted on at most.
SAMPLE = 1_000
EPOCHS, BAGS, RATE, DECAY = 12, 64, 0.01, 1e-4

_KIND = np.full(256, 6, np.uint8)  # other ASCII signs
_KIND[BLANK], _KIND[10], _KIND[128:] = 0, 7, 5
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = 4  # punctuation of prose
KINDS = 8
FEATURES = KINDS + 5 + PAIRS


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, first passage of each text and, last, their number)."""
    sizes = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-sizes // PASSAGE)))])
    text = np.repeat(np.arange(len(sizes)), sizes)
    of = first[text] + (np.arange(len(data)) - offsets[text]) // PASSAGE
    n = int(first[-1])
    count = np.bincount(of, minlength=n).astype(np.float32)
    kinds = np.bincount(of * KINDS + _KIND[data], minlength=n * KINDS).reshape(n, KINDS)
    pair = (data[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) + data[1:].astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(24)
    inside = text[:-1] == text[1:]
    pairs = np.bincount((of[:-1] * PAIRS + pair)[inside], minlength=n * PAIRS).reshape(n, PAIRS) if len(data) else np.zeros((n, PAIRS))
    starts, ends, _ = word_spans(data, offsets)
    words, lengths = span_hashes(data, starts, ends), (ends - starts).astype(np.float64)
    at = of[starts] if len(starts) else np.zeros(0, np.int64)
    same = np.zeros(len(words), np.float64)
    same[1:] = (words[1:] == words[:-1]) & (text[starts[1:]] == text[starts[:-1]]) if len(words) else 0
    number = np.maximum(np.bincount(at, minlength=n), 1)
    share = lambda x: np.bincount(at, x, n) / number
    mean = share(lengths)
    per = np.maximum(count, 1)
    rest = np.stack([share(same), mean / 10, np.sqrt(np.maximum(share(lengths**2) - mean**2, 0)) / 10, np.log1p(count) / 6, (pairs**2).sum(1) / per**2], axis=1)
    return np.concatenate([kinds / per[:, None], rest, np.sqrt(pairs / per[:, None])], axis=1).astype(np.float32), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class AttentionModel:
    """Weights of the encoder, the gated attention and the scorer; ``constant`` stands in where nothing could be learned."""

    weights: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    shift: float = 0.0
    constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        w = self.weights
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (t * s) @ w["w"]
        begins, sizes = first[:-1], np.diff(first)
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, begins), sizes))
        a /= np.repeat(np.add.reduceat(a, begins), sizes)
        z = np.add.reduceat(a[:, None] * h, begins, axis=0)
        return z @ w["c"] + w["d"][0], h, t, s, a, z

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, balance: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean weighed log loss of these bags, by each weight."""
        w, sizes = self.weights, np.diff(first)
        logit, h, t, s, a, z = self.forward(x, first)
        g = (_sigmoid(logit) - y) * balance / len(y)
        each = np.repeat(g, sizes)
        along = h @ w["c"]  # each passage's own vote, and below how it differs from its document's
        de = each * a * (along - np.repeat(z @ w["c"], sizes))
        dt, ds = de[:, None] * w["w"] * s * (1 - t * t), de[:, None] * w["w"] * t * s * (1 - s)
        dh = (each * a)[:, None] * w["c"] + dt @ w["V"].T + ds @ w["U"].T
        du = dh * (1 - h * h)
        return {"W": x.T @ du, "b": du.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ de, "c": z.T @ g, "d": g.sum(keepdims=True)}

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of each text, share of attention its strongest passage has)."""
        x, first = passages(data, offsets)
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant), np.zeros(len(first) - 1)
        logit, _, _, _, a, _ = self.forward((x - self.mean) / self.scale, first)
        return _sigmoid(logit.astype(np.float64) + self.shift), np.maximum.reduceat(a, first[:-1]).astype(np.float64)


def fit(sample: list[tuple[str, int]], share: float, seed: int = 7) -> AttentionModel:
    """A model of (text, label) pairs; share is that of label 1 among all labels, which the sample does not keep."""
    y = np.array([kind for _, kind in sample], np.float32)
    empty = AttentionModel({}, np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32), constant=share)
    if not 0 < y.sum() < len(y):
        return empty
    parts = [passages(*text_bytes(pa.array([t]))) for t, _ in sample]
    x = np.concatenate([p for p, _ in parts])
    first = np.concatenate([[0], np.cumsum([len(p) for p, _ in parts])])
    mean, scale = x.mean(0), x.std(0) + 0.02
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    w = {k: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32) for k, shape in
         (("W", (FEATURES, HIDDEN)), ("V", (HIDDEN, GATE)), ("U", (HIDDEN, GATE)), ("w", (GATE,)), ("c", (HIDDEN,)))}
    w |= {"b": np.zeros(HIDDEN, np.float32), "d": np.zeros(1, np.float32)}
    model = AttentionModel(w, mean, scale)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    balance = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))).astype(np.float32)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BAGS):
            bags = order[k:k + BAGS]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in bags])
            sizes = np.array([first[i + 1] - first[i] for i in bags])
            cut = np.concatenate([[0], np.cumsum(sizes)])
            step += 1
            for name, grad in model.gradients(x[rows], cut, y[bags], balance[bags]).items():
                m, v = moments[name]
                grad = grad + DECAY * w[name]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                w[name] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    model.shift = float(np.log(share / (1 - share))) if 0 < share < 1 else 0.0
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> AttentionModel:
    """Fitted on at most ``most`` documents of each class, none of the held-out fold (CRC-32 of the id mod 3 = 1)."""
    return fit(*labelled_texts(docs, labels, "quality", 3, 1, most))


def scored(docs: DataFrame, model: AttentionModel, score: str = "score", attention: str = "attention") -> DataFrame:
    """docs with the columns score and attention (share of the strongest passage) added; docs has a text column."""
    docs = docs.drop(score, attention)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            for a, b in lots(offsets):
                value, most = model.scores(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value), pa.array(most)], names=schema.names)

    rows = numbered(docs)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, T.DoubleType()) for n in ("score", "attention"))])
    return rows.mapInArrow(giving_back(run), schema).toDF(*names, score, attention)


def op3_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "attention")
