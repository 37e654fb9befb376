"""Toxicity: a linear-chain conditional random field tags toxic spans; marginals make document scores.

Tokens are runs of letters (ASCII, or any byte beyond ASCII), A-Z lowered. The labels are of documents,
so labelled tokens are made from them: a word, or a beginning of four or five letters, that toxic
documents hold far more often than clean ones marks the token toxic, in toxic documents only. The
field has two states and weights for a token's word, its beginnings and endings, and each transition;
it is fitted to tagged windows and as many clean ones by gradient ascent on the conditional
likelihood, gradients from forward-backward, on a bounded sample: documents, windows of a document and
windows in all have stated bounds, within which they are drawn at random.

A scan finds each token's weight by the hash of its bytes, computes the marginals of whole documents
by forward-backward in odds form (all documents of a lot at once, a token a step; a chain of more than
``CHAIN`` tokens is cut into blocks that are walked together, linked by their 2x2 products), joins neighbouring
tokens with a marginal of one half or more to spans, and maps the log odds of the largest marginal to
a score by a logistic curve fitted on the sample.

Defined cases: a null or empty text, or one without letters, scores like a document whose every
marginal is 0; ties and repeated rows score alike; a very long text is one lot of its worker; columns
other than doc_id and text are left out; without labels of both classes the score is the
share of class 1 among the labels (0.5 without labels); no rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import read
from .labelled import fold_of, labelled_texts
from .textbytes import lots, span_hashes, text_bytes

#: Documents of each class that the model is fitted on at most.
SAMPLE = 1_500
#: A word or beginning marks a token if toxic documents hold it TIMES as often as clean ones, and the log-likelihood
#: ratio of two rates against one is EVIDENCE: of a million words, hardly one reaches that by chance. Toxic documents in
#: which it stands between the same two words count once, or all words of a much copied passage would mark.
TIMES, EVIDENCE = 15.0, 14.0
AROUND = 12  # tokens on each side of a tagged one that a window holds
#: Windows the field is fitted on at most: in all, of one toxic document, of one clean document; drawn at random.
WINDOWS, TOXIC_WINDOWS, CLEAN_WINDOWS = 6_000, 40, 4
CHAIN = 512
EPOCHS, BATCH, RATE, DECAY = 40, 256, 0.1, 1e-5
KEPT_WORDS = 1_500_000
#: Bytes of a lot: the messages take a step for each token of its longest text, so large lots take fewer.
LOT = 2_000_000
FLOOR = -30.0

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def token_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes, starts, ends, first token of each text and their number) of the runs of letters."""
    low = data + np.uint8(32) * ((data >= 65) & (data <= 90)).astype(np.uint8)
    ink = _LETTER[data]
    edge = np.zeros(len(data), bool)
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1:]
    starts = np.flatnonzero(first)
    return low, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def keys_of(word: str) -> list[str]:
    """The features of a token: its word, beginnings of four and five letters, ending of three."""
    return [f"w:{word}", *(f"p:{word[:n]}" for n in (4, 5) if len(word) > n), *([f"s:{word[-3:]}"] if len(word) > 3 else [])]


def _words(text: str) -> list[str]:
    data, offsets = text_bytes(pa.array([text]))
    low, starts, ends, _ = token_spans(data, offsets)
    raw = low.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts, ends)]


def _walk(odds: np.ndarray, begin: np.ndarray, sizes: np.ndarray, move: np.ndarray, enter: np.ndarray) -> np.ndarray:
    """Messages along runs of tokens, all runs a token a step; enter: the message before each run, nan where a chain begins."""
    order = np.argsort(-sizes, kind="stable")
    begin, sizes, state = begin[order], sizes[order], enter[order]
    out = np.empty(len(odds))
    for t, n in enumerate(np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1 if len(sizes) else 1), "right")):
        at, r = begin[:n] + t, state[:n]
        now = odds[at] * (move[0, 1] + r * move[1, 1]) / (move[0, 0] + r * move[1, 0])
        state[:n] = out[at] = np.where(np.isnan(r), odds[at], now) if t == 0 else now
    return out


def messages(odds: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Odds of state 1 at each token, given its chain up to and with it. A step is a fraction of linear terms,
    so a block of tokens is one too (a 2x2 product), and the blocks of a long chain can be walked together."""
    sizes = np.diff(first)
    begins, sizes = first[:-1][sizes > 0], sizes[sizes > 0]
    blocks = -(-sizes // CHAIN)
    start = np.cumsum(blocks) - blocks
    chain = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(len(chain)) - start[chain]
    begin = begins[chain] + nth * CHAIN
    length = np.minimum(CHAIN, sizes[chain] - nth * CHAIN)
    enter = np.full(len(chain), np.nan)
    inner = np.flatnonzero(nth < blocks[chain] - 1)
    if len(inner):
        opens = nth[inner] == 0
        a, b, c, d = np.ones(len(inner)), np.zeros(len(inner)), np.zeros(len(inner)), np.ones(len(inner))
        for t in range(CHAIN):
            o = odds[begin[inner] + t]
            fresh = opens & (t == 0)
            p, q = np.where(fresh, 0, o * move[1, 1]), np.where(fresh, o, o * move[0, 1])
            r, s = np.where(fresh, 0, move[1, 0]), np.where(fresh, 1, move[0, 0])
            a, b, c, d = p * a + q * c, p * b + q * d, r * a + s * c, r * b + s * d
            most = np.maximum.reduce([a, b, c, d])
            a, b, c, d = a / most, b / most, c / most, d / most
        row = np.full(len(chain), -1)
        row[inner] = np.arange(len(inner))
        for k in range(int(blocks.max()) - 1):
            at = start[blocks > k + 1] + k
            i, r = row[at], np.nan_to_num(enter[at], nan=1.0)
            enter[at + 1] = (a[i] * r + b[i]) / (c[i] * r + d[i])
    return _walk(odds, begin, length, move, enter)


def forward_backward(odds: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Marginals of state 1 of many chains. odds: exp(weight of state 1 over 0) of each token.

    first: first token of each chain and the number of all. move[i, j]: exp(weight of going from i to j).
    The backward messages are the forward ones of the chains read from behind, under the transposed moves.
    """
    both = messages(odds, first, move) * _behind(odds, first, move)
    return both / (1 + both)


def _behind(odds: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Backward messages: odds of what follows each token, without the token's own."""
    return messages(odds[::-1], len(odds) - first[::-1], move.T)[::-1] / odds


@dataclass
class SpanTagger:
    """Weights of the field and of the logistic curve; ``constant`` stands in where nothing could be learned."""

    weights: dict[str, float]
    bias: float
    move: np.ndarray
    curve: tuple[float, float] = (1.0, 0.0)
    constant: float | None = None
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def weight(self, word: str) -> float:
        return self.bias + sum(self.weights.get(k, 0.0) for k in keys_of(word))

    def token_weights(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Weights by the hash of the token's bytes; a worker keeps those of KEPT_WORDS words and then starts anew."""
        unit, at, back = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(unit) > KEPT_WORDS:
            self.known, self.value = np.zeros(0, np.uint64), np.zeros(0)
        where = np.searchsorted(self.known, unit)
        new = np.ones(len(unit), bool)
        inside = where < len(self.known)
        new[inside] = self.known[where[inside]] != unit[inside]
        if new.any():
            raw = low.tobytes()
            fresh = [self.weight(raw[starts[i]:ends[i]].decode("utf-8", "replace")) for i in at[new]]
            self.known, self.value = np.insert(self.known, where[new], unit[new]), np.insert(self.value, where[new], fresh)
            where = np.searchsorted(self.known, unit)
        return self.value[where][back.ravel()]

    def tag(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """(score, spans of code points) of each text."""
        n = len(offsets) - 1
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        if self.constant is not None:
            return np.full(n, self.constant), spans
        low, starts, ends, first = token_spans(data, offsets)
        largest = np.zeros(n)
        if len(starts):
            marginal = forward_backward(np.exp(np.clip(self.token_weights(low, starts, ends), -60, 60)), first, self.move)
            some = np.flatnonzero(np.diff(first) > 0)
            largest[some] = np.maximum.reduceat(marginal, first[:-1][some])
            hot = np.flatnonzero(marginal >= 0.5)
            if len(hot):
                point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                text = np.searchsorted(first, hot, "right") - 1
                cut = np.flatnonzero((np.diff(hot) > 1) | (np.diff(text) > 0)) + 1
                for run in np.split(np.arange(len(hot)), cut):
                    k, a, b = text[run[0]], hot[run[0]], hot[run[-1]]
                    zero = point[offsets[k]]
                    spans[k].append((int(point[starts[a]] - zero), int(point[ends[b]] - zero)))
        return self.score(largest), spans

    def score(self, largest: np.ndarray) -> np.ndarray:
        logit = np.clip(np.log(np.maximum(largest, 1e-300)) - np.log1p(-np.minimum(largest, 1 - 1e-12)), FLOOR, -FLOOR)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * logit + self.curve[1], -40, 40)))


def _marks(sample: list[tuple[list[str], int]]) -> set[str]:
    """Words and beginnings that toxic documents hold far more often than clean ones."""
    counts = [max(1, sum(kind == k for _, kind in sample)) for k in (0, 1)]
    clean: Counter = Counter()
    places: dict[str, set[tuple[str, str]]] = {}
    for words, kind in sample:
        first = {w: i for i, w in reversed(list(enumerate(words)))}
        keys = {k: i for w, i in first.items() for k in keys_of(w) if not k.startswith("s:")}
        if not kind:
            clean.update(keys.keys())
            continue
        for k, i in keys.items():
            places.setdefault(k, set()).add((words[i - 1] if i else "", words[i + 1] if i + 1 < len(words) else ""))
    marks = set()
    for key, seen in places.items():
        n, c, share = len(seen), clean[key], counts[1] / sum(counts)
        evidence = n * np.log(n / ((n + c) * share)) + (c * np.log(c / ((n + c) * (1 - share))) if c else 0.0)
        if n / counts[1] >= TIMES * (c + 0.5) / counts[0] and evidence >= EVIDENCE:
            marks.add(key)
    return marks


def _windows(sample: list[tuple[list[str], int]], marks: set[str], rng: np.random.Generator) -> tuple[list[list[str]], list[np.ndarray]]:
    """(tokens, tags) of at most WINDOWS windows: around tagged tokens of toxic documents, and out of clean ones."""
    tagged: list[tuple[list[str], np.ndarray]] = []
    clean: list[tuple[list[str], np.ndarray]] = []
    for words, kind in sample:
        if not words:
            continue
        if kind:
            tags = np.array([any(k in marks for k in keys_of(w)) for w in words], np.int8)
            for at in rng.permutation(np.flatnonzero(tags))[:TOXIC_WINDOWS]:
                cut = slice(max(0, at - AROUND), at + AROUND + 1)
                tagged.append((words[cut], tags[cut]))
        else:
            for _ in range(CLEAN_WINDOWS):
                at = int(rng.integers(len(words)))
                cut = words[max(0, at - AROUND):at + AROUND + 1]
                clean.append((cut, np.zeros(len(cut), np.int8)))
    out = [x[i] for x in (tagged, clean) for i in rng.permutation(len(x))[:WINDOWS // 2]]
    return [w for w, _ in out], [t for _, t in out]


def fit(texts: list[tuple[str, int]], share: float, seed: int = 11) -> SpanTagger:
    """A model of (text, label) pairs; share is that of label 1 among all labels."""
    nothing = SpanTagger({}, 0.0, np.ones((2, 2)), constant=share)
    if len({kind for _, kind in texts}) < 2:
        return nothing
    rng = np.random.default_rng(seed)
    sample = [(_words(t), kind) for t, kind in texts]
    windows, tags = _windows(sample, _marks(sample), rng)
    if not any(t.any() for t in tags):
        return nothing
    names: dict[str, int] = {}
    seen = Counter(k for w in windows for x in w for k in keys_of(x))
    for k in sorted(k for k, n in seen.items() if n > 1):
        names[k] = len(names)
    # keys of each token, padded with the last row, which stays 0
    rows = [np.array([[*(names.get(k, len(names)) for k in keys_of(x)), *[len(names)] * 4][:4] for x in w]) for w in windows]
    theta, bias, move = np.zeros(len(names) + 1), np.array([-2.0]), np.zeros((2, 2))
    squares = [np.full_like(p, 1e-8) for p in (theta, bias, move)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            some = order[k:k + BATCH]
            first = np.concatenate([[0], np.cumsum([len(rows[i]) for i in some])])
            keys, y = np.concatenate([rows[i] for i in some]), np.concatenate([tags[i] for i in some]).astype(float)
            odds, exp_move = np.exp(np.clip(theta[keys].sum(1) + bias[0], -40, 40)), np.exp(move)
            marginal = forward_backward(odds, first, exp_move)
            inside = np.ones(len(y), bool)
            inside[first[1:] - 1] = False
            left = np.flatnonzero(inside)
            pair = _pair_marginals(odds, first, exp_move, left)
            seen_pair = np.zeros((2, 2))
            np.add.at(seen_pair, (y[left].astype(int), y[left + 1].astype(int)), 1)
            diff = (y - marginal) / len(some)
            g_theta = np.bincount(keys.ravel(), np.repeat(diff, 4), len(theta)) - DECAY * theta
            g_theta[-1] = 0
            for p, s, g in zip((theta, bias, move), squares, (g_theta, diff.sum(keepdims=True), (seen_pair - pair) / len(some) - DECAY * move)):
                s += g * g
                p += RATE * g / np.sqrt(s)
    model = SpanTagger({k: float(theta[i]) for k, i in names.items() if abs(theta[i]) > 1e-3}, float(bias[0]), np.exp(move))
    model.curve = (1.0, 0.0)
    data, offsets = text_bytes(pa.array([t for t, _ in texts]))
    largest = [model.tag(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])[0] for a, b in lots(offsets, LOT)]
    model.curve = _curve(np.concatenate(largest), np.array([kind for _, kind in texts]), share)
    model.known, model.value = np.zeros(0, np.uint64), np.zeros(0)  # workers make their own
    return model


def _pair_marginals(odds: np.ndarray, first: np.ndarray, move: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Expected number of each transition over the tokens ``left`` and their successors."""
    ahead, behind = messages(odds, first, move), _behind(odds, first, move)
    after = behind[left + 1] * odds[left + 1]
    joint = np.array([[np.full(len(left), move[0, 0]), move[0, 1] * after], [move[1, 0] * ahead[left], move[1, 1] * ahead[left] * after]])
    return (joint / joint.sum((0, 1))).sum(-1)


def _curve(scores: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the log odds of the largest marginal, by Newton steps with the true share of labels."""
    p = np.clip(scores, 1e-13, 1 - 1e-13)
    x = np.clip(np.log(p) - np.log1p(-p), FLOOR, -FLOOR)
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    a, b = 0.5, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = np.array([(weight * (y - q) * x).sum() - 0.1 * a, (weight * (y - q)).sum()])
        h = weight * q * (1 - q)
        hess = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a + float(np.clip(step[0], -0.5, 0.5)), b + float(np.clip(step[1], -2, 2))
    return max(a, 0.0), b


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> SpanTagger:
    """Fitted on at most ``most`` documents of each class, none of the held-out fold (CRC-32 of the id mod 5 = 0)."""
    return fit(*labelled_texts(docs, labels, "toxic", 5, 0, most))


def tagged(docs: DataFrame, model: SpanTagger) -> DataFrame:
    """doc_id, score and spans (array of start and end, code points, end exclusive) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in lots(offsets, LOT):
                score, spans = model.tag(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                listed = pa.array([[{"start": s, "end": e} for s, e in x] for x in spans], kind)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(score), listed], names=["doc_id", "score", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, spans array<struct<start int, end int>>")


def op5_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores and offending offsets of all documents."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    offsets = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return tagged(docs, model).select(
        "doc_id", F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"), offsets.alias("offsets"))
