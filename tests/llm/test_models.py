"""Quality and toxicity models, neighbours: exactness of their parts and accuracy on rows they did not see."""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from quirelight.llm import neighbours, quality, toxicity
from quirelight.llm.labelled import fold_of, labelled_texts
from quirelight.llm.queries import QUERIES
from quirelight.llm.textbytes import text_bytes

BIG = "/root/testdata/sf0.1"


def held_out_accuracy(spark, name: str, label: str, folds: int, out: int) -> tuple[float, float]:
    got = QUERIES[name](spark, BIG).toPandas().set_index("doc_id")
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    assert all(h == (zlib.crc32(str(i).encode()) % folds == out) for i, h in got.held_out.items())
    labels = spark.read.parquet(f"{BIG}/labels.parquet").toPandas().set_index("doc_id")[label]
    both = got[got.held_out].join(labels, how="inner")
    return float((both.predicted == both[label]).mean()), float(max(both[label].mean(), 1 - both[label].mean()))


def test_quality_on_rows_not_seen(spark):
    right, usual = held_out_accuracy(spark, "op3_quality_attention", "quality", 3, 1)
    assert right >= 0.98 > usual


def test_toxicity_on_rows_not_seen(spark):
    right, usual = held_out_accuracy(spark, "op5_toxicity_crf", "toxic", 5, 0)
    assert right >= 0.96 > usual


def test_samples_are_bounded_and_leave_out_the_fold(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if i % 10 else None) for i in range(200)] + [(None, 1)], "doc_id long, quality int")
    sample, share = labelled_texts(docs, labels, "quality", 3, 1, 20)
    assert len(sample) == 40 and all(zlib.crc32(t[1:].encode()) % 3 != 1 for t, _ in sample) and 0.3 < share < 0.7
    assert labelled_texts(docs, labels.limit(0), "quality", 3, 1, 20) == ([], 0.5)
    assert spark.range(9).select(fold_of(F.col("id"), 5)).collect()[4][0] == zlib.crc32(b"4") % 5


def test_models_without_both_classes_give_the_share():
    assert quality.fit([("a", 1)], 0.9).scores(*text_bytes(pa.array(["x", None])))[0].tolist() == [0.9, 0.9]
    assert toxicity.fit([], 0.5).tag(*text_bytes(pa.array(["", "x"])))[0].tolist() == [0.5, 0.5]


def test_passages_do_not_depend_on_their_lot():
    texts = ["", "a b a a", "x " * 900, "é" * 400, "The | the | THE!!\n"]
    together, first = quality.passages(*text_bytes(pa.array(texts)))
    assert first.tolist() == [0, 1, 2, 6, 8, 9]
    for i, t in enumerate(texts):
        alone, _ = quality.passages(*text_bytes(pa.array([t])))
        assert np.allclose(alone, together[first[i]:first[i + 1]], atol=1e-6)


def test_attention_and_gradients_against_plain_sums():
    rng = np.random.default_rng(8)
    first, x, y, balance = np.array([0, 1, 4, 9]), rng.normal(size=(9, quality.FEATURES)) / 8, np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    hidden, gate = 5, 3
    w = {k: rng.normal(size=n) / 2 for k, n in (("W", (quality.FEATURES, hidden)), ("b", hidden), ("V", (hidden, gate)), ("U", (hidden, gate)), ("w", gate), ("c", hidden), ("d", 1))}
    model = quality.AttentionModel(w, np.zeros(quality.FEATURES), np.ones(quality.FEATURES))

    def logits() -> list[float]:
        """By the definition, a passage at a time."""
        out = []
        for a, b in zip(first[:-1], first[1:]):
            h = [[np.tanh(sum(x[i, f] * w["W"][f, j] for f in range(quality.FEATURES)) + w["b"][j]) for j in range(hidden)] for i in range(a, b)]
            e = [sum(w["w"][g] * np.tanh(np.dot(p, w["V"][:, g])) / (1 + np.exp(-np.dot(p, w["U"][:, g]))) for g in range(gate)) for p in h]
            share = np.exp(e) / np.exp(e).sum()
            out.append(sum(s * np.dot(p, w["c"]) for s, p in zip(share, h)) + w["d"][0])
        return out

    assert np.allclose(model.forward(x, first)[0], logits())
    loss = lambda: float(np.mean(balance * [np.log1p(np.exp(-z if t else z)) for z, t in zip(logits(), y)]))
    for name, grad in model.gradients(x, first, y, balance).items():
        for at in [tuple(rng.integers(n) for n in w[name].shape) for _ in range(4)]:
            w[name][at] += 1e-5
            up = loss()
            w[name][at] -= 2e-5
            assert grad[at] == pytest.approx((up - loss()) / 2e-5, abs=1e-6)
            w[name][at] += 1e-5


def test_queries_of_the_models_on_odd_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, columns of any name; then empty tables."""
    long = "word " * 60_000 + "é"
    docs = [(i, f"lora nera {'idiot ' if i % 2 else ''}tiga {i}", "x", 0.5) for i in range(40)] + [(None, None, "x", 1.0), (50, "", None, None), (51, long, "y", 2.0), (3, "lora idiot", "x", 0.5), (3, "lora idiot", "x", 0.5)]
    schema = "doc_id long, text string, attention string, score double"
    labels = [(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (5, None, None), (51, 1, 0)]
    for n in (len(docs), 0):
        folder = tmp_path / str(n)
        spark.createDataFrame(docs[:n], schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame(labels if n else [], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        for name in ("op3_quality_attention", "op5_toxicity_crf"):
            got = QUERIES[name](spark, str(folder)).collect()
            assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
            assert len({r.score for r in got if r.doc_id == 3 and n}) <= 2
            assert not any(r.held_out for r in got if r.doc_id is None)
    frame = spark.createDataFrame(docs, schema).withColumn("a.b", F.lit(1))
    added = quality.scored(frame, quality.fit([("a b", 1), ("!!", 0)], 0.5))
    assert added.columns == ["doc_id", "text", "a.b", "score", "attention"] and added.count() == len(docs)


def test_an_id_of_many_rows_gives_one_text_to_learn_from(spark):
    docs = spark.range(5_000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")).union(
        spark.createDataFrame([(2, "x"), (3, "y" * 200)], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (1, 1)], "doc_id long, toxic int")
    assert sorted(labelled_texts(docs, labels, "toxic", 5, 4, 10, 100)[0]) == [("t0", 1), ("x", 0)]


def test_chains_longer_than_a_block(monkeypatch):
    rng = np.random.default_rng(6)
    sizes = [0, 1, 7, 8, 9, 16, 100, 0, 33]
    first, move = np.concatenate([[0], np.cumsum(sizes)]), np.exp(rng.normal(size=(2, 2)) * 2)
    odds = np.exp(rng.normal(size=first[-1]) * 3)
    whole = toxicity.forward_backward(odds, first, move)
    monkeypatch.setattr(toxicity, "CHAIN", 8)
    assert np.allclose(toxicity.forward_backward(odds, first, move), whole)


def test_windows_are_drawn_from_the_whole_document():
    words = ["a"] * 2_000
    for i in range(0, 2_000, 20):
        words[i] = "mark"
    windows, tags = toxicity._windows([(words, 1), (["b"] * 500, 0)], {"w:mark"}, np.random.default_rng(1))
    assert len(windows) == toxicity.TOXIC_WINDOWS + toxicity.CLEAN_WINDOWS and all(t.any() for t in tags[:toxicity.TOXIC_WINDOWS])


def test_marginals_against_all_paths():
    rng = np.random.default_rng(0)
    first, move = np.array([0, 4, 4, 5, 11]), np.exp(rng.normal(size=(2, 2)))
    odds = np.exp(rng.normal(size=11) * 2)
    want, pairs = np.zeros(11), np.zeros((2, 2))
    left = np.array([i for i in range(10) if i + 1 not in first])
    for a, b in zip(first[:-1], first[1:]):
        weights = []
        for path in itertools.product((0, 1), repeat=b - a):
            w = np.prod([odds[a + i] ** s for i, s in enumerate(path)]) * np.prod([move[x, y] for x, y in zip(path, path[1:])])
            weights.append((w, path))
        total = sum(w for w, _ in weights)
        for w, path in weights:
            want[a:b] += w / total * np.array(path)
            for x, y in zip(path, path[1:]):
                pairs[x, y] += w / total
    assert np.allclose(toxicity.forward_backward(odds, first, move), want)
    assert np.allclose(toxicity._pair_marginals(odds, np.array([0, 4, 5, 11]), move, left), pairs)


def test_spans_stand_where_the_words_do():
    rng = np.random.default_rng(3)
    usual = [f"{a}{b}" for a in ("lo", "mi", "nar", "tep", "sol") for b in ("ra", "ne", "ti", "ga", "dun")]
    sample = []
    for i in range(300):
        words = list(rng.choice(usual, 30))
        if i % 3 == 0:
            words[int(rng.integers(30))] = str(rng.choice(["Idiot", "scum"]))
        sample.append((" ".join(words), int(i % 3 == 0)))
    model = toxicity.fit(sample, 1 / 3)
    text = "é lora nera, you idiot! mira"
    score, spans = model.tag(*text_bytes(pa.array(["lora nera mira", text, None])))
    assert spans[0] == [] == spans[2] and [text[a:b] for a, b in spans[1]] == ["idiot"]
    assert score[1] > 0.5 > max(score[0], score[2])


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def exact(rows: list[tuple[int, list[float]]], queries: list[int], k: int) -> dict[int, list[tuple[int, float]]]:
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], np.float32).astype(np.float64)
    out = {}
    for q in queries:
        far = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(far[i])) for i in order]
    return out


def test_recall_against_brute_force(spark):
    got = QUERIES["op4_collision_neighbours"](spark, BIG).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{BIG}/embeddings.parquet").collect()]
    want = exact(rows, [i for i, _ in rows if i % 100 == 0], 10)
    found = {q: {(r.vec_id) for r in got if r.query_id == q} for q in want}
    assert sum(len(found[q] & {i for i, _ in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
    far = {(q, i): d for q, x in want.items() for i, d in x}
    assert all(r.score == pytest.approx(far[r.query_id, r.vec_id], rel=1e-12) for r in got if (r.query_id, r.vec_id) in far)
    assert all(sorted(r["rank"] for r in got if r.query_id == q) == list(range(1, 11)) for q in want)


def test_copies_ties_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 300)] + [(i, [float(x) for x in rng.normal(size=3)]) for i in range(300, 340)]
    odd = [(400, None), (500, [0.0, 0.0, 0.0]), (600, [nan, 1.0, 1.0]), (700, [inf, 1.0, 1.0]), (800, [1.0, None, 1.0]), (900, [1.0, 2.0]), (None, [1.0, 2.0, 3.0]), (1000, [])]
    frame = vectors(spark, rows + odd).withColumn("label", F.lit(1)).withColumn("score", F.lit("x"))
    got = neighbours.nearest(frame, F.col("vec_id") % 100 == 0).collect()
    want = exact(rows, [0, 100, 200, 300], 10)
    assert {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] for q in want} == {q: [i for i, _ in x] for q, x in want.items()}
    assert {r.query_id for r in got} == set(want)
    few = neighbours.nearest(vectors(spark, rows[:4]), F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r["rank"]) for r in few] == [(1, 1), (2, 2), (3, 3)]
    assert neighbours.nearest(frame.limit(0), F.lit(True)).count() == 0
