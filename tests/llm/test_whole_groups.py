"""Documents without an id of their own, and sources smaller than a block, come through."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_dedup_and_text import brute

from quirelight.llm import minhash, mixing, packing
from quirelight.llm.textbytes import span_hashes, text_bytes


def test_documents_without_an_id_of_their_own_stay(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("c")), (7, text("d")), (7, text("e")), (5, text("a") + " x"), (900, text("b") + " x"), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter([(5, text("a") + " x"), (900, text("b") + " x"), (None, text("c")), (7, text("d")), (7, text("e")), (901, "")])
    assert Counter(map(tuple, minhash.without_near_duplicates(docs).collect())) == want
    of = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert of == {(None, 5), (None, 900), (None, None), (7, 7), (5, 5), (900, 900), (901, 901)}


def test_every_source_gives_its_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_SLOTS", 64)  # blocks of some 480 words
    rows = [(i, "a", 100) for i in range(200)] + [(1000 + i, f"s{i:02}", 20 + i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    documents, plan = mixing.mix(docs)
    by = documents.groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert len(by) == 31 and all(abs(r.taken - r.target) <= 0.5 for r in by)
    block = mixing.block_words(sum(r.target for r in by))
    held = plan.groupBy("slot").agg(F.countDistinct("source").alias("n"), F.sum(F.col("to_word") - F.col("from_word")).alias("words")).collect()
    assert all(r.n == 1 and 0 < r.words <= block for r in held)


def twins(n: int) -> tuple[str, str]:
    """The Thue-Morse word of n letters and its complement: equal under every polynomial modulo 2**64 from 1,024 letters on."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_unlike_words_are_told_apart(spark, n):
    one, two = twins(n)
    docs = spark.createDataFrame([(1, one), (2, two), (3, one), (4, f"{one} {two}"), (5, f"{two} {one}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
    units = packing.Units(packing.word_bpe_path())
    data, offsets = text_bytes(pa.array([one, two, f"{one} {two}"]))
    got = [x.tolist() for x in packing._doc_ids(units, data, offsets)]
    assert got == [units.whole.encode(t, add_special_tokens=False).ids for t in (one, two, f"{one} {two}")]


def test_units_with_equal_hashes_keep_their_own_ids(monkeypatch):
    """Even if the hash were constant."""
    monkeypatch.setattr(packing, "span_hashes", lambda data, starts, ends: np.full(len(starts), 7, np.uint64))
    units = packing.Units(packing.word_bpe_path())
    for texts in (["alpha beta gamma alpha"], ["beta delta", "gamma"], ["alpha"]):
        data, offsets = text_bytes(pa.array(texts))
        assert [x.tolist() for x in packing._doc_ids(units, data, offsets)] == [units.whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_hashes_of_spans_of_all_lengths():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 3, 4_000).astype(np.uint8)
    starts = rng.integers(0, 3_900, 3_000)
    ends = starts + rng.integers(0, 40, 3_000)
    for lane in (0, 1):
        of = {}
        for h, a, b in zip(span_hashes(data, starts, ends, lane).tolist(), starts, ends):
            assert of.setdefault(h, data[a:b].tobytes()) == data[a:b].tobytes()
        assert len(of) == len({data[a:b].tobytes() for a, b in zip(starts, ends)})


def test_shingles_that_share_one_hash_are_counted_apart():
    x = np.array([[5, 5, 5, 9], [1, 2, 1, 3]], np.uint64)
    y = np.array([[5, 9], [2, 4]], np.uint64)
    assert minhash._distinct(x).T.tolist() == [[5, 1], [5, 2], [9, 3]]
    assert minhash.shared(minhash._distinct(x), y) == 1 == minhash.shared(y, minhash._distinct(x))
    assert minhash.shared(np.array([[5, 9], [1, 3]], np.uint64), y) == 0


def test_big_buckets_are_compared_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(minhash, "_BLOCK", 20_000)
    rng = random.Random(12)
    core, rows = [f"c{i}" for i in range(120)], []
    for g in range(12):  # groups that share most words but not enough to link, and chains inside them
        words = core[:104] + [f"g{g}x{i}" for i in range(16)]
        for k in range(8):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            words[rng.randrange(120)] = f"n{g}x{k}"
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, (_, c) in brute(rows, 80).items()}


def test_extra_columns_of_any_name_stay(spark):
    rows = [(i, f"{'a b c d e f' if i < 4 else 'x'} {i // 2}", i, float(i), "s", [i]) for i in range(8)] + [(9, "", 1, 1.0, "n", None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long, `row` double, `a.b` string, component array<int>")
    kept = minhash.without_near_duplicates(docs)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    want = [r for i, r in enumerate(rows) if i in (0, 2, 4, 6, 8, 9)]
    assert Counter(map(str, map(tuple, kept.collect()))) == Counter(map(str, want))
    assert minhash.without_near_duplicates(docs.limit(0)).count() == 0
