"""Each stage of the pipeline on nulls, empty texts, shared ids, repeated rows, odd columns and empty tables."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from quirelight.llm import packing

GOOD = "lora nera tiga dun sola mira teppa nar lo mi solne raga"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("stages")
    rows = [(i, f"{GOOD} {i}" if i % 2 else f"$$$ ### {i} %%% !!!", 1) for i in range(60)]
    spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i, _, _ in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node int, slot string"
WORDS = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
ROWS = [
    (None, WORDS("a", 30), None, "s", 9, 1.0, 1, "x"), (None, WORDS("b", 12), "en", "s", 9, None, None, None),
    (7, WORDS("c", 8), "en", "t", 9, 1.0, 1, "x"), (7, WORDS("d", 50) + "\n\tpwd: Zk!9x@Lq#2w", "en", "t", 9, 1.0, 1, "x"),
    (8, "", "en", "t", 9, 1.0, 1, "x"), (8, "", "en", "t", 9, 1.0, 1, "x"), (9, None, None, None, None, None, None, None),
    (10, WORDS("e", 40), "en", None, 9, 1.0, 1, "x"), (10, WORDS("e", 40), "en", None, 9, 1.0, 1, "x"), (11, WORDS("e", 40), "de", "s", 9, 1.0, 1, "x"),
]


def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("a.b", F.lit(1))


def as_text(rows) -> Counter:
    return Counter(map(str, map(tuple, rows)))


def test_the_classifier_keeps_rows_as_they_are(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("attention", F.lit("x")).withColumn("a.b", F.lit(1))
    for lost in (docs, docs.union(docs.filter("doc_id = 1")).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None).cast("string")))):
        got = cp.quality(spark, lost, folder)
        assert got.columns == docs.columns and not as_text(got.collect()) - as_text(lost.collect())
    assert {r.doc_id for r in got.collect() if r.doc_id is not None} == {i for i in range(60) if i % 2}
    assert cp.quality(spark, docs.limit(0), folder).count() == 0


def test_near_duplicates_lose_copies_only(spark, folder):
    got = cp.near_duplicates(spark, frame(spark), folder)
    assert got.columns == frame(spark).columns
    want = Counter(r[:2] for r in ROWS) - Counter([(10, WORDS("e", 40)), (11, WORDS("e", 40))])
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert cp.near_duplicates(spark, frame(spark).limit(0), folder).count() == 0


def test_secrets_go_and_documents_stay(spark, folder):
    got = cp.secrets(spark, frame(spark), folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
    assert sum("Zk!9x" in (r.text or "") for r in got) == 0 and sum((r.text or "").endswith("\n\tpwd: [secret]") for r in got) == 1
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert cp.secrets(spark, frame(spark).limit(0), folder).count() == 0


def test_mixing_gives_each_row_its_own_share(spark, folder):
    got = cp.mixing(spark, frame(spark), folder)
    assert got.columns == frame(spark).columns
    got = got.collect()
    size = lambda t: len((t or "").split())
    total = {s: sum(size(r[1]) for r in ROWS if r[3] == s) for s in ("s", "t", None)}
    taken = {s: sum(size(r.text) for r in got if r.source == s) for s in total}
    assert abs(sum(taken.values()) - 1.5 * sum(total.values())) <= 2 and all(taken[s] <= 2 * total[s] for s in total)
    texts = [r[1] or "" for r in ROWS]
    assert all(any(t.startswith(r.text) for t in texts) for r in got)
    assert cp.mixing(spark, frame(spark).limit(0), folder).count() == 0


def test_packing_holds_every_document(spark, folder):
    got = cp.packing(spark, frame(spark), folder)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = packing.Units(packing.word_bpe_path()).whole
    want = Counter()
    for r in ROWS:
        want[r[0]] += len(whole.encode(r[1] or "", add_special_tokens=False).ids) + 1
    have = Counter()
    for r in got.collect():
        have[r.doc_id] += r.length
    assert have == want and cp.packing(spark, frame(spark).limit(0), folder).count() == 0
