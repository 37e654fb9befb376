"""Queries that have no SQL cover all rows of their tables."""

from __future__ import annotations

from collections import defaultdict

from conftest import SMALL
from pyspark.sql import functions as F

from quirelight.catalog import QUERIES
from quirelight.operators import audit, layout, quality


def test_reading_order_places_every_word_of_every_document(spark):
    got = defaultdict(dict)
    for r in QUERIES["reading_order"](spark, SMALL).collect():
        assert r.word_id not in got[r.page_id]
        got[r.page_id][r.word_id] = r.place
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("words")).collect()
    pages = {f"{r.doc_id}:{i // 60}": r.words[i:i + 60] for r in docs for i in range(0, len(r.words), 60)}
    assert {p: sorted(w) for p, w in got.items()} == {p: list(range(len(w))) for p, w in pages.items()}
    for page, words in list(pages.items())[::7]:
        box = lambda n: ((n // 3 % 2) * 300 + n % 3 * 60, n // 6 * 14 + n // 30 * 20, min(len(words[n]), 10) * 5, 10)  # noqa: B023, E731
        by_place = sorted(got[page], key=got[page].get)
        assert by_place == layout.reading_order(sorted(range(len(words)), key=lambda n: box(n)[1::-1]), box)


def test_pages_of_reading_order_may_span_batches(spark):
    key, rows = "spark.sql.execution.arrow.maxRecordsPerBatch", [(p, n, float(n % 7 * 60), float(n // 7 * 14), 20.0, 10.0) for p in (1, 2, None) for n in range(50)]
    before = spark.conf.get(key)
    spark.conf.set(key, "8")
    try:
        got = layout.in_reading_order(spark.createDataFrame(rows, "page_id int, n int, x double, y double, w double, h double")).collect()
    finally:
        spark.conf.set(key, before)
    for p in (1, 2, None):
        assert sorted(r.place for r in got if r.page_id == p) == list(range(50))
        want = layout.reading_order([r[1:] for r in rows if r[0] == p], lambda b: b[1:])
        assert [r.n for r in sorted((r for r in got if r.page_id == p), key=lambda r: r.place)] == [b[0] for b in want]


def test_learned_rate_folds_every_order(spark):
    runs = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/orders.parquet").collect():
        runs[str(r.o_custkey)].append((r.o_orderkey, float(r.o_totalprice) / 1000, r.o_custkey % 50 + 1))
    want = {}
    for key, held in runs.items():
        rate = pages = None
        for _, new, n in sorted(held):
            rate, pages = audit.fold_rate(rate, pages, new, n)
        want[key] = (round(rate, 6), pages)
    assert {r.key: (round(r.rate, 6), r.pages) for r in QUERIES["learned_rate"](spark, SMALL).collect()} == want


def test_common_words_of_the_pages_themselves(spark):
    pages = spark.createDataFrame([(1, 1, "The probe and the meter"), (2, 1, "the Étude"), (3, 1, None)], "doc_id int, page_number int, text string")
    assert quality.commonest_words(pages, 2) == ["the", "and"]
    assert {r.doc_id: r.common for r in quality.page_metrics(pages).collect()} == {1: 5, 2: 2, 3: 0}
    assert {r.doc_id: r.common for r in quality.page_metrics(pages, ["the"]).collect()} == {1: 2, 2: 1, 3: 0}
