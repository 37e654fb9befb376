"""Matching, scores and notation against SQLite's FTS5 and known cases."""

from __future__ import annotations

import random
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from quirelight.functions.text import fold_word
from quirelight.operators import query as qy
from quirelight.operators import search

WORDS = "alpha beta gamma delta Épée fréquence one two three".split()


def corpus(n: int, seed: int) -> list[tuple[int, int, str, str]]:
    rng = random.Random(seed)
    pick = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    return [(i // 3, i % 3 + 1, pick(rng.randint(1, 14)), pick(rng.randint(0, 3))) for i in range(n)]


def fts5(rows, expression: str) -> dict[tuple[int, int], float]:
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table p using fts5(text, alternates, d unindexed, n unindexed, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("insert into p (d, n, text, alternates) values (?, ?, ?, ?)", rows)
    return {(d, n): s for d, n, s in con.execute("select d, n, bm25(p, 10.0, 1.0) from p where p match ?", (expression,))}


@pytest.fixture(scope="module")
def pages(spark):
    rows = corpus(60, 3)
    frame = spark.createDataFrame(rows, "doc_id long, page_number int, text string, alternates string").coalesce(1).cache()
    return rows, frame, search.Index(search.postings(frame).coalesce(1).cache(), search.page_stats(frame).cache())


@pytest.mark.parametrize("expression", [
    "alpha", "alpha AND beta", "alpha OR gamma", "alpha NOT beta", '"alpha beta"', "gam*", "frequence", "EPEE", "NEAR(alpha beta, 2)", "NEAR(alpha beta gamma, 4)",
    '"alpha beta" OR gamma NOT two', "(one OR two) AND three", "alpha + beta", "^alpha", "text : one", '"one tw"*', "one two", "missing", "one NOT two NOT three",
])
def test_matches_and_scores_like_fts5(pages, expression):
    rows, _, index = pages
    got = {(r.doc_id, r.page_number): r.score for r in search.bm25(index, qy.parse(expression)).collect()}
    want = fts5(rows, expression)
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_written_index_reads_the_shards_of_its_terms(spark, pages, tmp_path):
    _, frame, built = pages
    search.write_index(frame, str(tmp_path))
    index = search.read_index(spark, str(tmp_path))
    node = qy.parse('"alpha beta"')
    assert sorted(map(tuple, search.matching(index, node).collect())) == sorted(map(tuple, search.matching(built, node).collect()))
    for terms, prefix in ((["alpha"], None), ([], "alp"), (["beta"], "ga")):
        plan = index.of_terms(terms, prefix)._jdf.queryExecution().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*shard", plan)
    for query in ("gam*", "g*", "alpha AND beta", "NEAR(alpha beta, 2)"):
        got = {(r.doc_id, r.page_number): r.score for r in search.bm25(index, qy.parse(query)).collect()}
        want = {(r.doc_id, r.page_number): r.score for r in search.bm25(built, qy.parse(query)).collect()}
        assert got == pytest.approx(want)


def test_a_search_reads_no_document(spark, pages, tmp_path):
    """All that a search scans is the written index: its postings of the terms, its page counts and its totals."""
    _, frame, _ = pages
    search.write_index(frame, str(tmp_path))
    plan = search.bm25(search.read_index(spark, str(tmp_path)), qy.parse("alpha beta"))._jdf.queryExecution().toString()
    assert "regexp_extract_all" not in plan and "text#" not in plan.split("== Physical Plan ==")[1]


@pytest.mark.parametrize("query, expected", [
    ("HP-IB handshake", '"HP-IB" AND "handshake"'), ("yig OR sweeper", "yig OR sweeper"), ("wave*", "wave*"), (":TIMebase:SCALe", '"TIMebase" AND "SCALe"'),
    (":CHANnel<N>:INPut", '"CHANnel" AND "INPut"'), (":TRIGger:MODE {EDGE|GLITch|ADVanced}", '"TRIGger" AND "MODE" AND ("EDGE" OR "GLITch" OR "ADVanced")'),
    ("DC50|DCFifty", '("DC50" OR "DCFifty")'), ("<N>", None), ("<N> SCALe", '"SCALe"'), ("", None), ("--", None), ('"of the" x', '"of the" AND "x"'), ("A<open", '"A"'),
])
def test_notation(query, expected):
    assert qy.prepare(query) == expected


@pytest.mark.parametrize("query, is_one", [("WORD", False), ("COMMAND REFERENCE", False), ("NOTE", False), ("this AND", False), ("OR that", False), ("a OR b", True), ("NEAR(a b)", True)])
def test_what_is_an_expression(query, is_one):
    assert qy.looks_like_expression(query) is is_one


def test_a_broken_expression_is_read_as_words():
    node, note = qy.read("attenuator AND (protection")
    assert note and [p.tokens for p in qy.phrases(node)] == [("attenuator",), ("and",), ("protection",)]
    assert qy.mnemonics(":TRIGger:MODE {EDGE|GLITch|ADVanced}") == ["TRIGger", "GLITch", "ADVanced"]
    assert qy.mnemonics("SKEW MHz") == [] and qy.is_bare_term("SKEW") and not qy.is_bare_term(":SKEW")
    assert qy.terms("The AND 2 fréquence x") == ["The", "fréquence"]
    assert fold_word("Épée") == "epee" and fold_word("Ø") == "ø"


def library(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, path string, title string, content_hash string, page_number int, text string, recovered string, embedded_chars long")
    return frame


PROSE = "the attenuation of this stage is set by a pad and the attenuation attenuation attenuation is read from the scale of the meter on the panel"


def test_bias_brings_a_label_forward(spark):
    rows = [(1, "a/one.pdf", "One", "h1", 1, "\n".join([PROSE] * 2), None, 10), (2, "b/two.pdf", "Two", "h2", 1, "ATTenuation\n" + "x " * 60, None, 10), *((i, f"c/{i}.pdf", "C", f"h{i}", 1, "other words here", None, 5) for i in range(3, 9))]
    pages = library(spark, rows)
    index = search.build_index(pages)
    plain = [r.path for r in search.search(pages, index, "attenuation", bias=None).orderBy("rank").collect()]
    biased = [r.path for r in search.search(pages, index, "attenuation", model="two").orderBy("rank").collect()]
    assert plain == ["a/one.pdf", "b/two.pdf"] and biased == ["b/two.pdf", "a/one.pdf"]


def test_copies_fold_and_sources_are_told(spark):
    rows = [(1, "a/x.pdf", "X", "same", 1, "needle here", None, 11), (2, "b/x.pdf", "X", "same", 1, "needle here", None, 11), (3, "c/y.pdf", "Y", "", 1, "hay\nneedle", "needle", 0), (4, "d/z.pdf", "Z", "", 1, "needle and hay needle", "hay needle", 5),
            *((i, f"e/{i}.pdf", "E", "", 1, "nothing of note", None, 5) for i in range(5, 15))]
    pages = library(spark, rows)
    got = {r.path: r for r in search.search(pages, search.build_index(pages), "needle").collect()}
    assert set(got) == {"a/x.pdf", "c/y.pdf", "d/z.pdf"} and got["a/x.pdf"].also_at == ["b/x.pdf"]
    assert (got["c/y.pdf"].match_source, got["c/y.pdf"].page_source, got["d/z.pdf"].match_source, got["d/z.pdf"].page_source) == ("Ocr", "Ocr", "Mixed", "Mixed")
    assert search.search(pages, search.build_index(pages), "needle", fold=False).count() == 4
    assert search.search(pages, search.build_index(pages), "--").count() == 0


def test_pages_of_documents(spark):
    docs = spark.createDataFrame([(1, "\n".join(map(str, range(17)))), (2, ""), (3, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.page_number, r.text) for r in search.derived_pages(docs).collect())
    assert [(d, n) for d, n, _ in got] == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)] and got[2][2] == "16"
    assert search.page_stats(search.derived_pages(docs)).filter(F.col("doc_id") > 1).count() == 0
