"""Ink operators and snippets against brute force, made pages and SQLite."""

from __future__ import annotations

import random
import sqlite3

import numpy as np
from pyspark.sql import functions as F

from quirelight.operators import query as qy
from quirelight.operators import raster
from quirelight.operators.snippet import snippet, snippet_column


def flooded(ink: np.ndarray, diagonal: bool) -> list[tuple]:
    """Blobs by a flood fill, a pixel at a time."""
    left, out = {tuple(p) for p in np.argwhere(ink)}, []
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + [(1, 1), (1, -1), (-1, 1), (-1, -1)] * diagonal
    while left:
        todo, held = [left.pop()], []
        while todo:
            y, x = todo.pop()
            held.append((y, x))
            for p in ((y + a, x + b) for a, b in steps):
                if p in left:
                    left.remove(p)
                    todo.append(p)
        ys, xs = zip(*held)
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(held)))
    return sorted(out)


def runs_of(ink: np.ndarray, page: str) -> list[tuple]:
    out = []
    for y, row in enumerate(ink):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        out += [(page, "ink", float(a), float(y), float(b - a), 1.0) for a, b in zip(edge[::2], edge[1::2])]
    return out


SCHEMA = "page_id string, kind string, x double, y double, w double, h double"


def test_blobs_against_flood_fill(spark):
    rng = np.random.default_rng(1)
    pages = {f"p{i}": rng.random((rng.integers(1, 25), rng.integers(1, 25))) < rng.choice([0.2, 0.5, 0.7]) for i in range(30)}
    for ink in pages.values():
        assert raster.components(ink) == flooded(ink, True) and raster.components(ink, False) == flooded(ink, False)
    rows = [r for p, ink in pages.items() for r in runs_of(ink, p)]
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "7")  # pages go over many batches
    try:
        got = raster.blobs(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set(key, before)
    for p, ink in pages.items():
        assert sorted((int(r.x), int(r.y), int(r.w), int(r.h), r.pixels) for r in got if r.page_id == p) == flooded(ink, True)
    assert raster.blobs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_enclosed_blanks():
    ink = np.array([list(r) for r in ("#####", "#.#.#", "#..##", "##.#.", "####.")]) == "#"
    assert raster.enclosed(ink).astype(int).tolist() == [[0] * 5, [0, 1, 0, 1, 0], [0, 1, 1, 0, 0], [0, 0, 1, 0, 0], [0] * 5]


def test_letters_in_solid_blocks(spark):
    ink = np.zeros((200, 300), bool)
    ink[20:60, 20:120] = True  # a bar with two letters left blank, one of them under the text layer
    ink[30:42, 30:38] = ink[30:42, 60:68] = False
    ink[100:103, 20:280] = True  # a rule: no block
    ink[150:153, 100:103] = True
    rows = runs_of(ink, "a") + [("a", "text", 58.0, 28.0, 12.0, 16.0), ("b", "text", 0.0, 0.0, 1.0, 1.0)]
    got = raster.reversed_letters(spark.createDataFrame(rows, SCHEMA), 0.5).collect()
    assert [tuple(r) for r in got] == [("a", 30.0, 30.0, 8.0, 12.0, 96)]


def test_orphans_stand_in_a_column_between_words(spark):
    ink, rows = np.zeros((400, 400), bool), []
    for k in range(4):
        y = 40 + 40 * k
        rows += [("a", "word", 20.0, float(y), 60.0, 20.0), ("a", "word", 150.0, float(y), 80.0, 20.0)]
        ink[y + 2:y + 18, 110:118] = True  # a digit between two words
        ink[y + 2:y + 18, 300:308] = k < 3  # words on one side only
        ink[y + 2:y + 18, 82:86] = True  # too near the word
    ink[300:316, 110:118] = True  # off the rows
    got = raster.orphan_glyphs(spark.createDataFrame(rows + runs_of(ink, "a"), SCHEMA), 20.0).collect()
    assert sorted(tuple(r)[1:] for r in got) == [(110.0, 42.0 + 40 * k, 8.0, 16.0) for k in range(4)]
    two = [r for r in rows if r[3] < 100]
    assert raster.orphan_glyphs(spark.createDataFrame(two + runs_of(ink, "a"), SCHEMA), 20.0).count() == 0


def test_stacks_are_cut_at_blank_rows(spark):
    ink = np.zeros((300, 300), bool)
    for k in range(4):
        ink[40 + 30 * k:56 + 30 * k, 50:62] = True
    ink[30:160, 70:72] = True  # a rule beside them
    words = [("a", "word", 90.0, 38.0 + 30 * k, 60.0, 20.0) for k in range(4)]
    regions = [("a", "region", 45.0, 35.0, 30.0, 120.0), ("a", "region", 90.0, 38.0, 60.0, 20.0)]
    got = raster.cut_stacks(spark.createDataFrame(runs_of(ink, "a") + words + regions, SCHEMA), 20.0).collect()
    assert sorted(tuple(r)[1:] for r in got) == [(0, 50.0, 40.0 + 30 * k, 12.0, 16.0, True) for k in range(4)]
    assert not raster.of_a_table([(0, 0, 10, 40), (0, 50, 10, 90)], [], 20.0) and raster.stack_rows(ink, (45, 35, 75, 58), 20.0) == []
    assert raster.stack_rows(ink, (400, 0, 410, 10), 20.0) == []
    row = np.zeros((20, 100), bool)
    row[5:15, 10:30] = row[5:15, 40:60] = True
    assert raster.word_cuts(row, (5, 0, 70, 20), [15, 50]) == [(10.0, 5 - 5, 30.0, 20), (40.0, 0, 60.0, 20)]
    assert raster.word_cuts(row, (80, 0, 90, 20), [85]) == [(80, 0, 90, 20)]


def test_snippets_are_fts5s(spark):
    rng = random.Random(7)
    words = "alpha beta gamma one two three four five. six: seven, Épée fréquence\n x9".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 20, 24, 25, 60, 200]))) for _ in range(150)]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table p using fts5(text, alternates, n unindexed, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("insert into p (n, text, alternates) values (?, ?, 'omega')", list(enumerate(texts)))
    for expression in ("alpha", "alpha beta", '"alpha beta"', "alpha OR gamma", "fre*", "alpha NOT seven", '"one two" OR epee', "omega", "^alpha", "alternates : omega"):
        phrases = qy.phrases(qy.parse(expression))
        for n, s in con.execute("select n, snippet(p, 0, '[', ']', ' … ', 24) from p where p match ?", (expression,)):
            assert snippet(texts[n], phrases) == " ".join(s.split()), (expression, texts[n])
    frame = spark.createDataFrame([(texts[0],), (None,), ("",)], "t string")
    got = [r[0] for r in frame.select(snippet_column(F.col("t"), qy.parse("alpha"))).collect()]
    assert got == [snippet(texts[0], qy.phrases(qy.parse("alpha"))), "", ""]


def test_the_snippet_query_is_fts5s(spark):
    from conftest import SMALL

    from quirelight.catalog import QUERIES, tables

    con = sqlite3.connect(":memory:")
    con.execute("create virtual table p using fts5(text, d unindexed, n unindexed, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("insert into p (d, n, text) values (?, ?, ?)", [tuple(r) for r in tables.pages(spark, SMALL).collect()])
    want = {(d, n): " ".join(s.split()) for d, n, s in con.execute("""select d, n, snippet(p, 0, '[', ']', ' … ', 24) from p where p match '"of the" OR licensed'""")}
    got = QUERIES["search_snippets"](spark, SMALL).collect()
    assert got and all(r.snippet == want[r.doc_id, r.page_number] for r in got)
