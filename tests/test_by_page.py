"""Layout and ink operators that work on a page as one row: against the rows of their letters, plain Python and a page at a time; and that their queries shuffle nothing."""

from __future__ import annotations

import contextlib
import io
import random

import numpy as np
from conftest import SMALL

from quirelight.catalog import QUERIES, layouts
from quirelight.operators import layout, raster


def plan_of(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def exchanges(df) -> int:
    """Shuffles by a key; dealing a small table to all cores is none."""
    return plan_of(df).count("Exchange hashpartitioning") + plan_of(df).count("Exchange rangepartitioning")


def test_alignment_shuffles_no_letters(spark):
    assert exchanges(QUERIES["word_alignment"](spark, SMALL)) == 0


def test_aligned_rows(spark):
    rng = random.Random(3)
    words, letters, want = [], [], set()
    for p in range(12):
        shown = []
        for n in range(rng.randrange(12)):
            item = "".join(rng.choice("ab c\U0001f600\t") for _ in range(rng.randrange(5)))
            usable, begin = rng.random() < 0.7, len(shown)
            words.append((p, n, item, usable))
            if usable:
                shown += [c for c in item if not c.isspace()]
                want.add((p, n, "".join(shown[begin:]), begin, len(shown)))
        seen = [rng.choice([c, c, "fi", "?"]) for c in shown][:15]
        lost = {rng.randrange(15)} if p % 3 == 0 else set()
        letters += [(p, n, c) for n, c in enumerate(seen) if n not in lost]
    by_page = {}
    for p, n, c in letters:
        by_page.setdefault(p, {})[n] = c
    want = {(p, n, e, got, got == e) for p, n, e, a, b in want if (got := "".join(by_page.get(p, {}).get(i, "") for i in range(a, b)))}
    rng.shuffle(words)
    rng.shuffle(letters)
    got = layout.aligned(spark.createDataFrame(words, "page_id int, word_no int, item string, usable boolean"), spark.createDataFrame(letters, "page_id int, n int, letter string"))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20


def test_pages_of_sixty_words(spark):
    want = {(r.page_id, r.word_id): r["item"] for r in layouts._boxes(spark, SMALL).collect()}
    got = {(r.page_id, n): w for r in layouts._page_words(spark, SMALL).collect() for n, w in enumerate(r["items"])}
    assert got == want and want


def ink_of(rng, solid: bool) -> list[tuple]:
    """A page of runs, some of which touch, overlap or are empty: blocks with holes, or glyphs between words."""
    out = []
    for _ in range(rng.randrange(1, 4)):
        x, y, w, h = rng.randrange(60), rng.randrange(60), rng.randrange(8, 50), rng.randrange(8, 40)
        for r in range(h):
            cut = rng.randrange(w) if solid and 2 < r < h - 3 and rng.random() < 0.9 else None
            spans = [(x, w)] if cut is None else [(x, 5), (x + 5 + w % 9, max(0, w - 5 - w % 9))] if rng.random() < 0.9 else [(x, cut), (x + cut, w - cut)]
            out += [(float(a), float(y + r), float(b), 1.0) for a, b in spans]
    rng.shuffle(out)
    return out + [(150.0, 150.0, 1.0, 1.0)]


def each_by_itself(pages: list[dict], kind: str, run) -> list[tuple]:
    out = []
    for n, p in enumerate(pages):
        rows = [("ink", *r) for r in p["ink"]] + [(kind, *r) for r in p[kind]]
        ink, boxes = raster._raster({k: list(c) for k, c in zip(("kind", "x", "y", "w", "h"), zip(*rows))}) if rows else (np.zeros((0, 0), bool), {})
        out += [(n, *map(float, r)) for r in run(ink, boxes.get(kind, []))]
    return sorted(out)


def together(spark, pages: list[dict], kind: str, run) -> list[tuple]:
    box = "array<struct<x:double,y:double,w:double,h:double>>"
    df = spark.createDataFrame([(n, p["ink"], p[kind]) for n, p in enumerate(pages)], f"page_id int, ink {box}, {kind} {box}")
    return sorted(tuple(map(float, r)) for r in run(df).collect())


def test_letters_of_many_pages_are_those_of_each(spark):
    rng = random.Random(5)
    pages = [{"ink": ink_of(rng, True), "text": [(float(rng.randrange(60)), float(rng.randrange(60)), 9.0, 9.0) for _ in range(rng.randrange(4))]} for _ in range(150)]
    pages[7]["ink"] = []
    pages[9]["ink"] = [(2.0**21, 1.0, 3.0, 1.0)]  # worked on by itself
    want = each_by_itself(pages, "text", lambda ink, text: raster.holes_in_blocks(ink, text, 0.5))
    assert together(spark, pages, "text", lambda df: raster.reversed_on_pages(df, 0.5)) == want and len(want) > 10


def test_orphans_of_many_pages_are_those_of_each(spark):
    rng, pages = random.Random(6), []
    for _ in range(150):
        ink, words = ink_of(rng, False) if rng.random() < 0.2 else [], []
        for k in range(rng.randrange(1, 7)):
            y, x = 40.0 * k + rng.randrange(3), 110.0 + rng.randrange(8)
            words += [(20.0, y, 60.0, 20.0), (150.0 + rng.randrange(-30, 30), y, 80.0, 20.0)][:rng.choice([1, 2, 2, 2])]
            for at in (x, x + 8 + rng.randrange(1, 9))[:rng.randrange(3)]:  # side by side, some near enough to be one
                ink += [(at, y + r, 6.0, 1.0) for r in range(2, rng.choice([8, 14, 18, 18]))]
        pages.append({"ink": ink, "word": words})
    want = each_by_itself(pages, "word", lambda ink, words: [(a, b, c - a, d - b) for a, b, c, d in raster.orphans(ink, words, 20.0)])
    assert together(spark, pages, "word", lambda df: raster.orphans_on_pages(df, 20.0)) == want and len(want) > 30


def test_ink_is_not_dealt_run_by_run(spark):
    assert exchanges(QUERIES["reversed_letters"](spark, SMALL)) == 0
    assert exchanges(QUERIES["orphan_glyphs"](spark, SMALL)) == 1  # lines to their orders


def test_words_clear_of_any_letters(spark):
    rng = random.Random(4)
    words = [(p, n, *(float(rng.randrange(60)) for _ in range(2)), float(rng.randrange(-2, 20)), float(rng.randrange(12))) for p in range(6) for n in range(rng.randrange(30))]
    letters = [(p, float(rng.randrange(60)), float(rng.randrange(60))) for p in range(1, 7) for _ in range(rng.randrange(40))]
    want = [w for w in words if not any(p == w[0] and w[2] - w[5] * 0.1 <= cx <= w[2] + w[4] + w[5] * 0.1 and w[3] - w[5] * 0.1 <= cy <= w[3] + w[5] + w[5] * 0.1 for p, cx, cy in letters)]
    some, points = words + [(None, 0, 1.0, 1.0, 5.0, 5.0), (1, 99, None, 1.0, 5.0, 5.0)], letters + [(None, 2.0, 2.0), (1, None, 2.0)]
    got = layout.words_clear_of(spark.createDataFrame(some, "page_id int, word_id int, x double, y double, w double, h double"), spark.createDataFrame(points, "page_id int, cx double, cy double"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want + some[-2:], key=str) and 0 < len(want) < len(words)
    assert exchanges(QUERIES["words_clear_of"](spark, SMALL)) == 0


def test_centres_meet_boxes_in_parts():
    rng = np.random.default_rng(2)
    x, y, w, h, cx, cy = (rng.integers(0, 40, 60).astype(float) for _ in range(6))
    ends, of = np.array([0, 0, 25, 60]), np.array([0, 20, 45, 60])
    every = layout.holding(ends, x, y, w / 4, h / 4, of, cx, cy, 0.1)
    assert every.tolist() == layout.holding(ends, x, y, w / 4, h / 4, of, cx, cy, 0.1, most=3).tolist() and 0 < every.sum() < 60
