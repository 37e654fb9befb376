"""Queries without SQL, over whole small tables, against plain Python."""

from __future__ import annotations

import math
import os
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from conftest import SMALL
from test_raster import flooded

from quirelight.catalog import QUERIES, tables
from quirelight.functions import text as tx
from quirelight.operators import audit, state
from quirelight.streaming import windows


def rows(spark, name: str):
    return spark.read.parquet(f"{SMALL}/{name}.parquet").toPandas()


def page_rows(spark) -> dict[tuple[int, int], str]:
    return {(r.doc_id, r.page_number): r.text for r in tables.pages(spark, SMALL).collect()}


def test_learned_rate(spark):
    want: dict = {}
    for r in rows(spark, "orders").sort_values(["o_custkey", "o_orderkey"]).itertuples():
        want[str(r.o_custkey)] = audit.fold_rate(*want.get(str(r.o_custkey), (None, None)), float(r.o_totalprice) / 1000, r.o_custkey % 50 + 1)
    got = {r.key: (r.rate, r.pages) for r in QUERIES["learned_rate"](spark, SMALL).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_dehyphenate(spark):
    words = set(tables.common_words(spark, SMALL))
    got = {(r.doc_id, r.page_number): (r.text, r.alternates) for r in QUERIES["dehyphenate"](spark, SMALL).collect()}
    want = {k: state.rejoin(re.sub(r"(.{37}[^\W\d_A-ZÀ-Þ])([^\W\d_A-ZÀ-Þ])", r"\1-\n\2", t), words) for k, t in page_rows(spark).items()}
    assert set(got) == set(want)
    assert sum(got[k] == want[k] for k in want) >= 0.99 * len(want)  # letters without case are cut elsewhere by the two patterns


def test_word_error_rate(spark):
    def distance(a: list, b: list) -> int:
        row = np.arange(len(b) + 1)
        for i, x in enumerate(a, 1):
            last, row = row, np.empty(len(b) + 1, int)
            row[0] = i
            best = np.minimum(last[1:] + 1, last[:-1] + np.array([x != y for y in b], int)) if b else np.zeros(0, int)
            for j in range(len(b)):
                row[j + 1] = min(best[j], row[j] + 1)
        return int(row[-1])

    got = {r.item_id: (r.word_errors, r.truth_words) for r in QUERIES["word_error_rate"](spark, SMALL).collect()}
    for r in rows(spark, "benchmark").head(60).itertuples():
        truth = tx.fold_word(r.text).split()
        seen = (re.sub(r"\bth[a-z0]*", "", tx.fold_word(r.text).replace("o", "0"), flags=re.ASCII) + " zz").split()
        assert got[r.item_id] == (distance(truth, seen), len(truth))


def test_count_time_windows(spark):
    want = Counter()
    for user, part in rows(spark, "events").groupby("user_id"):
        for first, last, n in windows.close_windows(sorted(part.ts), (None, 0))[0]:
            want[str(user), first, last, n] += 1
    assert Counter((r.key, pd.Timestamp(r.first_ts), pd.Timestamp(r.last_ts), r.pages) for r in QUERIES["count_time_windows"](spark, SMALL).collect()) == want and want


def test_stepped_levels(spark):
    events = rows(spark, "events")
    events["minute"] = events.ts.dt.floor("min")
    spilled = events.groupby(["event_type", "minute"]).value.sum().round(6).reset_index()
    want = {}
    for kind, part in spilled.groupby("event_type"):
        part = part.sort_values("minute")
        want |= {(kind, t): n for t, n in zip(part.minute, audit.step_down(6, [None if v != v else v for v in part.value], 50))}
    got = {(r.key, pd.Timestamp(r.ts)): r.level for r in QUERIES["stepped_levels"](spark, SMALL).collect()}
    assert got == want and len(set(want.values())) > 1


def test_samples(spark):
    flagged = Counter((r.path, r.page_number) for r in QUERIES["page_verdict"](spark, SMALL).filter("verdict = 'UnderExtracted'").collect())
    every = Counter((r.path, n) for r in QUERIES["document_audit"](spark, SMALL).collect() for n in range(1, r.page_count + 1))
    for name, among in (("sample_flagged", flagged), ("sample_unflagged", Counter(k for k in every if k not in flagged))):
        got = Counter((r.path, r.page_number) for r in QUERIES[name](spark, SMALL).collect())
        assert got.total() == min(40, among.total()) and got <= among


def hits_of(pages: dict, asked: list[tuple], adjacent: bool) -> dict:
    """Ranks (page, document) of pages that ask for (doc_id, page_number, tokens), by BM25 over all pages, a query at a time."""
    tokens = {k: re.findall(r"[^\W_]+", tx.fold_word(t)) for k, t in pages.items() if t.strip(tx.BLANKS)}
    mean, ranks, out = sum(map(len, tokens.values())) / len(tokens), {}, {}
    spelled = {k: f" {' '.join(t)} ".replace(" ", "  ") for k, t in tokens.items()}
    counts = {k: Counter(t) for k, t in tokens.items()}
    for _, _, q in asked:
        if q in ranks:
            continue
        scores = defaultdict(float)
        parts = [q] if adjacent else [(t,) for t in dict.fromkeys(q)]
        held = {p: {k: n for k in tokens if (n := counts[k][p[0]] if len(p) == 1 else spelled[k].count(f" {'  '.join(p)} "))} for p in parts}
        for k in set.intersection(*(set(h) for h in held.values())):
            for p in parts:
                idf = math.log((len(tokens) - len(held[p]) + 0.5) / (len(held[p]) + 0.5))
                f = 10.0 * held[p][k]
                scores[k] -= (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(tokens[k]) / mean))
        order = sorted(scores, key=lambda k: (round(scores[k], 9), k))
        ranks[q] = {k: i for i, k in enumerate(order, 1)}
    for d, n, q in asked:
        found = ranks[q]
        out[d, n] = found.get((d, n)), min((r for (e, _), r in found.items() if e == d), default=None)
    return out


def test_command_ranks(spark):
    pages = page_rows(spark)
    asked = []
    for (d, n), t in pages.items():
        levels = re.findall(r"(?<![A-Za-z])[a-z]{7,}(?![A-Za-z])", t)[:2]
        if len(levels) == 2:
            asked.append((d, n, tuple(re.findall(r"[^\W_]+", tx.fold_word(" ".join(levels))))))
    ranks = list(hits_of(pages, asked, False).values())
    got = QUERIES["command_ranks"](spark, SMALL).first()
    count = lambda i, k: sum(r[i] is not None and r[i] <= k for r in ranks)
    assert tuple(got) == (len(asked), sum(r[0] is not None for r in ranks), count(0, 10), count(1, 10), count(1, 1)) and got.asked > 50


def test_findable_before_and_after(spark):
    pages = page_rows(spark)
    half = {k: t[:len(t) // 2] for k, t in pages.items()}
    asked = [(r.doc_id, r.page_number, tuple(re.findall(r"[^\W_]+", tx.fold_word(r.phrase)))) for r in QUERIES["newly_findable"](spark, SMALL).collect()]
    asked = [a for a in asked if a[2]]
    before, after = hits_of(half, asked, True), hits_of(pages, asked, True)
    got = QUERIES["findable_before_and_after"](spark, SMALL).first()
    assert tuple(got) == (len(asked), sum(r[0] is not None for r in before.values()), sum(r[0] is not None for r in after.values()), sum((r[0] or 99) <= 10 for r in after.values()))


def test_ink_blobs(spark):
    got = defaultdict(list)
    for r in QUERIES["ink_blobs"](spark, SMALL).collect():
        got[r.page_id].append((int(r.x), int(r.y), int(r.w), int(r.h), r.pixels))
    for (d, n), text in list(page_rows(spark).items())[::5]:
        lines = [[w for w in re.split(f"[{re.escape(tx.BLANKS)}]+", x) if w] for x in text.split("\n")]
        ink = np.zeros((len(lines), 6 * max(map(len, lines)) + 8), bool)
        for y, words in enumerate(lines):
            for k, w in enumerate(words):
                ink[y, 6 * k:6 * k + min(len(w), 7)] = True
        assert sorted(got[f"{d}:{n}"]) == flooded(ink, True)


def test_file_discovery(spark):
    got = {r.path: r.size for r in QUERIES["file_discovery"](spark, SMALL).collect()}
    want = {os.path.relpath(os.path.join(d, f), SMALL): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(SMALL) for f in names if f.endswith(".parquet")}
    assert got == want
