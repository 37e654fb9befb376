"""Known cases of the other operators."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirelight.functions import text as tx
from quirelight.operators import audit, evaluate, layout, quality, raster, state
from quirelight.sources import files
from quirelight.streaming import windows

WORDS = {"the", "of", "is", "by", "frequency", "output", "order", "end"}


@pytest.mark.parametrize("text, shown, other", [
    ("the fre-\nquency of the source", "the frequency  of the source", "fre-quency"), ("the frequency-\ncontrolling element", "the frequency-controlling  element", "frequencycontrolling"),
    ("the oscil-\nlator is fre-\nquency locked", "the oscillator  is frequency  locked", "oscil-lator fre-quency"), ("made by Hewlett-\nPackard of", "made by Hewlett-\nPackard of", ""),
    ("the output --\nmeasured", "the output --\nmeasured", ""), ("order part 08340-\n90243 now", "order part 08340-\n90243 now", ""), ("the end-", "the end-", ""), (None, "", ""), ("  \n ", "", ""), ("a fre-\nquency, x", "a frequency , x", "fre-quency"),
])
def test_dehyphenation(text, shown, other):
    got, alternates = state.rejoin(text, WORDS)
    assert alternates == other and got.split() == shown.split()


def test_error_rates(spark):
    cases = [("kitten", "sitting", 3, 1), ("flaw", "lawn", 2, 1), ("", "abc", 3, 1), ("1N21", "1N2l", 1, 1), ("A b\nC", "a B c", 0, 0), ("±0.5 dB", "+0.5 dB", 1, 1), ("one two three", "three one two", 12, 2), (None, None, 0, 0)]
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(cases)], "i int, truth string, recognised string")
    got = {r.i: r for r in evaluate.accuracy(pairs).collect()}
    for i, (_, _, chars, words) in enumerate(cases):
        assert got[i].word_errors == words
        if i != 6:
            assert got[i].char_errors == chars
    assert got[6].unordered_errors == 0 and got[2].truth_chars == 0
    pooled = evaluate.rates(evaluate.accuracy(pairs).filter("i in (2, 3)"), []).first()
    assert pooled.cer == pytest.approx(4 / 4) and pooled.truth_words == 1


def test_word_distance_against_plain_python(spark):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    rng = np.random.default_rng(1)
    pairs = [(i, " ".join(rng.choice(list("abcdef"), rng.integers(0, 30))), " ".join(rng.choice(list("abcdef"), rng.integers(0, 30)))) for i in range(40)]
    got = evaluate.accuracy(spark.createDataFrame(pairs, "i int, truth string, recognised string")).collect()
    assert all(r.word_errors == plain(pairs[r.i][1].split(), pairs[r.i][2].split()) for r in got)


def test_page_ranges_both_ways(spark):
    rows = [("a", p) for p in [19, 20, 21, 22, 23, 30, 32, 33, 34, 35, 36, 37, 37]] + [("b", 7), ("c", None)]
    got = {r.path: r.ranges for r in audit.page_ranges(spark.createDataFrame(rows, "path string, page_number int")).collect()}
    assert got == {"a": "19-23,30,32-37", "b": "7"}
    texts = spark.createDataFrame([("19-23,30,32-37",), ("3, x,1-2,2",), ("",), (None,), ("5-3,9",)], "t string")
    assert [list(r[0]) for r in texts.select(audit.parse_ranges(F.col("t"))).collect()] == [[19, 20, 21, 22, 23, 30, 32, 33, 34, 35, 36, 37], [1, 2, 3], [], [], [9]]


def test_classes(spark):
    rows = [(1, 500, 0, 0.95, 0.3, 0, "GoodText"), (2, 500, 0, 0.3, 0.3, 0, "SuspectText"), (3, 500, 0, 0.7, 0.3, 0, "GoodText"), (4, 500, 0, 0.7, 0.01, 0, "ProbablyGood"), (5, 5, 900, 0.0, 0.0, 0, "UnreadableTextLayer"),
            (6, 5, 5, 0.0, 0.0, 0, "ImageOnly"), (7, 500, 0, 0.95, 0.3, 2, "PartlyScanned"), (8, 500, 0, 0.3, 0.3, 2, "SuspectText")]
    frame = spark.createDataFrame([(i, 3, float(a), float(g), r, c, s) for i, a, g, r, c, s, _ in rows], "doc_id int, pages int, alphanumeric_per_page double, glyphs_per_page double, plausible_ratio double, common_share double, scanned_pages int")
    got = {r.doc_id: r.text_class for r in quality.classify(frame).collect()}
    assert got == {i: k for i, *_, k in rows}
    assert quality.parse_policy("goodtext=OCR")["GoodText"] == "Ocr"
    for bad in ("GoodText", "x=Ocr", "GoodText=y"):
        with pytest.raises(ValueError):
            quality.parse_policy(bad)


def test_metrics_of_technical_words(spark):
    page = [(1, 1, "08340-60019 SENSe:FREQuency:STARt l;'~4 the -- 59401A x")]
    got = quality.page_metrics(spark.createDataFrame(page, "doc_id int, page_number int, text string")).first()
    assert (got.tokens, got.plausible, got.word_like, got.common) == (5, 4, 1, 1)


def test_duplicates_keep_the_shallow_and_telling_name(spark):
    rows = [("x/y/a.pdf", "h"), ("x/LC574AL.pdf", "h"), ("x/LeCroy-5674 User.pdf", "h"), ("z.pdf", "other"), ("q.pdf", None), ("r.pdf", None)]
    got = {r.path: (r.primary, r.redundant) for r in quality.duplicate_groups(spark.createDataFrame(rows, "path string, content_hash string")).collect()}
    assert set(got) == {p for p, h in rows if h == "h"} and {p for p, _ in got.values()} == {"x/LeCroy-5674 User.pdf"} and got["x/LC574AL.pdf"][1]


def box(text, x, y, height=10.0):
    return (text, float(x), float(y), 5.0 * len(text), height)


def test_reading_order():
    order = lambda boxes: [b[0] for b in layout.reading_order(boxes, lambda b: b[1:])]
    columns = [b for i in range(4) for b in (box(f"left{i}", 0, 14 * i), box(f"right{i}", 300, 14 * i))]
    assert order(columns) == [f"left{i}" for i in range(4)] + [f"right{i}" for i in range(4)]
    assert order([box("heading", 0, -60), *columns])[0] == "heading"
    one = [box(f"line{i}", 0, 14 * i) for i in range(5)]
    assert order(one) == [f"line{i}" for i in range(5)]
    cells = [b for i in range(3) for b in (box(f"a{i}", 0, 14 * i), box(f"b{i}", 30, 14 * i))]
    assert order(cells) == ["a0", "b0", "a1", "b1", "a2", "b2"]
    flat = [box("b", 0, 0, 0.0), box("a", 9, 9, 0.0), box("c", 5, 5, 0.0)]
    assert order(flat) == ["b", "a", "c"] and order([]) == []


def test_blobs():
    ink = np.zeros((8, 12), bool)
    ink[1, 1] = ink[2, 2] = ink[3, 1] = True
    ink[5:8, 6:10] = True
    assert raster.components(ink) == [(1, 1, 2, 3, 3), (6, 5, 4, 3, 12)]
    assert raster.components(np.zeros((0, 0), bool)) == []
    assert raster.glyph_like([(0, 0, 4, 5, 20), (0, 0, 400, 2, 800)], 1.0) == [(0, 0, 4, 5, 20)]


def test_outstanding_follows_what_is_flagged_now(spark):
    findings = spark.createDataFrame([("a", p, "UnderExtracted") for p in range(1, 6)] + [("b", 1, "UnderExtracted"), ("b", 2, "Fine")] + [("c", p, "UnderExtracted") for p in (1, 2, 3)], "path string, page_number int, verdict string")
    docs = spark.createDataFrame([("a", "h", 5), ("b", "h", 1), ("c", "h", 3)], "path string, content_hash string, flagged int")
    repairs = spark.createDataFrame([("a", p, "h") for p in (1, 2, 3)] + [("b", 1, "h"), ("b", 2, "h"), ("c", 4, "h"), ("c", 1, "old")], "path string, page_number int, content_hash string")
    got = {r.path: (r.repaired, r.outstanding) for r in audit.with_repaired(docs, findings, repairs).collect()}
    assert got == {"a": (3, 2), "b": (1, 0), "c": (0, 3)}
    plan = spark.createDataFrame([("Drawn", 300)] * 78 + [("Raster", 300)] * 35, "kind string, dpi int")
    assert audit.repair_minutes(plan).first().minutes == pytest.approx(78 / 89.4 + 35 / 43.9)
    assert audit.repair_minutes(plan, {("Drawn", 300): 10.0}).first().minutes == pytest.approx(7.8 + 35 / 43.9)


def test_selection_keeps_the_cap(spark):
    rows = [("busy", i, 9000 - 1000 * i, 10 + i) for i in range(4)] + [("other", 1, 500, 50), ("twin", 1, 500, 50)]
    got = audit.capped_top_pages(spark.createDataFrame(rows, "path string, page_number int, path_ops int, glyphs int"), 4).collect()
    assert [(r.path, r.page_number) for r in got] == [("busy", 0), ("busy", 1), ("other", 1)]


def test_rates_fold_and_levels_step_down(spark):
    assert audit.fold_rate(None, None, 50, 100) == (50, 100) and audit.fold_rate(10, 100, 20, 100) == (15, 200) and audit.fold_rate(10, None, 20, 5000) == (15, 5000)
    runs = spark.createDataFrame([("k", 2, 20.0, 100), ("k", 1, 10.0, 100)], "key string, run int, rate double, pages int")
    assert tuple(audit.learned_rates(runs).first()) == ("k", 15.0, 200.0)
    assert audit.step_down(3, [100, 110, 400, 390, 800, None], 200) == [3, 3, 2, 2, 1, 1]


def test_register_and_names(spark):
    day = dt.datetime(2024, 1, 1)
    known = spark.createDataFrame([("a", 1, day, "h"), ("b", 1, day, "h"), ("c", 1, day, "h"), ("d", 1, day, "h")], "path string, size int, modified timestamp, content_hash string")
    found = spark.createDataFrame([("a", 1, day, "h"), ("b", 1, day + dt.timedelta(1), "h"), ("c", 2, day, "h2"), ("e", 1, day, "h")], "path string, size int, modified timestamp, content_hash string")
    assert {r.path: r.change for r in state.register(known, found).collect()} == {"a": "same", "b": "refreshed", "c": "reset", "d": "missing", "e": "new"}
    names = spark.createDataFrame([("x.pdf", ["x.pdf", "x (2).pdf"]), ("y.pdf", ["x.pdf"])], "w string, t array<string>")
    assert [r[0] for r in names.select(state.free_name(F.col("w"), F.col("t"))).collect()] == ["x (3).pdf", "y.pdf"]


def test_files_lists_and_links(spark, tmp_path):
    (tmp_path / "lib/keep/deep").mkdir(parents=True)
    (tmp_path / "lib/skip").mkdir()
    for name in ("keep/b.pdf", "keep/deep/A.pdf", "skip/c.pdf", "keep/d.txt"):
        (tmp_path / "lib" / name).write_bytes(name.encode())
    found = files.discover(spark, str(tmp_path / "lib"), ["skip"]).collect()
    assert [r.path for r in found] == ["keep/b.pdf", "keep/deep/A.pdf"] and found[0].size == 10
    assert files.hashes(spark, str(tmp_path / "lib")).count() == 3
    (tmp_path / "list").write_text("# c\na b.pdf\t3\nx\ty.pdf\t4\n\n")
    assert sorted(map(tuple, files.read_page_list(spark, str(tmp_path / "list")).collect())) == [("a b.pdf", 3), ("x\ty.pdf", 4)]
    (tmp_path / "m.csv").write_text('manual,page,kind,textFile,source\n"a, ""b"".pdf",1,prose,t1,Hand\nc.pdf,2,odd,t2,Hand\n')
    manifest = files.read_manifest(spark, str(tmp_path / "m.csv"))
    assert {(r.manual, r.kind) for r in manifest.collect()} == {('a, "b".pdf', "Prose"), ("c.pdf", "Mixed")}
    assert files.seed_manifest(manifest, manifest.union(manifest.limit(1).withColumn("page", F.lit(9)))).count() == 3
    links = spark.createDataFrame([("/manuals/a%20b/c.pdf/page/4.png",), ("/manuals/../x",), ("/manuals/c.pdf",)], "l string")
    assert [tuple(r) for r in links.select(*files.parse_link(F.col("l"))).collect()] == [("a b/c.pdf", 4, True), (None, None, False), ("c.pdf", None, False)]


def test_windows_close_by_count_and_time(spark, tmp_path):
    start = pd.Timestamp("2024-01-01")
    times = [start + pd.Timedelta(seconds=i) for i in range(50)]
    closed, rest = windows.close_windows(times, (None, 0))
    assert [c[2] for c in closed] == [21, 21] and rest[1] == 8
    fast = [start] * 30 + [start + pd.Timedelta(seconds=25)]
    assert [c[2] for c in windows.close_windows(fast, (None, 0))[0]] == [31]
    rows = spark.createDataFrame([("k", t.to_pydatetime()) for t in times], "key string, ts timestamp")
    assert windows.count_time_windows(rows, "key", "ts").count() == 2
    rows.write.parquet(str(tmp_path / "in"))
    stream = windows.count_time_windows(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "key", "ts")
    stream.writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.pages for r in spark.table("closed").collect()) == [21, 21]


def test_index_of_dropped_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        windows.index_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), "doc_id long, text string", str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/postings")).groupBy("term").count().collect().__len__() == 2
    assert spark.read.parquet(str(tmp_path / "out/page_stats")).count() == 2


def test_sample_and_partitions(spark):
    rows = spark.range(500).select(F.col("id").alias("path"), (F.col("id") % 9).alias("page_number"))
    one = audit.sample_rows(rows.coalesce(1), 20, 1, ["path"]).collect()
    assert one == audit.sample_rows(rows.repartition(7), 20, 1, ["path"]).collect() and len(one) == 20
    sampled = audit.sample_pages(spark.createDataFrame([("a", 100), ("b", 4), ("c", 0), ("d", 400)], "path string, page_count int"), 8).groupBy("path").agg(F.count("*").alias("n"), F.min("page_number").alias("lo"), F.max("page_number").alias("hi"))
    got = {r.path: r for r in sampled.collect()}
    assert (got["a"].n, got["b"].n) == (8, 4) and "c" not in got and 40 <= got["d"].lo and got["d"].hi <= 360


def test_levels_step_down_and_documents_complete_in_streams(spark, tmp_path):
    start = pd.Timestamp("2024-01-01")
    readings = [10.0, 12.0, None, 70.0, 71.0, 125.0, 60.0, 130.0, 300.0, 400.0, 500.0]
    rows = [("k", (start + pd.Timedelta(seconds=i)).to_pydatetime(), r) for i, r in enumerate(readings)] + [("l", start.to_pydatetime(), 5.0)]
    frame = spark.createDataFrame(rows, "key string, ts timestamp, spilled double")
    want = audit.step_down(4, readings, 50)
    got = [r.level for r in windows.stepped_levels(frame, "key", "ts", "spilled", 4, 50).orderBy("key", "ts").collect()]
    assert got == [*want, 4] and min(want) == 1
    frame.write.parquet(str(tmp_path / "in"))
    stream = windows.stepped_levels(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), "key", "ts", "spilled", 4, 50)
    stream.writeStream.format("memory").queryName("levels").option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start().awaitTermination(120)
    assert [r.level for r in spark.table("levels").orderBy("key", "ts").collect()] == [*want, 4]
    pages = spark.createDataFrame([("a", 3)] * 3 + [("b", 4)] * 3, "path string, page_count long")
    for k in range(2):
        pages.filter("path = 'a'" if k else "path = 'b'").write.parquet(str(tmp_path / f"pages/{k}"))
    done = windows.completions(spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "pages")))
    done.writeStream.format("memory").queryName("done").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination(120)
    assert [tuple(r) for r in spark.table("done").collect()] == [("a", 3)] == [tuple(r) for r in windows.completions(pages).collect()]


def test_dehyphenation_keeps_line_ends():
    assert state.rejoin("one\ntwo fre-\nquency, x\nend", WORDS) == ("one\ntwo frequency , x\nend", "fre-quency")


def test_samples_of_pages_not_flagged(spark):
    documents = spark.createDataFrame([("a", 5), ("b", 0), ("c", 30)], "path string, page_count int")
    findings = spark.createDataFrame([("a", 1), ("a", 2), ("c", 7)], "path string, page_number int")
    got = [tuple(r) for r in audit.sample_unflagged(documents, findings, 100, 3).collect()]
    assert sorted(got) == sorted([("a", p) for p in (3, 4, 5)] + [("c", p) for p in range(1, 31) if p != 7])
    assert [tuple(r) for r in audit.sample_unflagged(documents.repartition(3), findings, 5, 3).collect()] == got[:5]


def test_word_sequences_of_many_kinds(spark):
    long = " ".join(f"w{i}" for i in range(3_000))
    frame = spark.createDataFrame([(long, long + " w1 w1"), ("a a b", "b a c c"), ("", "")], "truth string, recognised string")
    assert [r.unordered_errors for r in evaluate.accuracy(frame.limit(1)).collect()] == [2]
    assert sorted(r.unordered_errors for r in evaluate.accuracy(frame.filter("length(truth) < 10")).collect()) == [0, 2]
