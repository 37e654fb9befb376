"""Audit of pages and documents: verdicts, rollups, selection, plans and estimates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Thresholds of a page's verdict, and repair rates in pages a minute by (kind, dots an inch).
PAGE = {"decoded": 100, "undecoded_times": 4, "full_page_image": 0.5, "glyphs": 900, "paths": 40, "image": 0.10, "uncovered": 0.002, "blobs": 40, "raster": 0.2, "kept": 0.85}
RATES = {("Drawn", 300): 89.4, ("Drawn", 400): 70.8, ("Drawn", 600): 44.0, ("Raster", 300): 43.9, ("Raster", 400): 45.4, ("Raster", 600): 28.0}
UNDER_EXTRACTED_SHARE = 0.10
LONGEST_TITLE_WORD = 4
STRAY_GLYPHS, SCAN_IMAGE = 40, 0.5


def page_verdict() -> tuple[Column, Column, Column]:
    """(verdict, kind, recoverable_chars) over glyphs, decoded, path_ops, image, uncovered, blobs."""
    c = F.col
    rendered = (c("glyphs") < PAGE["glyphs"]) | (c("path_ops") >= PAGE["paths"]) | (c("image") >= PAGE["image"])
    verdict = (
        F.when((c("glyphs") == 0) & (c("image") >= PAGE["full_page_image"]), "NoTextLayer")
        .when((c("glyphs") > 0) & (c("decoded") < PAGE["decoded"]) & (c("glyphs") >= PAGE["undecoded_times"] * c("decoded")), "Undecodable")
        .when(~rendered, "Fine")
        .when((c("uncovered") >= PAGE["uncovered"]) & (c("blobs") >= PAGE["blobs"]), "UnderExtracted").otherwise("Fine"))
    kind = F.when(c("image") >= PAGE["raster"], "Raster").otherwise("Drawn")
    return verdict, kind, F.bround(c("blobs") * PAGE["kept"]).cast("long")


def suggested_dpi(blob_height: Column) -> Column:
    """Resolution by the height of what was not read, in points."""
    return F.when(blob_height <= 0, 300).when(blob_height < 7, 600).when(blob_height < 9, 400).otherwise(300)


def document_audit(findings: DataFrame) -> DataFrame:
    """path, page_count, flagged, drawn, raster, recoverable, flagged_share, dpi, verdict of findings(path, verdict, kind, recoverable_chars, dpi)."""
    hit = F.col("verdict") == "UnderExtracted"
    drawn = hit & (F.col("kind") == "Drawn")
    rolled = findings.groupBy("path").agg(
        F.count("*").alias("page_count"), F.sum(hit.cast("int")).alias("flagged"), F.sum(drawn.cast("int")).alias("drawn"),
        F.sum(F.when(hit, F.col("recoverable_chars")).otherwise(0)).alias("recoverable"), F.max(F.when(hit, F.col("dpi"))).alias("dpi"))
    rolled = rolled.withColumn("raster", F.col("flagged") - F.col("drawn")).withColumn("flagged_share", F.col("flagged") / F.col("page_count"))
    return rolled.withColumn("document_verdict", document_verdict())


def document_verdict() -> Column:
    """Over flagged, drawn and page_count."""
    least = UNDER_EXTRACTED_SHARE * F.col("page_count")
    return (F.when(F.col("flagged") == 0, "Sound").when(F.col("drawn") >= least, "UnderExtracted")
            .when(F.col("flagged") - F.col("drawn") >= least, "ScannedGaps").otherwise("Figures"))


def valid_repairs(repairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Repairs made against the content that the document has now."""
    return repairs.join(documents.select("path", "content_hash"), ["path", "content_hash"], "left_semi")


def with_repaired(documents: DataFrame, findings: DataFrame, repairs: DataFrame) -> DataFrame:
    """documents with repaired (pages flagged now that have a valid repair) and outstanding."""
    now = findings.filter("verdict = 'UnderExtracted'").select("path", "page_number")
    done = valid_repairs(repairs, documents).select("path", "page_number").distinct().join(now, ["path", "page_number"], "left_semi")
    count = done.groupBy("path").agg(F.count("*").alias("repaired"))
    both = documents.join(count, "path", "left").withColumn("repaired", F.coalesce("repaired", F.lit(0)))
    return both.withColumn("outstanding", F.greatest(F.lit(0), F.col("flagged") - F.col("repaired")))


def audit_summary(documents: DataFrame) -> DataFrame:
    """Documents, those with flags, flagged and repaired pages, recoverable characters."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return documents.agg(F.count("*").alias("documents"), F.count(F.when(F.col("flagged") > 0, 1)).alias("flagged_documents"), total("flagged"), total("repaired"), total("recoverable"))


def worst_first(documents: DataFrame, limit: int) -> DataFrame:
    return documents.filter("flagged > 0").orderBy(F.desc("recoverable"), F.desc("flagged"), "path").limit(limit)


def page_ranges(pages: DataFrame, key: str = "path", page: str = "page_number") -> DataFrame:
    """Distinct pages of each key as text such as 1-3,7: runs by page minus rank, then joined in order."""
    distinct = pages.filter(F.col(page).isNotNull()).select(key, page).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy(page))
    runs = distinct.withColumn("run", F.col(page) - rank).groupBy(key, "run").agg(F.min(page).alias("a"), F.max(page).alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    ordered = F.array_sort(F.collect_list(F.struct("a", shown.alias("s"))))
    return runs.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["s"]), ",").alias("ranges"))


def parse_ranges(text: Column) -> Column:
    """The ascending distinct pages that text such as 1-3,7 names; parts that are neither are passed over."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda p: F.regexp_replace(p, r"\s", ""))
    good = F.filter(parts, lambda p: p.rlike(r"^\d{1,9}(-\d{1,9})?$"))
    number = lambda p, i: F.element_at(F.split(p, "-"), i).cast("int")
    spans = F.transform(good, lambda p: F.when(number(p, 1) <= number(p, -1), F.sequence(number(p, 1), F.greatest(number(p, 1), number(p, -1)))).otherwise(F.array().cast("array<int>")))
    return F.array_sort(F.array_distinct(F.flatten(spans)))


def expected_and_recovered(findings: DataFrame, repairs: DataFrame) -> DataFrame:
    """Flagged pages with the characters expected and recovered, and what became of them."""
    got = repairs.select("path", "page_number", F.length("ocr_text").alias("recovered"))
    both = findings.filter("verdict = 'UnderExtracted'").join(got, ["path", "page_number"], "left")
    outcome = F.when(F.col("recovered").isNull(), "not repaired").when(F.col("recovered") == 0, "nothing recovered").otherwise("recovered")
    return both.select("path", "page_number", F.col("recoverable_chars").alias("expected"), "recovered", outcome.alias("outcome"))


def repair_plan(documents: DataFrame, findings: DataFrame, repairs: DataFrame, include_scans: bool = False, include_figures: bool = True,
                redo_before: str | None = None, force: bool = False, highest_dpi: int = 600) -> DataFrame:
    """path, page_number, kind, dpi of the pages to read: flagged, in scope, not yet repaired (or before a date, or by force)."""
    scope = ["UnderExtracted", *["Figures"] * include_figures, *["ScannedGaps"] * include_scans]
    inside = documents.filter(F.col("document_verdict").isin(scope)).select("path", "content_hash", "document_verdict")
    wanted = F.lit(include_scans) | (F.col("kind") == "Drawn") | (F.col("document_verdict") == "Figures")
    flagged = findings.filter("verdict = 'UnderExtracted'").select("path", "page_number", "kind", "dpi").join(inside, "path").filter(wanted)
    done = repairs.select("path", "page_number", "content_hash", "repaired_utc")
    earlier = flagged.join(done, ["path", "page_number", "content_hash"], "left")
    read = F.col("repaired_utc").isNull() | F.lit(force)
    if redo_before:
        read = read | (F.col("repaired_utc") < F.lit(redo_before).cast("timestamp"))
    return earlier.filter(read).select("path", "page_number", "kind", F.least(F.lit(highest_dpi), F.col("dpi")).alias("dpi"))


def dpi_band(dpi: Column) -> Column:
    return F.when(dpi <= 300, 300).when(dpi <= 400, 400).otherwise(600)


def repair_minutes(plan: DataFrame, learned: dict[tuple[str, int], float] | None = None) -> DataFrame:
    """pages and minutes of a plan: the sum of 1 / rate of its kind and resolution; a learned rate goes before the table's."""
    rates = RATES | {k: v for k, v in (learned or {}).items() if v > 0}
    kind = F.when(F.col("kind") == "Drawn", "Drawn").otherwise("Raster")
    table = F.create_map(*[F.lit(x) for (k, d), r in rates.items() for x in (f"{k}/{d}", r)])
    rate = F.element_at(table, F.concat_ws("/", kind, dpi_band(F.col("dpi")).cast("string")))
    return plan.agg(F.count("*").alias("pages"), F.coalesce(F.sum(1 / rate), F.lit(0.0)).alias("minutes"))


def breakdown(plan: DataFrame) -> DataFrame:
    return plan.groupBy("kind", "dpi").agg(F.count("*").alias("pages"))


def capped_top_pages(pages: DataFrame, count: int, per_document: int = 2) -> DataFrame:
    """The pages with most drawing for their text: one for each (path_ops, glyphs), at most so many a document, so many in all.

    The greedy pick takes pages in one order and drops a repeated signature, then a document's excess;
    both depend on the order alone, so two ranks and a limit give the same pages.
    """
    weight = F.col("path_ops") / (F.col("glyphs") + 1)
    order = [F.desc("weight"), F.asc("path"), F.asc("page_number")]
    ranked = pages.withColumn("weight", weight)
    first = ranked.withColumn("twin", F.row_number().over(Window.partitionBy("path_ops", "glyphs").orderBy(*order))).filter("twin = 1")
    capped = first.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy(*order))).filter(F.col("nth") <= per_document)
    return capped.orderBy(*order).limit(count).select("path", "page_number", "weight")


def sample_pages(documents: DataFrame, size: int, key: str = "path") -> DataFrame:
    """Evenly spaced pages of each document(key, page_count), off its first and last tenth; all of a short one."""
    n = F.col("page_count")
    low, high = F.greatest(F.lit(1), F.floor(n * 0.1).cast("int")), F.least(n.cast("int"), F.floor(n * 0.9).cast("int"))
    step = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(1), high - low) / size).cast("int"))
    few = F.when(n > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), n.cast("int")))).otherwise(F.array().cast("array<int>"))
    chosen = F.when(n <= size, few).otherwise(F.slice(F.sequence(low, F.greatest(low, high), step), 1, size))
    return documents.select(key, F.explode(chosen).alias("page_number"))


def sample_rows(rows: DataFrame, count: int, seed: int, keys: list[str]) -> DataFrame:
    """A seeded sample without replacement: the rows with the least keyed hashes; the same for any partitioning."""
    return rows.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys).limit(count)


def sample_unflagged(documents: DataFrame, findings: DataFrame, count: int, seed: int) -> DataFrame:
    """path, page_number of a seeded sample of the pages of documents(path, page_count) that no finding names."""
    every = documents.filter("page_count > 0").select("path", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("page_number"))
    return sample_rows(every.join(findings.select("path", "page_number"), ["path", "page_number"], "left_anti"), count, seed, ["path", "page_number"])


def scans_without_text(pages: DataFrame, most_glyphs: int = STRAY_GLYPHS, least_image: float = SCAN_IMAGE) -> DataFrame:
    """pages(glyphs, hidden, image, ...) that are scans without a text layer: few stray glyphs, no hidden text, one image over half the page."""
    return pages.filter((F.col("glyphs") <= most_glyphs) & ~F.col("hidden") & (F.least(F.lit(1.0), F.col("image")) >= least_image))


def miss_advice(groups: DataFrame, outstanding: DataFrame, by: str, worst: int = 5) -> DataFrame:
    """by, hits, advice, outstanding, worst of groups(by, hits, audited) and the documents (by, path, outstanding, recoverable) with open pages.

    found; unproven without an audit; outstanding, naming the worst documents (most recoverable characters first); else absent.
    Only the worst of each group are gathered, so a group may have any number of documents.
    """
    order = Window.partitionBy(by).orderBy(F.desc("recoverable"), F.desc("outstanding"), "path")
    first = outstanding.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= worst)
    named = first.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "path"))), lambda x: x["path"]), ",").alias("names"))
    both = groups.join(outstanding.groupBy(by).agg(F.sum("outstanding").alias("open")), by, "left").join(named, by, "left")
    open_ = F.coalesce("open", F.lit(0))
    told = (F.col("hits") == 0) & F.col("audited")
    say = F.when(F.col("hits") > 0, "found").when(~F.col("audited"), "unproven").when(open_ > 0, "outstanding").otherwise("absent")
    return both.select(by, "hits", say.alias("advice"), F.when(told, open_).otherwise(0).alias("outstanding"), F.when(told & (open_ > 0), F.col("names")).otherwise("").alias("worst"))


def publisher_pages(pages: DataFrame, count: int, per_document: int = 2, least_chars: int = 900) -> DataFrame:
    """Pages fit as truth: verdict Fine, few paths and images, decoded in full; one a fingerprint, so many a document."""
    fit = pages.filter((F.col("verdict") == "Fine") & ~F.col("type3") & (F.col("path_ops") < 40) & (F.col("image") <= 0.10)
                       & (F.col("glyphs") > 0) & (F.col("decoded") >= least_chars) & (F.col("decoded") >= F.col("glyphs") * 0.98))
    one = fit.withColumn("twin", F.row_number().over(Window.partitionBy("fingerprint").orderBy("path", "page_number"))).filter("twin = 1")
    some = one.withColumn("nth", F.row_number().over(Window.partitionBy("path").orderBy("page_number"))).filter(F.col("nth") <= per_document)
    return some.orderBy("path", "page_number").limit(count).select("path", "page_number")


def heading_missing(title: Column, text: Column) -> Column:
    """Whether less than half of a title's words (of four letters or more) stand in the text, ignoring case."""
    words = F.filter(F.transform(F.split(title, r"\s+"), lambda w: F.btrim(w, F.lit(".,:;()-"))), lambda w: F.length(w) >= LONGEST_TITLE_WORD)
    found = F.size(F.filter(words, lambda w: F.contains(F.lower(text), F.lower(w))))
    return (F.size(words) > 0) & (found * 2 < F.size(words))


def run_report(pages: DataFrame, seconds: Column | str = "seconds") -> DataFrame:
    """pages; total, mean and largest seconds; pages a minute (0 without time)."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    total = F.coalesce(F.sum(s), F.lit(0.0))
    return pages.agg(F.count("*").alias("pages"), total.alias("seconds"), F.avg(s).alias("mean"), F.max(s).alias("slowest"), F.when(total > 0, F.count("*") * 60 / total).otherwise(0.0).alias("pages_per_minute"))


def fold_rate(before: float | None, before_pages: float | None, rate: float, pages: float, most: float = 5_000) -> tuple[float, float]:
    """A rate learned from earlier runs and a new one, weighed by pages; the memory stands for at most 5,000 pages."""
    if not before or before <= 0:
        return rate, min(pages, most)
    weight = min(most if before_pages is None else before_pages, most)
    return (before * weight + rate * pages) / (weight + pages), min(weight + pages, most)


def learned_rates(runs: DataFrame, most: float = 5_000) -> DataFrame:
    """key, rate, pages: runs(key, run, rate, pages) folded in the order of run. A key's runs are few (one row a run)."""
    ordered = F.array_sort(F.collect_list(F.struct("run", "rate", "pages")))
    nothing = F.struct(F.lit(0.0).alias("rate"), F.lit(0.0).alias("pages"))

    def step(s: Column, r: Column) -> Column:
        total = s["pages"] + r["pages"]
        return F.struct(F.when(s["pages"] > 0, (s["rate"] * s["pages"] + r["rate"] * r["pages"]) / total).otherwise(r["rate"]).alias("rate"), F.least(total, F.lit(float(most))).alias("pages"))

    folded = runs.select("key", "run", F.col("rate").cast("double").alias("rate"), F.col("pages").cast("double").alias("pages")).groupBy("key").agg(F.aggregate(ordered, nothing, step).alias("s"))
    return folded.select("key", "s.rate", "s.pages")


def step_down(levels: int, spilled: list[float | None], margin: float) -> list[int]:
    """The level after each window: one less whenever more than the margin is gone since the least seen, never up again."""
    out, baseline = [], math.inf
    for s in spilled:
        if s is not None:
            baseline = min(baseline, s)
            if s - baseline > margin:
                baseline, levels = s, max(1, levels - 1)
        out.append(levels)
    return out
