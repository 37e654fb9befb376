"""Text quality of pages and documents, classes, policy, duplicates of content."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

#: The thresholds of the classes.
LEAST_ALPHANUMERIC, LEAST_GLYPHS, READABLE_SHARE = 100, 100, 0.5
GOOD_RATIO, SUSPECT_RATIO, COMMON_SHARE = 0.85, 0.60, 0.15

#: Classes, actions, and what is done with a class unless told otherwise.
CLASSES = ("ImageOnly", "SuspectText", "UnreadableTextLayer", "ProbablyGood", "GoodText", "Unreadable", "PartlyScanned")
ACTIONS = ("Skip", "Ocr", "StripAndRedo", "CopyFromDuplicate", "ReadAgain")
DEFAULT_POLICY = {c: "Ocr" if c in ("ImageOnly", "PartlyScanned") else "Skip" for c in CLASSES}

#: Words that count as common where no list is given.
COMMON = 300

COUNTS = ("alphanumeric", "tokens", "plausible", "word_like", "common")


def commonest_words(pages: DataFrame, most: int = COMMON) -> list[str]:
    """The commonest terms of letters only, of two letters or more, of these pages; ties by name."""
    terms = pages.select(F.explode(tx.tokens(F.coalesce(F.col("text"), F.lit("")))).alias("term")).filter(F.col("term").rlike(r"^\p{L}{2,}$"))
    found = terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(most)
    return [r["term"] for r in found.collect()]


def page_metrics(pages: DataFrame, common: Sequence[str] | None = None) -> DataFrame:
    """doc_id, page_number and the counts of ``functions.text.token_metrics``; common: the words that count as such,
    by default the commonest of the pages themselves (counted at once, by a scan of its own)."""
    if common is None:
        common = commonest_words(pages)
    rows = pages.select("doc_id", "page_number", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.select("doc_id", "page_number", *(c.alias(n) for n, c in tx.token_metrics(F.col("text"), common).items()))


def _share(part: str, whole: str) -> Column:
    return F.when(F.sum(whole) > 0, F.sum(part) / F.sum(whole)).otherwise(0.0)


def document_metrics(metrics: DataFrame) -> DataFrame:
    """Per document: pages, means per page, and ratios of sums (not means of ratios). glyphs and is_scan are optional columns."""
    for name, kind in (("glyphs", "long"), ("is_scan", "boolean")):
        if name not in metrics.columns:
            metrics = metrics.withColumn(name, F.lit(0).cast("int").cast(kind))
    return metrics.groupBy("doc_id").agg(
        F.count("*").alias("pages"), F.avg("alphanumeric").alias("alphanumeric_per_page"), F.avg("glyphs").alias("glyphs_per_page"),
        _share("plausible", "tokens").alias("plausible_ratio"), _share("common", "word_like").alias("common_share"),
        F.sum(F.col("is_scan").cast("int")).alias("scanned_pages"))


def classify(documents: DataFrame) -> DataFrame:
    """documents (of ``document_metrics``) with text_class; one without pages is Unreadable."""
    text, glyphs = F.col("alphanumeric_per_page"), F.col("glyphs_per_page")
    poor = F.when((glyphs >= LEAST_GLYPHS) & (text < READABLE_SHARE * glyphs), "UnreadableTextLayer").otherwise("ImageOnly")
    fine = (F.when(F.col("plausible_ratio") >= GOOD_RATIO, "GoodText").when(F.col("plausible_ratio") < SUSPECT_RATIO, "SuspectText")
            .when(F.col("common_share") >= COMMON_SHARE, "GoodText").otherwise("ProbablyGood"))
    found = F.when(text < LEAST_ALPHANUMERIC, poor).otherwise(fine)
    partly = F.when((F.col("scanned_pages") > 0) & found.isin("GoodText", "ProbablyGood"), "PartlyScanned").otherwise(found)
    return documents.withColumn("text_class", F.when(F.coalesce("pages", F.lit(0)) == 0, "Unreadable").otherwise(partly))


def parse_policy(text: str | None) -> dict[str, str]:
    """``Class=action,...`` over the default policy, names in any case; an unknown one is an error."""
    policy = dict(DEFAULT_POLICY)
    for part in filter(None, (p.strip() for p in (text or "").split(","))):
        name, _, action = (x.strip().lower() for x in part.partition("="))
        names, actions = {c.lower(): c for c in CLASSES}, {a.lower(): a for a in ACTIONS}
        if name not in names or action not in actions:
            raise ValueError(f"not a class and an action: {part}")
        policy[names[name]] = actions[action]
    return policy


def with_action(documents: DataFrame, policy: Mapping[str, str] = DEFAULT_POLICY) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for pair in policy.items() for x in pair])
    return documents.withColumn("action", F.coalesce(F.try_element_at(pairs, F.col("text_class")), F.lit("Skip")))


def class_summary(files: DataFrame) -> DataFrame:
    """Files, pages and distinct actions of each class; missing files are left out."""
    return files.filter("status != 'Missing'").groupBy("text_class").agg(
        F.count("*").alias("files"), F.sum("page_count").alias("pages"), F.array_join(F.array_sort(F.collect_set("action")), ",").alias("actions"))


def descriptiveness(path: Column) -> Column:
    """Runs of three or more letters in a file name without its ending."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.size(F.regexp_extract_all(stem, F.lit("[A-Za-z]{3,}"), F.lit(0)))


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """path, duplicate_of for files(path, content_hash) that share a hash: the shallowest, then most telling, then first path is kept.

    The kept path is found by a partial minimum, so a hash with very many copies is no single task's group.
    """
    known = files.filter(F.coalesce("content_hash", F.lit("")) != "")
    order = F.struct(depth(F.col("path")).alias("d"), (-descriptiveness(F.col("path"))).alias("t"), F.col("path").alias("p"))
    kept = known.groupBy("content_hash").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    return known.join(kept, "content_hash").select("path", "content_hash", F.col("first.p").alias("primary"), (F.col("path") != F.col("first.p")).alias("redundant"))


def distinct_pages(pages: DataFrame) -> DataFrame:
    """One page for each fingerprint, the first by document and number; pages without letters or digits stay."""
    keyed = pages.withColumn("fingerprint", tx.fingerprint(F.col("text")))
    least = F.min(F.struct("doc_id", "page_number")).alias("first")
    named = keyed.filter("fingerprint != ''").groupBy("fingerprint").agg(least, F.count("*").alias("copies"))
    return named.select("first.doc_id", "first.page_number", "copies")
