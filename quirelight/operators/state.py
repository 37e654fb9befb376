"""Snapshots of files, pages and documents: what is new, changed or gone, and the snapshot that follows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window



def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with all rows of the keys in new replaced by new's: a document goes and comes as a whole."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def merge_latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key; a column that new leaves null keeps its old value."""
    rest = [c for c in old.columns if c not in keys]
    right = new.select(*keys, *(F.col(c).alias(f"new {c}") for c in rest))
    both = old.join(right, keys, "full_outer")
    return both.select(*keys, *(F.coalesce(F.col(f"`new {c}`"), F.col(c)).alias(c) for c in rest))


def pending(found: DataFrame, indexed: DataFrame, force: bool = False) -> DataFrame:
    """Files to index: those whose content hash or supplement hash is not what the index holds."""
    if force:
        return found
    return found.join(indexed.select("path", "content_hash", "supplement_hash"), ["path", "content_hash", "supplement_hash"], "left_anti")


def register(known: DataFrame, found: DataFrame) -> DataFrame:
    """path, change of files(path, size, modified, content_hash): same, refreshed (only the time), reset, new, or missing."""
    old = known.select("path", F.col("size").alias("s"), F.col("modified").alias("m"), F.col("content_hash").alias("h"), F.lit(True).alias("was"))
    now = found.select("path", "size", "modified", "content_hash", F.lit(True).alias("is"))
    same = F.col("size").eqNullSafe(F.col("s")) & F.col("content_hash").eqNullSafe(F.col("h"))
    change = (F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "missing")
              .when(same & F.col("modified").eqNullSafe(F.col("m")), "same").when(same, "refreshed").otherwise("reset"))
    return now.join(old, "path", "full_outer").select("path", change.alias("change"))


def with_presence(state: DataFrame, existing: DataFrame) -> DataFrame:
    """Status Missing for files that are gone, Discovered for missing ones that are back."""
    there = existing.select("path").distinct().withColumn("there", F.lit(True))
    status = F.when(F.col("there").isNull(), "Missing").when(F.col("status") == "Missing", "Discovered").otherwise(F.col("status"))
    return state.join(there, "path", "left").withColumn("status", status).drop("there")


def trim_missing(state: DataFrame) -> DataFrame:
    return state.filter("status != 'Missing'")


def renamed(table: DataFrame, names: DataFrame, columns: tuple[str, ...] = ("path",)) -> DataFrame:
    """table with old paths replaced by names(path, new_path) in each of the columns."""
    for c in columns:
        right = names.select(F.col("path").alias("was"), "new_path")
        table = table.join(right, F.col(c) == F.col("was"), "left").withColumn(c, F.coalesce("new_path", c)).drop("was", "new_path")
    return table


def reconcile(on_disk: DataFrame, indexed: DataFrame, examine: int = 25) -> DataFrame:
    """path, state: files of only one side, paths compared without case; the first of the unindexed ones are marked to be examined."""
    left = on_disk.select(F.lower("path").alias("key"), F.col("path").alias("disk")).dropDuplicates(["key"])
    right = indexed.select(F.lower("path").alias("key"), F.col("path").alias("index")).dropDuplicates(["key"])
    both = left.join(right, "key", "full_outer").filter(F.col("disk").isNull() | F.col("index").isNull())
    gone = both.filter("disk is null").select(F.col("index").alias("path"), F.lit("index only").alias("state"))
    new = both.filter("index is null").select("key", F.col("disk").alias("path"))
    first = new.orderBy("key").limit(examine).select("key", F.lit(True).alias("examined"))
    found = new.join(F.broadcast(first), "key", "left")  # at most ``examine`` rows
    return found.select("path", F.when(F.col("examined"), "disk only, examined").otherwise("disk only").alias("state")).union(gone)


def work_queue(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Files with something to do: smallest first, copies behind all others."""
    open_ = files.filter("action != 'Skip' and status in ('Discovered', 'Classified', 'InProgress', 'Failed')")
    ordered = open_.orderBy(F.col("duplicate_of").isNotNull(), "size", "path")
    return ordered.limit(limit) if limit else ordered


def supplement_hash(repairs: DataFrame) -> DataFrame:
    """path, supplement_hash: the first 16 digits of SHA-256 over page:length:second of its repairs in order of page."""
    part = F.concat_ws(":", F.col("page_number").cast("string"), F.length("ocr_text").cast("string"), F.unix_timestamp("repaired_utc").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", F.concat(part, F.lit(";")).alias("s"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["s"]), "")
    return repairs.groupBy("path").agg(F.substring(F.upper(F.sha2(joined, 256)), 1, 16).alias("supplement_hash"))


def merge_recovered(pages: DataFrame, repairs: DataFrame, common: Sequence[str]) -> DataFrame:
    """Pages(doc_id, page_number, text[, alternates]) with what repairs(doc_id, page_number, ocr_text, confidence) recovered.

    The page's own text stays as it is; the recovered text is dehyphenated (``common``: the common words)
    and stands behind an empty line, or alone. alternates of both are joined by a blank. Where something
    was recovered: embedded_chars, ocr_chars, confidence and ocr_text say where the text is from.
    """
    if "alternates" not in pages.columns:
        pages = pages.withColumn("alternates", F.lit(""))
    found = dehyphenated(repairs.filter(F.length("ocr_text") > 0).select("doc_id", "page_number", "ocr_text", "confidence"), common, "ocr_text")
    both = pages.join(found.withColumnRenamed("alternates", "other"), ["doc_id", "page_number"], "left")
    has = F.col("ocr_text").isNotNull()
    text = F.when(~has, F.col("text")).when(F.length("text") > 0, F.concat_ws("\n\n", "text", "ocr_text")).otherwise(F.col("ocr_text"))
    given = F.filter(F.array("alternates", "other"), lambda a: F.coalesce(a, F.lit("")) != "")
    return both.select("doc_id", "page_number", text.alias("text"), F.array_join(given, " ").alias("alternates"), F.when(has, F.length("text")).alias("embedded_chars"),
                       F.length("ocr_text").alias("ocr_chars"), "ocr_text", "confidence")


def already_held(incoming: DataFrame, held: DataFrame) -> DataFrame:
    """path, held_as: incoming files whose content is held; hashes are compared only where a size is held."""
    sized = incoming.join(held.select("size").distinct(), "size", "left_semi")
    first = held.groupBy("size", "content_hash").agg(F.min("path").alias("held_as"))
    return sized.join(first, ["size", "content_hash"]).select("path", "held_as")


def copies_ready(files: DataFrame) -> DataFrame:
    """Copies whose primary is complete, and so can be taken from it."""
    done = files.filter("status = 'Completed'").select(F.col("path").alias("duplicate_of"))
    return files.filter("duplicate_of is not null and status != 'Completed'").join(done, "duplicate_of", "left_semi")


def completed_pages(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Each file with its number of completed pages, and whether that is all of them."""
    n = pages.filter("status = 'Completed'").groupBy("path").agg(F.count("*").alias("done"))
    both = files.join(n, "path", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return both.withColumn("complete", F.col("done") == F.col("page_count"))


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages(path, page_number, settings) without a readable entry: words that are no JSON array count as none."""
    good = cache.filter(F.from_json("words_json", "array<struct<t:string,x:double,y:double,w:double,h:double,c:double>>").isNotNull())
    return wanted.join(good.select("path", "page_number", "settings"), ["path", "page_number", "settings"], "left_anti")


def free_name(wanted: Column, taken: Column) -> Column:
    """stem.ext, or the first of stem (2).ext, stem (3).ext ... that the array ``taken`` does not hold."""
    stem, ending = F.regexp_replace(wanted, r"\.[^.]*$", ""), F.regexp_extract(wanted, r"(\.[^.]*)$", 1)
    tries = F.transform(F.sequence(F.lit(2), F.size(taken) + 2), lambda n: F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), ending))
    free = F.filter(tries, lambda t: ~F.array_contains(taken, t))
    return F.when(~F.array_contains(taken, wanted), wanted).otherwise(F.element_at(free, 1))


def structural_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """page, image_no, difference between two tables of images(page, image_no, width, height, filter).

    A page whose number of images changed has one row (``images``, no image_no); of others each image
    that differs has one: lost, added, pixels, or filter.
    """
    cols = ("width", "height", "filter")
    a = before.select("page", "image_no", *(F.col(c).alias(f"a_{c}") for c in cols), F.lit(1).alias("in_a"))
    b = after.select("page", "image_no", *(F.col(c).alias(f"b_{c}") for c in cols), F.lit(1).alias("in_b"))
    both = a.join(b, ["page", "image_no"], "full_outer")
    of_page = Window.partitionBy("page")
    both = both.withColumn("as_many", F.count("in_a").over(of_page) == F.count("in_b").over(of_page))
    pixels = ~(F.col("a_width").eqNullSafe(F.col("b_width")) & F.col("a_height").eqNullSafe(F.col("b_height")))
    what = (F.when(~F.col("as_many"), "images").when(F.col("in_b").isNull(), "lost").when(F.col("in_a").isNull(), "added").when(pixels, "pixels")
            .when(~F.col("a_filter").eqNullSafe(F.col("b_filter")), "filter"))
    found = both.select("page", F.when(F.col("as_many"), F.col("image_no")).alias("image_no"), what.alias("difference")).filter("difference is not null")
    return found.distinct()


def page_diff(before: DataFrame, after: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """path, page_number, difference (size, rotation, or both) between pages(path, page_number, width, height, rotation) met by their place.

    A document whose number of pages changed has one row (``pages``, no page_number).
    """
    cols = ("width", "height", "rotation")
    nth = F.row_number().over(Window.partitionBy("path").orderBy("page_number"))
    side = lambda d, k: d.select("path", nth.alias("nth"), F.col("page_number").alias(f"{k}_page"), *(F.col(c).alias(f"{k}_{c}") for c in cols))
    both = side(before, "a").join(side(after, "b"), ["path", "nth"], "full_outer")
    of_path = Window.partitionBy("path")
    both = both.withColumn("as_many", F.count("a_page").over(of_path) == F.count("b_page").over(of_path))
    moved = (F.abs(F.col("a_width") - F.col("b_width")) > tolerance) | (F.abs(F.col("a_height") - F.col("b_height")) > tolerance)
    parts = F.array_compact(F.array(F.when(moved, "size"), F.when(F.col("a_rotation") != F.col("b_rotation"), "rotation")))
    what = F.when(~F.col("as_many"), "pages").when(F.size(parts) > 0, F.array_join(parts, ","))
    return both.select("path", F.when(F.col("as_many"), F.col("a_page")).alias("page_number"), what.alias("difference")).filter("difference is not null").distinct()


def first_difference(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """path, ordinal, difference: of lists (bookmarks, links) of documents, (path, ordinal, ...), the first entry that changed, or ``count``."""
    nth = F.row_number().over(Window.partitionBy("path").orderBy("ordinal"))
    side = lambda d, k: d.select("path", nth.alias("nth"), F.col("ordinal").alias(f"{k}_ordinal"), F.struct(*columns).alias(f"{k}_entry"))
    both = side(before, "a").join(side(after, "b"), ["path", "nth"], "full_outer")
    changed = F.min(F.when(~F.col("a_entry").eqNullSafe(F.col("b_entry")), F.col("a_ordinal")))
    rolled = both.groupBy("path").agg(F.count("a_ordinal").alias("a"), F.count("b_ordinal").alias("b"), changed.alias("ordinal"))
    other = F.col("a") != F.col("b")
    return rolled.filter(other | F.col("ordinal").isNotNull()).select("path", F.when(~other, F.col("ordinal")).alias("ordinal"), F.when(other, "count").otherwise("changed").alias("difference"))


def _named(files: DataFrame, paths: DataFrame | None) -> DataFrame:
    """files with ``named``: whether their path is in paths(path), by any case; all are without paths."""
    if paths is None:
        return files.withColumn("named", F.lit(True))
    wanted = paths.select(F.lower("path").alias("wanted")).distinct()
    return files.join(wanted, F.lower("path") == F.col("wanted"), "left").withColumn("named", F.col("wanted").isNotNull()).drop("wanted")


def reset_skipped(files: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Skipped files (or those of paths) as discovered ones, without pages or error."""
    again = F.col("named") & (F.col("status") == "Skipped")
    return _named(files, paths).withColumns({
        "page_count": F.when(again, 0).otherwise(F.col("page_count")), "error": F.when(~again, F.col("error")),
        "status": F.when(again, "Discovered").otherwise(F.col("status"))}).drop("named")


def reopen_completed(files: DataFrame, pages: DataFrame, paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, pages): finished files that were read and whose original is kept are to be read again, and their pages forgotten."""
    again = F.col("named") & (F.col("status") == "Completed") & F.col("action").isin("Ocr", "StripAndRedo") & F.col("original_path").isNotNull()
    marked = _named(files, paths).withColumn("again", F.coalesce(again, F.lit(False))).drop("named")
    kept = pages.join(marked.filter("again").select("path"), "path", "left_anti")
    opened = marked.withColumns({"status": F.when(F.col("again"), "Classified").otherwise(F.col("status")), "action": F.when(F.col("again"), "ReadAgain").otherwise(F.col("action")), "error": F.when(~F.col("again"), F.col("error"))})
    return opened.drop("again"), kept


def relink_originals(files: DataFrame, originals: DataFrame) -> DataFrame:
    """Files without an original on record, not finished, that originals(path, original_path, content_hash, page_count) hold
    with other content and as many pages: finished copies made from it."""
    kept = originals.select("path", F.col("original_path").alias("kept_path"), F.col("content_hash").alias("kept_hash"), F.col("page_count").alias("kept_pages"))
    lost = F.col("original_path").isNull() & F.col("status").isin("Skipped", "Classified", "Discovered", "Failed")
    fits = F.col("kept_path").isNotNull() & ~F.col("kept_hash").eqNullSafe(F.col("content_hash")) & (F.col("kept_pages") == F.col("page_count"))
    both = files.join(kept, "path", "left").withColumn("found", F.coalesce(lost & fits, F.lit(False)))
    found = F.col("found")
    return both.withColumns({
        "status": F.when(found, "Completed").otherwise(F.col("status")), "action": F.when(found, "Ocr").otherwise(F.col("action")),
        "output_path": F.when(found, F.col("path")).otherwise(F.col("output_path")), "original_path": F.when(found, F.col("kept_path")).otherwise(F.col("original_path")),
        "error": F.when(~found, F.col("error"))}).drop("found", "kept_path", "kept_hash", "kept_pages")


def dehyphenated(pages: DataFrame, common: Sequence[str], text: str = "text") -> DataFrame:
    """pages with words rejoined that a line's end broke, and alternates, the readings not chosen.

    A line that ends in a letter and one hyphen goes on in the next if that begins, after blanks, with a
    letter that is no capital. Before the hyphen a common word keeps it; a fragment loses it. What is
    left of the next line stands behind a blank and may itself be broken. common: the common words.
    """
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql import types as T

    words = {w.lower() for w in common if len(w) >= 2}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [rejoin(t, words) for t in batch[text]]
            batch[text], batch["alternates"] = [a for a, _ in both], [b for _, b in both]
            yield batch

    fields = [f for f in pages.schema.fields if f.name != "alternates"]
    return pages.select(*(f.name for f in fields)).mapInPandas(run, T.StructType([*fields, T.StructField("alternates", T.StringType())]))


def rejoin(text: str | None, words: set[str]) -> tuple[str, str]:
    """(text, alternates) of one page."""
    import re

    lines = re.split(r"\r\n|[\r\n\f\u0085  ]", text or "")
    out, other, at = [], [], 0
    while at < len(lines):
        line = lines[at].rstrip()
        left = re.search(r"([^\W\d_]+)-$", line)
        right = re.match(r"\s*([^\W\d_]+)", lines[at + 1]) if left and at + 1 < len(lines) else None
        if right and not right[1][0].isupper():
            kept, fused = f"{left[1]}-{right[1]}", left[1] + right[1]
            if not (len(left[1]) >= 2 and left[1].lower() in words):
                kept, fused = fused, kept
            out.append(line[:left.start()] + kept + " ")
            other.append(fused)
            lines[at + 1] = lines[at + 1][right.end():].lstrip()
        else:
            out.append(line + "\n")
        at += 1
    return "".join(out).strip(), " ".join(other)


def compact(spark: SparkSession, folder: str, files: int, into: str) -> None:
    """The same rows in fewer files."""
    spark.read.parquet(folder).repartition(files).write.mode("overwrite").parquet(into)
