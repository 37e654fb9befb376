"""Files in and out: discovery, hashes, sidecars, reports, manifests and lists."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_hash, edge_fingerprint
from ..plans.ordering import in_order, with_row_number
from ..plans.storage import Scratch

REPORT = ("path", "pages", "text_class", "action", "alphanumeric_per_page", "plausible_ratio", "common_share", "duplicate_of", "blocker", "error")


def discover(spark: SparkSession, root: str, excluded: Sequence[str] = (), pattern: str = "*.pdf") -> DataFrame:
    """path, size, modified of the files under root, not those of excluded top-level folders; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    inside = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "")
    rows = files.select(F.substring(inside, F.lit(len(base) + 2), F.length(inside)).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    for folder in excluded:
        rows = rows.filter(~F.startswith(F.lower("path"), F.lit(folder.lower().rstrip("/") + "/")))
    return rows.orderBy(F.lower("path"))


def hashes(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """path, content_hash, edge_hash of whole contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return files.select("path", content_hash(F.col("content")).alias("content_hash"), edge_fingerprint(F.col("content")).alias("edge_hash"))


def extract_pages(files: DataFrame, extractor: Callable[[bytes], Iterable[Callable[[], str]]], key: str = "path") -> DataFrame:
    """key, page_number (from 1), text, error of files(key, content): ``extractor`` gives a file's pages as calls that return their text.

    A page that fails has an empty text and its error; a file whose pages cannot even be listed has one
    row, without a page number. No file ends another's reading.
    """
    schema = T.StructType([files.schema[key], T.StructField("page_number", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])

    def of_file(content: bytes | None) -> Iterator[tuple]:
        try:
            pages = list(extractor(bytes(content or b"")))
        except Exception as e:  # noqa: BLE001  any failure of a reader is a row
            yield None, "", f"{type(e).__name__}: {e}"
            return
        for n, page in enumerate(pages, 1):
            try:
                yield n, page(), None
            except Exception as e:  # noqa: BLE001
                yield n, "", f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a file's pages leave before the next file is read
                rows = list(of_file(batch.column("content")[i].as_py()))
                keys = batch.column(key).slice(i, 1).take(pa.array([0] * len(rows), pa.int32()))
                number, text, error = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([keys, pa.array(number, pa.int32()), pa.array(text, pa.string()), pa.array(error, pa.string())], names=schema.names)

    return files.select(key, "content").mapInArrow(run, schema)


def sidecars(pages: DataFrame) -> DataFrame:
    """doc_id, sidecar: a document's pages in order under lines ``--- page N ---``. A document is one row."""
    block = F.concat(F.lit("--- page "), F.col("page_number").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", block.alias("b"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "").alias("sidecar"))


def parse_sidecars(rows: DataFrame) -> DataFrame:
    """doc_id, page_number, text out of doc_id, sidecar."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.col("sidecar")), r"\n--- page (?=\d+ ---\n)"), lambda p: p.rlike(r"^\d+ ---\n"))
    found = rows.select("doc_id", F.explode(parts).alias("p"))
    number = F.regexp_extract("p", r"^(\d+) ---\n", 1).cast("int")
    return found.select("doc_id", number.alias("page_number"), F.regexp_replace(F.regexp_replace("p", r"^\d+ ---\n", ""), r"\n$", "").alias("text"))


def one_line(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")


def write_report(files: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled, line breaks as blanks, ratios with four decimals."""
    ratio = lambda c: F.format_string("%.4f", F.col(c)).alias(c)
    cols = [ratio(c) if c.endswith(("ratio", "share")) else F.format_string("%.1f", F.col(c)).alias(c) if c.endswith("per_page") else one_line(F.col(c).cast("string")).alias(c) for c in REPORT if c in files.columns]
    files.select(*cols).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def audit_json(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """One JSON text a document, its findings nested in order of page, numbers rounded to six places."""
    listed = findings.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page_number", "verdict", "kind", F.round("uncovered", 6).alias("uncovered")))).alias("pages"))
    both = documents.join(listed, "path", "left").withColumn("pages", F.coalesce("pages", F.array().cast(listed.schema["pages"].dataType)))
    return both.select("path", F.to_json(F.struct("path", "page_count", "flagged", F.round("flagged_share", 6).alias("flagged_share"), "pages")).alias("json"))


def search_json(hits: DataFrame, caveats: dict[str, str]) -> str:
    """The JSON of a search: schema version, results in order, caveats. hits are at most a query's limit."""
    import json

    rows = [r.asDict(recursive=True) for r in hits.orderBy("rank").collect()]
    return json.dumps({"schemaVersion": 1, "results": rows, "caveats": caveats}, ensure_ascii=False, default=str)


def files_only(hits: DataFrame) -> DataFrame:
    """Distinct paths in order of their best rank."""
    return hits.groupBy("path").agg(F.min("rank").alias("rank")).orderBy("rank")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """manual, page, kind, textFile, source of a ground-truth CSV; an unknown kind is Mixed."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').schema("manual string, page int, kind string, textFile string, source string").csv(path)
    known = F.initcap("kind")
    return rows.withColumn("kind", F.when(known.isin("Prose", "Table", "Schematic", "Mixed"), known).otherwise("Mixed"))


def seed_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with the rows of new whose (manual, page) it lacks behind it; what is there stays as corrected."""
    return old.unionByName(new.join(old, ["manual", "page"], "left_anti").select(*old.columns))


def read_page_list(spark: SparkSession, path: str) -> DataFrame:
    """path, page of lines divided by their last tab; # begins a comment."""
    lines = spark.read.text(path).filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    return lines.select(F.regexp_extract("value", r"^(.*)\t(\d+)\s*$", 1).alias("path"), F.regexp_extract("value", r"^(.*)\t(\d+)\s*$", 2).cast("int").alias("page")).filter("page is not null")


def page_list(pages: DataFrame) -> DataFrame:
    return pages.select(F.concat_ws("\t", "path", F.col("page").cast("string")).alias("value"))


def book_manifest(outcomes: DataFrame, scratch: Scratch) -> DataFrame:
    """book_page, page, path, error of outcomes(nth, path, page, error): pages that could be rendered are numbered from 1 in their order, others 0."""
    good = with_row_number(in_order(outcomes.filter("error is null"), ["nth"], scratch, "book"))
    numbered = good.select((F.col("row_number") + 1).alias("book_page"), "page", "path", "error")
    return numbered.unionByName(outcomes.filter("error is not null").select(F.lit(0).cast("long").alias("book_page"), "page", "path", "error"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """page, document, query of a tab-separated list with # comments."""
    return spark.read.option("sep", "\t").option("comment", "#").schema("page int, document string, query string").csv(path)


def page_link(path: Column, page: Column | None = None, picture: bool = False) -> Column:
    """/manuals/<escaped path>, with /page/N and .png where asked for; slashes stay."""
    escaped = F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    link = F.concat(F.lit("/manuals/"), escaped)
    if page is not None:
        link = F.concat(link, F.lit("/page/"), page.cast("string"), F.lit(".png" if picture else ""))
    return link


def parse_link(link: Column) -> tuple[Column, Column, Column]:
    """(path or null, page or null, picture) of a link; a path that leaves the root is null."""
    rest = F.regexp_extract(link, r"^/manuals/(.+?)(?:/page/\d+(?:\.png)?)?$", 1)
    path = F.url_decode(F.replace(rest, F.lit("+"), F.lit("%2B")))
    outside = (rest == "") | path.rlike(r"(^|/)\.\.(/|$)") | F.startswith(path, F.lit("/")) | F.contains(path, F.lit(":"))
    page = F.regexp_extract(link, r"/page/(\d+)(?:\.png)?$", 1)
    return F.when(~outside, path), F.when(page != "", page.cast("int")), F.endswith(link, F.lit(".png"))


def html_text(html: Column) -> Column:
    """Text of a page of HTML: without scripts, styles and tags, the common entities read."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
