"""Queries on audits, and their SQL. The driver has no page statistics: lineitem stands for pages (order = document, line = page), numbers by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from .tables import DP, pages, table

QUERIES, ORACLE_SQL = {}, {}


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col
    return table(spark, sf_dir, "lineitem").select(
        i("l_orderkey").alias("path"), i("l_linenumber").alias("page_number"), (i("l_partkey") * 7 % 1500).alias("glyphs"), (i("l_partkey") * 5 % 1400).alias("decoded"),
        (i("l_partkey") % 97).alias("path_ops"), (i("l_suppkey") % 10 / 10).alias("image"), (i("l_partkey") % 50 / 10000).alias("uncovered"), (i("l_partkey") % 100).alias("blobs"),
        (i("l_partkey") % 12).alias("height"), i("l_quantity").alias("quantity"), i("l_shipdate").alias("repaired_utc"), (i("l_partkey") % 13 == 0).alias("type3"),
        (i("l_partkey") % 200).cast("string").alias("fingerprint"))


_RAW = """raw as (select l_orderkey as path, l_linenumber as page_number, l_partkey * 7 % 1500 as glyphs, l_partkey * 5 % 1400 as decoded, l_partkey % 97 as path_ops,
  l_suppkey % 10 / 10 as image, l_partkey % 50 / 10000 as uncovered, l_partkey % 100 as blobs, l_partkey % 12 as height, l_quantity as quantity, l_shipdate as repaired_utc,
  l_partkey % 13 = 0 as type3, cast(l_partkey % 200 as varchar) as fingerprint from lineitem),
 f as (select *, case when glyphs = 0 and image >= 0.5 then 'NoTextLayer' when glyphs > 0 and decoded < 100 and glyphs >= 4 * decoded then 'Undecodable'
   when not (glyphs < 900 or path_ops >= 40 or image >= 0.10) then 'Fine' when uncovered >= 0.002 and blobs >= 40 then 'UnderExtracted' else 'Fine' end as verdict,
   case when image >= 0.2 then 'Raster' else 'Drawn' end as kind, cast(round_even(blobs * 0.85, 0) as bigint) as recoverable_chars,
   case when height <= 0 then 300 when height < 7 then 600 when height < 9 then 400 else 300 end as dpi from raw)"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict, kind, chars = audit.page_verdict()
    return _raw(spark, sf_dir).withColumns({"verdict": verdict, "kind": kind, "recoverable_chars": chars, "dpi": audit.suggested_dpi(F.col("height"))})


QUERIES["page_verdict"] = lambda s, d: _findings(s, d).select("path", "page_number", "verdict", "kind", "recoverable_chars", "dpi")
ORACLE_SQL["page_verdict"] = f"with {_RAW} select path, page_number, verdict, kind, recoverable_chars, dpi from f"

_DOCS = _RAW + """,
 d0 as (select path, count(*) as page_count, sum((verdict = 'UnderExtracted')::int) as flagged, sum((verdict = 'UnderExtracted' and kind = 'Drawn')::int) as drawn,
   sum(case when verdict = 'UnderExtracted' then recoverable_chars else 0 end) as recoverable, max(case when verdict = 'UnderExtracted' then dpi end) as dpi from f group by path),
 d as (select *, flagged - drawn as raster, flagged / page_count as flagged_share, case when flagged = 0 then 'Sound' when drawn >= 0.1 * page_count then 'UnderExtracted'
   when flagged - drawn >= 0.1 * page_count then 'ScannedGaps' else 'Figures' end as document_verdict, 'h' || path % 10 as content_hash from d0),
 rep as (select path, page_number, 'h' || (case when path % 4 = 0 then 99 else path % 10 end) as content_hash, repeat('x', case when page_number = 2 then 0 else cast(quantity as integer) end) as ocr_text, repaired_utc
   from raw where page_number <= 3 and path % 3 <> 0),
 done as (select distinct path, page_number from rep semi join d using (path, content_hash)),
 r as (select d.*, coalesce(n, 0) as repaired, greatest(0, flagged - coalesce(n, 0)) as outstanding
   from d left join (select path, count(*) as n from done semi join (select * from f where verdict = 'UnderExtracted') u using (path, page_number) group by path) using (path))"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.document_audit(_findings(spark, sf_dir)).withColumn("content_hash", F.concat(F.lit("h"), (F.col("path") % 10).cast("string")))


def _repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three pages of two thirds of the documents; every fourth repair was made against other content, page 2 gave nothing."""
    rows = _raw(spark, sf_dir).filter("page_number <= 3 and path % 3 <> 0")
    made = F.when(F.col("path") % 4 == 0, F.lit(99)).otherwise(F.col("path") % 10)
    size = F.when(F.col("page_number") == 2, F.lit(0)).otherwise(F.col("quantity").cast("int"))
    return rows.select("path", "page_number", F.concat(F.lit("h"), made.cast("string")).alias("content_hash"), F.repeat(F.lit("x"), size).alias("ocr_text"), "repaired_utc")


QUERIES["document_audit"] = lambda s, d: _documents(s, d).drop("content_hash").withColumn("flagged_share", F.round("flagged_share", 6))
ORACLE_SQL["document_audit"] = f"with {_DOCS} select path, page_count, flagged, drawn, recoverable, dpi, raster, round(flagged_share, 6) as flagged_share, document_verdict from d"

QUERIES["valid_repairs"] = lambda s, d: audit.valid_repairs(_repairs(s, d), _documents(s, d)).select("path", "page_number", "content_hash")
ORACLE_SQL["valid_repairs"] = f"with {_DOCS} select path, page_number, content_hash from rep semi join d using (path, content_hash)"


def _with_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.with_repaired(_documents(spark, sf_dir), _findings(spark, sf_dir), _repairs(spark, sf_dir))


QUERIES["repaired_currently_flagged"] = lambda s, d: _with_repaired(s, d).select("path", "flagged", "repaired", "outstanding")
ORACLE_SQL["repaired_currently_flagged"] = f"with {_DOCS} select path, flagged, repaired, outstanding from r"
QUERIES["audit_summary"] = lambda s, d: audit.audit_summary(_with_repaired(s, d))
ORACLE_SQL["audit_summary"] = f"with {_DOCS} select count(*) as documents, count(*) filter (flagged > 0) as flagged_documents, sum(flagged) as flagged, sum(repaired) as repaired, sum(recoverable) as recoverable from r"
QUERIES["flagged_worst_first"] = lambda s, d: audit.worst_first(_documents(s, d), 20).select("path", "flagged", "recoverable")
ORACLE_SQL["flagged_worst_first"] = f"with {_DOCS} select path, flagged, recoverable from d where flagged > 0 order by recoverable desc, flagged desc, path limit 20"
QUERIES["page_ranges"] = lambda s, d: audit.page_ranges(_findings(s, d).filter("verdict != 'Fine'"))
_RANGES = """ , g as (select path, page_number - row_number() over (partition by path order by page_number) as run, page_number from x),
 s as (select path, min(page_number) as a, max(page_number) as b from g group by path, run)
select path, string_agg(case when a = b then a::varchar else a || '-' || b end, ',' order by a) as ranges from s group by path"""
ORACLE_SQL["page_ranges"] = f"with {_DOCS}, x as (select distinct path, page_number from f where verdict <> 'Fine') {_RANGES}"


def parsed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges written and read again: the pages they name."""
    text = QUERIES["page_ranges"](spark, sf_dir)
    return text.select("path", F.explode(audit.parse_ranges(F.concat(F.lit("x,"), "ranges"))).alias("page_number"))


QUERIES["parsed_ranges"] = parsed_ranges
ORACLE_SQL["parsed_ranges"] = f"with {_RAW} select distinct path, page_number from f where verdict <> 'Fine'"


def outstanding_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged pages without a valid repair, as ranges."""
    docs, found = _documents(spark, sf_dir), _findings(spark, sf_dir).filter("verdict = 'UnderExtracted'")
    done = audit.valid_repairs(_repairs(spark, sf_dir), docs)
    return audit.page_ranges(found.join(done, ["path", "page_number"], "left_anti"))


QUERIES["outstanding_page_ranges"] = outstanding_page_ranges
ORACLE_SQL["outstanding_page_ranges"] = f"with {_DOCS}, x as (select distinct path, page_number from f anti join done using (path, page_number) where verdict = 'UnderExtracted') {_RANGES}"
QUERIES["expected_vs_recovered"] = lambda s, d: audit.expected_and_recovered(_findings(s, d), _repairs(s, d))
ORACLE_SQL["expected_vs_recovered"] = f"""with {_DOCS} select path, page_number, recoverable_chars as expected, length(ocr_text) as recovered,
 case when ocr_text is null then 'not repaired' when ocr_text = '' then 'nothing recovered' else 'recovered' end as outcome
from f left join rep using (path, page_number) where verdict = 'UnderExtracted'"""

_PLAN_SQL = _DOCS + """, plan as (select path, page_number, kind, least(600, f.dpi) as dpi from f join (select path, content_hash, document_verdict from d where document_verdict in ('UnderExtracted', 'Figures')) q using (path)
 left join rep using (path, page_number, content_hash) where verdict = 'UnderExtracted' and (kind = 'Drawn' or document_verdict = 'Figures') and (rep.repaired_utc is null or rep.repaired_utc < timestamp '1995-01-01'))"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.repair_plan(_documents(spark, sf_dir), _findings(spark, sf_dir), _repairs(spark, sf_dir), redo_before="1995-01-01")


QUERIES["repair_plan"] = _plan
ORACLE_SQL["repair_plan"] = f"with {_PLAN_SQL} select * from plan"
QUERIES["repair_plan_breakdown"] = lambda s, d: audit.breakdown(_plan(s, d))
ORACLE_SQL["repair_plan_breakdown"] = f"with {_PLAN_SQL} select kind, dpi, count(*) as pages from plan group by kind, dpi"
QUERIES["repair_estimate"] = lambda s, d: audit.repair_minutes(_findings(s, d).filter("verdict = 'UnderExtracted'")).withColumn("minutes", F.round("minutes", 6))
ORACLE_SQL["repair_estimate"] = f"""with {_RAW} select count(*) as pages, round(sum(1 / case when kind = 'Drawn' then (case dpi when 300 then 89.4 when 400 then 70.8 else 44.0 end)::double
 else (case dpi when 300 then 43.9 when 400 then 45.4 else 28.0 end)::double end), 6) as minutes from f where verdict = 'UnderExtracted'"""
QUERIES["capped_top_pages"] = lambda s, d: audit.capped_top_pages(_findings(s, d), 50).withColumn("weight", F.round("weight", 9))
ORACLE_SQL["capped_top_pages"] = f"""with {_RAW}, w as (select *, path_ops / (glyphs + 1) as weight from f),
 a as (select * from w qualify row_number() over (partition by path_ops, glyphs order by weight desc, path, page_number) = 1),
 b as (select * from a qualify row_number() over (partition by path order by weight desc, path, page_number) <= 2)
select path, page_number, round(weight, 9) as weight from b order by b.weight desc, path, page_number limit 50"""
QUERIES["sample_pages"] = lambda s, d: audit.sample_pages(table(s, d, "part").select(F.col("p_partkey").alias("path"), (F.col("p_partkey") % 300).alias("page_count")), 8)
ORACLE_SQL["sample_pages"] = """with d as (select p_partkey as path, p_partkey % 300 as n from part),
 e as (select *, greatest(1, n // 10) as low, least(n, cast(floor(n * 0.9) as bigint)) as high from d),
 s as (select path, case when n <= 8 then range(1, n + 1) else range(low, greatest(low, high) + 1, greatest(1, greatest(1, high - low) // 8))[1:8] end as p from e)
select path, unnest(p) as page_number from s"""
QUERIES["sample_flagged"] = lambda s, d: audit.sample_rows(_findings(s, d).filter("verdict = 'UnderExtracted'").select("path", "page_number", "kind"), 40, 1, ["path", "page_number"])
QUERIES["sample_unflagged"] = lambda s, d: audit.sample_unflagged(_documents(s, d), _findings(s, d).filter("verdict = 'UnderExtracted'"), 40, 1)


def scans_without_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are one image and carry no text; every thirteenth part has hidden text."""
    raw = _raw(spark, sf_dir).withColumn("glyphs", F.col("glyphs") % 90).withColumnRenamed("type3", "hidden")
    return audit.scans_without_text(raw).select("path", "page_number")


QUERIES["scans_without_text"] = scans_without_text
ORACLE_SQL["scans_without_text"] = f"with {_RAW} select path, page_number from raw where glyphs % 90 <= 40 and not type3 and image >= 0.5"
QUERIES["publisher_truth"] = lambda s, d: audit.publisher_pages(_findings(s, d).withColumn("decoded", F.col("glyphs")), 40)
ORACLE_SQL["publisher_truth"] = f"""with {_RAW}, w as (select * from f where verdict = 'Fine' and not type3 and path_ops < 40 and image <= 0.10 and glyphs > 0 and glyphs >= 900),
 a as (select * from w qualify row_number() over (partition by fingerprint order by path, page_number) = 1),
 b as (select * from a qualify row_number() over (partition by path order by page_number) <= 2)
select path, page_number from b order by path, page_number limit 40"""


def heading_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first page's first line, as a title, is missing from the second page."""
    p = pages(spark, sf_dir)
    title = p.filter("page_number = 1").select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("title"))
    return p.filter("page_number = 2").join(title, "doc_id").select("doc_id", audit.heading_missing(F.col("title"), F.col("text")).alias("missing"))


QUERIES["heading_missing"] = heading_missing
ORACLE_SQL["heading_missing"] = rf"""with {DP}, t as (select doc_id, string_split(text, chr(10))[1] as title from dp where page_number = 1),
 w as (select doc_id, text, list_filter(list_transform(regexp_split_to_array(title, '\s+'), lambda x: trim(x, '.,:;()-')), lambda x: length(x) >= 4) as words from dp join t using (doc_id) where page_number = 2)
select doc_id, len(words) > 0 and len(list_filter(words, lambda x: contains(lower(text), lower(x)))) * 2 < len(words) as missing from w"""
QUERIES["run_report"] = lambda s, d: audit.run_report(_raw(s, d), "quantity")
ORACLE_SQL["run_report"] = "select count(*) as pages, sum(l_quantity) as seconds, avg(l_quantity) as mean, max(l_quantity) as slowest, count(*) * 60 / sum(l_quantity) as pages_per_minute from lineitem"
#: A key is a customer's, so that a fold has as many runs as a customer has orders, however many orders there are.
QUERIES["learned_rate"] = lambda s, d: audit.learned_rates(table(s, d, "orders").select(
    F.col("o_custkey").cast("string").alias("key"), F.col("o_orderkey").alias("run"), (F.col("o_totalprice") / 1000).alias("rate"), (F.col("o_custkey") % 50 + 1).alias("pages")))
ORACLE_SQL["learned_rate"] = """with o as (select o_custkey::varchar as key, list(struct_pack(rate := (o_totalprice / 1000)::double, pages := (o_custkey % 50 + 1)::double) order by o_orderkey) as runs from orders group by o_custkey),
 f as (select key, list_reduce(runs, lambda a, b: struct_pack(rate := (a.rate * a.pages + b.rate * b.pages) / (a.pages + b.pages), pages := least(a.pages + b.pages, 5000.0::double))) as s from o)
select key, s.rate as rate, s.pages as pages from f"""
