"""Queries on text quality, and their SQL. Glyph counts and scans do not exist in the driver's tables and are made by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import quality
from .tables import COMMON_SQL, DP, INDEX, common_words, library, pages, read, table

QUERIES, ORACLE_SQL = {}, {}


def _listed(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(words))) + ")"


_TRIM = "-_\"''*.,;:()[]|/\\"
METRICS = INDEX + f", {COMMON_SQL}" + rf""",
 w as (select doc_id, page_number, regexp_extract_all(text, '[^{tx.BLANK}]+') as words from dp),
 j as (select *, list_filter(list_transform(words, lambda x: trim(x, '{_TRIM}')), lambda x: length(x) >= 2) as judged from w),
 m as (select doc_id, page_number, cast(length(regexp_replace(array_to_string(words, ''), '[^\p{{L}}\p{{Nd}}]', '', 'g')) as bigint) as alphanumeric,
   cast(len(judged) as bigint) as tokens,
   cast(len(list_filter(judged, lambda x: length(regexp_replace(x, '[\p{{L}}\p{{Nd}}:_./+-]', '', 'g')) <= 1
     and (length(regexp_replace(x, '[^\p{{L}}]', '', 'g')) >= 2 or length(regexp_replace(x, '[^\p{{Nd}}]', '', 'g')) >= 2))) as bigint) as plausible,
   cast(len(list_filter(judged, lambda x: regexp_full_match(x, '\p{{L}}+'))) as bigint) as word_like,
   cast(len(list_filter(judged, lambda x: regexp_full_match(x, '\p{{L}}+') and list_contains(common, strip_accents(lower(x))))) as bigint) as common from j, (select list(term) as common from cw))"""


def page_text_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each page."""
    return quality.page_metrics(pages(spark, sf_dir), common_words(spark, sf_dir))


QUERIES["page_text_metrics"] = page_text_metrics
ORACLE_SQL["page_text_metrics"] = f"with {METRICS} select * from m"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document draws far more glyphs than it has letters; a page of under 40 letters and digits is a scan."""
    m = page_text_metrics(spark, sf_dir).withColumn("glyphs", F.when(F.col("doc_id") % 7 == 0, F.col("alphanumeric") * 3 + 100).otherwise(F.col("alphanumeric")))
    return quality.document_metrics(m.withColumn("is_scan", (F.col("alphanumeric") < 40) & (F.col("page_number") > 1)))


_DOCUMENTS = METRICS + """,
 d as (select doc_id, count(*) as pages, avg(alphanumeric) as alphanumeric_per_page, avg(case when doc_id % 7 = 0 then alphanumeric * 3 + 100 else alphanumeric end) as glyphs_per_page,
   case when sum(tokens) > 0 then sum(plausible) / sum(tokens) else 0.0 end as plausible_ratio,
   case when sum(word_like) > 0 then sum(common) / sum(word_like) else 0.0 end as common_share,
   sum((alphanumeric < 40 and page_number > 1)::int) as scanned_pages from m group by doc_id),
 c as (select *, case when alphanumeric_per_page < 100 then (case when glyphs_per_page >= 100 and alphanumeric_per_page < 0.5 * glyphs_per_page then 'UnreadableTextLayer' else 'ImageOnly' end)
   when plausible_ratio >= 0.85 then 'GoodText' when plausible_ratio < 0.6 then 'SuspectText' when common_share >= 0.15 then 'GoodText' else 'ProbablyGood' end as found from d),
 classed as (select *, case when scanned_pages > 0 and found in ('GoodText', 'ProbablyGood') then 'PartlyScanned' else found end as text_class from c)"""


def document_text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled metrics of each document."""
    d = _documents(spark, sf_dir)
    return d.select("doc_id", "pages", *(F.round(c, 6).alias(c) for c in ("alphanumeric_per_page", "glyphs_per_page", "plausible_ratio", "common_share")), "scanned_pages")


QUERIES["document_text_quality"] = document_text_quality
ORACLE_SQL["document_text_quality"] = f"""with {_DOCUMENTS} select doc_id, pages, round(alphanumeric_per_page, 6) as alphanumeric_per_page, round(glyphs_per_page, 6) as glyphs_per_page,
 round(plausible_ratio, 6) as plausible_ratio, round(common_share, 6) as common_share, scanned_pages from d"""

QUERIES["classify_documents"] = lambda s, d: quality.classify(_documents(s, d)).select("doc_id", "text_class")
ORACLE_SQL["classify_documents"] = f"with {_DOCUMENTS} select doc_id, text_class from classed"

_POLICY = "SuspectText=StripAndRedo, goodtext=readagain"
QUERIES["policy_actions"] = lambda s, d: quality.with_action(quality.classify(_documents(s, d)), quality.parse_policy(_POLICY)).select("doc_id", "text_class", "action")
_ACTION = "case text_class when 'ImageOnly' then 'Ocr' when 'PartlyScanned' then 'Ocr' when 'SuspectText' then 'StripAndRedo' when 'GoodText' then 'ReadAgain' else 'Skip' end"
ORACLE_SQL["policy_actions"] = f"with {_DOCUMENTS} select doc_id, text_class, {_ACTION} as action from classed"


def class_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, pages and actions of each class; every eleventh file is missing, every ninth a copy."""
    d = quality.with_action(quality.classify(_documents(spark, sf_dir)), quality.parse_policy(_POLICY))
    files = d.withColumn("status", F.when(F.col("doc_id") % 11 == 0, "Missing").otherwise("Discovered")).withColumnRenamed("pages", "page_count")
    return quality.class_summary(files.withColumn("action", F.when(F.col("doc_id") % 9 == 0, "CopyFromDuplicate").otherwise(F.col("action"))))


QUERIES["class_summary"] = class_summary
ORACLE_SQL["class_summary"] = f"""with {_DOCUMENTS}, a as (select *, case when doc_id % 9 = 0 then 'CopyFromDuplicate' else {_ACTION} end as action from classed where doc_id % 11 <> 0)
select text_class, count(*) as files, sum(pages) as pages, string_agg(distinct action, ',' order by action) as actions from a group by text_class"""


def dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of equal content with the one that is kept."""
    return quality.duplicate_groups(library(spark, sf_dir)).select("path", "primary", "redundant")


QUERIES["dedup_groups"] = dedup_groups
ORACLE_SQL["dedup_groups"] = r"""with f as (select source || '/' || doc_id || '.pdf' as path, sha256(text) as h from documents),
 r as (select *, count(*) over (partition by h) as n, first_value(path) over (partition by h
   order by length(path) - length(replace(path, '/', '')), -len(regexp_extract_all(split_part(split_part(path, '/', 2), '.', 1), '[A-Za-z]{3,}')), path) as "primary" from f)
select path, "primary", path <> "primary" as redundant from r where n > 1"""


def reads_as_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages read as running text."""
    return pages(spark, sf_dir).select("doc_id", "page_number", tx.reads_as_written(F.col("text")).alias("reads"))


QUERIES["reads_as_written"] = reads_as_written
ORACLE_SQL["reads_as_written"] = rf"""with {DP}, w as (select doc_id, page_number, regexp_extract_all(text, '[^{tx.BLANK}]+') as words from dp),
 k as (select *, list_filter(list_transform(words, lambda x: trim(x, '.,:;()"''-')), lambda x: regexp_full_match(x, '\p{{L}}{{2,3}}')) as short from w)
select doc_id, page_number, len(words) >= 50
 and len(list_filter(words, lambda x: regexp_full_match(x, '\p{{L}}') and x not in ('a', 'A', 'I'))) * 100 <= len(words) * 3
 and coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) * 2 >= len(words) * 7
 and (len(short) < 10 or len(list_filter(short, lambda x: lower(x) not in {_listed(tx.ORDINARY_SHORT_WORDS)})) * 100 <= len(short) * 35) as reads from k"""

QUERIES["page_fingerprint_dedup"] = lambda s, d: quality.distinct_pages(pages(s, d))
ORACLE_SQL["page_fingerprint_dedup"] = rf"""with {DP}, f as (select *, left(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]', '', 'g'), 400) as k from dp)
select min(struct_pack(doc_id, page_number)).doc_id as doc_id, min(struct_pack(doc_id, page_number)).page_number as page_number, count(*) as copies from f where k <> '' group by k"""

QUERIES["page_kind"] = lambda s, d: pages(s, d).select("doc_id", "page_number", tx.page_kind(F.col("text")).alias("kind"))
ORACLE_SQL["page_kind"] = rf"""with {DP}, l as (select *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, '{tx.BLANKS}')), lambda x: x <> '') as rows from dp)
select doc_id, page_number, case when len(rows) = 0 then 'Mixed'
 when len(list_filter(rows, lambda x: len(list_filter(string_split(x, ' '), lambda w: w <> '')) <= 6 and regexp_matches(x, '\d'))) * 10 >= len(rows) * 4 then 'Table' else 'Prose' end as kind from l"""

QUERIES["label_like_pages"] = lambda s, d: table(s, d, "pages").select(
    "page_id", tx.is_labels(F.regexp_replace("html", "<", "\n<")).alias("labels"))
ORACLE_SQL["label_like_pages"] = f"""with l as (select page_id, list_sort(list_transform(list_filter(list_transform(string_split(replace(html, '<', chr(10) || '<'), chr(10)), lambda x: trim(x, '{tx.BLANKS}')), lambda x: x <> ''), lambda x: length(x))) as n from pages)
select page_id, len(n) >= 12 and n[len(n) // 2 + 1] <= 16 as labels from l"""

QUERIES["content_hash"] = lambda s, d: read(s, d, "documents", "doc_id", "text").select("doc_id", tx.content_hash(F.encode("text", "UTF-8")).alias("content_hash"))
ORACLE_SQL["content_hash"] = "select doc_id, upper(sha256(text)) as content_hash from documents"


def mnemonic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in command case over all documents."""
    found = read(spark, sf_dir, "documents", "text").select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9]+"), F.lit(0))).alias("word"))
    return found.filter(tx.is_mnemonic(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


QUERIES["mnemonic_words"] = mnemonic_words
ORACLE_SQL["mnemonic_words"] = """with w as (select unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) as word from documents)
select word, count(*) as n from w where regexp_full_match(word, '[A-Z]{2,}[a-z]+') and word not like '%Hz' group by word"""
