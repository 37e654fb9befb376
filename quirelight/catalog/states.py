"""Queries on snapshots, and their SQL. Files are orders: path from the key, size from the price, hashes from other columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import state
from ..plans.storage import Scratch
from .tables import DP, INDEX, common_words, index, library, pages, table

QUERIES, ORACLE_SQL = {}, {}


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("f"), c("o_orderkey").cast("string")).alias("path"), c("o_orderkey").alias("k"), (c("o_custkey") % 400).alias("size"),
        F.concat(F.lit("h"), (c("o_custkey") % 97).cast("string")).alias("content_hash"), F.concat(F.lit("s"), (c("o_custkey") % 3).cast("string")).alias("supplement_hash"),
        c("o_orderdate").alias("modified"), c("o_orderstatus").alias("flag"), (c("o_custkey") % 9 + 1).alias("page_count"))


_FILES = """files as (select 'f' || o_orderkey as path, o_orderkey as k, o_custkey % 400 as size, 'h' || o_custkey % 97 as content_hash, 's' || o_custkey % 3 as supplement_hash,
 o_orderdate as modified, o_orderstatus as flag, o_custkey % 9 + 1 as page_count from orders)"""
#: The later state of things: every 5th file gone, every 7th with other content, every 11th touched, a tenth more files.
_LATER = """later as (select path, k, size, case when k % 7 = 0 then 'x' || content_hash else content_hash end as content_hash, supplement_hash,
  case when k % 11 = 0 then modified + interval 1 day else modified end as modified, flag, page_count from files where k % 5 <> 0
  union all select 'n' || k, k, size, content_hash, supplement_hash, modified, flag, page_count from files where k % 10 = 0)"""


def _later(files: DataFrame) -> DataFrame:
    k = F.col("k")
    kept = files.filter("k % 5 <> 0").withColumn("content_hash", F.when(k % 7 == 0, F.concat(F.lit("x"), "content_hash")).otherwise(F.col("content_hash")))
    kept = kept.withColumn("modified", F.when(k % 11 == 0, F.expr("modified + interval 1 day")).otherwise(F.col("modified")))
    return kept.unionByName(files.filter("k % 10 = 0").withColumn("path", F.concat(F.lit("n"), k.cast("string"))))


def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as pages of documents: documents whose key divides by 6 come again with their first two pages only."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number"), F.col("l_quantity").alias("value"))
    again = rows.filter("doc_id % 6 = 0 and page_number <= 2").withColumn("value", F.col("value") + 1000)
    return state.upsert(rows, again, ["doc_id"])


QUERIES["upsert_documents"] = upsert_documents
ORACLE_SQL["upsert_documents"] = """with r as (select l_orderkey as doc_id, l_linenumber as page_number, l_quantity as value from lineitem), n as (select doc_id, page_number, value + 1000 as value from r where doc_id % 6 = 0 and page_number <= 2)
select * from r where doc_id not in (select doc_id from n) union all select * from n"""


def merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select("path", "size", "content_hash", "flag")
    new = _later(_files(spark, sf_dir)).select("path", F.when(F.col("k") % 2 == 0, F.col("size") + 1).alias("size"), "content_hash", F.lit(None).cast("string").alias("flag"))
    return state.merge_latest(files, new, ["path"])


QUERIES["merge_latest"] = merge_latest
ORACLE_SQL["merge_latest"] = f"""with {_FILES}, {_LATER}, n as (select path, case when k % 2 = 0 then size + 1 end as size, content_hash from later)
select path, coalesce(n.size, f.size) as size, coalesce(n.content_hash, f.content_hash) as content_hash, flag from files f full join n using (path)"""

QUERIES["incremental_pending"] = lambda s, d: state.pending(_later(_files(s, d)), _files(s, d)).select("path", "content_hash")
ORACLE_SQL["incremental_pending"] = f"with {_FILES}, {_LATER} select path, content_hash from later anti join files using (path, content_hash, supplement_hash)"
QUERIES["register_changes"] = lambda s, d: state.register(_files(s, d), _later(_files(s, d)))
ORACLE_SQL["register_changes"] = f"""with {_FILES}, {_LATER} select path, case when f.k is null then 'new' when l.k is null then 'missing'
 when f.size = l.size and f.content_hash = l.content_hash and f.modified = l.modified then 'same' when f.size = l.size and f.content_hash = l.content_hash then 'refreshed' else 'reset' end as change
from files f full join later l using (path)"""


def mark_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).withColumn("status", F.when(F.col("flag") == "P", "Missing").otherwise("Completed"))
    return state.with_presence(files, _later(_files(spark, sf_dir))).select("path", "status")


QUERIES["mark_missing"] = mark_missing
ORACLE_SQL["mark_missing"] = f"""with {_FILES}, {_LATER} select path, case when path not in (select path from later) then 'Missing' when flag = 'P' then 'Discovered' else 'Completed' end as status from files"""


def rename_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select("path", "k", F.when(F.col("k") % 4 == 0, F.concat(F.lit("f"), (F.col("k") - 1).cast("string"))).alias("duplicate_of"))
    names = files.filter("k % 3 = 0").select("path", F.concat(F.lit("renamed/"), "path").alias("new_path"))
    return state.renamed(files, names, ("path", "duplicate_of")).select("path", "duplicate_of")


QUERIES["rename_cascade"] = rename_cascade
ORACLE_SQL["rename_cascade"] = f"""with {_FILES}, f as (select path, k, case when k % 4 = 0 then 'f' || (k - 1) end as duplicate_of from files), n as (select path, 'renamed/' || path as new_path from f where k % 3 = 0)
select coalesce(a.new_path, f.path) as path, coalesce(b.new_path, f.duplicate_of) as duplicate_of from f left join n a on f.path = a.path left join n b on f.duplicate_of = b.path"""


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    disk = _later(_files(spark, sf_dir)).select(F.upper("path").alias("path"))
    return state.reconcile(disk, _files(spark, sf_dir))


QUERIES["reconcile"] = reconcile
ORACLE_SQL["reconcile"] = f"""with {_FILES}, {_LATER}, new as (select lower(path) as key, upper(path) as path from later where path not in (select path from files))
select path, 'index only' as state from files where path not in (select path from later)
union all select path, case when row_number() over (order by key) <= 25 then 'disk only, examined' else 'disk only' end from new"""


def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).withColumn("action", F.when(F.col("k") % 3 == 0, "Skip").otherwise("Ocr"))
    files = files.withColumn("status", F.when(F.col("flag") == "F", "Discovered").when(F.col("flag") == "O", "Completed").otherwise("Failed"))
    return state.work_queue(files.withColumn("duplicate_of", F.when(F.col("k") % 4 == 0, F.lit("f1"))), 100).select("path", "size", "duplicate_of")


QUERIES["work_queue"] = work_queue
ORACLE_SQL["work_queue"] = f"""with {_FILES} select path, size, case when k % 4 = 0 then 'f1' end as duplicate_of from files where k % 3 <> 0 and flag <> 'O'
order by k % 4 = 0, size, path limit 100"""


def _repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).filter("(doc_id + page_number) % 3 = 0")
    return p.select("doc_id", "page_number", F.element_at(F.split("text", "\n"), -1).alias("ocr_text"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("repaired_utc"))


_REPAIRS = DP + ", rep as (select doc_id, page_number, string_split(text, chr(10))[-1] as ocr_text, 1700000000 + doc_id as epoch from dp where (doc_id + page_number) % 3 = 0)"
QUERIES["supplement_hash"] = lambda s, d: state.supplement_hash(_repairs(s, d).withColumnRenamed("doc_id", "path"))
ORACLE_SQL["supplement_hash"] = f"""with {_REPAIRS} select doc_id as path, left(upper(sha256(string_agg(page_number || ':' || length(ocr_text) || ':' || epoch || ';', '' order by page_number))), 16) as supplement_hash from rep group by doc_id"""
def merge_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with what was recovered of a third of them, a word broken at a line's end among it, behind their own text."""
    broken = F.concat(F.lit("zeb-\nra "), "ocr_text")
    return state.merge_recovered(pages(spark, sf_dir), _repairs(spark, sf_dir).withColumn("ocr_text", F.when(F.col("doc_id") % 2 == 0, broken).otherwise(F.col("ocr_text"))).withColumn("confidence", F.lit(0.5)), ["the"])


QUERIES["merge_recovered"] = merge_recovered
ORACLE_SQL["merge_recovered"] = f"""with {_REPAIRS}, o as (select doc_id, page_number, case when doc_id % 2 = 0 then 'zeb-' || chr(10) || 'ra ' || ocr_text else ocr_text end as raw,
   trim(case when doc_id % 2 = 0 then 'zebra ' || trim(ocr_text, '{tx.BLANKS}') else ocr_text end, '{tx.BLANKS}') as ocr, case when doc_id % 2 = 0 then 'zeb-ra' else '' end as other from rep),
 b as (select dp.*, ocr, other, coalesce(length(raw), 0) > 0 as has from dp left join o using (doc_id, page_number))
select doc_id, page_number, case when not has then text when length(text) > 0 then text || chr(10) || chr(10) || ocr else ocr end as text, case when has then other else '' end as alternates,
 case when has then length(text) end as embedded_chars, case when has then length(ocr) end as ocr_chars, case when has then ocr end as ocr_text, case when has then 0.5::double end as confidence from b"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _files(spark, sf_dir).select(
        "path", "k", "page_count", "content_hash", F.when(k % 5 == 0, "Skipped").when(k % 5 == 1, "Completed").when(k % 5 == 2, "Failed").otherwise("Discovered").alias("status"),
        F.when(k % 3 == 0, "CopyFromDuplicate").otherwise("Ocr").alias("action"), F.when(k % 4 == 0, F.concat(F.lit("o/"), "path")).alias("original_path"),
        F.lit(None).cast("string").alias("output_path"), F.when(k % 5 == 2, "broken").alias("error"))


_JOBS = _FILES + """, jobs as (select path, k, page_count, content_hash, case k % 5 when 0 then 'Skipped' when 1 then 'Completed' when 2 then 'Failed' else 'Discovered' end as status,
 case when k % 3 = 0 then 'CopyFromDuplicate' else 'Ocr' end as action, case when k % 4 = 0 then 'o/' || path end as original_path, null::varchar as output_path, case when k % 5 = 2 then 'broken' end as error from files)"""
QUERIES["reset_skipped"] = lambda s, d: state.reset_skipped(_jobs(s, d)).select("path", "status", "page_count", "error")
ORACLE_SQL["reset_skipped"] = f"with {_JOBS} select path, case when status = 'Skipped' then 'Discovered' else status end as status, case when status = 'Skipped' then 0 else page_count end as page_count, error from jobs"


def reopen_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished files with an original go back to be read again; their pages are forgotten."""
    jobs = _jobs(spark, sf_dir)
    done = jobs.select("path", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("page_number"))
    files, kept = state.reopen_completed(jobs, done)
    return files.join(kept.groupBy("path").agg(F.count("*").alias("kept")), "path", "left").select("path", "status", "action", F.coalesce("kept", F.lit(0)).alias("kept"))


QUERIES["reopen_completed"] = reopen_completed
ORACLE_SQL["reopen_completed"] = f"""with {_JOBS}, r as (select *, status = 'Completed' and action = 'Ocr' and original_path is not null as again from jobs)
select path, case when again then 'Classified' else status end as status, case when again then 'ReadAgain' else action end as action, case when again then 0 else page_count end as kept from r"""


def relink_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that lost their history and have another file of as many pages among the originals count as made from it."""
    jobs = _jobs(spark, sf_dir)
    originals = jobs.filter("k % 2 = 0 or k % 7 = 0").select("path", F.concat(F.lit("orig/"), "path").alias("original_path"), F.when(F.col("k") % 7 == 0, F.col("content_hash")).otherwise(F.lit("older")).alias("content_hash"), (F.col("page_count") + (F.col("k") % 11 == 0).cast("int")).alias("page_count"))
    return state.relink_originals(jobs, originals).select("path", "status", "action", "original_path", "output_path", "error")


QUERIES["relink_originals"] = relink_originals
ORACLE_SQL["relink_originals"] = f"""with {_JOBS}, r as (select *, original_path is null and status in ('Skipped', 'Classified', 'Discovered', 'Failed') and k % 2 = 0 and k % 7 <> 0 and k % 11 <> 0 as found from jobs)
select path, case when found then 'Completed' else status end as status, case when found then 'Ocr' else action end as action, case when found then 'orig/' || path else original_path end as original_path,
 case when found then path else output_path end as output_path, case when found then null else error end as error from r"""


def free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name for each customer's next order, those of the earlier ones being taken."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").cast("int").alias("n"))
    taken = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.when(i == 1, F.lit("a.b.pdf")).otherwise(F.concat(F.lit("a.b ("), i.cast("string"), F.lit(").pdf"))))
    return orders.select("o_custkey", state.free_name(F.lit("a.b.pdf"), taken).alias("name"))


QUERIES["free_names"] = free_names
ORACLE_SQL["free_names"] = "select o_custkey, 'a.b (' || (count(*) + 1) || ').pdf' as name from orders group by o_custkey"


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's postings written in fewer files: rows and terms stay."""
    scratch = Scratch(spark, "compact")
    scratch.save(index(spark, sf_dir).postings.drop("shard"), "many")
    state.compact(spark, scratch.path("many"), 4, scratch.path("few"))
    few = spark.read.parquet(scratch.path("few"))
    return few.agg(F.count("*").alias("tokens"), F.countDistinct("term").alias("terms"))


QUERIES["compacted"] = compacted
ORACLE_SQL["compacted"] = f"with {INDEX} select count(*) as tokens, count(distinct term) as terms from tk"
QUERIES["already_held"] = lambda s, d: state.already_held(_files(s, d).filter("k % 10 = 1").withColumn("path", F.concat(F.lit("in/"), "path")), _files(s, d).filter("k % 10 <> 1"))
ORACLE_SQL["already_held"] = f"""with {_FILES} select 'in/' || i.path as path, held_as from files i join (select size, content_hash, min(path) as held_as from files where k % 10 <> 1 group by all) h using (size, content_hash) where k % 10 = 1"""


def copies_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).withColumn("status", F.when(F.col("flag") == "F", "Completed").otherwise("Discovered"))
    return state.copies_ready(files.withColumn("duplicate_of", F.when(F.col("k") % 2 == 0, F.concat(F.lit("f"), (F.col("k") - 1).cast("string"))))).select("path", "duplicate_of")


QUERIES["copies_ready"] = copies_ready
ORACLE_SQL["copies_ready"] = f"""with {_FILES} select path, 'f' || (k - 1) as duplicate_of from files where k % 2 = 0 and flag <> 'F' and 'f' || (k - 1) in (select path from files where flag = 'F')"""


def completed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as files, their lines as pages, those shipped after mid 1995 complete; a file has as many pages as its order key leaves."""
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_orderkey") % 5 + 1).alias("page_count"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.when(F.col("l_linestatus") == "F", "Completed").otherwise("Failed").alias("status"))
    return state.completed_pages(files, lines)


QUERIES["completed_pages"] = completed_pages
ORACLE_SQL["completed_pages"] = """select o_orderkey as path, o_orderkey % 5 + 1 as page_count, coalesce(n, 0) as done, coalesce(n, 0) = o_orderkey % 5 + 1 as complete
from orders left join (select l_orderkey, count(*) as n from lineitem where l_linestatus = 'F' group by all) on o_orderkey = l_orderkey"""


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as cached pages: a null where the JSON of the words cannot be read."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.lit(1).alias("page_number"), F.col("event_type").alias("settings"), "event_id")
    cache = e.filter("event_id % 2 = 0").withColumn("words_json", F.when(F.col("event_id") % 6 == 0, "[{broken").otherwise('[{"t":"a","x":1,"y":2,"w":3,"h":4,"c":0.5}]'))
    return state.cache_misses(e.select("path", "page_number", "settings"), cache)


QUERIES["cache_misses"] = cache_misses
ORACLE_SQL["cache_misses"] = "select cast(event_id as varchar) as path, 1 as page_number, event_type as settings from events where event_id % 2 <> 0 or event_id % 6 = 0"


def structural_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as images of pages, before and after some were lost, scaled or encoded anew; pages that lost or gained one say so only."""
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    rows = one.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("image_no"), (F.col("p") % 50 + 1).alias("width"), (F.col("p") % 90).alias("height"), F.lit("A").alias("filter"), "p")
    after = rows.filter("p % 29 <> 0").withColumn("width", F.when(F.col("p") % 5 == 0, F.col("width") * 2).otherwise(F.col("width"))).withColumn("filter", F.when(F.col("p") % 4 == 0, F.lit("X")).otherwise(F.col("filter")))
    return state.structural_diff(rows.filter("p % 23 <> 0"), after)


QUERIES["structural_diff"] = structural_diff
ORACLE_SQL["structural_diff"] = """with r as (select l_orderkey as page, l_linenumber as image_no, min(l_partkey) as p from lineitem group by all),
 c as (select page, count(*) filter (p % 23 <> 0) as a, count(*) filter (p % 29 <> 0) as b from r group by page)
select page, null as image_no, 'images' as difference from c where a <> b
union all select page, image_no, case when p % 29 = 0 then 'lost' when p % 23 = 0 then 'added' when p % 5 = 0 then 'pixels' else 'filter' end
from r semi join (select page from c where a = b) using (page) where not (p % 29 = 0 and p % 23 = 0) and (p % 29 = 0 or p % 23 = 0 or p % 5 = 0 or p % 4 = 0)"""


def page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as documents and their lines as pages, before and after some were cropped, turned, or lost."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("page_number")).agg(F.min("l_partkey").alias("p"))
    before = rows.select("path", "page_number", (F.col("p") % 50 + 500.0).alias("width"), F.lit(700.0).alias("height"), F.lit(0).alias("rotation"), "p")
    after = before.filter("p % 31 <> 0").withColumn("width", F.col("width") + F.when(F.col("p") % 5 == 0, 0.2).when(F.col("p") % 5 == 1, 0.04).otherwise(0.0)).withColumn("rotation", F.when(F.col("p") % 7 == 0, 90).otherwise(0))
    return state.page_diff(before, after)


QUERIES["page_diff"] = page_diff
ORACLE_SQL["page_diff"] = """with r as (select l_orderkey as path, l_linenumber as page_number, min(l_partkey) as p from lineitem group by all),
 c as (select path, count(*) as a, count(*) filter (p % 31 <> 0) as b from r group by path)
select path, null as page_number, 'pages' as difference from c where a <> b
union all select path, page_number, case when p % 5 = 0 and p % 7 = 0 then 'size,rotation' when p % 5 = 0 then 'size' else 'rotation' end from r semi join (select path from c where a = b) using (path) where p % 5 = 0 or p % 7 = 0"""


def first_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as documents, their lines as links: the first link of each that opens another page, or the count if it changed."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("ordinal")).agg(F.min("l_partkey").alias("opens"))
    after = rows.filter("opens % 37 <> 0").withColumn("opens", F.when(F.col("opens") % 3 == 0, None).otherwise(F.col("opens")))
    return state.first_difference(rows, after, ["opens"])


QUERIES["first_change"] = first_change
ORACLE_SQL["first_change"] = """with r as (select l_orderkey as path, l_linenumber as ordinal, min(l_partkey) as p from lineitem group by all), c as (select path, count(*) as a, count(*) filter (p % 37 <> 0) as b, min(ordinal) filter (p % 3 = 0) as o from r group by path)
select path, case when a <> b then null else o end as ordinal, case when a <> b then 'count' else 'changed' end as difference from c where a <> b or o is not null"""


def dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages broken at every fortieth character, hyphenated where that falls inside a word, and rejoined."""
    broken = pages(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"(.{37}\p{Ll})(\p{Ll})", "$1-\n$2"))
    return state.dehyphenated(broken, common_words(spark, sf_dir))


QUERIES["dehyphenate"] = dehyphenate
QUERIES["library_files"] = library
ORACLE_SQL["library_files"] = "select doc_id, source || '/' || doc_id || '.pdf' as path, 'Manual ' || source as title, upper(sha256(text)) as content_hash from documents"
