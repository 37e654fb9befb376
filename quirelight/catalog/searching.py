"""Search queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..operators import audit, search
from ..operators import query as qy
from ..operators.snippet import snippet_column
from ..sources import files
from .tables import DP, INDEX, LIBRARY, index, library, pages, search_sql

QUERIES, ORACLE_SQL = {}, {}
_TOP = 10


def _hits(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    node, _ = qy.read(query)
    return search.bm25(index(spark, sf_dir), node)


def _top(hits: DataFrame) -> DataFrame:
    return hits.select("doc_id", "page_number", F.round("score", 6).alias("score")).orderBy("score", "doc_id", "page_number").limit(_TOP)


_TOP_SQL = f"\nselect doc_id, page_number, round(score, 6) as score from hits order by round(score, 6), doc_id, page_number limit {_TOP}"
_PAIR = "select doc_id, page_number from "

for _name, _query, _phrases, _match, _scored in [
    ("bm25_search", "was for", {"a": ["was"], "b": ["for"]}, f"{_PAIR}a intersect {_PAIR}b", None),
    ("search_and", "was AND that AND for", {"a": ["was"], "b": ["that"], "c": ["for"]}, f"{_PAIR}a intersect {_PAIR}b intersect {_PAIR}c", None),
    ("search_or", "idiot OR clown", {"a": ["idiot"], "b": ["clown"]}, f"{_PAIR}a union {_PAIR}b", None),
    ("search_not", "idiot NOT clown", {"a": ["idiot"], "b": ["clown"]}, f"{_PAIR}a except {_PAIR}b", ["a"]),
    ("search_phrase", '"of the"', {"a": ["of", "the"]}, f"{_PAIR}a", None),
    ("search_prefix", "licen*", {"a": ["licen*"]}, f"{_PAIR}a", None),
    ("search_mixed", '("of the" OR licensed) NOT was', {"a": ["of", "the"], "b": ["licensed"], "c": ["was"]},
     f"({_PAIR}a union {_PAIR}b) except {_PAIR}c", ["a", "b"]),
]:
    QUERIES[_name] = lambda s, d, q=_query: _top(_hits(s, d, q))
    ORACLE_SQL[_name] = search_sql(_phrases, _match, _scored) + _TOP_SQL


_CLOSE = "tk x join tk y using (doc_id, page_number) where x.term = 'was' and y.term = 'for' and greatest(x.pos, y.pos) - least(x.pos, y.pos) - 1 <= 3"
QUERIES["search_near"] = lambda s, d: _top(_hits(s, d, "NEAR(was for, 3)"))
ORACLE_SQL["search_near"] = search_sql(
    {"a": ["was"], "b": ["for"]}, f"select distinct x.doc_id, x.page_number from {_CLOSE}",
    near={n: f"select doc_id, page_number, 10.0 * count(*) as f from (select distinct doc_id, page_number, {t}.pos from {_CLOSE}) group by all" for n, t in (("a", "x"), ("b", "y"))}) + _TOP_SQL


def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and pages of each term."""
    return search.postings(pages(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id", "page_number").alias("n_pages"))


QUERIES["term_freq"] = term_freq
ORACLE_SQL["term_freq"] = f"with {INDEX} select term, count(*) as n, count(distinct (doc_id, page_number)) as n_pages from tk group by term"


def _provenance(pages_: DataFrame) -> DataFrame:
    """A recovered text for every third page: its last line; a sixth of the pages have nothing else."""
    key = F.col("doc_id") + F.col("page_number")
    last = F.element_at(tx.lines(F.col("text")), -1)
    return pages_.filter(key % 3 == 0).select(
        "doc_id", "page_number", F.when(key % 6 == 0, F.lit(0)).otherwise(F.length("text")).cast("long").alias("embedded_chars"),
        F.length(last).cast("long").alias("ocr_chars"), (F.lit(0.5) + (F.col("doc_id") % 50) / 100.0).alias("ocr_confidence"), last.alias("ocr_text"))


_PROVENANCE = """prov as (
  select doc_id, page_number, case when (doc_id + page_number) % 6 = 0 then 0 else length(text) end as embedded_chars,
         length(string_split(text, chr(10))[-1]) as ocr_chars, 0.5 + (doc_id % 50) / 100.0 as ocr_confidence, string_split(text, chr(10))[-1] as ocr_text
  from dp where (doc_id + page_number) % 3 = 0)"""


def search_join_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits beside their file (inner) and the page's provenance (left): page source, confidence and label."""
    p = index(spark, sf_dir).pages
    hits = _hits(spark, sf_dir, '"of the"').join(p, ["doc_id", "page_number"]).drop("text").join(_provenance(p), ["doc_id", "page_number"], "left")
    source = search.page_source(F.col("embedded_chars"), F.col("ocr_text"))
    return hits.select("path", "page_number", F.round("score", 6).alias("score"), source.alias("page_source"),
                       search.source_label(source, F.col("ocr_confidence")).alias("label"))


QUERIES["search_join_provenance"] = search_join_provenance
ORACLE_SQL["search_join_provenance"] = search_sql({"a": ["of", "the"]}, f"{_PAIR}a", extra=f""",
 {LIBRARY}, {_PROVENANCE},
 j as (select path, page_number, score, ocr_confidence, case when ocr_text is null then 'Embedded' when embedded_chars > 0 then 'Mixed' else 'Ocr' end as page_source
       from hits join library using (doc_id) left join prov using (doc_id, page_number))
select path, page_number, round(score, 6) as score, page_source,
       case page_source when 'Ocr' then 'OCR ' || cast(round_even(ocr_confidence * 100, 0) as integer) || '%'
            when 'Mixed' then 'part OCR ' || cast(round_even(ocr_confidence * 100, 0) as integer) || '%' else '' end as label from j""")


def _window_hits(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    p = index(spark, sf_dir).pages
    top = _hits(spark, sf_dir, query).withColumn("score", F.round("score", 9)).orderBy("score", "doc_id", "page_number").limit(search.window_size(10))
    found = top.join(p, ["doc_id", "page_number"])
    return found.join(_provenance(p).select("doc_id", "page_number", F.col("ocr_text").alias("recovered"), "embedded_chars"), ["doc_id", "page_number"], "left")


def search_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-ranked window of a bare term, with a model hint: multipliers for model, label line and recovered text."""
    hits = search.rerank(_window_hits(spark, sf_dir, "idiot"), "idiot", "src1")
    return hits.select("doc_id", "page_number", "match_source", F.round("multiplier", 6).alias("multiplier"), F.round("biased", 6).alias("score"))


_SOURCE_SQL = """case when ocr_text is null or ocr_text = '' then 'Embedded'
 when {o} > 0 and {f} > {o} then 'Mixed' when {o} > 0 then 'Ocr' else 'Embedded' end"""


def _count_sql(column: str, term: str) -> str:
    return f"((length(lower({column})) - length(replace(lower({column}), '{term}', ''))) // {len(term)})"


_RERANK = search_sql({"a": ["idiot"]}, f"{_PAIR}a", extra=f""",
 {LIBRARY}, {_PROVENANCE},
 top as (select doc_id, page_number, round(score, 9) as score from hits order by round(score, 9), doc_id, page_number limit 600),
 j as (select doc_id, page_number, score, text, title, path, content_hash, ocr_text, {_SOURCE_SQL.format(o=_count_sql('ocr_text', 'idiot'), f=_count_sql('text', 'idiot'))} as match_source
       from top join dp using (doc_id, page_number) join library using (doc_id) left join prov using (doc_id, page_number)),
 r as (select *, (case when contains(title, 'src1') or contains(split_part(path, '/', 2), 'src1') then 1.5 else 1.0 end)
   * (case when len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x, '{tx.BLANKS}')) between 1 and 13 and contains(lower(x), 'idiot'))) > 0 then 1.4 else 1.0 end)
   * (case when match_source = 'Ocr' then 1.4 else 1.0 end) as multiplier from j)""")
QUERIES["search_rerank"] = search_rerank
ORACLE_SQL["search_rerank"] = _RERANK + "\nselect doc_id, page_number, match_source, round(multiplier, 6) as multiplier, round(score * multiplier, 6) as score from r"


def search_fold_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same window folded: one hit for each content hash and page, with its other paths."""
    hits = search.rerank(_window_hits(spark, sf_dir, "idiot"), "idiot", "src1")
    kept = search.fold_duplicates(hits, ["biased", "bm25_rank"])
    return kept.select("path", "page_number", F.round("biased", 6).alias("score"), F.array_join("also_at", ",").alias("also_at"))


QUERIES["search_fold_duplicates"] = search_fold_duplicates
ORACLE_SQL["search_fold_duplicates"] = _RERANK + """,
 o as (select *, score * multiplier as biased, row_number() over (order by score, doc_id, page_number) as bm25_rank from r),
 g as (select content_hash, page_number, list(path order by biased, bm25_rank) as paths, min_by(round(biased, 6), struct_pack(biased, bm25_rank)) as score from o group by all)
select paths[1] as path, page_number, score, array_to_string(paths[2:], ',') as also_at from g"""


def search_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search for a bare term with a model hint: window, biases, copies folded, ten hits."""
    p = index(spark, sf_dir).pages
    held = p.join(_provenance(p).select("doc_id", "page_number", F.col("ocr_text").alias("recovered"), "embedded_chars"), ["doc_id", "page_number"], "left")
    hits = search.search(held, index(spark, sf_dir), "idiot", model="src1")
    return hits.select("rank", "path", "title", "page_number", F.round("score", 6).alias("score"), "match_source", "page_source", F.array_join("also_at", ",").alias("also_at"))


QUERIES["search_whole"] = search_whole
ORACLE_SQL["search_whole"] = _RERANK.replace("ocr_text, case", "ocr_text, embedded_chars, case") + """,
 o as (select *, score * multiplier as biased, row_number() over (order by score, doc_id, page_number) as bm25_rank,
   case when ocr_text is null then 'Embedded' when embedded_chars > 0 then 'Mixed' else 'Ocr' end as page_source from r),
 g as (select *, row_number() over (partition by content_hash, page_number order by biased, bm25_rank) as nth, list(path) over (partition by content_hash, page_number order by biased, bm25_rank rows between unbounded preceding and unbounded following) as paths from o)
select row_number() over (order by biased, bm25_rank) as rank, path, title, page_number, round(biased, 6) as score, match_source, page_source, array_to_string(paths[2:], ',') as also_at
from g where nth = 1 qualify rank <= 10"""
QUERIES["search_files_only"] = lambda s, d: files.files_only(search_whole(s, d)).select("path", "rank")
ORACLE_SQL["search_files_only"] = "select path, min(rank) as rank from (" + ORACLE_SQL["search_whole"] + ") group by path"


def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first fifty hits of two phrases show. The snippets are held against SQLite's in a test."""
    node, _ = qy.read('"of the" OR licensed')
    top = search.bm25(index(spark, sf_dir), node).withColumn("score", F.round("score", 9)).orderBy("score", "doc_id", "page_number").limit(50)
    return top.join(index(spark, sf_dir).pages, ["doc_id", "page_number"]).select("doc_id", "page_number", snippet_column(F.col("text"), node).alias("snippet"))


QUERIES["search_snippets"] = search_snippets


def search_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of a search, read again: its version, its hits, and a caveat."""
    text = files.search_json(search_whole(spark, sf_dir), {"audit": "none"})
    row = spark.createDataFrame([(text,)], "json string")
    hits = F.from_json(F.get_json_object("json", "$.results"), "array<struct<rank:int,path:string>>")
    return row.select(F.get_json_object("json", "$.schemaVersion").cast("int").alias("version"), F.array_join(hits["path"], ",").alias("paths"), F.get_json_object("json", "$.caveats.audit").alias("caveat"))


QUERIES["search_json"] = search_json
ORACLE_SQL["search_json"] = "select 1 as version, string_agg(path, ',' order by rank) as paths, 'none' as caveat from (" + ORACLE_SQL["search_whole"] + ")"

#: Typed queries, and what each is read as: the expression, whether it was typed as one, whether it is a bare term, its terms and mnemonics, and whether it had to be read as plain words.
_TYPED = [
    ("SOURce:POWer {LOW|HIGH}", '"SOURce" AND "POWer" AND ("LOW" OR "HIGH")', False, False, "SOURce POWer LOW HIGH", "SOURce POWer", False),
    ('"quiet sea" tide', '"quiet sea" AND "tide"', False, False, "quiet sea tide", "", False), ("ab-cd", '"ab-cd"', False, True, "ab cd", "", False),
    ("storm*", "storm*", True, False, "storm", "", False), ("gale OR calm", "gale OR calm", True, False, "gale calm", "", False), ("--", None, False, True, "", "", False),
    ("wave AND (foam", "wave AND (foam", True, False, "wave foam", "", True), ("10 MHz", '"10" AND "MHz"', False, False, "10 MHz", "", False), ("", None, False, False, "", "", False),
]


def typed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How typed queries are read."""
    rows = [(q, qy.prepare(q), qy.looks_like_expression(q), qy.is_bare_term(q), " ".join(qy.terms(q)), " ".join(qy.mnemonics(q)), qy.read(q)[1] is not None) for q, *_ in _TYPED]
    return spark.createDataFrame(rows, "query string, prepared string, expression boolean, bare boolean, terms string, mnemonics string, as_words boolean")


QUERIES["typed_queries"] = typed_queries
ORACLE_SQL["typed_queries"] = "select * from (values " + ", ".join(
    "(" + ", ".join("null" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v + "'" for v in row) + ")" for row in _TYPED) + ") v(query, prepared, expression, bare, terms, mnemonics, as_words)"


def search_notation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window re-ranked for a typed command: pages that spell its mnemonic as typed (every second one is made to) count for more."""
    node, _ = qy.read("was AND for")
    top = search.bm25(index(spark, sf_dir), node).withColumn("score", F.round("score", 9)).orderBy("score", "doc_id", "page_number").limit(search.window_size(10))
    spelled = F.when((F.col("doc_id") + F.col("page_number")) % 2 == 0, F.concat(F.lit("SOURce "), "text")).otherwise(F.col("text"))
    hits = top.join(index(spark, sf_dir).pages, search.PAGE).withColumn("text", spelled).withColumn("recovered", F.lit(""))
    return search.rerank(hits, ":SOURce").select("doc_id", "page_number", F.round("multiplier", 6).alias("multiplier"))


QUERIES["search_notation"] = search_notation
ORACLE_SQL["search_notation"] = search_sql({"a": ["was"], "b": ["for"]}, f"{_PAIR}a intersect {_PAIR}b") + f""",
 top as (select doc_id, page_number, text from (select * from hits order by round(score, 9), doc_id, page_number limit 600) join dp using (doc_id, page_number)),
 m as (select *, (doc_id + page_number) % 2 = 0 as spelled, string_split(case when (doc_id + page_number) % 2 = 0 then 'SOURce ' || text else text end, chr(10)) as rows from top)
select doc_id, page_number, (case when spelled or contains(text, 'SOURce') then 1.4 else 1.0 end) * (case when len(list_filter(rows, lambda x: length(trim(x, '{tx.BLANKS}')) between 1 and 14 and contains(lower(x), 'source'))) > 0 then 1.4 else 1.0 end) as multiplier from m"""


def best_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve files with the best page for a query."""
    hits = _hits(spark, sf_dir, "was").withColumn("score", F.round("score", 6))
    return search.best_files(hits)


QUERIES["best_files"] = best_files
ORACLE_SQL["best_files"] = search_sql({"a": ["was"]}, f"{_PAIR}a") + """
select doc_id, count(*) as hits, min(round(score, 6)) as best from hits group by doc_id order by best, doc_id limit 12"""


def label_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that carry a term on a line of its own."""
    return pages(spark, sf_dir).filter(tx.carries_label(F.col("text"), ["this", "der", "with"])).select("doc_id", "page_number")


QUERIES["label_pages"] = label_pages
ORACLE_SQL["label_pages"] = f"""with {DP} select doc_id, page_number from dp
where len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x, '{tx.BLANKS}')) between 1 and 12 and (contains(lower(x), 'this') or contains(lower(x), 'with')))) > 0"""


def match_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pages hold two terms: in the embedded text, the recovered, or both."""
    p = pages(spark, sf_dir)
    both = p.join(_provenance(p), ["doc_id", "page_number"], "left")
    return both.select("doc_id", "page_number", tx.match_source(["was", "that"], F.col("text"), F.col("ocr_text")).alias("match_source"))


QUERIES["match_source"] = match_source
_O, _F = [[_count_sql(c, t) for t in ("was", "that")] for c in ("ocr_text", "text")]
ORACLE_SQL["match_source"] = f"""with {DP}, {_PROVENANCE}
select doc_id, page_number, case when ocr_text is null or ocr_text = '' then 'Embedded'
  when ({_O[0]} > 0 or {_O[1]} > 0) and ({_F[0]} > {_O[0]} or {_F[1]} > {_O[1]}) then 'Mixed'
  when {_O[0]} > 0 or {_O[1]} > 0 then 'Ocr' else 'Embedded' end as match_source
from dp left join prov using (doc_id, page_number)"""


def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, pages, terms, and pages without text, of the index."""
    held = index(spark, sf_dir)
    blank = F.col("n_tokens").isNull()
    counts = held.pages.select("doc_id", "page_number").join(held.stats, search.PAGE, "left").agg(
        F.countDistinct("doc_id").alias("documents"), F.count(F.when(~blank, 1)).alias("pages"), F.count(F.when(blank, 1)).alias("blank_pages"))
    return counts.crossJoin(held.terms.agg(F.count("*").alias("terms"), F.sum("n").alias("tokens")))  # one row each


QUERIES["index_statistics"] = index_statistics
ORACLE_SQL["index_statistics"] = f"""with {INDEX} select (select count(distinct doc_id) from dp) as documents, (select count(*) from st) as pages,
 (select count(*) from dp where not regexp_matches(text, '[^{tx.BLANK}]')) as blank_pages, count(distinct term) as terms, count(*) as tokens from tk"""


def documents_without_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files none of whose pages has any text in the index, newest first."""
    said = index(spark, sf_dir).stats.select("doc_id").distinct()
    return library(spark, sf_dir).select("doc_id", "path").join(said, "doc_id", "left_anti").orderBy(F.desc("doc_id"))


QUERIES["documents_without_text"] = documents_without_text
ORACLE_SQL["documents_without_text"] = f"""with {DP}, {LIBRARY} select doc_id, path from library
where doc_id not in (select doc_id from dp where length(trim(text, '{tx.BLANKS}')) > 0)"""


def read_page_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 2 of every document with a page before and after, text and then what was recovered."""
    p = pages(spark, sf_dir)
    near = p.filter(F.col("page_number").between(2 - 1, 2 + 1)).join(_provenance(p).select("doc_id", "page_number", "ocr_text"), ["doc_id", "page_number"], "left")
    return near.select("doc_id", "page_number", F.concat_ws("\n\n", "text", "ocr_text").alias("shown"))


QUERIES["read_page_context"] = read_page_context
ORACLE_SQL["read_page_context"] = f"""with {DP}, {_PROVENANCE} select doc_id, page_number, concat_ws(chr(10) || chr(10), text, ocr_text) as shown
from dp left join prov using (doc_id, page_number) where page_number between 1 and 3"""


def miss_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to say where a word is not found, asked of each source for one rare term: found; unproven without an audit; not an
    absence while pages are outstanding, the five worst documents named; else an absence.

    Sources with an odd number of documents count as not audited; a document of a length divisible by 5 has outstanding pages.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("source is not null")
    node, _ = qy.read("worthless")
    found = search.matching(index(spark, sf_dir), node).select("doc_id").distinct().join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("hits"))
    audited = docs.groupBy("source").agg((F.count("*") % 2 == 0).alias("audited"))
    open_ = docs.filter("n_chars % 5 = 0").select("source", F.col("doc_id").cast("string").alias("path"), (F.col("n_chars") % 7 + 1).alias("outstanding"), F.col("n_chars").alias("recoverable"))
    return audit.miss_advice(audited.join(found, "source", "left").withColumn("hits", F.coalesce("hits", F.lit(0))), open_, "source")


QUERIES["miss_advice"] = miss_advice
ORACLE_SQL["miss_advice"] = f"""with {INDEX}, a as (select source, count(*) % 2 = 0 as audited from documents where source is not null group by source),
 h as (select source, count(distinct doc_id) as hits from documents semi join (select distinct doc_id from tk where term = 'worthless') t using (doc_id) group by source),
 o as (select source, doc_id::varchar as path, n_chars % 7 + 1 as outstanding, n_chars from documents where n_chars % 5 = 0),
 w as (select source, sum(outstanding) as outstanding, array_to_string((list(path order by n_chars desc, outstanding desc, path))[1:5], ',') as worst from o group by source)
select a.source, coalesce(hits, 0) as hits, case when coalesce(hits, 0) > 0 then 'found' when not audited then 'unproven' when coalesce(outstanding, 0) > 0 then 'outstanding' else 'absent' end as advice,
 case when coalesce(hits, 0) = 0 and audited then coalesce(outstanding, 0) else 0 end as outstanding, case when coalesce(hits, 0) = 0 and audited and outstanding > 0 then worst else '' end as worst
from a left join h using (source) left join w using (source)"""


def rarest_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rarest word of seven letters or more of each page, then the longest, then the first by name."""
    held = index(spark, sf_dir)
    found = held.postings.filter(F.length("term") >= 7).select("doc_id", "page_number", "term").distinct()
    rarest = F.min(F.struct("n_pages", (-F.length("term")).alias("size"), "term")).alias("r")
    return found.join(held.terms.select("term", "n_pages"), "term").groupBy("doc_id", "page_number").agg(rarest).select("doc_id", "page_number", "r.term", "r.n_pages")


QUERIES["rarest_term"] = rarest_term
ORACLE_SQL["rarest_term"] = f"""with {INDEX}, f as (select distinct doc_id, page_number, term from tk where length(term) >= 7),
 h as (select term, count(*) as n from f group by term)
select doc_id, page_number, term, n as n_pages from f join h using (term)
qualify row_number() over (partition by doc_id, page_number order by n, length(term) desc, term) = 1"""
