"""What several queries share: tables derived from the driver's, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import search
from ..plans.storage import Scratch
from ..plans.tables import exists, read, stamp


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_number, text: documents cut into pages of eight lines."""
    return search.derived_pages(read(spark, sf_dir, "documents", "doc_id", "text"))


_WRITTEN: dict[tuple[str, str], tuple[tuple, str]] = {}


def index(spark: SparkSession, sf_dir: str) -> search.Index:
    """The index of ``pages``, with the file each is of, written once a session for as long as the documents stay as they are."""
    key, now = (spark.sparkContext.applicationId, sf_dir), stamp(spark, f"{sf_dir}/documents.parquet")
    known = _WRITTEN.get(key)
    if known is None or known[0] != now or not exists(spark, f"{known[1]}/totals/_SUCCESS"):
        folder = Scratch(spark, "index").path("pages-of-eight-lines")
        # a shard of 64 takes another task for each 64 files of documents
        docs = _as_files(read(spark, sf_dir, "documents", "doc_id", "text", "source"))
        search.write_index(search.derived_pages(docs, keep=FILE), folder, min(64, 1 + now[0] // search.SHARDS))
        _WRITTEN[key] = known = (now, folder)
    return search.read_index(spark, known[1])


#: A word is common if it is one of so many commonest terms of the corpus, made of letters only.
COMMON = 300


def common_words(spark: SparkSession, sf_dir: str) -> list[str]:
    """The ``COMMON`` commonest terms of letters only, of two letters or more; ties by name."""
    found = index(spark, sf_dir).terms.filter(F.col("term").rlike(r"^\p{L}{2,}$"))
    return [r["term"] for r in found.orderBy(F.desc("n"), "term").limit(COMMON).collect()]


FILE = ["path", "title", "content_hash"]


def _as_files(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"path": F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))),
                             "title": F.concat_ws(" ", F.lit("Manual"), "source"), "content_hash": F.upper(F.sha2("text", 256))})


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a library: path, title, content_hash beside doc_id; the path is source/doc_id.pdf."""
    return _as_files(table(spark, sf_dir, "documents")).select("doc_id", *FILE)


DP = """dp as (
  select doc_id, cast(i // 8 + 1 as integer) as page_number, string_agg(line, chr(10) order by i) as text
  from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents)
  group by doc_id, i // 8)"""

LIBRARY = """library as (
  select doc_id, source || '/' || doc_id || '.pdf' as path, 'Manual ' || source as title, upper(sha256(text)) as content_hash from documents)"""

INDEX = DP + r""",
 toks as (select doc_id, page_number, text, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+') as t from dp),
 tk as (select doc_id, page_number, unnest(t) as term, generate_subscripts(t, 1) - 1 as pos from toks),
 st as (select doc_id, page_number, len(t) as n_tokens from toks where regexp_matches(text, '[^""" + tx.BLANK + r"""]')),
 const as (select count(*) as pages, avg(n_tokens) as mean from st)"""


def phrase_sql(name: str, words: list[str]) -> str:
    """A common table of the pages that hold a phrase and its weighed count; a last word ending in * is a beginning."""
    test = lambda i, w: f"t{i}.term like '{w[:-1]}%'" if w.endswith("*") else f"t{i}.term = '{w}'"
    joins = "".join(f" join tk t{i} on t{i}.doc_id = t0.doc_id and t{i}.page_number = t0.page_number and t{i}.pos = t0.pos + {i}" for i in range(1, len(words)))
    return f"{name} as (select t0.doc_id, t0.page_number, 10.0 * count(*) as f from tk t0{joins} where {' and '.join(test(i, w) for i, w in enumerate(words))} group by all)"


def search_sql(phrases: dict[str, list[str]], match: str, scored: list[str] | None = None, extra: str = "", near: dict[str, str] | None = None) -> str:
    """Common tables up to ``hits`` (doc_id, page_number, score): phrases by name, and the SQL of the pages that match; near: SQL of the occurrences that count, where not all do."""
    parts = [INDEX, *(phrase_sql(n, w) for n, w in phrases.items())]
    scores = []
    for n, sql in (near or {}).items():
        parts.append(f"{n}_near as ({sql})")
    for n in scored or list(phrases):
        f = f"{n}_near" if near else n
        scores.append(
            f"select {f}.doc_id, {f}.page_number, -(case when ln((pages - k + 0.5) / (k + 0.5)) > 0 then ln((pages - k + 0.5) / (k + 0.5)) else 1e-6 end)"
            f" * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n_tokens / mean)) as s from {f} join st using (doc_id, page_number), const, (select count(*) as k from {n})")
    parts += [f"matched as ({match})", "scores as (" + " union all ".join(scores) + ")",
              "hits as (select doc_id, page_number, sum(s) as score from scores semi join matched using (doc_id, page_number) group by all)"]
    return "with " + ",\n ".join(parts) + extra


#: The commonest terms, in SQL; after ``INDEX``.
COMMON_SQL = rf"cw as (select term from tk where regexp_full_match(term, '\p{{L}}{{2,}}') group by term order by count(*) desc, term limit {COMMON})"
