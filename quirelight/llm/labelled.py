"""Bounded samples of labelled documents, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(doc_id: Column, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


#: Bytes of a text that a model learns from at most; a longer one is left out of the sample (never of a scan).
LONGEST = 131_072


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int, longest: int = LONGEST) -> tuple[list[tuple[str, int]], float]:
    """((text, 0 or 1) of at most ``most`` documents of each class, share of class 1 among all labels).

    Documents of the held-out fold are left out; of the others, those with the least hashed ids are
    taken, so the choice does not depend on the input's order or partitions. An id that several rows
    share gives one text, the least that is not too long. So at most 2 * most rows, of ``longest`` bytes
    each, come to the driver. Labels that are null or neither 0 nor 1 are left out, a null text is empty.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    known = known.filter(fold_of(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    ones, total = known.agg(F.sum("label"), F.count("*")).first()
    chosen = None
    for kind in (0, 1):
        some = known.filter(F.col("label") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = some if chosen is None else chosen.union(some)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).filter(F.octet_length("text") <= longest)
    # at most 2 * most ids: small enough to send to every scan
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    found = sorted((r["doc_id"], r["text"], r["label"]) for r in rows.collect())
    return [(text, kind) for _, text, kind in found], (ones or 0) / total if total else 0.5
