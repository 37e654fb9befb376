"""SpotSigs fingerprints: chains of content words behind common-word anchors, and near pairs of them.

Words are runs of letters and digits, lower-cased. Words of a fixed list are anchors; the others are
content. Each anchor makes a signature of itself and the next ``CHAIN`` content words (anchors in
between skipped), hashed to 32 bits. Tables and lists have no common words, so a content word behind
``BARE`` content words in a row is anchored by the empty word. A text with words but without any
signature has one: its whole word sequence. The fingerprint is the set of signatures; the likeness of
two is their Jaccard similarity, 1 for two empty sets.

Pairs: documents with equal sets form a class. Sets are dealt to partitions by length, in steps of
1/threshold, so that a set meets only its own partition and the next; within those, two sets can be
near only if they share one of their first len - ceil(threshold * len) + 1 signatures in an order common
to all sets, and their lengths allow the threshold; those candidates are compared on the whole sets. The
order is by how often a signature's cell (one of ``CELLS``) is hit, rarest first, so that what many
documents share is seldom met. A signature that many classes meet at is split over tasks.

Defined cases: a null or empty text has the empty set and is in no class; a very long text is one row, its
arrays as long as it has words; other columns of any name are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.ordering import in_order, with_row_number
from ..plans.storage import Scratch
from ..plans.tables import read

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from has have in is it not of on or that the this to was were which with "
    "au aus aux avec auf bei con das dans de del dem den der des die du ein eine el en est et für il im ist "
    "la las le les lo los mit ne nicht no ou par para pas por pour que qui se sich son su sur un una une und "
    "von y zu"
).split()
CHAIN = 3
BARE = 8
THRESHOLD = 0.8
#: Cells whose hits are counted over all classes, whatever their number; one byte each goes with the plan.
CELLS = 1 << 16
MEETING = 512  # classes of one length partition and signature that meet in one task


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def with_signatures(df: DataFrame, text: str, into: str) -> DataFrame:
    """Adds ``into``, the ascending array of distinct 32-bit signatures of column ``text``; null counts as empty."""
    words, content = F.col(f"{into}_words"), F.col(f"{into}_content")

    def of_word(x: Column, j: Column) -> Column:
        chain = [x["w"], *(F.get(content, j + k)["w"] for k in range(1, CHAIN))]
        before = F.coalesce(F.get(content, j - 1)["at"], F.lit(-1))
        anchored = F.transform(F.slice(words, before + 2, x["at"] - before - 1), lambda a: F.hash(a, *chain))
        bare = F.when(F.get(content, j - BARE)["at"] == x["at"] - BARE, F.array(F.hash(F.lit(""), *chain))).otherwise(F.array().cast("array<int>"))
        whole = j + CHAIN <= F.size(content)
        return F.when(whole & (x["at"] - before > 1), anchored).when(whole, bare).otherwise(F.array().cast("array<int>"))

    found = F.col(f"{into}_found")
    return (
        df.withColumn(f"{into}_words", words_of(F.coalesce(F.col(text), F.lit(""))))
        .withColumn(f"{into}_content", F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda x: ~x["w"].isin(ANCHORS)))
        .withColumn(f"{into}_found", F.array_sort(F.array_distinct(F.flatten(F.transform(content, of_word)))))
        .withColumn(into, F.when((F.size(found) == 0) & (F.size(words) > 0), F.array(F.hash(F.array_join(words, " ")))).otherwise(found))
        .drop(f"{into}_words", f"{into}_content", f"{into}_found")
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature arrays; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def length_partition(n: Column, threshold: float = THRESHOLD) -> Column:
    """Sets whose lengths could reach the threshold lie in the same partition or in neighbouring ones."""
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / F.lit(math.log(1 / threshold)) + F.lit(1e-9))).otherwise(F.lit(-1)).cast("int")


def _cell(signature: Column) -> Column:
    return F.pmod(F.xxhash64(signature), F.lit(CELLS)).cast("int")


def _heads(classes: DataFrame, threshold: float) -> DataFrame:
    """class_id, n, lot, spot: the signatures of each class by which near ones must meet it."""
    hits = classes.select(F.explode("signatures").alias("spot")).groupBy(_cell(F.col("spot")).alias("cell")).agg(F.count("*").alias("n"))
    weight = bytearray(CELLS)  # an eighth of a power of two a step
    for r in hits.collect():  # at most CELLS rows
        weight[r["cell"]] = min(255, int(8 * math.log2(r["n"])))
    often = lambda x: F.hex(F.substring(F.lit(bytes(weight)), _cell(x) + 1, F.lit(1)))
    ordered = F.array_sort(F.transform("signatures", lambda x: F.struct(often(x).alias("often"), F.xxhash64(x).alias("h"), x.alias("spot"))))
    # the margin keeps a rounding error from shortening the prefix
    needed = (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int")
    return classes.select("class_id", "n", "lot", F.explode(F.transform(F.slice(ordered, F.lit(1), needed), lambda x: x["spot"])).alias("spot"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of docs(doc_id, signatures) as ``with_signatures`` makes them.

    members: doc_id, class_id (the smallest doc_id with the same set). pairs: class_a < class_b and
    likeness >= threshold. Documents with an empty or null set are members of no class (null) and in
    no pair; repeated rows are members twice; a null doc_id is a member of its set's class, and names
    it (as a class_id of null, in no pair) only if all are null.
    """
    scratch = Scratch(docs.sparkSession, "spots")
    keyed = scratch.save(docs.select("doc_id", F.coalesce("signatures", F.array().cast("array<int>")).alias("signatures"),
                                     F.md5(F.array_join(F.col("signatures").cast("array<string>"), ",")).alias("key")), "keyed")
    full = keyed.filter(F.size("signatures") > 0)
    ids = scratch.save(full.groupBy("key").agg(F.min("doc_id").alias("class_id")), "ids")
    members = keyed.select("doc_id", "key").join(ids, "key", "left").select("doc_id", "class_id")
    named = full.join(ids, "key").filter(F.col("doc_id") == F.col("class_id")).dropDuplicates(["key"]).select("class_id", "signatures")
    classes = scratch.save(named.withColumn("n", F.size("signatures")).withColumn("lot", length_partition(F.col("n"), threshold)), "classes")
    heads = scratch.save(_heads(classes, threshold), "heads")
    meeting = scratch.save(heads.groupBy("lot", "spot").agg(F.ceil(F.count("*") / MEETING).cast("int").alias("parts")), "meeting")
    left = heads.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "spot", F.explode(F.array("lot", F.col("lot") + 1)).alias("lot"), F.col("lot").alias("own"))
    left = left.join(meeting, ["lot", "spot"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = heads.join(meeting, ["lot", "spot"]).select(
        F.col("class_id").alias("b"), F.col("n").alias("nb"), "spot", "lot", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int").alias("part"))
    met = left.join(right, ["lot", "spot", "part"]).filter((F.col("own") < F.col("lot")) | (F.col("a") < F.col("b")))
    met = scratch.save(met.filter(F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9).select("a", "b").distinct(), "met")
    sets = classes.select("class_id", "signatures")
    compared = (met.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
                .withColumn("likeness", likeness(F.col("sa"), F.col("sb"))).filter(F.col("likeness") >= threshold))
    return members, compared.select(F.least("a", "b").alias("class_a"), F.greatest("a", "b").alias("class_b"), "likeness")


def near_documents(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links (other classes near its own) for each row of docs(doc_id, text)."""
    signed = with_signatures(docs.select("doc_id", "text"), "text", "signatures").select("doc_id", "signatures")
    members, pairs = near_classes(signed, threshold)
    ends = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(ends, "class_id", "left").select("doc_id", "class_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def spotsigs_near_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal fingerprints over all documents, and how many other classes each is near to."""
    return near_documents(read(spark, sf_dir, "documents", "doc_id", "text"))


def with_next(docs: DataFrame) -> DataFrame:
    """Each document beside the next by ascending doc_id, the last beside the first.

    docs(doc_id, text) -> doc_id, text, n_chars, signatures, next_head (as many code points as a
    quarter of this text has, or all), next_signatures. A null text is empty, a null doc_id comes
    before all others; rows that share an id follow by length and hash; rows equal in both columns
    stand at one place of the order and each gets its row. A lone document is its own next.

    The order is found on ids, lengths and hashes. Whole texts and their signatures, which are made once,
    move to meet their places; after that a document sends its predecessor only the head that is asked for,
    and its signatures.
    """
    scratch = Scratch(docs.sparkSession, "spots")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("long").alias("k"),
                        F.xxhash64(text, F.col("doc_id").isNull()).alias("h"))
    places = in_order(scratch.save(keyed.select("k", F.length("text").alias("n"), "h", "doc_id").distinct(), "keys"), ["k", "n", "h"], scratch, "placed")
    numbered = scratch.save(with_row_number(places).select("k", "n", "h", "doc_id", "row_number"), "numbered")
    count = max(numbered.count(), 1)
    before = numbered.select(F.col("k").alias("to_k"), F.col("h").alias("to_h"), F.floor(F.col("n") / 4).cast("int").alias("asked"),
                             F.pmod(F.col("row_number") + 1, F.lit(count)).alias("row_number"))
    order = scratch.save(numbered.join(before, "row_number").select("k", "h", "n", "doc_id", "to_k", "to_h", "asked"), "order")
    # both uses below read the same columns of the texts, so that they share one exchange, behind the signatures
    held = with_signatures(keyed.select("k", "h", "text"), "text", "signatures").join(order, ["k", "h"])
    own = held.select("k", "h", "doc_id", "text", F.col("n").cast("long").alias("n_chars"), "signatures")
    sent = held.select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), F.substring(F.col("text"), F.lit(1), F.col("asked")).alias("next_head"), F.col("signatures").alias("next_signatures"))
    sent = sent.groupBy("k", "h").agg(F.first(F.struct("next_head", "next_signatures")).alias("s")).select("k", "h", "s.next_head", "s.next_signatures")
    return own.join(sent, ["k", "h"]).drop("k", "h")


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, with likeness to the edit and to the next document.

    fingerprint: the signatures, ascending, as decimal numbers joined by commas.
    """
    docs = with_next(read(spark, sf_dir, "documents", "doc_id", "text"))
    kept = F.col("n_chars") - F.floor(F.col("n_chars") / 4)
    docs = docs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), kept.cast("int")), F.col("next_head"))).drop("text", "next_head")
    docs = docs.withColumn("edited_sha256", F.sha2("edited", 256))
    docs = with_signatures(docs, "edited", "edited_signatures")
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return docs.select(
        "doc_id", "n_chars", "edited_sha256",
        joined("signatures").alias("fingerprint"), joined("edited_signatures").alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
        length_partition(F.size("signatures")).alias("length_partition"),
    )
