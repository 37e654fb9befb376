"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Targets: sources, by code point with null last, weigh 5, 2, 1, 5, 2, 1, ... and share ``epochs``
(1.5) times all words; no source gives more than ``repeats`` (2) times its own words, and what is
cut off is shared anew by weight. That fixed point is target = min(repeats * size, level * weight),
and one sort of the sources by repeats * size / weight finds the level.

Schedule: the mix is a row of slots of ``block`` words each. Slot k lies at the golden-ratio point
frac(k * phi), taken in 31-bit integers; the point falls into one source's stretch of the
cumulative targets. A slot's rank among its source's slots names the block it takes from that
source: the source's documents, in a shuffled order, stand in one line of words, repeated
``repeats`` times, cut into blocks of equal words. Then each source's slots are settled to its target,
the last block cut to the words that remain, so that no source is lost. Any prefix of the mix is near its targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.ordering import in_order, with_running_sum
from ..plans.storage import Scratch
from .rows import named, packed, row_hashes

WEIGHTS = (5, 2, 1)
GOLDEN = 1_327_217_885  # odd, about 2**31 / 1.618
MODULUS = 1 << 31
MIX = 1_540_483_477
#: A slot has at most this many words, and there are at least this many slots (or one a word).
BLOCK_WORDS, LEAST_SLOTS = 4_096, 65_536
CELLS = 1_024
RUN = 8_192  # consecutive slots ranked together


def words_in(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def shuffled_key(doc_id: Column) -> Column:
    """A fixed 31-bit scramble of an id, the same in SQL."""
    t = (F.pmod(F.coalesce(doc_id.cast("long"), F.lit(-1)), F.lit(MODULUS)) * F.lit(MIX) + F.lit(12_345)) % F.lit(MODULUS)
    return t.bitwiseXOR(F.shiftright(t, 16))


def source_targets(sizes: DataFrame, epochs: float = 1.5, repeats: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row a source (source, source_size) with its rank, weight and target added."""
    all_rows = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("ratio", "rank")
    before, onward = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("wanted") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    return (
        sizes.withColumn("rank", rank).withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * repeats)
        .withColumn("wanted", F.lit(float(epochs)) * F.sum("source_size").over(all_rows))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level_here", level)
        .withColumn("level", F.max(F.when(F.col("ratio") > F.col("level_here"), F.col("level_here"))).over(all_rows))
        .withColumn("target", F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap").cast("double"))
                    .otherwise(F.col("level") * F.col("weight")))
        .select("source", "source_size", "rank", "weight", "target")
    )


def block_words(total: float) -> int:
    """Words a block: total / 65,536, at least 1 and at most 4,096."""
    return int(min(BLOCK_WORDS, max(1, total // LEAST_SLOTS)))


def schedule(targets: DataFrame, total: float, block: int) -> DataFrame:
    """slot, rank (of the source) and block_no: which block of which source each slot takes."""
    spark = targets.sparkSession
    slots = -int(-total // block) if total > 0 else 0
    ends = targets.filter("target > 0").withColumn("end", F.sum("target").over(Window.orderBy("rank")))
    ends = ends.withColumn("begin", F.coalesce(F.lag("end").over(Window.orderBy("rank")), F.lit(0.0)))
    ends = ends.withColumn("last", F.max("end").over(Window.partitionBy()))
    cell = lambda x: F.least(F.floor(x / F.col("last") * CELLS).cast("long"), F.lit(CELLS - 1).cast("long"))
    stretches = ends.select("rank", "begin", "end", "last", F.explode(F.sequence(cell(F.col("begin")), cell(F.col("end")))).alias("cell"))
    # the point is a fraction with 31 bits; its cell follows from the fraction alone
    points = spark.range(slots).select(
        F.col("id").alias("slot"),
        (((F.col("id") % MODULUS) * F.lit(GOLDEN)) % MODULUS / F.lit(float(MODULUS))).alias("point"),
    )
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS).cast("long"))
    near = points.join(stretches, "cell").filter(
        (F.col("point") * F.col("last") >= F.col("begin")) & (F.col("point") * F.col("last") < F.col("end")))
    drawn = near.select("slot", "rank", F.floor(F.col("slot") / RUN).alias("run"))
    inside = Window.partitionBy("run", "rank").orderBy("slot")
    counts = drawn.groupBy("run", "rank").agg(F.count("*").alias("drawn"))
    earlier = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("run", "rank", F.coalesce(F.sum("drawn").over(earlier), F.lit(0)).alias("start"))
    return (
        drawn.withColumn("nth", F.row_number().over(inside) - 1).join(starts, ["run", "rank"])
        .select("slot", "rank", (F.col("nth") + F.col("start")).cast("long").alias("block_no"))
    )


def settled(drawn: DataFrame, goals: DataFrame, slots: int) -> DataFrame:
    """The schedule with as many slots for each source as goals(rank, words, blocks) says.

    Blocks beyond the goal leave their slots; blocks that were not drawn take those slots in order, then new ones at the end.
    """
    met = drawn.join(goals, "rank", "left")
    counts = drawn.groupBy("rank").agg(F.count("*").alias("drawn"))
    short = goals.join(counts, "rank", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).filter("drawn < blocks")
    absent = short.select("rank", F.explode(F.sequence(F.col("drawn"), F.col("blocks") - 1)).alias("block_no"))
    absent = absent.withColumn("nth", F.row_number().over(Window.orderBy("block_no", "rank")))
    left = met.filter("blocks is null or block_no >= blocks").select(F.col("slot").alias("free"))
    left = left.withColumn("nth", F.row_number().over(Window.orderBy("free")))
    added = absent.join(left, "nth", "left").crossJoin(left.agg(F.count("*").alias("n_free"))).select(
        F.coalesce("free", F.lit(slots) + F.col("nth") - 1 - F.col("n_free")).cast("long").alias("slot"), "rank", "block_no")
    return met.filter("block_no < blocks").select("slot", "rank", "block_no").unionByName(added)


def mix(docs: DataFrame, epochs: float = 1.5, repeats: int = 2, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(documents, plan) for docs(doc_id, source, size); any other columns are passed on in a struct ``rest``.

    documents: a row for each row of docs, with source_size, target and taken, the words the mix
    takes of it over all its repeats (from 0 to repeats * size).
    plan: slot, doc_id, source, rest, from_word, to_word, repeat: what stands in each slot, in word offsets.
    Each source gives its target in whole words, one at least. Null ids and sources are a value like any
    other, a null size is 0, repeated rows are rows of their own and ties among them are interchangeable,
    documents without words take no part (taken 0), and an empty table gives empty results.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    others = [c for c in docs.columns if c not in ("doc_id", "source", "size")]
    rest = F.struct(*map(named, others)) if others else F.lit(None).cast("string")
    narrow = scratch.save(docs.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"),
                                      shuffled_key(F.col("doc_id")).alias("shuffled"), rest.alias("rest")), "sizes")
    targets = scratch.save(source_targets(
        narrow.groupBy("source").agg(F.sum("size").alias("source_size")), epochs, repeats, weights), "targets")
    total = float(targets.agg(F.sum("target")).first()[0] or 0.0)
    block = block_words(total)
    placed = in_order(narrow, [F.col("source").asc_nulls_last(), "shuffled", "doc_id", "size"], scratch, "placed")
    line = with_running_sum(placed, "source", "size", "at").alias("d").join(
        targets.select(F.col("source").alias("of"), "source_size", "rank", "target"),
        F.col("d.source").eqNullSafe(F.col("of"))).drop("of")
    line = scratch.save(line, "line")
    copies = line.filter("size > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    copies = copies.withColumn("begin", F.col("repeat") * F.col("source_size") + F.col("at"))
    words = F.greatest(F.lit(1), F.floor(F.col("target") + 0.5)).cast("long")
    goals = targets.filter("target > 0").select("rank", words.alias("words")).withColumn("blocks", F.ceil(F.col("words") / block).cast("long"))
    drawn = scratch.save(settled(scratch.save(schedule(targets, total, block), "drawn"), goals, -int(-total // block)), "settled")
    pieces = copies.withColumn("block_no", F.explode(F.sequence(
        F.floor(F.col("begin") / block).cast("long"), F.floor((F.col("begin") + F.col("size") - 1) / block).cast("long"))))
    start = F.greatest(F.col("begin"), F.col("block_no") * block) - F.col("begin")
    end = F.least(F.col("begin") + F.col("size"), (F.col("block_no") + 1) * block, words) - F.col("begin")
    plan = scratch.save(pieces.join(drawn, ["rank", "block_no"]).filter(start < end).select(
        "slot", "part", "place", "doc_id", "source", "rest", "repeat", start.alias("from_word"), end.alias("to_word")), "plan")
    taken = plan.groupBy("part", "place").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    documents = line.join(taken, ["part", "place"], "left").select(
        "doc_id", "source", "rest", "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"))
    return documents, plan


def first_words(text: Column, n: Column) -> Column:
    """A text up to its n-th word, with the white space in it and before it."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, epochs: float = 1.5, repeats: int = 2) -> DataFrame:
    """The documents a mix consists of, with the columns of docs(doc_id, text, source, ...), in the order of the schedule.

    Each row is a document, told by all its columns (128 bits); rows equal in all of them are alike, and stand as often
    as the mix takes them. A copy of which the mix takes all words stands in full; a rest, which only the documents at
    the end of a source's line have, is cut behind its last word. A copy stands where the slot of its first word does.
    Documents of which nothing is taken go. n_chars, where there is one, is that of the text. Other columns may have any name.
    """
    rows = packed(docs)
    one, two = row_hashes(docs.schema)
    keyed = rows.select("row", one.alias("k1"), two.alias("k2"))
    sized = keyed.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), words_in(F.col("row.text")).alias("size"), "k1", "k2")
    sized = sized.withColumn("whole", F.col("size"))
    _, plan = mix(sized, epochs, repeats)
    copies = plan.groupBy("part", "place", "repeat").agg(
        F.first("rest").alias("rest"), F.min("slot").alias("slot"), F.max("to_word").alias("words"))
    copies = copies.select("rest.k1", "rest.k2", "rest.whole", "slot", "words")
    # rows with one key are equal: the tasks keep one of them before they are shuffled
    nth = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.lit(0)))
    single = keyed.withColumn("nth", nth).filter("nth = 1").drop("nth")
    cut = F.when(F.col("words") < F.col("whole"), first_words(F.col("row.text"), F.col("words"))).otherwise(F.col("row.text"))
    shown = single.join(copies, ["k1", "k2"]).withColumn("text", cut)
    row = F.col("row").withField("text", F.col("text").cast(docs.schema["text"].dataType))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    ordered = shown.select("slot", "k1", "k2", "words", row.alias("row")).orderBy("slot", "k1", "k2", F.desc("words"))
    return ordered.select("row.*")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1: doc_id, size, source_size, target, taken, source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", words_in(F.col("text")).alias("size"))
    documents, _ = mix(docs)
    return documents.select("doc_id", "size", "source_size", "target", "taken", "source")
