"""Reproducible shuffle into shards: a Feistel permutation of global row numbers with cycle walking.

Row numbers 0..n-1 (documents by ascending id) are split as x = left * b + right on a grid of
a x b >= n cells, a = ceil(sqrt(n)). Each round adds a keyed value of one half to the other, so
the rounds permute the grid; a result beyond n is walked through the permutation again until it
falls below n. The new position p gives shard = p mod shards and slot = p div shards, so shard
sizes differ by one row at most and slots have no gap: the law is ``rows``. A row's place can be
computed from its number alone, and undone, without reading the other rows.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ordering import in_order, with_row_number
from ..plans.storage import Scratch
from .rows import packed

PRIME = 2_147_483_647
ROUNDS = 8
#: Below 4,096 rows fewer than 64 cells lie beyond n, so no walk is longer; above, less than one
#: in 64 does, and a walk of 64 steps has probability below 64**-64. A longer one raises an error.
WALKS = 64


def round_keys(seed: int) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    return [(rng.randrange(1, PRIME), rng.randrange(PRIME)) for _ in range(ROUNDS)]


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, max(1, -(-n // a))


def permute(x: int, n: int, seed: int) -> int:
    """The permutation in plain Python, for one row number; the column form below equals it."""
    a, b = grid(n)
    while True:
        left, right = divmod(x, b)
        for i, (m, c) in enumerate(round_keys(seed)):
            if i % 2 == 0:
                t = (right * m + c) % PRIME
                left = (left + t * t % PRIME) % a
            else:
                t = (left * m + c) % PRIME
                right = (right + t * t % PRIME) % b
        x = left * b + right
        if x < n:
            return x


def permuted(x: Column, n: int, seed: int) -> Column:
    """Column form of ``permute``: rounds and walks are array folds, with no Python at run time."""
    a, b = grid(n)
    keys = F.array(*[
        F.struct(F.lit(m).cast("long").alias("m"), F.lit(c).cast("long").alias("c"), F.lit(i % 2).alias("odd"))
        for i, (m, c) in enumerate(round_keys(seed))
    ])

    def keyed(half: Column, k: Column, size: int) -> Column:
        t = (half * k["m"] + k["c"]) % F.lit(PRIME)
        return (t * t) % F.lit(PRIME) % F.lit(size)

    def turn(s: Column, k: Column) -> Column:
        even = k["odd"] == 0
        return F.struct(
            F.when(even, (s["l"] + keyed(s["r"], k, a)) % F.lit(a)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + keyed(s["l"], k, b)) % F.lit(b)).alias("r"),
        )

    def once(v: Column) -> Column:
        start = F.struct(
            F.floor(v / F.lit(b)).cast("long").alias("l") if b > 1 else v.cast("long").alias("l"),
            (v % F.lit(b)).cast("long").alias("r"),
        )
        return F.aggregate(keys, start, turn, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])

    if a * b == n:
        return once(x)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(x), lambda v, _: F.when(v >= F.lit(n), once(v)).otherwise(v))
    return F.when(walked < F.lit(n), walked).otherwise(F.raise_error(F.lit("a cycle walk did not end")).cast("long"))


def shard_rows(df: DataFrame, order: list[str], shards: int = 16, seed: int = 20_240_501) -> DataFrame:
    """``df`` with row_number, position, shard and slot.

    df: should be narrow (keys and sizes, not texts); join texts afterwards by key. It may have
    any other columns; one named like the four that are added gives way to it.
    order: columns that fix the row numbers; nulls come first, rows equal in all of them are
    interchangeable. Repeated rows are rows of their own. An empty table gives an empty result.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    scratch = Scratch(df.sparkSession, "shards")
    rows = packed(df).select("row", *(F.col("row")[c].alias(f"order_{i}") for i, c in enumerate(order)))
    placed = in_order(scratch.save(rows, "keys"), [f"order_{i}" for i in range(len(order))], scratch, "placed")
    n = placed.count()
    numbered = with_row_number(placed).withColumn("position", permuted(F.col("row_number"), max(n, 1), seed))
    added = {"row_number", "position", "shard", "slot"}
    return numbered.select(
        *(F.col("row")[c].alias(c) for c in df.columns if c not in added), "row_number", "position",
        (F.col("position") % shards).cast("int").alias("shard"), F.floor(F.col("position") / shards).cast("long").alias("slot"))


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law ``rows``.

    size is the text's UTF-8 bytes plus one (1 for a null text), text_crc32 the unsigned CRC-32 of
    those bytes (0 for none), grown_shard null as the law is not ``key``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return shard_rows(keys, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number", "position",
    )
