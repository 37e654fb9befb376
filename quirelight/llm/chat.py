"""Chat formatting: collapse cumulative snapshots, then render what is left.

A logger that writes a conversation after each turn leaves many records of which the longest holds
all others. Each turn has a digest of its place, role and text; the hash of a prefix is the sum of its
turns' digests (two of 60 bits, beside the number of turns), so it rolls on from turn to turn and is a
running sum. A conversation is told by its last hash, and is a snapshot if that is also the hash of an
inner prefix of a longer one. Only hashes are shuffled for that; texts move once, for conversations that stay.

Rendered: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. ``<|`` inside a role or text becomes
``< |``, so that no turn can forge a marker.

Defined cases: a null role is ``unknown``, a null text is empty, a null turn number comes first; a turn
without a conv_id is a conversation of its own (so the turns that lack one are no group, and each stays
unless another conversation begins with it); turns with the same number follow by role and text; rows
equal in all four columns are one turn; of conversations with equal turns the smallest id stays (null if
that is the only one); a very long text is hashed where it lies and moves only to be rendered; a
conversation is one row of the result, so its turns meet in one task; no rows give no rows. Other columns,
of any name, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import Scratch

_KEY = ["conv_id", "lone"]
_HASH = ["n", "h1", "h2"]


def _turns(turns: DataFrame) -> DataFrame:
    """lone: for a turn without a conv_id, a digest that makes it a conversation of its own; else empty."""
    rows = turns.select(
        F.col("conv_id"), F.col("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).withColumn("text_hash", F.sha2("text", 256))
    own = F.sha2(F.concat_ws(":", F.coalesce(F.col("turn").cast("string"), F.lit("none")), "role", "text_hash"), 256)
    return rows.withColumn("lone", F.when(F.col("conv_id").isNull(), own).otherwise(F.lit("")))


def _number(digest: Column, at: int) -> Column:
    """60 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, lone, n (turns of the prefix), h1, h2 (its hash), is_whole, for each prefix of conversations(conv_id, turn, role, text)."""
    rows = _turns(turns).drop("text")
    order = Window.partitionBy(*_KEY).orderBy(F.col("turn").asc_nulls_first(), "role", "text_hash")
    twin = F.col("turn").eqNullSafe(F.lag("turn").over(order)) & (F.col("role") == F.lag("role").over(order)) & (F.col("text_hash") == F.lag("text_hash").over(order))
    single = rows.withColumn("twin", F.coalesce(twin, F.lit(False))).filter("not twin")
    placed = single.withColumn("n", F.row_number().over(order).cast("long"))
    # the role's length keeps two pairs of role and text from reading alike
    digest = F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.length("role").cast("string"), "role", "text_hash"), 256)
    placed = placed.withColumn("digest", digest)
    rolling = order.rowsBetween(Window.unboundedPreceding, 0)
    hashes = placed.withColumns({"h1": F.sum(_number(F.col("digest"), 1)).over(rolling), "h2": F.sum(_number(F.col("digest"), 16)).over(rolling),
                                 "is_whole": F.lead("n").over(order).isNull()})
    return hashes.select(*_KEY, *_HASH, "is_whole")


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, lone, n_turns and n_copies (conversations with these very turns) of those that no other one extends."""
    scratch = Scratch(turns.sparkSession, "chat")
    hashes = scratch.save(prefix_hashes(turns), "hashes")
    least = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "lone"))
    whole = hashes.filter("is_whole").groupBy(*_HASH).agg(least.alias("first"), F.count("*").alias("n_copies"))
    inner = hashes.filter("not is_whole").select(*_HASH).distinct()
    return whole.join(inner, _HASH, "left_anti").select("first.conv_id", "first.lone", F.col("n").alias("n_turns"), "n_copies")


def render(turns: DataFrame) -> DataFrame:
    """conv_id, lone and rendered text of each conversation of rows of ``_turns``."""
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    listed = F.array_sort(F.collect_set(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "role", "text_hash", "text")))
    shown = F.transform("listed", lambda t: F.concat(F.lit("<|im_start|>"), safe(t["role"]), F.lit("\n"), safe(t["text"]), F.lit("<|im_end|>\n")))
    return turns.groupBy(*_KEY).agg(listed.alias("listed")).select(*_KEY, F.array_join(shown, "").alias("rendered"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered for the maximal conversations of turns(conv_id, turn, role, text)."""
    kept = Scratch(turns.sparkSession, "chat").save(maximal_conversations(turns), "kept").withColumnsRenamed({"conv_id": "kept_id", "lone": "kept_lone"})
    same = F.col("conv_id").eqNullSafe(F.col("kept_id")) & (F.col("lone") == F.col("kept_lone"))
    shown = render(_turns(turns).join(kept.select("kept_id", "kept_lone"), same, "left_semi"))
    return shown.join(kept, same).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", "rendered")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All logged conversations, snapshots collapsed, rendered."""
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
