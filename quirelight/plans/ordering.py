"""Row numbers and running sums over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import Scratch

_LOW = (1 << 33) - 1  # monotonically_increasing_id keeps a partition's rows in its low 33 bits


def in_order(df: DataFrame, order: list[str | Column], scratch: Scratch, name: str) -> DataFrame:
    """Write ``df`` sorted over the cluster; adds part (int) and place (long, from 0 in its part).

    Range partitioning puts the parts themselves in order, so (part, place) is the global order.
    Rows equal in every order column are interchangeable.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return scratch.save(placed.withColumns({
        "part": F.spark_partition_id(),
        "place": F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW)),
    }), name)


def with_row_number(placed: DataFrame, column: str = "row_number") -> DataFrame:
    """Global row number from 0 of what ``in_order`` wrote. The joined table has a row per part."""
    counts = placed.groupBy("part").agg(F.count("*").alias("rows_in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("rows_in_part").over(before), F.lit(0)).alias("rows_before"))
    return (
        placed.join(F.broadcast(starts), "part")
        .withColumn(column, F.col("rows_before") + F.col("place"))
        .drop("rows_before")
    )


def with_running_sum(placed: DataFrame, group: str, value: str, column: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same ``group``, nulls being one group.

    Rows are summed inside each part first; then a group has at most one row a part to sum over.
    """
    inside = Window.partitionBy("part", group).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn(column, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    totals = placed.groupBy("part", group).agg(F.sum(value).alias("part_total"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("part").alias("start_part"),
        F.col(group).alias("start_group"),
        F.coalesce(F.sum("part_total").over(earlier), F.lit(0)).alias("start_at"),
    )
    return (
        local.join(starts, (F.col("part") == F.col("start_part")) & F.col(group).eqNullSafe(F.col("start_group")))
        .withColumn(column, F.col(column) + F.col("start_at"))
        .drop("start_part", "start_group", "start_at")
    )
