"""Whole rows as values: names that do not clash, hashes that tell rows apart, and batches of few rows."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def named(column: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame, into: str = "row") -> DataFrame:
    """``df`` with all its columns in one struct, so that others can be added under any name."""
    return df.select(F.struct(*map(named, df.columns)).alias(into))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: steps over Arrow batches cannot take every name."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it until no column has it (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def row_hashes(schema: T.StructType, row: str = "row") -> tuple[Column, Column]:
    """Two 64-bit hashes of the struct column ``row`` of this schema; maps and variants take no part."""
    parts = [F.col(row)[f.name] for f in schema.fields if _hashable(f.dataType)]
    nulls = F.concat(F.lit(""), *(F.when(p.isNull(), "n").otherwise("v") for p in parts))
    return F.xxhash64(nulls, *parts), F.xxhash64(F.lit("second"), *parts, nulls)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of few rows, for steps whose rows hold whole sets; the steps must be written inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before))) if int(before) > 0 else str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
