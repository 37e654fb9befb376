"""Tables of a folder, and what the file system says of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A table of fewer files than there are cores is dealt out anew if it is no larger than this.
SMALL = 2_000_000_000


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    system, found = _path(spark, path)
    return system.exists(found)


def stamp(spark: SparkSession, path: str) -> tuple:
    """(files, bytes, last change) under a path: another stamp means other content."""
    system, found = _path(spark, path)
    files = [f for f in system.listStatus(found) if f.isFile()]
    return len(files), sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0)


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table of ``folder`` with these columns (or all), for work that costs much more than reading.

    A small table in few files would be one task or two; its rows are dealt to all cores. A table of
    many files, or a large one, is read as it lies, without a shuffle.
    """
    path = f"{folder}/{name}.parquet"
    rows = spark.read.parquet(path)
    rows = rows.select(*columns) if columns else rows
    files, size, _ = stamp(spark, path)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if files < cores and size <= SMALL else rows
