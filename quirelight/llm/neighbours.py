"""Approximate nearest neighbours by collision counting over query-centred windows.

Each of m random lines gives every vector one projected number; a block of vectors keeps one sorted
array of those numbers a line. For a query, the window of half-width width * R / 2 around its own
number is opened in every array; R grows by ``GROWTH`` (virtual rehashing: the same arrays serve all
radii). A wider window only adds what lies between its old and new ends: those entries are counted once,
and a vector whose count reaches l lines is verified by its true distance. The search of a block ends
when the k nearest verified ones lie within R, or the windows hold the whole block.

A vector at distance R or less falls into a window with probability p1, one beyond ``RATIO`` * R with p2
or less; m and l are set so that the former reaches l lines with probability 1 - MISSED, and of the
latter at most ``FALSE`` in expectation do in a block. There is no cap on candidates: copies of one
vector pass together, so ties go to the smaller id.

All rows are indexed, in blocks of at most ``BLOCK`` vectors by the tasks that read them; the blocks'
arrays are written once, and every lot of queries reads them. The queries are a stated set; they are sent
to the tasks in lots of at most ``QUERIES`` (of d doubles each), and a task answers with its blocks' k
nearest of each query. The driver holds one lot at a time.

Vectors that are null, empty, zero, hold a null or non-finite number, have a null id, or another length
than most (the longest of the commonest) take no part. A query id with several vectors stands for the
least of them. Repeated rows are candidates each; a query's own id is never one. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.ordering import in_order, with_row_number
from ..plans.storage import Scratch
from .rows import arrow_rows

RATIO = 2.0
MISSED, FALSE = 0.03, 100
GROWTH = 1.4
BLOCK, QUERIES = 16_384, 4_096
PROBES = 32  # rows whose distance sets a search's first radius


def _phi(x: float) -> float:
    return math.erf(x / math.sqrt(2))  # of the two-sided window


def settings(n: int) -> tuple[float, int, int]:
    """(window width, lines m, collision threshold l) for a block of n vectors."""
    width = math.sqrt(8 * RATIO**2 * math.log(RATIO) / (RATIO**2 - 1))
    p1, p2 = _phi(width / 2), _phi(width / (2 * RATIO))
    far, near = math.sqrt(math.log(2 / min(0.9, FALSE / max(n, 1)))), math.sqrt(math.log(1 / MISSED))
    m = math.ceil((far + near) ** 2 / (2 * (p1 - p2) ** 2))
    share = (far / near * p1 + p2) / (1 + far / near)
    return width, m, math.ceil(share * m)


class BlockIndex:
    """Sorted projections of one block of vectors; ``fields`` is what is written of it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, values: np.ndarray) -> None:
        self.ids, self.vectors, self.order, self.values = ids, vectors, order, values
        self.width, self.m, self.least = settings(len(ids))
        self.lines = _lines(vectors.shape[1], self.m)
        # the lines' arrays end to end, each on a stretch of its own, so that one search serves all lines
        self.bottom, top = float(values[:, 0].min()) - 1.0, float(values[:, -1].max()) + 1.0
        self.top, self.stretch = top, np.arange(self.m) * (top - self.bottom)
        self.ends = (values + self.stretch[:, None]).ravel()

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> BlockIndex:
        by_id = np.argsort(ids, kind="stable")
        ids, vectors = ids[by_id], vectors[by_id].astype(np.float64)
        projected = (vectors @ _lines(vectors.shape[1], settings(len(ids))[1])).T
        order = np.argsort(projected, axis=1, kind="stable")
        return cls(ids, vectors, order.astype(np.uint16), np.take_along_axis(projected, order, axis=1))

    def fields(self) -> tuple[int, bytes, bytes, bytes, bytes]:
        return len(self.ids), self.ids.astype("<i8").tobytes(), self.vectors.astype("<f8").tobytes(), self.order.astype("<u2").tobytes(), self.values.astype("<f8").tobytes()

    @classmethod
    def of(cls, n: int, ids: bytes, vectors: bytes, order: bytes, values: bytes) -> BlockIndex:
        return cls(np.frombuffer(ids, "<i8"), *(np.frombuffer(x, k).reshape(shape) for x, k, shape in ((vectors, "<f8", (n, -1)), (order, "<u2", (-1, n)), (values, "<f8", (-1, n)))))

    def _distances(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.vectors[rows] - query) ** 2).sum(axis=1))

    def _places(self, numbers: np.ndarray, side: str) -> np.ndarray:
        """Where a number on each line stands in the arrays laid end to end."""
        return np.searchsorted(self.ends, np.clip(numbers, self.bottom, self.top) + self.stretch, side)

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest found, nearest first, ties to smaller ids."""
        n = len(self.ids)
        centre = query @ self.lines
        # the first radius: half the distance to the nearest other of a few rows, which is mostly beyond the k-th
        few = self._distances(np.arange(0, n, max(1, n // PROBES)), query)
        radius = float(few[few > 0].min()) / 2 if (few > 0).any() else 1e-9
        seen, count, by_line = self.ids == query_id, np.zeros(n, np.int64), self.order.ravel()
        low = high = self._places(centre, "left")
        rows, far = np.zeros(0, np.int64), np.zeros(0)
        while True:
            half = self.width * radius / 2
            wider = self._places(centre - half, "left"), self._places(centre + half, "right")
            # the entries that the windows have gained at either end
            ends = zip([*wider[0].tolist(), *high.tolist()], [*low.tolist(), *wider[1].tolist()])
            count += np.bincount(np.concatenate([by_line[x:y] for x, y in ends]), minlength=n)
            low, high = wider
            new = np.flatnonzero((count >= self.least) & ~seen)
            seen[new] = True
            rows, far = np.concatenate([rows, new]), np.concatenate([far, self._distances(new, query)])
            best = np.lexsort((rows, far))
            if len(rows) >= k and far[best[k - 1]] <= radius or int((high - low).sum()) == n * self.m:
                return self.ids[rows[best[:k]]], far[best[:k]]
            radius *= GROWTH


def _lines(length: int, m: int, seed: int = 23) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(length, m))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True)) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) for vectors(vec_id, embedding) and a condition that tells queries."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col(vector))).withColumn("length", F.size(vector))
    common = rows.groupBy("length").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    if common is not None:
        rows = rows.filter(F.col("length") == common["length"]).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v"), is_query.alias("asks"))
        asked = rows.filter("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
        asked = scratch.save(with_row_number(in_order(asked, ["vec_id"], scratch, "placed")).select("vec_id", "v", "row_number"), "queries")
        with arrow_rows(spark, 4):  # of some 20 MB each
            index = scratch.save(_indexed(rows.select("vec_id", "v")), "index")
            # queries are paged by their row number; a lot has at most QUERIES rows
            for i in range(-(-asked.count() // QUERIES)):
                lot = asked.filter(F.col("row_number").between(i * QUERIES, (i + 1) * QUERIES - 1)).collect()
                _search(index, lot, k).write.mode("append").parquet(scratch.path("found"))
                found = spark.read.schema(found.schema).parquet(scratch.path("found"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _indexed(rows: DataFrame) -> DataFrame:
    """The arrays of one block a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            fields = BlockIndex.build(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])).fields()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in fields], names=["n", "ids", "vectors", "by_line", "numbers"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK // 4):
                part = batch.slice(at, BLOCK // 4)
                vectors = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                held.append((part.column("vec_id").to_numpy(), vectors))
                n += part.num_rows
                if n > BLOCK - BLOCK // 4:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return rows.mapInArrow(run, "n long, ids binary, vectors binary, by_line binary, numbers binary")


def _search(index: DataFrame, asked: list, k: int) -> DataFrame:
    ids = np.array([r["vec_id"] for r in asked], np.int64)
    sent = index.sparkSession.sparkContext.broadcast((ids, np.array([list(r["v"]) for r in asked], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = BlockIndex.of(batch.column("n")[i].as_py(), *(batch.column(c)[i].as_buffer() for c in ("ids", "vectors", "by_line", "numbers")))
                out = [block.search(q, v, k) for q, v in zip(*sent.value)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(sent.value[0], [len(x) for x, _ in out])), pa.array(np.concatenate([x for x, _ in out])), pa.array(np.concatenate([x for _, x in out]))],
                    names=["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def op4_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector among all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 100 == 0)
