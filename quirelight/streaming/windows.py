"""Stateful streams: windows that close by count and time, completion of documents, and an index over dropped files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import search

#: A window closes after at least twelve pages, or four a level, and twenty seconds.
LEAST_PAGES, PAGES_A_LEVEL, LEAST_SECONDS = 12, 4, 20.0
WINDOWS = "key string, first_ts timestamp, last_ts timestamp, pages long"


def close_windows(times: list[pd.Timestamp], held: tuple[pd.Timestamp | None, int], level: int = 1) -> tuple[list[tuple], tuple[pd.Timestamp | None, int]]:
    """(closed windows as (first, last, pages), what stays open) after these times in order."""
    least = max(LEAST_PAGES, PAGES_A_LEVEL * level)
    first, pages = held
    closed = []
    for t in times:
        first, pages = (t, 1) if first is None else (first, pages + 1)
        if pages >= least and (t - first).total_seconds() >= LEAST_SECONDS:
            closed.append((first, t, pages))
            first, pages = None, 0
    return closed, (first, pages)


def count_time_windows(rows: DataFrame, key: str, ts: str, level: int = 1) -> DataFrame:
    """Windows of each key over a stream (or a table, in order of time) of rows."""
    if rows.isStreaming:
        def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            held = state.get if state.exists else (None, 0)
            times = sorted(t for p in parts for t in p["ts"])
            first = pd.Timestamp(held[0]) if held[0] is not None else None
            closed, (first, pages) = close_windows(times, (first, held[1]), level)
            state.update((first.to_pydatetime() if first is not None else None, pages))
            if closed:
                yield pd.DataFrame([(k[0], *c) for c in closed], columns=["key", "first_ts", "last_ts", "pages"])

        named = rows.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"))
        return named.groupBy("key").applyInPandasWithState(step, WINDOWS, "first timestamp, pages long", "append", GroupStateTimeout.NoTimeout)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        closed, _ = close_windows(sorted(pdf["ts"]), (None, 0), level)
        return pd.DataFrame([(pdf["key"].iloc[0], *c) for c in closed], columns=["key", "first_ts", "last_ts", "pages"])

    return rows.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts")).groupBy("key").applyInPandas(whole, WINDOWS)


def completions(pages: DataFrame, patience: int = 86_400_000) -> DataFrame:
    """path, done: a stream (or a table) of pages(path, page_count) counted until all of a document's pages are accounted for.

    A document's count is forgotten when it is complete, or when none of its pages came for ``patience``
    milliseconds, so a stream holds the open documents only.
    """
    if not pages.isStreaming:
        return pages.groupBy("path", "page_count").agg(F.count("*").alias("done")).filter("done = page_count").select("path", "done")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done = (state.get[0] if state.exists else 0) + sum(len(p) for p in parts)
        if done >= key[1]:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"path": [key[0]], "done": [done]})
        else:
            state.update((done,))
            state.setTimeoutDuration(patience)

    named = pages.select(F.col("path").cast("string").alias("path"), F.col("page_count").cast("long").alias("page_count"))
    return named.groupBy("path", "page_count").applyInPandasWithState(step, "path string, done long", "done long", "append", GroupStateTimeout.ProcessingTimeTimeout)


LEVELS = "key string, ts timestamp, level int"


def stepped_levels(rows: DataFrame, key: str, ts: str, spilled: str, level: int, margin: float) -> DataFrame:
    """key, ts, level after each window of a run (key), in order of time: one less whenever more than the margin is gone since the
    least spilled so far, never up again; a null reading changes nothing. A stream keeps a run's level and least reading.
    """
    def walk(times: list, readings: list, now: int, least: float | None) -> tuple[list[int], int, float | None]:
        out = []
        for _, s in sorted(zip(times, readings), key=lambda r: r[0]):
            if s is not None and s == s:
                least = s if least is None else min(least, s)
                if s - least > margin:
                    least, now = s, max(1, now - 1)
            out.append(now)
        return out, now, least

    named = rows.select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col(spilled).cast("double").alias("spilled"))
    if not rows.isStreaming:
        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("ts", kind="stable")
            return pdf[["key", "ts"]].assign(level=walk(list(pdf["ts"]), list(pdf["spilled"]), level, None)[0])

        return named.groupBy("key").applyInPandas(whole, LEVELS)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values("ts", kind="stable")
        now, least = state.get if state.exists else (level, None)
        out, now, least = walk(list(pdf["ts"]), list(pdf["spilled"]), now, least)
        state.update((now, least))
        yield pdf[["ts"]].assign(key=k[0], level=out)[["key", "ts", "level"]]

    return named.groupBy("key").applyInPandasWithState(step, LEVELS, "level int, least double", "append", GroupStateTimeout.NoTimeout)


def index_stream(spark: SparkSession, source: str, folder: str, schema: str, checkpoint: str):
    """Indexes documents(doc_id, text) that arrive as Parquet files: each batch's postings are written beside the earlier ones. Returns the query."""

    def write(batch: DataFrame, number: int) -> None:
        pages = search.derived_pages(batch.select("doc_id", "text"))
        # a batch that is run again after a failure writes the same folder again
        search.postings(pages).write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")
        search.page_stats(pages).write.mode("overwrite").parquet(f"{folder}/page_stats/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
