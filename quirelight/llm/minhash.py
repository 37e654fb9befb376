"""MinHash near-duplicates: banded minima, signature and exact verification, components by stars.

A document's set: distinct shingles of five words, A-Z lowered, words being runs without ASCII white
space; with fewer words the whole sequence is its one shingle. Shingles are told by 128 bits, two
independent hashes of their words' bytes.

1. A worker computes each set's 400 minima of a strongly universal family (multiply, add, upper half), b band
   keys of r minima each, and a signature of a byte for each. Equal sets form a class, told by 128 bits and their
   size; its least document stands for it.
2. Classes that share a band key are compared with the least class of that key (its hub): rows grow
   with the number of classes, however large a bucket is. Pairs pass if the signatures agree enough,
   then if the whole sets, made anew from the texts of the documents involved, reach the threshold.
3. Links give components. A bucket that holds several components may hide links between members other
   than the hub: those members are compared across components, block by block of some 16 MB, by signature
   inside the worker, and what passes is verified on whole sets like before. Links between members of one
   component could not change the result and are not looked for.

r and b follow from the threshold t: the longest bands with (1 - t**r)**b below 2e-6, so that a pair
just at the threshold is missed by all bands less often than that. Signatures may differ by six
standard deviations, which is exceeded once in a thousand million pairs. Otherwise links are exact.

Defined cases: a null or blank text has no shingles and is linked with nothing; a node is a doc_id with
its text (told by 64 bits), so rows that only share an id, or have none, are not linked by that; a null
doc_id is named after all others and comes out null; a very long text is one lot of its worker, some 60
bytes of memory for each of its own; ties do not arise, as classes have one least node; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import Scratch
from ..plans.tables import read
from .components import components
from .rows import arrow_rows, packed, row_hashes
from .textbytes import giving_back, lots, mixed, span_hashes, text_bytes, word_spans

SHINGLE = 5
MINIMA = 400
SIGNATURE = 400
MISSED = 2e-6
DEVIATIONS = 6.0
#: Ids of at most this many documents (8 bytes each) are broadcast to the scan; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
_SET = ["n_shingles", "s1", "s2"]
_BLOCK = 16_000_000  # bytes of sets and signatures of one bucket that meet as many others in a task

_rng = np.random.default_rng(20_240_607)
_A = _rng.integers(0, 1 << 64, MINIMA, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 64, MINIMA, dtype=np.uint64)
_C = _rng.integers(0, 1 << 63, (2, max(SHINGLE, MINIMA)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(percent: int) -> tuple[int, int]:
    """(rows, bands) for a threshold in hundredths."""
    t = percent / 100
    rows = max(r for r in range(1, MINIMA + 1) if r == 1 or (1 - t**r) ** (MINIMA // r) <= MISSED)
    return rows, MINIMA // rows


def least_agreement(percent: int) -> int:
    """Signature bytes that must agree; bytes of unequal minima agree once in 256 by chance."""
    t = percent / 100
    return max(0, math.floor(SIGNATURE * (t - DEVIATIONS * math.sqrt(t * (1 - t) / SIGNATURE))))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, ascending: two rows of 64-bit hashes, one for each lane."""
    low = data + np.uint8(32) * ((data >= 65) & (data <= 90)).astype(np.uint8)
    starts, ends, counts = word_spans(data, offsets)
    words = np.stack([span_hashes(low, starts, ends, lane) for lane in (0, 1)])
    runs = np.zeros((2, max(0, words.shape[1] - SHINGLE + 1)), np.uint64)
    for i in range(SHINGLE):
        runs += words[:, i:i + runs.shape[1]] * _C[:, i:i + 1]
    runs = mixed(runs)
    at = 0
    for n in counts.tolist():
        if n >= SHINGLE:
            yield _distinct(runs[:, at:at + n - SHINGLE + 1])
        elif n:
            yield mixed((words[:, at:at + n] * _C[:, :n]).sum(axis=1, keepdims=True, dtype=np.uint64) + np.uint64(n))
        else:
            yield np.zeros((2, 0), np.uint64)
        at += n


def _distinct(x: np.ndarray) -> np.ndarray:
    x = x[:, np.argsort(x[0], kind="stable")]
    same = x[0, 1:] == x[0, :-1]
    if (same & (x[1, 1:] != x[1, :-1])).any():  # two shingles that share one of their hashes
        x = x[:, np.lexsort((x[1], x[0]))]
        same = x[0, 1:] == x[0, :-1]
    return x[:, np.concatenate([[True], ~(same & (x[1, 1:] == x[1, :-1]))])]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Number of shingles in both of two sets of ``shingle_sets``."""
    if (np.diff(a[0]) == 0).any() or (np.diff(b[0]) == 0).any():
        return len(set(zip(*a.tolist())) & set(zip(*b.tolist())))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return int((a[1, i] == b[1, j]).sum())


def minima(shingles: np.ndarray) -> np.ndarray:
    """Least value of each of the functions (a * x + b modulo 2**64) div 2**32 over the upper halves of the first hashes."""
    x, least, room = shingles[0] >> np.uint64(32), np.full(MINIMA, (1 << 64) - 1, np.uint64), np.empty((64, MINIMA), np.uint64)
    for i in range(0, len(x), 64):
        value = np.multiply(x[i:i + 64, None], _A, out=room[:min(64, len(x) - i)])
        value += _B
        np.minimum(least, value.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(least: np.ndarray, percent: int) -> np.ndarray:
    """A 64-bit key for each band (a column) of each row of minima."""
    rows, count = bands(percent)
    cut = least[:, :rows * count].reshape(len(least), count, rows).astype(np.uint64)
    return mixed(mixed(cut + np.uint64(1)) @ _C[0, :rows] + np.arange(count, dtype=np.uint64))


def _node(doc_id: Column, text: Column) -> Column:
    """The node of a row; rows of one id and one text are one node."""
    return F.xxhash64(doc_id.cast("long"), text.cast("string"))


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=names)


def described(docs: DataFrame, percent: int) -> DataFrame:
    """node, doc_id, n_shingles, s1, s2 (null without shingles), bands, signature of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in lots(offsets):
                base = offsets[a]
                counts, sums, least = [], [], []
                for x in shingle_sets(data[base:offsets[b]], offsets[a:b + 1] - base):
                    counts.append(x.shape[1])
                    sums.append(mixed(x).sum(axis=1, dtype=np.uint64))
                    least.append(minima(x))
                counts, least, sums = np.array(counts, np.int64), np.array(least), np.array(sums, np.uint64).view(np.int64)
                keys = band_keys(least, percent).view(np.int64)
                signature = (least[:, :SIGNATURE] * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)
                none = counts == 0
                yield _batch(
                    ["node", "doc_id", "n_shingles", "s1", "s2", "bands", "signature"],
                    batch.column("node").slice(a, b - a), batch.column("doc_id").slice(a, b - a), pa.array(counts),
                    pa.array(sums[:, 0], mask=none), pa.array(sums[:, 1], mask=none),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel())),
                    pa.array([s.tobytes() for s in signature], pa.binary()))

    rows = docs.select(_node(F.col("doc_id"), F.col("text")).alias("node"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(giving_back(run), "node long, doc_id long, n_shingles long, s1 long, s2 long, bands array<long>, signature binary")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and whole shingle set (its two rows of 64-bit numbers as bytes) of the nodes named in ids(id), a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for a, b in lots(offsets):
                sets = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                yield _batch(["id", "shingles"], batch.column("id").slice(a, b - a), pa.array([x.tobytes() for x in sets], pa.large_binary()).cast(pa.binary()))

    few = ids.count() <= BROADCAST_IDS
    rows = docs.select(_node(F.col("doc_id"), F.col("text")).alias("id"), F.col("text").cast("string").alias("text"))
    return rows.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(giving_back(run), "id long, shingles binary").dropDuplicates(["id"])


def _compare(pairs: DataFrame, held: DataFrame, column: str, passes) -> DataFrame:
    """The pairs (a, b) of which ``passes`` (of two binary values) holds; held has an id and the column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            ok = pa.array([passes(x.as_buffer(), y.as_buffer()) for x, y in zip(left, right)], pa.bool_())
            yield batch.select(["a", "b"]).filter(ok)

    side = lambda k, v: held.select(F.col("id").alias(k), F.col(column).alias(v))
    return pairs.join(side("a", "left"), "a").join(side("b", "right"), "b").select("a", "b", "left", "right").mapInArrow(giving_back(run), "a long, b long").distinct()


def _reaches(percent: int):
    def passes(x, y) -> bool:
        a, b = (np.frombuffer(v, np.uint64).reshape(2, -1) for v in (x, y))
        n, m = a.shape[1], b.shape[1]
        if 100 * min(n, m) < percent * max(n, m):
            return False
        both = shared(a, b)
        return 100 * both >= percent * (n + m - both)

    return passes


def _agrees(least: int):
    return lambda x, y: int((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum()) >= least


def _across(rows: DataFrame, least: int, reaches) -> DataFrame:
    """Links (a, b) inside one bucket but across components; rows(bucket, bytes, id, component, signature, shingles).

    A bucket is dealt out in pairs of blocks, as many as its sets have times 16 MB. Members of two blocks meet in one task, by signature, and
    those that agree by their whole sets; what leaves the task are links only. Components that a task has
    found linked count as one for its later pairs.
    """
    blocks = F.ceil(F.col("bytes") / _BLOCK).cast("long")
    own = F.pmod(F.xxhash64("id"), blocks)
    dealt = (
        rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"),
                "id", "component", "signature", "shingles")
    )
    parts = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[int, int] = {}
        apart: set[tuple[int, int]] = set()

        def root(c: int) -> int:
            while (up := above.get(c, c)) != c:
                c = up
            return c

        def links(group: list[tuple]) -> Iterator[tuple[int, int]]:
            same = group[0][1] == group[0][2]
            one, two = [g for g in group if same or g[3]], [g for g in group if same or not g[3]]
            if not one or not two:
                return
            table = np.frombuffer(b"".join(g[6] for g in two), np.uint8).reshape(len(two), -1)
            for k, g in enumerate(one):
                for at in np.flatnonzero((table == np.frombuffer(g[6], np.uint8)).sum(axis=1) >= least):
                    h = two[at]
                    pair = (min(g[4], h[4]), max(g[4], h[4]))
                    if same and at <= k or pair in apart or (x := root(g[5])) == (y := root(h[5])):
                        continue
                    if reaches(g[7], h[7]):
                        above[max(x, y)] = min(x, y)
                        yield pair
                    elif len(apart) < 500_000:  # a pair met again in a later bucket is compared again only beyond that
                        apart.add(pair)

        group: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[:3] != group[0][:3]:
                    found += links(group)
                    group = []
                group.append(row)
            if found:
                yield _batch(["a", "b"], *(pa.array(c, pa.int64()) for c in zip(*found)))
        if group and (found := list(links(group))):
            yield _batch(["a", "b"], *(pa.array(c, pa.int64()) for c in zip(*found)))

    return parts.mapInArrow(giving_back(run), "a long, b long").distinct()


def _named(docs: DataFrame, percent: int) -> DataFrame:
    """node, doc_id, n_shingles, component (a node; null without shingles), component_id for each row of docs(doc_id, text)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "minhash")
    all_rows = scratch.save(described(docs, percent), "described")
    narrow = scratch.save(all_rows.select("node", "doc_id", "n_shingles", "s1", "s2"), "narrow")
    classes = scratch.save(narrow.filter("n_shingles > 0").groupBy(*_SET).agg(
        F.min("node").alias("id"), F.min("doc_id").alias("least")), "classes")
    standing = all_rows.join(classes.withColumnRenamed("id", "node"), [*_SET, "node"], "left_semi").dropDuplicates([*_SET, "node"])
    reps = scratch.save(standing.select(F.col("node").alias("id"), "bands", "signature", (F.col("n_shingles") * 16 + SIGNATURE).alias("bytes")), "reps")
    scratch.drop("described")

    keyed = reps.select("id", F.explode("bands").alias("bucket"))
    hubs = keyed.groupBy("bucket").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    members = scratch.save(keyed.join(scratch.save(hubs, "hubs"), "bucket"), "members")
    first = scratch.save(members.filter("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs-1")
    agree, reach, signatures = least_agreement(percent), _reaches(percent), reps.select("id", "signature")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        ids = scratch.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"ids-{name}")
        with arrow_rows(spark, 1_000):
            sets = scratch.save(_sets(docs, ids), f"sets-{name}")
        with arrow_rows(spark, 250):
            links = scratch.save(_compare(pairs, sets, "shingles", reach), f"links-{name}")
        scratch.drop(f"sets-{name}", f"ids-{name}")
        return links

    links = verified(scratch.save(_compare(first, signatures, "signature", _agrees(agree)), "near-1"), "1")
    joined = scratch.save(components(links, scratch, "component-1"), "components-1")
    of = joined.withColumnRenamed("node", "id")
    placed = members.filter("n > 2 and id != hub").join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = scratch.save(placed.select("bucket", "id", "component"), "placed")
    mixed_ = placed.join(reps.select("id", "bytes"), "id").groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum("bytes").alias("bytes")).filter("lo != hi")
    open_ = scratch.save(placed.join(scratch.save(mixed_.select("bucket", "bytes"), "open"), "bucket"), "open-members")
    if open_.take(1):
        with arrow_rows(spark, 1_000):
            sets = scratch.save(_sets(docs, scratch.save(open_.select("id").distinct(), "ids-2")), "sets-2")
        with arrow_rows(spark, 250):
            more = scratch.save(_across(open_.join(signatures, "id").join(sets, "id"), agree, reach), "links-2")
        if more.take(1):
            joined = scratch.save(components(links.union(more), scratch, "component-2"), "components-2")

    groups = classes.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = scratch.save(groups.select(*_SET, "component").join(least, "component"), "of-class")
    component_id = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return narrow.join(of_class, _SET, "left").select("node", "doc_id", "n_shingles", "component", component_id.alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links) and kept, for each row of docs(doc_id, text).

    Two documents are linked if 100 * (shared shingles) >= percent * (shingles of either). Kept are the rows with
    the component's id, and all rows of a component without one.
    """
    return _named(docs, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each component, one with the least doc_id, with all columns of docs(doc_id, text, ...).

    Rows of one doc_id (or none) and one text are one document; those that share only the id are several,
    and rows without a word all stay, as they are linked with nothing. Other columns may have any name.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    named = _named(docs.select("doc_id", "text"), percent).filter("component is not null")
    kept = named.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.node").alias("node"))
    rows = packed(docs).withColumn("node", _node(F.col("row.doc_id"), F.col("row.text")))
    blank = ~F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # of rows with one node one stays: the tasks drop the others before they are shuffled
    nth = F.row_number().over(Window.partitionBy("node").orderBy(*row_hashes(docs.schema)))
    told = rows.filter(~blank).join(kept, "node", "left_semi").withColumn("nth", nth).filter("nth = 1")
    return told.select("row").unionByName(rows.filter(blank).select("row")).select("row.*")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a similarity of 0.85."""
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"), 85)
