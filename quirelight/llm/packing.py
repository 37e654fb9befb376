"""Shortest-pack-first packing of tokenised documents into sequences of a fixed length.

1. Tokenise. Workers cut texts into units that the tokenizer treats independently (see ``_units``),
   hash them, and give only units they have not met to the tokenizers library; the ids of the others
   come from a table, which holds their bytes too, so that units with equal hashes keep their own ids. A document's ids get the end id 2 and are cut into pieces of at most 4096.
2. Count. The histogram of piece lengths has at most 4096 bins, whatever the input's size.
3. Pack the histogram, longest lengths first: each lot of equal pieces goes on the sequences filled
   least so far (the shortest packs), as many at once as have the same fill; where nothing fits, new
   sequences begin. The result is a table of patterns: the pieces of length L with ranks r .. r+n-1
   go to the sequences s .. s+n-1 at offset o.
4. Join. A piece's rank among its equals is its rank within its task plus a sum over earlier tasks;
   the patterns, cut at multiples of 64 ranks, are joined on length and rank div 64.

Nulls and empty texts make one piece (the end id); repeated rows are documents of their own; a null
doc_id is kept; pieces of equal length are interchangeable, so ties go by task and row; a very long text is
one lot of its worker; columns other than doc_id and text are left out; no documents give no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import Scratch
from ..plans.tables import read
from .textbytes import BLANK, equal_spans, giving_back, lots, span_hashes, text_bytes

SEQUENCE = 4_096
END_ID = 2
#: Units a worker keeps the ids of, some 70 bytes each; when there are more, it starts its table anew. The table
#: outlives its stage in a worker that Spark uses again.
KEPT_UNITS = 300_000
#: Rows of (task, length, earlier pieces), 24 bytes each, that are broadcast at most.
BROADCAST_COUNTS = 1_300_000
_BLOCK = 64  # ranks a pattern row covers at most in the join

_KIND = np.full(256, 4, np.uint8)  # 0 white space, 1 letter, 2 digit, 3 other ASCII, 4 beyond ASCII
_KIND[:128] = 3
_KIND[BLANK] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1


class Units:
    """Token ids of word parts, by hash, in one worker."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.whole.encode_special_tokens = self.plain.encode_special_tokens = True  # such strings in a text are ordinary text
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for s, i in vocabulary.items() if s.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.place, self.size, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def _joined(self, tokenizer, units: list[str]) -> list[np.ndarray]:
        """Ids of units that are one word to the tokenizer: encoded together, cut behind word ends."""
        out: list[np.ndarray] = []
        for i in range(0, len(units), 2_000):
            some = units[i:i + 2_000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):
                out += np.split(ids, cuts[:-1])
            else:
                out += self._single(some)
        return out

    def _single(self, units: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.whole.encode_batch_fast(units, add_special_tokens=False)]

    def _encode(self, units: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(units)
        ways: tuple[list[int], ...] = ([], [], [])
        for i, u in enumerate(units):
            ascii_ = u.isascii()
            ways[0 if ascii_ and u.isprintable() and "'" not in u and u == u.lower() else 1 if not ascii_ and u.isalpha() else 2].append(i)
        for way, f in zip(ways, (lambda x: self._joined(self.plain, x), lambda x: self._joined(self.whole, x), self._single)):
            for i, ids in zip(way, f([units[i] for i in way])):
                out[i] = ids
        return out

    def _keep(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encode these spans and put them in the table; their rows in it."""
        raw = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
        fresh = self._encode([x.decode("utf-8", "replace") for x in raw])
        sizes, lengths = np.array([len(x) for x in fresh], np.int32), ends - starts
        rows = len(self.begin) + np.arange(len(fresh))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes])
        self.count, self.ids = np.concatenate([self.count, sizes]), np.concatenate([self.ids, *fresh])
        self.place = np.concatenate([self.place, len(self.bytes) + np.cumsum(lengths) - lengths])
        self.size, self.bytes = np.concatenate([self.size, lengths]), np.concatenate([self.bytes, np.frombuffer(b"".join(raw), np.uint8)])
        return rows

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units in a row, ids per unit)."""
        unit, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(unit) > KEPT_UNITS:
            self.clear()
        where = np.searchsorted(self.known, unit)
        new = np.ones(len(unit), bool)
        inside = where < len(self.known)
        new[inside] = self.known[where[inside]] != unit[inside]
        if new.any():
            rows = self._keep(data, starts[first[new]], ends[first[new]])
            self.at = np.insert(self.at, where[new], rows)
            self.known = np.insert(self.known, where[new], unit[new])
            where = np.searchsorted(self.known, unit)
        at = self.at[where][back.ravel()]
        # a unit whose bytes are not those of its row in the table only shares its hash, and is encoded by itself
        lengths = ends - starts
        odd = lengths != self.size[at]
        some = np.flatnonzero(~odd)
        odd[some] = ~equal_spans(data, starts[some], self.bytes, self.place[at[some]], lengths[some])
        if odd.any():
            at = at.copy()
            at[odd] = self._keep(data, starts[odd], ends[odd])
        sizes = self.count[at].astype(np.int64)
        total = np.cumsum(sizes)
        places = np.repeat(self.begin[at] - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)
        return self.ids[places], sizes


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends): parts of text whose ids do not depend on their neighbours.

    The tokenizer composes characters (NFC), collapses white space, lower-cases, and then takes words
    of letters, single digits, or other signs, and some English endings behind an apostrophe. So
    white space always divides; so does a change between ASCII letters, digits and other signs, but
    not in a word with an apostrophe, nor beside a byte beyond ASCII, which may be of any kind or
    compose with its neighbour. Two-byte Latin letters (C3 80 to C3 BF but for the two signs) count
    as letters. A capital is lowered here only if no byte beyond ASCII follows.
    """
    kind = _KIND[data]
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)) if len(data) else np.zeros(0, int)
    kind[latin] = kind[latin + 1] = 1
    alone = np.ones(len(data), bool)
    alone[:-1] = data[1:] < 128
    low = data + np.uint8(32) * ((data >= 65) & (data <= 90) & alone).astype(np.uint8)
    ink = kind > 0
    word = ink.copy()
    word[1:] &= kind[:-1] == 0
    begins = offsets[:-1][offsets[:-1] < len(data)]
    word[begins] = ink[begins]
    inner = ink.copy()
    inner[:1] = False
    inner[1:] &= (kind[:-1] > 0) & (kind[1:] < 4) & (kind[:-1] < 4) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
    if len(marks := np.flatnonzero(data == 39)):
        starts = np.flatnonzero(word)
        number = np.searchsorted(starts, np.flatnonzero(inner), "right") - 1
        held = np.zeros(len(starts), bool)
        held[np.searchsorted(starts, marks, "right") - 1] = True
        inner[np.flatnonzero(inner)[held[number]]] = False
    starts = np.flatnonzero(word | inner)
    stop = np.flatnonzero(word | inner | ~ink)
    after = np.append(stop, len(data))
    return low, starts, after[np.searchsorted(stop, starts, "right")]


_UNITS: dict[str, Units] = {}


def _doc_ids(units: Units, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    low, starts, ends = _units(data, offsets)
    ids, sizes = units.look_up(low, starts, ends) if len(starts) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    total = np.concatenate([[0], np.cumsum(sizes)])
    cuts = total[np.searchsorted(starts, offsets)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield ids[a:b]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def token_pieces(docs: DataFrame, tokenizer: str, longest: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, and part, nth (task, and
    rank among the task's pieces of that length); with keep_ids also ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _UNITS.get(tokenizer) or _UNITS.setdefault(tokenizer, Units(tokenizer))
        part, seen = TaskContext.get().partitionId(), np.zeros(longest + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for a, b in lots(offsets):
                base = offsets[a]
                rows: list[tuple] = []
                for row, ids in enumerate(_doc_ids(units, data[base:offsets[b]], offsets[a:b + 1] - base), a):
                    n = len(ids) + 1
                    for start in range(0, n, longest):
                        cut = ids[start:start + longest]
                        length = min(longest, n - start)
                        crc = zlib.crc32(np.ascontiguousarray(cut, "<u4").tobytes())
                        if len(cut) < length:
                            crc = zlib.crc32(end, crc)
                        rows.append((names[row], start, length, crc, n, part, int(seen[length])) + (
                            (cut.tolist() + [END_ID] * (length - len(cut)),) if keep_ids else ()))
                        seen[length] += 1
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * keep_ids
                fields = PIECES.replace(",", "").split()[::2] + ["ids"] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=fields)

    return docs.select("doc_id", "text").mapInArrow(giving_back(run), PIECES + (", ids array<int>" if keep_ids else ""))


def pack_histogram(histogram: dict[int, int], longest: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Patterns (length, first rank, number, first sequence, offset) for the counts of each length.

    Sequences of equal fill are kept as ranges, so the work follows the number of ranges, not of pieces.
    New sequences begin one a piece up to the number that all tokens fill at least; beyond that only as
    many as the pieces left need when they share them.
    """
    needed = -(-sum(n * k for n, k in histogram.items()) // longest)
    patterns: list[tuple[int, int, int, int, int]] = []
    least: list[tuple[int, int, int]] = []  # fill, first sequence, number
    sequences = 0
    for length in sorted((n for n, k in histogram.items() if k), reverse=True):
        rank, left = 0, histogram[length]
        while left:
            if least and least[0][0] + length <= longest:
                fill, first, number = heapq.heappop(least)
                used = min(left, number)
                if used < number:
                    heapq.heappush(least, (fill, first + used, number - used))
            else:
                shared = -(-left // (longest // length))
                fill, first, used = 0, sequences, max(shared, min(left, needed - sequences))
                sequences += used
            patterns.append((length, rank, used, first, fill))
            if fill + length < longest:
                heapq.heappush(least, (fill + length, first, used))
            rank, left = rank + used, left - used
    return patterns


def pack(pieces: DataFrame, longest: int = SEQUENCE) -> DataFrame:
    """pieces (of ``token_pieces``, written) with sequence_id and offset in place of part and nth."""
    spark, scratch = pieces.sparkSession, Scratch(pieces.sparkSession, "packing")
    counts = scratch.save(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= longest rows
    patterns = spark.createDataFrame(pack_histogram(histogram, longest), "length long, rank_0 long, number long, sequence_0 long, offset long")
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # a row a task and length: sent to all tasks while it is some 32 MB, and else joined by shuffle, whatever the file sizes say
    few = counts.count() <= BROADCAST_COUNTS
    ranked = pieces.join(F.broadcast(before) if few else before.hint("shuffle_hash"), ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before")).drop("part", "nth", "before")
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / _BLOCK))
    last = F.col("rank_0") + F.col("number") - 1
    spread = patterns.withColumn("block", F.explode(F.sequence(F.floor(F.col("rank_0") / _BLOCK), F.floor(last / _BLOCK)))).withColumnRenamed("length", "of_length").withColumnRenamed("block", "of_block")
    met = (F.col("length") == F.col("of_length")) & (F.col("block") == F.col("of_block")) & F.col("rank").between(F.col("rank_0"), last)
    return (
        ranked.join(spread, met)
        .withColumn("sequence_id", F.col("sequence_0") + F.col("rank") - F.col("rank_0"))
        .drop("rank", "block", "of_length", "of_block", "rank_0", "number", "sequence_0")
    )


def packed_documents(docs: DataFrame, tokenizer: str, longest: int = SEQUENCE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for all pieces of docs(doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.save(token_pieces(docs, tokenizer, longest), "pieces"), longest).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return packed_documents(read(spark, sf_dir, "documents", "doc_id", "text"), word_bpe_path())
