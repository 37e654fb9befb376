"""UTF-8 texts of an Arrow column as flat byte arrays, and hashes of many spans at once."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in lots of about this many bytes, whatever an Arrow batch holds. A worker that outlives
#: its stage keeps much of the memory its largest lot took, some 60 bytes for each of a text.
LOT = 500_000

_LANE_1, _LANE_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Masks that keep the first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def lots(offsets: np.ndarray, most: int = LOT) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most about ``most`` bytes; a longer text is a lot of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, rows)
        first = last


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, at whose end the worker returns the memory that it has freed; Spark uses it again for other steps."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None  # glibc has it
            if trim:
                trim(0)

    return whole


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros behind the end."""
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", held, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hashes of spans of ``data``, equal for equal bytes in any array; lanes 0 and 1 are independent.

    The bytes go through a finaliser eight at a time, so that no family of texts collides as it does
    under a polynomial modulo 2**64. In lane 0, spans of up to seven bytes have hashes of their own.
    """
    eights = _eights(data)
    sizes = (ends - starts).astype(np.int64)
    # up to seven bytes and their number fill one word; the finaliser is a bijection
    value = (eights[starts] & _FIRST[np.minimum(sizes, 7)]) | (np.minimum(sizes, 255).astype(np.uint64) << np.uint64(56))
    value = mixed(value * _LANE_2 + np.uint64(1)) if lane else mixed(value)
    rest = np.flatnonzero(sizes > 7)
    if len(rest):
        rest = rest[np.argsort(-sizes[rest], kind="stable")]
        at, left = starts[rest].astype(np.int64), sizes[rest]
        state, step = np.full(len(rest), _LANE_2 if lane else _LANE_1) + left.astype(np.uint64), _LANE_1 if lane else _LANE_2
        n = len(rest)
        while n:
            state[:n] = mixed((state[:n] ^ (eights[at[:n]] & _FIRST[np.minimum(left[:n], 8)])) * step + np.uint64(1))
            at[:n] += 8
            left[:n] -= 8
            n = int(np.searchsorted(-left[:n], 0, "left"))
        value[rest] = state
    return value


def equal_spans(one: np.ndarray, at: np.ndarray, other: np.ndarray, place: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ``sizes`` bytes of ``one`` from ``at`` and of ``other`` from ``place`` are the same, span by span."""
    left, right = _eights(one), _eights(other)
    equal, some, done = np.ones(len(at), bool), np.arange(len(at)), 0
    while len(some):
        rest = sizes[some] - done
        equal[some] &= ((left[at[some] + done] ^ right[place[some] + done]) & _FIRST[np.minimum(rest, 8)]) == 0
        some, done = some[(rest > 8) & equal[some]], done + 8
    return equal


#: The six ASCII white-space bytes of [^\x20\x09-\x0D].
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per text) of the runs without white space; a text's end ends a word.

    offsets are positions in ``data``, the first of them 0 and the last its length.
    """
    ink = ~BLANK[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = ink[begins]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    finals = offsets[1:][offsets[1:] > 0] - 1
    last[finals] = ink[finals]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))
