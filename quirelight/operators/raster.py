"""Ink of pages: connected blobs, lettering inside solid blocks, orphan glyphs, stacks read as one word.

A page's ink is a table of runs, (page, kind, x, y, w, h) with kind ``ink``: w pixels from x in row y.
Boxes that a rule compares ink with are rows of the same table under other kinds: ``word`` (recognised
words), ``text`` (letters of the text layer), ``region`` (regions to cut). Pages are dealt to tasks by
their key and worked on one at a time; many small ones share a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rect = tuple[float, float, float, float]  # left, top, right, bottom

#: Size of a letter in points, its shape; solid blocks; orphans and stacks in line heights.
LETTER = {"least": 2.5, "most": 30.0, "aspect": 8.0, "fill": 0.18}
BLOCK = {"fill": 0.6, "least_area": 180.0, "most_share": 0.25}
ORPHAN = {"clear": 0.4, "clear_y": 0.15, "least": 0.4, "most": 1.2, "wide": 1.5, "join": 0.35, "near": 15.0, "column": 0.5}
STACK = {"tall": 2.5, "wide": 2.5, "gap": 0.15, "row": 1.15, "rule": 0.9, "speck": 0.3}


def by_page(rows: DataFrame, page: str, order: Sequence[str], run: Callable[[dict[str, list]], list[tuple]], fields: Sequence[T.StructField]) -> DataFrame:
    """page and ``fields`` for what ``run`` makes of each page's columns, its rows in this order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [c for c in rows.columns if c != page]
    schema = T.StructType([rows.schema[page], *fields])
    arrow = to_arrow_schema(schema)

    def made(table: pa.Table, ends: list[int]) -> Iterator[pa.RecordBatch]:
        keys, columns = table.column(page), {c: table.column(c).to_pylist() for c in names}
        out, start = [], 0
        for end in ends:
            key = keys[start].as_py()
            out += [(key, *r) for r in run({c: v[start:end] for c, v in columns.items()})]
            start = end
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for part in parts:
            table = pa.Table.from_batches([part])
            table = pa.concat_tables([held, table]) if held else table
            keys = table.column(page).to_pylist()
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
            if ends:  # the last page may go on in the next batch
                yield from made(table.slice(0, ends[-1]), ends)
            held = table.slice(ends[-1] if ends else 0)
        if held:
            yield from made(held, [len(held)])

    return rows.repartition(page).sortWithinPartitions(page, *order).mapInArrow(batches, schema)


def labelled(ink: np.ndarray, diagonal: bool = True) -> tuple[list[tuple[int, int, int]], list[int]]:
    """(runs as row, begin, end; the blob of each) of a boolean raster: runs of neighbouring rows join where they touch."""
    parent: list[int] = []
    runs: list[tuple[int, int, int]] = []
    reach = 1 if diagonal else 0

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above: list[int] = []
    for y, row in enumerate(np.asarray(ink, bool)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        here = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            k = len(runs)
            parent.append(k)
            runs.append((y, a, b))
            here.append(k)
            for j in above:
                if runs[j][1] < b + reach and a < runs[j][2] + reach:
                    parent[root(j)] = root(k)
        above = here
    return runs, [root(i) for i in range(len(runs))]


def components(ink: np.ndarray, diagonal: bool = True) -> list[tuple[int, int, int, int, int]]:
    """(x, y, width, height, pixels) of the connected blobs."""
    blobs: dict[int, tuple[int, int, int, int, int]] = {}
    for (y, a, b), k in zip(*labelled(ink, diagonal)):
        x0, y0, x1, y1, n = blobs.get(k, (a, y, b, y + 1, 0))
        blobs[k] = (min(x0, a), min(y0, y), max(x1, b), max(y1, y + 1), n + b - a)
    return sorted((x0, y0, x1 - x0, y1 - y0, n) for x0, y0, x1, y1, n in blobs.values())


def glyph_like(found: Sequence[tuple[int, int, int, int, int]], points_per_pixel: float) -> list[tuple[int, int, int, int, int]]:
    """Blobs of a letter's size and shape."""
    p = points_per_pixel
    return [b for b in found if LETTER["least"] <= b[3] * p <= LETTER["most"] and b[2] * p <= LETTER["most"]
            and max(b[2], b[3]) <= LETTER["aspect"] * min(b[2], b[3]) and b[4] >= LETTER["fill"] * b[2] * b[3]]


def enclosed(ink: np.ndarray) -> np.ndarray:
    """The blank pixels that no path of blank pixels, side by side, joins to the raster's edge."""
    blank = ~np.asarray(ink, bool)
    high, wide = blank.shape
    runs, of = labelled(blank, diagonal=False)
    outside = {k for (y, a, b), k in zip(runs, of) if y in (0, high - 1) or a == 0 or b == wide}
    out = np.zeros_like(blank)
    for (y, a, b), k in zip(runs, of):
        if k not in outside:
            out[y, a:b] = True
    return out


def holes_in_blocks(ink: np.ndarray, text: Sequence[Rect], points_per_pixel: float) -> list[tuple[int, int, int, int, int]]:
    """Letters left blank in solid blocks, not those whose middle a box of the text layer holds."""
    high, wide = ink.shape
    out = []
    for x, y, w, h, n in components(ink):
        if n < BLOCK["fill"] * w * h or w * h * points_per_pixel**2 < BLOCK["least_area"] or w * h > BLOCK["most_share"] * high * wide:
            continue
        for a, b, c, d, k in glyph_like(components(enclosed(ink[y:y + h, x:x + w])), points_per_pixel):
            mid_x, mid_y = x + a + c / 2, y + b + d / 2
            if not any(l <= mid_x <= r and t <= mid_y <= u for l, t, r, u in text):  # noqa: E741
                out.append((x + a, y + b, c, d, k))
    return sorted(out)


def orphans(ink: np.ndarray, words: Sequence[Rect], line: float) -> list[Rect]:
    """Glyphs of a line's size that stand clear of all words, between two words of their row, three or more in a column.

    words: boxes of recognised words; line: the page's line height.
    """
    boxes = np.array(words, float).reshape(-1, 4)
    wide, high = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
    size = np.where(wide > high, np.maximum(line, high), line)  # a word taller than wide is a stack, not big lettering
    clear = boxes + np.stack([-ORPHAN["clear"] * size, -ORPHAN["clear_y"] * size, ORPHAN["clear"] * size, ORPHAN["clear_y"] * size], axis=1)
    mates = boxes[high > STACK["speck"] * line]

    def free(r: Rect) -> bool:
        return not ((clear[:, 0] <= r[2]) & (r[0] <= clear[:, 2]) & (clear[:, 1] <= r[3]) & (r[1] <= clear[:, 3])).any()

    glyphs = [(float(x), float(y), float(x + w), float(y + h)) for x, y, w, h, _ in components(ink)
              if ORPHAN["least"] * line <= h <= ORPHAN["most"] * line and w <= ORPHAN["wide"] * line]
    joined = _glued(sorted(filter(free, glyphs)), line)

    def between(c: list[float]) -> bool:
        middle, tall = (c[1] + c[3]) / 2, c[3] - c[1]
        rows = mates[(mates[:, 1] < middle) & (middle < mates[:, 3])]
        rows = rows[(rows[:, 3] - rows[:, 1] >= 0.8 * tall) & (rows[:, 3] - rows[:, 1] <= 2.2 * tall)]
        rows = rows[np.minimum(np.abs(rows[:, 0] - c[2]), np.abs(c[0] - rows[:, 2])) < ORPHAN["near"] * line]
        return bool((rows[:, 2] <= c[0]).any() and (rows[:, 0] >= c[2]).any())

    held = [c for c in joined if between(c)]
    centres = np.array([(c[0] + c[2]) / 2 for c in held])
    return [tuple(c) for c, m in zip(held, centres) if (np.abs(centres - m) < ORPHAN["column"] * line).sum() >= 3]


def is_stack(region: Rect, line: float) -> bool:
    w, h = region[2] - region[0], region[3] - region[1]
    return h >= STACK["tall"] * line and h >= w and w <= STACK["wide"] * line


def stack_rows(ink: np.ndarray, region: Rect, line: float) -> list[Rect]:
    """The rows of ink in a region, a rule beside them left out; none unless there are two, set apart as rows of a table are."""
    high, wide = ink.shape
    x0, y0 = max(0, int(np.floor(region[0]))), max(0, int(np.floor(region[1])))
    x1, y1 = min(wide - 1, int(np.ceil(region[2]))), min(high - 1, int(np.ceil(region[3])))
    if x1 <= x0 or y1 <= y0:
        return []
    part = np.array(ink[y0:y1 + 1, x0:x1 + 1], bool)
    margin = max(2, int(np.rint(0.1 * line)))
    for x in np.flatnonzero(part.sum(axis=0) >= STACK["rule"] * len(part)):
        part[:, max(0, x - margin):x + margin + 1] = False
    runs: list[list[int]] = []
    for y in np.flatnonzero(part.any(axis=1)).tolist():
        if runs and y - runs[-1][1] <= 2:  # one blank row lies inside a glyph
            runs[-1][1] = y
        else:
            runs.append([y, y])
    runs = [r for r in runs if r[1] - r[0] + 1 >= STACK["speck"] * line]
    gaps = sorted(b[0] - a[1] - 1 for a, b in zip(runs, runs[1:]))
    if not gaps or gaps[len(gaps) // 2] < STACK["gap"] * line:
        return []
    out = []
    for a, b in runs:
        inked = np.flatnonzero(part[a:b + 1].any(axis=0))
        out.append((float(x0 + inked[0]), float(y0 + a), float(x0 + inked[-1] + 1), float(y0 + b + 1)))
    return out


def of_a_table(rows: Sequence[Rect], words: Sequence[Rect], line: float) -> bool:
    """Whether all rows (but one of four or more) have a word of about their height beside them, and are no taller than a line."""
    if not rows:
        return False
    boxes = np.array([w for w in words if w[3] - w[1] > STACK["speck"] * line], float).reshape(-1, 4)
    tall = np.array([r[3] - r[1] for r in rows])
    on = 0
    for r, t in zip(rows, tall):
        middle, h = (r[1] + r[3]) / 2, boxes[:, 3] - boxes[:, 1]
        near = np.minimum(np.abs(boxes[:, 0] - r[2]), np.abs(r[0] - boxes[:, 2])) < ORPHAN["near"] * line
        on += bool(((boxes[:, 1] < middle) & (middle < boxes[:, 3]) & (h >= 0.8 * t) & (h <= 2.2 * t) & near).any())
    return on >= len(rows) - (len(rows) >= 4) and float(np.sort(tall)[len(tall) // 2]) <= STACK["row"] * line


def word_cuts(ink: np.ndarray, row: Rect, centres: Sequence[float]) -> list[Rect]:
    """Boxes of the words of a row, told apart at the widest blank run between each two centres, each shrunk to its ink."""
    high, wide = ink.shape
    top, bottom = max(0, int(row[1])), min(high, int(np.ceil(row[3])))
    inked = np.asarray(ink[top:bottom], bool).any(axis=0)
    cuts = [row[0]]
    for a, b in zip(centres, centres[1:]):
        lo, hi = max(0, int(np.ceil(min(a, b)))), min(wide - 1, int(np.floor(max(a, b))))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (~inked[lo:hi + 1]).astype(np.int8), [0]])))
        size = edge[1::2] - edge[::2]
        cuts.append(lo + float(edge[::2][size.argmax()]) + size.max() / 2 if len(size) else (a + b) / 2)
    out = []
    for a, b in zip(cuts, [*cuts[1:], row[2]]):
        lo = max(0, int(np.floor(a)))
        found = np.flatnonzero(inked[lo:min(wide, int(np.ceil(b)))])
        out.append((float(lo + found[0]), row[1], float(lo + found[-1] + 1), row[3]) if len(found) else (a, row[1], b, row[3]))
    return out


def _raster(page: dict[str, list]) -> tuple[np.ndarray, dict[str, list[Rect]]]:
    """(ink, boxes by kind) of one page's rows."""
    boxes: dict[str, list[Rect]] = {}
    for kind, x, y, w, h in zip(*(page[c] for c in ("kind", "x", "y", "w", "h"))):
        boxes.setdefault(kind, []).append((x, y, x + w, y + h))
    runs = boxes.pop("ink", [])
    ink = np.zeros((int(max((r[3] for r in runs), default=0)), int(max((r[2] for r in runs), default=0))), bool)
    for a, y, b, _ in runs:
        ink[int(y), int(a):int(b)] = True
    return ink, boxes


class Boxes(NamedTuple):
    """Boxes of many pages: the number of each box's page, and its sides. Pages stand in order."""

    page: np.ndarray
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    h: np.ndarray

    def of(self, held: np.ndarray) -> Boxes:
        return Boxes(*(c[held] for c in self))


def gathered(rows: DataFrame, page: str, kinds: Sequence[str]) -> DataFrame:
    """A row for each page with an array of (x, y, w, h) for each kind."""
    return rows.groupBy(page).agg(*(F.collect_list(F.when(F.col("kind") == k, F.struct("x", "y", "w", "h"))).alias(k) for k in kinds))


def on_pages(pages: DataFrame, page: str, kinds: Sequence[str], run: Callable, one: Callable, fields: Sequence[T.StructField]) -> DataFrame:
    """page and ``fields`` of pages(page, an array of boxes for each kind, ink first): ``run`` works on the boxes of a batch of pages at once and returns the pages' numbers and the columns.

    ``one`` works on the raster and boxes of one page, and does so for pages whose ink lies off the raster.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([pages.schema[page], *fields])
    arrow = to_arrow_schema(schema)

    def boxes(lists: pa.Array) -> Boxes:
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        return Boxes(np.repeat(np.arange(len(size)), size), *(pc.struct_field(flat, [c]).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "xywh"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            held = [boxes(part.column(k)) for k in kinds]
            odd = odd_pages(held[0], part.num_rows)
            at, columns = run(*(b.of(~odd[b.page]) for b in held)) if odd.any() else run(*held)
            yield pa.RecordBatch.from_arrays([part.column(page).take(pa.array(at)), *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[1:]))], schema=arrow)
            for n in np.flatnonzero(odd):
                mine = {k: list(zip(*(c.tolist() for c in b.of(b.page == n)[1:]))) for k, b in zip(kinds, held)}
                ink, rects = _raster({"kind": [k for k in kinds for _ in mine[k]], **{c: [r[i] for k in kinds for r in mine[k]] for i, c in enumerate("xywh")}})
                if rows := one(ink, *(rects.get(k, []) for k in kinds[1:])):
                    yield pa.RecordBatch.from_arrays([part.column(page).take(pa.array([n] * len(rows))), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(arrow)[1:]))], schema=arrow)

    return pages.select(page, *kinds).mapInArrow(batches, schema)


def odd_pages(ink: Boxes, pages: int, widest: float = 2.0**20) -> np.ndarray:
    """Pages with ink that is no run on a raster: before its edges, of no height, without a number, or beyond what the keys of runs hold."""
    with np.errstate(invalid="ignore"):
        right = (ink.x >= 0) & (ink.y >= 0) & (ink.w >= 0) & (ink.h >= 1) & (ink.x + ink.w < widest) & (ink.y + ink.h < widest)
    out = np.zeros(pages, bool)
    out[ink.page[~right]] = True
    return out


def pairs(first: np.ndarray, size: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for every j of first[i] ... first[i] + size[i] - 1, some ``most`` at a time."""
    total, start = np.concatenate([[0], np.cumsum(size)]), 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(total, total[start] + most, "right")) - 1)
        i = np.repeat(np.arange(start, stop), size[start:stop])
        yield i, np.arange(len(i)) - np.repeat(total[start:stop] - total[start] - first[start:stop], size[start:stop])
        start = stop


def with_those_of(page: np.ndarray, boxes: Boxes) -> tuple[np.ndarray, np.ndarray]:
    """(first, size): the boxes of the same page."""
    first = np.searchsorted(boxes.page, page)
    return first, np.searchsorted(boxes.page, page, "right") - first


def runs_of_pages(ink: Boxes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(line, begin, end, lines a page): the inked runs of all pages, in order, those that touch made one; a page's rows are so many lines, of which the last is blank."""
    line, a, b = ink.y.astype(np.int64), ink.x.astype(np.int64), (ink.x + ink.w).astype(np.int64)
    lines = int(line.max(initial=0)) + 2
    line += ink.page * lines
    wide = int(b.max(initial=0)) + 1
    line, a, b = (c[a < b] for c in (line, a, b))
    key = line * wide + a
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        line, a, b, key = line[order], a[order], b[order], key[order]
    new = np.concatenate([[True], key[1:] > np.maximum.accumulate(line * wide + b)[:-1]])[:len(key)]
    at = np.flatnonzero(new)
    return line[at], a[at], np.maximum.reduceat(b, at) if len(at) else b, lines


def blob_of_runs(line: np.ndarray, a: np.ndarray, b: np.ndarray, diagonal: bool = True) -> np.ndarray:
    """The first run of the blob of each; runs in order, apart from each other, join those they touch in the line before."""
    reach, wide = int(diagonal), int(b.max(initial=0)) + 3
    first = np.searchsorted(line * wide + b + 1, (line - 1) * wide + a + 1 - reach, "right")
    size = np.maximum(np.searchsorted(line * wide + a + 1, (line - 1) * wide + b + 1 + reach) - first, 0)
    found = list(pairs(first, size, 1 << 62))
    u, v = found[0] if found else (line[:0], line[:0])
    root = np.arange(len(line))
    while len(u):
        root[np.maximum(u, v)] = np.minimum(u, v)
        while ((up := root[root]) != root).any():
            root = up
        u, v = root[u], root[v]
        u, v = u[apart := u != v], v[apart]
    return root


def boxes_of_runs(line: np.ndarray, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first line, x, width, height, pixels) of each blob."""
    order = np.argsort(root, kind="stable")
    line, a, b, root = line[order], a[order], b[order], root[order]
    at = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]])[:len(root)])
    if not len(at):
        return (line,) * 5
    top, x = np.minimum.reduceat(line, at), np.minimum.reduceat(a, at)
    return top, x, np.maximum.reduceat(b, at) - x, np.maximum.reduceat(line, at) + 1 - top, np.add.reduceat(b - a, at)


def holes_of_pages(ink: Boxes, text: Boxes, points_per_pixel: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """What ``holes_in_blocks`` finds, of many pages at once."""
    line, a, b, lines = runs_of_pages(ink)
    top, x, w, h, n = boxes_of_runs(line, a, b, blob_of_runs(line, a, b))
    starts = np.flatnonzero(np.concatenate([[True], ink.page[1:] != ink.page[:-1]])[:len(ink.page)])
    high, wide = np.zeros((2, int(ink.page.max(initial=-1)) + 1))
    if len(starts):
        high[ink.page[starts]], wide[ink.page[starts]] = (np.floor(np.maximum.reduceat(c, starts)) for c in (ink.y + ink.h, ink.x + ink.w))
    page = top // lines
    block = ~((n < BLOCK["fill"] * w * h) | (w * h * points_per_pixel**2 < BLOCK["least_area"]) | (w * h > BLOCK["most_share"] * high[page] * wide[page]))
    page, top, x, w, h = (c[block] for c in (page, top, x, w, h))
    # the ink inside each block's box, and the blanks between
    first = np.searchsorted(line, top)
    found = list(pairs(first, np.searchsorted(line, top + h) - first, 1 << 62))
    k, i = found[0] if found else (line[:0], line[:0])
    left, right, row = np.maximum(a[i], x[k]), np.minimum(b[i], x[k] + w[k]), line[i]
    k, left, right, row = (c[left < right] for c in (k, left, right, row))
    same = (k[1:] == k[:-1]) & (row[1:] == row[:-1])
    begins, ends = np.concatenate([[True], ~same])[:len(k)], np.concatenate([~same, [True]])[:len(k)]
    gap_k, gap_row = (np.concatenate([c[begins], c[:-1][same], c[ends]]) for c in (k, row))
    gap_a = np.concatenate([x[k[begins]], right[:-1][same], right[ends]])
    gap_b = np.concatenate([left[begins], left[1:][same], (x + w)[k[ends]]])
    there = gap_a < gap_b
    gap_k, gap_row, gap_a, gap_b = (c[there] for c in (gap_k, gap_row, gap_a, gap_b))
    step = int(h.max(initial=0)) + 2
    gap_line = gap_k * step + gap_row - top[gap_k]
    order = np.lexsort((gap_a, gap_line))
    gap_k, gap_row, gap_a, gap_b, gap_line = (c[order] for c in (gap_k, gap_row, gap_a, gap_b, gap_line))
    edge = (gap_row == top[gap_k]) | (gap_row == (top + h)[gap_k] - 1) | (gap_a == x[gap_k]) | (gap_b == (x + w)[gap_k])
    root = blob_of_runs(gap_line, gap_a, gap_b, diagonal=False)
    outside = np.zeros(len(root), bool)
    outside[root[edge]] = True
    gap_line, gap_a, gap_b = (c[~outside[root]] for c in (gap_line, gap_a, gap_b))
    hole_line, hole_x, c, d, n = boxes_of_runs(gap_line, gap_a, gap_b, blob_of_runs(gap_line, gap_a, gap_b))
    p = points_per_pixel
    like = (LETTER["least"] <= d * p) & (d * p <= LETTER["most"]) & (c * p <= LETTER["most"]) & (np.maximum(c, d) <= LETTER["aspect"] * np.minimum(c, d)) & (n >= LETTER["fill"] * c * d)
    hole_line, hole_x, c, d, n = (v[like] for v in (hole_line, hole_x, c, d, n))
    k = hole_line // step
    page, hole_y = page[k], hole_line - k * step + top[k] - page[k] * lines
    mid_x, mid_y = hole_x + c / 2, hole_y + d / 2
    told = np.zeros(len(page), bool)
    for g, t in pairs(*with_those_of(page, text)):
        l, u = text.x[t], text.y[t]  # noqa: E741
        told[g[(l <= mid_x[g]) & (mid_x[g] <= l + text.w[t]) & (u <= mid_y[g]) & (mid_y[g] <= u + text.h[t])]] = True
    return page[~told], [v[~told] for v in (*(np.asarray(v, float) for v in (hole_x, hole_y, c, d)), n)]


def _glued(glyphs: list[list[float]], line: float) -> list[list[float]]:
    """Sorted glyphs (left, top, right, bottom), those that begin inside or close behind another of their height joined to the first such."""
    out: list[list[float]] = []
    for g in glyphs:
        for m in out:
            together = min(m[3], g[3]) - max(m[1], g[1])
            if m[0] <= g[0] <= m[2] + ORPHAN["join"] * line and together > 0.5 * min(m[3] - m[1], g[3] - g[1]):
                m[:] = [m[0], min(m[1], g[1]), max(m[2], g[2]), max(m[3], g[3])]
                break
        else:
            out.append(list(g))
    return out


def orphans_of_pages(ink: Boxes, words: Boxes, line: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """What ``orphans`` finds, of many pages at once."""
    row, a, b, lines = runs_of_pages(ink)
    top, x, w, h, _ = boxes_of_runs(row, a, b, blob_of_runs(row, a, b))
    fit = (ORPHAN["least"] * line <= h) & (h <= ORPHAN["most"] * line) & (w <= ORPHAN["wide"] * line)
    top, x, w, h = (c[fit] for c in (top, x, w, h))
    page = top // lines
    y = top - page * lines
    box = np.stack([x, y, x + w, y + h], axis=1).astype(float)
    order = np.lexsort((box[:, 3], box[:, 2], box[:, 1], box[:, 0], page))
    page, box = page[order], box[order]
    word = np.stack([words.x, words.y, words.x + words.w, words.y + words.h], axis=1)
    wide, high = word[:, 2] - word[:, 0], word[:, 3] - word[:, 1]
    size = np.where(wide > high, np.maximum(line, high), line)
    clear = word + np.stack([-ORPHAN["clear"] * size, -ORPHAN["clear_y"] * size, ORPHAN["clear"] * size, ORPHAN["clear_y"] * size], axis=1)
    met = np.zeros(len(page), bool)
    for g, t in pairs(*with_those_of(page, words)):
        met[g[(clear[t, 0] <= box[g, 2]) & (box[g, 0] <= clear[t, 2]) & (clear[t, 1] <= box[g, 3]) & (box[g, 1] <= clear[t, 3])]] = True
    page, box = page[~met], box[~met]

    # glyphs are joined one after the other, which matters only on pages where any two can be
    close = np.zeros(len(page), bool)
    for g, t in pairs(np.arange(1, len(page) + 1), np.searchsorted(page, page, "right") - np.arange(1, len(page) + 1)):
        together = np.minimum(box[g, 3], box[t, 3]) - np.maximum(box[g, 1], box[t, 1])
        close[g[(box[t, 0] <= box[g, 2] + ORPHAN["join"] * line) & (together > 0.5 * np.minimum(box[g, 3] - box[g, 1], box[t, 3] - box[t, 1]))]] = True
    for n in np.unique(page[close]).tolist():
        mine = page == n
        glued = np.array(_glued(box[mine].tolist(), line))
        at = int(np.searchsorted(page, n))
        page, box = np.concatenate([page[~mine][:at], np.full(len(glued), n), page[~mine][at:]]), np.concatenate([box[~mine][:at], glued, box[~mine][at:]])

    mate = high > STACK["speck"] * line
    mates, word = words.of(mate), word[mate]
    sides, middle, tall = np.zeros((2, len(page)), bool), (box[:, 1] + box[:, 3]) / 2, box[:, 3] - box[:, 1]
    for g, t in pairs(*with_those_of(page, mates)):
        height = word[t, 3] - word[t, 1]
        ok = (word[t, 1] < middle[g]) & (middle[g] < word[t, 3]) & (height >= 0.8 * tall[g]) & (height <= 2.2 * tall[g])
        ok &= np.minimum(np.abs(word[t, 0] - box[g, 2]), np.abs(box[g, 0] - word[t, 2])) < ORPHAN["near"] * line
        sides[0, g[ok & (word[t, 2] <= box[g, 0])]] = True
        sides[1, g[ok & (word[t, 0] >= box[g, 2])]] = True
    page, box = page[held := sides.all(axis=0)], box[held]
    centre, column, first = (box[:, 0] + box[:, 2]) / 2, np.zeros(len(page), np.int64), np.searchsorted(page, page)
    for g, t in pairs(first, np.searchsorted(page, page, "right") - first):
        column += np.bincount(g[np.abs(centre[t] - centre[g]) < ORPHAN["column"] * line], minlength=len(page))
    page, box = page[column >= 3], box[column >= 3]
    return page, [box[:, 0], box[:, 1], box[:, 2] - box[:, 0], box[:, 3] - box[:, 1]]


_BOX = [T.StructField(n, T.DoubleType()) for n in "xywh"]
_PIXELS = T.StructField("pixels", T.LongType())
_ORDER = ("kind", "y", "x", "w", "h")


def blobs(rows: DataFrame, page: str = "page_id") -> DataFrame:
    """page, x, y, w, h, pixels of the 8-connected blobs of rows(page, kind, x, y, w, h). A page without ink has none."""
    return by_page(rows.filter("kind = 'ink'"), page, _ORDER, lambda p: [(*map(float, b[:4]), b[4]) for b in components(_raster(p)[0])], [*_BOX, _PIXELS])


def reversed_letters(rows: DataFrame, points_per_pixel: float, page: str = "page_id") -> DataFrame:
    """page, x, y, w, h, pixels of the letters left blank in solid blocks, those under ``text`` boxes left out."""
    return reversed_on_pages(gathered(rows, page, ["ink", "text"]), points_per_pixel, page)


def reversed_on_pages(pages: DataFrame, points_per_pixel: float, page: str = "page_id") -> DataFrame:
    """The same of pages(page, ink, text), a row each with arrays of (x, y, w, h), and without a shuffle."""
    one = lambda ink, text: holes_in_blocks(ink, text, points_per_pixel)
    return on_pages(pages, page, ["ink", "text"], lambda ink, text: holes_of_pages(ink, text, points_per_pixel), one, [*_BOX, _PIXELS])


def orphan_glyphs(rows: DataFrame, line: float, page: str = "page_id") -> DataFrame:
    """page, x, y, w, h of ink that stands in a column between words of its rows; ``word`` rows are the recognised words."""
    return orphans_on_pages(gathered(rows, page, ["ink", "word"]), line, page)


def orphans_on_pages(pages: DataFrame, line: float, page: str = "page_id") -> DataFrame:
    """The same of pages(page, ink, word), a row each with arrays of (x, y, w, h), and without a shuffle."""
    one = lambda ink, words: [(a, b, c - a, d - b) for a, b, c, d in orphans(ink, words, line)]
    return on_pages(pages, page, ["ink", "word"], lambda ink, words: orphans_of_pages(ink, words, line), one, _BOX)


def cut_stacks(rows: DataFrame, line: float, page: str = "page_id") -> DataFrame:
    """page, region (from 0, in order of y and x), x, y, w, h, table of the rows into which tall ``region`` boxes are cut."""

    def run(p: dict[str, list]) -> list[tuple]:
        ink, boxes = _raster(p)
        out = []
        for k, region in enumerate(boxes.get("region", [])):
            if is_stack(region, line):
                cut = stack_rows(ink, region, line)
                table = of_a_table(cut, boxes.get("word", []), line)
                out += [(k, a, b, c - a, d - b, table) for a, b, c, d in cut]
        return out

    return by_page(rows, page, _ORDER, run, [T.StructField("region", T.IntegerType()), *_BOX, T.StructField("table", T.BooleanType())])
