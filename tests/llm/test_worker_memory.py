"""What a worker holds in one step, and what it keeps for the next: Spark uses workers again."""

from __future__ import annotations

import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa

from quirelight.llm import packing, quality
from quirelight.llm.textbytes import giving_back, lots, text_bytes


def test_lots_bound_what_the_classifier_holds():
    rng = np.random.default_rng(3)
    data, offsets = text_bytes(pa.array([" ".join(map(str, rng.integers(0, 10**6, 300))) for _ in range(2_500)]))
    assert len(data) > 5_000_000
    model = quality.fit([("plain words of prose " * 30, 1), ("x9 ## " * 90, 0)], 0.5)
    tracemalloc.start()
    scores = [model.scores(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])[0] for a, b in lots(offsets)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, scores)) == 2_500 and peak < 60e6


def test_unit_table_stays_small_and_right():
    units, alphabet = packing.Units(packing.word_bpe_path()), np.array(list("abcdefghijklmnopqrstuvwxyz"))
    word = lambda i: "".join(alphabet[(i // 26 ** np.arange(4)) % 26])
    texts = [" ".join(map(word, range(first, first + 10_000))) for first in (*range(0, 400_000, 10_000), 0)]
    data, offsets = text_bytes(pa.array(texts))
    got = [ids for a, b in lots(offsets) for ids in packing._doc_ids(units, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])]
    kept = (units.known, units.at, units.begin, units.count, units.ids, units.place, units.size, units.bytes)
    assert sum(x.nbytes for x in kept) < 18e6
    for k in (0, 39, 40):
        assert got[k].tolist() == units.whole.encode(texts[k], add_special_tokens=False).ids


def test_a_worker_returns_what_it_has_freed():
    def anonymous():
        return int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    def run(batches):
        held = [np.ones(60_000, np.uint8) for _ in range(3_000)]
        kept.append(np.ones(60_000, np.uint8))  # above the others, so that they stay with the process
        yield from batches
        assert len(held) == 3_000

    kept: list[np.ndarray] = []
    before = anonymous()
    assert list(giving_back(run)(iter([1, 2]))) == [1, 2]
    assert anonymous() - before < 60
