"""What tasks of the joins of texts hold at once."""

import tracemalloc
from fractions import Fraction

import numpy as np
import pyarrow as pa

from sievebench.llm import overlap

T = Fraction("0.7")


def blob(records, posted):
    return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.array([len(records)], "<u4").tobytes() + records.tobytes() + posted.tobytes()], pa.binary())], ["part", "blob"])


def alike(n):
    """Records of 100 words that share a chunk and pass all bounds in pairs."""
    records, posted = np.zeros(n, overlap.RECORD), np.zeros(n, overlap.POSTED)
    records["bag"], records["n"] = np.arange(n), 100
    posted["rec"], posted["pos"], posted["low"], posted["len"], posted["level"] = np.arange(n), 1, overlap._NONE, 10, 1
    return records, posted


def peak(run):
    tracemalloc.start()
    found = list(run())
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return found, top


def test_pairs_of_a_chunk_are_not_all_held():
    """4,000 records give 8 million pairs; within a chunk and between two blocks of it."""
    found, top = peak(lambda: overlap._meet(T, 8192, False)(iter([blob(*alike(4000))])))
    assert sorted(x for b in found for x in b.column(2).to_pylist()) == list(range(4000))
    assert len({x for b in found for x in b.column(1).to_pylist()}) == 1 and top < 100e6
    blocks = list(overlap._meet(T, 2000, False)(iter([blob(*alike(4000))])))
    assert [b.column(0).to_pylist() for b in blocks] == [[1]] * 3
    found, top = peak(lambda: overlap._meet_blocks(T, False)(iter(blocks)))
    assert {x for b in found for x in b.column(2).to_pylist()} == set(range(4000)) and top < 100e6


def test_pairs_across_sides_go_out_in_pieces(monkeypatch):
    monkeypatch.setattr(overlap, "PAIRS", 1000, raising=False)
    records, posted = alike(400)
    records["c"] = np.arange(400) % 2
    found = list(overlap._meet(T, 8192, True)(iter([blob(records, posted)])))
    pairs = [p for b in found for p in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
    assert len(pairs) == len(set(pairs)) == 200 * 200 and len(found) > 1


def test_parts_hold_what_they_are_meant_to(monkeypatch):
    """With many parts a record's head travels with hardly more than one chunk, which the number of parts allows for."""
    monkeypatch.setattr(overlap, "PART_BYTES", 1 << 16)
    rng = np.random.default_rng(8)
    n, size = 3000, 50
    cold = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(np.sort(rng.integers(-(1 << 62), 0, (n, size)), axis=1).ravel()))
    hot = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1), pa.int32()), pa.array([], pa.int32()))
    rows = pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), pa.array(np.arange(n)), cold, hot, pa.array([0] * n, pa.int64())], ["side", "bag", "cold", "hot", "salt"])
    parts = overlap.parts_of(n, n * size, 4)
    held = np.zeros(parts)

    class Shared:
        value: dict = {}  # no hot words

    for batch in overlap._deal(Shared, T, parts)([rows]):
        for part, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held[part] += len(b)
    assert held.max() < 1.5 * (1 << 16) and overlap.parts_of(0, 0, 4) == 4
