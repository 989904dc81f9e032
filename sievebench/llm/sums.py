"""Sums of small matrices over tasks: each task gives its rows, which are summed in parallel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def rows_of(name: int, values: np.ndarray) -> pa.RecordBatch:
    """The nonzero rows of a matrix as ``which, row, numbers``."""
    rows = np.flatnonzero(np.abs(values).sum(1) > 0)
    flat = np.ascontiguousarray(values[rows], np.float64)
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * len(rows), pa.int32()), pa.array(rows, pa.int32()), pa.array([x.tobytes() for x in flat], pa.binary())],
        ["which", "row", "numbers"],
    )


ROWS = "which int, row int, numbers binary"


def sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for which, row, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = np.frombuffer(numbers, np.float64)
            sums[which, row] = sums[which, row] + x if (which, row) in sums else x
    keys = list(sums)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())],
        ["which", "row", "numbers"],
    )


def total_rows(partial: DataFrame, shapes: dict[int, tuple[int, int]]) -> dict[int, np.ndarray]:
    """Sums of the tasks' matrices; rows are summed in parallel, and only one matrix of each kind is collected."""
    out = {which: np.zeros(shape) for which, shape in shapes.items()}
    for which, row, numbers in partial.repartition("which", "row").mapInArrow(sum_rows, ROWS).collect():
        out[which][row] = np.frombuffer(numbers, np.float64)
    return out
