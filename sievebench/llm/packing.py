"""Filling containers of fixed capacity by bounded-space online best fit.

Each task keeps at most ``open_bins`` open containers in a bitset keyed by their free space: the lowest set bit at or
above an item's size is the best fit, found without a search. When nothing fits and all are open, the fullest closes.
Items are taken as they arrive.

What is still open at the end of a task is combined with the leftovers of a bounded number of other tasks by the same
rule, the partly filled containers being the items; so no task holds more than ``merge * open_bins`` of them however
large the input, and the waste is bounded by one set of open containers for ``merge`` tasks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievebench.llm import tokens
from sievebench.session import materialise

CAPACITY = 2048
OPEN_BINS = 128
MERGE = 64


class BestFit:
    """Bounded-space best fit; ``place`` gives the number of the container an item goes to."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be positive")
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.by_free, self.count, self.made = 0, defaultdict(list), 0, 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        one = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return one

    def place(self, size: int) -> int:
        if not 0 < size <= self.capacity:
            raise ValueError(f"size {size} is not in 1..{self.capacity}")
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            one = self._take(free)
        else:
            if self.count >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            one, free = self.made, self.capacity
            self.made += 1
        if rest := free - size:
            self.by_free[rest].append(one)
            self.bits |= 1 << rest
            self.count += 1
        return one

    def open(self) -> list[tuple[int, int]]:
        """``(container, filled)`` of the containers still open."""
        return [(one, self.capacity - free) for free, bins in sorted(self.by_free.items()) for one in bins]


def _pack_task(capacity: int, open_bins: int, path: str, measured: bool) -> Callable:
    """Rows ``(id..., text or size)`` become rows of placed pieces and, at the end, of the open containers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, bins = TaskContext.get().partitionId(), BestFit(capacity, open_bins)
        schema = None
        for batch in batches:
            n = batch.num_columns - 1
            column = batch.column(n)
            sizes = [x or 0 for x in column.to_pylist()] if measured else [len(tokens.encode(x, path)) for x in tokens.texts_of(column)]
            pieces = [
                (min(capacity, size - start), row, start)
                for row, size in enumerate(sizes)
                for start in range(0, max(size, 0), capacity)
            ]
            rows = np.array([x[1] for x in pieces], np.int64)
            ids = [c.take(pa.array(rows)) for c in batch.columns[:n]]
            made = pa.array([bins.place(x[0]) for x in pieces], pa.int64())
            out = [*ids, pa.array([x[2] for x in pieces], pa.int64()), pa.array([x[0] for x in pieces], pa.int32())]
            out += [pa.array([task] * len(pieces), pa.int32()), made, pa.array([False] * len(pieces))]
            names = [*batch.schema.names[:n], "start", "n_tokens", "task", "bin", "is_open"]
            schema = pa.schema([pa.field(a, b.type) for a, b in zip(names, out, strict=True)])
            yield pa.RecordBatch.from_arrays(out, schema=schema)
        left = bins.open()
        if left and schema is not None:
            nulls = [pa.nulls(len(left), schema.field(i).type) for i in range(len(schema) - 5)]
            out = [*nulls, pa.array([0] * len(left), pa.int64()), pa.array([x[1] for x in left], pa.int32())]
            out += [pa.array([task] * len(left), pa.int32()), pa.array([x[0] for x in left], pa.int64()), pa.array([True] * len(left))]
            yield pa.RecordBatch.from_arrays(out, schema=schema)

    return run


def _merge_group(capacity: int, open_bins: int) -> Callable:
    def run(key, rows):
        rows = rows.sort_values(["n_tokens", "task", "bin"], ascending=[False, True, True])
        bins = BestFit(capacity, open_bins)
        rows["merged"] = np.array([bins.place(int(x)) for x in rows["n_tokens"]], np.int64)
        return rows[["task", "bin", "merged"]]

    return run


def pack(
    df: DataFrame,
    *,
    key: str,
    text: str | None = "text",
    size: str | None = None,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    merge: int = MERGE,
    path: str = tokens.RANK_FILE,
) -> DataFrame:
    """``key, piece, start, n_tokens, container`` for every non-empty item.

    Give either ``text``, measured in tokens, or a column ``size``. An item above the capacity is cut into full pieces
    and a rest; items without tokens (null, empty) go nowhere. ``container`` is ``<group>-<number>`` and unique.
    """
    what = F.col(text).cast("binary") if size is None else F.col(size).cast("long")
    rows = df.select(F.col(key).alias("__key"), what.alias("__what"))
    schema = T.StructType(
        [
            T.StructField("__key", rows.schema["__key"].dataType),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.IntegerType()),
            T.StructField("task", T.IntegerType()),
            T.StructField("bin", T.LongType()),
            T.StructField("is_open", T.BooleanType()),
        ]
    )
    placed = materialise(rows.mapInArrow(_pack_task(capacity, open_bins, path, size is not None), schema), "packing")
    group = F.floor(F.col("task") / merge).cast("int")
    merged = (
        placed.filter("is_open")
        .groupBy(group.alias("grp"))
        .applyInPandas(_merge_group(capacity, merge * open_bins), "task int, bin long, merged long")
    )
    named = F.when(F.col("merged").isNotNull(), F.concat(F.lit("m"), group, F.lit("-"), F.col("merged"))).otherwise(
        F.concat(F.lit("t"), F.col("task"), F.lit("-"), F.col("bin"))
    )
    return (
        placed.filter(~F.col("is_open"))
        .join(merged, ["task", "bin"], "left")
        .select(
            F.col("__key").alias(key),
            (F.col("start") / capacity).cast("int").alias("piece"),
            "start",
            "n_tokens",
            named.alias("container"),
        )
    )


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the share of room used, and the fewest containers any packing needs."""
    return packed.agg(
        F.count_distinct("container").alias("containers"),
        F.sum("n_tokens").alias("tokens"),
    ).select(
        "containers",
        "tokens",
        F.ceil(F.col("tokens") / capacity).alias("least"),
        F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("used"),
    )
