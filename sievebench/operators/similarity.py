"""Exact similarity joins of a query set with all rows of a collection, in blocks.

Queries are dealt by hash to blocks of about ``QUERY_BLOCK``, a task each, and travel once. Items lie in a table in the
folder that all executors share; each task reads it from there and lets the items stream by, so neither side is copied for
the blocks of the other and nothing passes through the driver or a broadcast. Fewer blocks than tasks that can run are
dealt to several tasks that share the items. A task keeps the k best of each query before anything more is shuffled.

Products are taken in single precision with a bound of their error; what the bound leaves open is decided in double
precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievebench.session import files_of, materialise, opened

QUERY_BLOCK = 32_768
ROWS = 2048
#: Scores are compared after rounding to so many places, so equal vectors tie in every engine.
PLACES = 12


def dense(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column of ``dim`` numbers each as a matrix."""
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)


def in_blocks(queries: DataFrame, items: DataFrame, run: Callable, schema: str, *, dim: int, item_dim: int | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """``run(held, stream)`` for every block of queries and all items, or a share of them.

    ``queries`` has ``qid, vector`` of ``dim`` numbers, ``items`` ``item, vector`` of ``item_dim`` (``dim`` if not given).
    ``held`` is ``(ids, matrix)`` of the block's queries and ``stream`` gives ``(ids, matrix)`` of items in batches; ``run``
    yields record batches of ``schema``. Tasks are as many as can run at once, if there are fewer blocks and rows for them.
    """
    spark = queries.sparkSession
    stored = items if getattr(items, "shared_path", None) else materialise(items.select("item", "vector"), "items")
    n_q, n_i = queries.count(), stored.count()
    q_blocks = max(1, -(-n_q // block))
    shares = max(min(spark.sparkContext.defaultParallelism, -(-n_i // ROWS)) // q_blocks, 1)
    of, every = F.pmod(F.xxhash64("qid"), F.lit(q_blocks)), F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    dealt = queries.select(of.alias("q"), every.alias("share"), "qid", "vector")
    dealt = dealt.select((F.col("q") * shares + F.col("share")).cast("int").alias("task"), "qid", "vector")
    placed = dealt.repartitionById(q_blocks * shares, F.col("task"))
    return placed.mapInArrow(_paired(run, dim, item_dim or dim, files_of(stored), shares), schema)


def _paired(run: Callable, dim: int, item_dim: int, files: list[str], shares: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A partition holds one task's queries; its share of the items are every so many-th batch of the files."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, share = [], [], 0
        for batch in batches:
            if batch.num_rows:
                share = batch.column(0)[0].as_py() % shares
                ids += batch.column(1).to_pylist()
                parts.append(dense(batch.column(2), dim))

        def stream() -> Iterator[tuple[list, np.ndarray]]:
            place = 0
            for file in files:
                with opened(file) as source:
                    for part in pq.ParquetFile(source).iter_batches(ROWS, columns=["item", "vector"]):
                        if place % shares == share and part.num_rows:
                            yield part.column("item").to_pylist(), dense(part.column("vector"), item_dim)
                        place += 1

        if ids:
            yield from run((ids, np.concatenate(parts)), stream())

    return start


def _single(x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The rows in single precision and their lengths; None if they are too long or short for its error to be bounded by these."""
    norms = np.linalg.norm(x, axis=1)
    used = norms[norms > 0]
    if not np.isfinite(norms).all() or len(used) and not 1e-9 < used.min() <= used.max() < 1e9:
        return None
    return x.astype(np.float32), norms


def _error(dim: int) -> float:
    """Bound of the error of a product in single precision, for rows of length 1."""
    return (dim + 8) * 2.0**-23


def _exact(q: np.ndarray, x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for low in range(0, len(rows), 1 << 16):
        out[low : low + (1 << 16)] = np.einsum("ij,ij->i", q[rows[low : low + (1 << 16)]], x[columns[low : low + (1 << 16)]])
    return np.round(out, PLACES)


def _best(k: int, apart: bool) -> Callable:
    """The k best items of each held query."""

    def run(held: tuple[list, np.ndarray], stream: Iterator[tuple[list, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        qids, q = held
        best: list[list[tuple]] = [[] for _ in qids]  # (minus score, item), in order
        kth = np.full(len(qids), -np.inf)
        want = k + 1 if apart else k
        coarse = _single(q)
        for own, x in stream:
            fine = _single(x) if coarse else None
            a, b = (coarse[0], fine[0]) if fine else (q, x)
            bound = _error(x.shape[1]) * coarse[1] * fine[1].max() if fine else np.zeros(len(qids))
            for low in range(0, len(qids), ROWS):
                s, err = a[low : low + ROWS] @ b.T, bound[low : low + ROWS]
                floor = kth[low : low + ROWS]
                groups = min(len(own), 8 * want)
                if groups >= want and not np.isfinite(floor).all():
                    # the want-th largest of group maxima is at most the want-th largest score
                    width = len(own) // groups
                    tops = s[:, : groups * width].reshape(len(s), groups, width).max(2)
                    floor = np.maximum(floor, np.partition(tops, groups - want, axis=1)[:, groups - want] - err)
                least = (floor - err - 1e-9).astype(s.dtype)
                least = np.nextafter(least, s.dtype.type(-np.inf))  # rounded down
                rows, columns = np.divmod(np.flatnonzero((s >= least[:, None]).ravel()), len(own))
                if not len(rows):
                    continue
                scores = _exact(q, x, rows + low, columns)
                cuts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]).tolist()
                of, scores, columns = rows.tolist(), scores.tolist(), columns.tolist()
                for start, z in zip(cuts, [*cuts[1:], len(scores)], strict=True):
                    i = low + of[start]
                    found = best[i] + [(-scores[j], own[columns[j]]) for j in range(start, z) if not apart or own[columns[j]] != qids[i]]
                    found.sort()
                    best[i] = found[:k]
                    if len(found) >= k:
                        kth[i] = -best[i][-1][0]
        flat = [(qids[i], item, -minus) for i, own in enumerate(best) for minus, item in own]
        names = [f[1] for f in flat]
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in flat], shared_type(qids)), pa.array(names, shared_type(names)), pa.array([f[2] for f in flat], pa.float64())], ["qid", "item", "score"]
        )

    return run


def shared_type(values: list) -> pa.DataType:
    return pa.string() if values and isinstance(values[0], str) else pa.int64()


def nearest_items(queries: DataFrame, items: DataFrame, k: int, *, dim: int = 64, apart: bool = False, block: int = QUERY_BLOCK) -> DataFrame:
    """``qid, item, score, rank``: the k best items of each query by dot product, ties to the lesser item.

    ``queries`` has ``qid, vector`` and ``items`` has ``item, vector``, ids being numbers or strings, vectors usable and of
    ``dim`` numbers. With fewer than k items all come out; with ``apart`` an item is not its own query's neighbour.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((queries, "qid"), (items, "item"))]
    kinds = ["string" if x == "string" else "bigint" for x in kinds]
    asked = queries.select(F.col("qid").cast(kinds[0]).alias("qid"), "vector")
    stored = getattr(items, "shared_path", None) and items.schema["item"].dataType.simpleString() == kinds[1]
    rows = items if stored else items.select(F.col("item").cast(kinds[1]).alias("item"), "vector")
    found = in_blocks(asked, rows, _best(k, apart), f"qid {kinds[0]}, item {kinds[1]}, score double", dim=dim, block=block)
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "item")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _beaten(systems: dict[str, np.ndarray], dim: int, most: int | None) -> Callable:
    """How many items beat each gold item under each system; with ``most`` none are counted any more once so many do."""

    def run(held: tuple[list, np.ndarray], stream: Iterator[tuple[list, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, both = held
        names = [k.split("\0", 1) for k in keys]
        queries, golds = both[:, :dim], both[:, dim:]
        sides = {name: unit(queries @ m) for name, m in systems.items()}
        # scores that agree to PLACES digits count as equal
        least = {name: (sides[name] * unit(golds @ m)).sum(1) + 0.5 * 10.0**-PLACES for name, m in systems.items()}
        coarse = {name: side.astype(np.float32) for name, side in sides.items()}
        counts = {name: np.zeros(len(keys), np.int64) for name in systems}
        open_ = {name: np.arange(len(keys)) for name in systems}
        err = _error(dim)
        for _, x in stream:
            for name, m in systems.items():
                if not len(open_[name]):
                    continue
                fine = unit(x @ m)
                single = fine.astype(np.float32)
                for low in range(0, len(open_[name]), ROWS):
                    at = open_[name][low : low + ROWS]
                    s, wanted = coarse[name][at] @ single.T, least[name][at]
                    some, every = (np.nextafter((wanted + e).astype(np.float32), np.float32(e)) for e in (-err, err))
                    found = np.flatnonzero((s > some[:, None]).ravel())
                    rows, columns = np.divmod(found, len(fine))
                    near = np.flatnonzero(s.ravel()[found] <= every[rows])
                    lost = np.zeros(len(found), bool)
                    lost[near] = (sides[name][at[rows[near]]] * fine[columns[near]]).sum(1) <= wanted[rows[near]]
                    counts[name][at] += np.bincount(rows[~lost], minlength=len(at))
                if most is not None:
                    open_[name] = open_[name][counts[name][open_[name]] < most]
        every = [name for name in systems for _ in keys]
        flat = np.concatenate([counts[n] for n in systems]) if systems else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(every, pa.string()), pa.array([n[0] for n in names] * len(systems), pa.string()), pa.array([n[1] for n in names] * len(systems), pa.string()), pa.array(flat)],
            ["system", "qid", "item", "beaten"],
        )

    return run


def unit(x: np.ndarray, eps: float = 1e-12) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), eps)


def gold_ranks(golds: DataFrame, items: DataFrame, systems: dict[str, np.ndarray], *, dim: int = 64, block: int = QUERY_BLOCK // 4, most: int | None = None) -> DataFrame:
    """``system, qid, item, rank`` of each gold pair: one more than the number of items that score strictly higher.

    ``golds`` has ``qid, item, qvector, ivector``, ids being strings; ``items`` has ``vector`` and is the searched
    collection. A system is a matrix that both sides are multiplied by before they are made unit vectors. With ``most``
    only ranks up to it are exact; the others are beyond it as well.
    """
    key = F.concat("qid", F.lit("\0"), "item")
    held = golds.select(key.alias("qid"), F.concat("qvector", "ivector").alias("vector"))
    name = F.col("item").cast("string") if "item" in items.columns else F.xxhash64("vector").cast("string")
    searched = items.select(name.alias("item"), "vector")
    found = in_blocks(held, searched, _beaten(systems, dim, most), "system string, qid string, item string, beaten long", dim=2 * dim, item_dim=dim, block=block)
    return found.groupBy("system", "qid", "item").agg((F.sum("beaten") + 1).alias("rank"))
