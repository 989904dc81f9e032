"""The k most similar vectors of every vector by a block matrix join of int8 product tiles.

Vectors are dealt to cells around centroids, fitted on a bounded sample; every vector is stored in its nearest cell and
asks its nearest cells, the more the more cells there are (``probes_of``). Cells near each other form regions, so that a
vector travels once to a region and not once to a cell. A region's stored rows are dealt to blocks of about ``BLOCK`` and
its questions to parts of about ``ASKS``, and each block meets each part in a task of its own.

In a block, tiles of int8 codes are multiplied exactly (the products of codes are whole numbers below 2**24 up to 1,040
dimensions, which single precision holds without rounding) and give each cosine with a bound of its quantisation error.
The k-th largest lower bound is a threshold; pairs whose upper bound reaches it survive, are recomputed in double precision
from the unit vectors and go through a heap of the k best of each question. Heaps of unlike blocks are merged at last. So
the only loss is a neighbour in a cell that is not asked; with ``probes`` of at least the number of cells there is none.
Equal vectors of a block are stored up to k + 1 times, those of the least ids, so copies cost nothing beyond that.

The work of a vector is ``probes_of(cells)`` cells of about ``CELL`` rows; recall is measured in the tests.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievebench.session import materialise

K = 5
CELL = 5000
#: The fewest cells that a vector asks.
PROBES = 5
REGION_CELLS = 6
BLOCK, ASKS = 131072, 262144
#: Rows the centroids are fitted on: 40 for each cell, no fewer than 20,000 and no more than a million.
SAMPLE, SAMPLE_PER_CELL, SAMPLE_MOST = 20_000, 40, 1_000_000
#: More centroids than this are fitted in two steps, groups first.
FLAT = 1024
#: Bound of the error that unit vectors in single precision leave in a cosine.
FINE = 1e-5
#: Ids up to this number are broadcast, more are joined by a shuffle.
SMALL = 200_000


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a list column, and the vectors as unit rows.

    A vector is usable if it has ``dim`` finite numbers that aren't all zero.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(rows)).flatten()
    values = flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt((values * values).sum(1))
        scale = np.abs(values).max(1, initial=0)
        tiny = np.isfinite(scale) & (scale > 0) & ~(np.isfinite(norm) & (norm > 1e-150))
        if tiny.any():
            values[tiny] /= scale[tiny, None]
            norm[tiny] = np.sqrt((values[tiny] ** 2).sum(1))
    good = np.isfinite(values).all(1) & np.isfinite(norm) & (norm > 0)
    return rows[good], (values[good] / norm[good, None]).astype(np.float32)


def spherical_means(sample: np.ndarray, cells: int, seed: int = 3, rounds: int = 8) -> np.ndarray:
    """Unit centroids of a sample by spherical k-means."""
    pick = np.random.default_rng(seed).permutation(len(sample))[:cells]
    centroids = sample[pick].copy()
    for _ in range(rounds):
        near = (sample @ centroids.T).argmax(1)
        order = np.argsort(near, kind="stable")
        starts = np.searchsorted(near[order], np.arange(cells + 1))
        for c in range(cells):
            if starts[c] < starts[c + 1]:
                mean = sample[order[starts[c] : starts[c + 1]]].sum(0)
                if (norm := np.linalg.norm(mean)) > 1e-6:
                    centroids[c] = mean / norm
    return centroids


def fitted_means(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centroids of a sample; many are fitted within groups, so the work stays near proportional to the sample."""
    if cells <= FLAT:
        return spherical_means(sample, cells)
    groups = round(cells**0.5)
    near = np.concatenate([(part @ spherical_means(sample, groups).T).argmax(1) for part in np.array_split(sample, -(-len(sample) // 65536))])
    sizes = np.bincount(near, minlength=groups)
    share = np.maximum(1, np.round(cells * sizes / len(sample)).astype(int))
    return np.concatenate([spherical_means(sample[near == g], int(min(share[g], sizes[g]))) for g in range(groups) if sizes[g]])


@dataclass
class Layout:
    """Centroids, the region of each cell, and each region's first task, blocks of stored rows, parts of questions and stored rows (about)."""

    centroids: np.ndarray
    region: np.ndarray
    first_task: np.ndarray
    n_blocks: np.ndarray
    n_parts: np.ndarray
    probes: int
    held: np.ndarray

    @property
    def tasks(self) -> int:
        return int((self.n_blocks * self.n_parts).sum())


def probes_of(cells: int) -> int:
    """How many cells a vector asks. A fixed number would search a lesser share, and find less, the more cells there are."""
    return max(PROBES, round(cells**0.75 / 4))


def _nearest_cells(x: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The nearest cells of each row, the nearest first."""
    score = x @ centroids.T
    if probes < score.shape[1]:
        near = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
    else:
        near = np.tile(np.arange(score.shape[1]), (len(x), 1))
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(score, near, 1), axis=1, kind="stable"), 1)


def plan(sample: np.ndarray, rows: int, cell: int = CELL, probes: int | None = None, block: int = BLOCK, asks: int = ASKS) -> Layout:
    """The layout for so many rows; numbers of blocks and parts are estimated from the sample and only balance the load."""
    cells = int(max(1, min(len(sample), round(rows / cell))))
    centroids = fitted_means(sample, cells)
    cells = len(centroids)
    regions = max(1, cells // REGION_CELLS)
    region = (centroids @ spherical_means(centroids, regions, rounds=12).T).argmax(1) if regions > 1 else np.zeros(cells, np.int64)
    region = np.unique(region, return_inverse=True)[1]
    probes = min(probes or probes_of(cells), cells)
    held, asked = np.zeros(region.max() + 1), np.zeros(region.max() + 1)
    for part in np.array_split(sample[:SAMPLE], -(-min(len(sample), SAMPLE) // 4096)):
        of = region[_nearest_cells(part, centroids, probes)]
        held += np.bincount(of[:, 0], minlength=len(held))
        asked += np.bincount(np.unique(np.arange(len(of))[:, None] * len(held) + of) % len(held), minlength=len(held))
    scale = rows / max(1, min(len(sample), SAMPLE))
    n_blocks, n_parts = (np.maximum(1, np.ceil(x * scale / most)).astype(np.int64) for x, most in ((held, block), (asked, asks)))
    tasks = n_blocks * n_parts
    return Layout(centroids, region, np.cumsum(tasks) - tasks, n_blocks, n_parts, probes, held * scale)


def _deal(shared, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task, kind, id, cells, vector``: each vector once for each part as stored, and once for each block it asks.

    Kind 0 is stored, 1 stored and asking in the same task, 2 asking; the first of the cells is where a vector is stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = shared.value
        regions = len(layout.n_blocks)
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                rows, x = unit_rows(batch.column(1), dim)
                if not len(rows):
                    continue
                ids = batch.column(0).take(pa.array(rows)).to_numpy()
                near = _nearest_cells(x, layout.centroids, layout.probes)
                n, probes = near.shape
                hashed = (ids * 2654435761 >> 7) & 0x7FFFFFFF
                # questions: a row and a region, with the cells asked there, the nearest first
                key = np.arange(n)[:, None] * regions + layout.region[near]
                order = np.argsort(key.ravel(), kind="stable")
                pairs, starts = np.unique(key.ravel()[order], return_index=True)
                cells = pa.ListArray.from_arrays(pa.array(np.r_[starts, n * probes].astype(np.int32)), pa.array(near.ravel()[order].astype(np.int32)))
                who, region = pairs // regions, pairs % regions
                copies = layout.n_blocks[region]
                pair = np.repeat(np.arange(len(pairs)), copies)
                block = np.arange(len(pair)) - np.repeat(np.cumsum(copies) - copies, copies)
                who, region = who[pair], region[pair]
                asked = layout.first_task[region] + block * layout.n_parts[region] + hashed[who] % layout.n_parts[region]
                # stored rows: one block, all its parts; in one of these the row asks as well
                own_region = layout.region[near[:, 0]]
                parts = layout.n_parts[own_region]
                row = np.repeat(np.arange(n), parts)
                home = own_region[row]
                part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                own_block = hashed // 64 % layout.n_blocks[own_region]
                stored = layout.first_task[home] + own_block[row] * layout.n_parts[home] + part
                both = part == hashed[row] % layout.n_parts[home]
                own_pair = np.searchsorted(pairs, np.arange(n) * regions + own_region)
                apart = (region != own_region[who]) | (block != own_block[who])
                who, pair, asked = who[apart], pair[apart], asked[apart]
                every = np.r_[row, who]
                flat = pa.py_buffer(np.ascontiguousarray(x[every]).tobytes())
                ends = pa.py_buffer((np.arange(len(every) + 1) * 4 * dim).astype(np.int32).tobytes())
                kinds = np.r_[both.astype(np.int8), np.full(len(who), 2, np.int8)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[stored, asked].astype(np.int32)),
                        pa.array(kinds),
                        pa.array(ids[every], pa.int64()),
                        cells.take(pa.array(np.r_[own_pair[row], pair])),
                        pa.Array.from_buffers(pa.binary(), len(every), [None, ends, flat]),
                    ],
                    ["task", "kind", "id", "cells", "vector"],
                )

    return run


def int8_codes(x: np.ndarray, scale: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of at most 127 in size that stand for ``x / scale``, and a bound of each row's distance from what they stand for."""
    codes = np.round(x / scale).astype(np.int8)
    error = np.sqrt(((x - codes.astype(np.float64) * scale) ** 2).sum(1))
    return codes, (error * (1 + 1e-6) + 1e-6).astype(np.float32)


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of rows of int8 codes, exact up to 1,040 numbers a row."""
    if a.shape[1] > 1040:
        return (a.astype(np.int32) @ b.astype(np.int32).T).astype(np.float64)
    return a.astype(np.float32) @ b.astype(np.float32).T


class Store:
    """The stored rows of a block by cell, equal vectors at most k + 1 times."""

    def __init__(self, ids: np.ndarray, cells: np.ndarray, x: np.ndarray, k: int) -> None:
        order = np.lexsort((ids, cells))
        rows = np.ascontiguousarray(x[order]).view(f"V{x.shape[1] * x.itemsize}").ravel()
        same = np.unique(rows, return_inverse=True)[1]
        by = np.argsort(same, kind="stable")
        starts = np.flatnonzero(np.r_[True, same[by][1:] != same[by][:-1]])
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
        keep = order[place <= k] if len(order) else order
        self.ids, self.x, cells = ids[keep], x[keep], cells[keep]
        scale = np.maximum(np.abs(self.x).max(1, keepdims=True), 1e-30) / 127
        codes, self.errors = int8_codes(self.x, scale)
        self.scale = scale[:, 0].astype(np.float32)
        self.codes = codes.astype(np.float32) if x.shape[1] <= 1040 else codes  # whole numbers, as the product takes them
        self.cell_ids, starts = np.unique(cells, return_index=True)
        self.bounds = {int(c): (int(a), int(b)) for c, a, b in zip(self.cell_ids, starts, np.r_[starts[1:], len(cells)], strict=True)}


def tile_survivors(store: Store, low: int, high: int, codes: np.ndarray, scale: np.ndarray, error: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(question, stored row)`` of the pairs of a tile that can be among the k best; ``floor`` is what is already sure.

    ``codes``, ``scale`` and ``error`` are those of the questions.
    """
    tile = code_products(codes, store.codes[low:high])
    tile *= store.scale[low:high]
    worst = float(store.errors[low:high].max())
    band = error + worst + error * worst + 1e-5  # that of the product in single precision too
    n, m = tile.shape
    groups = min(m, 64)
    width = m // groups
    want = min(k + 1, groups)  # one may be the question itself
    if groups >= k + 1 and (floor < -1).any():
        best = tile[:, : groups * width].reshape(n, groups, width).max(2)
        floor = np.maximum(floor, np.partition(best, groups - want, axis=1)[:, groups - want] * scale - band)
    at = np.flatnonzero(tile >= ((floor - band) / scale).astype(np.float32)[:, None])
    return at // m, at % m + low


def _merge(heaps: list[list], worst: np.ndarray, rows: np.ndarray, cosines: np.ndarray, ids: np.ndarray, k: int) -> None:
    """Pushes scored pairs on the heaps of the k best, the greater id being the worse at a tie."""
    at = np.flatnonzero(cosines >= worst[rows])
    order = at[np.lexsort((ids[at], -cosines[at], rows[at]))]  # of a question's pairs only the first k can stay
    rows, cosines, ids = rows[order], cosines[order], ids[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    first = place < k
    touched = rows[starts].tolist()
    for row, cosine, other in zip(rows[first].tolist(), cosines[first].tolist(), (-ids[first]).tolist(), strict=True):
        heap = heaps[row]
        if len(heap) < k:
            heapq.heappush(heap, (cosine, other))
        elif (cosine, other) > heap[0]:
            heapq.heapreplace(heap, (cosine, other))
    for row in touched:
        if len(heaps[row]) == k:
            worst[row] = heaps[row][0][0]


def _answer(store: Store, ids: np.ndarray, who: np.ndarray, cells: np.ndarray, rank: np.ndarray, x: np.ndarray, k: int) -> tuple[list[int], list[int], list[float]]:
    """The k best stored rows of each question in the cells it asks: ``id, other, cosine``.

    ``who, cells, rank`` are the questions' places, the cells they ask and their order.
    """
    scale = np.maximum(np.abs(x).max(1, keepdims=True), 1e-30) / 127
    codes, error = int8_codes(x, scale)
    codes = codes.astype(np.float32) if x.shape[1] <= 1040 else codes
    scale = scale[:, 0].astype(np.float64)
    heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
    worst = np.full(len(ids), -2.0)  # the cosine that a pair must reach
    order = np.lexsort((who, cells, rank))
    step = rank[order].astype(np.int64) << 32 | cells[order]
    starts = np.flatnonzero(np.r_[True, step[1:] != step[:-1]]) if len(step) else np.zeros(0, np.int64)
    for first, last in zip(starts, np.r_[starts[1:], len(order)], strict=True):
        bounds = store.bounds.get(int(cells[order[first]]))
        if bounds is None:
            continue
        mine = who[order[first:last]]
        a, b = tile_survivors(store, *bounds, codes[mine], scale[mine], error[mine], worst[mine] - 1e-6, k)
        rows = mine[a]
        apart = ids[rows] != store.ids[b]
        rows, b = rows[apart], b[apart]
        for at in range(0, len(rows), 1 << 17):
            some, other = rows[at : at + (1 << 17)], b[at : at + (1 << 17)]
            exact = np.einsum("ij,ij->i", x[some], store.x[other], dtype=np.float64)
            _merge(heaps, worst, some, exact, store.ids[other], k)
    found = [(i, -other, cosine) for i, heap in zip(ids.tolist(), heaps, strict=True) for cosine, other in heap]
    return tuple(map(list, zip(*found, strict=True))) if found else ([], [], [])


def _floats(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _tiles(k: int, dim: int, at_once: int = 2048) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by task, stored ones first, become the best pairs of each block. Only the stored rows are held."""

    def answers(store: Store, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, part.num_rows, at_once):
            some = part.slice(at, at_once)
            sizes = some.column(3).value_lengths().to_numpy()
            who = np.repeat(np.arange(len(sizes)), sizes)
            rank = np.arange(len(who)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            found = _answer(store, some.column(2).to_numpy(), who, some.column(3).flatten().to_numpy(), rank, _floats(some.column(4), dim), k)
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["id", "other", "cosine"])

    def built(parts: list[pa.RecordBatch]) -> Store:
        first = [p.column(3).flatten().to_numpy()[p.column(3).offsets.to_numpy()[:-1] - p.column(3).offsets.to_numpy()[0]] for p in parts]
        return Store(np.concatenate([p.column(2).to_numpy() for p in parts]), np.concatenate(first), np.concatenate([_floats(p.column(4), dim) for p in parts]), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, parts, store = None, [], None

        def opened() -> Iterator[pa.RecordBatch]:
            for part in parts:
                asks = part.filter(pc.equal(part.column(1), 1))
                if asks.num_rows:
                    yield from answers(store, asks)

        for whole in batches:
            tasks, asks = whole.column(0).to_numpy(), whole.column(1).to_numpy() == 2
            cuts = np.flatnonzero((tasks[1:] != tasks[:-1]) | (asks[1:] != asks[:-1])) + 1
            for low, high in zip(np.r_[0, cuts], np.r_[cuts, len(tasks)], strict=True):
                if low == high:
                    continue
                if tasks[low] != task:
                    if parts:
                        store = built(parts)
                        yield from opened()
                    task, parts, store = tasks[low], [], None
                part = whole.slice(low, high - low)
                if not asks[low]:
                    parts.append(part)
                    continue
                if store is None:
                    if not parts:
                        continue
                    store = built(parts)
                    yield from opened()
                    parts = []
                yield from answers(store, part)
        if parts:
            store = built(parts)
            yield from opened()

    return run


def _usable_sample(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = unit_rows(batch.column(1), dim)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "vector"])

    return run


def sample_units(vectors: DataFrame, id_: str, vector: str, most: int, dim: int, n: int | None = None) -> np.ndarray:
    """About ``most`` unit vectors (all, if there are fewer), chosen by a hash of their id, for fitting centroids only.

    The choice is a filter, so nothing is shuffled; ``n`` is the number of rows, counted if not given.
    """
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.size("v") == dim)
    n = rows.count() if n is None else n
    if n > most:
        steps = 1 << 30
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(steps)) < int(steps * most / n))
    found = [r["vector"] for r in sorted(rows.mapInArrow(_usable_sample(dim), "id long, vector binary").collect())]
    return np.frombuffer(b"".join(found), np.float32).reshape(-1, dim)


def layout_of(
    vectors: DataFrame, *, id_: str = "vec_id", vector: str = "embedding", dim: int = 64, cell: int = CELL, probes: int | None = None, block: int = BLOCK, asks: int = ASKS
) -> Layout | None:
    """The layout for these vectors, none without usable ones."""
    n = vectors.filter(F.size(vector) == dim).count()
    cells = max(1, round(n / cell))
    sample = sample_units(vectors, id_, vector, min(SAMPLE_MOST, max(SAMPLE, SAMPLE_PER_CELL * cells)), dim, n)
    return plan(sample, n, cell, probes, block, asks) if len(sample) else None


def _homes(shared, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, first, sizes = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                batch = whole.slice(at, 8192)
                rows, x = unit_rows(batch.column(1), dim)
                ids = batch.column(0).take(pa.array(rows))
                region = layout.region[_nearest_cells(x, layout.centroids, 1)[:, 0]] if len(rows) else np.zeros(0, np.int64)
                part = first[region] + (ids.to_numpy() * 2654435761 >> 7 & 0x7FFFFFFF) % sizes[region]
                yield pa.RecordBatch.from_arrays([ids, pa.array(part.astype(np.int32))], ["node", "part"])

    return run


def homes(vectors: DataFrame, layout: Layout, most: int, *, id_: str = "vec_id", vector: str = "embedding", dim: int = 64) -> tuple[DataFrame, int]:
    """``node, part`` of the usable vectors and the number of parts: those of a region in parts of about ``most``."""
    sizes = np.maximum(1, np.ceil(layout.held / most)).astype(np.int64)
    shared = vectors.sparkSession.sparkContext.broadcast((layout, np.cumsum(sizes) - sizes, sizes))
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v"))
    return rows.mapInArrow(_homes(shared, dim), "node long, part int"), int(sizes.sum())


def nearest(
    vectors: DataFrame,
    *,
    id_: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    dim: int = 64,
    cell: int = CELL,
    probes: int | None = None,
    block: int = BLOCK,
    asks: int = ASKS,
    layout: Layout | None = None,
    least: float | None = None,
) -> DataFrame:
    """``id, other, cosine, rank``: the k most similar others of every usable vector, equal cosines by the lesser id.

    Unusable vectors (null, of other sizes, all zero, not finite) have no row and are nobody's neighbour. ``id`` must be
    unique. With k or fewer other vectors there are as many rows as others. ``layout`` is made if not given; neighbours
    below ``least`` are left out.
    """
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v"))
    layout = layout or layout_of(vectors, id_=id_, vector=vector, dim=dim, cell=cell, probes=probes, block=block, asks=asks)
    if layout is None:
        return rows.select("id", F.col("id").alias("other"), F.lit(0.0).alias("cosine"), F.lit(0).alias("rank")).limit(0)
    shared = vectors.sparkSession.sparkContext.broadcast(layout)
    dealt = rows.mapInArrow(_deal(shared, dim), "task int, kind byte, id long, cells array<int>, vector binary")
    placed = dealt.repartitionById(layout.tasks, F.col("task")).sortWithinPartitions("task", "kind")
    found = placed.mapInArrow(_tiles(k, dim), "id long, other long, cosine double")
    if least is not None:
        found = found.filter(F.col("cosine") >= least)
    by = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def close_pairs(neighbours: DataFrame, vectors: DataFrame, least: float, *, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``a, b`` with a < b: pairs of which one is a neighbour of the other and whose exact cosine is at least ``least``."""
    pairs = (
        neighbours.filter(F.col("cosine") >= least - FINE)
        .groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
        .agg(F.min("cosine").alias("cosine"))
    )
    pairs = materialise(pairs, "pairs")
    sure, near = pairs.filter(F.col("cosine") >= least + FINE), pairs.filter(F.col("cosine") < least + FINE)
    asked = near.select(F.explode(F.array("a", "b")).alias(id_)).distinct()
    n = asked.count()
    if not n:
        return sure.select("a", "b")
    asked = F.broadcast(asked) if n <= SMALL else asked
    wanted = vectors.join(asked, id_, "left_semi")

    def held(name: str) -> DataFrame:
        return wanted.select(F.col(id_).cast("long").alias(name), F.transform(vector, lambda v: v.cast("double")).alias(f"v{name}"))

    def dot(x: str, y: str):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    exact = dot("va", "vb") / F.sqrt(dot("va", "va") * dot("vb", "vb"))
    checked = near.join(held("a"), "a").join(held("b"), "b").filter(exact >= least)
    return sure.select("a", "b").unionByName(checked.select("a", "b"))
