"""Clusters of similar records by Markov clustering of a similarity graph.

``markov_clusters`` works on any weighted graph held in a table, a row for each column of the stochastic matrix. It
alternates squaring (each column is the sum of the columns it names), inflation and pruning of small entries, until each
column is as good as settled; the rows that keep flow are the attractors, and a node belongs to the attractor that gets
most of its flow.

Vectors are the nodes themselves: each is tied to its nearest others (``neighbours``), and that graph is clustered in tables.
The clusters it falls into are nodes in turn, tied by the edges between them, until none join any more. Mean directions over
all members follow; those that all but agree are parts of one. A vector belongs to the cluster its flow ends in, if its
cosine to that mean direction suffices, else to the nearest that does. The members that a step of the walk brings most flow
to are the typical ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievebench.llm import neighbours
from sievebench.llm.neighbours import unit_rows
from sievebench.llm.overlap import least_labels
from sievebench.llm.sums import ROWS, rows_of, total_rows
from sievebench.session import discard, materialise

#: The least cosine that ties two vectors; entries that a column of their graph keeps, and one of the clusters' graph.
NEAR, LINKS, MOST = 0.45, 6, 16
#: Rounds at most until a graph of vectors or of their clusters is settled.
ROUNDS = 100
#: A matrix of so few entries is finished in one task, so many products at a time.
FEW, PRODUCTS = 500_000, 2_000_000
#: So few ties of clusters are joined to the end in one task.
TIES = 1_000_000
#: Nodes of a part of a larger matrix, about.
PART = 65_536
#: The least tie of two clusters, as a share of their ties to themselves.
LEAST_TIE = 0.05
LEAST_COSINE = 0.53
#: The least cosine of the mean directions of parts of one cluster.
SAME = 0.8
#: Cosines between mean directions that the driver holds at once, about.
COSINES = 1 << 20
#: The fewest members, as any two or three vectors that are far apart lie near enough to their own mean.
LEAST_MEMBERS = 5
COLUMN = "col long, rows array<long>, p array<double>, chaos double"


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _by_entry(col: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The order by column, then by row."""
    if len(col) and min(col.min(), row.min()) >= 0 and max(col.max(), row.max()) < 1 << 31:
        return np.argsort(col << 32 | row)
    return np.lexsort((row, col))


def _settle(col: np.ndarray, row: np.ndarray, p: np.ndarray, inflation: float, least: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of whole columns summed by row, inflated, pruned and made stochastic."""
    order = _by_entry(col, row)
    col, row, p = col[order], row[order], p[order]
    first = np.flatnonzero(np.r_[True, (col[1:] != col[:-1]) | (row[1:] != row[:-1])]) if len(col) else np.zeros(0, np.int64)
    if not len(first):
        return col, row, p
    col, row, p = col[first], row[first], np.add.reduceat(p, first)
    starts = _starts(col)
    sizes = np.diff(np.r_[starts, len(col)])
    top = np.repeat(np.maximum.reduceat(p, starts), sizes)
    first, p = p == top, (p / top) ** inflation
    p /= np.repeat(np.add.reduceat(p, starts), sizes)
    keep = (p >= least) | first  # what can stay; of many, the greatest do
    col, row, p = col[keep], row[keep], p[keep]
    starts = _starts(col)
    sizes = np.diff(np.r_[starts, len(col)])
    keep = p >= least
    keep[starts] = True  # of a column whose entries are all smaller the first of the greatest
    many = np.flatnonzero(np.repeat(sizes > most, sizes))
    if len(many):
        order = many[np.lexsort((-p[many], col[many]))]  # equal ones stay in the order of rows
        place = np.arange(len(order)) - np.repeat(_starts(col[order]), sizes[sizes > most])
        keep[order[place >= most]] = False
    col, row, p = col[keep], row[keep], p[keep]
    starts = _starts(col)
    return col, row, p / np.repeat(np.add.reduceat(p, starts), np.diff(np.r_[starts, len(col)]))


def _chaos(col: np.ndarray, p: np.ndarray) -> np.ndarray:
    """How far each column is from settled."""
    starts = _starts(col)
    return np.maximum.reduceat(p, starts) - np.add.reduceat(p * p, starts) if len(starts) else np.zeros(0)


def _column_rows(col: np.ndarray, row: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    starts = _starts(col)
    ends = pa.array(np.r_[starts, len(col)], pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (row, p)]
    return pa.RecordBatch.from_arrays([pa.array(col[starts]), *lists, pa.array(_chaos(col, p))], ["col", "rows", "p", "chaos"])


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _columns(inflation: float, least: float, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``col, q, rows, p`` sorted by col: each column is the sum of ``q`` times the columns ``rows, p``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy()
            new = (np.repeat(batch.column(0).to_numpy(), sizes), _flat(batch.column(2)), np.repeat(batch.column(1).to_numpy(), sizes) * _flat(batch.column(3)))
            col, row, p = (np.concatenate(x) for x in zip(left, new, strict=True))
            if not len(col):
                continue
            whole = int(np.searchsorted(col, col[-1]))  # the last column may go on
            if whole:
                yield _column_rows(*_settle(col[:whole], row[:whole], p[:whole], inflation, least, most))
            left = (col[whole:], row[whole:], p[whole:])
        if len(left[0]):
            yield _column_rows(*_settle(*left, inflation, least, most))

    return run


def _renumbered(*ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct ids in order, and places among them instead of ids."""
    names, places = np.unique(np.concatenate(ids), return_inverse=True)
    return names, np.split(places, np.cumsum([len(x) for x in ids])[:-1])


Entries = tuple[np.ndarray, np.ndarray, np.ndarray]


def _squared(own: Entries, held: Entries, inflation: float, least: float, most: int) -> Entries:
    """A round for the columns ``own`` of which ``held`` has every column they name; ``col, row, p``, both in order."""
    (col, row, p), (of, to, q) = own, held
    low, size = np.searchsorted(of, row), np.searchsorted(of, row, side="right")
    size -= low
    products = np.cumsum(size)
    starts = _starts(col)
    upto = products[np.r_[starts[1:], len(col)] - 1] // PRODUCTS  # so many products at once, columns whole
    cuts = np.r_[0, starts[1:][np.diff(upto) > 0], len(col)]
    parts = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        n = size[a:b]
        at = np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        parts.append(_settle(np.repeat(col[a:b], n), to[at], np.repeat(p[a:b], n) * q[at], inflation, least, most))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _rounds(inflation: float, least: float, most: int, rounds: int, settled: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A whole matrix of few entries, squared, inflated and pruned until it is settled or ``rounds`` rounds have passed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.repeat(b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy()), _flat(b.column(1)), _flat(b.column(2))) for b in batches]
        if not held:
            return
        col, row, p = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((row, col))
        col, row, p = col[order], row[order], p[order]
        names, (col, row) = _renumbered(col, row)
        for _ in range(rounds):
            col, row, p = _squared((col, row, p), (col, row, p), inflation, least, most)
            if _chaos(col, p).max() < settled:
                break
        yield _column_rows(names[col], names[row], p)

    return run


def _packed(state: Entries, at: np.ndarray) -> bytes:
    """``col, row, p`` in order and the parts ``at`` of the rows, byte by byte, as bytes of one place are much alike."""
    col, row, p = state
    starts = _starts(col)
    out = [np.array([len(starts), len(col)], "<i8").tobytes()]
    for x, kind in ((col[starts], "<i8"), (np.diff(np.r_[starts, len(col)]), "<i4"), (row, "<i8"), (at, "<i4"), (p, "<f4")):
        x = np.ascontiguousarray(x, kind)
        out.append(np.ascontiguousarray(x.view("u1").reshape(len(x), x.itemsize).T).tobytes())
    return b"".join(out)


def _unpacked(blob) -> tuple[Entries, np.ndarray]:
    columns, entries = (int(x) for x in np.frombuffer(blob, "<i8", 2))
    at, found = 16, []
    for n, kind in ((columns, "<i8"), (columns, "<i4"), (entries, "<i8"), (entries, "<i4"), (entries, "<f4")):
        size = np.dtype(kind).itemsize
        found.append(np.ascontiguousarray(np.frombuffer(blob, "u1", n * size, at).reshape(size, n).T).view(kind).ravel())
        at += n * size
    col, size, row, parts, p = found
    return (np.repeat(col, size), row, p.astype(np.float64)), parts


STATE = "part int, entries long, chaos double, blob binary"
#: What goes from part to part: a part's own columns (``src`` is the part itself), ids asked for by another, or columns for it.
SENT = "to int, src int, blob binary"


def _sent(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    to, src, blobs = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(src, pa.int32()), pa.array(blobs, pa.binary())], ["to", "src", "blob"])


def _state(part: int, state: Entries, at: np.ndarray) -> pa.RecordBatch:
    made = [pa.array([part], pa.int32()), pa.array([len(at)], pa.int64()), pa.array([_chaos(state[0], state[2]).max(initial=0)]), pa.array([_packed(state, at)], pa.binary())]
    return pa.RecordBatch.from_arrays(made, ["part", "entries", "chaos", "blob"])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, bytes]]]:
    """What came to each part, by where it came from."""
    by: dict[int, dict[int, bytes]] = {}
    for batch in batches:
        for to, src, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            by.setdefault(to, {})[src] = blob
    for to in list(by):
        yield to, by.pop(to)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``part, col, row, at, p`` sorted by part and column become states."""
    held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if held:
        part, col, row, at, p = (np.concatenate(x) for x in zip(*held, strict=True))
        starts = _starts(part)
        for low, high in zip(starts, np.r_[starts[1:], len(part)], strict=True):
            order = low + _by_entry(col[low:high], row[low:high])
            yield _state(int(part[low]), (col[order], row[order], p[order]), at[order])


def _ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """States become themselves and, for each other part, the columns that are needed of it."""
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            (_, row, _), at = _unpacked(blob)
            rows, first = np.unique(row[at != part], return_index=True)
            of = at[at != part][first]
            order = np.argsort(of, kind="stable")
            starts = _starts(of[order])
            asked = [(int(of[x[0]]), part, _packed((rows[x], rows[x], np.zeros(len(x))), of[x])) for x in np.split(order, starts[1:]) if len(x)]
            yield _sent([(part, part, blob), *asked])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's state for itself, and for each part that asked the columns it needs."""
    for part, came in _gathered(batches):
        own = came.pop(part)
        (col, row, p), at = _unpacked(own)
        for src, blob in came.items():
            good = np.isin(col, _unpacked(blob)[0][0])
            yield _sent([(src, part, _packed((col[good], row[good], p[good]), at[good]))])
        yield _sent([(part, part, own)])


def _multiply(inflation: float, least: float, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A round for a part's columns, with the columns of other parts that they name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, came in _gathered(batches):
            held = [_unpacked(came.pop(part)), *(_unpacked(blob) for blob in came.values())]
            n = len(held[0][1])
            col, row, p, at = (np.concatenate(x) for x in zip(*((*e, a) for e, a in held), strict=True))
            names, (col, row) = _renumbered(col, row)
            parts = np.zeros(len(names), np.int32)
            parts[row] = at
            own = (col[:n], row[:n], p[:n])
            order = np.argsort(col, kind="stable")
            col, row, p = _squared(own, (col[order], row[order], p[order]), inflation, least, most)
            yield _state(part, (names[col], names[row], p), parts[row])

    return run


def _as_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(3).to_pylist():
            (col, row, p), _ = _unpacked(blob)
            if len(col):
                yield _column_rows(col, row, p)


def markov_clusters(
    edges: DataFrame, *, inflation: float = 2.0, least: float = 1e-4, most: int = 256, rounds: int = 40, settled: float = 1e-3,
    homes: tuple[DataFrame, int] | None = None,
) -> DataFrame:
    """``node, cluster, flow`` from ``src, dst, weight`` (undirected, positive; other rows count as no edge).

    A column keeps its ``most`` largest entries of at least ``least``. ``flow`` is the largest share of the node's walk that
    an attractor gets; ``cluster`` is the least attractor with at least half of it, and that attractor's own, so that
    attractors which share their flow count as one. Raises if ``rounds`` rounds don't settle it.

    A larger matrix is held in parts. In a round each part asks the others for the columns that its own name and gets each
    of them once, so the products don't travel. ``homes``, ``node, part`` and the number of parts, should put nodes
    that are tied into one part; without it parts follow from a hash.
    """
    one = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND weight > 0").select("src", "dst", F.col("weight").cast("double").alias("weight"))
    both = one.filter("src <> dst").select(F.col("src").alias("row"), F.col("dst").alias("col"), "weight")
    both = both.unionByName(both.select(F.col("col").alias("row"), F.col("row").alias("col"), "weight"))
    loops = one.filter("src = dst").select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(0.0).alias("weight"))
    each = both.unionByName(loops).repartition("col").groupBy("col", "row").agg(F.max("weight").alias("weight"))
    heaviest = F.max(F.when(F.col("row") != F.col("col"), F.col("weight"))).over(Window.partitionBy("col"))
    own = F.when(F.col("row") == F.col("col"), F.lit(-1.0)).otherwise(F.col("weight"))  # loops are made anew below
    place = F.row_number().over(Window.partitionBy("col").orderBy(F.desc(own), "row"))
    kept = each.withColumn("heaviest", F.coalesce(heaviest, F.lit(1.0))).withColumn("place", place).filter(F.col("place") <= most)
    lists = kept.groupBy("col").agg(F.collect_list(F.when(F.col("row") != F.col("col"), F.struct("row", "weight"))).alias("e"), F.max("heaviest").alias("heaviest"))
    begun = lists.select(
        "col", F.lit(1.0).alias("q"), F.concat("e.row", F.array("col")).alias("rows"), F.concat("e.weight", F.array("heaviest")).alias("p")
    )
    matrix = materialise(begun.mapInArrow(_columns(1.0, least, most), COLUMN), "flow")
    done, (columns, entries, chaos) = 0, matrix.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("rows")), F.lit(0)), F.max("chaos")).first()
    if entries > FEW:
        at, parts = homes or (None, -(-columns // PART))
        flat = matrix.select("col", F.explode(F.arrays_zip("rows", "p")).alias("x")).select("col", F.col("x.rows").alias("row"), F.col("x.p").alias("p"))
        for end, name in (("row", "at"), ("col", "part")):
            hashed = F.pmod(F.xxhash64(end), F.lit(parts)).cast("int")
            if at is None:
                flat = flat.withColumn(name, hashed)
            else:
                named = at.select(F.col("node").alias(end), F.col("part").alias(name))
                flat = flat.join(named, end, "left").withColumn(name, F.coalesce(name, hashed))
        flat = flat.select("part", "col", "row", "at", "p").repartitionById(parts, F.col("part")).sortWithinPartitions("part")
        state = materialise(flat.mapInArrow(_dealt, STATE), "state", old=matrix)
        while entries > FEW and chaos >= settled and done < rounds:
            answered = state.mapInArrow(_ask, SENT).repartitionById(parts, F.col("to")).mapInArrow(_answer, SENT)
            squared = answered.repartitionById(parts, F.col("to")).mapInArrow(_multiply(inflation, least, most), STATE)
            state = materialise(squared, "state", old=state)
            done, (entries, chaos) = done + 1, state.agg(F.sum("entries"), F.max("chaos")).first()
        matrix = materialise(state.mapInArrow(_as_columns, COLUMN), "flow", old=state)
    if columns and (not done or chaos >= settled) and done < rounds and entries <= FEW:  # one task does the rounds that are left
        matrix = materialise(matrix.repartition(1).mapInArrow(_rounds(inflation, least, most, rounds - done, settled), COLUMN), "flow", old=matrix)
    if (matrix.agg(F.max("chaos")).first()[0] or 0) >= settled:
        raise RuntimeError(f"flow did not settle in {rounds} rounds")
    strong = F.filter(F.arrays_zip("rows", "p"), lambda x: x.p >= F.array_max("p") / 2)
    best = materialise(matrix.select("col", F.array_min(F.transform(strong, lambda x: x.rows)).alias("cluster"), F.array_max("p").alias("flow")), "attractors", old=matrix)
    names = best.select(F.col("col").alias("cluster"), F.col("cluster").alias("name"))
    return best.join(names, "cluster").select(F.col("col").alias("node"), F.col("name").alias("cluster"), "flow")


def _members(means: np.ndarray, x: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The cluster of each row (-1 for none) and the cosine with its mean direction: its own, if that is near enough, else the nearest."""
    if not len(x) or not len(means):
        return np.full(len(x), -1), np.zeros(len(x))
    score, rows = x.astype(np.float64) @ means.T, np.arange(len(x))
    nearest = score.argmax(1)
    held = (own >= 0) & (score[rows, own] >= least)
    best = np.where(held, own, nearest)
    cosine = score[rows, best]
    return np.where(cosine >= least, best, -1), cosine


def _directions(shared, dim: int, least: float, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums and counts of the members, ``own, v``; at ``first`` of all that flow into a cluster, whatever their cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, means = shared.value
        out, counts = np.zeros(means.shape), np.zeros((len(means), 1))
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                rows, x = unit_rows(batch.column(1), dim)
                own = batch.column(0).to_numpy()[rows]
                own = np.where(own >= 0, same[own], -1)
                best = own if first else _members(means, x, own, least)[0]
                order = np.argsort(best, kind="stable")
                order = order[best[order] >= 0]
                if len(order):
                    counts[:, 0] += np.bincount(best[order], minlength=len(counts))
                    starts = _starts(best[order])
                    out[best[order][starts]] += np.add.reduceat(x[order].astype(np.float64), starts)
        yield rows_of(0, out)
        yield rows_of(1, counts)

    return run


def _assign(shared, dim: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kept columns, then ``own, v``: rows in a cluster with the cluster and the cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same, means = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                n = batch.num_columns - 2
                rows, x = unit_rows(batch.column(n + 1), dim)
                own = batch.column(n).to_numpy()[rows]
                best, cosine = _members(means, x, np.where(own >= 0, same[own], -1) if len(same) else np.full(len(own), -1), least)
                good = best >= 0
                kept = [c.take(pa.array(rows[good])) for c in batch.columns[:n]]
                made = [pa.array(best[good], pa.int32()), pa.array(cosine[good], pa.float64())]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*batch.schema.names[:n], "cluster", "cosine"])

    return run


def _merged(means: np.ndarray, least: float) -> np.ndarray:
    """A number for each mean direction; those that are as near as that, directly or by way of others, share one.

    About ``COSINES`` cosines are held at once: parts of a large cluster are near each other in all pairs.
    """
    n = len(means)
    label, rows = np.arange(n), max(1, COSINES // max(1, n))
    for low in range(0, n, rows):
        a, b = np.nonzero(means[low : low + rows] @ means[low:].T >= least)
        a, b = label[a + low], label[b + low]
        apart = a != b
        if apart.any():
            label = least_labels(n, a[apart], b[apart])[label]
    return np.unique(label, return_inverse=True)[1]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _contracted(ties: DataFrame, labels: DataFrame) -> DataFrame:
    """``a, b, weight`` between clusters, a <= b, from ``a, b, weight`` between their nodes and ``node, cluster``."""
    of_a = labels.select(F.col("node").alias("a"), F.col("cluster").alias("ca"))
    of_b = labels.select(F.col("node").alias("b"), F.col("cluster").alias("cb"))
    named = ties.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"), "weight")
    return named.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))


def _local_clusters(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray, most: int, rounds: int, inflation: float = 2.0, least: float = 1e-4, settled: float = 1e-3) -> np.ndarray:
    """As ``markov_clusters`` for few edges (each once, a < b), a label for each of ``n`` nodes, its own without edges."""
    labels = np.arange(n)
    if not len(a):
        return labels
    col, row, w = np.r_[a, b], np.r_[b, a], np.r_[weight, weight]
    order = np.lexsort((row, -w, col))
    col, row, w = col[order], row[order], w[order]
    starts = _starts(col)
    place = np.arange(len(col)) - np.repeat(starts, np.diff(np.r_[starts, len(col)]))
    kept = place < most
    state = _settle(np.r_[col[kept], col[starts]], np.r_[row[kept], col[starts]], np.r_[w[kept], w[starts]], 1.0, least, most)
    for _ in range(rounds):
        state = _squared(state, state, inflation, least, most)
        if _chaos(state[0], state[2]).max() < settled:
            break
    else:
        raise RuntimeError(f"flow did not settle in {rounds} rounds")
    col, row, p = state
    starts = _starts(col)
    strong = p >= np.repeat(np.maximum.reduceat(p, starts), np.diff(np.r_[starts, len(col)])) / 2
    labels[col[starts]] = np.minimum.reduceat(np.where(strong, row, n), starts)
    return labels[labels]


def _joined(most: int, rounds: int, least_tie: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``a, b, weight`` between all clusters become ``node, cluster``: clusters joined until none do any more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if not held:
            return
        a, b, w = (np.concatenate(x) for x in zip(*held, strict=True))
        names, (a, b) = _renumbered(a, b)
        n = len(names)
        labels = np.arange(n)
        while True:
            a, b = np.minimum(a, b), np.maximum(a, b)
            order = _by_entry(a, b)
            a, b, w = a[order], b[order], w[order]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            a, b, w = a[first], b[first], np.add.reduceat(w, first)
            inner = np.zeros(n)
            inner[a[a == b]] = w[a == b]
            ties = np.flatnonzero((a != b) & (inner[a] > 0) & (inner[b] > 0))
            share = w[ties] / (2 * np.sqrt(inner[a[ties]] * inner[b[ties]]))
            ties, share = ties[share >= least_tie], share[share >= least_tie]
            to = _local_clusters(n, a[ties], b[ties], share, most, rounds)
            nodes = np.unique(np.r_[a[ties], b[ties]])
            if len(np.unique(to[nodes])) == len(nodes):
                break
            labels, a, b = to[labels], to[a], to[b]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[labels])], ["node", "cluster"])

    return run


def graph_clusters(edges: DataFrame, *, most: int = LINKS, least_tie: float = LEAST_TIE, homes: tuple[DataFrame, int] | None = None) -> DataFrame:
    """``node, cluster`` by Markov clustering of the graph ``a, b, weight`` (a < b), then of its clusters until none join.

    Markov clustering cuts a large cluster of a sparse graph into many small ones, so these are nodes in turn. The tie of two
    is the sum of the edges between them as a share of those within each; a cluster without inner edges stays as it is.
    Of few ties one task does all that is left. ``homes`` as for ``markov_clusters``.
    """
    found = markov_clusters(edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), most=most, rounds=ROUNDS, homes=homes)
    labels = materialise(found.select("node", "cluster"), "labels")
    ties = materialise(_contracted(edges, labels), "ties")
    while True:
        last = ties.count() <= TIES
        if last:
            joined = materialise(ties.select("a", "b", "weight").repartition(1).mapInArrow(_joined(MOST, ROUNDS, least_tie), "node long, cluster long"), "joined")
        else:
            inner = ties.filter("a = b").select(F.col("a").alias("node"), F.col("weight").alias("inner"))
            scaled = (
                ties.filter("a < b")
                .join(inner.select(F.col("node").alias("a"), F.col("inner").alias("x")), "a")
                .join(inner.select(F.col("node").alias("b"), F.col("inner").alias("y")), "b")
                .select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("weight") / (2 * F.sqrt(F.col("x") * F.col("y")))).alias("weight"))
            )
            scaled = materialise(scaled.filter(F.col("weight") >= least_tie), "scaled")
            joined = materialise(markov_clusters(scaled, most=MOST, rounds=ROUNDS).select("node", "cluster"), "joined", old=scaled)
            n, fewer = joined.agg(F.count("node"), F.countDistinct("cluster")).first()
            if n == fewer:
                discard(joined)
                discard(ties)
                return labels
        moved = joined.select(F.col("node").alias("cluster"), F.col("cluster").alias("to"))
        labels = materialise(labels.join(moved, "cluster", "left").select("node", F.coalesce("to", "cluster").alias("cluster")), "labels", old=labels)
        if not last:
            ties = materialise(_contracted(ties, joined), "ties", old=ties)
        discard(joined)
        if last:
            discard(ties)
            return labels


def vector_clusters(
    vectors: DataFrame,
    *,
    id_: str = "vec_id",
    vector: str = "embedding",
    dim: int = 64,
    cells: int | None = None,
    near: float = NEAR,
    least_tie: float = LEAST_TIE,
    least_cosine: float = LEAST_COSINE,
    refine: int = 3,
) -> tuple[DataFrame, Callable[[DataFrame, str, list[str]], DataFrame]]:
    """``id, cluster, cosine, flow`` of every vector in a cluster, and a function that assigns other vectors (without a flow).

    Clusters are numbered from 0. Unusable vectors and those far from every direction have no row; a collection without
    usable vectors has none. ``cells`` is the number of cells of the search for neighbours, one for each 5,000 vectors if
    not given. Ids must be unique.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).alias("v"))
    cell = neighbours.CELL if cells is None else max(1, rows.filter(F.size("v") == dim).count() // cells)
    layout = neighbours.layout_of(rows, id_="id", vector="v", dim=dim, cell=cell)
    found = neighbours.nearest(rows, id_="id", vector="v", dim=dim, layout=layout, least=near)
    edges = materialise(found.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.max("cosine").alias("weight")), "edges")
    homes = neighbours.homes(rows, layout, PART, id_="id", vector="v", dim=dim) if layout else None  # near vectors are in one part
    labels = graph_clusters(edges, least_tie=least_tie, homes=homes)
    kept = labels.groupBy("cluster").count().filter(F.col("count") >= LEAST_MEMBERS).select("cluster").orderBy("cluster").collect()  # one row for each cluster
    numbers = spark.createDataFrame([(r["cluster"], i) for i, r in enumerate(kept)], "cluster long, own int")
    owned = labels.join(numbers, "cluster").select(F.col("node").alias("id"), "own")
    held = materialise(rows.join(owned, "id", "left").select("id", F.coalesce("own", F.lit(-1)).alias("own"), "v"), "held", old=labels)
    same, means = np.arange(len(kept)), np.zeros((len(kept), dim))
    for step in range(1 + refine if len(kept) else 0):
        shared = spark.sparkContext.broadcast((same, means))
        sums = total_rows(held.select("own", "v").mapInArrow(_directions(shared, dim, least_cosine, step == 0), ROWS), {0: means.shape, 1: (len(means), 1)})
        means = np.where(np.linalg.norm(sums[0], axis=1, keepdims=True) > 0, _unit(sums[0]), means)
        parts = _merged(means, SAME)  # of one cluster
        merged = np.zeros((parts.max() + 1, dim))
        np.add.at(merged, parts, means * np.maximum(sums[1], 1e-9))
        same, means = parts[same], _unit(merged)
    final = spark.sparkContext.broadcast((same, means))

    def placed(df: DataFrame, keep: list[str]) -> DataFrame:
        fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
        return df.mapInArrow(_assign(final, dim, least_cosine), f"{fields}, cluster int, cosine double")

    def assign(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
        return placed(df.select(*keep, F.lit(-1).alias("__own"), F.col(column).alias("__v")), keep)

    members = placed(held.select("id", "own", "v"), ["id"])
    sent = _flow(edges, held.filter("own >= 0").select("id", "own"))  # one row for each id, so the join goes where nobody reads the flow
    return members.join(sent, "id", "left").select("id", "cluster", "cosine", F.coalesce("flow", F.lit(0.0)).alias("flow")), assign


def _flow(edges: DataFrame, owned: DataFrame) -> DataFrame:
    """``id, flow``: what a step of the walk brings to each node from the other nodes of its cluster."""
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    total = both.groupBy("a").agg(F.sum("weight").alias("total"))
    steps = both.join(total, "a").select("a", "b", (F.col("weight") / F.col("total")).alias("share"))
    inside = steps.join(owned.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(owned.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
    return inside.filter("x = y").groupBy(F.col("b").alias("id")).agg(F.sum("share").alias("flow"))


def named_clusters(members: DataFrame, labelled: DataFrame) -> DataFrame:
    """``id, cluster, cosine, name``: the name most labelled rows of the cluster carry, the lesser one at a tie.

    ``labelled`` has ``cluster, name``; negative and null names are unknown. Clusters that no labelled row names have no row.
    """
    votes = labelled.filter("name >= 0").groupBy("cluster", "name").count()
    names = votes.groupBy("cluster").agg(F.min_by("name", F.struct(-F.col("count"), "name")).alias("name"))
    return members.join(names, "cluster")


def typical_members(members: DataFrame, top: int = 5) -> DataFrame:
    """The members of the strongest flow, with the cluster's size."""
    by = Window.partitionBy("name").orderBy(F.desc("flow"), F.desc("cosine"), "id")
    sizes = members.groupBy("name").agg(F.count(F.lit(1)).alias("size"))
    best = members.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top)
    return best.join(sizes, "name").select("name", "size", "rank", "id", "cosine", "flow")
