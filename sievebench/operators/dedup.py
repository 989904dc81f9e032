"""Exact and greedy deduplication."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievebench.operators.similarity import ROWS, _error, _exact, dense, unit


def first_by(rows: DataFrame, key: str, ord_: str = "ord") -> DataFrame:
    """The first row of each value of ``key`` by ``ord``; null is a value like any other.

    By aggregation, not by a window: only the least row of each task's copies is shuffled, so a text that many rows
    repeat makes no hot task. ``ord`` must be unique.
    """
    fields = [c for c in rows.columns if c not in (key, ord_)]
    if any(_unordered(rows, c) for c in fields):
        kept = rows.groupBy(key).agg(F.min(ord_).alias("__first")).select("__first")
        return rows.join(kept, F.col(ord_) == F.col("__first"), "left_semi")
    best = rows.groupBy(key).agg(F.min(F.struct(ord_, *fields)).alias("__row"))
    return best.select(*[F.col(key) if c == key else F.col(f"__row.{c}") for c in rows.columns])


def _unordered(rows: DataFrame, column: str) -> bool:
    kind = rows.schema[column].dataType.simpleString()
    return "map<" in kind or "variant" in kind


def greedy_keep(ords: np.ndarray, vectors: np.ndarray, eligible: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each row, in order, is no duplicate of an accepted one; only eligible rows that are kept are accepted."""
    kept = np.zeros(len(ords), bool)
    accepted = np.zeros_like(vectors)
    n = 0
    for i in np.argsort(ords, kind="stable"):
        kept[i] = not n or np.round((accepted[:n] @ vectors[i]).max(), 12) < threshold
        if kept[i] and eligible[i]:
            accepted[n] = vectors[i]
            n += 1
    return kept


#: Items that a task holds at once, and the cells it deals them to.
HELD, CELLS = 65_536, 64


def _cells(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit centres of up to ``CELLS`` cells, and the cell of the greatest product for each row."""
    centres = x[:: max(1, len(x) // CELLS)][:CELLS].copy()
    some = x[:: max(1, len(x) // 8192)]
    for _ in range(3):
        near, sums = (some @ centres.T).argmax(1), np.zeros(centres.shape)
        np.add.at(sums, near, some)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-3, unit(sums), centres).astype(np.float32)
    return centres, (x @ centres.T).argmax(1)


def _firsts(names: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of the rows that don't equal one of a lesser name."""
    odd = np.arange(1, 2 * x.shape[1], 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key = ((x + 0.0).view(np.uint64) * odd).sum(1)
    order = np.lexsort((names, key))
    runs = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    leader = np.repeat(order[runs], np.diff(np.r_[runs, len(order)]))
    return np.sort(order[(leader == order) | (x[leader] != x[order]).any(1)])


def _edges(threshold: float):
    """Pairs within the threshold of a held acceptor and a streamed vector.

    Vectors that near are at most ``reach`` apart, so an acceptor whose products with its best centre and another
    differ by more than ``reach`` allows has no partner in the cell of that other. Products are taken in single precision;
    those near the threshold are decided in double precision.
    """

    def run(held, stream) -> Iterator[pa.RecordBatch]:
        accs, q = held
        accs, q = np.array(accs, np.int64), unit(q)
        coarse, reach = q.astype(np.float32), np.sqrt(max(0.0, 2 - 2 * (threshold - 1e-11)))
        least = np.float32(threshold - 1e-11 - _error(q.shape[1]))

        def pairs(names: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = _firsts(names, x)
            names, x = names[first], unit(x[first])
            fine = x.astype(np.float32)
            centres, cell = _cells(fine)
            order = np.argsort(cell, kind="stable")
            starts = np.searchsorted(cell[order], np.arange(len(centres) + 1))
            score = coarse @ centres.T
            top = score.argmax(1)
            apart = np.linalg.norm(centres[:, None].astype(float) - centres[None], axis=2)
            asks = score.max(1)[:, None] - score <= reach * apart[top] + 1e-3
            for c in range(len(centres)):
                own, asking = order[starts[c] : starts[c + 1]], np.flatnonzero(asks[:, c])
                for low in range(0, len(own) and len(asking), ROWS):
                    of = asking[low : low + ROWS]
                    for begin in range(0, len(own), ROWS):
                        at = own[begin : begin + ROWS]
                        found = np.flatnonzero((coarse[of] @ fine[at].T >= least).ravel())
                        b, a = np.divmod(found, len(at))
                        b, a = of[b], at[a]
                        good = _exact(q, x, b, a) >= threshold
                        if good.any():
                            yield pa.RecordBatch.from_arrays([pa.array(names[a[good]]), pa.array(accs[b[good]])], ["vid", "earlier"])

        names, parts, n = [], [], 0
        for own, x in stream:
            names += own
            parts.append(x)
            n += len(own)
            if n >= HELD:
                yield from pairs(np.array(names, np.int64), np.concatenate(parts))
                names, parts, n = [], [], 0
        if n:
            yield from pairs(np.array(names, np.int64), np.concatenate(parts))

    return run


def _digests(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = dense(batch.column(1), dim) + 0.0  # no negative zeros
            keys = [hashlib.blake2b(row, digest_size=16).digest() for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(2)], ["ord", "key", "may"])

    return run


def semantic_dedup(rows: DataFrame, threshold: float = 0.95, *, dim: int = 64, eligible: str | None = None, rounds: int = 100) -> DataFrame:
    """``ord, kept``: greedy deduplication in order, exactly as a sequential scan would do it.

    A row is dropped if an earlier *accepted* row is within the threshold; rows that aren't ``eligible`` can be dropped but
    never accepted. Equal vectors share their neighbours, and only the first eligible of them can be accepted, so they
    count as one; they are found by a digest, so vectors themselves travel once (pairs of a later one of them join no
    ``facts``). The pairs of different vectors within the
    threshold come from a join in blocks; then acceptors are
    settled in rounds: one all of whose earlier neighbours are settled is settled, so a chain a-b-c keeps a and c. Each
    round is a join over the pairs only; rounds are as many as the longest chain of neighbours, and running out of them
    raises.
    """
    from sievebench.operators.similarity import in_blocks
    from sievebench.session import discard, materialise

    may = F.col(eligible) if eligible else F.lit(True)
    base = materialise(rows.select(F.col("ord").cast("long").alias("item"), "vector", may.alias("may")), "greedy")
    keyed = base.mapInArrow(_digests(dim), "ord long, key binary, may boolean")
    groups = keyed.groupBy("key").agg(F.min("ord").alias("vid"), F.max("ord").alias("last"), F.min(F.when(F.col("may"), F.col("ord"))).alias("acc"), F.count(F.lit(1)).alias("n"))
    groups = materialise(groups, "groups")
    facts = groups.select("vid", "last", "acc")
    same = keyed.join(groups.filter("n > 1").select("key", "vid"), "key").select("ord", "vid")  # of several equal rows
    same = materialise(same, "same")
    later = materialise(same.filter("ord <> vid").select(F.col("ord").alias("item")), "later")
    accepts = facts.filter("acc IS NOT NULL").select(F.col("vid").alias("item"), "acc")
    once = base.select("item", "vector").join(later, "item", "left_anti")
    acceptors = once.join(accepts, "item").select(F.col("acc").alias("qid"), "vector") if eligible else once.select(F.col("item").alias("qid"), "vector")
    pairs = in_blocks(acceptors, base, _edges(threshold), "vid long, earlier long", dim=dim)
    pairs = materialise(pairs.filter("vid <> earlier"), "near")
    discard(base)
    edges = materialise(pairs.join(facts, "vid").filter("earlier < last AND (acc IS NULL OR earlier <> acc)").select("vid", "earlier", "acc"), "pairs", old=pairs)
    before = edges.filter("earlier < acc")
    waiting = before.select("vid").distinct().withColumn("open", F.lit(True))
    state = materialise(facts.filter("acc IS NOT NULL").join(waiting, "vid", "left").select("vid", "acc", F.when(F.col("open"), F.lit(None)).otherwise(F.lit(True)).cast("boolean").alias("kept")), "state")
    for _ in range(rounds):
        if not state.filter("kept IS NULL").limit(1).count():
            break
        known = state.select(F.col("acc").alias("earlier"), F.col("kept").alias("taken"), F.col("kept").isNull().alias("waits"))
        seen = before.join(known, "earlier").groupBy("vid").agg(F.max(F.coalesce("taken", F.lit(False))).alias("hit"), F.max("waits").alias("waits"))
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit"), F.lit(False)).when(~F.col("waits"), F.lit(True))
        state = materialise(state.join(seen, "vid", "left").select("vid", "acc", new.alias("kept")), "state", old=state)
    else:
        if state.filter("kept IS NULL").limit(1).count():
            raise RuntimeError(f"greedy deduplication did not settle in {rounds} rounds")
    taken = state.filter("kept").select(F.col("acc").alias("earlier"))
    others = edges.join(taken, "earlier", "left_semi").select("vid", "earlier").unionByName(state.filter("kept").select("vid", F.col("acc").alias("earlier")))
    first = others.groupBy("vid").agg(F.min("earlier").alias("first"))
    held = groups.filter("n = 1").select(F.col("vid").alias("ord"), "vid").unionByName(same.select("ord", "vid")).join(first, "vid", "left")
    return held.select("ord", (F.col("first").isNull() | (F.col("ord") <= F.col("first"))).alias("kept"))


def dedup_rate(kept: DataFrame) -> DataFrame:
    """The share of rows dropped; 0 of none."""
    return kept.agg(F.coalesce(F.avg((~F.col("kept")).cast("double")), F.lit(0.0)).alias("rate"))
