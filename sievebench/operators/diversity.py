"""How varied a set of vectors is, and how two sets differ over a common quantisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievebench.operators.similarity import dense, unit


def _gram(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dim, dim)), 0
        for batch in batches:
            x = unit(dense(batch.column(0), dim))
            total += x.T @ x
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64())), pa.array(np.full(dim, n))], ["row", "numbers", "n"])

    return run


def vendi(vectors: DataFrame, *, dim: int = 64) -> DataFrame:
    """``vendi, ratio``: the effective number of different vectors, and its share of all; null of none.

    The eigenvalues of the kernel of all pairs are those of the ``dim`` x ``dim`` matrix of products, which is summed over
    all rows, so nothing is sampled.
    """
    spark = vectors.sparkSession
    parts = vectors.select("vector").mapInArrow(_gram(dim), "row int, numbers array<double>, n long")
    sums = parts.select("row", "n", *[F.col("numbers")[i].alias(f"c{i}") for i in range(dim)]).groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(dim)])
    rows = sorted(sums.collect())
    n = rows[0]["n"] if rows else 0
    if not n:
        return spark.createDataFrame([(None, None)], "vendi double, ratio double")
    p = np.maximum(np.linalg.eigvalsh(np.array([list(r)[2:] for r in rows]) / n), 0)
    p = p[p > 0] / p.sum()
    value = float(np.exp(-(p * np.log(p)).sum()))
    return spark.createDataFrame([(value, value / n)], "vendi double, ratio double")


def frontier_area(p: np.ndarray, q: np.ndarray, scale: float = 5.0, grid: int = 25, eps: float = 1e-6) -> float:
    """The area under the divergence frontier of two histograms, 1 for equal ones."""
    p, q = (np.asarray(x, float) + eps for x in (p, q))
    p, q = p / p.sum(), q / q.sum()
    kl = lambda a, b: float((a * np.log(a / b)).sum())
    points = [(0.0, 1.0), (1.0, 0.0)]
    for lam in np.linspace(0, 1, grid + 2)[1:-1]:
        r = lam * p + (1 - lam) * q
        points.append((np.exp(-scale * kl(q, r)), np.exp(-scale * kl(p, r))))
    x, y = np.array(sorted(points, key=lambda v: (v[0], -v[1]))).T
    return float(np.trapezoid(y, x))


def mauve(real: DataFrame, synthetic: DataFrame, *, buckets: int | None = None, seed: int = 0) -> DataFrame:
    """``mauve`` of two sets of vectors (``id, vector``): histograms over a common k-means partition and their frontier's area.

    All rows are counted, the larger side as shares. Null if a side is empty.
    """
    from sievebench.operators.mixture import assign, fit_partition

    spark = real.sparkSession
    n = min(real.count(), synthetic.count())
    if not n:
        return spark.createDataFrame([(None,)], "mauve double")
    both = real.select("vector", F.lit(0).alias("side")).unionByName(synthetic.select("vector", F.lit(1).alias("side")))
    count = buckets or min(128, max(4, n // 10))
    counts = assign(both, fit_partition(both, count, tries=1, seed=seed), ["side"]).groupBy("side", "cluster").count().collect()
    sides = np.zeros((2, count))
    for r in counts:
        sides[r["side"], r["cluster"]] = r["count"]
    sides /= sides.sum(1, keepdims=True)
    scale = n  # smoothing is per count of the smaller side
    return spark.createDataFrame([(frontier_area(sides[0] * scale, sides[1] * scale),)], "mauve double")
