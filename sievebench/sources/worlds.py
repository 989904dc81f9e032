"""Synthetic collections with known structure, made by numpy from one seed (small; for acceptance runs and tests)."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from sievebench.functions.vectors import sample_vmf, sphere_uniform


def stream(seed: int, name: str) -> np.random.Generator:
    """An independent generator for each name."""
    return np.random.default_rng([seed, int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big")])


def toy_world(
    spark: SparkSession,
    *,
    d: int = 64,
    components: int = 8,
    chunks: int = 640,
    queries: int = 5000,
    kappa_chunk: float = 150.0,
    kappa_query: float = 400.0,
    offset: float = 0.35,
    sub_shares: tuple[float, float] = (0.7, 0.3),
    skew: float = 1.1,
    seed: int = 0,
) -> dict[str, DataFrame]:
    """``chunks`` (``item, doc_id, vector, component``) and ``queries`` (``query_id, split, vector, component``).

    Chunks spread evenly around component means; demand falls as ``1 / rank ** skew`` and goes to two off-centre modes of
    each component, which the chunks don't show. Queries are split 60/25/15.
    """
    rng = stream(seed, "toy_world")
    means = sphere_uniform(components, d, rng)
    rows = [(f"toychunk:{i:04d}", f"toydoc:{i // 4}", sample_vmf(means[i % components], kappa_chunk, 1, rng)[0].tolist(), i % components) for i in range(chunks)]
    demand = 1 / np.arange(1, components + 1) ** skew
    modes = []
    for m in means:
        side = rng.standard_normal((2, d))
        side -= (side @ m)[:, None] * m
        moved = m + offset * side / np.linalg.norm(side, axis=1, keepdims=True)
        modes.append(moved / np.linalg.norm(moved, axis=1, keepdims=True))
    which = rng.choice(components, queries, p=demand / demand.sum())
    mode = rng.choice(2, queries, p=sub_shares)
    edge = [int(0.6 * queries), int(0.6 * queries) + int(0.25 * queries)]
    asked = []
    for i in range(queries):
        split = "train" if i < edge[0] else "anchor" if i < edge[1] else "oracle"
        asked.append((f"toyquery:{split}:{i:05d}", split, sample_vmf(modes[which[i]][mode[i]], kappa_query, 1, rng)[0].tolist(), int(which[i])))
    return {
        "chunks": spark.createDataFrame(rows, "item string, doc_id string, vector array<double>, component int"),
        "queries": spark.createDataFrame(asked, "query_id string, split string, vector array<double>, component int"),
    }
