"""Blocked joins: neither side is copied, and what single precision leaves open is decided exactly."""

import numpy as np
import pytest

from sievebench.operators import dedup as D
from sievebench.operators.similarity import gold_ranks, in_blocks, nearest_items, unit


def vectors(spark, x, name):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vector array<double>")


def test_no_side_travels_for_each_block_of_the_other(spark):
    """Ten blocks of queries: a query is dealt once, and no item is."""
    rng = np.random.default_rng(1)
    queries, items = vectors(spark, rng.standard_normal((400, 8)), "qid"), vectors(spark, rng.standard_normal((300, 8)), "item")

    def run(held, stream):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([len(held[0])]), pa.array([sum(len(ids) for ids, _ in stream)])], ["q", "i"])

    found = in_blocks(queries, items, run, "q long, i long", dim=8, block=40)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    rows = found.collect()
    assert sum(r["q"] for r in rows) == 400 and {r["i"] for r in rows} == {300} and len(rows) > 5


@pytest.mark.parametrize("scale", [1.0, 1e12, 1e-12])
def test_near_ties_are_decided_in_double_precision(spark, scale):
    """Scores that differ by 1e-9 of their size are beyond single precision."""
    rng = np.random.default_rng(2)
    x = np.tile(unit(rng.standard_normal((1, 16))), (500, 1)) * (1 + 1e-9 * rng.permutation(500)[:, None])
    q = unit(rng.standard_normal((3, 16)) + 2 * x[:1])
    factor = max(scale, 1.0)  # scores are rounded to a number of places
    got = nearest_items(vectors(spark, q * factor, "qid"), vectors(spark, x / factor if scale < 1 else x * 1.0, "item"), 5, dim=16).collect()
    exact = np.round((q * factor) @ (x if scale >= 1 else x / factor).T, 12)
    for i in range(3):
        want = sorted(range(500), key=lambda j: (-exact[i, j], j))[:5]
        assert sorted((r["rank"], r["item"]) for r in got if r["qid"] == i) == list(enumerate(want, 1))


def test_pruned_cells_lose_no_pair(spark):
    """Greedy deduplication against a scan: clusters, copies of a row, and pairs on both sides of the threshold."""
    rng = np.random.default_rng(3)
    base = unit(rng.standard_normal((12, 16)))
    x = unit(np.repeat(base, 60, 0) + 0.08 * rng.standard_normal((720, 16)))
    x = np.r_[x, x[:40], np.tile(x[5], (50, 1))][rng.permutation(810)]
    rows = vectors(spark, x, "ord")
    for threshold in (0.95, 0.85):
        got = {r["ord"]: r["kept"] for r in D.semantic_dedup(rows, threshold, dim=16).collect()}
        want = D.greedy_keep(np.arange(810), x, np.ones(810, bool), threshold)
        assert [got[i] for i in range(810)] == want.tolist() and 5 < want.sum() < 760


def test_gold_ranks_up_to_a_rank(spark):
    rng = np.random.default_rng(4)
    q, x = rng.standard_normal((6, 8)), rng.standard_normal((5000, 8))
    golds = spark.createDataFrame([(f"q{i}", f"i{j}", q[i].tolist(), x[j].tolist()) for i in range(6) for j in (i, 40 + i, int((x @ q[i]).argmax()))], "qid string, item string, qvector array<double>, ivector array<double>")
    items, systems = vectors(spark, x, "item"), {"a": np.eye(8), "b": np.diag(np.arange(1.0, 9))}
    every, some = ({(r["system"], r["qid"], r["item"]): r["rank"] for r in gold_ranks(golds, items, systems, dim=8, **kw).collect()} for kw in ({}, {"most": 10}))
    for (name, qid, item), rank in every.items():
        i, j, m = int(qid[1:]), int(item[1:]), systems[name]
        scores = unit(x @ m) @ unit(q[i : i + 1] @ m)[0]
        assert rank == 1 + (scores > scores[j] + 5e-13).sum()
        assert some[name, qid, item] == rank if rank <= 10 else some[name, qid, item] > 10


def test_batches_that_better_nothing():
    """After the first batch no item is good enough for any query."""
    from sievebench.operators.similarity import _best

    x = np.eye(4)
    batches = [(list(range(8)), np.tile(x[0], (8, 1))), (list(range(8, 16)), np.tile(-x[0], (8, 1))), (list(range(16, 24)), np.tile(x[1], (8, 1)))]
    (found,) = _best(2, False)(([7, 9], x[[0, 0]]), iter(batches))
    assert found.to_pydict() == {"qid": [7, 7, 9, 9], "item": [0, 1, 0, 1], "score": [1.0] * 4}
