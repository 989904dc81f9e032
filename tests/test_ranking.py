import math

import numpy as np
import pytest

from sievebench.operators import ranking as R
from sievebench.operators.similarity import gold_ranks, nearest_items


def basis(n, d=8):
    return [[1.0 if i == j else 0.0 for j in range(d)] for i in range(n)]


QUERY = [6.0, 5.0, 4.0, 3.0, 2.0, 1.0, 0.0, 0.0]


def score(spark, golds, k=10, drop=()):
    items = [(f"c{i}", v) for i, v in enumerate(basis(6))]
    pairs = spark.createDataFrame([("q", g, QUERY, dict(items)[g]) for g in golds if g not in drop], "qid string, item string, qvector array<double>, ivector array<double>")
    every = spark.createDataFrame([("q", g) for g in golds], "qid string, item string")
    held = spark.createDataFrame([(i, v) for i, v in items if i not in drop], "item string, vector array<double>")
    ranks = gold_ranks(pairs, held, {"exact": np.eye(8)}, dim=8)
    return R.ndcg(spark.createDataFrame([("q",)], "qid string"), every, ranks.select("qid", "item", "rank"), k).first()["score"]


def test_ndcg(spark):
    assert score(spark, ["c2"]) == pytest.approx(1 / math.log2(4))
    assert score(spark, ["c2"], k=2) == 0
    assert score(spark, ["c0", "c3"]) == pytest.approx((1 + 1 / math.log2(5)) / (1 + 1 / math.log2(3)))
    assert score(spark, ["c3"], drop=("c0",)) == pytest.approx(1 / math.log2(4))
    assert score(spark, ["c3"], drop=("c3",)) == 0
    assert score(spark, []) == 0


def ranks(spark, cand, ref=None):
    ref = ref or sorted(cand)
    return spark.createDataFrame([(str(x), ref.index(x) + 1, cand.index(x) + 1) for x in cand], "id string, ref int, cand int")


def test_rank_agreement(spark):
    assert R.tau_ap(ranks(spark, [1, 0, 2, 3])).first()[0] == pytest.approx(1 / 3)
    assert R.tau_ap(ranks(spark, [0, 1, 2, 3])).first()[0] == pytest.approx(1)
    assert R.tau_ap(ranks(spark, [3, 2, 1, 0])).first()[0] == pytest.approx(-1)
    assert R.rbo_ext(ranks(spark, [0, 1, 2])).first()[0] == pytest.approx(1)
    apart = spark.createDataFrame([("a", 1, None), ("b", None, 1)], "id string, ref int, cand int")
    assert R.rbo_ext(apart).first()[0] == pytest.approx(0)
    assert R.rbo_ext(ranks(spark, [1, 0, 2, 3])).first()[0] < R.rbo_ext(ranks(spark, [0, 1, 3, 2])).first()[0]
    t = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0), ("c", 2.0, 3.0)], "id string, x double, y double")
    assert R.kendall_tau_b(t).first()[0] == pytest.approx(2 / math.sqrt(6))
    flat = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, 2.0)], "id string, x double, y double")
    assert R.kendall_tau_b(flat).first()[0] is None


def test_agreement_matches_tables(spark):
    rng = np.random.default_rng(0)
    a, b = rng.random((5, 40)), rng.random((5, 40))
    got = R.agreement(a, b, 50)
    t = spark.createDataFrame([(str(i), float(x), float(y)) for i, (x, y) in enumerate(zip(a.mean(1), b.mean(1)))], "id string, x double, y double")
    assert R.kendall_tau_b(t).first()[0] == pytest.approx(got["tau"])
    assert R.agreement(a, a, 10)["rbo"] == pytest.approx(1) and R.agreement(a, a, 10)["tau_ap"] == pytest.approx(1)
    assert R.gates(0.9, 0.8) and not R.gates(0.89, 0.9)


def test_bootstrap(spark):
    shifted = spark.createDataFrame([(i, 0.1 + 0.01 * (i % 3)) for i in range(50)], "i long, delta double")
    got = R.bootstrap_pvalue(shifted, 100).first()
    assert got["delta"] == pytest.approx(0.1098) and got["p_value"] < 0.05
    assert R.bootstrap_pvalue(spark.createDataFrame([(i, 0.0) for i in range(20)], "i long, delta double"), 50).first()["p_value"] >= 0.5


def test_drop_mask_and_sample(spark):
    items = spark.createDataFrame([(str(i),) for i in range(99)], "item string")
    got = R.drop_mask(items, 0.10).collect()
    assert len(got) == 99 and sum(r["dropped"] for r in got) == 9
    assert R.hash_sample(items, "item", 200, "s").count() == 99
    assert R.hash_sample(items, "item", 5, "s").count() == 5


def test_zoo():
    zoo = R.make_zoo(16)
    assert len(zoo) == 12 and np.allclose(zoo["exact"], np.eye(16))
    p = zoo["rank_0.5"]
    assert np.allclose(p @ p, p) and round(np.trace(p)) == 8


def test_nearest_items_ties_and_passes(spark):
    items = spark.createDataFrame([(i, [1.0, 0.0] if i < 6 else [0.0, 1.0]) for i in range(8)], "item long, vector array<double>")
    queries = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "qid long, vector array<double>")
    for block in (2, 100):
        got = nearest_items(queries, items, 3, dim=2, block=block).orderBy("qid", "rank").collect()
        assert [(r["qid"], r["item"]) for r in got] == [(q, i) for q in range(5) for i in range(3)]
    apart = nearest_items(queries, items, 2, dim=2, apart=True).filter("qid = 0").orderBy("rank").collect()
    assert [r["item"] for r in apart] == [1, 2]
    assert nearest_items(queries.limit(0), items, 3, dim=2).count() == 0
    assert nearest_items(queries, items.limit(0), 3, dim=2).count() == 0
    assert nearest_items(queries, items, 50, dim=2).count() == 40
