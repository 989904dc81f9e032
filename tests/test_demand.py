import pytest
from pyspark.errors import PySparkException

from sievebench.operators import demand as D


@pytest.fixture(scope="module")
def demand(spark):
    return spark.createDataFrame([(0, 0.5), (1, 0.3), (2, 0.2)], "cluster int, p_hat double")


def labels(spark, values):
    return spark.createDataFrame([(v,) for v in values], "cluster int")


def test_importance(spark, demand):
    got = {r["cluster"]: r for r in D.importance(labels(spark, [0, 0, 1, 1]), demand).collect()}
    assert [round(got[c]["weight"], 9) for c in (0, 1)] == [1.25, 0.75]
    assert got[2]["weight"] is None and round(got[0]["gap"], 9) == 0.2
    got = {r["cluster"]: round(r["weight"], 9) for r in D.importance(labels(spark, [0, 0, 1, 2]), demand).collect()}
    assert got == {0: 1.0, 1: 1.2, 2: 0.8}


def test_effective_size(spark):
    w = spark.createDataFrame([(1.25, 2), (0.75, 2)], "weight double, n long")
    assert D.effective_size(w, n="n").first()[0] == pytest.approx(16 / 4.25)
    assert D.effective_size(spark.createDataFrame([(1.0,)] * 7, "weight double")).first()[0] == pytest.approx(7)


def test_post_stratified(spark, demand):
    rows = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 0.0), (1, 0.0)], "cluster int, score double")
    assert D.post_stratified(rows, demand).first()[0] == pytest.approx(0.625)
    rows = spark.createDataFrame([(0, 1.0), (0, 0.0), (1, 0.5), (2, 0.25)], "cluster int, score double")
    assert D.post_stratified(rows, demand).first()[0] == pytest.approx(0.45)


def test_coverage_and_empty(spark, demand):
    got = {r["floor"]: r["covered"] for r in D.coverage(labels(spark, [0, 0, 1, 1]), demand, [1, 2, 3]).collect()}
    assert got == pytest.approx({1: 0.8, 2: 0.8, 3: 0.0})
    assert sorted(r[0] for r in D.empty_clusters(labels(spark, [1, 1]), 4).collect()) == [0, 2, 3]


def test_proportions(spark):
    got = [(r["cluster"], r["n"], r["p_hat"]) for r in D.proportions(labels(spark, [0, 0, 2, None]), 3).orderBy("cluster").collect()]
    assert got == [(0, 2, pytest.approx(2 / 3)), (1, 0, 0.0), (2, 1, pytest.approx(1 / 3))]
    with pytest.raises(PySparkException):
        D.proportions(labels(spark, []), 2).collect()


def test_decay(spark):
    r = spark.createDataFrame([(0, 1.0, 0.0), (1, 1.0, 10.0)], "component int, gamma double, ts double")
    got = {x["component"]: x["demand"] for x in D.responsibility_demand(r, 1.0).collect()}
    assert got[1] == pytest.approx(1 / (1 + 2**-10))
    missing = spark.createDataFrame([(0, 1.0, None), (1, 1.0, 10.0)], "component int, gamma double, ts double")
    assert {x["component"]: x["demand"] for x in D.responsibility_demand(missing, 1.0).collect()} == {0: 0.5, 1: 0.5}
    soft = spark.createDataFrame([(0, 0.2), (1, 0.8), (0, 0.6), (1, 0.4)], "component int, gamma double")
    assert {x["component"]: round(x["demand"], 9) for x in D.responsibility_demand(soft).collect()} == {0: 0.4, 1: 0.6}


def test_tilt_and_quota(spark):
    d = spark.createDataFrame([(0, 1.0), (1, 0.0)], "cluster int, p_hat double")
    assert [round(r["tilted"], 9) for r in D.tilt(d, 0.7).orderBy("cluster").collect()] == [0.85, 0.15]
    tilted = [0.7 * 2 / 3 + 0.15, 0.7 / 3 + 0.15]
    assert D.allocate(tilted, 12, 3) == [7, 5]
    with pytest.raises(ValueError):
        D.allocate(tilted, 5, 3)
