import math

import numpy as np
import pytest

from sievebench.functions import vectors as V
from sievebench.operators import dedup as D
from sievebench.operators import fidelity as A
from sievebench.operators import gate as G
from sievebench.operators import mixture as M
from sievebench.operators import sampling as S


def table(spark, x, name="id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vector array<double>")


def test_densities():
    for d in (2, 64):
        for k in (1e-9, 1.0, 1e5):
            assert math.isfinite(V.vmf_log_norm_const(d, k))
    assert V.log_bessel_i(0.5, 2.0) == pytest.approx(math.log(math.sqrt(2 / (math.pi * 2)) * math.sinh(2)), abs=1e-9)
    assert V.log_bessel_i(31, 1500) == pytest.approx(V.log_bessel_i(31, 1500.0001), abs=1e-3)
    x = V.sample_vmf(np.eye(8)[0], 100.0, 2000, np.random.default_rng(0))
    assert np.allclose(np.linalg.norm(x, axis=1), 1) and (x.mean(0) / np.linalg.norm(x.mean(0)))[0] > 0.99


def test_vector_expressions(spark):
    rows = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, None), (4, [1.0])], "i int, v array<float>")
    got = rows.select("i", V.usable("v", 2).alias("u"), V.l2_normalize("v").alias("n")).orderBy("i").collect()
    assert [r["u"] for r in got] == [True, False, False, False, False]
    assert got[0]["n"] == pytest.approx([0.6, 0.8]) and got[1]["n"] == [0.0, 0.0]


def test_mixture(spark):
    rng = np.random.default_rng(0)
    x = np.r_[V.sample_vmf(np.eye(8)[0], 80.0, 150, rng), V.sample_vmf(np.eye(8)[1], 80.0, 50, rng)]
    rows = table(spark, x)
    model = M.fit_mixture(rows, 2, dim=8, rounds=20)
    assert sorted(np.round(model.weight, 2)) == [0.25, 0.75]
    assert all(40 < k < 160 for k in model.kappa)
    soft = M.responsibilities(rows, model, ["id"])
    assert soft.groupBy("id").sum("gamma").filter("abs(`sum(gamma)` - 1) > 1e-9").count() == 0
    draws, _ = M.guarded_sample(model, rows.withColumnRenamed("id", "item"), 10, 0.5)
    assert draws.shape == (10, 8)
    with pytest.raises(RuntimeError):
        M.guarded_sample(model, rows.withColumnRenamed("id", "item"), 5, 1.1, batches=2)


def test_fidelity(spark):
    rng = np.random.default_rng(1)
    a, b, c = rng.standard_normal((80, 4)), rng.standard_normal((80, 4)), rng.standard_normal((80, 4)) + 3
    same, far = A.c2st(table(spark, a), table(spark, b)).first()["auc"], A.c2st(table(spark, a), table(spark, c)).first()["auc"]
    assert 0.3 < same < 0.7 and far > 0.9
    assert A.c2st(table(spark, a[:3]), table(spark, b[:3])).first()["auc"] is None
    assert A.mmd_rbf(table(spark, a), table(spark, a), 0.5, dim=4).first()[0] == 0.0
    assert A.mmd_rbf(table(spark, a), table(spark, c), 0.5, dim=4).first()[0] > 0.1
    s = lambda x: spark.createDataFrame([(float(v),) for v in x], "score double")
    assert A.histogram_kl(s(a[:, 0]), s(a[:, 0])).first()[0] == pytest.approx(0, abs=1e-9)
    assert A.histogram_kl(s(a[:, 0]), s(c[:, 0])).first()[0] > 1
    assert A.fidelity_objective(0.1, 0.7, 0.5, 1) == -1e9 and A.fidelity_objective(0.1, 0.7, 0.5, 9) == pytest.approx(-0.3)


def test_greedy_dedup(spark):
    angle = [0, 15, 30, 90]  # a-b and b-c are near, a-c is not: a chain keeps a and c
    x = np.array([[math.cos(math.radians(t)), math.sin(math.radians(t))] for t in angle])
    rows = table(spark, x, "ord")
    got = {r["ord"]: r["kept"] for r in D.semantic_dedup(rows, 0.95, dim=2).collect()}
    assert got == {0: True, 1: False, 2: True, 3: True}
    assert list(D.greedy_keep(np.arange(4), x, np.ones(4, bool), 0.95)) == [True, False, True, True]
    rng = np.random.default_rng(2)
    y = rng.standard_normal((120, 3))
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    fit = rng.random(120) < 0.7
    rows = spark.createDataFrame([(i, v.tolist(), bool(f)) for i, (v, f) in enumerate(zip(y, fit))], "ord long, vector array<double>, fit boolean")
    got = [r["kept"] for r in D.semantic_dedup(rows, 0.95, dim=3, eligible="fit").orderBy("ord").collect()]
    assert got == list(D.greedy_keep(np.arange(120), y, fit, 0.95))
    two = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    assert D.dedup_rate(D.semantic_dedup(table(spark, two, "ord"), 0.95, dim=2)).first()[0] == pytest.approx(1 / 3)


def test_first_by(spark):
    rows = spark.createDataFrame([(2, "a", {"k": "v"}), (1, "a", None), (3, None, None), (4, None, None)], "ord int, text string, m map<string,string>")
    assert sorted(r["ord"] for r in D.first_by(rows, "text").collect()) == [1, 3]
    assert sorted(r["ord"] for r in D.first_by(rows.drop("m"), "text").collect()) == [1, 3]


def test_mix(spark):
    rows = spark.createDataFrame([(f"r{i}", "factoid" if i < 8 else "howto") for i in range(10)] + [("x", "other")], "record_id string, stratum_key string")
    got = S.apply_mix(rows, {"factoid": 0.5, "howto": 0.5}).groupBy("stratum_key").count().collect()
    assert {r[0]: r[1] for r in got} == {"factoid": 2, "howto": 2}


def test_gate_and_labels(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", True, True), ("b", False, True), ("c", True, None)], "qid string, x boolean, y boolean")
    got = {r["qid"]: r["rejected_by"] for r in G.run_gate(rows, [("one", F.col("x")), ("two", F.col("y"))]).collect()}
    assert got == {"a": None, "b": "one", "c": "two"}
    ranked = spark.createDataFrame([("a", "c1", 1, 0.9), ("a", "c2", 2, 0.8), ("a", "c3", 3, 0.1)], "qid string, item string, rank int, score double")
    golds = spark.createDataFrame([("a", "c2"), ("b", "c9")], "qid string, item string")
    trip = {r["qid"]: (r["passed"], r["score"]) for r in G.round_trip(ranked, golds, rows).collect()}
    assert trip == {"a": (True, 0.5), "b": (False, 0.0), "c": (False, 0.0)}
    assert [r["promoted"] for r in G.uniqueness(ranked, golds, F.col("score") > 0.5).collect()] == [["c1"]]
    seeds = spark.createDataFrame([("a", ["c2", "c2"]), ("z", ["c5"])], "query_id string, chunk_ids array<string>")
    near = spark.createDataFrame([("a", "c1")], "qid string, item string")
    assert sorted((r["query_id"], r["chunk_id"]) for r in G.nearest_qrels(seeds, near).collect()) == [("a", "c1"), ("z", "c5")]
    qrels = spark.createDataFrame([("a", "c1", 1), ("a", "c0", 1)], "query_id string, chunk_id string, grade int")
    hashes = spark.createDataFrame([("c1", "h1")], "chunk_id string, content_hash string")
    texts = spark.createDataFrame([("a", "t"), ("none", "t")], "query_id string, text string")
    record = G.annotation_records(texts, qrels, hashes, "v").collect()
    assert len(record) == 1 and record[0]["crucial"] == ["c0", "c1"] and record[0]["content_hashes"] == {"c1": "h1"}


def test_stream(spark, tmp_path):
    import datetime as dt

    from sievebench.streaming import demand as St

    day = lambda d, h=1: dt.datetime(2024, 1, d, h)
    rows = spark.createDataFrame([(day(1), "a"), (day(1, 2), "a"), (day(2), "b"), (day(5), "a")], "ts timestamp, event_type string")
    rows.write.parquet(str(tmp_path / "in"))
    counts = St.windowed_counts(St.read_events(spark, str(tmp_path / "in"), "ts timestamp, event_type string"))
    query = St.write_counts(counts, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    got = {(r["event_type"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 2), ("b", 1)}
    assert St.windowed_counts(rows, watermark=None).count() == 3
