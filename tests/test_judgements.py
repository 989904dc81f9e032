"""Graded judgements, soft demand, diversity, generation, stores and small helpers: known values and brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievebench.functions import text as T
from sievebench.operators import demand as D
from sievebench.operators import diversity as V
from sievebench.operators import fidelity as A
from sievebench.operators import generation as N
from sievebench.operators import judgements as J
from sievebench.operators import mixture as M
from sievebench.operators import ranking as R
from sievebench.operators import sampling as S


def table(spark, x, dim=None):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vector array<double>")


def test_kappa_and_alpha(spark):
    a, b = [0, 1, 2, 3, 3, 0, 1], [0, 1, 2, 3, 2, 1, 1]
    pairs = spark.createDataFrame([*zip(a, b, strict=True), (None, 1)], "a int, b int")
    m = J.confusion(pairs)
    assert m.count() == 16 and m.agg(F.sum("n")).first()[0] == 7
    o = np.zeros((4, 4))
    for x, y in zip(a, b, strict=True):
        o[x, y] += 1
    w = (np.subtract.outer(np.arange(4), np.arange(4)) / 3) ** 2
    want = 1 - (w * o).sum() / (w * np.outer(o.sum(1), o.sum(0)) / o.sum()).sum()
    assert J.weighted_kappa(m).first()[0] == pytest.approx(want)
    c = o + o.T
    n = c.sum(1)
    d2 = np.array([[0 if i == j else (n[min(i, j) : max(i, j) + 1].sum() - (n[i] + n[j]) / 2) ** 2 for j in range(4)] for i in range(4)])
    want = 1 - (n.sum() - 1) * (c * d2).sum() / (np.outer(n, n) * d2).sum()
    assert J.ordinal_alpha(m).first()[0] == pytest.approx(want)
    same = J.confusion(spark.createDataFrame([(2, 2), (1, 1)], "a int, b int"))
    assert J.weighted_kappa(same).first()[0] == 1.0 and J.ordinal_alpha(same).first()[0] == 1.0
    assert J.weighted_kappa(J.confusion(pairs.limit(0))).first()[0] is None
    bias = J.bias_report(m).first()
    assert bias["mean_delta"] == pytest.approx(0.0) and bias["accuracy"] == 1.0 and bias["over"] == pytest.approx(1 / 7)
    assert J.calibration(0.7, 0.95, 300) == {"verdict": "PASS", "provisional": False} and J.calibration(0.5, 0.9, 60)["verdict"] == "MARGINAL"
    with pytest.raises(ValueError):
        J.calibration(0.7, 0.95, 10)


def test_graded_ndcg_and_holes(spark):
    queries = spark.createDataFrame([("q",), ("z",)], "qid string")
    grades = spark.createDataFrame([("q", "a", 3), ("q", "b", 1), ("q", "c", 0)], "qid string, item string, grade int")
    ranks = spark.createDataFrame([("q", "a", 2), ("q", "b", 1)], "qid string, item string, rank int")
    got = {r["qid"]: r["score"] for r in J.graded_ndcg(queries, grades, ranks).collect()}
    assert got == {"q": pytest.approx((7 / np.log2(3) + 1) / (7 + 1 / np.log2(3))), "z": 0.0}
    binary = J.graded_ndcg(queries, grades.withColumn("grade", F.least("grade", F.lit(1))), ranks).collect()
    assert {r["qid"]: r["score"] for r in binary}["q"] == 1.0
    runs = spark.createDataFrame([("s", "q", x, i + 1) for i, x in enumerate("xayc")], "system string, qid string, item string, rank int")
    assert J.hole_rate(runs, grades, 4).first()["hole_rate"] == 0.5
    assert [(r["item"], r["rank"]) for r in J.condensed(runs, grades).orderBy("rank").collect()] == [("a", 1), ("c", 2)]
    exact = spark.createDataFrame([("q", x, s) for x, s in zip("xaycg", (0.9, 0.8, 0.7, 0.6, 0.1), strict=True)], "qid string, item string, score double")
    pool = J.pooled(runs, spark.createDataFrame([("q", "g")], "qid string, item string"), exact, depth=3, most=3).collect()
    assert {r["item"] for r in pool} == {"g", "x", "a"} and all(r["capped"] for r in pool)
    assert J.needs_pooling(0.95, 0.7) and not J.needs_pooling(0.8, 0.7)


def test_soft_demand(spark):
    rng = np.random.default_rng(0)
    g = rng.dirichlet(np.ones(3), 40)
    hard = rng.integers(0, 4, 40)
    found = spark.createDataFrame([(i, int(hard[i]), k, float(g[i, k])) for i in range(40) for k in range(3)], "query_id int, cluster int, component int, gamma double")
    shares = D.transport(found)
    assert all(abs(r[1] - 1) < 1e-12 for r in shares.groupBy("component").agg(F.sum("share")).collect())
    got = {r["cluster"]: r["p_hat"] for r in D.projected_demand(shares, D.responsibility_demand(found), 5).collect()}
    assert got == {c: pytest.approx((hard == c).mean(), abs=1e-12) for c in range(5)}
    starved = D.transport(found.withColumn("gamma", F.when(F.col("component") == 0, 0.0).otherwise(F.col("gamma"))), spark.createDataFrame([(0, 2), (1, 1)], "component int, cluster int"))
    assert [(r["cluster"], r["share"]) for r in starved.filter("component = 0").collect()] == [(2, 1.0)]


def test_ladder_and_quotas(spark):
    counts = {8: [40, 35, 31, 30, 29, 50, 50, 50], 4: [80, 70, 60, 50], 2: [150, 110]}
    even = {c: [1 / c] * c for c in counts}
    assert D.ladder([8, 4, 2], counts, even, seeds=240, least=30)[0] == 4
    skewed = even | {4: [0.7, 0.2, 0.05, 0.05]}
    chosen, log = D.ladder([8, 4, 2], counts, skewed, seeds=240, least=30)
    assert chosen == 2 and [x["fits"] for x in log] == [False, False, True]
    assert D.ladder([8], counts, even, seeds=10, least=30)[0] == 8
    tilted = D.tilt(spark.createDataFrame([(0, 2 / 3), (1, 1 / 3)], "cluster int, p_hat double"), 0.7)
    assert [r["quota"] for r in D.quotas(spark, tilted, 12, 3).orderBy("cluster").collect()] == [7, 5]
    with pytest.raises(ValueError):
        D.quotas(spark, tilted, 5, 3)


def test_vendi_and_mauve(spark):
    assert V.vendi(table(spark, [np.eye(4)[0]] * 9), dim=4).first()["vendi"] == pytest.approx(1.0)
    assert V.vendi(table(spark, np.eye(4)), dim=4).first()["vendi"] == pytest.approx(4.0)
    x = np.random.default_rng(1).standard_normal((60, 4))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    p = np.maximum(np.linalg.eigvalsh(u @ u.T / 60), 0)
    p = p[p > 1e-12] / p.sum()
    assert V.vendi(table(spark, x), dim=4).first()["vendi"] == pytest.approx(np.exp(-(p * np.log(p)).sum()))
    assert V.vendi(table(spark, []), dim=4).first()["vendi"] is None
    assert V.frontier_area(np.array([5, 5]), np.array([5, 5])) == pytest.approx(1.0)
    assert V.frontier_area(np.array([9, 0]), np.array([0, 9])) < 0.1
    a, far = table(spark, u), table(spark, u + 5)
    assert V.mauve(a, a, buckets=4).first()[0] == pytest.approx(1.0) and V.mauve(a, far, buckets=4).first()[0] < 0.5
    assert V.mauve(a, a.limit(0)).first()[0] is None


def test_two_sample_scores_all_rows(spark):
    """The fit may be bounded, the score isn't: n counts all rows and the AUC ranks all held-out ones."""
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((400, 3)), rng.standard_normal((300, 3)) + 0.8
    few, all_ = (A.c2st(table(spark, a), table(spark, b), most=m).first() for m in (60, 20_000))
    assert few["n"] == all_["n"] == 300 and abs(few["auc"] - all_["auc"]) < 0.05 and all_["auc"] > 0.75
    scored = spark.createDataFrame([(int(rng.random() < 0.4), float(np.round(rng.standard_normal(), 1))) for _ in range(500)], "side int, score double")
    pdf = scored.toPandas()
    assert A.auc_by(scored.withColumn("g", F.lit(1)), ["g"]).first()["auc"] == pytest.approx(A.auc(pdf["score"].to_numpy(), pdf["side"].to_numpy()))
    assert A.auc_by(scored.filter("side = 1").withColumn("g", F.lit(1)), ["g"]).first()["auc"] is None
    coefficients = A.c2st_coefficients(table(spark, a), table(spark, b)).collect()
    assert len(coefficients) == 3 and all(r["coefficient"] > 0 for r in coefficients)
    assert A.c2st_coefficients(table(spark, a), table(spark, b).limit(0)).count() == 0
    assert A.mmd_rbf(table(spark, a), table(spark, a), dim=3).first()[0] == 0.0 and A.mmd_rbf(table(spark, a), table(spark, b), dim=3).first()[0] > 0.02


def test_percentiles_and_numbers(spark):
    rng = np.random.default_rng(3)
    for values in (rng.standard_normal(700), np.r_[np.zeros(500), 1.0, 2.0], [4.0]):
        df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "x double")
        for share in (0.0, 0.05, 0.37, 1.0):
            assert R.exact_percentile(df, "x", share, few=50) == pytest.approx(np.percentile(values, 100 * share))
    assert R.exact_percentile(df.limit(0), "x", 0.5) is None
    rows = spark.createDataFrame([(f"k{i:04d}",) for i in rng.permutation(900)], "k string").repartition(7)
    monkey, R.BUCKET_ROWS = R.BUCKET_ROWS, 100
    try:
        assert [r["i"] for r in R.numbered(rows, "k").orderBy("k").collect()] == list(range(900))
    finally:
        R.BUCKET_ROWS = monkey
    picked = S.stratified_sample(rows.withColumn("g", F.substring("k", 5, 1)), "k", "g", 25, "x")
    assert picked.count() == 25 and {r["count"] for r in picked.groupBy("g").count().collect()} == {2, 3}
    assert S.stratified_sample(rows.withColumn("g", F.lit(1)), "k", "g", 5000, "x").count() == 900
    long, short = (S.nested_reference(rows, "k", n).orderBy("place").collect() for n in (50, 20))
    assert [r["k"] for r in long][:20] == [r["k"] for r in short]


def test_prompts(spark):
    row = spark.createDataFrame([(["a", "b"], ["x"], 0.4295)], "texts array<string>, ex array<string>, cos double")
    plain = row.select(T.prompt(F.col("texts"), F.array().cast("array<string>"), T.instruction(F.lit("howto")), F.lit(1), 3)).first()[0]
    assert plain.startswith("You are given evidence") and "Evidence:\n[chunk] a\n[chunk] b\n\nInstruction: Write one how-do-I" in plain and plain.endswith("Variant 2 of 3 - vary the angle or facet from other variants.")
    styled = row.select(T.prompt(F.col("texts"), F.col("ex"), T.instruction(F.lit("zz")), F.lit(0), 1)).first()[0]
    assert "[chunk] b\n\nReal user queries from this system (match their length, register, and tone):\n- x\n\nInstruction: Write one realistic" in styled
    revised = row.select(T.revise_prompt(F.lit("old"), F.col("cos"), 0.6, F.col("texts"), F.col("ex"), F.lit("I"))).first()[0]
    assert revised.startswith(f"REVISE_REQUEST\nYour previous query drifted from its retrieval target\n(cosine to target {0.4295:.3f} < required 0.6).\n\nPrevious query: old\n\nEvidence:\n")
    assert row.select(T.capitalise(F.lit("the Thing")), T.capitalise(F.lit(""))).first()[:] == ("The Thing", "")


def test_generation_with_revision(spark):
    chunks = spark.createDataFrame([(f"toychunk:{i:04d}", v) for i, v in enumerate(np.eye(4).tolist())], "text string, vector array<double>")
    bank = N.Bank(chunks)
    seeds = spark.createDataFrame([("s0", ["toychunk:0000"], [1.0, 0.0, 0.0, 0.0], "factoid"), ("s1", ["toychunk:0001"], [0.0, 0.0, 1.0, 0.0], "howto"), ("s2", ["toychunk:0002", "toychunk:0003"], None, "zz")], "seed_id string, chunk_ids array<string>, z array<double>, query_type string")
    texts = chunks.select(F.col("text").alias("chunk_id"), "text")
    contexts = N.assemble(seeds, texts)
    chat = N.toy_chat(bank, style=0.0, noise=0.3, dim=4)
    made = {r["qid"]: r for r in N.generate(N.requests(contexts, 2), chat, seeds.select("seed_id", "z"), namespace="n").collect()}
    assert len(made) == 6 and made["synq-s0-0"]["revisions"] == 0 and made["synq-s0-0"]["cos_to_target"] > 0.6
    assert made["synq-s1-0"]["revisions"] == 1 and made["synq-s1-0"]["embedding_ref"] == "n|synq-s1-0#a1" and made["synq-s2-1"]["cos_to_target"] is None
    assert len({r["text"] for r in made.values()}) == 6 and all(abs(np.linalg.norm(r["vector"]) - 1) < 1e-9 for r in made.values())
    with pytest.raises(Exception, match="unknown chunk"):
        N.assemble(seeds.withColumn("chunk_ids", F.array(F.lit("zz"))), texts).collect()
    with pytest.raises(Exception, match="no banked token"):
        chat(spark.createDataFrame([("q", "nothing here")], "qid string, prompt string")).collect()
    with pytest.raises(NotImplementedError):
        N.assemble(seeds, texts, two_step=True)
    anchored = {r["seed_id"]: r["vector"] for r in N.anchors(seeds, chunks.withColumnRenamed("text", "item")).collect()}
    assert anchored["s2"] == pytest.approx([0, 0, 0.5**0.5, 0.5**0.5])
    bank.put(spark.createDataFrame([("new", [1.0, 0.0, 0.0, 0.0])], "text string, vector array<double>"))
    assert bank.get(spark.createDataFrame([("new",)], "text string")).count() == 1
    with pytest.raises(Exception, match="no vector banked"):
        bank.get(spark.createDataFrame([("old",)], "text string")).collect()


def test_mock_models(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,), ("",)], "text string")
    got = N.mock_vectors(rows, dim=8, seed=3).collect()
    assert got[0]["vector"] == got[1]["vector"] and got[2]["vector"] is None and abs(np.linalg.norm(got[3]["vector"]) - 1) < 1e-9
    judged = rows.select(N.toy_judge(F.lit(0.5), "text", has_evidence=F.lit(True)), N.toy_judge(F.lit(None).cast("double"), "text", no_evidence_share=100), N.mock_judge(F.lit(False)))
    assert judged.first()[:] == (True, True, False)


def test_stores_and_artifacts(spark, tmp_path):
    from sievebench.sources.stores import Artifacts, ParquetStore, cached_vectors

    store = ParquetStore(spark, str(tmp_path / "store"), 2)
    calls = []

    def embed(missing):
        calls.append(missing.count())
        return missing.withColumn("embedding", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")))

    rows = spark.createDataFrame([("x", "aa"), ("x", "aa"), ("y", "b"), (None, "c")], "id string, text string")
    first = {r["id"]: r["embedding"] for r in cached_vectors(rows, store, embed).collect()}
    assert first == {"x": [2.0, 1.0], "y": [1.0, 1.0], None: None} and calls == [2]
    cached_vectors(rows, store, embed).collect()
    assert calls == [2]
    store.store_vectors(spark.createDataFrame([("x", [9.0, 9.0], "aa")], "id string, embedding array<float>, document string"), {"model": "m"})
    held = {r["id"]: (r["embedding"], r["metadata"]) for r in store.read().collect()}
    assert held == {"x": ([9.0, 9.0], {"model": "m"}), "y": ([1.0, 1.0], {})}
    with pytest.raises(Exception, match="wrong size"):
        store.store_vectors(spark.createDataFrame([("z", [9.0], "zz")], "id string, embedding array<float>, document string"))
    folder = Artifacts(str(tmp_path / "made"))
    model = M.Mixture(np.array([0.4, 0.6]), np.eye(2), np.array([3.0, 9.0]), -1.5)
    M.save_mixture(spark, model, folder, "mixture")
    M.save_partition(spark, np.eye(3), folder, "partition")
    again = M.load_mixture(spark, folder, "mixture")
    assert np.array_equal(again.mean, model.mean) and np.array_equal(again.kappa, model.kappa) and again.log_likelihood == -1.5
    assert np.array_equal(M.load_partition(spark, folder, "partition"), np.eye(3))


def test_sample_corpus(tmp_path):
    from sievebench.sources.sample import write_sample

    write_sample(str(tmp_path / "a"))
    write_sample(str(tmp_path / "b"))
    assert (tmp_path / "a" / "chunks.jsonl").read_bytes() == (tmp_path / "b" / "chunks.jsonl").read_bytes()
    rows = [json.loads(x) for x in (tmp_path / "a" / "chunks.jsonl").read_text().splitlines()]
    asked = [json.loads(x) for x in (tmp_path / "a" / "queries.jsonl").read_text().splitlines()]
    assert len(rows) == 200 and len({r["metadata"]["topic"] for r in rows}) == 8 and len(asked) == 120 and all(r["text"] for r in asked)


def test_benchmark_files(tmp_path, spark):
    from sievebench.sources import benchmarks as B
    from sievebench.sources.jsonl import load_query_metadata

    with pytest.raises(FileNotFoundError):
        B.discover_subcorpora(str(tmp_path))
    (tmp_path / "benchmarks").mkdir()
    with pytest.raises(FileNotFoundError):
        B.discover_subcorpora(str(tmp_path))
    for name, data in (("b", []), ("a", {"tests": [{"query": "q", "snippets": []}]}), ("c", {"x": 1})):
        (tmp_path / "benchmarks" / f"{name}.json").write_text(json.dumps(data))
    assert B.discover_subcorpora(str(tmp_path)) == ["a", "b", "c"] and len(B.read_benchmark(tmp_path / "benchmarks" / "a.json")) == 1
    with pytest.raises(TypeError):
        B.read_benchmark(tmp_path / "benchmarks" / "c.json")
    with pytest.raises(KeyError, match="known"):
        B.convert_preset(spark, "zz", "x", "y")
    (tmp_path / "queries.jsonl").write_text('{"text": "a", "metadata": {"k": "v"}}\n{"text": "b"}\n')
    assert [r["metadata"] for r in load_query_metadata(spark, str(tmp_path / "queries.jsonl")).orderBy("ord").collect()] == [{"k": "v"}, {}]
