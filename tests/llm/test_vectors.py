"""Problems on vectors: 2 and 6; and graphs."""

import numpy as np
import pytest

from sievebench.llm import clusters, neighbours
from sievebench.llm.graphs import components


def brute(ids, x, k):
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -9)
    return {(int(ids[i]), int(ids[j])) for i in range(len(x)) for j in sorted(range(len(x)), key=lambda j: (-s[i, j], ids[j]))[:k] if j != i}


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), v if v is None else [float(a) for a in v], "clash") for i, v in zip(ids, x)], "vec_id long, embedding array<float>, block string")


def test_neighbours_are_exact_when_all_cells_are_asked(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 16))
    got = neighbours.nearest(frame(spark, x), dim=16, cell=60, probes=99, block=50)
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)
    pairs = {(r["id"], r["other"]) for r in got.collect()}
    want = brute(np.arange(400), u, 5)
    assert len(pairs & want) >= 0.999 * len(want) and len(pairs) == len(want)  # single precision may swap near ties


def test_unusable_and_copies(spark):
    rng = np.random.default_rng(1)
    x = list(rng.standard_normal((30, 8))) + [np.eye(8)[0]] * 500
    x += [None, [1.0] * 7, [0.0] * 8, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1e-30] + [0.0] * 7, [3e30] + [0.0] * 7]
    got = neighbours.nearest(frame(spark, x), dim=8, block=100)
    rows = got.collect()
    held = {}
    for r in rows:
        held.setdefault(r["id"], []).append((r["rank"], r["other"], r["cosine"]))
    assert set(held) == set(range(530)) | {535, 536}
    copies = sorted(held[400])
    assert [o for _, o, _ in copies] == [30, 31, 32, 33, 34] and min(c for _, _, c in copies) > 0.9999
    assert [o for _, o, _ in sorted(held[30])] == [31, 32, 33, 34, 35]
    pairs = neighbours.close_pairs(got, frame(spark, x), 0.94)
    assert pairs.filter("a >= b").count() == 0 and pairs.count() > 500


def test_few_rows(spark):
    assert neighbours.nearest(frame(spark, []), dim=8).count() == 0
    assert neighbours.nearest(frame(spark, np.eye(8)[:1]), dim=8).count() == 0
    assert neighbours.nearest(frame(spark, np.eye(8)[:3]), dim=8).count() == 6


def test_tile_bounds_keep_the_best(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(x).max(1, keepdims=True) / 127
    codes, error = neighbours.int8_codes(x, scale)
    products = neighbours.code_products(codes, codes)
    assert codes.dtype == np.int8 and np.array_equal(products, codes.astype(np.int64) @ codes.astype(np.int64).T)
    assert np.all(np.abs(x @ x.T - products * scale * scale.T) <= error[:, None] + error[None, :] + error[:, None] * error[None, :] + 1e-6)


def test_crowds_and_split_questions(spark):
    """Far more near-equal vectors than k, in one region whose questions and rows are both split: exact all the same."""
    rng = np.random.default_rng(6)
    x = np.eye(12)[0] + 1e-3 * rng.standard_normal((700, 12))
    got = {(r["id"], r["other"]) for r in neighbours.nearest(frame(spark, x), dim=12, cell=100, probes=99, block=150, asks=120).collect()}
    u = x.astype(np.float32).astype(float)
    u = (u / np.linalg.norm(u, axis=1, keepdims=True)).astype(np.float32).astype(float)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    fifth = np.sort(s, axis=1)[:, -5]
    assert len(got) == 3500 and all(s[i, j] >= fifth[i] - 1e-12 for i, j in got)


def test_recall_on_test_data(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/vector_store.parquet")
    got = neighbours.nearest(table, cell=200, probes=5)
    pdf = table.toPandas()
    rows, x = neighbours.unit_rows(__import__("pyarrow").array(pdf["embedding"].tolist(), __import__("pyarrow").list_(__import__("pyarrow").float32())), 64)
    want = brute(pdf["vec_id"].to_numpy()[rows], x.astype(float), 5)
    pairs = {(r["id"], r["other"]) for r in got.collect()}
    assert len(pairs & want) >= 0.9 * len(want)


def test_markov_clusters(spark):
    edges = [(a, b, 1.0) for g in (range(5), range(5, 9)) for a in g for b in g if a < b] + [(4, 5, 0.05), (None, 1, 1.0), (1, 2, -1.0), (20, 20, 1.0)]
    got = {r["node"]: r["cluster"] for r in clusters.markov_clusters(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()}
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(5, 9)}) == 1 and got[0] != got[8]
    assert got[20] == 20 and set(got) == set(range(9)) | {20}
    assert clusters.markov_clusters(spark.createDataFrame([], "src long, dst long, weight double")).count() == 0


def test_markov_matches_numpy(spark):
    rng = np.random.default_rng(3)
    w = np.triu(rng.random((12, 12)) * (rng.random((12, 12)) < 0.3), 1)
    w[:6, :6] += np.triu(np.ones((6, 6)), 1)
    w[6:, 6:] += np.triu(np.ones((6, 6)), 1)
    m = w + w.T
    np.fill_diagonal(m, m.max(0))
    m /= m.sum(0)
    for _ in range(40):
        m = (m @ m) ** 2
        m /= m.sum(0)
        m[m < 1e-4] = 0
        m /= m.sum(0)
    edges = [(i, j, float(w[i, j])) for i in range(12) for j in range(12) if w[i, j] > 0]
    got = {r["node"]: r["cluster"] for r in clusters.markov_clusters(spark.createDataFrame(edges, "src long, dst long, weight double")).collect()}
    want = m.argmax(0)
    assert {(i, j) for i in range(12) for j in range(12) if got[i] == got[j]} == {(i, j) for i in range(12) for j in range(12) if want[i] == want[j]}


def test_vector_clusters(spark):
    from sievebench.functions.vectors import sample_vmf

    rng = np.random.default_rng(4)
    x = np.r_[sample_vmf(np.eye(16)[0], 40.0, 300, rng), sample_vmf(np.eye(16)[1], 40.0, 100, rng), -np.eye(16)[5:6]]
    df = frame(spark, [*x, None, [0.0] * 16])
    members, assign = clusters.vector_clusters(df, dim=16, cells=24)
    rows = members.collect()
    got = {r["id"]: r["cluster"] for r in rows}
    assert len({got[i] for i in range(300) if i in got}) == 1 and len({got[i] for i in range(300, 400) if i in got}) == 1 and len(got) >= 395
    seeds = spark.createDataFrame([(7, np.eye(16)[0].tolist()), (7, np.eye(16)[0].tolist()), (8, np.eye(16)[0].tolist()), (-1, np.eye(16)[1].tolist()), (3, np.eye(16)[1].tolist())], "name int, z array<double>")
    named = clusters.named_clusters(members, assign(seeds, "z", ["name"]))
    names = {r["id"]: r["name"] for r in named.collect()}
    assert names[0] == 7 and names[350] == 3 and 400 not in names
    best = clusters.typical_members(named, 2).collect()
    assert {(r["name"], r["rank"]) for r in best} == {(7, 1), (7, 2), (3, 1), (3, 2)}
    empty, _ = clusters.vector_clusters(df.limit(0), dim=16)
    assert empty.count() == 0


def test_more_clusters_than_the_fewest_landmarks(spark):
    """Clusters are as many as there are, with landmarks that grow with the rows, and typical members have the strongest flow."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((700, 64))
    x = np.repeat(centres, 12, axis=0) + 0.3 * rng.standard_normal((8400, 64))
    far = rng.standard_normal((60, 64))
    df = frame(spark, [*x, *far])
    members, _ = clusters.vector_clusters(df, cells=2800)
    got = {r["id"]: (r["cluster"], r["flow"]) for r in members.collect()}
    own = [[got.get(12 * c + i, (None, 0))[0] for i in range(12)] for c in range(700)]
    whole = [set(o) for o in own]
    right = sum(len(w) == 1 and None not in w for w in whole)
    assert right >= 690 and len({next(iter(w)) for w in whole if len(w) == 1}) > 640  # the nearest few centres are at a cosine of 0.5
    named = members.withColumnRenamed("cluster", "name")
    best = clusters.typical_members(named, 1).collect()
    by = {}
    for c, flow in got.values():
        by[c] = max(by.get(c, 0), flow)
    assert all(abs(r["flow"] - by[r["name"]]) < 1e-12 for r in best)


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (10, 11), (5, 5), (None, 4)] + [(i, i + 1) for i in range(100, 140)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10} | {i: 100 for i in range(100, 141)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(100, 300)], "a long, b long"), most=1)
