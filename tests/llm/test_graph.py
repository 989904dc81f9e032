"""Markov clustering of the vectors' own graph."""

import numpy as np

from sievebench.llm import clusters


def partition(rows):
    by = {}
    for node, cluster in rows:
        by.setdefault(cluster, set()).add(node)
    return {frozenset(v) for v in by.values()}


def test_every_vector_is_a_node(spark, monkeypatch):
    """Of 90 vectors in three clusters and two unusable ones, the first graph that is clustered has the 90 as nodes."""
    rng = np.random.default_rng(7)
    x = np.repeat(np.eye(16)[:3], 30, axis=0) + 0.1 * rng.standard_normal((90, 16))
    rows = [(1000 + i, [float(a) for a in v]) for i, v in enumerate(x)] + [(5, None), (6, [0.0] * 16)]
    nodes, plain = [], clusters.markov_clusters

    def seen(edges, **options):
        nodes.append({n for r in edges.collect() for n in (r["src"], r["dst"])})
        return plain(edges, **options)

    monkeypatch.setattr(clusters, "markov_clusters", seen)
    members, _ = clusters.vector_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), dim=16)
    got = [(r["id"], r["cluster"]) for r in members.collect()]
    assert nodes[0] == set(range(1000, 1090))
    assert partition(got) == {frozenset(range(1000 + 30 * c, 1030 + 30 * c)) for c in range(3)}


def test_rounds_in_tables_and_in_one_task_agree(spark, monkeypatch):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b), float(rng.random())) for g in range(6) for a in range(8 * g, 8 * g + 8) for b in range(a + 1, 8 * g + 8) if rng.random() < 0.6]
    edges += [(8 * g, 8 * g + 8, 0.05) for g in range(5)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    one = partition((r["node"], r["cluster"]) for r in clusters.markov_clusters(df, most=6).collect())
    monkeypatch.setattr(clusters, "FEW", 20)
    monkeypatch.setattr(clusters, "PRODUCTS", 10)
    assert partition((r["node"], r["cluster"]) for r in clusters.markov_clusters(df, most=6).collect()) == one


def test_parts_and_one_task_agree(spark, monkeypatch):
    """A matrix in parts, by a hash or by given homes, and clusters joined in tables give what one task gives."""
    rng = np.random.default_rng(11)
    edges = [(a, b, float(rng.random())) for g in range(8) for a in range(9 * g, 9 * g + 9) for b in range(a + 1, 9 * g + 9) if rng.random() < 0.5]
    edges += [(9 * g, 9 * g + 9, 0.3) for g in range(7)]
    df = spark.createDataFrame(edges, "a long, b long, weight double")
    one = partition((r["node"], r["cluster"]) for r in clusters.graph_clusters(df).collect())
    homes = spark.createDataFrame([(i, i // 9 % 3) for i in range(70)], "node long, part int"), 3  # two nodes have none
    monkeypatch.setattr(clusters, "FEW", 20)
    monkeypatch.setattr(clusters, "TIES", 0, raising=False)
    monkeypatch.setattr(clusters, "PART", 10, raising=False)
    assert partition((r["node"], r["cluster"]) for r in clusters.graph_clusters(df).collect()) == one
    assert partition((r["node"], r["cluster"]) for r in clusters.graph_clusters(df, homes=homes).collect()) == one


def test_columns_travel_once_to_a_part():
    """A column that many of another part's name goes there once, where each product went before."""
    n = 50
    col, row = np.repeat(np.arange(n), 2), np.stack([np.arange(n), np.full(n, 1000)], 1).ravel()
    own = clusters._state(0, (col, row, np.full(2 * n, 0.5)), np.tile([0, 1], n))
    other = clusters._state(1, (np.array([1000, 1000]), np.array([7, 1000]), np.array([0.5, 0.5])), np.array([0, 1]))
    sent = list(clusters._ask(iter([own, other])))
    answered = list(clusters._answer(iter(sent)))
    moved = [(to, src, clusters._unpacked(blob)[0][0].tolist()) for b in answered for to, src, blob in zip(*(c.to_pylist() for c in b.columns), strict=True) if to != src]
    assert sorted(moved) == [(0, 1, [1000, 1000]), (1, 0, [7, 7])]
    (state,) = [b for b in clusters._multiply(2.0, 1e-4, 6)(iter(answered)) if b.column(0)[0].as_py() == 0]
    (c, r, p), at = clusters._unpacked(state.column(3)[0].as_py())
    assert [(int(x), round(float(w), 4)) for x, w in zip(r[c == 3], p[c == 3], strict=True)] == [(3, round(0.0625 / 0.375, 4)), (7, round(0.0625 / 0.375, 4)), (1000, round(0.25 / 0.375, 4))]
    assert at[c == 3].tolist() == [0, 0, 1]
