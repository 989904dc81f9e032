"""Mean directions that are parts of one cluster are merged in bounded memory."""

import tracemalloc

import numpy as np

from sievebench.llm import clusters


def plain(means, least):
    label = np.arange(len(means))
    near = means @ means.T >= least
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return np.unique(label, return_inverse=True)[1]
        label = new


def test_pairs_of_parts_are_not_all_held():
    """4,000 parts of one cluster are 16 million pairs."""
    rng = np.random.default_rng(4)
    means = clusters._unit(rng.standard_normal(16) + 0.1 * rng.standard_normal((4000, 16)))
    tracemalloc.start()
    parts = clusters._merged(means, 0.8)
    top = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not parts.any() and top < 120e6


def test_chains_are_merged_across_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    means = clusters._unit(rng.standard_normal((300, 5)))
    expected = plain(means, 0.9)
    for cosines in (1, 1000, 1 << 21):
        monkeypatch.setattr(clusters, "COSINES", cosines, raising=False)
        assert (clusters._merged(means, 0.9) == expected).all()
    assert 1 < expected.max() < 299 and len(clusters._merged(np.zeros((0, 5)), 0.9)) == 0
