"""Pairs of a chunk are tested many at a time, and texts are signed many at a time, with the results of one by one."""

from fractions import Fraction

import numpy as np
import pyarrow as pa

from sievebench.llm import overlap

T = Fraction("0.7")


def test_pairs_are_tested_many_at_a_time(monkeypatch):
    """Chunks of 40 to 600 members, with and without a level before: few calls, and all pairs that pass."""
    rng = np.random.default_rng(12)
    sizes = [40, 600, 1, 300]
    members = np.zeros(sum(sizes), overlap.MEMBER)
    members["bag"], members["n"] = np.arange(len(members)), rng.integers(20, 60, len(members))
    members["c"], members["pos"] = rng.integers(0, 5, len(members)), rng.integers(1, 4, len(members))
    members["low"] = rng.choice([0, 1, 3, overlap._NONE, overlap._COLD], len(members))
    group = np.repeat(np.arange(4), sizes)
    order = overlap._in_order(members, group, T)
    m, calls, plain = overlap._columns(members[order], T), [], overlap.pair_ok

    def counted(a, b, *rest):
        calls.append(len(a))
        return plain(a, b, *rest)

    monkeypatch.setattr(overlap, "pair_ok", counted)
    a, b = overlap._group_pairs(group, m, T, False)
    one, two = np.triu_indices(len(group), 1)
    inside = group[one] == group[two]
    one, two = one[inside], two[inside]
    at = plain(one, two, m, overlap._most_table(m, T), False)
    assert len(calls) < 10 and sum(calls) < len(one)
    assert len(at) and {*zip(a.tolist(), b.tolist(), strict=True)} == {*zip(one[at].tolist(), two[at].tolist(), strict=True)}


def test_texts_are_signed_as_one_by_one(monkeypatch):
    rng = np.random.default_rng(13)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(30)], int(n))) for n in rng.integers(0, 40, 50)] + [None, "", "...", "w1 " * 20000, "new"]

    class Hot:
        value = {f"w{i}": 100 + i for i in range(20)}

    monkeypatch.setattr(overlap, "WORDS", 500)
    batch = pa.RecordBatch.from_arrays([pa.array(["k"] * len(texts)), pa.array(texts).cast(pa.binary())], ["kind", "text"])
    batches = list(overlap._sign_batches(Hot, True)(iter([batch])))
    rows = [r for b in batches for r in b.to_pylist()]
    known = overlap.Words(Hot.value)
    assert len(batches) > 3 and len(rows) == len(texts)
    for row, text in zip(rows, texts, strict=True):
        cold, hot = known.of(text)
        assert (row["bag"] is None) == (not cold and not hot)
        assert (row["cold"], row["hot"]) == ((cold, hot) if row["first"] else ([], []))
