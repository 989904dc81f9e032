"""Posted chunks: pairs of enough overlap must meet in one, whatever words are hot and however long they are."""

from fractions import Fraction

import numpy as np
import pytest

from sievebench.llm import leakage, near_duplicates, overlap

VOCABULARY = [f"w{i}" for i in range(4000)]
T = Fraction(7, 10)


def member(words, hot, bag=0):
    """The members that a record's posted chunks make, by chunk."""
    known = overlap.Words(hot)
    cold, warm = known.of(" ".join(words))
    counts = (np.array([len(cold)]), np.array([len(warm)]))
    flat = np.array(cold, np.int64), np.array(warm, np.int64)
    posted = overlap.posted_chunks(flat[0], counts[0], flat[1], counts[1], known.weight, T)
    bits = overlap.parities(flat[1], counts[1])
    made = {}
    for i, chunk in enumerate(posted["chunk"].tolist()):
        made[chunk] = (bag, *(x[0] for x in bits), len(cold) + len(warm), len(cold), 0, posted["pos"][i], posted["low"][i], posted["len"][i], posted["level"][i])
    return made


def met(a, b, hot):
    """Whether a pair meets in a chunk and passes the bounds there."""
    x, y = member(a, hot), member(b, hot, 1)
    for chunk in x.keys() & y.keys():
        members = np.array([x[chunk], y[chunk]], overlap.MEMBER)
        m = overlap._columns(members[overlap._in_order(members, np.zeros(2), T)], T)
        if len(overlap._group_pairs(np.zeros(2), m, T, False)[0]):
            return True
    return False


def pair(rng, n, m, words):
    """Records of n <= m words that share just enough."""
    shared = -(-7 * (n + m) // 17)
    picked = rng.permutation(words).tolist()
    return picked[:n], picked[n - shared : n - shared + m]


@pytest.mark.parametrize("share", [0.0, 0.05, 0.15, 0.3, 1.0])
def test_all_pairs_of_enough_overlap_meet(share):
    """The share of cold words goes from none to all; no pair may be lost at any length."""
    rng = np.random.default_rng(int(share * 100))
    hot = {w: 100 + i for i, w in enumerate(VOCABULARY) if rng.random() >= share}
    for n in (1, 2, 3, 5, 7, 10, 16, 17, 23, 40, 64, 100, 250, 1000):
        for m in {n, n + 1, n * 6 // 5, n * 10 // 7}:
            if 7 * (n + m) <= 17 * n:
                lost = [p for p in (pair(rng, n, m, VOCABULARY) for _ in range(20 if n < 200 else 4)) if not met(*p, hot)]
                assert not lost, (n, m, len(lost))


def test_unequal_shares_of_cold_words():
    """One record has its differing words among the cold, the other among the hot."""
    rng = np.random.default_rng(7)
    hot = {w: 100 + i for i, w in enumerate(VOCABULARY[:2000])}
    for n in (10, 17, 40, 100, 300):
        for _ in range(30):
            differ = overlap.differing(2 * n, T) // 2
            base = rng.permutation(VOCABULARY[:2000])[: n + differ].tolist()
            one = base[: n - differ] + rng.permutation(VOCABULARY[2000:])[:differ].tolist()
            assert met(one, base[:n], hot)


def test_repeated_words():
    rng = np.random.default_rng(8)
    hot = {w: 100 + i for i, w in enumerate(VOCABULARY[:30])}
    for n in (20, 60, 200):
        for _ in range(40):
            one = rng.choice(VOCABULARY[:60], n).tolist()
            two = one[: n - overlap.differing(2 * n, T) // 2] + rng.choice(VOCABULARY[:60], overlap.differing(2 * n, T) // 2).tolist()
            assert met(one, two, hot)


def grouped(spark, rows, **options):
    df = spark.createDataFrame(rows, "ord long, text string, kind string")
    groups = near_duplicates.similar_groups(df, key="ord", kind="kind", **options)
    return {(r["kind"], r["ord_a"], r["ord_b"]) for r in near_duplicates.group_pairs(groups, "ord").collect()}


def test_many_kinds_stay_apart(spark):
    rows = [(i, "one two three four", f"k{i:05d}") for i in range(2000)]
    rows += [(5000, "a b c d e f g h i j", "z1"), (5001, "a b c d e f g h i k", "z2"), (5002, "a b c d e f g h l k", "z1"), (5003, "one two three four", "k00007")]
    assert grouped(spark, rows) == {("k00007", 7, 5003)}


@pytest.mark.parametrize("floor", [0, 64])
def test_blocks_of_a_hot_chunk(spark, monkeypatch, floor):
    """Many records share their hot words: the chunk is dealt to pairs of blocks, and nothing is lost."""
    plain = overlap.hot_words
    monkeypatch.setattr(overlap, "hot_words", lambda t, c, *a: plain(t, c, floor))
    rows = [(i, f"all share these same eight words here x{i // 2}", "a") for i in range(120)]
    everything = {("a", i, j) for i in range(120) for j in range(i + 1, 120)}
    assert grouped(spark, rows, block=16) == everything
    rows = [(i, f"all share four words {' '.join(f'own{i // 2}{c}' for c in 'abcdef')} {i}", "a") for i in range(120)]
    assert grouped(spark, rows, block=16) == {("a", i, i + 1) for i in range(0, 120, 2)}


def test_copies_in_all_batches_are_joined_once(spark):
    """A text that most rows repeat doesn't multiply the joined rows."""
    rows = spark.range(0, 40_000, 1, 16).selectExpr("concat('q', id) AS query_id", "'the same text again' AS text", "if(id % 2 = 0, 'train', 'anchor') AS split", "'s' AS source")
    hot = overlap.hot_words(rows, "text")
    signed = overlap.signatures(rows.selectExpr("split = 'train' AS train", "text"), keep=["train"], text="text", hot=hot)
    assert signed.filter("first").count() >= 16
    assert overlap.met(signed, hot, cross="train").count() == 1
    got = leakage.cross_split_overlaps(rows, key="query_id")
    assert got.filter("partners = 1 AND best = 1").count() == 20_000
