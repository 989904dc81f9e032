"""Problems on texts: 1, 3, 5, 7, 8, 9."""

from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievebench.llm import leakage, near_duplicates, overlap, packing, splitting, subjects, tokens

WORDS = "red fox jumps over lazy dog near old mill while rain falls on quiet town street".split()


def plain_overlap(a, b):
    x, y = Counter(overlap.words(a)), Counter(overlap.words(b))
    shared = sum((x & y).values())
    total = sum(x.values()) + sum(y.values()) - shared
    return shared / total if shared else 0.0


def plain_groups(texts):
    parent = {k: k for k in texts}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(texts, 2):
        if plain_overlap(texts[a], texts[b]) >= 0.7 - 1e-12:
            parent[find(a)] = find(b)
    return {(min(a, b), max(a, b)) for a, b in combinations(texts, 2) if find(a) == find(b) and overlap.words(texts[a])}


def made_texts():
    import random

    rng = random.Random(5)
    out = {}
    for i in range(60):
        base = [rng.choice(WORDS) for _ in range(rng.randint(1, 14))] + [f"name{i // 3}"] * rng.randint(0, 2)
        out[len(out)] = " ".join(base)
        edited = [w for w in base if rng.random() > 0.1] + ["extra"] * (rng.random() < 0.4)
        rng.shuffle(edited)
        out[len(out)] = " ".join(edited).upper()
    for text in ("", "  ", "???", None, "what is it", "What is it?", "what_is_it please"):
        out[len(out)] = text
    return out


@pytest.mark.parametrize("floor", [0, 3, 64])
def test_groups_equal_brute_force(spark, monkeypatch, floor):
    monkeypatch.setattr(overlap, "FLOOR", floor)
    monkeypatch.setattr(near_duplicates.overlap, "hot_words", lambda t, c, floor=floor, bound=1 << 16, f=overlap.hot_words: f(t, c, floor, bound))
    texts = made_texts()
    rows = spark.createDataFrame([(k, v, "x", 1) for k, v in texts.items()], "ord long, text string, kind string, bag int")
    for block in (512, 3):
        groups = near_duplicates.similar_groups(rows, key="ord", kind="kind", block=block)
        got = {(r["ord_a"], r["ord_b"]) for r in near_duplicates.group_pairs(groups, "ord").collect()}
        assert got == plain_groups({k: v or "" for k, v in texts.items()})


def test_groups_of_copies_and_empty_tables(spark):
    schema = "ord long, text string, kind string"
    rows = spark.createDataFrame([(i, "the same text here", "a" if i % 2 else "b") for i in range(40)], schema)
    report = near_duplicates.group_report(near_duplicates.similar_groups(rows, key="ord", kind="kind"), "ord")
    assert {(r["kind"], r["size"], r["group_of"]) for r in report.collect()} == {("a", 20, 1), ("b", 20, 0)}
    assert report.filter("kept").count() == 2
    empty = near_duplicates.similar_groups(rows.limit(0), key="ord", kind="kind")
    assert near_duplicates.group_pairs(empty, "ord").count() == 0


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 4000}" for i in range(20_000))
    rows = spark.createDataFrame([(0, long), (1, long + " more"), (2, long[: len(long) // 3]), (3, "x" * 200_000)], "ord long, text string")
    got = near_duplicates.group_pairs(near_duplicates.similar_groups(rows, key="ord"), "ord").collect()
    assert [(r["ord_a"], r["ord_b"]) for r in got] == [(0, 1)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(range(12)), min_size=1, max_size=10), min_size=2, max_size=12))
def test_trie_equals_pairs(bags):
    records = {}
    for bag in bags:
        seen, words = Counter(), []
        for w in sorted(bag):
            seen[w] += 1
            words.append(w * 100 + seen[w])
        records.setdefault(tuple(sorted(words)), len(records))
    named = [(name, list(words)) for words, name in records.items()]
    parent = {n: n for n, _ in named}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in combinations(named, 2):
        shared = len(set(x) & set(y))
        if shared * 10 >= 7 * (len(x) + len(y) - shared):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    want = {(find(n), n) for n, _ in named if find(n) != n}
    assert {(min(a, b), max(a, b)) for a, b in near_duplicates.trie_links(named, 0.7)} == want


def test_cross_split(spark):
    texts = made_texts()
    rows = [(f"q{k}", v, ["train", "anchor", "oracle", None, "bench_dev"][k % 5], f"s{k % 2}", "clash") for k, v in texts.items()]
    rows += [("copy1", "hot query", "train", "s0", "x"), ("copy2", "hot query", "anchor", "s0", "x"), ("copy2", "hot query", "anchor", "s0", "x")]
    df = spark.createDataFrame(rows, "query_id string, text string, split string, source string, bag string")
    got = leakage.cross_split_overlaps(df, key="query_id")
    found = {r["query_id"]: r["best"] for r in got.filter("partners > 0").collect()}
    train = [t for _, t, s, _, _ in rows if s == "train"]
    want = {}
    for q, t, s, _, _ in rows:
        if s in leakage.EVALUATION and (best := max((plain_overlap(t, o) for o in train), default=0)) >= 0.7 - 1e-12:
            want[q] = best
    assert found == pytest.approx(want) and "copy2" in found
    assert got.count() == sum(s in leakage.EVALUATION for _, _, s, _, _ in rows)
    report = {(r["split"], r["source"]): (r["records"], r["affected"]) for r in leakage.leak_report(got).collect()}
    assert report["anchor", "s0"][1] >= 2
    assert leakage.cross_split_overlaps(df.limit(0), key="query_id").count() == 0


def test_splitting(spark):
    rows = [(0, "short"), (1, None), (2, ""), (3, " \n\t "), (4, "x" * 2500), (5, "A sentence here. " * 200), (6, "line\n\n" * 500), (7, "a" * 1000), (8, "a" * 1001), (9, " a　" * 600), (10, "é" * 3000), (4, "x" * 2500)]
    df = spark.createDataFrame([(a, b, 9, 9) for a, b in rows], "ord long, text string, start int, n_pieces int")
    got = splitting.split_texts(df, keep=["ord"]).collect()
    for ord_ in range(11):
        pieces = sorted((r for r in got if r["ord"] == ord_ and (ord_ != 4 or True)), key=lambda r: r["p_start"])
        text = " ".join((dict(rows)[ord_] or "").split())
        assert bool(pieces) == bool(text)
        if not pieces:
            continue
        spans = sorted({(r["p_start"], r["p_end"]) for r in pieces})
        assert (len(spans) > 1) == (len(text) > 1000) and spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(0 < b - a <= 1000 for a, b in spans)
        assert all(0 <= x[1] - y[0] <= 200 and y[1] > x[1] for x, y in zip(spans, spans[1:]))
        assert all(r["p_text"].replace("\n", " ") == text[r["p_start"] : r["p_end"]] for r in pieces)
    cut = [r for r in got if r["ord"] == 5 and r["p_piece"] < r["n_pieces"] - 1]
    assert all(r["p_text"].rstrip().endswith(".") for r in cut)
    assert splitting.split_texts(df.limit(0), keep=["ord"]).count() == 0
    with pytest.raises(ValueError):
        splitting.split_texts(df, keep=["ord"], limit=10, overlap=10)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\ń", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_splitting_invariants(text, limit, overlap_):
    pieces = splitting.split_text(text, limit, overlap_)
    flat = " ".join(text.split())
    assert "".join(p["text"][p["overlap"] :] for p in pieces).replace("\n", " ") == flat
    assert all(0 < len(p["text"]) <= limit and p["overlap"] <= overlap_ for p in pieces)
    assert all(text[p["source_start"]] == p["text"][0] or p["text"][0] in " \n" for p in pieces)


def test_tokens(spark, monkeypatch):
    texts = ["", None, "hello world", "<|endoftext|> x", "naïve 数据 🙂" * 50, "it's 42nd\r\n\t  end  ", "a1b2" * 5000, " " * 3000 + "x", "z" * 5000]
    whole = [tokens.encoding().encode_ordinary(t or "") for t in texts]
    monkeypatch.setattr(tokens, "STRETCH", 64)
    monkeypatch.setattr(tokens.stretches, "__defaults__", (64,))
    assert [tokens.encode(t) for t in texts] == whole
    assert all(tokens.decode(i) == (t or "") for i, t in zip(whole, texts))
    rows = spark.createDataFrame([(i, t, [7]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in tokens.token_ids(rows, keep=["doc_id"]).collect()}
    assert [got[i] for i in range(len(texts))] == whole and got[0] == got[1] == []
    assert 50256 not in got[3]
    assert tokens.token_ids(rows.limit(0), keep=["doc_id"]).count() == 0


def test_packing(spark):
    import random

    rng = random.Random(1)
    sizes = [rng.choice([0, 1, 5, 40, 99, 100, 101, 250]) for _ in range(500)] + [None]
    rows = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "id long, n int, bin string").repartition(7)
    packed = packing.pack(rows, key="id", size="n", capacity=100, open_bins=4, merge=3).collect()
    assert sum(r["n_tokens"] for r in packed) == sum(n or 0 for n in sizes)
    filled = Counter()
    for r in packed:
        filled[r["container"]] += r["n_tokens"]
    assert max(filled.values()) <= 100
    pieces = Counter(r["id"] for r in packed)
    assert all(pieces[i] == -(-(n or 0) // 100) for i, n in enumerate(sizes))
    least = -(-sum(n or 0 for n in sizes) // 100)
    assert len(filled) <= 1.35 * least
    assert packing.pack(rows.limit(0), key="id", size="n", capacity=100).count() == 0
    texts = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "id long, text string")
    assert [(r["id"], r["n_tokens"]) for r in packing.pack(texts, key="id").collect()] == [(1, 2)]
    assert packing.fill_report(packing.pack(texts, key="id")).first()["containers"] == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(1, 6))
def test_best_fit(sizes, open_bins):
    bins, filled = packing.BestFit(20, open_bins), Counter()
    for s in sizes:
        filled[bins.place(s)] += s
        assert bins.count <= open_bins + 1
    assert not filled or max(filled.values()) <= 20
    with pytest.raises(ValueError):
        bins.place(21)


def test_subjects(spark):
    import random

    rng = random.Random(3)
    lists = {
        "farm": "barley tractor manure silo herd plough".split(),
        "law": "court statute appeal clause verdict tort".split(),
        "sport": "goal referee striker league medal sprint".split(),
        "rail": "signal platform carriage locomotive junction freight".split(),
    }
    filler = ["thanks to everyone who answered", "more on that further down", "please tell them when something is wrong"]

    def sentence(s):
        a, b, c = rng.sample(lists[s], 3)
        return rng.choice([f"the {a} needs a {b} before the {c}", f"why the {a} lost its {b} and {c} remains open"])

    docs, truth = [], set()
    for i in range(200):
        kinds = [] if i % 10 == 9 else rng.sample(sorted(lists), 1 + i % 2)
        parts = [sentence(k) for k in kinds for _ in range(4)] + rng.sample(filler, 2)
        rng.shuffle(parts)
        docs.append((i, ". ".join(parts).capitalize() + ".", "clash"))
        truth |= {(i, k) for k in kinds}
    docs += [(900, None, "x"), (901, "", "x"), (902, "12345 !!!", "x")]
    examples = [(s, "en", sentence(s) + ". " + rng.choice(filler) + ".") for s in lists for _ in range(8)] + [(None, "en", "x"), ("law", None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    e = spark.createDataFrame(examples, "subject string, lang string, text string")
    found = subjects.document_subjects(d, e, key="doc_id", rank=8)
    got = {(r["doc_id"], r["subject"]) for r in found.filter("about >= 0.25 * sentences").collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got - truth) <= 0.05 * len(truth)
    assert subjects.document_subjects(d.limit(0), e, key="doc_id").count() == 0
    assert subjects.document_subjects(d, e.limit(0), key="doc_id").count() == 0


def test_held_out_passages(spark):
    """Passages left out of the examples get their own subject nearly always."""
    folder = "/root/testdata/sf0.01"
    every = spark.read.parquet(f"{folder}/subject_examples.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    held, rest = every.filter("example_id % 5 = 0"), every.filter("example_id % 5 <> 0")
    mixed = docs.union(held.selectExpr("-1 - example_id", "text"))
    found = subjects.document_subjects(mixed, rest, key="doc_id").filter("about >= 0.25 * sentences AND doc_id < 0")
    right = {(r["example_id"], r["subject"]) for r in held.collect()}
    got = {(-1 - r["doc_id"], r["subject"]) for r in found.collect()}
    assert len(got & right) >= 0.9 * len(right) and len(got - right) <= 0.1 * len(right)
