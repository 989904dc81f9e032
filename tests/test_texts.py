import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sievebench.functions import text as T
from sievebench.operators.fidelity import distinct_n
from sievebench.operators.lexical import bm25, hashed_embeddings, hashed_vector
from sievebench.operators.spans import gold_chunks, split_windows, windows

ODD = ["", " a  b ", "a  b　c", "x\x1cy\x1fz", " q", "tab\tand\nline", "é ü"]


def test_identity(spark):
    rows = spark.createDataFrame([(i, t, "d", 3) for i, t in enumerate(ODD)], "i int, text string, doc string, page int")
    got = rows.select("i", T.norm("text").alias("n"), T.content_hash("text").alias("h"), T.chunk_id("text", "doc", "page").alias("c"), T.stable_hash64("text").alias("u")).orderBy("i").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r, t in zip(got, ODD):
        n = " ".join(t.split())
        assert (r["n"], r["h"], r["c"]) == (n, sha(n)[:16], sha(f"{n}|d|3|None")[:16])
        assert int(r["u"]) == int(sha(t)[:16], 16)


def test_ngrams_and_distinct(spark):
    def rate(texts, n):
        return distinct_n(spark.createDataFrame([(t,) for t in texts], "text string"), "text", n).first()[0]

    assert rate(["a b", "a b"], 1) == 0.5
    assert rate(["a b c", "a b"], 2) == pytest.approx(2 / 3)
    assert rate(["a", "b c"], 2) == 1
    assert rate([None, ""], 1) == 0
    with pytest.raises(ValueError):
        T.word_ngrams("text", 0)


def test_windows():
    assert windows("ABCDE FGHI" * 230) == [(0, 995), (795, 1785), (1585, 2300)]
    assert windows("x" * 1500) == [(0, 1000), (800, 1500)]
    assert windows("") == windows(None) == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400))
def test_windows_cover(text):
    spans = windows(text, 50, 10)
    assert all(0 <= a < b <= len(text) and b - a <= 50 for a, b in spans)
    assert not text or (spans[0][0] == 0 and spans[-1][1] == len(text))
    assert all(x[1] - y[0] == 10 for x, y in zip(spans, spans[1:]))


def test_split_and_gold(spark):
    docs = spark.createDataFrame([("a", "x" * 1500), ("b", ""), ("c", None)], "doc_id string, text string")
    assert [(r["start"], r["end"]) for r in split_windows(docs, keep=["doc_id"]).orderBy("start").collect()] == [(0, 1000), (800, 1500)]
    chunks = spark.createDataFrame([("d", "c0", 0, 250), ("d", "c1", 200, 450), ("d", "c2", 380, 600)], "doc_id string, chunk_id string, start int, end int")
    spans = spark.createDataFrame([("q", "d", 100, 400)], "query_id string, doc_id string, start int, end int")
    assert sorted(r["chunk_id"] for r in gold_chunks(spans, chunks).collect()) == ["c0", "c1"]
    far = spark.createDataFrame([("d", "c0", 800, 1000), ("d", "c1", 900, 1150)], "doc_id string, chunk_id string, start int, end int")
    long = spark.createDataFrame([("q", "d", 0, 1000)], "query_id string, doc_id string, start int, end int")
    assert [r["chunk_id"] for r in gold_chunks(long, far).collect()] == ["c0"]


def test_verdicts_and_replies(spark):
    assert T.parse_verdict('so {"answerable": true, "answer": "x", "confidence": 0.5} end') == (True, "x", 0.5)
    assert T.parse_verdict("{bad {") == T.parse_verdict(None) == T.parse_verdict('{"answer": 1}') == (False, "", 0.0)
    row = spark.createDataFrame([("Evidence:\n[chunk] one two\n[chunk] three",)], "p string")
    reply = row.select(T.mock_reply(0, "s", F.col("p")).alias("r"), T.verdict("p").alias("v")).first()
    digest = hashlib.sha256("0|s|Evidence:\n[chunk] one two\n[chunk] three".encode()).hexdigest()[:8]
    assert reply["r"] == f"what about one two three ({digest})?" and reply["v"]["answerable"] is False


def test_hashed_vectors(spark):
    got = hashed_embeddings(spark.createDataFrame([(1, "abcd"), (2, ""), (3, None)], "i int, text string"), keep=["i"]).orderBy("i").collect()
    assert got[0]["vector"] == pytest.approx(hashed_vector("ABCD").tolist())
    assert got[1]["vector"][0] == 1.0 and got[2]["vector"] is None


def test_bm25(spark):
    items = spark.createDataFrame([("a", "red fox"), ("b", "red red dog"), ("c", ""), ("d", None), ("e", "red fox")], "item string, text string")
    queries = spark.createDataFrame([("q", "fox"), ("none", "zebra"), ("empty", "")], "qid string, text string")
    got = bm25(queries, items, 5).orderBy("rank").collect()
    assert [(r["qid"], r["item"]) for r in got] == [("q", "a"), ("q", "e")]


def test_missing_group_raises(spark):
    from sievebench.operators.sampling import split_by_hash

    rows = spark.createDataFrame([("a", None)], "k string, g string")
    with pytest.raises(PySparkException):
        split_by_hash(rows, "k", {"x": 0.5, "y": 0.5}, by="g").collect()
    with pytest.raises(ValueError):
        split_by_hash(rows, "k", {"x": 0.5})
