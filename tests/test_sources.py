import json

import pytest
from pyspark.errors import PySparkException

from sievebench.sources import benchmarks, jsonl
from sievebench.sources.stores import Artifacts, EmbeddingTable, replay, unrecorded


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n\n", encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    path = lines(tmp_path / "q.jsonl", [{"text": "a"}, {"query_id": "x", "text": "b", "timestamp": "2023-01-01T00:00:00Z", "metadata": {"k": "v"}}])
    got = jsonl.load_queries(spark, path).orderBy("ord").collect()
    assert [r["query_id"] for r in got] == ["q00000", "x"] and got[0]["metadata"] == {} and got[1]["ts"] is not None
    chunks = lines(tmp_path / "c.jsonl", [{"text": "a  b", "doc_id": "d"}, {"text": "a b", "doc_id": "d"}])
    got = jsonl.load_chunks(spark, chunks).collect()
    assert got[0]["content_hash"] == got[1]["content_hash"] and got[0]["chunk_id"] == got[1]["chunk_id"]
    qrels = lines(tmp_path / "g.jsonl", [{"query_id": "x", "qrels": {"c1": 1, "c2": 2}}])
    assert jsonl.load_qrels(spark, qrels).count() == 2
    with pytest.raises(FileNotFoundError):
        jsonl.load_queries(spark, str(tmp_path / "none.jsonl"))
    with pytest.raises(PySparkException):
        jsonl.load_chunks(spark, lines(tmp_path / "bad.jsonl", [{"doc_id": "d"}])).collect()


def test_convert_corpus(spark, tmp_path):
    raw = tmp_path / "raw"
    lines(raw / "corpus.jsonl", [{"_id": "1", "title": "T", "text": "x"}, {"_id": "2", "title": "", "text": "y"}])
    lines(raw / "queries.jsonl", [{"_id": "b", "text": "qb"}, {"_id": "a", "text": "qa"}, {"_id": "c", "text": "none"}])
    (raw / "qrels").mkdir()
    (raw / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\na\t1\t0\nb\t2\t1\nc\t1\t0\n")
    (raw / "qrels/train.tsv").write_text("query-id\tcorpus-id\tscore\na\t1\t2\na\t9\t1\n")
    first = benchmarks.convert_corpus(spark, str(raw), str(tmp_path / "o1"), "toy")
    second = benchmarks.convert_corpus(spark, str(raw), str(tmp_path / "o2"), "toy")
    assert first == second and first["counts"] == {"chunks": 2, "queries": 2, "qrels": 2}
    texts = [json.loads(x) for x in (tmp_path / "o1/chunks.jsonl").read_text().splitlines()]
    assert texts[0]["text"] == "T\n\nx" and texts[1]["text"] == "y"
    assert [json.loads(x)["query_id"] for x in (tmp_path / "o1/queries.jsonl").read_text().splitlines()] == ["b", "a"]
    with pytest.raises(FileNotFoundError):
        benchmarks.read_qrels(spark, str(tmp_path))


def test_convert_spans(spark, tmp_path):
    raw = tmp_path / "raw"
    (raw / "corpus/nda").mkdir(parents=True)
    (raw / "corpus/nda/a.txt").write_text("word " * 400)
    (raw / "benchmarks").mkdir()
    tests = [{"query": "q?", "snippets": [{"file_path": "nda/a.txt", "span": [0, 100]}, {"file_path": "nda/none.txt", "span": [0, 5]}]}]
    (raw / "benchmarks/nda.json").write_text(json.dumps({"tests": tests}))
    manifest = benchmarks.convert_spans(spark, str(raw), str(tmp_path / "out"))
    assert manifest["counts"]["queries"] == 1 and manifest["counts"]["qrels"] == 1 and manifest["counts"]["unmatched_spans"] == 1
    assert json.loads((tmp_path / "out/queries.jsonl").read_text())["query_id"] == "nda_0000"


def test_embedding_table(spark, tmp_path):
    store = EmbeddingTable(spark, str(tmp_path / "e"), 2)
    rows = lambda *x: spark.createDataFrame(list(x), "ord int, id string, embedding array<double>")
    store.add(rows((0, "a", [1.0, 2.0])))
    for bad in (rows((0, "a", [1.0, 2.0])), rows((0, "b", [1.0])), rows((0, "c", [1.0, 1.0]), (1, "c", [1.0, 1.0]))):
        with pytest.raises(ValueError):
            store.add(bad)
    store.upsert(rows((0, "a", [9.0, 9.0]), (1, "b", [3.0, 4.0]), (2, "b", [5.0, 5.0])))
    got = store.get(spark.createDataFrame([(0, "b"), (1, "a")], "ord int, id string")).orderBy("ord").collect()
    assert [r["embedding"] for r in got] == [[3.0, 4.0], [1.0, 2.0]]
    with pytest.raises(PySparkException):
        store.get(spark.createDataFrame([(0, "zz")], "ord int, id string")).collect()


def test_artifacts_and_transcripts(spark, tmp_path):
    held = Artifacts(str(tmp_path / "art"))
    held.save_json("a.json", {"b": 1, "a": "é"})
    assert (tmp_path / "art/a.json").read_text() == '{"a":"é","b":1}' and held.load_json("a.json") == {"a": "é", "b": 1}
    held.save_table("t", spark.range(3))
    assert held.load_table(spark, "t").count() == 3
    (tmp_path / "art/a.json").write_text("{}")
    with pytest.raises(ValueError):
        held.load_json("a.json")
    with pytest.raises(KeyError):
        held.load_json("none.json")
    asked = spark.createDataFrame([("k1",), ("k2",), ("k2",)], "key string")
    known = spark.createDataFrame([("k1", "r")], "key string, response string")
    assert [r["key"] for r in unrecorded(asked, known).collect()] == ["k2"]
    with pytest.raises(PySparkException):
        replay(asked, known).collect()
