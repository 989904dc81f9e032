"""Public benchmark layouts: corpora with titles, graded TSV qrels, and span-annotated documents."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievebench.functions.text import chunk_id, content_hash
from sievebench.operators.ranking import numbered
from sievebench.operators.spans import gold_chunks, split_windows
from sievebench.sources import jsonl


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``ord, upstream_id, title, text``."""
    return jsonl.read_lines(spark, path, "_id string, title string, text string").select(F.col("line_no").alias("ord"), F.col("_id").alias("upstream_id"), F.coalesce("title", F.lit("")).alias("title"), "text")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return jsonl.read_lines(spark, path, "_id string, text string").select(F.col("line_no").alias("ord"), F.col("_id").alias("query_id"), "text")


def read_qrels(spark: SparkSession, folder: str) -> DataFrame:
    """``query_id, upstream_id, grade`` of all TSV files, a pair's largest grade; a folder without any is an error."""
    if not sorted(Path(folder).glob("*.tsv")):
        raise FileNotFoundError(f"{folder} has no TSV files")
    schema = "query_id string, upstream_id string, grade int"
    return max_grades(spark.read.schema(schema).option("sep", "\t").option("header", True).option("pathGlobFilter", "*.tsv").csv(folder), ["query_id", "upstream_id"])


def max_grades(qrels: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each pair, with its largest grade."""
    return qrels.groupBy(*keys).agg(F.max("grade").alias("grade"))


def titled(title: str = "title", text: str = "text"):
    """Title, blank line and text; only the text where there is no title."""
    return F.when(F.coalesce(F.col(title), F.lit("")) != "", F.concat(F.col(title), F.lit("\n\n"), F.col(text))).otherwise(F.col(text))


def build_chunks(corpus: DataFrame) -> DataFrame:
    """One chunk for each document: ``ord, upstream_id, doc_id, text, chunk_id, content_hash``."""
    rows = corpus.select("ord", "upstream_id", F.col("upstream_id").alias("doc_id"), titled().alias("text"))
    return rows.select("*", chunk_id("text", "doc_id", F.lit(None)).alias("chunk_id"), content_hash("text").alias("content_hash"))


def binarize(qrels: DataFrame, chunks: DataFrame, threshold: int = 1) -> DataFrame:
    """``query_id, chunk_id, grade`` = 1 for grades at or above the threshold of known documents."""
    return qrels.filter(F.col("grade") >= threshold).join(chunks.select("upstream_id", "chunk_id"), "upstream_id").select("query_id", "chunk_id", F.lit(1).alias("grade")).distinct()


def convert_corpus(spark: SparkSession, raw: str, out: str, dataset: str, *, threshold: int = 1, license_note: str = "", version: str | None = None) -> dict:
    """A corpus, queries and qrels folder becomes three JSON-lines files and a manifest, byte-stable."""
    chunks = build_chunks(read_corpus(spark, f"{raw}/corpus.jsonl"))
    gold = binarize(read_qrels(spark, f"{raw}/qrels"), chunks, threshold)
    queries = read_queries(spark, f"{raw}/queries.jsonl").join(gold.select("query_id").distinct(), "query_id", "left_semi")
    maps = gold.groupBy("query_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("chunk_id", "grade")))).alias("qrels")).join(queries.select("query_id", "ord"), "query_id")
    digests = {
        "chunks.jsonl": jsonl.write_jsonl(chunks.select("ord", "text", "doc_id"), f"{out}/chunks.jsonl", "ord"),
        "queries.jsonl": jsonl.write_jsonl(queries.select("ord", "query_id", "text"), f"{out}/queries.jsonl", "ord"),
        "anchor_qrels.jsonl": jsonl.write_jsonl(maps, f"{out}/anchor_qrels.jsonl", "ord"),
    }
    manifest = {
        "dataset": dataset,
        "counts": {"chunks": chunks.count(), "queries": queries.count(), "qrels": gold.count()},
        "source_version": version or jsonl.source_version(spark, raw),
        "license_note": license_note,
        "output_sha256": digests,
    }
    jsonl.write_manifest(f"{out}/manifest.json", manifest)
    return manifest


#: Presets of ``convert_corpus``: the least grade that counts as relevant, and the note on the licence.
PRESETS = {
    "fiqa": {"threshold": 1, "license_note": "research use; see the terms of the source"},
    "nfcorpus": {"threshold": 1, "license_note": "research use; see the terms of the source"},
}


def convert_preset(spark: SparkSession, name: str, raw: str, out: str) -> dict:
    """``convert_corpus`` with the settings of a known benchmark; an unknown name is an error."""
    if name not in PRESETS:
        raise KeyError(f"unknown preset {name!r}; known: {sorted(PRESETS)}")
    return convert_corpus(spark, raw, out, name, **PRESETS[name])


def discover_subcorpora(raw: str) -> list[str]:
    """The names of the benchmark files, sorted; a missing folder or one without any is an error."""
    folder = Path(raw, "benchmarks")
    if not folder.is_dir():
        raise FileNotFoundError(f"{folder} is missing; expected <raw>/benchmarks/<subcorpus>.json")
    names = sorted(p.stem for p in folder.glob("*.json"))
    if not names:
        raise FileNotFoundError(f"{folder} has no JSON files")
    return names


def read_benchmark(path: Path) -> list[dict]:
    """The entries of a file: a bare list, or an object with a list named ``tests``."""
    data = json.loads(path.read_text(encoding="utf-8"))
    entries = data.get("tests") if isinstance(data, dict) else data
    if not isinstance(entries, list):
        raise TypeError(f"{path} is neither a list nor an object with a list of tests")
    return entries


def convert_spans(spark: SparkSession, raw: str, out: str, dataset: str = "legal") -> dict:
    """Whole-text documents and JSON files of queries with character spans become chunks, queries and qrels.

    Documents are split into windows, a chunk is gold for a query whose span it covers enough of, query ids are the file's
    stem and a four-digit number, and spans of unknown documents are counted in the manifest.
    """
    root = str(Path(raw, "corpus").resolve())
    docs = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(f"{raw}/corpus").select(F.substring_index("_metadata.file_path", root + "/", -1).alias("doc_id"), F.col("value").alias("text"))
    windows = split_windows(docs, keep=["doc_id"])
    chunks = windows.select("doc_id", "start", "end", "text", F.substring_index("doc_id", "/", 1).alias("subcorpus"))
    chunks = chunks.select("*", chunk_id("text", "doc_id", F.lit(None)).alias("chunk_id"), F.concat_ws("|", "doc_id", F.format_string("%010d", "start")).alias("place"))
    chunks = numbered(chunks, "place", "ord").drop("place")
    spans = spark.createDataFrame(list(_benchmark_rows(raw)), "query_id string, query string, doc_id string, start int, end int")
    gold = gold_chunks(spans, chunks)
    queries = numbered(spans.groupBy("query_id").agg(F.first("query").alias("text")), "query_id", "ord")
    maps = gold.groupBy("query_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("chunk_id", F.lit(1).alias("grade"))))).alias("qrels"))
    maps = numbered(maps, "query_id", "ord")
    tagged = chunks.select("ord", "text", "doc_id", F.create_map(F.lit("subcorpus"), "subcorpus").alias("metadata"))
    digests = {
        "chunks.jsonl": jsonl.write_jsonl(tagged, f"{out}/chunks.jsonl", "ord"),
        "queries.jsonl": jsonl.write_jsonl(queries, f"{out}/queries.jsonl", "ord"),
        "anchor_qrels.jsonl": jsonl.write_jsonl(maps, f"{out}/anchor_qrels.jsonl", "ord"),
    }
    unmatched = spans.join(docs, "doc_id", "left_anti").groupBy("doc_id").count().orderBy("doc_id").collect()  # one row for each wrong path
    lost = sum(r["count"] for r in unmatched)
    if lost:
        warnings.warn(f"{lost} spans of {len(unmatched)} unknown documents, such as {unmatched[0]['doc_id']}", stacklevel=2)
    manifest = {"dataset": dataset, "counts": {"chunks": chunks.count(), "queries": queries.count(), "qrels": gold.count(), "unmatched_spans": lost}, "source_version": jsonl.source_version(spark, raw), "license_note": "", "output_sha256": digests}
    jsonl.write_manifest(f"{out}/manifest.json", manifest)
    return manifest


def _benchmark_rows(raw: str) -> Iterator[tuple]:
    for name in discover_subcorpora(raw):
        for i, test in enumerate(read_benchmark(Path(raw, "benchmarks", f"{name}.json"))):
            for snippet in test["snippets"]:
                yield f"{name}_{i:04d}", test["query"], snippet["file_path"], int(snippet["span"][0]), int(snippet["span"][1])


__all__ = ["PRESETS", "binarize", "build_chunks", "convert_corpus", "convert_preset", "convert_spans", "discover_subcorpora", "max_grades", "read_corpus", "read_qrels", "read_queries", "titled"]
