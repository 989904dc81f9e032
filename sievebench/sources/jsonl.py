"""JSON-lines corpora, queries, qrels and metadata, and byte-stable writers."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievebench.functions.text import canonical_json, chunk_id, content_hash, sha16

CHUNK = "text string, doc_id string, page int, metadata map<string,string>"
QUERY = "query_id string, text string, timestamp string, metadata map<string,string>"
QRELS = "query_id string, qrels map<string,int>"


def _path(spark: SparkSession, path: str) -> Path:
    found = Path(path)
    if "://" not in path and not found.exists():
        raise FileNotFoundError(f"{path} does not exist; convert or generate the dataset first")
    return found


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each line that isn't blank, with ``line_no`` in file order; malformed JSON fails the job.

    ``line_no`` is the place of the line in the file, from positions of its partition, which a text source reads in order.
    """
    _path(spark, path)
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("mid"))
    raw = raw.withColumn("part", F.shiftright("mid", 33)).withColumn("at", F.col("mid").bitwiseAND((1 << 33) - 1))
    sizes = raw.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = raw.join(F.broadcast(before), "part")  # one row for each file split
    parsed = placed.filter(F.trim("value") != "").select((F.col("before") + F.col("at")).alias("line_no"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("line_no", "r.*")


def required(column: str, kind: str) -> Column:
    return F.when(F.col(column).isNull(), F.raise_error(F.lit(f"a {kind} row has no {column}"))).otherwise(F.col(column))


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    """``ord, chunk_id, doc_id, text, content_hash, page, metadata``; ids are computed from the contents."""
    rows = read_lines(spark, path, CHUNK).withColumn("text", required("text", "chunk")).withColumn("doc_id", required("doc_id", "chunk"))
    return rows.select(F.col("line_no").alias("ord"), chunk_id("text", "doc_id", "page").alias("chunk_id"), "doc_id", "text", content_hash("text").alias("content_hash"), "page", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """``ord, query_id, text, ts, metadata``; a missing id becomes ``q`` and the five-digit line number."""
    rows = read_lines(spark, path, QUERY).withColumn("text", required("text", "query"))
    return rows.select(F.col("line_no").alias("ord"), F.coalesce("query_id", F.format_string("q%05d", "line_no")).alias("query_id"), "text", F.to_timestamp("timestamp").alias("ts"), F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def with_metadata(rows: DataFrame) -> DataFrame:
    """``metadata`` as a map of strings, empty where there is none."""
    return rows.withColumn("metadata", F.coalesce(F.col("metadata").cast("map<string,string>"), F.create_map().cast("map<string,string>")))


def load_query_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``ord, metadata`` of every query, ``ord`` as in ``load_queries``."""
    return with_metadata(read_lines(spark, path, QUERY)).select(F.col("line_no").alias("ord"), "metadata")


def load_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, chunk_id, grade``."""
    return read_lines(spark, path, QRELS).select("query_id", F.explode("qrels").alias("chunk_id", "grade"))


def write_jsonl(df: DataFrame, path: str, ord_: str) -> str:
    """Rows as JSON lines with sorted keys in order of ``ord`` (not written), as one file; returns its SHA-256.

    For datasets that one machine is to read again; the rows stream through the driver and are never all held there.
    """
    digest, names = hashlib.sha256(), sorted(c for c in df.columns if c != ord_)
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    lines = df.orderBy(ord_).select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("line"))
    with target.open("wb") as out:
        for row in lines.toLocalIterator():
            line = (json.dumps(json.loads(row["line"]), sort_keys=True, ensure_ascii=False) + "\n").encode()
            digest.update(line)
            out.write(line)
    return digest.hexdigest()


def write_manifest(path: str, manifest: dict) -> None:
    Path(path).write_text(json.dumps(manifest, sort_keys=True, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256`` of every file below a folder, read in parallel."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def source_version(spark: SparkSession, path: str) -> str:
    """One digest of sorted relative paths and digests of files: the version of a source that names none."""
    root = str(Path(path).resolve())
    rows = sorted((r["path"].split(root)[-1].lstrip("/"), r["sha256"]) for r in file_digests(spark, path).collect())
    return hashlib.sha256(canonical_json(rows).encode()).hexdigest()


__all__ = ["load_chunks", "load_qrels", "load_queries", "read_lines", "sha16", "source_version", "write_jsonl", "write_manifest"]
